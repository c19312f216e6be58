"""Packing: neighbours along a space-filling curve share fixed-length sequences."""

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from taxaspark.llm import text as X
from taxaspark.llm.tables import materialize
from taxaspark.llm.tokens import KEPT_PIECES, encoded, tokenizer_path

DIMS, BITS, BUCKETS = 4, 12, 1024
RANGE_BYTES = 64 << 20
ROWS = 1024

PIECES = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()),
                    ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64())])
PIECES_SQL = ("doc_id long, start long, length long, ids_crc32 long, doc_tokens long, "
              "sequence_id long, offset long")


def slices(batches, rows: int = ROWS):
    """The same rows in order, at most ``rows`` at a time, so that few texts are Python objects at once."""
    for batch in batches:
        for start in range(0, batch.num_rows, rows):
            yield batch.slice(start, rows)


def hilbert_key(cells, bits: int = BITS):
    """Position along the Hilbert curve of integer points (n, dims) with ``bits`` bits a side.

    Skilling's transform (2004), column by column: undo the excess work of the
    high bits, Gray-encode, then interleave.
    """
    x = [cells[:, d].astype(np.uint64) for d in range(cells.shape[1])]
    for q in range(bits - 1, 0, -1):
        bit, low = np.uint64(1 << q), np.uint64((1 << q) - 1)
        for d in range(len(x)):
            up = (x[d] & bit) != 0
            swap = np.where(up, np.uint64(0), (x[0] ^ x[d]) & low)
            x[0] = np.where(up, x[0] ^ low, x[0] ^ swap)
            if d:
                x[d] = x[d] ^ swap
    for d in range(1, len(x)):
        x[d] = x[d] ^ x[d - 1]
    turn = np.zeros(len(cells), np.uint64)
    for q in range(bits - 1, 0, -1):
        turn = np.where((x[-1] & np.uint64(1 << q)) != 0, turn ^ np.uint64((1 << q) - 1), turn)
    key = np.zeros(len(cells), np.uint64)
    for q in range(bits - 1, -1, -1):
        for d in range(len(x)):
            key = (key << np.uint64(1)) | (((x[d] ^ turn) >> np.uint64(q)) & np.uint64(1))
    return key.astype(np.int64)


def projection(dims: int = DIMS):
    """Fixed Gaussian directions, one per hash bucket."""
    return np.random.default_rng(20240).standard_normal((BUCKETS, dims))


def curve_keys(texts, directions):
    """Hilbert keys of whole texts: hashed counts of byte triples, projected, averaged, laid on a grid."""
    sums, counts = np.zeros((len(texts), directions.shape[1])), np.zeros(len(texts))
    for group in X.groups(texts):
        sizes = np.array([len(p) + 2 for _, p in group])
        data = np.frombuffer((b"  ".join(p for _, p in group) + b"    ").translate(X.lower_table()), np.uint8).astype(np.uint32)
        many = int(sizes.sum())
        triple = data[:many] | data[1:many + 1] << np.uint32(8) | data[2:many + 2] << np.uint32(16)
        bucket = (triple * np.uint32(2654435761)) >> np.uint32(22)
        place = bucket + np.repeat(np.arange(len(group), dtype=np.uint32) * np.uint32(BUCKETS), sizes)
        # The last two places of a text would see its neighbour: they count nowhere.
        ends = np.cumsum(sizes)
        place[ends - 1] = place[ends - 2] = len(group) * BUCKETS
        table = np.bincount(place, minlength=len(group) * BUCKETS + 1)[:-1].reshape(len(group), BUCKETS)
        index = [i for i, _ in group]
        np.add.at(sums, index, table @ directions)
        np.add.at(counts, index, table.sum(axis=1))
    means = sums / np.maximum(counts, 1)[:, None]
    side = 1 << BITS
    cells = np.clip((means * 2 + 1) * side / 2, 0, side - 1).astype(np.int64)
    return hilbert_key(cells)


def keyed(docs: DataFrame) -> DataFrame:
    """``doc_id, text, spread``: null texts empty, and a hash that tells documents with equal curve keys apart."""
    text = F.coalesce("text", F.lit(""))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text")).withColumn("spread", F.xxhash64("doc_id", "text"))


def range_keys(curve, spread):
    """Sort key of a document: the curve's 48 bits, then 16 bits of the hash, as unsigned integers."""
    return curve.astype(np.uint64) << np.uint64(16) | spread.view(np.uint64) >> np.uint64(48)


def weighed(docs: DataFrame) -> DataFrame:
    """``key, bytes`` of every document."""
    def weigh(batches):
        directions = projection()
        for batch in slices(batches):
            texts = X.binary_column(batch, "text")
            keys = range_keys(curve_keys(texts, directions), batch.column("spread").to_numpy())
            yield pa.RecordBatch.from_arrays(
                [pa.array(keys.view(np.int64)), pa.array([len(t) + 1 for t in texts], pa.int64())], names=["key", "bytes"])

    return docs.mapInArrow(weigh, "key long, bytes long")


def cut_points(weights: DataFrame, parts: int, range_bytes: int, points: int = 1_000_000):
    """Keys that cut the curve into ranges of about equal bytes, at least ``parts``, of ``range_bytes`` at most beyond that.

    The cuts come from marks set every ``step`` bytes on average, a document taking as many as its
    bytes hold; so the driver receives about 64 marks a range, ``points`` in all, at any size.
    """
    total = weights.agg(F.sum("bytes")).first()[0] or 0
    ranges = max(parts, -(-total // range_bytes))
    step = max(total / min(points, 64 * ranges), 1.0)
    phase = F.pmod(F.xxhash64("key", "bytes"), F.lit(1 << 20)) / F.lit(float(1 << 20))
    marks = weights.select("key", F.floor(F.col("bytes") / F.lit(step) + phase).alias("marks")).where("marks > 0")
    found = marks.groupBy("key").agg(F.sum("marks").alias("marks")).collect()
    keys = np.array([r["key"] for r in found], np.int64).view(np.uint64)
    held = np.array([r["marks"] for r in found], np.int64)
    order = np.argsort(keys)
    before = np.cumsum(held[order]) - held[order]
    # A key belongs to the range its first mark lies in.
    number = before * ranges // max(int(held.sum()), 1)
    return keys[order][np.flatnonzero(np.diff(number, prepend=0))], ranges


def with_range(docs: DataFrame, cuts) -> DataFrame:
    """``doc_id, text, key, range``: place of every document along the curve and the number of its range."""
    def placed(batches):
        directions = projection()
        for batch in slices(batches):
            keys = range_keys(curve_keys(X.binary_column(batch, "text"), directions), batch.column("spread").to_numpy())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("text"), batch.column("spread"), pa.array((keys ^ np.uint64(1 << 63)).view(np.int64)),
                 pa.array(np.searchsorted(cuts, keys, "right"), pa.int32())], names=["doc_id", "text", "spread", "key", "range"])

    return docs.mapInArrow(placed, "doc_id long, text string, spread long, key long, range int")


class Packer:
    """Cuts a stream of documents into sequences; keeps only the open sequence."""

    def __init__(self, length, first_id):
        self.length, self.next_id = length, first_id
        self.open, self.used, self.done = [], 0, []

    def add(self, doc_id, ids):
        total, at = len(ids) // 4, 0
        while at < total:
            take = min(total - at, self.length - self.used)
            self.open.append((doc_id, at, ids[4 * at:4 * (at + take)], total))
            self.used, at = self.used + take, at + take
            if self.used == self.length:
                self.close()

    def close(self):
        offset = 0
        for doc_id, start, ids, total in self.open:
            n = len(ids) // 4
            self.done.append((doc_id, start, n, zlib.crc32(ids), total, self.next_id, offset, ids))
            offset += n
        self.next_id += 1
        self.open, self.used = [], 0

    def finish(self):
        """The rest, recut to falling powers of two, which need no padding."""
        rest, size = self.open, 1
        left = self.used
        self.open, self.used = [], 0
        while rest:
            size = 1 << (left.bit_length() - 1)
            room, later = size, []
            for doc_id, start, ids, total in rest:
                n = len(ids) // 4
                take = min(n, room)
                if take:
                    self.open.append((doc_id, start, ids[:4 * take], total))
                if take < n:
                    later.append((doc_id, start + take, ids[4 * take:], total))
                room -= take
            self.close()
            rest, left = later, left - size

    def batch(self, with_ids):
        columns = list(zip(*self.done)) if self.done else [()] * 8
        self.done = []
        arrays = [pa.array(c, f.type) for c, f in zip(columns, PIECES)]
        names = PIECES.names
        if with_ids:
            arrays.append(pa.array([np.frombuffer(x, "<u4").astype(np.int32) for x in columns[7]], pa.list_(pa.int32())))
            names = [*names, "ids"]
        return pa.RecordBatch.from_arrays(arrays, names=names)


def pack(docs: DataFrame, length: int = 1024, end_id: int = 0, tokenizer: str = None,
         with_ids: bool = False, range_bytes: int = RANGE_BYTES, kept_pieces: int = KEPT_PIECES) -> DataFrame:
    """Pieces ``(doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset[, ids])``.

    Documents are ranged by Hilbert key, ranges holding about equal bytes (a longer text is one
    range), and packed one behind the other, so a
    sequence holds neighbours; a document may be cut anywhere. The last, partly
    filled sequence of a range is recut to powers of two, so nothing is padded.
    Equal keys (copies) are spread over ranges by a hash of the id, so a group of
    copies of any size is several tasks' work. A task holds one open sequence, and
    a worker at most about twice ``kept_pieces`` pieces of text with their ids.

    Null and empty texts are the end id alone; a null doc_id is kept as null;
    rows that repeat an id are packed each on their own. Other columns are
    ignored. No rows give no pieces. ``sequence_id`` is unique, not gapless.
    """
    path = tokenizer or tokenizer_path()
    end = np.array([end_id], "<u4").tobytes()

    def packed(batches):
        packer = Packer(length, TaskContext.get().partitionId() << 33)
        for batch in slices(batches):
            ids, texts = batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()
            for i, data in encoded(texts, path, kept=kept_pieces):
                packer.add(ids[i], data + end)
                if len(packer.done) >= ROWS:
                    yield packer.batch(with_ids)
        packer.finish()
        yield packer.batch(with_ids)

    rows = keyed(docs)
    least = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cuts, ranges = cut_points(materialize(weighed(rows), "weights"), least, range_bytes)
    ranged = with_range(rows, cuts).repartitionById(ranges, "range").sortWithinPartitions("key", "spread", "doc_id")
    return ranged.select("doc_id", "text").mapInArrow(packed, PIECES_SQL + (", ids array<int>" if with_ids else ""))
