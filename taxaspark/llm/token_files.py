"""Token ids on disk: patched frame-of-reference blocks with an index of block starts.

A file holds the ids of whole documents, end to end. Every stream of integers in
it (ids, document ids, document lengths, block starts) is written as blocks of
``BLOCK`` values: the block's minimum is subtracted, the differences are packed at
a width taken from their percentiles, and what does not fit is patched from a list
of exceptions. Layout::

    magic | id blocks | document-id blocks | length blocks | start blocks | footer (JSON) | its length | magic
"""

import json
import struct
import uuid
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, Window, functions as F

from taxaspark.llm.tables import materialize, scratch_path
from taxaspark.llm.tokens import encoded, tokenizer_path

MAGIC = b"PFORIDS1"
BLOCK = 4096
PERCENTILES = (75, 90, 95, 99, 100)
HEAD = "<IQBI"  # values, minimum, width, exceptions


def encode_block(values, percentiles=PERCENTILES) -> bytes:
    """One block of unsigned integers (``<u4`` or ``<u8``), at the percentile width that takes least room."""
    kind = values.dtype
    base = values.min()
    rest = values - base
    lengths = np.sort(np.frexp(rest.astype(np.float64))[1]) if kind.itemsize == 4 else np.sort(
        np.array([int(v).bit_length() for v in rest]))
    n, cost = len(values), 4 + kind.itemsize
    widths = sorted({int(lengths[min(n - 1, int(np.ceil(p / 100 * n)) - 1)]) if n else 0 for p in percentiles})
    width = min(widths, key=lambda w: n * w / 8 + cost * (n - np.searchsorted(lengths, w, side="right")))
    high = np.flatnonzero(rest >> kind.type(width)) if width < 8 * kind.itemsize else np.zeros(0, np.int64)
    bits = np.unpackbits(np.ascontiguousarray(rest).view(np.uint8).reshape(n, kind.itemsize), axis=1,
                         bitorder="little")[:, :width]
    return (struct.pack(HEAD, n, int(base), width, len(high)) + np.packbits(bits.ravel(), bitorder="little").tobytes()
            + high.astype("<u4").tobytes() + rest[high].tobytes())


def decode_block(data, at: int, kind):
    """The block that starts at byte ``at``: its values and the byte after it."""
    n, base, width, exceptions = struct.unpack_from(HEAD, data, at)
    at += struct.calcsize(HEAD)
    size = (n * width + 7) // 8
    bits = np.unpackbits(np.frombuffer(data, np.uint8, size, at), bitorder="little")[: n * width].reshape(n, width)
    wide = np.zeros((n, 8 * kind.itemsize), np.uint8)
    wide[:, :width] = bits
    values = np.packbits(wide, axis=1, bitorder="little").view(kind).ravel().copy()
    at += size
    if exceptions:
        where = np.frombuffer(data, "<u4", exceptions, at)
        at += 4 * exceptions
        values[where] = np.frombuffer(data, kind, exceptions, at)
        at += kind.itemsize * exceptions
    return values + kind.type(base), at


U4, U8 = np.dtype("<u4"), np.dtype("<u8")


class Writer:
    """Streams documents into one file; holds one open block and the index."""

    def __init__(self, out, percentiles=PERCENTILES):
        self.out, self.percentiles = out, percentiles
        self.at, self.open, self.held = 0, [], 0
        self.starts, self.ids, self.lengths, self.tokens = [], [], [], 0
        self._put(MAGIC)

    def _put(self, data):
        self.out.write(data)
        self.at += len(data)

    def add(self, doc_id, ids: bytes):
        self.ids.append(doc_id)
        self.lengths.append(len(ids) // 4)
        self.tokens += len(ids) // 4
        self.open.append(ids)
        self.held += len(ids)
        if self.held >= 4 * BLOCK:
            values = np.frombuffer(b"".join(self.open), U4)
            full = len(values) // BLOCK * BLOCK
            for i in range(0, full, BLOCK):
                self._block(values[i:i + BLOCK])
            rest = values[full:].tobytes()
            self.open, self.held = [rest], len(rest)

    def _block(self, values):
        self.starts.append(self.at)
        self._put(encode_block(values, self.percentiles))

    def _stream(self, values):
        at = self.at
        for i in range(0, len(values), BLOCK):
            self._put(encode_block(values[i:i + BLOCK], self.percentiles))
        return at

    def close(self):
        if self.held:
            self._block(np.frombuffer(b"".join(self.open), U4))
        nulls = [i for i, x in enumerate(self.ids) if x is None]
        ids = np.array([0 if x is None else x for x in self.ids], np.int64).view(U8) ^ U8.type(1 << 63)
        footer = {"documents": len(self.ids), "tokens": self.tokens, "null_ids": nulls, "block": BLOCK,
                  "blocks": len(self.starts), "ids_at": self._stream(ids),
                  "lengths_at": self._stream(np.array(self.lengths, U4)),
                  "starts_at": self._stream(np.array(self.starts, U8))}
        data = json.dumps(footer).encode()
        self._put(data + struct.pack("<I", len(data)) + MAGIC)


class Reader:
    """Random access to one file, given as an object with ``read_at``-style seeks."""

    def __init__(self, file):
        self.file = file
        size = file.size()
        tail = self._bytes(size - 12, size)
        if tail[4:] != MAGIC:
            raise ValueError("not a token file, or one cut short")
        self.end = size - 12 - struct.unpack("<I", tail[:4])[0]
        self.footer = f = json.loads(self._bytes(self.end, size - 12))
        self.starts = self._stream(f["starts_at"], self.end, f["blocks"], U8).astype(np.int64)
        self.lengths = self._stream(f["lengths_at"], f["starts_at"], f["documents"], U4).astype(np.int64)
        ids = (self._stream(f["ids_at"], f["lengths_at"], f["documents"], U8) ^ U8.type(1 << 63)).view(np.int64)
        nulls = set(f["null_ids"])
        self.ids = [None if i in nulls else x for i, x in enumerate(ids.tolist())]
        self.data_end = f["ids_at"]

    def _bytes(self, start, end):
        self.file.seek(start)
        return self.file.read(end - start)

    def _stream(self, start, end, n, kind):
        data, at, parts = self._bytes(start, end), 0, []
        while at < len(data):
            values, at = decode_block(data, at, kind)
            parts.append(values)
        return np.concatenate(parts) if parts else np.zeros(0, kind)

    def tokens(self, start: int, n: int):
        """``n`` ids from position ``start``, reading only the blocks that hold them."""
        if n <= 0:
            return np.zeros(0, U4)
        first, last = start // BLOCK, (start + n - 1) // BLOCK
        end = self.starts[last + 1] if last + 1 < len(self.starts) else self.data_end
        data, at, parts = self._bytes(int(self.starts[first]), int(end)), 0, []
        while at < len(data):
            values, at = decode_block(data, at, U4)
            parts.append(values)
        return np.concatenate(parts)[start - first * BLOCK:][:n]

    def documents(self, run: int = 64 * BLOCK):
        """``(doc_id, start, ids)`` in order, decoding a run of blocks at a time."""
        at, held, held_at = 0, np.zeros(0, U4), 0
        for doc_id, n in zip(self.ids, self.lengths.tolist()):
            if at + n > held_at + len(held):
                # From this document's block on; a long document is one larger run.
                held_at = at // BLOCK * BLOCK
                held = self.tokens(held_at, min(max(run, at + n - held_at), self.footer["tokens"] - held_at))
            yield doc_id, at, held[at - held_at:at - held_at + n]
            at += n


def write_token_files(docs: DataFrame, folder: str, end_id: int = 2, tokenizer: str = None) -> DataFrame:
    """Write all documents in ascending doc_id order; the manifest ``(part, path, documents, tokens)``.

    Each range of ids is one file, named anew by each attempt at a task; only the
    files of attempts that succeeded are in the manifest, so a lost executor or a
    second attempt leaves no wrong file in it. Order within an id (rows that
    repeat one) follows a hash of the text, which also lets a repeated id span files.
    """
    path = tokenizer or tokenizer_path()
    end = np.array([end_id], U4).tobytes()

    def write(batches):
        from pyspark import TaskContext

        writer = stream = None
        for batch in batches:
            ids, texts = batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()
            for i, data in encoded(texts, path):
                if writer is None:
                    store, base = pyarrow.fs.FileSystem.from_uri(folder)
                    store.create_dir(base, recursive=True)
                    name = f"part-{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}.ids"
                    stream = store.open_output_stream(f"{base}/{name}")
                    writer = Writer(stream)
                writer.add(ids[i], data + end)
        if writer is not None:
            writer.close()
            stream.close()
            yield pa.RecordBatch.from_pydict({
                "part": [TaskContext.get().partitionId()], "path": [f"{folder}/{name}"],
                "documents": [len(writer.ids)], "tokens": [writer.tokens]})

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.withColumn("tie", F.xxhash64("text"))
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = rows.repartitionByRange(parts, "doc_id", "tie").sortWithinPartitions("doc_id", "tie")
    manifest = ordered.select("doc_id", "text").mapInArrow(write, "part long, path string, documents long, tokens long")
    return materialize(manifest, "manifest")


def read_token_files(manifest: DataFrame, with_ids: bool = False) -> DataFrame:
    """Per document, from the files: ``doc_id, start, n_tokens, ids_crc32[, ids]``; a file is a task's work."""
    first = manifest.withColumn("first", F.coalesce(F.sum("tokens").over(
        Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))  # a row per file, not per document
    files = manifest.sparkSession.conf.get("spark.sql.shuffle.partitions")

    def read(batches):
        for batch in batches:
            for path, start in zip(batch.column("path").to_pylist(), batch.column("first").to_pylist()):
                store, base = pyarrow.fs.FileSystem.from_uri(path)
                with store.open_input_file(base) as file:
                    rows = []
                    for doc_id, at, ids in Reader(file).documents():
                        rows.append((doc_id, start + at, len(ids), zlib.crc32(ids.tobytes()),
                                     *([ids.astype(np.int32)] if with_ids else ())))
                        if len(rows) == 4096:
                            yield _batch(rows, with_ids)
                            rows = []
                    yield _batch(rows, with_ids)

    def _batch(rows, with_ids):
        columns = list(zip(*rows)) if rows else [()] * (5 if with_ids else 4)
        kinds = [pa.int64()] * 4 + [pa.list_(pa.int32())]
        names = ["doc_id", "start", "n_tokens", "ids_crc32", "ids"]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=names[:len(columns)])

    schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + (", ids array<int>" if with_ids else "")
    return first.select("path", "first").repartition(int(files), "path").mapInArrow(read, schema)


def round_trip(docs: DataFrame, folder: str = None, **options) -> DataFrame:
    """Write the files and read them back.

    Null and empty texts are the end id alone; a null doc_id comes first and stays
    null; rows that repeat an id are documents of their own. Other columns are
    ignored. No rows write no file and give no rows.
    """
    folder = folder or scratch_path(docs.sparkSession, "token-ids")
    folder = folder if "://" in folder or folder.startswith("file:") else f"file://{folder}"
    return read_token_files(write_token_files(docs, folder, **options))
