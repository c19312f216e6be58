"""Sums over shared keys for all pairs of ids, as a tiled sparse product.

A pair measure such as Jensen–Shannon or Jaccard is a sum of ``f(x, y)`` over the
keys two ids share. A self join on the key sends one row per pair and key
through a shuffle; a key that most ids have makes that quadratic per key. Here
keys are numbered, the rows of an id are packed into one value, ids are hashed into
blocks, and an id is sent once to every tile ``(block, block, chunk)`` that needs it:
a few bytes per row and block. A tile adds the terms in NumPy, ``CELL_IDS`` ids against
as many at a time, and emits each of its pairs once, in batches. Block and chunk counts
come from the measured size, so a tile is bounded also when one id or one key holds much of the data.
"""

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from taxaspark.lineage import materialize

BLOCK_IDS = 8192
TILE_ROWS = 8_000_000
CELL_IDS = 1024
FEW_IDS = 256  # a block has no fewer ids on account of its rows; keys go to chunks then

# Pairs of rows expanded at a time inside a tile, rows of a packed value, rows of an output batch.
PAIR_BATCH = 1_000_000
PACKED_ROWS = 65_536
OUT_ROWS = 262_144

# Term of one shared key, given the two values.
TERMS = {
    "shared": lambda x, y: np.ones(len(x)),
    "min": np.minimum,
    "dot": np.multiply,
    "left": lambda x, y: x,
    "right": lambda x, y: y,
    "js_shared": lambda x, y: x * np.log(x / (x + y)) + y * np.log(y / (x + y)),
}

# Terms that are a product of what each side gives: the value, or 1. Cells where most ids have most keys are matrix products.
PRODUCTS = {"shared": (False, False), "dot": (True, True), "left": (True, False), "right": (False, True)}
DENSE = 50      # keys times pairs of ids for each pair of rows, at most, for a matrix product
DENSE_KEYS = 4096

_OUT = "a string, b string, s double, wa double, wb double"
_ARROW_OUT = pa.schema([
    ("a", pa.string()), ("b", pa.string()),
    ("s", pa.float64()), ("wa", pa.float64()), ("wb", pa.float64()),
])


def _numbered(rows: DataFrame, parts: int) -> DataFrame:
    """``id, side, code, x, w``: the key as a number (−1 for null), the same for equal keys and dense over all.

    A key's rows meet in one of ``parts`` partitions, where its place among the sorted keys is its number.
    """
    def code(batches):
        last, place = None, -1
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = batch.column("key").dictionary_encode()
            index, values = keys.indices.fill_null(-1).to_numpy(), keys.dictionary
            first = 0
            if len(values):
                first = place if values[0].as_py() == last else place + 1
                place, last = first + len(values) - 1, values[-1].as_py()
            codes = np.where(index < 0, -1, (first + index.astype(np.int64)) * parts + batch.column("part")[0].as_py())
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), batch.column("side"), pa.array(codes), batch.column("x"), batch.column("w")],
                names=["id", "side", "code", "x", "w"])

    number = lambda c: F.coalesce(F.col(c).cast("double"), F.lit(float("nan"))).alias(c)
    typed = rows.where("id is not null").select(
        F.col("id").cast("string").alias("id"), "side", F.col("key").cast("string").alias("key"), number("x"), number("w"))
    dealt = typed.repartition(parts, F.coalesce("key", "id")).sortWithinPartitions("key")
    return dealt.withColumn("part", F.spark_partition_id()).mapInArrow(code, "id string, side int, code long, x double, w double")


def _pack_codes(codes):
    """Ascending numbers as their steps, in as few bytes as the largest step needs."""
    steps = np.diff(codes, prepend=0)
    width = next(w for w in (1, 2, 4, 8) if not len(steps) or steps.max() < 1 << (8 * w - (w == 8)))
    return bytes([width]) + steps.astype(f"u{width}").tobytes()


def _unpack_codes(packed):
    return np.frombuffer(packed, f"u{packed[0]}", offset=1).astype(np.int64).cumsum()


def _pack_values(x):
    """Doubles; where they are few different ones, those and a byte for each row."""
    values, index = np.unique(x, return_inverse=True)
    if len(values) == 1:
        return b"\1" + values.tobytes()
    if len(values) <= 256 and 8 * len(values) < 7 * len(x):
        return b"\2" + bytes([len(values) - 1]) + values.tobytes() + index.astype(np.uint8).tobytes()
    return b"\0" + x.tobytes()


def _unpack_values(packed, n):
    kind = packed[0]
    if kind == 0:
        return np.frombuffer(packed, np.float64, offset=1)
    if kind == 1:
        return np.repeat(np.frombuffer(packed, np.float64, 1, 1), n)
    values = np.frombuffer(packed, np.float64, packed[1] + 1, 2)
    return values[np.frombuffer(packed, np.uint8, offset=2 + values.nbytes)]


def _packed(coded: DataFrame, chunks: int, parts: int) -> DataFrame:
    """``id, side, chunk, w, n, codes, xs``: the rows of an id and chunk packed, long ones into several values."""
    schema = pa.schema([("id", pa.string()), ("side", pa.int32()), ("chunk", pa.int32()), ("w", pa.float64()),
                        ("n", pa.int32()), ("codes", pa.binary()), ("xs", pa.binary())])

    def pack(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            codes, x, w = (batch.column(c).to_numpy() for c in ("code", "x", "w"))
            number = batch.column("id").dictionary_encode().indices.to_numpy().astype(np.int64)
            chunk, side = batch.column("chunk").to_numpy(), batch.column("side").to_numpy()
            starts = np.flatnonzero(np.diff((number * chunks + chunk) * 2 + side, prepend=-1))
            rows = []
            for start, end in zip(starts, [*starts[1:], len(codes)]):
                top = w[start:end].max()
                first = start + np.searchsorted(codes[start:end], 0)  # rows without a key come first
                for cut in range(first, max(end, first + 1), PACKED_ROWS):
                    stop = min(end, cut + PACKED_ROWS)
                    rows.append((start, top, stop - cut, _pack_codes(codes[cut:stop]), _pack_values(x[cut:stop])))
            at, top, n, keys, values = zip(*rows)
            at = pa.array(at)
            yield pa.RecordBatch.from_arrays(
                [batch.column("id").take(at), batch.column("side").take(at), batch.column("chunk").take(at),
                 pa.array(top, pa.float64()), pa.array(n, pa.int32()), pa.array(keys, pa.binary()), pa.array(values, pa.binary())],
                schema=schema)

    ordered = coded.repartition(parts, "id").sortWithinPartitions("id", "side", "chunk", "code")
    return ordered.select("id", "side", "chunk", "code", "x", "w").mapInArrow(
        pack, "id string, side int, chunk int, w double, n int, codes binary, xs binary")


class _Cell:
    """Some ids of one side of a tile, and their rows (position of the id, value) by ascending key."""

    def __init__(self, ids, rows):
        self.ids = ids
        codes = [_unpack_codes(k) for _, _, k, _ in rows]
        n = np.array([len(c) for c in codes], dtype=np.int64)
        codes = np.concatenate(codes) if rows else np.zeros(0, np.int64)
        place = np.repeat(np.array([p for p, _, _, _ in rows], dtype=np.int64), n)
        values = np.concatenate([_unpack_values(v, k) for (_, _, _, v), k in zip(rows, n)]) if rows else np.zeros(0)
        order = np.argsort(codes, kind="stable")
        codes, self.place, self.x = codes[order], place[order], values[order]
        self.start = np.flatnonzero(np.diff(codes, prepend=-1))
        self.key = codes[self.start]
        self.count = np.diff(self.start, append=len(codes))
        self.finite = bool(np.isfinite(self.x).all())


def _shared_keys(left, right):
    """Places of the keys that two cells share, in each."""
    if not len(left.key) or not len(right.key):
        return np.zeros((2, 0), np.int64)
    at = np.minimum(np.searchsorted(right.key, left.key), len(right.key) - 1)
    mine = np.flatnonzero(right.key[at] == left.key)
    return mine, at[mine]


def _table_of(cell, keys, valued):
    """Ids × some keys of a cell (their places): the summed values, or numbers of rows."""
    rows = np.repeat(cell.start[keys] - np.cumsum(cell.count[keys]) + cell.count[keys], cell.count[keys]) + np.arange(cell.count[keys].sum())
    column = np.repeat(np.arange(len(keys)), cell.count[keys])
    flat = np.bincount(cell.place[rows] * len(keys) + column, weights=cell.x[rows] if valued else None, minlength=len(cell.ids) * len(keys))
    return flat.reshape(len(cell.ids), len(keys)).astype(np.float64)


def _row_pairs(left, right, mine, theirs):
    """Index pairs (i, j) of rows of two cells with the same key, in batches."""
    pairs = left.count[mine] * right.count[theirs]
    batch = np.cumsum(pairs) // PAIR_BATCH
    for some in np.split(np.arange(len(mine)), np.nonzero(np.diff(batch))[0] + 1):
        if len(some):
            per_key, lstart, rstart, rcount = pairs[some], left.start[mine[some]], right.start[theirs[some]], right.count[theirs[some]]
            key = np.repeat(np.arange(len(some)), per_key)
            within = np.arange(len(key)) - np.repeat(np.cumsum(per_key) - per_key, per_key)
            yield lstart[key] + within // rcount[key], rstart[key] + within % rcount[key]


def _tile_function(term, combine, symmetric, all_pairs, top=None, ordered=False):
    f = TERMS[term]
    empty = math.inf if combine == "min" else 0.0
    product = PRODUCTS.get(term) if combine == "sum" else None

    def cells(ids, rows):
        """The ids of a side, in string order, and their packed rows, cut into cells."""
        owner = np.array([r[0] for r in rows], dtype=np.int64)
        out = []
        for start in range(0, len(ids), CELL_IDS):
            some = ids[start:start + CELL_IDS]
            place = np.searchsorted(some, owner)
            inside = np.flatnonzero((place < len(some)) & (some[np.minimum(place, len(some) - 1)] == owner))
            out.append(_Cell(some, [(place[k], *rows[k][1:]) for k in inside]))
        return out

    def sums(left, right, everything):
        """Terms added up for each pair of two cells, and the pairs that had any; nothing without any."""
        shape = (len(left.ids), len(right.ids))
        total = hit = None
        mine, theirs = _shared_keys(left, right)
        if product and len(mine) and left.finite and right.finite and (
                len(mine) * shape[0] * shape[1] <= DENSE * (left.count[mine] * right.count[theirs]).sum()):
            total, hit = np.zeros(shape), np.zeros(shape)
            for start in range(0, len(mine), DENSE_KEYS):
                x, y = mine[start:start + DENSE_KEYS], theirs[start:start + DENSE_KEYS]
                total += _table_of(left, x, product[0]) @ _table_of(right, y, product[1]).T
                if not everything:
                    hit += _table_of(left, x, False) @ _table_of(right, y, False).T
            return total.ravel(), hit.ravel() > 0
        for i, j in _row_pairs(left, right, mine, theirs):
            cell = left.place[i] * shape[1] + right.place[j]
            terms = f(left.x[i], right.x[j])
            if total is None:
                total, hit = np.full(shape[0] * shape[1], empty), np.zeros(shape[0] * shape[1], dtype=bool)
            if combine == "min":
                np.minimum.at(total, cell, terms)
            else:
                total += np.bincount(cell, weights=terms, minlength=len(total))
            hit[cell] = True
        return total, hit

    def tiles(batches):
        """The tiles of a task, one after the other."""
        held, number = [], None
        for batch in batches:
            if batch.num_rows:
                tile_of = batch.column("tile").to_numpy()
                starts = np.flatnonzero(np.diff(tile_of, prepend=-1))
                for start, end in zip(starts, [*starts[1:], len(tile_of)]):
                    if held and tile_of[start] != number:
                        yield from tile(held)
                        held = []
                    number = tile_of[start]
                    held.append(batch.slice(start, end - start))
        if held:
            yield from tile(held)

    def tile(batches):
        table = pa.Table.from_batches(batches)
        lo, hi, chunk = (table.column(c)[0].as_py() for c in ("lo", "hi", "chunk"))
        everything = all_pairs and chunk == 0
        encoded = table.column("id").combine_chunks().dictionary_encode()
        if isinstance(encoded, pa.ChunkedArray):
            encoded = encoded.unify_dictionaries().combine_chunks()
        names = encoded.dictionary.to_numpy(zero_copy_only=False)
        order = np.argsort(names)
        rank = np.empty(len(order), dtype=np.int64)
        rank[order] = np.arange(len(order))
        owner, names = rank[encoded.indices.to_numpy()], pa.array(names[order], pa.string())
        side = table.column("side").to_numpy()
        lweight, rweight = np.full((2, len(order)), -np.inf)
        for weight, rows in ((lweight, side == 0), (rweight, side == 1)):
            np.maximum.at(weight, owner[rows], table.column("w").to_numpy()[rows])
        if symmetric:  # an id is on one side only
            lweight = rweight = np.where(rweight == -np.inf, lweight, rweight)
        packed = list(zip(owner.tolist(), table.column("n").to_pylist(), table.column("codes").to_pylist(), table.column("xs").to_pylist()))
        of = lambda rows: cells(np.unique(owner[rows]), [packed[k] for k in np.flatnonzero(rows)])
        same = symmetric and lo == hi
        lefts = of(np.ones(len(owner), dtype=bool)) if same else of(side == 0)
        rights = lefts if same else of(side == 1)
        del packed, table

        def emitted(a, b, s):
            for start in range(0, len(a), OUT_ROWS):
                x, y = a[start:start + OUT_ROWS], b[start:start + OUT_ROWS]
                if symmetric:
                    x, y = np.minimum(x, y), np.maximum(x, y)
                yield pa.RecordBatch.from_arrays(
                    [names.take(pa.array(x)), names.take(pa.array(y)), pa.array(s[start:start + OUT_ROWS]),
                     pa.array(lweight[x]), pa.array(rweight[y])], schema=_ARROW_OUT)

        for place, left in enumerate(lefts):
            best = None
            for right in rights[place:] if same else rights:
                width = len(right.ids)
                if ordered and left.ids[0] >= right.ids[-1]:
                    continue
                total, hit = sums(left, right, everything)
                if hit is None and not everything:
                    continue
                if hit is None:
                    total = np.full(len(left.ids) * width, empty)
                at = np.arange(len(total)) if everything else np.flatnonzero(hit)
                if right is left and symmetric:  # every pair appears twice; keep the ordered one
                    at = at[at // width < at % width]
                if ordered:
                    at = at[left.ids[at // width] < right.ids[at % width]]
                i = at // width
                a, b, s = left.ids[i], right.ids[at - i * width], total[at]
                if top is None:
                    yield from emitted(a, b, s)
                    continue
                # The nearest so far of each id; ids are in string order, so the smaller one wins a tie.
                if best is not None:
                    a, b, s = (np.concatenate(x) for x in zip(best, (a, b, s)))
                order = np.lexsort((b, -(s / (lweight[a] + rweight[b] - s)), a))
                a, b, s = a[order], b[order], s[order]
                kept = np.arange(len(a)) - np.searchsorted(a, a) < top
                best = a[kept], b[kept], s[kept]
            if best is not None:
                yield from emitted(*best)

    return tiles


def tiled_pairs(
    left: DataFrame,
    right: DataFrame = None,
    term: str = "shared",
    combine: str = "sum",
    all_pairs: bool = False,
    block_ids: int = None,
    tile_rows: int = None,
    top: int = None,
    ordered: bool = False,
) -> DataFrame:
    """``(a, b, s, wa, wb)``: the combined term over the keys ids a and b share.

    Inputs are ``(id, key, x, w)``; ``w`` is a number per id that is passed
    through. With one input all pairs ``a < b`` of it are taken, with two the
    pairs left × right. Pairs without a shared key are missing, unless
    ``all_pairs`` asks for them (with an empty sum). ``top`` (two inputs, set sizes as
    ``w``) lets a tile that sees all keys leave out pairs that are not among the ``top`` of their left
    id by Jaccard similarity in the tile; the caller ranks what is left. ``ordered`` (two inputs)
    gives only the pairs ``a < b``. Rows with a null id are left out.
    """
    spark = left.sparkSession
    block_ids, tile_rows = block_ids or BLOCK_IDS, tile_rows or TILE_ROWS
    symmetric = right is None
    cores = spark.sparkContext.defaultParallelism
    parts = max(cores, int(spark.conf.get("spark.sql.shuffle.partitions")))
    rows = left.select("id", "key", "x", "w", F.lit(0).alias("side"))
    if not symmetric:
        rows = rows.unionByName(right.select("id", "key", "x", "w", F.lit(1).alias("side")))
    coded = materialize(_numbered(rows, parts), "numbered")
    per_id = coded.groupBy("side", "id").agg(F.count(F.lit(1)).alias("n"))
    measured = {r[0]: r[1:] for r in per_id.groupBy("side").agg(F.count(F.lit(1)), F.sum("n"), F.max("n")).collect()}
    sizes = [measured.get(k, (0, 0, 0)) for k in ((0,) if symmetric else (0, 1))]
    # Enough blocks to bound a tile, and enough tiles to keep the cluster busy.
    spread = math.ceil(math.sqrt(8 * cores if symmetric else 4 * cores))
    blocks = [
        max(1, math.ceil(ids / block_ids), min(spread, ids), min(math.ceil(ids / FEW_IDS), math.ceil(2 * n / tile_rows)))
        for ids, n, _ in sizes]
    tiled = sum((2 if symmetric else 1) * n / nb + largest for (_, n, largest), nb in zip(sizes, blocks))
    chunks = max(1, math.ceil(tiled / (2 * tile_rows)))

    coded = coded.withColumn("chunk", F.pmod("code", F.lit(chunks)).cast("int"))
    if all_pairs and chunks > 1:
        # One empty row per id in the first chunk, so that every pair is seen there.
        coded = coded.unionByName(coded.groupBy("side", "id").agg(F.max("w").alias("w")).select(
            "id", "side", F.lit(-1).cast("long").alias("code"), F.lit(0.0).alias("x"), "w", F.lit(0).alias("chunk")))
    packed = materialize(_packed(coded, chunks, parts), "packed")

    block = lambda nb: F.pmod(F.xxhash64("id"), F.lit(nb)).cast("int")
    others = lambda nb: F.explode(F.sequence(F.lit(0), F.lit(nb - 1)))
    columns = ["id", "w", "n", "codes", "xs", "chunk", "lo", "hi", "side"]
    if symmetric:
        nb = blocks[0]
        tiles = nb * (nb + 1) // 2
        sent = packed.withColumn("block", block(nb)).withColumn("other", others(nb)).withColumn(
            "lo", F.least("block", "other")).withColumn("hi", F.greatest("block", "other")).withColumn(
            "side", (F.col("block") > F.col("other")).cast("int")).select(columns)
    else:
        nl, nr = blocks
        tiles = nl * nr
        sent = packed.where("side = 0").withColumn("lo", block(nl)).withColumn("hi", others(nr)).select(columns).unionByName(
            packed.where("side = 1").withColumn("hi", block(nr)).withColumn("lo", others(nl)).select(columns))
    # A task for each tile: small inputs make large outputs, so their size says nothing.
    before = F.col("lo") * nr if not symmetric else F.col("lo") * (2 * nb - F.col("lo") - 1) / 2
    numbered = sent.withColumn("tile", ((before + F.col("hi")) * chunks + F.col("chunk")).cast("int"))
    pairs = numbered.repartitionById(min(tiles * chunks, 20_000), "tile").sortWithinPartitions("tile").mapInArrow(
        _tile_function(term, combine, symmetric, all_pairs, top if chunks == 1 and not symmetric else None, ordered), _OUT)
    if chunks == 1:
        return pairs
    total = F.min("s") if combine == "min" else F.sum("s")
    return pairs.groupBy("a", "b").agg(
        total.alias("s"), F.max("wa").alias("wa"), F.max("wb").alias("wb")
    )
