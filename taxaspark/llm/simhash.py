"""Near-duplicates by SimHash, searched by the generalised pigeonhole principle.

The 64 bits are cut into partitions, correlated bits together. A fingerprint gives its
partitions unequal thresholds t with sum(t + 1) = bits + 1 (a threshold of -1 leaves a
partition out), so another one within ``bits`` is within the threshold in at least one
partition. Which thresholds is settled per fingerprint by dynamic programming on
estimated numbers of probes and candidates. Probes meet the values of all fingerprints
in a join, and the pairs found are verified.
"""

from itertools import accumulate, combinations
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from taxaspark.llm import text as X
from taxaspark.llm.near import word_list
from taxaspark.llm.tables import materialize
from taxaspark.operators.graph import components

BITS = 64
SEED = 42
CHOICES = (2, 3, 4)  # numbers of partitions to choose from
BLOCK = 8            # bits of a block of the estimate: its table has 256 counts whatever the data
SMALL = 32           # values that more fingerprints share are linked by variants, not pair by pair


def fingerprint(data: bytes, shingle: int = 3) -> int:
    """SimHash of a text: bit i is 1 if it is set in over half the hashes of all shingles, repeats included.

    Read in pieces, so a long text needs no more memory than one piece's words.
    """
    digest = xxhash.xxh64_intdigest
    ones, total, words = np.zeros(BITS, np.int64), 0, []
    for piece in X.blocks(data):
        words = words + word_list(piece)
        n = len(words) - shingle + 1
        if n < 1:
            continue
        joined = b" ".join(words)
        sizes = [len(w) + 1 for w in words]
        starts = [0, *accumulate(sizes)]
        ends = starts[shingle:]
        hashes = np.array([digest(joined[s:e - 1], SEED) for s, e in zip(starts, ends)], "<u8")
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        total += n
        words = words[n:]
    if not total and words:
        return digest(b" ".join(words), SEED)
    return int(np.packbits(2 * ones > total, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """``doc_id, fp``: a row per document, the fingerprint as a signed long."""
    def signed(batches):
        for batch in batches:
            fps = np.array([fingerprint(t, shingle) for t in X.binary_column(batch, "text")], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(fps.view(np.int64))], names=["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(signed, "doc_id long, fp long")


def bit_rows(fps):
    """The bits of an array of fingerprints, a row each, the lowest bit first."""
    return np.unpackbits(np.ascontiguousarray(fps).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")


def summed(fps: DataFrame, tables) -> np.ndarray:
    """The sum over all fingerprints of ``tables(bits)``, a vector of fixed length."""
    def partial(batches):
        total = None
        for batch in batches:
            if batch.num_rows:
                part = tables(bit_rows(batch.column("fp").to_numpy()))
                total = part if total is None else total + part
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total))), pa.array(total.astype(np.int64))], names=["i", "n"])

    found = fps.select("fp").mapInArrow(partial, "i long, n long").groupBy("i").agg(F.sum("n").alias("n")).collect()
    out = np.zeros(len(found), np.int64)
    for row in found:
        out[row.i] = row.n
    return out


def correlated_parts(both, total, parts):
    """Bits in ``parts`` groups of near equal width, each grown by the bit most correlated with it.

    ``both[i, j]`` counts the fingerprints with bits i and j. A group starts at the bit that
    is most correlated with what is left, so correlated bits share a group (and, in order, a block).
    """
    share = both / max(total, 1)
    p = np.diag(share)
    spread = np.sqrt(np.maximum(p * (1 - p), 1e-12))
    strength = np.abs(share - np.outer(p, p)) / np.outer(spread, spread)
    np.fill_diagonal(strength, 0)
    left, groups = list(range(BITS)), []
    for k in range(parts):
        width = BITS * (k + 1) // parts - BITS * k // parts
        group = [max(left, key=lambda i: (strength[i, left].sum(), -i))]
        left.remove(group[0])
        while len(group) < width:
            group.append(max(left, key=lambda i: (strength[i, group].sum(), -i)))
            left.remove(group[-1])
        groups.append(group)
    return groups


class Plan(NamedTuple):
    """Partitions of the bits and what the estimate needs: chances of 0..bits differences by block and value."""
    groups: list
    chances: list  # per group, per block: array (values, bits + 1)
    total: int
    bits: int


def cut_blocks(group):
    return [group[i:i + BLOCK] for i in range(0, len(group), BLOCK)]


def block_values(rows, block):
    return rows[:, block].astype(np.int64) @ (1 << np.arange(len(block)))


def block_tables(groupings):
    """Counts of every value of every block of all groupings, end to end."""
    def tables(rows):
        return np.concatenate([np.bincount(block_values(rows, block), minlength=1 << len(block))
                               for groups in groupings for group in groups for block in cut_blocks(group)])
    return tables


def plans(groupings, counts, total, bits):
    """A plan of each grouping, from the counts :func:`block_tables` gave."""
    at, out = 0, []
    for groups in groupings:
        chances = []
        for group in groups:
            own = []
            for block in cut_blocks(group):
                size = 1 << len(block)
                share = counts[at:at + size] / max(total, 1)
                at += size
                apart = np.bitwise_count(np.arange(size)[:, None] ^ np.arange(size)[None, :])
                own.append(np.stack([(share[None, :] * (apart == d)).sum(axis=1) for d in range(bits + 1)], axis=1))
            chances.append(own)
        out.append(Plan(groups, chances, total, bits))
    return out


def probes_within(width, radius):
    """Values of ``width`` bits within ``radius`` of one."""
    return sum(len(list(combinations(range(width), r))) for r in range(radius + 1))


def allocate(rows, plan: Plan):
    """Thresholds of every fingerprint (a row) for every partition, and their estimated cost.

    The blocks of a partition are taken as independent: the chances of 0..bits differences
    are convolved over them. A threshold t costs its probes and the candidates it is
    expected to meet; ``bits + 1`` units (t + 1 each) are dealt out at the least total.
    """
    units = plan.bits + 1
    best = np.full((len(rows), units + 1), np.inf)
    best[:, 0] = 0
    picks = []
    for group, tables in zip(plan.groups, plan.chances):
        apart = None
        for block, table in zip(cut_blocks(group), tables):
            own = table[block_values(rows, block)]
            apart = own if apart is None else np.stack(
                [sum(apart[:, i] * own[:, d - i] for i in range(d + 1)) for d in range(units)], axis=1)
        cost = np.zeros((len(rows), units + 1))
        cost[:, 1:] = np.cumsum(apart, axis=1) * plan.total + [probes_within(len(group), t) for t in range(units)]
        options = np.stack([
            np.stack([best[:, j - u] + cost[:, u] if j >= u else np.full(len(rows), np.inf) for u in range(units + 1)], axis=1)
            for j in range(units + 1)], axis=1)
        picks.append(options.argmin(axis=2))
        best = options.min(axis=2)
    left, thresholds = np.full(len(rows), units), []
    for pick in reversed(picks):
        unit = pick[np.arange(len(rows)), left]
        thresholds.append(unit - 1)
        left = left - unit
    return np.stack(thresholds[::-1], axis=1), best[:, units]


def masks(width, radius):
    """All values of ``width`` bits with 1..radius bits set."""
    return np.array([sum(1 << i for i in chosen) for r in range(1, radius + 1) for chosen in combinations(range(width), r)], np.int64)


def keys(fps: DataFrame, plan: Plan) -> DataFrame:
    """``part, value, fp, own, probe``: a row for every value that a fingerprint has (own) or probes."""
    def emit(batches):
        for batch in batches:
            every = batch.column("fp").to_numpy()
            for at in range(0, len(every), 1024):
                fp = every[at:at + 1024]
                rows = bit_rows(fp)
                thresholds, _ = allocate(rows, plan)
                for part, group in enumerate(plan.groups):
                    own, t = block_values(rows, group), thresholds[:, part]
                    columns = [(own, fp, np.ones(len(fp), bool), t >= 0)]
                    for radius in range(1, plan.bits + 1):
                        far = t == radius
                        if far.any():
                            ball = masks(len(group), radius)
                            values = (own[far][:, None] ^ ball[None, :]).ravel()
                            columns.append((values, np.repeat(fp[far], len(ball)), np.zeros(len(values), bool), np.ones(len(values), bool)))
                    value, of, is_own, probe = (np.concatenate(c) for c in zip(*columns))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(value), part, np.int32)), pa.array(value), pa.array(of), pa.array(is_own), pa.array(probe)],
                        names=["part", "value", "fp", "own", "probe"])

    return fps.select("fp").mapInArrow(emit, "part int, value long, fp long, own boolean, probe boolean")


def choose_plan(fps: DataFrame, bits: int, choices=CHOICES) -> Plan:
    """The plan with the least estimated cost over all fingerprints.

    What reaches the driver is a 64 x 64 table of counts, the counts of block values and a sum a choice.
    """
    total = fps.count()
    both = summed(fps, lambda rows: (rows.T.astype(np.float64) @ rows).ravel()).reshape(-1, BITS) if total else np.zeros((BITS, BITS))
    groupings = [correlated_parts(both, total, parts) for parts in choices]
    tables = block_tables(groupings)
    counts = summed(fps, tables) if total else tables(np.zeros((0, BITS), np.uint8))
    found = plans(groupings, counts, total, bits)
    if len(found) == 1 or not total:
        return found[0]
    cost = summed(fps, lambda rows: np.array([np.ceil(allocate(rows, plan)[1].sum()) for plan in found]))
    return found[int(np.argmin(cost))]


def variant_links(fps: DataFrame, bits: int) -> DataFrame:
    """Links ``a, b`` that connect all pairs of ``fps`` within ``bits``, without a pair table.

    Two fingerprints within ``bits`` share a value half way between them. All that reach a
    value are linked with the least that is on the near side of it; any two such are within ``bits``.
    """
    near, far = bits // 2, bits - bits // 2
    flips = np.concatenate([np.zeros(1, np.uint64), np.array(
        [sum(1 << i for i in chosen) for r in range(1, far + 1) for chosen in combinations(range(BITS), r)], np.uint64)]).view(np.int64)
    flip = F.explode(F.array(*[F.lit(int(x)) for x in flips]))
    rows = fps.select("fp", flip.alias("flip")).select(
        "fp", F.col("fp").bitwiseXOR(F.col("flip")).alias("value"), (F.bit_count("flip") <= near).alias("inner"))
    least = rows.groupBy("value").agg(
        F.min(F.when(F.col("inner"), F.col("fp"))).alias("least"), F.min("fp").alias("lo"), F.max("fp").alias("hi")).where(
        "lo <> hi AND least IS NOT NULL").select("value", "least")
    return rows.join(least, "value").where("fp <> least").select(F.col("fp").alias("a"), F.col("least").alias("b"))


def links(fps: DataFrame, bits: int, choices=CHOICES, small: int = SMALL) -> DataFrame:
    """Links ``a, b`` between distinct fingerprints ``fp``: their components are those of all pairs within ``bits``.

    A value that at most ``small`` fingerprints have is probed pair by pair, so a probe meets
    ``small`` candidates at most. Fingerprints that have or probe a value more of them share
    (a large group of near copies) are linked by :func:`variant_links`.
    """
    rows = materialize(keys(fps, choose_plan(fps, bits, choices)), "simhash-keys")
    sizes = rows.groupBy("part", "value").agg(
        F.count_if("own").alias("n"), F.count_if("probe").alias("asked"), F.min("fp").alias("lo"), F.max("fp").alias("hi")).where(
        "n > 0 AND asked > 0 AND lo <> hi").select("part", "value", "n")
    met = materialize(rows.join(sizes, ["part", "value"]), "simhash-met")
    few = met.where(F.col("n") <= small)
    pairs = few.where("probe").select("part", "value", F.col("fp").alias("a")).join(
        few.where("own").select("part", "value", F.col("fp").alias("b")), ["part", "value"])
    verified = pairs.where("a <> b").where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= bits).select(
        F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    many = met.where(F.col("n") > small).select("fp").distinct()
    return verified.unionByName(variant_links(many, bits)).distinct()


def near_duplicates(docs: DataFrame, shingle: int = 3, bits: int = 2, choices=CHOICES, small: int = SMALL) -> DataFrame:
    """Per row of ``docs``: ``doc_id, fingerprint, component_id``.

    Rows whose fingerprints differ in ``bits`` bits or fewer are linked; ``component_id`` is the
    smallest doc_id reachable. Equal fingerprints are one node, so a group of copies is one
    row of the search. A shingle is ``shingle`` words, repeats included; fewer words
    are one shingle; null, empty and wordless texts have fingerprint zero and are linked
    like any other. A long text is read in pieces.

    A row without an id links like any other and has the smallest id of its component, or
    null if that has none. Rows that repeat an id count by their own texts. Two rows of equal
    fingerprint always share a component, so there are no ties. Other columns are ignored; no rows give no rows.
    """
    signed = materialize(fingerprints(docs, shingle), "simhash")
    nodes = materialize(signed.groupBy("fp").agg(F.min("doc_id").alias("first")), "simhash-nodes")
    fps = nodes.select("fp")
    found = materialize(links(fps, bits, choices, small), "simhash-links")
    labels = nodes.join(components(fps, found).withColumnRenamed("id", "fp"), "fp")
    named = labels.groupBy("component").agg(F.min("first").alias("component_id"))
    of = materialize(labels.join(named, "component").select("fp", "component_id"), "simhash-components")
    return signed.join(of, "fp").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
