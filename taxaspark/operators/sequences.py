"""Hamming distances and nearest neighbours of aligned sequences.

Equal sequences are compared once: the work is on distinct sequences, and ids
join in afterwards. All pairs are compared block by block in NumPy; nearest neighbours
meet over shared segments, with a radius that is raised only for queries still open.
"""

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from taxaspark.lineage import materialize

BLOCK_SEQUENCES = 512
LISTED_IDS = 256  # ids of one sequence in a list, about


def _bytes(column):
    """Equal-length strings as a byte matrix."""
    values = column.to_pylist()
    lengths = {len(v) for v in values}
    if len(lengths) > 1:
        raise ValueError(f"aligned sequences differ in length: {sorted(lengths)}")
    return np.frombuffer("".join(values).encode("ascii"), np.uint8).reshape(len(values), -1)


def _differences(x, y):
    """Number of differing positions of all rows of x against all rows of y."""
    out = np.empty((len(x), len(y)), dtype=np.int32)
    step = max(1, 4_000_000 // max(1, y.size))
    for i in range(0, len(x), step):
        out[i:i + step] = (x[i:i + step, None, :] != y[None, :, :]).sum(axis=2)
    return out


def hamming_pairs(alignment: DataFrame) -> DataFrame:
    """``(a, b, d)`` for all taxon pairs ``a < b`` of an alignment ``(taxon_id, aln)``.

    A distinct sequence goes to the tiles once, with lists of up to about ``LISTED_IDS`` of the ids
    that have it. A tile returns the ids of a sequence beside those of all its others at the same distance;
    their pairs are made where they are read, so no pair passes a shuffle.
    """
    rows = alignment.select("taxon_id", F.upper("aln").alias("aln"))
    most = rows.groupBy("aln").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 1
    listed = materialize(rows.withColumn("part", F.pmod(F.xxhash64("taxon_id"), F.lit(math.ceil(most / LISTED_IDS)))).groupBy(
        "aln", "part").agg(F.collect_list("taxon_id").alias("ids")).where("size(ids) > 0").select("aln", "ids"), "alignment")
    lists, ids = listed.agg(F.count(F.lit(1)), F.sum(F.size("ids"))).first()
    cores = alignment.sparkSession.sparkContext.defaultParallelism
    nb = max(1, math.ceil(lists / BLOCK_SEQUENCES), min(math.ceil(math.sqrt(8 * cores)), lists), math.ceil((ids or 0) / BLOCK_SEQUENCES / LISTED_IDS))
    tiles = (
        listed.withColumn("block", F.pmod(F.xxhash64("aln", F.col("ids")[0]), F.lit(nb)).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(nb - 1))))
        .select("aln", "ids", F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi"),
                (F.col("block") > F.col("other")).cast("int").alias("side"))
    )

    def tile(key, table):
        lo, hi = (k.as_py() for k in key)
        side = pa.array(table.column("side").to_numpy() == 1)
        left = table if lo == hi else table.filter(pa.compute.invert(side))
        right = table if lo == hi else table.filter(side)
        at, who, d, same = [], [], [], []
        if len(left) and len(right):
            x, y = _bytes(left.column("aln")), _bytes(right.column("aln"))
            for i in range(len(x)):
                # Each two lists meet once; inside one block the later ones, and a list itself apart.
                start = i + 1 if lo == hi else 0
                if lo == hi:
                    at.append(i), who.append(np.array([i])), d.append(0.0), same.append(True)
                far = _differences(x[i:i + 1], y[start:])[0]
                order = np.argsort(far, kind="stable")
                cuts = np.flatnonzero(np.diff(far[order], prepend=-1))
                for p, q in zip(cuts, [*cuts[1:], len(order)]):
                    at.append(i), who.append(start + order[p:q]), d.append(float(far[order[p]])), same.append(False)
        ids = lambda t: t.column("ids").combine_chunks()
        others = ids(right).take(pa.array(np.concatenate(who) if who else np.zeros(0, np.int64)))
        # The lists of one distance end to end.
        offsets = others.offsets.to_numpy()[np.cumsum([0, *map(len, who)])]
        return pa.table({"a": ids(left).take(pa.array(at, pa.int64())), "b": pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), others.values),
                         "d": pa.array(d, pa.float64()), "same": pa.array(same, pa.bool_())})

    # Small inputs make many pairs, so their size says nothing about the tasks they need.
    met = tiles.repartition(min(nb * (nb + 1), 20_000), "lo", "hi").groupBy("lo", "hi").applyInArrow(tile, "a array<string>, b array<string>, d double, same boolean")
    pairs = met.select(F.explode("a").alias("a"), "b", "d", "same").select("a", F.explode("b").alias("b"), "d", "same").where(
        F.when(F.col("same"), F.col("a") < F.col("b")).otherwise(F.col("a") != F.col("b")))
    return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "d")


def _segments(rows: DataFrame, length: int, parts: int) -> DataFrame:
    """``grp, aln, answer, key``: a row for every of ``parts`` segments of a sequence, keyed by group, segment and content.

    A segment is every ``parts``-th column of a fixed shuffle of the columns, so conserved
    stretches and gaps are shared out evenly.
    """
    columns = np.random.default_rng(length).permutation(length)
    factors = np.random.default_rng(parts).integers(1, 2**62, length, dtype=np.uint64) * np.uint64(2) + np.uint64(1)

    def cut(batches):
        for batch in batches:
            if batch.num_rows:
                weighted = (_bytes(batch.column("aln")).astype(np.uint64) + np.uint64(1)) ** np.uint64(2) * factors
                for part in range(parts):
                    own = weighted[:, columns[part::parts]]
                    value = (own ^ (own >> np.uint64(29))).sum(axis=1, dtype=np.uint64).view(np.int64)
                    yield pa.RecordBatch.from_arrays(
                        [*(batch.column(c) for c in ("grp", "aln", "answer")), pa.array(np.full(len(value), part, np.int32)), pa.array(value)],
                        names=["grp", "aln", "answer", "part", "value"])

    cuts = rows.select("grp", "aln", "answer").mapInArrow(cut, "grp string, aln string, answer string, part int, value long")
    return cuts.select("grp", "aln", "answer", F.concat_ws("|", "part", "value", "grp").alias("key"))


def _meetings(keyed: DataFrame) -> DataFrame:
    """``key, nq, nd``: queries (without an answer) and database sequences of the keys that both have."""
    return keyed.groupBy("key").agg(
        F.count_if(F.col("answer").isNull()).alias("nq"), F.count("answer").alias("nd")).where("nq > 0 and nd > 0")


def _nearest(keyed: DataFrame, meetings: DataFrame, block: int) -> DataFrame:
    """``grp, aln, h, answer``: the nearest database sequence among those that share a key with a query.

    Keys with many sequences are cut into blocks of about ``block``, small ones go many to a task.
    """
    blocks = lambda n: F.ceil(F.col(n) / block).cast("int")
    sizes = meetings.select("key", blocks("nq").alias("nq"), blocks("nd").alias("nd"))
    block_of = lambda n: F.pmod(F.xxhash64("aln"), F.col(n)).cast("int")
    everywhere = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    met = keyed.join(sizes, "key")
    asked = met.where("answer is null").withColumn("qb", block_of("nq")).withColumn("db", everywhere("nd"))
    answers = met.where("answer is not null").withColumn("db", block_of("nd")).withColumn("qb", everywhere("nq"))
    columns = ["key", "qb", "db", "grp", "aln", "answer"]
    rows = asked.select(columns).unionByName(answers.select(columns))
    totals = meetings.agg(F.sum(F.col("nq") + F.col("nd"))).first()[0] or 0
    slots = max(keyed.sparkSession.sparkContext.defaultParallelism, math.ceil(totals / (4 * BLOCK_SEQUENCES)))

    def tile(table):
        table = table.sort_by([("key", "ascending"), ("answer", "ascending")])  # the smaller id first, queries last
        code = table.column("key").combine_chunks().dictionary_encode()
        code = (code.unify_dictionaries().combine_chunks() if isinstance(code, pa.ChunkedArray) else code).indices.to_numpy()
        text, asks = _bytes(table.column("aln")), table.column("answer").is_null().to_numpy(zero_copy_only=False)
        cuts = np.flatnonzero(np.diff(code, prepend=-1))
        who, best, h = [], [], []
        for start, end in zip(cuts, [*cuts[1:], len(code)]):
            first = end - int(asks[start:end].sum())
            if start < first < end:
                d = _differences(text[first:end], text[start:first])
                nearest = d.argmin(axis=1)
                who.append(np.arange(first, end))
                best.append(start + nearest)
                h.append(d[np.arange(len(d)), nearest])
        pick = lambda x: pa.array(np.concatenate(x) if x else np.zeros(0, np.int64))
        return pa.table({"grp": table.column("grp").take(pick(who)), "aln": table.column("aln").take(pick(who)),
                         "h": pick(h).cast(pa.int32()), "answer": table.column("answer").take(pick(best))})

    return rows.withColumn("slot", F.pmod(F.xxhash64("key"), F.lit(slots)).cast("int")).groupBy("slot", "qb", "db").applyInArrow(
        lambda key, table: tile(table), "grp string, aln string, h int, answer string").groupBy("grp", "aln").agg(
        F.min(F.struct("h", "answer")).alias("m")).select("grp", "aln", "m.h", "m.answer")


def nearest_sequences(asked: DataFrame, answers: DataFrame, counted: list = None) -> DataFrame:
    """``grp, aln, h, answer``: the nearest of ``answers (grp, aln, answer)`` for every ``asked (grp, aln)``, both distinct.

    Equal sequences meet first. Then sequences are cut into 4, 16, 64, … segments: two that differ in fewer
    places than there are segments share one, so a query whose best candidate is that near is settled,
    and only the others go on. Before a round its comparisons are counted from the keys' sizes; once they exceed
    half of all that is open (neighbours so far away that no segment tells), the open queries meet their
    whole group, in blocks. ``counted`` receives the comparisons of every step.
    """
    sized = asked.select("aln").unionByName(answers.select("aln")).agg(F.min(F.length("aln")), F.max(F.length("aln"))).first()
    if sized[0] != sized[1]:
        raise ValueError(f"aligned sequences differ in length: {sized[0]} to {sized[1]}")
    groups = answers.groupBy("grp").agg(F.count(F.lit(1)).alias("nd"))
    found = [materialize(asked.join(answers, ["grp", "aln"]).select("grp", "aln", F.lit(0).alias("h"), "answer"), "nearest")]
    rest = asked.join(groups, "grp", "left_semi")
    parts, note = 4, (counted if counted is not None else []).append
    while True:
        rest = materialize(rest.join(found[-1], ["grp", "aln"], "left_anti"), "open")
        sides = rest.select("grp", "aln", F.lit(None).cast("string").alias("answer")).unionByName(answers)
        whole = rest.groupBy("grp").agg(F.count(F.lit(1)).alias("nq")).join(groups, "grp")
        pairs = whole.agg(F.sum(F.col("nq") * F.col("nd"))).first()[0] or 0
        if not pairs:
            break
        if parts <= (sized[0] or 0):
            keyed = materialize(_segments(sides, sized[0], parts), "segments")
            meetings = materialize(_meetings(keyed), "segments")
            met = meetings.agg(F.sum(F.col("nq") * F.col("nd"))).first()[0] or 0
            if 2 * met <= pairs:
                note(met)
                best = _nearest(keyed, meetings, BLOCK_SEQUENCES)
                found.append(materialize(best.where(F.col("h") < parts), "nearest"))
                parts *= 4
                continue
        note(pairs)
        cores = asked.sparkSession.sparkContext.defaultParallelism
        spread = math.ceil(max(rest.count(), answers.count()) / math.ceil(math.sqrt(cores)))
        found.append(_nearest(sides.withColumn("key", F.col("grp")), whole.withColumnRenamed("grp", "key"), min(BLOCK_SEQUENCES, max(1, spread))))
        break
    settled = found[0]
    for part in found[1:]:
        settled = settled.unionByName(part)
    return settled


def aligned_nn(queries: DataFrame, database: DataFrame, by: str = None) -> DataFrame:
    """Nearest database sequence of each query: ``(query, answer, similarity)``.

    Similarity is ``1 − hamming / length``; equal distances resolve to the
    smaller answer id. ``by`` names a column that both sides must share (a
    project); queries whose group has no database sequence get no answer.
    Inputs are ``(taxon_id, aln[, by])``. See :func:`nearest_sequences` for the search.
    """
    group = F.lit("") if by is None else F.col(by).cast("string")
    q = queries.select("taxon_id", F.upper("aln").alias("aln"), group.alias("grp"))
    base = database.select("taxon_id", F.upper("aln").alias("aln"), group.alias("grp"))
    # One answer per distinct sequence: the smallest id that has it.
    answers = materialize(base.groupBy("grp", "aln").agg(F.min("taxon_id").alias("answer")), "answers")
    q = materialize(q, "queries")
    best = nearest_sequences(materialize(q.select("grp", "aln").distinct(), "asked"), answers)
    similarity = 1 - F.col("h") / F.length("aln")
    return q.join(best, ["grp", "aln"]).select(
        F.col("taxon_id").alias("query"), "answer", similarity.alias("similarity"), *([] if by is None else [F.col("grp").alias(by)]))


def best_of_lookups(lookups) -> DataFrame:
    """Best answer per query over several lookup tables; earlier tables win ties.

    Inside one table the smaller answer wins a tie.
    """
    parts = [df.select("query", "answer", "similarity", F.lit(i).alias("src")) for i, df in enumerate(lookups)]
    rows = parts[0]
    for part in parts[1:]:
        rows = rows.unionByName(part)
    return rows.groupBy("query").agg(
        F.min(F.struct((-F.col("similarity")).alias("neg"), "src", "answer")).alias("m")
    ).select("query", F.col("m.answer").alias("answer"), (-F.col("m.neg")).alias("similarity"))
