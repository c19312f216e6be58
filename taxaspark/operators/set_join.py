"""The k most similar sets by Jaccard, exactly, without a table of all pairs that share something."""

from pyspark.sql import DataFrame, Window as W, functions as F

from taxaspark.functions import columns as C
from taxaspark.lineage import materialize
from taxaspark.operators.tiles import tiled_pairs

THRESHOLDS = (0.8, 0.5, 0.25)


def _by_rarity(sets: DataFrame, counts: DataFrame) -> DataFrame:
    """``id, key, n, place``: set size, and place of the key in its set, the rarest of the base first (from 1)."""
    order = W.partitionBy("id").orderBy(F.col("times").asc_nulls_first(), "key")
    sized = sets.groupBy("id").agg(F.count(F.lit(1)).alias("n"))
    return sets.join(counts, "key", "left").withColumn("place", F.row_number().over(order)).join(sized, "id").select("id", "key", "n", "place")


def _prefix(ranked: DataFrame, threshold: float) -> DataFrame:
    """The rarest keys of each set, of which a set at ``threshold`` or more must share one."""
    return ranked.where(F.col("place") <= F.col("n") - F.ceil(F.col("n") * F.lit(threshold) - 1e-9) + 1)


def top_similar_sets(queries: DataFrame, base: DataFrame, k: int, thresholds=THRESHOLDS, counted: list = None) -> DataFrame:
    """``id, other, jaccard, rank``: the ``k`` sets of ``base (id, key)`` most similar to each of ``queries (id, key)``.

    Rows of either side are distinct. Ties go to the smaller id; sets that share nothing have a similarity of 0, so a
    query has ``k`` rows whenever the base has ``k`` sets. A query row with a null key stands for an empty set.

    For falling thresholds, queries still open meet base sets over shared keys among their rarest (a pair at the
    threshold shares one) with sizes that allow it. All keys shared up to the end of the prefix that ends first were met,
    so a pair that met too few times for its sizes is out before its sets are compared. A query with ``k`` pairs at the
    threshold is settled.
    Before a round its meetings are counted from the keys' counts; once they exceed a sixth of those over all keys,
    the open queries go to tiles, each of which keeps ``k`` per query. ``counted`` receives the meetings of every step.
    """
    note = (counted if counted is not None else []).append
    everyone = materialize(queries.select("id").distinct(), "asked")
    queries = materialize(queries.where("key is not null"), "sets")
    base = materialize(base, "sets")
    counts = base.groupBy("key").agg(F.count(F.lit(1)).alias("times"))
    asked, known = (materialize(_by_rarity(s, counts), "ranked") for s in (queries, base))
    lists = lambda sets: sets.groupBy("id").agg(F.collect_list("key").alias("keys"))
    of_base, found, rest = None, [], asked
    meetings = lambda left, right: left.groupBy("key").agg(F.count(F.lit(1)).alias("nq")).join(
        right.groupBy("key").agg(F.count(F.lit(1)).alias("nb")), "key").agg(F.sum(F.col("nq") * F.col("nb"))).first()[0] or 0
    order = W.partitionBy("id").orderBy(F.desc("jaccard"), "other")
    ranked = lambda pairs: pairs.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    for threshold in thresholds:
        mine, theirs = _prefix(rest, threshold), _prefix(known, threshold)
        whole, met = meetings(rest, known), meetings(mine, theirs)
        if 6 * met > whole or not whole:
            break
        note(met)
        fits = F.least("n", "m") >= F.greatest("n", "m") * F.lit(threshold - 1e-9)
        needed = F.ceil((F.col("n") + F.col("m")) * F.lit(threshold / (1 + threshold)) - 1e-9)
        behind = F.ceil(F.greatest("n", "m") * F.lit(threshold) - 1e-9) - 1
        pairs = materialize(mine.join(theirs.select(F.col("id").alias("other"), "key", F.col("n").alias("m")), "key").where(fits).groupBy(
            "id", "other", "n", "m").agg(F.count(F.lit(1)).alias("met")).where(F.col("met") >= needed - behind).drop("met"), "candidates")
        of_base = of_base if of_base is not None else materialize(lists(known), "lists")
        shared = F.size(F.array_intersect("keys", "others"))
        scored = pairs.join(lists(rest), "id").join(of_base.select(F.col("id").alias("other"), F.col("keys").alias("others")), "other").select(
            "id", "other", C.jaccard_from_sizes(shared, "n", "m").alias("jaccard")).where(F.col("jaccard") >= threshold)
        best = materialize(ranked(scored), "nearest")
        full = best.groupBy("id").agg(F.max("rank").alias("rows")).where(F.col("rows") == k).select("id")
        found.append(best.join(full, "id", "left_semi"))
        rest = materialize(rest.join(full, "id", "left_anti"), "open")
    note(meetings(rest, known))
    tile = lambda sets: sets.select("id", "key", F.lit(1.0).alias("x"), F.col("n").alias("w"))
    tiles = tiled_pairs(tile(rest), tile(known), term="shared", top=k)
    sharing = materialize(ranked(tiles.select(F.col("a").alias("id"), F.col("b").alias("other"), C.jaccard_from_sizes("s", "wa", "wb").alias("jaccard"))), "nearest")
    found.append(sharing)
    # Queries that share something with fewer than k: the smallest other ids follow, all among the first 2k.
    have = sharing.groupBy("id").agg(F.max("rank").alias("have"))
    lacking = everyone.join(found[0].select("id").distinct(), "id", "left_anti") if len(found) > 1 else everyone
    for part in found[1:-1]:
        lacking = lacking.join(part.select("id").distinct(), "id", "left_anti")
    lacking = lacking.join(have, "id", "left").select("id", F.coalesce("have", F.lit(0)).alias("have")).where(F.col("have") < k)
    first = known.select("id").distinct().orderBy("id").limit(2 * k).agg(F.array_sort(F.collect_list("id")).alias("first"))
    spare = lacking.withColumn("other", F.explode(first.scalar())).join(sharing.select("id", "other"), ["id", "other"], "left_anti")
    found.append(spare.withColumn("rank", F.col("have") + F.row_number().over(W.partitionBy("id").orderBy("other"))).where(
        F.col("rank") <= k).select("id", "other", F.lit(0.0).alias("jaccard"), F.col("rank").cast("int").alias("rank")))
    out = found[0]
    for part in found[1:]:
        out = out.unionByName(part)
    return out
