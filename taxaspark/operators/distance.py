"""All-pairs distances between samples, and products with a taxon-distance table."""

import math

from pyspark.sql import DataFrame, functions as F

from taxaspark.functions import columns as C
from taxaspark.lineage import materialize
from taxaspark.operators.profile import normalise
from taxaspark.operators.tiles import tiled_pairs


def _with_size(profile, x, w):
    per_sample = profile.groupBy("sample_id").agg(w.alias("w"))
    return profile.join(per_sample, "sample_id").select(
        F.col("sample_id").alias("id"), F.col("taxon_id").alias("key"), x.alias("x"), "w"
    )


def co_occurrence(profile: DataFrame) -> DataFrame:
    """Shared taxa of every sample pair that shares any: ``(a, b, n_shared, n_a, n_b)``."""
    rows = _with_size(profile, F.lit(1.0), F.count(F.lit(1)))
    return tiled_pairs(rows, term="shared").select(
        "a", "b", *[F.col(c).cast("long").alias(n)
                    for c, n in (("s", "n_shared"), ("wa", "n_a"), ("wb", "n_b"))]
    )


def sample_distances(profile: DataFrame, method: str, taxon_distances: DataFrame = None,
                     fill_disjoint: bool = True, **tiling) -> DataFrame:
    """Distances ``(a, b, d)`` of all sample pairs ``a < b``.

    Methods: ``jaccard`` (1 − similarity), ``jensen_shannon`` (natural log, not
    rooted), ``root_jensen_shannon``, ``bray_curtis``, ``precomputed`` (mean of
    ``taxon_distances`` over the taxa of both). Only shared taxa are visited;
    pairs without one follow from the closed form of the measure and are left
    out with ``fill_disjoint=False``.
    """
    profile = profile.where("rel_abund > 0")
    if method == "precomputed":
        if taxon_distances is None:
            raise ValueError("method 'precomputed' needs taxon_distances")
        return mean_linkage(profile, taxon_distances, **tiling)
    share = normalise(profile, "rel_abund", "rel_abund")
    plain = share.select(
        F.col("sample_id").alias("id"), F.col("taxon_id").alias("key"),
        F.col("rel_abund").alias("x"), F.lit(0.0).alias("w"),
    )
    if method == "jaccard":
        pairs = tiled_pairs(_with_size(profile, F.lit(1.0), F.count(F.lit(1))),
                            term="shared", all_pairs=fill_disjoint, **tiling)
        d = 1 - C.jaccard_from_sizes("s", "wa", "wb")
    elif method in ("jensen_shannon", "root_jensen_shannon"):
        pairs = tiled_pairs(plain, term="js_shared", all_pairs=fill_disjoint, **tiling)
        # Normalised p, q: JS = ln 2 + 1/2 sum over shared of p ln(p/(p+q)) + q ln(q/(p+q)).
        d = F.greatest(F.lit(math.log(2.0)) + 0.5 * F.col("s"), F.lit(0.0))
        d = F.sqrt(d) if method.startswith("root") else d
    elif method == "bray_curtis":
        pairs = tiled_pairs(plain, term="min", all_pairs=fill_disjoint, **tiling)
        d = 1 - F.col("s")
    else:
        raise ValueError(f"unsupported distance method {method!r}")
    return pairs.select("a", "b", d.alias("d"))


def both_ways(distances: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """A distance table with each pair in both orders."""
    flipped = distances.select(F.col(b).alias(a), F.col(a).alias(b), "d")
    return distances.select(a, b, "d").unionByName(flipped)


def _taxon_rows(distances):
    return both_ways(distances).select(
        F.col("a").alias("id"), F.col("b").alias("key"), F.col("d").alias("x"), F.lit(0.0).alias("w")
    )


def mean_linkage(profile: DataFrame, taxon_distances: DataFrame, known: DataFrame = None, **tiling) -> DataFrame:
    """Mean taxon distance over taxa(a) × taxa(b) for all sample pairs ``a < b``.

    Two sparse products instead of one row per taxon pair and sample pair:
    first the summed distance of every taxon to a sample's taxa, then its sum
    over the other sample's taxa. The distance table holds ``a < b``; a taxon is
    at distance zero from itself. A missing distance between two taxa of the
    profile raises: it would count as zero. So do two distances of one pair that
    differ. ``known (taxon_id)`` leaves out all other taxa of the profile; a
    sample left without any raises, for its mean is taken over nothing.
    """
    if known is not None:
        whole, profile = profile, profile.join(known.select("taxon_id"), "taxon_id", "left_semi")
        bare = whole.select("sample_id").join(profile.select("sample_id"), "sample_id", "left_anti").agg(
            F.count_distinct("sample_id").alias("n"), F.min("sample_id").alias("first")).first()
        if bare.n:
            raise ValueError(f"{bare.n} samples have no known taxon, the first is {bare.first}")
    taxa = materialize(profile.select("taxon_id").distinct(), "taxa")
    listed = materialize(
        taxon_distances.where("a < b AND d IS NOT NULL")
        .join(taxa.select(F.col("taxon_id").alias("a")), "a", "left_semi")
        .join(taxa.select(F.col("taxon_id").alias("b")), "b", "left_semi")
        .groupBy("a", "b").agg(F.min("d").alias("d"), F.max("d").alias("_other")), "taxon-distances")
    twice = listed.where("d <> _other").count()
    if twice:
        raise ValueError(f"{twice} pairs of taxa have two distances that differ")
    listed = listed.drop("_other")
    n = taxa.count()
    missing = n * (n - 1) // 2 - listed.count()
    if missing:
        raise ValueError(f"{missing} pairs of the profile's {n} taxa have no distance")
    own = taxa.select(F.col("taxon_id").alias("id"), F.col("taxon_id").alias("key"), F.lit(0.0).alias("x"), F.lit(0.0).alias("w"))
    members = materialize(_with_size(profile, F.lit(1.0), F.count(F.lit(1))), "members")
    to_taxon = tiled_pairs(members, _taxon_rows(listed).unionByName(own), term="dot", **tiling)
    summed = to_taxon.select(F.col("a").alias("id"), F.col("b").alias("key"),
                             F.col("s").alias("x"), F.col("wa").alias("w"))
    pairs = tiled_pairs(summed, members, term="dot", ordered=True, **tiling)
    return pairs.select("a", "b", (F.col("s") / (F.col("wa") * F.col("wb"))).alias("d"))


def phylogenetic_similarity(profile: DataFrame, taxon_distances: DataFrame, known: DataFrame,
                            **tiling) -> DataFrame:
    """``exp(−d)`` with d the symmetrised mean nearest-taxon distance of two samples.

    Only taxa in ``known (taxon_id)`` count. ``taxon_distances`` holds ``a < b``.
    """
    inside = profile.join(known.select("taxon_id"), "taxon_id", "left_semi")
    members = materialize(_with_size(inside, F.lit(1.0), F.count(F.lit(1))), "members")
    itself = known.select(F.col("taxon_id").alias("id"), F.col("taxon_id").alias("key"),
                          F.lit(0.0).alias("x"), F.lit(0.0).alias("w"))
    table = _taxon_rows(taxon_distances).unionByName(itself)
    nearest = tiled_pairs(members, table, term="right", combine="min", **tiling)
    nearest = materialize(nearest.select(F.col("a").alias("id"), F.col("b").alias("key"), F.col("s").alias("x")), "nearest-taxa")
    # Over b's taxa the mean distance to their nearest in a, and over a's taxa that to b, as one sum over
    # keys that stand for a taxon and a direction.
    share = members.select("id", "key", (1 / F.col("w")).alias("x"), "w")
    def side(there, back):
        directed = lambda df, name: df.select("id", F.concat(F.lit(name), "key").alias("key"), "x", F.lit(0.0).alias("w"))
        return directed(nearest, there).unionByName(directed(share, back))
    paired = tiled_pairs(side(">", "<"), side("<", ">"), term="dot", ordered=True, **tiling).select(
        "a", "b", (F.col("s") / 2).alias("d"))
    return paired.select("a", "b", C.distance_kernel("d").alias("similarity"))


def submatrix(distances: DataFrame, rows: DataFrame, cols: DataFrame = None) -> DataFrame:
    """Distances between two id lists, in both orders when they differ; ids in one column."""
    r = rows.select(F.col(rows.columns[0]).alias("a"))
    c = (rows if cols is None else cols)
    c = c.select(F.col(c.columns[0]).alias("b"))
    both = distances if cols is None else both_ways(distances)
    return both.join(r, "a", "left_semi").join(c, "b", "left_semi").select("a", "b", "d")


def similarities(distances: DataFrame) -> DataFrame:
    """``1 − d / d_max`` over the whole table."""
    d_max = distances.agg(F.max("d")).scalar()
    return distances.withColumn("_max", d_max).select(
        "a", "b", C.similarity_from_distance("d", "_max").alias("similarity")
    )
