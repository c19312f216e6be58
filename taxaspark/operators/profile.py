"""Abundance profiles: counts to shares, restriction, depth, prevalence, richness.

Group totals are aggregated (combined map-side) and joined back rather than
taken with a window, so a sample with a third of all rows is not one task: AQE
splits its side of the join.
"""

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from taxaspark.functions import columns as C
from taxaspark.operators.ordering import ordered_positions


def normalise(df: DataFrame, value: str, out: str, keys=("sample_id",)) -> DataFrame:
    """Divide ``value`` by its group total."""
    keys = list(keys)
    totals = df.groupBy(*keys).agg(F.sum(value).alias("_total"))
    share = F.try_divide(F.col(value).cast("double"), F.col("_total").cast("double"))
    return df.join(totals, keys).withColumn(out, share).drop("_total")


def relative_abundance(counts: DataFrame, taxa: DataFrame = None, value: str = "n") -> DataFrame:
    """Share of each taxon of a sample; with ``taxa`` only of those, renormalised."""
    if taxa is not None:
        counts = counts.join(taxa.select("taxon_id").distinct(), "taxon_id", "left_semi")
    counts = counts.where(F.col(value) > 0)
    return normalise(counts, value, "rel_abund").select("sample_id", "taxon_id", "rel_abund")


def padded_profile(profile: DataFrame, order: DataFrame, width: int = 4096) -> DataFrame:
    """Abundance vector of each sample over a taxon order ``(taxon_id, ord)``, ord from 0.

    Zero for absent taxa, renormalised over the order. ``(sample_id, chunk, vec)``:
    chunk ``c`` holds positions ``c * width`` onwards, so no task has to hold a
    vector longer than ``width``; orders up to ``width`` give one row per sample.
    """
    size = order.agg(F.count(F.lit(1))).first()[0]
    inside = normalise(profile.join(order, "taxon_id"), "rel_abund", "rel_abund")
    chunk = F.floor(F.col("ord") / width).cast("int")
    filled = inside.groupBy("sample_id", chunk.alias("chunk")).agg(
        F.collect_list((F.col("ord") % width).cast("int")).alias("at"),
        F.collect_list("rel_abund").alias("x"),
    )
    every = inside.select("sample_id").distinct().withColumn(
        "chunk", F.explode(F.sequence(F.lit(0), F.lit((size - 1) // width)))
    )

    @F.pandas_udf("array<double>")
    def scatter(at: pd.Series, x: pd.Series, length: pd.Series) -> pd.Series:
        def one(positions, values, n):
            vec = np.zeros(n)
            if positions is not None:
                vec[positions] = values
            return vec
        return pd.Series([one(*row) for row in zip(at, x, length)])

    length = F.least(F.lit(width), F.lit(size) - F.col("chunk") * width)
    return every.join(filled, ["sample_id", "chunk"], "left").select(
        "sample_id", "chunk", scatter("at", "x", length).alias("vec")
    )


def read_depth(counts: DataFrame) -> DataFrame:
    return counts.groupBy("sample_id").agg(F.sum("n").alias("read_counts"))


def prevalence(counts: DataFrame, read_count_lb: int) -> DataFrame:
    """Number of samples, over all projects, in which a taxon reaches the count."""
    return counts.groupBy("taxon_id").agg(
        F.sum((F.col("n") >= read_count_lb).cast("long")).alias("n_samples")
    )


def richness(counts: DataFrame, value: str = "n") -> DataFrame:
    """Number of taxa present per sample."""
    return counts.groupBy("sample_id").agg(
        F.sum((F.col(value) > 0).cast("long")).alias("n_taxa")
    )


def max_richness(counts: DataFrame) -> DataFrame:
    return richness(counts).agg(F.max("n_taxa").alias("max_taxa"))


def strip_suffix(profile: DataFrame) -> DataFrame:
    """Keep the raw taxon id next to the one without the group suffix."""
    return profile.withColumn("taxon_id_raw", F.col("taxon_id")).withColumn(
        "taxon_id", C.strip_group_suffix("taxon_id")
    )


def first_records(records: DataFrame, id_col: str, order) -> DataFrame:
    """First record of each id in the given order; later duplicates are dropped.

    ``min_by`` keeps one candidate per map task, so many copies of one id are cheap.
    """
    rest = [c for c in records.columns if c != id_col]
    first = F.min_by(F.struct(*rest), F.struct(*order))
    return records.groupBy(id_col).agg(first.alias("_first")).select(id_col, "_first.*")


def distinct_taxa(counts: DataFrame, samples: DataFrame = None, taxa: DataFrame = None,
                  by=("project",)) -> DataFrame:
    """Taxa present per project after restricting samples and taxa."""
    if samples is not None:
        counts = counts.join(samples.select("sample_id"), "sample_id", "left_semi")
    if taxa is not None:
        counts = counts.join(taxa.select("taxon_id"), "taxon_id", "left_semi")
    return counts.where("n > 0").select(*by, "taxon_id").distinct()


def marker_index(records: DataFrame) -> DataFrame:
    """``(taxon_id, marker_id, ord)`` from record names ``SGB<n>__<gene>``, in the order of ``offset`` within a taxon.

    Records ``(record, offset)`` of other names are left out, names that repeat
    stay. A name whose part before the double underscore does not end with a digit raises.
    """
    taxon = F.substring_index("record", "__", 1)
    checked = F.when(taxon.rlike("[0-9]$"), taxon).otherwise(
        F.raise_error(F.concat(F.lit("no taxon in record "), F.col("record"))).cast("string"))
    named = records.where(F.col("record").startswith("SGB")).select(
        checked.alias("taxon_id"), F.col("record").alias("marker_id"), "offset")
    return ordered_positions(named, "offset", "marker_id", ["taxon_id"]).select(
        "taxon_id", "marker_id", F.col("position").cast("int").alias("ord"))


def compound_marker_index(indexes) -> DataFrame:
    """Concatenate marker tables ``(taxon_id, marker_id, ord)`` in source order."""
    parts = [df.withColumn("source_ord", F.lit(i)) for i, df in enumerate(indexes)]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def attach_vectors(profile: DataFrame, vectors: DataFrame, keep_unembedded: bool = False) -> DataFrame:
    """Profile with the vectors of its taxa, one row per taxon and marker.

    A taxon without a vector stays with ``marker_mask`` false. Its ``taxon_mask``
    and target depend on the form: masked out with target zero and the rest
    renormalised, or (``keep_unembedded``) kept with its abundance.
    """
    # A vector is looked at once, not once for every sample that has its taxon.
    vectors = vectors.select("taxon_id", "marker_id", "vec", (
        F.col("vec").isNotNull() & ~F.coalesce(C.has_nan("vec"), F.lit(False))).alias("_whole"))
    with_vector = vectors.select("taxon_id").distinct().withColumn("_known", F.lit(True))
    known = profile.join(with_vector, "taxon_id", "left").withColumn(
        "taxon_mask", F.lit(keep_unembedded) | F.coalesce("_known", F.lit(False))
    )
    known = known.withColumn(
        "target", F.when(F.col("taxon_mask"), F.col("rel_abund")).otherwise(F.lit(0.0))
    ).drop("_known")
    targets = normalise(known, "target", "target")
    return targets.join(vectors, "taxon_id", "left").withColumn(
        "marker_mask", F.coalesce("_whole", F.lit(False))).drop("_whole")
