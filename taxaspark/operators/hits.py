"""Verdicts on sequences from their hits in a reference database."""

from pyspark.sql import DataFrame, functions as F

from taxaspark import fixed_values as fixed
from taxaspark.functions import columns as C


def low_alignment(report: DataFrame, threshold: float) -> DataFrame:
    """Ids aligned over less than the given fraction of their length."""
    fraction = C.fraction_aligned("QueryStart", "QueryEnd", "QueryLength")
    return report.withColumn("fraction", fraction).where(F.col("fraction") < threshold).select(
        "QueryName", "fraction"
    )


def bacterial_verdict(hits: DataFrame, ids: DataFrame, min_identity: float,
                      id_col: str = "query_id") -> DataFrame:
    """``(id, domain, reason, keep)`` for every id; kept when any hit is bacterial.

    Hits shrink to distinct ``(id, domain)`` before the per-id sets are built.
    """
    domains = (
        hits.where(F.col("identity") / 100.0 >= min_identity)
        .select(F.col(id_col).alias("id"), C.taxonomy_domain("target").alias("domain"))
        .distinct()
        .groupBy("id")
        .agg(F.sort_array(F.collect_set("domain")).alias("domains"))
    )
    has = lambda name: F.array_contains("domains", name)
    others = F.array_join(F.array_remove("domains", "Bacteria"), ", ")
    say = fixed.VERDICT_REASONS
    finding = lambda domain, reason: F.struct(
        F.lit(domain).alias("domain"), (F.lit(reason) if isinstance(reason, str) else reason).alias("reason"))
    verdict = (
        F.when(F.col("domains").isNull(), finding("No hits", say["no_hits"].format(percent=min_identity * 100)))
        .when(has("Bacteria") & (F.size("domains") > 1), finding("Bacteria", F.concat(F.lit(say["mixed"]), others)))
        .when(has("Bacteria"), finding("Bacteria", say["bacterial"]))
        .when(has("Archaea"), finding("Archaea", say["archaeal"]))
        .when(has("Eukaryota"), finding("Eukaryota", say["eukaryotic"]))
        .when(has("Unknown"), finding("Unknown", say["undetermined"]))
        .otherwise(finding("Unknown", say["unrecognised"]))
    )
    return (
        ids.select(F.col(ids.columns[0]).alias("id")).distinct()
        .join(domains, "id", "left")
        .select("id", verdict.alias("v"))
        .select("id", "v.domain", "v.reason", (F.col("v.domain") == "Bacteria").alias("keep"))
    )


def verdict_summary(verdicts: DataFrame) -> DataFrame:
    """Ids per domain and their share."""
    per_domain = verdicts.groupBy("domain").agg(F.count(F.lit(1)).alias("n"))
    total = per_domain.agg(F.sum("n").alias("total"))
    return per_domain.withColumn("total", total.scalar()).withColumn(
        "share", F.col("n") / F.col("total")
    )


def top_hits_verdict(hits: DataFrame, ids: DataFrame, min_identity: float, top: int = 5) -> DataFrame:
    """``(id, keep, reason)``: kept when all of the first ``top`` hits above identity are 16S.

    ``hits (query_id, hit_rank, identity, description)``; ``hit_rank`` counts from 1.
    """
    first = hits.where(F.col("hit_rank") <= top)
    good = F.col("identity") >= min_identity
    bad = good & ~C.is_16s("description")
    shown = F.when(
        F.length("description") > fixed.DESCRIPTION_SHOWN,
        F.concat(F.substring("description", 1, fixed.DESCRIPTION_SHOWN), F.lit("..."))
    ).otherwise(F.col("description"))
    per_id = first.groupBy(F.col("query_id").alias("id")).agg(
        F.count_if(good).alias("n_good"),
        F.min(F.when(bad, F.struct("hit_rank", shown.alias("text")))).alias("first_bad"),
    )
    return (
        ids.select(F.col(ids.columns[0]).alias("id")).distinct().join(per_id, "id", "left")
        .select(
            "id",
            ((F.coalesce("n_good", F.lit(0)) > 0) & F.col("first_bad").isNull()).alias("keep"),
            F.when(F.col("n_good").isNull(), F.lit(fixed.VERDICT_REASONS["no_top_hits"]))
            .when(F.col("n_good") == 0, F.lit(fixed.VERDICT_REASONS["no_good_hits"].format(threshold=min_identity)))
            .when(F.col("first_bad").isNotNull(), F.concat(
                F.lit("Hit "), F.col("first_bad.hit_rank").cast("string"),
                F.lit(" is not 16S: "), F.col("first_bad.text")))
            .alias("reason"),
        )
    )
