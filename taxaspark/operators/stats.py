"""Comparison of methods over samples, seeds and splits.

``results`` are long: ``Method, SampleId, Seed, DataSplitSeed, <metric>``. A
seed column that is null throughout a method does not split its runs.
"""

import math

import pandas as pd
from pyspark.sql import DataFrame, Window as W, functions as F

from taxaspark.functions import columns as C
from taxaspark.operators.ordering import exact_quantiles, join_on, medians, ordered_histogram, tie_averaged_rank


def aggregate(results: DataFrame, keys, metric: str, how: str, out: str) -> DataFrame:
    """Mean or median of a metric per group."""
    if how == "mean":
        return results.groupBy(*keys).agg(F.avg(metric).alias(out))
    if how == "median":
        return medians(results, keys, metric, out)
    raise ValueError(f"unknown aggregation {how!r}")


def per_sample(results: DataFrame, metric: str, how: str = "mean") -> DataFrame:
    """One value per method and sample, over its seeds."""
    return aggregate(results, ["Method", "SampleId"], metric, how, metric)


def per_seed(results: DataFrame, metric: str, how: str = "median") -> DataFrame:
    """One value per method and seed, over its samples; rows without a seed are left out."""
    return aggregate(results.where("Seed is not null"), ["Method", "Seed"], metric, how, metric)


def _active_keys(results, seed_cols):
    """Runs of a method are its combinations of the seed columns it uses.

    A row that lacks a seed its method uses belongs to no run.
    """
    # -1 marks "method does not use this column", so that it groups as one run.
    used = results.groupBy("Method").agg(*[F.count(c).alias(f"_used_{c}") for c in seed_cols])
    marked = results.join(used, "Method")
    for c in seed_cols:
        marked = marked.withColumn(f"_run_{c}", F.when(F.col(f"_used_{c}") == 0, F.lit(-1).cast("long"))
                                   .otherwise(F.col(c).cast("long")))
    return marked.dropna(subset=[f"_run_{c}" for c in seed_cols])


def run_medians(results: DataFrame, metric: str, seed_cols) -> DataFrame:
    """Median over the samples of each run: ``(Method, _run_…, run_median)``."""
    runs = [f"_run_{c}" for c in seed_cols]
    return medians(_active_keys(results, seed_cols), ["Method", *runs], metric, "run_median")


def mean_std_of_medians(results: DataFrame, metric: str, seed_cols=("Seed",)) -> DataFrame:
    """Mean and sample deviation (null for one run) of the per-run medians, and run count."""
    return run_medians(results, metric, seed_cols).groupBy("Method").agg(
        F.avg("run_median").alias("mean"), F.stddev_samp("run_median").alias("std"),
        F.count(F.lit(1)).alias("n_runs"))


def variance_decomposition(results: DataFrame, metric: str, split_col: str = "DataSplitSeed",
                           seed_col: str = "Seed") -> DataFrame:
    """``(Method, mean, std_seed, std_split, n_runs)``.

    With several splits and seeds the seed deviation is the mean of those within
    a split and the split deviation that of the split means; with several of one
    kind only its deviation is given.
    """
    split, seed = f"_run_{split_col}", f"_run_{seed_col}"
    runs = run_medians(results, metric, (split_col, seed_col))
    by_split = runs.groupBy("Method", split).agg(
        F.avg("run_median").alias("split_mean"), F.stddev_samp("run_median").alias("split_std"))
    splits = by_split.groupBy("Method").agg(
        F.avg("split_std").alias("_within"), F.stddev_samp("split_mean").alias("_between"))
    many = runs.groupBy("Method").agg(
        F.avg("run_median").alias("mean"), F.stddev_samp("run_median").alias("_all"),
        F.count(F.lit(1)).alias("n_runs"),
        F.count_distinct(split).alias("_splits"), F.count_distinct(seed).alias("_seeds"))
    has_split, has_seed = F.col("_splits") > 1, F.col("_seeds") > 1
    return many.join(splits, "Method").select(
        "Method", "mean",
        F.when(has_seed & has_split, F.col("_within")).when(has_seed, F.col("_all")).alias("std_seed"),
        F.when(has_split & has_seed, F.col("_between")).when(has_split, F.col("_all")).alias("std_split"),
        "n_runs")


def merge_statistics(left: DataFrame, right: DataFrame, suffixes) -> DataFrame:
    """Full outer merge of two statistics tables on the method."""
    tag = lambda df, s: df.select("Method", *[F.col(c).alias(c + s) for c in df.columns if c != "Method"])
    return tag(left, suffixes[0]).join(tag(right, suffixes[1]), "Method", "full_outer")


def flag_best(stats: DataFrame, column: str = "mean", out: str = "is_best") -> DataFrame:
    """Mark the methods with the smallest value."""
    best = stats.agg(F.min(column)).scalar()
    return stats.withColumn("_best", best).withColumn(out, F.col(column) == F.col("_best")).drop("_best")


def seed_counts(results: DataFrame, by, seed_cols=("DataSplitSeed", "Seed")) -> DataFrame:
    """Distinct values per seed column and distinct runs per group."""
    filled = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in seed_cols]
    return results.groupBy(*by).agg(
        *[F.count_distinct(c).alias(f"n_{c}") for c in seed_cols],
        F.count_distinct(F.struct(*filled)).alias("n_runs"))


def seed_table(results: DataFrame, metric: str, seeds=None, how: str = "mean") -> DataFrame:
    """One row per method, one column per seed, mean and population deviation over seeds.

    Without ``seeds`` every seed of the results has its column, in ascending order.
    """
    cells = per_seed(results, metric, how)
    if seeds is None:
        seeds = sorted(r[0] for r in results.select("Seed").distinct().dropna().collect())
    wide = cells.groupBy("Method").pivot("Seed", list(seeds)).agg(F.first(metric))
    named = wide.select("Method", *[F.col(str(s)).alias(f"seed_{s}") for s in seeds])
    over = cells.groupBy("Method").agg(F.avg(metric).alias("mean"), F.stddev_pop(metric).alias("std"))
    return named.join(over, "Method")


def scaling_table(results: DataFrame, how: str = "mean") -> DataFrame:
    """Loss and parameter count per (method, embedding, model type, seed), with log10 columns."""
    tagged = results.withColumn("Embedding", C.method_embedding("Method")).withColumn(
        "ModelType", C.method_model_type("Method"))
    keys = ["Method", "Embedding", "ModelType", "Seed"]
    tagged = tagged.dropna(subset=keys)
    loss = aggregate(tagged, keys, "KL_err", how, "KL_err")
    parameters = aggregate(tagged, keys, "NumParameters", how, "NumParameters")
    return loss.join(parameters, keys).withColumn("KL_err_log", F.log10("KL_err")).withColumn(
        "NumParameters_log", F.log10("NumParameters"))


def contrast(results: DataFrame, by, flag: str, metric: str, names) -> DataFrame:
    """Mean of a metric per group with the flag true and false, and their difference."""
    on = F.avg(F.when(F.col(flag), F.col(metric)))
    off = F.avg(F.when(~F.col(flag), F.col(metric)))
    return results.where(F.col(flag).isNotNull()).groupBy(*by).agg(
        on.alias(names[0]), off.alias(names[1]), (on - off).alias("difference"))


def pooling_contrast(results: DataFrame, metric: str = "KL_err") -> DataFrame:
    """Pooled against not pooled models per (split, sample, embedding)."""
    tagged = results.withColumn("Embedding", C.method_embedding("Method")).withColumn(
        "Pooled", C.method_pooled("Method"))
    return contrast(tagged, ["DataSplitSeed", "SampleId", "Embedding"], "Pooled", metric, ("pooled", "not_pooled"))


def ablation_contrast(results: DataFrame, metric: str = "KL_err") -> DataFrame:
    """Ablated against full models per (split, sample, method)."""
    return contrast(results, ["DataSplitSeed", "SampleId", "Method"], "Ablated", metric, ("ablated", "full"))


# --- paired tests ---------------------------------------------------------------

def method_pairs(results: DataFrame, key_cols, metric: str, aggregator: str = "mean", by=()) -> DataFrame:
    """Values of every two methods ``method_a < method_b`` on the same key.

    The number of methods is that of a report, so a key has few rows.
    """
    by, key_cols = list(by), list(key_cols)
    values = aggregate(results, [*by, "Method", *key_cols], metric, aggregator, "v")
    a = values.select(*by, *key_cols, F.col("Method").alias("method_a"), F.col("v").alias("va"))
    b = values.select(*by, *key_cols, F.col("Method").alias("method_b"), F.col("v").alias("vb"))
    return a.join(b, by + key_cols).where("method_a < method_b")


def wilcoxon_statistics(pairs: DataFrame, by=()) -> DataFrame:
    """Signed-rank sums per method pair, zero differences dropped.

    ``n`` pairs, ``n_nonzero``, ``w_plus``, ``w_minus``, ``w`` (the smaller),
    ``z`` (tie-corrected, no continuity correction) and ``cl`` = P(a < b)
    without ties. Ranks come from the distinct sizes of the differences.
    """
    keys = [*by, "method_a", "method_b"]
    diff = pairs.withColumn("diff", F.col("va") - F.col("vb"))
    counts = diff.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    sizes = ordered_histogram(
        diff.where("diff <> 0").withColumn("size", F.abs("diff")), keys, "size",
        sums={"pos": (F.col("diff") > 0).cast("long")}).withColumnRenamed("n", "ties")
    rank = tie_averaged_rank("before", "ties")
    ranked = sizes.groupBy(*keys).agg(
        F.sum("ties").alias("n_nonzero"),
        F.sum(rank * F.col("pos")).alias("w_plus"),
        F.sum(rank * (F.col("ties") - F.col("pos"))).alias("w_minus"),
        F.sum(F.pow("ties", F.lit(3)) - F.col("ties")).alias("tie_term"),
        (F.sum(F.col("ties") - F.col("pos")) / F.sum("ties")).alias("cl"))
    m = F.col("n_nonzero").cast("double")  # its cube is beyond a long from two million pairs on
    variance = m * (m + 1) * (2 * m + 1) / 24 - F.col("tie_term") / 48
    w = F.least("w_plus", "w_minus")
    return join_on(counts, ranked, keys, "left").select(
        *keys, "n", F.coalesce("n_nonzero", F.lit(0).cast("long")).alias("n_nonzero"),
        "w_plus", "w_minus", w.alias("w"), "tie_term",
        F.try_divide(w - m * (m + 1) / 4, F.sqrt(variance)).alias("z"), "cl")


def _signed_rank_tail(n, w):
    """P(W ≤ w), W the positive rank sum of n untied differences under the null."""
    import numpy as np

    ways = np.zeros(n * (n + 1) // 2 + 1)
    ways[0] = 1.0
    for rank in range(1, n + 1):
        ways[rank:] = ways[rank:] + ways[:-rank]
    return ways[: int(math.floor(w)) + 1].sum() / 2.0**n


def wilcoxon_p(n, w, z, tie_term) -> float:
    """Two-sided p-value: exact for up to 50 untied differences, else normal."""
    if n <= 50 and tie_term == 0:
        return min(1.0, 2.0 * _signed_rank_tail(int(n), w))
    return math.erfc(abs(z) / math.sqrt(2.0))


def pairwise_wilcoxon(results: DataFrame, key_cols, metric: str = "KL_err", aggregator: str = "mean",
                      correction: str = "fdr_bh", by=()) -> DataFrame:
    """Two-sided signed-rank test of every method pair, corrected over the pairs.

    Fewer than two common keys give null; equal values throughout p = 1, cl = 0.5.
    """
    stats = wilcoxon_statistics(method_pairs(results, key_cols, metric, aggregator, by), by)

    @F.pandas_udf("double")
    def p_value(n: pd.Series, m: pd.Series, w: pd.Series, z: pd.Series, ties: pd.Series) -> pd.Series:
        out = []
        for pairs, nonzero, wi, zi, ti in zip(n, m, w, z, ties):
            out.append(None if pairs < 2 else 1.0 if nonzero == 0 else wilcoxon_p(nonzero, wi, zi, ti))
        return pd.Series(out, dtype="float64")

    enough = F.col("n") >= 2
    tested = stats.withColumn("p", p_value("n", "n_nonzero", "w", "z", "tie_term")).withColumn(
        "cl", F.when(enough & (F.col("n_nonzero") == 0), F.lit(0.5)).when(enough, F.col("cl")))
    tested = tested.withColumn("p", F.when(F.isnan("p"), None).otherwise(F.col("p")))
    return adjust_p(tested, "p", correction, by).withColumn("mark", C.significance_mark("p_adj"))


def symmetric(pairs: DataFrame) -> DataFrame:
    """Each method pair in both orders, with cl(b, a) = 1 − cl(a, b)."""
    other = pairs.withColumn("_a", F.col("method_a")).withColumn("method_a", F.col("method_b")).withColumn(
        "method_b", F.col("_a")).drop("_a").withColumn("cl", 1 - F.col("cl"))
    return pairs.unionByName(other)


def pair_count_summary(tested: DataFrame) -> DataFrame:
    """Smallest, largest and median number of paired observations."""
    middle = exact_quantiles(tested, [], "n", {"m": 0.5}).scalar()
    return tested.agg(F.min("n").alias("min_n"), F.max("n").alias("max_n")).withColumn(
        "median_n", middle.cast("long"))


def adjust_p(tests: DataFrame, p: str = "p", method: str = "fdr_bh", by=()) -> DataFrame:
    """Adjusted p-values ``p_adj`` over the non-null tests of each group.

    Methods ``fdr_bh``, ``fdr_by``, ``holm``, ``bonferroni``. A group is one
    row per method pair, the size of a report.
    """
    by = list(by)
    valid = tests.where(F.col(p).isNotNull())
    whole = W.partitionBy(*by)
    order = whole.orderBy(F.col(p))
    m, rank = F.count(F.lit(1)).over(whole), F.row_number().over(order)
    ranked = valid.withColumn("_m", m).withColumn("_k", rank)
    up_from_here = whole.orderBy("_k").rowsBetween(0, W.unboundedFollowing)
    down_to_here = whole.orderBy("_k").rowsBetween(W.unboundedPreceding, 0)
    k, n = F.col("_k"), F.col("_m")
    if method == "bonferroni":
        adjusted = F.col(p) * n
    elif method == "holm":
        adjusted = F.max(F.col(p) * (n - k + 1)).over(down_to_here)
    elif method == "fdr_bh":
        adjusted = F.min(F.col(p) * n / k).over(up_from_here)
    elif method == "fdr_by":
        harmonic = F.aggregate(F.sequence(F.lit(1).cast("long"), n), F.lit(0.0), lambda s, i: s + 1 / i)
        adjusted = F.min(F.col(p) * n * harmonic / k).over(up_from_here)
    else:
        raise ValueError(f"unknown correction {method!r}")
    done = ranked.withColumn("p_adj", F.least(adjusted, F.lit(1.0))).drop("_m", "_k")
    untested = tests.where(F.col(p).isNull()).withColumn("p_adj", F.lit(None).cast("double"))
    return done.unionByName(untested)


def paired_by_project(results: DataFrame, samples: DataFrame, metric: str = "KL_err", **options) -> DataFrame:
    """Signed-rank tests within each project, corrected per project."""
    tagged = results.join(samples.select(F.col("sample_id").alias("SampleId"), "project"), "SampleId")
    return pairwise_wilcoxon(tagged, ["SampleId"], metric, by=["project"], **options)


# --- unpaired tests over seeds ----------------------------------------------------

def welch_statistics(results: DataFrame, metric: str = "KL_err", seed_col: str = "Seed",
                     aggregator: str = "mean") -> DataFrame:
    """Welch t and degrees of freedom of every method pair on its seed-level values."""
    seeded = results.where(F.col(seed_col).isNotNull())
    values = aggregate(seeded, ["Method", seed_col], metric, aggregator, "v")
    s = values.groupBy("Method").agg(
        F.avg("v").alias("m"), F.var_samp("v").alias("s2"), F.count("v").alias("n"))
    # One row per method: a report-sized list, paired with itself as an array.
    row = F.struct("Method", "m", "s2", "n")
    every = s.agg(F.collect_list(row).alias("rows"))
    ordered = F.sort_array("rows")
    pairs = every.select(F.posexplode(ordered).alias("i", "a"), "rows").select(
        "a", F.explode(F.slice(F.sort_array("rows"), F.col("i") + 2, F.size("rows"))).alias("b"))
    pairs = pairs.select(*[F.col(f"{x}.{c}").alias(f"{c}_{x}") for x in "ab" for c in ("m", "s2", "n")],
                         F.col("a.Method").alias("method_a"), F.col("b.Method").alias("method_b"))
    ea, eb = F.col("s2_a") / F.col("n_a"), F.col("s2_b") / F.col("n_b")
    enough = (F.col("n_a") >= 2) & (F.col("n_b") >= 2)
    df = F.try_divide(F.pow(ea + eb, F.lit(2)), ea * ea / (F.col("n_a") - 1) + eb * eb / (F.col("n_b") - 1))
    return pairs.select(
        "method_a", "method_b", "n_a", "n_b",
        F.when(enough, F.try_divide(F.col("m_a") - F.col("m_b"), F.sqrt(ea + eb))).alias("t"),
        F.when(enough, df).alias("df"))


def student_p(t: float, df: float) -> float:
    """Two-sided p-value of Student's t, by the continued fraction of the incomplete beta."""
    x = df / (df + t * t)
    a, b = df / 2.0, 0.5
    if x <= 0.0 or x >= 1.0:
        return 0.0 if x <= 0.0 else 1.0
    log_front = (math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b)
                 + a * math.log(x) + b * math.log1p(-x))
    if x > (a + 1) / (a + b + 2):
        return 1.0 - math.exp(log_front) * _beta_fraction(b, a, 1 - x) / b
    return math.exp(log_front) * _beta_fraction(a, b, x) / a


def _beta_fraction(a, b, x, terms=500):
    """Continued fraction of the incomplete beta function, evaluated from its tail."""
    value = 1.0
    for i in range(terms, 0, -1):
        m = i // 2
        if i % 2 == 0:
            step = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        else:
            step = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        value = 1.0 + step / value
    return 1.0 / value


def pairwise_welch(results: DataFrame, metric: str = "KL_err", seed_col: str = "Seed",
                   aggregator: str = "mean", correction: str = "fdr_bh") -> DataFrame:
    """Welch's t-test of every method pair on seed-level values, corrected over the pairs."""
    @F.pandas_udf("double")
    def p_value(t: pd.Series, df: pd.Series) -> pd.Series:
        return pd.Series([None if pd.isna(x) or pd.isna(d) else student_p(x, d) for x, d in zip(t, df)], dtype="float64")

    tested = welch_statistics(results, metric, seed_col, aggregator).withColumn("p", p_value("t", "df"))
    return adjust_p(tested.withColumn("p", F.when(~F.isnan("p"), F.col("p"))), "p", correction)
