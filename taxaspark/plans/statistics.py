"""Queries: comparisons of methods over samples, seeds and splits."""

from pyspark.sql import functions as F

from taxaspark.operators import stats as S
from taxaspark.plans import bind as B
from taxaspark.plans.registry import query


@query("per_sample_values", f"""WITH {B.RESULTS}
SELECT "Method", "SampleId", round(avg("KL_err"), 11) AS mean, round(median("KL_err"), 11) AS median FROM results GROUP BY 1, 2""")
def per_sample_values(spark, sf):
    r = B.results(spark, sf)
    mean = S.per_sample(r, "KL_err", "mean").withColumnRenamed("KL_err", "mean")
    median = S.per_sample(r, "KL_err", "median").withColumnRenamed("KL_err", "median")
    return B.rounded(mean.join(median, ["Method", "SampleId"]), 11)


@query("per_seed_values", f"""WITH {B.RESULTS}
SELECT "Method", "Seed", round(avg("KL_err"), 6) AS mean, round(median("KL_err"), 6) AS median
FROM results WHERE "Seed" IS NOT NULL GROUP BY 1, 2""")
def per_seed_values(spark, sf):
    r = B.results(spark, sf)
    mean = S.per_seed(r, "KL_err", "mean").withColumnRenamed("KL_err", "mean")
    median = S.per_seed(r, "KL_err", "median").withColumnRenamed("KL_err", "median")
    return B.rounded(mean.join(median, ["Method", "Seed"]))


RUNS = B.RESULTS + """, runs AS (
  SELECT "Method", "DataSplitSeed", "Seed", median("KL_err") AS m FROM results GROUP BY 1, 2, 3)"""


@query("mean_std_of_medians", f"""WITH {RUNS}
SELECT "Method", round(avg(m), 6) AS mean, round(stddev_samp(m), 6) AS std, count(*) AS n_runs FROM runs GROUP BY 1""")
def mean_std_of_medians(spark, sf):
    return B.rounded(S.mean_std_of_medians(B.results(spark, sf), "KL_err", ("DataSplitSeed", "Seed")))


@query("mean_std_single_split", f"""WITH {B.RESULTS}, runs AS (
  SELECT "Method", "Seed", median("KL_err") AS m FROM results GROUP BY 1, 2)
SELECT "Method", round(avg(m), 6) AS mean, round(stddev_samp(m), 6) AS std, count(*) AS n_runs FROM runs GROUP BY 1""")
def mean_std_single_split(spark, sf):
    return B.rounded(S.mean_std_of_medians(B.results(spark, sf), "KL_err", ("Seed",)))


DECOMPOSED = RUNS + """, bys AS (
  SELECT "Method", "DataSplitSeed", avg(m) AS sm, stddev_samp(m) AS ss FROM runs GROUP BY 1, 2),
sp AS (SELECT "Method", avg(ss) AS within, stddev_samp(sm) AS btw FROM bys GROUP BY 1),
al AS (SELECT "Method", avg(m) AS mean, stddev_samp(m) AS sd, count(*) AS n_runs, count(DISTINCT "DataSplitSeed") AS ks, count(DISTINCT "Seed") AS kt FROM runs GROUP BY 1),
dec AS (
  SELECT "Method", mean, CASE WHEN ks > 1 AND kt > 1 THEN within WHEN kt > 1 THEN sd END AS std_seed,
    CASE WHEN ks > 1 AND kt > 1 THEN btw WHEN ks > 1 THEN sd END AS std_split, n_runs FROM al JOIN sp USING ("Method"))"""


@query("variance_decomposition", f"""WITH {DECOMPOSED}
SELECT "Method", round(mean, 6) AS mean, round(std_seed, 6) AS std_seed, round(std_split, 6) AS std_split, n_runs FROM dec""")
def variance_decomposition(spark, sf):
    return B.rounded(S.variance_decomposition(B.results(spark, sf), "KL_err"))


@query("best_method", f"""WITH {DECOMPOSED}
SELECT "Method", round(mean, 6) AS mean, mean = (SELECT min(mean) FROM dec) AS is_best FROM dec""")
def best_method(spark, sf):
    flagged = S.flag_best(S.variance_decomposition(B.results(spark, sf), "KL_err"))
    return B.rounded(flagged.select("Method", "mean", "is_best"))


@query("merged_statistics", f"""WITH {B.RESULTS}, x AS (
  SELECT "Method", median("KL_err") AS m FROM results WHERE "DataSplitSeed" = 1 GROUP BY 1),
y AS (SELECT "Method", median("KL_err") AS m FROM results WHERE "Method" <> '1-URGENT' GROUP BY 1)
SELECT coalesce(x."Method", y."Method") AS "Method", round(x.m, 6) AS m_pcoa, round(y.m, 6) AS m_rng FROM x FULL JOIN y ON x."Method" = y."Method" """)
def merged_statistics(spark, sf):
    r = B.results(spark, sf)
    x = S.aggregate(r.where("DataSplitSeed = 1"), ["Method"], "KL_err", "median", "m")
    y = S.aggregate(r.where("Method <> '1-URGENT'"), ["Method"], "KL_err", "median", "m")
    return B.rounded(S.merge_statistics(x, y, ("_pcoa", "_rng")))


@query("seed_counts", f"""WITH {B.RESULTS}, runs AS (SELECT DISTINCT "Method", "DataSplitSeed", "Seed" FROM results)
SELECT "Method", count(DISTINCT "DataSplitSeed") AS "n_DataSplitSeed", count(DISTINCT "Seed") AS "n_Seed", count(*) AS n_runs FROM runs GROUP BY 1""")
def seed_counts(spark, sf):
    return S.seed_counts(B.results(spark, sf), ["Method"])


@query("seed_table", f"""WITH {B.RESULTS}, c AS (
  SELECT "Method", "Seed", avg("KL_err") AS v FROM results WHERE "Seed" IS NOT NULL GROUP BY 1, 2),
m AS (SELECT "Method", round(avg(v), 6) AS mean, round(stddev_pop(v), 6) AS std FROM c GROUP BY 1),
s AS (SELECT DISTINCT "Seed" FROM c)
SELECT m."Method", mean, std, 'seed_' || s."Seed" AS seed, round(v, 6) AS value
FROM m CROSS JOIN s LEFT JOIN c ON c."Method" = m."Method" AND c."Seed" = s."Seed" """)
def seed_table(spark, sf):
    """The table with a column for every seed found, its cells shown as rows."""
    wide = S.seed_table(B.results(spark, sf), "KL_err")
    seeds = [c for c in wide.columns if c.startswith("seed_")]
    return B.rounded(wide.unpivot(["Method", "mean", "std"], seeds, "seed", "value"))


@query("scaling_table", f"""WITH {B.NAMED_RESULTS}
SELECT "Method", split_part("Method", '__', 1) AS "Embedding",
  CASE WHEN "Method" LIKE '%NO_MLP%' THEN 'pooled, no MLP' WHEN "Method" LIKE '%epc%' THEN 'pooled' ELSE 'set transformer' END AS "ModelType",
  "Seed", round(median("KL_err"), 6) AS "KL_err", round(median("NumParameters"), 6) AS "NumParameters",
  round(log10(median("KL_err")), 6) AS "KL_err_log", round(log10(median("NumParameters")), 6) AS "NumParameters_log" FROM nresults GROUP BY 1, 2, 3, 4""")
def scaling_table(spark, sf):
    return B.rounded(S.scaling_table(B.named_results(spark, sf), "median"))


@query("pooling_contrast", f"""WITH {B.NAMED_RESULTS}, t AS (
  SELECT *, split_part("Method", '__', 1) AS "Embedding", "Method" LIKE '%\\_pool\\_%' ESCAPE '\\' AS pooled,
    "Method" LIKE '%\\_nopool\\_%' ESCAPE '\\' AS nopool FROM nresults)
SELECT "DataSplitSeed", "SampleId", "Embedding", round(avg("KL_err") FILTER (pooled), 11) AS pooled,
  round(avg("KL_err") FILTER (nopool), 11) AS not_pooled,
  round(avg("KL_err") FILTER (pooled) - avg("KL_err") FILTER (nopool), 11) + 0.0 AS difference
FROM t WHERE pooled OR nopool GROUP BY 1, 2, 3""")
def pooling_contrast(spark, sf):
    return B.rounded(S.pooling_contrast(B.named_results(spark, sf)), 11)


@query("ablation_contrast", f"""WITH {B.NAMED_RESULTS}
SELECT "DataSplitSeed", "SampleId", "Method", round(avg("KL_err") FILTER ("Ablated"), 11) AS ablated,
  round(avg("KL_err") FILTER (NOT "Ablated"), 11) AS "full",
  round(avg("KL_err") FILTER ("Ablated") - avg("KL_err") FILTER (NOT "Ablated"), 11) + 0.0 AS difference
FROM nresults GROUP BY 1, 2, 3""")
def ablation_contrast(spark, sf):
    return B.rounded(S.ablation_contrast(B.named_results(spark, sf)), 11)


def wilcoxon_sql(by=""):
    """Signed-rank statistics per method pair, within ``by`` when given (with a trailing comma)."""
    return f"""v AS (SELECT {by} "Method" AS m, "SampleId" AS s, avg("KL_err") AS v FROM results GROUP BY ALL),
pr AS (SELECT {by.replace(',', '').strip() and 'a.' + by} a.m AS method_a, b.m AS method_b, a.v AS va, b.v AS vb
  FROM v a JOIN v b ON a.s = b.s AND a.m < b.m {'AND a.' + by.rstrip(', ') + ' = b.' + by.rstrip(', ') if by else ''}),
n AS (SELECT {by} method_a, method_b, count(*) AS n, count(*) FILTER (va <> vb) AS n_nonzero,
  avg(CASE WHEN va < vb THEN 1.0 ELSE 0.0 END) FILTER (va <> vb) AS cl FROM pr GROUP BY ALL),
rk AS (SELECT *, rank() OVER (PARTITION BY {by} method_a, method_b ORDER BY abs(va - vb))
  + (count(*) OVER (PARTITION BY {by} method_a, method_b, abs(va - vb)) - 1) / 2.0::DOUBLE AS r,
  count(*) OVER (PARTITION BY {by} method_a, method_b, abs(va - vb)) AS t FROM pr WHERE va <> vb),
w AS (SELECT {by} method_a, method_b, sum(CASE WHEN va > vb THEN r ELSE 0 END) AS wp, sum(CASE WHEN va < vb THEN r ELSE 0 END) AS wm,
  sum(t * t - 1)::DOUBLE AS ties, count(*) AS m FROM rk GROUP BY ALL)"""


@query("wilcoxon_stat", f"""WITH {B.RESULTS}, {wilcoxon_sql()}
SELECT method_a, method_b, n, n_nonzero, round(wp, 4) AS w_plus, round(wm, 4) AS w_minus, round(least(wp, wm), 4) AS w, ties AS tie_term,
  round((least(wp, wm) - m * (m + 1) / 4) / sqrt(m * (m + 1) * (2 * m + 1) / 24 - ties / 48), 6) AS z, round(cl, 6) AS cl
FROM n LEFT JOIN w USING (method_a, method_b)""")
def wilcoxon_stat(spark, sf):
    pairs = S.method_pairs(B.results(spark, sf), ["SampleId"], "KL_err")
    return B.rounded(B.rounded(S.wilcoxon_statistics(pairs), 4, "w_plus", "w_minus", "w"))


@query("effect_size", f"""WITH {B.RESULTS}, {wilcoxon_sql()}
SELECT method_a, method_b, round(cl, 6) AS cl FROM n UNION ALL SELECT method_b, method_a, round(1 - cl, 6) FROM n""")
def effect_size(spark, sf):
    tested = S.pairwise_wilcoxon(B.results(spark, sf), ["SampleId"])
    return B.rounded(S.symmetric(tested.select("method_a", "method_b", "cl")))


@query("pair_count_summary", f"""WITH {B.RESULTS}, {wilcoxon_sql()}
SELECT min(n) AS min_n, max(n) AS max_n, CAST(floor(median(n)) AS BIGINT) AS median_n FROM n""")
def pair_count_summary(spark, sf):
    pairs = S.method_pairs(B.results(spark, sf), ["SampleId"], "KL_err")
    return S.pair_count_summary(S.wilcoxon_statistics(pairs))


@query("paired_by_project", f"""WITH base AS (SELECT * FROM ({"WITH " + B.RESULTS + " SELECT * FROM results"})),
results AS (SELECT base.*, 'PRJ' || c_nationkey AS project FROM base JOIN customer ON "SampleId" = 'SRS' || c_custkey),
{wilcoxon_sql('project, ')}
SELECT project, method_a, method_b, n, round(least(wp, wm), 4) AS w,
  CASE WHEN n >= 2 THEN CASE WHEN n_nonzero = 0 THEN 0.5 ELSE round(cl, 6) END END AS cl FROM n LEFT JOIN w USING (project, method_a, method_b)""")
def paired_by_project(spark, sf):
    samples = B.table(spark, sf, "customer").select(
        B.prefixed("SRS", "c_custkey").alias("sample_id"), B.prefixed("PRJ", "c_nationkey").alias("project"))
    tested = S.paired_by_project(B.results(spark, sf), samples)
    return B.rounded(B.rounded(tested.select("project", "method_a", "method_b", "n", "w", "cl"), 4, "w"))


def _p_adjust(method, adjusted):
    @query(f"p_adjust_{method}", f"""WITH p AS (
  SELECT s_suppkey, s_nationkey, CASE WHEN s_acctbal >= 0 THEN round(pow(s_acctbal / 10000, 3), 12) END AS p FROM supplier),
k AS (SELECT *, row_number() OVER (PARTITION BY s_nationkey ORDER BY p) AS k, count(*) OVER (PARTITION BY s_nationkey) AS m FROM p WHERE p IS NOT NULL),
a AS (SELECT s_suppkey, {adjusted} AS p_adj FROM k)
SELECT s_suppkey, CASE WHEN p_adj IS NOT NULL THEN round(least(p_adj, 1), 6) END AS p_adj FROM p LEFT JOIN a USING (s_suppkey)""")
    def p_adjust(spark, sf):
        tests = B.table(spark, sf, "supplier").select(
            "s_suppkey", "s_nationkey",
            F.when(F.col("s_acctbal") >= 0, F.round(F.pow(F.col("s_acctbal") / 10000, F.lit(3)), 12)).alias("p"))
        return B.rounded(S.adjust_p(tests, "p", method, by=["s_nationkey"]).select("s_suppkey", "p_adj"))


_UP = "OVER (PARTITION BY s_nationkey ORDER BY k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)"
_p_adjust("bonferroni", "p * m")
_p_adjust("holm", "max(p * (m - k + 1)) OVER (PARTITION BY s_nationkey ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)")
_p_adjust("fdr_bh", f"min(p * m / k) {_UP}")
_p_adjust("fdr_by", f"min(p * m / k * list_sum(list_transform(range(1, m + 1), lambda i: 1 / i))) {_UP}")


@query("welch_stat", f"""WITH {B.RESULTS}, c AS (
  SELECT "Method" AS m, avg("KL_err") AS v FROM results WHERE "Seed" IS NOT NULL GROUP BY "Method", "Seed"),
s AS (SELECT m, avg(v) AS a, var_samp(v) AS s2, count(*) AS n FROM c GROUP BY 1)
SELECT x.m AS method_a, y.m AS method_b, x.n AS n_a, y.n AS n_b, round((x.a - y.a) / sqrt(x.s2 / x.n + y.s2 / y.n), 6) AS t,
  round(pow(x.s2 / x.n + y.s2 / y.n, 2) / (pow(x.s2 / x.n, 2) / (x.n - 1) + pow(y.s2 / y.n, 2) / (y.n - 1)), 6) AS df
FROM s x JOIN s y ON x.m < y.m""")
def welch_stat(spark, sf):
    return B.rounded(S.welch_statistics(B.results(spark, sf)))


@query("pairwise_wilcoxon_p")
def pairwise_wilcoxon_p(spark, sf):
    return B.rounded(S.pairwise_wilcoxon(B.results(spark, sf), ["SampleId"]))


@query("pairwise_welch_p")
def pairwise_welch_p(spark, sf):
    return B.rounded(S.pairwise_welch(B.results(spark, sf)))
