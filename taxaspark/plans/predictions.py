"""Queries: baseline predictors, metrics, losses."""

from functools import reduce

from pyspark.sql import functions as F

from taxaspark import fixed_values as fixed
from taxaspark.lineage import materialize
from taxaspark.operators import baseline as BL, evaluation as E, metrics as M, sequences as Q, tree as T
from taxaspark.operators.distance import both_ways
from taxaspark.operators.ordering import hash_positions
from taxaspark.plans import bind as B
from taxaspark.plans.registry import query

WEIGHTS = """weights AS (SELECT taxon_id AS target, exp(avg(ln(rel_abund))) AS weight FROM train GROUP BY 1)"""


def translated_sql(lookup="nn", name="tr"):
    return f"""{name} AS (
  SELECT t.sample_id, t.taxon_id, coalesce(l.answer, s.taxon_id) AS target FROM test t
  LEFT JOIN {lookup} l ON l.query = t.taxon_id LEFT JOIN (SELECT DISTINCT taxon_id FROM train) s ON s.taxon_id = t.taxon_id)"""


def knn_sql(k, tr="tr", p=""):
    """Weights from the k most similar training samples, falling back to all of them."""
    return f"""{p}q AS (SELECT DISTINCT sample_id, target FROM {tr} WHERE target IS NOT NULL),
{p}qs AS (SELECT sample_id, count(*) AS k FROM {p}q GROUP BY 1),
{p}ts AS (SELECT sample_id, count(*) AS k FROM train GROUP BY 1),
{p}sh AS (SELECT q.sample_id AS a, t.sample_id AS b, count(*) AS s FROM {p}q q JOIN train t ON t.taxon_id = q.target GROUP BY 1, 2),
{p}near AS (
  SELECT a, b FROM {p}sh JOIN {p}qs x ON x.sample_id = a JOIN {p}ts y ON y.sample_id = b
  QUALIFY row_number() OVER (PARTITION BY a ORDER BY s / (x.k + y.k - s)::DOUBLE DESC, b) <= {k}),
{p}local AS (
  SELECT n.a AS sample_id, q.target, exp(avg(ln(t.rel_abund))) AS local FROM {p}near n
  JOIN train t ON t.sample_id = n.b JOIN {p}q q ON q.sample_id = n.a AND q.target = t.taxon_id GROUP BY 1, 2),
{p}w AS (
  SELECT tr.sample_id, tr.taxon_id, coalesce(local, weight, 0) AS w FROM {tr} tr
  LEFT JOIN {p}local l ON l.sample_id = tr.sample_id AND l.target = tr.target LEFT JOIN weights g ON g.target = tr.target),
{p}pred AS (SELECT sample_id, taxon_id, w / sum(w) OVER (PARTITION BY sample_id) AS pred FROM {p}w)"""


NN_PRED = B.NN + ", " + WEIGHTS + ", " + translated_sql() + """, gw AS (
  SELECT sample_id, taxon_id, coalesce(weight, 0) AS w FROM tr LEFT JOIN weights USING (target)),
gpred AS (SELECT sample_id, taxon_id, w / sum(w) OVER (PARTITION BY sample_id) AS pred FROM gw)"""

UNIFORM = "upred AS (SELECT sample_id, taxon_id, 1 / count(*) OVER (PARTITION BY sample_id) AS pred FROM test)"


@query("predict_uniform", f"WITH {B.TRAIN_TEST}, {UNIFORM} SELECT sample_id, taxon_id, round(pred, 12) AS pred FROM upred")
def predict_uniform(spark, sf):
    _, test = B.train_test(spark, sf)
    return B.rounded(BL.predict_uniform(test), 12)


@query("training_table", f"WITH {B.TRAIN_TEST} SELECT sample_id, taxon_id, round(rel_abund, 12) AS rel_abund FROM train")
def training_table(spark, sf):
    return B.rounded(B.train_test(spark, sf)[0], 12)


@query("taxon_weights", f"""WITH {B.TRAIN_TEST} SELECT taxon_id AS target, round(exp(avg(ln(rel_abund))), 9) AS weight,
  round(exp(avg(ln(rel_abund + 1e-6))), 9) AS weight_eps FROM train GROUP BY 1""")
def taxon_weights(spark, sf):
    train, _ = B.train_test(spark, sf)
    eps = BL.taxon_weights(train, fixed.GEOMETRIC_MEAN_EPS).withColumnRenamed("weight", "weight_eps")
    return B.rounded(BL.taxon_weights(train).join(eps, "target"), 9)


@query("predict_nn", f"WITH {NN_PRED} SELECT sample_id, taxon_id, round(pred, 9) AS pred FROM gpred")
def predict_nn(spark, sf):
    train, test = B.train_test(spark, sf)
    return B.rounded(BL.predict_nn(test, train, B.nn_lookup(spark, sf, train, test)), 9)


@query("nearest_samples", f"""WITH {B.NN}, {WEIGHTS}, {translated_sql()}, {knn_sql(10)},
every AS (SELECT DISTINCT sample_id FROM tr)
SELECT e.sample_id, y.sample_id AS neighbour FROM every e CROSS JOIN ts y
  LEFT JOIN qs x ON x.sample_id = e.sample_id LEFT JOIN sh ON a = e.sample_id AND b = y.sample_id
QUALIFY row_number() OVER (PARTITION BY e.sample_id ORDER BY coalesce(s / (x.k + y.k - s)::DOUBLE, 0) DESC, y.sample_id) <= 10""")
def nearest_samples(spark, sf):
    train, test = B.train_test(spark, sf)
    translated = BL.translate(test, B.nn_lookup(spark, sf, train, test), train)
    return BL.nearest_samples(translated, train, 10).select("sample_id", "neighbour")


def _knn(k):
    @query(f"predict_knn_{k}", f"""WITH {B.NN}, {WEIGHTS}, {translated_sql()}, {knn_sql(k)}
SELECT sample_id, taxon_id, round(pred, 9) AS pred FROM pred""")
    def predict_knn(spark, sf):
        train, test = B.train_test(spark, sf)
        return B.rounded(BL.predict_nn(test, train, B.nn_lookup(spark, sf, train, test), k=k), 9)


for _k in (10, 20, 30, 40):
    _knn(_k)


@query("predict_nn_within_project", f"""WITH {B.NN_WITHIN}, {WEIGHTS}, {translated_sql('looked')}, gw AS (
  SELECT sample_id, taxon_id, coalesce(weight, 0) AS w FROM tr LEFT JOIN weights USING (target))
SELECT sample_id, taxon_id, round(w / sum(w) OVER (PARTITION BY sample_id), 9) AS pred FROM gw""")
def predict_nn_within_project(spark, sf):
    train, test = B.train_test(spark, sf)
    lookup = Q.best_of_lookups([B.nn_within_project(spark, sf, train, test), B.nn_lookup(spark, sf, train, test)])
    return B.rounded(BL.predict_nn(test, train, lookup), 9)


@query("predict_knn_within_project", f"""WITH {B.NN_WITHIN}, {WEIGHTS}, {translated_sql('looked')}, {knn_sql(10)}
SELECT sample_id, taxon_id, round(pred, 9) AS pred FROM pred""")
def predict_knn_within_project(spark, sf):
    train, test = B.train_test(spark, sf)
    lookup = Q.best_of_lookups([B.nn_within_project(spark, sf, train, test), B.nn_lookup(spark, sf, train, test)])
    return B.rounded(BL.predict_nn(test, train, lookup, k=10), 9)


# Lookup from a matrix of the parts whose size is below 40; others translate to themselves or to nothing.
PARTIAL = B.NN.replace("nn AS (", "nn_all AS (") + """, nn AS (
  SELECT query, answer, similarity FROM nn_all JOIN part ON query = 'ASV' || p_partkey WHERE p_size < 40)"""


@query("predict_nn_partial_lookup", f"""WITH {PARTIAL}, {WEIGHTS}, {translated_sql()}, gw AS (
  SELECT sample_id, taxon_id, coalesce(weight, 0) AS w FROM tr LEFT JOIN weights USING (target))
SELECT sample_id, taxon_id, round(w / sum(w) OVER (PARTITION BY sample_id), 9) AS pred FROM gw""")
def predict_nn_partial_lookup(spark, sf):
    """Taxa off the lookup stand for themselves if they train, else weigh nothing."""
    train, test = B.train_test(spark, sf)
    listed = B.table(spark, sf, "part").where("p_size < 40").select(B.prefixed("ASV", "p_partkey").alias("query"))
    lookup = B.nn_lookup(spark, sf, train, test).join(listed, "query", "left_semi")
    return B.rounded(BL.predict_nn(test, train, lookup), 9)


@query("predict_knn_eps", f"""WITH {B.NN}, {WEIGHTS.replace('ln(rel_abund)', 'ln(rel_abund + 1e-6)')}, {translated_sql()},
{knn_sql(10).replace('ln(t.rel_abund)', 'ln(t.rel_abund + 1e-6)')}
SELECT sample_id, taxon_id, round(pred, 9) AS pred FROM pred""")
def predict_knn_eps(spark, sf):
    """The older weights, with a constant inside the log."""
    train, test = B.train_test(spark, sf)
    nn = B.nn_lookup(spark, sf, train, test)
    return B.rounded(BL.predict_nn(test, train, nn, k=10, eps=fixed.GEOMETRIC_MEAN_EPS), 9)


NATION_PROFILE = """oc AS (
  SELECT 'C' || o_custkey AS sample_id, 'SRS' || l_suppkey AS taxon_id, sum(l_quantity) AS n, max(o_orderstatus) AS st
  FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY ALL),
op AS (SELECT sample_id, taxon_id, n / sum(n) OVER (PARTITION BY sample_id) AS rel_abund FROM oc),
trainc AS (SELECT op.* FROM op JOIN customer ON sample_id = 'C' || c_custkey WHERE c_mktsegment <> 'MACHINERY' AND taxon_id IN (
  SELECT 'SRS' || s_suppkey FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE r_name <> 'EUROPE')),
testc AS (SELECT op.* FROM op JOIN customer ON sample_id = 'C' || c_custkey WHERE c_mktsegment = 'MACHINERY')"""


@query("predict_tree_nn", f"""WITH {B.TREE}, {NATION_PROFILE}, keys AS (SELECT DISTINCT taxon_id FROM trainc),
cl AS (
  SELECT taxon_id AS query, taxon_id AS answer FROM keys
  UNION ALL SELECT a, b FROM patristic WHERE a NOT IN (FROM keys) AND b IN (FROM keys)
  QUALIFY row_number() OVER (PARTITION BY a ORDER BY d, b) = 1),
g AS (SELECT taxon_id AS answer, exp(avg(ln(rel_abund + 1e-6))) AS weight FROM trainc GROUP BY 1),
w AS (SELECT sample_id, taxon_id, coalesce(weight, 0) AS w FROM testc LEFT JOIN cl ON query = taxon_id LEFT JOIN g USING (answer))
SELECT sample_id, taxon_id, round(w / sum(w) OVER (PARTITION BY sample_id), 9) AS pred FROM w""")
def predict_tree_nn(spark, sf):
    """Customers as samples, suppliers as taxa: the closest training supplier on the tree.

    One segment is the test set, the others train; suppliers of one region are new to it.
    """
    from taxaspark.operators.profile import relative_abundance
    n = B.table(spark, sf, "orders").join(B.table(spark, sf, "lineitem"), F.col("o_orderkey") == F.col("l_orderkey")).groupBy(
        B.prefixed("C", "o_custkey").alias("sample_id"), B.prefixed("SRS", "l_suppkey").alias("taxon_id")).agg(
        F.sum("l_quantity").alias("n"))
    profile = relative_abundance(n)
    segment = lambda test: B.table(spark, sf, "customer").where((F.col("c_mktsegment") == "MACHINERY") == F.lit(test)).select(
        B.prefixed("C", "c_custkey").alias("sample_id"))
    nations = B.table(spark, sf, "nation").join(
        B.table(spark, sf, "region").where("r_name <> 'EUROPE'"), F.col("n_regionkey") == F.col("r_regionkey"))
    known = B.table(spark, sf, "supplier").join(nations, F.col("s_nationkey") == F.col("n_nationkey"), "left_semi").select(
        B.prefixed("SRS", "s_suppkey").alias("taxon_id"))
    train = profile.join(segment(False), "sample_id", "left_semi").join(known, "taxon_id", "left_semi")
    test = profile.join(segment(True), "sample_id", "left_semi")
    closest = T.closest_leaf(B.tree(spark, sf), test.select("taxon_id").distinct(), train.select("taxon_id").distinct())
    return B.rounded(BL.predict_tree_nn(test, train, closest), 9)


@query("nn_from_distances", f"""WITH {B.BRAND_DISTANCES}
SELECT a AS query, b AS answer FROM bdist WHERE a >= 'Brand#2' AND b < 'Brand#2'
QUALIFY row_number() OVER (PARTITION BY a ORDER BY d, b) = 1""")
def nn_from_distances(spark, sf):
    """Nearest neighbour as the smallest entry of a distance table; ties by database order."""
    inside = both_ways(B.brand_distances(spark, sf)).where("a >= 'Brand#2' and b < 'Brand#2'")
    return inside.groupBy(F.col("a").alias("query")).agg(F.min_by("b", F.struct("d", "b")).alias("answer"))


@query("empty_predictions", """SELECT DISTINCT 'SRS' || l_suppkey || '|' || l_orderkey AS sample_id FROM lineitem
GROUP BY l_suppkey, l_orderkey HAVING max(l_discount) = 0""")
def empty_predictions(spark, sf):
    weights = B.table(spark, sf, "lineitem").select(
        F.concat_ws("|", B.prefixed("SRS", "l_suppkey"), F.col("l_orderkey").cast("string")).alias("sample_id"),
        F.col("l_discount").alias("pred"))
    return BL.empty_predictions(weights)


LOG_PRED = """lp{0} AS (SELECT sample_id, taxon_id, ln((pred + 1e-8) / sum(pred + 1e-8) OVER (PARTITION BY sample_id)) AS lp FROM {0}pred)"""


@query("log_predictions", f"WITH {NN_PRED}, {LOG_PRED.format('g')} SELECT sample_id, taxon_id, round(lp, 6) AS lp FROM lpg")
def log_predictions(spark, sf):
    train, test = B.train_test(spark, sf)
    return B.rounded(BL.log_predictions(BL.predict_nn(test, train, B.nn_lookup(spark, sf, train, test))))


EVALUATE = """, cells AS (
  SELECT "Method", sample_id, t.rel_abund AS t, ln(t.rel_abund) AS lt, lp, exp(lp) AS p
  FROM preds JOIN test t USING (sample_id, taxon_id)),
ranked AS (
  SELECT *, rank() OVER (PARTITION BY "Method", sample_id ORDER BY lt::FLOAT) + (count(*) OVER (PARTITION BY "Method", sample_id, lt::FLOAT) - 1) / 2.0::DOUBLE AS rt,
    rank() OVER (PARTITION BY "Method", sample_id ORDER BY lp::FLOAT) + (count(*) OVER (PARTITION BY "Method", sample_id, lp::FLOAT) - 1) / 2.0::DOUBLE AS rp
  FROM cells),
scored AS (
  SELECT "Method", sample_id, sum(t * (lt - lp)) AS kl, sqrt(avg(pow((lp - lt) * log10(exp(1.0::DOUBLE)), 2))) AS rmsl,
    CASE WHEN min(rp) = max(rp) OR min(rt) = max(rt) THEN NULL ELSE corr(rt, rp) END AS rho,
    1 - 2 * sum(least(t, p)) / (sum(t) + sum(p)) AS bc,
    sqrt(greatest(0.5 * sum(t * ln(2 * t / (t + p)) + p * ln(2 * p / (t + p))), 0)) AS rjs, count(*) AS k
  FROM ranked GROUP BY 1, 2)
SELECT "Method", sample_id, round(kl, 6) AS "KL_err", round(rmsl, 6) AS "RMSL_err", round(rho, 6) AS "SpearmanCorr",
  round(bc, 6) AS "BrayCurtis", round(rjs, 6) AS "RootJensenShannon", k AS "NumTaxa" FROM scored"""


@query("evaluate_baselines", f"""WITH {NN_PRED}, {UNIFORM}, {knn_sql(10, p='k10')}, {knn_sql(20, p='k20')},
{knn_sql(30, p='k30')}, {knn_sql(40, p='k40')}, {LOG_PRED.format('k30')}, {LOG_PRED.format('k40')},
{LOG_PRED.format('u')}, {LOG_PRED.format('g')}, {LOG_PRED.format('k10')}, {LOG_PRED.format('k20')}, preds AS (
  SELECT 'uniform' AS "Method", * FROM lpu UNION ALL SELECT 'nearest_neighbor', * FROM lpg
  UNION ALL SELECT 'nearest_neighbor_KNN_10', * FROM lpk10 UNION ALL SELECT 'nearest_neighbor_KNN_20', * FROM lpk20
  UNION ALL SELECT 'nearest_neighbor_KNN_30', * FROM lpk30 UNION ALL SELECT 'nearest_neighbor_KNN_40', * FROM lpk40){EVALUATE}""")
def evaluate_baselines(spark, sf):
    """Flagship: predict every test profile with six baselines and score each sample."""
    train, test = B.train_test(spark, sf)
    nn = B.nn_lookup(spark, sf, train, test)
    return B.rounded(E.evaluate_all(test, train, nn))


def _loss(name, cell, mean_of_samples, per_taxon):
    reductions = ("batchmean", "mean", "sum")
    total = f"sum(CASE WHEN t > 0 THEN {cell} ELSE 0 END)" + (" / count(*) FILTER (t > 0)" if per_taxon else "")
    mean = "sum(l) / count(*)" if mean_of_samples else "sum(l) / (count(*) * max(k))"

    @query(f"loss_{name}", f"""WITH {NN_PRED}, {LOG_PRED.format('g')}, cells AS (
  SELECT sample_id, rel_abund AS t, lp FROM lpg JOIN test USING (sample_id, taxon_id)),
per AS (SELECT sample_id, {total} AS l, count(*) AS k FROM cells GROUP BY 1)
SELECT 'batchmean' AS reduction, round(sum(l) / count(*), 6) AS loss FROM per
UNION ALL SELECT 'mean', round({mean}, 6) FROM per UNION ALL SELECT 'sum', round(sum(l), 6) FROM per
UNION ALL SELECT sample_id, round(l, 6) FROM per""")
    def loss(spark, sf):
        """Every reduction; the unreduced losses carry their sample id."""
        train, test = B.train_test(spark, sf)
        lp = materialize(BL.log_predictions(BL.predict_nn(test, train, B.nn_lookup(spark, sf, train, test))), "lp")
        rows = [M.loss(lp, test, name, r).select(F.lit(r).alias("reduction"), "loss") for r in reductions]
        rows.append(M.loss(lp, test, name, "none").select(F.col("sample_id").alias("reduction"), "loss"))
        return B.rounded(reduce(lambda x, y: x.unionByName(y), rows))


_loss("kl", "t * (ln(t) - lp)", False, False)
_loss("cross_entropy", "-t * lp", False, False)
_loss("mse_log", "pow(lp - ln(t), 2)", True, True)
_loss("mse", "pow(t - exp(lp), 2)", False, True)


@query("weighted_mean_loss", "SELECT round(sum(o_totalprice * o_custkey) / sum(o_custkey), 4) AS loss FROM orders")
def weighted_mean_loss(spark, sf):
    return B.rounded(M.weighted_mean_loss(B.table(spark, sf, "orders").select(
        F.col("o_totalprice").alias("loss"), F.col("o_custkey").alias("n"))), 4)


@query("log_softmax", f"""WITH {B.COUNTS}, live AS (
  SELECT sample_id, taxon_id, n / 10.0::DOUBLE AS x FROM counts WHERE n >= 15)
SELECT c.sample_id, c.taxon_id, round(l.x - m.v, 6) AS lp FROM counts c LEFT JOIN live l USING (sample_id, taxon_id)
LEFT JOIN (SELECT sample_id, max(x) + ln(sum(exp(x - top))) AS v
  FROM (SELECT *, max(x) OVER (PARTITION BY sample_id) AS top FROM live) GROUP BY 1) m USING (sample_id)""")
def log_softmax(spark, sf):
    """Masked rows come back as −∞, shown as null."""
    logits = B.counts(spark, sf).select("sample_id", "taxon_id", (F.col("n") / 10.0).alias("logit"), (F.col("n") >= 15).alias("mask"))
    out = M.log_softmax(logits, mask="mask")
    return B.rounded(out.select("sample_id", "taxon_id", F.when(F.col("lp") > float("-inf"), F.col("lp")).alias("lp")))


@query("average_ranks", f"""WITH {B.COUNTS}
SELECT sample_id, taxon_id, rank() OVER (PARTITION BY sample_id ORDER BY n) + (count(*) OVER (PARTITION BY sample_id, n) - 1) / 2.0::DOUBLE AS r FROM counts""")
def average_ranks(spark, sf):
    return M.average_ranks(B.counts(spark, sf), ["sample_id"], "n", "r").select("sample_id", "taxon_id", "r")


@query("hash_order", """SELECT o_orderkey, row_number() OVER (PARTITION BY o_orderpriority ORDER BY md5('5|' || o_orderkey)) - 1 AS position FROM orders""")
def hash_order(spark, sf):
    placed = hash_positions(B.table(spark, sf, "orders").select("o_orderkey", "o_orderpriority"), "o_orderkey", 5, ["o_orderpriority"])
    return placed.select("o_orderkey", "position")
