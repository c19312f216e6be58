"""Queries: pair distances, sequences, trees, graphs, splits."""

from pyspark.sql import functions as F

from taxaspark.functions import columns as C
from taxaspark.operators import (
    distance as D, graph as G, ordination as O, sequences as Q, split as L, tree as T,
)
from taxaspark.plans import bind as B
from taxaspark.plans.registry import query

PAIRS = B.PROFILE + """, sizes AS (SELECT sample_id, count(*) AS k FROM profile GROUP BY 1),
allpairs AS (SELECT x.sample_id AS a, y.sample_id AS b, x.k AS ka, y.k AS kb FROM sizes x JOIN sizes y ON x.sample_id < y.sample_id),
shared AS (
  SELECT x.sample_id AS a, y.sample_id AS b, count(*) AS s, sum(least(x.rel_abund, y.rel_abund)) AS low,
    sum(x.rel_abund * ln(x.rel_abund / (x.rel_abund + y.rel_abund)) + y.rel_abund * ln(y.rel_abund / (x.rel_abund + y.rel_abund))) AS js
  FROM profile x JOIN profile y ON x.taxon_id = y.taxon_id AND x.sample_id < y.sample_id GROUP BY 1, 2)"""


@query("co_occurrence", f"WITH {PAIRS} SELECT a, b, s AS n_shared, ka AS n_a, kb AS n_b FROM shared JOIN allpairs USING (a, b)")
def co_occurrence(spark, sf):
    return D.co_occurrence(B.profile(spark, sf))


@query("jaccard_pairs", f"""WITH {PAIRS}
SELECT a, b, round(1 - coalesce(s, 0) / (ka + kb - coalesce(s, 0)), 6) AS d FROM allpairs LEFT JOIN shared USING (a, b)""")
def jaccard_pairs(spark, sf):
    return B.rounded(D.sample_distances(B.profile(spark, sf), "jaccard"))


@query("js_pairs", f"""WITH {PAIRS}
SELECT a, b, round(ln(2.0::DOUBLE) + 0.5 * coalesce(js, 0), 6) AS d FROM allpairs LEFT JOIN shared USING (a, b)""")
def js_pairs(spark, sf):
    return B.rounded(D.sample_distances(B.profile(spark, sf), "jensen_shannon"))


@query("root_js_pairs", f"""WITH {PAIRS}
SELECT a, b, round(sqrt(ln(2.0::DOUBLE) + 0.5 * coalesce(js, 0)), 6) AS d FROM allpairs LEFT JOIN shared USING (a, b)""")
def root_js_pairs(spark, sf):
    return B.rounded(D.sample_distances(B.profile(spark, sf), "root_jensen_shannon"))


@query("bray_curtis_pairs", f"""WITH {PAIRS}
SELECT a, b, round(1 - coalesce(low, 0), 6) AS d FROM allpairs LEFT JOIN shared USING (a, b)""")
def bray_curtis_pairs(spark, sf):
    return B.rounded(D.sample_distances(B.profile(spark, sf), "bray_curtis"))


DENSE = """ec AS (SELECT 'U' || user_id AS sample_id, event_type AS taxon_id, count(*) AS n FROM events GROUP BY ALL),
ep AS (SELECT sample_id, taxon_id, n / sum(n) OVER (PARTITION BY sample_id) AS p FROM ec)"""


@query("js_pairs_dense", f"""WITH {DENSE}, grid AS (
  SELECT s.sample_id, t.taxon_id, coalesce(p, 0) AS p FROM (SELECT DISTINCT sample_id FROM ep) s
  CROSS JOIN (SELECT DISTINCT taxon_id FROM ep) t LEFT JOIN ep USING (sample_id, taxon_id))
SELECT x.sample_id AS a, y.sample_id AS b, round(0.5 * sum(
  CASE WHEN x.p > 0 THEN x.p * ln(2 * x.p / (x.p + y.p)) ELSE 0 END + CASE WHEN y.p > 0 THEN y.p * ln(2 * y.p / (x.p + y.p)) ELSE 0 END), 6) AS d
FROM grid x JOIN grid y ON x.taxon_id = y.taxon_id AND x.sample_id < y.sample_id GROUP BY 1, 2""")
def js_pairs_dense(spark, sf):
    """The species-table form: few taxa that most samples have."""
    n = B.table(spark, sf, "events").groupBy(
        B.prefixed("U", "user_id").alias("sample_id"), F.col("event_type").alias("taxon_id")).agg(
        F.count(F.lit(1)).alias("n"))
    from taxaspark.operators.profile import relative_abundance
    return B.rounded(D.sample_distances(relative_abundance(n), "jensen_shannon"))


@query("mean_linkage_pairs", f"""WITH {B.BRAND_PROFILE}, {B.BRAND_DISTANCES}
SELECT x.sample_id AS a, y.sample_id AS b, round(avg(d), 6) AS d
FROM bprofile x JOIN bdist ON bdist.a = x.taxon_id JOIN bprofile y ON y.taxon_id = bdist.b
WHERE x.sample_id < y.sample_id GROUP BY 1, 2""")
def mean_linkage_pairs(spark, sf):
    return B.rounded(D.sample_distances(B.brand_profile(spark, sf), "precomputed", B.brand_distances(spark, sf)))


@query("distance_submatrix", f"""WITH {B.BRAND_DISTANCES}
SELECT a, b, d FROM bdist WHERE a < 'Brand#2' AND b >= 'Brand#2'""")
def distance_submatrix(spark, sf):
    brands = B.table(spark, sf, "part").select("p_brand").distinct()
    return D.submatrix(B.brand_distances(spark, sf), brands.where("p_brand < 'Brand#2'"), brands.where("p_brand >= 'Brand#2'"))


@query("distance_similarity", f"""WITH {B.BRAND_DISTANCES}
SELECT a, b, round(1 - d / (SELECT max(d) FROM bdist), 6) AS similarity FROM bdist WHERE a < b""")
def distance_similarity(spark, sf):
    return B.rounded(D.similarities(B.brand_distances(spark, sf)))


@query("jaccard_arrays", """WITH s AS (
  SELECT l_orderkey, list(DISTINCT l_suppkey) AS x, list(DISTINCT l_partkey % 100) AS y FROM lineitem GROUP BY 1)
SELECT l_orderkey, round(len(list_intersect(x, y)) / len(list_distinct(list_concat(x, y)))::DOUBLE, 6) AS j FROM s""")
def jaccard_arrays(spark, sf):
    """Set similarity of two arrays per row: suppliers of an order and part groups of it."""
    sets = B.table(spark, sf, "lineitem").groupBy("l_orderkey").agg(
        F.collect_set("l_suppkey").alias("x"), F.collect_set(F.col("l_partkey") % 100).alias("y"))
    return B.rounded(sets.select("l_orderkey", C.jaccard("x", "y").alias("j")))


# --- sequences ----------------------------------------------------------------------

@query("hamming_rows", "SELECT o_orderkey, CAST(hamming(md5(o_orderpriority), md5(o_orderkey::VARCHAR)) AS INTEGER) AS h FROM orders")
def hamming_rows(spark, sf):
    o = B.table(spark, sf, "orders")
    return o.select("o_orderkey", C.hamming(F.md5("o_orderpriority"), F.md5(F.col("o_orderkey").cast("string"))).alias("h"))


@query("hamming_pairs", """SELECT x.s_name AS a, y.s_name AS b, CAST(hamming(md5(x.s_name), md5(y.s_name)) AS DOUBLE) AS d
FROM supplier x JOIN supplier y ON x.s_name < y.s_name""")
def hamming_pairs(spark, sf):
    s = B.table(spark, sf, "supplier")
    return Q.hamming_pairs(s.select(F.col("s_name").alias("taxon_id"), F.md5("s_name").alias("aln")))


@query("hamming_row_sums", f"""WITH {B.SEQUENCES}
SELECT x.taxon_id AS a, count(*) AS n, CAST(sum(hamming(x.aln, y.aln)) AS BIGINT) AS total, CAST(max(hamming(x.aln, y.aln)) AS DOUBLE) AS furthest
FROM sequences x JOIN sequences y ON x.taxon_id < y.taxon_id GROUP BY 1""")
def hamming_row_sums(spark, sf):
    """The distance matrix of all parts, copies included, as row sums."""
    return Q.hamming_pairs(B.sequences(spark, sf)).groupBy("a").agg(
        F.count(F.lit(1)).alias("n"), F.sum("d").cast("bigint").alias("total"), F.max("d").alias("furthest"))


@query("aligned_nn", f"WITH {B.NN} SELECT query, answer, round(similarity, 6) AS similarity FROM nn")
def aligned_nn(spark, sf):
    return B.rounded(B.nn_lookup(spark, sf, *B.train_test(spark, sf)))


@query("aligned_nn_within_project", f"WITH {B.NN_WITHIN} SELECT project, query, answer, round(similarity, 6) AS similarity FROM nnw")
def aligned_nn_within_project(spark, sf):
    return B.rounded(B.nn_within_project(spark, sf, *B.train_test(spark, sf)))


@query("best_of_lookups", f"WITH {B.NN_WITHIN} SELECT query, answer, round(similarity, 6) AS similarity FROM looked")
def best_of_lookups(spark, sf):
    train, test = B.train_test(spark, sf)
    return B.rounded(Q.best_of_lookups([B.nn_within_project(spark, sf, train, test), B.nn_lookup(spark, sf, train, test)]))


# --- trees ----------------------------------------------------------------------------

@query("tree_depths", f"WITH {B.TREE} SELECT node_id, name, CAST(depth AS BIGINT) AS depth, round(root_dist, 6) AS root_dist FROM tree JOIN depths USING (node_id)")
def tree_depths(spark, sf):
    return B.rounded(T.tree_depths(B.tree(spark, sf)).select("node_id", "name", "depth", "root_dist"))


@query("tree_ancestors", f"WITH {B.TREE} SELECT node_id, ancestor_id, CAST(steps AS BIGINT) AS steps, round(length, 6) AS length FROM up")
def tree_ancestors(spark, sf):
    return B.rounded(T.ancestors(B.tree(spark, sf)))


@query("patristic_pairs", f"WITH {B.TREE} SELECT a, b, round(d, 6) AS d FROM patristic WHERE a < b")
def patristic_pairs(spark, sf):
    return B.rounded(T.patristic(B.tree(spark, sf)))


@query("closest_leaf", f"""WITH {B.TREE}, {B.split_sql()},
k AS (SELECT sample_id FROM split WHERE label = 'Train'), q AS (
  SELECT 'SRS' || c_custkey AS query FROM customer)
SELECT query, answer, round(d, 6) AS d FROM (
  SELECT query, query AS answer, 0.0::DOUBLE AS d FROM q WHERE query IN (FROM k)
  UNION ALL
  SELECT a, b, d FROM patristic WHERE a IN (FROM q) AND a NOT IN (FROM k) AND b IN (FROM k)
  QUALIFY row_number() OVER (PARTITION BY a ORDER BY d, b) = 1)""")
def closest_leaf(spark, sf):
    """Customers named like suppliers are leaves; the others get no answer."""
    keys = B.split(spark, sf).where("label = 'Train'").select("sample_id")
    queries = B.table(spark, sf, "customer").select(B.prefixed("SRS", "c_custkey").alias("q"))
    return B.rounded(T.closest_leaf(B.tree(spark, sf), queries, keys))


@query("pruned_tree", f"""WITH {B.TREE}, want AS (SELECT 'SRS' || s_suppkey AS name FROM supplier WHERE s_acctbal >= 5000),
kept AS (SELECT DISTINCT ancestor_id AS node_id FROM up SEMI JOIN (SELECT node_id FROM leaf SEMI JOIN want USING (name)) w USING (node_id)),
kids AS (SELECT parent_id AS node_id, count(*) AS k FROM tree SEMI JOIN kept USING (node_id) WHERE parent_id IS NOT NULL GROUP BY 1),
stay AS (SELECT t.* FROM tree t SEMI JOIN kept USING (node_id) LEFT JOIN kids USING (node_id) WHERE coalesce(k, 0) <> 1 OR parent_id IS NULL)
SELECT s.node_id, p.ancestor_id AS parent_id, s.name, round(coalesce(p.length, s.branch_length), 6) AS branch_length
FROM stay s LEFT JOIN (
  SELECT node_id, ancestor_id, length FROM up WHERE steps > 0 AND ancestor_id IN (SELECT node_id FROM stay)
  QUALIFY row_number() OVER (PARTITION BY node_id ORDER BY steps) = 1) p ON p.node_id = s.node_id""")
def pruned_tree(spark, sf):
    names = B.table(spark, sf, "supplier").where("s_acctbal >= 5000").select(B.prefixed("SRS", "s_suppkey").alias("name"))
    return B.rounded(T.prune(B.tree(spark, sf), names))


@query("pruned_patristic", f"""WITH {B.TREE}, want AS (SELECT 'SRS' || s_suppkey AS name FROM supplier WHERE s_acctbal >= 5000)
SELECT a, b, round(d, 6) AS d FROM patristic WHERE a < b AND a IN (FROM want) AND b IN (FROM want)""")
def pruned_patristic(spark, sf):
    names = B.table(spark, sf, "supplier").where("s_acctbal >= 5000").select(B.prefixed("SRS", "s_suppkey").alias("name"))
    return B.rounded(T.patristic(T.prune(B.tree(spark, sf), names)))


@query("missing_leaves", """SELECT 'SRS' || c_custkey AS name FROM customer WHERE c_custkey NOT IN (SELECT s_suppkey FROM supplier)""")
def missing_leaves(spark, sf):
    return T.missing_leaves(B.tree(spark, sf), B.table(spark, sf, "customer").select(B.prefixed("SRS", "c_custkey").alias("name")))


@query("newick_nodes", """SELECT CAST(n_nationkey AS BIGINT) AS tree_id, count(*) * 3 + 2 AS nodes, round(sum(abs(s_acctbal)) / 1000 + 2.5, 5) AS total
FROM supplier JOIN nation ON s_nationkey = n_nationkey GROUP BY 1""")
def newick_nodes(spark, sf):
    """One Newick text per nation, ``((left,right:1)SRSk:length,…,)``, parsed back to nodes."""
    supplier = B.table(spark, sf, "supplier")
    clade = F.concat(F.lit("(L:,R)"), B.prefixed("SRS", "s_suppkey"), F.lit(":"),
                     (F.abs("s_acctbal") / 1000).cast("string"))
    texts = supplier.groupBy(F.col("s_nationkey").cast("long").alias("tree_id")).agg(F.concat(
        F.lit("("), F.array_join(F.sort_array(F.collect_list(clade)), ","), F.lit(",out:2.5)root;")).alias("newick"))
    nodes = T.parse_newick(texts)
    return B.rounded(nodes.groupBy("tree_id").agg(
        F.count(F.lit(1)).alias("nodes"), F.sum("branch_length").alias("total")), 5)


NATIONS = """np AS (
  SELECT 'SRS' || l_suppkey AS sample_id, 'NATION_' || c_nationkey AS taxon_id
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
  GROUP BY ALL)"""


@query("phylo_similarity", f"""WITH {B.NATION_TREE}, {NATIONS}, pt AS (
  SELECT a, b, d FROM patristic UNION ALL SELECT name, name, 0.0 FROM leaf WHERE name NOT IN (SELECT a FROM patristic WHERE a = b)),
near AS (
  SELECT x.sample_id AS a, y.sample_id AS b, x.taxon_id, min(CASE WHEN x.taxon_id = y.taxon_id THEN 0 ELSE d END) AS d
  FROM np x JOIN pt ON pt.a = x.taxon_id JOIN np y ON y.taxon_id = pt.b WHERE x.sample_id <> y.sample_id GROUP BY 1, 2, 3),
oneway AS (SELECT a, b, avg(d) AS d FROM near GROUP BY 1, 2)
SELECT x.a, x.b, round(exp(-0.5 * (x.d + y.d)), 6) AS similarity FROM oneway x JOIN oneway y ON x.a = y.b AND x.b = y.a WHERE x.a < x.b""")
def phylo_similarity(spark, sf):
    held = B.table(spark, sf, "lineitem").join(B.table(spark, sf, "orders"), F.col("l_orderkey") == F.col("o_orderkey")).join(
        B.table(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    profile = held.groupBy(B.prefixed("SRS", "l_suppkey").alias("sample_id"),
                           B.prefixed("NATION_", "c_nationkey").alias("taxon_id")).agg(
        F.sum("l_quantity").alias("n"))
    tree = B.nation_tree(spark, sf)
    known = T.leaves(tree).select(F.col("name").alias("taxon_id"))
    return B.rounded(D.phylogenetic_similarity(profile, T.patristic(tree), known))


# --- graph ------------------------------------------------------------------------------

GRAPH = f"""{PAIRS}, sim AS (
  SELECT a, b, s / (ka + kb - s) AS j FROM shared JOIN allpairs USING (a, b)),
edges AS (SELECT a, b, j AS weight FROM sim WHERE j > 0)"""


def _edges(spark, sf):
    pairs = D.co_occurrence(B.profile(spark, sf))
    return G.similarity_graph(pairs.select("a", "b", C.jaccard_from_sizes("n_shared", "n_a", "n_b").alias("similarity")))


@query("similarity_graph", f"WITH {GRAPH} SELECT a, b, round(weight, 6) AS weight FROM edges")
def similarity_graph(spark, sf):
    return B.rounded(_edges(spark, sf))


LINKS = """e AS (
  SELECT DISTINCT 'C' || o_custkey AS a, 'P' || CAST(floor(o_totalprice) AS BIGINT) AS b FROM orders),
both_ways AS (SELECT a AS u, b AS v FROM e UNION ALL SELECT b, a FROM e),
walk AS (SELECT u, u AS c FROM both_ways UNION SELECT b.v, w.c FROM walk w JOIN both_ways b ON w.u = b.u),
named AS (SELECT u AS id, min(c) AS component FROM walk GROUP BY 1)"""


def _linked(spark, sf):
    """Customers linked by whole prices that both have paid."""
    e = B.table(spark, sf, "orders").select(
        B.prefixed("C", "o_custkey").alias("a"),
        F.concat(F.lit("P"), F.floor("o_totalprice").cast("string")).alias("b")).distinct()
    nodes = e.select(F.col("a").alias("id")).unionByName(e.select(F.col("b").alias("id"))).distinct()
    return G.components(nodes, e)


@query("components", f"WITH RECURSIVE {LINKS} SELECT id, component FROM named")
def components(spark, sf):
    return _linked(spark, sf)


@query("component_sizes", f"WITH RECURSIVE {LINKS} SELECT component, count(*) AS size FROM named GROUP BY 1")
def component_sizes(spark, sf):
    return G.component_sizes(_linked(spark, sf))


CUT = f"""WITH {GRAPH}, {B.split_sql()}, cut AS (
  SELECT a, b, weight FROM edges JOIN split x ON x.sample_id = a JOIN split y ON y.sample_id = b WHERE x.label <> y.label)"""


def _cut(spark, sf):
    labels = B.split(spark, sf).select(F.col("sample_id").alias("id"), "label")
    return G.cut_edges(_edges(spark, sf), labels, "Train", "Test")


@query("cut_weights", CUT + """ SELECT count(*) AS n, round(avg(weight), 6) AS mean, round(max(weight), 6) AS max,
  round(min(weight), 6) AS min, round(median(weight), 6) AS median FROM cut""")
def cut_weights(spark, sf):
    return B.rounded(G.cut_weights(_cut(spark, sf)))


@query("cut_histogram", CUT + """ SELECT CAST(least(floor((weight - (SELECT min(weight) FROM cut)) * 20
  / ((SELECT max(weight) FROM cut) - (SELECT min(weight) FROM cut))), 19) AS INTEGER) AS bin, count(*) AS n FROM cut GROUP BY 1""")
def cut_histogram(spark, sf):
    return G.cut_histogram(_cut(spark, sf))


@query("fiedler")
def fiedler(spark, sf):
    return B.rounded(G.fiedler_vector(_edges(spark, sf)), 5)


# --- ordination -----------------------------------------------------------------------

@query("pcoa")
def pcoa(spark, sf):
    coordinates, _ = O.pcoa(D.sample_distances(B.profile(spark, sf), "jensen_shannon"), 2)
    return B.rounded(coordinates.select("id", F.col("pc")[0].alias("PC1"), F.col("pc")[1].alias("PC2")), 5)


@query("pcoa_explained")
def pcoa_explained(spark, sf):
    _, explained = O.pcoa(D.sample_distances(B.profile(spark, sf), "bray_curtis"), 2)
    return B.rounded(explained, 5)


@query("missing_embeddings", "SELECT DISTINCT p_brand AS taxon_id FROM part WHERE p_brand >= 'Brand#2'")
def missing_embeddings(spark, sf):
    coordinates = B.table(spark, sf, "part").where("p_brand < 'Brand#2'").groupBy(F.col("p_brand").alias("id")).agg(
        F.array(F.avg("p_size")).alias("pc"))
    taxa = B.table(spark, sf, "part").select(F.col("p_brand").alias("taxon_id")).distinct()
    return O.offline_embeddings(taxa, coordinates)[1]


# Suppliers as points of a plane: their principal coordinates have a closed form,
# the points turned to their main axis, each axis with its largest entry positive.
POINTS = """pt AS (
  SELECT 'SRS' || s_suppkey AS id, s_acctbal / 1000 - avg(s_acctbal / 1000) OVER () AS x, s_nationkey / 5 - avg(s_nationkey / 5) OVER () AS y FROM supplier),
turn AS (SELECT 0.5 * atan2(2 * sum(x * y), sum(x * x) - sum(y * y)) AS t FROM pt),
raw AS (SELECT id, x * cos(t) + y * sin(t) AS u, y * cos(t) - x * sin(t) AS v FROM pt, turn),
pc AS (
  SELECT id, u * (SELECT sign(arg_max(u, (round(abs(u), 9), id))) FROM raw) AS p1, v * (SELECT sign(arg_max(v, (round(abs(v), 9), id))) FROM raw) AS p2 FROM raw)"""


def _plane(spark, sf):
    """Euclidean distances of the points, from their inner products."""
    from taxaspark.operators.tiles import tiled_pairs
    s = B.table(spark, sf, "supplier").select(
        B.prefixed("SRS", "s_suppkey").alias("id"), (F.col("s_acctbal") / 1000).alias("px"), (F.col("s_nationkey") / 5).alias("py"))
    rows = s.select("id", F.explode(F.create_map(F.lit("x"), "px", F.lit("y"), "py")).alias("key", "x"),
                    (F.col("px") * F.col("px") + F.col("py") * F.col("py")).alias("w"))
    pairs = tiled_pairs(rows, term="dot")
    return pairs.select("a", "b", F.sqrt(F.greatest(F.col("wa") + F.col("wb") - 2 * F.col("s"), F.lit(0.0))).alias("d"))


@query("pcoa_plane", f"WITH {POINTS} SELECT id, round(p1, 4) + 0.0 AS \"PC1\", round(p2, 4) + 0.0 AS \"PC2\" FROM pc")
def pcoa_plane(spark, sf):
    coordinates, _ = O.pcoa(_plane(spark, sf), 2)
    return B.rounded(coordinates.select("id", F.col("pc")[0].alias("PC1"), F.col("pc")[1].alias("PC2")), 4)


@query("pcoa_plane_explained", f"""WITH {POINTS}, ss AS (SELECT sum(p1 * p1) AS a, sum(p2 * p2) AS b FROM pc)
SELECT 1 AS axis, round(a, 4) AS eigenvalue, round(a / (a + b), 6) AS proportion FROM ss
UNION ALL SELECT 2, round(b, 4), round(b / (a + b), 6) FROM ss""")
def pcoa_plane_explained(spark, sf):
    _, explained = O.pcoa(_plane(spark, sf), 2)
    return B.rounded(B.rounded(explained, 4, "eigenvalue"), 6, "proportion")


@query("split_pcoa_plane", f"""WITH {POINTS}
SELECT id, round(p1, 4) + 0.0 AS value, CASE WHEN p1 < (SELECT quantile_cont(p1, 0.2) FROM pc) THEN 'Test'
  WHEN p1 >= (SELECT quantile_cont(p1, 0.3) FROM pc) THEN 'Train' ELSE 'Excluded' END AS label FROM pc""")
def split_pcoa_plane(spark, sf):
    return B.rounded(L.split_pcoa(_plane(spark, sf), 0.7, 0.2, train_is_left=False), 4)


@query("offline_embeddings", f"""WITH {POINTS}
SELECT id AS taxon_id, round(p1, 4) + 0.0 AS x, round(p2, 4) + 0.0 AS y FROM pc UNION ALL SELECT n_name, NULL, NULL FROM nation""")
def offline_embeddings(spark, sf):
    """Principal coordinates of the suppliers, set against a list that names nations too: null off the coordinates."""
    coordinates, _ = O.pcoa(_plane(spark, sf), 2)
    taxa = B.table(spark, sf, "supplier").select(B.prefixed("SRS", "s_suppkey").alias("taxon_id")).unionByName(
        B.table(spark, sf, "nation").select(F.col("n_name").alias("taxon_id")))
    table, _ = O.offline_embeddings(taxa, coordinates)
    return B.rounded(table.select("taxon_id", F.get("vec", F.lit(0)).alias("x"), F.get("vec", F.lit(1)).alias("y")), 4)


# --- splits ---------------------------------------------------------------------------

@query("split_random", f"WITH {B.split_sql()} SELECT sample_id, project, label FROM split")
def split_random(spark, sf):
    return B.split(spark, sf)


@query("split_per_project", """WITH p AS (
  SELECT 'SRS' || s_suppkey AS sample_id, 'PRJ' || s_nationkey AS project,
    row_number() OVER (PARTITION BY s_nationkey ORDER BY md5('3|SRS' || s_suppkey)) - 1 AS pos, count(*) OVER (PARTITION BY s_nationkey) AS k FROM supplier)
SELECT sample_id, project, CASE WHEN pos < floor(k * 0.8::DOUBLE) THEN 'Train' ELSE 'Test' END AS label FROM p""")
def split_per_project(spark, sf):
    return L.split_per_project(B.samples(spark, sf).select("sample_id", "project"), 3)


@query("split_greedy_projects", """WITH n AS (SELECT 'PRJ' || s_nationkey AS project, count(*) AS k FROM supplier GROUP BY 1),
w AS (SELECT project, coalesce(sum(k) OVER (ORDER BY k DESC, project ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM n)
SELECT 'SRS' || s_suppkey AS sample_id, project,
  CASE WHEN before < floor((SELECT count(*) FROM supplier) * 0.8::DOUBLE) THEN 'Train' ELSE 'Test' END AS label
FROM supplier JOIN w ON project = 'PRJ' || s_nationkey""")
def split_greedy_projects(spark, sf):
    return L.split_greedy_projects(B.samples(spark, sf).select("sample_id", "project"))


@query("split_leave_one_out", """SELECT f.project AS fold, 'SRS' || s_suppkey AS sample_id,
  CASE WHEN f.project = 'PRJ' || s_nationkey THEN 'Test' ELSE 'Train' END AS label
FROM supplier CROSS JOIN (SELECT DISTINCT 'PRJ' || s_nationkey AS project FROM supplier) f""")
def split_leave_one_out(spark, sf):
    return L.split_leave_one_out(B.samples(spark, sf).select("sample_id", "project")).select("fold", "sample_id", "label")


@query("split_restricted", f"""WITH {B.split_sql()} SELECT sample_id, project, label FROM split WHERE project IN ('PRJ1', 'PRJ2', 'PRJ3', 'PRJ15')""")
def split_restricted(spark, sf):
    return L.restrict_split(B.split(spark, sf), ["PRJ1", "PRJ2", "PRJ3", "PRJ15"])


@query("split_sizes", f"""WITH {B.split_sql()} SELECT count(*) AS n_total, count(*) FILTER (label = 'Train') AS n_train,
  count(*) FILTER (label = 'Test') AS n_test, round(count(*) FILTER (label = 'Train') / count(*) FILTER (label = 'Test'), 6) AS ratio FROM split""")
def split_sizes(spark, sf):
    return B.rounded(L.split_sizes(B.split(spark, sf)))


@query("tail_split", """WITH v AS (SELECT 'SRS' || c_custkey AS id, c_acctbal AS value FROM customer)
SELECT id, value, CASE WHEN value < (SELECT quantile_cont(value, 0.2) FROM v) THEN 'Test'
  WHEN value >= (SELECT quantile_cont(value, 0.3) FROM v) THEN 'Train' ELSE 'Excluded' END AS label FROM v""")
def tail_split(spark, sf):
    values = B.table(spark, sf, "customer").select(B.prefixed("SRS", "c_custkey").alias("id"), F.col("c_acctbal").alias("value"))
    return L.tail_split(values, 0.2, 0.3, "Test", "Train")


@query("label_coordinates", f"""WITH {B.split_sql()}, {B.SAMPLES}
SELECT 'SRS' || c_custkey AS id, c_acctbal AS x, coalesce(label, 'Excluded') AS label, region
FROM customer LEFT JOIN split ON split.sample_id = 'SRS' || c_custkey LEFT JOIN samples ON samples.sample_id = 'SRS' || c_custkey""")
def label_coordinates(spark, sf):
    split = B.split(spark, sf)
    coordinates = B.table(spark, sf, "customer").select(B.prefixed("SRS", "c_custkey").alias("id"), F.col("c_acctbal").alias("x"))
    return L.label_coordinates(
        coordinates, split.where("label = 'Train'"), split.where("label = 'Test'"),
        B.samples(spark, sf).select("sample_id", "region")).select("id", "x", "label", "region")


@query("split_pcoa")
def split_pcoa(spark, sf):
    distances = D.sample_distances(B.profile(spark, sf), "jensen_shannon")
    samples = B.samples(spark, sf).select("sample_id", "project")
    return L.train_test_split(samples, 0.8, 0.2, "pcoa", distances=distances, train_is_left=False)


@query("split_spectral")
def split_spectral(spark, sf):
    distances = D.sample_distances(B.profile(spark, sf), "jaccard")
    samples = B.samples(spark, sf).select("sample_id", "project")
    return L.train_test_split(samples, 0.7, 0.2, "spectral-mincut", distances=distances)


# Suppliers of a region in two groups, near inside and far across: the Fiedler vector of two cliques
# of p and q nodes is constant on each, sqrt(q / pn) and -sqrt(p / qn), the smaller one positive.
@query("split_spectral_cliques", """WITH s AS (
  SELECT 'SRS' || s_suppkey AS id, n_regionkey AS region, s_suppkey % 3 = 0 AS side FROM supplier JOIN nation ON s_nationkey = n_nationkey),
r AS (SELECT *, min(id) OVER (PARTITION BY region) AS component, count(*) OVER (PARTITION BY region) AS n,
        count(*) OVER (PARTITION BY region, side) AS own, arg_max(side, id) OVER (PARTITION BY region) AS last FROM s),
v AS (SELECT id, component, CASE WHEN n > 5 THEN sqrt((n - own) / (own * n)) * CASE WHEN 2 * own < n OR (2 * own = n AND side = last) THEN 1 ELSE -1 END END AS value FROM r)
SELECT id, component, round(value, 5) + 0.0 AS value, CASE WHEN value IS NULL THEN 'Train'
  WHEN value < quantile_cont(value, 0.2) OVER w THEN 'Test' WHEN value >= quantile_cont(value, 0.3) OVER w THEN 'Train' ELSE 'Excluded' END AS label
FROM v WINDOW w AS (PARTITION BY component)""")
def split_spectral_cliques(spark, sf):
    from taxaspark.operators.tiles import tiled_pairs
    s = B.table(spark, sf, "supplier").join(B.table(spark, sf, "nation"), F.col("s_nationkey") == F.col("n_nationkey")).select(
        B.prefixed("SRS", "s_suppkey").alias("id"), F.col("n_regionkey").cast("string").alias("key"), F.lit(1.0).alias("x"),
        (F.col("s_suppkey") % 3 == 0).cast("double").alias("w"))
    pairs = tiled_pairs(s, term="shared", all_pairs=True)
    distances = pairs.select("a", "b", F.when(F.col("s") == 0, 1.0).when(F.col("wa") == F.col("wb"), 0.1).otherwise(0.9).alias("d"))
    return B.rounded(L.split_spectral(distances, 0.7, 0.2), 5)
