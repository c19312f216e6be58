"""The star-schema tables read as domain tables, in Spark and in SQL.

sample = supplier, project = nation, taxon = part, count = summed quantity;
second profile: sample = user, taxon = event type; results = orders;
marker vectors = embeddings; tree = root, region, nation, supplier.
"""

from pyspark.sql import functions as F

from taxaspark.lineage import materialize
from taxaspark.operators import profile as P, sequences as Q, split as L


def table(spark, sf, name):
    return spark.read.parquet(f"{sf}/{name}.parquet")


def prefixed(prefix, column):
    return F.concat(F.lit(prefix), F.col(column).cast("string"))


def rounded(df, digits=6, *columns):
    """Round the named columns (all doubles by default); ``+ 0.0`` turns −0 into 0."""
    kinds = dict(df.dtypes)
    names = columns or [c for c, k in kinds.items() if k == "double"]
    return df.select(*[(F.round(c, digits) + F.lit(0.0)).alias(c) if c in names else F.col(c) for c in df.columns])


# --- counts, samples, projects --------------------------------------------------

def counts(spark, sf):
    lines = table(spark, sf, "lineitem").groupBy("l_suppkey", "l_partkey").agg(
        F.sum("l_quantity").cast("bigint").alias("n"))
    supplier = table(spark, sf, "supplier").select("s_suppkey", "s_nationkey")
    return lines.join(supplier, F.col("l_suppkey") == F.col("s_suppkey")).select(
        prefixed("PRJ", "s_nationkey").alias("project"), prefixed("SRS", "l_suppkey").alias("sample_id"),
        prefixed("ASV", "l_partkey").alias("taxon_id"), "n")


COUNTS = """counts AS (
  SELECT 'PRJ' || s_nationkey AS project, 'SRS' || l_suppkey AS sample_id, 'ASV' || l_partkey AS taxon_id,
         CAST(sum(l_quantity) AS BIGINT) AS n
  FROM lineitem JOIN supplier ON l_suppkey = s_suppkey GROUP BY ALL)"""


def profile(spark, sf):
    return P.relative_abundance(counts(spark, sf))


PROFILE = COUNTS + """, profile AS (
  SELECT sample_id, taxon_id, n / sum(n) OVER (PARTITION BY sample_id) AS rel_abund FROM counts)"""


def samples(spark, sf):
    supplier, nation, region = (table(spark, sf, t) for t in ("supplier", "nation", "region"))
    return supplier.join(nation, F.col("s_nationkey") == F.col("n_nationkey")).join(
        region, F.col("n_regionkey") == F.col("r_regionkey")).select(
        prefixed("SRS", "s_suppkey").alias("sample_id"), prefixed("PRJ", "s_nationkey").alias("project"),
        F.col("n_name").alias("iso"), F.col("r_name").alias("region"),
        F.when(F.col("s_acctbal") >= 2000, "Illumina MiSeq").otherwise("Illumina HiSeq").alias("instrument"),
        "s_acctbal")


SAMPLES = """samples AS (
  SELECT 'SRS' || s_suppkey AS sample_id, 'PRJ' || s_nationkey AS project, n_name AS iso, r_name AS region,
         CASE WHEN s_acctbal >= 2000 THEN 'Illumina MiSeq' ELSE 'Illumina HiSeq' END AS instrument, s_acctbal
  FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"""


def projects(spark, sf):
    nation, region = table(spark, sf, "nation"), table(spark, sf, "region")
    return nation.join(region, F.col("n_regionkey") == F.col("r_regionkey")).select(
        prefixed("PRJ", "n_nationkey").alias("project"),
        F.when(F.col("r_name") == "ASIA", "disease").otherwise("healthy").alias("condition"),
        F.when(F.col("r_name") == "AFRICA", "children").otherwise("adults").alias("subjects"),
        F.when(F.col("n_nationkey") < 12, "v4").otherwise("v3-v4").alias("amplicon"),
        (250 + F.col("n_nationkey") * 2.5).alias("avg_length"))


PROJECTS = """projects AS (
  SELECT 'PRJ' || n_nationkey AS project, CASE WHEN r_name = 'ASIA' THEN 'disease' ELSE 'healthy' END AS condition,
         CASE WHEN r_name = 'AFRICA' THEN 'children' ELSE 'adults' END AS subjects,
         CASE WHEN n_nationkey < 12 THEN 'v4' ELSE 'v3-v4' END AS amplicon,
         CAST(250 + n_nationkey * 2.5 AS DOUBLE) AS avg_length
  FROM nation JOIN region ON n_regionkey = r_regionkey)"""


def brand_profile(spark, sf):
    """Profile over brands, for operators that take a taxon-distance table."""
    lines = table(spark, sf, "lineitem").join(table(spark, sf, "part"), F.col("l_partkey") == F.col("p_partkey"))
    return P.relative_abundance(lines.groupBy(
        prefixed("SRS", "l_suppkey").alias("sample_id"), F.col("p_brand").alias("taxon_id")).agg(
        F.sum("l_quantity").alias("n")))


BRAND_PROFILE = """bcounts AS (
  SELECT 'SRS' || l_suppkey AS sample_id, p_brand AS taxon_id, sum(l_quantity) AS n
  FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY ALL),
bprofile AS (SELECT sample_id, taxon_id, n / sum(n) OVER (PARTITION BY sample_id) AS rel_abund FROM bcounts)"""


# --- sequences --------------------------------------------------------------------

def sequences(spark, sf):
    """Gapped 32-symbol sequences; equal name and brand give equal sequences."""
    part = table(spark, sf, "part")
    return part.select(prefixed("ASV", "p_partkey").alias("taxon_id"),
                       F.translate(F.md5(F.concat("p_name", "p_brand")), "01", "--").alias("aln"))


SEQUENCES = """sequences AS (
  SELECT 'ASV' || p_partkey AS taxon_id, translate(md5(p_name || p_brand), '01', '--') AS aln FROM part)"""


def brand_distances(spark, sf):
    brands = table(spark, sf, "part").select(F.col("p_brand").alias("taxon_id")).distinct()
    return Q.hamming_pairs(brands.withColumn("aln", F.md5("taxon_id")))


BRAND_DISTANCES = """brands AS (SELECT DISTINCT p_brand AS b FROM part),
bdist AS (SELECT x.b AS a, y.b AS b, CAST(hamming(md5(x.b), md5(y.b)) AS DOUBLE) AS d FROM brands x, brands y)"""


# --- splits and neighbours -----------------------------------------------------------

def split(spark, sf, seed=7):
    return L.split_random(samples(spark, sf).select("sample_id", "project"), 0.8, 0.2, seed)


def split_sql(seed=7, name="split"):
    return f"""placed_{name} AS (
  SELECT 'SRS' || s_suppkey AS sample_id, 'PRJ' || s_nationkey AS project,
         row_number() OVER (ORDER BY md5('{seed}|SRS' || s_suppkey)) - 1 AS pos, count(*) OVER () AS total
  FROM supplier),
{name} AS (
  SELECT sample_id, project, CASE WHEN pos < floor(total * 0.8::DOUBLE) THEN 'Train'
    WHEN pos < floor(total * 0.8::DOUBLE) + floor(total * 0.2::DOUBLE) THEN 'Test' ELSE 'Excluded' END AS label
  FROM placed_{name})"""


def train_test(spark, sf):
    """Training and test profiles; only parts that are not LARGE train."""
    labels = split(spark, sf)
    valid = table(spark, sf, "part").where("p_type <> 'LARGE'").select(prefixed("ASV", "p_partkey").alias("taxon_id"))
    c = counts(spark, sf)
    pick = lambda label: c.join(labels.where(F.col("label") == label).select("sample_id"), "sample_id", "left_semi")
    train, test = P.relative_abundance(pick("Train"), valid), P.relative_abundance(pick("Test"))
    # A split is written once and read by every predictor.
    return materialize(train, "train"), materialize(test, "test")


TRAIN_TEST = COUNTS + ", " + split_sql() + """, valid AS (
  SELECT 'ASV' || p_partkey AS taxon_id FROM part WHERE p_type <> 'LARGE'),
train AS (
  SELECT sample_id, taxon_id, n / sum(n) OVER (PARTITION BY sample_id) AS rel_abund
  FROM counts SEMI JOIN valid USING (taxon_id) WHERE sample_id IN (SELECT sample_id FROM split WHERE label = 'Train')),
test AS (
  SELECT sample_id, taxon_id, n / sum(n) OVER (PARTITION BY sample_id) AS rel_abund
  FROM counts WHERE sample_id IN (SELECT sample_id FROM split WHERE label = 'Test'))"""


def nn_lookup(spark, sf, train, test):
    """Nearest training taxon of every test taxon."""
    aligned = sequences(spark, sf)
    pick = lambda p: aligned.join(p.select("taxon_id").distinct(), "taxon_id", "left_semi")
    return materialize(Q.aligned_nn(pick(test), pick(train)), "nn")


NN = TRAIN_TEST + ", " + SEQUENCES + """, nnpairs AS (
  SELECT q.taxon_id AS query, d.taxon_id AS answer, hamming(q.aln, d.aln) AS h
  FROM (SELECT * FROM sequences SEMI JOIN test USING (taxon_id)) q,
       (SELECT * FROM sequences SEMI JOIN train USING (taxon_id)) d),
nn AS (
  SELECT query, answer, 1 - h / 32.0::DOUBLE AS similarity FROM nnpairs
  QUALIFY row_number() OVER (PARTITION BY query ORDER BY h, answer) = 1)"""


def project_sequences(spark, sf, p):
    """Sequences of a profile's taxa per project of its samples."""
    labels = samples(spark, sf).select("sample_id", "project")
    held = p.join(labels, "sample_id").select("project", "taxon_id").distinct()
    return held.join(sequences(spark, sf), "taxon_id")


def nn_within_project(spark, sf, train, test):
    found = Q.aligned_nn(project_sequences(spark, sf, test), project_sequences(spark, sf, train), by="project")
    return materialize(found, "nn-project")


NN_WITHIN = NN + """, tseq AS (
  SELECT DISTINCT project, taxon_id, aln FROM test JOIN split USING (sample_id) JOIN sequences USING (taxon_id)),
dseq AS (
  SELECT DISTINCT project, taxon_id, aln FROM train JOIN split USING (sample_id) JOIN sequences USING (taxon_id)),
nnw AS (
  SELECT t.project, t.taxon_id AS query, d.taxon_id AS answer, 1 - hamming(t.aln, d.aln) / 32.0::DOUBLE AS similarity
  FROM tseq t JOIN dseq d ON t.project = d.project
  QUALIFY row_number() OVER (PARTITION BY t.project, t.taxon_id ORDER BY hamming(t.aln, d.aln), d.taxon_id) = 1),
looked AS (
  SELECT query, answer, similarity FROM (
    SELECT query, answer, similarity, 0 AS src FROM nnw UNION ALL SELECT query, answer, similarity, 1 FROM nn)
  QUALIFY row_number() OVER (PARTITION BY query ORDER BY similarity DESC, src, answer) = 1)"""


# --- tree ------------------------------------------------------------------------------

def tree(spark, sf):
    """root 0; regions 1…; nations 100…; suppliers 1000…."""
    region, nation, supplier = (table(spark, sf, t) for t in ("region", "nation", "supplier"))
    node = lambda i, parent, name, length: [
        i.cast("long").alias("node_id"), parent.cast("long").alias("parent_id"), name.alias("name"),
        length.cast("double").alias("branch_length")]
    root = region.agg(F.min("r_regionkey").alias("k")).select(
        *node(F.col("k") * 0, F.lit(None), F.lit("root"), F.lit(0.0)))
    return root.unionByName(region.select(*node(
        F.col("r_regionkey") + 1, F.lit(0), F.col("r_name"), F.col("r_regionkey") + 1))
    ).unionByName(nation.select(*node(
        F.col("n_nationkey") + 100, F.col("n_regionkey") + 1, F.col("n_name"), (F.col("n_nationkey") + 1) / 4))
    ).unionByName(supplier.select(*node(
        F.col("s_suppkey") + 1000, F.col("s_nationkey") + 100, prefixed("SRS", "s_suppkey"),
        F.abs("s_acctbal") / 1000)))


TREE = """tree AS (
  SELECT 0::BIGINT AS node_id, NULL::BIGINT AS parent_id, 'root' AS name, 0.0::DOUBLE AS branch_length
  UNION ALL SELECT r_regionkey + 1, 0, r_name, r_regionkey + 1 FROM region
  UNION ALL SELECT n_nationkey + 100, n_regionkey + 1, n_name, (n_nationkey + 1) / 4 FROM nation
  UNION ALL SELECT s_suppkey + 1000, s_nationkey + 100, 'SRS' || s_suppkey, abs(s_acctbal) / 1000 FROM supplier),
up AS (
  WITH RECURSIVE u AS (
    SELECT node_id, node_id AS ancestor_id, 0 AS steps, 0.0::DOUBLE AS length FROM tree
    UNION ALL SELECT u.node_id, t.parent_id, steps + 1, length + t.branch_length
    FROM u JOIN tree t ON u.ancestor_id = t.node_id WHERE t.parent_id IS NOT NULL)
  SELECT * FROM u),
depths AS (SELECT node_id, max(steps) AS depth, max_by(length, steps) AS root_dist FROM up GROUP BY node_id),
leaf AS (
  SELECT node_id, name, root_dist FROM tree JOIN depths USING (node_id)
  WHERE node_id NOT IN (SELECT parent_id FROM tree WHERE parent_id IS NOT NULL)),
lca AS (
  SELECT x.node_id AS a, y.node_id AS b, max(d.root_dist) AS r
  FROM up x JOIN up y ON x.ancestor_id = y.ancestor_id JOIN depths d ON d.node_id = x.ancestor_id
  SEMI JOIN leaf lx ON lx.node_id = x.node_id SEMI JOIN leaf ly ON ly.node_id = y.node_id
  GROUP BY x.node_id, y.node_id),
patristic AS (
  SELECT x.name AS a, y.name AS b, x.root_dist + y.root_dist - 2 * r AS d
  FROM lca JOIN leaf x ON lca.a = x.node_id JOIN leaf y ON lca.b = y.node_id)"""


def nation_tree(spark, sf):
    """The same tree down to nations, so that nations are leaves."""
    return tree(spark, sf).where("node_id < 1000")


NATION_TREE = TREE.replace(
    "\n  UNION ALL SELECT s_suppkey + 1000, s_nationkey + 100, 'SRS' || s_suppkey, abs(s_acctbal) / 1000 FROM supplier", "")


# --- results ------------------------------------------------------------------------------

def results(spark, sf):
    """Orders as evaluation rows; one method has no seed, one neither seed nor split."""
    o = table(spark, sf, "orders")
    method = F.col("o_orderpriority")
    return o.select(
        method.alias("Method"), prefixed("SRS", "o_custkey").alias("SampleId"),
        F.when(~method.isin("4-NOT SPECIFIED", "5-LOW"), F.year("o_orderdate").cast("bigint")).alias("Seed"),
        F.when(method != "5-LOW", F.quarter("o_orderdate").cast("bigint")).alias("DataSplitSeed"),
        (F.col("o_totalprice") / 100000).alias("KL_err"))


RESULTS = """results AS (
  SELECT o_orderpriority AS "Method", 'SRS' || o_custkey AS "SampleId",
         CASE WHEN o_orderpriority NOT IN ('4-NOT SPECIFIED', '5-LOW') THEN year(o_orderdate) END AS "Seed",
         CASE WHEN o_orderpriority <> '5-LOW' THEN quarter(o_orderdate) END AS "DataSplitSeed",
         o_totalprice / 100000 AS "KL_err"
  FROM orders)"""


def named_results(spark, sf):
    """Orders as evaluation rows of named models, with parameter counts and an ablation flag."""
    o = table(spark, sf, "orders")
    names = {"1-URGENT": "dnabert-s__epc_pool_scaling64", "2-HIGH": "dnabert-s__epc_nopool_scaling64",
             "3-MEDIUM": "evo2_7b_hyena10__epc_pool_scaling64_NO_MLP",
             "4-NOT SPECIFIED": "evo2_7b_hyena10__epc_nopool_3_kl"}
    method = F.lit("evo2_7b_hyena10__set_transformer_d64")
    for priority, name in names.items():
        method = F.when(F.col("o_orderpriority") == priority, name).otherwise(method)
    return o.select(
        method.alias("Method"), prefixed("SRS", "o_custkey").alias("SampleId"),
        F.year("o_orderdate").cast("bigint").alias("Seed"), F.quarter("o_orderdate").cast("bigint").alias("DataSplitSeed"),
        (F.col("o_orderstatus") == "F").alias("Ablated"), (F.col("o_totalprice") / 100000).alias("KL_err"),
        (F.col("o_custkey") + 1).cast("double").alias("NumParameters"))


NAMED_RESULTS = """nresults AS (
  SELECT CASE o_orderpriority WHEN '1-URGENT' THEN 'dnabert-s__epc_pool_scaling64'
           WHEN '2-HIGH' THEN 'dnabert-s__epc_nopool_scaling64'
           WHEN '3-MEDIUM' THEN 'evo2_7b_hyena10__epc_pool_scaling64_NO_MLP'
           WHEN '4-NOT SPECIFIED' THEN 'evo2_7b_hyena10__epc_nopool_3_kl'
           ELSE 'evo2_7b_hyena10__set_transformer_d64' END AS "Method",
         'SRS' || o_custkey AS "SampleId", year(o_orderdate) AS "Seed", quarter(o_orderdate) AS "DataSplitSeed",
         o_orderstatus = 'F' AS "Ablated", o_totalprice / 100000 AS "KL_err",
         CAST(o_custkey + 1 AS DOUBLE) AS "NumParameters"
  FROM orders)"""


# --- markers and vectors ---------------------------------------------------------------------

def markers(spark, sf):
    """Marker vectors: taxon ids are even, so that odd taxa have none."""
    return table(spark, sf, "embeddings").select(
        F.concat(F.lit("SGB"), (F.col("label") * 2).cast("string")).alias("taxon_id"),
        prefixed("m", "vec_id").alias("marker_id"), F.col("vec_id").alias("ord"), F.col("embedding").alias("vec"))


MARKERS = """markers AS (
  SELECT 'SGB' || (label * 2) AS taxon_id, 'm' || vec_id AS marker_id, vec_id AS ord, embedding AS vec FROM embeddings),
dims AS (
  SELECT taxon_id, marker_id, generate_subscripts(vec, 1) AS dim, unnest(vec)::DOUBLE AS x FROM markers),
pooled AS (SELECT taxon_id, dim, avg(x) AS x FROM dims GROUP BY ALL)"""


def line_profile(spark, sf):
    """Profile over line numbers: taxa SGB1 … SGB7, of which even ones have vectors."""
    lines = table(spark, sf, "lineitem").groupBy(
        prefixed("SRS", "l_suppkey").alias("sample_id"), prefixed("SGB", "l_linenumber").alias("taxon_id")).agg(
        F.sum("l_quantity").alias("n"))
    return P.relative_abundance(lines)


LINE_PROFILE = """lcounts AS (
  SELECT 'SRS' || l_suppkey AS sample_id, 'SGB' || l_linenumber AS taxon_id, sum(l_quantity) AS n FROM lineitem GROUP BY ALL),
lprofile AS (SELECT sample_id, taxon_id, n / sum(n) OVER (PARTITION BY sample_id) AS rel_abund FROM lcounts)"""


# --- hits --------------------------------------------------------------------------------------

def hits(spark, sf):
    """Line items as database hits of their part; identity in percent."""
    li = table(spark, sf, "lineitem")
    target = (
        F.when((F.col("l_returnflag") == "A") & (F.col("l_linestatus") == "F"), "k__Bacteria;p__Firmicutes")
        .when(F.col("l_returnflag") == "A", "Archaebacteria;x")
        .when((F.col("l_returnflag") == "R") & (F.col("l_linestatus") == "F"), " Eukarya ; y")
        .when(F.col("l_returnflag") == "R", "Virus;z").otherwise("bacteria"))
    description = (
        F.when(F.col("l_returnflag") == "A", "16S ribosomal RNA gene")
        .when(F.col("l_linestatus") == "F", "uncultured clone 16S rRNA, partial")
        .otherwise("18S ribosomal RNA 16S rRNA"))
    return li.select(
        prefixed("ASV", "l_partkey").alias("query_id"), target.alias("target"),
        (50 + F.col("l_quantity")).alias("identity"), F.col("l_linenumber").alias("hit_rank"),
        F.concat_ws(" ", description, F.col("l_orderkey").cast("string")).alias("description"))


HITS = """hits AS (
  SELECT 'ASV' || l_partkey AS query_id,
    CASE WHEN l_returnflag = 'A' AND l_linestatus = 'F' THEN 'k__Bacteria;p__Firmicutes'
         WHEN l_returnflag = 'A' THEN 'Archaebacteria;x'
         WHEN l_returnflag = 'R' AND l_linestatus = 'F' THEN ' Eukarya ; y'
         WHEN l_returnflag = 'R' THEN 'Virus;z' ELSE 'bacteria' END AS target,
    50 + l_quantity AS identity, l_linenumber AS hit_rank,
    CASE WHEN l_returnflag = 'A' THEN '16S ribosomal RNA gene'
         WHEN l_linestatus = 'F' THEN 'uncultured clone 16S rRNA, partial'
         ELSE '18S ribosomal RNA 16S rRNA' END || ' ' || l_orderkey AS description
  FROM lineitem)"""

DOMAIN = """CASE lower(trim(replace(trim(split_part(trim({0}), ';', 1)), 'k__', '')))
  WHEN 'bacteria' THEN 'Bacteria' WHEN 'archaea' THEN 'Archaea' WHEN 'archaebacteria' THEN 'Archaea'
  WHEN 'eukaryota' THEN 'Eukaryota' WHEN 'eukarya' THEN 'Eukaryota'
  WHEN '' THEN 'Unknown' ELSE 'Unknown (' || replace(trim(split_part(trim({0}), ';', 1)), 'k__', '') || ')' END"""
