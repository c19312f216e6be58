"""Queries: files written from the given tables by Spark and read back."""

from pyspark.sql import functions as F

from taxaspark.lineage import scratch_path
from taxaspark.operators.profile import marker_index
from taxaspark.plans import bind as B
from taxaspark.plans.registry import query
from taxaspark.sources import files as S


def _wide_lines(df, rows, cols, value, header, by):
    """Long rows as lines of one wide text table per group, with its header line."""
    names = df.groupBy(*by).agg(F.sort_array(F.collect_set(cols)).alias("names"))
    lines = df.groupBy(*by, rows).agg(F.map_from_entries(F.collect_list(F.struct(cols, value))).alias("cells"))
    text = lines.join(names, by).select(*by, F.concat_ws(
        "\t", F.col(rows), F.transform("names", lambda s: F.coalesce(F.col("cells")[s].cast("string"), F.lit("0")))).alias("value"))
    head = names.select(*by, F.concat_ws("\t", F.lit(header), "names").alias("value"))
    return head.unionByName(text)


@query("read_counts", f"""WITH {B.COUNTS}, {B.SAMPLES}
SELECT project, sample_id, taxon_id, n FROM counts SEMI JOIN (SELECT sample_id FROM samples WHERE s_acctbal >= 1000) s USING (sample_id) WHERE n > 0""")
def read_counts(spark, sf):
    """Wide per-project count tables, with samples that are not asked for."""
    out = _wide_lines(B.counts(spark, sf), "taxon_id", "sample_id", "n", "asv", ["project"])
    path = scratch_path(spark, "wide")
    out.write.partitionBy("project").text(path)
    lines = spark.read.text(path)
    wanted = B.samples(spark, sf).where("s_acctbal >= 1000").select("project", "sample_id")
    return S.parse_counts(lines.select("project", "value"), wanted)


@query("read_count_headers", f"WITH {B.COUNTS} SELECT DISTINCT project, sample_id FROM counts")
def read_count_headers(spark, sf):
    out = _wide_lines(B.counts(spark, sf), "taxon_id", "sample_id", "n", "asv", ["project"])
    path = scratch_path(spark, "wide")
    out.write.partitionBy("project").text(path)
    return S.parse_count_headers(spark.read.text(path).select("project", "value"))


@query("read_clade_profiles", f"""WITH {B.LINE_PROFILE}
SELECT sample_id, taxon_id || '_group' AS taxon_id, round(rel_abund, 9) AS abundance FROM lprofile""")
def read_clade_profiles(spark, sf):
    """A clade table with a genus row above every species row, which the reader leaves out."""
    p = B.line_profile(spark, sf).withColumn("share", F.round("rel_abund", 12))
    species = p.withColumn("clade", F.concat(F.lit("k__B|g__x|t__"), "taxon_id", F.lit("_group")))
    genus = p.withColumn("clade", F.concat(F.lit("k__B|g__"), "taxon_id"))
    rows = species.unionByName(genus).withColumn("one", F.lit("all"))
    out = _wide_lines(rows, "clade", "sample_id", "share", "clade_name", ["one"])
    path = scratch_path(spark, "clades")
    out.select("value").write.text(path)
    return B.rounded(S.parse_clades(spark.read.text(path).withColumn("file", F.lit("all"))), 9)


@query("read_sequences", f"WITH {B.SEQUENCES} SELECT taxon_id, replace(aln, '-', 'N') AS seq FROM sequences")
def read_sequences(spark, sf):
    path = scratch_path(spark, "sequences")
    s = B.sequences(spark, sf).select(F.concat_ws("\t", "taxon_id", F.translate("aln", "-", "N")).alias("value"))
    header = spark.range(1).select(F.lit("#OTU\tsequence").alias("value"))
    header.unionByName(s).write.text(path)
    return S.read_sequences(spark, path)


@query("fasta_round_trip", """SELECT 'D' || doc_id AS id, md5(regexp_replace(text, '[ \\t\\n\\r\\f\\v]', '', 'g')) AS seq FROM documents""")
def fasta_round_trip(spark, sf):
    """Whole document texts as records; white space inside a record is not sequence."""
    path = scratch_path(spark, "fasta")
    docs = B.table(spark, sf, "documents").select(B.prefixed("D", "doc_id").alias("taxon_id"), F.col("text").alias("seq"))
    S.write_fasta(docs, path)
    return S.read_fasta(spark, path).select("id", F.md5("seq").alias("seq"))


@query("read_hits", """SELECT 'ASV' || l_partkey AS query_id, 'k__Bacteria;' || l_returnflag AS target, 50 + l_quantity AS identity,
  CAST(l_linenumber AS INTEGER) AS align_length, l_extendedprice AS bitscore FROM lineitem WHERE l_linenumber <> 7""")
def read_hits(spark, sf):
    """Hit lines; those of line 7 are written short or as comments and must be skipped."""
    li = B.table(spark, sf, "lineitem")
    number = lambda c: F.col(c).cast("string")
    line = F.concat_ws(
        "\t", B.prefixed("ASV", "l_partkey"), F.concat(F.lit("k__Bacteria;"), "l_returnflag"),
        (50 + F.col("l_quantity")).cast("string"), number("l_linenumber"), *[F.lit(str(i)) for i in range(6)],
        F.lit("1e-30"), number("l_extendedprice"))
    short = F.when(F.col("l_returnflag") == "A", F.concat(F.lit("#"), line)).when(
        F.col("l_returnflag") == "N", F.lit("")).otherwise(F.substring_index(line, "\t", 5))
    path = scratch_path(spark, "hits")
    li.select(F.when(F.col("l_linenumber") == 7, short).otherwise(line).alias("value")).write.text(path)
    return S.read_hits(spark, path).select("query_id", "target", "identity", "align_length", "bitscore")


@query("read_align_report", """SELECT 'ASV' || p_partkey AS "QueryName", CAST(p_size + 100 AS INTEGER) AS "QueryLength", CAST(p_size AS INTEGER) AS "TemplateStart" FROM part""")
def read_align_report(spark, sf):
    path = scratch_path(spark, "report")
    B.table(spark, sf, "part").select(
        B.prefixed("ASV", "p_partkey").alias("QueryName"), (F.col("p_size") + 100).alias("QueryLength"), F.col("p_name").alias("TemplateName"),
        F.lit(1).alias("QueryStart"), F.col("p_size").alias("QueryEnd"), F.col("p_size").alias("TemplateStart"),
        (F.col("p_size") + 9).alias("TemplateEnd")).write.csv(path, sep="\t", header=True)
    return S.read_align_report(spark, path).select("QueryName", "QueryLength", "TemplateStart")


@query("nn_lookup_round_trip", """SELECT 'ASV' || l_partkey AS query, 'ASV' || l_orderkey AS answer, l_discount AS similarity FROM lineitem""")
def nn_lookup_round_trip(spark, sf):
    path = scratch_path(spark, "nn")
    S.write_nn_lookup(B.table(spark, sf, "lineitem").select(
        B.prefixed("ASV", "l_partkey").alias("query"), B.prefixed("ASV", "l_orderkey").alias("answer"),
        F.col("l_discount").alias("similarity")), path)
    return S.read_nn_lookup(spark, path)


@query("marker_index_round_trip", f"""WITH {B.MARKERS}
SELECT taxon_id, marker_id, CAST(row_number() OVER (PARTITION BY taxon_id ORDER BY ord) - 1 AS INTEGER) AS ord FROM markers""")
def marker_index_round_trip(spark, sf):
    path = scratch_path(spark, "markers")
    S.write_marker_index(B.markers(spark, sf).select("taxon_id", "marker_id", "ord"), path)
    return S.read_marker_index(spark, path)


@query("read_results", """SELECT CASE WHEN o_orderpriority = '5-LOW' THEN 'uniform' ELSE 'dnabert-s__epc_pool_kl' END AS "Method",
  CASE WHEN o_orderpriority <> '5-LOW' THEN CAST(year(o_orderdate) AS INTEGER) END AS "Seed",
  o_orderpriority <> '5-LOW' AND o_orderstatus = 'F' AS "Ablated", 'SRS' || o_custkey AS "SampleId", o_totalprice AS "KL_err" FROM orders""")
def read_results(spark, sf):
    """Result files named by method, seed and ablation."""
    low = F.col("o_orderpriority") == "5-LOW"
    stem = F.when(low, F.lit("uniform.tsv")).otherwise(F.concat(
        F.when(F.col("o_orderstatus") == "F", "ABLATED__").otherwise(""), F.lit("dnabert-s__epc_pool_kl__"),
        F.year("o_orderdate").cast("string"), F.lit(".tsv")))
    none = lambda c: F.lit(None).cast("double").alias(c)
    path = scratch_path(spark, "results")
    B.table(spark, sf, "orders").select(
        stem.alias("file"), B.prefixed("SRS", "o_custkey").alias("SampleId"), F.col("o_totalprice").alias("KL_err"),
        none("RMSL_err"), none("SpearmanCorr"), none("BrayCurtis"), none("RootJensenShannon"),
        F.lit(5).cast("bigint").alias("NumTaxa")).write.partitionBy("file").csv(path, sep="\t", header=True)
    return S.read_results(spark, path).select("Method", "Seed", "Ablated", "SampleId", "KL_err")


@query("split_round_trip", f"WITH {B.split_sql()} SELECT sample_id, project, label FROM split WHERE label <> 'Excluded'")
def split_round_trip(spark, sf):
    path = scratch_path(spark, "split")
    S.write_split(B.split(spark, sf), path)
    return S.read_split(spark, path, "sample_id string, project string, label string")


@query("marker_index_names", """WITH r AS (
  SELECT 'SGB' || l_suppkey AS taxon_id, 'SGB' || l_suppkey || '__P' || l_partkey AS marker_id,
    l_orderkey * 10 + l_linenumber AS o FROM lineitem WHERE l_returnflag <> 'R')
SELECT taxon_id, marker_id, CAST(row_number() OVER (PARTITION BY taxon_id ORDER BY o, marker_id) - 1 AS INTEGER) AS ord FROM r""")
def marker_index_names(spark, sf):
    """Line items as FASTA records, written as an index and read back; returned ones are of another kind."""
    path = scratch_path(spark, "fai")
    kind = F.when(F.col("l_returnflag") == "R", "EUK").otherwise("SGB")
    name = F.concat(kind, F.col("l_suppkey").cast("string"), F.lit("__P"), F.col("l_partkey").cast("string"))
    B.table(spark, sf, "lineitem").select(F.concat_ws(
        "\t", name, F.lit("32"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).cast("string"), F.lit("60"), F.lit("61"))).write.text(path)
    return marker_index(S.read_record_names(spark, path))


@query("embedding_shards", "SELECT CAST(count(*) AS BIGINT) AS n, CAST(count(DISTINCT vec_id) AS BIGINT) AS ids, CAST(ceil(count(*) / 64) AS BIGINT) AS shards FROM embeddings")
def embedding_shards(spark, sf):
    path = scratch_path(spark, "shards")
    S.write_embeddings_sharded(B.markers(spark, sf).select("marker_id", "vec"), path, 64)
    back = S.read_embeddings_sharded(spark, path)
    return back.agg(F.count(F.lit(1)).alias("n"), F.count_distinct("marker_id").alias("ids"), F.count_distinct("shard").alias("shards"))


@query("id_list_round_trip", "SELECT DISTINCT 'ASV' || l_partkey AS taxon_id FROM lineitem")
def id_list_round_trip(spark, sf):
    path = scratch_path(spark, "ids")
    S.write_id_list(B.table(spark, sf, "lineitem").select(B.prefixed("ASV", "l_partkey").alias("taxon_id")), path)
    return spark.read.text(path).withColumnRenamed("value", "taxon_id")


@query("metadata_round_trip", f"WITH {B.SAMPLES} SELECT sample_id AS srs, project, instrument, iso, region FROM samples")
def metadata_round_trip(spark, sf):
    path = scratch_path(spark, "metadata")
    s = B.samples(spark, sf)
    s.select(F.col("sample_id").alias("srs"), "project", F.lit("AMPLICON").alias("library_strategy"), F.lit("METAGENOMIC").alias("library_source"),
             F.lit(1).cast("bigint").alias("total_bases"), "instrument", F.col("iso").alias("geo_loc_name"), "iso", "region"
             ).write.csv(path, sep="\t", header=True)
    return S.read_sample_metadata(spark, path).select("srs", "project", "instrument", "iso", "region")


@query("project_metadata_round_trip", f"WITH {B.PROJECTS} SELECT project, condition, subjects, amplicon, avg_length FROM projects")
def project_metadata_round_trip(spark, sf):
    path = scratch_path(spark, "projects")
    B.projects(spark, sf).write.csv(path, header=True)
    return S.read_project_metadata(spark, path)


@query("write_pcoa", """SELECT 'SRS' || c_custkey AS id, round(c_acctbal, 6) AS "PC1", round(c_acctbal / 8, 6) AS "PC2",
  CASE WHEN c_acctbal < 0 THEN 'Test' ELSE 'Train' END AS label FROM customer""")
def write_pcoa(spark, sf):
    """Coordinates with their label, written and read back."""
    customer = B.table(spark, sf, "customer")
    coordinates = customer.select(
        B.prefixed("SRS", "c_custkey").alias("id"), F.array("c_acctbal", F.col("c_acctbal") / 8).alias("pc"),
        F.when(F.col("c_acctbal") < 0, "Test").otherwise("Train").alias("label"))
    explained = customer.groupBy(F.when(F.col("c_acctbal") < 0, 1).otherwise(2).alias("axis")).agg(F.avg("c_acctbal").alias("proportion"))
    path = scratch_path(spark, "pcoa")
    S.write_pcoa(coordinates, explained, path)
    back = spark.read.csv(f"{path}/coordinates", sep="\t", header=True, schema="PC1 double, PC2 double, SampleId string, label string")
    return B.rounded(back.withColumnRenamed("SampleId", "id"))
