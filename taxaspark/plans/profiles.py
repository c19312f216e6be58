"""Queries: profiles, filters, reports, validation, projections."""

from pyspark.sql import functions as F

from taxaspark.functions import columns as C
from taxaspark.lineage import materialize
from taxaspark.operators import filters as FL, hits as H, profile as P, validation as V
from taxaspark.plans import bind as B
from taxaspark.plans.registry import query


@query("relative_abundance", f"WITH {B.PROFILE} SELECT sample_id, taxon_id, round(rel_abund, 12) AS rel_abund FROM profile")
def relative_abundance(spark, sf):
    return B.rounded(B.profile(spark, sf), 12)


@query("renormalised_subset", f"""WITH {B.COUNTS}, keep AS (
  SELECT 'ASV' || p_partkey AS taxon_id FROM part WHERE p_type IN ('STANDARD', 'SMALL'))
SELECT sample_id, taxon_id, round(n / sum(n) OVER (PARTITION BY sample_id), 12) AS rel_abund
FROM counts SEMI JOIN keep USING (taxon_id)""")
def renormalised_subset(spark, sf):
    keep = B.table(spark, sf, "part").where("p_type in ('STANDARD', 'SMALL')").select(
        B.prefixed("ASV", "p_partkey").alias("taxon_id"))
    return B.rounded(P.relative_abundance(B.counts(spark, sf), keep), 12)


@query("padded_profile", f"""WITH {B.BRAND_PROFILE}, ord AS (
  SELECT b AS taxon_id, CAST(row_number() OVER (ORDER BY b) - 1 AS INTEGER) AS ord FROM (SELECT DISTINCT p_brand AS b FROM part))
SELECT s.sample_id, o.ord, round(coalesce(p.rel_abund, 0), 12) AS value
FROM (SELECT DISTINCT sample_id FROM bprofile) s CROSS JOIN ord o
LEFT JOIN bprofile p ON p.sample_id = s.sample_id AND p.taxon_id = o.taxon_id""")
def padded_profile(spark, sf):
    brands = B.table(spark, sf, "part").agg(F.sort_array(F.collect_set("p_brand")).alias("b"))
    order = brands.select(F.posexplode("b").alias("ord", "taxon_id"))
    vectors = P.padded_profile(B.brand_profile(spark, sf), order, width=4096)
    return B.rounded(vectors.select("sample_id", F.posexplode("vec").alias("ord", "value")), 12)


@query("read_depth", f"WITH {B.COUNTS} SELECT sample_id, CAST(sum(n) AS BIGINT) AS read_counts FROM counts GROUP BY 1")
def read_depth(spark, sf):
    return P.read_depth(B.counts(spark, sf))


@query("prevalence", f"""WITH {B.COUNTS}
SELECT taxon_id, CAST(sum(CASE WHEN n >= 40 THEN 1 ELSE 0 END) AS BIGINT) AS n_samples FROM counts GROUP BY 1""")
def prevalence(spark, sf):
    return P.prevalence(B.counts(spark, sf), 40)


@query("richness", f"WITH {B.COUNTS} SELECT sample_id, count(*) AS n_taxa FROM counts WHERE n > 0 GROUP BY 1")
def richness(spark, sf):
    return P.richness(B.counts(spark, sf))


@query("max_richness", f"""WITH {B.COUNTS}
SELECT max(k) AS max_taxa FROM (SELECT count(*) AS k FROM counts WHERE n > 0 GROUP BY sample_id)""")
def max_richness(spark, sf):
    return P.max_richness(B.counts(spark, sf))


BANDED = B.COUNTS + ", " + B.SAMPLES + """, depth AS (
  SELECT sample_id, CAST(sum(n) AS BIGINT) AS read_counts FROM counts GROUP BY 1),
banded AS (
  SELECT s.*, read_counts FROM samples s JOIN depth USING (sample_id)
  QUALIFY read_counts BETWEEN quantile_cont(read_counts, 0.05) OVER (PARTITION BY project)
                          AND quantile_cont(read_counts, 0.95) OVER (PARTITION BY project))"""


@query("depth_band", f"""WITH {BANDED} SELECT sample_id, project, read_counts FROM banded""")
def depth_band(spark, sf):
    attached = FL.attach_depth(B.samples(spark, sf), B.counts(spark, sf))
    return FL.depth_band(attached).select("sample_id", "project", "read_counts")


@query("depth_band_by_instrument", f"""WITH {B.COUNTS}, {B.SAMPLES}, depth AS (
  SELECT sample_id, CAST(sum(n) AS BIGINT) AS read_counts FROM counts GROUP BY 1)
SELECT sample_id, region, instrument, read_counts FROM samples JOIN depth USING (sample_id)
QUALIFY read_counts BETWEEN quantile_cont(read_counts, 0.05) OVER (PARTITION BY region, instrument)
                        AND quantile_cont(read_counts, 0.95) OVER (PARTITION BY region, instrument)""")
def depth_band_by_instrument(spark, sf):
    attached = FL.attach_depth(B.samples(spark, sf), B.counts(spark, sf))
    return FL.depth_band(attached, by=("region", "instrument")).select("sample_id", "region", "instrument", "read_counts")


@query("depth_summary", f"""WITH {B.COUNTS}, {B.SAMPLES}, depth AS (
  SELECT sample_id, CAST(sum(n) AS DOUBLE) AS x FROM counts GROUP BY 1)
SELECT project, count(x) AS n, round(avg(x), 6) AS mean, round(stddev_samp(x), 6) AS std, min(x) AS min, max(x) AS max,
  round(quantile_cont(x, 0.25), 6) AS q25, round(quantile_cont(x, 0.5), 6) AS q50, round(quantile_cont(x, 0.75), 6) AS q75
FROM samples JOIN depth USING (sample_id) GROUP BY project""")
def depth_summary(spark, sf):
    return B.rounded(FL.depth_summary(FL.attach_depth(B.samples(spark, sf), B.counts(spark, sf))))


FILTERED = BANDED + """, kept AS (SELECT * FROM counts SEMI JOIN banded USING (sample_id)),
common AS (SELECT taxon_id FROM kept GROUP BY 1 HAVING sum(CASE WHEN n >= 30 THEN 1 ELSE 0 END) >= 7),
ckept AS (SELECT * FROM kept SEMI JOIN common USING (taxon_id)),
rich AS (SELECT sample_id, count(*) AS n_taxa FROM ckept GROUP BY 1 HAVING count(*) BETWEEN 50 AND 400)"""


def _filtered(spark, sf):
    counts = materialize(B.counts(spark, sf), "counts")
    return FL.filter_samples_and_taxa(
        B.projects(spark, sf), B.samples(spark, sf), counts, B.sequences(spark, sf),
        read_count_lb=30, sample_count_lb=7, min_taxa=50, max_taxa=400)


@query("filter_samples_taxa", f"""WITH {FILTERED}
SELECT sample_id, project, read_counts, n_taxa, CAST((SELECT max(n_taxa) FROM rich) AS BIGINT) AS max_taxa
FROM banded JOIN rich USING (sample_id)""")
def filter_samples_taxa(spark, sf):
    out = _filtered(spark, sf)
    return out["samples"].select("sample_id", "project", "read_counts", "n_taxa").withColumn(
        "max_taxa", out["max_taxa"].scalar())


@query("filter_sequences", f"WITH {FILTERED}, {B.SEQUENCES} SELECT taxon_id, aln FROM sequences SEMI JOIN common USING (taxon_id)")
def filter_sequences(spark, sf):
    return _filtered(spark, sf)["sequences"]


@query("filter_projects", f"""WITH {FILTERED}, {B.PROJECTS}
SELECT project, condition FROM projects SEMI JOIN (SELECT project FROM banded SEMI JOIN rich USING (sample_id)) USING (project)""")
def filter_projects(spark, sf):
    return _filtered(spark, sf)["projects"].select("project", "condition")


COHORT = """cohort AS (SELECT * FROM samples WHERE iso IN ('NATION_1', 'NATION_2', 'NATION_3', 'NATION_8', 'NATION_20')
  AND instrument = 'Illumina MiSeq')"""
COHORT_ISOS = ["NATION_1", "NATION_2", "NATION_3", "NATION_8", "NATION_20"]


@query("cohort_filter", f"WITH {B.SAMPLES}, {COHORT} SELECT sample_id, project, iso FROM cohort")
def cohort_filter(spark, sf):
    return FL.cohort_amplicon(B.samples(spark, sf), COHORT_ISOS, "Illumina MiSeq").select("sample_id", "project", "iso")


@query("cohort_healthy_adults", """SELECT 'SRS' || c_custkey AS sample_id FROM customer
WHERE c_mktsegment IN ('BUILDING', 'MACHINERY') AND c_acctbal >= 0""")
def cohort_healthy_adults(spark, sf):
    metadata = B.table(spark, sf, "customer").select(
        B.prefixed("SRS", "c_custkey").alias("sample_id"),
        F.when(F.col("c_mktsegment").isin("BUILDING", "MACHINERY"), "adult").otherwise("child").alias("age_category"),
        F.when(F.col("c_acctbal") >= 0, "healthy").otherwise("IBD").alias("disease"))
    return FL.cohort_healthy_adults(metadata).select("sample_id")


@query("new_taxa_per_project", f"""WITH {B.COUNTS}, firsts AS (
  SELECT taxon_id, min(CAST(substr(project, 4) AS INTEGER)) AS p FROM counts GROUP BY 1)
SELECT 'PRJ' || n_nationkey AS project, count(taxon_id) AS n_new FROM nation LEFT JOIN firsts ON p = n_nationkey GROUP BY 1""")
def new_taxa_per_project(spark, sf):
    order = B.table(spark, sf, "nation").select(B.prefixed("PRJ", "n_nationkey").alias("project"), F.col("n_nationkey").alias("ord"))
    return FL.new_taxa_per_project(P.distinct_taxa(B.counts(spark, sf)), order)


@query("project_taxa", f"""WITH {B.COUNTS}, {B.SAMPLES}, {COHORT}
SELECT DISTINCT project, taxon_id FROM counts SEMI JOIN cohort USING (sample_id)
SEMI JOIN (SELECT 'ASV' || p_partkey AS taxon_id FROM part WHERE p_type <> 'LARGE') v USING (taxon_id)""")
def project_taxa(spark, sf):
    cohort = FL.cohort_amplicon(B.samples(spark, sf), COHORT_ISOS, "Illumina MiSeq")
    valid = B.table(spark, sf, "part").where("p_type <> 'LARGE'").select(B.prefixed("ASV", "p_partkey").alias("taxon_id"))
    return P.distinct_taxa(B.counts(spark, sf), cohort, valid)


@query("project_summary", f"""WITH {B.SAMPLES}
SELECT project, string_agg(DISTINCT region, ',') AS regions, string_agg(DISTINCT iso, ',') AS isos, count(*) AS n_samples
FROM samples GROUP BY 1""")
def project_summary(spark, sf):
    return FL.project_summary(B.samples(spark, sf)).select(
        "project", F.array_join("regions", ",").alias("regions"), F.array_join("isos", ",").alias("isos"), "n_samples")


@query("region_counts", f"WITH {B.SAMPLES} SELECT region, iso, count(*) AS count FROM samples GROUP BY 1, 2")
def region_counts(spark, sf):
    return FL.value_counts(B.samples(spark, sf), "region", "iso")


@query("samples_per_project", f"""WITH {B.SAMPLES}, {B.PROJECTS}, n AS (
  SELECT project, count(*) AS n_samples FROM samples GROUP BY 1)
SELECT project, amplicon, avg_length, n_samples FROM projects LEFT JOIN n USING (project)
WHERE condition = 'healthy' AND subjects = 'adults' AND amplicon IN ('v3-v4', 'v3', 'v4')""")
def samples_per_project(spark, sf):
    chosen = FL.cohort_projects(B.projects(spark, sf), "healthy", "adults", ["v3-v4", "v3", "v4"])
    return FL.samples_per_project(chosen, B.samples(spark, sf)).select("project", "amplicon", "avg_length", "n_samples")


@query("cross_reference", f"""WITH {B.SAMPLES}, {B.PROJECTS}
SELECT p.project, s.sample_id FROM (SELECT * FROM projects WHERE condition = 'healthy') p JOIN
(SELECT * FROM samples WHERE instrument = 'Illumina MiSeq') s USING (project)""")
def cross_reference(spark, sf):
    """Projects with a surviving sample and samples with a surviving project."""
    s = B.samples(spark, sf).where("instrument = 'Illumina MiSeq'")
    p = B.projects(spark, sf).where("condition = 'healthy'")
    kept = s.join(p.select("project"), "project", "left_semi")
    return p.join(kept.select("project"), "project", "left_semi").select("project").join(
        kept.select("project", "sample_id"), "project")


@query("country_counts", """WITH labelled AS (
  SELECT CASE WHEN c_nationkey >= 5 THEN 'NATION_' || c_nationkey END AS label FROM customer)
SELECT n_name AS name, c.count FROM nation LEFT JOIN (SELECT label, count(*) AS count FROM labelled GROUP BY 1) c ON label = n_name""")
def country_counts(spark, sf):
    labelled = B.table(spark, sf, "customer").select(
        F.when(F.col("c_nationkey") >= 5, B.prefixed("NATION_", "c_nationkey")).alias("label"))
    return FL.counts_on_reference(labelled, "label", B.table(spark, sf, "nation").select(F.col("n_name").alias("name")), "name")


@query("missing_country_count", "SELECT count(*) AS n_missing FROM customer WHERE c_nationkey < 5")
def missing_country_count(spark, sf):
    labelled = B.table(spark, sf, "customer").select(
        F.when(F.col("c_nationkey") >= 5, B.prefixed("NATION_", "c_nationkey")).alias("label"))
    return FL.missing_label_count(labelled, "label")


@query("richness_distribution", f"""WITH {B.COUNTS}, r AS (SELECT count(*)::DOUBLE AS k FROM counts GROUP BY sample_id)
SELECT round(quantile_cont(k, 0.5), 6) AS median, round(quantile_cont(k, 0.05), 6) AS q05, round(quantile_cont(k, 0.95), 6) AS q95 FROM r""")
def richness_distribution(spark, sf):
    return B.rounded(FL.richness_distribution(B.profile(spark, sf)))


@query("rich_samples", f"WITH {B.COUNTS} SELECT sample_id, count(*) AS n_taxa FROM counts WHERE n > 0 GROUP BY 1 HAVING count(*) >= 500")
def rich_samples(spark, sf):
    return FL.rich_samples(B.profile(spark, sf), 500)


# --- validation -----------------------------------------------------------------------

@query("profile_violations", """SELECT 'SRS' || l_suppkey AS sample_id, round(sum(l_discount), 6) AS total
FROM lineitem GROUP BY 1 HAVING abs(sum(l_discount) - 1) > 1e-4""")
def profile_violations(spark, sf):
    shares = B.table(spark, sf, "lineitem").select(
        B.prefixed("SRS", "l_suppkey").alias("sample_id"), F.col("l_discount").alias("rel_abund"))
    return B.rounded(V.sum_violations(shares))


@query("metadata_violations", """SELECT 'SRS' || c_custkey AS sample_id, count(o_custkey) AS n
FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY 1 HAVING count(o_custkey) <> 1""")
def metadata_violations(spark, sf):
    ids = B.table(spark, sf, "customer").select(B.prefixed("SRS", "c_custkey").alias("sample_id"))
    return V.metadata_violations(ids, B.table(spark, sf, "orders").select(B.prefixed("SRS", "o_custkey").alias("srs")))


@query("bad_sample_ids", "SELECT 'XRS' || s_suppkey AS sample_id FROM supplier WHERE s_acctbal < 1000")
def bad_sample_ids(spark, sf):
    ids = B.table(spark, sf, "supplier").select(F.concat(
        F.when(F.col("s_acctbal") < 1000, "XRS").otherwise("ERS"), F.col("s_suppkey").cast("string")).alias("sample_id"))
    return V.bad_sample_ids(ids)


@query("missing_from_header", """SELECT 'PRJ' || c_nationkey AS project, 'SRS' || c_custkey AS sample_id FROM customer
WHERE NOT EXISTS (SELECT 1 FROM supplier WHERE s_nationkey = c_nationkey AND s_suppkey = c_custkey)""")
def missing_from_header(spark, sf):
    requested = B.table(spark, sf, "customer").select(
        B.prefixed("PRJ", "c_nationkey").alias("project"), B.prefixed("SRS", "c_custkey").alias("sample_id"))
    return V.missing_from_header(requested, B.samples(spark, sf).select("project", "sample_id"))


@query("split_overlap", f"""WITH {B.split_sql(7, 's7')}, {B.split_sql(8, 's8')}
SELECT sample_id FROM s7 WHERE label = 'Train' INTERSECT SELECT sample_id FROM s8 WHERE label = 'Test'""")
def split_overlap(spark, sf):
    return V.split_overlap(B.split(spark, sf, 7).where("label = 'Train'"), B.split(spark, sf, 8).where("label = 'Test'"))


@query("unknown_answers", f"""WITH {B.TRAIN_TEST}
SELECT 'ASV' || l_orderkey AS query, 'ASV' || l_partkey AS answer, l_discount AS similarity FROM lineitem
WHERE 'ASV' || l_partkey NOT IN (SELECT taxon_id FROM train)""")
def unknown_answers(spark, sf):
    train, _ = B.train_test(spark, sf)
    nn = B.table(spark, sf, "lineitem").select(
        B.prefixed("ASV", "l_orderkey").alias("query"), B.prefixed("ASV", "l_partkey").alias("answer"),
        F.col("l_discount").alias("similarity"))
    return V.unknown_answers(nn, train)


@query("unnormalised_predictions", f"""WITH {B.PROFILE}
SELECT sample_id, round(ln(sum(rel_abund)), 6) AS logsumexp FROM profile
SEMI JOIN (SELECT 'ASV' || p_partkey AS taxon_id FROM part WHERE p_type <> 'LARGE') v USING (taxon_id)
GROUP BY 1 HAVING abs(ln(sum(rel_abund))) > 1e-4""")
def unnormalised_predictions(spark, sf):
    valid = B.table(spark, sf, "part").where("p_type <> 'LARGE'").select(B.prefixed("ASV", "p_partkey").alias("taxon_id"))
    partial = B.profile(spark, sf).join(valid, "taxon_id", "left_semi")
    return B.rounded(V.unnormalised_predictions(partial.select("sample_id", F.ln("rel_abund").alias("lp"))))


# Every line is a row of the alignment: a sequence of its part, or a reference one under a name no sequence has.
@query("unaligned_sequences", f"""WITH {B.SEQUENCES}
SELECT taxon_id, aln FROM sequences
ANTI JOIN (SELECT CASE WHEN l_quantity >= 48 THEN 'ASV' ELSE 'REF' END || l_partkey AS taxon_id FROM lineitem) aligned USING (taxon_id)""")
def unaligned_sequences(spark, sf):
    aligned = B.table(spark, sf, "lineitem").select(
        F.concat(F.when(F.col("l_quantity") >= 48, "ASV").otherwise("REF"), F.col("l_partkey").cast("string")).alias("taxon_id"))
    return V.unaligned_sequences(B.sequences(spark, sf), aligned)


@query("alignment_lengths", f"""WITH {B.SEQUENCES}
SELECT length(replace(aln, '-', '')) AS length, count(*) AS n FROM sequences GROUP BY 1""")
def alignment_lengths(spark, sf):
    return V.alignment_lengths(B.sequences(spark, sf).select(C.degap("aln").alias("aln"))).select(
        F.col("length").cast("bigint").alias("length"), "n")


DAY_RESULTS = """r AS (SELECT DISTINCT o_orderpriority AS m, CAST(strftime(o_orderdate, '%Y%m') AS INTEGER) * 10
  + CASE o_orderstatus WHEN 'F' THEN 1 WHEN 'O' THEN 2 ELSE 3 END AS s FROM orders)"""


@query("missing_runs", f"""WITH {DAY_RESULTS}
SELECT ms.m AS "Method", ss.s AS "Seed" FROM (SELECT DISTINCT m FROM r) ms CROSS JOIN (SELECT DISTINCT s FROM r) ss
WHERE (ms.m, ss.s) NOT IN (SELECT m, s FROM r)""")
def missing_runs(spark, sf):
    status = F.when(F.col("o_orderstatus") == "F", 1).when(F.col("o_orderstatus") == "O", 2).otherwise(3)
    month = F.date_format("o_orderdate", "yyyyMM").cast("int")
    results = B.table(spark, sf, "orders").select(
        F.col("o_orderpriority").alias("Method"), (month * 10 + status).alias("Seed"))
    return V.missing_runs(results)


@query("sample_set_difference", f"""WITH {B.RESULTS},
x AS (SELECT DISTINCT "SampleId" FROM results WHERE "Method" = '1-URGENT'),
y AS (SELECT DISTINCT "SampleId" FROM results WHERE "Method" = '2-HIGH')
SELECT "SampleId", 'first' AS only_in FROM (SELECT * FROM x EXCEPT SELECT * FROM y)
UNION ALL SELECT "SampleId", 'second' FROM (SELECT * FROM y EXCEPT SELECT * FROM x)""")
def sample_set_difference(spark, sf):
    r = B.results(spark, sf)
    return V.sample_set_difference(r.where("Method = '1-URGENT'"), r.where("Method = '2-HIGH'"))


# --- projections ----------------------------------------------------------------------

@query("strip_suffix", """SELECT 'SGB' || p_partkey AS taxon_id,
  'SGB' || p_partkey || CASE p_type WHEN 'LARGE' THEN '_group' ELSE '' END AS taxon_id_raw FROM part""")
def strip_suffix(spark, sf):
    raw = F.concat(B.prefixed("SGB", "p_partkey"), F.when(F.col("p_type") == "LARGE", "_group").otherwise(""))
    return P.strip_suffix(B.table(spark, sf, "part").select(raw.alias("taxon_id")))


@query("marker_id_parse", """WITH m AS (
  SELECT p_partkey, p_type, CASE WHEN p_type IN ('STANDARD', 'SMALL') THEN 'p' || p_size || ':' || p_partkey || '__GCA' || p_size
    WHEN p_type = 'LARGE' THEN 'gene' || p_size || ':SGB' || p_partkey || '__GCA'
    WHEN p_type = 'PROMO' THEN 'SGB' || p_partkey || '__UniRef' || p_size ELSE p_name END AS marker_id,
    CASE WHEN p_type IN ('STANDARD', 'SMALL') THEN 'p' || p_size WHEN p_type = 'LARGE' THEN 'gene' || p_size
    WHEN p_type = 'PROMO' THEN 'UniRef' || p_size ELSE '' END AS gene FROM part)
SELECT marker_id, CASE WHEN p_type IN ('STANDARD', 'SMALL', 'LARGE', 'PROMO') THEN 'SGB' || p_partkey END AS taxon_id, gene FROM m""")
def marker_id_parse(spark, sf):
    key, size = F.col("p_partkey").cast("string"), F.col("p_size").cast("string")
    marker = (
        F.when(F.col("p_type").isin("STANDARD", "SMALL"), F.concat(F.lit("p"), size, F.lit(":"), key, F.lit("__GCA"), size))
        .when(F.col("p_type") == "LARGE", F.concat(F.lit("gene"), size, F.lit(":SGB"), key, F.lit("__GCA")))
        .when(F.col("p_type") == "PROMO", F.concat(F.lit("SGB"), key, F.lit("__UniRef"), size))
        .otherwise(F.col("p_name")))
    return B.table(spark, sf, "part").select(marker.alias("marker_id")).select(
        "marker_id", C.marker_taxon("marker_id").alias("taxon_id"), C.marker_gene("marker_id").alias("gene"))


@query("record_gene", """WITH r AS (
  SELECT p_partkey, 'mrk_p' || CASE WHEN p_size < 40 THEN lpad(p_size::VARCHAR, 4, '0') ELSE p_size::VARCHAR END AS head, p_size FROM part)
SELECT head || ':' || p_partkey AS record, CASE WHEN p_size < 40 THEN 'p' || lpad(p_size::VARCHAR, 4, '0') END AS gene,
  concat_ws(':', CASE WHEN p_size < 40 THEN 'p' || lpad(p_size::VARCHAR, 4, '0') END, 'G' || p_partkey) AS new_id FROM r""")
def record_gene(spark, sf):
    number = F.when(F.col("p_size") < 40, F.lpad(F.col("p_size").cast("string"), 4, "0")).otherwise(F.col("p_size").cast("string"))
    rows = B.table(spark, sf, "part").select(
        F.concat(F.lit("mrk_p"), number, F.lit(":"), F.col("p_partkey").cast("string")).alias("record"),
        B.prefixed("G", "p_partkey").alias("genome"))
    gene = C.gene_of_record("record")
    return rows.select("record", gene.alias("gene"), C.record_id(gene, "genome").alias("new_id"))


@query("degap", f"WITH {B.SEQUENCES} SELECT taxon_id, replace(aln, '-', '') AS seq FROM sequences")
def degap(spark, sf):
    return B.sequences(spark, sf).select("taxon_id", C.degap("aln").alias("seq"))


@query("first_records", """SELECT 'ASV' || l_partkey AS id, arg_min(l_extendedprice,
  (l_orderkey, l_linenumber, l_suppkey, l_quantity, l_extendedprice)) AS price FROM lineitem GROUP BY 1""")
def first_records(spark, sf):
    rows = B.table(spark, sf, "lineitem").select(
        B.prefixed("ASV", "l_partkey").alias("id"), "l_orderkey", "l_linenumber", "l_suppkey", "l_quantity", "l_extendedprice")
    order = ["l_orderkey", "l_linenumber", "l_suppkey", "l_quantity", "l_extendedprice"]
    return P.first_records(rows, "id", order).select("id", F.col("l_extendedprice").alias("price"))


@query("taxonomy_domain", f"""WITH {B.HITS} SELECT query_id, {B.DOMAIN.format('target')} AS domain, count(*) AS n
FROM hits GROUP BY ALL""")
def taxonomy_domain(spark, sf):
    tagged = B.hits(spark, sf).select("query_id", C.taxonomy_domain("target").alias("domain"))
    return FL.value_counts(tagged, "query_id", "domain").withColumnRenamed("count", "n")


NEGATIVE = "18s|23s|28s|5s|5\\.8s|large subunit|lsu|its1|its2|internal transcribed spacer|chloroplast|mitochondrial|plastid"
POSITIVE = "16s ribosomal rna|16s rrna|16s ribosomal|16s small subunit|small subunit ribosomal rna|ssu rrna|16s rdna|small subunit rrna"


@query("is_16s", f"""WITH d AS (
  SELECT doc_id, text || CASE WHEN lang = 'en' THEN ' 16S rRNA gene' WHEN lang = 'fr' THEN ' SSU rRNA' ELSE '' END AS t FROM documents)
SELECT doc_id, regexp_matches(lower(t), '{POSITIVE}') AND NOT regexp_matches(lower(t), '{NEGATIVE}') AS is_16s FROM d""")
def is_16s(spark, sf):
    tail = F.when(F.col("lang") == "en", " 16S rRNA gene").when(F.col("lang") == "fr", " SSU rRNA").otherwise("")
    docs = B.table(spark, sf, "documents").select("doc_id", F.concat("text", tail).alias("t"))
    return docs.select("doc_id", C.is_16s("t").alias("is_16s"))


@query("low_alignment", """SELECT 'ASV' || l_partkey AS "QueryName", round(CAST(l_quantity AS INTEGER) / (40.0::DOUBLE + l_linenumber), 6) AS fraction
FROM lineitem WHERE CAST(l_quantity AS INTEGER) / (40.0::DOUBLE + l_linenumber) < 0.25""")
def low_alignment(spark, sf):
    report = B.table(spark, sf, "lineitem").select(
        B.prefixed("ASV", "l_partkey").alias("QueryName"), (F.col("l_linenumber") + 40).alias("QueryLength"),
        F.col("l_linenumber").alias("QueryStart"),
        (F.col("l_linenumber") + F.col("l_quantity").cast("int") - 1).alias("QueryEnd"))
    return B.rounded(H.low_alignment(report, 0.25))


@query("country_clean", """WITH g AS (
  SELECT c_custkey, CASE WHEN c_nationkey < 4 THEN ' USA: Boston' WHEN c_nationkey < 7 THEN 'Not Collected'
    WHEN c_nationkey < 10 THEN 'Hong Kong' WHEN c_nationkey < 13 THEN 'Turkey:Ankara' WHEN c_nationkey < 16 THEN 'UK'
    WHEN c_nationkey < 19 THEN 'Atlantis' END AS geo FROM customer)
SELECT c_custkey, CASE geo WHEN ' USA: Boston' THEN 'United States of America' WHEN 'Hong Kong' THEN 'China'
  WHEN 'Turkey:Ankara' THEN 'Turkey' WHEN 'UK' THEN 'United Kingdom' END AS country FROM g""")
def country_clean(spark, sf):
    k = F.col("c_nationkey")
    geo = (F.when(k < 4, " USA: Boston").when(k < 7, "Not Collected").when(k < 10, "Hong Kong")
           .when(k < 13, "Turkey:Ankara").when(k < 16, "UK").when(k < 19, "Atlantis"))
    rows = B.table(spark, sf, "customer").select("c_custkey", geo.alias("geo"))
    return FL.clean_countries(rows, "geo").select("c_custkey", "country")


@query("fold_top_counts", """WITH n AS (SELECT c_nationkey, count(*) AS k FROM customer GROUP BY 1)
SELECT CASE WHEN k > 60 THEN 'NATION_' || c_nationkey ELSE 'Other' END AS country, CAST(sum(k) AS BIGINT) AS count FROM n GROUP BY 1""")
def fold_top_counts(spark, sf):
    labelled = B.table(spark, sf, "customer").select(B.prefixed("NATION_", "c_nationkey").alias("country"))
    return FL.value_counts(FL.fold_rare(labelled, "country", 60), "country")


@query("method_parse", """WITH m AS (
  SELECT CASE WHEN p_type IN ('STANDARD', 'LARGE') THEN 'umap_d' || p_size || '_s' || p_partkey || '__epc_pool_1_kl'
    WHEN p_type IN ('SMALL', 'ECONOMY') THEN 'pcoa_d' || p_size || '_s' || p_partkey || '__epc_nopool_3_kl'
    WHEN p_type = 'MEDIUM' THEN 'x_d' || p_size || '__epc_pool_NO_MLP_' || p_partkey ELSE 'x_d' || p_size || '__set_transformer_d' || p_partkey END AS method,
    p_size, p_partkey, p_type FROM part)
SELECT method, split_part(method, '__', 1) AS embedding, p_size AS dimension,
  CASE WHEN p_type IN ('STANDARD', 'LARGE') THEN 2 END AS depth,
  CASE WHEN p_type = 'MEDIUM' THEN 'pooled, no MLP' WHEN p_type = 'PROMO' THEN 'set transformer' ELSE 'pooled' END AS model_type,
  CASE WHEN p_type IN ('STANDARD', 'LARGE', 'MEDIUM') THEN true WHEN p_type <> 'PROMO' THEN false END AS pooled FROM m""")
def method_parse(spark, sf):
    key, size = F.col("p_partkey").cast("string"), F.col("p_size").cast("string")
    name = (
        F.when(F.col("p_type").isin("STANDARD", "LARGE"), F.concat(F.lit("umap_d"), size, F.lit("_s"), key, F.lit("__epc_pool_1_kl")))
        .when(F.col("p_type").isin("SMALL", "ECONOMY"), F.concat(F.lit("pcoa_d"), size, F.lit("_s"), key, F.lit("__epc_nopool_3_kl")))
        .when(F.col("p_type") == "MEDIUM", F.concat(F.lit("x_d"), size, F.lit("__epc_pool_NO_MLP_"), key))
        .otherwise(F.concat(F.lit("x_d"), size, F.lit("__set_transformer_d"), key)))
    return B.table(spark, sf, "part").select(name.alias("method")).select(
        "method", C.method_embedding("method").alias("embedding"),
        C.method_dimension(C.method_embedding("method")).alias("dimension"),
        C.method_mlp_depth("method").alias("depth"), C.method_model_type("method").alias("model_type"),
        C.method_pooled("method").alias("pooled"))


@query("embedding_model_parse", """SELECT CASE WHEN p_type = 'STANDARD' THEN 'evo2_7b_hyena' || p_size WHEN p_type = 'LARGE' THEN 'evo-1-8k-base'
  WHEN p_type = 'SMALL' THEN 'dnabert-s' WHEN p_type = 'MEDIUM' THEN 'umap_d' || p_size || '_s' || p_partkey
  ELSE 'pcoa_d' || p_size || '_s' || p_partkey END AS name,
  CASE WHEN p_type = 'STANDARD' THEN 'evo2' WHEN p_type = 'LARGE' THEN 'evo-1' WHEN p_type = 'SMALL' THEN 'dnabert-s'
  WHEN p_type = 'MEDIUM' THEN 'umap' ELSE 'pcoa' END AS family,
  CASE WHEN p_type IN ('STANDARD', 'LARGE') THEN 4096 WHEN p_type = 'SMALL' THEN 768 ELSE p_size END AS dimension,
  CASE WHEN p_type NOT IN ('STANDARD', 'LARGE', 'SMALL') THEN CAST(p_partkey AS INTEGER) END AS seed,
  CASE WHEN p_type = 'STANDARD' THEN p_size WHEN p_type = 'LARGE' THEN 32 END AS layers FROM part""")
def embedding_model_parse(spark, sf):
    key, size = F.col("p_partkey").cast("string"), F.col("p_size").cast("string")
    name = (
        F.when(F.col("p_type") == "STANDARD", F.concat(F.lit("evo2_7b_hyena"), size))
        .when(F.col("p_type") == "LARGE", F.lit("evo-1-8k-base")).when(F.col("p_type") == "SMALL", F.lit("dnabert-s"))
        .when(F.col("p_type") == "MEDIUM", F.concat(F.lit("umap_d"), size, F.lit("_s"), key))
        .otherwise(F.concat(F.lit("pcoa_d"), size, F.lit("_s"), key)))
    return B.table(spark, sf, "part").select(name.alias("name")).select("name", C.embedding_model("name").alias("m")).select("name", "m.*")


@query("significance_marks", """SELECT CASE WHEN l_discount * l_discount < 0.001 THEN '***' WHEN l_discount * l_discount < 0.01 THEN '**'
  WHEN l_discount * l_discount < 0.05 THEN '*' ELSE 'n.s.' END AS mark, count(*) AS count FROM lineitem GROUP BY 1""")
def significance_marks(spark, sf):
    p = B.table(spark, sf, "lineitem").select((F.col("l_discount") * F.col("l_discount")).alias("p"))
    return FL.value_counts(p.select(C.significance_mark("p").alias("mark")), "mark")


# --- verdicts and sequence reports -------------------------------------------------------

VERDICT = B.HITS + f""", dom AS (
  SELECT DISTINCT query_id, {B.DOMAIN.format('target')} AS d FROM hits WHERE identity / 100.0 >= 0.985),
per AS (SELECT query_id, list_sort(list(d)) AS ds FROM dom GROUP BY 1),
verdict AS (
  SELECT 'ASV' || p_partkey AS id,
    CASE WHEN ds IS NULL THEN 'No hits' WHEN list_contains(ds, 'Bacteria') THEN 'Bacteria'
         WHEN list_contains(ds, 'Archaea') THEN 'Archaea' WHEN list_contains(ds, 'Eukaryota') THEN 'Eukaryota' ELSE 'Unknown' END AS domain,
    CASE WHEN ds IS NULL THEN 'No VSEARCH hit above 98.5% identity threshold'
         WHEN list_contains(ds, 'Bacteria') AND len(ds) > 1 THEN 'Mixed hits: Bacteria + ' || array_to_string(list_filter(ds, lambda x: x <> 'Bacteria'), ', ')
         WHEN list_contains(ds, 'Bacteria') THEN 'Bacterial hits only'
         WHEN list_contains(ds, 'Archaea') THEN 'Rejected: Archaeal sequence'
         WHEN list_contains(ds, 'Eukaryota') THEN 'Rejected: Eukaryotic sequence'
         WHEN list_contains(ds, 'Unknown') THEN 'Rejected: Domain could not be determined'
         ELSE 'Rejected: No recognizable domain' END AS reason
  FROM part LEFT JOIN per ON query_id = 'ASV' || p_partkey)"""


def _ids(spark, sf):
    return B.table(spark, sf, "part").select(B.prefixed("ASV", "p_partkey").alias("id"))


@query("bacterial_verdict", f"WITH {VERDICT} SELECT id, domain, reason, domain = 'Bacteria' AS keep FROM verdict")
def bacterial_verdict(spark, sf):
    return H.bacterial_verdict(B.hits(spark, sf), _ids(spark, sf), 0.985)


@query("verdict_summary", f"""WITH {VERDICT}
SELECT domain, count(*) AS n, (SELECT count(*) FROM verdict) AS total, round(count(*) / (SELECT count(*) FROM verdict), 6) AS share
FROM verdict GROUP BY 1""")
def verdict_summary(spark, sf):
    return B.rounded(H.verdict_summary(H.bacterial_verdict(B.hits(spark, sf), _ids(spark, sf), 0.985)))


@query("top5_verdict", f"""WITH {B.HITS}, t AS (
  SELECT query_id AS id, count(*) FILTER (identity >= 97) AS good,
    min((hit_rank, description)) FILTER (identity >= 97 AND NOT (
      regexp_matches(lower(description), '{POSITIVE}') AND NOT regexp_matches(lower(description), '{NEGATIVE}'))) AS bad
  FROM hits WHERE hit_rank <= 5 GROUP BY 1)
SELECT 'ASV' || p_partkey AS id, coalesce(good, 0) > 0 AND bad IS NULL AS keep,
  CASE WHEN good IS NULL THEN 'No BLAST hits found' WHEN good = 0 THEN 'No hits above identity threshold 97'
       WHEN bad IS NOT NULL THEN 'Hit ' || bad[1] || ' is not 16S: ' || bad[2] END AS reason
FROM part LEFT JOIN t ON id = 'ASV' || p_partkey""")
def top5_verdict(spark, sf):
    return H.top_hits_verdict(B.hits(spark, sf), _ids(spark, sf), 97)


@query("amplicon_region_median", f"""WITH {B.COUNTS}, {B.SAMPLES}, {B.PROJECTS}, pt AS (SELECT DISTINCT project, taxon_id FROM counts),
r AS (SELECT project, CAST(floor(quantile_cont(p_size * 3, 0.5)) AS BIGINT) AS s,
             CAST(floor(quantile_cont(p_size * 3 + p_partkey, 0.5)) AS BIGINT) AS e
      FROM pt JOIN part ON taxon_id = 'ASV' || p_partkey GROUP BY 1)
SELECT project, n_samples, s AS start, e AS "end", e - s + 1 AS length, amplicon
FROM r JOIN (SELECT project, count(*) AS n_samples FROM samples GROUP BY 1) USING (project) LEFT JOIN projects USING (project)""")
def amplicon_region_median(spark, sf):
    report = B.table(spark, sf, "part").select(
        B.prefixed("ASV", "p_partkey").alias("QueryName"), (F.col("p_size") * 3).alias("TemplateStart"),
        (F.col("p_size") * 3 + F.col("p_partkey")).alias("TemplateEnd"))
    taxa = P.distinct_taxa(B.counts(spark, sf))
    regions = FL.amplicon_region(report, taxa, B.samples(spark, sf))
    return regions.join(B.projects(spark, sf).select("project", "amplicon"), "project", "left")


@query("amplicon_region_mode", f"""WITH {B.COUNTS}, {B.SEQUENCES}, frag AS (
  SELECT project, taxon_id, aln, translate(md5(project), 'abc', '---') AS ref
  FROM (SELECT DISTINCT project, taxon_id FROM counts) JOIN sequences USING (taxon_id)),
pos AS (
  SELECT project, taxon_id, length(replace(substr(ref, 1, i), '-', '')) - 1 AS place
  FROM frag, generate_series(1, 32) g(i) WHERE substr(aln, i, 1) <> '-' AND substr(ref, i, 1) <> '-'),
ends AS (SELECT project, min(place) AS f, max(place) AS l FROM pos GROUP BY project, taxon_id),
sf AS (SELECT project, f, count(*) AS n FROM ends GROUP BY 1, 2 QUALIFY row_number() OVER (PARTITION BY project ORDER BY n DESC, f) = 1),
sl AS (SELECT project, l, count(*) AS n FROM ends GROUP BY 1, 2 QUALIFY row_number() OVER (PARTITION BY project ORDER BY n DESC, l) = 1)
SELECT project, CAST(f AS INTEGER) AS start, CAST(l + 1 AS INTEGER) AS "end" FROM sf JOIN sl USING (project)""")
def amplicon_region_mode(spark, sf):
    fragments = P.distinct_taxa(B.counts(spark, sf)).join(B.sequences(spark, sf), "taxon_id")
    reference = B.projects(spark, sf).select("project", F.translate(F.md5("project"), "abc", "---").alias("ref"))
    return FL.amplicon_span_mode(fragments, reference)


@query("seq_length_hist", """WITH s AS (SELECT length(text) AS len, min(length(text)) OVER () AS lo, max(length(text)) OVER () AS hi FROM documents)
SELECT CAST(CASE WHEN hi = lo THEN 0 ELSE least(floor((len - lo) / ((hi - lo)::DOUBLE / 100)), 99) END AS INTEGER) AS bin,
  CAST(hi AS INTEGER) AS max_len, count(*) AS n FROM s GROUP BY 1, 2""")
def seq_length_hist(spark, sf):
    return FL.sequence_length_histogram(B.table(spark, sf, "documents").select(F.col("text").alias("seq")))


@query("marker_counts", f"WITH {B.MARKERS} SELECT taxon_id, count(*) AS n_markers FROM markers GROUP BY 1")
def marker_counts(spark, sf):
    return FL.marker_counts(B.markers(spark, sf))


@query("marker_totals", f"""WITH {B.MARKERS}, c AS (SELECT taxon_id, count(*) AS k FROM markers GROUP BY 1)
SELECT count(*) AS n_taxa, CAST(sum(k) AS BIGINT) AS n_markers, max(k) AS max_markers FROM c""")
def marker_totals(spark, sf):
    return FL.marker_totals(B.markers(spark, sf))
