"""Queries: marker vectors, pooling, scaling, batches, user embedders and models."""

import numpy as np
from pyspark.sql import functions as F

from taxaspark.functions import columns as C
from taxaspark.operators import features as X, ordination as O, profile as P
from taxaspark.plans import bind as B
from taxaspark.plans.registry import query


def _dims(df, *keys, vec="vec"):
    """One row per vector entry, ``dim`` from 1."""
    return B.rounded(df.select(*keys, F.posexplode(vec).alias("dim", "x")).withColumn(
        "dim", (F.col("dim") + 1).cast("bigint")))


@query("marker_pooling", f"WITH {B.MARKERS} SELECT taxon_id, dim, round(x, 6) + 0.0 AS x FROM pooled")
def marker_pooling(spark, sf):
    return _dims(X.pool_markers(B.markers(spark, sf)), "taxon_id")


@query("context_pooling", f"""WITH {B.MARKERS}, {B.LINE_PROFILE}
SELECT sample_id, dim, round(avg(x), 6) + 0.0 AS x FROM lprofile JOIN pooled USING (taxon_id) GROUP BY 1, 2""")
def context_pooling(spark, sf):
    return _dims(X.pool_context(B.line_profile(spark, sf), X.pool_markers(B.markers(spark, sf))), "sample_id")


FEATURES = B.MARKERS + ", " + B.LINE_PROFILE + """, ctx AS (
  SELECT sample_id, dim, avg(x) AS x FROM lprofile JOIN pooled USING (taxon_id) GROUP BY 1, 2),
feat AS (
  SELECT sample_id, taxon_id, dim, x FROM lprofile JOIN pooled USING (taxon_id)
  UNION ALL SELECT p.sample_id, p.taxon_id, dim + 64, {0} FROM lprofile p JOIN ctx USING (sample_id) WHERE p.taxon_id IN (SELECT taxon_id FROM pooled))"""


@query("pooled_features", f"WITH {FEATURES.format('x')} SELECT sample_id, taxon_id, dim, round(x, 6) + 0.0 AS x FROM feat")
def pooled_features(spark, sf):
    return _dims(X.pool_features(B.markers(spark, sf), B.line_profile(spark, sf)), "sample_id", "taxon_id", vec="features")


@query("pooled_features_ablated", f"WITH {FEATURES.format('0.0')} SELECT sample_id, taxon_id, dim, round(x, 6) + 0.0 AS x FROM feat")
def pooled_features_ablated(spark, sf):
    out = X.pool_features(B.markers(spark, sf), B.line_profile(spark, sf), ablate_context=True)
    return _dims(out, "sample_id", "taxon_id", vec="features")


@query("attach_vectors", f"""WITH {B.MARKERS}, {B.LINE_PROFILE}, k AS (SELECT DISTINCT taxon_id FROM markers),
t AS (SELECT p.*, k.taxon_id IS NOT NULL AS known FROM lprofile p LEFT JOIN k USING (taxon_id)),
tt AS (SELECT *, (CASE WHEN known THEN rel_abund ELSE 0 END) / sum(CASE WHEN known THEN rel_abund ELSE 0 END) OVER (PARTITION BY sample_id) AS target FROM t)
SELECT sample_id, taxon_id, known AS taxon_mask, round(target, 6) AS target, count(marker_id) AS n_markers
FROM tt LEFT JOIN markers USING (taxon_id) GROUP BY ALL""")
def attach_vectors(spark, sf):
    rows = P.attach_vectors(B.line_profile(spark, sf), B.markers(spark, sf))
    return B.rounded(rows.groupBy("sample_id", "taxon_id", "taxon_mask", "target").agg(
        F.count_if("marker_mask").alias("n_markers")))


@query("attach_vectors_stacked", f"""WITH {B.MARKERS}, {B.LINE_PROFILE}
SELECT sample_id, taxon_id, true AS taxon_mask, round(rel_abund, 6) AS target, count(marker_id) AS n_markers
FROM lprofile LEFT JOIN markers USING (taxon_id) GROUP BY ALL""")
def attach_vectors_stacked(spark, sf):
    rows = P.attach_vectors(B.line_profile(spark, sf), B.markers(spark, sf), keep_unembedded=True)
    return B.rounded(rows.groupBy("sample_id", "taxon_id", "taxon_mask", "target").agg(
        F.count_if("marker_mask").alias("n_markers")))


@query("compound_marker_index", f"""WITH {B.MARKERS}
SELECT taxon_id, marker_id, ord, 0 AS source_ord FROM markers WHERE taxon_id < 'SGB2'
UNION ALL SELECT taxon_id, marker_id, ord, 1 FROM markers""")
def compound_marker_index(spark, sf):
    m = B.markers(spark, sf).select("taxon_id", "marker_id", "ord")
    return P.compound_marker_index([m.where("taxon_id < 'SGB2'"), m])


@query("scaler", f"""WITH {B.MARKERS}
SELECT dim, round(avg(x), 6) + 0.0 AS mean, round(stddev_pop(x), 6) AS scale FROM dims GROUP BY 1""")
def scaler(spark, sf):
    fitted = O.fit_scaler(B.markers(spark, sf))
    return B.rounded(fitted.select(F.posexplode(F.arrays_zip("mean", "scale")).alias("dim", "s")).select(
        (F.col("dim") + 1).cast("bigint").alias("dim"), "s.mean", "s.scale"))


@query("standardised", f"""WITH {B.MARKERS}, s AS (SELECT dim, avg(x) AS m, stddev_pop(x) AS sd FROM dims GROUP BY 1)
SELECT marker_id, dim, round((x - m) / sd, 5) + 0.0 AS x FROM dims JOIN s USING (dim)""")
def standardised(spark, sf):
    m = B.markers(spark, sf)
    out = O.standardise(m.select("marker_id", "vec"), O.fit_scaler(m))
    return B.rounded(_dims_raw(out), 5)


def _dims_raw(df):
    return df.select("marker_id", F.posexplode("vec").alias("dim", "x")).withColumn("dim", (F.col("dim") + 1).cast("bigint"))


@query("pad_vectors", """SELECT vec_id, 70 AS dims, round(list_sum(embedding::DOUBLE[]), 5) + 0.0 AS total FROM embeddings""")
def pad_vectors(spark, sf):
    padded = B.table(spark, sf, "embeddings").select("vec_id", C.pad_vector("embedding", 70).alias("v"))
    total = F.aggregate("v", F.lit(0.0), lambda s, x: s + x)
    return B.rounded(padded.select("vec_id", F.size("v").alias("dims"), total.alias("total")), 5)


@query("kl_from_uniform", f"""WITH {B.LINE_PROFILE}
SELECT sample_id, round(sum(rel_abund * ln(rel_abund * 7)), 6) + 0.0 AS kl FROM lprofile GROUP BY 1""")
def kl_from_uniform(spark, sf):
    """Divergence of each profile from equal shares of the seven taxa."""
    kl = F.sum(C.kl_term("rel_abund", F.lit(1 / 7)))
    return B.rounded(B.line_profile(spark, sf).groupBy("sample_id").agg(kl.alias("kl")))


@query("pca")
def pca(spark, sf):
    reduced, _ = O.reduce_dimension(B.markers(spark, sf), 5, "marker_id")
    return reduced.select("marker_id", F.size("vec").alias("dims"))


@query("batches", """WITH p AS (SELECT 'SRS' || c_custkey AS sample_id, row_number() OVER (ORDER BY c_custkey) - 1 AS i, count(*) OVER () AS n FROM customer)
SELECT sample_id, CAST(floor(i / 32) AS BIGINT) AS batch, CAST(i % 32 AS INTEGER) AS slot FROM p WHERE (floor(i / 32) + 1) * 32 <= n""")
def batches(spark, sf):
    rows = B.table(spark, sf, "customer").select(B.prefixed("SRS", "c_custkey").alias("sample_id"), F.col("c_custkey").alias("ord"))
    return X.assign_batches(rows, 32, drop_last=True).select("sample_id", "batch", "slot")


@query("shuffled_batches", """WITH p AS (SELECT 'SRS' || c_custkey AS sample_id, row_number() OVER (ORDER BY c_custkey) - 1 AS i FROM customer),
b AS (SELECT x, row_number() OVER (ORDER BY md5('4|' || x)) - 1 AS batch FROM (SELECT DISTINCT CAST(floor(i / 32) AS BIGINT) AS x FROM p))
SELECT sample_id, batch, CAST(i % 32 AS INTEGER) AS slot FROM p JOIN b ON x = CAST(floor(i / 32) AS BIGINT)""")
def shuffled_batches(spark, sf):
    rows = B.table(spark, sf, "customer").select(B.prefixed("SRS", "c_custkey").alias("sample_id"), F.col("c_custkey").alias("ord"))
    return X.assign_batches(rows, 32, seed=4).select("sample_id", "batch", "slot")


@query("collated_batches", f"""WITH {B.MARKERS}, {B.LINE_PROFILE}, b AS (
  SELECT 'SRS' || s_suppkey AS sample_id, CAST(floor(s_suppkey / 8) AS BIGINT) AS batch FROM supplier),
k AS (SELECT taxon_id, count(*) AS k FROM markers GROUP BY 1),
s AS (SELECT sample_id, batch, count(*) AS taxa, max(coalesce(k, 1)) AS m, sum(coalesce(k, 0)) AS live
  FROM lprofile JOIN b USING (sample_id) LEFT JOIN k USING (taxon_id) GROUP BY 1, 2)
SELECT sample_id, batch, CAST(max(taxa) OVER (PARTITION BY batch) AS INTEGER) AS "S", CAST(max(m) OVER (PARTITION BY batch) AS INTEGER) AS "M", CAST(live AS BIGINT) AS live FROM s""")
def collated_batches(spark, sf):
    """Shapes and mask totals of the padded samples."""
    rows = P.attach_vectors(B.line_profile(spark, sf), B.markers(spark, sf)).withColumn(
        "marker_ord", F.coalesce(F.substring("marker_id", 2, 20).cast("long"), F.lit(0).cast("long"))).withColumn(
        "taxon_ord", F.substring("taxon_id", 4, 9).cast("int"))
    supplier = B.table(spark, sf, "supplier").select(B.prefixed("SRS", "s_suppkey").alias("sample_id"), F.col("s_suppkey").alias("ord"))
    placed = X.assign_batches(supplier, 8)
    out = X.collate(rows, placed, 64)
    live = F.aggregate(F.flatten("marker_mask"), F.lit(0).cast("bigint"), lambda s, m: s + m.cast("bigint"))
    return out.select("sample_id", "batch", F.size("features").alias("S"), F.size(F.col("features")[0]).alias("M"), live.alias("live"))


@query("gene_lists", f"""WITH {B.LINE_PROFILE}, g AS (
  SELECT 'SGB' || (label * 2) AS taxon_id, string_agg(md5('m' || vec_id), ',' ORDER BY vec_id) AS genes FROM embeddings GROUP BY 1)
SELECT sample_id, taxon_id, md5(genes) AS genes FROM lprofile JOIN g USING (taxon_id)""")
def gene_lists(spark, sf):
    markers = B.markers(spark, sf).select("taxon_id", "marker_id", "ord")
    sequences = B.markers(spark, sf).select("marker_id", F.md5("marker_id").alias("seq"))
    out = X.gene_lists(B.line_profile(spark, sf), markers, sequences)
    return out.select("sample_id", "taxon_id", F.md5(F.array_join("genes", ",")).alias("genes"))


class LetterCounts:
    """A small embedder for the check: text length and counts of four letters."""

    letters = "aeio"

    def embed_batch(self, texts):
        return [[len(t), *[t.count(c) for c in self.letters]] for t in texts]


@query("embed_sequences", "SELECT doc_id, " + ", ".join(
    ["CAST(length(text) AS DOUBLE) AS n"] + [f"CAST(length(text) - length(replace(text, '{c}', '')) AS DOUBLE) AS {c}" for c in "aeio"]) + " FROM documents")
def embed_sequences(spark, sf):
    """Whole document texts as sequences."""
    docs = B.table(spark, sf, "documents").select("doc_id", "text")
    out = X.embed_sequences(docs, LetterCounts, batch_size=64, id_col="doc_id", seq_col="text")
    return out.select("doc_id", *[F.col("vec")[i].cast("double").alias(c) for i, c in enumerate(["n", *"aeio"])])


@query("lookup_embedder", f"""WITH {B.SEQUENCES}, t AS (SELECT aln, min(taxon_id) AS first_id FROM sequences GROUP BY 1)
SELECT taxon_id, first_id FROM sequences JOIN t USING (aln)""")
def lookup_embedder(spark, sf):
    s = B.sequences(spark, sf).withColumnRenamed("aln", "seq")
    table = s.groupBy("seq").agg(F.min("taxon_id").alias("first_id"))
    known, _ = X.lookup_embedder(s, table)
    return known.select("taxon_id", "first_id")


def _weights(dims):
    """Fixed weights of the check's linear model."""
    return np.cos(np.arange(1, dims + 1))


def _linear_model():
    return lambda features: features @ _weights(features.shape[1])


@query("score_with_model", f"""WITH {FEATURES.format('x')}, logit AS (
  SELECT sample_id, taxon_id, sum(x * cos(dim)) AS v FROM feat GROUP BY 1, 2)
SELECT sample_id, taxon_id, round(v - ln(sum(exp(v)) OVER (PARTITION BY sample_id)), 6) AS lp FROM logit""")
def score_with_model(spark, sf):
    features = X.pool_features(B.markers(spark, sf), B.line_profile(spark, sf))
    return B.rounded(X.score_with_model(features, _linear_model).select("sample_id", "taxon_id", "lp"))
