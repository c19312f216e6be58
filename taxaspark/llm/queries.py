"""Registered queries of the operators of this folder, each with its SQL where SQL can say it."""

import corpus_pipeline
from taxaspark.llm import (
    conversations, decontaminate, exact, licenses, lm, near, pack, quality, simhash, spans, spelling, token_files, toxicity,
)
from taxaspark.llm.tables import table

QUERIES = {}
SQL = {}


def query(name, sql=None):
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn
    return add


@query("op6_exact_dedup", """
SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
       doc_id = max(doc_id) OVER same AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW same AS (PARTITION BY coalesce(text, ''))
""")
def op6_exact_dedup(spark, sf_dir):
    return exact.exact_groups(table(spark, sf_dir, "documents"))


@query("op5_token_files")
def op5_token_files(spark, sf_dir):
    return token_files.round_trip(table(spark, sf_dir, "documents"))


@query("op9_curve_packing")
def op9_curve_packing(spark, sf_dir):
    return pack.pack(table(spark, sf_dir, "documents"))


@query("op1_quality")
def op1_quality(spark, sf_dir):
    return quality.quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query("op7_toxicity")
def op7_toxicity(spark, sf_dir):
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query("op2_license_scan")
def op2_license_scan(spark, sf_dir):
    return licenses.scan(table(spark, sf_dir, "documents"))


@query("op8_suffix_tree")
def op8_suffix_tree(spark, sf_dir):
    return lm.score(table(spark, sf_dir, "documents"))


@query("op10_sentence_spans")
def op10_sentence_spans(spark, sf_dir):
    return spans.deduplicate(table(spark, sf_dir, "documents"))


@query("op3_near_duplicates")
def op3_near_duplicates(spark, sf_dir):
    return near.near_duplicates(table(spark, sf_dir, "documents"), shingle=3, percent=85)


@query("op4_decontaminate")
def op4_decontaminate(spark, sf_dir):
    return decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query("op11_spelling_variants")
def op11_spelling_variants(spark, sf_dir):
    return spelling.variants(table(spark, sf_dir, "documents"))


# h is CRC-32 bit by bit over the decimal digits. Subtree sums go over all pairs of a node and a node above it.
@query("op12_prefix_trie", """
WITH turns AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) - 1 AS pos
  FROM conversations WHERE conv_id IS NOT NULL),
convs AS (
  SELECT conv_id, conv_id - conv_id % 5 AS base, xor(list_reduce(list_prepend(4294967295, flatten(list_transform(
           string_split(conv_id::VARCHAR, ''), lambda c: [ascii(c)::BIGINT, 0, 0, 0, 0, 0, 0, 0]))),
           lambda s, b: xor(xor(s, b) >> 1, 3988292384 * (xor(s, b) & 1))), 4294967295) % 9 AS h
  FROM (SELECT DISTINCT conv_id FROM turns)),
opened AS (
  SELECT c.conv_id, t.pos, t.role, t.text FROM convs c JOIN turns t ON t.conv_id = c.base AND t.pos < c.h),
taken AS (
  SELECT c.conv_id, c.h, count(o.pos) AS k FROM convs c LEFT JOIN opened o USING (conv_id) GROUP BY ALL),
lines AS (
  SELECT conv_id, pos + 1 AS depth, role, text FROM opened
  UNION ALL
  SELECT t.conv_id, t.pos - k.h + k.k + 1, t.role, t.text FROM turns t JOIN taken k USING (conv_id) WHERE t.pos >= k.h),
paths AS (
  SELECT conv_id, depth, strlen(text) AS bytes,
         list({'r': role, 't': text}) OVER (PARTITION BY conv_id ORDER BY depth ROWS UNBOUNDED PRECEDING) AS path
  FROM lines
  UNION ALL SELECT conv_id, 0, 0, [] FROM convs),
members AS (
  SELECT conv_id, depth, bytes, min(conv_id) OVER (PARTITION BY path) AS node, depth = max(depth) OVER (PARTITION BY conv_id) AS ends
  FROM paths),
nodes AS (
  SELECT node, depth, any_value(bytes) AS bytes, count(*) AS n_convs,
         sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (WHERE ends), '')) AS ends_sha256
  FROM members GROUP BY node, depth),
up AS (
  SELECT n.*, m.node AS parent FROM nodes n LEFT JOIN members m ON m.conv_id = n.node AND m.depth = n.depth - 1),
kids AS (
  SELECT parent AS node, depth - 1 AS depth, count(*) AS n FROM up WHERE parent IS NOT NULL GROUP BY ALL),
counted AS (
  SELECT up.*, coalesce(kids.n, 0) AS n_children FROM up LEFT JOIN kids USING (node, depth)),
sums AS (
  SELECT m.node, m.depth, sum(CASE WHEN c.n_children = 0 THEN 1 ELSE 0 END) AS n_leaves, sum((c.n_convs - 1) * c.bytes) AS saved_tokens
  FROM counted c JOIN members m ON m.conv_id = c.node AND m.depth <= c.depth GROUP BY ALL)
SELECT c.node AS conv_id, c.depth, c.parent AS parent_conv_id, c.n_convs, c.n_children,
       s.n_leaves::BIGINT AS n_leaves, s.saved_tokens::BIGINT AS saved_tokens, c.ends_sha256
FROM counted c JOIN sums s USING (node, depth)
""")
def op12_prefix_trie(spark, sf_dir):
    return conversations.prefix_trie(table(spark, sf_dir, "conversations"))


@query("op13_simhash")
def op13_simhash(spark, sf_dir):
    return simhash.near_duplicates(table(spark, sf_dir, "documents"), shingle=3, bits=2)


@query("pipeline")
def pipeline(spark, sf_dir):
    return corpus_pipeline.run(spark, sf_dir)
