"""Exact deduplication: equal texts, one of each group stays."""

from pyspark.sql import DataFrame, functions as F

from taxaspark.llm.tables import materialize, whole_rows

SALTS = 64


def exact_groups(docs: DataFrame, digest=None, salts: int = SALTS) -> DataFrame:
    """Per document: ``doc_id, keep_id, group_size, kept, text_sha256``.

    Texts are equal when all their characters are. Copies are combined three
    times, each time by digest *and* full text: inside a task (the partial half
    of the first aggregate), inside a salted part of a digest's rows, and over
    the salts. So a group that holds a third of all rows reaches the last step as
    ``salts`` rows at most. The verdict then goes back to the documents by digest,
    a join of narrow rows that adaptive execution splits when one digest is hot.

    The largest doc_id of equal texts stays. A null text equals an empty one. A
    null doc_id never stays unless its whole group is null; rows that repeat an
    id and its text share the verdict. Other columns are ignored. No rows give no rows.

    ``digest`` (a Column function of the text) is there for tests: texts that
    share a digest are still told apart, by a join on the text for those digests alone.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    digest = digest or (lambda t: F.sha2(t, 256))
    rows = docs.select("doc_id", text.alias("text")).withColumn("digest", digest(F.col("text")))
    salted = rows.groupBy("digest", F.pmod(F.xxhash64("doc_id"), F.lit(salts)).alias("salt"), "text").agg(
        F.max("doc_id").alias("top"), F.count(F.lit(1)).alias("n"))
    winners = salted.groupBy("digest", "text").agg(
        F.max("top").alias("keep_id"), F.sum("n").alias("group_size"))
    verdicts = materialize(
        winners.select("digest", "keep_id", "group_size").groupBy("digest").agg(
            F.max("keep_id").alias("keep_id"), F.max("group_size").alias("group_size"),
            F.count(F.lit(1)).alias("texts")), "exact")
    # The text stays behind: only its digests travel to the verdict.
    named = rows.withColumn("text_sha256", F.sha2("text", 256))
    own = named.drop("text").join(verdicts.where("texts = 1").drop("texts"), "digest")
    shared = verdicts.where("texts > 1").select("digest")
    if not shared.isEmpty():
        told = winners.join(shared, "digest", "left_semi")
        own = own.unionByName(named.join(shared, "digest", "left_semi").join(told, ["digest", "text"]).select(
            *own.columns))
    return own.select(
        "doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"),
        "text_sha256")


def drop_copies(docs: DataFrame, salts: int = SALTS) -> DataFrame:
    """One document of each text, with all its columns: of the rows with the largest doc_id the least as JSON.

    A null text equals an empty one; no rows give no rows. Columns may have any names and types.
    Only rows that repeat such an id and its text, or have no id in a group without any, are
    compared, first inside a task, then inside a salted part, then over the salts.
    """
    groups = materialize(exact_groups(docs).where("kept").groupBy(
        F.col("doc_id").alias("id"), F.col("text_sha256").alias("digest")).agg(F.count(F.lit(1)).alias("times")), "kept")
    rows = whole_rows(docs)
    digest = F.sha2(F.coalesce(F.col("row.text"), F.lit("")), 256)
    same = F.col("row.doc_id").eqNullSafe(F.col("id")) & (digest == F.col("digest"))
    kept = rows.join(groups.where("times = 1"), same, "left_semi")
    ties = groups.where("times > 1")
    if not ties.isEmpty():
        # JSON orders any types, maps too; rows with the same JSON are the same to us.
        tied = rows.join(ties, same).select("id", "digest", F.pmod(F.spark_partition_id(), F.lit(salts)).alias("salt"),
                                            "row", F.to_json("row").alias("order"))
        part = tied.groupBy("id", "digest", "salt").agg(F.min_by("row", "order").alias("row"), F.min("order").alias("order"))
        kept = kept.unionByName(part.groupBy("id", "digest").agg(F.min_by("row", "order").alias("row")).select("row"))
    return kept.select("row.*")
