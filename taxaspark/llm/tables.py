"""Reading tables, held-out marks and tables between steps."""

from pyspark.sql import DataFrame, functions as F

from taxaspark.lineage import materialize, scratch_path  # noqa: F401

DOCUMENT = ("doc_id", "text", "lang", "source", "n_chars")


def table(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def whole_rows(docs: DataFrame) -> DataFrame:
    """The documents as one column ``row``, so that no name of theirs clashes with a step's own."""
    return docs.select(F.struct(*[F.col("`" + c.replace("`", "``") + "`") for c in docs.columns]).alias("row"))


def remainder(modulus: int, column="doc_id"):
    """crc32 of the id as text, modulo ``modulus``; of a null id null."""
    return F.crc32(F.col(column).cast("string")) % F.lit(modulus)


def held_out(modulus: int, value: int, column="doc_id"):
    """Whether a document is held out; one without an id is not, and has no label to learn from."""
    return F.coalesce(remainder(modulus, column) == value, F.lit(False))


def usable_labels(labels: DataFrame, label: str, modulus: int, value: int) -> DataFrame:
    """``(doc_id, label)`` of the rows to learn from: an id, a label of 0 or 1, not held out."""
    return labels.select("doc_id", F.col(label).cast("int").alias("label")).where(
        ~held_out(modulus, value) & F.col("label").isin(0, 1)).dropna().distinct()


def class_shares(labels: DataFrame, label: str, modulus: int, value: int) -> dict:
    """Share of each class among all usable labels."""
    counts = usable_labels(labels, label, modulus, value).groupBy("label").count().collect()
    total = sum(r["count"] for r in counts)
    return {k: sum(r["count"] for r in counts if r["label"] == k) / max(total, 1) for k in (0, 1)}


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, modulus: int, value: int,
                    per_class: dict) -> DataFrame:
    """``(doc_id, text, label)`` of training rows, at most ``per_class[k]`` of label k.

    The bound on the sample is the caller's parameter; which rows it takes follows
    a hash of the id, so it is the same on every run.
    """
    usable = usable_labels(labels, label, modulus, value)
    picked = None
    for k, n in per_class.items():
        part = usable.where(F.col("label") == k).orderBy(F.xxhash64("doc_id"), "doc_id").limit(n)
        picked = part if picked is None else picked.unionByName(part)
    # The picked rows are bounded by the parameter: safe to broadcast at any size of the tables.
    return docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id")
