"""Checks as queries: each returns the rows that violate it."""

from pyspark.sql import DataFrame, functions as F

from taxaspark import fixed_values as fixed


def sum_violations(profile: DataFrame, tolerance: float = fixed.PROFILE_SUM_TOLERANCE) -> DataFrame:
    """Samples whose abundances do not sum to 1."""
    return profile.groupBy("sample_id").agg(F.sum("rel_abund").alias("total")).where(
        F.abs(F.col("total") - 1) > tolerance)


def metadata_violations(ids: DataFrame, metadata: DataFrame, id_col: str = "srs") -> DataFrame:
    """Requested samples without exactly one metadata row."""
    counted = metadata.groupBy(F.col(id_col).alias("sample_id")).agg(F.count(F.lit(1)).alias("n"))
    return ids.select("sample_id").join(counted, "sample_id", "left").select(
        "sample_id", F.coalesce("n", F.lit(0).cast("long")).alias("n")).where("n <> 1")


def bad_sample_ids(samples: DataFrame) -> DataFrame:
    """Sample ids without an accession prefix."""
    return samples.where(~F.col("sample_id").rlike(f"^({'|'.join(fixed.SAMPLE_ID_PREFIXES)})"))


def missing_from_header(requested: DataFrame, header: DataFrame) -> DataFrame:
    """Requested ``(project, sample_id)`` that the project's count table does not have."""
    return requested.select("project", "sample_id").join(header, ["project", "sample_id"], "left_anti")


def split_overlap(train: DataFrame, test: DataFrame) -> DataFrame:
    """Samples in both training and test."""
    return train.select("sample_id").intersect(test.select("sample_id"))


def unknown_answers(nn: DataFrame, train: DataFrame) -> DataFrame:
    """Lookup rows whose answer is not a training taxon."""
    taxa = train.select(F.col("taxon_id").alias("answer")).distinct()
    return nn.join(taxa, "answer", "left_anti")


def unnormalised_predictions(predictions: DataFrame, tolerance: float = fixed.PROFILE_SUM_TOLERANCE) -> DataFrame:
    """Samples whose log predictions do not have log-sum-exp 0."""
    return predictions.groupBy("sample_id").agg(F.ln(F.sum(F.exp("lp"))).alias("logsumexp")).where(
        F.abs("logsumexp") > tolerance)


def unaligned_sequences(sequences: DataFrame, alignment: DataFrame) -> DataFrame:
    return sequences.join(alignment.select("taxon_id"), "taxon_id", "left_anti")


def alignment_lengths(alignment: DataFrame) -> DataFrame:
    """Lengths that occur; more than one row means the alignment is ragged."""
    return alignment.groupBy(F.length("aln").alias("length")).agg(F.count(F.lit(1)).alias("n"))


def missing_runs(results: DataFrame, expected: DataFrame = None) -> DataFrame:
    """``(Method, missing)``: expected seeds a method lacks, all observed seeds by default.

    Methods without any seed are not checked. Seeds are the columns of a
    report, so their list is short.
    """
    seeded = results.where("Seed is not null").select("Method", "Seed").distinct()
    wanted = (seeded if expected is None else expected).select("Seed").distinct()
    every = wanted.agg(F.collect_set("Seed")).scalar()
    present = seeded.groupBy("Method").agg(F.collect_set("Seed").alias("_have"))
    return present.withColumn("_all", every).select(
        "Method", F.explode(F.array_except("_all", "_have")).alias("Seed"))


def sample_set_difference(x: DataFrame, y: DataFrame) -> DataFrame:
    """Samples in only one of two evaluations."""
    xs, ys = x.select("SampleId").distinct(), y.select("SampleId").distinct()
    return xs.exceptAll(ys).withColumn("only_in", F.lit("first")).unionByName(
        ys.exceptAll(xs).withColumn("only_in", F.lit("second")))
