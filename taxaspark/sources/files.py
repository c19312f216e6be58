"""Readers and writers of the study's file formats, all line-parallel."""

from pyspark.sql import DataFrame, SparkSession, functions as F

from taxaspark import fixed_values as fixed, schema
from taxaspark.functions import columns as C
from taxaspark.operators.ordering import hash_positions


def _file_stem(pattern=r"([^/]+?)(?:\.[^/]*)?$"):
    return F.regexp_extract(F.col("_metadata.file_path"), pattern, 1)


def read_counts(spark: SparkSession, path: str, samples: DataFrame = None) -> DataFrame:
    """Long counts from one wide table per project (``asv<TAB>sample…``, plain or compressed).

    The project is the file name up to its first dot. With ``samples (project,
    sample_id)`` only those are kept.
    """
    return parse_counts(spark.read.text(path).select(_file_stem().alias("project"), "value"), samples)


def _cells(lines, key, first, kind):
    """Header names and body cells of wide text tables: ``(key, row, name, cell)``, zeros dropped.

    Cells are dropped while a line is split, so thousands of sample columns never
    become columns. A line whose token count differs from its header raises.
    """
    parsed = lines.select(key, F.split(F.rtrim("value"), "\t").alias("f")).where(F.size("f") > 1)
    rest = F.slice("f", 2, 1 << 30)
    headers = parsed.where(F.col("f")[0] == first).select(key, rest.alias("names"))
    body = parsed.where(F.col("f")[0] != first).join(headers, key)
    cells = F.zip_with("names", rest, lambda s, v: F.struct(s.alias("name"), kind(v).alias("cell")))
    checked = F.when(F.size(rest) == F.size("names"), cells).otherwise(
        F.raise_error(F.concat(F.lit("token count differs from header: "), F.col(key))))
    return body.select(key, F.col("f")[0].alias("row"), F.explode(F.filter(checked, lambda c: c["cell"] > 0)).alias("c")).select(
        key, "row", "c.name", "c.cell")


def parse_counts(lines: DataFrame, samples: DataFrame = None) -> DataFrame:
    """Counts from the text lines ``(project, value)`` of wide tables."""
    long = _cells(lines, "project", "asv", lambda v: v.cast("double").cast("bigint")).select(
        "project", F.col("name").alias("sample_id"), F.col("row").alias("taxon_id"), F.col("cell").alias("n"))
    if samples is not None:
        long = long.join(samples.select("project", "sample_id"), ["project", "sample_id"], "left_semi")
    return long


def read_count_headers(spark: SparkSession, path: str) -> DataFrame:
    """``(project, sample_id)`` named by the headers of wide count tables."""
    return parse_count_headers(spark.read.text(path).select(_file_stem().alias("project"), "value"))


def parse_count_headers(lines: DataFrame) -> DataFrame:
    return lines.where(F.col("value").startswith("asv\t")).select(
        "project", F.explode(F.slice(F.split("value", "\t"), 2, 1 << 30)).alias("sample_id"))


def read_clade_profiles(spark: SparkSession, path: str) -> DataFrame:
    """Species-bin abundances of a clade × sample table: ``(sample_id, taxon_id, abundance)``."""
    return parse_clades(spark.read.text(path).select(_file_stem().alias("file"), "value"))


def parse_clades(lines: DataFrame) -> DataFrame:
    """Species-bin rows of the text lines ``(file, value)`` of clade tables."""
    species = F.split(F.col("value"), "\t")[0]
    kept = lines.where((species == "clade_name") | C.species_from_clade(species).isNotNull())
    return _cells(kept, "file", "clade_name", lambda v: v.cast("double")).select(
        F.col("name").alias("sample_id"), C.species_from_clade("row").alias("taxon_id"), F.col("cell").alias("abundance"))


def _by_name(rows: DataFrame, fields) -> DataFrame:
    """The columns of a table with a header, found by name and typed."""
    return rows.select(*[F.col(f"`{f.name}`").cast(f.dataType).alias(f.name) for f in fields])


def read_sample_metadata(spark, path: str) -> DataFrame:
    return _by_name(spark.read.csv(path, sep="\t", header=True), schema.SAMPLE_METADATA)


def read_project_metadata(spark, path: str) -> DataFrame:
    return _by_name(spark.read.csv(path, header=True), schema.PROJECT_METADATA)


def read_sequences(spark, path: str) -> DataFrame:
    """``(taxon_id, seq)`` of a ``#OTU`` table; an id without the ASV prefix raises."""
    rows = spark.read.text(path).where(~F.col("value").startswith("#OTU") & (F.trim("value") != ""))
    f = F.split(F.trim("value"), "\t")
    fine = (F.size(f) == 2) & f[0].startswith("ASV")
    return rows.select(
        F.when(fine, f[0]).otherwise(F.raise_error(F.concat(F.lit("bad sequence line: "), F.col("value")))).alias("taxon_id"),
        F.get(f, F.lit(1)).alias("seq"))


def read_fasta(spark, path: str) -> DataFrame:
    """Records ``(id, description, seq)``. Files split at ``>`` at a line's start, so one file is many tasks."""
    lines = spark.read.text(path, lineSep="\n>").select(F.regexp_replace("value", "^>", "").alias("value"))
    records = lines.where(F.trim("value") != "")
    head = F.trim(F.regexp_replace(F.substring_index("value", "\n", 1), "\r", ""))
    seq = F.regexp_replace(F.regexp_replace("value", r"^[^\n]*\n?", ""), r"\s", "")
    return records.select(F.regexp_extract(head, r"^(\S*)", 1).alias("id"), head.alias("description"), seq.alias("seq"))


def write_fasta(df: DataFrame, path: str, id_col: str = "taxon_id", seq_col: str = "seq") -> None:
    df.select(F.concat(F.lit(">"), F.col(id_col), F.lit("\n"), F.col(seq_col)).alias("value")).write.text(path)


def read_hits(spark, path: str) -> DataFrame:
    """12-column tabular hits; comments, blank and short lines are skipped."""
    f = F.split(F.trim("value"), "\t")
    rows = spark.read.text(path).where(
        ~F.col("value").startswith("#") & (F.trim("value") != "") & (F.size(f) >= 12))
    kinds = ["string", "string", "double", *["int"] * 7, "double", "double"]
    return rows.select(*[f[i].cast(k).alias(c) for i, (c, k) in enumerate(zip(fixed.HIT_COLUMNS, kinds))])


def read_align_report(spark, path: str) -> DataFrame:
    """The alignment report's position columns, whatever other columns it has."""
    wide = spark.read.csv(path, sep="\t", header=True)
    return wide.select(*[F.col(x.name).cast(x.dataType).alias(x.name) for x in schema.ALIGN_REPORT])


def read_nn_lookup(spark, path: str) -> DataFrame:
    return spark.read.csv(path, sep="\t", schema=schema.NEIGHBOURS)


def write_nn_lookup(nn: DataFrame, path: str) -> None:
    nn.select("query", "answer", "similarity").write.csv(path, sep="\t")


def read_marker_index(spark, path: str) -> DataFrame:
    """``(taxon_id, marker_id, ord)`` of a JSON object taxon -> markers, or of one object per line; keys normalised.

    The text is split at the ends of the marker lists, so a large object is read
    by many tasks. Text that is no entry, and a ``]`` within a name, raises.
    """
    pieces = spark.read.text(path, lineSep="]").select(F.regexp_replace("value", r"^[\s{},]+", "").alias("entry"))
    kind = "map<string,array<string>>"
    parsed = F.from_json(F.when(F.col("entry") == "", "{}").otherwise(F.concat(F.lit("{"), "entry", F.lit("]}"))), kind)
    checked = pieces.select(F.coalesce(parsed, F.raise_error(
        F.concat(F.lit("no marker list: "), F.substring("entry", 1, 80))).cast(kind)).alias("m"))
    return checked.select(F.explode("m").alias("key", "markers")).select(
        C.normalise_taxon("key").alias("taxon_id"), F.posexplode("markers").alias("ord", "marker_id")).select(
        "taxon_id", "marker_id", "ord")


def write_marker_index(markers: DataFrame, path: str) -> None:
    """JSON lines ``{taxon: [markers…]}``, one taxon per line, markers in index order."""
    lists = markers.groupBy("taxon_id").agg(
        F.transform(F.sort_array(F.collect_list(F.struct("ord", "marker_id"))), lambda m: m["marker_id"]).alias("m"))
    lists.select(F.to_json(F.create_map("taxon_id", "m")).alias("value")).write.text(path)


def read_results(spark, path: str) -> DataFrame:
    """Evaluation tables with method, seed and ablation flag from their file names.

    ``[ABLATED__]<method>__<seed>.tsv``; baselines are ``<method>.tsv`` with a null seed.
    Columns go by the name in each file's own header; those it lacks are null.
    A line of a file without a header raises.
    """
    lines = spark.read.option("recursiveFileLookup", True).text(path).where("value <> ''").select(
        F.col("_metadata.file_path").alias("_file"), F.split("value", "\t").alias("_cells"))
    header = F.array_contains("_cells", "SampleId")
    heads = lines.where(header).groupBy("_file").agg(F.min("_cells").alias("_names"))
    placed = lines.where(~header).join(heads, "_file", "left").withColumn("_names", F.coalesce("_names", F.raise_error(
        F.concat(F.lit("no header in "), F.col("_file"))).cast("array<string>")))
    cell = lambda name: F.nullif(F.get("_cells", (F.array_position("_names", F.lit(name)) - 1).cast("int")), F.lit(""))
    table = placed.select("_file", *[cell(x.name).cast(x.dataType).alias(x.name) for x in schema.RESULTS])
    file = F.regexp_extract(F.col("_file"), r"([^/=]+)\.tsv(?:/[^/]*)?$", 1)
    named = table.withColumn("_f", file).withColumn("Ablated", F.col("_f").startswith("ABLATED__"))
    bare = F.regexp_replace("_f", "^ABLATED__", "")
    baseline = C.is_baseline(bare)
    return named.withColumn(
        "Method", F.when(baseline, bare).otherwise(F.regexp_replace(bare, "__[0-9]+$", ""))
    ).withColumn(
        "Seed", F.when(~baseline, F.nullif(F.regexp_extract(bare, "__([0-9]+)$", 1), F.lit("")).cast("int"))
    ).drop("_f", "_file")


def write_results(scores: DataFrame, path: str) -> None:
    """Metrics of one method as a table with a header, ``sample_id`` as ``SampleId``; :func:`read_results` reads it."""
    columns = [F.col("sample_id").alias("SampleId") if c == "sample_id" else F.col(c)
               for c in scores.columns if c == "sample_id" or c in schema.RESULTS.names]
    scores.select(*columns).write.mode("overwrite").csv(path, sep="\t", header=True)


def read_record_names(spark, path: str) -> DataFrame:
    """``(record, length, offset)`` of a FASTA index: offsets follow the order of the records."""
    f = F.split("value", "\t")
    return spark.read.text(path).where("value <> ''").select(
        f[0].alias("record"), F.get(f, F.lit(1)).cast("long").alias("length"), F.get(f, F.lit(2)).cast("long").alias("offset"))


def write_split(split: DataFrame, path: str) -> None:
    """``label=Train`` and ``label=Test`` tables; reading the parent gives both."""
    split.where(F.col("label").isin("Train", "Test")).write.partitionBy("label").csv(path, sep="\t", header=True)


def read_split(spark, path: str, columns) -> DataFrame:
    return spark.read.csv(path, sep="\t", header=True, schema=columns)


def write_embeddings_sharded(df: DataFrame, path: str, shard_size: int, id_col: str = "marker_id") -> None:
    """Vectors in shards of a fixed size, and an index of marker and shard.

    ``_SUCCESS`` marks a finished table.
    """
    placed = hash_positions(df, id_col, "shard").withColumn(
        "shard", F.floor(F.col("position") / shard_size).cast("int")).drop("position", "total")
    placed.repartition("shard").write.partitionBy("shard").parquet(f"{path}/vectors")
    df.sparkSession.read.parquet(f"{path}/vectors").select(
        F.col(id_col).alias("Marker"), F.col("shard").alias("Shard")
    ).write.csv(f"{path}/index", sep="\t", header=True)


def read_embeddings_sharded(spark, path: str) -> DataFrame:
    return spark.read.parquet(f"{path}/vectors")


def write_id_list(df: DataFrame, path: str, id_col: str = "taxon_id") -> None:
    """Distinct ids in order, one per line; files in order."""
    df.select(F.col(id_col).cast("string").alias("value")).distinct().orderBy("value").write.text(path)


def write_pcoa(coordinates: DataFrame, explained: DataFrame, path: str) -> None:
    """Coordinates (one column per axis) with their label, and the proportion explained."""
    k = explained.count()
    axes = [F.get("pc", F.lit(i)).alias(f"PC{i + 1}") for i in range(k)]
    label = ["label"] if "label" in coordinates.columns else []
    coordinates.select(*axes, F.col("id").alias("SampleId"), *label).write.csv(f"{path}/coordinates", sep="\t", header=True)
    explained.write.csv(f"{path}/proportion_explained", sep="\t", header=True)
