"""Cohort, depth-band, prevalence and richness filters, and project reports."""

from pyspark.sql import DataFrame, functions as F

from taxaspark import fixed_values as fixed
from taxaspark.functions import columns as C
from taxaspark.lineage import materialize
from taxaspark.operators.ordering import exact_quantiles, join_on, medians
from taxaspark.operators.profile import prevalence, read_depth, richness


def cohort_amplicon(samples: DataFrame, isos, instrument: str) -> DataFrame:
    return samples.where(F.col("iso").isin(list(isos)) & (F.col("instrument") == instrument))


def cohort_healthy_adults(metadata: DataFrame) -> DataFrame:
    return metadata.where("age_category = 'adult' and disease = 'healthy'")


def cohort_projects(projects: DataFrame, condition: str, subjects: str, amplicons) -> DataFrame:
    return projects.where(
        (F.col("condition") == condition) & (F.col("subjects") == subjects)
        & F.col("amplicon").isin(list(amplicons))
    )


def attach_depth(samples: DataFrame, counts: DataFrame) -> DataFrame:
    return samples.join(read_depth(counts), "sample_id", "left")


def depth_band(samples: DataFrame, by=("project",), q=fixed.DEPTH_QUANTILES) -> DataFrame:
    """Samples whose depth lies in the quantile band (inclusive) of their group."""
    bounds = exact_quantiles(samples, by, "read_counts", {"depth_lb": q[0], "depth_ub": q[1]})
    return join_on(samples, bounds, list(by)).where(
        F.col("read_counts").between(F.col("depth_lb"), F.col("depth_ub"))
    )


def depth_summary(samples: DataFrame, by=("project",)) -> DataFrame:
    """count, mean, std, min, quartiles and max of the read depth."""
    by = list(by)
    depth = F.col("read_counts").cast("double")
    basic = samples.groupBy(*by).agg(
        F.count(depth).alias("n"), F.avg(depth).alias("mean"), F.stddev_samp(depth).alias("std"),
        F.min(depth).alias("min"), F.max(depth).alias("max"),
    )
    quartiles = exact_quantiles(samples, by, "read_counts", {"q25": 0.25, "q50": 0.5, "q75": 0.75})
    return join_on(basic, quartiles, by)


def filter_samples_and_taxa(
    projects: DataFrame, samples: DataFrame, counts: DataFrame, sequences: DataFrame,
    read_count_lb=fixed.READ_COUNT_LB, sample_count_lb=fixed.SAMPLE_COUNT_LB,
    min_taxa=fixed.MIN_TAXA, max_taxa=fixed.MAX_TAXA, q=fixed.DEPTH_QUANTILES,
) -> dict:
    """Depth band per project, taxon prevalence, sample richness, cross-references.

    Returns frames ``projects``, ``samples``, ``taxa``, ``sequences`` and the
    one-row ``max_taxa``.
    """
    # Sample and taxon lists are small next to the counts: written once, their
    # size is known and the counts are scanned, not recomputed, for each step.
    banded = materialize(depth_band(attach_depth(samples, counts), q=q), "banded")
    kept_counts = counts.join(banded.select("sample_id"), "sample_id", "left_semi")
    common = prevalence(kept_counts, read_count_lb).where(F.col("n_samples") >= sample_count_lb)
    common = materialize(common, "common")
    common_counts = kept_counts.join(common.select("taxon_id"), "taxon_id", "left_semi")
    rich = richness(common_counts).where(F.col("n_taxa").between(min_taxa, max_taxa))
    rich = materialize(rich, "rich")
    kept_samples = banded.join(rich, "sample_id")
    # Every common taxon of a remaining project stays, as its table keeps its row.
    taxa = common.select("taxon_id")
    return {
        "projects": projects.join(kept_samples.select("project"), "project", "left_semi"),
        "samples": kept_samples,
        "counts": common_counts.join(rich.select("sample_id"), "sample_id", "left_semi"),
        "taxa": taxa,
        "sequences": sequences.join(taxa, "taxon_id", "left_semi"),
        "max_taxa": kept_samples.agg(F.max("n_taxa").alias("max_taxa")),
    }


def new_taxa_per_project(project_taxa: DataFrame, order: DataFrame) -> DataFrame:
    """Taxa a project adds to those of the projects before it in ``order (project, ord)``."""
    first = (
        project_taxa.join(order, "project").groupBy("taxon_id").agg(F.min_by("project", "ord").alias("project"))
    )
    added = first.groupBy("project").agg(F.count(F.lit(1)).alias("n_new"))
    return order.join(added, "project", "left").select(
        "project", F.coalesce("n_new", F.lit(0).cast("long")).alias("n_new")
    )


def project_summary(samples: DataFrame) -> DataFrame:
    """Regions, countries and number of samples per project.

    Reduced to the distinct labels first, so the collected sets hold labels only.
    """
    per_label = samples.groupBy("project", "region", "iso").agg(F.count(F.lit(1)).alias("_n"))
    return per_label.groupBy("project").agg(
        F.sort_array(F.collect_set("region")).alias("regions"),
        F.sort_array(F.collect_set("iso")).alias("isos"),
        F.sum("_n").alias("n_samples"),
    )


def value_counts(df: DataFrame, *columns) -> DataFrame:
    return df.groupBy(*columns).agg(F.count(F.lit(1)).alias("count"))


def samples_per_project(projects: DataFrame, samples: DataFrame) -> DataFrame:
    """Project metadata with the number of samples (null without any), by mean length."""
    n = samples.groupBy("project").agg(F.count("sample_id").alias("n_samples"))
    return projects.join(n, "project", "left").orderBy("avg_length", "project")


def counts_on_reference(df: DataFrame, label: str, reference: DataFrame, name: str) -> DataFrame:
    """Row counts per label left-joined to a reference list; labels off the list are dropped."""
    counts = df.where(F.col(label).isNotNull()).groupBy(F.col(label).alias(name)).agg(
        F.count(F.lit(1)).alias("count")
    )
    return reference.select(name).join(counts, name, "left")


def missing_label_count(df: DataFrame, label: str) -> DataFrame:
    return df.agg(F.count_if(F.col(label).isNull()).alias("n_missing"))


def fold_rare(df: DataFrame, label: str, lb: int = fixed.FOLD_COUNT_LB) -> DataFrame:
    """Replace labels with at most ``lb`` rows by ``Other``."""
    frequent = df.groupBy(label).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > lb)
    marked = df.join(frequent.withColumnRenamed(label, "_kept"), F.col(label) == F.col("_kept"), "left")
    return marked.withColumn(label, F.coalesce("_kept", F.lit("Other"))).drop("_kept", "_n")


def richness_distribution(profile: DataFrame, value: str = "rel_abund") -> DataFrame:
    """Median, 5 % and 95 % quantile of the number of taxa per sample."""
    per_sample = richness(profile, value)
    return exact_quantiles(per_sample, [], "n_taxa", {"median": 0.5, "q05": 0.05, "q95": 0.95})


def rich_samples(profile: DataFrame, lb: int = fixed.SPECIES_MIN_TAXA, value: str = "rel_abund") -> DataFrame:
    return richness(profile, value).where(F.col("n_taxa") >= lb)


def clean_countries(samples: DataFrame, geo: str) -> DataFrame:
    return samples.withColumn("country", C.clean_country(geo))


def amplicon_region(report: DataFrame, project_taxa: DataFrame, samples: DataFrame) -> DataFrame:
    """Median start and end of a project's taxa on the template, and the length between."""
    placed = project_taxa.join(report, project_taxa.taxon_id == report.QueryName)
    start = medians(placed, ["project"], "TemplateStart", "start")
    end = medians(placed, ["project"], "TemplateEnd", "end")
    n = samples.groupBy("project").agg(F.count(F.lit(1)).alias("n_samples"))
    whole = lambda c: F.col(c).cast("long").alias(c)
    return (
        start.join(end, "project").join(n, "project")
        .select("project", "n_samples", whole("start"), whole("end"))
        .withColumn("length", F.col("end") - F.col("start") + 1)
    )


def amplicon_span_mode(fragments: DataFrame, reference: DataFrame, by=("project",)) -> DataFrame:
    """Most common first and (last + 1) reference coordinate of a project's fragments.

    ``fragments (…, aln)`` and one aligned reference row ``(…, ref)`` per project.
    Equal counts resolve to the smaller coordinate.
    """
    by = list(by)
    span = fragments.join(reference, by).withColumn("span", C.non_gap_span("aln", "ref"))
    long = span.select(
        *by, F.explode(F.array(
            F.struct(F.lit("first").alias("side"), F.col("span.first").alias("at")),
            F.struct(F.lit("last").alias("side"), F.col("span.last").alias("at")),
        )).alias("e")
    ).select(*by, "e.side", "e.at").where("at is not null")
    counted = long.groupBy(*by, "side", "at").agg(F.count(F.lit(1)).alias("_n"))
    mode = counted.groupBy(*by).agg(*[
        F.max_by(F.when(F.col("side") == side, F.col("at")),
                 F.when(F.col("side") == side, F.struct("_n", -F.col("at")))).alias(name)
        for side, name in (("first", "start"), ("last", "end"))
    ])
    return mode.withColumn("end", F.col("end") + 1)


def sequence_length_histogram(sequences: DataFrame, bins: int = 100) -> DataFrame:
    """Equal-width histogram of sequence lengths from the shortest to the longest."""
    lengths = sequences.select(F.length("seq").alias("len"))
    lo = lengths.agg(F.min("len")).scalar()
    hi = lengths.agg(F.max("len")).scalar()
    bounded = lengths.withColumn("lo", lo).withColumn("max_len", hi)
    width = (F.col("max_len") - F.col("lo")).cast("double") / bins
    bin_no = F.when(F.col("max_len") == F.col("lo"), F.lit(0)).otherwise(
        F.least(F.floor(F.try_divide(F.col("len") - F.col("lo"), width)), F.lit(bins - 1))
    )
    return bounded.groupBy(bin_no.cast("int").alias("bin"), "max_len").agg(
        F.count(F.lit(1)).alias("n")
    )


def marker_counts(markers: DataFrame) -> DataFrame:
    return markers.groupBy("taxon_id").agg(F.count("marker_id").alias("n_markers"))


def marker_totals(markers: DataFrame) -> DataFrame:
    per_taxon = marker_counts(markers)
    return per_taxon.agg(
        F.count(F.lit(1)).alias("n_taxa"), F.sum("n_markers").alias("n_markers"),
        F.max("n_markers").alias("max_markers"),
    )
