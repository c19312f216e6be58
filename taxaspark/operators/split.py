"""Train/test splits of samples. Labels are ``Train``, ``Test`` and ``Excluded``."""


from pyspark.sql import Column, DataFrame, functions as F

from taxaspark import fixed_values as fixed
from taxaspark.lineage import materialize
from taxaspark.operators.distance import similarities
from taxaspark.operators.fiedler import fiedler_vectors
from taxaspark.operators.graph import component_sizes, components, similarity_graph
from taxaspark.operators.ordering import exact_quantiles, hash_positions, ordered_positions, running_totals
from taxaspark.operators.ordination import pcoa


def split_random(samples: DataFrame, train_fraction: float, test_fraction: float, seed: int) -> DataFrame:
    """Exactly ``int(n·f)`` samples each, in the order of a seeded hash of the id."""
    placed = hash_positions(samples, "sample_id", seed)
    n_train = F.floor(F.col("total") * F.lit(train_fraction))
    n_test = F.floor(F.col("total") * F.lit(test_fraction))
    return placed.withColumn(
        "label",
        F.when(F.col("position") < n_train, "Train")
        .when(F.col("position") < n_train + n_test, "Test").otherwise("Excluded"),
    ).drop("position", "total")


def split_per_project(samples: DataFrame, seed: int, train_test_ratio: float = 4.0) -> DataFrame:
    """``int(n·f)`` training samples of each project, the rest test."""
    fraction = train_test_ratio / (1 + train_test_ratio)
    placed = hash_positions(samples, "sample_id", seed, keys=["project"])
    return placed.withColumn(
        "label", F.when(F.col("position") < F.floor(F.col("total") * F.lit(fraction)), "Train").otherwise("Test")
    ).drop("position", "total")


def split_greedy_projects(samples: DataFrame, train_test_ratio: float = 4.0) -> DataFrame:
    """Whole projects by size, largest first, to training until its quota is used up.

    A project trains when the samples of the projects before it are below the
    quota; equal sizes go by project id.
    """
    fraction = train_test_ratio / (1 + train_test_ratio)
    sizes = samples.groupBy("project").agg(F.count(F.lit(1)).alias("_n"))
    # Prefix sums over ranges of (size, project): equal sizes spread like any others.
    placed = running_totals(sizes, [F.desc("_n"), F.asc("project")], "_n", "_before")
    total = samples.agg(F.count(F.lit(1))).scalar()
    chosen = placed.withColumn("_quota", F.floor(total * F.lit(fraction))).select(
        "project",
        F.when(F.col("_before") < F.col("_quota"), "Train").otherwise("Test").alias("label"))
    return samples.join(chosen, "project")


def leave_one_out_folds(samples: DataFrame) -> DataFrame:
    """``(fold, n_test, n_train)``: the projects, each the test set of one fold.

    With :func:`leave_one_out_label` this is the whole split; samples are
    multiplied by folds only where :func:`split_leave_one_out` is asked for.
    """
    sizes = samples.groupBy(F.col("project").alias("fold")).agg(F.count(F.lit(1)).alias("n_test"))
    return sizes.withColumn("n_train", samples.agg(F.count(F.lit(1))).scalar() - F.col("n_test"))


def leave_one_out_label(fold, project="project"):
    """Label of a sample in a fold; ``fold`` is a project id or a column."""
    same = F.col(project).eqNullSafe(fold if isinstance(fold, Column) else F.lit(fold))
    return F.when(same, "Test").otherwise("Train")


def leave_one_out(samples: DataFrame, fold) -> DataFrame:
    """One fold, as a map over the samples."""
    return samples.withColumn("label", leave_one_out_label(fold))


def split_leave_one_out(samples: DataFrame, chunk: int = 256) -> DataFrame:
    """Every fold expanded: projects × samples rows, each project being the test set once.

    The fold list is cut into chunks of ``chunk`` neighbouring projects. A sample
    is copied once per chunk and expanded inside its row. The chunks are a table of
    known size: a short list is broadcast, a long one has so many chunks that
    their copies spread over the tasks.
    """
    folds = ordered_positions(samples.select("project").distinct(), "project", "project")
    chunks = folds.groupBy(F.floor(F.col("position") / chunk).alias("_chunk")).agg(F.collect_list(F.struct("project")).alias("_folds"))
    last = materialize(chunks, "folds")
    n = F.coalesce(last.agg(F.max("_chunk")).scalar(), F.lit(-1).cast("long"))
    spread = samples.withColumn("_n", n).where("_n >= 0").withColumn(
        "_chunk", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_n")))).drop("_n")
    # Structs, because a list leaves nulls out: samples without a project are a fold too.
    expanded = spread.join(last, "_chunk").withColumn("_fold", F.explode("_folds")).withColumn(
        "fold", F.col("_fold.project")).drop("_chunk", "_folds", "_fold")
    return expanded.withColumn("label", leave_one_out_label(F.col("fold")))


def restrict_split(split: DataFrame, projects) -> DataFrame:
    return split.where(F.col("project").isin(list(projects)))


def tail_split(values: DataFrame, left_q: float, right_q: float, left: str, right: str,
               keys=()) -> DataFrame:
    """Label ``value < quantile(left_q)`` and ``value ≥ quantile(right_q)``, the rest ``Excluded``.

    A value in both tails gets the left label.
    """
    keys = list(keys)
    bounds = exact_quantiles(values, keys, "value", {"lo": left_q, "hi": right_q})
    if keys:
        ranged = values.join(bounds, keys)
    else:
        ranged = values.withColumn("lo", bounds.select("lo").scalar()).withColumn(
            "hi", bounds.select("hi").scalar())
    return ranged.withColumn(
        "label",
        F.when(F.col("value") < F.col("lo"), left).when(F.col("value") >= F.col("hi"), right)
        .otherwise("Excluded")).drop("lo", "hi")


def split_pcoa(distances: DataFrame, train_fraction: float, test_fraction: float,
               train_is_left: bool = True, coordinates: DataFrame = None, seed: int = 0, **eigen) -> DataFrame:
    """Split at the tails of the first principal coordinate: ``(id, value, label)``."""
    if coordinates is None:
        coordinates, _ = pcoa(distances, 2, seed=seed, **eigen)
    values = coordinates.select("id", F.col("pc")[0].alias("value"))
    if train_is_left:
        return tail_split(values, train_fraction, 1 - test_fraction, "Train", "Test")
    return tail_split(values, test_fraction, 1 - train_fraction, "Test", "Train")


def split_spectral(distances: DataFrame, train_fraction: float, test_fraction: float,
                   seed: int = 0, **eigen) -> DataFrame:
    """Spectral split of the similarity graph: ``(id, component, value, label)``.

    Components of up to five samples train whole; each larger one is cut at the
    tails of its Fiedler vector. All components are iterated together, whatever their
    sizes. Entries that agree to seven digits of the component's largest are ties and get one label.
    """
    distances = materialize(distances.select("a", "b", "d"), "distances")
    edges = materialize(similarity_graph(similarities(distances)), "edges")
    nodes = distances.select(F.col("a").alias("id")).unionByName(
        distances.select(F.col("b").alias("id"))).distinct()
    assigned = materialize(components(nodes, edges), "assigned")
    sizes = materialize(component_sizes(assigned), "sizes")
    small = F.col("size") <= fixed.SMALL_COMPONENT
    among = lambda condition: assigned.join(sizes.where(condition), "component", "left_semi")
    values = materialize(fiedler_vectors(edges, among(~small), seed=seed, **eigen), "vectors")
    largest = values.groupBy("component").agg(F.max("value").alias("largest"))  # the signs make it the largest by magnitude
    even = materialize(values.join(largest, "component").select(
        "component", "id", (F.round(F.col("value") / F.col("largest"), 7) * F.col("largest")).alias("value")), "fiedler")
    cut = tail_split(even, test_fraction, 1 - train_fraction, "Test", "Train", keys=["component"])
    whole = among(small).select("id", "component", F.lit(None).cast("double").alias("value"), F.lit("Train").alias("label"))
    return whole.unionByName(cut.select("id", "component", "value", "label"))


def train_test_split(samples: DataFrame, train_fraction: float, test_fraction: float, method: str,
                     distances: DataFrame = None, seed: int = 0, coordinates: bool = False, axes: int = 2, **options):
    """Samples with a label, by method ``random``, ``pcoa`` or ``spectral-mincut``.

    ``coordinates=True`` gives also the ordination ``(id, pc)`` as a pair ``(split,
    coordinates)``: for ``pcoa`` the one the split was made from; the other methods compute
    it from ``distances`` where given, else it is ``None``.
    """
    if coordinates:
        placed = None if distances is None else materialize(pcoa(distances, axes, seed=seed)[0], "coordinates")
        if method == "pcoa":
            options = {"coordinates": placed, **options}
        labelled = _labelled(samples, train_fraction, test_fraction, method, distances, seed, options)
        return labelled, options.get("coordinates", placed)
    return _labelled(samples, train_fraction, test_fraction, method, distances, seed, options)


def _labelled(samples, train_fraction, test_fraction, method, distances, seed, options):
    if method == "random":
        return split_random(samples, train_fraction, test_fraction, seed)
    if method == "pcoa":
        labels = split_pcoa(distances, train_fraction, test_fraction, seed=seed, **options)
    elif method == "spectral-mincut":
        labels = split_spectral(distances, train_fraction, test_fraction, seed=seed, **options)
    else:
        raise ValueError(f"unsupported split method {method!r}")
    labels = labels.select(F.col("id").alias("sample_id"), "label")
    return samples.join(labels, "sample_id", "left").withColumn(
        "label", F.coalesce("label", F.lit("Excluded")))


def label_coordinates(coordinates: DataFrame, train: DataFrame, test: DataFrame, metadata: DataFrame) -> DataFrame:
    """Coordinates with ``Train``/``Test``/``Excluded`` and the sample's metadata."""
    labels = train.select("sample_id", F.lit("Train").alias("label")).unionByName(
        test.select("sample_id", F.lit("Test").alias("label")))
    placed = coordinates.join(labels, coordinates["id"] == labels["sample_id"], "left").drop("sample_id")
    placed = placed.withColumn("label", F.coalesce("label", F.lit("Excluded")))
    return placed.join(metadata, placed["id"] == metadata["sample_id"], "left").drop("sample_id")


def split_sizes(split: DataFrame) -> DataFrame:
    """One row: samples, train, test and their ratio."""
    is_ = lambda label: F.count_if(F.col("label") == label)
    sizes = split.agg(F.count(F.lit(1)).alias("n_total"), is_("Train").alias("n_train"), is_("Test").alias("n_test"))
    return sizes.withColumn("ratio", F.try_divide(F.col("n_train"), F.col("n_test")))
