"""Baseline predictors of relative abundance.

Profiles are ``(sample_id, taxon_id, rel_abund)``, neighbour lookups ``(query,
answer, similarity)``, predictions ``(sample_id, taxon_id, pred)``.
"""

from pyspark.sql import DataFrame, functions as F

from taxaspark import fixed_values as fixed
from taxaspark.functions import columns as C
from taxaspark.lineage import materialize
from taxaspark.operators.ordering import join_on
from taxaspark.operators.profile import normalise, relative_abundance
from taxaspark.operators.sequences import best_of_lookups
from taxaspark.operators.set_join import top_similar_sets


def predict_uniform(test: DataFrame) -> DataFrame:
    """``1/n`` over the taxa present."""
    return normalise(test.withColumn("_one", F.lit(1)), "_one", "pred").select("sample_id", "taxon_id", "pred")


def training_table(train_counts: DataFrame, valid_taxa: DataFrame = None) -> DataFrame:
    """Training shares, renormalised on the valid taxa."""
    return relative_abundance(train_counts, valid_taxa)


def translate(test: DataFrame, nn: DataFrame, train: DataFrame) -> DataFrame:
    """Training taxon that stands for each test taxon.

    The lookup's answer, the best one where a query has several; without one the
    taxon itself if it trains; else null.
    """
    if "similarity" not in nn.columns:
        nn = nn.withColumn("similarity", F.lit(0.0))
    nn = best_of_lookups([nn])
    trained = train.select(F.col("taxon_id").alias("_self")).distinct()
    looked_up = test.select("sample_id", "taxon_id").join(
        nn.select(F.col("query").alias("taxon_id"), "answer"), "taxon_id", "left")
    return looked_up.join(trained, F.col("taxon_id") == F.col("_self"), "left").select(
        "sample_id", "taxon_id", F.coalesce("answer", "_self").alias("target"))


def nearest_samples(translated: DataFrame, train: DataFrame, k: int) -> DataFrame:
    """The ``k`` training samples most similar to each test sample (Jaccard on taxa): ``(sample_id, neighbour, jaccard, rank)``.

    Always ``k`` rows if so many samples train: those that share nothing follow with a similarity of 0.
    Ties go to the smaller sample id.
    """
    query = translated.select(F.col("sample_id").alias("id"), F.col("target").alias("key")).distinct()
    base = train.where("rel_abund > 0").select(F.col("sample_id").alias("id"), F.col("taxon_id").alias("key")).distinct()
    return top_similar_sets(query, base, k).select(
        F.col("id").alias("sample_id"), F.col("other").alias("neighbour"), "jaccard", "rank")


def taxon_weights(train: DataFrame, eps: float = None) -> DataFrame:
    """Geometric mean of each taxon over the training samples that have it."""
    return train.where("rel_abund > 0").groupBy(F.col("taxon_id").alias("target")).agg(
        C.geometric_mean("rel_abund", eps).alias("weight"))


def predict_nn_all(test: DataFrame, train: DataFrame, nn: DataFrame, ks=(), eps: float = None) -> DataFrame:
    """Nearest-neighbour predictions ``(k, sample_id, taxon_id, pred)`` for several ``k`` at once.

    ``k`` null is the prediction from all training samples. A taxon weighs the
    geometric mean abundance of its neighbour taxon over the ``k`` nearest
    samples that have it; where none has, over all training samples; without a
    neighbour 0. Weights are normalised per sample. The nearest samples are
    found once, for the largest ``k``. ``eps`` gives the older form with a
    constant inside the log.
    """
    translated = translate(test, nn, train)
    if ks:
        translated = materialize(translated, "translated")
    weighted = translated.join(taxon_weights(train, eps), "target", "left")
    weight = F.coalesce("weight", F.lit(0.0))
    options = [F.struct(F.lit(None).cast("int").alias("k"), weight.alias("weight"))]
    if ks:
        near = materialize(
            nearest_samples(translated, train, max(ks)).select("sample_id", "neighbour", "rank"), "nearest")
        wanted = translated.where("target is not null").select("sample_id", "target").distinct()
        abundances = train.where("rel_abund > 0").select(
            F.col("sample_id").alias("neighbour"), F.col("taxon_id").alias("target"), "rel_abund")
        among = lambda k: F.when(F.col("rank") <= k, F.col("rel_abund"))
        local = (
            near.join(abundances, "neighbour").join(wanted, ["sample_id", "target"], "left_semi")
            .groupBy("sample_id", "target")
            .agg(*[C.geometric_mean(among(k), eps).alias(f"local_{k}") for k in ks])
        )
        weighted = weighted.join(local, ["sample_id", "target"], "left")
        options += [F.struct(F.lit(k).alias("k"), F.coalesce(f"local_{k}", weight).alias("weight")) for k in ks]
    long = weighted.select("sample_id", "taxon_id", F.explode(F.array(*options)).alias("o")).select(
        "sample_id", "taxon_id", "o.k", "o.weight")
    totals = long.groupBy("k", "sample_id").agg(F.sum("weight").alias("_total"))
    return join_on(long, totals, ["k", "sample_id"]).select(
        "k", "sample_id", "taxon_id", F.try_divide("weight", "_total").alias("pred"))


def predict_nn(test: DataFrame, train: DataFrame, nn: DataFrame, k: int = None, eps: float = None) -> DataFrame:
    """One nearest-neighbour prediction, from all training samples or the ``k`` nearest."""
    every = predict_nn_all(test, train, nn, () if k is None else (k,), eps)
    return every.where(F.col("k").eqNullSafe(F.lit(k))).select("sample_id", "taxon_id", "pred")


def predict_tree_nn(test: DataFrame, train: DataFrame, closest: DataFrame) -> DataFrame:
    """Prediction from the closest leaf of a tree, ``closest (query, answer)``; unknown leaves weigh 0."""
    return predict_nn(test, train, closest, eps=fixed.GEOMETRIC_MEAN_EPS)


def empty_predictions(predictions: DataFrame) -> DataFrame:
    """Samples whose weights are all zero, so that no prediction exists."""
    return predictions.groupBy("sample_id").agg(F.max("pred").alias("top")).where(
        "top is null or top = 0").select("sample_id")


def log_predictions(predictions: DataFrame, mask: DataFrame = None, keys=("sample_id",)) -> DataFrame:
    """Smoothed, optionally masked to ``mask (taxon_id)``, renormalised log predictions ``lp``."""
    smoothed = predictions.withColumn("_p", F.col("pred") + F.lit(fixed.PREDICTION_SMOOTHING))
    if mask is not None:
        smoothed = smoothed.join(mask.select("taxon_id"), "taxon_id", "left_semi")
    return normalise(smoothed, "_p", "_p", keys).select(*keys, "taxon_id", F.ln("_p").alias("lp"))
