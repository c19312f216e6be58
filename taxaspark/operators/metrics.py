"""Per-sample prediction metrics, losses, masked log-softmax."""

import math

from pyspark.sql import DataFrame, functions as F

from taxaspark import fixed_values as fixed
from taxaspark.functions import columns as C
from taxaspark.lineage import materialize
from taxaspark.operators.ordering import join_on, ordered_histogram, tie_averaged_rank


def _paired(predictions, truth, keys):
    on = list(keys) + ["taxon_id"]
    t = truth.select("sample_id", "taxon_id", F.col("rel_abund").alias("t"))
    how = [k for k in on if k in t.columns]
    return predictions.join(t, how)


def prediction_gaps(predictions: DataFrame, truth: DataFrame, keys=("sample_id",)) -> DataFrame:
    """``(…keys, taxon_id)`` of true taxa that a group with predictions has none for."""
    keys = list(keys)
    wanted = predictions.select(*keys).distinct().join(truth.select("sample_id", "taxon_id"), "sample_id")
    return wanted.join(predictions.select(*keys, "taxon_id"), [*keys, "taxon_id"], "left_anti").select(*keys, "taxon_id")


def _without_gaps(groups: DataFrame, truth: DataFrame, keys, count: str) -> DataFrame:
    """``groups`` with their ``count`` of predicted taxa; any sample or taxon of the truth left out raises.

    Every combination of the other keys must have all samples of the truth, and
    each sample all its taxa.
    """
    others = [k for k in keys if k != "sample_id"]
    wanted = truth.groupBy("sample_id").agg(F.count(F.lit(1)).alias("_wanted"))
    checked = groups.join(wanted, "sample_id", "left" if others else "right")
    if others:
        n = truth.agg(F.count_distinct("sample_id")).scalar()
        checked = join_on(checked, groups.groupBy(*others).agg(F.count(F.lit(1)).alias("_samples")), others)
        whole = (F.col(count) == F.col("_wanted")) & (F.col("_samples") == n)
    else:
        whole = F.col(count) == F.col("_wanted")
    guarded = F.when(F.coalesce(whole, F.lit(False)), F.col(count)).otherwise(F.raise_error(F.concat(
        F.lit("predictions do not cover the true taxa of sample "), F.coalesce("sample_id", F.lit("(null)"))))
        .cast("long"))
    return checked.withColumn(count, guarded).select(groups.columns)


def average_ranks(df: DataFrame, keys, value: str, out: str) -> DataFrame:
    """Tie-averaged rank (from 1) of ``value`` within its group."""
    keys = list(keys)
    df = df.withColumn("_v", F.col(value).cast("double"))
    ranks = ordered_histogram(df.select(*keys, "_v"), keys, "_v").select(*keys, "_v", tie_averaged_rank().alias(out))
    return join_on(df, ranks, keys + ["_v"]).drop("_v")


def average_ranks_of(df: DataFrame, keys, ranked: dict) -> DataFrame:
    """Tie-averaged ranks of several columns, ``{value: out}``, from one ordering of (group, column, value).

    A row with a null or NaN in any of them has no rank and goes.
    """
    keys = list(keys)
    names = list(ranked)
    doubles = df.withColumns({f"_v{i}": F.col(c).cast("double") for i, c in enumerate(names)})
    sides = F.explode(F.array(*[F.struct(F.lit(i).alias("side"), F.col(f"_v{i}").alias("v")) for i in range(len(names))]))
    long = doubles.select(*keys, sides.alias("_s")).select(*keys, F.col("_s.side").alias("_side"), F.col("_s.v").alias("_v"))
    ranks = materialize(ordered_histogram(long, [*keys, "_side"], "_v").select(
        *keys, "_side", "_v", tie_averaged_rank().alias("_rank")), "ranks")
    for i, c in enumerate(names):
        own = ranks.where(F.col("_side") == i).select(*keys, F.col("_v").alias(f"_v{i}"), F.col("_rank").alias(ranked[c]))
        doubles = join_on(doubles, own, [*keys, f"_v{i}"])
    return doubles.drop(*[f"_v{i}" for i in range(len(names))])


def spearman(df: DataFrame, keys, x: str, y: str) -> DataFrame:
    """Rank correlation per group; null when either side is constant."""
    keys = list(keys)
    ranked = average_ranks_of(df, keys, {x: "_rx", y: "_ry"})
    # Sums of centred ranks need no second pass: the mean rank is (n + 1) / 2.
    sums = ranked.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("_n"), F.sum(F.col("_rx") * F.col("_ry")).alias("_xy"),
        F.sum(F.col("_rx") * F.col("_rx")).alias("_xx"), F.sum(F.col("_ry") * F.col("_ry")).alias("_yy"))
    centre = F.col("_n") * F.pow(F.col("_n") + 1, F.lit(2)) / 4
    sx, sy = F.col("_xx") - centre, F.col("_yy") - centre
    rho = F.when((sx > 1e-9) & (sy > 1e-9), (F.col("_xy") - centre) / F.sqrt(sx * sy))
    return sums.select(*keys, rho.alias("SpearmanCorr"))


def evaluation_violations(predictions: DataFrame, truth: DataFrame, keys=("sample_id",), groups: DataFrame = None,
                          prediction_tolerance: float = fixed.PROFILE_SUM_TOLERANCE,
                          truth_tolerance: float = fixed.PROFILE_SUM_TOLERANCE) -> DataFrame:
    """``(…keys, violation)`` of predictions or truth that cannot be scored as they are.

    ``no prediction``: a sample of the truth that a group lacks, for every group found or listed
    in ``groups`` (all keys but the sample); ``not in truth``: a sample or taxon beyond the
    truth; ``missing taxon``; ``prediction sum`` and ``truth sum``: shares that do not sum to 1 within the
    tolerance (an infinite or missing sum included). Keys of a truth's own violation are null but the sample.
    """
    keys = list(keys)
    others = [k for k in keys if k != "sample_id"]
    cells = truth.select("sample_id", "taxon_id", F.lit(True).alias("_true"))
    sample = truth.groupBy("sample_id").agg(F.count(F.lit(1)).alias("_wanted"), F.sum("rel_abund").alias("_sum"))
    joined = predictions.select(*keys, "taxon_id", "lp").join(cells, ["sample_id", "taxon_id"], "left")
    found = joined.groupBy(*keys).agg(
        F.count("_true").alias("_hit"), F.count(F.lit(1)).alias("_all"), F.sum(F.exp("lp")).alias("_total"))
    off = lambda total, tolerance: ~F.coalesce(F.abs(F.col(total) - 1) <= tolerance, F.lit(False))
    flags = F.filter(F.array(
        F.when(F.col("_hit") < F.col("_all"), "not in truth"),
        F.when(F.col("_hit") < F.coalesce("_wanted", F.lit(0).cast("long")), "missing taxon"),
        F.when(off("_total", prediction_tolerance), "prediction sum")), lambda x: x.isNotNull())
    bad = found.join(sample, "sample_id", "left").select(*keys, F.explode(flags).alias("violation"))
    wrong_truth = sample.where(off("_sum", truth_tolerance)).select(
        *[F.col(k) if k == "sample_id" else F.lit(None).cast(predictions.schema[k].dataType).alias(k) for k in keys],
        F.lit("truth sum").alias("violation"))
    listed = found.select(*others).distinct() if others else None
    if others and groups is not None:
        listed = listed.unionByName(groups.select(*others)).distinct()
    wanted = sample.select("sample_id")
    if others:
        # One row per group and sample: as many as the predictions must have.
        wanted = listed.withColumn("_one", F.lit(1)).join(wanted.withColumn("_one", F.lit(1)), "_one").drop("_one")
    lacking = join_on(wanted.select(*keys), found.select(*keys), keys, "left_anti").select(
        *keys, F.lit("no prediction").alias("violation"))
    return bad.unionByName(wrong_truth).unionByName(lacking)


def evaluate(predictions: DataFrame, truth: DataFrame, keys=("sample_id",), taxa_column: str = "NumTaxa") -> DataFrame:
    """One row of metrics per group of ``predictions (…keys, taxon_id, lp)``.

    ``truth (sample_id, taxon_id, rel_abund)`` holds the true taxa. Extra key
    columns (method, seed) evaluate many predictions at once. Each of them must
    predict every true taxon of every sample, else it raises;
    :func:`prediction_gaps` lists what is missing.
    """
    keys = list(keys)
    # Written once: metrics and ranks read it, and predictions can be dear.
    both = materialize(_paired(predictions, truth, keys).select(*keys, "taxon_id", "lp", "t"), "paired").withColumn(
        "_p", F.exp("lp")).withColumn("_lt", F.ln("t"))
    error = F.lit(math.log10(math.e)) * (F.col("lp") - F.col("_lt"))
    sums = both.groupBy(*keys).agg(
        F.sum(F.when(F.col("t") > 0, F.col("t") * (F.col("_lt") - F.col("lp"))).otherwise(F.lit(0.0))).alias("KL_err"),
        F.sqrt(F.avg(error * error)).alias("RMSL_err"),
        (1 - 2 * F.sum(F.least("t", "_p")) / (F.sum("t") + F.sum("_p"))).alias("BrayCurtis"),
        F.sqrt(F.greatest(F.sum(C.jensen_shannon_term("t", "_p")), F.lit(0.0))).alias("RootJensenShannon"),
        F.count(F.lit(1)).alias(taxa_column))
    # Ranks of single-precision logs, as models return them: equal shares stay equal.
    single = both.select(*keys, F.col("_lt").cast("float").alias("t"), F.col("lp").cast("float").alias("lp"))
    rho = spearman(single, keys, "t", "lp")
    # Written before the join: a join that drops a group must not drop its error.
    return join_on(materialize(_without_gaps(sums, truth, keys, taxa_column), "scores"), rho, keys)


def log_softmax(logits: DataFrame, keys=("sample_id",), mask: str = None, out: str = "lp") -> DataFrame:
    """Log-softmax per group; masked rows get −∞.

    Group maximum and sum are aggregated and joined back, so a group is split
    over tasks.
    """
    keys = list(keys)
    live = logits if mask is None else logits.where(F.col(mask))
    top = live.groupBy(*keys).agg(F.max("logit").alias("_top"))
    raised = join_on(live, top, keys).groupBy(*keys).agg(
        (F.first("_top") + F.ln(F.sum(F.exp(F.col("logit") - F.col("_top"))))).alias("_norm"))
    value = F.col("logit") - F.col("_norm")
    if mask is not None:
        value = F.when(F.col(mask), value).otherwise(F.lit(float("-inf")))
    return join_on(logits, raised, keys, "left").withColumn(out, value).drop("_norm")


LOSSES = ("kl", "cross_entropy", "mse_log", "mse")


def loss(predictions: DataFrame, truth: DataFrame, name: str, reduction: str = "batchmean",
         width: int = None) -> DataFrame:
    """Loss of log predictions ``(sample_id, taxon_id, lp)`` against true shares.

    Reduction ``none`` gives ``(sample_id, loss)``: the sample's summed cells, or
    for ``mse_log`` its mean. Others give one row. ``mean`` divides by all cells
    of the padded batch, samples × ``width`` (the largest sample by default),
    except for ``mse_log``, which averages samples. A true taxon without a
    prediction raises.
    """
    if name not in LOSSES:
        raise ValueError(f"unknown loss {name!r}")
    t, lp = F.col("t"), F.col("lp")
    live = t > 0
    term = {
        "kl": t * (F.ln(t) - lp),
        "cross_entropy": -t * lp,
        "mse_log": F.pow(lp - F.ln(t), F.lit(2)),
        "mse": F.pow(t - F.exp(lp), F.lit(2)),
    }[name]
    cells = _paired(predictions, truth, ["sample_id"])
    total, n_live = F.sum(F.when(live, term).otherwise(F.lit(0.0))), F.count_if(live)
    per_sample = cells.groupBy("sample_id").agg(
        (F.try_divide(total, n_live) if name in ("mse_log", "mse") else total).alias("loss"),
        F.count(F.lit(1)).alias("_cells"))
    # The filter keeps the check in the plan where no later column needs the count.
    per_sample = _without_gaps(per_sample, truth, ["sample_id"], "_cells").where("_cells > 0")
    if reduction == "none":
        return per_sample.select("sample_id", "loss")
    summed, samples = F.sum("loss"), F.count(F.lit(1))
    widest = F.max("_cells") if width is None else F.lit(width)
    value = {
        "sum": summed,
        "batchmean": summed / samples,
        "mean": summed / samples if name == "mse_log" else summed / (samples * widest),
    }[reduction]
    return per_sample.agg(value.alias("loss"))


def weighted_mean_loss(batches: DataFrame) -> DataFrame:
    """Dataset loss from ``(loss, n)`` per batch."""
    return batches.agg((F.sum(F.col("loss") * F.col("n")) / F.sum("n")).alias("loss"))
