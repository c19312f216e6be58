"""Ranks, exact quantiles and ordered positions of groups of any size.

A window over ``(group)`` puts a whole group into one task, so a group with a
third of all rows decides the run time. Here the group is first reduced to its
distinct values with counts (map-side combined), then range-partitioned by group
and value, at cut points Spark takes from the data, and written with the number
of the range. A window runs inside a group's part of one range only, and a
second one over the totals of these parts. Values in a narrow band, sequential
ids and a hot group all spread over as many ranges as there are shuffle
partitions.
"""

from functools import reduce

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from taxaspark.lineage import materialize


def in_ranges(rows: DataFrame, *order) -> DataFrame:
    """``rows`` with the number ``_bucket`` of their range in that order, written as a table.

    Rows that agree in ``order`` share a range. The cut points come from a sample
    of the rows, so another run may cut elsewhere; the table fixes them for all
    who read it.
    """
    ranges = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return materialize(rows.repartitionByRange(ranges, *order).withColumn("_bucket", F.spark_partition_id()), "ordered")


def join_on(left: DataFrame, right: DataFrame, keys, how="inner") -> DataFrame:
    """Equi-join that matches null keys and keeps the left key columns."""
    renamed = right.select(
        *[F.col(k).alias(f"_r_{k}") for k in keys],
        *[c for c in right.columns if c not in keys],
    )
    same = [F.col(k).eqNullSafe(F.col(f"_r_{k}")) for k in keys]
    joined = left.join(renamed, reduce(lambda x, y: x & y, same), how)
    return joined.drop(*[f"_r_{k}" for k in keys])


def _group(keys) -> Column:
    """The keys as one struct: equal structs match also where a key is null.

    Windows and joins then ask for the same partitioning, so one shuffle serves both.
    """
    return F.struct(*keys) if keys else F.struct(F.lit(0).alias("_all"))


def _bucket_starts(bucketed: DataFrame, count: Column) -> DataFrame:
    """Rows before each bucket of a group, and rows of the group."""
    whole = W.partitionBy("_g")
    below = whole.orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1)
    return (
        bucketed.groupBy("_g", "_bucket").agg(count.alias("_n"))
        .withColumn("_start", F.coalesce(F.sum("_n").over(below), F.lit(0).cast("long")))
        .withColumn("total", F.sum("_n").over(whole))
        .drop("_n")
    )


def ordered_histogram(df: DataFrame, keys, value: str, sums=None) -> DataFrame:
    """Distinct non-null values per group in order.

    Adds ``n`` rows with that value, ``before`` rows of the group below it and
    ``total`` rows of the group. ``sums`` maps extra column names to the
    expressions summed along with ``n``.
    """
    keys = list(keys)
    v = F.col(value).cast("double")
    extra = [F.sum(e).alias(name) for name, e in (sums or {}).items()]
    hist = (
        df.where(v.isNotNull() & ~F.isnan(v))
        .groupBy(_group(keys).alias("_g"), v.alias(value))
        .agg(F.count(F.lit(1)).alias("n"), *extra)
    )
    hist = in_ranges(hist, "_g", value)
    inside = W.partitionBy("_g", "_bucket").orderBy(value).rowsBetween(W.unboundedPreceding, -1)
    running = hist.withColumn("_inside", F.coalesce(F.sum("n").over(inside), F.lit(0).cast("long")))
    return running.join(_bucket_starts(hist, F.sum("n")), ["_g", "_bucket"]).select(
        *[F.col(f"_g.{k}").alias(k) for k in keys], value, "n", *(sums or {}),
        (F.col("_start") + F.col("_inside")).alias("before"), "total",
    )


def tie_averaged_rank(before="before", n="n") -> Column:
    """Rank (from 1) of a value that ``n`` rows share after ``before`` smaller ones."""
    return F.col(before) + (F.col(n) + 1) / 2


def exact_quantiles(df: DataFrame, keys, value: str, quantiles: dict) -> DataFrame:
    """Exact quantiles per group with linear interpolation: ``{column: q}``."""
    keys = list(keys)
    hist = ordered_histogram(df.select(*keys, F.col(value).alias("_v")), keys, "_v")
    value = "_v"
    aggs = []
    for name, q in quantiles.items():
        position = F.lit(float(q)) * (F.col("total") - 1)
        low = F.floor(position)
        high = F.ceil(position)
        at = lambda p: F.max(
            F.when((F.col("before") <= p) & (p < F.col("before") + F.col("n")), F.col(value))
        )
        aggs += [
            at(low).alias(f"_lo_{name}"), at(high).alias(f"_hi_{name}"),
            F.max(position - low).alias(f"_f_{name}"),
        ]
    grouped = hist.groupBy(*keys).agg(*aggs)
    return grouped.select(
        *keys,
        *[
            (F.col(f"_lo_{c}") + (F.col(f"_hi_{c}") - F.col(f"_lo_{c}")) * F.col(f"_f_{c}")).alias(c)
            for c in quantiles
        ],
    )


def medians(df: DataFrame, keys, value: str, name: str) -> DataFrame:
    return exact_quantiles(df, keys, value, {name: 0.5})


def hash_positions(df: DataFrame, id_col: str, seed, keys=()) -> DataFrame:
    """Position (from 0) of each row in the order of ``md5(seed|id)`` within its group.

    Adds ``position`` and the group size ``total``. The first four digits of the
    hash are the bucket, so buckets are even whatever the ids look like.
    """
    keys = list(keys)
    hashed = df.withColumn("_h", F.md5(F.concat_ws("|", F.lit(str(seed)), F.col(id_col)))).withColumn("_g", _group(keys))
    return _positions(hashed.withColumn("_bucket", F.substring("_h", 1, 4)), ["_h", id_col]).drop("_h")


def ordered_positions(df: DataFrame, ord_col: str, id_col: str, keys=()) -> DataFrame:
    """Position (from 0) of each row in the order of a number, then of the id."""
    return _positions(in_ranges(df.withColumn("_g", _group(list(keys))), "_g", ord_col, id_col), [ord_col, id_col])


def running_totals(df: DataFrame, order, weight: str, name: str) -> DataFrame:
    """``df`` with the sum ``name`` of ``weight`` over all rows before a row, in an order without ties."""
    placed = in_ranges(df.withColumn("_g", _group([])), *order)
    inside = W.partitionBy("_g", "_bucket").orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    within = placed.withColumn("_inside", F.coalesce(F.sum(weight).over(inside), F.lit(0).cast("long")))
    return within.join(_bucket_starts(placed, F.sum(weight)), ["_g", "_bucket"]).withColumn(
        name, F.col("_start") + F.col("_inside")).drop("_g", "_bucket", "_start", "_inside", "total")


def _positions(bucketed, order):
    inside = W.partitionBy("_g", "_bucket").orderBy(*order)
    numbered = bucketed.withColumn("_row", F.row_number().over(inside))
    return (
        numbered.join(_bucket_starts(bucketed, F.count(F.lit(1))), ["_g", "_bucket"])
        .withColumn("position", F.col("_start") + F.col("_row") - 1)
        .drop("_g", "_bucket", "_start", "_row")
    )
