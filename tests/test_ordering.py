import numpy as np
import pytest

from conftest import rows
from taxaspark.operators import ordering as O
from taxaspark.operators.metrics import average_ranks


@pytest.fixture(scope="module")
def values(spark):
    rng = np.random.default_rng(1)
    data = [("hot", float(v)) for v in np.round(rng.normal(0, 3, 400), 1)]
    data += [("one", 2.5), (None, -1.0), (None, 4.0), (None, 1e-9)]
    return data, spark.createDataFrame(data, "g string, v double")


def test_quantiles_match_numpy_for_skewed_null_and_single_groups(values):
    data, df = values
    got = {r.g: r for r in O.exact_quantiles(df, ["g"], "v", {"a": 0.05, "b": 0.5, "c": 0.95}).collect()}
    for g in {x[0] for x in data}:
        v = [x[1] for x in data if x[0] == g]
        np.testing.assert_allclose([got[g].a, got[g].b, got[g].c], np.quantile(v, [0.05, 0.5, 0.95]), atol=1e-12)


def test_global_quantile_ignores_null_and_nan(spark):
    df = spark.createDataFrame([(1.0,), (None,), (float("nan"),), (2.0,)], "v double")
    assert O.exact_quantiles(df, [], "v", {"m": 0.5}).first().m == 1.5


def test_histogram_positions_are_a_running_count(values):
    data, df = values
    hist = [r for r in O.ordered_histogram(df, ["g"], "v").collect() if r.g == "hot"]
    v = np.array([x[1] for x in data if x[0] == "hot"])
    for r in hist:
        assert r.before == (v < r.v).sum() and r.n == (v == r.v).sum() and r.total == len(v)


def test_average_ranks_with_ties(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 1.0), ("a", 3.0), ("b", -5.0)], "g string, v double")
    assert rows(average_ranks(df, ["g"], "v", "r")) == [("a", 1.0, 1.5), ("a", 1.0, 1.5), ("a", 3.0, 3.0), ("b", -5.0, 1.0)]


def test_a_value_column_may_be_called_n(spark):
    df = spark.createDataFrame([("a", 7), ("a", 9)], "g string, n long")
    assert O.medians(df, ["g"], "n", "m").first().m == 8.0
    assert rows(average_ranks(df, ["g"], "n", "r").select("g", "r")) == [("a", 1.0), ("a", 2.0)]


def test_hash_positions_are_a_permutation_and_depend_on_the_seed(spark):
    df = spark.range(500).selectExpr("cast(id as string) id", "id % 3 g")
    first = {r.id: r.position for r in O.hash_positions(df, "id", 1).collect()}
    assert sorted(first.values()) == list(range(500))
    second = {r.id: r.position for r in O.hash_positions(df, "id", 2).collect()}
    assert first != second
    grouped = O.hash_positions(df, "id", 1, ["g"]).collect()
    for g in range(3):
        part = [r for r in grouped if r.g == g]
        assert sorted(r.position for r in part) == list(range(len(part))) and part[0].total == len(part)


def test_ordered_positions_follow_the_number(spark):
    df = spark.createDataFrame([("b", 5), ("a", 5), ("c", -100000), ("d", 7000000)], "id string, ord long")
    assert rows(O.ordered_positions(df, "ord", "id").select("position", "id")) == [(0, "c"), (1, "a"), (2, "b"), (3, "d")]


@pytest.mark.parametrize("values", ["id", "1000000 + id", "1e9 + id / 1e6", "pow(2, id % 60) + id"])
def test_no_range_holds_over_three_times_its_share(spark, values):
    """Sequential ids, a narrow band and a wide one: a hot group spreads over all ranges alike."""
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    try:
        df = spark.range(60000).selectExpr("if(id % 10 = 0, cast(id as string), 'hot') g", f"cast({values} as double) v")
        placed = O.in_ranges(df, "g", "v")
        sizes = [r["count"] for r in placed.groupBy("_bucket").count().collect()]
        assert sum(sizes) == 60000 and max(sizes) <= 3 * 60000 / 16
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "2")


def test_running_totals_over_ranges(spark):
    from pyspark.sql import functions as F
    df = spark.createDataFrame([(f"p{i:03}", i % 7) for i in range(200)], "p string, n long")
    got = [(r.p, r.t) for r in O.running_totals(df, [F.desc("n"), F.asc("p")], "n", "t").collect()]
    want, before = {}, 0
    for n, p in sorted((-(i % 7), f"p{i:03}") for i in range(200)):
        want[p] = before
        before -= n
    assert dict(got) == want and len(got) == 200
