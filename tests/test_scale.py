"""What keeps operators bounded: shuffles that go, rows that travel packed, counts that do not overflow."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from taxaspark.lineage import materialize
from taxaspark.operators import eigen, graph as G, profile as P, sequences as Q, stats as S
from taxaspark.operators.tiles import tiled_pairs


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def shuffle_files(spark):
    blocks = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    return {blocks.apply(i).getName() for i in range(blocks.size()) if blocks.apply(i).getName().startswith("shuffle")}


def test_a_written_table_leaves_no_shuffle_files(spark):
    before = shuffle_files(spark)
    materialize(spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count(), "counts")
    assert shuffle_files(spark) <= before


def test_tiles_get_rows_of_an_id_packed(spark):
    rows = spark.range(400).select(
        (F.col("id") % 4).cast("string").alias("id"), F.col("id").cast("string").alias("key"), F.lit(1.0).alias("x"), F.lit(1.0).alias("w"))
    assert "codes" in plan(tiled_pairs(rows, all_pairs=True))


def test_an_id_on_both_sides_keeps_both_weights(spark):
    cols = "id string, key string, x double, w double"
    left = spark.createDataFrame([("a", "k", 2.0, 5.0), ("b", "k", 3.0, 5.0)], cols)
    right = spark.createDataFrame([("a", "k", 1.0, 7.0), ("b", "k", 1.0, 7.0)], cols)
    got = {(r.a, r.b): (r.s, r.wa, r.wb) for r in tiled_pairs(left, right, term="dot").collect()}
    assert got == {(x, y): (s, 5.0, 7.0) for x, s in (("a", 2.0), ("b", 3.0)) for y in "ab"}
    assert [(r.a, r.b) for r in tiled_pairs(left, right, term="dot", ordered=True).collect()] == [("a", "b")]


def test_dense_cells_with_a_missing_value(spark):
    cols = "id string, key string, x double, w double"
    values = {("a", "k"): 2.0, ("a", "l"): None, ("b", "k"): 3.0, ("c", "k"): 4.0, ("c", "l"): 1.0}
    got = {(r.a, r.b): r.s for r in tiled_pairs(
        spark.createDataFrame([(i, k, v, 1.0) for (i, k), v in values.items()], cols), term="dot").collect()}
    assert got[("a", "b")] == 6.0 and got[("b", "c")] == 12.0 and np.isnan(got[("a", "c")])


def test_hamming_pairs_join_no_pairs(spark):
    rows = spark.createDataFrame([("a", "AC"), ("b", "AC"), ("c", "AG"), ("c", "AG")], "taxon_id string, aln string")
    pairs = Q.hamming_pairs(rows)
    assert "Join" not in plan(pairs)
    assert sorted(map(tuple, pairs.collect())) == [
        ("a", "b", 0.0), ("a", "c", 1.0), ("a", "c", 1.0), ("b", "c", 1.0), ("b", "c", 1.0)]


def test_hamming_pairs_cut_long_lists(spark, monkeypatch):
    monkeypatch.setattr(Q, "LISTED_IDS", 2)
    monkeypatch.setattr(Q, "BLOCK_SEQUENCES", 2)
    names = [f"t{i:02d}" for i in range(15)]
    aln = {n: "AAAA"[: i % 3] + "CCCC"[i % 3:] for i, n in enumerate(names)}
    got = sorted(map(tuple, Q.hamming_pairs(spark.createDataFrame(list(aln.items()), "taxon_id string, aln string")).collect()))
    assert got == [(a, b, float(sum(x != y for x, y in zip(aln[a], aln[b])))) for a in names for b in names if a < b]


def test_eigenvectors_from_many_small_blocks(spark, monkeypatch):
    monkeypatch.setattr(eigen, "_BLOCK", 16)
    monkeypatch.setattr(eigen, "_PACKED", 20)
    monkeypatch.setattr(eigen, "_SMALL", 0)
    rng = np.random.default_rng(0)
    half = rng.normal(size=(90, 90))
    dense = half + half.T
    cells = [(f"i{i:02d}", f"i{j:02d}", float(dense[i, j])) for i in range(90) for j in range(90)]
    vectors, values = eigen.leading_eigenvectors(spark.createDataFrame(cells, "a string, b string, w double"), 2)
    assert np.allclose(values, np.linalg.eigvalsh(dense)[::-1][:2])
    found = np.array([r.vec for r in vectors.orderBy("id").collect()])
    assert np.allclose(dense @ found, found * values, atol=1e-4)

def test_a_cut_is_written_once(spark):
    calls = spark.sparkContext.accumulator(0)

    @F.udf("double")
    def seen(x):
        calls.add(1)
        return x

    cut = spark.createDataFrame([("a", "b", 0.5), ("a", "c", 1.0), ("b", "c", 0.0)], "a string, b string, weight double")
    cut = cut.withColumn("weight", seen("weight"))
    got = {r.bin: r.n for r in G.cut_histogram(cut, 2).collect()}
    assert got == {0: 1, 1: 2} and calls.value == 3


def test_vectors_are_looked_at_before_the_join(spark):
    profile = spark.createDataFrame([(f"s{i}", "t", 1.0) for i in range(20)] + [("s0", "u", 1.0)], "sample_id string, taxon_id string, rel_abund double")
    vectors = spark.createDataFrame([("t", "m", [1.0]), ("t", "n", [float("nan")])], "taxon_id string, marker_id string, vec array<double>")
    counted = P.attach_vectors(profile, vectors).groupBy("sample_id").agg(F.count_if("marker_mask").alias("n"))
    assert "vec" not in plan(counted).split("Join")[0]
    assert {r.n for r in counted.collect()} == {1}


def test_signed_ranks_of_two_million_pairs(spark):
    n = 2_000_000
    pairs = spark.range(n).select(F.lit("x").alias("method_a"), F.lit("y").alias("method_b"),
                                  (F.col("id") % 1000 + 1).cast("double").alias("va"), F.lit(0.0).alias("vb"))
    row = S.wilcoxon_statistics(pairs).first()
    assert row.n_nonzero == n and row.w == 0 and row.z == pytest.approx(
        -n * (n + 1) / 4 / np.sqrt(n * (n + 1) * (2 * n + 1) / 24 - 1000 * (2000.0**3 - 2000) / 48))
