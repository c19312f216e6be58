"""Sample similarity graphs: edges, connected components, Fiedler vector, cut weights."""

from pyspark.sql import DataFrame, functions as F

from taxaspark.lineage import materialize
from taxaspark.operators.eigen import leading_eigenvectors
from taxaspark.operators.ordering import exact_quantiles


def similarity_graph(similarities: DataFrame) -> DataFrame:
    """Edges ``(a, b, weight)`` where the similarity is positive."""
    return similarities.where("similarity > 0").select("a", "b", F.col("similarity").alias("weight"))


def components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``(id, component)``, the component named by its smallest id.

    Alternating large- and small-star rounds: every round links a node's
    neighbours to the smallest of them, and a few rounds make every component a
    star. A round is a ``min`` aggregate and a join, so a hub is never collected.
    """
    star = materialize(
        edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(),
        "components")
    while True:
        both = star.unionByName(star.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min(F.least("u", "v")).alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = materialize(large.where("u <> v").distinct(), "components")
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        linked = large.join(low, "u")
        small = linked.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(
            low.select("u", F.col("m").alias("v")))
        small = materialize(small.where("u <> v").distinct(), "components")
        # Done when every node points at one root and no root points further.
        roots = small.select(F.col("v").alias("u")).distinct()
        done = (small.join(roots, "u", "left_semi").isEmpty()
                and small.groupBy("u").count().where("count > 1").isEmpty())
        star = small
        if done:
            break
    ids = nodes.select(F.col(nodes.columns[0]).alias("id"))
    found = star.select(F.col("u").alias("id"), F.col("v").alias("component"))
    return ids.join(found, "id", "left").select("id", F.coalesce("component", "id").alias("component"))


def component_sizes(assigned: DataFrame) -> DataFrame:
    return assigned.groupBy("component").agg(F.count(F.lit(1)).alias("size"))


def fiedler_vector(edges: DataFrame, seed: int = 0, tol: float = 1e-8) -> DataFrame:
    """``(id, value)``: eigenvector of the second smallest eigenvalue of the Laplacian.

    The graph must be connected. It is the leading eigenvector of ``c·I − L``
    (c twice the largest degree) orthogonal to the constant. Its largest entry
    by magnitude is made positive.
    """
    edges = materialize(edges.select("a", "b", "weight"), "edges")
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"), "weight"))
    degree = materialize(both.groupBy("a").agg(F.sum("weight").alias("degree")), "degrees")
    c = 2 * degree.agg(F.max("degree")).first()[0]
    matrix = both.select("a", "b", F.col("weight").alias("w")).unionByName(
        degree.select("a", F.col("a").alias("b"), (F.lit(c) - F.col("degree")).alias("w")))
    vectors, _ = leading_eigenvectors(
        matrix, 1, centre=True, seed=seed, tol=tol)
    return vectors.select("id", F.col("vec")[0].alias("value"))


def cut_edges(edges: DataFrame, labels: DataFrame, left, right) -> DataFrame:
    """Weights of the edges between two parts; ``labels (id, label)``."""
    la = labels.select(F.col("id").alias("a"), F.col("label").alias("_la"))
    lb = labels.select(F.col("id").alias("b"), F.col("label").alias("_lb"))
    crosses = ((F.col("_la") == left) & (F.col("_lb") == right)) | (
        (F.col("_la") == right) & (F.col("_lb") == left))
    return edges.join(la, "a").join(lb, "b").where(crosses).select("a", "b", "weight")


def cut_weights(cut: DataFrame) -> DataFrame:
    """Mean, median, max and min weight of the cut, in one row."""
    cut = materialize(cut.select("weight"), "cut")
    basic = cut.agg(F.count(F.lit(1)).alias("n"), F.avg("weight").alias("mean"),
                    F.max("weight").alias("max"), F.min("weight").alias("min"))
    return basic.withColumn("median", exact_quantiles(cut, [], "weight", {"median": 0.5}).scalar())


def cut_histogram(cut: DataFrame, bins: int = 20) -> DataFrame:
    cut = materialize(cut.select("weight"), "cut")
    lo, hi = cut.agg(F.min("weight")).scalar(), cut.agg(F.max("weight")).scalar()
    ranged = cut.withColumn("lo", lo).withColumn("hi", hi)
    at = F.try_divide((F.col("weight") - F.col("lo")) * bins, F.col("hi") - F.col("lo"))
    return ranged.groupBy(F.least(F.floor(F.coalesce(at, F.lit(0.0))), F.lit(bins - 1)).cast("int").alias("bin")).agg(
        F.count(F.lit(1)).alias("n"))
