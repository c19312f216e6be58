import numpy as np
import pytest

from conftest import rows
from taxaspark.operators import graph as G, ordination as O, split as L, tree as T
from taxaspark.operators.eigen import leading_eigenvectors
from taxaspark.operators.fiedler import fiedler_vectors


@pytest.fixture(scope="module")
def tree(spark):
    newick = "((A:1,(B:2,C:x)inner:0.5)left:1,D:3,(E:1)unary:2)root:9;"
    texts = spark.createDataFrame([(1, newick)], "tree_id long, newick string")
    return T.parse_newick(texts).drop("tree_id")


def test_newick_names_lengths_and_depths(tree):
    got = {r.name: (r.depth, r.root_dist) for r in T.tree_depths(tree).collect()}
    assert got == {"root": (0, 0.0), "left": (1, 1.0), "A": (2, 2.0), "inner": (2, 1.5), "B": (3, 3.5),
                   "C": (3, 1.5), "D": (1, 3.0), "unary": (1, 2.0), "E": (2, 3.0)}


def test_patristic_distances_ignore_the_root_branch(tree):
    got = {(r.a, r.b): r.d for r in T.patristic(tree).collect()}
    assert len(got) == 10
    assert got["A", "B"] == pytest.approx(3.5) and got["A", "C"] == pytest.approx(1.5)
    assert got["B", "C"] == pytest.approx(2.0) and got["A", "D"] == pytest.approx(5.0) and got["D", "E"] == pytest.approx(6.0)


def test_closest_leaf_self_nearest_and_unknown(spark, tree):
    names = lambda *x: spark.createDataFrame([(n,) for n in x], "name string")
    got = {r["query"]: (r.answer, r.d) for r in T.closest_leaf(tree, names("A", "B", "Z"), names("A", "D")).collect()}
    assert got == {"A": ("A", 0.0), "B": ("A", pytest.approx(3.5))}


def test_prune_merges_unary_nodes_and_keeps_distances(spark, tree):
    keep = spark.createDataFrame([("A",), ("B",), ("E",)], "name string")
    pruned = T.prune(tree, keep)
    nodes = {r.name: (r.parent_id, r.branch_length) for r in pruned.collect()}
    assert set(nodes) == {"root", "left", "A", "B", "E"}
    assert nodes["B"][1] == pytest.approx(2.5) and nodes["E"][1] == pytest.approx(3.0)
    before = {(r.a, r.b): r.d for r in T.patristic(tree, keep).collect()}
    for r in T.patristic(pruned).collect():
        assert r.d == pytest.approx(before[r.a, r.b])
    assert rows(T.missing_leaves(tree, spark.createDataFrame([("A",), ("Q",)], "name string"))) == [("Q",)]


def test_ancestors_of_a_long_chain(spark):
    chain = spark.createDataFrame([(i, i - 1 if i else None, f"n{i}", 1.0) for i in range(41)],
                                  "node_id long, parent_id long, name string, branch_length double")
    got = T.ancestors(chain)
    assert got.count() == 41 * 42 / 2
    deepest = {r.ancestor_id: (r.steps, r.length) for r in got.where("node_id = 40").collect()}
    assert deepest == {i: (40 - i, float(40 - i)) for i in range(41)}


def test_components_of_hub_chain_and_lone_nodes(spark):
    edges = [("hub", f"h{i}") for i in range(60)] + [(f"c{i:02}", f"c{i + 1:02}") for i in range(25)] + [("y", "x")]
    nodes = sorted({n for e in edges for n in e} | {"alone"})
    got = {r.id: r.component for r in G.components(
        spark.createDataFrame([(n,) for n in nodes], "id string"), spark.createDataFrame(edges, "a string, b string")).collect()}
    assert sorted(got) == nodes
    assert {got[n] for n in nodes if n.startswith("h")} == {"h0"}
    assert {got[n] for n in nodes if n.startswith("c")} == {"c00"}
    assert got["x"] == got["y"] == "x" and got["alone"] == "alone"


def _table(spark, m, ids, columns="a string, b string, d double"):
    n = len(ids)
    return spark.createDataFrame([(ids[i], ids[j], float(m[i, j])) for i in range(n) for j in range(i + 1, n)], columns)


def test_pcoa_recovers_distances_and_proportions(spark):
    rng = np.random.default_rng(0)
    points = rng.normal(size=(30, 3)) * [5, 2, 0.5]
    d = np.linalg.norm(points[:, None] - points[None], axis=2)
    ids = [f"s{i:02}" for i in range(30)]
    coordinates, explained = O.pcoa(_table(spark, d, ids), 3)
    x = np.stack([r.pc for r in sorted(coordinates.collect(), key=lambda r: r.id)])
    np.testing.assert_allclose(np.linalg.norm(x[:, None] - x[None], axis=2), d, atol=1e-8)
    shares = [r.proportion for r in sorted(explained.collect(), key=lambda r: r.axis)]
    assert sum(shares) == pytest.approx(1.0) and shares == sorted(shares, reverse=True)
    for axis in range(3):
        column = x[:, axis]
        assert column[np.abs(column).argmax()] > 0


def test_pcoa_with_negative_eigenvalues_matches_numpy(spark):
    rng = np.random.default_rng(1)
    m = rng.random((24, 24)) + 0.2
    m = np.triu(m, 1) + np.triu(m, 1).T
    j = np.eye(24) - 1 / 24
    gower = -0.5 * j @ (m**2) @ j
    values, vectors = np.linalg.eigh(gower)
    coordinates, explained = O.pcoa(_table(spark, m, [f"s{i:02}" for i in range(24)]), 2)
    got = [r.eigenvalue for r in sorted(explained.collect(), key=lambda r: r.axis)]
    np.testing.assert_allclose(got, values[::-1][:2], rtol=1e-8)
    x = np.stack([r.pc for r in sorted(coordinates.collect(), key=lambda r: r.id)])
    want = vectors[:, ::-1][:, :2] * np.sqrt(values[::-1][:2])
    np.testing.assert_allclose(np.abs(x), np.abs(want), atol=1e-6)


def test_eigenvectors_of_a_low_rank_matrix(spark):
    v = np.array([3.0, 4.0, 0.0, 0.0]) / 5
    m = 7 * np.outer(v, v)
    table = spark.createDataFrame([(str(i), str(j), float(m[i, j])) for i in range(4) for j in range(4)], "a string, b string, w double")
    vectors, values = leading_eigenvectors(table, 1)
    assert values[0] == pytest.approx(7.0)
    got = [r.vec[0] for r in sorted(vectors.collect(), key=lambda r: r.id)]
    np.testing.assert_allclose(got, v, atol=1e-8)


def _two_blocks():
    rng = np.random.default_rng(4)
    w = np.zeros((16, 16))
    for block in (range(8), range(8, 16)):
        for i in block:
            for j in block:
                w[i, j] = 1 + 0.1 * rng.random()
    w[0, 8] = w[8, 0] = 0.05
    return np.triu(w, 1) + np.triu(w, 1).T


def test_fiedler_vector_separates_two_blocks_and_matches_numpy(spark):
    w = _two_blocks()
    ids = [f"s{i:02}" for i in range(16)]
    edges = _table(spark, w, ids, "a string, b string, weight double").where("weight > 0")
    got = np.array([r.value for r in sorted(G.fiedler_vector(edges).collect(), key=lambda r: r.id)])
    values, vectors = np.linalg.eigh(np.diag(w.sum(1)) - w)
    want = vectors[:, 1]
    np.testing.assert_allclose(got, want * np.sign(want @ got), atol=1e-6)
    assert len(set(np.sign(got[:8]))) == 1 and np.sign(got[0]) != np.sign(got[8])


def test_closest_leaf_matches_all_pairs(spark):
    """A random tree with negative branches, a node of many children and leaves of equal distance, against the pair table."""
    rng = np.random.default_rng(3)
    parents = [None] + [int(rng.integers(0, i)) if i > 40 else 0 for i in range(1, 160)]
    inner = {p for p in parents if p is not None}
    nodes = [(i, p, None if i in inner else f"L{i:03}", None if p is None else float(rng.integers(-2, 9)) / 4) for i, p in enumerate(parents)]
    tree = spark.createDataFrame(nodes, "node_id long, parent_id long, name string, branch_length double")
    names = [n[2] for n in nodes if n[2]]
    keys, queries = names[::3], names + ["nowhere"]
    d = {}
    for r in T.patristic(tree).collect():
        d[r.a, r.b] = d[r.b, r.a] = r.d
    want = {q: (q, 0.0) if q in keys else min(((k, d[q, k]) for k in keys), key=lambda x: (x[1], x[0])) for q in names}
    table = lambda x: spark.createDataFrame([(i,) for i in x], "name string")
    got = {r["query"]: (r.answer, r.d) for r in T.closest_leaf(tree, table(queries), table(keys)).collect()}
    assert got == want
    alone = T.closest_leaf(tree, table(names), table(names[:1])).collect()
    assert len(alone) == len(names) and {r.answer for r in alone} == {names[0]}
    assert T.closest_leaf(tree, table(names), table([])).collect() == []


def test_fiedler_vectors_of_all_components_at_once(spark):
    """Components of 6 to 3,000 nodes in one iteration: against NumPy, and a closed form for the largest."""
    rng = np.random.default_rng(7)
    edges, members, want = [], [], {}
    for c, n in enumerate([6, 7, 11, 40]):
        w = np.triu(rng.random((n, n)) * (rng.random((n, n)) < 0.6) + 0.01, 1)
        ids = [f"c{c}n{i:03}" for i in range(n)]
        edges += [(ids[i], ids[j], float(w[i, j])) for i in range(n) for j in range(i + 1, n)]
        members += [(i, ids[0]) for i in ids]
        w = w + w.T
        values, vectors = np.linalg.eigh(np.diag(w.sum(1)) - w)
        v = vectors[:, 1]
        want.update(zip(ids, v * np.sign(v[np.argmax(np.abs(v))])))
    # Two stars of p and q leaves, their centres joined: few edges, a known cut.
    ids = [f"s{i:04}" for i in range(3000)]
    edges += [(ids[0], x, 1.0) for x in ids[2:1000]] + [(ids[1], x, 1.0) for x in ids[1000:]] + [(ids[0], ids[1], 1.0)]
    members += [(i, "s") for i in ids]
    got = {r.id: r.value for r in fiedler_vectors(
        spark.createDataFrame(edges, "a string, b string, weight double"),
        spark.createDataFrame(members, "id string, component string")).collect()}
    assert len(got) == len(members)
    np.testing.assert_allclose([got[i] for i in want], list(want.values()), atol=1e-6)
    # By symmetry a matrix of four unknowns: the two centres and a leaf of each.
    small = np.array([[999, -1, -998, 0], [-1, 2001, 0, -2000], [-1, 0, 1, 0], [0, -1, 0, 1.0]])
    values, vectors = np.linalg.eig(small)
    v = vectors[:, np.argsort(values.real)[1]].real
    v = v / np.sqrt(v[0] ** 2 + v[1] ** 2 + 998 * v[2] ** 2 + 2000 * v[3] ** 2) * np.sign(v[2])
    np.testing.assert_allclose([got[ids[0]], got[ids[1]], got[ids[2]], got[ids[2999]]], v, atol=1e-6)


def test_spectral_split_keeps_small_components_in_training(spark):
    w = _two_blocks()
    ids = [f"s{i:02}" for i in range(16)] + ["z1", "z2"]
    d = np.ones((18, 18))
    d[:16, :16] = 1 - w / 2
    d[16, 17] = 0.5
    table = _table(spark, d, ids)
    labels = {r.id: r.label for r in L.split_spectral(table, 0.5, 0.5).collect()}
    assert labels["z1"] == labels["z2"] == "Train"
    assert {labels[i] for i in ids[:8]} != {labels[i] for i in ids[8:16]}
    assert sum(v == "Test" for v in labels.values()) == 8


def test_pcoa_split_takes_both_tails(spark):
    d = np.abs(np.arange(20.0)[:, None] - np.arange(20.0)[None])
    ids = [f"s{i:02}" for i in range(20)]
    samples = spark.createDataFrame([(i,) for i in ids + ["gone"]], "sample_id string")
    split = {r.sample_id: r.label for r in L.train_test_split(samples, 0.6, 0.2, "pcoa", distances=_table(spark, d, ids)).collect()}
    assert split["gone"] == "Excluded"
    counts = {k: list(split.values()).count(k) for k in ("Train", "Test", "Excluded")}
    assert counts == {"Train": 12, "Test": 4, "Excluded": 5}
    with pytest.raises(ValueError):
        L.train_test_split(samples, 0.6, 0.2, "other")


def test_random_split_is_exact_and_disjoint(spark):
    samples = spark.createDataFrame([(f"s{i}", f"p{i % 3}") for i in range(33)], "sample_id string, project string")
    labels = [r.label for r in L.split_random(samples, 0.8, 0.15, 1).collect()]
    assert labels.count("Train") == 26 and labels.count("Test") == 4 and labels.count("Excluded") == 3
    per = L.split_per_project(samples, 1).groupBy("project", "label").count().collect()
    assert {(r.project, r.label): r["count"] for r in per} == {
        (p, l): n for p in ("p0", "p1", "p2") for l, n in (("Train", 8), ("Test", 3))}


def test_greedy_projects_fill_the_quota(spark):
    sizes = {"big": 5, "mid1": 3, "mid2": 3, "small": 1}
    samples = spark.createDataFrame([(f"{p}{i}", p) for p, n in sizes.items() for i in range(n)], "sample_id string, project string")
    got = {r.project: r.label for r in L.split_greedy_projects(samples, 2.0).select("project", "label").distinct().collect()}
    assert got == {"big": "Train", "mid1": "Train", "mid2": "Test", "small": "Test"}  # quota 8 of 12


def test_scaler_and_pca_conventions(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(50, 4)) * [1, 2, 3, 0] + [0, 1, 2, 7]
    data = [(f"m{i:02}", [float(v) for v in row]) for i, row in enumerate(x)] + [("nan", [float("nan")] * 4)]
    df = spark.createDataFrame(data, "marker_id string, vec array<double>")
    s = O.fit_scaler(df).first()
    np.testing.assert_allclose(s.mean, x.mean(0), atol=1e-12)
    np.testing.assert_allclose(s.scale, [*x.std(0)[:3], 1.0], atol=1e-9)
    reduced, explained = O.reduce_dimension(df, 2, "marker_id")
    got = {r.marker_id: r.vec for r in reduced.collect()}
    assert got["nan"] is None
    z = (x - x.mean(0)) / np.array([*x.std(0)[:3], 1.0])
    u, sv, vt = np.linalg.svd(z, full_matrices=False)
    want = z @ vt[:2].T
    np.testing.assert_allclose(np.abs([got[f"m{i:02}"] for i in range(50)]), np.abs(want), atol=1e-8)
    assert explained == pytest.approx((sv[:2] ** 2).sum() / (sv**2).sum())
    same, none = O.reduce_dimension(df, 4, "marker_id")
    assert none is None and same.count() == 51
    with pytest.raises(ValueError):
        O.reduce_dimension(df, 4, "marker_id", strict=True)


def test_cut_statistics(spark):
    edges = spark.createDataFrame([("a", "b", 1.0), ("a", "c", 3.0), ("b", "d", 2.0), ("c", "d", 9.0)], "a string, b string, weight double")
    labels = spark.createDataFrame([("a", "L"), ("b", "L"), ("c", "R"), ("d", "R")], "id string, label string")
    cut = G.cut_edges(edges, labels, "L", "R")
    r = G.cut_weights(cut).first()
    assert (r.n, r.mean, r["max"], r["min"], r["median"]) == (2, 2.5, 3.0, 2.0, 2.5)
    assert rows(G.cut_histogram(cut)) == [(0, 1), (19, 1)]


def test_eigenvectors_need_many_products_on_a_path(spark):
    """A long path: eigenvalues 2 cos(pi j / (n + 1)) lie close, one product is far from enough."""
    n = 120
    cells = [(f"{i:03}", f"{i + s:03}", 1.0) for i in range(n) for s in (-1, 1) if 0 <= i + s < n]
    _, values = leading_eigenvectors(spark.createDataFrame(cells, "a string, b string, w double"), 2)
    assert values == pytest.approx([2 * np.cos(np.pi * j / (n + 1)) for j in (1, 2)], abs=1e-9)


def test_greedy_projects_of_equal_size_and_leave_one_out_folds(spark):
    samples = spark.range(3000).selectExpr("cast(id as string) sample_id", "concat('p', lpad(cast(id as string), 5, '0')) project")
    train = L.split_greedy_projects(samples, 2.0).where("label = 'Train'").select("project").collect()
    assert sorted(r.project for r in train) == [f"p{i:05}" for i in range(2000)]
    few = spark.createDataFrame([("a", "P"), ("b", "P"), ("c", "Q"), ("d", None)], "sample_id string, project string")
    folds = {r.fold: (r.n_test, r.n_train) for r in L.leave_one_out_folds(few).collect()}
    assert folds == {"P": (2, 2), "Q": (1, 3), None: (1, 3)}
    one = {r.sample_id: r.label for r in L.leave_one_out(few, "P").collect()}
    assert one == {"a": "Test", "b": "Test", "c": "Train", "d": "Train"}
    for chunk in (1, 256):
        every = L.split_leave_one_out(few, chunk=chunk).collect()
        assert len(every) == 12 and {r.sample_id: r.label for r in every if r.fold == "P"} == one
        assert [r.sample_id for r in every if r.fold is None and r.label == "Test"] == ["d"]
    assert L.split_leave_one_out(few.where("false")).collect() == []


def test_split_hands_back_its_coordinates(spark):
    d = spark.createDataFrame([(f"s{i}", f"s{j}", float(j - i)) for i in range(6) for j in range(i + 1, 6)], "a string, b string, d double")
    samples = spark.createDataFrame([(f"s{i}",) for i in range(6)], "sample_id string")
    labels, placed = L.train_test_split(samples, 0.5, 0.3, "pcoa", distances=d, coordinates=True, axes=1)
    pc = {r.id: r.pc[0] for r in placed.collect()}
    order = sorted(pc, key=pc.get)
    assert order in ([f"s{i}" for i in range(6)], [f"s{i}" for i in reversed(range(6))])
    got = {r.sample_id: r.label for r in labels.collect()}
    assert [got[s] for s in order] == ["Train"] * 3 + ["Excluded"] + ["Test"] * 2
    assert L.train_test_split(samples, 0.5, 0.3, "random", coordinates=True)[1] is None
