import itertools
import math

import numpy as np
import pytest

from taxaspark.operators import distance as D, sequences as Q
from taxaspark.operators.set_join import top_similar_sets
from taxaspark.operators.tiles import tiled_pairs


@pytest.fixture(scope="module")
def profile(spark):
    """40 samples; taxon t0 in all of them, sample s0 with a third of all rows, two disjoint samples."""
    rng = np.random.default_rng(3)
    data = {}
    for s in range(40):
        taxa = set(rng.choice(60, 6, replace=False)) | {0}
        if s == 0:
            taxa |= set(range(150))
        data[f"s{s}"] = {f"t{t}": float(x) for t, x in zip(sorted(taxa), rng.random(len(taxa)) + 0.01)}
    data["x1"] = {"only1": 2.0}
    data["x2"] = {"only2": 3.0, "only3": 1.0}
    data = {s: {t: v / sum(p.values()) for t, v in p.items()} for s, p in data.items()}
    rows = [(s, t, v) for s, p in data.items() for t, v in p.items()]
    return data, spark.createDataFrame(rows, "sample_id string, taxon_id string, rel_abund double")


def _dense(p, q):
    taxa = sorted(set(p) | set(q))
    return np.array([p.get(t, 0.0) for t in taxa]), np.array([q.get(t, 0.0) for t in taxa])


def _js(x, y):
    m = (x + y) / 2
    kl = lambda p: sum(a * math.log(a / b) for a, b in zip(p, m) if a > 0)
    return 0.5 * (kl(x) + kl(y))


BRUTE = {
    "jaccard": lambda x, y: 1 - ((x > 0) & (y > 0)).sum() / ((x > 0) | (y > 0)).sum(),
    "jensen_shannon": _js,
    "root_jensen_shannon": lambda x, y: math.sqrt(max(_js(x, y), 0)),
    "bray_curtis": lambda x, y: 1 - 2 * np.minimum(x, y).sum() / (x.sum() + y.sum()),
}


@pytest.mark.parametrize("method", sorted(BRUTE))
@pytest.mark.parametrize("tiling", [{}, {"block_ids": 7, "tile_rows": 40}])
def test_sample_distances_match_brute_force(profile, method, tiling):
    data, df = profile
    got = {(r.a, r.b): r.d for r in D.sample_distances(df, method, **tiling).collect()}
    pairs = list(itertools.combinations(sorted(data), 2))
    assert sorted(got) == pairs
    for a, b in pairs:
        assert got[a, b] == pytest.approx(BRUTE[method](*_dense(data[a], data[b])), abs=1e-9)


def test_disjoint_pairs_can_be_left_out(profile):
    _, df = profile
    got = {(r.a, r.b) for r in D.sample_distances(df, "jensen_shannon", fill_disjoint=False, tile_rows=50).collect()}
    assert not any("x1" in p or "x2" in p for p in got) and len(got) == 40 * 39 / 2


def test_bounds_of_the_measures(profile):
    _, df = profile
    js = [r.d for r in D.sample_distances(df, "jensen_shannon").collect()]
    jaccard = [r.d for r in D.sample_distances(df, "jaccard").collect()]
    assert 0 <= min(js) and max(js) <= math.log(2) + 1e-12
    assert 0 <= min(jaccard) and max(jaccard) == 1


def test_unknown_method_and_missing_table_raise(profile):
    with pytest.raises(ValueError):
        D.sample_distances(profile[1], "cosine")
    with pytest.raises(ValueError):
        D.sample_distances(profile[1], "precomputed")


def _taxon_table(spark, taxa):
    rng = np.random.default_rng(5)
    d = {(a, b): float(x) for (a, b), x in zip(itertools.combinations(sorted(taxa), 2), rng.random(len(taxa) ** 2))}
    full = lambda a, b: 0.0 if a == b else d[min(a, b), max(a, b)]
    return full, spark.createDataFrame([(a, b, x) for (a, b), x in d.items()], "a string, b string, d double")


@pytest.mark.parametrize("tiling", [{}, {"block_ids": 9, "tile_rows": 300}])
def test_mean_linkage_and_phylogenetic_similarity(spark, profile, tiling):
    data, df = profile
    small = {s: p for s, p in data.items() if s in ("s1", "s2", "s3", "s4", "x1", "x2")}
    df = df.where(df.sample_id.isin(list(small)))
    full, table = _taxon_table(spark, {t for p in small.values() for t in p})
    linked = {(r.a, r.b): r.d for r in D.sample_distances(df, "precomputed", table, **tiling).collect()}
    known = df.select("taxon_id").distinct()
    similar = {(r.a, r.b): r.similarity for r in D.phylogenetic_similarity(df, table, known, **tiling).collect()}
    for a, b in itertools.combinations(sorted(small), 2):
        m = np.array([[full(x, y) for y in small[b]] for x in small[a]])
        assert linked[a, b] == pytest.approx(m.mean())
        assert similar[a, b] == pytest.approx(math.exp(-0.5 * (m.min(axis=1).mean() + m.min(axis=0).mean())))


def test_two_sided_minimum_over_many_tiles(spark):
    left = [(f"l{i}", f"k{j}", 1.0, float(i)) for i in range(20) for j in range(i % 5 + 1)]
    right = [(f"r{i}", f"k{j}", float(i * 10 + j), 0.0) for i in range(15) for j in range(5)]
    cols = "id string, key string, x double, w double"
    got = tiled_pairs(spark.createDataFrame(left, cols), spark.createDataFrame(right, cols),
                      term="right", combine="min", block_ids=4, tile_rows=30).collect()
    assert len(got) == 300
    for r in got:
        assert r.s == int(r.b[1:]) * 10 and r.wa == int(r.a[1:])


def test_hamming_pairs_with_copies_and_lower_case(spark):
    seqs = {"A": "AC-T", "B": "ac-t", "C": "ACGT", "D": "AAAA", "E": "ACGT"}
    df = spark.createDataFrame(list(seqs.items()), "taxon_id string, aln string")
    got = {(r.a, r.b): r.d for r in Q.hamming_pairs(df).collect()}
    up = {k: v.upper() for k, v in seqs.items()}
    assert got == {(a, b): float(sum(x != y for x, y in zip(up[a], up[b]))) for a, b in itertools.combinations("ABCDE", 2)}


def test_ragged_alignment_raises(spark):
    df = spark.createDataFrame([("A", "ACGT"), ("B", "ACG")], "taxon_id string, aln string")
    with pytest.raises(Exception, match="differ in length"):
        Q.hamming_pairs(df).collect()


def test_aligned_nn_prefers_smaller_id_and_stays_in_its_project(spark):
    q = spark.createDataFrame([("q1", "AAAA", "p"), ("q2", "CCCC", "p"), ("q3", "AAAA", "z")], "taxon_id string, aln string, project string")
    d = spark.createDataFrame([("d2", "AAAC", "p"), ("d1", "AACA", "p"), ("d3", "CCCC", "y"), ("d4", "CCCC", "y")], "taxon_id string, aln string, project string")
    everywhere = {r.query: (r.answer, r.similarity) for r in Q.aligned_nn(q, d).collect()}
    assert everywhere == {"q1": ("d1", 0.75), "q2": ("d3", 1.0), "q3": ("d1", 0.75)}
    within = {r.query: r.answer for r in Q.aligned_nn(q, d, by="project").collect()}
    assert within == {"q1": "d1", "q2": "d1"}  # project z has no database sequence


def test_aligned_nn_matches_brute_force_with_copies(spark):
    rng = np.random.default_rng(2)
    make = lambda p, n: [(f"{p}{i}", "".join(rng.choice(list("ACGT-"), 12))) for i in range(n)]
    qs, ds = make("q", 60), make("d", 80)
    ds += [(f"copy{i}", ds[0][1]) for i in range(40)]
    cols = "taxon_id string, aln string"
    got = {r.query: (r.answer, r.similarity) for r in Q.aligned_nn(spark.createDataFrame(qs, cols), spark.createDataFrame(ds, cols)).collect()}
    for name, s in qs:
        h, best = min((sum(x != y for x, y in zip(s, t)), n) for n, t in ds)
        assert got[name] == (best, pytest.approx(1 - h / 12))


def test_nearest_sequences_meet_few_of_the_database(spark):
    """Neighbours at 0 to 30 of 120 places, conserved columns, copies and two groups: exact, with counted comparisons."""
    rng = np.random.default_rng(9)
    letters = np.array(list("ACGT-"))
    base = letters[rng.integers(0, 5, (400, 120))]
    base[:, :40] = "-"  # a stretch that all share
    near = base[rng.integers(0, 400, 60)].copy()
    for i, row in enumerate(near):
        at = 40 + rng.permutation(80)[:[0, 1, 3, 9, 14, 30][i % 6]]
        row[at] = letters[(np.searchsorted(letters, row[at], sorter=np.argsort(letters)) + 1) % 5]
    text = lambda m: ["".join(r) for r in m]
    answers = [("x" if i % 4 else "y", s, f"d{i:03}") for i, s in enumerate(dict.fromkeys(text(base)))]
    asked = sorted({(g, s) for i, s in enumerate(text(near)) for g in (["x"], ["x", "y"], ["none"])[i % 3]})
    counted = []
    got = {(r.grp, r.aln): (r.h, r.answer) for r in Q.nearest_sequences(
        spark.createDataFrame(asked, "grp string, aln string"), spark.createDataFrame(answers, "grp string, aln string, answer string"), counted).collect()}
    want = {(g, s): min((sum(x != y for x, y in zip(s, t)), a) for o, t, a in answers if o == g) for g, s in asked if g != "none"}
    assert got == want
    pairs = sum(o == g for g, _ in asked for o, _, _ in answers)
    # The radius grows only for what is open: the first rounds settle most, for a few comparisons.
    assert len(counted) >= 3 and sum(counted[:2]) < pairs / 20 and sum(counted) < pairs


@pytest.mark.parametrize("k", [3, 12])
def test_top_similar_sets(spark, k):
    """Near copies, sets that share nothing, empty sets and ties: always k rows, from fewer meetings than pairs that share a key."""
    rng = np.random.default_rng(5)
    base = {f"b{i:02}": set(map(str, rng.integers(0, 5000, 30))) | set(map(str, rng.integers(0, 6, 3))) for i in range(30)}
    for i in range(30, 70):  # five groups of near copies
        base[f"b{i:02}"] = set(sorted(base[f"b{i % 5:02}"])[int(rng.integers(0, 4)):]) | {f"own{i}"}
    queries = {f"q{i:02}": set(sorted(base[f"b{i % 70:02}"])[i % 3:]) for i in range(40)}
    queries |= {"q90": set(), "q91": {"nowhere"}, "q92": {"1"}}
    jaccard = lambda x, y: len(x & y) / max(1, len(x | y))
    want = {(q, b, i + 1) for q, s in queries.items() for i, b in enumerate(sorted(base, key=lambda b: (-jaccard(s, base[b]), b))[:k])}
    rows = lambda sets: spark.createDataFrame([(i, key) for i, s in sets.items() for key in s or [None]], "id string, key string")
    counted = []
    got = top_similar_sets(rows(queries), rows(base), k, counted=counted).collect()
    assert {(r.id, r.other, r["rank"]) for r in got} == want and len(got) == len(want)
    assert all(r.jaccard == pytest.approx(jaccard(queries[r.id], base[r.other])) for r in got)
    every = sum(len(s & t) for s in queries.values() for t in base.values())
    assert len(counted) > 1 and counted[0] < every / 3


def test_best_of_lookups_first_table_wins_ties(spark):
    cols = "query string, answer string, similarity double"
    one = spark.createDataFrame([("a", "x", 0.5), ("b", "x", 0.1)], cols)
    two = spark.createDataFrame([("a", "w", 0.5), ("b", "y", 0.9), ("c", "z", 0.0)], cols)
    got = {r["query"]: r.answer for r in Q.best_of_lookups([one, two]).collect()}
    assert got == {"a": "x", "b": "y", "c": "z"}


def test_mean_linkage_of_single_taxon_samples_and_with_a_missing_distance(spark):
    profile = spark.createDataFrame(
        [("a", "T", 1.0), ("b", "T", 1.0), ("c", "T", 0.5), ("c", "U", 0.5)], "sample_id string, taxon_id string, rel_abund double")
    table = spark.createDataFrame([("T", "U", 3.0)], "a string, b string, d double")
    got = {(r.a, r.b): r.d for r in D.sample_distances(profile, "precomputed", table).collect()}
    assert got == {("a", "b"): 0.0, ("a", "c"): 1.5, ("b", "c"): 1.5}
    with pytest.raises(ValueError, match="1 pairs"):
        D.sample_distances(profile, "precomputed", table.where("false"))


def test_mean_linkage_over_known_taxa_and_with_two_distances(spark):
    profile = spark.createDataFrame([("a", "T", 1.0), ("b", "U", 1.0), ("c", "V", 1.0)], "sample_id string, taxon_id string, rel_abund double")
    table = spark.createDataFrame([("T", "U", 3.0), ("T", "U", 3.0)], "a string, b string, d double")
    known = spark.createDataFrame([("T",), ("U",)], "taxon_id string")
    with pytest.raises(ValueError, match="1 samples have no known taxon, the first is c"):
        D.mean_linkage(profile, table, known)
    got = D.mean_linkage(profile.where("sample_id <> 'c'"), table, known).collect()
    assert [(r.a, r.b, r.d) for r in got] == [("a", "b", 3.0)]  # a pair listed twice counts once
    with pytest.raises(ValueError, match="two distances"):
        D.mean_linkage(profile.where("sample_id <> 'c'"), table.unionByName(table.selectExpr("a", "b", "d + 1 AS d")))
