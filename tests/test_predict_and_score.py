import math

import numpy as np
import pytest

from conftest import rows
from taxaspark.operators import baseline as BL, metrics as M, stats as S

PROFILE = "sample_id string, taxon_id string, rel_abund double"
NN = "query string, answer string, similarity double"


@pytest.fixture(scope="module")
def study(spark):
    rng = np.random.default_rng(8)
    def make(prefix, n, taxa):
        out = {}
        for s in range(n):
            chosen = rng.choice(taxa, rng.integers(3, 9), replace=False)
            w = rng.random(len(chosen)) + 0.05
            out[f"{prefix}{s}"] = dict(zip(map(str, chosen), (w / w.sum()).tolist()))
        return out
    train = make("tr", 15, [f"t{i}" for i in range(20)])
    test = make("te", 6, [f"t{i}" for i in range(15, 35)])
    known = sorted({t for p in train.values() for t in p})
    asked = sorted({t for p in test.values() for t in p})
    nn = {t: (t if t in known else known[int(t[1:]) % len(known)]) for t in asked[:-2]}
    frame = lambda d: spark.createDataFrame([(s, t, v) for s, p in d.items() for t, v in p.items()], PROFILE)
    lookup = spark.createDataFrame([(q, a, 1.0) for q, a in nn.items()], NN)
    return train, test, nn, frame(train), frame(test), lookup


def _brute(train, test, nn, k, eps=None):
    known = {t for p in train.values() for t in p}
    gm = lambda v: math.exp(np.mean(np.log(np.array(v) + (eps or 0))))
    out = {}
    for s, p in test.items():
        target = {t: nn.get(t, t if t in known else None) for t in p}
        wanted = {x for x in target.values() if x}
        near = list(train)
        if k is not None:
            score = lambda b: -len(wanted & set(train[b])) / len(wanted | set(train[b]))
            near = sorted(train, key=lambda b: (score(b), b))[:k]
        weights = {}
        for t, a in target.items():
            values = [train[b][a] for b in near if a in train[b]] or [q[a] for q in train.values() if a in q]
            weights[t] = gm(values) if a else 0.0
        total = sum(weights.values())
        out.update({(s, t): w / total for t, w in weights.items()})
    return out


@pytest.mark.parametrize("k,eps", [(None, None), (1, None), (3, None), (50, None), (3, 1e-6)])
def test_nearest_neighbour_predictions_match_brute_force(study, k, eps):
    train, test, nn, train_df, test_df, lookup = study
    got = {(r.sample_id, r.taxon_id): r.pred for r in BL.predict_nn(test_df, train_df, lookup, k=k, eps=eps).collect()}
    want = _brute(train, test, nn, k, eps)
    assert set(got) == set(want)
    for key in want:
        assert got[key] == pytest.approx(want[key], abs=1e-12)


def test_several_k_at_once_equal_one_by_one(study):
    _, _, _, train_df, test_df, lookup = study
    every = BL.predict_nn_all(test_df, train_df, lookup, ks=(1, 3))
    for k in (None, 1, 3):
        one = {(r.sample_id, r.taxon_id): r.pred for r in BL.predict_nn(test_df, train_df, lookup, k=k).collect()}
        many = {(r.sample_id, r.taxon_id): r.pred for r in every.collect() if r.k == k}
        assert one == pytest.approx(many)


def test_uniform_and_log_predictions_normalise(study):
    _, test, _, train_df, test_df, lookup = study
    uniform = {(r.sample_id, r.taxon_id): r.pred for r in BL.predict_uniform(test_df).collect()}
    assert all(v == pytest.approx(1 / len(test[s])) for (s, _), v in uniform.items())
    from taxaspark.operators.validation import unnormalised_predictions
    lp = BL.log_predictions(BL.predict_nn(test_df, train_df, lookup))
    assert unnormalised_predictions(lp).count() == 0
    assert lp.where("lp is null or lp < -40").count() == 0


def test_all_zero_weights_are_reported(spark, study):
    _, _, _, train_df, _, lookup = study
    lost = spark.createDataFrame([("z", "never", 1.0)], PROFILE)
    assert rows(BL.empty_predictions(BL.predict_nn(lost, train_df, lookup))) == [("z",)]


def _ranks(v):
    v = np.asarray(v)
    return np.array([(v < x).sum() + ((v == x).sum() + 1) / 2 for x in v])


def test_metrics_match_numpy_and_do_not_depend_on_taxon_order(spark, study):
    _, test, _, train_df, test_df, lookup = study
    lp_df = BL.log_predictions(BL.predict_nn(test_df, train_df, lookup))
    got = {r.sample_id: r for r in M.evaluate(lp_df, test_df).collect()}
    shuffled = {r.sample_id: r for r in M.evaluate(lp_df.orderBy("taxon_id"), test_df.orderBy("lp" if "lp" in test_df.columns else "rel_abund")).collect()}
    lp = {}
    for r in lp_df.collect():
        lp.setdefault(r.sample_id, {})[r.taxon_id] = r.lp
    for s, p in test.items():
        t = np.array([p[x] for x in sorted(p)])
        l = np.array([lp[s][x] for x in sorted(p)])
        e, m = np.exp(l), (t + np.exp(l)) / 2
        assert got[s].KL_err == pytest.approx((t * (np.log(t) - l)).sum())
        assert got[s].RMSL_err == pytest.approx(np.sqrt((((l - np.log(t)) / np.log(10)) ** 2).mean()))
        assert got[s].BrayCurtis == pytest.approx(1 - 2 * np.minimum(t, e).sum() / (t + e).sum())
        assert got[s].RootJensenShannon == pytest.approx(np.sqrt(0.5 * ((t * np.log(t / m)).sum() + (e * np.log(e / m)).sum())))
        assert got[s].SpearmanCorr == pytest.approx(np.corrcoef(_ranks(t.astype("f4")), _ranks(l.astype("f4")))[0, 1])
        assert got[s].NumTaxa == len(t)
        assert got[s].KL_err == pytest.approx(shuffled[s].KL_err)


def test_spearman_is_null_for_a_constant_side(spark):
    df = spark.createDataFrame([("a", 1.0, 2.0), ("a", 1.0, 3.0)], "g string, x double, y double")
    assert M.spearman(df, ["g"], "x", "y").first().SpearmanCorr is None


def test_losses_by_hand(spark):
    truth = spark.createDataFrame([("a", "x", 0.75), ("a", "y", 0.25), ("b", "x", 1.0), ("b", "z", 0.0), ("b", "y", 0.0)], PROFILE)
    lp = spark.createDataFrame(
        [("a", "x", math.log(0.5)), ("a", "y", math.log(0.5)), ("b", "x", math.log(0.8)), ("b", "z", math.log(0.1)), ("b", "y", math.log(0.1))],
        "sample_id string, taxon_id string, lp double")
    kl = [0.75 * math.log(1.5) + 0.25 * math.log(0.5), -math.log(0.8)]
    ce = [-math.log(0.5), -math.log(0.8)]
    ml = [(math.log(1.5) ** 2 + math.log(0.5) ** 2) / 2, math.log(0.8) ** 2]
    ms = [(0.25**2 + 0.25**2) / 2, 0.2**2]
    for name, per in {"kl": kl, "cross_entropy": ce, "mse_log": ml, "mse": ms}.items():
        value = lambda r: M.loss(lp, truth, name, r).first().loss
        assert value("sum") == pytest.approx(sum(per))
        assert value("batchmean") == pytest.approx(sum(per) / 2)
        assert value("mean") == pytest.approx(sum(per) / (2 if name == "mse_log" else 6))
        assert [r.loss for r in M.loss(lp, truth, name, "none").orderBy("sample_id").collect()] == pytest.approx(per)
    with pytest.raises(ValueError):
        M.loss(lp, truth, "hinge")


def test_log_softmax_masks_and_survives_large_logits(spark):
    df = spark.createDataFrame([("a", "x", 1000.0, True), ("a", "y", 1000.0, True), ("a", "z", 5000.0, False), ("b", "x", -3.0, True)],
                               "sample_id string, taxon_id string, logit double, mask boolean")
    got = {(r.sample_id, r.taxon_id): r.lp for r in M.log_softmax(df, mask="mask").collect()}
    assert got["a", "x"] == got["a", "y"] == pytest.approx(math.log(0.5))
    assert got["a", "z"] == -math.inf and got["b", "x"] == pytest.approx(0.0)


# --- statistics -------------------------------------------------------------------

RESULTS = "Method string, SampleId string, Seed long, DataSplitSeed long, KL_err double"


def test_variance_decomposition_four_cases(spark):
    data = []
    for split in (1, 2):
        for seed in (10, 20):
            data += [("full", f"s{i}", seed, split, split + seed / 100 + i) for i in range(3)]
        data += [("no_seed", f"s{i}", None, split, float(split * 2 + i)) for i in range(3)]
    for seed in (10, 20):
        data += [("one_split", f"s{i}", seed, 1, seed + i * 0.5) for i in range(3)]
    data += [("fixed", f"s{i}", None, None, float(i)) for i in range(3)]
    got = {r.Method: r for r in S.variance_decomposition(spark.createDataFrame(data, RESULTS), "KL_err").collect()}
    sd = lambda *v: np.std(v, ddof=1)
    assert got["full"]["mean"] == pytest.approx(2.65) and got["full"].n_runs == 4
    assert got["full"].std_seed == pytest.approx(sd(0.1, 0.2)) and got["full"].std_split == pytest.approx(sd(1, 2))
    assert got["no_seed"].std_seed is None and got["no_seed"].std_split == pytest.approx(sd(3, 5)) and got["no_seed"].n_runs == 2
    assert got["one_split"].std_seed == pytest.approx(sd(10.5, 20.5)) and got["one_split"].std_split is None
    assert (got["fixed"]["mean"], got["fixed"].std_seed, got["fixed"].std_split, got["fixed"].n_runs) == (1.0, None, None, 1)
    best = {r.Method: r.is_best for r in S.flag_best(S.variance_decomposition(spark.createDataFrame(data, RESULTS), "KL_err")).collect()}
    assert [m for m, b in best.items() if b] == ["fixed"]


def test_mean_std_of_medians_null_std_for_one_run(spark):
    data = [("m", f"s{i}", seed, None, float(i * seed)) for i in range(5) for seed in (1, 3)] + [("d", "s0", None, None, 4.0)]
    got = {r.Method: tuple(r)[1:] for r in S.mean_std_of_medians(spark.createDataFrame(data, RESULTS), "KL_err").collect()}
    assert got["m"] == (4.0, pytest.approx(math.sqrt(8)), 2) and got["d"] == (4.0, None, 1)


def test_exact_and_normal_wilcoxon_p():
    assert S.wilcoxon_p(5, 0, -2.0, 0) == pytest.approx(2 / 32)
    assert S.wilcoxon_p(8, 5, None, 0) == pytest.approx(0.0781, abs=1e-4)
    assert S.wilcoxon_p(60, 500, -3.05, 0) == pytest.approx(0.002288, abs=1e-5)
    assert S.wilcoxon_p(10, 27.5, 0.0, 6) == pytest.approx(1.0)


def test_student_p_reference_values():
    assert S.student_p(2.228139, 10) == pytest.approx(0.05, abs=1e-6)
    assert S.student_p(12.7062, 1) == pytest.approx(0.05, abs=1e-6)
    assert S.student_p(0.0, 7) == 1.0
    assert S.student_p(-1.959964, 1e6) == pytest.approx(0.05, abs=1e-5)


def test_pairwise_wilcoxon_edge_cases(spark):
    data = [("a", f"s{i}", 1, None, float(i)) for i in range(8)] + [("b", f"s{i}", 1, None, float(i)) for i in range(8)]
    data += [("c", f"s{i}", 1, None, i + 0.1 * (i + 1)) for i in range(8)] + [("lone", "s0", 1, None, 3.0)]
    got = {(r.method_a, r.method_b): r for r in S.pairwise_wilcoxon(spark.createDataFrame(data, RESULTS), ["SampleId"]).collect()}
    assert (got["a", "b"].p, got["a", "b"].cl, got["a", "b"].n_nonzero) == (1.0, 0.5, 0)
    assert got["a", "c"].p == pytest.approx(2 / 256) and got["a", "c"].cl == 1.0 and got["a", "c"].w == 0.0
    assert got["a", "lone"].p is None and got["a", "lone"].p_adj is None and got["a", "lone"].n == 1
    assert got["a", "c"].p_adj == pytest.approx(2 / 256 * 3 / 2) and got["a", "c"].mark == "*"
    pairs = spark.createDataFrame([(a, b, r.cl) for (a, b), r in got.items()], "method_a string, method_b string, cl double")
    both = {(r.method_a, r.method_b): r.cl for r in S.symmetric(pairs).collect()}
    assert all(both[a, b] + both[b, a] == pytest.approx(1) for a, b in got if got[a, b].cl is not None)


def test_tied_differences_use_average_ranks(spark):
    a, b = [1.0, 2.0, 3.0, 4.0, 5.0], [2.0, 1.0, 3.0, 6.0, 2.0]  # differences -1 1 0 -2 3
    data = [(m, f"s{i}", 1, None, v) for m, vs in (("a", a), ("b", b)) for i, v in enumerate(vs)]
    r = S.wilcoxon_statistics(S.method_pairs(spark.createDataFrame(data, RESULTS), ["SampleId"], "KL_err")).first()
    assert (r.n, r.n_nonzero, r.w_plus, r.w_minus, r.tie_term, r.cl) == (5, 4, 5.5, 4.5, 6.0, 0.5)


def test_p_adjustment_known_values(spark):
    p = [0.01, 0.04, 0.03, None, 0.005]
    df = spark.createDataFrame(list(enumerate(p)), "i int, p double")
    want = {
        "bonferroni": [0.04, 0.16, 0.12, None, 0.02], "holm": [0.03, 0.06, 0.06, None, 0.02],
        "fdr_bh": [0.02, 0.04, 0.04, None, 0.02], "fdr_by": [x and x * 25 / 12 for x in [0.02, 0.04, 0.04, None, 0.02]],
    }
    for method, values in want.items():
        got = [r.p_adj for r in S.adjust_p(df, "p", method).orderBy("i").collect()]
        assert [v is None for v in got] == [v is None for v in values]
        assert [v for v in got if v is not None] == pytest.approx([v for v in values if v is not None])
    with pytest.raises(ValueError):
        S.adjust_p(df, "p", "sidak")


def test_welch_by_hand_and_single_seed(spark):
    data = [("a", "s", i, None, v) for i, v in enumerate([1.0, 2.0, 3.0, 4.0])] + [("b", "s", i, None, v) for i, v in enumerate([2.0, 4.0, 9.0])]
    data += [("c", "s", 1, None, 1.0)]
    got = {(r.method_a, r.method_b): r for r in S.pairwise_welch(spark.createDataFrame(data, RESULTS)).collect()}
    va, vb = np.var([1, 2, 3, 4], ddof=1) / 4, np.var([2, 4, 9], ddof=1) / 3
    assert got["a", "b"].t == pytest.approx((2.5 - 5) / math.sqrt(va + vb))
    assert got["a", "b"].df == pytest.approx((va + vb) ** 2 / (va**2 / 3 + vb**2 / 2))
    assert 0 < got["a", "b"].p < 1 and got["a", "c"].p is None


def test_seed_table_has_a_column_per_seed(spark):
    data = [("a", f"s{i}", seed, None, float(i + seed)) for i in range(3) for seed in (1, 2)] + [("b", "s0", 1, None, 5.0)]
    got = {r.Method: tuple(r)[1:] for r in S.seed_table(spark.createDataFrame(data, RESULTS), "KL_err", [1, 2]).collect()}
    assert got == {"a": (2.0, 3.0, 2.5, 0.5), "b": (5.0, None, 5.0, 0.0)}


def test_predictions_with_gaps_raise(spark):
    truth = spark.createDataFrame([("s1", "x", 0.5), ("s1", "y", 0.5), ("s2", "x", 1.0)], "sample_id string, taxon_id string, rel_abund double")
    lp = "Method string, sample_id string, taxon_id string, lp double"
    whole = [("m", "s1", "x", -0.7), ("m", "s1", "y", -0.7), ("m", "s2", "x", 0.0)]
    keys = ("Method", "sample_id")
    assert M.evaluate(spark.createDataFrame(whole, lp), truth, keys).count() == 2
    for rest in (whole[1:], whole[:2]):
        gappy = spark.createDataFrame(rest, lp)
        with pytest.raises(Exception, match="do not cover"):
            M.evaluate(gappy, truth, keys).collect()
        with pytest.raises(Exception, match="do not cover"):
            M.evaluate(gappy.drop("Method"), truth).collect()
        for reduction in ("none", "sum"):
            with pytest.raises(Exception, match="do not cover"):
                M.loss(gappy.drop("Method"), truth, "kl", reduction).collect()
    assert [tuple(r) for r in M.prediction_gaps(spark.createDataFrame(whole[1:], lp), truth, keys).collect()] == [("m", "s1", "x")]


def test_violations_of_predictions_and_truth(spark):
    truth = spark.createDataFrame([("s1", "x", 0.5), ("s1", "y", 0.5), ("s2", "x", 1.0), ("s3", "x", 0.9)], "sample_id string, taxon_id string, rel_abund double")
    half = math.log(0.5)
    rows_ = [("m", "s1", "x", half), ("m", "s1", "y", half), ("m", "s2", "x", -1.0), ("m", "s3", "x", 0.0),
             ("o", "s1", "x", half), ("o", "s1", "z", half), ("o", "s2", "x", 0.0), ("o", "s4", "x", 0.0)]
    lp = spark.createDataFrame(rows_, "Method string, sample_id string, taxon_id string, lp double")
    groups = spark.createDataFrame([("m",), ("p",)], "Method string")
    got = {tuple(r) for r in M.evaluation_violations(lp, truth, ("Method", "sample_id"), groups).collect()}
    assert got == {("m", "s2", "prediction sum"), ("o", "s1", "not in truth"), ("o", "s1", "missing taxon"), ("o", "s4", "not in truth"),
                   ("o", "s3", "no prediction"), ("p", "s1", "no prediction"), ("p", "s2", "no prediction"), ("p", "s3", "no prediction"),
                   (None, "s3", "truth sum")}


def test_a_study_from_its_files_to_one_result_per_method(spark, study, tmp_path):
    from taxaspark.operators import evaluation as E
    from taxaspark.sources import files as S
    _, _, _, train_df, test_df, lookup = study
    parts = {"Train": train_df, "Test": test_df}
    split = None
    for label, df in parts.items():
        part = df.select("sample_id").distinct().selectExpr("sample_id", "'P' project", f"'{label}' label")
        split = part if split is None else split.unionByName(part)
    S.write_split(split, str(tmp_path / "split"))
    S.write_nn_lookup(lookup, str(tmp_path / "nn"))
    counts = train_df.unionByName(test_df).selectExpr("sample_id", "taxon_id", "cast(round(rel_abund * 1e6) as long) n").toPandas()
    wide = counts.pivot_table(index="taxon_id", columns="sample_id", values="n", aggfunc="sum", fill_value=0)
    wide.index.name = "asv"
    wide.to_csv(tmp_path / "P.txt", sep="\t")
    methods = E.evaluate_study(spark, str(tmp_path / "split"), str(tmp_path / "P.txt"), str(tmp_path / "nn"), str(tmp_path / "out"), ks=(1, 3))
    assert methods == ["uniform", "nearest_neighbor", "nearest_neighbor_KNN_1", "nearest_neighbor_KNN_3"]
    back = S.read_results(spark, str(tmp_path / "out")).collect()
    direct = {(r.Method, r.sample_id): r for r in E.evaluate_all(test_df, train_df, lookup, ks=(1, 3)).collect()}
    assert len(back) == len(direct) == 4 * test_df.select("sample_id").distinct().count()
    for r in back:
        assert r.KL_err == pytest.approx(direct[r.Method, r.SampleId].KL_err, abs=1e-3) and r.Seed is None
    assert E.evaluate_study(spark, "nowhere", "nowhere", "nowhere", str(tmp_path / "out"), ks=(1, 3), overwrite=False) == []
    lost = test_df.withColumn("rel_abund", test_df.rel_abund * 0.5)
    with pytest.raises(ValueError, match="truth sum"):
        E.evaluate_all(lost, train_df, lookup, ks=())
