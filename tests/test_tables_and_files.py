import os

import numpy as np
import pytest
import zstandard

from conftest import rows
from taxaspark.functions import columns as C
from taxaspark.operators import features as X, filters as FL, hits as H, profile as P, validation as V
from taxaspark.sources import files as S
from pyspark.sql import functions as F


def one(spark, column, **values):
    names = list(values)
    df = spark.createDataFrame([tuple(values.values())], ", ".join(f"{n} {'string' if isinstance(values[n], str) else 'double'}" for n in names))
    return df.select(column.alias("x")).first().x


# --- columns ---------------------------------------------------------------------

@pytest.mark.parametrize("text,domain", [
    ("Bacteria;Proteobacteria", "Bacteria"), ("k__Bacteria;p__X", "Bacteria"), (" archaebacteria ;x", "Archaea"),
    ("Eukarya;y", "Eukaryota"), ("", "Unknown"), ("  ;x", "Unknown"), ("Viruses;z", "Unknown (Viruses)")])
def test_taxonomy_domain(spark, text, domain):
    assert one(spark, C.taxonomy_domain("t"), t=text) == domain


@pytest.mark.parametrize("text,hit", [
    ("Uncultured 16S rRNA gene", True), ("chloroplast 16S rRNA", False), ("16S and 23S rRNA", False), ("whole genome", False),
    ("SSU rRNA", True)])
def test_is_16s(spark, text, hit):
    assert one(spark, C.is_16s("t"), t=text) is hit


@pytest.mark.parametrize("marker,taxon,gene", [
    ("p0001:123__GCA_9", "SGB123", "p0001"), ("p0001:SGB123__GCA", "SGB123", "p0001"),
    ("SGB77__UniRef90_x", "SGB77", "UniRef90_x"), ("nothing", None, "")])
def test_marker_grammars(spark, marker, taxon, gene):
    assert one(spark, C.marker_taxon("m"), m=marker) == taxon
    assert one(spark, C.marker_gene("m"), m=marker) == gene


@pytest.mark.parametrize("name,want", [
    ("evo2_7b_hyena10", ("evo2", 4096, None, 10)), ("evo-1-8k-base", ("evo-1", 4096, None, 32)),
    ("dnabert-s", ("dnabert-s", 768, None, None)), ("umap_d20_s1234", ("umap", 20, 1234, None)), ("pcoa_d4_s7", ("pcoa", 4, 7, None))])
def test_embedding_model_names(spark, name, want):
    assert tuple(one(spark, C.embedding_model("m"), m=name)) == want


@pytest.mark.parametrize("name", ["umap_20_s1", "pcoa_dx_s1", "word2vec", "evo2_hyena3_hyena4"])
def test_bad_embedding_model_names_raise(spark, name):
    with pytest.raises(Exception, match="unknown embedding model"):
        one(spark, C.embedding_model("m"), m=name)


def test_small_functions(spark):
    assert one(spark, C.clean_country("g"), g=" USA: Boston ") == "United States of America"
    assert one(spark, C.clean_country("g"), g="Not applicable") is None
    assert one(spark, C.strip_group_suffix("g"), g="SGB12_group") == "SGB12"
    assert one(spark, C.species_from_clade("g"), g="k__B|s__x|t__SGB5_group") == "SGB5_group"
    assert one(spark, C.species_from_clade("g"), g="k__B|s__x") is None
    assert one(spark, C.hamming("a", "b"), a="ACGT", b="AC-A") == 2
    assert one(spark, C.pad_vector(F.array(F.lit(1.0)), 3), g="") == [1.0, 0.0, 0.0]
    assert [one(spark, C.significance_mark("p"), p=p) for p in (0.0009, 0.009, 0.049, 0.05)] == ["***", "**", "*", "n.s."]
    assert one(spark, C.jaccard(F.array().cast("array<int>"), F.array().cast("array<int>")), g="") is None


def test_non_gap_span_skips_reference_gaps(spark):
    # columns: fragment starts where the reference has a gap, and ends the same way
    assert tuple(one(spark, C.non_gap_span("a", "r"), a="-ACG-T--", r="AC-GT-AA")) == (1, 2)
    assert tuple(one(spark, C.non_gap_span("a", "r"), a="-----", r="ACGTA")) == (None, None)


# --- profiles and filters ---------------------------------------------------------

COUNTS = "project string, sample_id string, taxon_id string, n long"


def test_relative_abundance_and_restriction(spark):
    counts = spark.createDataFrame([("p", "a", "x", 3), ("p", "a", "y", 1), ("p", "a", "z", 0), ("p", "b", "x", 5)], COUNTS)
    assert rows(P.relative_abundance(counts)) == [("a", "x", 0.75), ("a", "y", 0.25), ("b", "x", 1.0)]
    keep = spark.createDataFrame([("y",)], "taxon_id string")
    assert rows(P.relative_abundance(counts, keep)) == [("a", "y", 1.0)]
    assert V.sum_violations(P.relative_abundance(counts)).count() == 0


def test_padded_profile_in_chunks(spark):
    profile = spark.createDataFrame([("a", "t0", 0.5), ("a", "t4", 0.25), ("a", "off", 0.25), ("b", "t1", 1.0)], "sample_id string, taxon_id string, rel_abund double")
    order = spark.createDataFrame([(f"t{i}", i) for i in range(5)], "taxon_id string, ord int")
    got = {(r.sample_id, r.chunk): r.vec for r in P.padded_profile(profile, order, width=2).collect()}
    assert got == {("a", 0): [pytest.approx(2 / 3), 0.0], ("a", 1): [0.0, 0.0], ("a", 2): [pytest.approx(1 / 3)],
                   ("b", 0): [0.0, 1.0], ("b", 1): [0.0, 0.0], ("b", 2): [0.0]}


def test_filter_composite_by_hand(spark):
    counts = [("p", f"s{i}", "common", 20) for i in range(5)] + [("p", f"s{i}", f"own{i}", 10 + i) for i in range(5)]
    counts += [("p", "s0", "rare", 2), ("q", "lone", "common", 50)]
    counts = spark.createDataFrame(counts, COUNTS)
    samples = spark.createDataFrame([(f"s{i}", "p") for i in range(5)] + [("lone", "q")], "sample_id string, project string")
    projects = spark.createDataFrame([("p",), ("q",), ("empty",)], "project string")
    seqs = spark.createDataFrame([("common", "A"), ("own2", "C"), ("rare", "G")], "taxon_id string, seq string")
    out = FL.filter_samples_and_taxa(projects, samples, counts, seqs, read_count_lb=10, min_taxa=2, max_taxa=9, q=(0.2, 0.8))
    # depths 32 31 32 33 34: band 31.8 … 33.2
    assert rows(out["samples"].select("sample_id", "read_counts", "n_taxa")) == [("s0", 32, 2), ("s2", 32, 2), ("s3", 33, 2)]
    assert rows(out["projects"]) == [("p",)]
    assert rows(out["sequences"]) == [("common", "A"), ("own2", "C")]
    assert out["max_taxa"].first().max_taxa == 2
    assert out["counts"].where("taxon_id = 'rare'").count() == 0


def test_first_records_fold_and_new_taxa(spark):
    records = spark.createDataFrame([("g1", "late", 5), ("g1", "first", 1), ("g2", "x", 3)], "id string, seq string, pos int")
    assert rows(P.first_records(records, "id", ["pos"]).select("id", "seq")) == [("g1", "first"), ("g2", "x")]
    labels = spark.createDataFrame([("a",)] * 3 + [("b",)], "c string")
    assert rows(FL.value_counts(FL.fold_rare(labels, "c", 2), "c")) == [("Other", 1), ("a", 3)]
    taxa = spark.createDataFrame([("p", "x"), ("q", "x"), ("q", "y")], "project string, taxon_id string")
    order = spark.createDataFrame([("q", 2), ("p", 1), ("r", 3)], "project string, ord int")
    assert rows(FL.new_taxa_per_project(taxa, order)) == [("p", 1), ("q", 1), ("r", 0)]


def test_verdicts(spark):
    hits = spark.createDataFrame([
        ("q1", "Bacteria;x", 99.0), ("q1", "Eukaryota;x", 99.0), ("q2", "k__Bacteria", 98.0), ("q3", "Archaea", 99.0),
        ("q4", "Eukarya", 99.0), ("q5", "Virus", 99.0), ("q6", "Bacteria", 50.0)], "query_id string, target string, identity double")
    ids = spark.createDataFrame([(f"q{i}",) for i in range(1, 8)], "id string")
    got = {r.id: (r.domain, r.reason, r["keep"]) for r in H.bacterial_verdict(hits, ids, 0.95).collect()}
    assert got["q1"] == ("Bacteria", "Mixed hits: Bacteria + Eukaryota", True)
    assert got["q2"] == ("Bacteria", "Bacterial hits only", True)
    assert got["q5"] == ("Unknown", "Rejected: No recognizable domain", False)
    assert got["q6"] == got["q7"] == ("No hits", "No VSEARCH hit above 95.0% identity threshold", False)
    top = spark.createDataFrame([
        ("q1", 1, 99.0, "16S rRNA"), ("q1", 6, 99.0, "18S"), ("q2", 1, 99.0, "16S rRNA"), ("q2", 3, 99.0, "23S " + "x" * 120),
        ("q3", 1, 10.0, "16S rRNA")], "query_id string, hit_rank int, identity double, description string")
    got = {r.id: (r["keep"], r.reason) for r in H.top_hits_verdict(top, ids, 95).collect()}
    assert got["q1"] == (True, None)
    assert got["q2"] == (False, "Hit 3 is not 16S: 23S " + "x" * 96 + "...")
    assert got["q3"] == (False, "No hits above identity threshold 95") and got["q4"] == (False, "No BLAST hits found")


def test_violations(spark):
    ids = spark.createDataFrame([("SRS1",), ("SRS2",), ("X3",)], "sample_id string")
    meta = spark.createDataFrame([("SRS1",), ("SRS2",), ("SRS2",)], "srs string")
    assert rows(V.metadata_violations(ids, meta)) == [("SRS2", 2), ("X3", 0)]
    assert rows(V.bad_sample_ids(ids)) == [("X3",)]
    results = spark.createDataFrame([("m", 1), ("m", 2), ("k", 1), ("base", None)], "Method string, Seed int")
    assert rows(V.missing_runs(results)) == [("k", 2)]


# --- features ----------------------------------------------------------------------

def test_pooling_ignores_nan_and_is_permutation_invariant(spark):
    vec = "taxon_id string, marker_id string, vec array<float>"
    data = [("t1", "m1", [1.0, 2.0]), ("t1", "m2", [3.0, 4.0]), ("t1", "m3", [float("nan"), 0.0]), ("t2", "m4", [5.0, 5.0])]
    profile = spark.createDataFrame([("s", "t1"), ("s", "t2"), ("s", "none")], "sample_id string, taxon_id string")
    for order in (data, data[::-1]):
        got = {r.taxon_id: r.features for r in X.pool_features(spark.createDataFrame(order, vec), profile).collect()}
        assert got == {"t1": [2.0, 3.0, 3.5, 4.0], "t2": [5.0, 5.0, 3.5, 4.0]}
    ablated = X.pool_features(spark.createDataFrame(data, vec), profile, ablate_context=True)
    assert {r.taxon_id: r.features for r in ablated.collect()} == {"t1": [2.0, 3.0, 0.0, 0.0], "t2": [5.0, 5.0, 0.0, 0.0]}


def test_taxon_without_marker_is_masked_or_kept(spark):
    profile = spark.createDataFrame([("s", "SGB1", 0.5), ("s", "SGBFAKETEST", 0.5)], "sample_id string, taxon_id string, rel_abund double")
    vectors = spark.createDataFrame([("SGB1", "m", [1.0])], "taxon_id string, marker_id string, vec array<float>")
    got = lambda keep: {r.taxon_id: (r.taxon_mask, r.target, r.marker_mask) for r in P.attach_vectors(profile, vectors, keep).collect()}
    assert got(False) == {"SGB1": (True, 1.0, True), "SGBFAKETEST": (False, 0.0, False)}
    assert got(True) == {"SGB1": (True, 0.5, True), "SGBFAKETEST": (True, 0.5, False)}


def test_collate_pads_to_the_batch(spark):
    profile = spark.createDataFrame([("a", "t1", 1.0), ("b", "t1", 0.25), ("b", "t2", 0.75)], "sample_id string, taxon_id string, rel_abund double")
    vectors = spark.createDataFrame([("t1", "m1", [1.0, 1.0]), ("t2", "m2", [2.0, 2.0]), ("t2", "m3", [3.0, 3.0])], "taxon_id string, marker_id string, vec array<float>")
    rows_ = P.attach_vectors(profile, vectors).withColumn("marker_ord", F.substring("marker_id", 2, 9).cast("int")).withColumn(
        "taxon_ord", F.substring("taxon_id", 2, 9).cast("int"))
    batches = spark.createDataFrame([("a", 0), ("b", 0)], "sample_id string, batch long")
    got = {r.sample_id: r for r in X.collate(rows_, batches, 2).collect()}
    zero = [0.0, 0.0]
    assert got["a"].features == [[[1.0, 1.0], zero], [zero, zero]]
    assert got["a"].marker_mask == [[True, False], [False, False]] and got["a"].taxon_mask == [True, False] and got["a"].targets == [1.0, 0.0]
    assert got["b"].features == [[[1.0, 1.0], zero], [[2.0, 2.0], [3.0, 3.0]]] and got["b"].targets == [0.25, 0.75]


def _fails_on_batches():
    class FailsOnBatches:
        def embed_batch(self, texts):
            if len(texts) > 1:
                raise MemoryError
            if texts[0] == "bad":
                raise ValueError
            return [[float(len(texts[0]))]]

    return FailsOnBatches


def test_embedder_retries_one_by_one(spark):
    seqs = spark.createDataFrame([("a", "AC"), ("b", "ACG")], "taxon_id string, seq string")
    assert rows(X.embed_sequences(seqs, _fails_on_batches(), batch_size=2)) == [("a", [2.0]), ("b", [3.0])]
    with pytest.raises(Exception, match="cannot embed c"):
        X.embed_sequences(spark.createDataFrame([("c", "bad")], "taxon_id string, seq string"), _fails_on_batches()).collect()


def test_batches_cover_in_order_and_drop_last(spark):
    s = spark.createDataFrame([(f"s{i}", i) for i in range(10)], "sample_id string, ord int")
    whole = {r.sample_id: (r.batch, r.slot) for r in X.assign_batches(s, 4).collect()}
    assert whole == {f"s{i}": (i // 4, i % 4) for i in range(10)}
    assert X.assign_batches(s, 4, drop_last=True).count() == 8
    mixed = X.assign_batches(s, 4, seed=1).collect()
    assert sorted({r.batch for r in mixed}) == [0, 1, 2]
    assert len({(r.batch, int(r.sample_id[1:]) // 4) for r in mixed}) == 3


# --- files ----------------------------------------------------------------------------

def _write(folder, name, text, compress=False):
    data = text.encode()
    if compress:
        data = zstandard.ZstdCompressor().compress(data)
    path = os.path.join(folder, name)
    with open(path, "wb") as f:
        f.write(data)
    return path


def test_read_counts_plain_and_compressed(spark, tmp_path):
    _write(tmp_path, "PRJ1.txt.zst", "asv\tSRS1\tSRS2\tSRS9\nASV1\t3\t12.0\t7\nASV2\t0\t1\t1\n", compress=True)
    _write(tmp_path, "PRJ2.txt", "asv\tERS1\nASV1\t4.9\n")
    wanted = spark.createDataFrame([("PRJ1", "SRS1"), ("PRJ1", "SRS2"), ("PRJ2", "ERS1")], "project string, sample_id string")
    got = S.read_counts(spark, str(tmp_path), wanted)
    assert rows(got) == [("PRJ1", "SRS1", "ASV1", 3), ("PRJ1", "SRS2", "ASV1", 12), ("PRJ1", "SRS2", "ASV2", 1), ("PRJ2", "ERS1", "ASV1", 4)]
    header = S.read_count_headers(spark, str(tmp_path))
    assert ("PRJ1", "SRS9") in rows(header)
    assert rows(V.missing_from_header(spark.createDataFrame([("PRJ2", "SRS1")], "project string, sample_id string"), header)) == [("PRJ2", "SRS1")]


def test_count_line_of_wrong_length_raises(spark, tmp_path):
    _write(tmp_path, "PRJ1.txt", "asv\tSRS1\tSRS2\nASV1\t3\n")
    with pytest.raises(Exception, match="token count differs"):
        S.read_counts(spark, str(tmp_path)).collect()


def test_read_clades_fasta_sequences_hits(spark, tmp_path):
    clades = _write(tmp_path, "c.tsv", "clade_name\tA\tB\nk__B\t9\t9\nk__B|t__SGB1\t0\t5.5\nk__B|t__SGB2_group\t4\t0\n")
    assert rows(S.read_clade_profiles(spark, clades)) == [("A", "SGB2_group", 4.0), ("B", "SGB1", 5.5)]
    fasta = _write(tmp_path, "x.fa", ">id1 some words\r\nAC\r\nGT\n>id2\nTT\n\n>id3\n")
    assert rows(S.read_fasta(spark, fasta)) == [("id1", "id1 some words", "ACGT"), ("id2", "id2", "TT"), ("id3", "id3", "")]
    good = _write(tmp_path, "s.tsv", "#OTU\tseq\nASV1\tACGT\n")
    assert rows(S.read_sequences(spark, good)) == [("ASV1", "ACGT")]
    bad = _write(tmp_path, "b.tsv", "#OTU\tseq\nXSV1\tACGT\n")
    with pytest.raises(Exception, match="bad sequence line"):
        S.read_sequences(spark, bad).collect()
    fields = "q\tBacteria\t97.5\t250\t1\t0\t1\t250\t3\t252\t1e-50\t400.0"
    hits = _write(tmp_path, "h.b6", f"# comment\n\n{fields}\nshort\tline\n")
    got = S.read_hits(spark, hits).collect()
    assert len(got) == 1 and got[0].identity == 97.5 and got[0].evalue == 1e-50


def test_marker_index_of_one_json_object(spark, tmp_path):
    path = _write(tmp_path, "index.json", '{"SGB5": ["SGB5__a", "SGB5__b"],\n "7": ["p1:7__g"], "SGB9": []}')
    assert rows(S.read_marker_index(spark, path)) == [("SGB5", "SGB5__a", 0), ("SGB5", "SGB5__b", 1), ("SGB7", "p1:7__g", 0)]


def test_results_carry_method_seed_and_ablation(spark, tmp_path):
    head = "SampleId\tKL_err\tRMSL_err\tSpearmanCorr\tBrayCurtis\tRootJensenShannon\tNumTaxa\n"
    row = "s1\t0.5\t0.1\t\t0.2\t0.3\t7\n"
    for name in ("uniform", "asv_nearest_neighbor_KNN_10", "dnabert-s__epc_pool_kl__3", "ABLATED__dnabert-s__epc_pool_kl__4"):
        _write(tmp_path, f"{name}.tsv", head + row)
    got = rows(S.read_results(spark, str(tmp_path)).select("Method", F.coalesce("Seed", F.lit(-1)), "Ablated", "NumTaxa"))
    assert got == [("asv_nearest_neighbor_KNN_10", -1, False, 7), ("dnabert-s__epc_pool_kl", 3, False, 7),
                   ("dnabert-s__epc_pool_kl", 4, True, 7), ("uniform", -1, False, 7)]


def test_id_list_is_sorted_across_files(spark, tmp_path):
    path = str(tmp_path / "ids")
    S.write_id_list(spark.createDataFrame([(f"ASV{i % 50:03}",) for i in range(120)], "taxon_id string"), path)
    lines = []
    for name in sorted(n for n in os.listdir(path) if n.startswith("part")):
        with open(os.path.join(path, name)) as f:
            lines += f.read().split()
    assert lines == [f"ASV{i:03}" for i in range(50)]


def test_fasta_headers_may_hold_the_record_mark(spark, tmp_path):
    (tmp_path / "a.fa").write_text(">a desc with A>G change\nAC\nGT\n>b\nTT\n")
    got = S.read_fasta(spark, str(tmp_path / "a.fa"))
    assert rows(got) == [("a", "a desc with A>G change", "ACGT"), ("b", "b", "TT")]


def test_metadata_columns_are_found_by_name(spark, tmp_path):
    (tmp_path / "p.csv").write_text("amplicon,project,avg_length,condition,subjects\nv4,P1,250.5,well,people\n")
    got = S.read_project_metadata(spark, str(tmp_path / "p.csv"))
    assert rows(got) == [("P1", "well", "people", "v4", 250.5)]


def test_marker_index_of_lines_indented_objects_and_rubbish(spark, tmp_path):
    path = str(tmp_path / "written")
    markers = [(f"SGB{t}", f"SGB{t}__m{o}", o) for t in range(6) for o in range(3)]
    S.write_marker_index(spark.createDataFrame(markers, "taxon_id string, marker_id string, ord int").repartition(2), path)
    assert rows(S.read_marker_index(spark, path)) == markers
    indented = _write(tmp_path, "indented.json", '{\n  "SGB1": [\n    "a",\n    "b"\n  ],\n  "SGB2": [\n    "c"\n  ]\n}\n')
    assert rows(S.read_marker_index(spark, indented)) == [("SGB1", "a", 0), ("SGB1", "b", 1), ("SGB2", "c", 0)]
    broken = _write(tmp_path, "broken.json", '{"SGB1": ["a"], rest}')
    with pytest.raises(Exception, match="no marker list"):
        S.read_marker_index(spark, broken).collect()


def test_results_go_by_the_header_of_each_file(spark, tmp_path):
    _write(tmp_path, "uniform.tsv", "KL_err\tSampleId\tNumASV\n0.25\ts1\t9\n")
    _write(tmp_path, "dnabert-s__epc_pool_kl__3.tsv", "SampleId\tNumParameters\tKL_err\textra\ns1\t1000\t0.5\tx\n")
    got = rows(S.read_results(spark, str(tmp_path)).select("Method", "SampleId", "KL_err", "NumASV", "NumParameters"))
    assert got == [("dnabert-s__epc_pool_kl", "s1", 0.5, None, 1000), ("uniform", "s1", 0.25, 9, None)]
    _write(tmp_path, "other.tsv", "s1\t1\n")
    with pytest.raises(Exception, match="no header"):
        S.read_results(spark, str(tmp_path)).collect()


def test_marker_index_from_record_names(spark):
    from taxaspark.operators.profile import marker_index
    data = [("SGB2__g", 30), ("SGB10__b", 20), ("SGB2__a", 40), ("EUK1__x", 5), ("SGB2__g", 10), ("SGB10__c__d", 50)]
    got = rows(marker_index(spark.createDataFrame(data, "record string, offset long")))
    assert got == [("SGB10", "SGB10__b", 0), ("SGB10", "SGB10__c__d", 1), ("SGB2", "SGB2__a", 2), ("SGB2", "SGB2__g", 0), ("SGB2", "SGB2__g", 1)]
    with pytest.raises(Exception, match="no taxon in record"):
        marker_index(spark.createDataFrame([("SGBx__g", 1)], "record string, offset long")).collect()


def test_unaligned_sequences_read_every_line(spark, tmp_path):
    import __spark_entry__ as entry
    spark.createDataFrame([(i, f"n{i}", "b", "LARGE") for i in range(1, 5)], "p_partkey long, p_name string, p_brand string, p_type string").write.parquet(
        str(tmp_path / "part.parquet"))
    spark.createDataFrame([(1, 50.0), (2, 1.0), (3, 2.0), (3, 48.0), (None, 49.0)], "l_partkey long, l_quantity double").write.parquet(
        str(tmp_path / "lineitem.parquet"))
    got = entry.queries()["unaligned_sequences"](spark, str(tmp_path))
    assert [r[0] for r in rows(got)] == ["ASV2", "ASV4"]
