"""The operators over documents on small tables: brute force, round trips, held-out accuracy, odd rows."""

import random
import zlib

import numpy as np
import pyarrow as pa
import pytest

from taxaspark.llm import decontaminate, exact, licenses, lm, near, pack, quality, spans, text as X, token_files, tokens, toxicity

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, label int, key long, id long"
LETTERS = "an er th on in ti re ed st at nd ou ing ha the es".split()


def words(n, draw):
    return ["".join(draw.choice(LETTERS) for _ in range(draw.randint(1, 4))) for _ in range(n)]


def prose(n, draw):
    parts = words(n, draw)
    return ". ".join(" ".join(parts[i:i + 9]) for i in range(0, n, 9)) + "."


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls in every column, empty, blank and long texts, repeated rows, clashing column names."""
    draw = random.Random(1)
    long_text = prose(60000, draw)
    texts = [None, "", " \n\t ", "one", "a  b\n\nc", long_text, "same text here now", "same text here now", "\0 x", "é ñ 日本."]
    rows = [(i, t, None, "s", 1, 0, 7, 9) for i, t in enumerate(texts)]
    rows += [(None, "no id here at all", None, None, None, None, None, None), rows[6]]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def table(spark, rows, schema="doc_id long, text string"):
    return spark.createDataFrame(rows, schema)


@pytest.fixture(scope="module")
def encode():
    import tokenizers

    library = tokenizers.Tokenizer.from_file(tokens.tokenizer_path())
    library.encode_special_tokens = True
    return lambda t: library.encode(t or "", add_special_tokens=False).ids


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


# --- exact -----------------------------------------------------------------------

def test_exact_groups(odd, empty):
    got = {r["doc_id"]: r for r in exact.exact_groups(odd).collect()}
    assert got[7]["kept"] and not got[6]["kept"] and got[6]["keep_id"] == 7 and got[6]["group_size"] == 3
    assert got[0]["keep_id"] == 1 and got[1]["group_size"] == 2
    assert exact.exact_groups(odd).count() == odd.count()
    assert exact.exact_groups(empty).collect() == []


def test_exact_compares_full_texts_when_digests_meet(spark):
    from pyspark.sql import functions as F

    docs = table(spark, [(1, "ab"), (2, "cd"), (3, "ab"), (4, "xyz")])
    got = {r["doc_id"]: (r["keep_id"], r["group_size"]) for r in exact.exact_groups(docs, digest=F.length).collect()}
    assert got == {1: (3, 2), 3: (3, 2), 2: (2, 1), 4: (4, 1)}
    assert sorted(r["doc_id"] for r in exact.drop_copies(docs).collect()) == [2, 3, 4]


def test_drop_copies_leaves_one_row_of_each_text(spark, odd):
    twice = odd.unionByName(odd).unionByName(odd.where("doc_id = 7").selectExpr(*["'z' AS source" if c == "source" else c for c in odd.columns]))
    twice = twice.unionByName(table(spark, [(20, None), (20, "no other"), (None, "nobody"), (None, "nobody")]), allowMissingColumns=True)
    got = exact.drop_copies(twice)
    assert got.columns == twice.columns
    rows = got.collect()
    texts = [r["text"] or "" for r in rows]
    assert len(texts) == len(set(texts)) and set(texts) == {r["text"] or "" for r in twice.collect()}
    assert {r["text"]: (r["doc_id"], r["source"]) for r in rows}["same text here now"] == (7, "s")
    assert {r["text"]: r["doc_id"] for r in rows if r["doc_id"] is None} == {"no id here at all": None, "nobody": None}


CLASHING = "doc_id long, text string, _id long, _digest string, _times long, _salt int, _row string, _gone long, row string, id long, gone long, `a.b` map<string,int>"


def clashing(spark, rows):
    return spark.createDataFrame([(d, t, 1, "x", 2, 3, "r", 4, "row", 5, 6, {"k": n}) for n, (d, t) in enumerate(rows)], CLASHING)


def test_dropping_stages_take_columns_of_any_name_and_type(spark):
    draw = random.Random(21)
    base = words(60, draw)
    near_copy = " ".join(base[:-1] + ["else"])
    docs = clashing(spark, [(1, " ".join(base)), (2, " ".join(base)), (2, " ".join(base)), (3, near_copy), (4, prose(50, draw)), (None, None), (5, "")])
    got = exact.drop_copies(docs)
    assert got.columns == docs.columns
    rows = got.collect()
    assert sorted(r["doc_id"] for r in rows) == [2, 3, 4, 5]
    assert next(r for r in rows if r["doc_id"] == 2)["a.b"] == {"k": 1}
    kept = near.drop_near_duplicates(docs)
    assert kept.columns == docs.columns and sorted(str(r["doc_id"]) for r in kept.collect()) == ["1", "4", "5", "None"]


# --- tokens ----------------------------------------------------------------------

def test_encoder_is_the_library(encode):
    texts = ["a  b", "x \n y", "\n\n", "", "it's 12 3.5,. ok\n", "tab\tx", "<|endoftext|> z", "\0 a", "é ñ.\nÉ, ok.. ,", " lead", "trail ", "a\x1c b"]
    texts += [prose(50, random.Random(i)) for i in range(20)]
    got = dict(tokens.encoded(texts, tokens.tokenizer_path()))
    assert all(np.frombuffer(got[i], "<u4").tolist() == encode(t) for i, t in enumerate(texts))


def test_encoder_remembers_no_more_than_it_may(encode, monkeypatch):
    """Many distinct words: old ones are forgotten, those in use stay, and ids are the library's either way."""
    import tokenizers

    monkeypatch.setitem(tokenizers.__dict__, "_remembered_pieces", {})
    texts = [" ".join(["start", "usual, word.", *(f"x{i}y{j} " + chr(97 + i % 26) * j + "q." for j in range(20)), "2.5\nthe end"]) for i in range(100)]
    encoder, most = tokens.Encoder(tokens.tokenizer_path(), kept=100), 0
    learn, learned = encoder._learn, []
    monkeypatch.setattr(encoder, "_learn", lambda missing: (learned.extend(missing), learn(missing)))
    for text in texts:
        assert np.frombuffer(encoder.encode_many([text])[0], "<u4").tolist() == encode(text)
        most = max(most, len(encoder.pieces) + len(encoder.older))
    assert most <= 2 * (100 + 70) and learned.count("word.") == 1
    got = dict(tokens.encoded(texts, tokens.tokenizer_path(), size=500, kept=50))
    assert all(np.frombuffer(got[i], "<u4").tolist() == encode(t) for i, t in enumerate(texts))


@pytest.mark.parametrize("values", [[0], [5] * 9000, list(range(5000)), [1] * 4000 + [2**32 - 1] * 96, [2**32 - 1, 0, 7]])
def test_blocks_round_trip(values):
    for kind in (token_files.U4, token_files.U8):
        block = np.array(values[:4096], kind)
        data = token_files.encode_block(block)
        got, end = token_files.decode_block(data, 0, kind)
        assert end == len(data) and (got == block).all()


def test_token_files_round_trip(odd, empty, encode):
    got = token_files.round_trip(odd)
    rows = sorted(got.collect(), key=lambda r: r["start"])
    want = [(d["doc_id"], encode(d["text"]) + [2]) for d in odd.collect()]
    assert sorted((r["doc_id"] is not None, r["doc_id"] or 0, r["n_tokens"], r["ids_crc32"]) for r in rows) == sorted(
        (i is not None, i or 0, len(x), crc(x)) for i, x in want)
    at = 0
    for r in rows:
        assert r["start"] == at
        at += r["n_tokens"]
    assert [r["doc_id"] for r in rows][0] is None and [r["doc_id"] for r in rows][1:] == sorted(r["doc_id"] for r in rows[1:])
    assert token_files.round_trip(empty).collect() == []


def test_packing_places_every_id_once(odd, empty, encode):
    rows = pack.pack(odd.where("doc_id IS NOT NULL").dropDuplicates(["doc_id"]), length=64).collect()
    want = {d["doc_id"]: encode(d["text"]) + [0] for d in odd.collect()}
    pieces = {}
    for r in rows:
        pieces.setdefault(r["doc_id"], []).append(r)
        ids = want[r["doc_id"]]
        assert r["ids_crc32"] == crc(ids[r["start"]:r["start"] + r["length"]]) and r["doc_tokens"] == len(ids)
    for i, parts in pieces.items():
        at = 0
        for r in sorted(parts, key=lambda r: r["start"]):
            assert r["start"] == at
            at += r["length"]
        assert at == len(want[i])
    sequences = {}
    for r in sorted(rows, key=lambda r: (r["sequence_id"], r["offset"])):
        assert r["offset"] == sequences.get(r["sequence_id"], 0)
        sequences[r["sequence_id"]] = r["offset"] + r["length"]
    assert all(n == 64 or n & (n - 1) == 0 and n < 64 for n in sequences.values())
    assert set(pieces) == {d["doc_id"] for d in odd.collect() if d["doc_id"] is not None}
    assert pack.pack(empty).collect() == []


def test_packing_takes_few_rows_at_a_time(odd):
    """Batches of any size are cut without loss; few remembered pieces give the same rows."""
    batch = pa.RecordBatch.from_arrays([pa.array(range(2500))], names=["doc_id"])
    parts = list(pack.slices([batch, batch.slice(0, 0), batch.slice(7, 3)]))
    assert [p.num_rows for p in parts] == [1024, 1024, 452, 3]
    assert [i for p in parts for i in p.column("doc_id").to_pylist()] == [*range(2500), 7, 8, 9]
    docs = odd.where("doc_id IS NOT NULL")
    rows = [sorted(map(tuple, pack.pack(docs, length=64, kept_pieces=n).collect())) for n in (1, 750_000)]
    assert rows[0] == rows[1] and rows[0]


def test_packing_ranges_hold_equal_bytes(spark, empty):
    """Long texts beside short ones, and a third of all rows with one text: ranges of about equal bytes, keys in order."""
    draw = random.Random(6)
    texts = [prose(draw.choice([20, 20, 20, 400, 2000]), draw) for _ in range(400)]
    docs = table(spark, list(enumerate(texts + [texts[0] * 5] * 200)))
    rows = pack.keyed(docs)
    cuts, ranges = pack.cut_points(pack.weighed(rows), 12, 1 << 40)
    assert ranges == 12 and len(cuts) == 11
    placed = pack.with_range(rows, cuts).collect()
    held, keys = {}, {}
    for r in placed:
        held[r["range"]] = held.get(r["range"], 0) + len(r["text"].encode()) + 1
        keys.setdefault(r["range"], []).append(r["key"])
    assert len(held) == 12 and max(held.values()) < 2 * sum(held.values()) / 12
    assert all(max(keys[i]) < min(keys[i + 1]) for i in range(11))
    total = sum(held.values())
    assert pack.cut_points(pack.weighed(rows), 4, -(-total // 40))[1] == 40
    assert len(pack.cut_points(pack.weighed(pack.keyed(empty)), 4, 100)[0]) == 0


def test_hilbert_neighbours_are_one_step_apart():
    side = 8
    grid = np.array([(x, y) for x in range(side) for y in range(side)])
    order = grid[np.argsort(pack.hilbert_key(grid, 3))]
    assert (np.abs(np.diff(order, axis=0)).sum(axis=1) == 1).all()


# --- learned scores ---------------------------------------------------------------

@pytest.fixture(scope="module")
def labelled(spark):
    draw = random.Random(5)
    docs, labels = [], []
    for i in range(400):
        good, toxic = i % 4 != 0, i % 5 == 0
        body = prose(60, draw) if good else " ".join(w.upper() + "!!" for w in words(60, draw))
        if toxic:
            body += f" Some {draw.choice(['zibblewort', 'grumquax'])} here."
        docs.append((i, body))
        labels.append((i, int(good), int(toxic)))
    return table(spark, docs), table(spark, labels, "doc_id long, quality int, toxic int")


def held_out_accuracy(scores, labels, column):
    rows = scores.join(labels, "doc_id").where("held_out").collect()
    assert len(rows) > 50
    return sum(r["predicted"] == r[column] for r in rows) / len(rows)


def test_quality_on_held_out_documents(labelled, odd, empty):
    docs, labels = labelled
    assert held_out_accuracy(quality.quality(docs, labels), labels, "quality") > 0.95
    assert quality.quality(odd, labels).count() == odd.count()
    assert quality.quality(empty, labels).collect() == []
    blank = quality.quality(docs, labels.where("false")).first()
    assert blank["score"] == 0.5


def test_toxicity_on_held_out_documents(labelled, odd, empty):
    docs, labels = labelled
    assert held_out_accuracy(toxicity.toxicity(docs, labels), labels, "toxic") > 0.95
    model = toxicity.train(docs, labels)
    found = toxicity.offending_sentences(docs, model).collect()
    # Three hundred documents teach a few accidental n-grams as well; most places must be the planted ones.
    right = [r for r in found if "zibblewort" in r["sentence"] or "grumquax" in r["sentence"]]
    assert len(right) >= 0.9 * len(found) and len({r["doc_id"] for r in right}) >= 0.95 * 80
    kept = {r["doc_id"] for r in toxicity.drop_toxic(docs, labels).collect()}
    assert {i for i in range(400) if i % 5} <= kept and len(kept) < 330
    assert toxicity.score(odd, model).count() == odd.count() and toxicity.score(empty, model).collect() == []


def test_long_clean_text_is_not_toxic_for_its_length(labelled):
    docs, labels = labelled
    weight, bias = toxicity.train(docs, labels)
    clean = [r["text"] for r in docs.join(labels, "doc_id").where("toxic = 0 AND quality = 1").sort("doc_id").collect()]
    long_text = " ".join(clean * 9)
    assert len(long_text.split()) > 100000
    lines = long_text.replace(". ", "\n")
    planted = lines + "\nSome zibblewort and grumquax here."
    a, b, c = toxicity.document_scores([t.encode() for t in (long_text, lines, planted)], weight, bias)
    assert max(a, b) < toxicity.THRESHOLD <= c


# --- licenses ----------------------------------------------------------------------

def test_base_phrases_by_brute_force(spark, odd, empty):
    texts = ["Under the MIT License. mit-license, MIT  license", "CC BY-NC 4.0 and cc:by", "GNU General Public License, version 3",
             "apache\nlicense apache licenses", "nothing", "émit license mitlicense"]
    rows = [r for r in licenses.scan(table(spark, list(enumerate(texts)))).orderBy("doc_id").collect()]
    import re

    for r, t in zip(rows, texts):
        ws = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t))
        places = [(i, label) for phrase, label in licenses.BASE for i in range(len(ws))
                  if ws[i:i + len(phrase.split())] == phrase.split()]
        assert (r["n_words"], r["n_base"]) == (len(ws), len(places))
        assert r["first_word"] == min((i for i, _ in places), default=None)
        assert r["last_word"] == max((i for i, _ in places), default=None)
        assert r["base_labels"] == ",".join(sorted({x for _, x in places}))
        assert set(filter(None, r["base_labels"].split(","))) <= set(filter(None, r["labels"].split(",")))
    assert "gpl-3.0" in rows[2]["labels"]
    assert licenses.scan(odd).count() == odd.count() and licenses.scan(empty).collect() == []


def test_contained_detections_are_suppressed():
    scanner = licenses.Scanner([("inner", 10, 0.5, ("b",), "b"), ("outer", 20, 0.5, ("b",), "abc"), ("other", 30, 0.5, ("c",), "c")])
    assert [d[:3] for d in scanner.detections(b"abc b")] == [(0, 3, "outer"), (2, 3, "other"), (4, 5, "inner")]
    assert len(licenses.rules()) > 200


def test_gated_rules_find_what_all_rules_find():
    names = ["Creative Commons Zero", "Redistribution and use in source and binary forms, with or without modification", "GNU General Public License version 3",
             "Permission is hereby granted, free of charge, to any person obtaining a copy", "Open Database License", "PSF License", "Open RAIL-M License",
             "Open Data Commons Database License", "released into the public domain", "All rights reserved", "Common Public License 1.0",
             "do what the fuck you want to public license", "under the terms of the GNU General Public License as published by the Free Software Foundation"]
    gated, all_ = licenses.Scanner(), licenses.Scanner([(*r[:3], ("",), r[4]) for r in licenses.rules()])
    for name in names:
        for blank in (" ", "\n", "  ", "\r\n\t"):
            text = f"x {name} y".replace(" ", blank).lower().encode()
            assert gated.detections(text) and gated.detections(text) == all_.detections(text), text


# --- language model ------------------------------------------------------------------

def test_language_model_base_and_normalisation(spark, odd, empty):
    import math
    from collections import Counter

    draw = random.Random(3)
    docs = [(i, " ".join(words(30, draw))) for i in range(60)] + [(100, None), (101, "")]
    rows = {r["doc_id"]: r for r in lm.score(table(spark, docs), common=0.01).collect()}
    held = {i: zlib.crc32(str(i).encode()) % 7 == 2 for i, _ in docs}
    split = {i: (t or "").lower().split() + ["<end>"] for i, t in docs}
    count = Counter(w for i in split if not held[i] for w in split[i])
    n, v = sum(count.values()), len(count)
    for i in split:
        want = sum(math.log10((count[w] + 1) / (n + v + 1)) for w in split[i])
        assert abs(rows[i]["base_score"] - want) < 1e-9 and rows[i]["held_out"] == held[i]
        assert rows[i]["n_tokens"] == len(split[i]) and rows[i]["n_known"] == sum(count[w] > 0 for w in split[i])
        assert rows[i]["train_tokens"] == n and rows[i]["score"] < 0
    assert lm.score(odd).count() == odd.count() and lm.score(empty).collect() == []


def test_language_model_score_from_raw_counts(spark):
    """Scores by a plain loop: counts of every context from the texts, smoothing, divergence, longest kept suffix."""
    import math

    draw = random.Random(8)
    docs = [(i, " ".join(words(60, draw)).title()) for i in range(40)] + [(100, None), (101, "zebra ÿ"), (102, "  A \n b ")]
    smoothing, divergence = 8.0, 0.005
    bodies = {i: b" ".join((t or "").encode().lower().split()) + b"\n" for i, t in docs}
    training = [b for i, b in bodies.items() if zlib.crc32(str(i).encode()) % 7 != 2]
    counts = {}
    for body in training:
        padded = b"\n" * 5 + body
        for at in range(5, len(padded)):
            for k in range(6):
                follow = counts.setdefault(padded[at - k:at], {})
                follow[padded[at]] = follow.get(padded[at], 0) + 1
    least = max(2, math.ceil(lm.RARITY * sum(map(len, training)) ** (2 / 3)))
    root = counts[b""]
    unseen = 256 - len(set(root) | {32, 10})
    chance = {b"": {s: (root.get(s, 0) + 1) / (sum(root.values()) + 256) for s in set(root) | {32, 10}}}
    chance[b""][None] = unseen / (sum(root.values()) + 256)  # all bytes never seen together
    kept = {b""}
    for context in sorted((c for c in counts if c), key=len):
        if sum(counts[context].values()) >= least and context[1:] in chance:
            n, above = sum(counts[context].values()), chance[context[1:]]
            chance[context] = {s: (counts[context].get(s, 0) + smoothing * p) / (n + smoothing) for s, p in above.items()}
            if sum(p * math.log(p / above[s]) for s, p in chance[context].items()) >= divergence:
                kept |= {context[j:] for j in range(len(context))}
    assert len({len(c) for c in kept}) > 3
    got = {r["doc_id"]: r["score"] for r in lm.score(table(spark, docs)).collect()}
    for i, body in bodies.items():
        padded, want = b"\n" * 5 + body, 0.0
        for at in range(5, len(padded)):
            best = next(c for c in (padded[at - k:at] for k in range(5, -1, -1)) if c in kept)
            p = chance[best].get(padded[at])
            want += math.log10(chance[best][None] / unseen if p is None else p)
        assert got[i] == pytest.approx(want, abs=1e-2 + 1e-5 * abs(want))


def test_counting_task_holds_bounded_grams_and_words():
    """Random letters, hardly a run of six twice: what is held at a time does not follow the text."""
    import tracemalloc
    from collections import Counter

    import pyarrow as pa

    draw = np.random.default_rng(5)
    texts = [draw.choice(np.frombuffer(b"abcdefghijklmnopqrstuvwxyz0123456789 ", np.uint8), 1 << 20).tobytes().decode() for _ in range(9)]
    texts.append(texts[0])
    tracemalloc.start()
    total, grams = 0, []
    for batch in lm.count_batches(pa.RecordBatch.from_pydict({"text": [t]}) for t in texts):
        total += sum(n for w, n in zip(batch["word"].to_pylist(), batch["n"].to_pylist()) if w is not None) if batch["gram"].null_count else 0
        grams.append(batch.num_rows if not batch["gram"].null_count else 0)
        del batch
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 400e6 and max(grams) <= 5 << 20 and total == sum(len(t.split()) + 1 for t in texts)
    small = [" ".join(words(300, random.Random(i))) for i in range(4)] + [None, ""]
    batches = lambda: iter([pa.RecordBatch.from_pydict({"text": pa.array(small, pa.string())})] * 2)
    sums = Counter()
    for most in (1 << 21, 5):
        part = Counter()
        for batch in lm.count_batches(batches(), most, most):
            for w, g, n in zip(*(c.to_pylist() for c in batch.columns)):
                part[w, g] += n
        sums = sums or part
        assert part == sums


def test_suffix_tree_grows_with_the_corpus():
    sizes = [10 ** e for e in range(4, 15, 2)]
    bounds = [n / lm.least_count(n, lm.RARITY) for n in sizes]
    assert bounds == sorted(bounds) and bounds[-1] > 100 * bounds[1] and lm.least_count(0, lm.RARITY) == 2


def test_suffix_tree_walks_as_the_longest_suffix_says():
    draw = random.Random(9)
    bodies = [" ".join(words(40, draw)).encode() + lm.END for _ in range(30)]
    codes, n = lm._summed([lm._grams([lm.END * lm.DEPTH + b for b in bodies])])
    rows = {}
    for code, times in zip(codes.tolist(), n.tolist()):
        for k in range(lm.DEPTH + 1):
            key = (k, code >> 8 & ((1 << 8 * k) - 1))
            rows.setdefault(key, {}).setdefault(code & 255, 0)
            rows[key][code & 255] += times
    tree = lm.SuffixTree([(k, c, list(s), list(s.values())) for (k, c), s in sorted(rows.items()) if sum(s.values()) > 3])
    table_ = tree.logp.reshape(-1, tree.width)
    seen = np.bincount(tree.classes, minlength=tree.width)
    assert np.allclose((10.0 ** table_ * seen).sum(axis=1), 1, atol=1e-4)
    one = [tree.scores([b])[0] for b in bodies]
    assert np.allclose(one, tree.scores(bodies))
    long_body = b" ".join(b[:-1] for b in bodies) + lm.END
    state, total = tree.root, 0.0
    for t, s in enumerate(lm.END * lm.DEPTH + long_body):
        at = state * tree.width + tree.classes[s]
        total += tree.logp[at] if t >= lm.DEPTH else 0
        state = tree.after[at]
    assert abs(tree.scores([long_body])[0] - total) < 1e-2


# --- near duplicates -----------------------------------------------------------------

def brute_components(docs, k, percent):
    sets = {i: near.shingle_set(near.word_list((t or "").encode()), k) for i, t in docs}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b]:
                both = len(sets[a] & sets[b])
                if 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                    x, y = find(a), find(b)
                    root[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in ids}


def test_near_duplicates_by_brute_force(spark, odd, empty):
    draw = random.Random(2)
    base = [words(120, draw) for _ in range(6)]
    docs = []
    for i in range(110):
        # One large group whose members differ more or less, and several small ones.
        own = list(base[0] if i < 60 else base[i % 6])
        for _ in range(draw.randint(0, 5)):
            own[draw.randrange(len(own))] = "x" + str(draw.random())
        docs.append((i, " ".join(own)))
    docs += [(200, "a b"), (201, "A  b"), (202, ""), (203, None)]
    for k, percent in ((3, 85), (5, 80)):
        got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in near.near_duplicates(
            table(spark, docs), k, percent).collect()}
        assert got == brute_components(docs, k, percent)
    assert near.near_duplicates(odd).count() == odd.count()
    assert near.near_duplicates(empty).collect() == []


def test_near_duplicates_compare_texts_of_repeated_ids(spark):
    draw = random.Random(12)
    one, other = words(200, draw), words(200, draw)
    near_one, far_one = list(one), list(one)
    near_one[100] = "x"
    for i in range(4, 196, 16):
        far_one[i] = f"y{i}"
    # 8 repeats with 3, which is below the threshold; 5 and 6 are alike, but 5 has another text as well.
    near_other = list(other)
    near_other[90] = "z"
    docs = [(3, " ".join(one)), (8, " ".join(far_one)), (3, " ".join(one)), (8, " ".join(far_one)), (3, " ".join(one)),
            (5, " ".join(words(180, draw))), (5, " ".join(other)), (5, " ".join(words(160, draw))), (6, " ".join(near_other)), (4, " ".join(near_one))]
    signed = near.signatures(table(spark, docs), 5, 4)
    reps = signed.groupBy("digest").agg({"doc_id": "min"}).toDF("digest", "id").sort("id", "digest").coalesce(1).selectExpr(
        "monotonically_increasing_id() AS node", "digest", "id").cache()
    held = near.node_texts(table(spark, docs), reps, reps.select("node"))
    assert held.count() == 7
    pairs = held.selectExpr("doc_id AS x").join(held.selectExpr("doc_id AS y")).where("x < y")
    links = near.by_id(near.confirmed(held, pairs, 5, 80), reps).collect()
    assert {tuple(sorted((r["a"], r["b"]))) for r in links} == {(3, 4), (5, 6)}
    got = {(r["doc_id"], r["component_id"]) for r in near.near_duplicates(table(spark, docs), 5, 80).collect()}
    assert {(3, 3), (4, 3), (8, 8), (6, 5)} <= got


def test_tensored_tables_need_few_minhashes():
    m = near.sub_keys(85)
    assert m == 8 and 2 * m * near.ROWS < m * m


def test_tasks_make_a_bounded_number_of_table_keys(spark):
    """Nodes of a single file, as Spark merges small parts: before, one task made and counted all their keys."""
    from pyspark.sql import functions as F

    draw = random.Random(31)
    rows = [(i, 9, [draw.randrange(50) for _ in range(10)], [draw.randrange(50) for _ in range(10)]) for i in range(600)]
    reps = spark.createDataFrame(rows, "id long, n long, left array<long>, right array<long>").coalesce(1)
    keys = near.table_keys(reps, 5000)
    made = keys.groupBy(F.spark_partition_id().alias("task")).count().collect()
    assert sum(r["count"] for r in made) == 60_000 and max(r["count"] for r in made) <= 10_000
    assert near.table_keys(reps).rdd.getNumPartitions() == 1
    # Buckets of two or more, and no others, whatever the deal.
    groups = {}
    for i, _, left, right in rows:
        for a, x in enumerate(left):
            for b, y in enumerate(right):
                groups.setdefault((a, b, x, y), set()).add(i)
    got = {}
    for r in near.buckets(reps).collect():
        got.setdefault(r["key"], (r["size"], set()))[1].add(r["id"])
    assert all(size == len(ids) for size, ids in got.values())
    assert sorted(sorted(ids) for _, ids in got.values()) == sorted(sorted(ids) for ids in groups.values() if len(ids) > 1)


# --- decontamination --------------------------------------------------------------------

def test_decontamination_finds_copies_and_paraphrases(spark, odd, empty):
    draw = random.Random(4)
    items = [(i, prose(40, draw)) for i in range(5)]
    docs = [(i, prose(150, draw)) for i in range(60)]
    docs[3] = (3, docs[3][1] + " " + items[1][1] + " " + prose(50, draw))
    changed = items[2][1].split()
    changed[7] = changed[20] = "other"
    docs[9] = (9, prose(60, draw) + " " + " ".join(changed))
    bench = table(spark, items, "item_id long, text string")
    got = {r["doc_id"]: r for r in decontaminate.contamination(table(spark, docs), bench).collect()}
    assert {i for i, r in got.items() if r["contaminated"]} == {3, 9}
    assert got[3]["item_id"] == 1 and got[9]["item_id"] == 2 and got[3]["share"] == 1.0
    assert sorted(r["doc_id"] for r in decontaminate.drop_contaminated(table(spark, docs), bench).collect()) == [
        i for i in range(60) if i not in (3, 9)]
    assert decontaminate.contamination(odd, bench).count() == odd.count()
    assert decontaminate.contamination(empty, bench).collect() == []
    none = decontaminate.contamination(odd, bench.where("false"))
    assert not any(r["contaminated"] for r in none.collect())


def test_decontamination_finds_every_run_and_short_items_over_a_block_end(spark):
    draw = random.Random(14)
    items = [(i, " ".join(words(50, draw))) for i in range(30)] + [(99, " ".join(words(14, draw)))]
    docs = []
    for i, t in items[:-1]:
        at, own = draw.randrange(38), words(200, draw)
        docs.append((i, " ".join(own[:100] + t.split()[at:at + decontaminate.RUN] + own[100:])))
    filler = " ".join(words(20000, draw)) + " "
    filler *= -(-(1 << 20) // len(filler)) + 1
    short = items[-1][1]
    docs.append((99, filler[:filler.rfind(" ", 0, (1 << 20) - len(short) // 2) + 1] + short + " " + filler[:5000]))
    bench = table(spark, items, "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]) for r in decontaminate.matches(table(spark, docs), bench).collect()}
    assert {(i, i) for i, _ in items} <= got


def test_products_over_several_groups_and_verdicts_without_a_run():
    draw = np.random.default_rng(2)
    idf, omega = draw.random(decontaminate.TERMS) + 0.1, draw.standard_normal((decontaminate.TERMS, 4)).astype(np.float32)
    parts, dense = [], []
    for n in (1, 700, 40):
        begin = np.unique(np.append(draw.integers(0, n, n // 20), 0))
        bucket, passage = draw.integers(0, 300, n) ** 2 % decontaminate.TERMS, np.zeros(n, np.int64)
        passage[begin[1:]] = 1
        parts.append((bucket, np.cumsum(passage), begin))
        for a, b in zip(begin, np.append(begin[1:], n)):
            counts = np.bincount(bucket[a:b], minlength=decontaminate.TERMS)
            dense.append((counts, counts @ (idf[:, None] * omega) / (counts @ idf ** 2)))
    want = sum(np.outer(c, seen) for c, seen in dense)
    held, sums = decontaminate.gram(parts, idf, idf[:, None].astype(np.float32) * omega)
    assert np.allclose(sums, want[held], atol=1e-3, rtol=1e-3) and set(held) == set(np.flatnonzero(sum(c for c, _ in dense)))
    item = [str(i) for i in range(20)]
    for region in (item[:5] + ["x"] + item[9:], item[:9], ["x"] * 5, item):
        full = decontaminate.verdict(item, item[-3:], region)
        short = decontaminate.verdict(item, item[-3:], region, may_run=full[1] >= decontaminate.RUN)
        assert short == full if full[0] >= decontaminate.PARAPHRASE or full[3] else not short[3] and not full[3]


def test_common_subsequence_by_dynamic_programme():
    draw = random.Random(6)
    for _ in range(30):
        a, b = ([draw.choice("abcde") for _ in range(draw.randint(1, 12))] for _ in range(2))
        best = np.zeros((len(a) + 1, len(b) + 1), int)
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                best[i + 1, j + 1] = best[i, j] + 1 if x == y else max(best[i, j + 1], best[i + 1, j])
        assert decontaminate.common_subsequence(a, b) == best[-1, -1]


def test_license_names_start_at_a_word_and_take_quotes_and_short_names():
    scan = licenses.Scanner()
    labels = lambda t: {d[2] for d in scan.scan(t.encode())[2]}
    for t in ("a permit license", "commit license", "the summit licence", "transmit license key", "acc-by 4.0 report", "unelastic license 2.0"):
        assert not labels(t), t
    for _, _, name, _ in licenses.NAMES:
        assert licenses.START in next(r[4] for r in licenses.rules() if name in r[4])
    assert labels("THE SOFTWARE IS PROVIDED “AS IS”, WITHOUT WARRANTY OF ANY KIND") == {"mit"}
    for t, label in (("Licensed under GPLv3.", "gpl-3.0"), ("GPL v2", "gpl-2.0"), ("GNU LGPL license", "lgpl"), ("licensed under the MIT", "mit"),
                     ("“MIT License”", "mit"), ("cc-by 4.0", "cc-by-4.0"), ("licensed under GNU AGPL-3.0-only", "agpl-3.0")):
        assert label in labels(t), (t, labels(t))


# --- spans -------------------------------------------------------------------------------

def test_repeated_passages_leave_all_but_the_first(spark, odd, empty):
    draw = random.Random(8)
    passage = prose(60, draw)
    docs = [(i, prose(50, draw) + " " + passage + " " + prose(50, draw) if i in (2, 5, 7) else prose(80, draw)) for i in range(10)]
    got = {r["doc_id"]: r for r in spans.deduplicate(table(spark, docs)).collect()}
    assert {i for i, r in got.items() if r["removed"]} == {5, 7}
    assert passage in got[2]["text"] and all(got[i]["removed_words"] >= 55 for i in (5, 7))
    assert all(got[i]["text"] == t for i, t in docs if i not in (5, 7))
    assert spans.deduplicate(odd).count() == odd.count() and spans.deduplicate(empty).collect() == []


def test_rows_that_share_an_id_lose_only_their_own_repeats(spark):
    draw = random.Random(18)
    a, b = prose(60, draw), prose(60, draw)
    got = [(r["doc_id"], r["text"]) for r in spans.deduplicate(table(spark, [(0, a), (1, a), (1, b)])).collect()]
    assert sorted(got) == sorted([(0, a), (1, ""), (1, b)])


def test_long_sentences_and_passages_without_stops_are_found(spark):
    draw = random.Random(19)
    sentence = " ".join(words(38, draw)) + "."
    docs = [(i, " ".join([prose(40, draw), sentence, prose(40, draw)])) for i in range(60)]
    got = spans.deduplicate(table(spark, docs)).collect()
    assert all((r["removed_words"] >= 30) == (r["doc_id"] > 0) for r in got)
    passages = [" ".join(words(51, draw)) for _ in range(100)]
    docs = [(2 * i + j, " ".join([*words(80, draw), p, *words(80, draw)])) for i, p in enumerate(passages) for j in (0, 1)]
    got = {r["doc_id"]: r["removed_words"] for r in spans.deduplicate(table(spark, docs)).collect()}
    assert all(got[2 * i] == 0 for i in range(100)) and sum(got[2 * i + 1] >= 25 for i in range(100)) >= 95


def test_spans_by_brute_force(spark, odd):
    """Every run of every text against every earlier one, in plain Python."""
    draw = random.Random(20)
    shared = [prose(draw.randint(20, 90), draw) for _ in range(6)]
    docs = [(draw.randint(0, 30), " ".join(draw.choice([prose(draw.randint(5, 50), draw), draw.choice(shared)]) for _ in range(4)))
            for _ in range(40)]
    docs += docs[:3] + [(None, shared[0]), (3, None), (4, ""), (5, "one")]
    lower, keys = X.lower_table(), {(r["doc_id"], r["text"]): r["key"] for r in spans.keyed(table(spark, docs)).collect()}
    found = {}
    for d, t in {(d, t or "") for d, t in docs}:
        cut = [t.encode()[x:y].translate(lower).split() for x, y in spans.sentences(t.encode())]
        ends = [stop for _, _, stop in spans.pieces(t.encode())]
        for i in range(len(cut)):
            for j in range(i + 1, len(cut) + 1):
                n = lambda x, y: sum(map(len, cut[x:y]))
                # the fewest pieces from i on, or up to the end of a sentence
                if n(i, j) >= 25 and (j == i + 1 or n(i, j - 1) < 25 or (ends[j - 1] and n(i + 1, j) < 25)):
                    found.setdefault(tuple(w for c in cut[i:j] for w in c), []).append((d is not None, d or 0, keys[d, t], i, j, t))
    gone = {}
    for places in found.values():
        for known, d, key, i, j, t in sorted(places)[1:]:
            if known:
                gone.setdefault((d, t), set()).update(range(i, j))
    want = []
    for d, t in docs:
        t = t or ""
        out = gone.get((d, t), set()) if d is not None else set()
        want.append((str(d), "".join(t.encode()[x:y].decode() for i, (x, y) in enumerate(spans.sentences(t.encode())) if i not in out) if out else t))
    got = [(str(r["doc_id"]), r["text"]) for r in spans.deduplicate(table(spark, docs)).collect()]
    assert sorted(got) == sorted(want) and gone


def test_sentences_are_the_whole_text():
    for t in (b"", b"a", b"a. b! c?\nd", b". . x", b"x" * 500 + b" y. ", b" ".join(b"w%d" % i for i in range(400))):
        bounds = spans.sentences(t)
        assert b"".join(t[a:b] for a, b in bounds) == (t if bounds else b"") and (bounds or not t.strip())


def test_blocks_keep_words_whole():
    data = b" ".join(b"w%d" % i for i in range(5000))
    parts = list(X.blocks(data, 1000))
    assert b"".join(parts) == data and all(p[-1:] == b" " for p in parts[:-1])
