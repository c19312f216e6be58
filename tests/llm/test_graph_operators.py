"""Spelling variants, prefix trie and SimHash against brute force, on small tables with odd rows."""

import collections
import hashlib
import random
import re
import zlib

import numpy as np
import pytest
import xxhash

from taxaspark.llm import conversations, simhash, spelling

ODD = "doc_id long, text string, lang string, word string, n long, fp long, node long, component long, first long"


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls in every column, empty, blank and long texts, repeated rows, an id with two texts, clashing column names."""
    draw = random.Random(11)
    vocabulary = ["letter", "lettre", "lettér", "letters", "better", "setter", "betterment", "Åland", "naïveté", "Éclairs", "éclairs", "x" * 3000]
    texts = [None, "", " \n ", "one two", "a", " ".join(draw.choice(vocabulary) for _ in range(20000)), "\0 odd 　 bytes 日本 text"]
    texts += ["same words in this row " * 3] * 3 + ["Same  words in\nthis row " * 3]
    rows = [(i, t, None, "w", 1, 2, 3, 4, 5) for i, t in enumerate(texts)]
    rows += [(None, "letters better better better better better", *[None] * 7), (None, None, *[None] * 7), rows[7], (8, "another text of eight", *[None] * 7)]
    return spark.createDataFrame(rows, ODD)


# --- spelling ----------------------------------------------------------------------

def brute_variants(rows, least=6, times=5, factor=5, slips=199):
    counts = collections.Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            if doc_id is not None:
                h = zlib.crc32(f"{doc_id}:{run}".encode())
                if h % slips == 0:
                    run = run[:h % len(run)] + run[h % len(run) + 1:]
            counts[run] += 1
    n = {w: k for w, k in counts.items() if len(w) >= least and k >= times}
    letters = {c for w in n for c in w}
    near = {}
    for w in n:
        cut = {w[:i] + w[i + 1:] for i in range(len(w))}
        put = {w[:i] + c + w[i:] for i in range(len(w) + 1) for c in letters}
        swapped = {w[:i] + c + w[i + 1:] for i in range(len(w)) for c in letters}
        near[w] = (cut | put | swapped) & n.keys() - {w}
    form = {}
    for w in n:
        best = min(near[w], key=lambda u: (-n[u], u), default=None)
        form[w] = best if best is not None and n[best] >= factor * n[w] else None

    def root(w):
        return w if form[w] is None else root(form[w])

    return sorted(((w, form[w], root(w), n[w], len(near[w]), n.get(form[w])) for w in n), key=str)


def got_variants(df):
    return sorted(map(tuple, df.select("word", "form", "root", "n", "n_near", "form_n").collect()), key=str)


@pytest.mark.parametrize("states", [4096, 3])
def test_variants_match_brute_force(spark, states):
    draw = random.Random(5)
    stems = ["aaaaaa", "abcabc", "abcabd", "kolibri", "kolibris", "éééééé"]
    rows = []
    for i in range(60):
        words = []
        for _ in range(60):
            w = draw.choice(stems[:2 + draw.randint(0, 4)])
            for _ in range(draw.choice([0, 0, 0, 1, 1, 2, 3])):
                at = draw.randint(0, len(w) - 1)
                c = draw.choice("abé")
                w = draw.choice([w[:at] + w[at + 1:] or "a", w[:at] + c + w[at:], w[:at] + c + w[at + 1:], w + c])
            words.append(draw.choice([w, w.title()]))
        rows.append((i, draw.choice([" ", ", ", "7"]).join(words)))
    want = brute_variants(rows, slips=7)
    got = got_variants(spelling.variants(spark.createDataFrame(rows, "doc_id long, text string"), slips=7, states=states))
    assert got == want and len(want) > 50 and any(w[2] != w[1] is not None for w in want) and any(w[4] > 3 for w in want)


def test_words_are_left_behind_their_middle_and_pairs_found_once(spark):
    draw = random.Random(3)
    words = {"".join(draw.choice("aab") for _ in range(draw.randint(6, 9))) for _ in range(300)} | {"a" * i for i in range(6, 12)}
    vocabulary = spark.createDataFrame([(w, 5) for w in sorted(words)], "word string, n long")
    keys = spelling.both_ways(vocabulary)
    edges = spelling.trie_edges(keys)
    frontier = keys.selectExpr("word", "turn", "0 AS pos", "-1L AS node", "0 AS edits", "0 AS salt")
    for _ in range(3):
        level = spelling.arrivals(frontier, edges).cache()
        assert level.where("edits = 1 AND pos < turn - 1").count() == 0 and level.where("edits = 0").count() > 0
        frontier = level.where("open").select(*frontier.columns)
    got = sorted((r.word, r.near) for r in spelling.neighbours(vocabulary).collect())
    cut = lambda w: {w[:i] + w[i + 1:] for i in range(len(w))}
    near = lambda a, b: a != b and (a in cut(b) or b in cut(a) or len(a) == len(b) and sum(x != y for x, y in zip(a, b)) == 1)
    assert got == sorted((a, b) for a in words for b in words if near(a, b)) and len(got) > 500


def test_variants_ties_go_to_the_smaller_word(spark):
    rows = [(i, "lettar") for i in range(5)] + [(10 + i, "letter lettbr") for i in range(30)]
    got = got_variants(spelling.variants(spark.createDataFrame(rows, "doc_id long, text string"), slips=10**9))
    assert ("lettar", "lettbr", "lettbr", 5, 2, 30) in got


def test_variants_of_odd_rows(odd):
    got = got_variants(spelling.variants(odd))
    assert got == brute_variants([(r.doc_id, r.text) for r in odd.select("doc_id", "text").collect()])
    assert any(len(w[0]) >= 2999 for w in got)
    assert spelling.variants(odd.limit(0)).collect() == []


# --- prefix trie -------------------------------------------------------------------

def brute_trie(rows, group=5, opening=9):
    turns = collections.defaultdict(list)
    for conv_id, turn, role, text in rows:
        if conv_id is not None:
            turns[conv_id].append((turn is not None, turn or 0, role or "", text or ""))
    said = {c: [t[2:] for t in sorted(ts)] for c, ts in turns.items()}
    nodes = collections.defaultdict(list)
    for c, own in said.items():
        h = zlib.crc32(str(c).encode()) % opening
        base = c - (c % group if c >= 0 else -(-c % group))
        path = said.get(base, [])[:h] + own[h:]
        for d in range(len(path) + 1):
            nodes[tuple(path[:d])].append((c, d == len(path)))
    children = collections.Counter(p[:-1] for p in nodes if p)
    leaves, saved = collections.Counter(), collections.Counter()
    for p, members in nodes.items():
        for d in range(len(p) + 1):
            leaves[p[:d]] += children[p] == 0
            saved[p[:d]] += (len(members) - 1) * len(p[-1][1].encode()) if p else 0
    name = {p: min(c for c, _ in members) for p, members in nodes.items()}
    return sorted(((name[p], len(p), name[p[:-1]] if p else None, len(members), children[p], leaves[p], saved[p],
                    hashlib.sha256(",".join(str(c) for c in sorted(c for c, ends in members if ends)).encode()).hexdigest())
                   for p, members in nodes.items()), key=str)


TURNS = "conv_id long, turn long, role string, text string"
NODE = "conv_id depth parent_conv_id n_convs n_children n_leaves saved_tokens ends_sha256".split()


def got_trie(df, **options):
    return sorted(map(tuple, conversations.prefix_trie(df, **options).select(*NODE).collect()), key=str)


def few_turns(draw, convs):
    rows = []
    for c in convs:
        n = 70 if c == 3 else draw.randint(1, 6)
        rows += [(c, t, draw.choice(["user", "bot", None]), draw.choice(["é", "hi", "", None])) for t in range(n)]
    return rows


@pytest.mark.parametrize("options", [{}, dict(siblings=2, rulers=3, last=10, block=16)])
def test_trie_matches_brute_force(spark, options):
    rows = few_turns(random.Random(3), range(0, 80))
    assert got_trie(spark.createDataFrame(rows, TURNS), **options) == brute_trie(rows)


def test_trie_of_odd_rows(spark):
    draw = random.Random(4)
    rows = few_turns(draw, [-7, -5, -1, 0, 1, 2, 4, 11, 12, 13, 14, 10**12, 10**12 + 1])
    rows += [(11, None, "user", "first of all"), (12, 1, "user", "a tie"), (12, 1, "bot", "a tie"), rows[0], rows[0], (None, 1, "user", "nobody"),
             (13, 2, "user", "long text " * 50000), (21, None, None, None)]
    df = spark.createDataFrame([(*r, None, 1) for r in rows], TURNS + ", node long, parent long")
    assert got_trie(df) == brute_trie(rows)
    assert got_trie(df.limit(0)) == [] and got_trie(df.where("conv_id IS NULL")) == []


def test_trie_of_many_copies(spark):
    """One conversation a thousand times: its nodes have all of them, and the digest of their ids is streamed."""
    rows = [(c, t, "user", f"turn {t}") for c in range(1000) for t in range(3)]
    assert got_trie(spark.createDataFrame(rows, TURNS)) == brute_trie(rows)


# --- SimHash -----------------------------------------------------------------------

def brute_fingerprint(text, shingle=3):
    lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", lower)
    shingles = [" ".join(words[i:i + shingle]) for i in range(len(words) - shingle + 1)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << i for i in range(64) if 2 * sum(h >> i & 1 for h in hashes) > len(hashes))


def brute_components(rows, bits):
    """``(id, fingerprint) -> smallest id`` of rows ``(id, fingerprint)``."""
    known = sorted({f for _, f in rows})
    up = {f: f for f in known}

    def top(f):
        while up[f] != f:
            f = up[f]
        return f

    for i, f in enumerate(known):
        for g in known[i + 1:]:
            if bin(f ^ g).count("1") <= bits:
                up[top(f)] = top(g)
    low = {}
    for doc_id, f in rows:
        if doc_id is not None:
            low[top(f)] = min(doc_id, low.get(top(f), doc_id))
    return {(doc_id, f): low.get(top(f)) for doc_id, f in rows}


def test_fingerprint_is_read_in_pieces():
    draw = random.Random(8)
    text = " ".join(draw.choice(["Ab", "cd", "é", "f" * 40, "日本"]) for _ in range(300_000))
    assert len(text.encode()) > 2 << 20
    assert simhash.fingerprint(text.encode()) == brute_fingerprint(text)


def test_simhash_of_odd_rows(odd):
    rows = [(r.doc_id, brute_fingerprint(r.text)) for r in odd.select("doc_id", "text").collect()]
    want = brute_components(rows, 2)
    got = simhash.near_duplicates(odd).select("doc_id", "fingerprint", "component_id").collect()
    assert sorted(((r.doc_id, r.fingerprint) for r in got), key=str) == sorted(((i, f"{f:016x}") for i, f in rows), key=str)
    assert all(r.component_id == want[r.doc_id, int(r.fingerprint, 16)] for r in got)
    assert simhash.near_duplicates(odd.limit(0)).collect() == []


def clustered(draw, skewed):
    """Fingerprints in groups of near ones, chains among them, some bits tied to others."""
    rows = []
    for _ in range(40):
        f = draw.getrandbits(64)
        if skewed:
            f = f & ~0xFFFF | (0xFFFF if draw.random() < .5 else 0)
        for _ in range(draw.choice([1, 1, 2, 5, 60])):
            rows.append(f)
            for _ in range(draw.randint(1, 3)):
                f ^= 1 << draw.randint(0, 63)
    return [(i, f) for i, f in enumerate(rows)]


@pytest.mark.parametrize("bits, choices, small", [(2, (2, 3, 4), 32), (2, (2,), 2), (2, (4,), 8), (3, (3,), 2)])
def test_links_connect_all_pairs_within_the_bits(spark, bits, choices, small):
    from taxaspark.operators.graph import components

    rows = clustered(random.Random(bits + small), skewed=small > 2)
    signed = {f: int(np.uint64(f).astype(np.int64)) for _, f in rows}
    fps = spark.createDataFrame([(f,) for f in set(signed.values())], "fp long")
    found = simhash.links(fps, bits, choices, small)
    pairs = [tuple(r) for r in found.collect()]
    assert all(bin((a ^ b) & (2**64 - 1)).count("1") <= bits for a, b in pairs)
    of = {r.id: r.component for r in components(fps, found).collect()}
    want = brute_components(rows, bits)
    groups = collections.defaultdict(set)
    for i, f in rows:
        groups[want[i, f]].add(of[signed[f]])
    assert all(len(g) == 1 for g in groups.values()) and len(groups) == len(set(of.values()))


def test_thresholds_spend_all_units_at_the_least_cost():
    """The dynamic programme against every allocation, and every allocation finds all neighbours (pigeonhole)."""
    draw = random.Random(2)
    fps = np.array([f for _, f in clustered(draw, True)], np.uint64)
    rows = simhash.bit_rows(fps)
    both = (rows.T.astype(float) @ rows)
    grouping = simhash.correlated_parts(both, len(rows), 3)
    assert sorted(i for g in grouping for i in g) == list(range(64))
    assert any(set(range(16)) <= set(g) for g in grouping)  # the tied bits lie together
    # As if the table were much larger, so that candidates cost more than probes.
    plan = simhash.plans([grouping], simhash.block_tables([grouping])(rows), len(rows), 2)[0]._replace(total=10**7)
    thresholds, cost = simhash.allocate(rows, plan)
    assert ((thresholds + 1).sum(axis=1) == 3).all() and len({tuple(t) for t in thresholds}) > 1

    def price(i, t):
        total = 0
        for group, tables, radius in zip(plan.groups, plan.chances, t):
            if radius < 0:
                continue
            chance = np.ones(1)
            for block, table in zip(simhash.cut_blocks(group), tables):
                chance = np.convolve(chance, table[simhash.block_values(rows[i:i + 1], block)[0]])
            total += chance[:radius + 1].sum() * plan.total + simhash.probes_within(len(group), radius)
        return total

    options = [(a, b, 0 - a - b) for a in range(-1, 3) for b in range(-1, 3) if -1 <= -a - b <= 2]
    for i in range(0, len(rows), 17):
        assert cost[i] == pytest.approx(min(price(i, t) for t in options))
        assert price(i, thresholds[i]) == pytest.approx(cost[i])
