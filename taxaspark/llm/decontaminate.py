"""Benchmark decontamination by latent semantic retrieval.

Passages of all documents and of the benchmark are TF-IDF rows over hashed terms.
A distributed randomised SVD of them gives the latent space; passages near a
benchmark passage by cosine are candidates, and so is every place where a run of
words of an item stands; word-level checks confirm them.
"""

import itertools
import math
import re

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from taxaspark.llm import text as X

TERMS, RANK = 8192, 64  # terms: a power of two
GROUP = 1 << 15         # bytes of text side by side; keeps the rows of a group in cache
WINDOW, HALF = 32, 16
COSINE = 0.5        # candidates are at least this near, times the root of a passage's share of a window
OVERLAP = 0.4       # share of a benchmark passage's words that a candidate window must hold
RUN = 13            # so many words in a row are a copy
VERBATIM = 0.7      # share of an item in order that is a copy whatever is between
PARAPHRASE, ANSWER = 0.55, 0.8  # a smaller share is one if the answer is there as well
BLOCK_WORDS = 200_000  # benchmark words held by a task at a time
LOT = 1 << 16       # words whose sums by term are taken at once
STRIPE = 256        # terms of one partial result
PAIRS = 1 << 21     # windows times benchmark passages compared at a time

WORD = np.zeros(256, bool)
WORD[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
NOT_WORD = bytes(c if WORD[c] else 0x20 for c in range(256))
PLAIN = X.lower_table().translate(NOT_WORD)
SPELLED = re.compile(rb"[0-9A-Za-z\x80-\xff]+")


def word_list(data: bytes):
    return data.translate(PLAIN).split()


def hashed(group):
    """Hash, text index and number within its text of every word of side-by-side texts."""
    pieces = X.Pieces([p for _, p in group], WORD, lower=True)
    start, end, of = pieces.words()
    first = np.searchsorted(of, np.arange(pieces.n))
    return pieces.hashes(start, end), of, np.arange(len(of)) - first[of] if len(of) else of


def bucketed(h):
    return ((h >> np.uint64(20)) & np.uint64(TERMS - 1)).astype(np.int64)


def terms(group):
    """Hashed term, text index and number within its text of every word of side-by-side texts."""
    h, of, at = hashed(group)
    return bucketed(h), of, at


def runs(h, of, n):
    """Hashes of ``n`` consecutive words of one text, and the first word of each."""
    count = max(len(h) - n + 1, 0)
    own = np.zeros(count, np.uint64)
    for j in range(n):
        own = own * np.uint64(X.PRIME) + h[j:j + count]
    first = np.flatnonzero(of[:count] == of[n - 1:n - 1 + count])
    return X.mixed(own[first]), first


def overlapping(data, reach):
    """Blocks of a text, each with the ``reach`` words behind it."""
    start = 0
    for block in X.blocks(data):
        start += len(block)
        end = start
        for m in itertools.islice(SPELLED.finditer(data, start), reach):
            end = m.end()
        yield block + data[start:end]


def passages(group):
    """Words of passages of ``WINDOW`` words, side by side: term and passage of each word, and where passages begin."""
    bucket, of, at = terms(group)
    if not len(bucket):
        return bucket, bucket, bucket
    part = at // WINDOW
    new = np.concatenate(([True], (of[1:] != of[:-1]) | (part[1:] != part[:-1])))
    return bucket, np.cumsum(new) - 1, np.flatnonzero(new)


def gram(parts, idf, weighted):
    """``Aᵀ(A omega)`` without the last factor idf, as the terms held and their sums, over passages of several groups.

    ``weighted`` is ``idf * omega``. A row is a passage's summed term weights over
    the root of the sum of their squares, word by word. Sums by passage are taken group by group,
    those by term over all of them, where a term stands more often.
    """
    seen, before, buckets, rows = [], 0, [], []
    for bucket, passage, begin in parts:
        square = np.add.reduceat((idf * idf)[bucket], begin)
        seen.append(np.add.reduceat(weighted[bucket], begin, axis=0) / square[:, None].astype(np.float32))
        buckets.append(bucket.astype(np.uint16))
        rows.append(passage + before)
        before += len(begin)
    bucket, seen = np.concatenate(buckets), np.concatenate(seen)
    order = np.argsort(bucket, kind="stable")
    by, row = bucket[order], np.concatenate(rows)[order]
    edge = np.append(np.flatnonzero(np.concatenate(([True], by[1:] != by[:-1]))), len(by))
    sums = np.empty((len(edge) - 1, weighted.shape[1]), np.float32)
    for at in range(0, len(sums), STRIPE):  # few terms at a time, so that their rows stay in cache
        cut = edge[at:at + STRIPE + 1]
        sums[at:at + STRIPE] = np.add.reduceat(seen[row[cut[0]:cut[-1]]], cut[:-1] - cut[0], axis=0)
    return by[edge[:-1]], sums


def term_counts(docs: DataFrame):
    """Passages that hold each term, over all documents; the last entry counts all passages."""
    def counted(batches):
        df = np.zeros(TERMS + 1, np.int64)
        for batch in batches:
            for group in X.groups(X.binary_column(batch, "text"), GROUP):
                bucket, passage, begin = passages(group)
                held = np.sort(passage * TERMS + bucket)
                new = np.flatnonzero(held[1:] != held[:-1]) + 1
                df[:-1] += np.bincount(held[np.concatenate((np.zeros(min(len(held), 1), np.int64), new))] & (TERMS - 1), minlength=TERMS)
                df[-1] += len(begin)
        held = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(held), pa.array(df[held])], names=["term", "n"])

    rows = docs.select("text").mapInArrow(counted, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).collect()
    df = np.zeros(TERMS + 1, np.int64)
    df[[r["term"] for r in rows]] = [r["n"] for r in rows]  # TERMS + 1 rows at most
    return df[:-1], int(df[-1])


def range_products(docs: DataFrame, idf, omega):
    """``AᵀA omega`` over all passages of all documents.

    A task sums over its passages and hands on stripes of terms; a stripe's
    partial sums are added as they stream in, so no task holds more than its
    stripes. The driver receives one ``TERMS`` x ``RANK`` matrix, whatever the corpus.
    """
    stripes = TERMS // STRIPE

    def partial(batches):
        total, weighted = np.zeros(omega.shape), (idf[:, None] * omega).astype(np.float32)
        parts, words = [], 0

        def add():
            held, sums = gram(parts, idf, weighted)
            total[held] += sums

        for batch in batches:
            for group in X.groups(X.binary_column(batch, "text"), GROUP):
                part = passages(group)
                if len(part[0]):
                    parts.append(part)
                    words += len(part[0])
                if words >= LOT:
                    add()
                    parts, words = [], 0
        if parts:
            add()
        yield stripes_of(total * idf[:, None])

    def stripes_of(total):
        parts = total.reshape(stripes, -1)
        held = [i for i in range(stripes) if parts[i].any()]
        return pa.RecordBatch.from_arrays([pa.array(held, pa.int32()), pa.array([parts[i].tobytes() for i in held], pa.binary())],
                                          names=["stripe", "sums"])

    def added(batches):
        totals = {}
        for batch in batches:
            for stripe, sums in zip(batch.column("stripe").to_pylist(), batch.column("sums").to_pylist()):
                part = np.frombuffer(sums)
                totals[stripe] = totals[stripe] + part if stripe in totals else part
        yield pa.RecordBatch.from_arrays([pa.array(list(totals), pa.int32()),
                                          pa.array([t.tobytes() for t in totals.values()], pa.binary())], names=["stripe", "sums"])

    schema = "stripe int, sums binary"
    sums = docs.select("text").mapInArrow(partial, schema).repartition(stripes, "stripe").mapInArrow(added, schema)
    total = np.zeros((stripes, STRIPE * omega.shape[1]))
    for r in sums.collect():
        total[r["stripe"]] += np.frombuffer(r["sums"])
    return total.reshape(omega.shape)


class Benchmark:
    """Items as words, passages and answers; their latent vectors once the space is known."""

    def __init__(self, items):
        self.ids = [i for i, _ in items]
        self.words = [word_list(t) for _, t in items]
        self.answers = [self._answer(t) for _, t in items]
        self.pieces = [(k, w[s:s + WINDOW]) for k, w in enumerate(self.words)
                       for s in range(0, max(1, len(w) - HALF), HALF) if w]

    @staticmethod
    def _answer(text):
        """The words of the last sentence that has any."""
        parts = text.replace(b"?", b".").replace(b"!", b".").replace(b"\n", b".").split(b".")
        return next((w for w in (word_list(p) for p in reversed(parts)) if w), [])

    def rows(self):
        bucket, of, _ = terms([(i, b" ".join(w)) for i, (_, w) in enumerate(self.pieces)])
        key, tf = np.unique(of * TERMS + bucket, return_counts=True)
        return key // TERMS, key % TERMS, tf


def latent_space(docs: DataFrame, bench: Benchmark, seed=17):
    """Term projections, and the unit vectors of the benchmark's passages.

    Single-pass randomised SVD (Nyström form): with ``Y = AᵀA Ω`` of Gaussian Ω, the
    leading right singular vectors of A are the left ones of ``Y chol(ΩᵀY)⁻¹``. A holds
    all corpus passages, and the benchmark's with as much weight in total, so that
    the space spans what is searched for.
    """
    df, many = term_counts(docs)
    passage, term, tf = bench.rows()
    df = df + np.bincount(term, minlength=TERMS)
    idf = np.log((many + len(bench.pieces) + 1) / (df + 1)) + 1e-3
    omega = np.random.default_rng(seed).standard_normal((TERMS, RANK)).astype(np.float32)
    Y = range_products(docs, idf, omega) if many else np.zeros(omega.shape)
    own = passages([(i, b" ".join(w)) for i, (_, w) in enumerate(bench.pieces)])
    held, sums = gram([own], idf, (idf[:, None] * omega).astype(np.float32))
    Y[held] += sums * idf[held, None] * max(many / len(bench.pieces), 1.0)
    Y += 1e-3 * np.linalg.norm(Y) / np.sqrt(TERMS) * omega
    core = omega.T.astype(np.float64) @ Y
    lower = np.linalg.cholesky((core + core.T) / 2 + 1e-9 * np.trace(core) / RANK * np.eye(RANK))
    V = np.linalg.svd(np.linalg.solve(lower, Y.T).T, full_matrices=False)[0]
    project = (idf[:, None] * V).astype(np.float32)
    sums = np.zeros((len(bench.pieces), RANK), np.float32)
    np.add.at(sums, passage, tf[:, None] * project[term])
    return project, unit(sums)


def unit(rows):
    return rows / np.maximum(np.linalg.norm(rows, axis=1, keepdims=True), 1e-9)


def common_subsequence(a, b):
    """Length of the longest common subsequence, one bit per word of ``a`` (Hyyrö 2004)."""
    where = {}
    for i, w in enumerate(a):
        where[w] = where.get(w, 0) | (1 << i)
    full = (1 << len(a)) - 1
    state = full
    for places in filter(None, map(where.get, b)):
        hit = state & places
        state = ((state + hit) | (state - hit)) & full
    return len(a) - bin(state).count("1")


def longest_run(a, b):
    """Length of the longest run of words that both hold."""
    at, best, before = {}, 0, {}
    for j, w in enumerate(b):
        at.setdefault(w, []).append(j)
    for w in a:
        now = {j: before.get(j - 1, 0) + 1 for j in at.get(w, ())}
        best = max(best, max(now.values(), default=0))
        before = now
    return best


def verdict(item, answer, region, may_run=True):
    """``(share in order, longest run, whether the answer is there, contaminated)``.

    Without ``may_run`` no run that makes a copy stands in the region; then a share below
    that of a paraphrase settles it, and run and answer are not looked for.
    """
    share = common_subsequence(item, region) / len(item)
    if not may_run and share < PARAPHRASE:
        return share, 0, False, False
    run = longest_run(item, region)
    has_answer = bool(answer) and common_subsequence(answer, region) >= ANSWER * len(answer)
    copied = run >= min(RUN, len(item)) or share >= VERBATIM or (share >= PARAPHRASE and has_answer)
    return share, run, has_answer, copied


def may_hold(item, region):
    """Whether the region holds enough of the item's words for the share of a paraphrase, in whatever order."""
    held = region if isinstance(region, frozenset) else set(region)
    return sum(map(held.__contains__, item)) >= PARAPHRASE * len(item)


class Searcher:
    def __init__(self, bench, project, vectors):
        self.words, self.answers, self.pieces = bench.words, bench.answers, bench.pieces
        self.project, self.vectors = project, vectors
        self.item = np.array([k for k, _ in bench.pieces])
        self.sizes = np.array([len(w) for _, w in bench.pieces])
        passage, term, _ = bench.rows()
        holds = np.zeros((TERMS, -(-len(bench.pieces) // 8) * 8), np.uint8)
        holds[term, passage] = 1
        # Eight counts are added as one number; none exceeds WINDOW.
        self.holds = holds.view(np.uint64)
        self.enough = np.ceil(OVERLAP * self.sizes).astype(np.uint8)
        # Of a shorter passage more of the window around it is other text.
        self.least = (COSINE * np.sqrt(self.sizes / WINDOW)).astype(np.float32)
        self.own = {}
        for p, k in enumerate(self.item.tolist()):
            self.own.setdefault(k, []).append(p)
        # A region is at most this many words wide, see regions().
        self.reach = 3 * (max(map(len, self.words)) + WINDOW)
        self.copies = self._copies()

    def _copies(self):
        """By length the runs of words that make a copy: a table of their low bits, sorted hashes, the item of each."""
        h, of, _ = hashed([(k, b" ".join(w)) for k, w in enumerate(self.words)])
        size = np.array([len(w) for w in self.words])
        copies = {}
        for n in np.unique(np.minimum(size, RUN)).tolist():
            own, first = runs(h, of, n)
            mine = np.minimum(size, RUN)[of[first]] == n
            own, item = own[mine], of[first][mine]
            order = np.lexsort((item, own))
            marks = np.zeros(1 << min(24, max(16, int(64 * len(own)).bit_length())), bool)
            marks[own & np.uint64(len(marks) - 1)] = True
            copies[n] = marks, own[order], item[order]
        return copies

    def copied(self, h, of):
        """``(word, item)`` wherever a run of words that makes a copy stands."""
        for n, (marks, known, item) in self.copies.items():
            own, first = runs(h, of, n)
            likely = marks[own & np.uint64(len(marks) - 1)]
            own, first = own[likely], first[likely]
            low, high = np.searchsorted(known, own), np.searchsorted(known, own, side="right")
            for i in np.flatnonzero(high > low):
                for k in np.unique(item[low[i]:high[i]]).tolist():
                    yield int(first[i]), k

    def candidates(self, rows, bucket, begin, follows):
        """Windows and benchmark passages near each other that share enough words, and their cosines, as arrays."""
        edge = np.append(begin, len(bucket))
        step = max(1, PAIRS // (HALF * len(self.sizes)))
        for a in range(0, len(rows), step):
            b = min(a + step, len(rows))
            last = min(b + 1, len(rows))  # the half behind the last window
            half = np.add.reduceat(self.holds[bucket[edge[a]:edge[last]]], begin[a:last] - begin[a], axis=0)
            overlap = half[:b - a].copy()
            more = np.flatnonzero(follows[a:b])
            overlap[more] += half[more + 1]
            overlap = overlap.view(np.uint8)[:, :len(self.sizes)]
            cosine = rows[a:b] @ self.vectors.T
            window, piece = np.divmod(np.flatnonzero((cosine >= self.least) & (overlap >= self.enough)), len(self.sizes))
            yield a + window, piece, cosine[window, piece]

    def kept(self, rows, bucket, begin, follows, owner, place, copies):
        """``(text, item, {place: cosine})``: the candidate windows by text and item, copies among them."""
        parts = list(self.candidates(rows, bucket, begin, follows))
        window, piece, cosine = (np.concatenate(c) for c in zip(*parts))
        pair = owner[window] * len(self.words) + self.item[piece]
        order = np.lexsort((cosine, place[window], pair))  # of a place the highest cosine comes last and stays
        pair, where, cosine = pair[order], place[window[order]].tolist(), cosine[order].tolist()
        edge = np.append(np.flatnonzero(np.concatenate(([True], pair[1:] != pair[:-1]))), len(pair)).tolist() if len(pair) else [0]
        rest = dict(copies)
        for a, b, both in zip(edge, edge[1:], pair[edge[:-1]].tolist()):
            t, k = divmod(both, len(self.words))
            yield t, k, dict(zip(where[a:b], cosine[a:b])) | rest.pop((t, k), {})
        for (t, k), places in rest.items():
            yield t, k, places

    def search(self, texts):
        """Per text its matches ``{item: (cosine, share, run, answer)}``."""
        found = [{} for _ in texts]
        for group in X.groups(texts, GROUP, lambda data: overlapping(data, self.reach)):
            index = [i for i, _ in group]
            h, of, at = hashed(group)
            if not len(h):
                continue
            bucket = bucketed(h)
            # Sums by half window, then windows of two neighbouring halves of a text.
            part = at // HALF
            begin = np.flatnonzero(np.concatenate(([True], (of[1:] != of[:-1]) | (part[1:] != part[:-1]))))
            halves = np.add.reduceat(self.project[bucket], begin, axis=0)
            owner = of[begin]
            follows = np.concatenate((owner[1:] == owner[:-1], [False]))
            rows = halves.copy()
            rows[follows] += halves[np.flatnonzero(follows) + 1]
            rows = unit(rows)
            place = at[begin]
            copies = {}
            for word, k in self.copied(h, of):
                w = int(np.searchsorted(begin, word, side="right")) - 1
                c = float((self.vectors[self.own[k]] @ rows[w]).max())
                copies.setdefault((int(owner[w]), k), {})[int(place[w])] = c
            words, vocabulary = {}, {}
            for t, k, places in self.kept(rows, bucket, begin, follows, owner, place, copies):
                if t not in words:
                    words[t] = word_list(group[t][1])
                    vocabulary[t] = frozenset(words[t])
                # What a whole text lacks no region of it has.
                if (t, k) not in copies and not may_hold(self.words[k], vocabulary[t]):
                    continue
                for region, cosine in regions(places.items(), len(self.words[k])):
                    if (t, k) not in copies and not may_hold(self.words[k], words[t][region]):
                        continue
                    share, run, has_answer, copied = verdict(self.words[k], self.answers[k], words[t][region], (t, k) in copies)
                    old = found[index[t]].get(k)
                    if copied and (old is None or share > old[1]):
                        found[index[t]][k] = (cosine, share, run, has_answer)
        return found


def regions(places, size):
    """Word ranges around candidate windows, an item's length to either side; ranges that meet are one."""
    merged = []
    for start, cosine in sorted(places):
        a, b = max(0, start - size), start + WINDOW + size
        if merged and a <= merged[-1][1] and b - merged[-1][0] <= 3 * (size + WINDOW):
            merged[-1] = [merged[-1][0], b, max(merged[-1][2], cosine)]
        else:
            merged.append([a, b, cosine])
    return [(slice(a, b), c) for a, b, c in merged]


def searchers(docs: DataFrame, benchmark: DataFrame):
    """Item ids and the parts of a searcher, for blocks of ``BLOCK_WORDS`` benchmark words each.

    One block bounds what is broadcast; a larger benchmark is searched block by block.
    """
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").where("text IS NOT NULL")
    words = items.agg(F.sum(F.size(F.split("text", r"\s+")))).first()[0] or 0
    blocks = max(1, math.ceil(words / BLOCK_WORDS))
    for block in range(blocks):
        part = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == block)
        rows = sorted((r["item_id"] if r["item_id"] is not None else -1, r["text"].encode("utf-8", "replace")) for r in part.collect())
        bench = Benchmark([r for r in rows if word_list(r[1])])
        if bench.pieces:
            yield bench.ids, Searcher(bench, *latent_space(docs, bench))


def matches(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``doc_id, item_id, cosine, share, run, answer``: items that a document holds or paraphrases.

    ``share`` is the item's share that stands in the document in order, ``run`` the
    longest run of its words, ``answer`` whether its last sentence is there.
    Null, empty and wordless texts match nothing, nor do such items; texts over 1 MiB are
    searched in blocks cut at white space. Items of equal text each match.
    """
    schema = "doc_id long, item_id long, cosine double, share double, run long, answer boolean"
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    out = docs.sparkSession.createDataFrame([], schema)
    for ids, searcher in searchers(docs, benchmark):
        out = out.unionByName(rows.mapInArrow(_finder(ids, searcher), schema))
    return out


def _finder(ids, searcher):
    def find(batches):
        for batch in batches:
            out = [(doc_id, ids[k], *m) for doc_id, held in zip(
                batch.column("doc_id").to_pylist(), searcher.search(X.binary_column(batch, "text"))) for k, m in held.items()]
            columns = list(zip(*out)) if out else [()] * 6
            kinds = [pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.int64(), pa.bool_()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)],
                                             names=["doc_id", "item_id", "cosine", "share", "run", "answer"])
    return find


def contamination(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Per document ``doc_id, contaminated, n_items, item_id, share, cosine``; the best item of those that match.

    A null doc_id stays null and is judged with all rows without an id; rows that repeat an id
    share its verdict. Other columns are ignored; no rows give no rows.
    """
    best = F.max(F.struct("share", "cosine", (-F.col("item_id")).alias("item"))).alias("best")
    by = matches(docs, benchmark).groupBy(F.col("doc_id").alias("_id")).agg(
        F.count_distinct("item_id").alias("n_items"), best)
    ids = docs.select(F.col("doc_id").cast("long").alias("doc_id"))
    return ids.join(by, F.col("doc_id").eqNullSafe(F.col("_id")), "left").select(
        "doc_id", F.col("n_items").isNotNull().alias("contaminated"), F.coalesce("n_items", F.lit(0)).alias("n_items"),
        (-F.col("best.item")).alias("item_id"), F.col("best.share").alias("share"), F.col("best.cosine").alias("cosine"))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents without a match, with all their columns, in one pass over them and no join."""
    kept = docs
    for _, searcher in searchers(docs, benchmark):
        kept = kept.where(~_flag(searcher)(F.col("text")))
    return kept


def _flag(searcher):
    def flag(texts):
        return pd.Series([bool(m) for m in searcher.search([(t or "").encode("utf-8", "replace") for t in texts])])
    return F.pandas_udf(flag, "boolean")
