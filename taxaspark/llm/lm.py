"""Language-model scoring by a probabilistic suffix tree over the bytes of a text's words.

A text is its lower-cased words with one blank between them and a line end behind
the last: those are the symbols. The tree keeps a context of up to ``DEPTH``
symbols if it is frequent and its next-symbol distribution diverges from that of
its suffix; distributions are smoothed towards the suffix's. A symbol is predicted
by the longest suffix of the text so far that is a kept context.
"""

import math
from array import array
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from taxaspark.llm import text as X
from taxaspark.llm.tables import held_out, materialize

DEPTH = 5
END = b"\n"
SEGMENT = 256
RARITY = 3e-4


def count_batches(batches, most_grams=1 << 21, most_words=1 << 18):
    """Counts of words (the end among them) and of ``DEPTH + 1`` symbols, summed within a task.

    A task holds about ``most_grams`` and ``most_words`` of them; what does not fit is sent on in parts, to be summed behind the shuffle.
    """
    words, grams, held, size = Counter(), [], 0, 0
    lower = X.lower_table()

    def word_rows(words):
        return pa.RecordBatch.from_arrays(
            [pa.array(words.keys(), pa.binary()), pa.nulls(len(words), pa.int64()), pa.array(words.values(), pa.int64())],
            names=["word", "gram", "n"])

    def gram_rows(codes, n):
        return pa.RecordBatch.from_arrays(
            [pa.nulls(len(codes), pa.binary()), pa.array(codes.astype(np.int64)), pa.array(n)], names=["word", "gram", "n"])

    bodies, piece = [], 1 << 20
    for batch in batches:
        for data in X.binary_column(batch, "text"):
            parts = data.translate(lower).split()
            words.update(parts)
            words[END] += 1
            if len(words) > most_words:
                yield word_rows(words)
                words = Counter()
            body = END * DEPTH + b" ".join(parts) + END
            for at in range(0, len(body) - DEPTH, piece):
                bodies.append(body[at:at + piece + DEPTH])
                size += len(bodies[-1])
                if size < piece:
                    continue
                grams.append(_grams(bodies))
                bodies, size, held = [], 0, held + len(grams[-1][0])
                if held > most_grams:
                    grams = [_summed(grams)]
                    held = len(grams[0][0])
                    if held > most_grams // 2:
                        yield gram_rows(*grams.pop())
                        held = 0
    if bodies:
        grams.append(_grams(bodies))
    yield word_rows(words)
    yield gram_rows(*_summed(grams))


def _grams(bodies):
    """Distinct codes of ``DEPTH + 1`` bytes and their counts; none reaches over the end of a text."""
    data = np.frombuffer(b"".join(bodies), np.uint8).astype(np.uint64)
    count = len(data) - DEPTH
    codes = np.zeros(count, np.uint64)
    for j in range(DEPTH + 1):
        codes = (codes << np.uint64(8)) | data[j:j + count]
    lengths = np.array([len(b) for b in bodies])
    start = np.cumsum(lengths) - lengths
    inside = np.ones(count, bool)
    # A window whose last symbol is one of the next text's leading ends is none of its own.
    for k in range(DEPTH):
        over = start[1:] - DEPTH + k
        inside[over] = False
    codes, n = np.unique(codes[inside], return_counts=True)
    return codes, n


def _summed(parts):
    if not parts:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    codes, n = np.concatenate([c for c, _ in parts]), np.concatenate([n for _, n in parts])
    if not len(codes):
        return codes, n
    order = np.argsort(codes, kind="stable")
    codes, n = codes[order], n[order]
    edge = np.flatnonzero(np.concatenate(([True], codes[1:] != codes[:-1])))
    return codes[edge], np.add.reduceat(n, edge)


def _find(known, wanted):
    """Place of each wanted value in the sorted known ones, and whether it is there."""
    if not len(known):
        return np.zeros(len(wanted), np.int64), np.zeros(len(wanted), bool)
    at = np.minimum(np.searchsorted(known, wanted), len(known) - 1)
    return at, known[at] == wanted


class SuffixTree:
    """Next state and log10 probability of every state and symbol class, as two dense tables."""

    def __init__(self, contexts, smoothing=8.0, divergence=0.005):
        """``contexts``: rows ``(k, code, symbols, counts)`` of frequent contexts, the empty one among them.

        Read once, held as flat arrays and built level by level, so memory is that of the tables.
        """
        codes, sizes, symbols, counts = ([array(t) for _ in range(DEPTH + 1)] for t in "qiBq")
        for k, code, of_next, n in contexts:
            codes[k].append(code)
            sizes[k].append(len(of_next))
            symbols[k].extend(of_next)
            counts[k].extend(n)
        seen = sorted({*symbols[0], 0x20, END[0]})
        self.classes = np.full(256, len(seen), np.int64)  # the last class: all bytes never seen
        self.classes[seen] = np.arange(len(seen))
        width, unseen = len(seen) + 1, 256 - len(seen)
        spread = np.ones(width)
        spread[-1] = max(unseen, 1)
        root = np.bincount(self.classes[np.array(symbols[0], np.int64)], np.array(counts[0], np.float64), width)
        # Per level: sorted codes, smoothed distributions, whether kept.
        live = [np.zeros(1, np.int64)]
        chance = [((root + spread) / (root + spread).sum()).astype(np.float32)[None]]
        kept = [np.ones(1, bool)]
        for k in range(1, DEPTH + 1):
            code, size = np.array(codes[k], np.int64), np.array(sizes[k], np.int64)
            begin = np.cumsum(size) - size
            parent, has = _find(live[k - 1], code & ((1 << 8 * (k - 1)) - 1))
            order = np.argsort(code, kind="stable")
            order = order[has[order]]
            classes, n = self.classes[np.array(symbols[k], np.int64)], np.array(counts[k], np.float64)
            own, far = np.empty((len(order), width), np.float32), np.zeros(len(order), bool)
            for at in range(0, len(order), 8192):
                block = order[at:at + 8192]
                entry = np.repeat(begin[block] - np.cumsum(size[block]) + size[block], size[block]) + np.arange(size[block].sum())
                row = np.bincount(np.repeat(np.arange(len(block)), size[block]) * width + classes[entry], n[entry],
                                  len(block) * width).reshape(len(block), width)
                above = chance[k - 1][parent[block]].astype(np.float64)
                mixed = (row + smoothing * above) / (row.sum(axis=1, keepdims=True) + smoothing)
                own[at:at + 8192] = mixed
                far[at:at + 8192] = (mixed * np.log(mixed / above)).sum(axis=1) >= divergence
            live.append(code[order])
            chance.append(own)
            kept.append(far)
        for k in range(DEPTH, 0, -1):  # with a context its suffixes
            kept[k - 1][_find(live[k - 1], live[k][kept[k]] & ((1 << 8 * (k - 1)) - 1))[0]] = True
        self.kept = int(sum(f.sum() for f in kept))
        # States besides the kept contexts are their beginnings and the suffixes of those, so that a state and a symbol fix the next state.
        states = [np.unique(np.concatenate([live[k][kept[k]] >> 8 * (k - j) for k in range(j, DEPTH + 1)])) for j in range(DEPTH + 1)]
        for k in range(DEPTH, 0, -1):
            states[k - 1] = np.union1d(states[k - 1], states[k] & ((1 << 8 * (k - 1)) - 1))
        first = np.cumsum([0] + [len(c) for c in states])
        levels = [(c, first[k] + np.arange(len(c))) for k, c in enumerate(states)]
        depth, codes = np.repeat(np.arange(DEPTH + 1), [len(c) for c in states]), np.concatenate(states)
        logp = np.empty((len(codes), width), np.float32)
        open_ = np.ones(len(codes), bool)
        for j in range(DEPTH, -1, -1):
            mine = np.flatnonzero(open_ & (depth >= j))
            at, has = _find(live[j], codes[mine] & ((1 << 8 * j) - 1))
            has[has] = kept[j][at[has]]
            logp[mine[has]] = np.log10(chance[j][at[has]] / spread)
            open_[mine[has]] = False
        self.width, self.logp = width, logp.ravel()
        after = np.zeros((len(codes), width), np.int32)
        for cls, symbol in enumerate(seen):
            found = np.zeros(len(codes), bool)
            for k in range(DEPTH, 0, -1):
                able = ~found & (depth + 1 >= k)
                wanted = (codes << 8 | symbol) & ((1 << 8 * k) - 1)
                known, numbers = levels[k]
                if not len(known):
                    continue
                at = np.minimum(np.searchsorted(known, wanted), len(known) - 1)
                hit = able & (known[at] == wanted)
                after[hit, cls] = numbers[at[hit]]
                found |= hit
        self.after = after.ravel()
        self.root = 0

    @classmethod
    def restored(cls, tables):
        """A tree from ``vars()`` of another: plain arrays travel in a broadcast, classes don't."""
        tree = cls.__new__(cls)
        vars(tree).update(tables)
        return tree

    def scores(self, bodies):
        """log10 probability of each body (its symbols with the end), by segments side by side.

        A segment first reads the ``DEPTH`` symbols before it, which fixes its state
        exactly; so a long text is many short walks, not one long one.
        """
        data = self.classes[np.frombuffer(b"".join(END * DEPTH + b for b in bodies), np.uint8)]
        lengths = np.array([len(b) for b in bodies])
        parts = -(-lengths // SEGMENT)
        owner = np.repeat(np.arange(len(bodies)), parts)
        inner = np.arange(len(owner)) - np.repeat(np.cumsum(parts) - parts, parts)
        begin = np.repeat(np.cumsum(lengths + DEPTH) - lengths - DEPTH, parts) + inner * SEGMENT
        size = np.minimum(SEGMENT, lengths[owner] - inner * SEGMENT)
        order = np.argsort(-size, kind="stable")
        begin, size, owner = begin[order], size[order], owner[order]
        state = np.full(len(owner), self.root, np.int64)
        total = np.zeros(len(owner))
        alive = len(owner)
        for t in range(DEPTH + (int(size[0]) if len(size) else 0)):
            while alive and size[alive - 1] + DEPTH <= t:
                alive -= 1
            at = state[:alive] * self.width + data[begin[:alive] + t]
            if t >= DEPTH:
                total[:alive] += self.logp[at]
            state[:alive] = self.after[at]
        return np.bincount(owner, total, len(bodies))


def least_count(total: int, rarity: float) -> int:
    """Times a context has to occur in ``total`` symbols: ``rarity * total ** (2/3)``, at least 2.

    The share asked for falls as the corpus grows, so the tree grows with it, by the cube root in the
    worst case: no more than ``total ** (1/3) / rarity`` contexts of a length can occur so often.
    """
    return max(2, math.ceil(rarity * total ** (2 / 3)))


def contexts(counts: DataFrame, rarity: float):
    """Contexts of 0 to ``DEPTH`` symbols that occur ``least_count`` times or more, with the symbols behind them."""
    grams = counts.where("gram IS NOT NULL").select("gram", "n")
    total = grams.agg(F.sum("n")).first()[0] or 0
    # An id bit for the length keeps contexts of different lengths apart in one long.
    levels = F.explode(F.array(*[
        F.struct(F.lit(k).alias("k"), F.shiftright("gram", 8).bitwiseAND(F.lit((1 << 8 * k) - 1)).alias("code"))
        for k in range(DEPTH + 1)]))
    rows = grams.select(levels.alias("c"), F.col("gram").bitwiseAND(F.lit(255)).cast("int").alias("symbol"), "n")
    summed = rows.groupBy("c.k", "c.code", "symbol").agg(F.sum("n").alias("n"))
    # At most 256 symbols follow a context.
    grouped = summed.groupBy("k", "code").agg(F.sum("n").alias("total"), F.collect_list(F.struct("symbol", "n")).alias("next"))
    found = grouped.where((F.col("total") >= least_count(total, rarity)) | (F.col("k") == 0)).select(
        "k", "code", F.col("next.symbol").alias("symbols"), F.col("next.n").alias("counts")).toArrow()
    for batch in found.to_batches(max_chunksize=4096):
        yield from zip(*(c.to_pylist() for c in batch.columns))


def score(docs: DataFrame, modulus=7, value=2, rarity=RARITY, common=1e-6) -> DataFrame:
    """``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score`` of every document.

    Counts come from all documents that are not held out. Exact counts of words
    with at least a share ``common`` of all tokens (so at most ``1 / common`` words)
    are broadcast; every other word of a document goes to its count by a join.

    Null and empty texts are the end token alone. A null doc_id is not held out.
    Repeated rows are counted and scored each. Without training documents all
    counts are zero and the tree is its uniform root.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", held_out(modulus, value).alias("held_out"))
    partial = rows.where(~F.col("held_out")).select("text").mapInArrow(count_batches, "word binary, gram long, n long")
    counts = materialize(partial.groupBy("word", "gram").agg(F.sum("n").alias("n")), "counts")
    words = counts.where("word IS NOT NULL").select("word", "n")
    n, v = words.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1))).first()
    frequent_words = {bytes(r["word"]): r["n"] for r in words.where(F.col("n") >= common * n).collect()}
    known = spark.sparkContext.broadcast((vars(SuffixTree(contexts(counts, rarity))), frequent_words))
    base = n + v + 1

    def scored(batches):
        tables, common_words = known.value
        tree = SuffixTree.restored(tables)
        lower = X.lower_table()
        for batch in batches:
            texts = X.binary_column(batch, "text")
            tokens, hits, sums, lists, seen = [], [], [], [[], [], [0]], np.zeros(len(texts))
            bodies, waiting, size = [], [], 0
            for i, data in enumerate(texts):
                parts = data.translate(lower).split()
                body = b" ".join(parts) + END
                parts.append(END)
                found, total = 0, 0.0
                for word, times in Counter(parts).items():
                    c = common_words.get(word)
                    if c is None:
                        lists[0].append(word)
                        lists[1].append(times)
                    else:
                        found += times
                        total += times * np.log10((c + 1) / base)
                lists[2].append(len(lists[0]))
                tokens.append(len(parts))
                hits.append(found)
                sums.append(total)
                bodies.append(body)
                waiting.append(i)
                size += len(body)
                if size >= 1 << 19 or i == len(texts) - 1:
                    seen[waiting] = tree.scores(bodies)
                    bodies, waiting, size = [], [], 0
            rare = pa.ListArray.from_arrays(pa.array(lists[2], pa.int32()), pa.StructArray.from_arrays(
                [pa.array(lists[0], pa.binary()), pa.array(lists[1], pa.int64())], names=["word", "times"]))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("held_out"), pa.array(tokens, pa.int64()), pa.array(hits, pa.int64()),
                 pa.array(sums, pa.float64()), pa.array(seen), rare],
                names=["doc_id", "held_out", "n_tokens", "hits", "sums", "score", "rare"])

    found = materialize(rows.mapInArrow(
        scored, "doc_id long, held_out boolean, n_tokens long, hits long, sums double, score double, "
                "rare array<struct<word: binary, times: bigint>>"
    ).withColumn("row", F.monotonically_increasing_id()), "scored")
    rare = found.select("row", F.explode("rare").alias("r")).select("row", "r.word", "r.times")
    joined = rare.join(words.where(F.col("n") < common * n), "word", "left")
    c = F.coalesce("n", F.lit(0))
    rest = joined.groupBy("row").agg(
        F.sum(F.col("times") * F.log10((c + 1) / F.lit(float(base)))).alias("rare_sums"),
        F.sum(F.when(c > 0, F.col("times")).otherwise(0)).alias("rare_hits"))
    return found.drop("rare").join(rest, "row", "left").select(
        "doc_id", "held_out", "n_tokens", (F.col("hits") + F.coalesce("rare_hits", F.lit(0))).alias("n_known"),
        F.lit(int(n)).cast("long").alias("train_tokens"),
        (F.col("sums") + F.coalesce("rare_sums", F.lit(0.0))).alias("base_score"), "score")
