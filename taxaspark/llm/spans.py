"""Substring deduplication by sliding spans of sentences."""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from taxaspark.llm import text as X
from taxaspark.llm.tables import materialize


RUN, LEAST_WORDS, LONGEST, CUT = 1, 25, 16, 5
STOP = np.zeros(256, bool)
STOP[[ord(c) for c in ".!?"]] = True


class Powers:
    """Powers of the prime and of its inverse, as many as the longest input so far asked for."""

    def __init__(self):
        self.up, self.down = X.powers(1 << 12)

    def sums(self, values, start, end):
        """Hashes of the ranges ``start`` to ``end`` of ``values``; equal ranges have equal hashes wherever they stand."""
        if len(values) >= len(self.up):
            self.up, self.down = X.powers(2 * len(values))
        prefix = np.zeros(len(values) + 1, np.uint64)
        np.cumsum(values * self.up[:len(values)], out=prefix[1:])
        return X.mixed((prefix[end] - prefix[start]) * self.down[start])


class Layout:
    """The pieces of several texts side by side: ``doc``, ``start``, ``end`` in it, ``stop`` (a sentence ends there),
    ``total`` (words of all texts up to there); and ``words``, the hashes of all lower-cased words."""

    def __init__(self, texts, powers, lower):
        b = np.frombuffer((b"\n".join(texts) + b"\n").translate(lower), np.uint8)
        sizes = np.array([len(t) for t in texts], np.int64)
        origin = np.cumsum(sizes + 1) - sizes - 1
        space = X.SPACE[b]
        edge = np.flatnonzero(np.diff(space, prepend=True))  # the last byte is a line end
        begin, finish = edge[::2], edge[1::2]
        self.words = np.empty(len(begin), np.uint64)
        at = 0
        while at < len(begin):  # by blocks, so that a long text needs no wide arrays of its bytes
            to = max(at + 1, int(np.searchsorted(finish, begin[at] + (1 << 18), "right")))
            low = begin[at]
            self.words[at:to] = powers.sums(b[low:finish[to - 1]].astype(np.uint64) + np.uint64(1), begin[at:to] - low, finish[at:to] - low)
            at = to
        cut = np.flatnonzero((STOP[b] & np.append(space[1:], True)) | (b == 0x0A)) + 1
        # A blank behind a stop belongs to the sentence it ends.
        end = cut + (np.append(b, np.uint8(0))[cut] == 0x20)
        total = np.searchsorted(begin, end)
        before = np.append(0, total[:-1])
        end, total, before = (x[total > before] for x in (end, total, before))
        long = np.repeat(total - before > LONGEST, total - before)
        long[total - 1] = False  # behind its last word a sentence ends anyway
        inner = np.flatnonzero(long & ((self.words >> np.uint64(33)) % np.uint64(CUT) == 0)) + 1
        every = np.concatenate([total, inner])
        order = np.argsort(every)
        self.stop, self.total = (np.arange(len(every)) < len(end))[order], every[order]
        self.doc = np.searchsorted(origin, begin[self.total - 1], "right") - 1
        self.end = np.concatenate([end, begin[inner]])[order] - origin[self.doc]
        last = np.append(self.doc[1:] != self.doc[:-1], True)[:len(self.doc)]
        self.end[last] = sizes[self.doc[last]]
        self.start = np.append(0, self.end[:-1])[:len(self.end)]
        self.start[np.append(True, last[:-1])[:len(self.end)]] = 0
        self.first = np.searchsorted(self.doc, np.arange(len(texts) + 1))  # of each text its first piece


def grouped(texts, size=1 << 18):
    """Runs ``(number of the first, texts)`` of about ``size`` bytes of whole texts."""
    held, total, at = [], 0, 0
    for i, data in enumerate(texts):
        held.append(data)
        total += len(data)
        if total >= size or i == len(texts) - 1:
            yield at, held
            held, total, at = [], 0, i + 1


def sentences(data: bytes):
    """Bounds of the sentences and of the pieces of long ones, as :func:`pieces` finds them."""
    return [(a, b) for a, b, _ in pieces(data)]


def pieces(data: bytes):
    """``(start, end, whether a sentence ends there)`` of the sentences of a text: each ends behind a stop that white space follows, or behind a line end.

    Together the sentences are the whole text; one without a word joins the next.
    A sentence of more than ``LONGEST`` words is cut behind every word whose hash is a
    multiple of ``CUT``, so equal passages are cut alike also without stops, or
    inside longer sentences: at most a few words at either end differ.
    """
    found = Layout([data], Powers(), X.lower_table())
    return list(zip(found.start.tolist(), found.end.tolist(), found.stop.tolist()))


def spans(texts, run: int, least_words: int, powers, lower):
    """Arrays ``text, first, number, high, low`` of the runs from every piece on and up to every end of a sentence.

    A run is the fewest pieces of a text, ``run`` at least, that hold ``least_words``
    words (one long sentence can be a run); where a text has too few before or behind, none. Runs
    slide by one piece, so those up to a cut inside a sentence would add a few words at most. Words are compared
    lower-cased (A-Z), white space between them as one blank, by 96 bits of hashes.
    """
    found = Layout(texts, powers, lower)
    n, total = len(found.total), np.append(0, found.total)
    on = np.maximum(np.arange(n) + run, np.searchsorted(total, total[:-1] + least_words))
    back = np.minimum(np.arange(1, n + 1) - run, np.searchsorted(total, total[1:] - least_words, "right") - 1)
    ahead = np.flatnonzero(on <= found.first[found.doc + 1])
    behind = np.flatnonzero(found.stop & (back >= found.first[found.doc]))
    both = np.unique(np.concatenate([ahead * (n + 1) + on[ahead], back[behind] * (n + 1) + behind + 1]))
    first, end = both // (n + 1), both % (n + 1)
    high = powers.sums(found.words, total[first], total[end])
    low = powers.sums(X.mixed(found.words + np.uint64(1)), total[first], total[end]) >> np.uint64(32)
    text = found.doc[first]
    return text, first - found.first[text], end - first, high.view(np.int64), low.astype(np.uint32).view(np.int32)


def keyed(docs: DataFrame) -> DataFrame:
    """``doc_id, text, key``: null texts empty, and a 32-bit hash of the text, which with ``doc_id`` names the row, also where ids repeat."""
    text = F.coalesce("text", F.lit(""))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.hash(text).alias("key"))


def span_table(docs: DataFrame, run: int = RUN, least_words: int = LEAST_WORDS) -> DataFrame:
    """``doc_id, key, first, n, high, low``: every run of consecutive sentences with the parts of its 96-bit digest."""
    def rows_of(batches):
        powers, lower = Powers(), X.lower_table()
        for batch in batches:
            for at, texts in grouped(X.binary_column(batch, "text")):
                text, first, n, high, low = spans(texts, run, least_words, powers, lower)
                row = pa.array(text + at)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").take(row), batch.column("key").take(row), pa.array(first.astype(np.int32)),
                     pa.array(n.astype(np.int32)), pa.array(high), pa.array(low)], names=["doc_id", "key", "first", "n", "high", "low"])

    return keyed(docs).mapInArrow(rows_of, "doc_id long, key int, first int, n int, high long, low int")


def repeated(docs: DataFrame, run: int = RUN, least_words: int = LEAST_WORDS) -> DataFrame:
    """``doc_id, key, covered``: the sentences of a row covered by a run that stood somewhere before.

    Runs meet by digest over all documents; the first, by doc_id, key and place, is no
    repeat. The first places of runs that occur more than once are a table, so the join
    with them is a stage of its own, which adaptive execution splits where a passage
    stands in very many documents. Runs are computed for both steps: written, they would be larger than the texts.
    """
    table = span_table(docs, run, least_words)
    place = F.struct("doc_id", "key", "first")
    first = materialize(table.groupBy("high", "low").agg(
        F.min(place).alias("place"), F.count(F.lit(1)).alias("times")).where("times > 1").select("high", "low", "place"), "first")
    again = table.join(first, ["high", "low"]).where(~place.eqNullSafe(F.col("place")))
    # A row's own runs are as many as its sentences.
    return again.groupBy("doc_id", "key").agg(F.collect_set(F.struct("first", "n")).alias("covered"))


def deduplicate(docs: DataFrame, run: int = RUN, least_words: int = LEAST_WORDS) -> DataFrame:
    """Per document ``doc_id, n_sentences, n_removed, removed_words, removed, text``: the text without its repeats.

    ``removed`` says whether anything was. A removed sentence goes with the white
    space behind it; the rest stays as it is.

    Null and empty texts have no sentence; a null text comes back empty. Runs within one text repeat
    too. Documents with a null doc_id come first among repeats and lose nothing. Rows that
    repeat an id are told apart by a 32-bit hash of their text; equal rows are one
    place, so both keep what the first place keeps. Long texts are read whole. Other columns are ignored.
    """
    marked = keyed(docs).join(repeated(docs, run, least_words), ["doc_id", "key"], "left")

    def cleaned(batches):
        powers, lower = Powers(), X.lower_table()
        for batch in batches:
            covered = batch.column("covered").to_pylist()
            for at, texts in grouped(X.binary_column(batch, "text")):
                found = Layout(texts, powers, lower)
                size, sentence = np.diff(found.total, prepend=0), np.diff(found.first)
                gone = np.zeros(len(found.total), bool)
                out = []
                for i, data in enumerate(texts):
                    low, high = found.first[i], found.first[i + 1]
                    for c in covered[at + i] or ():
                        gone[low + c["first"]:low + c["first"] + c["n"]] = True
                    if covered[at + i]:
                        stays = low + np.flatnonzero(~gone[low:high])
                        data = b"".join(data[a:b] for a, b in zip(found.start[stays].tolist(), found.end[stays].tolist()))
                    out.append(data.decode("utf-8", "replace"))
                counts = np.append(0, np.cumsum(gone)), np.append(0, np.cumsum(size * gone))
                removed, words = (c[found.first[1:]] - c[found.first[:-1]] for c in counts)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(at, len(texts)), pa.array(sentence), pa.array(removed), pa.array(words),
                     pa.array(removed > 0), pa.array(out, pa.string())],
                    names=["doc_id", "n_sentences", "n_removed", "removed_words", "removed", "text"])

    return marked.mapInArrow(cleaned, "doc_id long, n_sentences long, n_removed long, removed_words long, "
                                      "removed boolean, text string")
