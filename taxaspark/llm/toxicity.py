"""Toxicity by multiple-instance learning: sentences are scored, documents are labelled."""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from taxaspark.llm import text as X
from taxaspark.llm.tables import class_shares, held_out, labelled_sample

BUCKETS, GRAMS, MAX_WORDS = 1 << 18, (4, 5), 32
THRESHOLD = 0.3
EVIDENCE = 0.01     # sentences below this add up to no more than their highest, however long a text is
WORD = np.zeros(256, bool)
WORD[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
STOP = np.zeros(256, bool)
STOP[[ord(c) for c in ".!?"]] = True


def instances(pieces):
    """Per word its text and sentence: ``start, end, text index, first word of a sentence``.

    A sentence ends at a stop or a line end, and after ``MAX_WORDS`` words.
    """
    start, end, of = pieces.words()
    if not len(start):
        return start, end, of, np.zeros(0, bool)
    breaks = np.concatenate(([0], np.cumsum(pieces.stops)))
    gap = breaks[start]
    new = np.concatenate(([True], (gap[1:] != gap[:-1]) | (of[1:] != of[:-1])))
    first = np.maximum.accumulate(np.where(new, np.arange(len(start)), 0))
    return start, end, of, new | ((np.arange(len(start)) - first) % MAX_WORDS == 0)


class Sentences(X.Pieces):
    """Texts side by side with the places where a sentence ends."""

    def __init__(self, texts):
        ends = np.frombuffer(b" " + b"  ".join(texts) + b" ", np.uint8)
        self.stops = STOP[ends] | (ends == 0x0A)
        super().__init__(texts, WORD, lower=True)


def features(pieces):
    """Hash buckets by word, flattened: ``bucket, word``, the word itself and the n-grams that start in it."""
    start, end, of, first = instances(pieces)
    own = pieces.hashes(start, end)
    sentence = np.cumsum(first, dtype=np.uint64)
    # A word counts once in its sentence.
    once = np.zeros(len(start), bool)
    once[np.unique(X.mixed(own + sentence * np.uint64(X.PRIME)), return_index=True)[1]] = True
    word = np.flatnonzero(once)
    buckets, owners = [own[word]], [word]
    for n in GRAMS:
        if len(pieces.bytes) < n:
            continue
        h, inside = pieces.grams(n)
        at = np.flatnonzero(inside)
        # An n-gram that starts on the blank before a word belongs to that word.
        owner = np.searchsorted(end, at, side="right")
        owner = np.where(~pieces.is_word[at], np.searchsorted(start, at, side="left"), owner)
        ok = owner < len(start)
        ok[ok] = once[owner[ok]]
        buckets.append(h[at[ok]])
        owners.append(owner[ok])
    return (np.concatenate(buckets) % np.uint64(BUCKETS)).astype(np.int64), np.concatenate(owners), of, first, start, end


def fit(documents, labels, weights, epochs=4, rate=0.5, prior=-8.0, floor=-9.5, seed=11):
    """Weights per bucket and a bias: AdaGrad on the noisy-or of the sentences.

    ``P(doc) = 1 - prod(1 - sigmoid(z_s))``; its log-likelihood has the gradient
    ``p_s`` for a clean document and ``-p_s Q / (1 - Q)`` for a toxic one, with
    ``Q`` the product. Buckets seen in fewer than three documents stay zero.
    Weights are kept at zero or above: harmless words add no evidence, and a long
    harmless sentence doesn't outweigh an offending word in it.
    """
    data, seen = [], np.zeros(BUCKETS, np.int32)
    for text in documents:
        parts = [features(Sentences([piece])) for piece in X.blocks(text)]
        buckets, sentence, base = [], [], 0
        for bucket, owner, _, first, _, _ in parts:
            number = np.cumsum(first) - 1
            buckets.append(bucket)
            sentence.append(base + number[owner] if len(owner) else owner)
            base += int(first.sum())
        b, s = np.concatenate(buckets), np.concatenate(sentence)
        data.append((b.astype(np.int32), s.astype(np.int32), base))
        seen[np.unique(b)] += 1
    common = seen >= 3
    data = [(b[common[b]], s[common[b]], n) for b, s, n in data]
    weight, history = np.zeros(BUCKETS), np.full(BUCKETS, 1e-2)
    bias, bias_history = prior, 1.0
    draw = np.random.default_rng(seed)
    for _ in range(epochs):
        for i in draw.permutation(len(data)):
            bucket, sentence, n = data[i]
            if not n:
                continue
            z = np.bincount(sentence, weight[bucket], n) + bias
            p = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
            if labels[i]:
                q = np.exp(np.log1p(-np.minimum(p, 1 - 1e-9)).sum())
                grad = -weights[i] * p * (q / max(1 - q, 1e-9))
            else:
                grad = weights[i] * p
            each = np.bincount(bucket, grad[sentence], BUCKETS) if len(bucket) > BUCKETS else None
            if each is None:
                ids, back = np.unique(bucket, return_inverse=True)
                g = np.bincount(back, grad[sentence], len(ids))
            else:
                ids = np.flatnonzero(each)
                g = each[ids]
            g = g + 1e-4 * weight[ids]
            history[ids] += g * g
            weight[ids] = np.maximum(weight[ids] - rate * g / np.sqrt(history[ids]), 0)
            total = grad.sum()
            bias_history += total * total
            bias = max(floor, bias - rate * total / np.sqrt(bias_history))
    return weight.astype(np.float32), float(bias)


def train(docs: DataFrame, labels: DataFrame, modulus=4, value=2, max_toxic=1500, max_clean=2500):
    """Fit on a sample of at most ``max_toxic`` and ``max_clean`` labelled documents, none of them held out.

    The sample is weighted back to the shares the classes have among all training
    labels. Without labels of both classes every score is 0.
    """
    picked = labelled_sample(docs, labels, "toxic", modulus, value, {1: max_toxic, 0: max_clean})
    rows = sorted((r["doc_id"], r["label"], r["text"] or "") for r in picked.collect())
    ys = [y for _, y, _ in rows]
    if not (0 in ys and 1 in ys):
        return np.zeros(BUCKETS, np.float32), -np.inf
    share = class_shares(labels, "toxic", modulus, value)
    per_class = {k: share[k] / (ys.count(k) / len(ys)) for k in (0, 1)}
    return fit([t.encode("utf-8", "replace") for _, _, t in rows], ys, [per_class[y] for y in ys])


def sentence_scores(pieces, weight, bias):
    """Per sentence: text index, first byte, end byte, probability."""
    bucket, owner, of, first, start, end = features(pieces)
    if not len(start):
        return (np.zeros(0, np.int64),) * 3 + (np.zeros(0),)
    per_word = np.bincount(owner, weight[bucket], len(start))
    at = np.flatnonzero(first)
    z = np.add.reduceat(per_word, at) + bias
    last = np.concatenate((at[1:], [len(start)])) - 1
    return of[at], start[at], end[last], 1 / (1 + np.exp(-np.clip(z, -60, 60)))


def score(docs: DataFrame, model) -> DataFrame:
    """``doc_id, score``: the noisy-or over the sentences with evidence of every whole text.

    Every sentence has some probability from the bias alone, which would sum up with the
    length of a text. So of the sentences below ``EVIDENCE`` only the highest counts.

    Null, empty and wordless texts have no sentence and score 0. Texts over 1 MiB
    are cut at white space into blocks whose sentences all count. A null doc_id
    stays null; repeated rows each get a row; other columns are ignored.
    """
    weight, bias = model

    def scored(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(document_scores(X.binary_column(batch, "text"), weight, bias))],
                names=["doc_id", "score"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(scored, "doc_id long, score double")


def document_scores(texts, weight, bias):
    missed, weak = np.zeros(len(texts)), np.zeros(len(texts))
    for group in X.groups(texts):
        index = np.array([i for i, _ in group])
        of, _, _, p = sentence_scores(Sentences([piece for _, piece in group]), weight, bias)
        strong = p >= EVIDENCE
        missed += np.bincount(index[of[strong]], np.log1p(-np.minimum(p[strong], 1 - 1e-12)), len(texts))
        np.maximum.at(weak, index[of[~strong]], p[~strong])
    return -np.expm1(missed + np.log1p(-weak))


def offending_sentences(docs: DataFrame, model, threshold: float = THRESHOLD) -> DataFrame:
    """``doc_id, start, length, sentence, score``: the sentences over the threshold, by byte position in the text."""
    weight, bias = model

    def located(batches):
        for batch in batches:
            ids, found = batch.column("doc_id").to_pylist(), []
            for i, text in enumerate(X.binary_column(batch, "text")):
                base = 0
                for piece in X.blocks(text):
                    _, start, end, p = sentence_scores(Sentences([piece]), weight, bias)
                    for k in np.flatnonzero(p >= threshold):
                        a, b = int(start[k]) - 1, int(end[k]) - 1
                        found.append((ids[i], base + a, b - a, piece[a:b].decode("utf-8", "replace"), float(p[k])))
                    base += len(piece)
            columns = list(zip(*found)) if found else [()] * 5
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.float64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)],
                                             names=["doc_id", "start", "length", "sentence", "score"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(located, "doc_id long, start long, length long, sentence string, score double")


def toxicity(docs: DataFrame, labels: DataFrame, modulus=4, value=2) -> DataFrame:
    """``doc_id, held_out, score, predicted`` of every document."""
    scores = score(docs, train(docs, labels, modulus, value))
    return scores.select("doc_id", held_out(modulus, value).alias("held_out"), "score",
                         (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def drop_toxic(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The documents whose score is below the threshold, with all their columns, in one pass over them."""
    weight, bias = train(docs, labels)
    column = F.pandas_udf(lambda texts: _series(texts, weight, bias), "double")
    return docs.where(column(F.col("text")) < threshold)


def _series(texts, weight, bias):
    import pandas as pd

    return pd.Series(document_scores([(t or "").encode("utf-8", "replace") for t in texts], weight, bias))
