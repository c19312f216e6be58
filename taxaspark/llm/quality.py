"""Quality classifier: supervised subword embeddings, averaged per document."""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from taxaspark.llm import text as X
from taxaspark.llm.tables import class_shares, held_out, labelled_sample

BUCKETS, DIMS, GRAMS = 1 << 16, 16, (3, 4, 5)


def word_grams(pieces):
    """Buckets and text index of words and of word pairs; a word that follows itself is one pair of its own kind."""
    start, end, of = pieces.words()
    own = pieces.hashes(start, end)
    pair = X.mixed(own[:-1] * np.uint64(X.PRIME) + own[1:])
    pair[own[:-1] == own[1:]] = np.uint64(1)
    near = of[:-1] == of[1:]
    ids = np.concatenate((own, pair[near])) % np.uint64(BUCKETS)
    return ids.astype(np.int64), np.concatenate((of, of[1:][near]))


def feature_ids(data: bytes):
    """Hash buckets of words, word pairs and byte n-grams of words (with the blank before and after)."""
    ids = []
    for piece in X.blocks(data):
        pieces = X.Pieces([piece])
        ids.append(word_grams(pieces)[0])
        for n in GRAMS:
            if len(pieces.bytes) >= n:
                h, inside = pieces.grams(n)
                ids.append((h[inside] % np.uint64(BUCKETS)).astype(np.int64))
    return np.concatenate(ids)


class Embeddings:
    """``softmax(W mean(E[features]) + b)`` over two classes, and its training by plain SGD."""

    def __init__(self, seed=7):
        draw = np.random.default_rng(seed)
        self.E = draw.uniform(-1 / DIMS, 1 / DIMS, (BUCKETS, DIMS)).astype(np.float32)
        self.W = np.zeros((2, DIMS), np.float32)
        self.b = np.zeros(2, np.float32)

    def fit(self, documents, labels, weights, epochs=8, rate=0.5, seed=7):
        """One step a document, in a new random order each epoch, with a falling rate."""
        counted = []
        for d in documents:
            ids, n = np.unique(d, return_counts=True)
            counted.append((ids.astype(np.int32), n.astype(np.int32)))
        draw, done, total = np.random.default_rng(seed), 0, epochs * max(len(counted), 1)
        for _ in range(epochs):
            for i in draw.permutation(len(counted)):
                ids, n = counted[i]
                step = rate * (1 - done / total) * weights[i]
                done += 1
                share = (n / max(n.sum(), 1)).astype(np.float32)
                mean = share @ self.E[ids]
                error = self.probabilities(mean)
                error[labels[i]] -= 1
                back = error @ self.W
                self.W -= step * np.outer(error, mean)
                self.b -= step * error
                # A mean spreads its gradient thin over thousands of features; scale it back up.
                self.E[ids] -= step * 20 * share[:, None] * back
        return self

    def probabilities(self, mean):
        z = self.W @ mean + self.b
        e = np.exp(z - z.max())
        return e / e.sum()

    def folded(self):
        """The logit of class 1 against 0 as one number per bucket, and a bias: the same scores, without the vectors."""
        w = self.W[1] - self.W[0]
        return (self.E @ w).astype(np.float32), float(self.b[1] - self.b[0])


def train(docs: DataFrame, labels: DataFrame, modulus=3, value=1, max_per_class=2000, epochs=8):
    """Fit on at most ``max_per_class`` labelled documents of either class, none of them held out.

    The sample is the one bounded thing here; its documents are weighted back to
    the shares the classes have among all training labels. Without labels of
    both classes the model says 0.5 for every text.
    """
    share = class_shares(labels, "quality", modulus, value)
    picked = labelled_sample(docs, labels, "quality", modulus, value, {0: max_per_class, 1: max_per_class})
    rows = sorted((r["doc_id"], r["label"], r["text"] or "") for r in picked.collect())
    model = Embeddings()
    ys = [y for _, y, _ in rows]
    if 0 in ys and 1 in ys:
        per_class = {k: share[k] / (ys.count(k) / len(ys)) for k in (0, 1)}
        model.fit((feature_ids(t.encode("utf-8", "replace")) for _, _, t in rows), ys, [per_class[y] for y in ys], epochs)
    return model.folded()


def logits(texts, weight, bias):
    """Class-1 logits of whole texts: the mean of their features' weights, plus the bias."""
    total, count = np.zeros(len(texts)), np.zeros(len(texts))
    for group in X.groups(texts):
        index = np.array([i for i, _ in group])
        pieces = X.Pieces([p for _, p in group])
        ids, of = word_grams(pieces)
        of = index[of]
        total += np.bincount(of, weight[ids], len(texts))
        count += np.bincount(of, minlength=len(texts))
        for n in GRAMS:
            if len(pieces.bytes) < n:
                continue
            h, inside = pieces.grams(n)
            ids = (h % np.uint64(BUCKETS)).astype(np.int64)
            total += np.bincount(index, pieces.sums(weight[ids] * inside), len(texts))
            count += np.bincount(index, pieces.sums(inside), len(texts))
    return total / np.maximum(count, 1) + bias


def score(docs: DataFrame, model) -> DataFrame:
    """``doc_id, score``: the probability of label 1 of every whole text.

    Only the text is read. Null and empty texts have no features and score the
    bias alone; texts over 1 MiB are cut at white space into blocks, all of which
    count; a null doc_id stays null and repeated rows each get a row.
    """
    weight, bias = model

    def scored(batches):
        for batch in batches:
            z = logits(X.binary_column(batch, "text"), weight, bias)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(1 / (1 + np.exp(-z)))],
                                             names=["doc_id", "score"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(scored, "doc_id long, score double")


def quality(docs: DataFrame, labels: DataFrame, modulus=3, value=1) -> DataFrame:
    """``doc_id, held_out, score, predicted`` of every document."""
    scores = score(docs, train(docs, labels, modulus, value))
    return scores.select("doc_id", held_out(modulus, value).alias("held_out"), "score",
                         (F.col("score") >= 0.5).cast("int").alias("predicted"))
