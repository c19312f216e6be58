"""Near-duplicates by MinHash with tensored banding.

A plain banding of L tables computes L times k minhashes. Here two small
collections of ``m`` sub-keys (``a`` minhashes each) are computed, and every pair of
a left and a right sub-key is the key of a table: m² tables for 2·m·a minhashes.
Candidates are confirmed on full shingle sets.
"""

import hashlib
import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from taxaspark.llm import text as X
from taxaspark.llm.tables import materialize, whole_rows
from taxaspark.operators.graph import components

ROWS = 2           # minhashes of a sub-key
MISS = 1e-4        # chance that a pair exactly at the threshold shares no table
SMALL = 8          # buckets up to this size are compared pair by pair
FEW, MANY = 256, 512  # documents on the two sides of a tile
KEYS = 1 << 18     # keys of tables that a task makes and counts, about


def sub_keys(percent: int) -> int:
    """Sub-keys a side, so that a pair at the threshold is missed with a chance of ``MISS`` at most."""
    return math.ceil(math.log(MISS / 2) / math.log(1 - (percent / 100) ** ROWS))


def word_list(data: bytes):
    """Words of a text, A-Z lower-cased: runs without ASCII white space."""
    return data.translate(X.lower_table()).split()


def shingle_set(words, k: int):
    """The set of ``k`` consecutive words; of fewer words the whole sequence; of none nothing."""
    if not words:
        return set()
    return set(zip(*(words[i:] for i in range(k)))) if len(words) >= k else {tuple(words)}


def shingle_hashes(words, k: int):
    """Distinct 64-bit hashes of the shingles."""
    if not words:
        return np.zeros(0, np.uint64)
    own = []
    for piece in X.blocks(b" ".join(words)):
        pieces = X.Pieces([piece])
        start, end, _ = pieces.words()
        own.append(pieces.hashes(start, end))
    own = np.concatenate(own)
    width = min(k, len(own))
    h = np.full(len(own) - width + 1, width, np.uint64)
    for i in range(width):
        h = h * np.uint64(X.PRIME) + own[i:len(own) - width + 1 + i]
    return np.unique(X.mixed(h))


def odd_factors(n: int):
    return np.random.default_rng(405).integers(1, 2**63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def signatures(docs: DataFrame, shingle: int, m: int) -> DataFrame:
    """``doc_id, n, digest, left, right``: set size, digest of the word sequence, sub-keys of both collections."""
    def signed(batches):
        factors = odd_factors(2 * m * ROWS)
        for batch in batches:
            sizes, digests, left, right = [], [], [], []
            for data in X.binary_column(batch, "text"):
                words = word_list(data)
                h = shingle_hashes(words, shingle)
                sizes.append(len(h))
                if not len(h):
                    digests.append(None)
                    left.append([])
                    right.append([])
                    continue
                digests.append(digest_of(words))
                low = np.full(len(factors), np.iinfo(np.uint64).max, np.uint64)
                for i in range(0, len(h), 4096):
                    low = np.minimum(low, (h[None, i:i + 4096] * factors[:, None]).min(axis=1))
                keys = np.zeros(2 * m, np.uint64)
                for r in range(ROWS):
                    keys = X.mixed(keys + low[r::ROWS])
                keys = keys.astype(np.int64)
                left.append(keys[:m])
                right.append(keys[m:])
            lists = pa.list_(pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(digests, pa.binary()),
                 pa.array(left, lists), pa.array(right, lists)], names=["doc_id", "n", "digest", "left", "right"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(signed, "doc_id long, n long, digest binary, left array<long>, right array<long>")


def fits(x, y, percent):
    """Whether two set sizes allow the similarity at all."""
    return F.least(x, y) * 100 >= F.greatest(x, y) * percent


def table_keys(reps: DataFrame, most: int = KEYS) -> DataFrame:
    """``key, id, n, i``: the keys of all tables, a node's next to each other.

    A node has a key for each pair of sub-keys, so a small file of nodes gives a
    hundred times as many rows. Nodes are dealt out first: a task makes about
    ``most`` keys, however few files the nodes lie in.
    """
    total = reps.agg(F.sum(F.size("left").cast("long") * F.size("right"))).first()[0] or 0
    tables = reps.repartition(total // most + 1, "id").select("id", "n", F.posexplode("left").alias("i", "l"), "right").select(
        "id", "n", "i", "l", F.posexplode("right").alias("j", "r"))
    return tables.select(F.xxhash64("i", "j", "l", "r").alias("key"), "id", "n", "i")


def buckets(reps: DataFrame) -> DataFrame:
    """``key, id, n, size, pivot, pivot_n``: members of all tables' buckets of two or more.

    Only keys that repeat go on from the first count. Pivots follow an order that is
    random by left sub-key, so a large group has several and not one per table.
    """
    keys = table_keys(reps)
    sizes = keys.groupBy("key").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
    members = materialize(keys.join(sizes, "key"), "members")
    pivots = members.groupBy("key").agg(F.min(F.struct(F.xxhash64("id", "i").alias("order"), "id", "n")).alias("pivot"))
    return members.join(pivots, "key").select(
        "key", "id", "n", "size", F.col("pivot.id").alias("pivot"), F.col("pivot.n").alias("pivot_n"))


def candidates(members: DataFrame, percent: int) -> DataFrame:
    """Distinct pairs ``x < y`` to confirm: all of a small bucket, each member with the pivot of a larger one."""
    stars = members.where((F.col("size") > SMALL) & (F.col("id") != F.col("pivot")) & fits("n", "pivot_n", percent)).select(
        F.least("id", "pivot").alias("x"), F.greatest("id", "pivot").alias("y"))
    lists = members.where(F.col("size") <= SMALL).groupBy("key").agg(F.collect_list(F.struct("id", "n")).alias("all"))
    pairs = lists.select(F.explode("all").alias("p"), "all").select("p", F.explode("all").alias("q")).where(
        "p.id < q.id").where(fits("p.n", "q.n", percent)).select(F.col("p.id").alias("x"), F.col("q.id").alias("y"))
    return stars.unionByName(pairs).distinct()


def digest_of(words):
    """128-bit digest of a word sequence."""
    return hashlib.blake2b(b" ".join(words), digest_size=16).digest()


def texts_of(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """``wanted`` (with an ``id`` column) with the text of that document; the same join at every size."""
    own = docs.select(F.col("doc_id").cast("long").alias("id"), "text").where("id IS NOT NULL")
    return wanted.hint("merge").join(own, "id")


def node_texts(docs: DataFrame, reps: DataFrame, wanted: DataFrame) -> DataFrame:
    """``doc_id, text``: one text of every wanted node, under the node's number.

    A node is a word sequence and the smallest id that has it; other texts of that id are other nodes.
    """
    nodes = wanted.join(reps.select("node", "digest", "id"), "node")

    def own(batches):
        for batch in batches:
            keep = [digest_of(word_list(t)) == d for t, d in zip(X.binary_column(batch, "text"), batch.column("digest").to_pylist())]
            yield batch.select(["node", "text"]).filter(pa.array(keep, pa.bool_()))

    rows = texts_of(docs, nodes).select("node", "text", "digest").mapInArrow(own, "node long, text string")
    return rows.groupBy(F.col("node").alias("doc_id")).agg(F.min("text").alias("text"))


def confirmed(docs: DataFrame, pairs: DataFrame, shingle: int, percent: int) -> DataFrame:
    """The pairs ``a, b`` whose full shingle sets reach the threshold.

    ``docs`` has one text per node. It goes to the node's pairs, and a pair's two texts meet by the pair.
    """
    sides = pairs.select(F.explode(F.array("x", "y")).alias("id"), "x", "y")
    met = texts_of(docs, sides).groupBy("x", "y").agg(F.collect_list("text").alias("texts"))

    def check(batches):
        for batch in batches:
            keep = []
            for texts in batch.column("texts").to_pylist():
                one, other = (shingle_set(word_list(t.encode("utf-8", "surrogatepass")), shingle) for t in texts)
                both = len(one & other)
                keep.append(100 * both >= percent * (len(one) + len(other) - both))
            yield pa.RecordBatch.from_arrays([batch.column("x"), batch.column("y")], names=["a", "b"]).filter(pa.array(keep))

    return met.mapInArrow(check, "a long, b long")


def rest_links(docs: DataFrame, members: DataFrame, labels: DataFrame, shingle: int, percent: int) -> DataFrame:
    """Links ``a, b`` that the pivots of large buckets did not show.

    Large buckets that share documents make a cluster. Documents of a cluster that
    are not yet in one component with its main document are compared with all
    others of the cluster: in tiles of ``FEW`` times ``MANY`` documents, a task each, whose
    intersections are one small matrix product. A cluster that the pivots united has no tile.
    """
    large = members.where(F.col("size") > SMALL)
    clusters = materialize(components(large.select("id").distinct(), large.select(
        F.col("id").alias("a"), F.col("pivot").alias("b")).where("a <> b").distinct()).join(
        labels.select("id", F.col("component").alias("label")), "id").join(
        large.groupBy("id").agg(F.max("n").alias("n")), "id"), "clusters")
    # The main component of a cluster is the one with most of its documents.
    counts = clusters.groupBy("component", "label").agg(F.count(F.lit(1)).alias("of"))
    main = counts.groupBy("component").agg(
        F.sum("of").alias("all"), F.max(F.struct("of", F.col("label").alias("main"))).alias("top"))
    open_ = clusters.join(main.where(F.col("all") > F.col("top.of")).select(
        "component", F.col("top.main").alias("main"), F.ceil(F.col("all") / MANY).cast("int").alias("many"),
        F.ceil((F.col("all") - F.col("top.of")) / FEW).cast("int").alias("few")), "component")
    spread = F.xxhash64("id")
    left = open_.where("label <> main").select(
        "component", "id", "label", F.pmod(spread, F.col("few")).cast("int").alias("f"),
        F.explode(F.sequence(F.lit(0), F.col("many") - 1)).alias("g"), F.lit(0).alias("side"))
    right = open_.select(
        "component", "id", "label", F.explode(F.sequence(F.lit(0), F.col("few") - 1)).alias("f"),
        F.pmod(spread, F.col("many")).cast("int").alias("g"), F.lit(1).alias("side"))
    tiles = texts_of(docs, left.unionByName(right))

    def compare(tile):
        words = [word_list((t or "").encode("utf-8", "surrogatepass")) for t in tile["text"]]
        hashes = [shingle_hashes(w, shingle) for w in words]
        side = tile["side"].to_numpy()
        ids, label = tile["id"].to_numpy(), tile["label"].to_numpy()
        few, many = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
        found = []
        if len(few) and len(many):
            known = np.intersect1d(np.concatenate([hashes[i] for i in few]), np.concatenate([hashes[i] for i in many]))

            def incidence(rows):
                table = np.zeros((len(rows), len(known)), np.float32)
                for r, i in enumerate(rows):
                    table[r, np.intersect1d(known, hashes[i], assume_unique=True, return_indices=True)[1]] = 1
                return table

            own = incidence(few)
            both = np.concatenate([own @ incidence(many[i:i + 64]).T for i in range(0, len(many), 64)], axis=1)
            sizes = np.array([len(h) for h in hashes])
            total = sizes[few][:, None] + sizes[many][None, :] - both
            hit = (100 * both >= percent * total) & (label[few][:, None] != label[many][None, :])
            seen = set()
            for i, j in zip(*np.nonzero(hit)):
                x, y = few[i], many[j]
                if (x, label[y]) in seen:
                    continue  # one link joins the two components
                own, other = shingle_set(words[x], shingle), shingle_set(words[y], shingle)
                shared = len(own & other)
                if 100 * shared >= percent * (len(own) + len(other) - shared):
                    seen.add((x, label[y]))
                    found.append((ids[x], ids[y]))
        return pd.DataFrame(found, columns=["a", "b"], dtype="int64")

    return tiles.groupBy("component", "f", "g").applyInPandas(compare, "a long, b long")


def by_id(links: DataFrame, reps: DataFrame) -> DataFrame:
    """Links of nodes as links ``a, b`` of the ids that stand for them."""
    ids = reps.select("node", "id")
    return links.join(ids.select(F.col("node").alias("a"), F.col("id").alias("x")), "a").join(
        ids.select(F.col("node").alias("b"), F.col("id").alias("y")), "b").select(F.col("x").alias("a"), F.col("y").alias("b"))


def near_duplicates(docs: DataFrame, shingle: int = 5, percent: int = 80) -> DataFrame:
    """Per document ``doc_id, n_shingles, component_id, kept``.

    Two documents are linked if ``100 * |both| >= percent * |either|`` over their
    sets of ``shingle`` consecutive words; ``component_id`` is the smallest id
    reachable over links, ``kept`` its own document. Documents with equal word
    sequences (by a 128-bit digest) are one node throughout.

    Null, empty and wordless texts have no shingles and no links. A document
    without an id has no component and stays. Rows that repeat an id share its
    component. Other columns are ignored; no rows give no rows.
    """
    signed = materialize(signatures(docs, shingle, sub_keys(percent)), "signed")
    # A node is a distinct word sequence; an id that repeats with other words has several.
    reps = materialize(
        signed.where("digest IS NOT NULL AND doc_id IS NOT NULL").groupBy("digest").agg(
            F.min(F.struct("doc_id", "n", "left", "right")).alias("r")).select(
            "digest", F.col("r.doc_id").alias("id"), "r.n", "r.left", "r.right").sortWithinPartitions("digest").withColumn(
            "node", F.monotonically_increasing_id()), "reps")
    members = materialize(buckets(reps.select(F.col("node").alias("id"), "n", "left", "right")), "buckets")
    # Texts of nodes that share any bucket: what all later comparisons read.
    held = materialize(node_texts(docs, reps, members.select(F.col("id").alias("node")).distinct()), "texts")
    nodes = reps.select("id").distinct()
    links = materialize(by_id(confirmed(held, candidates(members, percent), shingle, percent), reps), "links")
    if not members.where(F.col("size") > SMALL).isEmpty():
        labels = materialize(components(nodes, links), "labels")
        of_nodes = reps.select("node", "id").join(labels, "id").select(F.col("node").alias("id"), "component")
        more = materialize(by_id(rest_links(held, members, of_nodes, shingle, percent), reps), "links")
        if not more.isEmpty():
            links = links.unionByName(more)
            labels = components(nodes, links)
    else:
        labels = components(nodes, links)
    of = reps.select("digest", "id").join(labels, "id").select("digest", "component")
    return signed.select("doc_id", "n", "digest").join(of, "digest", "left").select(
        "doc_id", F.col("n").alias("n_shingles"), F.coalesce(
            F.when(F.col("doc_id").isNotNull(), F.col("component")), F.col("doc_id")).alias("component_id")).select(
        "*", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def drop_near_duplicates(docs: DataFrame, shingle: int = 5, percent: int = 80) -> DataFrame:
    """The documents that stay, one of each component, with all their columns, whatever their names.

    Documents without an id, text or words stay. Rows that repeat an id go or stay together; no rows give no rows.
    """
    gone = near_duplicates(docs, shingle, percent).where("NOT kept").select(F.col("doc_id").alias("gone")).distinct()
    return whole_rows(docs).join(gone, F.col("row.doc_id") == F.col("gone"), "left_anti").select("row.*")
