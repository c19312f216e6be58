"""Spelling variants: words one edit apart, found by walking a trie of all words as a relation.

The trie is a table of edges; unary stretches are one edge with a longer label. It holds every word twice,
forwards and backwards, behind a mark: two words one edit apart agree in a half, so a path is left only behind
its middle, where few edges lead on. The frontier is a table of states (word, position, node, edits). Level by
level it is joined with the edges, all words and all nodes at once, and terminal states with one edit are the neighbours.
"""

import hashlib
import re
import zlib
from collections import Counter

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from taxaspark.llm import text as X
from taxaspark.llm.tables import materialize

LETTERS = "[a-zÀ-ÿ]"
AHEAD, BACK = ">", "<"  # marks before a word and before a reversed one
LEAST = 6         # code points of a word
TIMES = 5         # occurrences of a word
FACTOR = 5        # a form is so many times as frequent
SLIPS = 199       # a run loses a code point if this divides its checksum
STATES = 16384    # states of one node that go to one task, about
FLUSH = 1 << 18   # distinct words counted in a task before they are sent on


def word_counts(docs: DataFrame, least: int = LEAST, slips: int = SLIPS) -> DataFrame:
    """``word, n``: all words of at least ``least`` code points and how often they occur.

    A text is read in pieces; counts are combined inside a task before the shuffle.
    """
    def counted(batches):
        # A shorter run is no word, with a slip or without.
        run, lower, total = re.compile(f"{LETTERS}{{{max(least, 1)},}}"), X.lower_table(), Counter()

        def rows():
            return pa.RecordBatch.from_arrays([pa.array(total.keys(), pa.string()), pa.array(total.values(), pa.int64())], names=["word", "n"])

        for batch in batches:
            for doc_id, data in zip(batch.column("doc_id").to_pylist(), X.binary_column(batch, "text")):
                start = None if doc_id is None else zlib.crc32(b"%d:" % doc_id)
                for piece in X.blocks(data):
                    for word, n in Counter(run.findall(piece.translate(lower).decode("utf-8", "replace"))).items():
                        if start is not None:
                            h = zlib.crc32(word.encode(), start)
                            if h % slips == 0:
                                at = h % len(word)
                                word = word[:at] + word[at + 1:]
                                if len(word) < least:
                                    continue
                        total[word] += n
                    if len(total) >= FLUSH:
                        yield rows()
                        total.clear()
        yield rows()

    parts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(counted, "word string, n long")
    return parts.groupBy("word").agg(F.sum("n").alias("n"))


def prefixes(words: DataFrame) -> DataFrame:
    """``word, pos, prefix, out``: a 128-bit digest of every prefix of every word, and the number of the code point behind it (null at the end)."""
    def cut(batches):
        for batch in batches:
            words, places, digests, outs = [], [], [], []
            for word in batch.column("word").to_pylist():
                state = b""
                for pos in range(len(word) + 1):
                    words.append(word)
                    places.append(pos)
                    digests.append(state)
                    out = word[pos] if pos < len(word) else None
                    outs.append(None if out is None else ord(out))
                    if out is not None:
                        state = hashlib.blake2b(state + out.encode(), digest_size=16).digest()
                if len(words) >= 1 << 16:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(words, pa.string()), pa.array(places, pa.int32()), pa.array(digests, pa.binary()), pa.array(outs, pa.int32())],
                        names=["word", "pos", "prefix", "out"])
                    words, places, digests, outs = [], [], [], []
            yield pa.RecordBatch.from_arrays(
                [pa.array(words, pa.string()), pa.array(places, pa.int32()), pa.array(digests, pa.binary()), pa.array(outs, pa.int32())],
                names=["word", "pos", "prefix", "out"])

    return words.select("word").mapInArrow(cut, "word string, pos int, prefix binary, out int")


def trie_edges(vocabulary: DataFrame, states: int = STATES) -> DataFrame:
    """``node, salt, first, label, child, outs, near, near_n, salts``: the edges of a radix trie of ``vocabulary (word, n)``.

    ``first`` is the label's first code point, ``outs`` those that lead on from the child, ``near`` and
    ``near_n`` the child's word if it is one. The root is node -1. A node that many states may
    reach has its edges in ``salts`` copies (``salts`` of the row are the child's); a state carries the salt of its copy.
    """
    every = materialize(prefixes(vocabulary), "prefixes")
    # Nodes: the root, ends of words, and prefixes that go on in more than one way.
    nodes = every.groupBy("prefix").agg(
        F.min("out").alias("lo"), F.max("out").alias("hi"), F.max(F.col("out").isNull()).alias("is_word"),
        F.count(F.lit(1)).alias("below"), F.first("pos").alias("depth")).where("is_word OR lo <> hi OR depth = 0").select(
        "prefix", "below", F.when(F.col("depth") == 0, -1).otherwise(F.monotonically_increasing_id()).alias("node"))
    nodes = materialize(nodes, "trie-nodes")
    on_path = every.join(nodes.hint("shuffle_hash"), "prefix").groupBy("word").agg(
        F.array_sort(F.collect_list(F.struct("pos", "node", "below"))).alias("path"))
    steps = on_path.where(F.size("path") > 1).select("word", "path", F.explode(F.sequence(F.lit(1), F.size("path") - 1)).alias("i")).select(
        "word", F.col("path")[F.col("i") - 1].alias("up"), F.col("path")[F.col("i")].alias("at"))
    edges = steps.select(
        F.col("up.node").alias("node"), F.col("at.node").alias("child"), F.col("up.below").alias("above"),
        F.substring("word", F.col("up.pos") + 1, F.col("at.pos") - F.col("up.pos")).alias("label"),
        F.when(F.col("at.pos") == F.length("word"), F.col("word")).alias("near"))
    edges = materialize(edges.groupBy("node", "child", "label", "above").agg(F.max("near").alias("near")), "trie-edges")
    outs = edges.groupBy(F.col("node").alias("child")).agg(F.concat_ws("", F.collect_list(F.substring("label", 1, 1))).alias("outs"))
    copies = F.ceil(F.col("above") / states).cast("int")
    own = edges.select(F.col("child").alias("node"), copies.alias("copies")).unionByName(
        vocabulary.agg(F.count(F.lit(1)).alias("above")).select(F.lit(-1).cast("long").alias("node"), copies.alias("copies")))
    full = edges.join(outs, "child", "left").join(own, "node").join(
        vocabulary.select(F.col("word").alias("near"), F.col("n").alias("near_n")), "near", "left")
    return materialize(full.select(
        "node", F.explode(F.sequence(F.lit(0), F.col("copies") - 1)).alias("salt"), F.substring("label", 1, 1).alias("first"), "label", "child",
        F.coalesce("outs", F.lit("")).alias("outs"), "near", "near_n", copies.alias("salts")), "trie-edges")


def part(text, start, size=None) -> Column:
    """Code points of a text from a start (from 0), all the rest without a size."""
    return F.substring(text, start + 1, F.length(text) if size is None else size)


def salt_of(word, salts) -> Column:
    return F.pmod(F.xxhash64(word), salts).cast("int")


def both_ways(vocabulary: DataFrame) -> DataFrame:
    """``word, n, turn``: every word behind ``AHEAD`` and, reversed, behind ``BACK``; ``turn`` is the place from which it may be left.

    The first ``length // 2`` code points are the half ahead, the others the half back.
    """
    half = F.floor(F.length("word") / 2).cast("int")
    ways = F.array(F.struct(F.concat(F.lit(AHEAD), "word").alias("word"), (half + 1).alias("turn")),
                   F.struct(F.concat(F.lit(BACK), F.reverse("word")).alias("word"), (F.length("word") - half + 1).alias("turn")))
    return vocabulary.select("n", F.explode(ways).alias("way")).select("way.word", "n", "way.turn")


def arrivals(states: DataFrame, edges: DataFrame) -> DataFrame:
    """The next level: ``word, turn, pos, node, edits, salt, open, near, near_n`` after one edge from every state.

    A state without an edit is on its word's own path. It leaves the path only at the first code point in
    which the two words differ, and not before ``turn``: by a replaced code point, by one more
    or by one less. A state with an edit follows its word exactly. Both look one code point ahead:
    where nothing leads on from the child, the state ends.
    """
    word, pos, label, turn, before = F.col("word"), F.col("pos"), F.col("label"), F.col("turn"), F.col("edits")
    size, length = F.length(label), F.length(word)
    step = lambda end, edits: F.struct(end.cast("int").alias("pos"), edits.alias("edits"))
    leads_on = lambda end: F.when(end < length, F.contains(F.col("outs"), part(word, end, F.lit(1)))).otherwise(
        (end == length) & F.col("near").isNotNull())

    # Edges are dealt evenly by their copies: a hash table of a task's share spares the sort of the states.
    edges = edges.hint("shuffle_hash")
    ahead = [part(word, pos + i, F.lit(1)).alias(f"c{i}") for i in range(3)]
    # Before its turn, and with an edit, a word goes on only by an edge that begins with its next code point.
    bound = states.where("edits = 1 OR pos < turn").select("*", ahead[0], F.lit("").alias("c1"), F.lit("").alias("c2"), ahead[0].alias("first")).join(
        edges, ["node", "salt", "first"])
    free = states.where("edits = 0 AND pos >= turn").select("*", *ahead).join(edges, ["node", "salt"])
    whole = bound.unionByName(free.select(bound.columns))
    # The offset of the first difference of a longer label and the rest of the word.
    differ = F.array_position(F.transform(
        F.sequence(F.lit(0), size - 1), lambda i: part(word, pos + i, F.lit(1)) == part(label, i, F.lit(1))), F.lit(False)).cast("int") - 1
    whole = whole.withColumn("own", F.when(size == 1, F.col("c0") == label).otherwise(part(word, pos, size) == label)).withColumn(
        "k", F.when((size > 1) & ~F.col("own"), differ))
    k, has = F.col("k"), pos + F.col("k") < length
    tail = part(label, k + 1, size - k - 1)
    # Most labels are one code point, which differs at once: then the next code points of the word say all.
    near_at = lambda i: F.when(F.col(f"c{i}") != "", F.contains(F.col("outs"), F.col(f"c{i}"))).otherwise(
        (pos + i == length) & F.col("near").isNotNull())
    ways = {
        "replaced": (pos + size, (F.col("c0") != "") & near_at(1), has & (tail == part(word, pos + k + 1, size - k - 1))),
        "more": (pos + size - 1, near_at(0), tail == part(word, pos + k, size - k - 1)),
        "less": (pos + size + 1, (F.col("c1") == label) & near_at(2), has & (part(label, k, size - k) == part(word, pos + k + 1, size - k))),
    }
    leaves = ~F.col("own") & (before == 0) & (pos + F.coalesce(k, F.lit(0)) >= turn)
    for name, (end, one, several) in ways.items():
        whole = whole.withColumn(name, leaves & F.when(size == 1, one).otherwise(several & leads_on(end)))
    whole = whole.withColumn("own", F.col("own") & ((before == 0) | leads_on(pos + size)))
    both = whole.where("own OR replaced OR more OR less").withColumn("to", F.explode(F.array(
        F.when(F.col("own"), step(pos + size, before)).when(F.col("replaced"), step(pos + size, F.lit(1))),
        *[F.when(F.col(name), step(ways[name][0], F.lit(1))) for name in ("more", "less")]))).where("to IS NOT NULL")
    end, edits = F.col("to.pos"), F.col("to.edits")
    is_near = F.col("near").isNotNull() & (end == F.when(edits == 0, length - 1).otherwise(length))
    return both.select(
        "word", "turn", end.alias("pos"), F.col("child").alias("node"), edits.alias("edits"), salt_of("word", F.col("salts")).alias("salt"),
        ((F.col("outs") != "") & ((edits == 0) | (end < length))).alias("open"),
        F.when(is_near, F.col("near")).alias("near"), F.when(is_near, F.col("near_n")).alias("near_n"))


def neighbours(vocabulary: DataFrame, states: int = STATES) -> DataFrame:
    """``word, near, near_n``: all pairs of words of ``vocabulary (word, n)`` one edit apart, both ways.

    As many levels as the trie has nodes on its longest path. Words that agree in the half ahead may
    meet on both ways; those pairs count on the way ahead only.
    """
    keys = materialize(both_ways(vocabulary), "keys")
    edges = trie_edges(keys, states)
    total = keys.count()
    frontier = keys.select(
        "word", "turn", F.lit(0).alias("pos"), F.lit(-1).cast("long").alias("node"), F.lit(0).alias("edits"),
        salt_of("word", F.lit(max(1, -(-total // states)))).alias("salt"))
    ahead = F.startswith("word", F.lit(AHEAD))
    plain = lambda key: F.when(ahead, part(F.col(key), 1)).otherwise(F.reverse(part(F.col(key), 1)))
    half = F.floor(F.length("word") / 2).cast("int")
    found = None
    while True:
        level = materialize(arrivals(frontier, edges), "frontier")
        pairs = level.where("near IS NOT NULL").select(plain("word").alias("word"), plain("near").alias("near"), "near_n", ahead.alias("ahead")).where(
            F.col("ahead") | (F.substring("word", F.lit(1), half) != F.substring("near", F.lit(1), half))).drop("ahead")
        found = pairs if found is None else found.unionByName(pairs)
        frontier = level.where("open").select("word", "turn", "pos", "node", "edits", "salt")
        if frontier.isEmpty():
            return found


def roots(forms: DataFrame) -> DataFrame:
    """``word, root`` of ``forms (word, form)``: the last of the forms that follow from a word.

    Every word's pointer doubles its reach in a round. A form is several times as frequent as its word,
    so a chain is no longer than the logarithm of the largest count.
    """
    reach = materialize(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        ahead = reach.select(F.col("word").alias("root"), F.col("root").alias("further"))
        step = materialize(reach.join(ahead, "root", "left").select(
            "word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")), "roots")
        reach = step.select("word", "root")
        if step.where("moved").isEmpty():
            return reach


def variants(docs: DataFrame, least: int = LEAST, times: int = TIMES, factor: int = FACTOR, slips: int = SLIPS, states: int = STATES) -> DataFrame:
    """Per word ``word, form, root, n, n_near, form_n``.

    Words are runs of letters (A-Z in lower case, and U+00C0 to U+00FF) of at least ``least`` code points that occur at
    least ``times`` times over all documents, after the slip of one code point that a checksum of document and run
    puts into some. Near words differ by one inserted, deleted or replaced code point. A word's form is
    its near word of largest n if that is at least ``factor`` times its own; ``root`` is the last of the chain of forms.

    Ties go to the word that is smallest by code points. A null or empty text has no words; a row without an id has
    words but no slips; repeated rows count again. Texts and words of any length are read whole. Other columns are ignored;
    no rows give no rows.
    """
    vocabulary = materialize(word_counts(docs, least, slips).where(F.col("n") >= times), "vocabulary")
    near = neighbours(vocabulary, states).groupBy("word").agg(
        F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("order"), "near")).alias("best"))
    ranked = vocabulary.join(near, "word", "left").withColumn("has", -F.col("best.order") >= F.col("n") * factor)
    ranked = materialize(ranked.select(
        "word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"),
        F.when(F.col("has"), F.col("best.near")).alias("form"), F.when(F.col("has"), -F.col("best.order")).alias("form_n")), "forms")
    of = roots(ranked.where("form IS NOT NULL"))
    return ranked.join(of, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
