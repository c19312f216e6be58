"""Prefix trie of conversations, its subtree sums by the Euler-tour technique.

Nodes are distinct sequences of first turns. Every node gives an arc that enters and an
arc that leaves it; the arcs in the order of a walk around the trie form one list. The list is
ranked by contraction to rulers, and running sums at the arcs' positions give the sum
over any subtree as a difference of two of them.
"""

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from taxaspark.llm.tables import materialize

GROUP = 5            # conversations that share the opening of the first of them
OPENING = 9          # h is a checksum modulo this
SIBLINGS = 256       # children of a node that are put in order at a time
RULERS = 16          # one arc of so many is a ruler
LAST = 1 << 16       # a contracted list of at most so many arcs is ranked in one task
BLOCK = 1 << 16      # positions summed in one task
CHUNK = 1 << 18      # bytes of member ids joined at a time


def ordered_turns(conversations: DataFrame) -> DataFrame:
    """``conv_id, pos, role, text``: turns with their place (from 0) in their conversation.

    Turns go by number (null first), equal numbers by role, then text. Rows are range-sorted as a
    whole and counted by partition, so a long conversation is spread over several tasks.
    """
    empty = F.lit("")
    rows = conversations.where("conv_id IS NOT NULL").select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
        F.coalesce("role", empty).alias("role"), F.coalesce("text", empty).alias("text"))
    order = ["conv_id", F.col("turn").asc_nulls_first(), "role", "text"]
    # The number holds the partition in its high bits and the row in the low 33.
    sorted_ = materialize(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn(
        "at", F.monotonically_increasing_id()), "turns")
    parts = sorted_.groupBy("conv_id", F.shiftright("at", 33).alias("part")).agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("n"))
    earlier = W.partitionBy("conv_id").orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    starts = parts.select("conv_id", "part", "first", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    return sorted_.withColumn("part", F.shiftright("at", 33)).join(starts, ["conv_id", "part"]).select(
        "conv_id", (F.col("at") - F.col("first") + F.col("before")).alias("pos"), "role", "text")


def rebuilt(turns: DataFrame, group: int = GROUP, opening: int = OPENING) -> DataFrame:
    """``conv_id, depth, role, text`` (depth from 1): each conversation behind the opening of its group's first.

    Conversation c takes the first h turns of conversation c - c % group, h = crc32(c) % opening, then its own
    turns after its first h. ``turns`` is ``conv_id, pos, role, text``.
    """
    h = F.crc32(F.col("conv_id").cast("string")) % opening
    sizes = turns.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n"))
    convs = sizes.select("conv_id", (F.col("conv_id") - F.col("conv_id") % group).alias("base"), h.alias("h")).join(
        sizes.select(F.col("conv_id").alias("base"), F.col("n").alias("base_n")), "base", "left").select(
        "conv_id", "base", "h", F.least("h", F.coalesce("base_n", F.lit(0))).alias("taken"))
    convs = materialize(convs, "convs")
    first = turns.where(F.col("pos") < opening - 1).select(F.col("conv_id").alias("base"), "pos", "role", "text")
    opened = convs.select("conv_id", "base", "taken").join(first, "base").where("pos < taken").select(
        "conv_id", (F.col("pos") + 1).alias("depth"), "role", "text")
    own = turns.where(F.col("pos") >= h).join(convs.select("conv_id", "h", "taken"), "conv_id").select(
        "conv_id", (F.col("pos") - F.col("h") + F.col("taken") + 1).alias("depth"), "role", "text")
    return opened.unionByName(own)


def digest(*columns) -> Column:
    """SHA-256 of several strings, told apart by their lengths."""
    parts = [p for c in columns for p in (F.length(c).cast("string"), F.lit(":"), F.col(c))]
    return F.unhex(F.sha2(F.concat(*parts), 256))


def prefix_digests(rows: DataFrame) -> DataFrame:
    """``conv_id, depth, bytes, prefix``: a digest of the turns 1..depth, equal for equal sequences.

    After round k a row's digest covers the last 2**k turns up to it, so a conversation of n turns
    takes log2(n) rounds and only rows deeper than 2**k take part in the next.
    """
    own = rows.select("conv_id", "depth", F.octet_length("text").cast("long").alias("bytes"), digest("role", "text").alias("prefix"))
    done, span = materialize(own, "prefixes"), 1
    deepest = done.agg(F.max("depth")).first()[0] or 0
    while span < deepest:
        before = done.select("conv_id", (F.col("depth") + span).alias("depth"), F.col("prefix").alias("before"))
        joined = done.where(F.col("depth") > span).join(before, ["conv_id", "depth"]).select(
            "conv_id", "depth", "bytes", F.unhex(F.sha2(F.concat("before", "prefix"), 256)).alias("prefix"))
        done = materialize(done.where(F.col("depth") <= span).unionByName(joined), "prefixes")
        span *= 2
    return done


def trie_nodes(prefixes: DataFrame, convs: DataFrame) -> DataFrame:
    """``node, conv_id, depth, parent, parent_conv_id, n_convs, n_children, own_tokens``, the root first of all (depth 0).

    A node is named by its smallest member and its depth; ``node`` and ``parent`` are numbers of nodes.
    """
    found = prefixes.groupBy("prefix").agg(
        F.min("conv_id").alias("conv_id"), F.first("depth").alias("depth"), F.first("bytes").alias("bytes"), F.count(F.lit(1)).alias("n_convs"))
    found = materialize(found.withColumn("node", F.monotonically_increasing_id() + 1), "nodes")
    # A node's parent is the node that holds its smallest member one turn earlier.
    above = prefixes.select("conv_id", (F.col("depth") + 1).alias("depth"), "prefix").join(
        found.select("conv_id", "depth"), ["conv_id", "depth"]).join(
        found.select("prefix", F.col("node").alias("parent"), F.col("conv_id").alias("parent_conv_id")), "prefix").drop("prefix")
    root = convs.agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_convs")).where("n_convs > 0")
    nodes = found.join(above, ["conv_id", "depth"], "left").select(
        "node", "conv_id", "depth", F.coalesce("parent", F.lit(0)).alias("parent"),
        F.coalesce("parent_conv_id", root.select("conv_id").scalar()).alias("parent_conv_id"), "n_convs", "bytes")
    nodes = nodes.unionByName(root.select(
        F.lit(0).cast("long").alias("node"), "conv_id", F.lit(0).cast("long").alias("depth"), F.lit(None).cast("long").alias("parent"),
        F.lit(None).cast("long").alias("parent_conv_id"), "n_convs", F.lit(0).cast("long").alias("bytes")))
    nodes = materialize(nodes, "nodes")
    children = nodes.where("parent IS NOT NULL").groupBy(F.col("parent").alias("node")).agg(F.count(F.lit(1)).alias("n_children"))
    return materialize(nodes.join(children, "node", "left").select(
        "node", "conv_id", "depth", "parent", "parent_conv_id", "n_convs",
        F.coalesce("n_children", F.lit(0)).alias("n_children"), ((F.col("n_convs") - 1) * F.col("bytes")).alias("own_tokens")), "nodes")


def next_siblings(nodes: DataFrame, siblings: int = SIBLINGS) -> DataFrame:
    """``node, parent, following, eldest``: each child with the next child of its parent, null behind the last.

    Children are dealt to buckets of about ``siblings`` by a hash; the walk takes the buckets one after
    another. So a parent with a great many children is ordered by many tasks.
    """
    of = nodes.select(F.col("node").alias("parent"), F.ceil(F.col("n_children") / siblings).alias("buckets"))
    # Written, or the windows would keep the partitioning by parent that this join leaves.
    dealt = materialize(nodes.select("node", "parent").join(of, "parent").withColumn(
        "bucket", F.pmod(F.xxhash64("node"), F.col("buckets"))), "dealt")
    inside = W.partitionBy("parent", "bucket").orderBy("node")
    placed = materialize(dealt.withColumn("following", F.lead("node").over(inside)).withColumn("place", F.row_number().over(inside)), "placed")
    across = W.partitionBy("parent").orderBy("bucket")
    heads = placed.where("place = 1").select("parent", "bucket", F.col("node").alias("head"))
    turns = materialize(heads.select(
        "parent", "bucket", F.lead("head").over(across).alias("next_head"), F.row_number().over(across).alias("turn")), "heads")
    return placed.join(turns, ["parent", "bucket"]).select(
        "node", "parent", F.coalesce("following", "next_head").alias("following"), ((F.col("place") == 1) & (F.col("turn") == 1)).alias("eldest"))


def euler_arcs(nodes: DataFrame, siblings: int = SIBLINGS) -> DataFrame:
    """``arc, next``: the list of arcs of the walk. Node n is entered by arc 2n and left by arc 2n + 1."""
    order = materialize(next_siblings(nodes, siblings), "siblings")
    eldest = order.where("eldest").select(F.col("parent").alias("node"), F.col("node").alias("child"))
    enter = nodes.select("node").join(eldest, "node", "left").select(
        (F.col("node") * 2).alias("arc"), F.coalesce(F.col("child") * 2, F.col("node") * 2 + 1).alias("next"))
    leave = order.select((F.col("node") * 2 + 1).alias("arc"), F.coalesce(F.col("following") * 2, F.col("parent") * 2 + 1).alias("next"))
    end = nodes.where("parent IS NULL").select((F.col("node") * 2 + 1).alias("arc"), F.lit(None).cast("long").alias("next"))
    return enter.unionByName(leave).unionByName(end)


def rank_in_one_task(arcs: DataFrame) -> DataFrame:
    """``arc, behind`` of a short list ``arc, next, dist``: the sum of ``dist`` from an arc to the end, by pointer jumping in NumPy."""
    def rank(table):
        arc, following = table.column("arc").to_numpy(), table.column("next").fill_null(-1).to_numpy()
        behind = table.column("dist").to_numpy().copy()
        order = np.argsort(arc)
        jump = np.where(following < 0, -1, order[np.searchsorted(arc, following, sorter=order) % max(len(arc), 1)])
        while (jump >= 0).any():
            moving = np.flatnonzero(jump >= 0)
            to = jump[moving]
            behind[moving] += behind[to]
            jump[moving] = jump[to]
        return pa.table({"arc": arc, "behind": behind})

    return arcs.groupBy().applyInArrow(rank, "arc long, behind long")


def list_ranks(arcs: DataFrame, rulers: int = RULERS, last: int = LAST, level: int = 0) -> DataFrame:
    """``arc, behind``: arcs between each arc and the end of the list ``arc, next, dist``.

    About one arc in ``rulers`` is a ruler. The others jump, twice as far each round, until they
    have met the next ruler: rounds are bounded by the longest stretch without one, not by the
    list. The rulers alone are a list ``rulers`` times shorter, ranked the same way by rulers of the
    next ``level``, the last of at most ``last`` arcs in one task; then every arc adds its ruler's rank.
    """
    if arcs.limit(last + 1).count() <= last:
        return rank_in_one_task(arcs)
    ruler = lambda c: F.pmod(F.xxhash64(c, F.lit(level)), F.lit(rulers)) == 0
    still = F.col("next").isNotNull() & ~ruler("next")
    # ``open``: the jump has not met a ruler nor the end yet.
    state = materialize(arcs.select("arc", "next", "dist", still.alias("open")), "ranks")
    while not state.where("open").isEmpty():
        ahead = state.where(~ruler("arc")).select(
            F.col("arc").alias("next"), F.col("next").alias("to"), F.col("dist").alias("more"), F.col("open").alias("ahead_open"))
        moved = state.where("open").join(ahead, "next").select(
            "arc", F.col("to").alias("next"), (F.col("dist") + F.col("more")).alias("dist"), F.col("ahead_open").alias("open"))
        state = materialize(state.where("NOT open").unionByName(moved), "ranks")
    short = materialize(list_ranks(state.where(ruler("arc")).select("arc", "next", "dist"), rulers, last, level + 1), "ranks")
    return state.join(short.select(F.col("arc").alias("next"), F.col("behind").alias("rest")), "next", "left").select(
        "arc", (F.col("dist") + F.coalesce("rest", F.lit(0))).alias("behind"))


def subtree_sums(nodes: DataFrame, arcs: DataFrame, values: dict, rulers: int = RULERS, last: int = LAST, block: int = BLOCK) -> DataFrame:
    """``node`` and the sum of each of ``values`` (name to column of ``nodes``) over the node's subtree.

    Positions are dense, so a block of them has a fixed size and its running sums are one small
    window; block totals are summed over the blocks. A node's sum is what the list adds between its two arcs.
    """
    weighted = arcs.withColumn("dist", F.when(F.col("next").isNull(), 0).otherwise(1).cast("long"))
    ranks = list_ranks(materialize(weighted, "arcs"), rulers, last)
    names = list(values)
    own = nodes.select((F.col("node") * 2).alias("arc"), *[values[n].cast("long").alias(n) for n in names])
    placed = materialize(ranks.join(own, "arc", "left").select(
        "arc", "behind", F.floor(F.col("behind") / block).alias("block"), *[F.coalesce(n, F.lit(0)).alias(n) for n in names]), "placed")
    # ``behind`` falls along the walk: what stands at it or later in the walk has a lower one.
    inside = W.partitionBy("block").orderBy("behind")
    later = W.orderBy("block").rowsBetween(W.unboundedPreceding, -1)
    totals = placed.groupBy("block").agg(*[F.sum(n).alias(n) for n in names])
    after = totals.select("block", *[F.coalesce(F.sum(n).over(later), F.lit(0)).alias(f"after_{n}") for n in names])
    running = placed.select("arc", "block", *[F.sum(n).over(inside).alias(n) for n in names]).join(after, "block")
    sign = F.when(F.col("arc") % 2 == 0, 1).otherwise(-1)
    return running.groupBy(F.shiftright("arc", 1).alias("node")).agg(
        *[F.sum(sign * (F.col(n) + F.col(f"after_{n}"))).alias(n) for n in names])


def joined_ids_sha256(members: DataFrame) -> DataFrame:
    """``node, ends_sha256``: SHA-256 of the members' ids, decimal, ascending, with commas between them.

    A digest of one string is sequential, so one task reads a node's ids as a stream of chunks that
    many tasks have put in order and joined. No list of members is held.
    """
    def chunks(batches):
        for batch in batches:
            of, ids = batch.column("node").to_numpy(), batch.column("conv_id").to_numpy()
            at = np.flatnonzero(np.diff(of, prepend=of[:1] - 1)) if len(of) else []
            step = CHUNK // 21
            out = [(of[s], ids[i], ",".join(map(str, ids[i:min(i + step, e)].tolist())))
                   for s, e in zip(at, [*at[1:], len(of)]) for i in range(s, e, step)]
            yield pa.RecordBatch.from_arrays(
                [pa.array([o[0] for o in out], pa.int64()), pa.array([o[1] for o in out], pa.int64()), pa.array([o[2] for o in out], pa.string())],
                names=["node", "first", "ids"])

    def digests(batches):
        node, state = None, None
        for batch in batches:
            done = []
            for of, ids in zip(batch.column("node").to_pylist(), batch.column("ids").to_pylist()):
                if of != node:
                    if state is not None:
                        done.append((node, state.hexdigest()))
                    node, state = of, hashlib.sha256(ids.encode())
                else:
                    state.update(b"," + ids.encode())
            yield pa.RecordBatch.from_arrays([pa.array([d[0] for d in done], pa.int64()), pa.array([d[1] for d in done], pa.string())],
                                             names=["node", "ends_sha256"])
        if state is not None:
            yield pa.RecordBatch.from_arrays([pa.array([node], pa.int64()), pa.array([state.hexdigest()])], names=["node", "ends_sha256"])

    sorted_ = members.select("node", "conv_id").repartitionByRange("node", "conv_id").sortWithinPartitions("node", "conv_id")
    joined = sorted_.mapInArrow(chunks, "node long, first long, ids string")
    return joined.repartition("node").sortWithinPartitions("node", "first").mapInArrow(digests, "node long, ends_sha256 string")


def prefix_trie(conversations: DataFrame, group: int = GROUP, opening: int = OPENING, siblings: int = SIBLINGS,
                rulers: int = RULERS, last: int = LAST, block: int = BLOCK) -> DataFrame:
    """Per trie node ``conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256``.

    ``conversations`` is ``conv_id, turn, role, text``, a row per turn. See :func:`rebuilt` for how a
    conversation is put together and the module for the method. ``n_leaves`` and ``saved_tokens``
    ((n_convs - 1) times the bytes of the node's last text) are sums over the subtree.

    A null role or text is empty, a null turn comes first; equal turns go by role, then text, and
    repeated rows are turns of their own. Rows without a conv_id belong to no conversation. Texts of
    any length go by their digest. Other columns are ignored; no conversations give no rows.
    """
    turns = materialize(ordered_turns(conversations), "ordered")
    convs = turns.select("conv_id").distinct()
    prefixes = prefix_digests(rebuilt(turns, group, opening))
    nodes = trie_nodes(prefixes, convs)
    numbers = nodes.select("node", "conv_id", "depth")
    # Members that end at a node: the node of the last prefix, the root for a conversation without turns.
    depth = prefixes.groupBy("conv_id").agg(F.max("depth").alias("depth"))
    least = prefixes.groupBy("prefix").agg(F.min("conv_id").alias("least"))
    lasts = prefixes.join(depth, ["conv_id", "depth"]).join(least, "prefix").select("conv_id", F.col("least"), "depth")
    ends = lasts.join(numbers.select(F.col("conv_id").alias("least"), "depth", "node"), ["least", "depth"]).select("node", "conv_id").unionByName(
        convs.join(depth, "conv_id", "left_anti").select(F.lit(0).cast("long").alias("node"), "conv_id"))
    sums = subtree_sums(nodes, euler_arcs(nodes, siblings), {
        "n_leaves": F.col("n_children") == 0, "saved_tokens": F.col("own_tokens")}, rulers, last, block)
    return nodes.join(sums, "node").join(joined_ids_sha256(ends), "node", "left").select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens",
        F.coalesce("ends_sha256", F.sha2(F.lit(""), 256)).alias("ends_sha256"))
