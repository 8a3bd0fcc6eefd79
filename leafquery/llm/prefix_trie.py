"""Prefix trie of conversations by whole-sequence collapse, in DataFrame operations only.

1. Every turn gets its place and a running 128-bit fingerprint of the conversation up to it: the exclusive or
   of a hash of (role, text, place) over all turns so far, so that running values of pieces of one
   conversation combine in any order. Turns are range-partitioned by conversation and turn, so a conversation
   of any length is cut over many tasks; a small table of piece totals joins the pieces up again.
2. Identical conversations are collapsed to one weighted sequence: number of conversations, smallest id, and
   the list of ids that end there, in bounded parts.
3. Sequences that are proper prefixes of others go by anti-join; what is left are the leaves.
4. The prefixes of weighted sequences are summed up to nodes.

Texts are hashed where they are scanned and never shuffled.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from leafquery.functions.staging import stage

GROUP = 100
MOST_SHARED = 6
#: children of a node that stay in one join partition; nodes with more are joined by broadcast
HOT_CHILDREN = 10_000
#: nodes that may be broadcast as hot ones
MOST_HOT = 10_000
NODE = ["depth", "k1", "k2"]


def shared_turns(conv_id: Column) -> Column:
    """How many first turns a conversation takes from the host of its group."""
    return F.crc32(conv_id.cast("string").cast("binary")) % MOST_SHARED


def group_host(conv_id: Column) -> Column:
    return conv_id - conv_id % GROUP


def _hashed(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, t1, t2, chars): a turn's 128-bit hash of role and text instead of its text."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    return conversations.filter("conv_id is not null").select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.xxhash64(role, text).alias("t1"),
        F.xxhash64(F.lit("second"), text, role).alias("t2"), F.char_length(text).cast("long").alias("chars"))


def _pieces(rows: DataFrame, *order: str) -> DataFrame:
    """``rows`` range-partitioned by ``order``, with the number of its range as ``piece``, written out."""
    keys = [F.asc_nulls_first(c) for c in order]
    return stage(rows.repartitionByRange(*keys).withColumn("piece", F.spark_partition_id()))


def _spanning(pieces: DataFrame, keys: list[str]) -> DataFrame:
    """Distinct (piece, *keys) of the groups that lie in more than one piece: at most two for each piece."""
    held = pieces.select("piece", *keys).distinct()
    many = held.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1").drop("_n")
    return held.join(many, keys, "left_semi")


def rebuild(conversations: DataFrame, host: Column | None = None, shared: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """(turns, members): every conversation with its first turns taken from its host.

    ``host`` and ``shared`` are expressions of conv_id: the first ``shared`` turns (at most ``MOST_SHARED``) of
    conversation ``host``, all if it has fewer, none if there is no such conversation, and then the conversation's own
    turns after its first ``shared``. ``turns`` has (conv_id, depth, k1, k2, p1, p2, chars, so_far, piece): the
    fingerprint up to a turn (k) and before it (p), the code points of its text and of all up to it.
    ``members`` has every conv_id once.

    Turns come in the order of ``turn``, null first; equal ones in the order of a hash of role and text. Null
    roles and texts are empty. Rows without a conv_id belong to no conversation. Texts of any length and
    other columns are fine; an empty table gives two empty ones.
    """
    host = group_host(F.col("conv_id")) if host is None else host
    shared = shared_turns(F.col("conv_id")) if shared is None else shared
    own = stage(_hashed(conversations))
    members = stage(own.select("conv_id").distinct())
    wanted = members.select("conv_id", host.alias("host"), shared.cast("int").alias("shared"))
    # a literal limit, so that each task drops all but the first turns before they are shuffled
    first = Window.partitionBy("conv_id").orderBy(F.asc_nulls_first("turn"), "t1", "t2")
    heads = (own.withColumn("at", F.row_number().over(first)).filter(F.col("at") <= MOST_SHARED)
             .groupBy(F.col("conv_id").alias("host"))
             .agg(F.array_sort(F.collect_list(F.struct("at", "t1", "t2", "chars"))).alias("turns")))
    given = (wanted.join(heads, "host").select("conv_id", F.explode(F.slice("turns", 1, F.col("shared"))).alias("x"))
             .select("conv_id", F.lit(0).alias("own"), F.col("x.at").cast("long").alias("turn"), "x.t1", "x.t2", "x.chars"))
    rows = given.unionByName(own.select("conv_id", F.lit(1).alias("own"), "turn", "t1", "t2", "chars"))
    order = ["conv_id", "own", "turn", "t1", "t2"]
    pieces = _pieces(rows, *order)
    cut = _spanning(pieces, ["conv_id"])

    # own turns in earlier pieces of the conversation, and turns taken from the host (all in front)
    inside = (Window.partitionBy("conv_id", "piece").orderBy("own", F.asc_nulls_first("turn"), "t1", "t2")
              .rowsBetween(Window.unboundedPreceding, 0))
    earlier = Window.partitionBy("conv_id").orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)
    counts = (pieces.join(F.broadcast(cut), ["conv_id", "piece"], "left_semi").groupBy("conv_id", "piece")
              .agg(F.sum("own").alias("_own"), F.sum(1 - F.col("own")).alias("_given"))
              .select("conv_id", "piece", F.sum("_own").over(earlier).alias("own_before"),
                      F.sum("_given").over(earlier).alias("given_before")))
    placed = (pieces.join(F.broadcast(counts), ["conv_id", "piece"], "left")
              .withColumn("n_own", F.sum("own").over(inside) + F.coalesce("own_before", F.lit(0)))
              .withColumn("n_given", F.sum(1 - F.col("own")).over(inside) + F.coalesce("given_before", F.lit(0)))
              .filter((F.col("own") == 0) | (F.col("n_own") > shared))
              .withColumn("depth", F.when(F.col("own") == 0, F.col("n_given"))
                          .otherwise(F.col("n_given") + F.col("n_own") - shared))
              .withColumn("h1", F.xxhash64("t1", "t2", "depth")).withColumn("h2", F.xxhash64("depth", "t2", "t1")))
    running = Window.partitionBy("conv_id", "piece").orderBy("depth").rowsBetween(Window.unboundedPreceding, 0)
    local = stage(placed.select("conv_id", "piece", "depth", "h1", "h2", "chars", *[
        f(c).over(running).alias(n) for n, f, c in
        (("r1", F.bit_xor, "h1"), ("r2", F.bit_xor, "h2"), ("r3", F.sum, "chars"))]))
    totals = (local.join(F.broadcast(cut), ["conv_id", "piece"], "left_semi").groupBy("conv_id", "piece")
              .agg(F.bit_xor("h1").alias("h1"), F.bit_xor("h2").alias("h2"), F.sum("chars").alias("c"))
              .select("conv_id", "piece", F.bit_xor("h1").over(earlier).alias("b1"),
                      F.bit_xor("h2").over(earlier).alias("b2"), F.sum("c").over(earlier).alias("b3")))
    zero = F.lit(0).cast("long")
    k1, k2 = [F.col(f"r{i}").bitwiseXOR(F.coalesce(f"b{i}", zero)) for i in (1, 2)]
    turns = local.join(F.broadcast(totals), ["conv_id", "piece"], "left").select(
        "conv_id", "depth", k1.alias("k1"), k2.alias("k2"), k1.bitwiseXOR(F.col("h1")).alias("p1"),
        k2.bitwiseXOR(F.col("h2")).alias("p2"), "chars", (F.col("r3") + F.coalesce("b3", zero)).alias("so_far"), "piece")
    return stage(turns), members


@dataclass
class Trie:
    """nodes(depth, k1, k2, conv_id, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens),
    ends(depth, k1, k2, part, ids): ids of the conversations that end at a node, ascending in and over the parts."""

    nodes: DataFrame
    ends: DataFrame


def build_trie(turns: DataFrame, members: DataFrame) -> Trie:
    """The trie of ``rebuild``'s conversations; no members, no nodes.

    ``saved_tokens`` of a node is the sum over its subtree of (conversations - 1) x code points of the node's text. With w, length and
    smallest id of weighted sequences this is a sum over the sequences below: each adds w times its code points
    from the node on, less those of the nodes that it owns, being their smallest member. A sequence owns its last nodes,
    from one depth on.
    """
    zero = F.lit(0).cast("long")
    last = turns.groupBy("conv_id").agg(F.max(F.struct("depth", "k1", "k2", "so_far")).alias("x"))
    whole = members.join(last, "conv_id", "left").select(
        "conv_id", *[F.coalesce(F.col(f"x.{c}"), zero).alias(c) for c in (*NODE, "so_far")])
    # whole-sequence collapse
    whole = stage(whole)
    sequences = stage(whole.groupBy(*NODE, F.col("so_far").alias("all_chars")).agg(
        F.count(F.lit(1)).alias("weight"), F.min("conv_id").alias("first_id")))

    # only the turns of each sequence's smallest member go on; they meet it piece by piece, so that one endless
    # conversation is many join keys
    held = turns.select("conv_id", "piece").distinct()
    facts = sequences.select(F.col("first_id").alias("conv_id"), F.col("depth").alias("end"), "weight", "all_chars")
    prefixes = stage(turns.join(facts.join(held, "conv_id"), ["conv_id", "piece"]))
    below = prefixes.groupBy(*NODE).agg(
        F.sum("weight").alias("n_convs"), F.min("conv_id").alias("conv_id"), F.max(F.col("depth") < F.col("end")).alias("inner"),
        F.min("p1").alias("p1"), F.min("p2").alias("p2"), F.min(F.col("so_far") - F.col("chars")).alias("before"))
    root = (sequences.groupBy(zero.alias("depth"), zero.alias("k1"), zero.alias("k2")).agg(
        F.sum("weight").alias("n_convs"), F.min("first_id").alias("conv_id"), F.max(F.col("depth") > 0).alias("inner"))
        .withColumns({"p1": zero, "p2": zero, "before": zero}))
    nodes = stage(below.unionByName(root))

    # leaves: sequences that are no proper prefix; and the first node that each sequence owns
    leaves = sequences.join(nodes.filter("inner").select(*NODE), NODE, "left_anti").select(
        F.col("first_id").alias("conv_id"), F.lit(1).alias("leaf"))
    owned = nodes.filter("depth > 0").groupBy("conv_id").agg(
        F.min(F.struct("depth", "before")).alias("own"))
    facts = stage(sequences.select(F.col("first_id").alias("conv_id"), F.col("depth").alias("end"), "weight", "all_chars")
                  .join(leaves, "conv_id", "left").join(owned, "conv_id", "left")
                  .select("conv_id", "weight", "all_chars", F.coalesce("leaf", F.lit(0)).alias("leaf"), "own"))
    marks = facts.select("conv_id", "leaf", "own").join(held, "conv_id")
    before = F.col("so_far") - F.col("chars")
    sums = (prefixes.join(marks, ["conv_id", "piece"]).groupBy(*NODE).agg(
        F.sum("leaf").alias("n_leaves"),
        F.sum(F.col("weight") * (F.col("all_chars") - before) - F.when(F.col("own").isNull(), zero).otherwise(
            F.col("all_chars") - F.greatest(F.col("own.before"), before))).alias("saved_tokens"))
        .unionByName(facts.agg(F.sum("leaf").alias("n_leaves"), F.sum(
            F.col("weight") * F.col("all_chars") - F.coalesce(F.col("all_chars") - F.col("own.before"), zero)).alias("saved_tokens"))
            .select(zero.alias("depth"), zero.alias("k1"), zero.alias("k2"), "n_leaves", "saved_tokens")))
    up = [(F.col("depth") - 1).alias("depth"), F.col("p1").alias("k1"), F.col("p2").alias("k2")]
    children = nodes.filter("depth > 0").groupBy(*up).agg(F.count(F.lit(1)).alias("n_children"))
    told = stage(nodes.join(sums, NODE).join(children, NODE, "left").select(
        *NODE, "p1", "p2", "conv_id", "n_convs", F.coalesce("n_children", zero).alias("n_children"), "n_leaves", "saved_tokens"))
    return Trie(_with_parents(told), _ends(whole))


def _with_parents(nodes: DataFrame) -> DataFrame:
    """Nodes with parent_conv_id. Parents of very many children (few, by count) are broadcast, the rest is an equi-join."""
    parent = [(F.col("depth") + 1).alias("depth"), F.col("k1").alias("p1"), F.col("k2").alias("p2"),
              F.col("conv_id").alias("parent_conv_id")]
    key = ["depth", "p1", "p2"]
    # each hot parent has more than ``least`` children, so there are at most MOST_HOT of them
    least = max(HOT_CHILDREN, (nodes.count() // MOST_HOT))
    hot = F.broadcast(nodes.filter(F.col("n_children") > least).select(*parent))
    usual = nodes.filter((F.col("n_children") > 0) & (F.col("n_children") <= least)).select(*parent)
    under = nodes.filter("depth > 0")
    out = under.join(hot, key).unionByName(under.join(hot, key, "left_anti").join(usual, key)).unionByName(
        nodes.filter("depth = 0").withColumn("parent_conv_id", F.lit(None).cast("long")))
    return out.drop("p1", "p2")


def _ends(whole: DataFrame) -> DataFrame:
    """(depth, k1, k2, part, ids): ids that end at a node; a part is what one range of all (node, id) holds of it."""
    pieces = _pieces(whole.select(*NODE, "conv_id"), *NODE, "conv_id")
    return stage(pieces.groupBy(*NODE, F.col("piece").alias("part")).agg(F.array_sort(F.collect_list("conv_id")).alias("ids")))


def ends_digest(trie: Trie) -> DataFrame:
    """(depth, k1, k2, ends_sha256): SHA-256 of a node's end ids, comma-joined.

    A list of one part is hashed in place. Lists of several parts (at most two for each range) are streamed
    part by part through one hash, as SHA-256 has to be; no list is ever held whole.
    """
    parts = trie.ends.select(*NODE, "part", F.array_join(F.col("ids").cast("array<string>"), ",").alias("ids"))
    many = F.broadcast(trie.ends.groupBy(*NODE).agg(F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n"))
    single = parts.join(many, NODE, "left_anti").select(*NODE, F.sha2("ids", 256).alias("ends_sha256"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = digest = None

        def row():
            return pa.RecordBatch.from_arrays([pa.array([k], pa.int64()) for k in key] + [pa.array([digest.hexdigest()])],
                                              [*NODE, "ends_sha256"])

        for batch in batches:
            *keys, ids = [batch.column(n).to_pylist() for n in (*NODE, "ids")]
            for here, text in zip(zip(*keys), ids):
                if here != key:
                    if key is not None:
                        yield row()
                    key, digest = here, hashlib.sha256()
                else:
                    digest.update(b",")
                digest.update(text.encode())
        if key is not None:
            yield row()

    streamed = (parts.join(many, NODE, "left_semi").repartition(*NODE).sortWithinPartitions(*NODE, "part")
                .mapInArrow(run, "depth bigint, k1 bigint, k2 bigint, ends_sha256 string"))
    return single.unionByName(streamed)


def trie_table(conversations: DataFrame) -> DataFrame:
    """One row for each node of the trie of all rebuilt conversations, with the digest of its ends."""
    trie = build_trie(*rebuild(conversations))
    nothing = hashlib.sha256().hexdigest()
    return trie.nodes.join(ends_digest(trie), NODE, "left").select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens",
        F.coalesce("ends_sha256", F.lit(nothing)).alias("ends_sha256"))
