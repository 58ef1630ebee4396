"""Conversation prefix trie by smallest-member ownership.

A node is a distinct sequence of the first d turns (role and text) of some conversation; its members
are the conversations that start with it, and its smallest member owns it. Members only get fewer
further down, so a conversation owns its path from some depth to its end, or nothing of it (a copy
of a conversation with a smaller id). Hence no tree is walked:

* Windows over each conversation give every prefix its hash, the code points before it and its
  parent's hash. A prefix's hash is the exclusive or of two seeded 64-bit hashes of (MD5 of the
  turn, position) over its turns, 128 bits in all.
* Every node takes its smallest member, together with that member's values, by an aggregation that
  combines before the exchange: the root holds all conversations and a common opening a third of
  them, and neither becomes one task (a window over a node's members would make it one).
* Per conversation, the least depth it owns and whether its last node is an owned one without
  children follow from the nodes.
* One aggregation by prefix then sums over members: a node's subtree holds each member's code points
  from there on, once per occurrence, less those of the nodes, each of which one member owns. A
  member adds what it does not own at this depth or below, and one leaf if it ends in its own.

Ids of conversations that end in a node are joined in blocks of neighbouring ids first and hashed as
a stream in order, so a node's ends are never held at once.

`rebuilt` mixes conversations: the first h turns of conversation c - c % spread, then c's own turns
after its first h, with h = crc32 of the decimal c modulo `cuts`.

Turns are ordered by number, nulls first, then by role and text; repeated rows are turns of their
own. Null roles and texts are empty. Rows without a conversation id are left out. A conversation
whose rebuilt form has no turns is a member of the root only. An empty table gives no nodes. Other
columns are not read. Hash-equal prefixes are taken to be equal.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyfold.llm import common

#: Ids of one block of ends.
BLOCK = 4096
NODE = ["depth", "h1", "h2"]


def numbered_turns(turns: DataFrame) -> DataFrame:
    """conv_id, k (from 1), digest and chars of every turn in its conversation's order."""
    own = turns.where("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").alias("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    order = Window.partitionBy("conv_id").orderBy(F.asc_nulls_first("turn"), "role", "text")
    digest = F.md5(F.concat_ws(":", F.octet_length("role"), "role", "text"))
    return own.select("conv_id", F.row_number().over(order).alias("k"), digest.alias("digest"), F.char_length("text").cast("long").alias("chars"))


def rebuilt(turns: DataFrame, spread: int = 100, cuts: int = 6) -> DataFrame:
    """conv_id, pos, digest and chars of the turns of every rebuilt conversation, and a row of
    position 0 without a digest for each conversation."""
    numbered = common.durable(numbered_turns(turns), "turns")
    convs = numbered.groupBy("conv_id").agg(F.count(F.lit(1)).alias("own")).select("conv_id", (F.crc32(F.col("conv_id").cast("string").cast("binary")) % cuts).cast("int").alias("h"), (F.col("conv_id") - F.col("conv_id") % spread).alias("base"))
    heads = numbered.where((F.col("conv_id") % spread == 0) & (F.col("k") < cuts)).select(F.col("conv_id").alias("base"), "k", "digest", "chars")
    # a base has as many borrowers as there are ids beside it, fewer than 2 * spread
    lent = convs.join(heads, "base").where("k <= h")
    given = lent.groupBy("conv_id").agg(F.count(F.lit(1)).cast("int").alias("given"))
    shift = convs.join(given, "conv_id", "left").select("conv_id", "h", F.coalesce("given", F.lit(0)).alias("given"))
    kept = numbered.join(shift, "conv_id").where("k > h").select("conv_id", (F.col("k") - F.col("h") + F.col("given")).alias("pos"), "digest", "chars")
    first = lent.select("conv_id", F.col("k").alias("pos"), "digest", "chars")
    none = convs.select("conv_id", F.lit(0).alias("pos"), F.lit(None).cast("string").alias("digest"), F.lit(0).cast("long").alias("chars"))
    return kept.unionByName(first).unionByName(none)


def _ends(paths: DataFrame) -> DataFrame:
    """NODE and ends_sha256 of nodes in which conversations end."""
    last = paths.where("depth = length").select(*NODE, "conv_id", F.floor(F.col("conv_id") / BLOCK).alias("block"))
    blocks = last.groupBy(*NODE, "block").agg(F.array_join(F.transform(F.array_sort(F.collect_list("conv_id")), lambda i: i.cast("string")), ",").alias("ids"))

    def digest(batches):
        at, state = None, None
        for batch in batches:
            out = []
            for *key, ids in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                if key != at:
                    if at is not None:
                        out.append((*at, state.hexdigest()))
                    at, state = key, hashlib.sha256(ids.encode())
                else:
                    state.update(b"," + ids.encode())
            yield _rows(out)
        if at is not None:
            yield _rows([(*at, state.hexdigest())])

    def _rows(out):
        kinds = (pa.int32(), pa.int64(), pa.int64(), pa.string())
        return pa.record_batch([pa.array(c, k) for c, k in zip(list(zip(*out, strict=True)) or [[]] * 4, kinds, strict=True)], names=[*NODE, "ends_sha256"])

    ordered = blocks.repartition(*NODE).sortWithinPartitions(*NODE, "block").select(*NODE, "ids")
    return common.map_arrow(ordered, digest, "depth int, h1 bigint, h2 bigint, ends_sha256 string")


def prefix_trie(turns: DataFrame) -> DataFrame:
    """One row per node of the trie over `turns` (conv_id, pos, digest, chars, as `rebuilt` gives):
    conv_id (smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens
    and ends_sha256."""
    order = Window.partitionBy("conv_id").orderBy("pos")
    upto = order.rowsBetween(Window.unboundedPreceding, 0)
    item = lambda seed: F.when(F.col("pos") > 0, F.xxhash64(F.lit(seed), "digest", "pos")).otherwise(F.lit(0).cast("long"))
    hashed = turns.select("conv_id", "pos", "chars", item(1).alias("x1"), item(2).alias("x2"))
    whole = Window.partitionBy("conv_id")
    paths = hashed.select(
        "conv_id", F.col("pos").alias("depth"), F.bit_xor("x1").over(upto).alias("h1"), F.bit_xor("x2").over(upto).alias("h2"), "x1", "x2",
        (F.sum("chars").over(upto) - F.col("chars")).alias("before"), F.max("pos").over(whole).alias("length"), F.sum("chars").over(whole).alias("chars"),
    )
    paths = common.durable(paths, "paths")
    owner = F.min(F.struct("conv_id", "before", (F.col("h1").bitwiseXOR(F.col("x1"))).alias("p1"), (F.col("h2").bitwiseXOR(F.col("x2"))).alias("p2")))
    nodes = common.durable(paths.groupBy(*NODE).agg(owner.alias("o"), F.max("length").alias("longest"), F.count(F.lit(1)).alias("n_convs")).select(*NODE, "o.*", "longest", "n_convs"), "nodes")
    # a conversation's last owned node is its last one
    owned = nodes.groupBy("conv_id").agg(F.min(F.struct("depth", "before")).alias("top"), F.max(F.struct("depth", "longest")).alias("end"))
    owned = owned.select("conv_id", F.col("top.depth").alias("since"), F.col("top.before").alias("outside"), (F.col("end.depth") == F.col("end.longest")).cast("long").alias("leaf"))
    marked = paths.join(owned, "conv_id", "left").withColumn("since", F.coalesce("since", F.col("length") + 1))
    unowned = F.greatest(F.lit(0), F.coalesce("outside", "chars") - F.col("before"))
    child = ((F.col("since") <= F.col("depth") + 1) & (F.col("length") > F.col("depth"))).cast("long")
    sums = marked.groupBy(*NODE).agg(F.sum(unowned).alias("saved_tokens"), F.sum(child).alias("n_children"), F.sum(F.coalesce("leaf", F.lit(0))).alias("n_leaves"))
    # below the first node that a conversation owns, it owns the parent too
    tops = nodes.join(owned.select("conv_id", F.col("since").alias("depth")), ["conv_id", "depth"], "left_semi").where("depth > 0")
    asks = tops.select((F.col("depth") - 1).alias("depth"), F.col("p1").alias("h1"), F.col("p2").alias("h2"), F.col("conv_id").alias("child_id"))
    above = common.join_groups(asks, nodes.select(*NODE, F.col("conv_id").alias("parent"), "n_convs"), NODE, "n_convs", paths.count())
    above = above.select(F.col("child_id").alias("conv_id"), (F.col("depth") + 1).alias("depth"), "parent")
    out = nodes.select(*NODE, "conv_id", "n_convs").join(sums, NODE).join(_ends(paths), NODE, "left").join(above, ["conv_id", "depth"], "left")
    parent = F.when(F.col("depth") > 0, F.coalesce("parent", "conv_id"))
    nothing = hashlib.sha256(b"").hexdigest()
    return out.select("conv_id", F.col("depth").cast("long").alias("depth"), parent.alias("parent_conv_id"), "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(nothing)).alias("ends_sha256"))
