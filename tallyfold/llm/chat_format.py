"""Preference formatting: chosen and rejected conversations share one prompt.

For each pair of conversations the longest common prefix of turns is rendered once as the prompt;
what follows is rendered as the two completions (empty for a conversation that is the whole
prefix). Masks are the character spans (start, end exclusive) of assistant text and its end mark in
each completion, that is, what a loss is taken on.

Two builders make pairs. `opening_pairs`: conversations whose first turns are equal answer the same
opening; in order of id each two neighbours form one pair, so a group of n gives n // 2 pairs and
never all of them (the last of an odd group has no partner); the one with more assistant text is
chosen (ties: the smaller id). A hot opening is numbered in two steps, ranks inside blocks of BLOCK
neighbouring ids and running sums of the blocks' sizes, so no task holds the group.
`swapped_pairs`, for tables without alternatives: every conversation with an assistant turn is
chosen over itself with its last assistant turn replaced by that of its neighbour (the id that
differs in the lowest bit), or removed if there is no such neighbour or reply; later turns go with
the swapped one.

Rows with a null conversation id are left out; null roles and texts count as empty; of repeated
(id, turn) rows the smallest (role, text) counts; turns are ordered by number, nulls first; an
empty table gives no pairs; other columns are not read. Native functions throughout.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BLOCK = 4096
START, MIDDLE, END = "<|im_start|>", "\n", "<|im_end|>\n"


def conversations_of(turns: DataFrame) -> DataFrame:
    """conv_id and turns (array of role, text) in order."""
    one = turns.where("conv_id is not null").groupBy("conv_id", "turn").agg(F.min(F.struct(F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))).alias("t"))
    listed = one.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct(F.coalesce("turn", F.lit(-(1 << 62))).alias("turn"), F.col("t.role").alias("role"), F.col("t.text").alias("text")))).alias("all"))
    return listed.select("conv_id", F.transform("all", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))).alias("turns"))


def paired_ids(convs: DataFrame, block: int = BLOCK) -> DataFrame:
    """conv_id, opening, pair, side (0 or 1): the neighbours of each opening."""
    first = F.col("turns")[0]
    heads = convs.select("conv_id", F.xxhash64(first["role"], first["text"], F.md5(first["text"])).alias("opening"), F.floor(F.col("conv_id") / block).alias("block"))
    inside = Window.partitionBy("opening", "block").orderBy("conv_id")
    sizes = heads.groupBy("opening", "block").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("opening").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("opening", "block", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    ranked = heads.withColumn("r", F.row_number().over(inside) - 1).join(offsets, ["opening", "block"])
    rank = F.col("r") + F.col("offset")
    return ranked.select("conv_id", "opening", F.floor(rank / 2).alias("pair"), (rank % 2).cast("int").alias("side"))


def _assistant_chars(turns: Column) -> Column:
    return F.aggregate(turns, F.lit(0), lambda n, t: n + F.when(t["role"] == "assistant", F.char_length(t["text"])).otherwise(0))


def rendered(turns: Column) -> Column:
    """Struct of the text of the turns and the spans of assistant text in it. The text is joined at
    once and the fold carries numbers only, so long conversations are not copied turn by turn."""
    head = lambda t: F.concat(F.lit(START), F.coalesce(t["role"], F.lit("")), F.lit(MIDDLE))
    body = lambda t: F.concat(F.coalesce(t["text"], F.lit("")), F.lit(END))
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<s:int,e:int>>").alias("mask"))

    def step(acc: Column, t: Column) -> Column:
        s = acc["at"] + F.char_length(head(t))
        e = s + F.char_length(body(t))
        span = F.array(F.struct(s.alias("s"), e.alias("e")))
        return F.struct(e.alias("at"), F.when(t["role"] == "assistant", F.concat(acc["mask"], span)).otherwise(acc["mask"]).alias("mask"))

    text = F.array_join(F.transform(turns, lambda t: F.concat(head(t), body(t))), "")
    return F.struct(text.alias("text"), F.aggregate(turns, start, step, lambda acc: acc["mask"]).alias("mask"))


def common_turns(a: Column, b: Column) -> Column:
    """Number of leading turns that both conversations share."""
    upto = F.least(F.size(a), F.size(b))
    same = F.zip_with(F.slice(a, 1, upto), F.slice(b, 1, upto), lambda x, y: (x["role"] == y["role"]) & (x["text"] == y["text"]))
    unlike = F.array_position(same, False)
    return F.when(unlike == 0, upto).otherwise((unlike - 1).cast("int"))


def opening_pairs(convs: DataFrame, block: int = BLOCK) -> DataFrame:
    """chosen_id, rejected_id, chosen and rejected (turns) for neighbours with equal first turns."""
    members = paired_ids(convs, block).join(convs, "conv_id")
    entry = F.struct((-_assistant_chars(F.col("turns"))).alias("less"), F.col("conv_id"), F.col("turns"))
    # a pair has two members at most, so this list is bounded
    both = members.groupBy("opening", "pair").agg(F.array_sort(F.collect_list(entry)).alias("m")).where(F.size("m") == 2)
    return both.select(F.col("m")[0]["conv_id"].alias("chosen_id"), F.col("m")[1]["conv_id"].alias("rejected_id"), F.col("m")[0]["turns"].alias("chosen"), F.col("m")[1]["turns"].alias("rejected"))


def swapped_pairs(convs: DataFrame) -> DataFrame:
    """chosen_id, rejected_id, chosen and rejected (turns): last replies traded between neighbours."""
    place = F.size("turns") - F.array_position(F.reverse(F.transform("turns", lambda t: t["role"] == "assistant")), True) + 1
    replied = convs.where(F.exists("turns", lambda t: t["role"] == "assistant")).withColumn("at", place.cast("int"))
    replies = replied.select(F.col("conv_id").bitwiseXOR(F.lit(1).cast("long")).alias("conv_id"), F.col("conv_id").alias("rejected_id"), F.col("turns")[F.col("at") - 1].alias("reply"))
    traded = replied.join(replies, "conv_id", "left")
    lead = F.slice(F.col("turns"), 1, F.col("at") - 1)
    return traded.select(
        F.col("conv_id").alias("chosen_id"), "rejected_id", F.col("turns").alias("chosen"),
        F.when(F.col("rejected_id").isNull(), lead).otherwise(F.concat(lead, F.array("reply"))).alias("rejected"),
    )


def preference_format(pairs: DataFrame) -> DataFrame:
    """chosen_id, rejected_id, n_shared, prompt, chosen, rejected, chosen_mask, rejected_mask."""
    both = pairs.select("chosen_id", "rejected_id", F.col("chosen").alias("c"), F.col("rejected").alias("r"), common_turns(F.col("chosen"), F.col("rejected")).alias("n_shared"))
    rest = lambda side: F.slice(F.col(side), F.col("n_shared") + 1, F.greatest(F.lit(0), F.size(side) - F.col("n_shared")))
    # explode() of one struct is a barrier: each text is rendered once
    out = both.select("chosen_id", "rejected_id", "n_shared", F.explode(F.array(F.struct(rendered(F.slice(F.col("c"), 1, F.col("n_shared"))).alias("p"), rendered(rest("c")).alias("c"), rendered(rest("r")).alias("r")))).alias("x"))
    spans = lambda c: F.array_join(F.transform(c, lambda x: F.concat_ws(":", x["s"].cast("string"), x["e"].cast("string"))), ",")
    return out.select(
        "chosen_id", "rejected_id", "n_shared", F.col("x.p.text").alias("prompt"), F.col("x.c.text").alias("chosen"), F.col("x.r.text").alias("rejected"),
        spans(F.col("x.c.mask")).alias("chosen_mask"), spans(F.col("x.r.mask")).alias("rejected_mask"),
    )
