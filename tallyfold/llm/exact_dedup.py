"""Exact dedup: groups by a 128-bit content hash, with the bytes compared inside each group.

Rows are equal when their texts are identical once white space (space, tab to carriage return)
is deleted; a null text counts as empty. Of equal rows the one with the most code points in its
original text stays, then the one with the smallest id (a null id comes last). Repeated rows are
members like any other; rows that share both the text's length and the id of the one that stays can't
be told apart and all stay. An empty table gives an empty result. Other columns, of any name, are
neither read nor returned.

The plan has one shuffle that moves texts. Spark's own partial aggregation collapses the copies
in each input split first, so a group that holds a third of all rows costs one row per split.
The way back to the rows is a join of their digests with the groups; the few groups that hold
more than one row in common.HOT_KEYS are broadcast there. Native: DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyfold.llm import common

#: The characters that comparison ignores.
SPACES = " \t\n\x0b\x0c\r"
_WIDE = "decimal(38,0)"
_TOP = "9223372036854775808"
_STEP = "100000000000000000000"


def _normalised(text: Column) -> Column:
    return F.translate(F.coalesce(text, F.lit("")), SPACES, "")


def content_hash(normalised: Column) -> Column:
    """The 128-bit hash as 16 bytes."""
    return F.unhex(F.md5(normalised))


def _rank(chars: Column, doc_id: Column) -> Column:
    """One number that is largest for the row that stays; a null id comes last."""
    back = F.coalesce(F.lit(_TOP).cast(_WIDE) - doc_id.cast("decimal(20,0)"), F.lit(0).cast(_WIDE))
    return (chars.cast("decimal(12,0)") * F.lit(_STEP).cast("decimal(21,0)") + back).cast(_WIDE)


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", hashed=content_hash) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 for every row of docs.

    `hashed` maps the normalised text to the grouping hash; tests pass a poor one to see that
    collisions never merge two texts.
    """
    rows = docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        F.char_length(F.coalesce(F.col(text_col), F.lit(""))).alias("chars"),
        _normalised(F.col(text_col)).alias("content"),
    ).withColumns({"h": hashed(F.col("content")), "text_sha256": F.sha2(F.col("content"), 256)})
    texts = rows.groupBy("h", "text_sha256", "content").agg(
        F.count(F.lit(1)).alias("n"), F.max(_rank(F.col("chars"), F.col("doc_id"))).alias("best")
    )
    groups = texts.groupBy("h", "text_sha256").agg(
        F.sum("n").alias("group_size"), F.max("best").alias("best"), F.count(F.lit(1)).alias("texts")
    )
    back = F.col("best") % F.lit(_STEP).cast("decimal(21,0)")
    groups = groups.select(
        "h",
        "text_sha256",
        F.when(F.col("texts") > 1, F.raise_error(F.lit("two texts share both digests"))).otherwise(F.col("group_size")).cast("long").alias("group_size"),
        F.when(back > 0, F.lit(_TOP).cast(_WIDE) - back).cast("long").alias("keep_id"),
        F.floor(F.col("best") / F.lit(_STEP).cast("decimal(21,0)")).cast("long").alias("keep_chars"),
    )
    members = common.durable(rows.select("doc_id", "chars", "h", "text_sha256"), "digests")
    joined = common.join_groups(members, common.durable(groups, "copies"), ["h", "text_sha256"], "group_size", members.count())
    kept = F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("chars") == F.col("keep_chars"))
    return joined.select("doc_id", "keep_id", "group_size", kept.alias("kept"), "text_sha256")


def drop_exact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs that stay, with all their columns. Ids must be unique."""
    return common.without(docs, exact_dedup(docs, id_col, text_col).where("not kept").select("doc_id"), id_col)
