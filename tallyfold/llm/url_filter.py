"""URL filters: captures against a dated block list, as of their fetch time.

List rows (host, listed_at, active) say that from listed_at on a host and everything below it is
blocked (active) or free again. Per host they become half-open validity intervals, which do not
overlap: of rows with equal host and time the active one counts, and a row ends when the next one
starts. Every capture is looked up under its host and each parent domain, as of its fetch time,
except under names of more labels than any name of the list, which cannot be listed; the longest
listed name decides, so a freed subdomain of a blocked domain is free.

The join is an equi-join on the name with the interval as a second condition, on the list's side
one row per entry. A list below BROADCAST_ROWS rows (it is counted) is broadcast; a longer one is
shuffled, with captures collapsed to one row per (name, fetch time) first, so a host that holds a
third of all captures does not land in one task. Null or unparsable URLs and null fetch times match
nothing and are kept; null list hosts or dates are ignored; repeated rows are judged alike; an
empty list blocks nothing. Native functions throughout.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BROADCAST_ROWS = 100_000


def host_of(url: Column) -> Column:
    """Lower-cased host without user, port and final dot; null if there is none."""
    host = F.regexp_extract(F.lower(F.trim(url)), r"^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:@]+)", 1)
    host = F.rtrim(host, F.lit("."))
    return F.when(host != "", host)


def names_of(host: Column, longest: int) -> Column:
    """The host and its parent domains of at most `longest` labels, longest first."""
    labels = F.split(host, r"\.")
    first = F.greatest(F.lit(1), F.size(labels) - longest + 1)
    return F.transform(F.sequence(first, F.size(labels)), lambda k: F.array_join(F.slice(labels, k, F.size(labels)), "."))


def intervals(entries: DataFrame) -> DataFrame:
    """name, valid_from, valid_to (null: open), active; one row per entry that counts."""
    rows = entries.where("host is not null and listed_at is not null").groupBy(F.lower("host").alias("name"), F.col("listed_at").alias("valid_from")).agg(F.max(F.coalesce("active", F.lit(False))).alias("active"))
    order = Window.partitionBy("name").orderBy("valid_from")
    return rows.withColumn("valid_to", F.lead("valid_from").over(order)).select("name", "valid_from", "valid_to", "active")


def filter_urls(captures: DataFrame, entries: DataFrame, id_col: str = "page_id", url_col: str = "url", time_col: str = "fetched_at") -> DataFrame:
    """id, host, matched (the deciding name or null), listed_since and blocked for every capture."""
    listed = intervals(entries)
    small = entries.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    longest = entries.agg(F.max(F.when(F.col("host").isNotNull(), F.size(F.split("host", r"\."))))).first()[0] or 1
    rows = captures.select(F.col(id_col), host_of(F.col(url_col)).alias("host"), F.col(time_col).alias("at"))
    looked = rows.where("host is not null and at is not null").select("host", "at").distinct()
    names = looked.select("host", "at", F.posexplode(names_of(F.col("host"), longest)).alias("depth", "name"))
    if small:
        listed = F.broadcast(listed)
    hits = names.join(listed, (names["name"] == listed["name"]) & (F.col("valid_from") <= F.col("at")) & (F.col("valid_to").isNull() | (F.col("at") < F.col("valid_to")))).select("host", "at", "depth", names["name"], "valid_from", "active")
    best = hits.groupBy("host", "at").agg(F.min(F.struct("depth", "name", "valid_from", "active")).alias("b"))
    verdicts = best.select("host", "at", F.col("b.name").alias("matched"), F.col("b.valid_from").alias("listed_since"), F.col("b.active").alias("blocked"))
    return rows.join(verdicts, ["host", "at"], "left").select(id_col, "host", "matched", "listed_since", F.coalesce("blocked", F.lit(False)).alias("blocked"))
