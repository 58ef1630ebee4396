"""Source divergence audit: how far the word use of each source lies from the others of its language.

Every kept term (in at least `least` documents of its language) has a smoothed integer share
p = 1 + floor(SCALE * (count + 2) / (N + 2 V)) in each source and in the language as a whole. Two
shares differ by f = floor((p - q)^2 / (p + q)). Part `pair` sums f over all kept terms for every two
sources; part `term` lists the terms whose share in a source exceeds the language's, by f.

1. Counts. Each task counts the terms of its documents per (language, source) in dictionaries of at
   most ROOM terms; sums combine before the exchange, by (language, source, term), so neither a hot
   source nor a common term is one task.
2. Blocks. Kept terms of a language are dealt over blocks of about TERMS terms by their hash. A block
   lays its counts out as a dense matrix of numpy int64, sources by terms; terms that none of these
   sources uses are alike, so they are one column with a weight.
3. Pairs. A block compares each source with all later ones by broadcasting and returns its part of
   the pair matrix; parts are summed. Sources come in tiles of TILE, so a matrix stays bounded for
   any number of sources; each pair of tiles is a task of its own.
4. Terms. A block returns the best `top` terms of each of its sources; the lists are merged.

All arithmetic is exact in 64 bits while a language has fewer than 9 * 10^15 terms. Null text,
language and source count as ''. Repeated rows count as often as they occur. Sources without terms
take part (all counts 0); a language without kept terms gives pairs of value 0; an empty table gives
nothing. Other columns are not read.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyfold.llm import common

SCALE = 1_000_000_000
LEAST, TOP = 10, 10
#: Different terms that a task counts before it passes its sums on.
ROOM = 400_000
TERMS, TILE = 2048, 256
#: Cells of a broadcast.
CELLS = 1 << 20
#: Letters stay (A-Z lower-cased) and so does everything beyond ASCII; all else separates.
_LETTERS = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
COUNTED = "lang string, source string, term string, n bigint, docs bigint"
PARTS = "lang string, a int, b int, term string, value bigint"


def terms_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(_LETTERS).split()


def count_terms(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """lang, source, term, n (occurrences) and docs (documents that hold it)."""
    rows = docs.select(*[F.coalesce(F.col(c), F.lit("")).alias(n) for c, n in ((lang_col, "lang"), (source_col, "source"), (text_col, "text"))])

    def count(batches):
        times: dict[tuple, Counter] = {}
        held: dict[tuple, Counter] = {}
        for whole in batches:
            for batch in common.slices(whole, 2, 8 << 20, whole.num_rows):
                for lang, source, text in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                    words, key = terms_of(text), (lang, source)
                    if key not in times:
                        times[key], held[key] = Counter(), Counter()
                    times[key].update(words)
                    held[key].update(set(words))
                if sum(map(len, times.values())) > ROOM:
                    yield from passed(times, held)
                    times, held = {}, {}
        yield from passed(times, held)

    def passed(times, held):
        for (lang, source), found in times.items():
            docs = held[lang, source]
            terms = list(found)
            columns = [pa.array([lang] * len(terms), pa.string()), pa.array([source] * len(terms), pa.string()), pa.array(terms, pa.binary()).cast(pa.string()), pa.array(found.values(), pa.int64()), pa.array([docs[t] for t in terms], pa.int64())]
            batch = pa.record_batch(columns, names=["lang", "source", "term", "n", "docs"])
            for at in range(0, batch.num_rows, 50_000):
                yield batch.slice(at, 50_000)

    counted = common.map_arrow(rows, count, COUNTED)
    return counted.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def shares(count: np.ndarray, total: np.ndarray, kept: int) -> np.ndarray:
    """1 + floor(SCALE * (count + 2) / (total + 2 kept)) by long division, three digits at a time."""
    size = total + 2 * kept
    whole, rest = np.divmod(count + 2, size)
    for _ in range(3):
        digit, rest = np.divmod(rest * 1000, size)
        whole = whole * 1000 + digit
    return whole + 1


def distance(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) * (p - q) // (p + q)


def pair_sums(p: np.ndarray, weight: np.ndarray, split: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """i, j and the weighted sum of distances of rows of p: of all i < j if split is 0, else of i
    below split and j from it on."""
    out, step = [], max(1, CELLS // max(1, p.shape[1]))
    for i in range(split or len(p)):
        for at in range(split or i + 1, len(p), step):
            rows = np.arange(at, min(at + step, len(p)))
            out.append((np.full(len(rows), i), rows, distance(p[i][None, :], p[rows]) @ weight))
    return tuple(np.concatenate(c) for c in zip(*out, strict=True)) if out else (np.empty(0, np.int64),) * 3


def _tiles(groups: DataFrame) -> DataFrame:
    """groups with `at`, their number in the language by order of name, from 0."""
    # a language has as many rows here as it has sources
    return groups.withColumn("at", F.row_number().over(Window.partitionBy("lang").orderBy("source")) - 1)


def source_divergence(docs: DataFrame, least: int = LEAST, top: int = TOP, terms: int = TERMS, tile: int = TILE) -> DataFrame:
    """lang, source, part, item, value and rank."""
    counted = common.durable(count_terms(docs), "term-counts")
    wide = counted.groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.sum("n").alias("all")).where(F.col("docs") >= least).select("lang", "term", "all")
    vocabulary = common.durable(wide, "vocabulary")
    langs = docs.select(F.coalesce("lang", F.lit("")).alias("lang"), F.coalesce("source", F.lit("")).alias("source")).distinct()
    kept = vocabulary.groupBy("lang").agg(F.count(F.lit(1)).alias("kept"), F.sum("all").alias("total"))
    # both sides have at most one row per (language, source, term)
    used = counted.join(vocabulary, ["lang", "term"]).select("lang", "source", "term", "n", "all")
    used = common.durable(used, "kept-counts")
    sizes = used.groupBy("lang", "source").agg(F.sum("n").alias("size"))
    groups = common.durable(_tiles(langs.join(sizes, ["lang", "source"], "left").select("lang", "source", F.coalesce("size", F.lit(0)).alias("size"))), "sources")
    heads = groups.groupBy("lang").agg(F.max("at").alias("last")).join(kept, "lang", "left").select(
        "lang", F.floor(F.col("last") / tile).cast("int").alias("last"), F.coalesce("kept", F.lit(0)).alias("kept"), F.coalesce("total", F.lit(0)).alias("total"),
        F.greatest(F.lit(1), F.ceil(F.coalesce("kept", F.lit(0)) / terms)).cast("int").alias("blocks"),
    )
    heads = common.durable(heads, "languages")
    block = F.pmod(F.xxhash64("term"), F.col("blocks")).cast("int")
    # every block of a language meets every pair of its tiles (one pair up to `tile` sources)
    inside = vocabulary.join(heads.select("lang", "blocks"), "lang").groupBy("lang", block.alias("block")).agg(F.count(F.lit(1)).alias("inside"))
    plans = heads.withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).join(inside, ["lang", "block"], "left").fillna(0, ["inside"])
    pairs = plans.withColumn("x", F.explode(F.sequence(F.lit(0), F.col("last")))).withColumn("y", F.explode(F.sequence("x", "last")))
    own = groups.groupBy("lang", F.floor(F.col("at") / tile).cast("int").alias("t")).agg(F.array_sort(F.collect_list(F.struct("at", "size"))).alias("members"))
    left, right = own.select("lang", F.col("t").alias("x"), F.col("members").alias("m")), own.select("lang", F.col("t").alias("y"), F.col("members").alias("w"))
    tasks = pairs.join(left, ["lang", "x"]).join(right, ["lang", "y"]).select("lang", "block", "x", "y", "kept", "total", "inside", F.col("m.at").alias("m_at"), F.col("m.size").alias("m_size"), F.col("w.at").alias("w_at"), F.col("w.size").alias("w_size"))
    placed = used.join(groups.select("lang", "source", "at"), ["lang", "source"]).join(heads.select("lang", "blocks", "last"), "lang")
    mine = F.floor(F.col("at") / tile).cast("int")
    placed = placed.select("lang", block.alias("block"), "term", "n", "all", "at", mine.alias("t"), F.explode(F.sequence(F.lit(0), F.col("last"))).alias("other"))
    cells = placed.select("lang", "block", F.least("t", "other").alias("x"), F.greatest("t", "other").alias("y"), "term", "n", "all", "at")

    def compare(cell: pa.Table, task: pa.Table) -> pa.Table:
        head = {c: task.column(c)[0].as_py() for c in task.column_names}
        at, size = [np.array(head["m" + c] + ([] if head["x"] == head["y"] else head["w" + c]), np.int64) for c in ("_at", "_size")]
        split = 0 if head["x"] == head["y"] else len(head["m_at"])
        cell = cell.sort_by("term")
        words = cell.column("term").combine_chunks().dictionary_encode() if cell.num_rows else pa.array([], pa.string()).dictionary_encode()
        column, names = words.indices.to_numpy(), words.dictionary.to_pylist()
        count = np.zeros((len(at), len(names) + 1), np.int64)
        row = np.searchsorted(at, cell.column("at").to_numpy())
        count[row, column] = cell.column("n").to_numpy()
        weight = np.ones(len(names) + 1, np.int64)
        # the last column stands for the block's terms that none of these sources uses
        weight[-1] = head["inside"] - len(names)
        parts = [pa.table({c: pa.array([], t) for c, t in (("a", pa.int32()), ("b", pa.int32()), ("term", pa.string()), ("value", pa.int64()))})]
        p = shares(count, size[:, None], head["kept"]) if head["kept"] else np.ones_like(count)
        i, j, value = pair_sums(p, weight, split)
        parts.append(pa.table({"a": pa.array(at[i], pa.int32()), "b": pa.array(at[j], pa.int32()), "term": pa.nulls(len(i), pa.string()), "value": pa.array(value, pa.int64())}))
        if split == 0 and names:
            everywhere = np.zeros(len(names), np.int64)
            everywhere[column] = cell.column("all").to_numpy()
            q = shares(everywhere, np.int64(head["total"]), head["kept"])
            for g in range(len(at)):
                # names are in order, and a stable sort keeps it among equals
                over = np.flatnonzero((count[g, :-1] > 0) & (p[g, :-1] > q))
                value = distance(p[g, over], q[over])
                best = np.argsort(-value, kind="stable")[:top]
                parts.append(pa.table({"a": pa.array(np.full(len(best), at[g]), pa.int32()), "b": pa.nulls(len(best), pa.int32()), "term": pa.array([names[over[k]] for k in best], pa.string()), "value": pa.array(value[best], pa.int64())}))
        out = pa.concat_tables(parts)
        return out.add_column(0, "lang", pa.array([head["lang"]] * out.num_rows, pa.string()))

    common.ship(docs.sparkSession)
    keys = ["lang", "block", "x", "y"]
    found = common.durable(cells.groupBy(*keys).cogroup(tasks.groupBy(*keys)).applyInArrow(compare, PARTS), "divergence")
    name = lambda at, out: groups.select("lang", F.col("at").alias(at), F.col("source").alias(out))
    summed = found.where("term is null").groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))
    both = summed.unionByName(summed.select("lang", F.col("b").alias("a"), F.col("a").alias("b"), "value"))
    pair = both.join(name("b", "item"), ["lang", "b"]).select("lang", "a", F.lit("pair").alias("part"), "item", "value")
    term = found.where("term is not null").select("lang", "a", F.lit("term").alias("part"), F.col("term").alias("item"), "value")
    order = Window.partitionBy("lang", "a", "part").orderBy(F.desc("value"), "item")
    # the limit prunes each task's lists before the exchange
    ranked = pair.withColumn("rank", F.row_number().over(order)).unionByName(term.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top))
    return ranked.join(name("a", "source"), ["lang", "a"]).select("lang", "source", "part", "item", "value", "rank")
