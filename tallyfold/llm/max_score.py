"""Exact top-k search by inner product with MaxScore.

A component x becomes floor(1024 * x). A dimension and a sign make a term; a vector's posting under
it is the size of that component. For a query, the term of each of its own signed components is a
query term: entries on the other side of zero only lose score. The score bound of a query term is
its weight times the largest posting of its list.

Entries are dealt over shards of about SHARD bytes by a hash. In a shard, a query's terms are sorted
by bound. Those whose bounds together stay under the query's threshold are non-essential: an entry
that is on none of the essential lists cannot reach the threshold. The essential lists are
traversed and their postings summed; entries whose sum plus all other bounds falls short go. The
losses of the rest on essential dimensions are taken off, and non-essential dimensions are then
probed one by one, largest bound first, while an entry's sum plus the bounds not yet probed is
competitive. Survivors have their exact score. If the threshold is not positive, entries on no list
may qualify, and all are scored. A query whose bounds all together fall short skips the shard.

The first threshold of a query is its k-th best score among at most SEEDS entries (drawn by a hash
of id and vector; a documented bound on what is sent along): it decides what is skipped and never
what is found. Only entries below it are left out, so ties stay. Shards return their best k, and
those are merged. Entries move once; queries go to every shard and stream by its entries.

Sums are taken in doubles while no sum can reach 2**53, else in whole numbers of any size; a score
beyond 64 bits is given as the nearest that fits. Vectors are padded with zeros to equal length, so
shorter and empty ones take part. Vectors that are null or hold null or non-finite components take
no part, nor do rows without an id. Rows of equal id are entries of their own, and none is a
candidate of that id; if a query id has several vectors, the smallest (component by component) asks.
Fewer than k candidates are all returned; an empty table gives an empty result; other columns are
not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyfold.llm import common

SCALE = 1024
#: Bytes of a shard, entries that give first thresholds and their bytes, queries at a time.
SHARD, SEEDS, SEED_BYTES, QUERIES = 4 << 20, 4096, 8 << 20, 1024
FOUND = "query_id bigint, vec_id bigint, score bigint"
_NONE = -np.inf


def whole_numbers(rows: list[bytes], width: int) -> np.ndarray:
    """floor(SCALE * x) of vectors packed as doubles, padded to width; object integers if doubles
    can't hold them."""
    out = np.zeros((len(rows), width))
    for i, row in enumerate(rows):
        out[i, : len(row) // 8] = np.frombuffer(row)
    with np.errstate(over="ignore"):
        scaled = np.floor(out * SCALE)
    if np.isfinite(scaled).all():
        return scaled
    exact = np.where(np.isfinite(scaled), scaled, 0).astype(object)
    for i, j in zip(*np.nonzero(~np.isfinite(scaled)), strict=True):
        exact[i, j] = int(out[i, j]) * SCALE
    return exact


def _plain(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Both as doubles if every inner product of theirs is exact in doubles, else as integers."""
    width = max(1, a.shape[1])
    top = [max((abs(int(x)) for x in (m.max(), m.min())), default=0) if m.size else 0 for m in (a, b)]
    if top[0] * top[1] * width < 1 << 53:
        return a.astype(float), b.astype(float)
    integers = lambda m: np.frompyfunc(int, 1, 1)(m).astype(object)
    return integers(a), integers(b)


class Postings:
    """Lists of rows and sizes by dimension and sign (0 below zero, 1 above), and the rows themselves."""

    def __init__(self, values: np.ndarray):
        self.values = values
        self.lists = [[(r := np.flatnonzero(column < 0), -column[r]), (r := np.flatnonzero(column > 0), column[r])] for column in values.T]
        self.largest = np.array([[max(sizes, default=0) if values.dtype == object else sizes.max(initial=0) for _, sizes in pair] for pair in self.lists], dtype=values.dtype).reshape(-1, 2)

    def bounds(self, queries: np.ndarray) -> np.ndarray:
        """Largest gain of each query on each dimension."""
        return np.where(queries > 0, queries * self.largest[:, 1], -queries * self.largest[:, 0])

    def search(self, query: np.ndarray, bound: np.ndarray, least, skip: slice) -> tuple[np.ndarray, np.ndarray]:
        """Rows (except those in skip) and exact scores of all entries that reach `least`."""
        order = np.argsort(bound, kind="stable")
        upto = np.cumsum(bound[order])
        # non-essential: the longest run of small bounds whose sum stays under the threshold
        spare = int(np.searchsorted(upto, least, side="left")) if least > 0 else 0
        small, essential = order[:spare], order[spare:][::-1]
        essential = essential[query[essential] != 0]
        total = np.zeros(len(self.values), self.values.dtype)
        met = np.full(len(self.values), least <= 0)
        for d in essential:
            rows, sizes = self.lists[d][int(query[d] > 0)]
            met[rows] = True
            total[rows] += abs(query[d]) * sizes
        met[skip] = False
        left = upto[spare - 1] if spare else 0
        rows = np.flatnonzero(met)
        rows = rows[total[rows] + left >= least]
        for d in essential:
            gain = query[d] * self.values[rows, d]
            total[rows] += np.where(gain < 0, gain, 0)
            rows = rows[total[rows] + left >= least]
        for d in small[::-1]:
            left = left - bound[d]
            total[rows] += query[d] * self.values[rows, d]
            rows = rows[total[rows] + left >= least]
        return rows, total[rows]


def clipped(scores: np.ndarray) -> np.ndarray:
    """Scores as 64-bit integers, the nearest that fit."""
    if scores.dtype != object:
        return scores.astype(np.int64)
    return np.array([max(-(1 << 63), min((1 << 63) - 1, s)) for s in scores], np.int64)


def _below(score) -> float:
    """A double that is no larger than the score, nor than any score that is clipped."""
    return float(score) if abs(score) <= 1 << 53 else float(np.nextafter(float(max(-(1 << 1000), min(1 << 62, score))), -np.inf))


class Shard:
    """Entries with their postings, as doubles or (where doubles are too short) as integers."""

    def __init__(self, ids: np.ndarray, values: np.ndarray):
        order = np.argsort(ids, kind="stable")
        self.ids, self.values = ids[order], values[order]
        self.postings: dict[bool, Postings] = {}

    def answers(self, names: np.ndarray, queries: np.ndarray, least: np.ndarray, k: int) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """query id, entry ids and scores of the best k entries of each query that reaches its threshold."""
        values, queries = _plain(self.values, queries)
        wide = values.dtype == object
        if wide not in self.postings:
            self.postings[wide] = Postings(values)
        lists = self.postings[wide]
        if wide:
            # no inner product of doubles is lower than this
            least = np.array([int(x) if np.isfinite(x) else -(1 << 4096) for x in least], dtype=object)
        bound, out = lists.bounds(queries), []
        for i in np.flatnonzero(bound.sum(axis=1) >= least):
            own = slice(*np.searchsorted(self.ids, [names[i], names[i] + 1]))
            rows, scores = lists.search(queries[i], bound[i], least[i], own)
            scores = clipped(scores)
            # rows are in order of id, and a stable sort keeps it among equals
            first = np.argsort(~scores, kind="stable")[:k]
            out.append((np.full(len(first), names[i]), self.ids[rows[first]], scores[first]))
        return out


def _found(answers: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> pa.RecordBatch:
    columns = [np.concatenate(c) for c in zip(*answers, strict=True)] if answers else [np.empty(0, np.int64)] * 3
    return pa.record_batch([pa.array(c, pa.int64()) for c in columns], names=["query_id", "vec_id", "score"])


def top_products(vectors: DataFrame, is_query, k: int = 10, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id and score of the k entries of highest inner product with each query."""
    spark = vectors.sparkSession
    raw = F.transform(F.col(vector_col), lambda x: x.cast("double"))
    bad = F.exists("raw", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), raw.alias("raw")).where("vec_id is not null and raw is not null").where(~bad)

    def to_bytes(batches):
        for batch in batches:
            values = [np.asarray(x, np.float64).tobytes() for x in batch.column(1).to_pylist()]
            yield pa.record_batch([batch.column(0), pa.array(values, pa.binary())], names=["vec_id", "v"])

    packed = common.durable(common.map_arrow(rows, to_bytes, "vec_id bigint, v binary"), "vectors")
    count, size = packed.agg(F.count(F.lit(1)), F.max(F.octet_length("v"))).first()
    if not count:
        return spark.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score bigint")
    width, shards = size // 8, max(1, -(-(count * size) // SHARD))
    share = min(SEEDS, max(2 * k, SEED_BYTES // max(1, size))) / count
    place = F.shiftrightunsigned(F.xxhash64("vec_id", "v"), 11) / float(1 << 53)
    drawn = packed.where(place < share).limit(2 * SEEDS).collect()
    seed_ids, seeds = np.array([r["vec_id"] for r in drawn], np.int64), [bytes(r["v"]) for r in drawn]

    def first_thresholds(batches):
        seeded = whole_numbers(seeds, width)
        for whole in batches:
            for batch in common.slices(whole, 1, 1 << 20, QUERIES):
                ids, data = np.asarray(batch.column(0)), batch.column(1).to_pylist()
                least = np.full(len(ids), _NONE)
                if len(seeds) > k:
                    a, b = _plain(whole_numbers(data, width), seeded)
                    for row, scores in enumerate(a @ b.T):
                        others = np.sort(scores[seed_ids != ids[row]])
                        if len(others) >= k:
                            least[row] = _below(others[-k])
                yield pa.record_batch([batch.column(0), batch.column(1), pa.array(least, pa.float64())], names=["vec_id", "v", "least"])

    single = rows.where(is_query(F.col("vec_id"))).groupBy("vec_id").agg(F.min("raw").alias("raw"))
    asked = common.durable(common.map_arrow(common.map_arrow(single, to_bytes, "vec_id bigint, v binary"), first_thresholds, "vec_id bigint, v binary, least double"), "queries")
    entries = packed.select(F.pmod(F.xxhash64("vec_id", "v"), F.lit(shards)).cast("int").alias("shard"), F.lit(0).alias("side"), "vec_id", "v", F.lit(0.0).alias("least"))
    probes = asked.select(F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"), F.lit(1).alias("side"), "vec_id", "v", "least")

    def search(batches):
        ids, data, shard = [], [], None
        for whole in batches:
            side = np.asarray(whole.column(1))
            split = int(np.searchsorted(side, 1))
            ids += whole.column(2)[:split].to_pylist()
            data += whole.column(3)[:split].to_pylist()
            if split < whole.num_rows:
                if shard is None:
                    shard = Shard(np.array(ids, np.int64), whole_numbers(data, width))
                    data = []
                for batch in common.slices(whole.slice(split), 3, 1 << 20, QUERIES):
                    yield _found(shard.answers(np.asarray(batch.column(2)), whole_numbers(batch.column(3).to_pylist(), width), np.asarray(batch.column(4)), k))

    # one shard is one task: its entries come first, then queries stream by
    met = entries.unionByName(probes).repartitionById(shards, "shard").sortWithinPartitions("side")
    found = common.map_arrow(met, search, FOUND)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
