"""Approximate nearest neighbours by an inverted multi-index.

Vectors are scaled to length 1 and cut into two halves; each half has its own codebook, and a
vector's cell is the pair of its nearest centroids. A codebook has four times the fourth root of the
number of vectors, so there are 16 times as many cells as its square root. A query walks the pairs in order of
summed distance, with a heap over the two sorted lists of distances, until the cells it has met
hold a given share of the distinct vectors; all entries of those cells are reranked by the exact
cosine of the original vectors in double precision. Before squaring, a vector is scaled by the power
of two of its largest component, which rounds nothing, so no finite vector is too long or too short.

The codebooks come from at most about SAMPLE vectors (drawn by a hash of the id, a documented
bound), and so does the share: the smallest on a ladder whose recall on that whole sample, against
brute force and over TRIAL_QUERIES of its distinct vectors drawn at random, is at least AIM. Cells are weighed by distinct vectors, so that many copies of one vector do
not use up a query's share. Every vector is indexed.

Reranking runs in blocks of about BLOCK bytes of entries. A block holds the cells of neighbouring
centroids of the first half (a centroid with more entries is split by a hash), and a query goes to
the blocks of the cells it walks, with its cells there: entries move once, queries once per block. A
block is one task: it takes its entries first and queries then stream by. It multiplies matrices and
returns the best few of each query, so pairs are never rows and no list of queries has to fit in a
task. Equal scores are decided by the smaller id.

Vectors that are null, zero, of another length than the first sampled one, or that hold null or
non-finite components take no part, nor do rows without an id. Rows of equal id are separate
entries, and none of them is a candidate of its own id. A query id asks once, however many rows it
has: if they differ, the smallest vector (component by component) asks. Fewer than k candidates are
all returned; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyfold.llm import common

SAMPLE = 20_000
#: Sampled vectors that are looked up to choose the share.
TRIAL_QUERIES = 256
AIM = 0.95
LADDER = (0.02, 0.05, 0.1, 0.15, 0.2, 0.3, 0.4, 0.5, 0.6, 0.75, 1.0)
#: Bytes of a block's entries, and queries in one product.
BLOCK, QUERIES = 4 << 20, 1024
#: Bytes of the copies of queries that a probing task hands over at once.
PROBES = 8 << 20
FOUND = "query_id bigint, vec_id bigint, score double"


def _sampled(vectors: DataFrame, total: int, size: int) -> np.ndarray:
    share = min(1.0, size / max(1, total))
    place = F.shiftrightunsigned(F.xxhash64("vec_id", F.lit(7)), 11) / float(1 << 53)
    rows = vectors.where(place < share).select("vec_id", "v").collect()
    rows.sort(key=lambda r: (r["vec_id"], bytes(r["v"])))
    if not rows:
        return np.empty((0, 0))
    size = len(rows[0]["v"])
    return np.frombuffer(b"".join(bytes(r["v"]) for r in rows if len(r["v"]) == size)).reshape(-1, size // 8)


def _scaled(x: np.ndarray) -> np.ndarray:
    """Rows times a power of two that brings their largest component to between 1/2 and 1."""
    _, exponent = np.frexp(np.abs(x).max(axis=1, keepdims=True))
    # two steps, for a single one could leave the range of doubles
    return np.ldexp(np.ldexp(x, -(exponent // 2)), exponent // 2 - exponent)


def _unit(x: np.ndarray) -> np.ndarray:
    x = _scaled(x)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def centroids(vectors: int) -> int:
    """Centroids of each half for so many vectors."""
    return max(16, round(4 * vectors**0.25))


def _nearest(points: np.ndarray, book: np.ndarray) -> np.ndarray:
    return ((book * book).sum(axis=1) - 2.0 * points @ book.T).argmin(axis=1)


def codebook(points: np.ndarray, k: int, rounds: int = 12, seed: int = 5) -> np.ndarray:
    """Lloyd's algorithm from k distinct points drawn at random."""
    points = np.unique(points, axis=0)
    book = points[np.random.default_rng(seed).permutation(len(points))[:k]].copy()
    for _ in range(rounds):
        own = _nearest(points, book)
        count = np.bincount(own, minlength=len(book))
        total = np.zeros_like(book)
        np.add.at(total, own, points)
        book[count > 0] = total[count > 0] / count[count > 0, None]
    return book


class MultiIndex:
    """Codebooks, and the walk over cells for a query."""

    def __init__(self, sample: np.ndarray, size: int = 64):
        unit = _unit(sample)
        self.half = max(1, unit.shape[1] // 2)
        self.width = unit.shape[1]
        self.books = [codebook(part, size) for part in (unit[:, : self.half], unit[:, self.half :])]
        # neighbours in this order are alike: along the longest axis of the first half
        axis = np.linalg.svd(self.books[0] - self.books[0].mean(axis=0), full_matrices=False)[2][0]
        self.books[0] = self.books[0][np.argsort(self.books[0] @ axis, kind="stable")]
        if self.width == 1:
            self.books[1] = np.zeros((1, 0))

    def cells(self, unit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return _nearest(unit[:, : self.half], self.books[0]), _nearest(unit[:, self.half :], self.books[1])

    def walk(self, unit: np.ndarray, weight: np.ndarray, enough: float) -> np.ndarray:
        """Boolean matrix of the cells met before their weights reach `enough`."""
        far = [((book - part) ** 2).sum(axis=1) for book, part in zip(self.books, (unit[: self.half], unit[self.half :]), strict=True)]
        order = [np.argsort(d, kind="stable") for d in far]
        a, b = (d[o].tolist() for d, o in zip(far, order, strict=True))
        met = np.zeros(weight.shape, bool)
        held = weight[order[0]][:, order[1]].tolist()
        heap, total, seen = [(a[0] + b[0], 0, 0)], 0.0, []
        while heap and total < enough:
            _, i, j = heapq.heappop(heap)
            total += held[i][j]
            seen.append((i, j))
            # each pair has one parent: the one above it in its row, or to its left in the first column
            if j + 1 < len(b):
                heapq.heappush(heap, (a[i] + b[j + 1], i, j + 1))
            if j == 0 and i + 1 < len(a):
                heapq.heappush(heap, (a[i + 1] + b[0], i + 1, 0))
        if seen:
            i, j = np.array(seen).T
            met[order[0][i], order[1][j]] = True
        return met

    def share(self, sample: np.ndarray, k: int, aim: float = AIM) -> float:
        """Smallest share on the ladder whose recall on the sample is at least aim."""
        unit = np.unique(_unit(sample), axis=0)
        chosen = np.random.default_rng(11).permutation(len(unit))[:TRIAL_QUERIES]
        i, j = self.cells(unit)
        weight = np.zeros((len(self.books[0]), len(self.books[1])))
        np.add.at(weight, (i, j), 1)
        near = unit[chosen] @ unit.T
        near[np.arange(len(chosen)), chosen] = -np.inf
        best = np.argsort(-near, axis=1)[:, : min(k, len(unit) - 1)]
        if best.shape[1] == 0:
            return 1.0
        for share in LADDER:
            hits = [self.walk(unit[q], weight, share * len(unit))[i[row], j[row]].mean() for q, row in zip(chosen, best, strict=True)]
            if np.mean(hits) >= aim:
                return share
        return 1.0


def cosine(query: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """Cosines of one vector with rows, summed alike for equal rows."""
    query, entries = _scaled(query[None, :])[0], _scaled(entries)
    return (entries * query).sum(axis=1) / (np.sqrt((entries * entries).sum(axis=1)) * np.sqrt((query * query).sum()))


def blocks(held: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """First block and number of blocks of each centroid, given its entries: centroids of more than
    `size` entries have blocks of their own, the others share one with their neighbours."""
    first, count, at, room = np.zeros(len(held), int), np.ones(len(held), int), -1, 0
    for i, n in enumerate(held.tolist()):
        if n > size:
            count[i], first[i], room = -(-n // size), at + 1, 0
            at += count[i]
        else:
            if n > room or at < 0:
                at, room = at + 1, size
            first[i], room = at, room - n
    return first, count


def neighbours(vectors: DataFrame, is_query, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding", aim: float = AIM) -> DataFrame:
    """query_id, rank, vec_id and score of the k nearest entries found for each row with is_query."""
    spark = vectors.sparkSession
    raw = F.transform(F.col(vector_col), lambda x: x.cast("double"))
    usable = F.exists("raw", lambda x: x != 0) & ~F.exists("raw", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), raw.alias("raw")).where("vec_id is not null and raw is not null").where(F.coalesce(usable, F.lit(False)))

    def to_bytes(batches):
        for batch in batches:
            values = [np.asarray(x, np.float64).tobytes() for x in batch.column(1).to_pylist()]
            yield pa.record_batch([batch.column(0), pa.array(values, pa.binary())], names=["vec_id", "v"])

    packed = common.map_arrow(rows, to_bytes, "vec_id bigint, v binary")
    empty = spark.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score double")
    total = rows.count()
    sample = _sampled(packed, total, SAMPLE)
    if not len(sample):
        return empty
    index = MultiIndex(sample, centroids(total))
    share, width = index.share(sample, k, aim), index.width

    def place(batches):
        for batch in batches:
            data = batch.column(1).to_pylist()
            fits = [len(v) == 8 * width for v in data]
            ids = np.asarray(batch.column(0))[fits]
            data = [v for v, ok in zip(data, fits, strict=True) if ok]
            if data:
                i, j = index.cells(_unit(np.frombuffer(b"".join(data)).reshape(-1, width)))
                yield pa.record_batch([pa.array(ids, pa.int64()), pa.array(data, pa.binary()), pa.array(i, pa.int32()), pa.array(j, pa.int32())], names=["vec_id", "v", "i", "j"])

    placed = common.durable(common.map_arrow(packed, place, "vec_id bigint, v binary, i int, j int"), "multi-index")
    # both counts have at most as many rows as there are cells
    weight = np.zeros((len(index.books[0]), len(index.books[1])))
    for i, j, n in placed.groupBy("i", "j", F.md5("v").alias("m")).agg(F.lit(1).alias("one")).groupBy("i", "j").count().collect():
        weight[i, j] = n
    held = np.zeros(len(weight), int)
    for i, n in placed.groupBy("i").count().collect():
        held[i] = n
    enough, cells = share * weight.sum(), weight.shape[1]
    asking = rows.where(is_query(F.col("vec_id"))).groupBy("vec_id").agg(F.min("raw").alias("raw"))
    chosen = common.map_arrow(asking, to_bytes, "vec_id bigint, v binary").where(F.octet_length("v") == 8 * width)
    first, count = blocks(held, max(256, BLOCK // (8 * width)))
    there = int((first + count).max())
    # the centroids of each block are neighbours
    low = np.full(there, len(first))
    high = np.zeros(there, int)
    for i, (b, n) in enumerate(zip(first.tolist(), count.tolist(), strict=True)):
        low[b : b + n], high[b : b + n] = np.minimum(low[b : b + n], i), i + 1

    def probe(batches):
        kinds = (pa.int32(), pa.int64(), pa.binary(), pa.binary())
        record = lambda out: pa.record_batch([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], names=["b", "vec_id", "v", "cells"])
        for batch in batches:
            out, size = [], 0
            for q, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                met = index.walk(_unit(np.frombuffer(v).reshape(1, -1))[0], weight, enough)
                rows = np.flatnonzero(met.any(axis=1))
                copies = [(b, q, v, np.packbits(met[low[b] : high[b]]).tobytes()) for b in sorted({int(b) for i in rows for b in range(first[i], first[i] + count[i])})]
                out += copies
                size += sum(len(v) + len(c[3]) for c in copies)
                # a query goes to many blocks, so a batch of queries is many times as long when it leaves
                if size >= PROBES:
                    yield record(out)
                    out, size = [], 0
            if out:
                yield record(out)

    probes = common.map_arrow(chosen, probe, "b int, vec_id bigint, v binary, cells binary").select("b", F.lit(1).alias("side"), "vec_id", "v", F.lit(0).alias("cell"), "cells")
    of = lambda values: F.array(*[F.lit(int(x)) for x in values])[F.col("i")]
    block = (of(first) + F.pmod(F.xxhash64("vec_id", "v"), of(count))).cast("int")
    entries = placed.select(block.alias("b"), F.lit(0).alias("side"), "vec_id", "v", (F.col("i") * cells + F.col("j")).alias("cell"), F.lit(b"").alias("cells"))

    def rerank(batches):
        ids, data, cell, unit, at = [], [], [], None, 0
        for whole in batches:
            split = int(np.searchsorted(np.asarray(whole.column(1)), 1))
            # no batch after the first with queries holds entries
            if split:
                ids.append(np.asarray(whole.column(2))[:split])
                data += whole.column(3)[:split].to_pylist()
                cell.append(np.asarray(whole.column(4))[:split])
            if split == whole.num_rows:
                continue
            if unit is None:
                if not data:
                    return
                ids, cell = np.concatenate(ids), np.concatenate(cell)
                order = np.argsort(ids, kind="stable")
                ids, e = ids[order], np.frombuffer(b"".join(data)).reshape(len(ids), -1)[order]
                unit, at = _unit(e), int(low[whole.column(0)[split].as_py()])
                cell = cell[order] - at * cells
            for part in common.slices(whole.slice(split), 5, 8 << 20, QUERIES):
                names = np.asarray(part.column(2))
                q = np.frombuffer(b"".join(part.column(3).to_pylist())).reshape(len(names), -1)
                near = _unit(q) @ unit.T
                met = np.unpackbits(np.frombuffer(b"".join(part.column(5).to_pylist()), np.uint8).reshape(len(names), -1), axis=1)[:, cell].astype(bool)
                met &= names[:, None] != ids[None, :]
                near[~met] = -np.inf
                kth = np.partition(near, -k, axis=1)[:, -k] if len(ids) > k else np.full(len(names), -2.0)
                out: list[tuple] = []
                for row, query in enumerate(names.tolist()):
                    # rounding differs between equal rows of a product: all near the k-th are scored anew
                    good = np.flatnonzero(met[row] & (near[row] >= kth[row] - 1e-9))
                    exact = cosine(q[row], e[good])
                    out += [(query, int(ids[good[x]]), float(exact[x])) for x in np.lexsort((ids[good], -exact))[:k]]
                columns = list(zip(*out, strict=True)) or [[]] * 3
                yield pa.record_batch([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.float64()), strict=True)], names=["query_id", "vec_id", "score"])

    met = entries.unionByName(probes).repartitionById(there, "b").sortWithinPartitions("side")
    found = common.map_arrow(met, rerank, FOUND)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
