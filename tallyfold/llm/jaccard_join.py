"""N-gram Jaccard join by vertical partitioning.

A document is the set of its distinct word shingles, as 64-bit hashes in one global order. Two
documents link when 100 * |intersection| >= 75 * |union|; the result is each document's set size
and component of the link graph.

The global order is cut into fragments, and a fragment's overlaps are counted apart from the
others', then summed:

1. Census. Every document sends the first half of its set, split by fragment, to the fragments'
   tasks (packed as byte planes, a few bytes per shingle). A fragment counts for each document how
   many of its shingles there also occur in another document. If two documents link, they share so
   many of their first shingles that a document whose summed count is lower links with nothing.
2. Documents with equal sets become one class; classes that pass the census are read again in
   full, and a second census over whole sets asks for three quarters of shared shingles and sums
   how often each one occurs.
3. Candidates are classes that share a shingle of their prefix (the first quarter of the set). In a
   shingle's list all are compared with one hub only, the class whose shingles are the most
   common. Overlaps are counted per fragment and summed per pair.
4. Components of the links found so far are formed. Lists whose classes all lie in one component
   are done: more links there change nothing. In the others every remaining pair across components
   that can still reach the threshold by length, position, bit parities of the sets and distance to a
   shared hub is compared.
   So no link between components is lost, while a group of n copies costs about n comparisons.

Words are what lies between ASCII white space, A-Z lower-cased. Texts shorter than a shingle are one
shingle as a whole; null, empty and blank texts have an empty set and stay alone. Rows of equal id
should be equal rows; each gets its result. A null id joins nothing by itself: its component is the
smallest id of its class's component, or null. An empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyfold.llm import common
from tallyfold.llm.components import components

WIDTH = 5
#: The least similarity, as a share of 100.
LEAST = 75
#: Bytes of text per fragment of the census.
FRAGMENT_BYTES = 12 << 20
#: Fragments in which a pair's overlap is counted: the top three bits of a shingle.
SEGMENTS = 8
#: Bytes of text of a batch in the first census, shingles of one in the second.
BYTES, TOKENS = 6 << 20, 500_000
_PACKED = "frag int, batch bigint, data binary"


def least_overlap(n: int) -> int:
    """Fewest shingles that a set of n shares with any set it links to."""
    return -(-LEAST * n // 100)


def _quorum(n: int) -> int:
    return max(1, n // 4)


def census_prefix(n: int) -> int:
    return n - least_overlap(n) + _quorum(n) if n else 0


def census_least(n: int) -> int:
    """Linking sets share this many of their census prefixes: the smaller set has at least
    least_overlap(n) shingles, and its quorum counts."""
    return _quorum(least_overlap(n))


def _pack(tokens: np.ndarray, marks: np.ndarray) -> bytes:
    """Sorted 40-bit values as differences in byte planes, and a 16-bit mark for each."""
    steps = np.diff(tokens, prepend=np.uint64(0))
    planes = steps.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :5].T.tobytes()
    return planes + marks.astype("<u2").view(np.uint8).reshape(-1, 2).T.tobytes()


def _unpack(data) -> tuple[np.ndarray, np.ndarray]:
    n = len(data) // 7
    planes = np.frombuffer(data, np.uint8).reshape(7, n)
    steps = np.zeros((n, 8), np.uint8)
    steps[:, :5] = planes[:5].T
    marks = np.ascontiguousarray(planes[5:].T).view("<u2").ravel()
    return np.cumsum(steps.view("<u8").ravel()), marks


#: Mark of a value that several rows of its batch have.
_MANY = (1 << 16) - 1


class _Asked:
    """The distinct 40-bit values of one batch of sets, and which rows have them."""

    def __init__(self, sets: list[np.ndarray]):
        tokens = np.concatenate(sets) >> np.uint64(24) if sets else np.empty(0, np.uint64)
        owner = np.repeat(np.arange(len(sets)), [len(x) for x in sets])
        self.values, first, self.back, self.times = np.unique(tokens, return_index=True, return_inverse=True, return_counts=True)
        self.owner, self.rows = owner, len(sets)
        self.marks = np.where(self.times > 1, _MANY, owner[first] if len(first) else 0)

    def messages(self, key: int, fragments: int):
        """One packed message per fragment of the global order."""
        frag = ((self.values * np.uint64(2 * fragments)) >> np.uint64(40)).astype(np.int64)
        cuts = [*np.flatnonzero(np.diff(frag, prepend=-1)).tolist(), len(frag)]
        return [(int(frag[a]), key, _pack(self.values[a:b], self.marks[a:b])) for a, b in zip(cuts, cuts[1:], strict=False)]


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    f, k, d = zip(*rows, strict=True)
    return pa.record_batch([pa.array(f, pa.int32()), pa.array(k, pa.int64()), pa.array(d, pa.binary())], names=["frag", "batch", "data"])


def _answered(packed: DataFrame, reply) -> DataFrame:
    """Every message of a fragment answered by reply(marks, times), times being the number of
    rows or batches that have each of its values (2 for any value that one batch has twice)."""

    def count(group: pa.Table) -> pa.Table:
        if group.column("frag")[0].as_py() < 0:
            return group
        parts = [_unpack(x.as_buffer()) for x in group.column("data")]
        _, back = np.unique(np.concatenate([t for t, _ in parts]), return_inverse=True)
        marks = np.concatenate([m for _, m in parts])
        sizes = [len(m) for _, m in parts]
        del parts
        times = np.bincount(back, weights=1 + (marks == _MANY)).astype(np.uint32)[back]
        at, out = 0, []
        for n in sizes:
            out.append(reply(marks[at : at + n], times[at : at + n]))
            at += n
        return group.set_column(2, "data", pa.array(out, pa.binary()))

    return common.map_tables(packed, ["frag"], count, _PACKED)


def _census(rows: DataFrame, width: int, fragments: int) -> DataFrame:
    """doc_id, n, h1, h2 and shared for every text: set size, two hashes of the set, and how many
    shingles of the census prefix other rows have too."""

    def deal(batches):
        seen = common.WordHash()
        for batch in batches:
            for part in common.slices(batch, 1, BYTES, _MANY):
                ids, texts = part.column(0), part.column(1)
                sets = [shingle_set(texts[i].as_py(), seen, width) for i in range(part.num_rows)]
                h1 = np.array([int(common.mix64(x).sum()) if len(x) else 0 for x in sets], np.uint64)
                h2 = np.array([int(common.mix64(x ^ np.uint64(0xA5A5A5A5A5A5A5A5)).sum()) if len(x) else 0 for x in sets], np.uint64)
                sizes = np.array([len(x) for x in sets], np.int64)
                asked = _Asked([x[: census_prefix(len(x))] for x in sets])
                here = np.bincount(asked.owner[asked.times[asked.back] > 1], minlength=asked.rows)
                none = ids.is_null().to_numpy(zero_copy_only=False)
                number = ids.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
                table = b"".join(x.tobytes() for x in (number, none.astype(np.int64), sizes, h1, h2, here.astype(np.int64)))
                key = np.uint64(xxhash.xxh64_intdigest(table)).astype(np.int64).item()
                yield _batch([(-1 - key % fragments, key, table), *asked.messages(key, fragments)])

    def reply(marks: np.ndarray, times: np.ndarray) -> bytes:
        alone = marks != _MANY
        return np.bincount(marks[alone], weights=times[alone] > 1).astype("<u4").tobytes()

    def total(group: pa.Table) -> pa.Table:
        frag, data = group.column("frag").to_pylist(), [x.as_buffer() for x in group.column("data")]
        tables = [d for f, d in zip(frag, data, strict=True) if f < 0]  # equal batches of repeated rows share a key
        number, none, n, h1, h2, shared = np.frombuffer(tables[0], np.int64).reshape(6, -1).copy()
        for f, d in zip(frag, data, strict=True):
            if f >= 0:
                shared[: len(d) // 4] += np.frombuffer(d, "<u4")
        out = pa.table({"doc_id": pa.array(number, pa.int64(), mask=none == 1), "n": n, "h1": h1, "h2": h2, "shared": shared})
        return pa.concat_tables([out] * len(tables))

    answered = _answered(common.map_arrow(rows, deal, _PACKED), reply)
    return common.map_tables(answered, ["batch"], total, "doc_id bigint, n bigint, h1 bigint, h2 bigint, shared bigint")


def _shared_sets(sets: DataFrame, fragments: int) -> DataFrame:
    """For every set (id, tokens) that shares least_overlap(n) or more of its n shingles with other
    sets: id, n, s (how many it shares), central (how common its shingles are) and, of the shared
    shingles, the prefix, the segments of the global order and the segments' bit parities."""

    def parts(batches):
        for batch in batches:
            ids, lists = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1)
            at = lists.offsets.to_numpy()
            values = lists.values.to_numpy(zero_copy_only=False).view(np.uint64)
            begin = 0
            while begin < len(ids):
                stop = min(len(ids), begin + _MANY, max(begin + 1, int(np.searchsorted(at, at[begin] + TOKENS, side="right")) - 1))
                yield ids[begin:stop], [values[a:b] for a, b in zip(at[begin:stop], at[begin + 1 : stop + 1], strict=True)]
                begin = stop

    def deal(batches):
        for ids, mine in parts(batches):
            table = np.array([len(ids)], np.int64).tobytes() + ids.astype(np.int64).tobytes() + np.array([len(x) for x in mine], np.int64).tobytes() + b"".join(x.tobytes() for x in mine)
            key = np.uint64(xxhash.xxh64_intdigest(table)).astype(np.int64).item()
            yield _batch([(-1 - key % fragments, key, table), *_Asked(mine).messages(key, fragments)])

    def total(group: pa.Table) -> pa.Table:
        group = group.sort_by("frag")
        data = [x.as_buffer() for x in group.column("data")]
        rows = int(np.frombuffer(data[0], np.int64, 1)[0])
        ids, sizes = np.frombuffer(data[0], np.int64, 2 * rows, 8).reshape(2, -1)
        tokens, ends = np.frombuffer(data[0], np.uint64, -1, 8 + 16 * rows), np.cumsum(sizes)
        asked = _Asked(np.split(tokens, ends[:-1]))
        told = np.concatenate([np.frombuffer(d, "<u4") for d in data[1:]]) if len(data) > 1 else np.empty(0, np.uint32)
        times = told[asked.back] + asked.times[asked.back] - 1 - (asked.times[asked.back] > 1)
        mass, owner = np.bincount(asked.owner, weights=times, minlength=rows), asked.owner
        del asked, told
        keep = times > 1
        shared = np.bincount(owner[keep], minlength=rows)
        least = -(-LEAST * sizes // 100)
        enough = shared >= least
        keep &= enough[owner]
        return _segmented(ids[enough], sizes[enough], mass[enough] / np.maximum(sizes[enough], 1), shared[enough], least[enough], tokens[keep])

    answered = _answered(common.map_arrow(sets, deal, _PACKED), lambda marks, times: times.astype("<u4").tobytes())
    return common.map_tables(answered, ["batch"], total, "id bigint, n bigint, s bigint, central double, prefix array<bigint>, segments array<array<bigint>>, parity array<bigint>")


def _segmented(ids: np.ndarray, sizes: np.ndarray, central: np.ndarray, shared: np.ndarray, least: np.ndarray, tokens: np.ndarray) -> pa.Table:
    """The output rows of sets whose shared shingles, in order, lie end to end in tokens. Shingles of
    one set only come first in the global order, so they fill a part of the prefix."""
    owner, first = np.repeat(np.arange(len(ids)), shared), np.repeat(np.cumsum(shared) - shared, shared)
    prefix = tokens[np.arange(len(tokens)) - first < np.repeat(shared - least + 1, shared)]
    slot = owner * SEGMENTS + (tokens >> np.uint64(61)).astype(np.int64)
    held = np.bincount(slot, minlength=len(ids) * SEGMENTS)
    parity = np.zeros(len(held), np.uint64)
    if len(tokens):
        at = (np.cumsum(held) - held)[held > 0]
        parity[held > 0] = np.bitwise_xor.reduceat(np.uint64(1) << (tokens & np.uint64(63)), at)
    each, long = np.full(len(ids), SEGMENTS), pa.int64()
    inner = common.lists(tokens.view(np.int64), held, long)
    segments = pa.ListArray.from_arrays(pa.array(np.arange(len(ids) + 1) * SEGMENTS, pa.int32()), inner)
    return pa.table({
        "id": ids, "n": sizes, "s": shared, "central": central, "prefix": common.lists(prefix.view(np.int64), np.minimum(shared, shared - least + 1), long),
        "segments": segments, "parity": common.lists(parity.view(np.int64), each, long),
    })


def shingle_set(text: str | None, seen: common.WordHash, width: int = WIDTH) -> np.ndarray:
    """The sorted distinct shingle hashes of a text."""
    return np.unique(common.shingle_hashes(seen.of(common.ascii_lower_words(text)), width))


def _bound(n: Column, m: Column) -> Column:
    """Fewest shared shingles with which sets of n and m link."""
    return F.ceil((n + m) * LEAST / (100.0 + LEAST) - 1e-9)


def _linked(n: Column, m: Column, both: Column) -> Column:
    return both * (100 + LEAST) >= (n + m) * LEAST


def _possible(n: Column, s: Column, p: Column, m: Column, t: Column, q: Column) -> Column:
    """Can sets of n and m link of which s and t shingles are shared with any other set? Each shared
    shingle flips one bit of the parities p and q, so bits that differ are at most as many as
    shared shingles that only one of both has."""
    unlike = F.bit_count(p[0].bitwiseXOR(q[0]))
    for j in range(1, SEGMENTS):
        unlike = unlike + F.bit_count(p[j].bitwiseXOR(q[j]))
    return (F.least(n, m) * 100 >= F.greatest(n, m) * LEAST) & (F.least(s, t) >= _bound(n, m)) & (unlike <= s + t - 2 * _bound(n, m))


def _overlaps(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """pairs (a, b) with na, nb and the overlap, counted per fragment and summed."""
    side = lambda x: sets.select(F.col("id").alias(x), F.col("n").alias(f"n{x}"), F.col("segments").alias(f"s{x}"))
    both = pairs.join(side("b"), "b").join(side("a"), "a")
    partial = F.zip_with("sa", "sb", lambda x, y: F.size(F.array_intersect(x, y)))
    return both.select("a", "b", "na", "nb", F.aggregate(partial, F.lit(0), lambda t, x: t + x).cast("long").alias("both"))


def jaccard_links(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(census, classes, labels): census has doc_id, n, h1 and h2 of every row; classes the smallest
    id of the rows of each h1, h2 and n; labels the component of every class that links with another one."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    fragments = max(16, -(-size // FRAGMENT_BYTES))
    census = common.durable(_census(rows, width, fragments), "census")
    fewest = F.ceil(F.col("n") * LEAST / 100.0 - 1e-9)
    passes = F.col("shared") >= F.greatest(F.lit(1), F.floor(fewest / 4))
    classes = census.where("n > 0 and doc_id is not null").groupBy("h1", "h2", "n").agg(F.min("doc_id").alias("id"), F.max(passes).alias("passes"), F.count(F.lit(1)).alias("copies"))
    classes = common.durable(classes, "classes")
    passing = classes.where("passes").select(F.col("id").alias("doc_id"))

    def full(batches):
        seen = common.WordHash()
        for batch in batches:
            for part in common.slices(batch, 1, BYTES, _MANY):
                sets = [shingle_set(part.column(1)[i].as_py(), seen, width) for i in range(part.num_rows)]
                tokens = np.concatenate(sets).view(np.int64)
                yield pa.record_batch([part.column(0), common.lists(tokens, np.array([len(x) for x in sets]), pa.int64())], names=["id", "tokens"])

    chosen = rows.join(passing.hint("shuffle_hash"), "doc_id", "left_semi")
    sets = common.durable(common.map_arrow(chosen, full, "id bigint, tokens array<bigint>").groupBy("id").agg(F.min("tokens").alias("tokens")), "sets")
    sets = common.durable(_shared_sets(sets, fragments), "segments")
    # places in the order, counted with the shingles that come first
    lists = sets.select("id", "n", "s", "central", "parity", F.posexplode("prefix").alias("at", "token"))
    hubs = lists.groupBy("token").agg(F.max(F.struct("central", (-F.col("id")).alias("less"))).alias("h"), F.count(F.lit(1)).alias("k")).where("k > 1").select("token", (-F.col("h.less")).alias("a"))
    starred = lists.select("token", "id").join(hubs, "token").where("id <> a").select("a", F.col("id").alias("b")).distinct()
    compared = common.durable(_overlaps(starred, sets), "compared")
    links = compared.where(_linked(F.col("na"), F.col("nb"), F.col("both"))).select("a", "b")
    labels = components(links, "jaccard")

    # what is left: lists that still hold several components
    nearest = compared.groupBy("b").agg(F.max(F.struct((F.col("both") / (F.col("na") + F.col("nb") - F.col("both"))).alias("sim"), "a")).alias("m")).select(F.col("b").alias("id"), F.col("m.a").alias("hub"), F.col("m.sim").alias("sim"))
    placed = lists.join(labels, "id", "left").withColumn("comp", F.coalesce("comp", "id")).drop("central").join(nearest, "id", "left")
    open_lists = placed.groupBy("token").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo <> hi").select("token")
    sized = placed.join(open_lists, "token").groupBy("token", "comp").agg(F.count(F.lit(1)).alias("k")).groupBy("token").agg(F.max(F.struct("k", "comp")).alias("m")).select("token", F.col("m.comp").alias("main"))
    left = common.durable(placed.join(sized, "token"), "open")
    minor = left.where("comp <> main").select("token", *[F.col(c).alias(f"x_{c}") for c in ("id", "n", "s", "at", "parity", "comp", "hub", "sim")])
    # pairs of two minor ones are met from both sides; keep one
    met = minor.join(left, "token").where("comp <> x_comp and (comp = main or x_id < id)")
    n, m = F.col("x_n"), F.col("n")
    reach = F.least(F.col("x_s") - F.col("x_at"), F.col("s") - F.col("at"))
    apart = (F.col("hub") == F.col("x_hub")) & (F.abs(F.col("sim") - F.col("x_sim")) > 1 - LEAST / 100.0 + 1e-9)
    known = (F.col("hub") == F.col("x_id")) | (F.col("x_hub") == F.col("id"))
    met = met.where(_possible(n, F.col("x_s"), F.col("x_parity"), m, F.col("s"), F.col("parity")) & (reach >= _bound(n, m)) & ~F.coalesce(apart, F.lit(False)) & ~F.coalesce(known, F.lit(False)))
    more = common.durable(_overlaps(met.select(F.col("x_id").alias("a"), F.col("id").alias("b")).distinct(), sets).where(_linked(F.col("na"), F.col("nb"), F.col("both"))).select("a", "b"), "more")
    if not more.isEmpty():
        labels = components(links.unionByName(more), "jaccard")
    return census, classes, labels


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH) -> DataFrame:
    """doc_id, n_shingles and component_id for every row of docs."""
    census, classes, labels = jaccard_links(docs, id_col, text_col, width)
    groups = classes.join(labels, "id", "left").select("h1", "h2", "n", F.coalesce("comp", "id").alias("component_id"), "copies")
    found = common.join_groups(census.select("doc_id", "h1", "h2", "n"), common.durable(groups, "groups"), ["h1", "h2", "n"], "copies", census.count(), "left")
    return found.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs whose id is their component's: one document of each group."""
    gone = jaccard_components(docs, id_col, text_col).where("doc_id <> component_id").select("doc_id")
    return common.without(docs, gone, id_col)
