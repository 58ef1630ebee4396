"""Suffix-array dedup: remove every byte covered by a WINDOW-byte string that starts elsewhere too.

Hashes only propose what to compare; the suffix arrays of the shards decide.

1. Anchors. Each window is represented by its minimal GRAM-byte hash (leftmost on ties). Equal
   windows have equal anchors at equal places, so a maximal run of window starts with one anchor (a
   fragment, under a kilobyte) needs comparing only with fragments of an equal anchor hash. Each
   input batch sends one short record per distinct fragment to tasks by anchor range. They answer
   which fragments seem to occur more than once as a whole and which share their anchor with other,
   different fragments.
2. Chunks. Neighbouring fragments that seem to repeat are joined (cut where an anchor hash is a
   multiple of CUT), so that a long repeated passage is compared as a few long pieces. Of chunks of
   equal hash two copies go to a shard, and of fragments that are in no such chunk as well.
3. Shards. They hold those copies and one copy of each fragment that shares its anchor. A shard
   builds its suffix array by induced sorting and the permuted common prefixes; a window goes if it
   shares WINDOW bytes with a neighbour in order. Both copies of a chunk or fragment must be covered
   wholly, else (two texts of one 128-bit hash) the run stops with an error instead of a wrong
   result. A shard holds about SHARD bytes.
4. Crowded anchors. An anchor with more than HOT different fragments (or more than LOCAL in one
   batch) would overfill a shard, so it is split further: its fragments into single windows. Windows
   that seem to repeat, by their 128-bit hashes, go to shards of their own, two copies of each. The
   copies inside a batch are collapsed before any exchange, so no group lands in one task.

Texts are written once, dealt by a number that each row gets there; it stands for the row in all
that follows, and its own id is only carried along.

Matches never cross documents. Null counts as empty; texts shorter than a window keep everything;
identical documents lose everything but what no window covers. Every row is a document of its own,
whatever its id: rows without one and rows of equal id are judged apart. An empty table gives an
empty result; other columns are not read. `removed_repeats` gives spans and remaining bytes;
`suffix_dedup` derives digests and the remaining text from them.
"""

from __future__ import annotations

import pickle

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyfold.llm import common
from tallyfold.llm.suffix_array import common_prefixes, suffix_array

WINDOW = 400
GRAM = 200
#: Bytes per shard, different fragments of one anchor that shards take, and in one batch.
SHARD, HOT, LOCAL = 750_000, 1000, 32
#: One in CUT anchors begins a new chunk.
CUT = 64
#: Bytes of text per anchor range, of a batch, and hashed at a time.
RANGE, BYTES, STRETCH = 12 << 20, 16 << 20, 1 << 20
RESULT = "doc_id bigint, n_bytes bigint, spans array<struct<start:bigint,stop:bigint>>, kept binary"
_SPANS = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))
_PACKED = "part int, batch bigint, data binary"
_PARTS = pa.struct([("s", pa.int32()), ("e", pa.int32()), ("c1", pa.int64()), ("c2", pa.int64())])
KNOWN = pa.schema([("doc_id", pa.int64()), ("s", pa.int32()), ("e", pa.int32()), ("kind", pa.int32()), ("c1", pa.int64()), ("c2", pa.int64()), ("parts", pa.list_(_PARTS))])
_KNOWN = "doc_id bigint, s int, e int, kind int, c1 bigint, c2 bigint, parts array<struct<s:int,e:int,c1:bigint,c2:bigint>>"
_PLACE = np.uint64((1 << 31) - 1)
_RNG = np.random.default_rng(400)
_VALUES = _RNG.integers(1, 1 << 63, (2, 256), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _powers(which: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of a base and of its inverse modulo 2**64."""
    if which not in _POWERS or len(_POWERS[which][0]) < n:
        size = max(n, STRETCH + (1 << 16))
        out = []
        for base in (_BASES[which], pow(_BASES[which], -1, 1 << 64)):
            steps = np.full(size, np.uint64(base))
            steps[0] = 1
            out.append(np.multiply.accumulate(steps))
        _POWERS[which] = (out[0], out[1])
    return _POWERS[which]


class Rolling:
    """Hashes of any stretch of a buffer, by two polynomials modulo 2**64."""

    def __init__(self, data: np.ndarray):
        self.sums, self.back = [], []
        for which in (0, 1):
            up, down = _powers(which, len(data) + 1)
            total = np.zeros(len(data) + 1, np.uint64)
            np.cumsum(_VALUES[which][data] * up[: len(data)], out=total[1:])
            self.sums.append(total)
            self.back.append(down)

    def of(self, which: int, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        return common.mix64((self.sums[which][stop] - self.sums[which][start]) * self.back[which][start])


def _sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    low, span = values, 1
    while span * 2 <= width:
        low = np.minimum(low[:-span], low[span:])
        span *= 2
    rest = width - span
    return np.minimum(low[:-rest], low[rest:]) if rest else low


def fragments(data: np.ndarray, owner_stop: np.ndarray, window: int = WINDOW, gram: int = GRAM):
    """Fragments of the documents laid end to end in data (owner_stop: where each one stops):
    first and last window start, anchor hash and fragment hash."""
    none = np.empty(0, np.int64)
    n = len(data)
    if n < window:
        return none, none, none.astype(np.uint64), none.astype(np.uint64)
    rolling = Rolling(data)
    at = np.arange(n - gram + 1)
    hashes = rolling.of(0, at, at + gram)
    anchor = (_sliding_min((hashes & ~_PLACE) | at.astype(np.uint64), window - gram + 1) & _PLACE).astype(np.int64)
    starts = np.arange(len(anchor))
    owner = np.searchsorted(owner_stop, starts, side="right")
    valid = starts + window <= owner_stop[np.minimum(owner, len(owner_stop) - 1)]
    change = np.ones(len(anchor), bool)
    change[1:] = (anchor[1:] != anchor[:-1]) | (owner[1:] != owner[:-1]) | (valid[1:] != valid[:-1])
    first = np.flatnonzero(change)
    last = np.append(first[1:], len(anchor)) - 1
    first, last = first[valid[first]], last[valid[first]]
    anchor = anchor[first]
    whole = rolling.of(1, first, last + window)
    shape = ((anchor - first).astype(np.uint64) << np.uint64(32)) | (last - first).astype(np.uint64)
    # least hashes are small numbers: mixed again they fill the range evenly
    return first, last, common.mix64(hashes[anchor] ^ np.uint64(_BASES[1])), common.mix64(whole ^ common.mix64(shape))


def _stretches(texts: list[bytes]):
    """Runs of document numbers whose bytes are hashed together."""
    run, size = [], 0
    for i, text in enumerate(texts):
        if len(text) >= WINDOW:
            if run and size + len(text) > STRETCH:
                yield run
                run, size = [], 0
            run.append(i)
            size += len(text)
    if run:
        yield run


def _laid_out(texts: list[bytes], run: list[int]) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(b"".join([texts[i] for i in run]), np.uint8), np.cumsum([len(texts[i]) for i in run])


def _grouped(values: np.ndarray):
    """Row order by all columns, and where a new value (of column 0, of all) begins in it."""
    order = np.lexsort(values.T[::-1])
    s = values[order]
    new_key = np.ones(len(s), bool)
    new_all = np.ones(len(s), bool)
    new_key[1:] = s[1:, 0] != s[:-1, 0]
    new_all[1:] = (s[1:] != s[:-1]).any(axis=1)
    return order, new_key, new_all


def _asked(rows: DataFrame, prepare, judge, finish, schema: str, parts: int) -> DataFrame:
    """An exchange in which every batch asks about values and gets one byte back for each.

    prepare(batch) -> (table, values, flags) with values an (n, 2) array of uint64, sorted by
    column 0; judge(values, flags) -> bytes for the values of one range; finish(table, answers)."""

    def deal(batches):
        for whole in batches:
            for batch in common.slices(whole, 1, BYTES, whole.num_rows):
                table, values, flags = prepare(batch)
                data = pickle.dumps(table, protocol=5)
                key = np.uint64(xxhash.xxh64_intdigest(data)).astype(np.int64).item()
                part = ((values[:, 0] >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)).astype(np.int64)
                cuts = [*np.flatnonzero(np.diff(part, prepend=-1)).tolist(), len(part)]
                out = [(-1 - key % parts, key, data)]
                out += [(int(part[a]), key, values[a:b].T.tobytes() + flags[a:b].tobytes()) for a, b in zip(cuts, cuts[1:], strict=False)]
                p, k, d = zip(*out, strict=True)
                yield pa.record_batch([pa.array(p, pa.int32()), pa.array(k, pa.int64()), pa.array(d, pa.binary())], names=["part", "batch", "data"])

    def answer(group: pa.Table) -> pa.Table:
        if group.column("part")[0].as_py() < 0:
            return group
        data = [x.as_buffer() for x in group.column("data")]
        sizes = [len(d) // 17 for d in data]
        values = np.concatenate([np.frombuffer(d, np.uint64, 2 * n).reshape(2, n).T for d, n in zip(data, sizes, strict=True)])
        flags = np.concatenate([np.frombuffer(d, np.uint8, n, 16 * n) for d, n in zip(data, sizes, strict=True)])
        told, at, out = judge(values, flags), 0, []
        for n in sizes:
            out.append(told[at : at + n].tobytes())
            at += n
        return group.set_column(2, "data", pa.array(out, pa.binary()))

    def gather(group: pa.Table) -> pa.Table:
        # equal batches (of repeated rows) share a key: their answers lie side by side
        group = group.sort_by("part")
        part, data = group.column("part").to_pylist(), [x.as_buffer() for x in group.column("data")]
        tables = [d for p, d in zip(part, data, strict=True) if p < 0]
        asked = dict(zip(part, data, strict=True))
        told = [np.frombuffer(d, np.uint8) for p, d in asked.items() if p >= 0]
        told = np.concatenate(told) if told else np.empty(0, np.uint8)
        return pa.concat_tables([finish(pickle.loads(t), told) for t in tables])

    answered = common.map_tables(common.map_arrow(rows, deal, _PACKED), ["part"], answer, _PACKED)
    return common.map_tables(answered, ["batch"], gather, schema)


def _texts(batch) -> tuple[np.ndarray, list[bytes]]:
    ids = batch.column(0).to_numpy(zero_copy_only=False)
    column = batch.column(1)
    return ids, [(column[i].as_py() or "").encode() for i in range(batch.num_rows)]


def _prepare_anchors(batch):
    """Fragments of a batch; the distinct (anchor, fragment) hashes are asked about."""
    ids, texts = _texts(batch)
    rows = []
    for run in _stretches(texts):
        data, stop = _laid_out(texts, run)
        first, last, key, whole = fragments(data, stop)
        number = np.searchsorted(stop, first, side="right")
        begin = np.concatenate([[0], stop[:-1]])[number]
        rows.append((np.array(run)[number], first - begin, last - begin, key, whole))
    doc, first, last, key, whole = (np.concatenate(c) for c in zip(*rows, strict=True)) if rows else [np.empty(0, np.int64)] * 3 + [np.empty(0, np.uint64)] * 2
    del rows
    values = np.column_stack([key, whole]) if len(key) else np.empty((0, 2), np.uint64)
    order, new_key, new_all = _grouped(values)
    kind = np.empty(len(order), np.int64)
    kind[order] = np.cumsum(new_all) - 1
    values = values[order][new_all]
    times = np.bincount(kind, minlength=len(values))
    group = np.cumsum(new_key[new_all]) - 1 if len(values) else np.empty(0, np.int64)
    crowded = np.bincount(group, minlength=1)[group] > LOCAL if len(values) else np.empty(0, bool)
    # a crowded anchor asks once, without its fragments
    head = np.ones(len(values), bool)
    head[1:] = group[1:] != group[:-1]
    asks = ~crowded | head
    question = np.maximum(np.cumsum(asks) - 1, 0)
    flags = np.where(crowded, 2, (times > 1).astype(int)).astype(np.uint8)
    table = (ids, doc.astype(np.int32), first.astype(np.int32), (last - first).astype(np.int16), kind.astype(np.int32), values, question.astype(np.int32), times > 1)
    asked = values[asks]
    asked[crowded[asks], 1] = 0
    return table, asked, flags[asks]


def _judge_anchors(values: np.ndarray, flags: np.ndarray) -> np.ndarray:
    """1: the whole fragment occurs elsewhere; 2: its bytes are compared in a shard; 4: hot."""
    order, new_key, new_all = _grouped(values)
    flag = flags[order]
    each, by_key = np.cumsum(new_all) - 1, np.cumsum(new_key) - 1
    times = np.bincount(each, weights=1 + (flag == 1))[each]
    kinds = np.bincount(by_key, weights=new_all)[by_key]
    hot = (np.bincount(by_key, weights=flag == 2)[by_key] > 0) | (kinds > HOT)
    told = np.where(hot, 4, 2 * ((kinds > 1) & new_all)) | ((times > 1) & (flag != 2))
    out = np.empty(len(order), np.uint8)
    out[order] = told
    return out


def _finish_anchors(table, told: np.ndarray) -> pa.Table:
    """Rows of KNOWN: chunks of fragments that seem to repeat (kind 0), one copy of each fragment of
    this batch that shares its anchor (1), or whose anchor is crowded (2)."""
    ids, doc, first, span, kind, values, question, repeated = table
    if not len(doc):
        return KNOWN.empty_table()
    last = first + span
    told = told[question]
    gone = np.flatnonzero(((told & 1 > 0) | repeated)[kind])
    d, f, e, v = doc[gone], first[gone], last[gone], values[kind[gone]]
    new = np.ones(len(gone), bool)
    new[1:] = (d[1:] != d[:-1]) | (f[1:] != e[:-1] + 1) | (v[1:, 0] % np.uint64(CUT) == 0)
    head = np.flatnonzero(new)
    size = np.diff(np.append(head, len(gone)))
    place = (np.arange(len(gone)) - np.repeat(head, size)).astype(np.uint64) * np.uint64(_BASES[0])
    total = [np.add.reduceat(common.mix64(v[:, k] + place), head) if len(head) else v[:0, 0] for k in (0, 1)]
    sample = np.zeros(len(values), np.int64)
    sample[kind[::-1]] = np.arange(len(kind))[::-1]
    cut = np.flatnonzero(told & 6)
    at = sample[cut]
    signed = lambda *x: np.concatenate(x).view(np.int64)
    inner = pa.StructArray.from_arrays([pa.array(f), pa.array(e), pa.array(v[:, 0].view(np.int64)), pa.array(np.ascontiguousarray(v[:, 1]).view(np.int64))], fields=list(_PARTS))
    return pa.table([
        np.concatenate([ids[d[head]], ids[doc[at]]]), np.concatenate([f[head], first[at]]), np.concatenate([e[head + size - 1], last[at]]),
        np.concatenate([np.zeros(len(head), np.int32), np.where(told[cut] & 4, 2, 1).astype(np.int32)]), signed(total[0], values[cut, 0]), signed(total[1], values[cut, 1]),
        pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(size), np.full(len(at), len(gone))]), pa.int32()), inner),
    ], schema=KNOWN)


def _prepare_windows(batch):
    """All windows of crowded fragments; the distinct ones are asked about."""
    ids, data, first = np.asarray(batch.column(0)), batch.column(1).to_pylist(), np.asarray(batch.column(2))
    rows = []
    for n, piece in enumerate(data):
        rolling, at = Rolling(np.frombuffer(piece, np.uint8)), np.arange(len(piece) - WINDOW + 1)
        rows.append((np.full(len(at), n), at, rolling.of(0, at, at + WINDOW), rolling.of(1, at, at + WINDOW)))
    piece, at, one, two = (np.concatenate(c) for c in zip(*rows, strict=True)) if rows else [np.empty(0, np.int64)] * 2 + [np.empty(0, np.uint64)] * 2
    values = np.column_stack([one, two])
    order, _, new = _grouped(values)
    kind = np.empty(len(order), np.int64)
    kind[order] = np.cumsum(new) - 1
    times = np.bincount(kind, minlength=int(new.sum()))
    return (ids, first, data, piece, at, kind, times > 1, values[order][new]), values[order][new], (times > 1).astype(np.uint8)


def _judge_windows(values: np.ndarray, flags: np.ndarray) -> np.ndarray:
    order, _, new = _grouped(values)
    each = np.cumsum(new) - 1
    out = np.empty(len(order), np.uint8)
    out[order] = np.bincount(each, weights=1 + flags[order])[each] > 1
    return out


def _finish_windows(table, told: np.ndarray) -> pa.Table:
    """Runs of windows that seem to repeat (no data), and up to two copies of each such window."""
    ids, first, data, piece, at, kind, repeated, values = table
    gone = np.flatnonzero(((told > 0) | repeated)[kind]) if len(kind) else np.empty(0, np.int64)
    piece, at, kind = piece[gone], at[gone], kind[gone]
    begin = np.flatnonzero(np.diff(piece, prepend=-1) | (np.diff(at, prepend=-1) != 1))
    end = np.append(begin[1:], len(at))[: len(begin)] - 1
    order = np.argsort(kind, kind="stable")
    nth = np.arange(len(kind)) - np.searchsorted(kind[order], kind[order])
    copy = order[nth < 2]
    none = np.zeros(len(begin), np.int64)
    return pa.table([
        np.concatenate([ids[piece[begin]], ids[piece[copy]]]), np.concatenate([first[piece[begin]] + at[begin], first[piece[copy]] + at[copy]]), np.concatenate([first[piece[begin]] + at[end], first[piece[copy]] + at[copy]]),
        np.concatenate([none, values[kind[copy], 0].view(np.int64)]), np.concatenate([none, np.ascontiguousarray(values[kind[copy], 1]).view(np.int64)]),
        pa.array([None] * len(begin) + [data[p][t : t + WINDOW] for p, t in zip(piece[copy].tolist(), at[copy].tolist(), strict=True)], pa.binary()),
    ], names=["doc_id", "s", "e", "c1", "c2", "data"])


def repeated_windows(pieces: list[bytes], window: int = WINDOW) -> list[np.ndarray]:
    """Starts of the windows of each piece that occur elsewhere in the pieces."""
    text = np.zeros(sum(map(len, pieces)) + len(pieces) + 1, np.int64)
    begin, at = [], 0
    for piece in pieces:
        begin.append(at)
        text[at : at + len(piece)] = np.frombuffer(piece, np.uint8).astype(np.int64) + 2
        text[at + len(piece)] = 1
        at += len(piece) + 1
    before, shared = common_prefixes(text, suffix_array(text))
    hit = shared >= window
    twice = hit.copy()
    twice[before[hit]] = True
    return [np.flatnonzero(twice[b : b + max(0, len(p) - window + 1)]) for b, p in zip(begin, pieces, strict=True)]


def _shard(group: pa.Table) -> pa.Table:
    """Runs of window starts that the shard's suffix array finds twice."""
    group = group.sort_by([("doc_id", "ascending"), ("s", "ascending"), ("kind", "ascending")])
    data = [x.as_buffer() for x in group.column("data")]
    found = repeated_windows(data)
    size, kind = np.array([len(f) for f in found]), group.column("kind").to_numpy()
    if (size < np.array([len(x) for x in data]) - WINDOW + 1)[kind == 0].any():
        raise RuntimeError("two different strings share both hashes")
    piece = np.repeat(np.arange(len(found)), size)
    at = np.concatenate(found)
    begin = np.flatnonzero(np.diff(piece, prepend=-1) | (np.diff(at, prepend=-1) != 1))
    end = np.append(begin[1:], len(at))[: len(begin)] - 1
    first = group.column("s").to_numpy()[piece[begin]]
    return pa.table({"doc_id": group.column("doc_id").to_numpy()[piece[begin]], "s": first + at[begin], "e": first + at[end]})


def _copies(rows: DataFrame, *more) -> DataFrame:
    """The first and the last place (a, b) of each c1 and c2, the number n of places, and what else is
    asked; partial aggregation collapses the copies of each input split before the exchange."""
    place = F.struct("doc_id", "s", "e", *[c for c in ("data",) if c in rows.columns])
    return rows.groupBy("c1", "c2").agg(F.min(place).alias("a"), F.max(place).alias("b"), F.count(F.lit(1)).alias("n"), *more)


def _both(found: DataFrame) -> DataFrame:
    """Both places of what has several."""
    return found.where("n > 1").select("c1", F.explode(F.array("a", "b")).alias("x")).select("x.*", "c1", F.lit(0).alias("kind"))


def dedup_spans(docs: DataFrame, parts: int) -> DataFrame:
    """doc_id, s, e: runs of window starts that occur elsewhere, for docs (doc_id, text) whose ids
    are all different."""
    known = common.durable(_asked(docs, _prepare_anchors, _judge_anchors, _finish_anchors, _KNOWN, parts), "anchors")
    seeming = known.where("kind = 0")
    chunks = common.durable(_copies(seeming.select("doc_id", "s", "e", "c1", "c2", "parts"), F.min_by("parts", F.struct("doc_id", "s", "e")).alias("parts")), "chunks")
    # fragments of chunks that occur once, unless they are part of another chunk that is compared
    inside = chunks.select("a.doc_id", (F.col("n") > 1).alias("paired"), F.explode("parts").alias("p")).select("doc_id", "paired", "p.*")
    loose = _copies(inside, F.max("paired").alias("paired")).where("not paired")
    wanted = _both(chunks).unionByName(_both(loose)).unionByName(known.where("kind > 0").select("doc_id", "s", "e", "c1", "kind"))
    cuts = wanted.groupBy("doc_id").agg(F.collect_list(F.struct("s", "e", "kind", "c1")).alias("cuts"))

    def cut(batches):
        for batch in batches:
            ids, texts = _texts(batch)
            out = [(int(i), c["s"], c["kind"], c["c1"], t[c["s"] : c["e"] + WINDOW]) for i, t, cs in zip(ids, texts, batch.column(2).to_pylist(), strict=True) for c in cs]
            kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.binary())
            columns = list(zip(*out, strict=True)) or [[]] * 5
            yield pa.record_batch([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["doc_id", "s", "kind", "c1", "data"])

    joined = docs.join(cuts.hint("shuffle_hash"), "doc_id").select("doc_id", "text", "cuts")
    pieces = common.durable(common.map_arrow(joined, cut, "doc_id bigint, s bigint, kind int, c1 bigint, data binary"), "fragments")
    crowded = _asked(pieces.where("kind = 2").select("doc_id", "data", "s"), _prepare_windows, _judge_windows, _finish_windows, "doc_id bigint, s bigint, e bigint, c1 bigint, c2 bigint, data binary", parts)
    windows = common.durable(crowded, "windows")
    twice = _both(_copies(windows.where("data is not null")))
    pieces = pieces.where("kind < 2").unionByName(twice.select("doc_id", "s", "kind", "c1", "data"))
    shards = max(1, -(-(pieces.agg(F.sum(F.octet_length("data"))).first()[0] or 0) // SHARD))
    shard = pieces.withColumn("shard", F.pmod(F.xxhash64("c1"), F.lit(shards)))
    compared = common.map_tables(shard, ["shard"], _shard, "doc_id bigint, s bigint, e bigint")
    of = lambda rows: rows.select("doc_id", F.col("s").cast("long").alias("s"), F.col("e").cast("long").alias("e"))
    return of(seeming).unionByName(compared).unionByName(of(windows.where("data is null")))


def covered(spans: list[tuple[int, int]], window: int = WINDOW) -> list[tuple[int, int]]:
    """Maximal byte runs (start, stop) that windows starting in the given runs cover."""
    out: list[list[int]] = []
    for s, e in sorted(spans):
        if out and s <= out[-1][1]:
            out[-1][1] = max(out[-1][1], e + window)
        else:
            out.append([s, e + window])
    return [(a, b) for a, b in out]


def removed_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Of every row of docs: doc_id, n_bytes, spans (maximal removed byte runs in order, stop exclusive)
    and kept (the remaining bytes; a cut may fall inside a character, so they need not be UTF-8)."""
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(64, -(-size // RANGE))
    tasks = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-parts // 2))
    dealt = common.bucketed(rows.withColumn("doc_id", F.monotonically_increasing_id()), "doc_id", tasks, "texts")
    spans = dedup_spans(dealt.select("doc_id", "text"), parts).groupBy("doc_id").agg(F.collect_list(F.struct("s", "e")).alias("spans"))

    def remove(batches):
        for whole in batches:
            for batch in common.slices(whole, 1, BYTES, whole.num_rows):
                out = []
                for text, found in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                    data, at, left = (text or "").encode(), 0, []
                    runs = covered([(x["s"], x["e"]) for x in found or ()])
                    for a, b in runs:
                        left.append(data[at:a])
                        at = b
                    left.append(data[at:])
                    out.append((len(data), [{"start": a, "stop": b} for a, b in runs], b"".join(left)))
                columns = list(zip(*out, strict=True)) or [[]] * 3
                kinds = (pa.int64(), _SPANS, pa.binary())
                yield pa.record_batch([batch.column(0), *[pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]], names=["doc_id", "n_bytes", "spans", "kept"])

    joined = dealt.join(spans.hint("shuffle_hash"), "doc_id", "left").select("id", "text", "spans")
    return common.map_arrow(joined, remove, RESULT)


def suffix_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, touched (was any byte removed) and kept_text
    (the remaining text; pieces of characters that a cut leaves are U+FFFD) of every row of docs."""
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, x: n + x["stop"] - x["start"])
    return removed_repeats(docs, id_col, text_col).select(
        "doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"),
        (F.size("spans") > 0).alias("touched"), F.make_valid_utf8(F.col("kept").cast("string")).alias("kept_text"),
    )
