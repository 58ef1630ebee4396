"""Best-fit packing of tokenized documents into sequences of a fixed size.

Every document becomes its token ids and one end id; only documents longer than a sequence are
cut, into full pieces and one rest. Full pieces are sequences by themselves. The rests are dealt
by a hash of the id into groups of bounded size, and each group is packed by best-two-fit: a
sequence is filled greedily with the longest rest that still fits; then its smallest document is
taken out if two unpacked ones fill the widened gap more tightly. A group has tens of thousands of
rests, so that only its last sequences stay open: grouping costs one sequence per group at most
over packing everything at once.

Only lengths matter, so a group is packed on counts by length. Memory is bounded by the group, the
shuffle moves small rows and no text, and a lost executor redoes its own groups. Null and empty
texts are the end id alone. Ties between rests of one length go by id, then by piece. Rows with
equal ids are separate documents. An empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import re
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyfold.llm import common

SEQUENCE = 4096
END = 1
#: Bytes of text that are encoded together.
SLICE = 2 << 20
#: Rests that one group holds on average.
GROUP = 50_000
PIECES = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint"
PACKED = PIECES + ", sequence_id bigint, offset bigint"
# Texts that the compiled pattern may split; all others are encoded by the library as a whole.
_PLAIN = re.compile("[\t\n\r\x20-\x7eÀ-įı-ſ]*")
_LETTERS = "a-zß-öø-ſ"
_WORDS = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTERS}]+|[0-9]|[^\t\n\r {_LETTERS}0-9]+")


class WordTokenizer:
    """Ids of the tokenizers library as little-endian 32-bit bytes, remembered by word."""

    def __init__(self, path: str, room: int = 400_000):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        self.known: dict[str, bytes] = {}
        self.room = room
        # tokens that end a word
        vocabulary = self.library.get_vocab(with_added_tokens=True)
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True

    def _encode(self, text: str) -> bytes:
        return np.asarray(self.library.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _learn(self, words: list[str]) -> None:
        """Encode new words together, with spaces between them, and tell them apart by their last tokens."""
        for at in range(0, len(words), 2000):
            part = words[at : at + 2000]
            ids = self._encode(" ".join(part))
            stop = 4 * (np.flatnonzero(self.ends[np.frombuffer(ids, "<u4")]) + 1)
            if len(stop) == len(part) and stop[-1] == len(ids):
                self.known.update(zip(part, (ids[a:b] for a, b in zip([0, *stop[:-1].tolist()], stop.tolist(), strict=True)), strict=True))
            else:
                self.known.update((w, self._encode(w)) for w in part)

    def all_ids(self, texts: list[str]) -> list[bytes]:
        # white space and letter case need no further care in plain texts; "<|" may start a special token
        split = [_WORDS.findall(t.lower()) if "<|" not in t and _PLAIN.fullmatch(t) else None for t in texts]
        words = set().union(*(x for x in split if x))
        new = words.difference(self.known)
        if len(self.known) + len(new) > self.room:
            self.known.clear()
            new = words
        self._learn(sorted(new))
        of = self.known.__getitem__
        return [self._encode(t) if x is None else b"".join(map(of, x)) for t, x in zip(texts, split, strict=True)]


_LOADED: dict[str, WordTokenizer] = {}


def token_pieces(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", size: int = SEQUENCE, end: int = END) -> DataFrame:
    """One row per piece of each document; columns as in PIECES."""

    def run(batches):
        if path not in _LOADED:
            _LOADED[path] = WordTokenizer(path)
        tokenizer, tail = _LOADED[path], end.to_bytes(4, "little")
        for batch in (part for whole in batches for part in common.slices(whole, 1, SLICE, whole.num_rows)):
            rows: list[tuple] = []
            ids = batch.column(0).to_pylist()
            for i, found in enumerate(tokenizer.all_ids([t or "" for t in batch.column(1).to_pylist()])):
                data = memoryview(found + tail)
                total = len(data) // 4
                for k, at in enumerate(range(0, total, size)):
                    upto = min(at + size, total)
                    rows.append((ids[i], k, at, upto - at, zlib.crc32(data[4 * at : 4 * upto])))
            columns = list(zip(*rows, strict=True)) or [[]] * 5
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            yield pa.record_batch([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return common.map_arrow(docs.select(F.col(id_col).cast("long"), F.col(text_col)), run, PIECES)


def best_two_fit(lengths, size: int) -> list[list[int]]:
    """Bins of lengths (each at most size), every given length used once."""
    left = [0] * (size + 1)
    for n in lengths:
        left[n] += 1
    there = 0  # bit n is set if a length n is left
    for n, c in enumerate(left):
        if c:
            there |= 1 << n

    def take(n: int) -> None:
        nonlocal there
        left[n] -= 1
        if not left[n]:
            there &= ~(1 << n)

    def put(n: int) -> None:
        nonlocal there
        left[n] += 1
        there |= 1 << n

    def longest(gap: int) -> int:
        """The longest length left that fits, 0 if none does."""
        return (there & ((1 << (gap + 1)) - 1)).bit_length() - 1 if gap > 0 and there & ((1 << (gap + 1)) - 1) else 0

    def tightest_pair(gap: int, over: int) -> tuple[int, int] | None:
        """Two lengths left with over < sum <= gap, of the largest sum."""
        best, found = over, None
        a = longest(gap - 1)
        while a * 2 > best:
            b = min(longest(gap - a), a)
            if b == a and left[a] < 2:
                b = longest(a - 1)
            if b and a + b > best:
                best, found = a + b, (a, b)
                if best == gap:
                    break
            a = longest(a - 1)
            if not a:
                break
        return found

    bins: list[list[int]] = []
    while there:
        bin_, gap = [], size
        while n := longest(gap):
            take(n)
            bin_.append(n)
            gap -= n
        if gap and there:
            small = bin_[-1]
            if pair := tightest_pair(gap + small, small):
                bin_.pop()
                put(small)
                for n in pair:
                    take(n)
                    bin_.append(n)
        bins.append(bin_)
    return bins


def pack(pieces: DataFrame, n_docs: int, size: int = SEQUENCE, group: int = GROUP) -> DataFrame:
    """pieces with sequence_id and offset."""
    groups = max(1, -(-n_docs // group))

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["doc_id", "piece", "start", "ids_crc32"], kind="stable").reset_index(drop=True)
        length = rows["length"].to_numpy()
        sequence, offset = np.empty(len(rows), np.int64), np.zeros(len(rows), np.int64)
        whole = np.flatnonzero(length == size)
        sequence[whole] = np.arange(len(whole))
        rest = np.flatnonzero(length < size)
        by_length = rest[np.argsort(length[rest], kind="stable")]
        at = np.searchsorted(length[by_length], np.arange(size + 1))
        slots = at.tolist()
        for k, bin_ in enumerate(best_two_fit(length[rest].tolist(), size)):
            place = 0
            for n in bin_:
                i = by_length[slots[n]]
                slots[n] += 1
                sequence[i], offset[i] = len(whole) + k, place
                place += n
        rows["sequence_id"] = (rows["grp"].to_numpy(np.int64) << 40) + sequence
        rows["offset"] = offset
        return rows.drop(columns="grp")

    dealt = pieces.withColumn("grp", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(groups)))
    return common.map_groups(dealt, ["grp"], run, PACKED)


def packed_documents(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", size: int = SEQUENCE, end: int = END) -> DataFrame:
    return pack(token_pieces(docs, path, id_col, text_col, size, end), docs.count(), size)
