"""BPE encoding and decoding by dynamic programming over prefixes.

Every prefix of a word has exactly one last token in its encoding. An automaton over the
vocabulary lists the tokens that end at each byte; of those the last token is the one that is
compatible with the (already known) last token of the prefix before it. Two tokens are compatible
when merging their joined bytes would give exactly these two; that is decided from the merge
table alone by walking down both sides of the border. Back-pointers then give the ids, in time
linear in the word, however long it is.

Words come from the tokenizer's own splitting rule. Texts made of plain and Latin letters go
through an equivalent compiled pattern; all others go through the library's pre-tokenizer, so the
ids are those of the library for any text. Special tokens written in a text are kept whole, as the
library does. Null and empty texts have no ids. Rows keep their order within a batch; repeated
rows are encoded alike; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import hashlib
import json
import re

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyfold.llm import common

#: Letters, digits and white space of texts that the compiled pattern may split.
_LETTERS = "A-Za-zÀ-ÖØ-öø-ſ"
_PLAIN = re.compile("[\t\n\r\x20-\x7eÀ-ſ]*")
_WORDS = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{_LETTERS}]+| ?[0-9]+| ?[^\t\n\r {_LETTERS}0-9]+|[\t\n\r ]+(?![^\t\n\r ])|[\t\n\r ]+")
SCHEMA = "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string"


def byte_letters() -> dict[str, int]:
    """The printable letter that stands for each byte in a byte-level vocabulary."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class Remembered(dict):
    """Values of make() by key; forgets all of them when there are more than `room`."""

    def __init__(self, room: int, make):
        super().__init__()
        self.room, self.make = room, make

    def __missing__(self, key):
        if len(self) >= self.room:
            self.clear()
        value = self[key] = self.make(key)
        return value


class PrefixBpe:
    """Encoder and decoder for a byte-level BPE file of the tokenizers library."""

    def __init__(self, path: str, room: int = 400_000):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        letters = byte_letters()
        raw = lambda token: bytes(letters[c] for c in token)
        vocab, merges = spec["model"]["vocab"], spec["model"]["merges"]
        pairs = [m if isinstance(m, list) else m.split(" ") for m in merges]
        # tokens are renumbered by the rank of the merge that makes them: bytes first
        ranked = [t for t in vocab if len(t) == 1 and t in letters] + [a + b for a, b in pairs]
        self.bytes_of = [raw(t) for t in ranked]
        self.id_of = [vocab[t] for t in ranked]
        self._decimal = [str(i) for i in self.id_of]
        number = {t: i for i, t in enumerate(ranked)}
        self.base = len(ranked) - len(pairs)
        self.halves = [(i, i) for i in range(self.base)] + [(number[a], number[b]) for a, b in pairs]
        self.merged = {}
        for i, pair in enumerate(self.halves[self.base :], self.base):
            self.merged.setdefault(pair, i)
        self.automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS)
        for i, b in enumerate(self.bytes_of):
            self.automaton.add_word(b.decode("latin-1"), i)
        self.automaton.make_automaton()
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.by_id = dict(zip(self.id_of, self.bytes_of, strict=True)) | {i: t.encode() for t, i in self.special.items()}
        self._special = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self._fits: dict[tuple[int, int], bool] = {}
        self._whole: dict[int, bool] = {}
        self.known = Remembered(room, self._ids)
        self.decoded = Remembered(room, lambda word: b"".join(map(self.by_id.__getitem__, map(int, self.known[word].split(",")))))
        self._split = None
        self._letter = {b: c for c, b in letters.items()}
        self._byte = letters

    def compatible(self, left: int, right: int) -> bool:
        """Would merging the joined bytes of both tokens leave just this border?"""
        fits = self._fits.get((left, right))
        if fits is None:
            if len(self._fits) > 2_000_000:
                self._fits.clear()
            fits = self._fits[left, right] = self._border_holds(left, right)
        return fits

    def _border_holds(self, left: int, right: int) -> bool:
        # undo merges from the latest to the earliest; any merge across the border that would have
        # come before the one undone last breaks it
        bound = len(self.halves)
        while True:
            across = self.merged.get((left, right))
            if across is not None and across < bound:
                return False
            if left > right:
                if left < self.base:
                    return True
                bound, left = left, self.halves[left][1]
            else:
                if right < self.base:
                    return True
                # on equal ranks the left one is merged first, so a tie at the border counts against it
                bound, right = right + 1, self.halves[right][0]

    def whole(self, token: int) -> bool:
        """Is the token the encoding of its own bytes?"""
        if token < self.base:
            return True
        answer = self._whole.get(token)
        if answer is None:
            left, right = self.halves[token]
            answer = self._whole[token] = self.whole(left) and self.whole(right) and self._first_merge(token) == token
        return answer

    def _first_merge(self, token: int) -> int | None:
        """The token that plain merging makes of the bytes, if it is a single one."""
        parts = [self._single(b) for b in self.bytes_of[token]]
        while len(parts) > 1:
            ranks = [self.merged.get(p, 1 << 40) for p in zip(parts, parts[1:], strict=False)]
            best = min(ranks)
            if best == 1 << 40:
                return None
            out, i = [], 0
            while i < len(parts):
                if i + 1 < len(parts) and self.merged.get((parts[i], parts[i + 1])) == best:
                    out.append(best)
                    i += 2
                else:
                    out.append(parts[i])
                    i += 1
            parts = out
        return parts[0]

    def _single(self, byte: int) -> int:
        if not hasattr(self, "_bytes"):
            self._bytes = {self.bytes_of[i][0]: i for i in range(self.base)}
        return self._bytes[byte]

    def _ids(self, word: str) -> str:
        if word in self.special:
            return str(self.special[word])
        return ",".join([self._decimal[r] for r in self.encode_bytes(word.encode())])

    def encode_bytes(self, word: bytes) -> list[int]:
        """Ranks of the tokens of one word."""
        n = len(word)
        last = [-1] * (n + 1)
        size = self.bytes_of
        for end, token in self.automaton.iter(word.decode("latin-1")):
            end += 1
            if last[end] >= 0:
                continue
            start = end - len(size[token])
            if start == 0:
                if self.whole(token):
                    last[end] = token
            elif last[start] >= 0 and self.compatible(last[start], token) and self.whole(token):
                last[end] = token
        out, at = [], n
        while at > 0:
            out.append(last[at])
            at -= len(size[last[at]])
        return out[::-1]

    def words(self, text: str) -> list[str]:
        """Pre-tokens of a text without special tokens."""
        if _PLAIN.fullmatch(text):
            return _WORDS.findall(text)
        if self._split is None:
            from tokenizers.pre_tokenizers import ByteLevel

            self._split = ByteLevel(add_prefix_space=False, use_regex=True)
        return [bytes(map(self._byte.__getitem__, w)).decode() for w, _ in self._split.pre_tokenize_str(text)]

    def pieces(self, text: str) -> list[str]:
        """Pre-tokens, and special tokens as they stand."""
        if not self._special or "<" not in text or not self._special.search(text):
            return self.words(text)
        out: list[str] = []
        for piece in self._special.split(text):
            out += [piece] if piece in self.special else self.words(piece) if piece else []
        return out

    def encode_text(self, text: str) -> tuple[str, bytes]:
        """The ids as decimal text joined by commas, and the bytes that they decode to."""
        pieces = self.pieces(text)
        return ",".join(map(self.known.__getitem__, pieces)), b"".join(map(self.decoded.__getitem__, pieces))

    def encode(self, text: str) -> list[int]:
        ids = self.encode_text(text)[0]
        return list(map(int, ids.split(","))) if ids else []

    def decode(self, ids: list[int]) -> str:
        return b"".join(map(self.by_id.__getitem__, ids)).decode("utf-8", "replace")


_LOADED: dict[str, PrefixBpe] = {}


def loaded(path: str) -> PrefixBpe:
    """One encoder per Python worker."""
    if path not in _LOADED:
        _LOADED[path] = PrefixBpe(path)
    return _LOADED[path]


def encode_column(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, ids (array of int) and decoded (text) for every row."""

    def run(batches):
        bpe = loaded(path)
        for batch in batches:
            ids = [bpe.encode(t or "") for t in batch.column(1).to_pylist()]
            yield pa.record_batch({"doc_id": batch.column(0), "ids": pa.array(ids, pa.list_(pa.int32())), "decoded": pa.array(map(bpe.decode, ids), pa.string())})

    return common.map_arrow(docs.select(F.col(id_col).cast("long"), F.col(text_col)), run, "doc_id bigint, ids array<int>, decoded string")


def encode_digest(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens and SHA-256 of the decimal ids and of the decoded text."""

    def run(batches):
        bpe = loaded(path)
        for batch in batches:
            count, ids_sha, text_sha = [], [], []
            for i in range(batch.num_rows):
                ids, raw = bpe.encode_text(batch.column(1)[i].as_py() or "")
                decoded = raw.decode("utf-8", "replace").encode()
                count.append(ids.count(",") + 1 if ids else 0)
                ids_sha.append(hashlib.sha256(ids.encode()).hexdigest())
                text_sha.append(hashlib.sha256(decoded).hexdigest())
            yield pa.record_batch({"doc_id": batch.column(0), "n_tokens": pa.array(count, pa.int64()), "ids_sha256": pa.array(ids_sha, pa.string()), "decoded_sha256": pa.array(text_sha, pa.string())})

    return common.map_arrow(docs.select(F.col(id_col).cast("long"), F.col(text_col)), run, SCHEMA)
