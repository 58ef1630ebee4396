"""Suffix arrays by induced sorting, and permuted common prefixes.

Suffixes are classified by whether they are smaller or larger than their right neighbour; the
leftmost-smaller substrings are ranked by their packed symbols, and (if ranks repeat) the text of
ranks is sorted by recursion; the whole array is then induced from them in linear time. Over a byte
alphabet whole buckets are induced at once with NumPy: of a bucket only what stays in the same
bucket needs another round, everything else is scattered together. The recursion, with its wide
alphabets, runs over plain lists.
"""

from __future__ import annotations

import numpy as np

#: Alphabets up to this size are induced by whole buckets.
WIDE = 1024


def _smaller(text: np.ndarray) -> np.ndarray:
    """True where a suffix is smaller than its right neighbour; the last one (the end mark) is."""
    n = len(text)
    differs = np.empty(n, bool)
    differs[:-1] = text[:-1] != text[1:]
    differs[-1] = True
    rises = np.empty(n, bool)
    rises[:-1] = text[:-1] < text[1:]
    rises[-1] = True
    nearest = np.where(differs, np.arange(n), n)
    nearest = np.minimum.accumulate(nearest[::-1])[::-1]
    return rises[nearest]


def _induce_buckets(text: np.ndarray, smaller: np.ndarray, size: int, seeds: np.ndarray) -> np.ndarray:
    """The array induced from leftmost-smaller positions given in their order."""
    n = len(text)
    count = np.bincount(text, minlength=size)
    end = np.cumsum(count)
    start = end - count
    array = np.full(n, -1, np.int64)
    seed_count = np.bincount(text[seeds], minlength=size)
    order = np.argsort(text[seeds], kind="stable")
    seed_first = end - seed_count
    own = text[seeds][order]
    array[seed_first[own] + np.arange(len(own)) - (np.cumsum(seed_count) - seed_count)[own]] = seeds[order]

    def spread(sources: np.ndarray, fill: np.ndarray, c: int, small: bool) -> None:
        """Put the left neighbours of sources (in scan order) that belong to buckets other than c."""
        left = sources[sources > 0] - 1
        chars = text[left]
        keep = (smaller[left] == small) & (chars != c)
        left, chars = left[keep], chars[keep]
        if not len(left):
            return
        by = np.argsort(chars, kind="stable")
        left, chars = left[by], chars[by]
        first = np.flatnonzero(np.diff(chars, prepend=-1))
        times = np.diff(np.append(first, len(chars)))
        rank = np.arange(len(chars)) - np.repeat(first, times)
        if small:
            array[fill[chars] - 1 - rank] = left
            fill[chars[first]] -= times
        else:
            array[fill[chars] + rank] = left
            fill[chars[first]] += times

    fill = start.copy()
    for c in np.flatnonzero(count).tolist():
        at = start[c]
        while at < fill[c]:
            batch = array[at : fill[c]]
            at = fill[c]
            left = batch[batch > 0] - 1
            left = left[(text[left] == c) & ~smaller[left]]
            array[at : at + len(left)] = left
            fill[c] = at + len(left)
        spread(np.concatenate([array[start[c] : fill[c]], array[seed_first[c] : end[c]]]), fill, c, False)
    larger_end = fill
    fill = end.copy()
    for c in np.flatnonzero(count)[::-1].tolist():
        at = end[c]
        while at > fill[c]:
            batch = array[fill[c] : at][::-1]
            at = fill[c]
            left = batch[batch > 0] - 1
            left = left[(text[left] == c) & smaller[left]]
            array[at - len(left) : at] = left[::-1]
            fill[c] = at - len(left)
        spread(np.concatenate([array[fill[c] : end[c]][::-1], array[start[c] : larger_end[c]][::-1]]), fill, c, True)
    array[0] = n - 1
    return array


def _induce_lists(text: np.ndarray, smaller: np.ndarray, size: int, seeds: np.ndarray) -> np.ndarray:
    n = len(text)
    count = np.bincount(text, minlength=size)
    end = np.cumsum(count).tolist()
    # of position q: the bucket of q - 1 if that is of the wanted kind; index -1 stands for "nothing here"
    larger = np.full(n + 1, -1)
    larger[1:n] = np.where(smaller[:-1], -1, text[:-1])
    less = np.full(n + 1, -1)
    less[1:n] = np.where(smaller[:-1], text[:-1], -1)
    larger, less, array = larger.tolist(), less.tolist(), [-1] * n
    fill = end.copy()
    for p, c in zip(seeds[::-1].tolist(), text[seeds[::-1]].tolist(), strict=True):
        fill[c] -= 1
        array[fill[c]] = p
    fill = (np.cumsum(count) - count).tolist()
    for q in array:
        c = larger[q]
        if c >= 0:
            at = fill[c]
            array[at] = q - 1
            fill[c] = at + 1
    fill = end
    for q in reversed(array):
        c = less[q]
        if c >= 0:
            at = fill[c] = fill[c] - 1
            array[at] = q - 1
    array[0] = n - 1
    return np.array(array, np.int64)


def _ranks(text: np.ndarray, places: np.ndarray, following: np.ndarray, size: int) -> np.ndarray:
    """Dense ranks of the leftmost-smaller substrings, each from its place to the next one inclusive.
    Of two of which one begins the other the longer is smaller: the shorter ends in a symbol that is
    smaller than its right neighbour, where the longer one's equal symbol is larger."""
    bits = (size + 1).bit_length()
    per = 62 // bits
    length = following - places

    def packed(which: np.ndarray, at: int) -> np.ndarray:
        key = np.zeros(len(which), np.int64)
        for k in range(at, at + per):
            inside = k <= length[which]
            key = (key << bits) | np.where(inside, text[np.minimum(places[which] + k, len(text) - 1)], size)
        return key

    rank, open_, at = np.zeros(len(places), np.int64), np.arange(len(places)), 0
    while len(open_):
        key = packed(open_, at)
        order = np.lexsort((key, rank[open_])) if at else np.argsort(key, kind="stable")
        open_, key = open_[order], key[order]
        group = rank[open_]
        new_group = np.ones(len(open_), bool)
        new_group[1:] = group[1:] != group[:-1]
        new = new_group.copy()
        new[1:] |= key[1:] != key[:-1]
        # a rank is the number of smaller substrings
        here = np.arange(len(open_))
        first = np.maximum.accumulate(np.where(new, here, 0))
        rank[open_] = group + first - np.maximum.accumulate(np.where(new_group, here, 0))
        at += per
        tied = ~new
        tied[:-1] |= ~new[1:]
        # a substring is told apart from a longer one by the mark behind its end
        open_ = open_[tied & (length[open_] + 1 >= at)]
    present = np.zeros(len(places) + 1, np.int64)
    present[rank] = 1
    return (np.cumsum(present) - 1)[rank]


def suffix_array(text: np.ndarray) -> np.ndarray:
    """Positions of all suffixes in order. The text's last symbol must be 0 and occur only there."""
    text = np.asarray(text, np.int64)
    n = len(text)
    if n < 3:
        return np.arange(n - 1, -1, -1)
    size = int(text.max()) + 1
    smaller = _smaller(text)
    leftmost = np.zeros(n, bool)
    leftmost[1:] = smaller[1:] & ~smaller[:-1]
    places = np.flatnonzero(leftmost)
    induce = _induce_buckets if size <= WIDE else _induce_lists
    order = np.empty(len(places), np.int64)
    ranks = _ranks(text, places, np.append(places[1:], n - 1), size)
    if int(ranks.max()) + 1 < len(places):
        order = suffix_array(ranks)
    else:
        order[ranks] = np.arange(len(places))
    return induce(text, smaller, size, places[order])


def common_prefixes(text: np.ndarray, array: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(before, length): for each position the suffix before it in order (-1 for the first), and
    how many symbols both share. Only positions whose left symbols differ are compared; the others
    share one symbol less than the position to their left."""
    n = len(text)
    before = np.full(n, -1, np.int64)
    before[array[1:]] = array[:-1]
    at = np.arange(n)
    compared = (before <= 0) | (at == 0)
    inner = ~compared
    compared[inner] = text[at[inner] - 1] != text[before[inner] - 1]
    length = np.zeros(n, np.int64)
    # several symbols at a time, the first one lowest; the end mark differs from any other symbol
    bits = int(text.max()).bit_length() or 1
    per = 62 // bits
    packed = np.zeros(n, np.int64)
    for j in range(min(per, n)):
        packed[: n - j] |= text[j:] << (bits * j)
    open_ = np.flatnonzero(compared & (before >= 0))
    k = 0
    while len(open_):
        unlike = packed[open_ + k] ^ packed[before[open_] + k]
        here = unlike != 0
        _, lowest = np.frexp((unlike[here] & -unlike[here]).astype(float))
        length[open_[here]] = k + (lowest - 1) // bits
        open_ = open_[~here]
        k += per
    reach = np.where(compared, length + at, 0)
    return before, np.maximum(np.maximum.accumulate(reach) - at, 0)
