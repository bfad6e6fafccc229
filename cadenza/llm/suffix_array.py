"""Suffix arrays of many short strings: Larsson-Sadakane refinement and Kasai common prefixes, in numpy."""

from __future__ import annotations

import numpy as np

from .anchors import loads

_U = np.uint64


class Strings:
    """Strings laid end to end, each followed by one place that no other suffix shares."""

    def __init__(self, parts: list[bytes]):
        sizes = np.array([len(p) for p in parts], dtype=np.int64)
        self.starts = np.cumsum(sizes + 1) - (sizes + 1)
        self.data = np.frombuffer(b"\0".join([*parts, b"\0" * 8]), dtype=np.uint8)[: int((sizes + 1).sum()) + 8]
        self.n = int((sizes + 1).sum())
        self.left = np.repeat(self.starts + sizes, sizes + 1) - np.arange(self.n)  # bytes from a place to its string's end


def suffix_ranks(s: Strings) -> np.ndarray:
    """The rank of each place's suffix. Suffixes stop at their string's end; equal ones are ranked by place.

    Ranks start from 8 bytes, and each round orders those that are still equal by the ranks further on; a suffix alone in
    its rank is done. Up to 2^21 places, three ranks fit a 64-bit key, and a round triples the depth; else it doubles.
    """
    n = s.n
    eight = loads(s.data)[:n]
    avail = np.minimum(s.left, 8)
    eight = np.where(avail > 0, eight >> (_U(8) * (_U(8) - np.maximum(avail, 1).astype(np.uint64))) << (_U(8) * (_U(8) - np.maximum(avail, 1).astype(np.uint64))), _U(0))
    order = np.lexsort((np.where(avail < 8, np.arange(n) + 1, 0), avail, eight))
    new = np.ones(n, dtype=bool)
    full = avail[order] == 8
    new[1:] = (eight[order][1:] != eight[order][:-1]) | ~full[1:] | ~full[:-1]
    first = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    rank = np.empty(n, dtype=np.int64)
    rank[order] = first
    ends = np.append(new[1:], True)
    live = order[~(new & ends)]
    depth, fold, bits = 8, (3 if n < 1 << 21 else 2), (21 if n < 1 << 21 else 31)
    while len(live):
        # A live suffix shares ``depth`` bytes with another, so it reaches no further than its string's end at +depth.
        key = rank[live].astype(np.uint64)
        at, inside = live, np.ones(len(live), dtype=bool)
        for _ in range(1, fold):
            at = at + depth
            inside = inside & (at < n)
            key = (key << _U(bits)) | np.where(inside, rank[np.minimum(at, n - 1)], 0).astype(np.uint64)
        by = np.argsort(key, kind="stable")
        live, key = live[by], key[by]
        old = (key >> _U(bits * (fold - 1))).astype(np.int64)
        new = np.ones(len(live), dtype=bool)
        new[1:] = key[1:] != key[:-1]
        block = np.ones(len(live), dtype=bool)
        block[1:] = old[1:] != old[:-1]
        index = np.arange(len(live))
        rank[live] = old + np.maximum.accumulate(np.where(new, index, 0)) - np.maximum.accumulate(np.where(block, index, 0))
        live = live[~(new & np.append(new[1:], True))]
        depth *= fold
    return rank


def common_prefixes(s: Strings, order: np.ndarray) -> np.ndarray:
    """For each place in suffix order, the bytes that its suffix shares with the one before (0 for the first).

    By Kasai's law the common prefix at a place is at least that at the place before, less one, and just that where both
    suffixes extend to the left by one byte. So only the others are compared, eight bytes at a time.
    """
    n = s.n
    previous = np.full(n, -1, dtype=np.int64)
    previous[order[1:]] = order[:-1]
    place = np.arange(n)
    left_equal = np.zeros(n, dtype=bool)
    inner = (place > 0) & (previous > 0)
    p, q = place[inner] - 1, previous[inner] - 1
    left_equal[inner] = (s.data[p] == s.data[q]) & (s.left[p] > 0) & (s.left[q] > 0) & (previous[p] == q)
    compare = np.flatnonzero(~left_equal & (previous >= 0))
    shared = np.zeros(n, dtype=np.int64)
    eight = loads(s.data)
    a, b, limit = compare, previous[compare], np.minimum(s.left[compare], s.left[previous[compare]])
    done = np.zeros(len(a), dtype=np.int64)
    live = np.flatnonzero(limit > 0)
    while len(live):
        differ = eight[np.minimum(a[live] + done[live], n - 1)] ^ eight[np.minimum(b[live] + done[live], n - 1)]
        equal = np.full(len(live), 8)
        some = differ != 0
        top = np.frexp((differ[some] >> _U(11)).astype(np.float64))[1] + 11
        low = differ[some] >> _U(11) == 0
        top[low] = np.frexp(differ[some][low].astype(np.float64))[1]
        equal[some] = (64 - top) // 8
        done[live] += equal
        live = live[(equal == 8) & (done[live] < limit[live])]
    shared[compare] = np.minimum(done, limit)
    reach = np.maximum.accumulate(np.where(left_equal, 0, shared + place))
    return (reach - place)[order]


def repeated(s: Strings, chosen: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Of the places ``chosen`` (each with ``width`` bytes to its string's end): (whether another chosen place starts the
    same ``width`` bytes, the number of its class of equal strings)."""
    rank = suffix_ranks(s)
    order = np.empty(s.n, dtype=np.int64)
    order[rank] = np.arange(s.n)
    classes = np.cumsum(common_prefixes(s, order) < width)
    mine = classes[rank[chosen]]
    return np.bincount(mine, minlength=1)[mine] > 1 if len(mine) else np.zeros(0, dtype=bool), mine
