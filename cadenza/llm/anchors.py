"""Content anchors of byte strings: the same string of ``WIDTH`` bytes has the same anchor wherever it stands.

A window of WIDTH bytes is owned by one of the K-byte grams inside it, that with the least hash (the first of equals).
The choice depends on the window's bytes alone, so equal windows are owned by equal grams at equal offsets. An anchor owns
a run of windows, and its context is the bytes that those windows cover.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import xxhash

from .shingles import mix

WIDTH, K = 200, 32
_SPAN = WIDTH - K + 1
_U = np.uint64
_POSITION = 24
#: Bytes that are looked at at once; some ten numbers of 8 bytes are held for each.
_PIECE = 1 << 16
_rng = np.random.default_rng(23)
_FACTORS = _rng.integers(0, 2**63, 4, dtype=np.uint64) * _U(2) + _U(1)


@dataclass
class Anchors:
    """Anchors of several texts, in order. A context is data[start:stop]; its first window starts at ``start``."""

    text: np.ndarray
    start: np.ndarray
    stop: np.ndarray
    gram: np.ndarray  # hash of the anchor's gram, int64
    place: np.ndarray  # of the gram, in the data

    def select(self, chosen: np.ndarray) -> Anchors:
        return Anchors(self.text[chosen], self.start[chosen], self.stop[chosen], self.gram[chosen], self.place[chosen])


def loads(data: np.ndarray) -> np.ndarray:
    """The 8 bytes from each place on as a number, most significant first, for all places that have 8."""
    return np.ndarray((max(0, len(data) - 7),), dtype=">u8", buffer=data, strides=(1,)).astype(np.uint64)


def _owners(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(the place of the gram that owns the window at each place, the hashes of all grams) of WIDTH to 2^24 bytes."""
    eight = loads(data)
    n = len(data) - K + 1
    h = eight[:n] * _FACTORS[0]
    for i in range(1, 4):
        h += eight[8 * i : 8 * i + n] * _FACTORS[i]
    h = mix(h)
    key = (h & ~_U((1 << _POSITION) - 1)) | np.arange(n, dtype=np.uint64)
    low, span = key, 1
    while 2 * span <= _SPAN:
        low = np.minimum(low[:-span], low[span:])
        span *= 2
    low = np.minimum(low[: len(data) - WIDTH + 1], low[_SPAN - span : _SPAN - span + len(data) - WIDTH + 1])
    return (low & _U((1 << _POSITION) - 1)).astype(np.int64), h


def find(data: np.ndarray, offsets: np.ndarray) -> Anchors:
    """Anchors of the texts data[offsets[i]:offsets[i + 1]]. Texts under WIDTH bytes have none.

    Owners are found in pieces of _PIECE bytes, each WIDTH - 1 over the next, so that every window lies in one piece. Only
    anchors are kept of a piece: what is held at once does not grow with the texts.
    """
    step = _PIECE - WIDTH + 1
    found: list[tuple[np.ndarray, ...]] = [(np.zeros(0, dtype=np.int64),) * 4]
    before = np.array([-1, -1])  # text and owner of the window before
    for at in range(0, len(data) - WIDTH + 1, step):
        owner, h = _owners(data[at : at + step + WIDTH - 1])
        some = np.arange(np.searchsorted(offsets, at, side="right") - 1, np.searchsorted(offsets, at + len(owner), side="left"))
        low, high = np.maximum(offsets[some], at), np.minimum(offsets[some + 1] - WIDTH + 1, at + len(owner))
        windows = np.maximum(high - low, 0)
        text = np.repeat(some, windows)
        if not len(text):
            continue
        first = np.arange(len(text)) + np.repeat(low - (np.cumsum(windows) - windows), windows)
        owner = owner[first - at]
        new = np.ones(len(text), dtype=bool)
        new[1:] = (owner[1:] != owner[:-1]) | (text[1:] != text[:-1])
        new[0] = text[0] != before[0] or owner[0] + at != before[1]
        before = np.array([text[-1], owner[-1] + at])
        found.append((text[new], first[new], h[owner[new]].view(np.int64), owner[new] + at))
    text, first, gram, place = (np.concatenate(c) for c in zip(*found, strict=True))
    # The last window of an anchor is that before the next one's first, or its text's last.
    stop = offsets[text + 1].astype(np.int64)
    same = text[1:] == text[:-1]
    stop[:-1][same] = first[1:][same] + WIDTH - 1
    return Anchors(text, first, stop, gram, place)


def context_digests(data: np.ndarray, found: Anchors) -> tuple[np.ndarray, np.ndarray]:
    """The two halves of a 128-bit digest of each anchor's context and of the gram's place in it."""
    raw, digest = data.tobytes(), xxhash.xxh3_128_digest
    spots = zip(found.start.tolist(), found.stop.tolist(), (found.place - found.start).tolist(), strict=True)
    halves = np.frombuffer(b"".join([digest(raw[a:b], seed) for a, b, seed in spots]), dtype="<i8").reshape(-1, 2)
    return halves[:, 0].copy(), halves[:, 1].copy()
