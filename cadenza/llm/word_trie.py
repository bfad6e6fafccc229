"""Runs of words in a trie whose nodes hold counts and CRC states.

A word is a run of ASCII digits and letters (A-Z lower-cased) and of characters beyond ASCII. A feature is a run of 1 to
``order`` consecutive words joined by one space; it is a path from the root, and its CRC-32 is its parent's, carried on
over a space and the last word. So each distinct feature's checksum costs one step, however often it occurs.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_IN_WORD = np.zeros(256, dtype=bool)
_IN_WORD[48:58] = _IN_WORD[97:123] = _IN_WORD[128:] = True


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(the UTF-8 bytes of all texts, offsets by text); null counts as empty."""
    texts = pc.fill_null(texts.cast(pa.string()), "")
    _, places, data = texts.buffers()
    if not len(texts) or places is None:
        return np.zeros(0, dtype=np.uint8), np.zeros(len(texts) + 1, dtype=np.int64)
    offsets = np.frombuffer(places, dtype=np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    held = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, dtype=np.uint8)
    return held[offsets[0] : offsets[-1]], offsets - offsets[0]


def runs(inside: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first places of the maximal runs of ``inside`` that do not cross texts, runs before each text)."""
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    heads = offsets[:-1][offsets[:-1] < len(inside)]
    first[heads] |= inside[heads]
    starts = np.flatnonzero(first)
    return starts, np.searchsorted(starts, offsets)


def words_of(texts: pa.Array) -> tuple[np.ndarray, list[bytes], np.ndarray]:
    """(codes, distinct, offsets): text i has the words distinct[codes[offsets[i]:offsets[i + 1]]]."""
    data, places = text_bytes(texts)
    low = _LOWER[data]
    inside = _IN_WORD[low]
    starts, offsets = runs(inside, places)
    kept = np.concatenate([[0], np.cumsum(inside)])
    bounds = np.append(kept[starts], kept[-1]).astype(np.int32)
    words = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(bounds), pa.py_buffer(low[inside])])
    coded = words.dictionary_encode()
    return coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), coded.dictionary.to_pylist(), offsets


class _Level:
    """The nodes of one depth, found by (parent, word)."""

    def __init__(self) -> None:
        self.keys = np.zeros(0, dtype=np.int64)
        self.at = np.zeros(0, dtype=np.int64)
        self.crc = np.zeros(0, dtype=np.uint32)
        self.count = np.zeros(0, dtype=np.int64)

    def nodes(self, keys: np.ndarray, step) -> np.ndarray:
        """The node of each key; new ones get the checksum ``step(key)``."""
        distinct, inverse = np.unique(keys, return_inverse=True)
        fresh = distinct[~np.isin(distinct, self.keys, assume_unique=True)]
        if len(fresh):
            crc = np.fromiter((step(k) for k in fresh.tolist()), dtype=np.uint32, count=len(fresh))
            merged = np.concatenate([self.keys, fresh])
            order = np.argsort(merged, kind="stable")
            self.keys = merged[order]
            self.at = np.concatenate([self.at, len(self.crc) + np.arange(len(fresh))])[order]
            self.crc = np.concatenate([self.crc, crc])
            self.count = np.concatenate([self.count, np.zeros(len(fresh), dtype=np.int64)])
        return self.at[np.searchsorted(self.keys, distinct)][inverse]


class WordTrie:
    """The features of the texts that have been walked, to ``order`` words; forgets all where it has ``most`` nodes, which
    costs work and changes no count that has been taken out by ``totals`` before."""

    def __init__(self, order: int, most: int = 1 << 18):
        self.order, self.most = order, most
        self.clear()

    def clear(self) -> None:
        self.known: dict[bytes, int] = {}
        self.words: list[bytes] = []
        self.levels = [_Level() for _ in range(self.order)]

    def full(self) -> bool:
        return sum(len(level.crc) for level in self.levels) >= self.most

    def walk(self, codes: np.ndarray, distinct: list[bytes], offsets: np.ndarray) -> Iterator[tuple[_Level, np.ndarray, np.ndarray]]:
        """For each length: (level, node of each feature, place of its first word), in order of place."""
        numbers = np.empty(len(distinct), dtype=np.int64)
        for i, w in enumerate(distinct):
            numbers[i] = self.known.setdefault(w, len(self.known))
            if numbers[i] == len(self.words):
                self.words.append(w)
        word = numbers[codes] if len(codes) else codes
        left = np.repeat(offsets[1:], np.diff(offsets)) - np.arange(len(codes))  # words from here to the text's end
        place, parent = np.arange(len(codes)), np.zeros(len(codes), dtype=np.int64)
        for depth, level in enumerate(self.levels):
            if depth:
                last = self.levels[depth - 1]
                step = lambda k, last=last: zlib.crc32(b" " + self.words[k & 0xFFFFFFFF], int(last.crc[k >> 32]))
            else:
                step = lambda k: zlib.crc32(self.words[k])
            going = left[place] > depth
            place, parent = place[going], parent[going]
            parent = level.nodes((parent << 32) | word[place + depth], step)
            yield level, parent, place

    def totals(self, buckets: int) -> np.ndarray:
        """Counts by bucket of checksum."""
        out = np.zeros(buckets, dtype=np.int64)
        for level in self.levels:
            np.add.at(out, level.crc % np.uint32(buckets), level.count)
        return out
