"""Words, word shingles and MinHash values of many texts at once, in numpy.

A word is a run of letters and digits, lower-cased. A shingle is five words in a row; a text of fewer words has one
shingle, all of them; a text without words has none.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

WORDS = 5
_U = np.uint64


def words_of(texts: pa.Array) -> tuple[np.ndarray, list[str], np.ndarray]:
    """(codes, distinct, offsets): text i has the words distinct[codes[offsets[i]:offsets[i + 1]]]."""
    plain = pc.replace_substring_regex(pc.utf8_lower(pc.fill_null(texts.cast(pa.string()), "")), r"[^\pL\pN]+", " ")
    parts = pc.split_pattern(pc.ascii_trim_whitespace(plain), " ")
    coded = parts.flatten().dictionary_encode()
    codes = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    distinct = coded.dictionary.to_pylist()
    offsets = parts.offsets.to_numpy().astype(np.int64)
    offsets = offsets - offsets[0]
    if "" in distinct:  # the one part of a text without words
        real = codes != distinct.index("")
        offsets = np.concatenate([[0], np.cumsum(real)])[offsets]
        codes = codes[real]
    return codes, distinct, offsets


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit (the finaliser of MurmurHash3)."""
    h = h ^ (h >> _U(33))
    h = h * _U(0xFF51AFD7ED558CCD)
    h = h ^ (h >> _U(33))
    h = h * _U(0xC4CEB9FE1A85EC53)
    return h ^ (h >> _U(33))


def word_hashes(codes: np.ndarray, distinct: list[str]) -> np.ndarray:
    table = np.fromiter((xxhash.xxh64_intdigest(w) for w in distinct), dtype=np.uint64, count=len(distinct))
    return table[codes] if len(codes) else np.zeros(0, dtype=np.uint64)


def shingle_counts(offsets: np.ndarray, words: int = WORDS) -> np.ndarray:
    n = np.diff(offsets)
    return np.where(n == 0, 0, np.maximum(n - words + 1, 1))


def _starts(offsets: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The first word of each shingle, texts in order."""
    before = np.cumsum(counts) - counts
    return np.arange(int(counts.sum())) + np.repeat(offsets[:-1] - before, counts)


def shingle_hashes(hashes: np.ndarray, offsets: np.ndarray, words: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """(64-bit hashes of all shingles, offsets by text), from word hashes."""
    counts = shingle_counts(offsets, words)
    start = _starts(offsets, counts)
    ends = np.repeat(offsets[1:], counts)
    h = np.zeros(len(start), dtype=np.uint64)
    for k in range(words):
        at = start + k
        inside = at < ends
        word = hashes[np.minimum(at, len(hashes) - 1)] if len(hashes) else h
        h = (h * _U(0x9E3779B97F4A7C15)) ^ np.where(inside, word, _U(0))
        h = h ^ (h >> _U(29))
    return mix(h), np.concatenate([[0], np.cumsum(counts)])


def shingle_ids(codes: np.ndarray, offsets: np.ndarray, words: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """(exact numbers of all shingles, offsets by text): two shingles have one number if and only if their words are equal."""
    counts = shingle_counts(offsets, words)
    start = _starts(offsets, counts)
    ends = np.repeat(offsets[1:], counts)
    number = np.zeros(len(start), dtype=np.int64)
    base = int(codes.max()) + 2 if len(codes) else 1
    for k in range(words):
        at = start + k
        word = np.where(at < ends, codes[np.minimum(at, len(codes) - 1)] + 1, 0) if len(codes) else number
        number = np.unique(number * base + word, return_inverse=True)[1].astype(np.int64)
    return number, np.concatenate([[0], np.cumsum(counts)])


def multipliers(count: int, seed: int = 11) -> np.ndarray:
    return np.random.default_rng(seed).integers(0, 2**63, count, dtype=np.uint64) * _U(2) + _U(1)


def minhash(hashes: np.ndarray, offsets: np.ndarray, count: int) -> np.ndarray:
    """MinHash values, (texts x count); texts without shingles get the largest value throughout."""
    texts = len(offsets) - 1
    out = np.full((texts, count), np.iinfo(np.uint64).max, dtype=np.uint64)
    full = np.flatnonzero(np.diff(offsets))
    if len(full):
        starts = offsets[:-1][full]
        for k, m in enumerate(multipliers(count)):
            out[full, k] = np.minimum.reduceat(hashes * m, starts)
    return out
