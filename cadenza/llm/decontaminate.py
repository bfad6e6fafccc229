"""Benchmark decontamination: shared n-grams find candidate passages, Smith-Waterman alignment scores them.

An alignment of an item of n words that scores t or more has m >= t n + e / 2 matched words at e edits, in at most e + 1
runs; as m <= n, there are at most 2 (1 - t) n edits. So

1. it lies in n + 2 (1 - t) n words of the document;
2. at least (2 t - 1) n - 1 of the item's 2-grams are intact in it. Where that is not over 0 (items of 5 words at t = 0.6),
   single words take their place, of which there are at least t n;
3. with M of the item's words and B of its 2-grams anywhere in a passage, no alignment there earns over (M + B + 1) / 2.

Documents are scanned against the benchmark's grams; passages that meet 1 and 2 for an item are kept as they are, and those
that meet 3 are aligned. No bound loses an alignment of the threshold or more, and grams are not ranked or sampled.

The benchmark is broadcast in parts of at most about PART words, for each of which the documents are scanned once. Nothing
that grows with the documents is broadcast or collected.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import body, materialize, without_ids
from .shingles import mix, word_hashes, words_of
from .tokens import slices

#: Words of a part of the benchmark (more where one item is longer), and of a piece of a document (pieces overlap by what an
#: alignment can reach).
PART, PIECE = 1 << 16, 1 << 14
#: Words of passages and items, padded, that are aligned at once.
TOGETHER = 1 << 18
MATCH, MISMATCH, GAP = 1.0, -0.5, -0.5
_FACTOR = np.uint64(0x9E3779B97F4A7C15)


def _coded(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(word hashes as int64, their offsets)."""
    codes, distinct, offsets = words_of(texts)
    return word_hashes(codes, distinct).view(np.int64), offsets


def _pairs(words: np.ndarray) -> np.ndarray:
    """The hash of each word with the next."""
    w = words.view(np.uint64)
    return mix((w[:-1] * _FACTOR) ^ w[1:]).view(np.int64)


def coded_items(benchmark: DataFrame, item_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """item and words (hashes) of the benchmark's items that have words."""
    schema = pa.schema([("item", pa.int64()), ("words", pa.list_(pa.int64()))])

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words, offsets = _coded(batch.column(1))
            lists = pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(words))
            yield pa.RecordBatch.from_arrays([batch.column(0), lists], schema=schema).filter(pa.array(np.diff(offsets) > 0))

    rows = benchmark.select(F.col(item_col).cast("bigint").alias("item"), body(text_col).alias("text"))
    return rows.mapInArrow(code, "item bigint, words array<bigint>").distinct()


@dataclass
class Index:
    """A part of the benchmark: its items, their words and bounds, and by gram length (1, 2) where its grams are."""

    item: list[int | None]
    words: list[np.ndarray]
    gram: np.ndarray  # the length of the grams that find an item
    need: np.ndarray  # so many of them are in an alignment that reaches the threshold
    span: np.ndarray  # in so many words of the document
    grams: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]  # distinct grams, the places of their owners, owners


def index_of(item: list[int | None], words: list[np.ndarray], threshold: float) -> Index:
    n = np.array([len(w) for w in words], dtype=np.int64)
    intact = (2 * threshold - 1) * n - 1
    gram = np.where(intact > 1e-9, 2, 1)
    need = np.maximum(1, np.ceil(np.where(gram == 2, intact, threshold * n) - 1e-9)).astype(np.int64)
    span = n + np.floor(2 * max(0.0, 1 - threshold) * n + 1e-9).astype(np.int64)
    grams = {}
    for length in (1, 2):
        of = np.flatnonzero(gram == length)
        keys = [words[i] if length == 1 else _pairs(words[i]) for i in of]
        flat = np.concatenate([np.zeros(0, dtype=np.int64), *keys])
        order = np.argsort(flat, kind="stable")
        distinct, first = np.unique(flat[order], return_index=True)
        grams[length] = distinct, np.append(first, len(flat)), np.repeat(of, np.array([len(k) for k in keys], dtype=np.int64))[order]
    return Index(item, words, gram, need, span, grams)


def _pieces(offsets: np.ndarray, overlap: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, first word, end word) of overlapping pieces of texts; each run of ``overlap`` words is in one whole."""
    step = max(PIECE, 2 * overlap) - overlap
    sizes = np.diff(offsets)
    count = np.where(sizes > 0, np.maximum(1, -(-(sizes - overlap) // step)), 0)
    text = np.repeat(np.arange(len(sizes)), count)
    number = np.arange(len(text)) - np.repeat(np.cumsum(count) - count, count)
    first = offsets[:-1][text] + number * step
    return text, first, np.minimum(first + step + overlap, offsets[1:][text])


def _ranges(first: np.ndarray, count: np.ndarray) -> np.ndarray:
    """first[i], first[i] + 1, ... (count[i] numbers) for each i, in order."""
    return np.arange(int(count.sum())) + np.repeat(first - (np.cumsum(count) - count), count)


def candidates(words: np.ndarray, offsets: np.ndarray, index: Index, threshold: float) -> Iterator[tuple[int, int, int, int]]:
    """(text, item, first word, end word) of the passages where an alignment may reach the threshold."""
    text, first, end = _pieces(offsets, int(index.span.max(initial=0)))
    for length, (distinct, owners_at, owners) in index.grams.items():
        if not len(distinct) or len(words) < length:
            continue
        keys = words if length == 1 else _pairs(words)
        where = np.minimum(np.searchsorted(distinct, keys), len(distinct) - 1)
        at = np.flatnonzero(distinct[where] == keys)
        low, high = np.searchsorted(at, first), np.searchsorted(at, end - length + 1)
        count = np.maximum(high - low, 0)
        pos, piece = at[_ranges(low, count)], np.repeat(np.arange(len(first)), count)
        of = where[pos]
        count = owners_at[of + 1] - owners_at[of]
        owner = owners[_ranges(owners_at[of], count)]
        pos, piece = np.repeat(pos, count), np.repeat(piece, count)
        order = np.lexsort((pos, owner, piece))
        pos, piece, owner = pos[order], piece[order], owner[order]
        last = np.arange(len(pos)) + index.need[owner] - 1
        held = last < len(pos)
        last = np.minimum(last, len(pos) - 1)
        held &= (piece[last] == piece) & (owner[last] == owner) & (pos[last] - pos < index.span[owner])
        pos, piece, owner = pos[held], piece[held], owner[held]
        left, right = np.maximum(pos - index.span[owner], first[piece]), np.minimum(pos + index.span[owner], end[piece])
        new = np.ones(len(pos), dtype=bool)
        new[1:] = (piece[1:] != piece[:-1]) | (owner[1:] != owner[:-1]) | (left[1:] > right[:-1])
        group = np.flatnonzero(new)
        for a, b in zip(group, np.append(group, len(pos))[1:] - 1, strict=True):
            item, part = index.words[owner[a]], words[left[a] : right[b]]
            m = int(np.isin(item, part).sum())
            least = threshold * len(item) - 1e-9
            if m >= least and (length == 1 or m + int(np.isin(_pairs(item), _pairs(part)).sum()) + 1 >= 2 * least):
                yield int(text[piece[a]]), int(owner[a]), int(left[a]), int(right[b])


def _best(a: np.ndarray, na: np.ndarray, b: np.ndarray, nb: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(best local alignment score, words of ``a`` up to its end) for each row of the padded word arrays ``a`` and ``b``."""
    rows, width = b.shape
    inside = np.arange(width)[None, :] < nb[:, None]
    slope = -GAP * np.arange(width, dtype=np.float32)[None, :]
    h = np.zeros((rows, width), dtype=np.float32)
    score, end = np.zeros(rows, dtype=np.float32), np.zeros(rows, dtype=np.int64)
    for i in range(a.shape[1]):
        diagonal = np.zeros_like(h)
        diagonal[:, 1:] = h[:, :-1]
        diagonal += np.where((a[:, i : i + 1] == b) & inside, np.float32(MATCH), np.float32(MISMATCH))
        best = np.maximum(np.maximum(diagonal, h + np.float32(GAP)), 0)
        h = np.maximum.accumulate(best + slope, axis=1) - slope
        top = np.where((i < na)[:, None] & inside, h, 0).max(axis=1)
        more = top > score
        score[more], end[more] = top[more], i + 1
    return score, end


def _padded(arrays: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    n = np.array([len(x) for x in arrays])
    out = np.zeros((len(arrays), int(n.max())), dtype=np.int64)
    for i, x in enumerate(arrays):
        out[i, : len(x)] = x
    return out, n


def align(texts: list[np.ndarray], items: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(score as a share of the item, first word, end word) of the best local alignment of each pair of word arrays."""
    a, na = _padded(texts)
    b, nb = _padded(items)
    score, end = _best(a, na, b, nb)
    back, _ = _padded([x[:e][::-1] if e else x[:1] for x, e in zip(texts, end, strict=True)])
    turned, _ = _padded([x[::-1] for x in items])
    _, length = _best(back, np.maximum(end, 1), turned, nb)
    return score / (MATCH * nb), end - length, end


def _together(found: list[tuple[int, int, int, int]], index: Index) -> Iterator[list[tuple[int, int, int, int]]]:
    """Candidates in runs whose padded passages and items take about TOGETHER words, one at least."""
    some: list[tuple[int, int, int, int]] = []
    most = 0
    for c in found:
        size = max(most, c[3] - c[2] + len(index.words[c[1]]))
        if some and size * (len(some) + 1) > TOGETHER:
            yield some
            some, size = [], c[3] - c[2] + len(index.words[c[1]])
        some.append(c)
        most = size
    if some:
        yield some


def _alignments(docs: DataFrame, index: Index, threshold: float, id_col: str, text_col: str) -> DataFrame:
    """doc_id, item, score, first and end (words of the document) of the alignments that reach the threshold."""
    shared = docs.sparkSession.sparkContext.broadcast(index)
    schema = pa.schema([("doc_id", pa.int64()), ("item", pa.int64()), ("score", pa.float64()), ("first", pa.int64()), ("end", pa.int64())])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = shared.value
        for batch in batches:
            for at, n in slices(batch.column(1), 4 << 20):
                part = batch.slice(at, n)
                words, offsets = _coded(part.column(1))
                ids = part.column(0).to_pylist()
                found = sorted(candidates(words, offsets, index, threshold), key=lambda c: c[3] - c[2] + len(index.words[c[1]]))
                for some in _together(found, index):
                    share, first, end = align([words[a:b] for _, _, a, b in some], [index.words[w] for _, w, _, _ in some])
                    start = np.array([a - offsets[d] for d, _, a, _ in some])
                    keep = np.flatnonzero(share >= threshold)
                    columns = [ids[some[i][0]] for i in keep], [index.item[some[i][1]] for i in keep], share[keep], (first + start)[keep], (end + start)[keep]
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), body(text_col).alias("text"))
    return rows.mapInArrow(scan, "doc_id bigint, item bigint, score double, first bigint, end bigint")


def leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", threshold: float = 0.6) -> DataFrame:
    """The pairs of documents and benchmark items of which the document holds a copy, whole or edited.

    Columns: ``id_col``, ``item_col``, score (at least ``threshold``), start_word, end_word (the place of the best
    alignment, in words of the document). One row for each pair: of its alignments the one with the highest score, of
    equals the first that ends (in one passage) and starts (among passages).

    A word is a lower-cased run of letters and digits. A match earns 1; a replaced, added or missing word costs 0.5; the
    score is the sum over the item's words, whatever its length. Items without words match nothing, as do null texts,
    which are empty; texts of any length are scanned whole, in overlapping pieces. Repeated rows give one row; rows of one
    id count together; rows with a null id appear with a null id; empty tables give no rows. Other columns are not read.
    """
    items = materialize(coded_items(benchmark, item_col, item_text_col), "items")
    parts = max(1, -(-(items.agg(F.sum(F.size("words"))).first()[0] or 0) // PART))
    scored = []
    for k in range(parts):
        rows = items.where(F.pmod(F.xxhash64("item", "words"), F.lit(parts)) == k).select("item", "words").toArrow()
        index = index_of(rows["item"].to_pylist(), [w.values.to_numpy() for w in rows["words"]], threshold)
        scored.append(_alignments(docs, index, threshold, id_col, text_col))
    scored = reduce(DataFrame.unionByName, scored)
    best = scored.groupBy("doc_id", "item").agg(F.max(F.struct("score", -F.col("first"), "end")).alias("b"))
    return best.select(F.col("doc_id").alias(id_col), F.col("item").alias(item_col), F.col("b.score").alias("score"), (-F.col("b.col2")).alias("start_word"), F.col("b.end").alias("end_word"))


def keep_clean(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.6) -> DataFrame:
    """The rows of ``docs`` that hold no copy of a benchmark item, with all their columns. Rows with a null id stay."""
    return without_ids(docs, leaks(docs, benchmark, id_col, text_col, threshold=threshold), id_col)
