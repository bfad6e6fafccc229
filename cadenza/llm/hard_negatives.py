"""Hard negatives of labelled vectors, by exact inner products behind a rotation onto principal axes.

All vectors are turned by one orthogonal matrix, whose first axes hold most of their energy. A block of vectors is held
against a block of anchors component group by component group: after the leading ones, what the rest can add to a product
is bounded by the lengths of both remainders (Cauchy-Schwarz) and by the slack of rounding. Pairs whose bounds cannot
reach what an anchor already has are dropped; the products of the others are taken over whole numbers.

Anchors come in batches of bounded size; every batch meets all vectors in two passes, one for positives and one for
negatives, in which Spark deals out the vectors and merges each task's best few.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize

#: Vectors, and anchors, that are held against each other at once.
ROWS, ANCHORS = 1024, 512
#: Shares of the components after which bounds are taken.
STEPS = (0.125, 0.25, 0.5)
#: Where more than this share of the pairs is alive, the next components are added for all of them at once.
DENSE = 0.2
_NONE = np.iinfo(np.int64).min


@dataclass
class Best:
    """The first ``keep`` (score, id) of each group, the highest scores first and then the smallest ids."""

    groups: int
    keep: int

    def __post_init__(self) -> None:
        self.group, self.score, self.name = (np.zeros(0, dtype=np.int64) for _ in range(3))
        #: The least score that still matters for a group: that of its last place.
        self.floor = np.full(self.groups, _NONE)

    def add(self, group: np.ndarray, score: np.ndarray, name: np.ndarray) -> None:
        if not len(group):
            return
        group, score, name = (np.concatenate(x) for x in ((self.group, group), (self.score, score), (self.name, name)))
        order = np.lexsort((name, -score, group))
        group, score, name = group[order], score[order], name[order]
        heads = np.flatnonzero(np.diff(group, prepend=-1))
        place = np.arange(len(group)) - np.repeat(heads, np.diff(np.append(heads, len(group))))
        kept = place < self.keep
        self.group, self.score, self.name = group[kept], score[kept], name[kept]
        last = place == self.keep - 1
        self.floor[group[last]] = np.maximum(self.floor[group[last]], score[last])


class Rotated:
    """Whole-number vectors, what they are on the principal axes, and the lengths of what is left after each step."""

    def __init__(self, whole: np.ndarray, axes: np.ndarray, cuts: list[int]):
        self.whole = whole
        self.turned = whole.astype(np.float64) @ axes
        squares = self.turned**2
        self.length = np.sqrt(squares.sum(axis=1))
        self.left = [np.sqrt(squares[:, c:].sum(axis=1)) for c in cuts]


def cuts_of(dim: int) -> list[int]:
    return sorted({max(1, math.ceil(dim * s)) for s in STEPS if math.ceil(dim * s) < dim}) if dim > 1 else []


def rounding(axes: np.ndarray) -> float:
    """How far a product on the axes, as computed, may be off, as a share of the product of the lengths."""
    dim = len(axes)
    return float(np.abs(axes.T @ axes - np.eye(dim)).sum()) + 8 * (dim + 4) * 2.0**-52


def survivors(a: Rotated, b: Rotated, cuts: list[int], slack: float, alive: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(i, j): pairs of ``alive`` whose product may lie in low[i]..high[i], by bounds that get closer with each cut."""
    partial, at, pairs = np.zeros((len(a.turned), len(b.turned))), 0, None
    for cut, left_a, left_b in zip(cuts, a.left, b.left, strict=True):
        if pairs is None:
            partial += a.turned[:, at:cut] @ b.turned[:, at:cut].T
            rest = np.outer(left_a, left_b) + slack * np.outer(a.length, b.length)
            alive = alive & (partial + rest >= low[:, None]) & (partial - rest <= high[:, None])
            if alive.mean() <= DENSE:
                pairs = np.nonzero(alive)
                sums = partial[pairs]
        else:
            i, j = pairs
            sums = sums + np.einsum("nd,nd->n", a.turned[i, at:cut], b.turned[j, at:cut])
            rest = left_a[i] * left_b[j] + slack * a.length[i] * b.length[j]
            kept = (sums + rest >= low[i]) & (sums - rest <= high[i])
            pairs, sums = (i[kept], j[kept]), sums[kept]
        at = cut
    return np.nonzero(alive) if pairs is None else pairs


def products(a: np.ndarray, b: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Inner products of whole-number vectors, for pairs of rows."""
    out = np.empty(len(i), dtype=np.int64)
    for at in range(0, len(i), 1 << 15):
        x, y = a[i[at : at + (1 << 15)]], b[j[at : at + (1 << 15)]]
        out[at : at + len(x)] = np.einsum("nd,nd->n", x, y)
    return out


def _matrix(cells: pa.Array, dim: int) -> np.ndarray:
    """Lists of bigint as rows; shorter ones are filled up with zeros."""
    lengths = np.diff(cells.offsets.to_numpy())
    flat = cells.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    if len(flat) == len(cells) * dim:
        return flat.reshape(len(cells), dim)
    out = np.zeros((len(cells), dim), dtype=np.int64)
    row = np.repeat(np.arange(len(cells)), lengths)
    out[row, np.arange(len(flat)) - np.repeat(np.cumsum(lengths) - lengths, lengths)] = flat
    return out


def whole_vectors(rows: DataFrame, scale: int, label: Column, id_col: str, label_col: str, vector_col: str) -> DataFrame:
    """id, label (as ``label`` has it) and v (whole numbers) of the rows that take part."""
    v = F.col(vector_col)
    sound = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    taking = rows.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & v.isNotNull() & sound)
    scaled = F.transform(v, lambda x: F.floor(x.cast("double") * scale))
    return taking.select(F.col(id_col).cast("bigint").alias("id"), label.cast("bigint").alias("label"), scaled.alias("v"))


def axes_of(rows: DataFrame, dim: int) -> np.ndarray:
    """The principal axes of the vectors (columns, those of most energy first): eigenvectors of their second moments, which
    tasks sum over their own rows and Spark over tasks; ``dim`` times ``dim`` sums reach the driver."""

    def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((dim, dim))
        for batch in batches:
            x = _matrix(batch.column(0), dim).astype(np.float64)
            total += x.T @ x
        i, j = np.nonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(i), pa.array(j), pa.array(total[i, j])], names=["i", "j", "s"])

    sums = rows.select("v").mapInArrow(moments, "i bigint, j bigint, s double").groupBy("i", "j").agg(F.sum("s").alias("s")).toPandas()
    matrix = np.zeros((dim, dim))
    matrix[sums["i"], sums["j"]] = sums["s"]
    return np.ascontiguousarray(np.linalg.eigh((matrix + matrix.T) / 2)[1][:, ::-1])


def mine(
    rows: DataFrame, anchors: Column, label: Column | None = None, positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90,
    scale: int = 256, batch_bytes: int = 8 << 20, id_col: str = "vec_id", label_col: str = "label", vector_col: str = "embedding",
) -> DataFrame:
    """Hard negatives of every row for which ``anchors`` (a condition on ``id``) holds, against all rows.

    Columns: anchor_id, positive_id, rank, negative_id, positive_score, negative_score. A component x counts as
    floor(scale * x), and scores are inner products of such vectors, in whole numbers. An anchor's positives are the first
    ``positives`` rows of its label under another id; the negatives of a positive are the first ``negatives`` rows of
    other labels with low * positive_score <= 100 * negative_score <= high * positive_score. Higher scores come first, then smaller
    ids. ``label`` is an expression over the columns of ``rows``, the label column as it is where it is None.

    Rows with a null id, label or vector, or a component that is null or not finite, take no part. Repeated rows count as
    often as they occur, and each repeat of an anchor has its own result. Vectors are filled up with zeros to the longest
    one; empty vectors score 0. Positives that no negative fits have no row; other columns are not read; an empty table
    gives no rows. Scores beyond 63 bits raise ValueError.

    Batches of anchors take about ``batch_bytes`` each, and are all that the driver and a task hold of them.
    """
    spark = rows.sparkSession
    held = materialize(whole_vectors(rows, scale, F.col(label_col) if label is None else label, id_col, label_col, vector_col), "whole-vectors")
    schema = "anchor_id bigint, positive_id bigint, rank int, negative_id bigint, positive_score bigint, negative_score bigint"
    size = held.agg(F.max(F.size("v")).alias("dim"), F.max(F.aggregate("v", F.lit(0.0), lambda m, x: F.greatest(m, F.abs(x.cast("double"))))).alias("top")).first()
    dim = size["dim"] or 0
    if dim * (size["top"] or 0.0) ** 2 * max(100, low, high) >= 2.0**63:
        raise ValueError("scores do not fit 63 bits")
    if not dim and not held.where(anchors).count():
        return spark.createDataFrame([], schema)
    dim = max(dim, 1)
    axes, cuts = axes_of(held, dim), cuts_of(dim)
    slack = rounding(axes)

    chosen = held.where(anchors)
    per_batch = max(1, batch_bytes // (24 * dim))
    parts = max(1, math.ceil(chosen.count() / per_batch))
    part = F.pmod(F.xxhash64("id"), F.lit(parts))
    chosen = materialize(chosen.withColumn("part", part), "anchors")
    found = []
    for p in range(parts):
        table = chosen.where(F.col("part") == p).sort("id", "label", "v").toArrow()
        if not table.num_rows:
            continue
        ids, labels = (table.column(c).to_numpy().astype(np.int64) for c in ("id", "label"))
        whole = _matrix(table.column("v").combine_chunks(), dim)
        best = materialize(_positives(held, ids, labels, whole, axes, cuts, slack, positives), "positives")
        near = best.toPandas().sort_values(["a", "place"])
        found.append(materialize(_negatives(held, near, labels, whole, axes, cuts, slack, negatives, low, high), "negatives").join(
            F.broadcast(spark.createDataFrame([(int(a), int(i)) for a, i in enumerate(ids)], "a bigint, anchor_id bigint")), "a"))
    out = spark.createDataFrame([], schema)
    for f in found:
        out = out.unionByName(f.select("anchor_id", "positive_id", F.col("place").cast("int").alias("rank"), F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score")))
    return out


def _blocks(batches: Iterator[pa.RecordBatch], axes: np.ndarray, cuts: list[int]) -> Iterator[tuple[np.ndarray, np.ndarray, Rotated]]:
    for batch in batches:
        for at in range(0, batch.num_rows, ROWS):
            part = batch.slice(at, ROWS)
            ids, labels = (part.column(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in (0, 1))
            yield ids, labels, Rotated(_matrix(part.column(2), len(axes)), axes, cuts)


def _first(rows: DataFrame, keys: list[str], keep: int) -> DataFrame:
    """The first ``keep`` rows of each key, with place (from 1); a task has given ``keep`` of each key at most."""
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("score"), "id"))
    return rows.withColumn("place", place).where(F.col("place") <= keep)


def _positives(held: DataFrame, ids, labels, whole, axes, cuts, slack, keep: int) -> DataFrame:
    """a (the anchor's number), id, score, place: each anchor's positives."""

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = Best(len(ids), keep)
        groups = [(at, Rotated(whole[at : at + ANCHORS], axes, cuts)) for at in range(0, len(ids), ANCHORS)]
        for names, kinds, block in _blocks(batches, axes, cuts):
            for at, group in groups:
                mine = slice(at, at + len(group.whole))
                fits = (labels[mine, None] == kinds[None, :]) & (ids[mine, None] != names[None, :])
                if not fits.any():
                    continue
                floor = best.floor[mine].astype(np.float64)
                i, j = survivors(group, block, cuts, slack, fits, floor, np.full(len(floor), np.inf))
                score = products(group.whole, block.whole, i, j)
                kept = score >= best.floor[at + i]
                best.add(at + i[kept], score[kept], names[j[kept]])
        yield pa.RecordBatch.from_arrays([pa.array(best.group), pa.array(best.name), pa.array(best.score)], names=["a", "id", "score"])

    return _first(held.select("id", "label", "v").mapInArrow(search, "a bigint, id bigint, score bigint"), ["a"], keep)


def _negatives(held: DataFrame, near, labels, whole, axes, cuts, slack, keep: int, low: int, high: int) -> DataFrame:
    """a, positive_id, positive_score, id, score, place: the negatives of each anchor and positive (``near``)."""
    # One window of scores for each anchor and positive: number, anchor, first and last score.
    anchor, positive, score = (near[c].to_numpy(dtype=np.int64) for c in ("a", "id", "score"))
    first, last = -(-low * score // 100), high * score // 100
    counts = np.bincount(anchor, minlength=len(labels))
    begin = np.cumsum(counts) - counts
    some = np.flatnonzero(counts)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = Best(len(anchor), keep)
        groups = [(some[at : at + ANCHORS], Rotated(whole[some[at : at + ANCHORS]], axes, cuts)) for at in range(0, len(some), ANCHORS)]
        for _, kinds, block, names in ((None, k, b, n) for n, k, b in _blocks(batches, axes, cuts)):
            for mine, group in groups:
                wanted = np.maximum(first, best.floor)
                least = np.minimum.reduceat(wanted, begin[some])[np.searchsorted(some, mine)].astype(np.float64)
                most = np.maximum.reduceat(last, begin[some])[np.searchsorted(some, mine)].astype(np.float64)
                i, j = survivors(group, block, cuts, slack, labels[mine, None] != kinds[None, :], least, most)
                got = products(group.whole, block.whole, i, j)
                # Each product is held against the windows of its anchor.
                times = counts[mine[i]]
                pair = np.repeat(np.arange(len(i)), times)
                window = begin[mine[i]][pair] + np.arange(len(pair)) - np.repeat(np.cumsum(times) - times, times)
                kept = (got[pair] >= wanted[window]) & (got[pair] <= last[window])
                best.add(window[kept], got[pair[kept]], names[j[pair[kept]]])
        w = best.group
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in (w, anchor[w], positive[w], score[w], best.name, best.score)], names=["w", "a", "positive_id", "positive_score", "id", "score"])

    schema = "w bigint, a bigint, positive_id bigint, positive_score bigint, id bigint, score bigint"
    return _first(held.select("id", "label", "v").mapInArrow(search, schema), ["w"], keep).drop("w")
