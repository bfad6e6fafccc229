"""Packing of documents into sequences: first-fit decreasing in randomised groups.

A document longer than a sequence is cut into full pieces and a rest; the rests of a group are packed by first-fit
decreasing, the first open sequence with room being found in a tournament tree of free room. Groups are drawn by a hash
of the id and the text, and of the place of rows that are equal many times, so they are alike in make-up, bounded in size
whatever rows repeat, and independent of each other.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import body, materialize
from .tokens import encoder, slices


class RoomTree:
    """Free room of bins in a tournament tree: each inner node holds the most room below it."""

    def __init__(self, bins: int, capacity: int):
        self.leaves = 1 << max(0, bins - 1).bit_length()
        self.room = [capacity] * (2 * self.leaves)

    def place(self, size: int) -> tuple[int, int]:
        """Put ``size`` into the first bin with room for it: (bin, room that it had)."""
        room, node = self.room, 1
        while node < self.leaves:
            node *= 2
            if room[node] < size:
                node += 1
        had, found = room[node], node - self.leaves
        room[node] = had - size
        while node > 1:
            node //= 2
            left, right = room[2 * node], room[2 * node + 1]
            room[node] = left if left > right else right
        return found, had


def first_fit_decreasing(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """(bin, offset) of each size, all at most ``capacity``; equal sizes keep their order."""
    bins, offsets = np.zeros(len(sizes), dtype=np.int64), np.zeros(len(sizes), dtype=np.int64)
    tree = RoomTree(len(sizes), capacity)
    for i in np.argsort(-sizes, kind="stable").tolist():
        bins[i], had = tree.place(int(sizes[i]))
        offsets[i] = capacity - had
    return bins, offsets


#: Bytes of text that are encoded at once, and of words whose ids a worker keeps.
ENCODED = 4 << 20
PIECE_SCHEMA = "doc_id bigint, start bigint, length bigint, doc_tokens bigint, ids binary, sequence_id bigint, offset bigint"
_FIELDS = [("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("doc_tokens", pa.int64()), ("ids", pa.binary()), ("sequence_id", pa.int64()), ("offset", pa.int64())]


class _Group:
    """The rests of one group, held until all have been seen; full pieces are numbered as they are cut."""

    def __init__(self, number: int, length: int):
        self.base, self.length, self.full, self.rests = number << 32, length, 0, []

    def cut(self, doc_id: int | None, doc: np.ndarray) -> Iterator[tuple]:
        """The full pieces of a document."""
        whole = len(doc) // self.length * self.length
        for start in range(0, whole, self.length):
            yield doc_id, start, self.length, len(doc), doc[start : start + self.length].tobytes(), self.base + self.full, 0
            self.full += 1
        if whole < len(doc):
            self.rests.append((doc_id, whole, len(doc) - whole, len(doc), doc[whole:].tobytes()))

    def packed(self) -> list[tuple]:
        bins, offsets = first_fit_decreasing(np.array([r[2] for r in self.rests], dtype=np.int64), self.length)
        return [(*r, self.base + self.full + int(b), int(o)) for r, b, o in zip(self.rests, bins, offsets, strict=True)]


def _grouped(rows: DataFrame, groups: int, group_docs: int, seed: int, broadcast_rows: int = 100_000) -> DataFrame:
    """``rows`` (doc_id, text) with __text (a hash of the text) and __group. Rows go by id and text; where rows are equal and
    many, they are dealt over groups by their place as well.

    Ids and texts that many rows share are counted: few of them are broadcast, more take a shuffled join.
    """
    alike = max(1, group_docs // 16)
    keyed = rows.withColumn("__text", F.xxhash64("text"))
    often = keyed.groupBy("doc_id", "__text").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > alike)
    often = materialize(often.select(F.col("doc_id").alias("__id"), F.col("__text").alias("__hash"), F.ceil(F.col("n") / alike).alias("__salts")), "equal-rows")
    salted = keyed.withColumn("__place", F.monotonically_increasing_id())
    match = F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("__text") == F.col("__hash"))
    salted = salted.join(F.broadcast(often) if often.count() <= broadcast_rows else often, match, "left")
    salt = F.coalesce(F.pmod("__place", "__salts"), F.lit(0))
    return salted.select("doc_id", "text", "__text", F.pmod(F.xxhash64("doc_id", "__text", salt, F.lit(seed)), F.lit(groups)).alias("__group"))


def pack(
    docs: DataFrame, tokenizer: str, end_id: int, length: int = 2048, id_col: str = "doc_id", text_col: str = "text",
    group_docs: int = 2048, seed: int = 7, task_bytes: int = 32 << 20,
) -> DataFrame:
    """Pieces of all documents with their places in sequences of at most ``length`` ids.

    Columns: doc_id, start, length, doc_tokens, ids (binary, little-endian unsigned 32-bit), sequence_id, offset. Each
    document is the ids of its text and ``end_id``; each id lies in one piece. Null text is empty; equal rows are packed
    as often as they occur; pieces of one size and rows of one id go in order of id, text checksum and start; texts of any
    length are cut whole; an empty table gives no rows. About ``group_docs`` documents share a group; a sequence's id is its
    group's number times 2^32 and its number in the group. Sequences depend on the rows, not on how files are split,
    unless more than a sixteenth of ``group_docs`` rows are equal.

    Texts are dealt out by group, over as many tasks as keeps one at about ``task_bytes`` of them, and encoded and packed
    there, group by group. A task holds a group's rests, each under ``length`` ids, and one slice of texts.
    """
    size = docs.agg(F.count(F.lit(1)).alias("rows"), F.coalesce(F.sum(F.octet_length(body(text_col))), F.lit(0)).alias("bytes")).first()
    groups = max(1, math.ceil(size["rows"] / group_docs))
    tasks = max(1, min(groups, math.ceil(size["bytes"] / task_bytes)))
    schema = pa.schema(_FIELDS)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def table(rows: list[tuple]) -> pa.RecordBatch:
            columns = zip(*rows, strict=True) if rows else [[] for _ in schema]
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

        group, pool = None, pa.default_memory_pool()
        for batch in batches:
            for at, n in slices(batch.column(1), ENCODED):
                pool.release_unused()  # what the slice before, or another stage in this worker, has left there
                ids, offsets = encoder(tokenizer, ENCODED).encode(batch.column(1).slice(at, n))
                out: list[tuple] = []
                for i, (name, number) in enumerate(zip(batch.column(0).slice(at, n).to_pylist(), batch.column(2).slice(at, n).to_pylist(), strict=True)):
                    if group is None or number << 32 != group.base:
                        out += group.packed() if group else []
                        group = _Group(number, length)
                    out += group.cut(name, np.append(ids[offsets[i] : offsets[i + 1]], np.uint32(end_id)).astype("<u4"))
                yield table(out)
        if group:
            yield table(group.packed())

    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), body(text_col).alias("text"))
    dealt = _grouped(rows, groups, group_docs, seed).repartition(tasks, "__group").sortWithinPartitions("__group", "doc_id", "__text")
    return dealt.select("doc_id", "text", "__group").mapInArrow(cut, PIECE_SCHEMA)
