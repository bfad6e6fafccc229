"""SimHash near-duplicates: fingerprints over word shingles, linked through a hierarchical index in Gray order.

Two fingerprints that differ in d bits agree on one of d + 1 bands of their bits. A band's value makes an upper node of the
index: its mask is the band. Below it, members are sorted by Gray rank by Spark and cut into leaves of bounded size, each a
row that holds the bits its members share. Leaves are searched by themselves, and pairs of leaves of one node where the
shared bits do not already differ too much (``gray_index`` does the rest). What is found is reduced to the links of a
spanning forest where it is found, and the forests' components are taken by Spark.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import apart, body, materialize
from .components import components
from .gray_index import GrayIndex, join_up
from .tokens import slices
from .word_trie import runs, text_bytes

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
#: Shingles that are hashed at once.
HASHED = 1 << 15
#: Fingerprints of a leaf, and leaves that share an upper pattern.
LEAF, UPPER = 512, 32


def fingerprints(texts: pa.Array, words: int = 3, seed: int = 42) -> np.ndarray:
    """The 64-bit SimHash (uint64) of each text: a bit is set where it is in over half of the shingles' XXH64 values.

    Words are what ASCII white space parts, A-Z lower-cased; a shingle is ``words`` of them, or all of a text with fewer,
    joined by one space, and counts as often as it occurs. Texts without words have fingerprint 0.
    """
    data, places = text_bytes(texts)
    inside = ~_SPACE[data]
    starts, offsets = runs(inside, places)
    kept = np.concatenate([[0], np.cumsum(inside)])
    bounds = np.append(kept[starts], kept[-1])
    number = np.arange(len(starts))
    plain = np.full(int(bounds[-1]) + len(starts), 32, dtype=np.uint8)
    plain[np.arange(bounds[-1]) + np.repeat(number, np.diff(bounds))] = _LOWER[data[inside]]
    first, last = bounds[:-1] + number, bounds[1:] + number
    held = plain.tobytes()

    counts = np.diff(offsets)
    shingles = np.where(counts == 0, 0, np.maximum(counts - words + 1, 1))
    before = np.concatenate([[0], np.cumsum(shingles)])
    ones = np.zeros((len(counts), 64), dtype=np.int64)
    for at in range(0, int(before[-1]), HASHED):
        place = np.arange(at, min(at + HASHED, int(before[-1])))
        text = np.searchsorted(before, place, side="right") - 1
        word = offsets[text] + place - before[text]
        begin, end = first[word], last[np.minimum(word + words, offsets[text + 1]) - 1]
        h = np.fromiter((xxhash.xxh64_intdigest(held[a:b], seed) for a, b in zip(begin.tolist(), end.tolist(), strict=True)), dtype=np.uint64, count=len(place))
        bits = np.unpackbits(h.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        heads = np.flatnonzero(np.diff(text, prepend=-1))
        ones[text[heads]] += np.add.reduceat(bits, heads, axis=0, dtype=np.int64)
    return np.packbits(2 * ones > shingles[:, None], axis=1, bitorder="little").view("<u8").reshape(-1)


def _bands(fp: Column, most: int) -> list[Column]:
    """The upper nodes of a fingerprint: number and value of each of its ``most`` + 1 bands, of 16 bits at most."""
    width = 64 // (most + 1)
    mask = (1 << min(width, 16)) - 1
    return [F.shiftrightunsigned(fp, width * r).bitwiseAND(F.lit(mask)) + F.lit(r << 16) for r in range(most + 1)]


def _gray(fp: Column) -> Column:
    for s in (1, 2, 4, 8, 16, 32):
        fp = fp.bitwiseXOR(F.shiftrightunsigned(fp, s))
    return fp


def _leaves(prints: DataFrame, most: int) -> DataFrame:
    """node, leaf, low, high (the bits that all, and that any, of its members have) and members (binary) of the leaves of all
    nodes that have two members at least."""
    nodes = prints.select(F.explode(F.array(*_bands(F.col("fp"), most))).alias("node"))
    counts = nodes.groupBy("node").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1)  # (most + 1) * 2^16 rows at most
    shared = np.zeros((most + 1) << 16, dtype=bool)
    shared[counts.toPandas()["node"].to_numpy(dtype=np.int64)] = True

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            node = batch.column(0).to_numpy()
            taken = pa.array(shared[node])
            yield batch.filter(taken)

    dealt = prints.select(F.explode(F.array(*_bands(F.col("fp"), most))).alias("node"), "fp").mapInArrow(deal, "node bigint, fp bigint")
    ordered = materialize(dealt, "dealt").withColumn("rank", _gray(F.col("fp"))).repartitionByRange("node", "rank").sortWithinPartitions("node", "rank")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = 0
        for batch in batches:
            node, fp, part = (batch.column(k).to_numpy().astype(np.int64) for k in range(3))
            if not len(node):
                continue
            heads = np.flatnonzero(np.diff(node, prepend=-1))
            place = np.arange(len(node)) - np.repeat(heads, np.diff(np.append(heads, len(node))))
            starts = np.flatnonzero(place % LEAF == 0)
            numbers = (part[starts] << 32) + made + np.arange(len(starts))
            made += len(starts)
            members = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer((np.append(starts, len(fp)) * 8).astype(np.int32)), pa.py_buffer(fp.astype("<i8"))])
            low, high = np.bitwise_and.reduceat(fp, starts), np.bitwise_or.reduceat(fp, starts)
            yield pa.RecordBatch.from_arrays([pa.array(node[starts]), pa.array(numbers), pa.array(low), pa.array(high), members], names=["node", "leaf", "low", "high", "members"])

    return ordered.select("node", "fp", F.spark_partition_id().cast("bigint").alias("part")).mapInArrow(cut, "node bigint, leaf bigint, low bigint, high bigint, members binary")


def _fixed_apart(a: str, b: str) -> Column:
    """In how many bits that are the same all over a, and all over b, the two differ."""
    fixed = lambda side: F.bitwise_not(F.col(f"{side}.high").bitwiseXOR(F.col(f"{side}.low")))
    return F.bit_count(F.col(f"{a}.low").bitwiseXOR(F.col(f"{b}.low")).bitwiseAND(fixed(a)).bitwiseAND(fixed(b)))


def _leaf_pairs(leaves: DataFrame, most: int) -> DataFrame:
    """a, b: leaves of one node, a before b, whose patterns do not differ in more than ``most`` bits; patterns of runs of
    leaves are held against each other first."""
    light = leaves.select("node", "leaf", "low", "high", F.floor(F.col("leaf") / UPPER).alias("upper"))
    several = light.groupBy("node").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(F.col("node").alias("several"))
    light = materialize(light.join(several, F.col("node") == F.col("several"), "left_semi"), "patterns")
    upper = light.groupBy("node", "upper").agg(F.bit_and("low").alias("low"), F.bit_or("high").alias("high"))
    near = (F.col("p.node") == F.col("q.node")) & (_fixed_apart("p", "q") <= most)
    uppers = upper.alias("p").join(upper.alias("q"), near & (F.col("p.upper") <= F.col("q.upper")))
    uppers = uppers.select(F.col("p.node").alias("node"), F.col("p.upper").alias("ua"), F.col("q.upper").alias("ub"))
    first = uppers.join(light.alias("p"), (uppers["node"] == F.col("p.node")) & (uppers["ua"] == F.col("p.upper")))
    both = first.join(light.alias("q"), (uppers["node"] == F.col("q.node")) & (uppers["ub"] == F.col("q.upper")) & (F.col("p.leaf") < F.col("q.leaf")) & (_fixed_apart("p", "q") <= most))
    return both.select(F.col("p.leaf").alias("a"), F.col("q.leaf").alias("b"))


def _members(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    lists = column.to_pylist()
    return np.frombuffer(b"".join(lists), dtype="<u8"), np.concatenate([[0], np.cumsum([len(x) // 8 for x in lists])]).astype(np.int64)


def _forest(members: np.ndarray, labels: np.ndarray) -> pa.RecordBatch:
    """u, v: each member that is not the first of its group, and that first one."""
    moved = np.flatnonzero(labels != np.arange(len(labels)))
    signed = members.astype("<u8").view("<i8")
    return pa.RecordBatch.from_arrays([pa.array(signed[moved]), pa.array(signed[labels[moved]])], names=["u", "v"])


def links(prints: DataFrame, most: int = 3) -> DataFrame:
    """u, v: links between distinct fingerprints ``fp`` (bigint) that differ in ``most`` bits at most; as many as connect all
    that such links connect, and some more."""
    leaves = materialize(_leaves(prints, most), "leaves")

    def within(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            members, offsets = _members(batch.column(0))
            labels = np.arange(len(members))
            own = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
            for i, j in GrayIndex(members, offsets).search(members, own, most):
                labels = join_up(labels, i[i < j], j[i < j])
            yield _forest(members, labels)

    def between(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 64):
                batch = whole.slice(at, 64)
                (a, a_offsets), (b, b_offsets) = _members(batch.column(0)), _members(batch.column(1))
                labels = np.arange(len(a) + len(b))
                for i, j in GrayIndex(b, b_offsets).search(a, np.repeat(np.arange(len(a_offsets) - 1), np.diff(a_offsets)), most):
                    labels = join_up(labels, i, len(a) + j)
                yield _forest(np.concatenate([a, b]), labels)

    found = leaves.select("members").mapInArrow(within, "u bigint, v bigint")
    pairs = materialize(_leaf_pairs(leaves, most), "leaf-pairs")
    left = leaves.select(F.col("leaf").alias("a"), F.col("members").alias("ma"))
    right = leaves.select(F.col("leaf").alias("b"), F.col("members").alias("mb"))
    crossed = pairs.join(left, "a").join(right, "b").select("ma", "mb").mapInArrow(between, "u bigint, v bigint")
    return found.unionByName(crossed)


def near_duplicates(docs: DataFrame, most: int = 3, words: int = 3, seed: int = 42, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col``, fingerprint (16 hex digits) and component_id of every row of ``docs``.

    Rows whose fingerprints differ in ``most`` bits at most are linked; component_id is the least id that links reach, the
    row's own included. Null and empty texts, and such of white space, have fingerprint zero, which is linked like any other;
    texts of any length are read whole; equal rows have equal results; null ids take part and are never the least, so
    component_id is null where nothing else is reached; an empty table gives no rows; other columns are not read.

    Each distinct fingerprint is searched once. ``most`` is 3 or more (bands are of 16 bits at most), and 15 at most.
    """
    if not 3 <= most <= 15:
        raise ValueError("most is 3 to 15")
    kind = docs.schema[id_col].dataType

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, n in slices(batch.column(1)):
                fp = fingerprints(batch.column(1).slice(at, n), words, seed).view("<i8")
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, n), pa.array(fp)], names=["id", "fp"])

    rows = docs.select(F.col(id_col), body(text_col).alias("__text")).mapInArrow(mark, f"id {kind.simpleString()}, fp bigint")
    marked = materialize(rows, "fingerprints")
    prints = materialize(marked.groupBy("fp").agg(F.min("id").alias("least")), "distinct-fingerprints")
    groups = components(links(prints.select("fp"), most))
    placed = materialize(prints.join(groups, F.col("fp") == F.col("node"), "left").select("fp", "least", F.coalesce("component", "fp").alias("component")), "grouped")
    least = placed.groupBy("component").agg(F.min("least").alias("component_id"))
    named = placed.select("fp", apart("component").alias("key")).join(least.select(apart("component").alias("other"), "component_id"), F.col("key") == F.col("other"))
    table = named.select(apart("fp").alias("key"), "component_id")
    joined = marked.join(table, apart("fp") == F.col("key"))
    return joined.select(F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
