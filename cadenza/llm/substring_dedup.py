"""Removal of byte strings of 200 bytes that occur more than once in the corpus, by suffix arrays.

1. Content anchors (see ``anchors``) give each 200-byte window one owner, so that equal windows meet at equal anchors.
   Anchors whose gram occurs once own nothing repeated. The others are written to a table, with a 128-bit digest of each
   one's context (its windows' bytes).
2. A context that occurs twice repeats as a whole; this settles the inside of copies.
3. Different contexts of one gram go to a shard, which sorts their suffixes and marks windows whose common prefix with
   another window is 200 bytes.
4. A gram with many contexts (a common line) is told apart by longer strings. Equal windows have the gram at equal places,
   so a context is cut into slices of RANGE of these places at most; all windows of a slice have WIDTH - RANGE + 1 bytes in
   common, its core, and equal windows lie in slices of one core. A core that occurs once holds nothing repeated, slices
   that occur twice repeat as a whole, and the others of one core go to a shard as contexts of one gram do. If even a core
   has many slices, each of their windows is its own core.
5. The windows found are laid on every occurrence of their context, and texts are cut once.

So a shard's strings are bounded, and a context of a frequent gram is moved as few slices, not as windows of 200 bytes.
Documents are read four times, and shuffled once, in the last step: for the counts of grams, for the anchors, and for the
contexts of grams that have several. Bitmaps, sized by the number of grams up to 2^MOST_BITS bits, spare the work for other
grams, and a bitmap of the texts that speak for a context spares its bytes from all others that have it. Where there is too
much for them, they let more through, and what follows selects alike. Tables are deleted as soon as nothing reads them.

Python holds little at once: Spark hands over batches of BATCH bytes, which are worked on in slices, anchors are looked for
in pieces, and a shard's suffixes are sorted for a few grams at a time.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bitmap
from .anchors import WIDTH, Anchors, context_digests, find
from .common import body, discard, materialize
from .shingles import mix
from .suffix_array import Strings, repeated
from .tokens import slices

MOST_BITS = 27
#: Places of a gram in its windows that one slice of a context takes.
RANGE = 13
#: Bytes that Spark hands to Python at once, that are worked on at once, and whose suffixes are sorted at once.
BATCH, SLICE, SORTED = 4 << 20, 1 << 20, 128 << 10
#: Of a text: two 64-bit hashes of its id and bytes.
UID = ["uid1", "uid2"]


def _flat(batch: pa.RecordBatch, column: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, rows, bytes, offsets) of slices of a batch's binary column."""
    for at, n in slices(batch.column(column), SLICE):
        parts = batch.column(column).slice(at, n).to_pylist()
        yield at, n, np.frombuffer(b"".join(parts), dtype=np.uint8), np.concatenate([[0], np.cumsum([len(p) for p in parts])])
    pa.default_memory_pool().release_unused()


def _runs(keys: list[np.ndarray], offsets: np.ndarray) -> list[np.ndarray]:
    """Runs of consecutive offsets under equal keys: [*keys, first, last] of each run."""
    if not len(offsets):
        return [*(k[:0] for k in keys), offsets, offsets]
    order = np.lexsort((offsets, *keys))
    keys, offsets = [k[order] for k in keys], offsets[order]
    new = np.ones(len(offsets), dtype=bool)
    new[1:] = offsets[1:] != offsets[:-1] + 1
    for k in keys:
        new[1:] |= k[1:] != k[:-1]
    at = np.flatnonzero(new)
    return [*(k[at] for k in keys), offsets[at], offsets[np.append(at[1:], len(offsets)) - 1]]


_RUNS = "gram bigint, f1 bigint, f2 bigint, first int, last int"


def _shard(part: pd.DataFrame) -> pd.DataFrame:
    """Repeated windows of one shard, as runs. Equal windows have one gram, so a few grams at a time are sorted, and those
    with one context (that a bitmap let through) not at all."""
    part = part[part["gram"].duplicated(keep=False)]
    if part.empty:
        return pd.DataFrame({c: np.zeros(0, dtype=np.int64) for c in ("gram", "f1", "f2", "first", "last")})
    part = part.sort_values(["gram", "f1", "f2"], kind="stable", ignore_index=True)
    sizes, gram = part["context"].map(len).to_numpy(dtype=np.int64), part["gram"].to_numpy()
    new = np.flatnonzero(np.diff(gram, prepend=~gram[:1]) != 0)
    group = (np.cumsum(sizes)[new] - sizes[new]) // SORTED
    cuts = [*new[np.flatnonzero(np.diff(group, prepend=-1))], len(part)]
    return pd.concat([_repeats(part.iloc[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)], ignore_index=True)


def _repeats(part: pd.DataFrame) -> pd.DataFrame:
    """Runs of the windows of whole grams that occur more than once among them."""
    s = Strings(part["context"].tolist())
    count = part["context"].map(len).to_numpy() - WIDTH + 1
    of = np.repeat(np.arange(len(part)), count)
    at = np.arange(len(of)) - np.repeat(np.cumsum(count) - count, count)
    twice, _ = repeated(s, s.starts[of] + at, WIDTH)
    hit = np.flatnonzero(twice)
    runs = _runs([part[c].to_numpy(dtype=np.int64)[of[hit]] for c in ("gram", "f1", "f2")], at[hit])
    return pd.DataFrame(dict(zip(("gram", "f1", "f2", "first", "last"), runs, strict=True)))


def _sorted_out(texts: DataFrame, total: int, shard_bytes: int) -> DataFrame:
    """Repeated windows of ``texts`` (gram, f1, f2, context), ``total`` bytes of them, as runs; equal ones have one gram."""
    shard = F.pmod(F.col("gram"), F.lit(max(1, math.ceil(total / shard_bytes))))
    return texts.select("gram", "f1", "f2", "context", shard.alias("shard")).groupBy("shard").applyInPandas(_shard, _RUNS)


def _bitmap_of(hashes: DataFrame, column: str, count: int) -> np.ndarray:
    return bitmap.build(hashes, column, min(MOST_BITS, max(16, (8 * count).bit_length())))


def _sliced(batch: pa.RecordBatch) -> tuple[np.ndarray, Anchors, np.ndarray, np.ndarray]:
    """(bytes, slices, keys of their cores, first windows in their contexts) of a batch of gram, f1, f2, place, context.

    A slice is an anchor with fewer windows: ``text`` is the row of its context, and ``gram`` is still that of the context.
    """
    parts = batch.column(4).to_pylist()
    data = np.frombuffer(b"".join(parts), dtype=np.uint8)
    sizes = np.array([len(p) for p in parts], dtype=np.int64)
    starts, place = np.cumsum(sizes) - sizes, batch.column(3).to_numpy().astype(np.int64)
    # A window that starts d bytes before the gram is of range d // RANGE.
    least = place - (sizes - WIDTH)
    ranges = place // RANGE - least // RANGE + 1
    row = np.repeat(np.arange(len(parts)), ranges)
    r = np.arange(len(row)) - np.repeat(np.cumsum(ranges) - ranges, ranges) + np.repeat(least // RANGE, ranges)
    p = place[row]
    first = p - np.minimum(p, RANGE * r + RANGE - 1)
    last = p - np.maximum(least[row], RANGE * r)
    gram = batch.column(0).to_numpy()[row]
    found = Anchors(row, starts[row] + first, starts[row] + last + WIDTH, gram, (starts + place)[row])
    core = found.place - RANGE * r
    raw, digest = data.tobytes(), xxhash.xxh3_64_intdigest
    cores = np.array([digest(raw[a : a + WIDTH - RANGE + 1], k) for a, k in zip(core.tolist(), r.tolist(), strict=True)], dtype=np.uint64)
    return data, found, mix(cores ^ mix(gram.view(np.uint64))).view(np.int64), first


def _crowded(texts: DataFrame, shard_bytes: int, shard_contexts: int) -> tuple[DataFrame, list[DataFrame]]:
    """gram, f1, f2, first, last: repeated windows of ``texts`` (gram, f1, f2, place of the gram, context; distinct contexts
    of frequent grams) as runs; and the tables that can go when these are written. ``texts`` is read no more then."""
    spark = texts.sparkSession

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(_sliced(batch)[2])], names=["key"])

    twice = texts.mapInArrow(keys, "key bigint").groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("key")
    twice = materialize(twice, "cores", SLICE)
    shared = spark.sparkContext.broadcast(_bitmap_of(twice, "key", twice.count()))
    fields = pa.schema([*((c, pa.int64()) for c in ("key", "s1", "s2", "gram", "f1", "f2")), ("shift", pa.int32()), ("slice", pa.binary())])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, found, key, shift = _sliced(batch)
            chosen = bitmap.test(shared.value, key)
            found, raw = found.select(chosen), data.tobytes()
            s1, s2 = context_digests(data, found)
            parts = [raw[x:y] for x, y in zip(found.start.tolist(), found.stop.tolist(), strict=True)]
            columns = (key[chosen], s1, s2, found.gram, *(batch.column(k).to_numpy()[found.text] for k in (1, 2)), shift[chosen], parts)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, fields, strict=True)], schema=fields)

    owners = materialize(texts.mapInArrow(cut, "key bigint, s1 bigint, s2 bigint, gram bigint, f1 bigint, f2 bigint, shift int, slice binary"), "slices", SLICE)
    shared.unpersist()
    discard(twice)
    strings = owners.groupBy(F.col("key").alias("gram"), F.col("s1").alias("f1"), F.col("s2").alias("f2")).agg(F.count(F.lit(1)).alias("n"), F.first("slice").alias("context"))
    strings = materialize(strings, "strings")
    cores = strings.groupBy("gram").agg(F.count(F.lit(1)).alias("kinds"), F.sum(F.length("context")).alias("bytes")).where("kinds > 1")
    cores = materialize(cores, "kinds")
    many = F.col("kinds") > shard_contexts
    total, frequent = cores.agg(F.coalesce(F.sum(F.when(~many, F.col("bytes"))), F.lit(0)), F.count_if(many)).first()
    of = lambda which: strings.join(cores.where(which).select(F.col("gram").alias("of")), F.col("gram") == F.col("of"), "left_semi")
    runs = materialize(_sorted_out(of(~many), total, shard_bytes), "sliced", BATCH)
    tables = [owners, strings, cores, runs]
    if frequent:
        windows = pa.schema([*((c, pa.int64()) for c in ("gram", "f1", "f2", "w1", "w2")), ("at", pa.int32())])

        def single(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for at, n, data, offsets in _flat(batch, 3):
                    count = np.diff(offsets) - WIDTH + 1
                    row = np.repeat(np.arange(n), count)
                    inside = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
                    start, (gram, f1, f2) = offsets[row] + inside, (batch.column(k).slice(at, n).to_numpy()[row] for k in range(3))
                    w1, w2 = context_digests(data, Anchors(row, start, start + WIDTH, gram, start))
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip((gram, f1, f2, w1, w2, inside), windows, strict=True)], schema=windows)

        each = of(many).select("gram", "f1", "f2", "context").mapInArrow(single, "gram bigint, f1 bigint, f2 bigint, w1 bigint, w2 bigint, at int")
        each = materialize(each, "windows", SLICE)
        again = each.groupBy(F.col("gram").alias("g"), F.col("w1").alias("v1"), F.col("w2").alias("v2")).agg(F.count(F.lit(1)).alias("n")).where("n > 1")
        found = each.join(again, (F.col("gram") == F.col("g")) & (F.col("w1") == F.col("v1")) & (F.col("w2") == F.col("v2")), "left_semi")
        runs = runs.unionByName(found.select("gram", "f1", "f2", F.col("at").alias("first"), F.col("at").alias("last")))
        tables.append(each)
    runs = runs.join(strings.where("n = 1").select("gram", "f1", "f2"), ["gram", "f1", "f2"], "left_semi")
    copied = strings.where("n > 1").select("gram", "f1", "f2", F.lit(0).alias("first"), (F.length("context") - WIDTH).alias("last"))
    runs = runs.unionByName(copied).select(F.col("gram").alias("of"), F.col("f1").alias("of1"), F.col("f2").alias("of2"), "first", "last")
    laid = owners.join(runs, (F.col("key") == F.col("of")) & (F.col("s1") == F.col("of1")) & (F.col("s2") == F.col("of2")))
    laid = laid.select("gram", "f1", "f2", (F.col("shift") + F.col("first")).alias("first"), (F.col("shift") + F.col("last")).alias("last"))
    return laid, tables


def repeated_windows(rows: DataFrame, shard_bytes: int = 512 << 10, shard_contexts: int = 1024) -> DataFrame:
    """uid1, uid2, first, last: runs of places in a text at which 200 bytes start that also start elsewhere.

    ``rows`` has uid1, uid2 (bigint) and data (binary, not null). Rows of one uid are texts of their own when counting.
    """
    spark = rows.sparkSession

    def grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, data, offsets in _flat(batch, 0):
                yield pa.RecordBatch.from_arrays([pa.array(find(data, offsets).gram)], names=["gram"])

    counted = rows.select("data").mapInArrow(grams, "gram bigint").groupBy("gram").agg(F.count(F.lit(1)).alias("n"))
    twice = materialize(counted.where("n > 1").select("gram"), "grams", BATCH)
    shared = spark.sparkContext.broadcast(_bitmap_of(twice, "gram", twice.count()))
    places = pa.schema([*((u, pa.int64()) for u in UID), ("gram", pa.int64()), ("f1", pa.int64()), ("f2", pa.int64()), ("start", pa.int32()), ("windows", pa.int32())])

    def locate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, n, data, offsets in _flat(batch, 2):
                found = find(data, offsets)
                found = found.select(bitmap.test(shared.value, found.gram))
                f1, f2 = context_digests(data, found)
                uids = [batch.column(k).slice(at, n).to_numpy()[found.text] for k in (0, 1)]
                columns = (*uids, found.gram, f1, f2, found.start - offsets[:-1][found.text], found.stop - found.start - WIDTH + 1)
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, places, strict=True)], schema=places)

    # Anchors whose gram occurs once own nothing repeated.
    found = materialize(rows.select(*UID, "data").mapInArrow(locate, "uid1 bigint, uid2 bigint, gram bigint, f1 bigint, f2 bigint, start int, windows int"), "anchors", BATCH)
    discard(twice)
    shared.unpersist()
    # The text of least uid1 speaks for a context: only there its bytes are taken.
    contexts = found.groupBy("gram", "f1", "f2").agg(F.count(F.lit(1)).alias("n"), F.max("windows").alias("windows"), F.min("uid1").alias("speaker"))
    contexts = materialize(contexts, "contexts")
    several = contexts.groupBy("gram").agg(F.count(F.lit(1)).alias("kinds"), F.sum(F.col("windows") + WIDTH).alias("bytes")).where("kinds > 1")
    several = materialize(several, "several")
    many = F.col("kinds") > shard_contexts
    total, grams, most, frequent = several.agg(F.coalesce(F.sum(F.when(~many, F.col("bytes"))), F.lit(0)), F.count(F.lit(1)), F.coalesce(F.sum("kinds"), F.lit(0)), F.count_if(many)).first()
    mixed = spark.sparkContext.broadcast(_bitmap_of(several, "gram", 8 * grams))  # sparse: others' contexts would be shuffled
    crowded = spark.sparkContext.broadcast(_bitmap_of(several.where(many), "gram", frequent))

    def speaking(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            gram, f1, uid1 = (batch.column(k).to_numpy() for k in range(3))
            yield pa.RecordBatch.from_arrays([pa.array((f1 ^ uid1)[bitmap.test(mixed.value, gram)])], names=["key"])

    speakers = contexts.select("gram", "f1", "speaker").mapInArrow(speaking, "key bigint")
    speakers = spark.sparkContext.broadcast(_bitmap_of(speakers, "key", most))

    kinds = pa.schema([("gram", pa.int64()), ("f1", pa.int64()), ("f2", pa.int64()), ("crowded", pa.bool_()), ("place", pa.int32()), ("context", pa.binary())])

    def collect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, n, data, offsets in _flat(batch, 1):
                a = find(data, offsets)
                a = a.select(bitmap.test(mixed.value, a.gram))
                f1, f2 = context_digests(data, a)
                speaks = bitmap.test(speakers.value, f1 ^ batch.column(0).slice(at, n).to_numpy()[a.text])
                a, f1, f2 = a.select(speaks), f1[speaks], f2[speaks]
                _, once = np.unique(f1 ^ mix(f2.view(np.uint64) ^ mix(a.gram.view(np.uint64))).view(np.int64), return_index=True)
                a, raw = a.select(once), data.tobytes()
                context = [raw[x:y] for x, y in zip(a.start.tolist(), a.stop.tolist(), strict=True)]
                columns = (a.gram, f1[once], f2[once], bitmap.test(crowded.value, a.gram), a.place - a.start, context)
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, kinds, strict=True)], schema=kinds)

    texts = rows.select("uid1", "data").mapInArrow(collect, "gram bigint, f1 bigint, f2 bigint, crowded boolean, place int, context binary")
    texts = texts.groupBy("gram", "f1", "f2").agg(F.first("crowded").alias("crowded"), F.first("place").alias("place"), F.first("context").alias("context"))
    texts = materialize(texts, "texts", BATCH)
    discard(several)
    for b in (mixed, speakers, crowded):
        b.unpersist()
    runs = materialize(_sorted_out(texts.where("not crowded"), total, shard_bytes), "shards", BATCH)
    tables = [found, contexts, runs]
    if frequent:
        more, made = _crowded(texts.where("crowded").select("gram", "f1", "f2", "place", "context"), shard_bytes, shard_contexts)
        runs, tables = runs.unionByName(more), [*tables, *made]
    discard(texts)
    runs = runs.join(contexts.where("n = 1").select("gram", "f1", "f2"), ["gram", "f1", "f2"], "left_semi")
    copied = contexts.where("n > 1").select("gram", "f1", "f2", F.lit(0).alias("first"), (F.col("windows") - 1).alias("last"))
    runs = runs.unionByName(copied).select(F.col("gram").alias("g"), F.col("f1").alias("h1"), F.col("f2").alias("h2"), "first", "last")
    laid = found.join(runs, (F.col("gram") == F.col("g")) & (F.col("f1") == F.col("h1")) & (F.col("f2") == F.col("h2")))
    laid = materialize(laid.select(*UID, (F.col("start") + F.col("first")).alias("first"), (F.col("start") + F.col("last")).alias("last")), "runs")
    discard(*tables)
    return laid


def _spans(firsts: np.ndarray, lasts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Maximal covered runs [start, stop) of windows of WIDTH bytes at first..last."""
    order = np.argsort(firsts, kind="stable")
    starts, stops = firsts[order], np.maximum.accumulate(lasts[order] + WIDTH)
    new = np.ones(len(starts), dtype=bool)
    new[1:] = starts[1:] > stops[:-1]
    at = np.flatnonzero(new)
    return starts[at], stops[np.append(at[1:], len(starts)) - 1]


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every document with its repeated bytes removed.

    Columns: ``id_col``, n_bytes, spans (array of start and stop, in UTF-8 bytes of the text, maximal and in order) and
    kept (binary: the other bytes). A byte is removed when a 200-byte string over it also starts anywhere else, in the
    same text or another; strings are judged on the texts as given and never cross texts. Null text is empty. Repeated
    rows repeat each other; null ids pass through; texts of any length are taken whole; an empty table gives no rows; other
    columns are not read.
    """
    data = body(text_col).cast("binary")
    rows = docs.select(F.col(id_col).cast("bigint").alias("id"), data.alias("data")).select(
        "id", F.xxhash64("id", "data").alias("uid1"), F.xxhash64(F.lit(1), "data", "id").alias("uid2"), "data"
    )
    found = repeated_windows(rows.select(*UID, "data"))
    # Repeated rows have one uid and the same runs: a set holds each once.
    lists = found.groupBy(*UID).agg(F.collect_set(F.struct("first", "last")).alias("found")).select(F.col("uid1").alias("of1"), F.col("uid2").alias("of2"), "found")
    schema = "id bigint, n_bytes bigint, spans array<struct<start:bigint,stop:bigint>>, kept binary"
    span = pa.struct([("start", pa.int64()), ("stop", pa.int64())])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (whole.slice(at, n) for whole in batches for at, n in slices(whole.column(1), SLICE)):
            sizes, spans, kept = [], [], []
            lists = batch.column(2)
            pairs = lists.flatten()
            firsts, lasts = (pairs.field(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in (0, 1))
            ends = np.cumsum(pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False))
            begin = 0
            for value, end in zip(batch.column(1).to_pylist(), ends, strict=True):
                starts, stops = _spans(firsts[begin:end], lasts[begin:end]) if end > begin else (firsts[:0], firsts[:0])
                begin = end
                sizes.append(len(value))
                spans.append([{"start": a, "stop": b} for a, b in zip(starts.tolist(), stops.tolist(), strict=True)])
                edges = [0, *np.stack([starts, stops], axis=1).reshape(-1).tolist(), len(value)]
                kept.append(b"".join(value[edges[i] : edges[i + 1]] for i in range(0, len(edges), 2)) if len(starts) else value)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(spans, pa.list_(span)), pa.array(kept, pa.binary())], names=["id", "n_bytes", "spans", "kept"])
            pa.default_memory_pool().release_unused()

    joined = rows.join(lists, (F.col("uid1") == F.col("of1")) & (F.col("uid2") == F.col("of2")), "left").select("id", "data", "found")
    return joined.mapInArrow(cut, schema).withColumnRenamed("id", id_col)
