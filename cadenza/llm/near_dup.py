"""Near-duplicate join on word shingles: MinHash bands, Bayesian pruning, exact verification.

1. Each text gets MinHash values; bands of them are hashed. Equal texts (by SHA-256) are one node from here on, whatever
   their ids.
2. Blocks hold the candidate pairs. Texts that share a band are tied to the least text of the band. A component of these
   ties is a block; a large one whose bands hold fewer texts than its chunks would (unrelated texts in a chain) is taken
   apart, and each of its bands is a block.
3. Small blocks share tiles; a large block is dealt into chunks and each pair of chunks is a tile. In a tile, pairs that
   share a band are compared a few MinHash values at a time and dropped as soon as the posterior probability that their
   similarity reaches the threshold (uniform prior) is below ``tolerance``; the rest are verified by exact shingle sets.
4. A tile gives, for each text, the number of its links and the least text that it is linked to; never the pairs. Classes
   are the components of these verified links.

A pair is counted in one tile: that of its component and chunks, or that of the first band that it shares. Candidates are
as good as the bands: at similarity 0.8 a pair shares none with probability 7e-5, and pruning loses at most about
``tolerance`` of the rest. Texts of one dense class all have to be compared, so its work grows as its square.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import apart, body, materialize, without_ids
from .components import components
from .shingles import mix, minhash, shingle_hashes, shingle_ids, word_hashes, words_of
from .tokens import slices

BANDS, ROWS = 24, 5
STEP = 12


def bands_of(values: np.ndarray) -> np.ndarray:
    """(texts x BANDS) 64-bit keys of the bands; the band's number is part of its key."""
    keys = np.empty((len(values), BANDS), dtype=np.int64)
    for b in range(BANDS):
        h = np.full(len(values), b + 1, dtype=np.uint64)
        for r in range(ROWS):
            h = mix(h * np.uint64(0x9E3779B97F4A7C15) ^ values[:, b * ROWS + r])
        keys[:, b] = h.view(np.int64)
    return keys


def least_matches(threshold: float, tolerance: float, compared: int) -> int:
    """The fewest matches of ``compared`` MinHash values at which a pair stays: with a uniform prior the posterior that its
    similarity is at least ``threshold`` is then ``tolerance`` or more."""
    below = 0.0
    for m in range(compared + 1):
        below += math.comb(compared + 1, m) * threshold**m * (1 - threshold) ** (compared + 1 - m)
        if below >= tolerance:
            return m
    return compared


def prune(a: np.ndarray, b: np.ndarray, values: np.ndarray, threshold: float, tolerance: float) -> tuple[np.ndarray, np.ndarray]:
    """Those pairs (a[i], b[i]) that pass every step of the incremental comparison."""
    kept = [(a[:0], b[:0])]
    for at in range(0, len(a), 50_000):
        x, y = a[at : at + 50_000], b[at : at + 50_000]
        same = np.zeros(len(x), dtype=np.int64)
        for done in range(0, BANDS * ROWS, STEP):
            part = values[:, done : done + STEP]
            same += (part[x] == part[y]).sum(axis=1)
            stay = same >= least_matches(threshold, tolerance, done + STEP)
            x, y, same = x[stay], y[stay], same[stay]
        kept.append((x, y))
    return np.concatenate([k[0] for k in kept]), np.concatenate([k[1] for k in kept])


def verify(a: np.ndarray, b: np.ndarray, ids: np.ndarray, offsets: np.ndarray, threshold: float) -> np.ndarray:
    """Whether the Jaccard similarity of the shingle sets of a[i] and b[i] is at least ``threshold``, exactly."""
    text = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    order = np.lexsort((ids, text))
    text, ids = text[order], ids[order]
    first = np.ones(len(ids), dtype=bool)
    first[1:] = (text[1:] != text[:-1]) | (ids[1:] != ids[:-1])
    text, ids = text[first], ids[first]
    size = np.bincount(text, minlength=len(offsets) - 1)
    start = np.cumsum(size) - size
    marked = np.zeros(int(ids.max()) + 1 if len(ids) else 1, dtype=bool)
    out = np.zeros(len(a), dtype=bool)
    order = np.argsort(a, kind="stable")
    for group in np.split(order, np.flatnonzero(np.diff(a[order])) + 1) if len(a) else []:
        x = a[group[0]]
        mine = ids[start[x] : start[x] + size[x]]
        marked[mine] = True
        for at in range(0, len(group), 512):
            some = group[at : at + 512]
            n = size[b[some]]
            ends = np.cumsum(n)
            index = np.arange(int(ends[-1])) + np.repeat(start[b[some]] - (ends - n), n)
            common = np.concatenate([[0], np.cumsum(marked[ids[index]])])
            common = common[ends] - common[ends - n]
            out[some] = common >= threshold * (size[x] + n - common) - 1e-9
        marked[mine] = False
    return out & (size[a] > 0)


def _least_tied(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least member of each of ``n`` nodes' component under the pairs."""
    low = np.arange(n)
    while True:
        before = low.copy()
        least = np.minimum(low[a], low[b])
        np.minimum.at(low, a, least)
        np.minimum.at(low, b, least)
        low = low[low]
        if (low == before).all():
            return low


def _owned(a: np.ndarray, b: np.ndarray, keys: np.ndarray, owned: np.ndarray) -> np.ndarray:
    """Whether the first band that texts a[i] and b[i] share is one of ``owned``."""
    out = np.zeros(len(a), dtype=bool)
    for at in range(0, len(a), 50_000):
        x, y = a[at : at + 50_000], b[at : at + 50_000]
        first = (keys[x] == keys[y]).argmax(axis=1)
        out[at : at + 50_000] = np.isin(keys[x, first], owned)
    return out


def tile_links(
    nodes: np.ndarray, texts: pa.Array, chunks: np.ndarray, cross: bool, threshold: float, tolerance: float, owned: np.ndarray | None = None
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(linked positions, their numbers of links, the least node that each is tied to) in one tile.

    With ``cross``, only pairs of different chunks count; with ``owned``, only pairs whose first shared band is in it.
    """
    order = np.argsort(nodes, kind="stable")
    codes, distinct, offsets = words_of(texts.take(pa.array(order)))
    hashes, hash_offsets = shingle_hashes(word_hashes(codes, distinct), offsets)
    values = minhash(hashes, hash_offsets, BANDS * ROWS)
    keys, n = bands_of(values), len(nodes)
    chunks = chunks[order]
    worded = np.diff(offsets) > 0
    near = np.zeros((n, n), dtype=bool)
    for band in keys.T:
        by = np.argsort(band, kind="stable")
        edges = np.flatnonzero(np.diff(band[by])) + 1
        starts, ends = np.concatenate([[0], edges]), np.concatenate([edges, [n]])
        for s, e in zip(starts[ends - starts > 1], ends[ends - starts > 1], strict=True):
            near[np.ix_(by[s:e], by[s:e])] = True
    if cross:
        near &= chunks[:, None] != chunks[None, :]
    near &= worded[:, None] & worded[None, :]
    a, b = np.nonzero(np.triu(near, 1))
    if owned is not None:
        mine = _owned(a, b, keys, owned)
        a, b = a[mine], b[mine]
    a, b = prune(a, b, values, threshold, tolerance)
    ids, id_offsets = shingle_ids(codes, offsets)
    true = verify(a, b, ids, id_offsets, threshold)
    a, b = a[true], b[true]
    links = np.bincount(a, minlength=n) + np.bincount(b, minlength=n)
    least = _least_tied(n, a, b)
    linked = np.flatnonzero(links)
    sorted_nodes = nodes[order]
    return order[linked], links[linked], sorted_nodes[least[linked]]


def _sketched(rows: DataFrame) -> DataFrame:
    """id, digest, size (bytes of a text that has words, else 0) and bands of every row (id, text, digest)."""
    schema = pa.schema([("id", pa.int64()), ("digest", pa.binary()), ("size", pa.int64()), ("bands", pa.list_(pa.int64()))])

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, n in slices(batch.column(1), 2 << 20):
                part = batch.slice(at, n)
                codes, distinct, offsets = words_of(part.column(1))
                hashes, ends = shingle_hashes(word_hashes(codes, distinct), offsets)
                keys = bands_of(minhash(hashes, ends, BANDS * ROWS)).reshape(-1)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * BANDS), pa.array(keys))
                octets = pc.binary_length(part.column(1)).cast(pa.int64()).to_numpy(zero_copy_only=False)
                size = pa.array(np.where(np.diff(offsets) > 0, octets, 0))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(2).cast(pa.binary()), size, lists], schema=schema)

    return rows.mapInArrow(sketch, "id bigint, digest binary, size bigint, bands array<bigint>")


def _blocks(nodes: DataFrame, tile_docs: int, tile_bytes: int) -> DataFrame:
    """node, chunk, tile (a, b: the block or the share of small blocks; i, j: the chunks), cross and keys (of the bands
    that are blocks in this tile; null where components are): where each text is compared."""
    keyed = nodes.where("size > 0").select("node", "size", F.explode("bands").alias("key"))
    bands = keyed.groupBy("key").agg(F.min("node").alias("head"), F.count(F.lit(1)).alias("n"), F.sum("size").alias("bytes")).where("n > 1")
    shared = materialize(bands.select("key", "head", "n", "bytes"), "bands")
    chunks_of = lambda n, size: F.ceil(F.greatest(F.col(n) / tile_docs, F.col(size) / tile_bytes)).cast("int")
    at = shared.select(apart("key").alias("at"), "head", chunks_of("n", "bytes").alias("band_chunks"))
    held = keyed.join(at, apart("key") == F.col("at"))
    member = components(held.where("node <> head").select(F.col("node").alias("u"), F.col("head").alias("v")))
    member = materialize(member.join(nodes.select("node", "size"), "node"), "members")

    of_band = shared.join(member.select(F.col("node").alias("head"), "component"), "head").groupBy("component").agg(
        F.sum(F.col("n") * chunks_of("n", "bytes")).alias("by_band")
    )
    whole = member.groupBy("component").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("bytes")).withColumn("chunks", chunks_of("n", "bytes"))
    whole = whole.join(of_band, "component").select(apart("component").alias("of"), "chunks", ((F.col("chunks") > 1) & (F.col("by_band") < F.col("n") * F.col("chunks"))).alias("apart"))
    dealt = member.join(whole, apart("component") == F.col("of")).select("node", "size", "component", "chunks", "apart")
    dealt = materialize(dealt, "dealt")
    by_component = dealt.where("NOT apart").select("node", "size", F.col("component").alias("block"), "chunks", F.lit(None).cast("bigint").alias("key"))
    taken_apart = dealt.where("apart").select(F.col("node").alias("part_of"))
    by_band = held.join(taken_apart, F.col("node") == F.col("part_of")).select("node", "size", F.col("key").alias("block"), F.col("band_chunks").alias("chunks"), "key")
    placed = by_component.unionByName(by_band)
    load = placed.groupBy(F.col("key").isNull().alias("whole")).agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("bytes")).collect()  # two rows at most
    bins = max([1, *(math.ceil(max(r["n"] / tile_docs, (r["bytes"] or 0) / tile_bytes)) for r in load)])
    chunk = F.pmod(F.xxhash64("node"), F.col("chunks")).cast("int")
    spread = placed.withColumn("chunk", chunk).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    many = F.col("chunks") > 1
    tile = F.struct(
        F.col("key").isNotNull().alias("band"), F.when(many, F.col("block")).otherwise(F.pmod(F.xxhash64("block"), F.lit(bins))).alias("a"),
        F.when(many, F.least("chunk", "other")).otherwise(-1).alias("i"), F.when(many, F.greatest("chunk", "other")).otherwise(-1).alias("j"),
    )
    return spread.groupBy("node", tile.alias("tile")).agg(
        F.max("chunk").alias("chunk"), F.bool_or(F.col("chunk") != F.col("other")).alias("other_chunk"), F.collect_set("key").alias("keys")
    ).select("node", "tile", "chunk", (F.col("other_chunk") & (F.col("tile.i") != F.col("tile.j"))).alias("cross"), "keys")


def _classified(docs: DataFrame, id_col: str, text_col: str, threshold: float, tolerance: float, tile_docs: int, tile_bytes: int) -> DataFrame:
    """id, digest, class_id, least (the least digest of the class), links and copies of every row of ``docs``."""
    text = body(text_col)
    rows = docs.select(F.col(id_col).cast("bigint").alias("id"), text.alias("text"), F.unhex(F.sha2(text.cast("binary"), 256)).alias("digest"))
    sketches = materialize(_sketched(rows.select("id", "text", "digest")), "sketches")
    # Numbers are given once, when the table is written; a text keeps its number from there on.
    nodes = sketches.groupBy("digest").agg(F.min("id").alias("doc"), F.count(F.lit(1)).alias("copies"), F.max("size").alias("size"), F.first("bands").alias("bands"))
    nodes = materialize(nodes.withColumn("node", F.monotonically_increasing_id()), "nodes")
    blocks = materialize(_blocks(nodes, tile_docs, tile_bytes), "blocks")

    # One row speaks for each text: that with its least id. Rows that repeat it are folded before they are shuffled. A null
    # counts as the least bigint here, so that the join finds texts where the aggregation has put them.
    slot = lambda c: F.coalesce(c, F.lit(-(2**63)))
    wanted = blocks.select("node").distinct().join(nodes.select("node", slot("doc").alias("slot_of"), F.col("digest").alias("of")), "node")
    texts = rows.groupBy("digest", slot("id").alias("slot")).agg(F.first("text").alias("text"))
    texts = wanted.hint("merge").join(texts, (F.col("of") == F.col("digest")) & (F.col("slot_of") == F.col("slot"))).select(F.col("node").alias("speaks"), "text")
    tiles = blocks.hint("merge").join(texts, F.col("node") == F.col("speaks")).select("tile", "node", "chunk", "cross", "keys", "text")

    def link(part: pd.DataFrame) -> pd.DataFrame:
        nodes, texts = part["node"].to_numpy(dtype=np.int64), pa.array(part["text"], pa.string())
        keys = [k for k in part["keys"] if len(k)]
        owned = np.unique(np.concatenate(keys)) if keys else None
        where, links, least = tile_links(nodes, texts, part["chunk"].to_numpy(), bool(part["cross"].any()), threshold, tolerance, owned)
        return pd.DataFrame({"node": nodes[where], "links": links, "least": least})

    linked = materialize(tiles.groupBy("tile").applyInPandas(link, "node bigint, links bigint, least bigint"), "links")
    counts = linked.groupBy("node").agg(F.sum("links").alias("links")).select(F.col("node").alias("counted"), "links")
    # Texts under one id are one document, so they are of one class.
    several = sketches.where("id IS NOT NULL").groupBy("id").agg(F.min("digest").alias("a"), F.max("digest").alias("b")).where("a <> b").select(F.col("id").alias("several"))
    of_one = sketches.join(several, F.col("id") == F.col("several")).select("id", "digest").distinct().join(nodes.select("digest", "node"), "digest")
    of_one = of_one.join(of_one.groupBy(F.col("id").alias("one")).agg(F.min("node").alias("v")), F.col("id") == F.col("one")).select(F.col("node").alias("u"), "v")
    member = components(linked.select(F.col("node").alias("u"), F.col("least").alias("v")).unionByName(of_one))
    named = member.join(nodes.select("node", "doc", "digest"), "node")
    best = named.groupBy(apart("component").alias("at")).agg(F.min("doc").alias("class_doc"), F.min("digest").alias("class_text"))
    classes = named.join(best, apart("component") == F.col("at")).select(F.col("node").alias("member"), "class_doc", "class_text")
    of_node = nodes.join(classes, F.col("node") == F.col("member"), "left").join(counts, F.col("node") == F.col("counted"), "left").select(
        F.substring("digest", 1, 32).alias("text_of"), "copies", F.coalesce("class_doc", "doc").alias("class_id"), F.coalesce("class_text", "digest").alias("least"),
        F.coalesce("links", F.lit(0)).cast("bigint").alias("links"),
    )
    return sketches.select("id", "digest").join(of_node, F.col("digest") == F.col("text_of")).drop("text_of")


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.8, tolerance: float = 1e-5, tile_docs: int = 1024, tile_bytes: int = 8 << 20
) -> DataFrame:
    """The near-duplicate class of every row of ``docs``.

    Columns: ``id_col``, class_id (the least id of its class), links (other texts whose shingle sets have a Jaccard
    similarity of at least ``threshold``; equal texts count as one), copies (rows with the same text). Classes are
    connected components of the links, with equal texts together, and with texts of one id together.

    Null text is empty; texts without words link to nothing but equal texts. A row without an id is a document of its own:
    its class is that of its text, with a null class_id where no row of the class has an id. Texts of any length are
    compared whole. An empty table gives no rows; other columns are not read.
    """
    found = _classified(docs, id_col, text_col, threshold, tolerance, tile_docs, tile_bytes)
    return found.select(F.col("id").alias(id_col), "class_id", "links", "copies")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.8, **options) -> DataFrame:
    """``docs`` with one document of each near-duplicate class: that with the least id, with all its rows and columns.

    Rows without an id go where a row of their class has one. Of a class without ids, the rows of one text stay.
    """
    settings = {"tolerance": 1e-5, "tile_docs": 1024, "tile_bytes": 8 << 20} | options
    found = materialize(_classified(docs, id_col, text_col, threshold, **settings), "classes")
    named = without_ids(docs, found.where("id <> class_id").select(F.col("id").alias(id_col)), id_col).where(F.col(id_col).isNotNull())
    gone = found.where("id IS NULL AND (class_id IS NOT NULL OR digest <> least)").select(F.col("digest").alias("__gone")).distinct()
    unnamed = docs.where(F.col(id_col).isNull())
    unnamed = unnamed.join(gone, F.unhex(F.sha2(body(text_col).cast("binary"), 256)) == F.col("__gone"), "left_anti")
    return named.unionByName(unnamed)
