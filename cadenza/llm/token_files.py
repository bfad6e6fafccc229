"""Token-id files: documents in ascending id order, coded by Simple-8b, with the places of documents in them.

A file is a Parquet container of frames. A frame is a row: whole documents of about ``FRAME_IDS`` ids, the words as
raw little-endian bytes, the offsets of their blocks, and the escapes. Shards follow the order of ids, and frames the
order within a shard, so the concatenation of all frames is the token stream. Parquet is only the envelope (the words
are not compressed again): it gives the files Spark's commit protocol and any store that Spark can reach.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import body, shared_path
from .simple8b import Coded, decode, encode
from .tokens import encoder, slices

FRAME_IDS = 1 << 17
FRAME_SCHEMA = (
    "shard int, frame int, first_id bigint, n_ids bigint, doc_ids array<bigint>, doc_tokens array<bigint>, "
    "words binary, block_offsets binary, escape_positions binary, escape_values binary"
)
_ARROW = pa.schema([
    ("shard", pa.int32()), ("frame", pa.int32()), ("first_id", pa.int64()), ("n_ids", pa.int64()), ("doc_ids", pa.list_(pa.int64())),
    ("doc_tokens", pa.list_(pa.int64())), ("words", pa.binary()), ("block_offsets", pa.binary()), ("escape_positions", pa.binary()), ("escape_values", pa.binary()),
])


def _frame(shard: int, frame: int, first: int, docs: list[int | None], counts: list[int], ids: np.ndarray) -> pa.RecordBatch:
    c = encode(ids)
    row = [shard, frame, first, len(ids), docs, counts, c.words.astype("<u8").tobytes(), c.block_offsets.astype("<i4").tobytes(), c.escape_positions.astype("<u4").tobytes(), c.escape_values.astype("<u4").tobytes()]
    return pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip(row, _ARROW, strict=True)], schema=_ARROW)


def write_tokens(docs: DataFrame, path: str, tokenizer: str, end_id: int, id_col: str = "doc_id", text_col: str = "text", frame_ids: int = FRAME_IDS) -> None:
    """Encode every text, append ``end_id``, and write the ids of all documents in ascending id order.

    Null text is empty (its document holds the end id alone); null ids come first; equal ids are ordered by text, and
    equal rows are written as often as they occur. An empty table gives a file without frames. Texts are ranged by id
    before they are encoded, so each is encoded once, in the task that writes it. Other columns are not read.
    """

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, frame, first = TaskContext.get().partitionId(), 0, 0
        names: list[int | None] = []
        counts: list[int] = []
        held: list[np.ndarray] = []
        size = 0
        end = np.array([end_id], dtype=np.uint32)
        for batch in batches:
            for at, n in slices(batch.column(1)):
                ids, offsets = encoder(tokenizer).encode(batch.column(1).slice(at, n))
                for i, name in enumerate(batch.column(0).slice(at, n).to_pylist()):
                    names.append(name)
                    counts.append(int(offsets[i + 1] - offsets[i]) + 1)
                    held += [ids[offsets[i] : offsets[i + 1]], end]
                    size += counts[-1]
                    if size >= frame_ids:
                        yield _frame(shard, frame, first, names, counts, np.concatenate(held))
                        frame, first, names, counts, held, size = frame + 1, first + size, [], [], [], 0
        if names:
            yield _frame(shard, frame, first, names, counts, np.concatenate(held))

    rows = docs.select(F.col(id_col).cast("bigint").alias("id"), body(text_col).alias("text"))
    ordered = rows.repartitionByRange(F.asc_nulls_first("id")).sortWithinPartitions(F.asc_nulls_first("id"), "text")
    ordered.mapInArrow(write, FRAME_SCHEMA).write.option("compression", "uncompressed").parquet(path)


def frame_ids_of(row: dict) -> np.ndarray:
    """All ids of a frame given as a dict of its columns."""
    return decode(Coded(
        row["n_ids"], np.frombuffer(row["words"], "<u8"), np.frombuffer(row["block_offsets"], "<i4"),
        np.frombuffer(row["escape_positions"], "<u4"), np.frombuffer(row["escape_values"], "<u4"),
    ))


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """Each document in the files under ``path``: doc_id, start (ids of all documents before it), n_tokens, ids (binary,
    little-endian unsigned 32-bit)."""
    return _read(spark, path, "ids binary", pa.binary(), lambda ids: ids.tobytes())


def read_checksums(spark: SparkSession, path: str) -> DataFrame:
    """As :func:`read_tokens`, with ids_crc32 (unsigned, of those bytes) in place of the ids."""
    return _read(spark, path, "ids_crc32 bigint", pa.int64(), lambda ids: zlib.crc32(ids.tobytes()))


def _read(spark: SparkSession, path: str, column: str, kind: pa.DataType, of) -> DataFrame:
    frames = spark.read.schema(FRAME_SCHEMA).parquet(path)
    totals = frames.groupBy("shard").agg(F.sum("n_ids").alias("n"))
    # One row for each file of the writer; no rows of documents pass this window.
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    bases = totals.select(F.col("shard").alias("__shard"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("__base"))
    name = column.split()[0]
    schema = pa.schema([("doc_id", pa.int64()), ("shard", pa.int32()), ("local", pa.int64()), ("n_tokens", pa.int64()), (name, kind)])

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                ids = frame_ids_of(row).astype("<u4")
                ends = np.cumsum(row["doc_tokens"])
                starts = ends - row["doc_tokens"]
                values = [of(ids[a:b]) for a, b in zip(starts, ends, strict=True)]
                arrays = [row["doc_ids"], [row["shard"]] * len(starts), starts + row["first_id"], row["doc_tokens"], values]
                yield pa.RecordBatch.from_arrays([pa.array(a, f.type) for a, f in zip(arrays, schema, strict=True)], schema=schema)

    rows = frames.mapInArrow(unpack, f"doc_id bigint, shard int, local bigint, n_tokens bigint, {column}")
    return rows.join(bases, rows["shard"] == bases["__shard"]).select("doc_id", (F.col("__base") + F.col("local")).alias("start"), "n_tokens", name)


def round_trip(docs: DataFrame, tokenizer: str, end_id: int) -> DataFrame:
    """Write ``docs`` to new files in the shared folder and read the documents' places and checksums back."""
    path = shared_path(docs.sparkSession, "tokens")
    write_tokens(docs, path, tokenizer, end_id)
    return read_checksums(docs.sparkSession, path)
