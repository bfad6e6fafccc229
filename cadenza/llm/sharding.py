"""Sharding by jump consistent hashing, with gapless slots inside each shard."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import body


#: Rows that are laid out at once.
BLOCK = 1 << 14


def jump_hash(keys: np.ndarray, shards: int) -> np.ndarray:
    """The shard of each 64-bit key, by jump consistent hashing (Lamping and Veach, 2014), for all keys at once.

    With one more shard a key either stays or moves to the new shard, and 1 / (shards + 1) of the keys move.
    """
    key = keys.astype(np.uint64, copy=True)
    shard = np.zeros(len(key), dtype=np.int64)
    jump = np.zeros(len(key), dtype=np.int64)
    live = np.arange(len(key))
    while len(live):
        shard[live] = jump[live]
        key[live] = key[live] * np.uint64(2862933555777941757) + np.uint64(1)
        step = (key[live] >> np.uint64(33)).astype(np.float64) + 1.0
        jump[live] = ((shard[live] + 1) * (float(1 << 31) / step)).astype(np.int64)
        live = live[jump[live] < shards]
    return shard.astype(np.int32)


def shard_rows(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shards: int = 16, rows_per_bucket: int = 20_000
) -> DataFrame:
    """Shard, slot and size of every row of ``docs``.

    Columns: ``id_col``, size (UTF-8 bytes plus 1), text_crc32, law (``key``), shard, slot, grown_shard (with one
    shard more). The id and the shard count alone decide the shard: the key is made of the first 60 bits of the MD5 of the
    id as text. Null text has no bytes; null ids hash alike; repeated ids share a shard; texts of any length are read
    whole; an empty table gives no rows; other columns are not read.

    Slots count from 0 without gaps in each shard. No task sees a whole shard: a shard's rows are dealt over buckets by
    other bits and the text's checksum, rows are numbered inside a bucket, and the buckets' counts (a small table) give
    where each starts. Rows that are alike in all that is returned are counted, placed as one, and laid out again.
    """

    @F.pandas_udf("shard int, grown_shard int")
    def place(keys: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for k in keys:
            hashed = k.to_numpy(dtype=np.int64).view(np.uint64)
            yield pd.DataFrame({"shard": jump_hash(hashed, shards), "grown_shard": jump_hash(hashed, shards + 1)})

    rows = docs.count()
    buckets = max(64, math.ceil(rows / (shards * rows_per_bucket)))
    keyed = docs.select(F.col(id_col).alias("__id"), body(text_col).alias("__text")).select(
        "__id", (F.octet_length("__text") + 1).cast("bigint").alias("size"), F.crc32(F.col("__text").cast("binary")).alias("text_crc32")
    )
    alike = keyed.groupBy("__id", "size", "text_crc32").agg(F.count(F.lit(1)).alias("__rows"))
    digits = F.md5(F.coalesce(F.col("__id").cast("string"), F.lit("")).cast("binary"))
    number = lambda at, n: F.conv(F.substring(digits, at, n), 16, 10).cast("bigint")
    placed = alike.withColumn("__p", place(number(1, 15))).withColumn("__bucket", (number(16, 8) + F.col("text_crc32")) % buckets).select(
        "*", F.col("__p.shard").alias("shard"), F.col("__p.grown_shard").alias("grown_shard")
    )
    counts = placed.groupBy("shard", "__bucket").agg(F.sum("__rows").alias("n"))
    before = Window.partitionBy("shard").orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(F.col("shard").alias("__s"), F.col("__bucket").alias("__b"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("__start"))
    inside = Window.partitionBy("shard", "__bucket").orderBy("__id", "text_crc32", "size").rowsBetween(Window.unboundedPreceding, 0)
    numbered = placed.withColumn("__n", F.sum("__rows").over(inside) - F.col("__rows"))
    first = numbered.join(starts, (F.col("shard") == F.col("__s")) & (F.col("__bucket") == F.col("__b"))).withColumn("__first", F.col("__start") + F.col("__n"))
    # Laid out in two steps, so that no array grows with the number of rows.
    blocks = first.withColumn("__at", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("__rows") - 1, F.lit(BLOCK))))
    slots = blocks.withColumn("slot", F.explode(F.sequence(F.col("__first") + F.col("__at"), F.col("__first") + F.least(F.col("__at") + BLOCK, F.col("__rows")) - 1)))
    return slots.select(F.col("__id").alias(id_col), "size", "text_crc32", F.lit("key").alias("law"), "shard", F.col("slot").cast("bigint").alias("slot"), "grown_shard")
