"""Resampling of documents towards a target distribution, by importance weights over hashed word runs (Xie et al., 2023).

Each partition walks its texts through a trie of its own (``word_trie``), whose nodes hold counts and CRC states; only
totals by bucket leave the partition and are summed by Spark. With the buckets' gains attached to the nodes, texts are
walked again and scored. Seeded Gumbel noise makes the highest scores a draw without replacement.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import body, materialize
from .tokens import slices
from .word_trie import WordTrie, words_of

#: Scores that share a step of the first count, so that no count over all scores is more than a few hundred rows.
COARSE = 1024
#: Rows that are laid out at once.
BLOCK = 1 << 14


def bucket_totals(rows: DataFrame, text_col: str = "text", order: int = 1, buckets: int = 10_000) -> DataFrame:
    """bucket (0 to ``buckets`` - 1), n: how many features of all texts fall in a bucket; empty buckets have no row."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie, total = WordTrie(order), np.zeros(buckets, dtype=np.int64)
        for batch in batches:
            for at, n in slices(batch.column(0)):
                for level, node, _ in trie.walk(*words_of(batch.column(0).slice(at, n))):
                    level.count += np.bincount(node, minlength=len(level.count))
                if trie.full():
                    total += trie.totals(buckets)
                    trie.clear()
        total += trie.totals(buckets)
        held = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(held), pa.array(total[held])], names=["bucket", "n"])

    return rows.select(body(text_col).alias("t")).mapInArrow(count, "bucket bigint, n bigint").groupBy("bucket").agg(F.sum("n").alias("n"))


def gains_of(docs: DataFrame, target: DataFrame, text_col: str = "text", order: int = 1, buckets: int = 10_000) -> np.ndarray:
    """The gain of each bucket in thousandths: the log ratio of its smoothed shares in ``target`` and in ``docs``, rounded
    down. ``buckets`` values reach the driver, whatever the tables."""
    spark = docs.sparkSession
    raw = materialize(bucket_totals(docs, text_col, order, buckets).withColumnRenamed("n", "s"), "raw-totals")
    aim = bucket_totals(target, text_col, order, buckets).withColumnRenamed("n", "t")
    both = spark.range(buckets).withColumnRenamed("id", "bucket").join(raw, "bucket", "left").join(aim, "bucket", "left").fillna(0, ["s", "t"])
    counts = both.toPandas().sort_values("bucket")
    s, t = counts["s"].to_numpy(dtype=np.float64), counts["t"].to_numpy(dtype=np.float64)
    return np.floor(1000 * np.log((t + 1) * (s.sum() + buckets) / ((s + 1) * (t.sum() + buckets)))).astype(np.int64)


def weights(docs: DataFrame, gains: np.ndarray, id_col: str = "doc_id", text_col: str = "text", order: int = 1) -> DataFrame:
    """``id_col``, n_words, n_features and weight (the mean gain over a text's features, rounded down; 0 without any)."""
    kind = docs.schema[id_col].dataType

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie, attached = WordTrie(order), [np.zeros(0, dtype=np.int64) for _ in range(order)]
        for batch in batches:
            for at, n in slices(batch.column(1)):
                codes, distinct, offsets = words_of(batch.column(1).slice(at, n))
                words, features, total = np.diff(offsets), np.zeros(n, dtype=np.int64), np.zeros(n, dtype=np.int64)
                text = np.repeat(np.arange(n), words)
                for depth, (level, node, place) in enumerate(trie.walk(codes, distinct, offsets)):
                    fresh = level.crc[len(attached[depth]) :] % np.uint32(len(gains))
                    attached[depth] = np.concatenate([attached[depth], gains[fresh]])
                    features += np.bincount(text[place], minlength=n)
                    sums = np.concatenate([[0], np.cumsum(attached[depth][node])])
                    bounds = np.searchsorted(place, offsets)
                    total += sums[bounds[1:]] - sums[bounds[:-1]]
                weight = np.where(features > 0, total // np.maximum(features, 1), 0)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, n), pa.array(words.astype(np.int64)), pa.array(features), pa.array(weight)], names=[id_col, "n_words", "n_features", "weight"])
                if trie.full():
                    trie.clear()
                    attached = [np.zeros(0, dtype=np.int64) for _ in range(order)]

    rows = docs.select(F.col(id_col), body(text_col).alias("__text"))
    return rows.mapInArrow(score, f"`{id_col}` {kind.simpleString()}, n_words bigint, n_features bigint, weight bigint")


def noise(seed: int, key: Column) -> Column:
    """Gumbel noise in thousandths, rounded down, from the first 32 bits of the SHA-256 of ``seed:key``; a null key is empty."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))).cast("binary"), 256)
    h = F.conv(F.substring(digest, 1, 8), 16, 10).cast("bigint")
    return F.floor(F.lit(-1000.0) * F.log(-F.log((h + F.lit(0.5)) / F.lit(4294967296.0)))).cast("bigint")


def resample(
    docs: DataFrame, target: DataFrame, percent: int = 10, least_words: int = 20, order: int = 1, buckets: int = 10_000, seed: int = 2024,
    id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """Every row of ``docs`` with its place in a draw of ``percent`` % of those that have ``least_words`` words.

    Columns: ``id_col``, n_features, weight, score (weight plus noise), rank (from 1; null where not drawn). Ties go to the
    smaller id, null ids first, then to fewer features; rows that are alike in all of these are as often in the result.
    Null and empty texts have no features and weight 0 and are never drawn where ``least_words`` is positive; texts of
    any length are read whole; an empty ``docs`` gives no rows, and an empty ``target`` evens the buckets out; other columns,
    whatever their names, are not read. Gains come from all features of both tables.

    No task sees all scores: they are counted by value, the counts of steps of ``COARSE`` give where each value begins, and
    only rows of a drawn score are ordered, each score by itself.
    """
    scored = weights(docs, gains_of(docs, target, text_col, order, buckets), id_col, text_col, order)
    scored = scored.select(F.col(id_col).alias("__id"), "n_words", "n_features", "weight").withColumn("score", F.col("weight") + noise(seed, F.col("__id")))
    scored = materialize(scored, "scores")
    able = F.col("n_words") >= least_words
    counts = materialize(scored.where(able).groupBy("score").agg(F.count(F.lit(1)).alias("n")), "score-counts")
    number = int(counts.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0])
    draw = percent * number // 100

    step = F.floor(F.col("score") / COARSE)
    higher = Window.orderBy(F.desc("__step")).rowsBetween(Window.unboundedPreceding, -1)
    steps = counts.groupBy(step.alias("__step")).agg(F.sum("n").alias("__of")).select(F.col("__step").alias("__s"), F.coalesce(F.sum("__of").over(higher), F.lit(0)).alias("__before"))
    inside = Window.partitionBy("__step").orderBy(F.desc("score")).rowsBetween(Window.unboundedPreceding, -1)
    placed = counts.withColumn("__step", step).withColumn("__in", F.coalesce(F.sum("n").over(inside), F.lit(0))).join(F.broadcast(steps), F.col("__step") == F.col("__s"))
    # Scores are whole thousandths of logarithms, so there are some 100,000 values at most, whatever the table.
    first = placed.select(F.col("score").alias("__score"), (F.col("__before") + F.col("__in")).alias("__above")).where(F.col("__above") < draw)

    marked = scored.join(F.broadcast(first), able & (F.col("score") == F.col("__score")), "left")
    out = [F.col("__id").alias(id_col), "n_features", "weight", "score"]
    rest = marked.where(F.col("__above").isNull()).select(*out, F.lit(None).cast("bigint").alias("rank"))
    alike = marked.where(F.col("__above").isNotNull()).groupBy("__id", "n_features", "weight", "score", "__above").agg(F.count(F.lit(1)).alias("__rows"))
    before = Window.partitionBy("score").orderBy("__id", "n_features", "weight").rowsBetween(Window.unboundedPreceding, -1)
    begun = alike.withColumn("__first", F.col("__above") + F.coalesce(F.sum("__rows").over(before), F.lit(0)))
    # Laid out in two steps, so that no array grows with the number of rows.
    blocks = begun.withColumn("__at", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("__rows") - 1, F.lit(BLOCK))))
    each = blocks.withColumn("__rank", F.explode(F.sequence(F.col("__first") + F.col("__at") + 1, F.col("__first") + F.least(F.col("__at") + BLOCK, F.col("__rows")))))
    return rest.unionByName(each.select(*out, F.when(F.col("__rank") <= draw, F.col("__rank")).cast("bigint").alias("rank")))


def drawn(docs: DataFrame, ranks: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The rows of ``docs`` whose id has a rank in ``ranks`` (of ``resample``); rows with a null id are not among them."""
    ids = ranks.where(F.col("rank").isNotNull()).select(F.col(id_col).alias("__drawn")).distinct()
    return docs.join(ids, docs[id_col] == F.col("__drawn"), "left_semi")
