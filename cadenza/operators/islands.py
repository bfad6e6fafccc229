"""Runs, gaps and merged intervals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def runs(frames: DataFrame, at: str, chunk: int = 1 << 14) -> DataFrame:
    """rec, first, last: maximal runs of consecutive values of ``at`` (each once in a rec).

    Runs are found inside chunks, and those that touch at chunk edges are merged, so only runs pass the second step.
    """
    cut = F.floor(F.col(at) / chunk)
    inside = Window.partitionBy("rec", "c").orderBy(at)
    local = frames.select("rec", at, cut.alias("c")).withColumn("island", F.col(at) - F.row_number().over(inside))
    pieces = local.groupBy("rec", "c", "island").agg(F.min(at).alias("first"), F.max(at).alias("last"))
    return merge_intervals(pieces.select("rec", "first", "last"), 1)


def merge_intervals(pieces: DataFrame, gap: int) -> DataFrame:
    """rec, first, last: intervals joined where the next starts at most ``gap`` after the running end."""
    order = Window.partitionBy("rec").orderBy("first", "last")
    before = F.max("last").over(order.rowsBetween(Window.unboundedPreceding, -1))
    marked = pieces.withColumn("new", F.when(before.isNull() | (F.col("first") - before > gap), 1).otherwise(0))
    grouped = marked.withColumn("g", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return grouped.groupBy("rec", "g").agg(F.min("first").alias("first"), F.max("last").alias("last")).drop("g")


def silences(frames: DataFrame, quiet: Column, hop: int, least: int, size: DataFrame) -> DataFrame:
    """rec, i, start, end, mid: runs of at least ``least`` frames (rec, f) that are ``quiet``, in samples."""
    found = runs(frames.where(quiet).select("rec", "f"), "f").where(F.col("last") - F.col("first") + 1 >= least)
    spans = found.join(size, "rec").select("rec", (F.col("first") * hop).alias("start"), F.least("length", (F.col("last") + 1) * hop).alias("end"))
    numbered = spans.withColumn("i", (F.row_number().over(Window.partitionBy("rec").orderBy("start")) - 1).cast("bigint"))
    return numbered.select("rec", "i", "start", "end", F.floor((F.col("start") + F.col("end")) / 2).alias("mid"))


def complement(spans: DataFrame, size: DataFrame) -> DataFrame:
    """rec, start, end: what the ordered, disjoint ``spans`` (rec, start, end) leave of [0, length)."""
    order = Window.partitionBy("rec").orderBy("start")
    gaps = spans.select("rec", F.coalesce(F.lag("end").over(order), F.lit(0)).alias("start"), F.col("start").alias("end"))
    ends = size.join(spans.groupBy("rec").agg(F.max("end").alias("done")), "rec", "left")
    tail = ends.select("rec", F.coalesce("done", F.lit(0)).alias("start"), F.col("length").alias("end"))
    return gaps.unionByName(tail).where("end > start")


def segments(quiet: DataFrame, size: DataFrame) -> DataFrame:
    """rec, i, start, end: the recording cut at the middle of each silence."""
    cuts = quiet.select("rec", F.col("mid").alias("at")).unionByName(size.select("rec", F.lit(0).cast("bigint").alias("at"))).unionByName(size.select("rec", F.col("length").alias("at"))).distinct()
    order = Window.partitionBy("rec").orderBy("at")
    pairs = cuts.select("rec", F.col("at").alias("start"), F.lead("at").over(order).alias("end"), (F.row_number().over(order) - 1).cast("bigint").alias("i"))
    return pairs.where("end IS NOT NULL").select("rec", "i", "start", "end")
