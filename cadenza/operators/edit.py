"""Plain edits of signals: mixing channels down, cutting, reversing, joining channels, and envelopes as points in time."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.num import db_to_lin
from ..sources.layout import lengths


def downmix(samples: DataFrame) -> DataFrame:
    """rec, n, x: the mean over channels of (rec, ch, n, x)."""
    return samples.groupBy("rec", "n").agg(F.avg("x").alias("x"))


def cut(samples: DataFrame, start: int, length: int) -> DataFrame:
    """Samples start..start + length, counted from 0; recordings that end before give no rows."""
    return samples.where((F.col("n") >= start) & (F.col("n") < start + length)).withColumn("n", F.col("n") - start)


def reverse(samples: DataFrame) -> DataFrame:
    return samples.join(lengths(samples), "rec").select("rec", (F.col("length") - 1 - F.col("n")).alias("n"), "x")


def flatten(samples: DataFrame) -> DataFrame:
    """rec, n, x: the channels of (rec, ch, n, x) end to end, each as long as the longest."""
    size = samples.groupBy("rec").agg((F.max("n") + 1).alias("length"))
    return samples.join(size, "rec").select("rec", (F.col("n") + F.col("ch") * F.col("length")).alias("n"), "x")


def gain(samples: DataFrame, db: float) -> DataFrame:
    return samples.withColumn("x", F.col("x") * db_to_lin(F.lit(db)))


def envelope_points(points: DataFrame, rate: float, playback: float = 1.0, makeup_db: float = 0.0) -> DataFrame:
    """rec, seconds, value of breakpoints (rec, at, db): time as played and linear gain, less a makeup gain kept apart."""
    return points.select("rec", (F.col("at") / rate / playback).alias("seconds"), db_to_lin(F.col("db") - makeup_db).alias("value"))


def window_loudness_gate(windows: DataFrame, drop: float) -> DataFrame:
    """rec, w, lufs, is_speech of windows (rec, w, z): speech is at most ``drop`` LU under the recording's gated loudness over
    means of four windows in a row."""
    from ..functions.num import lufs
    from .loudness import gated

    blocks = windows.select("rec", F.explode(F.sequence(F.col("w") - 3, F.col("w"))).alias("b"), "z").where("b >= 0").groupBy("rec", "b").agg(F.avg("z").alias("z"), F.count(F.lit(1)).alias("c")).where("c = 4")
    whole = gated(blocks, ["rec"]).select("rec", F.col("lufs").alias("programme"))
    return windows.join(whole, "rec").select("rec", "w", lufs(F.col("z")).alias("lufs"), F.coalesce(lufs(F.col("z")) > F.col("programme") - drop, F.lit(False)).alias("is_speech"))
