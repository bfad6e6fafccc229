"""The event stream read as signals: one recording for each type of event."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .layout import number_rows

#: Window constants of this material, in samples.
BLOCK, HOP, FRAME, MIN_RUN = 40, 10, 3, 12


def event_signal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """rec, n, x: the values in order of time, alternating in sign by id, with every fourth minute of 60 near silence."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "ts", F.col("event_type").alias("rec"), F.col("value").cast("double").alias("value"))
    numbered = number_rows(events, "rec", ["ts", "event_id"], F.date_trunc("day", "ts"))
    sign = F.when(F.col("event_id") % 2 == 0, 1.0).otherwise(-1.0)
    quiet = F.when(F.floor(F.col("n") / 60) % 4 == 3, 0.001).otherwise(1.0)
    return numbered.select("rec", "n", (F.col("value") / 1024.0 * sign * quiet).alias("x"))


def two_channels(samples: DataFrame) -> DataFrame:
    """The signal and itself one sample later, as channels 0 and 1."""
    late = samples.select("rec", F.lit(1).alias("ch"), (F.col("n") + 1).alias("n"), "x")
    return samples.select("rec", F.lit(0).alias("ch"), "n", "x").unionByName(late)
