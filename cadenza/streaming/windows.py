"""Streaming twins of the windowed measurements: event time, watermarks, append mode."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.num import lufs


def hopping_loudness(stream: DataFrame, window: str = "400 milliseconds", hop: str = "100 milliseconds", late: str = "2 seconds") -> DataFrame:
    """rec, start, lufs, samples of hopping windows over (rec, ts, x); a window is final ``late`` after its end."""
    grouped = stream.withWatermark("ts", late).groupBy("rec", F.window("ts", window, hop).alias("w"))
    sums = grouped.agg(F.avg(F.col("x") * F.col("x")).alias("z"), F.count(F.lit(1)).alias("samples"))
    return sums.select("rec", F.col("w.start").alias("start"), lufs(F.col("z")).alias("lufs"), "samples")


def silent_sessions(stream: DataFrame, level: float, gap: str = "1 second", late: str = "2 seconds") -> DataFrame:
    """rec, start, end, samples: sessions of samples no larger than ``level`` that are less than ``gap`` apart."""
    # A sample that is loud has no gap, so no session; as it is not filtered out, it still moves the watermark.
    own = F.when(F.abs("x") <= level, gap).otherwise("0 seconds")
    sessions = stream.withWatermark("ts", late).groupBy("rec", F.session_window("ts", own).alias("w")).agg(F.count(F.lit(1)).alias("samples"))
    return sessions.select("rec", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "samples")


def smoothed(stream: DataFrame, coefficient: float) -> DataFrame:
    """rec, n, y: y = (1 - c) * x + c * y[-1] over (rec, n, x), the last value of each recording kept as state.

    Samples of a recording arrive in order of n; a batch is ordered before it is used.
    """

    def step(key: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        y = state.get[0] if state.exists else 0.0
        part = pd.concat(list(frames)).sort_values("n")
        out = np.empty(len(part))
        for i, x in enumerate(part["x"].to_numpy()):
            y = (1 - coefficient) * x + coefficient * y
            out[i] = y
        state.update((float(y),))
        yield pd.DataFrame({"rec": part["rec"], "n": part["n"], "y": out})

    return stream.groupBy("rec").applyInPandasWithState(step, "rec string, n bigint, y double", "y double", "append", "NoTimeout")
