"""Seeded material: noise, tones, clicks, reverberation and degradations. Every sample is made from its place alone."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.num import lufs
from ..operators.loudness import integrated


def uniform(seed: int, at: np.ndarray) -> np.ndarray:
    """Draws in [0, 1) of the mulberry32 generator at places ``at``: its state is a counter, so any place is direct."""
    with np.errstate(over="ignore"):
        a = np.uint32(seed & 0xFFFFFFFF) + (at.astype(np.uint32) + np.uint32(1)) * np.uint32(0x6D2B79F5)
        t = (a ^ (a >> np.uint32(15))) * (a | np.uint32(1))
        t ^= t + (t ^ (t >> np.uint32(7))) * (t | np.uint32(61))
        return (t ^ (t >> np.uint32(14))) / 4294967296.0


def noise(spark: SparkSession, rec: str, length: int, seed: int) -> DataFrame:
    """rec, n, x: uniform noise in [-1, 1)."""

    def draw(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            yield pd.DataFrame({"rec": rec, "n": f["id"], "x": 2 * uniform(seed, f["id"].to_numpy()) - 1})

    return spark.range(length).mapInPandas(draw, "rec string, n bigint, x double")


def sine(spark: SparkSession, rec: str, length: int, freq: float, rate: float, amplitude: float = 0.5) -> DataFrame:
    return spark.range(length).select(F.lit(rec).alias("rec"), F.col("id").alias("n"), (amplitude * F.sin(2 * math.pi * freq * F.col("id") / rate)).alias("x"))


def concat(parts: list[tuple[DataFrame, int]], rec: str) -> DataFrame:
    """Signals of known lengths laid end to end."""
    at, out = 0, None
    for part, length in parts:
        moved = part.select(F.lit(rec).alias("rec"), (F.col("n") + at).alias("n"), "x")
        out = moved if out is None else out.unionByName(moved)
        at += length
    return out


def mix(signal: DataFrame, other: DataFrame) -> DataFrame:
    """The sum of two signals of the same recordings."""
    return signal.unionByName(other).groupBy("rec", "n").agg(F.sum("x").alias("x"))


def at_loudness(samples: DataFrame, target: float, block: int, hop: int) -> DataFrame:
    """Samples scaled to an integrated loudness; recordings without any stay as they are."""
    level = integrated(samples, block, hop).select(F.col("rec").alias("lrec"), "lufs")
    gain = F.coalesce(F.pow(F.lit(10.0), (target - F.col("lufs")) / 20.0), F.lit(1.0))
    return samples.join(level, F.col("rec") == F.col("lrec"), "left").select("rec", "n", (F.col("x") * gain).alias("x"))


def with_noise(samples: DataFrame, hiss: DataFrame, snr_db: float, block: int, hop: int) -> DataFrame:
    """Samples with noise ``snr_db`` LU under their integrated loudness."""
    level = integrated(samples, block, hop).select(F.col("rec").alias("lrec"), "lufs")
    power = hiss.groupBy(F.col("rec").alias("nrec")).agg(lufs(F.avg(F.col("x") * F.col("x"))).alias("own"))
    scaled = hiss.join(level, F.col("rec") == F.col("lrec")).join(power, F.col("rec") == F.col("nrec"))
    gain = F.pow(F.lit(10.0), (F.col("lufs") - snr_db - F.col("own")) / 20.0)
    return mix(samples, scaled.select("rec", "n", (F.col("x") * gain).alias("x")))


def click_places(length: int, count: int, width: int, seed: int) -> np.ndarray:
    """Places of clicks: one to a slot, off its middle by a seeded jitter."""
    margin = max(4 * width, 64)
    jitter = (uniform(seed, np.arange(count)) - 0.5) / count * 0.8
    return np.sort(np.floor(((np.arange(count) + 0.5) / count + jitter) * (length - 2 * margin) + margin + 0.5).astype(np.int64))


def with_clicks(samples: DataFrame, places: DataFrame, peak: float, width: int) -> DataFrame:
    """Samples with clicks at ``places`` (rec, site): alternating in sign, falling over ``width`` samples."""
    k = F.explode(F.sequence(F.lit(0), F.lit(width - 1)))
    taps = places.select("rec", "site", k.alias("k"))
    shape = peak * F.when(F.col("k") % 2 == 0, 1.0).otherwise(-1.0) * (1 - F.col("k") / width)
    return mix(samples, taps.select("rec", (F.col("site") + F.col("k")).alias("n"), shape.alias("x")))


def room_response(rate: float, rt60: float = 0.6, direct_db: float = 6.0, seed: int = 31337, pre_delay: float = 0.012) -> np.ndarray:
    """A room's impulse response: the direct sound and, from ``pre_delay`` seconds on, a noise tail that falls by 60 dB in
    ``rt60`` seconds and lies ``direct_db`` under the direct sound in energy."""
    n, start = max(2, math.floor(1.5 * rt60 * rate + 0.5)), math.floor(pre_delay * rate + 0.5)
    out, at = np.zeros(n), np.arange(max(0, n - start))
    out[0] = 1.0
    tail = (2 * uniform(seed, at) - 1) * np.exp(-math.log(1000) / (rt60 * rate) * at)
    energy = (tail**2).sum()
    out[start:] = tail * math.sqrt(10 ** (-direct_db / 10) / energy) if energy > 0 else tail
    return out
