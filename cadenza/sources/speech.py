"""Synthetic talk: voiced spurts with formants and syllables, at exact segment loudness, over a noise floor."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.filters import peaking
from ..operators.recurrences import cascade
from .synthetic import uniform

#: Formants of five vowels, in Hz.
VOWELS = ((730, 1090, 2440), (530, 1840, 2480), (270, 2290, 3010), (570, 840, 2410), (300, 870, 2240))
SCHEMA = "rec string, n bigint, x double"


def spurt(rate: float, seconds: float, f0: float, seed: int) -> np.ndarray:
    """One spurt of talk, of RMS 0.1: pulses of a slowly wandering pitch through a vowel's formants, by syllables."""
    n = int(math.floor(seconds * rate + 0.5))
    at = np.arange(n)
    knots = max(2, int(seconds * 6) + 2)
    place = np.linspace(0, knots - 1, n)
    wander = np.interp(place, np.arange(knots), 2 * uniform(seed, np.arange(knots)) - 1)
    pitch = f0 * (1 + 0.08 * wander) * (1 - 0.12 * at / max(1, n))
    phase = np.cumsum(pitch / rate) % 1.0
    pulse = np.where(phase < 0.4, 0.5 - 0.5 * np.cos(np.pi * phase / 0.4), np.where(phase < 0.56, np.cos(np.pi / 2 * (phase - 0.4) / 0.16), 0.0))
    voice = np.diff(pulse, prepend=0.0) + 0.02 * (2 * uniform(seed + 1, at) - 1)
    out = np.zeros(n)
    size = max(1, int(0.22 * rate))
    for k, start in enumerate(range(0, n, size)):
        stop, lead = min(n, start + size), max(0, start - size // 4)
        vowel = VOWELS[int(uniform(seed + 2, np.array([k]))[0] * len(VOWELS))]
        formants = [peaking(f, 18.0, 5.0, rate) for f in (*vowel, 3700) if f < rate / 2.2]
        part = cascade(voice[lead:stop], formants)
        shape = np.sin(np.pi * np.clip((np.arange(lead, stop) - lead + 0.5) / (stop - lead), 0, 1)) ** 0.7
        out[lead:stop] += part * shape
    rms = math.sqrt(float((out**2).mean())) if n else 0.0
    return out * (0.1 / rms) if rms > 0 else out


def talk(spark: SparkSession, rec: str, rate: float, segments: list[tuple[float, float, float]], pause: float, floor_db: float, seed: int) -> tuple[DataFrame, DataFrame]:
    """(samples, bounds): segments of (seconds, level in dB, f0) with pauses before, between and after them, over noise of
    ``floor_db``; bounds are rec, i, start, end, level_db. Each segment is made by its own task."""
    gap = int(math.floor(pause * rate + 0.5))
    rows, at = [], gap
    for i, (seconds, level, f0) in enumerate(segments):
        n = int(math.floor(seconds * rate + 0.5))
        rows.append((rec, i, at, at + n, float(level), float(f0)))
        at += n + gap
    plan = spark.createDataFrame(rows, "rec string, i int, start bigint, end bigint, level_db double, f0 double")

    def speak(part: pd.DataFrame) -> pd.DataFrame:
        r = part.iloc[0]
        x = spurt(rate, (r["end"] - r["start"]) / rate, r["f0"], seed + 100 * int(r["i"]))
        x *= 10 ** (r["level_db"] / 20) / math.sqrt(max(1e-30, float((x**2).mean())))
        return pd.DataFrame({"rec": r["rec"], "n": np.arange(r["start"], r["end"]), "x": x})

    def hiss(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            yield pd.DataFrame({"rec": rec, "n": f["id"], "x": (2 * uniform(seed, f["id"].to_numpy()) - 1) * math.sqrt(3) * 10 ** (floor_db / 20)})

    voiced = plan.groupBy("rec", "i").applyInPandas(speak, SCHEMA)
    samples = spark.range(at).mapInPandas(hiss, SCHEMA).unionByName(voiced).groupBy("rec", "n").agg(F.sum("x").alias("x"))
    return samples, plan.drop("f0")
