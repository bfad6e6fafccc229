"""Spectra over ranges of a recording (speech, pauses), and filters and noise profiles that differ by recording."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.layout import CHUNK, packed, with_halo

#: Fewest frames from which a spectrum is taken.
LEAST_FRAMES = 4


def _with_ranges(samples: DataFrame, ranges: DataFrame, after: int, chunk: int) -> DataFrame:
    """Chunks of samples with the ranges (rec, start, end) that touch them, as an array."""
    pieces = ranges.withColumn("rchunk", F.explode(F.sequence(F.floor(F.col("start") / chunk), F.floor((F.col("end") - 1) / chunk))))
    lists = pieces.groupBy(F.col("rec").alias("rrec"), "rchunk").agg(F.collect_list(F.struct("start", "end")).alias("ranges"))
    rows = with_halo(samples.select("rec", "n", "x"), 0, after, chunk)
    return rows.join(lists, (F.col("rec") == F.col("rrec")) & (F.col("chunk") == F.col("rchunk")))


def range_spectrum(samples: DataFrame, ranges: DataFrame, window: np.ndarray, hop: int, anchored: bool = True, chunk: int = CHUNK) -> DataFrame:
    """rec, frames, k, p: mean power of the frames that lie in ranges (rec, start, end) whole; recordings with fewer than
    LEAST_FRAMES have no rows. Frames start with their range, or at multiples of ``hop`` where not ``anchored``.

    A chunk gives the sum over the frames that start in it, one row; sums are added by recording and bin.
    """
    size = len(window)

    def run(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("n", ignore_index=True)
        x, first = part["x"].to_numpy(dtype=np.float64), int(part["n"].iloc[0])
        own = part.loc[part["core"], "n"]
        starts: list[int] = []
        for r in part["ranges"].iloc[0] if len(own) else ():
            base = int(r["start"]) if anchored else -(-int(r["start"]) // hop) * hop
            low = base + max(0, -(-(int(own.iloc[0]) - base) // hop)) * hop
            starts += range(low, min(int(own.iloc[-1]), int(r["end"]) - size) + 1, hop)
        total = np.zeros(size // 2 + 1)
        for at in starts:
            total += np.abs(np.fft.rfft(x[at - first : at - first + size] * window)) ** 2
        return pd.DataFrame({"rec": [part["rec"].iloc[0]], "frames": [len(starts)], "power": [total]})

    sums = _with_ranges(samples, ranges, size, max(chunk, size)).groupBy("rec", "chunk").applyInPandas(run, "rec string, frames bigint, power array<double>")
    cells = sums.select("rec", "frames", F.posexplode("power").alias("k", "p")).groupBy("rec", "k").agg(F.sum("frames").alias("frames"), F.sum("p").alias("p"))
    return cells.where(F.col("frames") >= LEAST_FRAMES).select("rec", "frames", "k", (F.col("p") / F.col("frames")).alias("p"))


def quietest_spectrum(samples: DataFrame, size: DataFrame, window: np.ndarray, hop: int, share: float = 0.2) -> DataFrame:
    """rec, frames, k, p: by bin, the mean power of the quietest ``share`` of a recording's frames (minimum statistics)."""
    width = len(window)

    def run(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("n", ignore_index=True)
        x, first, end = part["x"].to_numpy(dtype=np.float64), int(part["n"].iloc[0]), int(part["n"].iloc[-1]) + 1
        own = part.loc[part["core"], "n"]
        starts = [at for at in range(-(-int(own.iloc[0]) // hop) * hop, int(own.iloc[-1]) + 1, hop) if at + width <= end] if len(own) else []
        powers = [np.abs(np.fft.rfft(x[at - first : at - first + width] * window)) ** 2 for at in starts]
        return pd.DataFrame({"rec": [part["rec"].iloc[0]] * len(starts), "power": powers})

    frames = with_halo(samples.select("rec", "n", "x"), 0, width, max(CHUNK, width)).groupBy("rec", "chunk").applyInPandas(run, "rec string, power array<double>")
    cells = frames.select("rec", F.posexplode("power").alias("k", "p"))
    ranked = cells.select("rec", "k", "p", F.row_number().over(Window.partitionBy("rec", "k").orderBy("p")).alias("r"), F.count(F.lit(1)).over(Window.partitionBy("rec", "k")).alias("c"))
    take = F.greatest(F.lit(1), F.floor(F.col("c") * share))
    return ranked.where(F.col("r") <= take).groupBy("rec", "k").agg(F.count(F.lit(1)).alias("frames"), F.avg("p").alias("p"))


def log_curves(spectra: DataFrame, rate: float, size: int, low: float = 50.0, high: float = 16_000.0, per_octave: int = 12, octaves: float = 1 / 3, least_hz: float = 120.0) -> DataFrame:
    """rec, i, freq, db: spectra (rec, k, p) on a grid of log frequencies, each point the mean power over ``octaves``, and
    over ``least_hz`` at least."""
    top, hz = min(high, rate / 2 - 1), rate / size
    span = math.log2(top / low)
    points = max(2, int(math.floor(span * per_octave + 0.5)) + 1)
    grid = []
    for i in range(points):
        f = low * 2 ** (i / (points - 1) * span)
        a, b = f / 2 ** (octaves / 2), f * 2 ** (octaves / 2)
        if b - a < least_hz:
            a, b = f - least_hz / 2, f + least_hz / 2
        first = max(1, math.floor(a / hz))
        grid.append((i, f, first, max(first, min(size // 2, math.ceil(b / hz)))))
    bands = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(f).alias("freq"), F.lit(a).alias("a"), F.lit(b).alias("b")) for i, f, a, b in grid])
    wanted = spectra.sparkSession.range(1).select(F.inline(bands)).select("i", "freq", F.explode(F.sequence("a", "b")).alias("bin"))
    met = spectra.join(F.broadcast(wanted), F.col("k") == F.col("bin"))  # a grid of some hundred points
    return met.groupBy("rec", "i", "freq").agg((10.0 * F.log10(F.avg("p") + 1e-30)).alias("db"))


def with_target(curves: DataFrame, octaves: float = 1.5) -> DataFrame:
    """``curves`` (rec, i, freq, db) with target: the mean power of the points within ``octaves`` / 2 of each, in dB."""
    other = curves.select(F.col("rec").alias("orec"), F.col("freq").alias("ofreq"), F.pow(F.lit(10.0), F.col("db") / 10.0).alias("op"))
    near = curves.join(other, (F.col("rec") == F.col("orec")) & (F.abs(F.log2(F.col("ofreq") / F.col("freq"))) <= octaves / 2 + 1e-12))
    return near.groupBy("rec", "i", "freq", "db").agg((10.0 * F.log10(F.avg("op") + 1e-30)).alias("target"))


def band_levels(spectra: DataFrame, rate: float, size: int, low: float, high: float, name: str) -> DataFrame:
    """rec, ``name``: mean power in dB of the bins from ``low`` to ``high`` Hz."""
    hz = rate / size
    inside = spectra.where((F.col("k") >= math.ceil(low / hz)) & (F.col("k") <= math.floor(high / hz)))
    return inside.groupBy("rec").agg((10.0 * F.log10(F.avg("p") + 1e-30)).alias(name))


def settings_rows(structs: pd.DataFrame | pd.Series) -> list[dict]:
    """The rows of a struct column, which pandas may hold as a table of its own."""
    return structs.to_dict("records") if isinstance(structs, pd.DataFrame) else [dict(r) if isinstance(r, dict) else r.asDict() for r in structs]


def by_recording(samples: DataFrame, settings: DataFrame, kernel: Callable[[np.ndarray, pd.Series], np.ndarray], before: int, after: int = 0, chunk: int = CHUNK) -> DataFrame:
    """rec, n, x of the recordings that ``settings`` (one row each) has: ``kernel`` of each chunk's samples and its row.

    A chunk is one row when it meets its recording's settings, so these are not repeated for its samples.
    """
    chunk = max(chunk, before, after)
    told = settings.select(F.col("rec").alias("srec"), F.struct(*[c for c in settings.columns if c != "rec"]).alias("settings"))
    rows = packed(samples, before, max(1, after), chunk).join(told, F.col("rec") == F.col("srec")).drop("srec")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for rec, number, first, x, own in zip(frame["rec"], frame["chunk"], frame["first"], frame["x"], settings_rows(frame["settings"]), strict=True):
                got = kernel(np.frombuffer(x, dtype="<f8").copy(), own)
                n = np.arange(first, first + len(got))
                mine = n // chunk == number
                yield pd.DataFrame({"rec": rec, "n": n[mine], "x": got[mine]})

    return rows.mapInPandas(run, "rec string, n bigint, x double")
