"""What surrounds a neural denoiser: bands, features, and the use of its gains and filters. Weights are not part of it."""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .recurrences import biquad


@dataclass(frozen=True)
class Config:
    rate: float = 48_000.0
    size: int = 960
    hop: int = 480
    bands: int = 32
    low_bins: int = 96
    least_bins: int = 2
    order: int = 5
    ahead: int = 2
    seconds: float = 1.0
    #: Local signal-to-noise ratios: under the first nothing is left; over the second nothing is done; over the third only
    #: the bands' gains are used.
    limits: tuple[float, float, float] = (-10.0, 30.0, 20.0)


#: Where the running mean of band levels (dB) and the running magnitude of bins start, over their range.
MEAN_START, UNIT_START = (-60.0, -90.0), (0.001, 0.0001)


def band_widths(c: Config) -> list[int]:
    """Bins of each band, equal on the ERB scale; a band too narrow borrows from the next, and the last takes what is left."""
    erb = lambda hz: 9.265 * math.log1p(hz / (24.7 * 9.265))
    hz = lambda e: 24.7 * 9.265 * math.expm1(e / 9.265)
    edges = [math.floor(hz(erb(c.rate / 2) * i / c.bands) * c.size / c.rate + 0.5) for i in range(c.bands + 1)]
    widths, debt = [], 0
    for low, high in zip(edges, edges[1:], strict=False):
        own = high - low - debt
        debt = max(0, c.least_bins - own)
        widths.append(own + debt)
    widths[-1] += min(1, c.size // 2 + 1 - sum(widths))
    return widths


def band_map(c: Config) -> list[tuple[int, int]]:
    """(bin, band) of every bin."""
    bands = np.repeat(np.arange(c.bands), band_widths(c))
    return list(enumerate(bands.tolist()))


def band_levels(cells: DataFrame, key: list[str], c: Config) -> DataFrame:
    """``key``, band, db: mean power of a frame's bins in each band; cells are (``key``, k, p). The map has one row a bin."""
    pairs = F.array(*[F.struct(F.lit(k).alias("bk"), F.lit(b).alias("band")) for k, b in band_map(c)])
    bands = cells.sparkSession.range(1).select(F.inline(pairs))
    return cells.join(F.broadcast(bands), F.col("k") == F.col("bk")).groupBy(*key, "band").agg((10.0 * F.log10(F.avg("p") + 1e-10)).alias("db"))


def decay_of(c: Config) -> float:
    """The running means' coefficient, rounded to as few digits (three at least) as keep it under 1."""
    exact, digits = math.exp(-c.hop / c.rate / c.seconds), 3
    while math.floor(exact * 10**digits + 0.5) >= 10**digits:
        digits += 1
    return math.floor(exact * 10**digits + 0.5) / 10**digits


def _running(x: np.ndarray, start: np.ndarray, a: float) -> np.ndarray:
    """y = (1 - a) x + a y[-1] down the frames, from ``start``."""
    out = np.stack([biquad(column, (1 - a, 0.0, 0.0, -a, 0.0)) for column in x.T], axis=1)
    return out + start * a ** np.arange(1, len(x) + 1)[:, None]


def features(spectra: np.ndarray, c: Config) -> tuple[np.ndarray, np.ndarray]:
    """(band features, low bins by their running magnitude) of frames (frames x bins, complex)."""
    power = np.abs(spectra) ** 2
    edges = np.concatenate([[0], np.cumsum(band_widths(c))])
    level = 10 * np.log10(np.add.reduceat(power, edges[:-1], axis=1) / np.diff(edges) + 1e-10)
    a = decay_of(c)
    bands = (level - _running(level, np.linspace(*MEAN_START, c.bands), a)) / 40
    low = spectra[:, : c.low_bins]
    return bands, low / np.sqrt(_running(np.abs(low), np.linspace(*UNIT_START, c.low_bins), a))


def apply_model(noisy: np.ndarray, gains: np.ndarray, filters: np.ndarray, lsnr: np.ndarray, c: Config, limit_db: float = 0.0) -> np.ndarray:
    """Frames with a model's output used: ``gains`` (frames x bands), ``filters`` (frames x low bins x order, complex) and
    local signal-to-noise ratios. The model is ``ahead`` frames ahead of the frame it speaks for; frames beyond it pass."""
    n, bins = noisy.shape
    out = noisy.copy()
    spoken = np.arange(n) + c.ahead < len(lsnr)
    level = np.full(n, np.inf)
    level[spoken] = lsnr[c.ahead : c.ahead + spoken.sum()]
    none, whole, mask = c.limits
    out[level < none] = 0
    masked = np.flatnonzero((level >= none) & (level <= whole))
    wide = np.repeat(gains[masked + c.ahead], band_widths(c), axis=1)[:, :bins]
    out[masked, c.low_bins :] = noisy[masked, c.low_bins :] * wide[:, c.low_bins :]
    deep = np.flatnonzero((level >= none) & (level <= mask))
    padded = np.zeros((n + c.order, c.low_bins), dtype=complex)
    padded[c.ahead : c.ahead + n] = noisy[:, : c.low_bins]
    out[deep, : c.low_bins] = sum(padded[deep + o] * filters[deep + c.ahead, :, o] for o in range(c.order))
    keep = 10 ** (-limit_db / 20) if limit_db > 0 else 0.0
    return out * (1 - keep) + noisy * keep


def in_chunks(frames: int, size: int, warm: int, run: Callable[[int, int], np.ndarray]) -> np.ndarray:
    """``run(first, last)`` over chunks of ``size`` frames with ``warm`` frames ahead of each, which are dropped again."""
    out = []
    for at in range(0, frames, size):
        first = max(0, at - warm)
        out.append(run(first, min(frames, at + size))[at - first :])
    return np.concatenate(out)
