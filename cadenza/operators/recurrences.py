"""Ordered recurrences over samples: filters, gain smoothing, limiting.

A filter forgets, and is run chunk by chunk: each chunk starts early enough that what came before no longer shows in double
precision, so chunks are independent and a long recording spreads over many tasks. Smoothers and limiters, whose step depends
on the state, are scans of maps (``scans``).
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from ..functions.filters import Biquad, k_weighting, settle
from ..sources.layout import CHUNK, with_halo
from .scans import Limiter, Smoother, scanned

Kernel = Callable[[np.ndarray], np.ndarray]


def by_chunk(samples: DataFrame, kernel: Kernel, before: int, after: int = 0, chunk: int = CHUNK, column: str = "x", out: str = "x") -> DataFrame:
    """rec, n and ``out``: ``kernel`` of the ordered ``column`` of each chunk and its halo, at the chunk's own rows.

    A halo longer than a chunk makes the chunk longer.
    """
    chunk = max(chunk, before, after)

    def run(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("n", ignore_index=True)
        part[out] = kernel(part[column].to_numpy(dtype=np.float64))
        return part.loc[part["core"], ["rec", "n", out]]

    rows = with_halo(samples.select("rec", "n", column), before, after, chunk)
    return rows.groupBy("rec", "chunk").applyInPandas(run, f"rec string, n bigint, {out} double")


def biquad_on(x: np.ndarray, c: Biquad, past: tuple[float, float, float, float]) -> tuple[np.ndarray, tuple[float, float, float, float]]:
    """One filter over an array that goes on from ``past`` (the last two inputs and the last two outputs, newest first): the
    output, and what the next array goes on from. Blocks of 256 are filtered at once, and the two state values carried over.

    In a block y = H x + O s with the impulse response H and the response O to the state s = (y[-1], y[-2]) and inputs.
    """
    b0, b1, b2, a1, a2 = c
    size, n = 256, len(x)
    if not n:
        return x, past
    x1, x2, one, two = past
    feed = b0 * x
    feed[1:] += b1 * x[:-1]
    feed[2:] += b2 * x[:-2]
    feed[0] += b1 * x1 + b2 * x2
    if n > 1:
        feed[1] += b2 * x1
    h = np.zeros(size + 1)
    h[0] = 1.0
    for i in range(1, size + 1):
        h[i] = -a1 * h[i - 1] - (a2 * h[i - 2] if i > 1 else 0.0)
    rows = -(-n // size)
    grid = np.zeros((rows, size))
    grid.reshape(-1)[:n] = feed
    toeplitz = np.where(np.arange(size)[:, None] >= np.arange(size)[None, :], h[np.abs(np.arange(size)[:, None] - np.arange(size)[None, :])], 0.0)
    local = grid @ toeplitz.T
    first, second = -a1 * h[:size] - a2 * np.concatenate([[0.0], h[: size - 1]]), -a2 * h[:size]
    for i in range(rows):
        local[i] += first * one + second * two
        one, two = local[i, -1], local[i, -2]
    y = local.reshape(-1)[:n]
    return y, (float(x[-1]), float(x[-2]) if n > 1 else x1, float(y[-1]), float(y[-2]) if n > 1 else past[2])


def biquad(x: np.ndarray, c: Biquad) -> np.ndarray:
    """One filter over an array, from rest."""
    return biquad_on(x, c, (0.0, 0.0, 0.0, 0.0))[0]


def cascade(x: np.ndarray, filters: Sequence[Biquad]) -> np.ndarray:
    for c in filters:
        x = biquad(x, c)
    return x


def filtered(samples: DataFrame, filters: Sequence[Biquad], chunk: int = CHUNK) -> DataFrame:
    """Samples through a cascade of filters."""
    return by_chunk(samples, lambda x: cascade(x, filters), settle(filters), chunk=chunk)


def k_weighted(samples: DataFrame, rate: float) -> DataFrame:
    return filtered(samples, k_weighting(rate))


def one_pole(x: np.ndarray, a: float) -> np.ndarray:
    """y = (1 - a) * x + a * y[-1]."""
    return biquad(x, (1 - a, 0.0, 0.0, -a, 0.0))


def coefficient(ms: float, rate: float) -> float:
    """Decay of a one-pole smoother over one sample, for a time constant in milliseconds; 0 for no time."""
    return math.exp(-1.0 / (ms / 1000.0 * rate)) if ms > 0 else 0.0


def smooth_gain(target: np.ndarray, down: float, up: float) -> np.ndarray:
    """Gain in dB that moves to its target by ``down`` when the target is lower, else by ``up``; from 0 dB."""
    out, g = np.empty(len(target)), 0.0
    for i, t in enumerate(target.tolist()):
        g = t + (g - t) * (down if t < g else up)
        out[i] = g
    return out


def smoothed(targets: DataFrame, down: float, up: float, column: str = "x", chunk: int = CHUNK) -> DataFrame:
    """rec, n, gain_db: ``smooth_gain`` of each recording, as a scan."""
    return scanned(targets, Smoother(down, up), 0.0, column, "gain_db", chunk)


def limit_forward(required: np.ndarray, release: float, start: float = 1.0) -> np.ndarray:
    """Limiter gain: down at once to what is required, up by a one-pole release towards 1."""
    out, g = np.empty(len(required)), start
    for i, r in enumerate(required.tolist()):
        g = r if r < g else 1.0 - (1.0 - g) * release
        out[i] = g
    return out


def limiter_gain(required: DataFrame, release: float, column: str = "x", chunk: int = CHUNK) -> DataFrame:
    """rec, n, gain of required gains in 0..1: ``limit_forward`` of each recording, as a scan."""
    return scanned(required, Limiter(release), 0.0, column, "gain", chunk)
