"""Frame kernels that also tell what they did: samples, and beside them sums over the frames that add up over chunks.

A kernel takes the spectra of a chunk's frames and gives changed spectra and figures by frame. Chunks have a halo, so a frame
may be in several; it counts in the chunk in which it starts. Frames before the first sample count in a recording's first
chunk, frames after its last sample in its last chunk, so that totals are those of one run over the whole recording.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.layout import CHUNK, packed
from .longterm import settings_rows
from .transforms import dynamic_eq_states, dynamic_eq_warm, istft, stft, wiener_gains

#: Spectra (frames x bins) and the settings of their recording to changed spectra and, by name, a figure for each frame.
FrameKernel = Callable[[np.ndarray, dict | None], tuple[np.ndarray, dict[str, np.ndarray]]]

#: What a kernel tells, and how the figures of two frames become one.
DYNAMIC_EQ = {"cells": "sum", "reduced": "sum", "reduction": "sum", "worst": "max"}
DENOISE = {"noise_gain": "sum", "noise_cells": "sum", "speech_gain": "sum", "speech_cells": "sum"}


def measured(samples: DataFrame, kernel: FrameKernel, told: dict[str, str], size: int, hop: int, warm_frames: int, settings: DataFrame | None = None, chunk: int = CHUNK) -> DataFrame:
    """rec, first, values and a column for each name in ``told``: one row a chunk, with its samples from place ``first`` on.

    ``signal`` and ``totals`` take both results from these rows; write the rows first where both are wanted, so that the
    kernel runs once. With ``settings`` (rec and other columns, one row a recording) only recordings that it has are done.
    A figure that is not a number does not count. No samples give no rows.
    """
    before = (warm_frames * hop + 2 * size + hop - 1) // hop * hop
    chunk = -(-max(chunk, before, 2 * size) // hop) * hop
    rows = packed(samples, before, 2 * size, chunk)
    if settings is not None:
        own = settings.select(F.col("rec").alias("srec"), F.struct(*[c for c in settings.columns if c != "rec"]).alias("settings"))
        rows = rows.join(own, F.col("rec") == F.col("srec")).drop("srec")
    merge = {name: {"sum": np.nansum, "max": lambda v: np.nanmax(v, initial=0.0)}[kind] for name, kind in told.items()}

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            owns = settings_rows(frame["settings"]) if "settings" in frame else [None] * len(frame)
            for rec, number, first, last, x, own in zip(frame["rec"], frame["chunk"], frame["first"], frame["last"], frame["x"], owns, strict=True):
                held = np.frombuffer(x, dtype="<f8")
                spectra, figures = kernel(stft(held, size, hop), own)
                starts = first - size + hop * np.arange(len(spectra))
                mine = ((starts >= number * chunk) | (number == 0)) & ((starts < (number + 1) * chunk) | last)
                at = number * chunk - first
                values = istft(spectra, size, hop, len(held))[at : at + chunk]
                yield pd.DataFrame({"rec": [rec], "first": [number * chunk], "values": [values], **{name: [float(f(figures[name][mine]))] for name, f in merge.items()}})

    return rows.mapInPandas(run, "rec string, first bigint, values array<double>, " + ", ".join(f"{name} double" for name in told))


def signal(rows: DataFrame) -> DataFrame:
    """rec, n, x of what ``measured`` gives."""
    return rows.select("rec", "first", F.posexplode("values").alias("at", "x")).select("rec", (F.col("first") + F.col("at")).alias("n"), "x")


def totals(rows: DataFrame, told: dict[str, str]) -> DataFrame:
    """rec and the figures of whole recordings: chunks' figures added, or the largest of them."""
    return rows.groupBy("rec").agg(*[{"sum": F.sum, "max": F.max}[kind](name).alias(name) for name, kind in told.items()])


def _share(part: str, whole: str) -> Column:
    """A quotient that is 0 where there is nothing to divide by."""
    return F.when(F.col(whole) > 0, F.col(part) / F.col(whole)).otherwise(0.0)


def dynamic_eq(samples: DataFrame, rate: float, size: int = 1024, hop: int = 256, chunk: int = CHUNK) -> DataFrame:
    """``measured`` dynamic equalisation: cells (frames times bins), reduced (those held down by over 0.01 dB), reduction (the
    sum of their dB) and worst (the largest)."""

    def kernel(spectra: np.ndarray, _: dict | None) -> tuple[np.ndarray, dict[str, np.ndarray]]:
        state = dynamic_eq_states(np.abs(spectra) ** 2, rate, size, hop)
        down = np.where(state < -0.01, -state, 0.0)
        figures = {"cells": np.full(len(state), float(state.shape[1])), "reduced": (down > 0).sum(axis=1), "reduction": down.sum(axis=1), "worst": down.max(axis=1, initial=0.0)}
        return spectra * 10 ** (state / 20), figures

    return measured(samples, kernel, DYNAMIC_EQ, size, hop, dynamic_eq_warm(rate, hop), chunk=chunk)


def dynamic_eq_report(rows: DataFrame) -> DataFrame:
    """rec, max_reduction_db, mean_reduction_db (over the cells held down), active (their share)."""
    sums = totals(rows, DYNAMIC_EQ)
    return sums.select("rec", F.col("worst").alias("max_reduction_db"), _share("reduction", "reduced").alias("mean_reduction_db"), _share("reduced", "cells").alias("active"))


def denoised(samples: DataFrame, settings: DataFrame, size: int = 1024, hop: int = 256, warm_frames: int = 400, over: float = 1.5, chunk: int = CHUNK) -> DataFrame:
    """``measured`` Wiener gains with each recording's noise power by bin and reduction in dB (settings: rec, noise, applied).

    A cell under 4 times its noise counts as noise, one over 100 times as speech; sums of gains in dB, and counts, of each.
    """

    def kernel(spectra: np.ndarray, own: dict | None) -> tuple[np.ndarray, dict[str, np.ndarray]]:
        power, noise = np.abs(spectra) ** 2, np.array(own["noise"], dtype=np.float64)
        gains = wiener_gains(power, noise, 10 ** (-abs(own["applied"]) / 20), over=over)
        level, db = noise * over + 1e-20, 20 * np.log10(np.maximum(gains, 1e-12))
        low, high = power < 4 * level, power > 100 * level
        figures = {"noise_gain": (db * low).sum(axis=1), "noise_cells": low.sum(axis=1), "speech_gain": (db * high).sum(axis=1), "speech_cells": high.sum(axis=1)}
        return spectra * gains, figures

    return measured(samples, kernel, DENOISE, size, hop, warm_frames, settings, chunk)


def denoise_report(rows: DataFrame) -> DataFrame:
    """rec, noise_gain_db, speech_gain_db: mean gain of the cells that count as noise and as speech, 0 where there are none."""
    sums = totals(rows, DENOISE)
    return sums.select("rec", _share("noise_gain", "noise_cells").alias("noise_gain_db"), _share("speech_gain", "speech_cells").alias("speech_gain_db"))
