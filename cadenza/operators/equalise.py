"""Corrective equalisation: fitting bands to a curve's deviation from its broad shape. A curve has some hundred points."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from ..functions.filters import Biquad, high_pass, peaking, response_db

#: Voicings as (frequency, gain in dB, Q).
VOICINGS = {"neutral": (), "warm": ((95.0, 1.0, 0.7), (3400.0, -1.1, 0.9))}


@dataclass
class Band:
    freq: float
    gain_db: float
    q: float


def fit_bands(freqs: np.ndarray, deviation: np.ndarray, rate: float, snr: np.ndarray | None = None, most: int = 5, least_db: float = 2.0, cut: float = 6.0, boost: float = 3.0, share: float = 0.8, clean_snr: float = 15.0, low: float = 80.0, high: float = 12_000.0) -> list[Band]:
    """Bands that take out the worst deviations one by one; a boost needs ``clean_snr`` dB of signal over noise there."""
    dev, usable, bands = deviation.astype(float).copy(), (freqs >= low) & (freqs <= high), []
    while len(bands) < most and usable.any():
        i = int(np.argmax(np.where(usable, np.abs(dev), -1)))
        if abs(dev[i]) < least_db:
            break
        wanted = -dev[i] * share
        if wanted > 0 and (snr is None or snr[i] < clean_snr):
            usable[i] = False
            continue
        gain = min(boost, max(-cut, wanted))
        band = Band(float(freqs[i]), gain, _q(freqs, dev, i))
        bands.append(band)
        dev += [response_db([peaking(band.freq, gain, band.q, rate)], f, rate) for f in freqs]
    return bands


def _q(freqs: np.ndarray, dev: np.ndarray, i: int) -> float:
    """Q of the bump around a point, from where it falls to half its height on the same side."""
    half, sign = abs(dev[i]) / 2, np.sign(dev[i])
    a = b = i
    while a > 0 and sign * dev[a - 1] > half:
        a -= 1
    while b < len(dev) - 1 and sign * dev[b + 1] > half:
        b += 1
    octaves = max(0.1, math.log2(freqs[b] / freqs[a]) if b > a else 0.1)
    return float(np.clip(math.sqrt(2**octaves) / (2**octaves - 1), 0.7, 4.0))


def cascade_of(bands: list[Band], rate: float, rumble: float | None = None, voicing: str = "neutral") -> list[Biquad]:
    head = [high_pass(rumble, rate)] if rumble else []
    return head + [peaking(b.freq, b.gain_db, b.q, rate) for b in bands] + [peaking(f, g, q, rate) for f, g, q in VOICINGS[voicing]]


def fit_curves(curves: DataFrame, rate: float, **options) -> DataFrame:
    """rec, i, freq, gain_db, q of curves (rec, freq, db, target and maybe snr): one group of grid points for each recording."""

    def fit(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("freq", ignore_index=True)
        snr = part["snr"].fillna(-np.inf).to_numpy() if "snr" in part else None
        bands = fit_bands(part["freq"].to_numpy(), (part["db"] - part["target"]).to_numpy(), rate, snr=snr, **options)
        return pd.DataFrame([(part["rec"].iloc[0], i, b.freq, b.gain_db, b.q) for i, b in enumerate(bands)], columns=["rec", "i", "freq", "gain_db", "q"])

    return curves.groupBy("rec").applyInPandas(fit, "rec string, i int, freq double, gain_db double, q double")
