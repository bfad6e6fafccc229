"""Scalar functions of audio measurement as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MINUS_INF = float("-inf")


def js_round(x: Column) -> Column:
    """Halves go up."""
    return F.floor(x + 0.5)


def db_to_lin(db: Column) -> Column:
    return F.pow(F.lit(10.0), db / 20.0)


def clamp(x: Column, most: float) -> Column:
    return F.greatest(F.lit(-most), F.least(F.lit(most), x))


def lufs(mean_square: Column) -> Column:
    """Loudness of a mean square; null where there is no power (minus infinity at the report's edge)."""
    return F.when(mean_square > 0, -0.691 + 10.0 * F.log10(mean_square))


def lufs_or_silence(mean_square: Column) -> Column:
    return F.coalesce(lufs(mean_square), F.lit(MINUS_INF))


def db(linear: Column) -> Column:
    """20 log10, null for zero."""
    return F.when(linear > 0, 20.0 * F.log10(linear))


def channel_weight(ch: Column) -> Column:
    return F.when(ch >= 3, 1.41).otherwise(1.0)


def erb_rate(hz: Column) -> Column:
    return 9.265 * F.log1p(hz / (24.7 * 9.265))


def erb_to_hz(erb: Column) -> Column:
    return 24.7 * 9.265 * (F.exp(erb / 9.265) - 1.0)


def nearest_rank(n: Column, p: float) -> Column:
    """The rank, from 0, of the p-th percentile (0 to 100) of n ascending values, by nearest rank."""
    return js_round(F.lit(p / 100.0) * (n - 1))


def floor_rank(n: Column, share: float) -> Column:
    """The rank min(n - 1, floor(n * share)), from 0, of n ascending values."""
    return F.least(n - 1, F.floor(n * share))


def compressor_gain(level: Column, threshold: float, ratio: float, knee: float, cap: float) -> Column:
    """Gain in dB of a downward compressor with a quadratic knee; at most ``cap`` dB of reduction."""
    over, slope = level - threshold, 1.0 - 1.0 / ratio
    bent = slope * (over + knee / 2.0) * (over + knee / 2.0) / (2.0 * knee) if knee > 0 else F.lit(0.0)
    cut = F.when(over <= -knee / 2.0, 0.0).when(over < knee / 2.0, bent).otherwise(slope * over)
    return -F.least(F.lit(cap), cut)


def expander_gain(level: Column, threshold: float, ratio: float, knee: float, cap: float) -> Column:
    """Gain in dB of a downward expander with a quadratic knee; at most ``cap`` dB of reduction."""
    under, slope = threshold - level, ratio - 1.0
    bent = slope * (under + knee / 2.0) * (under + knee / 2.0) / (2.0 * knee) if knee > 0 else F.lit(0.0)
    cut = F.when(under <= -knee / 2.0, 0.0).when(under < knee / 2.0, bent).otherwise(slope * under)
    return -F.least(F.lit(cap), cut)


def adaptive_reduction(clean_snr: float, snr: Column, requested: float) -> Column:
    """How much of a requested noise reduction a recording of a given signal-to-noise ratio needs."""
    need = F.greatest(F.lit(0.0), F.least(F.lit(requested), clean_snr - snr))
    return F.when(snr.isNull() | F.isnan(snr), requested).otherwise(need)


def snr_stage(lsnr: Column) -> Column:
    """What a frame's local signal-to-noise ratio calls for: nothing left, nothing done, a mask, or a mask and filter."""
    return F.when(lsnr < -10, "zero").when(lsnr > 30, "pass").when(lsnr > 20, "mask").otherwise("mask+filter")
