"""Linear prediction and gap interpolation: dense solves in small kernels."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.layout import packed, with_halo


def levinson(r: np.ndarray, order: int) -> np.ndarray:
    """Prediction polynomial (1, a1, ..., ap) from autocorrelations; what exists when a reflection leaves (-1, 1)."""
    a, error = np.zeros(order + 1), float(r[0])
    a[0] = 1.0
    for m in range(1, order + 1):
        if not error > 0:
            break
        k = -float(a[:m] @ r[m:0:-1]) / error
        if not abs(k) < 1:
            break
        a[: m + 1] = a[: m + 1] + k * a[m::-1][: m + 1]
        error *= 1 - k * k
    return a


def fit_ar(x: np.ndarray, order: int) -> np.ndarray:
    """Prediction polynomial of a stretch, with a little ridge."""
    r = np.array([x[: len(x) - k] @ x[k:] for k in range(order + 1)])
    r[0] = r[0] * 1.0001 + 1e-12
    return levinson(r, order)


def interpolate_gap(x: np.ndarray, start: int, end: int, a: np.ndarray) -> bool:
    """Fills x[start:end] with the values of least prediction error under ``a``; False, and unchanged, where the gap has
    less than the order on a side or the system is singular."""
    p = len(a) - 1
    if start < p or end + p > len(x) or end <= start:
        return False
    ra = np.array([a[: p + 1 - k] @ a[k:] for k in range(p + 1)])
    gap = np.arange(start, end)
    lag = np.abs(gap[:, None] - gap[None, :])
    matrix = np.where(lag <= p, ra[np.minimum(lag, p)], 0.0)
    known = np.concatenate([np.arange(start - p, start), np.arange(end, end + p)])
    lag = np.abs(gap[:, None] - known[None, :])
    right = np.where(lag <= p, ra[np.minimum(lag, p)], 0.0) @ x[known]
    try:
        values = np.linalg.solve(matrix, -right)
    except np.linalg.LinAlgError:
        return False
    if not np.isfinite(values).all():
        return False
    x[start:end] = values
    return True


def burst_runs(x: np.ndarray, start: int, end: int, order: int, threshold: float) -> list[tuple[int, int, float, float]]:
    """(start, end, residual peak in sigma, sample peak) of runs in x[start:end] that neither the samples before nor those
    after predict, by a model of the stretch and its context; sigma is robust, and stretches without residual have none."""
    a, b = max(order, start), min(len(x) - order, end)
    if b - a < 2 * order:
        return []
    model = fit_ar(x[max(0, start - order) : end + order], order)
    ahead = np.convolve(x[a - order : b], model)[order : order + b - a]
    back = np.convolve(x[a : b + order][::-1], model)[order : order + b - a][::-1]
    sigma = 1.4826 * np.median(np.abs(ahead))
    if sigma < 1e-7:
        return []
    hit = np.flatnonzero((np.abs(ahead) > threshold * sigma) & (np.abs(back) > threshold * sigma))
    runs = np.split(hit, np.flatnonzero(np.diff(hit) > 1) + 1) if len(hit) else []
    return [(a + int(r[0]), a + int(r[-1]) + 1, float(np.abs(ahead[r]).max() / sigma), float(np.abs(ahead[r]).max())) for r in runs]


def detected(samples: DataFrame, order: int, block: int, threshold: float, blocks: int = 256) -> DataFrame:
    """rec, b, start, end, sigma, peak: bursts of each block of ``block`` samples, found in chunks of ``blocks`` blocks."""
    def run(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("n", ignore_index=True)
        x, first = part["x"].to_numpy(dtype=np.float64), int(part["n"].iloc[0])
        own = part.loc[part["core"], "n"]
        rows = []
        for b in range(int(own.iloc[0]) // block, int(own.iloc[-1]) // block + 1) if len(own) else ():
            begin, end = b * block - first, min(b * block + block, int(own.iloc[-1]) + 1) - first
            rows += [(part["rec"].iloc[0], b, s + first, e + first, sigma, peak) for s, e, sigma, peak in burst_runs(x, begin, end, order, threshold)]
        return pd.DataFrame(rows, columns=["rec", "b", "start", "end", "sigma", "peak"])

    rows = with_halo(samples, 2 * order, 2 * order, block * blocks)
    return rows.groupBy("rec", "chunk").applyInPandas(run, "rec string, b bigint, start bigint, end bigint, sigma double, peak double")


def repaired(samples: DataFrame, bursts: DataFrame, order: int, context: int, chunk: int = 1 << 14) -> DataFrame:
    """Samples with bursts (rec, start, end) interpolated in order of place, each by a model of its surroundings.

    A burst is repaired by the chunk that it starts in, with ``context`` + 2 * ``order`` samples on both sides; bursts of one
    chunk see each other's repairs.
    """
    reach = context + 2 * order
    lists = bursts.withColumn("__c", F.explode(F.sequence(F.floor((F.col("start") - reach) / chunk), F.floor((F.col("end") + reach) / chunk)))).groupBy("rec", "__c").agg(
        F.sort_array(F.collect_list(F.struct("start", "end"))).alias("bursts")
    )
    # A chunk is one row when it meets its bursts, so these are not repeated for its samples.
    rows = packed(samples, reach, max(1, reach), chunk)
    joined = rows.join(lists.select(F.col("rec").alias("brec"), F.col("__c").alias("bchunk"), "bursts"), (F.col("rec") == F.col("brec")) & (F.col("chunk") == F.col("bchunk")), "left")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for rec, number, first, data, found in zip(frame["rec"], frame["chunk"], frame["first"], frame["x"], frame["bursts"], strict=True):
                x = np.frombuffer(data, dtype="<f8").copy()
                for b in found if found is not None else ():
                    s, e = int(b["start"]) - first, int(b["end"]) - first
                    if s < 0 or e > len(x):
                        continue
                    model = fit_ar(x[max(0, s - context) : min(len(x), e + context)].copy(), order)
                    if interpolate_gap(x, s, e, model):
                        interpolate_gap(x, s, e, fit_ar(x[max(0, s - context) : min(len(x), e + context)], order))
                n = np.arange(first, first + len(x))
                mine = n // chunk == number
                yield pd.DataFrame({"rec": rec, "n": n[mine], "x": x[mine]})

    return joined.select("rec", "chunk", "first", "x", "bursts").mapInPandas(run, "rec string, n bigint, x double")
