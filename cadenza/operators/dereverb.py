"""Late reverberation predicted away by weighted prediction error, over recordings of any length.

In each bin of a short-time transform a frame is predicted from the frames ``delay`` and more before it; what is predicted is
taken off. The prediction solves normal equations, and these are sums over frames. So each chunk of a recording, with
the frames before it that its own need, gives its share of the sums; Spark adds the shares; a small solve gives the filters,
which are joined back to the chunks. A round of this is taken for each iteration, as the weights come from the output of the
filters before. No task sees a whole recording, and chunks of another size give the same filters.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.layout import CHUNK, PACK_SCHEMA, packed, with_halo
from .spectra import hann

#: Bins whose sums travel in one row, and tasks whose sums are added in one group.
BINS, TASKS = 64, 32

#: (spectra of frames first, first + 1, ...; first; the frames of these that are the row's own: from, to) of a row.
Frames = Callable[[pd.Series], tuple[np.ndarray, int, int, int]]


def _past(y: np.ndarray, at: np.ndarray, taps: int, delay: int) -> np.ndarray:
    """(bins, frames, taps): what each frame of ``at`` is predicted from."""
    return y[at[:, None] - delay - np.arange(taps)[None, :]].transpose(2, 0, 1)


def _without(y: np.ndarray, first: int, at: np.ndarray, filters: np.ndarray | None, taps: int, delay: int) -> np.ndarray:
    """The frames ``at`` of ``y`` less what ``filters`` (bins, taps) predict; frames without enough before them stay."""
    out = y[at].copy()
    if filters is not None:
        full = np.flatnonzero(at + first >= delay + taps)
        for b in range(0, y.shape[1], BINS):
            past = _past(y[:, b : b + BINS], at[full], taps, delay)
            out[full, b : b + BINS] -= np.einsum("btk,bk->tb", past, np.nan_to_num(filters[b : b + BINS]).conj())
    return out


def shares(y: np.ndarray, first: int, start: int, stop: int, mean: np.ndarray | None, filters: np.ndarray | None, taps: int, delay: int) -> np.ndarray:
    """(bins, taps * taps + taps + 1): a chunk's part of the matrix, the right side and the power of its own frames; of the power
    alone where ``mean`` is None."""
    at = np.arange(start - first, stop - first)
    out = np.zeros((y.shape[1], taps * taps + taps + 1), dtype=np.complex128)
    if mean is None:
        out[:, -1] = (np.abs(y[at]) ** 2).sum(axis=0)
        return out
    power = np.abs(_without(y, first, at, filters, taps, delay)) ** 2
    full = at + first >= delay + taps
    at, weight = at[full], 1.0 / np.maximum(power[full], np.maximum(1e-3 * np.nan_to_num(mean), 1e-300))
    for b in range(0, y.shape[1], BINS):
        past = _past(y[:, b : b + BINS], at, taps, delay)
        weighted = (past * weight.T[b : b + BINS, :, None]).transpose(0, 2, 1)
        out[b : b + BINS, : taps * taps] = (weighted @ past.conj()).reshape(-1, taps * taps)
        out[b : b + BINS, taps * taps : -1] = (weighted @ y[at, b : b + BINS].T.conj()[:, :, None])[:, :, 0]
    return out


def solved(sums: np.ndarray, mean: np.ndarray, frames: int, taps: int, delay: int, regularisation: float) -> tuple[np.ndarray, np.ndarray]:
    """(mean power, filters) of bins; both are nan where a bin is to stay as it is: with too few frames, without power, or
    where there is no solution. The matrix is loaded with a share of the mean power of all frames."""
    filters = np.full((len(sums), taps), np.nan, dtype=np.complex128)
    mean = np.where((mean > 0) & (frames > taps + delay + 2), mean, np.nan)
    for b in np.flatnonzero(~np.isnan(mean)):
        matrix = sums[b, : taps * taps].reshape(taps, taps) + np.eye(taps) * mean[b] * regularisation * frames
        try:
            filters[b] = np.linalg.solve(matrix, sums[b, taps * taps : -1])
        except np.linalg.LinAlgError:
            pass
    lost = ~np.isfinite(filters).all(axis=1)
    mean[lost], filters[lost] = np.nan, np.nan
    return mean, filters


def predicted_away(y: np.ndarray, taps: int = 20, delay: int = 3, iterations: int = 3, regularisation: float = 1e-4) -> np.ndarray:
    """The same for the spectra (frames, bins) of a whole recording at once."""
    n = len(y)
    mean, filters = shares(y, 0, 0, n, None, None, taps, delay)[:, -1].real / max(1, n), None
    for _ in range(iterations):
        mean, filters = solved(shares(y, 0, 0, n, mean, filters, taps, delay), mean, n, taps, delay, regularisation)
    return _without(y, 0, np.arange(n), filters, taps, delay)


_SUMS = "rec string, b int, task bigint, frames bigint, mean binary, sums binary"
_FILTERS = "rec string, b int, mean binary, filters binary"


def _fitted(packs: DataFrame, frames_of: Frames, taps: int, delay: int, iterations: int, regularisation: float) -> DataFrame:
    """rec, fit (an array of b, mean, filters by group of bins) of the recordings of ``packs``."""
    width = taps * taps + taps + 1

    def give(rec: str, task: int, held: list, mean: np.ndarray | None) -> pd.DataFrame:
        sums, frames = held
        rows = [(rec, b // BINS, task, frames, None if mean is None else mean[b : b + BINS].tobytes(), sums[b : b + BINS].tobytes()) for b in range(0, len(sums), BINS)]
        return pd.DataFrame(rows, columns=["rec", "b", "task", "frames", "mean", "sums"])

    def gather(rows: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rec, held, mean, task = None, None, None, 0
        for frame in rows:
            for _, row in frame.iterrows():
                if held is not None and row["rec"] != rec:
                    yield give(rec, task, held, mean)
                    held = None
                y, first, start, stop = frames_of(row)
                mean, filters = _unpacked(row.get("fit"), taps)
                got = shares(y, first, start, stop, mean, filters, taps, delay)
                held = [got, stop - start] if held is None else [held[0] + got, held[1] + stop - start]
                rec, task = row["rec"], int(row["task"])
        if held is not None:
            yield give(rec, task, held, mean)

    def added(part: pd.DataFrame) -> pd.DataFrame:
        total = sum(np.frombuffer(s, dtype=np.complex128) for s in part["sums"])
        first = part.iloc[0]
        return pd.DataFrame({"rec": [first["rec"]], "b": [first["b"]], "task": [int(first["task"]) // TASKS], "frames": [int(part["frames"].sum())], "mean": [first["mean"]], "sums": [total.tobytes()]})

    def solve(part: pd.DataFrame) -> pd.DataFrame:
        row = added(part).iloc[0]
        sums, frames = np.frombuffer(row["sums"], dtype=np.complex128).reshape(-1, width), int(row["frames"])
        if row["mean"] is None:
            mean, filters = sums[:, -1].real / max(1, frames), None
        else:
            mean, filters = solved(sums, np.frombuffer(row["mean"], dtype=np.float64), frames, taps, delay, regularisation)
        return pd.DataFrame({"rec": [row["rec"]], "b": [row["b"]], "mean": [mean.tobytes()], "filters": [None if filters is None else filters.tobytes()]})

    fit = None
    for _ in range(iterations + 1):
        rows = packs if fit is None else packs.join(fit, F.col("rec") == F.col("frec"))
        parts = rows.withColumn("task", F.spark_partition_id().cast("bigint")).mapInPandas(gather, _SUMS)
        parts = parts.groupBy("rec", "b", F.floor(F.col("task") / TASKS)).applyInPandas(added, _SUMS)
        blocks = parts.groupBy("rec", "b").applyInPandas(solve, _FILTERS)
        fit = blocks.groupBy(F.col("rec").alias("frec")).agg(F.sort_array(F.collect_list(F.struct("b", "mean", "filters"))).alias("fit"))  # a row for each group of bins
    return fit


def _unpacked(fit, taps: int) -> tuple[np.ndarray | None, np.ndarray | None]:
    if fit is None or isinstance(fit, float):
        return None, None
    mean = np.concatenate([np.frombuffer(x["mean"], dtype=np.float64) for x in fit])
    if fit[0]["filters"] is None:
        return mean, None
    return mean, np.concatenate([np.frombuffer(x["filters"], dtype=np.complex128) for x in fit]).reshape(-1, taps)


def dereverberated(
    samples: DataFrame, size: int = 4096, hop: int = 1024, taps: int = 20, delay: int = 3, iterations: int = 3, regularisation: float = 1e-4, chunk: int = 4 * CHUNK
) -> DataFrame:
    """rec, n, x: samples through frames of ``size``, one every ``hop``, whose late reverberation is predicted away.

    Recordings too short for a prediction, and silent bins, come back as the transform gives them.
    """
    if size % hop:
        raise ValueError("the hop must divide the frame")
    before = (delay + taps) * hop + size
    chunk = -(-max(chunk, before) // hop) * hop
    window = np.sqrt(hann(size))
    packs = packed(samples, before, size, chunk)

    def spectra(row: pd.Series, first: int, stop: int) -> np.ndarray:
        x, begin = np.frombuffer(row["x"], dtype="<f8"), int(row["first"])
        held = np.zeros((stop - 1 - first) * hop + size)
        at = begin - (first * hop - size)
        a, b = max(0, at), min(len(held), at + len(x))
        held[a:b] = x[a - at : b - at]
        return np.fft.rfft(np.lib.stride_tricks.sliding_window_view(held, size)[::hop] * window, axis=1)

    def reach(row: pd.Series) -> tuple[int, int, int]:
        """(first frame that the own ones are predicted from, first own frame, the one after the last own frame)."""
        start = int(row["chunk"]) * chunk // hop
        end = int(row["first"]) + len(row["x"]) // 8
        stop = (end + size) // hop + 1 if row["last"] else start + chunk // hop
        return max(0, start - delay - taps), start, stop

    def frames_of(row: pd.Series) -> tuple[np.ndarray, int, int, int]:
        first, start, stop = reach(row)
        return spectra(row, first, stop), first, start, stop

    fit = _fitted(packs, frames_of, taps, delay, iterations, regularisation)

    def change(rows: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in rows:
            for _, row in frame.iterrows():
                first, start, stop = reach(row)
                own, end = int(row["chunk"]) * chunk, int(row["first"]) + len(row["x"]) // 8
                stop = stop if row["last"] else stop + size // hop  # frames that reach back into the chunk
                y = spectra(row, first, stop)
                out = np.fft.irfft(_without(y, first, np.arange(start - first, stop - first), _unpacked(row["fit"], taps)[1], taps, delay), size, axis=1) * window
                total, weight = np.zeros((stop - 1 - start) * hop + size), np.zeros((stop - 1 - start) * hop + size)
                for i, piece in enumerate(out):
                    total[i * hop : i * hop + size] += piece
                    weight[i * hop : i * hop + size] += window**2
                total = np.where(weight > 1e-9, total / np.maximum(weight, 1e-9), 0.0)[own - (start * hop - size) :][: min(chunk, end - own)]
                yield pd.DataFrame({"rec": row["rec"], "n": np.arange(own, own + len(total)), "x": total})

    return packs.join(fit, F.col("rec") == F.col("frec")).mapInPandas(change, "rec string, n bigint, x double")


def dereverberated_cells(cells: DataFrame, bins: int, taps: int = 20, delay: int = 3, iterations: int = 3, regularisation: float = 1e-4, chunk: int = 1 << 10) -> DataFrame:
    """rec, k, f, re, im of cells (rec, k, f, re, im) of frames f = 0, 1, ... with ``bins`` bins each; missing cells are 0."""
    chunk = max(chunk, delay + taps)

    def pack(part: pd.DataFrame) -> pd.DataFrame:
        if not part["core"].any():
            return pd.DataFrame(columns=["rec", "chunk", "first", "last", "x"])
        first, number = int(part["n"].min()), int(part["chunk"].iloc[0])
        top = int(part.loc[part["core"], "n"].max())
        grid = np.zeros((top + 1 - first, bins), dtype=np.complex128)
        grid[part["n"].to_numpy() - first, part["k"].to_numpy()] = part["re"].to_numpy() + 1j * part["im"].to_numpy()
        return pd.DataFrame({"rec": [part["rec"].iloc[0]], "chunk": [number], "first": [first], "last": [False], "x": [grid.tobytes()]})

    def frames_of(row: pd.Series) -> tuple[np.ndarray, int, int, int]:
        y = np.frombuffer(row["x"], dtype=np.complex128).reshape(-1, bins)
        return y, int(row["first"]), int(row["chunk"]) * chunk, int(row["first"]) + len(y)

    rows = with_halo(cells.select("rec", "k", F.col("f").alias("n"), "re", "im"), delay + taps, 0, chunk)
    packs = rows.groupBy("rec", "chunk").applyInPandas(pack, PACK_SCHEMA)
    fit = _fitted(packs, frames_of, taps, delay, iterations, regularisation)

    def change(rows: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in rows:
            for _, row in frame.iterrows():
                y, first, start, stop = frames_of(row)
                out = _without(y, first, np.arange(start - first, stop - first), _unpacked(row["fit"], taps)[1], taps, delay).reshape(-1)
                f, k = np.divmod(np.arange(len(out)), bins)
                yield pd.DataFrame({"rec": row["rec"], "k": k.astype(np.int32), "f": f + start, "re": out.real, "im": out.imag})

    return packs.join(fit, F.col("rec") == F.col("frec")).mapInPandas(change, "rec string, k int, f bigint, re double, im double")
