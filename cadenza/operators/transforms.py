"""Short-time transforms, denoising and dynamic equalisation over frames, convolution and resampling."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.layout import CHUNK, lengths, packed
from .recurrences import by_chunk
from .spectra import hann

FrameMap = Callable[[np.ndarray], np.ndarray]
#: Bytes of an impulse response up to which each executor may hold all of it.
SMALL_RESPONSE = 8 << 20


def check_size(n: int, primes: tuple[int, ...] = (2,)) -> None:
    """Raises for a transform size with other prime factors."""
    rest = n
    for p in primes:
        while rest > 1 and rest % p == 0:
            rest //= p
    if n < 1 or rest != 1:
        raise ValueError(f"{n} has prime factors beyond {primes}")


def vorbis_window(n: int) -> np.ndarray:
    return np.sin(np.pi / 2 * np.sin(np.pi * (np.arange(n) + 0.5) / n) ** 2)


def stft(x: np.ndarray, size: int, hop: int) -> np.ndarray:
    """Half spectra of frames under a root-Hann window; the signal is padded by a frame at either end."""
    check_size(size)
    if size % hop:
        raise ValueError("the hop must divide the frame")
    count = (len(x) + size) // hop + 1
    padded = np.zeros((count - 1) * hop + size)
    padded[size : size + len(x)] = x[: max(0, len(padded) - size)]
    frames = np.lib.stride_tricks.sliding_window_view(padded, size)[::hop]
    return np.fft.rfft(frames * np.sqrt(hann(size)), axis=1)


def istft(spectra: np.ndarray, size: int, hop: int, length: int) -> np.ndarray:
    """Overlap-add of inverse spectra over the summed squared window; 0 where no window reaches."""
    window = np.sqrt(hann(size))
    frames = np.fft.irfft(spectra, size, axis=1) * window
    total = (len(frames) - 1) * hop + size
    out, weight = np.zeros(max(total, size + length)), np.zeros(max(total, size + length))
    per = size // hop
    for k in range(per):  # frames k, k + per, ... do not overlap
        part = frames[k::per]
        if len(part):
            at = k * hop
            out[at : at + part.size] += part.reshape(-1)
            weight[at : at + part.size] += np.tile(window**2, len(part))
    good = weight > 1e-9
    out[good] /= weight[good]
    out[~good] = 0.0
    return out[size : size + length]


def through_frames(samples: DataFrame, change: FrameMap, size: int, hop: int, warm_frames: int, chunk: int = CHUNK) -> DataFrame:
    """Samples through the transform, ``change`` of the spectra, and back.

    Chunks start on a frame, with ``warm_frames`` frames and a frame's reach ahead of them.
    """
    before = (warm_frames * hop + 2 * size + hop - 1) // hop * hop
    chunk = -(-max(chunk, before) // hop) * hop
    return by_chunk(samples, lambda x: istft(change(stft(x, size, hop)), size, hop, len(x)), before, 2 * size, chunk)


def wiener_gains(power: np.ndarray, noise: np.ndarray, floor: float, smoothing: float = 0.98, over: float = 1.5, reach: int = 2) -> np.ndarray:
    """Decision-directed Wiener gains of frames (frames x bins): the prior leans on the last frame's cleaned power."""
    level = noise * over + 1e-20
    clean = np.zeros(power.shape[1])
    out = np.empty_like(power)
    bins = np.arange(power.shape[1])
    low, high = np.maximum(bins - reach, 0), np.minimum(bins + reach, len(bins) - 1) + 1
    for f, p in enumerate(power):
        prior = smoothing * clean / level + (1 - smoothing) * np.maximum(p / level - 1, 0)
        gain = np.maximum(floor, prior / (1 + prior))
        sums = np.concatenate([[0.0], np.cumsum(gain)])
        out[f] = (sums[high] - sums[low]) / (high - low)
        clean = out[f] ** 2 * p
    return out


def denoised(samples: DataFrame, noise: np.ndarray, reduction_db: float, size: int = 1024, hop: int = 256, warm_frames: int = 400) -> DataFrame:
    """Samples with noise of the given power by bin held down, by at most ``reduction_db``."""
    floor = 10 ** (-reduction_db / 20)

    def change(s: np.ndarray) -> np.ndarray:
        return s * wiener_gains(np.abs(s) ** 2, noise, floor)

    return through_frames(samples, change, size, hop, warm_frames)


def dynamic_eq_gains(power: np.ndarray, rate: float, size: int, hop: int, threshold: float = 12.0, ratio: float = 0.5, most: float = 8.0, attack_ms: float = 2.0, release_ms: float = 60.0, octaves: float = 0.5, least_width: float = 400.0) -> np.ndarray:
    """Gains that hold down bins standing over their surroundings, by frame, with attack and release."""
    return 10 ** (dynamic_eq_states(power, rate, size, hop, threshold, ratio, most, attack_ms, release_ms, octaves, least_width) / 20)


def dynamic_eq_states(power: np.ndarray, rate: float, size: int, hop: int, threshold: float = 12.0, ratio: float = 0.5, most: float = 8.0, attack_ms: float = 2.0, release_ms: float = 60.0, octaves: float = 0.5, least_width: float = 400.0) -> np.ndarray:
    """The same gains in dB."""
    hz = np.arange(power.shape[1]) * rate / size
    half = np.maximum(hz * (2 ** (octaves / 2) - 2 ** (-octaves / 2)), least_width) / 2
    low = np.maximum(1, np.floor((hz - half) * size / rate)).astype(int)
    high = np.minimum(len(hz) - 1, np.ceil((hz + half) * size / rate)).astype(int) + 1
    limit = np.where(hz < 300, np.inf, threshold - np.where((hz >= 5000) & (hz <= 9000), 3.0, 0.0))
    down, up = (math.exp(-hop / (ms / 1000 * rate)) for ms in (attack_ms, release_ms))
    state, out = np.zeros(len(hz)), np.empty_like(power)
    for f, p in enumerate(power):
        level = 10 * np.log10(p + 1e-30)
        sums = np.concatenate([[0.0], np.cumsum(level)])
        around = (sums[high] - sums[np.minimum(low, high - 1)]) / np.maximum(1, high - np.minimum(low, high - 1))
        excess = level - around - limit
        target = np.where(excess > 0, -np.minimum(most, ratio * np.maximum(excess, 0)), 0.0)
        state = target + (state - target) * np.where(target < state, down, up)
        out[f] = state
    return out


def dynamic_eq_warm(rate: float, hop: int) -> int:
    """Frames after which a bin's state no longer shows in double precision."""
    return math.ceil(math.log(2.0**-53) / (-hop / (0.06 * rate)))


def dynamic_eq(samples: DataFrame, rate: float, size: int = 1024, hop: int = 256) -> DataFrame:
    return through_frames(samples, lambda s: s * dynamic_eq_gains(np.abs(s) ** 2, rate, size, hop), size, hop, dynamic_eq_warm(rate, hop))


def convolve(x: np.ndarray, impulse: np.ndarray) -> np.ndarray:
    """Convolution cut to the input's length, by one transform of the next power of two."""
    n = 1 << (len(x) + len(impulse) - 2).bit_length() if len(x) else 1
    return np.fft.irfft(np.fft.rfft(x, n) * np.fft.rfft(impulse, n), n)[: len(x)]


def convolved(samples: DataFrame, impulse: np.ndarray, chunk: int = CHUNK) -> DataFrame:
    """Samples through an impulse response, cut to their length; one longer than a chunk is taken apart."""
    if len(impulse) > chunk:
        return convolved_in_parts(samples, impulse, chunk)
    return by_chunk(samples, lambda x: convolve(x, impulse), max(0, len(impulse) - 1), chunk=chunk)


def convolve_blocks(x: np.ndarray, h: np.ndarray, block: int) -> np.ndarray:
    """All of the convolution of two pieces, filled up to blocks: blocks are transformed once, and products of one place
    are added as spectra."""
    a, b = (np.fft.rfft(np.pad(v, (0, -len(v) % block)).reshape(-1, block), 2 * block, axis=1) for v in (x, h))
    sums = np.zeros((len(a) + len(b) - 1, block + 1), dtype=complex)
    for j, part in enumerate(b):
        sums[j : j + len(a)] += a * part
    y = np.fft.irfft(sums, 2 * block, axis=1)
    out = np.zeros((len(y) + 1, block))
    out[:-1] += y[:, :block]
    out[1:] += y[:, block:]
    return out.reshape(-1)


def convolved_in_parts(samples: DataFrame, impulse: np.ndarray, block: int = CHUNK, row: int = CHUNK) -> DataFrame:
    """The same for an impulse response of any length, by partitioned overlap-add.

    Samples and response are cut to blocks of ``block`` values, and as many of them as make ``row`` values are one row. Each
    row of samples meets each row of the response, which gives two rows of output; rows of one place are added. A task holds
    one pair of rows, and at most twice as many as the response has rows in one sum.
    """
    spark = samples.sparkSession
    size = block * max(1, row // block)
    parts = [(j, impulse[j * size : (j + 1) * size].astype("<f8").tobytes()) for j in range(max(1, -(-len(impulse) // size)))]
    held = packed(samples, 0, 1, size)
    if len(parts) > 1:
        last = lengths(samples).select(F.col("rec").alias("frec"), F.floor((F.col("length") - 1) / size).alias("final"))
        held = held.join(last, F.col("rec") == F.col("frec"))
    else:  # what follows the next row is out of reach
        held = held.withColumn("final", F.col("chunk") + F.when(F.col("last"), 0).otherwise(1))
    meets = held.select("rec", "chunk", "final", "x", F.explode(F.sequence(F.lit(0).cast("bigint"), F.least(F.lit(len(parts) - 1), F.col("final") - F.col("chunk")))).alias("j"))
    response = spark.createDataFrame(parts, "part bigint, h binary")
    if impulse.nbytes <= SMALL_RESPONSE:  # shuffled, the rows of few parts would all go to as few tasks
        response = F.broadcast(response)
    meets = meets.join(response, F.col("j") == F.col("part"))

    def multiply(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for rec, chunk, final, j, x, h in zip(frame["rec"], frame["chunk"], frame["final"], frame["j"], frame["x"], frame["h"], strict=True):
                own = np.frombuffer(x, dtype="<f8")[:size]
                y = convolve_blocks(own, np.frombuffer(h, dtype="<f8"), block)
                halves = [(p, y[k * size : (k + 1) * size].tobytes()) for k, p in enumerate((chunk + j, chunk + j + 1)) if p <= final]
                # The first product at a place tells how many samples are there.
                yield pd.DataFrame({"rec": rec, "at": [p for p, _ in halves], "own": [len(own) if p == chunk else 0 for p, _ in halves], "y": [half for _, half in halves]})

    def add(part: pd.DataFrame) -> pd.DataFrame:
        total = np.zeros(int(part["own"].max()))
        for y in part["y"]:
            y = np.frombuffer(y, dtype="<f8")[: len(total)]
            total[: len(y)] += y
        return pd.DataFrame({"rec": part["rec"].iloc[0], "n": int(part["at"].iloc[0]) * size + np.arange(len(total)), "x": total})

    products = meets.select("rec", "chunk", "final", "j", "x", "h").mapInPandas(multiply, "rec string, at bigint, own bigint, y binary")
    return products.groupBy("rec", "at").applyInPandas(add, "rec string, n bigint, x double")


def resample(x: np.ndarray, source: float, target: float, first: int = 0, at: np.ndarray | None = None, zeros: int = 32, rolloff: float = 0.95, beta: float = 12.0) -> np.ndarray:
    """Values at output places ``at`` (all by default) of a signal whose first sample has place ``first``, by a Kaiser-windowed
    sinc whose weights are made to sum to one."""
    ratio = target / source
    if at is None:
        at = np.arange(int(math.floor(len(x) * ratio + 0.5)))
    cutoff = 0.5 * rolloff * min(1.0, ratio)
    half = zeros / (2 * cutoff)
    center = at / ratio
    taps = np.floor(center).astype(np.int64)[:, None] + np.arange(-math.ceil(half), math.ceil(half) + 1)[None, :]
    t = center[:, None] - taps
    inside = np.abs(t) <= half
    weight = np.where(inside, np.sinc(2 * cutoff * t) * np.i0(beta * np.sqrt(np.maximum(0, 1 - (t / half) ** 2))), 0.0)
    place = taps - first
    value = np.where((place >= 0) & (place < len(x)), x[np.clip(place, 0, len(x) - 1)], 0.0) if len(x) else 0.0 * t
    return (weight * value).sum(axis=1) / weight.sum(axis=1)


def resampled(samples: DataFrame, source: float, target: float, chunk: int = 1 << 14) -> DataFrame:
    """rec, n, x at another rate; the same DataFrame where the rates are equal. Each chunk of input gives the outputs whose
    centres fall in it."""
    if source == target:
        return samples
    import pandas as pd
    from pyspark.sql import functions as F

    from ..sources.layout import with_halo

    ratio = target / source
    reach = math.ceil(32 / (0.95 * min(1.0, ratio))) + 2
    lengths = samples.groupBy("rec").agg((F.max("n") + 1).alias("length"))

    def run(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("n", ignore_index=True)
        size = int(math.floor(part["length"].iloc[0] * ratio + 0.5))
        own = part.loc[part["core"], "n"]
        if own.empty:
            return pd.DataFrame({"rec": [], "n": [], "x": []})
        at = np.arange(math.ceil(own.iloc[0] * ratio), math.ceil((own.iloc[-1] + 1) * ratio))
        at = at[at < size]
        return pd.DataFrame({"rec": part["rec"].iloc[0], "n": at, "x": resample(part["x"].to_numpy(dtype=np.float64), source, target, int(part["n"].iloc[0]), at)})

    rows = with_halo(samples.join(lengths, "rec"), reach, reach, chunk)
    return rows.groupBy("rec", "chunk").applyInPandas(run, "rec string, n bigint, x double")
