"""Power spectra of frames, band energies, smoothing over frequency, and noise statistics.

Frames are arrays. A transform is a numpy kernel over Arrow batches; what follows is relational over cells (frame, bin).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def hann(n: int) -> np.ndarray:
    """Periodic Hann window."""
    return 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(n) / n)


def power_spectra(frames: DataFrame, key: str, column: str, size: int) -> DataFrame:
    """``key``, power: windowed power of bins 0..size / 2, over the window's energy. Frames of other sizes give no row."""
    window = hann(size)
    energy = float((window**2).sum())
    schema = pa.schema([(key, pa.int64()), ("power", pa.list_(pa.float64()))])

    def transform(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, rows = batch.column(0), batch.column(1)
            good = pc.equal(pc.list_value_length(rows), size)
            x = rows.filter(good).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, size)
            power = np.abs(np.fft.rfft(x * window, axis=1)) ** 2 / energy
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(power) + 1, dtype=np.int32) * power.shape[1]), pa.array(power.reshape(-1)))
            yield pa.RecordBatch.from_arrays([ids.filter(good).cast(pa.int64()), lists], schema=schema)

    return frames.select(F.col(key).cast("bigint"), column).mapInArrow(transform, f"{key} bigint, power array<double>")


def cells(spectra: DataFrame, key: str) -> DataFrame:
    """``key``, k, p of every bin."""
    return spectra.select(key, F.posexplode("power").alias("k", "p"))


def band_energy(spectra: DataFrame, key: str, low: int, high: int) -> DataFrame:
    """``key``, db: mean power of bins low..high in dB, over a floor of 1e-30."""
    band = F.slice("power", low + 1, high - low + 1)
    total = F.aggregate(band, F.lit(0.0), lambda a, x: a + x)
    return spectra.select(key, (10.0 * F.log10(total / F.size(band) + 1e-30)).alias("db"))


def smooth_bins(spectra: DataFrame, key: str, reach: int) -> DataFrame:
    """``key``, k, p: mean of each bin and the ``reach`` bins to either side, fewer at the edges."""
    part = F.slice("power", F.greatest(F.lit(1), F.col("k") + 1 - reach), F.least(F.size("power"), F.col("k") + 1 + reach) - F.greatest(F.lit(1), F.col("k") + 1 - reach) + 1)
    rows = spectra.select(key, "power", F.posexplode("power").alias("k", "own"))
    return rows.select(key, "k", (F.aggregate(part, F.lit(0.0), lambda a, x: a + x) / F.size(part)).alias("p"))


def quietest(spectra: DataFrame, key: str, share: float) -> DataFrame:
    """k, p: mean of the quietest max(1, floor(share * frames)) frames of each bin.

    A bin's threshold is found in two steps: counts of powers by octave, then ranks inside the octave that the threshold
    falls in. So no task sorts a bin's frames.
    """
    rows = cells(spectra, key).withColumn("octave", F.floor(F.log2(F.greatest("p", F.lit(1e-300)))))
    counts = rows.groupBy("k", "octave").agg(F.count(F.lit(1)).alias("c"), F.sum("p").alias("s"))
    order = Window.partitionBy("k").orderBy("octave")
    upto = order.rowsBetween(Window.unboundedPreceding, 0)
    run = counts.select("k", "octave", "c", "s", F.sum("c").over(upto).alias("cc"), F.sum("s").over(upto).alias("ss"), F.sum("c").over(Window.partitionBy("k")).alias("n"))
    run = run.withColumn("take", F.greatest(F.lit(1), F.floor(F.col("n") * share)))
    edge = run.where((F.col("cc") >= F.col("take")) & (F.col("cc") - F.col("c") < F.col("take")))
    edge = edge.select(F.col("k").alias("ek"), F.col("octave").alias("eo"), "take", (F.col("take") - (F.col("cc") - F.col("c"))).alias("left"), (F.col("ss") - F.col("s")).alias("base"))
    inside = rows.join(edge, (F.col("k") == F.col("ek")) & (F.col("octave") == F.col("eo")))
    ranked = inside.withColumn("rank", F.row_number().over(Window.partitionBy("k").orderBy("p"))).where(F.col("rank") <= F.col("left"))
    return ranked.groupBy("k", "take", "base").agg(F.sum("p").alias("s")).select("k", ((F.col("base") + F.col("s")) / F.col("take")).alias("p"))


def mean_spectrum(spectra: DataFrame, key: str) -> DataFrame:
    """k, p: Welch mean over frames."""
    return cells(spectra, key).groupBy("k").agg(F.avg("p").alias("p"))


def log_grid(spectrum: DataFrame, rate: float, size: int, low: float, per_octave: int, points: int, width: float) -> DataFrame:
    """i, freq, db: a spectrum (k, p) on a grid of ``per_octave`` points from ``low`` Hz, each the mean power over
    ``width`` octaves; the one nearest bin where no bin is inside. A grid has few points and a spectrum few bins."""
    grid = spectrum.sparkSession.range(points).select(F.col("id").alias("i"), (low * F.pow(F.lit(2.0), F.col("id") / per_octave)).alias("freq"))
    hz = rate / size
    lo = F.floor(F.col("freq") * 2.0 ** (-width / 2) / hz + 0.5)
    hi = F.greatest(lo, F.floor(F.col("freq") * 2.0 ** (width / 2) / hz + 0.5))
    wanted = grid.select("i", "freq", F.explode(F.sequence(lo, hi)).alias("bin"))
    met = wanted.join(spectrum, F.col("bin") == F.col("k"))
    return met.groupBy("i", "freq").agg((10.0 * F.log10(F.avg("p") + 1e-30)).alias("db"))


def broad_target(curve: DataFrame, octaves: float) -> DataFrame:
    """i, target: mean power of the grid points within ``octaves`` / 2 of each, in dB. A grid is at most some hundred rows."""
    other = curve.select(F.col("freq").alias("f2"), F.pow(F.lit(10.0), F.col("db") / 10.0).alias("p2"))
    near = curve.join(other, F.abs(F.log2(F.col("f2") / F.col("freq"))) <= octaves / 2 + 1e-9)
    return near.groupBy("i").agg((10.0 * F.log10(F.avg("p2"))).alias("target"))


def smooth_widths(spectra: DataFrame, key: str, low: list[int], high: list[int]) -> DataFrame:
    """``key``, k, db: mean level in dB of bins low[k]..high[k] of each frame, whose widths differ from bin to bin."""
    level = F.transform("power", lambda p: 10.0 * F.log10(p + 1e-30))
    bounds = F.array(*[F.struct(F.lit(a).alias("lo"), F.lit(b).alias("hi")) for a, b in zip(low, high, strict=True)])
    rows = spectra.select(key, level.alias("level"), F.posexplode(bounds).alias("k", "b"))
    part = F.slice("level", F.col("b.lo") + 1, F.col("b.hi") - F.col("b.lo") + 1)
    return rows.select(key, "k", (F.aggregate(part, F.lit(0.0), lambda a, x: a + x) / F.size(part)).alias("db"))


def octave_bounds(bins: int, hz: float, octaves: float, least: float) -> tuple[list[int], list[int]]:
    """First and last bin within ``octaves`` / 2 of each bin, and at least ``least`` Hz wide; never bin 0 alone as a start."""
    f = np.arange(bins) * hz
    half = np.maximum(f * (2 ** (octaves / 2) - 2 ** (-octaves / 2)), least) / 2
    low = np.minimum(np.maximum(1, np.floor((f - half) / hz)), bins - 1).astype(int)
    high = np.maximum(low, np.minimum(bins - 1, np.ceil((f + half) / hz))).astype(int)
    return low.tolist(), high.tolist()
