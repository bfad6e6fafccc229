"""The metrics of a processed recording, as rows (rec, metric, value), and those that its report tells.

Names are the fixed ones that stored runs are compared by. A metric whose inputs are not given, or that is not finite, has no
row. Every metric is a sum, a rank or a greatest value over the samples, so inputs are best kept as tables.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.num import db, lufs
from ..operators import longterm, loudness, metrics, peaks, recurrences
from ..operators.spectra import hann
from .stages import quiet_ranges, times

METRICS = "rec string, metric string, value double"
_CHUNK = 1 << 12


@dataclass(frozen=True)
class Scale:
    """What is measured in samples: loudness blocks and their hop, the pad at a segment's ends and the least that is left, the
    noise window before a segment and its distance, a click's width and what masks it; and the weighting of loudness."""

    block: int
    hop: int
    pad: int
    least: int
    noise: int
    guard: int
    click: int
    mask: int
    weigh: Callable[[DataFrame], DataFrame]

    @staticmethod
    def of(rate: float) -> Scale:
        hop = times(0.1, rate)
        lengths = (4 * hop, hop, times(0.3, rate), times(0.5, rate), times(0.15, rate), times(0.05, rate), 3, times(0.01, rate))
        return Scale(*lengths, lambda samples: recurrences.k_weighted(samples, rate))


def segment_levels(weighted: DataFrame, segments: DataFrame, scale: Scale) -> DataFrame:
    """rec, i, lufs: gated loudness of the segments (rec, i, start, end) without ``pad`` at each end.

    Blocks start with their segment. Segments of which less than ``least`` is left, or that are silent, give no row; segments
    are cut to pieces of a chunk, which samples meet by an equal join, so a long segment is no task of its own.
    """
    inner = segments.select("rec", "i", (F.col("start") + scale.pad).alias("lo"), (F.col("end") - scale.pad).alias("hi")).where(F.col("hi") - F.col("lo") >= scale.least)
    pieces = inner.withColumn("c", F.explode(F.sequence(F.floor(F.col("lo") / _CHUNK), F.floor((F.col("hi") - 1) / _CHUNK))))
    met = weighted.withColumn("c", F.floor(F.col("n") / _CHUNK)).join(pieces, ["rec", "c"]).where("n >= lo AND n < hi")
    own = met.select(F.struct("rec", "i").alias("rec"), (F.col("n") - F.col("lo")).alias("n"), "x")
    return loudness.integrated(own, scale.block, scale.hop).select("rec.rec", "rec.i", "lufs")


def segment_error(weighted: DataFrame, segments: DataFrame, target: float, scale: Scale) -> DataFrame:
    """rec, value: the greatest distance of a segment's loudness from ``target``; 0 where no segment can be measured."""
    worst = segment_levels(weighted, segments, scale).groupBy("rec").agg(F.max(F.abs(F.col("lufs") - target)).alias("worst"))
    return segments.select("rec").distinct().join(worst, "rec", "left").select("rec", F.coalesce("worst", F.lit(0.0)).alias("value"))


def segment_snr(weighted: DataFrame, segments: DataFrame, scale: Scale) -> DataFrame:
    """rec, value: median over segments of their gated loudness over the level of the last ``noise`` samples of the pause
    before, but for ``guard``. Pauses shorter than that count for nothing."""
    order = Window.partitionBy("rec").orderBy("i")
    pauses = segments.select("rec", "i", F.coalesce(F.lag("end").over(order), F.lit(0)).alias("from"), (F.col("start") - scale.guard).alias("end"))
    windows = pauses.where(F.col("end") - F.col("from") >= scale.noise).select("rec", "i", (F.col("end") - scale.noise).alias("start"), "end")
    noise = loudness.range_loudness(weighted, windows).select("rec", "i", lufs(F.col("z")).alias("noise"))
    both = segment_levels(weighted, segments, scale).join(noise, ["rec", "i"])
    return both.groupBy("rec").agg(F.median(F.col("lufs") - F.col("noise")).alias("value"))


def spectral_deviation(samples: DataFrame, segments: DataFrame, rate: float, low: float = 80.0, high: float = 12_000.0) -> DataFrame:
    """rec, value: the greatest distance in dB of the segments' mean spectrum from its broad shape."""
    size = min(8192, 1 << int(np.floor(np.log2(rate * 0.17))))
    spectrum = longterm.range_spectrum(samples, segments.select("rec", "start", "end"), hann(size), size // 2)
    curve = longterm.with_target(longterm.log_curves(spectrum, rate, size)).where(F.col("freq").between(low, high))
    return curve.groupBy("rec").agg(F.max(F.abs(F.col("db") - F.col("target"))).alias("value"))


def _scored(reference: DataFrame, estimate: DataFrame) -> DataFrame:
    pairs = reference.select("rec", "n", F.col("x").alias("r")).join(estimate.select("rec", "n", "x"), ["rec", "n"])
    return metrics.si_sdr(pairs, ["rec"], "r", "x").select("rec", F.col("si_sdr").alias("value"))


def _difference(after: DataFrame, before: DataFrame) -> DataFrame:
    return after.join(before.withColumnRenamed("value", "was"), "rec").select("rec", (F.col("value") - F.col("was")).alias("value"))


def bundle(
    before: DataFrame, after: DataFrame, scale: Scale, rate: float | None = None, segments: DataFrame | None = None, clicks: DataFrame | None = None,
    references: tuple[DataFrame, DataFrame] | None = None, target: float | None = None, only: set[str] | None = None,
) -> DataFrame:
    """rec, metric, value of recordings before and after a chain.

    ``segments`` (rec, i, start, end) are the known stretches of speech, ``clicks`` (rec, site) the known clicks, ``references``
    the clean signal as it was and as the chain renders it, ``target`` the loudness asked for. What is told in seconds or Hz
    needs ``rate``. ``only`` names the metrics to take; what they do not need is not computed.
    """
    sides = {"input": before, "output": after}
    heard = {side: scale.weigh(samples) for side, samples in sides.items()}
    level = {side: loudness.integrated(w, scale.block, scale.hop).select("rec", F.col("lufs").alias("value")) for side, w in heard.items()}
    told: dict[str, Callable[[], DataFrame]] = {}

    def pair(name: str, value: Callable[[str], DataFrame], change: str | None = None, falls: bool = False) -> None:
        """A metric of both sides, and how it changed."""
        for side in sides:
            told[side + name] = lambda side=side: value(side)
        if change:
            told[change] = lambda: _difference(value("input"), value("output")) if falls else _difference(value("output"), value("input"))

    pair("Lufs", level.__getitem__)
    pair("PeakDbfs", lambda side: sides[side].groupBy("rec").agg(db(F.max(F.abs("x"))).alias("value")))
    pair("TruePeakDbfs", lambda side: peaks.true_peak(sides[side]).withColumnRenamed("peak_db", "value"))
    told["changeDb"] = lambda: metrics.change_db(before, after).withColumnRenamed("change_db", "value")
    if rate is not None:
        floor = lambda side: quiet_ranges(sides[side], rate)[1].select("rec", F.col("floor").alias("value"))
        pair("FloorLufs", floor)
        pair("SnrDb", lambda side: _difference(level[side], floor(side)), "snrGainDb")
        decay = lambda side: metrics.decay(sides[side], times(0.005, rate), 20.0, 25.0, 200).select("rec", (F.col("frames") * 5.0).alias("value"))
        pair("DecayMs", decay)
        every = lambda: before.select("rec").distinct()
        told["decayShorteningMs"] = lambda: every().join(_difference(decay("input"), decay("output")), "rec", "left").select("rec", F.coalesce("value", F.lit(0.0)).alias("value"))
    if segments is not None:
        pair("SegmentSnrDb", lambda side: segment_snr(heard[side], segments, scale), "segmentSnrGainDb")
        if rate is not None:
            pair("SpectralDeviationDb", lambda side: spectral_deviation(sides[side], segments, rate), "spectralFlatteningDb", falls=True)
    if target is not None:
        told["lufsError"] = lambda: level["output"].select("rec", F.abs(F.col("value") - target).alias("value"))
        if segments is not None:
            told["segmentLufsError"] = lambda: segment_error(heard["output"], segments, target, scale)
    if references is not None:
        clean = dict(zip(sides, references, strict=True))
        pair("SiSdrDb", lambda side: _scored(clean[side], sides[side]), "siSdrGainDb")
        if clicks is not None:
            residual = lambda side: metrics.residual_at(clean[side], sides[side], clicks, scale.click, scale.mask)
            pair("ClickResidualDb", lambda side: residual(side).groupBy("rec").agg(F.max("ratio_db").alias("value")))
    unknown = (only or set()) - set(told)
    if unknown:
        raise ValueError(f"no metric {', '.join(sorted(unknown))} from these inputs; there are {', '.join(told)}")
    rows = [make().select("rec", F.lit(name).alias("metric"), F.col("value").cast("double")) for name, make in told.items() if only is None or name in only]
    return reduce(DataFrame.unionByName, rows).where((F.abs("value") < math.inf) & ~F.isnan("value"))


def report_documents(report: DataFrame) -> DataFrame:
    """rec, report: the rows of a chain's report (stage, rec, key, value) as one VARIANT a recording: stage, then key."""
    pairs = report.where("value IS NOT NULL").groupBy("rec", "stage").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("key", "value")))).alias("facts"))
    return pairs.groupBy("rec").agg(F.parse_json(F.to_json(F.map_from_entries(F.array_sort(F.collect_list(F.struct("stage", "facts")), _by_stage)))).alias("report"))


def _by_stage(a: Column, b: Column) -> Column:
    return F.when(a["stage"] < b["stage"], -1).when(a["stage"] > b["stage"], 1).otherwise(0)


#: Metrics of a report: paths into it; of two paths, the first's value less the second's.
FROM_REPORT = {
    "resampled": ("$.chain.resampled",),
    "programmeLossDb": ("$.denoise.loss",),
    "loudnessRangeReductionLu": ("$.compress.lra", "$.compress.lra_after"),
    "loudnessRangeAfterLu": ("$.compress.lra_after",),
    "compressorMaxReductionDb": ("$.compress.max_reduction_db",),
    "floorReductionDb": ("$.expand.floor_reduction_db",),
}


def from_reports(documents: DataFrame) -> DataFrame:
    """rec, metric, value of reports (rec, report); a metric whose paths are not all there has no row."""
    at = lambda path: F.try_variant_get("report", path, "double")
    pairs = [F.struct(F.lit(name).alias("metric"), (at(p[0]) if len(p) == 1 else at(p[0]) - at(p[1])).alias("value")) for name, p in FROM_REPORT.items()]
    return documents.select("rec", F.inline(F.array(*pairs))).where("value IS NOT NULL AND NOT isnan(value)")
