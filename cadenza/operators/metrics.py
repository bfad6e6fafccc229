"""Metrics that compare two signals, and decay."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def change_db(before: DataFrame, after: DataFrame) -> DataFrame:
    """rec, change_db: power of the difference over that of ``before``, in dB; null where nothing changed."""
    pairs = before.select("rec", "n", "x").join(after.select("rec", "n", F.col("x").alias("y")), ["rec", "n"])
    sums = pairs.groupBy("rec").agg(F.sum((F.col("y") - F.col("x")) * (F.col("y") - F.col("x"))).alias("d"), F.sum(F.col("x") * F.col("x")).alias("e"))
    return sums.select("rec", F.when((F.col("d") > 0) & (F.col("e") > 0), 10.0 * F.log10(F.col("d") / F.col("e"))).alias("change_db"))


def si_sdr(pairs: DataFrame, key: list[str], x: str, y: str) -> DataFrame:
    """``key``, si_sdr: scale-invariant ratio in dB of the estimate ``y`` to the reference ``x``, in two passes.

    Null where the reference, the projection or the residual has no energy.
    """
    dots = pairs.groupBy(*key).agg(F.sum(F.col(x) * F.col(y)).alias("xy"), F.sum(F.col(x) * F.col(x)).alias("xx"))
    scaled = pairs.join(dots.where("xx > 0").withColumn("a", F.col("xy") / F.col("xx")), key)
    residual = F.col(y) - F.col("a") * F.col(x)
    energies = scaled.groupBy(*key).agg(F.sum(F.col("a") * F.col(x) * F.col("a") * F.col(x)).alias("t"), F.sum(residual * residual).alias("r"))
    return energies.select(*key, F.when((F.col("t") > 0) & (F.col("r") > 0), 10.0 * F.log10(F.col("t") / F.col("r"))).alias("si_sdr"))


def residual_at(reference: DataFrame, estimate: DataFrame, sites: DataFrame, width: int, around: int, guard: int = 8) -> DataFrame:
    """rec, site, ratio_db: what is audible of the residual where something was repaired.

    The residual is the estimate without the reference scaled to fit it. Its peak from ``guard`` samples before the site to
    ``guard`` after its ``width`` samples, with the scale taken out, stands over the reference's peak within ``around``
    samples, which counts as at least 0.02 of the recording's RMS. Null where there is no residual; recordings without power
    give no rows. Sites are dealt to cells, so that samples meet them by an equal join; rows of one site are one.
    """
    cell, floor = 1 << 10, 0.02
    pairs = reference.select("rec", "n", F.col("x").alias("s")).join(estimate.select("rec", "n", "x"), ["rec", "n"])
    fit = pairs.groupBy("rec").agg(F.sum(F.col("x") * F.col("s")).alias("xs"), F.sum(F.col("s") * F.col("s")).alias("ss"), F.count(F.lit(1)).alias("size")).where("ss > 0")
    fit = fit.select("rec", (F.col("xs") / F.col("ss")).alias("a"), F.sqrt(F.col("ss") / F.col("size")).alias("level"))
    before, after = max(guard, around), max(width + guard, around)
    cells = F.sequence(F.floor((F.col("site") - before) / cell), F.floor((F.col("site") + after) / cell))
    wanted = sites.select("rec", "site").distinct().withColumn("c", F.explode(cells)).join(fit, "rec")
    met = pairs.withColumn("c", F.floor(F.col("n") / cell)).join(wanted, ["rec", "c"]).withColumn("d", F.col("n") - F.col("site"))
    off = F.max(F.when((F.col("d") >= -guard) & (F.col("d") < width + guard), F.abs(F.col("x") - F.col("a") * F.col("s"))))
    near = F.max(F.when((F.col("d") >= -around) & (F.col("d") < around), F.abs("s")))
    found = met.groupBy("rec", "site", "a", "level").agg(off.alias("off"), near.alias("near"))
    scale = F.when(F.abs("a") > 1e-12, F.abs("a")).otherwise(1.0)
    ratio = F.col("off") / scale / F.greatest("near", floor * F.col("level"))
    return found.where("off IS NOT NULL").select("rec", "site", F.when(F.col("off") > 0, 20.0 * F.log10(ratio)).alias("ratio_db"))


def decay(samples: DataFrame, frame: int, drop_db: float, span: int, reach: int) -> DataFrame:
    """rec, frames: median number of frames in which the level falls by ``drop_db`` from a local peak.

    Peaks are at least their neighbours and within ``span`` dB of the recording's loudest frame; a peak whose level is passed
    before it has fallen, within ``reach`` frames, counts for nothing. Frames meet the ones after them by cells of ``reach``.
    """
    level = samples.groupBy("rec", F.floor(F.col("n") / frame).alias("f")).agg(F.avg(F.col("x") * F.col("x")).alias("z")).select("rec", "f", (10.0 * F.log10(F.col("z") + 1e-12)).alias("e"))
    top = level.groupBy("rec").agg(F.max("e").alias("top"), F.max("f").alias("last"))
    left = level.select("rec", (F.col("f") + 1).alias("f"), F.col("e").alias("before"))
    right = level.select("rec", (F.col("f") - 1).alias("f"), F.col("e").alias("after"))
    peaks = level.join(left, ["rec", "f"]).join(right, ["rec", "f"]).join(top, "rec").where("e >= before AND e >= after").where(F.col("e") >= F.col("top") - span)
    looks = peaks.select("rec", "f", "e", F.explode(F.sequence(F.floor((F.col("f") + 1) / reach), F.floor((F.col("f") + reach - 1) / reach))).alias("c"))
    later = level.select("rec", F.floor(F.col("f") / reach).alias("c"), F.col("f").alias("g"), F.col("e").alias("ge"))
    met = looks.join(later, ["rec", "c"]).where((F.col("g") > F.col("f")) & (F.col("g") < F.col("f") + reach))
    fell = F.min(F.when(F.col("ge") <= F.col("e") - drop_db, F.col("g")))
    rose = F.min(F.when(F.col("ge") > F.col("e"), F.col("g")))
    times = met.groupBy("rec", "f").agg(fell.alias("fell"), rose.alias("rose")).where("fell IS NOT NULL AND (rose IS NULL OR fell < rose)")
    return times.groupBy("rec").agg(F.median(F.col("fell") - F.col("f")).alias("frames"))


def segment_snr(samples: DataFrame, speech: DataFrame, silences: DataFrame, window: int, guard: int) -> DataFrame:
    """rec, snr_db, segments: median over speech ranges (rec, start, end) that follow a silence, of their level over that of
    the silence's last ``window`` samples but for the last ``guard``."""
    from .loudness import range_loudness

    ranges = speech.select("rec", F.col("start").alias("i"), "start", "end")
    loud = range_loudness(samples, ranges).select("rec", "i", F.col("z").alias("zs"))
    last = silences.select("rec", F.col("end").alias("i"), F.greatest("start", F.col("end") - guard - window).alias("start"), (F.col("end") - guard).alias("end")).where("end > start")
    noise = range_loudness(samples, last).select("rec", "i", F.col("z").alias("zn"))
    both = loud.join(noise, ["rec", "i"]).where("zs > 0 AND zn > 0").select("rec", (10.0 * F.log10(F.col("zs") / F.col("zn"))).alias("snr"))
    return both.groupBy("rec").agg(F.median("snr").alias("snr_db"), F.count(F.lit(1)).alias("segments"))
