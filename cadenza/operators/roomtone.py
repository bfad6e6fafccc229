"""Room tone: scoring of quiet stretches, the cleanest clip of each, and a crossfaded bed."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Weights of the score: peaks over the median block, and unevenness of the blocks' RMS.
PEAK_WEIGHT, SPREAD_WEIGHT, EPS, SILENT_PEAK, SILENT_SCORE = 1.5, 25.0, 1e-9, 1e-4, -140.0


def window_scores(samples: DataFrame, windows: DataFrame, block: int, chunk: int = 1 << 12) -> DataFrame:
    """rec, i, start, end, score of ``windows`` (rec, i, start, end): lower is cleaner.

    Level in dB, plus how far the loudest block's peak stands over the median block's, plus the spread of the blocks' RMS.
    """
    pieces = windows.withColumn("c", F.explode(F.sequence(F.floor(F.col("start") / chunk), F.floor((F.col("end") - 1) / chunk))))
    met = samples.withColumn("c", F.floor(F.col("n") / chunk)).join(pieces, ["rec", "c"]).where("n >= start AND n < end")
    blocks = met.groupBy("rec", "i", "start", "end", F.floor((F.col("n") - F.col("start")) / block).alias("b")).agg(F.avg(F.col("x") * F.col("x")).alias("z"), F.max(F.abs("x")).alias("peak"), F.count(F.lit(1)).alias("c"))
    whole = blocks.groupBy("rec", "i", "start", "end").agg(
        F.sqrt(F.sum(F.col("z") * F.col("c")) / F.sum("c")).alias("rms"), F.max("peak").alias("top"), F.median("peak").alias("mid"),
        F.avg(F.sqrt("z")).alias("mean"), F.stddev_pop(F.sqrt("z")).alias("sd"),
    )
    score = 20.0 * F.log10(F.col("rms") + EPS) + PEAK_WEIGHT * 20.0 * F.log10((F.col("top") + EPS) / (F.col("mid") + EPS)) + SPREAD_WEIGHT * F.col("sd") / (F.col("mean") + EPS)
    return whole.select("rec", "i", "start", "end", F.when(F.col("top") < SILENT_PEAK, SILENT_SCORE).otherwise(score).alias("score"))


def best_windows(samples: DataFrame, ranges: DataFrame, size: int, hop: int, block: int) -> DataFrame:
    """rec, i, start, end, score: the cleanest window of ``size`` in each range, the earliest of equals; a shorter range whole."""
    starts = F.when(F.col("end") - F.col("start") <= size, F.array(F.col("start"))).otherwise(F.sequence(F.col("start"), F.col("end") - size, F.lit(hop).cast("bigint")))
    tried = ranges.withColumn("at", F.explode(starts)).select("rec", "i", F.col("at").alias("start"), F.least("end", F.col("at") + size).alias("end"))
    best = window_scores(samples, tried, block).groupBy("rec", "i").agg(F.min(F.struct(F.round("score", 9).alias("score"), "start", "end")).alias("b"))
    return best.select("rec", "i", "b.start", "b.end", "b.score")


def keep_clean(clips: DataFrame, margin: float) -> DataFrame:
    """Clips whose score is at most ``margin`` over the recording's best."""
    return clips.withColumn("best", F.min("score").over(Window.partitionBy("rec"))).where(F.col("score") <= F.col("best") + margin).drop("best")


def bed(samples: DataFrame, clips: DataFrame, target: int, crossfade: int, fade: int, most: int = 1000, chunk: int = 1 << 12) -> DataFrame:
    """rec, n, x: clips in turn, every other instance reversed, overlapped with equal power until ``target`` samples are there.

    Instances are rows (at most ``most`` a recording); each sample of a clip is weighed for each instance and summed by place.
    """
    order = Window.partitionBy("rec").orderBy("start")
    told = clips.select("rec", "start", (F.col("end") - F.col("start")).alias("size"), (F.row_number().over(order) - 1).alias("k"), F.count(F.lit(1)).over(Window.partitionBy("rec")).alias("clips"))
    turns = told.where(F.col("k") < most).withColumn("p", F.explode(F.sequence(F.col("k").cast("bigint"), F.lit(most - 1).cast("bigint"), F.col("clips"))))
    line = Window.partitionBy("rec").orderBy("p")
    before = F.lag("size").over(line)
    overlapped = turns.withColumn("xf", F.when(before.isNull(), 0).otherwise(F.least(F.lit(crossfade), F.floor(before / 2), F.floor(F.col("size") / 2))).cast("bigint"))
    grown = overlapped.withColumn("ends", F.sum(F.col("size") - F.col("xf")).over(line.rowsBetween(Window.unboundedPreceding, 0)))
    kept = grown.where(F.col("ends") - (F.col("size") - F.col("xf")) < target).withColumn("out", F.coalesce(F.lead("xf").over(line), F.lit(0)))
    kept = kept.withColumn("out", F.when(F.lead("p").over(line).isNull(), 0).otherwise(F.col("out"))).withColumn("at", F.col("ends") - F.col("size"))
    ends = kept.groupBy(F.col("rec").alias("erec")).agg(F.max("ends").alias("total"))
    pieces = kept.withColumn("c", F.explode(F.sequence(F.floor(F.col("start") / chunk), F.floor((F.col("start") + F.col("size") - 1) / chunk))))
    met = samples.select("rec", "n", "x", F.floor(F.col("n") / chunk).alias("c")).join(pieces, ["rec", "c"]).where("n >= start AND n < start + size")
    inner = F.when(F.col("p") % 2 == 1, F.col("size") - 1 - (F.col("n") - F.col("start"))).otherwise(F.col("n") - F.col("start"))
    placed = met.withColumn("j", inner).withColumn("left", F.col("size") - 1 - F.col("j"))
    rise = F.when(F.col("j") < F.col("xf"), F.sin(math.pi / 2 * (F.col("j") + 0.5) / F.col("xf"))).otherwise(1.0)
    fall = F.when(F.col("left") < F.col("out"), F.sin(math.pi / 2 * (F.col("left") + 0.5) / F.col("out"))).otherwise(1.0)
    sums = placed.groupBy("rec", (F.col("at") + F.col("j")).alias("m")).agg(F.sum(F.col("x") * rise * fall).alias("x")).join(ends, F.col("rec") == F.col("erec"))
    edge = F.least(F.lit(1.0), (F.col("m") + 0.5) / fade, (F.col("total") - F.col("m") - 0.5) / fade)
    return sums.select("rec", F.col("m").alias("n"), (F.col("x") * edge).alias("x"))
