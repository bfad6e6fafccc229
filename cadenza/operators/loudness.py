"""Gated loudness, loudness range, and loudness of windows and ranges."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.num import floor_rank, lufs
from ..sources.layout import hopping_mean_squares
from .ranks import at_ranks


def gated(blocks: DataFrame, keys: list[str]) -> DataFrame:
    """Integrated loudness of blocks (``keys``, z): gate at -70 LUFS, then at 10 LU under the mean of what is left.

    Both gates take the mean of mean squares. Keys none of whose blocks pass the first gate give no row.
    """
    heard = blocks.withColumn("l", lufs(F.col("z"))).where("l >= -70")
    gate = heard.groupBy(*keys).agg((lufs(F.avg("z")) - 10.0).alias("gate"))
    return heard.join(gate, keys).where("l >= gate").groupBy(*keys).agg(lufs(F.avg("z")).alias("lufs"), F.count(F.lit(1)).alias("blocks"))


def integrated(samples: DataFrame, block: int, hop: int) -> DataFrame:
    """rec, lufs, blocks of each recording."""
    return gated(hopping_mean_squares(samples, block, hop), ["rec"])


def momentary(samples: DataFrame, block: int, hop: int) -> DataFrame:
    """rec, b, lufs of every full block (null where silent)."""
    return hopping_mean_squares(samples, block, hop).select("rec", "b", lufs(F.col("z")).alias("lufs"))


def loudest(samples: DataFrame, block: int, hop: int) -> DataFrame:
    """rec, lufs: the loudest full block."""
    return momentary(samples, block, hop).groupBy("rec").agg(F.max("lufs").alias("lufs"))


def loudness_range(samples: DataFrame, block: int, hop: int) -> DataFrame:
    """rec, lra: spread of the blocks over -70 LUFS and 20 LU under their 95th percentile, from the 10th to the 95th.

    Fewer than two such blocks give 0.
    """
    heard = momentary(samples, block, hop).select("rec", F.when(F.col("lufs") >= -70, F.col("lufs")).alias("v"))
    top = at_ranks(heard, {"top": lambda n: floor_rank(n, 0.95)}).select("rec", "top")
    kept = heard.join(top, "rec").select("rec", F.when(F.col("v") > F.col("top") - 20.0, F.col("v")).alias("v"))
    spread = at_ranks(kept, {"low": lambda n: floor_rank(n, 0.10), "high": lambda n: floor_rank(n, 0.95)})
    return spread.select("rec", F.when(F.col("n") < 2, 0.0).otherwise(F.col("high") - F.col("low")).alias("lra"))


def centered_windows(samples: DataFrame, window: int, hop: int) -> DataFrame:
    """rec, f, z: mean square of [c - half, c + half) around c = f * hop + floor(hop / 2), clipped to the recording."""
    half = window // 2
    size = samples.groupBy("rec").agg((F.max("n") + 1).alias("length"))
    reach = F.sequence(F.floor((F.col("n") - hop // 2 - half) / hop) , F.floor((F.col("n") - hop // 2 + half) / hop))
    dealt = samples.select("rec", "n", "x", F.explode(reach).alias("f"))
    center = F.col("f") * hop + hop // 2
    inside = dealt.where((F.col("n") >= center - half) & (F.col("n") < center + half) & (F.col("f") >= 0))
    frames = inside.groupBy("rec", "f").agg(F.avg(F.col("x") * F.col("x")).alias("z"))
    return frames.join(size, "rec").where(F.col("f") < F.floor(F.col("length") / hop)).drop("length")


def range_loudness(samples: DataFrame, ranges: DataFrame) -> DataFrame:
    """``ranges`` (rec, i, start, end) with z, the mean square of [start, end).

    Ranges are cut to pieces of a chunk, so samples meet them by an equal join on the chunk.
    """
    size = 1 << 12
    pieces = ranges.withColumn("chunk", F.explode(F.sequence(F.floor(F.col("start") / size), F.floor((F.col("end") - 1) / size))))
    found = samples.withColumn("chunk", F.floor(F.col("n") / size)).join(pieces, ["rec", "chunk"]).where("n >= start AND n < end")
    return found.groupBy("rec", "i", "start", "end").agg(F.avg(F.col("x") * F.col("x")).alias("z"))


def otsu(values: DataFrame, bins: int = 128) -> DataFrame:
    """rec, threshold: the split of the values' histogram (rec, v) with the greatest variance between the classes.

    The first of equal splits wins; the threshold is the upper edge of the lower class's last bin. One value alone gives it.
    """
    span = values.groupBy("rec").agg(F.min("v").alias("lo"), F.max("v").alias("hi"), F.count(F.lit(1)).alias("total"))
    width = (F.col("hi") - F.col("lo")) / bins
    binned = values.join(span, "rec").where("hi > lo").withColumn("bin", F.least(F.lit(bins - 1), F.floor((F.col("v") - F.col("lo")) / width)).cast("int"))
    counts = binned.groupBy("rec", "lo", "hi", "total", "bin").agg(F.count(F.lit(1)).alias("c"))
    grid = span.where("hi > lo").select("rec", "lo", "hi", "total", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"))
    full = grid.join(counts.select("rec", "bin", "c"), ["rec", "bin"], "left").withColumn("c", F.coalesce("c", F.lit(0)))
    up_to = Window.partitionBy("rec").orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)  # bins rows a recording
    whole = Window.partitionBy("rec")
    run = full.select("rec", "lo", "hi", "total", "bin", F.sum("c").over(up_to).alias("w"), F.sum(F.col("c") * F.col("bin")).over(up_to).alias("s"), F.sum(F.col("c") * F.col("bin")).over(whole).alias("all"))
    low, high = F.col("s") / F.col("w"), (F.col("all") - F.col("s")) / (F.col("total") - F.col("w"))
    between = run.where("w > 0 AND w < total").withColumn("var", F.round(F.col("w").cast("double") * (F.col("total") - F.col("w")) * (low - high) * (low - high), 6))
    best = between.groupBy("rec", "lo", "hi").agg(F.max(F.struct("var", (-F.col("bin")).alias("minus"))).alias("b"))
    return best.select("rec", (F.col("lo") + (F.col("hi") - F.col("lo")) * (1 - F.col("b.minus")) / bins).alias("threshold"))
