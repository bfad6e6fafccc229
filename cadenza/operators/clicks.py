"""Click candidates: robust deviation, density guard, interval merging, and the veto of pulse trains."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.layout import in_chunk, with_halo


def pre_emphasis(samples: DataFrame, k: float = 0.97) -> DataFrame:
    """rec, n, y = x[n] - k * x[n - 1]."""
    late = F.coalesce(F.lag("x").over(in_chunk()), F.lit(0.0))
    return with_halo(samples, 1, 0).withColumn("y", F.col("x") - k * late).where("core").select("rec", "n", "y")


def block_sigma(samples: DataFrame, block: int) -> DataFrame:
    """rec, b, sigma: 1.4826 times the median magnitude of each block; blocks under 1e-7 are left out."""
    blocks = samples.groupBy("rec", F.floor(F.col("n") / block).alias("b")).agg((1.4826 * F.median(F.abs("x"))).alias("sigma"))
    return blocks.where("sigma >= 1e-7")


def candidates(samples: DataFrame, block: int, times: float) -> DataFrame:
    """rec, b, start, end, peak: runs inside a block over ``times`` its sigma, with their largest magnitude."""
    loud = samples.withColumn("b", F.floor(F.col("n") / block)).join(block_sigma(samples, block), ["rec", "b"]).where(F.abs("x") > times * F.col("sigma"))
    island = F.col("n") - F.row_number().over(Window.partitionBy("rec", "b").orderBy("n"))
    runs = loud.withColumn("g", island).groupBy("rec", "b", "g")
    return runs.agg(F.min("n").alias("start"), (F.max("n") + 1).alias("end"), F.max(F.abs("x")).alias("peak")).drop("g")


def density_guard(found: DataFrame, block: int, most: float) -> DataFrame:
    """Drops all of a block's candidates where they cover more than ``most`` of it."""
    covered = F.sum(F.col("end") - F.col("start")).over(Window.partitionBy("rec", "b"))
    return found.withColumn("covered", covered).where(F.col("covered") <= most * block).drop("covered")


def pulse_veto(found: DataFrame, nearest: int, farthest: int, ratio: float) -> DataFrame:
    """Drops candidates that have another, at least ``ratio`` as high, at a gap of ``nearest`` to ``farthest`` samples.

    A band join: both sides are dealt to cells of ``farthest`` samples, and each looks into its own and the two beside.
    """
    cell = F.floor(F.col("start") / farthest)
    others = found.select(F.col("rec").alias("orec"), F.col("start").alias("ostart"), F.col("end").alias("oend"), F.col("peak").alias("opeak"), cell.alias("oc"))
    looks = found.withColumn("c", F.explode(F.sequence(F.floor((F.col("start") - 2 * farthest) / farthest), F.floor((F.col("end") + farthest) / farthest))))
    gap = F.when(F.col("ostart") >= F.col("end"), F.col("ostart") - F.col("end")).otherwise(F.col("start") - F.col("oend"))
    vetoed = looks.join(others, (F.col("rec") == F.col("orec")) & (F.col("c") == F.col("oc")) & (F.col("opeak") >= ratio * F.col("peak")) & (gap >= nearest) & (gap <= farthest))
    keys = vetoed.select(F.col("rec").alias("vrec"), F.col("start").alias("vstart")).distinct()
    return found.join(keys, (F.col("rec") == F.col("vrec")) & (F.col("start") == F.col("vstart")), "left_anti")


def autocorrelation(samples: DataFrame, lags: int) -> DataFrame:
    """rec, k, r: sum of x[n] * x[n - k] for k = 0..lags."""
    w = in_chunk()
    late = F.array(*[F.coalesce(F.lag("x", k).over(w), F.lit(0.0)) for k in range(lags + 1)])
    rows = with_halo(samples, lags, 0).withColumn("late", late).where("core")
    return rows.select("rec", "x", F.posexplode("late").alias("k", "y")).groupBy("rec", "k").agg(F.sum(F.col("x") * F.col("y")).alias("r"))
