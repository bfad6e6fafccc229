"""Sample peaks, true peaks and peak pyramids."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.num import db
from ..sources.layout import in_chunk, with_halo

#: The four phases of the 4x oversampling filter of ITU-R BS.1770-4, Annex 2.
PHASES = (
    (0.0017089843750, 0.0109863281250, -0.0196533203125, 0.0332031250000, -0.0594482421875, 0.1373291015625, 0.9721679687500, -0.1022949218750, 0.0476074218750, -0.0266113281250, 0.0148925781250, -0.0083007812500),
    (-0.0291748046875, 0.0292968750000, -0.0517578125000, 0.0891113281250, -0.1665039062500, 0.4650878906250, 0.7797851562500, -0.2003173828125, 0.1015625000000, -0.0582275390625, 0.0330810546875, -0.0189208984375),
    (-0.0189208984375, 0.0330810546875, -0.0582275390625, 0.1015625000000, -0.2003173828125, 0.7797851562500, 0.4650878906250, -0.1665039062500, 0.0891113281250, -0.0517578125000, 0.0292968750000, -0.0291748046875),
    (-0.0083007812500, 0.0148925781250, -0.0266113281250, 0.0476074218750, -0.1022949218750, 0.9721679687500, 0.1373291015625, -0.0594482421875, 0.0332031250000, -0.0196533203125, 0.0109863281250, 0.0017089843750),
)


def sample_peak(samples: DataFrame) -> DataFrame:
    """rec, peak_db."""
    return samples.groupBy("rec").agg(db(F.max(F.abs("x"))).alias("peak_db"))


def oversampled(samples: DataFrame) -> DataFrame:
    """rec, n, peak: the largest magnitude of the four phases at each sample; taps beyond the recording count nothing."""
    w = in_chunk()
    tap = [F.coalesce(F.lag("x", 5 - t).over(w) if t <= 5 else F.lead("x", t - 5).over(w), F.lit(0.0)) for t in range(12)]
    rows = with_halo(samples, 5, 6).select("rec", "chunk", "n", "core", *[c.alias(f"t{i}") for i, c in enumerate(tap)])
    phases = [F.abs(sum((F.col(f"t{i}") * k for i, k in enumerate(phase)), F.lit(0.0))) for phase in PHASES]
    return rows.where("core").select("rec", "n", F.greatest(*phases).alias("peak"))


def true_peak(samples: DataFrame) -> DataFrame:
    """rec, peak_db of the oversampled signal."""
    return oversampled(samples).groupBy("rec").agg(db(F.max("peak")).alias("peak_db"))


def true_peak_envelope(samples: DataFrame) -> DataFrame:
    """rec, n, peak: oversampled magnitude, spread to the two neighbours."""
    spread = F.max("peak").over(in_chunk(-1, 1))
    return with_halo(oversampled(samples), 1, 1).withColumn("p", spread).where("core").select("rec", "n", F.col("p").alias("peak"))


def pyramid(samples: DataFrame, base: int = 128, levels: int = 3) -> DataFrame:
    """rec, level, b, lo, hi: least and greatest sample of blocks of base * 2^level; each level is made of the one below."""
    low = samples.groupBy("rec", F.floor(F.col("n") / base).alias("b")).agg(F.min("x").alias("lo"), F.max("x").alias("hi"))
    out = low.select("rec", F.lit(0).alias("level"), "b", "lo", "hi")
    for level in range(1, levels):
        low = low.groupBy("rec", F.floor(F.col("b") / 2).alias("b")).agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))
        out = out.unionByName(low.select("rec", F.lit(level).alias("level"), "b", "lo", "hi"))
    return out
