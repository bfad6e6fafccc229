"""Blind listening sessions: trials from windows and variants, hidden labels, loudness matching."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def plan_trials(windows: DataFrame, variants: DataFrame, most: int) -> DataFrame:
    """trial, window, variant, file, label, start, dur.

    Each window (window, start, dur) is heard with its variants (window, ord, variant, file), ``most`` to a trial; trials are
    t01, t02, ..., t100 by window and chunk. A lone last variant of a window goes with the chunk before. Labels A, B, ... follow a hash of trial and variant, so they tell nothing of the
    order and are the same each time. A variant of a window that is not there stops the job, and so does a trial of one or
    of more than ten variants.
    """
    at = F.row_number().over(Window.partitionBy("window").orderBy("ord")) - 1
    size = F.count(F.lit(1)).over(Window.partitionBy("window"))
    last = F.when((size % most == 1) & (size > 1), F.floor(size / most) - 1).otherwise(F.floor(size / most))
    dealt = variants.withColumn("chunk", F.least(F.floor(at / most), last))
    joined = dealt.join(windows.select("window", "start", "dur", F.lit(True).alias("known")), "window", "left")
    checked = joined.withColumn("start", F.when(F.col("known"), F.col("start")).otherwise(F.raise_error(F.concat(F.lit("no window "), F.col("window").cast("string"))).cast("double")))
    number = checked.select("window", "chunk").distinct().withColumn("t", F.row_number().over(Window.orderBy("window", "chunk")))  # one row a trial
    rows = checked.join(number, ["window", "chunk"]).withColumn("trial", F.concat(F.lit("t"), F.when(F.col("t") < 10, F.lit("0")).otherwise(""), F.col("t").cast("string")))
    hidden = Window.partitionBy("trial").orderBy(F.sha2(F.concat_ws("/", "trial", "variant"), 256))
    size = F.count(F.lit(1)).over(Window.partitionBy("trial"))
    told = rows.withColumn("size", size).withColumn("label", F.chr((F.row_number().over(hidden) + 64).cast("bigint")))
    good = F.when(F.col("size").between(2, 10), F.col("label")).otherwise(F.raise_error(F.concat(F.lit("bad size of trial "), F.col("trial"))))
    return told.select("trial", "window", "variant", "file", good.alias("label"), "start", "dur")


def match_gains(measured: DataFrame, target: float, peak_limit_db: float = -0.1) -> DataFrame:
    """clip, gain_db: what brings clips (clip, lufs, peak_db) to ``target``; 0 for a silent clip. A clip that would then peak
    over ``peak_limit_db`` stops the job."""
    wanted = F.coalesce(target - F.col("lufs"), F.lit(0.0))
    over = F.col("peak_db") + wanted > peak_limit_db
    return measured.select("clip", F.when(~F.coalesce(over, F.lit(False)), wanted).otherwise(F.raise_error(F.concat(F.lit("clip would peak over the limit: "), F.col("clip"))).cast("double")).alias("gain_db"))


def same_variants(before: DataFrame, after: DataFrame) -> DataFrame:
    """trial, same: whether a trial (trial, variant rows) holds the same variants, as often, as it did."""
    bag = lambda df, name: df.groupBy("trial").agg(F.array_sort(F.collect_list("variant")).alias(name))
    return bag(after, "now").join(bag(before, "was"), "trial", "left").select("trial", F.coalesce(F.col("now") == F.col("was"), F.lit(False)).alias("same"))


def report_lines(run: DataFrame) -> DataFrame:
    """rec, line of run rows (rec, lufs, peak_db, segments): a line of text each."""
    number = lambda c: F.when(F.col(c).isNull() | F.isnan(c), "-inf").otherwise(F.format_string("%.1f", F.col(c)))
    plural = F.when(F.col("segments") == 1, "segment").otherwise("segments")
    return run.select("rec", F.concat_ws(" ", F.concat("rec", F.lit(":")), number("lufs"), F.lit("LUFS, peak"), number("peak_db"), F.lit("dBFS,"), F.col("segments").cast("string"), plural).alias("line"))
