"""Segment gains, breakpoints, gain envelopes and limiting."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.num import clamp, db_to_lin, lufs
from ..sources.layout import in_chunk, with_halo


def segment_gains(segments: DataFrame, threshold: float, target: float, most: float) -> DataFrame:
    """Adds is_speech, gain_db and filled_db to segments (rec, i, start, end, z).

    Speech is louder than ``threshold``; if no segment is, every segment with a level is. A segment without speech takes
    the gain of the nearest one with speech by index, of two equally near the earlier; without any it takes 0 dB.
    """
    every = Window.partitionBy("rec")
    level = segments.withColumn("lufs", lufs(F.col("z"))).withColumn("loud", F.coalesce(F.col("lufs") > threshold, F.lit(False)))
    told = level.withColumn("is_speech", F.when(F.max("loud").over(every), F.col("loud")).otherwise(F.col("lufs").isNotNull()))
    own = told.withColumn("gain_db", F.when(F.col("is_speech"), clamp(target - F.col("lufs"), most)))
    order = Window.partitionBy("rec").orderBy("i")
    back, ahead = order.rowsBetween(Window.unboundedPreceding, 0), order.rowsBetween(0, Window.unboundedFollowing)
    speech = F.when(F.col("gain_db").isNotNull(), F.struct("i", "gain_db"))
    near = own.withColumn("p", F.last(speech, True).over(back)).withColumn("q", F.first(speech, True).over(ahead))
    nearer_ahead = F.col("p.i").isNull() | (F.col("q.i") - F.col("i") < F.col("i") - F.col("p.i"))
    filled = F.coalesce(F.when(nearer_ahead, F.col("q.gain_db")), F.col("p.gain_db"), F.col("q.gain_db"), F.lit(0.0))
    return near.withColumn("filled_db", filled).drop("loud", "p", "q")


def breakpoints(gains: DataFrame, silences: DataFrame, size: DataFrame) -> DataFrame:
    """rec, at, db: a segment's gain holds up to the silence after it and the next one's holds from that silence's end."""
    order = Window.partitionBy("rec").orderBy("i")
    steps = gains.select("rec", "i", F.col("filled_db").alias("g"), F.lead("filled_db").over(order).alias("h"))
    turns = silences.join(steps, ["rec", "i"]).where("h IS NOT NULL").select("rec", F.inline(F.array(F.struct(F.col("start").alias("at"), F.col("g").alias("db")), F.struct(F.col("end").alias("at"), F.col("h").alias("db")))))
    first = steps.where("i = 0").select("rec", F.lit(0).cast("bigint").alias("at"), F.col("g").alias("db"))
    last = steps.join(size, "rec").where("h IS NULL").select("rec", F.col("length").alias("at"), F.col("g").alias("db"))
    return turns.unionByName(first).unionByName(last).distinct()


def spans_of(points: DataFrame) -> DataFrame:
    """rec, at, db, next_at, next_db: each breakpoint with its successor."""
    order = Window.partitionBy("rec").orderBy("at", "db")
    return points.select("rec", "at", "db", F.lead("at").over(order).alias("next_at"), F.lead("db").over(order).alias("next_db"))


def gain_envelope(samples: DataFrame, points: DataFrame, chunk: int = 1 << 12) -> DataFrame:
    """rec, n, gain_db: the breakpoints' gains, between them on a line in dB, at every sample.

    Spans between breakpoints are cut to chunks, so that samples meet theirs by an equal join on the chunk.
    """
    spans = spans_of(points).where("next_at > at")
    pieces = spans.withColumn("chunk", F.explode(F.sequence(F.floor(F.col("at") / chunk), F.floor((F.col("next_at") - 1) / chunk))))
    met = samples.select("rec", "n", F.floor(F.col("n") / chunk).alias("chunk")).join(pieces, ["rec", "chunk"]).where("n >= at AND n < next_at")
    share = (F.col("n") - F.col("at")) / (F.col("next_at") - F.col("at"))
    return met.select("rec", "n", (F.col("db") + (F.col("next_db") - F.col("db")) * share).alias("gain_db"))


def backward_ramp(required: DataFrame, attack: float, reach: int, chunk: int) -> DataFrame:
    """rec, n, gain: the limiter's look-ahead ramp over required gains (rec, n, gain in 0..1).

    g[n] = min(gain[n], 1 - (1 - g[n + 1]) * attack) is a running maximum of (1 - gain) * attack^n from the end, taken here
    over a frame of ``reach`` samples, past which attack^reach is below double precision's step for the ramp.
    """
    rows = with_halo(required, 0, reach, chunk)
    cut = 1.0 - F.col("gain")
    at = (F.col("n") - F.col("chunk") * chunk).cast("double")
    ahead = in_chunk(0, reach)
    weighed = rows.withColumn("e", F.when(cut > 0, F.log(F.when(cut > 0, cut)) + at * math.log(attack)))
    most = F.max("e").over(ahead)
    return weighed.withColumn("r", F.coalesce(F.exp(most - at * math.log(attack)), F.lit(0.0))).where("core").select("rec", "n", (1.0 - F.col("r")).alias("gain"))


def apply_gain(samples: DataFrame, envelope: DataFrame) -> DataFrame:
    """Samples times their envelope's gain in dB."""
    return samples.join(envelope, ["rec", "n"]).select("rec", "n", (F.col("x") * db_to_lin(F.col("gain_db"))).alias("x"))
