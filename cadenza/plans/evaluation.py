"""Evaluation: cases of made material, their chains and bounds, run as one table of metrics."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.num import db
from ..operators import chain, islands, metrics, transforms
from ..sources import speech, synthetic
from ..sources.layout import CHUNK, lengths
from .stages import programme, run_chain

RATE = 8000.0
EXPECTATION = "case string, metric string, lo double, hi double, because string"


@dataclass(frozen=True)
class Case:
    """A case: what it is fed, the clean reference if it has one, the stages that run, and what must hold."""

    name: str
    build: Callable[[SparkSession], tuple[DataFrame, DataFrame | None, DataFrame]]
    only: tuple[str, ...]
    bypass: tuple[str, ...]
    bounds: tuple[tuple[str, float | None, float | None, str], ...]


def _talk(spark: SparkSession, name: str, levels: tuple[float, ...] = (-24.0, -24.0), floor: float = -70.0) -> tuple[DataFrame, DataFrame]:
    return speech.talk(spark, name, RATE, [(2.0, level, 110.0 + 20 * i) for i, level in enumerate(levels)], 1.2, floor, 4242)


def _clean(name: str, **options):
    def build(spark: SparkSession):
        samples, bounds = _talk(spark, name, **options)
        return samples, None, bounds

    return build


def _clicky(spark: SparkSession):
    samples, bounds = _talk(spark, "clicky")
    size = int(2 * 2.0 * RATE + 3 * 1.2 * RATE)
    places = spark.createDataFrame([("clicky", int(p)) for p in synthetic.click_places(size, 12, 3, 5150)], "rec string, site bigint")
    return synthetic.with_clicks(samples, places, 0.8, 3), samples, bounds


def in_room(samples: DataFrame, rate: float, response: np.ndarray, chunk: int = CHUNK) -> DataFrame:
    """Samples in a room, at the loudness that they had before; recordings without a loudness are only convolved."""
    wet = transforms.convolved(samples, response, chunk)
    gain = programme(samples, rate).withColumnRenamed("lufs", "dry").join(programme(wet, rate).withColumnRenamed("lufs", "wet"), "rec")
    gain = gain.select(F.col("rec").alias("grec"), F.pow(F.lit(10.0), (F.col("dry") - F.col("wet")) / 20).alias("gain"))
    return wet.join(gain, F.col("rec") == F.col("grec"), "left").select("rec", "n", (F.col("x") * F.coalesce("gain", F.lit(1.0))).alias("x"))


CASES = (
    Case("bypass", _clean("bypass"), ("level",), ("level",), (("change_db", None, None, "nothing runs"), ("unchanged", 1.0, 1.0, "a bypassed chain gives back its input"))),
    Case("drift", _clean("drift", levels=(-34.0, -18.0)), ("level",), (), (("out_lufs", -21.0, -15.0, "levelled to the target"), ("peak_db", None, -0.5, "under the ceiling"))),
    Case("clicky", _clicky, ("declick",), (), (("si_sdr_gain_db", 3.0, None, "clicks are repaired"),)),
    Case("quiet-room", _clean("quiet-room", floor=-95.0), ("denoise",), (), (("unchanged", 1.0, 1.0, "clean material is left alone"),)),
)


def expectations(spark: SparkSession, cases: tuple[Case, ...] = CASES) -> DataFrame:
    rows = [(c.name, metric, lo, hi, because) for c in cases for metric, lo, hi, because in c.bounds if not (lo is None and hi is None)]
    return spark.createDataFrame(rows, EXPECTATION)


def measure(case: str, before: DataFrame, after: DataFrame, reference: DataFrame | None) -> DataFrame:
    """case, metric, value; a metric that is not finite has no row."""
    pairs = before.join(after.select("rec", "n", F.col("x").alias("y")), ["rec", "n"])
    rows = [
        programme(after, RATE).select(F.lit("out_lufs").alias("metric"), F.col("lufs").alias("value")),
        after.groupBy("rec").agg(db(F.max(F.abs("x"))).alias("value")).select(F.lit("peak_db").alias("metric"), "value"),
        metrics.change_db(before, after).select(F.lit("change_db").alias("metric"), F.col("change_db").alias("value")),
        pairs.agg(F.bool_and(F.col("x") == F.col("y")).cast("double").alias("value")).select(F.lit("unchanged").alias("metric"), "value"),
    ]
    if reference is not None:
        clean = reference.select("rec", "n", F.col("x").alias("r"))
        score = lambda df: metrics.si_sdr(clean.join(df, ["rec", "n"]), ["rec"], "r", "x").select("rec", "si_sdr")
        gain = score(after).join(score(before).withColumnRenamed("si_sdr", "was"), "rec")
        rows.append(gain.select(F.lit("si_sdr_gain_db").alias("metric"), (F.col("si_sdr") - F.col("was")).alias("value")))
    out = rows[0]
    for r in rows[1:]:
        out = out.unionByName(r)
    return out.where("value IS NOT NULL").select(F.lit(case).alias("case"), "metric", "value")


def run_cases(spark: SparkSession, keep: Callable[[DataFrame, str], DataFrame], cases: tuple[Case, ...] = CASES) -> tuple[DataFrame, DataFrame]:
    """(metrics, checks) of cases; ``keep`` writes a table under a name and reads it again."""
    found = None
    for c in cases:
        samples, reference, _ = c.build(spark)
        before = keep(samples, f"{c.name}-in")
        after = run_chain(before, RATE, list(c.only), list(c.bypass), between=lambda df, stage, c=c: keep(df, f"{c.name}-{stage}")).samples
        told = keep(measure(c.name, before, after, keep(reference, f"{c.name}-ref") if reference is not None else None), f"{c.name}-metrics")
        found = told if found is None else found.unionByName(told)
    return found, chain.check_bounds(found, expectations(spark, cases).drop("because"))


def pauses_of(samples: DataFrame, bounds: DataFrame) -> DataFrame:
    """rec, start, end: what lies between the known segments."""
    return islands.complement(bounds.select("rec", "start", "end"), lengths(samples))
