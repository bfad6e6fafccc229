"""A chain run with measures before and after it, and its report as rows, JSON and text."""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.num import db
from ..sources.layout import lengths
from .stages import STAGES, Registry, Result, programme, run_chain, working_rate


@dataclass
class Run:
    """What a chain gives, and the facts of the run: one row a recording."""

    result: Result
    measures: DataFrame
    stages: list[tuple[str, bool, dict]]
    rate: float
    working: float


def measured(samples: DataFrame, rate: float, prefix: str) -> DataFrame:
    """rec, ``prefix``_lufs, ``prefix``_peak_db."""
    peak = samples.groupBy("rec").agg(db(F.max(F.abs("x"))).alias(f"{prefix}_peak_db"))
    return peak.join(programme(samples, rate).withColumnRenamed("lufs", f"{prefix}_lufs"), "rec", "left")


def run(
    samples: DataFrame, rate: float, only: list[str] | None = None, bypass: list[str] | None = None, params: dict[str, dict] | None = None,
    between: Callable[[DataFrame, str], DataFrame] | None = None, registry: Registry = STAGES,
) -> Run:
    """``run_chain`` with measures. A chain that passes everything over gives its input back, which is measured once.

    ``between`` should write what it is given and read it again: measures then take a table, not the chain once more.
    """
    result = run_chain(samples, rate, only, bypass, params, between, registry)
    names = [n for n in registry.names() if only is None or n in only]
    off = set(bypass or ())
    working = working_rate([registry.get(n) for n in names if n not in off], rate)
    before = measured(samples, rate, "in")
    if result.samples is samples:
        both = before.select("*", F.col("in_lufs").alias("out_lufs"), F.col("in_peak_db").alias("out_peak_db"))
    else:
        both = before.join(measured(result.samples, rate, "out"), "rec", "left")
    both = both.join(lengths(samples), "rec").withColumn("seconds", F.col("length") / rate)
    told = [(n, n not in off, {**registry.get(n).defaults, **(params or {}).get(n, {})}) for n in names]
    return Run(result, both, told, rate, working)


def report_rows(made: Run) -> DataFrame:
    """stage, ord, rec, key, value: the stages' own rows, and those of the run as a stage named chain before them."""
    own = made.measures.withColumn("resampled", F.lit(int(made.working != made.rate))).withColumn("working_rate", F.lit(made.working))
    keys = ("resampled", "working_rate", "seconds", "in_lufs", "in_peak_db", "out_lufs", "out_peak_db")
    pairs = F.array(*[F.struct(F.lit(k).alias("key"), F.col(k).cast("string").alias("value")) for k in keys])
    return own.select(F.lit("chain").alias("stage"), F.lit(-1).alias("ord"), "rec", F.inline(pairs)).unionByName(made.result.report)


def _finite(c: Column) -> Column:
    """A number that JSON can hold, else null."""
    return F.when((F.abs(c) < float("inf")) & ~F.isnan(c), c)


def json_reports(made: Run, channels: int = 1) -> DataFrame:
    """rec, json: one document a recording, its stages in order, passed-over ones without a report. What is not finite is null."""
    facts = made.result.report.groupBy("rec").pivot("stage", [n for n, on, _ in made.stages if on] or ["none"]).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("key", "value")))))
    rows = made.measures.join(facts, "rec", "left")
    side = lambda p: F.struct(_finite(F.col(f"{p}_lufs")).alias("integratedLufs"), _finite(F.col(f"{p}_peak_db")).alias("peakDbfs"))
    none = F.lit(None).cast("map<string,string>")
    stages = [
        F.struct(F.lit(n).alias("name"), F.lit(on).alias("enabled"), F.map_from_arrays(F.array(*[F.lit(k) for k in p]), F.array(*[F.lit(json.dumps(v)) for v in p.values()])).alias("params"), (F.col(n) if on else none).alias("report"))
        for n, on, p in made.stages
    ]
    document = F.struct(
        F.lit(made.rate).alias("sourceSampleRate"), F.lit(made.working).alias("workingSampleRate"), F.lit(channels).alias("channels"), F.col("seconds").alias("durationSec"),
        F.lit(made.working != made.rate).alias("resampled"), side("in").alias("input"), side("out").alias("output"),
        F.array(*stages).alias("stages"), F.array(*[F.lit(name) for name in made.result.extras]).cast("array<string>").alias("extras"),
    )
    return rows.select("rec", F.to_json(document, {"ignoreNullFields": "false", "pretty": "true"}).alias("json"))


def text_reports(made: Run, channels: int = 1) -> DataFrame:
    """rec, text: the report for a reader, a line for the recording, its levels and each stage."""
    number = lambda c, unit: F.when(_finite(F.col(c)).isNull(), f"-inf {unit}").otherwise(F.format_string(f"%.1f {unit}", F.col(c)))
    kind = "Mono" if channels == 1 else f"{channels} ch"
    ran = f" (chain ran at {made.working:g} Hz)" if made.working != made.rate else ""
    level = lambda name, p: F.concat(F.lit(name), number(f"{p}_lufs", "LUFS"), F.lit(", peak "), number(f"{p}_peak_db", "dBFS"))
    lines = [
        F.concat(F.lit(f"{kind} · {made.rate:g} Hz · "), F.format_string("%.1fs", "seconds"), F.lit(ran)),
        level("Input:  ", "in"), level("Output: ", "out"), F.lit("\nChain:"),
        *[F.lit(f"  {n}" if on else f"  {n}  — bypassed") for n, on, _ in made.stages],
    ]
    levelled = [on for n, on, _ in made.stages if n == "level"]
    rows = made.measures
    if levelled == [True]:
        facts = made.result.report.where("stage = 'level'").groupBy("rec").pivot("key", ["threshold", "floor", "segments", "limiter_gain"]).agg(F.first("value"))
        rows = rows.join(facts, "rec", "left")
        value = lambda k: F.format_string("%.1f", F.col(k).cast("double"))
        cut = -db(F.col("limiter_gain").cast("double"))
        count = F.col("segments").cast("bigint")
        lines += [
            F.concat(F.lit("\nSilence threshold: "), value("threshold"), F.lit(" LUFS (floor "), value("floor"), F.lit(")")),
            F.concat(F.lit("Detected "), F.col("segments"), F.when(count == 1, " segment").otherwise(" segments")),
            F.when(cut > 0.01, F.concat(F.lit("Limiter engaged: up to "), F.format_string("%.1f", cut), F.lit(" dB reduction"))),
        ]
    return rows.select("rec", F.concat_ws("\n", *lines).alias("text"))
