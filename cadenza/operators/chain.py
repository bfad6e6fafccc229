"""Chains of stages as tables: order, parameters, backends, bounds and baselines."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def plan_chain(stages: DataFrame, only: DataFrame | None = None, bypass: DataFrame | None = None) -> DataFrame:
    """ord, name, enabled: the stages (ord, name) that ``only`` (name) keeps, in their own order; ``bypass`` (name) turns
    stages off. A name that no stage has stops the job."""
    for named in (only, bypass):
        if named is not None:
            unknown = named.join(stages, "name", "left_anti").agg(F.concat_ws(", ", F.sort_array(F.collect_list("name"))).alias("names"))
            told = F.when(F.col("names") != "", F.raise_error(F.concat(F.lit("unknown stage: "), F.col("names"))).cast("boolean"))
            stages = stages.crossJoin(unknown.select(told.alias("__ok"))).where("__ok IS NULL").drop("__ok")
    kept = stages.join(only, "name", "left_semi") if only is not None else stages
    if bypass is None:
        return kept.select("ord", "name", F.lit(True).alias("enabled"))
    off = bypass.select("name", F.lit(True).alias("off")).distinct()
    return kept.join(off, "name", "left").select("ord", "name", F.col("off").isNull().alias("enabled"))


def merge_params(defaults: DataFrame, overrides: DataFrame) -> DataFrame:
    """stage, key, value, edited: defaults (stage, key, value), replaced where overrides has the key."""
    over = overrides.select("stage", "key", F.col("value").alias("over"))
    joined = defaults.join(over, ["stage", "key"], "left")
    return joined.select("stage", "key", F.coalesce("over", "value").alias("value"), (F.col("over").isNotNull() & ~F.col("over").eqNullSafe(F.col("value"))).alias("edited"))


def resolve_backend(preferences: DataFrame, backends: DataFrame) -> DataFrame:
    """request, chosen, skipped: the first preference (request, ord, name) whose backend (name, available, reason) runs, and
    those passed over before it with their reasons."""
    known = preferences.join(backends, "name", "left").withColumn("runs", F.coalesce("available", F.lit(False)))
    first = known.where("runs").groupBy("request").agg(F.min(F.struct("ord", "name")).alias("f"))
    joined = known.join(first, "request", "left").withColumn("before", F.col("f").isNull() | (F.col("ord") < F.col("f.ord")))
    reason = F.concat(F.col("name"), F.lit(": "), F.coalesce("reason", F.lit("unknown backend")))
    lists = joined.groupBy("request").agg(F.max("f.name").alias("chosen"), F.array_sort(F.collect_list(F.when(F.col("before"), F.struct("ord", reason.alias("r"))))).alias("s"))
    return lists.select("request", "chosen", F.array_join(F.col("s.r"), "; ").alias("skipped"))


def check_bounds(metrics: DataFrame, expectations: DataFrame) -> DataFrame:
    """Expectations (case, metric, lo, hi) with the value and whether it is inside; a missing value is outside."""
    joined = expectations.join(metrics, ["case", "metric"], "left")
    inside = (F.col("lo").isNull() | (F.col("value") >= F.col("lo"))) & (F.col("hi").isNull() | (F.col("value") <= F.col("hi")))
    return joined.select("case", "metric", "value", (F.col("value").isNotNull() & F.coalesce(inside, F.lit(False))).alias("ok"))


def baseline_diff(run: DataFrame, baseline: DataFrame, least: float = 0.05) -> DataFrame:
    """case, metric, was, now, state: metrics that moved by more than ``least``, and cases that the baseline lacks."""
    base = baseline.select("case", "metric", F.col("value").alias("was"))
    cases = base.select("case", F.lit(True).alias("known")).distinct()
    joined = run.join(base, ["case", "metric"], "left").join(cases, "case", "left")
    state = F.when(F.col("known").isNull(), "new case").when(F.abs(F.col("value") - F.col("was")) > least, "moved")
    return joined.select("case", "metric", "was", F.col("value").alias("now"), state.alias("state")).where("state IS NOT NULL")
