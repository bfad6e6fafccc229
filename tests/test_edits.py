"""Session and edit rules that SQL does not show."""

import pytest
from pyspark.sql import functions as F

from cadenza.operators import chain, edit, islands, sessions
from cadenza.plans import analyzer
from cadenza.sources import layout


def test_session_errors(spark):
    windows = spark.createDataFrame([(1, 0.0, 8.0)], "window int, start double, dur double")
    variants = lambda *rows: spark.createDataFrame(rows, "window int, ord int, variant string, file string")
    good = sessions.plan_trials(windows, variants((1, 0, "a", "fa"), (1, 1, "b", "fb")), 4).collect()
    assert sorted(r.label for r in good) == ["A", "B"] and {r.trial for r in good} == {"t01"}
    with pytest.raises(Exception, match="no window"):
        sessions.plan_trials(windows, variants((2, 0, "a", "fa"), (2, 1, "b", "fb")), 4).collect()
    with pytest.raises(Exception, match="bad size"):
        sessions.plan_trials(windows, variants((1, 0, "a", "fa")), 4).collect()
    clips = spark.createDataFrame([("a", -30.0, -3.0), ("b", None, None)], "clip string, lufs double, peak_db double")
    assert {r.clip: r.gain_db for r in sessions.match_gains(clips, -28.0).collect()} == {"a": 2.0, "b": 0.0}
    with pytest.raises(Exception, match="peak over"):
        sessions.match_gains(clips, -20.0).collect()
    trials = lambda *rows: spark.createDataFrame(rows, "trial string, variant string")
    same = sessions.same_variants(trials(("t", "a"), ("t", "b"), ("u", "a")), trials(("t", "b"), ("t", "a"), ("u", "b"), ("v", "a")))
    assert {r.trial: r.same for r in same.collect()} == {"t": True, "u": False, "v": False}


def test_chain_names(spark):
    stages = spark.createDataFrame([(0, "a"), (1, "b")], "ord int, name string")
    wrong = spark.createDataFrame([("c",)], "name string")
    with pytest.raises(Exception, match="unknown stage: c"):
        chain.plan_chain(stages, bypass=wrong).collect()


def test_numbering_and_halo(spark):
    rows = spark.range(1000).select(F.lit("a").alias("rec"), (F.col("id") * 7 % 1000).alias("t"))
    numbered = layout.number_rows(rows, "rec", ["t"], F.floor(F.col("t") / 90))
    assert numbered.where("n <> t").count() == 0
    x = numbered.select("rec", "n", F.col("n").cast("double").alias("x"))
    halo = layout.with_halo(x, 3, 5, 64)
    assert halo.where("core").count() == 1000
    sizes = {r.chunk: r["count"] for r in halo.groupBy("chunk").count().collect()}
    assert sizes[0] == 64 + 5 and sizes[3] == 64 + 8 and len(sizes) == 16


def test_runs_across_chunks(spark):
    frames = spark.createDataFrame([("a", i) for i in (*range(5, 40), 50, 51, *range(60, 70))], "rec string, f bigint")
    got = sorted((r["first"], r["last"]) for r in islands.runs(frames, "f", chunk=8).collect())
    assert got == [(5, 39), (50, 51), (60, 69)]
    size = spark.createDataFrame([("a", 100), ("b", 7)], "rec string, length bigint")
    spans = spark.createDataFrame([("a", 0, 10), ("a", 90, 100)], "rec string, start bigint, end bigint")
    assert sorted((r.rec, r.start, r.end) for r in islands.complement(spans, size).collect()) == [("a", 10, 90), ("b", 0, 7)]


def test_silent_recording(spark):
    rows = spark.range(200).select(F.lit("a").alias("rec"), F.col("id").alias("n"), F.lit(0.0).alias("x"))
    a = analyzer.Analyzer(rows)
    assert [(r.start, r.end) for r in a.silences.collect()] == [(0, 200)]
    assert all(r.filled_db == 0.0 for r in a.gains.collect())
    a.release()
    assert edit.cut(rows, 190, 50).count() == 10
