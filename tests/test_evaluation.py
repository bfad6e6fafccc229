"""Made talk, and the evaluation cases with their bounds."""

import pytest
from pyspark.sql import functions as F

from cadenza.plans import evaluation
from cadenza.sources import speech


def test_talk(spark):
    samples, bounds = speech.talk(spark, "a", 8000.0, [(0.5, -20.0, 110.0), (0.75, -30.0, 130.0)], 0.25, -60.0, 7)
    assert [(r.start, r.end) for r in bounds.orderBy("i").collect()] == [(2000, 6000), (8000, 14000)]
    assert samples.count() == 16_000
    from cadenza.operators.loudness import range_loudness

    level = {r.i: r.db for r in range_loudness(samples, bounds).withColumn("db", 10 * F.log10("z")).collect()}
    assert level == pytest.approx({0: -20.0, 1: -30.0}, abs=0.1)
    quiet = range_loudness(samples, evaluation.pauses_of(samples, bounds).withColumn("i", F.col("start"))).collect()
    assert len(quiet) == 3 and all(r.z == pytest.approx(1e-6, rel=0.1) for r in quiet)
    again = speech.spurt(8000.0, 0.5, 110.0, 7)
    assert (again == speech.spurt(8000.0, 0.5, 110.0, 7)).all()


def test_cases(spark, tmp_path):
    def keep(df, name):
        df.write.mode("overwrite").parquet(str(tmp_path / name))
        return df.sparkSession.read.parquet(str(tmp_path / name))

    _, checks = evaluation.run_cases(spark, keep)
    rows = checks.collect()
    assert {(r.case, r.metric) for r in rows} >= {("drift", "out_lufs"), ("clicky", "si_sdr_gain_db")}
    assert [(r.case, r.metric, r.value) for r in rows if not r.ok] == []
