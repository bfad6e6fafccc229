"""Working rates, measures and reports of a run; the metric bundle's segment windows against direct computation."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from cadenza.plans import bundle, runner, stages


def registry(*rates):
    made = stages.Registry()
    made.add(stages.Stage("gain", {"gain": 0.5}, lambda s, p, rate: stages.Result(s.withColumn("x", F.col("x") * p["gain"]), stages.facts(s.select("rec").distinct().withColumn("saw", F.lit(rate)), "saw"))))
    for r in rates:
        made.add(stages.Stage(f"fixed{r}", {}, lambda s, p, rate: stages.Result(s, stages.facts(s.select("rec").distinct().withColumn("saw", F.lit(rate)), "saw"), {"tone": s}), float(r)))
    return made


@pytest.fixture(scope="module")
def tone(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("r") / "tone")
    rows = [(rec, i, float(a * np.sin(i * 0.05))) for rec, a, n in (("a", 0.2, 8001), ("b", 0.05, 6000)) for i in range(n)]
    spark.createDataFrame(rows, "rec string, n bigint, x double").write.parquet(path)
    return spark.read.parquet(path)


@pytest.mark.parametrize("rate", [4000, 12000])
def test_working_rate(tone, rate):
    out = stages.run_chain(tone, 8000.0, registry=registry(rate))
    assert {(r.stage, float(r.value)) for r in out.report.collect()} == {("gain", float(rate)), (f"fixed{rate}", float(rate))}
    got = {r.rec: (r.n, r.m) for r in out.samples.groupBy("rec").agg(F.count("*").alias("n"), F.max("n").alias("m")).collect()}
    assert got == {"a": (8001, 8000), "b": (6000, 5999)}
    assert out.extras["tone"].count() >= 14_001
    back = out.samples.join(tone.withColumnRenamed("x", "y"), ["rec", "n"]).where("n BETWEEN 500 AND 5000")
    assert back.agg(F.max(F.abs(F.col("x") - 0.5 * F.col("y")))).first()[0] < 1e-3


def test_no_conversion_and_conflict(tone):
    out = stages.run_chain(tone, 8000.0, bypass=["fixed12000", "gain"], registry=registry(12000))
    assert out.samples is tone
    with pytest.raises(ValueError, match="disagree"):
        stages.run_chain(tone, 8000.0, registry=registry(12000, 16000))
    assert stages.run_chain(tone, 12000.0, only=["fixed12000"], registry=registry(12000)).samples is tone


def test_measures_and_reports(spark, tone):
    made = runner.run(tone, 8000.0, bypass=["fixed12000"], registry=registry(12000))
    for r in made.measures.collect():
        assert r.out_lufs == pytest.approx(r.in_lufs - 6.02, abs=0.01) and r.out_peak_db == pytest.approx(r.in_peak_db - 6.02, abs=0.01)
    document = {r.rec: json.loads(r.json) for r in runner.json_reports(made).collect()}["a"]
    assert [(s["name"], s["enabled"], s["report"]) for s in document["stages"]] == [("gain", True, {"saw": "8000.0"}), ("fixed12000", False, None)]
    assert not document["resampled"] and document["durationSec"] == pytest.approx(8001 / 8000)
    text = {r.rec: r.text for r in runner.text_reports(made).collect()}["a"]
    assert "Mono · 8000 Hz · 1.0s\nInput:  " in text and text.endswith("Chain:\n  gain\n  fixed12000  — bypassed")
    found = {(r.rec, r.metric): r.value for r in bundle.from_reports(bundle.report_documents(runner.report_rows(made))).collect()}
    assert found == {("a", "resampled"): 0.0, ("b", "resampled"): 0.0}


def test_silence_has_a_report(spark):
    quiet = spark.range(9000).select(F.lit("q").alias("rec"), F.col("id").alias("n"), F.lit(0.0).alias("x"))
    made = runner.run(quiet, 8000.0, registry=registry())
    told = json.loads(runner.json_reports(made).first()["json"])
    assert told["input"] == {"integratedLufs": None, "peakDbfs": None}
    assert "-inf LUFS, peak -inf dBFS" in runner.text_reports(made).first()["text"]


def gated(x, block, hop):
    z = np.array([np.mean(x[i : i + block] ** 2) for i in range(0, len(x) - block + 1, hop)])
    level = lambda v: -0.691 + 10 * np.log10(v)
    z = z[level(np.maximum(z, 1e-30)) >= -70]
    return level(z[level(z) >= level(z.mean()) - 10].mean())


def test_segment_windows(spark):
    r = np.random.default_rng(3)
    x = r.normal(size=20_000) * np.repeat([0.01, 0.1, 0.003, 0.3, 0.05], 4000)
    samples = spark.createDataFrame([("a", i, float(v)) for i, v in enumerate(x)], "rec string, n bigint, x double").repartition(4)
    spans = [(0, 4000, 8000), (1, 11_990, 16_000), (2, 16_100, 16_150)]
    segments = spark.createDataFrame([("a", *s) for s in spans] + [("none", 0, 0, 5)], "rec string, i bigint, start bigint, end bigint")
    scale = bundle.Scale(400, 100, 300, 500, 150, 50, 3, 80, lambda s: s)
    want = {i: gated(x[a + 300 : b - 300], 400, 100) for i, a, b in spans[:2]}
    got = {s.i: s.lufs for s in bundle.segment_levels(samples, segments, scale).collect()}
    assert got == pytest.approx(want, abs=1e-9)
    errors = {s.rec: s.value for s in bundle.segment_error(samples, segments, -18.0, scale).collect()}
    assert errors == pytest.approx({"a": max(abs(v + 18) for v in want.values()), "none": 0.0}, abs=1e-9)
    noise = {i: -0.691 + 10 * np.log10(np.mean(x[a - 200 : a - 50] ** 2)) for i, a, _ in spans[:2]}
    snr = bundle.segment_snr(samples, segments, scale).collect()
    assert [s.value for s in snr] == pytest.approx([np.median([want[i] - noise[i] for i in want])], abs=1e-9)


def test_bundle_keys(spark, tone):
    plain = bundle.bundle(tone, tone, bundle.Scale.of(8000.0), only={"inputPeakDbfs", "changeDb"}).collect()
    assert {(r.rec, r.metric) for r in plain} == {("a", "inputPeakDbfs"), ("b", "inputPeakDbfs")}
    with pytest.raises(ValueError, match="no metric lufsError"):
        bundle.bundle(tone, tone, bundle.Scale.of(8000.0), only={"lufsError"})
