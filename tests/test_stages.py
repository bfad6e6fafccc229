"""Stages on made material: what they decide, and that what they decline is untouched."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from cadenza.operators.loudness import integrated
from cadenza.plans import stages
from cadenza.sources import synthetic

RATE = 4000.0


@pytest.fixture(scope="module")
def speech(spark, tmp_path_factory):
    tone = lambda seconds, freq, amp: (synthetic.sine(spark, "t", int(seconds * RATE), freq, RATE, amp), int(seconds * RATE))
    hush = (synthetic.noise(spark, "t", int(1.5 * RATE), 3).withColumn("x", F.col("x") * 2e-4), int(1.5 * RATE))
    path = str(tmp_path_factory.mktemp("s") / "speech")
    synthetic.concat([tone(3, 220, 0.08), hush, tone(3, 440, 0.6)], "t").write.parquet(path)
    return spark.read.parquet(path)


@pytest.fixture
def keep(tmp_path):
    def write(df, name):
        df.write.parquet(str(tmp_path / name))
        return df.sparkSession.read.parquet(str(tmp_path / name))

    return write


def facts(result, name):
    return {(r.rec, r.key): r.value for r in result.report.where(F.col("stage") == name).collect()}


def test_level(speech, keep):
    out = stages.run_chain(speech, RATE, only=["level"], between=keep)
    told = facts(out, "level")
    assert told[("t", "segments")] == "2" and told[("t", "speech")] == "2"
    half = out.samples.withColumn("rec", F.when(F.col("n") < 3.75 * RATE, "a").otherwise("b"))
    for low, high in ((0, 3 * RATE), (4.5 * RATE, 7.5 * RATE)):
        part = half.where((F.col("n") >= low) & (F.col("n") < high)).withColumn("n", F.col("n") - int(low))
        from cadenza.operators.recurrences import k_weighted

        assert integrated(k_weighted(part, RATE), 1600, 400).first()["lufs"] == pytest.approx(-18.0, abs=1.0)
    assert out.samples.agg(F.max(F.abs("x"))).first()[0] <= 10 ** (-1 / 20) + 0.02
    tone = out.extras["roomtone"].agg(F.count("x"), F.max(F.abs("x"))).first()
    assert tone[0] >= 10 * RATE and tone[1] < 1e-3


def test_declined_recordings_are_untouched(speech, keep):
    out = stages.run_chain(speech, RATE, only=["denoise", "dereverb"], bypass=["dereverb"], between=keep)
    assert facts(out, "denoise")[("t", "acts")] == "false"
    both = speech.join(out.samples.withColumnRenamed("x", "y"), ["rec", "n"])
    assert both.count() == speech.count() and both.where("x <> y").count() == 0
    assert stages.run_chain(speech, RATE, bypass=stages.STAGES.names()).samples is speech


def test_dynamics(speech, keep):
    out = stages.run_chain(speech, RATE, only=["expand"], params={"expand": {"clean_floor": 90.0}}, between=keep)
    assert float(facts(out, "expand")[("t", "floor_distance")]) > 50
    clean = stages.run_chain(speech, RATE, only=["expand"], between=lambda df, name: keep(df, name + "-clean"))
    assert facts(clean, "expand")[("t", "acts")] == "false" and clean.samples.exceptAll(speech).count() == 0
    quiet = (F.col("n") > 3.5 * RATE) & (F.col("n") < 4.4 * RATE)
    level = lambda df: 10 * np.log10(df.where(quiet).agg(F.avg(F.col("x") * F.col("x"))).first()[0])
    assert level(out.samples) < level(speech) - 8
    assert 0 < float(facts(out, "expand")[("t", "max_reduction_db")]) <= 12.0


def test_declick(spark, speech, keep):
    places = spark.createDataFrame([("t", 5000), ("t", 20_000)], "rec string, site bigint")
    base = speech.withColumn("x", F.col("x") + 0.002 * F.sin(F.col("n") * F.col("n") % 97))
    clicked = keep(synthetic.with_clicks(base, places, 0.9, 3), "clicked")
    out = stages.run_chain(clicked, RATE, only=["declick"], params={"declick": {"max_burst": 0.003, "order": 16}}, between=keep)
    assert facts(out, "declick")[("t", "acts")] == "true"
    near = lambda df: df.join(places, "rec").where("abs(n - site) <= 4").join(base.withColumnRenamed("x", "y"), ["rec", "n"]).agg(F.max(F.abs(F.col("x") - F.col("y")))).first()[0]
    assert near(out.samples) < 0.5 * near(clicked)


def test_chain_errors(speech):
    with pytest.raises(ValueError, match="unknown stage"):
        stages.run_chain(speech, RATE, only=["nothing"])
    with pytest.raises(ValueError, match="no parameter"):
        stages.run_chain(speech, RATE, only=["level"], params={"level": {"loud": 1}})
    with pytest.raises(ValueError, match="already"):
        stages.STAGES.add(stages.STAGES.get("level"))
    assert stages.preset("acx")["params"]["level"]["target"] == -20.0
    with pytest.raises(ValueError):
        stages.preset("none")


@pytest.fixture(scope="module")
def voice(spark, tmp_path_factory):
    """Noise as speech with a bump at 1 kHz and rumble at 40 Hz, pauses of steady noise."""
    rate, r = 8000.0, np.random.default_rng(4)
    parts = []
    for k in range(3):
        n = int(3 * rate)
        t = np.arange(n) / rate
        spoken = 0.1 * r.standard_normal(n) * (0.6 + 0.4 * np.sin(2 * np.pi * 3 * t)) + 0.02 * np.sin(2 * np.pi * 40 * t)
        shape = np.fft.rfft(spoken)
        f = np.fft.rfftfreq(n, 1 / rate)
        shape *= 10 ** (9 * np.exp(-((np.log2(np.maximum(f, 1) / 1000) / 0.25) ** 2)) / 20)
        parts += [np.fft.irfft(shape, n), np.zeros(int(1.5 * rate))]
    x = np.concatenate(parts) + 0.004 * r.standard_normal(sum(map(len, parts)))
    path = str(tmp_path_factory.mktemp("v") / "voice")
    spark.createDataFrame([("v", i, float(v)) for i, v in enumerate(x)], "rec string, n bigint, x double").write.parquet(path)
    return spark.read.parquet(path), rate


def array_of(df):
    return np.array([r.x for r in df.orderBy("n").select("x").collect()])


def test_eq_takes_out_a_bump_and_rumble(voice, keep):
    samples, rate = voice
    out = stages.run_chain(samples, rate, only=["eq"], params={"eq": {"voicing": "neutral"}}, between=keep)
    told = facts(out, "eq")
    assert told[("v", "acts")] == "true" and told[("v", "rumble")] == "true" and int(told[("v", "band_count")]) >= 1
    before, after = array_of(samples), array_of(out.samples)
    f = np.fft.rfftfreq(len(before), 1 / rate)
    level = lambda x, a, b: 10 * np.log10((np.abs(np.fft.rfft(x))[(f >= a) & (f < b)] ** 2).mean())
    change = lambda a, b: level(after, a, b) - level(before, a, b)
    assert change(950, 1050) < change(600, 700) - 1.5 and change(36, 44) < -8 and abs(change(2500, 3500)) < 3.5


def test_denoise_by_profile(voice, keep):
    samples, rate = voice
    out = stages.run_chain(samples, rate, only=["denoise"], between=keep)
    told = facts(out, "denoise")
    assert told[("v", "acts")] == "true" and told[("v", "pauses")] == "true" and 0 < float(told[("v", "applied")]) <= 12
    before, after = array_of(samples), array_of(out.samples)
    pause = slice(int(3.3 * rate), int(4.3 * rate))
    lost = 10 * np.log10((before[pause] ** 2).mean() / (after[pause] ** 2).mean())
    assert abs(lost - float(told[("v", "applied")])) < 2.5
    speech = slice(int(1 * rate), int(2 * rate))
    assert abs(10 * np.log10((before[speech] ** 2).mean() / (after[speech] ** 2).mean())) < 1
