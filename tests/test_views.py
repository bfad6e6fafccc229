"""Pyramids, views and ranges against the samples; long impulse responses against direct convolution; rooms."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from cadenza.operators import transforms, views
from cadenza.plans import evaluation
from cadenza.plans.stages import programme
from cadenza.sources import layout, synthetic


@pytest.fixture(scope="module")
def signals():
    r = np.random.default_rng(1)
    return {"a": r.normal(size=1000) * 0.3, "b": r.normal(size=37)}


@pytest.fixture(scope="module")
def table(spark, signals):
    return spark.createDataFrame([(k, i, float(v)) for k, x in signals.items() for i, v in enumerate(x)], "rec string, n bigint, x double").repartition(3).cache()


def test_pyramid_and_ranges(spark, table, signals):
    blocks = views.pyramid(table, 4, 8).cache()
    levels = {(r.rec, r.level): r.n for r in blocks.groupBy("rec", "level").agg(F.count("b").alias("n")).collect()}
    assert levels == {**{("a", k): -(-250 // 2**k) for k in range(6)}, ("b", 0): 10, ("b", 1): 5}
    ranges = [("a", s, e) for s, e in ((0, 1000), (3, 997), (5, 6), (8, 8), (8, 12), (9, 11), (250, 900), (990, 5000), (2000, 2001))] + [("b", 1, 36), ("c", 0, 9)]
    frame = spark.createDataFrame([*ranges, ranges[0]], "rec string, start bigint, end bigint")
    got = {(r.rec, r.start, r.end): (r.lo, r.hi) for r in views.range_peaks(blocks, table, frame, 4).collect()}
    for rec, s, e in ranges:
        x = signals.get(rec, np.zeros(0))[s:e]
        assert got[rec, s, e] == ((x.min(), x.max()) if len(x) else (None, None))
    cover = spark.createDataFrame([("a", 3, 997, 5)], "rec string, start bigint, end bigint, top int").select(F.concat(*[views._cover(k, F.col("top"), 4) for k in range(views.LEVELS)]).alias("c")).first()["c"]
    assert len(cover) <= 2 * 5 + 8 and sum(4 << c.level for c in cover) >= 988


def test_columns_past_the_end_and_loud_samples(spark, table):
    loud = spark.createDataFrame([("a", i, 3.0) for i in range(10)], "rec string, n bigint, x double")
    asked = spark.createDataFrame([("v", "a", 0, 2.0, 8)], "view string, rec string, start bigint, spp double, width int")
    got = {r.column: (r.lo, r.hi) for r in views.view(views.pyramid(loud, 4, 8), loud, asked, 4).collect()}
    assert got == {i: ((1.0, 3.0) if i < 5 else (0.0, 0.0)) for i in range(8)}


@pytest.mark.parametrize("length", [1, 16, 50, 900, 1500])
def test_long_impulse_responses(table, signals, length):
    h = np.random.default_rng(2).normal(size=length)
    got = transforms.convolved(table, h, 16).toPandas().sort_values(["rec", "n"])
    for rec, x in signals.items():
        mine = got[got["rec"] == rec]
        assert mine["n"].tolist() == list(range(len(x)))
        assert np.abs(mine["x"].to_numpy() - np.convolve(x, h)[: len(x)]).max() < 1e-9


@pytest.mark.parametrize("length", [1, 40, 48, 300, 1500])
def test_rows_of_several_blocks(table, signals, length):
    h = np.random.default_rng(3).normal(size=length)
    got = transforms.convolved_in_parts(table, h, 16, row=50).toPandas().sort_values(["rec", "n"])
    for rec, x in signals.items():
        mine = got[got["rec"] == rec]
        assert mine["n"].tolist() == list(range(len(x)))
        assert np.abs(mine["x"].to_numpy() - np.convolve(x, h)[: len(x)]).max() < 1e-9


def test_short_blocks_are_not_dealt_out_one_by_one(table, monkeypatch):
    sizes = []
    monkeypatch.setattr(transforms, "packed", lambda samples, before, after, chunk: sizes.append(chunk) or layout.packed(samples, before, after, chunk))
    assert transforms.convolved_in_parts(table, np.ones(300), 64).count() == 1037
    assert sizes == [layout.CHUNK]


def test_a_room_keeps_the_loudness(spark):
    rate = 8000.0
    tone = synthetic.sine(spark, "t", 24_000, 220.0, rate, 0.2)
    response = synthetic.room_response(rate, 0.5, 4.0, 1)
    assert response[0] == 1.0 and not response[1:96].any() and 10 * np.log10(1 / (response[1:] ** 2).sum()) == pytest.approx(4.0)
    wet = evaluation.in_room(tone, rate, response, 2048)
    before, after = (programme(s, rate).first()["lufs"] for s in (tone, wet))
    assert after == pytest.approx(before, abs=0.01) and wet.count() == 24_000
