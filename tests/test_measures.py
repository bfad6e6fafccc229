"""Ranks, residuals at sites, 8-bit samples and the room tone's bed against direct computations."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from cadenza.functions.num import floor_rank, nearest_rank
from cadenza.operators import metrics, ranks, roomtone
from cadenza.sources import pcm


def test_ranks(spark):
    r = np.random.default_rng(0)
    told = {"a": np.round(r.normal(size=500) * 20, 2), "b": np.full(40, -3.25), "c": np.array([7.0]), "d": np.array([])}
    rows = [(rec, float(v)) for rec, values in told.items() for v in values] + [("d", None), ("a", None)]
    values = spark.createDataFrame(rows, "rec string, v double").repartition(5)
    asked = {"p10": lambda n: nearest_rank(n, 10), "p50": lambda n: nearest_rank(n, 50), "top": lambda n: floor_rank(n, 0.95)}
    got = {r.rec: (r.n, r.p10, r.p50, r.top) for r in ranks.at_ranks(values, asked).collect()}
    assert got.pop("d") == (0, None, None, None)
    for rec, found in got.items():
        v = np.sort(told[rec])
        n = len(v)
        assert found == (n, v[int(np.floor(0.1 * (n - 1) + 0.5))], v[int(np.floor(0.5 * (n - 1) + 0.5))], v[min(n - 1, int(n * 0.95))])
    assert set(got) == {"a", "b", "c"} and ranks.at_ranks(values.limit(0), asked).count() == 0


def test_residual_at_sites(spark):
    r = np.random.default_rng(1)
    s = r.normal(size=3000) * 0.1
    s[1000:1200] = 0.0
    x = 0.5 * s
    x[500] += 0.2
    x[1100] += 0.01
    table = lambda v: spark.createDataFrame([("a", i, float(y)) for i, y in enumerate(v)] + [("silent", 0, 0.0)], "rec string, n bigint, x double")
    sites = spark.createDataFrame([("a", 498), ("a", 498), ("a", 1099), ("a", 2990), ("silent", 0)], "rec string, site bigint")
    got = {row.site: row.ratio_db for row in metrics.residual_at(table(s), table(x), sites, 3, 40).collect()}
    a, level = float(x @ s / (s @ s)), float(np.sqrt((s**2).mean()))
    off = np.abs(x - a * s)
    want = {n: 20 * np.log10(off[n - 8 : n + 11].max() / a / max(np.abs(s[n - 40 : n + 40]).max(), 0.02 * level)) for n in (498, 1099, 2990)}
    assert got == pytest.approx(want)


def test_decode8(spark):
    texts = {1: "abc", 2: "Ü€", 3: "", 4: None}
    rows = spark.createDataFrame(list(texts.items()), "id int, text string")
    got = {}
    for row in pcm.decode8(rows, "id", "text").orderBy("id", "n").collect():
        got.setdefault(row.id, []).append(row.x)
    assert got == {k: [(b - 128) / 128 for b in t.encode()] for k, t in texts.items() if t}


def test_bed_is_the_same_in_any_cells(spark):
    x = np.random.default_rng(2).normal(size=900) * 0.01
    samples = spark.createDataFrame([("a", i, float(v)) for i, v in enumerate(x)], "rec string, n bigint, x double")
    clips = spark.createDataFrame([("a", 0, 10, 70, 1.0), ("a", 1, 400, 431, 2.0), ("a", 2, 800, 850, 1.5)], "rec string, i bigint, start bigint, end bigint, score double")
    whole = {r.n: r.x for r in roomtone.bed(samples, clips, 400, 6, 8).collect()}
    cut = {r.n: r.x for r in roomtone.bed(samples, clips, 400, 6, 8, chunk=16).collect()}
    assert sorted(whole) == list(range(len(whole))) and len(whole) >= 400 and cut == pytest.approx(whole)
    assert whole[30] == pytest.approx(x[40])
    assert roomtone.bed(samples, clips.where(F.lit(False)), 400, 6, 8).count() == 0
