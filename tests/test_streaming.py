"""Stateful streams against their batch operators, with rows out of order, late rows and batches of any size."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from cadenza.functions import filters
from cadenza.operators import envelope, islands, recurrences
from cadenza.streaming import stateful

SCHEMA = "rec string, ts timestamp, n bigint, x double"
START = dt.datetime(2024, 1, 1)


@pytest.fixture(scope="module", autouse=True)
def store(spark):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", stateful.STORE)
    yield
    spark.conf.unset("spark.sql.streaming.stateStore.providerClass")


def rows_of(rec, x):
    return [(rec, START + dt.timedelta(milliseconds=10 * i), i, float(v)) for i, v in enumerate(x)]


@pytest.fixture(scope="module")
def signals():
    r = np.random.default_rng(3)
    loud = np.repeat(r.random(12) < 0.5, 50)
    return {"a": r.normal(size=600) * np.where(loud, 1.0, 0.001), "b": r.normal(size=450) * 0.5}


def played(spark, folder, signals, query, name):
    """What a stream gives out over files of some seconds, shuffled across neighbouring files, and an end far off."""
    r = np.random.default_rng(9)
    rows = [x for rec, v in signals.items() for x in rows_of(rec, v)]
    rows.sort(key=lambda x: x[2] + r.uniform(0, 150))  # up to 1.5 s out of order
    batches = np.array_split(np.arange(len(rows)), 3)
    source, done = str(folder / "in"), [("end", START + dt.timedelta(seconds=s), 0, 9.0) for s in (60, 120)]
    (folder / "in").mkdir()
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(source)
    out = None
    for i, batch in enumerate([[rows[k] for k in b] for b in batches] + [[done[0]], [("a", START, 5, 77.0), done[1]]]):
        spark.createDataFrame(batch, SCHEMA).coalesce(1).write.mode("append").parquet(source)
        out = query(stream).writeStream.format("parquet").option("path", str(folder / name)).option("checkpointLocation", str(folder / f"{name}-state")).trigger(availableNow=True).start()
        out.awaitTermination(120)
        assert out.exception() is None, i
    return spark.read.parquet(str(folder / name)).where("rec <> 'end'")


def test_filters(spark, tmp_path, signals):
    chain = [*filters.k_weighting(48000), filters.peaking(1000, 6, 1, 48000)]
    got = played(spark, tmp_path, signals, lambda s: stateful.filtered(s, chain), "y").toPandas().sort_values(["rec", "n"])
    for rec, x in signals.items():
        mine = got[got["rec"] == rec]
        assert mine["n"].tolist() == list(range(len(x)))
        assert np.abs(mine["x"].to_numpy() - recurrences.cascade(x, chain)).max() < 1e-10


def test_limiter(spark, tmp_path, signals):
    got = played(spark, tmp_path, signals, lambda s: stateful.limiter(s, 0.3, 0.95, 0.7), "g").toPandas().sort_values(["rec", "n"])
    table = spark.createDataFrame([x for rec, v in signals.items() for x in rows_of(rec, v)], SCHEMA)
    required = table.select("rec", "n", F.least(F.lit(1.0), 0.3 / F.greatest(F.abs("x"), F.lit(1e-9))).alias("x"))
    want = envelope.backward_ramp(recurrences.limiter_gain(required, 0.95), 0.7, 120, 1 << 12).toPandas().sort_values(["rec", "n"])
    assert got["n"].tolist() == want["n"].tolist() and np.abs(got["gain"].to_numpy() - want["gain"].to_numpy()).max() < 1e-12


def test_silences(spark, tmp_path, signals):
    got = played(spark, tmp_path, signals, lambda s: stateful.silences(s, 0.01, 30), "q").collect()
    table = spark.createDataFrame([x for rec, v in signals.items() for x in rows_of(rec, v)], SCHEMA)
    want = islands.runs(table.where(F.abs("x") <= 0.01), "n").where("last - first >= 29").collect()
    assert {(r.rec, r.start, r.end) for r in got} == {(r.rec, r.first, r.last + 1) for r in want} and len(got) == len(want) > 2


def test_silence_kernel_in_any_cuts():
    """The kernel's state carries runs over cuts, also over empty pieces."""
    x = np.array([0, 0, 9, 0, 0, 0, 9, 9, 0, 0], dtype=float)
    found = {}
    stateful.in_order, kept = (lambda s, kernel, *_: kernel), stateful.in_order
    try:
        kernel = stateful.silences(None, 1.0, 2)
    finally:
        stateful.in_order = kept
    for cuts in ([], [1], [2, 3], [5, 5, 6], list(range(10))):
        state, got = None, []
        pieces = np.split(np.arange(10), cuts)
        for k, n in enumerate(pieces):
            state, out = kernel(state, n, x[n], k == len(pieces) - 1)
            got += list(zip(out["start"].tolist(), out["end"].tolist(), strict=True))
        found[tuple(cuts)] = got
    assert all(v == [(0, 2), (3, 6), (8, 10)] for v in found.values()), found
