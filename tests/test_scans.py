"""Scans against loops over samples: any chunk size, level stretches, instant arms, several levels of the tree."""

import numpy as np
import pytest

from cadenza.operators import recurrences, scans


def signals(low, high, n):
    rng = np.random.default_rng(n)
    noise = low + (high - low) * rng.random(n)
    return [noise, np.repeat(noise[: n // 20 + 1], 20)[:n], np.full(n, low + 0.3 * (high - low)), np.where(rng.random(n) < 0.9, high, noise)]


def scan(law, x, size, start, lo, hi):
    """The law over pieces of ``size``, and the state that the composed map gives after all of them."""
    out, state, whole = [], start, None
    for i in range(0, len(x), size):
        piece = x[i : i + size]
        m = law.summary(piece, lo, hi)
        out.append(law.run(piece, state, lo, hi))
        state = law.after(m, state)
        whole = m if whole is None else law.compose(whole, m)
    return np.concatenate(out), law.after(whole, start)


@pytest.mark.parametrize("n,size", [(1, 7), (50, 7), (1000, 33), (5000, 700)])
def test_smoother(n, size):
    for down, up in ((0.5, 0.95), (0.95, 0.5), (0.0, 0.9), (0.9, 0.0), (0.9995, 0.9999), (0.999, 0.999)):
        for t in signals(-12.0, 0.0, n):
            want = recurrences.smooth_gain(t, down, up)
            got, end = scan(scans.Smoother(down, up), t, size, 0.0, min(0.0, t.min()), max(0.0, t.max()))
            assert np.abs(got - want).max() < 1e-12
            assert abs(end - want[-1]) < 1e-12


@pytest.mark.parametrize("n,size", [(1, 7), (50, 7), (1000, 33), (5000, 700)])
def test_limiter(n, size):
    for release in (0.5, 0.9, 0.9996):
        for r in signals(0.0, 1.0, n):
            want = recurrences.limit_forward(r, release)
            got, end = scan(scans.Limiter(release), r, size, 0.0, 0.0, 1.0)
            assert np.abs(got - want).max() < 1e-12
            assert abs(1.0 - end - want[-1]) < 1e-12


def test_maps_over_many_time_constants_are_small():
    t = signals(-12.0, 0.0, 40000)[0]
    assert len(scans.Smoother(0.99, 0.999).summary(t, -12.0, 0.0)[0]) < 50


@pytest.mark.parametrize("chunk,levels", [(64, 1), (64, 0), (3, 2), (10000, 1)])
def test_tree(spark, chunk, levels):
    made = {"noise": signals(0.0, 1.0, 1500)[0], "level": np.full(1501, 0.25), "one": np.array([0.5])}
    rows = [(r, i, float(v)) for r, x in made.items() for i, v in enumerate(x)]
    table = spark.createDataFrame(rows, "rec string, n bigint, x double").repartition(3)
    for law, start, loop in ((scans.Limiter(0.99), 0.0, lambda x: recurrences.limit_forward(x, 0.99)), (scans.Smoother(0.9, 0.99), 0.0, lambda x: recurrences.smooth_gain(x, 0.9, 0.99))):
        got = scans.scanned(table, law, start, chunk=chunk, levels=levels).toPandas().sort_values("n")
        for rec, x in made.items():
            mine = got[got["rec"] == rec]
            assert mine["n"].tolist() == list(range(len(x)))
            assert np.abs(mine["x"].to_numpy() - loop(x)).max() < 1e-12


def test_empty(spark):
    empty = spark.createDataFrame([], "rec string, n bigint, x double")
    assert recurrences.smoothed(empty, 0.5, 0.9).count() == 0
    assert recurrences.limiter_gain(empty, 0.9).count() == 0
