"""Late reverberation by summed normal equations: chunks of any size against one loop over the whole recording."""

import numpy as np
import pytest

from cadenza.operators import dereverb, linear, longterm
from cadenza.operators.transforms import istft, stft

SIZE, HOP, TAPS, DELAY = 64, 16, 4, 2


def plain(y, taps, delay, iterations=3, regularisation=1e-4):
    """One bin, frame by frame."""
    n = len(y)
    mean = sum(abs(v) ** 2 for v in y) / n
    if n <= taps + delay + 2 or mean <= 0:
        return y
    out = y.copy()
    for _ in range(iterations):
        matrix, right = np.eye(taps, dtype=complex) * mean * regularisation * n, np.zeros(taps, dtype=complex)
        for t in range(delay + taps, n):
            past = np.array([y[t - delay - i] for i in range(taps)])
            weight = 1 / max(abs(out[t]) ** 2, mean * 1e-3)
            matrix += weight * np.outer(past, past.conj())
            right += weight * past * np.conj(y[t])
        g = np.linalg.solve(matrix, right)
        out = y.copy()
        for t in range(delay + taps, n):
            out[t] -= np.conj(g) @ np.array([y[t - delay - i] for i in range(taps)])
    return out


def reverberant(seed, n):
    r = np.random.default_rng(seed)
    dry = r.normal(size=n) * (r.random(n // 50 + 1).repeat(50)[:n] < 0.4)
    tail = r.normal(size=400) * np.exp(-np.arange(400) / 80.0)
    tail[0] = 3.0
    return dry, np.convolve(dry, tail)[:n]


@pytest.fixture(scope="module")
def recordings():
    return {"a": reverberant(1, 3000)[1], "b": reverberant(2, 1111)[1], "short": reverberant(3, 40)[1], "silent": np.zeros(500)}


@pytest.mark.parametrize("chunk", [192, 512, 1 << 16])
def test_chunks_of_any_size_equal_the_whole(spark, recordings, chunk):
    rows = [(r, i, float(v)) for r, x in recordings.items() for i, v in enumerate(x)]
    table = spark.createDataFrame(rows, "rec string, n bigint, x double").repartition(3)
    got = dereverb.dereverberated(table, SIZE, HOP, TAPS, DELAY, chunk=chunk).toPandas().sort_values(["rec", "n"])
    for rec, x in recordings.items():
        y = stft(x, SIZE, HOP)
        want = istft(np.stack([plain(b, TAPS, DELAY) for b in y.T], axis=1), SIZE, HOP, len(x))
        mine = got[got["rec"] == rec]
        assert mine["n"].tolist() == list(range(len(x)))
        assert np.abs(mine["x"].to_numpy() - want).max() < 1e-8


@pytest.mark.parametrize("chunk", [6, 40, 1000])
def test_cells(spark, chunk):
    r = np.random.default_rng(5)
    y = r.normal(size=(90, 3)) + 1j * r.normal(size=(90, 3))
    rows = [("a", k, f, float(y[f, k].real), float(y[f, k].imag)) for f in range(90) for k in range(3)]
    cells = spark.createDataFrame(rows, "rec string, k int, f bigint, re double, im double").repartition(3)
    got = dereverb.dereverberated_cells(cells, 3, TAPS, DELAY, chunk=chunk).toPandas().sort_values(["f", "k"])
    want = np.stack([plain(b, TAPS, DELAY) for b in y.T], axis=1)
    assert np.abs((got["re"] + 1j * got["im"]).to_numpy().reshape(90, 3) - want).max() < 1e-9
    assert np.abs(dereverb.predicted_away(y, TAPS, DELAY) - want).max() < 1e-9


def test_the_tail_goes_and_the_source_stays():
    dry, wet = reverberant(7, 40_000)
    share = lambda x: x @ dry / np.sqrt((x @ x) * (dry @ dry))
    clean = lambda delay: istft(dereverb.predicted_away(stft(wet, 128, 32), 12, delay), 128, 32, len(wet))
    assert share(clean(4)) > share(wet) > share(clean(0))


def test_settings_meet_chunks_and_not_samples(spark):
    """A long setting costs a chunk's row, and each chunk has its own recording's."""
    rows = [(r, i, float(i)) for r in "ab" for i in range(100)]
    table = spark.createDataFrame(rows, "rec string, n bigint, x double").repartition(3)
    settings = spark.createDataFrame([("a", [2.0] * 500), ("b", [3.0] * 500)], "rec string, profile array<double>")
    out = longterm.by_recording(table, settings, lambda x, own: x * own["profile"][499], 3, 0, 16)
    assert {(r.rec, r.n, r.x) for r in out.collect()} == {(r, i, i * (2.0 if r == "a" else 3.0)) for r in "ab" for i in range(100)}
    plan = out._jdf.queryExecution().toString()
    assert "MapInPandas" in plan


def test_repairs_in_any_chunks(spark):
    x = np.sin(np.arange(4000) * 0.05) + 0.01 * np.random.default_rng(1).normal(size=4000)
    bursts = [("a", s, s + 5) for s in (100, 1023, 2047, 3500)]
    for _, s, e in bursts:
        x[s:e] += 3.0
    table = spark.createDataFrame([("a", i, float(v)) for i, v in enumerate(x)], "rec string, n bigint, x double").repartition(3)
    found = spark.createDataFrame(bursts, "rec string, start bigint, end bigint")
    a, b = (linear.repaired(table, found, 8, 48, c).toPandas().sort_values("n")["x"].to_numpy() for c in (256, 1 << 14))
    assert len(a) == 4000 and np.abs(a - b).max() < 1e-9 and np.abs(a[95:110]).max() < 1.2
