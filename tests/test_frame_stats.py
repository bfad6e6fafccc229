"""Figures out of frame kernels: the same at any chunk size as plain loops over one whole recording."""

import math

import numpy as np
import pytest

from cadenza.operators import frame_stats, transforms
from cadenza.plans import stages

RATE, SIZE, HOP = 1000.0, 32, 8


def wave(n, seed):
    r = np.random.default_rng(seed)
    t = np.arange(n)
    return 0.01 * r.standard_normal(n) + 0.4 * np.sin(2 * np.pi * 0.4 * t) * (np.sin(2 * np.pi * t / 700) > 0.5)


#: The denoiser's smallest chunk is 1264 samples: whole multiples of it, one more, and less than a frame.
LENGTHS = {"long": 5000, "whole": 2528, "even": 992, "over": 1265, "short": 20, "one": 1}


@pytest.fixture(scope="module")
def table(spark):
    rows = [(rec, i, float(v)) for k, (rec, n) in enumerate(LENGTHS.items()) for i, v in enumerate(wave(n, k))]
    return spark.createDataFrame(rows, "rec string, n bigint, x double").repartition(3)


def plain_dynamic_eq(x):
    power = np.abs(transforms.stft(x, SIZE, HOP)) ** 2
    down, up = math.exp(-HOP / (0.002 * RATE)), math.exp(-HOP / (0.06 * RATE))
    state, cells, held = [0.0] * power.shape[1], 0, []
    for frame in power:
        level = [10 * math.log10(p + 1e-30) for p in frame]
        for k in range(len(level)):
            hz = k * RATE / SIZE
            half = max(hz * (2**0.25 - 2**-0.25), 400.0) / 2
            low, high = max(1, math.floor((hz - half) * SIZE / RATE)), min(len(level) - 1, math.ceil((hz + half) * SIZE / RATE))
            around = level[low : high + 1]
            excess = level[k] - sum(around) / len(around) - 12.0 if hz >= 300 else -1.0
            target = -min(8.0, 0.5 * excess) if excess > 0 else 0.0
            state[k] = target + (state[k] - target) * (down if target < state[k] else up)
            cells += 1
            if state[k] < -0.01:
                held.append(-state[k])
    return max(held, default=0.0), sum(held) / len(held) if held else 0.0, len(held) / cells


def test_dynamic_eq(spark):
    waves = {"long": wave(9000, 1), "whole": wave(2 * 2272, 2), "over": wave(2273, 3), "short": wave(20, 4), "one": wave(1, 5)}
    samples = spark.createDataFrame([(rec, i, float(v)) for rec, x in waves.items() for i, v in enumerate(x)], "rec string, n bigint, x double").repartition(3)
    for chunk in (1, 4096, 1 << 16):
        rows = frame_stats.dynamic_eq(samples, RATE, SIZE, HOP, chunk)
        got = {r.rec: (r.max_reduction_db, r.mean_reduction_db, r.active) for r in frame_stats.dynamic_eq_report(rows).collect()}
        assert got.keys() == waves.keys()
        for rec, x in waves.items():
            assert got[rec] == pytest.approx(plain_dynamic_eq(x), abs=1e-9)
    assert got["long"][0] > 1 and 0 < got["long"][2] < 0.5
    assert rows.count() == len(waves) and frame_stats.dynamic_eq(samples, RATE, SIZE, HOP, 1).count() > len(waves)
    cells = {r.rec: r.cells for r in frame_stats.totals(frame_stats.dynamic_eq(samples, RATE, SIZE, HOP, 1), frame_stats.DYNAMIC_EQ).collect()}
    assert cells == {rec: ((len(x) + SIZE) // HOP + 1) * (SIZE // 2 + 1) for rec, x in waves.items()}
    heard = {(r.rec, r.n): r.x for r in frame_stats.signal(rows).collect()}
    same = {(r.rec, r.n): r.x for r in transforms.dynamic_eq(samples, RATE, SIZE, HOP).collect()}
    assert heard.keys() == same.keys() and max(abs(heard[k] - same[k]) for k in same) < 1e-12
    assert frame_stats.dynamic_eq(samples.limit(0), RATE, SIZE, HOP).count() == 0


def plain_denoise(x, noise, reduction):
    power = np.abs(transforms.stft(x, SIZE, HOP)) ** 2
    floor, clean, told = 10 ** (-reduction / 20), [0.0] * power.shape[1], {"low": [], "high": []}
    for frame in power:
        level = [n * 1.5 + 1e-20 for n in noise]
        prior = [0.98 * c / v + 0.02 * max(p / v - 1, 0) for c, v, p in zip(clean, level, frame, strict=True)]
        gain = [max(floor, a / (1 + a)) for a in prior]
        smooth = [sum(near) / len(near) for near in (gain[max(0, k - 2) : k + 3] for k in range(len(gain)))]
        clean = [g * g * p for g, p in zip(smooth, frame, strict=True)]
        for g, p, v in zip(smooth, frame, level, strict=True):
            if p < 4 * v:
                told["low"].append(20 * math.log10(max(g, 1e-12)))
            elif p > 100 * v:
                told["high"].append(20 * math.log10(max(g, 1e-12)))
    return tuple(sum(v) / len(v) if v else 0.0 for v in told.values())


def test_denoise(spark, table):
    noise = {rec: [1e-3 * (1 + i) for _ in range(SIZE // 2 + 1)] for i, rec in enumerate(LENGTHS) if rec != "even"}
    settings = spark.createDataFrame([(rec, v, 6.0 + i) for i, (rec, v) in enumerate(noise.items())], "rec string, noise array<double>, applied double")
    for chunk in (1, 1 << 16):
        rows = frame_stats.denoised(table, settings, SIZE, HOP, 150, chunk=chunk)
        got = {r.rec: (r.noise_gain_db, r.speech_gain_db) for r in frame_stats.denoise_report(rows).collect()}
        assert got.keys() == noise.keys()  # a recording without settings is left out
        for i, (k, rec) in enumerate((k, rec) for k, rec in enumerate(LENGTHS) if rec in noise):
            assert got[rec] == pytest.approx(plain_denoise(wave(LENGTHS[rec], k), noise[rec], 6.0 + i), abs=1e-6)
    assert got["long"][0] < -3 and -3 < got["long"][1] < 0


def test_stage_report(spark, tmp_path):
    n = 12_000
    samples = spark.createDataFrame([("a", i, float(v)) for i, v in enumerate(wave(n, 9))], "rec string, n bigint, x double")
    written = []

    def keep(df, name):
        written.append(name)
        df.write.parquet(str(tmp_path / name))
        return spark.read.parquet(str(tmp_path / name))

    out = stages.run_chain(samples, 4000.0, only=["dyneq"], between=keep)
    told = {r.key: float(r.value) for r in out.report.collect()}
    assert written == ["dyneq-rows", "dyneq"] and out.samples.count() == n
    assert told.keys() == {"max_reduction_db", "mean_reduction_db", "active", "change_db"} and 0 < told["mean_reduction_db"] <= told["max_reduction_db"] <= 8 and 0 < told["active"] < 1
