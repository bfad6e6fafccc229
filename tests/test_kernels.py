"""Kernels against direct computations, and chunked runs against whole ones."""

import numpy as np
import pytest

from cadenza.functions import filters
from cadenza.operators import linear, recurrences, transforms
from cadenza.sources import synthetic, wav


@pytest.fixture(scope="module")
def signal():
    return np.random.default_rng(1).normal(size=5000) * 0.1


@pytest.fixture(scope="module")
def table(spark, signal):
    rows = [(r, i, float(v) * s) for r, s in (("a", 1.0), ("b", 0.5)) for i, v in enumerate(signal)]
    return spark.createDataFrame(rows, "rec string, n bigint, x double").repartition(4).cache()


def direct(x, c):
    b0, b1, b2, a1, a2 = c
    y = np.zeros(len(x) + 2)
    p = np.concatenate([[0, 0], x])
    for i in range(2, len(p)):
        y[i] = b0 * p[i] + b1 * p[i - 1] + b2 * p[i - 2] - a1 * y[i - 1] - a2 * y[i - 2]
    return y[2:]


def values(df, column="x"):
    got = df.toPandas().sort_values(["rec", "n"])
    return got.loc[got["rec"] == "a", column].to_numpy()


def test_biquad(signal):
    for c in (*filters.k_weighting(48000), filters.peaking(1000, 6, 1, 48000), filters.shelf(200, -3, 0.7, 48000, False), filters.high_pass(80, 48000)):
        assert np.abs(recurrences.biquad(signal, c) - direct(signal, c)).max() < 1e-11
        assert recurrences.biquad(signal[:3], c) == pytest.approx(direct(signal[:3], c))


def test_responses():
    assert filters.response_db([filters.peaking(1000, 6, 1, 48000)], 1000, 48000) == pytest.approx(6, abs=1e-6)
    assert filters.response_db([filters.shelf(200, -3, 0.7, 48000, False)], 5, 48000) == pytest.approx(-3, abs=0.05)
    assert filters.response_db([filters.shelf(5000, 4, 0.7, 48000, True)], 20000, 48000) == pytest.approx(4, abs=0.1)
    assert filters.response_db([filters.high_pass(80, 48000)], 80, 48000) == pytest.approx(-3.0103, abs=1e-3)
    assert filters.response_db(filters.k_weighting(48000), 997, 48000) == pytest.approx(0.691, abs=0.02)


def test_chunked_filter(table, signal):
    c = [filters.peaking(8000, 6, 1, 48000), filters.high_pass(4000, 48000)]
    got = values(recurrences.filtered(table, c, chunk=1000))
    assert np.abs(got - recurrences.cascade(signal, c)).max() < 1e-12


def test_chunked_smoother_and_limiter(table, signal):
    down, up = recurrences.coefficient(0.2, 48000), recurrences.coefficient(1.0, 48000)
    got = values(recurrences.smoothed(table, down, up, chunk=512), "gain_db")
    assert np.abs(got - recurrences.smooth_gain(signal, down, up)).max() < 1e-12
    required = table.selectExpr("rec", "n", "least(1.0, 0.1 / greatest(abs(x), 1e-9)) AS x")
    whole = recurrences.limit_forward(np.minimum(1, 0.1 / np.maximum(np.abs(signal), 1e-9)), 0.95)
    got = values(recurrences.limiter_gain(required, 0.95, chunk=512), "gain")
    assert np.abs(got - whole).max() < 1e-12


def test_transform_round_trip(table, signal):
    assert np.abs(transforms.istft(transforms.stft(signal, 256, 64), 256, 64, len(signal)) - signal).max() < 1e-12
    assert np.abs(values(transforms.through_frames(table, lambda s: s, 256, 64, 4, chunk=1024)) - signal).max() < 1e-12
    with pytest.raises(ValueError):
        transforms.check_size(48)
    transforms.check_size(960, (2, 3, 5))


def test_wiener_lowers_noise(signal):
    spectra = transforms.stft(signal, 256, 64)
    power = np.abs(spectra) ** 2
    gains = transforms.wiener_gains(power, power.mean(axis=0), 0.25)
    assert gains.min() >= 0.25 - 1e-12 and gains.max() <= 1 and gains.mean() < 0.5


def test_dynamic_eq_holds_down_a_tone():
    x = 0.02 * np.sin(2 * np.pi * 2500 * np.arange(48000) / 48000) + np.random.default_rng(0).normal(size=48000) * 1e-4
    power = np.abs(transforms.stft(x, 1024, 256)) ** 2
    gains = transforms.dynamic_eq_gains(power, 48000, 1024, 256)
    assert gains[100, 53] < 0.6 and gains[:, :6].min() == 1.0 and gains.max() <= 1 + 1e-12 and gains.min() >= 10 ** (-8 / 20) - 1e-9


def test_convolve(table, signal):
    impulse = np.random.default_rng(2).normal(size=37)
    whole = np.convolve(signal, impulse)[: len(signal)]
    assert np.abs(transforms.convolve(signal, impulse) - whole).max() < 1e-10
    assert np.abs(values(transforms.convolved(table, impulse, chunk=512)) - whole).max() < 1e-10


def test_resample(table):
    x = 0.5 * np.sin(2 * np.pi * 1000 * np.arange(4410) / 44100)
    back = transforms.resample(transforms.resample(x, 44100, 48000), 48000, 44100)
    mid = slice(500, 3900)
    assert 10 * np.log10((x[mid] ** 2).sum() / ((back[: len(x)][mid] - x[mid]) ** 2).sum()) > 80
    assert transforms.resample(np.full(2000, 0.25), 44100, 48000)[300:1800] == pytest.approx(0.25, abs=1e-4)
    assert transforms.resampled(table, 48000, 48000) is table


def test_chunked_resample(table, signal):
    got = values(transforms.resampled(table, 44100, 48000, chunk=700))
    assert np.abs(got - transforms.resample(signal, 44100, 48000)).max() < 1e-12


def test_linear_prediction(table, spark):
    r = np.random.default_rng(3)
    x = np.zeros(4000)
    for i in range(2, 4000):
        x[i] = 1.6 * x[i - 1] - 0.8 * x[i - 2] + 0.01 * r.normal()
    assert linear.fit_ar(x, 2)[1:] == pytest.approx([-1.6, 0.8], abs=0.05)
    y = x.copy()
    y[2000:2006] = 0
    assert linear.interpolate_gap(y, 2000, 2006, linear.fit_ar(x, 16))
    assert np.abs(y - x).max() < 0.1 and not linear.interpolate_gap(y, 3, 6, linear.fit_ar(x, 16))
    broken = x.copy()
    broken[2000:2004] = 9.0
    rows = spark.createDataFrame([("a", i, float(v)) for i, v in enumerate(broken)], "rec string, n bigint, x double")
    fixed = values(linear.repaired(rows, spark.createDataFrame([("a", 2000, 2004)], "rec string, start bigint, end bigint"), 16, 200, chunk=1500))
    assert np.abs(fixed - x).max() < 0.2 and (np.delete(fixed, range(2000, 2004)) == np.delete(x, range(2000, 2004))).all()


def test_generators(spark):
    state, want = 7, []
    for _ in range(50):
        state = (state + 0x6D2B79F5) & 0xFFFFFFFF
        t = state
        t = ((t ^ (t >> 15)) * (t | 1)) & 0xFFFFFFFF
        t ^= (t + (((t ^ (t >> 7)) * (t | 61)) & 0xFFFFFFFF)) & 0xFFFFFFFF
        want.append((t ^ (t >> 14)) / 4294967296)
    assert synthetic.uniform(7, np.arange(50)) == pytest.approx(want, abs=0)
    tone = synthetic.sine(spark, "a", 4800, 440.0, 48000.0)
    loud = synthetic.at_loudness(tone, -23.0, 400, 100)
    from cadenza.operators.loudness import integrated

    assert integrated(loud, 400, 100).first()["lufs"] == pytest.approx(-23.0, abs=1e-9)
    noisy = synthetic.with_noise(tone, synthetic.noise(spark, "a", 4800, 5), 20.0, 400, 100)
    assert noisy.count() == 4800
    places = synthetic.click_places(48000, 40, 4, 5150)
    assert (np.diff(places) > 0).all() and len(places) == 40
    assert synthetic.room_response(8000, 0.3, 4.0, 1)[0] == 1.0


def test_wav(spark, tmp_path):
    r = np.random.default_rng(6)
    x = r.uniform(-1, 1, (2, 70_001)).astype(np.float32).astype(np.float64)
    for bits, form, error in ((8, "int", 1e-2), (16, "int", 1e-4), (24, "int", 1e-6), (32, "int", 1e-9), (32, "float", 0), (64, "float", 0)):
        data = wav.render(x, 44100, bits, form)
        head, y = wav.parse(data)
        assert head == {"rate": 44100, "channels": 2, "bits": bits, "format": form} and np.abs(y - x).max() <= error
        assert wav.render(y, 44100, bits, form) == data and len(data) == 44 + x.size * bits // 8
    for bad in (b"JUNK" + data[4:], data[:8] + b"JUNK" + data[12:], data[:36]):
        with pytest.raises(ValueError):
            wav.parse(bad)
    (tmp_path / "take one.WAV").write_bytes(wav.render(x, 44100, 24))
    (tmp_path / "take one_processed.wav").write_bytes(b"not a file to read")
    blocks = wav.read_blocks(spark, str(tmp_path)).cache()
    assert [tuple(t) for t in wav.recordings_of(blocks).select("rec", "rate", "length", "channels").collect()] == [("take one", 44100, 70_001, 2)]
    assert wav.samples_of(blocks).count() == x.size
    assert bytes(wav.files_of(blocks).first()["content"]) == wav.render(x, 44100, 24)


def test_streams(spark, tmp_path):
    from cadenza.streaming import windows

    rows = spark.range(3000).selectExpr("'a' AS rec", "id AS n", "timestamp_millis(id * 10) AS ts", "CASE WHEN id BETWEEN 1000 AND 1500 THEN 0.0 ELSE sin(id) END AS x")
    rows.coalesce(1).sortWithinPartitions("n").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    for name, out in (("loud", windows.hopping_loudness(stream)), ("quiet", windows.silent_sessions(stream, 0.0)), ("smooth", windows.smoothed(stream, 0.9))):
        q = out.writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", str(tmp_path / name)).start()
        q.processAllAvailable()
        q.stop()
    loud = {r.start: r.lufs for r in spark.table("loud").collect()}
    batch = {r.start: r.lufs for r in windows.hopping_loudness(rows).collect()}
    assert loud and all(batch[k] == pytest.approx(v) if v is not None else batch[k] is None for k, v in loud.items())
    assert any(r.samples >= 500 for r in spark.table("quiet").collect())
    y = [r.y for r in spark.table("smooth").orderBy("n").collect()]
    x = [r.x for r in rows.orderBy("n").collect()]
    assert np.abs(np.array(y) - recurrences.one_pole(np.array(x), 0.9)).max() < 1e-9
