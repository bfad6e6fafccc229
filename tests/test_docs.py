"""Document scans, and what surrounds the neural denoiser."""

import hashlib
import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from cadenza.operators import documents, neural
from cadenza.sources import json_docs


def test_sessions(spark, tmp_path):
    a = tmp_path / "a"
    a.mkdir()
    (tmp_path / "b").mkdir()
    (a / "session.json").write_text(json.dumps({"name": "A", "loudnessLufs": -28, "trials": []}))
    (tmp_path / "b" / "session.json").write_text(json.dumps({"name": "B", "trials": []}))
    (a / "key.json").write_text(json.dumps({"name": "A", "clips": {"t01": {"A": "x", "B": "y"}}, "windows": {"t01": {"start": 2.5, "dur": 8, "label": "w"}}, "variants": {}}))
    results = {"session": "A", "listener": "me", "updatedAt": "2020", "trials": {"t01": {"clips": {"A": {"scale": 4}, "C": {"notes": 'say "no"'}}, "trial": {"pick": "B"}, "timeSpentMs": 1}}}
    (a / "results.me.json").write_text(json.dumps(results))
    (tmp_path / "b" / "key.json").write_text(json.dumps({"name": "B", "clips": {"t01": {"A": "y", "C": "z"}}, "windows": {}, "variants": {}}))
    assert sorted((r.name, r.listener, r.done) for r in json_docs.sessions(spark, str(tmp_path)).collect()) == [("A", "me", 1), ("B", None, None)]
    answers, key = json_docs.answer_rows(spark, str(tmp_path)), json_docs.key_rows(spark, str(tmp_path))
    rows = {(r.clip, r.question): (r.variant, r.window_start, r.answer) for r in documents.answers_export(answers, key).collect()}
    assert rows == {("A", "scale"): ("x", 2.5, '"4"'), ("C", "notes"): ("", None, '"say ""no"""'), ("", "pick"): ("", None, '"B"')}
    stats = documents.variant_stats(answers, key).collect()
    assert [(s.variant, s.question, s.answers, s.n, s["mean"]) for s in stats] == [("x", "scale", 1, 1, 4.0)]


def test_annotations_baseline_and_models(spark, tmp_path):
    good = {"file": "x.wav", "sampleRate": 48000, "duration": 3, "labels": ["click"], "annotations": [{"id": "1", "start": 1, "end": 2.25, "label": "a, b", "note": 'n "q"', "confidence": "sure"}, {"id": "2", "start": 2, "end": 1, "label": "c", "confidence": "maybe"}]}
    (tmp_path / "x.annotations.json").write_text(json.dumps(good))
    (tmp_path / "y.annotations.json").write_text("{not json")
    rows = json_docs.annotation_rows(spark, str(tmp_path))
    lines = [r.line for r in documents.annotation_lines(rows).orderBy("start").collect()]
    assert lines == ['x.wav,1.0000,2.2500,"a, b",sure,"n ""q"""', "x.wav,2.0000,1.0000,c,maybe,"]
    assert [(r.id, r.problem) for r in documents.invalid_annotations(rows).collect()] == [("2", "end before start")]
    (tmp_path / "base.json").write_text('{"clean": {"lufs": -18.0, "change": null}}')
    assert {(r.case, r.metric, r.value) for r in json_docs.baseline(spark, str(tmp_path / "base.json")).collect()} == {("clean", "lufs", -18.0), ("clean", "change", None)}
    models = tmp_path / "m"
    models.mkdir()
    (models / "enc").write_bytes(b"one")
    (models / "dec").write_bytes(b"two")
    digest = lambda b: hashlib.sha256(b).hexdigest()
    pinned = spark.createDataFrame([("a", "enc", digest(b"one")), ("b", "enc", digest(b"one")), ("b", "dec", digest(b"?")), ("c", "dec", "")], "model string, name string, sha256 string")
    assert {r.model: r.ok for r in json_docs.verified_models(spark, str(models), pinned).collect()} == {"a": True, "b": False, "c": False}
    name = spark.createDataFrame([("ok-1.wav",)], "n string").select(json_docs.safe_name(F.col("n")).alias("n"), json_docs.sidecar(F.lit("Foo.WAV")).alias("s")).first()
    assert tuple(name) == ("ok-1.wav", "Foo.annotations.json")


def test_bands():
    c = neural.Config()
    widths = neural.band_widths(c)
    assert len(widths) == 32 and sum(widths) == 481 and min(widths) >= 2
    assert neural.decay_of(c) == 0.99


def test_features():
    c, r = neural.Config(), np.random.default_rng(0)
    spectra = r.normal(size=(40, 481)) + 1j * r.normal(size=(40, 481))
    bands, low = neural.features(spectra, c)
    mean, unit = np.linspace(-60, -90, 32), np.linspace(0.001, 0.0001, 96)
    edges = np.concatenate([[0], np.cumsum(neural.band_widths(c))])
    for t in range(40):
        db = np.array([10 * np.log10((np.abs(spectra[t, a:b]) ** 2).mean() + 1e-10) for a, b in zip(edges, edges[1:], strict=False)])
        mean = 0.01 * db + 0.99 * mean
        unit = 0.01 * np.abs(spectra[t, :96]) + 0.99 * unit
        assert bands[t] == pytest.approx((db - mean) / 40)
        assert low[t] == pytest.approx(spectra[t, :96] / np.sqrt(unit))


def test_apply_model():
    c, r = neural.Config(), np.random.default_rng(1)
    noisy = r.normal(size=(8, 481)) + 1j * r.normal(size=(8, 481))
    gains, filters = r.random((8, 32)), r.normal(size=(8, 96, 5)) + 1j * r.normal(size=(8, 96, 5))
    lsnr = np.array([0, 0, -20, 40, 25, 0, 0, 0.0])
    out = neural.apply_model(noisy, gains, filters, lsnr, c)
    assert (out[0] == 0).all() and (out[1] == noisy[1]).all() and (out[6:] == noisy[6:]).all()
    assert (out[2, :96] == noisy[2, :96]).all() and out[2, 480] == pytest.approx(noisy[2, 480] * gains[4, 31])
    want = sum(noisy[3 - 2 + o, :96] * filters[5, :, o] for o in range(5))
    assert out[3, :96] == pytest.approx(want)
    mixed = neural.apply_model(noisy, gains, filters, lsnr, c, 20.0)
    assert mixed[0] == pytest.approx(noisy[0] * 0.1)
    whole = np.arange(50.0)
    assert (neural.in_chunks(50, 7, 3, lambda a, b: whole[a:b]) == whole).all()
