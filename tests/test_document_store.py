"""Upserts against a dictionary: clashing keys, batches in any order, runs that are repeated, and batches that fail."""

import datetime as dt
import itertools
import random

import pytest

from cadenza.sources import document_store

SCHEMA = "key string, updatedAt timestamp, body string, note string"


def batches(seed):
    r = random.Random(seed)
    at = lambda: r.choice([None, *(dt.datetime(2024, 1, d) for d in range(1, 6))])
    return [[(f"doc {r.randrange(30)}", at(), '{"v": %d}' % r.randrange(100), "x") for _ in range(40)] for _ in range(3)]


def plain(*parts):
    best = {}
    for key, at, body, _ in itertools.chain(*parts):
        mark = (at or dt.datetime.min, body)
        if key not in best or mark > best[key][0]:
            best[key] = (mark, at, body)
    return {k: v[1:] for k, v in best.items()}


def held(spark, path):
    rows = document_store.read(spark, path).collect()
    assert len({r.key for r in rows}) == len(rows)
    return {r.key: (r.updatedAt, r.body) for r in rows}


def test_batches_in_any_order_and_again(spark, tmp_path):
    parts = batches(4)
    frames = [spark.createDataFrame(p, SCHEMA).repartition(3) for p in parts]
    for name, order in (("a", (0, 1, 2)), ("b", (2, 0, 1))):
        path = str(tmp_path / name)
        assert held(spark, path) == {}
        for i, k in enumerate(order):
            assert document_store.upsert(frames[k], path, 8) or i
            assert held(spark, path) == plain(*(parts[j] for j in order[: i + 1]))
        files = {p: p.stat().st_mtime_ns for p in (tmp_path / name).rglob("*.parquet")}
        for k in order:
            assert document_store.upsert(frames[k], path, 8) == []
        assert {p: p.stat().st_mtime_ns for p in (tmp_path / name).rglob("*.parquet")} == files
    assert held(spark, str(tmp_path / "a")) == held(spark, str(tmp_path / "b"))


def test_only_touched_buckets_are_written(spark, tmp_path):
    path = str(tmp_path / "s")
    document_store.upsert(spark.createDataFrame([(f"k{i}", dt.datetime(2024, 1, 1), "{}", "") for i in range(40)], SCHEMA), path, 8)
    files = {p: p.stat().st_mtime_ns for p in (tmp_path / "s").rglob("*.parquet")}
    written = document_store.upsert(spark.createDataFrame([("k7", dt.datetime(2024, 1, 2), "[1]", ""), ("k8", dt.datetime(2023, 1, 1), "[2]", "")], SCHEMA), path, 8)
    kept = {p: p.stat().st_mtime_ns for p in (tmp_path / "s").rglob("*.parquet") if f"bucket={written[0]}/" not in str(p)}
    assert len(written) == 1 and len(kept) == 7 and kept.items() <= files.items()
    assert held(spark, path)["k7"][1] == "[1]" and held(spark, path)["k8"][1] == "{}" and len(held(spark, path)) == 40


def test_batches_that_fail_leave_the_store_alone(spark, tmp_path):
    path = str(tmp_path / "s")
    document_store.upsert(spark.createDataFrame([("a", None, "1", "")], SCHEMA), path, 4)
    for bad in (("b", None, "{", ""), ("b", None, None, ""), (None, None, "2", "")):
        with pytest.raises(Exception, match="no document"):
            document_store.upsert(spark.createDataFrame([("a", dt.datetime(2025, 1, 1), "3", ""), bad], SCHEMA), path, 4)
        assert held(spark, path) == {"a": (None, "1")}
    assert document_store.upsert(spark.createDataFrame([], SCHEMA), path, 4) == []
