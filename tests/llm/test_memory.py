"""What operators hold and move at once."""

import tracemalloc
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from cadenza.llm import anchors, substring_dedup


def letters(r, n):
    return bytes(r.integers(97, 123, n).astype(np.uint8)).decode()


def test_anchors_take_little_memory_beside_the_text():
    data = np.random.default_rng(1).integers(97, 123, 4 << 20).astype(np.uint8)
    tracemalloc.start()
    anchors.find(data, np.array([0, 1 << 20, 4 << 20]))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 24 << 20


def test_contexts_of_a_frequent_line_are_moved_as_few_slices(spark, monkeypatch):
    r = np.random.default_rng(2)
    line, passage = letters(r, 120), letters(r, 230)
    rows = [(i, letters(r, 150) + line + letters(r, 150)) for i in range(40)]
    rows += [(100 + i, letters(r, 90) + passage[i % 3 : 230 - i % 5] + letters(r, 90)) for i in range(40)]
    rows += [(200 + i, rows[i][1][20:] + letters(r, 50)) for i in range(8)]
    moved, run, keep = {}, substring_dedup.repeated_windows, substring_dedup.materialize

    def watched(df, name, *more):
        table = keep(df, name, *more)
        binary = [c for c, kind in table.dtypes if kind == "binary"]
        moved[name] = table.agg(*(F.coalesce(F.sum(F.length(c)), F.lit(0)) for c in binary)).first() if binary else (0,)
        return table

    monkeypatch.setattr(substring_dedup, "materialize", watched)
    monkeypatch.setattr(substring_dedup, "repeated_windows", lambda x: run(x, 4096, 8))
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    got = {x.doc_id: [(s.start, s.stop) for s in x.spans] for x in substring_dedup.remove_repeats(docs).collect()}
    count = Counter(t[p : p + 200] for _, t in rows for p in range(len(t) - 199))
    for i, t in rows:
        hit = np.zeros(len(t) + 2, dtype=bool)
        for p in range(len(t) - 199):
            if count[t[p : p + 200]] > 1:
                hit[1 + p : 201 + p] = True
        edges = np.flatnonzero(np.diff(hit.astype(int))).reshape(-1, 2)
        assert got[i] == [tuple(e) for e in edges.tolist()]
    assert all(sum(m) < 4 * sum(len(t) for _, t in rows) for m in moved.values()), moved
    assert {"slices", "windows"} <= set(moved)  # lines told apart by their cores, passages by each window
