"""The corpus pipeline, stage by stage, against brute force on what the stage before kept."""

import re
from collections import Counter

import numpy as np

import corpus_pipeline
from cadenza.llm import quality, registry
from cadenza.llm.common import materialize


def words(text):
    return re.findall(r"[^\W_]+", text.lower())


def shingles(text):
    w = words(text)
    return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def test_stages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    kept = [docs]
    for name, stage in corpus_pipeline.STAGES:
        kept.append(materialize(stage(spark, kept[-1], sf_dir), name))
    tables = [{r.doc_id: r for r in t.collect()} for t in kept[:5]]
    assert all(t.columns == docs.columns for t in kept[:5])
    assert all(tables[i + 1][d] == tables[i][d] for i in range(4) for d in tables[i + 1])

    model = quality.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    score = {d: model.score(quality.features_of(r.text)[None])[0] for d, r in tables[0].items()}
    assert set(tables[1]) == {d for d, s in score.items() if s >= 0.7} != set(tables[0])

    best = {}
    for d, r in tables[1].items():
        best[r.text] = max(d, best.get(r.text, d))
    assert set(tables[2]) == set(best.values())

    ids = sorted(tables[2])
    sets = {d: shingles(tables[2][d].text) for d in ids}
    parent = {d: d for d in ids}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            if sets[a] and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                parent[max(root(a), root(b))] = min(root(a), root(b))
    assert set(tables[3]) == {d for d in ids if root(d) == d}

    items = [f" {' '.join(words(r.text))} " for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    leaked = {d for d, r in tables[3].items() if any(i in f" {' '.join(words(r.text))} " for i in items)}
    assert set(tables[4]) == set(tables[3]) - leaked

    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(registry.tokenizer_path())
    want = Counter(i for r in tables[4].values() for i in [*tokenizer.encode(r.text, add_special_tokens=False).ids, 1])
    pieces = kept[5].collect()
    assert Counter(i for p in pieces for i in np.frombuffer(p.ids, "<u4").tolist()) == want
    fill = Counter()
    for p in pieces:
        fill[p.sequence_id] += p.length
    assert max(fill.values()) <= 2048


def test_queries_are_registered():
    import __spark_entry__

    names = __spark_entry__.queries()
    assert {f"op{n}_" for n in range(1, 14)} == {re.match(r"op\d+_", n)[0] for n in names if n.startswith("op")}
    assert "pipeline" in names and [n for n, _ in corpus_pipeline.STAGES] == ["quality", "exact_dedup", "near_dup", "decontaminate", "packing"]


def test_shards_and_copies_queries(spark, sf_dir):
    rows = registry.op9_sharding(spark, sf_dir).collect()
    for s in range(16):
        slots = sorted(r.slot for r in rows if r.shard == s)
        assert slots == list(range(len(slots)))
    assert len(rows) == spark.read.parquet(f"{sf_dir}/documents.parquet").count()
