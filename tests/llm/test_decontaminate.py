"""Leaks against alignment of every document with every item: exact copies of an item together with edited ones."""

import numpy as np
import pytest

from cadenza.llm import decontaminate

WORDS = [f"w{i}" for i in range(400)]


def best_share(text, item):
    """The Smith-Waterman score as a share of the item, by definition; 0 where too few words are common for 0.6."""
    if sum(w in set(text) for w in item) < 0.6 * len(item):
        return 0.0
    best, before = 0.0, [0.0] * (len(item) + 1)
    for a in text:
        row = [0.0]
        for j, b in enumerate(item, 1):
            row.append(max(0.0, before[j - 1] + (1.0 if a == b else -0.5), before[j] - 0.5, row[j - 1] - 0.5))
        best, before = max(best, *row), row
    return best / len(item)


def mixed(r, words, share):
    """Each word replaced, dropped or followed by a new one with probability ``share``."""
    out = []
    for w in words:
        kind = r.integers(3) if r.random() < share else 3
        out += {0: [f"n{r.integers(999)}"], 1: [], 2: [w, f"n{r.integers(999)}"], 3: [w]}[int(kind)]
    return out


def case(r):
    items = [list(r.choice(WORDS, n)) for n in (1, 2, 3, 4, 5, 5, 6, 8, 15, 15, 38, 59, 700)]
    texts = []
    for item in items:
        copies = [item] * 3 + [mixed(r, item, share) for share in (0.15, 0.2, 0.25, 0.25)]
        for every in (3, 4, 6):
            copies.append([f"x{i}" if i % every == every - 1 else w for i, w in enumerate(item)])
        if len(item) > 500:  # a third of it is no leak
            copies.append(item[: len(item) // 3])
        copies.append([x for i, w in enumerate(item) for x in ([w, f"y{i}"] if i < 0.8 * len(item) else [w])])
        texts += [[*r.choice(WORDS, 60), *c, *r.choice(WORDS, 40)] for c in copies]
    return items, [*texts, [w for t in texts[:30] for w in t]]


@pytest.mark.parametrize("piece", [1 << 14, 250])
def test_leaks_with_edited_and_exact_copies(spark, monkeypatch, piece):
    monkeypatch.setattr(decontaminate, "PIECE", piece)
    items, texts = case(np.random.default_rng(3))
    monkeypatch.setattr(decontaminate, "TOGETHER", 4000)
    want = {(d, i): s for d, t in enumerate(texts) for i, w in enumerate(items) if (s := best_share(t, w)) >= 0.6}
    if piece == 1 << 14:
        monkeypatch.setattr(decontaminate, "PART", 60)  # several parts of the benchmark
        docs = spark.createDataFrame([(d, " ".join(t)) for d, t in enumerate(texts)], "doc_id bigint, text string").repartition(3)
        bench = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(items)], "item_id bigint, text string")
        got = {(x.doc_id, x.item_id): x.score for x in decontaminate.leaks(docs, bench).collect()}
    else:
        code = lambda words: np.array([hash(w) for w in words], dtype=np.int64)
        index = decontaminate.index_of(list(range(len(items))), [code(w) for w in items], 0.6)
        flat, offsets = code([w for t in texts for w in t]), np.cumsum([0, *map(len, texts)])
        got = {}
        for d, i, a, b in decontaminate.candidates(flat, offsets, index, 0.6):
            score = decontaminate.align([flat[a:b]], [index.words[i]])[0][0]
            if score >= 0.6:
                got[d, i] = max(score, got.get((d, i), 0))
    assert len(want) > 60 and sum(0.6 <= s < 0.8 for s in want.values()) > 20
    assert got == pytest.approx(want)
