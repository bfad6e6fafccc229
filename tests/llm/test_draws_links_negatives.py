"""Importance resampling, SimHash links and hard negatives against brute force, with odd rows."""

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from cadenza.llm import hard_negatives, importance, registry, simhash
from cadenza.llm.gray_index import GrayIndex, gray_rank
from cadenza.llm.hard_negatives import Rotated, survivors
from cadenza.llm.word_trie import WordTrie, words_of

LOWER = {i: i + 32 for i in range(65, 91)}
TEXTS = [
    "The quick Brown fox jumps", None, "", " \n\t ", "ÀÉ straße\x00 naïve x9 A-Z_a", "a" * 100_000, "one", "one two", "one two three four " * 5_000, "the quick brown fox jumps",
    *(" ".join(f"w{(i * j) % 7}" for j in range(25)) for i in range(12)),
]
SCHEMA = "doc_id bigint, text string, score string, n bigint"


def documents(spark, texts=TEXTS):
    rows = [(i, t, "clash", None) for i, t in enumerate(texts)] + [(3, texts[-1], None, 1)] * 3 + [(None, texts[-1], None, 1)]
    return spark.createDataFrame(rows, SCHEMA).repartition(3), [(r[0], r[1]) for r in rows]


def features(text, order):
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))
    return len(w), [" ".join(w[i : i + k]) for k in range(1, order + 1) for i in range(len(w) - k + 1)]


def plain_resample(rows, target, order, least, percent, buckets):
    bucket = lambda f: zlib.crc32(f.encode()) % buckets
    s = Counter(bucket(f) for _, t in rows for f in features(t, order)[1])
    t = Counter(bucket(f) for x in target for f in features(x, order)[1])
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (s.total() + buckets) / ((s[b] + 1) * (t.total() + buckets))))
    out = []
    for i, text in rows:
        words, found = features(text, order)
        weight = sum(gain(bucket(f)) for f in found) // len(found) if found else 0
        h = int(hashlib.sha256(f"2024:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append((words >= least, i, len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32)))))
    able = sorted((x for x in out if x[0]), key=lambda x: (-x[4], x[1] is not None, x[1] or 0, x[2]))
    drawn = percent * len(able) // 100
    ranked = [(*x[1:], n + 1 if n < drawn else None) for n, x in enumerate(able)]
    return Counter([*ranked, *((*x[1:], None) for x in out if not x[0])])


@pytest.mark.parametrize(("order", "least", "percent", "buckets"), [(1, 20, 10, 10_000), (3, 2, 50, 97), (2, 0, 100, 13)])
def test_resample(spark, order, least, percent, buckets):
    docs, rows = documents(spark)
    target = ["the quick fox", None, "w1 w2 w3"]
    frame = spark.createDataFrame([(i, t) for i, t in enumerate(target)], "item_id bigint, text string")
    got = importance.resample(docs, frame, percent, least, order, buckets)
    assert Counter(tuple(r) for r in got.collect()) == plain_resample(rows, target, order, least, percent, buckets)
    ids = {r.doc_id for r in got.collect() if r.rank is not None and r.doc_id is not None}
    assert {r.doc_id for r in importance.drawn(docs, got).collect()} == ids


def test_trie_that_forgets_counts_the_same():
    texts = pa.array([t for t in TEXTS if t and len(t) < 1000] * 3)
    whole, small = WordTrie(2), WordTrie(2, most=4)
    total = np.zeros(50, dtype=np.int64)
    for i in range(len(texts)):
        for trie in (whole, small):
            for level, node, _ in trie.walk(*words_of(texts.slice(i, 1))):
                level.count += np.bincount(node, minlength=len(level.count))
        if small.full():
            total += small.totals(50)
            small.clear()
    assert (whole.totals(50) == total + small.totals(50)).all()


def test_empty_tables(spark):
    none = spark.createDataFrame([], SCHEMA)
    target = spark.createDataFrame([], "item_id bigint, text string")
    assert importance.resample(none, target).count() == 0
    assert importance.resample(documents(spark)[0], target).count() == len(TEXTS) + 4
    assert simhash.near_duplicates(none).count() == 0
    vectors = spark.createDataFrame([], "vec_id bigint, embedding array<float>, label int")
    assert hard_negatives.mine(vectors, F.col("id") % 100 == 0).count() == 0


def plain_print(text):
    w = [x for x in re.split("[\x20\x09-\x0d]+", (text or "").translate(LOWER)) if x]
    shingles = [" ".join(w[k : k + 3]) for k in range(max(1, len(w) - 2))] if w else []
    hashed = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashed) > len(hashed))


def plain_components(prints):
    """The group number of each fingerprint, by a search over all pairs."""
    f, left, group = np.array(prints, dtype=np.uint64), set(range(len(prints))), {}
    while left:
        todo = [min(left)]
        head = todo[0]
        left.discard(head)
        while todo:
            x = todo.pop()
            group[x] = head
            near = {int(j) for j in np.flatnonzero(np.bitwise_count(f[x] ^ f) <= 3)} & left
            left -= near
            todo += near
    return [group[i] for i in range(len(prints))]


def test_simhash(spark):
    docs, rows = documents(spark)
    prints = [plain_print(t) for _, t in rows]
    group = plain_components(prints)
    least = {}
    for (i, _), g in zip(rows, group, strict=True):
        least[g] = min((x for x in (i, least.get(g)) if x is not None), default=None)
    want = Counter((i, format(p, "016x"), least[g]) for (i, _), p, g in zip(rows, prints, group, strict=True))
    assert Counter(tuple(r) for r in simhash.near_duplicates(docs).collect()) == want
    with pytest.raises(ValueError, match="most"):
        simhash.near_duplicates(docs, most=1)


def clustered(seed, count, flips):
    """Fingerprints around one centre, and random ones."""
    r = np.random.default_rng(seed)
    near = r.integers(0, 2**64, 1, dtype=np.uint64) ^ np.bitwise_or.reduce(np.uint64(1) << r.integers(0, 64, (count, flips), dtype=np.uint64), axis=1)
    edges = np.array([0, 2**64 - 1, 1, 2**63, 3], dtype=np.uint64)
    return np.unique(np.concatenate([near, r.integers(0, 2**64, count // 4, dtype=np.uint64), edges]))


def test_gray_index_finds_all_pairs():
    prints = clustered(5, 900, 4)
    ordered = prints[np.argsort(gray_rank(prints))]
    offsets = np.array([0, 1, 70, 600, len(ordered)])
    index = GrayIndex(ordered, offsets)
    for leaf in range(4):
        inside = ordered[offsets[leaf] : offsets[leaf + 1]]
        got = {(i, j) for a, b in index.search(prints, np.full(len(prints), leaf), 3) for i, j in zip(a.tolist(), b.tolist(), strict=True)}
        want = np.nonzero(np.bitwise_count(prints[:, None] ^ inside[None, :]) <= 3)
        assert got == set(zip(want[0].tolist(), (want[1] + offsets[leaf]).tolist(), strict=True))


def test_links_of_a_node_of_many_leaves(spark):
    """More members that share bands than leaves hold: pairs of leaves, and of runs of leaves, are searched."""
    prints = clustered(7, 4_000, 5)
    frame = spark.createDataFrame([(int(x),) for x in prints.view(np.int64)], "fp bigint")
    group = {int(x): g for x, g in zip(prints.view(np.int64), plain_components(prints), strict=True)}
    parent = {x: x for x in group}

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for r in simhash.links(frame).collect():
        assert (r.u ^ r.v) & (2**64 - 1) and group[r.u] == group[r.v]
        parent[top(r.u)] = top(r.v)
    assert len({top(x) for x in group}) == len(set(group.values()))
    assert simhash.links(frame).count() < 8 * len(prints) * 4


def plain_negatives(rows, positives, negatives):
    v = [(i, k, [math.floor(256 * x) for x in e]) for i, e, k in rows if i is not None and k is not None and e is not None and all(x is not None and math.isfinite(x) for x in e)]
    dot = lambda a, b: sum(x * y for x, y in zip(a, b))  # noqa: B905, E731
    out = Counter()
    for i, k, a in v:
        if i % 100:
            continue
        scored = sorted((-dot(a, b), j, kind) for j, kind, b in v if j != i)
        for score, p, _ in [s for s in scored if s[2] == k][:positives]:
            fits = [s for s in scored if s[2] != k and 30 * -score <= 100 * -s[0] <= 90 * -score][:negatives]
            out.update((i, p, n + 1, j, -score, -s) for n, (s, j, _) in enumerate(fits))
    return out


@pytest.mark.parametrize("spread", [0.0, 1.0])
def test_hard_negatives(spark, spread):
    """Vectors of one direction and of many; ties, repeats, odd values and lengths."""
    r = np.random.default_rng(11)
    base = r.normal(size=12)
    rows = [(int(i), [float(np.float32(x)) for x in base + spread * r.normal(size=12)], int(i) % 3) for i in range(450)]
    same = rows[5][1]
    rows += [(1000 + i, same, i % 3) for i in range(40)] + [(1300, same, 1)] * 2 + [(100, rows[0][1], 2)]
    rows += [(None, same, 1), (2000, None, 1), (2100, same, None), (2200, [math.nan, *same[1:]], 0), (2300, [None, *same[1:]], 0), (2400, [math.inf, *same[1:]], 0), (2500, [], 0), (2600, same[:3], 1)]
    frame = spark.createDataFrame([(*x, "c", 1) for x in rows], "vec_id bigint, embedding array<float>, label int, id string, a int").repartition(3)
    want = plain_negatives(rows, 5, 10)
    for batch in (8 << 20, 600):
        got = Counter(tuple(x) for x in hard_negatives.mine(frame, F.col("id") % 100 == 0, batch_bytes=batch).collect())
        assert got == want
    with pytest.raises(ValueError, match="63 bits"):
        hard_negatives.mine(spark.createDataFrame([(0, [1e18], 1)], "vec_id bigint, embedding array<float>, label int"), F.col("id") == 0)


def test_survivors_lose_no_pair_and_drop_most():
    r = np.random.default_rng(2)
    whole = np.rint(r.normal(size=(600, 32)) * np.geomspace(200, 1, 32)).astype(np.int64)
    axes, cuts = np.linalg.eigh((whole.T @ whole).astype(float))[1][:, ::-1], hard_negatives.cuts_of(32)
    a, b = Rotated(whole[:100], axes, cuts), Rotated(whole, axes, cuts)
    scores = whole[:100] @ whole.T
    low = np.sort(scores, axis=1)[:, -5].astype(float)
    i, j = survivors(a, b, cuts, hard_negatives.rounding(axes), np.ones(scores.shape, dtype=bool), low, np.full(100, np.inf))
    kept = np.zeros(scores.shape, dtype=bool)
    kept[i, j] = True
    assert kept[scores >= low[:, None]].all() and kept.mean() < 0.1


def test_queries_on_the_tables(spark, sf_dir):
    assert registry.op12_simhash(spark, sf_dir).columns == ["doc_id", "fingerprint", "component_id"]
    assert set(registry.queries()) - set(registry.oracle_sql()) >= {"op12_simhash"}
