"""Near-duplicates, decontamination, substring removal, licences and quality against brute force, with odd rows."""

import hashlib
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from cadenza.llm import decontaminate, licenses, near_dup, quality, substring_dedup
from cadenza.llm.suffix_array import Strings, common_prefixes, suffix_ranks

WORDS = [f"w{i}" for i in range(400)]


def text_of(r, n):
    return " ".join(r.choice(WORDS, n))


def edited(r, text, edits):
    words = text.split()
    for i in r.choice(len(words), edits, replace=False):
        words[i] = f"new{r.integers(1000)}"
    return " ".join(words)


@pytest.fixture(scope="module")
def near_rows():
    r = np.random.default_rng(5)
    texts = [text_of(r, int(n)) for n in r.integers(1, 200, 40)]
    base = text_of(r, 300)
    texts += [edited(r, base, int(k)) for k in r.integers(1, 8, 60)] + [base, base.upper() + " !", texts[0], texts[0]]
    rows = list(enumerate(texts))
    rows += [(500, None), (501, ""), (502, "?!"), (503, "one two"), (504, "One, two."), (3, texts[3]), (None, base), (600, text_of(r, 20_000))]
    lone, other = text_of(r, 150), text_of(r, 150)
    rows += [(3, lone), (601, edited(r, lone, 2)), (None, edited(r, lone, 3)), (None, other), (None, edited(r, other, 1)), (None, other)]
    long = text_of(r, 2400).split()  # a chain: each text is near its neighbours only
    return rows + [(1000 + k, " ".join(long[10 * k : 10 * k + 120])) for k in range(220)]


def shingles(text):
    w = re.findall(r"[^\W_]+", (text or "").lower())
    return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


@pytest.mark.parametrize("tile_docs", [1024, 4])
def test_near_duplicates(spark, near_rows, tile_docs):
    docs = spark.createDataFrame(near_rows, "doc_id bigint, text string").selectExpr("*", "1 AS links", "2 AS node", "3 AS id").repartition(3)
    got = [tuple(r) for r in near_dup.near_duplicates(docs, tile_docs=tile_docs).collect()]
    texts = sorted({t or "" for _, t in near_rows})
    sets, parent, links = [shingles(t) for t in texts], list(range(len(texts))), Counter()

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(texts)):
        for b in range(a + 1, len(texts)):
            if sets[a] and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                links[texts[a]] += 1
                links[texts[b]] += 1
                parent[root(a)] = root(b)
    of_id, number = {}, {t: k for k, t in enumerate(texts)}
    for i, t in near_rows:
        if i is not None:
            parent[root(number[t or ""])] = root(of_id.setdefault(i, number[t or ""]))
    least = {}
    for i, t in near_rows:
        c = root(number[t or ""])
        least[c] = min((x for x in (least.get(c), i) if x is not None), default=None)
    copies = Counter(t or "" for _, t in near_rows)
    want = [(i, least[root(number[t or ""])], links[t or ""], copies[t or ""]) for i, t in near_rows]
    assert sum(links.values()) > 400
    assert Counter(got) == Counter(want)
    kept = Counter(tuple(r) for r in near_dup.keep_one(docs.select("doc_id", "text"), tile_docs=tile_docs).collect())
    named = Counter((i, t) for i, t in near_rows if i is not None and i == least[root(number[t or ""])])
    unnamed = [(i, t) for i, t in near_rows if i is None and least[root(number[t or ""])] is None]
    first = min((t for _, t in unnamed), key=lambda t: hashlib.sha256(t.encode()).digest())
    assert kept == named + Counter(x for x in unnamed if x[1] == first)


def test_large_chains_are_compared_by_band(spark, near_rows):
    """The chain's bands hold fewer texts than its chunks would; the dense class stays whole."""
    rows = spark.createDataFrame(near_rows, "id bigint, text string").selectExpr("id", "coalesce(text, '') AS text", "unhex(sha2(coalesce(text, ''), 256)) AS digest")
    nodes = near_dup._sketched(rows).groupBy("digest").agg({"size": "max", "bands": "first"}).toDF("digest", "size", "bands")
    nodes = near_dup.materialize(nodes.selectExpr("*", "monotonically_increasing_id() AS node"), "nodes")
    tiles = {(r.tile.band, r.tile.i >= 0) for r in near_dup._blocks(nodes, 4, 8 << 20).collect()}
    assert (True, False) in tiles and (False, True) in tiles


def test_near_duplicates_of_nothing(spark):
    docs = spark.createDataFrame([], "doc_id bigint, text string")
    assert near_dup.near_duplicates(docs).count() == 0 and near_dup.keep_one(docs).count() == 0


def test_pruning_keeps_what_may_reach_the_threshold():
    for compared in (12, 60, 120):
        least = near_dup.least_matches(0.8, 1e-5, compared)
        assert 0.2 * compared < least < 0.8 * compared
        draws = np.random.default_rng(0).binomial(compared, 0.8, 100_000)
        assert (draws < least).mean() < 1e-3


def test_decontaminate(spark):
    r = np.random.default_rng(9)
    items = [(i, text_of(r, int(n))) for i, n in enumerate(r.integers(14, 60, 12))] + [(90, None), (91, "?!"), (92, text_of(r, 1500)), (None, text_of(r, 30))]
    rows, want = [], set()
    for k, (item, text) in enumerate(items):
        if item is None or item in (90, 91):
            continue
        words = len(text.split())
        for kind, inside in enumerate((text, text.upper().replace(" ", ", "), edited(r, text, words // 10))):
            rows.append((10 * k + kind, f"{text_of(r, 300)}\n{inside}\n{text_of(r, 100)}"))
            want.add((10 * k + kind, item))
    rows += [(1000 + i, text_of(r, 400)) for i in range(30)] + [(2000, None), (2001, ""), rows[0], (None, items[0][1])]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").selectExpr("*", "1 AS item", "'x' AS item_id", "0 AS score").repartition(3)
    bench = spark.createDataFrame(items, "item_id bigint, text string").selectExpr("*", "5 AS doc_id")
    found = decontaminate.leaks(docs, bench).collect()
    assert {(f.doc_id, f.item_id) for f in found} == want | {(None, 0)}
    exact = [f for f in found if f.doc_id is not None and f.doc_id % 10 < 2]
    assert exact and all(f.score == pytest.approx(1.0) for f in exact)
    assert all(f.start_word == 300 for f in exact if f.item_id != 92)
    clean = {x.doc_id for x in decontaminate.keep_clean(docs, bench).collect()}
    assert clean == {i for i, _ in rows} - {d for d, _ in want}
    assert decontaminate.leaks(docs, bench.limit(0)).count() == 0
    assert decontaminate.leaks(docs.limit(0), bench).count() == 0


def test_suffix_arrays():
    r = np.random.default_rng(2)
    for _ in range(60):
        parts = [bytes(r.integers(0, int(r.choice([1, 2, 256])), int(n)).astype(np.uint8)) for n in r.integers(0, 60, 6)]
        parts += parts[:2]
        s = Strings(parts)
        order = np.argsort(suffix_ranks(s))
        suffixes = [p[j:] for p in parts for j in range(len(p) + 1)]
        found = [suffixes[i] for i in order]
        assert found == sorted(suffixes)
        shared = [0] + [next((k for k in range(min(len(a), len(b))) if a[k] != b[k]), min(len(a), len(b))) for a, b in zip(found, found[1:], strict=False)]
        assert common_prefixes(s, order).tolist() == shared


@pytest.mark.parametrize("contexts", [1024, 2])
def test_remove_repeats(spark, monkeypatch, contexts):
    r = np.random.default_rng(4)
    passage, line = text_of(r, 90), text_of(r, 20)
    rows = [(i, f"{text_of(r, 60)} {line} {text_of(r, 30)}") for i in range(25)]
    rows += [(100 + i, f"{text_of(r, 20)} {passage[i : 300 + 7 * i]} é{text_of(r, 20)}") for i in range(12)]
    rows += [(200, "ab" * 500), (201, None), (202, ""), (203, "x" * 199), (204, "x" * 200), (205, rows[0][1]), (205, rows[0][1]), (None, rows[1][1]), (206, "z" * 200), (207, "y" * 201)]
    run = substring_dedup.repeated_windows
    monkeypatch.setattr(substring_dedup, "repeated_windows", lambda x: run(x, 4096, contexts))
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").selectExpr("*", "1 AS spans", "2 AS uid1").repartition(3)
    data = [(i, (t or "").encode()) for i, t in rows]
    count = Counter(b[p : p + 200] for _, b in data for p in range(len(b) - 199))
    want = Counter()
    for i, b in data:
        hit = np.zeros(len(b) + 1, dtype=bool)
        for p in range(len(b) - 199):
            if count[b[p : p + 200]] > 1:
                hit[p : p + 200] = True
        edges = np.flatnonzero(np.diff(np.concatenate([[0], hit[:-1].astype(int), [0]]))).reshape(-1, 2)
        want[(i, len(b), tuple(map(tuple, edges.tolist())), bytes(np.frombuffer(b, np.uint8)[~hit[:-1]]))] += 1
    got = Counter((x.doc_id, x.n_bytes, tuple((s.start, s.stop) for s in x.spans), bytes(x.kept)) for x in substring_dedup.remove_repeats(docs).collect())
    assert got == want
    assert substring_dedup.remove_repeats(docs.limit(0)).count() == 0


def cosine_scan(files, threshold=0.8):
    """The licence scan by definition, in plain Python: {id: {license: (score, named)}} of own licences."""
    terms = lambda t: Counter(re.findall(r"[^\W_]+", t.lower()))
    lines = [line for _, _, t in files for line in (t or "").split("\n")]
    df = Counter(w for line in lines for w in terms(line))
    vector = lambda t: {w: n * (np.log((1 + len(lines)) / (1 + df[w])) + 1) for w, n in terms(t).items()}
    norm = lambda v: np.sqrt(sum(x * x for x in v.values()))
    templates = [(k, u, norm(u)) for k, ts in licenses.known_templates().items() for u in map(vector, ts)]
    out: dict = {}
    for i, path, t in files:
        named = path.rsplit("/", 1)[-1].split(".")[0].lower() in licenses.LICENSE_FILES
        own = [x for x in (t or "").split("\n") if x.strip()]

        def reached(unit):
            v = vector(unit)
            scores = [(sum(v.get(w, 0) * x for w, x in u.items()) / norm(v) / n, k) for k, u, n in templates if v]
            best = max((s for s, _ in scores), default=0)
            if best < threshold - 1e-9:
                return False
            name = min(k for s, k in scores if s > best - 1e-12)
            out.setdefault(i, {})[name] = max(best, out.get(i, {}).get(name, 0))
            return True

        hit = [reached(x) for x in own]
        for k in range(len(own) - 1):
            if not hit[k] and not hit[k + 1]:
                reached(own[k] + " " + own[k + 1])
        if named:
            reached(t or "")
    return out


FILES = [
    (1, "a/LICENSE", "Licensed under the Apache License, Version 2.0."), (2, "a/b/c.txt", "nothing here"), (3, "a/b/COPYING.txt", "Released under the MIT License.\nmore words"),
    (4, "a/b/d/e.txt", None), (5, "z/f.txt", "text\nThis work is licensed under the GNU General Public License, version 3.\ntext"), (6, "z/g.txt", "Released under the old MIT License terms, see file"),
    (7, "top.txt", ""), (8, "a/h.txt", "Licensed under CC BY-NC 4.0.\nReleased under the MIT License."), (9, "q/LICENSE", "no licence at all"), (10, "q/r/s.txt", "the license of the license"),
]


def test_licenses(spark):
    from pyspark.sql import functions as F

    docs = spark.createDataFrame(FILES, "doc_id bigint, path string, text string").selectExpr("*", "'x' AS license", "1 AS own")
    got = {r.doc_id: r for r in licenses.scan(docs, F.col("path")).collect()}
    own = {i: {x.license: x.score for x in r.licenses} for i, r in got.items() if r.origin in ("notice", "file")}
    want = cosine_scan(FILES)
    assert len(got) == len(FILES) and {i: set(x) for i, x in own.items()} == {i: set(x) for i, x in want.items()}
    assert all(own[i][k] == pytest.approx(want[i][k]) for i in own for k in own[i])
    assert {i: r.origin for i, r in got.items() if r.origin == "file"} == {1: "file", 3: "file"}
    inherited = {(i, r.directory, *(x.license for x in r.licenses)) for i, r in got.items() if r.origin == "inherited"}
    assert inherited == {(2, "a/b", "MIT"), (4, "a/b", "MIT")}
    assert {i for i, r in got.items() if r.origin == "none" and r.licenses == []} == {6, 7, 9, 10} - set(want)
    assert licenses.scan(docs.limit(0), F.col("path")).count() == 0
    odd = spark.createDataFrame([(None, None, "Released under the MIT License."), (1, None, None), (1, "x/y", "t" * 100_000)], "doc_id bigint, path string, text string")
    assert {(r.doc_id, r.origin, len(r.licenses)) for r in licenses.scan(odd, F.col("path")).collect()} == {(None, "notice", 1), (1, "none", 0)}


def test_full_texts_headers_and_tags(spark):
    from importlib.resources import files

    from pyspark.sql import functions as F

    folder = files("cadenza.llm").joinpath("license_texts")
    rows = [(i, f"p{i}/LICENSE", e.read_text("utf-8"), e.name.removesuffix(".txt")) for i, e in enumerate(sorted(folder.iterdir(), key=lambda e: e.name))]
    rows += [(100 + i, f"p{i}/src/a.c", "int main;", licence) for i, _, _, licence in rows]
    rows += [
        (200, "s/a.py", "# Copyright someone\n#\n" + rows[[r[3] for r in rows].index("MIT")][2], "MIT"),
        (201, "s/b.py", "\n".join(rows[[r[3] for r in rows].index("GPL-3.0")][2].split("\n")[:12]), "GPL-3.0"),
        (202, "s/c.py", "# Permission to use, copy, modify, and/or distribute this software for any\n# purpose with or without fee is hereby granted, provided that the above", "ISC"),
        (203, "s/d.py", "// SPDX-License-Identifier: MIT\ncode", "MIT"), (204, "s/e.py", "/* SPDX-License-Identifier: (GPL-2.0-only OR Apache-2.0+) */", "Apache-2.0 GPL-2.0"),
        (205, "s/f.py", '# Licensed under the Apache License, Version 2.0 (the "License");\n# you may not use this file except in compliance with the License.', "Apache-2.0"),
        (206, "s/g.py", "    This program is free software: you can redistribute it and/or modify\n    it under the terms of the GNU General Public License as published by\n    the Free Software Foundation, either version 3 of the License, or\n    (at your option) any later version.", "GPL-3.0"),
        (207, "s/h.py", "This Source Code Form is subject to the terms of the Mozilla Public\nLicense, v. 2.0.", "MPL-2.0"), (208, "s/i.py", "we license nothing of the kind to the public", ""),
    ]
    docs = spark.createDataFrame([r[:3] for r in rows], "doc_id bigint, at string, text string").selectExpr("*", "'x' AS path", "1 AS named")
    got = {r.doc_id: (r.origin, {x.license for x in r.licenses}) for r in licenses.scan(docs, F.col("at")).collect()}
    for i, _, _, licence in rows:
        assert got[i][1] >= set(licence.split()) and (licence or not got[i][1]), (i, licence, got[i])
    assert all(got[i][0] == ("file" if i < 100 else "inherited" if i < 200 else "notice" if i < 208 else "none") for i in got)


def inherited_by_hand(files, own):
    """{id: (directory, licences)} by walking up from every file without a licence of its own."""
    folder = lambda p: p.rsplit("/", 1)[0] if "/" in p else ""
    holders: dict = {}
    for i, path, _ in files:
        if i in own and path.rsplit("/", 1)[-1].split(".")[0].lower() in licenses.LICENSE_FILES:
            holders.setdefault(folder(path), set()).update(own[i])
    out = {}
    for i, path, _ in files:
        at = folder(path)
        while i not in own:
            if at in holders:
                out[i] = (at, frozenset(holders[at]))
            if at in holders or not at:
                break
            at = folder(at)
    return out


def test_inheritance_by_brute_force(spark):
    from pyspark.sql import functions as F

    r = np.random.default_rng(6)
    notices = ["Released under the MIT License.", "Licensed under CC BY 4.0.", "Licensed under the Apache License, Version 2.0.", "plain words", None]
    files = []
    for i in range(120):
        depth = int(r.integers(0, 5))
        name = "LICENSE" if r.random() < 0.2 else f"f{i}.txt"
        files.append((i, "/".join([*(str(x) for x in r.integers(0, 2, depth)), name]), notices[int(r.integers(5))] if name == "LICENSE" or r.random() < 0.1 else "words"))
    got = licenses.scan(spark.createDataFrame(files, "doc_id bigint, path string, text string").repartition(3), F.col("path")).collect()
    own = {x.doc_id: {y.license for y in x.licenses} for x in got if x.origin in ("file", "notice")}
    assert own == {i: set(x) for i, x in cosine_scan(files).items()}
    want = inherited_by_hand(files, own)
    assert {x.doc_id: (x.directory, frozenset(y.license for y in x.licenses)) for x in got if x.origin == "inherited"} == want and len(want) > 20


def test_quality(spark, sf_dir):
    docs, labels = (spark.read.parquet(f"{sf_dir.replace('sf0.001', 'sf0.01')}/{t}.parquet") for t in ("documents", "labels"))
    model = quality.train(docs, labels)
    rows = {r.doc_id: r for r in quality.score_rows(docs, model).collect()}
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 4 == 2) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for i, r in rows.items())
    known = [(rows[x.doc_id].predicted, x.quality) for x in labels.collect() if rows[x.doc_id].held_out]
    assert np.mean([a == b for a, b in known]) > 0.95


def test_quality_odd_rows(spark):
    docs = spark.createDataFrame([(1, None), (1, ""), (None, "a b"), (2, "x " * 50_000), (3, "\n\n"), (4, " ")], "doc_id bigint, text string").selectExpr("*", "1 AS score")
    labels = spark.createDataFrame([(1, 1, None), (1, None, 0), (None, 0, 1)], "doc_id bigint, quality int, toxic int")
    for model in (quality.train(docs, labels), quality.train(docs.limit(0), labels), quality.train(docs, labels.limit(0))):
        rows = quality.score_rows(docs.drop("score"), model).collect()
        assert len(rows) == 6 and all(0 <= r.score <= 1 for r in rows)
    assert quality.score_rows(docs.drop("score").limit(0), model).count() == 0


def test_gam_learns_an_interaction():
    r = np.random.default_rng(0)
    x = r.random((4000, 3))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)).astype(float)
    model = quality.fit(x[:3000], y[:3000])
    assert ((model.score(x[3000:]) > 0.5) == y[3000:]).mean() > 0.9



def test_sizes_are_bytes(spark):
    """What bounds a tile is a text's length in bytes, however few words it has."""
    texts = ["x" * 300_000, "four words of text", "é " * 50, " \n ", ""]
    rows = spark.createDataFrame([(i, t, bytes([i])) for i, t in enumerate(texts)], "id bigint, text string, digest binary")
    assert {r.id: r["size"] for r in near_dup._sketched(rows).collect()} == {0: 300_000, 1: 18, 2: 150, 3: 0, 4: 0}


def test_long_words_in_small_tiles(spark):
    """Texts of a few huge words are compared over several tiles, and no link of theirs is lost."""
    words = [chr(97 + i) * 40_000 for i in range(26)]
    texts = [" ".join(words[:20] + [f"end{i}"]) for i in range(6)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    got = {r.doc_id: (r.class_id, r.links) for r in near_dup.near_duplicates(docs, tile_bytes=1 << 20).collect()}
    assert got == {i: (0, 5) for i in range(6)}  # 16 of 18 shingles are shared
