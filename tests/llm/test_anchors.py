"""Anchors and repeats in a text of over 2^24 bytes."""

import numpy as np

from cadenza.llm import anchors, substring_dedup

PAST = (1 << 24) + 5000


def long_text():
    """Random letters; 700 bytes of the beginning stand again past 2^24, and 900 bytes from there stand twice."""
    data = np.random.default_rng(8).integers(97, 123, PAST + 60_000).astype(np.uint8)
    data[PAST : PAST + 700] = data[3000:3700]
    data[PAST + 20_000 : PAST + 20_900] = data[PAST + 10_000 : PAST + 10_900]
    data[(1 << 24) - 300 : (1 << 24) + 300] = data[9000:9600]
    return data


def test_anchors_past_the_limit_are_those_of_the_tail():
    data = long_text()
    whole, at = anchors.find(data, np.array([0, len(data)])), (1 << 24) - 20_000
    tail = anchors.find(data[at:], np.array([0, len(data) - at]))
    found = {(g, p) for g, p in zip(whole.gram.tolist(), whole.place.tolist(), strict=True) if p >= at + 200}
    assert found == {(g, p + at) for g, p in zip(tail.gram.tolist(), tail.place.tolist(), strict=True) if p + at >= at + 200}
    assert whole.start[0] == 0 and whole.stop[-1] == len(data)
    assert (whole.start[1:] == whole.stop[:-1] - anchors.WIDTH + 1).all()  # each window has one owner


def test_repeats_past_the_limit_are_removed(spark):
    docs = spark.createDataFrame([(1, bytes(long_text()).decode()), (2, "short")], "doc_id bigint, text string")
    got = {r.doc_id: [(s.start, s.stop) for s in r.spans] for r in substring_dedup.remove_repeats(docs).select("doc_id", "spans").collect()}
    pairs = [(3000, 700), (9000, 600), ((1 << 24) - 300, 600), (PAST, 700), (PAST + 10_000, 900), (PAST + 20_000, 900)]
    assert got == {1: [(a, a + n) for a, n in pairs], 2: []}
