"""Exact deduplication, sharding and WARC against brute force, with odd rows."""

import base64
import gzip
import hashlib
import os
import zlib
from collections import Counter

import numpy as np
import pytest

from cadenza.llm import exact_dedup, sharding, warc
from cadenza.llm.common import shared_path

ROWS = [(1, "a", "x"), (2, "a", None), (3, None, "y"), (4, "", "z"), (5, "b" * 200_000, None), (6, "é", "q"), (7, "a ", "r"), (6, "é", "q"), (None, "a", "s"), (None, "n", "t")]
SCHEMA = "doc_id bigint, text string, keep_id string"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, SCHEMA).repartition(3).cache()


def test_copy_report(docs):
    groups: dict[str, list] = {}
    for i, t, _ in ROWS:
        groups.setdefault(t or "", []).append(i)
    want = Counter()
    for i, t, _ in ROWS:
        best = max((g for g in groups[t or ""] if g is not None), default=None)
        want[(i, best, len(groups[t or ""]), i == best, hashlib.sha256((t or "").encode()).hexdigest())] += 1
    got = Counter((r.doc_id, r.keep_id, r.group_size, r.kept, r.text_sha256) for r in exact_dedup.copy_report(docs, salts=2).collect())
    assert got == want


def test_drop_copies(docs):
    got = {(r.doc_id, r.text, r.keep_id) for r in exact_dedup.drop_copies(docs).collect()}
    assert got == {(2, "a", None), (4, "", "z"), (5, "b" * 200_000, None), (6, "é", "q"), (7, "a ", "r"), (None, "n", "t")}


def test_native(docs):
    plan = exact_dedup.copy_report(docs)._jdf.queryExecution().toString() + exact_dedup.drop_copies(docs)._jdf.queryExecution().toString()
    assert not any(word in plan for word in ("Python", "Arrow", "Pandas"))


def test_empty(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert exact_dedup.copy_report(none).count() == 0
    assert exact_dedup.drop_copies(none).count() == 0
    assert sharding.shard_rows(none).count() == 0
    assert warc.round_trip(spark.createDataFrame([], "page_id bigint, url string, html string")).count() == 0


def test_jump_hash_moves_only_into_the_new_shard():
    keys = np.random.default_rng(3).integers(0, 2**63, 50_000, dtype=np.uint64)
    for n in (1, 2, 7, 16, 100):
        a, b = sharding.jump_hash(keys, n), sharding.jump_hash(keys, n + 1)
        assert ((a == b) | (b == n)).all()
        assert np.bincount(a, minlength=n).min() > 0.8 * len(keys) / n
        assert abs((b == n).mean() - 1 / (n + 1)) < 0.02


def jumped(key, shards):
    """Jump consistent hashing, one key at a time."""
    at, jump = -1, 0
    while jump < shards:
        at = jump
        key = (key * 2862933555777941757 + 1) % 2**64
        jump = int((at + 1) * (2.0**31 / ((key >> 33) + 1)))
    return at


def test_shards_by_definition(spark):
    rows = [(i, "t" * (i % 7)) for i in range(300)] + [(None, f"n{i % 5}") for i in range(200)] + [(9, "same")] * 150
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").selectExpr("*", "1 AS shard", "2 AS slot", "3 AS size").repartition(4)
    got = sharding.shard_rows(docs, rows_per_bucket=1).collect()
    key = lambda i: int(hashlib.md5(("" if i is None else str(i)).encode()).hexdigest()[:15], 16)
    want = Counter((i, len(t) + 1, zlib.crc32(t.encode()), jumped(key(i), 16), jumped(key(i), 17)) for i, t in rows)
    assert Counter((r.doc_id, r["size"], r.text_crc32, r.shard, r.grown_shard) for r in got) == want
    for s in range(16):
        assert sorted(r.slot for r in got if r.shard == s) == list(range(sum(r.shard == s for r in got)))


def test_shard_rows(docs):
    rows = sharding.shard_rows(docs, shards=4, rows_per_bucket=1).collect()
    assert Counter(r.doc_id for r in rows) == Counter(i for i, *_ in ROWS)
    sizes = {i: len((t or "").encode()) + 1 for i, t, _ in ROWS if i is not None}
    assert all(r["size"] == sizes[r.doc_id] for r in rows if r.doc_id is not None)
    assert all(r.text_crc32 == zlib.crc32("é".encode()) for r in rows if r.doc_id == 6)
    for s in range(4):
        slots = sorted(r.slot for r in rows if r.shard == s)
        assert slots == list(range(len(slots)))
    assert all(r.grown_shard in (r.shard, 4) and r.law == "key" for r in rows)


PAGES = [(1, "http://a", "<p>x</p>"), (2, None, "<p>x</p>"), (3, "http://c\r\nX: y", ""), (4, "http://d", None), (5, "u", "WARC/1.1\r\nContent-Length: 3\r\n\r\n"), (6, "v", "é" * 50_000), (6, "v", "é" * 50_000), (None, "w", "only")]


def test_warc(spark):
    pages = spark.createDataFrame(PAGES, "page_id bigint, url string, html string").selectExpr("*", "'z' AS payload_digest")
    got = Counter(tuple(r) for r in warc.round_trip(pages, archive_bytes=1 << 16).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect())
    digest = lambda t: base64.b32encode(hashlib.sha1((t or "").encode()).digest()).decode()
    best: dict[str, int] = {}
    for i, _, t in PAGES:
        best[t or ""] = max(best.get(t or "", i if i is not None else -1), i if i is not None else -1)
    want = Counter()
    for i, _, t in PAGES:
        first = best[t or ""] in (i, -1)
        want[(i, len((t or "").encode()), digest(t), "response" if first else "revisit", None if first else best[t or ""])] += 1
    assert got == want


def test_warc_records(spark):
    path = shared_path(spark, "w")
    pages = spark.createDataFrame(PAGES, "page_id bigint, url string, html string")
    warc.write_archives(pages, path, min_bytes=1)
    records = warc.read_archives(spark, path).collect()
    assert {r.record_type for r in records} == {"warcinfo", "response", "revisit"} and all(r.intact for r in records if r.record_type == "response")
    assert sum(r.record_type == "revisit" for r in records) == 1  # the two empty pages are both responses
    for r in records:
        if r.record_type == "response":
            assert r.header_digest == r.payload_digest
            assert bytes(r.payload).decode() in {t or "" for _, _, t in PAGES}
    assert len({r.record_id for r in records if r.page_id or r.record_type == "response"}) == len(PAGES) - 1


def record(kind, payload, **fields):
    block = b"HTTP/1.1 200 OK\r\n\r\n" + payload
    head = "".join(f"{k.replace('_', '-')}: {v}\r\n" for k, v in fields.items())
    return f"WARC/1.0\r\nwarc-type: {kind}\r\n{head}Content-Length: {len(block)}\r\n\r\n".encode() + block + b"\r\n\r\n"


def test_archives_of_other_writers(spark):
    payloads = [b"first", b"\0" * 3_000_000, b"third\r\n\r\nWARC/1.0", b""]
    right = lambda x: "sha1:" + base64.b32encode(hashlib.sha1(x).digest()).decode()
    records = [record("response", p, WARC_Payload_Digest=right(p), WARC_Record_ID=f"<{k}>") for k, p in enumerate(payloads)]
    plain = b"".join(records)
    for data in (plain, gzip.compress(plain), b"".join(map(gzip.compress, records)), gzip.compress(plain[:50]) + gzip.compress(plain[50:])):
        got = list(warc.parse_records(data))
        assert [r["payload"] for r in got] == payloads and all(r["intact"] for r in got) and [r["record_id"] for r in got] == ["<0>", "<1>", "<2>", "<3>"]
    packed = gzip.compress(records[0])
    for broken in (packed[:-12], packed + b"rest", plain[:-30], gzip.compress(plain + b"more")):
        with pytest.raises((ValueError, zlib.error)):
            list(warc.parse_records(broken))
    assert [r["intact"] for r in warc.parse_records(record("response", b"x", WARC_Payload_Digest=right(b"y")) + record("request", b"x"))] == [False, None]
    assert len(warc._member(b"a" * 20_000_000)) and b"".join(warc.inflate(warc._member(b"a" * 20_000_000))) == b"a" * 20_000_000
    assert warc._member(b"a" * ((16 << 20) + 1))[-1] == 0


def test_long_payloads(spark):
    pages = spark.createDataFrame([(1, "u", "é" * 9_000_000), (2, "v", "x")], "page_id bigint, url string, html string")
    assert {(r.page_id, r.payload_bytes) for r in warc.round_trip(pages).collect()} == {(1, 18_000_000), (2, 1)}


def test_release(spark):
    from cadenza.llm.common import materialize, release

    kept = materialize(spark.range(5), "r")
    assert kept.count() == 5
    release(spark)
    assert not [f for f in kept.inputFiles() if os.path.exists(f.removeprefix("file://"))]


def test_stated_digests():
    own = hashlib.sha1(b"x")
    bare = base64.b32encode(own.digest()).decode()
    for written in (f"sha1:{bare}", f"SHA1:{bare.lower()}", f"sha1:{own.hexdigest()}", f" sha1: {own.hexdigest().upper()} "):
        assert warc.stated_digest(written) == bare
    assert [warc.stated_digest(x) for x in (None, "", "sha1:", "SHA-256:Ab", "sha1:" + "g" * 40)] == [None, None, None, "sha-256:Ab", "G" * 40]


def test_revisits_of_other_writers(spark, tmp_path):
    """Revisits by record id, by digest alone, by another algorithm's digest, and those that lead nowhere, over two archives."""
    hexadecimal, bare = (lambda x: "sha1:" + hashlib.sha1(x).hexdigest()), (lambda x: base64.b32encode(hashlib.sha1(x).digest()).decode())
    of = {"WARC_Refers_To_Target_URI": "http://a/", "WARC_Refers_To_Date": "2020-01-01T00:00:00Z"}
    first = [
        record("response", b"one", WARC_Record_ID="<r1>", WARC_Payload_Digest=hexadecimal(b"one"), X_Page_ID=1),
        record("response", b"one", WARC_Record_ID="<r2>", WARC_Payload_Digest="sha1:" + bare(b"one").lower(), X_Page_ID=2),
        record("response", b"two!", WARC_Record_ID="<r3>", WARC_Payload_Digest="sha256:" + hashlib.sha256(b"two!").hexdigest()),
        record("response", b"", X_Page_ID=4),
    ]
    second = [
        record("revisit", b"", WARC_Record_ID="<v1>", WARC_Payload_Digest=hexadecimal(b"one").upper().replace("SHA1", "sha1"), X_Page_ID=11, **of),
        record("revisit", b"", WARC_Record_ID="<v2>", WARC_Payload_Digest="sha1:" + bare(b"one"), WARC_Refers_To="<r1>", X_Page_ID=12),
        record("revisit", b"", WARC_Payload_Digest="SHA256:" + hashlib.sha256(b"two!").hexdigest(), X_Page_ID=13, **of),
        record("revisit", b"", WARC_Record_ID="<v4>", WARC_Payload_Digest=hexadecimal(b"nowhere"), X_Page_ID=14, **of),
        record("revisit", b"", WARC_Record_ID="<v5>", X_Page_ID=15),
        record("request", b"", WARC_Record_ID="<q>"),
    ]
    (tmp_path / "a.warc").write_bytes(b"".join(first))
    (tmp_path / "b.warc.gz").write_bytes(b"".join(map(gzip.compress, second)))
    got = Counter(tuple(r) for r in warc.resolve_revisits(warc.read_archives(spark, str(tmp_path), payloads=False)).collect())
    one, two = (3, bare(b"one")), (4, bare(b"two!"))
    assert got == Counter([
        (1, *one, "response", None), (2, *one, "response", None), (None, *two, "response", None), (4, 0, bare(b""), "response", None),
        (11, *one, "revisit", 2), (12, *one, "revisit", 1), (13, *two, "revisit", None), (14, None, None, "revisit", None), (15, None, None, "revisit", None),
    ])


def test_many_revisits_by_digest(spark, tmp_path):
    """A payload that most records revisit by its digest is told once for each of them."""
    digest = "sha1:" + hashlib.sha1(b"hot").hexdigest()
    records = [record("response", b"hot", WARC_Record_ID="<r>", WARC_Payload_Digest=digest, X_Page_ID=0)]
    records += [record("revisit", b"", WARC_Record_ID=f"<v{i}>", WARC_Payload_Digest=digest, X_Page_ID=i) for i in range(1, 3000)]
    (tmp_path / "a.warc").write_bytes(b"".join(records))
    rows = warc.resolve_revisits(warc.read_archives(spark, str(tmp_path), payloads=False)).collect()
    assert len(rows) == 3000 and {(r.payload_bytes, r.refers_to) for r in rows} == {(3, None), (3, 0)}
