"""Token coding, token files and packing: exact round trips."""

import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from cadenza.llm import packing, simple8b, token_files
from cadenza.llm.common import shared_path
from cadenza.llm.registry import tokenizer_path
from cadenza.llm.tokens import WordEncoder

ROWS = [(3, "It's a test, 12 éàÉ!"), (1, None), (2, ""), (7, "word " * 6000), (5, "<|endoftext|> x\n\ny"), (4, "\t a\x1cb"), (5, "again"), (None, "null id")]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, "doc_id bigint, text string").selectExpr("*", "1 AS ids", "2 AS start").repartition(3)


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokenizer_path())


def ids_of(tokenizer, text, end):
    return [*tokenizer.encode(text or "", add_special_tokens=False).ids, end]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.integers(0, 2**32 - 1), st.integers(0, 3), st.just(0)), max_size=3000))
def test_simple8b(ids):
    a = np.array(ids, dtype=np.uint32)
    coded = simple8b.encode(a)
    assert (simple8b.decode(coded) == a).all()
    assert (simple8b.decode(coded, 1, 2) == a[1024:2048]).all()
    assert len(coded.words) <= len(a)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet=st.one_of(st.characters(exclude_categories=["Cs"]), st.sampled_from("aB .'s!*<|é\n")), max_size=40), max_size=6))
def test_words_encode_as_whole_texts(texts):
    encoder = WordEncoder.__dict__.get("shared") or WordEncoder(tokenizer_path())
    WordEncoder.shared = encoder
    ids, offsets = encoder.encode(pa.array(texts, pa.string()))
    for i, t in enumerate(texts):
        assert ids[offsets[i] : offsets[i + 1]].tolist() == encoder.tokenizer.encode(t, add_special_tokens=False).ids


def test_token_files(spark, docs, tokenizer):
    path = shared_path(spark, "t")
    token_files.write_tokens(docs, path, tokenizer_path(), 2, frame_ids=50)
    got = sorted(token_files.read_tokens(spark, path).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in got] == sorted((i for i, _ in ROWS), key=lambda i: (i is not None, i or 0))
    start, by_id = 0, defaultdict(list)
    for i, t in ROWS:
        by_id[i].append(ids_of(tokenizer, t, 2))
    for r in got:
        ids = np.frombuffer(r.ids, "<u4").tolist()
        assert r.start == start and r.n_tokens == len(ids) and ids in by_id[r.doc_id]
        start += len(ids)
    sums = {(r.doc_id, r.ids_crc32) for r in token_files.read_checksums(spark, path).collect()}
    assert sums == {(r.doc_id, zlib.crc32(r.ids)) for r in got}


def test_first_fit_decreasing():
    r = np.random.default_rng(1)
    for n in (0, 1, 5, 300):
        sizes = r.integers(1, 101, n)
        bins, offsets = packing.first_fit_decreasing(sizes, 100)
        free: list[int] = []
        for i in np.argsort(-sizes, kind="stable"):
            at = next((k for k, room in enumerate(free) if room >= sizes[i]), len(free))
            if at == len(free):
                free.append(100)
            assert (bins[i], offsets[i]) == (at, 100 - free[at])
            free[at] -= sizes[i]


def test_pack(docs, tokenizer):
    pieces = packing.pack(docs, tokenizer_path(), 1, length=64, group_docs=3).collect()
    by_doc = defaultdict(list)
    for i, t in ROWS:
        by_doc[i].append(ids_of(tokenizer, t, 1))
    total = Counter(i for ds in by_doc.values() for d in ds for i in d)
    assert Counter(x for p in pieces for x in np.frombuffer(p.ids, "<u4").tolist()) == total
    for p in pieces:
        ids = np.frombuffer(p.ids, "<u4").tolist()
        assert len(ids) == p.length <= 64
        assert any(d[p.start : p.start + p.length] == ids and len(d) == p.doc_tokens for d in by_doc[p.doc_id])
    sequences = defaultdict(list)
    for p in pieces:
        sequences[p.sequence_id].append((p.offset, p.length))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 64


def test_repeated_rows_spread_over_groups(spark):
    rows = [(None, "one two three")] * 300 + [(7, f"text {i}") for i in range(100)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").selectExpr("*", "1 AS start", "2 AS length").repartition(8)
    pieces = packing.pack(docs, tokenizer_path(), 1, length=32, group_docs=40).collect()
    groups = Counter(p.sequence_id >> 32 for p in pieces)
    assert len(pieces) == 400 and len(groups) == 10 and max(groups.values()) < 120
    room = Counter()
    for p in pieces:
        room[p.sequence_id] += p.length
    assert sum(room.values()) > 0.9 * 32 * len(room)  # little padding


def test_other_tokenizers_encode_whole_texts():
    import public_tokenizers

    path = str(public_tokenizers.path("byte_bpe_50k.json"))
    coder, plain = WordEncoder(path), Tokenizer.from_file(path)
    texts = ["two  spaces\n\tand tabs", None, "", "Wörter 123 <|endoftext|> it's"]
    ids, offsets = coder.encode(pa.array(texts))
    assert not coder.by_words
    for i, t in enumerate(texts):
        assert ids[offsets[i] : offsets[i + 1]].tolist() == plain.encode(t or "", add_special_tokens=False).ids


def test_empty(spark):
    none = spark.createDataFrame([], "doc_id bigint, text string")
    assert packing.pack(none, tokenizer_path(), 1).count() == 0
    assert token_files.round_trip(none, tokenizer_path(), 2).count() == 0


def test_pack_of_many_equal_rows_in_one_split(spark):
    """Equal rows are dealt over groups that stay bounded, whatever splits they lie in."""
    rows = spark.range(20_000).coalesce(1).selectExpr("cast(5 as bigint) AS doc_id", "'one two three' AS text")
    pieces = packing.pack(rows, tokenizer_path(), 1).select("doc_id", "length", "offset", (packing.F.col("sequence_id") / 2**32).cast("bigint").alias("g"), "sequence_id").collect()
    sizes = Counter(p.g for p in pieces)
    assert len(pieces) == 20_000 and 8 <= len(sizes) <= 10 and max(sizes.values()) < 2 * 2048
    assert len({p.sequence_id for p in pieces}) <= sum(p.length for p in pieces) / 2048 + len(sizes)


def test_pack_is_the_same_for_other_splits(spark):
    rows = [(i % 90, f"text {i % 70} " * (i % 400)) for i in range(300)]
    frame = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = [Counter(tuple(r) for r in packing.pack(frame.repartition(n), tokenizer_path(), 1, length=128, group_docs=64).collect()) for n in (1, 7)]
    assert got[0] == got[1]
