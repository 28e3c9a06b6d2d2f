"""op1 and op4: Simple-8b round trips, exact encoding, stores and histograms."""

import random
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from kinquery.llm import simple8b
from kinquery.llm.bpe_text import CachedEncoder
from kinquery.llm.registry import tokenizer_path

FILE = tokenizer_path("byte_bpe_50k.json")


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.integers(0, 3), st.integers(0, 60_000), st.integers(0, 2**64 - 1)), max_size=700))
def test_words_round_trip(ids):
    words, offsets, escapes = simple8b.encode(np.array(ids, dtype=np.uint64))
    assert simple8b.decode(words, offsets, escapes, len(ids)).tolist() == ids
    assert len(offsets) == -(-len(ids) // simple8b.BLOCK) + 1 and len(escapes) == sum(i >= 2**60 for i in ids)


def test_small_ids_are_packed():
    words, _, _ = simple8b.encode(np.zeros(256, dtype=np.uint64))
    assert len(words) == 5  # four times sixty and sixteen
    words, _, _ = simple8b.encode(np.full(256, 30_000, dtype=np.uint64))
    assert len(words) == 64


def test_blocks_can_be_read_alone():
    ids = np.random.default_rng(1).integers(0, 50_000, 2000).astype(np.uint64)
    words, offsets, escapes = simple8b.encode(ids)
    a, b = int(offsets[3]), int(offsets[4])
    one = simple8b.decode(words[a:b], np.array([0, b - a]), escapes, 256)
    assert one.tolist() == ids[3 * 256 : 4 * 256].tolist()


def test_segments_keep_null_ids_and_empty_documents():
    ids = np.array([5, 6, 7], dtype=np.uint64)
    blob = simple8b.pack([None, -4, 9], np.array([1, 0, 2]), ids)
    keys, lengths, back = simple8b.unpack(blob)
    assert keys == [None, -4, 9] and lengths.tolist() == [1, 0, 2] and back.tolist() == [5, 6, 7]
    with pytest.raises(ValueError):
        simple8b.unpack(b"X" + blob[1:])


def odd_texts(n, seed):
    rnd = random.Random(seed)
    parts = ["a", "the", "Foo", "é", "x1", " ", "  ", "\n", "\n\n", " \n", "\t", ".", ",", "%%%", "'s", "'", " ", "\x1c", "日本", "🙂", "<|endoftext|>", "\r\n", "9", "ǅ", "ʰ", "foo", " bar", " "]
    return ["".join(rnd.choice(parts) for _ in range(rnd.randint(0, 30))) for _ in range(n)]


def test_cut_texts_encode_as_whole_ones():
    enc = CachedEncoder(FILE, max_parts=300)
    texts = odd_texts(3000, 5)
    got = []
    for lo in range(0, len(texts), 100):
        got += enc.encode(texts[lo : lo + 100])
    want = [e.ids for e in enc.tokenizer.encode_batch(texts, add_special_tokens=False)]
    assert [np.frombuffer(g, "<u4").tolist() for g in got] == want


def test_store_against_the_library(spark, tmp_path):
    from kinquery.llm.token_store import read_tokens, token_digests, write_tokens

    texts = odd_texts(60, 7) + [None, "", "long " * 40_000]
    rows = [(i * 3 - 20, t, "x") for i, t in enumerate(texts)] + [(1, texts[7], "again"), (None, "no id", "n")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, start string").repartition(5)
    write_tokens(docs, str(tmp_path / "t"), FILE, 2, segment_ids=500)
    enc = CachedEncoder(FILE).tokenizer
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or ""))
    want, at = [], 0
    for key, text, _ in order:
        ids = [*enc.encode(text or "", add_special_tokens=False).ids, 2]
        want.append((key, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    got = sorted(token_digests(spark, str(tmp_path / "t")).collect(), key=lambda r: r.start)
    assert [tuple(r) for r in got] == want
    back = read_tokens(spark, str(tmp_path / "t")).orderBy("part", "seq", "pos").collect()
    assert [(r.doc_id, len(r.ids)) for r in back] == [(w[0], w[2]) for w in want]


def test_empty_store(spark, tmp_path):
    from kinquery.llm.token_store import token_digests, write_tokens

    write_tokens(spark.createDataFrame([], "doc_id long, text string"), str(tmp_path / "e"), FILE, 2)
    assert token_digests(spark, str(tmp_path / "e")).count() == 0


def test_limits_by_brute_force(spark):
    from kinquery.llm.token_counts import context_limits, length_histogram, quantile, token_lengths

    rnd = random.Random(2)
    sizes = [rnd.choice([0, 3, 3, 7, 1500, 5000, rnd.randint(0, 4000)]) for _ in range(300)]
    limits = context_limits(length_histogram(spark.createDataFrame([(s,) for s in sizes], "n_tokens long")))
    rows = {r.context_limit: r for r in limits.collect()}
    assert set(rows) == set(sizes)
    for limit, r in rows.items():
        assert r.n_docs == sizes.count(limit) and r.docs_over == sum(s > limit for s in sizes) and r.docs_total == 300
        assert r.tokens_within == sum(s for s in sizes if s <= limit) and r.tokens_truncated == sum(min(s, limit) for s in sizes) and r.tokens_total == sum(sizes)
    assert quantile(limits, 0.5) == sorted(sizes)[149] and quantile(limits, 1.0) == max(sizes)
    docs = spark.createDataFrame([(1, "a b", 5), (2, None, 6), (3, "", 7)], "doc_id long, text string, n_tokens long").drop("n_tokens")
    assert sorted(map(tuple, token_lengths(docs, FILE, ["doc_id"]).collect())) == [(1, 2), (2, 0), (3, 0)]
    none = context_limits(length_histogram(spark.createDataFrame([], "n_tokens long")))
    assert none.count() == 0 and quantile(none, 0.5) is None


def test_added_tokens_are_those_of_the_library():
    from tokenizers import Tokenizer

    fresh, enc = Tokenizer.from_file(FILE), CachedEncoder(FILE, max_parts=300)
    texts = ["one <|endoftext|> two", "<|endoftext|>", "a<|endoftext|>b c", "one two", "x\n<|endoftext|>\ny", "<|endoftext|> one two", *odd_texts(1000, 6)]
    for _ in range(2):  # the second time from kept parts
        got = [np.frombuffer(b, "<u4").tolist() for b in enc.encode(texts)]
        assert got == [fresh.encode(t, add_special_tokens=False).ids for t in texts]
    assert got[0] == [505, 220, 50256, 734]
