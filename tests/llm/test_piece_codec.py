"""op3: exact equality with the sentencepiece library, both ways."""

import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from kinquery.llm.piece_codec import PieceCodec, decode_documents, encode_documents
from kinquery.llm.registry import tokenizer_path

MODEL = tokenizer_path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def both():
    import sentencepiece

    return PieceCodec(MODEL, max_words=2000), sentencepiece.SentencePieceProcessor(model_file=MODEL)


def same(both, texts):
    mine, sp = both
    got = [np.frombuffer(x, "<i4") for x in mine.encode(texts)]
    want = [sp.encode(t) for t in texts]
    assert [g.tolist() for g in got] == want
    assert mine.decode(got) == [sp.decode(w) for w in want]


@settings(max_examples=150, deadline=None)
@given(text=st.text(max_size=60))
def test_any_text(both, text):
    same(both, [text])


@settings(max_examples=100, deadline=None)
@given(text=st.text(alphabet="ab h▁ \n<s>é1=-", max_size=80))
def test_runs_and_overlaps(both, text):
    same(both, [text])


def test_awkward_texts(both):
    rnd = random.Random(4)
    same(both, ["", " ", "     ", "▁", "▁▁ a", "<s></s><unk><0x0A>", "aaaaaaaaa", "ababababab", "=" * 300, "x" * 5000, "日本語 テキスト", "🙂🙃", "a\x00b", "é", " " * 999 + "x"])
    same(both, ["".join(rnd.choice("abcdefghinorstuéè ") for _ in range(rnd.randint(1, 200))) for _ in range(500)])
    same(both, [" ".join("".join(rnd.choice("abcdhinorst") for _ in range(rnd.randint(1, 12))) for _ in range(30_000))])


def test_ids_of_no_text(both):
    mine, sp = both
    rnd = random.Random(5)
    lists = [[rnd.randrange(32_000) if rnd.random() < 0.5 else rnd.randrange(300) for _ in range(rnd.randint(0, 12))] for _ in range(400)]
    assert mine.decode([np.array(x, dtype=np.int64) for x in lists]) == [sp.decode(x) for x in lists]
    with pytest.raises(ValueError):
        mine.decode([np.array([32_000])])


def test_frames(spark, both):
    rows = [(1, "Hello  world\n", "a"), (1, "Hello  world\n", "a"), (2, None, "b"), (None, "", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    out = encode_documents(docs, MODEL, decoded="back")
    got = out.collect()
    assert out.columns == ["doc_id", "text", "lang", "ids", "back"] and len(got) == 4
    for r in got:
        assert r.ids == both[1].encode(r.text or "") and r.back == (r.text or "")
    again = decode_documents(encode_documents(docs, MODEL).drop("text"), MODEL).collect()
    assert sorted(r.decoded for r in again) == sorted(t or "" for _, t, _ in rows)
    assert decode_documents(spark.createDataFrame([(None,)], "ids array<int>"), MODEL).collect()[0].decoded == ""
    assert encode_documents(docs.limit(0), MODEL).count() == 0
    clash = encode_documents(docs.withColumnRenamed("lang", "ids"), MODEL)
    assert clash.columns == ["doc_id", "text", "ids"] and sorted(map(len, (r.ids for r in clash.collect()))) == sorted(len(r.ids) for r in got)
    assert decode_documents(out.withColumnRenamed("lang", "decoded"), MODEL).columns == ["doc_id", "text", "ids", "back", "decoded"]
    with pytest.raises(ValueError):
        encode_documents(docs, MODEL, ids="text")
