"""The pipeline's stages, one by one and together."""

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline as cp

SF = "/root/testdata/sf0.001"
COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="needs the driver's tables")

EN = "the of and with is in that for on by this which from or an as are was it"
DE = "der die und nicht mit ein ist auf von zu den im sich des auch als an es"


def sample(spark, extra=()):
    body = [f"w{i} {EN.split()[i % 19]}" for i in range(60)]
    long = " ".join(body)
    rows = [
        (1, long, "en", "a", 1), (2, long, "en", "a", 1), (2, long, "en", "a", 1), (3, " ".join([*body[:58], "other end"]), "en", "b", 1),
        (4, None, "en", "a", 0), (5, "", "de", "a", 0), (6, "1234 !?", "de", None, 7), (7, DE, "de", "a", 9), (None, DE + " mehr", None, "a", 9), (None, None, None, None, None),
        (9, "und " * 30_000, "de", "a", 9), (10, EN, "en", "c", 3),
    ]
    return spark.createDataFrame([*rows, *extra], COLUMNS).repartition(3)


def ids(df):
    return sorted((r.doc_id if r.doc_id is not None else -1) for r in df.collect())


def test_names():
    assert [n for n, _ in cp.STAGES] == ["language_id", "near_dedup", "decontaminate", "pieces"]


def test_language_id_drops_what_has_no_letter(spark):
    docs = sample(spark)
    kept = cp.language_id(spark, docs, SF)
    assert kept.columns == docs.columns and ids(kept) == [-1, 1, 2, 2, 3, 7, 9, 10]
    clash = docs.withColumn("lang_pred", F.lit("x")).withColumn("__lang_pred", F.lit(1)).withColumn("score", F.lit(2))
    again = cp.language_id(spark, clash, SF)
    assert again.columns == clash.columns and ids(again) == ids(kept) and again.select("__lang_pred").distinct().count() == 1
    assert cp.language_id(spark, docs.limit(0), SF).count() == 0


def test_language_id_follows_its_model(spark, monkeypatch):
    from kinquery.llm.language import LanguageModel

    docs = spark.createDataFrame([(1, "und und und", "de", "a", 1), (2, "und und", None, "a", 1), (3, "und the", None, "b", 1), (4, "1!", None, "b", 1)], COLUMNS)

    def model(*langs, prior=None):
        prob = np.full((len(langs), 1 << 8), -5.0, np.float32)
        return LanguageModel(list(langs), prob, np.log(np.array(prior or [1 / len(langs)] * len(langs))), 1 << 8)

    for found, want in ((model("de"), [(1, "de"), (2, "de"), (3, "de")]), (model("en"), [(1, "de"), (2, "en"), (3, "en")]), (model("de", "en", "fr"), []), (model("de", "en", prior=[0.3, 0.7]), [(1, "de"), (2, "en"), (3, "en")])):
        monkeypatch.setattr(cp, "learn", lambda *_, found=found: found)
        assert sorted((r.doc_id, r.lang) for r in cp.language_id(spark, docs, SF).collect()) == want


def test_near_dedup_keeps_one_of_each(spark):
    docs = sample(spark)
    kept = cp.near_dedup(spark, docs, SF)
    assert kept.columns == docs.columns and ids(kept) == [-1, -1, 1, 4, 6, 7, 9, 10]  # 2 and 3 are near copies of 1, 5 is empty as 4
    clash = docs.withColumn("rep", F.lit("x")).withColumn("fp", F.lit(1)).withColumn("n", F.lit(1)).withColumn("__id", F.lit(1))
    assert ids(cp.near_dedup(spark, clash, SF)) == ids(kept)
    assert cp.near_dedup(spark, docs.limit(0), SF).count() == 0


def test_decontaminate_drops_texts_with_an_item(spark):
    item = max(spark.read.parquet(f"{SF}/benchmark.parquet").collect(), key=lambda r: len(r.text or "")).text
    docs = sample(spark, [(20, f"before {item} after", "en", "a", 1), (21, item.upper(), "en", "a", 1)])
    kept = cp.decontaminate(spark, docs, SF)
    assert kept.columns == docs.columns and ids(kept) == ids(sample(spark))
    clash = docs.withColumn("__text", F.lit("x")).withColumn("item_id", F.lit(1))
    again = cp.decontaminate(spark, clash, SF)
    assert again.columns == clash.columns and ids(again) == ids(kept)
    assert cp.decontaminate(spark, docs.limit(0), SF).count() == 0


def test_pieces_equal_the_library(spark):
    import sentencepiece

    from kinquery.llm.registry import tokenizer_path

    sp = sentencepiece.SentencePieceProcessor(model_file=tokenizer_path("piece_bpe_32k.model"))
    docs = sample(spark).withColumn("ids", F.lit("clash")).withColumn("decoded", F.lit(1))
    want = sorted((r.doc_id or -1, len(i := sp.encode(r.text or "")), tuple(i), sp.decode(i)) for r in docs.collect())
    assert sorted((r.doc_id or -1, r.n_tokens, tuple(r.ids), r.decoded) for r in cp.pieces(spark, docs, SF).collect()) == want
    assert cp.pieces(spark, docs.limit(0), SF).count() == 0


def test_run_against_its_stages_by_hand(spark):
    """The whole run on the smallest tables: kept ids by plain Python."""
    import re

    out = cp.run(spark, SF)
    rows = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    items = [r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    kept = {r.doc_id: r.n_tokens for r in out.collect()}
    assert len(kept) == out.count() and set(kept) <= set(rows)
    lettered = {i for i, t in rows.items() if t and any(map(str.isalpha, t))}
    sets = {}
    for i in sorted(lettered):
        w = [re.sub("[A-Z]", lambda m: m[0].lower(), x) for x in re.findall("[^\x20\x09-\x0d]+", rows[i])]
        sets[i] = frozenset(tuple(w[j : j + 5]) for j in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)])
    for i in sorted(set(rows) - set(kept)):
        near = any(j != i and len(sets[i] & s) >= 0.8 * len(sets[i] | s) for j, s in sets.items()) if i in sets else False
        leak = any((words := re.findall(r"[^\W_]+", t.lower())) and " ".join(words[:5]) in " ".join(re.findall(r"[^\W_]+", (rows[i] or "").lower())) for t in items if t)
        assert i not in lettered or near or leak, i
    whole = sorted(kept)
    for a, i in enumerate(whole):
        for j in whole[a + 1 :]:
            assert len(sets[i] & sets[j]) < 0.8 * len(sets[i] | sets[j])
