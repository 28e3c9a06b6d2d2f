"""Sources, sinks, votes, shapes and retrieval on small inputs."""

import json

import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from kinquery.operators import evaluation as E
from kinquery.operators import retrieval as R
from kinquery.operators import shapes as S
from kinquery.operators import votes as V
from kinquery.sources import records


def test_votes(spark):
    votes = spark.createDataFrame([(1, "A, b"), (1, "a"), (1, "c,a,a"), (2, "x"), (2, "y"), (3, None), (3, "")], "q int, pred string")
    got = {r.q: (r.pred, r.error) for r in V.majority(votes, ["q"]).collect()}
    assert got == {1: ("a", None), 2: ("", "No majority vote"), 3: ("", None)}


def test_usage(spark):
    rows = [(1, '{"a": 1, "b": {"c": 2, "d": null}}'), (1, '{"a": null, "b": {"c": 5}}'), (1, None), (2, "{}")]
    got = {(r.q, r.path): r.total for r in V.usage_sum(spark.createDataFrame(rows, "q int, usage string"), ["q"]).collect()}
    assert got == {(1, "a"): 1.0, (1, "b.c"): 7.0, (1, "b.d"): 0.0}
    deep = '{"k":' * 9 + '{"n": 3, "s": "}{"}' + "}" * 9
    found = V.usage_sum(spark.createDataFrame([(1, deep), (1, deep)], "q int, usage string"), ["q"]).collect()
    assert {(r.path, r.total) for r in found} == {("k." * 9 + "n", 6.0), ("k." * 9 + "s", 0.0)}
    assert V.usage_sum(spark.createDataFrame([(1, None)], "q int, usage string"), ["q"]).count() == 0


def test_scores_of_odd_answers(spark):
    rows = [("a, B", ["b", "A"]), ("", ["x"]), (None, [""]), ("a,b,c", ["a,b"]), ("z", ["a", "b"])]
    got = [(r.EM, r.precision, r.recall, round(r.f1, 4)) for r in E.scored(spark.createDataFrame(rows, "pred string, true array<string>").coalesce(1)).collect()]
    assert got == [(True, 1.0, 1.0, 1.0), (False, 0.0, 0.0, 0.0), (True, 1.0, 1.0, 1.0), (False, 2 / 3, 1.0, 0.8), (False, 0.0, 0.0, 0.0)]


def test_single_rows_have_no_error(spark):
    df = spark.createDataFrame([("m", 1, 1, 0.5)], "_model string, _data_seed int, _seed int, f1 double")
    assert E.accuracy(df, ["_model"], ("f1",)).collect()[0].f1_std is None


def test_pivot_orders_keys_and_columns(spark):
    df = spark.createDataFrame([("b", 10, 1.0), ("a", 9, 2.0), ("c", 9, 3.0)], "_model string, _depth int, v double")
    out = E.pivoted(df, "_depth", "v", order=["c", "a", "nobody"])
    assert out.columns == ["_model", "9", "10"] and [tuple(r) for r in out.collect()] == [("c", 3.0, None), ("a", 2.0, None)]


def test_prediction_files(spark, tmp_path):
    record = {"true": ["a"], "pred": "a", "prolog_query": None, "error": None, "interaction": [], "metadata": {"model": "m", "dataset": "d", "split": "depth_10_size_50_seed_1", "batch_size": 10, "batch_number": 2, "type": 1, "difficulty": 3}, "inference_params": {"seed": 4, "max_tokens": 9}, "usage": {"tokens": 5}}
    folder = tmp_path / "preds"
    folder.mkdir()
    (folder / "split=x__bn=2.json").write_text(json.dumps({"q1": record, "q2": {**record, "pred": "b"}}))
    (folder / "split=x__bn=10.json").write_text(json.dumps({"q3": {**record, "interaction": {"messages": [{"role": "user", "content": [{"type": "text", "text": "hi"}]}], "uid": "u"}}}))
    got = {r.id: r for r in records.read_predictions(spark, str(folder)).collect()}
    assert set(got) == {"q1", "q2", "q3"} and got["q1"].batch_in_name == 2 and got["q3"].batch_in_name == 10
    assert got["q1"]._seed == 4 and got["q1"]._split == "depth_10_size_50_seed_1" and got["q1"].interaction is None and got["q3"].interaction.messages[0].role == "user"
    qa = spark.createDataFrame([("q1", "Who?"), ("q9", "What?")], "id string, question string")
    rows = {r.id: r for r in E.scored(E.with_questions(records.read_predictions(spark, str(folder)), qa)).collect()}
    assert rows["q1"].question == "Who?" and rows["q2"].question is None and rows["q2"].EM is False and rows["q1"]._depth == 10 and rows["q1"]._size == 50

    from kinquery.streaming import arriving_predictions, score_arriving

    seen = {}
    put = lambda df, n: seen.update({r.id: r.EM for r in df.collect()})
    score_arriving(arriving_predictions(spark, str(folder)), qa, put, str(tmp_path / "state"), once=True).awaitTermination(60)
    assert seen == {"q1": True, "q2": False, "q3": True}


def test_splits_and_depth_subset(spark, tmp_path):
    from kinquery.functions.templates import templates

    base = tmp_path / "data"
    split = base / "depth_10_size_25_seed_1"
    (split).mkdir(parents=True)
    (base / ".hidden").mkdir()
    small, large = templates(6)[0], templates(10)[0]
    rows = [{"id": str(i), "question": q, "solution_traces": "[]", "answer": ["x"], "prolog": {"query": list(t.goals), "answer": t.answer}, "template": list(t.question), "type": i, "difficulty": 2} for i, (q, t) in enumerate([("Who is it?", small), ("How many it?", large)])]
    (split / "questions.json").write_text(json.dumps(rows))
    (split / "articles.json").write_text(json.dumps([{"title": "A", "article": "# A\n", "facts": ["x."]}]))
    (split / "facts.pl").write_text('job("a", "b").\n')
    assert [n for n, _ in records.splits_below(spark, str(base))] == ["depth_10_size_25_seed_1"]
    whole = records.load_split(spark, str(base), "depth_10_size_25_seed_1")
    assert whole["qa_pairs"].count() == 2 and whole["text_corpus"].collect()[0].split == "depth_10_size_25_seed_1" and "job" in whole["database"].collect()[0].content
    part = records.load_split(spark, str(base), "depth_6_size_25_seed_1")
    assert [r.id for r in part["qa_pairs"].collect()] == ["0"]
    assert records.load_split(spark, str(base), "depth_10_size_25_seed_1", True)["qa_pairs"].count() == 1
    with pytest.raises(ValueError):
        records.load_split(spark, str(base), "depth_20_size_25_seed_1")


def test_small_sources_and_sinks(spark, tmp_path):
    (tmp_path / "limits.yaml").write_text("openai:\n  gpt-x:  # one\n    usage_tier=1:\n      RPM: 500\n      TPM: 30_000\n    usage_tier=2:\n      RPM: 5000\n      TPM: 9\ntogether:\n  default:\n    usage_tier=1:\n      RPM: 60\n      TPM: 7\n")
    limits = records.read_limits(spark, str(tmp_path / "limits.yaml"))
    assert {(r.server, r.model, r.tier, r.rpm, r.tpm) for r in limits.collect()} == {("openai", "gpt-x", 1, 500, 30000), ("openai", "gpt-x", 2, 5000, 9), ("together", "default", 1, 60, 7)}
    models = spark.createDataFrame([("OpenAI", "GPT-X", 2), ("together", "any", 1), ("openai", "none", 1)], "server string, model string, tier int")
    assert {r.model: r.rpm for r in S.limits_for(models, limits, "together").collect()} == {"GPT-X": 5000, "any": 60, "none": None}
    (tmp_path / "hobbies.csv").write_text("Hobby-name,Type\nChess,In\nRowing,Out\nBridge,In\n")
    assert {r.category: r.hobbies for r in records.read_hobbies(spark, str(tmp_path / "hobbies.csv")).collect()} == {"In": ["bridge", "chess"], "Out": ["rowing"]}
    (tmp_path / "c.jsonl").write_text(json.dumps({"id": "1", "contents": '"Ann Lee"\nBody\nmore'}) + "\n")
    assert [tuple(r)[:3] for r in records.read_passages(spark, str(tmp_path / "c.jsonl")).collect()] == [("1", "ann lee", "Body\nmore")]
    df = spark.createDataFrame([("a", 1), ("a", 2), ("b", 3)], "g string, v int")
    assert S.text_table(df, "g", "latex").splitlines() == [r"g & v \\", r"\midrule", r"a & 1 \\", r"a & 2 \\", r"\midrule", r"b & 3 \\"]
    records.write_scores(df, str(tmp_path / "scores"))
    assert records.read_scores(spark, str(tmp_path / "scores")).count() == 3
    preds = spark.createDataFrame([("q", "x")], "id string, pred string")
    records.write_predictions(preds, str(tmp_path / "p"))
    records.write_predictions(preds.unionByName(preds), str(tmp_path / "p"))
    assert spark.read.json(str(tmp_path / "p")).count() == 1
    records.write_predictions(preds.unionByName(preds), str(tmp_path / "p"), force=True)
    assert spark.read.json(str(tmp_path / "p")).count() == 2
    t = records.Timings()
    with t.stage("facts"):
        pass
    t.write(spark, str(tmp_path / "t"))
    assert spark.read.csv(str(tmp_path / "t"), header=True).columns == ["facts", "total"]
    art = spark.createDataFrame([("A b", "# A b\n", ["x."])], "title string, article string, facts array<string>")
    records.write_articles(art, str(tmp_path / "art"), "txt")
    assert spark.read.text(str(tmp_path / "art/articles")).where("title = 'A b'").count() >= 1
    records.export_passages(art, str(tmp_path / "jsonl"))
    assert spark.read.json(str(tmp_path / "jsonl")).collect()[0].contents == '"A b"\n# A b\n'


def test_retrieval_in_blocks_and_ties(spark, monkeypatch):
    docs = spark.createDataFrame([(i, [float(i % 3), 1.0]) for i in range(9)], "doc_id int, vector array<double>")
    queries = spark.createDataFrame([(q, [1.0, 0.5 * q]) for q in range(4)], "query_id int, query_vector array<double>")
    whole = sorted(map(tuple, R.dense(docs, queries, 3).collect()))
    monkeypatch.setattr(R, "BROADCAST_BYTES", 40)
    assert sorted(map(tuple, R.dense(docs, queries, 3).collect())) == whole
    assert [r.doc_id for r in R.dense(docs, queries.where("query_id = 0"), 3).orderBy("rank").collect()] == [2, 5, 8]
    with pytest.raises(ValueError):
        R.matching(docs.withColumn("text", F.lit("x")), "a(b")


def test_bm25_prefers_rare_words(spark):
    docs = spark.createDataFrame([(1, "the cat sat"), (2, "the dog sat"), (3, "the the the"), (4, None)], "doc_id int, text string")
    q = spark.createDataFrame([(1, "The dog, the DOG"), (2, "nothing here")], "query_id int, query string")
    got = [(r.query_id, r.doc_id) for r in R.bm25(docs, q, 2).orderBy("query_id", "rank").collect()]
    assert got[0] == (1, 2) and len(got) == 2


def test_histograms_close_their_last_bin(spark):
    df = spark.createDataFrame([(1.0,), (19.5,), (20.0,), (20.5,), (0.5,), (None,)], "v double")
    assert {r.bin: r.n for r in S.integer_histogram(df, "v").collect()} == {1: 1, 19: 2}
    rows = S.equal_width_histogram(df, "v", 4).collect()
    assert sum(r.n for r in rows) == 5 and max(r.bin for r in rows) == 3
    assert S.equal_width_histogram(df.where("v = 1"), "v", 4).collect()[0].n == 1


def test_interpolation_matches_numpy(spark):
    import numpy as np

    x, y = [1, 5, 20, 300], [0.0, 4.0, 1.0, 2.0]
    df = spark.createDataFrame([(1, float(a), b) for a, b in zip(x, y, strict=True)] + [(1, None, 3.0), (2, 7.0, 5.0)], "g int, x double, y double")
    got = sorted((r.i, r.x, r.y) for r in S.interpolated(df, ["g"], "x", "y").where("g = 1").collect())
    at = np.linspace(np.log10(1), np.log10(300), 100)
    assert len(got) == 100 and np.allclose([g[1] for g in got], at) and np.allclose([g[2] for g in got], np.interp(at, np.log10(x), y))
    assert S.interpolated(df, ["g"], "x", "y").where("g = 2").count() == 1


def test_index_is_searched_many_times(spark):
    docs = spark.createDataFrame([(1, "the cat sat"), (2, "the dog sat"), (3, "the the the")], "doc_id int, text string")
    index = R.Bm25Index(docs)
    for words in ("dog", "cat dog"):
        q = spark.createDataFrame([(1, words)], "query_id int, query string")
        assert sorted(map(tuple, index.search(q, 2).collect())) == sorted(map(tuple, R.bm25(docs, q, 2).collect()))
    index.close()


def test_text_helpers(spark):
    from kinquery.functions import columns as C

    r = spark.range(1).select(
        C.arrow_parts(F.lit("S ->  Who | What")).alias("a"), C.arrow_parts(F.lit("none")).alias("n"), C.joined_lines(F.lit(" x\n\n y ")).alias("j"),
        C.listed_questions(F.lit("1. Who is it?\nnoise\n- What?\n")).alias("q"), C.names_in(F.lit("Ann met Bob"), ["Bob", "Cid", "Ann"]).alias("m"), C.bracketed(F.lit("a <b> <c_1>")).alias("b"), C.fenced(F.lit('x """y\nz""" ')).alias("f")).collect()[0]
    assert r.a == ["S", "Who | What"] and r.n is None and r.j == "x y" and r.q == ["Who is it?", "What?"] and r.m == ["Bob", "Ann"] and r.b == ["b", "c_1"] and r.f == "y\nz"


def test_exports(spark, tmp_path):
    qa = spark.createDataFrame([("1", "Who?", ["a", "b"])], "id string, question string, answer array<string>")
    records.export_questions(qa, str(tmp_path / "q"))
    assert spark.read.json(str(tmp_path / "q")).collect()[0].golden_answers == ["a", "b"]
    rows = spark.createDataFrame([("1", [("Search", "x")])], "id string, actions array<struct<name:string,argument:string>>")
    records.write_actions(rows, str(tmp_path / "a"))
    assert "Search" in spark.read.csv(str(tmp_path / "a"), header=True, escape='"').collect()[0].actions
    assert E.by_prefix(spark.createDataFrame([(1, 2, 3)], "b int, _a int, c int")).columns == ["_a", "b", "c"]


def test_scratch_tables_go(spark):
    from kinquery.runtime import drop_scratch, stored

    df = stored(spark.range(3), "test")
    assert df.count() == 3
    path = df.inputFiles()[0].rpartition("/")[0]
    drop_scratch(spark)
    assert not __import__("os").path.exists(path.removeprefix("file://"))


@pytest.mark.parametrize("metric", ["dot", "l2"])
def test_dense_by_matrix_products_equals_pair_by_pair(spark, metric, monkeypatch):
    """Copies, scores that differ by less than the ninth decimal, and vectors that are null, short or not finite."""
    rnd = random.Random(4)
    base = [[rnd.uniform(-1, 1) for _ in range(8)] for _ in range(60)]
    rows = [(i, base[i % 60] if i % 3 else [c + rnd.uniform(-1, 1) * 1e-10 for c in base[i % 60]]) for i in range(300)]
    rows += [(300, None), (301, [1.0] * 7), (302, [1.0] * 7 + [None]), (303, [float("nan")] * 8), (304, [1e200] * 8)]
    docs = spark.createDataFrame(rows, "doc_id int, vector array<double>")
    queries = docs.where("doc_id % 20 = 1 or doc_id > 301").toDF("query_id", "query_vector")
    want = docs.crossJoin(F.broadcast(queries))
    score = R._dot(F.col("vector"), F.col("query_vector")) if metric == "dot" else -R._distance(F.col("vector"), F.col("query_vector"))
    want = R.top(want.select("query_id", "doc_id", score.alias("score")), ["query_id"], 4, F.round("score", 9), ["doc_id"])
    want = want.select("query_id", "doc_id", (F.col("score") if metric == "dot" else -F.col("score")).alias("score"), "rank")
    calls = []
    real = R._Best.add
    monkeypatch.setattr(R._Best, "add", lambda self, docs, x: (calls.append(1), real(self, docs, x))[1])
    got = R.dense(docs, queries, 4, metric)
    assert sorted(map(repr, got.collect())) == sorted(map(repr, want.collect()))
    best, x = R._Best(np.array(base[:5]), 4, metric), np.array([v for _, v in rows[:300]])
    for lo in range(0, 300, 50):
        best.add(pa.array(range(lo, lo + 50)), x[lo : lo + 50])
    assert calls and len(best.q) < 5 * 300  # pairs out of reach aren't kept


def test_lookups_of_many_people_are_not_broadcast(spark, monkeypatch):
    from kinquery.operators import generation as G
    from kinquery.operators import walks as W

    edges = spark.createDataFrame([(str(i), "r", str((i + k) % 40), 1) for i in range(40) for k in (1, 2)], "x string, rel string, y string, mult long")
    people = spark.createDataFrame([(str(i), i) for i in range(40)], "name string, i long")
    monkeypatch.setattr(W, "BROADCAST_ROWS", 10)
    adjacency = W.Adjacency.of(edges)
    walks = G.Walks(people, 40, adjacency, adjacency)
    state = spark.range(300).select(F.col("id").alias("q"))
    starts = walks.start(state, F.col("q"))
    steps = adjacency.choose(starts, "at", W.below(F.col("__total"), "s", F.col("q")))
    for found in (starts, steps):
        assert "BroadcastHashJoin" not in found._jdf.queryExecution().sparkPlan().toString()
    assert steps.count() == 300 and all((int(r.y) - int(r["at"])) % 40 in (1, 2) for r in steps.collect())
