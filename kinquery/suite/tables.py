"""Evaluation, retrieval, text and shape operators over the driver's tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinquery.functions import columns as C
from kinquery.operators import evaluation as E
from kinquery.operators import long_texts as L
from kinquery.operators import retrieval as R
from kinquery.operators import shapes as S
from kinquery.operators import votes as V
from kinquery.runtime import spread, table

QUERIES: dict = {}
ORACLES: dict = {}


def query(name: str, sql: str | None = None):
    def add(run):
        QUERIES[name] = run
        if sql:
            ORACLES[name] = sql
        return run

    return add


# predictions: an order is a question, its parts' remainders are the answers, its suppliers' the prediction


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("k")).agg(
        F.array_sort(F.collect_set((F.col("l_partkey") % 7).cast("string"))).alias("true"), F.array_join(F.array_sort(F.collect_set((F.col("l_suppkey") % 7).cast("string"))), ", ").alias("pred"))
    o = table(spark, sf_dir, "orders")
    keys = o.select(F.col("o_orderkey").alias("k"), F.concat(F.lit("model-"), F.col("o_custkey") % 5).alias("_model"), (F.col("o_orderkey") % 3).alias("_data_seed"), (F.col("o_orderkey") % 5).alias("_seed"), F.element_at(F.array(F.lit(50), F.lit(500), F.lit(5000)), (F.col("o_custkey") % 3 + 1).cast("int")).alias("_size"), (F.col("o_orderkey") % 4 + 1).alias("_type"), F.element_at(F.array(F.lit("cot"), F.lit("react")), (F.col("o_custkey") % 2 + 1).cast("int")).alias("method"), F.year("o_orderdate").alias("difficulty"))
    return lines.join(keys, "k")


def scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.scored(predictions(spark, sf_dir))


_SCORES = """WITH t AS (SELECT DISTINCT l_orderkey AS k, l_partkey % 7 AS v FROM lineitem), p AS (SELECT DISTINCT l_orderkey AS k, l_suppkey % 7 AS v FROM lineitem),
  nt AS (SELECT k, count(*) AS n FROM t GROUP BY k), np AS (SELECT k, count(*) AS n FROM p GROUP BY k),
  hit AS (SELECT k, count(*) AS n FROM t JOIN p USING (k, v) GROUP BY k),
  s0 AS (SELECT nt.k, coalesce(hit.n, 0) AS h, np.n AS np, nt.n AS nt FROM nt JOIN np USING (k) LEFT JOIN hit USING (k)),
  s AS (SELECT k, (h = np AND h = nt) AS "EM", h / np AS precision, h / nt AS recall, CASE WHEN h = 0 THEN 0 ELSE 2 * (h / np) * (h / nt) / (h / np + h / nt) END AS f1 FROM s0),
  e AS (SELECT s.*, 'model-' || (o_custkey % 5) AS _model, o_orderkey % 3 AS _data_seed, o_orderkey % 5 AS _seed, CASE o_custkey % 3 WHEN 0 THEN 50 WHEN 1 THEN 500 ELSE 5000 END AS _size,
    o_orderkey % 4 + 1 AS _type, CASE o_custkey % 2 WHEN 0 THEN 'cot' ELSE 'react' END AS method, year(o_orderdate) AS difficulty, o_custkey FROM s JOIN orders ON k = o_orderkey)"""


def _r(*names: str) -> list:
    return [F.round(F.col(n).cast("double"), 6).alias(n) for n in names]


def _rs(*names: str) -> str:
    return ", ".join(f'round(CAST({n} AS DOUBLE), 6) AS {n}' for n in names)


@query("score_em_pr_f1", f'{_SCORES} SELECT k, "EM", {_rs("precision", "recall", "f1")} FROM s')
def score_em_pr_f1(spark, sf_dir):
    return scores(spark, sf_dir).select("k", "EM", *_r("precision", "recall", "f1"))


@query("acc_by_seed", f"""{_SCORES} SELECT _model, _data_seed, _seed, round(avg("EM"::INT), 6) AS "EM", round(avg(f1), 6) AS f1, count(*) AS n FROM e GROUP BY ALL""")
def acc_by_seed(spark, sf_dir):
    return E.mean_by(scores(spark, sf_dir), ["_model", "_data_seed", "_seed"], ("EM", "f1")).select("_model", "_data_seed", "_seed", *_r("EM", "f1"), F.col("count").alias("n"))


_L1 = f"{_SCORES}, l1 AS (SELECT _model, _size, _data_seed, _seed, avg(f1) AS f1 FROM e GROUP BY ALL)"


@query("acc_mean_se", f"{_L1}, l2 AS (SELECT _model, _size, _data_seed, avg(f1) AS f1 FROM l1 GROUP BY ALL) SELECT _model, _size, round(avg(f1), 6) AS f1_mean, round(stddev_samp(f1) / sqrt(count(*)), 6) AS f1_std, count(*) AS n FROM l2 GROUP BY ALL")
def acc_mean_se(spark, sf_dir):
    return E.accuracy(scores(spark, sf_dir), ["_model", "_size"], ("f1",)).select("_model", "_size", *_r("f1_mean", "f1_std"), "n")


@query("acc_mean_se_one_stage", f"{_L1} SELECT _model, _size, round(avg(f1), 6) AS f1_mean, round(stddev_samp(f1) / sqrt(count(*)), 6) AS f1_std, count(*) AS n FROM l1 GROUP BY ALL")
def acc_mean_se_one_stage(spark, sf_dir):
    return E.accuracy(scores(spark, sf_dir), ["_model", "_size"], ("f1",), two_stage=False).select("_model", "_size", *_r("f1_mean", "f1_std"), "n")


@query("acc_by_type", f"{_SCORES} SELECT _model, _type, round(avg(f1), 6) AS f1_mean, round(stddev_samp(f1), 6) AS f1_std FROM e GROUP BY ALL")
def acc_by_type(spark, sf_dir):
    return E.mean_deviation(scores(spark, sf_dir), ["_model", "_type"], ("f1",)).select("_model", "_type", *_r("f1_mean", "f1_std"))


@query("acc_range_filter", f"{_SCORES} SELECT difficulty, round(avg(f1), 6) AS f1, count(*) AS n FROM e WHERE difficulty BETWEEN 1994 AND 1996 AND _size IN (50, 500) AND lower(_model) IN ('model-1', 'model-2') GROUP BY ALL")
def acc_range_filter(spark, sf_dir):
    rows = scores(spark, sf_dir).where(F.col("difficulty").between(1994, 1996) & F.col("_size").isin(50, 500) & F.lower("_model").isin("model-1", "model-2"))
    return E.mean_by(rows, ["difficulty"], ("f1",)).select("difficulty", *_r("f1"), F.col("count").alias("n"))


@query("pivot_mean", f"{_SCORES}, m AS (SELECT _model, _type, avg(f1) AS v FROM e GROUP BY ALL) SELECT _model, {', '.join(f'round(max(v) FILTER (_type = {t}), 6) AS t{t}' for t in (1, 2, 3, 4))} FROM m WHERE _model IN ('model-3', 'model-1') GROUP BY _model")
def pivot_mean(spark, sf_dir):
    rows = E.mean_by(scores(spark, sf_dir), ["_model", "_type"], ("f1",))
    wide = E.pivoted(rows, "_type", "f1", [1, 2, 3, 4], order=["model-3", "model-1"])
    return wide.select("_model", *(F.round(F.col(str(t)), 6).alias(f"t{t}") for t in (1, 2, 3, 4)))


@query("leaderboard", f"""{_SCORES}, l1 AS (SELECT _size, _model, method, _data_seed, _seed, avg(f1) AS f1 FROM e WHERE _size IN (50, 500) GROUP BY ALL),
  l2 AS (SELECT _size, _model, method, _data_seed, avg(f1) AS f1 FROM l1 GROUP BY ALL),
  c AS (SELECT _size, _model, method, round(100 * avg(f1), 4) AS v FROM l2 GROUP BY ALL)
  SELECT _size, _model, max(v) FILTER (method = 'cot') AS cot, max(v) FILTER (method = 'react') AS react FROM c GROUP BY ALL""")
def leaderboard(spark, sf_dir):
    rows = E.mean_by(scores(spark, sf_dir).where(F.col("_size").isin(50, 500)), ["_size", "_model", "method", "_data_seed", "_seed"], ("f1",))
    cells = E.mean_error(rows.groupBy("_size", "_model", "method", "_data_seed").agg(F.avg("f1").alias("f1")), ["_size", "_model", "method"], ("f1",))
    wide = cells.groupBy("_size", "_model").pivot("method", ["cot", "react"]).agg(F.first("f1_mean"))
    return wide.select("_size", "_model", *(F.round(100 * F.col(m), 4).alias(m) for m in ("cot", "react")))


@query("leaderboard_cells", f"""{_SCORES}, a AS (SELECT _size, _model, method, _data_seed, _seed, avg(f1) AS f1 FROM e GROUP BY ALL),
  b AS (SELECT _size, _model, method, _data_seed, avg(f1) AS f1 FROM a GROUP BY ALL), c AS (SELECT _size, _model, method, avg(f1) AS m, stddev_samp(f1) / sqrt(count(*)) AS s FROM b GROUP BY ALL)
  SELECT _size, _model, method, CAST(round(m, 4) AS DOUBLE) AS mean, CAST(round(s, 4) AS DOUBLE) AS error FROM c""")
def leaderboard_cells(spark, sf_dir):
    """The numbers that stand in the cells of all sizes, models and methods, to a unit of their last place."""
    rows = scores(spark, sf_dir)
    sizes, models, methods = ([r[0] for r in rows.select(c).distinct().orderBy(c).collect()] for c in ("_size", "_model", "method"))  # a few of each
    cells = E.leaderboard(rows, methods, sizes, models).unpivot(["_size", "_model"], methods, "method", "cell").where("cell is not null")
    part = lambda i: F.round(F.split("cell", " ± ")[i].cast("double") / 100, 4)
    return cells.select("_size", "_model", "method", part(0).alias("mean"), part(1).alias("error"))


@query("out_of_context", f"{_SCORES} SELECT _size, method, _model, CASE WHEN _size > 500 AND method = 'cot' AND _model = 'model-2' THEN '--' ELSE CAST(count(*) AS VARCHAR) END AS cell FROM e GROUP BY _size, method, _model")
def out_of_context(spark, sf_dir):
    rows = E.mean_by(scores(spark, sf_dir), ["_size", "method", "_model"], ("f1",))
    return rows.select("_size", "method", "_model", E.out_of_context(F.col("count").cast("string"), F.col("_size"), F.col("_model"), F.col("method"), 500, ["model-2"], ["cot"]).alias("cell"))


@query("delta_mixin", f"{_SCORES}, m AS (SELECT _model, method, _data_seed, _seed, _size, _type, avg(f1) AS f1 FROM e GROUP BY ALL) SELECT a._model, a._data_seed, a._seed, a._size, a._type, round(b.f1 - a.f1, 6) + 0.0 AS f1_delta FROM m a JOIN m b USING (_model, _data_seed, _seed, _size, _type) WHERE a.method = 'cot' AND b.method = 'react'")
def delta_mixin(spark, sf_dir):
    keys = ["_model", "_data_seed", "_seed", "_size", "_type"]
    rows = E.mean_by(scores(spark, sf_dir), [*keys, "method"], ("f1",))
    return E.compared(rows.where("method = 'cot'"), rows.where("method = 'react'"), keys, ("f1",)).select(*keys, (F.round("f1_delta", 6) + F.lit(0.0)).alias("f1_delta"))


@query("preds_left_join_qa", "SELECT CAST(o_orderkey AS VARCHAR) AS id, CAST(20 AS INTEGER) AS _depth, CAST(o_custkey AS INTEGER) AS _size, CAST(3 AS INTEGER) AS _data_seed, CASE WHEN o_orderkey % 3 = 0 THEN o_orderpriority END AS question FROM orders")
def preds_left_join_qa(spark, sf_dir):
    o = table(spark, sf_dir, "orders").withColumn("id", F.col("o_orderkey").cast("string"))
    preds = o.select("id", F.concat(F.lit("depth_20_size_"), F.col("o_custkey"), F.lit("_seed_3")).alias("_split"))
    qa = o.where("o_orderkey % 3 = 0").select("id", F.col("o_orderpriority").alias("question"), F.lit("x").alias("_split"))
    return E.with_questions(preds, qa).select("id", "_depth", "_size", "_data_seed", "question")


@query("split_name_parse", "SELECT o_orderkey AS k, CASE WHEN o_orderkey % 2 = 0 THEN CAST(o_custkey AS INTEGER) END AS depth, CASE WHEN o_orderkey % 2 = 0 THEN CAST(o_orderkey AS INTEGER) END AS seed FROM orders")
def split_name_parse(spark, sf_dir):
    name = F.when(F.col("o_orderkey") % 2 == 0, F.concat(F.lit("depth_"), "o_custkey", F.lit("_size_1_seed_"), "o_orderkey")).otherwise(F.lit("train"))
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), name.alias("s")).select("k", C.split_part("s", "depth").alias("depth"), C.split_part("s", "seed").alias("seed"))


@query("question_columns", "SELECT o_orderkey AS k, CAST(1 + o_orderkey % 3 AS BIGINT) AS hops, CAST(o_orderkey % 2 AS INTEGER) AS aggregation, CAST(o_orderkey % 4 AS BIGINT) AS solutions, 'Who is <name>_4 ?' AS template FROM orders")
def question_columns(spark, sf_dir):
    goal = F.when(F.col("o_orderkey") % 2 == 1, F.lit("aggregate_all(count, distinct(child(Y_3, Y_1)), Count_1)")).otherwise(F.lit("child(Y_3, Y_1)"))
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), F.struct(F.array_repeat(goal, (1 + F.col("o_orderkey") % 3).cast("int")).alias("query"), F.lit("Y_1").alias("answer")).alias("prolog"), F.array_repeat(F.lit("a"), (F.col("o_orderkey") % 4).cast("int")).alias("answer"), F.split(F.lit("Who is|<name>_4|?"), r"\|").alias("template"))
    return E.question_columns(rows).select("k", "hops", "aggregation", "solutions", "template")


_QUESTION = "CASE WHEN doc_id % 3 = 0 THEN '  How many ' || source WHEN doc_id % 3 = 1 THEN 'how many ' || source ELSE 'Who is ' || source END"


@query("exclude_aggregation", f"SELECT doc_id, {_QUESTION} AS question FROM documents WHERE doc_id % 3 <> 0")
def exclude_aggregation(spark, sf_dir):
    q = F.concat(F.when(F.col("doc_id") % 3 == 0, "  How many ").when(F.col("doc_id") % 3 == 1, "how many ").otherwise("Who is "), "source")
    return E.without_aggregations(table(spark, sf_dir, "documents").select("doc_id", q.alias("question")))


@query("depth_subset", "SELECT o_orderkey AS k FROM orders WHERE o_orderpriority IN ('1-URGENT', '3-MEDIUM')")
def depth_subset(spark, sf_dir):
    qa = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), F.split("o_orderpriority", "-").alias("template"))
    known = spark.createDataFrame([(["1", "URGENT"],), (["3", "MEDIUM"],), (["3", "MEDIUM"],)], "template array<string>")
    return E.of_templates(qa, known).select("k")


@query("interaction_counts", """SELECT conv_id, count(*) AS n_messages, count(*) FILTER (role = 'assistant') AS n_actions FROM conversations GROUP BY conv_id""")
def interaction_counts(spark, sf_dir):
    one = F.struct("turn", F.struct("role", F.array(F.struct(F.lit("text").alias("type"), F.concat("text", F.lit(" Act["), "turn", F.lit("]")).alias("text"))).alias("content")).alias("m"))
    talk = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list(one)), lambda x: x["m"]).alias("messages"))
    return E.interaction_counts(talk.select("conv_id", F.struct("messages", F.lit("u").alias("uid")).alias("interaction"))).select("conv_id", "n_messages", "n_actions")


# votes and usage


@query("majority_vote", """WITH v AS (SELECT user_id, event_id, event_type FROM events), n AS (SELECT user_id, count(*) AS n FROM v GROUP BY 1), c AS (SELECT user_id, lower(event_type) AS a, count(*) AS c FROM v GROUP BY ALL)
  SELECT n.user_id, coalesce(string_agg(a, ',' ORDER BY a), '') AS pred, CASE WHEN count(a) = 0 THEN 'No majority vote' END AS error FROM n LEFT JOIN c ON c.user_id = n.user_id AND 2 * c > n.n GROUP BY n.user_id""")
def majority_vote(spark, sf_dir):
    return V.majority(table(spark, sf_dir, "events").select("user_id", F.concat(F.upper("event_type"), F.lit(" , "), F.col("event_type")).alias("pred")), ["user_id"])


@query("usage_sum", "SELECT event_type, 'tokens.in' AS path, CAST(sum(user_id) AS DOUBLE) AS total FROM events GROUP BY 1 UNION ALL SELECT event_type, 'calls', CAST(count(*) FILTER (event_id % 2 = 0) AS DOUBLE) FROM events GROUP BY 1")
def usage_sum(spark, sf_dir):
    text = F.concat(F.lit('{"calls": '), F.when(F.col("event_id") % 2 == 0, "1").otherwise("null"), F.lit(', "tokens": {"in": '), "user_id", F.lit("}}"))
    return V.usage_sum(table(spark, sf_dir, "events").select("event_type", text.alias("usage")), ["event_type"])


@query("fallback_rows", "SELECT o_orderkey AS k, CASE WHEN o_orderkey % 3 = 0 AND o_orderkey % 2 = 0 THEN 'second' ELSE 'first' END AS pred FROM orders")
def fallback_rows(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"))
    first = o.select("k", F.lit("first").alias("pred"), F.when(F.col("k") % 3 == 0, "No majority vote in x").alias("error"))
    second = o.where("k % 2 = 0").select("k", F.lit("second").alias("pred"), F.lit(None).cast("string").alias("error"))
    return V.with_fallback(first, second, "k", "No majority vote").select("k", "pred")


# retrieval

_TOKENS = "list_filter(regexp_split_to_array(lower({0}), '[^\\p{{L}}\\p{{N}}]+'), lambda t: t <> '')"


@query("bm25_top4", f"""WITH d AS (SELECT doc_id, {_TOKENS.format('text')} AS w FROM documents), s AS (SELECT count(*) AS n, avg(len(w)) AS mean FROM d),
  q AS (SELECT DISTINCT item_id, unnest({_TOKENS.format('text')}) AS t FROM benchmark), tf AS (SELECT doc_id, len(w) AS l, t, count(*) AS tf FROM (SELECT doc_id, w, unnest(w) AS t FROM d) GROUP BY doc_id, l, t),
  df AS (SELECT t, count(*) AS df FROM tf GROUP BY t),
  r AS (SELECT item_id, doc_id, sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * l / mean))) AS score FROM q JOIN tf USING (t) JOIN df USING (t), s GROUP BY item_id, doc_id)
  SELECT item_id, doc_id, round(score, 5) AS score, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY round(score, 9) DESC, doc_id) AS rank FROM r) WHERE rank <= 4""")
def bm25_top4(spark, sf_dir):
    asked = table(spark, sf_dir, "benchmark").select("item_id", F.col("text").alias("query"))
    return R.bm25(table(spark, sf_dir, "documents"), asked, 4, query="item_id").withColumn("score", F.round("score", 5))


def _dense_sql(score: str, order: str) -> str:
    return f"""WITH r AS (SELECT q.vec_id AS query_id, d.vec_id AS doc_id, {score} AS score FROM embeddings q JOIN embeddings d ON q.vec_id % 100 = 0)
  SELECT query_id, doc_id, round(score, 5) AS score, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) {order}, doc_id) AS rank FROM r) WHERE rank <= 4"""


def _vectors(spark, sf_dir):
    v = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id"), F.col("embedding").alias("vector"))
    return spread(v), v.where("doc_id % 100 = 0").select(F.col("doc_id").alias("query_id"), F.col("vector").alias("query_vector"))


@query("dense_top4", _dense_sql("list_inner_product(CAST(q.embedding AS DOUBLE[]), CAST(d.embedding AS DOUBLE[]))", "DESC"))
def dense_top4(spark, sf_dir):
    return R.dense(*_vectors(spark, sf_dir)).withColumn("score", F.round("score", 5))


@query("dense_l2_top4", _dense_sql("list_distance(CAST(q.embedding AS DOUBLE[]), CAST(d.embedding AS DOUBLE[]))", "ASC"))
def dense_l2_top4(spark, sf_dir):
    return R.dense(*_vectors(spark, sf_dir), metric="l2").withColumn("score", F.round("score", 5))


def _titled(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.concat(F.lit("Doc "), "source", F.lit("-"), F.col("doc_id") % 100).alias("title"), "text")


_TITLED = "d AS (SELECT doc_id, 'Doc ' || source || '-' || (doc_id % 100) AS title, text FROM documents)"


@query("title_exact", f"WITH {_TITLED}, q AS (SELECT item_id, 'dOC SRC' || (item_id % 20) || '-' || (item_id % 30) AS query FROM benchmark) SELECT item_id, min(doc_id) AS doc_id FROM q JOIN d ON lower(title) = lower(query) GROUP BY item_id")
def title_exact(spark, sf_dir):
    asked = table(spark, sf_dir, "benchmark").select("item_id", F.concat(F.lit("dOC SRC"), F.col("item_id") % 20, F.lit("-"), F.col("item_id") % 30).alias("query"))
    return R.by_title(_titled(spark, sf_dir), asked, query="item_id").select("item_id", "doc_id")


_ASKS = "q AS (SELECT item_id, CASE WHEN item_id % 2 = 0 THEN text ELSE 'Doc src' || (item_id % 20) || '-' || (item_id % 30) END AS query FROM benchmark)"


@query("title_or_bm25", f"""WITH {_TITLED}, {_ASKS}, t AS (SELECT item_id, min(doc_id) AS doc_id FROM q JOIN d ON lower(title) = lower(query) GROUP BY item_id),
  w AS (SELECT doc_id, {_TOKENS.format('text')} AS w FROM documents), s AS (SELECT count(*) AS n, avg(len(w)) AS mean FROM w),
  a AS (SELECT DISTINCT item_id, unnest({_TOKENS.format('query')}) AS t FROM q WHERE item_id NOT IN (SELECT item_id FROM t)), tf AS (SELECT doc_id, len(w) AS l, t, count(*) AS tf FROM (SELECT doc_id, w, unnest(w) AS t FROM w) GROUP BY doc_id, l, t),
  df AS (SELECT t, count(*) AS df FROM tf GROUP BY t),
  r AS (SELECT item_id, doc_id, sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * l / mean))) AS score FROM a JOIN tf USING (t) JOIN df USING (t), s GROUP BY item_id, doc_id)
  SELECT item_id, doc_id, 'title' AS how, CAST(1 AS INTEGER) AS rank FROM t UNION ALL
  SELECT item_id, doc_id, 'bm25', CAST(rank AS INTEGER) FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY round(score, 9) DESC, doc_id) AS rank FROM r) WHERE rank <= 2""")
def title_or_bm25(spark, sf_dir):
    titles = F.concat(F.lit("Doc src"), F.col("item_id") % 20, F.lit("-"), F.col("item_id") % 30)
    asked = table(spark, sf_dir, "benchmark").select("item_id", F.when(F.col("item_id") % 2 == 0, F.col("text")).otherwise(titles).alias("query"))
    return R.title_or_bm25(_titled(spark, sf_dir), asked, query="item_id").select("item_id", "doc_id", "how", "rank")


@query("ids_by_title", "SELECT source, string_agg(CAST(doc_id AS VARCHAR), ',' ORDER BY doc_id) AS ids FROM documents GROUP BY 1")
def ids_by_title(spark, sf_dir):
    return R.ids_by_title(table(spark, sf_dir, "documents"), "source").select("source", F.array_join(F.col("ids").cast("array<string>"), ",").alias("ids"))


@query("mean_count", f"{_SCORES}, m AS (SELECT _model, _type, count(*) AS n FROM e GROUP BY ALL) SELECT _model, CAST(floor(avg(n)) AS INTEGER) AS n FROM m GROUP BY 1")
def mean_count(spark, sf_dir):
    rows = E.mean_by(scores(spark, sf_dir), ["_model", "_type"], ("f1",))
    return E.mean_count(rows, ["_model"]).select("_model", F.col("count").alias("n"))


@query("chunk_merge", "SELECT source AS title, length(string_agg(text, chr(10) ORDER BY doc_id)) AS n, md5(string_agg(text, chr(10) ORDER BY doc_id)) AS h FROM documents GROUP BY source")
def chunk_merge(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select("doc_id", F.col("source").alias("title"), F.col("text").alias("body"))
    return L.digests(L.joined_parts(rows, "title", "doc_id", "body"), "title").select("title", F.col("n_chars").alias("n"), F.col("md5").alias("h"))


@query("attr_search_regex", "SELECT doc_id FROM documents WHERE regexp_matches(lower(text), 'mit licen.e|gnu\\s+general')")
def attr_search_regex(spark, sf_dir):
    return R.matching(table(spark, sf_dir, "documents"), r"MIT licen.e|gnu\s+general").select("doc_id")


@query("ordinal_labels", "SELECT doc_id, '(' || row_number() OVER (PARTITION BY source ORDER BY doc_id) || ') ' || lang AS label FROM documents")
def ordinal_labels(spark, sf_dir):
    return R.numbered(table(spark, sf_dir, "documents").select("doc_id", "source", "lang"), ["source"], "doc_id", "lang").select("doc_id", "label")


_SENT = "regexp_split_to_array(regexp_replace(trim(regexp_replace(text, '\\s+', ' ', 'g')), '([.!?]) ', '\\1' || chr(1), 'g'), chr(1))"


@query("keyword_lookup", f"""WITH s AS (SELECT doc_id, {_SENT} AS s FROM documents), k AS (SELECT doc_id, s, unnest(range(1, len(s) + 1)) AS i FROM s)
  SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY i) AS INTEGER) AS n, s[i] AS sentence, array_to_string(s[greatest(i - 2, 1) : i + 2], ' ') AS context FROM k WHERE contains(lower(s[i]), 'licen')""")
def keyword_lookup(spark, sf_dir):
    return R.keyword_lookup(table(spark, sf_dir, "documents"), "Licen")


_CORE = "regexp_replace(w, '^[^\\p{L}\\p{N}]+|[^\\p{L}\\p{N}.!?]+$', '', 'g')"


@query("sentences_learned", f"""WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '\\s+'), lambda x: x <> '') AS ws FROM documents),
  p AS (SELECT unnest(ws) AS w, unnest(list_concat([NULL], ws[:-2])) AS before FROM d WHERE len(ws) > 0), c AS (SELECT {_CORE} AS core, {_CORE.replace('(w,', '(before,')} AS prior FROM p),
  t AS (SELECT lower(regexp_replace(core, '[.!?]+$', '')) AS word, regexp_matches(core, '[^.]\\.$') AS s, regexp_matches(core, '^\\p{{Ll}}') AS l, regexp_matches(core, '^\\p{{Lu}}') AND prior IS NOT NULL AND NOT regexp_matches(prior, '[.!?]$') AS c FROM c),
  g AS (SELECT word, count(*) FILTER (s) AS k, count(*) FILTER (NOT s) AS plain, count(*) FILTER (l) AS small, count(*) FILTER (c) AS capital_inside FROM t WHERE word <> '' GROUP BY word),
  n AS (SELECT least(greatest(sum(k) / sum(k + plain), 1e-9), 1 - 1e-9) AS p FROM g), z AS (SELECT *, length(replace(word, '.', '')) AS len FROM g, n)
  SELECT word, CAST(k AS BIGINT) AS stopped, CAST(plain AS BIGINT) AS plain, CAST(small AS BIGINT) AS small, CAST(capital_inside AS BIGINT) AS capital_inside,
    CASE WHEN k > 0 AND regexp_matches(word, '\\p{{L}}') THEN round(2 * (k * ln(0.99) + plain * ln(0.01) - k * ln(p) - plain * ln(1 - p)) * exp(-len) * (length(word) - len + 1) * pow(greatest(len, 1), -plain), 6) + 0.0 END AS score FROM z""")
def sentences_learned(spark, sf_dir):
    """Of every word of all documents how it is written, and how sure it is an abbreviation."""
    from kinquery.operators.sentence_model import statistics

    return statistics(table(spark, sf_dir, "documents")).withColumn("score", F.round("score", 6) + F.lit(0.0))


@query("evidence_join", "SELECT source, md5(string_agg(text, chr(10) || '================' || chr(10) || chr(10) ORDER BY doc_id)) AS h FROM documents GROUP BY source")
def evidence_join(spark, sf_dir):
    line = "\n================\n\n"
    return L.digests(L.joined_parts(table(spark, sf_dir, "documents"), "source", "doc_id", "text", line), "source", line).select("source", F.col("md5").alias("h"))


@query("relevant_articles", "SELECT r_regionkey AS id, string_agg(n_name, chr(10) || '================' || chr(10) || chr(10) ORDER BY n_nationkey DESC) AS evidence FROM region JOIN nation ON n_regionkey = r_regionkey GROUP BY 1")
def relevant_articles(spark, sf_dir):
    nation = table(spark, sf_dir, "nation")
    names = nation.groupBy(F.col("n_regionkey").alias("id")).agg(F.transform(F.sort_array(F.collect_list(F.struct("n_nationkey", "n_name")), asc=False), lambda x: x["n_name"]).alias("names"))
    return R.relevant(nation.select(F.col("n_name").alias("title"), F.col("n_name").alias("article")), names)


@query("constant_evidence", "SELECT item_id, (SELECT string_agg(r_name, ' ' ORDER BY r_regionkey) FROM region) || ': ' || text AS prompt FROM benchmark")
def constant_evidence(spark, sf_dir):
    one = R.evidence(table(spark, sf_dir, "region").withColumn("g", F.lit(0)), ["g"], "r_regionkey", "r_name", " ").select("evidence")
    return table(spark, sf_dir, "benchmark").crossJoin(F.broadcast(one)).select("item_id", F.concat("evidence", F.lit(": "), "text").alias("prompt"))


@query("jsonl_export", "SELECT CAST(doc_id AS VARCHAR) AS id, md5('\"' || doc_id || '\"' || chr(10) || text) AS contents FROM documents")
def jsonl_export(spark, sf_dir):
    from kinquery.sources.records import passages

    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("title"), F.col("text").alias("article"))
    return passages(docs).select("id", F.md5("contents").alias("contents"))


@query("passage_title_body", "SELECT conv_id, turn, lower(source) AS title, text AS body FROM (SELECT conv_id, turn, 'Talk ' || role AS source, text FROM conversations)")
def passage_title_body(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.concat(F.lit('"Talk '), "role", F.lit('"\n'), "text").alias("contents"))
    return rows.select("conv_id", "turn", C.title_of("contents").alias("title"), C.body_of("contents").alias("body"))


# parsing


@query("parse_answer_tag", "SELECT conv_id, turn, CASE WHEN turn % 3 = 1 THEN NULL WHEN turn % 3 = 0 THEN role ELSE 'last ' || role END AS answer FROM conversations")
def parse_answer_tag(spark, sf_dir):
    tag = lambda c: F.concat(F.lit("<answer>"), c, F.lit("</answer>"))
    text = F.when(F.col("turn") % 3 == 1, F.concat(F.lit("<answer>a\nb</answer>"), "text")).when(F.col("turn") % 3 == 0, tag(F.col("role"))).otherwise(F.concat(tag(F.lit("x")), F.lit("\n"), tag(F.concat(F.lit("last "), "role"))))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", C.answer_tag(text).alias("answer"))


@query("parse_think", "SELECT conv_id, turn, CASE WHEN turn % 2 = 0 THEN role ELSE text END AS answer FROM conversations")
def parse_think(spark, sf_dir):
    text = F.when(F.col("turn") % 2 == 0, F.concat(F.lit("<think>hm</think>\n\n"), "role", F.lit("\nmore"))).otherwise(F.col("text"))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", C.after_think(text).alias("answer"))


@query("parse_action", "SELECT conv_id, turn, CASE WHEN turn % 2 = 0 THEN 'Search' END AS name, CASE WHEN turn % 2 = 0 THEN lower(role) || ' x' END AS argument FROM conversations")
def parse_action(spark, sf_dir):
    text = F.when(F.col("turn") % 2 == 0, F.concat(F.lit("Action 1: Search["), F.upper("role"), F.lit(" X] or Finish[y]"))).otherwise(F.lit("no action"))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", C.action(text).alias("a")).select("conv_id", "turn", "a.name", "a.argument")


@query("parse_last_line", "SELECT conv_id, turn, role || '(X)' AS line FROM conversations")
def parse_last_line(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", C.last_line(F.concat(F.lit("thus\n`"), "role", F.lit("(X)`\n \n"))).alias("line"))


@query("format_pred", "SELECT conv_id, turn, role || ' and ' || turn AS pred FROM conversations")
def format_pred(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", C.one_line(F.concat(F.lit("\n "), "role", F.lit(" and\n"), "turn", F.lit(" \n"))).alias("pred"))


@query("retrieved_titles", "SELECT n_regionkey AS g, string_agg(n_name, '|' ORDER BY n_nationkey) AS titles FROM nation GROUP BY 1")
def retrieved_titles(spark, sf_dir):
    article = F.concat(F.lit("# "), "n_name", F.lit("\n\n## Family\nx"))
    rows = R.evidence(table(spark, sf_dir, "nation").select("n_regionkey", "n_nationkey", article.alias("a")), ["n_regionkey"], "n_nationkey", "a", "\n=====\n")
    message = F.concat(F.lit("Given (BEGIN EVIDENCE)"), "evidence", F.lit("(END EVIDENCE) answer"))
    return rows.select(F.col("n_regionkey").alias("g"), F.array_join(C.retrieved_titles(message, "(BEGIN EVIDENCE)", "(END EVIDENCE)", "\n=====\n"), "|").alias("titles"))


@query("fill_question", "SELECT c_custkey, 'Who is the sister of ' || c_name || '?' AS question FROM customer")
def fill_question(spark, sf_dir):
    tokens = F.array(*map(F.lit, ("Who is", "the", "<relation>_3", "of", "<name>_31", "?")))
    values = F.create_map(F.lit("<relation>_3"), F.lit("sister"), F.lit("<name>_31"), F.col("c_name"), F.lit("<name>_3"), F.lit("wrong"))
    return table(spark, sf_dir, "customer").select("c_custkey", C.question_text(C.fill_placeholders(tokens, values)).alias("question"))


@query("alias_lookup", "SELECT n_nationkey, CASE n_name WHEN 'FRANCE' THEN 'fr' ELSE n_name END AS a FROM nation")
def alias_lookup(spark, sf_dir):
    return table(spark, sf_dir, "nation").select("n_nationkey", C.alias_of("n_name", {"FRANCE": "fr"}).alias("a"))


@query("hobby_categories", "SELECT p_type AS category, count(*) AS n, min(lower(p_name)) AS first FROM part GROUP BY 1")
def hobby_categories(spark, sf_dir):
    rows = table(spark, sf_dir, "part").groupBy(F.col("p_type").alias("category")).agg(F.array_sort(F.collect_list(F.lower("p_name"))).alias("hobbies"))
    return rows.select("category", F.size("hobbies").cast("long").alias("n"), F.get("hobbies", F.lit(0)).alias("first"))


@query("limits_lookup", "SELECT n_nationkey, CASE WHEN n_nationkey < 20 THEN 100 + n_nationkey WHEN n_regionkey = 2 THEN 7 END AS rpm FROM nation")
def limits_lookup(spark, sf_dir):
    n = table(spark, sf_dir, "nation")
    server = F.concat(F.lit("S"), "n_regionkey")
    limits = n.where("n_nationkey < 20").select(F.lower(server).alias("server"), F.lower("n_name").alias("model"), F.lit(1).alias("tier"), (F.col("n_nationkey") + 100).cast("long").alias("rpm"), F.lit(1).cast("long").alias("tpm"))
    limits = limits.unionByName(spark.createDataFrame([(f"s{i}", "default", 1, 7, 1) for i in range(5)], limits.schema))
    found = S.limits_for(n.select(server.alias("server"), F.col("n_name").alias("model"), F.lit(1).alias("tier")), limits, "s2")
    return found.join(n.select("n_nationkey", F.col("n_name").alias("model")), "model").select("n_nationkey", F.col("rpm").cast("long").alias("rpm"))


# shapes


@query("hist_integer", "WITH v AS (SELECT source, CAST(n_chars AS DOUBLE) / 200 AS v FROM documents), b AS (SELECT source, least(floor(v), 19)::BIGINT AS bin, count(*) AS n FROM v WHERE v >= 1 AND v <= 20 GROUP BY ALL) SELECT source, bin, n, round(n / sum(n) OVER (PARTITION BY source), 6) AS density FROM b")
def hist_integer(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select("source", (F.col("n_chars") / 200).alias("v"))
    return S.integer_histogram(rows, "v", by=["source"]).select("source", "bin", "n", F.round("density", 6).alias("density"))


@query("hist_equal_width", "WITH m AS (SELECT min(o_totalprice) AS lo, max(o_totalprice) AS hi, count(*) AS t FROM orders) SELECT least(floor((o_totalprice - lo) / ((hi - lo) / 20)), 19)::BIGINT AS bin, count(*) AS n, round(count(*) / (max(t) * max((hi - lo) / 20)), 12) AS density FROM orders, m GROUP BY 1")
def hist_equal_width(spark, sf_dir):
    return S.equal_width_histogram(table(spark, sf_dir, "orders"), "o_totalprice").select("bin", "n", F.round("density", 12).alias("density"))


@query("dense_grid", "WITH s AS (SELECT n_nationkey AS a, n_regionkey AS b, 1.0::DOUBLE AS v FROM nation) SELECT g.a, g.b, s.v FROM (SELECT x.a, y.b FROM (SELECT DISTINCT a FROM s) x, (SELECT DISTINCT b FROM s) y) g LEFT JOIN s ON s.a = g.a AND s.b = g.b")
def dense_grid(spark, sf_dir):
    return S.dense_grid(table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("a"), F.col("n_regionkey").alias("b"), F.lit(1.0).alias("v")), "a", "b", "v")


@query("padded_grid", "SELECT n_nationkey AS a, n_regionkey AS b, 1.0::DOUBLE AS v FROM nation UNION ALL SELECT CAST(x AS INTEGER), b, 0.0 FROM range(30, 41, 5) t(x), (SELECT DISTINCT n_regionkey AS b FROM nation)")
def padded_grid(spark, sf_dir):
    return S.padded_grid(table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("a"), F.col("n_regionkey").alias("b"), F.lit(1.0).alias("v")), "a", 30, 40, 5, "b", "v", 0.0)


@query("interp_linear", """WITH s AS (SELECT n_regionkey AS g, log10(n_nationkey + 1) AS u, avg(CAST(n_nationkey * n_nationkey AS DOUBLE)) AS v FROM nation GROUP BY ALL),
  m AS (SELECT g, min(u) AS lo, max(u) AS hi FROM s GROUP BY g), p AS (SELECT g, CAST(i AS INTEGER) AS i, lo + i * (hi - lo) / 99 AS x FROM m, range(100) t(i)),
  n AS (SELECT g, u, v, lead(u) OVER w AS u2, lead(v) OVER w AS v2 FROM s WINDOW w AS (PARTITION BY g ORDER BY u)),
  k AS (SELECT p.g, i, x, u, v, u2, v2, row_number() OVER (PARTITION BY p.g, i ORDER BY u) AS r FROM p JOIN n ON n.g = p.g AND x >= u - 1e-12 AND x <= u2 + 1e-12)
  SELECT g, i, round(x, 6) AS x, round(v + (v2 - v) * (x - u) / (u2 - u), 5) AS y FROM k WHERE r = 1""")
def interp_linear(spark, sf_dir):
    rows = table(spark, sf_dir, "nation").select(F.col("n_regionkey").alias("g"), (F.col("n_nationkey") + 1).alias("x"), (F.col("n_nationkey") * F.col("n_nationkey")).cast("double").alias("y"))
    return S.interpolated(rows, ["g"], "x", "y").select("g", "i", F.round("x", 6).alias("x"), F.round("y", 5).alias("y"))


@query("batch_slice", "SELECT o_custkey, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS r FROM orders) WHERE r > 3 AND r <= 6")
def batch_slice(spark, sf_dir):
    return S.batch_slice(table(spark, sf_dir, "orders"), ["o_custkey"], "o_orderkey", 3, 2).select("o_custkey", "o_orderkey")


@query("first_per_type", "SELECT o_orderpriority, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_orderkey) AS r FROM orders) WHERE r <= 10")
def first_per_type(spark, sf_dir):
    return S.first_per_group(table(spark, sf_dir, "orders"), ["o_orderpriority"], "o_orderkey", 10).select("o_orderpriority", "o_orderkey")


@query("duplicate_names", "SELECT p_name, count(*) AS n FROM part GROUP BY 1 HAVING count(*) > 1")
def duplicate_names(spark, sf_dir):
    return S.duplicates(table(spark, sf_dir, "part"), "p_name")


@query("seeds_per_size", f"{_SCORES} SELECT _size, string_agg(DISTINCT CAST(_data_seed AS VARCHAR), ',' ORDER BY CAST(_data_seed AS VARCHAR)) AS seeds FROM e GROUP BY 1")
def seeds_per_size(spark, sf_dir):
    return predictions(spark, sf_dir).groupBy("_size").agg(F.array_join(F.array_sort(F.collect_set(F.col("_data_seed").cast("string"))), ",").alias("seeds"))


@query("union_scores", "SELECT 'a' AS method, o_orderkey, o_totalprice FROM orders WHERE o_orderkey % 2 = 0 UNION ALL SELECT 'b', o_orderkey, o_totalprice FROM orders WHERE o_orderkey % 3 = 0")
def union_scores(spark, sf_dir):
    """Two methods' score files, written and read as one table."""
    from kinquery.runtime import scratch_path
    from kinquery.sources.records import read_scores, write_scores

    o, paths = table(spark, sf_dir, "orders"), []
    for method, k in (("a", 2), ("b", 3)):
        paths.append(scratch_path(spark, f"scores-{method}"))
        write_scores(o.where(f"o_orderkey % {k} = 0").select(F.lit(method).alias("method"), "o_orderkey", "o_totalprice"), paths[-1])
    types = dict(o.dtypes)
    return read_scores(spark, *paths).select("method", *(F.col(c).cast(types[c]).alias(c) for c in ("o_orderkey", "o_totalprice")))


@query("predictions_parse", "SELECT CAST(c_custkey AS VARCHAR) AS id, 'model-x' AS _model, CAST(3 AS INTEGER) AS batch_in_name, CAST(c_custkey AS INTEGER) AS _seed, c_name AS pred, CAST(2 AS BIGINT) AS n_true, CAST(1 AS BIGINT) AS n_messages FROM customer")
def predictions_parse(spark, sf_dir):
    """One file's JSON object a customer, keyed by question id, as prediction files have it."""
    from kinquery.sources.records import parse_predictions

    record = F.to_json(F.struct(F.array(F.lit("a"), F.lit("b")).alias("true"), F.col("c_name").alias("pred"), F.struct(F.array(F.struct(F.lit("user").alias("role"), F.array(F.struct(F.lit("text").alias("type"), F.lit("hi").alias("text"))).alias("content"))).alias("messages"), F.lit("u").alias("uid")).alias("interaction"), F.struct(F.lit("model-x").alias("model"), F.lit(1).alias("type")).alias("metadata"), F.struct(F.col("c_custkey").alias("seed")).alias("inference_params")))
    files = table(spark, sf_dir, "customer").select(F.lit("x/split=a__bs=10__bn=3.json").alias("path"), F.concat(F.lit('{"'), "c_custkey", F.lit('": '), record, F.lit("}")).alias("value"))
    return parse_predictions(files).select("id", "_model", "batch_in_name", "_seed", "pred", F.size("true").cast("long").alias("n_true"), F.size("interaction.messages").cast("long").alias("n_messages"))
