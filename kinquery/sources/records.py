"""Readers and writers of corpora, questions, predictions, scores, pools and limits."""

from __future__ import annotations

import json
import re
import time
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kinquery.functions import columns as C

CORPUS = "title string, article string, facts array<string>"
QUESTIONS = "id string, question string, solution_traces string, answer array<string>, prolog struct<query:array<string>,answer:string>, template array<string>, type bigint, difficulty bigint, is_aggregation_question boolean"
MESSAGES = "array<struct<role:string,content:array<struct<type:string,text:string>>>>"
CONVERSATION = f"messages {MESSAGES}, uid string"
PREDICTION = (
    "struct<true:array<string>,pred:string,prolog_query:string,prolog_query_results:string,error:string,interaction:string,"
    "metadata:struct<model:string,dataset:string,split:string,batch_size:int,batch_number:int,type:int,difficulty:int>,"
    "inference_params:struct<max_tokens:int,repetition_penalty:double,seed:int,stop_sequences:array<string>,temperature:double,top_p:double,top_k:int,max_retries:int,wait_seconds:int>,"
    "model_kwargs:string,agent_kwargs:string,usage:string>"
)


def _split_of() -> Column:
    """The folder of the file a row is from."""
    return F.url_decode(F.element_at(F.split(F.input_file_name(), "/"), -2))


def read_corpus(spark: SparkSession, *paths: str, lines: bool = False) -> DataFrame:
    """title, article, facts of JSON arrays (or lines), with the folder of each file as its split."""
    return spark.read.schema(CORPUS).option("multiLine", not lines).json(list(paths)).withColumn("split", _split_of())


def read_questions(spark: SparkSession, *paths: str, lines: bool = False) -> DataFrame:
    """Question records of JSON arrays (or lines); the older name of the traces' column is taken as well."""
    old = QUESTIONS.replace("solution_traces string", "solution_traces string, intermediate_answers string")
    df = spark.read.schema(old).option("multiLine", not lines).json(list(paths))
    return df.withColumn("solution_traces", F.coalesce("solution_traces", "intermediate_answers")).drop("intermediate_answers").withColumn("split", _split_of())


def read_database_text(spark: SparkSession, *paths: str) -> DataFrame:
    """content: each file's whole text."""
    return spark.read.text(list(paths), wholetext=True).select(F.col("value").alias("content"))


def splits_below(spark: SparkSession, path: str) -> list[tuple[str, str]]:
    """(split, path) of each folder below ``path`` whose name doesn't start with a dot; or the path itself."""
    jvm = spark._jvm
    root = jvm.org.apache.hadoop.fs.Path(path)
    fs = root.getFileSystem(spark._jsc.hadoopConfiguration())
    found = [s.getPath() for s in fs.listStatus(root) if s.isDirectory() and not s.getPath().getName().startswith(".")]
    return sorted((p.getName(), p.toString()) for p in found) or [(root.getName(), path)]


def load_split(spark: SparkSession, path: str, split: str, exclude_aggregation_questions: bool = False) -> dict[str, DataFrame]:
    """corpus, questions and database of one split.

    A split that isn't there is taken from one of greater depth with the same size and seed, with
    only the questions whose template the smaller depth has.
    """
    from kinquery.functions.templates import templates
    from kinquery.operators.evaluation import without_aggregations

    have = dict(splits_below(spark, path))
    depth = None
    if split not in have:
        m = re.match(r"depth_(\d+)_(size_\d+_seed_\d+)$", split)
        deeper = sorted((int(n.split("_")[1]), n) for n in have if m and n.endswith(m[2]) and n.startswith("depth_") and int(n.split("_")[1]) > int(m[1]))
        if not deeper:
            raise ValueError(f"no split {split}")
        depth, split = int(m[1]), deeper[0][1]
    base = have[split]
    qa = read_questions(spark, f"{base}/questions*.json")
    if depth is not None:
        known = spark.createDataFrame([(t.question,) for t in templates(depth)], "template array<string>")
        qa = qa.join(known, "template", "left_semi")
    if exclude_aggregation_questions:
        qa = without_aggregations(qa)
    return {"text_corpus": read_corpus(spark, f"{base}/articles*.json"), "qa_pairs": qa, "database": read_database_text(spark, f"{base}/facts.pl")}


def parse_predictions(files: DataFrame, path: str = "path", text: str = "value") -> DataFrame:
    """Predictions of files that hold one JSON object keyed by question id: a row an id.

    ``_batch_number`` and others come from each record's metadata, ``batch_in_name`` from the path.
    """
    rows = files.select(F.regexp_extract(path, r"bn=(\d+)", 1).alias("bn"), F.explode(F.from_json(text, f"map<string,{PREDICTION}>")).alias("id", "r"))
    meta = {f"_{k}": F.col(f"r.metadata.{k}") for k in ("model", "dataset", "split", "batch_size", "batch_number", "type")}
    out = rows.select("id", F.when(F.col("bn") != "", F.col("bn")).cast("int").alias("batch_in_name"), "r.*", *(v.alias(k) for k, v in meta.items()), F.col("r.inference_params.seed").alias("_seed"))
    talk = F.from_json("interaction", CONVERSATION)
    return out.withColumn("interaction", F.when(F.startswith(F.coalesce(C.strip("interaction"), F.lit("")), F.lit("{")), talk)).drop("metadata")


def read_predictions(spark: SparkSession, *paths: str) -> DataFrame:
    files = spark.read.text(list(paths), wholetext=True).withColumn("path", F.url_decode(F.input_file_name()))
    return parse_predictions(files)


def read_scores(spark: SparkSession, *paths: str) -> DataFrame:
    """Score files of several methods, one below the other."""
    return spark.read.csv(list(paths), header=True, inferSchema=True).withColumn("file", F.input_file_name())


def read_conversations(spark: SparkSession, *paths: str) -> DataFrame:
    return spark.read.schema(CONVERSATION).option("multiLine", True).json(list(paths))


def read_passages(spark: SparkSession, *paths: str) -> DataFrame:
    """id, title, body of (id, contents) lines: the first line is the title."""
    df = spark.read.schema("id string, contents string").json(list(paths))
    return df.select("id", C.title_of("contents").alias("title"), C.body_of("contents").alias("body"), "contents")


def read_hobbies(spark: SparkSession, path: str) -> DataFrame:
    """category, hobbies of a CSV of (Hobby-name, Type)."""
    df = spark.read.csv(path, header=True)
    return df.groupBy(F.col("Type").alias("category")).agg(F.array_sort(F.collect_list(F.lower("`Hobby-name`"))).alias("hobbies"))


def read_pool(spark: SparkSession, path: str) -> list[str]:
    """A pool of names or jobs, one a line; empty lines and what follows # don't count."""
    text = C.strip(F.split("value", "#")[0])
    return [r[0] for r in spark.read.text(path).select(text.alias("v")).where("v <> ''").collect()]  # a pool is a settings file


def read_limits(spark: SparkSession, path: str) -> DataFrame:
    """server, model, tier, rpm, tpm of an indented file: server, then model, then usage_tier=k, then RPM and TPM."""
    stack: list[tuple[int, str]] = []
    rows: dict[tuple[str, str, int], dict[str, int]] = {}
    for (line,) in spark.read.text(path).collect():  # a settings file, a few lines a model
        body = line.split("#")[0].rstrip()
        if not body.strip():
            continue
        depth = len(body) - len(body.lstrip())
        key, _, value = body.strip().rpartition(":") if not body.strip().endswith(":") else (body.strip()[:-1], "", "")
        while stack and stack[-1][0] >= depth:
            stack.pop()
        if value.strip():
            server, model, tier = (s for _, s in stack[:3])
            rows.setdefault((server, model, int(tier.rpartition("=")[2])), {})[key.strip().lower()] = int(value.strip().replace("_", ""))
        else:
            stack.append((depth, key.strip().strip("\"'")))
    return spark.createDataFrame([(*k, v.get("rpm"), v.get("tpm")) for k, v in rows.items()], "server string, model string, tier int, rpm long, tpm long")


def export_passages(corpus: DataFrame, path: str) -> None:
    """(id, contents) JSON lines for an external retriever."""
    passages(corpus).write.json(path)


def passages(corpus: DataFrame, title: str = "title", text: str = "article") -> DataFrame:
    return corpus.select(F.col(title).alias("id"), F.concat(F.lit('"'), F.col(title), F.lit('"\n'), F.col(text)).alias("contents"))


def retriever_questions(qa: DataFrame) -> DataFrame:
    """(id, question, golden_answers) for an external retriever."""
    return qa.select("id", "question", F.col("answer").alias("golden_answers"))


def export_questions(qa: DataFrame, path: str) -> None:
    retriever_questions(qa).write.json(path)


def write_actions(rows: DataFrame, path: str, actions: str = "actions") -> None:
    """Action lists as CSV, each list a JSON text."""
    rows.withColumn(actions, F.to_json(actions)).select(*(c for c, t in rows.dtypes if c == actions or "<" not in t)).write.mode("overwrite").csv(path, header=True)


def write_articles(articles: DataFrame, path: str, form: str = "json") -> None:
    """Articles as JSON lines, or as a text file a title (with its facts beside it)."""
    if form == "json":
        articles.write.json(path)
    else:
        articles.select("title", F.col("article").alias("value")).write.partitionBy("title").text(f"{path}/articles")
        articles.select("title", F.array_join("facts", "\n").alias("value")).write.partitionBy("title").text(f"{path}/facts")


def write_questions(questions: DataFrame, path: str, form: str = "json_by_type") -> None:
    (questions.write.partitionBy("type") if form == "json_by_type" else questions.write).json(path)


def write_predictions(preds: DataFrame, path: str, force: bool = False) -> None:
    """Left as it is if it is there, unless forced."""
    preds.write.mode("overwrite" if force else "ignore").json(path)


def write_scores(scores: DataFrame, path: str) -> None:
    """A report of one file."""
    scores.coalesce(1).write.mode("overwrite").csv(path, header=True)


class Timings:
    """Seconds of each stage of a run, as one row."""

    def __init__(self) -> None:
        self.seconds: dict[str, float] = {}

    @contextmanager
    def stage(self, name: str):
        start = time.perf_counter()
        try:
            yield
        finally:
            self.seconds[name] = self.seconds.get(name, 0.0) + time.perf_counter() - start

    def write(self, spark: SparkSession, path: str) -> None:
        row = {**self.seconds, "total": sum(self.seconds.values())}
        spark.createDataFrame([tuple(row.values())], [*row]).coalesce(1).write.mode("overwrite").csv(path, header=True)

    def __repr__(self) -> str:
        return json.dumps(self.seconds)
