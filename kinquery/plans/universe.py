"""A whole universe: facts, articles, questions with answers, and how long each stage took."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinquery.functions import columns as C
from kinquery.functions.templates import templates
from kinquery.operators.documents import articles
from kinquery.operators.generation import Rules, Walks, answered, generate, sample_questions
from kinquery.plans.facts import FactBase
from kinquery.plans.relations import ASKABLE, EASY
from kinquery.runtime import stored
from kinquery.sources.records import Timings, write_articles, write_questions


@dataclass
class Config:
    trees: int = 1
    rules: Rules = field(default_factory=Rules)
    friends: float = 3.0
    friend_seed: int = 1
    seed: int = 1
    depth: int = 6
    per_type: int = 10
    attempts: int = 100
    easy: bool = False
    skip_traces: bool = False
    article_format: str = "json"
    question_format: str = "json_by_type"
    jobs: list[str] | None = None  # None: spelled by a rule
    hobbies: dict[str, list[str]] | None = None


@dataclass
class Universe:
    facts: FactBase
    articles: DataFrame
    questions: DataFrame
    timings: Timings


def questions(facts: FactBase, config: Config) -> DataFrame:
    """Question records of all templates of the depth: sampled, answered, with traces and difficulty.

    Each template's records are written before the next one's are planned, so that no plan grows with
    the number of templates.
    """
    walks = Walks.of(facts, EASY if config.easy else ASKABLE, config.seed)
    out = None
    for kind, t in enumerate(templates(config.depth)):
        asked = stored(sample_questions(facts, t, config.per_type, kind, config.seed, config.attempts, walks=walks), "asked")
        rows = answered(facts, asked, t, not config.skip_traces)
        if config.skip_traces:
            rows = rows.withColumn("traces", F.lit("[]"))
        part = rows.select(
            F.col("qid").alias("id"), "question", F.col("traces").alias("solution_traces"), F.col("solutions").alias("answer"),
            F.struct("query", F.lit(t.answer).alias("answer")).alias("prolog"), F.array(*map(F.lit, t.question)).alias("template"),
            "type", "difficulty", C.is_aggregation("question").alias("is_aggregation_question"))
        part = stored(part, "questions")
        out = part if out is None else out.unionByName(part)
    return out


def build(spark: SparkSession, config: Config | None = None, output: str | None = None) -> Universe:
    """Generate a universe, and write it below ``output`` where that is given."""
    config, timings = config or Config(), Timings()
    with timings.stage("facts_generate"):
        facts = generate(spark, config.trees, config.seed, config.friend_seed, config.friends, config.rules, config.jobs, config.hobbies).cache()
    if output:
        with timings.stage("facts_save"):
            facts.save(f"{output}/facts")
    with timings.stage("articles_generate"):
        texts = articles(facts).persist()
        texts.count()
    if output:
        with timings.stage("articles_save"):
            write_articles(texts, f"{output}/articles", config.article_format)
    with timings.stage("questions_generate"):
        asked = questions(facts, config).persist()
        asked.count()
    if output:
        with timings.stage("questions_save"):
            write_questions(asked, f"{output}/questions", config.question_format)
        timings.write(spark, f"{output}/timings.csv")
    return Universe(facts, texts, asked, timings)
