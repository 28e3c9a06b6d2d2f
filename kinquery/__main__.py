"""python -m kinquery: generate a universe, or score predictions."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from kinquery.runtime import drop_scratch, scratch_mark, ship


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="kinquery")
    sub = top.add_subparsers(dest="command", required=True)
    g = sub.add_parser("generate", help="facts, articles and questions of a new universe")
    g.add_argument("output")
    for flag, kind, default in (("--num-family-trees", int, 1), ("--max-branching-factor", int, 5), ("--max-family-tree-depth", int, 5), ("--max-family-tree-size", int, 25), ("--stop-prob", float, 0.0), ("--friendship-k", float, 3.0), ("--friendship-seed", int, 1), ("--num-questions-per-type", int, 10), ("--num-sampling-attempts", int, 100), ("--question-depth", int, 6), ("--seed", int, 1)):
        g.add_argument(flag, type=kind, default=default)
    for flag, what in (("--female-names", "a name a line"), ("--male-names", "a name a line"), ("--jobs", "a job a line"), ("--hobbies", "CSV of Hobby-name and Type")):
        g.add_argument(flag, help=f"pool file: {what} (default: spelled by a rule)")
    g.add_argument("--easy-mode", action="store_true")
    g.add_argument("--skip-solution-traces", action="store_true")
    g.add_argument("--article-format", choices=["txt", "json"], default="json")
    g.add_argument("--question-format", choices=["json_by_type", "json"], default="json_by_type")
    s = sub.add_parser("score", help="scores of prediction files against question records")
    s.add_argument("predictions")
    s.add_argument("questions")
    s.add_argument("output")
    s.add_argument("--sep", default=",")
    return top


def main(args: list[str] | None = None) -> None:
    o = parser().parse_args(args)
    spark = SparkSession.builder.appName("kinquery").getOrCreate()
    ship(spark)
    if o.command == "generate":
        from kinquery.operators.generation import Rules
        from kinquery.plans.universe import Config, build

        from kinquery.sources.records import read_hobbies, read_pool

        pool = lambda path: read_pool(spark, path) if path else []
        names = (tuple(pool(o.female_names)), tuple(pool(o.male_names)))
        hobbies = {r["category"]: r["hobbies"] for r in read_hobbies(spark, o.hobbies).collect()} if o.hobbies else None
        rules = Rules(names=names, max_depth=o.max_family_tree_depth, max_children=o.max_branching_factor, max_size=o.max_family_tree_size, stop_prob=o.stop_prob)
        config = Config(o.num_family_trees, rules, o.friendship_k, o.friendship_seed, o.seed, o.question_depth, o.num_questions_per_type, o.num_sampling_attempts, o.easy_mode, o.skip_solution_traces, o.article_format, o.question_format, pool(o.jobs) or None, hobbies)
        mark = scratch_mark()
        print(build(spark, config, o.output).timings)
        drop_scratch(spark, mark)  # all is written
    else:
        from kinquery.operators.evaluation import accuracy, scored, with_questions
        from kinquery.sources.records import read_predictions, read_questions, write_scores

        qa = read_questions(spark, o.questions).select("id", "question", F.col("type").alias("qtype"))
        rows = scored(with_questions(read_predictions(spark, o.predictions), qa), sep=o.sep)
        write_scores(accuracy(rows, ["_model", "_depth", "_size"]), o.output)


if __name__ == "__main__":
    main()
