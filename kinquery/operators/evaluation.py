"""Scoring of predictions and their roll-up into means, errors, pivots and leaderboards."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinquery.functions import columns as C

METRICS = ("EM", "precision", "recall", "f1")


def with_questions(preds: DataFrame, qa: DataFrame) -> DataFrame:
    """Predictions with their question's columns, and depth, size and data seed from the split's name.

    All predictions stay, matched or not. Question columns that predictions have as well are left out.
    """
    more = qa.select("id", *(c for c in qa.columns if c not in preds.columns))
    return preds.join(more, "id", "left").withColumns({"_depth": C.split_part("_split", "depth"), "_size": C.split_part("_split", "size"), "_data_seed": C.split_part("_split", "seed")})


def question_columns(qa: DataFrame) -> DataFrame:
    """hops, aggregation, solutions and the joined template, from the question records."""
    query = F.col("prolog.query")
    return qa.withColumns({"hops": C.number_of_hops(query), "aggregation": C.counts_something(query).cast("int"), "solutions": F.size("answer").cast("long"), "template": F.array_join("template", " ")})


def scored(df: DataFrame, pred: str = "pred", true: str = "true", sep: str = ",") -> DataFrame:
    """EM, precision, recall and f1 of a text against an array of true answers.

    True answers are joined by ``sep`` and cut again, so one that holds it counts as several.
    """
    have = df.withColumns({"__p": C.answer_set(F.coalesce(F.col(pred), F.lit("")), sep), "__t": C.answer_set(F.array_join(true, sep), sep)})
    p, t = F.col("__p"), F.col("__t")
    return have.withColumns({"EM": C.exact_match(p, t), "precision": C.precision(p, t), "recall": C.recall(p, t), "f1": C.f1(p, t)}).drop("__p", "__t")


def _mean(metric: str) -> Column:
    return F.avg(F.col(metric).cast("double"))


def mean_by(df: DataFrame, keys: list[str], metrics: tuple[str, ...] = METRICS) -> DataFrame:
    """Level one: the mean of each metric by key, and how many rows there are."""
    return df.groupBy(*keys).agg(*(_mean(m).alias(m) for m in metrics), F.count(F.lit(1)).alias("count"))


def mean_error(df: DataFrame, keys: list[str], metrics: tuple[str, ...] = METRICS) -> DataFrame:
    """Mean and standard error of the mean; null errors for a single row."""
    n = F.sqrt(F.count(F.lit(1)).cast("double"))
    return df.groupBy(*keys).agg(*(e for m in metrics for e in (_mean(m).alias(f"{m}_mean"), (F.stddev_samp(F.col(m).cast("double")) / n).alias(f"{m}_std"))), F.count(F.lit(1)).alias("n"))


def mean_deviation(df: DataFrame, keys: list[str], metrics: tuple[str, ...] = METRICS) -> DataFrame:
    """Mean and plain sample deviation."""
    return df.groupBy(*keys).agg(*(e for m in metrics for e in (_mean(m).alias(f"{m}_mean"), F.stddev_samp(F.col(m).cast("double")).alias(f"{m}_std"))))


def accuracy(df: DataFrame, keys: list[str], metrics: tuple[str, ...] = METRICS, two_stage: bool = True) -> DataFrame:
    """Means over questions, then (``two_stage``) over inference seeds, then mean and error over what is left.

    Without the second stage the error is over data seeds times inference seeds.
    """
    rows = mean_by(df, [*keys, "_data_seed", "_seed"], metrics)
    if two_stage:
        rows = rows.groupBy(*keys, "_data_seed").agg(*(F.avg(m).alias(m) for m in metrics))
    return mean_error(rows, keys, metrics)


def pivoted(df: DataFrame, axis: str, value: str, values: list[int] | None = None, key: str = "_model", order: list[str] | None = None) -> DataFrame:
    """One row a key, one column a value of an integer axis, ascending; keys in ``order``, others left out.

    Give ``values`` where they are known; otherwise one small job finds the distinct ones first.
    """
    if values is None:
        values = sorted(r[0] for r in df.select(F.col(axis).cast("int")).distinct().collect() if r[0] is not None)
    wide = df.groupBy(key).pivot(axis, values).agg(F.first(value, ignorenulls=True))
    if not order:
        return wide
    place = F.array_position(F.array(*map(F.lit, order)), F.col(key))
    return wide.where(place > 0).orderBy(place)


def plus_minus(mean: Column, error: Column) -> Column:
    """'m ± s' in hundredths with two decimals."""
    return F.format_string("%.2f ± %.2f", mean * 100, error * 100)


def leaderboard(df: DataFrame, methods: list[str], sizes: list[int], models: list[str] | None = None, metric: str = "f1") -> DataFrame:
    """size, model, a column a method with 'mean ± error'."""
    rows = df.where(F.col("_size").isin(sizes))
    if models is not None:
        rows = rows.where(F.lower("_model").isin([m.lower() for m in models]))
    seeds = mean_by(rows, ["_size", "_model", "method", "_data_seed", "_seed"], (metric,))
    level2 = seeds.groupBy("_size", "_model", "method", "_data_seed").agg(F.avg(metric).alias(metric))
    cells = mean_error(level2, ["_size", "_model", "method"], (metric,)).withColumn("cell", plus_minus(F.col(f"{metric}_mean"), F.col(f"{metric}_std")))
    return cells.groupBy("_size", "_model").pivot("method", methods).agg(F.first("cell")).orderBy("_size", "_model")


def method_family(method: Column | str, families: dict[str, str]) -> Column:
    """The upper header of a method's column."""
    return C.alias_of(method, families)


def out_of_context(cell: Column, size: Column, model: Column, method: Column, limit: int, models: list[str], methods: list[str], mark: str = "--") -> Column:
    """A mark in cells of in-context methods whose model can't hold a corpus that large."""
    return F.when((size > limit) & model.isin(models) & method.isin(methods), F.lit(mark)).otherwise(cell)


def compared(left: DataFrame, right: DataFrame, keys: list[str], metrics: tuple[str, ...] = METRICS, suffix: str = "_mixin") -> DataFrame:
    """Two methods' rows side by side on all keys, the right one's metrics suffixed, and the differences."""
    other = right.select(*keys, *(F.col(m).alias(f"{m}{suffix}") for m in metrics))
    return left.select(*keys, *metrics).join(other, keys).select(*keys, *metrics, *(f"{m}{suffix}" for m in metrics), *((F.col(f"{m}{suffix}") - F.col(m)).alias(f"{m}_delta") for m in metrics))


def without_aggregations(qa: DataFrame, flag: str = "is_aggregation_question", text: str = "question") -> DataFrame:
    """Questions that count nothing: by their flag, or by their text where there is none."""
    test = C.is_aggregation(text)
    return qa.where(~(F.coalesce(F.col(flag), test) if flag in qa.columns else test))


def of_templates(qa: DataFrame, templates: DataFrame) -> DataFrame:
    """Questions whose template is among those of a smaller depth."""
    return qa.join(templates.select("template").distinct(), "template", "left_semi")


def interaction_counts(df: DataFrame, interaction: str = "interaction") -> DataFrame:
    """n_messages, actions (of the assistant's messages) and n_actions, those that don't finish."""
    messages = F.coalesce(F.col(f"{interaction}.messages"), F.array().cast(df.schema[interaction].dataType["messages"].dataType))
    text = lambda m: F.array_join(F.transform(m["content"], lambda c: c["text"]), "")
    acts = F.filter(F.transform(F.filter(messages, lambda m: m["role"] == "assistant"), lambda m: C.action(text(m))), lambda a: a.isNotNull())
    return df.withColumns({"n_messages": F.size(messages).cast("long"), "actions": acts, "n_actions": F.size(F.filter(acts, lambda a: a["name"] != "Finish")).cast("long")})


def mean_count(df: DataFrame, keys: list[str], count: str = "count") -> DataFrame:
    """The mean of a count over rows, cut to an integer."""
    return df.groupBy(*keys).agg(F.avg(count).cast("int").alias(count))


def by_prefix(df: DataFrame, first: tuple[str, ...] = ("_",)) -> DataFrame:
    """Columns with one of the prefixes first, in the prefixes' order, then the others."""
    front = [c for p in first for c in df.columns if c.startswith(p)]
    return df.select(*front, *(c for c in df.columns if c not in front))


def evaluation_data(spark, predictions: str, questions: str, sep: str = ",") -> DataFrame:
    """Prediction files with their questions, split columns, question columns and scores."""
    from kinquery.sources.records import read_predictions, read_questions

    qa = question_columns(read_questions(spark, questions)).withColumnRenamed("type", "question_type").drop("split")
    return scored(with_questions(read_predictions(spark, predictions), qa), sep=sep)
