"""Majority votes and usage sums."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinquery.functions import columns as C


def majority(votes: DataFrame, by: list[str], pred: str = "pred", sep: str = ",") -> DataFrame:
    """by, pred, error: the answers more than half of a question's votes have, in order of their text.

    A vote is a set of answers. Without a majority pred is empty and error says so; a null vote is
    an empty answer.
    """
    sets = votes.select(*by, C.answer_set(F.coalesce(F.col(pred), F.lit("")), sep).alias("a"))
    n = sets.groupBy(*by).agg(F.count(F.lit(1)).alias("n"))
    counts = sets.select(*by, F.explode("a").alias("a")).groupBy(*by, "a").agg(F.count(F.lit(1)).alias("c"))
    won = counts.join(n, by).where(F.col("c") * 2 > F.col("n")).groupBy(*by).agg(F.array_join(F.array_sort(F.collect_list("a")), sep).alias("pred"))
    return n.join(won, by, "left").select(*by, F.coalesce("pred", F.lit("")).alias("pred"), F.when(F.col("pred").isNull(), F.lit("No majority vote")).alias("error"))


def usage_sum(usage: DataFrame, by: list[str], column: str = "usage") -> DataFrame:
    """by, path, total: leaves of JSON usage objects added up by dotted path; null and missing count 0.

    The paths are those of each group's objects, however deep; a group of empty objects has no
    rows. How deep they are is counted first (brackets inside quotes count too, which does no harm).
    """
    step = lambda s, c: F.struct((s["now"] + F.when(c == "{", 1).when(c == "}", -1).otherwise(0)).alias("now"), F.greatest(s["most"], s["now"] + F.when(c == "{", 1).otherwise(0)).alias("most"))
    braces = F.split(F.regexp_replace(F.coalesce(F.col(column), F.lit("")), "[^{}]", ""), "")
    depth = usage.agg(F.max(F.aggregate(braces, F.struct(F.lit(0).alias("now"), F.lit(0).alias("most")), step)["most"])).first()[0] or 1
    return usage.select(*by, F.explode(_leaves(F.col(column), depth)).alias("l")).groupBy(*by, F.col("l.path").alias("path")).agg(F.sum(F.coalesce("l.value", F.lit(0.0))).alias("total"))


def _leaves(text: Column, depth: int) -> Column:
    """(path, value) of the leaves of a JSON object of at most ``depth`` levels, opened level by level."""
    entries = lambda t: F.coalesce(F.map_entries(F.from_json(t, "map<string,string>")), F.array().cast("array<struct<key:string,value:string>>"))

    def opened(x: Column) -> Column:
        inner = F.transform(entries(x["value"]), lambda e: F.struct(F.concat_ws(".", x["path"], e["key"]).alias("path"), e["value"].alias("value")))
        return F.when(F.startswith(F.coalesce(x["value"], F.lit("")), F.lit("{")), inner).otherwise(F.array(x))

    rows = F.array(F.struct(F.lit(None).cast("string").alias("path"), F.coalesce(text, F.lit("{}")).alias("value")))
    for _ in range(depth):
        rows = F.flatten(F.transform(rows, opened))
    return F.transform(rows, lambda x: F.struct(x["path"].alias("path"), x["value"].try_cast("double").alias("value")))


def with_fallback(first: DataFrame, second: DataFrame, key: str, prefix: str) -> DataFrame:
    """Each key's row of ``first``, or ``second``'s where the first's error starts with ``prefix``."""
    a, b = first.alias("a"), second.select(F.col(key), *(F.col(c).alias(f"__{c}") for c in ("pred", "error"))).alias("b")
    use = F.startswith(F.coalesce(F.col("error"), F.lit("")), F.lit(prefix)) & F.col("__has").isNotNull()
    joined = a.join(b.withColumn("__has", F.lit(1)), key, "left")
    return joined.withColumns({"pred": F.when(use, F.col("__pred")).otherwise(F.col("pred")), "error": F.when(use, F.col("__error")).otherwise(F.col("error"))}).drop("__pred", "__error", "__has")
