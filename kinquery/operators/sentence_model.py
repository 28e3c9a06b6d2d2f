"""Sentence boundaries by abbreviations that are learned from the texts themselves.

A full stop ends a sentence unless its word is an abbreviation. Which words are is told by how much
better "almost always has a full stop" explains their counts than "has one as often as any word"
(a log-likelihood ratio), weighed down for long words and for each time the word stands without one,
and up for full stops inside. After an abbreviation a sentence still ends where the next word begins
with a capital although it is otherwise written small, and never with a capital inside a sentence.

One aggregation over all words gives the statistics, a row a word; what is applied are the words that
matter (abbreviations, and how their followers are written), joined to the words of the texts, broadcast by
Spark while they are small. Null and empty texts have no sentences. Words are runs of what isn't white space.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ACCEPT = 0.3
ALWAYS = 0.99


def words(text: Column) -> Column:
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), r"\s+", -1), "")


def _core(word: Column) -> Column:
    """A word without outer marks, its end marks kept."""
    return F.regexp_replace(word, r"^[^\p{L}\p{N}]+|[^\p{L}\p{N}.!?]+$", "")


def _type(word: Column) -> Column:
    return F.lower(F.regexp_replace(_core(word), r"[.!?]+$", ""))


def _stopped(word: Column) -> Column:
    """Whether the word ends with one full stop."""
    return _core(word).rlike(r"[^.]\.$")


def _ends(word: Column) -> Column:
    return F.coalesce(_core(word).rlike(r"[.!?]$"), F.lit(False))


def _placed(docs: DataFrame, doc: str, text: str) -> DataFrame:
    """__d, i, w, before, after: a row a word, with its neighbours."""
    listed = docs.select(F.col(doc).alias("__d"), words(F.col(text)).alias("ws"))
    return listed.select("__d", "ws", F.posexplode("ws").alias("i", "w")).select("__d", "i", "w", F.get("ws", F.col("i") - 1).alias("before"), F.get("ws", F.col("i") + 1).alias("after"))


def statistics(docs: DataFrame, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """word, stopped, plain, small, capital_inside, score: of every word in lower case.

    small: how often it begins with a small letter; capital_inside: with a capital one, not first in a
    text and not after an end mark. The score is null for words that never have a full stop.
    """
    w, core = F.col("w"), _core(F.col("w"))
    seen = _placed(docs, doc, text).select(
        _type(w).alias("word"), _stopped(w).cast("int").alias("s"), core.rlike(r"^\p{Ll}").cast("int").alias("l"), (core.rlike(r"^\p{Lu}") & F.col("before").isNotNull() & ~_ends(F.col("before"))).cast("int").alias("c")
    ).where("word <> ''")
    types = seen.groupBy("word").agg(F.sum("s").alias("stopped"), (F.count(F.lit(1)) - F.sum("s")).alias("plain"), F.sum("l").alias("small"), F.sum("c").alias("capital_inside"))
    whole = types.agg((F.sum("stopped") / F.sum(F.col("stopped") + F.col("plain"))).alias("share"))  # one row
    k, n = F.col("stopped").cast("double"), (F.col("stopped") + F.col("plain")).cast("double")
    share = F.least(F.greatest(F.col("share"), F.lit(1e-9)), F.lit(1 - 1e-9))
    better = 2 * (k * math.log(ALWAYS) + (n - k) * math.log(1 - ALWAYS) - k * F.log(share) - (n - k) * F.log(1 - share))
    length = F.length(F.replace("word", F.lit("."))).cast("double")
    score = better * F.exp(-length) * (F.length("word") - length + 1) * F.pow(F.greatest(length, F.lit(1.0)), -F.col("plain").cast("double"))
    return types.crossJoin(F.broadcast(whole)).select("word", "stopped", "plain", "small", "capital_inside", F.when((k > 0) & F.col("word").rlike(r"\p{L}"), score).alias("score"))


def learned_sentences(docs: DataFrame, stats: DataFrame, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """doc, n (from 0), sentence: the sentences of each text in order, their words parted by one space.

    Documents are told by ``doc``, which must differ; a text's words are put together in its own row.
    """
    w, after = F.col("w"), F.col("after")
    short = stats.where(F.col("score") >= ACCEPT).select(F.col("word").alias("__short"), F.lit(True).alias("short"))
    fresh = stats.where("small > 0 and capital_inside = 0").select(F.col("word").alias("__next"), F.lit(True).alias("fresh"))
    rows = _placed(docs, doc, text).withColumns({"__short": F.when(_stopped(w), _type(w)), "__next": F.when(_core(after).rlike(r"^\p{Lu}"), _type(after))})
    rows = rows.join(short, "__short", "left").join(fresh, "__next", "left")
    ends = _ends(w) & (~F.coalesce("short", F.lit(False)) | F.coalesce("fresh", F.lit(False)))
    listed = F.array_sort(F.collect_list(F.struct("i", "w", ends.alias("end"))))
    joined = F.array_join(F.transform(listed, lambda x: F.concat(x["w"], F.when(x["end"], F.lit("\n")).otherwise(F.lit(" ")))), "")
    found = rows.groupBy("__d").agg(F.regexp_replace(joined, r"\s$", "").alias("t"))
    return found.select(F.col("__d").alias(doc), F.posexplode(F.split("t", "\n", -1)).alias("n", "sentence"))
