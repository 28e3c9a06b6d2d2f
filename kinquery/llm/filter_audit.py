"""How filters interact: what each removes in every order of application, by source.

A row's failed filters are five bits. Rows are counted by (part, bits, labels) on the JVM first, a
few rows a part; ``mapInArrow`` then looks each up in a precomputed table of 32 sets of failures by
120 orders, which holds the step of the first failure, and adds up removals by part, order and step
with ``np.bincount``, once a label. Partial sums of the tasks are added up by Spark.

Duplicates: texts are told apart by their SHA-256. The first four bits depend on the text alone, so
rows of one text are counted by (text, part, labels) before they meet; of a text with any number of
copies only those counts are compared. A row fails E if a smaller id has its text; rows of the
smallest id don't fail, be they several, and null ids neither fail nor count as smaller.

Null texts are empty and fail A (no words) but not B (0 of 0) or C; empty texts are equal to each
other and to null ones. Null sources are the part of the empty source. A document's labels are 1 if
any of its label rows has 1; null ids have no labels. Parts come from documents alone. An empty table has no rows.
Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

FILTERS = "ABCDE"
ORDERS = ["".join(p) for p in permutations(FILTERS)]
_AT = np.array([[FILTERS.index(c) for c in order] for order in ORDERS])  # order, step: filter
_SETS = np.arange(1 << len(FILTERS))
_FAILS = (_SETS[:, None, None] >> _AT[None]) & 1 == 1  # set, order, step
#: Set of failures, order: the step (from 1) at which it is removed; 0: never.
FIRST = np.where(_FAILS.any(axis=2), _FAILS.argmax(axis=2) + 1, 0)
#: Set of failures, order, step: fails here but was removed earlier.
LATE = _FAILS & (FIRST[:, :, None] < np.arange(1, len(FILTERS) + 1))
#: Set of failures, order, step: fails this filter only.
ONLY = _SETS[:, None, None] == (1 << _AT[None])


def failures(text: Column, min_words: int = 200, distinct_pct: int = 50, upper_pct: int = 2) -> Column:
    """Bits of the filters A to D that a non-null text fails."""
    words = F.array_remove(F.split(text, r"[\x20\x09-\x0D]+", -1), "")
    n, distinct = F.size(words), F.size(F.array_distinct(words))
    points = F.length(text)
    upper = points - F.length(F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", ""))
    bit = lambda k, fails: F.when(fails, 1 << k).otherwise(0)
    return bit(0, n < min_words) + bit(1, 100 * distinct < distinct_pct * n) + bit(2, 100 * upper.cast("long") > upper_pct * points.cast("long")) + bit(3, text.rlike(r"[#$%&*|]"))


def failure_counts(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """part, fails (five bits), good, toxic, n: how many rows; at most 128 rows a part."""
    text = F.coalesce("text", F.lit(""))
    rows = docs.select("doc_id", F.coalesce("source", F.lit("")).alias("part"), F.unhex(F.sha2(text, 256)).alias("digest"), failures(text).alias("fails"))
    rows = rows.groupBy("doc_id", "part", "digest", "fails").agg(F.count("*").alias("n"))
    one = labels.where(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(*(F.coalesce(F.max((F.col(c) == 1).cast("int")), F.lit(0)).alias(as_) for c, as_ in (("quality", "good"), ("toxic", "toxic"))))
    rows = rows.join(one, "doc_id", "left").fillna(0, ["good", "toxic"])
    has_id = F.col("doc_id").isNotNull()
    texts = rows.groupBy("digest", "part", "fails", "good", "toxic").agg(
        F.sum("n").alias("n"), F.coalesce(F.sum(F.when(~has_id, F.col("n"))), F.lit(0)).alias("unnamed"), F.min(F.when(has_id, F.struct("doc_id", "n"))).alias("least")
    )
    smallest = F.min("least.doc_id").over(Window.partitionBy("digest"))
    unique = F.col("unnamed") + F.when(F.col("least.doc_id") == smallest, F.col("least.n")).otherwise(0)
    split = texts.withColumn("unique", unique).select("part", "good", "toxic", F.explode(F.array(F.struct(F.col("fails"), F.col("unique").alias("n")), F.struct((F.col("fails") + 16).alias("fails"), (F.col("n") - F.col("unique")).alias("n")))).alias("s"))
    return split.select("part", "good", "toxic", "s.fails", "s.n").where("n > 0").groupBy("part", "fails", "good", "toxic").agg(F.sum("n").alias("n"))


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Partial sums a part, order and step; a batch at a time, so a task holds a batch's parts only."""
    orders, steps = _AT.shape
    for whole in batches:
        for lo in range(0, whole.num_rows, 1024):
            batch = whole.slice(lo, 1024)
            coded = batch.column("part").dictionary_encode()
            parts, part = coded.dictionary, coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
            fails, n = batch.column("fails").to_numpy(), batch.column("n").to_numpy()
            good, toxic = (batch.column(c).to_numpy() for c in ("good", "toxic"))
            size = len(parts) * orders * (steps + 1)
            cell = ((part[:, None] * orders + np.arange(orders)) * (steps + 1) + FIRST[fails]).ravel()

            def removed(weight: np.ndarray) -> np.ndarray:
                found = np.bincount(cell, np.repeat(weight, orders), size)  # doubles, exact to 2**53
                return found.reshape(len(parts), orders, steps + 1)[:, :, 1:]

            def by_table(table: np.ndarray) -> np.ndarray:
                out = np.zeros((len(parts), orders, steps), np.int64)
                np.add.at(out, part, table[fails] * n[:, None, None])
                return out

            total = np.bincount(part, n, len(parts))[:, None, None] * np.ones((1, orders, steps))
            sums = [removed(n), by_table(LATE), by_table(ONLY), removed(n * good), removed(n * toxic), total]
            k = np.indices((len(parts), orders, steps)).reshape(3, -1)
            ids = [parts.take(pa.array(k[0])), pa.array(np.array(ORDERS)[k[1]]), pa.array((k[2] + 1).astype(np.int32))]
            yield pa.RecordBatch.from_arrays([*ids, *(pa.array(s.astype(np.int64).ravel()) for s in sums)], ["part", "filter_order", "step", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "total"])


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row a part, order of the filters and step."""
    sums = ["removed", "redundant", "unique_fails", "good_lost", "toxic_lost"]
    counts = failure_counts(docs, labels).repartition("part")  # 128 rows a part at most, so a part's partial sums come from one task
    partial = counts.mapInArrow(_count, "part string, filter_order string, step int, " + ", ".join(f"{c} long" for c in [*sums, "total"]))
    whole = partial.groupBy("part", "filter_order", "step").agg(*(F.sum(c).alias(c) for c in [*sums, "total"]))
    so_far = Window.partitionBy("part", "filter_order").orderBy("step").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    letter = F.substring(F.col("filter_order"), F.col("step"), F.lit(1))
    return whole.withColumns({"kept": F.col("total") - F.sum("removed").over(so_far), "shapley": F.sum("removed").over(Window.partitionBy("part", letter))}).select("part", "filter_order", "step", "kept", *sums, "shapley")
