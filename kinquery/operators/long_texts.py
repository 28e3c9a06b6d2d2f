"""Texts of a group joined in order, without a row that holds a whole group.

Rows are dealt out by ranges of (group, order), so a group with any share of them lies in several
partitions. Each partition joins its rows as a stream into parts of about ``most`` characters; where a
part begins in its group's joined text follows from what the partitions before it hold, a row each.
A part holds whole texts, so it is longer than ``most`` only if a single text is.

Null texts are left out, as an SQL ``string_agg`` does; null groups are a group. Rows alike in group,
order and text are texts of their own. An empty table has no parts.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kinquery.operators.numbering import carries, group_key, in_ranges, running, with_carries
from kinquery.runtime import stored

_SUMS = {"start": "chars"}


def joined_parts(docs: DataFrame, by: str, order: str, text: str, separator: str = "\n", most: int = 1 << 20) -> DataFrame:
    """by, start, n_chars, n_texts, part: in order of start the parts are the group's joined text.

    Between two parts of a group stands one ``separator``, which is in neither: start counts it.
    """
    rows = docs.where(F.col(text).isNotNull()).select(group_key(F.col(by)).alias("grp"), F.col(by).alias("by"), F.col(order).alias("o"), F.col(text).alias("text"))
    sized = in_ranges(rows, "grp", ["o", "text"]).withColumn("chars", (F.length("text") + len(separator)).cast("long"))
    laid = running(sized, "grp", _SUMS).drop("o")
    kept = [laid.schema[c] for c in ("grp", "by", "__part", "__first", "__row", "start")]
    schema = T.StructType([*kept, T.StructField("chars", T.LongType()), T.StructField("n_texts", T.LongType()), T.StructField("part", T.StringType())])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, texts, size = None, [], 0
        names = schema.fieldNames()

        def flush() -> pa.RecordBatch:
            row = [*held, size, len(texts), separator.join(texts)]
            return pa.RecordBatch.from_pylist([dict(zip(names, row, strict=True))], kinds)

        from pyspark.sql.pandas.types import to_arrow_schema

        kinds = to_arrow_schema(schema)
        for batch in batches:
            cols = [batch.column(f.name) for f in kept]
            for at in range(0, batch.num_rows, 64):
                some = [c.slice(at, 64).to_pylist() for c in cols]
                for *head, chars, value in zip(*some, batch.column("chars").slice(at, 64).to_pylist(), batch.column("text").slice(at, 64).to_pylist(), strict=True):
                    if texts and (head[0] != held[0] or size + chars > most):
                        yield flush()
                        texts, size = [], 0
                    if not texts:
                        held = head
                    texts.append(value)
                    size += chars
        if texts:
            yield flush()

    written = stored(laid.mapInArrow(cut, schema), "parts")
    whole = with_carries(written, carries(written, "grp", _SUMS), ["start"])
    return whole.select(F.col("by").alias(by), "start", (F.col("chars") - len(separator)).alias("n_chars"), "n_texts", "part")


def digests(parts: DataFrame, by: str, separator: str = "\n") -> DataFrame:
    """by, n_chars, md5 of each group's joined text, read part by part; a task holds a batch of parts."""
    kind = parts.schema[by]
    schema = T.StructType([T.StructField("by", kind.dataType), T.StructField("n_chars", T.LongType()), T.StructField("md5", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        kinds, last, done = to_arrow_schema(schema), None, None
        for batch in batches:
            for i in range(batch.num_rows):
                key, group, n, part = (batch.column(c)[i].as_py() for c in ("key", "by", "n_chars", "part"))
                if key != last:
                    if done:
                        yield pa.RecordBatch.from_pylist([{"by": done[0], "n_chars": done[1], "md5": done[2].hexdigest()}], kinds)
                    last, done = key, [group, 0, hashlib.md5()]
                else:
                    done[1] += len(separator)
                    done[2].update(separator.encode())
                done[1] += n
                done[2].update(part.encode("utf-8", "surrogatepass"))
        if done:
            yield pa.RecordBatch.from_pylist([{"by": done[0], "n_chars": done[1], "md5": done[2].hexdigest()}], kinds)

    rows = parts.select(group_key(F.col(by)).alias("key"), F.col(by).alias("by"), "start", "n_chars", "part")
    return rows.repartition("key").sortWithinPartitions("key", "start").mapInArrow(run, schema).withColumnRenamed("by", by)


def whole_texts(parts: DataFrame, by: str, separator: str = "\n", name: str = "text") -> DataFrame:
    """by, text: the parts of each group put together, for groups that fit a row."""
    listed: Column = F.array_sort(F.collect_list(F.struct("start", "part")))
    return parts.groupBy(by).agg(F.array_join(F.transform(listed, lambda p: p["part"]), separator).alias(name))
