"""Places and running sums within groups, however much of the table a group holds.

Rows are dealt out by ranges of (group, order) and sorted, so a large group lies in several
partitions. Each partition is read once, as a stream, and gives its rows sums that start anew at
the partition; what the partitions before it hold of its first group is one row a partition, added
up by the driver. A group of all rows is therefore spread like any other.

Null groups are a group. Rows that are alike in group and order get places in any order, and lie in
one partition. An empty table stays empty.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kinquery.runtime import stored


def group_key(value: Column) -> Column:
    """Never null, null first, otherwise in the order of the bytes of the value as text."""
    return F.coalesce(F.concat(F.lit("="), value.cast("string")), F.lit(""))


def in_ranges(df: DataFrame, group: str, order: list[str | Column]) -> DataFrame:
    """Rows dealt out by ranges of (group, order) and sorted, with their partition's number."""
    return df.repartitionByRange(group, *order).sortWithinPartitions(group, *order).withColumn("__part", F.spark_partition_id())


def running(df: DataFrame, group: str, sums: dict[str, str]) -> DataFrame:
    """Adds for every row of sorted partitions what its group had before it in the same partition.

    ``sums``: name of a new column, to the long column it adds up. ``__first``: whether the row's
    group is its partition's first, to which rows of earlier partitions may belong. ``__row``: the
    row's place in the partition.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, first_key, so_far, rows = None, None, dict.fromkeys(sums, 0), 0
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            keys = batch.column(group)
            new = np.ones(n, bool)
            new[1:] = pc.not_equal(keys[1:], keys[:-1]).to_numpy(zero_copy_only=False)
            begin, end = keys[0].as_py(), keys[n - 1].as_py()
            first_key = begin if first_key is None else first_key
            goes_on = last == begin
            new[0] = not goes_on
            heads = np.maximum.accumulate(np.where(new, np.arange(n), -1))  # -1: the group began in an earlier batch
            out = batch
            for name, source in sums.items():
                value = batch.column(source).to_numpy(zero_copy_only=False).astype(np.int64)
                before = np.concatenate([[0], np.cumsum(value)])
                here = before[:-1] - np.where(heads >= 0, before[np.maximum(heads, 0)], -so_far[name])
                so_far[name] = int(here[-1] + value[-1])
                out = out.append_column(name, pa.array(here))
            out = out.append_column("__first", pc.equal(keys, first_key))
            out = out.append_column("__row", pa.array(np.arange(rows, rows + n)))
            rows, last = rows + n, end
            yield out

    extra = [T.StructField(name, T.LongType()) for name in sums] + [T.StructField("__first", T.BooleanType()), T.StructField("__row", T.LongType())]
    return df.mapInArrow(run, T.StructType([*df.schema.fields, *extra]))


def carries(written: DataFrame, group: str, sums: dict[str, str]) -> DataFrame:
    """(__part, __carry_<name> ...) of the partitions whose first group began in an earlier one; one row a partition at most.

    ``written``: what ``running`` gave, as stored.
    """
    ends = F.struct(F.col("__row").alias("row"), F.col(group).alias("key"), *((F.col(name) + F.col(source)).alias(name) for name, source in sums.items()))
    parts = written.groupBy("__part").agg(F.max(ends).alias("last"), F.min(F.struct("__row", F.col(group).alias("key"))).alias("first")).orderBy("__part").collect()
    rows, open_key, open_sums = [], None, dict.fromkeys(sums, 0)
    for part in parts:
        first, last = part["first"]["key"], part["last"]["key"]
        had = dict(open_sums) if first == open_key else dict.fromkeys(sums, 0)
        if any(had.values()):
            rows.append((part["__part"], *had.values()))
        open_sums = {name: part["last"][name] + (had[name] if first == last else 0) for name in sums}
        open_key = last
    schema = T.StructType([T.StructField("__part", T.IntegerType()), *(T.StructField(f"__carry_{name}", T.LongType()) for name in sums)])
    return written.sparkSession.createDataFrame(rows, schema)


def with_carries(written: DataFrame, carry: DataFrame, names: list[str]) -> DataFrame:
    """Sums over whole groups: those of ``running``, and the carry for rows of a partition's first group."""
    joined = written.join(F.broadcast(carry), "__part", "left")  # a row a partition at most
    whole = {name: F.col(name) + F.when(F.col("__first"), F.coalesce(F.col(f"__carry_{name}"), F.lit(0))).otherwise(0) for name in names}
    return joined.withColumns(whole).drop(*(f"__carry_{name}" for name in names))


def placed(df: DataFrame, group: str, order: list[str | Column], what: str, name: str = "place") -> DataFrame:
    """All columns, and the row's place in its group from 0. The table is written once, in order."""
    one = in_ranges(df, group, order).withColumn("__one", F.lit(1).cast("long"))
    written = stored(running(one, group, {name: "__one"}), what)
    return with_carries(written, carries(written, group, {name: "__one"}), [name]).drop("__one", "__part", "__first", "__row")
