"""Histograms, grids, interpolation, batches, rate windows and reshaping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T


def integer_histogram(df: DataFrame, value: str, low: int = 1, high: int = 20, by: list[str] | None = None) -> DataFrame:
    """by, bin, n, density over [low, low+1), ..., the last bin closed; values outside count nowhere."""
    by = by or []
    b = F.least(F.floor(value), F.lit(high - 1)).cast("long")
    counts = df.where((F.col(value) >= low) & (F.col(value) <= high)).groupBy(*by, b.alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumn("density", F.col("n") / F.sum("n").over(W.partitionBy(*by)))


def equal_width_histogram(df: DataFrame, value: str, bins: int = 20) -> DataFrame:
    """bin (from 0), n, density over equal parts of the range; the last bin closed. Nulls count nowhere."""
    ends = df.agg(F.min(value).cast("double").alias("lo"), F.max(value).cast("double").alias("hi"), F.count(value).alias("total"))
    rows = df.where(F.col(value).isNotNull()).select(F.col(value).cast("double").alias("v")).crossJoin(F.broadcast(ends))
    width = F.when(F.col("hi") > F.col("lo"), (F.col("hi") - F.col("lo")) / bins).otherwise(F.lit(1.0 / bins))
    b = F.least(F.floor((F.col("v") - F.col("lo")) / width), F.lit(bins - 1)).cast("long")
    return rows.groupBy(b.alias("bin"), "total", width.alias("w")).agg(F.count(F.lit(1)).alias("n")).select("bin", "n", (F.col("n") / (F.col("total") * F.col("w"))).alias("density"))


def dense_grid(df: DataFrame, a: str, b: str, value: str) -> DataFrame:
    """A row for each pair of an a and a b that occur, its value null where the pair doesn't."""
    pairs = df.select(a).distinct().crossJoin(df.select(b).distinct())  # distinct axis values, as a grid has them
    return pairs.join(df.select(a, b, value), [a, b], "left")


def padded_grid(df: DataFrame, a: str, low: int, high: int, step: int, b: str, value: str, fill: float) -> DataFrame:
    """Rows and, for each value of b, rows at a in low..high with a fill value."""
    ticks = df.select(b).distinct().select(F.explode(F.sequence(F.lit(low), F.lit(high), F.lit(step)).cast(T.ArrayType(df.schema[a].dataType))).alias(a), b)
    return df.select(a, b, value).unionByName(ticks.withColumn(value, F.lit(fill).cast(df.schema[value].dataType)))


def interpolated(df: DataFrame, by: list[str], x: str, y: str, points: int = 100, log: bool = True) -> DataFrame:
    """by, i, x, y: ``points`` evenly spaced places along (the decimal logarithm of) x, linear between rows.

    Rows without x or y are left out; a group of one place gives that place.
    """
    at = F.log10(x) if log else F.col(x).cast("double")
    rows = df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).select(*by, at.alias("u"), F.col(y).cast("double").alias("v")).groupBy(*by, "u").agg(F.avg("v").alias("v"))
    order, every = W.partitionBy(*by).orderBy("u"), W.partitionBy(*by)
    seg = rows.withColumns({"u2": F.lead("u").over(order), "v2": F.lead("v").over(order), "lo": F.min("u").over(every), "hi": F.max("u").over(every)})
    step = (F.col("hi") - F.col("lo")) / (points - 1)
    first = F.ceil((F.col("u") - F.col("lo")) / step - 1e-9)
    last = F.when(F.col("u2") == F.col("hi"), F.lit(points - 1)).otherwise(F.ceil((F.col("u2") - F.col("lo")) / step - 1e-9) - 1)
    inner = seg.where("u2 is not null").select("*", F.explode(F.when(last >= first, F.sequence(first.cast("int"), last.cast("int"))).otherwise(F.array().cast("array<int>"))).alias("i"))
    place = F.col("lo") + F.col("i") * step
    value = F.col("v") + (F.col("v2") - F.col("v")) * (place - F.col("u")) / (F.col("u2") - F.col("u"))
    alone = seg.where("lo = hi").select(*by, F.lit(0).alias("i"), F.col("u").alias("x"), F.col("v").alias("y"))
    return inner.select(*by, "i", place.alias("x"), value.alias("y")).unionByName(alone)


def batches(df: DataFrame, by: list[str], order: str, size: int) -> DataFrame:
    """Rows with their batch number (from 1) in order inside each group."""
    return df.withColumn("batch", F.ceil(F.row_number().over(W.partitionBy(*by).orderBy(order)) / F.lit(size)).cast("long"))


def batch_slice(df: DataFrame, by: list[str], order: str, size: int, number: int) -> DataFrame:
    """The rows of one batch."""
    return batches(df, by, order, size).where(F.col("batch") == number)


def first_per_group(df: DataFrame, by: list[str], order: str, n: int) -> DataFrame:
    return df.withColumn("n", F.row_number().over(W.partitionBy(*by).orderBy(order))).where(F.col("n") <= n)


def duplicates(df: DataFrame, key: str) -> DataFrame:
    """Keys that occur more than once, and how often: empty if the key is one."""
    return df.groupBy(key).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def limits_for(models: DataFrame, limits: DataFrame, default_server: str | None = None) -> DataFrame:
    """server, model, tier with rpm and tpm, looked up whatever their case.

    For one server a model without limits of its own has those of 'default'.
    """
    key = lambda c: F.lower(F.col(c))
    have = limits.select(key("server").alias("s"), key("model").alias("m"), F.col("tier").alias("t"), "rpm", "tpm")
    own = models.join(have, (key("server") == F.col("s")) & (key("model") == F.col("m")) & (F.col("tier") == F.col("t")), "left").select("server", "model", "tier", "rpm", "tpm")
    if default_server is None:
        return own
    rest = have.where("m = 'default'").select("s", "t", F.col("rpm").alias("drpm"), F.col("tpm").alias("dtpm"))
    usable = key("server") == F.lit(default_server.lower())
    return own.join(rest, usable & (key("server") == F.col("s")) & (F.col("tier") == F.col("t")), "left").select("server", "model", "tier", F.coalesce("rpm", "drpm").alias("rpm"), F.coalesce("tpm", "dtpm").alias("tpm"))


def text_table(df: DataFrame, group: str | None = None, style: str = "github", most: int = 2000) -> str:
    """A report table as text, with a rule where the group changes; for results of at most ``most`` rows."""
    rows = df.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} rows are no report")
    cells = [["" if v is None else str(v) for v in r] for r in rows]
    latex = style == "latex"
    line = lambda c: " & ".join(c) + r" \\" if latex else "| " + " | ".join(c) + " |"
    out = [line(df.columns)] + ([r"\midrule"] if latex else ["|" + "---|" * len(df.columns)])
    at = df.columns.index(group) if group else None
    for i, c in enumerate(cells):
        if latex and at is not None and i and c[at] != cells[i - 1][at]:
            out.append(r"\midrule")
        out.append(line(c))
    return "\n".join(out)
