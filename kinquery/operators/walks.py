"""Weighted choices of edges: adjacency with prefix sums, for walks and for uniform draws of joins.

Edges are put into one global order by ranges, so a person with any share of them lies in several
partitions; running weights are summed a partition at a time, and what lies before a partition is
one row each on the driver. A person's edges are a run of that order, cut into segments of at most
``SEGMENT`` edges with the ends of their weights as an array. A choice is a number below the person's
total weight: a binary search in the person's segment starts, one lookup of the segment, and a binary search there.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from kinquery.runtime import stored

SEGMENT = 512
#: Rows of a lookup table at most that a join may broadcast. Spark goes by the size of a file, of which rows in memory are many times.
BROADCAST_ROWS = 100_000


def beside(rows: DataFrame, n: int) -> DataFrame:
    """A lookup table of ``n`` rows, as a join is to take it: one of many is shuffled and does not pass the driver."""
    return rows.hint("merge") if n > BROADCAST_ROWS else rows


def ranked(rows: DataFrame, order: list[str | Column], what: str, name: str = "i", weight: str | None = None, before: str = "before") -> DataFrame:
    """Rows with their place from 0 in a total order, and with ``weight`` the sum of it before them.

    Dealt out by ranges of the order and written once; each partition counts by itself, and the
    driver adds up one row a partition. Rows alike in all of the order's columns are in any order.
    """
    one = F.lit(1).cast("long") if weight is None else F.col(weight).cast("long")
    dealt = rows.withColumn("__w", one).repartitionByRange(*order).sortWithinPartitions(*order)
    written = stored(dealt.withColumn("__part", F.spark_partition_id()).withColumn("__at", F.monotonically_increasing_id()), what)
    parts, offsets, n, total = written.groupBy("__part").agg(F.count(F.lit(1)).alias("n"), F.sum("__w").alias("w")).orderBy("__part").collect(), [], 0, 0
    for p in parts:
        offsets.append((p["__part"], n, total))
        n, total = n + p["n"], total + p["w"]
    offset = rows.sparkSession.createDataFrame(offsets, "__part int, __n long, __total long")
    joined = written.join(F.broadcast(offset), "__part")  # a row a partition
    found = joined.withColumn(name, F.col("__n") + F.col("__at").bitwiseAND(F.lit((1 << 33) - 1)))
    if weight is not None:
        inside = F.sum("__w").over(W.partitionBy("__part").orderBy("__at").rowsBetween(W.unboundedPreceding, W.currentRow)) - F.col("__w")
        found = found.withColumn(before, F.col("__total") + inside)
    return found.select(*rows.columns, name, *([before] if weight is not None else []))


def last_at_most(starts: Column, value: Column) -> Column:
    """The place (from 0) of the last of rising ``starts`` that isn't over ``value``; -1: all are over it."""
    rounds = F.sequence(F.lit(1), F.ceil(F.log2(F.size(starts) + 1)).cast("int") + 1)

    def halve(s: Column, _: Column) -> Column:
        mid = F.floor((s["low"] + s["high"]) / 2).cast("int")
        under = (mid < F.size(starts)) & (F.get(starts, mid) <= value)
        open_ = s["low"] < s["high"]
        return F.struct(F.when(open_ & under, mid + 1).otherwise(s["low"]).alias("low"), F.when(open_ & ~under, mid).otherwise(s["high"]).alias("high"))

    # the first place that is over the value, by halves
    return F.aggregate(rounds, F.struct(F.lit(0).alias("low"), F.size(starts).alias("high")), halve, lambda s: s["low"] - 1)


@dataclass
class Adjacency:
    """heads(x, total, segments: array of first, start) and segments(x, seg, starts, edges)."""

    heads: DataFrame
    segments: DataFrame

    @cached_property
    def many(self) -> int:
        """How many people have edges."""
        return self.heads.count()

    @classmethod
    def of(cls, edges: DataFrame, what: str = "adjacency", segment: int = SEGMENT) -> Adjacency:
        """From edges(x, rel, y, mult), distinct in x, rel and y; edges without weight are left out."""
        rows = ranked(edges.where("mult > 0").select("x", "rel", "y", F.col("mult").cast("long").alias("mult")), ["x", "rel", "y"], what, "g", "mult", "w")
        rows = rows.withColumn("seg", F.floor(F.col("g") / segment))
        cut = F.array_sort(F.collect_list(F.struct("g", "w", "rel", "y")))
        segments = rows.groupBy("x", "seg").agg(cut.alias("e"), F.sum("mult").alias("weight"))
        segments = segments.select("x", "seg", F.transform("e", lambda e: e["w"]).alias("starts"), F.transform("e", lambda e: F.struct(e["rel"].alias("rel"), e["y"].alias("y"))).alias("edges"), "weight")
        segments = stored(segments, f"{what}-segments")
        heads = segments.groupBy("x").agg(F.sum("weight").alias("total"), F.array_sort(F.collect_list(F.struct(F.get("starts", F.lit(0)).alias("start"), "seg"))).alias("s"))
        heads = heads.select("x", "total", F.transform("s", lambda s: s["start"]).alias("starts"), F.transform("s", lambda s: s["seg"]).alias("segs"))
        return cls(stored(heads, f"{what}-heads"), segments.drop("weight"))

    def choose(self, state: DataFrame, at: str, number: Column, reduced: str | None = None) -> DataFrame:
        """Each row with the edge (rel, y) of its person that ``number`` falls on; rows without edges go.

        ``number`` is at least 0 and may use ``__total``, the person's weight; below it, it stands for
        one of the edge's derivations. ``reduced``: a column for the number less the weight before the edge.
        """
        heads = self.heads.select(F.col("x").alias("__x"), F.col("total").alias("__total"), F.col("starts").alias("__starts"), F.col("segs").alias("__segs"))
        found = self._placed(state.join(beside(heads, self.many), F.col(at) == F.col("__x")), number)
        return self._chosen(found, state.columns, reduced)

    def choose_one_of_all(self, state: DataFrame, number: Column, reduced: str | None = None) -> DataFrame:
        """The same where all edges are one person's, whose head is broadcast: 16 bytes a segment."""
        head = self.heads.select(F.col("x").alias("__x"), F.col("total").alias("__total"), F.col("starts").alias("__starts"), F.col("segs").alias("__segs"))
        return self._chosen(self._placed(state.crossJoin(F.broadcast(head)), number), state.columns, reduced)

    def _placed(self, found: DataFrame, number: Column) -> DataFrame:
        found = found.withColumn("__want", F.get("__starts", F.lit(0)) + number)
        return found.withColumn("__seg", F.get("__segs", last_at_most(F.col("__starts"), F.col("__want")))).drop("__starts", "__segs", "__total")

    def _chosen(self, found: DataFrame, columns: list[str], reduced: str | None) -> DataFrame:
        parts = self.segments.select(F.col("x").alias("__x"), F.col("seg").alias("__seg"), "starts", "edges")
        found = found.join(beside(parts, self.many), ["__x", "__seg"]).withColumn("__k", last_at_most(F.col("starts"), F.col("__want")))
        edge = F.get("edges", F.col("__k"))
        cols = [*columns, edge["rel"].alias("rel"), edge["y"].alias("y")]
        return found.select(*cols, *([(F.col("__want") - F.get("starts", F.col("__k"))).alias(reduced)] if reduced else []))


def below(total: Column, *what: Column | str) -> Column:
    """A number from 0 to total - 1 that is drawn by a hash of ``what``."""
    return F.pmod(F.xxhash64(*(F.lit(w) if isinstance(w, str) else w for w in what)), total)


def chain_draws(steps: list[DataFrame], n: int, seed: int = 1) -> tuple[int, DataFrame]:
    """How many bindings a chain of edges has, and ``n`` of them at random, none twice (all, if fewer).

    steps[k](x, y) are the distinct pairs of the k-th goal, whose y is the next one's x. Completions
    are counted from the last goal to the first; a binding's number then leads down the chain, at each
    person through the weights of its edges, so numbers are bindings one to one. Rows: draw, p0, p1, ...
    """
    after: DataFrame | None = None
    chosen: list[Adjacency] = []
    for k in range(len(steps) - 1, -1, -1):
        pairs = steps[k].select("x", "y")
        edges = pairs.withColumn("mult", F.lit(1).cast("long")) if after is None else pairs.join(after.withColumnRenamed("x", "y"), "y")
        adjacency = Adjacency.of(edges.select("x", F.lit(k).cast("string").alias("rel"), "y", "mult"), f"chain-{k}")
        chosen.append(adjacency)
        after = adjacency.heads.select("x", F.col("total").alias("mult"))
    spark = steps[0].sparkSession
    people = after.count()
    everyone = Adjacency.of(after.select(F.lit("").alias("x"), F.lit("").alias("rel"), F.col("x").alias("y"), "mult"), "chain-starts", max(SEGMENT, int(people**0.5) + 1))
    total = everyone.heads.agg(F.coalesce(F.sum("total"), F.lit(0))).first()[0]
    state = spark.range(min(n, total)).select(F.col("id").alias("draw"), permuted(F.col("id"), total, seed).alias("__r"))
    state = everyone.choose_one_of_all(state, F.col("__r"), "__left").select("draw", F.col("y").alias("p0"), "__left")
    for k, adjacency in enumerate(reversed(chosen)):
        kept = [c for c in state.columns if c != "__left"]
        state = adjacency.choose(state, f"p{k}", F.col("__left"), "__next").select(*kept, F.col("y").alias(f"p{k + 1}"), F.col("__next").alias("__left"))
    return total, state.drop("__left")


def permuted(i: Column, n: int, seed: int = 1, rounds: int = 6, walks: int = 48) -> Column:
    """A permutation of 0 to n - 1: where ``i`` goes. No two rows share a place, and none needs another's.

    Numbers are pairs (a, b) of a grid of at least n cells, changed in turn by a hash of the other; a
    cell past n - 1 is changed again. The grid has at most 2 sqrt(n) + 1 cells too many, so ``walks``
    rounds end with all but certainty; a row that doesn't end is an error, not another's place.
    """
    if n < 1:
        return i
    high = int(n**0.5)
    high += high * high < n
    wide = -(-n // high)

    def mixed(x: Column) -> Column:
        a, b = F.floor(x / wide), x % wide
        for r in range(rounds):
            if r % 2:
                a = (a + F.pmod(F.xxhash64(F.lit(seed), F.lit(r), b), F.lit(high))) % high
            else:
                b = (b + F.pmod(F.xxhash64(F.lit(seed), F.lit(r), a), F.lit(wide))) % wide
        return a * wide + b

    step = lambda x, _: F.when((x >= 0) & (x < n), x).otherwise(mixed(F.when(x < 0, -1 - x).otherwise(x)))
    start = -1 - i.cast("long")  # below 0: not changed yet
    found = F.aggregate(F.sequence(F.lit(1), F.lit(walks)), start, step)
    return F.when((found >= 0) & (found < n), found).otherwise(F.raise_error(F.lit("a place was not found")).cast("long"))
