"""Connected components of an edge table, by alternating large and small stars.

Every round is two aggregations and two joins on (a, b) pairs; the edges are written once a star into the
shared folder and never leave the cluster. What comes to the driver is one row a round: how many
edges there are and a checksum, which stop the loop once they no longer change.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinquery.runtime import checkpoint


def _star(edges: DataFrame, small: bool) -> DataFrame:
    """edges(a > b). A large star links larger neighbours to the least; a small star the smaller ones."""
    pairs = edges if small else edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = pairs.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    moved = pairs.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"), F.col("a").alias("u"))
    kept = moved.where("a > b") if small else moved.where("a > u")
    out = kept.select("a", "b")
    if small:
        out = out.unionByName(least.where("a > m").select("a", F.col("m").alias("b")))
    return out.distinct()


def components(edges: DataFrame) -> DataFrame:
    """edges(a, b) of long ids, either way round, loops allowed: (id, component) of all that has an edge.

    The component is the smallest id reachable. No edges: no rows. Null ids are ignored.
    """
    now = checkpoint(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    seen = None
    while True:  # every round that changes an edge lowers a label, so this ends
        mark = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if mark == seen or not mark[0]:
            return now.groupBy("a").agg(F.min("b").alias("component")).select(F.col("a").alias("id"), "component").unionByName(now.select(F.col("b").alias("id"), F.col("b").alias("component")).distinct())
        seen = mark
        most = 2 * mark[0]  # a star has an edge a pair or node at most
        now = checkpoint(_star(checkpoint(_star(now, small=False), most), small=True), most)
