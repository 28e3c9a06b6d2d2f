"""Balanced label propagation: rows of equal text move to common shards, sizes stay even.

Rows with equal texts are linked. Each linked row starts in a shard of its own hash. In a round,
every group (rows of one text) counts its members' shards by joins on the group, and the members
elsewhere ask to move to the label that most of their neighbours have; every other round only
shards with room for all of them count, and where none of these has a member, any shard with room for
the group. Requests are added up in buckets of group size and hash. Those of a round are
granted together, as what leaves a full shard makes room for what comes in: from all of them, buckets of
small groups are taken back until no shard gets more than its quota, net. A whole group in a shard
over its quota may move to one with room as well. Rounds end when no group is cut or no request is
left; a round that grants nothing twice in a row is the last. What has no link then fills the shards to exactly equal
counts (law ``rows``: at most one apart). Only a group of more rows than a shard takes is cut, into
as few chunks as hold it.

A row's shard and slot follow from columns written with it (its part, label and place among them),
so the result can be joined, unioned, coalesced or counted again like any other frame.

Only counts by shard, bucket and part come to the driver, never rows or links. A null text is
an empty one (size 1, CRC of nothing). Repeated rows and null ids are rows like others. An empty
table gives no rows. Columns other than ``doc_id`` and ``text`` are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinquery.runtime import checkpoint, stored

SUB_BUCKETS = 64
#: Rows of the plan (a part and label each) to broadcast at most.
BROADCAST_ROWS = 1_000_000


def _case(values: list[int], at: Column) -> Column:
    return F.get(F.array(*(F.lit(int(v)) for v in values)), at)


def _wishes(counts: DataFrame, group: list[str], room: list[int], r: int) -> DataFrame:
    """(group, to, bucket, m, evicted): where each cut group wants its members to be.

    m: its members by shard. evicted: a whole group of a shard that holds too many.
    """
    held = counts.groupBy(*group).agg(F.collect_list(F.struct("shard", "c")).alias("m"))  # a row a shard at most
    n = F.aggregate("m", F.lit(0).cast("long"), lambda s, x: s + x["c"])
    evicted = (F.size("m") == 1) & (_case(room, F.col("m")[0]["shard"]) < 0)
    held = held.withColumn("evicted", evicted).where((F.size("m") > 1) | F.col("evicted")).withColumn("n", n)

    def ranked(shard: Column, c: Column) -> Column:
        return F.struct(c.alias("c"), F.xxhash64(F.lit(r), *group, shard).alias("h"), shard.alias("shard"))

    fits = lambda x: F.lit(r % 2 == 0) | (_case(room, x["shard"]) >= F.col("n") - x["c"])
    own = F.transform(F.filter("m", lambda x: ~F.col("evicted") & fits(x)), lambda x: ranked(x["shard"], x["c"]))
    other = F.transform(F.filter(F.array(*map(F.lit, range(len(room)))), lambda s: _case(room, s) >= F.col("n")), lambda s: ranked(s, F.lit(0).cast("long")))
    best = F.array_max(F.when(F.size(own) > 0, own).otherwise(other))
    size_class = 40 - F.least(F.lit(40), F.floor(F.log2("n"))).cast("int")
    bucket = size_class * SUB_BUCKETS + F.pmod(F.xxhash64(F.lit(-r - 1), *group), F.lit(SUB_BUCKETS)).cast("int")
    wish = held.withColumn("best", best).where("best is not null")
    return wish.select(*group, F.col("best.shard").alias("to"), bucket.alias("bucket"), "m", "evicted")


def grant(asked: list[tuple[bool, int, int, int, int]], room: list[int]) -> list[tuple[int, int, bool]]:
    """(to, bucket, evicted) of what is granted, of requests (evicted, bucket, to, from, rows).

    All requests to join are granted at first; the last buckets into a shard whose net gain passes
    its room are taken back, until none does. Evictions follow while their shard holds too many.
    """
    flows: dict[tuple[bool, int, int], dict[int, int]] = {}
    for evicted, bucket, to, start, rows in asked:
        if start != to:
            flow = flows.setdefault((evicted, bucket, to), {})
            flow[start] = flow.get(start, 0) + rows
    left = list(room)

    def move(key: tuple[bool, int, int], sign: int) -> None:
        for start, rows in flows[key].items():
            left[start] += sign * rows
            left[key[2]] -= sign * rows

    granted = sorted(k for k in flows if not k[0])
    for key in granted:
        move(key, 1)
    limit = [min(0, x) for x in room]
    by_shard = {s: [k for k in granted if k[2] == s] for s in range(len(room))}
    while over := [s for s in by_shard if left[s] < limit[s] and by_shard[s]]:
        for s in over:
            while left[s] < limit[s] and by_shard[s]:
                move(by_shard[s].pop(), -1)
    stay = {k for ks in by_shard.values() for k in ks}
    for key in granted:  # what stood behind a bucket too large may fit without it
        if key not in stay and left[key[2]] - sum(flows[key].values()) >= limit[key[2]]:
            move(key, 1)
            stay.add(key)
    out = sorted(stay)
    for key in sorted(k for k in flows if k[0]):
        rows = sum(flows[key].values())
        if left[key[2]] >= rows and all(-left[s] >= n for s, n in flows[key].items()):
            move(key, 1)
            out.append(key)
    return [(to, bucket, evicted) for evicted, bucket, to in out]


def _propagate(members: DataFrame, shards: int, quota: int) -> DataFrame:
    """members(rid, gid, chunk, shard): the same rows with their last labels."""
    group, spark = ["gid", "chunk"], members.sparkSession
    r = idle = 0
    while idle < 2:
        counts = checkpoint(members.groupBy(*group, "shard").agg(F.count(F.lit(1)).alias("c")))
        load = {x["shard"]: x["n"] for x in counts.groupBy("shard").agg(F.sum("c").alias("n")).collect()}
        room = [quota - load.get(s, 0) for s in range(shards)]
        wish = checkpoint(_wishes(counts, group, room, r))
        flow = wish.select("evicted", "bucket", "to", F.explode("m").alias("x")).groupBy("evicted", "bucket", "to", "x.shard").agg(F.sum("x.c").alias("k"))
        granted = grant([tuple(x) for x in flow.collect()], room)  # a row a bucket and two shards at most
        idle = 0 if granted else idle + 1
        r += 1
        if granted:
            taken = F.broadcast(spark.createDataFrame(granted, "to int, bucket int, evicted boolean"))
            moves = checkpoint(wish.join(taken, ["to", "bucket", "evicted"]).select(*group, "to"))
            members = checkpoint(members.join(moves, group, "left").select("rid", *group, F.coalesce("to", "shard").alias("shard")))
    return members


def _numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Add the part, and each row's place among those of its part and label."""
    from pyspark import TaskContext

    part, seen = TaskContext.get().partitionId(), {}
    for batch in batches:
        label = batch.column("label").to_numpy()
        place = np.zeros(len(label), np.int64)
        for s in np.unique(label).tolist():
            mine = np.flatnonzero(label == s)
            place[mine] = seen.get(s, 0) + np.arange(len(mine))
            seen[s] = seen.get(s, 0) + len(mine)
        yield batch.append_column("part", pa.array(np.full(len(label), part, np.int32))).append_column("place", pa.array(place))


def _plan(held: dict[tuple[int, int], int], shards: int) -> tuple[list[tuple[int, int, int, int, int]], list[int], list[int]]:
    """(part, label, spare, loose, kept): of a part's rows of a label, the first ``spare`` lose it.

    Rows without a label (-1) and those are counted through; ``loose`` is where they begin, ``kept`` the slot where
    the others do. With it: how many loose rows the shards up to each take, and where its loose rows' slots begin.
    """
    total, parts = sum(held.values()), sorted({p for p, _ in held})
    want = [total // shards + (s < total % shards) for s in range(shards)]
    have = [sum(held.get((p, s), 0) for p in parts) for s in range(shards)]
    surplus = [max(0, h - w) for h, w in zip(have, want, strict=True)]
    first_loose = [min(h, w) for h, w in zip(have, want, strict=True)]
    cuts = np.cumsum([w - f for w, f in zip(want, first_loose, strict=True)]).tolist()
    rows, loose, kept = [], 0, [0] * shards
    for p in parts:
        for s in range(-1, shards):
            n = held.get((p, s), 0)
            spare = n if s < 0 else min(n, surplus[s])
            if n:
                rows.append((p, s, spare, loose, kept[s] if s >= 0 else 0))
            loose += spare
            if s >= 0:
                surplus[s] -= spare
                kept[s] += n - spare
    return rows, cuts, first_loose


def balanced_shards(docs: DataFrame, shards: int = 8) -> DataFrame:
    """One row a row of ``docs(doc_id, text)``: doc_id, size, text_crc32, law, shard, slot, grown_shard."""
    spark = docs.sparkSession
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = stored(docs.select(F.monotonically_increasing_id().alias("rid"), F.col("doc_id").cast("long").alias("doc_id"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("crc"), F.unhex(F.md5(text.cast("binary"))).alias("gid")), "shard-rows")
    groups = checkpoint(rows.groupBy("gid").agg(F.count(F.lit(1)).alias("n")).where("n > 1"))
    even = rows.count() // shards
    parts = F.greatest(F.lit(1), F.ceil(F.col("n") / F.lit(max(1, even)))).cast("long")
    chunk = F.pmod(F.xxhash64(F.lit("chunk"), "rid"), parts).cast("int")
    start = F.pmod(F.xxhash64(F.lit("start"), "rid"), F.lit(shards)).cast("int")
    linked = checkpoint(rows.select("rid", "gid").join(groups, "gid").select("rid", "gid", chunk.alias("chunk"), start.alias("shard")))
    linked = _propagate(linked, shards, even).select("rid", F.col("shard").alias("label"))
    joined = rows.select("rid", "doc_id", "size", "crc").join(linked, "rid", "left").select("doc_id", "size", "crc", F.coalesce("label", F.lit(-1)).alias("label"))
    placed = stored(joined.mapInArrow(_numbered, "doc_id long, size long, crc long, label int, part int, place long"), "placed")

    held = {(x["part"], x["label"]): x["n"] for x in placed.groupBy("part", "label").agg(F.count(F.lit(1)).alias("n")).collect()}
    plan, cuts, first_loose = _plan(held, shards)
    steps = spark.createDataFrame(plan, "part int, label int, spare long, loose long, kept long")
    found = placed.join(F.broadcast(steps) if len(plan) <= BROADCAST_ROWS else steps, ["part", "label"])
    number = F.col("loose") + F.col("place")  # among all loose rows
    ends = F.array(*(F.lit(int(c)).cast("long") for c in cuts))
    filled = F.size(F.filter(ends, lambda e: e <= F.col("number")))
    free = F.col("place") < F.col("spare")
    begin = F.array(*(F.lit(int(a - b)).cast("long") for a, b in zip(first_loose, [0, *cuts[:-1]], strict=True)))
    found = found.withColumn("number", number).withColumn("shard", F.when(free, filled).otherwise(F.col("label")).cast("int"))
    slot = F.when(free, F.get(begin, F.col("shard")) + F.col("number")).otherwise(F.col("kept") + F.col("place") - F.col("spare"))
    return found.select("doc_id", "size", F.col("crc").alias("text_crc32"), F.lit("rows").alias("law"), "shard", slot.cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))


def cut_links(result: DataFrame) -> DataFrame:
    """linked, cut: rows with an equal text elsewhere, and those of them outside their text's main shard.

    Texts are told by size and checksum, as the result has them.
    """
    one = result.groupBy("text_crc32", "size", "shard").agg(F.count(F.lit(1)).alias("c"))
    one = one.groupBy("text_crc32", "size").agg(F.sum("c").alias("n"), F.max("c").alias("most")).where("n > 1")
    return one.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("linked"), F.coalesce(F.sum(F.col("n") - F.col("most")), F.lit(0)).alias("cut"))
