"""Merkle manifest of a dataset: a tree a source, a tree over the sources' roots, a proof a row.

A leaf is the digest of a row's fields, each ``-`` if null, else its UTF-8 length, ``:`` and value.
Leaves get their places in their source (see ``numbering``; a source may hold any share of the
rows). A level is a window by (group, parent): its ordered list over the whole frame is the parent's
preimage, and without the node itself the node's siblings. The run's first row is kept as the
parent, so each parent enters the next level once. A group ends with the level at which one node is
left. The subroots are leaves of a last tree, ordered by source.

Proofs go down the levels: a node's path is its own siblings before and after it, and its parent's
path. Only the lists of a level above the leaves are written (a sixteenth of the rows each); paths
of leaves are put together, folded and digested without being written.

Null in any field: ``-``. Null sources are a source, the first. Within a source null ids come first;
rows of one id are ordered by their leaf, and repeated rows are leaves of their own. A null id is
never tampered with. An empty table has no rows and no root. Other columns are ignored. Digests
are lower-case hex SHA-256; what is hashed is concatenated as text.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kinquery.operators.numbering import group_key, placed
from kinquery.runtime import stored

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_PATH = "array<struct<before:string,after:string>>"


def leaf_digest(fields: list[Column]) -> Column:
    """Digest of a row's fields, told apart by their lengths."""
    text = [f.cast("string") for f in fields]
    return F.sha2(F.concat(*(F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in text)), 256)


def _with_runs(nodes: DataFrame, width: int) -> DataFrame:
    """grp, place, digest; run: the digests under the same parent in order; alone: nothing else is left of the group."""
    whole = Window.partitionBy("grp", F.expr(f"place div {width}")).orderBy("place").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    runs = nodes.withColumn("run", F.collect_list("digest").over(whole))
    return runs.withColumn("alone", (F.col("place") == 0) & (F.size("run") == 1))


def _parents(runs: DataFrame, width: int) -> DataFrame:
    """One row a run: the parent's place and digest; a node that is alone stays as it is."""
    digest = F.when(F.col("alone"), F.col("digest")).otherwise(F.sha2(F.array_join("run", ""), 256))
    return runs.where(F.col("place") % width == 0).select("grp", F.expr(f"place div {width}").alias("place"), digest.alias("digest"), "alone")


@dataclass
class Tree:
    """levels[k]: nodes of level k + 1 with their runs; parents[k]: what level k gave, with those that are alone."""

    levels: list[DataFrame]
    parents: list[DataFrame]
    width: int

    def tops(self) -> DataFrame:
        """grp, digest of the last node of every group."""
        found = [p.where("alone").select("grp", "digest") for p in self.parents]
        whole = found[0]
        for more in found[1:]:
            whole = whole.unionByName(more)
        return whole


def build(leaves: DataFrame, width: int, what: str) -> Tree:
    """Levels above leaves (grp, place, digest), until no group has several nodes left."""
    tree = Tree([], [stored(_parents(_with_runs(leaves, width), width), f"{what}-parents")], width)
    while not (nodes := tree.parents[-1].where(~F.col("alone")).drop("alone")).isEmpty():
        level = stored(_with_runs(nodes, width), f"{what}-level")
        tree.levels.append(level)
        tree.parents.append(stored(_parents(level, width), f"{what}-parents"))
    return tree


def _siblings(width: int) -> Column:
    at = (F.col("place") % width).cast("int")
    before, after = F.slice("run", F.lit(1), at), F.slice("run", at + 2, F.lit(width))
    own = F.array(F.struct(F.array_join(before, "").alias("before"), F.array_join(after, "").alias("after")))
    return F.when(F.col("alone"), F.array().cast(_PATH)).otherwise(own.cast(_PATH))


def _lower(runs: DataFrame, above: DataFrame, width: int) -> DataFrame:
    """Paths of a level from those of its parents: grp, place, top, path, and what else ``runs`` has."""
    up = above.withColumnRenamed("place", "__parent").withColumnRenamed("path", "__above")
    joined = runs.withColumn("__parent", F.expr(f"place div {width}")).join(up, ["grp", "__parent"])
    return joined.withColumn("path", F.concat(_siblings(width), "__above")).drop("__parent", "__above", "run", "alone")


def paths(tree: Tree, leaves: DataFrame, tops: DataFrame) -> DataFrame:
    """Every leaf with ``top``, its group's last node, and ``path``, its siblings from level to level and on.

    ``tops``: grp, top, path of the groups' last nodes in what lies above this tree.
    """
    above = None
    for k in range(len(tree.parents) - 1, -1, -1):
        ended = tree.parents[k].where("alone").select("grp", "place").join(tops, "grp")
        if above is None:
            above = ended
        else:
            above = ended.unionByName(_lower(tree.levels[k], above, tree.width).select("grp", "place", "top", "path"))
    return _lower(_with_runs(leaves, tree.width), above, tree.width)


def folded(leaf: Column, path: Column) -> Column:
    """The root that follows from a leaf and its siblings."""
    return F.aggregate(path, leaf, lambda acc, p: F.sha2(F.concat(p["before"], acc, p["after"]), 256))


def tampered(doc_id: Column, every: int = 5) -> Column:
    """Whether ``every`` divides the crc32 of the id as text; a null id: no."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % every == 0, F.lit(False))


def manifest(docs: DataFrame, fields: tuple[str, ...] = ("doc_id", "source", "lang", "n_chars", "text"), width: int = 16, every: int = 5) -> DataFrame:
    """One row a row of ``docs``: doc_id, leaf, subroot, root, proof_sha256, folded_root, verified, source, place, n_levels.

    ``fields``: the id, the source, others, and the text last. ``folded_root`` is recomputed from the
    row's tampered leaf (A-Z of the text in lower case), or its own if it isn't tampered with.
    """
    key, source, text = fields[0], fields[1], fields[-1]
    doctored = leaf_digest([F.col(f) if f != text else F.translate(F.col(f), UPPER, LOWER) for f in fields])
    hashed = docs.select(
        F.col(key).alias("doc_id"), group_key(F.col(source)).alias("grp"), F.col(source).alias("source"), leaf_digest([F.col(f) for f in fields]).alias("digest"), F.when(tampered(F.col(key), every), doctored).alias("forged")
    )
    leaves = placed(stored(hashed, "merkle-hashed"), "grp", ["doc_id", "digest"], "merkle-leaves")
    tree = build(leaves.select("grp", "place", "digest"), width, "merkle")
    subroots = placed(tree.tops().select(F.lit("").alias("grp"), F.col("grp").alias("of"), "digest"), "grp", ["of"], "merkle-subroots")
    over = build(subroots.select("grp", "place", "digest"), width, "merkle-top")
    root = over.tops().select("grp", F.col("digest").alias("top"), F.array().cast(_PATH).alias("path"))
    tops = paths(over, subroots, root).select(F.col("of").alias("grp"), F.struct(F.col("digest").alias("subroot"), F.col("top").alias("root")).alias("top"), "path")
    found = paths(tree, leaves, stored(tops, "merkle-tops")).withColumn("folded_root", folded(F.coalesce("forged", "digest"), F.col("path")))
    proof = F.sha2(F.array_join(F.transform("path", lambda p: F.concat(p["before"], p["after"])), ""), 256)
    return found.select(
        "doc_id", F.col("digest").alias("leaf"), F.col("top.subroot").alias("subroot"), F.col("top.root").alias("root"), proof.alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("top.root")).alias("verified"), "source", "place", F.size("path").alias("n_levels")
    )
