"""SimHash near-duplicate groups, linked through BK-trees.

Documents of one fingerprint are one class, so groups of copies cost one row. Two fingerprints
that differ in two bits or fewer have one of three bit blocks in common (21, 21 and 22 bits): each
class goes to three shards keyed by a block's place and value, and every linked pair meets in
one shard at least. In each shard a BK-tree (children keyed by their Hamming distance to the parent)
takes the fingerprints one after the other; each is first looked up, along edges within the radius
only, and joined to what it finds by union-find, so a shard gives a row a linked class, not all
pairs. Shard trees are built where their rows are and aren't broadcast: their size has no bound.
A shard of more than ``hot`` fingerprints is dealt again by the rest's blocks, with the same
guarantee. Shards' links are joined by connected components.

Two bits are far less than what a text of a few changed words differs by. ``one_of_each`` can
therefore also link texts by their sets of five-word shingles (``kinquery.llm.shingle_sets``).

Null and empty texts have fingerprint zero. Rows with equal doc_id are kept. Null doc_ids keep
their row, with a null component unless their class has another id. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinquery.llm.batches import slices
from kinquery.llm.components import components
from kinquery.runtime import checkpoint, drop_scratch, scratch_mark, stored

BLOCKS = ((0, 21), (21, 21), (42, 22))


def fingerprint_hashes(text: str | None, shingle: int, seed: int) -> np.ndarray:
    """XXH64 of each word shingle of a text, repeats included."""
    from xxhash import xxh64_intdigest as h

    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, dtype=np.uint64)
    if len(words) < shingle:
        return np.array([h(b" ".join(words), seed)], dtype=np.uint64)
    line = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    last = len(words) - shingle + 1
    return np.fromiter((h(line[a:b], seed) for a, b in zip(starts[:last].tolist(), ends[shingle - 1 :].tolist(), strict=True)), np.uint64, last)


def majority(hashes: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """The fingerprint of each run of hashes: a bit is 1 if set in over half of them."""
    out = np.zeros(len(bounds) - 1, dtype=np.uint64)
    sizes = np.diff(bounds)
    full = np.flatnonzero(sizes)
    if not len(full):
        return out
    step = 1 << 17
    totals = np.zeros((len(full), 64), dtype=np.int64)
    owner = np.repeat(np.arange(len(full)), sizes[full])
    for lo in range(0, len(hashes), step):
        part, own = hashes[lo : lo + step], owner[lo : lo + step]
        bits = np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        first = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
        totals[own[first]] += np.add.reduceat(bits, first, axis=0, dtype=np.int32)
    won = (2 * totals > sizes[full][:, None]).astype(np.uint8)
    out[full] = np.packbits(won, axis=1, bitorder="little").view(np.uint64).ravel()
    return out


def fingerprints(docs: DataFrame, shingle: int = 3, seed: int = 42) -> DataFrame:
    """doc_id, fp (the unsigned fingerprint's bits in a long)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for some in slices(batch, "text", rows=256):
                each = [fingerprint_hashes(t, shingle, seed) for t in some.column("text").to_pylist()]
                bounds = np.concatenate([[0], np.cumsum([len(x) for x in each])])
                fps = majority(np.concatenate(each), bounds)
                yield pa.RecordBatch.from_arrays([some.column("doc_id"), pa.array(fps.view(np.int64))], ["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, fp long")


class BKTree:
    """Nodes in insertion order; each keeps its children by their Hamming distance to it."""

    def __init__(self) -> None:
        self.values: list[int] = []
        self.children: list[dict[int, int]] = []

    def within(self, value: int, radius: int) -> list[int]:
        """Nodes at ``radius`` bits or fewer, following only edges that can lead to one."""
        found, todo = [], [0] if self.values else []
        while todo:
            node = todo.pop()
            d = (self.values[node] ^ value).bit_count()
            if d <= radius:
                found.append(node)
            kids = self.children[node]
            if len(kids) <= 2 * radius + 1:
                todo += [k for e, k in kids.items() if -radius <= e - d <= radius]
            else:
                todo += [kids[e] for e in range(d - radius, d + radius + 1) if e in kids]
        return found

    def add(self, value: int) -> int:
        new = len(self.values)
        self.values.append(value)
        self.children.append({})
        node = 0 if new else -1
        while node >= 0:
            d = (self.values[node] ^ value).bit_count()
            nxt = self.children[node].get(d, -1)
            if nxt < 0:
                self.children[node][d] = new
            node = nxt
        return new


class BucketTree:
    """A BK-tree whose edges lead to buckets of up to ``leaf`` values, scanned at once in numpy.

    For shards of many values: a bucket that grows over ``leaf`` becomes a node with its own edges.
    """

    def __init__(self, leaf: int = 2048) -> None:
        self.leaf, self.count, self.root = leaf, 0, None

    def within(self, value: int, radius: int) -> list[int]:
        found: list[int] = []
        todo = [self.root] if self.root else []
        v = np.uint64(value)
        while todo:
            pivot, place, kids = todo.pop()
            d = (pivot ^ value).bit_count()
            if d <= radius:
                found.append(place)
            for e in range(max(0, d - radius), min(64, d + radius) + 1):
                kid = kids.get(e)
                if kid is None:
                    continue
                if isinstance(kid, tuple):
                    todo.append(kid)
                else:
                    n, values, places = kid
                    near = np.bitwise_count(values[:n] ^ v) <= radius
                    if near.any():
                        found += places[:n][near].tolist()
        return found

    def add(self, value: int) -> None:
        self._put(value, self.count)
        self.count += 1

    def _put(self, value: int, place: int) -> None:
        if self.root is None:
            self.root = (value, place, {})
            return
        node = self.root
        while True:
            pivot, _, kids = node
            e = (pivot ^ value).bit_count()
            kid = kids.get(e)
            if isinstance(kid, tuple):
                node = kid
                continue
            if kid is None:
                kid = kids[e] = [0, np.zeros(8, np.uint64), np.zeros(8, np.int64)]
            n = kid[0]
            if n == len(kid[1]):
                kid[1], kid[2] = np.concatenate([kid[1], np.zeros(n, np.uint64)]), np.concatenate([kid[2], np.zeros(n, np.int64)])
            kid[1][n], kid[2][n], kid[0] = value, place, n + 1
            if kid[0] > self.leaf:
                kids[e] = (int(kid[1][0]), int(kid[2][0]), {})
                for v, p in zip(kid[1][1 : kid[0]].tolist(), kid[2][1 : kid[0]].tolist(), strict=True):
                    self._put(v, p)
            return


def shard_links(values: list[int], reps: list[int], radius: int) -> list[tuple[int, int]]:
    """(rep, root) of every linked class of one shard, by lookups in a growing BK-tree."""
    tree = BucketTree() if len(values) > 256 else BKTree()
    parent = list(range(len(values)))

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    for i, v in enumerate(values):
        for j in tree.within(v, radius):
            parent[root(j)] = root(i)
        tree.add(v)
    least: dict[int, int] = {}
    for i, r in enumerate(reps):
        least[root(i)] = min(r, least.get(root(i), r))
    return [(r, least[root(i)]) for i, r in enumerate(reps) if r != least[root(i)]]


def _bits(at: int, n: int) -> Column:
    return F.shiftrightunsigned("fp", at).bitwiseAND(F.lit((1 << n) - 1)).cast("long")


def _key(*parts: int | Column) -> Column:
    return F.struct(*((p if isinstance(p, Column) else F.lit(p).cast("long")).alias(f"k{j}") for j, p in enumerate(parts)))


def _shards() -> Column:
    """The three shards of a fingerprint: a block's place and value."""
    return F.array(*(_key(i, _bits(at, n), 0, 0) for i, (at, n) in enumerate(BLOCKS)))


def _finer_shards() -> Column:
    """As above, each cut by the other bits: of four pieces of them, two differing bits leave two equal."""
    keys = []
    for i, (at, n) in enumerate(BLOCKS):
        pieces = [p for j, (o, m) in enumerate(BLOCKS) if j != i for p in ((o, 11), (o + 11, m - 11))]
        for a, b in combinations(range(4), 2):
            keys.append(_key(i, _bits(at, n), 1 + a * 4 + b, _bits(*pieces[a]) * F.lit(1 << 12) + _bits(*pieces[b])))
    return F.array(*keys)


def link_classes(classes: DataFrame, radius: int = 2, hot: int = 128) -> DataFrame:
    """classes(fp, rep) of distinct fingerprints: edges (a, b) of reps that connect all linked ones."""
    if radius > 2:
        raise ValueError("three blocks find pairs of up to two differing bits")
    keys = ["k0", "k1", "k2", "k3"]
    first = classes.select("fp", "rep", F.explode(_shards()).alias("k")).select("fp", "rep", "k.*")
    counts = first.groupBy("k0", "k1").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    sized = first.join(counts, ["k0", "k1"])
    again = sized.where(F.col("n") > hot).select("fp", "rep", F.col("k0").alias("b"), F.explode(_finer_shards()).alias("k")).where("b = k.k0")
    dealt = sized.where(F.col("n") <= hot).select("fp", "rep", *keys).unionByName(again.select("fp", "rep", "k.*"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, values, reps = None, [], []

        def flush() -> pa.RecordBatch:
            found = shard_links(values, reps, radius) if len(values) > 1 else []
            return pa.RecordBatch.from_arrays([pa.array([x[0] for x in found], pa.int64()), pa.array([x[1] for x in found], pa.int64())], ["a", "b"])

        for batch in batches:
            cols = [batch.column(c).to_pylist() for c in (*keys, "fp", "rep")]
            for *key, fp, rep in zip(*cols, strict=True):
                if key != now:
                    if len(values) > 1:
                        yield flush()
                    now, values, reps = key, [], []
                values.append(fp & 0xFFFFFFFFFFFFFFFF)
                reps.append(rep)
        yield flush()

    return dealt.repartition(*keys).sortWithinPartitions(*keys, "fp").mapInArrow(run, "a long, b long")


def near_duplicates(docs: DataFrame, shingle: int = 3, seed: int = 42, radius: int = 2, hot: int = 128) -> DataFrame:
    """One row a document: doc_id, fp, component_id (the smallest doc_id reachable over links)."""
    prints = stored(fingerprints(docs, shingle, seed), "fingerprints")
    n = prints.count()
    classes = checkpoint(prints.groupBy("fp").agg(F.min("doc_id").alias("rep")), n)
    groups = components(link_classes(classes.where("rep is not null"), radius, hot))
    named = checkpoint(classes.join(groups.withColumnRenamed("id", "rep"), "rep", "left").select("fp", F.coalesce("component", "rep").alias("component_id")), n)
    return prints.join(named, "fp").select("doc_id", "fp", "component_id")


def _to_class(nodes: DataFrame, classes: DataFrame, on: str) -> DataFrame:
    """Edges (a, b) from nodes to the representative of their class, where that is another node."""
    pairs = nodes.select(on, F.col("rep").alias("a")).join(classes.select(on, F.col("rep").alias("b")), on)
    return pairs.where("a <> b").select("a", "b")


def copies(docs: DataFrame, similarity: float | None = None, shingle: int = 3, seed: int = 42, radius: int = 2, hot: int = 128, **sets) -> tuple[DataFrame, DataFrame]:
    """doc_id of all documents that aren't their component's smallest, and doc_id of those that come several times.

    Components are those of fingerprints; with ``similarity`` the links of similar shingle sets
    count as well. Texts are hashed once for both, and components are found once, over classes:
    documents of one fingerprint and one set are one node, so a group of copies has no edge.
    """
    from kinquery.llm.shingle_sets import set_prints, similar_classes

    mark = scratch_mark()
    known = docs.where("doc_id is not null")
    prints = stored(fingerprints(known, shingle, seed) if similarity is None else set_prints(known, similarity, fingerprint=shingle, seed=seed, **{k: v for k, v in sets.items() if k == "shingle"}), "prints")
    n = prints.count()
    nodes = stored(prints.groupBy("fp", *(["same"] if similarity is not None else [])).agg(F.min("doc_id").alias("rep")), "nodes", n)
    by_print = checkpoint(nodes.groupBy("fp").agg(F.min("rep").alias("rep")), n)
    edges = [_to_class(nodes, by_print, "fp"), link_classes(by_print, radius, hot)]
    if similarity is not None:
        classes, links = similar_classes(known, prints, similarity, seed=seed, **sets)
        edges += [_to_class(nodes, classes, "same"), links]
    every = edges[0]
    for e in edges[1:]:
        every = every.unionByName(e)
    found = components(every.where("a <> b"))
    kept = nodes.join(found.withColumnRenamed("id", "rep"), "rep", "left").where(F.coalesce("component", "rep") == F.col("rep"))
    gone = stored(prints.select("doc_id").distinct().join(kept.select(F.col("rep").alias("doc_id")), "doc_id", "left_anti"), "copies", n)
    twice = stored(prints.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("doc_id"), "repeated", n)
    drop_scratch(docs.sparkSession, mark, (gone, twice))
    return gone, twice


#: Ids to broadcast at most (8 bytes each); a larger set is joined by a shuffle.
BROADCAST_IDS = 2_000_000


def _small(ids: DataFrame) -> DataFrame:
    return F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids


def one_of_each(docs: DataFrame, similarity: float | None = None, **how) -> DataFrame:
    """The documents whose id is their component's smallest; of rows with that same id, one.

    Which of several rows with one id stays is settled by their text's hash, then the text. A row
    without an id can't be told to be another's copy and stays. All columns are kept.
    """
    gone, twice = copies(docs, similarity, **how)
    single = docs.join(_small(gone.unionByName(twice)), "doc_id", "left_anti")  # nulls stay
    first = F.min_by(F.struct(*(F.col(c) for c in docs.columns)), F.struct(F.xxhash64("text"), "text")).alias("r")
    again = docs.join(_small(twice), "doc_id", "left_semi").join(_small(gone), "doc_id", "left_anti")
    chosen = again.groupBy(F.col("doc_id").alias("__id")).agg(first).select("r.*")
    return single.select(docs.columns).unionByName(chosen.select(docs.columns))
