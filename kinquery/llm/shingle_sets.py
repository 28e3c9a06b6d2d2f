"""Links between texts whose sets of word shingles are alike, exactly, by prefixes.

Two sets of a Jaccard similarity of ``similarity`` or more share a good part of their shingles, so
under any order of all shingles they share one among the first n - ceil(similarity * n) + 1 of
each. Every class of texts of one set is dealt to the keys of that prefix; a pair is weighed at its
first common key, where the sizes and the key's places already bound what can be shared.

The order is free, and its choice changes no result: shingles found often come last, so that a
passage that many texts have is no key of theirs. They are counted in the pass that hashes the
texts: per batch, added up over all batches, the ``ORDERED`` most frequent of them (a bounded
broadcast); an unlisted frequent shingle costs time, no link.

At a key of up to ``cold`` classes, the pairs that sizes and places allow are written down once and
weighed by counts of their shingles in 256 buckets, which bound what is shared from above; what is
left is decided on whole sets. A key of more classes gets their whole sets into one shard, where
``SetLinks`` joins them without writing pairs. Over ``hot`` classes a key is cut into bands of
sizes, each class going to its own band and the next one, and bands of over ``hot`` into parts that
meet two by two. So no pair is lost at any size.

What goes to a pair are the texts of its classes, told by a bitmap of a bounded size (what it lets
through too much is of no effect); their sets are hashed again where the pair is decided. Only shards
get sets, as there a text would be hashed once a key.

Shingles are XXH64 values; sets without shingles (null, empty) are one class. Rows without an id
take no part.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinquery.llm.batches import slices
from kinquery.llm.components import components
from kinquery.llm.simhash import fingerprint_hashes, majority
from kinquery.runtime import checkpoint, drop_scratch, scratch_mark, stored

COLD = 64
ORDERED = 1 << 18
BITMAP = 1 << 26
SALTS = 64
#: Shingles of a shard at most, some 40 bytes each while it is joined; a shard of more is cut.
SHARD_SHINGLES = 1 << 22
BUCKETS = 256
EPS = 1e-9


def prefix_length(n: np.ndarray | int, similarity: float):
    return n - np.ceil(similarity * n - EPS).astype(np.int64) + 1


def must_share(n, m, similarity: float):
    """How many shingles sets of n and m must share to be similar."""
    return np.ceil(similarity / (1 + similarity) * (n + m) - EPS)


def fits(n, i, m, j, similarity: float):
    """Whether sets of n and m shingles can be similar if their first common one has places i and j."""
    return (np.minimum(n, m) >= similarity * np.maximum(n, m) - EPS) & (1 + np.minimum(n - i - 1, m - j - 1) >= must_share(n, m, similarity))


def _bucket_counts(hashes: np.ndarray) -> bytes:
    """Counts in buckets, one or two bytes each; nothing where two don't do."""
    found = np.bincount((hashes & np.uint64(BUCKETS - 1)).astype(np.int64), minlength=BUCKETS)
    most = found.max()
    return found.astype(np.uint8 if most < 1 << 8 else "<u2").tobytes() if most < 1 << 16 else b""


def _same(hashes: np.ndarray) -> int:
    from xxhash import xxh64_intdigest

    return xxh64_intdigest(hashes.tobytes(), len(hashes)) - (1 << 63)


def set_prints(docs: DataFrame, similarity: float, fingerprint: int | None = None, shingle: int = 5, seed: int = 42) -> DataFrame:
    """doc_id, fp (of ``fingerprint``-word shingles), same (a hash of the set), n, counts, common.

    common: keys found more than once among the prefixes of a batch's distinct sets, with counts.
    """

    def often(heads: list[np.ndarray]) -> bytes | None:
        k, c = np.unique(np.concatenate([*heads, np.zeros(0, np.uint64)]), return_counts=True)
        return np.stack([k[c > 1], c[c > 1].astype(np.uint64)]).tobytes() or None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            heads: list[np.ndarray] = []
            seen: set[int] = set()
            held = 0
            done = 0
            for some in slices(batch, "text", rows=256):
                done += some.num_rows
                texts = some.column("text").to_pylist()
                fps = np.zeros(len(texts), np.uint64)
                if fingerprint is not None:
                    each = [fingerprint_hashes(t, fingerprint, seed) for t in texts]
                    fps = majority(np.concatenate(each), np.concatenate([[0], np.cumsum([len(x) for x in each])]))
                sets = [np.unique(fingerprint_hashes(t, shingle, seed)) for t in texts]
                same = list(map(_same, sets))
                for x, key in zip(sets, same, strict=True):
                    if len(x) and key not in seen:
                        seen.add(key)
                        heads.append(x[: int(prefix_length(len(x), similarity))])
                        held += len(heads[-1])
                common: list[bytes | None] = [None] * len(texts)
                if held > 1 << 21 or done == batch.num_rows:
                    common[0] = often(heads)
                    heads, held = [], 0
                yield pa.RecordBatch.from_arrays(
                    [some.column("doc_id"), pa.array(fps.view(np.int64)), pa.array(same, pa.int64()), pa.array([len(x) for x in sets], pa.int32()), pa.array(list(map(_bucket_counts, sets)), pa.binary()), pa.array(common, pa.binary())],
                    ["doc_id", "fp", "same", "n", "counts", "common"],
                )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, fp long, same long, n int, counts binary, common binary")


def frequent(prints: DataFrame, cold: int, most: int = ORDERED) -> np.ndarray:
    """The most frequent keys (unsigned, sorted), ``most`` at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for x in batch.column("common").to_pylist():
                k, c = np.frombuffer(x, np.int64).reshape(2, -1)
                yield pa.RecordBatch.from_arrays([pa.array(k), pa.array(c)], ["k", "c"])

    found = prints.where("common is not null").select("common").mapInArrow(run, "k long, c long")
    top = found.groupBy("k").agg(F.sum("c").alias("c")).where(F.col("c") > cold).orderBy(F.col("c").desc(), "k").limit(most)
    return np.sort(top.select("k").toArrow()["k"].to_numpy().view(np.uint64))


def _ordered(hashes: np.ndarray, last: np.ndarray) -> np.ndarray:
    """A sorted set with the frequent shingles behind the others."""
    if not len(last):
        return hashes
    late = last[np.minimum(np.searchsorted(last, hashes), len(last) - 1)] == hashes
    return np.concatenate([hashes[~late], hashes[late]])


def _is_in(keys: np.ndarray, last: np.ndarray) -> np.ndarray:
    return last[np.minimum(np.searchsorted(last, keys), len(last) - 1)] == keys if len(last) else np.zeros(len(keys), bool)


def prefixes(docs: DataFrame, shared, similarity: float, shingle: int, seed: int) -> DataFrame:
    """k, salt, a, n, i: the keys of each class, once a batch. Frequent keys are salted by class."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = shared.value
        for batch in batches:
            seen: set[int] = set()
            for some in slices(batch, "text", rows=64):
                rows = []
                for t in some.column("text").to_pylist():
                    x = np.unique(fingerprint_hashes(t, shingle, seed))
                    same = _same(x)
                    if len(x) and same not in seen:
                        seen.add(same)
                        rows.append((same, len(x), _ordered(x, last)[: int(prefix_length(len(x), similarity))]))
                if rows:
                    sizes = [len(x) for _, _, x in rows]
                    k = np.concatenate([x for _, _, x in rows])
                    a = np.repeat(np.array([r[0] for r in rows], np.int64), sizes)
                    i = np.arange(len(k)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
                    salt = np.where(_is_in(k, last), a % SALTS, 0)
                    yield pa.RecordBatch.from_arrays([pa.array(k.view(np.int64)), pa.array(salt.astype(np.int32)), pa.array(a), pa.array(np.repeat(np.array([r[1] for r in rows], np.int32), sizes)), pa.array(i.astype(np.int32))], ["k", "salt", "a", "n", "i"])

    return docs.select("text").mapInArrow(run, "k long, salt int, a long, n int, i int")


MEETING = "k long, a long, n int, i int, b long"


def meetings(dealt: DataFrame, shared, similarity: float, cold: int) -> DataFrame:
    """Pairs (a, b) that can be similar of keys of few classes; the rows of other keys, with b null."""

    def alone(rows: np.ndarray) -> np.ndarray:
        """Rows without those that repeat the key and class before them."""
        return rows[:, np.concatenate([[True], (rows[0, 1:] != rows[0, :-1]) | (rows[1, 1:] != rows[1, :-1])])] if rows.shape[1] else rows

    def batch_of(rows: np.ndarray, b: np.ndarray | None = None) -> pa.RecordBatch:
        n = rows.shape[1]
        return pa.RecordBatch.from_arrays([pa.array(rows[0]), pa.array(rows[1]), pa.array(rows[2].astype(np.int32)), pa.array(rows[3].astype(np.int32)), pa.nulls(n, pa.int64()) if b is None else pa.array(b)], ["k", "a", "n", "i", "b"])

    def whole_keys(rows: np.ndarray, last: np.ndarray) -> Iterator[pa.RecordBatch]:
        k, a, n, i = rows = alone(rows)
        if not len(k):
            return
        heads = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]]))
        sizes = np.diff(np.append(heads, len(k)))
        many = (sizes > cold) | _is_in(k[heads].view(np.uint64), last)
        if many.any():
            yield batch_of(rows[:, np.repeat(many, sizes)])
        end = np.repeat(np.where(many, heads, heads + sizes), sizes)
        live, d = np.arange(len(k)), 1
        while True:
            live = live[live + d < end[live]]
            live = live[n[live] >= similarity * n[live + d] - EPS]  # sizes rise within a key
            if not len(live):
                return
            far = live + d
            ok = fits(n[live], i[live], n[far], i[far], similarity)
            if ok.any():
                one, other = live[ok], far[ok]
                yield batch_of(np.stack([np.zeros(len(one), np.int64), np.minimum(a[one], a[other]), n[one], i[one]]), np.maximum(a[one], a[other]))
            d += 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = shared.value
        held, passing = np.zeros((4, 0), np.int64), None
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = np.stack([batch.column(c).to_numpy().astype(np.int64) for c in ("k", "a", "n", "i")])
            if passing is not None:
                at = int(np.searchsorted(rows[0], passing, side="right"))
                if at:
                    yield batch_of(alone(rows[:, :at]))
                rows = rows[:, at:]
                if not rows.shape[1]:
                    continue
                passing = None
            rows = np.concatenate([held, rows], axis=1)
            at = int(np.searchsorted(rows[0], rows[0, -1], side="left"))
            yield from whole_keys(rows[:, :at], last)
            held = alone(rows[:, at:])
            if held.shape[1] > cold:  # a key of many classes goes on as it comes
                yield batch_of(held)
                held, passing = np.zeros((4, 0), np.int64), int(rows[0, -1])
        yield from whole_keys(held, last)

    return dealt.repartition("k", "salt").sortWithinPartitions("k", "n", "a").select("k", "a", "n", "i").mapInArrow(run, MEETING)


class _Lists:
    """For each shingle the sets that have it, to count what a set shares with those before it."""

    def __init__(self, sets: list[np.ndarray]):
        sizes = np.array([len(x) for x in sets], np.int64)
        self.ends = np.cumsum(sizes)
        self.starts = self.ends - sizes
        flat = np.concatenate(sets)
        by = np.argsort(flat, kind="stable")
        flat = flat[by]
        opens = np.concatenate([[True], flat[1:] != flat[:-1]]) if len(flat) else np.zeros(0, bool)
        begin = np.maximum.accumulate(np.where(opens, np.arange(len(flat)), 0)) if len(flat) else np.zeros(0, np.int64)
        self.lists = np.repeat(np.arange(len(sets), dtype=np.int32), sizes)[by]
        self.begin, self.before = np.empty(len(flat), np.int32), np.empty(len(flat), np.int32)
        self.begin[by], self.before[by] = begin, np.arange(len(flat)) - begin

    def cost(self, i: int) -> int:
        return int(self.before[self.starts[i] : self.ends[i]].sum(dtype=np.int64))

    def counts(self, i: int) -> np.ndarray:
        """By set before i: how many shingles of i it has."""
        one = slice(self.starts[i], self.ends[i])
        n = self.before[one].astype(np.int64)
        if not len(n):
            return np.zeros(i, np.int64)
        ends = np.cumsum(n)
        at = np.arange(int(ends[-1])) + np.repeat(self.begin[one] - (ends - n), n)
        return np.bincount(self.lists[at], minlength=i)


class SetLinks:
    """Links the similar ones of a key's sets (in the common order, without repeats, none empty).

    Sets are taken by size, so those a set can be similar to stand in one run before it. A few next
    to it are compared first, as one of a large group connects all of it; of the others, those left
    that share a shingle before the key are weighed at that one. All counts are of whole sets.
    """

    def __init__(self, sets: list[np.ndarray], places: list[int], reps: list[int], similarity: float):
        sizes = np.array([len(x) for x in sets], np.int64)
        order = np.argsort(sizes, kind="stable")
        self.sets, self.sizes, self.similarity = [sets[i] for i in order], sizes[order], similarity
        self.reps, self.places = [reps[i] for i in order], np.array(places, np.int64)[order]
        self.whole, self.early = _Lists(self.sets), _Lists([x[:p] for x, p in zip(self.sets, self.places.tolist(), strict=True)])

    def _shared(self, i: int, some: np.ndarray) -> np.ndarray:
        if self.sizes[some].sum() > self.whole.cost(i):
            return self.whole.counts(i)[some]
        mine, theirs = np.sort(self.sets[i]), np.concatenate([self.sets[j] for j in some.tolist()])
        hit = mine[np.minimum(np.searchsorted(mine, theirs), len(mine) - 1)] == theirs
        return np.add.reduceat(hit, np.cumsum(self.sizes[some]) - self.sizes[some], dtype=np.int64)

    def links(self) -> list[tuple[int, int]]:
        """(rep, root) of every linked set."""
        s, n, at, label = self.similarity, self.sizes, self.places, np.arange(len(self.sets))
        low = np.searchsorted(n, s * n - EPS)
        for i in range(1, len(n)):
            rest = np.arange(low[i], i)
            rest = rest[(label[rest] != label[i]) & fits(n[i], at[i], n[rest], at[rest], s)]
            for some, few in ((rest[-4:], True), (rest[:-4], False)):
                some = some[label[some] != label[i]]
                if len(some) and not few:
                    some = some[self.early.counts(i)[some] == 0]
                if not len(some):
                    continue
                alike = some[self._shared(i, some) >= must_share(n[some], n[i], s)]
                if len(alike):
                    label[np.isin(label, label[alike])] = label[i]
        least: dict[int, int] = {}
        for x, r in zip(label.tolist(), self.reps, strict=True):
            least[x] = min(r, least.get(x, r))
        return [(r, least[x]) for x, r in zip(label.tolist(), self.reps, strict=True) if r != least[x]]


def _can_share(pairs: DataFrame, similarity: float) -> DataFrame:
    """Of pairs with their bucket counts, those that could share enough."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            left = []
            rows = zip(*(batch.column(c).to_pylist() for c in ("counts_a", "counts_b", "n_a", "n_b")), strict=True)
            for x, y, n, m in rows:
                if x and y:
                    x, y = (np.frombuffer(z, np.uint8 if len(z) == BUCKETS else "<u2") for z in (x, y))
                    left.append(np.minimum(x, y).sum(dtype=np.int64) >= must_share(n, m, similarity))
                else:
                    left.append(True)
            yield batch.select(["a", "b", "rep_a", "rep_b"]).filter(pa.array(left, pa.bool_()))

    return pairs.mapInArrow(run, "a long, b long, rep_a long, rep_b long")


def _texts(docs: DataFrame, needed: DataFrame, shingle: int, seed: int) -> DataFrame:
    """same (the hash of its set), text of at least the documents ``needed(rep)``."""
    spark = docs.sparkSession
    bits = min(BITMAP, 1 << max(6, int(16 * needed.count()).bit_length()))
    place = lambda c: F.pmod(F.xxhash64(c), F.lit(bits))
    words = needed.select(place("rep").alias("p")).groupBy(F.floor(F.col("p") / 64).alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(p % 64 as int))")).alias("v")).toArrow()
    bitmap = np.zeros(bits // 64, np.int64)
    bitmap[words["w"].to_numpy()] = words["v"].to_numpy()
    told = spark.sparkContext.broadcast(bitmap)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        map_ = told.value
        for batch in batches:
            p = batch.column("p").to_numpy()
            which = np.flatnonzero((map_[p >> 6] >> (p & 63)) & 1)
            for some in slices(batch.take(pa.array(which)), "text", rows=64):
                same = [_same(np.unique(fingerprint_hashes(t, shingle, seed))) for t in some.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays([pa.array(same, pa.int64()), some.column("text")], ["same", "text"])

    return docs.select(place(F.col("doc_id").cast("long")).alias("p"), "text").mapInArrow(run, "same long, text string")


def _sets(texts: DataFrame, shared, shingle: int, seed: int) -> DataFrame:
    """same, hashes (in the common order) of ``texts(same, text)``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = shared.value
        for some in (s for b in batches for s in slices(b, "text", rows=64)):
            sets = [_ordered(np.unique(fingerprint_hashes(t, shingle, seed)), last).tobytes() for t in some.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([some.column("same"), pa.array(sets, pa.binary())], ["same", "hashes"])

    return texts.mapInArrow(run, "same long, hashes binary")


def _decided(pairs: DataFrame, similarity: float, shingle: int, seed: int) -> DataFrame:
    """Edges (a, b) between the reps of pairs with texts x and y whose whole sets are similar."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: tuple[str, np.ndarray] | None = None
        for batch in (s for b in batches for s in slices(b, "x", rows=256)):
            left = []
            for x, y in zip(batch.column("x"), batch.column("y"), strict=True):
                x, y = x.as_py(), y.as_py()
                if last is None or y != last[0]:  # rows of one y mostly come together
                    last = (y, np.unique(fingerprint_hashes(y, shingle, seed)))
                one, other = np.unique(fingerprint_hashes(x, shingle, seed)), last[1]
                left.append(len(np.intersect1d(one, other, assume_unique=True)) >= must_share(len(one), len(other), similarity))
            yield batch.select(["a", "b"]).filter(pa.array(left, pa.bool_()))

    return pairs.mapInArrow(run, "a long, b long")


def _in_shards(rows: DataFrame, sets: DataFrame, similarity: float, hot: int) -> DataFrame:
    """rows(k, a, n, i, rep) of keys of many classes: edges (a, b) of reps that connect all similar ones."""
    most = SHARD_SHINGLES
    size = (F.count(F.lit(1)).alias("c"), F.sum(F.col("n").cast("long")).alias("t"))
    held = rows.count()
    sized = rows.join(checkpoint(rows.groupBy("k").agg(*size).where("c > 1"), held), "k")  # small once written, so rows stay where they are
    fit = (F.col("c") <= hot) & (F.col("t") <= most)
    whole = F.lit(-1).cast("long")
    cols = ("a", "i", "rep", "k")
    small = sized.where(fit).select(*cols, whole.alias("band"), whole.alias("x"), whole.alias("y"))
    own = F.floor(F.log("n") / F.lit(-np.log(similarity)) + F.lit(EPS))
    banded = sized.where(~fit).select(*cols, "n", own.alias("own"), F.explode(F.array(own, own + 1)).alias("band"))
    bands = checkpoint(banded.groupBy("k", "band").agg(*size, F.max(F.col("own") == F.col("band")).alias("home")).where("c > 1 and home"), 2 * held)
    parts = F.ceil(F.greatest(F.col("c") / hot, F.col("t") / most))
    cut = banded.join(bands.select("k", "band", parts.alias("g")), ["k", "band"]).withColumn("h", F.pmod(F.xxhash64("rep"), "g"))
    pair = F.explode(F.transform(F.sequence(F.lit(0).cast("long"), F.col("g") - 1), lambda o: F.struct(F.least("h", o).alias("x"), F.greatest("h", o).alias("y")))).alias("p")
    met = cut.select(*cols, "band", pair).select(*cols, "band", "p.x", "p.y")
    keys = ["k", "band", "x", "y"]
    dealt = small.unionByName(met).join(sets.withColumnRenamed("same", "a"), "a").select(*keys, "i", "rep", "hashes")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, reps, places, held = None, [], [], []

        def flush() -> pa.RecordBatch:
            found = SetLinks(held, places, reps, similarity).links() if len(reps) > 1 else []
            return pa.RecordBatch.from_arrays([pa.array([x[0] for x in found], pa.int64()), pa.array([x[1] for x in found], pa.int64())], ["a", "b"])

        for batch in (b.slice(lo, 500) for b in batches for lo in range(0, b.num_rows, 500)):
            cols = [batch.column(c).to_pylist() for c in (*keys, "i", "rep", "hashes")]
            for *key, i, rep, hashes in zip(*cols, strict=True):
                if key != now:
                    if len(reps) > 1:
                        yield flush()
                    now, reps, places, held = key, [], [], []
                reps.append(rep)
                places.append(i)
                held.append(np.frombuffer(hashes, np.uint64))
        yield flush()

    return dealt.repartition(*keys).sortWithinPartitions(*keys, "rep").mapInArrow(run, "a long, b long")


def similar_classes(docs: DataFrame, prints: DataFrame, similarity: float = 0.8, shingle: int = 5, seed: int = 42, cold: int = COLD, hot: int = 4096, ordered: int = ORDERED) -> tuple[DataFrame, DataFrame]:
    """classes(same, rep, n, counts), and edges (a, b) of reps that connect all similar ones.

    ``prints``: what ``set_prints`` gave for ``docs``, stored.
    """
    one = F.min(F.struct("doc_id", "n", "counts")).alias("o")
    classes = stored(prints.groupBy("same").agg(one).select("same", F.col("o.doc_id").alias("rep"), "o.n", "o.counts"), "set-classes", prints.count())
    shared = docs.sparkSession.sparkContext.broadcast(frequent(prints, cold, ordered))
    met = stored(meetings(prefixes(docs, shared, similarity, shingle, seed), shared, similarity, cold), "meetings")
    side = lambda c: classes.select(F.col("same").alias(c), *(F.col(x).alias(f"{x}_{c}") for x in ("rep", "n", "counts")))
    close = stored(_can_share(met.where("b is not null").select("a", "b").distinct().join(side("a"), "a").join(side("b"), "b"), similarity), "close-pairs")
    rows = stored(met.where("b is null").select("k", "a", "n", "i").distinct().join(classes.select(F.col("same").alias("a"), "rep"), "a"), "frequent-keys")
    needed = close.select(F.explode(F.array("rep_a", "rep_b")).alias("rep")).unionByName(rows.select("rep")).distinct()
    texts = stored(_texts(docs, needed, shingle, seed), "texts")
    side = lambda c, name: texts.select(F.col("same").alias(c), F.col("text").alias(name))
    weighed = close.join(side("a", "x"), "a").join(side("b", "y"), "b").select(F.col("rep_a").alias("a"), F.col("rep_b").alias("b"), "x", "y")
    links = stored(_decided(weighed, similarity, shingle, seed), "set-links")  # two jobs, so that only one's shuffle files are there at once
    at_keys = texts.join(rows.select(F.col("a").alias("same")), "same", "left_semi")
    return classes, links.unionByName(stored(_in_shards(rows, _sets(at_keys, shared, shingle, seed), similarity, hot), "shard-links"))


def similar_documents(docs: DataFrame, shingle: int = 5, similarity: float = 0.8, seed: int = 42, **how) -> DataFrame:
    """One row a document with an id: doc_id, component_id (the smallest doc_id reachable over similar texts).

    A row without an id gets a null component, unless a row of its very set has one.
    """
    mark = scratch_mark()
    prints = stored(set_prints(docs, similarity, None, shingle, seed), "prints")
    known = docs.where("doc_id is not null")
    classes, links = similar_classes(known, prints.where("doc_id is not null"), similarity, shingle, seed, **how)
    groups = components(links)
    out = classes.select("same", "rep").join(groups.withColumnRenamed("id", "rep"), "rep", "left").select("same", F.coalesce("component", "rep").alias("component_id"))
    out = stored(prints.select("doc_id", "same").join(out, "same", "left").select("doc_id", "component_id"), "similar")
    drop_scratch(docs.sparkSession, mark, (out,))
    return out
