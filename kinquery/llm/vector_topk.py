"""Exact top-k inner products, pruned by segment statistics from coarse to fine.

Vectors are cut into segments. With a segment's mean and deviation in both vectors, its part of
the inner product is at most m * (mean * mean + dev * dev), by Cauchy and Schwarz on what is left
of the means; the sum over segments bounds the score (and, with the norms, the distance from
below). A coarse level (few segments) is computed for a whole block of pairs as one matrix
product; pairs that can still enter a query's best k go to the next finer level, and the survivors
are computed exactly: in doubles where the norms keep every sum below 2^53, in 64-bit integers
below 2^62, in Python's integers beyond. Bounds allow for their own rounding; components over 2^100
have none, and all their pairs are computed. A score that a long can't hold is ranked exactly and
shown as the nearest long.

Queries are taken in blocks of a bounded number of bytes; each block is broadcast and meets all
candidates in one pass, which leaves k rows a query and task for the final ranking. Over ``AT_ONCE``
blocks are written in groups, so that no plan grows with their number. Vectors that
are null, empty, or hold null or non-finite components take no part, nor do rows without an id;
pairs of different length are no pairs. A query's own id is no candidate. A repeated query id is asked once,
with its smallest vector; repeated candidate rows count each. Ties go to the smaller id.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from kinquery.runtime import stored

LEVELS = (4, 16)
AT_ONCE = 16
WILD = 2.0**100
_MOST = (1 << 63) - 1


def usable(vectors: DataFrame, key: str, vector: str) -> DataFrame:
    """(id, x array<double>) of the rows that take part."""
    finite = F.forall(F.col(vector), lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c.cast("double")) < F.lit(float("inf"))))
    ok = vectors.where(F.col(key).isNotNull() & F.col(vector).isNotNull() & (F.size(vector) > 0) & finite)
    return ok.select(F.col(key).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("x"))


def _whole(x: np.ndarray, scale: int) -> np.ndarray:
    """floor(scale * x) as Python integers, of any size."""
    return np.array([[(n * scale) // d for n, d in (v.as_integer_ratio() for v in row)] for row in x.tolist()], object).reshape(x.shape)


class _Rows:
    """Quantised vectors: doubles with whole values, statistics of all levels, norms, what is wild."""

    def __init__(self, x: np.ndarray, scale: int):
        self.raw, self.scale = x, scale
        self.wild = (np.abs(x) > WILD).any(axis=1)
        self.x = np.floor(np.where(self.wild[:, None], 0.0, x) * scale)
        self.norm = np.sqrt((self.x * self.x).sum(axis=1)) * (1 + 1e-9)
        self.levels = [_Level(self.x, min(s, x.shape[1])) for s in LEVELS]

    def objects(self, which: np.ndarray) -> np.ndarray:
        return _whole(self.raw[which], self.scale)


class _Level:
    """Means and deviations of all segments of the rows of a matrix, scaled for the bound."""

    def __init__(self, x: np.ndarray, segments: int):
        cuts = np.linspace(0, x.shape[1], segments + 1).astype(int)[:-1]
        sizes = np.diff(np.append(cuts, x.shape[1]))
        mean = np.add.reduceat(x, cuts, axis=1) / sizes
        off = x - np.repeat(mean, sizes, axis=1)
        dev = np.sqrt(np.add.reduceat(off * off, cuts, axis=1) / sizes)
        self.stats = np.concatenate([mean, dev], axis=1) * np.sqrt(np.tile(sizes, 2))


def exact_products(a: _Rows, i: np.ndarray, b: _Rows, j: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[int]]:
    """The integer inner products of rows i of a and j of b: as int64, and for places where that can't do, as Python integers."""
    out = np.zeros(len(i), np.int64)
    most = a.norm[i] * b.norm[j]  # no partial sum is larger
    wild = a.wild[i] | b.wild[j]
    small, large = ~wild & (most < 2.0**53), ~wild & (most >= 2.0**53) & (most < 2.0**62)
    large &= (a.norm[i] < 2.0**62) & (b.norm[j] < 2.0**62)
    if small.all():
        return np.einsum("ij,ij->i", a.x[i], b.x[j]).astype(np.int64), np.zeros(0, np.int64), []
    out[small] = np.einsum("ij,ij->i", a.x[i[small]], b.x[j[small]]).astype(np.int64)
    out[large] = np.einsum("ij,ij->i", a.x[i[large]].astype(np.int64), b.x[j[large]].astype(np.int64))
    rest = np.flatnonzero(~small & ~large)
    return out, rest, (a.objects(i[rest]) * b.objects(j[rest])).sum(axis=1).tolist() if len(rest) else []


class BlockSearch:
    """The best k of all candidates seen so far, for one block of queries of one length."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, k: int, scale: int):
        self.ids, self.rows, self.k, self.scale = ids, _Rows(x, scale), k, scale
        self.best: list[list[tuple[int, int]]] = [[] for _ in ids]  # (-score, id), sorted
        self.floor = np.full(len(ids), -np.inf)  # the k-th best score
        self.pairs_exact = 0

    def feed(self, ids: np.ndarray, x: np.ndarray) -> None:
        rows = _Rows(x, self.scale)
        step = max(1, 4_000_000 // max(1, len(ids)))
        for lo in range(0, len(self.ids), step):
            self._some(lo, min(lo + step, len(self.ids)), ids, rows)

    def _least(self, q: np.ndarray, norms: np.ndarray) -> np.ndarray:
        """What a bound must reach, less what rounding may have taken from it or the floor."""
        floor = self.floor[q]
        known = np.where(np.isinf(floor), 0.0, floor)
        return np.where(np.isinf(floor), -np.finfo(float).max, known - 1e-9 * (self.rows.norm[q] * norms + np.abs(known)) - 1e-3)

    def _some(self, lo: int, hi: int, ids: np.ndarray, rows: _Rows) -> None:
        mine = self.rows
        bound = mine.levels[0].stats[lo:hi] @ rows.levels[0].stats.T
        bound[:, rows.wild] = np.inf
        bound[mine.wild[lo:hi], :] = np.inf
        bound[self.ids[lo:hi, None] == ids[None, :]] = -np.inf
        cold = np.flatnonzero(self.floor[lo:hi] == -np.inf)
        if len(cold):  # a first floor: the exact scores of the most promising candidates
            k = min(4 * self.k, len(ids))
            for q in cold.tolist():
                top = np.argpartition(-bound[q], k - 1)[:k]
                top = top[bound[q, top] > -np.inf]
                self._take(np.full(len(top), lo + q), top, ids, rows)
                bound[q, top] = -np.inf
        q, c = np.nonzero(bound >= self._least(np.arange(lo, hi), rows.norm.max(initial=0))[:, None])
        for at in range(0, len(q), 400_000):
            qq, cc = q[at : at + 400_000] + lo, c[at : at + 400_000]
            fine = np.einsum("ij,ij->i", mine.levels[1].stats[qq], rows.levels[1].stats[cc])
            left = (fine >= self._least(qq, rows.norm[cc])) | mine.wild[qq] | rows.wild[cc]
            self._take(qq[left], cc[left], ids, rows)

    def _take(self, q: np.ndarray, c: np.ndarray, ids: np.ndarray, rows: _Rows) -> None:
        if not len(q):
            return
        self.pairs_exact += len(q)
        score, rest, large = exact_products(self.rows, q, rows, c)
        found: dict[int, list[tuple[int, int]]] = {}
        for at, value in zip(rest.tolist(), large, strict=True):
            found.setdefault(int(q[at]), []).append((-value, int(ids[c[at]])))
        good = score >= self.floor[q] - 1e-9 * np.abs(np.where(np.isinf(self.floor[q]), 0.0, self.floor[q]))
        good[rest] = False
        q, c, score = q[good], c[good], score[good]
        order = np.lexsort((ids[c], -score, q))
        q, c, score = q[order], c[order], score[order]
        heads = np.flatnonzero(np.concatenate([[True], q[1:] != q[:-1]])) if len(q) else np.zeros(0, np.int64)
        for a, b in zip(heads.tolist(), np.append(heads[1:], len(q))[: len(heads)].tolist(), strict=True):
            b = min(b, a + self.k)
            found.setdefault(int(q[a]), []).extend(zip((-score[a:b]).tolist(), ids[c[a:b]].tolist(), strict=True))
        for i, more in found.items():
            new = self.best[i] = heapq.nsmallest(self.k, self.best[i] + more)
            if len(new) == self.k:
                self.floor[i] = float(min(max(-new[-1][0], -(10**300)), 10**300))


def order_key(score: int) -> str:
    """Empty where a long holds the score; else a text that sorts as scores of one sign do."""
    if -_MOST <= score <= _MOST:
        return ""
    digits = str(abs(score))
    key = f"{len(digits):06d}{digits}"
    return key if score > 0 else key.translate(str.maketrans("0123456789", "9876543210"))


def _matrix(lists: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Lengths of the lists, and all values."""
    return lists.value_lengths().to_numpy(zero_copy_only=False), lists.flatten().to_numpy(zero_copy_only=False)


def _by_length(ids: np.ndarray, lists: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    sizes, flat = _matrix(lists)
    ends = np.cumsum(sizes)
    for n in np.unique(sizes).tolist():
        which = np.flatnonzero(sizes == n)
        yield n, ids[which], flat[(ends[which] - n)[:, None] + np.arange(n)[None, :]]


def exact_top_k(vectors: DataFrame, asked: Column, k: int = 5, key: str = "vec_id", vector: str = "embedding", scale: int = 256, block_bytes: int = 16 << 20) -> DataFrame:
    """query_id, rank, vec_id, score: each query's k highest inner products of floor(scale * x).

    ``asked``: which rows are queries. ``scale``: a power of two, so that products with it are exact.
    """
    spark = vectors.sparkSession
    candidates = usable(vectors, key, vector)
    queries = stored(usable(vectors.where(asked), key, vector).groupBy("id").agg(F.min("x").alias("x")), "queries")
    mark = queries.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("x")).alias("d")).first()
    parts: list[DataFrame] = []
    blocks = max(1, -(-mark["n"] * (mark["d"] or 1) * 8 // block_bytes))
    for b in range(blocks):
        block = queries.where(F.pmod(F.xxhash64("id"), F.lit(blocks)) == b).toArrow()
        shared = spark.sparkContext.broadcast([(n, i, x) for chunk in block.to_batches() for n, i, x in _by_length(chunk["id"].to_numpy(), chunk["x"])])

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            merged: dict[int, list] = {}
            for n, i, x in shared.value:
                merged.setdefault(n, []).append((i, x))
            search = {n: BlockSearch(np.concatenate([p[0] for p in ps]), np.concatenate([p[1] for p in ps]), k, scale) for n, ps in merged.items()}
            for batch in batches:
                for n, i, x in _by_length(batch.column("id").to_numpy(), batch.column("x")):
                    if n in search:
                        for lo in range(0, len(i), 4096):
                            search[n].feed(i[lo : lo + 4096], x[lo : lo + 4096])
            rows = [(int(q), c, max(-_MOST, min(_MOST, -s)), order_key(-s)) for one in search.values() for q, best in zip(one.ids, one.best, strict=True) for s, c in best]
            yield pa.RecordBatch.from_arrays([pa.array([r[j] for r in rows], pa.string() if j == 3 else pa.int64()) for j in range(4)], ["query_id", "vec_id", "score", "more"])

        parts.append(candidates.mapInArrow(run, "query_id long, vec_id long, score long, more string"))
        if blocks > AT_ONCE and (len(parts) == AT_ONCE or b == blocks - 1):
            parts = [stored(_best(parts, k), "best-so-far")]
    return _best(parts, k).select("query_id", "rank", "vec_id", "score")


def _best(parts: list[DataFrame], k: int) -> DataFrame:
    columns = ["query_id", "vec_id", "score", "more"]
    found = parts[0].select(columns)
    for p in parts[1:]:
        found = found.unionByName(p.select(columns))
    order = W.partitionBy("query_id").orderBy(F.col("score").desc(), F.col("more").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
