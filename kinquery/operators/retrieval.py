"""Retrieval over document tables: BM25, vectors, titles, patterns, sentences."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from kinquery.functions import columns as C
from kinquery.operators.bm25 import Bm25Index, bm25, tokens, top  # noqa: F401

BROADCAST_BYTES = 8 << 20


def ids_by_title(docs: DataFrame, title: str = "title", order: str = "doc_id") -> DataFrame:
    """title, ids in order."""
    return docs.groupBy(title).agg(F.array_sort(F.collect_list(order)).alias("ids"))


def _dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v)


def _distance(a: Column, b: Column) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))), F.lit(0.0), lambda s, v: s + v))


#: Pairs of a matrix product at most.
PAIRS_AT_ONCE = 1 << 21
#: Scores nearer than this may round to one ninth decimal.
SAME = 2e-9


def _regular(vector: str, width: int) -> Column:
    """Of ``width`` finite components, none null or over 1e100."""
    fine = F.forall(vector, lambda c: c.isNotNull() & (F.abs(c.cast("double")) < F.lit(1e100)))
    return F.coalesce(F.col(vector).isNotNull() & (F.size(vector) == width) & fine, F.lit(False))


def _place(ids: pa.Array) -> np.ndarray:
    return pc.rank(ids, "ascending", null_placement="at_start", tiebreaker="first").to_numpy()


class _Best:
    """The rows of a task that can be among the k best of each query, by matrix products.

    A product only tells which pairs are scored; those that can reach a query's k-th best so far, by
    the product's own rounding, get the score that adds components one after the other. Of equal
    scores the k of the least ids stay, of others all that may round to the k-th best's.
    """

    def __init__(self, queries: np.ndarray, k: int, metric: str):
        self.v, self.k, self.l2 = queries, k, metric != "dot"
        self.norm = np.sqrt((queries * queries).sum(axis=1))
        self.least = np.full(len(queries), -np.inf)
        self.q, self.s, self.d = np.zeros(0, np.int64), np.zeros(0), None  # None: no rows were added

    def _scored(self, q: np.ndarray, x: np.ndarray) -> np.ndarray:
        v, out = self.v[q], np.zeros(len(q))
        for j in range(v.shape[1]):  # in the order of the components, as SQL adds them
            step = x[:, j] - v[:, j] if self.l2 else v[:, j]
            out += step * step if self.l2 else x[:, j] * step
        return -np.sqrt(out) if self.l2 else out

    def _unlike(self, docs: pa.Array, x: np.ndarray) -> np.ndarray:
        """Rows without those that k rows of the same vector and lesser ids stand before."""
        same = np.unique(np.ascontiguousarray(x).view(np.dtype((np.void, x.shape[1] * 8))).ravel(), return_inverse=True)[1].ravel()
        order = np.lexsort((_place(docs), same))
        at = np.arange(len(order))
        run = np.maximum.accumulate(np.where(np.concatenate([[True], same[order][1:] != same[order][:-1]]), at, 0))
        return np.sort(order[at - run < self.k])

    def add(self, docs: pa.Array, x: np.ndarray) -> None:
        some = self._unlike(docs, x)
        docs, x = docs.take(pa.array(some)), x[some]
        norm = np.sqrt((x * x).sum(axis=1))
        some = max(1, PAIRS_AT_ONCE // len(x))
        for lo in range(0, len(self.v), some):
            part = slice(lo, lo + some)
            high = self.v[part] @ x.T  # what the score is at most, or not below by more than rounding
            slack = 8 * (x.shape[1] + 4) * 2.0**-53
            if self.l2:
                far = self.norm[part, None] ** 2 + norm[None, :] ** 2
                high = -np.sqrt(np.maximum(far * (1 - slack) - 2 * high, 0))
            else:
                high += slack * self.norm[part, None] * norm[None, :]
            least = self.least[part]
            if len(x) > self.k and np.isinf(least).any():  # of the first rows only the best and what may equal them
                kth = np.partition(high, len(x) - self.k, axis=1)[:, len(x) - self.k]
                if self.l2:
                    kth = -np.sqrt(kth * kth + 2 * slack * (self.norm[part] + norm.max()) ** 2)
                else:
                    kth = kth - 2 * slack * self.norm[part] * norm.max()
                least = np.maximum(least, kth)
            i, j = np.nonzero(high >= (least - SAME)[:, None])
            cuts = range(0, len(i), 1 << 16)
            self._keep(i + lo, np.concatenate([self._scored(i[c : c + (1 << 16)] + lo, x[j[c : c + (1 << 16)]]) for c in cuts] or [np.zeros(0)]), docs.take(pa.array(j)))

    def _keep(self, q: np.ndarray, s: np.ndarray, d: pa.Array) -> None:
        self.q, self.s = np.concatenate([self.q, q]), np.concatenate([self.s, s])
        self.d = d if self.d is None else pa.concat_arrays([self.d, d])
        if not len(q):
            return
        order = np.lexsort((_place(self.d), -self.s, self.q))
        q, s = self.q[order], self.s[order]
        at = np.arange(len(q))
        new = np.concatenate([[True], q[1:] != q[:-1]])
        first = np.maximum.accumulate(np.where(new, at, 0))
        run = np.maximum.accumulate(np.where(np.concatenate([[True], new[1:] | (s[1:] != s[:-1])]), at, 0))
        full = np.flatnonzero(at - first == self.k - 1)
        self.least[q[full]] = s[full]
        stay = (s >= self.least[q] - SAME) & (at - run < self.k)
        self.q, self.s, self.d = q[stay], s[stay], self.d.take(pa.array(order[stay]))


def _nearest(have: DataFrame, some: DataFrame, k: int, metric: str) -> DataFrame:
    """__q, __d, score: what can be among the k best, k rows and their equals a query and task."""
    block = some.toArrow()
    ids = block.column("__q").combine_chunks()
    vectors = np.array(block.column("__v").to_pylist(), float)
    told = have.sparkSession.sparkContext.broadcast((ids, vectors))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, vectors = told.value
        best = _Best(vectors, k, metric) if len(ids) else None
        for batch in batches:
            for lo in range(0, batch.num_rows if best else 0, 4096):
                part = batch.slice(lo, 4096)
                best.add(part.column("__d"), part.column("__x").flatten().to_numpy(zero_copy_only=False).astype(float).reshape(part.num_rows, -1))
        if best and best.d is not None:
            yield pa.RecordBatch.from_arrays([ids.take(pa.array(best.q)), best.d, pa.array(best.s)], ["__q", "__d", "score"])

    kinds = [f"{c} {df.schema[c].dataType.simpleString()}" for df, c in ((some, "__q"), (have, "__d"))]
    return have.select("__d", "__x").mapInArrow(run, ", ".join([*kinds, "score double"]))


def dense(docs: DataFrame, queries: DataFrame, k: int = 4, metric: str = "dot", doc: str = "doc_id", vector: str = "vector", query: str = "query_id", query_vector: str = "query_vector") -> DataFrame:
    """query, doc, score, rank by inner product (``dot``) or least distance (``l2``).

    A given query set meets all documents, in matrix products that leave about k rows a query and task.
    It goes to the tasks in blocks of at most ``BROADCAST_BYTES``. Vectors of another length, or with
    components that are null, not finite or over 1e100, are compared row by row with all others.
    """
    asked = queries.select(F.col(query).alias("__q"), F.col(query_vector).alias("__v"))
    have = docs.select(F.col(doc).alias("__d"), F.col(vector).alias("__x"))
    size = asked.agg(F.coalesce(F.sum(F.size("__v").cast("long") * 8 + 16), F.lit(0)).alias("n"), F.coalesce(F.max(F.size("__v")), F.lit(0)).alias("width")).first()
    parts = []

    def blocks_of(some: DataFrame) -> list[DataFrame]:
        n = max(1, -(-size["n"] // BROADCAST_BYTES))
        return [some] if n == 1 else [some.where(F.pmod(F.xxhash64("__q"), F.lit(n)) == i) for i in range(n)]

    def one_by_one(have: DataFrame, asked: DataFrame) -> None:
        for some in blocks_of(asked):
            score = _dot(F.col("__x"), F.col("__v")) if metric == "dot" else -_distance(F.col("__x"), F.col("__v"))
            parts.append(have.crossJoin(F.broadcast(some)).select("__q", "__d", score.alias("score")))

    if size["width"] < 1:
        one_by_one(have, asked)
    else:
        usual, plain = _regular("__v", size["width"]), _regular("__x", size["width"])
        if not have.where(~plain).isEmpty():
            one_by_one(have.where(~plain), asked)
            have = have.where(plain)
        if not asked.where(~usual).isEmpty():
            one_by_one(have, asked.where(~usual))
        parts += [_nearest(have, some, k, metric) for some in blocks_of(asked.where(usual))]
    best = lambda rows: top(rows, ["__q"], k, F.round("score", 9), ["__d"])
    out = best(reduce(DataFrame.unionByName, [best(p).drop("rank") for p in parts]) if len(parts) > 1 else parts[0])
    shown = F.col("score") if metric == "dot" else -F.col("score")
    return out.select(F.col("__q").alias(query), F.col("__d").alias(doc), shown.alias("score"), "rank")


def by_title(docs: DataFrame, queries: DataFrame, doc: str = "doc_id", title: str = "title", query: str = "query_id", wanted: str = "query") -> DataFrame:
    """query, doc, title of the first document (least id) whose title is the one asked for, whatever its case."""
    hit = queries.select(F.col(query), F.lower(wanted).alias("__t")).join(docs.select(F.col(doc), F.col(title), F.lower(title).alias("__t")), "__t")
    first = hit.groupBy(query).agg(F.min_by(F.struct(F.col(doc), F.col(title)), F.col(doc)).alias("m"))
    return first.select(query, f"m.{doc}", f"m.{title}")


def merged_chunks(docs: DataFrame, title: str = "title", body: str = "body", order: str = "doc_id") -> DataFrame:
    """title, body: all chunks of a title in order, a line feed between them."""
    listed = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(body).alias("b"))))
    return docs.groupBy(title).agg(F.array_join(F.transform(listed, lambda c: c["b"]), "\n").alias(body))


def title_or_bm25(docs: DataFrame, queries: DataFrame, k: int = 2, doc: str = "doc_id", title: str = "title", text: str = "text", query: str = "query_id", wanted: str = "query") -> DataFrame:
    """query, doc, how, rank: the document of that title, or else the k best by BM25."""
    exact = by_title(docs, queries, doc, title, query, wanted).select(query, doc, F.lit("title").alias("how"), F.lit(1).alias("rank"))
    rest = queries.join(exact.select(query).distinct(), query, "left_anti")
    ranked = bm25(docs, rest, k, doc, text, query, wanted).select(query, doc, F.lit("bm25").alias("how"), "rank")
    return exact.unionByName(ranked)


def matching(docs: DataFrame, pattern: str, text: str = "text") -> DataFrame:
    """Documents in whose lower-case text the lower-case pattern is found; ValueError for a bad pattern."""
    if not C.valid_pattern(pattern.lower()):
        raise ValueError(f"not a pattern: {pattern}")
    return docs.where(F.lower(text).rlike(pattern.lower()))


def numbered(rows: DataFrame, by: list[str], order: str, title: str) -> DataFrame:
    """'(1) title' labels in order inside each group, which may have any share of the rows."""
    from kinquery.operators.numbering import group_key, placed

    grouped = rows.withColumn("__grp", F.concat_ws("\x00", *(group_key(F.col(c)) for c in by)))
    found = placed(grouped, "__grp", [order, title], "labels", "__place")
    return found.withColumn("label", F.concat(F.lit("("), (F.col("__place") + 1).cast("string"), F.lit(") "), F.col(title))).drop("__grp", "__place")


def keyword_lookup(docs: DataFrame, keyword: str, doc: str = "doc_id", text: str = "text", around: int = 2) -> DataFrame:
    """doc, n, sentence, context: the sentences that hold the keyword, in order, with their neighbours."""
    if not any(c.isspace() for c in keyword):  # then it can't arise from white space being collapsed
        docs = docs.where(F.contains(F.lower(text), F.lit(keyword.lower())))
    cut = docs.select(F.col(doc), C.sentences(text).alias("__s"))
    hits = cut.select(F.col(doc), "__s", F.posexplode("__s").alias("__i", "sentence")).where(F.contains(F.lower("sentence"), F.lit(keyword.lower())))
    first = F.greatest(F.col("__i") - around, F.lit(0))
    context = F.array_join(F.slice("__s", first + 1, F.col("__i") + around - first + 1), " ")
    n = F.row_number().over(W.partitionBy(doc).orderBy("__i"))
    return hits.select(F.col(doc), n.alias("n"), "sentence", context.alias("context"))


def evidence(docs: DataFrame, by: list[str], order: str, text: str, separator: str = "\n================\n\n") -> DataFrame:
    """One text a group: its documents in order, joined."""
    listed = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(text).alias("t"))))
    return docs.groupBy(*by).agg(F.array_join(F.transform(listed, lambda c: c["t"]), separator).alias("evidence"))


def relevant(docs: DataFrame, names: DataFrame, title: str = "title", text: str = "article", separator: str = "\n================\n\n") -> DataFrame:
    """names(id, names array): the articles of the names, in the list's order, joined."""
    listed = names.select("id", F.posexplode("names").alias("pos", "__n"))
    hit = listed.join(docs.select(F.col(title).alias("__n"), F.col(text).alias("__t")), "__n")
    return evidence(hit, ["id"], "pos", "__t", separator)
