"""Benchmark decontamination: BM25 index of test items, block-max WAND, overlap check.

The index has, for each term, its items with their BM25 weight over the item's whole weight, in
blocks of ``BLOCK`` items with the largest weight of each block. A training text is cut into tiles
of as many words as the longest item; two tiles in a row are a passage, so any copy of an item lies
in one passage whole. Every passage is a query, and all items are wanted whose score reaches
``threshold`` (1 is an item's score for itself).

An item's essential terms are its heaviest, until the others together stay below half of the
threshold; a passage without one of them can't reach it. So only essential terms are looked up at first: their
block maxima are added up by passage and block, and blocks whose bound (plus the most that
non-essential terms can give) stays below the threshold are skipped. In blocks that are left,
items are bounded in the same way, then scored exactly. What reaches the threshold is verified: of
the five-word shingles of the item's question (its first line) and of its answer (the other lines)
``overlap`` must stand in the text, of each part that has any. An item of fewer than five words
must stand as a whole. Short answers (under five words) are taken with the question.

Words are runs of letters and digits, lower-cased. Items are dealt by a hash to
chunks of about ``index_bytes`` of text; each chunk's index is broadcast for one pass over the
texts, so what is broadcast is bounded however many items there are. Item counts, lengths and
document frequencies are those of all items, so results are the same however items are dealt. Null
and empty texts and items give no rows; rows without an id neither. Items of equal text are all reported.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinquery.runtime import checkpoint, stored

BLOCK = 8
#: Terms are looked up until the others together give less than this part of the threshold.
REST = 0.5
_WORD = re.compile(r"[^\W_]+")
FOUND = "doc_id long, item_id long, score double, question_overlap double, answer_overlap double"


def words_of(text: str) -> list[str]:
    return _WORD.findall(text.lower())


@dataclass
class ItemStats:
    """Counts over all items, whatever chunk they are in: how many, their words, the longest, and items by word."""

    items: int
    words: int
    longest: int
    df: dict[str, int]

    @classmethod
    def of(cls, bags: list[list[str]]) -> ItemStats:
        return cls(len(bags), sum(map(len, bags)), max(map(len, bags), default=1), dict(Counter(w for bag in bags for w in set(bag))))


def parts_of(text: str, shingle: int = 5) -> tuple[list[str], list[str]]:
    """Words of an item's question and of its answer; a part of too few words is taken with the other."""
    lines = [w for w in (words_of(x) for x in text.split("\n")) if w]
    if not lines:
        return [], []
    question, answer = lines[0], [w for x in lines[1:] for w in x]
    return (question + answer, []) if len(question) < shingle or len(answer) < shingle else (question, answer)


def shingle_hashes(words: list[str], n: int) -> np.ndarray:
    """XXH64 of each run of n words, sorted, without repeats."""
    from xxhash import xxh64_intdigest as h

    return np.unique(np.array([h(" ".join(words[j : j + n]).encode("utf-8", "surrogatepass")) for j in range(len(words) - n + 1)], np.uint64))


class ItemIndex:
    """BM25 postings of one chunk of items in numpy; items are columns 0..n-1.

    Per word of the items: 12 bytes by item, 8 of shingles, and 16 by term where it is essential.
    """

    def __init__(self, items: list[tuple[int, str]], threshold: float, stats: ItemStats | None = None, k1: float = 1.2, b: float = 0.75, shingle: int = 5):
        self.threshold = threshold
        kept = [(i, q, a) for i, (q, a) in ((i, parts_of(t, shingle)) for i, t in sorted(items)) if q]
        stats = stats or ItemStats.of([q + a for _, q, a in kept])
        self.ids, self.longest = [i for i, _, _ in kept], stats.longest
        self.runs = [min(shingle, len(q)) for _, q, _ in kept]
        self.parts = [(shingle_hashes(q, n), shingle_hashes(a, n) if a else None) for n, (_, q, a) in zip(self.runs, kept, strict=True)]
        mean, n = stats.words / max(1, stats.items), len(kept)
        self.term: dict[str, int] = {}
        terms, shares, sizes = [], [], []
        essential: list[list[tuple[int, float]]] = []
        self.rest = np.zeros(n)  # what an item's non-essential terms can give at most
        for i, (_, question, answer) in enumerate(kept):
            length = len(question) + len(answer)
            idf = lambda d: math.log(1 + (stats.items - d + 0.5) / (d + 0.5))
            weight = {w: idf(stats.df[w]) * f * (k1 + 1) / (f + k1 * (1 - b + b * length / mean)) for w, f in Counter(question + answer).items()}
            order = sorted(weight, key=lambda w: (-weight[w], w))
            whole = sum(weight[w] for w in order)
            left = 1.0
            for w in order:
                share = weight[w] / whole
                t = self.term.setdefault(w, len(self.term))
                if t == len(essential):
                    essential.append([])
                terms.append(t)
                shares.append(share)
                if left >= threshold * REST:
                    essential[t].append((i, share))
                    left -= share
            sizes.append(len(order))
            self.rest[i] = max(0.0, left)
        self.ends = np.concatenate([[0], np.cumsum(np.array(sizes, np.int64))]).astype(np.int64)
        self.terms, self.shares = np.array(terms, np.int32), np.array(shares)
        self.blocks = -(-n // BLOCK)
        self.essential = self._flat(essential)
        maxima = []
        for found in essential:
            top: dict[int, float] = {}
            for i, w in found:
                top[i // BLOCK] = max(top.get(i // BLOCK, 0.0), w)
            maxima.append(sorted(top.items()))
        self.maxima = self._flat(maxima)
        self.block_rest = np.array([self.rest[j * BLOCK : (j + 1) * BLOCK].max() for j in range(self.blocks)])
        self.is_essential = np.array([bool(e) for e in essential], bool)

    @staticmethod
    def _flat(lists: list[list[tuple[int, float]]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        sizes = np.array([len(x) for x in lists], np.int64)
        flat = [p for x in lists for p in x]
        return np.concatenate([[0], np.cumsum(sizes)]), np.array([p[0] for p in flat], np.int64), np.array([p[1] for p in flat])

    @staticmethod
    def _expand(flat: tuple[np.ndarray, np.ndarray, np.ndarray], terms: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For each term its entries: place in ``terms``, target, weight."""
        ends, target, weight = flat
        sizes = ends[terms + 1] - ends[terms]
        src = np.repeat(np.arange(len(terms)), sizes)
        at = np.arange(len(src)) - np.repeat(np.cumsum(sizes) - sizes, sizes) + ends[terms][src]
        return src, target[at], weight[at]

    def search(self, texts: list[tuple[int, str]]) -> list[tuple[int, int, float, float, float]]:
        """(doc_id, item_id, score, question overlap, answer overlap) of verified items."""
        if not self.ids:
            return []
        get = self.term.get
        docs = [words_of(t) for _, t in texts]
        size = np.array([len(d) for d in docs], np.int64)
        code = np.fromiter(chain.from_iterable(map(get, d, repeat(-1)) for d in docs), np.int64, int(size.sum()))
        tiles = -(-size // self.longest)
        first_tile = np.cumsum(tiles + 1) - tiles - 1  # an empty tile parts the texts
        owner = np.repeat(np.arange(len(docs)), size)
        inside = np.arange(len(code)) - np.repeat(np.cumsum(size) - size, size)
        tile = first_tile[owner] + inside // self.longest
        hit = np.flatnonzero((code >= 0) & self.is_essential[code])
        if not len(hit):
            return []
        pairs = np.unique(tile[hit] * len(self.term) + code[hit])
        tile_e, term_e = pairs // len(self.term), pairs % len(self.term)
        blocks = self._passages(self.maxima, tile_e, term_e, self.blocks, self.block_rest)
        if not len(blocks):
            return []
        near = np.zeros(int(first_tile[-1] + tiles[-1]) + 2, bool)
        start = np.unique(blocks // self.blocks)
        near[start] = near[start + 1] = True
        live = near[tile_e]
        items = self._passages(self.essential, tile_e[live], term_e[live], len(self.ids), self.rest)
        # the item's block must have been left as well; its own bound is the tighter one
        at_tile, at_item = items // len(self.ids), items % len(self.ids)
        found: dict[tuple[int, int], float] = {}
        doc_of = np.searchsorted(first_tile, at_tile, side="right") - 1
        starts = np.cumsum(size) - size
        cache: dict[tuple[int, int], np.ndarray] = {}
        for t, i, d in zip(at_tile.tolist(), at_item.tolist(), doc_of.tolist(), strict=True):
            k = t - int(first_tile[d])
            one = slice(self.ends[i], self.ends[i + 1])
            for first in (k - 1, k):  # what isn't essential may also stand in the tile before
                if first < 0:
                    continue
                if (d, first) not in cache:
                    at = int(starts[d])
                    words = code[at + first * self.longest : at + min(int(size[d]), (first + 2) * self.longest)]
                    cache[d, first] = np.unique(words[words >= 0])
                here = cache[d, first]
                have = here[np.minimum(np.searchsorted(here, self.terms[one]), len(here) - 1)] == self.terms[one] if len(here) else np.zeros(0, bool)
                score = math.fsum(self.shares[one][have].tolist()) if len(here) else 0.0
                if score >= self.threshold and score > found.get((d, i), 0.0):
                    found[d, i] = score
        out = []
        seen: dict[int, np.ndarray] = {}
        for (d, i), score in found.items():
            n, (question, answer) = self.runs[i], self.parts[i]
            if (d, n) not in seen:
                seen[d, n] = shingle_hashes(docs[d], n)
            share = lambda part: len(np.intersect1d(part, seen[d, n], assume_unique=True)) / len(part)  # noqa: B023, E731
            q = share(question)
            out.append((texts[d][0], self.ids[i], score, q, q if answer is None else share(answer)))
        return out

    def _passages(self, flat, tile: np.ndarray, term: np.ndarray, width: int, rest: np.ndarray) -> np.ndarray:
        """(tile * width + target) where the tile and the one after it can reach the threshold."""
        src, target, weight = self._expand(flat, term)
        key, where = np.unique(tile[src] * width + target, return_inverse=True)
        mass = np.bincount(where, weight, minlength=len(key))
        nxt = np.searchsorted(key, key + width)
        nxt = np.minimum(nxt, len(key) - 1)
        after = np.where(key[nxt] == key + width, mass[nxt], 0.0) if len(key) else mass
        return key[mass + after + rest[key % width] >= self.threshold - 1e-9]


def _chunk_stats(items: DataFrame, chunk: Column, chunks: int) -> list[ItemStats]:
    """Counts over all items, for each chunk with the words of its own items only."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bags = [sum(parts_of(t), []) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("chunk"), pa.array(list(map(len, bags)), pa.int64()), pa.array([sorted(set(x)) for x in bags], pa.list_(pa.string()))], ["chunk", "size", "words"])

    bags = stored(items.select(chunk.alias("chunk"), "text").mapInArrow(run, "chunk long, size long, words array<string>").where("size > 0"), "item-words")
    words = bags.select("chunk", F.explode("words").alias("word"))
    df = stored(words.groupBy("word").agg(F.count(F.lit(1)).alias("df")), "item-df")
    n, total, longest = bags.agg(F.count(F.lit(1)), F.sum("size"), F.max("size")).first()
    out = []
    for c in range(chunks):
        own = words.where(F.col("chunk") == c).select("word").distinct().join(df, "word").toArrow()
        out.append(ItemStats(n, total or 0, longest or 1, dict(zip(own["word"].to_pylist(), own["df"].to_pylist(), strict=True))))
    return out


def find_leaks(docs: DataFrame, benchmark: DataFrame, threshold: float = 0.5, overlap: float = 0.8, index_bytes: int = 8 << 20, key: str = "doc_id") -> DataFrame:
    """doc_id, item_id, score, question_overlap, answer_overlap: all verified items of all texts."""
    spark = docs.sparkSession
    items = benchmark.where("item_id is not null and text is not null and text <> ''").select(F.col("item_id").cast("long").alias("item_id"), "text")
    sizes = items.select("item_id", F.octet_length("text").cast("long").alias("n"))
    total = sizes.agg(F.sum("n")).first()[0] or 0
    texts = docs.where(F.col(key).isNotNull() & F.col("text").isNotNull()).select(F.col(key).cast("long").alias("doc_id"), "text")
    chunks = max(1, -(-total // index_bytes))
    chunk = F.pmod(F.xxhash64("item_id", "text"), F.lit(chunks))
    stats = [None] if chunks == 1 else _chunk_stats(items, chunk, chunks)
    parts = []
    for c in range(chunks):
        mine = items if chunks == 1 else items.where(chunk == c)
        index = ItemIndex([(r["item_id"], r["text"]) for r in mine.collect()], threshold, stats[c])
        shared = spark.sparkContext.broadcast(index)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for lo in range(0, batch.num_rows, 200):
                    some = batch.slice(lo, 200)
                    rows = shared.value.search(list(zip(some.column("doc_id").to_pylist(), some.column("text").to_pylist(), strict=True)))
                    rows = [r for r in rows if r[3] >= overlap and r[4] >= overlap]
                    yield pa.RecordBatch.from_arrays([pa.array([r[j] for r in rows], pa.int64() if j < 2 else pa.float64()) for j in range(5)], ["doc_id", "item_id", "score", "question_overlap", "answer_overlap"])

        parts.append(texts.mapInArrow(run, FOUND))
    found = parts[0]
    for p in parts[1:]:
        found = found.unionByName(p)
    return found


def without_leaks(docs: DataFrame, benchmark: DataFrame, **how) -> DataFrame:
    """The rows of ``docs`` in whose text no item is verified, with all their columns.

    The decision is one of the text alone, so it is joined back by the text's 64-bit hash, which
    is the same whenever a lost part is computed again. Null texts and null ids stay.
    """
    hashed, free = F.xxhash64("text"), "_" * (1 + max(map(len, docs.columns)))
    found = find_leaks(docs.select(hashed.alias("h"), "text"), benchmark, key="h", **how)
    bad = checkpoint(found.select(F.col("doc_id").alias(free)).distinct())
    return docs.withColumn(free, hashed).join(bad, free, "left_anti").select(docs.columns)
