"""Language identification: multinomial naive Bayes over hashed character n-grams.

A text is lower-cased, every run of non-letters becomes one space, and n-grams of one to three
characters are hashed into ``buckets``. Learning adds up counts by language and bucket; what it
returns has one row of buckets a language and is broadcast. A matrix of more than ``most_cells``
cells (64 MB: 256 languages of 65,536 buckets) is an error; fewer buckets or more cells are the caller's choice.
Prediction sums the log-probabilities of a batch's n-grams in numpy, a run of positions a text. Texts
are read some million bytes at a time, longer ones in windows whose sums add up.

Learning takes at most about ``per_lang`` documents a language (all, where there are fewer), picked
by a hash of the id; that is the one bound here, everything else reads all rows and whole texts.
Null texts and texts without a letter are ``und`` with score 0, as is everything if nothing could
be learned. Null languages and null ids aren't learned from. The score is the posterior
probability of the language predicted; ties go to the language that sorts first.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinquery.llm.batches import slices

UND = "und"
#: Characters of a text that is read in windows, and bytes of the texts read together (some 80 bytes a character in work).
LONG, TOGETHER = 500_000, 1_000_000
_TABLE: np.ndarray | None = None


def _letters() -> np.ndarray:
    """By code point: 0 for what isn't a letter, else the lower-case letter's code point."""
    global _TABLE
    if _TABLE is None:
        found = np.zeros(sys.maxunicode + 1, np.uint32)
        for i in range(sys.maxunicode + 1):
            c = chr(i)
            if c.isalpha():
                low = c.lower()
                found[i] = ord(low) if len(low) == 1 else i
        _TABLE = found
    return _TABLE


def _grams(c: np.ndarray, p1: np.ndarray, p2: np.ndarray, buckets: int) -> list[np.ndarray]:
    """Buckets of the n-grams of one, two and three that end at letters ``c`` after ``p1`` and ``p2``."""
    mask = np.uint32(buckets - 1)
    one = (c * np.uint32(0x9E3779B1)) >> np.uint32(7)
    two = ((c * np.uint32(0x85EBCA77)) ^ (p1 * np.uint32(0xC2B2AE3D) + np.uint32(1))) * np.uint32(0x27D4EB2F)
    three = ((two ^ (p2 * np.uint32(0x165667B1) + np.uint32(2))) * np.uint32(0x9E3779B1)) >> np.uint32(9)
    return [one & mask, (two >> np.uint32(11)) & mask, three & mask]


def features(texts: list[str | None], buckets: int) -> tuple[list[np.ndarray], np.ndarray]:
    """The bucket of each n-gram, an array an order, and where each text's characters start and end.

    All arrays have one entry a character: the n-gram that ends there. Every text begins with a
    space, and n-grams never reach into the text before, so a text's are the same in any batch.
    """
    joined = "".join(["\n" + (t or "") for t in texts]).encode("utf-32-le", "surrogatepass")
    c = _letters()[np.frombuffer(joined, np.uint32)]
    lengths = np.array([len(t or "") for t in texts], np.int64) + 1
    first = np.cumsum(lengths) - lengths
    keep = (c != 0) | np.concatenate([[True], c[:-1] != 0])[: len(c)]  # one space for each run of others
    keep[first] = True
    bounds = np.concatenate([[0], np.cumsum(keep)])[np.append(first, len(c))]
    c = c[keep]
    p1 = np.concatenate([np.zeros(1, np.uint32), c])[: len(c)]
    p2 = np.concatenate([np.zeros(2, np.uint32), c])[: len(c)]
    heads = bounds[:-1]
    p1[heads] = p2[heads] = 0
    p2[np.minimum(heads + 1, len(c) - 1)] = 0
    return _grams(c, p1, p2, buckets), bounds


def windows(text: str, buckets: int, size: int = 1 << 18) -> Iterator[list[np.ndarray]]:
    """The n-grams ``features`` finds in one text, by windows of ``size`` characters.

    The last two letters and whether the last character was none go on to the next window.
    """
    tail, after_letter = np.zeros(2, np.uint32), True
    for lo in range(0, len(text) + 1, size):
        part = ("\n" if lo == 0 else "") + text[max(0, lo - 1) : lo + size - 1]
        c = _letters()[np.frombuffer(part.encode("utf-32-le", "surrogatepass"), np.uint32)]
        keep = (c != 0) | np.concatenate([[after_letter], c[:-1] != 0])[: len(c)]
        after_letter = bool(c[-1])
        c = np.concatenate([tail, c[keep]])
        tail = c[-2:]
        yield _grams(c[2:], c[1:-1], c[:-2], buckets)


@dataclass
class LanguageModel:
    """langs in order; log_prob[lang, bucket]; log_prior[lang]."""

    langs: list[str]
    log_prob: np.ndarray
    log_prior: np.ndarray
    buckets: int

    def scores(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Log-scores by text and language, and whether the text has a letter."""
        n = len(texts)
        lettered = np.array([bool(t) and any(map(str.isalpha, t)) for t in texts], bool)
        out = np.tile(self.log_prior, (n, 1))
        if n == 1 and texts[0] and len(texts[0]) > LONG:
            for grams in windows(texts[0], self.buckets):
                for k, row in enumerate(self.log_prob):
                    out[0, k] += sum(row[g].sum(dtype=np.float64) for g in grams)
            return out, lettered
        grams, bounds = features(texts, self.buckets)
        full = np.flatnonzero(np.diff(bounds) > 0)
        if len(full):
            starts, end = bounds[:-1][full], bounds[-1]
            for k in range(len(self.langs)):
                row = self.log_prob[k]
                total = row[grams[0][:end]]
                for g in grams[1:]:
                    total = total + row[g[:end]]
                out[full, k] += np.add.reduceat(total, starts, dtype=np.float64)
        return out, lettered

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        if not self.langs:
            return [UND] * len(texts), np.zeros(len(texts))
        scores, lettered = self.scores(texts)
        best = scores.argmax(axis=1)
        top = scores[np.arange(len(texts)), best]
        post = 1.0 / np.exp(scores - top[:, None]).sum(axis=1)
        return [self.langs[b] if ok else UND for b, ok in zip(best.tolist(), lettered.tolist(), strict=True)], np.where(lettered, post, 0.0)


def _together(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Slices of about ``TOGETHER`` bytes; a text of more than ``LONG`` characters is one of its own."""
    for some in slices(batch, "text", TOGETHER, 250):
        sizes = pc.fill_null(pc.utf8_length(some.column("text")), 0).to_numpy(zero_copy_only=False)
        lo = 0
        for at in np.flatnonzero(sizes > LONG).tolist():
            if at > lo:
                yield some.slice(lo, at - lo)
            yield some.slice(at, 1)
            lo = at + 1
        if lo < some.num_rows:
            yield some.slice(lo)


def learn(docs: DataFrame, usable: Column, buckets: int = 1 << 16, per_lang: int = 10_000, alpha: float = 0.5, most_cells: int = 1 << 24) -> LanguageModel:
    """Learn from text and lang of the rows where ``usable`` holds."""
    rows = docs.where(usable & F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("string").alias("key"), "lang", "text")
    sizes = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}
    langs = sorted(sizes)
    if len(langs) * buckets > most_cells:
        raise ValueError(f"{len(langs)} languages of {buckets} buckets are more than {most_cells} cells: choose fewer buckets or allow more cells")
    if not langs:
        return LanguageModel([], np.zeros((0, buckets)), np.zeros(0), buckets)
    large = {k: per_lang / n for k, n in sizes.items() if n > per_lang}  # a few at most
    share = F.element_at(F.create_map(*(F.lit(x) for k, s in large.items() for x in (k, s))), F.col("lang")) if large else F.lit(1.0)
    picked = rows.where(F.pmod(F.xxhash64(F.lit("sample"), "key"), F.lit(1 << 20)) < F.coalesce(share, F.lit(1.0)) * F.lit(1 << 20)).select("lang", "text")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(langs), buckets), np.int64)
        place = {k: i for i, k in enumerate(langs)}
        for batch in (s for b in batches for s in _together(b)):
            by: dict[str, list[str]] = {}
            for k, t in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist(), strict=True):
                by.setdefault(k, []).append(t)
            for k, texts in by.items():
                for grams in windows(texts[0], buckets) if len(texts) == 1 and len(texts[0]) > LONG else [features(texts, buckets)[0]]:
                    for g in grams:
                        total[place[k]] += np.bincount(g, minlength=buckets)
        k, b = np.nonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(k.astype(np.int32)), pa.array(b.astype(np.int32)), pa.array(total[k, b])], ["k", "b", "n"])

    found = picked.mapInArrow(count, "k int, b int, n long").groupBy("k", "b").agg(F.sum("n").alias("n")).toArrow()
    counts = np.zeros((len(langs), buckets))
    counts[found["k"].to_numpy(), found["b"].to_numpy()] = found["n"].to_numpy()
    log_prob = np.log(counts + alpha) - np.log(counts.sum(axis=1, keepdims=True) + alpha * buckets)
    prior = np.array([sizes[k] for k in langs], float)
    return LanguageModel(langs, log_prob.astype(np.float32), np.log(prior / prior.sum()), buckets)


def predict(docs: DataFrame, model: LanguageModel, names: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """All columns of ``docs``, and the language predicted from ``text`` with its score.

    Columns that have one of ``names`` already are replaced.
    """
    docs = docs.drop(*names)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    from pyspark.sql import types as T

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for some in _together(batch):
                langs, score = shared.value.predict(some.column("text").to_pylist())
                yield some.append_column(names[0], pa.array(langs, pa.string())).append_column(names[1], pa.array(score))

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(names[0], T.StringType()), T.StructField(names[1], T.DoubleType())]))


def held_out(doc_id: Column) -> Column:
    """Whether crc32 of the id as text leaves 2 when divided by 4 (null id: no)."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))
