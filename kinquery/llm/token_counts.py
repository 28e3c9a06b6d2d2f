"""Token counts from an exact length histogram.

Documents are encoded once and added up by length: one row a length that occurs, which no group of
documents can inflate. Suffix sums over the histogram answer, for every length as a context limit,
how many documents reach past it, the tokens of all that fit, and the tokens left when every
document is cut there. Suffix sums are taken inside blocks of 256 lengths and over one row a
block, so no task holds more than a block or the list of blocks.

Null and empty texts have length 0. Repeated rows count each. An empty table has no lengths.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

BLOCK = 256


def token_lengths(docs: DataFrame, tokenizer_file: str, keep: list[str] | None = None, text: str = "text") -> DataFrame:
    """The columns in ``keep`` and n_tokens, a row a document."""
    keep = keep or []
    schema = docs.select(*keep).schema if keep else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from kinquery.llm.bpe_text import encoder

        enc = encoder(tokenizer_file)
        for batch in batches:
            for lo in range(0, batch.num_rows, 5000):
                some = batch.slice(lo, 5000)
                sizes = np.array([len(x) // 4 for x in enc.encode(some.column("__text"))], np.int64)
                yield pa.RecordBatch.from_arrays([*(some.column(k) for k in keep), pa.array(sizes)], [*keep, "n_tokens"])

    from pyspark.sql import types as T

    out = T.StructType([*(schema.fields if schema else []), T.StructField("n_tokens", T.LongType())])
    return docs.select(*keep, F.col(text).alias("__text")).mapInArrow(run, out)


def length_histogram(lengths: DataFrame) -> DataFrame:
    """n_tokens, n_docs: exact counts by length."""
    return lengths.groupBy("n_tokens").agg(F.count(F.lit(1)).alias("n_docs"))


def context_limits(histogram: DataFrame) -> DataFrame:
    """A row a length that occurs, as a context limit.

    context_limit, n_docs (of just that length), docs_over (longer ones), docs_total, tokens_within
    (all tokens of documents that fit), tokens_truncated (all tokens when every document is cut at
    the limit), tokens_total, share_within (the quantile of documents that the limit is).
    """
    block = F.floor(F.col("n_tokens") / BLOCK)
    h = histogram.select("n_tokens", "n_docs", (F.col("n_tokens") * F.col("n_docs")).alias("tokens"), block.alias("block"))
    blocks = h.groupBy("block").agg(F.sum("n_docs").alias("bd"), F.sum("tokens").alias("bt"))
    later = W.orderBy(F.col("block").desc()).rowsBetween(W.unboundedPreceding, -1)
    blocks = blocks.select("block", F.coalesce(F.sum("bd").over(later), F.lit(0)).alias("docs_later"), F.coalesce(F.sum("bt").over(later), F.lit(0)).alias("tokens_later"), F.sum("bd").over(W.partitionBy()).alias("docs_total"), F.sum("bt").over(W.partitionBy()).alias("tokens_total"))
    above = W.partitionBy("block").orderBy(F.col("n_tokens").desc()).rowsBetween(W.unboundedPreceding, -1)
    inside = h.select("*", F.coalesce(F.sum("n_docs").over(above), F.lit(0)).alias("da"), F.coalesce(F.sum("tokens").over(above), F.lit(0)).alias("ta"))
    over, tokens_over = F.col("da") + F.col("docs_later"), F.col("ta") + F.col("tokens_later")
    within = F.col("tokens_total") - tokens_over
    return inside.join(blocks, "block").select(
        F.col("n_tokens").alias("context_limit"),
        "n_docs",
        over.alias("docs_over"),
        "docs_total",
        within.alias("tokens_within"),
        (within + over * F.col("n_tokens")).alias("tokens_truncated"),
        "tokens_total",
        F.round((F.col("docs_total") - over) / F.col("docs_total"), 9).alias("share_within"),
    )


def quantile(limits: DataFrame, q: float) -> int | None:
    """The smallest length that at least the share ``q`` of documents doesn't pass; None without documents."""
    found = limits.where((F.col("docs_total") - F.col("docs_over")) >= F.lit(q) * F.col("docs_total")).agg(F.min("context_limit")).first()
    return found[0]
