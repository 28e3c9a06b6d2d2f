"""Token ids as binary segments (Simple-8b), written in document order and read back.

Documents are dealt by ranges of ``doc_id`` and sorted inside a range, so the files hold them in
ascending order (equal ids: by text; null ids first). Each task packs whole documents into
segments of about ``segment_ids`` ids. Segments are stored as binary values of a Parquet table:
Spark's writer commits them as a whole, so a lost executor leaves no half file, and they can lie
in any store Spark reaches. A null or empty text has the end id only. Extra columns are ignored.
An empty table gives an empty store.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SEGMENTS = "part int, seq int, n_docs long, n_ids long, blob binary"


def write_tokens(docs: DataFrame, path: str, tokenizer_file: str, end_id: int, segment_ids: int = 1_000_000) -> None:
    """Encode ``docs(doc_id, text)`` and write the segments to ``path``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        from kinquery.llm.bpe_text import encoder
        from kinquery.llm.simple8b import pack

        enc, part, seq = encoder(tokenizer_file), TaskContext.get().partitionId(), 0
        end = np.array([end_id], dtype="<u4").tobytes()
        keys: list[int | None] = []
        parts: list[bytes] = []
        held = 0

        def flush() -> pa.RecordBatch:
            nonlocal keys, parts, held, seq
            lengths = np.array([len(p) // 4 for p in parts])
            blob = pack(keys, lengths, np.frombuffer(b"".join(parts), dtype="<u4"))
            found = pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([seq], pa.int32()), pa.array([len(keys)]), pa.array([int(lengths.sum())]), pa.array([blob], pa.binary())], ["part", "seq", "n_docs", "n_ids", "blob"])
            keys, parts, held, seq = [], [], 0, seq + 1
            return found

        for batch in batches:
            for lo in range(0, batch.num_rows, 5000):
                some = batch.slice(lo, 5000)
                for key, ids in zip(some.column("doc_id").to_pylist(), enc.encode(some.column("text")), strict=True):
                    keys.append(key)
                    parts.append(ids + end)
                    held += len(ids) // 4 + 1
                    if held >= segment_ids:
                        yield flush()
        if keys:
            yield flush()

    # rows of one id, or without one, are told apart by their text's hash, so they don't all meet in one task
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("h"))
    dealt = keyed.repartitionByRange("doc_id", "h").sortWithinPartitions("doc_id", "h", "text").select("doc_id", "text")
    dealt.mapInArrow(run, SEGMENTS).write.option("compression", "none").parquet(path)


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """The stored documents in order: part, seq, pos, doc_id, before (ids of the same segment), ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from kinquery.llm.simple8b import unpack

        for batch in batches:
            for part, seq, blob in zip(*(batch.column(c).to_pylist() for c in ("part", "seq", "blob")), strict=True):
                doc_ids, lengths, ids = unpack(blob)
                ends = np.cumsum(lengths, dtype=np.int64)
                offsets = np.concatenate([[0], ends])
                n = len(doc_ids)
                for lo in range(0, n, 500):
                    hi = min(n, lo + 500)
                    a, b = int(offsets[lo]), int(offsets[hi])
                    lists = pa.ListArray.from_arrays(pa.array(offsets[lo : hi + 1] - a, pa.int32()), pa.array(ids[a:b].astype(np.int64)))
                    yield pa.RecordBatch.from_arrays([pa.array([part] * (hi - lo), pa.int32()), pa.array([seq] * (hi - lo), pa.int32()), pa.array(range(lo, hi), pa.int32()), pa.array(doc_ids[lo:hi], pa.int64()), pa.array(offsets[lo:hi]), lists], ["part", "seq", "pos", "doc_id", "before", "ids"])

    stored = spark.read.parquet(path).select("part", "seq", "blob")
    return stored.mapInArrow(run, "part int, seq int, pos int, doc_id long, before long, ids array<long>")


def token_digests(spark: SparkSession, path: str) -> DataFrame:
    """Per stored document: its place in the whole stream, its length and the CRC-32 of its ids.

    The starts of segments are running sums over one row a segment inside its file, and over one
    row a file; only per-file totals meet in one task.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from kinquery.llm.simple8b import unpack

        for batch in batches:
            for part, seq, blob in zip(*(batch.column(c).to_pylist() for c in ("part", "seq", "blob")), strict=True):
                doc_ids, lengths, ids = unpack(blob)
                ends = np.cumsum(lengths, dtype=np.int64)
                raw = memoryview(ids.astype("<u4").tobytes())
                crcs = [zlib.crc32(raw[4 * (e - n) : 4 * e]) for e, n in zip(ends.tolist(), lengths.tolist(), strict=True)]
                k = len(doc_ids)
                yield pa.RecordBatch.from_arrays([pa.array([part] * k, pa.int32()), pa.array([seq] * k, pa.int32()), pa.array(doc_ids, pa.int64()), pa.array(ends - lengths), pa.array(lengths.astype(np.int64)), pa.array(crcs, pa.int64())], ["part", "seq", "doc_id", "before", "n_tokens", "ids_crc32"])

    from pyspark.sql import Window as W

    stored = spark.read.parquet(path)
    heads = stored.select("part", "seq", "n_ids")
    files = heads.groupBy("part").agg(F.sum("n_ids").alias("n")).withColumn("file_start", F.sum("n").over(W.orderBy("part")) - F.col("n")).select("part", "file_start")
    inside = heads.withColumn("inside", F.sum("n_ids").over(W.partitionBy("part").orderBy("seq")) - F.col("n_ids"))
    starts = inside.join(files, "part").select("part", "seq", (F.col("file_start") + F.col("inside")).alias("segment_start"))
    rows = stored.select("part", "seq", "blob").mapInArrow(run, "part int, seq int, doc_id long, before long, n_tokens long, ids_crc32 long")
    return rows.join(starts, ["part", "seq"]).select("doc_id", (F.col("segment_start") + F.col("before")).alias("start"), "n_tokens", "ids_crc32")
