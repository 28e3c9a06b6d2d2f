"""A corpus pipeline: language ID, SimHash near-dedup, benchmark decontamination, SentencePiece.

Each stage takes (spark, docs, sf_dir) and gives a DataFrame, which is written as Parquet in the
shared folder and read again as the next stage's documents. All but the last keep the columns of
documents. Stages work on all rows their predecessor kept, whatever their ids, and on whole texts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinquery.llm.decontaminate import without_leaks
from kinquery.llm.language import UND, held_out, learn, predict
from kinquery.llm.piece_codec import encode_documents
from kinquery.llm.registry import tokenizer_path
from kinquery.llm.simhash import one_of_each
from kinquery.runtime import drop_scratch, scratch_mark, stored, table


#: A document whose likeliest language has less than this probability counts as of no language.
MIN_LANGUAGE_SCORE = 0.5


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can be told, with that language where ``lang`` is null.

    Those without a text or a letter go, and those whose likeliest language has a probability below
    ``MIN_LANGUAGE_SCORE``. A language that is given stays. Repeated rows are kept. The two columns added for the
    decision have names that no column of the table has, and go again. A table with a column of such
    a name keeps its own.
    """
    free = "_" * (1 + max(map(len, docs.columns)))
    names = (f"{free}lang", f"{free}score")
    model = learn(docs, ~held_out(F.col("doc_id")))
    told = predict(docs, model, names).where((F.col(names[0]) != UND) & (F.col(names[1]) >= MIN_LANGUAGE_SCORE))
    return told.withColumn("lang", F.coalesce("lang", names[0])).select(docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group the document with the smallest id.

    A group is linked by fingerprints at two or fewer bits, and by five-word shingle sets of a
    similarity of 0.8 or more.
    """
    return one_of_each(docs, similarity=0.8)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no benchmark item stands. Null texts stay; repeated rows stay or go together."""
    return without_leaks(docs, table(spark, sf_dir, "benchmark"))


def pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, the piece ids of the text, how many there are, and the text decoded from them.

    A null text has no ids and an empty decoded text. Repeated rows stay; other columns are left out.
    """
    both = encode_documents(docs.select("doc_id", "text"), tokenizer_path("piece_bpe_32k.model"), decoded="decoded")
    return both.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids", "decoded")


STAGES = [("language_id", language_id), ("near_dedup", near_dedup), ("decontaminate", decontaminate), ("pieces", pieces)]

#: No stage but the third could be written in SQL (XXH64 fingerprints, a learned model, pieces).
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, mark = table(spark, sf_dir, "documents"), scratch_mark()
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
        drop_scratch(spark, mark, (docs,))  # what the stage read and wrote on its way
    return docs
