"""Scoring of prediction files as they arrive."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from kinquery.operators.evaluation import scored, with_questions
from kinquery.sources.records import parse_predictions


def arriving_predictions(spark: SparkSession, folder: str, files_at_once: int = 1000) -> DataFrame:
    """Prediction files of a folder as a stream, a row a file."""
    return spark.readStream.format("text").option("wholetext", True).option("maxFilesPerTrigger", files_at_once).load(folder).withColumn("path", F.url_decode(F.input_file_name()))


def score_arriving(files: DataFrame, qa: DataFrame, put: Callable[[DataFrame, int], None], checkpoint: str, once: bool = False) -> StreamingQuery:
    """Score each batch of files and hand it to ``put(scores, batch number)``.

    Scoring needs no state between batches. A batch that is repeated after a loss has the same
    number, so ``put`` can write it over.
    """

    def run(batch: DataFrame, number: int) -> None:
        put(scored(with_questions(parse_predictions(batch), qa)), number)

    writer = files.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
