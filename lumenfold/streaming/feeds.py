"""Feeds that keep landing files, read as streams by the batch parsers.

Parsing, row filters and cleaning keep no state between rows, so the batch
functions apply as they are and no watermark is needed.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming.query import StreamingQuery

from lumenfold.sources.readers import posts_from_json, tweets_from_json


def _landed(spark: SparkSession, folder: str, files: int | None) -> DataFrame:
    reader = spark.readStream if files is None else spark.readStream.option("maxFilesPerTrigger", files)
    return reader.text(folder)


def stream_posts(spark: SparkSession, folder: str, files: int | None = None) -> DataFrame:
    """``files`` bounds the files of one micro-batch."""
    return posts_from_json(_landed(spark, folder, files))


def stream_tweets(spark: SparkSession, folder: str, files: int | None = None) -> DataFrame:
    return tweets_from_json(_landed(spark, folder, files))


def land(
    feed: DataFrame,
    path: str,
    state: str,
    step: Callable[[DataFrame], DataFrame] = lambda df: df,
) -> StreamingQuery:
    """Append what has landed since the last run to a parquet table, then stop.

    ``state`` is the query's own checkpoint folder on shared storage: a restart
    goes on where the last run ended.
    """
    return (
        step(feed)
        .writeStream.format("parquet")
        .option("path", path)
        .option("checkpointLocation", state)
        .trigger(availableNow=True)
        .start()
    )
