"""Landed files → articles, posts, tweets, lookups.

The parsing halves (``*_from_json``) work on any text column, so the same code
serves a batch read, a streaming read and a column of a table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenfold import schemas
from lumenfold.fixed import palette_rows
from lumenfold.functions.text import col, default_empty


MAX_SPREAD = 64


def load(spark: SparkSession, folder: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{table}.parquet")


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Hash an input over the cores if its scan has fewer splits than cores.

    Fewer splits than ``MAX_SPREAD`` bounds the input by as many splits, so this
    shuffle stays small on a cluster of any size. A larger input is left alone.
    """
    cores = min(df.sparkSession.sparkContext.defaultParallelism, MAX_SPREAD)
    return df.repartition(cores, *keys) if df.rdd.getNumPartitions() < cores else df


def _parsed(column: Column | str, schema) -> Column:
    """JSON text as a struct; malformed text is an error, never a row of NULLs."""
    return F.from_json(col(column), schema, {"mode": "FAILFAST"})


def articles_from_json(pages: DataFrame, column: Column | str = "value") -> DataFrame:
    """One search page per row → one article per row."""
    page = _parsed(column, schemas.ARTICLE_PAGE)
    return pages.select(page.alias("p")).select(F.inline("p.articles"))


def read_articles(spark: SparkSession, path: str, fmt: str = "pages") -> DataFrame:
    """Articles below ``path``; the scan of many files is the union of the pages.

    ``fmt`` is ``pages`` (JSON search pages), ``json`` (one article per line) or
    ``parquet``.
    """
    if fmt == "pages":
        pages = spark.read.schema(schemas.ARTICLE_PAGE).json(path)
        return pages.select(F.inline("articles"))
    return spark.read.schema(schemas.ARTICLE).format(fmt).load(path)


def posts_from_json(items: DataFrame, column: Column | str = "value") -> DataFrame:
    """One forum item per row → the eight post columns.

    A missing body or parent becomes ''. A row without a url keeps its NULL and
    is dropped by ``require_url`` before any limit is counted.
    """
    item = _parsed(column, schemas.POST_ITEM)
    return items.select(item.alias("i")).select(
        F.col("i._type").alias("type"),
        F.col("i.author").alias("author"),
        default_empty("i.body").alias("body"),
        F.col("i.created").cast("timestamp_ntz").alias("created"),
        F.col("i.id").alias("id"),
        default_empty("i.parentId").alias("parent_id"),
        F.col("i.subreddit").alias("subreddit"),
        F.col("i.url").alias("url"),
    )


def read_posts(spark: SparkSession, path: str) -> DataFrame:
    return posts_from_json(spark.read.text(path).filter("trim(value) <> ''"))


def tweets_from_json(items: DataFrame, column: Column | str = "value") -> DataFrame:
    """One message object per row; the name comes from the nested user."""
    item = _parsed(column, schemas.TWEET_ITEM)
    return items.select(item.alias("i")).select(
        F.col("i.date").cast("timestamp_ntz").alias("ts"),
        F.col("i.id").alias("tweet_id"),
        F.col("i.content").alias("text"),
        F.col("i.user.username").alias("username"),
        F.col("i.is_retweet").alias("is_retweet"),
        F.col("i.is_reply").alias("is_reply"),
    )


def read_tweets(spark: SparkSession, path: str) -> DataFrame:
    return tweets_from_json(spark.read.text(path).filter("trim(value) <> ''"))


def read_emotion_palette(spark: SparkSession, path: str) -> DataFrame:
    """CSV of emotion → colour; the explicit schema names a blank header cell."""
    return spark.read.csv(path, header=True, schema=schemas.PALETTE, enforceSchema=True)


def default_palette(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(palette_rows(), schemas.PALETTE)


def unpivot_similarity(wide: DataFrame, id_column: str) -> DataFrame:
    """Wide outlet matrix → (src_a, src_b, sim)."""
    def named(c: str) -> Column:  # outlet names hold dots
        return F.col("`" + c.replace("`", "``") + "`")

    others = [c for c in wide.columns if c != id_column]
    return wide.select(
        named(id_column).cast("string").alias("src_a"),
        *[named(c).cast("double").alias(c) for c in others],
    ).unpivot("src_a", [named(c) for c in others], "src_b", "sim")


def read_similarity(spark: SparkSession, path: str) -> DataFrame:
    """CSV matrix whose first column names the row's outlet."""
    wide = spark.read.csv(path, header=True)
    return unpivot_similarity(wide, wide.columns[0])
