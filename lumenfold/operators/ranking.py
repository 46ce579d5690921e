"""Top-k, limits, distinct, counts and evidence lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lumenfold.functions.text import split_sentences

RANK_SALTS = 64


def explode_sentences(df: DataFrame, column: str, *keep: str) -> DataFrame:
    return df.select(*keep, F.posexplode(split_sentences(column)).alias("pos", "sentence"))


def explode_zip(df: DataFrame, left: str, right: str, *keep: str) -> DataFrame:
    """Element i of one list next to element i of the other, one row each."""
    return df.select(*keep, F.inline(F.arrays_zip(left, right)))


def limit_first(df: DataFrame, n: int | str, *tie: str) -> DataFrame:
    """First n items of the feed, newest first; n may come as text from a form."""
    return df.orderBy(F.desc("created"), *tie).limit(int(n))


def latest_then_ascending(df: DataFrame, n: int | str) -> DataFrame:
    """First n messages of the feed, then in time order."""
    latest = df.orderBy(F.desc("ts"), F.desc("tweet_id")).limit(int(n))
    return latest.orderBy("ts", "tweet_id")


def topk(
    df: DataFrame,
    k: int,
    order: list[Column],
    group: list[str] | tuple[str, ...] = ("facet",),
    rank: str = "rk",
    salted: bool = True,
) -> DataFrame:
    """Exact top k rows per group, also when a group holds most of the rows.

    Every task first keeps its own k best rows per group. These meet in
    ``RANK_SALTS`` tasks per group, which keep k rows each; only those are
    ranked together. The salt is the task's number, so it adds no rows, and the
    result does not depend on it. Without ``salted``, for groups that are small
    by construction, the rows meet at once.
    """
    whole = W.partitionBy(*group).orderBy(*order)
    if not salted:
        return df.withColumn(rank, F.row_number().over(whole)).filter(F.col(rank) <= k)
    spread = df.withColumn("_salt", F.spark_partition_id() % RANK_SALTS)
    part = W.partitionBy(*group, "_salt").orderBy(*order)
    best = (
        spread.withColumn("_part_rank", F.row_number().over(part))
        .filter(F.col("_part_rank") <= k)
        .drop("_part_rank", "_salt")
    )
    return best.withColumn(rank, F.row_number().over(whole)).filter(F.col(rank) <= k)


def distinct_texts(df: DataFrame, column: str) -> DataFrame:
    """Each text once. Copies collapse in every task before the shuffle."""
    return df.select(column).distinct()


def value_counts(df: DataFrame, column: str) -> DataFrame:
    return (
        df.groupBy(column)
        .agg(F.count(F.lit(1)).alias("n"))
        .orderBy(F.desc("n"), column)
    )


def evidence_lists(ranked: DataFrame, text: str) -> DataFrame:
    """Ranked rows → (facet, evidence list in rank order); k bounds each list."""
    pairs = F.array_sort(F.collect_list(F.struct("rk", F.col(text).alias("text"))))
    return ranked.groupBy("facet").agg(
        F.transform(pairs, lambda p: p["text"]).alias("evidence")
    )


def union_batches(*batches: DataFrame) -> DataFrame:
    """Row concatenation by name; columns a batch lacks become NULL."""
    whole, *rest = batches
    for batch in rest:
        whole = whole.unionByName(batch, allowMissingColumns=True)
    return whole
