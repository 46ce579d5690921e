"""Evidence retrieval: the texts most similar to each facet of a review."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenfold.fixed import PESTLE_K, SWOT_ARTICLES_K, SWOT_POSTS_K, SWOT_TWEETS_K
from lumenfold.functions.text import clean_text, default_empty
from lumenfold.operators.ranking import distinct_texts, explode_sentences, topk
from lumenfold.operators.scoring import score_dense, score_sparse


def clean_sentences(articles: DataFrame) -> DataFrame:
    """(article_id, pos, text): every sentence of every summary, cleaned."""
    return explode_sentences(articles, "summary", "article_id").select(
        "article_id", "pos", clean_text("sentence").alias("text")
    )


def swot_articles(
    articles: DataFrame, seeds: DataFrame, k: int = SWOT_ARTICLES_K
) -> DataFrame:
    """Top k sentences per facet; equal sentences all count.

    One narrow stage from the scan to each task's k best rows per facet.
    """
    scored = score_sparse(
        clean_sentences(articles),
        ["article_id", "pos", "text"],
        "text",
        seeds,
        cleaned=True,
        best=k,
    )
    return topk(scored, k, [F.desc("sim"), F.col("article_id"), F.col("pos")])


def topk_distinct(
    sentences: DataFrame, seeds: DataFrame, k: int, cleaned: bool = True
) -> DataFrame:
    """Top k different texts per facet.

    The similarity depends on the text alone, so copies are removed before the
    encoding, where they also cost nothing to score.
    """
    scored = score_sparse(
        distinct_texts(sentences, "text"), ["text"], "text", seeds, cleaned=cleaned, best=k
    )
    return topk(scored, k, [F.desc("sim"), F.col("text")])


def pestle_articles(
    articles: DataFrame, seeds: DataFrame, k: int = PESTLE_K
) -> DataFrame:
    return topk_distinct(clean_sentences(articles), seeds, k)


def _best_texts(
    table: DataFrame, key: str, text: Column, seeds: DataFrame, k: int, cleaned: bool
) -> DataFrame:
    """Top k whole texts per facet; copies of a text or key all count."""
    texts = table.select(key, text.alias("text"))
    scored = score_sparse(texts, [key, "text"], "text", seeds, cleaned=cleaned, best=k)
    return topk(scored, k, [F.desc("sim"), F.col(key), F.col("text")])


def swot_posts(posts: DataFrame, seeds: DataFrame, k: int = SWOT_POSTS_K) -> DataFrame:
    """Top k posts per facet, on the body as it is."""
    return _best_texts(posts, "id", default_empty("body"), seeds, k, cleaned=False)


def swot_tweets(
    tweets: DataFrame, seeds: DataFrame, k: int = SWOT_TWEETS_K
) -> DataFrame:
    """Top k messages per facet, on the cleaned text."""
    return _best_texts(
        tweets, "tweet_id", clean_text("text"), seeds, k, cleaned=True
    )


def dense_evidence(
    df: DataFrame, key: str, vector: str, facets: DataFrame, k: int
) -> DataFrame:
    """Top k rows per facet by the cosine of dense vectors."""
    return topk(score_dense(df, [key], vector, facets, best=k), k, [F.desc("sim"), F.col(key)])
