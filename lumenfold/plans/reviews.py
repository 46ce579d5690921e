"""Whole requests: from the search form to the report with its evidence.

filter → seed paragraphs from the completion function → evidence → prompt → report.
The evidence comes back beside the report, one list per facet in the order of the report.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenfold.fixed import PESTLE_FACETS, SWOT_FACETS
from lumenfold.operators.models import complete
from lumenfold.operators.ranking import evidence_lists
from lumenfold.plans import evidence as ev
from lumenfold.plans import reports as rp
from lumenfold.plans import tables as tb
from lumenfold.session import materialise


def seeds(like: DataFrame, subject: str, stage: str, fn: Callable) -> DataFrame:
    """Seed paragraphs (facet, text) for a subject, from the completion function."""
    one = like.sparkSession.createDataFrame([(subject,)], "subject string")
    prompts = rp.seed_prompts(one).filter(F.col("stage") == stage)
    # A completion is asked for once, though its text is read twice.
    return materialise(complete(prompts, fn).select("facet", F.col("completion").alias("text")))


def _review(best: DataFrame, subject: str, facets: list[str], prompts: Callable, fn: Callable) -> DataFrame:
    """(subject, stage, report, evidence): ``evidence`` lists (facet, texts) in facet order."""
    lists = materialise(evidence_lists(best, "text"))
    order = F.array_position(F.lit(facets), F.col("facet"))
    entry = F.struct(order.alias("o"), "facet", F.col("evidence").alias("texts"))
    gathered = lists.agg(F.array_sort(F.collect_list(entry)).alias("e")).select(
        F.transform("e", lambda e: F.struct(e["facet"].alias("facet"), e["texts"].alias("texts"))).alias("evidence")
    )
    # One row of lists, with k texts per facet at most, as a scalar.
    return rp.report(prompts(lists, subject), fn).withColumn("evidence", gathered.scalar())


def article_review(articles: DataFrame, subject: str, fn: Callable, **search) -> DataFrame:
    """SWOT review of the articles that a search finds; ``search`` as in ``articles_table``."""
    found = tb.articles_table(articles, **search)
    best = ev.swot_articles(found, seeds(articles, subject, "swot_seed", fn))
    return _review(best, subject, SWOT_FACETS, rp.swot_prompt, fn)


def pestle_review(articles: DataFrame, subject: str, fn: Callable, **search) -> DataFrame:
    """PESTLE review of the articles that a search finds."""
    found = tb.articles_table(articles, **search)
    best = ev.pestle_articles(found, seeds(articles, subject, "pestle_seed", fn))
    return _review(best, subject, PESTLE_FACETS, rp.pestle_prompts, fn)


def post_review(posts: DataFrame, subject: str, fn: Callable, subreddit: str, limit: int) -> DataFrame:
    """SWOT review of the newest posts of a community; posts without a url don't count."""
    found = tb.posts_table(posts, subreddit, limit)
    best = ev.swot_posts(found, seeds(posts, subject, "swot_seed", fn))
    return _review(best, subject, SWOT_FACETS, rp.swot_prompt, fn)


def tweet_review(tweets: DataFrame, subject: str, fn: Callable, limit: int, **search) -> DataFrame:
    """SWOT review of messages; ``search`` as in ``tweets_table``."""
    found = tb.tweets_table(tweets, limit, **search)
    best = ev.swot_tweets(found, seeds(tweets, subject, "swot_seed", fn))
    return _review(best, subject, SWOT_FACETS, rp.swot_prompt, fn)


def review_tables(review: DataFrame) -> dict[str, DataFrame]:
    """A review as two tables to publish together: ``report`` (subject, stage, report) and
    ``evidence`` (subject, stage, place, facet, texts)."""
    # Both tables hold the answers of the same calls.
    review = materialise(review)
    lists = review.select("subject", "stage", F.posexplode("evidence").alias("place", "e"))
    return {
        "report": review.select("subject", "stage", "report"),
        "evidence": lists.select("subject", "stage", "place", "e.facet", "e.texts"),
    }


def from_tables(report: DataFrame, evidence: DataFrame) -> DataFrame:
    """The review again: (subject, stage, report, evidence)."""
    entry = F.struct("place", "facet", "texts")
    lists = evidence.groupBy("subject", "stage").agg(F.array_sort(F.collect_list(entry)).alias("e"))
    lists = lists.select(
        "subject", "stage", F.transform("e", lambda e: F.struct(e["facet"].alias("facet"), e["texts"].alias("texts"))).alias("evidence")
    )
    return report.join(lists, ["subject", "stage"])
