"""The three result tables: articles, posts, messages."""

from __future__ import annotations

from pyspark.sql import DataFrame

from lumenfold.fixed import MAX_RANK
from lumenfold.operators import filters
from lumenfold.operators.ranking import latest_then_ascending, limit_first

MESSAGE_COLUMNS = ["ts", "tweet_id", "text", "username"]


def articles_table(
    articles: DataFrame,
    keyword: str,
    search_in: str = "title",
    sources: str | None = None,
    since: str | None = None,
    until: str | None = None,
    today: str | None = None,
    lang: str = "en",
    country: str = "us",
    max_rank: int = MAX_RANK,
    topic_groups: list[str] | None = None,
) -> DataFrame:
    """Article search: cheap column filters first, the text match last."""
    found = filters.country_filter(filters.lang_filter(articles, lang), country)
    found = filters.rank_filter(filters.source_filter(found, sources), max_rank)
    found = filters.date_range(found, "published", since, until, today)
    found = filters.topic_filter(found, topic_groups or [])
    return filters.keyword_filter(found, keyword, search_in)


def posts_table(posts: DataFrame, subreddit: str, limit: int) -> DataFrame:
    """First ``limit`` posts of a community that have a url."""
    valid = filters.require_url(filters.by_subreddit(posts, subreddit))
    return limit_first(valid, limit, "id")


def tweets_table(
    tweets: DataFrame,
    limit: int,
    username: str | None = None,
    hashtags: str | None = None,
    since: str | None = None,
    until: str | None = None,
    today: str | None = None,
) -> DataFrame:
    """Original messages of a user or with any hashtag, in time order.

    With both given, the hashtags decide.
    """
    if hashtags:
        found = filters.by_hashtags(tweets, hashtags)
    elif username:
        found = filters.by_user(tweets, username)
    else:
        raise ValueError("give a username or hashtags")
    window = filters.since_until(filters.originals_only(found), since, until, today)
    return latest_then_ascending(window.select(*MESSAGE_COLUMNS), limit)
