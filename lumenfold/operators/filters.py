"""Predicates. Each is a plain column filter, so it reaches the scan."""

from __future__ import annotations

import re
from datetime import date
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenfold.fixed import MAX_RANK, PLACEHOLDERS, TOPIC_GROUPS, WINDOW_DAYS
from lumenfold.functions.text import hashtags_in, normalise_username

_NOT_WORD = r"[^\p{L}\p{N}]"
_TOKEN = re.compile(r"\"([^\"]+)\"|'([^']+)'|(\S+)")


def _has_term(text: Column, term: str) -> Column:
    """Whole words; between the words of a phrase any run of other characters."""
    escaped = [re.sub(r"([^\w\s])", r"\\\1", w) for w in term.lower().split()]
    phrase = f"{_NOT_WORD}+".join(escaped)
    return text.rlike(f"(^|{_NOT_WORD}){phrase}($|{_NOT_WORD})")


def parse_keywords(expression: str) -> list[list[str]]:
    """Alternatives of an expression, each a list of terms that all have to match.

    Quotes are read first: AND and OR inside them are words. AND binds tighter than OR,
    and words next to each other are joined by AND.
    """
    alternatives: list[list[str]] = [[]]
    for double, single, plain in _TOKEN.findall(expression):
        if plain == "OR":
            alternatives.append([])
        elif plain != "AND":
            term = double or single or plain
            if term.strip():
                alternatives[-1].append(term)
    found = [terms for terms in alternatives if terms]
    if not found:
        raise ValueError("the keyword expression has no terms")
    return found


def keyword_filter(df: DataFrame, expression: str, search_in: str = "title") -> DataFrame:
    """Keep rows that match e.g. ``Mac AND Apple OR 'Steve Jobs'``.

    The expression is read by :func:`parse_keywords`. A term matches whole words in any
    letter case, and a phrase across line breaks and punctuation.
    """
    text = F.lower(F.col(search_in))
    hits = [reduce(and_, [_has_term(text, t) for t in terms]) for terms in parse_keywords(expression)]
    return df.filter(reduce(or_, hits))


def lang_filter(df: DataFrame, lang: str = "en") -> DataFrame:
    return df.filter(F.col("lang") == lang)


def country_filter(df: DataFrame, country: str = "us") -> DataFrame:
    return df.filter(F.col("country") == country)


def source_filter(df: DataFrame, sources: str | None) -> DataFrame:
    """Outlets as comma-separated names; an empty list filters nothing."""
    names = [s.strip() for s in (sources or "").split(",") if s.strip()]
    return df.filter(F.col("source").isin(names)) if names else df


def rank_filter(df: DataFrame, max_rank: int = MAX_RANK) -> DataFrame:
    return df.filter(F.col("rank") <= max_rank)


def _day(text: str | None, today: str) -> str | None:
    """ISO form of a date as a form sends it: ``2022-06-01``, ``2022/06/01``, ``today``."""
    text = (text or "").strip().lower()
    return today if text == "today" else text.replace("/", "-") or None


def _window(since: str | None, until: str | None, today: str | None):
    """(since, until) as date columns; NULL and '' both mean the default."""
    now = _day(today, "") or date.today().isoformat()
    end = F.to_date(F.lit(_day(until, now) or now))
    first = _day(since, now)
    start = F.to_date(F.lit(first)) if first else F.date_sub(end, WINDOW_DAYS)
    return start, end


def date_range(
    df: DataFrame,
    column: str,
    since: str | None = None,
    until: str | None = None,
    today: str | None = None,
) -> DataFrame:
    """``since <= column < until``; the default is the week before today.

    Works for timestamps, dates and ISO date text; literals are cast to the
    column's type, never the column, so that the filter can be pushed down.
    """
    kind = df.schema[column].dataType.simpleString()
    start, end = _window(since, until, today)
    c = F.col(column)
    return df.filter((c >= start.cast(kind)) & (c < end.cast(kind)))


def since_until(
    df: DataFrame,
    since: str | None = None,
    until: str | None = None,
    today: str | None = None,
) -> DataFrame:
    """Message window over ``ts``: until defaults to today, since to a week before."""
    return date_range(df, "ts", since, until, today)


def topic_filter(df: DataFrame, groups: list[str]) -> DataFrame:
    topics = sorted({t for g in groups for t in TOPIC_GROUPS[g]})
    return df.filter(F.col("topic").isin(topics)) if topics else df


def by_user(df: DataFrame, username: str) -> DataFrame:
    return df.filter(F.col("username") == normalise_username(F.lit(username)))


def by_hashtags(df: DataFrame, hashtags: str) -> DataFrame:
    """Any of the comma-separated hashtags, with or without '#'."""
    tags = [t.strip().removeprefix("#").lower() for t in hashtags.split(",")]
    tags = [t for t in tags if t]
    if not tags:
        raise ValueError("no hashtag given")
    wanted = F.array(*[F.lit(t) for t in tags])
    return df.filter(F.arrays_overlap(hashtags_in("text"), wanted))


def originals_only(df: DataFrame) -> DataFrame:
    """Neither shared nor an answer; a missing flag counts as no."""
    no = F.lit(False)
    return df.filter(~F.coalesce("is_retweet", no) & ~F.coalesce("is_reply", no))


def by_subreddit(df: DataFrame, name: str) -> DataFrame:
    return df.filter(F.col("subreddit") == name)


def require_url(df: DataFrame) -> DataFrame:
    return df.filter(F.col("url").isNotNull())


def drop_placeholders(df: DataFrame, column: str = "body") -> DataFrame:
    """Drop missing, deleted and removed texts; an empty text is kept."""
    return df.filter(F.col(column).isNotNull() & ~F.col(column).isin(PLACEHOLDERS))


def emotion_eq(df: DataFrame, label: str) -> DataFrame:
    return df.filter(F.col("top_emotion") == label)
