"""Text columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lumenfold.fixed import PREVIEW_CHARS, WINDOW_DAYS

# --- fixed values: whitespace, Unicode included (a class of Java patterns) ----
_SPACES = (
    r"\t-\r\x1C-\x20\x85\xA0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000"
)
SPACE = f"[{_SPACES}]"
NOT_SPACE = f"[^{_SPACES}]"

SENTENCE_BREAK = f"(?<=[.!?]){SPACE}+"
NOT_WORD_RUN = r"[^\p{L}\p{N}]+"


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def to_text(c: Column | str) -> Column:
    """Cast to string; a missing value stays NULL and never becomes text."""
    return col(c).cast("string")


def default_empty(c: Column | str) -> Column:
    return F.coalesce(col(c), F.lit(""))


def split_sentences(c: Column | str) -> Column:
    """Cut at whitespace that follows ``.``, ``!`` or ``?``; keep a trailing ''."""
    return F.split(to_text(c), SENTENCE_BREAK, -1)


def count_sentences(c: Column | str) -> Column:
    """Number of pieces of :func:`split_sentences`: one more than there are cuts."""
    return F.regexp_count(to_text(c), F.lit(f"[.!?]{SPACE}")) + 1


def first_sentence(c: Column | str) -> Column:
    """First piece of :func:`split_sentences`; stops at the first cut."""
    return F.get(F.split(to_text(c), SENTENCE_BREAK, 2), F.lit(0))


def clean_text(c: Column | str) -> Column:
    """Drop mentions, '#' and links, then turn every other run into one space.

    Only ASCII letters and digits survive and the result is not trimmed. After
    the last step no run of whitespace can be left, so none is collapsed.
    ``\\P{Alnum}`` is ASCII here and ten times faster than ``[^A-Za-z0-9]``.
    """
    c = F.regexp_replace(col(c), r"@\p{Alnum}+", "")
    c = F.replace(c, F.lit("#"), F.lit(""))
    c = F.regexp_replace(c, f"https?://{NOT_SPACE}+", "")
    return F.regexp_replace(c, r"\P{Alnum}+", " ")


def clean_each(texts: Column | str) -> Column:
    return F.transform(col(texts), lambda t: clean_text(t))


def words(c: Column | str, cleaned: bool = False) -> Column:
    """Lower-case words in reading order.

    ``cleaned`` says the text comes from :func:`clean_text`, where words are one
    space apart and the cheap split gives the same list.
    """
    pattern = " " if cleaned else NOT_WORD_RUN
    return F.array_remove(F.split(F.lower(col(c)), pattern), "")


def hashtags_in(c: Column | str) -> Column:
    """Hashtags of a text, lower case, without the '#'; letters and digits of any script."""
    return F.regexp_extract_all(F.lower(col(c)), F.lit(r"#([\p{L}\p{M}\p{N}_]+)"), 1)


def normalise_hashtags(c: Column | str) -> Column:
    """'ai, #ml' → '#ai OR #ml'."""
    trimmed = F.regexp_replace(col(c), f"^{SPACE}+|{SPACE}+$", "")
    tags = F.array_remove(F.split(trimmed, f"{SPACE}*,{SPACE}*"), "")
    marked = F.transform(
        tags, lambda t: F.when(t.startswith("#"), t).otherwise(F.concat(F.lit("#"), t))
    )
    return F.array_join(marked, " OR ")


def normalise_username(c: Column | str) -> Column:
    return F.regexp_replace(col(c), "^@", "")


def iso_date(c: Column | str) -> Column:
    return F.date_format(col(c), "yyyy-MM-dd")


def minus_days(c: Column | str, days: int = WINDOW_DAYS) -> Column:
    return F.date_sub(F.to_date(col(c)), days)


def search_criteria(subject: Column, since: Column, until: Column) -> Column:
    """Criteria text of the message search (fixed format)."""
    return F.concat_ws(
        " ",
        subject,
        F.concat(F.lit("since:"), since),
        F.concat(F.lit("until:"), until),
        F.lit("exclude:retweets"),
        F.lit("exclude:replies"),
    )


def preview(c: Column | str, chars: int = PREVIEW_CHARS) -> Column:
    return F.substring(col(c), 1, chars)


def bulletise(c: Column | str) -> Column:
    return F.replace(col(c), F.lit(" -"), F.lit("\n-"))


def sentiment_label(score: Column | str) -> Column:
    """Negative, Neutral or Positive; NULL and NaN have no label."""
    s = col(score)
    return (
        F.when(s.isNull() | F.isnan(s), F.lit(None).cast("string"))
        .when(s < 0, "Negative")
        .when(s == 0, "Neutral")
        .otherwise("Positive")
    )


def marker_size(n: Column | str) -> Column:
    n = col(n)
    return F.when(n > 10000, 1.0).when(n > 1000, 1.5).otherwise(2.0)
