"""Given tables → articles, posts, tweets, facet seeds and lexicons.

The given tables hold no news, forum or message data. These adapters derive it
from them, over whole tables and whole texts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenfold.fixed import EMOTIONS, PESTLE_FACETS, SWOT_FACETS
from lumenfold.functions.text import count_sentences, first_sentence, split_sentences, words
from lumenfold.functions.vectors import bind
from lumenfold.operators.lookups import row_count
from lumenfold.sources.readers import load, spread

TOPICS = ["news", "science", "tech", "finance", "food"]


def articles(spark: SparkSession, folder: str) -> DataFrame:
    d = spread(load(spark, folder, "documents"), "doc_id")
    day = F.date_add(F.lit("2024-01-01").cast("date"), (F.col("doc_id") % 30).cast("int"))
    topics = F.array(*[F.lit(t) for t in TOPICS])
    return d.select(
        F.col("doc_id").alias("article_id"),
        first_sentence("text").alias("title"),
        F.col("text").alias("summary"),
        "lang",
        F.when(F.col("doc_id") % 3 != 0, "us").otherwise("gb").alias("country"),
        "source",
        (F.col("doc_id") * 37 % 10000).cast("int").alias("rank"),
        F.get(topics, (F.col("doc_id") % 5).cast("int")).alias("topic"),
        day.alias("published"),
    )


def posts(spark: SparkSession, folder: str) -> DataFrame:
    c = spread(load(spark, folder, "conversations"), "conv_id", "turn")
    mark = (F.col("conv_id") + F.col("turn")) % 13
    post_id = F.concat_ws("_", "conv_id", "turn")
    return c.select(
        F.when(F.col("turn") == 0, "submission").otherwise("comment").alias("type"),
        F.col("role").alias("author"),
        F.when(mark == 0, "[deleted]")
        .when(mark == 1, "[removed]")
        .when(mark != 2, F.col("text"))
        .alias("body"),
        F.expr(
            "timestamp_ntz'2024-01-01 00:00:00'"
            " + make_dt_interval(0, cast(conv_id as int), cast(turn as int), 0)"
        ).alias("created"),
        post_id.alias("id"),
        F.when(
            F.col("turn") != 0, F.concat_ws("_", "conv_id", F.col("turn") - 1)
        ).alias("parent_id"),
        F.concat(F.lit("sub"), F.col("conv_id") % 10).alias("subreddit"),
        F.when(
            (F.col("conv_id") + F.col("turn")) % 17 != 0,
            F.concat(F.lit("u/"), post_id),
        ).alias("url"),
    )


def tweets(spark: SparkSession, folder: str) -> DataFrame:
    """One message per sentence of every document.

    Sender, kind and time come from an event, the link from a page; both are
    found by an even modulo of the whole table, so neither join is skewed. A sentence
    stays where the event or page is missing. The joins see places of sentences only: a
    text is shuffled once, whole, to meet the list of its senders.
    """
    d = load(spark, folder, "documents").select("doc_id", "text").filter("text is not null")
    events = load(spark, folder, "events")
    pages = load(spark, folder, "pages")
    # Rows that share an id have the places of the longest of them.
    sizes = (
        d.filter("doc_id is not null")
        .groupBy("doc_id")
        .agg(F.max(count_sentences("text")).alias("n"))
    )
    place = sizes.select("doc_id", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("pos"))
    event = ((F.col("doc_id") * 7919 + F.col("pos")) % row_count(events)).alias("event_id")
    senders = (
        place.select("doc_id", "pos", event)
        .join(events.select("event_id", "ts", "user_id", "event_type"), "event_id", "left")
        .groupBy("doc_id")
        .agg(F.collect_list(F.struct("pos", "ts", "user_id", "event_type")).alias("senders"))
    )
    urls = (
        sizes.select("doc_id", (F.col("doc_id") % row_count(pages)).alias("page_id"))
        .join(pages.select("page_id", "url"), "page_id")
        .select("doc_id", "url")
    )
    met = d.join(senders, "doc_id", "left").join(urls, "doc_id", "left")
    kind = senders.schema["senders"].dataType.simpleString()

    def each(s: Column) -> Column:
        nobody = F.transform(s, lambda x, i: F.struct(i.alias("pos"), *[F.lit(None)] * 3)).cast(kind)
        return F.transform(
            F.coalesce("senders", nobody),
            lambda e: F.struct(
                e["pos"].alias("pos"),
                e["ts"].alias("ts"),
                e["user_id"].alias("user_id"),
                e["event_type"].alias("event_type"),
                F.get(s, e["pos"]).alias("sentence"),
            ),
        )

    return (
        met.select("doc_id", "url", F.inline(bind(split_sentences("text"), each)))
        .filter("sentence is not null")
        .withColumn("tweet_id", F.col("doc_id") * (1 << 31) + F.col("pos"))
        .select(
            "ts",
            "tweet_id",
            F.concat(
                F.lit("@user"),
                F.coalesce(F.col("user_id").cast("string"), F.lit("")),
                F.lit(" #"),
                F.coalesce("event_type", F.lit("")),
                F.lit(" "),
                F.coalesce("url", F.lit("")),
                F.lit(" "),
                "sentence",
            ).alias("text"),
            F.concat(F.lit("user"), "user_id").alias("username"),
            (F.col("tweet_id") % 7 == 0).alias("is_retweet"),
            (F.col("tweet_id") % 11 == 0).alias("is_reply"),
        )
    )


def facet_seeds(spark: SparkSession, folder: str, facets: list[str]) -> DataFrame:
    """Seed paragraphs (facet, text): every benchmark passage belongs to one facet."""
    names = F.array(*[F.lit(f) for f in facets])
    return spread(load(spark, folder, "benchmark"), "item_id").select(
        F.get(names, (F.col("item_id") % len(facets)).cast("int")).alias("facet"),
        "text",
    )


def swot_seeds(spark: SparkSession, folder: str) -> DataFrame:
    return facet_seeds(spark, folder, SWOT_FACETS)


def pestle_seeds(spark: SparkSession, folder: str) -> DataFrame:
    return facet_seeds(spark, folder, PESTLE_FACETS)


def vectors(spark: SparkSession, folder: str) -> DataFrame:
    return spread(load(spark, folder, "embeddings"), "vec_id")


def _vocabulary(spark: SparkSession, folder: str) -> DataFrame:
    return (
        spread(load(spark, folder, "benchmark"), "item_id")
        .select(F.explode(words("text")).alias("term"))
        .distinct()
    )


def _hash(start: int, modulus: int):
    """Eight hex digits of md5(term) as a number below ``modulus``."""
    return F.conv(F.substring(F.md5("term"), start, 8), 16, 10).cast("long") % modulus


def sentiment_lexicon(spark: SparkSession, folder: str) -> DataFrame:
    """(term, polarity in [-1, 1], subjectivity in [0, 1]) for benchmark words."""
    return _vocabulary(spark, folder).select(
        "term",
        ((_hash(1, 201) - 100) / 100.0).alias("polarity"),
        (_hash(9, 101) / 100.0).alias("subjectivity"),
    )


def emotion_lexicon(spark: SparkSession, folder: str) -> DataFrame:
    """(term, emotion, weight) for benchmark words."""
    labels = F.array(*[F.lit(e) for e in EMOTIONS])
    return _vocabulary(spark, folder).select(
        "term",
        F.get(labels, _hash(1, len(EMOTIONS)).cast("int")).alias("emotion"),
        ((_hash(9, 100) + 1) / 100.0).alias("weight"),
    )


def modifiers(spark: SparkSession, folder: str) -> DataFrame:
    """(term, factor): one benchmark word in forty negates, two in forty intensify by
    0.5 to 1.5."""
    kind, factor = _hash(17, 40), (_hash(25, 11) + 5) / 10.0
    rows = _vocabulary(spark, folder).withColumn("kind", kind).filter("kind < 3")
    return rows.select("term", F.when(F.col("kind") > 0, factor).alias("factor"))


def palette(spark: SparkSession, folder: str) -> DataFrame:
    """(emotion, colour): a colour per label from the first of its words."""
    first = emotion_lexicon(spark, folder).groupBy("emotion").agg(F.min("term").alias("term"))
    return first.select("emotion", F.concat(F.lit("#"), F.upper(F.substring(F.md5("term"), 1, 6))).alias("colour"))
