"""Explicit schemas of the landed inputs."""

from pyspark.sql import types as T

ARTICLE = T.StructType(
    [
        T.StructField("article_id", T.LongType()),
        T.StructField("title", T.StringType()),
        T.StructField("summary", T.StringType()),
        T.StructField("lang", T.StringType()),
        T.StructField("country", T.StringType()),
        T.StructField("source", T.StringType()),
        T.StructField("rank", T.IntegerType()),
        T.StructField("topic", T.StringType()),
        T.StructField("published", T.DateType()),
    ]
)

# One search page: the envelope around up to 100 articles.
ARTICLE_PAGE = T.StructType(
    [
        T.StructField("page", T.LongType()),
        T.StructField("articles", T.ArrayType(ARTICLE)),
    ]
)

# One forum item as it arrives; names are the feed's own.
POST_ITEM = T.StructType(
    [
        T.StructField("_type", T.StringType()),
        T.StructField("author", T.StringType()),
        T.StructField("body", T.StringType()),
        T.StructField("created", T.StringType()),
        T.StructField("id", T.StringType()),
        T.StructField("parentId", T.StringType()),
        T.StructField("subreddit", T.StringType()),
        T.StructField("url", T.StringType()),
    ]
)

TWEET_ITEM = T.StructType(
    [
        T.StructField("date", T.StringType()),
        T.StructField("id", T.LongType()),
        T.StructField("content", T.StringType()),
        T.StructField(
            "user", T.StructType([T.StructField("username", T.StringType())])
        ),
        T.StructField("is_retweet", T.BooleanType()),
        T.StructField("is_reply", T.BooleanType()),
    ]
)

PALETTE = T.StructType(
    [
        T.StructField("emotion", T.StringType()),
        T.StructField("colour", T.StringType()),
    ]
)
