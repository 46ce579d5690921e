import pytest

from lumenfold.operators import filters as fl
from lumenfold.plans.tables import tweets_table


def ids(df):
    return sorted(r[0] for r in df.collect())


@pytest.fixture(scope="module")
def titles(spark):
    rows = [
        (1, "Mac sales"),
        (2, "apple and MAC"),
        (3, "About Steve Jobs today"),
        (4, "Jobs and Steve"),
        (5, "macOS"),
        (6, None),
        (7, "a+b test"),
    ]
    return spark.createDataFrame(rows, "id int, title string")


@pytest.mark.parametrize(
    "expression, found",
    [
        ("Mac AND Apple OR 'Steve Jobs'", [2, 3]),
        ('Mac OR "steve jobs"', [1, 2, 3]),
        ("jobs steve", [3, 4]),
        ("mac", [1, 2]),
        ("a+b", [7]),
    ],
)
def test_keywords(titles, expression, found):
    assert ids(fl.keyword_filter(titles, expression)) == found


def test_no_keyword(titles):
    with pytest.raises(ValueError):
        fl.keyword_filter(titles, "  ")


def test_sources(spark):
    df = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "id int, source string")
    assert ids(fl.source_filter(df, " a , c ")) == [1, 3]
    assert ids(fl.source_filter(df, "")) == [1, 2, 3]
    assert ids(fl.source_filter(df, None)) == [1, 2, 3]


def test_default_window(spark):
    df = spark.createDataFrame(
        [(1, "2024-01-02"), (2, "2024-01-03"), (3, "2024-01-09"), (4, "2024-01-10")],
        "id int, day string",
    )
    for since, until in [(None, None), ("", "")]:
        assert ids(fl.date_range(df, "day", since, until, "2024-01-10")) == [2, 3]
    assert ids(fl.date_range(df, "day", "2024-01-09", "2024-01-11")) == [3, 4]


def test_placeholders(spark):
    df = spark.createDataFrame(
        [("",), ("nan",), ("[deleted]",), ("[removed]",), ("ok",), (None,)], "body string"
    )
    assert ids(fl.drop_placeholders(df)) == ["", "ok"]


def test_topics(spark):
    df = spark.createDataFrame([(1, "news"), (2, "food"), (3, "tech")], "id int, topic string")
    assert ids(fl.topic_filter(df, ["culture", "mainstream"])) == [1, 2]
    assert ids(fl.topic_filter(df, [])) == [1, 2, 3]


def test_hashtags(spark):
    rows = [(1, "x #AI"), (2, "ai"), (3, "#mlops"), (4, "#ml!")]
    df = spark.createDataFrame(rows, "id int, text string")
    assert ids(fl.by_hashtags(df, "ai, #ml")) == [1, 4]
    with pytest.raises(ValueError):
        fl.by_hashtags(df, " , ")


def test_messages_need_a_subject(spark, folder):
    from lumenfold.sources.adapters import tweets

    with pytest.raises(ValueError):
        tweets_table(tweets(spark, folder), 10)


def test_filters_reach_the_scan(spark, folder):
    from lumenfold.sources.adapters import articles

    plan = fl.lang_filter(articles(spark, folder)).select("article_id")
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(lang,en)" in text
    assert "text" not in text.split("ReadSchema")[1]


@pytest.mark.parametrize(
    ("expression", "found"),
    [
        ("'trick OR treat'", [1]),
        ("\"Steve Jobs\"", [2, 3]),
        ("treat OR jobs", [1, 2, 3]),
        ("'jobs AND x' OR", []),
    ],
)
def test_phrases(spark, expression, found):
    rows = [(1, "A trick or treat day"), (2, "steve\nJobs"), (3, "Steve - jobs!"), (4, "stevejobs")]
    df = spark.createDataFrame(rows, "id int, title string")
    got = [r["id"] for r in fl.keyword_filter(df, expression).orderBy("id").collect()]
    assert got == found


def test_form_dates(spark):
    rows = [(i, f"2022-06-{i:02d}") for i in range(1, 11)]
    df = spark.createDataFrame(rows, "id int, day string").selectExpr("id", "date(day) as day")

    def ids(**window):
        return [r["id"] for r in fl.date_range(df, "day", **window).orderBy("id").collect()]

    assert ids(since="2022/06/02", until="2022/06/04") == [2, 3]
    assert ids(since="2022-06-08", until="today", today="2022/06/10") == [8, 9]


def test_missing_flags_count_as_no(spark):
    rows = [(1, None, None), (2, True, None), (3, False, False), (4, None, True)]
    df = spark.createDataFrame(rows, "id int, is_retweet boolean, is_reply boolean")
    assert [r["id"] for r in fl.originals_only(df).orderBy("id").collect()] == [1, 3]
