"""Unit rows of the text columns, and properties on whole texts."""

import random
import re

import pytest
from pyspark.sql import functions as F

from lumenfold.functions import text as tx
from lumenfold.functions.vectors import term_vector
from lumenfold.operators.ranking import explode_sentences
from lumenfold.sources.readers import load


def value(spark, column, given, kind="string"):
    df = spark.createDataFrame([(given,)], f"c {kind}")
    return df.select(column.alias("v")).first()["v"]


@pytest.mark.parametrize(
    "given, expected",
    [
        ("Hi @bob, see https://x.io/a?b=1 now!", "Hi see now "),
        ("#Big news", "Big news"),
        ("mail bob@example.com", "mail bob com"),
        ("@foo_bar ok", " bar ok"),
        ("été", " t "),
        ("", ""),
        ("!!!", " "),
        ("a \t\n b", "a b"),
        ("http://a.b#c d", " d"),
    ],
)
def test_clean_text(spark, given, expected):
    assert value(spark, tx.clean_text("c"), given) == expected


@pytest.mark.parametrize(
    "given, expected",
    [
        ("A. B! C? D", ["A.", "B!", "C?", "D"]),
        ("A. ", ["A.", ""]),
        ("A.B", ["A.B"]),
        ("", [""]),
    ],
)
def test_split_sentences(spark, given, expected):
    assert value(spark, tx.split_sentences("c"), given) == expected
    assert value(spark, tx.first_sentence("c"), given) == expected[0]


def test_hashtags_and_names(spark):
    tags = value(spark, tx.normalise_hashtags("c"), "ai, #ml ,data")
    assert tags == "#ai OR #ml OR #data"
    assert value(spark, tx.normalise_username("c"), "@@x") == "@x"
    assert value(spark, tx.hashtags_in("c"), "#A b #c_d") == ["a", "c_d"]


@pytest.mark.parametrize(
    "score, label",
    [
        (-0.1, "Negative"),
        (0.0, "Neutral"),
        (0.1, "Positive"),
        (None, None),
        (float("nan"), None),
    ],
)
def test_sentiment_label(spark, score, label):
    assert value(spark, tx.sentiment_label("c"), score, "double") == label


@pytest.mark.parametrize("n, size", [(10001, 1.0), (10000, 1.5), (1001, 1.5), (1000, 2.0)])
def test_marker_size(spark, n, size):
    assert value(spark, tx.marker_size("c"), n, "long") == size


def test_preview_and_bullets(spark):
    assert value(spark, tx.preview("c"), "é" * 200) == "é" * 175
    assert value(spark, tx.bulletise("c"), "a - b -c") == "a\n- b\n-c"


def test_missing_text_stays_missing(spark):
    assert value(spark, tx.clean_text("c"), None) is None
    assert value(spark, tx.to_text("c"), None) is None
    assert value(spark, tx.default_empty("c"), None) == ""


def test_clean_is_idempotent_and_ascii(spark, folder):
    once = load(spark, folder, "documents").select(tx.clean_text("text").alias("a"))
    twice = once.select("a", tx.clean_text("a").alias("b"))
    assert twice.filter("a <> b or not a rlike '^[A-Za-z0-9 ]*$'").count() == 0


def test_cleaning_matches_its_rules(spark, folder):
    """Row by row against plain regular expressions, over every whole text."""
    rules = [
        (r"@[A-Za-z0-9]+", ""),
        (r"#", ""),
        (r"https?://\S+", ""),
        (r"[^A-Za-z0-9]+", " "),
        (r"\s+", " "),
    ]
    docs = load(spark, folder, "documents")
    for row in docs.select("text", tx.clean_text("text").alias("c")).collect():
        want = row["text"]
        for pattern, by in rules:
            want = re.sub(pattern, by, want)
        assert row["c"] == want


def random_texts(n):
    rng = random.Random(11)
    parts = [
        "a", "Zz9", ".", "!", "?", " ", "  ", "\t", "\n", "\v", "\x1c", "\x85", "\xa0",
        "\u2003", "\u3000", "@", "@bob", "#", "_", "http://x", "https://y.z/?q=1", "é",
        "ß", "日本", "😀", "\u200b", ",",
    ]
    return ["".join(rng.choices(parts, k=rng.randrange(14))) for _ in range(n)]


def test_random_texts_match_plain_patterns(spark):
    """Unicode spaces, odd characters and empty texts, in one job."""
    df = spark.createDataFrame([(t,) for t in random_texts(3000)], "t string")
    rows = df.select(
        "t",
        tx.split_sentences("t").alias("split"),
        tx.first_sentence("t").alias("first"),
        tx.clean_each(tx.split_sentences("t")).alias("clean"),
        tx.preview("t", 5).alias("preview"),
        tx.normalise_hashtags("t").alias("tags"),
    ).collect()
    for r in rows:
        pieces = re.split(r"(?<=[.!?])\s+", r["t"])
        assert r["split"] == pieces
        assert r["first"] == pieces[0]
        assert r["preview"] == r["t"][:5]
        for piece, cleaned in zip(pieces, r["clean"]):
            want = re.sub(r"#", "", re.sub(r"@[A-Za-z0-9]+", "", piece))
            want = re.sub(r"[^A-Za-z0-9]+", " ", re.sub(r"https?://\S+", "", want))
            assert cleaned == want
        tags = [t.strip() for t in r["t"].split(",") if t.strip()]
        assert r["tags"] == " OR ".join(t if t[0] == "#" else "#" + t for t in tags)


def test_sentence_count(spark, folder):
    docs = load(spark, folder, "documents")
    total = docs.agg(F.sum(F.size(tx.split_sentences("text")))).first()[0]
    assert explode_sentences(docs, "text", "doc_id").count() == total


def test_term_vector(spark):
    v = value(spark, term_vector("c", dims=7), "b a, b c B")
    assert sum(e["n"] for e in v) == 5
    assert [e["bucket"] for e in v] == sorted({e["bucket"] for e in v})
    assert value(spark, term_vector("c"), "") == []
    same = value(spark, term_vector("c", cleaned=True), "b a b c B")
    assert same == value(spark, term_vector("c"), "b a, b c B")
