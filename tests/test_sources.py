import pytest
"""Landed files in, result files out."""

import json
import math
import re
from datetime import datetime

from pyspark.sql import functions as F

from lumenfold.fixed import EMOTIONS
from lumenfold.functions.text import clean_text
from lumenfold.operators.models import complete, emotion_model, encode_model
from lumenfold.sources import adapters, readers, sinks
from lumenfold.streaming.feeds import land, stream_posts, stream_tweets


def write(path, *lines):
    path.write_text("\n".join(lines) + "\n", encoding="utf-8")


def post(n, **more):
    item = {
        "_type": "comment", "author": "a", "body": f"b{n}", "created": "2024-01-01T00:00:00",
        "id": f"p{n}", "parentId": "p0", "subreddit": "s", "url": f"u{n}",
    }
    return json.dumps({**item, **more})


def test_article_pages(spark, tmp_path):
    for page in (1, 2):
        articles = [{"article_id": page * 10 + i, "summary": "A. B."} for i in range(3)]
        write(tmp_path / f"{page}.json", json.dumps({"page": page, "articles": articles}))
    df = readers.read_articles(spark, str(tmp_path))
    assert sorted(r["article_id"] for r in df.collect()) == [10, 11, 12, 20, 21, 22]
    assert df.filter("title is not null").count() == 0


def test_posts(spark, tmp_path):
    missing = json.loads(post(1))
    del missing["body"], missing["parentId"], missing["url"]
    write(tmp_path / "p.jsonl", post(0), json.dumps(missing), post(2, body=None))
    rows = readers.read_posts(spark, str(tmp_path)).orderBy("id").collect()
    assert [r["body"] for r in rows] == ["b0", "", ""]
    assert [r["parent_id"] for r in rows] == ["p0", "", "p0"]
    assert [r["url"] for r in rows] == ["u0", None, "u2"]
    assert rows[0]["type"] == "comment" and rows[0]["created"].year == 2024


def test_tweets(spark, tmp_path):
    item = {"date": "2024-01-05T01:02:03", "id": 7, "content": "hi", "user": {"username": "bob"}}
    write(tmp_path / "t.jsonl", json.dumps(item))
    row = readers.read_tweets(spark, str(tmp_path)).first()
    assert (row["tweet_id"], row["text"], row["username"]) == (7, "hi", "bob")
    assert row["ts"].isoformat() == "2024-01-05T01:02:03"


def test_palette_with_a_blank_header(spark, tmp_path):
    write(tmp_path / "c.csv", "Emotions,", "joy,#112233", "love,#445566")
    rows = readers.read_emotion_palette(spark, str(tmp_path / "c.csv")).collect()
    assert [tuple(r) for r in rows] == [("joy", "#112233"), ("love", "#445566")]


def test_similarity_matrix(spark, tmp_path):
    write(tmp_path / "m.csv", ",a.com,b.com", "a.com,1.0,0.5", "b.com,0.5,1.0")
    rows = {tuple(r) for r in readers.read_similarity(spark, str(tmp_path / "m.csv")).collect()}
    assert rows == {
        ("a.com", "a.com", 1.0), ("a.com", "b.com", 0.5),
        ("b.com", "a.com", 0.5), ("b.com", "b.com", 1.0),
    }


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (2, None)], "id int, t string")
    for fmt in ("parquet", "json", "csv"):
        path = str(tmp_path / fmt)
        sinks.write_table(df, path, fmt)
        reader = spark.read.option("header", True).schema(df.schema).format(fmt)
        assert sorted(reader.load(path).collect()) == sorted(df.collect())
    records = [r[0] for r in sinks.json_records(df).collect()]
    assert sorted(records) == ['{"id":1,"t":"a"}', '{"id":2,"t":null}']


def test_feeds_land_each_item_once(spark, tmp_path):
    source, out, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    (tmp_path / "in").mkdir()
    step = lambda df: df.select("id", clean_text("body").alias("clean"))
    for n in range(2):
        write(tmp_path / "in" / f"{n}.jsonl", post(n, body="#a @b c!"))
        land(stream_posts(spark, source), out, state, step).awaitTermination()
    rows = spark.read.parquet(out).orderBy("id").collect()
    assert [tuple(r) for r in rows] == [("p0", "a c "), ("p1", "a c ")]
    assert stream_tweets(spark, source).isStreaming


def test_model_slots(spark):
    df = spark.createDataFrame([(i, "x" * i) for i in range(5)], "id int, t string")

    def lengths():
        import numpy as np

        return lambda texts: np.array([[len(t), 1] for t in texts], dtype="float32")

    rows = encode_model(df, "t", lengths, batch_size=2).orderBy("id").collect()
    assert [r["embedding"] for r in rows] == [[float(i), 1.0] for i in range(5)]

    labels = list(reversed(EMOTIONS))

    def classifier():
        import numpy as np

        return lambda texts: np.tile(np.arange(27, dtype="float32"), (len(texts), 1))

    row = emotion_model(df, "t", labels, classifier).first()
    assert row["emotion"] == sorted(EMOTIONS)
    assert row["score"] == [float(26 - i) for i in range(27)]

    done = complete(df, lambda batch: [t.upper() for t in batch["t"]])
    assert done.filter(F.col("completion") != F.upper("t")).count() == 0


def test_lists_as_csv_and_no_silent_overwrite(spark, tmp_path):
    df = spark.createDataFrame([("a", ["x", "y"])], "facet string, evidence array<string>")
    sinks.write_table(df, str(tmp_path / "csv"), "csv")
    row = spark.read.csv(str(tmp_path / "csv"), header=True).first()
    assert row["evidence"] == '["x","y"]'
    with pytest.raises(Exception, match="(?i)exist"):
        sinks.write_table(df, str(tmp_path / "csv"), "csv")


def test_malformed_items_are_an_error(spark):
    lines = spark.createDataFrame([("{not json",)], "value string")
    with pytest.raises(Exception, match="(?i)malformed"):
        readers.posts_from_json(lines).collect()


def test_prompts_keep_placeholders_in_evidence(spark):
    from lumenfold.plans.reports import swot_prompt

    rows = [("positive", ["say {negative} {subject}"]), ("negative", ["no"])]
    lists = spark.createDataFrame(rows, "facet string, evidence array<string>")
    prompt = swot_prompt(lists, "tea").first()["prompt"]
    assert '["say {negative} {subject}"]' in prompt and '["no"]' in prompt and "review of tea" in prompt


def message_tables(spark, folder):
    """Documents, events and pages with repeated, missing and NULL keys."""
    texts = ["One. Two!  Three", "", "No cut", None, "A? B? C? D. "]
    documents = [(i, t) for i, t in enumerate(texts)] + [(0, "Again. Again."), (None, "Of none. x"), (-3, "Below. y")]
    events = [(i, datetime(2024, 1, 1 + i), 10 + i, f"t{i}") for i in (0, 1, 2, 2, 4, 5)]
    pages = [(0, "u0"), (1, "u1"), (1, "again"), (7, "u7")]
    spark.createDataFrame(documents, "doc_id long, text string").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(events, "event_id long, ts timestamp_ntz, user_id long, event_type string").write.parquet(f"{folder}/events.parquet")
    spark.createDataFrame(pages, "page_id long, url string").write.parquet(f"{folder}/pages.parquet")
    return documents, events, pages


def test_every_sentence_meets_its_event_and_page(spark, tmp_path):
    documents, events, pages = message_tables(spark, str(tmp_path))
    want = []
    for doc, text in documents:
        for pos, sentence in enumerate([] if text is None else re.split(r"(?<=[.!?])\s+", text)):
            # the remainder has the sign of the id, as in SQL
            found = [e for e in events if doc is not None and e[0] == math.fmod(doc * 7919 + pos, len(events))]
            links = [p[1] for p in pages if doc is not None and p[0] == math.fmod(doc, len(pages))]
            for _, ts, user, kind in found or [(None, None, None, None)]:
                for url in links or [""]:
                    sender = "" if user is None else user
                    tweet = None if doc is None else doc * 2**31 + pos
                    want.append((tweet, ts, f"@user{sender} #{kind or ''} {url} {sentence}"))
    got = [(r["tweet_id"], r["ts"], r["text"]) for r in adapters.tweets(spark, str(tmp_path)).collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)


def test_texts_of_messages_are_shuffled_once(spark, tmp_path, capsys):
    message_tables(spark, str(tmp_path))
    kept = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        adapters.tweets(spark, str(tmp_path)).explain("formatted")
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", kept)
    steps = re.split(r"\n\n+", capsys.readouterr().out)
    dealt = [s for s in steps if re.match(r"\(\d+\) Exchange", s)]
    assert len(dealt) > 2
    assert len([s for s in dealt if re.search(r"\b(text|sentence)#", s)]) == 1
