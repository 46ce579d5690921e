"""Feeds with state, the ledger of completions, and tables that are published together."""

import os

import pandas as pd
import pytest
from pyspark.sql import functions as F

from lumenfold.operators import ledger as lg
from lumenfold.session import checkpoint_ready
from lumenfold.sources import publish as pub
from lumenfold.streaming import newest as nw

ITEM = "id string, sub string, created timestamp, n int"


def land(spark, folder, rows):
    spark.createDataFrame(rows, ITEM.replace("timestamp", "string")).coalesce(1).write.mode("append").json(folder)


def run(spark, tmp_path, n):
    feed = spark.readStream.schema(ITEM).option("maxFilesPerTrigger", 1).json(str(tmp_path / "feed"))
    lists = nw.newest(nw.first_seen(feed, "id", "created", "100 days"), "sub", "id", "created", n, salts=3)
    nw.keep_newest(lists, str(tmp_path / "lists"), str(tmp_path / "state")).awaitTermination()
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in lists.schema.fields) + ", batch int"
    found = nw.read_newest(spark, str(tmp_path / "lists"), schema, "sub", "id", "created", n)
    return sorted((r["sub"], r.rk, r.id, r.n) for r in found.collect())


def test_newest_with_repeated_and_late_items(spark, tmp_path):
    """Three landings and a restart: the lists are those of the whole table."""
    nw.with_state_store(spark)
    rows = [(f"i{k:03}", f"s{k % 3 if k % 5 else 0}", f"2024-01-{1 + k * 7 % 28:02} 0{k % 10}:00:00", k) for k in range(90)]
    land(spark, str(tmp_path / "feed"), rows[40:] + [(None, "s0", "2024-03-01 00:00:00", -1), ("x", "s1", None, -2)])
    land(spark, str(tmp_path / "feed"), rows[:40] + rows[60:80])

    def want(some, n):
        out = []
        for sub in sorted({r[1] for r in some}):
            best = sorted((r for r in some if r[1] == sub), key=lambda r: r[0])
            best = sorted(best, key=lambda r: r[2], reverse=True)[:n]
            out += [(sub, i + 1, r[0], r[3]) for i, r in enumerate(best)]
        return out

    assert run(spark, tmp_path, 7) == want(rows, 7)
    # A restart goes on with the lists that it has, and an item from before stays one.
    later = [("z1", "s1", "2024-02-01 00:00:00", 500), ("z2", "s9", "2024-01-02 00:00:00", 501)]
    land(spark, str(tmp_path / "feed"), later + rows[10:20])
    assert run(spark, tmp_path, 7) == want(rows + later, 7)


# ---- ledger -----------------------------------------------------------------------


def prompts(spark, texts):
    rows = [("subject", "stage", f"f{i}", t, 300) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "subject string, stage string, facet string, prompt string, max_tokens int")


def counting(path, fail_after=None):
    """A completion that notes every call in a file, and fails when there are so many."""

    def fn(batch):
        out = []
        for text in batch["prompt"]:
            if fail_after is not None and os.path.exists(path) and len(open(path).read().split()) >= fail_after:
                raise RuntimeError("the service is down")
            with open(path, "a") as f:
                f.write(text + "\n")
            out.append(f"answer to {text}")
        return out

    return fn


@pytest.fixture
def one_task(spark):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", before)


def test_a_prompt_is_paid_for_once(spark, tmp_path, one_task):
    calls, book = tmp_path / "calls", str(tmp_path / "ledger")
    texts = ["a", "b", "c", "d", "b"]
    asked = prompts(spark, texts).coalesce(1)
    with pytest.raises(Exception, match="the service is down"):
        lg.complete_once(asked, counting(str(calls), fail_after=3), book).collect()
    assert len(set(calls.read_text().split())) == 3
    got = lg.complete_once(asked, counting(str(calls)), book)
    assert sorted((r.facet, r.completion) for r in got.collect()) == [(f"f{i}", f"answer to {t}") for i, t in enumerate(texts)]
    assert got.columns == [*asked.columns, "completion"]
    assert sorted(calls.read_text().split()) == ["a", "b", "c", "d"]
    # Another run pays for what is new; other numbers are another prompt.
    lg.complete_once(prompts(spark, ["a", "e"]), counting(str(calls)), book).collect()
    lg.complete_once(prompts(spark, ["a"]).withColumn("max_tokens", F.lit(9)), counting(str(calls)), book).collect()
    assert sorted(calls.read_text().split()) == ["a", "a", "b", "c", "d", "e"]


def test_a_task_that_runs_again_asks_for_the_rest_only(tmp_path):
    """The first attempt dies behind its second answer; the second goes on from there."""
    calls = tmp_path / "calls"
    rows = pd.DataFrame({"key": list("klmn"), "prompt": list("abcd")})
    book = lambda: lg.Journal(str(tmp_path / "journal"))
    with pytest.raises(RuntimeError):
        list(lg.answers(iter([rows]), counting(str(calls), fail_after=2), book))
    again = pd.concat(lg.answers(iter([rows[:2], rows[2:]]), counting(str(calls)), book))
    assert again["completion"].tolist() == [f"answer to {t}" for t in "abcd"]
    assert calls.read_text().split() == list("abcd")


def test_no_prompts(spark, tmp_path):
    got = lg.complete_once(prompts(spark, ["a"]).limit(0), counting(str(tmp_path / "calls")), str(tmp_path / "ledger"))
    assert got.count() == 0


# ---- publishing ---------------------------------------------------------------------


def test_both_tables_or_none(spark, tmp_path):
    folder = str(tmp_path / "out")
    good = spark.range(5)
    bad = spark.range(5).select(F.raise_error(F.lit("lost")).alias("x"))
    with pytest.raises(Exception, match="lost"):
        pub.publish(folder, {"report": good, "evidence": bad})
    for name in ("report", "evidence"):
        with pytest.raises(ValueError, match="not published"):
            pub.read_published(spark, folder, name)
    assert pub.publish(folder, {"report": good, "evidence": spark.range(3)}) == 0
    with pytest.raises(Exception, match="lost"):
        pub.publish(folder, {"report": spark.range(50), "evidence": bad})
    assert pub.read_published(spark, folder, "report").count() == 5
    assert pub.sweep(spark, folder) == 2 and pub.sweep(spark, folder) == 0
    assert pub.publish(folder, {"report": spark.range(7), "evidence": spark.range(8)}, "json") == 1
    assert [pub.read_published(spark, folder, n).count() for n in ("report", "evidence")] == [7, 8]
    assert pub.read_published(spark, folder, "evidence", 0).count() == 3
    with pytest.raises(ValueError):
        pub.publish(folder, {})


# ---- the shared folder ------------------------------------------------------------


class Elsewhere:
    """What ``checkpoint_ready`` asks a session on a cluster for."""

    def __init__(self, master, folder):
        self.folder, self.set = folder, None
        self.conf = self
        self.sparkContext = self
        self.master = master

    def get(self, name, default):
        return self.folder or default

    def getCheckpointDir(self):
        return self.set

    def setCheckpointDir(self, folder):
        self.set = folder


@pytest.mark.parametrize("master", ["yarn", "local-cluster[2,1,1024]", "spark://host:7077"])
def test_a_cluster_needs_a_shared_folder(master):
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        checkpoint_ready(Elsewhere(master, None))
    session = Elsewhere(master, "hdfs:///shared")
    checkpoint_ready(session)
    assert session.set == "hdfs:///shared"


@pytest.mark.parametrize("master", ["local", "local[4]", "local[*]"])
def test_one_process_has_a_folder_of_its_own(master):
    session = Elsewhere(master, None)
    checkpoint_ready(session)
    assert "lumenfold-checkpoint" in session.set
