"""Top-k, scoring and neighbours against brute force on small fixtures."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumenfold.functions.vectors import cosine_dense, first_max
from lumenfold.operators import lookups
from lumenfold.operators.neighbours import knn, nearest, search
from lumenfold.operators.ranking import evidence_lists, topk, union_batches
from lumenfold.operators.scoring import (
    emotion_scores,
    lexicon_scores,
    score_dense,
    score_sparse,
    source_centroids,
)
from lumenfold.plans.evidence import clean_sentences, pestle_articles, swot_articles
from lumenfold.sources import adapters as ad


def test_topk_is_exact_with_a_hot_group(spark):
    rng = random.Random(1)
    rows = [("hot" if i % 3 else f"g{i % 5}", i, rng.randrange(200)) for i in range(5000)]
    df = spark.createDataFrame(rows, "facet string, id int, sim int").repartition(16)
    order = [F.desc("sim"), F.col("id")]
    want = set()
    for g in {r[0] for r in rows}:
        best = sorted((r for r in rows if r[0] == g), key=lambda r: (-r[2], r[1]))[:7]
        want |= {(*r, rk) for rk, r in enumerate(best, 1)}
    for salted in (True, False):
        got = {tuple(r) for r in topk(df, 7, order, salted=salted).collect()}
        assert got == want


def test_topk_plan_prunes_before_the_shuffle(spark, folder):
    best = swot_articles(ad.articles(spark, folder), ad.swot_seeds(spark, folder))
    plan = best._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 4
    assert "Python" not in plan
    assert "Join" not in plan and "CartesianProduct" not in plan


def test_distinct_evidence(spark, folder):
    best = pestle_articles(ad.articles(spark, folder), ad.pestle_seeds(spark, folder))
    rows = best.collect()
    assert len({(r["facet"], r["text"]) for r in rows}) == len(rows)
    for facet in {r["facet"] for r in rows}:
        assert sum(r["facet"] == facet for r in rows) <= 60
    assert all(0 <= r["sim"] <= 1 + 1e-12 for r in rows)


def test_evidence_keeps_rank_order(spark):
    rows = [("a", 2, "y"), ("a", 1, "x"), ("b", 1, "z")]
    df = spark.createDataFrame(rows, "facet string, rk int, t string")
    got = {r["facet"]: r["evidence"] for r in evidence_lists(df, "t").collect()}
    assert got == {"a": ["x", "y"], "b": ["z"]}


def test_cosine_dense(spark):
    df = spark.createDataFrame(
        [([1.0, 0.0], [0.0, 0.0]), ([1.0, 2.0], [2.0, 4.0]), ([1.0, 0.0], [0.0, 3.0])],
        "a array<float>, b array<float>",
    )
    both = df.select(cosine_dense("a", "b").alias("x"), cosine_dense("b", "a").alias("y"))
    got = both.collect()
    assert [round(r["x"], 12) for r in got] == [0.0, 1.0, 0.0]
    assert all(r["x"] == r["y"] for r in got)


def test_first_of_equal_scores_wins(spark):
    row = (["anger", "fear", "joy"], [0.4, 0.1, 0.4])
    df = spark.createDataFrame([row], "e array<string>, s array<double>")
    assert df.select(first_max("s", "e")).first()[0] == "anger"


def test_lexicon_beyond_the_broadcast_bound(spark, folder, monkeypatch):
    """The salted shuffle join gives the same scores as the broadcast."""
    sentences = clean_sentences(ad.articles(spark, folder))
    lexicon = ad.sentiment_lexicon(spark, folder)
    ids = ["article_id", "pos"]
    small = lexicon_scores(sentences, ids, "text", lexicon)
    monkeypatch.setattr(lookups.lookup_join, "__defaults__", ("left", 10))
    large = lexicon_scores(sentences, ids, "text", lexicon)
    plan = large._jdf.queryExecution().executedPlan().toString()
    assert "_salt" in plan
    assert small.exceptAll(large).count() == 0 == large.exceptAll(small).count()


def test_lexicon_means(spark):
    """Weights finer than hundredths count; a text without known words scores 0."""
    texts = spark.createDataFrame(
        [(1, "good, good bad other"), (2, "other"), (3, "")], "id int, t string"
    )
    lexicon = spark.createDataFrame(
        [("good", 0.136364, 0.5), ("bad", -0.7, 1.0)],
        "term string, polarity double, subjectivity double",
    )
    got = {r["id"]: r for r in lexicon_scores(texts, ["id"], "t", lexicon).collect()}
    assert got[1]["polarity"] == pytest.approx((2 * 0.136364 - 0.7) / 3, abs=1e-12)
    assert got[1]["subjectivity"] == pytest.approx(2 / 3, abs=1e-12)
    assert [(got[i]["polarity"], got[i]["subjectivity"]) for i in (2, 3)] == [(0.0, 0.0)] * 2

    moods = spark.createDataFrame(
        [("good", "joy", 0.125), ("bad", "anger", 0.3)],
        "term string, emotion string, weight double",
    )
    scored = emotion_scores(texts, ["id"], "t", moods, ["joy", "anger", "fear"])
    rows = {r["id"]: r for r in scored.collect()}
    assert rows[1]["emotion"] == ["anger", "fear", "joy"]
    assert rows[1]["score"] == [0.3, 0.0, 0.25]
    assert rows[3]["score"] == [0.0, 0.0, 0.0]


def test_any_number_of_facets(spark):
    rng = np.random.default_rng(5)
    x, y = rng.normal(size=(30, 3)), rng.normal(size=(200, 3))
    vectors = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id int, v array<double>")
    facets = spark.createDataFrame(
        [(f"f{i}", v.tolist()) for i, v in enumerate(y)], "facet string, embedding array<double>"
    )
    got = {(r["id"], r["facet"]): r["sim"] for r in score_dense(vectors, ["id"], "v", facets).collect()}
    cos = x @ y.T / np.linalg.norm(x, axis=1)[:, None] / np.linalg.norm(y, axis=1)
    assert len(got) == 6000
    assert all(abs(got[i, f"f{j}"] - cos[i, j]) < 1e-12 for i in range(30) for j in range(200))


def test_many_sparse_facets_equal_few(spark):
    texts = spark.createDataFrame([(i, f"w{i} w{i + 1} common") for i in range(40)], "id int, t string")
    seeds = spark.createDataFrame([(f"f{i}", f"w{i} common") for i in range(150)], "facet string, text string")
    many = {(r["id"], r["facet"]): r["sim"] for r in score_sparse(texts, ["id"], "t", seeds).collect()}
    few = score_sparse(texts, ["id"], "t", seeds.limit(20)).collect()
    assert len(many) == 6000 and len(few) == 800
    assert all(many[r["id"], r["facet"]] == r["sim"] for r in few)


def test_union_fills_missing_columns(spark):
    a = spark.createDataFrame([(1, "x")], "id int, a string")
    b = spark.createDataFrame([(2, "y")], "id int, b string")
    rows = [tuple(r) for r in union_batches(a, b).orderBy("id").collect()]
    assert rows == [(1, "x", None), (2, None, "y")]


def brute_neighbours(ids, vectors, k):
    v = np.asarray(vectors, dtype="float32").astype("float64")
    want = {}
    for i, x in enumerate(v):
        d = ((v - x) ** 2).sum(1)
        order = sorted((d[j], ids[j]) for j in range(len(ids)) if j != i)[:k]
        want[ids[i]] = [(j, r) for r, (_, j) in enumerate(order, 1)]
    return want


@pytest.mark.parametrize("shape", ["clusters", "copies", "all_equal", "few"])
def test_knn_is_exact(spark, shape):
    rng = np.random.default_rng(3)
    if shape == "clusters":
        v = np.repeat(rng.normal(size=(6, 4)) * 40, 50, axis=0) + rng.normal(size=(300, 4))
    elif shape == "copies":
        v = rng.normal(size=(120, 3))
        v[::3] = v[0]  # a third of all rows are one vector
        v[1::4] = v[1]
    elif shape == "all_equal":
        v = np.ones((40, 3))
    else:
        v = rng.normal(size=(5, 3))
    ids = [int(i) * 7 for i in rng.permutation(len(v))]
    rows = [(i, [float(x) for x in vec]) for i, vec in zip(ids, v)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = {}
    for r in knn(df, k=8, every=1).collect():
        got.setdefault(r["id"], []).append((r["neighbour"], r["rk"]))
    got = {i: sorted(n, key=lambda t: t[1]) for i, n in got.items()}
    assert got == brute_neighbours(ids, v, 8)


def test_search_in_small_blocks_and_slices(spark, folder):
    rows = ad.vectors(spark, folder).selectExpr("vec_id as id", "embedding as v")
    some = rows.filter("id % 3 = 0")
    one, many = search(some, rows, 8), search(some, rows, 8, block=10, slice_=100)
    assert one.count() == 8 * some.count()
    assert one.exceptAll(many).count() == 0
    assert {tuple(r) for r in knn(ad.vectors(spark, folder)).select("id").distinct().collect()} == {
        (i,) for i in range(0, 500, 50)
    }


def test_nearest_outlets_with_zeros_and_ties(spark):
    """One path for every size: blocks of three give what brute force gives."""
    v = {"a": [1, 0], "b": [2, 2], "c": [0, 0], "d": [3, 0], "e": [1, 1], "f": [-1, 0], "g": [0, 1]}
    rows = [(s, [float(x) for x in xs]) for s, xs in v.items()]
    df = spark.createDataFrame([*rows, ("none", None)], "s string, v array<double>")

    def cos(x, y):
        n = math.hypot(*x) * math.hypot(*y)
        return (x[0] * y[0] + x[1] * y[1]) / n if n else 0.0

    want = {
        (s, o, rk)
        for s in v
        for rk, (_, o) in enumerate(sorted((-round(cos(v[s], v[o]), 9), o) for o in v if o != s)[:4], 1)
    }
    for block in (3, 8192):
        got = nearest(df, "s", "v", 4, block, block).collect()
        assert {(r["source"], r["similar"], r["rk"]) for r in got} == want
    assert {round(r["sim"], 9) for r in got if r["source"] == "c"} == {0.0}


def test_centroids(spark):
    rows = [("a", [1.0, 3.0]), ("a", [3.0, 5.0]), ("b", [0.0, 1.0])]
    df = spark.createDataFrame(rows, "s string, v array<float>")
    got = {r["s"]: r["embedding"] for r in source_centroids(df, "s", "v").collect()}
    assert got == {"a": [2.0, 4.0], "b": [0.0, 1.0]}
    assert not any(math.isnan(x) for v in got.values() for x in v)


def test_equal_ids_stay_two_rows(spark):
    texts = spark.createDataFrame([(1, "good"), (1, "bad"), (1, "bad")], "id int, t string")
    lexicon = spark.createDataFrame(
        [("good", 1.0, 0.5), ("bad", -1.0, 1.0)], "term string, polarity double, subjectivity double"
    )
    got = sorted(r["polarity"] for r in lexicon_scores(texts, ["id"], "t", lexicon).collect())
    assert got == [-1.0, -1.0, 1.0]
    moods = spark.createDataFrame([("good", "joy", 1.0)], "term string, emotion string, weight double")
    scored = emotion_scores(texts, ["id"], "t", moods, ["joy"]).collect()
    assert sorted(r["score"][0] for r in scored) == [0.0, 0.0, 1.0]


def test_unknown_emotion_labels_are_an_error(spark):
    texts = spark.createDataFrame([(1, "good")], "id int, t string")
    moods = spark.createDataFrame([("good", "bliss", 1.0)], "term string, emotion string, weight double")
    with pytest.raises(Exception, match="unknown label"):
        emotion_scores(texts, ["id"], "t", moods, ["joy"]).collect()


def test_scores_of_vectors_are_those_of_the_expression(spark):
    """Zeros, gaps, other lengths and NaN among the vectors; a task scores many rows at a time."""
    from pyspark.sql import functions as F

    from lumenfold.functions.vectors import cosine_dense

    nan = float("nan")
    rows = [[1.0, 2.0, 0.5], [0.0, 0.0, 0.0], None, [], [1.0], [1.0, None, 3.0], [nan, 1.0, 1.0], [0.1, 0.2, 0.3], [0.0]]
    df = spark.createDataFrame(list(enumerate(rows)), "id int, v array<double>").coalesce(1)
    facets = spark.createDataFrame([("a", [0.3, 0.1, 0.7]), ("b", [0.0, 0.0, 0.0]), ("c", None), (None, [1.0])], "facet string, embedding array<double>")
    scored = score_dense(df, ["id"], "v", facets)
    assert "MapInArrow" in scored._jdf.queryExecution().executedPlan().toString()
    want = df.crossJoin(facets).select("id", "facet", cosine_dense(F.col("v"), F.col("embedding")).alias("sim"))
    assert sorted(map(repr, scored.collect())) == sorted(map(repr, want.collect()))


def test_best_scores_keep_every_equal_one(spark):
    texts = [(i, "sun sea") for i in range(40)] + [(40 + i, f"word{i} stone") for i in range(40)] + [(80, None), (81, "")]
    df = spark.createDataFrame(texts, "id int, t string").coalesce(1)
    seeds = spark.createDataFrame([("a", "sun"), ("b", "stone")], "facet string, text string")
    every = {(r["id"], r["facet"]): r["sim"] for r in score_sparse(df, ["id"], "t", seeds).collect()}
    few = {(r["id"], r["facet"]): r["sim"] for r in score_sparse(df, ["id"], "t", seeds, best=3).collect()}
    assert len(every) == 164 and len(few) < 164
    assert all(every[k] == v for k, v in few.items())
    for facet in "ab":
        bar = sorted(v for (_, f), v in every.items() if f == facet)[-3]
        assert {k for k, v in every.items() if k[1] == facet and v >= bar} == {k for k in few if k[1] == facet}
