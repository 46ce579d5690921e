import numpy as np
import pytest
from pyspark.sql import functions as F

from lumenfold.catalog.queries import QUERIES
from lumenfold.fixed import EMOTIONS, palette_rows
from lumenfold.operators import emotion as em


@pytest.fixture(scope="module")
def labelled(spark):
    """Label i of the first 12 occurs i + 1 times; the last two are equal."""
    rows, n = [], 0
    for i, label in enumerate(EMOTIONS[:12]):
        for _ in range(min(i, 10) + 1):
            rows.append((n, label))
            n += 1
    return spark.createDataFrame(rows, "id int, top_emotion string")


def test_codes_follow_the_labels_present(labelled):
    coded = em.emotion_code(labelled, em.label_counts(labelled))
    got = {r["top_emotion"]: r["code"] for r in coded.distinct().collect()}
    assert got == {e: i for i, e in enumerate(EMOTIONS[:12])}


def test_keep_dominant(labelled):
    counts = em.label_counts(labelled)
    total = labelled.count()
    assert em.keep_dominant(labelled, counts, threshold=total).count() == total
    kept = em.keep_dominant(labelled, counts, threshold=total - 1)
    assert {r[0] for r in kept.select("top_emotion").collect()} == set(EMOTIONS[2:12])


def test_unknown_label_is_an_error(spark):
    df = spark.createDataFrame([(1, "envy")], "id int, top_emotion string")
    with pytest.raises(Exception, match="unknown label"):
        em.label_counts(df).collect()


def test_palette_covers_every_label():
    assert [e for e, _ in palette_rows()] == sorted(EMOTIONS)
    assert len({c for _, c in palette_rows()}) == 27


def test_projection_matches_numpy(spark):
    """x, y, z are the leading principal components, the largest loading positive."""
    rng = np.random.default_rng(5)
    data = rng.normal(size=(80, 6)) * np.array([9, 5, 3, 1, 0.5, 0.1])
    rows = [(i, row.tolist()) for i, row in enumerate(data)]
    df = spark.createDataFrame(rows, "id int, v array<double>")
    placed = em.project_3d(df, "v").orderBy("id").select("x", "y", "z").toPandas().to_numpy()
    _, _, axes = np.linalg.svd(data - data.mean(0), full_matrices=False)
    signs = np.sign([a[abs(a).argmax()] for a in axes[:3]])
    want = (data - data.mean(0)) @ (axes[:3].T * signs)
    assert np.allclose(placed, want, atol=1e-8)
    assert em.project_3d(df.filter("id < 0"), "v").count() == 0
    assert placed.var(0)[0] >= placed.var(0)[1] >= placed.var(0)[2]


def test_plot_table(spark, folder):
    table = QUERIES["em_plot_table"](spark, folder)
    rows = table.collect()
    assert set(table.columns) == {
        "id", "text", "top_emotion", "code", "trimmed_text", "colour", "dot_size", "x", "y", "z",
    }
    labels = [r["top_emotion"] for r in rows]
    assert labels == sorted(labels)
    assert all(len(r["trimmed_text"]) <= 175 and r["colour"] for r in rows)
    flat = QUERIES["em_labels"](spark, folder)
    assert flat.count() == len(rows)
    assert table.filter(F.isnan("x") | F.col("x").isNull()).count() == 0


def test_posts_with_equal_ids_stay_two_rows(spark):
    from lumenfold.plans.emotion_map import labelled_posts
    from lumenfold.sources.readers import default_palette

    posts = spark.createDataFrame([("a", "good"), ("a", "bad"), ("b", "good")], "id string, body string")
    lexicon = spark.createDataFrame(
        [("good", "joy", 1.0), ("bad", "anger", 1.0)], "term string, emotion string, weight double"
    )
    rows = labelled_posts(posts, lexicon, default_palette(spark)).collect()
    assert sorted((r["id"], r["text"], r["top_emotion"]) for r in rows) == [
        ("a", "bad", "anger"), ("a", "good", "joy"), ("b", "good", "joy"),
    ]
