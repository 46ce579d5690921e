"""What is fitted or searched approximately: brute force, exact solutions and recall."""

import itertools
import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumenfold.fixed import EMOTIONS
from lumenfold.functions.vectors import term_buckets_sql
from lumenfold.operators import emotion as em
from lumenfold.operators import emotion_trained as et
from lumenfold.operators import keyword_index as ki
from lumenfold.operators import neighbour_graph as ng
from lumenfold.operators import semantic as sem
from lumenfold.operators import sentiment_rules as sr
from lumenfold.operators.filters import keyword_filter
from lumenfold.operators.neighbour_graph import knn_graph
from lumenfold.operators.neighbours import knn
from lumenfold.operators.scoring import emotion_scores, polarity

# ---- neighbour graph ----------------------------------------------------------


def brute_graph(rows, k):
    out = {}
    for i, v in rows:
        cost = sorted((sum((np.float64(a) - np.float64(b)) ** 2 for a, b in zip(v, w)), j) for j, w in rows if j != i)
        out[i] = [j for _, j in cost[:k]]
    return out


def lists(graph):
    out = {}
    for r in sorted(graph.collect(), key=lambda r: (r.id, r.rk)):
        out.setdefault(r.id, []).append(r.neighbour)
    return out


def test_graph_of_few_rows_is_exact(spark):
    rng = random.Random(1)
    rows = [(i, [float(rng.randrange(-4, 5)) for _ in range(5)]) for i in range(150)]
    rows += [(200 + i, rows[3][1]) for i in range(30)]
    df = spark.createDataFrame(rows + rows[:4] + [(None, [1.0] * 5), (999, None), (998, [])], "vec_id long, embedding array<float>")
    assert lists(knn_graph(df, k=6)) == brute_graph(rows, 6)


@pytest.mark.parametrize("n", [0, 1, 3])
def test_graph_of_hardly_any_rows(spark, n):
    df = spark.createDataFrame([(i, [float(i)]) for i in range(n)], "vec_id long, embedding array<float>")
    got = lists(knn_graph(df))
    assert got == ({} if n < 2 else {i: [j for _, j in sorted((abs(i - j), j) for j in range(n) if j != i)] for i in range(n)})


def test_graph_recall(spark):
    """Blocks of 64 in 2,000 vectors: every vector has k neighbours, nine in ten are right.
    A third of all rows are copies of one vector."""
    df = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").select("vec_id", "embedding")
    one = df.filter("vec_id = 7").select("embedding")
    copies = spark.range(100_000, 101_000).select(F.col("id").alias("vec_id"), F.lit(one.first()[0]).cast("array<float>").alias("embedding"))
    both = df.unionByName(copies)
    graph = knn_graph(both, block=64).cache()
    per = graph.groupBy("id").agg(F.count(F.lit(1)).alias("n"), F.min("rk"), F.max("rk")).select("n", "min(rk)", "max(rk)").distinct().collect()
    assert [tuple(r) for r in per] == [(8, 1, 8)] and graph.select("id").distinct().count() == 3000
    exact = knn(both)
    hit = exact.join(graph.select("id", "neighbour"), ["id", "neighbour"], "left_semi").count()
    assert hit >= 0.9 * exact.count()


def test_members_that_met_before_do_not_meet_again():
    """Only pairs with a new member, and only links that a row's list can still take."""
    rng = np.random.default_rng(4)
    v, ids, bar = rng.standard_normal((40, 6)), np.arange(40) * 3, rng.random(40) * 12
    bar[:5] = np.inf
    for share in (0.0, 0.1, 0.5, 1.0):
        new = rng.random(40) < share
        want = set()
        for a in range(40):
            near = sorted((np.square(v[a] - v[b]).sum(), ids[b]) for b in range(40) if b != a and (new[a] or new[b]))
            want |= {(ids[a], b, cost) for cost, b in near[:5] if cost <= bar[a]}
        batch = ng._links(ids, v, 5, new, bar)
        assert set(zip(*(batch.column(c).to_pylist() for c in ("c", "other", "cost")), strict=True)) == want


def test_a_round_without_new_links_changes_nothing(spark):
    rows = spark.createDataFrame([(i, [float(i), float(i * i % 7)]) for i in range(12)], "c long, v array<double>")
    links = [(i, (i + d) % 12, float(d), False) for i in range(12) for d in (1, 2)]
    graph = spark.createDataFrame(links, "c long, other long, cost double, new boolean")
    got = ng._refined(graph, rows, 2, 0, 4)
    assert sorted(map(tuple, got.select(graph.columns).collect())) == sorted(links)


# ---- supervised axes ------------------------------------------------------------


def separation(rows, axes):
    """Scatter between labels over scatter within, along some axes."""
    groups = {}
    for label, v in rows:
        groups.setdefault(label, []).append(np.array([np.dot(a, v) for a in axes]))
    centre = np.mean([x for g in groups.values() for x in g], axis=0)
    within = sum(((np.array(g) - np.mean(g, axis=0)) ** 2).sum(axis=0) for g in groups.values())
    between = sum(len(g) * (np.mean(g, axis=0) - centre) ** 2 for g in groups.values())
    return float((between / within).sum())


def test_fisher_axes_hold_labels_apart(spark):
    """Classes that differ in a direction of little variance: the principal axes miss it."""
    rng = np.random.default_rng(2)
    scale = np.array([9.0, 7.0, 5.0, 0.3, 0.3, 0.3, 0.2])
    rows = []
    for i in range(400):
        label = "abcd"[i % 4]
        v = rng.standard_normal(7) * scale
        v[3] += (i % 2) * 3
        v[4] += (i % 4 // 2) * 3
        rows.append((label, v.tolist()))
    df = spark.createDataFrame(rows, "label string, v array<double>")
    axes, centre = em.fisher_axes(df, "v", "label")
    pca = em.project_3d(df, "v")
    plane = np.linalg.lstsq(np.array([r[1] for r in rows]) - np.mean([r[1] for r in rows], axis=0), np.array([[r.x, r.y, r.z] for r in pca.collect()]), rcond=None)[0].T
    assert separation(rows, axes[:2]) > 20 * separation(rows, plane)
    assert centre == pytest.approx(np.mean([r[1] for r in rows], axis=0).tolist())
    x = np.array([r[1] for r in rows])
    labels = np.array([r[0] for r in rows])
    within = sum(np.cov(x[labels == c].T, bias=True) * (labels == c).mean() for c in "abcd")
    within += em.RIDGE * np.trace(within) / 7 * np.eye(7)
    a = np.array(axes)
    assert np.allclose(a @ within @ a.T, np.eye(3), atol=1e-8)


def test_fisher_axes_of_one_label_or_none(spark):
    df = spark.createDataFrame([("a", [1.0, 2.0]), ("a", [2.0, 1.0])], "label string, v array<double>")
    assert [tuple(r) for r in em.project_by_label(df, "v", "label").select("x", "y", "z").collect()] == [(0.0, 0.0, 0.0)] * 2
    assert em.project_by_label(df.limit(0), "v", "label").columns == ["label", "v", "x", "y", "z"]


# ---- semantic encoder -----------------------------------------------------------


def topics(n, seed):
    """Texts of four topics, each with its own words; any two texts share few."""
    rng = random.Random(seed)
    return [(i, " ".join(f"{'abcd'[i % 4]}word{rng.randrange(30)}" for _ in range(6))) for i in range(n)]


def dense(spark, df, model):
    rows = sem._buckets(df, "text", len(model.idf), model.cleaned, ["id"]).orderBy("id").toArrow()
    column = rows.column("b").combine_chunks()
    row, bucket, w = sem.weights(column, model.idf)
    out = np.zeros((rows.num_rows, len(model.idf)))
    out[row, bucket] = w
    return out


def test_texts_are_hashed_once_for_fit_and_encoder(spark):
    """Buckets as the SQL expression has them; places from them are those from the texts, and
    rounded in the task as Spark rounds them."""
    odd = [(900, None), (901, ""), (902, " ... "), (903, "Ünï a a B b ß 123 日本 a")]
    df = spark.createDataFrame(topics(300, 3) + odd, "id long, text string").repartition(5)
    for cleaned in (False, True):
        want = df.select("id", F.expr(f"coalesce({term_buckets_sql('text', 512, cleaned)}, array())").alias("b"))
        assert sorted(map(tuple, sem._buckets(df, "text", 512, cleaned, ["id"]).collect())) == sorted(map(tuple, want.collect()))
    hashed = sem.hashed_texts(df, ["id"], "text", buckets=512)
    model = sem.fit_semantic(hashed, "text", buckets=512, dims=8, spare=8)
    plain = sem.fit_semantic(df, "text", buckets=512, dims=8, spare=8)
    assert np.allclose(model.basis, plain.basis, atol=1e-9) and np.array_equal(model.idf, plain.idf)
    texts = sem.encode_semantic(df, ["id"], "text", model)
    rounded = texts.withColumn("embedding", F.transform("embedding", lambda x: F.round(x, 6) + 0.0))
    got = sem.encode_semantic(hashed, ["id"], "text", model, 6)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, rounded.collect()))
    halves = [0.0000005, -0.0000005, 0.1234565, 0.1234575, -0.9999995, 1.0, 0.0, -0.0, 0.3000004999]
    spark_rounds = spark.createDataFrame([(x,) for x in halves], "x double").select(F.round("x", 6) + 0.0).collect()
    assert [str(x) for x in sem._rounded(np.array(halves), 6)] == [str(r[0]) for r in spark_rounds]


def test_range_finder_against_exact_svd(spark):
    df = spark.createDataFrame(topics(300, 3) + [(900, None), (901, ""), (902, "...")], "id long, text string").repartition(5)
    model = sem.fit_semantic(df, "text", buckets=512, dims=8, spare=8)
    a = dense(spark, df, model)
    assert np.allclose(np.linalg.norm(a, axis=1), [1.0] * 300 + [0.0] * 3)
    assert np.allclose(model.basis.T @ model.basis, np.eye(8), atol=1e-9)
    left = np.linalg.norm(a - a @ model.basis @ model.basis.T) ** 2
    values = np.linalg.svd(a, compute_uv=False)
    best = (values[8:] ** 2).sum()
    assert best <= left + 1e-9 and left <= 1.05 * best
    assert model.shares == pytest.approx(((a @ model.basis) ** 2).sum(axis=0) / 300, rel=0.05)
    placed = {r.id: r.embedding for r in sem.encode_semantic(df, ["id"], "text", model).collect()}
    assert np.allclose([placed[i] for i in range(300)], a[:300] @ model.basis)
    assert placed[900] == placed[901] == [0.0] * 8
    # Idf by its definition.
    used = (a > 0).sum(axis=0)
    assert model.idf == pytest.approx([math.log(301 / (1 + k)) + 1 for k in used])


def test_texts_of_a_topic_are_close_without_shared_words(spark):
    df = spark.createDataFrame(topics(2000, 4), "id long, text string")
    model = sem.fit_semantic(df, "text", buckets=1024, dims=4, spare=8)
    asked = spark.createDataFrame([(0, "aword1 aword2"), (1, "aword3 aword4"), (2, "bword1 bword2")], "id long, text string")
    v = {r.id: np.array(r.embedding) for r in sem.encode_semantic(asked, ["id"], "text", model).collect()}
    cos = lambda x, y: x @ y / np.linalg.norm(x) / np.linalg.norm(y)
    assert cos(v[0], v[1]) > 0.8 > 0.2 > abs(cos(v[0], v[2]))
    seeds = spark.createDataFrame([("a", "aword5 aword6"), ("b", "bword5")], "facet string, text string")
    best = sem.semantic_evidence(df, ["id"], "text", seeds, model, 20).collect()
    assert all(r.text.startswith(r.facet) for r in best) and len(best) == 40


def test_semantic_of_nothing(spark):
    df = spark.createDataFrame([], "id long, text string")
    model = sem.fit_semantic(df, "text", buckets=64, dims=4, spare=4)
    assert not model.basis.any()
    one = spark.createDataFrame([(1, "word")], "id long, text string")
    assert sem.encode_semantic(one, ["id"], "text", model).first().embedding == [0.0] * 4


# ---- sentiment rules ------------------------------------------------------------

WORDS = {"good": (0.7, 0.6), "bad": (-0.7, 0.66), "fine": (0.4, 0.5), "awful": (-1.0, 1.0)}
RULES = {"not": None, "never": None, "very": 1.3, "slightly": 0.5}


def brute_rules(text):
    p = s = n = 0
    boost, reach = 1.0, 0
    for w in (text or "").lower().split():
        if w in RULES and RULES[w] is None:
            boost, reach = 1.0, sr.REACH
        elif w in RULES:
            boost *= RULES[w]
        elif w in WORDS:
            a, b = WORDS[w]
            p += max(-1.0, min(1.0, a * boost * (sr.TURNED if reach > 0 else 1.0)))
            s += min(1.0, b * boost)
            n += 1
            boost, reach = 1.0, 0
        else:
            boost, reach = 1.0, max(0, reach - 1)
    return (p / n, s / n) if n else (0.0, 0.0)


def test_rules_by_brute_force(spark):
    rng = random.Random(6)
    some = [*WORDS, *RULES, "x", "y", "z"]
    texts = [None, "", "not good", "not a b good", "not a b c good", "very very good", "not very good and bad", "very x good", "awful very awful"]
    texts += [" ".join(rng.choices(some, k=rng.randrange(30))) for _ in range(300)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(2, "not good"), (2, "not good")], "id long, text string")
    lexicon = spark.createDataFrame([(w, *v) for w, v in WORDS.items()] + [("very", 0.2, 0.2)], "term string, polarity double, subjectivity double")
    rules = spark.createDataFrame(list(RULES.items()), "term string, factor double")
    got = sr.ruled_scores(df, ["id"], "text", lexicon, rules).collect()
    assert len(got) == len(texts) + 2
    for r in got:
        assert (r.polarity, r.subjectivity) == pytest.approx(brute_rules(texts[r.id]), abs=1e-12), texts[r.id]
    by = {t: brute_rules(t)[0] for t in ("not good", "very very good")}
    assert by["not good"] == -0.35 and by["very very good"] == 1.0


def test_rules_are_looked_up_where_the_text_is(spark):
    """A lexicon that can be broadcast takes no shuffle of words; a larger one, a term twice and
    a missing weight take the join. Scores are the same to the last bit."""
    rng = random.Random(8)
    some = [*WORDS, *RULES, "x", "y"]
    rows = [(i % 9, " ".join(rng.choices(some, k=rng.randrange(30)))) for i in range(200)] + [(None, None), (1, ""), (1, "")]
    df = spark.createDataFrame(rows, "id long, text string").repartition(3)
    lexicon = spark.createDataFrame([(w, *v) for w, v in WORDS.items()], "term string, polarity double, subjectivity double")
    rules = spark.createDataFrame(list(RULES.items()), "term string, factor double")

    def found(words, **more):
        scores = sr.ruled_scores(df, ["id"], "text", words, rules, **more)
        plan = scores._jdf.queryExecution().executedPlan().toString()
        return plan, sorted(map(tuple, scores.collect()), key=str)

    plan, near = found(lexicon)
    assert "hashpartitioning(_text" not in plan and "MapInArrow" in plan
    plan, joined = found(lexicon, max_rows=1)
    assert "MapInArrow" not in plan and near == joined
    odd = lexicon.unionByName(spark.createDataFrame([("good", 0.1, 0.1), ("x", None, 0.5)], lexicon.schema))
    assert "MapInArrow" not in found(odd)[0]


def test_scores_do_not_depend_on_the_order_of_rows(spark):
    """Texts are known by themselves, not by a number that a second read may deal anew."""
    rows = [(i % 3, t) for i, t in enumerate(["good", "bad good", "", None, "good", "x fine"] * 3)]
    lexicon = spark.createDataFrame([(w, *v) for w, v in WORDS.items()], "term string, polarity double, subjectivity double")
    labels = spark.createDataFrame([("good", "joy", 0.5), ("bad", "anger", 0.25)], "term string, emotion string, weight double")
    rng, seen = random.Random(1), []
    for _ in range(3):
        df = spark.createDataFrame(rows, "id long, text string").repartition(rng.randrange(1, 6))
        scored = polarity(df, ["id"], "text", lexicon)
        felt = emotion_scores(df, ["id"], "text", labels)
        plan = felt._jdf.queryExecution().toString() + scored._jdf.queryExecution().toString()
        assert "monotonically" not in plan
        seen.append((sorted(map(str, scored.collect())), sorted(map(str, felt.collect()))))
        rng.shuffle(rows)
    assert seen[0] == seen[1] == seen[2] and len(seen[0][0]) == len(seen[0][1]) == len(rows)


# ---- trained classifier ---------------------------------------------------------


def test_classifier_beats_the_lexicon(spark):
    """Every label has forty words, of which the lexicon knows ten."""
    rng = random.Random(9)
    labels = EMOTIONS[:9]
    words = {e: [f"{e[:4]}{i}" for i in range(40)] for e in labels}
    common = [f"c{i}" for i in range(50)]
    rows = []
    for i in range(1500):
        label = labels[i % 9]
        rows.append((i, " ".join(rng.choices(words[label], k=2) + rng.choices(common, k=6)), label))
    df = spark.createDataFrame(rows + [(5000, None, "joy"), (5001, "", None)], "id long, text string, label string")
    lexicon = spark.createDataFrame([(w, e, 1.0) for e in labels for w in words[e][:10]], "term string, emotion string, weight double")
    model = et.fit_emotions(df.filter("id % 5 <> 1"), "text", "label", dims=1024)
    held = df.filter("id % 5 = 1 and id < 5000")
    right = lambda scored: scored.join(held, "id").filter("top_emotion = label").count() / held.count()
    trained = em.top_emotion(et.trained_scores(held, ["id"], "text", model))
    known = em.top_emotion(emotion_scores(held, ["id"], "text", lexicon))
    assert right(trained) > 0.85 and right(trained) > right(known) + 0.2
    scored = et.trained_scores(df, ["id"], "text", model).collect()
    assert len(scored) == len(rows) + 2
    assert all(abs(sum(r.score) - 1) < 1e-9 and r.emotion == sorted(EMOTIONS) for r in scored)
    assert {r.top_emotion for r in em.top_emotion(et.trained_scores(df, ["id"], "text", model)).collect()} <= set(labels)


def test_classifier_counts_words(spark):
    df = spark.createDataFrame([("a b a c a",), ("",), (None,)], "text string")
    got = [r.c for r in df.select(F.expr(et._counts("text", 64)).alias("c")).collect()]
    assert sorted(got[0])[-3:] == [1.0, 1.0, 3.0] and sum(got[0]) == 5 and not any(got[1] + got[2])


def test_classifier_without_rows(spark):
    df = spark.createDataFrame([], "text string, label string")
    model = et.fit_emotions(df, "text", "label", dims=8)
    one = spark.createDataFrame([(1, "x")], "id long, text string")
    assert set(et.trained_scores(one, ["id"], "text", model).first().score) == {1 / len(EMOTIONS)}


# ---- keyword index ----------------------------------------------------------------

TEXTS = [
    "The cat sat, by the door.",
    "by\nthe: cat",
    "THE",
    "the the cat by",
    "Größe 日本 x2",
    "c++ and c#",
    "c and c",
    "",
    None,
    "cat. Cat! by-the-cat the",
]
EXPRESSIONS = [
    "cat",
    "the AND cat",
    "'by the'",
    "by AND the OR door",
    "'the cat by'",
    "\"by the cat\" OR größe",
    "日本 x2",
    "c++",
    "'the the' OR 'cat cat'",
    "missing",
    "'missing the' OR cat",
    "by-the-cat",
]


def written(spark, tmp_path, rows, name):
    df = spark.createDataFrame(rows, "id long, text string")
    path = str(tmp_path / name)
    ki.write_index(df, "id", "text", path)
    return df, path


def test_index_finds_what_the_filter_keeps(spark, tmp_path):
    rng = random.Random(5)
    rows = [(i * 700 - 1500, t) for i, t in enumerate(TEXTS)]
    some = ["the", "cat", "by", "door", "a1"]
    rows += [(10_000 + i, " ".join(rng.choices(some, k=rng.randrange(12)))) for i in range(3000)]
    df, path = written(spark, tmp_path, rows, "index")
    more = [" ".join(rng.choice(["the", "cat", "'by the'", "door", "'cat a1 the'"]) + rng.choice(["", " AND", " OR"]) for _ in range(3)) + " by" for _ in range(6)]
    for expression in EXPRESSIONS + more:
        got = sorted(r.id for r in ki.matching(df, "id", path, expression, "text").collect())
        assert got == sorted(r.id for r in keyword_filter(df, expression, "text").collect()), expression


def test_index_reads_the_folders_of_its_terms(spark, tmp_path):
    df, path = written(spark, tmp_path, [(i, f"word{i % 40} the") for i in range(4000)], "index")
    some = ki.read_postings(spark, path, ["word7"])
    scan = next(line for line in some._jdf.queryExecution().toString().splitlines() if "FileScan parquet" in line)
    (asked,) = {r.folder for r in some.select("folder").distinct().collect()}
    # The scan is told the folder, and the terms go to the files' statistics.
    assert f"PartitionFilters: [isnotnull(folder" in scan and f"= {asked})" in scan and "PushedFilters: [IsNotNull(term), EqualTo(term,word7)]" in scan
    assert spark.read.parquet(path).select("folder").distinct().count() > 20
    # A word in every document is many lists of bounded length, coded as differences.
    lists = ki.read_postings(spark, path, ["the"]).collect()
    assert len(lists) == 4 and all(len(r.docs) <= ki.SEGMENT for r in lists)
    assert all(max(r.docs[1:]) == 1 for r in lists)


def test_index_of_nothing(spark, tmp_path):
    df, path = written(spark, tmp_path, [(1, None), (None, "cat"), (2, "")], "index")
    assert ki.postings(df, "id", "text").count() == 0
    with pytest.raises(ValueError, match="no words"):
        ki.search(spark, path, "+++")


def test_deltas_turn_back(spark):
    rng = random.Random(3)
    lists = [[], [5], sorted(rng.sample(range(1000), 50)), [-3, 0, 7]]
    df = spark.createDataFrame([(x,) for x in lists], "x array<bigint>")
    first = F.lit(-10).cast("long")
    back = df.select(ki._sums(ki._deltas(F.col("x"), first), first).alias("y"))
    assert [r.y for r in back.collect()] == lists


def test_pairs_of_terms_have_all_orders():
    """The parser's alternatives stay as they were."""
    from lumenfold.operators.filters import parse_keywords

    assert parse_keywords("a AND 'b c' OR d e") == [["a", "b c"], ["d", "e"]]
    assert [len(parse_keywords(" OR ".join(p))) for p in itertools.permutations("abc")] == [3] * 6
    with pytest.raises(ValueError):
        parse_keywords("AND OR")


def test_postings_by_brute_force_and_with_one_shuffle(spark):
    texts = [(3, "a b a"), (3, "b c a"), (-1, "a"), (5000, "c. A"), (1024, "a a"), (1023, "b"), (None, "a"), (9, None), (7, "a")]
    texts += [(10 + i, "often") for i in range(700)]
    found = ki.postings(spark.createDataFrame(texts, "id long, text string"), "id", "text")
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange ") == 1 and "rangepartitioning" in plan  # no second one to sort the table
    want = {}
    for doc, text in texts:
        for place, word in enumerate(re.findall(r"\w+", (text or "").lower()) if doc is not None else []):
            want.setdefault((word, doc // 1024), {}).setdefault(doc, set()).add(place)
    deltas = lambda values, first: [b - a for a, b in zip([first, *values], values, strict=False)]
    want = {
        (word, segment): (deltas(sorted(docs), segment * 1024), [deltas(sorted(docs[d]), 0) for d in sorted(docs)])
        for (word, segment), docs in want.items()
    }
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "5")  # lists go on over batches
    try:
        rows = found.collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert {(r["term"], r["segment"]): (r["docs"], r["places"]) for r in rows} == want and len(rows) == len(want)
