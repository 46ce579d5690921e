"""Every registered query: name → function of (session, table folder)."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenfold.fixed import EMOTIONS, PAGE_SIZE, PESTLE_K, SWOT_ARTICLES_K
from lumenfold.functions import text as tx
from lumenfold.functions.vectors import dot_buckets_sql, first_max, term_buckets_sql
from lumenfold.operators import emotion as em
from lumenfold.operators import filters as fl
from lumenfold.operators import ranking as rk
from lumenfold.operators import scoring as sc
from lumenfold.operators import keyword_index as ki
from lumenfold.operators import semantic as sem
from lumenfold.operators.emotion_trained import fit_emotions, trained_scores
from lumenfold.operators.lookups import small_literal
from lumenfold.operators.models import emotion_model, encode_model
from lumenfold.operators.neighbour_graph import knn_graph as graph_of
from lumenfold.operators.neighbours import knn, nearest
from lumenfold.operators.sentiment_rules import ruled_scores
from lumenfold.plans import emotion_map as maps
from lumenfold.plans import evidence as ev
from lumenfold.plans import reports as rp
from lumenfold.plans import reviews as rv
from lumenfold.plans import tables as tb
from lumenfold.sources import adapters as ad
from lumenfold.session import checkpoint_ready
from lumenfold.sources import publish as pub
from lumenfold.sources import readers, sinks
from lumenfold.streaming import feeds as fd
from lumenfold.streaming import newest as nw

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

# Request parameters of the registered queries; the oracle uses the same ones.
KEYWORDS = "the AND of OR 'by the'"
SOURCES = "src1, src3,src5 , src7,src9,src11"
SINCE, UNTIL = "2024-01-08", "2024-01-29"
TODAY = "2024-01-20"
GROUPS = ["business", "science"]
USER = "@user8"
TAGS = "click, #error ,purchase"
COMMUNITY = "sub3"
SUBJECT = "renewable energy"
POST_LIMIT = 25
TWEET_LIMIT = 200
THRESHOLD = 100
SIM_DIGITS = 6


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


# ---- sources ---------------------------------------------------------------


@query
def src_articles(spark, folder):
    """Articles packed into search pages of 100, landed as JSON, read back."""
    a = ad.articles(spark, folder)
    pages = a.groupBy(F.expr(f"article_id div {PAGE_SIZE}").alias("page")).agg(
        F.collect_list(F.struct(*a.columns)).alias("articles")
    )
    return readers.articles_from_json(
        pages.select(F.to_json(F.struct("page", "articles")).alias("value"))
    )


def _post_json(posts: DataFrame) -> DataFrame:
    """Posts as the feed sends them: absent keys instead of NULLs."""
    return posts.select(
        F.to_json(
            F.struct(
                F.col("type").alias("_type"),
                "author",
                "body",
                F.col("created").cast("string").alias("created"),
                "id",
                F.col("parent_id").alias("parentId"),
                "subreddit",
                "url",
            )
        ).alias("value")
    )


@query
def src_posts_json(spark, folder):
    return readers.posts_from_json(_post_json(ad.posts(spark, folder)))


@query
def src_tweets(spark, folder):
    t = ad.tweets(spark, folder)
    items = t.select(
        F.to_json(
            F.struct(
                F.col("ts").cast("string").alias("date"),
                F.col("tweet_id").alias("id"),
                F.col("text").alias("content"),
                F.struct("username").alias("user"),
                "is_retweet",
                "is_reply",
            )
        ).alias("value")
    )
    return readers.tweets_from_json(items)


@query
def src_similarity_long(spark, folder):
    """Outlet centroids with the means of six classes of vectors as a wide matrix → long form."""
    vectors = ad.vectors(spark, folder)
    centroids = sc.source_centroids(vectors, "label", "embedding")
    facets = sc.source_centroids(vectors.withColumn("facet", F.col("vec_id") % 6), "facet", "embedding")
    long = sc.score_dense(centroids, ["label"], "embedding", facets)
    wide = long.groupBy("label").pivot("facet", list(range(6))).agg(F.first("sim"))
    return readers.unpivot_similarity(wide, "label").select(
        "src_a", "src_b", F.round("sim", SIM_DIGITS).alias("sim")
    )


# ---- filters ---------------------------------------------------------------


@query
def kw_title(spark, folder):
    return fl.keyword_filter(ad.articles(spark, folder), KEYWORDS, "title").select(
        "article_id", "title"
    )


@query
def kw_phrase(spark, folder):
    """OR and AND inside quotes are words; a phrase crosses line breaks and marks."""
    found = fl.keyword_filter(ad.articles(spark, folder), "'the OR and' OR of \"and the\"", "summary")
    return found.select("article_id", "title")


@query
def kw_summary(spark, folder):
    return fl.keyword_filter(ad.articles(spark, folder), KEYWORDS, "summary").select(
        "article_id", "source"
    )


@query
def flt_lang(spark, folder):
    return fl.lang_filter(ad.articles(spark, folder), "en").select("article_id", "lang")


@query
def flt_country(spark, folder):
    return fl.country_filter(ad.articles(spark, folder), "us").select(
        "article_id", "country"
    )


@query
def flt_sources(spark, folder):
    return fl.source_filter(ad.articles(spark, folder), SOURCES).select(
        "article_id", "source"
    )


@query
def flt_rank(spark, folder):
    return fl.rank_filter(ad.articles(spark, folder)).select("article_id", "rank")


@query
def flt_dates(spark, folder):
    a = ad.articles(spark, folder)
    return fl.date_range(a, "published", SINCE, UNTIL).select("article_id", "published")


@query
def flt_topics(spark, folder):
    return fl.topic_filter(ad.articles(spark, folder), GROUPS).select(
        "article_id", "topic"
    )


@query
def tw_user(spark, folder):
    return fl.by_user(ad.tweets(spark, folder), USER).select("tweet_id", "username")


@query
def tw_hashtags(spark, folder):
    return fl.by_hashtags(ad.tweets(spark, folder), TAGS).select("tweet_id", "text")


@query
def tw_window(spark, folder):
    return fl.since_until(ad.tweets(spark, folder), today=TODAY).select("tweet_id", "ts")


@query
def tw_originals(spark, folder):
    return fl.originals_only(ad.tweets(spark, folder)).select("tweet_id", "username")


@query
def po_subreddit(spark, folder):
    return fl.by_subreddit(ad.posts(spark, folder), COMMUNITY).select("id", "subreddit")


@query
def po_has_url(spark, folder):
    return fl.require_url(ad.posts(spark, folder)).select("id", "url")


@query
def po_placeholders(spark, folder):
    return fl.drop_placeholders(ad.posts(spark, folder)).select("id", "body")


@query
def tw_landed(spark, folder):
    """Messages as a feed without the two flags lands them: all are originals."""
    t = ad.tweets(spark, folder)
    landed = t.select(
        F.to_json(
            F.struct(
                F.col("ts").cast("string").alias("date"),
                F.col("tweet_id").alias("id"),
                F.col("text").alias("content"),
                F.struct("username").alias("user"),
            )
        ).alias("value")
    )
    found = fl.originals_only(readers.tweets_from_json(landed))
    return found.select("tweet_id", "ts", "username")


# ---- scalar functions --------------------------------------------------------


@query
def po_defaults(spark, folder):
    return ad.posts(spark, folder).select(
        "id",
        tx.default_empty("body").alias("body"),
        tx.default_empty("parent_id").alias("parent_id"),
    )


@query
def tx_sentences(spark, folder):
    return ad.articles(spark, folder).select(
        "article_id",
        F.array_join(tx.split_sentences("summary"), "|").alias("sentences"),
        F.size(tx.split_sentences("summary")).cast("long").alias("n"),
    )


@query
def tx_clean(spark, folder):
    return ad.tweets(spark, folder).select(
        "tweet_id", tx.clean_text("text").alias("clean")
    )


@query
def tx_clean_array(spark, folder):
    cleaned = tx.clean_each(tx.split_sentences("summary"))
    return ad.articles(spark, folder).select(
        "article_id", F.array_join(cleaned, "|").alias("sentences")
    )


@query
def tx_hashtags(spark, folder):
    """Tag lists as a user types them, one per message, normalised."""
    typed = F.concat(F.lit(" "), F.array_join(tx.hashtags_in("text"), " , "), F.lit(",#x"))
    return ad.tweets(spark, folder).select(
        "tweet_id", tx.normalise_hashtags(typed).alias("tags")
    )


@query
def tx_username(spark, folder):
    return readers.load(spark, folder, "events").select(
        "event_id",
        tx.normalise_username(F.concat(F.lit("@@user"), "user_id")).alias("username"),
    )


@query
def tx_criteria(spark, folder):
    return (
        readers.load(spark, folder, "events")
        .groupBy("user_id")
        .agg(F.max("ts").alias("last"))
        .select(
            "user_id",
            tx.search_criteria(
                F.concat(F.lit("from:user"), "user_id"),
                tx.iso_date(tx.minus_days("last")),
                tx.iso_date("last"),
            ).alias("criteria"),
        )
    )


@query
def tx_criteria_tags(spark, folder):
    """The hashtag form: the tags of each kind of event, joined by OR."""
    typed = F.concat(F.lit(" "), "event_type", F.lit(" , #x,"))
    last = readers.load(spark, folder, "events").groupBy("event_type").agg(F.max("ts").alias("last"))
    criteria = tx.search_criteria(
        tx.normalise_hashtags(typed), tx.iso_date(tx.minus_days("last")), tx.iso_date("last")
    )
    return last.select("event_type", criteria.alias("criteria"))


@query
def tx_preview(spark, folder):
    return ad.articles(spark, folder).select(
        "article_id", tx.preview("summary").alias("trimmed_text")
    )


@query
def tx_bullets(spark, folder):
    return ad.articles(spark, folder).select(
        "article_id",
        tx.bulletise(F.replace("summary", F.lit(". "), F.lit(" - "))).alias("bullets"),
    )


@query
def dt_default_window(spark, folder):
    return readers.load(spark, folder, "events").select(
        "event_id",
        tx.iso_date("ts").alias("until"),
        tx.iso_date(tx.minus_days("ts")).alias("since"),
    )


@query
def tx_sentiment_label(spark, folder):
    return _polarity(spark, folder).select(
        "article_id", "pos", tx.sentiment_label("polarity").alias("sentiment")
    )


# ---- scores --------------------------------------------------------------------


def _polarity(spark, folder):
    return sc.polarity(
        ev.clean_sentences(ad.articles(spark, folder)),
        ["article_id", "pos"],
        "text",
        ad.sentiment_lexicon(spark, folder),
        cleaned=True,
    )


@query
def tx_polarity(spark, folder):
    return _polarity(spark, folder)


@query
def tx_subjectivity(spark, folder):
    return sc.subjectivity(
        ev.clean_sentences(ad.articles(spark, folder)),
        ["article_id", "pos"],
        "text",
        ad.sentiment_lexicon(spark, folder),
        cleaned=True,
    )


@query
def tx_polarity_rules(spark, folder):
    """Polarity and subjectivity with negation and intensifiers."""
    found = ruled_scores(
        ev.clean_sentences(ad.articles(spark, folder)),
        ["article_id", "pos"],
        "text",
        ad.sentiment_lexicon(spark, folder),
        ad.modifiers(spark, folder),
        cleaned=True,
    )
    rounded = [(F.round(c, SIM_DIGITS) + 0.0).alias(c) for c in ("polarity", "subjectivity")]
    return found.select("article_id", "pos", *rounded)


def _semantic(spark, folder):
    """Cleaned sentences, and the encoder fitted on them."""
    sentences = ev.clean_sentences(ad.articles(spark, folder))
    return sentences, sem.fit_semantic(sentences, "text", cleaned=True)


@query
def enc_semantic(spark, folder):
    """Every sentence on the latent axes of all sentences."""
    sentences = ev.clean_sentences(ad.articles(spark, folder))
    hashed = sem.hashed_texts(sentences, ["article_id", "pos"], "text", cleaned=True)
    model = sem.fit_semantic(hashed, "text", cleaned=True)
    return sem.encode_semantic(hashed, ["article_id", "pos"], "text", model, SIM_DIGITS)


@query
def swot_semantic(spark, folder):
    """The SWOT evidence of articles by the semantic encoder."""
    sentences, model = _semantic(spark, folder)
    best = sem.semantic_evidence(sentences, ["article_id", "pos"], "text", ad.swot_seeds(spark, folder), model, SWOT_ARTICLES_K)
    return best.withColumn("sim", F.round("sim", SIM_DIGITS))


@query
def enc_terms(spark, folder):
    return sc.encode_terms(
        ev.clean_sentences(ad.articles(spark, folder)),
        ["article_id", "pos"],
        "text",
        cleaned=True,
    )


@query
def enc_model(spark, folder):
    """A stand-in encoder: how often each vowel occurs."""

    def loader():
        import numpy as np

        def predict(texts):
            return np.array(
                [[str(t).count(v) for v in "aeiou"] for t in texts], dtype="float32"
            )

        return predict

    encoded = encode_model(
        ad.articles(spark, folder).select("article_id", "summary"), "summary", loader
    )
    return encoded.select(
        "article_id",
        *[F.col("embedding")[i].cast("double").alias(v) for i, v in enumerate("aeiou")],
    )


@query
def sim_sparse(spark, folder):
    """Whole articles with the PESTLE facets, as a join of long-form vectors."""
    a = sc.encode_terms(ad.articles(spark, folder), ["article_id"], "summary")
    seeds = sc.encode_terms(ad.pestle_seeds(spark, folder), ["facet"], "text")
    facets = seeds.groupBy("facet", "bucket").agg(F.sum("n").alias("n"))
    return sc.cosine_sparse(a, facets, "article_id", "facet")


def _centroids(spark, folder):
    return sc.source_centroids(ad.vectors(spark, folder), "label", "embedding")


def _dense_facets(spark, folder):
    return _centroids(spark, folder).select(F.col("label").alias("facet"), "embedding")


@query
def sim_dense(spark, folder):
    """Every vector with the centroid of every outlet."""
    scored = sc.score_dense(
        ad.vectors(spark, folder), ["vec_id"], "embedding", _dense_facets(spark, folder)
    )
    return scored.select("vec_id", "facet", F.round("sim", SIM_DIGITS).alias("sim"))


@query
def dense_evidence(spark, folder):
    best = ev.dense_evidence(
        ad.vectors(spark, folder),
        "vec_id",
        "embedding",
        _dense_facets(spark, folder),
        PESTLE_K,
    )
    return best.select("facet", "rk", "vec_id", F.round("sim", SIM_DIGITS).alias("sim"))


@query
def em_scores(spark, folder):
    scored = _scored_posts(spark, folder)
    return rk.explode_zip(scored, "emotion", "score", "id")


def _modelled(spark, folder):
    """A stand-in classifier: one score per label from the text's length."""
    labels = list(reversed(EMOTIONS))

    def loader():
        import numpy as np

        def predict(texts):
            return np.array(
                [[(len(str(t)) * (j + 1)) % 97 for j in range(27)] for t in texts],
                dtype="float32",
            )

        return predict

    usable = fl.drop_placeholders(ad.posts(spark, folder)).select("id", "body")
    return emotion_model(usable, "body", labels, loader)


@query
def em_model(spark, folder):
    return em.top_emotion(_modelled(spark, folder)).select(
        "id", "top_emotion", F.array_max("score").alias("top_score")
    )


# ---- joins -----------------------------------------------------------------------


@query
def jn_score_pairs(spark, folder):
    """Every sentence with every SWOT facet."""
    return sc.score_sparse(
        ev.clean_sentences(ad.articles(spark, folder)),
        ["article_id", "pos"],
        "text",
        ad.swot_seeds(spark, folder),
        cleaned=True,
    )


@query
def jn_zip_explode(spark, folder):
    """List of sentences beside the list of their dots with a facet, for both facets."""
    facets = small_literal(
        sc.encode_facets(ad.swot_seeds(spark, folder)), sc.FACETS, "facets"
    )
    lists = ad.articles(spark, folder).select(
        "article_id", tx.clean_each(tx.split_sentences("summary")).alias("sentence")
    )
    dot = dot_buckets_sql(term_buckets_sql("s", cleaned=True), "counts")
    scored = lists.select("*", F.inline(facets)).select(
        "article_id", "facet", "sentence", F.expr(f"transform(sentence, s -> {dot})").alias("dot")
    )
    return rk.explode_zip(scored, "sentence", "dot", "article_id", "facet")


@query
def similar_sources(spark, folder):
    found = nearest(_centroids(spark, folder), "label", "embedding")
    return found.select(
        "source", "similar", F.col("rk").cast("long").alias("rk"),
        F.round("sim", SIM_DIGITS).alias("sim"),
    )


# ---- explode, limit, top-k -----------------------------------------------------


@query
def tx_explode(spark, folder):
    return rk.explode_sentences(ad.articles(spark, folder), "summary", "article_id")


@query
def po_limit(spark, folder):
    return rk.limit_first(fl.require_url(ad.posts(spark, folder)), POST_LIMIT, "id").select(
        "id", "created", "url"
    )


@query
def tw_latest(spark, folder):
    return rk.latest_then_ascending(ad.tweets(spark, folder), TWEET_LIMIT).select(
        "tweet_id", "ts"
    )


@query
def swot_articles(spark, folder):
    return ev.swot_articles(ad.articles(spark, folder), ad.swot_seeds(spark, folder))


@query
def swot_posts(spark, folder):
    return ev.swot_posts(ad.posts(spark, folder), ad.swot_seeds(spark, folder))


@query
def swot_tweets(spark, folder):
    return ev.swot_tweets(ad.tweets(spark, folder), ad.swot_seeds(spark, folder))


@query
def pestle_articles(spark, folder):
    return ev.pestle_articles(ad.articles(spark, folder), ad.pestle_seeds(spark, folder))


@query
def swot_distinct(spark, folder):
    """The distinct form of the SWOT evidence: two facets, k = 50."""
    sentences = ev.clean_sentences(ad.articles(spark, folder))
    return ev.topk_distinct(sentences, ad.swot_seeds(spark, folder), 50)


# ---- aggregates, sets --------------------------------------------------------


@query
def evidence_lists(spark, folder):
    best = swot_articles(spark, folder)
    return rk.evidence_lists(best, "text").select(
        "facet",
        F.size("evidence").cast("long").alias("n"),
        F.array_join("evidence", "|").alias("evidence"),
    )


@query
def source_centroids(spark, folder):
    return _centroids(spark, folder).select(
        "label", F.posexplode("embedding").alias("pos", "x")
    ).select("label", "pos", F.round("x", SIM_DIGITS).alias("x"))


@query
def union_batches(spark, folder):
    """Posts and messages in one feed; each lacks some of the other's columns."""
    posts = ad.posts(spark, folder).select("id", F.col("body").alias("text"), "subreddit")
    tweets = ad.tweets(spark, folder).select(
        F.col("tweet_id").cast("string").alias("id"), "text", "username"
    )
    return rk.union_batches(posts, tweets)


# ---- emotion map ---------------------------------------------------------------


def _scored_posts(spark, folder):
    return maps.scored_posts(ad.posts(spark, folder), ad.emotion_lexicon(spark, folder))


def _topped(spark, folder):
    return em.top_emotion(_scored_posts(spark, folder)).select("id", "top_emotion")


@query
def em_top(spark, folder):
    return _topped(spark, folder)


@query
def em_top_array(spark, folder):
    """First label of the highest score, from a model's lists."""
    return _modelled(spark, folder).select(
        "id", first_max("score", "emotion").alias("top_emotion")
    )


@query
def em_one(spark, folder):
    return fl.emotion_eq(_topped(spark, folder), "caring")


@query
def em_counts(spark, folder):
    return rk.value_counts(_topped(spark, folder), "top_emotion")


@query
def em_codes(spark, folder):
    topped = _topped(spark, folder)
    return em.emotion_code(topped, em.label_counts(topped))


@query
def em_top10(spark, folder):
    topped = _topped(spark, folder)
    return em.keep_dominant(topped, em.label_counts(topped), threshold=THRESHOLD)


@query
def em_colours(spark, folder):
    return em.emotion_colour(_topped(spark, folder), readers.default_palette(spark))


@query
def em_labels(spark, folder):
    """The plot table without its coordinates."""
    return maps.labelled_posts(
        ad.posts(spark, folder),
        ad.emotion_lexicon(spark, folder),
        readers.default_palette(spark),
        threshold=THRESHOLD,
    )


def _rounded(df: DataFrame) -> DataFrame:
    """Coordinates to six digits; adding 0.0 makes -0.0 plain zero."""
    return df.withColumns({c: F.round(c, SIM_DIGITS) + 0.0 for c in "xyz"})


@query
def em_xyz(spark, folder):
    return _rounded(em.project_3d(_scored_posts(spark, folder), "score").select("id", "x", "y", "z"))


@query
def em_plot_table(spark, folder):
    plot = maps.emotion_map(
        ad.posts(spark, folder),
        ad.emotion_lexicon(spark, folder),
        readers.default_palette(spark),
        threshold=THRESHOLD,
    )
    return _rounded(plot)


@query
def em_trained(spark, folder):
    """Labels of a classifier that is trained on the lexicon's labels of two posts in three."""
    posts = maps.usable_posts(ad.posts(spark, folder))
    labels = em.top_emotion(_scored_posts(spark, folder)).filter(F.crc32("id") % 3 != 1)
    model = fit_emotions(posts.join(labels.select("id", "top_emotion"), "id"), "text", "top_emotion")
    return em.top_emotion(trained_scores(posts, ["id"], "text", model)).select("id", "top_emotion")


@query
def em_axes(spark, folder):
    """The supervised layout: score lists on the axes that hold the labels apart."""
    topped = em.top_emotion(_scored_posts(spark, folder))
    return _rounded(em.project_by_label(topped, "score", "top_emotion").select("id", "x", "y", "z"))


@query
def em_plot_supervised(spark, folder):
    """The plot table in the supervised layout."""
    plot = maps.emotion_map(
        ad.posts(spark, folder),
        ad.emotion_lexicon(spark, folder),
        readers.default_palette(spark),
        supervised=True,
        threshold=THRESHOLD,
    )
    return _rounded(plot)


@query
def em_palette(spark, folder):
    """Colours from a palette that was written as csv and read back."""
    path = _path(spark)
    sinks.write_table(ad.palette(spark, folder), path, "csv")
    return em.emotion_colour(_topped(spark, folder), readers.read_emotion_palette(spark, path))


@query
def kw_index(spark, folder):
    """The keyword search through a positional index of the summaries."""
    articles = ad.articles(spark, folder)
    path = _path(spark)
    ki.write_index(articles, "article_id", "summary", path)
    return ki.matching(articles, "article_id", path, KEYWORDS, "summary").select("article_id", "source")


@query
def knn_graph(spark, folder):
    """Neighbours of every vector; exact for as few as the SQL can compare."""
    found = graph_of(ad.vectors(spark, folder))
    return found.select(
        "id", "neighbour", F.col("rk").cast("long").alias("rk"),
        F.round("dist2", SIM_DIGITS).alias("dist2"),
    )


@query
def knn_exact(spark, folder):
    """Neighbours of every vector whose id is divisible by 50, among all vectors."""
    found = knn(ad.vectors(spark, folder))
    return found.select(
        "id", "neighbour", F.col("rk").cast("long").alias("rk"),
        F.round("dist2", SIM_DIGITS).alias("dist2"),
    )


# ---- whole tables and reports -------------------------------------------------


@query
def articles_table(spark, folder):
    return tb.articles_table(
        ad.articles(spark, folder), KEYWORDS, "summary", SOURCES, SINCE, UNTIL
    )


@query
def posts_table(spark, folder):
    feed = readers.posts_from_json(_post_json(ad.posts(spark, folder)))
    return tb.posts_table(feed, COMMUNITY, POST_LIMIT)


@query
def tweets_user_table(spark, folder):
    return tb.tweets_table(
        ad.tweets(spark, folder), TWEET_LIMIT, username=USER, today=TODAY
    )


@query
def tweets_hashtag_table(spark, folder):
    return tb.tweets_table(
        ad.tweets(spark, folder), TWEET_LIMIT, hashtags=TAGS, since=SINCE, until=UNTIL
    )


@query
def seed_rows(spark, folder):
    """Seed prompts for every outlet."""
    subjects = readers.load(spark, folder, "documents").select(
        F.col("source").alias("subject")
    )
    return rp.seed_prompts(subjects.distinct())


@query
def prompt_rows(spark, folder):
    swot = rk.evidence_lists(swot_articles(spark, folder), "text")
    pestle = rk.evidence_lists(pestle_articles(spark, folder), "text")
    return rp.build_prompts(swot, pestle, SUBJECT)


@query
def report_rows(spark, folder):
    """Reports from a stand-in completion that quotes its prompt's digest."""

    def fn(batch):
        import hashlib

        return [
            f"{len(p)} characters - digest {hashlib.md5(p.encode()).hexdigest()} - end"
            for p in batch["prompt"]
        ]

    return rp.report(prompt_rows(spark, folder), fn)


def _stub(batch):
    """A stand-in completion: a seed prompt is its own paragraph, a summary its digest."""
    import hashlib

    return [
        p if stage.endswith("_seed") else f"{len(p)} characters - digest {hashlib.md5(p.encode()).hexdigest()} - end"
        for stage, p in zip(batch["stage"], batch["prompt"])
    ]


def _with_json(review: DataFrame) -> DataFrame:
    lists = F.transform("evidence", lambda e: e["texts"])
    return review.select("subject", "stage", "report", F.to_json(lists).alias("evidence"))


SEARCH = dict(keyword=KEYWORDS, search_in="summary", sources=SOURCES, since=SINCE, until=UNTIL)


@query
def review_articles(spark, folder):
    return _with_json(rv.article_review(ad.articles(spark, folder), SUBJECT, _stub, **SEARCH))


@query
def review_pestle(spark, folder):
    return _with_json(rv.pestle_review(ad.articles(spark, folder), SUBJECT, _stub, **SEARCH))


@query
def review_posts(spark, folder):
    return _with_json(rv.post_review(ad.posts(spark, folder), SUBJECT, _stub, COMMUNITY, POST_LIMIT))


@query
def review_tweets(spark, folder):
    review = rv.tweet_review(
        ad.tweets(spark, folder), SUBJECT, _stub, TWEET_LIMIT, hashtags=TAGS, since=SINCE, until=UNTIL
    )
    return _with_json(review)


def _path(spark: SparkSession) -> str:
    """A new path in the shared folder."""
    checkpoint_ready(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/out-{uuid.uuid4().hex}"


def _written(df: DataFrame, fmt: str) -> DataFrame:
    """The table as a writer leaves it in the shared folder, read back."""
    spark, path = df.sparkSession, _path(df.sparkSession)
    sinks.write_table(df, path, fmt)
    reader = spark.read.option("header", True) if fmt == "csv" else spark.read
    return reader.format(fmt).load(path)


@query
def out_csv_evidence(spark, folder):
    """Evidence lists as csv, where they are JSON text."""
    return _written(rk.evidence_lists(swot_articles(spark, folder), "text"), "csv")


@query
def out_parquet_articles(spark, folder):
    """Articles written as Parquet and read back."""
    return _written(ad.articles(spark, folder), "parquet")


@query
def out_published(spark, folder):
    """A review whose report and evidence are published together and read back."""
    review = rv.article_review(ad.articles(spark, folder), SUBJECT, _stub, **SEARCH)
    path = _path(spark)
    pub.publish(path, rv.review_tables(review))
    return _with_json(rv.from_tables(pub.read_published(spark, path, "report"), pub.read_published(spark, path, "evidence")))


@query
def po_newest(spark, folder):
    """The newest posts of every community, from a feed that lands in pieces with repeated
    and late items."""
    posts = ad.posts(spark, folder).filter("created is not null and id is not null")
    path = _path(spark)
    # The feed lands three times: each time its share of the posts, and some of the last one again.
    part = F.pmod(F.crc32("id"), F.lit(3))
    for n in range(3):
        again = (part == n) | ((part == (n - 1) % 3) & (F.crc32(F.reverse("id")) % 4 == 0))
        _post_json(posts.filter(again)).write.mode("append").text(f"{path}/feed")
    feed = fd.stream_posts(nw.with_state_store(spark), f"{path}/feed", files=8).withColumn("created", F.col("created").cast("timestamp"))
    lists = nw.newest(nw.first_seen(feed, "id", "created", "10000 days"), "subreddit", "id", "created", POST_LIMIT)
    nw.keep_newest(lists, f"{path}/lists", f"{path}/state").awaitTermination()
    schema = f"{lists.schema.simpleString()[7:-1]}, batch:int".replace(":", " ")
    found = nw.read_newest(spark, f"{path}/lists", schema, "subreddit", "id", "created", POST_LIMIT)
    return found.select("subreddit", F.col("rk").cast("long").alias("rk"), "id", F.col("created").cast("timestamp_ntz").alias("created"), "author")


@query
def out_json_records(spark, folder):
    return sinks.json_records(
        ad.posts(spark, folder).select("type", "author", "body", "id", "parent_id", "url")
    )
