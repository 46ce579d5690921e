"""Posts → emotion map."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenfold.functions.text import preview
from lumenfold.operators.emotion import labelled_table, project_3d, project_by_label, top_emotion
from lumenfold.operators.filters import drop_placeholders
from lumenfold.operators.scoring import emotion_scores
from lumenfold.session import materialise


def usable_posts(posts: DataFrame) -> DataFrame:
    return drop_placeholders(posts).select("id", F.col("body").alias("text"))


def scored_posts(posts: DataFrame, lexicon: DataFrame) -> DataFrame:
    """(id, emotion, score) of every post with a usable body."""
    return emotion_scores(usable_posts(posts), ["id"], "text", lexicon)


def _labelled(
    posts: DataFrame, lexicon: DataFrame, palette: DataFrame, **sizes
) -> tuple[DataFrame, DataFrame]:
    """(plot rows without texts, texts): both are keyed by ``row``, a number of the post,
    so posts that share an id stay apart."""
    texts = materialise(usable_posts(posts).withColumn("row", F.monotonically_increasing_id()))
    # The scores serve the counts, the fit and the rows: compute them once. They
    # are written without the texts, which join back at the very end.
    scored = emotion_scores(texts, ["row", "id"], "text", lexicon)
    topped = top_emotion(scored).drop("emotion")
    return labelled_table(materialise(topped), palette, **sizes), texts.select("row", "text")


def _with_text(table: DataFrame, texts: DataFrame) -> DataFrame:
    return table.join(texts, "row").drop("row").withColumn("trimmed_text", preview("text"))


def labelled_posts(
    posts: DataFrame, lexicon: DataFrame, palette: DataFrame, **sizes
) -> DataFrame:
    """The plot table without its coordinates."""
    table, texts = _labelled(posts, lexicon, palette, **sizes)
    return _with_text(table.drop("score"), texts)


def emotion_map(
    posts: DataFrame, lexicon: DataFrame, palette: DataFrame, supervised: bool = False, **sizes
) -> DataFrame:
    """Plot-ready rows in label order; ``supervised`` lays them out by their labels."""
    table, texts = _labelled(posts, lexicon, palette, **sizes)
    placed = project_by_label(table, "score", "top_emotion") if supervised else project_3d(table, "score")
    placed = placed.drop("score")
    return _with_text(placed, texts).orderBy("top_emotion", "id")
