"""An emotion classifier trained on labelled texts: a softmax over hashed word counts.

The fit is one distributed optimisation over all labelled texts; the model is a table of
buckets by labels, a constant of the scoring expression, so scoring a text is narrow.
"""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenfold.fixed import EMOTIONS, ENCODER_DIMS
from lumenfold.functions.vectors import term_buckets_sql

PENALTY = 0.001
ROUNDS = 60


@dataclass
class EmotionClassifier:
    """``labels`` in order, a weight per bucket and label, and an offset per label."""

    labels: list[str]
    weights: list[list[float]]
    offsets: list[float]


def _counts(text: str, dims: int) -> str:
    """Counts of a text's words per bucket, as a full list; a NULL text has none."""
    zeros = f"array_repeat(0.0D, {dims})"
    buckets = f"coalesce({term_buckets_sql(f'`{text}`', dims)}, array())"
    # Runs of the sorted buckets: a bucket's count is the distance between its ends.
    return (
        f"transform(array({buckets}), b -> if(size(b) = 0, {zeros}, transform(sequence(0, {dims - 1}),"
        " i -> if(array_position(b, i) = 0, 0.0D, double(size(b) - array_position(reverse(b), i) - array_position(b, i) + 2)))))[0]"
    )


def fit_emotions(
    df: DataFrame, text: str, label: str, labels: list[str] = EMOTIONS, dims: int = ENCODER_DIMS, rounds: int = ROUNDS
) -> EmotionClassifier:
    """Fit on every row with a text and a label; a label beyond ``labels`` is an error.

    A label without texts keeps the weights that say so little that it never wins
    against one with texts. Without rows all weights are zero."""
    ordered = sorted(labels)
    at = F.array_position(F.lit(ordered), F.col(label))
    unknown = F.raise_error(F.concat(F.lit("unknown label: "), F.col(label)))
    rows = df.filter(F.col(text).isNotNull() & F.col(label).isNotNull()).select(
        F.when(at > 0, at - 1).otherwise(unknown.cast("long")).cast("double").alias("label"),
        array_to_vector(F.expr(_counts(text, dims))).alias("features"),
    )
    if rows.isEmpty():
        return EmotionClassifier(ordered, [[0.0] * len(ordered) for _ in range(dims)], [0.0] * len(ordered))
    # Every label is a class, whether or not the rows have it.
    present = {int(r.label) for r in rows.select("label").distinct().collect()}
    model = LogisticRegression(family="multinomial", regParam=PENALTY, maxIter=rounds, standardization=False).fit(rows)
    weights, offsets = model.coefficientMatrix.toArray(), model.interceptVector.toArray()
    table = [[float(weights[c, b]) if c < len(weights) else 0.0 for c in range(len(ordered))] for b in range(dims)]
    lowest = float(min(offsets)) - 50.0
    bias = [float(offsets[c]) if c in present and c < len(offsets) else lowest for c in range(len(ordered))]
    return EmotionClassifier(ordered, table, bias)


def trained_scores(df: DataFrame, ids: list[str], text: str, model: EmotionClassifier) -> DataFrame:
    """Probabilities of the labels, as the two lists of ``emotion_scores``; one row per row of
    ``df``. A text without words has those of its labels' shares."""
    dims = len(model.weights)
    buckets = F.expr(f"coalesce({term_buckets_sql(f'`{text}`', dims)}, array())")
    # As JSON text, which Spark folds into one constant.
    weights, offsets = (F.from_json(F.lit(json.dumps(x)), t) for x, t in ((model.weights, "array<array<double>>"), (model.offsets, "array<double>")))
    rows = df.select(*ids, buckets.alias("_b"))
    added = F.aggregate("_b", offsets, lambda acc, b: F.zip_with(acc, F.get(weights, b), lambda a, w: a + w))
    powers = rows.select(*ids, added.alias("_s")).select(
        *ids, F.transform("_s", lambda s: F.exp(s - F.array_max("_s"))).alias("_e")
    )
    total = F.aggregate("_e", F.lit(0.0), lambda acc, x: acc + x)
    shares = powers.select(*ids, "_e", total.alias("_t"))
    return shares.select(
        *ids,
        F.lit(model.labels).alias("emotion"),
        F.transform("_e", lambda x: x / F.col("_t")).alias("score"),
    )
