"""The emotion map: dominant label, codes, colours and coordinates per post."""

from __future__ import annotations

from pyspark.ml.feature import PCA
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lumenfold.fixed import DOMINANT_K, DOMINANT_THRESHOLD, EMOTIONS
from lumenfold.functions.text import marker_size
from lumenfold.functions.vectors import dot_dense, first_max
from lumenfold.operators.lookups import lookup_join


def top_emotion(scored: DataFrame) -> DataFrame:
    """Add the label of the highest score; lists are label-sorted, first wins."""
    return scored.withColumn("top_emotion", first_max("score", "emotion"))


def label_counts(df: DataFrame, labels: list[str] = EMOTIONS) -> DataFrame:
    """(top_emotion, n, code, rank, total): one row per label present.

    Any other label is an error. There are at most ``len(labels)`` rows, so the
    unpartitioned windows and the broadcasts of this table are bounded by the label
    set, not by the data.
    """
    unknown = F.raise_error(F.concat(F.lit("unknown label: "), "top_emotion"))
    label = F.when(F.col("top_emotion").isin(labels), F.col("top_emotion"))
    counts = (
        df.select(label.otherwise(unknown).alias("top_emotion"))
        .groupBy("top_emotion")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    by_label = W.orderBy("top_emotion")
    by_count = W.orderBy(F.desc("n"), "top_emotion")
    return counts.select(
        "top_emotion",
        "n",
        (F.row_number().over(by_label) - 1).alias("code"),
        F.row_number().over(by_count).alias("rank"),
        F.sum("n").over(W.partitionBy()).alias("total"),
    )


def emotion_code(df: DataFrame, counts: DataFrame) -> DataFrame:
    """0-based code of the label among all labels present."""
    return df.join(
        F.broadcast(counts.select("top_emotion", "code")), "top_emotion"
    )


def keep_dominant(
    df: DataFrame,
    counts: DataFrame,
    threshold: int = DOMINANT_THRESHOLD,
    k: int = DOMINANT_K,
) -> DataFrame:
    """With more than ``threshold`` rows, keep the k most frequent labels only."""
    kept = counts.filter((F.col("total") <= threshold) | (F.col("rank") <= k))
    return df.join(F.broadcast(kept.select("top_emotion")), "top_emotion", "left_semi")


def emotion_colour(df: DataFrame, palette: DataFrame) -> DataFrame:
    colours = palette.select(F.col("emotion").alias("top_emotion"), "colour")
    return lookup_join(df, colours, "top_emotion")


def project_3d(df: DataFrame, vector: str) -> DataFrame:
    """Add x, y, z: the first three principal components of the centred score lists.

    The fit is one distributed covariance of label-set size. It is linear and
    unsupervised, unlike the non-linear layout it stands in for. The largest loading of
    a component is positive. Without rows there is nothing to fit and none comes out.
    """
    if df.isEmpty():
        return df.withColumns({c: F.lit(None).cast("double") for c in "xyz"})
    with_features = df.withColumn("_f", array_to_vector(vector))
    center = with_features.agg(vector_to_array(Summarizer.mean(F.col("_f"))).alias("m")).first()["m"]
    loadings = PCA(k=3, inputCol="_f", outputCol="_p").fit(with_features).pc.toArray().T
    axes = {}
    for name, axis in zip("xyz", loadings, strict=True):
        axis = axis if axis[abs(axis).argmax()] > 0 else -axis
        offset = float(axis @ center)
        axes[name] = dot_dense(F.col(vector), F.lit(axis.tolist())) - F.lit(offset)
    return df.withColumns(axes)


RIDGE = 0.01  # of the mean variance within labels, added to each direction


def fisher_axes(df: DataFrame, vector: str, label: str, ridge: float = RIDGE) -> tuple[list[list[float]], list[float]]:
    """Up to three axes along which labels lie furthest apart, and the mean of all vectors.

    One aggregate leaves, per label, its mean vector and mean products, a table whose
    size is that of the label set; the driver solves the generalised eigenproblem of the
    scatter between labels against the scatter within them. An axis has variance one
    within labels, and its largest loading is positive. With c labels there are c - 1
    axes at most; the others are zero.
    """
    import numpy as np

    products = F.flatten(F.transform(vector, lambda a: F.transform(vector, lambda b: a * b)))
    both = array_to_vector(F.concat(vector, products))
    means = vector_to_array(Summarizer.mean(both)).alias("m")
    rows = df.filter(F.col(label).isNotNull() & F.col(vector).isNotNull()).groupBy(label).agg(F.count(F.lit(1)).alias("n"), means)
    rows = sorted(rows.collect(), key=lambda r: r[label])
    if not rows:
        return [], []
    n = np.array([r.n for r in rows], dtype="float64")
    told = np.array([r.m for r in rows])
    dims = int((np.sqrt(1 + 4 * told.shape[1]) - 1) / 2)
    mean, second = told[:, :dims], told[:, dims:].reshape(-1, dims, dims)
    share = n / n.sum()
    centre = share @ mean
    within = np.einsum("l,lij->ij", share, second - mean[:, :, None] * mean[:, None, :])
    apart = mean - centre
    between = np.einsum("l,li,lj->ij", share, apart, apart)
    spread = np.trace(within) / dims
    within += (ridge * spread if spread > 0 else 1.0) * np.eye(dims)
    half = np.linalg.inv(np.linalg.cholesky(within))
    values, turn = np.linalg.eigh(half @ between @ half.T)
    axes = []
    for i in np.argsort(-values, kind="stable")[:3]:
        axis = half.T @ turn[:, i]
        axis = axis if axis[abs(axis).argmax()] > 0 else -axis
        axes.append((axis if values[i] > 1e-9 * max(values.max(), 1e-300) and values[i] > 1e-12 else axis * 0).tolist())
    return axes, centre.tolist()


def project_by_label(df: DataFrame, vector: str, label: str, ridge: float = RIDGE) -> DataFrame:
    """Add x, y, z: score lists on the axes of :func:`fisher_axes`, centred.

    The layout is supervised, as labels are its target, and linear. Without rows there is
    nothing to fit and none comes out.
    """
    axes, centre = fisher_axes(df, vector, label, ridge)
    if not axes:
        return df.withColumns({c: F.lit(None).cast("double") for c in "xyz"})
    axes += [[0.0] * len(centre)] * (3 - len(axes))
    out = {}
    for name, axis in zip("xyz", axes, strict=True):
        offset = sum(a * c for a, c in zip(axis, centre, strict=True))
        out[name] = dot_dense(F.col(vector), F.lit(axis)) - F.lit(offset)
    return df.withColumns(out)


def labelled_table(
    topped: DataFrame,
    palette: DataFrame,
    threshold: int = DOMINANT_THRESHOLD,
    k: int = DOMINANT_K,
    labels: list[str] = EMOTIONS,
) -> DataFrame:
    """Add code, colour and marker size; drop the rows of rare labels.

    Codes count all labels, the marker size counts the rows that stay. All of it
    hangs on the label, so one small table of labels is joined to the rows once.
    """
    counts = label_counts(topped, labels)
    kept = counts.filter(
        (F.col("total") <= threshold) | (F.col("rank") <= k)
    ).select(
        "top_emotion",
        "code",
        marker_size(F.sum("n").over(W.partitionBy())).alias("dot_size"),
    )
    return topped.join(F.broadcast(emotion_colour(kept, palette)), "top_emotion")
