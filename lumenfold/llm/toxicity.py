"""Toxicity: FTRL-proximal logistic regression over hashed n-grams and skip-grams.

Features are hashed words, pairs of neighbours and pairs one word apart, each counted once
a text. FTRL-proximal keeps a learning rate per coordinate and an L1 penalty that leaves
most weights at exactly zero, so the model is a short list of (coordinate, weight) that
every task receives. Training takes a bounded sample of the labelled rows: features are made
in parallel, the online learner itself is one task of bounded size.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenfold.llm.common import stored, text_of

BITS = 22
#: FTRL-proximal: learning rate, its smoothing, L1 and L2 penalty.
ALPHA, BETA, L1, L2 = 3.0, 1.0, 4.0, 0.01
EPOCHS = 6
#: Weight of a toxic row; toxic rows are few.
TOXIC_WEIGHT = 2.0
#: Texts that a coordinate must be in to enter the model.
MIN_TEXTS = 4
#: Labelled rows used at most: those with the smallest hash of their id.
MAX_ROWS = 16_384
THRESHOLD = 0.7
#: Coordinate of the constant term.
BIAS = -1

_MARKS = bytes(c if chr(c).isalnum() or c > 127 else 32 for c in range(256))
_A, _B, _MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0xD6E8FEB86659FD93)


def coordinates(text: str) -> np.ndarray:
    """Hashed features of a text, in order and with repeats. Words are runs of letters and
    digits, in lower case; characters beyond ASCII count as letters."""
    words = text.lower().encode("utf-8").translate(_MARKS).split()
    h = np.fromiter(map(zlib.crc32, words), dtype=np.uint64, count=len(words))
    grams = np.concatenate((h * _A + _B, h[:-1] * _A + h[1:] * _B, h[:-2] * _A + h[2:] * _B + _A))
    grams ^= grams >> np.uint64(32)
    return ((grams * _MIX) >> np.uint64(64 - BITS)).astype(np.int64)


def train(examples: list[tuple[np.ndarray, int]], epochs: int = EPOCHS, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Nonzero (coordinates, weights) of FTRL-proximal over distinct coordinates per example."""
    size = 1 << BITS
    z, n = np.zeros(size + 1, dtype=np.float32), np.zeros(size + 1, dtype=np.float32)

    def weights(at):
        zi, l1 = z[at], np.where(at == size, 0, L1)
        w = -(zi - np.sign(zi) * l1) / ((BETA + np.sqrt(n[at])) / ALPHA + L2)
        return np.where(np.abs(zi) <= l1, 0, w)

    order = np.random.default_rng(seed)
    for _ in range(epochs):
        for i in order.permutation(len(examples)):
            at, label = examples[i]
            w = weights(at)
            p = 1 / (1 + np.exp(-np.clip(w.sum(), -35, 35)))
            g = (p - label) * (TOXIC_WEIGHT if label else 1.0)
            sigma = (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / ALPHA
            z[at] += g - sigma * w
            n[at] += g * g
    at = np.flatnonzero((np.abs(z) > L1) | (np.arange(size + 1) == size))
    return np.where(at == size, BIAS, at), weights(at)


def included(found: list[np.ndarray], labels) -> list[tuple[np.ndarray, int]]:
    """Examples from distinct coordinates: those that enter the model, and the constant term.

    A coordinate enters if at least MIN_TEXTS of the texts have it; most n-grams are in
    one text only and could not be told from noise.
    """
    count = np.zeros(1 << BITS, dtype=np.int32)
    for f in found:
        count[f] += 1
    end = np.array([1 << BITS], dtype=np.int32)
    return [(np.concatenate((f[count[f] >= MIN_TEXTS], end)), int(y)) for f, y in zip(found, labels, strict=True)]


def _features(batches):
    for batch in batches:
        found = [np.unique(coordinates(t.as_py() or "")).astype(np.int32) for t in batch.column(2)]
        column = pa.array(found, pa.list_(pa.int32()))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), column], names=["id", "label", "at"])


def _learn(batches):
    rows = [r for b in batches for r in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), strict=True)]
    rows.sort(key=lambda r: (str(r[0]), len(r[2])))
    found = [r[2].values.to_numpy() for r in rows]
    at, w = train(included(found, [r[1] for r in rows])) if rows else (np.empty(0, np.int64), np.empty(0))
    yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(w, pa.float64())], names=["at", "w"])


def fit(
    docs: DataFrame,
    labels: DataFrame,
    max_rows: int = MAX_ROWS,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "toxic",
) -> tuple[np.ndarray, np.ndarray]:
    """The model as (coordinates, weights), fitted on at most ``max_rows`` labelled rows.

    ``labels`` has one row per labelled id. Rows without an id, a label or a document are
    left out; an id that is labelled twice counts once, as toxic if one of them says so.
    Without any labelled row the model is empty and scores 0.5.
    """
    known = labels.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{label_col}`").cast("int").alias("label"))
    known = known.filter("id is not null and label is not null").groupBy("id").agg(F.max("label").alias("label"))
    chosen = stored(known.orderBy(F.xxhash64("id"), "id").limit(max_rows))
    # At most max_rows rows of two integers are broadcast.
    texts = docs.select(F.col(f"`{id_col}`").alias("id"), text_of(text_col).alias("text"))
    rows = texts.join(F.broadcast(chosen), "id").select("id", "label", "text")
    kind = rows.schema["id"].dataType.simpleString()
    features = rows.mapInArrow(_features, f"id {kind}, label int, at array<int>")
    # The sample is bounded, so one task holds it; L1 keeps few of 2**BITS weights.
    model = features.repartition(1).mapInArrow(_learn, "at long, w double").toArrow()
    return model.column("at").to_numpy(), model.column("w").to_numpy()


def scorer(at: np.ndarray, w: np.ndarray):
    """A function from a text to the probability that it is toxic."""
    table = np.zeros(1 << BITS, dtype=np.float32)
    bias = float(w[at == BIAS].sum())
    table[at[at != BIAS]] = w[at != BIAS]

    def score(text: str) -> float:
        found = coordinates(text)
        found = np.unique(found[table[found] != 0])
        return float(1 / (1 + np.exp(-np.clip(bias + table[found].sum(dtype=np.float64), -35, 35))))

    return score


def score(df: DataFrame, model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, score), one row per input row; other columns are not read. NULL and empty
    texts score by the constant term alone."""
    at, w = model
    two = df.select(F.col(f"`{id_col}`").alias("doc_id"), text_of(text_col).alias("text"))
    kind = two.schema["doc_id"].dataType.simpleString()

    def run(batches):
        of = scorer(at, w)
        for batch in batches:
            values = pa.array([of(t.as_py() or "") for t in batch.column(1)], pa.float64())
            yield pa.RecordBatch.from_arrays([batch.column(0), values], names=["doc_id", "score"])

    return two.mapInArrow(run, f"doc_id {kind}, score double")


def held_out(id_col: Column) -> Column:
    """Rows that never train: crc32 of the id as text leaves 1 when divided by 3."""
    return F.coalesce(F.crc32(F.encode(id_col.cast("string"), "utf-8")) % 3 == 1, F.lit(False))


def drop_toxic(df: DataFrame, model, threshold: float = THRESHOLD, text_col: str = "text") -> DataFrame:
    """The rows of ``df`` that score below the threshold, with all their columns, in one
    pass and without a shuffle."""
    at, w = model
    names = df.columns
    column = names.index(text_col)

    def run(batches):
        of = scorer(at, w)
        for batch in batches:
            keep = pa.array([of(t.as_py() or "") < threshold for t in batch.column(column)], pa.bool_())
            yield batch.filter(keep)

    return df.mapInArrow(run, df.schema)
