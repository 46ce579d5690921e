"""A semantic encoder fitted on the corpus: latent axes of weighted word counts.

Words are hashed to buckets and weighted by how few texts have them. A randomised range
finder then looks for the directions that hold most of all texts: random directions are
sent through the matrix of texts and back, made orthogonal, and sent again. Each pass is
one scan that leaves a table of buckets by directions; its size depends on the
parameters, never on the data. Texts that share no word but share company come close.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from decimal import ROUND_HALF_UP, Decimal

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lumenfold.operators.ranking import topk
from lumenfold.operators.scoring import batch_buckets, score_dense, spaced_words
from lumenfold.session import materialise

BUCKETS = 4096  # hashed words
DIMS = 48  # axes that are kept
SPARE = 16  # random directions beyond them
PASSES = 3  # scans of the range finder, the last of which also ranks the axes
SLICE = 2048  # texts whose weights a task holds at once
BLOCK = 128  # texts of one matrix of weights


@dataclass
class SemanticModel:
    """``idf`` per bucket, ``basis`` (buckets x dims, orthonormal columns), the share of the
    corpus' squared length along each axis, and whether texts come from ``clean_text``."""

    idf: np.ndarray
    basis: np.ndarray
    shares: np.ndarray
    cleaned: bool


def _lists(flat: np.ndarray, ends: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(flat))


def _buckets(df: DataFrame, text: str, size: int, cleaned: bool, keep: list[str] | tuple[str, ...] = ()) -> DataFrame:
    """(keep..., b): sorted buckets of the words of each text; NULL has none.

    ``text`` may be the column of a table that :func:`hashed_texts` made."""
    if isinstance(df.schema[text].dataType, T.ArrayType):
        return df.select(*keep, F.col(f"`{text}`").alias("b"))
    rows = df.select(*keep, spaced_words(f"`{text}`", cleaned).alias("b"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, bucket = batch_buckets(batch.column(batch.num_columns - 1), size)
            ends = np.concatenate(([0], np.cumsum(np.bincount(row, minlength=batch.num_rows))))
            lists = _lists((np.sort(row * size + bucket) % size).astype(np.int32), ends)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], lists], names=batch.schema.names)

    return rows.mapInArrow(run, T.StructType([*rows.schema.fields[:-1], T.StructField("b", T.ArrayType(T.IntegerType()))]))


def hashed_texts(df: DataFrame, keep: list[str], text: str, buckets: int = BUCKETS, cleaned: bool = False) -> DataFrame:
    """(keep..., text) with the buckets of its words for each text, written once: for a fit
    and an encoder that read the same texts."""
    return materialise(_buckets(df, text, buckets, cleaned, keep).withColumnRenamed("b", text))


def weights(column: pa.Array, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, bucket, weight) of a column of sorted bucket lists: (1 + ln n) * idf, where every
    text with words has length one."""
    size = len(idf)
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    row = np.repeat(np.arange(len(column)), np.diff(column.offsets.to_numpy()))
    key = row * size + flat
    start = np.flatnonzero(np.diff(key, prepend=-1))
    n = np.diff(start, append=len(key))
    row, bucket = row[start], flat[start]
    w = (1 + np.log(n)) * idf[bucket]
    length = np.sqrt(np.bincount(row, weights=w * w, minlength=len(column)))
    return row, bucket, w / length[row] if len(row) else w


def _weighted(column: pa.Array, idf: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """(first text, row behind it, bucket, weight) of every ``BLOCK`` texts that have words."""
    for lo in range(0, len(column), SLICE):
        row, bucket, w = weights(pa.concat_arrays([column.slice(lo, SLICE)]), idf)
        edge = np.searchsorted(row, np.arange(0, SLICE + 1, BLOCK))
        for i, (a, b) in enumerate(zip(edge, edge[1:], strict=False)):
            if b > a:
                yield lo + i * BLOCK, row[a:b] - i * BLOCK, bucket[a:b], w[a:b]


def _through(texts: DataFrame, idf: np.ndarray, directions: np.ndarray) -> np.ndarray:
    """The directions sent through the texts and back: a table of buckets by directions.

    Each task adds up its texts in one such table, as products with one matrix of a few
    texts by the buckets they have, and hands it on; tasks are merged by bucket on the
    executors."""
    size = len(idf)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, at = np.zeros_like(directions), np.zeros(size, dtype=np.int64)
        for batch in batches:
            for _, row, bucket, w in _weighted(batch.column(0), idf):
                seen = np.zeros(size, dtype=bool)
                seen[bucket] = True
                used = np.flatnonzero(seen)
                at[used] = np.arange(len(used))
                a = np.zeros((BLOCK, len(used)))
                a[row, at[bucket]] = w
                total[used] += a.T @ (a @ directions[used])
        at = np.flatnonzero(total.any(axis=1))
        lists = _lists(total[at].ravel(), np.arange(len(at) + 1) * total.shape[1])
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), lists], names=["bucket", "z"])

    parts = texts.mapInArrow(run, "bucket int, z array<double>")
    merged = parts.groupBy("bucket").agg(vector_to_array(Summarizer.sum(array_to_vector("z"))).alias("z"))
    out = np.zeros_like(directions)
    for r in merged.collect():  # at most one row per bucket
        out[r.bucket] = r.z
    return out


def fit_semantic(
    df: DataFrame,
    text: str,
    buckets: int = BUCKETS,
    dims: int = DIMS,
    spare: int = SPARE,
    passes: int = PASSES,
    cleaned: bool = False,
    seed: int = 1,
) -> SemanticModel:
    """Fit on every text of ``df``; texts without words, NULL among them, weigh nothing.

    ``text`` may come from :func:`hashed_texts` with the same ``buckets`` and ``cleaned``.
    Without any words the axes are zero. The driver holds tables of ``buckets`` rows and
    ``dims + spare`` columns and solves a problem of ``dims + spare`` rows.
    """
    texts = _buckets(df, text, buckets, cleaned)
    if not isinstance(df.schema[text].dataType, T.ArrayType):
        texts = materialise(texts)
    known = texts.filter(F.size("b") > 0)
    n = known.count()
    counts = known.select(F.explode(F.array_distinct("b")).alias("bucket")).groupBy("bucket").agg(F.count(F.lit(1)).alias("k"))
    idf = np.full(buckets, math.log(1 + n) + 1)
    for r in counts.collect():  # at most one row per bucket
        idf[r.bucket] = math.log((1 + n) / (1 + r.k)) + 1
    width = min(dims + spare, buckets)
    q = np.linalg.qr(np.random.default_rng(seed).standard_normal((buckets, width)))[0]
    for _ in range(passes - 1):
        q = np.linalg.qr(_through(texts, idf, q))[0]
    inner = q.T @ _through(texts, idf, q)
    values, turn = np.linalg.eigh((inner + inner.T) / 2)
    order = np.argsort(-values, kind="stable")[: min(dims, width)]
    basis = q @ turn[:, order]
    basis *= np.where(np.take_along_axis(basis, np.abs(basis).argmax(axis=0)[None], axis=0) < 0, -1.0, 1.0)
    shares = np.maximum(values[order], 0) / max(n, 1)  # every text with words has length one
    return SemanticModel(idf, basis if n else np.zeros_like(basis), shares, cleaned)


def _rounded(x: np.ndarray, digits: int) -> np.ndarray:
    """``x`` as Spark rounds it, halves of its decimal digits away from zero; no negative zero."""
    up = np.abs(x) * 10.0**digits
    whole = np.floor(up + 0.5)
    for i in np.flatnonzero(np.abs(up - np.floor(up) - 0.5) < 1e-6):
        whole[i] = float(Decimal(repr(float(abs(x[i])))).scaleb(digits).quantize(Decimal(1), ROUND_HALF_UP))
    return np.copysign(whole / 10.0**digits, x) + 0.0


def encode_semantic(df: DataFrame, keep: list[str], text: str, model: SemanticModel, digits: int | None = None) -> DataFrame:
    """(keep..., embedding): the place of every text on the axes; zeros without words.

    ``text`` as in :func:`fit_semantic`; ``digits`` rounds places, which are at most 1. A
    text's sum runs along its buckets, whatever its batch."""
    size, dims = model.basis.shape
    rows = _buckets(df, text, size, model.cleaned, keep)
    idf, basis = model.idf, model.basis

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            places = np.zeros((batch.num_rows, dims))
            for lo, row, bucket, w in _weighted(batch.column(batch.num_columns - 1), idf):
                start = np.flatnonzero(np.diff(row, prepend=-1))
                places[lo + row[start]] = np.add.reduceat(w[:, None] * basis[bucket], start, axis=0)
            flat = places.ravel()
            flat = flat if digits is None else _rounded(flat, digits)
            lists = _lists(flat, np.arange(batch.num_rows + 1) * dims)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], lists], names=[*batch.schema.names[:-1], "embedding"])

    extra = T.StructField("embedding", T.ArrayType(T.DoubleType()))
    return rows.mapInArrow(run, T.StructType([*rows.schema.fields[:-1], extra]))


def semantic_evidence(
    texts: DataFrame, keep: list[str], text: str, seeds: DataFrame, model: SemanticModel, k: int
) -> DataFrame:
    """Top k texts per facet by cosine on the axes: (keep..., text, facet, sim, rk).

    A facet is the mean of its seed paragraphs (facet, text). Ties go by ``keep``."""
    seeds = encode_semantic(seeds, ["facet"], "text", model)
    mean = vector_to_array(Summarizer.mean(array_to_vector("embedding")))
    facets = materialise(seeds.groupBy("facet").agg(mean.alias("embedding")))
    placed = encode_semantic(texts, [*keep, text], text, model)
    scored = score_dense(placed, [*keep, text], "embedding", facets, best=k)
    return topk(scored, k, [F.desc("sim"), *(F.col(c) for c in keep)])
