"""Lexicon scores, encodings and similarity to facets."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lumenfold.fixed import EMOTIONS, ENCODER_DIMS
from lumenfold.functions.text import NOT_WORD_RUN, words
from lumenfold.functions.vectors import (
    buckets_norm,
    cosine_dense,
    cosine_sql,
    dot_buckets_sql,
    term_buckets_sql,
    term_vector,
)
from lumenfold.operators.lookups import TooManyRows, lookup_join, small_literal, small_rows

FACETS = 64  # facets in one literal, or in one block of a larger set
WEIGHT = "decimal(28, 18)"  # lexicon weights; their sums do not depend on order


def text_words(df: DataFrame, ids: list[str], text: str, cleaned: bool = False) -> DataFrame:
    """One row per word: (ids..., _text, _place, term); a text without words keeps one row.

    ``_text`` is a digest, and a text is known by it and its ids: no row number that a
    task computed again could change. Rows that are equal in both give equal scores:
    :func:`copies` counts them, and :func:`each_copy` gives every one its own row.
    """
    rows = df.select(*ids, F.md5(F.coalesce(F.col(text), F.lit("-"))).alias("_text"), words(text, cleaned).alias("_words"))
    return rows.select(*ids, "_text", F.posexplode_outer("_words").alias("_place", "term"))


def copies() -> Column:
    """The number of equal rows behind one group of :func:`text_words`."""
    return F.count_if(F.coalesce(F.col("_place"), F.lit(0)) == 0).alias("_copies")


def each_copy(df: DataFrame, ids: list[str], columns: list[Column]) -> DataFrame:
    """One row per copy, with the ids and some columns of ``df``."""
    found = df.select(*ids, *columns, F.col("_copies"))
    names = [c for c in found.columns if c != "_copies"]
    return found.select(*names, F.explode(F.sequence(F.lit(1).cast("long"), "_copies")).alias("_copy")).drop("_copy")


def _weight(column: str) -> Column:
    return F.col(column).cast(WEIGHT)


def lexicon_scores(
    df: DataFrame,
    ids: list[str],
    text: str,
    lexicon: DataFrame,
    cleaned: bool = False,
) -> DataFrame:
    """Mean polarity and subjectivity of a text's known words; 0.0 if it has none.

    One row per row of ``df``, which carries ``ids``, also where they are equal;
    ``cleaned`` as in :func:`words`. Weights are summed as decimals, so the result does
    not depend on the order of rows. All words of a text are in one task, and the
    partial aggregate leaves one row per text to shuffle.
    """
    weights = lexicon.select(
        "term",
        _weight("polarity").alias("p"),
        _weight("subjectivity").alias("s"),
    )
    hits = lookup_join(text_words(df, ids, text, cleaned), weights, "term")
    sums = hits.groupBy("_text", *ids).agg(
        F.count("p").alias("n"), F.sum("p").alias("p"), F.sum("s").alias("s"), copies()
    )

    def mean(total: str) -> Column:
        return F.when(F.col("n") == 0, F.lit(0.0)).otherwise(
            F.col(total).cast("double") / F.col("n")
        )

    return each_copy(sums, ids, [mean("p").alias("polarity"), mean("s").alias("subjectivity")])


def polarity(
    df: DataFrame, ids: list[str], text: str, lexicon: DataFrame, cleaned: bool = False
) -> DataFrame:
    return lexicon_scores(df, ids, text, lexicon, cleaned).select(*ids, "polarity")


def subjectivity(
    df: DataFrame, ids: list[str], text: str, lexicon: DataFrame, cleaned: bool = False
) -> DataFrame:
    return lexicon_scores(df, ids, text, lexicon, cleaned).select(*ids, "subjectivity")


def emotion_scores(
    df: DataFrame,
    ids: list[str],
    text: str,
    lexicon: DataFrame,
    labels: list[str] = EMOTIONS,
) -> DataFrame:
    """One score per label, as two lists in label order; one row per row of ``df``.

    A lexicon row with a label beyond ``labels`` is an error.

    One aggregate per label gives the complete grid of labels, zeros included,
    without a join to the labels.
    """
    ordered = sorted(labels)
    at = F.array_position(F.lit(ordered), F.col("emotion"))
    unknown = F.raise_error(F.concat(F.lit("unknown label: "), F.col("emotion")))
    weights = lexicon.select(
        "term",
        F.when(at > 0, at - 1).otherwise(unknown.cast("long")).alias("label"),
        _weight("weight").alias("w"),
    )
    hits = lookup_join(text_words(df, ids, text), weights, "term")
    sums = hits.groupBy("_text", *ids).agg(
        *[
            F.expr(f"double(coalesce(sum(w) filter (where label = {i}), 0)) as _{i}")
            for i in range(len(ordered))
        ],
        copies(),
    )
    scores = F.array(*[F.col(f"_{i}") / F.col("_copies") for i in range(len(ordered))])
    return each_copy(sums, ids, [F.lit(ordered).alias("emotion"), scores.alias("score")])


def encode_terms(
    df: DataFrame, ids: list[str], text: str, dims: int = ENCODER_DIMS, cleaned: bool = False
) -> DataFrame:
    """Text → sparse hashed term counts in long form (ids, bucket, n)."""
    return df.select(*ids, F.inline(term_vector(text, dims, cleaned)))


def encode_facets(seeds: DataFrame, dims: int = ENCODER_DIMS) -> DataFrame:
    """Seed paragraphs (facet, text) → (facet, counts, norm), one row per facet.

    A facet may have any number of paragraphs: their counts add up before the
    shuffle, to at most ``dims`` rows per facet.
    """
    buckets = (
        encode_terms(seeds, ["facet"], "text", dims)
        .groupBy("facet", "bucket")
        .agg(F.sum("n").alias("n"))
    )
    gathered = buckets.groupBy("facet").agg(
        F.map_from_entries(F.collect_list(F.struct("bucket", "n"))).alias("m"),
        F.sum(F.col("n") * F.col("n")).alias("norm"),
    )
    full = F.transform(
        F.sequence(F.lit(0), F.lit(dims - 1)),
        lambda b: F.coalesce(F.try_element_at(F.col("m"), b), F.lit(0).cast("long")),
    )
    return gathered.select("facet", full.alias("counts"), "norm")


def _with_facets(df: DataFrame, facets: DataFrame) -> DataFrame:
    """Add ``_facets``, facets as an array of structs; each row meets each facet once.

    Up to ``FACETS`` facets are one literal of the plan: no join and no shuffle. More
    are cut into blocks of about that size; a row is repeated for every block, as it
    will be for every facet, and joined to it, with the block salted on both sides.
    """
    try:
        return df.withColumn("_facets", small_literal(facets, FACETS, "facets"))
    except TooManyRows:
        pass
    blocks = -(-facets.count() // FACETS)
    salts = df.sparkSession.sparkContext.defaultParallelism
    block = F.pmod(F.xxhash64("facet"), F.lit(blocks)).cast("int")
    packed = (
        facets.withColumn("_block", block)
        .groupBy("_block")
        .agg(F.sort_array(F.collect_list(F.struct(*facets.columns))).alias("_facets"))
        .withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    )
    return (
        df.withColumn("_salt", F.pmod(F.monotonically_increasing_id(), F.lit(salts)).cast("int"))
        .withColumn("_block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
        .join(packed, ["_block", "_salt"])
        .drop("_block", "_salt")
    )


Scores = Callable[[pa.Array], Iterator[np.ma.MaskedArray]]


def _kept(sim: np.ma.MaskedArray, best: int | None) -> np.ndarray | None:
    """The rows that can be among the ``best`` of their batch, equal ones included; None: all."""
    if best is None or len(sim) <= best:
        return None
    value = sim.filled(-np.inf)
    bar = np.partition(value, len(value) - best)[len(value) - best]  # NaN is the highest
    return np.flatnonzero(np.isnan(value) | (value >= bar))


def _scored(rows: DataFrame, scores: Scores, facets: list[Row], kind: T.DataType, best: int | None) -> DataFrame:
    """``rows`` with its last column replaced by (facet, sim), each row for every facet."""
    keep = rows.columns[:-1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, sim in enumerate(scores(batch.column(batch.num_columns - 1))):
                rest, kept = batch.select(range(len(keep))).columns, _kept(sim, best)
                if kept is not None:
                    sim, rest = sim[kept], [c.take(pa.array(kept)) for c in rest]
                values = pa.array(sim.data, mask=np.ma.getmaskarray(sim))
                place = pa.array(np.full(len(sim), at, dtype=np.int32))
                yield pa.RecordBatch.from_arrays([*rest, place, values], names=[*keep, "_facet", "sim"])

    extra = [T.StructField("_facet", T.IntegerType()), T.StructField("sim", T.DoubleType())]
    found = rows.mapInArrow(run, T.StructType([*rows.schema.fields[:-1], *extra]))
    names = F.array(*[F.lit(f["facet"]).cast(kind) for f in facets])
    return found.select(*keep, F.get(names, F.col("_facet")).alias("facet"), "sim")


def spaced_words(text: str, cleaned: bool) -> Column:
    """The words of :func:`words` one space apart, as UTF-8; there may be spaces around them."""
    lower = F.lower(F.col(text))
    return (lower if cleaned else F.regexp_replace(lower, NOT_WORD_RUN, " ")).cast("binary")


def batch_words(column: pa.Array) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
    """(row, code, different words) of a column of :func:`spaced_words`, in reading order; a
    code is a word's place in the list."""
    lists = pc.split_pattern(column, " ")
    row = np.repeat(np.arange(len(column)), pc.fill_null(pc.list_value_length(lists), 0).to_numpy())
    flat = lists.flatten().dictionary_encode()
    found, code = flat.dictionary.to_pylist(), flat.indices.to_numpy()
    word = np.array([bool(w) for w in found], dtype=bool)[code]
    return row[word], code[word], found


def batch_buckets(column: pa.Array, dims: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, bucket) of every word of a column, as :func:`term_buckets_sql` has them."""
    row, code, found = batch_words(column)
    of_word = [int.from_bytes(hashlib.md5(w).digest()[:4], "big") % dims for w in found]
    return row, np.array(of_word, dtype=np.int64)[code]


def _word_scores(facets: list[Row], dims: int) -> Scores:
    """Cosine of the term counts of words, one space apart, with every facet."""
    counts = [np.array(f["counts"], dtype="float64") for f in facets]
    norms = [float(f["norm"]) for f in facets]

    def scores(column: pa.Array) -> Iterator[np.ma.MaskedArray]:
        n = len(column)
        row, bucket = batch_buckets(column, dims)
        key, count = np.unique(row * dims + bucket, return_counts=True)
        # Sums of whole numbers, exact as floats.
        norm = np.bincount(key // dims, weights=count.astype("float64") ** 2, minlength=n)
        for c, facet_norm in zip(counts, norms, strict=True):
            dot = np.bincount(row, weights=c[bucket], minlength=n)
            length = np.sqrt(norm * facet_norm)
            yield np.ma.MaskedArray(np.divide(dot, length, out=np.zeros(n), where=length != 0))

    return scores


def score_sparse(
    df: DataFrame,
    keep: list[str],
    text: str,
    seeds: DataFrame,
    dims: int = ENCODER_DIMS,
    cleaned: bool = False,
    best: int | None = None,
) -> DataFrame:
    """Every text with every facet → (keep..., facet, sim).

    A text is encoded and scored in its task, many at a time. With up to ``FACETS``
    facets the job has no join and no shuffle of texts. With ``best``, rows that
    cannot be among so many best ones of a facet may be left out.
    """
    facets = encode_facets(seeds, dims)
    try:
        few = small_rows(facets, FACETS, "facets")
    except TooManyRows:
        return _score_sparse_blocks(df, keep, text, facets, dims, cleaned)
    rows = df.select(*keep, spaced_words(text, cleaned).alias("_words"))
    return _scored(rows, _word_scores(few, dims), few, facets.schema["facet"].dataType, best)


def _score_sparse_blocks(
    df: DataFrame, keep: list[str], text: str, facets: DataFrame, dims: int, cleaned: bool
) -> DataFrame:
    """:func:`score_sparse` with blocks of facets, joined."""
    encoded = df.select(
        *keep, F.expr(term_buckets_sql(text, dims, cleaned)).alias("_buckets")
    ).select("*", buckets_norm("_buckets").alias("_norm"))
    sim = cosine_sql(dot_buckets_sql("_buckets", "f.counts"), "_norm", "f.norm")
    return _with_facets(encoded, facets).select(
        *keep,
        F.expr(f"inline(transform(_facets, f -> struct(f.facet as facet, {sim} as sim)))"),
    )


def cosine_sparse(a: DataFrame, b: DataFrame, a_id: str, b_id: str) -> DataFrame:
    """Cosine of long-form vectors (id, bucket, n) that share a bucket.

    ``b`` is a set of query vectors: few ids, so few rows per bucket. Pairs that
    share no bucket have cosine 0 and are not listed.
    """
    na = a.groupBy(a_id).agg(F.sum(F.col("n").cast("long") * F.col("n")).alias("_na"))
    nb = b.groupBy(b_id).agg(F.sum(F.col("n").cast("long") * F.col("n")).alias("_nb"))
    queries = b.join(nb, b_id).select("bucket", b_id, F.col("n").alias("_m"), "_nb")
    dots = (
        lookup_join(a, queries, "bucket", "inner")
        .groupBy(a_id, b_id, "_nb")
        .agg(F.sum(F.col("n").cast("long") * F.col("_m")).alias("dot"))
    )
    return dots.join(na, a_id).select(
        a_id, b_id, "dot", F.expr(cosine_sql("dot", "_na", "_nb")).alias("sim")
    )


def _in_order(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Products of the columns of two matrices added up from the first row to the last, so
    that a vector's sum does not depend on its batch."""
    total = np.zeros(a.shape[1])
    for x, y in zip(a, b, strict=True):
        total += x * y
    return total


def _vector_scores(facets: list[Row]) -> Scores:
    """Cosine of vectors with every facet, as :func:`cosine_dense`: 0.0 if either is a zero
    vector, NULL where a value is missing or lengths differ."""
    vectors = [f["embedding"] for f in facets]
    whole = [v is not None and None not in v for v in vectors]
    vectors = [np.array(v if ok else [], dtype="float64")[:, None] for v, ok in zip(vectors, whole, strict=True)]

    def scores(column: pa.Array) -> Iterator[np.ma.MaskedArray]:
        n = len(column)
        size = pc.fill_null(pc.list_value_length(column), -1).to_numpy()
        flat = column.flatten()
        start = np.concatenate(([0], np.cumsum(np.maximum(size, 0))))[:-1]
        lost = size < 0
        if flat.null_count:
            lost |= np.isin(np.arange(n), np.repeat(np.arange(n), np.maximum(size, 0))[flat.is_null().to_numpy(zero_copy_only=False)])
        values = flat.to_numpy(zero_copy_only=False).astype("float64")
        groups = []  # rows without gaps by length, one matrix each, vectors as columns
        for d in np.unique(size[~lost]):
            rows = np.flatnonzero(~lost & (size == d))
            m = np.ascontiguousarray(values[start[rows][None, :] + np.arange(d)[:, None]])
            groups.append((rows, m, np.sqrt(_in_order(m, m))))
        for v, ok in zip(vectors, whole, strict=True):
            sim, gone = np.zeros(n), np.ones(n, dtype=bool)
            for rows, m, length in groups if ok else []:
                norms = length * np.sqrt(_in_order(v, v))
                if len(v) == len(m):
                    with np.errstate(divide="ignore", invalid="ignore"):
                        sim[rows] = np.where(norms == 0, 0.0, _in_order(m, np.broadcast_to(v, m.shape)) / norms)
                    gone[rows] = False
                else:
                    gone[rows] = norms != 0
            yield np.ma.MaskedArray(sim, mask=gone)

    return scores


def score_dense(
    df: DataFrame, keep: list[str], vector: str, facets: DataFrame, best: int | None = None
) -> DataFrame:
    """Dense form of :func:`score_sparse`; ``facets`` is (facet, embedding)."""
    facets = facets.select("facet", "embedding")
    rows = df.select(*keep, F.col(vector).cast("array<double>").alias("_v"))
    try:
        few = small_rows(facets, FACETS, "facets")
    except TooManyRows:
        pass
    else:
        return _scored(rows, _vector_scores(few), few, facets.schema["facet"].dataType, best)
    scores = F.transform(
        "_facets",
        lambda f: F.struct(
            f["facet"].alias("facet"),
            cosine_dense("_v", f["embedding"]).alias("sim"),
        ),
    )
    return _with_facets(rows, facets).select(*keep, F.inline(scores))


def source_centroids(df: DataFrame, source: str, vector: str) -> DataFrame:
    """Mean vector per source; rows without a vector do not count.

    The partial aggregate leaves one row per source and task, so a source that holds
    a third of all vectors is no hot key.
    """
    rows = df.filter(F.col(vector).isNotNull()).select(source, array_to_vector(vector).alias("_v"))
    mean = vector_to_array(Summarizer.mean(F.col("_v")))
    return rows.groupBy(source).agg(mean.alias("embedding"))
