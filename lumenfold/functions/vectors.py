"""Sparse term vectors and dense vectors, computed inside one row.

A text is encoded as its sorted word buckets, or as counts per bucket. Both are one
SQL expression over a column, so scoring texts needs no shuffle. A one-element
``transform(array(x), name -> ...)[0]`` names a value that is used several times, so
that it is computed once per row.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from lumenfold.fixed import ENCODER_DIMS
from lumenfold.functions.text import NOT_WORD_RUN, col


def bind(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once per row and use it several times in ``body``."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def term_buckets_sql(text: str, dims: int = ENCODER_DIMS, cleaned: bool = False) -> str:
    """Sorted buckets of all words of the text named ``text``.

    A word's bucket is the first 32 bits of its MD5 modulo ``dims``.
    """
    cut = "' '" if cleaned else f"r'{NOT_WORD_RUN}'"
    terms = f"array_remove(split(lower({text}), {cut}), '')"
    bucket = f"cast(cast(conv(left(md5(w), 8), 16, 10) as bigint) % {dims} as int)"
    return f"sort_array(transform({terms}, w -> {bucket}))"


def term_vector(text: str, dims: int = ENCODER_DIMS, cleaned: bool = False) -> Column:
    """Hashed term counts: the sorted buckets, cut where the value changes."""
    starts = (
        "filter(transform(b, (x, i) -> struct(x as bucket, i as at)),"
        " r -> r.at = 0 or get(b, r.at - 1) <> r.bucket)"
    )
    runs = (
        "transform(runs, (r, j) -> struct(r.bucket as bucket,"
        " coalesce(get(runs, j + 1).at, size(b)) - r.at as n))"
    )
    return F.expr(
        f"transform(array({term_buckets_sql(text, dims, cleaned)}),"
        f" b -> transform(array({starts}), runs -> {runs})[0])[0]"
    )


def buckets_norm(buckets: str) -> Column:
    """Squared norm of the term counts behind a column of sorted buckets."""
    starts = (
        f"filter(transform({buckets}, (x, i) -> if(i > 0 and {buckets}[i - 1] = x, -1, i)),"
        " i -> i >= 0)"
    )
    length = f"bigint(coalesce(get(s, j + 1), size({buckets})) - at)"
    return F.expr(
        f"transform(array({starts}), s -> aggregate(transform(s, (at, j) -> {length}),"
        " 0L, (acc, n) -> acc + n * n))[0]"
    )


def dot_buckets_sql(buckets: str, counts: str) -> str:
    """Dot product of the term counts with a full ``array<long>`` of counts."""
    return f"aggregate({buckets}, 0L, (acc, x) -> acc + get({counts}, x))"


def cosine_sql(dot: str, norm_a: str, norm_b: str) -> str:
    """Cosine from integer parts; a zero vector is similar to nothing (0.0)."""
    length = f"sqrt(double({norm_a}) * double({norm_b}))"
    return f"coalesce(try_divide(double({dot}), {length}), 0.0D)"


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda acc, x: acc + x)


def dot_dense(a: Column, b: Column) -> Column:
    return _sum(
        F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    )


def cosine_dense(a: Column | str, b: Column | str) -> Column:
    """Cosine of two array columns; 0.0 if either is a zero vector."""
    a, b = col(a), col(b)
    norms = F.sqrt(dot_dense(a, a)) * F.sqrt(dot_dense(b, b))
    return bind(
        norms, lambda n: F.when(n == 0, F.lit(0.0)).otherwise(dot_dense(a, b) / n)
    )


def first_max(scores: Column | str, labels: Column | str) -> Column:
    """Label of the highest score; the first one wins a tie."""
    s = col(scores)
    return F.get(col(labels), (F.array_position(s, F.array_max(s)) - 1).cast("int"))
