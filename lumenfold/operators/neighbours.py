"""Nearest rows of a stated set of queries, in blocks.

Queries are cut into slices and members into blocks, both of bounded size. Every slice
meets every block in a task of its own, as two matrices; k rows per query leave the task,
and the ranking of these is all that is merged. Distances add up dimension by dimension,
so equal vectors have equal distances and ties go to the smaller id.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenfold.fixed import NEIGHBOURS, SIMILAR_TAKE
from lumenfold.operators.ranking import topk

BLOCK = 8192  # members in a task
SLICE = 2048  # queries in a task
CELLS = 4_000_000  # distances in memory at once
EVERY = 50  # one query in so many ids


def _search(k: int, cosine: bool):
    """k smallest (cost, id) per query; the cost is the squared distance or -cosine."""

    def run(queries: pd.DataFrame, members: pd.DataFrame) -> pd.DataFrame:
        import numpy as np

        empty = pd.DataFrame({"id": [], "other": [], "cost": []})
        if queries.empty or members.empty:
            return empty
        members = members.sort_values("id")
        other = members["id"].to_numpy()
        m = np.stack(members["v"].to_list()).astype("float64")
        q = np.stack(queries["v"].to_list()).astype("float64")
        ids = queries["id"].to_numpy()

        def unit(x):
            length = np.zeros(len(x))
            for d in range(x.shape[1]):
                length += x[:, d] ** 2
            length = np.sqrt(length)[:, None]
            return np.divide(x, length, out=np.zeros_like(x), where=length > 0)

        if cosine:
            m, q = unit(m), unit(q)
        out = [empty]
        step = max(1, CELLS // len(m))
        for lo in range(0, len(q), step):
            part, own = q[lo : lo + step], ids[lo : lo + step]
            cost = np.zeros((len(part), len(m)))
            for d in range(m.shape[1]):
                a, b = part[:, d, None], m[None, :, d]
                cost += -a * b if cosine else (a - b) ** 2
            cost[own[:, None] == other[None, :]] = np.inf
            top = np.argsort(cost, axis=1, kind="stable")[:, :k]
            best = np.take_along_axis(cost, top, axis=1)
            row, col = np.nonzero(np.isfinite(best))
            out.append(
                pd.DataFrame({"id": own[row], "other": other[top[row, col]], "cost": best[row, col]})
            )
        return pd.concat(out[1:])

    return run


def search(
    queries: DataFrame,
    members: DataFrame,
    k: int,
    cosine: bool = False,
    block: int = BLOCK,
    slice_: int = SLICE,
) -> DataFrame:
    """(id, other, cost, rk): the k best members of every query; both are (id, v).

    The work is queries times members, the result k rows per query. A member is sent
    once to each slice of queries. Rows without a vector and ids without one are left
    out; a query never finds its own id.
    """
    usable = "id is not null and v is not null and size(v) > 0"
    queries, members = queries.filter(usable), members.filter(usable)
    slices = max(1, -(-queries.count() // slice_))
    blocks = max(1, -(-members.count() // block))

    def every(n: int):
        return F.explode(F.sequence(F.lit(0), F.lit(n - 1)))

    def part(n: int):
        return F.pmod(F.xxhash64("id"), F.lit(n)).cast("int")

    q = queries.select("id", "v", part(slices).alias("slice"), every(blocks).alias("block"))
    m = members.select("id", "v", every(slices).alias("slice"), part(blocks).alias("block"))
    kind = members.schema["id"].dataType.simpleString()
    found = (
        q.groupBy("slice", "block")
        .cogroup(m.groupBy("slice", "block"))
        .applyInPandas(_search(k, cosine), f"id {kind}, other {kind}, cost double")
    )
    return topk(found, k, [F.col("cost"), F.col("other")], ["id"], salted=False)


def knn(
    df: DataFrame,
    ident: str = "vec_id",
    vector: str = "embedding",
    k: int = NEIGHBOURS,
    every: int = EVERY,
) -> DataFrame:
    """Exact k nearest neighbours of every row whose id is divisible by ``every``, among
    all rows: (id, neighbour, rk, dist2). Ties go to the smaller id."""
    rows = df.select(F.col(ident).alias("id"), F.col(vector).alias("v"))
    found = search(rows.filter(F.col("id") % every == 0), rows, k)
    return found.select(
        "id", F.col("other").alias("neighbour"), "rk", F.col("cost").alias("dist2")
    )


def nearest(
    centroids: DataFrame,
    source: str,
    vector: str,
    take: int = SIMILAR_TAKE,
    block: int = BLOCK,
    slice_: int = SLICE,
) -> DataFrame:
    """The ``take`` most similar other outlets: (source, similar, rk, sim).

    Outlets are a dimension table: all of them are queries, the work is the square of
    their number and the result ``take`` rows each. A zero vector has cosine 0.
    """
    rows = centroids.select(F.col(source).alias("id"), F.col(vector).alias("v"))
    found = search(rows, rows, take, True, block, slice_)
    return found.select(
        F.col("id").alias("source"),
        F.col("other").alias("similar"),
        "rk",
        (-F.col("cost")).alias("sim"),
    )
