"""Nearest neighbours of every row, by neighbour descent.

Rows are sorted along a few random codes and meet in blocks of each order, which gives a
first graph. Then rounds refine it: whoever is a neighbour of a row, or has it as one, meets
all the others that are, since a neighbour's neighbour is likely to be one. Who met in an
earlier round does not meet again there, so rounds shrink as the graph settles, and what could not enter
a row's list leaves no task. A round is two joins and a ranking; rounds end when almost nothing
changes. Equal vectors are one class, so copies neither fill each other's lists nor make one
row the neighbour of all.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lumenfold.fixed import NEIGHBOURS
from lumenfold.operators.lookups import hot_lookup
from lumenfold.operators.ranking import topk
from lumenfold.session import materialise

BLOCK = 512  # rows of one order that meet each other; up to twice as many at its end
ORDERS = 4  # random codes
BITS = 30  # hyperplanes of a code
WIDTH = 32  # neighbours that a row has while the graph is refined
EMIT = 8  # candidates that a row takes from one neighbourhood
GROUP = 256  # members of a row's neighbourhood that meet each other in one round
ROUNDS = 8  # at most
STILL = 0.0005  # share of all costs that a round must save for another one
SPARE = 8  # candidates beyond k whose distance is computed exactly


def _matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return flat.flatten().to_numpy(zero_copy_only=False).astype("float64").reshape(len(flat), -1)


def _best(
    ids: np.ndarray, v: np.ndarray, k: int, new: np.ndarray | None = None
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, other row, squared distance) of the k nearest of every row in one block; with
    ``new``, among the pairs of which one at least is new.

    Products find the candidates; their distances are then computed pair by pair, so a
    pair has the same distance in every block it meets in."""
    n = len(ids)
    take = min(n - 1, k + SPARE)
    if take < 1:
        nothing = np.empty(0, dtype=np.int64)
        return nothing, nothing, np.empty(0)
    norm = np.einsum("ij,ij->i", v, v)
    rough = norm[:, None] + norm[None, :] - 2 * (v @ v.T)
    if new is not None:
        old = np.flatnonzero(~new)
        rough[np.ix_(old, old)] = np.inf
    np.fill_diagonal(rough, np.inf)
    near = np.argpartition(rough, take - 1, axis=1)[:, :take]
    row = np.repeat(np.arange(n), take)
    other = near.ravel()
    met = row != other
    if new is not None:
        met &= new[row] | new[other]
    cost = np.square(v[row] - v[other]).sum(axis=1)
    order = np.lexsort((ids[other], cost, ~met, row))
    row, other, cost = row[order], other[order], cost[order]
    keep = np.tile(np.arange(take) < k, n) & met[order]
    return row[keep], other[keep], cost[keep]


def _links(ids: np.ndarray, v: np.ndarray, k: int, new: np.ndarray | None = None, bar: np.ndarray | None = None) -> pa.RecordBatch:
    """The links of :func:`_best`; with ``bar``, those that are no longer than a row's bar."""
    row, other, cost = _best(ids, v, k, new)
    if bar is not None:
        keep = cost <= bar[row]
        row, other, cost = row[keep], other[keep], cost[keep]
    return pa.RecordBatch.from_arrays(
        [pa.array(ids[row]), pa.array(ids[other]), pa.array(cost)], names=["c", "other", "cost"]
    )


def _codes(mean: np.ndarray, orders: int):
    """Ranks of each vector in the reflected binary order of its hyperplane signs."""
    planes = np.random.default_rng(1).standard_normal((orders, BITS, len(mean)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v = _matrix(batch.column(1)) - mean
            codes = []
            for plane in planes:
                gray = ((v @ plane.T > 0).astype(np.int64) << np.arange(BITS)[::-1]).sum(axis=1)
                rank, shift = gray, 1
                while shift < BITS:
                    rank, shift = rank ^ (rank >> shift), shift * 2
                codes.append(rank)
            flat = pa.array(np.stack(codes, axis=1).ravel())
            ends = pa.array(np.arange(len(v) + 1, dtype=np.int32) * len(planes))
            lists = pa.ListArray.from_arrays(ends, flat)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), lists], names=["c", "v", "codes"])

    return run


def _in_blocks(k: int, block: int):
    """The k nearest of every row among the rows next to it in a sorted partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            held.append(batch.select(["c", "v"]))
            while sum(b.num_rows for b in held) >= 2 * block:
                table = pa.Table.from_batches(held)
                first, rest = table.slice(0, block), table.slice(block)
                yield _links(first.column("c").to_numpy(), _matrix(first.column("v")), k)
                held = rest.to_batches()
        if sum(b.num_rows for b in held) > 1:
            table = pa.Table.from_batches(held)
            yield _links(table.column("c").to_numpy(), _matrix(table.column("v")), k)

    return run


def _in_groups(k: int):
    """The k nearest of every member among the members of one sorted (node, part)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = None
        for batch in (*batches, None):
            tables = [t for t in (rest, None if batch is None else pa.Table.from_batches([batch])) if t is not None]
            if not tables or not sum(t.num_rows for t in tables):
                continue
            table = pa.concat_tables(tables)
            node, part = table.column("node").to_numpy(), table.column("part").to_numpy()
            edge = np.flatnonzero((node[1:] != node[:-1]) | (part[1:] != part[:-1])) + 1
            edge = [0, *edge.tolist()]
            if batch is None:
                edge.append(len(node))
            rest = table.slice(edge[-1])
            if len(edge) < 2:
                continue
            ids = table.column("c").to_numpy()[: edge[-1]]
            v = _matrix(table.column("v").slice(0, edge[-1]))
            new = table.column("new").to_numpy()[: edge[-1]]
            bar = table.column("bar").to_numpy()[: edge[-1]]
            spans = [slice(a, b) for a, b in zip(edge, edge[1:], strict=False) if b - a > 1]
            out = [_links(ids[x], v[x], k, new[x], bar[x]) for x in spans if new[x].any()]
            if out:
                yield pa.Table.from_batches(out).combine_chunks().to_batches()[0]

    return run


_LINK = "c long, other long, cost double"


def _merged(links: DataFrame, k: int, parts: int) -> DataFrame:
    """The k best of every class, new only if no link says otherwise. Rows are dealt by class
    once, for both steps."""
    best = [F.min("cost").alias("cost"), F.min("new").alias("new")]
    dealt = links.repartition(parts, "c").groupBy("c", "other").agg(*best)
    return topk(dealt, k, [F.col("cost"), F.col("other")], ["c"], salted=False).drop("rk")


def _first_graph(coded: DataFrame, n: int, k: int, block: int, orders: int, parts: int) -> DataFrame:
    few = max(1, min(parts, n // (8 * block)))
    found = None
    for r in range(orders):
        code = F.col("codes")[r]
        dealt = coded.select("c", "v", code.alias("code")).repartitionByRange(few, "code", "c").sortWithinPartitions("code", "c")
        links = dealt.mapInArrow(_in_blocks(k, block), _LINK)
        found = links if found is None else found.unionByName(links)
    return _merged(found.withColumn("new", F.lit(True)), k, parts)


def _refined(graph: DataFrame, rows: DataFrame, k: int, salt: int, parts: int) -> DataFrame:
    """One round, over the neighbourhoods with a new link. A neighbourhood beyond ``GROUP``
    members is dealt to parts anew in each."""
    both = graph.select(F.col("c").alias("node"), F.col("other").alias("c"), "new")
    both = both.unionByName(graph.select(F.col("other").alias("node"), "c", "new"))
    both = both.unionByName(rows.select(F.col("c").alias("node"), "c", F.lit(False).alias("new")))
    # Who was a member before, in either direction, is not new.
    members = both.repartition(parts, "node").groupBy("node", "c").agg(F.min("new").alias("new"))
    of_node = W.partitionBy("node")
    members = members.withColumn("n", F.count(F.lit(1)).over(of_node)).withColumn("any", F.max("new").over(of_node))
    part = F.pmod(F.xxhash64("c", F.lit(salt)), F.ceil(F.col("n") / F.lit(GROUP))).cast("long")
    busy = members.filter("any").select("node", part.alias("part"), "c", "new")
    # A full list takes no link that is longer than its longest.
    full = F.when(F.count(F.lit(1)) >= k, F.max("cost")).alias("bar")
    barred = rows.join(graph.groupBy("c").agg(full), "c", "left")
    barred = barred.select("c", "v", F.coalesce("bar", F.lit(float("inf"))).alias("bar"))
    dealt = busy.join(barred, "c").repartition(parts, "node", "part").sortWithinPartitions("node", "part", "c")
    links = dealt.select("node", "part", "c", "new", "bar", "v").mapInArrow(_in_groups(EMIT), _LINK)
    return _merged(links.withColumn("new", F.lit(True)).unionByName(graph.withColumn("new", F.lit(False))), k, parts)


def class_graph(rows: DataFrame, k: int, block: int = BLOCK, orders: int = ORDERS, rounds: int = ROUNDS, width: int = WIDTH) -> DataFrame:
    """(c, other, cost): k neighbours of every row of (c long, v), all vectors different."""
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    n = rows.count()
    if not n:
        return rows.select("c", F.col("c").alias("other"), F.lit(0.0).alias("cost"))
    mean = rows.agg(vector_to_array(Summarizer.mean(array_to_vector("v"))).alias("m")).first()["m"]
    kind = rows.schema["v"].dataType.simpleString()
    coded = rows.select("c", "v").mapInArrow(_codes(np.array(mean), orders), f"c long, v {kind}, codes array<long>")
    if n <= 2 * block:  # one block holds all rows: the graph is exact
        return _first_graph(coded, n, k, block, 1, parts).drop("new")
    wide = max(k, width)
    graph = materialise(_first_graph(materialise(coded), n, wide, block, orders, parts))
    before = None
    for salt in range(rounds):
        links, total = graph.agg(F.count(F.lit(1)), F.sum("cost")).first()
        now = (links, total)
        if before and links == before[0] and total > before[1] * (1 - STILL):
            break
        before = now
        graph = materialise(_refined(graph, rows, wide, salt, parts))
    return topk(graph, k, [F.col("cost"), F.col("other")], ["c"], salted=False).drop("rk", "new")


def knn_graph(
    df: DataFrame,
    ident: str = "vec_id",
    vector: str = "embedding",
    k: int = NEIGHBOURS,
    block: int = BLOCK,
    orders: int = ORDERS,
    rounds: int = ROUNDS,
) -> DataFrame:
    """k neighbours of every row with a vector: (id, neighbour, rk, dist2).

    Up to two blocks of different vectors the neighbours are exact, beyond that nearly
    all of them are. Equal distances go to the smaller id, copies of a vector to each
    other first. Rows without an id or a vector are left out, repeated rows count
    once, and there are fewer than k neighbours only where there are fewer rows.
    """
    usable = f"`{ident}` is not null and `{vector}` is not null and size(`{vector}`) > 0"
    rows = df.filter(usable).select(F.col(f"`{ident}`").alias("id"), F.col(f"`{vector}`").alias("v")).distinct()
    rows = materialise(rows)
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # A class is numbered in the order of its smallest id and knows its k + 1 smallest.
    first = topk(rows, k + 1, [F.col("id")], ["v"]).groupBy("v").agg(F.sort_array(F.collect_list("id")).alias("ids"))
    sizes = rows.groupBy("v").agg(F.count(F.lit(1)).alias("n"))
    classes = first.join(sizes, "v").repartitionByRange(parts, F.col("ids")[0]).sortWithinPartitions(F.col("ids")[0])
    classes = materialise(classes.withColumn("c", F.monotonically_increasing_id()))
    graph = class_graph(classes.select("c", "v"), k, block, orders, rounds)
    # What any member of a class may list: members of its own class and of its neighbours.
    lists = classes.select(F.col("c").alias("other"), "ids")
    listed = graph.join(lists, "other").select("c", "cost", F.explode("ids").alias("id"))
    own = classes.filter("n > 1").select("c", F.lit(0.0).alias("cost"), F.explode("ids").alias("id"))
    best = topk(listed.unionByName(own), k + 1, [F.col("cost"), F.col("id")], ["c"], salted=False)
    best = best.groupBy("c").agg(F.sort_array(F.collect_list(F.struct("cost", "id"))).alias("best"))
    best = materialise(best.join(classes.select("c", "n"), "c"))
    single = classes.filter("n = 1").select(F.col("ids")[0].alias("id"), "c")
    several = hot_lookup(rows, materialise(classes.filter("n > 1").select("v", "c", "n")), "v", "n", "inner")
    member = single.unionByName(several.select("id", "c"))
    found = hot_lookup(member, best, "c", "n", "inner")
    others = F.slice(F.filter("best", lambda b: b["id"] != F.col("id")), 1, k)
    return found.select("id", F.posexplode(others).alias("rk", "b")).select(
        "id", F.col("b.id").alias("neighbour"), (F.col("rk") + 1).alias("rk"), F.col("b.cost").alias("dist2")
    )
