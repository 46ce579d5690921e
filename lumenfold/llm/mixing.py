"""Mixing sources to target weights with a curriculum that varies over time.

Every source has a weight and a schedule, a linear density over training time from 0 to 1
that integrates to one. A source's share of all words is its weight times that integral.
The words of a source form a stream: its documents in a fixed pseudo-random order, read
again from the start when the target exceeds the source. The place of a document copy in
the stream, divided by the target, is a share of the source's demand; the inverse of the
integrated schedule turns it into a training position, and copies are sorted by position
across the cluster. Prefix sums run in cells of a few thousand documents with one offset
per cell, so a source with a third of all rows is spread over many tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumenfold.llm.common import WORD, hot_join, stored, text_of

#: Weights of the sources in code point order, repeating.
WEIGHTS = (1, 2, 3)
#: Most times that a source, and so a document, is read.
MOST = 3
#: Slope of each weight's schedule: density 1 - slope at time 0, 1 + slope at time 1.
SLOPES = (-0.5, 0.0, 0.5)
#: Documents in a cell, on average.
CELL = 4096
#: Sources whose table is broadcast; with more, source rows are matched by ``hot_join``.
SOURCES = 100_000


def _facts(id_col: str, source_col: str, text_col: str) -> dict[str, Column]:
    """Columns that a row's place depends on. ``src`` is the source and never NULL; ``h``
    has 60 bits and orders the stream of a source, by the id or else the text."""
    source, ident = F.col(f"`{source_col}`").cast("string"), F.col(f"`{id_col}`").cast("string")
    digest = F.md5(F.coalesce(ident, F.concat(F.lit("text "), text_of(text_col))))
    return {
        "src": F.coalesce(F.concat(F.lit("="), source), F.lit("")),
        "size": F.regexp_count(text_of(text_col), F.lit(WORD)).cast("long"),
        "h": F.conv(F.substring(digest, 1, 15), 16, 10).cast("long"),
    }


def sized(df: DataFrame, id_col: str, source_col: str, text_col: str) -> DataFrame:
    """Stored (doc_id, src, size, h), one row per input row."""
    facts = _facts(id_col, source_col, text_col)
    return stored(df.select(F.col(f"`{id_col}`").alias("doc_id"), *(c.alias(n) for n, c in facts.items())))


def source_targets(rows: DataFrame, weights=WEIGHTS, most: int = MOST) -> DataFrame:
    """Stored (src, n, source_size, slope, cells, target), one row per source.

    Sources are numbered by a range sort, with one count per partition as offset. Then
    targets above ``most`` times their source are held there and the rest is shared by
    weight again, until none is above; each round is one aggregate of two sums.
    """
    spark = rows.sparkSession
    sums = rows.groupBy("src").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n"))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    order = [F.col("src") == "", F.col("src")]
    ordered = stored(
        sums.repartitionByRange(parts, *order)
        .sortWithinPartitions(*order)
        .withColumn("part", F.spark_partition_id())
        .withColumn("at", F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1))
    )
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = ordered.groupBy("part").agg(F.count(F.lit(1)).alias("k"))  # at most one row per partition
    offsets = offsets.select("part", F.coalesce(F.sum("k").over(before), F.lit(0)).alias("offset"))
    rank = F.col("at") + F.col("offset")
    turn = F.pmod(rank, F.lit(len(weights))).cast("int")
    pick = lambda values: F.element_at(F.array(*map(F.lit, values)), turn + 1)
    known = stored(
        ordered.join(F.broadcast(offsets), "part").select(
            "src",
            "n",
            "source_size",
            pick(weights).alias("weight"),
            pick([SLOPES[i % len(SLOPES)] for i in range(len(weights))]).alias("slope"),
            (F.col("source_size") * most).alias("cap"),
        )
    )
    total = known.agg(F.coalesce(F.sum("source_size"), F.lit(0))).first()[0]
    unit = 0.0
    held = F.lit(False)
    while True:
        caps, free = known.agg(F.sum(F.when(held, F.col("cap")).otherwise(0)), F.sum(F.when(held, 0).otherwise(F.col("weight")))).first()
        if not free:
            break
        unit = (total - caps) / free
        above = held | (F.lit(unit) * F.col("weight") > F.col("cap"))
        if not known.filter(above & ~held).limit(1).count():
            break
        held = above
    target = F.when(held, F.col("cap").cast("double")).otherwise(F.lit(unit) * F.col("weight"))
    cells = F.greatest(F.lit(1), F.ceil(F.col("n") / CELL)).cast("long")
    return stored(known.select("src", "n", "source_size", "slope", cells.alias("cells"), target.alias("target")))


def with_cells(rows: DataFrame, targets: DataFrame) -> DataFrame:
    """The rows with the columns of their source and their cell in its stream."""
    if targets.limit(SOURCES + 1).count() <= SOURCES:
        met = rows.join(F.broadcast(targets.drop("n")), "src")
    else:
        met = hot_join(rows, targets, ["src"], "n")
    return met.withColumn("cell", F.shiftright(F.shiftright("h", 30) * F.col("cells"), 30)).drop("cells")


def cell_offsets(celled: DataFrame) -> DataFrame:
    """Stored (src, cell, offset): the words of a source before the cell."""
    sums = celled.groupBy("src", "cell").agg(F.sum("size").alias("words"))
    before = Window.partitionBy("src").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    return stored(sums.select("src", "cell", F.coalesce(F.sum("words").over(before), F.lit(0)).alias("offset")))


def demand(celled: DataFrame, offsets: DataFrame, *tie: Column, most: int = MOST) -> DataFrame:
    """The rows with ``start``, their offset in one reading of their source, and
    ``copies``, the times they are read.

    A reading counts if the middle of the document lies within the target, so a source
    ends within half a document of it. A document without words is read once. Rows meet
    their cell's offset and are summed up in it after one shuffle by cell; a cell holds
    a few thousand rows, whatever the source.
    """
    inside = (
        Window.partitionBy("src", "cell")
        .orderBy("h", *tie, "size")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    placed = celled.join(offsets.hint("merge"), ["src", "cell"])
    start = F.col("offset") + F.coalesce(F.sum("size").over(inside), F.lit(0))
    placed = placed.withColumn("start", start).drop("offset", "cell")
    copies = sum(
        (2 * (k * F.col("source_size") + F.col("start")) + F.col("size") <= 2 * F.col("target")).cast("int")
        for k in range(most)
    )
    return placed.withColumn("copies", F.when(F.col("size") == 0, F.lit(1)).otherwise(copies))


def position(copy):
    """Training time of a copy: the inverse of the source's integrated schedule."""
    words = copy * F.col("source_size") + F.col("start") + F.col("size") / 2
    u = F.least(F.lit(1.0), F.when(F.col("target") > 0, words / F.col("target")).otherwise(F.lit(0.0)))
    s = F.col("slope")
    root = F.sqrt((1 - s) * (1 - s) + 4 * s * u)
    return F.when(s == 0, u).otherwise((s - 1 + root) / (2 * s))


def training_order(*tie: Column) -> list[Column]:
    """What copies are sorted by: the training position, then the digest of the id."""
    return [F.col("position"), F.col("h"), *tie, F.col("copy")]


def each_copy(placed: DataFrame) -> DataFrame:
    """The rows of ``demand`` once per copy, with ``copy`` and its ``position``."""
    copies = placed.filter("copies > 0").withColumn("copy", F.explode(F.sequence(F.lit(0), F.col("copies") - 1)))
    return copies.withColumn("position", position(F.col("copy")))


def ranks(copies: DataFrame, *tie: Column) -> DataFrame:
    """The copies with ``rank``, their place among all of them in training order, from 0.

    Ranks are the places in the partitions of a range sort plus one offset per partition.
    """
    parts = int(copies.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = stored(
        copies.repartitionByRange(parts, *training_order(*tie))
        .sortWithinPartitions(*training_order(*tie), "size")
        .withColumn("part", F.spark_partition_id())
        .withColumn("at", F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1))
    )
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = ranged.groupBy("part").agg(F.count(F.lit(1)).alias("k"))  # at most one row per partition
    offsets = offsets.select("part", F.coalesce(F.sum("k").over(before), F.lit(0)).alias("offset"))
    rank = F.col("at") + F.col("offset")
    return ranged.join(F.broadcast(offsets), "part").withColumn("rank", rank).drop("part", "at", "offset")


def _demanded(df: DataFrame, id_col: str, source_col: str, text_col: str) -> DataFrame:
    rows = sized(df, id_col, source_col, text_col)
    celled = with_cells(rows, source_targets(rows))
    return demand(celled, cell_offsets(celled), F.col("doc_id").asc_nulls_last())


def schedule(df: DataFrame, id_col="doc_id", source_col="source", text_col="text") -> DataFrame:
    """One row per copy: ``doc_id, copy, position, rank``.

    ``position`` is the training time from 0 to 1, ``rank`` the place of the copy among
    all copies, from 0; ``mix`` writes the documents in this order. A NULL text has size 0
    and is read once, at its place in the stream; NULL is a source of its own, last in
    order. Rows that repeat an id are documents of their own, and rows repeated whole
    are interchangeable. An empty table gives no rows.
    """
    copies = each_copy(_demanded(df, id_col, source_col, text_col)).select("doc_id", "copy", "position", "h", "size")
    return ranks(copies, F.col("doc_id").asc_nulls_last()).select("doc_id", "copy", "position", "rank")


def plan(df: DataFrame, id_col="doc_id", source_col="source", text_col="text") -> DataFrame:
    """One row per input row: ``doc_id, size, source_size, target, taken``, with
    ``copies``, and ``position`` and ``rank`` of the first copy (NULL if there is none).

    What is taken of a document are the copies that the schedules give a place in training;
    the rows come from the range sort of these. A NULL text has size 0; NULL is a source
    of its own, last in order. NULL and repeated ids are fine. Documents are ordered by a
    digest of the id, so reruns agree. An empty table gives no rows.
    """
    placed = stored(_demanded(df, id_col, source_col, text_col))
    facts = ("doc_id", "size", "source_size", "target", "copies")
    copies = each_copy(placed).select(*facts, "copy", "position", "h")
    first = ranks(copies, F.col("doc_id").asc_nulls_last()).filter("copy = 0").select(*facts, "position", "rank")
    none = placed.filter("copies = 0").select(*facts, F.lit(None).cast("double").alias("position"), F.lit(None).cast("long").alias("rank"))
    out = first.unionByName(none)
    return out.withColumn("taken", F.col("size") * F.col("copies")).select(
        "doc_id", "size", "source_size", "target", "taken", "copies", "position", "rank"
    )


def mix(df: DataFrame, id_col="doc_id", source_col="source", text_col="text") -> DataFrame:
    """The documents in training order, each as many times as the mix reads it, with the
    columns of ``df``. The partitions are ranges of training positions, sorted inside.

    Texts are shuffled twice: once by cell, once by position. NULL and empty texts are read
    once; NULL sources and ids, rows that repeat an id, and columns named like those used
    here are fine. An empty table gives no rows.
    """
    rows = sized(df, id_col, source_col, text_col)
    targets = source_targets(rows)
    offsets = cell_offsets(with_cells(rows, targets))
    # The documents travel as one struct, so their column names clash with nothing.
    facts = _facts(id_col, source_col, text_col)
    docs = df.select(F.struct(*(F.col(f"`{c}`") for c in df.columns)).alias("doc"), *(c.alias(n) for n, c in facts.items()))
    tie = [F.col("doc").getField(id_col).asc_nulls_last(), F.xxhash64(F.col("doc").getField(text_col))]
    copies = each_copy(demand(with_cells(docs, targets), offsets, *tie)).select("doc", "position", "h", "copy")
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ident = F.col("doc").getField(id_col).asc_nulls_last()
    ranged = copies.repartitionByRange(parts, *training_order(ident)).sortWithinPartitions(*training_order(ident))
    return ranged.select("doc.*")
