"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: A word is a run of characters that are neither a blank nor one of \t \n \v \f \r.
WORD = r"[^\x20\x09-\x0D]+"

#: A key with more than this share of the rows is hot, or with more than a task's share where
#: there are more tasks. At most 1 / HOT_SHARE keys, or as many as there are tasks, can be
#: hot, which is the bound on what ``hot_join`` broadcasts.
HOT_SHARE = 1 / 500
#: Bits of Spark's row numbers that count inside a partition.
INSIDE = 33


def shared_folder(spark: SparkSession) -> str:
    """A new path below the folder that ``spark.checkpoint.dir`` names.

    Only a local master without that setting gets a temporary folder of its own.
    """
    sc = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not folder:
        if not sc.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="lumenfold-")
        sc.setCheckpointDir(folder)
    return f"{folder.rstrip('/')}/llm-{uuid.uuid4().hex}"


def stored(df: DataFrame, compression: str = "snappy") -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back.

    This cuts the lineage: later jobs read files that survive a lost executor, and
    values that depend on the order of rows are fixed once.
    """
    spark, path = df.sparkSession, shared_folder(df.sparkSession)
    df.write.parquet(path, compression=compression)
    return spark.read.schema(df.schema).parquet(path)


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Column names that ``df`` does not have, one for each wanted name."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def text_of(name: str) -> Column:
    """A text column by its exact name; NULL counts as empty."""
    return F.coalesce(F.col(f"`{name}`").cast("string"), F.lit(""))


def hot_join(left: DataFrame, right: DataFrame, on: list[str], n: str, how: str = "left") -> DataFrame:
    """Join ``left`` to ``right``, which has one row per key and in column ``n`` the
    number of left rows with that key.

    Hot keys, those with more than ``HOT_SHARE`` or a task's share of the rows, are at most
    500 rows of ``right``, or as many as there are tasks: they are broadcast, so a hot key is never shuffled into one task.
    The other keys are joined by a shuffle, where each has a small share. Keys match
    as by ``<=>``, so NULL is a key like any other. ``right`` is read twice and should
    be a stored table. The result has the columns of ``left`` and ``right`` but ``n``.
    """
    total = right.agg(F.coalesce(F.sum(n), F.lit(0))).first()[0]
    tasks = int(left.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    bar = max(1000, int(total * min(HOT_SHARE, 1 / tasks)))
    marked = [f"__{i}" for i in range(len(on))]
    keyed = right.withColumnsRenamed(dict(zip(on, marked, strict=True)))
    same = [F.col(k).eqNullSafe(F.col(m)) for k, m in zip(on, marked, strict=True)]
    hot = keyed.filter(F.col(n) > bar).withColumn("__hot", F.lit(True))
    cold = keyed.filter(F.col(n) <= bar).drop(n)
    if total <= bar:
        return left.join(cold, same, how).drop(*marked)
    # One pass: the broadcast side marks hot rows; these bypass the shuffled join.
    first = left.join(F.broadcast(hot.select(*marked, "__hot")), same, "left").drop(*marked)
    is_hot = F.col("__hot").isNotNull()
    rest = first.filter(~is_hot).drop("__hot").join(cold, same, how).drop(*marked)
    met = first.filter(is_hot).drop("__hot").join(F.broadcast(hot.drop(n, "__hot")), same).drop(*marked)
    return rest.unionByName(met)


def ranked(rows: DataFrame, group: list[str], order: list[str]) -> DataFrame:
    """Stored rows with ``pos``, their place in their group from 0, and ``n``, its size.

    Rows are sorted by range over all tasks, so that a group of any size is spread; one
    count per partition and group gives the offsets. A group has at most one such count
    in each partition.
    """
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    by = [F.col(c) for c in (*group, *order)]
    dealt = rows.repartitionByRange(parts, *by).sortWithinPartitions(*by) if by else rows
    dealt = stored(dealt.withColumn("_row", F.monotonically_increasing_id()))
    part = F.shiftright("_row", INSIDE)
    counts = dealt.groupBy(part.alias("_part"), *(F.col(g).alias(f"_{g}") for g in group)).agg(
        F.min("_row").alias("_low"), F.count(F.lit(1)).alias("_k")
    )
    whole = Window.partitionBy(*(f"_{g}" for g in group))
    before = F.sum("_k").over(whole.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    counts = stored(counts.select("*", F.coalesce(before, F.lit(0)).alias("_before"), F.sum("_k").over(whole).alias("n")))
    same = part == F.col("_part")
    for g in group:
        same &= F.col(g).eqNullSafe(F.col(f"_{g}"))
    met = dealt.join(counts, same).withColumn("pos", F.col("_row") - F.col("_low") + F.col("_before"))
    return stored(met.select(*rows.columns, "pos", "n"))


def blocks(batches, starts: Callable[[pa.RecordBatch], np.ndarray]) -> Iterator[pa.Table]:
    """Whole blocks of sorted rows; a block may run on over several batches."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        edges = [0, *np.flatnonzero(starts(batch)).tolist(), batch.num_rows]
        for k, (lo, hi) in enumerate(pairwise(edges)):
            if k and held:
                yield pa.Table.from_batches(held)
                held = []
            if hi > lo:
                held.append(batch.slice(lo, hi - lo))
    if held:
        yield pa.Table.from_batches(held)
