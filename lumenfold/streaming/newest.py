"""Feeds with state: items pulled twice count once, and the newest n of each community.

A feed is read again and again until a limit, so the same item lands in several files and
older items land late. Repeated items are dropped within the watermark; what is left
updates, per community, a list of the n newest items. A community is dealt to several
state keys, each with its own list, so a busy one is not one task; the lists of a
community meet only when the table is read.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from lumenfold.operators.ranking import topk

SALTS = 16  # state keys of a community
DELAY = "30 days"  # how long after the newest item another one may land


def first_seen(feed: DataFrame, ident: str, time: str, delay: str = DELAY) -> DataFrame:
    """Every item once, though it may land several times within ``delay``.

    Items without an id or a time are left out: they cannot be told apart or placed."""
    usable = feed.filter(F.col(ident).isNotNull() & F.col(time).isNotNull())
    return usable.withWatermark(time, delay).dropDuplicatesWithinWatermark([ident])


class Newest(StatefulProcessor):
    """The n newest items of a key, in a state of n rows. Equal times go to the smaller id."""

    def __init__(self, n: int, columns: list[str], schema: str, time: str, ident: str):
        self.n, self.columns, self.schema, self.time, self.ident = n, columns, schema, time, ident

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.items = handle.getListState("items", self.schema)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        held = [tuple(r) for r in self.items.get()]
        best = pd.DataFrame(held, columns=self.columns)
        for batch in rows:  # one batch at a time is in memory
            both = pd.concat([best, batch[self.columns]]) if len(best) else batch[self.columns]
            best = both.sort_values([self.time, self.ident], ascending=[False, True], kind="stable").head(self.n)
        self.items.put([tuple(r) for r in best.itertuples(index=False, name=None)])
        yield best

    def close(self) -> None:
        pass


def newest(feed: DataFrame, community: str, ident: str, time: str, n: int, salts: int = SALTS) -> DataFrame:
    """The stream of lists: whenever a list changes, all of it comes out with its ``salt``.

    ``feed`` has each item once. The session needs the RocksDB state store
    (:func:`with_state_store`)."""
    salted = feed.filter(F.col(community).isNotNull()).withColumn("salt", F.pmod(F.xxhash64(ident), F.lit(salts)).cast("int"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in salted.schema.fields)
    processor = Newest(n, salted.columns, schema, time, ident)
    return salted.groupBy(community, "salt").transformWithStateInPandas(processor, schema, "Update", "None")


def with_state_store(spark: SparkSession) -> SparkSession:
    """The session with the state store that :func:`newest` needs."""
    provider = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", provider)
    return spark


def keep_newest(lists: DataFrame, path: str, state: str) -> StreamingQuery:
    """Write the lists that change, one folder per micro-batch, until all that landed is read.

    A micro-batch that runs again after a failure replaces its folder. ``state`` is the
    query's checkpoint folder on shared storage."""

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return (
        lists.writeStream.outputMode("update")
        .foreachBatch(write)
        .option("checkpointLocation", state)
        .trigger(availableNow=True)
        .start()
    )


def read_newest(spark: SparkSession, path: str, schema, community: str, ident: str, time: str, n: int) -> DataFrame:
    """The n newest items of every community: of each list what came out last, merged."""
    written = spark.read.schema(schema).parquet(path)
    last = written.groupBy(community, "salt").agg(F.max("batch").alias("batch"))
    lists = written.join(last, [community, "salt", "batch"], "left_semi").drop("batch", "salt")
    return topk(lists, n, [F.desc(time), F.col(ident)], [community], salted=False)
