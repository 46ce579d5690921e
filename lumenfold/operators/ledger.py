"""Completions that are paid for once: a ledger keyed by what is asked.

A prompt's key is the digest of its text and its numbers. Prompts whose key is in the ledger
are answered from it; the others are asked for, each key once, and every answer is put
into a journal, one file per key, before the next one is asked for. A task that runs
again, or a job after a failed one, finds the answers of its first attempt there. When
all are answered, they are appended to the ledger's table in one write.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lumenfold.session import materialise

LEDGER = T.StructType([T.StructField("key", T.StringType()), T.StructField("completion", T.StringType())])
NOT_ASKED = ("subject", "stage", "facet")  # columns that name a prompt but are not sent


class Journal:
    """One file per key below a folder that all executors reach (any ``pyarrow`` file system)."""

    def __init__(self, folder: str):
        from pyarrow import fs

        self.fs, self.path = fs.FileSystem.from_uri(folder) if "://" in folder or folder.startswith("file:") else (fs.LocalFileSystem(), folder)
        self.fs.create_dir(self.path, recursive=True)

    def get(self, key: str) -> tuple[bool, str | None]:
        try:
            with self.fs.open_input_stream(f"{self.path}/{key}") as f:
                return True, json.loads(f.read().decode("utf-8"))
        except FileNotFoundError:
            return False, None

    def put(self, key: str, text: str | None) -> None:
        """Written aside and renamed, so that no reader sees a part of an answer."""
        aside = f"{self.path}/.{key}-{uuid.uuid4().hex}"
        with self.fs.open_output_stream(aside) as f:
            f.write(json.dumps(text).encode("utf-8"))
        self.fs.move(aside, f"{self.path}/{key}")


def prompt_key(prompts: DataFrame) -> Column:
    """Digest of all that is sent: every column but those that only name the prompt."""
    sent = sorted(c for c in prompts.columns if c not in NOT_ASKED)
    return F.sha2(F.to_json(F.struct(*sent), {"ignoreNullFields": "false"}), 256)


def answers(batches: Iterator[pd.DataFrame], fn: Callable, journal: Callable[[], Journal]) -> Iterator[pd.DataFrame]:
    """(key, completion) of prompt rows; ``fn`` is asked only for what the journal lacks."""
    book = journal()
    for batch in batches:
        out = []
        for i in range(len(batch)):
            one = batch.iloc[i : i + 1]
            key = one["key"].iloc[0]
            known, text = book.get(key)
            if not known:
                text = list(fn(one.drop(columns="key")))[0]
                book.put(key, text)
            out.append((key, text))
        yield pd.DataFrame(out, columns=["key", "completion"])


def read_ledger(df: DataFrame, folder: str) -> DataFrame:
    """The ledger's table, without rows where there is none yet."""
    spark = df.sparkSession
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{folder}/table")
    if not path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path):
        return spark.createDataFrame([], LEDGER)
    return spark.read.schema(LEDGER).parquet(f"{folder}/table")


def complete_once(prompts: DataFrame, fn: Callable, folder: str) -> DataFrame:
    """Add ``completion`` to prompt rows, as ``complete`` does, and ask for each prompt once ever.

    Equal prompts share an answer. ``fn`` gets frames of one row. ``folder`` is shared storage;
    the one gap is a process that dies between the answer and its journal file. Should
    two jobs ask for a prompt at the same time, both pay, and the smaller answer counts.
    """
    keyed = materialise(prompts.withColumn("key", prompt_key(prompts)))
    known = read_ledger(prompts, folder).select("key").distinct()
    first = [F.min(f"`{c}`").alias(c) for c in prompts.columns]
    missing = keyed.join(known, "key", "left_anti").groupBy("key").agg(*first).select("key", *prompts.columns)
    where = f"{folder}/journal"

    def run(batches):
        yield from answers(batches, fn, lambda: Journal(where))

    missing.mapInPandas(run, LEDGER).write.mode("append").parquet(f"{folder}/table")
    told = read_ledger(prompts, folder).groupBy("key").agg(F.min("completion").alias("completion"))
    return keyed.join(told, "key").select(*prompts.columns, "completion")
