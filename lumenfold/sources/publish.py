"""Several tables that become visible at once.

Tables are written aside, below a new version; a manifest that names them is written last,
as one file in one commit. Readers follow the newest manifest, so they see all tables of a
version or none. What a failed job left behind is named by no manifest: readers never
see it, and ``sweep`` removes it.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenfold.sources.sinks import write_table

MANIFEST = "version long, name string, path string, fmt string"


def manifests(spark: SparkSession, folder: str) -> DataFrame:
    """(version, name, path, fmt) of all published tables; no rows before the first."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{folder}/manifests")
    if not path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path):
        return spark.createDataFrame([], MANIFEST)
    return spark.read.schema(MANIFEST).option("recursiveFileLookup", True).json(f"{folder}/manifests")


def publish(folder: str, tables: dict[str, DataFrame], fmt: str = "parquet") -> int:
    """Write the tables and make them visible together; the number of the new version.

    Names are unique within a version. A version that another job publishes meanwhile is an
    error, as its manifest is there already. An empty set of tables is one too."""
    if not tables:
        raise ValueError("there is nothing to publish")
    spark = next(iter(tables.values())).sparkSession
    last = manifests(spark, folder).agg(F.max("version")).first()[0]
    version = 0 if last is None else last + 1
    rows, aside = [], f"{folder}/tables/{version}-{uuid.uuid4().hex}"
    for name, df in tables.items():
        path = f"{aside}/{name}"
        write_table(df, path, fmt)
        rows.append((version, name, path, fmt))
    # One file: it is either there or not.
    spark.createDataFrame(rows, MANIFEST).coalesce(1).write.mode("error").json(f"{folder}/manifests/{version}")
    return version


def read_published(spark: SparkSession, folder: str, name: str, version: int | None = None) -> DataFrame:
    """A table of the newest version, or of the one given."""
    found = manifests(spark, folder)
    if version is None:
        version = found.agg(F.max("version")).first()[0]
    row = found.filter((F.col("version") == version) & (F.col("name") == name)).first() if version is not None else None
    if row is None:
        raise ValueError(f"{name} is not published in {folder}")
    reader = spark.read.option("header", True) if row.fmt == "csv" else spark.read
    return reader.format(row.fmt).load(row.path)


def sweep(spark: SparkSession, folder: str) -> int:
    """Remove the folders that no manifest names, and count them. To be run while nothing is published."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    tables = jvm.org.apache.hadoop.fs.Path(f"{folder}/tables")
    files = tables.getFileSystem(conf)
    if not files.exists(tables):
        return 0
    # One folder for each version ever published.
    named = {r.path.rsplit("/", 2)[1] for r in manifests(spark, folder).select("path").collect()}
    removed = 0
    for status in files.listStatus(tables):
        if status.getPath().getName() not in named:
            files.delete(status.getPath(), True)
            removed += 1
    return removed
