"""Writers for result tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def json_records(df: DataFrame) -> DataFrame:
    """One JSON object per row; a NULL stays visible as ``null``."""
    return df.select(
        F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("record")
    )


def write_table(df: DataFrame, path: str, fmt: str = "parquet", mode: str = "error") -> None:
    """Write a table, a report or evidence lists as parquet, json or csv.

    An existing table is an error unless ``mode`` says otherwise. In csv, lists and
    structs are JSON text.
    """
    writer = df.write
    if fmt == "csv":
        nested = (T.ArrayType, T.StructType, T.MapType)
        df = df.select(
            *[
                F.to_json(f"`{f.name}`").alias(f.name) if isinstance(f.dataType, nested) else F.col(f"`{f.name}`")
                for f in df.schema
            ]
        )
        writer = df.write.option("header", True)
    writer.mode(mode).format(fmt).save(path)
