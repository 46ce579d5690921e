"""Small tables inside large jobs, each behind a check of its size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql import types as T

BROADCAST_ROWS = 200_000


def row_count(df: DataFrame) -> Column:
    """Row count of a table as a scalar subquery."""
    return df.agg(F.count(F.lit(1)).alias("n")).scalar()


class TooManyRows(ValueError):
    """A table that should be a literal has more rows than its bound."""


def small_literal(df: DataFrame, max_rows: int, what: str) -> Column:
    """A small table as one literal array of structs, sorted.

    For request parameters such as facet vectors. At most ``max_rows + 1`` rows
    leave the cluster, and more than ``max_rows`` is an error, never a cut result.
    Spark folds the JSON text into one constant, which every row reads in place.
    """
    packed = (
        df.limit(max_rows + 1)
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.to_json(F.sort_array(F.collect_list(F.struct(*df.columns)))).alias("rows"),
        )
        .first()
    )
    if packed["n"] > max_rows:
        raise TooManyRows(f"{what}: more than {max_rows} rows")
    return F.from_json(F.lit(packed["rows"]), T.ArrayType(df.schema))


def small_rows(df: DataFrame, max_rows: int, what: str) -> list[Row]:
    """The rows of a table of request parameters; more than ``max_rows`` is an error."""
    rows = df.limit(max_rows + 1).collect()
    if len(rows) > max_rows:
        raise TooManyRows(f"{what}: more than {max_rows} rows")
    return rows


def is_small(df: DataFrame, max_rows: int = BROADCAST_ROWS) -> bool:
    """Count up to one row past the bound; never a full count of a large table."""
    return df.limit(max_rows + 1).count() <= max_rows


def lookup_join(
    df: DataFrame,
    lookup: DataFrame,
    on: str,
    how: str = "left",
    max_rows: int = BROADCAST_ROWS,
) -> DataFrame:
    """Join to a lookup table that has one or few rows per key.

    A lookup within the bound is broadcast. A larger one is shuffled, with the key
    salted on both sides by the number of tasks, so one key that holds a third of
    ``df`` is spread over all of them. NULL matches nothing and goes round the join.
    """
    if is_small(lookup, max_rows):
        return df.join(F.broadcast(lookup), on, how)
    salts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    salted = df.withColumn("_salt", F.pmod(F.xxhash64(*df.columns), F.lit(salts)))
    copies = lookup.withColumn(
        "_salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(salts - 1).cast("long")))
    )
    met = salted.filter(F.col(on).isNotNull()).join(copies, [on, "_salt"], how).drop("_salt")
    if how == "inner":
        return met
    return met.unionByName(df.filter(F.col(on).isNull()), allowMissingColumns=True)


HOT_SHARE = 1 / 500  # of all rows; a key with more, or with more than a task's share, is hot


def hot_lookup(df: DataFrame, lookup: DataFrame, on: str, n: str, how: str = "left") -> DataFrame:
    """Join to ``lookup``, which has one row per key and in ``n`` the key's rows in ``df``.

    Hot keys are broadcast, at most 500 or as many as there are tasks; all other keys meet in a shuffle, where none is large. ``lookup`` should be
    materialised, as it is read twice. ``n`` does not come out.
    """
    total = lookup.agg(F.coalesce(F.sum(n), F.lit(0))).first()[0]
    tasks = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    bar = max(1000, int(total * min(HOT_SHARE, 1 / tasks)))
    if total <= bar:
        return df.join(lookup.drop(n), on, how)
    hot = lookup.filter(F.col(n) > bar).drop(n)
    keys = F.broadcast(hot.select(on))
    rest = df.join(keys, on, "left_anti").join(lookup.filter(F.col(n) <= bar).drop(n), on, how)
    return rest.unionByName(df.join(F.broadcast(hot), on))
