"""Sharding by a permutation-filled lookup table.

Every shard has an order of preference over the slots of a table of prime size. The shards
take turns, each claiming the next slot in its order that is still free, until the table is
full. A key's slot is a digest of it modulo the size, and the slot names the shard. The
table depends on the names of the shards alone; when a shard goes or comes, nearly all
other keys stay where they are.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenfold.llm.common import fresh

SHARDS = tuple(f"shard-{i:02d}" for i in range(16))
#: Prime, and over a hundred times the shards, so that shares differ by about a percent.
SLOTS = 1621


def _digits(text: str) -> int:
    return int(hashlib.md5(text.encode("utf-8")).hexdigest()[:15], 16)


def is_prime(n: int) -> bool:
    return n > 1 and all(n % d for d in range(2, int(n**0.5) + 1))


def lookup_table(shards=SHARDS, slots: int = SLOTS, weights: dict[str, int] | None = None) -> list[str]:
    """The shard of every slot. A shard of weight w claims w slots in its turn.

    Shards take turns in the order of their names. Offset and skip of a shard's order
    come from digests of its name; a prime size makes every skip reach all slots.
    """
    names = sorted(set(shards))
    if not names or not is_prime(slots) or slots < len(names):
        raise ValueError("needs shards, and a prime number of slots that is not below theirs")
    at = {s: _digits(s + " offset") % slots for s in names}
    skip = {s: _digits(s + " skip") % (slots - 1) + 1 if slots > 2 else 1 for s in names}
    turns = [s for s in names for _ in range((weights or {}).get(s, 1))]
    out: list[str | None] = [None] * slots
    free = slots
    while free:
        for s in turns:
            if not free:
                break
            while out[at[s]] is not None:
                at[s] = (at[s] + skip[s]) % slots
            out[at[s]] = s
            free -= 1
    return out  # type: ignore[return-value]


def slot_of(key: Column, slots: int = SLOTS) -> Column:
    """Slot of a key: the first 15 hex digits of its md5, modulo the size."""
    return (F.conv(F.substring(F.md5(key.cast("string")), 1, 15), 16, 10).cast("long") % slots).cast("int")


def place(df: DataFrame, key: str = "doc_id", spare: str = "text", shards=SHARDS, slots: int = SLOTS) -> DataFrame:
    """``df`` with the columns ``slot`` and ``shard``, one row per input row.

    A row without a key goes by its column ``spare``, so that rows without keys do not
    meet in one shard; without both it counts as the empty key. Equal keys share a
    shard. The table is broadcast: one row per slot, a bound that no data changes.
    """
    slot, shard = fresh(df, "slot", "shard")
    spark = df.sparkSession
    rows = list(enumerate(lookup_table(shards, slots)))
    table = spark.createDataFrame(rows, f"`{slot}` int, `{shard}` string")
    by = F.coalesce(F.col(f"`{key}`").cast("string"), F.col(f"`{spare}`").cast("string"), F.lit(""))
    return df.withColumn(slot, slot_of(by, slots)).join(F.broadcast(table), slot).select(*df.columns, slot, shard)


def write(df: DataFrame, path: str, shard: str = "shard", tasks: int = 4) -> None:
    """Write a placed table as one folder per shard. Every shard is split over ``tasks``
    tasks by a hash of the whole row, so a large shard is never one task."""
    salt = F.pmod(F.xxhash64(*df.columns), F.lit(tasks))
    (spread,) = fresh(df, "_spread")
    df.withColumn(spread, salt).repartition(F.col(shard), F.col(spread)).drop(spread).write.partitionBy(shard).parquet(path)
