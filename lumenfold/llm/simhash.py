"""SimHash near-dedup with bit-sliced comparison.

Fingerprints have 64 bits. Two within three bits agree in at least two of five bit
fields (13, 13, 13, 13 and 12 bits), so every near pair meets in one of ten tables keyed
by two fields. Inside a bucket the fingerprints stand vertically: plane b holds bit b of
all of them. Differences are counted with carry-save adders over the planes, one bit of a
counter for each lane, and a block is left as soon as all its lanes exceed the radius.
A bucket hands on a spanning forest of its links, not its pairs; the forests of all
buckets are joined to components by alternating large-star and small-star rounds.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenfold.llm.common import fresh, hot_join, stored, text_of

SHINGLE = 3
SEED = 42
RADIUS = 3
#: Bit fields as (shift, width).
FIELDS = [(0, 13), (13, 13), (26, 13), (39, 13), (52, 12)]
TABLES = [(a, b) for a in range(5) for b in range(a + 1, 5)]
#: Fingerprints in one tile at most, twice as many when two parts of a bucket meet.
TILE = 8192
#: Planes between two looks whether a block can be abandoned.
LOOK = 8


# ---- fingerprints -----------------------------------------------------------


def shingle_hashes(text: str, width: int = SHINGLE) -> np.ndarray:
    """XXH64 of every shingle of a text, letters A-Z lower-cased."""
    words = text.encode("utf-8").lower().split()
    if not words:
        return np.empty(0, dtype=np.uint64)
    joined = b" ".join(words)
    if len(words) <= width:
        return np.array([xxhash.xxh64_intdigest(joined, SEED)], dtype=np.uint64)
    ends = np.cumsum(np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1)
    starts = np.concatenate(([0], ends[:-1]))[: len(words) - width + 1].tolist()
    stops = (ends[width - 1 :] - 1).tolist()
    digest = xxhash.xxh64_intdigest
    n = len(starts)
    return np.fromiter((digest(joined[a:b], SEED) for a, b in zip(starts, stops, strict=True)), np.uint64, n)


def fingerprint(hashes: np.ndarray) -> int:
    """Bit b is set if it is set in over half the hashes."""
    ones = np.zeros(64, dtype=np.int64)
    for i in range(0, len(hashes), 1 << 15):
        part = hashes[i : i + (1 << 15)].astype("<u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = (2 * ones > len(hashes)).astype(np.uint8)
    return int(np.packbits(bits, bitorder="little").view("<u8")[0])


def _fingerprints(batches):
    for batch in batches:
        texts = batch.column(batch.num_columns - 1)
        prints = np.fromiter(
            (fingerprint(shingle_hashes(t.as_py() or "")) for t in texts), dtype=np.uint64, count=len(texts)
        )
        rest = [batch.column(i) for i in range(batch.num_columns - 1)]
        names = batch.schema.names[:-1]
        yield pa.RecordBatch.from_arrays([*rest, pa.array(prints.view(np.int64))], names=[*names, "fp"])


def fingerprints(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", row: str | None = None
) -> DataFrame:
    """(doc_id, fp), and ``row`` if such a column is named: one row per input row, ``fp``
    as a signed long.

    A text without words, an empty one and NULL have fingerprint zero.
    """
    keys = df.select(F.col(f"`{id_col}`").alias("doc_id"), *([F.col(row).alias("row")] if row else []), text_of(text_col).alias("text"))
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in keys.schema.fields[:-1])
    return keys.mapInArrow(_fingerprints, f"{kinds}, fp long")


# ---- bit-sliced comparison --------------------------------------------------


def planes(prints: np.ndarray) -> np.ndarray:
    """64 rows of packed bits: plane b holds bit b of every fingerprint."""
    bits = np.unpackbits(np.ascontiguousarray(prints, dtype="<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    return np.packbits(bits.T, axis=1, bitorder="little")


def near(diff, shape: tuple[int, ...]) -> np.ndarray:
    """Packed lanes whose distance is within the radius.

    ``diff(b)`` gives the lanes that differ in plane b. Two counter bits count modulo
    four by carry-save addition, and the carry out of the second marks a lane that has
    exceeded the radius for good.
    """
    ones, twos, over = (np.zeros(shape, dtype=np.uint8) for _ in range(3))
    for b in range(64):
        d = diff(b)
        carry = ones & d
        ones ^= d
        over |= twos & carry
        twos ^= carry
        if b % LOOK == LOOK - 1 and (over == 0xFF).all():
            break
    return ~over


def _find(parent: list[int], x: int) -> int:
    while parent[x] != x:
        parent[x] = parent[parent[x]]
        x = parent[x]
    return x


def forest(prints: np.ndarray, side: np.ndarray, same: bool) -> list[tuple[int, int]]:
    """Links (member, root) that connect what is within the radius in one tile.

    With ``same``, all fingerprints meet all; otherwise those of side 0 meet those of
    side 1, as two parts of one large bucket.
    """
    n = len(prints)
    parent = list(range(n))
    rows = np.arange(n) if same else np.flatnonzero(side == 0)
    lanes = np.arange(n) if same else np.flatnonzero(side == 1)
    if not len(rows) or not len(lanes):
        return []
    step = 1024
    for lo in range(0, len(lanes), step):
        block = lanes[lo : lo + step]
        table = planes(prints[block])
        for q in range(0, len(rows), 256):
            ask = rows[q : q + 256]
            if same and ask[0] > block[-1]:
                continue
            bits = np.unpackbits(prints[ask].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            mask = (0 - bits).astype(np.uint8)  # 0x00 or 0xFF
            hit = near(lambda b, t=table, m=mask: t[b][None, :] ^ m[:, b : b + 1], (len(ask), table.shape[1]))
            found = np.unpackbits(hit, axis=1, count=len(block), bitorder="little")
            for i, j in zip(*np.nonzero(found), strict=True):
                a, b = _find(parent, int(ask[i])), _find(parent, int(block[j]))
                if a != b:
                    parent[max(a, b)] = min(a, b)
    return [(i, r) for i in range(n) if (r := _find(parent, i)) != i]


def _small_runs(prints: np.ndarray, run: np.ndarray, longest: int) -> list[tuple[int, int]]:
    """Links of many short buckets at once: lanes are the rows, compared with the rows
    1, 2, ... places further on, where these are in the same bucket."""
    out = []
    for d in range(1, longest):
        at = np.flatnonzero(run[d:] == run[:-d])
        if not len(at):
            break
        diff = planes(prints[at] ^ prints[at + d])
        hit = np.unpackbits(near(lambda b, x=diff: x[b], diff.shape[1:]), count=len(at), bitorder="little")
        out += [(int(i), int(i) + d) for i in at[hit == 1]]
    return out


def _links(batches):
    """Links from rows sorted by tile; a tile may go on in the next batch."""
    key = ["t", "k", "ti", "tj"]
    rest = None
    for batch in (*batches, None):
        table = None if batch is None else pa.Table.from_batches([batch])
        if rest is not None:
            table = rest if table is None else pa.concat_tables([rest, table])
        if table is None or not table.num_rows:
            continue
        keys = np.stack([table.column(c).to_numpy() for c in key], axis=1)
        new = np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1
        stop = table.num_rows if batch is None else (int(new[-1]) if len(new) else 0)
        rest = table.slice(stop)
        if not stop:
            continue
        prints = table.column("fp").to_numpy()[:stop].view(np.uint64)
        side = table.column("side").to_numpy()[:stop]
        edge = np.concatenate(([0], new[new < stop], [stop]))
        sizes, pairs = np.diff(edge), []
        run = np.repeat(np.arange(len(sizes)), sizes)
        for g in np.flatnonzero((sizes > 16) | (keys[edge[:-1], 2] != keys[edge[:-1], 3])):
            lo, hi = edge[g], edge[g + 1]
            same = keys[lo, 2] == keys[lo, 3]
            pairs += [(lo + a, lo + b) for a, b in forest(prints[lo:hi], side[lo:hi], same)]
            run[lo:hi] = -1 - np.arange(lo, hi)
        pairs += _small_runs(prints, run, 16)
        if pairs:
            at = np.array(pairs, dtype=np.int64)
            p = prints.view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(p[at[:, 0]]), pa.array(p[at[:, 1]])], names=["a", "b"])


def links(prints: DataFrame, tile: int = TILE) -> DataFrame:
    """Distinct (a, b): links between different fingerprints, in forests per bucket.

    ``prints`` holds distinct fingerprints in column ``fp``. A bucket beyond ``tile``
    rows is cut into parts by a hash; every part meets itself and every other part in a
    task of its own, so no task holds more than two parts and no pair is missed.
    """
    field = [F.shiftrightunsigned("fp", s).bitwiseAND((1 << w) - 1) for s, w in FIELDS]
    tables = F.array(
        *(
            F.struct(F.lit(t).alias("t"), (field[a] * 8192 + field[b]).cast("int").alias("k"))
            for t, (a, b) in enumerate(TABLES)
        )
    )
    keyed = prints.select("fp", F.explode(tables).alias("x")).select("fp", "x.t", "x.k")
    buckets = stored(keyed.groupBy("t", "k").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").withColumn("m", F.col("n")))
    met = hot_join(keyed, buckets, ["t", "k"], "n", "inner")
    parts = F.ceil(F.col("m") / F.lit(tile)).cast("int")
    part = F.pmod(F.hash("fp"), F.col("parts"))
    tiles = (
        met.withColumn("parts", parts)
        .withColumn("part", part)
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        .select(
            "t",
            "k",
            F.least("part", "other").alias("ti"),
            F.greatest("part", "other").alias("tj"),
            (F.col("part") > F.col("other")).cast("int").alias("side"),
            "fp",
        )
    )
    n = int(prints.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = tiles.repartition(n, "t", "k", "ti", "tj").sortWithinPartitions("t", "k", "ti", "tj", "fp")
    found = dealt.mapInArrow(_links, "a long, b long")
    return found.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


# ---- components -------------------------------------------------------------


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of the edges (a, b), ``root`` the smallest in reach.

    Alternates large-star and small-star rounds until the edges stay the same. Each
    round is written to the shared folder. A node with very many neighbours never
    gathers in one task: minima are pre-aggregated and matched with ``hot_join``.
    """
    now = stored(edges.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    before = None
    while True:
        mark = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b") % 1_000_003), F.sum(F.xxhash64("b", "a") % 999_983)).first()
        if mark == before or not mark[0]:
            break
        before = mark
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = stored(both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"), F.count(F.lit(1)).alias("n")))
        # Large star: each larger neighbour of a links to the smallest around a.
        large = hot_join(both, least, ["a"], "n").filter("b > a").select(F.col("m").alias("a"), "b").filter("a <> b")
        large = stored(large.distinct())
        # Small star: each smaller neighbour of b, and b, link to the smallest around b.
        least = stored(large.groupBy("b").agg(F.min("a").alias("m"), F.count(F.lit(1)).alias("n")))
        small = hot_join(large, least, ["b"], "n").filter("a <> m").select(F.col("m").alias("a"), F.col("a").alias("b"))
        now = stored(small.unionByName(least.select(F.col("m").alias("a"), "b")).distinct())
    return now.select(F.col("b").alias("node"), F.col("a").alias("root")).unionByName(
        now.select(F.col("a").alias("node"), F.col("a").alias("root")).distinct()
    )


def near_groups(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", row: str | None = None
) -> DataFrame:
    """(doc_id, fp, component_id, root, and row if named): one row per input row.

    ``component_id`` is the smallest id reachable over links, NULL if no document in
    reach has an id. Equal fingerprints are linked. Repeated rows and ids are kept as
    they are. An empty table gives no rows.
    """
    docs = stored(fingerprints(df, id_col, text_col, row))
    prints = stored(docs.groupBy("fp").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("n")))
    roots = components(links(prints.select("fp")))
    reach = stored(
        prints.join(roots, prints.fp == roots.node, "left").select("fp", "first", "n", F.coalesce("root", "fp").alias("root"))
    )
    least = stored(reach.groupBy("root").agg(F.min("first").alias("component_id"), F.count(F.lit(1)).alias("of")))
    named = stored(hot_join(reach.select("fp", "n", "root"), least, ["root"], "of").select("fp", "n", "component_id", "root"))
    return hot_join(docs, named, ["fp"], "n")


def near_dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``df`` that stay, with all their columns: of each component the
    document with the smallest id. Where nothing in reach has an id, and where an id is
    repeated, one row stays all the same."""
    (row,) = fresh(df, "_row")
    numbered = stored(df.withColumn(row, F.monotonically_increasing_id()), "zstd")
    groups = near_groups(numbered, id_col, text_col, row)
    order = F.struct(F.col("doc_id").isNull().alias("no_id"), F.col("doc_id").alias("id"), F.col("row").alias("row"))
    stay = groups.groupBy("root").agg(F.min(order).alias("best")).select(F.col("best.row").alias(row))
    return numbered.join(stay, row, "left_semi").drop(row)
