"""Exact dedup by deterministic block naming.

A normalised text is cut into blocks of a fixed number of bytes. The distinct blocks
are sorted and numbered: the number is the block's name. Then the names of adjacent
blocks form pairs, the distinct pairs are sorted and numbered in turn, and so on until
one name is left of each document. Two documents end with the same name after the same
number of rounds exactly when their texts are equal: every name stands for one block or
one pair, so there are no collisions to accept.

All of it is DataFrame expressions. The text of the blocks is shuffled once, to find the
distinct blocks. Rows are matched to the names of level 0 by a hash of their block; where
different blocks share a hash, by the block itself. From level 1 on only integers move.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenfold.llm.common import fresh, hot_join, stored, text_of

#: Bytes in a block. Larger blocks make fewer rows, smaller ones share more names.
BLOCK = 1024
BLANKS = " \t\n\x0b\f\r"


def normalised(text: Column) -> Column:
    """Without blanks and the control characters from \\t to \\r."""
    for c in BLANKS:
        text = F.replace(text, F.lit(c), F.lit(""))
    return text


def identities(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", hasher=F.xxhash64, row: str | None = None
) -> DataFrame:
    """One row per input row: its number ``row``, its id, ``n_chars`` of the original text, ``text_sha256``
    of the normalised one, and the identity (``level``, ``name``).

    A NULL text is empty. NULL and repeated ids are fine, because rows carry a number
    of their own. Other columns are not read. ``row`` names a column that numbers the rows, if
    there is one. ``hasher`` turns a binary block into a long; a poor one costs time but never changes the result.
    """
    body = normalised(text_of(text_col))
    rows = df.select(
        (F.col(row) if row else F.monotonically_increasing_id()).alias("row"),
        F.col(f"`{id_col}`").alias("doc_id"),
        F.length(text_of(text_col)).cast("long").alias("n_chars"),
        F.sha2(body, 256).alias("text_sha256"),
        F.encode(body, "utf-8").alias("body"),
    )
    last = F.greatest(F.lit(0), F.expr(f"(octet_length(body) - 1) div {BLOCK}").cast("int"))
    blocks = rows.select(
        "row",
        "doc_id",
        "n_chars",
        "text_sha256",
        "body",
        (last + 1).alias("of"),
        F.explode(F.sequence(F.lit(0), last)).alias("pos"),
    )
    blocks = blocks.withColumn("block", F.substring("body", F.col("pos") * BLOCK + 1, F.lit(BLOCK)))
    blocks = blocks.withColumn("h", hasher("block"))
    first = F.col("pos") == 0
    table = stored(
        blocks.select(
            "row",
            "pos",
            "of",
            "h",
            F.when(first, F.col("doc_id")).alias("doc_id"),
            F.when(first, F.col("n_chars")).alias("n_chars"),
            F.when(first, F.col("text_sha256")).alias("text_sha256"),
        )
    )
    facts = table.filter("pos = 0").select("row", "doc_id", "n_chars", "text_sha256")
    done, named, level = [], _name_blocks(table.select("row", "pos", "of", "h"), blocks), 0
    while True:
        done.append(named.filter("of = 1").select("row", F.lit(level).alias("level"), "name"))
        longest = named.agg(F.max("of")).first()[0] or 1
        if longest == 1:
            break
        named, level = _name_pairs(named.filter("of > 1")), level + 1
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return facts.join(out, "row")


def _name_blocks(rows: DataFrame, blocks: DataFrame) -> DataFrame:
    """(row, pos, of, name) from the distinct blocks in sorted order.

    ``clash`` counts the distinct blocks of a hash. Where it is 1, the hash finds the
    name; elsewhere the blocks are compared themselves.
    """
    texts = blocks.groupBy("h", "block").agg(F.count(F.lit(1)).alias("n"))
    names = texts.sortWithinPartitions("h", "block").withColumn("name", F.monotonically_increasing_id())
    by_hash = stored(
        names.groupBy("h").agg(
            F.min("name").alias("name"), F.count(F.lit(1)).alias("clash"), F.sum("n").alias("n")
        )
    )
    out = hot_join(rows, by_hash, ["h"], "n")
    clear = out.filter("clash = 1").select("row", "pos", "of", "name")
    clashing = by_hash.filter("clash > 1").select("h")
    if clashing.isEmpty():
        return stored(clear)
    # Names of clashing blocks are negative and so apart from the names above.
    some = blocks.join(clashing, "h", "left_semi")
    own = stored(
        some.groupBy("h", "block")
        .agg(F.count(F.lit(1)).alias("n"))
        .sortWithinPartitions("h", "block")
        .withColumn("name", -1 - F.monotonically_increasing_id())
    )
    told = hot_join(some.select("row", "pos", "of", "h", "block"), own, ["h", "block"], "n")
    return stored(clear.unionByName(told.select("row", "pos", "of", "name")))


def _name_pairs(named: DataFrame) -> DataFrame:
    """One level up: the names of adjacent pairs. A last name without a partner pairs with NULL."""
    even = F.col("pos") % 2 == 0
    pairs = stored(
        named.groupBy("row", F.expr("pos div 2").cast("int").alias("pos"), F.expr("(of + 1) div 2").cast("int").alias("of"))
        .agg(F.max(F.when(even, F.col("name"))).alias("a"), F.max(F.when(~even, F.col("name"))).alias("b"))
    )
    names = stored(
        pairs.groupBy("a", "b")
        .agg(F.count(F.lit(1)).alias("n"))
        .sortWithinPartitions("a", "b")
        .withColumn("name", F.monotonically_increasing_id())
    )
    return stored(hot_join(pairs, names, ["a", "b"], "n").select("row", "pos", "of", "name"))


def exact_groups(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", hasher=F.xxhash64, row: str | None = None
) -> DataFrame:
    """One row per input row: ``doc_id, keep_id, group_size, kept, text_sha256``, and
    ``n_chars`` of the original text.

    Of equal normalised texts the row with the most original characters stays, then the
    one with the smallest id, NULL last. Of rows that are repeated whole one stays, and
    ``group_size`` counts each. An empty table gives no rows.
    """
    rows = stored(identities(df, id_col, text_col, hasher, row))
    best = F.struct(
        (-F.col("n_chars")).alias("n"),
        F.col("doc_id").isNull().alias("no_id"),
        F.col("doc_id").alias("id"),
        F.col("row").alias("row"),
    )
    groups = stored(
        rows.groupBy("level", "name")
        .agg(F.min(best).alias("best"), F.count(F.lit(1)).alias("group_size"))
        .withColumn("n", F.col("group_size"))
    )
    return hot_join(rows, groups, ["level", "name"], "n").select(
        "doc_id",
        F.col("best.id").alias("keep_id"),
        "group_size",
        (F.col("row") == F.col("best.row")).alias("kept"),
        "text_sha256",
        "n_chars",
        "row",
    )


def exact_dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``df`` that stay, with all their columns."""
    (row,) = fresh(df, "_row")
    numbered = stored(df.withColumn(row, F.monotonically_increasing_id()), "zstd")
    stay = exact_groups(numbered, id_col, text_col, row=row).filter("kept").select(F.col("row").alias(row))
    return numbered.join(stay, row, "left_semi").drop(row)
