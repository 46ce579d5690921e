"""Merkle manifest of a table as a persistent tree with path copying.

The rows of a language are leaves in the order of their ids; every eight consecutive nodes
have a parent, and the subroots of the languages form one more tree above. A tree is cut
into aligned blocks of 8**4 nodes. Going up, a task hashes a whole block, and the roots of
the blocks are the leaves of the next tier; going down, a block's root hands on its path to
the tree's root, as the digests left and right of it on every level. No tier gathers a
language in one task.

A changed leaf makes a version of the tree: it copies the ancestors of the leaf inside its
block, goes on along the path of the block through the upper tiers, and shares every other
node with the version it came from, which stays as it is.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenfold.llm.common import blocks, ranked, stored

#: Children of a node, and levels of an aligned block.
WIDTH, LEVELS = 8, 4
BLOCK = WIDTH**LEVELS
#: Columns of a leaf in the order in which they are hashed.
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


# ---- leaves and their places ------------------------------------------------


def leaf(*values: Column) -> Column:
    """sha256, as lowercase hex, of the values, each as its byte count, ``:`` and its text; NULL is ``-``."""
    texts = [v.cast("string") for v in values]
    parts = [F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts]
    return F.sha2(F.concat(*parts), 256)


def lower_cased(text: Column) -> Column:
    """The text with A-Z in lower case."""
    return F.translate(text, _UPPER, _LOWER)


def chosen(ident: Column) -> Column:
    """True where 3 divides the checksum of the decimal id; false for NULL."""
    return F.coalesce(F.crc32(ident.cast("string")) % 3 == 0, F.lit(False))


# ---- one block --------------------------------------------------------------


def digest(text: str) -> str:
    return hashlib.sha256(text.encode("ascii")).hexdigest()


def height(n: int) -> int:
    """Levels above the leaves of one block in a tree of ``n``: up to the tree's root, or
    up to the root of the block."""
    levels = 0
    while n > 1 and levels < LEVELS:
        n, levels = -(-n // WIDTH), levels + 1
    return levels


def grow(leaves: list[str], levels: int) -> list[list[str]]:
    """All levels of a block, from its leaves up."""
    out = [leaves]
    for _ in range(levels):
        out.append([digest("".join(out[-1][i : i + WIDTH])) for i in range(0, len(out[-1]), WIDTH)])
    return out


def path(levels: list[list[str]], i: int) -> list[str]:
    """The siblings of leaf ``i`` up to the block's root: left and right of it on each level."""
    out = []
    for nodes in levels[:-1]:
        run = i - i % WIDTH
        out += ["".join(nodes[run:i]), "".join(nodes[i + 1 : run + WIDTH])]
        i //= WIDTH
    return out


def fold(node: str, siblings: list[str]) -> list[str]:
    """The ancestors of a node, given the siblings on its path."""
    out = []
    for left, right in zip(siblings[::2], siblings[1::2], strict=True):
        node = digest(left + node + right)
        out.append(node)
    return out


# ---- up and down the tiers --------------------------------------------------


def _up(batches):
    for block in blocks(batches, lambda b: b.column("pos").to_numpy() % BLOCK == 0):
        n, first = block.column("n")[0].as_py(), block.column("pos")[0].as_py()
        levels = grow(block.column("digest").to_pylist(), height(n))
        rows = [(k, first // WIDTH**k + i, d) for k, nodes in enumerate(levels) if k for i, d in enumerate(nodes)]
        rows = rows or [(0, 0, levels[0][0])]  # a lone leaf is the root
        level, pos, digests = zip(*rows, strict=True)
        last = [k == len(levels) - 1 for k in level]
        whole = n <= BLOCK
        columns = {
            "key": pa.array([block.column("key")[0].as_py()] * len(rows), pa.string()),
            "level": pa.array(level, pa.int32()),
            "pos": pa.array(pos, pa.int64()),
            "n": pa.array([-(-n // WIDTH**k) for k in level], pa.int64()),
            "digest": pa.array(digests, pa.string()),
            "top": pa.array([x and whole for x in last]),
            "goes_on": pa.array([x and not whole for x in last]),
        }
        yield pa.RecordBatch.from_pydict(columns)


def build(leaves: DataFrame) -> tuple[list[DataFrame], list[DataFrame]]:
    """The tiers of the trees of (key, pos, n, digest), one tree per key, and the stored
    nodes of each tier as (key, level, pos, n, digest, top, goes_on).

    ``level`` counts inside the tier, ``top`` marks the root of a tree, and ``goes_on`` the
    roots of blocks, which are the leaves of the next tier.
    """
    parts = int(leaves.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    tiers, nodes = [leaves], []
    while True:
        rows = tiers[-1].select("key", "pos", "n", "digest", F.expr(f"pos div {BLOCK}").alias("block"))
        rows = rows.repartition(parts, "key", "block").sortWithinPartitions("key", "block", "pos")
        kinds = "key string, level int, pos long, n long, digest string, top boolean, goes_on boolean"
        nodes.append(stored(rows.mapInArrow(_up, kinds)))
        more = nodes[-1].filter("goes_on").select("key", "pos", "n", "digest")
        if more.isEmpty():
            return tiers, nodes
        tiers.append(more)


def tops(nodes: list[DataFrame]) -> DataFrame:
    """(key, tier, digest) of the root of every tree."""
    each = [d.filter("top").select("key", F.lit(t).alias("tier"), "digest") for t, d in enumerate(nodes)]
    out = each[0]
    for more in each[1:]:
        out = out.unionByName(more)
    return out


def trace(tiers: list[DataFrame], starts: DataFrame, last: Callable, kinds: str, first: Callable | None = None) -> DataFrame:
    """Hand the paths down from the roots to the leaves.

    ``starts`` has (key, tier, above array<string>, info string): what lies above the root
    of each tree. A block goes through one task, led by one row with its path; ``first``
    turns a block of an upper tier, and ``last`` a block of leaves, into rows.
    """
    parts = int(starts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    heads = None
    for t in reversed(range(len(tiers))):
        own = starts.filter(F.col("tier") == t).select("key", F.lit(0).cast("long").alias("block"), "above", "info")
        heads = own if heads is None else own.unionByName(heads.select("key", F.col("pos").alias("block"), "above", "info"))
        rows = tiers[t].withColumn("block", F.expr(f"pos div {BLOCK}"))
        both = rows.unionByName(heads.withColumn("pos", F.lit(-1).cast("long")), allowMissingColumns=True)
        both = both.repartition(parts, "key", "block").sortWithinPartitions("key", "block", "pos")
        if t:
            heads = stored(both.mapInArrow(first or _paths, "key string, pos long, above array<string>, info string"))
        else:
            return both.mapInArrow(last, kinds)
    raise ValueError("no tiers")


def led(batches) -> Iterator[tuple[pa.Table, list[list[str]], list[str], str, int]]:
    """The blocks of ``trace``: rows, levels, the path above the block, its info, and the
    place of its first leaf."""
    for block in blocks(batches, lambda b: b.column("pos").to_numpy() == -1):
        above, info, rows = block.column("above")[0].as_py(), block.column("info")[0].as_py(), block.slice(1)
        levels = grow(rows.column("digest").to_pylist(), height(rows.column("n")[0].as_py()))
        yield rows, levels, above, info, rows.column("pos")[0].as_py()


def _paths(batches):
    for rows, levels, above, info, _ in led(batches):
        n = rows.num_rows
        columns = {
            "key": pa.array(rows.column("key").to_pylist(), pa.string()),
            "pos": pa.array(rows.column("pos").to_pylist(), pa.int64()),
            "above": pa.array([path(levels, i) + above for i in range(n)], pa.list_(pa.string())),
            "info": pa.array([info] * n, pa.string()),
        }
        yield pa.RecordBatch.from_pydict(columns)


# ---- the manifest -----------------------------------------------------------


_COPY = pa.struct([("tree", pa.int32()), ("level", pa.int32()), ("pos", pa.int64()), ("digest", pa.string())])


def manifest(df: DataFrame, changed: Column, fields=FIELDS, id_col: str = "doc_id", key_col: str = "lang") -> DataFrame:
    """One row per input row: ``doc_id, lang, leaf, subroot, root, proof_sha256,
    folded_root, verified`` and ``copies``, the nodes of the row's version of the tree.

    ``changed`` is the digest of the row's leaf after a change, NULL where it has none. A
    changed leaf copies its ancestors: (tree, level, pos, digest), tree 0 being that of the
    language and 1 the one above the languages; every other node is the one of ``nodes``.
    ``folded_root`` is the root of the version, and the row is verified if it equals
    ``root``; without a change ``copies`` is NULL and the original leaf is folded.

    NULL values are hashed as ``-``, a NULL language comes first, and a NULL id first in its
    language. Rows that repeat an id are ordered by their digest; rows repeated whole are
    leaves of their own. An empty table gives no rows. Columns not in ``fields`` are not read.
    """
    cols = {f: F.col(f"`{f}`") for f in fields}
    kind = df.schema[id_col].dataType.simpleString()
    leaves = df.select(
        F.col(f"`{key_col}`").cast("string").alias("key"),
        F.col(f"`{id_col}`").alias("doc_id"),
        leaf(*cols.values()).alias("digest"),
        changed.alias("changed"),
        F.monotonically_increasing_id().alias("tie"),
    )
    # Stored before the range sort, which would hash all texts once more for its sample.
    leaves = ranked(stored(leaves), ["key"], ["doc_id", "digest", "tie"]).drop("tie")
    tiers, nodes = build(leaves)
    subroots = ranked(tops(nodes), [], ["key"])
    named = subroots.select(F.lit("").alias("key"), "pos", "n", "digest", F.col("key").alias("lang"), "tier")
    upper, above = build(named)
    # One row: the root of all.
    root = "".join(r.digest for r in tops(above).collect())
    heads = tops(above).select("key", "tier", F.array().cast("array<string>").alias("above"), F.lit("").alias("info"))
    of_langs = stored(trace(upper, heads, _langs, "lang string, pos long, tier int, digest string, above array<string>"))
    info = F.concat_ws(" ", "digest", F.col("pos").cast("string"))
    starts = of_langs.select(F.col("lang").alias("key"), "tier", "above", info.alias("info"))

    def last(batches):
        for rows, levels, over, told, first in led(batches):
            subroot, at = told.split(" ")
            ends = "".join(over)
            new, old = rows.column("changed").to_pylist(), levels[0]
            proofs, folded, copies = [], [], []
            inside, upto = len(levels) - 1, len(over) // 2
            for i, (was, now) in enumerate(zip(old, new, strict=True)):
                own = path(levels, i)
                proofs.append(digest("".join(own) + ends))
                version = fold(now or was, own + over)
                folded.append(version[-1] if version else now or was)
                if now is None:
                    copies.append(None)
                    continue
                # Levels of the language's own tree come first, then those above it.
                top = upto - above_levels
                path_of = [(0, k, (first + i) // WIDTH**k) for k in range(1, inside + top + 1)]
                path_of += [(1, k, int(at) // WIDTH**k) for k in range(1, above_levels + 1)]
                copies.append(
                    [{"tree": t, "level": k, "pos": p, "digest": d} for (t, k, p), d in zip(path_of, version, strict=True)]
                )
            n = rows.num_rows
            columns = {
                "doc_id": rows.column("doc_id").combine_chunks(),
                "lang": pa.array(rows.column("key").to_pylist(), pa.string()),
                "leaf": pa.array(old, pa.string()),
                "subroot": pa.array([subroot] * n, pa.string()),
                "root": pa.array([root] * n, pa.string()),
                "proof_sha256": pa.array(proofs, pa.string()),
                "folded_root": pa.array(folded, pa.string()),
                "verified": pa.array([f == root for f in folded], pa.bool_()),
                "copies": pa.array(copies, pa.list_(_COPY)),
            }
            yield pa.RecordBatch.from_pydict(columns)

    above_levels = _levels_of(of_langs)
    texts = "lang string, leaf string, subroot string, root string, proof_sha256 string, folded_root string"
    copied = "array<struct<tree:int,level:int,pos:bigint,digest:string>>"
    return trace(tiers, starts, last, f"doc_id {kind}, {texts}, verified boolean, copies {copied}")


def _levels_of(of_langs: DataFrame) -> int:
    """Levels above the subroots, the same for all of them."""
    row = of_langs.agg(F.max(F.size("above"))).first()
    return (row[0] or 0) // 2


def _langs(batches):
    for rows, levels, above, _, _ in led(batches):
        columns = {
            "lang": pa.array(rows.column("lang").to_pylist(), pa.string()),
            "pos": pa.array(rows.column("pos").to_pylist(), pa.int64()),
            "tier": pa.array(rows.column("tier").to_pylist(), pa.int32()),
            "digest": pa.array(rows.column("digest").to_pylist(), pa.string()),
            "above": pa.array([path(levels, i) + above for i in range(rows.num_rows)], pa.list_(pa.string())),
        }
        yield pa.RecordBatch.from_pydict(columns)


def nodes(df: DataFrame, fields=FIELDS, id_col: str = "doc_id", key_col: str = "lang") -> DataFrame:
    """The tree that all versions share: (lang, level, pos, digest) of every node above the
    leaves, levels from 1; a language with one row has its leaf as level 0."""
    leaves = df.select(
        F.col(f"`{key_col}`").cast("string").alias("key"),
        F.col(f"`{id_col}`").alias("doc_id"),
        leaf(*(F.col(f"`{f}`") for f in fields)).alias("digest"),
        F.monotonically_increasing_id().alias("tie"),
    )
    _, made = build(ranked(stored(leaves), ["key"], ["doc_id", "digest", "tie"]))
    each = [d.select(F.col("key").alias("lang"), (F.col("level") + t * LEVELS).alias("level"), "pos", "digest") for t, d in enumerate(made)]
    out = each[0]
    for more in each[1:]:
        out = out.unionByName(more)
    return out


def tampered(fields=FIELDS) -> Column:
    """The leaf after lower-casing A-Z in the text, where the row is chosen; else NULL."""
    cols = {f: F.col(f"`{f}`") for f in fields}
    return F.when(chosen(cols["doc_id"]), leaf(*(lower_cased(c) if f == "text" else c for f, c in cols.items())))
