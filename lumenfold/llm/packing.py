"""Sum-of-squares packing of token sequences.

Documents become token ids and an end id, and are cut into pieces only where they exceed a
sequence. Full pieces are sequences as they stand. The others are dealt to shards of bounded
size that are contiguous ranges of the documents' order. A shard places its pieces, longest
first, where the sum over all residual gaps of the squared number of open sequences with
that gap becomes smallest; it knows its open sequences by their gap only, so a step costs
one vector operation on the counts. Sequences are numbered in the documents' order.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenfold.llm.common import ranked, stored, text_of
from lumenfold.llm.tokens import public_path, word_tokens

CAPACITY = 2048
END_ID = 0
#: Pieces in a shard on average. A shard wastes a few sequences, whatever its size.
SHARD = 65_536
_NEVER = np.int64(1) << 40


def place(lengths: np.ndarray, capacity: int = CAPACITY) -> tuple[np.ndarray, np.ndarray]:
    """Sequence number and offset of every length (1 to capacity), taken in order.

    Among equal sums the fuller sequence is taken, then the newer one.
    """
    count = np.zeros(capacity + 1, dtype=np.int64)
    held: list[list[int]] = [[] for _ in range(capacity + 1)]  # open sequences by gap
    seq, off = np.empty(len(lengths), dtype=np.int64), np.empty(len(lengths), dtype=np.int64)
    used = 0
    for i, s in enumerate(lengths.tolist()):
        change = 1 - 2 * count[s:]  # a sequence leaves gap g = s, s + 1, ...
        change[1:] += 2 * count[1 : capacity - s + 1] + 1  # and enters gap g - s
        change[count[s:] == 0] = _NEVER
        k = int(change.argmin())
        fresh = 2 * count[capacity - s] + 1 if s < capacity else 0
        if change[k] < _NEVER and change[k] <= fresh:
            gap = s + k
            number = held[gap].pop()
            count[gap] -= 1
        else:
            gap, number = capacity, used
            used += 1
        seq[i], off[i] = number, capacity - gap
        if gap > s:
            held[gap - s].append(number)
            count[gap - s] += 1
    return seq, off


def file_order(df: DataFrame) -> tuple[Column, Column] | None:
    """The order in which the rows of a Parquet table were written: number and path of the
    part file, and the row in it. ``df`` must read the table as it is. None if it is no table.
    """
    try:
        df.select("_metadata.file_name", "_metadata.row_index")
    except AnalysisException:
        return None
    part = F.lpad(F.regexp_extract("_metadata.file_name", "^part-([0-9]+)", 1), 10, "0")
    return F.concat(part, F.col("_metadata.file_path")), F.col("_metadata.row_index")


def pieces(
    df: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    vocabulary: str | None = None,
    capacity: int = CAPACITY,
    with_ids: bool = False,
    order: tuple[Column, Column] | None = None,
) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32), and the ids as bytes if wanted; then the
    document's place as (file, row), which ``pack`` takes off. ``order`` gives the place,
    another one for each row; without it, rows are in the order of ``df``.

    ``vocabulary`` is the path of a ``tokenizers`` file on the executors; without one,
    each executor asks the installed public vocabularies for ``word_bpe_49k.json``.
    """
    file, row = order or (F.lit(""), F.monotonically_increasing_id())
    two = df.select(F.col(f"`{id_col}`").alias("doc_id"), text_of(text_col).alias("text"), file.alias("file"), row.alias("row"))
    kind = two.schema["doc_id"].dataType.simpleString()
    end = np.array([END_ID], dtype="<u4").tobytes()
    names = ["doc_id", "piece", "start", "length", "ids_crc32"] + ["ids"] * with_ids + ["file", "row"]

    def cut(batches):
        tokenizer = word_tokens(vocabulary or public_path("word_bpe_49k.json"))
        for batch in batches:
            rows: list[list] = [[] for _ in names[:-2]]
            at: list[int] = []
            for i, text in enumerate(batch.column(1)):
                ids = tokenizer.ids(text.as_py() or "") + end
                for p, lo in enumerate(range(0, len(ids), 4 * capacity)):
                    part = ids[lo : lo + 4 * capacity]
                    at.append(i)
                    facts = (p, lo // 4, len(part) // 4, zlib.crc32(part), part)
                    for column, fact in zip(rows[1:], facts, strict=False):
                        column.append(fact)
            kinds = [pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
            arrays = [pa.array(c, k) for c, k in zip(rows[1:], kinds, strict=False)]
            docs, files, places = (batch.column(c).take(pa.array(at, pa.int64())) for c in (0, 2, 3))
            yield pa.RecordBatch.from_arrays([docs, *arrays, files, places], names=names)

    ids = ", ids binary" if with_ids else ""
    return two.mapInArrow(cut, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long{ids}, file string, row long")


def _pack_shard(capacity: int):
    def pack(batches):
        table = pa.Table.from_batches(list(batches)) if (batches := [b for b in batches if b.num_rows]) else None
        if table is None:
            return
        table = table.sort_by([("length", "descending"), ("ids_crc32", "ascending"), ("start", "ascending"), ("key", "ascending")])
        seq, off = place(table.column("length").to_numpy(), capacity)
        numbers = pa.array(middle(seq, table.column("key").to_numpy()))
        table = table.drop_columns("key").append_column("sequence_id", numbers).append_column("offset", pa.array(off))
        yield from table.to_batches(max_chunksize=10_000)

    return pack


def middle(seq: np.ndarray, key: np.ndarray) -> np.ndarray:
    """For every row, the middle one of the keys of its sequence; sequences count from 0."""
    by = np.lexsort((key, seq))
    first = np.searchsorted(seq[by], np.arange(seq.max() + 1))
    last = np.append(first[1:], len(seq)) - 1
    return key[by][(first + last) // 2][seq]


def pack(cut: DataFrame, capacity: int = CAPACITY, shard: int = SHARD) -> DataFrame:
    """The pieces with ``sequence_id`` and ``offset``.

    Pieces are numbered in the order of ``pieces`` by a range sort, and shards are ranges of
    the shorter ones among them. A sequence is numbered by its middle piece, so ids increase
    in that order, from shard to shard and inside a shard. Offsets of a sequence are gapless
    from 0. Pieces without ids and repeated rows are pieces like any other; those of a NULL
    or empty text are its end. An empty table gives no rows.
    """
    names = [c for c in cut.columns if c not in ("file", "row")]
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in cut.select(names).schema)
    keyed = ranked(stored(cut), [], ["file", "row", "piece"]).drop("file", "row", "n").withColumnRenamed("pos", "key")
    full = keyed.filter(F.col("length") == capacity).select(*names, F.col("key").alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    rest = ranked(keyed.filter(F.col("length") < capacity), [], ["key"])
    total = rest.agg(F.max("n")).first()[0] or 0
    shards = max(1, -(-total // shard))
    at = F.floor(F.col("pos") * shards / max(1, total)).cast("int")
    dealt = rest.select(*names, "key", at.alias("shard")).repartitionById(shards, F.col("shard")).drop("shard")
    packed = dealt.mapInArrow(_pack_shard(capacity), f"{kinds}, sequence_id long, offset long")
    return packed.unionByName(full)


def sequences(packed: DataFrame) -> DataFrame:
    """(sequence_id, ids, doc_ids) of packed pieces with ids: at most one capacity of
    tokens in a row, ids as little-endian unsigned 32-bit integers."""
    part = F.sort_array(F.collect_list(F.struct("offset", "ids", "doc_id")))
    return packed.groupBy("sequence_id").agg(part.alias("p")).select(
        "sequence_id",
        F.aggregate("p", F.lit(b""), lambda acc, x: F.concat(acc, x["ids"])).alias("ids"),
        F.col("p.doc_id").alias("doc_ids"),
    )
