"""Token counts of flat, unindexed token files by a separator scan.

A token file is nothing but ids, little-endian and of fixed width, with an end-of-document
id after each document. Files are read in blocks; a block knows nothing of its neighbours.
In each block one vector comparison finds the separators. What a block leaves open at its
ends is stitched by prefix scans over the blocks: separators so far give the number of a
document, tokens since the last separator give what it brings along. The scans run in two
levels, over the blocks of a chunk and over the chunks of a file, so a file of any length is
spread over many tasks and only a row per block is moved.
"""

from __future__ import annotations

import base64

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lumenfold.llm.common import stored, text_of
from lumenfold.llm.tokens import public_path

END_ID = 50256
#: Bytes of an id; two hold vocabularies of up to 65,536 ids.
WIDTH = 2
#: Tokens in a block, and blocks in a chunk of the scan.
BLOCK, CHUNK = 65_536, 512


def byte_bpe(path: str):
    """The public byte-level vocabulary; the end id is no id of any text."""
    import public_tokenizers
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def token_blocks(
    df: DataFrame, vocabulary: str | None = None, id_col: str = "doc_id", text_col: str = "text", block: int = BLOCK
) -> DataFrame:
    """Flat token files of the texts, one per partition, as blocks: (file, block, data).

    Blocks are cut by size alone, so documents run over their ends. Beside the data comes
    the manifest, which counting does not read: ``ids`` lists the documents that end in
    the block, in order. NULL is an empty text: its document is just the end id.
    """
    two = df.select(F.col(f"`{id_col}`").alias("doc_id"), text_of(text_col).alias("text"))
    kind = two.schema["doc_id"].dataType.simpleString()
    id_type = two.schema["doc_id"].dataType

    def run(batches):
        from pyspark.sql.pandas.types import to_arrow_type

        tokenizer = byte_bpe(vocabulary or public_path("byte_bpe_50k.tiktoken"))
        file = TaskContext.get().partitionId()
        size, number, held, ids = block * WIDTH, 0, bytearray(), []
        end = np.array([END_ID], dtype=f"<u{WIDTH}").tobytes()

        def row(data):
            names = ["file", "block", "data", "ids"]
            arrays = [
                pa.array([file], pa.int32()),
                pa.array([number], pa.int64()),
                pa.array([data], pa.binary()),
                pa.array([ids], pa.list_(to_arrow_type(id_type))),
            ]
            return pa.RecordBatch.from_arrays(arrays, names=names)

        for batch in batches:
            for doc, t in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                held += np.array(tokenizer.encode_ordinary(t.as_py() or ""), dtype=f"<u{WIDTH}").tobytes() + end
                while len(held) > size:
                    yield row(bytes(held[:size]))
                    del held[:size]
                    number, ids = number + 1, []
                ids.append(doc)
        if held:
            yield row(bytes(held))

    return two.mapInArrow(run, f"file int, block long, data binary, ids array<{kind}>")


def read_token_files(spark, path: str, block: int = BLOCK, width: int = WIDTH) -> DataFrame:
    """Blocks (file, block, data) of flat token files in a folder. A file is read whole by
    one task before it is cut, so files should be shards of at most about a gigabyte."""
    files = spark.read.format("binaryFile").load(path).select(F.col("path").alias("file"), "content")
    at = F.explode(F.sequence(F.lit(0), F.greatest(F.lit(0), F.expr(f"(length(content) - 1) div {block * width}").cast("int"))))
    cut = files.select("file", "content", at.alias("block"))
    data = F.substring("content", F.col("block") * (block * width) + 1, F.lit(block * width))
    return cut.select("file", F.col("block").cast("long").alias("block"), data.alias("data"))


def _scan(end_id: int, width: int):
    kind = f"<u{width}"

    def run(batches):
        for batch in batches:
            rows: list[list] = [[], [], [], []]
            for d in batch.column(2):
                data = d.as_buffer() if d.is_valid else b""
                ids = np.frombuffer(data, dtype=kind)
                at = np.flatnonzero(ids == end_id)
                rows[0].append(len(at))
                rows[1].append(int(at[0]) if len(at) else 0)  # tokens before the first separator
                rows[2].append(len(ids) - int(at[-1]) - 1 if len(at) else len(ids))  # after the last
                rows[3].append((np.diff(at) - 1).tolist())  # of documents inside the block
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64())]
            arrays = [pa.array(r, k) for r, k in zip(rows, kinds, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), *arrays], names=["file", "block", "seps", "head", "tail", "inner"]
            )

    return run


def count_tokens(blocks: DataFrame, end_id: int = END_ID, width: int = WIDTH, chunk: int = CHUNK) -> DataFrame:
    """(file, number, n_tokens): one row per document in order of the file, without its end
    id. Tokens after the last end id are a document too.

    Empty and NULL blocks hold no tokens. Blocks of a file are numbered in order, gaps
    are fine.
    """
    kind = blocks.schema["file"].dataType.simpleString()
    three = blocks.select("file", "block", "data")
    found = three.mapInArrow(
        _scan(end_id, width), f"file {kind}, block long, seps long, head long, tail long, inner array<long>"
    )
    found = stored(found.withColumn("chunk", F.expr(f"block div {chunk}")))
    # What a block finds open: the tails of the blocks before it in its chunk, from the
    # last one with a separator on. Both sums are running sums, so their difference is it.
    sum_before = lambda c, w: F.coalesce(F.sum(c).over(w), F.lit(0))
    before = Window.partitionBy("file", "chunk").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    marked = found.withColumns({"seen": sum_before("seps", before), "upto": sum_before("tail", before)})
    base = F.max(F.when(F.col("seps") > 0, F.col("upto"))).over(before)
    marked = marked.withColumn("carry", F.col("upto") - F.coalesce(base, F.lit(0)))
    ends = marked.groupBy("file", "chunk").agg(
        F.sum("seps").alias("seps"), F.max_by(F.struct("carry", "tail", F.col("seps").alias("own")), "block").alias("e")
    )
    tail = F.when(F.col("e.own") > 0, F.col("e.tail")).otherwise(F.col("e.carry") + F.col("e.tail"))
    ends = ends.select("file", "chunk", "seps", tail.alias("tail"))
    over = Window.partitionBy("file").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    ends = ends.withColumn("upto", sum_before("tail", over))
    begin = F.max(F.when(F.col("seps") > 0, F.col("upto"))).over(over)
    chunks = stored(
        ends.select(
            "file",
            "chunk",
            sum_before("seps", over).alias("chunk_seen"),
            (F.col("upto") - F.coalesce(begin, F.lit(0))).alias("chunk_carry"),
        )
    )
    met = marked.join(chunks, ["file", "chunk"])
    carried = F.col("carry") + F.when(F.col("seen") == 0, F.col("chunk_carry")).otherwise(F.lit(0))
    first = F.col("chunk_seen") + F.col("seen")
    whole = met.filter("seps > 0").select(
        "file", first.alias("first"), F.posexplode(F.concat(F.array(carried + F.col("head")), "inner")).alias("i", "n_tokens")
    )
    whole = whole.select("file", (F.col("first") + F.col("i")).alias("number"), "n_tokens")
    # What follows the last separator of a file.
    final = met.groupBy("file").agg(
        F.max_by(F.struct(first.alias("first"), "seps", "tail", carried.alias("carried")), "block").alias("e")
    )
    rest = F.when(F.col("e.seps") > 0, F.col("e.tail")).otherwise(F.col("e.carried") + F.col("e.tail"))
    final = final.select("file", (F.col("e.first") + F.col("e.seps")).alias("number"), rest.alias("n_tokens")).filter("n_tokens > 0")
    return whole.unionByName(final)


def document_counts(df: DataFrame, vocabulary: str | None = None, id_col="doc_id", text_col="text", block: int = BLOCK) -> DataFrame:
    """(doc_id, n_tokens, file, number): texts are written as flat token files, in blocks
    in the shared folder, and counted from these alone; the manifest then names the
    documents. One row per input row, NULL and repeated ids too."""
    files = stored(token_blocks(df, vocabulary, id_col, text_col, block), "zstd")
    counts = count_tokens(files)
    per = files.select("file", "block", "ids")
    ends = per.select("file", "block", F.size("ids").cast("long").alias("k"), F.expr(f"block div {CHUNK}").alias("chunk"))
    chunk = stored(ends.groupBy("file", "chunk").agg(F.sum("k").alias("k")))
    before = Window.partitionBy("file").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    offset = chunk.select("file", "chunk", F.coalesce(F.sum("k").over(before), F.lit(0)).alias("offset"))
    inside = Window.partitionBy("file", "chunk").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    placed = per.withColumn("chunk", F.expr(f"block div {CHUNK}")).withColumn("seen", F.coalesce(F.sum(F.size("ids")).over(inside), F.lit(0)))
    named = placed.join(offset, ["file", "chunk"]).select(
        "file", (F.col("offset") + F.col("seen")).alias("first"), F.posexplode("ids").alias("i", "doc_id")
    )
    named = named.select("file", (F.col("first") + F.col("i")).alias("number"), "doc_id")
    return named.join(counts, ["file", "number"]).select("doc_id", "n_tokens", "file", "number")
