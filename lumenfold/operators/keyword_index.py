"""A positional inverted index of words, and keyword search that reads only its terms.

A posting list holds the documents of a term with the places of the word, as differences
from one to the next. Lists are cut into segments by document number, so a word that
stands in every document is many short lists. The table is partitioned by a hash of the
term and sorted by term: a search reads the folders of its terms and skips the rest.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce
from itertools import chain
from operator import and_, or_

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenfold.functions.text import words
from lumenfold.operators.filters import keyword_filter, parse_keywords

FOLDERS = 64  # partitions of the table
SEGMENT = 1024  # document numbers in one posting list


def folder_of(term: Column) -> Column:
    return F.pmod(F.crc32(F.encode(term, "utf-8")), F.lit(FOLDERS)).cast("int")


def _deltas(values: Column, first: Column) -> Column:
    """Differences from one to the next, the first one from ``first``."""
    return F.transform(values, lambda x, i: x - F.when(i == 0, first).otherwise(F.get(values, i - 1)))


def _sums(deltas: Column, first: Column) -> Column:
    """What :func:`_deltas` was made from."""
    empty = F.array().cast("array<bigint>")
    last = lambda acc: F.coalesce(F.get(acc, F.size(acc) - 1), first)
    return F.aggregate(deltas, empty, lambda acc, d: F.array_append(acc, last(acc) + d))


_LISTS = "folder int, term string, segment long, docs array<long>, places array<array<long>>"


def _ends(starts: np.ndarray, n: int) -> pa.Array:
    return pa.array(np.append(starts, n).astype(np.int32))


def _lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Posting lists of words in the order of term, segment, document and place."""
    rest = None
    for batch in chain(batches, [None]):
        parts = [t for t in (rest, None if batch is None else pa.Table.from_batches([batch])) if t is not None]
        if not parts:
            continue
        rows = pa.concat_tables(parts).combine_chunks()
        if not rows.num_rows:
            continue
        segment, term = rows.column("segment").to_numpy(), rows.column("term").combine_chunks()
        other = pc.not_equal(term.slice(1), term.slice(0, len(term) - 1)).to_numpy(zero_copy_only=False)
        first = np.concatenate(([True], other | (segment[1:] != segment[:-1])))
        end = len(first)
        if batch is not None:  # the last list may go on in the next batch
            end = int(np.flatnonzero(first)[-1])
            rest = rows.slice(end)
            if not end:
                continue
        doc, place = rows.column("doc").to_numpy()[:end], rows.column("place").to_numpy()[:end]
        first = first[:end]
        of_doc = first | np.concatenate(([True], doc[1:] != doc[:-1]))
        once = np.flatnonzero(of_doc | np.concatenate(([True], place[1:] != place[:-1])))
        first, of_doc, doc, place = first[once], of_doc[once], doc[once], place[once]
        step = np.where(of_doc, place, place - np.concatenate(([0], place[:-1])))
        docs = np.flatnonzero(of_doc)
        head, number = first[docs], doc[docs]
        lists = np.flatnonzero(head)
        kept = rows.select(["folder", "term", "segment"]).take(pa.array(once[docs[lists]])).combine_chunks()
        begin = np.repeat(kept.column("segment").to_numpy() * SEGMENT, np.diff(np.append(lists, len(docs))))
        gap = number - np.where(head, begin, np.concatenate(([0], number[:-1])))
        at = pa.ListArray.from_arrays(_ends(docs, len(once)), pa.array(step))
        ends = _ends(lists, len(docs))
        columns = [c.combine_chunks() for c in kept.columns]
        columns += [pa.ListArray.from_arrays(ends, pa.array(gap)), pa.ListArray.from_arrays(ends, at)]
        yield pa.RecordBatch.from_arrays(columns, names=[*kept.column_names, "docs", "places"])


def postings(df: DataFrame, ident: str, text: str) -> DataFrame:
    """(folder, term, segment, docs, places): ``docs`` are differences of document numbers,
    ``places`` for each document the differences of the word's positions.

    ``ident`` is an integer; rows that share one are one document with all their words.
    Rows without id or text have no postings.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    doc = F.col(f"`{ident}`").cast("long")
    each = df.select(doc.alias("doc"), F.posexplode(words(text)).alias("place", "term")).filter("doc is not null")
    segment = F.expr(f"floor(doc / {SEGMENT})").cast("long").alias("segment")
    each = each.select(folder_of(F.col("term")).alias("folder"), "term", segment, "doc", F.col("place").cast("long"))
    # Dealt once, by what the table is sorted by; a segment bounds every list.
    by = ["folder", "term", "segment"]
    dealt = each.repartitionByRange(parts, *by).sortWithinPartitions(*by, "doc", "place")
    return dealt.mapInArrow(_lists, _LISTS)


def write_index(df: DataFrame, ident: str, text: str, path: str) -> None:
    """Write the index of a text column; an existing one is an error."""
    rows = postings(df, ident, text).sortWithinPartitions("folder", "term", "segment")
    rows.write.partitionBy("folder").parquet(path)


def read_postings(spark: SparkSession, path: str, terms: list[str]) -> DataFrame:
    """The stored lists of some terms; only their folders are read."""
    values = spark.createDataFrame([(t,) for t in terms], "term string").select(folder_of(F.col("term")).alias("f"))
    folders = sorted({r.f for r in values.collect()})
    return spark.read.parquet(path).filter(F.col("folder").isin(folders) & F.col("term").isin(terms))


def _shifted(places: Column, by: int) -> Column:
    return F.transform(places, lambda p: p - by)


def _found(places: Column, phrase: list[str]) -> Column:
    """The words of a phrase at places that follow each other."""
    none = F.array().cast("array<bigint>")
    starts = [_shifted(F.coalesce(F.try_element_at(places, F.lit(w)), none), i) for i, w in enumerate(phrase)]
    return F.size(reduce(F.array_intersect, starts)) > 0


def search(spark: SparkSession, path: str, expression: str) -> DataFrame:
    """(doc) of the documents whose indexed text matches a keyword expression, once each.

    Terms of letters and digits are decided by the index alone. Where a term has other
    characters, its words are: the result then also holds documents in which these
    characters differ, and :func:`matching` tells them apart.
    """
    alternatives = [[_words(t) for t in terms] for terms in parse_keywords(expression)]
    terms = sorted({w for phrases in alternatives for phrase in phrases for w in phrase})
    if not terms:
        raise ValueError("the keyword expression has no words")
    lists = read_postings(spark, path, terms)
    docs = _sums(F.col("docs"), F.col("segment") * SEGMENT)
    each = lists.select("term", F.inline(F.arrays_zip(docs.alias("doc"), F.col("places"))))
    each = each.select("doc", "term", _sums(F.col("places"), F.lit(0).cast("long")).alias("places"))
    of_doc = each.groupBy("doc").agg(F.map_from_entries(F.collect_list(F.struct("term", "places"))).alias("m"))
    hits = [reduce(and_, [_found(F.col("m"), p) for p in phrases if p] or [F.lit(True)]) for phrases in alternatives]
    return of_doc.filter(reduce(or_, hits)).select("doc")


def _words(term: str) -> list[str]:
    return [w for w in re.split(r"[\W_]+", term.lower()) if w]


def matching(df: DataFrame, ident: str, path: str, expression: str, text: str) -> DataFrame:
    """The rows that :func:`keyword_filter` keeps, found through the index at ``path`` of the
    column ``text``. Texts are read again only for terms with marks in them."""
    found = search(df.sparkSession, path, expression).withColumnRenamed("doc", "_doc")
    out = df.join(found, F.col(f"`{ident}`").cast("long") == F.col("_doc"), "left_semi")
    plain = all(re.fullmatch(r"[^\W_]+(\s+[^\W_]+)*", t) for terms in parse_keywords(expression) for t in terms)
    return out if plain else keyword_filter(out, expression, text)
