"""Sentiment with negation and intensifiers: a state machine over a text's words in order.

A lexicon that can be broadcast is looked up where the text is, many texts at a time, and no
word leaves its task. With a larger one, each word is joined; what is known of a text is then
folded, word by word, inside its row.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lumenfold.operators.lookups import BROADCAST_ROWS, TooManyRows, lookup_join, small_rows
from lumenfold.operators.scoring import batch_words, copies, each_copy, spaced_words, text_words

# --- fixed values: the rules ---------------------------------------------------
REACH = 3  # words after a negation that it can still turn
TURNED = -0.5  # polarity of a negated word, as a multiple
NOT, MORE, WORD = 0, 1, 2

#: One step. ``gap`` unknown words lie between the last known word and this one: an
#: intensifier acts on the very next word only, a negation over ``REACH`` words.
_STEP = f"""
transform(array(named_struct(
    'boost', if(w.pos - z.at > 1, 1.0D, z.boost),
    'reach', greatest(0, z.reach - (w.pos - z.at - 1)))), c ->
  case w.kind
    when {NOT} then named_struct('p', z.p, 's', z.s, 'n', z.n, 'boost', 1.0D, 'reach', {REACH}, 'at', w.pos)
    when {MORE} then named_struct('p', z.p, 's', z.s, 'n', z.n, 'boost', c.boost * w.p, 'reach', c.reach, 'at', w.pos)
    else named_struct(
      'p', z.p + greatest(-1.0D, least(1.0D, w.p * c.boost * if(c.reach > 0, {TURNED}D, 1.0D))),
      's', z.s + least(1.0D, w.s * c.boost),
      'n', z.n + 1, 'boost', 1.0D, 'reach', 0, 'at', w.pos)
  end)[0]"""
_START = "named_struct('p', 0.0D, 's', 0.0D, 'n', 0, 'boost', 1.0D, 'reach', 0, 'at', -1)"


def known_words(lexicon: DataFrame, modifiers: DataFrame) -> DataFrame:
    """(term, kind, p, s) of the lexicon (term, polarity, subjectivity) and of modifiers (term,
    factor): a NULL factor negates, another one multiplies. A term in both is a modifier."""
    kind = F.when(F.col("factor").isNull(), NOT).otherwise(MORE)
    factor = F.coalesce(F.col("factor"), F.lit(0.0)).cast("double")
    rules = modifiers.select("term", kind.alias("kind"), factor.alias("p"), F.lit(0.0).alias("s"))
    plain = lexicon.join(modifiers.select("term"), "term", "left_anti")
    scores = [F.col(c).cast("double").alias(a) for c, a in (("polarity", "p"), ("subjectivity", "s"))]
    return rules.unionByName(plain.select("term", F.lit(WORD).alias("kind"), *scores))


def _plain(words: list[Row]) -> bool:
    """Whether every term has one row, with numbers."""
    numbers = all(w[c] is not None and w[c] == w[c] for w in words for c in ("p", "s"))
    return numbers and all(w["term"] is not None for w in words) and len({w["term"] for w in words}) == len(words)


def _totals(n: int, row: np.ndarray, pos: np.ndarray, kind: np.ndarray, p: np.ndarray, s: np.ndarray):
    """Lexicon words of each of ``n`` texts, and their sums, as :data:`_STEP` folds them.

    (row, pos, kind, p, s) is a known word, in reading order. Each lexicon word
    ends what stands before it, so it looks back to the one before it only."""
    at = np.arange(len(row))
    first = np.diff(row, prepend=-1) != 0
    start = np.maximum.accumulate(np.where(first, at, 0))
    unknown = pos - (at - start)  # unknown words of the text so far
    last = np.maximum.accumulate(np.where(kind == NOT, at, -1))
    word = np.maximum.accumulate(np.where(kind == WORD, at, -1))
    before = np.concatenate(([-1], word[:-1]))[: len(at)]
    turned = (last >= start) & (last > before) & (unknown - unknown[last] < REACH)
    # Intensifiers side by side are one run, which acts on the word right behind it.
    beside = ~first & (np.diff(pos, prepend=-1) == 1)
    more = kind == MORE
    joined = beside & more & np.concatenate(([False], more[:-1]))[: len(at)]
    head = np.flatnonzero(more & ~joined)
    factor = np.ones(len(at))
    if len(head):
        runs = np.multiply.reduceat(np.where(more, p, 1.0), head)
        factor = np.where(beside & np.concatenate(([False], more[:-1]))[: len(at)], runs[np.maximum(np.searchsorted(head, at) - 1, 0)], 1.0)
    hit = np.flatnonzero(kind == WORD)
    row, turned, factor = row[hit], turned[hit], factor[hit]
    polarity = np.maximum(-1.0, np.minimum(1.0, p[hit] * factor * np.where(turned, TURNED, 1.0)))
    subjectivity = np.minimum(1.0, s[hit] * factor)
    sums = [np.bincount(row, weights=x, minlength=n) for x in (polarity, subjectivity)]
    return np.bincount(row, minlength=n), *sums


def _scored_texts(df: DataFrame, ids: list[str], text: str, words: list[Row], cleaned: bool) -> DataFrame:
    """:func:`ruled_scores` without a join or a shuffle."""
    rows = df.select(*ids, spaced_words(f"`{text}`", cleaned).alias("_words"))
    place = {w["term"].encode(): i for i, w in enumerate(words)}
    kinds = np.array([w["kind"] for w in words], dtype=np.int64)
    values = [np.array([w[c] for w in words], dtype="float64") for c in ("p", "s")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            row, code, found = batch_words(batch.column(batch.num_columns - 1))
            at = np.array([place.get(w, -1) for w in found], dtype=np.int64)[code]
            pos = np.arange(len(row)) - np.searchsorted(row, row)
            hit = np.flatnonzero(at >= 0)
            known = at[hit]
            count, *sums = _totals(n, row[hit], pos[hit], kinds[known], *(v[known] for v in values))
            means = [pa.array(np.divide(x, count, out=np.zeros(n), where=count > 0)) for x in sums]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *means], names=[*batch.schema.names[:-1], "polarity", "subjectivity"])

    extra = [T.StructField(c, T.DoubleType()) for c in ("polarity", "subjectivity")]
    return rows.mapInArrow(run, T.StructType([*rows.schema.fields[:-1], *extra]))


def ruled_scores(
    df: DataFrame,
    ids: list[str],
    text: str,
    lexicon: DataFrame,
    modifiers: DataFrame,
    cleaned: bool = False,
    max_rows: int = BROADCAST_ROWS,
) -> DataFrame:
    """(ids, polarity, subjectivity): means over the lexicon words of a text, one row per
    row of ``df``; 0.0 without such words, and for a NULL text.

    A negation turns the next lexicon word, if that is among the ``REACH`` words
    behind it (modifiers do not count): its polarity is multiplied by ``TURNED``.
    Intensifiers multiply polarity and subjectivity of the word that follows at once, and
    each other. Every word stays within [-1, 1] and [0, 1].
    """
    known = known_words(lexicon, modifiers)
    try:
        few = small_rows(known, max_rows, "words")
    except TooManyRows:
        few = None
    if few is not None and _plain(few):
        return _scored_texts(df, ids, text, few, cleaned)
    hits = lookup_join(text_words(df, ids, text, cleaned), known, "term", max_rows=max_rows)
    entry = F.when(F.col("kind").isNotNull(), F.struct(F.col("_place").alias("pos"), "kind", "p", "s"))
    # All words of a text are in one task already; copies of it share their entries.
    rows = hits.groupBy("_text", *ids).agg(F.sort_array(F.collect_set(entry)).alias("_known"), copies())
    folded = rows.withColumn("_z", F.expr(f"aggregate(_known, {_START}, (z, w) -> {_STEP})"))

    def mean(total: str):
        return F.when(F.col("_z.n") == 0, F.lit(0.0)).otherwise(F.col(f"_z.{total}") / F.col("_z.n"))

    return each_copy(folded, ids, [mean("p").alias("polarity"), mean("s").alias("subjectivity")])
