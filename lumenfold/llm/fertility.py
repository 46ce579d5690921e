"""Quality rules from tokeniser fertility, with rejection bands per language or script.

A public vocabulary with byte fallback reads every whole text, word by word. Three measures
come out: characters per token, the share of byte-fallback tokens, and the entropy of the
token distribution in bits. What is usual depends on the language and on the length, so
bands are set per language (per script, where no language is given) and per power of two of
the token count, around the quartiles over all documents. Quartiles are read from
histograms with fixed bins: counts add up in any order, so reruns agree.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lumenfold.llm.common import hot_join, stored, text_of
from lumenfold.llm.tokens import CHUNKS, public_path

BLANKS = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
MIN_WORDS = 50
#: Measures: histogram bin, and how many quartile distances the band reaches down and up.
BANDS = {
    "chars_per_token": (0.01, 9.0, 12.0),
    "byte_share": (0.002, None, 12.0),
    "entropy": (0.02, 5.0, 12.0),
}
#: Documents that a language and length needs for a band of its own. Below it entropy,
#: which depends on the length, goes by the length over all languages; the other measures,
#: which depend on the language, by the language over all lengths, then by the script. Where
#: these have fewer documents too, the band is that of all documents.
LEAST = 50
SCRIPTS = ("Latin", "Cyrillic", "Greek", "Arabic", "Hebrew", "Devanagari", "Han", "Hiragana", "Katakana", "Hangul", "Thai")
_SCRIPT = [(s, regex.compile(rf"\p{{{s}}}")) for s in SCRIPTS]


_LETTERS = bytes(range(65, 91)) + bytes(range(97, 123))
_NO_LETTERS = bytes(set(range(256)) - set(_LETTERS))
_ASCII = bytes(range(128))


def script(text: str) -> str:
    """The script with the most characters; the first listed of equals, Other if none."""
    data = text.encode("utf-8")
    rest = "" if text.isascii() else data.translate(None, _ASCII).decode("utf-8")
    counts = [(len(p.findall(rest)) if rest else 0, -i, s) for i, (s, p) in enumerate(_SCRIPT)]
    counts[0] = (counts[0][0] + len(data.translate(None, _NO_LETTERS)), *counts[0][1:])  # Latin
    best = max(counts)
    return best[2] if best[0] else "Other"


def repeated_words(words: list[bytes]) -> int:
    """Words inside three-word windows that the text has twice or more."""
    n = len(words) - 2
    if n < 2:
        return 0
    windows = list(zip(words, words[1:], words[2:]))
    if len(set(windows)) == n:
        return 0  # as most texts
    count = Counter(windows)
    again = np.fromiter((count[w] > 1 for w in windows), dtype=bool, count=n)
    covered = np.zeros(len(words), dtype=bool)
    for k in range(3):
        covered[k : k + n] |= again
    return int(covered.sum())


def repeated_lines(text: str) -> int:
    """Lines with a word that equal an earlier line."""
    seen, n = set(), 0
    for line in text.split("\n"):
        if line.strip(BLANKS):
            n += line in seen
            seen.add(line)
    return n


#: Words that surely are one run of pieces each: letters, digits and marks of Latin scripts.
_SIMPLE = re.compile("[!-~¡-¬®-ɏ]+")


class Fertility:
    """Measures of one text after another with a ``sentencepiece`` vocabulary.

    A piece never crosses a blank, so a text's ids are those of its words. Words repeat: each
    new one is encoded once, together with all other new words of the text, and the ids are
    cut where a piece starts a word.
    """

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        size = self.model.get_piece_size()
        self.is_byte = np.array([self.model.is_byte(i) for i in range(size)])
        self.starts = np.array([self.model.id_to_piece(i).startswith("\u2581") for i in range(size)])
        self.words: dict[bytes, bytes] = {}

    def _encode(self, text: str) -> np.ndarray:
        return np.array(self.model.encode(text), dtype="<u4")

    def _learn(self, new: list[bytes]) -> None:
        texts = [w.decode("utf-8") for w in new]
        simple = [w for w, t in zip(new, texts, strict=True) if _SIMPLE.fullmatch(t)]
        if simple:
            ids = self._encode(b" ".join(simple).decode("utf-8"))
            cuts = [*(4 * np.flatnonzero(self.starts[ids])).tolist(), 4 * len(ids)]
            if len(cuts) == len(simple) + 1 and cuts[0] == 0:
                data = ids.tobytes()
                self.words.update((w, data[a:b]) for w, a, b in zip(simple, cuts, cuts[1:], strict=False))
        for w, t in zip(new, texts, strict=True):
            if w not in self.words:
                self.words[w] = self._encode(t).tobytes()

    def ids(self, words: list[bytes]) -> np.ndarray:
        if len(self.words) > CHUNKS:
            self.words.clear()
        if new := [w for w in dict.fromkeys(words) if w not in self.words]:
            self._learn(new)
        return np.frombuffer(b"".join(map(self.words.__getitem__, words)), dtype="<u4")

    def measure(self, words: list[bytes], chars: int) -> tuple[int, float, float, float]:
        """Tokens, characters per token, byte-fallback share, entropy; zeros without words."""
        if not words:
            return 0, 0.0, 0.0, 0.0
        ids = self.ids(words)
        count = np.bincount(ids)
        count = count[count > 0] / len(ids)
        entropy = float(-(count * np.log2(count)).sum()) + 0.0
        return len(ids), chars / len(ids), float(self.is_byte[ids].mean()), entropy


def measures(
    df: DataFrame, vocabulary: str | None = None, id_col="doc_id", text_col="text", lang_col="lang"
) -> DataFrame:
    """One row per input row: the counts of the base rules, the tokens and the three
    measures, ``script``, and ``band``, the language or else the script. NULL is an empty text."""
    three = df.select(
        F.col(f"`{id_col}`").alias("doc_id"),
        text_of(text_col).alias("text"),
        F.nullif(F.trim(F.col(f"`{lang_col}`").cast("string")), F.lit("")).alias("lang"),
    )
    kind = three.schema["doc_id"].dataType.simpleString()
    names = "n_words word_chars n_symbols n_dup_lines n_repeat_words tokens".split()
    floats = list(BANDS)

    def run(batches):
        gauge = Fertility(vocabulary or public_path("piece_bpe_32k.model"))
        for batch in batches:
            rows = []
            for t, lang in zip(batch.column(1), batch.column(2).to_pylist(), strict=True):
                text = t.as_py() or ""
                words = text.encode("utf-8").split()
                chars = len(text) - sum(map(text.count, BLANKS))
                rows.append(
                    (
                        len(words),
                        chars,
                        sum(map(text.count, SYMBOLS)),
                        repeated_lines(text),
                        repeated_words(words),
                        *gauge.measure(words, chars),
                        (of := script(text)),
                        lang or of,
                    )
                )
            columns = list(zip(*rows, strict=True)) or [()] * 11
            kinds = [pa.int64()] * 6 + [pa.float64()] * 3 + [pa.string()] * 2
            arrays = [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *arrays], names=["doc_id", *names, *floats, "script", "band"])

    schema = f"doc_id {kind}, " + ", ".join([f"{n} long" for n in names] + [f"{n} double" for n in floats])
    return three.mapInArrow(run, schema + ", script string, band string")


def bands(measured: DataFrame) -> DataFrame:
    """Stored (level, band, size, n, low and high of each measure).

    Levels: ``own`` per band and size, ``lang`` per band, ``script`` per script (in column
    ``band``), ``size`` per size, ``all``. ``size`` is the whole part of log2 of the token count.
    The rows are few: one for each language and power of two. Texts without tokens set no
    band.
    """
    bins = F.array(
        *(
            F.struct(F.lit(m).alias("measure"), F.floor(F.col(m) / b + 0.5).alias("bin"))
            for m, (b, _, _) in BANDS.items()
        )
    )
    long = measured.filter("tokens > 0").select("band", "script", "size", F.explode(bins).alias("x"))
    cells = stored(long.groupBy("band", "script", "size", "x.measure", "x.bin").agg(F.count(F.lit(1)).alias("k")))
    none = F.lit(None)
    levels = {
        "own": (F.col("band"), F.col("size")),
        "lang": (F.col("band"), none.cast("int")),
        "script": (F.col("script"), none.cast("int")),
        "size": (none.cast("string"), F.col("size")),
        "all": (none.cast("string"), none.cast("int")),
    }
    hist = None
    for level, (band, size) in levels.items():
        part = cells.groupBy(F.lit(level).alias("level"), band.alias("band"), size.alias("size"), "measure", "bin").agg(F.sum("k").alias("k"))
        hist = part if hist is None else hist.unionByName(part)
    key = ("level", "band", "size")
    cell = Window.partitionBy(*key, "measure")
    run = cell.orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    told = hist.withColumns({"upto": F.sum("k").over(run), "of": F.sum("k").over(cell)})
    quart = [F.min(F.when(F.col("upto") * 4 >= q * F.col("of"), F.col("bin"))).alias(f"q{q}") for q in (1, 2, 3)]
    quartiles = told.groupBy(*key, "measure").agg(F.max("of").alias("n"), *quart)
    out = []
    for m, (b, down, up) in BANDS.items():
        here = F.col("measure") == m
        # The quieter side may hold the junk: the low bound goes by the upper quartile.
        above = F.greatest(F.col("q3") - F.col("q2"), F.lit(1))
        below = F.greatest(F.col("q2") - F.col("q1"), above)
        low = (F.col("q2") - down * above) * b if down else F.lit(-1.0)
        high = (F.col("q2") + up * below) * b
        out += [F.max(F.when(here, low)).alias(f"{m}_low"), F.max(F.when(here, high)).alias(f"{m}_high")]
    return stored(quartiles.groupBy(*key).agg(F.max("n").alias("n"), *out))


def quality(df: DataFrame, vocabulary: str | None = None, id_col="doc_id", text_col="text", lang_col="lang") -> DataFrame:
    """The measures with ``base_failed`` and ``kept``, one row per input row.

    A text fails the base rules with fewer than 50 words or with more than half of its
    words in repeated windows. It is kept if it does not, and if every measure lies within
    its band. NULL and empty texts have no words and fail. NULL and repeated ids are kept
    as they are, and an empty table gives no rows. A table without the language column is
    judged by script.
    """
    if lang_col.lower() not in (c.lower() for c in df.columns):
        df = df.withColumn(lang_col, F.lit(None).cast("string"))
    got = measures(df, vocabulary, id_col, text_col, lang_col)
    got = stored(got.withColumn("size", F.when(F.col("tokens") > 0, F.floor(F.log2("tokens"))).cast("int")))
    known = bands(got)
    edges = [f"{m}_{side}" for m in BANDS for side in ("low", "high")]

    def at(level: str, *key) -> DataFrame:
        renamed = [F.col(e).alias(f"{level}_{e}") for e in edges]
        return known.filter(F.col("level") == level).select(*key, F.col("n").alias(f"{level}_n"), *renamed)

    own = stored(at("own", "band", "size").withColumn("n", F.col("own_n")))
    lang = stored(at("lang", "band").withColumn("n", F.col("lang_n")))
    met = hot_join(hot_join(got, own, ["band", "size"], "n"), lang, ["band"], "n")
    met = met.join(F.broadcast(at("script", F.col("band").alias("script"))), "script", "left")  # a row per script
    met = met.join(F.broadcast(at("size", "size")), "size", "left")  # a row per power of two
    whole = known.filter("level = 'all'").first()  # one row, if any document has tokens
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    inside = F.lit(True)
    for m in BANDS:
        chain = ("own", "size") if m == "entropy" else ("own", "lang", "script")
        ends = []
        for side in ("low", "high"):
            end = F.lit(whole[f"{m}_{side}"] if whole else None)
            for level in reversed(chain):
                end = F.when(F.col(f"{level}_n") >= LEAST, F.col(f"{level}_{m}_{side}")).otherwise(end)
            ends.append(end)
        inside &= F.coalesce(F.col(m).between(*ends), F.lit(True))  # no tokens, no measure
    met = met.withColumn("base_failed", failed).withColumn("kept", ~failed & inside)
    return met.select(*(c for c in got.columns if c != "size"), "base_failed", "kept")
