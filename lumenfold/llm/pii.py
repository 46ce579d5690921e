"""Personal data with offset-preserving deobfuscation.

Base rules find plain identifiers. A transducer then rewrites the text into a normal form
and notes for every character it writes the source span it came from: look-alike letters
and full-width forms become ASCII, invisible characters vanish, spelled digits become
digits, "(at)" and "dot" become @ and a dot. The rules run again over the rewritten text,
and what they find is mapped back through the notes to spans of the source.

Every rule is anchored at a character that cannot be skipped (@, a run of digits, +) and
bounded by it, so the time is linear in the text.
"""

from __future__ import annotations

import re
import unicodedata

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenfold.llm.common import text_of

KINDS = ("email", "ip", "card", "phone")

# The base rules. A dotted run that is no address leaves no later start inside itself, so a
# match may only start where a run of digits does.
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = re.compile(r"[A-Za-z0-9._%+-]+\Z")
_LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def emails(text: str) -> list[tuple[int, int]]:
    """Leftmost matches of local part, @ and dotted domain; each starts at the first
    character of the local part that no earlier match has taken."""
    out, free = [], 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in _LOCAL_CHARS:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            out.append((start, m.end()))
            free = m.end()
        at = text.find("@", max(at + 1, free))
    return out


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def small(part: str) -> bool:
    """Is a decimal number of any length at most 255?"""
    part = part.lstrip("0")
    return len(part) < 4 and int(part or "0") <= 255


def ips(text: str) -> list[tuple[int, int]]:
    return [m.span() for m in _IP.finditer(text) if all(small(p) for p in m[0].split("."))]


def cards(text: str) -> list[tuple[int, int]]:
    out = []
    for m in _CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 14 <= len(digits) <= 19 and luhn(digits):
            out.append(m.span())
    return out


def phones(text: str) -> list[tuple[int, int]]:
    return [m.span() for m in _PHONE.finditer(text) if 10 <= sum("0" <= c <= "9" for c in m[0]) <= 15]


RULES = {"email": emails, "ip": ips, "card": cards, "phone": phones}


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the base rules, by start and then kind as listed."""
    found = []
    if "@" in text:
        found += [(a, b, "email") for a, b in emails(text)]
    if _DIGITS.search(text):
        for kind in KINDS[1:]:
            found += [(a, b, kind) for a, b in RULES[kind](text)]
    return sorted(found, key=lambda s: (s[0], KINDS.index(s[2])))


# ---- the transducer ---------------------------------------------------------

# Letters of other alphabets that look like Latin ones (Cyrillic, Greek capitals,
# Greek small, Armenian, Cherokee).
_LOOKALIKES = dict(
    zip(
        "АВЕЅІЈКМНОРСТУХаеѕіјорсухԁԛԝһЬԌԍѵґԚԜ" + "ΑΒΕΖΗΙΚΜΝΟΡΤΥΧϹ" + "αγηικνορστυχωϲϳ" + "օսհոցզյՕՍԼ" + "ᎠᎡᎢᎫᎬᎳᎷᎻᏀᏃᏞᏟᏢᏦᏴᏙᏚᏒᎪ",
        "ABESIJKMHOPCTYXaesijopcyxdqwhbGgvrQW" + "ABEZHIKMNOPTYXC" + "aynikvopotuxwcj" + "ouhngqjOUL" + "DRTJEWMHGZLCPKBVSRA",
        strict=True,
    )
)
# Latin small capitals, by their names.
_LOOKALIKES |= {
    chr(c): name[-1].lower()
    for c in (*range(0x1D00, 0x1D23), *range(0x0250, 0x02B0), *range(0xA730, 0xA732))
    if re.fullmatch("LATIN LETTER SMALL CAPITAL [A-Z]", name := unicodedata.name(chr(c), ""))
}
_INVISIBLE = frozenset("­​‌‍‎‏⁠⁡⁢⁣⁤﻿᠎")
_DIGITS = re.compile(r"[0-9]")
# Spelled digits in the languages of the corpus.
_SPELLED = {
    w: str(d % 10)
    for words in (
        "zero one two three four five six seven eight nine",
        "null eins zwei drei vier fünf sechs sieben acht neun",
        "zéro un deux trois quatre cinq six sept huit neuf",
        "cero uno dos tres cuatro cinco seis siete ocho nueve",
    )
    for d, w in enumerate(words.split())
} | {"oh": "0", "ein": "1", "zwo": "2"}
_AT_WORDS, _DOT_WORDS = "at|arroba|arobase|ät", "dot|punkt|punto|point"
_OPEN, _CLOSE = r"[\[({<]", r"[\])}>]"
#: A disguised @ in brackets.
_AT_BOXED = re.compile(rf"[\x20]?{_OPEN}[\x20]?(?:@|(?:{_AT_WORDS}))[\x20]?{_CLOSE}[\x20]?", re.I)
_DOT_BOXED = re.compile(rf"[\x20]?{_OPEN}[\x20]?(?:\.|(?:{_DOT_WORDS}))[\x20]?{_CLOSE}[\x20]?", re.I)
#: Words or spaced signs between words: "name at host dot com", "name @ host . com".
_DOT_BETWEEN = re.compile(rf"[\x20_-](?:{_DOT_WORDS}|\.)[\x20_-]", re.I)
_JOIN = rf"(?:\.|{_DOT_BETWEEN.pattern})"
_PLAIN = re.compile(
    rf"(?<![A-Za-z0-9._%+-])(?P<local>[A-Za-z0-9][A-Za-z0-9_%+-]{{0,63}}(?:{_JOIN}[A-Za-z0-9_%+-]{{1,63}}){{0,4}})"
    rf"(?P<at>[\x20_-](?:{_AT_WORDS})[\x20_-]|[\x20]?@[\x20]?)"
    rf"(?P<host>[A-Za-z0-9][A-Za-z0-9-]{{0,62}}(?:{_JOIN}[A-Za-z0-9-]{{1,62}}){{0,3}}{_JOIN}[A-Za-z]{{2,63}})(?![A-Za-z0-9@])",
    re.I,
)
_WORD_DIGIT = "|".join(sorted(_SPELLED, key=len, reverse=True))
#: Four digits or more in a row of which some are spelled; signs of numbers may stand between.
_NUMBER = re.compile(
    rf"(?<!\w)(?:(?:\+|plus[\x20])[\x20]?)?(?:{_WORD_DIGIT}|[0-9]+)(?:(?:[\x20,.-]{{1,2}}|[\x20](?:{_DOT_WORDS}|dash|minus)[\x20])(?:{_WORD_DIGIT}|[0-9]+)){{3,}}(?!\w)",
    re.I,
)
_NUMBER_PART = re.compile(rf"(?P<digit>(?<!\w)(?:{_WORD_DIGIT})(?!\w))|(?P<plus>(?<!\w)plus(?!\w)[\x20]?)|(?P<dot>[\x20](?:{_DOT_WORDS})[\x20])|(?P<dash>[\x20](?:dash|minus)[\x20])", re.I)


class Tape:
    """A text with the source span of each of its characters."""

    def __init__(self, text: str, start: list[int] | None = None, end: list[int] | None = None):
        self.text = text
        self.start = start if start is not None else list(range(len(text)))
        self.end = end if end is not None else list(range(1, len(text) + 1))

    def rewrite(self, edits: list[tuple[int, int, str]]) -> Tape:
        """Replace disjoint, sorted spans. What is written spans all it stands for."""
        if not edits:
            return self
        text, start, end, at = [], [], [], 0
        for a, b, new in edits:
            text += [self.text[at:a], new]
            start += self.start[at:a] + [self.start[a]] * len(new)
            end += self.end[at:a] + [self.end[b - 1]] * len(new)
            at = b
        text.append(self.text[at:])
        return Tape("".join(text), start + self.start[at:], end + self.end[at:])

    def source(self, a: int, b: int) -> tuple[int, int]:
        return self.start[a], self.end[b - 1]


def _fold(c: str) -> str:
    """ASCII for a look-alike, '' for an invisible character, else the character."""
    if c in _INVISIBLE:
        return ""
    if c in _LOOKALIKES:
        return _LOOKALIKES[c]
    if unicodedata.category(c) == "Nd":
        return str(unicodedata.decimal(c))
    plain = unicodedata.normalize("NFKC", c)
    return plain if len(plain) == 1 and plain.isascii() else c


_ODD = re.compile(r"[^\x00-\x7f¡-¬®-ɏ]")


def normalise(text: str) -> Tape:
    """The tape after all rewriting steps."""
    tape = Tape(text)
    tape = tape.rewrite([(m.start(), m.end(), new) for m in _ODD.finditer(text) if (new := _fold(m[0])) != m[0]])
    boxed = sorted([(m.start(), m.end(), "@") for m in _AT_BOXED.finditer(tape.text)] + [(m.start(), m.end(), ".") for m in _DOT_BOXED.finditer(tape.text)])
    kept, free = [], 0
    for a, b, new in boxed:
        if a >= free:
            kept.append((a, b, new))
            free = b
    tape = tape.rewrite(kept)
    edits = []
    for m in _PLAIN.finditer(tape.text):
        dots = [(m.start(part) + d.start(), m.start(part) + d.end(), ".") for part in ("local", "host") for d in _DOT_BETWEEN.finditer(m[part])]
        # A plain "at" needs a disguised dot in the host, or it is a word of the text.
        if "@" in m["at"] or any(a >= m.start("host") for a, _, _ in dots):
            edits += sorted([*dots, (*m.span("at"), "@")])
    tape = tape.rewrite(edits)
    edits = []
    for m in _NUMBER.finditer(tape.text):
        for p in _NUMBER_PART.finditer(m[0]):
            new = _SPELLED[p[0].lower()] if p["digit"] else {"plus": "+", "dot": ".", "dash": "-"}[p.lastgroup]
            edits.append((m.start() + p.start(), m.start() + p.end(), new))
    tape = tape.rewrite(edits)
    # Digits that were spelled stand apart; close the gaps between them.
    if edits:
        gaps = re.compile(r"(?<=[0-9])[\x20,](?=[0-9])")
        wrote = set()
        for i, (a, b) in enumerate(zip(tape.start, tape.end, strict=True)):
            if b - a > 1:
                wrote.add(i)
        tape = tape.rewrite([(g.start(), g.end(), "") for g in gaps.finditer(tape.text) if g.start() - 1 in wrote or g.end() in wrote])
    return tape


#: Matches wherever ``normalise`` changes a text: its first two steps are listed as they are;
#: the third writes at a spaced @ or a dot between words; the fourth at such a dot, at
#: "plus" before a digit, at "dash" or "minus" before one, or at a spelled digit, which has a
#: digit on one side. Digits may be spelled; what ends a digit is no letter.
_ANY_DIGIT = rf"(?:(?:{_WORD_DIGIT})(?!\w)|[0-9])"
_HINT = re.compile(
    rf"(?-i:{_ODD.pattern})|{_OPEN}[\x20]?(?:@|{_AT_WORDS}|\.|{_DOT_WORDS})[\x20]?{_CLOSE}|[\x20_-](?:{_DOT_WORDS}|\.)[\x20_-]|[\x20]@|@[\x20]"
    rf"|(?<!\w)(?:plus[\x20]{{1,2}}{_ANY_DIGIT}|(?:{_WORD_DIGIT})[\x20,.-]{{1,2}}{_ANY_DIGIT})|[\x20](?:dash|minus)[\x20]{_ANY_DIGIT}|[0-9][\x20,.-]{{1,2}}(?:{_WORD_DIGIT})(?!\w)",
    re.I,
)


def spans(text: str) -> list[tuple[int, int, str]]:
    """All spans: those of the base rules, and those of the rewritten text that do not lie
    inside another span of their kind. An identifier disguised in one part has both: its
    plain part as a base span, and the whole."""
    found = base_spans(text)
    if not _HINT.search(text):
        return found
    tape = normalise(text)
    if tape.text == text:
        return found
    taken = {k: [(a, b) for a, b, kind in found if kind == k] for k in KINDS}
    for a, b, kind in base_spans(tape.text):
        lo, hi = tape.source(a, b)
        if not any(x <= lo and hi <= y for x, y in taken[kind]):
            found.append((lo, hi, kind))
            taken[kind].append((lo, hi))
    return sorted(set(found), key=lambda s: (s[0], KINDS.index(s[2]), s[1]))


def listed(found: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{kind}:{a}:{b}" for a, b, kind in found)


def find(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: ``doc_id``, the base counts ``n_email, n_ip, n_card, n_phone``,
    ``base`` and ``spans`` as arrays of (kind, start, end) in code points, end exclusive.

    NULL is an empty text and has none. Other columns are not read.
    """
    two = df.select(F.col(f"`{id_col}`").alias("doc_id"), text_of(text_col).alias("text"))
    kind = two.schema["doc_id"].dataType.simpleString()
    span = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])

    def run(batches):
        for batch in batches:
            base, every, counts = [], [], []
            for t in batch.column(1):
                text = t.as_py() or ""
                plain = base_spans(text)
                base.append([{"kind": k, "start": a, "end": b} for a, b, k in plain])
                every.append([{"kind": k, "start": a, "end": b} for a, b, k in spans(text)])
                counts.append([sum(s[2] == k for s in plain) for k in KINDS])
            numbers = [pa.array([c[i] for c in counts], pa.int64()) for i in range(len(KINDS))]
            lists = [pa.array(x, pa.list_(span)) for x in (base, every)]
            names = ["doc_id", *(f"n_{k}" for k in KINDS), "base", "spans"]
            yield pa.RecordBatch.from_arrays([batch.column(0), *numbers, *lists], names=names)

    lists = "array<struct<kind:string,start:bigint,end:bigint>>"
    longs = ", ".join(f"n_{k} long" for k in KINDS)
    return two.mapInArrow(run, f"doc_id {kind}, {longs}, base {lists}, spans {lists}")


def redact(text: str, mark: str = "[{}]") -> str:
    """The text with every span replaced by its kind. Overlapping spans are replaced as
    one, by the kind of the longest, the first one among equals."""
    merged: list[tuple[int, int, int, str]] = []  # start, end, length of the longest, its kind
    for a, b, kind in spans(text):
        if merged and a < merged[-1][1]:
            start, end, most, named = merged.pop()
            merged.append((start, max(end, b), *((b - a, kind) if b - a > most else (most, named))))
        else:
            merged.append((a, b, b - a, kind))
    out, at = [], 0
    for a, b, _, kind in merged:
        out += [text[at:a], mark.format(kind.upper())]
        at = b
    return "".join(out) + text[at:]
