"""Secret scan by grammar inference: probabilistic automata learned from credentials.

Three plain rules find and label credentials. For each kind, the labelled values and examples
of public formats form a prefix tree with counts; states whose outgoing frequencies are
statistically compatible (Hoeffding's bound, checked down the whole subtree) are merged,
so what is left is a small probabilistic automaton of that kind's format. Every other long
token of the corpus is a candidate: its likelihood under the automata is compared with
that under a background of character pairs counted over all candidates of all documents.
A candidate is reported where the odds, with the corpus' own share of credentials as
prior, are a hundred to one.
"""

from __future__ import annotations

import math
import random
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenfold.llm.common import stored, text_of

KINDS = ("assign", "access", "hex")
#: Characters of a token, and the least that a candidate has.
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_.=-"
SHORTEST = 16
#: The automata are fitted on so many distinct labelled values of a kind, those with the
#: smallest digests, of at most so many characters. Nothing else has a bound.
MAX_VALUES, LONGEST = 1024, 256
#: Of each public format, so many laid-out examples.
EXAMPLES = 128
#: One in so many merges of states with equal distributions is refused by the bound.
ALPHA = 0.05
#: Weight of what a state or the background has not seen.
UNSEEN, BACKED = 0.5, 16.0
#: Log odds above the prior at which a candidate is reported.
MARGIN = math.log(99)

# --- fixed values: the plain rules and public formats ---------------------------
_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
_ACCESS = re.compile(r"AKIA[A-Z0-9]{12,}")
_HEX = re.compile(r"[0-9a-f]{32,}")
_WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
ALNUM = ALPHABET[:62]
#: (kind, literal start, alphabet, length of the rest); parts of one format follow each other.
FORMATS = (
    ("assign", (("ghp_", ALNUM, 36),)),
    ("assign", (("sk_live_", ALNUM, 24),)),
    ("assign", (("AIza", ALNUM + "_-", 35),)),
    ("assign", (("glpat-", ALNUM + "_-", 20),)),
    ("assign", (("xoxb-", "0123456789", 12), ("-", "0123456789", 12), ("-", ALNUM, 24))),
    ("assign", (("eyJ", ALNUM, 33), (".eyJ", ALNUM, 60), (".", ALNUM + "_-", 43))),
    ("assign", (("", ALNUM + "+/", 40),)),
    ("access", (("AKIA", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", 16),)),
    ("access", (("ASIA", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", 16),)),
    ("hex", (("", "0123456789abcdef", 32),)),
    ("hex", (("", "0123456789abcdef", 40),)),
    ("hex", (("", "0123456789abcdef", 64),)),
    ("hex", (("", "0123456789ABCDEF", 40),)),
)


def examples(n: int = EXAMPLES, seed: int = 7) -> list[tuple[str, str]]:
    """(kind, value): ``n`` values of every public format."""
    rng = random.Random(seed)
    out = []
    for kind, parts in FORMATS:
        for _ in range(n):
            out.append((kind, "".join(start + "".join(rng.choices(letters, k=size)) for start, letters, size in parts)))
    return out


# ---- plain rules and candidates ---------------------------------------------


def labelled(text: str) -> list[tuple[int, int, str, str]]:
    """(start, end, kind, value) of the plain rules, leftmost and non-overlapping per kind.

    Shorter runs cannot match behind a failed longer one, so the least lengths of access
    and hex stand in their patterns."""
    found = []
    low = text.lower()
    if any(w in low for w in _WORDS):
        found += [(*m.span(), "assign", m[2]) for m in _ASSIGN.finditer(text) if len(m[2]) >= 8]
    if "AKIA" in text:
        found += [(*m.span(), "access", m[0]) for m in _ACCESS.finditer(text)]
    found += [(*m.span(), "hex", m[0]) for m in _HEX.finditer(text)]
    return sorted(found, key=lambda s: (s[0], KINDS.index(s[2])))


_TOKEN = re.compile(rf"[A-Za-z0-9+/_.=-]{{{SHORTEST},}}")


def candidates(text: str, found: list[tuple[int, int, str, str]]) -> list[tuple[int, int]]:
    """Spans of long tokens that lie in no span found so far, without the dots, equals signs
    and dashes at their ends; what gets too short by that is none."""
    out = []
    for m in _TOKEN.finditer(text):
        token = m[0].lstrip(".=-")
        start = m.end() - len(token)
        end = start + len(token.rstrip(".-"))
        if end - start >= SHORTEST and not any(a <= start and end <= b for a, b, _, _ in found):
            out.append((start, end))
    return out


# ---- automata ---------------------------------------------------------------


class Automaton:
    """States with the number of values that end there, and of those that leave by each
    character. State 0 is the first."""

    def __init__(self, values: list[str]):
        """The prefix tree of the values."""
        self.ends: list[int] = [0]
        self.leaves: list[dict[str, int]] = [{}]
        self.next: list[dict[str, int]] = [{}]
        for value in values:
            s = 0
            for c in value:
                t = self.next[s].get(c)
                if t is None:
                    t = len(self.ends)
                    self.ends.append(0)
                    self.leaves.append({})
                    self.next.append({})
                    self.next[s][c] = t
                self.leaves[s][c] = self.leaves[s].get(c, 0) + 1
                s = t
            self.ends[s] += 1

    def total(self, s: int) -> int:
        return self.ends[s] + sum(self.leaves[s].values())

    def compatible(self, a: int, b: int, bound: float) -> bool:
        """Whether the two states, and all that follow them alike, could be one."""
        todo = [(a, b)]
        while todo:
            a, b = todo.pop()
            if a == b:
                continue
            m, n = self.total(a), self.total(b)
            if not m or not n:
                continue
            most = bound * (m**-0.5 + n**-0.5)
            if abs(self.ends[a] / m - self.ends[b] / n) > most:
                return False
            one, two = self.leaves[a], self.leaves[b]
            if any(abs(one.get(c, 0) / m - two.get(c, 0) / n) > most for c in one.keys() | two.keys()):
                return False
            # What follows is compared where both have it.
            todo += [(self.next[a][c], t) for c, t in self.next[b].items() if c in self.next[a]]
        return True

    def merge(self, red: int, blue: int) -> None:
        """Make ``blue``, the root of a tree, part of ``red``, and its subtree with it."""
        todo = [(red, blue)]
        while todo:
            a, b = todo.pop()
            self.ends[a] += self.ends[b]
            for c, k in self.leaves[b].items():
                self.leaves[a][c] = self.leaves[a].get(c, 0) + k
            for c, t in self.next[b].items():
                if c in self.next[a]:
                    todo.append((self.next[a][c], t))
                else:
                    self.next[a][c] = t


def infer(values: list[str], alpha: float = ALPHA) -> Automaton:
    """Merge compatible states of the prefix tree, nearest to the root first.

    Settled states are pairwise incompatible. The next state to settle is the one most
    values pass, the one with the smallest path of equals; it is merged with the first settled
    state that it is compatible with, or settles itself. Equal values in any order give
    the same automaton.
    """
    tree = Automaton(sorted(values))
    bound = math.sqrt(0.5 * math.log(2 / alpha))
    settled = [0]
    while True:
        known = set(settled)
        open_states = [(-k, settled.index(s), c) for s in settled for c, k in tree.leaves[s].items() if tree.next[s][c] not in known]
        if not open_states:
            break
        _, at, c = min(open_states)
        parent = settled[at]
        blue = tree.next[parent][c]
        for red in settled:
            if tree.compatible(red, blue, bound):
                tree.next[parent][c] = red
                tree.merge(red, blue)
                break
        else:
            settled.append(blue)
    return _compact(tree, settled)


def _compact(tree: Automaton, settled: list[int]) -> Automaton:
    number = {s: i for i, s in enumerate(settled)}
    out = Automaton([])
    out.ends = [tree.ends[s] for s in settled]
    out.leaves = [dict(tree.leaves[s]) for s in settled]
    out.next = [{c: number[t] for c, t in tree.next[s].items()} for s in settled]
    return out


def tables(automaton: Automaton) -> tuple[np.ndarray, np.ndarray]:
    """(next state, log probability) by state and character code; column 0 is the end.

    A character or end that a state has not seen shares the weight ``UNSEEN``, and leads to
    one last state without a format, in which all are equally likely."""
    n, size = len(automaton.ends), len(ALPHABET) + 1
    step = np.full((n + 1, 128), n, dtype=np.int32)
    logs = np.full((n + 1, 128), -math.log(size))
    for s in range(n):
        total = automaton.total(s) + UNSEEN
        logs[s] = math.log(UNSEEN / size / total)
        logs[s, 0] = math.log((automaton.ends[s] + UNSEEN / size) / total)
        for c, k in automaton.leaves[s].items():
            logs[s, ord(c)] = math.log((k + UNSEEN / size) / total)
            step[s, ord(c)] = automaton.next[s][c]
    return step, logs


def likelihoods(tokens: list[str], step: np.ndarray, logs: np.ndarray) -> np.ndarray:
    """Log likelihood of every token, all tokens moving by one character at a time."""
    size = np.fromiter(map(len, tokens), np.int64, len(tokens))
    order = np.argsort(-size, kind="stable")
    code = np.frombuffer("".join(tokens[i] for i in order).encode("ascii"), dtype=np.uint8)
    length = size[order]
    start = np.concatenate(([0], np.cumsum(length)[:-1])) if len(length) else length
    state = np.zeros(len(tokens), dtype=np.int64)
    out = np.zeros(len(tokens))
    for j in range(int(length[0]) if len(length) else 0):
        live = int(np.searchsorted(-length, -j, side="left"))  # those longer than j
        c = code[start[:live] + j]
        s = state[:live]
        out[:live] += logs[s, c]
        state[:live] = step[s, c]
    out += logs[state, 0]
    back = np.empty(len(tokens))
    back[order] = out
    return back


# ---- background -------------------------------------------------------------

_CLASS = np.full(128, 3)
for _i, _letters in enumerate(("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz", "0123456789")):
    _CLASS[[ord(c) for c in _letters]] = _i
_CLASS[0] = 4


def background(pairs: list[tuple[int, int, int]]) -> tuple[np.ndarray, np.ndarray]:
    """Tables as those of an automaton, from counts of character pairs (before, after, n).

    Code 0 stands before the first character and after the last. A rare pair falls back to
    its pair of character classes, where a class that was never seen keeps to itself."""
    codes = [0, *sorted(map(ord, ALPHABET))]
    count = np.zeros((128, 128))
    for a, b, n in pairs:
        count[a, b] += n
    kinds = _CLASS[codes]
    classes = np.full((5, 5), 0.25)
    np.fill_diagonal(classes, 9.0)
    for a in codes:
        np.add.at(classes[_CLASS[a]], kinds, count[a, codes])
    classes /= classes.sum(axis=1, keepdims=True)
    members = np.bincount(kinds, minlength=5)
    logs = np.full((128, 128), -99.0)
    for a in codes:
        backed = classes[_CLASS[a], kinds] / members[kinds]
        logs[a, codes] = np.log((count[a, codes] + BACKED * backed) / (count[a, codes].sum() + BACKED))
    step = np.tile(np.arange(128), (128, 1))
    return step, logs


# ---- Spark ------------------------------------------------------------------

_SPAN = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])
_TOLD = pa.struct([("start", pa.int64()), ("end", pa.int64()), ("token", pa.string())])


def scanned(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Stored (doc_id, base, labels, candidates), one row per input row: spans of the plain
    rules, their (kind, value), and (start, end, token) of the candidates. Texts stay behind."""
    two = df.select(F.col(f"`{id_col}`").alias("doc_id"), text_of(text_col).alias("text"))
    kind = two.schema["doc_id"].dataType.simpleString()
    value = pa.struct([("kind", pa.string()), ("value", pa.string())])

    def run(batches):
        for batch in batches:
            base, labels, tokens = [], [], []
            for t in batch.column(1):
                text = t.as_py()
                found = labelled(text)
                base.append([{"kind": k, "start": a, "end": b} for a, b, k, _ in found])
                labels.append([{"kind": k, "value": v} for _, _, k, v in found])
                tokens.append([{"start": a, "end": b, "token": text[a:b]} for a, b in candidates(text, found)])
            columns = [batch.column(0), pa.array(base, pa.list_(_SPAN)), pa.array(labels, pa.list_(value)), pa.array(tokens, pa.list_(_TOLD))]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "base", "labels", "candidates"])

    lists = "base array<struct<kind:string,start:bigint,end:bigint>>, labels array<struct<kind:string,value:string>>"
    return stored(two.mapInArrow(run, f"doc_id {kind}, {lists}, candidates array<struct<start:bigint,end:bigint,token:string>>"))


def _pairs(batches):
    """Counts of character pairs in the tokens of one task: at most 68 * 68 rows."""
    count = np.zeros((128, 128), dtype=np.int64)
    for batch in batches:
        told = batch.column(0).to_pylist()
        text = "".join("\0" + t for t in told)
        if text:
            code = np.frombuffer((text + "\0").encode("ascii"), dtype=np.uint8)
            count += np.bincount(code[:-1].astype(np.int64) * 128 + code[1:], minlength=128 * 128).reshape(128, 128)
    a, b = np.nonzero(count)
    yield pa.RecordBatch.from_arrays([pa.array(a, pa.int32()), pa.array(b, pa.int32()), pa.array(count[a, b], pa.int64())], names=["a", "b", "n"])


def learn(found: DataFrame) -> tuple[dict[str, tuple[np.ndarray, np.ndarray]], tuple[np.ndarray, np.ndarray], float]:
    """The automata by kind, the background, and the log odds from which a candidate is reported.

    ``found`` comes from ``scanned``. The driver gets at most ``MAX_VALUES`` values of a kind,
    and the counts of character pairs, a table of fixed size.
    """
    labels = found.select(F.explode("labels").alias("x")).select("x.kind", "x.value")
    values = stored(labels.groupBy("kind", "value").agg(F.count(F.lit(1)).alias("n")))
    shown = examples()
    machines = {}
    for kind in KINDS:
        some = values.filter((F.col("kind") == kind) & (F.length("value") <= LONGEST))
        some = some.orderBy(F.sha2("value", 256), "value").limit(MAX_VALUES).select("value").collect()
        machines[kind] = tables(infer([r.value for r in some] + [v for k, v in shown if k == kind]))
    tokens = found.select(F.explode("candidates.token").alias("token"))
    pairs = tokens.mapInArrow(_pairs, "a int, b int, n long").groupBy("a", "b").agg(F.sum("n").alias("n")).collect()
    many = sum(r.n for r in pairs if r.a == 0)
    known = values.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    odds = math.log((many + 1) / (known + 1)) + MARGIN
    return machines, background([tuple(r) for r in pairs]), max(odds, MARGIN)


def judge(tokens: list[str], machines, ground) -> list[tuple[str, float]]:
    """The likeliest kind of every token and its log odds against the background."""
    if not tokens:
        return []
    ordinary = likelihoods(tokens, *ground)
    each = np.stack([likelihoods(tokens, *machines[k]) - ordinary for k in KINDS])
    best = each.argmax(axis=0)
    return [(KINDS[k], float(each[k, i])) for i, k in enumerate(best)]


def report(found: DataFrame, model) -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, base, spans) for ``scanned`` rows."""
    machines, ground, odds = model
    kind = found.schema["doc_id"].dataType.simpleString()

    def run(batches) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            base = batch.column(1).to_pylist()
            told = batch.column(2).to_pylist()
            verdicts = iter(judge([c["token"] for row in told for c in row], machines, ground))
            spans, counts = [], []
            for plain, row in zip(base, told, strict=True):
                more = [{"kind": k, "start": c["start"], "end": c["end"]} for c, (k, score) in zip(row, verdicts) if score > odds]
                spans.append(sorted(plain + more, key=lambda s: (s["start"], KINDS.index(s["kind"]), s["end"])))
                counts.append([sum(s["kind"] == k for s in plain) for k in KINDS])
            numbers = [pa.array([c[i] for c in counts], pa.int64()) for i in range(len(KINDS))]
            names = ["doc_id", *(f"n_{k}" for k in KINDS), "base", "spans"]
            yield pa.RecordBatch.from_arrays([batch.column(0), *numbers, batch.column(1), pa.array(spans, pa.list_(_SPAN))], names=names)

    lists = "array<struct<kind:string,start:bigint,end:bigint>>"
    longs = ", ".join(f"n_{k} long" for k in KINDS)
    return found.select("doc_id", "base", "candidates").mapInArrow(run, f"doc_id {kind}, {longs}, base {lists}, spans {lists}")


def find(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: ``doc_id``, the counts ``n_assign, n_access, n_hex`` of the plain
    rules, ``base`` and ``spans`` as arrays of (kind, start, end) in code points, end exclusive.

    ``spans`` are the base spans and the candidates that the automata report. NULL is an
    empty text and has none; repeated rows and ids stay apart; an empty table gives no
    rows. Other columns are not read.
    """
    found = scanned(df, id_col, text_col)
    return report(found, learn(found))
