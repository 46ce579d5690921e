"""Repair of the structure of conversations by a checkpointed dynamic program.

A conversation's rows are kept, given another role, deleted or joined by inserted rows
until the initials of its roles read ``(s?(ua)+)?``. Four states follow that pattern, and
the least cost to finish from each of them, the vector before a row, is computed from the
last row back. Vectors are stored at checkpoints only: a forward walk starts at the first
row, recomputes the vectors of one stretch between checkpoints at a time, and emits at
every step the ASCII-least edit that is tight, that is, still reaches the least cost.

Rows are sorted by range over all tasks and cut into cells of 4,096 rows, so a conversation
may be of any length. What a cell does to a vector is a matrix of four by four least costs;
a scan of these matrices gives the vector at the end of each cell, the checkpoints that
tasks share. Then every cell walks for itself, from each state it may be entered in, and a
second scan tells which one that is. Inside a cell checkpoints lie 64 rows apart.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from itertools import pairwise

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenfold.llm.common import blocks, hot_join, ranked, stored

#: Bits of a row number inside a cell, and rows between two checkpoints of a cell.
CELL_BITS = 12
STRIDE = 64
#: Cells or groups of cells that one step of a scan takes together.
FAN = 512
BLANKS = " \t\n\x0b\x0c\r"
NEVER = 10**15
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 1, 2, 5, 5
#: Faults of a row.
SOUND, IS_BLANK, IS_DUPLICATE, IS_TRUNCATED = range(4)
#: States: nothing yet, after the system row, after a user row, after an assistant row.
START, SYSTEM, USER, ASSISTANT = range(4)
#: The state after the role that the pattern asks for next, and that role.
NEXT = (USER, USER, ASSISTANT, USER)
ASKS = ("user", "user", "assistant", "user")
#: The state after keeping a row, by its initial.
KEPT = {"s": (SYSTEM, None, None, None), "u": (USER, USER, None, USER), "a": (None, None, ASSISTANT, None)}
NOT_KEPT = (None, None, None, None)


# ---- the program on rows (initial, fault) -----------------------------------


def inserted(base: list[int]) -> list[int]:
    """The vector with rows inserted first; more than two are never worth it."""
    user = min(base[USER], INSERT + base[ASSISTANT])
    assistant = min(base[ASSISTANT], INSERT + base[USER])
    return [min(base[START], INSERT + user), min(base[SYSTEM], INSERT + user), user, assistant]


#: The vector after the last row of a conversation.
END = inserted([0, NEVER, NEVER, 0])


def before(row: tuple[str, int], after: list[int]) -> list[int]:
    """The vector before a row, from the one after it."""
    initial, fault = row
    out = [DELETE + v for v in after]
    if fault not in (IS_BLANK, IS_DUPLICATE):
        extra = TRUNCATED if fault == IS_TRUNCATED else 0
        kept = KEPT.get(initial, NOT_KEPT)
        for s in range(4):
            out[s] = min(out[s], REROLE + extra + after[NEXT[s]])
            if kept[s] is not None:
                out[s] = min(out[s], KEEP + extra + after[kept[s]])
    return inserted(out)


def matrix(rows: list[tuple[str, int]]) -> list[int]:
    """Least costs through the rows, from each state before to each state after, by rows."""
    columns = []
    for t in range(4):
        v = [0 if s == t else NEVER for s in range(4)]
        for row in reversed(rows):
            v = before(row, v)
        columns.append([min(x, NEVER) for x in v])
    return [columns[t][s] for s in range(4) for t in range(4)]


def through(m: list[int], after: list[int]) -> list[int]:
    """The vector before what the matrix stands for."""
    return [min(m[4 * s + t] + after[t] for t in range(4)) for s in range(4)]


def joined(ms: list[list[int]]) -> list[int]:
    """The matrix of consecutive parts."""
    out = ms[-1]
    for m in reversed(ms[:-1]):
        columns = [through(m, out[t::4]) for t in range(4)]
        out = [min(columns[t][s], NEVER) for s in range(4) for t in range(4)]
    return out


def walk(rows: list[tuple[str, int]], after: list[int], entered: list[int], last: bool) -> tuple[int, list[str], list[int]]:
    """Least cost from state 0, and for each state that the rows may be entered in the
    edits and the state after them.

    ``after`` is the vector after the rows; ``last`` says that nothing follows, so that
    rows may be inserted behind. Of the vectors one in ``STRIDE`` is stored.
    """
    n = len(rows)
    checkpoints = {-(-n // STRIDE): after}
    v = after
    for i in range(n - 1, -1, -1):
        v = before(rows[i], v)
        if i % STRIDE == 0:
            checkpoints[i // STRIDE] = v
    cost = v[START]
    states = list(entered)
    edits: list[list[str]] = [[] for _ in states]
    for b in range(-(-n // STRIDE)):
        part = rows[b * STRIDE : (b + 1) * STRIDE]
        vectors = [checkpoints.pop(b + 1)]
        for row in reversed(part):
            vectors.append(before(row, vectors[-1]))
        vectors.reverse()
        for k, s in enumerate(states):
            out = edits[k]
            for j, (initial, fault) in enumerate(part):
                now, then = vectors[j], vectors[j + 1]
                extra = TRUNCATED if fault == IS_TRUNCATED else 0
                # The edits in ASCII order: D, I, K, R.
                while True:
                    if DELETE + then[s] == now[s]:
                        out.append("D")
                        break
                    if INSERT + now[NEXT[s]] == now[s]:
                        out.append("I")
                        s = NEXT[s]
                        continue
                    kept = KEPT.get(initial, NOT_KEPT)[s]
                    if kept is not None and KEEP + extra + then[kept] == now[s]:
                        out.append("K")
                        s = kept
                    else:
                        out.append("R")
                        s = NEXT[s]
                    break
            states[k] = s
    if last:
        for k, s in enumerate(states):
            while after[s]:
                edits[k].append("I")
                s = NEXT[s]
            states[k] = s
    return cost, ["".join(e) for e in edits], states


def apply(edits: str, state: int, rows: Iterator[tuple[str, str]]) -> Iterator[tuple[str, str, str]]:
    """(edit, role, text) of what the edits leave of rows (role, text), from the state given."""
    for edit in edits:
        if edit == "I":
            role, text = ASKS[state], ""
        else:
            role, text = next(rows)
            if edit == "D":
                continue
            if edit == "R":
                role = ASKS[state]
        state = KEPT[role[:1]][state] if edit == "K" else NEXT[state]
        yield edit, role, text


# ---- rows in order ----------------------------------------------------------


def damage(df: DataFrame, conv="conv_id", turn="turn", role="role", text="text") -> DataFrame:
    """(key, turn, role, text) after damage by the checksum of ``conv:turn`` modulo 20.

    0 drops a row, 1 empties its text, 2 removes its full stops, exclamation and question
    marks, 3 repeats it, 4 makes its role user. NULL is one space in the checksum's text, in
    roles and in texts; ``key`` is the conversation as text and stays NULL, as ``turn`` does.
    """
    space = F.lit(" ")
    key, at = F.col(f"`{conv}`").cast("string"), F.col(f"`{turn}`")
    kind = F.crc32(F.concat(F.coalesce(key, space), F.lit(":"), F.coalesce(at.cast("string"), space))) % 20
    rows = df.select(
        key.alias("key"),
        at.cast("long").alias("turn"),
        F.coalesce(F.col(f"`{role}`").cast("string"), space).alias("role"),
        F.coalesce(F.col(f"`{text}`").cast("string"), space).alias("text"),
        kind.alias("kind"),
    ).filter("kind <> 0")
    rows = rows.withColumn("copy", F.explode(F.sequence(F.lit(1), F.when(F.col("kind") == 3, 2).otherwise(1))))
    spoken = F.when(F.col("kind") == 4, F.lit("user")).otherwise(F.col("role"))
    said = F.when(F.col("kind") == 1, F.lit("")).when(F.col("kind") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    return rows.select("key", "turn", spoken.alias("role"), said.alias("text"))


def ordered(rows: DataFrame) -> DataFrame:
    """Stored (key, turn, role, text, said, fault, row): the rows by conversation and turn,
    NULL first; rows of one turn go by role and text. ``row`` ascends in that order, and
    ``said`` identifies role and text. ``fault`` does not know duplicates yet.
    """
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    by = ["key", "turn", "role", "text", "tie"]
    rows = rows.withColumn("tie", F.monotonically_increasing_id())
    dealt = rows.repartitionByRange(parts, *by).sortWithinPartitions(*by)
    body = F.rtrim("text", F.lit(BLANKS))
    sound = F.when(body == "", IS_BLANK).when(F.substring(body, -1, 1).isin(*".!?"), SOUND).otherwise(IS_TRUNCATED)
    said = F.sha2(F.concat(F.octet_length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text")), 256)
    return stored(
        dealt.select("key", "turn", "role", "text", F.unhex(said).alias("said"), sound.alias("fault")).withColumn(
            "row", F.monotonically_increasing_id()
        )
    )


def judged(rows: DataFrame) -> DataFrame:
    """Stored (key, turn, row, cell, initial, fault), now with duplicates: rows whose role
    and text came earlier in their conversation."""
    light = rows.select("key", "turn", "row", "said", F.substring("role", 1, 1).alias("initial"), "fault")
    first = light.groupBy("key", "said").agg(F.min("row").alias("first"), F.count(F.lit(1)).alias("n"))
    met = hot_join(light, stored(first.filter("n > 1")), ["key", "said"], "n")
    again = (F.col("fault") != IS_BLANK) & (F.col("row") > F.col("first"))
    fault = F.when(again, IS_DUPLICATE).otherwise(F.col("fault"))
    cell = F.shiftright("row", CELL_BITS).alias("cell")
    return stored(met.select("key", "turn", "row", cell, "initial", fault.alias("fault")))


def _segments(batches, names: list[str]) -> Iterator[tuple[dict[str, list], bool]]:
    """Runs of rows with one cell and one key, as lists; and whether the run is the first or
    the last of its cell, so that its conversation may go on in another."""

    def runs():
        held, mark = None, None
        for batch in batches:
            columns = {c: batch.column(c).to_pylist() for c in names}
            marks = list(zip(columns["cell"], columns["key"], strict=True))
            starts = [i for i, m in enumerate(marks) if m != (marks[i - 1] if i else mark)]
            for k, (lo, hi) in enumerate(pairwise([0, *starts, batch.num_rows])):
                part = {c: v[lo:hi] for c, v in columns.items()}
                if k:
                    if held:
                        yield held
                    held = part
                elif hi:
                    held = {c: held[c] + part[c] for c in names}
            mark = marks[-1] if marks else mark
        if held:
            yield held

    last, edge = None, True
    for run in runs():
        if last is not None:
            changes = last["cell"][0] != run["cell"][0]
            yield last, edge or changes
            edge = changes
        last = run
    if last is not None:
        yield last, True


_LONGS = pa.list_(pa.int64())


def _summaries(batches):
    """One row per segment: how it changes a vector, where it may be part of a conversation."""
    names = ["key", "cell", "row", "initial", "fault"]
    out: dict[str, list] = {c: [] for c in ("key", "cell", "row", "illegal", "opens", "closes", "part")}
    for run, edge in _segments(batches, names):
        initials = run["initial"]
        out["key"].append(run["key"][0])
        out["cell"].append(run["cell"][0])
        out["row"].append(run["row"][0])
        out["illegal"].append(sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:])))
        out["opens"].append(initials[0])
        out["closes"].append(initials[-1])
        out["part"].append(matrix(list(zip(initials, run["fault"], strict=True))) if edge else None)
        if len(out["key"]) >= 4096:
            yield _batch(out, _SUMMARY)
            out = {c: [] for c in out}
    yield _batch(out, _SUMMARY)


_SUMMARY = {
    "key": pa.string(),
    "cell": pa.int64(),
    "row": pa.int64(),
    "illegal": pa.int64(),
    "opens": pa.string(),
    "closes": pa.string(),
    "part": _LONGS,
}
_EDITS = {
    "key": pa.string(),
    "cell": pa.int64(),
    "row": pa.int64(),
    "cost": pa.int64(),
    "edits": pa.list_(pa.string()),
    "value": _LONGS,
}


def _batch(columns: dict[str, list], kinds: dict[str, pa.DataType]) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict({c: pa.array(v, kinds[c]) for c, v in columns.items()})


def _walks(batches):
    """Edits of every segment: from state 0 if it is a whole conversation; from each state if
    a row with the vector after it leads it."""
    names = ["key", "cell", "row", "initial", "fault", "context", "last"]
    out: dict[str, list] = {c: [] for c in _EDITS}
    for run, _ in _segments(batches, names):
        after, last, entered, skip = END, True, [START], 0
        if run["context"][0] is not None:
            after, last, entered, skip = run["context"][0], run["last"][0], [START, SYSTEM, USER, ASSISTANT], 1
        rows = list(zip(run["initial"][skip:], run["fault"][skip:], strict=True))
        cost, edits, states = walk(rows, after, entered, last)
        for c, v in zip(out, (run["key"][0], run["cell"][0], run["row"][0], cost, edits, states), strict=True):
            out[c].append(v)
        if len(out["key"]) >= 4096:
            yield _batch(out, _EDITS)
            out = {c: [] for c in out}
    yield _batch(out, _EDITS)


# ---- scans over the cells of long conversations -----------------------------


def scan(rows: DataFrame, fold: Callable, spread: Callable, start: list[int]) -> DataFrame:
    """Stored (key, pos, context) for (key, pos, n, value): what a row takes from the others
    of its key.

    ``fold`` turns the values of consecutive rows into one, and ``spread`` gives each of
    them its context from that of all of them. Steps take ``FAN`` rows together, so a key
    of any length needs few steps and no task holds more than one group.
    """
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def folded(batches):
        for part in blocks(batches, lambda b: b.column("pos").to_numpy() % FAN == 0):
            first = part.column("pos")[0].as_py()
            columns = {
                "key": pa.array(part.column("key").to_pylist()[:1], pa.string()),
                "pos": pa.array([first // FAN], pa.int64()),
                "n": pa.array([-(-part.column("n")[0].as_py() // FAN)], pa.int64()),
                "value": pa.array([fold(part.column("value").to_pylist())], _LONGS),
            }
            yield pa.RecordBatch.from_pydict(columns)

    def handed(batches):
        for part in blocks(batches, lambda b: b.column("pos").to_numpy() == -1):
            context, rest = part.column("context")[0].as_py(), part.slice(1)
            columns = {
                "key": pa.array(rest.column("key").to_pylist(), pa.string()),
                "pos": pa.array(rest.column("pos").to_pylist(), pa.int64()),
                "context": pa.array(spread(context, rest.column("value").to_pylist()), _LONGS),
            }
            yield pa.RecordBatch.from_pydict(columns)

    def dealt(df):
        return df.repartition(parts, "key", "block").sortWithinPartitions("key", "block", "pos")

    block = F.expr(f"pos div {FAN}")
    tiers = [rows.select("key", "pos", "n", "value")]
    while not (long := tiers[-1].filter(F.col("n") > FAN)).isEmpty():
        up = dealt(long.withColumn("block", block)).mapInArrow(folded, "key string, pos long, n long, value array<long>")
        tiers.append(stored(up))
    context = None
    for tier in reversed(tiers):
        short = tier.filter(F.col("n") <= FAN).filter("pos = 0")
        heads = short.select("key", F.lit(0).cast("long").alias("block"), F.array(*map(F.lit, start)).cast("array<long>").alias("context"))
        if context is not None:
            heads = heads.unionByName(context.select("key", F.col("pos").alias("block"), "context"))
        both = tier.withColumn("block", block).unionByName(heads.withColumn("pos", F.lit(-1).cast("long")), allowMissingColumns=True)
        context = stored(dealt(both).mapInArrow(handed, "key string, pos long, context array<long>"))
    return context


def _vectors(after: list[int], parts: list[list[int]]) -> list[list[int]]:
    """The vector after each part, from the one after all of them."""
    out = []
    for m in reversed(parts):
        out.append(after)
        after = through(m, after)
    return out[::-1]


def _entered(state: list[int], maps: list[list[int]]) -> list[list[int]]:
    """The state before each part, from the one before all of them."""
    out = []
    for m in maps:
        out.append(state)
        state = [m[state[0]]]
    return out


def _mapped(maps: list[list[int]]) -> list[int]:
    out = list(range(4))
    for m in maps:
        out = [m[s] for s in out]
    return out


# ---- the operator -----------------------------------------------------------


def edits(light: DataFrame) -> tuple[DataFrame, DataFrame]:
    """For ``judged`` rows: stored (key, cell, row, cost, edits, state) of every segment, with
    the state that it is entered in, and stored (key, illegal). ``cost`` is that of the whole
    conversation in the segment with its first row, and NULL in the others."""
    parts = int(light.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = light.select("key", "cell", "row", "initial", "fault")
    dealt = rows.repartition(parts, "cell").sortWithinPartitions("row")
    texts = "key string, cell long, row long, illegal long, opens string, closes string, part array<long>"
    segments = stored(dealt.mapInArrow(_summaries, texts))
    inside = segments.select("key", "illegal")
    # Conversations in several cells: at most two segments of a cell can be part of one.
    cut = ranked(segments.filter("part is not null"), ["key"], ["cell"]).filter("n > 1")
    ahead = cut.select(F.col("key").alias("k"), (F.col("pos") - 1).alias("p"), F.col("opens").alias("then"))
    pair = F.concat("closes", "then")
    across = cut.join(ahead, F.col("key").eqNullSafe(F.col("k")) & (F.col("pos") == F.col("p"))).select(
        "key", (~pair.isin("su", "ua", "au")).cast("long").alias("illegal")
    )
    illegal = inside.unionByName(across).groupBy("key").agg(F.sum("illegal").alias("illegal"))

    after = scan(cut.withColumn("value", F.col("part")), joined, _vectors, END)
    after = after.select(F.col("key").alias("k"), F.col("pos").alias("p"), "context")
    leads = cut.join(after, F.col("key").eqNullSafe(F.col("k")) & (F.col("pos") == F.col("p"))).select(
        "key", "cell", "row", "context", (F.col("pos") == F.col("n") - 1).alias("last"), F.lit(0).alias("led")
    )
    both = rows.withColumn("led", F.lit(1)).unionByName(leads, allowMissingColumns=True)
    both = both.repartition(parts, "cell").sortWithinPartitions("row", "led")
    kinds = "key string, cell long, row long, cost long, edits array<string>, value array<long>"
    walked = stored(both.mapInArrow(_walks, kinds))

    places = cut.select(F.col("row").alias("at"), "pos", "n")
    met = stored(walked.filter(F.size("edits") > 1).join(places, F.col("row") == F.col("at")).drop("at"))
    states = scan(met, _mapped, _entered, [START])
    states = states.select(F.col("key").alias("k"), F.col("pos").alias("p"), F.col("context")[0].cast("int").alias("state"))
    long = met.join(states, F.col("key").eqNullSafe(F.col("k")) & (F.col("pos") == F.col("p"))).select(
        "key", "cell", "row", F.when(F.col("pos") == 0, F.col("cost")).alias("cost"), F.element_at("edits", F.col("state") + 1).alias("edits"), "state"
    )
    short = walked.filter(F.size("edits") == 1).select("key", "cell", "row", "cost", F.col("edits")[0].alias("edits"), F.lit(START).alias("state"))
    return stored(short.unionByName(long)), stored(illegal)


def _stream(rows: DataFrame, segments: DataFrame, fn: Callable, kinds: str) -> DataFrame:
    """Rows with their texts behind the edits of their segment, conversation by conversation."""
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    heads = segments.select("key", "row", "edits", "state", F.lit(0).alias("led"))
    both = rows.select("key", "row", "role", "text", F.lit(1).alias("led")).unionByName(heads, allowMissingColumns=True)
    return both.repartition(parts, "key").sortWithinPartitions("key", "row", "led").mapInArrow(fn, kinds)


class _Reader:
    """Repaired rows of sorted conversations, read as a stream: one batch is in memory."""

    def __init__(self, batches):
        self.items = self._rows(batches)
        self.item = next(self.items, None)

    @staticmethod
    def _rows(batches):
        names = ("key", "led", "role", "text", "edits", "state")
        for batch in batches:
            yield from zip(*(batch.column(c).to_pylist() for c in names), strict=True)

    def _take(self):
        item, self.item = self.item, next(self.items, None)
        return item

    def _texts(self):
        while self.item is not None and self.item[1]:
            yield self._take()[2:4]

    def conversations(self):
        while self.item is not None:
            key = self.item[0]
            yield key, self._segments(key)

    def _segments(self, key):
        """(edits, repaired rows) of each segment; the rows are to be read before the next."""
        while self.item is not None and self.item[0] == key:
            _, _, _, _, edits, state = self._take()
            yield edits, apply(edits, state, self._texts())
            # Rows behind the last kept one were deleted.
            for _ in self._texts():
                pass


_AUDIT = {"key": pa.string(), "audit": pa.string(), "repaired_sha256": pa.string()}
_REPAIRED = {"key": pa.string(), "place": pa.int64(), "edit": pa.string(), "role": pa.string(), "text": pa.string()}


def _audits(batches):
    out: dict[str, list] = {c: [] for c in _AUDIT}
    for key, segments in _Reader(batches).conversations():
        audit, digest, rows = [], hashlib.sha256(), 0
        for done, repaired in segments:
            audit.append(done)
            for _, role, text in repaired:
                digest.update((f"\n{role}:{text}" if rows else f"{role}:{text}").encode())
                rows += 1
        for c, v in zip(out, (key, "".join(audit), digest.hexdigest()), strict=True):
            out[c].append(v)
        if len(out["key"]) >= 1024:
            yield _batch(out, _AUDIT)
            out = {c: [] for c in out}
    yield _batch(out, _AUDIT)


def _repaired(batches):
    out: dict[str, list] = {c: [] for c in _REPAIRED}
    for key, segments in _Reader(batches).conversations():
        place = 0
        for _, repaired in segments:
            for edit, role, text in repaired:
                for c, v in zip(out, (key, place, edit, role, text), strict=True):
                    out[c].append(v)
                place += 1
                if len(out["key"]) >= 4096:
                    yield _batch(out, _REPAIRED)
                    out = {c: [] for c in out}
    yield _batch(out, _REPAIRED)


def repaired(rows: DataFrame) -> DataFrame:
    """(key, place, edit, role, text): the repaired conversations, row by row, of rows (key,
    turn, role, text) without NULL in role and text."""
    sorted_rows = ordered(rows)
    segments, _ = edits(judged(sorted_rows))
    return _stream(sorted_rows, segments, _repaired, "key string, place long, edit string, role string, text string")


def audit(df: DataFrame, conv="conv_id", turn="turn", role="role", text="text", rows: DataFrame | None = None) -> DataFrame:
    """One row per conversation of ``df``: ``conv_id``, the counts ``gaps, blank, duplicate,
    truncated, illegal``, the least ``cost`` of a repair, its edits as ``audit``, and
    ``repaired_sha256`` of the repaired rows.

    ``rows`` are the rows to repair, those of ``damage`` unless given. A row's first fault
    counts. Rows of one turn go by role and text, rows repeated whole stay apart, and a NULL
    conversation is one like any other; a NULL turn comes first. A conversation without rows
    has zeros, no edits and the digest of the empty text. An empty table gives no rows.
    Other columns are not read. The digest of a conversation is one stream of bytes, so one
    task reads its texts, a batch at a time; everything else is spread over the cells.
    """
    sorted_rows = ordered(damage(df, conv, turn, role, text) if rows is None else rows)
    light = judged(sorted_rows)
    segments, illegal = edits(light)
    counts = light.groupBy("key").agg(
        F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count_distinct("turn"), F.lit(0)).alias("gaps"),
        *(F.sum((F.col("fault") == f).cast("long")).alias(c) for c, f in (("blank", IS_BLANK), ("duplicate", IS_DUPLICATE), ("truncated", IS_TRUNCATED))),
    )
    costs = segments.groupBy("key").agg(F.max("cost").alias("cost"))
    digests = _stream(sorted_rows, segments, _audits, "key string, audit string, repaired_sha256 string")
    ident = F.col(f"`{conv}`")
    out = df.select(ident.alias("conv_id"), ident.cast("string").alias("key")).distinct()
    for found in (counts, illegal, costs, digests):
        told = found.withColumnRenamed("key", "_key")
        out = out.join(told, F.col("key").eqNullSafe(F.col("_key")), "left").drop("_key")
    numbers = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
    return out.select(
        "conv_id",
        *(F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in numbers),
        F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("repaired_sha256", F.lit(hashlib.sha256().hexdigest())).alias("repaired_sha256"),
    )
