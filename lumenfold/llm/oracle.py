"""DuckDB SQL that gives the rows of the queries SQL can express."""

from __future__ import annotations

ORACLE: dict[str, str] = {}

ORACLE["op5_exact_dedup"] = r"""
WITH d AS (
  SELECT doc_id, length(coalesce(text, '')) AS n,
         regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS body
  FROM documents)
SELECT doc_id,
       first_value(doc_id) OVER w AS keep_id,
       count(*) OVER (PARTITION BY body) AS group_size,
       row_number() OVER w = 1 AS kept,
       sha256(body) AS text_sha256
FROM d
WINDOW w AS (PARTITION BY body ORDER BY n DESC, doc_id NULLS LAST)
"""

#: Every copy that the mix reads, with its training position.
_COPIES = r"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         ('0x' || substr(md5(coalesce(doc_id::VARCHAR, 'text ' || coalesce(text, ''))), 1, 15))::BIGINT AS h
  FROM documents),
s AS (
  SELECT source, sum(size)::BIGINT AS source_size, count(*) AS n,
         [1, 2, 3][((row_number() OVER (ORDER BY source NULLS LAST)) - 1) % 3 + 1] AS weight,
         [-0.5, 0.0, 0.5][((row_number() OVER (ORDER BY source NULLS LAST)) - 1) % 3 + 1]::DOUBLE AS slope
  FROM d GROUP BY source),
-- k sources with the lowest cap per weight are held at their cap
o AS (
  SELECT *, row_number() OVER w - 1 AS k,
         coalesce(sum(3 * source_size) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS caps,
         (sum(weight) OVER ())::BIGINT
           - coalesce(sum(weight) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS free,
         (sum(source_size) OVER ())::BIGINT AS total
  FROM s WINDOW w AS (ORDER BY 3 * source_size / weight, source NULLS LAST)),
u AS (SELECT (total - caps)::DOUBLE / free AS unit FROM o
      WHERE (total - caps)::DOUBLE / free * weight <= 3 * source_size ORDER BY k LIMIT 1),
t AS (SELECT s.source, source_size, slope,
             CASE WHEN unit * weight > 3 * source_size THEN (3 * source_size)::DOUBLE ELSE unit * weight END AS target
      FROM s, u),
p AS (
  SELECT d.doc_id, h, size, source_size, target, slope,
         coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY h, doc_id NULLS LAST, size
                  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
c AS (
  SELECT *, (2 * (copy * source_size + start) + size) / 2 AS words
  FROM p, (SELECT unnest([0, 1, 2]) AS copy)
  WHERE CASE WHEN size = 0 THEN copy = 0 ELSE 2 * (copy * source_size + start) + size <= 2 * target END),
v AS (
  SELECT *, least(1.0::DOUBLE, CASE WHEN target > 0 THEN words / target ELSE 0.0 END) AS u FROM c),
w AS (
  SELECT *, CASE WHEN slope = 0 THEN u
                 ELSE (slope - 1 + sqrt((1 - slope) * (1 - slope) + 4 * slope * u)) / (2 * slope) END AS position
  FROM v)
"""

ORACLE["op10_mixing"] = (
    _COPIES
    + """,
x AS (SELECT *, row_number() OVER (ORDER BY position, h, doc_id NULLS LAST, copy, size) - 1 AS rank FROM w),
n AS (SELECT doc_id, h, size, start, source_size, target, count(*) AS copies, arg_min(position, copy) AS position, arg_min(rank, copy) AS rank
      FROM x GROUP BY ALL)
SELECT p.doc_id, p.size, p.source_size, p.target, p.size * coalesce(copies, 0) AS taken, position, rank
FROM p LEFT JOIN n ON p.doc_id IS NOT DISTINCT FROM n.doc_id AND p.start = n.start AND p.size = n.size
  AND p.source_size = n.source_size AND p.target = n.target AND p.h = n.h
"""
)

ORACLE["op10_mixing_order"] = (
    _COPIES
    + """
SELECT doc_id, copy, position,
       row_number() OVER (ORDER BY position, h, doc_id NULLS LAST, copy, size) - 1 AS rank
FROM w
"""
)


ORACLE["op7_sharding"] = r"""
WITH RECURSIVE shards AS (
  SELECT i, printf('shard-%02d', i) AS name FROM range(16) r(i)),
prefs AS (
  SELECT list(('0x' || substr(md5(name || ' offset'), 1, 15))::BIGINT % 1621 ORDER BY i) AS off,
         list(('0x' || substr(md5(name || ' skip'), 1, 15))::BIGINT % 1620 + 1 ORDER BY i) AS skip
  FROM shards),
fill AS (
  SELECT 0 AS step, list_transform(range(1621), lambda x: -1::BIGINT) AS owner, off, skip FROM prefs
  UNION ALL
  SELECT step + 1, owner[1:k] || [(step % 16)::BIGINT] || owner[k + 2:], off, skip
  FROM (SELECT *, (off[step % 16 + 1]
                   + skip[step % 16 + 1] * list_filter(range(1621), lambda j:
                       owner[(off[step % 16 + 1] + skip[step % 16 + 1] * j) % 1621 + 1] = -1)[1]) % 1621 AS k
        FROM fill WHERE step < 1621)),
slots AS (
  SELECT unnest(range(1621)) AS slot, unnest(owner) AS i FROM fill WHERE step = 1621)
SELECT doc_id, slot::INTEGER AS slot, name AS shard
FROM (SELECT doc_id, ('0x' || substr(md5(coalesce(doc_id::VARCHAR, text, '')), 1, 15))::BIGINT % 1621 AS slot
      FROM documents)
JOIN slots USING (slot) JOIN shards USING (i)
"""


def _tree(name: str, group: str, levels: int) -> str:
    """Levels 0 to ``levels`` of the trees in ``{name}0`` (group, pos, h); a root stays as it is."""
    out = []
    for k in range(levels):
        out.append(f"""
{name}{k + 1} AS (
  SELECT {group}, pos // 8 AS pos,
         CASE WHEN max(n) > 1 THEN sha256(string_agg(h, '' ORDER BY pos)) ELSE max(h) END AS h,
         (max(n) + 7) // 8 AS n
  FROM {name}{k} GROUP BY {group}, pos // 8)""")
    return ",".join(out)


def _climb(name: str, start: str, match: str, levels: int, carried: str) -> str:
    """Proof and folded digest of every row of ``start`` along the levels of ``name``."""
    out, last = [], start
    for k in range(levels):
        now = f"{start}_{k + 1}"
        out.append(f"""
{now}_s AS (
  SELECT s.row, coalesce(string_agg(t.h, '' ORDER BY t.pos) FILTER (t.pos < s.pos), '') AS l,
         coalesce(string_agg(t.h, '' ORDER BY t.pos) FILTER (t.pos > s.pos), '') AS r, max(t.n) AS n
  FROM {last} s JOIN {name}{k} t ON {match} AND t.pos // 8 = s.pos // 8 GROUP BY s.row),
{now} AS (
  SELECT {carried}, s.row, s.pos // 8 AS pos, proof || l || r AS proof,
         CASE WHEN x.n > 1 THEN sha256(l || fold || r) ELSE fold END AS fold
  FROM {last} s JOIN {now}_s x ON s.row = x.row)""")
        last = now
    return ",".join(out)


def _leaf(text: str) -> str:
    part = "coalesce(strlen({0})::VARCHAR || ':' || {0}, '-')".format
    return "sha256(" + " || ".join(map(part, ["doc_id::VARCHAR", "source", "lang", "n_chars::VARCHAR", text])) + ")"


#: Levels that the SQL lays out: enough for 8 ** 7 rows of a language and 8 ** 3 languages.
_HIGH, _WIDE = 7, 3

#: The table of CRC-32, and the checksum of a short ASCII text.
_CRCS = """crcs AS (
  SELECT list_transform(range(256), lambda i: list_reduce(list_prepend(i::BIGINT, range(8)),
           lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS crc)"""


def _crc(text: str) -> str:
    codes = f"list_transform(string_split({text}, ''), lambda c: ascii(c)::BIGINT)"
    return f"""xor(list_reduce(list_prepend(4294967295::BIGINT, {codes}),
           lambda c, b: xor(c >> 8, crc[(xor(c, b) & 255) + 1])), 4294967295)"""


ORACLE["op13_merkle"] = f"""
WITH {_CRCS},
d AS (
  SELECT row_number() OVER () AS row, doc_id, lang, {_leaf("text")} AS leaf,
         {_leaf("translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} AS other,
         coalesce({_crc("doc_id::VARCHAR")} % 3 = 0, false) AS changed
  FROM documents, crcs),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos FROM d),
t0 AS (SELECT lang, pos, leaf AS h, count(*) OVER (PARTITION BY lang) AS n FROM placed),{_tree("t", "lang", _HIGH)},
u0 AS (SELECT 0 AS one, lang, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS pos, h, count(*) OVER () AS n FROM t{_HIGH}),{_tree("u", "one", _WIDE)},
f AS (SELECT doc_id, lang, leaf, row, pos, '' AS proof, CASE WHEN changed THEN other ELSE leaf END AS fold FROM placed),{_climb("t", "f", "t.lang IS NOT DISTINCT FROM s.lang", _HIGH, "doc_id, s.lang, leaf")},
g AS (
  SELECT doc_id, s.lang, leaf, row, u0.pos, u0.h AS subroot, proof, fold
  FROM f_{_HIGH} s JOIN u0 ON u0.lang IS NOT DISTINCT FROM s.lang),{_climb("u", "g", "true", _WIDE, "doc_id, lang, leaf, subroot")}
SELECT doc_id, leaf, subroot, h AS root, sha256(proof) AS proof_sha256, fold AS folded_root, fold = h AS verified
FROM g_{_WIDE}, u{_WIDE}
"""

ORACLE["op12_conversations"] = f"""
WITH RECURSIVE {_CRCS},
raw AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
         {_crc("coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ')")} % 20 AS kind
  FROM conversations, crcs),
damaged AS (
  SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
         CASE kind WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text,
         unnest(range(CASE WHEN kind = 3 THEN 2 ELSE 1 END)) AS copy
  FROM raw WHERE kind <> 0),
-- A conversation is named by a text, so that NULL is one like any other.
placed AS (
  SELECT coalesce(conv_id::VARCHAR, 'none') AS c, turn, role, text, substr(role, 1, 1) AS initial,
         rtrim(text, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS body,
         row_number() OVER w - 1 AS i, lead(substr(role, 1, 1)) OVER w AS ahead
  FROM damaged WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)),
r AS (
  SELECT *, CASE WHEN body = '' THEN 1 WHEN row_number() OVER (PARTITION BY c, role, text ORDER BY i) > 1 THEN 2
                   WHEN substr(body, -1, 1) IN ('.', '!', '?') THEN 0 ELSE 3 END AS fault
  FROM placed),
counts AS (
  SELECT c, count(*) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps,
         count(*) FILTER (fault = 1) AS blank, count(*) FILTER (fault = 2) AS duplicate,
         count(*) FILTER (fault = 3) AS truncated,
         count(*) FILTER (initial || ahead NOT IN ('su', 'ua', 'au')) AS illegal
  FROM r GROUP BY c),
-- Up to two inserted rows lead from one state to another.
ins(a, b, more, price) AS (VALUES ('', '', '', 0), ('s', 's', '', 0), ('u', 'u', '', 0), ('a', 'a', '', 0),
  ('', 'u', 'I', 5), ('', 'a', 'II', 10), ('s', 'u', 'I', 5), ('s', 'a', 'II', 10), ('u', 'a', 'I', 5), ('a', 'u', 'I', 5)),
asks(a, b) AS (VALUES ('', 'u'), ('s', 'u'), ('u', 'a'), ('a', 'u')),
-- The least (cost, edits) of every state after each row.
walk AS (
  SELECT c, 0 AS i, '' AS state, {{'cost': 0, 'audit': ''}} AS best FROM counts
  UNION ALL
  SELECT c, i + 1, x.state, min({{'cost': x.cost, 'audit': x.audit}}) FROM (
    SELECT w.c, w.i, unnest([
        {{'state': ins.b, 'cost': w.best.cost + price + 2, 'audit': w.best.audit || more || 'D'}},
        CASE WHEN fault NOT IN (1, 2) THEN
          {{'state': asks.b, 'cost': w.best.cost + price + 1 + CASE WHEN fault = 3 THEN 5 ELSE 0 END, 'audit': w.best.audit || more || 'R'}} END,
        CASE WHEN fault NOT IN (1, 2) AND (initial = asks.b OR (initial = 's' AND ins.b = '')) THEN
          {{'state': initial, 'cost': w.best.cost + price + CASE WHEN fault = 3 THEN 5 ELSE 0 END, 'audit': w.best.audit || more || 'K'}} END]) AS x
    FROM walk w JOIN ins ON ins.a = w.state JOIN asks ON asks.a = ins.b JOIN r ON r.c = w.c AND r.i = w.i)
  WHERE x IS NOT NULL GROUP BY c, i, x.state),
done AS (
  SELECT w.c, min({{'cost': w.best.cost + price, 'audit': w.best.audit || more}}) AS best
  FROM walk w JOIN counts n ON n.c = w.c AND n.n = w.i JOIN ins ON ins.a = w.state AND ins.b IN ('', 'a') GROUP BY w.c),
steps AS (
  SELECT c, unnest(string_split(best.audit, '')) AS edit, generate_subscripts(string_split(best.audit, ''), 1) AS nr
  FROM done WHERE best.audit <> ''),
read AS (
  SELECT *, count(*) FILTER (edit <> 'I') OVER w - 1 AS i, count(*) FILTER (edit <> 'D') OVER w AS place
  FROM steps WINDOW w AS (PARTITION BY c ORDER BY nr)),
told AS (
  SELECT s.c, s.nr, s.edit, s.place, r.role, r.text,
         coalesce(max((s.place = 1 AND s.edit = 'K' AND r.initial = 's')::INT) OVER (PARTITION BY s.c), 0) AS led
  FROM read s LEFT JOIN r ON r.c = s.c AND r.i = s.i AND s.edit <> 'I' WHERE s.edit <> 'D'),
texts AS (
  SELECT c, string_agg(CASE WHEN edit = 'K' THEN role WHEN (place - led) % 2 = 1 THEN 'user' ELSE 'assistant' END
                       || ':' || coalesce(text, ''), chr(10) ORDER BY nr) AS body
  FROM told GROUP BY c)
SELECT o.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank,
       coalesce(duplicate, 0)::BIGINT AS duplicate, coalesce(truncated, 0)::BIGINT AS truncated,
       coalesce(illegal, 0)::BIGINT AS illegal, coalesce(best.cost, 0)::BIGINT AS cost,
       coalesce(best.audit, '') AS audit, sha256(coalesce(body, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id, coalesce(conv_id::VARCHAR, 'none') AS c FROM conversations) o
LEFT JOIN counts USING (c) LEFT JOIN done USING (c) LEFT JOIN texts USING (c)
"""
