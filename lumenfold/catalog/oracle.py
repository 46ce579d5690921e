"""The SQL each registered query must agree with, for DuckDB on the same tables.

Names in capitals are building blocks; ``ORACLE`` at the end is what is checked.
"""

from __future__ import annotations

from lumenfold.catalog import queries as q
from lumenfold.fixed import (
    DOMINANT_K,
    EMOTIONS,
    ENCODER_DIMS,
    MAX_RANK,
    NEIGHBOURS,
    PESTLE_FACETS,
    PESTLE_K,
    PESTLE_TITLES,
    PLACEHOLDERS,
    PREVIEW_CHARS,
    SIMILAR_TAKE,
    SWOT_ARTICLES_K,
    SWOT_FACETS,
    SWOT_POSTS_K,
    SWOT_TWEETS_K,
    TOPIC_GROUPS,
    palette_rows,
)
from lumenfold.operators import emotion as em
from lumenfold.operators import sentiment_rules as sr
from lumenfold.plans import reports as rp
from lumenfold.sources.adapters import TOPICS


def text_list(values) -> str:
    return ", ".join("'" + v.replace("'", "''") + "'" for v in values)


# Whitespace, Unicode included, as a class of RE2 patterns.
SPACES = (
    "\\t-\\r\\x1C-\\x20\\x{85}\\x{A0}\\x{1680}\\x{2000}-\\x{200A}\\x{2028}\\x{2029}"
    "\\x{202F}\\x{205F}\\x{3000}"
)


def split(c: str) -> str:
    return (
        f"string_split(regexp_replace({c}, '([.!?])[{SPACES}]+', '\\1' || chr(1), 'g'), "
        "chr(1))"
    )


def clean(c: str) -> str:
    c = f"replace(regexp_replace({c}, '@[A-Za-z0-9]+', '', 'g'), '#', '')"
    c = f"regexp_replace({c}, 'https?:\\/\\/[^{SPACES}]+', '', 'g')"
    c = f"regexp_replace({c}, '[^A-Za-z0-9]+', ' ', 'g')"
    return f"regexp_replace({c}, '[{SPACES}]+', ' ', 'g')"


def words(c: str) -> str:
    """All pieces between words, '' included."""
    return "string_split_regex(lower(" + c + "), '[^\\p{L}\\p{N}]+')"


def digits(c: str, start: int) -> str:
    return f"('0x' || substr(md5({c}), {start}, 8))::BIGINT"


def has_term(c: str, term: str) -> str:
    term = term.replace(" ", "[^\\p{L}\\p{N}]+")
    return (
        f"regexp_matches(lower({c}), "
        f"'(^|[^\\p{{L}}\\p{{N}}]){term}($|[^\\p{{L}}\\p{{N}}])')"
    )


def keywords(c: str) -> str:
    """``q.KEYWORDS`` spelled out."""
    return (
        f"(({has_term(c, 'the')} AND {has_term(c, 'of')}) OR {has_term(c, 'by the')})"
    )


ARTICLES = f"""articles AS (
  SELECT doc_id AS article_id, {split('text')}[1] AS title, text AS summary, lang,
    CASE WHEN doc_id % 3 <> 0 THEN 'us' ELSE 'gb' END AS country, source,
    (doc_id * 37 % 10000)::INTEGER AS rank,
    [{text_list(TOPICS)}][(doc_id % 5 + 1)::INTEGER] AS topic,
    (DATE '2024-01-01' + (doc_id % 30)::INTEGER)::DATE AS published
  FROM documents)"""

POSTS = """posts AS (
  SELECT CASE WHEN turn = 0 THEN 'submission' ELSE 'comment' END AS type,
    role AS author,
    CASE (conv_id + turn) % 13 WHEN 0 THEN '[deleted]' WHEN 1 THEN '[removed]'
      WHEN 2 THEN NULL ELSE text END AS body,
    TIMESTAMP '2024-01-01 00:00:00' + to_hours(conv_id) + to_minutes(turn) AS created,
    conv_id || '_' || turn AS id,
    CASE WHEN turn <> 0 THEN conv_id || '_' || (turn - 1) END AS parent_id,
    'sub' || (conv_id % 10) AS subreddit,
    CASE WHEN (conv_id + turn) % 17 <> 0 THEN 'u/' || conv_id || '_' || turn END AS url
  FROM conversations)"""

TWEETS = f"""pieces AS (
  SELECT doc_id, unnest({split('text')}) AS sentence,
    generate_subscripts({split('text')}, 1) - 1 AS pos
  FROM documents),
numbered AS (
  SELECT sentence, doc_id * 2147483648 + pos AS tweet_id,
    (doc_id * 7919 + pos) % (SELECT count(*) FROM events) AS event_id,
    doc_id % (SELECT count(*) FROM pages) AS page_id FROM pieces),
tweets AS (
  SELECT e.ts, n.tweet_id,
    '@user' || e.user_id || ' #' || e.event_type || ' ' || p.url || ' ' || n.sentence
      AS text,
    'user' || e.user_id AS username,
    n.tweet_id % 7 = 0 AS is_retweet, n.tweet_id % 11 = 0 AS is_reply
  FROM numbered n
  JOIN events e USING (event_id)
  JOIN pages p USING (page_id))"""

SENTENCES = f"""sentences AS (
  SELECT doc_id AS article_id, (generate_subscripts({split('text')}, 1) - 1)::INTEGER AS pos,
    unnest({split('text')}) AS sentence
  FROM documents),
cleaned AS (
  SELECT article_id, pos, {clean('sentence')} AS text FROM sentences)"""


def facets(names: list[str]) -> str:
    """Seeds of the named facets → counts and squared norms per facet."""
    return f"""seed_terms AS (
  SELECT [{text_list(names)}][(item_id % {len(names)} + 1)::INTEGER] AS facet,
    unnest({words('text')}) AS term FROM benchmark),
facet_terms AS (
  SELECT facet, {digits('term', 1)} % {ENCODER_DIMS} AS bucket, count(*) AS m
  FROM seed_terms WHERE term <> '' GROUP BY ALL),
facet_norms AS (
  SELECT facet, sum(m * m)::BIGINT AS nf FROM facet_terms GROUP BY facet)"""


def encoded(table: str, key: str, text: str) -> str:
    """Texts of a table → counts and squared norms per key."""
    return f"""text_terms AS (
  SELECT {key}, {digits('term', 1)} % {ENCODER_DIMS} AS bucket, count(*) AS n
  FROM (SELECT {key}, unnest({words(text)}) AS term FROM {table})
  WHERE term <> '' GROUP BY ALL),
text_norms AS (
  SELECT {key}, sum(n * n)::BIGINT AS nt FROM text_terms GROUP BY {key}),
dots AS (
  SELECT {key}, facet, sum(n * m)::BIGINT AS dot
  FROM text_terms JOIN facet_terms USING (bucket) GROUP BY {key}, facet)"""


def scored(table: str, key: str, text: str) -> str:
    """All (text, facet) pairs with their similarity."""
    return f"""{encoded(table, key, text)},
scored AS (
  SELECT {', '.join('t.' + c.strip() for c in key.split(','))}, t.{text} AS text, f.facet,
    CASE WHEN d.dot IS NULL THEN 0.0::DOUBLE
      ELSE d.dot::DOUBLE / sqrt(nt::DOUBLE * nf::DOUBLE) END AS sim
  FROM {table} t CROSS JOIN facet_norms f
  LEFT JOIN text_norms USING ({key})
  LEFT JOIN dots d ON {' AND '.join(f'd.{c.strip()} = t.{c.strip()}' for c in key.split(','))}
    AND d.facet = f.facet)"""


def best(k: int, order: str) -> str:
    return (
        "best AS (SELECT *, row_number() OVER "
        f"(PARTITION BY facet ORDER BY sim DESC, {order})::INTEGER AS rk FROM scored "
        f"QUALIFY rk <= {k})"
    )


def ctes(*parts: str) -> str:
    return "WITH " + ",\n".join(parts) + "\n"


DISTINCT = "distinct_texts AS (SELECT DISTINCT text FROM cleaned)"
SWOT = facets(SWOT_FACETS)
PESTLE = facets(PESTLE_FACETS)
SWOT_BEST = ctes(
    SENTENCES,
    SWOT,
    scored("cleaned", "article_id, pos", "text"),
    best(SWOT_ARTICLES_K, "article_id, pos"),
)
PESTLE_BEST = ctes(
    SENTENCES, PESTLE, DISTINCT, scored("distinct_texts", "text", "text"),
    best(PESTLE_K, "text"),
).replace("t.text, t.text AS text", "t.text")

VOCABULARY = f"""vocabulary AS (
  SELECT DISTINCT term FROM (SELECT unnest({words('text')}) AS term FROM benchmark)
  WHERE term <> '')"""
SENTIMENT = f"""{VOCABULARY},
lexicon AS (
  SELECT term, {digits('term', 1)} % 201 - 100 AS p, {digits('term', 9)} % 101 AS s
  FROM vocabulary),
sentiment AS (
  SELECT article_id, pos, count(p) AS n, sum(p)::BIGINT AS p, sum(s)::BIGINT AS s
  FROM (SELECT article_id, pos, unnest({words('text')}) AS term FROM cleaned)
  JOIN lexicon USING (term) GROUP BY article_id, pos),
sentiments AS (
  SELECT c.article_id, c.pos,
    coalesce(p / 100.0::DOUBLE / n, 0.0) AS polarity,
    coalesce(s / 100.0::DOUBLE / n, 0.0) AS subjectivity
  FROM cleaned c LEFT JOIN sentiment USING (article_id, pos))"""

EMOTION = f"""{POSTS},
{VOCABULARY},
lexicon AS (
  SELECT term, [{text_list(EMOTIONS)}][({digits('term', 1)} % 27 + 1)::INTEGER] AS emotion,
    {digits('term', 9)} % 100 + 1 AS w FROM vocabulary),
usable AS (
  SELECT id, body AS text FROM posts
  WHERE body IS NOT NULL AND body NOT IN ({text_list(PLACEHOLDERS)})),
hits AS (
  SELECT id, emotion, sum(w)::BIGINT AS w
  FROM (SELECT id, unnest({words('text')}) AS term FROM usable) JOIN lexicon USING (term)
  GROUP BY id, emotion),
scores AS (
  SELECT u.id, l.emotion, coalesce(w, 0) / 100.0::DOUBLE AS score
  FROM usable u CROSS JOIN (SELECT unnest([{text_list(EMOTIONS)}]) AS emotion) l
  LEFT JOIN hits h ON h.id = u.id AND h.emotion = l.emotion),
topped AS (
  SELECT id, emotion AS top_emotion FROM scores
  QUALIFY row_number() OVER (PARTITION BY id ORDER BY score DESC, emotion) = 1),
counts AS (
  SELECT top_emotion, count(*) AS n, sum(count(*)) OVER () AS total,
    (row_number() OVER (ORDER BY top_emotion) - 1)::INTEGER AS code,
    row_number() OVER (ORDER BY count(*) DESC, top_emotion) AS rank
  FROM topped GROUP BY top_emotion),
kept AS (
  SELECT * FROM counts WHERE total <= {q.THRESHOLD} OR rank <= {DOMINANT_K}),
palette AS (
  SELECT * FROM (VALUES {', '.join(f"('{e}', '{c}')" for e, c in palette_rows())})
    AS v(top_emotion, colour))"""

CENTROIDS = """axes AS (
  SELECT vec_id, label, generate_subscripts(embedding, 1) AS i,
    unnest(embedding)::DOUBLE AS x FROM embeddings),
means AS (SELECT label, i, avg(x) AS x FROM axes GROUP BY label, i),
centroids AS (SELECT label, list(x ORDER BY i) AS c FROM means GROUP BY label)"""

PROMPTS = (
    SWOT_BEST
    + ",\nswot_lists AS (SELECT facet, to_json(list(text ORDER BY rk)) AS evidence "
    "FROM best GROUP BY facet),\npestle_lists AS ("
    + PESTLE_BEST
    + "SELECT facet, to_json(list(text ORDER BY rk)) AS evidence FROM best GROUP BY facet),\n"
    + "prompts AS (SELECT '{s}' AS subject, 'swot_summary' AS stage, 'all' AS facet, "
    "replace(replace(replace('{t}', '{{subject}}', '{s}'), '{{positive}}', "
    "max(evidence) FILTER (facet = 'positive')), '{{negative}}', "
    "max(evidence) FILTER (facet = 'negative')) AS prompt, {n} FROM swot_lists "
    "UNION ALL SELECT '{s}', 'pestle_summary', facet, replace(replace(replace("
    "'{p}', '{{subject}}', '{s}'), '{{facet}}', facet), '{{evidence}}', evidence), "
    "{m} FROM pestle_lists)\n".format(
        s=q.SUBJECT,
        t=rp.SWOT_SUMMARY,
        p=rp.PESTLE_SUMMARY,
        n=", ".join(
            f"{v} AS {c}" for v, c in zip(rp.SWOT_SUMMARY_NUMBERS, rp.NUMBER_COLUMNS)
        ),
        m=", ".join(map(str, rp.PESTLE_SUMMARY_NUMBERS)),
    )
)


def component(n: int) -> str:
    """Principal component n by power iteration on c{n}, and the matrix without it."""
    return f"""p{n} AS (
  SELECT 0 AS step, list_transform(range({len(EMOTIONS)}), lambda x: 1.0::DOUBLE / (1 + x)) AS v
  UNION ALL
  SELECT step + 1, list_transform(w, lambda x: x / sqrt(list_dot_product(w, w))) AS v
  FROM (SELECT step, list_transform(c, lambda r: list_dot_product(r, v)) AS w
        FROM p{n}, c{n} WHERE step < 3000)),
e{n} AS (
  SELECT v, list_dot_product(v, list_transform(c, lambda r: list_dot_product(r, v))) AS l,
    list_transform(v, lambda x: abs(x)) AS a
  FROM p{n}, c{n} WHERE step = 3000),
c{n + 1} AS (
  SELECT list_transform(c, lambda r, i: list_transform(r, lambda x, j: x - l * v[i] * v[j])) AS c
  FROM c{n}, e{n})"""


def axes(rows: str) -> str:
    """Coordinates (id, x, y, z) of the ids in ``rows``, fitted on these rows."""
    placed = ", ".join(
        f"round(list_dot_product(d, {a}.v) * sign({a}.v[list_position({a}.a, list_max({a}.a))]), {q.SIM_DIGITS})"
        f" + 0.0 AS {x}"
        for a, x in (("e1", "x"), ("e2", "y"), ("e3", "z"))
    )
    return f"""centred AS (
  SELECT id, emotion, score - avg(score) OVER (PARTITION BY emotion) AS d
  FROM scores SEMI JOIN {rows} USING (id)),
products AS (
  SELECT a.emotion AS i, b.emotion AS j, sum(a.d * b.d) AS s
  FROM centred a JOIN centred b USING (id) GROUP BY ALL),
matrix_rows AS (SELECT i, list(s ORDER BY j) AS r FROM products GROUP BY i),
c1 AS (SELECT list(r ORDER BY i) AS c FROM matrix_rows),
{component(1)},
{component(2)},
{component(3)},
lists AS (SELECT id, list(d ORDER BY emotion) AS d FROM centred GROUP BY id),
coordinates AS (SELECT id, {placed} FROM lists, e1, e2, e3)"""


def times(a: str, b: str) -> str:
    """The product of two matrices as lists of rows, the second one symmetric."""
    return f"list_transform({a}, lambda r: list_transform({b}, lambda c: list_dot_product(r, c)))"


def fisher(n: int) -> str:
    """Axis n: the direction of most scatter between labels, of length one and at right
    angles to the earlier ones as the scatter within labels measures it."""
    found = "u"
    for k in range(1, n):
        found = f"list_transform({found}, lambda x, i: x - f{k}.v[i] * list_dot_product(f{k}.wv, u))"
    return f"""q{n} AS (
  SELECT 0 AS step, list_transform(range({len(EMOTIONS)}), lambda x: 1.0::DOUBLE / (1 + x)) AS v
  UNION ALL
  SELECT step + 1, list_transform(d, lambda x: x / sqrt(list_dot_product(d, list_transform(w, lambda r: list_dot_product(r, d)))))
  FROM (SELECT step, w, {found} AS d
        FROM (SELECT step, list_transform(x, lambda r: list_dot_product(r, list_transform(b, lambda s: list_dot_product(s, q{n}.v)))) AS u
              FROM q{n}, inverse, between_m WHERE step < 3000), within_m{"".join(f", f{k}" for k in range(1, n))})),
f{n} AS (
  SELECT v, list_transform(w, lambda r: list_dot_product(r, v)) AS wv, list_transform(v, lambda x: abs(x)) AS a
  FROM q{n}, within_m WHERE step = 3000)"""


def fisher_axes(rows: str) -> str:
    """Coordinates (id, x, y, z) of the ids in ``rows`` (id, top_emotion), fitted on them."""
    placed = ", ".join(
        f"round(list_dot_product(d, {a}.v) * sign({a}.v[list_position({a}.a, list_max({a}.a))]), {q.SIM_DIGITS})"
        f" + 0.0 AS {x}"
        for a, x in (("f1", "x"), ("f2", "y"), ("f3", "z"))
    )
    size = len(EMOTIONS)
    return f"""placed AS (
  SELECT id, top_emotion, emotion, score - avg(score) OVER (PARTITION BY top_emotion, emotion) AS inner_d,
    score - avg(score) OVER (PARTITION BY emotion) AS d
  FROM scores JOIN (SELECT id, top_emotion FROM {rows}) USING (id)),
total AS (SELECT count(DISTINCT id)::DOUBLE AS n FROM placed),
scatter AS (
  SELECT a.emotion AS i, b.emotion AS j, sum(a.inner_d * b.inner_d) / any_value(n) AS w,
    sum((a.d - a.inner_d) * (b.d - b.inner_d)) / any_value(n) AS b
  FROM placed a JOIN placed b USING (id), total GROUP BY ALL),
ridge AS (SELECT {em.RIDGE} * sum(w) / {size} AS e FROM scatter WHERE i = j),
scatter_rows AS (
  SELECT i, list(w + CASE WHEN i = j THEN e ELSE 0 END ORDER BY j) AS w, list(b ORDER BY j) AS b
  FROM scatter, ridge GROUP BY i),
within_m AS (SELECT list(w ORDER BY i) AS w FROM scatter_rows),
between_m AS (SELECT list(b ORDER BY i) AS b FROM scatter_rows),
newton AS (
  SELECT 0 AS step, list_transform(w, lambda r: list_transform(r, lambda x: x / m / m)) AS x
  FROM within_m, (SELECT list_max(list_transform(w, lambda r: list_sum(list_transform(r, lambda x: abs(x))))) AS m FROM within_m)
  UNION ALL
  SELECT step + 1, list_transform(y, lambda r, i: list_transform(r, lambda t, j: x[i][j] + x[j][i] - t))
  FROM (SELECT step, x, {times(times("x", "w"), "x")} AS y FROM newton, within_m WHERE step < 60)),
inverse AS (SELECT x FROM newton WHERE step = 60),
{fisher(1)},
{fisher(2)},
{fisher(3)},
lists AS (SELECT id, list(d ORDER BY emotion) AS d FROM placed GROUP BY id),
coordinates AS (SELECT id, {placed} FROM lists, f1, f2, f3)"""


# Known words of every sentence with their places, and one step of the rules.
RULED = f"""{SENTIMENT},
rules AS (
  SELECT term, {digits('term', 17)} % 40 AS kind, ({digits('term', 25)} % 11 + 5) / 10.0::DOUBLE AS factor FROM vocabulary),
known AS (
  SELECT l.term, CASE WHEN kind < 3 THEN least(kind, 1) ELSE 2 END AS kind,
    CASE WHEN kind = 0 THEN 0.0 WHEN kind < 3 THEN factor ELSE p / 100.0::DOUBLE END AS p,
    CASE WHEN kind < 3 THEN 0.0 ELSE s / 100.0::DOUBLE END AS s
  FROM lexicon l JOIN rules USING (term)),
pieces AS (
  SELECT article_id, pos, list_filter({words('text')}, lambda w: w <> '') AS ws FROM cleaned),
placed AS (
  SELECT article_id, pos, unnest(ws) AS term, generate_subscripts(ws, 1) - 1 AS place FROM pieces),
found AS (
  SELECT article_id, pos, list({{'p': p::DOUBLE, 's': s::DOUBLE, 'n': 0, 'boost': 1.0::DOUBLE, 'reach': 0,
    'place': place::BIGINT, 'kind': kind::BIGINT}} ORDER BY place) AS hits
  FROM placed JOIN known USING (term) GROUP BY article_id, pos),
folded AS (
  SELECT article_id, pos, list_reduce(hits, lambda z, w: CASE
    WHEN w.kind = 0 THEN {{'p': z.p, 's': z.s, 'n': z.n, 'boost': 1.0::DOUBLE, 'reach': {sr.REACH}, 'place': w.place, 'kind': w.kind}}
    WHEN w.kind = 1 THEN {{'p': z.p, 's': z.s, 'n': z.n,
      'boost': CASE WHEN w.place - z.place > 1 THEN 1.0 ELSE z.boost END * w.p,
      'reach': greatest(0, z.reach - (w.place - z.place - 1)), 'place': w.place, 'kind': w.kind}}
    ELSE {{
      'p': z.p + greatest(-1.0, least(1.0, w.p * CASE WHEN w.place - z.place > 1 THEN 1.0::DOUBLE ELSE z.boost END
           * CASE WHEN z.reach - (w.place - z.place - 1) > 0 THEN {sr.TURNED}::DOUBLE ELSE 1.0::DOUBLE END)),
      's': z.s + least(1.0, w.s * CASE WHEN w.place - z.place > 1 THEN 1.0::DOUBLE ELSE z.boost END),
      'n': z.n + 1, 'boost': 1.0::DOUBLE, 'reach': 0, 'place': w.place, 'kind': w.kind}} END,
    {{'p': 0.0::DOUBLE, 's': 0.0::DOUBLE, 'n': 0, 'boost': 1.0::DOUBLE, 'reach': 0, 'place': -1::BIGINT, 'kind': 2::BIGINT}}) AS z
  FROM found)"""


def where(table: str, columns: str, condition: str, *parts: str) -> str:
    return ctes(*parts) + f"SELECT {columns} FROM {table} WHERE {condition}"


SOURCE_NAMES = text_list(s.strip() for s in q.SOURCES.split(","))
TAG_NAMES = text_list(t.strip().removeprefix("#") for t in q.TAGS.split(","))
TAGGED = f"list_has_any(regexp_extract_all(lower(text), '#([\\p{{L}}\\p{{M}}\\p{{N}}_]+)', 1), [{TAG_NAMES}])"
GROUP_TOPICS = text_list(t for g in q.GROUPS for t in TOPIC_GROUPS[g])
USERNAME = q.USER.removeprefix("@")


def latest(condition: str) -> str:
    return ctes(TWEETS) + (
        f"SELECT ts, tweet_id, text, username FROM tweets WHERE {condition} "
        f"ORDER BY ts DESC, tweet_id DESC LIMIT {q.TWEET_LIMIT}"
    )


def seeded(named: dict[str, str]) -> str:
    """Given seed paragraphs → counts and squared norms per facet."""
    rows = ", ".join(f"('{f}', '{t}')" for f, t in named.items())
    given = f"given AS (SELECT * FROM (VALUES {rows}) v(facet, text))"
    return given + ",\n" + facets(list(named)).replace(
        facets(list(named)).split("),\nfacet_terms")[0],
        f"seed_terms AS (SELECT facet, unnest({words('text')}) AS term FROM given",
    )


def _named(templates: dict[str, str]) -> dict[str, str]:
    return {
        f: t.replace("{subject}", q.SUBJECT).replace("{facet}", f) for f, t in templates.items()
    }


SEEDED_SWOT = seeded(_named(rp.SWOT_SEEDS))
SEEDED_PESTLE = seeded(_named({f: rp.PESTLE_SEED for f in PESTLE_FACETS}))
FOUND = f"""found AS (
  SELECT * FROM articles WHERE lang = 'en' AND country = 'us' AND source IN ({SOURCE_NAMES})
    AND rank <= {MAX_RANK} AND published >= DATE '{q.SINCE}'
    AND published < DATE '{q.UNTIL}' AND {keywords('summary')}),
sentences AS (
  SELECT article_id, (generate_subscripts({split('summary')}, 1) - 1)::INTEGER AS pos,
    unnest({split('summary')}) AS sentence
  FROM found),
cleaned AS (SELECT article_id, pos, {clean('sentence')} AS text FROM sentences)"""


def review(stage: str, names: list[str], *parts: str) -> str:
    """Evidence in ``best`` → report, and the lists as JSON in facet order."""
    digest = (
        "length(prompt) || ' characters' || chr(10) || '- digest ' || md5(prompt) || chr(10) || '- end'"
    )
    if stage == "swot_summary":
        listed = ", ".join(
            f"coalesce(max(to_json(evidence)) FILTER (facet = '{f}'), '[]') AS {f}" for f in names
        )
        prompt = f"'{rp.SWOT_SUMMARY}'"
        for f in names:
            prompt = f"replace({prompt}, '{{{f}}}', {f})"
        prompt = f"replace({prompt}, '{{subject}}', '{q.SUBJECT}')"
        text = f"(SELECT 'Strengths: ' || {digest} FROM (SELECT {prompt} AS prompt FROM (SELECT {listed} FROM lists)))"
    else:
        prompt = (
            f"replace(replace(replace('{rp.PESTLE_SUMMARY}', '{{subject}}', '{q.SUBJECT}'), "
            "'{facet}', facet), '{evidence}', to_json(evidence))"
        )
        text = (
            f"(SELECT string_agg([{text_list(PESTLE_TITLES.values())}][o] || ':' || chr(10) || {digest}, "
            f"chr(10) || chr(10) ORDER BY o) FROM (SELECT o, {prompt} AS prompt FROM lists))"
        )
    return ctes(*parts) + f""", lists AS (
  SELECT facet, list_position([{text_list(names)}], facet) AS o, list(text ORDER BY rk) AS evidence
  FROM best GROUP BY facet)
SELECT '{q.SUBJECT}' AS subject, '{stage}' AS stage, {text} AS report,
  to_json(list(evidence ORDER BY o))::VARCHAR AS evidence FROM lists"""


ORACLE: dict[str, str] = {
    # sources
    "src_articles": ctes(ARTICLES) + "SELECT * FROM articles",
    "src_posts_json": ctes(POSTS)
    + "SELECT * REPLACE (coalesce(body, '') AS body, coalesce(parent_id, '') AS parent_id)"
    " FROM posts",
    "src_tweets": ctes(TWEETS) + "SELECT * FROM tweets",
    "src_similarity_long": ctes(CENTROIDS)
    + ", classes AS (SELECT f, list(x ORDER BY i) AS d FROM "
    "(SELECT vec_id % 6 AS f, i, avg(x) AS x FROM axes GROUP BY ALL) GROUP BY f) "
    "SELECT label::VARCHAR AS src_a, f::VARCHAR AS src_b, "
    f"round(list_cosine_similarity(c, d), {q.SIM_DIGITS}) AS sim FROM centroids CROSS JOIN classes",
    # filters
    "kw_title": where("articles", "article_id, title", keywords("title"), ARTICLES),
    "kw_phrase": where(
        "articles",
        "article_id, title",
        f"({has_term('summary', 'the or and')}) OR ({has_term('summary', 'of')} AND "
        f"{has_term('summary', 'and the')})",
        ARTICLES,
    ),
    "kw_index": where("articles", "article_id, source", keywords("summary"), ARTICLES),
    "kw_summary": where("articles", "article_id, source", keywords("summary"), ARTICLES),
    "flt_lang": where("articles", "article_id, lang", "lang = 'en'", ARTICLES),
    "flt_country": where("articles", "article_id, country", "country = 'us'", ARTICLES),
    "flt_sources": where(
        "articles", "article_id, source", f"source IN ({SOURCE_NAMES})", ARTICLES
    ),
    "flt_rank": where("articles", "article_id, rank", f"rank <= {MAX_RANK}", ARTICLES),
    "flt_dates": where(
        "articles",
        "article_id, published",
        f"published >= DATE '{q.SINCE}' AND published < DATE '{q.UNTIL}'",
        ARTICLES,
    ),
    "flt_topics": where(
        "articles", "article_id, topic", f"topic IN ({GROUP_TOPICS})", ARTICLES
    ),
    "tw_user": where("tweets", "tweet_id, username", f"username = '{USERNAME}'", TWEETS),
    "tw_hashtags": where("tweets", "tweet_id, text", TAGGED, TWEETS),
    "tw_window": where(
        "tweets",
        "tweet_id, ts",
        f"ts >= DATE '{q.TODAY}' - 7 AND ts < DATE '{q.TODAY}'",
        TWEETS,
    ),
    "tw_originals": where(
        "tweets", "tweet_id, username", "NOT is_retweet AND NOT is_reply", TWEETS
    ),
    "po_subreddit": where("posts", "id, subreddit", f"subreddit = '{q.COMMUNITY}'", POSTS),
    "po_has_url": where("posts", "id, url", "url IS NOT NULL", POSTS),
    "po_placeholders": where(
        "posts",
        "id, body",
        f"body IS NOT NULL AND body NOT IN ({text_list(PLACEHOLDERS)})",
        POSTS,
    ),
    # scalar functions
    "po_defaults": ctes(POSTS)
    + "SELECT id, coalesce(body, '') AS body, coalesce(parent_id, '') AS parent_id FROM posts",
    "tx_sentences": f"SELECT doc_id AS article_id, array_to_string({split('text')}, '|') "
    f"AS sentences, len({split('text')}) AS n FROM documents",
    "tx_clean": ctes(TWEETS) + f"SELECT tweet_id, {clean('text')} AS clean FROM tweets",
    "tx_clean_array": ctes(SENTENCES)
    + "SELECT article_id, string_agg(text, '|' ORDER BY pos) AS sentences FROM cleaned "
    "GROUP BY article_id",
    "tx_hashtags": ctes(TWEETS)
    + "SELECT tweet_id, array_to_string(list_append(regexp_extract_all(lower(text), "
    "'#\\w+'), '#x'), ' OR ') AS tags FROM tweets",
    "tx_username": "SELECT event_id, '@user' || user_id AS username FROM events",
    "tx_criteria": "SELECT user_id, 'from:user' || user_id || ' since:' || "
    "strftime(max(ts)::DATE - 7, '%Y-%m-%d') || ' until:' || strftime(max(ts), '%Y-%m-%d') "
    "|| ' exclude:retweets exclude:replies' AS criteria FROM events GROUP BY user_id",
    "tx_preview": f"SELECT doc_id AS article_id, substring(text, 1, {PREVIEW_CHARS}) "
    "AS trimmed_text FROM documents",
    "tx_bullets": "SELECT doc_id AS article_id, replace(replace(text, '. ', ' - '), ' -', "
    "chr(10) || '-') AS bullets FROM documents",
    "dt_default_window": "SELECT event_id, strftime(ts, '%Y-%m-%d') AS until, "
    "strftime(ts::DATE - 7, '%Y-%m-%d') AS since FROM events",
    "tx_sentiment_label": ctes(SENTENCES, SENTIMENT)
    + "SELECT article_id, pos, CASE WHEN polarity < 0 THEN 'Negative' WHEN polarity = 0 "
    "THEN 'Neutral' ELSE 'Positive' END AS sentiment FROM sentiments",
    # scores
    "tx_polarity": ctes(SENTENCES, SENTIMENT)
    + "SELECT article_id, pos, polarity FROM sentiments",
    "tx_subjectivity": ctes(SENTENCES, SENTIMENT)
    + "SELECT article_id, pos, subjectivity FROM sentiments",
    "enc_terms": ctes(SENTENCES, SWOT, encoded("cleaned", "article_id, pos", "text"))
    + "SELECT article_id, pos, bucket::INTEGER AS bucket, n::INTEGER AS n FROM text_terms",
    "enc_model": "SELECT doc_id AS article_id, "
    + ", ".join(
        f"(length(text) - length(replace(text, '{v}', '')))::DOUBLE AS {v}" for v in "aeiou"
    )
    + " FROM documents",
    "sim_sparse": ctes(PESTLE, encoded("documents", "doc_id", "text"))
    + "SELECT doc_id AS article_id, facet, dot, dot::DOUBLE / sqrt(nt::DOUBLE * nf::DOUBLE) "
    "AS sim FROM dots JOIN text_norms USING (doc_id) JOIN facet_norms USING (facet)",
    "sim_dense": ctes(CENTROIDS)
    + "SELECT vec_id, c.label AS facet, round(list_cosine_similarity(embedding::DOUBLE[], "
    f"c.c), {q.SIM_DIGITS}) AS sim FROM embeddings CROSS JOIN centroids c",
    "dense_evidence": ctes(CENTROIDS)
    + ", scored AS (SELECT vec_id, c.label AS facet, list_cosine_similarity("
    "embedding::DOUBLE[], c.c) AS sim FROM embeddings CROSS JOIN centroids c), "
    + best(PESTLE_K, "vec_id")
    + f" SELECT facet, rk, vec_id, round(sim, {q.SIM_DIGITS}) AS sim FROM best",
    "tx_polarity_rules": ctes(SENTENCES, RULED)
    + ", ".join(
        [
            "SELECT c.article_id, c.pos",
            *(f"round(CASE WHEN z.n > 0 THEN z.{a} / z.n ELSE 0.0 END, {q.SIM_DIGITS}) + 0.0 AS {b}" for a, b in (("p", "polarity"), ("s", "subjectivity"))),
        ]
    )
    + " FROM cleaned c LEFT JOIN folded USING (article_id, pos)",
    "em_scores": ctes(EMOTION) + "SELECT id, emotion, score FROM scores",
    "em_model": ctes(POSTS)
    + f""", usable AS (
  SELECT id, body FROM posts
  WHERE body IS NOT NULL AND body NOT IN ({text_list(PLACEHOLDERS)})),
scores AS (
  SELECT id, [{text_list(EMOTIONS)}][27 - j] AS emotion,
    (length(body) * (j + 1) % 97)::DOUBLE AS score
  FROM usable CROSS JOIN range(27) r(j))
SELECT id, emotion AS top_emotion, score AS top_score FROM scores
QUALIFY row_number() OVER (PARTITION BY id ORDER BY score DESC, emotion) = 1""",
    # joins
    "jn_score_pairs": ctes(SENTENCES, SWOT, scored("cleaned", "article_id, pos", "text"))
    + "SELECT article_id, pos, facet, sim FROM scored",
    "jn_zip_explode": ctes(SENTENCES, SWOT, encoded("cleaned", "article_id, pos", "text"))
    + "SELECT article_id, facet, text AS sentence, coalesce(dot, 0) AS dot FROM cleaned "
    "CROSS JOIN (SELECT facet FROM facet_norms) LEFT JOIN dots USING (article_id, pos, facet)",
    "similar_sources": ctes(CENTROIDS)
    + "SELECT a.label AS source, b.label AS similar, row_number() OVER (PARTITION BY a.label "
    "ORDER BY list_cosine_similarity(a.c, b.c) DESC, b.label) AS rk, "
    f"round(list_cosine_similarity(a.c, b.c), {q.SIM_DIGITS}) AS sim "
    "FROM centroids a JOIN centroids b ON a.label <> b.label "
    f"QUALIFY rk <= {SIMILAR_TAKE}",
    # explode, limit, top-k
    "tx_explode": ctes(SENTENCES) + "SELECT article_id, pos, sentence FROM sentences",
    "po_limit": ctes(POSTS)
    + "SELECT id, created, url FROM posts WHERE url IS NOT NULL "
    f"ORDER BY created DESC, id LIMIT {q.POST_LIMIT}",
    "tw_latest": ctes(TWEETS)
    + "SELECT tweet_id, ts FROM tweets ORDER BY ts DESC, tweet_id DESC "
    f"LIMIT {q.TWEET_LIMIT}",
    "swot_articles": SWOT_BEST + "SELECT * FROM best",
    "swot_posts": ctes(
        POSTS,
        SWOT,
        "bodies AS (SELECT id, coalesce(body, '') AS text FROM posts)",
        scored("bodies", "id", "text"),
        best(SWOT_POSTS_K, "id"),
    )
    + "SELECT * FROM best",
    "swot_tweets": ctes(
        TWEETS,
        SWOT,
        f"messages AS (SELECT tweet_id, {clean('text')} AS text FROM tweets)",
        scored("messages", "tweet_id", "text"),
        best(SWOT_TWEETS_K, "tweet_id"),
    )
    + "SELECT * FROM best",
    "pestle_articles": PESTLE_BEST + "SELECT * FROM best",
    "swot_distinct": ctes(
        SENTENCES, SWOT, DISTINCT, scored("distinct_texts", "text", "text"), best(50, "text")
    ).replace("t.text, t.text AS text", "t.text")
    + "SELECT * FROM best",
    # aggregates, sets
    "evidence_lists": SWOT_BEST
    + "SELECT facet, count(*) AS n, string_agg(text, '|' ORDER BY rk) AS evidence "
    "FROM best GROUP BY facet",
    "source_centroids": ctes(CENTROIDS)
    + f"SELECT label, (i - 1)::INTEGER AS pos, round(x, {q.SIM_DIGITS}) AS x FROM means",
    "union_batches": ctes(POSTS, TWEETS)
    + "SELECT id, body AS text, subreddit, NULL AS username FROM posts UNION ALL "
    "SELECT tweet_id::VARCHAR, text, NULL, username FROM tweets",
    # emotion map
    "em_top": ctes(EMOTION) + "SELECT id, top_emotion FROM topped",
    "em_one": ctes(EMOTION)
    + "SELECT id, top_emotion FROM topped WHERE top_emotion = 'caring'",
    "em_counts": ctes(EMOTION) + "SELECT top_emotion, n FROM counts",
    "em_codes": ctes(EMOTION)
    + "SELECT id, top_emotion, code FROM topped JOIN counts USING (top_emotion)",
    "em_top10": ctes(EMOTION)
    + "SELECT id, top_emotion FROM topped SEMI JOIN kept USING (top_emotion)",
    "em_axes": ctes(EMOTION, fisher_axes("topped")).replace("WITH", "WITH RECURSIVE", 1)
    + "SELECT id, x, y, z FROM coordinates",
    "em_palette": ctes(EMOTION)
    + ", own AS (SELECT emotion AS top_emotion, '#' || upper(substr(md5(min(term)), 1, 6)) AS colour FROM lexicon GROUP BY emotion) "
    "SELECT id, top_emotion, colour FROM topped LEFT JOIN own USING (top_emotion)",
    "em_colours": ctes(EMOTION)
    + "SELECT id, top_emotion, colour FROM topped LEFT JOIN palette USING (top_emotion)",
    "em_labels": ctes(EMOTION)
    + f"""SELECT id, text, top_emotion, code, substring(text, 1, {PREVIEW_CHARS}) AS trimmed_text,
  colour, CASE WHEN (SELECT sum(n) FROM kept) > 10000 THEN 1.0::DOUBLE
    WHEN (SELECT sum(n) FROM kept) > 1000 THEN 1.5 ELSE 2.0 END AS dot_size
FROM topped JOIN kept USING (top_emotion) JOIN usable USING (id)
LEFT JOIN palette USING (top_emotion)""",
    "em_xyz": ctes(EMOTION, axes("topped")).replace("WITH", "WITH RECURSIVE", 1)
    + "SELECT * FROM coordinates",
    "knn_exact": f"""SELECT a.vec_id AS id, b.vec_id AS neighbour,
  row_number() OVER (PARTITION BY a.vec_id ORDER BY
    list_distance(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), b.vec_id) AS rk,
  round(list_distance(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) ** 2, {q.SIM_DIGITS})
    AS dist2
FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0 QUALIFY rk <= {NEIGHBOURS}""",
    # whole tables and reports
    "articles_table": where(
        "articles",
        "*",
        f"lang = 'en' AND country = 'us' AND source IN ({SOURCE_NAMES}) AND "
        f"rank <= {MAX_RANK} AND published >= DATE '{q.SINCE}' AND "
        f"published < DATE '{q.UNTIL}' AND {keywords('summary')}",
        ARTICLES,
    ),
    "posts_table": ctes(POSTS)
    + "SELECT * REPLACE (coalesce(body, '') AS body, coalesce(parent_id, '') AS parent_id) "
    f"FROM posts WHERE subreddit = '{q.COMMUNITY}' AND url IS NOT NULL "
    f"ORDER BY created DESC, id LIMIT {q.POST_LIMIT}",
    "tweets_user_table": latest(
        f"username = '{USERNAME}' AND NOT is_retweet AND NOT is_reply AND "
        f"ts >= DATE '{q.TODAY}' - 7 AND ts < DATE '{q.TODAY}'"
    ),
    "tweets_hashtag_table": latest(
        f"{TAGGED} AND NOT is_retweet AND NOT is_reply AND "
        f"ts >= DATE '{q.SINCE}' AND ts < DATE '{q.UNTIL}'"
    ),
    "seed_rows": "SELECT subject, stage, facet, replace(replace(template, '{subject}', "
    "subject), '{facet}', facet) AS prompt, max_tokens, temperature, frequency_penalty, "
    "presence_penalty FROM (SELECT DISTINCT source AS subject FROM documents) CROSS JOIN "
    "(VALUES "
    + ", ".join(
        f"('{stage}', '{f}', '{t}', {n[0]}, {n[1]}::DOUBLE, {n[2]}::DOUBLE, {n[3]}::DOUBLE)"
        for stage, f, t, n in [
            *[("swot_seed", f, t, rp.SWOT_SEED_NUMBERS) for f, t in rp.SWOT_SEEDS.items()],
            *[
                ("pestle_seed", f, rp.PESTLE_SEED, rp.PESTLE_SEED_NUMBERS)
                for f in PESTLE_FACETS
            ],
        ]
    )
    + ") AS t(stage, facet, template, max_tokens, temperature, frequency_penalty, "
    "presence_penalty)",
    "prompt_rows": PROMPTS
    + "SELECT * REPLACE (temperature::DOUBLE AS temperature, frequency_penalty::DOUBLE AS "
    "frequency_penalty, presence_penalty::DOUBLE AS presence_penalty) FROM prompts",
    "report_rows": PROMPTS
    + f""", completed AS (
  SELECT subject, stage, list_position([{text_list(PESTLE_FACETS)}], facet) AS o,
    [{text_list(PESTLE_TITLES.values())}][o] AS title,
    length(prompt) || ' characters' || chr(10) || '- digest ' || md5(prompt) || chr(10)
      || '- end' AS points FROM prompts)
SELECT subject, stage, string_agg(CASE WHEN stage = 'swot_summary' THEN 'Strengths: ' || points
  ELSE title || ':' || chr(10) || points END, chr(10) || chr(10) ORDER BY o) AS report
FROM completed GROUP BY subject, stage""",
    "review_articles": review(
        "swot_summary",
        SWOT_FACETS,
        ARTICLES,
        FOUND,
        SEEDED_SWOT,
        scored("cleaned", "article_id, pos", "text"),
        best(SWOT_ARTICLES_K, "article_id, pos"),
    ),
    "review_pestle": review(
        "pestle_summary",
        PESTLE_FACETS,
        ARTICLES,
        FOUND,
        SEEDED_PESTLE,
        DISTINCT,
        scored("distinct_texts", "text", "text"),
        best(PESTLE_K, "text"),
    ).replace("t.text, t.text AS text", "t.text"),
    "review_posts": review(
        "swot_summary",
        SWOT_FACETS,
        POSTS,
        SEEDED_SWOT,
        f"bodies AS (SELECT id, coalesce(body, '') AS text FROM posts WHERE subreddit = "
        f"'{q.COMMUNITY}' AND url IS NOT NULL ORDER BY created DESC, id LIMIT {q.POST_LIMIT})",
        scored("bodies", "id", "text"),
        best(SWOT_POSTS_K, "id"),
    ),
    "review_tweets": review(
        "swot_summary",
        SWOT_FACETS,
        TWEETS,
        SEEDED_SWOT,
        f"messages AS (SELECT tweet_id, {clean('text')} AS text FROM (SELECT * FROM tweets "
        f"WHERE {TAGGED} AND NOT is_retweet AND NOT is_reply AND ts >= DATE '{q.SINCE}' AND "
        f"ts < DATE '{q.UNTIL}' ORDER BY ts DESC, tweet_id DESC LIMIT {q.TWEET_LIMIT}))",
        scored("messages", "tweet_id", "text"),
        best(SWOT_TWEETS_K, "tweet_id"),
    ),
    "tw_landed": ctes(TWEETS) + "SELECT tweet_id, ts, username FROM tweets",
    "tx_criteria_tags": "SELECT event_type, '#' || event_type || ' OR #x since:' || "
    "strftime(max(ts)::DATE - 7, '%Y-%m-%d') || ' until:' || strftime(max(ts), '%Y-%m-%d') "
    "|| ' exclude:retweets exclude:replies' AS criteria FROM events GROUP BY event_type",
    "out_csv_evidence": SWOT_BEST
    + "SELECT facet, to_json(list(text ORDER BY rk))::VARCHAR AS evidence FROM best GROUP BY facet",
    "out_parquet_articles": ctes(ARTICLES) + "SELECT * FROM articles",
    "out_json_records": ctes(POSTS)
    + "SELECT to_json({'type': type, 'author': author, 'body': body, 'id': id, "
    "'parent_id': parent_id, 'url': url})::VARCHAR AS record FROM posts",
}

ORACLE["em_top_array"] = ORACLE["em_model"].replace(
    "SELECT id, emotion AS top_emotion, score AS top_score", "SELECT id, emotion AS top_emotion"
)
ORACLE["em_plot_table"] = ctes(
    EMOTION,
    "staying AS (SELECT id FROM topped SEMI JOIN kept USING (top_emotion))",
    axes("staying"),
    "labels AS (" + ORACLE["em_labels"].removeprefix(ctes(EMOTION)) + ")",
).replace("WITH", "WITH RECURSIVE", 1) + "SELECT * FROM labels JOIN coordinates USING (id)"
ORACLE["em_plot_supervised"] = ctes(
    EMOTION,
    "staying AS (SELECT id, top_emotion FROM topped SEMI JOIN kept USING (top_emotion))",
    fisher_axes("staying"),
    "labels AS (" + ORACLE["em_labels"].removeprefix(ctes(EMOTION)) + ")",
).replace("WITH", "WITH RECURSIVE", 1) + "SELECT * FROM labels JOIN coordinates USING (id)"
ORACLE["knn_graph"] = ORACLE["knn_exact"].replace("WHERE a.vec_id % 50 = 0 ", "")
ORACLE["out_published"] = ORACLE["review_articles"]
ORACLE["po_newest"] = (
    ctes(POSTS)
    + f"""SELECT subreddit, row_number() OVER (PARTITION BY subreddit ORDER BY created DESC, id) AS rk, id, created, author
FROM posts QUALIFY rk <= {q.POST_LIMIT}"""
)
