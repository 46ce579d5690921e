"""Toxicity, fertility, personal data and pages: brute force and held-out accuracy."""

import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumenfold.llm import fertility as fe
from lumenfold.llm import html_blocks as hb
from lumenfold.llm import html_crf as hc
from lumenfold.llm import pii
from lumenfold.llm import toxicity as tox
from lumenfold.llm.queries import QUERIES

ODD = [None, "", " \n\t", "a" * 30_000, "wörd " * 3000, "\U0001f600 ok ​", "x\x00y"]


def frame(spark, rows):
    """Ids with nulls and repeats, and columns whose names an operator uses itself."""
    return spark.createDataFrame([(i, t, "en", "s", 1.5, 0) for i, t in rows], "doc_id long, text string, lang string, source string, score double, size int")


# ---- toxicity ---------------------------------------------------------------


def labelled(n, seed):
    rng = random.Random(seed)
    words = ["".join(rng.choice("abcdefgh") for _ in range(4)) for _ in range(300)]
    bad = ["zorf", "plick", "gruud"]
    rows = []
    for i in range(n):
        text = [rng.choice(words) for _ in range(rng.randrange(5, 80))]
        label = int(rng.random() < 0.2)
        if label:
            text.insert(rng.randrange(len(text)), rng.choice(bad))
        rows.append((i, " ".join(text), label))
    return rows


def test_toxicity_learns_and_is_sparse(spark):
    rows = labelled(1500, 1)
    docs = frame(spark, [(i, t) for i, t, _ in rows] + [(None, "zorf"), (1, "zorf repeated id")])
    labels = spark.createDataFrame([(i, y) for i, _, y in rows[:1000]] + [(None, 1), (5000, 1), (2, None)], "doc_id long, toxic int")
    model = tox.fit(docs, labels)
    again = tox.fit(docs, labels)
    assert np.array_equal(model[0], again[0]) and np.array_equal(model[1], again[1])
    assert len(model[0]) < 500
    of = tox.scorer(*model)
    wrong = sum((of(t) >= 0.7) != y for _, t, y in rows[1000:])
    assert wrong <= 2
    scored = tox.score(docs, model).collect()
    assert len(scored) == 1502 and all(0 <= r.score <= 1 for r in scored)
    kept = tox.drop_toxic(docs, model)
    assert kept.columns == docs.columns
    assert abs(kept.filter("doc_id >= 1000").count() - sum(1 - y for _, _, y in rows[1000:])) <= 2


def test_toxicity_edges(spark):
    docs = frame(spark, list(enumerate(ODD)) + [(None, None)])
    none = spark.createDataFrame([], "doc_id long, toxic int")
    model = tox.fit(docs, none)
    assert [r.score for r in tox.score(docs, model).collect()] == [0.5] * (len(ODD) + 1)
    assert tox.score(frame(spark, []), model).count() == 0
    held = frame(spark, [(i, "") for i in range(50)] + [(None, "")]).select("doc_id", tox.held_out(F.col("doc_id")).alias("h"))
    import zlib

    assert {r.doc_id: r.h for r in held.collect()} == {None: False, **{i: zlib.crc32(str(i).encode()) % 3 == 1 for i in range(50)}}


# ---- fertility --------------------------------------------------------------


def brute_counts(t):
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    tri = [tuple(w[k : k + 3]) for k in range(len(w) - 2)]
    n, cover, seen, dup = Counter(tri), set(), set(), 0
    for k, x in enumerate(tri):
        if n[x] > 1:
            cover |= {k, k + 1, k + 2}
    for line in t.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), dup, len(cover)


def test_fertility_counts(spark):
    rng = random.Random(4)
    texts = ODD + ["".join(rng.choice("ab c\n# ") for _ in range(rng.randrange(120))) for _ in range(80)]
    got = fe.quality(frame(spark, list(enumerate(texts)) + [(None, "a")])).collect()
    assert len(got) == len(texts) + 1
    for r in got:
        if r.doc_id is not None:
            t = texts[r.doc_id] or ""
            counts = brute_counts(t)
            assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == counts, t[:50]
            assert r.base_failed == (counts[0] < 50 or 100 * counts[4] > 50 * counts[0])
            assert not (r.base_failed and r.kept)
    assert fe.quality(frame(spark, [])).count() == 0


def test_fertility_measures_and_script():
    import sentencepiece

    from lumenfold.llm.tokens import public_path

    model = sentencepiece.SentencePieceProcessor(model_file=public_path("piece_bpe_32k.model"))
    words = "the Cat sat on Бег \U0001f600 the".split()
    ids = [i for w in words for i in model.encode(w)]
    n, per, byte, entropy = fe.Fertility(public_path("piece_bpe_32k.model")).measure([w.encode() for w in words], 22)
    share = np.array(list(Counter(ids).values())) / len(ids)
    assert (n, per) == (len(ids), 22 / len(ids))
    assert byte == pytest.approx(np.mean([model.is_byte(i) for i in ids]))
    assert entropy == pytest.approx(-(share * np.log2(share)).sum())
    assert [fe.script(t) for t in ("Бег a", "漢字", "", "12")] == ["Cyrillic", "Han", "Other", "Other"]


def test_fertility_rejects_junk_and_keeps_clean(spark):
    folder = "/root/testdata/sf0.01"
    got = QUERIES["op4_fertility"](spark, folder).join(spark.read.parquet(f"{folder}/labels.parquet"), "doc_id")
    n = {(r.quality, r.kept): r["count"] for r in got.groupBy("quality", "kept").count().collect()}
    assert n.get((0, True), 0) <= 3
    clean = got.filter("quality = 1 and not base_failed")
    assert clean.filter("not kept").count() <= 0.03 * clean.count()


# ---- personal data ----------------------------------------------------------


def brute_spans(t):
    def luhn(s):
        d = [int(c) for c in s[::-1]]
        return (sum(d[0::2]) + sum(sum(divmod(2 * x, 10)) for x in d[1::2])) % 10 == 0

    out = [(m.start(), 0, m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [(m.start(), 1, m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(p) <= 255 for p in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t):
        s = re.sub("[^0-9]", "", m[0])
        out += [(m.start(), 2, m.end())] * (14 <= len(s) <= 19 and luhn(s))
    out += [(m.start(), 3, m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 10 <= len(re.sub("[^0-9]", "", m[0])) <= 15]
    return [(a, b, pii.KINDS[k]) for a, k, b in sorted(out)]


def test_base_spans_equal_the_rules():
    rng = random.Random(5)
    parts = ["a@b.c", "@", ".", "1", "22", "256", "+1", "4111 1111-1111 1111", "(", " ", "-", "a.b", "é", "9.9.9.9", "+49 (30) 123456-78", "0" * 30]
    for _ in range(4000):
        t = "".join(rng.choice(parts) for _ in range(rng.randrange(12)))
        assert pii.base_spans(t) == brute_spans(t), t


DISGUISED = {
    "write to bob.smith (at) mail (dot) example (dot) com now": ("email", "bob.smith (at) mail (dot) example (dot) com"),
    "or jane [at] host.org": ("email", "jane [at] host.org"),
    "joe at mail dot example dot com.": ("email", "joe at mail dot example dot com"),
    "bob @ mail . example . com": ("email", "bob @ mail . example . com"),
    "ｂｏｂ＠ｍａｉｌ．ｃｏｍ": ("email", "ｂｏｂ＠ｍａｉｌ．ｃｏｍ"),
    "é аlice@mаil.com!": ("email", "аlice@mаil.com"),
    "b​ob@ma​il.com": ("email", "b​ob@ma​il.com"),
    "call plus one two zero two five five five zero one four three": ("phone", "plus one two zero two five five five zero one four three"),
    "192 dot 168 dot 10 dot 1": ("ip", "192 dot 168 dot 10 dot 1"),
    "192[.]168[.]1[.]1": ("ip", "192[.]168[.]1[.]1"),
    "four" + " one" * 15: ("card", "four" + " one" * 15),
}


@pytest.mark.parametrize("text", DISGUISED)
def test_disguises_map_back_to_the_source(text):
    (a, b, kind), = pii.spans(text)
    assert (kind, text[a:b]) == DISGUISED[text]
    assert pii.redact(text) == text[:a] + f"[{kind.upper()}]" + text[b:]


@pytest.mark.parametrize(
    "text",
    ["+one 202 555 0143", "plus 1 202 555 0143", "+1 dash 202 dash 555 dash 0143", "+1 minus 202 555 01 minus 43", "+1 202 55 014 three", "bob@mail . com", "bob at mail . com"],
)
def test_disguises_need_no_other_hint(text):
    (a, b, _), = pii.spans(text)
    assert (a, b) == (0, len(text))


@pytest.mark.parametrize(
    ("text", "kind", "plain"),
    [
        ("john dot smith@mail.com", "email", "smith@mail.com"),
        ("jane@mail.co dot uk", "email", "jane@mail.co"),
        ("аlice@mail.com", "email", "lice@mail.com"),
        ("+1 202 555 014 three", "phone", "+1 202 555 014"),
    ],
)
def test_partly_disguised_identifiers_are_whole(text, kind, plain):
    at = text.index(plain)
    want = {(0, len(text), kind), (at, at + len(plain), kind)}
    assert set(pii.spans(f"{text}, ok")) == want and len(pii.spans(text)) == 2
    assert set(pii.base_spans(text)) <= set(pii.spans(text))
    assert pii.redact(f"to {text}, ok") == f"to [{kind.upper()}], ok"


def test_hint_covers_all_that_is_rewritten():
    rng = random.Random(11)
    words = "one two sept un null plus dash minus dot punkt at arroba bob mail com it 1 202 555 0143 + @ . , - _ ( ) [ ] é \u017f".split() + ["b​c"]
    changed = 0
    for _ in range(60_000):
        t = "".join(rng.choice(words) + rng.choice(["", " ", " ", " ", "-", "  "]) for _ in range(rng.randrange(1, 10)))
        if pii.normalise(t).text != t:
            changed += 1
            assert pii._HINT.search(t), t
        if rng.random() < 0.2:
            assert pii.spans(t) == pii.spans(t + " ’"), t
    assert changed > 1000


@pytest.mark.parametrize("text", ["meet at noon at example.com", "one two three", "look at it. dot", "1, 2, 3, 4, 5", ""])
def test_plain_text_has_none(text):
    assert pii.spans(text) == []


def test_find_rows(spark):
    rows = [(1, "a@b.cc and x (at) y.com"), (1, None), (None, "9.9.9.9")] + [(9, t) for t in ODD]
    got = pii.find(frame(spark, rows)).collect()
    assert len(got) == len(rows)
    first = got[0]
    assert (first.n_email, [tuple(s) for s in first.base]) == (1, [("email", 0, 6)])
    assert [tuple(s) for s in first.spans] == [("email", 0, 6), ("email", 11, 23)]
    assert sum(r.n_ip for r in got) == 1
    assert pii.find(frame(spark, [])).count() == 0


# ---- pages ------------------------------------------------------------------


def test_blocks_forgive():
    found = hb.blocks("<p>One <b>two<br>three<p title='>'>Four&amp;five &lt;<script>x<p>y</script> six</p>< 7<!-- <p>no --><li>a<li class=ad>b</ul>")
    assert [b.text for b in found] == ["One two three", "Four&five < six", "< 7", "a", "b"]
    assert "advert" in found[-1].kinds
    for bad in ("", "<", "<p", "text <b", "</p></p>", '<a href="x>y', "<!--", "<script>", "&#xZZ; &am", "<p " + 'a="' * 3000, "<div>" * 3000 + "deep"):
        hb.blocks(bad)


def test_field_on_other_labelled_pages():
    weights, moves = (a.tolist() for a in hc.model())
    wrong = total = 0
    for page in hc.labelled_pages(150, seed=99):
        got = hc.decode([b for b, _ in page], weights, moves)
        wrong += sum(g != y for g, (_, y) in zip(got, page, strict=True))
        total += len(page)
    assert wrong < 0.02 * total


def test_viterbi_is_the_best_path():
    from itertools import product

    weights, moves = (a.tolist() for a in hc.model())
    for page in hc.labelled_pages(60, seed=5):
        found = [b for b, _ in page][:9]
        emit = [sum(weights[i] for i in f) for f in hc.features(found)]
        score = lambda y: sum(e for e, k in zip(emit, y, strict=True) if k) + sum(moves[a][b] for a, b in zip(y, y[1:], strict=False))
        best = max(product((0, 1), repeat=len(found)), key=score)
        assert score(hc.decode(found, weights, moves)) == pytest.approx(score(best))


def test_extract_equals_the_article(spark, folder):
    import html

    got = {r.page_id: r for r in QUERIES["op9_html_crf"](spark, folder).collect()}
    for r in spark.read.parquet(f"{folder}/pages.parquet").collect():
        inside = re.search(r"<article>(.*?)(?:</article>|$)", r.html, re.S)[1]
        parts = [" ".join(html.unescape(re.sub(r"<[^>]*>", "", x)).split()) for x in re.split(r"<(?:/?p|/?h1)>", inside)]
        want = "\n".join(x for x in parts if x)
        assert (got[r.page_id].text, got[r.page_id].n_chars) == (want, len(want))


def test_extract_rows(spark):
    schema = "page_id long, url string, html string, text int"
    rows = [(1, "u", None, 0), (1, None, "", 0), (None, "u", "<article><p>Some words here, and more.</p></article>", 0)]
    got = hc.extract(spark.createDataFrame(rows, schema)).collect()
    assert sorted((r.page_id or 0, r.text, r.n_chars) for r in got) == [(0, "Some words here, and more.", 26), (1, "", 0), (1, "", 0)]
    assert hc.extract(spark.createDataFrame([], schema)).count() == 0


def brute_bands(rows):
    """Bounds of each document by plain lists: the quartile bins of the documents that its
    band, length, script or the whole table has, of which the first with enough counts."""

    def edges(values, b, down, up):
        bins = sorted(int(np.floor(v / b + 0.5)) for v in values)
        q1, q2, q3 = (bins[max(0, -(-len(bins) * k // 4) - 1)] for k in (1, 2, 3))
        above = max(q3 - q2, 1)
        return (q2 - down * above) * b if down else -1.0, (q2 + up * max(q2 - q1, above)) * b

    told = [r for r in rows if r.tokens]
    size = {id(r): int(np.log2(r.tokens)) for r in told}
    out = []
    for r in rows:
        inside = True
        for m, (b, down, up) in fe.BANDS.items() if r.tokens else ():
            own = [x for x in told if (x.band, size[id(x)]) == (r.band, size[id(r)])]
            if m == "entropy":
                chain = [own, [x for x in told if size[id(x)] == size[id(r)]]]
            else:
                chain = [own, [x for x in told if x.band == r.band], [x for x in told if x.script == r.script]]
            found = next((c for c in chain if len(c) >= fe.LEAST), told)
            low, high = edges([x[m] for x in found], b, down, up)
            inside &= low <= x_of(r, m) <= high
        out.append(not r.base_failed and inside)
    return out


def x_of(row, measure):
    return row[measure]


def test_fertility_bands_by_brute_force(spark):
    """Many, some and few documents of a language, one language in two scripts, and junk."""
    rng = random.Random(12)
    vocabulary = {"en": "the of and cat dog house tree over under little".split(), "ru": "дом кот лес над под мало река".split()}
    rows = []
    for i in range(420):
        lang = "en" if i < 260 else "ru" if i < 340 else rng.choice(["xx", "yy", None])
        words = vocabulary["ru" if lang == "ru" or i % 7 == 0 else "en"]
        text = [rng.choice(words) + rng.choice(["", "a", "er", "ow"]) for _ in range(rng.choice([20, 60, 100, 200, 700]))]
        if i % 40 == 0:
            text = ["\U0001f600༺" * 3 + w for w in text]
        rows.append((i, " ".join(text), lang))
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = fe.quality(df).collect()
    assert [r.kept for r in got] == brute_bands(got)
    assert any(not r.kept and not r.base_failed for r in got)
    bare = fe.quality(df.drop("lang")).collect()
    assert [r.kept for r in bare] == brute_bands(bare) and all(r.band == r.script for r in bare)


@pytest.mark.parametrize("letter", sorted(pii._LOOKALIKES))
def test_every_lookalike_is_read(letter):
    text = f"write to x{letter}y@mail.com or {letter}nn@mail.com"
    found = {(a, b) for a, b, kind in pii.spans(text) if kind == "email"}
    assert {(9, 21), (25, 37)} <= found
    assert len(pii._LOOKALIKES[letter]) == 1 and pii._LOOKALIKES[letter].isascii()
