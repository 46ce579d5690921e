"""Secrets, conversations and the manifest: brute force, planted cases and odd input."""

import hashlib
import itertools
import math
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest
from check import compare, connect
from pyspark.sql import functions as F

from lumenfold.llm import conversations as cv
from lumenfold.llm import credentials as cr
from lumenfold.llm import merkle as mk
from lumenfold.llm.oracle import ORACLE
from lumenfold.llm.queries import QUERIES

H = lambda s: hashlib.sha256(s.encode()).hexdigest()


@pytest.mark.parametrize("name", ["op12_conversations", "op13_merkle"])
def test_agrees_with_sql(spark, folder, name):
    assert compare(spark, connect(folder), name, QUERIES[name], ORACLE[name], folder) == ""


# ---- manifest ---------------------------------------------------------------

DOCS = "doc_id long, source string, lang string, n_chars long, text string, key string, pos long, digest string"


def brute_leaf(row, text):
    parts = ["-" if v is None else f"{len(str(v).encode())}:{v}" for v in (*row[:4], text)]
    return H("".join(parts))


def brute_levels(leaves):
    out = [leaves]
    while len(out[-1]) > 1:
        out.append([H("".join(out[-1][i : i + 8])) for i in range(0, len(out[-1]), 8)])
    return out


def brute_path(levels, i):
    out = []
    for nodes in levels[:-1]:
        run = i - i % 8
        out.append((nodes[run:i], nodes[i + 1 : run + 8]))
        i //= 8
    return out


def brute_manifest(rows):
    langs = defaultdict(list)
    for r in rows:
        langs[r[2]].append((r, brute_leaf(r, r[4])))
    names = sorted(langs, key=lambda x: (x is not None, (x or "").encode()))
    trees = {}
    for name in names:
        langs[name].sort(key=lambda x: (x[0][0] is not None, x[0][0] or 0, x[1]))
        trees[name] = brute_levels([h for _, h in langs[name]])
    upper = brute_levels([trees[n][-1][0] for n in names])
    root = upper[-1][0]
    out = []
    for at, name in enumerate(names):
        for i, (r, leaf) in enumerate(langs[name]):
            path = brute_path(trees[name], i) + brute_path(upper, at)
            proof = "".join("".join(a) + "".join(b) for a, b in path)
            fold = leaf
            if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 3 == 0 and r[4] is not None:
                fold = brute_leaf(r, re.sub("[A-Z]", lambda m: m[0].lower(), r[4]))
            for a, b in path:
                fold = H("".join(a) + fold + "".join(b))
            out.append((r[0], leaf, trees[name][-1][0], root, H(proof), fold, fold == root))
    return out


def documents(n, seed, langs=("en", "de", None, "", "日本")):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        text = rng.choice([None, "", "a b", "Ab Üb", "X" * 2000, f"text {i}", f"Text {i}"])
        rows.append((i * 7 - 50, rng.choice(["s", None, "sé"]), rng.choice(langs), rng.choice([None, 5, -1]), text, "k", 1, "d"))
    rows += [(None, "s", "en", 1, "A", "k", 1, "d"), (None, None, "en", None, None, "k", 1, "d")]
    return rows + rows[:3] + [rows[0]] * 4 + [(rows[1][0], "other", *rows[1][2:])]


def manifest_rows(spark, rows):
    df = spark.createDataFrame(rows, DOCS)
    got = mk.manifest(df, mk.tampered())
    return got, got.select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified").collect()


@pytest.mark.parametrize("n, langs", [(0, ("en",)), (1, ("en",)), (400, ("en", "de", None, "", "日本")), (60, tuple(f"l{i}" for i in range(40)))])
def test_manifest_is_the_plain_tree(spark, n, langs):
    rows = documents(n, n, langs)
    _, got = manifest_rows(spark, rows)
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, brute_manifest(rows)))


def test_manifest_with_several_tiers(spark, monkeypatch):
    """Blocks of 64 leaves: the same tree through more tiers. Workers take what is set here
    by value, so the functions of a block are called with the patched sizes directly."""
    levels = brute_levels([H(str(i)) for i in range(1000)])
    monkeypatch.setattr(mk, "LEVELS", 2)
    monkeypatch.setattr(mk, "BLOCK", 64)
    tier = levels[0]
    tops = []
    while True:
        blocks = [mk.grow(tier[i : i + 64], mk.height(len(tier))) for i in range(0, len(tier), 64)]
        tops.append(blocks)
        if len(tier) <= 64:
            break
        tier = [b[-1][0] for b in blocks]
    assert len(tops) == 2 and tops[-1][0][-1][0] == levels[-1][0]
    i = 777
    path = mk.path(tops[0][i // 64], i % 64) + mk.path(tops[1][0], i // 64)
    assert [("".join(a), "".join(b)) for a, b in brute_path(levels, i)] == list(zip(path[::2], path[1::2]))
    assert mk.fold(levels[0][i], path)[-1] == levels[-1][0]


def test_manifest_over_one_block(spark):
    """More rows of one language than a block has, in more than one tier."""
    rows = [(i, "s", "en" if i % 50 else "fr", None, f"T{i}", "k", 1, "d") for i in range(9000)]
    found, got = manifest_rows(spark, rows)
    assert sorted(map(tuple, got)) == sorted(brute_manifest(rows))
    # A version is its copies and the nodes of the shared tree, and the copies hash their children.
    nodes = {(r.lang, r.level, r.pos): r.digest for r in mk.nodes(spark.createDataFrame(rows, DOCS)).collect()}
    some = found.filter("copies is not null and lang = 'en'").orderBy("doc_id").limit(40).collect()
    for r in some:
        own = {(c.level, c.pos): c.digest for c in r.copies if c.tree == 0}
        assert [c.level for c in r.copies] == [1, 2, 3, 4, 5, 1]
        for (level, pos), digest in own.items():
            if level > 1:
                run = [own.get((level - 1, p)) or nodes.get(("en", level - 1, p)) for p in range(pos * 8, pos * 8 + 8)]
                assert H("".join(x for x in run if x)) == digest
            assert (digest == nodes["en", level, pos]) == r.verified
        assert r.copies[-1].digest == r.folded_root


def test_manifest_of_nothing(spark):
    df = spark.createDataFrame([], DOCS)
    assert mk.manifest(df, mk.tampered()).collect() == []


# ---- conversations ----------------------------------------------------------


def brute_repair(rows):
    """All edit strings in order of cost: (cost, audit) by a shortest path over every state,
    with the strings themselves compared."""
    best = {(0, ""): (0, "")}  # (row, initials so far reduced to a state) -> (cost, audit)
    nxt = {"": "u", "s": "u", "u": "a", "a": "u"}

    def relax(i, state, cost, audit):
        if (i, state) not in best or (cost, audit) < best[i, state]:
            best[i, state] = (cost, audit)
            return True
        return False

    for i in range(len(rows) + 1):
        for _ in range(4):
            for state in ("", "s", "u", "a"):
                if (i, state) in best:
                    cost, audit = best[i, state]
                    relax(i, nxt[state], cost + 5, audit + "I")
        if i == len(rows):
            break
        initial, fault = rows[i]
        for state in ("", "s", "u", "a"):
            if (i, state) not in best:
                continue
            cost, audit = best[i, state]
            relax(i + 1, state, cost + 2, audit + "D")
            if fault in (cv.IS_BLANK, cv.IS_DUPLICATE):
                continue
            extra = 5 if fault == cv.IS_TRUNCATED else 0
            relax(i + 1, nxt[state], cost + extra + 1, audit + "R")
            if initial == nxt[state] or (initial == "s" and state == ""):
                relax(i + 1, initial, cost + extra, audit + "K")
    return min(best[len(rows), s] for s in ("", "a") if (len(rows), s) in best)


def test_walk_is_least_and_first():
    rng = random.Random(3)
    for _ in range(1500):
        n = rng.randrange(0, 12)
        rows = [(rng.choice("suax"), rng.choice([0, 0, 0, 1, 2, 3])) for _ in range(n)]
        cost, audits, _ = cv.walk(rows, cv.END, [cv.START], True)
        assert (cost, audits[0]) == brute_repair(rows)


def test_cells_walk_as_the_whole():
    rng = random.Random(4)
    for n in (1, 63, 64, 65, 200, 700):
        rows = [(rng.choice("suuaax"), rng.choice([0, 0, 0, 0, 1, 2, 3])) for _ in range(n)]
        cost, audits, _ = cv.walk(rows, cv.END, [cv.START], True)
        cuts = sorted({0, n, *(rng.randrange(n + 1) for _ in range(4))})
        parts = [rows[a:b] for a, b in itertools.pairwise(cuts)]
        after = cv._vectors(cv.END, [cv.matrix(p) for p in parts])
        assert cv.through(cv.joined([cv.matrix(p) for p in parts]), cv.END)[0] == cost
        state, got = 0, ""
        for k, (part, v) in enumerate(zip(parts, after)):
            _, edits, states = cv.walk(part, v, [0, 1, 2, 3], k == len(parts) - 1)
            got, state = got + edits[state], states[state]
        assert got == audits[0] and state in (0, 3)


CONV = "conv_id long, turn long, role string, text string, key string, cell long, row long, n int"


def brute_audit(rows):
    out = {}
    groups = defaultdict(list)
    sp = lambda v: " " if v is None else str(v)
    for c, t, role, text, *_ in rows:
        groups[c]
        kind = zlib.crc32(f"{sp(c)}:{sp(t)}".encode()) % 20
        role, text = sp(role), sp(text)
        if kind == 0:
            continue
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        groups[c] += [(t, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    for c, found in groups.items():
        found.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
        seen, faults = set(), []
        for _, role, text in found:
            body = text.rstrip(" \t\n\x0b\x0c\r")
            fault = 1 if not body else 2 if (role, text) in seen else 0 if body[-1] in ".!?" else 3
            faults.append(fault)
            seen.add((role, text))
        firsts = [role[:1] for _, role, _ in found]
        turns = [t for t, _, _ in found if t is not None]
        cost, audit = brute_repair(list(zip(firsts, faults))) if len(found) < 400 else cv.walk(list(zip(firsts, faults)), cv.END, [0], True)[:2]
        audit = audit if isinstance(audit, str) else audit[0]
        lines, rest, state = [], iter(found), ""
        nxt = {"": "u", "s": "u", "u": "a", "a": "u"}
        for e in audit:
            if e != "I":
                _, role, text = next(rest)
            if e == "D":
                continue
            state = role[:1] if e == "K" else nxt[state]
            full = {"u": "user", "a": "assistant"}
            lines.append(f"{role}:{text}" if e == "K" else f"{full[state]}:{'' if e == 'I' else text}")
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(firsts, firsts[1:]))
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        out[c] = (c, gaps, faults.count(1), faults.count(2), faults.count(3), illegal, cost, audit, H("\n".join(lines)))
    return sorted(out.values(), key=str)


def talk(n, seed):
    rng = random.Random(seed)
    rows = []
    for c in [*range(n), None]:
        for t in range(rng.randrange(1, 14)):
            role = rng.choice(["system", "user", "assistant", "user", "assistant", None, "", "tool"])
            text = rng.choice(["Yes.", "No!", "why?", "open", "", None, " \n", f"t{t}. ", "x." * 3000])
            rows.append((c, rng.choice([t, t, t, None, t * 2]), role, text, "k", 1, 1, 1))
    return rows + rows[:5] + [rows[0]] * 6


@pytest.mark.parametrize("n", [0, 150])
def test_audit_by_brute_force(spark, n):
    rows = talk(n, n) if n else []
    got = cv.audit(spark.createDataFrame(rows, CONV))
    assert sorted(map(tuple, got.collect()), key=str) == brute_audit(rows)


def test_audit_of_a_conversation_over_many_cells(spark, monkeypatch):
    """A conversation of 30,000 rows, which 8 range partitions and cells of 4,096 rows cut."""
    rng = random.Random(8)
    rows = [(5, t, rng.choice(["user", "assistant"]), f"line {t}{rng.choice('.!? ')}", "k", 1, 1, 1) for t in range(30_000)]
    rows += [(6, 0, "user", "hi.", "k", 1, 1, 1), (4, 1, "assistant", "ho.", "k", 1, 1, 1)]
    got = cv.audit(spark.createDataFrame(rows, CONV)).collect()
    assert sorted(map(tuple, got), key=str) == brute_audit(rows)


def test_scan_by_brute_force(spark):
    """Sums before each row, over more rows than one step of a scan takes."""
    n = {"a": 2000, "b": 512, "c": 1, None: 513}
    rows = [(k, i, m, [i % 7]) for k, m in n.items() for i in range(m)]
    df = spark.createDataFrame(rows, "key string, pos long, n long, value array<long>")

    def fold(values):
        return [sum(v[0] for v in values)]

    def spread(context, values):
        return [[context[0] + s] for s in [0, *itertools.accumulate(v[0] for v in values)][:-1]]

    got = {(r.key, r.pos): r.context[0] for r in cv.scan(df, fold, spread, [100]).collect()}
    want = {(k, i): 100 + sum(j % 7 for j in range(i)) for k, m in n.items() for i in range(m)}
    assert got == want


def test_repaired_rows_follow_the_pattern(spark):
    rows = cv.damage(spark.createDataFrame(talk(60, 1), CONV))
    said = defaultdict(str)
    for r in sorted(cv.repaired(rows).collect(), key=lambda r: (str(r.key), r.place)):
        said[r.key] += r.role[:1]
    assert said and all(re.fullmatch("(s?(ua)+)?", s) for s in said.values())


# ---- secrets ----------------------------------------------------------------


def brute_base(text):
    rules = {
        "assign": re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A),
        "access": re.compile("AKIA[A-Z0-9]+"),
        "hex": re.compile("[0-9a-f]+"),
    }
    enough = {"assign": lambda m: len(m[2]) >= 8, "access": lambda m: len(m[0]) >= 16, "hex": lambda m: len(m[0]) >= 32}
    found = [(m.start(), m.end(), k) for k, p in rules.items() for m in p.finditer(text) if enough[k](m)]
    return sorted(found, key=lambda s: (s[0], cr.KINDS.index(s[2])))


ODD_TEXTS = [
    None,
    "",
    "token=short",
    "TOKEN : 'abcdefgh1'",
    "Api_Key=\"x+/=.-_9",
    "AKIA" * 9,
    "AKIAabc AKIA0123456789AB",
    "0" * 31 + " " + "f" * 32 + "g" + "a" * 100_000,
    "ſecret=12345678 secret= 12345678 paſſword:12345678 toKen=12345678 éapikey=abcdefgh",
    "password=password=password=12345678",
    "a" * 200_000,
]


def test_plain_rules_by_brute_force():
    rng = random.Random(5)
    bits = ["token", "Secret", "=", ":", " ", '"', "AKIA", "ABCDEF012345", "0123456789abcdef", "é", "x-/", "\n", "passwd"]
    texts = [t or "" for t in ODD_TEXTS] + ["".join(rng.choices(bits, k=rng.randrange(1, 20))) for _ in range(3000)]
    for text in texts:
        assert [(a, b, k) for a, b, k, _ in cr.labelled(text)] == brute_base(text)


def test_automaton_is_a_distribution():
    """The likelihoods of all short strings and of what is longer add up to one."""
    machine = cr.infer(["ab", "ab", "abab", "b", "ababab", "bb", "b"])
    n = len(machine.ends)
    for s in range(n):
        total = machine.total(s)
        assert total > 0 and set(machine.leaves[s]) == set(machine.next[s])
    step, logs = cr.tables(machine)
    codes = [0, *map(ord, cr.ALPHABET)]
    assert np.allclose(np.exp(logs[:, codes]).sum(axis=1), 1)


def test_merging_by_the_bound():
    """Values of (ab)* make two states; a fixed word behind a prefix stays apart."""
    rng = random.Random(2)
    values = ["ab" * rng.choices(range(1, 9), weights=[2.0**-k for k in range(8)])[0] for _ in range(1000)]
    machine = cr.infer(values)
    assert len(machine.ends) <= 4
    assert len(cr.infer(values[::-1]).ends) == len(machine.ends)
    step, logs = cr.tables(machine)
    good, bad = cr.likelihoods(["abababababab", "aabbaabbabab"], step, logs)
    assert good > bad + 10


def slow_likelihood(token, machine):
    size, s, out = len(cr.ALPHABET) + 1, 0, 0.0
    for c in [*token, None]:
        if s is None:
            out -= math.log(size)
            continue
        total = machine.total(s) + cr.UNSEEN
        seen = machine.ends[s] if c is None else machine.leaves[s].get(c, 0)
        out += math.log((seen + cr.UNSEEN / size) / total)
        s = machine.next[s].get(c) if c is not None else s
    return out


def test_likelihoods_by_brute_force():
    rng = random.Random(6)
    shown = [v for k, v in cr.examples(40) if k == "assign"]
    machine = cr.infer(shown)
    tokens = ["".join(rng.choices(cr.ALPHABET, k=rng.randrange(16, 60))) for _ in range(200)] + shown + ["ghp_" + "a" * 5000]
    got = cr.likelihoods(tokens, *cr.tables(machine))
    assert np.allclose(got, [slow_likelihood(t, machine) for t in tokens])
    assert len(cr.likelihoods([], *cr.tables(machine))) == 0


def corpus(spark, folder):
    return spark.read.parquet(f"{folder}/documents.parquet")


def test_finds_formats_and_leaves_words(spark, folder):
    """Of unseen values of every public format in documents, nine in ten are found; of the
    documents' own tokens, identifiers and numbers almost none."""
    docs = corpus(spark, folder)
    model = cr.learn(cr.scanned(docs))
    unseen = cr.examples(40, seed=99)
    planted = spark.createDataFrame([(i, f"see «{v}» for more") for i, (_, v) in enumerate(unseen)], "doc_id long, text string")
    caught = cr.report(cr.scanned(planted), model).filter(F.size("spans") > 0).count()
    assert caught >= 0.9 * len(unseen)
    plain = ["internationalization", "4539578763621486", "counterrevolutionaries", "2024-01-31T12:00:00", "www.example.com/index.html", "some-very-long-file_name.parquet", "=" * 40, "aaaaaaaaaaaaaaaaaaaaaaa"]
    clean = spark.createDataFrame([(i, f"see {v} for more") for i, v in enumerate(plain)], "doc_id long, text string")
    assert cr.report(cr.scanned(clean), model).filter(F.size("spans") > 0).count() <= 1
    own = cr.report(cr.scanned(docs), model)
    extra = own.filter(F.size("spans") > F.size("base")).count()
    assert extra <= 0.01 * docs.count()


def test_query_keeps_the_base(spark, folder):
    got = QUERIES["op11_secrets"](spark, folder).collect()
    texts = {r.doc_id: r.text for r in corpus(spark, folder).collect()}
    assert len(got) == len(texts)
    for r in got:
        base = brute_base(texts[r.doc_id] or "")
        listed = [f"{k}:{a}:{b}" for a, b, k in base]
        assert r.base_sha256 == H(",".join(listed))
        assert set(listed) <= set(filter(None, r.spans.split(",")))
        assert [r.n_assign, r.n_access, r.n_hex] == [sum(k == kind for _, _, k in base) for kind in cr.KINDS]


def test_odd_texts_of_secrets(spark):
    rows = [(None if i % 3 == 0 else i % 4, t, [], 1) for i, t in enumerate(ODD_TEXTS * 2)]
    df = spark.createDataFrame(rows, "doc_id long, text string, base array<int>, spans int")
    got = cr.find(df).collect()
    assert len(got) == len(rows)
    want = sorted(str([(s[2], s[0], s[1]) for s in brute_base(t or "")]) for _, t, *_ in rows)
    assert sorted(str([(s.kind, s.start, s.end) for s in r.base]) for r in got) == want
    assert cr.find(df.limit(0)).collect() == []
    again = cr.find(df).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))
