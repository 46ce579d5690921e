"""Exact dedup and near-dedup against brute force."""

import hashlib
import random
import re

import numpy as np
import pytest
import xxhash
from check import compare, connect
from pyspark.sql import functions as F

from lumenfold.llm import exact_dedup as ed
from lumenfold.llm import simhash as sh
from lumenfold.llm.oracle import ORACLE
from lumenfold.llm.queries import QUERIES

SCHEMA = "doc_id long, text string, row string, name int, text_sha256 string"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "x", 1, "y") for i, t in rows], SCHEMA)


def rows_of(n=60, seed=1):
    rng = random.Random(seed)
    base = ["", " \t\n", "a", "é" * 700, "word " * 900, "x" * 5000, "x" * 4999 + "y", "a b c", " "]
    rows = []
    for i in range(n):
        t = rng.choice(base)
        cut = rng.randrange(len(t) + 1)
        rows.append((i, t[:cut] + rng.choice(["", " ", "\n\n"]) + t[cut:]))
    return rows + [(None, "a"), (None, "a"), (3, None), (100, "a b c"), (100, "a b c"), (101, "z" * 200_000), (102, "z" * 200_000)]


def expected(rows):
    groups = {}
    for i, t in rows:
        t = t or ""
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]", "", t), []).append((-len(t), i is None, i or 0, i))
    out = []
    for body, members in groups.items():
        best = min(members, key=lambda m: m[:3])[3]
        out += [(m[3], best, len(members), hashlib.sha256(body.encode()).hexdigest()) for m in members]
    return sorted(out, key=str), len(groups)


@pytest.mark.parametrize("hasher", [F.xxhash64, lambda c: F.pmod(F.xxhash64(c), F.lit(3))])
def test_exact_groups(spark, hasher):
    rows = rows_of()
    got = ed.exact_groups(frame(spark, rows), hasher=hasher).collect()
    want, groups = expected(rows)
    assert sorted(((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got), key=str) == want
    assert sum(r.kept for r in got) == groups
    assert all(r.doc_id == r.keep_id for r in got if r.kept)


def test_exact_dedup_rows(spark):
    rows = rows_of()
    out = ed.exact_dedup(frame(spark, rows))
    assert out.columns == ["doc_id", "text", "row", "name", "text_sha256"]
    kept = out.collect()
    bodies = [re.sub(r"[\x20\x09-\x0D]", "", r.text or "") for r in kept]
    assert len(bodies) == len(set(bodies)) == expected(rows)[1]
    assert {r.row for r in kept} == {"x"}
    assert ed.exact_dedup(frame(spark, [])).count() == 0
    assert ed.exact_groups(frame(spark, [])).count() == 0


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_oracle_llm(spark, folder, name):
    assert compare(spark, connect(folder), name, QUERIES[name], ORACLE[name], folder) == ""


def brute_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_fingerprints():
    rng = random.Random(2)
    texts = ["", " ", "One", "one TWO", "One two three", "É É É", "a b c", "x " * 5000]
    texts += [" ".join(rng.choice("abcdefg") for _ in range(rng.randrange(40))) for _ in range(40)]
    for t in texts:
        assert sh.fingerprint(sh.shingle_hashes(t)) == brute_fingerprint(t)


def clusters(n, seed):
    rng = random.Random(seed)
    out = set()
    while len(out) < n:
        c = rng.getrandbits(64)
        out |= {c} | {c ^ sum(1 << rng.randrange(64) for _ in range(rng.randrange(6))) % (1 << 64) for _ in range(rng.randrange(40))}
    return np.array(sorted(out), dtype=np.uint64)


def brute_components(prints):
    parent = list(range(len(prints)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(prints)):
        for j in np.flatnonzero(np.bitwise_count(prints[i + 1 :] ^ prints[i]) <= 3):
            a, b = find(i), find(i + 1 + int(j))
            parent[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(prints))]


@pytest.mark.parametrize("tile", [sh.TILE, 8])
def test_links_lose_no_component(spark, tile):
    prints = clusters(700, 3)
    signed = prints.view(np.int64).tolist()
    df = spark.createDataFrame([(x,) for x in signed], "fp long")
    found = {r.node: r.root for r in sh.components(sh.links(df, tile)).collect()}
    want = brute_components(prints)
    mine = [found.get(x, x) for x in signed]
    assert len(set(want)) < len(prints)
    assert len(set(zip(want, mine, strict=True))) == len(set(want)) == len(set(mine))


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 160)] + [(7, 7)]
    got = {r.node: r.root for r in sh.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, **{i: 100 for i in range(100, 160)}}
    assert sh.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_near_groups_rows(spark):
    rows = [(5, ""), (2, None), (None, " "), (9, "one two three four"), (4, "ONE  two three\nfour"), (4, "else"), (None, "alone"), (7, "alone")]
    got = sh.near_groups(frame(spark, rows)).collect()
    assert sorted(((r.doc_id, r.component_id) for r in got), key=str) == sorted(
        [(5, 2), (2, 2), (None, 2), (9, 4), (4, 4), (4, 4), (None, 7), (7, 7)], key=str
    )
    kept = sh.near_dedup(frame(spark, rows))
    assert kept.columns == SCHEMA.replace(" long", "").replace(" string", "").replace(" int", "").split(", ")
    assert sorted((r.doc_id, r.text or "") for r in kept.collect()) == [(2, ""), (4, "ONE  two three\nfour"), (4, "else"), (7, "alone")]
    assert sh.near_groups(frame(spark, [])).count() == 0
