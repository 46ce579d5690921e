"""Mixing, packing, sharding, token counts and the pipeline."""

import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

import corpus_pipeline
from lumenfold.llm import mixing, packing, sharding, toxicity
from lumenfold.llm import token_counts as tc
from lumenfold.llm.queries import toxicity_model
from lumenfold.llm.tokens import WordTokens, public_path

SCHEMA = "doc_id long, text string, source string, size int, slot int, copies int, row int"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, s, 0, 0, 0, 0) for i, t, s in rows], SCHEMA)


def some_rows():
    rng = random.Random(6)
    rows = [(i, "w " * rng.randrange(60), rng.choice(["a", "b", "é", "B", None])) for i in range(300)]
    return rows + [(None, "x y", "a"), (None, "x y", "a"), (5, None, "b"), (5, "", "lone"), (6, "v " * 3, "tiny")]


# ---- mixing -----------------------------------------------------------------


def test_mixing_targets_and_copies(spark):
    rows = some_rows()
    got = mixing.plan(frame(spark, rows)).collect()
    sizes = Counter()
    for _, t, s in rows:
        sizes[s] += len((t or "").split())
    assert len(got) == len(rows) and sorted(r.size for r in got) == sorted(len((t or "").split()) for _, t, _ in rows)
    order = sorted(sizes, key=lambda s: (s is None, s))
    weight = {s: (1, 2, 3)[i % 3] for i, s in enumerate(order)}
    total, held = sum(sizes.values()), set()
    while True:
        unit = (total - sum(3 * sizes[s] for s in held)) / sum(weight[s] for s in order if s not in held)
        more = {s for s in order if s not in held and unit * weight[s] > 3 * sizes[s]}
        if not more:
            break
        held |= more
    want = {s: 3 * sizes[s] if s in held else unit * weight[s] for s in order}
    assert sorted(round(want[s], 6) for _, _, s in rows) == sorted(round(r.target, 6) for r in got)
    taken = defaultdict(int)
    for r in got:
        taken[r.source_size, round(r.target, 6)] += r.taken
        assert r.taken in (0, r.size, 2 * r.size, 3 * r.size)
        assert r.position is None or 0 <= r.position <= 1
    for s in order:
        assert abs(taken[sizes[s], round(want[s], 6)] - want[s]) <= 60


def test_mixing_writes_the_training_order(spark):
    df = frame(spark, some_rows())
    out = mixing.mix(df)
    assert out.columns == df.columns
    plan = Counter()
    for r in mixing.plan(df).collect():
        plan[r.doc_id, r.size] += r.copies
    assert Counter((r.doc_id, len((r.text or "").split())) for r in out.collect()) == +plan
    assert mixing.mix(frame(spark, [])).count() == mixing.plan(frame(spark, [])).count() == 0
    assert mixing.plan(frame(spark, [(1, None, None)])).first().taken == 0


def test_position_inverts_the_integrated_schedule(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([(float(s), k) for s in (-0.5, 0.0, 0.5) for k in range(10)], "slope double, start long")
    df = df.selectExpr("*", "1L as size", "10L as source_size", "10D as target")
    for r in df.withColumn("t", mixing.position(F.lit(0))).collect():
        assert r.t + r.slope * (r.t * r.t - r.t) == pytest.approx((r.start + 0.5) / 10)


@pytest.mark.parametrize("name", ["op10_mixing", "op10_mixing_order"])
def test_mixing_agrees_with_sql_and_needs_the_slopes(spark, folder, monkeypatch, name):
    from check import compare, connect

    from lumenfold.llm.oracle import ORACLE
    from lumenfold.llm.queries import QUERIES

    args = (spark, connect(folder), name, QUERIES[name], ORACLE[name], folder)
    assert compare(*args) == ""
    monkeypatch.setattr(mixing, "SLOPES", (0.0, 0.0, 0.0))
    assert "differ" in compare(*args)


def test_mix_writes_copies_by_rank(spark):
    df = frame(spark, some_rows())
    order = mixing.schedule(df).orderBy("rank").collect()
    assert [r.rank for r in order] == list(range(len(order)))
    assert [r.position for r in order] == sorted(r.position for r in order)
    first = {r.doc_id: r.position for r in mixing.plan(df).collect() if r.doc_id is not None and r.doc_id > 6}
    assert all(first[r.doc_id] == r.position for r in order if r.doc_id in first and r.copy == 0)
    assert [r.doc_id for r in mixing.mix(df).collect()] == [r.doc_id for r in order]
    assert mixing.schedule(frame(spark, [])).count() == 0


# ---- packing ----------------------------------------------------------------


def test_place_is_the_sum_of_squares_rule():
    rng = np.random.default_rng(7)
    lengths = rng.integers(1, 21, 300)
    seq, off = packing.place(lengths, 20)
    level = {}
    for s, q, o in zip(lengths.tolist(), seq.tolist(), off.tolist(), strict=True):
        gaps = Counter(20 - x for x in level.values() if x < 20)

        def after(gap, size=s, gaps=gaps):
            g = gaps.copy()
            g[gap] -= gap < 20
            g[gap - size] += gap > size
            return sum(v * v for v in g.values())

        best = min(after(g) for g in [20, *[x for x in gaps if gaps[x] and x >= s]])
        assert after(20 - o) == best and level.get(q, 0) == o
        level[q] = o + s
    assert max(level.values()) <= 20 and len(level) <= 1.1 * lengths.sum() / 20


def test_tokens_equal_the_tokenizer():
    mine = WordTokens(public_path("word_bpe_49k.json"))
    rng = random.Random(8)
    pool = [chr(c) for c in [*range(32, 127), *range(160, 600), *range(0x370, 0x400), 0x301, 0x3A3, 0x130, 0x2028, 0x3000, 0x1F600, 0, 0x1C, 0x85]]
    texts = ["", "it's DON'T", "café é", "日本 123", "<|endoftext|>", "a" * 3000]
    for t in texts + ["".join(rng.choice(pool) for _ in range(50)) for _ in range(300)]:
        ids = mine.tokenizer.encode(t, add_special_tokens=False).ids
        assert np.frombuffer(mine.ids(t), "<u4").tolist() == ids


def check_packing(rows, texts, capacity):
    mine = WordTokens(public_path("word_bpe_49k.json"))
    ids = Counter(mine.ids(t) + b"\0\0\0\0" for t in texts)
    by_seq = defaultdict(list)
    for r in rows:
        assert 1 <= r.length <= capacity
        by_seq[r.sequence_id].append((r.offset, r.length))
    for places in by_seq.values():
        at = 0
        for o, n in sorted(places):
            assert o == at
            at += n
        assert at <= capacity
    assert sum(r.length for r in rows) == sum(len(k) // 4 * n for k, n in ids.items())
    want = Counter()
    for k, n in ids.items():
        for p, lo in enumerate(range(0, len(k), 4 * capacity)):
            part = k[lo : lo + 4 * capacity]
            want[p, lo // 4, len(part) // 4, zlib.crc32(part)] += n
    assert Counter((r.piece, r.start, r.length, r.ids_crc32) for r in rows) == want
    return len(by_seq)


def test_packing_rows(spark):
    rows = some_rows() + [(7, "token " * 500, "a")]
    cut = packing.pieces(frame(spark, rows), capacity=64, with_ids=True)
    packed = packing.pack(cut, 64, shard=100)
    check_packing(packed.collect(), [t or "" for _, t, _ in rows], 64)
    whole = packing.sequences(packed).collect()
    assert all(len(r.ids) <= 4 * 64 for r in whole)
    assert sum(len(r.ids) for r in whole) == 4 * sum(r.length for r in packed.collect())
    assert packing.pack(packing.pieces(frame(spark, []))).count() == 0


def test_packing_keeps_the_order_of_the_mix(spark, tmp_path):
    rng = random.Random(10)
    df = frame(spark, [(i, f"w{i} " * rng.randrange(1, 60), rng.choice("abc")) for i in range(400)])
    mixing.mix(df).write.parquet(str(tmp_path / "mixed"))
    mixed = spark.read.parquet(str(tmp_path / "mixed"))
    rank = defaultdict(list)
    for r in mixing.schedule(df).collect():
        rank[r.doc_id].append(r.rank)

    def ranks(packed):
        """Mean rank of the documents of each sequence, in the order of the sequences."""
        by_seq = defaultdict(list)
        for r in packed.collect():
            if len(rank[r.doc_id]) == 1:
                by_seq[r.sequence_id].append(rank[r.doc_id][0])
        return [by_seq[k] for k in sorted(by_seq)]

    cut = packing.pieces(mixed, capacity=512, order=packing.file_order(mixed))
    high = 0
    for found in ranks(packing.pack(cut, 512, shard=48)):
        assert max(found) - min(found) <= 64 and min(found) >= high - 64
        high = max(high, *found)
    assert high > 300
    means = [float(np.mean(x)) for x in ranks(corpus_pipeline.pack_sequences(spark, mixed, ""))]
    assert len(means) > 3 and np.corrcoef(means, range(len(means)))[0, 1] > 0.5
    assert packing.file_order(df) is None


# ---- sharding ---------------------------------------------------------------


def test_lookup_table_is_even_and_steady():
    names = [f"s{i}" for i in range(10)]
    table = sharding.lookup_table(names, 2503)
    share = Counter(table)
    assert max(share.values()) - min(share.values()) <= 1
    less = sharding.lookup_table(names[:-1], 2503)
    moved = sum(a != b for a, b in zip(table, less, strict=True) if a != "s9")
    assert moved < 0.05 * 2503
    heavy = Counter(sharding.lookup_table(names, 2503, {"s0": 3}))
    assert heavy["s0"] > 2.8 * heavy["s1"]
    for bad in ((names, 10), (names, 2500), ([], 7)):
        with pytest.raises(ValueError, match="prime"):
            sharding.lookup_table(*bad)


def test_place_rows(spark, tmp_path):
    rows = some_rows()
    df = frame(spark, rows)
    out = sharding.place(df)
    assert out.columns == [*df.columns, "slot_", "shard"]
    got = out.collect()
    table = sharding.lookup_table()
    assert len(got) == len(rows) and all(table[r.slot_] == r.shard for r in got)
    assert sharding.place(frame(spark, [])).count() == 0
    sharding.write(out, str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out")).count() == len(rows)


# ---- token counts -----------------------------------------------------------


def test_separator_scan(spark):
    rng = random.Random(9)
    rows, want = [], {}
    for file in range(5):
        ids = [rng.choice([1, 2, 3, 9]) for _ in range(rng.choice([0, 1, 7, 200]))]
        want[file] = [len(x) for x in re.split("9", "".join(map(str, ids)))]
        if not want[file][-1]:
            want[file].pop()
        data = np.array(ids, "<u2").tobytes()
        rows += [(file, k, data[lo : lo + 14]) for k, lo in enumerate(range(0, max(1, len(data)), 14))]
    rows.append((9, 0, None))
    df = spark.createDataFrame(rows, "file int, block long, data binary")
    got = defaultdict(dict)
    for r in tc.count_tokens(df, end_id=9, chunk=3).collect():
        got[r.file][r.number] = r.n_tokens
    for file, lengths in want.items():
        assert got.get(file, {}) == dict(enumerate(lengths))
    assert 9 not in got


def test_document_counts_and_files(spark, tmp_path):
    rows = some_rows() + [(8, "long " * 4000, "a")]
    got = tc.document_counts(frame(spark, rows), block=64).collect()
    tokenizer = tc.byte_bpe(public_path("byte_bpe_50k.tiktoken"))
    want = Counter((i, len(tokenizer.encode_ordinary(t or ""))) for i, t, _ in rows)
    assert Counter((r.doc_id, r.n_tokens) for r in got) == want
    assert tc.document_counts(frame(spark, [])).count() == 0
    (tmp_path / "x.bin").write_bytes(np.array([5, 50256, 6, 7, 50256, 50256, 8], "<u2").tobytes())
    (tmp_path / "y.bin").write_bytes(b"")
    back = tc.count_tokens(tc.read_token_files(spark, str(tmp_path), block=2)).orderBy("number").collect()
    assert [r.n_tokens for r in back] == [1, 2, 0, 1]


# ---- the pipeline -----------------------------------------------------------


def test_stages_against_brute_force(spark, folder):
    from test_llm_dedup import brute_components, brute_fingerprint

    docs = spark.read.parquet(f"{folder}/documents.parquet")
    of = toxicity.scorer(*toxicity_model(docs, folder))
    left = [r.asDict() for r in docs.collect() if of(r.text) < toxicity.THRESHOLD]
    best = {}
    for r in left:
        key = re.sub(r"[\x20\x09-\x0D]", "", r["text"])
        if key not in best or (-len(r["text"]), r["doc_id"]) < (-len(best[key]["text"]), best[key]["doc_id"]):
            best[key] = r
    left = sorted(best.values(), key=lambda r: r["doc_id"])
    prints = np.array([brute_fingerprint(r["text"]) for r in left], dtype=np.uint64)
    roots = brute_components(prints)
    left = [r for i, r in enumerate(left) if roots[i] == i]
    mixed = mixing.plan(spark.createDataFrame(left)).select("doc_id", "copies").collect()
    texts = {r["doc_id"]: r["text"] for r in left}
    want = [texts[r.doc_id] for r in mixed for _ in range(r.copies)]
    used = check_packing(corpus_pipeline.run(spark, folder).collect(), want, 2048)
    assert used > 0


def test_stages_keep_the_columns(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet").limit(40)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, folder).columns == docs.columns, name
        assert stage(spark, docs.limit(0), folder).count() == 0, name
    assert corpus_pipeline.STAGES[-1][1](spark, docs.limit(0), folder).count() == 0


ODD_DOCS = "doc_id long, text string, lang string, source string, n_chars long, row long, score double, size long, keep_id long"


def test_stages_take_odd_rows(spark, folder):
    """NULL and repeated ids and texts, rows repeated whole, a very long text, and columns named
    like those that the stages use."""
    rng = random.Random(2)
    texts = [None, "", " \n", "one two three four", "One two three four", "long word " * 20_000, *(" ".join(rng.choices("abcdefghij", k=30)) for _ in range(20))]
    rows = [(None if i % 5 == 0 else i // 2, t, "en", rng.choice(["a", "b", None]), None, 7, 0.5, -3, None) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows + rows[:4] + [rows[7]] * 3, ODD_DOCS)
    kept = docs
    counts = []
    for _, stage in corpus_pipeline.STAGES[:-1]:
        kept = corpus_pipeline.stored(stage(spark, kept, folder))
        counts.append(kept.count())
        assert kept.columns == docs.columns
        assert {(r.row, r.score, r.size) for r in kept.collect()} == {(7, 0.5, -3)}
    toxic, exact, near, _ = counts
    # NULL, the empty text and the blank one are equal; so are rows repeated whole.
    assert toxic == len(rows) + 7 and exact == len(texts) - 2 and near <= exact
    packed = corpus_pipeline.STAGES[-1][1](spark, kept, folder)
    assert check_packing(packed.collect(), [r.text or "" for r in kept.collect()], 2048) > 0


def test_packing_has_no_broadcast_that_grows(spark):
    """What is numbered is joined to one count per partition, and no window holds all rows."""
    cut = packing.pieces(frame(spark, some_rows() * 50))
    plan = packing.pack(cut)._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "BroadcastExchange" not in plan


# ---- the learner --------------------------------------------------------------


def plain_ftrl(examples, epochs, seed):
    """FTRL-proximal with a dictionary per coordinate, one text after the other."""
    z, n, bias = defaultdict(float), defaultdict(float), 1 << toxicity.BITS

    def weight(i):
        l1 = 0.0 if i == bias else toxicity.L1
        if abs(z[i]) <= l1:
            return 0.0
        return -(z[i] - (l1 if z[i] > 0 else -l1)) / ((toxicity.BETA + n[i] ** 0.5) / toxicity.ALPHA + toxicity.L2)

    order = np.random.default_rng(seed)
    for _ in range(epochs):
        for k in order.permutation(len(examples)):
            at, label = examples[k]
            w = {int(i): weight(int(i)) for i in at}
            p = 1 / (1 + np.exp(-sum(w.values())))
            g = (p - label) * (toxicity.TOXIC_WEIGHT if label else 1.0)
            for i, wi in w.items():
                sigma = ((n[i] + g * g) ** 0.5 - n[i] ** 0.5) / toxicity.ALPHA
                z[i] += g - sigma * wi
                n[i] += g * g
    return {(toxicity.BIAS if i == bias else i): weight(i) for i in z if weight(i) or i == bias}


def test_learner_by_brute_force():
    rng = random.Random(7)
    examples = []
    for _ in range(300):
        label = int(rng.random() < 0.3)
        some = rng.sample(range(40), 6) + [50 + label * rng.randrange(4), 1 << toxicity.BITS]
        examples.append((np.array(sorted(set(some)), dtype=np.int64), label))
    at, w = toxicity.train(examples, epochs=4, seed=3)
    want = plain_ftrl(examples, 4, 3)
    got = dict(zip(at.tolist(), w.tolist()))
    assert {i for i, x in got.items() if abs(x) > 0.02} <= set(want) and {i for i, x in want.items() if abs(x) > 0.02} <= set(got)
    assert all(got[i] == pytest.approx(want.get(i, 0.0), abs=0.02) for i in got)
    assert len(got) < 40  # of 45 coordinates; the others are exactly zero
