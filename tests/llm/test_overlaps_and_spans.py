"""Near copies across splits, shared spans, leaks: against brute force."""

import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from pathloom.llm import bloom, leakage, overlap, path_keys, rolling, shared_spans


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        now = [i]
        for j, y in enumerate(b, 1):
            now.append(min(row[j] + 1, now[-1] + 1, row[j - 1] + (x != y)))
        row = now
    return row[-1]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(0, 3), max_size=40), st.lists(st.integers(0, 3), max_size=40))
def test_edit_distance(a, b):
    assert overlap.edit_distance(a, b) == distance(a, b) == overlap.within(np.array(a, np.int64), np.array(b, np.int64), 99)


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 5000))
def test_pieces_outnumber_the_distance(n):
    m = overlap.pieces_of(n, 0.1)
    longest = max(k for k in range(n, n * 2 + 2) if k - n <= k // 10)
    assert m > longest // 10
    assert [-(-(j * n // m) * m // n) for j in range(m)] == list(range(m)) or n < m


def mutate(rng, t, k):
    t = list(t)
    for _ in range(k):
        i = int(rng.integers(0, len(t)))
        kind = rng.integers(0, 3)
        t[i : i + (kind != 0)] = [] if kind == 1 else [f"t{rng.integers(0, 9)}"]
    return t


@pytest.fixture(scope="module")
def paths():
    rng = np.random.default_rng(7)
    rows, base = [], [[f"t{x}" for x in rng.integers(0, 9, int(n))] for n in rng.integers(20, 90, 60)]
    for i, t in enumerate(base):
        rows.append((i, "train", f"s{i % 5}", f"0x{i % 7:x}", t))
        for k in range(2):
            rows.append((1000 + 10 * i + k, ("val", "test")[k], f"v{i % 3}", f"0x{i % 4:x}", mutate(rng, t, int(rng.integers(0, 5)))))
    rows += [(5000 + i, ("train", "test")[i % 2], f"c{i}", "0x9", base[0]) for i in range(40)]  # a hot group of copies
    rows += [(6000, "train", "n", "0x1", None), (6001, "test", "n", None, []), (6002, None, "n", "0x1", base[1]), (None, "test", "n", "0x1", base[2]), (0, "train", "s0", "0x0", base[0])]
    rows += [(7000, "train", "z", "0x1", [None] * 30), (7001, "val", "z", "0x2", [None] * 30)]
    return rows


SCHEMA = "id long, split string, shard string, addr string, tokens array<string>, _name string, band int, _n int"


def test_near_copies(spark, paths, monkeypatch):
    monkeypatch.setattr(overlap, "SLICE_TOKENS", 500)
    df = spark.createDataFrame([(*r, "x", 1, 2) for r in paths], SCHEMA)
    long = {r[0]: r for r in paths if r[0] is not None and r[1] and r[4] and len(r[4]) >= 30}
    want = set()
    for a in long.values():
        for b in long.values():
            if a[1] == "train" != b[1] and distance(a[4], b[4]) * 10 <= max(len(a[4]), len(b[4])):
                want.add((min(a[0], b[0]), max(a[0], b[0])))
    for passages in (100_000, 40):
        got = overlap.near_copy_pairs(df, F.col("split"), F.col("shard"), record="id", least=30, passages=passages)
        assert {(r.a, r.b) for r in got.collect()} == want
    assert len(want) > 400
    report = overlap.overlap_report(df, F.col("split"), F.col("shard"), record="id", least=30).collect()
    assert sum(r.records for r in report) == sum(r[1] != "train" for r in long.values())
    hit = {b for a, b in want} | {a for a, b in want}
    assert sum(r.unchanged + r.altered for r in report) == sum(r[1] != "train" and r[0] in hit for r in long.values())


def test_near_copies_of_nothing(spark):
    df = spark.createDataFrame([(1, "train", "s", "0x1", ["a"] * 70, "x", 1, 1)], SCHEMA)
    assert overlap.near_copy_pairs(df, F.col("split"), F.col("shard"), record="id").count() == 0
    assert overlap.near_copy_pairs(df.limit(0), F.col("split"), F.col("shard"), record="id").count() == 0


def brute_spans(rows, least):
    where = {}
    for r in rows:
        if r[0] is not None and r[3] is not None and r[4]:
            for i in range(len(r[4]) - least + 1):
                where.setdefault(tuple(r[4][i : i + least]), {}).setdefault(r[0], (set(), (r[2], r[3])))[0].add(i)
    pairs, covered = set(), {}
    for holders in where.values():
        if len({o for _, o in holders.values()}) > 1:
            for a, (at, oa) in holders.items():
                covered.setdefault(a, set()).update(k for i in at for k in range(i, i + least))
                pairs |= {(a, b) for b, (_, ob) in holders.items() if a < b and oa != ob}
    return pairs, {k: len(v) for k, v in covered.items()}


@pytest.mark.parametrize("least", [12, 21])
def test_shared_spans(spark, paths, least):
    df = spark.createDataFrame([(*r, "x", 1, 2) for r in paths], SCHEMA)
    owner = F.when(F.col("addr").isNotNull(), F.struct("shard", "addr"))
    pairs, covered = brute_spans(paths, least)
    got = shared_spans.shared_pairs(df, "id", "tokens", owner, least, 1 << 16)
    assert {(r.a, r.b) for r in got.collect()} == pairs and len(pairs) > 100
    share = {r.id: r.shared_tokens for r in shared_spans.shared_share(df, "id", "tokens", owner, least, 1 << 16).collect()}
    assert {k: v for k, v in share.items() if v} == covered and set(share) == {r[0] for r in paths if r[0] is not None}


def test_spans_of_nothing_and_of_one_owner(spark):
    df = spark.createDataFrame([(i, "s", "s", "0x1", ["a"] * 80, "x", 1, 1) for i in range(3)], SCHEMA)
    assert shared_spans.shared_pairs(df, "id", "tokens", F.struct("shard", "addr")).count() == 0
    assert shared_spans.shared_pairs(df.limit(0), "id", "tokens", F.struct("shard", "addr")).count() == 0


def test_a_path_is_compacted(spark):
    rng = np.random.default_rng(2)
    span = [f"t{x}" for x in rng.integers(0, 50, 200)]
    rows = [(i, "s", f"s{i}", "0x1", [f"l{i}{k}" for k in range(9)] + span + [f"r{i}"], "x", 1, 1) for i in range(4)]
    df = spark.createDataFrame(rows, SCHEMA)
    edges = shared_spans.repeated_edges(df, "id", "tokens", F.struct("shard", "addr"), 50, 1 << 16)
    members = shared_spans.span_members(edges, 50).collect()
    assert edges.count() == 4 * 151 and len(members) == 4 and {(r._start, r._end) for r in members} == {(10, 209)}


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.integers(0, 3), max_size=60), max_size=4), st.integers(1, 6), st.integers(1, 9))
def test_winnowing_keeps_a_gram_of_every_span(seqs, k, w):
    starts = np.concatenate(([0], np.cumsum([len(s) for s in seqs]))).astype(np.int64)
    flat = np.array([x for s in seqs for x in s], np.uint64)
    of, place, h = rolling.winnow(flat, starts, k, w)
    kept = {(o, p) for o, p in zip(of.tolist(), place.tolist(), strict=True)}
    for i, s in enumerate(seqs):
        for j in range(len(s) - k - w + 2):
            assert any((i, p) in kept for p in range(j, j + w))
    names = {}
    for o, p, v in zip(of.tolist(), place.tolist(), h.tolist(), strict=True):
        assert names.setdefault(tuple(seqs[o][p : p + k]), v) == v


def test_bloom_filter_loses_nothing(spark):
    x = np.random.default_rng(0).integers(-(2**62), 2**62, 2000)
    packed = np.frombuffer(bloom.bloom_filter(spark.createDataFrame([(int(i),) for i in x], "h long"), "h"), np.uint8)
    assert bloom.passes(packed, x.view(np.uint64)).all()
    assert bloom.passes(packed, np.random.default_rng(1).integers(0, 2**62, 2000).view(np.uint64)).mean() < 0.05


def test_path_keys(spark):
    rows = [("0x0041", " /a/b/x.jsonl ", " Val"), ("0X41", "x.jsonl", "TRAIN "), ("41", "a/ x.jsonl", None), ("0x0", "", ""), ("zz", None, "t"), (None, "x", "x")]
    df = spark.createDataFrame(rows, "f string, n string, s string")
    got = df.select(path_keys.address(F.col("f")), path_keys.shard_name(F.col("n")), path_keys.split_name(F.col("s"))).collect()
    assert [tuple(r) for r in got] == [("41", "x.jsonl", "val"), ("41", "x.jsonl", "train"), ("41", "x.jsonl", None), ("0", "", ""), (None, None, "t"), (None, "x", "x")]


def test_leaks(spark):
    rng = np.random.default_rng(5)
    word = lambda: "".join(chr(97 + x) for x in rng.integers(0, 26, 6))
    items = [(i, " ".join(word() for _ in range(20)), "en" if i % 2 else None) for i in range(6)]
    zh = "".join(chr(0x4E00 + x) for x in rng.integers(0, 900, 60))
    items += [(10, zh, "zh"), (11, None, "en"), (12, "", "ja"), (13, "short", "en"), (0, items[0][1], None)]
    docs = []
    for i in range(120):
        _, text, _ = items[i % 6]
        a, n = int(rng.integers(0, 60)), int(rng.integers(30, 90))
        docs.append((i, word() * 3 + " — " + text[a : a + n].upper().replace(" ", ", ") + "!" + word() * 4))
    docs += [(200 + i, f"前{i}" + zh[i : i + 14 + i] + "后") for i in range(12)] + [(300, None), (301, ""), (None, items[1][1]), (0, docs[0][1]), (302, "x" * 50_000), (303, items[2][1] + zh)]
    df = spark.createDataFrame([(*d, "c", 1) for d in docs], "doc long, text string, _key string, lang int")
    ev = spark.createDataFrame([(*e, "c") for e in items], "item long, text string, lang string, doc string")
    norm = leakage.letters_and_digits
    want = {}
    for d, t in docs:
        for e, u, lang in items:
            if d is None or t is None or not u:
                continue
            x, y, k = norm(t), norm(u), 20 if lang in ("zh", "ja") else 50
            n = max((m for m in range(k, len(y) + 1) if any(y[i : i + m] in x for i in range(len(y) - m + 1))), default=0)
            if n:
                want[d, e] = max(n, want.get((d, e), 0))
    got = leakage.leaks(df, ev, F.col("lang").isin("zh", "ja"), "doc", "text", "item", "text", filter_bits=1 << 16)
    assert {(r.doc, r.item): r.longest for r in got.collect()} == want and len(want) > 30
    assert leakage.leaks(df.limit(0), ev, F.col("lang") == "zh", "doc", "text", "item", "text", filter_bits=1 << 16).count() == 0
    assert leakage.leaks(df, ev.limit(0), F.col("lang") == "zh", "doc", "text", "item", "text", filter_bits=1 << 16).count() == 0


def test_normalisation():
    assert leakage.letters_and_digits("Ｆｕ̈ß ①  x_y!") == "füss1xy"


def test_a_filter_that_is_too_small_is_replaced_by_a_join(spark):
    rng = random.Random(5)
    common = [f"c{i}" for i in range(30)]
    rows = [(i, [f"w{rng.randrange(40)}" for _ in range(rng.randrange(5, 60))] + (common if i % 3 == 0 else []) + [f"w{rng.randrange(40)}" for _ in range(9)], i // 2) for i in range(60)]
    df = spark.createDataFrame(rows + rows[:4], "path_id long, tokens array<string>, f long")
    want = {(r.a, r.b) for r in shared_spans.shared_pairs(df, "path_id", "tokens", F.col("f"), 20).collect()}
    assert want == {(a, b) for a in range(0, 60, 3) for b in range(a + 1, 60) if b % 3 == 0 and a // 2 != b // 2}
    got = {(r.a, r.b) for r in shared_spans.shared_pairs(df, "path_id", "tokens", F.col("f"), 20, filter_bits=64).collect()}
    assert got == want
    shares = [{r.path_id: r.shared_tokens for r in shared_spans.shared_share(df, "path_id", "tokens", F.col("f"), 20, filter_bits=b).collect()} for b in (64, 1 << 20)]
    assert shares[0] == shares[1] and {k for k, v in shares[0].items() if v} == set(range(0, 60, 3)) and min(v for v in shares[0].values() if v) >= 30


def test_bloom_filter_loses_none_and_lets_few_through(spark):
    rng = np.random.default_rng(0)
    inside, outside = rng.integers(-(2**63), 2**63 - 1, 5000), rng.integers(-(2**63), 2**63 - 1, 20000)
    df = spark.createDataFrame([(int(x),) for x in inside], "h long")
    packed = np.frombuffer(bloom.bloom_filter(df, "h"), np.uint8)
    assert bloom.passes(packed, inside).all() and bloom.passes(packed, outside).mean() < 0.02
    assert np.unpackbits(packed[: len(packed) // 2]).mean() == pytest.approx(np.unpackbits(packed[len(packed) // 2 :]).mean(), rel=0.1)


def test_one_hot_text_span_and_passage(spark):
    # half of all rows hold one text, one span or one passage
    text = [f"t{i}" for i in range(70)]
    rows = [(i, "s", ["train", "val"][i % 2] if i < 200 else "train", text if i % 4 < 2 else [f"u{i}_{j}" for j in range(70)]) for i in range(800)]
    df = spark.createDataFrame(rows, "path_id long, file string, split string, tokens array<string>")
    got = overlap.near_copy_pairs(df, F.col("split"), F.col("file")).count()
    trains, evals = sum(1 for r in rows if r[2] == "train" and r[3] is text), sum(1 for r in rows if r[2] == "val" and r[3] is text)
    assert got == trains * evals
    members = shared_spans.span_members(shared_spans.repeated_edges(df, "path_id", "tokens", F.col("path_id")))
    assert members.count() == sum(1 for r in rows if r[3] is text)  # one nonbranching path, one row a record
    docs = spark.createDataFrame([(i, ("x" * i if i % 2 else "the quick brown fox jumps over the lazy dog and runs far away from here") + f" tail {i}") for i in range(400)], "doc_id long, text string")
    items = spark.createDataFrame([(1, "once the quick brown fox jumps over the lazy dog and runs far away from here again", "en")], "eval_id long, text string, lang string")
    for bound in (0, 1_000_000):
        assert leakage.leaks(docs, items, F.lit(False), most_sent=bound).count() == 200
