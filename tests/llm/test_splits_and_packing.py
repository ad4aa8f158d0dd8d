"""Splits by origin and containers on small fixtures."""

from collections import Counter, defaultdict

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from pathloom.llm import components, grouped_split, packing


def test_components(spark):
    rows = [("b", "a"), ("b", "c"), ("x", "x"), ("y", "z"), ("z", "y"), ("y", "z"), ("q", None), (None, "r")] + [(f"n{i:03}", f"n{i + 1:03}") for i in range(60)]
    df = spark.createDataFrame(rows, "p string, r string")
    got = {r.node: r.component for r in components.connected_components(df, "p", "r").collect()}
    assert got == {"a": "a", "b": "a", "c": "a", "x": "x", "y": "y", "z": "y"} | {f"n{i:03}": "n000" for i in range(61)}
    assert components.connected_components(df.limit(0), "p", "r").count() == 0


def test_names(spark):
    rows = [(" Ls.ELF ", "x_gcc"), ("/a/b/Ls", None), ("", "cat_gcc_O1"), ("  ", "CAT_gcc"), (None, "?"), (None, None), (".elf", "q_r"), (None, "_x")]
    df = spark.createDataFrame(rows, "u string, l string")
    assert [r[0] for r in df.select(grouped_split.source_name(F.col("u"), F.col("l"))).collect()] == ["ls", "ls", "cat", "cat", None, None, None, None]


def split(spark, rows, links, **more):
    df = spark.createDataFrame([(*r, "clash", 0) for r in rows], "id long, util string, strat string, group_key string, _split int")
    ln = spark.createDataFrame(links, "a string, b string")
    return grouped_split.grouped_split(df, ln, "id", F.col("util"), F.col("strat"), F.col("a"), F.col("b"), **more).collect()


def test_groups_stay_together_and_sizes_fit(spark):
    rng = np.random.default_rng(3)
    names = [f"u{i}" for i in rng.zipf(1.4, 4000) % 150]
    rows = [(i, n, f"s{i % 4}") for i, n in enumerate(names)]
    got = split(spark, rows, [("u3", "u4"), ("u4", "u7"), ("u9", "u9")])
    assert len(got) == 4000
    of = defaultdict(set)
    for r in got:
        of[r.group_key].add(r.split)
    assert all(len(s) == 1 for s in of.values()) and not {"u4", "u7"} & set(of)
    share = Counter(r.split for r in got)
    most = max(Counter(r.group_key for r in got).values()) / 4000
    assert most > 0.2 and abs(share["validation"] / 4000 - 0.1) < 0.01 and abs(share["test"] / 4000 - 0.1) < 0.01


def test_light_groups_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(grouped_split, "HEAVY", 20)
    monkeypatch.setattr(grouped_split, "BLOCK", 50)
    rows = [(i, f"u{i % 200}" if i % 3 else "hot", None) for i in range(3000)]
    got = split(spark, rows, [])
    share = Counter(r.split for r in got)
    assert len(got) == 3000 and abs(share["train"] / 3000 - 0.8) < 0.03 and abs(share["test"] / 3000 - 0.1) < 0.03
    assert len({(r.group_key, r.split) for r in got}) == len({r.group_key for r in got})


def test_records_without_names_and_few_groups(spark):
    got = split(spark, [(1, None, None), (2, "a", "s"), (2, "a", "s"), (None, "a", "s")], [])
    assert sorted(((r.id or 0), r.group_key) for r in got) == sorted([(1, None), (2, "a"), (2, "a"), (0, "a")])
    assert all(r.split in grouped_split.SPLITS for r in got) and {r.split for r in got if r.group_key} == {"train"}
    assert split(spark, [], [("a", "b")]) == []


def test_annealing_beats_the_hash():
    rng = np.random.default_rng(0)
    counts = np.column_stack([s := rng.integers(1, 50, 200), s // 2, s - s // 2]).astype(float)
    target = np.array([0.8, 0.1, 0.1])[:, None] * counts.sum(0)
    start = rng.integers(0, 3, 200)
    best, cost = grouped_split.anneal(counts, target, start, 1, 8000)
    sums = np.array([counts[best == k].sum(0) for k in range(3)])
    assert cost < 1e-4 and abs(sums / counts.sum(0) - [[0.8], [0.1], [0.1]]).max() < 0.01


@settings(max_examples=80, deadline=None)
@given(st.dictionaries(st.integers(1, 64), st.integers(1, 40), max_size=30))
def test_plan_places_every_item_once_within_capacity(counts):
    room, seen = Counter(), defaultdict(list)
    for size, first, n, container, per in packing.harmonic_plan(counts, 64, (3, 8)):
        for i in range(n):
            room[container + i // per] += size
            seen[size].append(first + i)
    assert {s: sorted(v) for s, v in seen.items()} == {s: list(range(n)) for s, n in counts.items()}
    assert all(v <= 64 for v in room.values()) and sorted(room) == list(range(len(room)))


def test_fill_is_close_to_the_least():
    rng = np.random.default_rng(1)
    counts = Counter(np.minimum(rng.lognormal(4.5, 0.8, 50_000).astype(int) + 1, 2048).tolist())
    plan = packing.harmonic_plan(counts, 2048)
    used = len({c + i // per for _, _, n, c, per in plan for i in range(n)})
    assert used <= 1.02 * sum(s * n for s, n in counts.items()) / 2048


def test_pack(spark):
    rows = [(1, 25), (2, 10), (2, 10), (3, None), (4, 0), (None, 7)] + [(100 + i, 3) for i in range(3000)]
    df = spark.createDataFrame([(*r, "c") for r in rows], "_item long, _size long, container string")
    got = packing.pack(df, 10, (2, 4), bucket_rows=100).collect()
    room = Counter()
    for r in got:
        room[r.container] += r.n_tokens
    assert max(room.values()) <= 10 and sum(room.values()) == 25 + 20 + 7 + 9000
    assert sorted((r.piece, r.first_token, r.n_tokens) for r in got if r._item == 1) == [(1, 1, 10), (2, 11, 10), (3, 21, 5)]
    assert Counter(r._item for r in got)[2] == 2 and not {3, 4} & {r._item for r in got}
    report = packing.fill_report(packing.pack(df, 10, (2, 4)), 10).first()
    assert report.tokens == 9052 and report.items == len(got) and report.fullest <= 10
    assert packing.pack(df.limit(0), 10).count() == 0 and packing.fill_report(packing.pack(df.limit(0), 10), 10).first().containers == 0


def test_token_sizes(spark):
    df = spark.createDataFrame([(1, "hello world"), (2, ""), (3, None), (4, "<|endoftext|> ok"), (5, "a" * 30_000)], "id long, text string")
    got = {r._item: r._size for r in packing.token_sizes(df, "id", "text").collect()}
    assert got[2] == 0 and got[3] is None and 1 <= got[1] <= 4 and got[4] > 3 and got[5] > 1000


def test_every_stratum_has_a_number_of_its_own(spark):
    spelled = [f"{c}/{o}" for c in ("gcc", "clang", "cc", "?") for o in ("o0", "o1", "o2", "o3", "os", "?")] + [None]
    df = spark.createDataFrame([(x,) for x in spelled * 2], "_spelled string")
    known, numbers = grouped_split.numbered_strata(df)
    assert set(known) == set(spelled) and len(known) == 25
    assert sorted(r._stratum for r in numbers.collect()) == list(range(25))
