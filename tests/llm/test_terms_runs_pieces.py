"""Term frequencies, runs and pieces on small fixtures."""

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from pathloom.llm import chunking, event_runs, term_frequency
from pathloom.llm.arrow_tokens import hash_strings, pack, token_batch, unpack

TOKENS = "id long, tokens array<string>, term string, _id string, mark int"


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x", "y", 1) for r in rows], TOKENS)


def test_terms(spark):
    rows = [(1, ["a", "b", "a", None]), (1, ["a", "b", "a", None]), (2, ["a", ""]), (3, []), (4, None), (None, ["b"]), (None, ["b"])]
    got = {r.term: (r.occurrences, r.records, r.mark) for r in term_frequency.marked_terms(frame(spark, rows), "id", "tokens", 2, 0.4).collect()}
    assert got == {"a": (3, 2, None), "b": (3, 3, "common"), "": (1, 1, "rare")}
    assert term_frequency.record_count(frame(spark, rows), "id").first().n == 6


def test_terms_of_nothing(spark):
    assert term_frequency.marked_terms(frame(spark, []), "id").count() == 0
    assert term_frequency.marked_terms(frame(spark, [(1, None), (2, [])]), "id").count() == 0


def test_hot_term_and_long_record(spark):
    rows = [(i, ["hot"] * 3 + [f"t{i % 7}"]) for i in range(300)] + [(999, ["long"] * 50_000)]
    got = {r.term: (r.occurrences, r.records) for r in term_frequency.term_frequencies(frame(spark, rows), "id").collect()}
    assert got["hot"] == (900, 300) and got["long"] == (50_000, 1) and len(got) == 9


def test_many_distinct_terms_take_the_sparse_way(monkeypatch, spark):
    from pathloom.llm import arrow_tokens

    monkeypatch.setattr(arrow_tokens, "_DENSE", 10)
    import pyarrow as pa

    b = token_batch(pa.array([["a", "b", "a"], [], ["c", None, "a"]], pa.list_(pa.string())))
    row, code, count = arrow_tokens.row_counts(b)
    assert [(r, b.words[c], n) for r, c, n in zip(row, code, count, strict=True)] == [(0, "a", 2), (0, "b", 1), (2, "a", 1), (2, "c", 1), (2, None, 1)]
    assert [unpack(p).tolist() for p in pack(b)] == [hash_strings(x).tolist() for x in (["a", "b", "a"], [], ["c", None, "a"])]


@settings(max_examples=50, deadline=None)
@given(st.lists(st.one_of(st.none(), st.lists(st.one_of(st.none(), st.text(max_size=3)), max_size=8)), max_size=6))
def test_packing_is_exact(lists):
    import pyarrow as pa

    b = token_batch(pa.array(lists, pa.list_(pa.string())))
    assert [unpack(p).tolist() for p in pack(b)] == [hash_strings(x or []).tolist() for x in lists]


RUNS = "id long, tokens array<string>, ticks array<bigint>, token string, start_pos int"


def runs(spark, rows, least=1):
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], RUNS)
    return sorted(tuple(r) for r in event_runs.event_runs(df, "id", least=least).collect())


def test_runs(spark):
    rows = [(1, ["a", " A", "a@x", "<b@1>", "<B>", "<B@"], [1, None, 5, 9, 4, 7]), (2, [None, "a", None, "a"], [1, 2]), (3, [], None), (4, None, None), (5, ["a"], None)]
    assert runs(spark, rows) == [
        (1, "<B", 6, 6, 1, 7, 7, 0),
        (1, "<B>", 4, 5, 2, 9, 4, -5),
        (1, "A", 1, 3, 3, 1, 5, 4),
        (2, "A", 2, 2, 1, 2, 2, 0),
        (2, "A", 4, 4, 1, None, None, None),
        (5, "A", 1, 1, 1, None, None, None),
    ]
    assert runs(spark, rows, 3) == [(1, "A", 1, 3, 3, 1, 5, 4)]


def test_runs_of_repeated_and_null_entities(spark):
    rows = [(1, ["a", "a"], [1, 2]), (1, ["a", "a"], [1, 2]), (None, ["a"], [7, 8, 9])]
    got = runs(spark, [r for r in rows if r[0]])
    assert got == [(1, "A", 1, 2, 2, 1, 2, 1)] * 2
    assert runs(spark, rows[2:]) == [(None, "A", 1, 1, 1, 7, 7, 0)]
    assert runs(spark, []) == []


def test_a_run_of_one_long_trace(spark):
    assert runs(spark, [(1, ["x"] * 20_000 + ["y"], list(range(20_001)))], 4) == [(1, "X", 1, 20_000, 20_000, 0, 19_999, 19_999)]


def cut_by_hand(ends, limit, overlap):
    n, s, out = len(ends), 0, []
    while n - s > limit:
        good = [e for e in range(s + overlap, s + limit) if ends[e]]
        e = good[-1] if good else s + limit - 1
        out.append((s, e))
        s = e - overlap + 1
    return [*out, (s, n - 1)] if n else out


@settings(max_examples=80, deadline=None)
@given(st.lists(st.integers(0, 300), max_size=5), st.sampled_from([0.0, 0.02, 0.3, 1.0]), st.integers(2, 60), st.integers(0, 40), st.integers(0, 99))
def test_pointer_doubling_equals_the_greedy_walk(sizes, density, limit, overlap, seed):
    overlap = min(overlap, limit - 1)
    starts = np.concatenate(([0], np.cumsum(sizes))).astype(np.int64)
    ends = np.random.default_rng(seed).random(starts[-1]) < density
    first, last, _ = chunking.greedy_pieces(ends, starts, limit, overlap)
    want = [(a + starts[i], b + starts[i]) for i in range(len(sizes)) for a, b in cut_by_hand(ends[starts[i] : starts[i + 1]], limit, overlap)]
    assert list(zip(first.tolist(), last.tolist(), strict=True)) == want


def test_pieces(spark):
    rows = [(1, ["x"] * 10), (2, ["x", "JK_RET", "x", None, "<API_Q>", "x"]), (3, None), (4, []), (2, ["x", "JK_RET", "x", None, "<API_Q>", "x"]), (5, ["x"] * 4)]
    df = frame(spark, rows)
    got = sorted((r.id, r.start_pos, r.end_pos, r.n_tokens, r.at_block_end) for r in chunking.split_oversized(df, "id", limit=4, overlap=1).collect())
    assert got == [(1, 1, 4, 4, False), (1, 4, 7, 4, False), (1, 7, 10, 4, False), (2, 1, 2, 2, True), (2, 2, 5, 4, True), (2, 5, 6, 2, False)]
    assert chunking.split_oversized(df, "id", limit=4, overlap=1, keep_small=True).filter("id = 5").count() == 1
    assert chunking.split_oversized(frame(spark, []), "id").count() == 0


def test_null_ids_keep_their_pieces(spark):
    got = chunking.split_oversized(frame(spark, [(None, ["x"] * 5), (None, ["x"] * 5)]), "id", limit=4, overlap=0)
    assert sorted((r.id, r.start_pos) for r in got.select("id", "start_pos").collect()) == [(None, 1), (None, 5)]


def test_canonical_events(spark):
    df = spark.createDataFrame([("\tfoo@2 ",), ("<a@b>",), ("<a@b",), ("a>@b>",), (None,), ("  ",)], "t string")
    assert [r[0] for r in df.select(event_runs.canonical_event(F.col("t"))).collect()] == ["FOO", "<A>", "<A", "A>", None, ""]
