"""Operators of the core on small fixtures."""

import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from pathloom.operators import corpus, graph, model, sequences, series, similarity, vocabulary
from pathloom.sources.once import once
from pathloom.sources.shared import written


def test_nearest_rank_takes_the_lower_place(spark):
    df = spark.createDataFrame([(float(i),) for i in range(10)], "v double")
    assert {r.p: r.value for r in corpus.nearest_rank(df, "v", (0, 75, 100)).collect()} == {0: 0, 75: 6, 100: 9}


def test_vocab_ties_specials_and_floor(spark):
    df = spark.createDataFrame([(["b", "a", "b", "a", "c", "<UNK>", "<UNK>", None],)], "tokens array<string>")
    v = vocabulary.build_vocab(vocabulary.token_freq(df))
    assert sorted((r.id, r.token) for r in v.collect()) == [(0, "<PAD>"), (1, "<UNK>"), (2, "<MASK>"), (3, "a"), (4, "b")]


@pytest.mark.parametrize("most", [1000, 1])
def test_encode_both_ways(spark, most):
    df = spark.createDataFrame([(1, ["a", "x", None, "b"]), (2, []), (3, None), (4, ["b"])], "id int, tokens array<string>")
    v = spark.createDataFrame([("a", 3, 1), ("b", 4, 1)], "token string, id int, freq int")
    got = {r.id: list(r.ids) for r in vocabulary.encode(df, v, most_sent=most).collect()}
    assert got == {1: [3, 1, 1, 4], 2: [], 3: [], 4: [4]}


def test_decode_is_the_inverse(spark):
    df = spark.createDataFrame([(1, ["a", "b", "a"])], "id int, tokens array<string>")
    v = spark.createDataFrame([("a", 3, 1), ("b", 4, 1)], "token string, id int, freq int")
    assert vocabulary.decode(vocabulary.encode(df, v), v).first().decoded == ["a", "b", "a"]


def test_trim_common_prefix(spark):
    rows = [(1, "f", list("aaaaaaaabX")), (2, "f", list("aaaaaaaacY")), (3, "g", list("abc")), (4, "h", list("ab")), (5, "h", list("abc"))]
    df = spark.createDataFrame(rows, "id int, f string, tokens array<string>")
    got = {r.id: r.trimmed for r in sequences.trim_common_prefix(df, ["f"], "tokens", 6).collect()}
    assert got == {1: 2, 2: 2, 3: 0, 4: 0, 5: 0}


def test_banded_join(spark):
    df = spark.createDataFrame([(i * 3, i) for i in range(7)], "k int, v int")
    got = {(r.a, r.b, r.v_a, r.v_b) for r in sequences.banded_join(df, "k", 3).collect()}
    assert got == {(i * 3, j * 3, i, j) for i in range(7) for j in range(i, min(7, i + 3))}


def test_ema(spark):
    df = spark.createDataFrame([(0, 1.0), (1, 3.0)], "epoch int, loss double")
    assert [r.smooth for r in series.ema(df, "epoch", "loss").orderBy("epoch").collect()] == pytest.approx([1.0, 1.3])


def test_extremes_take_the_first_of_ties(spark):
    df = spark.createDataFrame([(0, 2.0), (1, 1.0), (2, 1.0), (3, 2.0)], "epoch int, loss double")
    r = series.extremes(df, "epoch", "loss").first()
    assert (r.best, r.worst, r.final, r.first, r.last, r.n) == (1, 0, 2.0, 0, 3, 4)


def test_linkage_is_clamped(spark):
    df = spark.createDataFrame([(20, "a", [5.0, 0.0]), (1, "b", [0.0, 5.0]), (2, "c", [-5.0, 0.0])], "k long, g string, v array<double>")
    got = {(r.f1, r.f2): (r.distance, r.inner_product) for r in similarity.linkage(df, "k", "g", "v", F.col("k") % 20 == 0).collect()}
    assert got == {("a", "a"): (0.0, 25.0), ("a", "b"): (1.0, 0.0), ("a", "c"): (1.0, 0.0)}


def test_similarity_stats_equal_pairs_in_blocks(spark, monkeypatch):
    rng = np.random.default_rng(0)
    v = rng.normal(size=(200, 8))
    df = spark.createDataFrame([(i, i % 3, v[i].tolist()) for i in range(200)], "k long, g int, v array<double>")
    monkeypatch.setattr(similarity, "ROWS", 37)
    monkeypatch.setattr(similarity, "QUERIES", 3)
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    s = [(i % 3 == j % 3, u[i] @ u[j]) for i in range(0, 200, 20) for j in range(200) if i != j]
    for r in similarity.similarity_stats(df, "k", "g", "v", F.col("k") % 20 == 0).collect():
        x = np.array([d for p, d in s if p == r.is_positive])
        assert r.n == len(x) and (r["mean"], r["std"], r.low, r.high) == pytest.approx((x.mean(), x.std(ddof=1), x.min(), x.max()), abs=2e-6)


def test_paths_layers_and_order(spark):
    e = spark.createDataFrame([(1, "a", "b"), (1, "a", "c"), (1, "b", "d"), (1, "c", "d"), (1, "x", "y"), (2, "a", "b"), (2, "b", "a")], "func int, src string, dst string")
    paths = {(r.func, r.nth): "".join(r.path) for r in graph.simple_paths(e, "a").collect()}
    assert paths == {(1, 1): "abd", (1, 2): "acd", (2, 1): "ab"}
    assert {r.nth for r in graph.simple_paths(e, "a", most=1).filter("func = 1").collect()} == {1}
    assert ["".join(r.path) for r in graph.simple_paths(e, "a", longest=2).filter("func = 1").orderBy("nth").collect()] == ["ab", "ac"]
    assert {(r.node, r.layer) for r in graph.layers(e, "a").filter("func = 1").collect()} == {("a", 0), ("b", 1), ("c", 1), ("d", 2), ("x", 3), ("y", 3)}
    assert {r.layer for r in graph.layers(e, "nowhere").collect()} == {0}
    order = {(r.func, r.place): (r.node, r.cyclic) for r in graph.topological(e, "a").collect()}
    assert [order[1, i][0] for i in range(6)] == list("abcdxy") and order[2, 0] == ("a", True)


def test_encoder_sees_eleven_tokens_and_keeps_length():
    w = model.init_weights(50, emb=8, hidden=8, out=4, predictor=8)
    ids = np.arange(30)[None, :] % 50
    a = model.encode_batch(w, ids)
    assert a.shape == (1, 30, 4)
    other = ids.copy()
    other[0, 15] = 49
    changed = np.flatnonzero(np.abs(model.encode_batch(w, other) - a).sum(2)[0] > 1e-9)
    assert changed.min() == 10 and changed.max() == 20


def test_convolution_by_hand():
    x, w = np.array([[[1.0], [2.0], [3.0]]]), np.array([[[1.0]], [[10.0]], [[100.0]]])
    assert model.conv(x, w, np.zeros(1))[0, :, 0].tolist() == [210.0, 321.0, 32.0]


def test_losses_and_weights():
    assert model.smooth_l1(np.array([0.0, 0.5, 3.0]), np.zeros(3)) == pytest.approx((0 + 0.125 + 2.5) / 3)
    assert model.ema_update({"a": np.ones(2)}, {"a": np.zeros(2)}, 0.0)["a"].tolist() == [0, 0]
    assert model.gelu(np.array([0.0, 1.0, -1.0])) == pytest.approx([0.0, 0.8413447, -0.1586553], abs=1e-6)
    w = model.init_weights(20, emb=4, hidden=4, out=4, predictor=4)
    ids = np.arange(12).reshape(1, 12)
    m = np.zeros((1, 12), bool)
    m[0, 8:] = True
    assert model.masked_loss(w, w, ids, m, m) > 0


def test_models_handle_empty_sequences(spark):
    w = model.init_weights(20, emb=4, hidden=4, out=4, predictor=4)
    df = spark.createDataFrame([(1, [3, 4]), (2, []), (3, None)], "k int, ids array<int>")
    assert {r.k: len(r.emb) for r in model.encode_paths(df, "k", "ids", w).collect()} == {1: 8, 2: 0, 3: 0}
    assert {r.k: len(r.emb) for r in model.predict_paths(df.filter("ids IS NOT NULL"), "k", "ids", w).collect()} == {1: 4, 2: 4}


def test_shared_tables(spark):
    df = written(spark.range(5), "numbers")
    assert df.count() == 5 and df.columns == ["id"]


def test_once_keeps_one_row_of_every_key(spark, tmp_path):
    rows = [(1, "a"), (2, "b"), (1, "a"), (None, "c"), (None, "c"), (3, None), (2, "b"), (2, "b")]
    df = spark.createDataFrame(rows, "k long, v string").repartition(3)
    df.write.parquet(str(tmp_path / "t"))
    for frame in (df, spark.read.parquet(str(tmp_path / "t"))):
        for bound in (0, 10):
            got = sorted((tuple(r) for r in once(frame, "k", most_sent=bound).collect()), key=repr)
            assert got == sorted([(1, "a"), (2, "b"), (3, None), (None, "c")], key=repr)
            assert once(frame, "k", nulls=False, most_sent=bound).filter("k IS NULL").count() == 2
    assert once(df.limit(0), "k").count() == 0


def test_large_vocabularies_are_joined(spark):
    rng = random.Random(0)
    rows = [(i, [rng.choice("abcdefgh") for _ in range(rng.randrange(6))]) for i in range(300)]
    df = spark.createDataFrame(rows, "k long, tokens array<string>").repartition(5, "k")
    small = vocabulary.build_vocab(vocabulary.token_freq(df))
    large = vocabulary.build_vocab(vocabulary.token_freq(df), most_sorted=2)
    assert sorted(map(tuple, small.collect())) == sorted(map(tuple, large.collect()))
    known = {r.token: r.id for r in small.collect()}
    joined = vocabulary.encode(df, small, most_sent=3)
    assert {r.k: list(r.ids) for r in joined.collect()} == {k: [known[t] for t in v] for k, v in rows}
    back = vocabulary.decode(joined, small, most_sent=3)
    assert {r.k: list(r.decoded) for r in back.collect()} == dict(rows)


def test_bands_reach_over_ranges(spark):
    keys = [2, 3, 5, 8, 13, 21, 34, 55, 56, 57, 100, 101]
    df = spark.createDataFrame([(k, [k, k % 3]) for k in keys], "k long, ids array<int>")
    want = {(a, b) for i, a in enumerate(keys) for b in keys[i : i + 4]}
    for parts in (1, 3, 12):
        assert {(r.a, r.b) for r in sequences.banded_join(df, "k", 4, parts).collect()} == want

        def compare(k, values, starts, a, b):
            return pa.RecordBatch.from_arrays([pa.array(k[a]), pa.array(k[b]), pa.array(sequences.unlikeness(values, starts, a, b))], names=["a", "b", "u"])

        got = sequences.banded_comparison(df, "k", "ids", 4, compare, "a long, b long, u double", parts).collect()
        assert len(got) == len(want)
        assert {(r.a, r.b): r.u for r in got} == {(a, b): ((a != b) + (a % 3 != b % 3)) / 2 for a, b in want}
