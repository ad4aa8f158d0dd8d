"""Nearest vectors against brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from pathloom.llm import nearest

SCHEMA = "id long, v array<float>, _id long, rank int, neighbour string"


def frame(spark, rows):
    return spark.createDataFrame([(*r, 1, 2, "x") for r in rows], SCHEMA)


def brute(rows, k):
    ok = {i: np.array(v, np.float64) for i, v in rows if i is not None and v is not None and len(v) == 8 and all(x is not None and np.isfinite(x) for x in v) and any(v)}
    ids = sorted(ok)
    x = np.array([ok[i] / np.linalg.norm(ok[i]) for i in ids])
    s = np.round(x @ x.T, 9)
    out = {}
    for a, i in enumerate(ids):
        near = sorted((b for b in range(len(ids)) if b != a), key=lambda b: (-s[a, b], ids[b]))[:k]
        out[i] = [(ids[b], s[a, b]) for b in near]
    return out


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(12, 8))
    v = [(centres[i % 12] + 0.4 * rng.normal(size=8)).astype(np.float32).tolist() for i in range(400)]
    rows = list(enumerate(v))
    rows += [(1000 + i, v[7]) for i in range(150)]  # a hot group of copies
    rows += [(2000, None), (2001, v[0][:7]), (2002, [0.0] * 8), (2003, [float("nan")] * 8), (2004, [float("inf")] + v[0][1:]), (2005, [None, *v[0][1:]]), (None, v[1])]
    rows += [(3000, [x * 1e6 for x in v[3]]), (3001, [x * 1e-6 for x in v[3]])]
    return rows


def test_neighbours_and_copies(spark, rows):
    want = brute(rows, 4)
    got = {}
    for r in nearest.neighbours(frame(spark, rows), "id", "v", 4, 8, orderings=4, window=100_000).collect():
        got.setdefault(r.id, []).append((r["rank"], r.neighbour, r.similarity))
    assert set(got) == set(want)
    for i, near in got.items():
        near.sort()
        assert [r for r, _, _ in near] == [1, 2, 3, 4]
        assert [s for _, _, s in near] == pytest.approx([s for _, s in want[i]], abs=2e-3)
        assert i not in [n for _, n, _ in near]
    assert [n for _, n, _ in got[1140]] == [n for n, _ in want[1140]]  # ties: the smaller id first


def test_windows_find_most(spark):
    rng = np.random.default_rng(9)
    centres = rng.normal(size=(40, 32))
    x = (centres[rng.integers(0, 40, 3000)] + 0.5 * rng.normal(size=(3000, 32))).astype(np.float32)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, v array<float>")
    got = {}
    for r in nearest.neighbours(df, "id", "v", 5, 32, orderings=4, window=700).collect():
        got.setdefault(r.id, set()).add(r.neighbour)
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    s = u @ u.T
    np.fill_diagonal(s, -2)
    asked = range(0, 3000, 20)
    hit = [len(got[i] & set(np.argsort(-s[i])[:5].tolist())) / 5 for i in asked]
    assert np.mean(hit) >= 0.9


@pytest.mark.parametrize("window", [300, 75])
def test_recall_does_not_fall_with_the_number_of_windows(spark, window):
    rng = np.random.default_rng(9)
    centres = rng.normal(size=(40, 32))
    x = (centres[rng.integers(0, 40, 3000)] + 0.5 * rng.normal(size=(3000, 32))).astype(np.float32)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, v array<float>")
    got = {}
    for r in nearest.neighbours(df, "id", "v", 5, 32, window=window).collect():
        got.setdefault(r.id, set()).add(r.neighbour)
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    s = u @ u.T
    np.fill_diagonal(s, -2)
    assert np.mean([len(got[i] & set(np.argsort(-s[i])[:5].tolist())) / 5 for i in range(0, 3000, 20)]) >= 0.9


def test_pairs_near_the_threshold_are_exact(spark, rows):
    want = {(min(i, n), max(i, n)) for i, near in brute(rows, 5).items() for n, s in near if s >= 0.9}
    got = nearest.similar_pairs(frame(spark, rows), "id", "v", 0.9, 5, dim=8, orderings=4, window=100_000)
    assert {(r.a, r.b) for r in got.collect()} == want


def test_few_or_no_rows(spark):
    assert nearest.neighbours(frame(spark, []), "id", "v", 5, 8).count() == 0
    assert nearest.neighbours(frame(spark, [(1, [1.0] * 8)]), "id", "v", 5, 8).count() == 0
    two = nearest.neighbours(frame(spark, [(1, [1.0] * 8), (2, [1.0] * 8), (2, [1.0] * 8)]), "id", "v", 5, 8).collect()
    assert sorted((r.id, r.neighbour, r["rank"]) for r in two) == [(1, 2, 1), (2, 1, 1)]
    got = nearest.exact_pairs(spark.createDataFrame([(1, 2)], "a long, b long"), frame(spark, [(1, [3.0, 4.0]), (2, [4.0, 3.0])]), "id", "v").first()
    assert got.cosine == pytest.approx(0.96)


def test_hilbert_curve_goes_from_cell_to_cell():
    for dims, bits in ((2, 3), (3, 2), (4, 1)):
        cells = np.stack(np.meshgrid(*[np.arange(2**bits)] * dims, indexing="ij"), -1).reshape(-1, dims)
        key = nearest.hilbert_index(cells.astype(np.uint32), bits)
        assert sorted(key.tolist()) == list(range(len(cells)))
        walk = cells[np.argsort(key)]
        assert (np.abs(np.diff(walk.astype(int), axis=0)).sum(1) == 1).all()


def test_hidden_columns_do_not_clash(spark, rows):
    df = frame(spark, rows[:30]).withColumn("_v", F.lit("x")).withColumn("_key", F.lit(1))
    assert nearest.neighbours(df, "id", "v", 2, 8).count() == 60


@pytest.mark.parametrize("dim", [1, 7, 256])
def test_packed_vectors_keep_their_direction(dim):
    v = np.random.default_rng(0).normal(size=(50, dim)).astype(np.float32)
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    back = nearest.unpack12(nearest.pack12(v), dim)
    assert back.shape == v.shape and np.abs((back * u).sum(1) - 1).max() < 1e-5
    assert np.abs(back @ back.T - u @ u.T).max() < nearest.SLACK
