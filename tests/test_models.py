"""The model's queries take whole paths and all ids, at the reference's sizes."""

import numpy as np

from pathloom.operators import model as M
from pathloom.plans import catalog, models


def test_paths_are_encoded_whole(spark, sf):
    ids, weights = models._model(spark, sf)
    want = {r.path_id: len(r.ids) for r in ids.collect()}
    assert max(want.values()) > 64
    got = {r.path_id: r.dims for r in catalog.queries()["encode_paths"](spark, sf).collect()}
    assert got == {k: n * 256 for k, n in want.items()}
    assert weights["conv0"].shape == (5, 128, 256) and weights["linear0"].shape == (256, 512)


def test_the_mask_follows_the_last_token(spark):
    w = M.init_weights(5000, 4, 6, 6, 8)
    rng = np.random.default_rng(0)
    paths = {i: rng.integers(3, 5000, n).tolist() for i, n in enumerate((0, 1, 64, 65, 300, 9000))}
    df = spark.createDataFrame(list(paths.items()), "k long, ids array<int>")
    for r in M.predict_paths(df, ["k"], "ids", w).collect():
        z = M.predict_batch(w, M.encode_batch(w, np.array([[*paths[r.k], 2]]))[:, -1])[0]
        assert np.allclose(r.emb, z / np.linalg.norm(z), atol=1e-5)
    got = {r.k: len(r.emb) for r in M.encode_paths(df, ["k"], "ids", w).collect()}
    assert got == {k: 6 * len(v) for k, v in paths.items()}


def test_padded_sequences_compare_as_if_encoded_whole():
    w = M.init_weights(50, 4, 6, 6, 8)
    rng = np.random.default_rng(1)
    for length in (12, 40):
        e = M.PaddedEncoder(w, length)
        rows = [rng.integers(3, 50, n) for n in (1, 3, 12, 20, 29, 31, 36, 40, 60)]
        whole = []
        for r in rows:
            x = np.zeros((1, length), np.int64)
            x[0, : min(length, len(r))] = r[:length]
            z = M.encode_batch(w, x).ravel()
            whole.append(z / np.linalg.norm(z))
        for i, a in enumerate(rows):
            for j, b in enumerate(rows):
                got = e.compare(e.encode(a), e.encode(b))
                assert np.allclose(got[0], whole[i] @ whole[j], atol=1e-5)
                assert np.allclose(got[1], np.linalg.norm(whole[i] - whole[j]), atol=2e-3)


def test_only_what_the_masked_place_sees_is_encoded(spark, sf):
    ids, weights = models._model(spark, sf)
    seen, same = models._model(spark, sf, M.SEEN)
    assert all((weights[k] == same[k]).all() for k in weights)
    whole = {r.path_id: r.ids for r in ids.collect()}
    assert {r.path_id: r.ids for r in seen.collect()} == {k: v[-5:] for k, v in whole.items()}
    w = {k: v.astype(np.float64) for k, v in weights.items()}
    rows = [v for v in whole.values() if len(v) > 30][:20] + [[], [5], [5, 6, 7]]
    for v in rows:
        x = np.array([[*v, 2]])
        assert np.allclose(M.encode_last(w, x), M.encode_batch(w, x)[:, -1])


def test_sequences_end_to_end_are_encoded_as_alone(monkeypatch):
    w = {k: v.astype(np.float64) for k, v in M.init_weights(40, 4, 6, 6, 8).items()}
    rng = np.random.default_rng(2)
    sizes = np.array([0, 1, 2, 3, 0, 7, 300, 12, 0])
    ids = rng.integers(0, 40, int(sizes.sum()))
    ids[100:140] = ids[20:60]
    ends = np.cumsum(sizes)
    whole = np.concatenate([M.encode_batch(w, ids[e - n : e][None])[0] for n, e in zip(sizes, ends, strict=True) if n])
    for places in (M.PLACES, 64):
        monkeypatch.setattr(M, "PLACES", places)
        assert np.allclose(np.concatenate(list(M.encode_flat(w, ids, sizes))), whole)


def test_padded_rows_encoded_together_are_as_alone(monkeypatch):
    w = M.init_weights(50, 4, 6, 6, 8)
    rng = np.random.default_rng(4)
    rows = [rng.integers(3, 50, n) for n in (0, 1, 12, 29, 30, 31, 40, 60, 5)]
    monkeypatch.setattr(M, "SHARED", 90)
    e = M.PaddedEncoder(w, 40)
    for r, z in zip(rows, e.encode_all(rows), strict=True):
        x = np.zeros((1, 40), np.int64)
        x[0, : min(40, len(r))] = r[:40]
        assert len(z) == (40 if len(r) >= 30 else len(r) + 5)
        assert np.allclose(z, M.encode_batch(w, x)[0, : len(z)], atol=1e-5)
