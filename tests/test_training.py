"""Training: gradients against differences, falling loss, defined edges."""

import numpy as np
import pytest

from pathloom.operators import model, training


def test_gradients_equal_differences():
    rng = np.random.default_rng(0)
    w = {k: v.astype(np.float64) for k, v in model.init_weights(9, 3, 4, 3, 5, seed=1).items()}
    t = {k: v + 0.1 * rng.normal(size=v.shape) for k, v in w.items()}
    ids = rng.integers(3, 9, (2, 7))
    hidden = rng.random((2, 7)) < 0.4
    hidden[0, 2] = True
    loss, g = training.loss_and_gradients(w, t, ids, hidden, hidden)
    assert loss == pytest.approx(model.masked_loss(w, t, ids, hidden, hidden))
    for k in w:
        for at in [tuple(rng.integers(0, s) for s in w[k].shape) for _ in range(4)]:
            up, down = ({**w, k: w[k].copy()} for _ in range(2))
            up[k][at] += 1e-4
            down[k][at] -= 1e-4
            slope = (model.masked_loss(up, t, ids, hidden, hidden) - model.masked_loss(down, t, ids, hidden, hidden)) / 2e-4
            assert g[k][at] == pytest.approx(slope, abs=2e-4)


def test_loss_falls_and_edges(spark):
    rng = np.random.default_rng(1)
    df = spark.createDataFrame([(i, [int(x) for x in rng.integers(3, 12, int(rng.integers(0, 20)))]) for i in range(200)] + [(999, None)], "k long, ids array<int>")
    w = model.init_weights(12, 8, 8, 8, 8)
    new, target, log = training.train(df, "k", "ids", w, epochs=4, batch=20, rate=5e-3, mask="thirds", length=16, workers=2)
    assert [e for e, _ in log] == [1, 2, 3, 4] and log[-1][1] < 0.7 * log[0][1]
    assert set(new) == set(w) == set(target) and np.abs(target["conv0"] - w["conv0"]).max() < np.abs(new["conv0"] - w["conv0"]).max()
    same, _, none = training.train(df.limit(0), "k", "ids", w, epochs=1)
    assert none == [(1, 0.0)] and all((same[k] == w[k]).all() for k in w)


def test_places_that_are_not_seen_do_not_matter():
    rng = np.random.default_rng(2)
    w = {k: v.astype(np.float64) for k, v in model.init_weights(9, 3, 4, 3, 5, seed=1).items()}
    ids = rng.integers(3, 9, (6, 40))
    asked = np.zeros((6, 40), bool)
    asked[[0, 1, 2, 3, 3], [0, 39, 20, 7, 12]] = True
    loss, _ = training.loss_and_gradients(w, w, ids, asked, asked)
    assert loss == pytest.approx(model.masked_loss(w, w, ids, asked, asked))
    assert training.seen_part(ids, asked, asked)[0].shape == (4, 16)


def test_only_what_is_seen_leaves_the_rows(spark):
    """Long rows give what the whole padded ones give, step by step, and batches without an asked place decay the weights."""
    rng = np.random.default_rng(3)
    w = {k: v.astype(np.float64) for k, v in model.init_weights(30, 4, 6, 5, 7).items()}
    ids, hidden = rng.integers(3, 30, (5, 60)), np.zeros((5, 60), bool)
    hidden[[0, 1, 2, 4, 4, 4], [0, 59, 31, 7, 8, 30]] = True
    places = training.Places(np.full(5, 60), hidden.ravel())
    assert len(places.ids) < 6 * 7 + 1 and np.allclose(places.forward(w, ids.ravel())["z"], model.encode_batch(w, ids)[hidden])
    df = spark.createDataFrame([(i, rng.integers(3, 30, n).tolist()) for i, n in enumerate((400, 1, 0, 7, 12, 300, 64))], "k long, ids array<int>")
    whole, cut = (training.train(df, "k", "ids", w, epochs=1, batch=3, length=n, workers=1)[2][0][1] for n in (500, 5000))
    assert whole == pytest.approx(cut) and whole > 0
    one = {k: v.copy() for k, v in w.items()}
    training.AdamW(1e-3).step(one, None)
    assert all(np.allclose(one[k], w[k] * (1 - 1e-5)) for k in w)
