"""Training of the joint-embedding model, data-parallel on the tasks.

In every epoch each worker goes through its part of the rows in mini-batches,
from the same weights, with AdamW and the moving average of the target encoder;
then the workers' weights are averaged by their number of rows.  What travels
is one set of weights per worker and epoch, whatever the number of rows.
"""

from __future__ import annotations

import io
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.arrays import MASK, MASKS, pad_truncate
from .model import SEEN, STEP, Weights, gelu


def gelu_slope(x: np.ndarray, of: np.ndarray) -> np.ndarray:
    """The derivative of GELU; of: ``gelu(x)``."""
    normal = np.divide(of, x, out=np.full_like(x, 0.5), where=x != 0)
    return (normal + x * np.exp(-0.5 * x * x) / math.sqrt(2 * math.pi)).astype(x.dtype, copy=False)


def seen_part(ids: np.ndarray, hidden: np.ndarray, asked: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The columns of each row that its asked places see; loss and gradients are the same as of the whole rows.

    Every row is cut to one width, that of the widest; a row's cut ends with the
    row or ``SEEN`` places beyond its asked ones.
    """
    n = ids.shape[1]
    some = asked.any(1)
    if not some.any():
        return ids[:0], hidden[:0], asked[:0]
    ids, hidden, asked = ids[some], hidden[some], asked[some]
    first = np.maximum(asked.argmax(1) - SEEN, 0)
    last = np.minimum(n - asked[:, ::-1].argmax(1) + SEEN, n)
    width = int((last - first).max())
    at = np.minimum(first, n - width)[:, None] + np.arange(width)
    return tuple(np.take_along_axis(x, at, 1) for x in (ids, hidden, asked))


class Places:
    """The places that the asked ones of some sequences, which lie end to end, see at each layer; no others are calculated."""

    def __init__(self, sizes: np.ndarray, asked: np.ndarray) -> None:
        # sequences with room between them, which stands for the zeros around each
        self.at = np.arange(len(asked)) + SEEN * (np.repeat(np.arange(len(sizes)), sizes) + 1)
        self.room = len(asked) + SEEN * (len(sizes) + 1)
        inside = np.zeros(self.room, bool)
        inside[self.at] = True
        self.asked = asked
        top = self.at[asked]
        middle, self.second = self._below(top, 1, inside)
        low, self.first = self._below(middle, 2, inside)
        self.ids = low[:, None] + np.arange(-2, 3)

    def _below(self, places: np.ndarray, half: int, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The places of the layer below, and for each place the numbers of those at its taps; the last number is for none."""
        near, seen = places[:, None] + np.arange(-half, half + 1), np.zeros(self.room, bool)
        seen[near] = True
        below = np.flatnonzero(seen & inside)
        number = np.full(self.room, len(below))
        number[below] = np.arange(len(below))
        return below, number[near]

    def forward(self, w: Weights, ids: np.ndarray) -> dict[str, np.ndarray]:
        """The vectors of the asked places, and what led to them."""
        known = np.zeros(len(w["embedding"]), bool)
        known[ids] = True
        terms, number = np.flatnonzero(known), np.zeros(self.room, np.int64)
        number[self.at] = np.cumsum(known)[ids]  # from 1; 0 is a place outside
        number, of = number[self.ids], w["embedding"][terms]
        a0 = np.repeat(w["conv0_bias"][None], len(number), 0)
        table = np.zeros((len(terms) + 1, a0.shape[1]), of.dtype)
        for k in range(number.shape[1]):
            np.matmul(of, w["conv0"][k], out=table[1:])
            a0 += table.take(number[:, k], axis=0)
        h0 = gelu(a0)
        near0 = _taps(h0, self.first)
        a1 = near0 @ w["conv1"].reshape(near0.shape[1], -1) + w["conv1_bias"]
        h1 = gelu(a1)
        near1 = _taps(h1, self.second)
        z = near1 @ w["conv2"].reshape(near1.shape[1], -1) + w["conv2_bias"]
        return {"terms": terms, "number": number, "of": of, "a0": a0, "h0": h0, "near0": near0, "a1": a1, "h1": h1, "near1": near1, "z": z}

    def back(self, w: Weights, f: dict[str, np.ndarray], dz: np.ndarray) -> Weights:
        """Gradients of the encoder's weights."""
        g = {"conv2": (f["near1"].T @ dz).reshape(w["conv2"].shape), "conv2_bias": dz.sum(0)}
        da1 = _untaps(dz @ w["conv2"].reshape(-1, dz.shape[1]).T, self.second, len(f["h1"])) * gelu_slope(f["a1"], f["h1"])
        g |= {"conv1": (f["near0"].T @ da1).reshape(w["conv1"].shape), "conv1_bias": da1.sum(0)}
        da0 = _untaps(da1 @ w["conv1"].reshape(-1, da1.shape[1]).T, self.first, len(f["h0"])) * gelu_slope(f["a0"], f["h0"])
        taps, wide, deep = w["conv0"].shape
        # by distinct id and tap: the sum of the gradients where it stands there
        sums = np.zeros((len(f["terms"]) + 1, taps, deep), da0.dtype)
        for k in range(taps):
            number = f["number"][:, k]
            order = np.argsort(number, kind="stable")
            number = number[order]
            begin = np.flatnonzero(np.concatenate(([True], number[1:] != number[:-1])))
            sums[number[begin], k] = np.add.reduceat(da0[order], begin, axis=0)
        sums = sums[1:].reshape(-1, taps * deep)
        g |= {"conv0": np.ascontiguousarray((f["of"].T @ sums).reshape(wide, taps, deep).transpose(1, 0, 2)), "conv0_bias": da0.sum(0)}
        g["embedding"] = np.zeros_like(w["embedding"])
        g["embedding"][f["terms"]] = sums @ w["conv0"].transpose(0, 2, 1).reshape(taps * deep, wide)
        return g


def _taps(x: np.ndarray, near: np.ndarray) -> np.ndarray:
    """For each place the vectors at its taps as one row; zeros where there is none."""
    return np.concatenate([x, np.zeros((1, x.shape[1]), x.dtype)]).take(near, axis=0).reshape(len(near), -1)


def _untaps(d: np.ndarray, near: np.ndarray, n: int) -> np.ndarray:
    """The gradient of ``x``, of n rows, from that of ``_taps(x, near)``."""
    d = d.reshape(*near.shape, -1)
    out = np.zeros((n + 1, d.shape[2]), d.dtype)
    for k in range(near.shape[1]):
        out[near[:, k]] += d[:, k]  # no place stands twice at a tap, but for the last row, which is none
    return out[:n]


def flat_gradients(w: Weights, target: Weights, ids: np.ndarray, hidden: np.ndarray, asked: np.ndarray, sizes: np.ndarray) -> tuple[float, Weights | None]:
    """``loss_and_gradients`` of sequences that lie end to end; no gradients where no place is asked."""
    if not asked.any():
        return 0.0, None
    places = Places(sizes, asked)
    f = places.forward(w, np.where(hidden, MASK, ids))
    z = f["z"]
    p = z @ w["linear0"] + w["linear0_bias"]
    q = gelu(p)
    d = q @ w["linear1"] + w["linear1_bias"] - places.forward(target, ids)["z"]
    loss = float(np.where(np.abs(d) < 1, 0.5 * d * d, np.abs(d) - 0.5).mean())
    dy = (np.clip(d, -1, 1) / d.size).astype(d.dtype)
    g = {"linear1": q.T @ dy, "linear1_bias": dy.sum(0)}
    dp = dy @ w["linear1"].T * gelu_slope(p, q)
    g |= {"linear0": z.T @ dp, "linear0_bias": dp.sum(0)}
    return loss, g | places.back(w, f, dp @ w["linear0"].T)


def loss_and_gradients(w: Weights, target: Weights, ids: np.ndarray, hidden: np.ndarray, asked: np.ndarray) -> tuple[float, Weights]:
    """The smooth L1 loss at the asked places, from ids with the hidden places masked, and its gradients.

    No place asked: no loss.
    """
    ids, hidden, asked = seen_part(ids, hidden, asked)
    loss, g = flat_gradients(w, target, ids.ravel(), hidden.ravel(), asked.ravel(), np.full(len(ids), ids.shape[1]))
    return loss, g or {k: np.zeros_like(v) for k, v in w.items()}


@dataclass
class AdamW:
    """Adam with decoupled weight decay."""

    rate: float = 1e-4
    decay: float = 0.01
    steps: int = 0
    first: Weights | None = None
    second: Weights | None = None

    def step(self, w: Weights, g: Weights | None) -> None:
        """Changes ``w`` in place, in steps that stay in the cache; no gradients count as zeros."""
        self.first = self.first or {k: np.zeros_like(v) for k, v in w.items()}
        self.second = self.second or {k: np.zeros_like(v) for k, v in w.items()}
        self.steps += 1
        rate, root = self.rate / (1 - 0.9**self.steps), 1 / math.sqrt(1 - 0.999**self.steps)
        for k, v in w.items():
            arrays = [x.reshape(-1) for x in (v, self.first[k], self.second[k])] + [None if g is None else np.ascontiguousarray(g[k]).reshape(-1)]
            for i in range(0, v.size, STEP):
                x, m, s, d = (None if y is None else y[i : i + STEP] for y in arrays)
                m *= 0.9
                s *= 0.999
                if d is not None:
                    m += 0.1 * d
                    s += 0.001 * d * d
                below = np.sqrt(s)
                below *= root
                below += 1e-8
                np.divide(m, below, out=below)
                below *= rate
                x *= 1 - self.rate * self.decay
                x -= below


def _follow(target: Weights, online: Weights, m: float) -> None:
    """``ema_update`` in place."""
    for k, v in target.items():
        t, o = v.reshape(-1), online[k].reshape(-1)
        for i in range(0, t.size, STEP):
            t[i : i + STEP] *= m
            t[i : i + STEP] += (1 - m) * o[i : i + STEP]


def _packed(*sets: Weights) -> bytes:
    out = io.BytesIO()
    np.savez(out, **{f"{i}.{k}": v for i, s in enumerate(sets) for k, v in s.items()})
    return out.getvalue()


def _unpacked(data: bytes) -> list[Weights]:
    sets: dict[int, Weights] = {}
    with np.load(io.BytesIO(data), allow_pickle=False) as f:
        for name in f.files:
            i, _, k = name.partition(".")
            sets.setdefault(int(i), {})[k] = f[name]
    return [sets[i] for i in sorted(sets)]


def train(df: DataFrame, key: str, ids: str, weights: Weights, epochs: int = 10, batch: int = 20, rate: float = 1e-4, mask: str = "random_token", length: int = 64, workers: int = 4, momentum: float = 0.996) -> tuple[Weights, Weights, list[tuple[int, float]]]:
    """(encoder and predictor, target encoder, [(epoch, mean loss)]).

    Sequences are cut or padded to ``length``; the order of rows is that of their
    keys' hashes.  An empty frame leaves the weights as they are, at a loss of 0.
    """
    padded = df.select(F.col(key).alias("_k"), pad_truncate(F.coalesce(ids, F.array().cast("array<int>")), length).alias("_ids"))
    hidden, asked = MASKS[mask](F.col("_ids"), F.col("_k"))
    masked = padded.select("_ids", hidden.alias("_hidden"), asked.alias("_asked"), F.xxhash64("_k").alias("_order"))
    # of each row what its asked places see, before it moves; a row without any stays in its batch
    first = F.array_position("_asked", True)
    last = F.size("_asked") + 1 - F.array_position(F.reverse("_asked"), True)
    low, high = F.greatest(first - SEEN, F.lit(1)), F.when(first > 0, F.least(last + SEEN, F.size("_asked"))).otherwise(0)
    cut = masked.withColumns({"_low": low.cast("int"), "_n": F.greatest(high - low + 1, F.lit(0)).cast("int")})
    cut = cut.select(*(F.slice(c, F.col("_low"), F.col("_n")).alias(c) for c in ("_ids", "_hidden", "_asked")), "_order")
    rows = cut.repartition(workers, "_order").sortWithinPartitions("_order")
    online, target, log = dict(weights), dict(weights), []

    for epoch in range(1, epochs + 1):
        sent = _packed(online, target)

        def run(source: Iterator[pa.RecordBatch], sent: bytes = sent) -> Iterator[pa.RecordBatch]:
            w, t = _unpacked(sent)
            adam, total, n = AdamW(rate), 0.0, 0
            for b in source:
                sizes = np.asarray(pc.list_value_length(b.column(0))).astype(np.int64)
                x, h, a = (c.flatten().to_numpy(zero_copy_only=False) for c in b.columns[:3])
                starts = np.concatenate(([0], np.cumsum(sizes)))
                for i in range(0, len(sizes), batch):
                    some = sizes[i : i + batch]
                    part = slice(starts[i], starts[i + len(some)])
                    loss, g = flat_gradients(w, t, x[part], h[part], a[part], some)
                    adam.step(w, g)
                    _follow(t, w, momentum)
                    total, n = total + loss * len(some), n + len(some)
            if n:
                yield pa.RecordBatch.from_arrays([pa.array([_packed(w, t)], pa.binary()), pa.array([total]), pa.array([n])], names=["w", "loss", "n"])

        parts = rows.drop("_order").mapInArrow(run, "w binary, loss double, n long").collect()  # one row per worker
        n = sum(r["n"] for r in parts)
        if n:
            sets = [(_unpacked(bytes(r["w"])), r["n"] / n) for r in parts]
            online, target = ({k: sum(s[i][k] * share for s, share in sets).astype(v.dtype) for k, v in weights.items()} for i in (0, 1))
        log.append((epoch, sum(r["loss"] for r in parts) / n if n else 0.0))
    return online, target, log
