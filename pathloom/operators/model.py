"""Inference of a joint-embedding model on id sequences, in numpy on the tasks.

Encoder: embedding, two convolutions of width 5 with GELU, one of width 3; each
pads with zeros to keep the length, so a place sees 11 tokens.  Predictor: two
linear layers with a GELU between.  Weights come from a checkpoint or a seed
and go to the tasks once; a batch of equal length is one matrix product per tap.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Weights = dict[str, np.ndarray]
#: Places that a product takes together, and a batch of results holds, unless one sequence is longer.
PLACES = 8192
#: Places whose runs of five ids are calculated once each, unless one sequence is longer.
SHARED = 16384


def init_weights(vocab: int, emb: int = 128, hidden: int = 256, out: int = 256, predictor: int = 512, seed: int = 0) -> Weights:
    """Uniform weights within one over the root of the inputs."""
    rng = np.random.default_rng(seed)

    def uniform(*shape: int, fan: int) -> np.ndarray:
        return rng.uniform(-1, 1, shape).astype(np.float32) / np.float32(np.sqrt(fan))

    w = {"embedding": rng.normal(size=(vocab, emb)).astype(np.float32)}
    for i, (k, a, b) in enumerate(((5, emb, hidden), (5, hidden, hidden), (3, hidden, out))):
        w[f"conv{i}"], w[f"conv{i}_bias"] = uniform(k, a, b, fan=k * a), uniform(b, fan=k * a)
    w["linear0"], w["linear0_bias"] = uniform(out, predictor, fan=out), uniform(predictor, fan=out)
    w["linear1"], w["linear1_bias"] = uniform(predictor, out, fan=predictor), uniform(out, fan=predictor)
    return w


#: Numerator and denominator of erf(x) / x in x squared, for x of 4 at most; both fall from the highest power.
ERF = (
    (-2.72614225801306e-10, 2.77068142495902e-08, -2.10102402082508e-06, -5.69250639462346e-05, -7.34990630326855e-04, -2.95459980854025e-03, -1.60960333262415e-02),
    (-1.45660718464996e-05, -2.13374055278905e-04, -1.68282697438203e-03, -7.37332916720468e-03, -1.42647390514189e-02),
)
#: Numbers that a step of ``gelu`` takes, so that its passes stay in the cache.
STEP = 16384


def gelu(x: np.ndarray) -> np.ndarray:
    """x times the normal distribution function, whose erf is a rational function."""
    x = np.ascontiguousarray(x)
    out, flat = np.empty_like(x), x.reshape(-1)
    to = out.reshape(-1)
    z, square, below = (np.empty(min(STEP, flat.size), x.dtype) for _ in range(3))
    for i in range(0, flat.size, STEP):
        part, above = flat[i : i + STEP], to[i : i + STEP]
        t, u, d = z[: len(part)], square[: len(part)], below[: len(part)]
        np.multiply(part, 0.7071067811865476, out=t)
        np.clip(t, -4, 4, out=t)
        np.multiply(t, t, out=u)
        for sums, factors in ((above, ERF[0]), (d, ERF[1])):
            np.multiply(u, factors[0], out=sums)
            for f in factors[1:-1]:
                sums += f
                sums *= u
            sums += factors[-1]
        above *= t
        above /= d
        above += 1
        above *= part
        above *= 0.5
    return out


def conv(x: np.ndarray, w: np.ndarray, bias: np.ndarray, last: int | None = None) -> np.ndarray:
    """x: batch x length x in; w: taps x in x out; zeros around keep the length.  last: only so many places at the end."""
    half, (rows, n, wide) = len(w) // 2, x.shape
    padded = np.pad(x, ((0, 0), (half, half), (0, 0)))
    # every place with its neighbours as one long row: a single product for all taps
    near = np.lib.stride_tricks.sliding_window_view(padded, len(w), axis=1).transpose(0, 1, 3, 2)
    if last is not None and last < n:
        near, n = near[:, n - last :], last
    out = near.reshape(rows * n, len(w) * wide) @ w.reshape(-1, w.shape[2])
    return (out + bias).reshape(rows, n, w.shape[2])


def conv_tokens(w: Weights, ids: np.ndarray, last: int | None = None) -> np.ndarray:
    """The first convolution, of the embeddings of ``ids``: what each distinct id gives at each tap is calculated once, and summed by place."""
    taps, (rows, n), known = len(w["conv0"]), ids.shape, np.zeros(len(w["embedding"]), bool)
    known[ids] = True
    terms = np.flatnonzero(known)
    number = np.cumsum(known)  # from 1; 0 is a place outside
    near = np.pad(number[ids], ((0, 0), (taps // 2, taps // 2)))
    first = 0 if last is None else max(0, n - last)
    of = w["embedding"][terms]
    table = np.zeros((len(terms) + 1, w["conv0"].shape[2]), of.dtype)
    out = np.empty((rows, n - first, table.shape[1]), of.dtype)
    out[:] = w["conv0_bias"]
    for k in range(taps):
        np.matmul(of, w["conv0"][k], out=table[1:])
        out += table.take(near[:, first + k : n + k], axis=0)
    return out


def encode_batch(w: Weights, ids: np.ndarray) -> np.ndarray:
    """batch x length ids to batch x length x out."""
    x = gelu(conv(w["embedding"][ids], w["conv0"], w["conv0_bias"]))
    x = gelu(conv(x, w["conv1"], w["conv1_bias"]))
    return conv(x, w["conv2"], w["conv2_bias"])


#: Places to each side that a place of the encoder sees.
SEEN = 5


def encode_flat(w: Weights, ids: np.ndarray, sizes: np.ndarray) -> Iterator[np.ndarray]:
    """``encode_batch`` of sequences that lie end to end, in parts of some rows.

    What the second convolution takes from a run of five ids is calculated once
    for all its places.
    """
    out = len(w["conv0_bias"])
    # two places between sequences stand for the zeros around each
    at = np.arange(len(ids)) + 2 * (np.repeat(np.arange(len(sizes)), sizes) + 1)
    room = len(ids) + 2 * (len(sizes) + 1)
    known = np.zeros(len(w["embedding"]), bool)
    known[ids] = True
    terms, number = np.flatnonzero(known), np.zeros(room, np.int64)
    number[at] = np.cumsum(known)[ids]  # from 1; 0 is a place outside
    near, base = at[:, None] + np.arange(-2, 3), len(terms) + 1
    if base**5 < 2**63:
        _, one, same = np.unique(number[near] @ base ** np.arange(5), return_index=True, return_inverse=True)
    else:
        one, same = (np.arange(len(ids)) for _ in range(2))
    runs, of = number[near[one]], w["embedding"][terms]
    h = np.repeat(w["conv0_bias"][None], len(runs), 0)
    table = np.zeros((base, out), of.dtype)
    for k in range(5):
        np.matmul(of, w["conv0"][k], out=table[1:])
        h += table.take(runs[:, k], axis=0)
    h = gelu(h)
    run = np.full(room, len(runs))
    run[at] = same
    second = np.zeros((room, out), h.dtype)
    table = np.zeros((len(runs) + 1, out), h.dtype)
    for k in range(5):
        np.matmul(h, w["conv1"][k], out=table[:-1])
        for i in range(2, room - 2, STEP // 16):
            j = min(i + STEP // 16, room - 2)
            second[i:j] += table.take(run[i + k - 2 : j + k - 2], axis=0)
    inside = np.zeros(room, bool)
    inside[at] = True
    del table, h
    taps = np.concatenate(list(w["conv2"]), axis=1)
    for i in range(1, room - 1, PLACES // 4):
        j = min(i + PLACES // 4, room - 1)
        x = gelu(second[i - 1 : j + 1] + w["conv1_bias"])
        x[~inside[i - 1 : j + 1]] = 0
        a, b, c = np.split(x @ taps, 3, axis=1)
        z = a[:-2] + b[1:-1]
        z += c[2:]
        z += w["conv2_bias"]
        yield z[inside[i:j]]


def encode_last(w: Weights, ids: np.ndarray) -> np.ndarray:
    """``encode_batch(w, ids)[:, -1]``, of the places that the last one sees."""
    x = gelu(conv_tokens(w, ids[:, -SEEN - 1 :], 4))
    x = gelu(conv(x, w["conv1"], w["conv1_bias"], 2))
    return conv(x, w["conv2"], w["conv2_bias"], 1)[:, 0]


def ending(array: Column | str, n: int) -> Column:
    """The last ``n`` elements, or all if there are fewer."""
    return F.slice(array, F.greatest(F.size(array) - n + 1, F.lit(1)), n)


def predict_batch(w: Weights, z: np.ndarray) -> np.ndarray:
    return gelu(z @ w["linear0"] + w["linear0_bias"]) @ w["linear1"] + w["linear1_bias"]


def ema_update(target: Weights, online: Weights, m: float = 0.996) -> Weights:
    """m of the target and 1 - m of the online weights; m = 0 copies."""
    return {k: m * target[k] + (1 - m) * online[k] for k in target}


def smooth_l1(a: np.ndarray, b: np.ndarray) -> float:
    d = np.abs(a - b)
    return float(np.where(d < 1, 0.5 * d * d, d - 0.5).mean())


def masked_loss(online: Weights, target: Weights, ids: np.ndarray, hidden: np.ndarray, asked: np.ndarray, mask_id: int = 2) -> float:
    """The loss of predicting the target's vectors at ``asked`` places from ids with ``hidden`` places masked."""
    context = encode_batch(online, np.where(hidden, mask_id, ids))
    return smooth_l1(predict_batch(online, context)[asked], encode_batch(target, ids)[asked])


def _spread(df: DataFrame) -> DataFrame:
    """The same rows over all cores: a row's work outweighs moving it."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(max(cores, df.rdd.getNumPartitions()))


def _apply(df: DataFrame, keys: list[str] | str, ids: str, weights: Weights, predict: bool, figures: bool) -> DataFrame:
    """``keys`` and ``emb``, or with ``figures`` instead ``dims`` and the length of ``emb`` before it was made 1."""
    keys = [keys] if isinstance(keys, str) else keys
    at, wide = len(keys), len(weights["linear1_bias"])

    def shown(parts: Iterator[np.ndarray], places: np.ndarray) -> list[pa.Array]:
        """Of rows of so many vectors each, which come in parts, what leaves the task."""
        parts = [(np.einsum("ij,ij->i", z, z, dtype=np.float64), None if figures else z) for z in parts]
        ends = np.cumsum(places)
        upto = np.concatenate([[0.0], *(s for s, _ in parts)]).cumsum()
        length = np.sqrt(upto[ends] - upto[ends - places])
        if figures:
            return [pa.array(places * wide), pa.array(length)]
        z = np.concatenate([np.zeros((0, wide), np.float32), *(z for _, z in parts)]) / np.repeat(np.maximum(length, 1e-8), places)[:, None]
        return [pa.ListArray.from_arrays(pa.array(np.concatenate(([0], ends)) * wide, pa.int32()), pa.array(z.ravel().astype(np.float32, copy=False)))]

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in source:
            lists = b.column(at)
            sizes = np.asarray(pc.fill_null(pc.list_value_length(lists), 0)).astype(np.int64)
            values = np.asarray(pc.fill_null(lists.flatten(), 0)).astype(np.int64)
            starts = np.concatenate(([0], np.cumsum(sizes)))
            i = 0
            while i < len(sizes):
                j = max(i + 1, int(np.searchsorted(starts, starts[i] + (SHARED if figures or predict else PLACES), side="right")) - 1)
                part, some = values[starts[i] : starts[j]], sizes[i:j]
                if predict:
                    got = shown(_predicted(weights, part, some), np.minimum(some, 1))
                else:
                    got = shown(encode_flat(weights, part, some), some)
                yield pa.RecordBatch.from_arrays([*(c.slice(i, j - i) for c in b.columns[:at]), *got], names=[*keys, *(["dims", "length"] if figures else ["emb"])])
                i = j

    kinds = ", ".join(f"{k} {df.schema[k].dataType.simpleString()}" for k in keys)
    return _spread(df.select(*keys, ids)).mapInArrow(run, f"{kinds}, " + ("dims long, length double" if figures else "emb array<float>"))


def _predicted(w: Weights, ids: np.ndarray, sizes: np.ndarray) -> Iterator[np.ndarray]:
    """What is predicted for the last places of sequences that lie end to end and are not empty, one row each."""
    out, ends = np.zeros((len(sizes), len(w["linear1_bias"])), np.float32), np.cumsum(sizes)
    seen = np.minimum(sizes, SEEN + 1)
    for n in np.unique(seen[seen > 0]).tolist():
        rows = np.flatnonzero(seen == n)
        for x in range(0, len(rows), PLACES // n):
            part = rows[x : x + PLACES // n]
            distinct, same = np.unique(ids[ends[part][:, None] + np.arange(-n, 0)], axis=0, return_inverse=True)
            out[part] = predict_batch(w, encode_last(w, distinct))[same.ravel()]
    yield out[sizes > 0]


def encode_paths(df: DataFrame, keys: list[str] | str, ids: str, weights: Weights, figures: bool = False) -> DataFrame:
    """``keys``, ``emb``: the vectors of all places end to end, of unit length; none for an empty sequence.

    figures: only their number and length leave the task, not the vectors.
    """
    return _apply(df, keys, ids, weights, False, figures)


def predict_paths(df: DataFrame, keys: list[str] | str, ids: str, weights: Weights, mask_id: int = 2, figures: bool = False) -> DataFrame:
    """``keys``, ``emb``: the vector predicted for a masked place after the last token, of unit length.

    That place sees the ``SEEN`` tokens before it, so no others are moved.
    """
    return _apply(df.withColumn(ids, F.array_append(ending(ids, SEEN), mask_id)), keys, ids, weights, True, figures)


class PaddedEncoder:
    """Vectors of sequences padded to one length, without the places that see nothing but padding: those are the same in all."""

    def __init__(self, weights: Weights, length: int) -> None:
        self.weights, self.length = weights, length
        blank = encode_batch(weights, np.zeros((1, 21), np.int64))[0]
        self.inner, self.last = blank[10], blank[-5:]
        self.tail = float((self.last**2).sum())
        self.square = float((self.inner**2).sum())

    def encode(self, ids: np.ndarray) -> np.ndarray:
        """length x out, or fewer rows, after which rows are ``inner`` but for the last five of the padded length."""
        return next(self.encode_all([ids]))

    def encode_all(self, rows: list[np.ndarray]) -> Iterator[np.ndarray]:
        """``encode`` of each, many at once."""
        cut = [ids[: self.length] for ids in rows]
        sizes = np.array([min(len(ids) + 10, self.length) for ids in cut], np.int64)
        upto, i = np.concatenate(([0], np.cumsum(sizes))), 0
        while i < len(cut):
            j = max(i + 1, int(np.searchsorted(upto, upto[i] + SHARED, side="right")) - 1)
            filled = np.zeros(upto[j] - upto[i], np.int64)
            for ids, at in zip(cut[i:j], upto[i:j] - upto[i], strict=True):
                filled[at : at + len(ids)] = ids
            z = np.concatenate(list(encode_flat(self.weights, filled, sizes[i:j])))
            for at, n in zip(upto[i:j] - upto[i], sizes[i:j], strict=True):
                yield z[at : at + (n if n == self.length else n - 5)]
            i = j

    def compare(self, x: np.ndarray, y: np.ndarray) -> tuple[float, float, float]:
        """Cosine, distance and inner product of two results of ``encode``, flattened and made of unit length."""
        if len(x) > len(y):
            x, y = y, x
        n, xx, yy = len(x), _product(x, x), _product(y, y)
        xy = _product(x, y[:n])
        # after its own rows the shorter one has ``inner``, and at the end the last five
        if n < self.length <= len(y):
            xx += (self.length - 5 - n) * self.square + self.tail
            xy += float((y[n:-5] @ self.inner).sum()) + _product(self.last, y[-5:])
        elif n < self.length:
            rest = (self.length - 5 - len(y)) * self.square + self.tail
            xx += (len(y) - n) * self.square + rest
            xy += float((y[n:] @ self.inner).sum()) + rest
            yy += rest
        cosine = xy / max(np.sqrt(xx * yy), 1e-8)
        return cosine, float(np.sqrt(max(0.0, 2 - 2 * cosine))), cosine


def _product(x: np.ndarray, y: np.ndarray) -> float:
    return float(np.dot(x.ravel(), y.ravel()))
