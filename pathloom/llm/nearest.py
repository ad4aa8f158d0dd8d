"""The k most similar vectors of every vector, by shifted space-filling curves.

Vectors are projected on random directions inside the main subspace of a
bounded sample, every coordinate becomes its quantile, and the Hilbert index of
the shifted quantiles is a key.  Several such orderings are cut into windows of
neighbouring keys, and each window takes the edges of its two neighbours as
well; inside a window every vector is compared with every other by a matrix
product.  The windows of all orderings are merged, and the best k reranked.

Vectors of one direction (equal at 12 bits a number of the greatest one, so that
their cosine differs from 1 by less than 1e-5) are one class before the search:
copies, however many and however scaled, fill no window.  Each member's list is
then made of its own class and of the members of the classes found.

Accuracy.  A window holds an ever smaller share of a growing table, so the
number of orderings is not fixed: the exact neighbours of some sampled records
are found by brute force, and orderings are added until the windows hold
``recall`` of them.  README.md has figures against brute force.  Windows hold
vectors at 12 or 8 bits a number; a list goes on past its k-th place as long as
similarities are closer to it than ``slack``, so that a search whose result is
computed again from the stored vectors loses nothing to the packing.

Defined cases
    null, short, long, zero or not finite vectors, null ids: take no part;
    repeated id: it is never its own neighbour;
    ties: the smaller id first; fewer than k others: a shorter list.
"""

from __future__ import annotations

import math
import warnings
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import written

SAMPLE, SUBSPACE, DIMS, BITS = 10_000, 32, 12, 4
BROADCAST_IDS = 1_000_000
#: Records whose exact neighbours decide the number of orderings, and the number at which a warning ends the search for more.
ASKED, MOST_ORDERINGS = 1024, 256
UNSEEN = 8
#: Cosines of vectors packed at 12 bits are closer than this to the true ones.
SLACK = 0.001
#: The share of a window that it takes of each neighbour.
HALO = 1 / 16


def hilbert_index(cells: np.ndarray, bits: int) -> np.ndarray:
    """The place on the Hilbert curve of points with coordinates under 2**bits (Skilling's transform, 2004)."""
    x = [cells[:, i].astype(np.uint32) for i in range(cells.shape[1])]
    n, q = len(x), 1 << (bits - 1)
    while q > 1:
        low = np.uint32(q - 1)
        for i in range(n):
            high = (x[i] & np.uint32(q)) != 0
            swap = np.where(high, np.uint32(0), (x[0] ^ x[i]) & low)
            x[0] = np.where(high, x[0] ^ low, x[0] ^ swap)
            x[i] = x[i] ^ swap
        q >>= 1
    for i in range(1, n):
        x[i] ^= x[i - 1]
    flip, q = np.zeros_like(x[0]), 1 << (bits - 1)
    while q > 1:
        flip = np.where((x[-1] & np.uint32(q)) != 0, flip ^ np.uint32(q - 1), flip)
        q >>= 1
    key = np.zeros(len(flip), np.int64)
    for b in range(bits - 1, -1, -1):
        for i in range(n):
            key = (key << 1) | (((x[i] ^ flip) >> np.uint32(b)) & 1).astype(np.int64)
    return key


class Orderings:
    """Projections, quantiles and shifts fitted on a sample of unit vectors."""

    def __init__(self, sample: np.ndarray, orderings: int, seed: int = 7) -> None:
        self.rng = np.random.default_rng(seed)
        dim = sample.shape[1]
        self.mean = sample.mean(0)
        _, basis = np.linalg.eigh((sample - self.mean).T @ (sample - self.mean))
        self.basis = basis[:, ::-1][:, : min(SUBSPACE, dim)]
        self.project, self.edges, self.shift = [], [], []
        for _ in range(orderings):
            self.add(sample)

    def add(self, sample: np.ndarray) -> None:
        """One ordering more."""
        wide = self.basis.shape[1]
        dims = min(DIMS, wide)
        turn, _ = np.linalg.qr(self.rng.normal(size=(wide, wide)))
        p = (self.basis @ turn[:, :dims]).astype(np.float32)
        self.project.append(p)
        self.edges.append(np.quantile((sample - self.mean) @ p, np.linspace(0, 1, 257)[1:-1], axis=0))
        self.shift.append(self.rng.random(dims))

    def keys(self, vectors: np.ndarray, which: int) -> np.ndarray:
        z = (vectors - self.mean) @ self.project[which]
        cells = np.empty(z.shape, np.uint32)
        for j in range(z.shape[1]):
            u = np.searchsorted(self.edges[which][:, j], z[:, j]) / 256.0
            # quantiles fill half of the curve's cube, shifted within the other half
            cells[:, j] = np.minimum((u + self.shift[which][j]) * 2 ** (BITS - 1), 2**BITS - 1)
        return hilbert_index(cells, BITS)


def usable(column: pa.Array, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """(rows, vectors) of those of exactly ``dim`` finite numbers that are not all zero."""
    n = np.asarray(pc.fill_null(pc.list_value_length(column), -1))
    rows = np.flatnonzero(n == dim)
    if not len(rows):
        return rows, np.zeros((0, dim), np.float32)
    flat = column.take(pa.array(rows)).flatten()
    flat = flat.combine_chunks() if isinstance(flat, pa.ChunkedArray) else flat
    v = pc.fill_null(flat.cast(pa.float32()), float("nan")).to_numpy(zero_copy_only=False).reshape(-1, dim)
    good = np.isfinite(v).all(1) & (v != 0).any(1)
    return rows[good], v[good]


def unit(v: np.ndarray) -> np.ndarray:
    v = v.astype(np.float64)
    v = v / np.abs(v).max(1, keepdims=True)
    return (v / np.linalg.norm(v, axis=1, keepdims=True)).astype(np.float32)


def pack12(v: np.ndarray) -> list[bytes]:
    """Vectors at 12 bits a number, of the greatest one; what is lost of the length does not matter to a cosine."""
    v = np.pad(v, ((0, 0), (0, v.shape[1] % 2)))
    q = np.rint(v / np.maximum(np.abs(v).max(1, keepdims=True), 1e-30) * 2047).astype(np.int32) + 2048
    a, b = q[:, ::2], q[:, 1::2]
    out = np.stack([a >> 4, (a & 15) << 4 | b >> 8, b & 255], -1).astype(np.uint8).reshape(len(v), -1)
    return [x.tobytes() for x in out]


def unpack12(data: list[bytes], dim: int) -> np.ndarray:
    """Unit vectors of packed ones."""
    x = np.frombuffer(b"".join(data), np.uint8).reshape(len(data), -1, 3).astype(np.int32)
    q = np.empty((len(data), x.shape[1] * 2), np.float32)
    q[:, ::2], q[:, 1::2] = x[:, :, 0] << 4 | x[:, :, 1] >> 4, (x[:, :, 1] & 15) << 8 | x[:, :, 2]
    q = q[:, :dim] - 2048
    return q / np.maximum(np.linalg.norm(q, axis=1, keepdims=True), 1e-30)


def packed(v: np.ndarray, bits: int) -> list[bytes]:
    """At 12 or 8 bits a number."""
    if bits == 12:
        return pack12(v)
    q = np.rint(v / np.maximum(np.abs(v).max(1, keepdims=True), 1e-30) * 127).astype(np.int8)
    return [x.tobytes() for x in q]


def slack_of(bits: int, dim: int) -> float:
    """What cosines of packed vectors are closer than to the true ones: at 8 bits eight standard deviations of the rounding."""
    return SLACK if bits == 12 else 0.08 / math.sqrt(dim)


def unpacked(data: list[bytes], dim: int, bits: int) -> np.ndarray:
    if bits == 12:
        return unpack12(data, dim)
    q = np.frombuffer(b"".join(data), np.int8).reshape(len(data), dim).astype(np.float32)
    return q / np.maximum(np.linalg.norm(q, axis=1, keepdims=True), 1e-30)


def _top(sims: np.ndarray, k: int) -> np.ndarray:
    """Columns of the k largest of every row, unordered; the width is a multiple of 64.

    The k largest lie in the k combs of 64 columns with the largest maxima.
    """
    rows, n = sims.shape
    wide = n // 64
    if wide <= k:
        return np.argpartition(-sims, min(k, n) - 1, axis=1)[:, :k]
    peak = sims.reshape(rows, 64, wide).max(1)
    best = np.argpartition(-peak, k - 1, axis=1)[:, :k]
    cols = (best[:, :, None] + np.arange(64) * wide).reshape(rows, -1)
    near = np.take_along_axis(sims, cols, 1)
    return np.take_along_axis(cols, np.argpartition(-near, k - 1, axis=1)[:, :k], 1)


def _window_lists(k: int, dim: int, bits: int, slack: float, least: float):  # noqa: ANN202
    """The lists of a window's own rows: the k most similar of the window, those as similar as the k-th but for ``slack``, none under ``least``."""
    keep = k + 1

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [b for b in source if b.num_rows]
        if not parts:
            return
        t = pa.Table.from_batches(parts)
        window, ids, own = t.column(0).to_numpy(), t.column(1).to_numpy(), t.column(2).to_numpy()
        v = unpacked(t.column(3).to_pylist(), dim, bits)
        for o in np.unique(window):
            at = np.flatnonzero(window == o)
            at = at[np.lexsort((ids[at], ~own[at]))]
            n, mine = len(at), int(own[at].sum())
            w = np.zeros((-(-n // 64) * 64, dim), np.float32)
            w[:n] = v[at]
            names = np.append(ids[at], np.zeros(len(w) - n, ids.dtype))
            for x in range(0, mine, 512):
                s = w[x : min(x + 512, mine)] @ w.T
                rows = np.arange(len(s))
                s[rows, x + rows] = -4
                s[:, n:] = -4
                top = _top(s, keep)
                sim = np.take_along_axis(s, top, 1)
                row, near, found = np.repeat(rows, top.shape[1]), top.ravel(), sim.ravel()
                if top.shape[1] >= keep:
                    # where even the last one kept is as similar as the k-th, all that are so similar
                    edge = np.maximum(np.sort(sim, axis=1)[:, -k] - slack, least)
                    more = np.flatnonzero(sim.min(1) >= edge)
                    if len(more):
                        i, j = np.nonzero(s[more] >= edge[more, None])
                        keep_row = ~np.isin(row, more)
                        row, near, found = np.append(row[keep_row], more[i]), np.append(near[keep_row], j), np.append(found[keep_row], s[more[i], j])
                        order = np.argsort(row, kind="stable")
                        row, near, found = row[order], near[order], found[order]
                ok = found > max(-3, least)
                row, near, found = row[ok], near[ok], np.round(found[ok], 5)
                starts = pa.array(np.searchsorted(row, np.arange(len(s) + 1)), pa.int32())
                lists = [pa.ListArray.from_arrays(starts, pa.array(-found, pa.float32())), pa.ListArray.from_arrays(starts, pa.array(names[near], pa.int64()))]
                out = pa.RecordBatch.from_arrays([pa.array(names[x : x + len(s)], pa.int64()), *lists], names=["_id", "_d", "_near"])
                yield out if least <= -1 else out.filter(pa.array(np.diff(np.asarray(starts)) > 0))

    return run


def _true_pairs(df: DataFrame, names: np.ndarray, vectors: np.ndarray, k: int, dim: int, least: float) -> tuple[np.ndarray, np.ndarray]:
    """(a, b): asked vectors and each of their k nearest of all rows, by brute force; not those of the same direction, none under ``least``."""

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best, near = np.full((len(names), k), -4, np.float32), np.zeros((len(names), k, dim), np.float32)
        for b in source:
            rows, v = usable(b.column(1), dim)
            v, ids = unit(v) if len(v) else v, b.column(0).take(pa.array(rows, pa.int64())).to_numpy()
            for x in range(0, len(v), 2048):
                part = v[x : x + 2048]
                s = vectors @ part.T
                s[(names[:, None] == ids[None, x : x + 2048]) | (s > 1 - 1e-5)] = -4
                s = np.concatenate([best, s], 1)
                top = np.argpartition(-s, k - 1, axis=1)[:, :k]
                best = np.take_along_axis(s, top, 1)
                old = np.take_along_axis(near, np.minimum(top, k - 1)[:, :, None], 1)
                near = np.where((top < k)[:, :, None], old, part[np.maximum(top - k, 0)])
        a, j = np.nonzero(best > max(-3, least))
        if len(a):
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int32()), pa.array(best[a, j]), pa.array(pack12(near[a, j]), pa.binary())], names=["_a", "_s", "_v"])

    found = df.mapInArrow(run, "_a int, _s float, _v binary")
    place = F.row_number().over(Window.partitionBy("_a").orderBy(F.col("_s").desc(), "_v"))
    got = found.withColumn("_p", place).filter(F.col("_p") <= k).select("_a", "_v").collect()
    if not got:
        return np.zeros((0, dim), np.float32), np.zeros((0, dim), np.float32)
    return vectors[[r[0] for r in got]], unpack12([bytes(r[1]) for r in got], dim)


class Windows:
    """Where the windows of an ordering begin, from the keys of a sample, and what they take of their neighbours."""

    def __init__(self, fitted: Orderings, sample: np.ndarray, count: int) -> None:
        self.fitted, self.sample, self.count = fitted, sample, count
        self.low: list[np.ndarray] = []
        self.edge: list[np.ndarray] = []
        self.high: list[np.ndarray] = []

    def of(self, which: int) -> None:
        while len(self.edge) <= which:
            o = len(self.edge)
            if o == len(self.fitted.project):
                self.fitted.add(self.sample)
            keys = np.sort(self.fitted.keys(self.sample, o))
            inner = np.arange(1, self.count) / self.count
            for held, shift in ((self.low, -HALO), (self.edge, 0.0), (self.high, HALO)):
                held.append(keys[np.clip((inner + shift / self.count) * len(keys), 0, len(keys) - 1).astype(np.int64)])

    def placed(self, v: np.ndarray, which: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(window, first, last): a row's own window, and the windows that hold it, which are that and its neighbours at most."""
        self.of(which)
        keys = self.fitted.keys(v, which)
        own = np.searchsorted(self.edge[which], keys, side="right")
        first = np.maximum(np.searchsorted(self.high[which], keys, side="left"), own - 1)
        last = np.minimum(np.searchsorted(self.low[which], keys, side="right"), own + 1)
        return own, np.minimum(first, own), np.maximum(last, own)


def enough_orderings(windows: Windows, a: np.ndarray, b: np.ndarray, recall: float) -> int:
    """How many orderings it takes until ``recall`` of the pairs a, b meet in a window of a; adds those that lack."""
    met = np.zeros(len(a), bool)
    for o in range(MOST_ORDERINGS):
        own, (_, first, last) = windows.placed(a, o)[0], windows.placed(b, o)
        met |= (first <= own) & (own <= last)
        if met.mean() >= recall:
            return o + 1
    warnings.warn(f"{MOST_ORDERINGS} orderings find {met.mean():.3f} of the nearest vectors, not {recall}", stacklevel=2)
    return MOST_ORDERINGS


def _ids_joined(df: DataFrame, ids: DataFrame, on: str, how: str) -> DataFrame:
    """Joins by id with a side that is sent to all tasks only if it is counted to be small."""
    if ids.count() <= BROADCAST_IDS:
        ids = F.broadcast(ids)
    return df.join(ids, on, how)


def neighbours(
    df: DataFrame, record: str = "record_id", vector: str = "embedding", k: int = 5, dim: int = 256, orderings: int = 2, window: int = 8192, seed: int = 7,
    recall: float = 0.95, spare: float = 0.0, bits: int = 12, slack: float = 0.0, least: float = -2.0,
) -> DataFrame:
    """``record``, ``rank`` (from 1), ``neighbour``, ``similarity`` (as good as the packing) for every usable row.

    window: about how many vectors one is compared with in an ordering.  orderings:
    at least so many; more where a sample shows that it takes more for ``recall``,
    and ``spare`` (a share) beyond.  slack: lists go on past k while similarities are so close to the
    k-th.  least: no similarity under it is wanted, and ``recall`` is of the others.
    """
    base = df.select(F.col(record).cast("long").alias("_id"), F.col(vector).alias("_v")).filter(F.col("_id").isNotNull() & (F.size("_v") == dim))

    def named(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in source:
            rows, v = usable(b.column(1), dim)
            names = [xxhash.xxh3_128_digest(x) for x in pack12(unit(v))] if len(v) else []
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(rows, pa.int64())), pa.array(names, pa.binary())], names=["_id", "_name"])

    members = written(base.mapInArrow(named, "_id long, _name binary").distinct(), "vector-names")
    classes = members.groupBy("_name").agg(F.min("_id").alias("_rep"), F.count("*").alias("_n"))
    copied = written(classes.filter("_n > 1").select("_name", "_rep"), "copied-vectors")
    in_copied = written(_ids_joined(members, copied, "_name", "inner").select("_rep", F.col("_id").alias("_member")), "copies")
    surplus = in_copied.filter("_member <> _rep").select(F.col("_member").alias("_id")).distinct()
    n = members.count()
    alone = _ids_joined(base, surplus, "_id", "left_anti") if n else base

    def sampled(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in source:
            rows, v = usable(b.column(1), dim)
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(rows, pa.int64())), pa.array(pack12(unit(v)) if len(v) else [], pa.binary())], names=["_id", "_v"])

    per_order = max(1, -(-n // window))
    size = max(SAMPLE, 16 * per_order)
    share = min(1.0, size / max(1, n))
    part = alone.filter(F.pmod(F.xxhash64("_id", F.lit(seed)), F.lit(1_000_000)) < share * 1_000_000).mapInArrow(sampled, "_id long, _v binary").limit(2 * size)
    drawn = sorted((r[0], bytes(r[1])) for r in part.collect())
    taken = [v for _, v in drawn]
    sample = unpack12(taken, dim) if len(taken) > 1 else np.eye(2, dim, dtype=np.float32)
    windows = Windows(Orderings(sample, orderings, seed), sample, per_order)
    if per_order == 1:
        orderings = 1  # one window holds all
    elif len(taken) > 1:
        at = np.sort(np.random.default_rng(seed).permutation(len(taken))[:ASKED])
        a, b = _true_pairs(alone, np.array([drawn[i][0] for i in at]), sample[at], k, dim, least)
        # where the sample has no pair that is wanted, there are few, and UNSEEN orderings look for them
        orderings = max(orderings, math.ceil(enough_orderings(windows, a, b, recall) * (1 + spare)) if len(a) else UNSEEN)
    windows.of(orderings - 1)

    def keyed(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in source:
            rows, v = usable(b.column(1), dim)
            if not len(rows):
                continue
            v = unit(v)
            ids = b.column(0).take(pa.array(rows))
            data = pa.array(packed(v, bits), pa.binary())
            for o in range(orderings):
                own, first, last = windows.placed(v, o)
                for shift in (-1, 0, 1):
                    i = np.flatnonzero((own + shift >= first) & (own + shift <= last))
                    yield pa.RecordBatch.from_arrays([pa.array((o * per_order + own[i] + shift).astype(np.int32)), ids.take(pa.array(i)), pa.array(np.full(len(i), shift == 0)), data.take(pa.array(i))], names=["_window", "_id", "_own", "_v"])

    # every window is a task of its own
    keys = alone.mapInArrow(keyed, "_window int, _id long, _own boolean, _v binary").repartitionById(orderings * per_order, "_window")
    lists = keys.mapInArrow(_window_lists(k, dim, bits, slack, least), "_id long, _d array<float>, _near array<long>")
    zipped = F.array_sort(F.array_distinct(F.arrays_zip(F.flatten(F.collect_list("_d")).alias("d"), F.flatten(F.collect_list("_near")).alias("id"))))
    merged = lists.groupBy("_id").agg(zipped.alias("_near"))
    upto = F.try_element_at("_near", F.lit(k))["d"] + F.lit(slack)
    closest = F.when(F.size("_near") > k, F.concat(F.slice("_near", 1, k), F.filter(F.slice("_near", k + 1, F.size("_near")), lambda e: e["d"] <= upto))).otherwise(F.col("_near"))
    merged = written(merged.select("_id", closest.alias("_near")), "neighbour-classes")

    # members of the classes found: the k + 1 smallest ids of a class stand for it
    first = F.row_number().over(Window.partitionBy("_rep").orderBy("_member"))
    heads = written(in_copied.withColumn("_r", first).filter(F.col("_r") <= k + 1).groupBy("_rep").agg(F.collect_list("_member").alias("_ids")), "class-heads")
    flat = merged.select("_id", F.explode("_near").alias("_e")).select("_id", F.col("_e.d").alias("_d"), F.col("_e.id").alias("_near"))
    flat = flat.join(heads.withColumnRenamed("_rep", "_near"), "_near", "left")
    flat = flat.select("_id", "_d", F.explode(F.coalesce("_ids", F.array("_near"))).alias("_near"))
    own = heads.select(F.col("_rep").alias("_id"), F.lit(-1.0).cast("float").alias("_d"), F.explode("_ids").alias("_near"))
    listed = flat.union(own).groupBy("_id").agg(F.array_sort(F.collect_set(F.struct("_d", "_near"))).alias("_list"))
    others = in_copied.filter("_member <> _rep").join(listed.withColumnRenamed("_id", "_rep"), "_rep").select(F.col("_member").alias("_id"), "_list")
    rest = F.filter("_list", lambda e: e["_near"] != F.col("_id"))
    last = F.try_element_at(rest, F.lit(k))["_d"] + F.lit(slack)
    best = F.when(F.size(rest) > k, F.concat(F.slice(rest, 1, k), F.filter(F.slice(rest, k + 1, F.size(rest)), lambda e: e["_d"] <= last))) if slack else F.slice(rest, 1, k)
    best = F.coalesce(best, rest) if slack else best
    out = listed.union(others).select("_id", F.posexplode(best).alias("_p", "_e"))
    return out.select(F.col("_id").alias(record), (F.col("_p") + 1).alias("rank"), F.col("_e._near").alias("neighbour"), (-F.col("_e._d")).alias("similarity"))


def exact_pairs(pairs: DataFrame, df: DataFrame, record: str = "record_id", vector: str = "embedding") -> DataFrame:
    """``a``, ``b``, ``cosine`` (to 12 digits, so that copies tie) in double precision from the stored vectors, of pairs a, b."""
    pairs = written(pairs, "pairs")
    ids = pairs.select(F.col("a").alias("_id")).union(pairs.select("b")).distinct()
    v = _ids_joined(df.select(F.col(record).cast("long").alias("_id"), F.col(vector).alias("_v")), ids, "_id", "left_semi").dropDuplicates(["_id"])
    v = written(v, "pair-vectors")
    both = pairs.join(v.toDF("a", "_va"), "a").join(v.toDF("b", "_vb"), "b")

    def dot(x: str, y: str):  # noqa: ANN202
        return F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, e: s + e)

    return both.select("a", "b", F.round(dot("_va", "_vb") / (F.sqrt(dot("_va", "_va")) * F.sqrt(dot("_vb", "_vb"))), 12).alias("cosine"))


def similar_pairs(df: DataFrame, record: str = "record_id", vector: str = "embedding", least: float = 0.8, k: int = 5, dim: int = 256, bits: int = 8, **search) -> DataFrame:  # noqa: ANN003
    """``a`` < ``b`` of cosine at least ``least``, one among the k most similar of the other (ties: the smaller id first).

    The search looks for pairs from ``least`` on only, and adds orderings until all
    of a sample are found, and half as many again.  The packed vectors decide all but the pairs close to the threshold, and those
    close to a k-th place that a later one is close to as well: their cosines
    are computed from the stored vectors.
    """
    slack = slack_of(bits, dim)
    near = neighbours(df, record, vector, k, dim, **({"recall": 1.0, "spare": 0.5, "bits": bits, "slack": 2 * slack, "least": least - slack} | search))
    lists = near.groupBy(F.col(record).alias("_id")).agg(F.array_sort(F.collect_list(F.struct("rank", F.col("neighbour").alias("n"), F.col("similarity").alias("s")))).alias("_l"))
    lists = lists.withColumn("_k", F.try_element_at("_l", F.lit(k))["s"]).withColumn("_open", F.size("_l") > k)
    each = lists.select("_id", F.col("_k").alias("_s"), "_open", F.explode("_l").alias("_e")).select("_id", "_s", "_open", F.col("_e.rank").alias("_rank"), F.col("_e.n").alias("_n"), F.col("_e.s").alias("_sim"))
    unsure = F.col("_open") & (F.abs(F.col("_sim") - F.col("_s")) <= 2 * slack)
    each = each.filter(unsure | (F.col("_rank") <= k))
    each = written(each.select("_id", "_n", "_rank", F.coalesce(unsure, F.lit(False)).alias("_unsure"), (F.coalesce(unsure, F.lit(False)) | (F.col("_sim") < least + slack)).alias("_ask"), F.least("_id", "_n").alias("a"), F.greatest("_id", "_n").alias("b")), "near-pairs")
    asked = each.filter("_ask").select("a", "b").distinct()
    known = written(exact_pairs(asked, df, record, vector), "exact-pairs")
    each = each.join(known, ["a", "b"], "left").filter(F.col("cosine").isNull() | (F.col("cosine") >= least))
    sure = each.filter("NOT _unsure").select("_id", "a", "b")
    taken = sure.groupBy("_id").agg(F.count("*").alias("_taken"))
    place = F.row_number().over(Window.partitionBy("_id").orderBy(F.col("cosine").desc(), "_n"))
    rest = each.filter("_unsure").withColumn("_place", place).join(taken, "_id", "left").filter(F.col("_place") + F.coalesce("_taken", F.lit(0)) <= k)
    return sure.select("a", "b").union(rest.select("a", "b")).distinct()
