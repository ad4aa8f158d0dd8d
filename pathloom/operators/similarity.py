"""Comparison of vectors in blocks: a stated set of queries, or all rows, against all rows.

Rows go to blocks of fixed size by hash, queries to every block, and each block
is one matrix product whose results are reduced before they leave the task.
Neither side is sent to all tasks and no pair is shuffled.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import written

ROWS, QUERIES = 4096, 1024


def block_products(df: DataFrame, key: str, group: str, vector: str, query: Column, reduce: Callable[[pd.DataFrame, pd.DataFrame, np.ndarray, np.ndarray], pd.DataFrame], schema: str, extra: tuple[str, ...] = (), among: Column | None = None) -> DataFrame:
    """``reduce(queries, rows, dots, norms)`` of every pair of blocks.

    queries, rows: frames of _k and _g; dots: their inner products, shorter
    vectors filled with zeros; norms: a list of the two sides' lengths; extra: columns
    that the queries bring along; among: the rows they are compared with, all without it.
    """
    base = df.select(F.col(key).alias("_k"), F.col(group).alias("_g"), F.col(vector).cast("array<float>").alias("_v"), query.alias("_q"), (F.lit(True) if among is None else among).alias("_r"), *extra).filter("_v IS NOT NULL AND _k IS NOT NULL")
    n = base.agg(F.count("*").alias("n"), F.count_if("_q").alias("q")).first()
    rows_in, queries_in = max(1, -(-n["n"] // ROWS)), max(1, -(-n["q"] // QUERIES))
    rows = base.filter("_r").select("_k", "_g", "_v", F.pmod(F.xxhash64("_k"), F.lit(rows_in)).alias("_b"), F.explode(F.sequence(F.lit(0), F.lit(queries_in - 1))).alias("_c"))
    asked = base.filter("_q").select(F.col("_k").alias("_ka"), F.col("_g").alias("_ga"), F.col("_v").alias("_va"), F.explode(F.sequence(F.lit(0), F.lit(rows_in - 1)).cast("array<bigint>")).alias("_ba"), F.pmod(F.xxhash64("_k", F.lit(1)), F.lit(queries_in)).cast("int").alias("_ca"), *extra)

    def matrix(values: pd.Series, width: int) -> np.ndarray:
        size = np.array([len(v) for v in values])
        out = np.zeros((len(values), width))
        # all numbers at once, each in its row
        out[np.repeat(np.arange(len(size)), size), np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)] = np.concatenate(list(values)) if size.sum() else 0
        return np.nan_to_num(out)

    def product(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return pd.DataFrame(columns=names)
        left = left.rename(columns={"_ka": "_k", "_ga": "_g", "_va": "_v"}).sort_values("_k")
        right = right.sort_values("_k")
        width = max([1, *(len(v) for v in left["_v"]), *(len(v) for v in right["_v"])])
        a, b = matrix(left["_v"], width), matrix(right["_v"], width)
        return reduce(left, right, a @ b.T, [np.linalg.norm(a, axis=1), np.linalg.norm(b, axis=1)])

    names = [c.split()[0] for c in schema.split(", ")]
    return asked.groupBy("_ba", "_ca").cogroup(rows.groupBy("_b", "_c")).applyInPandas(product, schema)


def cosine_pairs(df: DataFrame, key: str, group: str, vector: str, query: Column, least: float) -> DataFrame:
    """``a`` (a query), ``b``, ``similarity`` (cosine, lengths of at least 1e-8), ``same_group`` of pairs from ``least`` on; not a row with itself."""

    def keep(q: pd.DataFrame, r: pd.DataFrame, dots: np.ndarray, norms: list[np.ndarray]) -> pd.DataFrame:
        s = dots / (np.maximum(norms[0], 1e-8)[:, None] * np.maximum(norms[1], 1e-8)[None, :])
        ka, kb, ga, gb = q["_k"].to_numpy(), r["_k"].to_numpy(), q["_g"].to_numpy(), r["_g"].to_numpy()
        i, j = np.nonzero((s >= least) & (ka[:, None] != kb[None, :]))
        return pd.DataFrame({"a": ka[i], "b": kb[j], "similarity": s[i, j], "same_group": ga[i] == gb[j]})

    kind = df.schema[key].dataType.simpleString()
    return block_products(df, key, group, vector, query, keep, f"a {kind}, b {kind}, similarity double, same_group boolean")


def similarity_stats(df: DataFrame, key: str, group: str, vector: str, query: Column | None = None) -> DataFrame:
    """``is_positive`` (one group), ``n``, ``mean``, ``std``, ``low``, ``high`` of the cosines of queries (of all rows without ``query``) and all other rows."""
    query = F.lit(True) if query is None else query

    def sums(q: pd.DataFrame, r: pd.DataFrame, dots: np.ndarray, norms: list[np.ndarray]) -> pd.DataFrame:
        s = dots / (np.maximum(norms[0], 1e-8)[:, None] * np.maximum(norms[1], 1e-8)[None, :])
        other = q["_k"].to_numpy()[:, None] != r["_k"].to_numpy()[None, :]
        same = q["_g"].to_numpy()[:, None] == r["_g"].to_numpy()[None, :]
        out = []
        for positive in (True, False):
            v = s[other & (same == positive)]
            if len(v):
                out.append((positive, len(v), v.sum(), (v * v).sum(), v.min(), v.max()))
        return pd.DataFrame(out, columns=["is_positive", "n", "s", "ss", "low", "high"])

    parts = block_products(df, key, group, vector, query, sums, "is_positive boolean, n long, s double, ss double, low double, high double")
    n, s, ss = F.sum("n"), F.sum("s"), F.sum("ss")
    std = F.when(n > 1, F.sqrt(F.greatest((ss - s * s / n) / (n - 1), F.lit(0.0))))
    return parts.groupBy("is_positive").agg(n.alias("n"), F.round(s / n, 6).alias("mean"), F.round(std, 6).alias("std"), F.round(F.min("low"), 6).alias("low"), F.round(F.max("high"), 6).alias("high"))


def linkage(df: DataFrame, key: str, group: str, vector: str, query: Column | None = None, among: Column | None = None) -> DataFrame:
    """``f1`` (of queries, or of all rows without ``query``), ``f2``: the least distance, at most 1, and the greatest inner product, at least 0, of their vectors; rows without a group take no part."""
    df, query = df.filter(F.col(group).isNotNull()), F.lit(True) if query is None else query

    def closest(q: pd.DataFrame, r: pd.DataFrame, dots: np.ndarray, norms: list[np.ndarray]) -> pd.DataFrame:
        far = np.maximum(norms[0][:, None] ** 2 + norms[1][None, :] ** 2 - 2 * dots, 0.0)
        # rows and columns by group, so that each pair of groups is a rectangle of the block
        i, j = q["_g"].argsort(kind="stable").to_numpy(), r["_g"].argsort(kind="stable").to_numpy()
        ga, gb = q["_g"].to_numpy()[i], r["_g"].to_numpy()[j]
        x = np.flatnonzero(np.append(True, ga[1:] != ga[:-1]))
        y = np.flatnonzero(np.append(True, gb[1:] != gb[:-1]))
        d = np.sqrt(np.minimum.reduceat(np.minimum.reduceat(far[np.ix_(i, j)], x, axis=0), y, axis=1))
        p = np.maximum.reduceat(np.maximum.reduceat(dots[np.ix_(i, j)], x, axis=0), y, axis=1)
        return pd.DataFrame({"f1": np.repeat(ga[x], len(y)), "f2": np.tile(gb[y], len(x)), "d": d.ravel(), "p": p.ravel()})

    kind = df.schema[group].dataType.simpleString()
    parts = block_products(df, key, group, vector, query, closest, f"f1 {kind}, f2 {kind}, d double, p double", among=among)
    return parts.groupBy("f1", "f2").agg(F.round(F.least(F.lit(1.0), F.min("d")), 5).alias("distance"), F.round(F.greatest(F.lit(0.0), F.max("p")), 5).alias("inner_product"))


def top_neighbours(df: DataFrame, key: str, group: str, vector: str, query: Column, k: int) -> DataFrame:
    """``a`` (a query), ``rank`` (from 1), ``b``, ``similarity``, ``same_group``: the k most similar other rows; ties by key."""

    def best(q: pd.DataFrame, r: pd.DataFrame, dots: np.ndarray, norms: list[np.ndarray]) -> pd.DataFrame:
        s = np.round(dots / (np.maximum(norms[0], 1e-8)[:, None] * np.maximum(norms[1], 1e-8)[None, :]), 9)
        ka, kb, ga, gb = q["_k"].to_numpy(), r["_k"].to_numpy(), q["_g"].to_numpy(), r["_g"].to_numpy()
        s[ka[:, None] == kb[None, :]] = -2
        # rows are in order of key, so a stable sort keeps ties in that order
        top = np.argsort(-s, axis=1, kind="stable")[:, :k]
        i = np.repeat(np.arange(len(ka)), top.shape[1])
        j = top.ravel()
        keep = s[i, j] > -2
        i, j = i[keep], j[keep]
        return pd.DataFrame({"a": ka[i], "b": kb[j], "similarity": s[i, j], "same_group": ga[i] == gb[j]})

    kind = df.schema[key].dataType.simpleString()
    found = block_products(df, key, group, vector, query, best, f"a {kind}, b {kind}, similarity double, same_group boolean")
    rank = F.row_number().over(Window.partitionBy("a").orderBy(F.col("similarity").desc(), "b"))
    return found.withColumn("rank", rank.cast("long")).filter(F.col("rank") <= k).select("a", "rank", "b", "similarity", "same_group")


def first_of_group(df: DataFrame, key: str, group: str, vector: str, query: Column) -> DataFrame:
    """``a`` (a query), ``first``: the rank of the most similar other row of its group among all other rows, null without any; ties by key."""

    def cosines(q: pd.DataFrame, r: pd.DataFrame, dots: np.ndarray, norms: list[np.ndarray]) -> tuple[np.ndarray, ...]:
        s = np.round(dots / (np.maximum(norms[0], 1e-8)[:, None] * np.maximum(norms[1], 1e-8)[None, :]), 9)
        ka, kb = q["_k"].to_numpy(), r["_k"].to_numpy()
        return s, ka, kb, ka[:, None] != kb[None, :]

    def best(q: pd.DataFrame, r: pd.DataFrame, dots: np.ndarray, norms: list[np.ndarray]) -> pd.DataFrame:
        s, ka, kb, other = cosines(q, r, dots, norms)
        s[~(other & (q["_g"].to_numpy()[:, None] == r["_g"].to_numpy()[None, :]))] = -2
        top = s.argmax(1)  # the first of equals: rows are in order of key
        found = s[np.arange(len(s)), top]
        return pd.DataFrame({"a": ka, "_s": found, "_b": np.where(found > -2, kb[top], -1), "_has": found > -2})

    def before(q: pd.DataFrame, r: pd.DataFrame, dots: np.ndarray, norms: list[np.ndarray]) -> pd.DataFrame:
        s, ka, kb, other = cosines(q, r, dots, norms)
        least, at = q["_s"].to_numpy(np.float64)[:, None], q["_b"].to_numpy(np.float64)[:, None]
        ahead = other & ((s > least) | ((s == least) & (kb[None, :] < at)))
        return pd.DataFrame({"a": ka, "n": ahead.sum(1)})

    kind = df.schema[key].dataType.simpleString()
    tops = block_products(df, key, group, vector, query, best, f"a {kind}, _s double, _b {kind}, _has boolean").filter("_has")
    tops = tops.groupBy(F.col("a").alias("_a")).agg(F.max("_s").alias("_s"), F.max_by("_b", F.struct(F.col("_s"), -F.col("_b"))).alias("_b"))
    tops = written(tops, "best-of-group")
    asked = df.join(tops, df[key] == tops["_a"], "left")
    ahead = block_products(asked, key, group, vector, query, before, f"a {kind}, n long", ("_s", "_b"))
    counted = ahead.groupBy("a").agg(F.sum("n").alias("n"))
    return counted.join(tops.select(F.col("_a").alias("a"), "_s"), "a", "left").select("a", F.when(F.col("_s").isNotNull(), F.col("n") + 1).alias("first"))


def heatmap(linked: DataFrame, value: str, most: int = 200) -> DataFrame:
    """The wide form of a linkage for drawing: a row per ``f2``, a column per ``f1``; of at most ``most`` functions."""
    names = sorted(r[0] for r in linked.select("f1").distinct().limit(most + 1).collect())
    if len(names) > most:
        raise ValueError(f"more than {most} functions cannot be drawn")
    return linked.groupBy("f2").pivot("f1", names).agg(F.first(value)).orderBy("f2")
