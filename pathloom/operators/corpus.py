"""Diagnostics of a corpus of token paths."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def path_hash(tokens: Column) -> Column:
    """MD5 of the tokens, each ended by a NUL."""
    return F.md5(F.concat(F.array_join(tokens, "\0"), F.lit("\0")))


def volume(df: DataFrame) -> DataFrame:
    """One row: files, functions, paths, tokens.  df: file, func_addr, n."""
    return df.agg(
        F.countDistinct("file").alias("files"),
        F.countDistinct("file", F.coalesce("func_addr", F.lit("?"))).alias("functions"),
        F.count("*").alias("paths"),
        F.coalesce(F.sum("n"), F.lit(0)).cast("long").alias("tokens"),
    )


def duplicates(df: DataFrame) -> DataFrame:
    """One row: paths, distinct ones, percentage of repeats.  df: h (hash)."""
    n, u = F.count("*"), F.countDistinct("h")
    return df.agg(n.alias("paths"), u.alias("unique_paths"), F.round((1 - u / n) * 100, 6).alias("dup_pct"))


def entropy(freq: DataFrame, count: str = "freq") -> DataFrame:
    """One row: Shannon entropy in bits, its greatest value, utilisation in percent."""
    n = F.sum(count).cast("double")
    c = F.col(count).cast("double")
    bits = F.log2(n) - F.sum(c * F.log2(c)) / n
    most = F.log2(F.count("*").cast("double"))
    return freq.agg(F.round(bits, 6).alias("entropy"), F.round(most, 6).alias("max_entropy"), F.round(F.when(most > 0, bits / most * 100), 6).alias("utilisation"))


def nearest_rank(df: DataFrame, value: str, percents: tuple[int, ...], kind: str = "long") -> DataFrame:
    """``p``, ``value``: the value at place int(p/100*(n-1)) of all, in order.

    Values are counted first, so the running sum goes over distinct values only.
    """
    counts = df.groupBy(F.col(value).alias("_v")).agg(F.count("*").alias("_c"))
    upto = F.sum("_c").over(Window.orderBy("_v"))
    total = F.sum("_c").over(Window.partitionBy())
    marks = F.array(*(F.struct(F.lit(p).alias("p"), F.floor(F.lit(p) / F.lit(100.0) * (F.col("_n") - 1)).alias("i")) for p in percents))
    ranged = counts.select("_v", "_c", upto.alias("_upto"), total.alias("_n")).withColumn("_m", F.explode(marks))
    hit = (F.col("_m.i") < F.col("_upto")) & (F.col("_m.i") >= F.col("_upto") - F.col("_c"))
    return ranged.filter(hit).select(F.col("_m.p").alias("p"), F.col("_v").cast(kind).alias("value"))


def diversity(df: DataFrame) -> DataFrame:
    """Per file and function: paths, distinct ones, their ratio.  df: file, func_addr, h."""
    g = df.groupBy("file", F.coalesce("func_addr", F.lit("?")).alias("func_addr")).agg(F.count("*").alias("paths"), F.countDistinct("h").alias("unique_paths"))
    return g.withColumn("ratio", F.round(F.col("unique_paths") / F.col("paths"), 6))


def percentiles(df: DataFrame, value: str, named: dict[str, int], kind: str = "long") -> DataFrame:
    """One row: the places ``named`` in percent, by name."""
    p = nearest_rank(df, value, tuple(sorted(set(named.values()))), kind)
    return p.agg(*(F.max(F.when(F.col("p") == at, F.col("value"))).alias(name) for name, at in named.items()))


def shares(freq: DataFrame, tops: tuple[int, ...], count: str = "freq") -> DataFrame:
    """``top``, ``share`` (percent) of the most frequent tokens together; only the most frequent are sorted."""
    most = freq.orderBy(F.col(count).desc(), "token").limit(max(tops)).select(F.collect_list(count).alias("_l"))
    one = most.select(F.sort_array("_l", False).alias("_l"), F.explode(F.array(*map(F.lit, tops))).alias("top"))
    summed = F.aggregate(F.slice("_l", 1, F.col("top")), F.lit(0).cast("long"), lambda a, x: a + x)
    return one.select("top", F.round(summed / freq.agg(F.sum(count)).scalar() * 100, 6).alias("share"))


def path_entropy(df: DataFrame, key: str, tokens: str) -> DataFrame:
    """``key``, ``entropy`` (bits), ``n`` of the elements of every array that has any; nothing is shuffled.

    Nulls are elements of one kind.
    """

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in source:
            column = b.column(1)
            size = np.asarray(pc.fill_null(pc.list_value_length(column), 0)).astype(np.int64)
            coded = column.flatten().dictionary_encode(null_encoding="encode")
            k = max(1, len(coded.dictionary))
            at, count = np.unique(np.repeat(np.arange(len(size)), size) * k + np.asarray(coded.indices).astype(np.int64), return_counts=True)
            total = np.bincount(at // k, count * np.log2(count), len(size))
            rows = np.flatnonzero(size)
            bits = np.abs(np.log2(size[rows]) - total[rows] / size[rows])
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(rows)), pa.array(np.round(bits, 6)), pa.array(size[rows])], names=[key, "entropy", "n"])

    return df.select(key, tokens).mapInArrow(run, f"{key} {df.schema[key].dataType.simpleString()}, entropy double, n long")
