"""Operators on ordered records and arrays that need more than one row."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import written


def numbered(df: DataFrame, order: list[Column], name: str = "_i") -> DataFrame:
    """Adds the place of each row in ``order``, from 0, without moving all rows to one task.

    Rows are sorted by range; only the sizes of the ranges are summed up in order.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # written, so that both uses below see the same ranges
    ranged = written(df.repartitionByRange(parts, *order).withColumn("_part", F.spark_partition_id()), "ranges")
    local = ranged.withColumn("_nth", F.row_number().over(Window.partitionBy("_part").orderBy(*order)))
    sizes = ranged.groupBy("_part").agg(F.count("*").alias("_size"))
    before = F.sum("_size").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    offsets = sizes.select("_part", F.coalesce(before, F.lit(0)).alias("_before"))  # one row per partition
    return local.join(F.broadcast(offsets), "_part").withColumn(name, F.col("_before") + F.col("_nth") - 1).drop("_part", "_nth", "_before")


def halo_ranges(df: DataFrame, key: str, width: int, parts: int | None = None) -> DataFrame:
    """The rows by ranges of ``key`` (an integer; no nulls, no repeats), each range with the ``width - 1`` rows after it.

    Adds ``_part`` (a number) and ``_own`` (whether the row is of the range itself).
    Only keys are looked at to cut the ranges: the bounds and the keys that a range
    begins with, ``width`` at most, come to the driver, so many per partition.  A
    row is then moved once, and those at the start of a range twice.
    """
    parts = parts or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keys = df.select(F.col(key).cast("long").alias("_key"))
    cuts = keys.agg(F.percentile_approx("_key", [i / parts for i in range(1, parts)], 10_000).alias("b")).first()["b"] if parts > 1 else []
    bounds = np.unique(np.array(cuts or [], np.int64))

    @F.pandas_udf("int")
    def part_of(k: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(bounds, k.to_numpy(), side="right").astype(np.int32))

    place = F.row_number().over(Window.partitionBy("_part").orderBy("_key"))
    first = keys.withColumn("_part", part_of("_key")).withColumn("_n", place).filter(F.col("_n") < width).select("_part", "_key").collect()
    heads = np.sort(np.array([r["_key"] for r in first], np.int64))
    # the last key that a range takes from those after it
    after = np.searchsorted(heads, bounds) + width - 2
    reach = np.where(after < len(heads), heads[np.minimum(after, len(heads) - 1)], np.iinfo(np.int64).max) if len(heads) and width > 1 else bounds - 1

    @F.pandas_udf("struct<low:int,own:int>")
    def parts_of(k: pd.Series) -> pd.DataFrame:
        v = k.to_numpy()
        own = np.searchsorted(bounds, v, side="right").astype(np.int32)
        return pd.DataFrame({"low": np.minimum(np.searchsorted(reach, v, side="left"), own).astype(np.int32), "own": own})

    placed = df.withColumn("_p", parts_of(F.col(key).cast("long")))
    each = placed.select(*df.columns, F.explode(F.sequence("_p.low", "_p.own")).alias("_part"), F.col("_p.own").alias("_to"))
    return each.select(*df.columns, "_part", (F.col("_part") == F.col("_to")).alias("_own")).repartitionById(len(bounds) + 1, "_part")


def banded_join(df: DataFrame, key: str, width: int, parts: int | None = None) -> DataFrame:
    """Pairs of each row with itself and the ``width - 1`` rows after it in the order of ``key``.

    a, b (keys), and every other column twice, with _a and _b.
    """
    others = [c for c in df.columns if c != key]
    near = Window.partitionBy("_part").orderBy(key).rowsBetween(0, width - 1)
    rows = halo_ranges(df, key, width, parts).withColumn("_near", F.collect_list(F.struct(key, *others)).over(near)).filter("_own")
    pairs = rows.select(key, *others, F.explode("_near").alias("_b"))
    return pairs.select(F.col(key).alias("a"), F.col(f"_b.{key}").alias("b"), *(F.col(c).alias(f"{c}_a") for c in others), *(F.col(f"_b.{c}").alias(f"{c}_b") for c in others))


def unlikeness(values: np.ndarray, starts: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Places that differ, of the length of the longer sequence; nan for two empty ones.

    values, starts: sequences end to end; a, b: numbers of sequences.
    """
    n = np.diff(starts)
    both, most = np.minimum(n[a], n[b]), np.maximum(n[a], n[b])
    out = (most - both).astype(np.float64)
    step = np.cumsum(both) // 4_000_000
    for x in np.unique(step):
        at = np.flatnonzero(step == x)
        at = at[both[at] > 0]
        if len(at):
            size = both[at]
            begin = np.cumsum(size) - size
            place = np.arange(int(size.sum())) - np.repeat(begin, size)
            differ = values[np.repeat(starts[a[at]], size) + place] != values[np.repeat(starts[b[at]], size) + place]
            out[at] += np.add.reduceat(differ, begin)
    with np.errstate(invalid="ignore"):
        return out / most


def banded_comparison(df: DataFrame, key: str, ids: str, width: int, compare: Callable[[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray], pa.RecordBatch], schema: str, parts: int | None = None) -> DataFrame:
    """``compare(keys, values, starts, a, b)`` of each row and itself and the ``width - 1`` rows after it in the order of ``key``.

    keys: of the sequences that lie end to end in ``values``; a, b: the pairs, by
    number.  A task holds one batch of rows and the ``width - 1`` before it.
    """
    rows = halo_ranges(df.select(key, ids), key, width, parts).sortWithinPartitions("_part", key)

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None
        for batch in source:
            if not batch.num_rows:
                continue
            new = pa.Table.from_batches([batch])
            t = new if held is None else pa.concat_tables([held, new])
            before = t.num_rows - new.num_rows
            keys, part, own = t.column(0).to_numpy(), t.column(2).to_numpy(), t.column(3).to_numpy()
            b = np.arange(before, t.num_rows)
            lag = np.arange(width)
            a = b[:, None] - lag[None, :]
            ok = a >= 0
            ok[ok] &= (part[a[ok]] == np.broadcast_to(part[b][:, None], a.shape)[ok]) & own[a[ok]]
            lists = t.column(1).combine_chunks()
            starts = np.concatenate(([0], np.cumsum(lists.value_lengths().fill_null(0).to_numpy()))).astype(np.int64)
            yield compare(keys, lists.flatten().to_numpy(), starts, a[ok], np.broadcast_to(b[:, None], a.shape)[ok])
            held = t.slice(max(0, t.num_rows - width + 1)) if width > 1 else None

    return rows.mapInArrow(run, schema)


def trim_common_prefix(df: DataFrame, group: list[str], tokens: str, context: int) -> DataFrame:
    """Adds ``trimmed``: how many tokens the rows of a group begin with in common, less ``context``, 0 at least.

    0 too for a group of one row, or where no token differs within the shortest row.
    Null tokens equal each other.  What all rows begin with in common, the least
    and the greatest of them do: so one aggregate finds it.
    """
    sizes = df.groupBy(*group).agg(F.count("*").alias("_rows"), F.min(F.size(tokens)).alias("_least"), F.min(tokens).alias("_x"), F.max(tokens).alias("_y"))
    both = F.slice("_x", 1, F.greatest("_least", F.lit(0)))
    first = F.array_position(F.zip_with(both, F.slice("_y", 1, F.greatest("_least", F.lit(0))), lambda x, y: ~x.eqNullSafe(y)), True)
    cut = sizes.select(*group, F.when(F.col("_rows") > 1, first - 1).alias("_first"))
    return df.join(cut, group, "left").withColumn("trimmed", F.greatest(F.coalesce(F.when(F.col("_first") >= 0, F.col("_first")) - context, F.lit(0)), F.lit(0))).drop("_first")
