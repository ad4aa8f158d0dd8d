"""Operators on short ordered series, such as training logs."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def ema(df: DataFrame, order: str, value: str, alpha: float = 0.85) -> DataFrame:
    """``order``, ``value``, ``smooth``: the first value, then alpha times the smoothed one before plus 1 - alpha times the value.

    A recurrence has no parallel form that keeps its rounding, so a series goes
    through one task in order, a batch at a time; a log has one row per epoch.
    """
    kinds = df.select(order, value)

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None
        for b in source:
            smooth = []
            for v in b.column(1).to_pylist():
                last = v if last is None else None if v is None else alpha * last + (1 - alpha) * v
                smooth.append(last)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(smooth, pa.float64())], names=[order, value, "smooth"])

    ordered = kinds.withColumn(value, F.col(value).cast("double")).repartition(1).sortWithinPartitions(order)
    return ordered.mapInArrow(run, f"{order} {df.schema[order].dataType.simpleString()}, {value} double, smooth double")


def deltas(df: DataFrame, order: str, value: str) -> DataFrame:
    """Adds ``delta`` to the value before, 0 at first, and ``trend``."""
    delta = F.col(value) - F.lag(value, 1).over(Window.orderBy(order))
    out = df.withColumn("delta", F.coalesce(delta, F.lit(0.0)))
    return out.withColumn("trend", F.when(F.col("delta") < 0, "down").when(F.col("delta") > 0, "up").otherwise("flat"))


def extremes(df: DataFrame, order: str, value: str) -> DataFrame:
    """One row: where the least and the greatest value are (the first on ties), the last value, first and last place, count."""
    return df.agg(
        F.min_by(order, F.struct(F.col(value), F.col(order))).alias("best"),
        F.min_by(order, F.struct(-F.col(value), F.col(order))).alias("worst"),
        F.round(F.min(value), 6).alias("least"),
        F.round(F.max_by(value, order), 6).alias("final"),
        F.min(order).alias("first"),
        F.max(order).alias("last"),
        F.count("*").alias("n"),
    )


def plateau(df: DataFrame, order: str, share: float = 0.9) -> DataFrame:
    """The rows from place int(share * n) on."""
    rn = F.row_number().over(Window.orderBy(order)) - 1
    n = F.count("*").over(Window.partitionBy())
    return df.select("*", rn.alias("_rn"), n.alias("_n")).filter(F.col("_rn") >= F.floor(F.lit(share) * F.col("_n"))).drop("_rn", "_n")
