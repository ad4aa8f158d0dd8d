"""Queries over streams, here all the files of a directory read as one."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..sources.tables import stream
from ..streaming.token_counts import run_to_end, token_counts
from .registry import query
from .views_sql import FREQ


@query(f"WITH {FREQ} SELECT token, freq FROM freq")
def token_freq_stream(spark: SparkSession, d: str) -> DataFrame:
    """Counts per token over a stream of path records, each counted once though delivered again."""
    return run_to_end(token_counts(stream(spark, d, "paths")))
