"""Rows of a table whose key may have been delivered again, each key once.

Only keys move: the repeated ones are found on the key column alone, and one row
of each is kept where it lies.  The other columns of a row, however wide, are
never shuffled for it.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import written

#: Repeated keys up to this number, counted, are sent to all tasks; more are joined.
MOST_SENT = 1_000_000


def _of_files(df: DataFrame) -> bool:
    """Whether rows have a place in a file, so that one of several can be named."""
    try:
        df.select("_metadata.file_path", "_metadata.row_index")
    except AnalysisException:
        return False
    return True


def once(df: DataFrame, key: str, nulls: bool = True, most_sent: int = MOST_SENT) -> DataFrame:
    """One row of every ``key``.  nulls: rows with a null key are one key's; else each is kept.

    df: best a table as read, whose rows have places in files.  Of other frames the
    rows of repeated keys, and they alone, are shuffled.
    """
    columns, places = df.columns, _of_files(df)
    place = F.xxhash64("_metadata.file_path", "_metadata.row_index") if places else F.lit(0).cast("long")
    marked = df.select("*", place.alias("_place"))
    found = marked if nulls else marked.filter(F.col(key).isNotNull())
    repeated = found.groupBy(F.col(key).alias("_key")).agg(F.min("_place").alias("_kept"), F.count("*").alias("_n")).filter("_n > 1").select("_key", "_kept")
    repeated = written(repeated, "repeated-keys")
    sent = F.broadcast(repeated) if repeated.count() <= most_sent else repeated
    same = marked[key].eqNullSafe(sent["_key"]) if nulls else marked[key] == sent["_key"]
    if places:
        return marked.join(sent, same, "left").filter(F.col("_kept").isNull() | (F.col("_kept") == F.col("_place"))).select(*columns)
    return marked.join(sent, same, "left_anti").select(*columns).union(marked.join(sent, same, "left_semi").dropDuplicates([key]).select(*columns))
