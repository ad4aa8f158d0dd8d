"""Intermediate tables in the folder that all executors share.

A table written here cuts lineage: a lost executor costs a re-read, not a
recomputation.  The folder is the session's ``spark.checkpoint.dir``; only
where that is unset (tests, local runs) a temporary folder is chosen.
"""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_written: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The URI of the shared folder; set on the session where it was unset."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise RuntimeError("on a cluster spark.checkpoint.dir must name a folder that all executors share")
        at = "file://" + tempfile.mkdtemp(prefix="pathloom-shared-")
        spark.conf.set("spark.checkpoint.dir", at)
    return at.rstrip("/")


def write_shared(df: DataFrame, name: str, partitions: list[str] | None = None) -> str:
    """Writes ``df`` as a Parquet table of the shared folder; its URI."""
    spark = df.sparkSession
    at = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    writer = df.write.option("compression", "zstd")
    if partitions:
        writer = writer.partitionBy(*partitions)
    writer.parquet(at)
    _written.append((spark, at))
    return at


def written(df: DataFrame, name: str) -> DataFrame:
    """Writes ``df`` as a Parquet table of the shared folder and reads it again."""
    return df.sparkSession.read.schema(df.schema).parquet(write_shared(df, name))


def drop_written() -> None:
    """Removes every table that ``written`` left, as far as sessions still run.

    For long sessions: call it when the results of the queries so far are done
    with.  It is called at exit as well.
    """
    while _written:
        spark, at = _written.pop()
        try:
            path = spark._jvm.org.apache.hadoop.fs.Path(at)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
        except Exception:  # noqa: BLE001 - the session has ended
            pass


atexit.register(drop_written)
