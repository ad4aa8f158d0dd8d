"""Token frequencies kept up to date while path records arrive.

Ids are made unique by a state that forgets them after the lateness allowed, so
that it stays bounded; counts are kept per token.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.shared import shared_dir


def token_counts(stream: DataFrame, key: str = "path_id", tokens: str = "tokens", arrived: str = "ingested_at", late: str = "120 days") -> DataFrame:
    """``token``, ``freq`` over a stream of records; a record delivered again within ``late`` counts once."""
    at = F.col(arrived).cast("timestamp").alias("_at")
    once = stream.select(F.col(key).alias("_key"), F.col(tokens).alias("_tokens"), at).withWatermark("_at", late).dropDuplicatesWithinWatermark(["_key"])
    t = once.select(F.explode("_tokens").alias("token")).filter(F.col("token").isNotNull())
    return t.groupBy("token").agg(F.count("*").alias("freq"))


def arrivals(stream: DataFrame, arrived: str = "ingested_at", window: str = "7 days", late: str = "30 days") -> DataFrame:
    """``start``, ``records`` per window of arrival time; closed once nothing in it can come any more."""
    at = F.col(arrived).cast("timestamp").alias("_at")
    g = stream.select(at).withWatermark("_at", late).groupBy(F.window("_at", window).alias("w"))
    return g.agg(F.count("*").alias("records")).select(F.col("w.start").alias("start"), "records")


def run_to_end(counts: DataFrame, mode: str = "complete") -> DataFrame:
    """Runs a stream over all that is there and reads its last result."""
    spark: SparkSession = counts.sparkSession
    at = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"

    def save(batch: DataFrame, _: int) -> None:
        batch.write.mode("overwrite" if mode == "complete" else "append").parquet(f"{at}/out")

    q = counts.writeStream.outputMode(mode).option("checkpointLocation", f"{at}/state").trigger(availableNow=True).foreachBatch(save).start()
    q.awaitTermination()
    return spark.read.schema(counts.schema).parquet(f"{at}/out")
