"""The tables of a data directory as the records the operators work on."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .once import once
from .tables import table

_BLANK = " \t\n\r"


def corpus(spark: SparkSession, d: str) -> DataFrame:
    """Path records, once per id: path_id, file (shard), func_addr (0x.. or null), tokens (never null).

    Ids that were delivered again are found first, so that no token array is shuffled.
    """
    digits = F.ltrim(F.regexp_replace(F.lower(F.btrim("func_addr", F.lit(_BLANK))), "^0x", ""), F.lit("0"))
    return once(table(spark, d, "paths"), "path_id").select(
        "path_id",
        F.btrim(F.substring_index("file_name", "/", -1), F.lit(_BLANK)).alias("file"),
        F.concat(F.lit("0x"), digits).alias("func_addr"),
        F.coalesce("tokens", F.array().cast("array<string>")).alias("tokens"),
    )


def records(spark: SparkSession, d: str, *columns: str, only: Column | None = None) -> DataFrame:
    """The corpus without token arrays: path_id, file, func_addr and expressions on ``tokens``.

    The arrays are reduced before ids are made unique, so that they are not shuffled.
    only: a condition on columns as stored.
    """
    digits = F.ltrim(F.regexp_replace(F.lower(F.btrim("func_addr", F.lit(_BLANK))), "^0x", ""), F.lit("0"))
    base = table(spark, d, "paths")
    base = (base if only is None else base.filter(only)).withColumn("tokens", F.coalesce("tokens", F.array().cast("array<string>")))
    base = base.select("path_id", F.btrim(F.substring_index("file_name", "/", -1), F.lit(_BLANK)).alias("file"), F.concat(F.lit("0x"), digits).alias("func_addr"), *(F.expr(c) for c in columns))
    return base.dropDuplicates(["path_id"])


def event_graph(spark: SparkSession, d: str) -> DataFrame:
    """Edges of a small graph per user: func, src, dst; from each event type to the next one, without loops."""
    nxt = F.lead("event_type").over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    e = table(spark, d, "events").select(F.col("user_id").alias("func"), F.col("event_type").alias("src"), nxt.alias("dst"))
    return e.filter((F.col("dst").isNotNull()) & (F.col("src") != F.col("dst"))).distinct()


def training_log(spark: SparkSession, d: str) -> DataFrame:
    """A series: epoch (day from 0), loss (mean event value)."""
    e = table(spark, d, "events").select(F.to_date("ts").alias("day"), "value")
    days = e.groupBy("day").agg(F.avg("value").alias("loss"))
    first = F.min("day").over(Window.partitionBy())
    return days.select(F.datediff("day", first).alias("epoch"), "loss")


def vectors(spark: SparkSession, d: str) -> DataFrame:
    """Path vectors: func (label), path_id, emb."""
    return table(spark, d, "embeddings").select(F.col("label").alias("func"), F.col("vec_id").alias("path_id"), F.col("embedding").alias("emb"))
