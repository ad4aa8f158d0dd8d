"""Queries on series."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import series as S
from ..sources.tables import table
from ..sources.views import training_log
from .registry import query
from .views_sql import LOG

_EMA = f"WITH RECURSIVE {LOG}, o AS (SELECT epoch, loss, row_number() OVER (ORDER BY epoch) AS rn FROM log), e AS (SELECT rn, epoch, loss, loss AS smooth FROM o WHERE rn = 1 UNION ALL SELECT o.rn, o.epoch, o.loss, 0.85::DOUBLE * e.smooth + (1 - 0.85::DOUBLE) * o.loss FROM e JOIN o ON o.rn = e.rn + 1)"


@query(f"{_EMA} SELECT epoch, round(loss, 6) AS loss, round(smooth, 6) AS smooth FROM e")
def ema_curve(spark: SparkSession, d: str) -> DataFrame:
    return S.ema(training_log(spark, d), "epoch", "loss").select("epoch", F.round("loss", 6).alias("loss"), F.round("smooth", 6).alias("smooth"))


@query(f"WITH {LOG}, x AS (SELECT epoch, coalesce(loss - lag(loss) OVER (ORDER BY epoch), 0) AS delta FROM log) SELECT epoch, round(delta, 6) AS delta, CASE WHEN delta < 0 THEN 'down' WHEN delta > 0 THEN 'up' ELSE 'flat' END AS trend FROM x")
def loss_delta(spark: SparkSession, d: str) -> DataFrame:
    return S.deltas(training_log(spark, d), "epoch", "loss").select("epoch", F.round("delta", 6).alias("delta"), "trend")


def _extremes_sql(t: str, v: str, name: str) -> str:
    return f"SELECT '{name}' AS metric, (SELECT epoch FROM {t} ORDER BY {v}, epoch LIMIT 1) AS best, (SELECT epoch FROM {t} ORDER BY {v} DESC, epoch LIMIT 1) AS worst, round(min({v}), 6) AS least, round(arg_max({v}, epoch), 6) AS final, min(epoch) AS first, max(epoch) AS last, count(*) AS n FROM {t}"


@query(f"{_EMA} {_extremes_sql('e', 'loss', 'loss')} UNION ALL {_extremes_sql('e', 'smooth', 'smooth')}")
def best_epoch(spark: SparkSession, d: str) -> DataFrame:
    """Extremes of the raw and of the smoothed series, a row each."""
    e = S.ema(training_log(spark, d), "epoch", "loss")
    return S.extremes(e, "epoch", "loss").withColumn("metric", F.lit("loss")).unionByName(S.extremes(e, "epoch", "smooth").withColumn("metric", F.lit("smooth")))


@query(f"WITH {LOG}, o AS (SELECT epoch, loss, row_number() OVER (ORDER BY epoch) - 1 AS i, count(*) OVER () AS n FROM log) SELECT epoch, round(loss, 6) AS loss FROM o WHERE i >= floor(0.9::DOUBLE * n)")
def plateau(spark: SparkSession, d: str) -> DataFrame:
    return S.plateau(training_log(spark, d), "epoch").select("epoch", F.round("loss", 6).alias("loss"))


@query("SELECT event_type, round(sum(value * (1 + event_id % 3)) / sum(1 + event_id % 3), 6) AS mean, round(min(value), 6) AS low, round(max(value), 6) AS high, CAST(sum(1 + event_id % 3) AS BIGINT) AS weight FROM events GROUP BY event_type")
def weighted_meter(spark: SparkSession, d: str) -> DataFrame:
    """Weighted running mean, least and greatest value, total weight."""
    w = F.col("event_id") % 3 + 1
    return table(spark, d, "events").groupBy("event_type").agg(F.round(F.sum(F.col("value") * w) / F.sum(w), 6).alias("mean"), F.round(F.min("value"), 6).alias("low"), F.round(F.max("value"), 6).alias("high"), F.sum(w).alias("weight"))
