"""Runs of the same event in a row, collapsed into one event each.

The row number within an entity minus the row number within an entity and
value is constant along a run and differs between runs of one value, so runs
are groups of (entity, value, difference).  Each input row is one sequence; the
sequences are spread evenly over the tasks once, as whole arrays, and both row
numbers and the grouping then need no further shuffle.

Defined cases
    null or empty token list: no runs;
    null token: no event; it ends a run;
    null clock list or tick: the run has the ticks that are there, or null;
    clock list of another length: missing ticks are null, further ones ignored;
    equal or null entity ids, repeated rows: each row is a sequence of its own;
    a clock that jumps back: the duration is last minus first, below zero.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_BLANK = " \t\n\r\x0b\x0c"


def canonical_event(token: Column) -> Column:
    """Trimmed, upper-cased, without what follows an ``@`` (the closing ``>`` of a bracketed token stays)."""
    t = F.upper(F.btrim(token, F.lit(_BLANK)))
    head = F.substring_index(t, "@", 1)
    return F.when(~t.contains("@"), t).when(t.startswith("<") & t.endswith(">"), F.concat(head, F.lit(">"))).otherwise(head)


def event_runs(df: DataFrame, entity: str = "trace_id", tokens: str = "tokens", ticks: str | None = "ticks", least: int = 1) -> DataFrame:
    """Runs of at least ``least`` events.

    Columns: the entity, ``token`` (canonical), ``start_pos``, ``end_pos`` (from 1),
    ``n_events``, ``first_tick``, ``last_tick``, ``duration``.
    """
    clock = F.coalesce(F.col(ticks), F.array().cast("array<bigint>")) if ticks else F.array().cast("array<bigint>")
    rows = df.select(F.col(entity).alias("_entity"), F.col(tokens).alias("_tokens"), clock.alias("_ticks"), F.monotonically_increasing_id().alias("_row")).filter(F.size("_tokens") > 0)
    # the clock is cut to the tokens, so that the zip is as long as they are
    pairs = F.arrays_zip(F.col("_tokens").alias("t"), F.slice("_ticks", 1, F.greatest(F.size("_tokens"), F.lit(0))).alias("k"))
    events = rows.repartition("_row").select("_row", "_entity", F.posexplode(pairs).alias("_pos", "_e"))
    events = events.select("_row", "_entity", (F.col("_pos") + 1).alias("_pos"), canonical_event(F.col("_e.t")).alias("_token"), F.col("_e.k").alias("_tick")).filter(F.col("_token").isNotNull())
    nth = F.row_number().over(Window.partitionBy("_row", "_token").orderBy("_pos"))
    runs = events.withColumn("_run", F.col("_pos") - nth).groupBy("_row", "_token", "_run").agg(
        F.first("_entity").alias(entity),
        F.min("_pos").alias("start_pos"),
        F.max("_pos").alias("end_pos"),
        F.count("*").alias("n_events"),
        F.min_by("_tick", F.when(F.col("_tick").isNotNull(), F.col("_pos"))).alias("first_tick"),
        F.max_by("_tick", F.when(F.col("_tick").isNotNull(), F.col("_pos"))).alias("last_tick"),
    )
    return runs.filter(F.col("n_events") >= least).select(
        entity, F.col("_token").alias("token"), F.col("start_pos").cast("long").alias("start_pos"), F.col("end_pos").cast("long").alias("end_pos"), "n_events", "first_tick", "last_tick", (F.col("last_tick") - F.col("first_tick")).alias("duration")
    )
