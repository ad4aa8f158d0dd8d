"""Frequency of every distinct term: occurrences, and records that hold it.

Repeated deliveries of a record are found by ids alone.  Per-record term counts
are made where a record lies and summed by hash on each task before the one
shuffle by term.  A term that holds a third of all occurrences therefore
reaches the shuffle as one row per task, and no record's counts are shuffled.

Defined cases
    null or empty token list: the record counts, without terms;
    null token: no term;
    null record id: every such row is a record of its own;
    repeated record id: its rows hold the same tokens; one of them counts;
    empty table: no rows.
Other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.once import once
from .arrow_tokens import batches, row_counts, token_batch


def _count_terms(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches(source):
        flat = token_batch(b.column(1))
        row, code, count = row_counts(flat)
        if None in flat.words:
            keep = code != flat.words.index(None)
            row, code, count = row[keep], code[keep], count[keep]
        starts = pa.array(np.searchsorted(row, np.arange(b.num_rows + 1)), pa.int32())
        words = pa.array(flat.words, pa.string()).take(pa.array(code))
        yield pa.RecordBatch.from_arrays(
            [b.column(0), pa.ListArray.from_arrays(starts, words), pa.ListArray.from_arrays(starts, pa.array(count, pa.int32()))],
            names=["_id", "_terms", "_counts"],
        )


def record_terms(df: DataFrame, record: str = "path_id", tokens: str = "tokens") -> DataFrame:
    """One row per record: _id, _terms, _counts."""
    base = once(df.select(F.col(record).alias("_id"), F.col(tokens).alias("_tokens")), "_id", nulls=False)
    kind = base.schema["_id"].dataType
    schema = T.StructType([T.StructField("_id", kind), T.StructField("_terms", T.ArrayType(T.StringType())), T.StructField("_counts", T.ArrayType(T.IntegerType()))])
    return base.mapInArrow(_count_terms, schema)


def term_frequencies(df: DataFrame, record: str = "path_id", tokens: str = "tokens") -> DataFrame:
    """``term``, ``occurrences``, ``records`` of every distinct term."""
    terms = record_terms(df, record, tokens).select(F.explode(F.arrays_zip("_terms", "_counts")).alias("t"))
    return terms.groupBy(F.col("t._terms").alias("term")).agg(F.sum("t._counts").alias("occurrences"), F.count("*").alias("records"))


def record_count(df: DataFrame, record: str = "path_id") -> DataFrame:
    """One row, ``n``: distinct record ids, and rows without one."""
    return df.select(F.col(record).alias("_id")).agg((F.countDistinct("_id") + F.count_if(F.col("_id").isNull())).alias("n"))


def marked_terms(df: DataFrame, record: str = "path_id", tokens: str = "tokens", min_records: int = 3, max_share: float = 0.8) -> DataFrame:
    """``term_frequencies`` with ``mark``: 'rare' under ``min_records`` records, 'common' over ``max_share`` of all, else null."""
    total = record_count(df, record).select(F.col("n").cast("double")).scalar()
    mark = F.when(F.col("records") < min_records, "rare").when(F.col("records") > total * F.lit(max_share), "common")
    return term_frequencies(df, record, tokens).withColumn("mark", mark)
