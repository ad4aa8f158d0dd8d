"""Vocabularies by frequency, and token arrays as ids."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import written
from .sequences import numbered

SPECIALS = ("<PAD>", "<UNK>", "<MASK>")
MOST_SENT = 1_000_000


def token_freq(df: DataFrame, tokens: str = "tokens") -> DataFrame:
    """``token``, ``freq`` of every token; nulls are none."""
    t = df.select(F.explode(tokens).alias("token")).filter(F.col("token").isNotNull())
    return t.groupBy("token").agg(F.count("*").alias("freq"))


def ranked(df: DataFrame, order: list[Column], name: str = "rank", most_sorted: int = MOST_SENT) -> DataFrame:
    """Adds the place of each row in ``order``, from 1.

    The rows are stored and counted: up to ``most_sorted`` are sorted in one task,
    more by ranges.
    """
    df = written(df, "to-rank")
    if df.count() <= most_sorted:
        return df.withColumn(name, F.row_number().over(Window.orderBy(*order)).cast("long"))
    return numbered(df, order, name).withColumn(name, F.col(name) + 1)


def build_vocab(freq: DataFrame, min_freq: int = 2, specials: tuple[str, ...] = SPECIALS, most_sorted: int = MOST_SENT) -> DataFrame:
    """``token``, ``id``, ``freq``: the specials, then tokens of at least ``min_freq`` by falling frequency, ties by token."""
    kept = freq.filter((F.col("freq") >= min_freq) & ~F.col("token").isin(*specials)).select("token", "freq")
    kept = ranked(kept, [F.col("freq").desc(), F.col("token")], "_rank", most_sorted)
    kept = kept.select("token", (F.col("_rank") + len(specials) - 1).cast("int").alias("id"), "freq")
    fixed = freq.sparkSession.createDataFrame([(s, i, 0) for i, s in enumerate(specials)], "token string, id int, freq long")
    return fixed.unionByName(kept)


def _joined(df: DataFrame, elements: str, names: DataFrame, otherwise: Column, out: str, kind: str) -> DataFrame:
    """Adds ``out``: for each element of an array what ``names`` (_e, _to) has for it, by a join.

    The rows are stored with their numbers, so that both uses see the same ones.
    """
    rows = written(df.withColumn("_row", F.monotonically_increasing_id()), "rows")
    flat = rows.select("_row", F.posexplode(elements).alias("_pos", "_e")).join(names, "_e", "left")
    lists = flat.groupBy("_row").agg(F.transform(F.array_sort(F.collect_list(F.struct("_pos", F.coalesce("_to", otherwise).alias("to")))), lambda e: e["to"]).alias(out))
    return rows.join(lists, "_row", "left").drop("_row").withColumn(out, F.coalesce(out, F.array().cast(kind)))


def encode(df: DataFrame, vocab: DataFrame, tokens: str = "tokens", unk: int = 1, most_sent: int = MOST_SENT) -> DataFrame:
    """Adds ``ids``: the id of every token, ``unk`` for others.

    A vocabulary of at most ``most_sent`` terms goes to every task, which looks
    up each distinct token of a batch once; a larger one is joined.
    """
    sent = vocab.select("token", "id").limit(most_sent + 1).collect()
    if len(sent) > most_sent:
        return _joined(df, tokens, vocab.select(F.col("token").alias("_e"), F.col("id").alias("_to")), F.lit(unk), "ids", "array<int>")
    known = {r["token"]: r["id"] for r in sent}
    at = df.columns.index(tokens)

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in source:
            column = b.column(at)
            n = np.asarray(pc.fill_null(pc.list_value_length(column), 0))
            coded = column.flatten().dictionary_encode(null_encoding="encode")
            ids = np.array([known.get(t, unk) for t in coded.dictionary.to_pylist()] or [0], np.int32)
            starts = pa.array(np.concatenate(([0], np.cumsum(n))), pa.int32())
            lists = pa.ListArray.from_arrays(starts, pa.array(ids[np.asarray(coded.indices).astype(np.int64)], pa.int32()))
            yield pa.RecordBatch.from_arrays([*b.columns, lists], names=[*b.schema.names, "ids"])

    return df.mapInArrow(run, df.withColumn("ids", F.array().cast("array<int>")).schema)


def decode(df: DataFrame, vocab: DataFrame, ids: str = "ids", most_sent: int = MOST_SENT) -> DataFrame:
    """Adds ``decoded``: the tokens of ids, by a map of the vocabulary if it has at most ``most_sent`` terms, joined otherwise."""
    sent = vocab.select("token", "id").limit(most_sent + 1).collect()
    if len(sent) > most_sent:
        return _joined(df, ids, vocab.select(F.col("id").alias("_e"), F.col("token").alias("_to")), F.lit("<UNK>"), "decoded", "array<string>")
    names = {r["id"]: r["token"] for r in sent}
    at = df.columns.index(ids)

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in source:
            column = b.column(at)
            n = np.asarray(pc.fill_null(pc.list_value_length(column), 0))
            coded = column.flatten().dictionary_encode()
            words = pa.array([names.get(i, "<UNK>") for i in coded.dictionary.to_pylist()], pa.string())
            starts = pa.array(np.concatenate(([0], np.cumsum(n))), pa.int32())
            yield pa.RecordBatch.from_arrays([*b.columns, pa.ListArray.from_arrays(starts, words.take(coded.indices))], names=[*b.schema.names, "decoded"])

    return df.mapInArrow(run, df.withColumn("decoded", F.array().cast("array<string>")).schema)
