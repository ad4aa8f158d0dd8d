"""Interchange formats: JSON lines, vocabularies, matrices, logs, embeddings, checkpoints."""

from __future__ import annotations

import base64
import json
import os
import struct
import time
from dataclasses import dataclass, fields

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

PATH = T.StructType([T.StructField("file", T.StringType()), T.StructField("func_addr", T.StringType()), T.StructField("tokens", T.ArrayType(T.StringType()))])
_CORRUPT = T.StructType([*PATH.fields, T.StructField("_corrupt_record", T.StringType())])


def read_paths(spark: SparkSession, directory: str) -> DataFrame:
    """JSON lines of paths with a fixed schema; bad lines keep their text in ``_corrupt_record``."""
    return spark.read.schema(_CORRUPT).option("mode", "PERMISSIVE").json(directory)


def parse_lines(df: DataFrame, column: str) -> DataFrame:
    """Parses a column of JSON lines: file, func_addr, tokens (never null), ``_corrupt_record`` of those that fail."""
    parsed = F.from_json(column, _CORRUPT, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"})
    rows = df.select(parsed.alias("r")).select("r.*")
    return rows.withColumn("tokens", F.coalesce("tokens", F.array().cast("array<string>")))


def parse_report(parsed: DataFrame) -> DataFrame:
    bad = F.col("_corrupt_record").isNotNull()
    return parsed.agg(F.count("*").alias("lines"), F.count_if(~bad).alias("parsed"), F.count_if(bad).alias("skipped"), F.coalesce(F.sum(F.when(~bad, F.size("tokens"))), F.lit(0)).cast("long").alias("tokens"))


def write_paths(df: DataFrame, directory: str, partition: str | None = "file") -> None:
    """JSON lines, a folder per shard; the commit protocol makes each write whole or absent."""
    w = df.write.mode("overwrite")
    (w.partitionBy(partition) if partition else w).json(directory)


def vocab_of_json(text: DataFrame) -> DataFrame:
    """``token``, ``id`` of a column ``value`` that holds one JSON object."""
    return text.select(F.explode(F.from_json("value", "map<string,int>")).alias("token", "id"))


def read_vocab(spark: SparkSession, path: str) -> DataFrame:
    return vocab_of_json(spark.read.text(path, wholetext=True))


def write_vocab(vocab: DataFrame, path: str, most: int = 1_000_000) -> None:
    """An ordered JSON object, for vocabularies of at most ``most`` terms; larger ones belong in Parquet."""
    rows = vocab.select("token", "id").orderBy("id").limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} terms: write Parquet")
    _replace(path, json.dumps({r["token"]: r["id"] for r in rows}, indent=4, ensure_ascii=False))


def _replace(path: str, text: str) -> None:
    with open(f"{path}.tmp", "w", encoding="utf-8") as f:
        f.write(text)
    os.replace(f"{path}.tmp", path)


def read_matrix(spark: SparkSession, path: str) -> DataFrame:
    """``row``, ``ids`` of a JSON array of integer arrays."""
    text = spark.read.text(path, wholetext=True)
    return text.select(F.posexplode(F.from_json("value", "array<array<int>>")).alias("row", "ids"))


def write_matrix(df: DataFrame, path: str, ids: str = "ids") -> None:
    df.select(ids).write.mode("overwrite").parquet(path)


@dataclass
class Config:
    """A flat training configuration; missing values keep these defaults."""

    epochs: int = 10
    batch_size: int = 20
    learning_rate: float = 1e-4
    seed: int = 0
    mask: str = "random_token"
    data: str = ""

    @property
    def run_id(self) -> str:
        """Time, epochs, rate and batch size; the rate as 1e-4 rather than 0.0001."""
        mantissa, exponent = f"{self.learning_rate:e}".split("e")
        rate = f"{float(mantissa):g}e{int(exponent)}"
        return f"{time.strftime('%Y%m%d-%H%M%S')}_ep{self.epochs}_lr{rate}_bs{self.batch_size}"


def read_config(path: str) -> Config:
    """``key: value`` lines, as a flat YAML file has them; unknown keys and a missing file are errors."""
    known, values = {f.name: f.type for f in fields(Config)}, {}
    with open(path, encoding="utf-8") as f:
        for line in f:
            line = line.split("#")[0].strip()
            if line:
                key, _, value = line.partition(":")
                if key.strip() not in known:
                    raise ValueError(f"unknown setting {key.strip()!r}")
                values[key.strip()] = {"int": int, "float": float, "str": str}[known[key.strip()]](value.strip().strip("'\""))
    return Config(**values)


def read_log(spark: SparkSession, path: str) -> DataFrame:
    """A CSV log with header; names are trimmed and lower-cased, ``epoch`` must be there."""
    df = spark.read.csv(path, header=True, inferSchema=True)
    df = df.toDF(*[c.strip().lower() for c in df.columns])
    if "epoch" not in df.columns:
        raise ValueError("a log needs a column epoch")
    return df


def metric_columns(columns: list[str]) -> list[str]:
    """Columns but the epoch, losses first."""
    rest = [c for c in columns if c != "epoch"]
    return [c for c in rest if "loss" in c] + [c for c in rest if "loss" not in c]


def append_log(df: DataFrame, path: str, formats: dict[str, str]) -> None:
    """Appends rows as CSV, each column in its format."""
    df.select(*(F.format_string(formats[c], c).alias(c) if c in formats else F.col(c).cast("string") for c in df.columns)).write.mode("append").option("header", True).csv(path)


def vector_text(values: list[float]) -> str:
    """Base64 of a count and 32-bit floats: a codec that runs no code on reading."""
    return base64.b64encode(struct.pack(f"<I{len(values)}f", len(values), *values)).decode()


def text_vector(text: str) -> list[float]:
    data = base64.b64decode(text)
    (n,) = struct.unpack_from("<I", data)
    return list(struct.unpack_from(f"<{n}f", data, 4))


def write_embeddings(df: DataFrame, directory: str) -> None:
    """func, path_id, emb as JSON lines with one object per function, vectors in order of path_id."""
    df.groupBy("func").agg(F.transform(F.array_sort(F.collect_list(F.struct("path_id", "emb"))), lambda e: e["emb"]).alias("embs")).write.mode("overwrite").json(directory)


def read_embeddings(spark: SparkSession, directory: str, func: str | None = None) -> DataFrame:
    df = spark.read.schema("func string, embs array<array<float>>").json(directory)
    if func is not None:
        df = df.filter(F.col("func") == func)
    return df.select("func", F.posexplode("embs").alias("path_id", "emb"))


def pending(wanted: DataFrame, finished: DataFrame, key: str) -> DataFrame:
    """What a resumed run still has to do."""
    return wanted.join(finished.select(key), key, "left_anti")


def save_checkpoint(directory: str, epoch: int, weights: dict[str, np.ndarray], every: int = 5) -> None:
    """The latest weights, and those of every ``every``-th epoch, as npz files."""
    os.makedirs(directory, exist_ok=True)
    for name in ["latest", *([f"epoch{epoch}"] if epoch % every == 0 else [])]:
        with open(f"{directory}/{name}.npz.tmp", "wb") as f:
            np.savez(f, epoch=epoch, **weights)
        os.replace(f"{directory}/{name}.npz.tmp", f"{directory}/{name}.npz")


def load_checkpoint(path: str) -> tuple[int, dict[str, np.ndarray]]:
    with np.load(path, allow_pickle=False) as data:
        return int(data["epoch"]), {k: data[k] for k in data.files if k != "epoch"}


def slug(title: Column) -> Column:
    """A panel title as a file name."""
    return F.regexp_replace(F.lower(F.btrim(title)), r"[^a-z0-9]+", "_")


def latex_table(df: DataFrame, columns: list[str], most: int = 1000) -> str:
    """A small frame as rows of a LaTeX table; one of more than ``most`` rows is an error."""
    rows = df.select(*columns).limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} rows are no table")
    head = " & ".join(c.replace("_", r"\_") for c in columns) + r" \\"
    return "\n".join([head, r"\hline", *(" & ".join("--" if v is None else str(v).replace("_", r"\_") for v in r) + r" \\" for r in rows)])


def report_text(report: DataFrame, top: DataFrame | None = None) -> str:
    """A corpus report of one row as text, a figure a line, and the most frequent tokens below."""
    row = report.first()
    wide = max(len(c) for c in report.columns)
    shown = [f"{c.replace('_', ' '):<{wide}}  {f'{v:,.3f}' if isinstance(v, float) else '--' if v is None else f'{v:,}'}" for c, v in zip(report.columns, row, strict=True)]
    if top is not None:
        shown += ["", *(f"{r['token']:<40}{r['freq']:>14,}{r['share']:>8.2f} %" for r in top.orderBy(F.col("freq").desc(), "token").collect())]
    return "\n".join(shown)


def read_shard(spark: SparkSession, directory: str, file: str) -> DataFrame:
    """The paths of one shard of what ``write_paths`` left: only its folder is read."""
    kinds = T.StructType([*_CORRUPT.fields[1:], _CORRUPT.fields[0]])
    return spark.read.schema(kinds).option("mode", "PERMISSIVE").json(directory).filter(F.col("file") == file)
