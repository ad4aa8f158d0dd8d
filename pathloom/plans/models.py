"""Queries that run a model; its weights here come from a seed, as no checkpoint is public."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import model as M
from ..operators.sequences import banded_comparison, unlikeness
from ..operators.training import train
from ..operators.vocabulary import build_vocab, encode, token_freq
from ..sources.shared import written
from ..sources.tables import table
from ..sources.views import corpus
from .registry import query
from .sequences import is_selected

#: The most tokens of a path in training (the reference's limit_sequence_length).
TRAINED = 500


def _model(spark: SparkSession, d: str, seen: int | None = None) -> tuple[DataFrame, M.Weights]:
    """``path_id``, ``file``, ``func_addr``, ``ids`` of whole paths, and weights for all ids at the reference's sizes.

    seen: only the last so many tokens of a path become ids, where the result depends on no others.
    """
    c = corpus(spark, d)
    v = build_vocab(token_freq(c))
    size = v.agg(F.max("id")).first()[0] + 1
    if seen is not None:
        c = c.withColumn("tokens", M.ending("tokens", seen))
    return encode(c, v).select("path_id", "file", "func_addr", "ids"), M.init_weights(size)


def _rounded(df: DataFrame) -> DataFrame:
    return df.withColumn("length", F.round("length", 2))


@query()
def encode_paths(spark: SparkSession, d: str) -> DataFrame:
    """From tokens to the vectors of all places of every path, with the function they go with: how many numbers, and their length.

    ``operators.model.encode_paths`` without ``figures`` gives the vectors, which
    ``sources.formats.write_embeddings`` stores by function.
    """
    ids, weights = _model(spark, d)
    return _rounded(M.encode_paths(ids, ["path_id", "file", "func_addr"], "ids", weights, figures=True))


@query()
def predict_paths(spark: SparkSession, d: str) -> DataFrame:
    """The vector predicted for a masked place after every path: how many numbers, and their length."""
    ids, weights = _model(spark, d, M.SEEN)
    return _rounded(M.predict_paths(ids, ["path_id", "file", "func_addr"], "ids", weights, figures=True))


@query()
def pair_metrics(spark: SparkSession, d: str) -> DataFrame:
    """Each path and the nine after it, padded to one length, where they are alike without being equal or hardly alike: unlikeness and how near the model finds them."""
    ids, weights = _model(spark, d)
    longest = table(spark, d, "paths").agg(F.greatest(F.least(F.max(F.size("tokens")), F.lit(TRAINED)), F.lit(1))).first()[0] or 1
    ids = ids.filter("size(ids) > 0 AND path_id IS NOT NULL").select("path_id", F.slice("ids", 1, longest).alias("ids"))

    def compare(keys: np.ndarray, values: np.ndarray, starts: np.ndarray, a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
        u = unlikeness(values, starts, a, b)
        keep = is_selected(u)
        a, b, u = a[keep], b[keep], u[keep]
        encoder, known = M.PaddedEncoder(weights, longest), {}
        rows = np.unique(np.concatenate([a, b])).tolist()
        coming = zip(rows, encoder.encode_all([values[starts[k] : starts[k + 1]] for k in rows]), strict=True)
        found = np.zeros((len(a), 3))
        for i, (x, y) in enumerate(zip(a.tolist(), b.tolist(), strict=True)):
            # pairs come in the order of their later row, which is the greater
            while y not in known:
                k, z = next(coming)
                known[k] = z
                for old in [k for k in known if k < y - 9]:
                    del known[old]
            found[i] = encoder.compare(known[x], known[y])
        cols = [pa.array(keys[a]), pa.array(keys[b]), pa.array(np.round(u, 6)), *(pa.array(np.round(found[:, j], 3)) for j in range(3))]
        return pa.RecordBatch.from_arrays(cols, names=["a", "b", "unlikeness", "similarity", "distance", "dot_product"])

    return banded_comparison(ids, "path_id", "ids", 10, compare, "a long, b long, unlikeness double, similarity double, distance double, dot_product double")


@query()
def train_log(spark: SparkSession, d: str) -> DataFrame:
    """Two epochs of training over all paths, as a log."""
    ids, weights = _model(spark, d)
    ids = written(ids.select("path_id", "ids"), "training-ids")  # read again in every epoch
    *_, log = train(ids, "path_id", "ids", weights, epochs=2, batch=64, rate=1e-3, length=TRAINED)
    return spark.createDataFrame(log, "epoch int, loss double")
