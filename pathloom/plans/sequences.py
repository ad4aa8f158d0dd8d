"""Queries on id sequences: encoding, padding, masks, comparison."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import arrays as A
from ..operators.corpus import path_entropy
from ..operators.sequences import banded_comparison, banded_join, trim_common_prefix, unlikeness
from ..operators.vocabulary import build_vocab, decode as decode_ids, encode as encode_tokens, token_freq
from ..sources.tables import table
from ..sources.views import corpus, records
from .registry import query
from .views_sql import CORPUS, IDS, PADDED

_TEXT = "array_to_string({x}, ' ')"
_REAL = "len(list_filter(ids, lambda x: x <> 0))"


def encoded(spark: SparkSession, d: str) -> DataFrame:
    c = corpus(spark, d)
    return encode_tokens(c, build_vocab(token_freq(c)))


#: The most ids of a padded path; fewer if no path is as long.
LIMIT = 500


def padded(spark: SparkSession, d: str) -> DataFrame:
    longest = table(spark, d, "paths").agg(F.greatest(F.least(F.max(F.size("tokens")), F.lit(LIMIT)), F.lit(0))).first()[0] or 0
    return encoded(spark, d).select("path_id", A.pad_truncate(F.col("ids"), longest).alias("ids"))


@query(f"WITH {IDS} SELECT path_id, {_TEXT.format(x='ids')} AS ids FROM enc")
def encode(spark: SparkSession, d: str) -> DataFrame:
    return encoded(spark, d).select("path_id", A.joined(F.col("ids")).alias("ids"))


@query(f"WITH {IDS} SELECT e.path_id, coalesce(string_agg(v.token, ' ' ORDER BY e.pos), '') AS tokens FROM (SELECT path_id, unnest(ids) AS id, generate_subscripts(ids, 1) AS pos FROM enc) e JOIN voc v ON e.id = v.id GROUP BY e.path_id")
def decode(spark: SparkSession, d: str) -> DataFrame:
    c = corpus(spark, d)
    v = build_vocab(token_freq(c))
    return decode_ids(encode_tokens(c, v), v).filter("size(ids) > 0").select("path_id", F.array_join("decoded", " ").alias("tokens"))


@query(f"WITH {IDS} SELECT c.path_id, len(c.tokens) AS n_raw, len(e.ids) AS n_ids, len(list_filter(e.ids, lambda x: x = 1)) AS n_unknown FROM corpus c JOIN enc e ON c.file IS NOT DISTINCT FROM e.file AND c.path_id = e.path_id")
def raw_encoded_join(spark: SparkSession, d: str) -> DataFrame:
    raw = corpus(spark, d).select("path_id", "file", F.size("tokens").cast("long").alias("n_raw"))
    ids = encoded(spark, d).select("path_id", "file", F.size("ids").cast("long").alias("n_ids"), F.size(F.filter("ids", lambda x: x == A.UNK)).cast("long").alias("n_unknown"))
    return raw.join(ids, ["path_id", "file"]).select("path_id", "n_raw", "n_ids", "n_unknown")


@query(f"WITH {PADDED} SELECT path_id, {_TEXT.format(x='ids')} AS ids FROM padded")
def pad_truncate(spark: SparkSession, d: str) -> DataFrame:
    return padded(spark, d).select("path_id", A.joined(F.col("ids")).alias("ids"))


@query(f"WITH {IDS} SELECT path_id, {_TEXT.format(x='list_concat(list_concat([3], ids[1:62]), [4])')} AS ids FROM enc")
def bos_eos(spark: SparkSession, d: str) -> DataFrame:
    return encoded(spark, d).select("path_id", A.joined(A.bos_eos(F.col("ids"), 3, 4, 64)).alias("ids"))


@query(f"WITH {PADDED} SELECT path_id, {_REAL} AS n FROM padded")
def real_length(spark: SparkSession, d: str) -> DataFrame:
    return padded(spark, d).select("path_id", A.real_length(F.col("ids")).cast("long").alias("n"))


def _mask_sql(first: str, last: str) -> str:
    return f"array_to_string(list_transform(range(w), lambda i: CASE WHEN i >= {first} AND i < {last} THEN 1 ELSE 0 END), '')"


def _bits(mask: Column) -> Column:
    return F.array_join(mask.cast("array<int>").cast("array<string>"), "")


@query(f"WITH {PADDED}, n AS (SELECT path_id, w, {_REAL} AS n FROM padded) SELECT path_id, {_mask_sql('n // 3', 'n')} AS input, {_mask_sql('2 * n // 3', 'n')} AS prediction FROM n")
def mask_thirds(spark: SparkSession, d: str) -> DataFrame:
    i, p = A.thirds_mask(F.col("ids"))
    return padded(spark, d).select("path_id", _bits(i).alias("input"), _bits(p).alias("prediction"))


@query(f"WITH {PADDED}, n AS (SELECT path_id, w, {_REAL} AS n FROM padded) SELECT path_id, {_mask_sql('2 * n // 3', 'n')} AS input, {_mask_sql('n - 1', 'n')} AS prediction FROM n")
def mask_last(spark: SparkSession, d: str) -> DataFrame:
    i, p = A.last_token_mask(F.col("ids"))
    return padded(spark, d).select("path_id", _bits(i).alias("input"), _bits(p).alias("prediction"))


@query()
def mask_random_token(spark: SparkSession, d: str) -> DataFrame:
    i, p = A.random_token_mask(F.col("ids"), F.col("path_id"))
    return padded(spark, d).select("path_id", _bits(i).alias("input"), _bits(p).alias("prediction"))


@query()
def mask_random_block(spark: SparkSession, d: str) -> DataFrame:
    i, p = A.random_block_mask(F.col("ids"), F.col("path_id"), 8)
    return padded(spark, d).select("path_id", _bits(i).alias("input"), _bits(p).alias("prediction"))


_RULE = f"WITH {PADDED}, n AS (SELECT path_id, w, {_REAL} AS n FROM padded) SELECT path_id, "


@query(_RULE + "CASE WHEN n > 0 THEN 1 ELSE 0 END AS hidden, true AS same, true AS among_real FROM n")
def mask_random_token_rule(spark: SparkSession, d: str) -> DataFrame:
    """What holds of any random token mask: one place among the real ones, hidden and asked for."""
    i, p = A.random_token_mask(F.col("ids"), F.col("path_id"))
    r = padded(spark, d).select("path_id", i.alias("i"), (i == p).alias("same"), A.real_length(F.col("ids")).alias("n"))
    return r.select("path_id", F.size(F.array_remove("i", F.lit(False))).alias("hidden"), "same", (F.array_position("i", True) <= F.col("n")).alias("among_real"))


@query(_RULE + "least(8, w) AS hidden, true AS same, true AS in_a_row FROM n")
def mask_random_block_rule(spark: SparkSession, d: str) -> DataFrame:
    """What holds of any random block mask: eight places in a row, hidden and asked for."""
    i, p = A.random_block_mask(F.col("ids"), F.col("path_id"), 8)
    r = padded(spark, d).select("path_id", i.alias("i"), (i == p).alias("same"))
    hidden = F.size(F.array_remove("i", F.lit(False)))
    run = F.slice("i", F.greatest(F.array_position("i", True), F.lit(1)).cast("int"), hidden)
    return r.select("path_id", hidden.cast("long").alias("hidden"), "same", (F.size(F.array_remove(run, F.lit(False))) == hidden).alias("in_a_row"))


@query(f"WITH {PADDED}, n AS (SELECT path_id, ids, {_REAL} AS n FROM padded) SELECT path_id, array_to_string(list_transform(ids, lambda x, i: CASE WHEN i - 1 >= n // 3 AND i - 1 < n THEN 2 ELSE x END), ' ') AS ids FROM n")
def apply_mask(spark: SparkSession, d: str) -> DataFrame:
    i, _ = A.thirds_mask(F.col("ids"))
    return padded(spark, d).select("path_id", A.joined(A.apply_mask(F.col("ids"), i)).alias("ids"))


@query(f"WITH {IDS} SELECT path_id, {_TEXT.format(x='list_append(ids, 2)')} AS ids FROM enc")
def append_mask(spark: SparkSession, d: str) -> DataFrame:
    return encoded(spark, d).select("path_id", A.joined(F.array_append("ids", A.MASK)).alias("ids"))


@query(f"WITH {PADDED}, s AS (SELECT unnest(ids) AS x FROM padded) SELECT coalesce(min(x) FILTER (WHERE x <> 0), 0) AS low, CASE WHEN max(x) FILTER (WHERE x <> 0) IS NULL THEN 1 WHEN min(x) FILTER (WHERE x <> 0) = max(x) FILTER (WHERE x <> 0) THEN max(x) FILTER (WHERE x <> 0) + 1 ELSE max(x) FILTER (WHERE x <> 0) END AS high FROM s")
def nonpad_range(spark: SparkSession, d: str) -> DataFrame:
    """Least and greatest id that is no padding; a range of one value is widened, none is (0, 1)."""
    p = padded(spark, d).select(F.array_min(F.filter("ids", lambda x: x != 0)).alias("a"), F.array_max(F.filter("ids", lambda x: x != 0)).alias("b"))
    a, b = F.min("a"), F.max("b")
    return p.agg(F.coalesce(a, F.lit(0)).alias("low"), F.when(b.isNull(), 1).when(a == b, b + 1).otherwise(b).alias("high"))


_ENTROPY = f"""WITH {PADDED}, t AS (SELECT path_id, x FROM (SELECT path_id, unnest(ids) AS x FROM padded) WHERE x <> 0),
c AS (SELECT path_id, x, count(*)::DOUBLE AS c FROM t GROUP BY ALL), n AS (SELECT path_id, sum(c) AS n FROM c GROUP BY path_id),
e AS (SELECT path_id, round(abs(sum(c / n * log2(c / n))), 6) AS entropy FROM c JOIN n USING (path_id) GROUP BY path_id)"""


def _entropies(spark: SparkSession, d: str) -> DataFrame:
    return path_entropy(padded(spark, d).select("path_id", F.filter("ids", lambda x: x != 0).alias("ids")), "path_id", "ids")


@query(f"{_ENTROPY} SELECT path_id, entropy FROM e")
def entropy_nopad(spark: SparkSession, d: str) -> DataFrame:
    return _entropies(spark, d).select("path_id", "entropy")


@query(f"{_ENTROPY} SELECT CASE WHEN entropy >= 2.5 THEN 'high' WHEN entropy >= 1.0 THEN 'medium' ELSE 'low' END AS band, count(*) AS paths FROM e GROUP BY 1")
def entropy_band(spark: SparkSession, d: str) -> DataFrame:
    e = F.col("entropy")
    return _entropies(spark, d).groupBy(F.when(e >= 2.5, "high").when(e >= 1.0, "medium").otherwise("low").alias("band")).agg(F.count("*").alias("paths"))


@query(f"WITH {CORPUS} SELECT file, func_addr, count(*) AS paths, string_agg(CAST(path_id AS VARCHAR), ' ' ORDER BY path_id) AS ids FROM corpus GROUP BY file, func_addr")
def group_paths(spark: SparkSession, d: str) -> DataFrame:
    g = corpus(spark, d).select("file", "func_addr", "path_id").groupBy("file", "func_addr").agg(F.count("*").alias("paths"), F.array_sort(F.collect_list("path_id")).alias("v"))
    return g.select("file", "func_addr", "paths", A.joined(F.col("v")).alias("ids"))


@query(f"""WITH {IDS}, r AS (SELECT file, func_addr, list_resize(ids[1:64], 64, 0) AS ids, row_number() OVER (PARTITION BY file, func_addr ORDER BY path_id) AS rn FROM enc),
k AS (SELECT file, func_addr, count(*) AS n, string_agg(array_to_string(ids, ' '), ' ' ORDER BY rn) AS t FROM r WHERE rn <= 16 GROUP BY file, func_addr)
SELECT file, func_addr, n AS paths, md5(t || repeat(' 0', CAST((16 - n) * 64 AS INTEGER))) AS tensor FROM k""")
def func_tensor(spark: SparkSession, d: str) -> DataFrame:
    """16 x 64 ids per function: its first 16 paths, and padding; shown as a hash of the numbers."""
    rn = F.row_number().over(Window.partitionBy("file", "func_addr").orderBy("path_id"))
    c = encoded(spark, d).select("file", "func_addr", "path_id", A.pad_truncate(F.col("ids"), 64).alias("ids")).withColumn("rn", rn).filter("rn <= 16")
    g = c.groupBy("file", "func_addr").agg(F.count("*").alias("paths"), F.array_sort(F.collect_list(F.struct("rn", "ids"))).alias("v"))
    rows = F.concat(F.transform("v", lambda e: e["ids"]), F.array_repeat(F.array_repeat(F.lit(A.PAD), 64), F.lit(16) - F.col("paths").cast("int")))
    return g.select("file", "func_addr", "paths", F.md5(A.joined(F.flatten(rows))).alias("tensor"))


@query(f"WITH {CORPUS} SELECT path_id, array_to_string(CASE WHEN len(tokens) <= 8 THEN tokens ELSE list_append(tokens[1:7], '…+' || (len(tokens) - 7)) END, ' ') AS shown FROM corpus")
def node_overflow(spark: SparkSession, d: str) -> DataFrame:
    return corpus(spark, d).select("path_id", F.array_join(A.overflow(F.col("tokens"), 8), " ").alias("shown"))


@query(f"""WITH {CORPUS}, f AS (SELECT file, func_addr, count(*) AS n, min(len(tokens)) AS least FROM corpus WHERE func_addr IS NOT NULL GROUP BY ALL),
t AS (SELECT c.file, c.func_addr, unnest(c.tokens) AS token, generate_subscripts(c.tokens, 1) AS pos FROM corpus c),
x AS (SELECT t.file, t.func_addr, t.pos FROM t JOIN f ON t.file = f.file AND t.func_addr = f.func_addr AND t.pos <= f.least WHERE f.n > 1 GROUP BY ALL HAVING count(DISTINCT token) > 1),
m AS (SELECT file, func_addr, min(pos) AS first FROM x GROUP BY ALL)
SELECT c.path_id, greatest(coalesce(m.first - 1 - 6, 0), 0) AS trimmed, array_to_string(c.tokens[greatest(coalesce(m.first - 1 - 6, 0), 0) + 1:greatest(coalesce(m.first - 1 - 6, 0), 0) + 12], ' ') AS head
FROM corpus c LEFT JOIN m ON c.file = m.file AND c.func_addr = m.func_addr WHERE c.func_addr IS NOT NULL""")
def trim_prefix(spark: SparkSession, d: str) -> DataFrame:
    """Paths of a function without what they begin with in common, but for six tokens."""
    c = corpus(spark, d).filter("func_addr IS NOT NULL")
    t = trim_common_prefix(c, ["file", "func_addr"], "tokens", 6)
    return t.select("path_id", F.col("trimmed").cast("long").alias("trimmed"), F.array_join(F.slice("tokens", F.col("trimmed") + 1, 12), " ").alias("head"))


_BAND = f"""WITH {IDS}, o AS (SELECT path_id, ids, row_number() OVER (ORDER BY path_id) - 1 AS i FROM enc WHERE len(ids) > 0),
b AS (SELECT a.path_id AS a, c.path_id AS b, a.ids AS x, c.ids AS y FROM o a JOIN o c ON c.i >= a.i AND c.i < a.i + 10),
u AS (SELECT a, b, list_sum(list_transform(range(1, greatest(len(x), len(y)) + 1), lambda i: CASE WHEN x[i] IS DISTINCT FROM y[i] THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END)) / greatest(len(x), len(y)) AS u FROM b)"""


@query(f"{_BAND} SELECT a, b FROM u")
def banded_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Each path with itself and the nine after it."""
    full = records(spark, d, "size(tokens) AS n").filter("n > 0 AND path_id IS NOT NULL").select("path_id")
    return banded_join(full, "path_id", 10)


def is_selected(u: np.ndarray) -> np.ndarray:
    """Pairs that are alike without being equal, or hardly alike."""
    return ((u > 0) & (u < 0.40)) | (u >= 0.90)


@query(f"{_BAND} SELECT a, b, round(u, 6) AS unlikeness FROM u WHERE (u > 0 AND u < 0.40) OR u >= 0.90")
def unlike_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Neighbours that are alike without being equal, or hardly alike."""

    def compare(keys: np.ndarray, values: np.ndarray, starts: np.ndarray, a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
        u = unlikeness(values, starts, a, b)
        keep = is_selected(u)
        return pa.RecordBatch.from_arrays([pa.array(keys[a[keep]]), pa.array(keys[b[keep]]), pa.array(np.round(u[keep], 6))], names=["a", "b", "unlikeness"])

    return banded_comparison(encoded(spark, d).filter("size(ids) > 0 AND path_id IS NOT NULL"), "path_id", "ids", 10, compare, "a long, b long, unlikeness double")


@query("""SELECT l_orderkey, count(*) AS n, string_agg(l_returnflag || l_linestatus, ' ' ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_shipdate, l_returnflag, l_linestatus) AS tokens FROM lineitem GROUP BY l_orderkey""")
def path_tokens(spark: SparkSession, d: str) -> DataFrame:
    """Block tokens along a path, here the lines of an order: lists in order, made flat."""
    keys = ("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_shipdate", "l_returnflag", "l_linestatus")
    t = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("n"), F.array_sort(F.collect_list(F.struct(*keys))).alias("v"))
    blocks = F.transform("v", lambda e: F.array(F.concat(e["l_returnflag"], e["l_linestatus"])))
    return t.select("l_orderkey", "n", F.array_join(F.flatten(blocks), " ").alias("tokens"))
