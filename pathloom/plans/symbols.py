"""Queries on tokens as symbols: categories, names, colours, canonical forms, labels, addresses."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import tokens as K
from ..operators.vocabulary import token_freq
from ..sources.tables import table
from ..sources.views import corpus
from .registry import query
from .views_sql import FREQ


def _case(column: str, values: dict[str, str], otherwise: str) -> str:
    return "CASE " + " ".join(f"WHEN {column} = '{k}' THEN '{v}'" for k, v in values.items()) + f" ELSE {otherwise} END"


CATEGORY_SQL = _case("token", K.CATEGORY_EXACT, "CASE " + " ".join(f"WHEN starts_with(token, '{p}') THEN '{c}'" for p, c in K.CATEGORY_PREFIXES) + " ELSE 'SPECIAL' END")
_FAMILY = "coalesce(" + ", ".join(f"nullif(regexp_extract(token, '{p}', 1), '')" for p in ("^VEX_OP_(.+)$", "^<API_(.+)>$", "^<SYSCALL_(.+)>$", "^JK_(.+)$", "^VEX_Ist_(.+)$")) + ")"
NAME_SQL = _case("token", K.SHORT_NAMES, f"coalesce({_FAMILY}[1:6], token[1:7])")

#: Operations as a lifter names them, made from the tokens of the corpus.
_OPS_SQL = "SELECT token, CASE WHEN starts_with(token, 'VEX_OP_') THEN 'Iop_' || token[8:] || '32' END AS op, CASE WHEN token = 'VEX_LOAD' THEN 'Iex_Load' WHEN token = 'VEX_CONST' THEN 'Iex_Const' WHEN token = 'VEX_REG_READ' THEN 'Iex_Get' WHEN starts_with(token, 'VEX_') THEN 'Iex_Binop' END AS tag FROM vocab"
_OP_SQL = "CASE WHEN op LIKE '%\\_%' ESCAPE '\\' THEN 'VEX_OP_' || upper(split_part(op, '_', 2)[1:3]) WHEN tag = 'Iex_Load' THEN 'VEX_LOAD' WHEN tag = 'Iex_Const' THEN 'VEX_CONST' WHEN tag = 'Iex_Get' THEN 'VEX_REG_READ' ELSE 'VEX_WrTmp' END"
_STMT_SQL = "CASE id % 6 WHEN 0 THEN 'Ist_WrTmp' WHEN 1 THEN 'Ist_Store' WHEN 2 THEN 'Ist_Put' WHEN 3 THEN 'Ist_Exit' WHEN 4 THEN 'Ist_IMark' ELSE 'Ist_Dirty' END"


@query(f"WITH {FREQ} SELECT token, {CATEGORY_SQL} AS category FROM freq")
def categorize(spark: SparkSession, d: str) -> DataFrame:
    return token_freq(corpus(spark, d)).select("token", K.categorize(F.col("token")).alias("category"))


@query(f"WITH {FREQ} SELECT token, {NAME_SQL} AS name FROM freq")
def display_name(spark: SparkSession, d: str) -> DataFrame:
    return token_freq(corpus(spark, d)).select("token", K.display_name(F.col("token")).alias("name"))


_COLOR = f"""WITH {FREQ}, c AS (SELECT token, {CATEGORY_SQL} AS k, CAST('0x' || md5(token)[1:8] AS BIGINT) AS h FROM freq),
v AS (SELECT token, CASE {" ".join(f"WHEN k = '{k}' THEN {v}::DOUBLE" for k, v in K.BASE_HUES.items())} END AS base, k, h FROM c),
l AS (SELECT token, base + ((h >> 16) % 9 - 4) * 0.01::DOUBLE AS hue,
  CASE k WHEN 'SPECIAL' THEN 0.13::DOUBLE + (h % 4) * 0.04::DOUBLE WHEN 'TEMP' THEN 0.38::DOUBLE + (h % 6) * 0.05::DOUBLE ELSE 0.42::DOUBLE + ((h >> 8) % 6) * 0.05::DOUBLE END AS light,
  CASE k WHEN 'SPECIAL' THEN 0.10::DOUBLE WHEN 'TEMP' THEN 0.28::DOUBLE + (h % 5) * 0.08::DOUBLE ELSE 0.60::DOUBLE + (h % 7) * 0.05::DOUBLE END AS sat FROM v),
m AS (SELECT token, hue - floor(hue) AS hue, light, CASE WHEN light <= 0.5 THEN light * (sat + 1) ELSE light + sat - light * sat END AS high FROM l),
x AS (SELECT token, 2 * light - high AS low, high, unnest([1 / 3::DOUBLE, 0.0::DOUBLE, -1 / 3::DOUBLE]) + hue AS t, unnest([1, 2, 3]) AS n FROM m),
y AS (SELECT token, n, low, high, t - floor(t) AS t FROM x),
r AS (SELECT token, n, CAST(floor(255 * CASE WHEN t < 1 / 6::DOUBLE THEN low + (high - low) * t * 6 WHEN t < 0.5 THEN high WHEN t < 2 / 3::DOUBLE THEN low + (high - low) * (2 / 3::DOUBLE - t) * 6 ELSE low END) AS INTEGER) AS v FROM y),
d AS (SELECT token, '#' || string_agg(lpad(lower(to_hex(v)), 2, '0'), '' ORDER BY n) AS color FROM r GROUP BY token)
SELECT token, {_case("token", K.TOKEN_COLORS, "color")} AS color FROM d"""


@query(_COLOR)
def token_color(spark: SparkSession, d: str) -> DataFrame:
    return token_freq(corpus(spark, d)).select("token", K.token_color(F.col("token")).alias("color"))


@query("SELECT token, " + _case("token", K.EDGE_COLORS, f"'{K.EDGE_DEFAULT}'") + " AS color FROM vocab WHERE starts_with(token, 'JK_')")
def edge_color(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "vocab").filter(F.col("token").startswith("JK_")).select("token", K.edge_color(F.col("token")).alias("color"))


def _ops(spark: SparkSession, d: str) -> DataFrame:
    t = F.col("token")
    op = F.when(t.startswith("VEX_OP_"), F.concat(F.lit("Iop_"), F.substring(t, F.lit(8), F.length(t)), F.lit("32")))
    tag = F.when(t == "VEX_LOAD", "Iex_Load").when(t == "VEX_CONST", "Iex_Const").when(t == "VEX_REG_READ", "Iex_Get").when(t.startswith("VEX_"), "Iex_Binop")
    return table(spark, d, "vocab").select("token", "id", op.alias("op"), tag.alias("tag"))


@query(f"SELECT token, {_OP_SQL} AS canon FROM ({_OPS_SQL})")
def canon_op(spark: SparkSession, d: str) -> DataFrame:
    return _ops(spark, d).select("token", K.canon_op(F.col("tag"), F.col("op")).alias("canon"))


@query(f"""SELECT id, CASE WHEN s = 'Ist_IMark' THEN NULL WHEN s = 'Ist_WrTmp' THEN {_OP_SQL} WHEN s = 'Ist_Store' THEN 'VEX_STORE' WHEN s = 'Ist_Put' THEN 'VEX_REG_WRITE'
WHEN s = 'Ist_Exit' THEN 'VEX_EXIT_COND' ELSE 'VEX_' || s END AS canon FROM (SELECT v.id, o.op, o.tag, {_STMT_SQL.replace("id %", "v.id %")} AS s FROM vocab v JOIN ({_OPS_SQL}) o ON v.token = o.token)""")
def canon_stmt(spark: SparkSession, d: str) -> DataFrame:
    """The vocabulary as statements of six kinds in turn."""
    kinds = F.array(*map(F.lit, ("Ist_WrTmp", "Ist_Store", "Ist_Put", "Ist_Exit", "Ist_IMark", "Ist_Dirty")))
    return _ops(spark, d).select("id", K.canon_stmt(F.get(kinds, F.col("id") % 6), F.col("tag"), F.col("op")).alias("canon"))


@query(f"""SELECT block, CASE WHEN block % 5 = 0 THEN '<UNLIFTABLE>' ELSE coalesce(string_agg(canon, ' ' ORDER BY id), '') END AS tokens FROM (SELECT id // 8 AS block, id, CASE WHEN s = 'Ist_IMark' THEN NULL WHEN s = 'Ist_WrTmp' THEN {_OP_SQL}
WHEN s = 'Ist_Store' THEN 'VEX_STORE' WHEN s = 'Ist_Put' THEN 'VEX_REG_WRITE' WHEN s = 'Ist_Exit' THEN 'VEX_EXIT_COND' ELSE 'VEX_' || s END AS canon FROM (SELECT v.id, o.op, o.tag, {_STMT_SQL.replace("id %", "v.id %")} AS s FROM vocab v JOIN ({_OPS_SQL}) o ON v.token = o.token)) GROUP BY block""")
def canon_block(spark: SparkSession, d: str) -> DataFrame:
    """The vocabulary as blocks of eight statements, each fifth of which could not be lifted."""
    kinds = F.array(*map(F.lit, ("Ist_WrTmp", "Ist_Store", "Ist_Put", "Ist_Exit", "Ist_IMark", "Ist_Dirty")))
    s = _ops(spark, d).select(F.floor(F.col("id") / 8).cast("int").alias("block"), F.struct("id", F.get(kinds, F.col("id") % 6).alias("tag"), F.col("tag").alias("data_tag"), "op").alias("s"))
    b = s.groupBy("block").agg(F.array_sort(F.collect_list("s")).alias("v"))
    return b.select("block", F.array_join(K.canon_block(F.col("v"), F.col("block") % 5 != 0), " ").alias("tokens"))


_API = "CASE WHEN id % 3 = 0 THEN '<API_' || upper(split_part(name, '@', 1)) || '>' WHEN id % 3 = 1 THEN '<SYSCALL_' || upper(name) || '>' END"
_API_ROWS = "SELECT id, lower(regexp_extract(token, '^<(?:API|SYSCALL)_(.+)>$', 1)) || '@plt' AS name FROM vocab WHERE starts_with(token, '<API_') OR starts_with(token, '<SYSCALL_')"


def _functions(spark: SparkSession, d: str) -> DataFrame:
    v = table(spark, d, "vocab").filter(F.col("token").startswith("<API_") | F.col("token").startswith("<SYSCALL_"))
    kind = F.when(F.col("id") % 3 == 0, "plt").when(F.col("id") % 3 == 1, "syscall").otherwise("plain")
    return v.select("id", F.concat(F.lower(F.regexp_extract("token", "^<(?:API|SYSCALL)_(.+)>$", 1)), F.lit("@plt")).alias("name"), kind.alias("kind"))


@query(f"SELECT id, {_API} AS canon FROM ({_API_ROWS})")
def canon_api(spark: SparkSession, d: str) -> DataFrame:
    return _functions(spark, d).select("id", K.canon_api(F.col("name"), F.col("kind")).alias("canon"))


@query(f"SELECT id, coalesce({_API}, 'JK_' || upper(replace(CASE WHEN id % 2 = 0 THEN 'Ijk_Boring' ELSE 'Ijk_Ret' END, 'Ijk_', ''))) AS canon FROM ({_API_ROWS})")
def canon_jump(spark: SparkSession, d: str) -> DataFrame:
    f = _functions(spark, d)
    jump = F.when(F.col("id") % 2 == 0, "Ijk_Boring").otherwise("Ijk_Ret")
    return f.select("id", K.canon_jump(jump, K.canon_api(F.col("name"), F.col("kind"))).alias("canon"))


_LABEL = "'^(.+)_(gcc|clang)_(O[0-9s])(?:\\.elf)?(?:-embeddings\\.json)?$'"


@query(f"SELECT record_id, regexp_extract(label, {_LABEL}, 1) AS util, regexp_extract(label, {_LABEL}, 2) AS compiler, regexp_extract(label, {_LABEL}, 3) AS opt FROM binary_records WHERE regexp_matches(label, {_LABEL})")
def parse_label(spark: SparkSession, d: str) -> DataFrame:
    r = table(spark, d, "binary_records").select("record_id", K.parse_label(F.col("label")).alias("p"))
    return r.filter("p IS NOT NULL").select("record_id", "p.util", "p.compiler", "p.opt")


@query("SELECT DISTINCT regexp_replace(regexp_extract(trim(file_name), '[^/]*$'), '(-embeddings)?\\.(jsonl|json|elf)$', '') AS label FROM paths")
def make_label(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "paths").select(K.make_label(F.col("file_name")).alias("label")).distinct()


@query("SELECT user_id, '0x' || lower(to_hex(user_id)) AS addr, user_id AS back FROM (SELECT DISTINCT user_id FROM events)")
def addr_hex(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").select("user_id").distinct().withColumn("addr", K.addr_hex(F.col("user_id")))
    return e.withColumn("back", K.addr_number(F.col("addr")))
