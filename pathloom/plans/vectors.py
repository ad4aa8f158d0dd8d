"""Queries on embeddings.  Searches take as queries every vector whose id is divisible by 20; linkage and statistics are over all pairs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import vectors as V
from ..functions.tokens import parse_label
from ..operators import similarity as S
from ..sources.tables import table
from ..sources.views import vectors
from .registry import query
from .views_sql import VECTORS

_COS = "list_dot_product(a.emb, b.emb) / (greatest(sqrt(list_dot_product(a.emb, a.emb)), 1e-8) * greatest(sqrt(list_dot_product(b.emb, b.emb)), 1e-8))"
_PAIRS = f"WITH {VECTORS}, p AS (SELECT a.path_id AS a, b.path_id AS b, a.func AS fa, b.func AS fb, {_COS} AS s, list_dot_product(a.emb, b.emb) AS dot, list_distance(a.emb, b.emb) AS dist FROM vec a JOIN vec b ON a.path_id % 20 = 0)"
_ALL = _PAIRS.replace("ON a.path_id % 20 = 0", "ON true")


def _asked():  # noqa: ANN202
    return F.col("path_id") % 20 == 0


@query(f"WITH {VECTORS} SELECT path_id, round(sqrt(list_dot_product(emb, emb)), 6) AS norm, round(list_dot_product(emb, list_reverse(emb)), 6) AS dot_reversed, round(list_distance(emb, list_reverse(emb)), 6) AS distance_reversed, round(list_cosine_similarity(emb, list_reverse(emb)), 6) AS cosine_reversed FROM vec")
def vector_metrics(spark: SparkSession, d: str) -> DataFrame:
    """Length, and inner product, distance and cosine with the vector read backwards."""
    e, r = F.col("emb"), F.reverse("emb")
    return vectors(spark, d).select("path_id", F.round(V.norm(e), 6).alias("norm"), F.round(V.dot(e, r), 6).alias("dot_reversed"), F.round(V.distance(e, r), 6).alias("distance_reversed"), F.round(V.cosine(e, r), 6).alias("cosine_reversed"))


@query(f"WITH {VECTORS}, u AS (SELECT path_id, list_transform(emb, lambda x: x / sqrt(list_dot_product(emb, emb))) AS u FROM vec) SELECT path_id, round(u[1], 6) AS first, round(list_dot_product(u, u), 6) AS length FROM u")
def l2_normalize(spark: SparkSession, d: str) -> DataFrame:
    u = vectors(spark, d).select("path_id", V.l2_normalize(F.col("emb")).alias("u"))
    return u.select("path_id", F.round(F.element_at("u", 1), 6).alias("first"), F.round(V.dot(F.col("u"), F.col("u")), 6).alias("length"))


@query(f"{_PAIRS} SELECT a, b, round(s, 6) AS similarity, fa = fb AS same_group FROM p WHERE a <> b")
def pairwise_cosine(spark: SparkSession, d: str) -> DataFrame:
    p = S.cosine_pairs(vectors(spark, d), "path_id", "func", "emb", _asked(), -2.0)
    return p.select("a", "b", F.round("similarity", 6).alias("similarity"), "same_group")


@query(f"{_PAIRS}, r AS (SELECT a, b, round(s, 6) AS similarity, fa = fb AS is_positive, row_number() OVER (PARTITION BY fa = fb ORDER BY round(s, 6) DESC, a, b) AS rank FROM p WHERE a <> b) SELECT * FROM r WHERE rank <= 50")
def pair_ranking(spark: SparkSession, d: str) -> DataFrame:
    """The 50 most similar pairs of one group and of two."""
    from pyspark.sql import Window

    p = S.cosine_pairs(vectors(spark, d), "path_id", "func", "emb", _asked(), -2.0)
    p = p.select("a", "b", F.round("similarity", 6).alias("similarity"), F.col("same_group").alias("is_positive"))
    rank = F.row_number().over(Window.partitionBy("is_positive").orderBy(F.col("similarity").desc(), "a", "b"))
    return p.withColumn("rank", rank.cast("long")).filter("rank <= 50")


@query(f"{_ALL} SELECT fa = fb AS is_positive, count(*) AS n, round(avg(s), 6) AS mean, round(stddev_samp(s), 6) AS std, round(min(s), 6) AS low, round(max(s), 6) AS high FROM p WHERE a <> b GROUP BY 1")
def similarity_stats(spark: SparkSession, d: str) -> DataFrame:
    return S.similarity_stats(vectors(spark, d), "path_id", "func", "emb")


_LINKED = f"{_ALL} SELECT fa AS f1, fb AS f2, round(least(1.0, min(dist)), 5) AS distance, round(greatest(0.0, max(dot)), 5) AS inner_product FROM p"


@query(f"{_LINKED} GROUP BY 1, 2")
def func_linkage(spark: SparkSession, d: str) -> DataFrame:
    return S.linkage(vectors(spark, d), "path_id", "func", "emb")


@query(f"{_LINKED} WHERE fa IN (1, 2) AND fb IN (1, 2) GROUP BY 1, 2")
def compare_functions(spark: SparkSession, d: str) -> DataFrame:
    """Two chosen functions."""
    return S.linkage(vectors(spark, d).filter(F.col("func").isin(1, 2)), "path_id", "func", "emb")


_NAMES = range(10)


@query(f"{_LINKED} GROUP BY 1, 2".replace(f"{_ALL} SELECT", f"{_ALL}, m AS (SELECT", 1) + ") SELECT f2, " + ", ".join(f'max(distance) FILTER (WHERE f1 = {n}) AS "{n}"' for n in _NAMES) + " FROM m GROUP BY f2")
def func_matrix(spark: SparkSession, d: str) -> DataFrame:
    """The proximity matrix of functions: a row per function, a column per function."""
    return S.linkage(vectors(spark, d), "path_id", "func", "emb").groupBy("f2").pivot("f1", list(_NAMES)).agg(F.max("distance"))


_DIMS = f"WITH {VECTORS}, x AS (SELECT func, path_id, unnest(emb) AS v, generate_subscripts(emb, 1) AS pos FROM vec)"


def _dims(spark: SparkSession, d: str) -> DataFrame:
    return vectors(spark, d).select("func", "path_id", F.posexplode("emb").alias("pos", "v")).select("func", "path_id", (F.col("pos") + 1).cast("long").alias("pos"), F.col("v").cast("double").alias("v"))


@query(f"{_DIMS} SELECT func, pos, round(avg(v), 6) AS mean FROM x GROUP BY func, pos")
def func_embedding(spark: SparkSession, d: str) -> DataFrame:
    """The mean vector of every function, by dimension."""
    return _dims(spark, d).groupBy("func", "pos").agg(F.round(F.avg("v"), 6).alias("mean"))


@query(f"{_DIMS} SELECT func, pos, round(max(v), 6) AS top FROM x GROUP BY func, pos")
def maxpool_func(spark: SparkSession, d: str) -> DataFrame:
    return _dims(spark, d).groupBy("func", "pos").agg(F.round(F.max("v"), 6).alias("top"))


@query(f"{_DIMS} SELECT path_id, (pos - 1) % 16 AS dim, round(avg(v), 6) AS mean FROM x GROUP BY ALL")
def chunk_meanpool(spark: SparkSession, d: str) -> DataFrame:
    """A flat sequence of 16-dimensional steps as the mean of its steps."""
    p = vectors(spark, d).select("path_id", F.posexplode(V.chunk_mean(F.col("emb"), 16)).alias("dim", "m"))
    return p.select("path_id", F.col("dim").cast("long").alias("dim"), F.round("m", 6).alias("mean"))


@query(f"WITH {VECTORS}, t AS (SELECT path_id, emb, list_transform(emb, lambda x, i: CASE WHEN i <= 40 THEN x ELSE 0.0 END) AS cut FROM vec) SELECT path_id, round(list_distance(emb, cut), 6) AS distance, round(list_dot_product(emb, cut), 6) AS dot FROM t")
def padded_distance(spark: SparkSession, d: str) -> DataFrame:
    """Vectors of two lengths, the shorter filled with zeros."""
    e, cut = F.col("emb"), F.slice("emb", 1, 40)
    return vectors(spark, d).select("path_id", F.round(V.distance(e, cut), 6).alias("distance"), F.round(V.dot(e, cut), 6).alias("dot"))


@query(f"{_DIMS} SELECT func, round(avg(CASE WHEN abs(8 * v) < 1 THEN 0.5 * 64 * v * v ELSE abs(8 * v) - 0.5 END), 6) AS loss FROM x WHERE pos > 32 GROUP BY func")
def smooth_l1(spark: SparkSession, d: str) -> DataFrame:
    """Smooth L1 loss of eightfold differences from zero, over the places of a mask."""
    x = F.abs(F.col("v") * 8)
    return _dims(spark, d).filter("pos > 32").groupBy("func").agg(F.round(F.avg(F.when(x < 1, 0.5 * x * x).otherwise(x - 0.5)), 6).alias("loss"))


@query("""WITH s AS (SELECT DISTINCT regexp_replace(trim(regexp_extract(file_name, '[^/]*$'), e' \\t\\n\\r'), '\\.jsonl$', '') AS label FROM paths),
b AS (SELECT regexp_replace(label, '\\.elf$', '') AS label, count(*) AS builds FROM binary_records WHERE regexp_matches(label, '^.+_(gcc|clang)_O[0-9s](\\.elf)?$') GROUP BY 1)
SELECT s.label, coalesce(b.builds, 0) AS builds FROM s LEFT JOIN b ON s.label = b.label""")
def left_lookup(spark: SparkSession, d: str) -> DataFrame:
    """Shards with the builds of their label, if there are any."""
    s = table(spark, d, "paths").select(F.regexp_replace(F.btrim(F.substring_index("file_name", "/", -1), F.lit(" \t\n\r")), r"\.jsonl$", "").alias("label")).distinct()
    b = table(spark, d, "binary_records").filter(parse_label(F.col("label")).isNotNull() & ~F.col("label").endswith(".json"))
    b = b.groupBy(F.regexp_replace("label", r"\.elf$", "").alias("label")).agg(F.count("*").alias("builds"))
    return s.join(b, "label", "left").select("label", F.coalesce("builds", F.lit(0)).cast("long").alias("builds"))


@query("""WITH c AS (SELECT trim(regexp_extract(file_name, '[^/]*$'), e' \\t\\n\\r') AS file, '0x' || ltrim(regexp_replace(lower(trim(func_addr)), '^0x', ''), '0') AS func_addr, count(DISTINCT path_id) AS n FROM paths WHERE func_addr IS NOT NULL GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY file ORDER BY n DESC, func_addr) AS rn FROM c)
SELECT f.file, coalesce(m.func_addr, r.func_addr) AS func_addr, m.func_addr IS NOT NULL AS is_main FROM (SELECT DISTINCT file FROM c) f JOIN r ON f.file = r.file AND r.rn = 1
LEFT JOIN (SELECT DISTINCT file, func_addr FROM c WHERE func_addr = '0x401000') m ON f.file = m.file""")
def representative_func(spark: SparkSession, d: str) -> DataFrame:
    """The function that stands for a file: that at the main address if it is there, else the one with most paths."""
    from ..sources.views import records

    c = records(spark, d).filter("func_addr IS NOT NULL").groupBy("file", "func_addr").agg(F.count("*").alias("n"))
    best = c.groupBy("file").agg(F.min_by("func_addr", F.struct(-F.col("n"), "func_addr")).alias("most"), F.max(F.when(F.col("func_addr") == "0x401000", F.col("func_addr"))).alias("main"))
    return best.select("file", F.coalesce("main", "most").alias("func_addr"), F.col("main").isNotNull().alias("is_main"))


@query(f"""{_PAIRS}, r AS (SELECT a, fa = fb AS same, row_number() OVER (PARTITION BY a ORDER BY round(s, 9) DESC, b) AS rank FROM p WHERE a <> b),
f AS (SELECT a, min(rank) FILTER (WHERE same) AS first FROM r GROUP BY a)
SELECT count(*) AS queries, round(avg(coalesce(1.0::DOUBLE / first, 0)), 6) AS mrr, round(avg(CASE WHEN first <= 1 THEN 1.0 ELSE 0.0 END), 6) AS hit_at_1, round(avg(CASE WHEN first <= 10 THEN 1.0 ELSE 0.0 END), 6) AS hit_at_10 FROM f""")
def retrieval_metrics(spark: SparkSession, d: str) -> DataFrame:
    """How early a vector of the same function is found: mean reciprocal rank, and hits within one and ten."""
    first = S.first_of_group(vectors(spark, d), "path_id", "func", "emb", _asked())
    hit = lambda n: F.round(F.avg(F.when(F.col("first") <= n, 1.0).otherwise(0.0)), 6)
    return first.agg(F.count("*").alias("queries"), F.round(F.avg(F.coalesce(1.0 / F.col("first"), F.lit(0.0))), 6).alias("mrr"), hit(1).alias("hit_at_1"), hit(10).alias("hit_at_10"))
