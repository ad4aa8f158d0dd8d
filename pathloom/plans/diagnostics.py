"""Queries on the corpus as a whole: volume, repeats, entropy, lengths, shares."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.tokens import JUMPS, STRUCTURAL, categorize
from ..operators import corpus as C
from ..operators.vocabulary import SPECIALS, build_vocab, token_freq as freq_of
from ..sources.shared import written
from ..sources.views import corpus, records
from .registry import query
from .symbols import CATEGORY_SQL
from .views_sql import CORPUS, FREQ, VOCAB

_STRUCTURAL = ", ".join(f"'{t}'" for t in STRUCTURAL)
_JUMPS = ", ".join(f"'{t}'" for t in JUMPS)
_HASH = "md5(array_to_string(tokens, chr(0)) || chr(0))"
_H = "md5(concat(array_join(tokens, char(0)), char(0))) AS h"
PERCENTS = (0, 10, 25, 50, 75, 90, 99, 100)


def _rounded(x: Column, digits: int) -> Column:
    """``x`` rounded as the SQL does it, by a product in floating point; ``F.round`` takes the decimal digits of ``x``."""
    return F.round(x * 10.0**digits) / 10.0**digits


@query(f"WITH {FREQ} SELECT token, freq FROM freq")
def token_freq(spark: SparkSession, d: str) -> DataFrame:
    return freq_of(corpus(spark, d))


@query(f"WITH {VOCAB} SELECT token, id, freq FROM voc")
def vocab(spark: SparkSession, d: str) -> DataFrame:
    return build_vocab(freq_of(corpus(spark, d)))


@query(f"WITH {FREQ} SELECT count(*) FILTER (WHERE freq >= 2 AND token NOT IN ('<PAD>', '<UNK>', '<MASK>')) AS kept, count(*) FILTER (WHERE freq < 2) AS dropped, count(*) AS total, CAST(sum(freq) AS BIGINT) AS tokens FROM freq")
def vocab_stats(spark: SparkSession, d: str) -> DataFrame:
    f = freq_of(corpus(spark, d))
    kept = (F.col("freq") >= 2) & ~F.col("token").isin(*SPECIALS)
    return f.agg(F.count_if(kept).alias("kept"), F.count_if(F.col("freq") < 2).alias("dropped"), F.count("*").alias("total"), F.sum("freq").alias("tokens"))


@query(f"WITH {FREQ} SELECT (SELECT count(DISTINCT file) FROM corpus) AS files, (SELECT count(DISTINCT (file, coalesce(func_addr, '?'))) FROM corpus) AS functions, (SELECT count(*) FROM corpus) AS paths, (SELECT CAST(sum(len(tokens)) AS BIGINT) FROM corpus) AS tokens, (SELECT count(*) FROM freq) AS distinct_tokens")
def corpus_volume(spark: SparkSession, d: str) -> DataFrame:
    distinct = freq_of(corpus(spark, d)).agg(F.count("*")).scalar()
    return C.volume(records(spark, d, "size(tokens) AS n")).withColumn("distinct_tokens", distinct)


@query(f"WITH {CORPUS} SELECT count(*) AS paths, count(DISTINCT {_HASH}) AS unique_paths, round((1 - count(DISTINCT {_HASH})::DOUBLE / count(*)) * 100, 6) AS dup_pct FROM corpus WHERE len(tokens) > 0")
def dup_paths(spark: SparkSession, d: str) -> DataFrame:
    return C.duplicates(records(spark, d, _H, "size(tokens) AS n").filter("n > 0"))


@query(f"WITH {CORPUS} SELECT DISTINCT {_HASH} AS h FROM corpus WHERE len(tokens) > 0")
def distinct_paths(spark: SparkSession, d: str) -> DataFrame:
    return records(spark, d, _H, "size(tokens) AS n").filter("n > 0").select("h").distinct()


@query(f"WITH {CORPUS} SELECT file, coalesce(func_addr, '?') AS func_addr, count(*) AS paths, count(DISTINCT {_HASH}) AS unique_paths, round(count(DISTINCT {_HASH})::DOUBLE / count(*), 6) AS ratio FROM corpus WHERE len(tokens) > 0 GROUP BY ALL")
def func_diversity(spark: SparkSession, d: str) -> DataFrame:
    return C.diversity(records(spark, d, _H, "size(tokens) AS n").filter("n > 0"))


@query(f"""WITH {CORPUS}, f AS (SELECT count(DISTINCT {_HASH})::DOUBLE / count(*) AS ratio FROM corpus WHERE len(tokens) > 0 GROUP BY file, coalesce(func_addr, '?'))
SELECT count(*) AS functions, count(*) FILTER (WHERE ratio <= 0.01) AS nearly_constant, count(*) FILTER (WHERE ratio < 0.5) AS under_half, count(*) FILTER (WHERE ratio = 1.0) AS all_unique FROM f""")
def diversity_buckets(spark: SparkSession, d: str) -> DataFrame:
    r = F.col("unique_paths") / F.col("paths")
    return C.diversity(records(spark, d, _H, "size(tokens) AS n").filter("n > 0")).agg(
        F.count("*").alias("functions"), F.count_if(r <= 0.01).alias("nearly_constant"), F.count_if(r < 0.5).alias("under_half"), F.count_if(r == 1.0).alias("all_unique")
    )


@query(f"""WITH {FREQ}, s AS (SELECT CAST(sum(freq) AS DOUBLE) AS n, count(*)::DOUBLE AS v FROM freq),
e AS (SELECT -sum(freq / n * log2(freq / n)) AS h, log2(any_value(v)) AS m FROM freq, s)
SELECT round(h, 6) AS entropy, round(m, 6) AS max_entropy, round(h / m * 100, 6) AS utilisation FROM e""")
def entropy_global(spark: SparkSession, d: str) -> DataFrame:
    return C.entropy(freq_of(corpus(spark, d)))


_ENTROPY_SQL = """, c AS (SELECT path_id, {x} AS x, count(*)::DOUBLE AS c FROM {t} GROUP BY ALL), n AS (SELECT path_id, sum(c) AS n FROM c GROUP BY path_id)
SELECT path_id, round(abs(sum(c / n * log2(c / n))), 6) AS entropy, CAST(any_value(n) AS BIGINT) AS n FROM c JOIN n USING (path_id) GROUP BY path_id"""


@query(f"WITH {CORPUS}, t AS (SELECT path_id, unnest(tokens) AS tok FROM corpus)" + _ENTROPY_SQL.format(x="tok", t="t"))
def entropy_per_path(spark: SparkSession, d: str) -> DataFrame:
    return C.path_entropy(corpus(spark, d), "path_id", "tokens")


@query(f"""WITH {CORPUS}, l AS (SELECT len(tokens) AS n, row_number() OVER (ORDER BY len(tokens)) AS rn, count(*) OVER () AS c FROM corpus WHERE len(tokens) > 0)
SELECT CAST(p AS INTEGER) AS p, n AS value FROM l, (SELECT unnest([{", ".join(map(str, PERCENTS))}]) AS p) WHERE rn = floor(p / 100.0::DOUBLE * (c - 1)) + 1""")
def length_percentiles(spark: SparkSession, d: str) -> DataFrame:
    return C.nearest_rank(records(spark, d, "size(tokens) AS n").filter("n > 0"), "n", PERCENTS)


@query(f"""WITH {CORPUS}, s AS (SELECT CAST(sum(len(list_filter(tokens, lambda t: t IN ({_STRUCTURAL})))) AS BIGINT) AS structural, CAST(sum(len(tokens)) AS BIGINT) AS tokens FROM corpus)
SELECT structural, tokens - structural AS semantic, round(structural * 100.0::DOUBLE / tokens, 6) AS structural_pct FROM s""")
def structural_ratio(spark: SparkSession, d: str) -> DataFrame:
    r = records(spark, d, f"size(filter(tokens, t -> t IN ({_STRUCTURAL}))) AS s", "size(tokens) AS n")
    s, n = F.sum("s"), F.sum("n")
    return r.agg(s.alias("structural"), (n - s).alias("semantic"), F.round(s * 100.0 / n, 6).alias("structural_pct"))


@query(f"""WITH {CORPUS}, j AS (SELECT len(list_filter(tokens, lambda t: t IN ({_JUMPS}))) AS j FROM corpus WHERE len(tokens) > 0)
SELECT count(*) AS paths, count(*) FILTER (WHERE j = 0) AS without_jump, round(count(*) FILTER (WHERE j = 0) * 100.0::DOUBLE / count(*), 6) AS without_pct, CAST(sum(j) AS BIGINT) AS jumps, max(j) AS most FROM j""")
def jump_counts(spark: SparkSession, d: str) -> DataFrame:
    r = records(spark, d, f"size(filter(tokens, t -> t IN ({_JUMPS}))) AS j", "size(tokens) AS n").filter("n > 0")
    none = F.count_if(F.col("j") == 0)
    return r.agg(F.count("*").alias("paths"), none.alias("without_jump"), F.round(none * 100.0 / F.count("*"), 6).alias("without_pct"), F.sum("j").alias("jumps"), F.max("j").cast("long").alias("most"))


@query(f"WITH {CORPUS} SELECT path_id, len(list_distinct(tokens)) AS n_distinct FROM corpus")
def distinct_per_path(spark: SparkSession, d: str) -> DataFrame:
    return records(spark, d, "cast(size(array_distinct(filter(tokens, t -> t IS NOT NULL))) as bigint) AS n_distinct").select("path_id", "n_distinct")


@query(f"""WITH {FREQ}, r AS (SELECT freq, row_number() OVER (ORDER BY freq DESC, token) AS rn FROM freq)
SELECT CAST(n AS INTEGER) AS top, round(sum(freq) FILTER (WHERE rn <= n)::DOUBLE / sum(freq) * 100, 6) AS share FROM r, (SELECT unnest([5, 10, 20, 50]) AS n) GROUP BY n""")
def topn_share(spark: SparkSession, d: str) -> DataFrame:
    return C.shares(written(freq_of(corpus(spark, d)), "freq"), (5, 10, 20, 50))


@query(f"""WITH {FREQ} SELECT token, freq, round(freq::DOUBLE / (SELECT sum(freq) FROM freq) * 100, 6) AS share FROM freq ORDER BY freq DESC, token LIMIT 20""")
def top_tokens(spark: SparkSession, d: str) -> DataFrame:
    f = written(freq_of(corpus(spark, d)), "freq")
    share = F.round(F.col("freq") / f.agg(F.sum("freq")).scalar() * 100, 6)
    return f.orderBy(F.col("freq").desc(), "token").limit(20).select("token", "freq", share.alias("share"))


@query(f"WITH {FREQ}, c AS (SELECT {CATEGORY_SQL} AS category, freq FROM freq) SELECT category, count(*) AS tokens, CAST(sum(freq) AS BIGINT) AS occurrences FROM c GROUP BY category")
def category_hist(spark: SparkSession, d: str) -> DataFrame:
    f = freq_of(corpus(spark, d))
    return f.groupBy(categorize(F.col("token")).alias("category")).agg(F.count("*").alias("tokens"), F.sum("freq").alias("occurrences"))


@query(f"""WITH {FREQ}, t AS (SELECT path_id, unnest(tokens) AS tok FROM corpus), h AS (SELECT path_id, entropy FROM (SELECT * FROM (SELECT 1)) x, ({_ENTROPY_SQL.format(x="tok", t="t").strip().removeprefix(",").replace("c AS", "WITH c AS", 1)}) e),
k AS (SELECT c.*, h.entropy FROM corpus c LEFT JOIN h ON c.path_id = h.path_id)
SELECT file, coalesce(func_addr, '?') AS func_addr, count(*) AS paths, CAST(sum(len(tokens)) AS BIGINT) AS tokens, round(sum(len(tokens))::DOUBLE / count(*), 6) AS mean_length,
CAST(sum(len(list_filter(tokens, lambda t: t IN ({_JUMPS})))) AS BIGINT) AS blocks, CAST(sum(len(list_filter(tokens, lambda t: starts_with(t, 'VEX_')))) AS BIGINT) AS statements,
round(sum(len(list_filter(tokens, lambda t: starts_with(t, 'VEX_'))))::DOUBLE / nullif(sum(len(list_filter(tokens, lambda t: t IN ({_JUMPS})))), 0), 6) AS ratio,
round(avg(coalesce(entropy, 0)), 5) AS mean_entropy, (SELECT count(*) + 3 FROM freq WHERE freq >= 2 AND token NOT IN ('<PAD>', '<UNK>', '<MASK>')) AS vocab_size FROM k GROUP BY ALL""")
def stage_stats(spark: SparkSession, d: str) -> DataFrame:
    """Per function what each stage makes of it: blocks (by their jumps), statements and their ratio, paths, tokens, mean length, mean entropy of a path, size of the vocabulary."""
    c = corpus(spark, d)
    h = C.path_entropy(c.select("path_id", "tokens"), "path_id", "tokens")
    size = (F.count_if((F.col("freq") >= 2) & ~F.col("token").isin(*SPECIALS)) + len(SPECIALS)).alias("n")
    r = c.select("path_id", "file", F.coalesce("func_addr", F.lit("?")).alias("func_addr"), F.size("tokens").alias("n"), F.expr(f"size(filter(tokens, t -> t IN ({_JUMPS})))").alias("j"), F.expr("size(filter(tokens, t -> startswith(t, 'VEX_')))").alias("v"))
    r = r.join(h.select("path_id", "entropy"), "path_id", "left")
    # entropies are summed in the order of their ids: means that lie halfway depend on it
    entropies = F.array_sort(F.collect_list(F.struct("path_id", F.coalesce("entropy", F.lit(0.0)).alias("e"))))
    mean = F.aggregate(entropies, F.lit(0.0), lambda a, x: a + x["e"]) / F.count("*")
    s = r.groupBy("file", "func_addr").agg(
        F.count("*").alias("paths"), F.sum("n").alias("tokens"), _rounded(F.sum("n") / F.count("*"), 6).alias("mean_length"), F.sum("j").alias("blocks"), F.sum("v").alias("statements"),
        _rounded(F.sum("v") / F.nullif(F.sum("j"), F.lit(0)), 6).alias("ratio"), _rounded(mean, 5).alias("mean_entropy"),
    )
    return s.withColumn("vocab_size", freq_of(c).agg(size).scalar())


@query(f"WITH {CORPUS}, t AS (SELECT path_id, unnest(tokens) AS tok FROM corpus), h AS (SELECT * FROM (" + _ENTROPY_SQL.format(x="tok", t="t").strip().removeprefix(",").replace("c AS", "WITH c AS", 1) + ") e) SELECT count(*) AS paths, round(avg(entropy), 5) AS mean_entropy FROM h")
def entropy_mean(spark: SparkSession, d: str) -> DataFrame:
    """The mean entropy of a path."""
    h = C.path_entropy(corpus(spark, d), "path_id", "tokens")
    return h.agg(F.count("*").alias("paths"), F.round(F.avg("entropy"), 5).alias("mean_entropy"))


_LENGTHS = {"shortest": 0, "length_p10": 10, "length_p25": 25, "length_p50": 50, "length_p75": 75, "length_p90": 90, "length_p99": 99, "longest": 100}


def _places(column: str, table: str, named: dict[str, int]) -> str:
    of = f"(SELECT list_sort(list({column})) AS l, count(*) AS n FROM {table})"
    return f"SELECT {', '.join(f'l[CAST(floor({at} / 100.0::DOUBLE * (n - 1)) AS INTEGER) + 1] AS {name}' for name, at in named.items())} FROM {of}"


@query(f"""WITH {FREQ}, p AS (SELECT file, coalesce(func_addr, '?') AS func_addr, {_HASH} AS h, len(tokens) AS n, len(list_filter(tokens, lambda t: t IN ({_STRUCTURAL}))) AS s,
len(list_filter(tokens, lambda t: t IN ({_JUMPS}))) AS j, len(list_distinct(tokens)) AS k FROM corpus WHERE len(tokens) > 0),
f AS (SELECT count(DISTINCT h)::DOUBLE / count(*) AS u FROM p GROUP BY file, func_addr), t AS (SELECT CAST(sum(freq) AS DOUBLE) AS n, log2(count(*)::DOUBLE) AS m FROM freq),
r AS (SELECT freq, row_number() OVER (ORDER BY freq DESC, token) AS rn FROM freq),
one AS (SELECT count(DISTINCT file) AS files, count(DISTINCT (file, func_addr)) AS functions, count(*) AS paths, count(DISTINCT h) AS unique_paths, count(*) - count(DISTINCT h) AS repeats,
  round((1 - count(DISTINCT h)::DOUBLE / count(*)) * 100, 6) AS repeats_pct, CAST(sum(n) AS BIGINT) AS tokens, CAST(sum(s) AS BIGINT) AS structural, round(sum(s) * 100.0::DOUBLE / sum(n), 6) AS structural_pct,
  count(*) FILTER (WHERE j = 0) AS without_jump, round(count(*) FILTER (WHERE j = 0) * 100.0::DOUBLE / count(*), 6) AS without_jump_pct FROM p),
e AS (SELECT count(*) AS distinct_tokens, round(-sum(freq / n * log2(freq / n)), 6) AS entropy, round(any_value(m), 6) AS max_entropy, round(-sum(freq / n * log2(freq / n)) / any_value(m) * 100, 6) AS utilisation FROM freq, t),
tops AS (SELECT {", ".join(f"round(sum(freq) FILTER (WHERE rn <= {n})::DOUBLE / sum(freq) * 100, 6) AS top{n}_pct" for n in (5, 10, 20, 50))} FROM r),
lens AS ({_places("n", "p", _LENGTHS)}), jumps AS ({_places("j", "p", {"jumps_p50": 50, "jumps_p75": 75})}), kinds AS ({_places("k", "p", {"distinct_p50": 50, "distinct_p75": 75})}),
div AS ({_places("u", "f", {"diversity_p25": 25, "diversity_p50": 50, "diversity_p75": 75})}),
fn AS (SELECT count(*) FILTER (WHERE u <= 0.01) AS nearly_constant, count(*) FILTER (WHERE u < 0.5) AS under_half, count(*) FILTER (WHERE u = 1.0) AS all_unique FROM f)
SELECT one.*, e.*, tops.*, lens.*, jumps.*, kinds.*, round(diversity_p25, 6) AS diversity_p25, round(diversity_p50, 6) AS diversity_p50, round(diversity_p75, 6) AS diversity_p75, fn.* FROM one, e, tops, lens, jumps, kinds, div, fn""")
def corpus_report(spark: SparkSession, d: str) -> DataFrame:
    """All numbers of a corpus report in one row: volume, distribution, structure, lengths, diversity, sequences."""
    f = written(freq_of(corpus(spark, d)), "freq")
    r = records(spark, d, _H, "size(tokens) AS n", f"size(filter(tokens, t -> t IN ({_STRUCTURAL}))) AS s", f"size(filter(tokens, t -> t IN ({_JUMPS}))) AS j", "size(array_distinct(filter(tokens, t -> t IS NOT NULL))) AS k")
    r = written(r.filter("n > 0").withColumn("func_addr", F.coalesce("func_addr", F.lit("?"))), "path-figures")
    functions = written(C.diversity(r).withColumn("u", F.col("unique_paths") / F.col("paths")), "function-figures")
    n, u, none = F.count("*"), F.countDistinct("h"), F.count_if(F.col("j") == 0)
    one = r.agg(
        F.countDistinct("file").alias("files"), F.countDistinct("file", "func_addr").alias("functions"), n.alias("paths"), u.alias("unique_paths"), (n - u).alias("repeats"), F.round((1 - u / n) * 100, 6).alias("repeats_pct"),
        F.sum("n").alias("tokens"), F.sum("s").alias("structural"), F.round(F.sum("s") * 100.0 / F.sum("n"), 6).alias("structural_pct"), none.alias("without_jump"), F.round(none * 100.0 / n, 6).alias("without_jump_pct"),
    )
    e = C.entropy(f).withColumn("distinct_tokens", f.agg(F.count("*")).scalar())
    tops = C.shares(f, (5, 10, 20, 50)).agg(*(F.max(F.when(F.col("top") == t, F.col("share"))).alias(f"top{t}_pct") for t in (5, 10, 20, 50)))
    parts = [
        e, tops, C.percentiles(r, "n", _LENGTHS), C.percentiles(r, "j", {"jumps_p50": 50, "jumps_p75": 75}), C.percentiles(r, "k", {"distinct_p50": 50, "distinct_p75": 75}),
        C.percentiles(functions.withColumn("u", F.round("u", 6)), "u", {"diversity_p25": 25, "diversity_p50": 50, "diversity_p75": 75}, "double"),
        functions.agg(F.count_if(F.col("u") <= 0.01).alias("nearly_constant"), F.count_if(F.col("u") < 0.5).alias("under_half"), F.count_if(F.col("u") == 1.0).alias("all_unique")),
    ]
    for i, p in enumerate(parts):
        one = one.withColumn(f"_{i}", p.select(F.struct(*p.columns)).scalar())
    return one.select("*", *(f"_{i}.*" for i in range(len(parts)))).drop(*(f"_{i}" for i in range(len(parts))))


@query(f"WITH {CORPUS} SELECT path_id, file, func_addr FROM (SELECT *, row_number() OVER (PARTITION BY file, func_addr ORDER BY path_id) AS rn FROM corpus) WHERE rn <= 16")
def cap_paths(spark: SparkSession, d: str) -> DataFrame:
    """The first 16 paths of every function."""
    rn = F.row_number().over(Window.partitionBy("file", "func_addr").orderBy("path_id"))
    return records(spark, d).withColumn("rn", rn).filter("rn <= 16").select("path_id", "file", "func_addr")
