"""Queries on sources: scans, tolerant parsing, projections and filters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.arrays import joined
from ..sources import formats
from ..sources.tables import table
from ..sources.views import corpus, records
from .registry import query
from .views_sql import CORPUS


def _spelled(spark: SparkSession, d: str, column: str, name: Column, most: int = 1000) -> tuple[str | None, Column]:
    """The least ``name`` of paths, and a condition on ``column`` as stored that the scan can prune by: its spellings, if they are ``most`` at most."""
    names = table(spark, d, "paths").select(F.col(column).alias("raw"), name.alias("name")).distinct()
    first = names.agg(F.min("name")).first()[0]
    raw = [r[0] for r in names.filter(F.col("name") == first).select("raw").limit(most + 1).collect()]
    return first, F.col(column).isin(raw) if len(raw) <= most else F.lit(True)


@query(f"WITH {CORPUS} SELECT path_id, file, func_addr, len(tokens) AS n_tokens FROM corpus")
def scan_paths(spark: SparkSession, d: str) -> DataFrame:
    return records(spark, d, "cast(size(tokens) as bigint) AS n_tokens")


@query("""WITH c AS (SELECT path_id, any_value(len(coalesce(tokens, []))) AS n FROM paths GROUP BY path_id)
SELECT count(*) AS lines, count(*) FILTER (WHERE path_id % 5 <> 0) AS parsed, count(*) FILTER (WHERE path_id % 5 = 0) AS skipped,
CAST(sum(n) FILTER (WHERE path_id % 5 <> 0) AS BIGINT) AS tokens FROM c""")
def tolerant_parse(spark: SparkSession, d: str) -> DataFrame:
    """Every path as a JSON line, each fifth one damaged, parsed again: bad lines are counted, not fatal."""
    c = corpus(spark, d)
    line = F.to_json(F.struct("file", "func_addr", "tokens"))
    lines = c.select(F.when(F.col("path_id") % 5 == 0, F.concat(F.lit("{"), line)).otherwise(line).alias("line"))
    return formats.parse_report(formats.parse_lines(lines, "line"))


@query(f"WITH {CORPUS} SELECT path_id, func_addr, len(tokens) AS n_tokens FROM corpus WHERE file = (SELECT min(file) FROM corpus)")
def scan_one_file(spark: SparkSession, d: str) -> DataFrame:
    first, only = _spelled(spark, d, "file_name", F.btrim(F.substring_index("file_name", "/", -1), F.lit(" \t\n\r")))
    r = records(spark, d, "cast(size(tokens) as bigint) AS n_tokens", only=only)
    return r.filter(F.col("file") == first).select("path_id", "func_addr", "n_tokens")


@query("SELECT token, id FROM vocab")
def load_vocab(spark: SparkSession, d: str) -> DataFrame:
    """The vocabulary as one JSON object and back."""
    v = table(spark, d, "vocab")
    text = v.agg(F.to_json(F.map_from_entries(F.array_sort(F.collect_list(F.struct("token", "id"))))).alias("value"))
    return formats.vocab_of_json(text)


@query("SELECT vec_id, label, len(embedding) AS dims, round(CAST(embedding[1] AS DOUBLE), 6) AS first FROM embeddings")
def scan_embeddings(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings")
    return e.select("vec_id", "label", F.size("embedding").cast("long").alias("dims"), F.round(F.element_at("embedding", 1).cast("double"), 6).alias("first"))


@query("SELECT label, count(*) AS n, string_agg(CAST(vec_id AS VARCHAR), ' ' ORDER BY vec_id) AS ids FROM embeddings GROUP BY label")
def embeddings_by_func(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings").groupBy("label").agg(F.count("*").alias("n"), F.array_sort(F.collect_list("vec_id")).alias("v"))
    return e.select("label", "n", joined(F.col("v")).alias("ids"))


@query("""SELECT DISTINCT trim(regexp_extract(file_name, '[^/]*$'), e' \\t\\n\\r') AS file FROM paths
EXCEPT SELECT trim(regexp_extract(file_name, '[^/]*$'), e' \\t\\n\\r') FROM traces WHERE file_name IS NOT NULL""")
def resume_anti(spark: SparkSession, d: str) -> DataFrame:
    """Shards of paths that have no trace yet: what a resumed run still has to do."""

    def shards(name: str) -> DataFrame:
        return table(spark, d, name).select(F.btrim(F.substring_index("file_name", "/", -1), F.lit(" \t\n\r")).alias("file")).filter("file IS NOT NULL").distinct()

    return formats.pending(shards("paths"), shards("traces"), "file")


@query("""SELECT u.util || '_' || c.compiler || '_' || o.opt AS label FROM (SELECT DISTINCT lower(trim(util, e' \\t\\n\\r')) AS util FROM binary_records WHERE util IS NOT NULL) u,
(VALUES ('gcc'), ('clang')) c(compiler), (VALUES ('O0'), ('O1'), ('O2'), ('O3'), ('Os')) o(opt)""")
def variant_grid(spark: SparkSession, d: str) -> DataFrame:
    """Every utility in every build configuration; the configurations are a constant that rows are exploded by."""
    utils = table(spark, d, "binary_records").select(F.lower(F.btrim("util", F.lit(" \t\n\r"))).alias("util")).filter("util IS NOT NULL").distinct()
    grid = [f"{c}_{o}" for c in ("gcc", "clang") for o in ("O0", "O1", "O2", "O3", "Os")]
    return utils.select("util", F.explode(F.array(*map(F.lit, grid))).alias("v")).select(F.concat_ws("_", "util", "v").alias("label"))


@query(f"WITH {CORPUS} SELECT path_id, coalesce(file, '?') AS file, coalesce(func_addr, '?') AS func_addr, len(tokens) AS n_tokens FROM corpus")
def project_default(spark: SparkSession, d: str) -> DataFrame:
    r = records(spark, d, "cast(size(tokens) as bigint) AS n_tokens")
    return r.select("path_id", F.coalesce("file", F.lit("?")).alias("file"), F.coalesce("func_addr", F.lit("?")).alias("func_addr"), "n_tokens")


@query(f"WITH {CORPUS} SELECT file, count(*) AS paths FROM corpus WHERE len(tokens) > 0 GROUP BY file")
def drop_empty(spark: SparkSession, d: str) -> DataFrame:
    return records(spark, d, "size(tokens) AS n").filter("n > 0").groupBy("file").agg(F.count("*").alias("paths"))


@query("SELECT event_id, user_id, event_type FROM events WHERE event_type NOT IN ('error', 'view') AND user_id IS NOT NULL AND value > 0")
def func_kind_filter(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    return e.filter(~F.col("event_type").isin("error", "view") & F.col("user_id").isNotNull() & (F.col("value") > 0)).select("event_id", "user_id", "event_type")


@query(f"WITH {CORPUS} SELECT path_id, file, len(tokens) AS n_tokens FROM corpus WHERE func_addr = (SELECT min(func_addr) FROM corpus) ORDER BY path_id LIMIT 12")
def paths_for_func(spark: SparkSession, d: str) -> DataFrame:
    """The first 12 paths of one function, as a display takes them."""
    at = F.concat(F.lit("0x"), F.ltrim(F.regexp_replace(F.lower(F.btrim("func_addr", F.lit(" \t\n\r"))), "^0x", ""), F.lit("0")))
    first, only = _spelled(spark, d, "func_addr", at)
    r = records(spark, d, "cast(size(tokens) as bigint) AS n_tokens", only=only)
    return r.filter(F.col("func_addr") == first).orderBy("path_id").limit(12).select("path_id", "file", "n_tokens")


_SHARDS = "SELECT DISTINCT trim(regexp_extract(file_name, '[^/]*$'), e' \\t\\n\\r') AS file FROM {t} WHERE file_name IS NOT NULL"


@query(f"""WITH p AS ({_SHARDS.format(t='paths')}), t AS ({_SHARDS.format(t='traces')})
SELECT CASE WHEN t.file IS NULL THEN 'pending' WHEN p.file IS NULL THEN 'unknown' ELSE 'finished' END AS status, count(*) AS shards FROM p FULL JOIN t ON p.file = t.file GROUP BY 1""")
def run_counters(spark: SparkSession, d: str) -> DataFrame:
    """Shards by what a resumed run makes of them."""

    def shards(name: str, flag: str) -> DataFrame:
        return table(spark, d, name).select(F.btrim(F.substring_index("file_name", "/", -1), F.lit(" \t\n\r")).alias("file")).filter("file IS NOT NULL").distinct().withColumn(flag, F.lit(True))

    both = shards("paths", "p").join(shards("traces", "t"), "file", "full")
    status = F.when(F.col("t").isNull(), "pending").when(F.col("p").isNull(), "unknown").otherwise("finished")
    return both.groupBy(status.alias("status")).agg(F.count("*").alias("shards"))


@query("SELECT record_id, label[1:28] AS shown, len(label) > 28 AS cut FROM binary_records WHERE label IS NOT NULL")
def operand_cut(spark: SparkSession, d: str) -> DataFrame:
    """Texts as a panel shows them: the first 28 characters."""
    return table(spark, d, "binary_records").filter("label IS NOT NULL").select("record_id", F.substring("label", 1, 28).alias("shown"), (F.length("label") > 28).alias("cut"))


@query(f"""WITH {CORPUS} SELECT file, coalesce(func_addr, '?') AS func_addr, count(*) <= 8 AND max(len(tokens)) <= 16 AS annotated FROM corpus GROUP BY ALL""")
def annotate_flag(spark: SparkSession, d: str) -> DataFrame:
    """Whether a function is small enough for its cells to be labelled: at most 8 paths of at most 16 tokens."""
    r = records(spark, d, "size(tokens) AS n")
    return r.groupBy("file", F.coalesce("func_addr", F.lit("?")).alias("func_addr")).agg(((F.count("*") <= 8) & (F.max("n") <= 16)).alias("annotated"))
