"""The queries of the ten problems, over their whole tables, and what SQL can say of them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources.shared import written
from ..sources.tables import table
from . import chunking, event_runs, grouped_split, leakage, nearest, overlap, packing, path_keys, sentences, shared_spans, term_frequency

Query = Callable[[SparkSession, str], DataFrame]


def _terms(spark: SparkSession, d: str) -> DataFrame:
    return term_frequency.marked_terms(table(spark, d, "paths"))


def p1_terms(spark: SparkSession, d: str) -> DataFrame:
    return _terms(spark, d).select(F.col("term").alias("token"), "occurrences", F.col("records").alias("paths"), "mark")


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return _terms(spark, d).filter(F.col("mark").isNotNull()).select(F.col("term").alias("token"))


def p2_split(spark: SparkSession, d: str) -> DataFrame:
    c = F.col
    return grouped_split.grouped_split(
        table(spark, d, "binary_records"),
        table(spark, d, "util_links"),
        "record_id",
        grouped_split.source_name(c("util"), c("label")),
        grouped_split.build_stratum(c("compiler"), c("opt")),
        grouped_split.written_alike(c("name_a")),
        grouped_split.written_alike(c("name_b")),
    )


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return p2_split(spark, d).filter(F.col("group_key").isNotNull() & F.col("split").isNotNull()).select("record_id", "group_key")


def p2_balance(spark: SparkSession, d: str) -> DataFrame:
    """Per split and stratum: records, their share of the stratum, and how far it is from what the split should have."""
    c = F.col
    strata = table(spark, d, "binary_records").select("record_id", grouped_split.build_stratum(c("compiler"), c("opt")).alias("stratum"))
    counts = p2_split(spark, d).join(strata, "record_id").groupBy("stratum", "split").agg(F.count("*").alias("records"))
    wanted = F.when(c("split") == "train", 0.8).otherwise(0.1)
    share = c("records") / F.sum("records").over(Window.partitionBy("stratum"))
    return counts.select("split", "stratum", "records", F.round(share, 6).alias("share"), F.round(share - wanted, 6).alias("deviation"))


def p2_whole(spark: SparkSession, d: str) -> DataFrame:
    """Per group: its records, and in how many splits they are."""
    return p2_split(spark, d).filter("group_key IS NOT NULL").groupBy("group_key").agg(F.count("*").alias("records"), F.countDistinct("split").alias("splits"))


def p3_neighbours(spark: SparkSession, d: str) -> DataFrame:
    """The five most similar records of every record, with their labels."""
    records = table(spark, d, "binary_records")
    labels = records.select(F.col("record_id").alias("neighbour_id"), F.col("label").alias("neighbour_label"))
    near = nearest.neighbours(records).withColumnRenamed("neighbour", "neighbour_id")
    return near.join(labels, "neighbour_id", "left").select("record_id", "rank", "neighbour_id", "neighbour_label", F.round("similarity", 3).alias("similarity"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return nearest.similar_pairs(table(spark, d, "binary_records")).toDF("record_id_a", "record_id_b")


def _sides() -> tuple[Column, Column]:
    """Split (train, val or test, else null) and shard of a path."""
    split = path_keys.split_name(F.col("split"))
    return F.when(split.isin("train", "val", "test"), split), path_keys.shard_name(F.col("file_name"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return overlap.near_copy_pairs(table(spark, d, "paths"), *_sides()).select(F.col("a").alias("path_id_a"), F.col("b").alias("path_id_b"))


def p4_overlap(spark: SparkSession, d: str) -> DataFrame:
    """Paths of val and test shards that train shards hold, per split and shard."""
    return overlap.overlap_report(table(spark, d, "paths"), *_sides())


def p5_runs(spark: SparkSession, d: str) -> DataFrame:
    return event_runs.event_runs(table(spark, d, "traces"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return event_runs.event_runs(table(spark, d, "traces"), least=4).select("trace_id", "start_pos", "end_pos")


def p6_pieces(spark: SparkSession, d: str) -> DataFrame:
    return chunking.split_oversized(table(spark, d, "paths"), keep_small=True)


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return chunking.split_oversized(table(spark, d, "paths")).select("path_id", "start_pos", "end_pos")


def _function() -> Column:
    """Shard and address; null where the address is."""
    at = path_keys.address(F.col("func_addr"))
    return F.when(at.isNotNull(), F.struct(F.coalesce(path_keys.shard_name(F.col("file_name")), F.lit("")), at))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return shared_spans.shared_pairs(table(spark, d, "paths"), "path_id", "tokens", _function()).toDF("path_id_a", "path_id_b")


def p7_share(spark: SparkSession, d: str) -> DataFrame:
    """How much of each path is found in other functions."""
    return shared_spans.shared_share(table(spark, d, "paths"), "path_id", "tokens", _function())


def p8_containers(spark: SparkSession, d: str) -> DataFrame:
    """The container of 2,048 tokens of every review text, or of every piece of a longer one."""
    tokenizer = spark.conf.get("spark.pathloom.tokenizer", packing.TOKENIZER)
    packed = packing.pack(packing.token_sizes(table(spark, d, "documents"), "doc_id", "text", tokenizer))
    return packed.withColumnRenamed("_item", "doc_id")


def p8_fill(spark: SparkSession, d: str) -> DataFrame:
    return packing.fill_report(p8_containers(spark, d))


def p8_rules(spark: SparkSession, d: str) -> DataFrame:
    """One row: texts in containers, containers over their capacity, texts divided that need not be, pieces missing or there twice."""
    packed = written(p8_containers(spark, d), "packed")
    over = packed.groupBy("container").agg(F.sum("n_tokens").alias("n")).filter("n > 2048").agg(F.count("*")).scalar()
    texts = packed.groupBy("doc_id").agg(F.count("*").alias("pieces"), F.countDistinct("piece").alias("distinct"), F.max("piece").alias("last"), F.sum("n_tokens").alias("n"))
    divided, wrong = F.count_if((F.col("n") <= 2048) & (F.col("pieces") > 1)), F.count_if((F.col("pieces") != F.col("last")) | (F.col("distinct") != F.col("last")) | (F.col("last") != F.ceil(F.col("n") / 2048)))
    return texts.agg(F.count("*").alias("texts"), divided.alias("divided"), wrong.alias("wrong_pieces")).withColumn("over_full", over)


def _leaks(spark: SparkSession, d: str) -> DataFrame:
    short = F.lower(F.btrim(F.col("lang"))).isin("zh", "ja")
    return leakage.leaks(table(spark, d, "documents"), table(spark, d, "eval_items"), short)


def p9_leaks(spark: SparkSession, d: str) -> DataFrame:
    """Leaked items per review, with the longest span they share."""
    return _leaks(spark, d)


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return _leaks(spark, d).select("doc_id", "eval_id")


def p10_sentences(spark: SparkSession, d: str) -> DataFrame:
    """Numbered sentences with their text."""
    return sentences.sentence_units(table(spark, d, "documents"))


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return sentences.sentence_units(table(spark, d, "documents")).select("doc_id", "sent_start", "sent_end")


def queries() -> dict[str, Query]:
    return {f.__name__: f for f in (p1_terms, p1_found, p2_split, p2_found, p2_balance, p2_whole, p3_neighbours, p3_found, p4_found, p4_overlap, p5_runs, p5_found, p6_pieces, p6_found, p7_found, p7_share, p8_containers, p8_fill, p8_rules, p9_leaks, p9_found, p10_sentences, p10_found)}
