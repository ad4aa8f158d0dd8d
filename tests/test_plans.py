"""Plans: what is read, pruned, pushed down and shuffled."""

import re

from pyspark.sql import functions as F

from pathloom.operators import similarity
from pathloom.plans import catalog
from pathloom.sources.tables import table


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def columns_read(text):
    return {c for s in re.findall(r"ReadSchema: struct<([^\n]*)>", text) for c in re.findall(r"(\w+):", s)}


def test_only_needed_columns_are_read(spark, sf):
    q = catalog.queries()
    assert columns_read(plan(q["drop_empty"](spark, sf))) == {"path_id", "file_name", "tokens"}
    assert columns_read(plan(q["func_kind_filter"](spark, sf))) == {"event_id", "user_id", "event_type", "value"}
    assert columns_read(plan(q["parse_label"](spark, sf))) == {"record_id", "label"}
    assert "embedding" not in columns_read(plan(q["variant_grid"](spark, sf)))


def test_filters_reach_the_scan(spark, sf):
    text = plan(catalog.queries()["func_kind_filter"](spark, sf))
    pushed = text[text.index("PushedFilters") : text.index("ReadSchema")]
    assert "GreaterThan(value,0.0)" in pushed and "IsNotNull(user_id)" in pushed


def test_token_arrays_are_reduced_before_the_shuffle(spark, sf):
    text = plan(catalog.queries()["structural_ratio"](spark, sf))
    exchange = text.index("Exchange hashpartitioning(path_id")
    assert "filter(" in text[exchange:] and "filter(" not in text[:exchange]


def test_no_query_multiplies_its_tables(spark, sf):
    for name, query in catalog.queries().items():
        if name not in ("token_freq_stream", "train_log", "banded_pairs", "unlike_pairs"):
            text = plan(query(spark, sf))
            assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text, name


def shuffled(df):
    """Names of the columns that shuffles carry."""
    out, todo = set(), [df._jdf.queryExecution().executedPlan()]
    while todo:
        node = todo.pop()
        if node.getClass().getSimpleName() == "AdaptiveSparkPlanExec":
            node = node.initialPlan()
        if node.getClass().getSimpleName() == "ShuffleExchangeExec":
            out |= {node.output().apply(i).name() for i in range(node.output().size())}
        todo += [node.children().apply(i) for i in range(node.children().size())]
    return out


def test_entropy_shuffles_nothing(spark, sf):
    assert not shuffled(catalog.queries()["entropy_per_path"](spark, sf))


def test_no_token_array_is_shuffled(spark, sf):
    assert "token" in shuffled(catalog.queries()["token_freq"](spark, sf))
    for name in ("token_freq", "vocab", "corpus_report", "encode", "pad_truncate", "mask_thirds", "entropy_band", "topn_share"):
        assert not shuffled(catalog.queries()[name](spark, sf)) & {"tokens", "ids"}, name


def test_heatmap(spark):
    df = spark.createDataFrame([("a", "x", 0.1), ("b", "x", 0.2), ("a", "y", 0.3)], "f1 string, f2 string, d double")
    assert [tuple(r) for r in similarity.heatmap(df, "d").collect()] == [("x", 0.1, 0.2), ("y", 0.3, None)]


def test_top_neighbours_break_ties_by_key(spark):
    df = spark.createDataFrame([(i, "g", [1.0, 0.0]) for i in (0, 5, 3, 4)], "k long, g string, v array<double>")
    got = similarity.top_neighbours(df, "k", "g", "v", F.col("k") == 0, 2).orderBy("rank").collect()
    assert [(r.b, r["rank"]) for r in got] == [(3, 1), (4, 2)]


def test_tables_are_parquet_scans(spark, sf):
    assert "FileScan parquet" in plan(table(spark, sf, "nation"))
