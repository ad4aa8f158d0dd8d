"""stage_stats rounds means that lie halfway as its SQL does."""

from oracle import sql_rows

from pathloom.plans import catalog


def test_means_that_lie_halfway(spark, tmp_path):
    halfway = [["a"] * 1 + ["b"] * x + ["c"] * y for x, y in ((2, 5), (2, 29), (7, 20), (9, 21), (17, 25))]
    rows = [(i, "s.jsonl", hex(4096 + i), t) for i, t in enumerate(halfway)] + [(9, "s.jsonl", None, [])]
    spark.createDataFrame(rows, "path_id long, file_name string, func_addr string, tokens array<string>").coalesce(1).write.parquet(f"{tmp_path}/paths.parquet")
    names, want = sql_rows(catalog.oracle_sql()["stage_stats"], str(tmp_path))
    got = catalog.queries()["stage_stats"](spark, str(tmp_path)).select(*names).collect()
    assert sorted(map(tuple, got)) == sorted(want)
    assert {r.mean_entropy for r in got if r.func_addr == "0x1000"} == {1.29879}
