"""Round trips of the interchange formats."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from pathloom.__main__ import main
from pathloom.sources import formats
from pathloom.streaming.token_counts import arrivals, run_to_end, token_counts


def test_paths_and_bad_lines(spark, tmp_path):
    at = tmp_path / "in"
    at.mkdir()
    (at / "a.jsonl").write_text('{"file": "f", "func_addr": "0x1", "tokens": ["a"]}\n\n{bad\n[1]\n{"file": "g"}\n')
    df = formats.read_paths(spark, str(at)).cache()
    assert df.count() == 4 and df.filter("_corrupt_record IS NOT NULL").count() == 2
    lines = spark.createDataFrame([('{"tokens": ["a", "b"]}',), ("{bad",), ('{"file": "x"}',)], "l string")
    r = formats.parse_report(formats.parse_lines(lines, "l")).first()
    assert (r.lines, r.parsed, r.skipped, r.tokens) == (3, 2, 1, 2)
    good = spark.createDataFrame([("f", "0x1", ["a"]), ("g", None, [])], "file string, func_addr string, tokens array<string>")
    formats.write_paths(good, str(tmp_path / "out"))
    back = spark.read.schema("func_addr string, tokens array<string>, file string").json(str(tmp_path / "out"))
    assert {(r.file, r.func_addr, tuple(r.tokens)) for r in back.collect()} == {("f", "0x1", ("a",)), ("g", None, ())}


def test_vocab_and_matrix(spark, tmp_path):
    v = spark.createDataFrame([("é", 1), ("<PAD>", 0), ("a", 2)], "token string, id int")
    formats.write_vocab(v, str(tmp_path / "v.json"))
    assert list(json.loads((tmp_path / "v.json").read_text())) == ["<PAD>", "é", "a"]
    assert {(r.token, r.id) for r in formats.read_vocab(spark, str(tmp_path / "v.json")).collect()} == {("é", 1), ("<PAD>", 0), ("a", 2)}
    with pytest.raises(ValueError):
        formats.write_vocab(v, str(tmp_path / "v.json"), most=2)
    (tmp_path / "m.json").write_text("[[1, 2], [3, 4]]")
    assert [list(r.ids) for r in formats.read_matrix(spark, str(tmp_path / "m.json")).orderBy("row").collect()] == [[1, 2], [3, 4]]


def test_config_and_logs(spark, tmp_path):
    (tmp_path / "c.yaml").write_text("epochs: 3  # few\nlearning_rate: 0.0001\n")
    c = formats.read_config(str(tmp_path / "c.yaml"))
    assert c.epochs == 3 and c.run_id.endswith("_ep3_lr1e-4_bs20")
    (tmp_path / "bad.yaml").write_text("depth: 3\n")
    with pytest.raises(ValueError):
        formats.read_config(str(tmp_path / "bad.yaml"))
    with pytest.raises(FileNotFoundError):
        formats.read_config(str(tmp_path / "none.yaml"))
    log = spark.createDataFrame([(1, 0.123456)], "epoch int, loss double")
    for _ in range(2):
        formats.append_log(log, str(tmp_path / "log"), {"epoch": "%d", "loss": "%.5f"})
    assert [(r.epoch, r.loss) for r in formats.read_log(spark, str(tmp_path / "log")).collect()] == [(1, 0.12346)] * 2
    (tmp_path / "x.csv").write_text(" Epoch , Loss\n1,2\n")
    assert formats.read_log(spark, str(tmp_path / "x.csv")).columns == ["epoch", "loss"]
    (tmp_path / "y.csv").write_text("a,b\n1,2\n")
    with pytest.raises(ValueError):
        formats.read_log(spark, str(tmp_path / "y.csv"))
    assert formats.metric_columns(["epoch", "acc", "val_loss", "loss"]) == ["val_loss", "loss", "acc"]


def test_embeddings_and_checkpoints(spark, tmp_path):
    assert formats.text_vector(formats.vector_text([1.5, -2.0])) == [1.5, -2.0]
    df = spark.createDataFrame([("f", 1, [1.0]), ("f", 0, [2.0]), ("g", 0, [3.0])], "func string, path_id int, emb array<float>")
    formats.write_embeddings(df, str(tmp_path / "e"))
    back = {(r.func, r.path_id, tuple(r.emb)) for r in formats.read_embeddings(spark, str(tmp_path / "e")).collect()}
    assert back == {("f", 0, (2.0,)), ("f", 1, (1.0,)), ("g", 0, (3.0,))}
    assert formats.read_embeddings(spark, str(tmp_path / "e"), "g").count() == 1
    formats.save_checkpoint(str(tmp_path / "c"), 5, {"w": np.arange(3)})
    assert {p.name for p in (tmp_path / "c").iterdir()} == {"latest.npz", "epoch5.npz"}
    epoch, w = formats.load_checkpoint(str(tmp_path / "c" / "latest.npz"))
    assert epoch == 5 and w["w"].tolist() == [0, 1, 2]


def test_small_helpers(spark):
    df = spark.createDataFrame([("A B", 1), (None, 2)], "t string, n int")
    assert df.select(formats.slug(F.col("t"))).first()[0] == "a_b"
    assert "A B & 1" in formats.latex_table(df, ["t", "n"])
    assert formats.pending(df, df.filter("n = 1"), "n").count() == 1


def test_streams(spark, tmp_path):
    rows = [(1, ["a", "b", None], "2024-01-01"), (1, ["a", "b", None], "2024-01-03"), (2, ["a"], "2024-01-02"), (3, None, "2024-01-20")]
    df = spark.createDataFrame(rows, "path_id long, tokens array<string>, d string").withColumn("ingested_at", F.to_timestamp("d"))
    df.write.parquet(str(tmp_path / "s"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "s"))
    assert {(r.token, r.freq) for r in run_to_end(token_counts(stream)).collect()} == {("a", 2), ("b", 1)}
    assert sum(r.records for r in run_to_end(arrivals(stream)).collect()) == 4


def test_reports_and_tables(spark):
    one = spark.createDataFrame([(1234567, 0.5, None)], "paths long, share double, most int")
    top = spark.createDataFrame([("a", 5, 50.0), ("b", 7, 70.0)], "token string, freq long, share double")
    text = formats.report_text(one, top)
    assert "1,234,567" in text and "0.500" in text and text.index("b  ") < text.index("a  ")
    with pytest.raises(ValueError):
        formats.latex_table(spark.range(3), ["id"], most=2)


def test_one_shard_reads_one_folder(spark, tmp_path):
    rows = [(f"s{i % 3}", "0x1", [str(i)]) for i in range(9)]
    formats.write_paths(spark.createDataFrame(rows, "file string, func_addr string, tokens array<string>"), str(tmp_path / "out"))
    df = formats.read_shard(spark, str(tmp_path / "out"), "s1")
    assert sorted(r.tokens[0] for r in df.collect()) == ["1", "4", "7"]
    assert "PartitionFilters: [isnotnull(file" in df._jdf.queryExecution().executedPlan().toString()


def test_command_line(spark, tmp_path, capsys):
    (tmp_path / "p.jsonl").write_text('{"file": "f", "func_addr": "0x1", "tokens": ["a", "b", "a"]}\n{"file": "f", "func_addr": "0x2", "tokens": ["b"]}\n{"file": "f", "func_addr": "0x1", "tokens": ["a"]}\n')
    out = str(tmp_path / "out")
    assert main(["-E", str(tmp_path / "p.jsonl"), "none.jsonl", "-P", "--stdout", "-O", out]) == 0
    said = capsys.readouterr().out
    assert "none.jsonl does not exist" in said and said.count("0x1\n") == 2
    at = f"{out}/p.jsonl-embeddings-predictor"
    assert main(["-C", at, at, "-D", "--plot", "-O", out]) == 0
    lines = [x.split("\t") for x in capsys.readouterr().out.splitlines()]
    assert [x[:2] for x in lines] == [["0x1", "0x1"], ["0x1", "0x2"], ["0x2", "0x1"], ["0x2", "0x2"]]
    assert all(float(x[2]) == pytest.approx(1, abs=1e-4) for x in lines if x[0] == x[1])
    main(["-C", at, at, "-F", "0x1", "0x9"])
    assert "no such functions" in capsys.readouterr().out
    assert main(["-C", at, "nowhere"]) == 1
