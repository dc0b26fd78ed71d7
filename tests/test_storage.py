import os

import pytest
from pyspark.sql import functions as F

from weftline.sources import readers, sinks


def test_parquet_order_and_resume(spark, tmp_path):
    for k in range(3):
        spark.createDataFrame([(10 * k + i,) for i in range(3)], "v int").coalesce(1).write.parquet(str(tmp_path / f"part{k}"))
    rows = readers.parquet(spark, *[str(tmp_path / f"part{k}") for k in range(3)])
    assert [r.v for r in rows.orderBy("file_no", "row_no").collect()] == [0, 1, 2, 10, 11, 12, 20, 21, 22]
    assert sorted(r.v for r in readers.parquet(spark, *[str(tmp_path / f"part{k}") for k in range(3)], start_file=2).collect()) == [20, 21, 22]


def test_corrupt_files(spark, tmp_path):
    spark.createDataFrame([(1,)], "v int").write.parquet(str(tmp_path / "good"))
    (tmp_path / "bad.parquet").write_bytes(b"PAR1nothing")
    assert readers.corrupt_files(spark, [str(tmp_path / "good"), str(tmp_path / "bad.parquet")]) == [str(tmp_path / "bad.parquet")]


def test_roles_and_adapting(spark):
    found = readers.roles(["ID", "Prompt", "output", "Answer", "score"])
    assert (found["instr"], found["code"], found["score"], found["id"], found["status"]) == ("Prompt", "output", "score", "ID", None)
    assert found["ignored"] == ["Answer"]
    df = spark.createDataFrame([(None, "b"), (" ", "c")], "instruction string, prompt string")
    assert [r[0] for r in df.select(readers.first_of(df, ["instruction", "prompt"], True)).collect()] == ["b", "c"]
    assert readers.probe(df)["skipped"] == "no column for code"


def test_json_lines(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"x": 1}\nbroken\n')
    rows = readers.json_lines(spark, str(tmp_path / "a.jsonl"), "x int", strict=False).cache()
    good, bad = readers.without_corrupt(rows)
    assert [r.x for r in good.collect()] == [1] and [r.n for r in bad.collect()] == [1]
    with pytest.raises(Exception):  # noqa: B017
        readers.json_lines(spark, str(tmp_path / "a.jsonl"), "x int").collect()
    (tmp_path / "_skip.jsonl").write_text("no\n")
    assert [(r.line_no, r.line) for r in readers.numbered_lines(spark, str(tmp_path)).orderBy("line_no").collect()] == [(1, '{"x": 1}'), (2, "broken")]


def test_task_shapes(spark):
    df = spark.createDataFrame([("t", "p", "f", "def check(candidate):\n    assert candidate(1) == 2\n    x = 1")], "task_id string, prompt string, entry_point string, test string")
    assert readers.tasks(df).head().asDict() == {"name": "t", "prompt": "p", "entry": "f", "tests": ["f(1) == 2"]}


def test_step_folders(spark, tmp_path):
    for n in ("step_10", "step_9", "other"):
        os.mkdir(tmp_path / n)
    assert [r.step for r in readers.step_folders(spark, str(tmp_path)).collect()] == [9, 10]


def test_large_token_files_are_read_in_pieces(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(sinks, "PIECE", 64)
    target = str(tmp_path / "bins")
    df = spark.range(500).select(F.col("id").alias("chunk_id"), F.array(F.col("id").cast("int"), F.lit(65_535), F.lit(0)).alias("ids"), F.array(F.lit(0), F.lit(1), (F.col("id") % 2).cast("int")).alias("mask"))
    sinks.token_file(df, target).collect()
    assert sorted((r.chunk_id, r.ids) for r in sinks.read_token_file(spark, target, 3).collect()) == [(k, [k, 65_535, 0]) for k in range(500)]
    assert sorted((r.chunk_id, r.mask) for r in sinks.read_masks(spark, "file://" + target, 3).collect()) == [(k, [0, 1, k % 2]) for k in range(500)]
    assert sinks.token_faults(spark, target, 3).collect() == []
    assert sinks.token_file(df.where("false"), str(tmp_path / "none")).collect() == []


def test_token_file_round_trip(spark, tmp_path):
    rows = [(k, [k, 65_535, 0], [0, 1, 1]) for k in range(20)]
    df = spark.createDataFrame(rows, "chunk_id long, ids array<int>, mask array<int>")
    target = str(tmp_path / "bin")
    assert sum(r.n_tokens for r in sinks.token_file(df, target).collect()) == 60
    assert [(r.chunk_id, r.ids) for r in sinks.read_token_file(spark, target, 3).orderBy("chunk_id").collect()] == [(k, i) for k, i, _ in rows]
    with pytest.raises(Exception, match="whole number"):
        sinks.read_token_file(spark, target, 7).collect()
    with pytest.raises(Exception, match="16 bits"):
        sinks.token_file(df.withColumn("ids", F.array(F.lit(65_536))), str(tmp_path / "bad")).collect()


def test_publish_and_reports(spark, tmp_path):
    target = str(tmp_path / "table")
    for k in (1, 2):
        sinks.publish(spark.createDataFrame([(k,)], "v int"), target)
    assert [r.v for r in spark.read.parquet(target).collect()] == [2] and os.listdir(tmp_path) == ["table"]
    with pytest.raises(ValueError):
        sinks.publish(spark.createDataFrame([], "v int"), target)
    assert sinks.markdown(spark.createDataFrame([("a|b", None)], "x string, y int")) == "| x | y |\n|---|---|\n| a\\|b | — |\n"
    with pytest.raises(ValueError):
        sinks.markdown(spark.range(5).toDF("x"), 3)
