"""Queries that go through sources and sinks."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.operators import packs
from weftline.operators.funnel import verdicts
from weftline.plans.catalog import query
from weftline.plans.packs import CHUNK, samples
from weftline.session import shared_folder, table
from weftline.sources import readers, sinks


def _folder(spark: SparkSession) -> str:
    return f"{shared_folder(spark)}/weftline/io-{uuid.uuid4().hex}"


@query("SELECT doc_id FROM documents")
def scan_parquet_dir(spark: SparkSession, folder: str) -> DataFrame:
    return readers.parquet(spark, f"{folder}/documents.parquet").orderBy("file_no", "row_no").select("doc_id")


@query("SELECT id FROM problems UNION ALL SELECT id FROM heldout_problems")
def scan_multi_dir(spark: SparkSession, folder: str) -> DataFrame:
    return readers.parquet(spark, f"{folder}/problems.parquet", f"{folder}/heldout_problems.parquet").select("id")


@query("SELECT doc_id FROM documents WHERE false")
def scan_resume_index(spark: SparkSession, folder: str) -> DataFrame:
    """Nothing is left after as many files as there are."""
    files = len(table(spark, folder, "documents").inputFiles())
    return readers.parquet(spark, f"{folder}/documents.parquet", start_file=files).select("doc_id")


@query("SELECT path, md5(text) AS digest FROM documents")
def scan_column_adapt(spark: SparkSession, folder: str) -> DataFrame:
    renamed = table(spark, folder, "documents").select(F.col("path").alias("max_stars_repo_path"), "text")
    return readers.source_rows(renamed).select("path", F.md5("content").alias("digest"))


@query("SELECT 'instr' AS role, 'prompt' AS name UNION ALL SELECT 'code', 'solution'")
def detect_fields(spark: SparkSession, folder: str) -> DataFrame:
    found = readers.roles(table(spark, folder, "prompt_solution").columns)
    return spark.createDataFrame([(r, n) for r, n in found.items() if isinstance(n, str)], "role string, name string")


@query("SELECT count(*) AS n FROM prompt_solution")
def scan_probe_footer(spark: SparkSession, folder: str) -> DataFrame:
    return spark.createDataFrame([(readers.probe(table(spark, folder, "prompt_solution"))["rows"],)], "n long")


@query("SELECT id, prompt, entry, CAST(coalesce(len(tests), 0) AS BIGINT) AS n_tests FROM heldout_problems")
def scan_task_file(spark: SparkSession, folder: str) -> DataFrame:
    shaped = readers.tasks(table(spark, folder, "heldout_problems"))
    return shaped.select(F.col("name").alias("id"), "prompt", "entry", F.coalesce(F.size("tests"), F.lit(0)).cast("long").alias("n_tests"))


@query("SELECT id, k_index, completion FROM candidates")
def scan_jsonl_strict(spark: SparkSession, folder: str) -> DataFrame:
    """Candidates written as JSON lines and read back strictly."""
    target = _folder(spark)
    table(spark, folder, "candidates").write.option("ignoreNullFields", "false").json(target)
    return readers.json_lines(spark, target, "id string, k_index int, completion string, seed_used int").select("id", "k_index", "completion")


@query("SELECT count(*) AS good, CAST(2 AS BIGINT) AS bad FROM heldout_problems")
def scan_jsonl_lenient(spark: SparkSession, folder: str) -> DataFrame:
    """Two broken lines among the items are counted, not fatal."""
    target = _folder(spark)
    lines = table(spark, folder, "heldout_problems").select(F.to_json(F.struct("id", "entry")).alias("value"))
    lines.union(spark.createDataFrame([("{",), ("no json",)], "value string")).write.text(target)
    rows = readers.json_lines(spark, target, "id string, entry string", strict=False)
    return rows.agg(F.count("id").alias("good"), F.count_if(F.col("_corrupt_record").isNotNull() & F.col("id").isNull()).alias("bad"))


@query()
def sink_jsonl_split(spark: SparkSession, folder: str) -> DataFrame:
    """Accepted texts by split, written and read back."""
    target = _folder(spark)
    judged = verdicts(table(spark, folder, "documents")).where("reason = 'accepted'")
    sinks.json_by_split(judged.select("split", F.col("clean").alias("text")), target)
    return spark.read.schema("text string, split string").json(target).groupBy("split").agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("text")).alias("n_chars"))


@query()
def sink_bin(spark: SparkSession, folder: str) -> DataFrame:
    """Chunks written as 16-bit files and read back."""
    target = _folder(spark)
    sinks.token_file(packs.pack(samples(spark, folder), ["pair_id"], CHUNK), target).collect()
    return sinks.read_token_file(spark, target, CHUNK).select("chunk_id", F.aggregate("ids", F.lit(0).cast("long"), lambda a, i: a + i).alias("id_sum"))


@query("SELECT run_id, count(*) AS n, count(val_loss) AS n_val FROM training_log GROUP BY 1")
def sink_csv_log(spark: SparkSession, folder: str) -> DataFrame:
    target = _folder(spark)
    sinks.csv_log(table(spark, folder, "training_log").select("run_id", "step", "val_loss"), target)
    return sinks.read_csv_log(spark, target, "run_id string, step long, val_loss double").groupBy("run_id").agg(F.count(F.lit(1)).alias("n"), F.count("val_loss").alias("n_val"))


@query("SELECT count(*) AS n FROM subjects")
def sink_atomic_replace(spark: SparkSession, folder: str) -> DataFrame:
    target = _folder(spark)
    for _ in range(2):
        sinks.publish(table(spark, folder, "subjects"), target)
    return spark.read.parquet(target).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT CAST(count(*) + 2 AS BIGINT) AS n FROM pack_profiles")
def sink_markdown(spark: SparkSession, folder: str) -> DataFrame:
    report = sinks.markdown(table(spark, folder, "pack_profiles"))
    return spark.createDataFrame([(len(report.strip().split("\n")),)], "n long")


@query("SELECT CAST(count(*) AS BIGINT) AS n FROM documents")
def sink_meta_stats(spark: SparkSession, folder: str) -> DataFrame:
    target = _folder(spark)
    sinks.side_table(spark, {"n": table(spark, folder, "documents").count(), "made_by": "test"}, target)
    return spark.read.schema("n long").json(target).select("n")
