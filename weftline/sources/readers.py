"""Sources: ordered Parquet and JSON lines, by schema roles, strict or lenient."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Names by which a column's role is known, the first that is there counts.
ROLES = {
    "instr": ["instruction", "input", "question", "problem", "task", "query", "instruction_text", "description", "prompt"],
    "code": ["output", "response", "answer", "solution", "code", "completion", "response_text"],
    "score": ["average_test_score", "score", "test_score", "reward"],
    "status": ["tests_execution_status", "execution_status", "test_status"],
    "id": ["sha1", "hash", "id", "fingerprint", "problem_id", "task_id"],
}


def parquet(spark: SparkSession, *paths: str, start_file: int = 0, skip_corrupt: bool = False) -> DataFrame:
    """Rows with ``file_no`` (files by name) and ``row_no`` (place in the file), which together are the order.

    ``start_file`` leaves out the files before it. Unreadable files stop the scan unless they may be skipped.
    """
    reader = spark.read.option("mergeSchema", "true").option("ignoreCorruptFiles", str(skip_corrupt).lower())
    rows = reader.parquet(*paths).select("*", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.row_index").alias("row_no"))
    names = sorted(rows.inputFiles())
    number = F.array_position(F.lit([_decoded(n) for n in names]), _plain(F.col("_file"))) - 1 if names else F.lit(0)
    return rows.withColumn("file_no", number.cast("int")).drop("_file").where(F.col("file_no") >= start_file)


def _decoded(name: str) -> str:
    from urllib.parse import unquote

    return re.sub(r"^file:/+", "/", unquote(name))


def _plain(c: Column) -> Column:
    return F.regexp_replace(F.url_decode(F.replace(c, F.lit("+"), F.lit("%2B"))), "^file:/+", "/")


def corrupt_files(spark: SparkSession, paths: list[str]) -> list[str]:
    """Which of the files have no readable footer; only footers are read."""
    bad = []
    for path in paths:
        try:
            spark.read.parquet(path).schema  # noqa: B018
        except Exception:  # whatever the reader raises: the file can't be used
            bad.append(path)
    return bad


def roles(columns: list[str]) -> dict[str, str | None | list[str]]:
    """Column of each role, by name whatever its case; no column has two. ``ignored`` are the rest."""
    lower = {c.lower(): c for c in columns}
    found: dict[str, str | None | list[str]] = {}
    for role, names in ROLES.items():
        found[role] = next((lower[n] for n in names if n in lower and lower[n] not in found.values()), None)
    found["ignored"] = [c for c in columns if c not in found.values()]
    return found


def first_of(df: DataFrame, names: list[str], blank_is_none: bool = False) -> Column:
    """First value that isn't null (or blank) of the columns that are there; null if none is."""
    there = [F.col(n) for n in names if n in df.columns]
    if not there:
        return F.lit(None).cast("string")
    return F.coalesce(*[F.when(F.trim(c) != "", c) if blank_is_none else c for c in there])


def source_rows(df: DataFrame) -> DataFrame:
    """``path`` and ``content`` by whichever names the source has them."""
    return df.select("*", first_of(df, ["path", "max_stars_repo_path"]).alias("_path"), first_of(df, ["content", "text"]).alias("_content")).select(F.col("_path").alias("path"), F.col("_content").alias("content"))


def probe(df: DataFrame, needs: tuple[str, ...] = ("instr", "code")) -> dict[str, object]:
    """Rows, columns, roles, and why the source can't be used, if so."""
    found = roles(df.columns)
    missing = [n for n in needs if not found[n]]
    return {"rows": df.count(), "columns": df.columns, "roles": found, "skipped": f"no column for {', '.join(missing)}" if missing else None}


def json_lines(spark: SparkSession, path: str, schema: T.StructType | str, strict: bool = True, recursive: bool = False, pattern: str | None = None) -> DataFrame:
    """JSON lines. Strict: a bad line fails the scan. Lenient: it comes as a row with ``_corrupt_record``."""
    shape = schema if isinstance(schema, T.StructType) else T.StructType.fromDDL(schema)
    if not strict and "_corrupt_record" not in shape.names:
        shape = T.StructType([*shape.fields, T.StructField("_corrupt_record", T.StringType())])
    reader = spark.read.schema(shape).option("mode", "FAILFAST" if strict else "PERMISSIVE").option("recursiveFileLookup", str(recursive).lower())
    return (reader.option("pathGlobFilter", pattern) if pattern else reader).json(path)


def without_corrupt(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The good rows, and the number of bad ones by file."""
    bad = df.where("_corrupt_record is not null").groupBy(F.input_file_name().alias("file")).agg(F.count(F.lit(1)).alias("n"))
    return df.where("_corrupt_record is null").drop("_corrupt_record"), bad


def numbered_lines(spark: SparkSession, path: str, pattern: str = "*.jsonl") -> DataFrame:
    """``file``, ``line_no`` (from 1) and ``line`` of the files below a folder, those named _… left out.

    A file is one row of the scan, so this is for logs and evaluation files, not for corpora.
    """
    files = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).text(path, wholetext=True).select(F.input_file_name().alias("file"), "value")
    kept = files.where(~F.element_at(F.split("file", "/"), -1).startswith("_"))
    lines = kept.select("file", F.posexplode(F.split("value", "\n")).alias("at", "line"))
    return lines.where("line <> ''").select("file", (F.col("at") + 1).alias("line_no"), "line")


def step_folders(spark: SparkSession, path: str) -> DataFrame:
    """``step`` and ``folder`` of the folders named step_N, by number."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    found = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listStatus(where)
    rows = [(int(m[1]), s.getPath().toString()) for s in found if s.isDirectory() and (m := re.fullmatch(r"step_(\d+)", s.getPath().getName()))]
    return spark.createDataFrame(rows, "step long, folder string").orderBy("step")


def tasks(df: DataFrame) -> DataFrame:
    """Tasks in one shape. Lines ``assert candidate(…)`` of a ``test`` text become tests of the entry point."""
    entry = first_of(df, ["entry", "entry_point"])
    lines = F.filter(F.split(F.col("test"), "\n"), lambda x: F.rlike(F.trim(x), F.lit(r"^assert\s+candidate\("))) if "test" in df.columns else None
    rewritten = F.transform(lines, lambda x: F.regexp_replace(F.regexp_replace(F.trim(x), F.lit(r"^assert\s+"), F.lit("")), F.lit(r"\bcandidate\("), F.concat(entry, F.lit("(")))) if lines is not None else None
    tests = F.coalesce(*[c for c in (F.col("tests") if "tests" in df.columns else None, rewritten) if c is not None])
    return df.select(first_of(df, ["name", "task_id", "id"]).alias("name"), F.col("prompt"), entry.alias("entry"), tests.alias("tests"))


def preview(df: DataFrame, rows: int = 3) -> dict[str, object]:
    """Schema, number of rows, and the first ones."""
    return {"schema": df.schema.simpleString(), "rows": df.count(), "first": [r.asDict(recursive=True) for r in df.limit(rows).collect()]}
