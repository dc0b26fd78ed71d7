"""Sinks: JSON lines by split, token files, logs, side tables, small reports."""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MOST_ID = 65_535
#: Bytes of token files that a task reads at once; a file of any size is read in such pieces.
PIECE = 64 << 20


def _address(spark: SparkSession, folder: str) -> str:
    """The folder with its file system, as every executor reaches it; without one the cluster's default holds."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(path).toString()


def _file_system(address: str):  # noqa: ANN202
    """(file system, path) of an address: shared folders, HDFS and object stores alike."""
    from pyarrow import fs

    scheme, _, rest = address.partition(":")
    if scheme == "file":
        return fs.LocalFileSystem(), "/" + rest.lstrip("/")
    return fs.FileSystem.from_uri({"s3a": "s3", "s3n": "s3"}.get(scheme, scheme) + ":" + rest)


def json_by_split(df: DataFrame, folder: str, split: str = "split", append: bool = False) -> None:
    """One folder of JSON lines for each split; a rerun replaces what is there unless it appends."""
    df.write.mode("append" if append else "overwrite").partitionBy(split).json(folder)


def csv_log(df: DataFrame, folder: str) -> None:
    """Append rows to a log; nulls are empty fields."""
    df.write.mode("append").option("header", "true").option("nullValue", "").csv(folder)


def read_csv_log(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).option("header", "true").option("nullValue", "").csv(folder)


def token_file(df: DataFrame, folder: str, with_mask: bool = True) -> DataFrame:
    """Write chunks as unsigned 16-bit ids (and 8-bit masks), a pair of files for each range of chunks.

    ``folder`` lies on a file system that all executors share. Files are named by their first chunk,
    so that by name they are the stream. An id that doesn't fit fails the job. A task that is run
    again writes the same files anew, each put in place by a rename. Gives ``first_chunk``,
    ``n_chunks`` and ``n_tokens`` of each file.
    """
    spark = df.sparkSession
    width = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    checked = df.withColumn("_ok", F.assert_true(F.forall("ids", lambda i: (i >= 0) & (i <= MOST_ID)), F.lit("an id doesn't fit 16 bits")))
    laid = checked.where("_ok is null").select("chunk_id", "ids", *(["mask"] if with_mask else [])).repartitionByRange(width, "chunk_id").sortWithinPartitions("chunk_id")
    address = _address(spark, folder)

    def put(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import uuid
        from contextlib import ExitStack

        files, target = _file_system(address)
        files.create_dir(target, recursive=True)
        first, chunks, tokens = None, 0, 0
        ends = {".bin": ("ids", "<u2"), "_mask.bin": ("mask", "u1")} if with_mask else {".bin": ("ids", "<u2")}
        part = f"{target}/_part-{uuid.uuid4().hex}"
        with ExitStack() as open_files:
            outs = {end: open_files.enter_context(files.open_output_stream(part + end)) for end in ends}
            for frame in frames:
                if not len(frame):
                    continue
                first = int(frame["chunk_id"].iloc[0]) if first is None else first
                for end, (column, kind) in ends.items():
                    flat = np.concatenate(frame[column].to_list()).astype(kind)
                    outs[end].write(flat.tobytes())
                    tokens += len(flat) if column == "ids" else 0
                chunks += len(frame)
        for end in ends:
            if first is None:
                files.delete_file(part + end)
            else:
                files.move(part + end, f"{target}/part-{first:012d}{end}")
        if first is not None:
            yield pd.DataFrame({"first_chunk": [first], "n_chunks": [chunks], "n_tokens": [tokens]})

    return laid.mapInPandas(put, "first_chunk long, n_chunks long, n_tokens long")


def _read_chunks(spark: SparkSession, folder: str, chunk: int, pattern: str, kind: str, column: str) -> DataFrame:
    """Chunks of the files of a pattern, in pieces of whole chunks, so that one large file is read by many tasks."""
    width = np.dtype(kind).itemsize * chunk
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(folder).select("path", "length")
    whole = F.assert_true(F.col("length") % width == 0, F.concat("path", F.lit(": no whole number of chunks")))
    step = max(1, PIECE // width)
    pieces = files.withColumn("_ok", whole).where("_ok is null and length > 0").select("path", "length", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(length - 1) div {width}"), F.lit(step).cast("long"))).alias("low"))

    def take(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for path, length, low in zip(frame["path"], frame["length"], frame["low"], strict=True):
                system, place = _file_system(path)
                count = min(step, int(length) // width - int(low))
                with system.open_input_file(place) as file:
                    file.seek(int(low) * width)
                    table = np.frombuffer(file.read(count * width), kind).reshape(count, chunk).astype(np.int32)
                first = int(path.rsplit("part-", 1)[1][:12]) + int(low)
                for k in range(0, count, 4096):
                    yield pd.DataFrame({"chunk_id": range(first + k, first + min(count, k + 4096)), column: list(table[k : k + 4096])})

    return pieces.repartition("path", "low").mapInPandas(take, f"chunk_id long, {column} array<int>")


def read_token_file(spark: SparkSession, folder: str, chunk: int) -> DataFrame:
    """``chunk_id`` and ``ids`` of a token file's chunks. A file whose size is no whole number of chunks fails the scan."""
    return _read_chunks(spark, folder, chunk, "part-????????????.bin", "<u2", "ids")


def read_masks(spark: SparkSession, folder: str, chunk: int) -> DataFrame:
    """``chunk_id`` and ``mask`` from the mask files beside a token file; a size that is no whole number of chunks fails."""
    return _read_chunks(spark, folder, chunk, "part-????????????_mask.bin", "u1", "mask")


def token_faults(spark: SparkSession, folder: str, chunk: int) -> DataFrame:
    """``name`` and ``fault`` of token files without a mask, with one of another length, of an odd size, or cut within a chunk."""
    sizes = spark.read.format("binaryFile").option("pathGlobFilter", "part-*.bin").load(folder).select(F.element_at(F.split("path", "/"), -1).alias("file"), "length")
    ids = sizes.where(~F.col("file").endswith("_mask.bin")).select(F.regexp_replace("file", r"\.bin$", "").alias("name"), F.col("length").alias("n_bytes"))
    masks = sizes.where(F.col("file").endswith("_mask.bin")).select(F.regexp_replace("file", r"_mask\.bin$", "").alias("name"), F.col("length").alias("n_mask"))
    fault = (
        F.when(F.col("n_mask").isNull(), "no_mask").when(F.col("n_bytes") % 2 != 0, "odd_size").when(F.col("n_bytes") != 2 * F.col("n_mask"), "mask_length").when(F.col("n_mask") % chunk != 0, "cut_chunk")
    )
    return ids.join(masks, "name", "left").select("name", fault.alias("fault")).where("fault is not null")


def append_tokens(df: DataFrame, folder: str, chunk: int) -> int:
    """Append chunks after those that are there, numbered on; gives the number of the first new one."""
    spark = df.sparkSession
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    there = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where)
    last = read_token_file(spark, folder, chunk).agg(F.max("chunk_id")).head()[0] if there else None
    start = 0 if last is None else int(last) + 1
    token_file(df.withColumn("chunk_id", F.col("chunk_id") + F.lit(start)), folder).collect()
    return start


def side_table(spark: SparkSession, values: dict[str, object], folder: str) -> None:
    """One JSON row of settings and counts beside a result."""
    spark.createDataFrame([(json.dumps(values, sort_keys=True, default=str),)], "value string").coalesce(1).write.mode("overwrite").text(folder)


def markdown(df: DataFrame, most: int = 1000) -> str:
    """A small table as Markdown; one of more than ``most`` rows is refused rather than cut."""
    rows = df.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} rows")
    cell = lambda v: "—" if v is None else str(v).replace("|", "\\|").replace("\n", " ")
    return "\n".join(["| " + " | ".join(df.columns) + " |", "|" + "---|" * len(df.columns), *("| " + " | ".join(map(cell, r)) + " |" for r in rows)]) + "\n"


def publish(df: DataFrame, folder: str) -> None:
    """Write beside the target and swap, so that readers see the old or the new table; an empty one is refused."""
    if not df.head(1):
        raise ValueError("nothing to publish")
    import uuid

    spark = df.sparkSession
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    fresh, target, old = path(f"{folder}.{uuid.uuid4().hex}"), path(folder), path(f"{folder}.old-{uuid.uuid4().hex}")
    df.write.parquet(fresh.toString())
    files = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if files.exists(target):
        files.rename(target, old)
    files.rename(fresh, target)
    files.delete(old, True)
