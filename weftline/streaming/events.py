"""Event-time windows, in batch and as a stream, from the same expressions."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftline.session import shared_folder


def _watermarked(df: DataFrame, late: str | None) -> DataFrame:
    """Watermarks want a timestamp with a zone; one without is taken in the session's."""
    return df.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late) if late else df


def tumbling(df: DataFrame, width: str, slide: str | None = None, late: str | None = None) -> DataFrame:
    """Count and total by window and type; sliding if ``slide`` is given. On a stream ``late`` is the watermark's delay."""
    rows = _watermarked(df, late)
    window = F.window("ts", width, slide) if slide else F.window("ts", width)
    counted = rows.groupBy(window.alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total"))
    return counted.select(F.col("w.start").alias("start"), "event_type", "n", "total")


def sessions(df: DataFrame, gap: str, late: str | None = None) -> DataFrame:
    """Sessions of each user: from an event to the last that follows within the gap of the one before."""
    rows = _watermarked(df, late)
    return rows.groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count(F.lit(1)).alias("n")).select("user_id", F.col("w.start").alias("start"), "n")


def unique(df: DataFrame, keys: list[str], late: str) -> DataFrame:
    """First of the events with equal keys, as long as the others come within the watermark's delay."""
    return _watermarked(df, late).dropDuplicatesWithinWatermark(keys)


def source(spark: SparkSession, path: str, files: int = 4) -> DataFrame:
    """Stream of the rows of a folder of Parquet files, or of one file, a few files at a time."""
    schema = spark.read.parquet(path).schema
    if path.rstrip("/").endswith(".parquet") and _is_file(spark, path):
        folder, name = path.rsplit("/", 1)
        return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).option("pathGlobFilter", name).parquet(folder)
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(path)


def _is_file(spark: SparkSession, path: str) -> bool:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(where).isFile()


def run_available(df: DataFrame, mode: str = "append", folder: str | None = None, columns: list[str] | None = None) -> str:
    """Run a stream over what there is, into files by micro-batch, and return their folder.

    A batch that is run again replaces what it wrote before, so each row is there once. With the
    same ``folder`` a later call goes on where this one ended.
    """
    spark = df.sparkSession
    folder = folder or f"{shared_folder(spark)}/weftline/stream-{uuid.uuid4().hex}"

    def put(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/out/batch={number}")

    started = df.writeStream.outputMode(mode).foreachBatch(put).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
    started.awaitTermination()
    return folder


def result(spark: SparkSession, folder: str, schema) -> DataFrame:  # noqa: ANN001
    """What a stream wrote to its folder, empty if there was no batch."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{folder}/out")
    if not path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path):
        return spark.createDataFrame([], schema)
    return spark.read.option("basePath", f"{folder}/out").parquet(f"{folder}/out")


def streamed(spark: SparkSession, path: str, width: str) -> DataFrame:
    """Tumbling counts by a stream; each window's last state is its result."""
    counted = tumbling(source(spark, path), width, late="1 day")
    folder = run_available(counted, "update")
    states = result(spark, folder, T.StructType([*counted.schema.fields, T.StructField("batch", T.IntegerType())]))
    last = states.groupBy("start", "event_type").agg(F.max_by(F.struct("n", "total"), "batch").alias("s"))
    return last.select("start", "event_type", "s.n", "s.total")
