"""Session settings and tables that cut lineage."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
import warnings
import zipfile

from py4j.protocol import Py4JError
from pyspark.sql import DataFrame, SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.showConsoleProgress": "false",
}


def build_session(master: str | None = None, app: str = "weftline", **extra: str) -> SparkSession:
    """Return a session with the settings the operators assume; an existing session is reused."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**SETTINGS, **extra}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """Folder that every executor can reach.

    It is what the cluster names in ``spark.checkpoint.dir``. Only where nothing is
    set, as in tests on one machine, a folder of our own is made and set.
    """
    context = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not found:
        found = "file://" + tempfile.mkdtemp(prefix="weftline-")
        context.setCheckpointDir(found)
    return found.rstrip("/")


_SETTLED: list[str] = []


def _remove(spark: SparkSession, folder: str) -> bool:
    """Whether the folder could be removed; with the session gone only a local one can."""
    try:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
    except (Py4JError, ConnectionError, AttributeError):
        local = folder.removeprefix("file://")
        if not os.path.isdir(local):
            return False
        shutil.rmtree(local, ignore_errors=True)
    return True


def settle(df: DataFrame, name: str = "table") -> DataFrame:
    """Write ``df`` once to the shared folder and return a scan of it.

    Cuts the lineage like ``checkpoint()``, survives the loss of executors, and as
    columnar files it stays small and lets later steps prune columns.
    """
    spark = df.sparkSession
    folder = f"{shared_folder(spark)}/weftline/{name}-{uuid.uuid4().hex}"
    df.write.mode("errorifexists").option("compression", "zstd").parquet(folder)
    if not _SETTLED:
        atexit.register(forget, spark)
    _SETTLED.append(folder)
    return spark.read.schema(df.schema).parquet(folder)


def forget(spark: SparkSession) -> None:
    """Remove the tables settled so far. Results that still read them must have been written by then."""
    kept = [folder for folder in _SETTLED if not _remove(spark, folder)]
    _SETTLED.clear()
    if kept:
        warnings.warn(f"{len(kept)} settled tables are left, the first in {kept[0]}", stacklevel=2)


_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Give this package to the executors' Python, once an application, so that a query runs from any folder."""
    context = spark.sparkContext
    if context.applicationId in _SHIPPED:
        return
    home = os.path.dirname(os.path.abspath(__file__))
    folder = tempfile.mkdtemp(prefix="weftline-ship-")
    archive = os.path.join(folder, "weftline.zip")
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as out:
        for place, _, names in sorted(os.walk(home)):
            for name in sorted(names):
                if name.endswith(".py"):
                    path = os.path.join(place, name)
                    out.write(path, os.path.relpath(path, os.path.dirname(home)))
    context.addPyFile(archive)
    _SHIPPED.add(context.applicationId)
    atexit.register(shutil.rmtree, folder, True)


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """Scan of one input table, a file or a folder of files."""
    return spark.read.parquet(os.path.join(folder, f"{name}.parquet"))


def spread(df: DataFrame) -> DataFrame:
    """``df`` over all cores where its files give fewer partitions than that, else as it is.

    A large input has more splits than cores and is left alone; a small one that lies in a
    single file would keep a text-heavy projection on one core.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() * 2 <= cores else df


def texts(spark: SparkSession, folder: str, name: str = "documents") -> DataFrame:
    """Scan of a table of texts, spread for work that is heavy on each row."""
    return spread(table(spark, folder, name))
