"""Order-dependent operators without a single-task window.

A running total over a whole table is taken in two levels: rows are range-partitioned
and sorted once, each part is cumulated where it lies, and the parts' totals (one number
a part) become the offsets of their rows. Totals within groups are the same, with the
group first in the order, less what stands before the group.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from weftline.session import settle

#: Groups that are sent to every executor at most; more are joined by a shuffle.
MOST_GROUPS = 200_000


def _cumulated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches of one sorted part with its number and, of the last column, the total before each row."""
    from pyspark import TaskContext

    part, total = TaskContext.get().partitionId(), 0
    for batch in batches:
        size = batch.num_rows
        if not size:
            continue
        through = pc.cumulative_sum(batch.column(batch.num_columns - 1))
        before = pc.add(pc.subtract(through, batch.column(batch.num_columns - 1)), total)
        total += through[-1].as_py()
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.repeat(pa.scalar(part, pa.int64()), size), before], [*batch.schema.names, "_weft_part", "_weft_in"])


def running_total(df: DataFrame, order: list[str], value: Column | str, name: str = "before") -> DataFrame:
    """``df`` with the total of ``value`` over all rows before each in ``order`` (BIGINT; null counts as 0).

    ``order`` should be unique; rows that tie on it take an arbitrary but fixed order.
    """
    spark = df.sparkSession
    value = F.col(value) if isinstance(value, str) else value
    width = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    laid = df.withColumn("_weft_v", F.coalesce(value.cast("long"), F.lit(0).cast("long"))).repartitionByRange(width, *order).sortWithinPartitions(*order)
    schema = StructType([*laid.schema.fields, StructField("_weft_part", LongType()), StructField("_weft_in", LongType())])
    laid = settle(laid.mapInArrow(_cumulated, schema), "laid")
    sums = laid.groupBy("_weft_part").agg(F.sum("_weft_v").alias("_weft_s"))  # one row for each partition
    offsets = sums.withColumn("_weft_off", F.coalesce(F.sum("_weft_s").over(Window.orderBy("_weft_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).select("_weft_part", "_weft_off")
    return laid.join(F.broadcast(offsets), "_weft_part").withColumn(name, F.col("_weft_off") + F.col("_weft_in")).drop("_weft_v", "_weft_part", "_weft_in", "_weft_off")


def within_groups(df: DataFrame, group: str, order: list[str], value: Column | str, name: str = "before") -> DataFrame:
    """``df`` with the total of ``value`` before each row in its group, and the group's as ``name`` + "_all"; null is a group.

    A group that holds most rows is spread over as many parts as its rows need.
    """
    value = F.col(value) if isinstance(value, str) else value
    laid = running_total(df.withColumn("_weft_w", F.coalesce(value.cast("long"), F.lit(0).cast("long"))), [group, *[c for c in order if c != group]], "_weft_w", name)
    ends = laid.groupBy(F.col(group).alias("_weft_g")).agg(F.min(name).alias("_weft_first"), F.sum("_weft_w").alias(f"{name}_all"))
    few = ends.limit(MOST_GROUPS + 1).count() <= MOST_GROUPS
    return laid.join(F.broadcast(ends) if few else ends, F.col(group).eqNullSafe(F.col("_weft_g"))).withColumn(name, F.col(name) - F.col("_weft_first")).drop("_weft_g", "_weft_first", "_weft_w")


def row_numbers(df: DataFrame, order: list[str], name: str = "row_no") -> DataFrame:
    """``df`` numbered from 0 in ``order``."""
    return running_total(df, order, F.lit(1), name)


def first_by(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row of each key in ``order``; null keys are keys like any other.

    One aggregation with partial results before the shuffle, so a hot key costs a row a task.
    """
    names = [c for c in df.columns if c not in keys]
    rest = F.struct(*order, *[c for c in names if c not in order])
    first = df.groupBy(*keys).agg(F.min_by(rest, F.struct(*order)).alias("_f"))
    return first.select(*[F.col(c) if c in keys else F.col(f"_f.{c}").alias(c) for c in df.columns])


def at_most(df: DataFrame, keys: list[str], order: list[str], most: int) -> DataFrame:
    """The first ``most`` rows of each key; Spark cuts the window's groups before the shuffle."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= most).drop("_n")


def hashed_sample(df: DataFrame, key: str, size: int, seed: int = 42) -> DataFrame:
    """``size`` rows that depend on nothing but their keys and the seed; of the MD5 of both, so that other systems can follow."""
    return df.orderBy(F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string"))), key).limit(size)


def every_nth(df: DataFrame, group: str, order: list[str], target: int) -> DataFrame:
    """Every max(1, n div target)-th row of each group of n rows."""
    numbered = within_groups(df, group, order, F.lit(1), "_n")
    return numbered.where(F.col("_n") % F.greatest(F.lit(1), F.floor(F.col("_n_all") / target)) == 0).drop("_n", "_n_all")


def even_pick(df: DataFrame, order: list[str], size: int) -> DataFrame:
    """``size`` rows spread evenly over the order, both ends included, with half-even rounding."""
    numbered = row_numbers(df, order, "_n")
    total = numbered.agg(F.count(F.lit(1)).alias("_c"))
    step = F.when(F.lit(size) > 1, (F.col("_c") - 1) / F.lit(max(1, size - 1))).otherwise(F.lit(0.0))
    places = F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda k: F.bround(k * step).cast("long"))
    return numbered.crossJoin(F.broadcast(total)).where((F.col("_c") <= size) | F.array_contains(places, F.col("_n"))).drop("_n", "_c")


def quota(df: DataFrame, group: str, order: list[str], size: Column, most: int, unit: list[str] | None = None) -> DataFrame:
    """Rows of each group while the total before them is below ``most``; 0 is no limit.

    The row that crosses the quota stays. With ``unit`` whole units (documents, say) stay or go:
    the total is that before the unit's first row.
    """
    if most == 0:
        return df
    before = within_groups(df, group, order, size, "_b").drop("_b_all")
    if unit:
        # a unit is a document or the like: its rows are few
        before = before.withColumn("_b", F.min("_b").over(Window.partitionBy(group, *unit)))
    return before.where(F.col("_b") < most).drop("_b")


def until_total(df: DataFrame, order: list[str], size: str, target: int) -> DataFrame:
    """Rows in order while the total before them is below the target, exactly."""
    return running_total(df, order, size, "_b").where(F.col("_b") < target).drop("_b")
