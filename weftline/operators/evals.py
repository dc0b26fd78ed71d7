"""Aggregates over verdicts, training logs and checkpoints."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def pass_rate(df: DataFrame, by: list[str], passed: str = "passed") -> DataFrame:
    """Passes and totals; a null verdict is no pass."""
    ok = F.coalesce(F.col(passed), F.lit(False)).cast("long")
    return df.groupBy(*by).agg(F.sum(ok).alias("k"), F.count(F.lit(1)).alias("n")).withColumn("rate", F.round(F.col("k") / F.col("n"), 4))


def fractions(df: DataFrame, by: str, task: str, passed: str = "passed") -> DataFrame:
    """Map from task to "k/n"."""
    rates = pass_rate(df, [by, task], passed)
    pairs = F.sort_array(F.collect_list(F.struct(F.col(task), F.concat(F.col("k").cast("string"), F.lit("/"), F.col("n").cast("string")))))
    return rates.groupBy(by).agg(F.map_from_entries(pairs).alias("tasks"))


def sum_fractions(tasks: Column) -> Column:
    """(k, n) summed over a map of "k/n"; values that are none are left out."""
    parts = F.filter(F.map_values(tasks), lambda v: F.rlike(v, F.lit(r"^\d+/\d+$")))
    return F.struct(
        F.aggregate(parts, F.lit(0).cast("long"), lambda a, v: a + F.split_part(v, F.lit("/"), F.lit(1)).cast("long")).alias("k"),
        F.aggregate(parts, F.lit(0).cast("long"), lambda a, v: a + F.split_part(v, F.lit("/"), F.lit(2)).cast("long")).alias("n"),
    )


def rescaled(k: Column, n: Column, to: int) -> Column:
    """k of n as a score out of ``to``, with one decimal; null without any."""
    return F.round(F.try_divide(k, n) * to, 1)


def pass_percent(k: Column, n: Column) -> Column:
    return F.when(n > 0, F.round(100 * k / F.greatest(n, F.lit(1)), 2))


def weighted_mean(value: str, weight: str) -> Column:
    """Sum of value times weight over the sum of weights, at least 1; rows with a null value don't count."""
    w = F.when(F.col(value).isNotNull(), F.col(weight))
    return F.coalesce(F.sum(F.col(value) * w), F.lit(0.0)) / F.greatest(F.coalesce(F.sum(w), F.lit(0)), F.lit(1))


def trailing_mean(df: DataFrame, by: str, order: list[str], value: str, rows: int, name: str = "mean") -> DataFrame:
    w = Window.partitionBy(by).orderBy(*order).rowsBetween(1 - rows, Window.currentRow)
    return df.withColumn(name, F.avg(value).over(w))


def best_so_far(df: DataFrame, by: str, order: list[str], value: str) -> DataFrame:
    """Running minimum and whether the row sets a new one; null values set none."""
    w = Window.partitionBy(by).orderBy(*order)
    best = F.min(value).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    before = F.min(value).over(w.rowsBetween(Window.unboundedPreceding, -1))
    return df.withColumn("best", best).withColumn("is_new", F.coalesce(F.col(value).isNotNull() & (before.isNull() | (F.col(value) < before)), F.lit(False)))


def learning_rate(step: Column, peak: float, warmup: int, stable: int, total: int, least: float = 0.1) -> Column:
    """Warm-up, plateau, and cosine decay to ``least`` of the peak."""
    decay = F.least(F.greatest((step - stable) / max(1, total - stable), F.lit(0.0)), F.lit(1.0))
    cosine = least + (1 - least) * 0.5 * (1 + F.cos(F.lit(3.141592653589793) * decay))
    return F.lit(peak) * F.when(step < warmup, (step + 1) / warmup).when(step < stable, F.lit(1.0)).otherwise(cosine)


def average_vectors(df: DataFrame, vector: str, weight: Column | None = None, by: list[str] | None = None) -> DataFrame:
    """Element-wise weighted mean of vectors, by position, so partial sums meet and not vectors."""
    weight = F.lit(1.0) if weight is None else weight
    flat = df.select(*(by or []), weight.alias("_w"), F.posexplode(vector).alias("_k", "_x"))
    means = flat.groupBy(*(by or []), "_k").agg((F.sum(F.col("_w") * F.col("_x")) / F.sum("_w")).alias("_m"))
    return means.groupBy(*(by or [])).agg(F.transform(F.sort_array(F.collect_list(F.struct("_k", "_m"))), lambda s: s["_m"]).alias(vector))


def step_weights(df: DataFrame, low: Column, low_share: float = 0.3) -> DataFrame:
    """``weight``: ``low_share`` spread over the rows where ``low`` holds, the rest over the others; all to one side if the other is empty."""
    marked = df.withColumn("_low", F.coalesce(low, F.lit(False)))
    sizes = marked.agg(F.sum(F.col("_low").cast("int")).alias("_nl"), F.sum((~F.col("_low")).cast("int")).alias("_nh"))
    share = F.when((F.col("_nl") == 0) | (F.col("_nh") == 0), 1.0).otherwise(F.when(F.col("_low"), low_share).otherwise(1 - low_share))
    return marked.crossJoin(F.broadcast(sizes)).withColumn("weight", share / F.when(F.col("_low"), F.col("_nl")).otherwise(F.col("_nh"))).drop("_low", "_nl", "_nh")


def blend(a: Column, b: Column, alpha: float) -> Column:
    """(1 - alpha) a + alpha b, or a where the lengths differ."""
    return F.when(F.size(a) == F.size(b), F.zip_with(a, b, lambda x, y: (1 - alpha) * x + alpha * y)).otherwise(a)


def first_places(df: DataFrame, by: str, who: str, score: str) -> DataFrame:
    """How often each one comes first; those level share the place."""
    ranked = df.withColumn("_r", F.rank().over(Window.partitionBy(by).orderBy(F.col(score).desc())))
    return ranked.groupBy(who).agg(F.sum((F.col("_r") == 1).cast("long")).alias("firsts"))


def retained(df: DataFrame, step: str, milestone: int, keep: int = 2) -> DataFrame:
    """Steps that are milestones, or younger than ``keep`` milestones before the last step."""
    last = F.broadcast(df.agg(F.max(step).alias("_m")))
    return df.crossJoin(last).where((F.col(step) % milestone == 0) | (F.col(step) >= F.col("_m") - keep * milestone)).drop("_m")
