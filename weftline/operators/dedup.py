"""Exact, template and coupled deduplication."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.functions.text import template_key
from weftline.operators.order import at_most, first_by
from weftline.session import settle


def exact(df: DataFrame, text: Column, order: list[str]) -> DataFrame:
    """First row of each text; null texts are one text."""
    return first_by(df.withColumn("_d", F.sha2(text, 256)), ["_d"], order).drop("_d")


def template_cap(df: DataFrame, text: Column, order: list[str], most: int = 5) -> DataFrame:
    """At most ``most`` rows of each template."""
    return at_most(df.withColumn("_t", template_key(text)), ["_t"], order, most).drop("_t")


def coupled(df: DataFrame, digest: Column, instruction: Column, template: Column, order: str, most: int = 5, rounds: int = 200) -> DataFrame:
    """Rows that a single pass in ``order`` would accept: text and instruction new, template below ``most``.

    Only accepted rows count, so the three conditions depend on each other. A row whose text and
    instruction occur nowhere else and whose template has at most ``most`` rows is accepted at once.
    Of the others, with their keys alone, in each round those are accepted that come first, among
    the undecided, in all of their keys; then every row that now meets an accepted text or
    instruction, or a full template, is rejected. A row always waits only for earlier rows that
    share a key, so the result is that of the single pass, in as many rounds as the longest chain
    of such waits. Beyond ``rounds`` it raises instead of giving a partial result. ``order`` must
    be unique.
    """
    keyed = df.select("*", F.sha2(digest, 256).alias("_d"), F.sha2(instruction, 256).alias("_i"), F.sha2(template, 256).alias("_t")).fillna("", ["_d", "_i", "_t"])
    counted = keyed.select(order, "_d", "_i", "_t")
    for key in ("_d", "_i", "_t"):
        counted = counted.join(counted.groupBy(key).agg(F.count(F.lit(1)).alias(f"_n{key}")), key)
    counted = settle(counted, "counted")
    free = (F.col("_n_d") == 1) & (F.col("_n_i") == 1) & (F.col("_n_t") <= most)
    accepted = counted.where(free).select(order)
    left = settle(counted.where(~free).select(order, "_d", "_i", "_t"), "left")
    taken: DataFrame | None = None
    for _ in range(rounds):
        if not left.head(1):
            accepted = accepted if taken is None else accepted.unionByName(taken.select(order))
            return df.join(accepted, order, "left_semi")
        ready = left
        for key in ("_d", "_i", "_t"):
            first = left.groupBy(key).agg(F.min(order).alias(f"_min{key}"))
            ready = ready.join(first, key).where(F.col(order) == F.col(f"_min{key}")).drop(f"_min{key}")
        ready = ready.select(left.columns)
        taken = settle(ready if taken is None else taken.unionByName(ready), "taken")
        full = taken.groupBy("_t").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= most).select("_t")
        left = settle(left.join(taken.select("_d").distinct(), "_d", "left_anti").join(taken.select("_i").distinct(), "_i", "left_anti").join(full, "_t", "left_anti").select(left.columns), "left")
    raise RuntimeError(f"rows are still undecided after {rounds} rounds")
