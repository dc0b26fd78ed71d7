"""Deterministic splits by hash."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftline.functions.text import blake2b_bucket
from weftline.operators.order import running_total


def md5_bucket(text: Column, chars: int = 200) -> Column:
    """Number of the first 8 hex digits of the MD5 of the text's first characters."""
    return F.conv(F.substring(F.md5(F.substring(text, 1, chars)), 1, 8), 16, 10).cast("long")


def md5_split(text: Column, modulus: int = 50) -> Column:
    """val for one text in ``modulus``, else train."""
    return F.when(md5_bucket(text) % modulus == 0, "val").otherwise("train")


def digest_split(sample: Column, ratio: float) -> Column:
    """val where the digest of the sample falls below the ratio, in 10,000 steps."""
    return F.when(blake2b_bucket(sample) < int(ratio * 10_000), "val").otherwise("train")


def promote(df: DataFrame, length: str, order: str, least: int, split: str = "split") -> DataFrame:
    """Move the longest train rows (the earlier of equals) to val until val has ``least``; raises if train hasn't enough."""
    have = df.where(F.col(split) == "val").agg(F.coalesce(F.sum(length), F.lit(0))).head()[0]
    if have >= least:
        return df
    train = df.where(F.col(split) == "train").withColumn("_neg", -F.col(length))
    ranked = running_total(train, ["_neg", order], length, "_before")
    total = train.agg(F.coalesce(F.sum(length), F.lit(0))).head()[0]
    if have + total < least:
        raise ValueError(f"all rows together have {have + total} of {least}")
    moved = ranked.withColumn(split, F.when(F.col("_before") < least - have, "val").otherwise("train")).select(df.columns)
    return df.where(f"{split} is null or {split} <> 'train'").unionByName(moved)


def seeded(df: DataFrame, key: str, count: int) -> DataFrame:
    """Each row ``count`` times with ids key#k0, key#k1 and so on."""
    return df.withColumn("k_index", F.explode(F.sequence(F.lit(0), F.lit(count - 1)))).withColumn("candidate_id", F.concat(key, F.lit("#k"), F.col("k_index").cast("string")))


def rank_in(df: DataFrame, group: list[str], order: list[Column], name: str = "place") -> DataFrame:
    """Rank within a group; equals share a rank."""
    return df.withColumn(name, F.rank().over(Window.partitionBy(*group).orderBy(*order)))
