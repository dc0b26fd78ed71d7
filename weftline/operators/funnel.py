"""Ordered rejection of source files: one column says why, and everything else derives from it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.functions import rules, text
from weftline.operators.splits import md5_split

LEAST_CHARS = 50


def first_stage(path: Column, body: Column, layers: dict[str, rules.Rules] = rules.CORPUS_LAYERS) -> Column:
    """Language, file name, length and layers L1 to L3, on the text as it came."""
    return F.coalesce(
        F.when(~F.coalesce(F.endswith(path, F.lit(".py")), F.lit(False)), "non_python"),
        F.when(rules.file_excluded(path), "filename_filtered"),
        F.when(F.coalesce(F.length(body), F.lit(0)) < LEAST_CHARS, "too_short"),
        F.when(rules.first_reason(body, layers["L1"]).isNotNull(), "L1_framework"),
        F.when(rules.first_reason(body, layers["L2"]).isNotNull(), "L2_python2"),
        F.when(rules.first_reason(body, layers["L3"]).isNotNull(), "L3_config"),
    )


def second_stage(body: Column, layers: dict[str, rules.Rules] = rules.CORPUS_LAYERS) -> Column:
    """Layers L4 to L6, on the scrubbed text."""
    return F.coalesce(
        F.when(rules.first_reason(body, layers["L4"]).isNotNull(), "L4_tests"),
        F.when(text.quality_reason(body).isNotNull(), "L5_quality"),
        F.when(rules.autogenerated_reason(body).isNotNull(), "L6_autogen"),
    )


def verdicts(df: DataFrame, path: str = "path", body: str = "text", scrub: bool = True) -> DataFrame:
    """``df`` with ``clean`` (the scrubbed text), ``reason`` (accepted, or the first rule broken), ``was_stripped`` and ``split``.

    A row without a text has the reason its path gives, else too_short. There is no shuffle: the verdict is a
    projection, and the scrub reaches Python for texts with a shebang or a licence word that passed so far.
    """
    found = text.let(F.struct(F.col(path).alias("p"), F.col(body).alias("b")), lambda r: first_stage(r["p"], r["b"]))
    first = df.withColumn("_first", found)
    clean = text.strip_copyright(F.when(F.col("_first").isNull(), F.col(body))) if scrub else F.col(body)
    cleaned = first.withColumn("clean", F.coalesce(clean, F.col(body)))
    # inside a lambda the optimizer leaves the rules whole; a filter on the reason would unfold them branch by branch
    second = text.let(F.col("clean"), lambda c: F.coalesce(second_stage(c), F.lit("accepted")))
    judged = cleaned.withColumn("reason", F.coalesce(F.col("_first"), second))
    return judged.withColumn("was_stripped", F.coalesce(F.col("_first").isNull() & (F.col("clean") != F.col(body)), F.lit(False))).withColumn("split", F.when(F.col("reason") == "accepted", md5_split(F.col("clean")))).drop("_first")


def counts(judged: DataFrame, *by: str) -> DataFrame:
    return judged.groupBy(*by, "reason").agg(F.count(F.lit(1)).alias("n"))


def residue(df: DataFrame, body: str = "text") -> DataFrame:
    """For each audit literal, the rows that still hold it."""
    sums = [F.sum(F.coalesce(F.contains(F.col(body), F.lit(p)), F.lit(False)).cast("long")).alias(f"h{k}") for k, p in enumerate(rules.POISON)]
    pairs = F.array(*[F.struct(F.lit(p).alias("pattern"), F.coalesce(F.col(f"h{k}"), F.lit(0)).alias("hits")) for k, p in enumerate(rules.POISON)])
    return df.agg(*sums).select(F.inline(pairs))


def language_only(df: DataFrame, path: str = "path", body: str = "text") -> DataFrame:
    """Baseline arm: language and length alone, metadata tags taken off."""
    kept = df.where(F.endswith(F.col(path), F.lit(".py")) & (F.length(body) >= LEAST_CHARS))
    return kept.withColumn(body, text.strip_meta_lines(F.col(body))).where(~text.blank(F.col(body)))
