"""Joins of problems, candidates and results, and of tables of evaluations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftline.operators.order import first_by
from weftline.session import settle


def base_id(c: Column) -> Column:
    """Problem of a candidate: the id before ``#k``."""
    return F.split_part(c, F.lit("#k"), F.lit(1))


def executed(results: DataFrame, candidates: DataFrame, problems: DataFrame, include_failed: bool = False) -> DataFrame:
    """Each result with its candidate's code and its problem's prompt, and the ``outcome``.

    Of candidates with one id the first by (k_index, seed_used, completion) counts, even if it is
    empty, which is as good as none. Of problems with one id the last by prompt counts. A
    candidate's id may be a problem's, else what stands before ``#k`` is. Results stay as many as they are.
    """
    code = first_by(candidates.where("id is not null").select("id", "k_index", "seed_used", "completion"), ["id"], ["k_index", "seed_used", "completion"]).select(F.col("id").alias("_cid"), F.col("completion").alias("code"))
    last = problems.where("id is not null").groupBy("id").agg(F.max_by(F.struct("prompt", "entry"), F.struct("prompt", "entry")).alias("p"))
    prompts = last.select(F.col("id").alias("_pid"), F.col("p.prompt").alias("_prompt"), F.col("p.entry").alias("_entry"))
    whole = prompts.select(F.col("_pid").alias("_wid"), F.col("_prompt").alias("_wprompt"), F.col("_entry").alias("_wentry"))
    joined = (
        results.join(code, results["id"] == F.col("_cid"), "left")
        .join(whole, results["id"] == F.col("_wid"), "left")
        .join(prompts, base_id(results["id"]) == F.col("_pid"), "left")
    )
    prompt = F.when(F.col("_wid").isNotNull(), F.col("_wprompt")).otherwise(F.col("_prompt"))
    outcome = (
        F.when(~F.coalesce(F.col("passed"), F.lit(False)) & F.lit(not include_failed), "skipped_failed")
        .when(F.coalesce(F.col("code"), F.lit("")) == "", "skipped_no_candidate")
        .when(F.coalesce(prompt, F.lit("")) == "", "skipped_no_problem")
        .otherwise("kept")
    )
    return joined.select(results["id"], F.col("passed"), F.col("code"), prompt.alias("instruction"), F.coalesce("_wentry", "_entry").alias("entry"), base_id(results["id"]).alias("group"), outcome.alias("outcome"))


def looked_up(candidates: DataFrame, problems: DataFrame, results: DataFrame) -> DataFrame:
    """Candidates with a verdict: NO_PROBLEM, NO_RESULT, PASS or the reason of failure."""
    known = problems.where("id is not null").select(F.col("id").alias("_pid")).distinct()
    verdict = results.where("id is not null").groupBy("id").agg(F.max_by(F.struct("passed", "reason"), F.struct("received_at", "passed", "reason")).alias("r")).withColumnRenamed("id", "_rid")
    joined = candidates.join(known, base_id(F.col("id")) == F.col("_pid"), "left").join(verdict, F.col("id") == F.col("_rid"), "left")
    word = F.when(F.col("_pid").isNull(), "NO_PROBLEM").when(F.col("_rid").isNull(), "NO_RESULT").when(F.coalesce(F.col("r.passed"), F.lit(False)), "PASS").otherwise(F.coalesce(F.col("r.reason"), F.lit("UNKNOWN")))
    return joined.select("id", "k_index", word.alias("verdict"))


def upsert(before: DataFrame, now: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of ``before`` whose keys ``now`` hasn't, and all of ``now``; columns that one lacks are null."""
    return before.join(now.select(*keys).distinct(), keys, "left_anti").unionByName(now, allowMissingColumns=True)


def nearest(left: DataFrame, right: DataFrame, at: str, value: str, within: int) -> DataFrame:
    """Each row of ``left`` with the ``value`` of the row of ``right`` nearest in ``at``, no farther than ``within``.

    The smaller ``at`` wins a tie, then the smaller value. Both sides meet on buckets as wide
    as the reach: a row looks into its own bucket and the two beside it.
    """
    bucket = F.floor(F.col(at) / within).cast("long")
    # ids are written once: a stage that is run again could number the rows another way
    a = settle(left.withColumn("_id", F.monotonically_increasing_id()), "numbered").withColumn("_b", F.explode(F.array(bucket - 1, bucket, bucket + 1)))
    b = right.select(F.col(at).alias("_at"), F.col(value).alias(f"{value}_right")).withColumn("_b", F.floor(F.col("_at") / within).cast("long"))
    near = a.join(b, "_b").where(F.abs(F.col(at) - F.col("_at")) <= within).withColumn("_gap", F.abs(F.col(at) - F.col("_at")))
    keys = [c for c in left.columns]
    best = near.groupBy("_id", *keys).agg(F.min(F.struct("_gap", "_at", f"{value}_right")).alias("_m"))
    return best.select(*keys, F.col("_m._at").alias(f"{at}_right"), F.col(f"_m.{value}_right").alias(f"{value}_right"))


def overridden(built_in: DataFrame, custom: DataFrame, key: str = "name") -> DataFrame:
    """Custom rows, and the built-in ones whose key no custom row has."""
    return built_in.join(custom.select(key).distinct(), key, "left_anti").unionByName(custom)


def latest(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Last row of each key in ``order``."""
    w = Window.partitionBy(*keys).orderBy(*[F.col(c).desc_nulls_last() for c in order])
    return df.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")
