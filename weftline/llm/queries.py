"""Queries of the training-data problems, by name, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.llm import credentials, handwritten, leaks, near, packing, subjects, tokens
from weftline.session import table, texts


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    """Documents with the evaluation items of which they have five lines in a row, or all, in their order."""
    return leaks.leaked(texts(spark, folder), table(spark, folder, "heldout_problems"), reordered=False).select("doc_id", "item_id")


def p1_reordered(spark: SparkSession, folder: str) -> DataFrame:
    """Documents that hold most of an evaluation item, in order or not, with the share that tiles cover."""
    found = leaks.leaked(texts(spark, folder), table(spark, folder, "heldout_problems"))
    return found.where(F.col("covered") >= leaks.COVERED).select("doc_id", "item_id", F.round("covered", 4).alias("covered"), "in_order")


def p1_by_item(spark: SparkSession, folder: str) -> DataFrame:
    """For each evaluation item that leaked: how many documents have it, and the most lines in a row of it."""
    found = leaks.leaked(texts(spark, folder), table(spark, folder, "heldout_problems"), reordered=False)
    return found.groupBy("item_id").agg(F.count(F.lit(1)).alias("n_documents"), F.max("lines").alias("most_lines"))


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    """Credentials written out in documents."""
    return credentials.found(texts(spark, folder))


def p2_redacted(spark: SparkSession, folder: str) -> DataFrame:
    """Documents with their credentials replaced."""
    return credentials.redacted(texts(spark, folder))


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    """Files that are generated, minified, copied or data."""
    return handwritten.found(texts(spark, folder))


def p3_kinds(spark: SparkSession, folder: str) -> DataFrame:
    """The same files with what they are."""
    return handwritten.kinds(texts(spark, folder))


def _similar(spark: SparkSession, folder: str) -> near.Similar:
    return near.Similar(near.record_sets(texts(spark, folder), table(spark, folder, "prompt_solution")))


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    """Pairs of records of one table that share most of their content."""
    return _similar(spark, folder).found()


def p4_classes(spark: SparkSession, folder: str) -> DataFrame:
    """Each record with its class of equal content and the number of similar classes."""
    return _similar(spark, folder).membership().withColumnRenamed("set", "record_set")


def p5_ids(spark: SparkSession, folder: str) -> DataFrame:
    """Token ids of every document."""
    return tokens.with_ids(texts(spark, folder))


def p6_containers(spark: SparkSession, folder: str) -> DataFrame:
    """Containers of every document, for each profile."""
    return packing.containers(texts(spark, folder), table(spark, folder, "pack_profiles"))


def p6_summary(spark: SparkSession, folder: str) -> DataFrame:
    """Containers used for each profile against the least that the tokens could need."""
    profiles = table(spark, folder, "pack_profiles")
    return packing.summary(packing.containers(texts(spark, folder), profiles), profiles)


def _areas(spark: SparkSession, folder: str) -> DataFrame:
    return subjects.subject_areas(texts(spark, folder), table(spark, folder, "subject_labels"), table(spark, folder, "subjects"))


def p7_found(spark: SparkSession, folder: str) -> DataFrame:
    """Documents with their subject areas."""
    return _areas(spark, folder).select("doc_id", "subject").distinct()


def p7_composition(spark: SparkSession, folder: str) -> DataFrame:
    """Documents by subject, whole and in shares."""
    return _areas(spark, folder).groupBy("subject").agg(F.countDistinct("doc_id").alias("n_documents"), F.round(F.sum("share"), 4).alias("shares"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    every = (p1_found, p1_by_item, p1_reordered, p2_found, p2_redacted, p3_found, p3_kinds, p4_found, p4_classes, p5_ids, p6_containers, p6_summary, p7_found, p7_composition)
    return {f.__name__: f for f in every}


_SETS = """
WITH records AS (
  SELECT DISTINCT 'documents' AS record_set, doc_id AS id, text FROM documents WHERE text IS NOT NULL
  UNION ALL
  SELECT DISTINCT 'prompt_solution', pair_id, solution FROM prompt_solution WHERE solution IS NOT NULL
), words AS (
  SELECT record_set, id, list_transform(regexp_extract_all(text, '[A-Za-z0-9_]+'), lambda w: lower(w)) AS w FROM records
), runs AS (
  SELECT DISTINCT record_set, id, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS run
  FROM (SELECT record_set, id, w, unnest(range(1, len(w) - 1)) AS i FROM words WHERE len(w) >= 3)
), sizes AS (SELECT record_set, id, count(*) AS n FROM runs GROUP BY ALL)
"""

SQL = {
    "p4_found": _SETS
    + """
, common AS (
  SELECT a.record_set, a.id AS id_a, b.id AS id_b, count(*) AS c
  FROM runs a JOIN runs b ON a.record_set = b.record_set AND a.run = b.run AND a.id < b.id
  GROUP BY ALL
)
SELECT c.record_set, c.id_a, c.id_b
FROM common c
JOIN sizes x ON x.record_set = c.record_set AND x.id = c.id_a
JOIN sizes y ON y.record_set = c.record_set AND y.id = c.id_b
WHERE 10 * c.c >= 6 * (x.n + y.n - c.c)
""",
}
