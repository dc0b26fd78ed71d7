"""Queries of the whole flows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.operators import flows
from weftline.operators.order import first_by, row_numbers
from weftline.plans.catalog import query
from weftline.plans.packs import _TOKENS, CHUNK, point_ids
from weftline.session import settle, table, texts


@query()
def x_build_corpus(spark: SparkSession, folder: str) -> DataFrame:
    """Accepted files by split."""
    return flows.build_corpus(texts(spark, folder)).groupBy("split").agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("clean")).alias("n_chars"))


_TAG = r"'(?m)^(?:<(?:gh_stars|reponame|filename)>[^<\n]*)+\n?'"


@query(
    f"""
WITH k AS (SELECT regexp_replace(text, {_TAG}, '', 'g') AS t FROM documents WHERE ends_with(path, '.py') AND length(text) >= 50)
SELECT CASE WHEN CAST('0x' || left(md5(left(t, 200)), 8) AS BIGINT) % 50 = 0 THEN 'val' ELSE 'train' END AS split, count(*) AS n FROM k
WHERE regexp_matches(t, '[^\\s\\x85\\x{{a0}}\\x{{1680}}\\x{{2000}}-\\x{{200a}}\\x{{2028}}\\x{{2029}}\\x{{202f}}\\x{{205f}}\\x{{3000}}\\x1c-\\x1f\\x0b]') GROUP BY 1
"""
)
def x_build_corpus_language_only(spark: SparkSession, folder: str) -> DataFrame:
    """The baseline arm by split."""
    return flows.build_corpus(table(spark, folder, "documents"), filters=False).groupBy("split").agg(F.count(F.lit(1)).alias("n"))


@query()
def x_build_signature_pairs(spark: SparkSession, folder: str) -> DataFrame:
    """Pairs of signature and body from all documents."""
    return flows.build_signature_pairs(texts(spark, folder), "doc_id")


def _instructions(spark: SparkSession, folder: str) -> DataFrame:
    first = first_by(table(spark, folder, "prompt_solution").select("pair_id", "loaded_at", "prompt", "solution"), ["pair_id"], ["loaded_at"])
    return flows.build_instruction_pairs(row_numbers(first, ["pair_id"], "at"), "at", most_prompt=2_000, most_code=20_000)


@query()
def x_build_instruction_pairs(spark: SparkSession, folder: str) -> DataFrame:
    """Instruction pairs that pass all gates; lengths in characters."""
    return _instructions(spark, folder)


@query()
def x_pack_pairs(spark: SparkSession, folder: str) -> DataFrame:
    """Those pairs as chunks by split, an id a code point."""
    return flows.pack_pairs(settle(_instructions(spark, folder), "pairs"), "at", point_ids, CHUNK)


@query(
    f"""
WITH {_TOKENS}, c AS (SELECT pos // {CHUNK} AS chunk_id, count(*) AS n, sum(kept) AS loss, max(id) AS top FROM tok, total WHERE pos // {CHUNK} < total // {CHUNK} GROUP BY 1)
SELECT 'train' AS split, 'chunks' AS "check", CAST(count(*) AS BIGINT) AS n FROM c UNION ALL SELECT 'train', 'tokens', CAST(sum(n) AS BIGINT) FROM c UNION ALL SELECT 'train', 'loss_tokens', CAST(sum(loss) AS BIGINT) FROM c
UNION ALL SELECT 'train', 'fault_no_loss', count(*) FROM c WHERE loss = 0 HAVING count(*) > 0 UNION ALL SELECT 'train', 'fault_vocabulary', count(*) FROM c WHERE top >= 5000 HAVING count(*) > 0
"""
)
def x_verify_pack(spark: SparkSession, folder: str) -> DataFrame:
    """All pairs packed with the loss kept beyond chunk ends, and what the check says of the chunks."""
    rows = table(spark, folder, "prompt_solution").where("prompt is not null and solution is not null")
    first = first_by(rows.select("pair_id", "loaded_at", "prompt", "solution"), ["pair_id"], ["loaded_at"])
    packed = settle(flows.pack_pairs(first.withColumn("split", F.lit("train")), "pair_id", point_ids, CHUNK), "chunks")
    return flows.verify_pack(packed, CHUNK, 5000)
