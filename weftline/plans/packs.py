"""Queries over packed chunks. Samples are pairs with an id for each code point of their whole texts, as the core has no tokenizer."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.operators import order, packs
from weftline.plans.catalog import query
from weftline.session import table

CHUNK = 257

#: Ids of code points begin after the reserved ones (4 ends a sample, 2 and 3 are never text); code points that wouldn't fit 16 bits share one.
FIRST_ID, UNKNOWN, MOST_POINT = 5, 1, 60_000

_SAMPLES = """
s AS (
  SELECT pair_id, prompt, solution, length(prompt) AS p, length(solution) AS q FROM (
    SELECT *, row_number() OVER (PARTITION BY pair_id ORDER BY loaded_at) AS r FROM prompt_solution WHERE prompt IS NOT NULL AND solution IS NOT NULL) WHERE r = 1
), laid AS (
  SELECT pair_id, prompt || solution AS body, p, q, p + q + 1 AS n, CAST(coalesce(sum(p + q + 1) OVER (ORDER BY pair_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS off FROM s
)"""
_TOKENS = (
    _SAMPLES
    + f""", tok AS (
  SELECT pair_id, off, p, n, off + i AS pos, i, CASE WHEN i = n - 1 THEN 4 WHEN unicode(substr(body, i + 1, 1)) < {MOST_POINT} THEN unicode(substr(body, i + 1, 1)) + {FIRST_ID} ELSE {UNKNOWN} END AS id,
    CASE WHEN i >= p AND i < {CHUNK} - off % {CHUNK} THEN 1 ELSE 0 END AS mask, CASE WHEN i >= p THEN 1 ELSE 0 END AS kept
  FROM laid, LATERAL (SELECT unnest(range(0, n)) AS i)
), total AS (SELECT sum(n) AS total FROM laid)"""
)


def point_ids(text: Column) -> Column:
    """An id for each code point of the text."""
    points = F.regexp_extract_all(text, F.lit("(?s)."), F.lit(0))
    return F.transform(points, lambda c: F.when(F.ascii(c) < MOST_POINT, F.ascii(c) + FIRST_ID).otherwise(UNKNOWN))


def samples(spark: SparkSession, folder: str) -> DataFrame:
    """``pair_id``, ``ids`` and ``mask`` of each pair, the first delivery of each."""
    rows = table(spark, folder, "prompt_solution").where("prompt is not null and solution is not null")
    first = order.first_by(rows.select("pair_id", "loaded_at", "prompt", "solution"), ["pair_id"], ["loaded_at"])
    return first.select("pair_id", F.inline(F.array(packs.sample(point_ids(F.col("prompt")), point_ids(F.col("solution"))))))


@query(f"WITH {_SAMPLES} SELECT pair_id, CAST(n AS BIGINT) AS n, CAST(q + 1 AS BIGINT) AS loss FROM laid")
def p_sample_layout(spark: SparkSession, folder: str) -> DataFrame:
    loss = F.aggregate("mask", F.lit(0).cast("long"), lambda a, m: a + m)
    return samples(spark, folder).select("pair_id", F.size("ids").cast("long").alias("n"), loss.alias("loss"))


@query("SELECT doc_id, md5(text || '<eos>') AS digest FROM documents WHERE text IS NOT NULL")
def p_eos_append(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "documents").where("text is not null").select("doc_id", F.md5(F.concat("text", F.lit("<eos>"))).alias("digest"))


@query(f"WITH {_SAMPLES} SELECT pair_id, off FROM laid")
def p_offsets(spark: SparkSession, folder: str) -> DataFrame:
    return packs.with_offsets(samples(spark, folder), ["pair_id"]).select("pair_id", F.col("off").cast("long").alias("off"))


@query(f"WITH {_TOKENS} SELECT pair_id, CAST(sum(mask) AS BIGINT) AS loss, any_value(n) > {CHUNK} - any_value(off) % {CHUNK} AS crosses FROM tok GROUP BY 1")
def p_cross_policy(spark: SparkSession, folder: str) -> DataFrame:
    laid = packs.with_offsets(samples(spark, folder), ["pair_id"])
    mask = packs.crossing_mask(F.col("mask"), F.col("off"), CHUNK)
    loss = F.aggregate(mask, F.lit(0).cast("long"), lambda a, m: a + m)
    return laid.select("pair_id", loss.alias("loss"), packs.crosses(F.col("off"), F.size("ids"), CHUNK).alias("crosses"))


@query(f"WITH {_SAMPLES} SELECT CAST(sum(n) AS BIGINT) AS tokens, CAST(sum(n) // {CHUNK} * {CHUNK} AS BIGINT) AS usable FROM laid")
def p_truncate_tail(spark: SparkSession, folder: str) -> DataFrame:
    return samples(spark, folder).agg(F.sum(F.size("ids").cast("long")).alias("tokens")).withColumn("usable", F.expr(f"tokens div {CHUNK} * {CHUNK}"))


@query(f"WITH {_TOKENS} SELECT pos // {CHUNK} AS chunk_id, list(id ORDER BY pos) AS ids, list(mask ORDER BY pos) AS mask FROM tok, total WHERE pos // {CHUNK} < total // {CHUNK} GROUP BY 1")
def p_explode_chunks(spark: SparkSession, folder: str) -> DataFrame:
    return packs.pack(samples(spark, folder), ["pair_id"], CHUNK)


@query(
    f"""
WITH {_TOKENS}, w AS (SELECT k FROM total, LATERAL (SELECT unnest(range(0, CAST((total - {CHUNK}) // {CHUNK - 1} + 1 AS BIGINT))) AS k))
SELECT k AS chunk_id, CAST(sum(id) AS BIGINT) AS id_sum, count(*) AS n FROM w JOIN tok ON pos >= k * {CHUNK - 1} AND pos < k * {CHUNK - 1} + {CHUNK} GROUP BY 1
"""
)
def p_rolling_window(spark: SparkSession, folder: str) -> DataFrame:
    laid = packs.with_offsets(samples(spark, folder), ["pair_id"])
    made = packs.chunks(laid, CHUNK, CHUNK - 1)
    return made.select("chunk_id", F.aggregate("ids", F.lit(0).cast("long"), lambda a, i: a + i).alias("id_sum"), F.size("ids").cast("long").alias("n"))


def _parts(spark: SparkSession, folder: str) -> list[DataFrame]:
    packed = packs.pack(samples(spark, folder), ["pair_id"], CHUNK).withColumn("part", F.pmod(F.col("chunk_id"), F.lit(2)))
    return [packed.where(F.col("part") == k).withColumn("chunk_id", F.expr("chunk_id div 2")).select("chunk_id", "ids", "mask") for k in (0, 1)]


_CHUNK_SUMS = f"c AS (SELECT pos // {CHUNK} AS chunk_id, CAST(sum(id) AS BIGINT) AS id_sum FROM tok, total WHERE pos // {CHUNK} < total // {CHUNK} GROUP BY 1), parts AS (SELECT chunk_id % 2 AS part, chunk_id // 2 AS old, id_sum FROM c)"


def _sums(df: DataFrame) -> DataFrame:
    return df.select(F.col("chunk_id").cast("long").alias("chunk_id"), F.aggregate("ids", F.lit(0).cast("long"), lambda a, i: a + i).alias("id_sum"))


@query(f"WITH {_TOKENS}, {_CHUNK_SUMS} SELECT row_number() OVER (ORDER BY part, old) - 1 AS chunk_id, id_sum FROM parts")
def p_mix_concat(spark: SparkSession, folder: str) -> DataFrame:
    return _sums(packs.mix(_parts(spark, folder)))


@query(f"WITH {_TOKENS}, {_CHUNK_SUMS} SELECT row_number() OVER (ORDER BY old // 16, part, old) - 1 AS chunk_id, id_sum FROM parts")
def p_mix_interleave(spark: SparkSession, folder: str) -> DataFrame:
    return _sums(packs.mix(_parts(spark, folder), 16, "interleave"))


_STATS = f"""
WITH {_TOKENS}, c AS (SELECT pos // {CHUNK} AS chunk_id, sum(mask) AS loss, count(*) AS n FROM tok, total WHERE pos // {CHUNK} < total // {CHUNK} GROUP BY 1)
SELECT count(*) AS n_chunks, CAST(sum(n) AS BIGINT) AS tokens, CAST(sum(loss) AS BIGINT) AS loss_tokens, round(sum(loss) / sum(n), 4) AS loss_share, CAST(sum(CASE WHEN loss = 0 THEN 1 ELSE 0 END) AS BIGINT) AS zero_loss_chunks FROM c
"""


@query(_STATS)
def p_mix_stats(spark: SparkSession, folder: str) -> DataFrame:
    return packs.stats(packs.pack(samples(spark, folder), ["pair_id"], CHUNK))


@query()
def p_replay_mix(spark: SparkSession, folder: str) -> DataFrame:
    one, two = _parts(spark, folder)
    return _sums(packs.replay(one, two, 0.25))


@query(f"WITH {_TOKENS}, c AS (SELECT DISTINCT pos // {CHUNK} AS chunk_id FROM tok, total WHERE pos // {CHUNK} < total // {CHUNK}), n AS (SELECT count(*) AS n FROM c) SELECT CAST(e * n + chunk_id AS BIGINT) AS position, chunk_id FROM c, n, range(0, 3) t(e) WHERE e * n + chunk_id >= 100")
def p_epochs(spark: SparkSession, folder: str) -> DataFrame:
    packed = packs.pack(samples(spark, folder), ["pair_id"], CHUNK)
    return packs.epochs(packed.select("chunk_id"), 3, 100).select(F.col("position").cast("long").alias("position"), "chunk_id")


@query(f"WITH {_SAMPLES} SELECT off // 20000 AS pool_id, count(*) AS n FROM laid GROUP BY 1")
def p_shuffle_pool(spark: SparkSession, folder: str) -> DataFrame:
    sized = samples(spark, folder).select("pair_id", F.size("ids").alias("n"))
    return packs.shuffled_pools(sized, ["pair_id"], "n", 20_000).groupBy("pool_id").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {_TOKENS}, c AS (SELECT pos // {CHUNK} AS chunk_id, max(CASE WHEN pos % {CHUNK} = 1 THEN mask END) AS second FROM tok, total WHERE pos // {CHUNK} < total // {CHUNK} GROUP BY 1) SELECT CASE WHEN second = 1 THEN 'within_solution' ELSE 'clean' END AS head, count(*) AS n FROM c GROUP BY 1")
def v_chunk_heads(spark: SparkSession, folder: str) -> DataFrame:
    return packs.heads(packs.pack(samples(spark, folder), ["pair_id"], CHUNK))


@query(f"WITH {_TOKENS} SELECT fault, count(*) AS n FROM (SELECT CASE WHEN sum(mask) = 0 THEN 'no_loss' END AS fault FROM tok GROUP BY pair_id) WHERE fault IS NOT NULL GROUP BY 1")
def v_mask_shape(spark: SparkSession, folder: str) -> DataFrame:
    laid = packs.with_offsets(samples(spark, folder), ["pair_id"])
    checked = packs.sample_faults(laid.withColumn("mask", packs.crossing_mask(F.col("mask"), F.col("off"), CHUNK)), CHUNK)
    return checked.groupBy("fault").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {_TOKENS}, c AS (SELECT pos // {CHUNK} AS chunk_id, sum(mask) AS loss, max(id) AS top FROM tok, total WHERE pos // {CHUNK} < total // {CHUNK} GROUP BY 1) SELECT fault, count(*) AS n FROM (SELECT 'no_loss' AS fault FROM c WHERE loss = 0 UNION ALL SELECT 'vocabulary' FROM c WHERE top >= 5000) GROUP BY 1")
def v_contract(spark: SparkSession, folder: str) -> DataFrame:
    return packs.chunk_faults(packs.pack(samples(spark, folder), ["pair_id"], CHUNK), CHUNK, 5000).groupBy("fault").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {_TOKENS} SELECT CAST(max(id) AS BIGINT) AS max_id, CAST(sum(CASE WHEN id IN (2, 3) THEN 1 ELSE 0 END) AS BIGINT) AS n_reserved FROM tok")
def v_max_id(spark: SparkSession, folder: str) -> DataFrame:
    reserved = F.size(F.filter("ids", lambda i: i.isin(2, 3)))
    return samples(spark, folder).agg(F.max(F.array_max("ids")).cast("long").alias("max_id"), F.sum(reserved.cast("long")).alias("n_reserved"))


@query(f"WITH {_TOKENS} SELECT round(sum(mask) / count(*), 6) AS share, 'ok' AS verdict FROM tok, total WHERE pos // {CHUNK} < total // {CHUNK}")
def v_mask_ratio(spark: SparkSession, folder: str) -> DataFrame:
    return packs.loss_verdict(packs.pack(samples(spark, folder), ["pair_id"], CHUNK)).withColumn("share", F.round("share", 6))


@query(f"WITH {_TOKENS} SELECT chunk_id FROM (SELECT DISTINCT pos // {CHUNK} AS chunk_id FROM tok, total WHERE pos // {CHUNK} < total // {CHUNK}) WHERE chunk_id >= 10 AND chunk_id < 10 + CAST(ceil(5000 / {CHUNK}.0) AS BIGINT)")
def scan_bin_chunks(spark: SparkSession, folder: str) -> DataFrame:
    """Chunks from a start offset until a number of tokens is reached."""
    start, tokens = 10 * CHUNK, 5000
    packed = packs.pack(samples(spark, folder), ["pair_id"], CHUNK)
    return packed.where((F.col("chunk_id") >= start // CHUNK) & (F.col("chunk_id") < start // CHUNK + -(-tokens // CHUNK))).select("chunk_id")


@query(f"WITH {_TOKENS}, c AS (SELECT DISTINCT pos // {CHUNK} AS chunk_id FROM tok, total WHERE pos // {CHUNK} < total // {CHUNK}) SELECT CAST(budget AS BIGINT) AS budget, count(*) AS n FROM c, (VALUES (1000), (10000), (100000)) v(budget) WHERE chunk_id < ceil(budget / {CHUNK}.0) GROUP BY 1")
def z_prefix_budget(spark: SparkSession, folder: str) -> DataFrame:
    packed = packs.pack(samples(spark, folder), ["pair_id"], CHUNK).select("chunk_id")
    budgets = packed.select("chunk_id", F.explode(F.array(*[F.lit(b).cast("long") for b in (1_000, 10_000, 100_000)])).alias("budget"))
    return budgets.where(F.col("chunk_id") < F.ceil(F.col("budget") / CHUNK)).groupBy("budget").agg(F.count(F.lit(1)).alias("n"))
