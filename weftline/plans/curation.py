"""Queries over source documents: filters, scrubbing, hashing, deduplication, sampling."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.functions import rules, text
from weftline.operators import dedup, funnel, order, splits
from weftline.plans.catalog import query
from weftline.session import table, texts

_WS = rules.quoted(text.WS)
_QUALITY = f"""
lined AS (
  SELECT *, string_split(text, chr(10)) AS ls FROM {{source}}
), coded AS (
  SELECT *, list_filter(ls, lambda x: trim(x, {_WS}) <> '' AND NOT starts_with(trim(x, {_WS}), '#')) AS code FROM lined
), bared AS (
  SELECT *, list_transform(code, lambda x: trim(x, {_WS})) AS bare FROM coded
), measured AS (
  SELECT *, len(ls) AS total, len(code) AS n,
    len(list_filter(bare, lambda x: starts_with(x, 'import ') OR starts_with(x, 'from '))) AS imports,
    len(list_filter(bare, lambda x: starts_with(x, 'class ') OR starts_with(x, '@'))) AS classes,
    len(list_filter(ls, lambda x: starts_with(trim(x, {_WS}), '#'))) AS comments,
    len(list_filter(range(1, len(bare) + 1), lambda i: starts_with(bare[i], 'def ') AND NOT contains(code[i], 'raise NotImplementedError')
      AND len(list_filter(bare[i + 1:i + 4], lambda b: b <> 'pass' AND NOT starts_with(b, repeat(chr(34), 3)))) = 0)) AS bodiless,
    len(list_filter(bare, lambda x: starts_with(x, 'def '))) AS defs,
    len(list_filter(code, lambda x: regexp_matches(x, '=|if |for |while |return |print\\(|yield '))) AS logic,
    len(list_filter(range(4, len(bare) + 1), lambda i: bare[i] = bare[i - 1] AND bare[i] = bare[i - 2] AND bare[i] = bare[i - 3])) AS repeats,
    coalesce(list_sum(list_transform(code, lambda x: length(x))), 0) AS width
  FROM bared
), judged AS (
  SELECT *, CASE WHEN total < 2 THEN 'L5_too_few_lines' WHEN n < 2 THEN 'L5_effective_lines' WHEN imports > 0.6 * n THEN 'L5_import_ratio' WHEN classes > 0.7 * n THEN 'L5_class_ratio'
    WHEN comments > 0.8 * total THEN 'L5_comment_ratio' WHEN bodiless > 0 THEN 'L5_def_without_body' WHEN defs = 0 AND logic < 2 THEN 'L5_no_def_no_logic'
    WHEN repeats > 0 THEN 'L5_repeated_lines' WHEN width < 8 * n THEN 'L5_short_lines' END AS quality
  FROM measured
)
"""


def _reason(layer: str) -> str:
    return rules.reason_sql("text", rules.CORPUS_LAYERS[layer])


@query(
    f"""
WITH {_QUALITY.format(source="documents")}
SELECT CASE
    WHEN path IS NULL OR NOT ends_with(path, '.py') THEN 'non_python'
    WHEN {rules.file_excluded_sql("path")} THEN 'filename_filtered'
    WHEN coalesce(length(text), 0) < 50 THEN 'too_short'
    WHEN {_reason("L1")} IS NOT NULL THEN 'L1_framework'
    WHEN {_reason("L2")} IS NOT NULL THEN 'L2_python2'
    WHEN {_reason("L3")} IS NOT NULL THEN 'L3_config'
    WHEN {_reason("L4")} IS NOT NULL THEN 'L4_tests'
    WHEN quality IS NOT NULL THEN 'L5_quality'
    WHEN {rules.autogenerated_sql("text")} IS NOT NULL THEN 'L6_autogen'
    ELSE 'accepted' END AS reason, count(*) AS n
FROM judged GROUP BY 1
"""
)
def f_funnel(spark: SparkSession, folder: str) -> DataFrame:
    return funnel.counts(funnel.verdicts(texts(spark, folder), scrub=False))


@query()
def f_funnel_scrubbed(spark: SparkSession, folder: str) -> DataFrame:
    judged = funnel.verdicts(texts(spark, folder))
    return judged.groupBy("source", "reason").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("was_stripped").cast("long")).alias("n_stripped"))


@query(
    f"""
SELECT coalesce({_reason("L1")}, {_reason("L2")}, {_reason("L3")}, {_reason("L4")}, {rules.autogenerated_sql("text")}, 'none') AS reason, count(*) AS n
FROM documents GROUP BY 1
"""
)
def f_layer_reasons(spark: SparkSession, folder: str) -> DataFrame:
    body = F.col("text")
    found = F.coalesce(*[rules.first_reason(body, rules.CORPUS_LAYERS[k]) for k in ("L1", "L2", "L3", "L4")], rules.autogenerated_reason(body), F.lit("none"))
    return texts(spark, folder).groupBy(found.alias("reason")).agg(F.count(F.lit(1)).alias("n"))


def _layer_query(name: str, layer: str) -> None:
    def run(spark: SparkSession, folder: str) -> DataFrame:
        reason = rules.first_reason(F.col("text"), rules.CORPUS_LAYERS[layer])
        return table(spark, folder, "documents").select("doc_id", reason.alias("reason")).where("reason is not null")

    run.__name__ = name
    query(f"SELECT doc_id, {_reason(layer)} AS reason FROM documents WHERE {_reason(layer)} IS NOT NULL")(run)


for _name, _layer in (("f_L1", "L1"), ("f_L2", "L2"), ("f_L3", "L3"), ("f_L4", "L4")):
    _layer_query(_name, _layer)


@query(f"WITH {_QUALITY.format(source='documents')} SELECT doc_id, coalesce(quality, 'ok') AS reason FROM judged WHERE text IS NOT NULL")
def f_L5(spark: SparkSession, folder: str) -> DataFrame:
    return texts(spark, folder).where("text is not null").select("doc_id", F.coalesce(text.quality_reason(F.col("text")), F.lit("ok")).alias("reason"))


@query(f"SELECT doc_id, {rules.autogenerated_sql('text')} AS reason FROM documents WHERE {rules.autogenerated_sql('text')} IS NOT NULL")
def f_L6(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "documents").select("doc_id", rules.autogenerated_reason(F.col("text")).alias("reason")).where("reason is not null")


@query("SELECT coalesce(lower(lang), 'unknown') AS lang, count(*) AS n, CAST(sum(CASE WHEN ends_with(path, '.py') THEN 1 ELSE 0 END) AS BIGINT) AS n_python_path FROM documents GROUP BY 1")
def f_lang(spark: SparkSession, folder: str) -> DataFrame:
    ends = F.coalesce(F.endswith("path", F.lit(".py")), F.lit(False))
    return table(spark, folder, "documents").groupBy(F.coalesce(F.lower("lang"), F.lit("unknown")).alias("lang")).agg(F.count(F.lit(1)).alias("n"), F.sum(ends.cast("long")).alias("n_python_path"))


@query(f"SELECT doc_id, path FROM documents WHERE {rules.file_excluded_sql('path')}")
def f_filename(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "documents").where(rules.file_excluded(F.col("path"))).select("doc_id", "path")


@query("SELECT source, count(*) AS n FROM documents WHERE coalesce(length(text), 0) < 50 GROUP BY 1")
def f_min_chars(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "documents").where(F.coalesce(F.length("text"), F.lit(0)) < 50).groupBy("source").agg(F.count(F.lit(1)).alias("n"))


@query(
    "SELECT pattern, hits FROM (SELECT "
    + ", ".join(f"CAST(count(*) FILTER (WHERE contains(text, {rules.quoted(p)})) AS BIGINT) AS h{k}" for k, p in enumerate(rules.POISON))
    + " FROM documents), (VALUES "
    + ", ".join(f"({k}, {rules.quoted(p)})" for k, p in enumerate(rules.POISON))
    + ") v(k, pattern), LATERAL (SELECT CASE k "
    + " ".join(f"WHEN {k} THEN h{k}" for k in range(len(rules.POISON)))
    + " END AS hits)"
)
def f_verify_residual(spark: SparkSession, folder: str) -> DataFrame:
    return funnel.residue(table(spark, folder, "documents"))


@query(
    r"""
WITH s AS (SELECT doc_id, regexp_replace(text, '(?m)^(?:<(?:gh_stars|reponame|filename)>[^<\n]*)+\n?', '', 'g') AS t FROM documents WHERE ends_with(path, '.py') AND length(text) >= 50)
SELECT doc_id, md5(t) AS digest FROM s WHERE trim(t, """
    + _WS
    + ") <> ''"
)
def f_lang_only(spark: SparkSession, folder: str) -> DataFrame:
    return funnel.language_only(table(spark, folder, "documents")).select("doc_id", F.md5("text").alias("digest"))


@query(
    f"""
WITH ok AS (SELECT doc_id, source, seq, row_number() OVER (PARTITION BY source ORDER BY seq, doc_id) AS r FROM documents WHERE length(text) >= 50)
SELECT doc_id, source FROM ok WHERE r <= 100
"""
)
def f_max_accept(spark: SparkSession, folder: str) -> DataFrame:
    kept = table(spark, folder, "documents").where(F.length("text") >= 50).select("doc_id", "source", "seq")
    return order.at_most(kept, ["source"], ["seq", "doc_id"], 100).select("doc_id", "source")


# Scrubbing and text functions


@query()
def s_strip_copyright(spark: SparkSession, folder: str) -> DataFrame:
    docs = texts(spark, folder).where("text is not null")
    return docs.select("doc_id", text.strip_copyright(F.col("text")).alias("clean")).withColumn("n_chars", F.length("clean"))


@query()
def s_strip_header(spark: SparkSession, folder: str) -> DataFrame:
    docs = texts(spark, folder).where("text is not null")
    return docs.select("doc_id", text.strip_header(F.col("text")).alias("clean")).withColumn("n_chars", F.length("clean"))


@query(
    r"""
WITH s AS (SELECT text, regexp_replace(text, '^(?:<(?:gh_stars|reponame|filename)>[^\n]*\n)+', '') AS t FROM documents WHERE text IS NOT NULL)
SELECT CASE WHEN t <> text THEN 'stripped' ELSE 'kept' END AS outcome, count(*) AS n, CAST(sum(length(t)) AS BIGINT) AS n_chars FROM s WHERE t <> '' GROUP BY 1
"""
)
def s_strip_meta_prefix(spark: SparkSession, folder: str) -> DataFrame:
    s = table(spark, folder, "documents").where("text is not null").select("text", text.strip_meta_prefix(F.col("text")).alias("t")).where("t <> ''")
    return s.groupBy(F.when(F.col("t") != F.col("text"), "stripped").otherwise("kept").alias("outcome")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("t")).alias("n_chars"))


@query(r"SELECT doc_id, md5(regexp_replace(text, '(?m)^<(?:gh_stars|reponame|filename)>', '', 'g')) AS digest FROM documents WHERE text IS NOT NULL")
def s_strip_meta_lines(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "documents").where("text is not null").select("doc_id", F.md5(text.strip_meta_lines(F.col("text"), chained=False)).alias("digest"))


@query(r"SELECT doc_id, md5(regexp_replace(text, '(?m)^(?:<(?:gh_stars|reponame|filename)>[^<\n]*)+\n?', '', 'g')) AS digest FROM documents WHERE text IS NOT NULL")
def s_strip_meta_chained(spark: SparkSession, folder: str) -> DataFrame:
    """Tags chained on one line all go."""
    return table(spark, folder, "documents").where("text is not null").select("doc_id", F.md5(text.strip_meta_lines(F.col("text"))).alias("digest"))


_KEY = r"md5(regexp_replace(regexp_replace({c}, '''(?:[^''\\\n]|\\.)*''|\"(?:[^\"\\\n]|\\.)*\"', 'S', 'g'), '[0-9]+', 'N', 'g'))"


@query(f"SELECT key, n FROM (SELECT {_KEY.format(c='solution')} AS key, count(*) AS n FROM prompt_solution WHERE solution IS NOT NULL GROUP BY 1)")
def s_template_key(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "prompt_solution").where("solution is not null")
    return rows.groupBy(text.template_key(F.col("solution")).alias("key")).agg(F.count(F.lit(1)).alias("n"))


@query(f"SELECT doc_id, CAST(len(list_filter(string_split(text, chr(10)), lambda x: trim(x, {_WS}) <> '' AND NOT starts_with(trim(x, {_WS}), '#'))) AS BIGINT) AS n_lines FROM documents WHERE text IS NOT NULL")
def s_effective_lines(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "documents").where("text is not null").select("doc_id", text.effective_lines(F.col("text")).cast("long").alias("n_lines"))


@query()
def s_split_signature(spark: SparkSession, folder: str) -> DataFrame:
    docs = texts(spark, folder).where(F.endswith("path", F.lit(".py")) & F.contains("text", F.lit("def ")))
    return docs.select("doc_id", "source", F.inline(text.function_pairs(F.col("text"))))


@query()
def s_extract_function_body(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "candidates").where("completion is not null")
    return docs.select("id", "k_index", text.function_body(F.col("completion")).alias("body"))


@query()
def s_sanitize_indent(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "candidates").select("id", "k_index", text.expand_tabs(F.col("completion")).alias("code"))


@query("SELECT doc_id, CASE WHEN contains(text, '### Code' || chr(10)) THEN md5(list_extract(string_split(text, '### Code' || chr(10)), -1)) ELSE md5(text) END AS digest FROM documents WHERE text IS NOT NULL AND lower(lang) = 'markdown'")
def s_after_last_marker(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").where("text is not null and lower(lang) = 'markdown'")
    return docs.select("doc_id", F.md5(text.after_last(F.col("text"))).alias("digest"))


_STOPS = ", ".join(f"nullif(strpos(completion, {rules.quoted(s)}), 0)" for s in rules.STOPS)


@query(f"SELECT id, k_index, completion IS NOT NULL AS present, CASE WHEN least({_STOPS}) IS NULL THEN completion ELSE substr(completion, 1, least({_STOPS}) - 1) END AS code FROM candidates")
def s_truncate(spark: SparkSession, folder: str) -> DataFrame:
    c = F.col("completion")
    return table(spark, folder, "candidates").select("id", "k_index", c.isNotNull().alias("present"), text.truncate(c).alias("code"))


# Hashes, splits, deduplication, selection

_BUCKET = "CAST(('0x' || left(md5(substr({c}, 1, 200)), 8)) AS BIGINT)"


@query(f"SELECT doc_id, CASE WHEN {_BUCKET.format(c='text')} % 50 = 0 THEN 'val' ELSE 'train' END AS split FROM documents WHERE text IS NOT NULL")
def h_split_md5(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "documents").where("text is not null").select("doc_id", splits.md5_split(F.col("text")).alias("split"))


@query()
def h_split_blake(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "prompt_solution").where("solution is not null")
    return rows.select("pair_id", splits.digest_split(F.col("solution"), 0.02).alias("split"), F.hex(text.blake2b8(F.col("solution"))).alias("digest"))


@query("SELECT doc_id, source FROM (SELECT doc_id, source, row_number() OVER (PARTITION BY text ORDER BY seq, doc_id) AS r FROM documents WHERE text IS NOT NULL) WHERE r = 1")
def d_exact(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").where("text is not null")
    return dedup.exact(docs.select("doc_id", "source", "seq", "text"), F.col("text"), ["seq", "doc_id"]).select("doc_id", "source")


@query(f"SELECT pair_id, loaded_at FROM (SELECT pair_id, loaded_at, row_number() OVER (PARTITION BY {_KEY.format(c='solution')} ORDER BY pair_id, loaded_at) AS r FROM prompt_solution WHERE solution IS NOT NULL) WHERE r <= 5")
def d_template_cap(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "prompt_solution").where("solution is not null")
    return dedup.template_cap(rows, F.col("solution"), ["pair_id", "loaded_at"]).select("pair_id", "loaded_at")


@query()
def d_instruction(spark: SparkSession, folder: str) -> DataFrame:
    """Accepted pairs of a single pass with coupled text, instruction and template conditions."""
    rows = table(spark, folder, "prompt_solution").where("solution is not null and prompt is not null")
    numbered = order.row_numbers(rows, ["pair_id", "loaded_at"], "at")
    return dedup.coupled(numbered, F.concat("prompt", F.lit("\n"), "solution"), F.col("prompt"), text.template_key(F.col("solution")), "at").select("pair_id", "loaded_at")


@query(
    """
SELECT doc_id, source FROM (
  SELECT doc_id, source, coalesce(sum(n_chars) OVER (PARTITION BY source ORDER BY seq, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM documents WHERE n_chars > 0
) WHERE before < 100000
"""
)
def d_quota_source(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").where("n_chars > 0").select("doc_id", "source", "seq", "n_chars")
    return order.quota(docs, "source", ["seq", "doc_id"], F.col("n_chars"), 100_000).select("doc_id", "source")


@query(
    """
SELECT doc_id FROM (
  SELECT doc_id, coalesce(sum(n_chars) OVER (ORDER BY seq, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM documents WHERE n_chars > 0
) WHERE before < 500000
"""
)
def d_target_total(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").where("n_chars > 0").select("doc_id", "seq", "n_chars")
    return order.until_total(docs, ["seq", "doc_id"], "n_chars", 500_000).select("doc_id")


@query("SELECT doc_id, source FROM (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY seq, doc_id) AS r FROM documents) WHERE r <= 50")
def d_row_limit(spark: SparkSession, folder: str) -> DataFrame:
    return order.at_most(table(spark, folder, "documents").select("doc_id", "source", "seq"), ["source"], ["seq", "doc_id"], 50).select("doc_id", "source")


@query(
    """
WITH d AS (SELECT doc_id, n_chars, CASE WHEN CAST('0x' || left(md5(left(text, 200)), 8) AS BIGINT) % 5000 = 0 THEN 'val' ELSE 'train' END AS split FROM documents WHERE n_chars > 0),
h AS (SELECT coalesce(sum(n_chars) FILTER (WHERE split = 'val'), 0) AS have FROM d),
r AS (SELECT doc_id, n_chars, coalesce(sum(n_chars) OVER (ORDER BY n_chars DESC, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM d WHERE split = 'train')
SELECT doc_id, n_chars, CASE WHEN before < 50000 - have THEN 'val' ELSE 'train' END AS split FROM r, h UNION ALL SELECT doc_id, n_chars, split FROM d WHERE split = 'val'
"""
)
def d_val_promote(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").where("n_chars > 0").select("doc_id", "n_chars", splits.md5_split(F.col("text"), 5000).alias("split"))
    return splits.promote(docs, "n_chars", "doc_id", 50_000)


@query("SELECT id || '#k' || k AS candidate_id, CAST(k AS INTEGER) AS k_index FROM (SELECT DISTINCT id FROM problems), range(0, 4) t(k)")
def d_seed_expand(spark: SparkSession, folder: str) -> DataFrame:
    return splits.seeded(table(spark, folder, "problems").select("id").distinct(), F.col("id"), 4).select("candidate_id", "k_index")


@query(
    """
WITH n AS (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY seq, doc_id) - 1 AS r, count(*) OVER (PARTITION BY source) AS c FROM documents)
SELECT doc_id, source FROM n WHERE r % greatest(1, c // 40) = 0
"""
)
def t_systematic(spark: SparkSession, folder: str) -> DataFrame:
    return order.every_nth(table(spark, folder, "documents").select("doc_id", "source", "seq"), "source", ["seq", "doc_id"], 40).select("doc_id", "source")


@query("SELECT doc_id, source FROM documents ORDER BY md5('42:' || doc_id), doc_id LIMIT 200")
def t_reservoir(spark: SparkSession, folder: str) -> DataFrame:
    return order.hashed_sample(table(spark, folder, "documents").select("doc_id", "source"), "doc_id", 200)


@query("SELECT doc_id, seq FROM documents ORDER BY seq, doc_id LIMIT 20")
def t_head_n(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "documents").select("doc_id", "seq").orderBy("seq", "doc_id").limit(20)


@query(
    """
WITH n AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS r, count(*) OVER () AS c FROM documents)
SELECT doc_id FROM n WHERE r IN (SELECT CAST(round_even(k * (c - 1) / 10.0, 0) AS BIGINT) FROM range(0, 11) t(k))
"""
)
def t_even_pick(spark: SparkSession, folder: str) -> DataFrame:
    return order.even_pick(table(spark, folder, "documents").select("doc_id"), ["doc_id"], 11)
