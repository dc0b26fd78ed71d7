"""Queries over instruction pairs and problems: gates, extraction, joins."""

from __future__ import annotations

import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.functions import rules, text
from weftline.operators import joins
from weftline.plans.catalog import query
from weftline.session import table, texts

_WS = rules.quoted(text.WS)
_FENCE = r"'```[ \t]*([A-Za-z0-9_+.\-]*)[ \t]*\n((?s:.*?))(?:\n[ \t]*```|\z)'"
_DEF = r"'(?m)^[ \t]*(?:async[ \t]+)?(?:def|class)[ \t]+([A-Za-z_][A-Za-z0-9_]*)'"
_UNIX = "replace(replace({c}, chr(13) || chr(10), chr(10)), chr(13), chr(10))"


def _extract_sql(c: str) -> str:
    u = _UNIX.format(c=c)
    tags, bodies = f"regexp_extract_all({u}, {_FENCE}, 1)", f"regexp_extract_all({u}, {_FENCE}, 2)"
    python = f"list_filter(range(1, len({tags}) + 1), lambda k: starts_with(lower({tags}[k]), 'py'))"
    bare = f"list_filter(range(1, len({tags}) + 1), lambda k: {tags}[k] = '')"
    chosen = f"coalesce({bodies}[{python}[1]], {bodies}[{bare}[1]])"
    return f"CASE WHEN trim(coalesce({c}, ''), {_WS}) = '' THEN NULL WHEN len({tags}) = 0 THEN trim({u}, {_WS}) ELSE trim({chosen}, {_WS}) END"


@query(f"SELECT id, k_index, {_extract_sql('completion')} AS code FROM candidates")
def s_extract_code(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "candidates").select("id", "k_index", text.extract_code(F.col("completion")).alias("code"))


_SIMPLE = r"'```(?:python|py)?[ \t]*\r?\n((?s:.*?))```'"


@query(f"SELECT id, k_index, trim(replace(CASE WHEN regexp_matches(completion, {_SIMPLE}) THEN regexp_extract(completion, {_SIMPLE}, 1) ELSE coalesce(completion, '') END, chr(13) || chr(10), chr(10)), chr(10)) AS code FROM candidates")
def s_strip_fence_simple(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "candidates").select("id", "k_index", text.simple_fence(F.col("completion")).alias("code"))


@query()
def s_strip_fences_nl(spark: SparkSession, folder: str) -> DataFrame:
    """What follows the last marker, out of its fence (a text with foreign fences only stays), normalised."""
    body = text.after_last(F.col("completion"))
    code = F.coalesce(text.extract_code(body), body)
    stray = F.regexp_replace(F.regexp_replace(code, r"\A(?:```[A-Za-z0-9_+#.\-]*\s*\n)+", ""), r"(?:\n```[A-Za-z0-9_+#.\-]*\s*)+\z", "")
    return table(spark, folder, "candidates").select("id", "k_index", text.normalize_code(stray).alias("code"))


@query()
def s_extract_nl_heldout(spark: SparkSession, folder: str) -> DataFrame:
    body = text.after_last(F.col("completion"), "### Code")
    return table(spark, folder, "candidates").select("id", "k_index", text.normalize_code(F.coalesce(text.extract_code(body), body)).alias("code"))


@query()
def s_normalize_code(spark: SparkSession, folder: str) -> DataFrame:
    return texts(spark, folder, "candidates").select("id", "k_index", text.normalize_code(F.col("completion")).alias("code"))


@query("SELECT DISTINCT id, '### Task' || chr(10) || prompt || chr(10) || chr(10) || '### Code' || chr(10) AS prompt FROM problems WHERE prompt IS NOT NULL")
def s_prompt_template(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "problems").where("prompt is not null").select("id", text.prompt(F.col("prompt")).alias("prompt")).distinct()


@query("SELECT id, CAST(meta.prompt_chars AS BIGINT) AS told, CAST(length(prompt) AS BIGINT) AS chars FROM problems WHERE prompt IS NOT NULL AND meta.prompt_chars <> length(prompt)")
def s_prompt_check(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "problems").where("prompt is not null")
    return rows.select("id", F.col("meta.prompt_chars").cast("long").alias("told"), F.length("prompt").cast("long").alias("chars")).where("told <> chars")


@query(f"SELECT id, prompt, CAST(len(list_filter(tests, lambda t: t IS NOT NULL AND trim(t, {_WS}) <> '')) AS BIGINT) AS n FROM problems WHERE tests IS NOT NULL")
def s_norm_tests(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "problems").where("tests is not null").select("id", "prompt", F.size(text.clean_tests(F.col("tests"))).cast("long").alias("n"))


@query(f"SELECT id, prompt, nullif(regexp_extract(ref_solution, {_DEF}, 1), '') AS entry FROM problems WHERE ref_solution IS NOT NULL")
def s_entry_of(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "problems").where("ref_solution is not null").select("id", "prompt", text.entry_name(F.col("ref_solution")).alias("entry"))


@query(
    """
SELECT id, k_index, CASE WHEN contains(lower(completion), 'sorted(') THEN 'BANNED sorted(' WHEN contains(lower(completion), 'eval(') THEN 'BANNED eval('
  WHEN NOT (contains(lower(completion), 'for ') OR contains(lower(completion), 'while ')) THEN 'MISSING for |while ' WHEN NOT contains(lower(completion), 'return') THEN 'MISSING return' ELSE 'ok' END AS verdict
FROM candidates WHERE completion IS NOT NULL
"""
)
def s_check_impl(spark: SparkSession, folder: str) -> DataFrame:
    reason = text.implementation_reason(F.col("completion"), ["sorted(", "eval("], ["for |while ", "return"])
    return table(spark, folder, "candidates").where("completion is not null").select("id", "k_index", F.coalesce(reason, F.lit("ok")).alias("verdict"))


@query()
def s_negatives(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "heldout_problems").where("ref_solution is not null and entry is not null")
    return rows.select("id", F.inline(text.mutants(F.col("ref_solution"), F.col("entry")))).withColumn("parses", text.compiles(F.col("code")))


@query()
def s_lenient_rewrite(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "problems").select("id", F.posexplode("tests").alias("at", "test"))
    return rows.select("id", "at", text.lenient_test(F.regexp_replace("test", r"^\s*assert\s+", "")).alias("test"))


@query(
    """
SELECT bucket, count(*) AS n FROM (
  SELECT CASE WHEN reason IS NULL THEN 'other' WHEN starts_with(reason, 'PASS') THEN 'PASS' WHEN starts_with(reason, 'MISSING') THEN 'MISSING' WHEN starts_with(reason, 'BANNED') THEN 'BANNED'
    WHEN regexp_matches(lower(reason), 'no function|no_fn|nameerror') THEN 'no_fn' WHEN regexp_matches(lower(reason), 'error|timeout|exec') THEN 'exec' ELSE 'other' END AS bucket FROM results
) GROUP BY 1
"""
)
def s_failure_bucket(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "results").groupBy(text.failure_bucket(F.col("reason")).alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


# Gates


def _pair_gate_sql() -> str:
    layers = [rules.reason_sql("solution", rules.PAIR_LAYERS[k]) for k in ("L1", "L2", "L3", "L4")]
    return f"coalesce({', '.join(layers)}, {rules.autogenerated_sql('solution', 3, 44)}, 'clean')"


@query(f"SELECT pair_id, loaded_at, {_pair_gate_sql()} AS reason FROM prompt_solution WHERE solution IS NOT NULL")
def g_pollution_full(spark: SparkSession, folder: str) -> DataFrame:
    body = F.col("solution")
    reason = F.coalesce(*[rules.first_reason(body, rules.PAIR_LAYERS[k]) for k in ("L1", "L2", "L3", "L4")], rules.autogenerated_reason(body, 3, 44), F.lit("clean"))
    return table(spark, folder, "prompt_solution").where("solution is not null").select("pair_id", "loaded_at", reason.alias("reason"))


@query(
    f"""
SELECT pair_id, loaded_at, CASE WHEN {rules.any_sql("coalesce(prompt, '')", rules.PAIR_CONFIG)} OR {rules.any_sql("solution", rules.PAIR_CONFIG)} THEN 'L3_config'
  WHEN {" OR ".join(f"(contains(solution, {rules.quoted(t)}) AND NOT contains(coalesce(prompt, ''), {rules.quoted(t)}))" for t in rules.PAIR_TESTS)} THEN 'L4_test'
  WHEN {rules.autogenerated_sql("solution")} IS NOT NULL THEN 'L6_autogen' ELSE 'clean' END AS reason
FROM prompt_solution WHERE solution IS NOT NULL
"""
)
def g_pollution_light(spark: SparkSession, folder: str) -> DataFrame:
    p, s = F.coalesce("prompt", F.lit("")), F.col("solution")
    tests = F.lit(False)
    for t in rules.PAIR_TESTS:
        tests = tests | (F.contains(s, F.lit(t)) & ~F.contains(p, F.lit(t)))
    reason = (
        F.when(rules.contains_any(p, rules.PAIR_CONFIG) | rules.contains_any(s, rules.PAIR_CONFIG), "L3_config")
        .when(tests, "L4_test").when(rules.autogenerated_reason(s).isNotNull(), "L6_autogen").otherwise("clean")
    )
    return table(spark, folder, "prompt_solution").where("solution is not null").select("pair_id", "loaded_at", reason.alias("reason"))


@query(
    f"""
WITH a AS (SELECT pair_id, loaded_at, string_split(solution, chr(10)) AS ls FROM prompt_solution WHERE solution IS NOT NULL),
b AS (SELECT *, list_filter(ls, lambda x: trim(x, {_WS}) <> '' AND NOT starts_with(trim(x, {_WS}), '#')) AS code FROM a),
c AS (SELECT *, list_transform(code, lambda x: trim(x, {_WS})) AS bare, len(code) AS n FROM b)
SELECT pair_id, loaded_at, CASE WHEN len(ls) < 2 THEN 'L5_too_few_lines' WHEN n < 2 THEN 'L5_effective_lines'
  WHEN len(list_filter(bare, lambda x: starts_with(x, 'import ') OR starts_with(x, 'from '))) > 0.6 * n THEN 'L5_import_ratio'
  WHEN len(list_filter(bare, lambda x: starts_with(x, 'class ') OR starts_with(x, '@'))) > 0.7 * n THEN 'L5_class_ratio'
  WHEN len(list_filter(ls, lambda x: starts_with(trim(x, {_WS}), '#'))) > 0.8 * len(ls) THEN 'L5_comment_ratio'
  WHEN len(list_filter(range(4, n + 1), lambda i: bare[i] = bare[i - 1] AND bare[i] = bare[i - 2] AND bare[i] = bare[i - 3])) > 0 THEN 'L5_repeated_lines'
  WHEN len(list_filter(code, lambda x: regexp_matches(x, '=|if |for |while |return |print\\(|yield |raise |assert '))) = 0 THEN 'L5_no_logic' ELSE 'ok' END AS reason
FROM c
"""
)
def g_quality(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "prompt_solution").where("solution is not null")
    return rows.select("pair_id", "loaded_at", F.coalesce(text.body_reason(F.col("solution")), F.lit("ok")).alias("reason"))


@query()
def g_text_present(spark: SparkSession, folder: str) -> DataFrame:
    """First of: no text, replacement character, too long, no function, not Python; else ok."""
    c = text.unix_lines(F.col("text"))
    early = F.when(text.blank(c), "no_text").when(F.contains(c, F.lit("�")), "bad_char").when(F.length(c) > 100_000, "too_long").when(~F.contains(c, F.lit("def ")), "no_function")
    parsed = text.compiles(F.when(early.isNull(), c))
    return texts(spark, folder).select("doc_id", F.coalesce(early, F.when(parsed, "ok").otherwise("syntax_error")).alias("reason"))


@query(
    f"""
SELECT pair_id, loaded_at, CASE WHEN length(solution) < 50 THEN 'too_short' WHEN length(solution) > 1000 THEN 'too_long'
  WHEN len(list_filter(string_split(solution, chr(10)), lambda x: trim(x, {_WS}) <> '' AND NOT starts_with(trim(x, {_WS}), '#'))) < 3 THEN 'few_lines' ELSE 'ok' END AS reason
FROM prompt_solution WHERE solution IS NOT NULL
"""
)
def g_length_gates(spark: SparkSession, folder: str) -> DataFrame:
    s = F.col("solution")
    reason = F.when(F.length(s) < 50, "too_short").when(F.length(s) > 1000, "too_long").when(text.effective_lines(s) < 3, "few_lines").otherwise("ok")
    return table(spark, folder, "prompt_solution").where("solution is not null").select("pair_id", "loaded_at", reason.alias("reason"))


@query(f"SELECT doc_id FROM documents WHERE {rules.any_sql('text', rules.SPECIAL_TOKENS)}")
def g_special_literal(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "documents").where(rules.contains_any(F.col("text"), rules.SPECIAL_TOKENS)).select("doc_id")


@query(f"SELECT doc_id FROM documents WHERE {rules.any_sql('text', rules.MARKERS)}")
def g_template_marker(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "documents").where(rules.contains_any(F.col("text"), rules.MARKERS)).select("doc_id")


@query(
    f"""
WITH names AS (SELECT entry AS name FROM heldout_problems WHERE entry IS NOT NULL UNION SELECT unnest([{", ".join(map(rules.quoted, rules.EVALUATION_NAMES))}]))
SELECT DISTINCT doc_id, name FROM (SELECT doc_id, unnest(regexp_extract_all(text, {_DEF}, 1)) AS name FROM documents) JOIN names USING (name)
"""
)
def g_leak_blacklist(spark: SparkSession, folder: str) -> DataFrame:
    """Documents that define a function or class with an evaluation item's name."""
    names = table(spark, folder, "heldout_problems").select(F.col("entry").alias("name")).where("name is not null")
    names = names.union(spark.createDataFrame([(n,) for n in rules.EVALUATION_NAMES], "name string")).distinct()
    defined = table(spark, folder, "documents").select("doc_id", F.explode(text.defined_names(F.col("text"))).alias("name"))
    return defined.join(names, "name").select("doc_id", "name").distinct()


@query(
    f"""
WITH names AS (SELECT entry AS name FROM heldout_problems WHERE entry IS NOT NULL)
SELECT doc_id FROM documents WHERE text IS NOT NULL AND doc_id NOT IN (SELECT doc_id FROM (SELECT doc_id, unnest(regexp_extract_all(text, {_DEF}, 1)) AS name FROM documents) JOIN names USING (name))
"""
)
def j_blacklist_anti(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").where("text is not null")
    names = table(spark, folder, "heldout_problems").select(F.col("entry").alias("name")).where("name is not null").distinct()
    hit = docs.select("doc_id", F.explode(text.defined_names(F.col("text"))).alias("name")).join(names, "name", "left_semi").select("doc_id").distinct()
    return docs.select("doc_id").join(hit, "doc_id", "left_anti")


@query("SELECT id, prompt, meta.average_test_score AS score FROM problems WHERE meta.average_test_score IS NULL OR meta.average_test_score >= 0.8")
def g_score(spark: SparkSession, folder: str) -> DataFrame:
    score = F.col("meta.average_test_score")
    return table(spark, folder, "problems").where(score.isNull() | (score >= 0.8)).select("id", "prompt", score.alias("score"))


@query(f"SELECT id, reason, count(*) AS n FROM results WHERE reason IS NULL OR lower(trim(reason, {_WS})) IN ('passed', 'true', 'ok', 'success', '1') GROUP BY 1, 2")
def g_status(spark: SparkSession, folder: str) -> DataFrame:
    ok = F.col("reason").isNull() | F.lower(text.strip(F.col("reason"))).isin(rules.PASSED_WORDS)
    return table(spark, folder, "results").where(ok).groupBy("id", "reason").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT split_part(id, '#k', 1) AS id, bool_and(coalesce(passed, false)) AS all_passed FROM results WHERE id IS NOT NULL GROUP BY 1")
def g_all_tests_passed(spark: SparkSession, folder: str) -> DataFrame:
    """Problems whose candidates all passed, by way of a JSON array of their verdicts."""
    words = F.when(F.coalesce("passed", F.lit(False)), "pass").otherwise("fail")
    grouped = table(spark, folder, "results").where("id is not null").groupBy(joins.base_id(F.col("id")).alias("id")).agg(F.to_json(F.collect_set(words)).alias("status"))
    return grouped.select("id", text.all_passed(F.col("status")).alias("all_passed"))


@query()
def g_compile(spark: SparkSession, folder: str) -> DataFrame:
    return texts(spark, folder, "candidates").where("completion is not null").select("id", "k_index", text.compiles(text.extract_code(F.col("completion"))).alias("parses"))


@query("SELECT pair_id, loaded_at FROM prompt_solution WHERE length(prompt) <= 512 AND length(solution) <= 768 AND length(prompt) + length(solution) <= 1024")
def g_token_limits(spark: SparkSession, folder: str) -> DataFrame:
    """Limits on prompt, solution and both; here in characters, as the core has no tokenizer."""
    p, s = F.length("prompt"), F.length("solution")
    return table(spark, folder, "prompt_solution").where((p <= 512) & (s <= 768) & (p + s <= 1024)).select("pair_id", "loaded_at")


@query("SELECT doc_id FROM (SELECT doc_id, list_transform(string_split(text, ''), lambda c: unicode(c)) AS ids FROM documents WHERE length(text) > 0) WHERE list_has_any(ids, [9, 65279])")
def g_special_ids(spark: SparkSession, folder: str) -> DataFrame:
    """Samples with a reserved id; here code points stand for ids."""
    ids = F.transform(F.split("text", ""), lambda c: F.ascii(c))
    return table(spark, folder, "documents").where(F.length("text") > 0).select("doc_id", ids.alias("ids")).where(F.arrays_overlap("ids", F.array(F.lit(9), F.lit(65279)))).select("doc_id")


@query("SELECT id, prompt FROM problems WHERE entry IS NOT NULL AND tests IS NOT NULL AND len(list_filter(tests, lambda t: regexp_matches(t, '\\b' || regexp_escape(entry) || '\\s*\\('))) > 0")
def g_entry_called(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "problems").where("entry is not null and tests is not null").where(text.calls(F.col("entry"), F.col("tests"))).select("id", "prompt")


_STDLIB = sorted(sys.stdlib_module_names)
_IMPORTS = r"'(?m)^[ \t]*(?:import[ \t]+([A-Za-z_][\w.]*)|from[ \t]+([A-Za-z_][\w.]*)[ \t]+import)'"


@query(
    f"""
WITH m AS (SELECT doc_id, unnest(list_concat(regexp_extract_all(text, {_IMPORTS}, 1), regexp_extract_all(text, {_IMPORTS}, 2))) AS module FROM documents WHERE ends_with(path, '.py'))
SELECT DISTINCT doc_id, split_part(module, '.', 1) AS module FROM m WHERE module <> '' AND split_part(module, '.', 1) NOT IN ({", ".join(map(rules.quoted, _STDLIB))})
"""
)
def g_nonstdlib(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").where(F.endswith("path", F.lit(".py")))
    foreign = F.array_except(text.root_modules(F.col("text")), F.array(*[F.lit(m) for m in _STDLIB]))
    return docs.select("doc_id", F.explode(foreign).alias("module"))


@query(
    "SELECT doc_id FROM documents WHERE regexp_matches(text, "
    + rules.quoted(text.UNSTABLE)
    + ") AND NOT regexp_matches(text, "
    + rules.quoted(text.SEED)
    + ")"
)
def g_nondeterministic(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "documents").where(text.unstable(F.col("text"))).select("doc_id")


@query(
    f"""
SELECT reason, count(*) AS n FROM (
  SELECT CASE WHEN trim(coalesce(prompt, ''), {_WS}) = '' THEN 'no_prompt' WHEN length(prompt) > 2000 THEN 'prompt_too_long' WHEN trim(coalesce(ref_solution, ''), {_WS}) = '' THEN 'no_solution'
    WHEN len(list_filter(coalesce(tests, []), lambda t: t IS NOT NULL AND trim(t, {_WS}) <> '')) = 0 THEN 'no_tests' WHEN nullif(regexp_extract(ref_solution, {_DEF}, 1), '') IS NULL THEN 'no_entry'
    WHEN coalesce(len(list_filter(tests, lambda t: regexp_matches(t, '\\b' || regexp_escape(regexp_extract(ref_solution, {_DEF}, 1)) || '\\s*\\('))), 0) = 0 THEN 'entry_not_called'
    WHEN meta.average_test_score < 1 THEN 'score' ELSE 'kept' END AS reason FROM problems
) GROUP BY 1
"""
)
def g_extract_funnel(spark: SparkSession, folder: str) -> DataFrame:
    p, s = F.col("prompt"), F.col("ref_solution")
    tests, entry = text.clean_tests(F.col("tests")), text.entry_name(s)
    reason = (
        F.when(text.blank(p), "no_prompt").when(F.length(p) > 2000, "prompt_too_long").when(text.blank(s), "no_solution").when(F.size(tests) == 0, "no_tests")
        .when(entry.isNull(), "no_entry").when(~text.calls(entry, tests), "entry_not_called").when(F.col("meta.average_test_score") < 1, "score").otherwise("kept")
    )
    return table(spark, folder, "problems").groupBy(reason.alias("reason")).agg(F.count(F.lit(1)).alias("n"))


@query(f"SELECT id, prompt FROM (SELECT id, prompt, row_number() OVER (PARTITION BY id ORDER BY prompt) AS r FROM problems WHERE id IS NOT NULL AND ref_solution IS NOT NULL AND trim(coalesce(prompt, ''), {_WS}) <> '') WHERE r = 1")
def g_gold(spark: SparkSession, folder: str) -> DataFrame:
    from weftline.operators.order import first_by

    rows = table(spark, folder, "problems").where("id is not null and ref_solution is not null").where(~text.blank(F.col("prompt"))).select("id", "prompt")
    return first_by(rows, ["id"], ["prompt"])


# Joins

_TRIPLE = """
WITH c AS (SELECT id, completion FROM (SELECT id, completion, row_number() OVER (PARTITION BY id ORDER BY k_index NULLS FIRST, seed_used NULLS FIRST, completion NULLS FIRST) AS r FROM candidates WHERE id IS NOT NULL) WHERE r = 1),
p AS (SELECT id, prompt, entry FROM (SELECT id, prompt, entry, row_number() OVER (PARTITION BY id ORDER BY prompt DESC NULLS LAST, entry DESC NULLS LAST) AS r FROM problems WHERE id IS NOT NULL) WHERE r = 1),
j AS (
  SELECT r.id, r.passed, c.completion, CASE WHEN w.id IS NOT NULL THEN w.prompt ELSE b.prompt END AS prompt
  FROM results r LEFT JOIN c ON c.id = r.id LEFT JOIN p w ON w.id = r.id LEFT JOIN p b ON b.id = split_part(r.id, '#k', 1)
)
SELECT CASE WHEN NOT coalesce(passed, false) THEN 'skipped_failed' WHEN coalesce(completion, '') = '' THEN 'skipped_no_candidate' WHEN coalesce(prompt, '') = '' THEN 'skipped_no_problem' ELSE 'kept' END AS outcome, id
FROM j
"""


def _executed(spark: SparkSession, folder: str) -> DataFrame:
    return joins.executed(table(spark, folder, "results"), table(spark, folder, "candidates"), table(spark, folder, "problems"))


@query(f"SELECT outcome, id, count(*) AS n FROM ({_TRIPLE}) GROUP BY 1, 2")
def j_esd_triple(spark: SparkSession, folder: str) -> DataFrame:
    return _executed(spark, folder).groupBy("outcome", "id").agg(F.count(F.lit(1)).alias("n"))


@query(
    """
WITH p AS (SELECT DISTINCT id FROM problems WHERE id IS NOT NULL),
r AS (SELECT id, passed, reason FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY received_at DESC NULLS LAST, passed DESC NULLS LAST, reason DESC NULLS LAST) AS k FROM results WHERE id IS NOT NULL) WHERE k = 1)
SELECT c.id, c.k_index, CASE WHEN p.id IS NULL THEN 'NO_PROBLEM' WHEN r.id IS NULL THEN 'NO_RESULT' WHEN coalesce(r.passed, false) THEN 'PASS' ELSE coalesce(r.reason, 'UNKNOWN') END AS verdict
FROM candidates c LEFT JOIN p ON p.id = split_part(c.id, '#k', 1) LEFT JOIN r ON r.id = c.id
"""
)
def j_sandbox_lookup(spark: SparkSession, folder: str) -> DataFrame:
    return joins.looked_up(table(spark, folder, "candidates"), table(spark, folder, "problems"), table(spark, folder, "results"))


@query("SELECT id, entry FROM heldout_problems UNION ALL SELECT id, entry FROM problems WHERE id NOT IN (SELECT id FROM heldout_problems)")
def j_merge_tasks(spark: SparkSession, folder: str) -> DataFrame:
    return joins.overridden(table(spark, folder, "problems").select("id", "entry"), table(spark, folder, "heldout_problems").select("id", "entry"), "id")


@query("SELECT h.id, p.profile, CAST(k AS INTEGER) AS seed FROM heldout_problems h, pack_profiles p, range(0, 3) t(k)")
def j_generation_grid(spark: SparkSession, folder: str) -> DataFrame:
    """Tasks by models by seeds; both sides of the grid are settings of fixed size."""
    seeds = spark.range(3).select(F.col("id").cast("int").alias("seed"))
    grid = table(spark, folder, "pack_profiles").select("profile").crossJoin(F.broadcast(seeds))
    return table(spark, folder, "heldout_problems").select("id").crossJoin(F.broadcast(grid))
