"""Queries over verdicts, candidates and training logs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.operators import evals, joins
from weftline.plans.catalog import query
from weftline.session import table

_DONE = "d AS (SELECT DISTINCT id, passed, reason FROM results WHERE id IS NOT NULL), v AS (SELECT split_part(id, '#k', 1) AS task, CAST(split_part(id, '#k', 2) AS INTEGER) AS seed, coalesce(passed, false) AS passed, reason FROM d WHERE regexp_matches(id, '^[^#]*#k[0-9]+$'))"


def _verdicts(spark: SparkSession, folder: str) -> DataFrame:
    """Distinct verdicts by task and seed; a candidate's number stands for the seed."""
    done = table(spark, folder, "results").where("id is not null").select("id", "passed", "reason").distinct().where(F.rlike("id", F.lit("^[^#]*#k[0-9]+$")))
    return done.select(joins.base_id(F.col("id")).alias("task"), F.split_part("id", F.lit("#k"), F.lit(2)).cast("int").alias("seed"), F.coalesce("passed", F.lit(False)).alias("passed"), "reason")


@query("SELECT coalesce(reason, 'none') AS reason, count(*) AS n FROM results GROUP BY 1")
def a_counter(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "results").groupBy(F.coalesce("reason", F.lit("none")).alias("reason")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT source, count(*) AS n, CAST(sum(coalesce(length(text), 0)) AS BIGINT) AS n_chars, count(DISTINCT repo) AS n_repos FROM documents GROUP BY 1")
def a_per_source(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "documents").groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.sum(F.coalesce(F.length("text"), F.lit(0)).cast("long")).alias("n_chars"), F.countDistinct("repo").alias("n_repos"))


@query(f"WITH {_DONE} SELECT seed, CAST(sum(passed::INT) AS BIGINT) AS k, count(*) AS n, round(sum(passed::INT) / count(*), 4) AS rate FROM v GROUP BY 1")
def a_pass_rate(spark: SparkSession, folder: str) -> DataFrame:
    return evals.pass_rate(_verdicts(spark, folder), ["seed"])


@query(f"WITH {_DONE} SELECT count(*) FILTER (WHERE k > 0) AS solved, count(*) AS tasks FROM (SELECT task, sum(passed::INT) AS k FROM v GROUP BY 1)")
def a_any_pass(spark: SparkSession, folder: str) -> DataFrame:
    return _verdicts(spark, folder).groupBy("task").agg(F.bool_or("passed").alias("ok")).agg(F.count_if("ok").alias("solved"), F.count(F.lit(1)).alias("tasks"))


@query(f"WITH {_DONE} SELECT task, CAST(sum(passed::INT) AS VARCHAR) || '/' || count(*) AS score, CAST(sum(CASE WHEN seed = 0 THEN passed::INT ELSE 0 END) AS BIGINT) AS seed0, CAST(sum(CASE WHEN seed = 1 THEN passed::INT ELSE 0 END) AS BIGINT) AS seed1 FROM v GROUP BY 1")
def a_pivot_tasks(spark: SparkSession, folder: str) -> DataFrame:
    v = _verdicts(spark, folder)
    wide = v.groupBy("task").pivot("seed", [0, 1]).agg(F.sum(F.col("passed").cast("long")))
    rates = evals.pass_rate(v, ["task"]).select("task", F.concat(F.col("k").cast("string"), F.lit("/"), F.col("n").cast("string")).alias("score"))
    return rates.join(wide, "task").select("task", "score", F.coalesce("0", F.lit(0)).alias("seed0"), F.coalesce("1", F.lit(0)).alias("seed1"))


@query(f"WITH {_DONE} SELECT seed, CAST(sum(k) AS BIGINT) AS k, CAST(sum(n) AS BIGINT) AS n, round(sum(k) / sum(n) * 55, 1) AS of55 FROM (SELECT seed, task, sum(passed::INT) AS k, count(*) AS n FROM v GROUP BY 1, 2) GROUP BY 1")
def a_sum_fractions(spark: SparkSession, folder: str) -> DataFrame:
    summed = evals.fractions(_verdicts(spark, folder), "seed", "task").select("seed", evals.sum_fractions(F.col("tasks")).alias("s"))
    return summed.select("seed", "s.k", "s.n", evals.rescaled(F.col("s.k"), F.col("s.n"), 55).alias("of55"))


@query(f"WITH {_DONE} SELECT CAST(sum(passed::INT) AS BIGINT) AS k, count(*) AS n, round(sum(passed::INT) / count(*) * 110, 1) AS of110 FROM v")
def a_rescale(spark: SparkSession, folder: str) -> DataFrame:
    total = _verdicts(spark, folder).agg(F.sum(F.col("passed").cast("long")).alias("k"), F.count(F.lit(1)).alias("n"))
    return total.select("k", "n", evals.rescaled(F.col("k"), F.col("n"), 110).alias("of110"))


@query(f"WITH {_DONE} SELECT seed, CAST(sum(passed::INT) AS BIGINT) AS strict, CAST(sum((passed OR reason = 'wrong_answer')::INT) AS BIGINT) AS lenient, CAST(sum((NOT passed AND reason = 'wrong_answer')::INT) AS BIGINT) AS delta FROM v GROUP BY 1")
def a_rejudge(spark: SparkSession, folder: str) -> DataFrame:
    """Strict passes, and those that a second, lenient verdict adds; here a reason stands for the second verdict."""
    second = ~F.col("passed") & F.coalesce(F.col("reason") == "wrong_answer", F.lit(False))
    return _verdicts(spark, folder).groupBy("seed").agg(
        F.sum(F.col("passed").cast("long")).alias("strict"), F.sum((F.col("passed") | second).cast("long")).alias("lenient"), F.sum(second.cast("long")).alias("delta")
    )


@query("SELECT run_id, count(*) AS n, min(step) AS first_step, max(step) AS last_step, count(DISTINCT step) AS steps, count(val_loss) AS n_val FROM training_log GROUP BY 1")
def a_index(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "training_log").groupBy("run_id").agg(
        F.count(F.lit(1)).alias("n"), F.min("step").alias("first_step"), F.max("step").alias("last_step"), F.countDistinct("step").alias("steps"), F.count("val_loss").alias("n_val")
    )


@query(f"WITH {_DONE} SELECT seed, coalesce(reason, 'none') AS reason, count(*) AS n FROM v WHERE NOT passed GROUP BY 1, 2")
def a_fail_breakdown(spark: SparkSession, folder: str) -> DataFrame:
    return _verdicts(spark, folder).where("not passed").groupBy("seed", F.coalesce("reason", F.lit("none")).alias("reason")).agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {_DONE} SELECT seed, reason, CAST(sum(passed::INT) AS BIGINT) AS k, count(*) AS n, grouping(seed, reason) AS level FROM v GROUP BY ROLLUP (seed, reason)")
def a_audit_matrix(spark: SparkSession, folder: str) -> DataFrame:
    return _verdicts(spark, folder).rollup("seed", "reason").agg(F.sum(F.col("passed").cast("long")).alias("k"), F.count(F.lit(1)).alias("n"), F.grouping_id().alias("level"))


_SCORES = "s AS (SELECT m.domain AS domain, v.seed, sum(v.passed::INT) AS k FROM v JOIN (SELECT id, max(meta.domain) AS domain FROM problems GROUP BY 1) m ON m.id = v.task WHERE m.domain IS NOT NULL GROUP BY 1, 2)"


def _scores(spark: SparkSession, folder: str) -> DataFrame:
    domains = table(spark, folder, "problems").groupBy("id").agg(F.max("meta.domain").alias("domain")).where("domain is not null")
    return _verdicts(spark, folder).join(domains, F.col("task") == F.col("id")).groupBy("domain", "seed").agg(F.sum(F.col("passed").cast("long")).alias("k"))


@query(f"WITH {_DONE}, {_SCORES} SELECT domain, CAST(sum((r = 1)::INT) AS BIGINT) AS firsts FROM (SELECT *, rank() OVER (PARTITION BY seed ORDER BY k DESC) AS r FROM s) GROUP BY 1")
def a_seed_rank(spark: SparkSession, folder: str) -> DataFrame:
    return evals.first_places(_scores(spark, folder), "seed", "domain", "k")


@query(f"WITH {_DONE}, {_SCORES} SELECT a.domain, count(*) FILTER (WHERE a.k - b.k >= 0) AS non_negative, count(*) FILTER (WHERE a.k - b.k < 0) AS negative FROM s a JOIN s b ON a.seed = b.seed AND b.domain = 'software' GROUP BY 1")
def a_sign_cells(spark: SparkSession, folder: str) -> DataFrame:
    s = _scores(spark, folder)
    base = s.where("domain = 'software'").select("seed", F.col("k").alias("kb"))
    return s.join(base, "seed").groupBy("domain").agg(F.count_if(F.col("k") - F.col("kb") >= 0).alias("non_negative"), F.count_if(F.col("k") - F.col("kb") < 0).alias("negative"))


@query(
    """
SELECT source, CAST(sum(n_chars) AS BIGINT) AS chars, round(sum(n_chars) / sum(w), 4) AS chars_per_word, round(avg(w), 4) AS mean_words, round(stddev_pop(w), 4) AS sd_words
FROM (SELECT source, n_chars, len(regexp_extract_all(text, '[A-Za-z0-9_]+')) AS w FROM documents WHERE n_chars > 0) GROUP BY 1
"""
)
def a_compression(spark: SparkSession, folder: str) -> DataFrame:
    """Characters to a unit, with mean and population deviation; words stand for tokens here."""
    sized = table(spark, folder, "documents").where("n_chars > 0").select("source", "n_chars", F.regexp_count("text", F.lit("[A-Za-z0-9_]+")).alias("w"))
    return sized.groupBy("source").agg(
        F.sum("n_chars").alias("chars"), F.round(F.sum("n_chars") / F.sum("w"), 4).alias("chars_per_word"), F.round(F.avg("w"), 4).alias("mean_words"), F.round(F.stddev_pop("w"), 4).alias("sd_words")
    )


_LOG = "l AS (SELECT DISTINCT run_id, step, total_tokens, loss, lr, val_loss, elapsed_s, tok_per_sec FROM training_log), u AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY run_id, step ORDER BY total_tokens, loss NULLS FIRST, val_loss NULLS FIRST) AS r FROM l) WHERE r = 1)"


def _log(spark: SparkSession, folder: str) -> DataFrame:
    """One row for each run and step."""
    from weftline.operators.order import first_by

    rows = table(spark, folder, "training_log").select("run_id", "step", "total_tokens", "loss", "val_loss", "elapsed_s", "tok_per_sec")
    return first_by(rows, ["run_id", "step"], ["total_tokens", "loss", "val_loss"])


@query(f"WITH {_LOG} SELECT run_id, round(coalesce(sum(loss * total_tokens), 0) / greatest(sum(CASE WHEN loss IS NOT NULL THEN total_tokens END), 1), 6) AS loss FROM u GROUP BY 1")
def a_loss_weighted(spark: SparkSession, folder: str) -> DataFrame:
    return _log(spark, folder).groupBy("run_id").agg(F.round(evals.weighted_mean("loss", "total_tokens"), 6).alias("loss"))


@query(f"WITH {_LOG} SELECT run_id, step, round(avg(loss) OVER (PARTITION BY run_id ORDER BY step ROWS BETWEEN 9 PRECEDING AND CURRENT ROW), 6) AS mean FROM u")
def a_window_mean_log(spark: SparkSession, folder: str) -> DataFrame:
    return evals.trailing_mean(_log(spark, folder), "run_id", ["step"], "loss", 10).select("run_id", "step", F.round("mean", 6).alias("mean"))


@query(
    f"""
WITH {_LOG}, b AS (SELECT run_id, step, val_loss, min(val_loss) OVER (PARTITION BY run_id ORDER BY step ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS best,
  min(val_loss) OVER (PARTITION BY run_id ORDER BY step ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM u)
SELECT run_id, step, best, coalesce(val_loss IS NOT NULL AND (before IS NULL OR val_loss < before), false) AS is_new FROM b WHERE val_loss IS NOT NULL
"""
)
def a_best_so_far(spark: SparkSession, folder: str) -> DataFrame:
    return evals.best_so_far(_log(spark, folder), "run_id", ["step"], "val_loss").where("val_loss is not null").select("run_id", "step", "best", "is_new")


@query(f"WITH {_LOG} SELECT run_id, CAST(max(total_tokens) - min(total_tokens) AS BIGINT) AS tokens, round((max(total_tokens) - min(total_tokens)) / greatest(max(elapsed_s) - min(elapsed_s), 1), 3) AS per_second FROM u GROUP BY 1")
def a_throughput(spark: SparkSession, folder: str) -> DataFrame:
    span = F.max("total_tokens") - F.min("total_tokens")
    return _log(spark, folder).groupBy("run_id").agg(span.alias("tokens"), F.round(span / F.greatest(F.max("elapsed_s") - F.min("elapsed_s"), F.lit(1)), 3).alias("per_second"))


@query("SELECT b.batch, b.accum, CAST(greatest(1, n // (b.batch * b.accum)) AS BIGINT) AS steps FROM (SELECT count(*) AS n FROM documents), (VALUES (2, 16), (4, 8), (8, 4), (16, 2)) b(batch, accum)")
def a_step_table(spark: SparkSession, folder: str) -> DataFrame:
    configs = F.array(*[F.struct(F.lit(b).alias("batch"), F.lit(a).alias("accum")) for b, a in ((2, 16), (4, 8), (8, 4), (16, 2))])
    return table(spark, folder, "documents").agg(F.count(F.lit(1)).alias("n")).select("n", F.inline(configs)).select("batch", "accum", F.greatest(F.lit(1).cast("long"), F.expr("n div (batch * accum)")).alias("steps"))


_VECTORS = "x AS (SELECT label, vec_id, unnest(embedding) AS v, unnest(range(0, len(embedding))) AS k FROM embeddings)"


@query(f"WITH {_VECTORS}, m AS (SELECT label, k, avg(CAST(v AS DOUBLE)) AS m FROM x GROUP BY 1, 2) SELECT label, round(sum(m), 5) AS total, count(*) AS n FROM m GROUP BY 1")
def a_uniform_avg(spark: SparkSession, folder: str) -> DataFrame:
    mean = evals.average_vectors(table(spark, folder, "embeddings").withColumn("embedding", F.col("embedding").cast("array<double>")), "embedding", by=["label"])
    return mean.select("label", F.round(F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x), 5).alias("total"), F.size("embedding").cast("long").alias("n"))


@query(
    f"""
WITH {_VECTORS}, c AS (SELECT count(*) FILTER (WHERE label = 0) AS nl, count(*) FILTER (WHERE label <> 0) AS nh FROM embeddings),
w AS (SELECT k, sum(v * CASE WHEN label = 0 THEN 0.3 / nl ELSE 0.7 / nh END) / sum(CASE WHEN label = 0 THEN 0.3 / nl ELSE 0.7 / nh END) AS m FROM x, c GROUP BY 1)
SELECT round(sum(m), 5) AS total, count(*) AS n FROM w
"""
)
def a_weighted_avg(spark: SparkSession, folder: str) -> DataFrame:
    weighted = evals.step_weights(table(spark, folder, "embeddings").withColumn("embedding", F.col("embedding").cast("array<double>")), F.col("label") == 0)
    mean = evals.average_vectors(weighted, "embedding", F.col("weight"))
    return mean.select(F.round(F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x), 5).alias("total"), F.size("embedding").cast("long").alias("n"))


@query("SELECT a.vec_id, round(list_sum(list_transform(range(1, len(a.embedding) + 1), lambda i: 0.75 * CAST(a.embedding[i] AS DOUBLE) + 0.25 * CAST(b.embedding[i] AS DOUBLE))), 5) AS total FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1")
def a_blend(spark: SparkSession, folder: str) -> DataFrame:
    v = table(spark, folder, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("a"))
    pairs = v.join(v.select((F.col("vec_id") - 1).alias("vec_id"), F.col("a").alias("b")), "vec_id")
    return pairs.select("vec_id", F.round(F.aggregate(evals.blend(F.col("a"), F.col("b"), 0.25), F.lit(0.0), lambda s, x: s + x), 5).alias("total"))


# Joins and ranking of evaluations


@query(f"WITH {_DONE}, a AS (SELECT task, count(*) AS n FROM v WHERE seed = 0 GROUP BY 1), b AS (SELECT task, count(*) AS n FROM v WHERE seed = 1 GROUP BY 1) SELECT task, n, 'old' AS origin FROM a WHERE task NOT IN (SELECT task FROM b) UNION ALL SELECT task, n, 'new' FROM b")
def j_upsert(spark: SparkSession, folder: str) -> DataFrame:
    v = _verdicts(spark, folder)
    part = lambda k, word: v.where(F.col("seed") == k).groupBy("task").agg(F.count(F.lit(1)).alias("n")).withColumn("origin", F.lit(word))
    return joins.upsert(part(0, "old"), part(1, "new"), ["task"])


@query(f"WITH {_DONE}, a AS (SELECT task, bool_or(passed) AS p FROM v WHERE seed = 0 GROUP BY 1), b AS (SELECT task, bool_or(passed) AS p FROM v WHERE seed = 1 GROUP BY 1) SELECT a.task, CASE WHEN a.p THEN 'pass' ELSE 'fail' END AS one, CASE WHEN b.p IS NULL THEN '-' WHEN b.p THEN 'pass' ELSE 'fail' END AS two FROM a LEFT JOIN b USING (task)")
def j_compare_columns(spark: SparkSession, folder: str) -> DataFrame:
    v = _verdicts(spark, folder)
    word = lambda c: F.when(F.col(c).isNull(), "-").when(F.col(c), "pass").otherwise("fail")
    a, b = (v.where(F.col("seed") == k).groupBy("task").agg(F.bool_or("passed").alias(f"p{k}")) for k in (0, 1))
    return a.join(b, "task", "left").select("task", word("p0").alias("one"), word("p1").alias("two"))


@query(f"WITH {_DONE}, a AS (SELECT task, sum(passed::INT) AS k FROM v WHERE seed % 2 = 0 GROUP BY 1), b AS (SELECT task, sum(passed::INT) AS k FROM v WHERE seed % 2 = 1 GROUP BY 1) SELECT task, CAST(a.k AS BIGINT) AS even_k, CAST(b.k AS BIGINT) AS odd_k, CAST(a.k + b.k AS BIGINT) AS total FROM a FULL OUTER JOIN b USING (task)")
def j_soup_report(spark: SparkSession, folder: str) -> DataFrame:
    v = _verdicts(spark, folder)
    a, b = (v.where(F.col("seed") % 2 == k).groupBy("task").agg(F.sum(F.col("passed").cast("long")).alias(name)) for k, name in ((0, "even_k"), (1, "odd_k")))
    return a.join(b, "task", "full_outer").withColumn("total", F.col("even_k") + F.col("odd_k"))


@query(f"WITH {_DONE}, s AS (SELECT task, seed, count(*) AS n FROM v WHERE passed GROUP BY 1, 2), t AS (SELECT task, seed, count(*) AS m FROM v GROUP BY 1, 2) SELECT task, seed, n, m FROM s JOIN t USING (task, seed)")
def j_mix_seed_shards(spark: SparkSession, folder: str) -> DataFrame:
    v = _verdicts(spark, folder)
    s = v.where("passed").groupBy("task", "seed").agg(F.count(F.lit(1)).alias("n"))
    return s.join(v.groupBy("task", "seed").agg(F.count(F.lit(1)).alias("m")), ["task", "seed"])


_ASOF = f"""
WITH {_LOG}, base AS (SELECT run_id FROM u GROUP BY 1 ORDER BY count(*) DESC, run_id LIMIT 1),
a AS (SELECT run_id, total_tokens, val_loss FROM u WHERE val_loss IS NOT NULL AND run_id NOT IN (SELECT run_id FROM base)), b AS (SELECT total_tokens, val_loss FROM u JOIN base USING (run_id) WHERE val_loss IS NOT NULL),
c AS (SELECT a.run_id, a.total_tokens, a.val_loss, b.total_tokens AS t, b.val_loss AS v, row_number() OVER (PARTITION BY a.run_id, a.total_tokens, a.val_loss ORDER BY abs(a.total_tokens - b.total_tokens), b.total_tokens, b.val_loss) AS k
  FROM a JOIN b ON abs(a.total_tokens - b.total_tokens) <= 60000000)
SELECT run_id, total_tokens, val_loss, t AS total_tokens_right, v AS val_loss_right FROM c WHERE k = 1
"""


@query(_ASOF)
def j_asof_val(spark: SparkSession, folder: str) -> DataFrame:
    """Validation losses of every run beside the nearest ones of the longest run."""
    log = _log(spark, folder).where("run_id is not null")
    base = log.groupBy("run_id").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "run_id").limit(1).select(F.col("run_id").alias("base"))
    rows = log.where("val_loss is not null").crossJoin(F.broadcast(base))  # one row
    others = rows.where("run_id <> base").select("run_id", "total_tokens", "val_loss")
    return joins.nearest(others, rows.where("run_id = base").select("total_tokens", "val_loss"), "total_tokens", "val_loss", 60_000_000)


@query(f"WITH {_DONE} SELECT task, CAST(sum(passed::INT) AS BIGINT) AS k FROM v GROUP BY 1 ORDER BY k DESC, task LIMIT 10")
def t_topk_rank(spark: SparkSession, folder: str) -> DataFrame:
    return _verdicts(spark, folder).groupBy("task").agg(F.sum(F.col("passed").cast("long")).alias("k")).orderBy(F.desc("k"), "task").limit(10)


@query(f"WITH {_DONE} SELECT seed, task, passed FROM (SELECT *, row_number() OVER (PARTITION BY seed ORDER BY task, passed, reason NULLS FIRST) AS r FROM v) WHERE r <= 3")
def t_grouped_limit(spark: SparkSession, folder: str) -> DataFrame:
    from weftline.operators.order import at_most

    return at_most(_verdicts(spark, folder), ["seed"], ["task", "passed", "reason"], 3).select("seed", "task", "passed")


@query(f"WITH {_LOG}, m AS (SELECT run_id, max(step) AS top FROM u GROUP BY 1) SELECT run_id, step FROM u JOIN m USING (run_id) WHERE step >= top - 500")
def t_window_last(spark: SparkSession, folder: str) -> DataFrame:
    from pyspark.sql import Window

    last = F.max("step").over(Window.partitionBy("run_id"))
    return _log(spark, folder).withColumn("top", last).where(F.col("step") >= F.col("top") - 500).select("run_id", "step")


@query("SELECT doc_id FROM documents ORDER BY md5('7:' || doc_id), doc_id LIMIT 250")
def t_val_chunks(spark: SparkSession, folder: str) -> DataFrame:
    from weftline.operators.order import hashed_sample

    return hashed_sample(table(spark, folder, "documents").select("doc_id"), "doc_id", 250, 7).orderBy("doc_id")


@query("SELECT repo, count(*) AS n FROM documents WHERE repo IS NOT NULL GROUP BY 1 ORDER BY repo")
def t_sort_natural(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "documents").where("repo is not null").groupBy("repo").agg(F.count(F.lit(1)).alias("n")).orderBy("repo")


# Small operators


@query(f"WITH {_LOG} SELECT run_id, step FROM u, (SELECT max(step) AS top FROM u) WHERE step % 1000 = 0 OR step >= top - 2000")
def z_retention(spark: SparkSession, folder: str) -> DataFrame:
    return evals.retained(_log(spark, folder).select("run_id", "step"), "step", 1000)


@query("SELECT DISTINCT id FROM problems WHERE id IS NOT NULL AND id NOT IN (SELECT split_part(id, '#k', 1) FROM results WHERE id IS NOT NULL)")
def z_todo_anti(spark: SparkSession, folder: str) -> DataFrame:
    done = table(spark, folder, "results").select(joins.base_id(F.col("id")).alias("id")).where("id is not null").distinct()
    return table(spark, folder, "problems").select("id").where("id is not null").distinct().join(done, "id", "left_anti")


@query("SELECT doc_id, CASE WHEN contains(path, 'third_party') OR contains(path, 'vendor') THEN 'external' WHEN contains(path, '/') THEN string_split(path, '/')[-2] END AS alias FROM documents WHERE path IS NOT NULL")
def z_model_alias(spark: SparkSession, folder: str) -> DataFrame:
    p = F.col("path")
    alias = F.when(F.contains(p, F.lit("third_party")) | F.contains(p, F.lit("vendor")), "external").when(F.contains(p, F.lit("/")), F.element_at(F.split(p, "/"), -2))
    return table(spark, folder, "documents").where("path is not null").select("doc_id", alias.alias("alias"))


@query(f"WITH {_LOG}, r AS (SELECT step, avg(loss) FILTER (WHERE ascii(right(run_id, 1)) % 2 = 0) AS a, avg(loss) FILTER (WHERE ascii(right(run_id, 1)) % 2 = 1) AS b FROM u GROUP BY 1) SELECT step, round(a - b, 6) AS delta, round(100 * (a - b) / b, 4) AS percent, CASE WHEN a < b THEN 'better' ELSE 'worse' END AS verdict FROM r WHERE a IS NOT NULL AND b IS NOT NULL")
def z_delta_pct(spark: SparkSession, folder: str) -> DataFrame:
    side = F.ascii(F.right("run_id", F.lit(1))) % 2
    r = _log(spark, folder).groupBy("step").agg(F.avg(F.when(side == 0, F.col("loss"))).alias("a"), F.avg(F.when(side == 1, F.col("loss"))).alias("b")).where("a is not null and b is not null")
    return r.select("step", F.round(F.col("a") - F.col("b"), 6).alias("delta"), F.round(100 * (F.col("a") - F.col("b")) / F.col("b"), 4).alias("percent"), F.when(F.col("a") < F.col("b"), "better").otherwise("worse").alias("verdict"))


@query(f"WITH {_DONE} SELECT task, round(100.0 * sum(passed::INT) / count(*), 2) AS percent FROM v GROUP BY 1")
def z_pass1_pct(spark: SparkSession, folder: str) -> DataFrame:
    return evals.pass_rate(_verdicts(spark, folder), ["task"]).select("task", evals.pass_percent(F.col("k"), F.col("n")).alias("percent"))


@query("SELECT DISTINCT trim(lower(subject)) AS name FROM subject_labels WHERE subject IS NOT NULL AND subject NOT IN (SELECT subject FROM subjects)")
def z_name_validation(spark: SparkSession, folder: str) -> DataFrame:
    known = table(spark, folder, "subjects").select("subject")
    return table(spark, folder, "subject_labels").where("subject is not null").join(known, "subject", "left_anti").select(F.trim(F.lower("subject")).alias("name")).distinct()


@query("SELECT profile, capacity_tokens, CASE WHEN capacity_tokens <= 1100 THEN 16 WHEN capacity_tokens <= 2100 THEN 8 ELSE 4 END AS batch FROM pack_profiles")
def z_config_grid(spark: SparkSession, folder: str) -> DataFrame:
    c = F.col("capacity_tokens")
    return table(spark, folder, "pack_profiles").select("profile", c, F.when(c <= 1100, 16).when(c <= 2100, 8).otherwise(4).alias("batch"))


@query("SELECT source, CAST(n AS BIGINT) AS n, row_number() OVER (ORDER BY n, source) AS place FROM (SELECT source, count(*) AS n FROM documents WHERE source IS NOT NULL GROUP BY 1)")
def z_order_small_first(spark: SparkSession, folder: str) -> DataFrame:
    from weftline.operators.order import row_numbers

    sizes = table(spark, folder, "documents").where("source is not null").groupBy("source").agg(F.count(F.lit(1)).alias("n"))
    return row_numbers(sizes, ["n", "source"], "place").withColumn("place", F.col("place") + 1)


@query("SELECT id, k_index, completion <> rtrim(completion, ' ' || chr(9) || chr(10) || chr(13)) AS changed FROM candidates WHERE completion IS NOT NULL")
def z_extraction_changed(spark: SparkSession, folder: str) -> DataFrame:
    c = F.col("completion")
    return table(spark, folder, "candidates").where("completion is not null").select("id", "k_index", (c != F.rtrim(c, F.lit(" \t\n\r"))).alias("changed"))


@query(f"WITH {_DONE}, k AS (SELECT task, bool_or(passed) AS p FROM v GROUP BY 1), i AS (SELECT DISTINCT id FROM problems) SELECT coalesce(k.task, i.id) AS task, CASE WHEN i.id IS NULL THEN '?' WHEN k.task IS NULL THEN '—' WHEN k.p THEN 'pass' ELSE 'fail' END AS mark FROM k FULL OUTER JOIN i ON i.id = k.task")
def z_missing_mark(spark: SparkSession, folder: str) -> DataFrame:
    k = _verdicts(spark, folder).groupBy("task").agg(F.bool_or("passed").alias("p"))
    i = table(spark, folder, "problems").select("id").distinct()
    mark = F.when(F.col("id").isNull(), "?").when(F.col("task").isNull(), "—").when(F.col("p"), "pass").otherwise("fail")
    return k.join(i, F.col("task") == F.col("id"), "full_outer").select(F.coalesce("task", "id").alias("task"), mark.alias("mark"))


@query("SELECT CAST((row_number() OVER (ORDER BY id, prompt) - 1) // 64 AS BIGINT) AS batch, id FROM problems")
def z_batches(spark: SparkSession, folder: str) -> DataFrame:
    from weftline.operators.order import row_numbers

    return row_numbers(table(spark, folder, "problems").select("id", "prompt"), ["id", "prompt"], "r").select(F.expr("r div 64").alias("batch"), "id")


@query("SELECT run_id, round(max(elapsed_s), 1) AS elapsed FROM training_log GROUP BY 1")
def z_timing_fields(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "training_log").groupBy("run_id").agg(F.round(F.max("elapsed_s"), 1).alias("elapsed"))


@query(
    """
SELECT step, round(0.0003 * CASE WHEN step < 100 THEN (step + 1) / 100.0 WHEN step < 1000 THEN 1.0
  ELSE 0.1 + 0.9 * 0.5 * (1 + cos(3.141592653589793 * least(greatest((step - 1000) / 4000.0, 0), 1))) END, 12) AS lr FROM (SELECT DISTINCT step FROM training_log)
"""
)
def z_learning_rate(spark: SparkSession, folder: str) -> DataFrame:
    steps = table(spark, folder, "training_log").select("step").distinct()
    return steps.select("step", F.round(evals.learning_rate(F.col("step"), 0.0003, 100, 1000, 5000), 12).alias("lr"))
