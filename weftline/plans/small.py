"""Small operators of their own: scans and sinks with checks, flags, samples, self-tests."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.functions import text
from weftline.operators import evals, funnel, order, packs
from weftline.plans.catalog import query
from weftline.plans.packs import _TOKENS, CHUNK, samples
from weftline.session import shared_folder, table, texts
from weftline.sources import readers, sinks


def _folder(spark: SparkSession) -> str:
    return f"{shared_folder(spark)}/weftline/small-{uuid.uuid4().hex}"


def _packed(spark: SparkSession, folder: str) -> DataFrame:
    return packs.pack(samples(spark, folder), ["pair_id"], CHUNK)


@query("SELECT count(*) AS n, CAST(1 AS BIGINT) AS n_bad FROM subjects")
def scan_corrupt_skip(spark: SparkSession, folder: str) -> DataFrame:
    """A broken file among good ones is left out and counted."""
    target = _folder(spark)
    table(spark, folder, "subjects").write.parquet(f"{target}/good")
    spark.createDataFrame([("no parquet",)], "value string").coalesce(1).write.text(f"{target}/text")
    files = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    fs = files(target).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    broken = next(x.getPath() for x in fs.listStatus(files(f"{target}/text")) if x.getPath().getName().startswith("part-"))
    fs.rename(broken, files(f"{target}/good/part-broken.parquet"))
    schema = table(spark, folder, "subjects").schema
    rows = spark.read.schema(schema).option("ignoreCorruptFiles", "true").parquet(f"{target}/good")
    bad = readers.corrupt_files(spark, [f"{target}/good/part-broken.parquet"])
    return rows.agg(F.count(F.lit(1)).alias("n")).withColumn("n_bad", F.lit(len(bad)).cast("long"))


@query("SELECT id FROM problems WHERE ref_solution IS NOT NULL AND len(tests) > 0 ORDER BY id, prompt LIMIT 20")
def scan_rowgroup_early_stop(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "problems").where("ref_solution is not null and size(tests) > 0").orderBy("id", "prompt").limit(20).select("id")


@query("SELECT source, CAST(max(seq) AS BIGINT) AS last_seq FROM documents GROUP BY 1")
def scan_batched_pruned(spark: SparkSession, folder: str) -> DataFrame:
    """Two columns are read; the plan's ReadSchema has no other."""
    return table(spark, folder, "documents").groupBy("source").agg(F.max("seq").alias("last_seq"))


@query("SELECT count(*) AS n, CAST(1 AS BIGINT) AS first_line FROM subjects")
def scan_recursive_glob(spark: SparkSession, folder: str) -> DataFrame:
    target = _folder(spark)
    table(spark, folder, "subjects").coalesce(1).write.json(f"{target}/a/b")
    lines = readers.numbered_lines(spark, target, "*.json")
    return lines.agg(F.count(F.lit(1)).alias("n"), F.min("line_no").cast("long").alias("first_line"))


@query("SELECT CAST(s AS BIGINT) AS step FROM range(100, 1200, 500) t(s)")
def scan_step_dirs(spark: SparkSession, folder: str) -> DataFrame:
    target = _folder(spark)
    for step in (1100, 100, 600):
        table(spark, folder, "subjects").limit(1).write.parquet(f"{target}/step_{step}")
    return readers.step_folders(spark, target).select("step")


@query(f"WITH {_TOKENS} SELECT pos // {CHUNK} AS chunk_id, CAST(sum(mask) AS BIGINT) AS loss FROM tok, total WHERE pos // {CHUNK} < total // {CHUNK} GROUP BY 1")
def scan_bin_mask(spark: SparkSession, folder: str) -> DataFrame:
    """Masks beside a token file; a fault in the files stops the scan."""
    target = _folder(spark)
    sinks.token_file(_packed(spark, folder), target).collect()
    faults = sinks.token_faults(spark, target, CHUNK).head(1)
    if faults:
        raise ValueError(str(faults[0]))
    return sinks.read_masks(spark, target, CHUNK).select("chunk_id", F.aggregate("mask", F.lit(0).cast("long"), lambda a, m: a + m).alias("loss"))


@query(f"WITH {_TOKENS}, c AS (SELECT pos // {CHUNK} AS chunk_id, CAST(sum(id) AS BIGINT) AS id_sum FROM tok, total WHERE pos // {CHUNK} < total // {CHUNK} GROUP BY 1), n AS (SELECT count(*) AS n FROM c) SELECT chunk_id + k * n AS chunk_id, id_sum FROM c, n, (VALUES (0), (1)) v(k)")
def sink_bin_append(spark: SparkSession, folder: str) -> DataFrame:
    target = _folder(spark)
    for _ in range(2):
        sinks.append_tokens(_packed(spark, folder), target, CHUNK)
    return sinks.read_token_file(spark, target, CHUNK).select("chunk_id", F.aggregate("ids", F.lit(0).cast("long"), lambda a, i: a + i).alias("id_sum"))


@query(f"WITH {_TOKENS} SELECT CAST(sum(1) // {CHUNK} AS BIGINT) AS n_chunks FROM tok")
def sink_binwriter(spark: SparkSession, folder: str) -> DataFrame:
    """Ids and masks with the crossing policy and the tail cut, as files; here their number of chunks."""
    target = _folder(spark)
    return sinks.token_file(_packed(spark, folder), target).agg(F.sum("n_chunks").alias("n_chunks"))


@query(f"WITH {_TOKENS} SELECT pos // {CHUNK} AS chunk_id, CAST(max(id) AS BIGINT) AS max_id FROM tok, total WHERE pos // {CHUNK} < total // {CHUNK} GROUP BY 1")
def sink_bin_mem(spark: SparkSession, folder: str) -> DataFrame:
    """Chunks kept as rows; an id that doesn't fit 16 bits fails the query."""
    fits = F.assert_true(F.forall("ids", lambda i: i <= sinks.MOST_ID), F.lit("an id doesn't fit 16 bits"))
    return _packed(spark, folder).withColumn("ok", fits).where("ok is null").select("chunk_id", F.array_max("ids").cast("long").alias("max_id"))


@query(
    """
SELECT pair_id, prompt, solution, source FROM (SELECT *, row_number() OVER (PARTITION BY pair_id ORDER BY loaded_at) AS r FROM prompt_solution WHERE solution IS NOT NULL)
WHERE r = 1 ORDER BY md5('42:' || pair_id), pair_id LIMIT 200
"""
)
def sink_review(spark: SparkSession, folder: str) -> DataFrame:
    """200 pairs for a look by people, the same at every run; of a pair delivered again the first."""
    rows = order.first_by(table(spark, folder, "prompt_solution").where("solution is not null"), ["pair_id"], ["loaded_at"])
    return order.hashed_sample(rows, "pair_id", 200).select("pair_id", "prompt", "solution", "source")


@query("SELECT 'off' AS filters, count(*) AS n FROM documents WHERE ends_with(path, '.py') UNION ALL SELECT 'on', count(*) FILTER (WHERE length(text) >= 50) FROM documents WHERE ends_with(path, '.py')")
def f_toggle(spark: SparkSession, folder: str) -> DataFrame:
    """Python files with the length filter off and on."""
    rows = table(spark, folder, "documents").where(F.endswith("path", F.lit(".py")))
    return rows.agg(F.count(F.lit(1)).alias("off"), F.count_if(F.length("text") >= funnel.LEAST_CHARS).alias("on")).select(F.expr("stack(2, 'off', off, 'on', on) AS (filters, n)"))


@query("SELECT path, CASE WHEN contains(path, '_nl') OR starts_with(path, 'nl_') THEN 'nl' ELSE 'sig' END AS guess FROM documents WHERE path IS NOT NULL")
def s_column_guess(spark: SparkSession, folder: str) -> DataFrame:
    guess = F.when(F.contains("path", F.lit("_nl")) | F.startswith("path", F.lit("nl_")), "nl").otherwise("sig")
    return table(spark, folder, "documents").where("path is not null").select("path", guess.alias("guess"))


@query("SELECT id, CASE WHEN starts_with(id, 'held') THEN 'heldout' WHEN contains(id, 'noise20') THEN 'noise20' ELSE '5-run' END AS bucket FROM (SELECT id FROM problems UNION ALL SELECT id FROM heldout_problems)")
def s_file_bucket(spark: SparkSession, folder: str) -> DataFrame:
    ids = table(spark, folder, "problems").select("id").union(table(spark, folder, "heldout_problems").select("id"))
    return ids.select("id", F.when(F.startswith("id", F.lit("held")), "heldout").when(F.contains("id", F.lit("noise20")), "noise20").otherwise("5-run").alias("bucket"))


@query("SELECT doc_id FROM documents ORDER BY md5('42:' || doc_id), doc_id LIMIT 100")
def t_random_fixed(spark: SparkSession, folder: str) -> DataFrame:
    return order.hashed_sample(table(spark, folder, "documents").select("doc_id"), "doc_id", 100)


@query(f"WITH {_TOKENS}, c AS (SELECT DISTINCT pos // {CHUNK} AS chunk_id FROM tok, total WHERE pos // {CHUNK} < total // {CHUNK}), n AS (SELECT count(*) AS n FROM c) SELECT chunk_id FROM c, n WHERE chunk_id IN (SELECT CAST(round_even(k * (n - 1) / 7.0, 0) AS BIGINT) FROM n, range(0, 8) t(k))")
def t_linspace_probe(spark: SparkSession, folder: str) -> DataFrame:
    return order.even_pick(_packed(spark, folder).select("chunk_id"), ["chunk_id"], 8)


@query(f"WITH {_TOKENS} SELECT pos // {CHUNK} AS chunk_id, CAST(min(id) AS BIGINT) AS min_id, CAST(sum((mask = 0)::INT) AS BIGINT) AS zeros, list(id ORDER BY pos)[1:8] AS first8 FROM tok, total WHERE pos // {CHUNK} < total // {CHUNK} GROUP BY 1")
def a_chunk_stats(spark: SparkSession, folder: str) -> DataFrame:
    zeros = F.size(F.filter("mask", lambda m: m == 0)).cast("long")
    return _packed(spark, folder).select("chunk_id", F.array_min("ids").cast("long").alias("min_id"), zeros.alias("zeros"), F.slice("ids", 1, 8).alias("first8"))


@query(f"WITH {_TOKENS} SELECT CAST(sum((id = 2)::INT) AS BIGINT) AS n_unk, CAST(sum((id = 3)::INT) AS BIGINT) AS n_pad FROM tok")
def v_pad_unk(spark: SparkSession, folder: str) -> DataFrame:
    count = lambda v: F.sum(F.size(F.filter("ids", lambda i: i == v)).cast("long"))
    return samples(spark, folder).agg(count(2).alias("n_unk"), count(3).alias("n_pad"))


@query("SELECT DISTINCT id, md5('### Task' || chr(10) || prompt || chr(10) || chr(10) || '### Code' || chr(10)) AS digest, true AS good FROM problems WHERE prompt IS NOT NULL")
def v_template_sample(spark: SparkSession, folder: str) -> DataFrame:
    """Prompts in the template, and whether they begin with its head and end with its tail."""
    rows = table(spark, folder, "problems").where("prompt is not null").select("id", "prompt").distinct().select("id", text.prompt(F.col("prompt")).alias("p"))
    good = F.startswith("p", F.lit("### Task\n")) & F.endswith("p", F.lit("### Code\n"))
    return rows.select("id", F.md5("p").alias("digest"), good.alias("good"))


@query(f"WITH {_TOKENS} SELECT CAST(sum(1) // {CHUNK} * {CHUNK} AS BIGINT) AS tokens, CAST(0 AS BIGINT) AS faults FROM tok")
def v_consumer(spark: SparkSession, folder: str) -> DataFrame:
    """What a consumer of the files sees: their tokens, and files that don't match their masks."""
    target = _folder(spark)
    tokens = sinks.token_file(_packed(spark, folder), target).agg(F.sum("n_tokens")).head()[0]
    return spark.createDataFrame([(tokens, sinks.token_faults(spark, target, CHUNK).count())], "tokens long, faults long")


@query("SELECT * FROM (VALUES ('none flag', 'none'), ('named', 'explicit'), ('beside', 'companion'), ('flag', 'high_bit'), ('ids', 'high_bit')) v(given, source)")
def v_resolve_mask(spark: SparkSession, folder: str) -> DataFrame:
    cases = [("none flag", {"none": True, "explicit": "m"}), ("named", {"explicit": "m", "companion": "c"}), ("beside", {"companion": "c", "flagged": True}), ("flag", {"flagged": True}), ("ids", {"max_id": 40_000, "vocabulary": 32_000})]
    return spark.createDataFrame([(name, packs.mask_source(**given)) for name, given in cases], "given string, source string")


@query("SELECT 'subjects' AS name, false AS refused UNION ALL SELECT 'nothing', true")
def v_nonempty(spark: SparkSession, folder: str) -> DataFrame:
    """An empty table is not published."""
    rows = []
    for name, df in (("subjects", table(spark, folder, "subjects")), ("nothing", table(spark, folder, "subjects").where("false"))):
        try:
            sinks.publish(df, _folder(spark))
            rows.append((name, False))
        except ValueError:
            rows.append((name, True))
    return spark.createDataFrame(rows, "name string, refused boolean")


@query("SELECT kind, count(*) AS n FROM heldout_problems, (VALUES ('reference'), ('syntax_error'), ('wrong_name'), ('wrong_return'), ('infinite_loop')) v(kind) WHERE ref_solution IS NOT NULL AND entry IS NOT NULL AND kind <> 'syntax_error' GROUP BY 1")
def v_dryrun(spark: SparkSession, folder: str) -> DataFrame:
    """References and their wrong variants that parse; those with broken syntax must not. Nothing is run."""
    rows = table(spark, folder, "heldout_problems").where("ref_solution is not null and entry is not null")
    every = rows.select(F.inline(text.mutants(F.col("ref_solution"), F.col("entry")))).unionByName(rows.select(F.lit("reference").alias("kind"), F.col("ref_solution").alias("code")))
    return every.where(text.compiles(F.col("code"))).groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT * FROM (VALUES ('fence', true), ('foreign', true), ('plain', true), ('banned', true), ('required', true), ('marker', true)) v(name, ok)")
def v_selftest(spark: SparkSession, folder: str) -> DataFrame:
    """Made cases of extraction and of the implementation check, with what must come out."""
    cases = spark.createDataFrame(
        [("fence", "```python\nx = 1\n```", "x = 1"), ("foreign", "```java\nx\n```", None), ("plain", "x = 1", "x = 1"), ("banned", "return sorted(x)", "BANNED sorted("), ("required", "return x", "MISSING for |while "), ("marker", "a### Code\nb", "b")],
        "name string, body string, want string",
    )
    got = (
        F.when(F.col("name").isin("fence", "foreign", "plain"), text.extract_code(F.col("body")))
        .when(F.col("name") == "marker", text.after_last(F.col("body")))
        .otherwise(text.implementation_reason(F.col("body"), ["sorted("], ["for |while "]))
    )
    return cases.select("name", got.eqNullSafe(F.col("want")).alias("ok"))


@query("SELECT a.vec_id, list_transform(range(1, 9), lambda i: round(0.75 * CAST(a.embedding[i] AS DOUBLE) + 0.25 * CAST(b.embedding[i] AS DOUBLE), 6)) AS first8 FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1")
def v_blend_snapshot(spark: SparkSession, folder: str) -> DataFrame:
    """The first 8 elements of each blend with the next vector."""
    v = table(spark, folder, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("a"))
    pairs = v.join(v.select((F.col("vec_id") - 1).alias("vec_id"), F.col("a").alias("b")), "vec_id")
    return pairs.select("vec_id", F.transform(F.slice(evals.blend(F.col("a"), F.col("b"), 0.25), 1, 8), lambda x: F.round(x, 6)).alias("first8"))


@query()
def u_ast_functions(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "candidates").where("completion is not null")
    return rows.select("id", "k_index", F.size(text.function_pairs(text.extract_code(F.col("completion")), methods=True)).alias("n_functions"))


@query()
def u_compile(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "problems").where("ref_solution is not null").select("id", "prompt", text.compiles(F.col("ref_solution")).alias("parses"))


@query()
def u_scrub(spark: SparkSession, folder: str) -> DataFrame:
    docs = texts(spark, folder).where("text is not null")
    return docs.select("doc_id", (text.strip_copyright(F.col("text")) != F.col("text")).alias("touched")).groupBy("touched").agg(F.count(F.lit(1)).alias("n"))


@query()
def u_blake2b(spark: SparkSession, folder: str) -> DataFrame:
    return texts(spark, folder).where("text is not null").select("doc_id", F.hex(text.blake2b8(F.col("text"))).alias("digest"))


@query("SELECT count(*) AS n, CAST((SELECT count(*) FROM (DESCRIBE documents)) AS BIGINT) AS n_columns FROM documents")
def z_schema_preview(spark: SparkSession, folder: str) -> DataFrame:
    df = table(spark, folder, "documents")
    seen = readers.preview(df)
    return spark.createDataFrame([(seen["rows"], len(df.columns))], "n long, n_columns long")


@query("SELECT seed, doc_id FROM (SELECT s AS seed, doc_id, row_number() OVER (PARTITION BY s ORDER BY md5(s || ':' || doc_id), doc_id) AS r FROM documents, (VALUES (9), (10)) v(s)) WHERE r <= 50")
def z_seed_everything(spark: SparkSession, folder: str) -> DataFrame:
    """A sample for each of two seeds; the same rows at every run."""
    df = table(spark, folder, "documents").select("doc_id")
    a, b = (order.hashed_sample(df, "doc_id", 50, seed).select(F.lit(seed).alias("seed"), "doc_id") for seed in (9, 10))
    return a.unionByName(b)


