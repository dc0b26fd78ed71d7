"""Whole flows from source rows to splits, pairs and chunks, put together from the single operators.

Each takes and gives DataFrames; nothing is written but the tables that cut lineage. Rows that are
left out can be counted by their reason from the same verdict columns.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.functions import rules, text
from weftline.operators import dedup, funnel, packs, splits

#: Characters of the longest document that functions are taken from.
MOST_CHARS = 100_000


def build_corpus(df: DataFrame, path: str = "path", body: str = "text", filters: bool = True) -> DataFrame:
    """``df`` with ``clean`` and ``split`` of the files that the funnel accepts; without ``filters`` language and length alone decide.

    The verdict is a projection. Null texts, paths of other languages and short texts are never accepted.
    """
    if filters:
        return funnel.verdicts(df, path, body).where("reason = 'accepted'").drop("reason", "was_stripped")
    kept = funnel.language_only(df, path, body)
    return kept.withColumn("clean", F.col(body)).withColumn("split", splits.md5_split(F.col("clean")))


def build_signature_pairs(df: DataFrame, key: str, body: str = "text", least_chars: int = 50, most_chars: int = 1000, least_lines: int = 3, most_repeats: int = 5, ratio: float = 0.02, docstring: str = "strip") -> DataFrame:
    """``key``, ``place``, ``prompt``, ``solution`` and ``split`` of the functions of source files.

    A prompt is a signature, its solution the body. Bodies outside the limits and those that break a
    quality rule are left out, of equal pairs all but the first, of a template all but ``most_repeats``.
    ``key`` orders documents and is unique.
    """
    whole = df.select(F.col(key).alias("_key"), text.unix_lines(F.col(body)).alias("_text")).where((F.length("_text") <= MOST_CHARS) & F.contains("_text", F.lit("def ")))
    pairs = whole.select("_key", F.posexplode(text.function_pairs(F.col("_text"), docstring=docstring)).alias("place", "p")).select("_key", "place", "p.*")
    s = F.col("solution")
    good = (F.length(s) >= least_chars) & (F.length(s) <= most_chars) & (text.effective_lines(s) >= least_lines) & text.body_reason(s).isNull()
    first = dedup.exact(pairs.where(good), F.concat("prompt", s), ["_key", "place"])
    capped = dedup.template_cap(first, F.concat("prompt", s), ["_key", "place"], most_repeats)
    return capped.select(F.col("_key").alias(key), "place", "prompt", "solution", splits.digest_split(F.concat("prompt", s), ratio).alias("split"))


def build_instruction_pairs(df: DataFrame, at: str, instruction: str = "prompt", code: str = "solution", style: str = "marker", policy: str = "extract", most_prompt: int = 512, most_code: int = 768, least_chars: int = 40, least_lines: int = 2, most_repeats: int = 5, ratio: float = 0.02, blacklist: list[str] = rules.EVALUATION_NAMES, length: Callable[[Column], Column] = F.length) -> DataFrame:
    """``at``, ``prompt``, ``solution`` and ``split`` of instruction pairs that pass the gates, in the order of ``at``, which is unique.

    Code is taken out of its fences; blank sides, code outside the limits (in what ``length`` counts),
    of the wrong kind, that isn't Python or defines a name of the ``blacklist`` are left out. Text,
    instruction and template are deduplicated as in a single pass.
    """
    taken = df.select(F.col(at), text.strip(F.col(instruction)).alias("_ask"), text.extract_code(F.col(code), policy).alias("solution"))
    s, ask = F.col("solution"), F.col("_ask")
    config = rules.contains_any(ask, rules.PAIR_CONFIG) | rules.contains_any(s, rules.PAIR_CONFIG)
    listed = F.coalesce(F.arrays_overlap(text.defined_names(s), F.array(*[F.lit(n) for n in blacklist])), F.lit(False)) if blacklist else F.lit(False)
    good = (
        ~text.blank(ask) & ~text.blank(s) & (length(ask) <= most_prompt) & (length(s) <= most_code) & (F.length(s) >= least_chars)
        & (text.effective_lines(s) >= least_lines) & ~config & rules.autogenerated_reason(s).isNull() & ~listed
    )
    parsed = taken.where(good).where(text.compiles(s))
    kept = dedup.coupled(parsed, F.concat("_ask", F.lit("\n"), "solution"), ask, text.template_key(s), at, most_repeats)
    made = kept.withColumn("prompt", text.prompt(ask, style))
    return made.select(at, "prompt", "solution", splits.digest_split(F.concat("prompt", s), ratio).alias("split"))


def pack_pairs(df: DataFrame, at: str, encode: Callable[[Column], Column], chunk: int, policy: str = "keep") -> DataFrame:
    """``split``, ``chunk_id``, ``ids`` and ``mask``: the pairs of each split as chunks, in the order of ``at``.

    ``encode`` gives the ids of a text; null sides are left out.
    """
    rows = df.where("prompt is not null and solution is not null")
    laid = rows.select("split", at, F.inline(F.array(packs.sample(encode(F.col("prompt")), encode(F.col("solution"))))))
    out = None
    for split in ("train", "val"):
        part = packs.pack(laid.where(F.col("split") == split).select(at, "ids", "mask"), [at], chunk, policy).select(F.lit(split).alias("split"), "chunk_id", "ids", "mask")
        out = part if out is None else out.unionByName(part)
    return out


def verify_pack(chunks: DataFrame, chunk: int, vocabulary: int, reserved: tuple[int, ...] = (2, 3)) -> DataFrame:
    """``split``, ``check`` and ``n`` of packed chunks: their number, tokens and loss tokens, and each fault that occurs."""
    loss = F.aggregate("mask", F.lit(0).cast("long"), lambda a, m: a + m)
    sums = chunks.groupBy("split").agg(F.count(F.lit(1)).alias("chunks"), F.sum(F.size("ids").cast("long")).alias("tokens"), F.sum(loss).alias("loss_tokens"))
    counted = sums.select("split", F.inline(F.array(*[F.struct(F.lit(c).alias("check"), F.col(c).alias("n")) for c in ("chunks", "tokens", "loss_tokens")])))
    faults = packs.chunk_faults(chunks.withColumn("chunk_id", F.struct("split", "chunk_id")), chunk, vocabulary, reserved)
    return counted.unionByName(faults.groupBy(F.col("chunk_id.split").alias("split"), F.concat(F.lit("fault_"), "fault").alias("check")).agg(F.count(F.lit(1)).alias("n")))
