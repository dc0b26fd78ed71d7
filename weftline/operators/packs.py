"""Fixed-length chunks from samples of tokens, with their loss masks, and checks on them.

A stream is the samples laid end to end in an explicit order. A sample's offset is the
total of the lengths before it (two levels, no single-task window), and chunks are cut
by arithmetic on offsets: samples that follow each other where they lie are cut into whole
chunks on the spot, and what is left at the ends, less than a chunk each, is gathered by
chunk. Overlapping chunks gather all their pieces, which together never hold more than
a chunk's length.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.operators.order import running_total
from weftline.session import settle

EOS = 4


def sample(prompt: Column, solution: Column, eos: int = EOS) -> Column:
    """(ids, mask) of a sample: prompt, solution and end token; the loss covers all but the prompt."""
    ids = F.concat(prompt, solution, F.array(F.lit(eos)))
    mask = F.concat(F.array_repeat(F.lit(0), F.size(prompt)), F.array_repeat(F.lit(1), F.size(solution) + 1))
    return F.struct(ids.alias("ids"), mask.alias("mask"))


def with_offsets(df: DataFrame, order: list[str], ids: str = "ids") -> DataFrame:
    """``off``: the tokens before each sample."""
    return running_total(df, order, F.size(ids), "off")


def crosses(off: Column, length: Column, chunk: int) -> Column:
    """Whether a sample reaches beyond the chunk in which it begins."""
    return length > chunk - off % chunk


def crossing_mask(mask: Column, off: Column, chunk: int, policy: str = "mask") -> Column:
    """Mask of a sample laid at ``off``: with policy mask, the part beyond its first chunk has no loss; keep leaves it."""
    if policy == "keep":
        return mask
    room = chunk - off % chunk
    return F.transform(mask, lambda m, i: F.when(i >= room, F.lit(0)).otherwise(m))


def _cut(frames: Iterator[pd.DataFrame], chunk: int) -> Iterator[pd.DataFrame]:
    """Whole chunks of neighbouring samples, and the pieces at their ends."""
    for frame in frames:
        if not len(frame):
            continue
        frame = frame.sort_values("off", kind="stable")
        off, size = frame["off"].to_numpy(), frame["ids"].map(len).to_numpy()
        breaks = np.flatnonzero(off[1:] != off[:-1] + size[:-1]) + 1
        for low, high in zip([0, *breaks], [*breaks, len(frame)], strict=True):
            start = int(off[low])
            columns = [np.concatenate(frame[c].iloc[low:high].to_list()) for c in ("ids", "mask")]
            spots = np.unique([start, *range(-(-start // chunk) * chunk, start + len(columns[0]), chunk)])
            pieces = [np.split(c, spots[1:] - start) for c in columns]
            for k in range(0, len(spots), 2000):
                yield pd.DataFrame({"chunk_id": spots[k : k + 2000] // chunk, "at": spots[k : k + 2000], "ids": pieces[0][k : k + 2000], "mask": pieces[1][k : k + 2000]})


def chunks(df: DataFrame, chunk: int, stride: int | None = None, whole: bool = True) -> DataFrame:
    """``chunk_id``, ``ids`` and ``mask`` of every chunk of the stream of samples with ``off``, ``ids`` and ``mask``.

    Chunk k covers the tokens from k * stride on, ``chunk`` of them; the stride is the chunk's
    length unless given (a smaller one makes chunks overlap). With ``whole``, chunks that the stream
    ends in are left out.
    """
    step = stride or chunk
    n = F.size("ids")
    if step == chunk:
        laid = df.where(n > 0).select(F.col("off").cast("long").alias("off"), F.col("ids").cast("array<int>").alias("ids"), F.col("mask").cast("array<int>").alias("mask"))
        pieces = laid.mapInPandas(lambda frames: _cut(frames, chunk), "chunk_id long, at long, ids array<int>, mask array<int>")
        # written once: what is whole and what is left must come from the same batches
        return _gathered(settle(pieces, "pieces"), chunk, whole)
    first = F.greatest(F.lit(0), F.floor((F.col("off") - chunk) / step) + 1).cast("long")
    last = F.floor((F.col("off") + n - 1) / step).cast("long")
    reached = df.where(n > 0).select("off", "ids", "mask", F.explode(F.sequence(first, last)).alias("chunk_id"))
    low = F.greatest(F.col("chunk_id") * step - F.col("off"), F.lit(0)).cast("int")
    high = F.least((F.col("chunk_id") * step + chunk - F.col("off")).cast("int"), F.size("ids"))
    pieces = reached.where(high > low).select("chunk_id", (F.col("off") + low).alias("at"), F.slice("ids", low + 1, high - low).alias("ids"), F.slice("mask", low + 1, high - low).alias("mask"))
    return _gathered(pieces, chunk, whole)


def _gathered(pieces: DataFrame, chunk: int, whole: bool) -> DataFrame:
    """Chunks of pieces ``chunk_id``, ``at``, ``ids``, ``mask``; those that are whole already meet no others."""
    done = F.size("ids") == chunk
    ready, rest = pieces.where(done).select("chunk_id", "ids", "mask"), pieces.where(~done)
    gathered = rest.groupBy("chunk_id").agg(F.sort_array(F.collect_list(F.struct("at", "ids", "mask"))).alias("p"))
    out = gathered.select("chunk_id", F.flatten(F.col("p.ids")).alias("ids"), F.flatten(F.col("p.mask")).alias("mask"))
    return ready.unionByName(out.where(F.size("ids") == chunk) if whole else out)


def pack(df: DataFrame, order: list[str], chunk: int, policy: str = "mask") -> DataFrame:
    """Chunks of samples with ``ids`` and ``mask``, laid in ``order``."""
    laid = with_offsets(df.select(*order, "ids", "mask"), order)
    return chunks(laid.withColumn("mask", crossing_mask(F.col("mask"), F.col("off"), chunk, policy)), chunk)


def mix(parts: list[DataFrame], block: int = 256, mode: str = "concat") -> DataFrame:
    """Chunks of several streams in one, renumbered.

    concat: one stream after the other. interleave: blocks of ``block`` chunks in turn, until all
    are used up.
    """
    tagged = None
    for k, part in enumerate(parts):
        at = part.select(F.lit(k).alias("_part"), F.floor(F.col("chunk_id") / block).cast("long").alias("_block"), F.col("chunk_id").alias("_old"), "ids", "mask")
        tagged = at if tagged is None else tagged.unionByName(at)
    order = ["_part", "_old"] if mode == "concat" else ["_block", "_part", "_old"]
    return running_total(tagged, order, F.lit(1), "chunk_id").select("chunk_id", "ids", "mask")


def replay(df: DataFrame, pool: DataFrame, share: float, seed: int = 42) -> DataFrame:
    """Each chunk replaced, with probability ``share``, by a chunk of the pool with loss on all tokens.

    The choice depends on the chunk's number and the seed alone.
    """
    size = max(1, pool.count())
    spin = F.pmod(F.xxhash64(F.lit(seed), "chunk_id"), F.lit(1_000_000))
    marked = df.withColumn("_swap", spin < int(share * 1_000_000)).withColumn("_pick", F.pmod(F.xxhash64(F.lit(seed + 1), "chunk_id"), F.lit(size)))
    numbered = running_total(pool.select("chunk_id", F.col("ids").alias("_ids")), ["chunk_id"], F.lit(1), "_pick").select("_pick", "_ids")
    swapped = marked.where("_swap").join(numbered, "_pick").select("chunk_id", F.col("_ids").alias("ids"), F.transform("_ids", lambda _: F.lit(1)).alias("mask"))
    return marked.where("not _swap").select("chunk_id", "ids", "mask").unionByName(swapped)


def epochs(df: DataFrame, count: int, start: int = 0) -> DataFrame:
    """The chunks ``count`` times over, numbered on, from position ``start``."""
    total = F.broadcast(df.agg(F.count(F.lit(1)).alias("_n")))
    many = df.withColumn("epoch", F.explode(F.sequence(F.lit(0), F.lit(count - 1)))).crossJoin(total)
    return many.withColumn("position", F.col("epoch") * F.col("_n") + F.col("chunk_id")).where(F.col("position") >= start).drop("_n")


def shuffled_pools(df: DataFrame, order: list[str], length: str, pool: int, seed: int = 42) -> DataFrame:
    """``pool_id`` and ``place``: samples fall into pools of about ``pool`` tokens in order and are shuffled within."""
    from pyspark.sql import Window

    laid = running_total(df, order, length, "_b").withColumn("pool_id", F.floor(F.col("_b") / pool).cast("long")).drop("_b")
    keys = [F.xxhash64(F.lit(seed), *[F.col(c).cast("string") for c in order]), *[F.col(c) for c in order]]
    return laid.withColumn("place", F.row_number().over(Window.partitionBy("pool_id").orderBy(*keys)))


def stats(df: DataFrame) -> DataFrame:
    """Chunks, tokens, loss tokens, their share (4 decimals), and chunks without any loss."""
    loss = F.aggregate("mask", F.lit(0).cast("long"), lambda a, m: a + m)
    return df.agg(
        F.count(F.lit(1)).alias("n_chunks"),
        F.coalesce(F.sum(F.size("ids").cast("long")), F.lit(0)).alias("tokens"),
        F.coalesce(F.sum(loss), F.lit(0)).alias("loss_tokens"),
        F.round(F.coalesce(F.try_divide(F.sum(loss), F.sum(F.size("ids"))), F.lit(0.0)), 4).alias("loss_share"),
        F.coalesce(F.sum((loss == 0).cast("long")), F.lit(0)).alias("zero_loss_chunks"),
    )


def sample_faults(df: DataFrame, chunk: int) -> DataFrame:
    """Samples whose mask isn't zeros, ones, zeros, or whose second zeros don't begin at a chunk's start; no row is good."""
    digits = F.array_join(F.transform("mask", lambda m: m.cast("string")), "")
    tail = F.length(digits) - F.length(F.regexp_replace(digits, "(?<=1)0+$", ""))
    starts = (F.col("off") + F.size("mask") - tail) % chunk
    fault = (
        F.when(F.size("mask") != F.size("ids"), "length")
        .when(~digits.rlike("^0*1*0*$"), "shape")
        .when(~F.contains(digits, F.lit("1")), "no_loss")
        .when((tail > 0) & (starts != 0), "boundary")
    )
    return df.withColumn("fault", fault).where("fault is not null")


def chunk_faults(df: DataFrame, chunk: int, vocabulary: int, reserved: tuple[int, ...] = (2, 3)) -> DataFrame:
    """``chunk_id`` and ``fault`` of chunks that break the contract; no row is good."""
    loss = F.exists("mask", lambda m: m != 0)
    faults = F.array_compact(
        F.array(
            F.when((F.size("ids") != chunk) | (F.size("mask") != chunk), F.lit("length")),
            F.when(F.exists("ids", lambda i: (i < 0) | (i >= vocabulary)), F.lit("vocabulary")),
            F.when(F.exists("mask", lambda m: ~m.isin(0, 1)), F.lit("mask_value")),
            F.when(~loss, F.lit("no_loss")),
            F.when(F.arrays_overlap("ids", F.array(*[F.lit(r) for r in reserved])), F.lit("reserved")),
        )
    )
    return df.select("chunk_id", F.explode(faults).alias("fault"))


def heads(df: DataFrame) -> DataFrame:
    """Chunks whose second label has loss (they begin within a solution), and the others."""
    return df.groupBy(F.when(F.element_at("mask", 2) == 1, "within_solution").otherwise("clean").alias("head")).agg(F.count(F.lit(1)).alias("n"))


def loss_verdict(df: DataFrame) -> DataFrame:
    """Share of tokens with loss: fatal at none, warn at all, else ok."""
    share = F.try_divide(F.sum(F.aggregate("mask", F.lit(0).cast("long"), lambda a, m: a + m)), F.sum(F.size("mask")))
    return df.agg(share.alias("share")).withColumn("verdict", F.when(F.coalesce(F.col("share"), F.lit(0.0)) == 0, "fatal").when(F.col("share") == 1, "warn").otherwise("ok"))


def embedded_mask(ids: Column) -> Column:
    """(id, loss) of tokens whose highest of 16 bits is the loss flag."""
    return F.transform(ids, lambda i: F.struct(i.bitwiseAND(F.lit(32767)).alias("id"), F.shiftright(i, 15).alias("loss")))


def mask_source(none: bool = False, explicit: str | None = None, companion: str | None = None, flagged: bool = False, max_id: int | None = None, vocabulary: int | None = None) -> str:
    """Where a stream's mask comes from, by precedence; raises if nothing says."""
    if none:
        return "none"
    if explicit:
        return "explicit"
    if companion:
        return "companion"
    if flagged or (max_id is not None and vocabulary is not None and max_id >= vocabulary):
        return "high_bit"
    raise ValueError("no mask: name one, or say that there is none")
