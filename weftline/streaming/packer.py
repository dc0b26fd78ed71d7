"""Packing of a stream: chunks are cut as samples come, and the remainder waits as state, by source."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from weftline.functions.text import let, quality_reason
from weftline.streaming import events

CHUNK = 257
_OUT = "source string, chunk_no bigint, ids array<int>"


def cut(df: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """``source``, ``chunk_no`` and ``ids`` of full chunks of a stream of ``source``, ``at`` and ``ids``.

    Samples of a source are laid in the order of ``at`` within a micro-batch, and batches one after
    the other. Null ids count as none.
    """

    def step(key: tuple[str], frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        number, rest = state.get if state.exists else (0, [])
        rows = pd.concat(list(frames), ignore_index=True).sort_values("at", kind="stable")
        stream = np.concatenate([np.asarray(rest, np.int32), *(np.asarray(ids, np.int32) for ids in rows["ids"] if ids is not None)])
        count = len(stream) // chunk
        state.update((number + count, stream[count * chunk :].tolist()))
        whole = stream[: count * chunk].reshape(count, chunk)
        yield pd.DataFrame({"source": [key[0]] * count, "chunk_no": range(number, number + count), "ids": list(whole)})

    return df.groupBy("source").applyInPandasWithState(step, _OUT, "number bigint, rest array<int>", "append", GroupStateTimeout.NoTimeout)


def filtered(df: DataFrame, body: str = "text") -> DataFrame:
    """Online filter: rows of a stream whose text is there and breaks no quality rule."""
    return df.where(F.col(body).isNotNull()).where(let(F.col(body), lambda c: quality_reason(c).isNull()))


def streamed(spark: SparkSession, path: str) -> DataFrame:
    """Filter, encode and pack the pairs' solutions as they come, an id a code point, by source."""
    rows = filtered(events.source(spark, path), "solution")
    ids = F.transform(F.regexp_extract_all("solution", F.lit("(?s)."), F.lit(0)), lambda c: F.ascii(c))
    made = cut(rows.select(F.coalesce("source", F.lit("none")).alias("source"), F.col("pair_id").alias("at"), ids.alias("ids")))
    return events.result(spark, events.run_available(made), made.schema).select("source", "chunk_no", "ids")
