"""Whole-corpus encoding with a public byte-level BPE.

Short texts are encoded in one go. A long text is cut into segments that are encoded
in parallel; the segments are then concatenated pairwise, level by level, as a tree.
At each join a window around the cut is encoded again and widened until both of its
ends are places where the encoding left and right of it is certain to be the same as
in the whole text, so the result equals that of encoding the text at once.
"""

from __future__ import annotations

import base64
import functools
import os
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Texts up to so many characters are encoded in one go.
LONG_CHARS = 16_384
#: Characters of a segment of a longer text.
SEGMENT_CHARS = 8_192
#: Neighbouring parts that one task joins on each level of the tree.
FAN_IN = 16


def tokenizer_folder() -> str:
    """Folder of the tokenizers' files: $TOKENIZER_DIR, else that of the installed package."""
    return os.environ.get("TOKENIZER_DIR", "/opt/tokenizers")


class Codec:
    """A byte-level BPE read from a file of ranks."""

    def __init__(self, folder: str, name: str = "byte_bpe_50k") -> None:
        import public_tokenizers
        import tiktoken

        with open(os.path.join(folder, f"{name}.tiktoken"), "rb") as file:
            ranks = {base64.b64decode(word): int(rank) for word, rank in (line.split() for line in file if line.strip())}
        self._encoding = tiktoken.Encoding(name, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.width = np.zeros(max(ranks.values()) + 1, dtype=np.int64)
        for word, rank in ranks.items():
            self.width[rank] = len(word)

    def encode(self, text: str) -> list[int]:
        return self._encoding.encode_ordinary(text)


@functools.lru_cache(maxsize=4)
def codec(folder: str, name: str = "byte_bpe_50k") -> Codec:
    """One codec for each Python worker."""
    return Codec(folder, name)


def _kind(char: str) -> str:
    """Class of a character as the pre-tokenizer sees it."""
    import unicodedata

    if char.isspace() and not "\x1c" <= char <= "\x1f":
        return "space"
    letter = unicodedata.category(char)[0]
    return "letter" if letter == "L" else "number" if letter == "N" else "other"


def _certain(left: str, right: str) -> bool:
    """Whether a word always ends between these two neighbours, whatever stands further away.

    No alternative of the pre-tokenizer spans it: white space after anything else; two
    characters of different classes, unless the first is a space (which may belong to
    the next word) or an apostrophe (which may open a contraction).
    """
    a, b = _kind(left), _kind(right)
    if b == "space":
        return a != "space"
    return a not in (b, "space") and left != "'"


def _same_run(left: str, right: str) -> bool:
    """Whether both characters surely belong to one word."""
    a, b = _kind(left), _kind(right)
    return a == b and a != "space" and "'" not in (left, right)


def join_encoded(left: str, left_ids: list[int], right: str, right_ids: list[int], tool: Codec, first: int = 8) -> list[int]:
    """Encoding of ``left + right`` from the encodings of both.

    The window around the cut grows by doubling until each end is settled: either a
    word certainly ends there, or the end lies within one long word and the window's
    outermost token equals the one that was there before. In the second case every
    pair of neighbouring tokens has been seen by an encoding, which for a byte pair
    encoding makes the whole sequence the encoding of its text. A side on which neither
    holds is taken into the window whole.
    """
    if not left:
        return right_ids
    if not right:
        return left_ids
    if _certain(left[-1], right[0]):
        return left_ids + right_ids
    raw_l, raw_r = left.encode(), right.encode()
    ends_l = np.cumsum(tool.width[np.asarray(left_ids[::-1], dtype=np.int64)])
    ends_r = np.cumsum(tool.width[np.asarray(right_ids, dtype=np.int64)])

    def reach(raw: bytes, ends: np.ndarray, size: int, from_end: bool) -> int:
        """Tokens, ``size`` or a few more, after which a whole character ends."""
        while size < len(ends):
            at = len(raw) - int(ends[size - 1]) if from_end else int(ends[size - 1])
            if raw[at] & 0xC0 != 0x80:
                return size
            size += 1
        return len(ends)

    grow_l = grow_r = first
    while True:
        take_l, take_r = reach(raw_l, ends_l, grow_l, True), reach(raw_r, ends_r, grow_r, False)
        at_l = len(raw_l) - int(ends_l[take_l - 1])
        at_r = int(ends_r[take_r - 1])
        inner = tool.encode(raw_l[at_l:].decode() + raw_r[:at_r].decode())
        whole_l, whole_r = take_l == len(ends_l), take_r == len(ends_r)
        good_l = whole_l or _settled(raw_l, at_l, inner[0] == left_ids[-take_l])
        good_r = whole_r or _settled(raw_r, at_r, inner[-1] == right_ids[take_r - 1])
        if good_l and good_r:
            return left_ids[: len(left_ids) - take_l] + inner + right_ids[take_r:]
        grow_l, grow_r = (grow_l if good_l else 2 * take_l), (grow_r if good_r else 2 * take_r)


def _settled(raw: bytes, at: int, equal: bool) -> bool:
    """Whether a window may end before byte ``at``; ``equal``: its outermost token is as before."""
    before = raw[max(0, at - 4) : at].decode(errors="ignore")[-1]
    after = raw[at : at + 4].decode(errors="ignore")[0]
    return _certain(before, after) or (equal and _same_run(before, after))


def join_tree(parts: list[tuple[str, list[int]]], tool: Codec) -> list[int]:
    """Encoding of the concatenation of encoded parts, joined pairwise level by level."""
    while len(parts) > 1:
        paired = [
            (a[0] + b[0], join_encoded(a[0], a[1], b[0], b[1], tool)) for a, b in zip(parts[::2], parts[1::2], strict=False)
        ]
        parts = paired + parts[len(paired) * 2 :]
    return parts[0][1] if parts else []


def _to_lists(rows: list[list[int]]) -> pa.Array:
    lengths = np.fromiter((len(r) for r in rows), dtype=np.int64, count=len(rows))
    offsets = np.zeros(len(rows) + 1, dtype=np.int32)
    np.cumsum(lengths, out=offsets[1:])
    flat = np.empty(int(offsets[-1]), dtype=np.int32)
    for row, start in zip(rows, offsets, strict=False):
        flat[start : start + len(row)] = row
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))


def with_ids(df: DataFrame, key: str = "doc_id", text: str = "text", folder: str | None = None, long_chars: int = LONG_CHARS, segment_chars: int = SEGMENT_CHARS, only_length: bool = False) -> DataFrame:
    """``key`` and ``ids``, the token ids of ``text``, one row for each row of ``df``.

    Null and empty texts give the empty list. Strings that look like special tokens are
    ordinary text. Repeated keys and rows stay; other columns, whatever their names, are
    not read. With ``only_length`` the column is ``n_tokens`` (BIGINT) instead of ``ids``.

    Texts longer than ``long_chars`` go by their hash to the segmented path, so that
    one text is encoded once however often it occurs, and by many tasks however long it is.
    """
    spark = df.sparkSession
    folder = folder or tokenizer_folder()
    rows = df.select(F.col(key).alias("_key"), F.col(text).alias("_text"))
    kind = rows.schema["_key"].dataType
    value = "n_tokens bigint" if only_length else "ids array<int>"
    name = value.split()[0]

    def short(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = codec(folder)
        for batch in batches:
            encoded = [tool.encode(x) if x else [] for x in batch.column(1).to_pylist()]
            out = pa.array([len(x) for x in encoded], pa.int64()) if only_length else _to_lists(encoded)
            yield pa.RecordBatch.from_arrays([batch.column(0), out], ["_key", name])

    is_long = F.length("_text") > F.lit(long_chars)
    direct = rows.where(~F.coalesce(is_long, F.lit(False))).mapInArrow(short, f"_key {kind.simpleString()}, {value}")
    late = rows.where(is_long).withColumn("_hash", F.sha2("_text", 256))

    def cut(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for digest, body in zip(frame["_hash"], frame["_text"], strict=True):
                starts = range(0, len(body), segment_chars)
                for low in range(0, len(starts), 64):
                    some = starts[low : low + 64]
                    yield pd.DataFrame({"_hash": digest, "seg": range(low, low + len(some)), "part": [body[s : s + segment_chars] for s in some]})

    def encode(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tool = codec(folder)
        for frame in frames:
            frame["ids"] = [tool.encode(x) for x in frame["part"]]
            yield frame

    def merge(frame: pd.DataFrame) -> pd.DataFrame:
        """Neighbouring parts as one."""
        frame = frame.sort_values("seg")
        ids = join_tree(list(zip(frame["part"], (list(map(int, x)) for x in frame["ids"]), strict=True)), codec(folder))
        return pd.DataFrame({"_hash": [frame["_hash"].iloc[0]], "seg": [int(frame["seg"].iloc[0]) // FAN_IN], "part": ["".join(frame["part"])], "ids": [ids]})

    width = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    longest = late.agg(F.max(F.length("_text"))).head()[0] or 0
    part = "_hash string, seg int, part string, ids array<int>"
    level = (
        late.select("_hash", "_text")
        .dropDuplicates(["_hash"])
        .mapInPandas(cut, "_hash string, seg int, part string")
        .repartition(width, "_hash", "seg")
        .mapInPandas(encode, part)
    )
    # each level joins FAN_IN neighbours a task, so that many tasks work on one very long text
    left = -(-longest // segment_chars)
    while left > 1:
        level = level.groupBy("_hash", F.floor(F.col("seg") / FAN_IN)).applyInPandas(merge, part)
        left = -(-left // FAN_IN)
    merged = level.select("_hash", F.size("ids").cast("long").alias(name) if only_length else F.col("ids").alias(name))
    joined = late.select("_key", "_hash").join(merged, "_hash").select("_key", name)
    return direct.unionByName(joined).withColumnRenamed("_key", key)
