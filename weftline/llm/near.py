"""Near-duplicate records: pigeonhole blocks over fingerprints.

A record's set of word runs is summed up by POSITIONS min-hash values, its fingerprint.
Fingerprints are split into BLOCKS blocks; two that differ in fewer positions than there
are blocks must agree in a whole block, and at the similarity asked for, 0.6, a pair
misses every block with a chance of 2 in 100,000 (1 in a million at 0.65, none in practice
from 0.7). Pairs that share a block are checked by the Hamming distance of two bits a
position, then exactly by their sets.

Records with equal sets are one class from the start, so copies meet no one more than
once. A block shared by more than HOT_BLOCK classes pairs no one: its members are joined
on the rarest word runs of each instead, which loses no similar pair at all.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.session import settle

BLOCKS, WIDTH = 44, 3
POSITIONS = BLOCKS * WIDTH
#: Positions of which two bits make the print that Hamming distances are taken of.
PRINTED = 128
#: Of the 256 bits. At a similarity of 0.6 the distance is 51 on average with a deviation of 7.5, so one pair in a million is beyond this.
MOST_BITS = 86
HOT_BLOCK = 64
#: Members of two classes (or one) whose pairs are all written out; in larger ones exact copies are tied to the first of their text.
EXPAND = 256
#: Ids that may be sent to every executor, 8 bytes each.
BROADCAST_IDS = 200_000

_WORD = re.compile(r"[A-Za-z0-9_]+")
_RNG = np.random.default_rng(20_011)
_MULTIPLY = (_RNG.integers(1, 2**63, POSITIONS, dtype=np.uint64) << np.uint64(1)) | np.uint64(1)
_ADD = _RNG.integers(0, 2**63, POSITIONS, dtype=np.uint64)
_P1, _P2, _P3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class WordHashes:
    """64-bit hashes of words, remembered for the batch's frequent words."""

    def __init__(self) -> None:
        self._known: dict[str, int] = {}

    def of(self, words: list[str]) -> np.ndarray:
        import xxhash

        known = self._known
        if len(known) > 2_000_000:
            known.clear()
        new = set(words).difference(known)
        known.update((w, xxhash.xxh3_64_intdigest(w)) for w in new)
        return np.fromiter(map(known.__getitem__, words), dtype=np.uint64, count=len(words))


def shingles(text: str | None, hashes: WordHashes, run: int = 3) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the runs of ``run`` words; empty for fewer words."""
    words = _WORD.findall(text.lower()) if text and text.isascii() else [w.lower() for w in _WORD.findall(text or "")]
    if len(words) < run:
        return np.empty(0, np.uint64)
    h = hashes.of(words)
    with np.errstate(over="ignore"):
        total = np.zeros(len(h) - run + 1, np.uint64)
        for k in range(run):
            total = _mix(total * _P1 + h[k : len(h) - run + 1 + k] * _P2 + _P3)
    return np.unique(total)


def minhash(flat: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """POSITIONS x sets matrix of 32-bit minima over each set; sets are consecutive in ``flat`` and not empty."""
    out = np.empty((POSITIONS, len(starts)), np.uint32)
    with np.errstate(over="ignore"):
        for k in range(POSITIONS):
            out[k] = np.minimum.reduceat((flat * _MULTIPLY[k] + _ADD[k]) >> np.uint64(32), starts)
    return out


def _records(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    import xxhash

    hashes = WordHashes()
    for frame in frames:
        for low in range(0, len(frame), 1000):
            part = frame.iloc[low : low + 1000]
            sets = [shingles(t, hashes) for t in part["text"]]
            keep = [k for k, s in enumerate(sets) if len(s)]
            if not keep:
                continue
            sets = [sets[k] for k in keep]
            sizes = np.array([len(s) for s in sets])
            starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
            flat = np.concatenate(sets)
            with np.errstate(over="ignore"):
                ones = np.add.reduceat(_mix(flat), starts) + sizes.astype(np.uint64)
                twos = np.add.reduceat(_mix(flat ^ _P3), starts) ^ (sizes.astype(np.uint64) * _P1)
                table = minhash(flat, starts)
                # a position's two bits come from a hash of its value: the minima of large sets are all small
                bits = (_mix(table[:PRINTED].astype(np.uint64)) & np.uint64(3)).reshape(4, PRINTED // 4, -1)
                prints = [np.bitwise_or.reduce(b << (np.arange(PRINTED // 4, dtype=np.uint64) * np.uint64(2))[:, None], axis=0) for b in bits]
                blocks = np.zeros((BLOCKS, len(sets)), np.uint64)
                for k in range(WIDTH):
                    blocks = _mix(blocks * _P1 + table[k::WIDTH].astype(np.uint64) + np.arange(1, BLOCKS + 1, dtype=np.uint64)[:, None] * _P2)
            texts = [xxhash.xxh3_64_intdigest(part["text"].iat[k].encode("utf-8", "surrogatepass")) for k in keep]
            out = pd.DataFrame({"set": part["set"].to_numpy()[keep], "id": part["id"].to_numpy()[keep], "t": np.array(texts, np.uint64).view(np.int64), "c1": ones.view(np.int64), "c2": twos.view(np.int64), "n": sizes})
            for k in range(4):
                out[f"f{k}"] = prints[k].view(np.int64)
            out["blocks"] = list(blocks.view(np.int64).T)
            yield out


_RECORD = "set string, id bigint, t bigint, c1 bigint, c2 bigint, n bigint, f0 bigint, f1 bigint, f2 bigint, f3 bigint, blocks array<bigint>"


def _sets(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    hashes = WordHashes()
    for frame in frames:
        frame["items"] = [shingles(t, hashes).view(np.int64) for t in frame["text"]]
        yield frame[["set", "id", "items"]]


def _only(df: DataFrame, wanted: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of ``df`` whose keys are in ``wanted``, which is sent out whole only if it is small."""
    side = wanted.select(*keys).distinct()
    return df.join(F.broadcast(side) if wanted.count() <= BROADCAST_IDS else side, keys, "left_semi")


class Similar:
    """Classes, representatives and similar pairs of representatives of one or more record sets.

    ``records``: ``set`` (name of the record set), ``id``, ``text``; rows with a null id are left
    out. Null texts and texts of fewer than three words are in no class. Rows that repeat an id
    are versions of one record, which is similar to others if any version is. ``expand``: members
    of classes whose pairs ``found`` writes out in full, else EXPAND.
    """

    def __init__(self, records: DataFrame, threshold: float = 0.6, expand: int | None = None) -> None:
        self.threshold = threshold
        self.expand = EXPAND if expand is None else expand
        source = records.select("set", F.col("id").cast("bigint").alias("id"), "text").where("id is not null and set is not null and text is not null")
        self.table = settle(source.mapInPandas(_records, _RECORD), "records")
        members = self.table.select("set", "c1", "c2", "id", "n")
        self.classes = settle(members.groupBy("set", "c1", "c2", "n").agg(F.min("id").alias("rep"), F.countDistinct("id").alias("size")), "classes")
        self.pairs = settle(self._pairs(source), "pairs")

    def _pairs(self, source: DataFrame) -> DataFrame:
        """``set``, ``a`` < ``b`` (ids of representatives of different classes) that are similar."""
        several = self.classes.where("size > 1")
        copies = settle(self.table.select("set", "c1", "c2", "id").join(self._small(several.select("set", "c1", "c2", "rep"), several), ["set", "c1", "c2"]).where("id <> rep").select("set", "id", "c1", "c2").distinct(), "copies")
        heads = self.table.join(self._small(copies, copies), ["set", "id", "c1", "c2"], "left_anti")
        lines = heads.select("set", "id", F.explode("blocks").alias("key"))
        # blocks are counted by partial sums first; both sides of the join are plain exchanges then, of which a hot block is split
        sizes = settle(lines.groupBy("set", "key").agg(F.count(F.lit(1)).alias("m")).where("m > 1"), "sizes")
        shared = settle(lines.join(sizes, ["set", "key"]), "shared")
        few = shared.where(F.col("m") <= HOT_BLOCK)
        met = few.alias("x").join(few.alias("y"), ["set", "key"]).where("x.id < y.id").select("set", F.col("x.id").alias("a"), F.col("y.id").alias("b"))
        candidates = met.distinct()
        hot = shared.where(F.col("m") > HOT_BLOCK).select("set", "id").distinct()
        hot = settle(hot, "hot")
        if hot.head(1):
            candidates = candidates.unionByName(self._by_prefix(source, hot)).distinct()
        prints = heads.select("set", "id", "n", "f0", "f1", "f2", "f3")
        x = prints.select("set", F.col("id").alias("a"), F.col("n").alias("na"), *[F.col(f"f{k}").alias(f"x{k}") for k in range(4)])
        y = prints.select("set", F.col("id").alias("b"), F.col("n").alias("nb"), *[F.col(f"f{k}").alias(f"y{k}") for k in range(4)])
        distance = sum((F.bit_count(F.col(f"x{k}").bitwiseXOR(F.col(f"y{k}"))) for k in range(1, 4)), F.bit_count(F.col("x0").bitwiseXOR(F.col("y0"))))
        close = (
            candidates.join(x, ["set", "a"]).where("a is not null").join(y, ["set", "b"])
            .where((F.least("na", "nb") + 1e-9 >= self.threshold * F.greatest("na", "nb")) & (distance <= MOST_BITS))
            .select("set", "a", "b").distinct()
        )
        close = settle(close, "close")
        ids = settle(close.select("set", F.col("a").alias("id")).union(close.select("set", "b")).distinct(), "ids")
        items = settle(_only(source, ids, ["set", "id"]).mapInPandas(_sets, "set string, id bigint, items array<bigint>"), "items")
        both = close.join(items.select("set", F.col("id").alias("a"), F.col("items").alias("p")), ["set", "a"]).join(items.select("set", F.col("id").alias("b"), F.col("items").alias("q")), ["set", "b"])
        common = F.size(F.array_intersect("p", "q"))
        return both.where(common + 1e-9 >= self.threshold * (F.size("p") + F.size("q") - common)).select("set", "a", "b").distinct()

    def _small(self, side: DataFrame, counted: DataFrame) -> DataFrame:
        return F.broadcast(side) if counted.count() <= BROADCAST_IDS // 4 else side

    def _by_prefix(self, source: DataFrame, hot: DataFrame) -> DataFrame:
        """Candidate pairs among ``hot``, none missing: similar sets share one of their rarest items."""
        items = _only(source, hot, ["set", "id"]).mapInPandas(_sets, "set string, id bigint, items array<bigint>")
        lines = settle(items.select("set", "id", F.size("items").alias("n"), F.explode("items").alias("item")).distinct(), "lines")
        often = lines.groupBy("set", "item").agg(F.count(F.lit(1)).alias("df"))
        ordered = lines.join(often, ["set", "item"]).groupBy("set", "id", "n").agg(F.sort_array(F.collect_list(F.struct("df", "item"))).alias("by_df"))
        length = F.col("n") - F.ceil(F.lit(self.threshold) * F.col("n") - 1e-9) + 1
        heads = settle(ordered.select("set", "id", "n", F.explode(F.slice(F.col("by_df.item"), F.lit(1), length.cast("int"))).alias("item")), "heads")
        x, y = heads.alias("x"), heads.alias("y")
        near = (F.col("x.id") < F.col("y.id")) & (F.least("x.n", "y.n") + 1e-9 >= self.threshold * F.greatest("x.n", "y.n"))
        return x.join(y, ["set", "item"]).where(near).select("set", F.col("x.id").alias("a"), F.col("y.id").alias("b")).distinct()

    def membership(self) -> DataFrame:
        """One row for each record in a class: ``set``, ``id``, ``class_id`` (the class's least id), ``class_size``, ``links`` (similar classes)."""
        rep = self.classes.select("set", "c1", "c2", F.col("rep").alias("class_id"), F.col("size").alias("class_size"))
        ends = self.pairs.select("set", F.col("a").alias("class_id")).union(self.pairs.select("set", "b"))
        links = ends.groupBy("set", "class_id").agg(F.count(F.lit(1)).alias("links"))
        rows = self.table.select("set", "id", "c1", "c2").distinct().join(rep, ["set", "c1", "c2"]).drop("c1", "c2")
        return rows.join(links, ["set", "class_id"], "left").select("set", "id", "class_id", "class_size", F.coalesce("links", F.lit(0)).alias("links"))

    def found(self) -> DataFrame:
        """``record_set``, ``id_a`` < ``id_b``: the similar pairs of records.

        Pairs within a class, and between two similar classes, are all written out while the
        classes (for two: their product) have at most ``expand`` (its square) members. Beyond that
        each exact copy is paired with the first record of its text, and these with each other,
        within the class and across, so that all different texts are linked.
        """
        rows = self.table.select("set", "c1", "c2", "id", "t").distinct().join(self.classes.select("set", "c1", "c2", "rep", "size"), ["set", "c1", "c2"])
        rows = rows.select("set", "id", "t", "rep", "size")
        many = rows.where("size > 1")
        small = many.where(F.col("size") <= self.expand).select("set", "rep", "id").distinct()
        inside = small.alias("x").join(small.alias("y"), ["set", "rep"]).where("x.id < y.id").select("set", F.col("x.id").alias("a"), F.col("y.id").alias("b"))
        large = many.where(F.col("size") > self.expand)
        firsts = large.groupBy("set", "rep", "t").agg(F.min("id").alias("first"))
        star = large.join(firsts, ["set", "rep", "t"]).where("id <> first").select("set", F.col("first").alias("a"), F.col("id").alias("b"))
        texts = firsts.select("set", "rep", F.col("first").alias("id")).distinct()
        across = texts.alias("x").join(texts.alias("y"), ["set", "rep"]).where("x.id < y.id").select("set", F.col("x.id").alias("a"), F.col("y.id").alias("b"))
        sizes = self.classes.select("set", "rep", "size").groupBy("set", "rep").agg(F.max("size").alias("size"))
        sized = self.pairs.join(sizes.select("set", F.col("rep").alias("a"), F.col("size").alias("sa")), ["set", "a"]).join(sizes.select("set", F.col("rep").alias("b"), F.col("size").alias("sb")), ["set", "b"])
        sized = settle(sized, "sized")
        plain = sized.where("sa = 1 and sb = 1").select("set", "a", "b")

        def between(pairs: DataFrame, members: DataFrame) -> DataFrame:
            return (
                pairs.join(members.select("set", F.col("rep").alias("a"), F.col("id").alias("ia")), ["set", "a"])
                .join(members.select("set", F.col("rep").alias("b"), F.col("id").alias("ib")), ["set", "b"])
                .select("set", F.col("ia").alias("a"), F.col("ib").alias("b"))
            )

        ids = rows.select("set", "rep", "id")
        spread = between(sized.where(f"(sa > 1 or sb > 1) and sa * sb <= {self.expand**2}"), ids)
        vast = sized.where(f"sa * sb > {self.expand**2}")
        inside = inside.union(across)
        if vast.head(1):
            spread = spread.union(between(vast, rows.groupBy("set", "rep", "t").agg(F.min("id").alias("id"))))
        union = inside.union(star).union(plain).union(spread).where("a <> b")
        return union.select(F.col("set").alias("record_set"), F.least("a", "b").alias("id_a"), F.greatest("a", "b").alias("id_b")).distinct()


def record_sets(documents: DataFrame, prompt_solution: DataFrame) -> DataFrame:
    """Both record sets as ``set``, ``id``, ``text``."""
    a = documents.select(F.lit("documents").alias("set"), F.col("doc_id").alias("id"), F.col("text").alias("text"))
    b = prompt_solution.select(F.lit("prompt_solution").alias("set"), F.col("pair_id").alias("id"), F.col("solution").alias("text"))
    return a.unionByName(b)
