"""Filling containers of fixed capacity with whole documents.

Everything but the last step works on the histogram of sizes, which has at most
``capacity`` entries however large the corpus is:

1. enumerate shallow combinations of lengths (two or three items) whose sum falls in a
   window just below the capacity;
2. find by non-negative least squares how often each should be repeated so that together
   they use up the histogram, and round down;
3. pack what remains greedily, largest first, a whole run of equal containers at a time.

Several windows and numbers of rounds are tried, each by a task of its own; what takes the
fewest containers counts. The result is a list of runs of equal containers. Each document
then takes its place by its rank among the documents of its size: rank by salted counting,
with as many salts as the size's count asks for, place by a lookup in the runs. No group of
equal sizes is ever gathered in one task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weftline.llm.tokens import with_ids
from weftline.session import settle

#: Documents of one size that are ranked together, on average; a size of more is split by a salt.
RANKED = 50_000


def combinations(sizes: np.ndarray, counts: np.ndarray, capacity: int, window: int, per_size: int = 6) -> list[tuple[int, ...]]:
    """Combinations of at most three sizes that fill [capacity - window, capacity].

    For each size as the largest item: the best partners for two items, and for three
    items a spread of middle sizes with the best third.
    """
    found: set[tuple[int, ...]] = set()
    for size in sizes[::-1]:
        size = int(size)
        if size >= capacity - window:
            found.add((size,))
        room = capacity - size
        at = int(np.searchsorted(sizes, min(room, size), side="right")) - 1
        for k in range(at, max(-1, at - per_size), -1):
            if size + sizes[k] < capacity - window:
                break
            found.add((size, int(sizes[k])))
        if room < 2 or at < 0:
            continue
        for middle in np.unique(np.linspace(0, at, per_size).astype(int)):
            second = int(sizes[middle])
            third = int(np.searchsorted(sizes, min(room - second, second), side="right")) - 1
            if third >= 0 and size + second + sizes[third] >= capacity - window:
                found.add((size, second, int(sizes[third])))
    return sorted(found)


def solve(sizes: np.ndarray, counts: np.ndarray, patterns: list[tuple[int, ...]], steps: int = 400) -> np.ndarray:
    """Repeat counts x >= 0 that minimise |A x - counts|, by accelerated projected gradient.

    A has a column for each pattern; as it has three entries a column at most, products
    are sums by index.
    """
    place = {int(s): k for k, s in enumerate(sizes)}
    rows = np.array([place[s] for p in patterns for s in p])
    columns = np.array([k for k, p in enumerate(patterns) for _ in p])
    forward = lambda x: np.bincount(rows, weights=x[columns], minlength=len(sizes))
    back = lambda r: np.bincount(columns, weights=r[rows], minlength=len(patterns))
    probe = np.ones(len(patterns))
    for _ in range(12):
        probe = back(forward(probe))
        scale = float(np.linalg.norm(probe)) or 1.0
        probe /= scale
    x = y = np.zeros(len(patterns))
    t = 1.0
    for _ in range(steps):
        new = np.maximum(0.0, y - back(forward(y) - counts) / (scale * 1.05))
        t_new = (1 + (1 + 4 * t * t) ** 0.5) / 2
        y = new + (t - 1) / t_new * (new - x)
        x, t = new, t_new
    return x


def _greedy(sizes: np.ndarray, rest: np.ndarray, capacity: int) -> list[tuple[dict[int, int], int]]:
    """Runs of equal containers for what remains: largest first, then again and again the largest that fits."""
    runs = []
    while True:
        present = np.flatnonzero(rest)
        if not len(present):
            return runs
        inside: dict[int, int] = {}
        room = capacity
        while room:
            fits = present[: int(np.searchsorted(sizes[present], room, side="right"))]
            at = next((int(k) for k in fits[::-1] if rest[k] > inside.get(int(k), 0)), None) if len(fits) else None
            if at is None:
                break
            free = int(rest[at]) - inside.get(at, 0)
            take = max(1, min(free, room // int(sizes[at])))
            inside[at] = inside.get(at, 0) + take
            room -= take * int(sizes[at])
        times = min(int(rest[k]) // n for k, n in inside.items())
        for k, n in inside.items():
            rest[k] -= n * times
        runs.append((inside, times))


def _runs(sizes: np.ndarray, counts: np.ndarray, capacity: int, window: int, rounds: int = 4) -> list[tuple[dict[int, int], int]]:
    """Runs of equal containers: least squares and rounding down, again on what is left while that helps, then greedily."""
    rest = counts.copy()
    runs: list[tuple[dict[int, int], int]] = []
    for _ in range(rounds):
        present = np.flatnonzero(rest)
        place = {int(sizes[k]): int(k) for k in present}
        patterns = combinations(sizes[present], rest[present], capacity, window)
        if not patterns:
            break
        wanted = solve(sizes[present], rest[present].astype(float), patterns)
        placed = 0
        for k in np.argsort(-wanted, kind="stable"):
            inside: dict[int, int] = {}
            for s in patterns[k]:
                inside[place[s]] = inside.get(place[s], 0) + 1
            times = min(int(wanted[k] + 0.25), *(int(rest[s]) // n for s, n in inside.items()))
            if times < 1:
                continue
            for s, n in inside.items():
                rest[s] -= n * times
            runs.append((inside, times))
            placed += times
        if placed < 0.02 * rest.sum():
            break
    return runs + _greedy(sizes, rest, capacity)


def _options(capacity: int) -> list[tuple[int, int]]:
    """Windows and rounds of least squares that are tried."""
    return [(w, rounds) for w in sorted({0, capacity // 1024, capacity // 512, capacity // 128}) for rounds in (1, 4)]


def plan(sizes: np.ndarray, counts: np.ndarray, capacity: int, window: int, rounds: int) -> pd.DataFrame:
    """Runs of equal containers that hold exactly ``counts[k]`` items of ``sizes[k]``.

    One row for each run and size in it: ``size``, ``low`` and ``high`` (the ranks within
    the size that go to this run), ``base`` (the run's first container), ``each`` (items of
    this size in each of its containers), ``total`` (containers of all runs).
    """
    order = np.argsort(sizes)
    sizes, counts = np.asarray(sizes, np.int64)[order], np.asarray(counts, np.int64)[order]
    runs = _runs(sizes, counts, capacity, window, rounds)
    used = np.zeros(len(sizes), np.int64)
    base, rows = 0, []
    for inside, times in runs:
        for k, n in inside.items():
            rows.append((int(sizes[k]), int(used[k]), int(used[k] + n * times), base, n))
            used[k] += n * times
        base += times
    return pd.DataFrame(rows, columns=["size", "low", "high", "base", "each"]).astype("int64").assign(total=base)


_PLAN = "profile string, size long, low long, high long, base long, each long, total long, option int"


def _planned(spark: SparkSession, histogram: pd.DataFrame, settings: list[tuple[str, int]]) -> pd.DataFrame:
    """The best plan of each profile; every option is planned by a task of its own."""
    tasks = [(p, c, w, rounds, k) for p, c in settings for k, (w, rounds) in enumerate(_options(c))]
    shared = spark.sparkContext.broadcast({p: part[["_l", "_m"]].to_numpy().T.copy() for p, part in histogram.groupby("_p")})

    def work(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for profile, capacity, window, rounds, option in frame.itertuples(index=False):
                if profile in shared.value:
                    yield plan(*shared.value[profile], int(capacity), int(window), int(rounds)).assign(profile=profile, option=option)[[c.split()[0] for c in _PLAN.split(", ")]]

    made = spark.createDataFrame(tasks, "profile string, capacity long, window long, rounds long, option int")
    spread = made.repartitionByRange(len(tasks), "profile", "option")
    plans = settle(spread.mapInPandas(work, _PLAN), "plans")
    best = plans.groupBy("profile").agg(F.min(F.struct("total", "option")).alias("b")).select("profile", F.col("b.option").alias("option"))
    return plans.join(F.broadcast(best), ["profile", "option"]).toPandas()  # runs of one option a profile; at most a few for each size


def pack(sizes: DataFrame, profiles: DataFrame, key: str = "doc_id") -> DataFrame:
    """Containers for every item and profile.

    ``sizes``: ``key`` and ``n_tokens``; null sizes and sizes below 1 are left out.
    ``profiles``: ``profile`` and ``capacity_tokens``, a short table of settings; rows with a
    null or a capacity below 1 are left out, of repeated names the largest capacity holds.

    Gives ``profile``, ``container`` (from 0, without gaps), ``key``, ``piece`` (from 0),
    ``start`` and ``length`` in tokens. An item is whole (piece 0 only) unless it is longer
    than the capacity; then all its pieces but the last fill a container each. Equal rows
    of ``sizes`` are items of their own.
    """
    spark = sizes.sparkSession
    wanted = (
        profiles.select(F.col("profile").alias("profile"), F.col("capacity_tokens").cast("long").alias("capacity"))
        .where("profile is not null and capacity >= 1")
        .groupBy("profile")
        .agg(F.max("capacity").alias("capacity"))
    )
    settings = sorted((r.profile, r.capacity) for r in wanted.collect())
    schema = f"profile string, container long, {key} {sizes.schema[key].dataType.simpleString()}, piece int, start long, length long"
    if not settings:
        return spark.createDataFrame([], schema)
    items = sizes.select(F.col(key).alias("_key"), F.col("n_tokens").cast("long").alias("_n")).where("_n >= 1")
    options = F.array(*[F.struct(F.lit(p).alias("p"), F.lit(c).cast("long").alias("c")) for p, c in settings])
    pieces = (
        items.select("*", F.explode(options).alias("o"))
        .select("_key", "_n", F.col("o.p").alias("_p"), F.col("o.c").alias("_c"))
        .select("*", F.explode(F.sequence(F.lit(0), ((F.col("_n") - 1) / F.col("_c")).cast("int"))).alias("_i"))
        .select("_key", "_p", "_i", (F.col("_i") * F.col("_c")).alias("_s"), F.least("_c", F.col("_n") - F.col("_i") * F.col("_c")).alias("_l"))
    )
    # at most capacity x profiles rows: bounded by the settings, not by the corpus
    histogram = pieces.groupBy("_p", "_l").agg(F.count(F.lit(1)).alias("_m")).toPandas()
    if not len(histogram):
        return spark.createDataFrame([], schema)
    histogram["_k"] = -(-histogram["_m"] // RANKED)
    salts = spark.createDataFrame(histogram[["_p", "_l", "_k"]], "_p string, _l long, _k long")
    salted = pieces.join(F.broadcast(salts), ["_p", "_l"]).withColumn("_salt", F.pmod(F.xxhash64("_key", "_i"), F.col("_k"))).drop("_k")
    # what a salt's documents rank after: a row for every RANKED documents of a size that has more
    split = salted.join(F.broadcast(salts.where("_k > 1").select("_p", "_l")), ["_p", "_l"], "left_semi")
    by_salt = split.groupBy("_p", "_l", "_salt").agg(F.count(F.lit(1)).alias("_m")).toPandas().sort_values(["_p", "_l", "_salt"])
    by_salt["_at"] = by_salt.groupby(["_p", "_l"])["_m"].cumsum() - by_salt["_m"]
    offsets = {(p, int(n)): np.zeros(int(k), np.int64) for p, n, k in histogram[["_p", "_l", "_k"]].itertuples(index=False)}
    for (profile, length), part in by_salt.groupby(["_p", "_l"]):
        offsets[profile, int(length)][part["_salt"].to_numpy()] = part["_at"].to_numpy()
    runs = {}
    for (profile, size), part in _planned(spark, histogram, settings).groupby(["profile", "size"]):
        runs[profile, int(size)] = part.sort_values("low")[["low", "base", "each"]].to_numpy().T.copy()
    shared = spark.sparkContext.broadcast((offsets, runs))

    def seat(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        offsets, runs = shared.value
        for frame in frames:
            container = np.zeros(len(frame), np.int64)
            for (profile, length), at in frame.groupby(["_p", "_l"]).indices.items():
                part = frame.iloc[at]
                rank = offsets[profile, int(length)][part["_salt"].to_numpy()] + part["_r"].to_numpy() - 1
                low, base, each = runs[profile, int(length)]
                k = np.searchsorted(low, rank, side="right") - 1
                container[at] = base[k] + (rank - low[k]) // each[k]
            yield pd.DataFrame({"profile": frame["_p"], "container": container, key: frame["_key"], "piece": frame["_i"], "start": frame["_s"], "length": frame["_l"]})

    ranked = salted.withColumn("_r", F.row_number().over(Window.partitionBy("_p", "_l", "_salt").orderBy("_key", "_i")).cast("long"))
    return ranked.mapInPandas(seat, schema)


def containers(documents: DataFrame, profiles: DataFrame, folder: str | None = None) -> DataFrame:
    """``pack`` of the non-empty ``documents.text`` (white space counts), sized in tokens."""
    whole = documents.where(F.length("text") > 0)
    return pack(settle(with_ids(whole, folder=folder, only_length=True), "sizes"), profiles)


def summary(packed: DataFrame, profiles: DataFrame) -> DataFrame:
    """For each profile: containers, tokens, and the least number of containers those tokens could need."""
    caps = profiles.groupBy("profile").agg(F.max(F.col("capacity_tokens").cast("long")).alias("capacity"))
    used = packed.groupBy("profile").agg((F.max("container") + 1).alias("containers"), F.sum("length").alias("tokens"))
    return used.join(F.broadcast(caps), "profile").select("profile", "capacity", "containers", "tokens", F.ceil(F.col("tokens") / F.col("capacity")).alias("least"))
