"""Subject areas of documents.

Complement naive Bayes is trained on labelled documents and refined by expectation
maximisation over all the others. From the refined counts each word gets its posterior
over the subjects; a document's share of a subject is the mean of these over its words,
weighted by how much each word tells. A logistic curve turns each share into the
probability that the subject is one of the document's, each independently of the others.
It is fitted on labelled documents, each with the shares it has in the model without it.

Words are pieces of identifiers and of prose in any script (pairs of characters where a
script has no spaces), hashed to BUCKETS numbers, so the model has a fixed size. Corpus
statistics cover all documents; only the labelled sample is bounded (MOST_LABELLED
documents, chosen by hash). Sums are taken where the documents lie and added as a tree;
what reaches the driver has the model's size, or a few numbers a labelled document.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.session import settle

BUCKETS = 1 << 16
#: Labelled documents the model is fitted on at most.
MOST_LABELLED = 20_000
ROUNDS = 2
#: Weight of an unlabelled document against a labelled one.
UNLABELLED = 0.3
#: Words that a document's score counts at most; keeps posteriors of long texts from being all or nothing.
EFFECTIVE = 25.0
SMOOTHING = 0.3
#: Blocks in which counts are summed, and how many parts of a block one task adds at a time.
SLICES = 64
FAN_IN = 128

_PIECE = re.compile(r"[A-Z]?[a-z]{2,}|[A-Z]{2,}")
#: Words with letters beyond ASCII: Latin ones with accents, then those of other scripts.
_WIDE = re.compile(r"[A-ZÀ-ÖØ-Þ]?[a-zß-öø-ÿ]{2,}|[A-ZÀ-ÖØ-Þ]{2,}|[^\W\d_A-Za-zÀ-ÖØ-öø-ÿ]+")
#: Scripts without spaces between words.
_DENSE = re.compile(r"[\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u9fff\uf900-\ufaff\U00020000-\U0003ffff]+")


def words_of(text: str) -> list[str]:
    """Words of the text, as they stand."""
    if text.isascii():
        return _PIECE.findall(text)
    out = []
    for word in _WIDE.findall(text):
        if len(word) > 2 and _DENSE.fullmatch(word):
            out += [word[k : k + 2] for k in range(len(word) - 1)]
        else:
            out.append(word)
    return out


def bag(text: str, known: dict[str, int]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the text's words, ascending, and their counts."""
    import xxhash

    words = words_of(text)
    if len(known) > 1_000_000:
        known.clear()
    for w in set(words).difference(known):
        known[w] = xxhash.xxh3_64_intdigest(w.lower()) % BUCKETS
    return np.unique(np.fromiter(map(known.__getitem__, words), np.int32, len(words)), return_counts=True)


def bags(documents: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key``, ``words`` and ``counts`` of every document that is not blank."""
    rows = documents.select(F.col(key).alias("_key"), F.col(text).alias("_text")).where("_key is not null and length(_text) > 0")

    def count(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known: dict[str, int] = {}
        for frame in frames:
            kept = [(k, *bag(t, known)) for k, t in zip(frame["_key"], frame["_text"], strict=True) if t.strip()]
            if kept:
                yield pd.DataFrame(kept, columns=[key, "words", "counts"])

    return rows.mapInPandas(count, f"{key} {rows.schema['_key'].dataType.simpleString()}, words array<int>, counts array<int>")


@dataclass
class Model:
    subjects: list[str]
    #: Complement weights, subjects x BUCKETS.
    weights: np.ndarray
    #: Posterior of each subject by word, times how much the word tells; and the latter alone.
    telling: np.ndarray
    tells: np.ndarray
    slope: float = 20.0
    offset: float = -4.0

    def posterior(self, words: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """Posterior over the subjects, of which one is assumed to hold."""
        if not len(words):
            return np.full(len(self.subjects), 1 / len(self.subjects))
        n = np.log1p(counts)
        score = self.weights[:, words] @ n
        score *= min(n.sum(), EFFECTIVE) / n.sum()
        score = np.exp(score - score.max())
        return score / score.sum()

    def shares(self, words: np.ndarray, counts: np.ndarray) -> np.ndarray:
        total = float(self.tells[words] @ counts) if len(words) else 0.0
        return self.telling[:, words] @ counts / total if total > 0 else np.full(len(self.subjects), 1 / len(self.subjects))

    def probabilities(self, words: np.ndarray, counts: np.ndarray) -> np.ndarray:
        if not len(words) or not float(self.tells[words] @ counts) > 0:
            return np.zeros(len(self.subjects))  # nothing tells
        return 1 / (1 + np.exp(-(self.slope * self.shares(words, counts) + self.offset)))


def _telling(counts: np.ndarray, totals: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Posterior of each subject by word times how much the word tells, and the latter, from counts of some words and totals of all."""
    rate = counts / np.maximum(totals[:, None], 1e-9)
    smooth = rate + 0.02 * rate.mean(axis=0) + 1e-6
    by_word = smooth / smooth.sum(axis=0)
    entropy = -(by_word * np.log(by_word)).sum(axis=0) / np.log(len(counts)) if len(counts) > 1 else np.zeros(counts.shape[1])
    tells = np.maximum(0.0, 1 - entropy) ** 2 * (1 - np.exp(-counts.sum(axis=0) / 2))
    return by_word * tells, tells


def complement(counts: np.ndarray, subjects: list[str]) -> Model:
    """Complement naive Bayes from (expected) word counts, subjects x BUCKETS."""
    rest = counts.sum(axis=0) - counts + SMOOTHING
    weights = -np.log(rest / rest.sum(axis=1, keepdims=True))
    weights -= weights.mean(axis=0)
    telling, tells = _telling(counts, counts.sum(axis=1))
    return Model(subjects, weights.astype(np.float32), telling.astype(np.float32), tells.astype(np.float32))


def _total(table: DataFrame, rows: int, weigh: Callable[..., np.ndarray], columns: list[str]) -> np.ndarray:
    """Sum over all documents of ``weigh(words, counts, *columns)``, rows x words each, as rows x BUCKETS.

    Each partition adds up its documents; the partitions' sums are added in slices, FAN_IN at
    a time, as a tree, so no task holds more than that however many partitions there are.
    """
    shape = (rows, BUCKETS // SLICES)

    def partial(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        total, some = np.zeros((rows, BUCKETS), np.float32), False
        for frame in frames:
            for words, counts, *rest in zip(frame["words"], frame["counts"], *[frame[c] for c in columns], strict=True):
                if len(words):
                    total[:, words] += weigh(words, np.log1p(counts), *rest)
                    some = True
        if some:
            context = TaskContext.get()
            yield pd.DataFrame({"slice": range(SLICES), "part": context.partitionId() if context else 0, "sums": [p.tobytes() for p in np.split(total, SLICES, axis=1)]})

    def add(frame: pd.DataFrame) -> pd.DataFrame:
        total = sum(np.frombuffer(b, np.float32).astype(np.float64) for b in frame["sums"])
        return pd.DataFrame({"slice": [frame["slice"].iloc[0]], "part": [frame["part"].iloc[0] // FAN_IN], "sums": [total.astype(np.float32).tobytes()]})

    schema = "slice int, part int, sums binary"
    narrow = table.select("words", "counts", *columns)
    left = narrow.rdd.getNumPartitions()
    parts = narrow.mapInPandas(partial, schema)
    while left > 1:
        parts = parts.groupBy("slice", F.floor(F.col("part") / FAN_IN)).applyInPandas(lambda frame: add(frame), schema)
        left = -(-left // FAN_IN)
    out = np.zeros((rows, BUCKETS))
    for row in parts.toLocalIterator():
        at = row["slice"] * shape[1]
        out[:, at : at + shape[1]] += np.frombuffer(row["sums"], np.float32).reshape(shape)
    return out


def _expected(table: DataFrame, model: Model) -> np.ndarray:
    """Expected word counts by subject over all rows of the table."""
    shared = table.sparkSession.sparkContext.broadcast(model)
    return _total(table, len(model.subjects), lambda words, n: np.outer(shared.value.posterior(words, np.expm1(n)), n), [])


def _own(subjects: int, n: np.ndarray, labels: np.ndarray) -> np.ndarray:
    """What a labelled document adds to the counts; one of several subjects counts in equal parts."""
    out = np.zeros((subjects, len(n)))
    out[np.asarray(labels, np.int64)] = n / len(labels)
    return out


def _logistic(x: np.ndarray, y: np.ndarray, steps: int = 60) -> np.ndarray:
    """Slope and offset of the likeliest logistic curve, by Newton's method; a small ridge keeps them finite."""
    design = np.column_stack([x, np.ones_like(x)])
    beta = np.array([10.0, -3.0])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(design @ beta, -30, 30)))
        gradient = design.T @ (y - p) - 1e-3 * beta
        hessian = (design * (p * (1 - p))[:, None]).T @ design + 1e-3 * np.eye(2)
        step = np.clip(np.linalg.solve(hessian, gradient), -5, 5)
        beta = beta + step
        if np.abs(step).max() < 1e-8:
            break
    return beta


def calibrate(model: Model, shares: np.ndarray, holds: np.ndarray, trims: int = 6, surprise: float = 0.97) -> None:
    """Fit the curve from shares to independent probabilities; ``holds``: whether the subject is one of the document's.

    Some labels are wrong. They would flatten the curve, so it is fitted again without the
    labels that the curve before it holds nearly impossible, a few times over.
    """
    if not len(shares) or len(model.subjects) < 2:
        return
    x, y = shares.ravel(), holds.ravel().astype(float)
    beta = _logistic(x, y)
    for _ in range(trims):
        p = 1 / (1 + np.exp(-np.clip(beta[0] * x + beta[1], -30, 30)))
        good = np.abs(y - p) < surprise
        beta = _logistic(x[good], y[good])
    if beta[0] > 0:
        model.slope, model.offset = float(beta[0]), float(beta[1])


def _held_out(sample: DataFrame, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Shares of each labelled document in the model without it, and which subjects it has."""
    shared, size = sample.sparkSession.sparkContext.broadcast(counts.astype(np.float32)), len(counts)

    def judge(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counts = shared.value
        totals = counts.sum(axis=1, dtype=np.float64)
        for frame in frames:
            found = []
            for words, c, labels in zip(frame["words"], frame["counts"], frame["labels"], strict=True):
                own = _own(size, np.log1p(c), labels)
                telling, tells = _telling(np.maximum(counts[:, np.asarray(words, np.int64)] - own, 0.0), totals - own.sum(axis=1))
                total = float(tells @ c)
                found.append(telling @ c / total if total > 0 else np.full(size, 1 / size))
            yield pd.DataFrame({"shares": found, "labels": frame["labels"]})

    judged = sample.mapInPandas(judge, "shares array<double>, labels array<int>").toPandas()  # at most MOST_LABELLED rows
    holds = np.array([np.isin(np.arange(size), x) for x in judged["labels"]])
    return np.array([np.asarray(x) for x in judged["shares"]]), holds


def clean_labels(labels: DataFrame, subjects: list[str], key: str = "doc_id") -> DataFrame:
    """``key`` and ``labels`` (positions in ``subjects``): spellings folded, unknown and null subjects and ids dropped."""
    name = F.lower(F.trim(F.regexp_replace("subject", r"(?U)\s+", " ")))
    place = F.array_position(F.array(*[F.lit(s.lower()) for s in subjects]), name).cast("int") - 1
    return labels.select(F.col(key).alias(key), place.alias("p")).where(f"{key} is not null and p >= 0").groupBy(key).agg(F.sort_array(F.collect_set("p")).alias("labels"))


def fit(table: DataFrame, labels: DataFrame, subjects: list[str], key: str = "doc_id", most: int = MOST_LABELLED, rounds: int = ROUNDS) -> Model:
    """Model from the bags of all documents and the hand labels of some, at most ``most``."""
    chosen = settle(clean_labels(labels, subjects, key).orderBy(F.xxhash64(key), key).limit(most), "labels")
    sample = settle(table.join(F.broadcast(chosen), key).dropDuplicates([key]).where(F.size("words") > 0).select("words", "counts", "labels"), "labelled")
    known = _total(sample, len(subjects), lambda words, n, labels: _own(len(subjects), n, labels), ["labels"])
    model, counts = complement(known, subjects), known
    rest = table.join(F.broadcast(chosen.select(key)), key, "left_anti")
    for _ in range(rounds if known.any() else 0):
        counts = known + UNLABELLED * _expected(rest, model)
        model = complement(counts, subjects)
    if known.any():
        calibrate(model, *_held_out(sample, counts))
    return model


def areas(table: DataFrame, model: Model, key: str = "doc_id", least: float = 0.5) -> DataFrame:
    """``key``, ``subject``, ``share`` and ``probability``: every subject of at least ``least``, else the likeliest alone.

    A text in which no word tells anything has no row.
    """
    shared = table.sparkSession.sparkContext.broadcast(model)

    def assign(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = shared.value
        for frame in frames:
            rows = []
            for k, words, counts in zip(frame[key], frame["words"], frame["counts"], strict=True):
                words, counts = np.asarray(words, np.int64), np.asarray(counts)
                share, p = model.shares(words, counts), model.probabilities(words, counts)
                top = int(p.argmax())
                rows += [(k, model.subjects[c], float(share[c]), float(p[c])) for c in range(len(p)) if p[top] > 0 and (p[c] >= least or c == top)]
            if rows:
                yield pd.DataFrame(rows, columns=[key, "subject", "share", "probability"])

    return table.mapInPandas(assign, f"{key} {table.schema[key].dataType.simpleString()}, subject string, share double, probability double")


def subject_areas(documents: DataFrame, labels: DataFrame, subjects: DataFrame) -> DataFrame:
    """Subject areas of every ``documents`` row that is not blank; see ``areas``.

    ``subjects`` is the fixed list. A document without words, or of none that the labels or
    the refinement have met, has no row; without any usable label no document has. Rows that
    repeat a ``doc_id`` are classified each by its own text.
    """
    names = sorted(r.subject for r in subjects.select("subject").where("subject is not null").distinct().collect())
    if not names:
        return documents.sparkSession.createDataFrame([], "doc_id bigint, subject string, share double, probability double")
    table = settle(bags(documents), "bags")
    return areas(table, fit(table, labels, names))
