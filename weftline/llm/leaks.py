"""Evaluation code leaking into training text, by greedy string tiling.

Texts become two streams of tokens that survive renaming and another layout. The plain one
holds numbers (by value) and operators; names, quotes, brackets, comments and white space are
left out. The richer one holds keywords, brackets and masked names too, and in it names must
stand for the same names throughout. A document is tiled with an item: again and again the
longest match not yet marked is found by running Karp-Rabin and marked in both.

What tiles cover decides, in two ways. A document leaks an item in order if tiles of either
stream cover LINES code lines in a row of it, or all of it, one after the other; in the plain
stream, whose tiles say less, they must lie around a run of SEED tokens with NUMBERS numbers.
It leaks it reordered if tiles of the richer stream cover COVERED of all of the item's tokens,
wherever they lie.

In the richer stream no pair that meets either threshold is passed over: of each five lines the
token is taken whose runs are the rarest, and as tiles can't cover the lines without it, they
hold one of the few runs of RICH_TILE tokens around it. These are looked up in every document.
"""

from __future__ import annotations

import functools
import html
import keyword
import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Tokens of a seed of the plain stream, and of them how many numbers at least.
SEED, NUMBERS = 6, 2
#: Tokens of the shortest tile.
TILE = 3
#: The same for the richer stream, and of a tile that tells without a number or keyword.
RICH_TILE, RICH_SEED = 6, 10
#: Tokens between neighbours in a covered line, and between covered lines, at most.
STEP, LEAP = 12, 40
#: Share of the names of a passage that must stand for the same names throughout.
CONSISTENT = 0.8
#: Consecutive code lines of an item that make a case.
LINES = 5
#: Share of an item's tokens that tiles must cover to make a case whatever their order.
COVERED = 0.8
#: Share of a passage's tokens that are no names, below which names must be the same names, as in prose.
TELLING = 0.34
#: Characters of items that one pass holds in every task; more items take more passes.
PASS_CHARS = 2_000_000

_SIGNS = frozenset("-+*/%^&|<>=!~@()[]{}.")
_RICH = re.compile(r"[^\W\d]\w*|[-+*/%^&|<>=!~@()\[\]{}.]|\d(?<![^\W_]\d)(?:(?<=0)[xXoObB][0-9A-Fa-f_]+|[\d_]*(?:\.\d+)?)(?![^\W_])")
_KEYWORDS = frozenset(keyword.kwlist) | frozenset("function var let const new this throw switch case catch null true false undefined typeof".split())
#: Value of every name in the richer stream; from where on values are numbers or keywords. Those of the plain stream are odd.
_NAME, _NUMBER = 2, 2000
#: What may stand before a line of code that is quoted: comment signs, prompts, line numbers, diff and reply marks.
_LEAD = re.compile(r"\n[ \t]*(?:(?:#+|//+|\*|--|;+|>>>|\.\.\.|>+|\|)[ \t]?(?:[ \t]*\d+[:.|)](?=[ \t]))?|\d+[:.|)](?=[ \t]))")
_TAGS = re.compile(r"</?(?:pre|code|p|br|div|span|li|td|tr)\b[^>\n]*>")
# The sign comes before what must stand around it, so that the search can skip to the next sign.
_REMARK = re.compile(r"#(?<![^\s;]#)[^\n]*|//(?<=\s//)[ \t][^\n]*")
_WHOLE_REMARK = re.compile(r"\n[ \t]*(?:#|//)[^\n]*")
_HASH = np.uint64(0x9E3779B97F4A7C15)
_BASE = 0x9E3779B97F4A7C15
_BACK = np.uint64(pow(_BASE, -1, 2**64))


def unwrap(text: str) -> str:
    """Code in an escaped or marked-up form as plain lines."""
    if "&" in text and ";" in text:
        text = html.unescape(text)
    if "\\" in text:
        text = re.sub(r"\\+[rn]", "\n", text).replace("\\t", " ").replace('\\"', '"').replace("\\'", "'")
    if "<" in text:
        text = _TAGS.sub(" ", text)
    return text.replace("\r\n", "\n").replace("\r", "\n")


def _value(token: str) -> int:
    """Number of a token: signs by code point, numbers by value, keywords by hash, all other names alike."""
    if token in _SIGNS:
        return 2 * ord(token) + (token not in "()[]{}.")
    if not token[0].isdecimal():
        return xxhash.xxh3_64_intdigest(token) >> 3 << 1 | 1 << 62 if token in _KEYWORDS else _NAME
    plain = token.replace("_", "")
    try:
        if len(plain) > 18:
            raise ValueError
        number = int(plain, 0 if plain[:1] == "0" and len(plain) > 1 and not plain.isdecimal() else 10)
        if number < 1 << 59:
            return _NUMBER + 2 * number + 1
        plain = str(number)
    except ValueError:
        pass
    return xxhash.xxh3_64_intdigest(plain) >> 3 | 1 << 61 | 1


class _Known(dict[str, int]):
    """Values of tokens, remembered."""

    def __missing__(self, token: str) -> int:
        value = self[token] = _value(token)
        return value


def _hashed(v: np.ndarray, size: int) -> np.ndarray:
    """Hashes of the runs of ``size`` values."""
    n = len(v) - size + 1
    h = np.zeros(max(n, 0), np.uint64)
    for k in range(size if n > 0 else 0):
        h *= _HASH
        h += v[k : n + k]
    h ^= h >> np.uint64(29)
    return h


def _among(values: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Whether each value is one of ``wanted``, which is sorted."""
    if not len(wanted):
        return np.zeros(len(values), bool)
    at = wanted.searchsorted(values)
    at[at == len(wanted)] = 0
    return wanted[at] == values


class _Tokens:
    """Token values, and of an item's the code line of each."""

    #: Tokens of the shortest tile.
    shortest: int
    values: np.ndarray
    lines: np.ndarray | None = None
    n_lines = 0

    @functools.cached_property
    def runs(self) -> np.ndarray:
        """Hashes of the runs of as many tokens as the shortest tile has."""
        return _hashed(self.values, self.shortest)

    @functools.cached_property
    def windows(self) -> tuple[np.ndarray, np.ndarray]:
        """Where the tokens of each LINES lines in a row begin and end, or of all if there are fewer, if any."""
        low = np.arange(max(1, self.n_lines - LINES + 1))
        begin, end = np.searchsorted(self.lines, low), np.searchsorted(self.lines, low + LINES)
        return begin[end > begin], end[end > begin]

    def covered_at_most(self, values: np.ndarray) -> np.ndarray:
        """How many tokens before each place, and in all, tiles with these values could cover: all that lie in shared runs."""
        size, n = self.shortest, len(self.runs)
        shared = np.zeros(n + 2 * size - 1, np.int64)
        np.cumsum(_among(self.runs, np.sort(_hashed(values, size))), out=shared[size : size + n])
        shared[size + n :] = shared[size + n - 1]
        return np.concatenate([[0], np.cumsum(shared[size:] > shared[:-size])])

    def lines_at_most(self, values: np.ndarray) -> bool:
        """Whether tiles with these values could cover LINES lines in a row, or all."""
        covered = self.covered_at_most(values)
        begin, end = self.windows
        return bool((covered[end] - covered[begin] == end - begin).any())


class Rich(_Tokens):
    """The richer stream of a text, with the tokens themselves."""

    shortest = RICH_TILE

    def __init__(self, text: str, known: _Known, with_lines: bool = False) -> None:
        lines = [x for x in text.split("\n") if x.strip()] if with_lines else [text]
        found = [_RICH.findall(x) for x in lines]
        self.tokens = [t for x in found for t in x] if with_lines else found[0]
        self.values = np.fromiter(map(known.__getitem__, self.tokens), np.uint64, len(self.tokens))
        if with_lines:
            self.lines, self.n_lines = np.repeat(np.arange(len(lines)), [len(x) for x in found]), len(lines)


class Stream(_Tokens):
    """The plain stream of a text: what the richer one has of numbers and operators."""

    shortest = TILE

    def __init__(self, rich: Rich) -> None:
        kept = (rich.values & np.uint64(1)).nonzero()[0]
        self.values, self.n_lines = rich.values[kept], rich.n_lines
        self.lines = None if rich.lines is None else rich.lines[kept]

    @functools.cached_property
    def seeds(self) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of the runs of SEED tokens with NUMBERS numbers or more, and where they begin."""
        v = self.values
        if len(v) < SEED:
            return np.empty(0, np.uint64), np.empty(0, np.int64)
        numbers = np.concatenate([[0], np.cumsum(v >= np.uint64(_NUMBER))])
        good = (numbers[SEED:] - numbers[:-SEED] >= NUMBERS).nonzero()[0]
        return _hashed(v, SEED)[good], good


class _Running:
    """Karp-Rabin hashes of the windows of a stream, each from running sums in a step that doesn't depend on its length."""

    def __init__(self, values: np.ndarray) -> None:
        with np.errstate(over="ignore"):
            powers = np.cumprod(np.concatenate([[np.uint64(1)], np.full(len(values), _HASH)]), dtype=np.uint64)
            self.back = np.cumprod(np.concatenate([[np.uint64(1)], np.full(len(values), _BACK)]), dtype=np.uint64)
            # small values are spread first, so that sums of a few don't meet
            spread = (values ^ (values >> np.uint64(31))) * np.uint64(0xD6E8FEB86659FD93)
            self.sums = np.concatenate([[np.uint64(0)], np.cumsum((spread ^ (spread >> np.uint64(29))) * powers[:-1], dtype=np.uint64)])

    def windows(self, free: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of the windows of ``size`` values that are all free, and where they begin."""
        if len(free) < size:
            return np.empty(0, np.uint64), np.empty(0, np.int64)
        marks = np.concatenate([[0], np.cumsum(~free)])
        at = np.flatnonzero(marks[size:] == marks[:-size])
        with np.errstate(over="ignore"):
            return (self.sums[at + size] - self.sums[at]) * self.back[at], at


def tile(a: np.ndarray, b: np.ndarray, shortest: int = TILE) -> list[tuple[int, int, int]]:
    """Greedy string tiling of two streams by running Karp-Rabin: (start in a, start in b, length) of each tile.

    The search length halves from the longest possible. At each length the unmarked windows
    of ``a`` are hashed into a table, those of ``b`` looked up, every hit is compared and
    extended as far as it goes, and the longest are marked first.
    """
    x, y = a.tolist(), b.tolist()
    free_a, free_b = np.ones(len(x), bool), np.ones(len(y), bool)
    running_a, running_b = _Running(a), _Running(b)
    tiles = []
    length = max(shortest, min(len(x), len(y)))
    while True:
        table = defaultdict(list)
        hashes, where = running_a.windows(free_a, length)
        for h, i in zip(hashes.tolist(), where.tolist(), strict=True):
            table[h].append(i)
        matches = []
        hashes, where = running_b.windows(free_b, length)
        hit = _among(hashes, np.unique(np.fromiter(table, np.uint64, len(table))))
        for h, j in zip(hashes[hit].tolist(), where[hit].tolist(), strict=True):
            for i in table[h]:
                if i and j and x[i - 1] == y[j - 1] and free_a[i - 1] and free_b[j - 1]:
                    continue  # the match that begins one earlier covers this one
                n = 0
                while i + n < len(x) and j + n < len(y) and x[i + n] == y[j + n] and free_a[i + n] and free_b[j + n]:
                    n += 1
                if n >= length:
                    matches.append((n, i, j))
        matches.sort(key=lambda m: (-m[0], m[1], m[2]))
        for n, i, j in matches:
            if free_a[i : i + n].all() and free_b[j : j + n].all():
                free_a[i : i + n] = free_b[j : j + n] = False
                tiles.append((i, j, n))
        if length == shortest:
            return tiles
        length = max(shortest, length // 2)


def _consistent(item: Rich, document: list[str], places: list[tuple[int, int]]) -> bool:
    """Whether the names at the places stand for the same names throughout, each for one, as far as CONSISTENT asks.

    Where there is next to nothing but names, they must be the same names.
    """
    pairs = Counter((item.tokens[i], document[j]) for i, j in places if item.values[i] == _NAME)
    total = sum(pairs.values())
    if len(places) - total < TELLING * len(places):
        return sum(n for (a, b), n in pairs.items() if a == b) >= CONSISTENT * total
    there, back = defaultdict(int), defaultdict(int)
    for (a, b), n in pairs.items():
        there[a], back[b] = max(there[a], n), max(back[b], n)
    return min(sum(there.values()), sum(back.values())) >= CONSISTENT * total


def coverage(item: Rich, document: Rich) -> float:
    """Share of the item's tokens that tiles of both cover, wherever they lie; 0 if their names are not consistent.

    A tile counts if it holds a number or a keyword, or has RICH_SEED tokens or more.
    """
    places: list[tuple[int, int]] = []
    for i, j, n in tile(item.values, document.values, RICH_TILE):
        if n >= RICH_SEED or (item.values[i : i + n] >= np.uint64(_NUMBER)).any():
            places += zip(range(i, i + n), range(j, j + n), strict=True)
    return len(places) / len(item.values) if places and _consistent(item, document.tokens, places) else 0.0


def covered_lines(item: Stream | Rich, document: np.ndarray, shortest: int = TILE, tokens: list[str] | None = None) -> int:
    """The most consecutive code lines of the item that the document's tiles cover, in their order.

    Only tiles near the item's matches count: the document is cut to the neighbourhood of
    each seed. A line with tokens is covered if all of them are, to places that follow
    those of the line before within a short distance. A line without tokens goes with its
    neighbours, in the plain stream with those before it. With the document's ``tokens``, only lines count that are part of LINES
    covered lines, or of all, whose names are consistent.
    """
    tiles = tile(item.values, document, shortest)
    to = np.full(len(item.values), -1, np.int64)
    for i, j, n in tiles:
        to[i : i + n] = np.arange(j, j + n)
    if tokens is not None:
        kept = np.zeros(len(to), bool)
        for low in range(max(1, item.n_lines - LINES + 1)):
            within = (item.lines >= low) & (item.lines < low + LINES)
            if (to[within] >= 0).all() and _consistent(item, tokens, [(int(i), int(to[i])) for i in np.flatnonzero(within)]):
                kept |= within
        to[~kept] = -1
    most = run = gap = 0
    last = -1
    for line in range(item.n_lines):
        at = to[item.lines == line]
        if not len(at):
            gap += bool(run or tokens)  # counts if a covered line follows, or the item ends here
            continue
        steps = np.diff(at)
        good = (at >= 0).all() and (steps > 0).all() and (steps <= STEP).all()
        if good and run and not 0 < at[0] - last <= LEAP:
            run = 0
            gap = 0
        if good:
            run, last = run + gap + 1, at[-1]
            gap = 0
            most = max(most, run)
        else:
            most = max(most, run + min(gap, 1) if tokens is None else run and run + gap)
            run = gap = 0
    return max(most, run and run + gap)


def _near(positions: np.ndarray, total: int, reach: int) -> list[tuple[int, int]]:
    """Stretches of the document around seeds; those that overlap are one."""
    spans: list[tuple[int, int]] = []
    for p in np.sort(positions).tolist():
        low, high = max(0, p - reach), min(total, p + reach)
        if spans and low <= spans[-1][1]:
            spans[-1] = (spans[-1][0], high)
        else:
            spans.append((low, high))
    return spans


class _Owned:
    """Hashes with the items, by number, that each belongs to."""

    def __init__(self, hashes: list[np.ndarray]) -> None:
        flat = np.concatenate([np.empty(0, np.uint64), *hashes])
        order = np.argsort(flat, kind="stable")
        self.hashes, self.owners = flat[order], np.repeat(np.arange(len(hashes)), [len(x) for x in hashes])[order]
        self.of = [np.sort(x) for x in hashes]

    def met(self, hashes: np.ndarray) -> dict[int, np.ndarray]:
        """The items of which hashes are among these, and at which places."""
        at = _among(hashes, self.hashes).nonzero()[0]
        if not len(at):
            return {}
        some = np.unique(hashes[at])
        low, high = np.searchsorted(self.hashes, some, side="left"), np.searchsorted(self.hashes, some, side="right")
        owners = sorted({owner for a, b in zip(low.tolist(), high.tolist(), strict=True) for owner in self.owners[a:b].tolist()})
        return {owner: at[_among(hashes[at], self.of[owner])] for owner in owners}


def _rare(item: Rich, log_share: dict[int, float]) -> np.ndarray:
    """For each token of an item how common the most common run of RICH_TILE tokens is that holds it."""
    sums = np.concatenate([[0.0], np.cumsum([log_share[v] for v in item.values.tolist()])])
    runs = np.concatenate([np.full(RICH_TILE - 1, -np.inf), sums[RICH_TILE:] - sums[:-RICH_TILE], np.full(RICH_TILE - 1, -np.inf)])
    return np.lib.stride_tricks.sliding_window_view(runs, RICH_TILE).max(axis=1)


def _around(item: Rich, places: np.ndarray) -> np.ndarray:
    """Hashes of the runs of RICH_TILE tokens that hold one of the places."""
    begin = np.unique((places[:, None] - np.arange(RICH_TILE)).ravel())
    return np.unique(item.runs[begin[(begin >= 0) & (begin < len(item.runs))]])


class Index:
    """Seeds of a block of items."""

    def __init__(self, items: list[tuple[str, str]], reordered: bool = True) -> None:
        self.known = _Known()
        self.items: list[tuple[str, Stream, Rich]] = []
        #: Lines of fewer than RICH_TILE tokens in all, token by token, with the items and how many lines.
        self.short: dict[tuple[str, ...], dict[int, int]] = defaultdict(dict)
        for name, code in items:
            rich = Rich(_REMARK.sub("", unwrap(code)), self.known, with_lines=True)
            if rich.n_lines:
                self.items.append((name, Stream(rich), rich))
        self.plain = _Owned([np.unique(plain.seeds[0]) for _, plain, _ in self.items])
        counts = Counter(v for _, _, rich in self.items for v in rich.values.tolist())
        log_share = {v: math.log(n / counts.total()) for v, n in counts.items()}
        lines, whole = [], []
        for k, (_, _, rich) in enumerate(self.items):
            none = np.empty(0, np.uint64)
            size = len(rich.values)
            if size >= RICH_TILE and (rich.n_lines > 2 or size >= RICH_SEED):
                rare = _rare(rich, log_share)
                lines.append(_around(rich, np.array([a + rare[a:b].argmin() for a, b in zip(*rich.windows, strict=True)])))
                # tiles that cover COVERED of all tokens leave out fewer than these
                whole.append(_around(rich, np.argsort(rare, kind="stable")[: int((1 - COVERED) * size + 1e-9) + 1]) if reordered else none)
            else:
                lines.append(none)
                whole.append(none)
            for a, b in zip(*rich.windows, strict=True) if rich.n_lines > 2 else ():
                if b - a < RICH_TILE:
                    self.short[tuple(rich.tokens[a:b])][k] = min(LINES, rich.n_lines)
        self.lines, self.whole = _Owned(lines), _Owned(whole)

    def _most(self, item: Stream | Rich, values: np.ndarray, where: np.ndarray, tokens: list[str] | None = None) -> int:
        """The most lines in a row around places of a text: close to them, and as far as lines can lie. 0 if they are too few."""
        most, seen = 0, None
        for reach in (2 * len(item.values) + 40, STEP * len(item.values) + LEAP * item.n_lines):
            spans = _near(where, len(values), reach)
            if spans != seen:
                for a, b in spans:
                    if most < item.n_lines and item.lines_at_most(values[a:b]):
                        most = max(most, covered_lines(item, values[a:b], item.shortest, tokens and tokens[a:b]))
            seen = spans
        return most

    def _lines(self, views: list[Rich]) -> dict[int, int]:
        """The most lines in a row of each item, by number, that the views of a text could hold in their order."""
        out: dict[int, int] = defaultdict(int)
        for view in views:
            plain = Stream(view)
            hashes, where = plain.seeds
            for owner, at in self.plain.met(hashes).items():
                item = self.items[owner][1]
                if out[owner] < item.n_lines:
                    out[owner] = max(out[owner], self._most(item, plain.values, where[at]))
            for owner, at in self.lines.met(view.runs).items():
                item = self.items[owner][2]
                if out[owner] < item.n_lines:
                    out[owner] = max(out[owner], self._most(item, view.values, at, view.tokens))
            for size in {len(x) for x in self.short}:
                for k in range(len(view.tokens) - size + 1):
                    for owner, n in self.short.get(tuple(view.tokens[k : k + size]), {}).items():
                        out[owner] = max(out[owner], n)
        return out

    def _could_cover(self, view: Rich) -> Iterator[int]:
        """Items, by number, of which tiles of the richer stream could cover COVERED."""
        for owner in self.whole.met(view.runs):
            item = self.items[owner][2]
            if item.covered_at_most(view.values)[-1] / len(item.values) >= COVERED:
                yield owner

    def leaks(self, text: str, reordered: bool = True) -> list[tuple[str, int, float, bool]]:
        """Name, most lines in a row, share covered and whether in order, of the items that the text leaks.

        The lines are 0 where fewer than LINES could be covered. The share is that of the best view.
        Without ``reordered`` it is not taken.
        """
        if len(self.known) > 1_000_000:
            self.known.clear()
        plain = "\n" + unwrap(text)
        stripped = _LEAD.sub("\n", plain)
        # everything; what was commented out, without the comments inside it; what stands outside whole-line comments
        texts = [stripped]
        inner = _REMARK.sub("", stripped) if "#" in stripped or "//" in stripped else stripped
        if len(inner) != len(stripped):
            texts.append(inner)
        bare = _WHOLE_REMARK.sub("\n", plain) if "#" in plain or "//" in plain else plain
        if len(bare) != len(plain):
            texts.append(_REMARK.sub("", _LEAD.sub("\n", bare)))
        views = [Rich(x, self.known) for x in texts]
        most = self._lines(views)
        in_order = {k for k, lines in most.items() if lines >= min(LINES, self.items[k][2].n_lines)}
        wanted = in_order.union(*(self._could_cover(view) for view in views)) if reordered else in_order
        out = []
        for k in sorted(wanted):
            name, _, whole = self.items[k]
            share = max(coverage(whole, view) for view in views) if reordered else 0.0
            if k in in_order or share >= COVERED:
                out.append((name, most.get(k, 0), share, k in in_order))
        return out


def leaked(documents: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item_key: str = "id", item_text: str = "ref_solution", reordered: bool = True) -> DataFrame:
    """``key``, ``item_id``, ``lines``, ``covered`` and ``in_order`` for every document that leaks an item, distinct.

    ``lines`` are the most code lines in a row, or 0 where they can't be LINES, ``covered`` the share of the item's tokens that
    tiles cover, ``in_order`` says whether LINES lines in a row, or all, are there in their order;
    the other rows have COVERED of the item in another order. Without ``reordered`` these are
    left out and ``covered`` is 0.

    ``items`` is the fixed evaluation set; it is read in blocks of PASS_CHARS characters
    that are sent to the tasks, a pass over the documents for each block. Null and blank
    texts on either side, null ids, lines without any token of the richer stream, and items of
    one or two lines with fewer than RICH_SEED tokens in all and no seed are never a case. Lines of
    fewer than RICH_TILE tokens in all are one if all of their tokens are there in a row, names
    and all. Repeated rows count once.
    """
    spark = documents.sparkSession
    wanted = items.select(F.col(item_key).cast("string").alias("id"), F.col(item_text).alias("code")).where("id is not null and length(trim(code)) > 0").distinct()
    rows = documents.select(F.col(key).alias("_key"), F.col(text).alias("_text")).where("_key is not null and length(_text) > 0")
    schema = f"{key} {rows.schema['_key'].dataType.simpleString()}, item_id string, lines int, covered double, in_order boolean"
    blocks: list[list[tuple[str, str]]] = [[]]
    size = 0
    for row in wanted.orderBy("id", "code").toLocalIterator():
        if size > PASS_CHARS:
            blocks.append([])
            size = 0
        blocks[-1].append((row.id, row.code))
        size += len(row.code)
    out = None
    for block in blocks:
        shared = spark.sparkContext.broadcast(block)

        def search(frames: Iterator[pd.DataFrame], shared=shared) -> Iterator[pd.DataFrame]:  # noqa: ANN001
            index = Index(shared.value, reordered)
            for frame in frames:
                rows = [(k, *leak) for k, body in zip(frame["_key"], frame["_text"], strict=True) for leak in index.leaks(body, reordered)]
                if rows:
                    yield pd.DataFrame(rows, columns=[key, "item_id", "lines", "covered", "in_order"])

        part = rows.mapInPandas(search, schema)
        out = part if out is None else out.unionByName(part)
    return out.groupBy(key, "item_id").agg(*[F.max(c).alias(c) for c in ("lines", "covered", "in_order")])
