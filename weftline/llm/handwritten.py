"""Generated, minified and vendored files, and bodies of data kept as source.

Every text becomes a stream of masked tokens (names I, numbers N, strings S; keywords and
signs as they are). Runs of five are its shingles, 80 min-hash places its signature. Texts
of equal signatures are one node. Bands of the signature bring similar nodes together in
buckets, and within a bucket every pair of nodes whose signatures agree in 0.8 of the places or
more counts: the least node is a head, to which all that agree with it are linked; the least
of the rest is the next head, and so on; nodes that agree with each other but with no common
head join the clusters of their heads. The nodes around a head are a cluster, and so is every
connected component of links.

What a cluster means is read off all of its members:

- data, if the masked streams of half of them or more hold next to nothing but literals;
- minified, if half of them or more have a minifier's layout;
- generated, if it lies within one repository and its members differ unmasked (one template,
  many fillings), or if a fair share of them say that a tool wrote them, so it wrote the others;
- vendored, for clusters over unmasked shingles in several repositories of which some say
  that they come from elsewhere.

The spread of unmasked clusters over repositories alone decides nothing: edited copies of
hand-written files lie in several. Texts that have no partner are judged by what they say,
their layout and where they lie.
"""

from __future__ import annotations

import functools
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.llm.near import _mix
from weftline.session import settle

RUN = 5
PLACES = 80
#: Buckets that a signature goes to, and the places that make each; a place is in two bands.
BANDS, ROWS = 20, 8
#: Share of the signature places that must agree for a link, and how many that is.
AGREE = 0.8
MOST = round(AGREE * PLACES)
#: Of the 16 half-bytes of two unmasked signatures, those that agree in texts that are not unlike.
SKETCH_AGREE = 8
#: Nodes of a bucket that are compared as a matrix, and those that go to one task; of more, each two parts of that size meet in a task.
MATRIX, PART = 256, 16_384
#: Members that say so, and the share of members that these, less their likely error, must make, for a cluster to be generated.
SAYING, SHARE = 4, 0.2
#: The same for a cluster of copies to be vendored, without allowing for an error.
SAYING_COPY, SHARE_COPY = 1, 0.3
#: And for a cluster to be data, or minified.
ALIKE, SHARE_ALIKE = 2, 0.5
#: Members of a family within one repository, the share that this repository must hold, and that of members unlike their head unmasked.
FAMILY, SHARE_REPO, SHARE_UNLIKE = 8, 0.8, 0.5
#: Unmasked signature places of which fewer agree in two fillings of one template.
UNLIKE = 0.5
#: Share of a text's characters that long literals make in a body of data.
LITERAL_CHARS = 0.9

_RNG = np.random.default_rng(40_009)
_MULTIPLY = (_RNG.integers(1, 2**63, PLACES, dtype=np.uint64) << np.uint64(1)) | np.uint64(1)
_ADD = _RNG.integers(0, 2**63, PLACES, dtype=np.uint64)
_BAND = np.concatenate([_RNG.permutation(PLACES) for _ in range(BANDS * ROWS // PLACES)]).reshape(BANDS, ROWS)
_P = np.uint64(0x9E3779B97F4A7C15)

_TOKEN = re.compile(
    r"[rbufRBUF]{0,2}(?:\"\"\"(?:[^\"\\]|\\.|\"(?!\"\"))*\"\"\"|'''(?:[^'\\]|\\.|'(?!''))*''')|[rbufRBUF]{0,2}\"(?:[^\"\\\n]|\\.)*\"|[rbufRBUF]{0,2}'(?:[^'\\\n]|\\.)*'|`[^`\n]*`|[^\W\d][\w$]*|\$\w+|\d[\w.]*|[^\s\w]",
    re.S,
)
# Keywords that stay in the masked stream.
_KEYWORDS = frozenset(
    "def class return import from if elif else for while try except finally raise with as yield lambda pass not and or in is None True False const let var function export async await new this self throw switch case default null true false print assert do done then fi".split()
)

# What comments of generated files say.
_GENERATED = re.compile(
    r"(?i)auto[- ]?generated|@generated|\bgenerated (?:by|from|with|code|file)\b|machine[- ]generated|code generated|do not (?:modify|edit|change) this|do not edit|hands off|\boutput of \S+ \d|regenerate with|is rebuilt from|manual changes will be lost|"
    r"maschinell erzeugt|automatisch (?:erzeugt|generiert)|nicht von hand ändern|généré automatiquement|ne pas modifier|archivo generado|generado (?:automáticamente|por)|no editar|generato automaticamente|gerado (?:automaticamente|por)|wygenerowan|automatisch gegenereerd|sourcemappingurl"
)
_BY_HAND = re.compile(r"(?i)by hand|nothing in|not (?:auto-?)?generated|edit freely|hand-?written")
# What comments of copied third-party files say.
_VENDORED = re.compile(
    r"(?i)vendored (?:copy|from)|\bbackport of\b|third[_-]party[/:]|upstream[- ]version|\bupstream:\s*http|imported verbatim|\bbundled here\b|\(external project\)|not part of this code ?base|bugs go upstream|unmodified copy of|\bcopied (?:in )?from (?:its|the|http)|never patch in place|release archive|"
    r"kopie aus dem fremdprojekt|copie (?:du|d'un) projet|copia (?:del|de un) proyecto|@preserve|\(c\)[^\n]{0,40}\bcontributors\b|by the [\w-]+ contributors|distributed with [\w-]+; see"
)
_VENDOR_PATH = re.compile(r"(?i)(?:^|/)(?:_?vendor(?:ed)?|third[_-]?party|node_modules|bower_components|extern(?:al)?s?|site-packages)/")
_LIBRARY_PATH = re.compile(r"^(?:[^/]+/)*lib/[a-z]{5,}(?:lib|kit|util)\.(?:py|js)$")
_COMMENT = re.compile(r"^[ \t\ufeff\xa0]*(?:#|//|/\*|\*|;|<!--|--|:|\"\"\"|''')")
# Comments and metadata tags are read for what they say, but are no part of the masked stream.
_LINE_REMARK = re.compile(r"(?m)^[ \t\ufeff]*(?:#|//|;|<(?:reponame|filename|gh_stars)>)[^\n]*$")
_END_REMARK = re.compile(r"[ \t,;)\]}](?:#[ \t]|//[ \t])[^\n\"'`]*")
_BLOCK_REMARK = re.compile(r"/\*[^*]*(?:\*(?!/)[^*]*)*\*/")


def _strip(text: str) -> str:
    if "#" in text or "//" in text or ";" in text or text.startswith(("<", "\ufeff")):
        text = _LINE_REMARK.sub("", text)
    if "# " in text or "// " in text or "#\t" in text:
        text = _END_REMARK.sub("", text)
    return _BLOCK_REMARK.sub("", text) if "/*" in text else text


_RANDOM = re.compile(r"(?<![A-Za-z0-9+/=])[A-Za-z0-9+/=]{32,}(?![A-Za-z0-9+/=])")
_ESCAPE = re.compile(r"\\x[0-9A-Fa-f]{2}")
_KEY_BLOCK = re.compile(r"-----BEGIN [A-Z0-9 ]+-----(?:(?!-----BEGIN).)*?-----END [A-Z0-9 ]+-----", re.S)
# Pieces of text without which no comment can say either.
_HINTS = (
    "generated", "edit", "modify", "hands off", "output of", "regenerate", "rebuilt", "changes will", "erzeugt", "generiert", "ändern", "généré", "modifier", "generado", "editar", "generato", "gerado", "wygenerowan", "gegenereerd", "sourcemappingurl",
    "vendored", "backport", "third", "upstream", "verbatim", "bundled", "external project", "not part of", "unmodified", "copied", "in place", "release archive", "fremdprojekt", "copie d", "copia de", "@preserve", "contributors", "distributed with",
)


@functools.lru_cache(maxsize=1)
def _hints():  # noqa: ANN202
    import ahocorasick

    machine = ahocorasick.Automaton()
    for word in _HINTS:
        machine.add_word(word, len(word))
    machine.make_automaton()
    return machine


def says(text: str) -> tuple[bool, bool]:
    """Whether a comment says that the text was generated, and that it comes from elsewhere."""
    generated = vendored = False
    seen = -1
    low = text.lower()
    if len(low) != len(text):
        low = "".join(c.lower() if len(c.lower()) == 1 else c for c in text)
    for at, _ in _hints().iter(low):
        if at < seen:
            continue
        start = text.rfind("\n", 0, at) + 1
        seen = text.find("\n", at)
        seen = len(text) if seen < 0 else seen
        line = text[start:seen]
        if not _COMMENT.match(line) or line.lstrip().startswith(('"""', "'''")) and "generated by the" in line.lower():
            continue
        if _BY_HAND.search(line):
            continue
        generated = generated or bool(_GENERATED.search(line))
        vendored = vendored or bool(_VENDORED.search(line))
    return generated, vendored


#: Characters of the longest token whose number is remembered.
LONG_TOKEN = 64


class Masks:
    """Numbers of tokens, short ones remembered: the masked token, what kind it is, and the token itself."""

    def __init__(self) -> None:
        self._known: dict[str, int] = {}

    @staticmethod
    def _number(token: str) -> int:
        c = token[0]
        name = keyword = short = sign = 0
        if token[-1] in "\"'`" and len(token) > 1:
            masked = 3
        elif c.isalpha() or c in "_$":
            keyword = token in _KEYWORDS
            name = not keyword
            short = name and len(token) <= 2
            masked = 4 + xxhash.xxh3_64_intdigest(token) % (2**27 - 4) if keyword else 1
        elif c.isdigit():
            masked = 2
        else:
            sign = token in ";{}()="
            masked = 4 + xxhash.xxh3_64_intdigest(token) % (2**27 - 4)
        return masked << 36 | sign << 35 | short << 34 | keyword << 33 | name << 32 | xxhash.xxh3_64_intdigest(token) >> 32

    def of(self, tokens: list[str]) -> np.ndarray:
        known = self._known
        if len(known) > 1_000_000:
            known.clear()
        new = {t: self._number(t) for t in set(tokens).difference(known)}
        known.update(new)
        numbers = np.fromiter(map(known.__getitem__, tokens), np.uint64, len(tokens))
        for t in new:
            if len(t) > LONG_TOKEN:
                del known[t]
        return numbers


def _share(numbers: np.ndarray, bit: int) -> int:
    """How many of the tokens have the bit: 32 names, 33 keywords, 34 names of a letter or two, 35 signs."""
    return int(((numbers >> np.uint64(bit)) & np.uint64(1)).sum())


def _shingles(numbers: np.ndarray) -> np.ndarray:
    n = len(numbers) - RUN + 1
    if n < 1:
        return np.empty(0, np.uint64)
    numbers = numbers * _P
    numbers ^= numbers >> np.uint64(29)
    h = np.zeros(n, np.uint64)
    for k in range(RUN):
        h *= _P
        h += numbers[k : n + k]
    return _mix(h)


def _signatures(sets: list[np.ndarray]) -> np.ndarray:
    """PLACES x sets minima; no set is empty."""
    flat = np.concatenate(sets)
    starts = np.concatenate([[0], np.cumsum([len(x) for x in sets])[:-1]])
    out = np.empty((PLACES, len(sets)), np.uint64)
    with np.errstate(over="ignore"):
        for k in range(PLACES):
            out[k] = np.minimum.reduceat((flat * _MULTIPLY[k] + _ADD[k]) >> np.uint64(32), starts)
    return out


def _bands(signatures: np.ndarray, salt: int) -> np.ndarray:
    """BANDS x sets keys."""
    with np.errstate(over="ignore"):
        h = np.repeat((np.arange(1, BANDS + 1, dtype=np.uint64) * _P + np.uint64(salt))[:, None], signatures.shape[1], axis=1)
        for k in range(ROWS):
            h = _mix(h * _P + signatures[_BAND[:, k]])
    return h.view(np.int64)


def _nodes_and_sketches(signatures: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each set a number that stands for its whole signature, and half-bytes of 16 places in one number."""
    with np.errstate(over="ignore"):
        node = np.zeros(signatures.shape[1], np.uint64)
        for k in range(PLACES):
            node = _mix(node * _P + signatures[k])
        sketch = np.zeros(signatures.shape[1], np.uint64)
        for k in range(16):
            sketch |= (_mix(signatures[5 * k]) & np.uint64(15)) << np.uint64(4 * k)
    return node.view(np.int64), sketch.view(np.int64)


def minified(text: str, numbers: np.ndarray) -> bool:
    """Whether the layout is a minifier's: no room between the tokens of long lines, or names of a letter or two throughout."""
    names, short = _share(numbers, 32), _share(numbers, 34)
    if names >= 40 and short > 0.4 * names and _share(numbers, 35) > 0.2 * len(numbers) or names >= 24 and short > 0.7 * names:
        return True
    lines = text.split("\n")
    dense = 0
    for line in lines:
        size = len(line)
        if size > 300 and line.count(" ") + line.count("\t") < 0.03 * size and sum(line.count(c) for c in ";{},") > 0.03 * size and not _RANDOM.search(line):
            dense += size
    return dense > 0.5 * max(1, len(text))


def data_body(text: str, bare: str, numbers: np.ndarray, tokens: list[str]) -> bool:
    """Whether the text is a body of data kept as source: literals and hardly anything else."""
    size = max(1, len(text))
    long = sum(len(t) for t in tokens if len(t) > 200 and t[-1] in "\"'`" and "-----BEGIN" not in t) if max(map(len, tokens), default=0) > 200 else 0
    if long >= LITERAL_CHARS * len(bare.strip()) > 0 and any(t in "=:(" for t in tokens):
        return True
    if "\\x" in text and len(_ESCAPE.findall(text)) * 4 > 0.3 * size:
        return True
    plain = _KEY_BLOCK.sub("", text) if "-----BEGIN" in text else text
    random = [len(m) for m in _RANDOM.findall(plain) if any(c.isdigit() for c in m) and len(set(m)) > 9]
    if len(random) >= 8 and sum(random) > 0.15 * size or sum(random) > 0.6 * size and sum(random) > 200:
        return True
    count = len(numbers)
    if count >= 120 and bare.lstrip("\ufeff \t\r\n")[:1] not in ("{", "["):
        masked = numbers >> np.uint64(36)
        if _share(numbers, 32) + _share(numbers, 33) < 0.12 * count and int(((masked == 2) | (masked == 3)).sum()) > 0.3 * count:
            return True
    if bare.count(",") >= 2 * bare.count("\n") > 20:
        lines = [x for x in bare.split("\n") if x.strip()]
        if len(lines) >= 12:
            commas, rows = Counter(x.count(",") for x in lines).most_common(1)[0]
            return commas >= 2 and rows >= 0.85 * len(lines) and sum(" " not in x.strip() and "(" not in x for x in lines) > 0.85 * len(lines)
    return False


_SCHEMA = "id bigint, repo string, generated boolean, vendored boolean, minified boolean, data boolean, sig binary, node bigint, sketch bigint, bands array<bigint>, near_sig binary, near_node bigint, near_sketch bigint, near_bands array<bigint>"


def _features(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    masks = Masks()
    names = [c.split()[0] for c in _SCHEMA.split(", ")]
    for frame in frames:
        for low in range(0, len(frame), 500):
            part = frame.iloc[low : low + 500]
            rows, sets, near_sets, places = [], [], [], []
            for key, text, repo, path in zip(part["id"], part["text"], part["repo"], part["path"], strict=True):
                if not text.strip():
                    continue
                bare = _strip(text)
                tokens = _TOKEN.findall(bare)
                numbers = masks.of(tokens)
                generated, vendored = says(text)
                if isinstance(path, str) and (_VENDOR_PATH.search(path) or _LIBRARY_PATH.search(path)):
                    vendored = True
                a, b = _shingles(numbers >> np.uint64(36)), _shingles(numbers & np.uint64(2**32 - 1))
                if len(a):
                    places.append(len(rows))
                    sets.append(a)
                    near_sets.append(b)
                rows.append([key, repo, generated, vendored, minified(text, numbers), data_body(text, bare, numbers, tokens), *[None] * 8])
            for at, some, salt in ((6, sets, 1), (10, near_sets, 2)) if sets else ():
                signatures = _signatures(some)
                bands, (nodes, sketches) = _bands(signatures, salt), _nodes_and_sketches(signatures)
                small = signatures.astype(np.uint8)
                for k, place in enumerate(places):
                    rows[place][at : at + 4] = small[:, k].tobytes(), int(nodes[k]), int(sketches[k]), bands[:, k]
            if rows:
                out = pd.DataFrame(rows, columns=names)
                for c in ("node", "sketch", "near_node", "near_sketch"):
                    out[c] = out[c].astype("Int64")
                yield out


class _Signed:
    """Nodes in rows with their signatures, and a bit of each place by which most pairs that don't agree are told apart."""

    def __init__(self, sigs: np.ndarray) -> None:
        self.sigs = sigs
        bits = np.zeros((len(sigs), 16), np.uint8)
        bits[:, : PLACES // 8] = np.packbits(sigs & np.uint8(1), axis=1)
        self.bits = np.ascontiguousarray(bits.view(np.uint64).T)

    def may(self, a, b) -> np.ndarray:  # noqa: ANN001
        """Whether no more bits differ than places may."""
        return np.bitwise_count(self.bits[0][a] ^ self.bits[0][b]) + np.bitwise_count(self.bits[1][a] ^ self.bits[1][b]) <= PLACES - MOST

    def agree(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return (self.sigs[a] == self.sigs[b]).sum(axis=1) >= MOST

    def with_one(self, a: int, others: np.ndarray) -> np.ndarray:
        """Those of ``others`` that agree with ``a``."""
        some = others[self.may(a, others)]
        return some[(self.sigs[some] == self.sigs[a]).sum(axis=1) >= MOST]


def _pairs(signed: _Signed, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All pairs of rows of one group that agree; rows are in the order of their groups."""
    one, two = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    for apart in range(1, len(group)):
        same = group[apart:] == group[:-apart]
        if not same.any():
            break
        a = (same & signed.may(slice(None, -apart), slice(apart, None))).nonzero()[0]
        good = a[signed.agree(a, a + apart)]
        one.append(good)
        two.append(good + apart)
    a, b = np.concatenate(one), np.concatenate(two)
    order = np.lexsort((b, a))
    return a[order], b[order]


def _linked_few(signed: _Signed, group: np.ndarray, wanted: np.ndarray | None) -> Iterator[tuple[int, int, bool]]:
    """Row, row of its head and whether it is of the head's cluster, for groups of few rows, from all pairs that agree."""
    beside: dict[int, list[int]] = {}
    a, b = _pairs(signed, group)
    pairs = list(zip(a.tolist(), b.tolist(), strict=True))
    for x, y in pairs:
        beside.setdefault(x, []).append(y)
        beside.setdefault(y, []).append(x)
    # the first head of each row, and which heads are in one component
    first: dict[int, int] = {}
    above: dict[int, int] = {}

    def top(x: int) -> int:
        while above.get(x, x) != x:
            x = above[x]
        return x

    for x in sorted(beside):
        if x not in first if wanted is None else wanted[x] and not all(y in first for y in (x, *beside[x])):
            first.setdefault(x, x)
            for y in beside[x]:
                if first.setdefault(y, x) != x:
                    above[top(first[y])] = top(x)
                yield y, x, True
    if wanted is None:
        for x, y in pairs:
            if first[x] != first[y] and top(first[x]) != top(first[y]):
                above[top(first[y])] = top(first[x])
                yield y, x, False


def _linked_many(signed: _Signed, wanted: np.ndarray | None) -> Iterator[tuple[int, int, bool]]:
    """The same for one group of many rows, without all pairs: no two rows of one component are compared but with heads."""
    every = np.arange(len(signed.sigs))
    seen, root = np.zeros(len(every), bool), every.copy()
    heads = []
    for x in every.tolist() if wanted is None else wanted.nonzero()[0].tolist():
        if wanted is None and seen[x]:
            continue
        found = signed.with_one(x, every)
        if seen[found].all():
            continue
        seen[found] = True
        heads.append(x)
        if len(found) > 1:
            root[np.isin(root, root[found])] = root[x]
            yield from ((y, x, True) for y in found.tolist() if y != x)
    if wanted is not None:
        return
    rest = np.delete(every, heads)
    for k, x in enumerate(rest.tolist()):
        others = rest[k + 1 :]
        for y in signed.with_one(x, others[root[others] != root[x]]).tolist():
            if root[y] != root[x]:
                root[root == root[y]] = root[x]
                yield y, x, False


def _places(column: pa.Array) -> np.ndarray:
    """Signatures as rows of bytes, where they lie."""
    return np.frombuffer(column.buffers()[2], np.uint8, len(column) * PLACES, column.offset * PLACES).reshape(-1, PLACES)


_LINK = pa.schema([("node", pa.int64()), ("head", pa.int64()), ("unlike", pa.bool_()), ("star", pa.bool_())])


def _linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links within the buckets, whose rows follow each other by ``node``. ``unlike``: their unmasked signatures don't agree."""

    def bucket(rows: pa.Table | pa.RecordBatch) -> np.ndarray:
        return np.stack([rows[c].to_numpy(zero_copy_only=False) if isinstance(rows[c], pa.Array) else rows[c].to_numpy() for c in ("key", "low", "high")])

    def whole(parts: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = pa.Table.from_batches(parts)
        keys = bucket(rows)
        group = np.concatenate([[0], np.cumsum((keys[:, 1:] != keys[:, :-1]).any(axis=0))])
        sizes = np.bincount(group)
        sigs, other = (np.concatenate([_places(x[c]) for x in parts]) for c in ("sig", "other"))
        wanted = rows["wanted"].to_numpy().astype(bool) if not rows["wanted"].null_count else None
        few = (sizes[group] <= MATRIX).nonzero()[0]
        out = [(int(few[y]), int(few[x]), s) for y, x, s in _linked_few(_Signed(sigs[few]), group[few], None if wanted is None else wanted[few])]
        for k in (sizes > MATRIX).nonzero()[0]:
            at = (group == k).nonzero()[0]
            out += [(int(at[y]), int(at[x]), s) for y, x, s in _linked_many(_Signed(sigs[at]), None if wanted is None else wanted[at])]
        if out:
            one, two, star = (np.array(c) for c in zip(*out, strict=True))
            node = rows["node"].to_numpy()
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in (node[one], node[two], (other[one] == other[two]).mean(axis=1) < UNLIKE, star)], schema=_LINK)

    kept: list[pa.RecordBatch] = []
    for batch in batches:
        if not len(batch):
            continue
        keys = bucket(batch)
        begun = int((keys != keys[:, -1:]).any(axis=0).sum())
        if kept and (begun or (bucket(kept[-1])[:, -1] != keys[:, -1]).any()):
            yield from whole([*kept, batch.slice(0, begun)] if begun else kept)
            kept = []
        elif begun:
            yield from whole([batch.slice(0, begun)])
        kept.append(batch.slice(begun))
    if kept:
        yield from whole(kept)


def _sketches_agree(a: Column, b: Column) -> Column:
    """Whether SKETCH_AGREE of the 16 half-bytes are equal."""
    x = a.bitwiseXOR(b)
    some = x.bitwiseOR(F.shiftrightunsigned(x, 1))
    some = some.bitwiseOR(F.shiftrightunsigned(some, 2)).bitwiseAND(F.lit(0x1111111111111111))
    return F.bit_count(some) <= 16 - SKETCH_AGREE


def links(nodes: DataFrame, wanted: bool = False) -> DataFrame:
    """``node``, ``head``, ``unlike``, ``star``: nodes and the heads of their buckets that they agree with, no pair twice.

    ``nodes``: ``node``, ``bands``, ``sig``, ``other``, no node twice. Two nodes of a bucket that agree
    are in one connected component of the links. Where ``star`` is false they belong to no common
    head. With ``wanted`` (a boolean column) heads are wanted nodes, as many as it takes for each
    node that agrees with a wanted one to have a head. A bucket of more than PART nodes is met in
    parts, each two of them in a task.
    """
    lines = nodes.select("node", F.explode("bands").alias("key"))
    if wanted:
        lines = lines.join(nodes.where("wanted").select(F.explode("bands").alias("key")).distinct(), "key", "left_semi")
    else:
        lines = lines.repartition("key")  # one exchange for the counts and what they are joined to
    buckets = lines.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    parts = F.ceil(F.col("n") / PART)
    part = F.pmod(F.xxhash64("node"), parts)
    met = lines.join(buckets, "key").select("node", "key", part.alias("part"), F.explode(F.sequence(F.lit(0).cast("bigint"), parts - 1)).alias("other_part"))
    met = met.select("node", "key", F.least("part", "other_part").alias("low"), F.greatest("part", "other_part").alias("high"))
    signed = met.join(nodes.select("node", "sig", "other", (F.col("wanted") if wanted else F.lit(None).cast("boolean")).alias("wanted")), "node")
    found = signed.repartition("key", "low", "high").sortWithinPartitions("key", "low", "high", "node").mapInArrow(_linked, "node bigint, head bigint, unlike boolean, star boolean")
    return settle(found.groupBy("node", "head").agg(F.max("unlike").alias("unlike"), F.max("star").alias("star")), "links")


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """``node``, ``root`` (the least node of its connected component) of every node that has an edge (``node``, ``head``).

    First every node is put together with its least neighbour, which leaves few edges. Each round
    takes the least root among neighbours and then that root's own root, so the number of
    rounds grows with the logarithm of a chain's length. Raises if it doesn't end.
    """
    every = edges.select("node", F.col("head").alias("next")).union(edges.select("head", "node")).distinct()
    first = settle(every.groupBy("node").agg(F.least(F.min("next"), F.col("node")).alias("first")), "first")
    one, two = first.withColumnRenamed("first", "one"), first.select(F.col("node").alias("head"), F.col("first").alias("two"))
    left = settle(edges.select("node", "head").join(one, "node").join(two, "head").where("one <> two").select(F.least("one", "two").alias("one"), F.greatest("one", "two").alias("two")).distinct(), "edges")
    both = left.select(F.col("one").alias("node"), F.col("two").alias("next")).union(left.select("two", "one"))
    label = settle(both.groupBy("node").agg(F.least(F.min("next"), F.col("node")).alias("root")), "roots")
    for _ in range(rounds):
        near = both.join(label.select(F.col("node").alias("next"), "root"), "next").groupBy("node").agg(F.min("root").alias("least"))
        least = label.join(near, "node").select("node", "root", F.least("root", "least").alias("least"))
        # what a root's members have seen holds for the root as well
        hooked = least.groupBy(F.col("root").alias("of")).agg(F.min("least").alias("low"))
        jumped = least.join(hooked, least["root"] == hooked["of"], "left").select("node", F.col("root").alias("old"), F.least("least", "low").alias("root"))
        up = jumped.select(F.col("node").alias("root"), F.col("root").alias("above"))
        label = settle(jumped.join(up, "root", "left").select("node", "old", F.least("root", F.coalesce("above", "root")).alias("root")), "roots")
        if not label.where("root <> old").head(1):
            roots = label.select(F.col("node").alias("first"), "root")
            return first.join(roots, "first", "left").select("node", F.coalesce("root", "first").alias("root"))
        label = label.select("node", "root")
    raise RuntimeError(f"components are not settled after {rounds} rounds")


def clusters(edges: DataFrame) -> DataFrame:
    """``cluster``, ``node``, ``unlike``: each head with the nodes of its star, and each connected component, no row twice.

    A star's number is its head's, a component's that of its least node, bit by bit inverted.
    """
    unlike = edges.groupBy("node").agg(F.max("unlike").alias("unlike"))
    around = edges.where("star")
    stars = around.select(F.col("head").alias("cluster"), "node", "unlike").union(around.select("head", "head", F.lit(False)).distinct())
    joined = components(edges).join(unlike, "node", "left").select(F.bitwise_not("root").alias("cluster"), "node", F.coalesce("unlike", F.lit(False)))
    return stars.union(joined).groupBy("cluster", "node").agg(F.max("unlike").alias("unlike"))


def _meant(table: DataFrame, nodes: DataFrame) -> DataFrame:
    """``node``, ``kind``: nodes of masked clusters that mean something, and what."""
    placed = clusters(links(nodes))
    # texts of one node that are unlike its first one unmasked
    several = table.select("node", "near_sketch").join(nodes.where(F.col("docs") > 1).select("node", "first"), "node")
    apart = several.where(~_sketches_agree(F.col("near_sketch"), F.col("first"))).groupBy("node").agg(F.count(F.lit(1)).alias("apart"))
    known = nodes.select("node", "docs", "generated", "minified", "data").join(apart, "node", "left").fillna(0, ["apart"])
    # a node of several equal texts is a cluster by itself
    alone = nodes.where("docs > 1").select(F.col("node").alias("cluster"), "node", F.lit(False).alias("unlike"))
    counted = settle(placed.select("cluster", "node", "unlike").unionByName(alone).groupBy("cluster", "node").agg(F.max("unlike").alias("unlike")).join(known, "node"), "counted")
    by = counted.groupBy("cluster").agg(*[F.sum(c).alias(c) for c in ("docs", "generated", "minified", "data")], F.sum(F.when(F.col("unlike"), F.col("docs")).otherwise(F.col("apart"))).alias("unlike"))
    in_doubt = counted.join(by.where((F.col("docs") >= FAMILY) & (F.col("unlike") >= SHARE_UNLIKE * F.col("docs"))).select("cluster", F.col("docs").alias("size")), "cluster").select("cluster", "node", "size")
    homes = in_doubt.join(table.where("repo is not null").groupBy("node", "repo").agg(F.count(F.lit(1)).alias("n")), "node").groupBy("cluster", "repo").agg(F.sum("n").alias("n"), F.max("size").alias("size"))
    family = homes.where(F.col("n") >= SHARE_REPO * F.col("size")).select("cluster").distinct().withColumn("family", F.lit(True))
    k, n = F.col("generated"), F.col("docs")
    said = (k >= SAYING) & (k - F.sqrt(k) >= SHARE * n)
    told = by.join(family, "cluster", "left").select(
        "cluster",
        F.array_compact(
            F.array(
                F.when(said | F.coalesce("family", F.lit(False)), F.lit("generated_family")),
                F.when((F.col("minified") >= ALIKE) & (F.col("minified") >= SHARE_ALIKE * n), F.lit("minified_family")),
                F.when((F.col("data") >= ALIKE) & (F.col("data") >= SHARE_ALIKE * n), F.lit("data_family")),
            )
        ).alias("kinds"),
    ).where(F.size("kinds") > 0)
    return counted.select("cluster", "node").join(told, "cluster").select("node", F.explode("kinds").alias("kind")).distinct()


def _copies(table: DataFrame, nodes: DataFrame) -> DataFrame:
    """``near_node`` of unmasked clusters over several repositories of which enough members come from elsewhere."""
    edges = links(nodes.withColumn("wanted", F.col("vendored") > 0), wanted=True)
    around = edges.select(F.col("head").alias("cluster"), "node").union(nodes.where("vendored > 0").select("node", "node")).distinct()
    lying = around.join(table.select(F.col("near_node").alias("node"), "repo", "vendored"), "node")
    by = lying.groupBy("cluster").agg(F.count(F.lit(1)).alias("n"), F.count_if("vendored").alias("k"), F.approx_count_distinct("repo").alias("repos"))
    meant = by.where((F.col("k") >= SAYING_COPY) & (F.col("k") >= SHARE_COPY * F.col("n")) & (F.col("repos") > 1)).select("cluster")
    return around.join(meant, "cluster").select(F.col("node").alias("near_node")).distinct()


def kinds(documents: DataFrame) -> DataFrame:
    """``doc_id`` and ``kind`` of every file that isn't hand-written; a file of several kinds has a row for each.

    ``kind``: generated_family, minified_family, data_family, vendored_copy (what its cluster means),
    generated, minified, data, vendored (what it is by itself). Null and blank texts, and rows with
    a null id, are left out. Rows that repeat an id are judged each by its text.
    """
    named = documents.select(F.col("doc_id").cast("bigint").alias("id"), F.col("text").alias("text"), F.col("repo").alias("repo"), F.col("path").alias("path")).where("id is not null and length(text) > 0")
    table = settle(named.mapInPandas(_features, _SCHEMA), "features")
    number = lambda c: F.count_if(c).alias(c)
    masked = table.where("node is not null").groupBy("node").agg(F.any_value("bands").alias("bands"), F.any_value("sig").alias("sig"), F.any_value("near_sig").alias("other"), F.min("near_sketch").alias("first"), F.count(F.lit(1)).alias("docs"), number("generated"), number("minified"), number("data"))
    family = _meant(table, settle(masked, "nodes"))
    plain = table.where("node is not null").select(F.col("near_node").alias("node"), F.col("near_bands").alias("bands"), F.col("near_sig").alias("sig"), F.col("near_sig").alias("other"), "vendored")
    copies = _copies(table, plain.groupBy("node").agg(*[F.any_value(c).alias(c) for c in ("bands", "sig", "other")], number("vendored")))
    own = table.select("id", F.explode(F.array(*[F.when(F.col(k), F.lit(k)) for k in ("generated", "vendored", "minified", "data")])).alias("kind")).where("kind is not null")
    by_family = table.select("id", "node").join(family, "node").select("id", "kind")
    by_copy = table.select("id", "near_node").join(copies, "near_node").select("id", F.lit("vendored_copy").alias("kind"))
    return own.unionByName(by_family).unionByName(by_copy).select(F.col("id").alias("doc_id"), "kind").distinct()


def found(documents: DataFrame) -> DataFrame:
    """``doc_id`` of every file that isn't hand-written, distinct."""
    return kinds(documents).select("doc_id").distinct()
