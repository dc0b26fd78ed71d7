"""Text functions: built-in expressions first, Arrow UDFs where a text needs a parser or a state machine.

White space is what Python strips; ``WS`` names its characters so that Spark and SQL
trim the same. All functions give null for null unless they say otherwise.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftline.functions.rules import LICENCE_WORDS, LOGIC, PAIR_LOGIC, STOPS

WS = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0 " + "".join(map(chr, range(0x2000, 0x200B))) + "    　"
META_TAG = r"<(?:gh_stars|reponame|filename)>"

# Patterns that decide what counts as a literal, a definition, an import, a fenced block, and as chance or the clock.
STRING = r"'(?:[^'\\\n]|\\.)*'|\"(?:[^\"\\\n]|\\.)*\""
DEFINITION = r"(?m)^[ \t]*(?:async[ \t]+)?(?:def|class)[ \t]+([A-Za-z_][A-Za-z0-9_]*)"
IMPORT = r"(?m)^[ \t]*(?:import[ \t]+([A-Za-z_][\w.]*)|from[ \t]+([A-Za-z_][\w.]*)[ \t]+import)"
FENCE = r"```[ \t]*([A-Za-z0-9_+.\-]*)[ \t]*\n((?s:.*?))(?:\n[ \t]*```|\z)"
UNSTABLE = r"(?:\brandom\s*\.|(?:np|numpy)\s*\.\s*random|uuid\s*\.\s*uuid4|\bsecrets\s*\.|os\s*\.\s*urandom|time\s*\.\s*(?:time|perf_counter)\s*\(|datetime\s*\.\s*(?:now|today)\s*\()"
SEED = r"\bseed\s*\("


def strip(c: Column) -> Column:
    """Without white space at both ends."""
    return F.btrim(c, F.lit(WS))


def strip_right(c: Column) -> Column:
    return F.rtrim(c, F.lit(WS))


def blank(c: Column) -> Column:
    """Null, empty or white space."""
    return F.coalesce(strip(c) == "", F.lit(True))


def lines(c: Column) -> Column:
    return F.split(c, "\n", -1)


def unix_lines(c: Column) -> Column:
    """Line ends of all kinds as line feeds."""
    return F.replace(F.replace(c, F.lit("\r\n"), F.lit("\n")), F.lit("\r"), F.lit("\n"))


def code_lines(c: Column) -> Column:
    """Lines that are neither blank nor a comment alone, as they stand."""
    return F.filter(lines(c), lambda x: (strip(x) != "") & ~F.startswith(strip(x), F.lit("#")))


def effective_lines(c: Column) -> Column:
    return F.size(code_lines(c))


def template_key(c: Column) -> Column:
    """Hash of the text with string literals and numbers flattened, so texts of one template are equal."""
    return F.md5(F.regexp_replace(F.regexp_replace(c, STRING, "S"), r"\d+", "N"))


def strip_meta_prefix(c: Column) -> Column:
    """Without the lines of metadata tags at the top."""
    return F.regexp_replace(c, rf"\A(?:{META_TAG}[^\n]*\n)+", "")


def strip_meta_lines(c: Column, chained: bool = True) -> Column:
    """Without metadata tags and their values: a line that begins with a tag keeps what follows its last tag's value.

    With ``chained=False`` only the first tag of a line goes, with its value left in place.
    Other lines stay as they are, indentation included.
    """
    if not chained:
        return F.regexp_replace(c, rf"(?m)^{META_TAG}", "")
    return F.regexp_replace(c, rf"(?m)^(?:{META_TAG}[^<\n]*)+\n?", "")


def after_last(c: Column, marker: str = "### Code\n") -> Column:
    """What follows the last marker, or the whole text without one."""
    return F.substring_index(c, marker, -1)


def truncate(c: Column, stops: list[str] = STOPS) -> Column:
    """The text before the first of the stop strings."""
    spot = F.array_min(F.array(*[F.nullif(F.instr(c, s), F.lit(0)) for s in stops]))
    return F.when(spot.isNull(), c).otherwise(F.substring(c, F.lit(1), spot - 1))


def prompt(instruction: Column, style: str = "marker") -> Column:
    """Prompt text for an instruction: marker, fence or plain."""
    heads = {"marker": ("### Task\n", "\n\n### Code\n"), "fence": ("### Task\n", "\n\n```python\n"), "plain": ("", "\n\n")}
    head, tail = heads[style]
    return F.concat(F.lit(head), instruction, F.lit(tail))


def fences(c: Column) -> Column:
    """Fenced blocks as (tag, body), in order; an open one runs to the end."""
    text = unix_lines(c)
    return F.arrays_zip(F.regexp_extract_all(text, F.lit(FENCE), F.lit(1)).alias("tag"), F.regexp_extract_all(text, F.lit(FENCE), F.lit(2)).alias("body"))


def extract_code(c: Column, policy: str = "extract") -> Column:
    """Code of an answer.

    extract: body of the first block tagged as Python, else of the first without a tag, else, where
    all blocks have other tags, null; a text without blocks as it stands. strip: bodies of all blocks,
    joined. keep: the text. All trimmed; null for blank texts.
    """
    text = unix_lines(c)
    blocks = fences(c)
    if policy == "keep":
        out = text
    elif policy == "strip":
        out = F.when(F.size(blocks) == 0, text).otherwise(F.array_join(blocks["body"], "\n"))
    else:
        chosen = F.coalesce(
            F.try_element_at(F.filter(blocks, lambda b: F.startswith(F.lower(b["tag"]), F.lit("py"))), F.lit(1)),
            F.try_element_at(F.filter(blocks, lambda b: b["tag"] == ""), F.lit(1)),
        )
        out = F.when(F.size(blocks) == 0, text).otherwise(chosen["body"])
    return F.when(~blank(c), strip(out))


def simple_fence(c: Column) -> Column:
    """Body of the first Python or untagged block, else the text; without line feeds at the ends."""
    body = F.regexp_extract(c, r"```(?:python|py)?[ \t]*\r?\n((?s:.*?))```", 1)
    has = c.rlike(r"```(?:python|py)?[ \t]*\r?\n(?s:.*?)```")
    return F.btrim(F.replace(F.when(has, body).otherwise(F.coalesce(c, F.lit(""))), F.lit("\r\n"), F.lit("\n")), F.lit("\n"))


def defined_names(c: Column) -> Column:
    """Names of the functions and classes that the code defines."""
    return F.regexp_extract_all(c, F.lit(DEFINITION), F.lit(1))


def entry_name(c: Column) -> Column:
    """First function or class that the code defines, else null."""
    return F.nullif(F.regexp_extract(c, DEFINITION, 1), F.lit(""))


def root_modules(c: Column) -> Column:
    """Root modules that the code imports."""
    plain = F.array_union(F.regexp_extract_all(c, F.lit(IMPORT), F.lit(1)), F.regexp_extract_all(c, F.lit(IMPORT), F.lit(2)))
    return F.array_distinct(F.filter(F.transform(plain, lambda m: F.split_part(m, F.lit("."), F.lit(1))), lambda m: m != ""))


def clean_tests(c: Column) -> Column:
    """Tests trimmed, without nulls and blanks; null gives the empty array."""
    trimmed = F.transform(c, lambda t: strip(F.replace(t, F.lit("\r\n"), F.lit("\n"))))
    return F.coalesce(F.filter(trimmed, lambda t: t.isNotNull() & (t != "")), F.array().cast("array<string>"))


def parse_tests(c: Column) -> Column:
    """Tests from JSON: an array of strings, or a single string."""
    many = F.from_json(c, "array<string>")
    one = F.from_json(F.concat(F.lit("["), c, F.lit("]")), "array<string>")
    return clean_tests(F.when(F.startswith(F.ltrim(c), F.lit("[")), many).otherwise(F.when(F.startswith(F.ltrim(c), F.lit('"')), one)))


def all_passed(c: Column) -> Column:
    """Whether a status, a word or a JSON array of words, says that every test passed."""
    good = ["pass", "passed", "true", "1"]
    many = F.from_json(c, "array<string>")
    word = F.lower(strip(F.btrim(strip(c), F.lit('"')))).isin(good)
    array = (F.size(many) > 0) & F.forall(many, lambda x: F.coalesce(F.lower(strip(x)).isin(good), F.lit(False)))
    return F.coalesce(F.when(F.startswith(F.ltrim(c), F.lit("[")), array).otherwise(word), F.lit(False))


def calls(entry: Column, tests: Column) -> Column:
    """Whether any test calls the entry function."""
    pattern = F.concat(F.lit(r"\b\Q"), entry, F.lit(r"\E\s*\("))
    return F.coalesce(F.exists(tests, lambda t: F.rlike(t, pattern)), F.lit(False))


def unstable(c: Column) -> Column:
    """Whether the code draws on chance or the clock without a seed."""
    return c.rlike(UNSTABLE) & ~c.rlike(SEED)


def let(value: Column, body) -> Column:  # noqa: ANN001
    """``body(value)`` with the value computed once: an expression inside a lambda would be computed for each element."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _measure(c: Column, body) -> Column:  # noqa: ANN001
    """``body`` of the code lines, the same stripped, their number, and the numbers of all lines and of comments."""

    def inner(rows: Column) -> Column:
        kept = F.filter(rows, lambda r: (r["b"] != "") & ~F.startswith(r["b"], F.lit("#")))
        comments = F.size(F.filter(rows, lambda r: F.startswith(r["b"], F.lit("#"))))
        return let(
            F.struct(kept.alias("kept"), F.size(kept).alias("n"), F.size(rows).alias("total"), comments.alias("comments")),
            lambda m: let(F.struct(m["kept"]["l"].alias("code"), m["kept"]["b"].alias("bare")), lambda k: body(k["code"], k["bare"], m["n"], m["total"], m["comments"])),
        )

    stripped = F.transform(lines(c), lambda x: F.struct(x.alias("l"), strip(x).alias("b")))
    return F.when(c.isNotNull(), let(stripped, inner))


def _count(bare: Column, *heads: str) -> Column:
    def check(x: Column) -> Column:
        found = F.lit(False)
        for head in heads:
            found = found | F.startswith(x, F.lit(head))
        return found

    return F.size(F.filter(bare, check))


def _repeated(bare: Column, n: Column) -> Column:
    """Whether four lines in a row are equal."""
    return F.exists(
        F.sequence(F.lit(4), F.greatest(n, F.lit(4))),
        lambda i: (i <= n) & (F.try_element_at(bare, i) == F.try_element_at(bare, i - 1)) & (F.try_element_at(bare, i) == F.try_element_at(bare, i - 2)) & (F.try_element_at(bare, i) == F.try_element_at(bare, i - 3)),
    )


def _any_of(x: Column, literals: list[str]) -> Column:
    found = F.lit(False)
    for literal in literals:
        found = found | F.contains(x, F.lit(literal))
    return found


def quality_reason(c: Column) -> Column:
    """First quality rule that a source file breaks, else null."""

    def judge(code: Column, bare: Column, n: Column, total: Column, comments: Column) -> Column:
        bodiless = F.exists(
            F.sequence(F.lit(1), F.greatest(n, F.lit(1))),
            lambda i: F.startswith(F.try_element_at(bare, i), F.lit("def "))
            & ~F.contains(F.try_element_at(code, i), F.lit("raise NotImplementedError"))
            & ~F.exists(F.slice(bare, i + 1, F.lit(4)), lambda b: (b != "pass") & ~F.startswith(b, F.lit('"""'))),
        )
        logic = F.size(F.filter(code, lambda x: _any_of(x, LOGIC)))
        width = F.aggregate(code, F.lit(0), lambda a, x: a + F.length(x))
        return (
            F.when(total < 2, "L5_too_few_lines").when(n < 2, "L5_effective_lines").when(_count(bare, "import ", "from ") > 0.6 * n, "L5_import_ratio")
            .when(_count(bare, "class ", "@") > 0.7 * n, "L5_class_ratio").when(comments > 0.8 * total, "L5_comment_ratio").when(bodiless, "L5_def_without_body")
            .when((_count(bare, "def ") == 0) & (logic < 2), "L5_no_def_no_logic").when(_repeated(bare, n), "L5_repeated_lines").when(width < 8 * n, "L5_short_lines")
        )

    return _measure(c, judge)


def body_reason(c: Column) -> Column:
    """First quality rule that a function body breaks, else null."""

    def judge(code: Column, bare: Column, n: Column, total: Column, comments: Column) -> Column:
        return (
            F.when(total < 2, "L5_too_few_lines").when(n < 2, "L5_effective_lines").when(_count(bare, "import ", "from ") > 0.6 * n, "L5_import_ratio")
            .when(_count(bare, "class ", "@") > 0.7 * n, "L5_class_ratio").when(comments > 0.8 * total, "L5_comment_ratio").when(_repeated(bare, n), "L5_repeated_lines")
            .when(~F.exists(code, lambda x: _any_of(x, PAIR_LOGIC)), "L5_no_logic")
        )

    return _measure(c, judge)


# Arrow UDFs


# White space within a line, and a line's end.
_GAP = r"[^\S\n]*"
#: A line that is no code: blank, a comment, or a docstring up to the end of its last line.
_SOFT = re.compile(rf"{_GAP}(?:#[^\n]*|(?P<q>\"\"\"|''')(?s:.*?)(?P=q)[^\n]*)?(?:\n|\Z)")
_SHEBANG = re.compile(rf"(?m)^{_GAP}#!")
#: A comment line with the comments and blank lines that follow it.
_BLOCK = re.compile(rf"(?m)^{_GAP}#[^\n]*(?:\n{_GAP}(?:#[^\n]*)?$)*\n?")
_NEXT_COMMENT = re.compile(rf"\n{_GAP}#{_GAP}")
_BLANK_RUN = re.compile(rf"(?m)(^{_GAP}\n)(?:{_GAP}\n)+")


def _licence(block: str) -> bool:
    """Whether a licence word stands in the block, comments that follow each other read as one line."""
    words = _NEXT_COMMENT.sub(" ", block.lower())
    return any(word in words for word in LICENCE_WORDS)


def strip_header_text(text: str) -> str:
    """Trimmed, and without the lines above the code if they hold a licence or a shebang; then unchanged if no code follows or a docstring stays open."""
    end = 0
    while end < len(text) and (soft := _SOFT.match(text, end)):
        end = soft.end()
    top, rest = text[:end], text[end:].strip()
    if not (_SHEBANG.search(top) or _licence(top)):
        return text.strip() or text
    return text if not rest or rest.startswith(('"""', "'''")) else rest


def strip_copyright_text(text: str) -> str:
    """Without licence headers and licence comment blocks anywhere; blank runs shrink only where something went."""
    text = strip_header_text(text)
    spots = [block.span() for block in _BLOCK.finditer(text) if _licence(block.group())]
    if not spots:
        return text
    ends = [0, *(end for _, end in spots)]
    kept = "".join(text[a:b] for a, b in zip(ends, [*(start for start, _ in spots), len(text)], strict=True))
    return _BLANK_RUN.sub(r"\1", kept).strip() or text


def _mapped(function, kind=T.StringType()):  # noqa: ANN001, ANN202, B008
    @F.pandas_udf(kind)
    def mapped(column: pd.Series) -> pd.Series:
        return column.map(lambda x: None if x is None else function(x))

    return mapped


def strip_header(c: Column) -> Column:
    return _mapped(strip_header_text)(c)


def strip_copyright(c: Column) -> Column:
    """Licence scrub. Texts without a shebang or licence word, which may go on over comment lines, are only trimmed and never reach Python."""
    words = "|".join(r"[\s#]+".join(re.escape(part) for part in w.split(" ")) for w in LICENCE_WORDS)
    touched = F.contains(c, F.lit("#!")) | F.lower(c).rlike(words)
    return F.when(touched, _mapped(strip_copyright_text)(F.when(touched, c))).otherwise(F.when(blank(c), c).otherwise(strip(c)))


def normalize_code_text(text: str) -> str:
    """Dedented, lines trimmed on the right, no blank lines at the ends."""
    import textwrap

    rows = [r.rstrip() for r in textwrap.dedent(text).replace("\r\n", "\n").replace("\r", "\n").split("\n")]
    filled = [k for k, r in enumerate(rows) if r]
    return "\n".join(rows[filled[0] : filled[-1] + 1]) if filled else ""


def normalize_code(c: Column) -> Column:
    return _mapped(normalize_code_text)(c)


def expand_tabs(c: Column, width: int = 4) -> Column:
    return _mapped(lambda x: x.expandtabs(width))(c)


def compiles_text(text: str) -> bool:
    """Whether the text is Python; it is parsed, never run."""
    import ast
    import warnings

    try:
        with warnings.catch_warnings():
            warnings.simplefilter("ignore")
            ast.parse(text)
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        return False
    return True


def compiles(c: Column) -> Column:
    return _mapped(compiles_text, T.BooleanType())(c)


def blake2b8(c: Column) -> Column:
    """First 8 bytes of the BLAKE2b digest, as a binary."""
    import hashlib

    return _mapped(lambda x: hashlib.blake2b(x.encode("utf-8", "replace"), digest_size=8).digest(), T.BinaryType())(c)


def blake2b_bucket(c: Column, buckets: int = 10_000) -> Column:
    """The 8-byte digest as an unsigned big-endian number, modulo ``buckets``."""
    import hashlib

    return _mapped(lambda x: int.from_bytes(hashlib.blake2b(x.encode("utf-8", "replace"), digest_size=8).digest(), "big") % buckets, T.LongType())(c)


def function_pairs_text(text: str, methods: bool = False, docstring: str = "strip") -> list[dict[str, str]]:
    """(prompt, solution) of each function whose signature is one line with the body on the next.

    The prompt ends in the body's first indent, so the solution's further lines are indented by four.
    """
    import ast
    import textwrap
    import warnings

    try:
        with warnings.catch_warnings():
            warnings.simplefilter("ignore")
            tree = ast.parse(text)
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        return []
    rows = text.split("\n")
    todo, out = list(tree.body), []
    while todo:
        node = todo.pop(0)
        if methods and isinstance(node, ast.ClassDef):
            todo = list(node.body) + todo
        if not isinstance(node, ast.FunctionDef | ast.AsyncFunctionDef) or node.lineno > len(rows):
            continue
        first = node.body[0]
        signature = rows[node.lineno - 1].rstrip()
        if not signature.endswith(":"):
            signature = signature.split("#")[0].rstrip()
        if first.lineno != node.lineno + 1 or not signature.endswith(":") or not re.match(r"(?:async\s+def|def)\s", signature.strip()):
            continue
        start = first.lineno
        if isinstance(first, ast.Expr) and isinstance(first.value, ast.Constant) and isinstance(first.value.value, str):
            if docstring == "reject" or len(node.body) < 2:
                continue
            start = node.body[1].lineno
        body = textwrap.dedent("\n".join(rows[start - 1 : node.end_lineno])).split("\n")
        solution = "\n".join([body[0].rstrip(), *("    " + r.rstrip() if r.strip() else "" for r in body[1:])]).rstrip()
        if solution.strip():
            out.append({"prompt": signature.strip() + "\n    ", "solution": solution})
    return out


def function_pairs(c: Column, methods: bool = False, docstring: str = "strip") -> Column:
    kind = T.ArrayType(T.StructType([T.StructField("prompt", T.StringType()), T.StructField("solution", T.StringType())]))
    return _mapped(lambda x: function_pairs_text(x, methods, docstring), kind)(c)


def function_body_text(text: str) -> str:
    """From the first line that begins a function to before the first line of code that isn't indented; '' without one."""
    rows = text.split("\n")
    start = next((k for k, r in enumerate(rows) if r.strip().startswith("def ")), None)
    if start is None:
        return ""
    kept = [rows[start]]
    for row in rows[start + 1 :]:
        indented, bare = row[:1] in (" ", "\t"), row.strip()
        if bare and not bare.startswith("#") and not indented:
            break
        if indented:
            kept.append(row)
    while kept and not kept[-1].strip():
        kept.pop()
    return "\n".join(kept)


def function_body(c: Column) -> Column:
    return _mapped(function_body_text)(c)


def lenient_test_text(test: str, number: int = 0) -> str:
    """A test ``f(args) == expected`` that also accepts a single list argument changed in place."""
    import ast

    match = re.match(r"^([A-Za-z_]\w*)\((.*)\)\s*==\s*(.+)$", test.strip(), re.S)
    if not match:
        return f"assert {test}"
    name, arguments, expected = match.groups()
    try:
        values = ast.literal_eval(f"({arguments},)")
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        values = ()
    condition = f"(_R{number} == {expected})"
    if len(values) == 1 and isinstance(values[0], list):
        condition += f" or (_A{number}[0] == {expected})"
    return f"_A{number} = ({arguments},)\n_R{number} = {name}(*_A{number})\nassert {condition}"


def lenient_test(c: Column) -> Column:
    return _mapped(lenient_test_text)(c)


def mutants(code: Column, entry: Column) -> Column:
    """Four wrong variants of a solution, as (kind, code): broken syntax, renamed entry, wrong result, endless loop."""
    header = F.concat(F.lit(r"(?ms)\A(.*?^[ \t]*(?:async[ \t]+)?(?:def|class)[ \t]+)\Q"), entry, F.lit(r"\E\b"))
    renamed = F.when(F.rlike(code, header), F.regexp_replace(code, header, F.concat(F.lit("$1"), entry, F.lit("_RENAMED")))).otherwise(F.concat(code, F.lit("\n\n"), entry, F.lit("()\n")))
    override = F.concat(code, F.lit("\n\ndef "), entry, F.lit("(*args, **kwargs):\n"))
    return F.array(
        F.struct(F.lit("syntax_error").alias("kind"), F.concat(code, F.lit("\n\nthis is not valid python !!!(\n")).alias("code")),
        F.struct(F.lit("wrong_name").alias("kind"), renamed.alias("code")),
        F.struct(F.lit("wrong_return").alias("kind"), F.concat(override, F.lit("    return '__WRONG_RETURN__'\n")).alias("code")),
        F.struct(F.lit("infinite_loop").alias("kind"), F.concat(override, F.lit("    while True:\n        pass\n")).alias("code")),
    )


def implementation_reason(code: Column, banned: list[str], required: list[str]) -> Column:
    """BANNED or MISSING with the pattern that the code breaks, else null; ``a|b`` asks for one of them."""
    low = F.lower(code)
    breaks = [F.when(F.contains(low, F.lit(p.lower())), F.lit(f"BANNED {p}")) for p in banned]
    for p in required:
        held = F.lit(False)
        for option in p.split("|"):
            held = held | F.contains(low, F.lit(option))
        breaks.append(F.when(~held, F.lit(f"MISSING {p}")))
    return F.coalesce(*breaks) if breaks else F.lit(None).cast("string")


def failure_bucket(reason: Column) -> Column:
    """Coarse kind of a verdict's reason."""
    return (
        F.when(reason.isNull(), "other").when(F.startswith(reason, F.lit("PASS")), "PASS").when(F.startswith(reason, F.lit("MISSING")), "MISSING")
        .when(F.startswith(reason, F.lit("BANNED")), "BANNED").when(F.lower(reason).rlike("no function|no_fn|nameerror"), "no_fn").when(F.lower(reason).rlike("error|timeout|exec"), "exec").otherwise("other")
    )
