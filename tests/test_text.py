import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from weftline.functions import rules, text


def one(spark, value, function, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(function(F.col("x")).alias("y")).head()[0]


@pytest.mark.parametrize("value", ["\u2028a\xa0", "\t x \x1f", " ", "", "a　", "\x85b"])
def test_strip_is_pythons(spark, value):
    assert one(spark, value, text.strip) == value.strip()


@pytest.mark.parametrize(
    ("value", "reason"),
    [
        ("one line", "L5_too_few_lines"),
        ("# a\n# b\nx", "L5_effective_lines"),
        ("import a\nimport b\nimport c\nx = 1", "L5_import_ratio"),
        ("import aaaaaa\nimport bbbbbb\nimport cccccc\nx = 1111111\ny = 2222222", None),  # 0.6 exactly
        ("@a\n@b\nclass C:\n@d", "L5_class_ratio"),
        ("# c\n" * 9 + "x = 1\ny = 2", "L5_comment_ratio"),
        ("# c\n" * 8 + "x = 111111\ny = 222222", None),  # 0.8 exactly
        ("def f():\n    pass\n    pass\n    pass\n    pass\n    return 1", "L5_def_without_body"),
        ("def f():\n    pass\n    pass\n    pass\n    return 1", None),
        ("just prose of\nno code at all", "L5_no_def_no_logic"),
        ("x = 11111\ny = 22222\ny = 22222\ny = 22222\ny = 22222", "L5_repeated_lines"),
        ("x = 11111\ny = 22222\ny = 22222\ny = 22222", None),
        ("x = 1\ny = 2", "L5_short_lines"),
        (None, None),
    ],
)
def test_quality(spark, value, reason):
    assert one(spark, value, text.quality_reason) == reason


def test_rules_go_by_their_order_not_by_place(spark):
    body = "xrange(\nfrom __future__ import x"
    assert one(spark, body, lambda c: rules.first_reason(c, rules.CORPUS_LAYERS["L2"])) == "L2_python2:from __future__ import"
    assert one(spark, None, lambda c: rules.first_reason(c, rules.CORPUS_LAYERS["L1"])) is None


@pytest.mark.parametrize(("times", "found"), [(2, None), (3, r"L6_autogen:\b[a-z]+_\d{4,}\b")])
def test_autogenerated_needs_three(spark, times, found):
    assert one(spark, " ".join(f"name_{1000 + k}" for k in range(times)), rules.autogenerated_reason) == found


@pytest.mark.parametrize(("path", "out"), [("a/b/tests/c.py", True), ("setup.py", True), ("a/setups.py", False), ("x/Tests/y.py", False), ("a/flask_app/b.py", True), (None, None)])
def test_file_names(spark, path, out):
    assert one(spark, path, rules.file_excluded) == out


@pytest.mark.parametrize(
    ("before", "after"),
    [
        ("#!/usr/bin/env python\nx = 1", "x = 1"),
        ('#!/bin/sh\n# Copyright (c) me\n"""doc"""\nx = 1', "x = 1"),
        ('"""never closed\nx = 1', '"""never closed\nx = 1'),
        ("# a note\nx = 1", "# a note\nx = 1"),
        ("# Licensed under X", "# Licensed under X"),
        ("x = 1\n\n# Copyright me\n\n# more\ny = 2", "x = 1\n\ny = 2"),
        ("x = 1\n\n\n# note\ny = 2", "x = 1\n\n\n# note\ny = 2"),
        ('"""All rights\nreserved. All rights reserved"""\n\nx = 1', "x = 1"),
    ],
)
def test_scrub(before, after):
    assert text.strip_copyright_text(before) == after


def test_scrub_leaves_the_others_in_the_jvm(spark):
    rows = spark.createDataFrame([("x = 1",), ("#!/bin/sh\nx = 1",), (None,), ("",)], "x string")
    assert [r[0] for r in rows.select(text.strip_copyright(F.col("x"))).collect()] == ["x = 1", "x = 1", None, ""]


@pytest.mark.parametrize(
    ("value", "code"),
    [
        ("a\n```java\nj\n```\n```python\np = 1\n```", "p = 1"),
        ("```\nq\n```", "q"),
        ("```java\nj\n```", None),
        ("```py\nopen", "open"),
        ("plain\r\ntext", "plain\ntext"),
        ("  ", None),
        (None, None),
    ],
)
def test_extract_code(spark, value, code):
    assert one(spark, value, text.extract_code) == code


def test_metadata_tags(spark):
    chained = "<reponame>a/b<filename>c.py<gh_stars>9\n    x = 1\n"
    assert one(spark, chained, text.strip_meta_lines) == "    x = 1\n"
    assert one(spark, "<reponame>a/b\n<filename>c\nx", text.strip_meta_prefix) == "x"
    assert one(spark, "y\n<reponame>a/b\nx", text.strip_meta_prefix) == "y\n<reponame>a/b\nx"


def test_small_functions(spark):
    assert one(spark, "x\ndef g(): 1\nprint(2)", text.truncate) == "x"
    assert one(spark, "a### Code\nb### Code\nc", text.after_last) == "c"
    assert one(spark, "async def go(x):\n  pass", text.entry_name) == "go"
    assert one(spark, '["pass", "PASSED"]', text.all_passed) is True
    assert one(spark, '["pass", "fail"]', text.all_passed) is False
    assert one(spark, "[]", text.all_passed) is False
    assert one(spark, " ok\xa0", lambda c: text.strip(c)) == "ok"
    assert one(spark, "import random\nrandom.random()", text.unstable) is True
    assert one(spark, "import random\nrandom.seed(1)\nrandom.random()", text.unstable) is False
    assert one(spark, ["a", None, " "], text.clean_tests, "array<string>") == ["a"]
    assert one(spark, "a = 'x1'\nb = 22", text.template_key) == one(spark, 'a = "y"\nb = 7', text.template_key)


def test_calls_quotes_the_name(spark):
    rows = spark.createDataFrame([("f", ["assert f (1)"]), ("f", ["assert ff(1)"]), ("a.b", ["a.b(1)"]), (None, ["f(1)"])], "e string, t array<string>")
    assert [r[0] for r in rows.select(text.calls(F.col("e"), F.col("t"))).collect()] == [True, False, True, False]


def test_function_pairs():
    code = 'def f(x):  # why\n    """doc"""\n    if x:\n        return 1\n    return 2\n\ndef g(): return 1\n\nclass C:\n    def m(self):\n        return 3\n'
    assert text.function_pairs_text(code) == [{"prompt": "def f(x):\n    ", "solution": "if x:\n        return 1\n    return 2"}]
    assert len(text.function_pairs_text(code, methods=True)) == 2
    assert text.function_pairs_text(code, docstring="reject") == []
    assert text.function_pairs_text("def broken(") == []


def test_function_body_and_lenient():
    assert text.function_body_text("junk\ndef f():\n    x\n\n    # c\n    y\nprint(1)") == "def f():\n    x\n    # c\n    y"
    assert text.function_body_text("x = 1") == ""
    assert "_A0[0] == [1]" in text.lenient_test_text("f([2]) == [1]")
    assert "_A0[0]" not in text.lenient_test_text("f(2) == 1")
    assert text.lenient_test_text("f(1)") == "assert f(1)"


def test_mutants(spark):
    rows = spark.createDataFrame([("class A:\n    pass\ndef A(): 1", "A")], "c string, e string")
    kinds = {r["kind"]: r["code"] for r in rows.select(F.inline(text.mutants(F.col("c"), F.col("e")))).collect()}
    assert kinds["wrong_name"] == "class A_RENAMED:\n    pass\ndef A(): 1"
    assert not text.compiles_text(kinds["syntax_error"]) and text.compiles_text(kinds["infinite_loop"])


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="ab#\n \t\"'!", max_size=60))
def test_scrub_never_fails_and_never_empties(value):
    out = text.strip_copyright_text(value)
    assert out.strip() or not value.strip()


def test_blake2b_is_unsigned(spark):
    import hashlib

    values = [str(k) for k in range(50)]
    rows = spark.createDataFrame([(v,) for v in values], "x string").select("x", text.blake2b_bucket(F.col("x")).alias("b")).collect()
    assert all(r.b == int.from_bytes(hashlib.blake2b(r.x.encode(), digest_size=8).digest(), "big") % 10_000 for r in rows)


LICENSED = "# Copyright 2020 Somebody\n# All rights\n# reserved\n"


@pytest.mark.parametrize(
    ("text_in", "want"),
    [
        ("#!/usr/bin/env python\n\nx = 1\n", "x = 1"),
        (LICENSED + '"""\nWhat it does.\n"""\n\nx = 1\n', "x = 1"),
        ('"""What it does."""\nx = 1\n', '"""What it does."""\nx = 1'),
        (LICENSED + '"""\nstays open\nx = 1\n', LICENSED + '"""\nstays open\nx = 1\n'),
        (LICENSED + "\n\n", LICENSED + "\n\n"),
        ("# all rights\n# reserved\nx = 1", "x = 1"),
        ("# all rights\n\n# reserved\nx = 1", "# all rights\n\n# reserved\nx = 1"),
        ("'''mit license''' + y\r\nx = 1\r\n", "x = 1"),
        ("x = 1\n", "x = 1"),
        ("", ""),
        (" \n ", " \n "),
    ],
)
def test_headers(text_in, want):
    assert text.strip_header_text(text_in) == want


@pytest.mark.parametrize(
    ("text_in", "want"),
    [
        ("x = 1\n\n# Copyright me\n\n# and you\n\ny = 2\n", "x = 1\n\ny = 2"),
        ("x = 1\n\n\n\n# Copyright me\n\n\ny = 2\n", "x = 1\n\ny = 2"),
        ("x = 1\n\n\n\ny = 2  # Copyright me\n", "x = 1\n\n\n\ny = 2  # Copyright me"),
        ("x = 1\n# plain\n\n# words\ny = 2\n# MIT License", "x = 1\n# plain\n\n# words\ny = 2"),
        ("# Copyright me\n# and you", "# Copyright me\n# and you"),
    ],
)
def test_licence_blocks(text_in, want):
    assert text.strip_copyright_text(text_in) == want
