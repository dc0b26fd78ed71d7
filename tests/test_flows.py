"""Whole flows on small tables."""

from pyspark.sql import functions as F

from weftline.operators import flows
from weftline.plans.packs import point_ids

CODE = "import os\n\n\ndef area(width, height):\n    result = width * height\n    if result < 0:\n        raise ValueError(width)\n    return result\n"


def test_corpus(spark):
    rows = [(1, "a.py", CODE), (2, "a.js", CODE), (3, "b.py", "# Copyright me\n" + CODE), (4, "c.py", None), (5, None, CODE), (6, "d.py", "x = 1"), (7, "e.py", "<reponame>a/b\n" + CODE)]
    df = spark.createDataFrame(rows, "k long, path string, text string")
    got = {r.k: r.clean for r in flows.build_corpus(df).collect()}
    assert set(got) == {1, 3, 7} and got[3] == CODE.strip()
    plain = {r.k: r.clean for r in flows.build_corpus(df, filters=False).collect()}
    assert set(plain) == {1, 3, 7} and plain[7] == CODE
    assert flows.build_corpus(df.where("false")).collect() == []


def test_signature_pairs(spark):
    other = CODE.replace("area", "volume").replace("width", "depth")
    many = [(10 + k, CODE.replace("< 0", f"< {k}")) for k in range(8)]
    df = spark.createDataFrame([(1, CODE), (2, CODE), (3, other), (4, None), (5, "x = 1"), *many], "doc long, text string")
    got = flows.build_signature_pairs(df, "doc", ratio=0.0).collect()
    assert {r.doc for r in got} == {1, 3, 11, 12, 13, 14}  # document 10 equals 1; five of its template at most
    assert all(r.prompt.startswith("def ") and r.solution.startswith("result = ") and r.split == "train" for r in got)


def test_instruction_pairs_to_checked_chunks(spark):
    fenced = "Here:\n```python\n" + CODE + "```\n"
    rows = [(1, "Area?", fenced), (2, "Area?", CODE + "# 2\n"), (3, " ", CODE), (4, "None", None), (5, "Broken", "def f(:\n  return 1\n  x = 2\n" + " " * 40), (6, "Java", "```java\nint x;\n```"), (7, "Other", CODE.replace("area", "size").replace("result", "out"))]
    df = spark.createDataFrame(rows, "at long, prompt string, solution string")
    pairs = flows.build_instruction_pairs(df, "at", ratio=0.0)
    got = {r["at"]: r for r in pairs.collect()}
    assert set(got) == {1, 7} and got[1].solution == CODE.strip() and got[1].prompt == "### Task\nArea?\n\n### Code\n"
    packed = flows.pack_pairs(pairs, "at", point_ids, 16)
    total = sum(len(r.prompt) + len(r.solution) + 1 for r in got.values())
    checks = {(r.split, r.check): r.n for r in flows.verify_pack(packed, 16, 5000).collect()}
    assert checks["train", "chunks"] == total // 16 and checks["train", "tokens"] == total // 16 * 16
    assert not [c for _, c in checks if c.startswith("fault_") and c != "fault_no_loss"]
    broken = packed.withColumn("ids", F.transform("ids", lambda i: i + 5000))
    assert ("train", "fault_vocabulary") in {(r.split, r.check) for r in flows.verify_pack(broken, 16, 5000).collect()}
