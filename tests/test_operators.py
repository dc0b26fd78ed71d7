import random

import pytest
from pyspark.sql import functions as F

from weftline.operators import dedup, evals, funnel, joins, order, packs, splits


@pytest.mark.parametrize("partitions", [1, 4, 13])
def test_running_total_is_the_same_for_any_layout(spark, partitions):
    rows = [(k, (k * 7) % 5) for k in range(200)]
    df = spark.createDataFrame(rows, "at long, n int").repartition(partitions)
    got = {r["at"]: r.before for r in order.running_total(df, ["at"], "n").collect()}
    total = 0
    for at, n in rows:
        assert got[at] == total
        total += n


def test_running_total_of_nothing_and_nulls(spark):
    assert order.running_total(spark.createDataFrame([], "at long, n int"), ["at"], "n").collect() == []
    got = order.running_total(spark.createDataFrame([(1, None), (2, 3), (3, 1)], "at long, n int"), ["at"], "n").collect()
    assert sorted((r["at"], r.before) for r in got) == [(1, 0), (2, 0), (3, 3)]


def test_first_by_keeps_null_keys_and_columns(spark):
    df = spark.createDataFrame([(None, 2, "b"), (None, 1, "a"), ("k", 5, None)], "key string, at int, v string")
    assert sorted(map(tuple, order.first_by(df, ["key"], ["at"]).collect()), key=str) == [("k", 5, None), (None, 1, "a")]


def test_quota_keeps_the_row_that_crosses(spark):
    df = spark.createDataFrame([("s", k, 40) for k in range(5)], "source string, at int, n int")
    assert sorted(r["at"] for r in order.quota(df, "source", ["at"], F.col("n"), 100).collect()) == [0, 1, 2]
    assert order.quota(df, "source", ["at"], F.col("n"), 0).count() == 5


def test_quota_by_unit(spark):
    df = spark.createDataFrame([("s", 0, 1, 60), ("s", 1, 2, 60), ("s", 1, 3, 60), ("s", 2, 4, 60)], "source string, doc int, at int, n int")
    assert sorted(r["at"] for r in order.quota(df, "source", ["at"], F.col("n"), 100, ["doc"]).collect()) == [1, 2, 3]


def test_skewed_groups_equal_brute_force(spark):
    """One source holds 95 % of the rows; names clash with those inside."""
    r = random.Random(4)
    rows = [("big" if r.random() < 0.95 else r.choice(["a", "b", None]), k, r.randrange(1, 50), k % 7, k) for k in range(2000)]
    df = spark.createDataFrame(rows, "source string, at long, n int, _part int, before int").repartition(5)
    total, place, want, every = {}, {}, set(), set()
    size = {}
    for source, *_ in rows:
        size[source] = size.get(source, 0) + 1
    for source, k, n, *_ in rows:
        if total.get(source, 0) < 900:
            want.add(k)
        if place.get(source, 0) % max(1, size[source] // 40) == 0:
            every.add(k)
        total[source] = total.get(source, 0) + n
        place[source] = place.get(source, 0) + 1
    assert {x["at"] for x in order.quota(df, "source", ["at"], F.col("n"), 900).collect()} == want
    assert {x["at"] for x in order.every_nth(df, "source", ["at"], 40).collect()} == every
    assert order.quota(df.where("false"), "source", ["at"], F.col("n"), 900).collect() == []


def test_groups_beyond_the_broadcast_bound(spark, monkeypatch):
    monkeypatch.setattr(order, "MOST_GROUPS", 1)
    df = spark.createDataFrame([("a", 1), ("a", 2), ("b", 1), (None, 1), (None, 2)], "g string, at int")
    got = {(x.g, x["at"], x.k, x.k_all) for x in order.within_groups(df, "g", ["at"], F.lit(1), "k").collect()}
    assert got == {("a", 1, 0, 2), ("a", 2, 1, 2), ("b", 1, 0, 1), (None, 1, 0, 2), (None, 2, 1, 2)}


def test_even_pick_and_systematic(spark):
    df = spark.range(10).withColumnRenamed("id", "k").withColumn("g", F.lit("x"))
    assert sorted(r.k for r in order.even_pick(df, ["k"], 4).collect()) == [0, 3, 6, 9]
    assert sorted(r.k for r in order.every_nth(df, "g", ["k"], 4).collect()) == [0, 2, 4, 6, 8]
    assert order.hashed_sample(df, "k", 3).count() == 3


def sequential(rows, most=5):
    texts, prompts, kinds, out = set(), set(), {}, []
    for at, text, prompt, kind in rows:
        if text in texts or prompt in prompts or kinds.get(kind, 0) >= most:
            continue
        texts.add(text)
        prompts.add(prompt)
        kinds[kind] = kinds.get(kind, 0) + 1
        out.append(at)
    return out


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_coupled_dedup_is_the_single_pass(spark, seed):
    r = random.Random(seed)
    rows = [(k, f"t{r.randrange(40)}", f"p{r.randrange(30)}", f"k{r.randrange(5)}") for k in range(90)]
    df = spark.createDataFrame(rows, "at long, text string, prompt string, kind string")
    got = dedup.coupled(df, F.col("text"), F.col("prompt"), F.col("kind"), "at", 3)
    assert sorted(x["at"] for x in got.collect()) == sequential(rows, 3)


def test_coupled_dedup_lets_a_later_row_in(spark):
    rows = [(k, f"t{k}", f"p{k}", "same") for k in range(2)] + [(2, "t2", "q", "same"), (3, "t3", "q", "other")]
    df = spark.createDataFrame(rows, "at long, text string, prompt string, kind string")
    got = dedup.coupled(df, F.col("text"), F.col("prompt"), F.col("kind"), "at", 2)
    assert sorted(x["at"] for x in got.collect()) == [0, 1, 3]
    assert dedup.coupled(df.where("false"), F.col("text"), F.col("prompt"), F.col("kind"), "at").count() == 0


def test_exact_and_template(spark):
    df = spark.createDataFrame([(2, "a"), (1, "a"), (3, None), (4, None)] + [(10 + k, f"x = {k}") for k in range(7)], "at int, t string")
    assert sorted(r["at"] for r in dedup.exact(df, F.col("t"), ["at"]).collect()) == [1, 3] + list(range(10, 17))
    assert sorted(r["at"] for r in dedup.template_cap(df.where("at >= 10"), F.col("t"), ["at"]).collect()) == [10, 11, 12, 13, 14]


def test_promote_moves_the_longest(spark):
    df = spark.createDataFrame([(1, 5, "train"), (2, 9, "train"), (3, 9, "train"), (4, 1, "val")], "at int, n int, split string")
    got = splits.promote(df, "n", "at", 10)
    assert {r["at"] for r in got.where("split = 'val'").collect()} == {2, 4}
    with pytest.raises(ValueError):
        splits.promote(df, "n", "at", 100)


def test_funnel_adds_up_and_goes_by_order(spark):
    long = "def f(x):\n    return x + 1\n\n" * 4
    rows = [("a.js", long), ("a/tests/b.py", long), ("a.py", "x" * 49), ("a.py", long + "models.CharField(\nxrange("), ("a.py", long + "xrange("), ("a.py", long + "setup("), ("a.py", long + "def test_x"), ("a.py", "word " * 20), ("a.py", long + " n_1111 n_1111 n_1111"), ("a.py", long), (None, None)]
    df = spark.createDataFrame(rows, "path string, text string")
    got = {r.reason: r.n for r in funnel.counts(funnel.verdicts(df)).collect()}
    assert got == {"non_python": 2, "filename_filtered": 1, "too_short": 1, "L1_framework": 1, "L2_python2": 1, "L3_config": 1, "L4_tests": 1, "L5_quality": 1, "L6_autogen": 1, "accepted": 1}
    assert funnel.verdicts(df.where("false")).count() == 0


def brute_chunks(samples, chunk, policy="mask"):
    ids, mask, off = [], [], 0
    for p, s in samples:
        row, own = [*p, *s, packs.EOS], [0] * len(p) + [1] * (len(s) + 1)
        room = chunk - off % chunk
        if policy == "mask":
            own = [m if i < room else 0 for i, m in enumerate(own)]
        ids, mask, off = ids + row, mask + own, off + len(row)
    return [(ids[k : k + chunk], mask[k : k + chunk]) for k in range(0, len(ids) - chunk + 1, chunk)]


@pytest.mark.parametrize("policy", ["mask", "keep"])
@pytest.mark.parametrize("sizes", [[(2, 4)], [(3, 3), (0, 13), (2, 1)], [(1, 20), (5, 1), (2, 4)], [(3, 3)] * 6, []])
def test_pack(spark, sizes, policy):
    chunk = 7
    samples = [(list(range(10, 10 + p)), list(range(50, 50 + s))) for p, s in sizes]
    df = spark.createDataFrame([(k, p, s) for k, (p, s) in enumerate(samples)], "at long, p array<int>, s array<int>")
    laid = df.select("at", F.inline(F.array(packs.sample(F.col("p"), F.col("s")))))
    got = [(r.ids, r.mask) for r in packs.pack(laid, ["at"], chunk, policy).orderBy("chunk_id").collect()]
    assert got == brute_chunks(samples, chunk, policy)


def test_overlapping_chunks(spark):
    df = spark.createDataFrame([(0, list(range(10)), [1] * 10), (1, list(range(10, 23)), [1] * 13)], "at long, ids array<int>, mask array<int>")
    got = [r.ids for r in packs.chunks(packs.with_offsets(df, ["at"]), 5, 4).orderBy("chunk_id").collect()]
    assert got == [list(range(k, k + 5)) for k in range(0, 19, 4)]


def stream(spark, numbers):
    return spark.createDataFrame([(k, [v, v], [1, 0]) for k, v in enumerate(numbers)], "chunk_id long, ids array<int>, mask array<int>")


def test_mix_replay_epochs(spark):
    a, b = stream(spark, [1, 2, 3, 4, 5]), stream(spark, [11, 12, 13])
    firsts = lambda df: [r.ids[0] for r in df.orderBy("chunk_id").collect()]
    assert firsts(packs.mix([a, b])) == [1, 2, 3, 4, 5, 11, 12, 13]
    assert firsts(packs.mix([a, b], 2, "interleave")) == [1, 2, 11, 12, 3, 4, 13, 5]
    assert firsts(packs.replay(a, b, 0.0)) == [1, 2, 3, 4, 5]
    assert set(firsts(packs.replay(a, b, 1.0))) <= {11, 12, 13}
    assert packs.epochs(a, 2, 7).count() == 3


def test_checks_find_faults(spark):
    rows = [(0, [5, 6], [0, 1]), (1, [5, 3], [0, 1]), (2, [5, 99], [1, 1]), (3, [5, 6], [0, 0]), (4, [5], [1]), (5, [5, 6], [0, 2])]
    df = spark.createDataFrame(rows, "chunk_id long, ids array<int>, mask array<int>")
    got = sorted((r.chunk_id, r.fault) for r in packs.chunk_faults(df, 2, 50).collect())
    assert got == [(1, "reserved"), (2, "vocabulary"), (3, "no_loss"), (4, "length"), (5, "mask_value")]
    samples = spark.createDataFrame([(0, [1, 1, 1], [0, 1, 0]), (3, [1, 1, 1], [0, 1, 0]), (0, [1, 1], [1, 0]), (0, [1, 1, 1], [1, 0, 1])], "off long, ids array<int>, mask array<int>")
    assert sorted(r.fault for r in packs.sample_faults(samples, 5).collect()) == ["boundary", "boundary", "shape"]


def test_mask_source():
    assert packs.mask_source(none=True, explicit="x") == "none"
    assert packs.mask_source(max_id=40_000, vocabulary=32_000) == "high_bit"
    with pytest.raises(ValueError):
        packs.mask_source(max_id=10, vocabulary=32_000)


def test_executed_join(spark):
    results = spark.createDataFrame([("a#k1", True), ("a#k1", True), ("b#k0", False), ("c#k0", True), ("d", True), ("e#k0", True), (None, True), ("f#k0", None)], "id string, passed boolean")
    candidates = spark.createDataFrame([("a#k1", 1, "first", 1), ("a#k1", 1, "second", 2), ("c#k0", 0, "", 1), ("d", 0, "code", 1), ("e#k0", 0, "code", 1), (None, 0, "x", 1)], "id string, k_index int, completion string, seed_used int")
    problems = spark.createDataFrame([("a", "p1", "f"), ("a", "p2", "f"), ("c", "p", "f"), ("d", "p", "f"), (None, "p", "f")], "id string, prompt string, entry string")
    got = sorted((str(r.id), r.outcome, r.code, r.instruction) for r in joins.executed(results, candidates, problems).collect())
    assert got == [
        ("None", "skipped_no_candidate", None, None), ("a#k1", "kept", "first", "p2"), ("a#k1", "kept", "first", "p2"), ("b#k0", "skipped_failed", None, None),
        ("c#k0", "skipped_no_candidate", "", "p"), ("d", "kept", "code", "p"), ("e#k0", "skipped_no_problem", "code", None), ("f#k0", "skipped_failed", None, None),
    ]


def test_upsert_and_nearest(spark):
    old = spark.createDataFrame([("a", 1), ("b", 2)], "k string, v int")
    new = spark.createDataFrame([("b", 9, "x")], "k string, v int, extra string")
    assert sorted(map(tuple, joins.upsert(old, new, ["k"]).collect())) == [("a", 1, None), ("b", 9, "x")]
    assert joins.upsert(old.where("false"), new, ["k"]).count() == 1
    left = spark.createDataFrame([(10,), (25,), (100,)], "t long")
    right = spark.createDataFrame([(5, 1.0), (15, 2.0), (33, 3.0)], "t long, loss double")
    assert sorted(map(tuple, joins.nearest(left, right, "t", "loss", 10).collect())) == [(10, 5, 1.0), (25, 33, 3.0)]


def test_evaluation_aggregates(spark):
    df = spark.createDataFrame([("m", "t1", True), ("m", "t1", None), ("m", "t2", False)], "model string, task string, passed boolean")
    tasks = evals.fractions(df, "model", "task")
    assert tasks.head().tasks == {"t1": "1/2", "t2": "0/1"}
    assert tuple(tasks.select(evals.sum_fractions(F.col("tasks")).alias("s")).head().s) == (1, 3)
    bad = spark.createDataFrame([({"a": "x/y", "b": "2/3", "c": None},)], "tasks map<string,string>")
    assert tuple(bad.select(evals.sum_fractions(F.col("tasks")).alias("s")).head().s) == (2, 3)


def test_vectors(spark):
    df = spark.createDataFrame([(1, [1.0, 2.0]), (2, [3.0, 6.0])], "step int, v array<double>")
    assert evals.average_vectors(df, "v").head().v == [2.0, 4.0]
    weighted = evals.step_weights(df, F.col("step") == 1)
    assert evals.average_vectors(weighted, "v", F.col("weight")).head().v == pytest.approx([2.4, 4.8])
    assert evals.step_weights(df, F.lit(False)).agg(F.sum("weight")).head()[0] == pytest.approx(1.0)
    one = df.select(evals.blend(F.col("v"), F.array(F.lit(9.0)), 0.5).alias("v")).head().v
    assert one == [1.0, 2.0]


def test_best_so_far_and_retention(spark):
    df = spark.createDataFrame([("r", 1, None), ("r", 2, 3.0), ("r", 3, 3.0), ("r", 4, 2.0)], "run string, step int, v double")
    assert [r["is_new"] for r in evals.best_so_far(df, "run", ["step"], "v").orderBy("step").collect()] == [False, True, False, True]
    steps = spark.createDataFrame([(k,) for k in range(0, 1100, 50)], "step int")
    assert sorted(r.step for r in evals.retained(steps, "step", 250).collect()) == [0, 250, 500, 550, 600, 650, 700, 750, 800, 850, 900, 950, 1000, 1050]
