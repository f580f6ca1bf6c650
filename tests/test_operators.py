from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from corvid.operators import conversations, index, metrics, nearest, ranking, statistics


def test_require_all_and_remap(spark):
    d = spark.createDataFrame([(1, 5), (2, 1)], "id long, base long")
    assert index.require_all(d, d, "id") is d
    with pytest.raises(ValueError):
        index.require_all(d, d.where("id = 1"), "id")
    m = spark.createDataFrame([(1, 10)], "old long, new long")
    assert sorted(map(tuple, index.remap(d, "base", m, "old", "new").select("id", "base").collect())) == [(1, -1), (2, 10)]


def test_keep_first_keeps_whole_rows(spark):
    d = spark.createDataFrame([(3, "a", None), (1, "a", "x"), (2, None, "y"), (4, None, "z")], "id long, k string, v string")
    assert sorted(map(tuple, index.keep_first(d, ["k"], ["id"]).collect()), key=str) == [(1, "a", "x"), (2, None, "y")]


def test_splits_are_disjoint_and_complete(spark):
    d = spark.range(1000).select(F.col("id").alias("doc"), F.when(F.col("id") < 15, "small").when(F.col("id") % 3 == 0, None).otherwise("big").alias("s"))
    got = ranking.stratified_split(d, "s", "doc").collect()
    assert sorted(r.doc for r in got) == list(range(1000))
    for s, n in Counter(r.s for r in got).items():
        c = Counter(r.split for r in got if r.s == s)
        assert c["val"] == c["test"] == int(n * 0.05)


def test_bucketed_rank_is_a_row_number(spark):
    d = spark.range(500).select("id", (F.col("id") % 2).alias("g"))
    r = ranking.bucketed_rank(d, ["g"], "id").collect()
    assert all(sorted(x["rank"] for x in r if x.g == g) == list(range(1, 251)) for g in (0, 1))


def test_quotas_and_overshoot(spark):
    assert ranking.quotas(100, ["1", "2", "3+"]) == {"1": 34, "2": 33, "3+": 33}
    d = spark.createDataFrame([("f", i, w) for i, w in enumerate([3, 4, 5, 6])], "f string, i int, w int")
    assert sorted(r.i for r in ranking.quota_prefix(d, "f", "i", "w", 7).collect()) == [0, 1]
    assert sorted(r.i for r in ranking.quota_prefix(d, "f", "i", "w", 8).collect()) == [0, 1, 2]


def test_rotation_has_no_fixed_point(spark):
    d = spark.createDataFrame([(1, "a"), (2, "a"), (3, "b"), (4, "a"), (9, "c")], "id long, g string")
    got = {r.id: r.effective for r in ranking.rotate(d, "g", "id").collect()}
    assert got == {1: 2, 2: 4, 4: 1, 3: 4, 9: 1}


def test_turns(spark):
    d = spark.createDataFrame([(1, 0, "system", "s"), (1, 1, "user", "q"), (1, 2, "assistant", "a"), (1, 3, "assistant", "b")], "conv_id long, turn long, role string, text string")
    t = conversations.turn_types(conversations.assistant_turns(d).withColumn("types", F.array(F.lit("A2"))), "types")
    assert [(r.turn, r.question, r.n_history, r.ordinal, r.turn_type) for r in t.orderBy("turn").collect()] == [(2, "q", 2, 0, "A2"), (3, "q", 3, 1, "")]


def test_dose_tiers(spark):
    rows = [("s", i, float(i)) for i in range(4)] + [("n", i, [0.0, 1.0, 2.0, 3.0, 5.0, 4.0, 6.0, 7.0][i]) for i in range(8)] + [("p", i, float(-i)) for i in range(3)] + [("c", i, 1.0) for i in range(3)] + [("few", i, float(i)) for i in range(2)]
    got = {r.g: (r.tier, r.rho) for r in statistics.dose_response(spark.createDataFrame(rows, "g string, x int, y double"), "g", "x", "y").collect()}
    assert {k: v[0] for k, v in got.items()} == {"s": "strict", "n": "near", "p": "partial", "c": "partial"}
    assert got["p"][1] == -1.0 and got["c"][1] == 0.0


def test_nearest_over_many_blocks(spark):
    rng = np.random.default_rng(3)
    m = rng.normal(size=(60, 5))
    m[7] = m[3]
    d = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(m)] + [(99, None)], "id long, v array<double>").repartition(4)
    got = {r.id: r.nn_id for r in nearest.nearest(d, d, "id", "v", pivots=3, ring=4).collect()}
    far = ((m[:, None] - m[None]) ** 2).sum(axis=2)
    np.fill_diagonal(far, np.inf)
    assert got == {i: int(far[i].argmin()) for i in range(60)}


def test_scores(spark):
    d = spark.createDataFrame([("x", ["a", "b"], ["b", "c"]), ("x", [], []), ("y", ["a"], ["a"]), ("z", [], [])], "k string, g array<string>, p array<string>")
    s = metrics.set_scores(d, F.col("g"), F.col("p"), ["k"])
    assert {r.k: (r.tp, r.fp, r.fn, r.f1) for r in s.collect()} == {"x": (1, 1, 1, 0.5), "y": (1, 0, 0, 1.0), "z": (0, 0, 0, 0.0)}
    m = {r.k: r.f1 for r in metrics.macro_micro(s, "k").collect()}
    assert m["macro"] == 0.75 and m["z"] is None and m["micro"] == pytest.approx(0.666667)
    none = metrics.abstention(d, F.lit(False), F.col("k") == "x").first()
    assert none.f1 is None and none.over_abstain == 0.5


def test_greedy_tolerance_takes_the_nearest_once(spark):
    rows = [(1, [1.0, 1.01], [1.005]), (2, [100.0], [101.0, 99.5]), (3, [0.0], [0.02]), (4, None, [1.0])]
    got = {r.k: (r.tp, r.fp, r.fn) for r in metrics.greedy_tolerance(spark.createDataFrame(rows, "k long, g array<double>, p array<double>"), "k", "g", "p").collect()}
    assert got == {1: (1, 0, 1), 2: (1, 1, 0), 3: (0, 1, 1), 4: (0, 1, 0)}


def test_paired_tests(spark):
    rows = [(True, False)] * 8 + [(False, True)] * 2 + [(True, True)] * 5
    d = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i long, a boolean, b boolean")
    r = metrics.mcnemar(d, F.col("a"), F.col("b")).first()
    assert (r.a_only, r.b_only, r.p_value) == (8, 2, 0.109375)
    b = metrics.paired_bootstrap(d, F.col("a").cast("int"), F.col("b").cast("int"), "i", 2000).first()
    assert b.difference == pytest.approx(0.4) and b.low < 0.4 < b.high
    assert metrics.mcnemar(d.limit(0), F.col("a"), F.col("b")).first().p_value == 1.0
    assert metrics.paired_bootstrap(d.limit(0), F.col("a").cast("int"), F.col("b").cast("int"), "i", 50).count() == 0


def test_weighted_mean_and_best(spark):
    d = spark.createDataFrame([(1, 2.0, 1.0), (2, 4.0, 3.0)], "s int, x double, w double")
    assert metrics.weighted_mean(d, "x", "w").first().mean == 3.5
    assert metrics.weighted_mean(d.where("s > 5"), "x", "w").first().mean == 0.0
    b = spark.createDataFrame([("r", 1, 0.5), ("r", 2, 0.5), ("r", 3, 0.7)], "g string, s int, m double")
    assert [r.improved for r in metrics.running_best(b, "g", "s", "m").orderBy("s").collect()] == [True, False, True]
