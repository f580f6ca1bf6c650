"""Sweep lines, ranks and running sums over bins, and Poisson resamples, against plain computations."""

import math
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corvid.operators import bootstrap as B
from corvid.operators import curves as C
from corvid.operators import prefix as P
from corvid.operators import metrics, statistics

NAN = float("nan")


def test_passed_counts_thresholds_below(spark):
    values = [-1.0, 0.0, 0.1, 0.15, 0.2, 0.9, 1.0, 2.0, NAN, None]
    for grid in ([0.1], [0.0, 0.1, 0.2], [0.0, 0.1, 0.2, 0.5, 0.9]):
        got = [r.p for r in spark.createDataFrame([(v,) for v in values], "v double").select(C.passed(F.col("v"), grid).alias("p")).collect()]
        assert got == [sum(v is not None and not math.isnan(v) and g < v for g in grid) for v in values]
    with pytest.raises(ValueError, match="a threshold"):
        C.accuracy_curve(spark.range(1), F.col("id"), F.lit(True), [])


def heads(n=60, seed=1):
    rng = random.Random(seed)
    rows = []
    for row in ("a", "b"):
        for i in range(n):
            for m in range(4):
                gold = rng.choice([0.0, 0.0, 0.3, 0.7])
                pred = rng.choice([max(0.0, gold + rng.uniform(-0.3, 0.3)), 0.1, 0.2, None if rng.random() < 0.1 else 0.0])
                rows.append((row, i, m, pred, gold))
    return rows


def test_threshold_curves_equal_the_definition(spark):
    grid = [0.5, 0.0, 0.05, 0.1, 0.1, 0.2, 0.8]
    rows = heads() + [("c", 1, 0, 0.4, 0.0), ("c", 1, 1, 0.4, 0.5)]
    got = {(r.row_id, r.threshold): r for r in C.threshold_curves(spark.createDataFrame(rows, "row_id string, index long, muscle long, pred double, gold double"), grid).collect()}
    assert len(got) == 3 * len(set(grid))
    for (row, thr), r in got.items():
        by = defaultdict(list)
        for name, i, _, pred, gold in rows:
            if name == row:
                by[i].append((pred is not None and pred > thr, gold > 1e-4))
        flat = [x for v in by.values() for x in v]
        assert (r.n, r.n_exact) == (len(by), sum(all(p == g for p, g in v) for v in by.values()))
        assert (r.tp, r.fp, r.fn) == (sum(p and g for p, g in flat), sum(p and not g for p, g in flat), sum(g and not p for p, g in flat))
        assert r.pred_n_act == pytest.approx(sum(p for p, _ in flat) / len(by))


def test_best_and_seeds(spark):
    long = spark.createDataFrame(heads(), "row_id string, index long, muscle long, pred double, gold double")
    grid = [0.0, 0.05, 0.1, 0.2, 0.4]
    curve = C.threshold_curves(long, grid)
    best = {r.row_id: (r.threshold, r.em) for r in C.best_of(curve, ["row_id"]).collect()}
    every = defaultdict(list)
    for r in curve.collect():
        every[r.row_id].append((-r.em, r.threshold))
    assert best == {k: (min(v)[1], -min(v)[0]) for k, v in every.items()}
    rows = C.seed_sweep(long, {"test": long}, grid, [0, 7], 20).collect()
    assert Counter((r.row_id, r.seed) for r in rows) == Counter((x, s) for x in "ab" for s in (0, 7, None))
    for r in rows:
        if r.seed is None:
            assert (r.threshold, r.val_em) == best[r.row_id] and r.test_em == r.val_em
    assert sorted(map(tuple, rows), key=str) == sorted(map(tuple, C.seed_sweep(long.repartition(5), {"test": long}, grid, [0, 7], 20).collect()), key=str)
    assert {r.val_em for r in C.seed_sweep(long, {}, grid, [3], 10**6).where("seed = 3").collect()} == {e for _, e in best.values()}


def average_rank(values):
    order = sorted((math.inf if v is None else v) for v in values)
    return {v: (order.index(math.inf if v is None else v) + 1 + len(order) - order[::-1].index(math.inf if v is None else v)) / 2 for v in values}


def ranked_rows(n=400):
    rng = random.Random(5)
    return [(rng.choice(["hot", "hot", "x", None]), rng.choice([1.0, 1.0, 1.0, float(rng.randint(0, 30)), rng.random()]), float(rng.choice([0, 0, rng.randint(0, 9)]))) for _ in range(n)]


@pytest.mark.parametrize("how", [{}, {"at_once": 0, "bins": 4}, {"at_once": 0, "bins": 64}], ids=str)
def test_average_ranks_of_any_group(spark, how, monkeypatch):
    monkeypatch.setattr(P, "HOT_ROWS", 20)
    monkeypatch.setattr(P, "HOT_PART", 50)
    rows = [*ranked_rows(), ("x", None, 1.0), ("x", None, 2.0)]
    d = spark.createDataFrame(rows, "g string, x double, y double")
    got = {(r.g, r.x): (r["rank"], r.n) for r in P.average_ranks(d, ["g"], "x", **how).collect()}
    for g in {r[0] for r in rows}:
        own = [x for a, x, _ in rows if a == g]
        assert {x: got[g, x][0] for x in own} == average_rank(own) and all(got[g, x][1] == own.count(x) for x in own)


@pytest.mark.parametrize("how", [{}, {"at_once": 0, "bins": 4}], ids=str)
def test_rank_correlation_of_any_group(spark, how, monkeypatch):
    monkeypatch.setattr(P, "HOT_ROWS", 20)
    monkeypatch.setattr(P, "HOT_PART", 50)
    rows = [*ranked_rows(), ("flat", 1.0, 1.0), ("flat", 1.0, 2.0)]
    got = {r.g: (r.rho, r.n) for r in P.rank_correlation(spark.createDataFrame(rows, "g string, x double, y double"), ["g"], "x", "y", **how).collect()}
    for g in {r[0] for r in rows}:
        own = [(x, y) for a, x, y in rows if a == g]
        rx, ry = average_rank([x for x, _ in own]), average_rank([y for _, y in own])
        a, b = np.array([rx[x] for x, _ in own]), np.array([ry[y] for _, y in own])
        want = 0.0 if a.std() == 0 or b.std() == 0 else np.corrcoef(a, b)[0, 1]
        assert got[g] == (pytest.approx(want), len(own))
    assert statistics.spearman(spark.createDataFrame([], "g string, x double, y double"), ["g"], "x", "y").collect() == []


def test_groups_in_the_order_of_structs(spark):
    """Few values of the first field, the second one tells rows apart; bins keep the order of both."""
    rng = random.Random(4)
    rows = [(g, rng.choice([0.1, 0.2, None, math.nan, 2.0]), i, rng.random()) for g in "ab" for i in range(300)] + [("a", rng.random(), 1000 + i, 0.5) for i in range(90)]
    d = spark.createDataFrame(rows, "g string, level double, i long, v double").withColumn("place", F.struct("level", "i")).repartition(4)
    b = P.binned(d, ["g"], "place", 5, 20)
    w = Window.partitionBy("g").orderBy("place")
    assert b.withColumn("before", F.lag("_bin").over(w)).where("before > _bin").isEmpty() and b.count() == len(rows)
    assert b.groupBy("g", "_bin").count().agg(F.max("count")).first()[0] < 60
    got = {r.g: (r.n, r.monotonic, r.net_up) for r in P.rises(d, "g", "place", "i", 5, 20).collect()}
    assert got["b"][:2] == (300, False) and got == {r.g: (r.n, r.monotonic, r.net_up) for r in P.rises(d, "g", "place", "i").collect()}
    rho = [{r.g: pytest.approx(r.rho) for r in P.rank_correlation(d, ["g"], "place", "v", 5, n).collect()} for n in (20, 10**6)]
    assert {g: x.expected for g, x in rho[0].items()} == rho[1]
    big = spark.createDataFrame([("a", (2**53 + i % 2, -i)) for i in range(100)], "g string, place struct<x: long, y: long>")
    assert P.binned(big, ["g"], "place", 5, 20).withColumn("before", F.lag("_bin").over(w)).where("before > _bin").isEmpty()


@pytest.mark.parametrize("at_once", [0, 10**6])
def test_rises_arcs_and_bests(spark, at_once, monkeypatch):
    real = P.binned
    monkeypatch.setattr(P, "binned", lambda df, groups, by, *more: real(df, groups, by, 5, at_once))
    rng = random.Random(9)
    rows = [("up", i, float(i)) for i in range(50)] + [("dip", i, float(i if i != 33 else 31.5)) for i in range(50)] + [("r", i, rng.random()) for i in range(70)] + [("one", 5, 2.0)]
    d = spark.createDataFrame(rows, "g string, o long, v double").repartition(4)
    by = defaultdict(list)
    for g, o, v in rows:
        by[g].append(v)
    got = {r.g: (r.n, r.monotonic, r.net_up) for r in P.rises(d, "g", "o", "v").collect()}
    assert got == {g: (len(v), all(a < b for a, b in zip(v, v[1:])), v[-1] > v[0]) for g, v in by.items()}
    arcs = {(r.g, r.o): r.arc for r in statistics.arc_length(d, "g", "o", "v").collect()}
    for g, o, _ in rows:
        at = o if g != "one" else 0
        assert arcs[g, o] == pytest.approx(sum(abs(b - a) for a, b in zip(by[g][: at + 1], by[g][1 : at + 1])))
    w = Window.partitionBy("g").orderBy("o")
    best = metrics.running_best(d, "g", "o", "v")
    want = d.withColumns({"best": F.max("v").over(w), "improved": F.coalesce(F.col("v") > F.max("v").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(True))})
    assert sorted(map(str, best.select("g", "o", "best", "improved").collect())) == sorted(map(str, want.select("g", "o", "best", "improved").collect()))


def test_poisson_weights_have_mean_and_variance_one(spark):
    d = spark.range(3000).select(F.col("id").alias("i"), F.lit(1.0).alias("x"))
    rows = [r for r in B.resampled(d, "i", {"x": F.col("x")}, 300).collect() if r["sample"] >= 0]
    n = np.array([r.n for r in rows])
    assert abs(n.mean() / 3000 - 1) < 0.01 and 0.7 < n.std() / math.sqrt(3000) < 1.3
    assert B.poisson_steps()[0] == int(math.exp(-1) * B.PRIME) and all(r.x == r.n for r in rows)


def test_bootstrap_intervals_cover_like_theory(spark):
    rng = random.Random(3)
    rows = [(i, rng.gauss(5, 2)) for i in range(2000)]
    r = B.bootstrap(spark.createDataFrame(rows, "i long, x double"), "i", {"x": F.col("x")}, F.try_divide("x", "n"), 1500).first()
    mean, error = np.mean([x for _, x in rows]), np.std([x for _, x in rows]) / math.sqrt(2000)
    assert r.value == pytest.approx(mean) and r.n == 2000
    assert r.low == pytest.approx(mean - 1.96 * error, abs=0.2 * error) and r.high == pytest.approx(mean + 1.96 * error, abs=0.2 * error)
    assert B.bootstrap(spark.createDataFrame([], "i long, x double"), "i", {"x": F.col("x")}, F.col("x"), 10).collect() == []
