import numpy as np
import pytest
from pyspark.sql import functions as F

from corvid.operators import mesh, probe


def test_region_masks_and_motion(spark):
    rng = np.random.default_rng(1)
    m = rng.normal(size=(50, 3))
    rest = spark.createDataFrame([(i, *map(float, p)) for i, p in enumerate(m)], "vertex int, x double, y double, z double")
    got = {(r.vertex, r.region) for r in probe.region_masks(rest).collect()}
    x, z = m[:, 0], m[:, 2]
    tip, root = x <= np.percentile(x, 20), x >= np.percentile(x, 80)
    want = {"tip": tip, "root": root, "body": ~tip & ~root, "dorsum": ~tip & (z >= np.percentile(z, 70))}
    assert got == {(i, k) for k, v in want.items() for i in np.flatnonzero(v)}
    moved = spark.createDataFrame([(7, i, 0.001 * i, 0.0, -0.002) for i in range(50)], "index long, vertex int, dx double, dy double, dz double")
    r = {x.region: x for x in probe.region_motion(moved, probe.region_masks(rest)).collect()}
    assert r["tip"].up_mm == -2.0 and r["tip"].forward_mm == pytest.approx(-np.flatnonzero(tip).mean(), abs=0.006)


def test_labels_and_corrections(spark):
    d = spark.createDataFrame([(0.5, -0.5), (0.49, 0.0), (-3.0, 0.1)], "f double, u double")
    assert [r.x for r in d.select(probe.direction_labels(F.col("f"), F.col("u")).alias("x")).collect()] == [["advance", "descend"], ["preserve"], ["retract"]]
    cur, goal = [0.0] * 11, [0.0] * 11
    cur[1], goal[0], goal[2] = 0.5, 0.05, 0.04
    a = spark.createDataFrame([(cur, goal)], "c array<double>, t array<double>")
    more, less = probe.corrections_between(F.col("c"), F.col("t"))
    assert tuple(a.select(more, less).first()) == (["GGP"], ["GGM"])


def test_value_scores(spark):
    rows = [("a", "about 3.5 mm", 5.0, None, None, "x", "mm"), ("b", "0.06", 0.02, None, None, "cd_min", "norm"), ("c", "none", 1.0, 9.0, None, "x", "mm"), ("d", "1", 1.4, 0.5, None, "x", "norm")]
    d = spark.createDataFrame(rows, "uid string, pred string, gold_value double, gt double, mt double, q string, u string")
    tol = lambda s: probe.value_tolerance(F.col("gt"), F.col("mt"), F.col("q"), F.col("u"), s)
    ok = lambda s: {r.uid: r.correct for r in probe.score_values(d, tol(s)).collect()}
    assert ok("gold") == {"a": True, "b": False, "c": False, "d": True} and ok("config")["d"] is False


def test_region_scores(spark):
    gold = {"tip": ["advance"], "dorsum": ["elevate"], "root": ["preserve"]}
    rows = [("all", "tip: advance; dorsum: raise; root: stay", gold), ("coarse", "front advance, back unchanged", gold), ("against", "tip: advance and retract; dorsum: raise; root: stay", gold), ("none", None, gold), ("empty", "tip: advance", {})]
    got = {r.uid: (r.n_regions, r.n_right, r.n_against, r.correct) for r in probe.score_regions(spark.createDataFrame(rows, "uid string, pred string, gold_directions map<string,array<string>>")).collect()}
    assert got["all"] == (3, 3, 0, True) and got["coarse"] == (2, 2, 0, True)
    assert got["against"] == (3, 2, 1, False) and got["none"][1:] == (0, 0, False) and got["empty"] == (0, 0, 0, False)


def test_correction_and_axis_scores(spark):
    rows = [("a", "GGP↑, STY↓", ["GGP"], ["STY"]), ("b", "contract GGP", ["GGP"], ["HG"]), ("c", "", None, None)]
    c = probe.score_corrections(spark.createDataFrame(rows, "uid string, pred string, gold_inc array<string>, gold_dec array<string>"))
    r = c.first()
    assert (r.tp, r.fp, r.fn, r.n, r.n_exact) == (3, 0, 1, 3, 1)
    assert probe.headline(c, None, None).first().direction == pytest.approx(6 / 7)
    rows = [("ok", "front moves forward and up 0.9", ["advance"], "front", 3.0), ("hedge", "advance or retract", ["advance"], "front", 3.0), ("weak", "advance", ["advance"], "front", 1.9), ("still", "advance", ["preserve"], "front", 9.0), ("half", "raise", ["advance", "elevate"], None, 2.0)]
    a = probe.score_axes(spark.createDataFrame(rows, "uid string, pred string, gold_concepts array<string>, dominant_region string, mag_mm double"))
    got = {r.uid: (r.skipped, r.correct) for r in a.collect()}
    assert got == {"ok": (None, True), "hedge": (None, False), "weak": ("weak", None), "still": ("empty", None), "half": (None, False)}
    assert probe.headline(None, a, None).first().direction == pytest.approx(1 / 3)


def test_abstentions_and_control(spark):
    rows = [("abstention", True), ("abstention", False), ("value", False), ("muscle_set", True), ("utility", True)]
    r = probe.score_abstentions(spark.createDataFrame(rows, "family string, said boolean"), F.col("said")).first()
    assert (r.tp, r.fp, r.fn, r.tn) == (1, 1, 1, 1)
    one = spark.createDataFrame([(0.75,)], "f1 double")
    assert probe.control_delta(one, one.withColumn("f1", F.lit(0.5)), "f1").first().delta == 0.25


def test_topology(spark):
    f = spark.createDataFrame([(0, 1, 2), (2, 1, 5)], "i int, j int, k int")
    assert {tuple(r) for r in mesh.edges(f).collect()} == {(0, 1), (1, 2), (0, 2), (1, 5), (2, 5)}
    assert {r.vertex: r.neighbours for r in mesh.neighbours(f).collect()}[2] == [0, 1, 5]
    assert {tuple(r) for r in mesh.compact_ids(f).collect()} == {(0, 0), (1, 1), (2, 2), (5, 3)}
    coo = spark.createDataFrame([(0, 0, 0.5), (0, 1, 0.5), (1, 1, 2.0)], "row int, col int, val double")
    x = spark.createDataFrame([(0, 2.0), (1, 4.0)], "col int, x double")
    assert {tuple(r) for r in mesh.sparse_apply(coo, x).collect()} == {(0, 3.0), (1, 8.0)}


def test_small_formulas(spark):
    d = spark.createDataFrame([(0.5, 0.2, [1.0, 2.0], 3)], "t double, s double, a array<double>, n int")
    pad, mask = mesh.padded(F.col("a"), 4)
    r = d.select(mesh.min_jerk(F.col("t")).alias("j"), mesh.loss_weight(F.col("s"), 0.5, 10).alias("w"), pad.alias("p"), mask.alias("m"), mesh.subset_size(F.col("n"), 0.4).alias("k"), mesh.all_finite(F.col("a")).alias("ok"), mesh.spiral_gather(F.expr("array(array(1), array(2), array(3))"), F.expr("array(2, 0)")).alias("g")).first()
    assert (r.j, r.w, r.p, r.m, r.k, r.ok, r.g) == (0.5, 4.0, [1.0, 2.0, 0.0, 0.0], [True, True, False, False], 2, True, [3, 1])
    e = spark.createDataFrame([(1, 0.5, 2.0), (1, -0.1, 1.0)], "index long, ratio double, volume double")
    q = mesh.element_quality(e).first()
    assert q.n_inverted == 1 and q.min_elem_vol == -0.1 and q.vol_ratio == pytest.approx(0.3)
    n = spark.createDataFrame([(1, 3.0, 4.0, 0.0), (1, float("nan"), 0.0, 0.0)], "index long, vx double, vy double, vz double")
    assert tuple(mesh.node_state(n).first())[1:] == (5.0, True)
    v = spark.createDataFrame([(1, 0, 1.0, 2.0, 3.0)], "index long, vertex int, x float, y float, z float")
    rest = spark.createDataFrame([(0, 0.5, 0.5, 0.5)], "vertex int, x float, y float, z float")
    assert tuple(mesh.displacement(v, rest).first()) == (1, 0, 0.5, 1.5, 2.5)
