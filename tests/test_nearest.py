"""The pivot join against the product of all pairs."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from corvid.operators import nearest as N
from corvid.plans.probe_items import interventions, motion_between


def clustered(n=600, dim=5, seed=2):
    rng = np.random.default_rng(seed)
    centers = rng.normal(size=(12, dim)) * 10
    rows = [(i, (centers[i % 12] + rng.normal(size=dim) * 0.3).tolist()) for i in range(n)]
    return rows + [(n + i, rows[3][1]) for i in range(5)] + [(n + 10 + i, [0.0] * dim) for i in range(40)] + [(n + 99, None)]


def product(queries, rows):
    known = [(i, np.array(v)) for i, v in rows if v is not None]
    out = {}
    for q, skip, v in queries:
        if v is not None and (near := [(float(((np.array(v) - w) ** 2).sum()), i) for i, w in known if i != skip]):
            d, i = min(near)
            out[q] = (i, pytest.approx(d**0.5, abs=1e-9))
    return out


@pytest.mark.parametrize("how", [{}, {"pivots": 12, "ring": 8}, {"pivots": 1, "ring": 16}, {"pivots": 40, "ring": 3}], ids=str)
def test_equal_to_the_product(spark, how, monkeypatch):
    monkeypatch.setattr(N, "QUERIES", 7)
    rows = clustered()
    data = spark.createDataFrame(rows, "id long, v array<double>").repartition(5)
    rng = random.Random(1)
    queries = [(k, i, v) for k, (i, v) in enumerate(rng.sample(rows, 120))] + [(1000 + k, None, [x + rng.uniform(-3, 3) for x in rows[k][1]]) for k in range(30)] + [(2000, 5, None), (2001, rows[3][0], rows[3][1]), (2002, 610, [0.0] * 5)]
    q = spark.createDataFrame(queries, "k long, skip long, v array<double>")
    got = N.nearest_join(q, N.PivotIndex(data, "id", "v", **how), "k", "skip", "v").collect()
    want = product(queries, rows)
    assert {r.query: (r.nn_id, r.distance) for r in got} == want
    if how.get("pivots") == 12:
        assert sum(r.compared for r in got) < 0.35 * len(want) * 602


def test_own_rows_and_few_of_them(spark):
    rows = [(1, [0.0, 0.0]), (2, [3.0, 4.0]), (3, [0.0, 0.0]), (4, None)]
    d = spark.createDataFrame(rows, "id long, v array<float>")
    assert {r.id: (r.nn_id, r.distance) for r in N.nearest(d, d, "id", "v").collect()} == {1: (3, 0.0), 2: (1, 5.0), 3: (1, 0.0)}
    assert N.nearest(d.where("id = 2"), d.where("id = 2"), "id", "v").collect() == []
    assert N.nearest(d, d.limit(0), "id", "v").collect() == [] and N.nearest(d.limit(0), d, "id", "v").collect() == []


def test_motion_takes_the_first_of_equal_regions(spark):
    kind = "struct<front: struct<dx: double, dz: double>, mid: struct<dx: double, dz: double>, back: struct<dx: double, dz: double>>"
    still = ((0.0, 0.0),) * 3
    rows = [(still, ((1.0, 0.0), (0.0, 1.0), (0.0, 0.4))), (still, ((0.1, 0.0), (0.0, -2.0), (1.0, 1.0))), (still, still), (None, still)]
    got = spark.createDataFrame(rows, f"a {kind}, b {kind}").select(motion_between(F.col("a"), F.col("b")).alias("m")).collect()
    assert [r.m and (r.m.region, r.m.directions, r.m.dx, r.m.dz) for r in got] == [("front", ["advance"], 1.0, 0.0), ("mid", ["descend"], 0.0, -2.0), ("front", ["preserve"], 0.0, 0.0), None]


def test_interventions_pass_over_meshes_that_do_not_move(spark):
    act = lambda *on: [on[0] if on else 0.0] + [0.0] * 10
    pool = [(1, act()), (2, act(0.1)), (3, act(0.15)), (4, [0.0] * 10 + [0.3])]
    still, moved = {"dx": 0.0, "dz": 0.0}, {"dx": 2.0, "dz": 0.0}
    mm = {1: (still,) * 3, 2: (still,) * 3, 3: (still, still, moved), 4: None}
    kind = "index long, act array<double>, region_mm struct<front: struct<dx: double, dz: double>, mid: struct<dx: double, dz: double>, back: struct<dx: double, dz: double>>"
    rows = spark.createDataFrame([(i, a, mm[i]) for i, a in pool], kind)
    got = {r["index"]: r for r in interventions(rows, rows, rows).collect()}
    assert got[1].muscle == "GGP" and (got[1].delta, got[1].base_mesh, got[1].region, got[1].directions) == (0.15, 3, "back", ["advance"])
    assert 4 not in got and got[3].directions == ["retract"]
