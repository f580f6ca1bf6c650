from collections import Counter

import pytest

from corvid.functions.vocabulary import MUSCLES
from corvid.plans import pool


@pytest.fixture(scope="module")
def rows(spark):
    centers = [("i", [0.4] + [0.0] * 10, 0.05), ("a", [0.0, 0.0, 0.3, 0.0, 0.0, 0.0, 0.5, 0.0, 0.0, 0.0, 0.0], 0.1)]
    c = spark.createDataFrame(centers, "phoneme string, act array<double>, sigma double")
    return pool.build_pool(spark, c, 1700, seed=3, n_triples=200).collect(), pool.build_pool(spark, c.repartition(3), 1700, seed=3, n_triples=200).collect()


def test_pool_is_numbered_distinct_and_repeatable(rows):
    a, b = rows
    assert sorted(r["index"] for r in a) == list(range(len(a))) and {tuple(r) for r in a} == {tuple(r) for r in b}
    vectors = {tuple(round(r[m] * 10_000) for m in MUSCLES) for r in a}
    assert len(vectors) == len(a) > 1300
    by = {r["index"]: r for r in a}
    assert by[0].section == "rest" and by[0].n_active == 0
    n = Counter(r.section for r in a)
    assert n["single"] == 66 and 190 < n["triple"] <= 200 and n["pair"] == 495 and n["anchor"] > 250 and n["spacefill"] > 150


def test_pool_limits_and_bases(rows):
    by = {r["index"]: r for r in rows[0]}
    for r in by.values():
        v = [r[m] for m in MUSCLES]
        assert min(v) >= 0 and max(v) <= 0.9 + 1e-9 and sum(v) <= 2.0 + 0.001 and r.n_active == sum(x >= 0.05 for x in v)
        if r.section == "neighbor" and r.base_index >= 0:
            base = by[r.base_index]
            assert base.section == "anchor"
            moved = [abs(r[m] - base[m]) for m in MUSCLES]
            assert max(moved) <= 0.1501 or sum(v) > 1.9
        assert r.section == "neighbor" or r.base_index == -1


def test_centers():
    assert pool.center_vector({"GGP": (0.2, 0.6), "SL": (0.1, 0.1)}) == [0.4] + [0.0] * 9 + [0.1]
