import json
from collections import Counter

import pytest
from pyspark.sql import functions as F

from corvid.functions.vocabulary import MUSCLES
from corvid.plans import probe_items as P
from corvid.sources.reports import markdown, rows_of, write_markdown, write_metrics


@pytest.fixture(scope="module")
def pool(spark):
    rows = [(i, *[0.3 if k < i % 4 else 0.0 for k in range(11)]) for i in range(80)]
    return spark.createDataFrame(rows, "index long, " + ", ".join(f"{m} double" for m in MUSCLES))


def test_samples_are_balanced_and_in_the_split(spark, pool):
    ids = spark.range(60).withColumnRenamed("id", "index")
    got = P.sample_meshes(pool, ids, 20, F.col("index") < 8).collect()
    assert Counter(r.n_act_bin for r in got) == {"1": 7, "2": 7, "3+": 6} and max(r["index"] for r in got) < 60
    assert {2, 6} <= {r["index"] for r in got if r.n_act_bin == "2"}
    assert {r.n_act_bin for r in P.sample_meshes(pool, ids, 5, mode="3plus").collect()} == {"3+"} and P.sample_meshes(pool, ids, 5, mode="natural").count() == 5


def test_items_of_all_families(spark, pool):
    meshes = P.sample_meshes(pool, pool, 12)
    values = pool.select("index", F.lit("peak_z").alias("quantity"), F.lit("norm").alias("unit"), F.lit(0.25).alias("value"))
    targets = spark.createDataFrame([("i", [0.3] + [0.0] * 10), ("a", [0.0] * 11)], "ipa string, goal array<double>")
    questions = {"muscle_set": "which?", "value": "what is {quantity}?", "direction": "towards {target}?", "utility": "describe"}
    items = P.build_items(meshes, values, targets, questions, ["who spoke?", "what sex?"]).collect()
    n = Counter(r.family for r in items)
    assert n["muscle_set"] == n["value"] == n["abstention"] == n["utility"] == 12 >= n["direction"] > 0
    assert len({r.uid for r in items}) == len(items) and all(r.should_abstain == (r.family == "abstention") for r in items)
    for r in items:
        if r.family == "muscle_set":
            assert r.gold_muscles == MUSCLES[: r.mesh_index % 4]
        if r.family == "value":
            assert (r.question, r.gold_text, r.tol) == ("what is peak_z?", "0.25", 0.1)
        if r.family == "direction":
            assert r.gold_inc or r.gold_dec and r.question in ("towards i?", "towards a?")


def test_reports(spark, tmp_path):
    d = spark.createDataFrame([("x", 0.5, None), ("y", None, None)], "name string, f1 double, gone string")
    assert markdown(d) == "| name | f1 |\n| --- | --- |\n| x | 0.5000 |\n| y | - |"
    for _ in range(2):
        write_metrics(d, f"file://{tmp_path}/m.json")
        write_markdown(d, f"file://{tmp_path}/m.md", "Scores")
    assert json.loads((tmp_path / "m.json").read_text())[0] == {"name": "x", "f1": 0.5, "gone": None}
    assert (tmp_path / "m.md").read_text().startswith("# Scores\n\n| name")
    with pytest.raises(ValueError):
        rows_of(spark.range(5), 4)
