import random

import pytest
from pyspark.sql import functions as F

from corvid.functions import vocabulary as V
from corvid.functions.spans import Vocabulary, spans_of
from corvid.operators import facts
from corvid.plans import evaluation as E

SPANS = "array<struct<type: string, value: string, start: int, end: int, role: string>>"


def items(spark, rows):
    d = spark.createDataFrame(rows, "turn_type string, gold_text string, pred string")
    return d.withColumn("gold_spans", spans_of(F.col("gold_text"), Vocabulary.rewritten("en")))


def test_mask_f1_equals_sets(spark):
    rows = [
        ("B3", "styloglossus (STY) monotonically increases at front 0.50 and 2", "styloglossus (STY) increases at front by 0.50 and 3"),
        ("B3", "back retract 2", "back 2.01"),
        ("A1", "nothing here", None),
    ]
    got = {r.category: r for r in facts.mask_f1(items(spark, rows), "en", spark.createDataFrame([("B3", "2")], "turn_type string, value string")).collect()}
    counts = {k: (r.tp, r.fp, r.fn) for k, r in got.items()}
    assert counts["muscle"] == (1, 0, 0) and counts["region"] == (2, 0, 0) and counts["movement"] == (1, 0, 2)
    assert counts["number"] == (1, 2, 2) and counts["number_informative"] == (1, 2, 0) and counts["number_tol"] == (2, 1, 1)
    assert counts["micro"] == (5, 2, 4) and got["macro"].f1 == pytest.approx((1 + 1 + 0.5 + 1 / 3) / 4)
    empty = {r.category: r.f1 for r in facts.mask_f1(items(spark, rows[2:]), "en").collect()}
    assert set(empty.values()) == {None}


def test_trends_signs_and_directions(spark):
    rows = [("B3", "monotonically increases", "a reversal that increases"), ("B3", "saturation monotonically", "saturation"), ("B3", "front", "x"), ("B2", "advance lower", "advance then lower"), ("B2", "retract", "retract or advance")]
    d = items(spark, rows)
    assert {tuple(r) for r in facts.trend_confusion(d, "en").collect()} == {("monotonic", "reversal", 1), ("saturating", "saturating", 1)}
    assert tuple(facts.direction_accuracy(d, "en").first()) == (3, 2, 1, 2)
    s = spark.createDataFrame([("synergy, linear",), ("they oppose",), ("linear",), ("",)], "t string").select(facts.sign_of(F.col("t")).alias("s")).collect()
    assert [r.s for r in s] == ["+", "-", "0", "?"]


def test_untaggable_spans(spark):
    d = spark.createDataFrame([([("movement", "superposition", 0, 1, None), ("region", "front", 0, 1, None), ("muscle", "x", 0, 1, None)],), (None,)], f"s {SPANS}")
    assert [r.n for r in d.select(facts.untaggable(F.col("s"), "en").alias("n")).collect()] == [1, 0]


def test_number_df(spark):
    conv = [{"from": "human", "value": "q", "mask_spans": None}, {"from": "gpt", "value": "a", "mask_spans": [("number", "1", 0, 1, None), ("number", "1", 3, 4, None), ("region", "mid", 0, 1, None)]}]
    rows = [("f", i, None if i % 2 else 0, i, ["A1"], conv) for i in range(6)] + [("f", 9, 1, 1, ["A1"], conv), ("g", 0, 0, 77, ["A1"], conv)]
    d = spark.createDataFrame(rows, f"file string, line int, variant int, first_id long, turn_types array<string>, conversations array<struct<from: string, value: string, mask_spans: {SPANS}>>")
    train = spark.range(6).withColumnRenamed("id", "index")
    assert [tuple(r) for r in facts.number_df(d, train, least_turns=6).collect()] == [("A1", "1", 1.0)]
    assert facts.number_df(d, train, least_turns=7).collect() == [] == facts.number_df(d, train, least_turns=6, per_file=5).collect()


def test_paraphrase_round(spark):
    conv = [{"from": "human", "value": "q1"}, {"from": "gpt", "value": "front 1.5"}, {"from": "gpt", "value": "extra"}, {"from": "human", "value": "q2"}, {"from": "gpt", "value": "mid 2"}]
    records = spark.createDataFrame([("f", 1, conv)], "file string, line int, conversations array<struct<from: string, value: string>>")
    jobs = E.paraphrase_jobs(records, ["plain", "warm"], 3)
    assert sorted((r.turn, r.variant, r.style, r.q) for r in jobs.collect())[:3] == [(1, 0, "plain", "q1"), (1, 1, "warm", "q1"), (1, 2, "plain", "q1")]
    outputs = spark.createDataFrame([("f", 1, 1, 0, 0, "<Q>lost</Q> <A>front 9</A>"), ("f", 1, 1, 0, 1, "<Q>w?</Q><A>the front, 1.5</A>"), ("f", 1, 1, 0, 2, "<Q> w 1? </Q><A>the front, 1.5</A>"), ("f", 1, 4, 0, 0, 'text\n`{"q": "z 2", "a": "mid is 2"}`'), ("f", 1, 1, 1, 0, "junk")], "file string, line int, turn int, variant int, attempt int, text string")
    done = E.accepted(jobs, outputs, V.FULL_NAMES["en"], {"front": "front", "mid": "mid"})
    got = {(r.turn, r.variant): (r.q, r.a, r.faithful) for r in done.collect()}
    assert got[1, 0] == ("w 1?", "the front, 1.5", True) and got[4, 0] == ("z 2", "mid is 2", True) and got[1, 1] == ("q1", "front 1.5", False)
    whole = {r.variant: (r.nat_all_faithful, [t.turn for t in r.turns]) for r in E.regrouped(done).collect()}
    assert whole == {0: (True, [1, 4]), 1: (False, [1, 4]), 2: (False, [1, 4])}


def test_jobs_and_predictions(spark):
    d = spark.createDataFrame([(1, 0, "user", "q", "A"), (1, 1, "assistant", "x", "A"), (2, 0, "assistant", "y", "A"), (3, 0, "user", "q", "A"), (3, 1, "assistant", "z", "A")], "conv_id long, turn long, role string, text string, turn_type string")
    jobs = E.turn_jobs(d)
    assert sorted((r.conv_id, r.gold) for r in jobs.collect()) == [(1, "x"), (3, "z")] and E.turn_jobs(d, 1).count() == 1
    p = spark.createDataFrame([(1, 1, "old", 0), (1, 1, "new", 1)], "conv_id long, turn long, pred string, n int")
    assert {r.conv_id: r.pred for r in E.with_predictions(jobs, p, ["conv_id", "turn"], "n").collect()} == {1: "new", 3: ""}
    t = spark.createDataFrame([("A", [1, 9]), ("A", [8]), ("B", [])], "turn_type string, mesh_indices array<long>")
    assert {r.turn_type: (r.total, r.rate) for r in E.overlap_by_type(t, spark.createDataFrame([(1,), (1,)], "index long")).collect()} == {"A": (3, 1 / 3), "B": (0, 0.0)}


def test_regression_scores(spark):
    rng = random.Random(4)
    rows = [("m", i, k, rng.choice([0.0, 0.05, 0.3]) if k != "HG" else 0.0, rng.choice([0.0, 0.0, 0.4])) for i in range(40) for k in ("GGP", "STY", "HG")]
    d = spark.createDataFrame(rows, "row_id string, index long, muscle string, pred double, gold double")

    def em(t):
        by = {}
        for _, i, _, p, g in rows:
            by.setdefault(i, []).append((p > t) == (g > 1e-4))
        return sum(map(all, by.values())) / 40

    grid = [0.01, 0.1, 0.5]
    best = E.best_threshold(d, grid).first()
    assert best.em == pytest.approx(max(map(em, grid))) and best.threshold == min(t for t in grid if em(t) == max(map(em, grid)))
    assert E.exact_scores(E.set_matches(d, 0.1)).first().em == pytest.approx(em(0.1))
    r = E.dead_muscles(d, 0.1).first()
    needs = {i for _, i, k, _, g in rows if k == "HG" and g > 0}
    assert r.dead_muscles == ["HG"] and r.n_blocked == len(needs) and r.em_ceiling == pytest.approx(1 - len(needs) / 40)
    gold = d.select("index", "muscle", "gold")
    base = E.constant_baselines(gold, gold)
    assert base.count() == 240 and base.where("row_id = 'zeros'").agg(F.max("pred")).first()[0] == 0.0
    bins = {r["index"]: r.n_act_bin for r in E.active_bins(d).collect()}
    assert len(bins) == 40 and set(bins.values()) <= {"0", "1", "2", "3+"}
    grid = E.threshold_grid()
    assert grid == sorted(grid) and len(grid) == 38
