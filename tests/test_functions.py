import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from corvid.functions import text as T
from corvid.functions import vocabulary as V
from corvid.functions.geometry import align, by_x, contour_features, distances, features_of, gather, resample, similarity
from corvid.functions.parsers import corrections, corrections_of, directions, muscle_mentions
from corvid.functions.spans import Vocabulary, spans_of, tagger

PIECES = ["front", "mid", "back", "increases", "increase", "monotonically increases", "#12", "0.50", "-3", " ", "dx ", "genioglossus posterior (GGP)", "mm", "x", "é"]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.sampled_from(PIECES), max_size=14).map(" ".join))
def test_spans_slice_back_and_never_overlap(text):
    for vocabulary in (Vocabulary.rewritten("en"), Vocabulary(["x"], ["increase"], ["front"], [("dx", "dx_mm")], True, True)):
        at = 0
        for s in tagger(vocabulary)(text):
            assert text[s["start"] : s["end"]] == s["value"] and s["start"] >= at
            at = s["end"]
            assert (s["role"] is not None) == (s["type"] == "number")


def test_span_rules():
    tag = tagger(Vocabulary.rewritten("en"))
    got = [(s["type"], s["value"], s["role"]) for s in tag("It monotonically increases at front: dx 0.5 mm, #77 and vol_ratio=1. back")]
    assert got == [("movement", "monotonically increases", None), ("region", "front", None), ("number", "0.5", "dx_mm"), ("number", "1.", "vol_ratio"), ("region", "back", None)]
    assert [s["value"] for s in tagger(Vocabulary(movements=["raise"], whole_movements=True))("raises raise")] == ["raise"]


def test_spans_of_columns(spark):
    d = spark.createDataFrame([("front 1",), (None,)], "t string").select(spans_of(F.col("t"), Vocabulary.rewritten("en")).alias("s"))
    a, b = d.collect()
    assert [x.value for x in a.s] == ["front", "1"] and b.s is None


def test_numbers_and_texts(spark):
    d = spark.createDataFrame([("a 1. -2.5 x3", 0.125), ("none", 1234.5)], "t string, x double")
    r = d.select(T.numbers(F.col("t")).alias("a"), T.numbers(F.col("t"), T.NUMBERS_SCORED).alias("b"), T.first_number(F.col("t")).alias("f"), T.fixed(F.col("x"), 2).alias("s"), T.value_text(F.col("x")).alias("v")).collect()
    assert (r[0].a, r[0].b, r[0].f, r[0].s, r[0].v) == (["1", "-2.5", "3"], ["1.", "-2.5", "3"], 1.0, "0.12", "0.125")
    assert (r[1].a, r[1].f, r[1].s, r[1].v) == ([], None, "1234.50", "1234.5")
    zeros = spark.createDataFrame([(-0.0001,), (2.5,), (9.9996,)], "x double").select(T.value_text(F.col("x")).alias("v")).collect()
    assert [x.v for x in zeros] == ["0", "2.5", "10"]


def test_faithful_rewrites(spark):
    names, surfaces = V.FULL_NAMES["en"], {k: v[0] for k, v in V.MOVEMENT_CONCEPTS["en"].items()}
    origin = "When styloglossus (STY) contracts, front moves to retract by 1.25 and 1.25 mm."
    rows = [("As styloglossus (STY) contracts the front will retract 1.25 mm, 1.25 in all.", True), ("styloglossus (STY) retract 1.25", False), ("the muscle will retract 1.25 1.25", False), ("styloglossus (STY) 1.25 1.25", False)]
    d = spark.createDataFrame(rows, "new string, ok boolean").withColumn("got", T.faithful(F.lit(origin), F.col("new"), names, surfaces))
    assert all(r.ok == r.got for r in d.collect())


def test_pattern_labels(spark):
    rows = [("A synergistic, linear gain", "+"), ("they cancel", "-"), ("purely additive", "0"), ("?", "?")]
    d = spark.createDataFrame(rows, "t string, want string").withColumn("got", T.pattern_label(F.col("t"), V.SIGNS, "?"))
    assert all(r.want == r.got for r in d.collect())
    d = spark.createDataFrame([("It CANNOT be told", True), ("유일하지 않다", True), ("yes", False)], "t string, want boolean")
    assert all(r.want == r.got for r in d.withColumn("got", T.matches_any(F.col("t"), V.ABSTENTIONS["en"] + V.ABSTENTIONS["ko"])).collect())


def test_directions():
    assert directions("tip: advance, raise; body=retract; dorsum = stay") == {"tip": ["advance", "elevate"], "body": ["retract"], "root": [], "dorsum": ["preserve"]}
    assert directions("front dx 0.8, dz -0.9")["tip"] == ["advance", "descend"]
    assert directions("it goes up 0.7") == {r: ["elevate"] for r in V.REGIONS}
    assert directions(None) == {r: [] for r in V.REGIONS}
    assert directions("front dx 0.2mm")["tip"] == []


def test_corrections():
    assert corrections("GGP↑, TRANS↓") == {"GGP": "inc", "TRANS": "dec"}
    assert corrections("↑ GGP, styloglossus; ↓ HG") == {"GGP": "inc", "STY": "inc", "HG": "dec"}
    assert corrections("contract GGP and STY. relax VERT, hyoglossus") == {"GGP": "inc", "STY": "inc", "HG": "dec", "VERT": "dec"}
    assert corrections("STY 더 수축하고, 수직근 이완")["VERT"] == "dec"
    assert corrections("GGP↑ relax GGP") == {"GGP": "inc"}
    assert corrections("increase GGP. decrease GGP.") == {} == corrections(None)


def test_parsers_on_columns(spark):
    d = spark.createDataFrame([("relax the styloglossus (STY), not gh",), (None,)], "t string")
    r = d.select(corrections_of(F.col("t")).alias("c"), muscle_mentions(F.coalesce("t", F.lit(""))).alias("m")).collect()
    assert r[0].c["STY"] == "dec" and r[0].m == ["STY", "GH"] and r[1].c == {} and r[1].m == []


def arc(n=30, height=0.4):
    x = np.linspace(0, 1, n)
    return np.stack([x, height * np.sin(np.pi * x)], axis=1)


def test_contour_features_of_known_shapes():
    palate = arc(40, 0.6)
    f = contour_features(arc(25, 0.5), palate)
    assert list(f) == V.CONTOUR_FEATURES and all(map(np.isfinite, f.values()))
    assert f["peak_xn"] == pytest.approx(0.5, abs=0.02) and f["h_front"] == pytest.approx(f["h_back"], abs=1e-3)
    assert abs(f["tilt"]) < 1e-2 and f["doming"] == pytest.approx(f["peak_z"], rel=0.05) and f["ant_slope"] > 0 > f["post_slope"]
    front = contour_features(arc(25, 0.5) * [0.5, 1.1], palate)
    assert front["cl_t"] < f["cl_t"] + 0.5 and front["peak_xn"] < 0.3
    assert contour_features(palate, palate)["cd_min"] == pytest.approx(0, abs=1e-12)


def test_distances_equal_a_loop():
    rng = np.random.default_rng(0)
    points, path = rng.normal(size=(7, 2)), rng.normal(size=(6, 2))
    path[3] = path[2]

    def one(p, a, b):
        ab = b - a
        t = np.clip((p - a) @ ab / (ab @ ab), 0, 1) if ab @ ab > 0 else 0
        return np.linalg.norm(p - a - t * ab)

    want = [min(one(p, path[i], path[i + 1]) for i in range(5)) for p in points]
    assert distances(points, path) == pytest.approx(want)


def test_alignment_recovers_a_similarity():
    a = arc()
    turn = np.array([[0.8, -0.6], [0.6, 0.8]])
    b = 2 * a @ turn.T + [3, -1]
    scale, rotation, shift = similarity(a, b)
    assert scale == pytest.approx(2) and rotation == pytest.approx(turn) and shift == pytest.approx([3, -1])
    moved = arc() * 1.5 + [4, 4]
    assert align(moved, moved, arc()) == pytest.approx(arc(), abs=1e-6)
    assert (resample(np.ones((3, 2)), 4) == 1).all() and by_x(a[::-1])[0, 0] == 0


def test_features_on_columns(spark):
    rows = [(1, arc(10).tolist()), (2, [[0.0, float("nan")]] * 10), (3, None), (4, [[0.0, 1.0]])]
    d = spark.createDataFrame(rows, "id int, c array<array<double>>").select("id", features_of(F.col("c"), arc(40, 0.6)).alias("f"))
    got = {r.id: r.f for r in d.collect()}
    assert got[1].feat_ok and got[1].cd_min == pytest.approx(contour_features(arc(10), arc(40, 0.6))["cd_min"])
    assert not got[2].feat_ok and not got[3].feat_ok and got[2].tilt is None
    v = spark.createDataFrame([([[3.0, 9.0, 1.0], [1.0, 9.0, 2.0]],)], "v array<array<float>>").select(gather(F.col("v"), [0, 1]).alias("p")).first().p
    assert v == [[1.0, 2.0], [3.0, 1.0]]


def test_vocabulary_keeps_long_forms_first():
    for lang, words in V.MOVEMENTS.items():
        for i, w in enumerate(words):
            assert not any(w.startswith(x) and w != x for x in words[:i]), (lang, w)
    assert all(re.compile(p) for p, _ in V.SIGNS)


def test_one_automaton_equals_a_pattern_a_word():
    import random
    import re

    from corvid.functions.spans import Surfaces

    rng = random.Random(6)
    for _ in range(300):
        words = [("".join(rng.choice("ab é_") for _ in range(rng.randint(1, 3))), rng.randint(0, 2), "k", rng.random() < 0.5) for _ in range(rng.randint(0, 5))]
        text = "".join(rng.choice("aab é_.") for _ in range(rng.randint(0, 25)))
        want = []
        for i, (w, rank, kind, whole) in enumerate(words):
            edge = r"\b" if whole else ""
            want += [(m.start(), rank, i, m.end(), kind) for m in re.finditer(edge + re.escape(w) + edge, text)]
        assert sorted(Surfaces(words).find(text)) == sorted(want), (words, text)
