import json
import math

import pytest

from corvid.functions.vocabulary import FULL_NAMES, MUSCLES
from corvid.plans import qa

TEMPLATES = {
    "lang": "en",
    "muscle_names": FULL_NAMES["en"],
    "muscle_actions": {m: f"does {m.lower()}" for m in MUSCLES},
    "direction_words": {"advance": "advance", "retract": "retract", "raise": "raise", "lower": "lower"},
    "physics": {
        "attribution": {"q": "who?", "a": "By {muscles}: {actions}.", "action_item": "{muscle} {action}", "list_sep": ", ", "action_sep": "; "},
        "identifiability": {"q": "sure?", "a": "No."},
        "volume": {"q": "volume?", "a": "vol_ratio={vol_ratio} {region} {h} {v}"},
        "single": {"q": "only {muscle}?", "a": "{region} {h} {v} {front_dx}/{front_dz} {mid_dx}/{mid_dz} {back_dx}/{back_dz}"},
        "counterfactual": {"q": "if {delta}?", "a_effect": "{region} {h} {v} dx {dx}mm dz {dz}mm #{base}", "a_negligible": "negligible {dx} {dz} #{base}"},
        "prescriptive": {"q": "to {target}?", "a": "{target}{label}: {body}", "increase_prefix": "more ", "decrease_prefix": "less ", "already_close": "close", "list_sep": ", ", "part_sep": "; "},
    },
    "feature": {f"q{i}": f"q{i}" for i in (1, 2, 3)}
    | {"a1": "{place} cl_t={cl_t} cd_min={cd_min} {hi_reg}", "a2": "{place_example}", "a3": "curv_peak={curv_peak} {curv_word} {doming_word}"}
    | {"place_words": {"front": "front", "mid": "mid", "back": "back"}, "place_examples": {"front": "F", "mid": "M", "back": "B"}, "curv_words": {"gentle": "g", "sharp": "s"}, "doming_words": {"flat": "flattened", "domed": "domed"}},
    "b3": {"q_single": "{muscle} {lv0}-{lv1}", "q_effort": "{muscles} {lv0}-{lv1}", "seq_item": "{lv}->{resp}mm", "seq_sep": ", ", "a_strict": "S {lead} {seq} rho={rho}", "a_near": "N {lead} {seq}", "a_partial": "P {lead} {seq}"},
    "spans": {p: {"movement_words": ["advance", "retract", "raise", "lower"], "movement_mode": "word", "region_words": ["front", "mid", "back"], "region_mode": "word", "number_roles": [["vol_ratio", "vol_ratio"], ["dx", "dx_mm"], ["mm", "disp_mm"]], "context_chars": 12} for p in ("physics", "feature")},
}
POOL = "index long, section string, detail string, base_index long, delta string, " + ", ".join(f"{m} double" for m in MUSCLES)


def pool_row(index, section, detail, base=-1, delta=None, **act):
    return (index, section, detail, base, delta, *[act.get(m, 0.0) for m in MUSCLES])


@pytest.fixture(scope="module")
def tables(spark):
    pool = [pool_row(0, "rest", "rest"), pool_row(1, "single", "GGP@0.30", GGP=0.3), pool_row(2, "neighbor", "dGGP+1", 1, "GGP+0.15", GGP=0.45), pool_row(3, "neighbor", "x", 99, "y", STY=0.2), pool_row(4, "pair", "p", GGP=0.9, HG=0.9)]
    pool += [pool_row(10 + i, "single", f"STY@{0.15 * (i + 1):.2f}", STY=0.15 * (i + 1)) for i in range(4)]
    pool += [pool_row(20 + i, "effort", f"effort:GH+GGA@{lv}", GH=lv, GGA=lv) for i, lv in enumerate((0.3, 0.6, 0.6, 0.9))]
    disp = [(0, [0.0] * 9), (1, [-1.0, 2.0, 2.236, 0.1, 0.1, 0.2, 0.0, 0.0, 0.0]), (2, [-1.02, 2.05, 2.3, 0.1, 0.1, 0.2, 0.0, 0.0, 0.0]), (3, [1.0, -1.0, 1.5, 0.0, 0.0, 1.5, 0.0, 0.0, 0.1])]
    disp += [(10 + i, [0.0, 0.0, float(r)] * 3) for i, r in enumerate((1, 2, 3, 4))] + [(20 + i, [0.0, 0.0, r] * 3) for i, r in enumerate((1.0, 3.0, 9.0, 2.0))]
    meta = [(r[0], "FAILED" if r[0] == 4 else "VALID", 1.0005) for r in pool]
    goal = [(t, "L", *[0.5 if m == "GGP" else 0.0 for m in MUSCLES]) for t in qa.TARGETS] + [("-", "x", *[1.0] * 11)]
    return (
        spark.createDataFrame(pool, POOL),
        spark.createDataFrame(meta, "index long, label string, vol_ratio double"),
        spark.createDataFrame(disp, "index long, rd array<double>"),
        spark.createDataFrame(goal, "ipa string, label_ko string, " + ", ".join(f"{m} double" for m in MUSCLES)),
    )


def test_physics_chain(tables):
    got = {r["index"]: r for r in qa.physics_chain(*tables, TEMPLATES).collect()}
    assert 0 not in got and 4 not in got and {1, 2, 3} <= set(got)
    one, two, three = (got[i] for i in (1, 2, 3))
    assert one.turn_types == ["A2", "D1", "C1", "B1", "prescriptive"]
    assert two.turn_types == ["A2", "D1", "C1", "B2", "prescriptive"] and "B2" not in three.turn_types
    said = [c.value for c in one.conversations]
    assert said[1] == "By genioglossus posterior (GGP): genioglossus posterior (GGP) does ggp."
    assert said[5] == "vol_ratio=1.000 front advance raise" or said[5] == "vol_ratio=1.001 front advance raise"
    assert said[7] == "front advance raise -1.00/2.00 0.10/0.10 0.00/0.00" and said[9] == "aL: more genioglossus posterior (GGP)"
    assert [c.value for c in two.conversations][7].startswith("negligible -0.02 0.05 #1")
    assert [c.value for c in three.conversations][5].endswith("front retract lower")
    assert one.mesh_ref.asDict() == {"verts_shard": 0, "row_in_shard": 1, "indices": None}
    for r in got.values():
        for c in r.conversations:
            for s in c.mask_spans or []:
                assert c.value[s.start : s.end] == s.value
    assert not any(s.value == "1" and s.type == "number" for s in two.conversations[7].mask_spans)


def test_dose_response_records(tables):
    pool, meta, disp, _ = tables
    got = {r.sweep_id: r for r in qa.dose_response_records(qa.sweeps(pool, meta.where("label = 'VALID'"), disp), TEMPLATES).collect()}
    assert set(got) == {"single|STY", "effort|GH+GGA"}
    sty, effort = got["single|STY"], got["effort|GH+GGA"]
    assert sty.sweep.tier == "strict" and sty.sweep.rho == 1.0 and sty.sweep.resp_mm == [1.0, 2.0, 3.0, 4.0]
    assert effort.sweep.levels == [0.3, 0.6, 0.9] and effort.sweep.resp_mm == [1.0, 3.0, 2.0] and effort.sweep.tier == "partial"
    assert effort.mesh_ref.indices == [20, 21, 23] and sty.conversations[1].value.startswith("S styloglossus (STY) 0.15->1.00mm")


def test_shape_descriptions(spark, tables):
    cols = ["cl_t", "cd_min", "peak_xn", "peak_z", "doming", "tilt", "h_front", "h_mid", "h_back", "arc_len", "curv_peak"]
    rows = [(1, True, 0.5, 0.125, 0.1, 0.1, 0.08, 0.0, 0.3, 0.3, 0.1, 1.2, 120.0), (2, False, *[math.nan] * 11)]
    got = qa.shape_descriptions(spark.createDataFrame(rows, "index long, feat_ok boolean, " + ", ".join(f"{c} double" for c in cols)), tables[1], TEMPLATES).collect()
    assert len(got) == 1 and got[0].turn_types == ["A1", "A1_place", "A1_curv"]
    assert [c.value for c in got[0].conversations][1::2] == ["mid cl_t=0.50 cd_min=0.125 front", "M", "curv_peak=120.0 s domed"]


def test_pool_parts(spark):
    n = {r.section: r["count"] for r in qa.enumerated_pool(spark).groupBy("section").count().collect()}
    assert n == {"rest": 1, "single": 66, "pair": 495}
    from pyspark.sql import functions as F

    v = spark.range(1).select(qa.clip_budget(F.array(*[F.lit(float(x)) for x in (1.5, 0.9, -1.0, 0.9)]), 2.0).alias("v")).first().v
    assert v == [0.6667, 0.6667, 0.0, 0.6667]


def test_records_write_and_resume(spark, tables, tmp_path):
    from corvid.sources.readers import mesh_ids, read_records
    from corvid.sources.writers import write_records
    from pyspark.sql import functions as F

    records = qa.physics_chain(*tables, TEMPLATES)
    path = f"file://{tmp_path}/qa"
    write_records(records, path)
    write_records(records, path)
    back = read_records(spark, f"{path}/*")
    assert back.count() == records.count()
    assert {r.ids[0] for r in back.select(mesh_ids(F.col("mesh_ref")).alias("ids")).collect()} == {r["index"] for r in records.collect()}
    line = next(p for p in tmp_path.rglob("part-*.json")).read_text(encoding="utf-8").splitlines()[0]
    assert json.loads(line)["scenario"] == "physics_chain"
