"""Question-answer records from simulated meshes: physics chains, shape descriptions, dose-response sweeps.

Texts come from a language's template file. All turns of a record are columns of one row: a turn that does
not apply is null and drops out, so a generator is a few joins and a projection.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from pathlib import Path

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.spans import SPAN, Vocabulary, spans_of
from ..functions.text import fixed, render
from ..functions.vocabulary import MUSCLES
from ..operators.index import shard_address
from ..operators.statistics import dose_response, first_argmax
from ..sources.scratch import shared_folder

REGION_NAMES = ("front", "mid", "back")
# Fixed values of the generators: targets in turn, and the limits of the texts' branches.
TARGETS = ("i", "a", "u", "t d s", "k g")
ACTIVE, CORRECTION, NEGLIGIBLE_MM = 0.05, 0.12, 0.1
FRONT_PLACE, MID_PLACE, SHARP, DOMED = 0.34, 0.67, 120, 0.08
LEAST_PAIRS = 3


def load_templates(path: str) -> dict:
    """A language's template file."""
    import yaml

    return yaml.safe_load(Path(path).read_text(encoding="utf-8"))


def vocabulary(templates: Mapping, part: str) -> Vocabulary:
    """What the tagger of a part of the templates looks for."""
    s = templates["spans"][part]
    return Vocabulary(
        list(templates["muscle_names"].values()),
        s["movement_words"],
        s["region_words"],
        [tuple(r) for r in s["number_roles"]],
        s.get("movement_mode", "find") == "word",
        s.get("region_mode", "find") == "word",
        int(s.get("context_chars", 12)),
    )


def _map(d: Mapping[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for kv in d.items() for x in kv])


def _turn(kind: str, q: Column, a: Column) -> Column:
    return F.struct(F.lit(kind).alias("type"), q.alias("q"), a.alias("a"))


def _names(muscles: Column, names: Column, sep: str) -> Column:
    return F.array_join(F.transform(muscles, lambda m: F.element_at(names, m)), sep)


def _where(holds: Sequence[tuple[str, Column]]) -> Column:
    return F.filter(F.array(*[F.when(cond, F.lit(name)) for name, cond in holds]), lambda x: x.isNotNull())


def _pair(q: str, a: str, spans: Column) -> Column:
    """A question and its answer with spans, as a conversation has them."""
    return F.array(F.struct(F.lit("human").alias("from"), F.col(q).alias("value"), F.lit(None).cast(SPAN).alias("mask_spans")), F.struct(F.lit("gpt").alias("from"), F.col(a).alias("value"), spans.alias("mask_spans")))


def _records(rows: DataFrame, scenario: str, lang: str, words: Vocabulary, extra: Sequence[str] = ()) -> DataFrame:
    """Rows with an array of turns as records; the answers of all turns are tagged in one Arrow pass."""
    turn = rows.select("index", *extra, F.posexplode("turns").alias("k", "t")).select("index", *extra, "k", "t.type", "t.q", "t.a", spans_of(F.col("t.a"), words).alias("spans"))
    said = F.struct("k", "type", _pair("q", "a", F.col("spans")).alias("pair"))
    g = turn.groupBy("index", *extra).agg(F.array_sort(F.collect_list(said)).alias("all"))
    return g.select("index", *extra, F.lit(scenario).alias("scenario"), F.lit(lang).alias("lang"), F.flatten(F.col("all.pair")).alias("conversations"), F.col("all.type").alias("turn_types"), F.lit(True).alias("verified"))


def physics_chain(pool: DataFrame, meta: DataFrame, displacement: DataFrame, targets: DataFrame, templates: Mapping) -> DataFrame:
    """Physics-chain records of valid meshes.

    displacement: index and rd, nine millimetres (dx, dz, magnitude of front, mid, back). targets: ipa, label_ko
    and activations. The base of a neighbour need not be valid; without a base in the table its turn is absent.
    """
    p, names, actions, words = templates["physics"], _map(templates["muscle_names"]), _map(templates["muscle_actions"]), templates["direction_words"]
    d = pool.join(meta.where("label = 'VALID'").select("index", "vol_ratio"), "index").join(displacement, "index")
    d = d.join(displacement.select(F.col("index").alias("base_index"), F.col("rd").alias("base_rd")), "base_index", "left")
    goal = targets.where(F.col("ipa").isin(*TARGETS)).select("ipa", "label_ko", F.array(*[F.col(m).cast("double") for m in MUSCLES]).alias("goal"))
    d = d.withColumn("ipa", F.element_at(F.array(*map(F.lit, TARGETS)), (F.col("index") % len(TARGETS)).cast("int") + 1)).join(F.broadcast(goal.dropDuplicates(["ipa"])), "ipa")
    rd = lambda i: F.get("rd", i)
    act = {m: F.col(m).cast("double") for m in MUSCLES}
    d = d.withColumns({"active": _where([(m, x > ACTIVE) for m, x in act.items()]), "region": first_argmax(REGION_NAMES, [rd(2), rd(5), rd(8)])})
    at = (F.array_position(F.array(*map(F.lit, REGION_NAMES)), F.col("region")).cast("int") - 1) * 3
    d = d.withColumns({"h": F.when(F.get("rd", at) < 0, words["advance"]).otherwise(words["retract"]), "v": F.when(F.get("rd", at + 1) > 0, words["raise"]).otherwise(words["lower"]), "dd": F.zip_with("rd", "base_rd", lambda x, y: x - y)})
    change = [F.abs(F.get("dd", 3 * k)) + F.abs(F.get("dd", 3 * k + 1)) for k in range(3)]
    d = d.withColumn("moved", first_argmax(REGION_NAMES, change))
    k = (F.array_position(F.array(*map(F.lit, REGION_NAMES)), F.col("moved")).cast("int") - 1) * 3
    d = d.withColumns({"ddx": F.get("dd", k), "ddz": F.get("dd", k + 1)})

    some, first = F.size("active") > 0, F.get("active", 0)
    shape = {"region": F.col("region"), "h": F.col("h"), "v": F.col("v")}
    t = p["attribution"]
    each = F.array_join(F.transform("active", lambda m: render(t["action_item"], {"muscle": F.element_at(names, m), "action": F.element_at(actions, m)})), t["action_sep"])
    attribution = _turn("A2", F.lit(t["q"]), render(t["a"], {"muscles": _names(F.col("active"), names, t["list_sep"]), "actions": each}))
    unknown = _turn("D1", F.lit(p["identifiability"]["q"]), F.lit(p["identifiability"]["a"]))
    volume = _turn("C1", F.lit(p["volume"]["q"]), render(p["volume"]["a"], shape | {"vol_ratio": fixed(F.col("vol_ratio"), 3)}))
    moves = {f"{r}_{a}": fixed(rd(3 * i + j), 2) for i, r in enumerate(REGION_NAMES) for j, a in enumerate(("dx", "dz"))}
    slots = shape | moves | {"muscle": F.element_at(names, first), "action": F.element_at(actions, first)}
    single = _turn("B1", render(p["single"]["q"], slots), render(p["single"]["a"], slots))
    t = p["counterfactual"]
    slots = {
        "delta": F.col("delta"),
        "base": F.col("base_index").cast("string"),
        "region": F.col("moved"),
        "h": F.when(F.col("ddx") > 0, words["retract"]).otherwise(words["advance"]),
        "v": F.when(F.col("ddz") > 0, words["raise"]).otherwise(words["lower"]),
        "dx": fixed(F.col("ddx"), 2),
        "dz": fixed(F.col("ddz"), 2),
    }
    small = F.abs("ddx") + F.abs("ddz") < NEGLIGIBLE_MM
    counterfactual = _turn("B2", render(t["q"], slots), F.when(small, render(t["a_negligible"], slots)).otherwise(render(t["a_effect"], slots)))
    t = p["prescriptive"]
    more = _where([(m, F.get("goal", i) - x > CORRECTION) for i, (m, x) in enumerate(act.items())])
    less = _where([(m, x - F.get("goal", i) > CORRECTION) for i, (m, x) in enumerate(act.items())])
    d = d.withColumns({"more": more, "less": less})
    listed = lambda c, prefix: F.when(F.size(c) > 0, F.concat(F.lit(prefix), _names(F.col(c), names, t["list_sep"])))
    body = F.concat_ws(t["part_sep"], listed("more", t["increase_prefix"]), listed("less", t["decrease_prefix"]))
    slots = {"target": F.col("ipa"), "label": F.coalesce("label_ko", F.lit("")), "body": F.when(body == "", t["already_close"]).otherwise(body)}
    prescriptive = _turn("prescriptive", render(t["q"], slots), render(t["a"], slots))
    turns = F.array(
        F.when(some, attribution),
        F.when(some, unknown),
        volume,
        F.when((F.col("section") == "single") & some, single),
        F.when((F.col("section") == "neighbor") & F.col("base_rd").isNotNull(), counterfactual),
        prescriptive,
    )
    rows = d.select("index", F.filter(turns, lambda x: x.isNotNull()).alias("turns")).where(F.size("turns") >= LEAST_PAIRS)
    return _with_reference(_records(rows, "physics_chain", templates["lang"], vocabulary(templates, "physics")))


def _with_reference(records: DataFrame) -> DataFrame:
    ref = F.struct(F.col("verts_shard").cast("int").alias("verts_shard"), F.col("row_in_shard").cast("int").alias("row_in_shard"), F.lit(None).cast("array<long>").alias("indices"))
    return shard_address(records, "index").withColumn("mesh_ref", ref).drop("row_in_shard")


def shape_descriptions(features: DataFrame, valid: DataFrame, templates: Mapping) -> DataFrame:
    """Three turns for each valid mesh whose features are ok."""
    t, c = templates["feature"], F.col
    d = features.where("feat_ok").join(valid.select("index"), "index", "left_semi")
    place = F.when(c("cl_t") < FRONT_PLACE, "front").when(c("cl_t") < MID_PLACE, "mid").otherwise("back")
    slots = {name: fixed(c(name).cast("double"), n) for name, n in (("cl_t", 2), ("cd_min", 3), ("peak_xn", 2), ("peak_z", 2), ("doming", 2), ("tilt", 2), ("h_front", 2), ("h_mid", 2), ("h_back", 2), ("arc_len", 2), ("curv_peak", 1))}
    slots |= {
        "place": F.element_at(_map(t["place_words"]), place),
        "place_example": F.element_at(_map(t["place_examples"]), place),
        "hi_reg": first_argmax(REGION_NAMES, [c("h_front"), c("h_mid"), c("h_back")]),
        "curv_word": F.when(c("curv_peak") < SHARP, t["curv_words"]["gentle"]).otherwise(t["curv_words"]["sharp"]),
        "doming_word": F.when(c("doming") < DOMED, t["doming_words"]["flat"]).otherwise(t["doming_words"]["domed"]),
    }
    turns = F.array(*[_turn(kind, F.lit(t[f"q{i}"]), render(t[f"a{i}"], slots)) for i, kind in ((1, "A1"), (2, "A1_place"), (3, "A1_curv"))])
    return _with_reference(_records(d.select("index", turns.alias("turns")), "shape_desc", templates["lang"], vocabulary(templates, "feature")))


def sweeps(pool: DataFrame, valid: DataFrame, displacement: DataFrame) -> DataFrame:
    """One row a level of each sweep: lead (a muscle, or a combination as written), level, resp in mm, index.

    Single-muscle levels keep duplicates; of an effort's equal levels the smallest index stays, and it needs 3 different ones.
    """
    mean = (F.get("rd", 2) + F.get("rd", 5) + F.get("rd", 8)) / 3
    d = pool.join(valid.select("index"), "index", "left_semi").join(displacement.select("index", mean.alias("resp")), "index")
    level = F.regexp_extract("detail", r"@([0-9.]+)", 1).try_cast("double")
    single = d.where("section = 'single'").select(F.lit("single").alias("kind"), F.nullif(F.regexp_extract("detail", r"([A-Z]+)@", 1), F.lit("")).alias("lead"), level.alias("level"), "resp", "index")
    effort = d.where("section = 'effort'").select(F.lit("effort").alias("kind"), F.nullif(F.regexp_extract("detail", r"effort:(.+)@", 1), F.lit("")).alias("lead"), level.alias("level"), "resp", "index")
    effort = effort.groupBy("kind", "lead", "level").agg(F.min_by("resp", "index").alias("resp"), F.min("index").alias("index"))
    return single.unionByName(effort).where("lead is not null and level is not null")


def dose_response_records(levels: DataFrame, templates: Mapping) -> DataFrame:
    """One record a sweep of at least 3 levels: a question over its range and an answer by its tier.

    The levels are written to the shared folder, since ranks and bins read them several times.
    """
    t, names = templates["b3"], _map(templates["muscle_names"])
    path = shared_folder(levels.sparkSession, "levels")
    levels.write.parquet(path)
    levels = levels.sparkSession.read.schema(levels.schema).parquet(path)
    d = levels.withColumns({"sweep_id": F.concat_ws("|", "kind", "lead"), "place": F.struct("level", "index")})
    tiers = dose_response(d.withColumnRenamed("resp", "_resp"), "sweep_id", "place", "_resp")
    lists = d.groupBy("sweep_id", "kind", "lead").agg(F.array_sort(F.collect_list(F.struct("level", "index", "resp"))).alias("steps"))
    j = lists.join(tiers.select("sweep_id", "rho", "monotonic", "tier"), "sweep_id")
    full = F.array_join(F.transform(F.split("lead", r"\+"), lambda m: F.coalesce(F.try_element_at(names, m), m)), " + ")
    seq = F.array_join(F.transform("steps", lambda s: render(t["seq_item"], {"lv": fixed(s["level"], 2), "resp": fixed(s["resp"], 2)})), t["seq_sep"])
    ends = {"lv0": fixed(F.col("steps")[0]["level"], 2), "lv1": fixed(F.element_at("steps", -1)["level"], 2)}
    q = F.when(F.col("kind") == "single", render(t["q_single"], ends | {"muscle": full})).otherwise(render(t["q_effort"], ends | {"muscles": full}))
    a = F.lit(None).cast("string")
    for tier in ("strict", "near", "partial"):
        a = F.when(F.col("tier") == tier, render(t[f"a_{tier}"], {"lead": full, "seq": seq, "rho": fixed(F.col("rho"), 2)})).otherwise(a)
    sweep = F.struct(F.transform("steps", lambda s: s["level"]).alias("levels"), F.transform("steps", lambda s: F.bround(s["resp"], 3)).alias("resp_mm"), F.bround("rho", 3).alias("rho"), "monotonic", "tier")
    # A sweep has one turn, and its lists may be long: no key of a group holds them, and what is not asked for is not rendered.
    rows = j.select("sweep_id", sweep.alias("sweep"), F.transform("steps", lambda s: s["index"]).alias("ids"), q.alias("q"), a.alias("a"))
    said = _pair("q", "a", spans_of(F.col("a"), vocabulary(templates, "feature")))
    out = rows.select(F.lit(None).cast("long").alias("index"), "sweep_id", "sweep", "ids", F.lit("dose_response").alias("scenario"), F.lit(templates["lang"]).alias("lang"), said.alias("conversations"), F.array(F.lit("B3")).alias("turn_types"), F.lit(True).alias("verified"))
    ref = F.struct(F.lit(None).cast("int").alias("verts_shard"), F.lit(None).cast("int").alias("row_in_shard"), F.col("ids").alias("indices"))
    return out.withColumn("mesh_ref", ref).drop("ids")


def design_problems(centers: DataFrame, anchors: DataFrame) -> DataFrame:
    """Anchors whose activations differ from the centre table's by more than 1e-9, with the largest difference."""
    a = anchors.select("ipa", F.array(*[F.col(m).cast("double") for m in MUSCLES]).alias("a"))
    c = centers.select("ipa", F.array(*[F.col(m).cast("double") for m in MUSCLES]).alias("c"))
    j = a.join(c, "ipa").select("ipa", F.array_max(F.zip_with("a", "c", lambda x, y: F.abs(x - y))).alias("difference"))
    return j.where("difference > 1e-9")


def clip_budget(act: Column, budget: float, largest: float = 0.9) -> Column:
    """Activations within [0, largest], scaled down to a total of at most the budget, rounded to 4 decimals."""
    inside = F.transform(act, lambda x: F.least(F.greatest(x, F.lit(0.0)), F.lit(largest)))
    total = F.aggregate(inside, F.lit(0.0), lambda s, x: s + x)
    return F.transform(inside, lambda x: F.bround(F.when(total > budget, x * budget / total).otherwise(x), 4))


def enumerated_pool(spark, levels: Sequence[float] = (0.15, 0.30, 0.45, 0.60, 0.75, 0.90), grid: Sequence[float] = (0.3, 0.6, 0.9)) -> DataFrame:
    """The fixed part of the pool: rest, each muscle at each level, each pair of muscles at each pair of grid levels."""
    m = spark.createDataFrame(list(enumerate(MUSCLES)), "i int, muscle string")
    lv = spark.createDataFrame([(float(x),) for x in levels], "level double")
    g = spark.createDataFrame([(float(x),) for x in grid], "level double")
    rest = spark.createDataFrame([("rest", "rest", [0.0] * len(MUSCLES))], "section string, detail string, act array<double>")
    vector = lambda *set_: F.transform(F.sequence(F.lit(0), F.lit(len(MUSCLES) - 1)), lambda k: F.coalesce(*[F.when(k == i, x) for i, x in set_], F.lit(0.0)))
    single = m.crossJoin(F.broadcast(lv)).select(F.lit("single").alias("section"), F.concat("muscle", F.lit("@"), fixed(F.col("level"), 2)).alias("detail"), vector((F.col("i"), F.col("level"))).alias("act"))
    a, b = m.crossJoin(F.broadcast(g)).toDF("i", "m", "x"), m.crossJoin(F.broadcast(g)).toDF("j", "n", "y")
    # Both sides are constants: 11 muscles at 3 levels.
    pair = a.join(F.broadcast(b), F.col("i") < F.col("j")).select(F.lit("pair").alias("section"), F.concat("m", F.lit("+"), "n").alias("detail"), vector((F.col("i"), F.col("x")), (F.col("j"), F.col("y"))).alias("act"))
    return rest.unionByName(single).unionByName(pair)
