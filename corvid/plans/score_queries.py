"""Queries of the scores, generators and lookups. Their items are built from the provided tables by fixed rules.

An item's gold and answer follow from its key, so the expected scores can be written in SQL without a parser,
while the library parses the answers' text.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import vocabulary as V
from ..functions.parsers import corrections_of, directions_of, muscle_mentions
from ..operators import facts, mesh, metrics, probe, records
from . import evaluation, qa, scoring
from .queries import query, table

_NAMES = list(V.FULL_NAMES["en"].values())
_VERBS = ["advance", "retract", "raise", "lower", "increases", "flattened", "domed", "preserved", "negligible"]
_REGIONS = ["front", "mid", "back"]


def _list(words) -> str:
    return "[" + ", ".join("'" + str(w).replace("'", "''") + "'" for w in words) + "]"


def _pick(words, at: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, words)), (at % len(words)).cast("int") + 1)


def _sql_pick(words, at: str) -> str:
    return f"{_list(words)}[CAST(1 + ({at}) % {len(words)} AS INT)]"


def _orders(spark, d, *more):
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("k"), *more)


_m = lambda at: _pick(V.MUSCLES, at)
_sm = lambda at: _sql_pick(V.MUSCLES, at)


class _Key:
    """The column k, made when it is used, since a column needs a session."""

    def __getattr__(self, name):
        return getattr(F.col("k"), name)

    def __mod__(self, other):
        return F.col("k") % other

    def __add__(self, other):
        return F.col("k") + other

    def __mul__(self, other):
        return F.col("k") * other


k = _Key()

# Muscles, values, directions, corrections, axes


def _muscle_items(spark, d):
    second = F.when(k % 5 == 0, _m(k)).when(k % 7 == 0, _m(k + 4)).otherwise(_m(k + 3))
    return _orders(spark, d).select(F.concat(F.lit("m"), k.cast("string")).alias("uid"), _pick(["1", "2", "3+"], k).alias("n_act_bin"), F.array(_m(k), _m(k + 3)).alias("gold_muscles"), F.concat(F.lit("The active muscles are "), _m(k), F.lit(" and "), second, F.lit(".")).alias("pred"))


_MUSCLES_SQL = f"""m AS (SELECT o_orderkey AS k, {_sql_pick(["1", "2", "3+"], "o_orderkey")} AS n_act_bin, [{_sm("o_orderkey")}, {_sm("o_orderkey + 3")}] AS g,
list_distinct([{_sm("o_orderkey")}, CASE WHEN o_orderkey % 5 = 0 THEN {_sm("o_orderkey")} WHEN o_orderkey % 7 = 0 THEN {_sm("o_orderkey + 4")} ELSE {_sm("o_orderkey + 3")} END]) AS p FROM orders),
mc AS (SELECT *, len(list_intersect(g, p)) AS tp, len(p) - len(list_intersect(g, p)) AS fp, len(g) - len(list_intersect(g, p)) AS fn FROM m)"""
_PRF = """round(CASE WHEN tp + fp = 0 THEN 0 ELSE tp / (tp + fp) END, 6) AS precision, round(CASE WHEN tp + fn = 0 THEN 0 ELSE tp / (tp + fn) END, 6) AS recall,
round(CASE WHEN tp = 0 THEN 0 ELSE 2 * (tp / (tp + fp)) * (tp / (tp + fn)) / (tp / (tp + fp) + tp / (tp + fn)) END, 6) AS f1"""
_SUMS = "CAST(sum(tp) AS BIGINT) AS tp, CAST(sum(fp) AS BIGINT) AS fp, CAST(sum(fn) AS BIGINT) AS fn"


@query(f"WITH {_MUSCLES_SQL}, s AS (SELECT n_act_bin, {_SUMS} FROM mc GROUP BY n_act_bin) SELECT n_act_bin, tp, fp, fn, {_PRF} FROM s")
def q_muscle_answers(spark, d):
    return probe.score_muscles(_muscle_items(spark, d))


@query(f"WITH {_MUSCLES_SQL} SELECT 'm' || k AS uid, array_to_string(list_sort(p), ',') AS muscles FROM m")
def q_muscle_mentions(spark, d):
    return _muscle_items(spark, d).select("uid", F.array_join(F.array_sort(muscle_mentions(F.col("pred"))), ",").alias("muscles"))


def _value_items(spark, d):
    o = _orders(spark, d, (F.floor(F.col("o_totalprice") / 10) / 100).alias("gold_value"))
    said = F.when(k % 13 == 0, "ambiguous").otherwise(F.concat(F.lit("about "), T.fixed(F.col("gold_value") + (k % 7 - 3), 2), F.lit(" mm")))
    unit, quantity = F.when(k % 3 == 0, "norm").otherwise("mm"), F.when(k % 2 == 0, "cd_min").otherwise("length")
    tol = F.when(k % 11 == 0, 2.5)
    return o.select(F.concat(F.lit("v"), k.cast("string")).alias("uid"), "gold_value", said.alias("pred"), unit.alias("unit"), quantity.alias("quantity"), tol.alias("tol"))


_VALUES_SQL = """v AS (SELECT o_orderkey AS k, floor(o_totalprice / 10) / 100 AS gold, CASE WHEN o_orderkey % 13 = 0 THEN NULL ELSE CAST(printf('%.2f', floor(o_totalprice / 10) / 100 + (o_orderkey % 7 - 3)) AS DOUBLE) END AS said,
CASE WHEN o_orderkey % 11 = 0 THEN 2.5::DOUBLE WHEN o_orderkey % 2 = 0 THEN 0.03::DOUBLE WHEN o_orderkey % 3 = 0 THEN 0.1::DOUBLE ELSE 2::DOUBLE END AS tol FROM orders)"""


@query(f"WITH {_VALUES_SQL} SELECT 'v' || k AS uid, said AS pred_value, coalesce(abs(said - gold) <= tol, false) AS correct FROM v")
def q_value_answers(spark, d):
    i = _value_items(spark, d)
    tol = probe.value_tolerance(F.col("tol"), F.lit(None).cast("double"), F.col("quantity"), F.col("unit"))
    return probe.score_values(i, tol).select("uid", "pred_value", "correct")


def _region_items(spark, d):
    x, y = _pick(["advance", "retract", "raise"], k), F.when(k % 4 < 2, "retract").otherwise("preserve")
    text = F.concat(F.lit("tip: "), x, F.lit("; body: "), y, F.lit("; root: lower; dorsum: raise"))
    body = F.when(k % 2 == 0, "preserve").otherwise("retract")
    gold = F.create_map(F.lit("tip"), F.array(F.lit("advance")), F.lit("body"), F.array(body), F.lit("root"), F.array(F.lit("descend")), F.lit("dorsum"), F.array(F.lit("elevate")))
    return _orders(spark, d).select(F.concat(F.lit("r"), k.cast("string")).alias("uid"), text.alias("pred"), gold.alias("gold_directions"))


_REGIONS_SQL = """r AS (SELECT o_orderkey AS k, (o_orderkey % 3 = 0)::INT AS tip, (o_orderkey % 3 = 1)::INT AS against, ((o_orderkey % 2 = 0) = (o_orderkey % 4 >= 2))::INT AS body FROM orders),
rs AS (SELECT 'r' || k AS uid, 4::BIGINT AS n_regions, CAST(tip + body + 2 AS BIGINT) AS n_right, CAST(against AS BIGINT) AS n_against, tip + body = 2 AS correct FROM r)"""


@query(f"WITH {_REGIONS_SQL} SELECT * FROM rs")
def q_region_answers(spark, d):
    return probe.score_regions(_region_items(spark, d))


@query("""SELECT 'r' || o_orderkey AS uid, ['advance', 'retract', 'elevate'][CAST(1 + o_orderkey % 3 AS INT)] AS tip, CASE WHEN o_orderkey % 4 < 2 THEN 'retract' ELSE 'preserve' END AS body, 'descend' AS root, 'elevate' AS dorsum FROM orders""")
def q_direction_parsers(spark, d):
    i = _region_items(spark, d).withColumn("s", directions_of(F.col("pred")))
    return i.select("uid", *[F.array_join(F.element_at("s", r), "+").alias(r) for r in V.REGIONS])


_FORMS = ["contract {a}; relax {b}", "{a}↑, {b}↓", "increase {a} and decrease {b}", "relax {b}; contract {a}"]


def _correction_items(spark, d):
    off = F.when(k % 4 == 0, _m(k + 6)).otherwise(_m(k + 5))
    form = (k.cast("long") / 5).cast("long") % len(_FORMS)
    text = F.lit(None).cast("string")
    for i, f in enumerate(_FORMS):
        text = F.when(form == i, T.render(f, {"a": _m(k), "b": off})).otherwise(text)
    return _orders(spark, d).select(F.concat(F.lit("c"), k.cast("string")).alias("uid"), F.array(_m(k)).alias("gold_inc"), F.array(_m(k + 5)).alias("gold_dec"), text.alias("pred"))


_CORRECTIONS_SQL = f"""c AS (SELECT o_orderkey AS k, {_sm("o_orderkey")} AS a, {_sm("o_orderkey + 5")} AS b, CASE WHEN o_orderkey % 4 = 0 THEN {_sm("o_orderkey + 6")} ELSE {_sm("o_orderkey + 5")} END AS b2 FROM orders),
cs AS (SELECT CAST(sum(1 + (b = b2)::INT) AS BIGINT) AS tp, CAST(sum((b <> b2)::INT) AS BIGINT) AS fp, CAST(sum((b <> b2)::INT) AS BIGINT) AS fn, count(*) AS n, CAST(count_if(b = b2) AS BIGINT) AS n_exact FROM c)"""


@query(f"WITH {_CORRECTIONS_SQL} SELECT 'c' || k AS uid, array_to_string(list_sort([a || ':inc', b2 || ':dec']), ',') AS pairs FROM c")
def q_answer_parsers(spark, d):
    """Corrections in four forms of answer, every pair of muscles in each."""
    said = F.map_entries(corrections_of(F.col("pred")))
    return _correction_items(spark, d).select("uid", F.array_join(F.array_sort(F.transform(said, lambda e: F.concat(e["key"], F.lit(":"), e["value"]))), ",").alias("pairs"))


@query(f"WITH {_CORRECTIONS_SQL} SELECT tp, fp, fn, {_PRF}, n, n_exact FROM cs")
def q_correction_answers(spark, d):
    return probe.score_corrections(_correction_items(spark, d))


def _axis_items(spark, d):
    said = _pick(["the front moves: advance", "the front moves: retract and raise", "the front moves: lower"], k)
    gold = F.when((k.cast("long") / 3).cast("long") % 2 == 0, F.array(F.lit("advance"))).otherwise(F.array(F.lit("elevate"), F.lit("retract")))
    return _orders(spark, d).select(F.concat(F.lit("b"), k.cast("string")).alias("uid"), said.alias("pred"), gold.alias("gold_concepts"), F.lit("tip").alias("dominant_region"), (k % 6).cast("double").alias("mag_mm"))


_AXES_SQL = """b AS (SELECT o_orderkey AS k, CASE WHEN o_orderkey % 6 < 2 THEN 'weak' END AS skipped, CASE WHEN o_orderkey // 3 % 2 = 0 THEN 1 ELSE 2 END AS n_axes,
CASE WHEN o_orderkey // 3 % 2 = 0 THEN (o_orderkey % 3 = 0)::INT ELSE CASE WHEN o_orderkey % 3 = 1 THEN 2 ELSE 0 END END AS n_right FROM orders),
bs AS (SELECT 'b' || k AS uid, skipped, n_axes, n_right, CASE WHEN skipped IS NULL THEN n_axes = n_right END AS correct FROM b)"""


@query(f"WITH {_AXES_SQL} SELECT * FROM bs")
def q_axis_answers(spark, d):
    return probe.score_axes(_axis_items(spark, d))


def _probe_items(spark, d):
    none = {"n_act_bin": "string", "gold_muscles": "array<string>", "gold_value": "double", "unit": "string", "quantity": "string", "tol": "double", "gold_directions": "map<string,array<string>>", "gold_inc": "array<string>", "gold_dec": "array<string>", "gold_concepts": "array<string>", "dominant_region": "string", "mag_mm": "double"}
    abstain = _orders(spark, d).select(F.concat(F.lit("a"), k.cast("string")).alias("uid"), F.when(k % 3 == 0, "contract GGP").otherwise("It cannot be determined from this.").alias("pred"))
    utility = abstain.select(F.concat(F.lit("u"), "uid").alias("uid"), "pred")
    parts = [(_muscle_items, "muscle_set", None), (_value_items, "value", None), (_region_items, "direction", "rest_desc"), (_correction_items, "direction", "prescription"), (_axis_items, "direction", "axes")]
    of_kind = {"prescription": F.when(F.crc32(F.col("uid").cast("binary")) % 2 == 0, "prescriptive").otherwise("correction"), "axes": F.when(F.col("mag_mm") == 3, "b2").when(F.col("mag_mm") != 4, "unheard of")}
    frames = [(f(spark, d), family, kind) for f, family, kind in parts] + [(abstain, "abstention", None), (utility, "utility", None)]
    out = None
    for df, family, kind in frames:
        cols = [F.col(c) if c in df.columns else F.lit(None).cast(t).alias(c) for c, t in none.items()]
        own = df.select("uid", F.lit(family).alias("family"), of_kind.get(kind, F.lit(kind).cast("string")).alias("kind"), "pred", *cols)
        out = own if out is None else out.unionByName(own)
    return out


_PROBE_SQL = f"""WITH {_MUSCLES_SQL}, {_VALUES_SQL}, {_CORRECTIONS_SQL}, {_AXES_SQL},
ms AS (SELECT {_SUMS} FROM mc), mf AS (SELECT *, {_PRF} FROM ms),
va AS (SELECT count(*) AS n, avg(coalesce(abs(said - gold) <= tol, false)::INT) AS accuracy FROM v),
cf AS (SELECT *, {_PRF} FROM cs), ba AS (SELECT count(*) AS n, avg(correct::INT) AS accuracy FROM bs WHERE skipped IS NULL),
ab AS (SELECT count_if(o_orderkey % 3 <> 0) AS tp, count_if(o_orderkey % 13 = 0) AS fp, count_if(o_orderkey % 3 = 0) AS fn FROM orders),
af AS (SELECT *, {_PRF} FROM ab),
sh AS (SELECT sum(t) AS tp, sum(2 - t) AS fp, sum(2 - t) AS fn FROM (SELECT len(list_intersect(g, [{_sm("k + 1")}, {_sm("k + 3")}])) AS t FROM m)),
sf AS (SELECT round(2 * (tp / (tp + fp)) * (tp / (tp + fn)) / (tp / (tp + fp) + tp / (tp + fn)), 6) AS f1 FROM sh),
o AS (SELECT 'Muscle F1' AS name, f1 AS value FROM mf UNION ALL SELECT 'Value acc', accuracy FROM va UNION ALL SELECT 'Direction acc', 2 * tp / (2 * tp + fp + fn) FROM cs
UNION ALL SELECT 'B2-sign', accuracy FROM ba UNION ALL SELECT 'B2-sign n', n FROM ba UNION ALL SELECT 'Abstention F1', f1 FROM af
UNION ALL SELECT 'Δ_shuf', mf.f1 - sf.f1 FROM mf, sf)
SELECT name, round(value, 5) AS value FROM o"""


@query(_PROBE_SQL)
def q_probe_headline(spark, d):
    """All families scored by one call, and what the answers under another mesh lose."""
    shuffled = _muscle_items(spark, d).withColumns({"family": F.lit("muscle_set"), "pred": F.concat(F.lit("The active muscles are "), _m(F.substring("uid", 2, 20).cast("long") + 1), F.lit(" and "), _m(F.substring("uid", 2, 20).cast("long") + 3))})
    s = scoring.score_probe(_probe_items(spark, d), "en", shuffled)
    return s.where("metric = 'headline'").select("name", F.round("value", 5).alias("value"))


@query("""SELECT CAST(count_if(o_orderkey % 3 <> 0) AS BIGINT) AS tp, CAST(count_if(o_orderkey % 13 = 0) AS BIGINT) AS fp, CAST(count_if(o_orderkey % 3 = 0) AS BIGINT) AS fn FROM orders""")
def q_probe_abstentions(spark, d):
    """Abstention items beside answerable ones that should not be refused."""
    return probe.score_abstentions(_probe_items(spark, d), scoring.abstained("en")).select("tp", "fp", "fn")


@query(f"""WITH {_REGIONS_SQL}, {_AXES_SQL}, x AS (SELECT avg(correct::INT) AS x FROM bs WHERE skipped IS NULL UNION ALL SELECT sum(n_right) / sum(n_regions) FROM rs) SELECT 'parts' AS part, round(avg(x), 6) AS direction FROM x""")
def q_direction_headline(spark, d):
    h = probe.headline(None, probe.score_axes(_axis_items(spark, d)), probe.score_regions(_region_items(spark, d)))
    return h.select("part", F.round("direction", 6).alias("direction"))


# Facts of texts


def _span(kind: str, value: Column) -> Column:
    return F.struct(F.lit(kind).alias("type"), value.alias("value"), F.lit(0).alias("start"), F.lit(0).alias("end"), F.lit(None).cast("string").alias("role"))


def _fact_items(spark, d):
    x = T.fixed((k % 50) / 10 + 1, 2)
    y = T.fixed((k % 50) / 10 + 1 + F.when(k % 3 == 0, 0.01).otherwise(0.0) + F.when(k % 7 == 0, 1.0).otherwise(0.0), 2)
    text = T.render("{m} contracts: the {r} region will {v}, dx {x}", {"m": _pick(_NAMES, k + F.when(k % 4 == 0, 1).otherwise(0)), "r": _pick(_REGIONS, k + F.when(k % 5 == 0, 1).otherwise(0)), "v": _pick(_VERBS, k + F.when(k % 6 == 0, 1).otherwise(0)), "x": y})
    spans = F.array(_span("muscle", _pick(_NAMES, k)), _span("region", _pick(_REGIONS, k)), _span("movement", _pick(_VERBS, k)), _span("number", x))
    return _orders(spark, d).select("k", _pick(["A1", "C1", "D1"], k).alias("turn_type"), spans.alias("gold_spans"), text.alias("pred"))


_FACTS_SQL = """f AS (SELECT o_orderkey AS k, o_orderkey % 4 <> 0 AS muscle, o_orderkey % 5 <> 0 AS region, o_orderkey % 6 <> 0 AS movement, o_orderkey % 3 <> 0 AND o_orderkey % 7 <> 0 AS number,
o_orderkey % 7 <> 0 OR 1 + (o_orderkey % 3 = 0)::INT * 0.01 <= 0.02 * ((o_orderkey % 50) / 10 + 1) AS number_tol, ['A1', 'C1', 'D1'][CAST(1 + o_orderkey % 3 AS INT)] AS turn_type FROM orders{0}),
fl AS (UNPIVOT f ON muscle, region, movement, number, number_tol INTO NAME category VALUE ok),
fs AS (SELECT category, CAST(count_if(ok) AS BIGINT) AS tp, CAST(count_if(NOT ok) AS BIGINT) AS fp FROM fl GROUP BY category),
fm AS (SELECT * FROM fs UNION ALL SELECT 'micro', CAST(sum(tp) AS BIGINT), CAST(sum(fp) AS BIGINT) FROM fs WHERE category <> 'number_tol')"""


@query(f"""WITH {_FACTS_SQL.format("")} SELECT category, tp, fp, fp AS fn, round(tp / (tp + fp), 6) AS f1 FROM fm
UNION ALL SELECT 'macro', NULL, NULL, NULL, round(avg(tp / (tp + fp)), 6) FROM fs WHERE category <> 'number_tol'""")
def q_mask_f1(spark, d):
    return facts.mask_f1(_fact_items(spark, d), "en").withColumn("f1", F.round("f1", 6))


@query(f"""WITH {_FACTS_SQL.format("")}, o AS (SELECT 'val/mask_f1' AS name, tp / (tp + fp) AS value FROM fm WHERE category = 'micro'
UNION ALL SELECT 'val/mask_precision', tp / (tp + fp) FROM fm WHERE category = 'micro' UNION ALL SELECT 'val/mask_recall', tp / (tp + fp) FROM fm WHERE category = 'micro'
UNION ALL SELECT 'val/mask_f1_' || category, tp / (tp + fp) FROM fs WHERE category <> 'number_tol'
UNION ALL SELECT 'val/abstention_f1', 0 UNION ALL SELECT 'val/abstain_rate', 0 UNION ALL SELECT 'val/n_gen_samples', count(*) FROM orders
UNION ALL SELECT 'val/pred_chars', avg(length({_sql_pick(_NAMES, "o_orderkey + (o_orderkey % 4 = 0)::INT")}) + length({_sql_pick(_REGIONS, "o_orderkey + (o_orderkey % 5 = 0)::INT")}) + length({_sql_pick(_VERBS, "o_orderkey + (o_orderkey % 6 = 0)::INT")}) + 38) FROM orders)
SELECT name, round(value, 5) AS value FROM o""")
def q_validation_map(spark, d):
    items = _fact_items(spark, d).withColumn("should_abstain", k % 9 == 0)
    return scoring.validation_map(items, "en").withColumn("value", F.round("value", 5))


@query("""WITH opposite AS (SELECT * FROM (VALUES ('advance', 'retract'), ('elevate', 'descend'), ('inc', 'dec'), ('flat', 'arch')) t(a, b)), pairs AS (SELECT a, b FROM opposite UNION ALL SELECT b, a FROM opposite),
c AS (SELECT o_orderkey AS k, ['advance', 'retract', 'elevate', 'descend', 'inc', 'flat', 'arch', 'preserve', 'negligible'] AS names FROM orders),
i AS (SELECT k, names[CAST(1 + k % 9 AS INT)] AS gold, names[CAST(1 + (k + (k % 6 = 0)::INT) % 9 AS INT)] AS said FROM c)
SELECT count(b) AS n, CAST(count_if(b IS NOT NULL AND gold = said) AS BIGINT) AS correct, CAST(count_if(b = said) AS BIGINT) AS contradictions, CAST(count_if(b IS NULL) AS BIGINT) AS skipped FROM i LEFT JOIN pairs ON gold = a""")
def q_direction_accuracy(spark, d):
    """All concepts that have an opposite, answers that say the gold, another concept or the opposite."""
    return facts.direction_accuracy(_fact_items(spark, d), "en")


_TRENDS = ["monotonically increases", "saturation", "reversal"]


@query(f"""WITH x AS (SELECT ['monotonic', 'saturating', 'reversal'][CAST(1 + o_orderkey % 3 AS INT)] AS gold, {_sql_pick(["monotonic", "saturating", "reversal", "none"], "o_orderkey")} AS pred FROM orders) SELECT gold, pred, count(*) AS n FROM x GROUP BY gold, pred""")
def q_trend_confusion(spark, d):
    items = _orders(spark, d).select(F.array(_span("movement", _pick(_TRENDS, k))).alias("gold_spans"), F.concat(F.lit("The response shows "), _pick([*_TRENDS, "nothing"], k)).alias("pred"))
    return facts.trend_confusion(items, "en")


@query("SELECT o_orderkey AS k, CAST((o_orderkey % 3 = 0)::INT + (o_orderkey % 4 = 0)::INT AS INT) AS n_untaggable FROM orders")
def q_untaggable(spark, d):
    spans = F.array(_span("movement", F.when(k % 3 == 0, "wobbles").otherwise("raise")), _span("region", F.when(k % 4 == 0, "edge").otherwise("mid")), _span("muscle", F.lit("any")))
    return _orders(spark, d).select("k", facts.untaggable(spans, "en").alias("n_untaggable"))


@query("""WITH t AS (SELECT 't' || o_orderkey % 2 AS turn_type, printf('%.1f', (o_orderkey % 40) / 10) AS a, printf('%.1f', (o_orderkey % 3) / 10) AS b FROM orders WHERE o_orderkey % 4 <> 0 AND o_orderkey % 10 <> 3),
n AS (SELECT turn_type, count(*) AS n_turns FROM t GROUP BY turn_type), h AS (SELECT turn_type, value, count(*) AS n FROM (SELECT turn_type, a AS value FROM t UNION ALL SELECT turn_type, b FROM t WHERE b <> a) GROUP BY turn_type, value)
SELECT h.turn_type, value, round(n / n_turns, 6) AS df FROM h JOIN n ON h.turn_type = n.turn_type WHERE n / n_turns >= 0.04 AND n_turns >= 100""")
def q_boilerplate_numbers(spark, d):
    """The share of a turn type's answers that hold a number."""
    none = F.lit(None).cast("array<struct<type: string, value: string, start: int, end: int, role: string>>")
    spans = F.array(_span("number", T.fixed((k % 40) / 10, 1)), _span("number", T.fixed((k % 3) / 10, 1)))
    talk = F.array(F.struct(F.lit("human").alias("from"), F.lit("q").alias("value"), none.alias("mask_spans")), F.struct(F.lit("gpt").alias("from"), F.lit("a").alias("value"), spans.alias("mask_spans")))
    recs = _orders(spark, d).select(F.concat(F.lit("f"), (k % 3).cast("string")).alias("file"), k.alias("line"), F.when(k % 4 == 0, 1).alias("variant"), k.alias("first_id"), F.array(F.concat(F.lit("t"), (k % 2).cast("string"))).alias("turn_types"), talk.alias("conversations"))
    train = _orders(spark, d).where(k % 10 != 3).select(k.alias("index"))
    return facts.number_df(recs, train, least_share=0.04, least_turns=100, per_file=1 << 40).withColumn("df", F.round("df", 6))


@query("""SELECT 'additive' AS kind, o_orderkey AS k, ['+', '-', '0', '?'][CAST(1 + o_orderkey % 4 AS INT)] AS sign FROM orders""")
def q_sign_of(spark, d):
    said = _pick(["It is super-additive, not additive.", "The pair is subadditive; roughly linear", "equal to the sum", "no idea"], k)
    return _orders(spark, d).select(F.lit("additive").alias("kind"), "k", facts.sign_of(said).alias("sign"))


# Paraphrases, jobs and predictions


def _paraphrase_records(spark, d):
    turn = lambda who, value: F.struct(F.lit(who).alias("from"), value.alias("value"))
    talk = F.array(turn("system", F.lit("s")), turn("human", F.concat(F.lit("q"), k.cast("string"))), turn("gpt", F.concat(F.lit("moves "), (k % 90).cast("string"), F.lit(" mm"))), turn("gpt", F.lit("more")), turn("human", F.lit("and?")), turn("gpt", F.lit("raise it")))
    return _orders(spark, d).select(F.lit("f").alias("file"), k.alias("line"), talk.alias("conversations"))


@query("""SELECT 'f' AS file, o_orderkey AS line, t.turn, v.variant, ['plain', 'formal', 'short'][CAST(1 + v.variant % 3 AS INT)] AS style, CASE t.turn WHEN 2 THEN 'q' || o_orderkey ELSE 'and?' END AS q FROM orders, (SELECT unnest([2, 5]) AS turn) t, (SELECT unnest([0, 1, 2, 3]) AS variant) v""")
def q_paraphrase_jobs(spark, d):
    return evaluation.paraphrase_jobs(_paraphrase_records(spark, d), ["plain", "formal", "short"], 4).select("file", "line", "turn", "variant", "style", "q")


_OUTPUTS = ["<Q>new q</Q>\n<A>it goes {x} mm</A>", 'Sure:\n{"q": "new q", "a": "it goes {x} mm"}', "no tags at all", "<Q>new q</Q><A>it goes far</A>"]


@query("""SELECT o_orderkey AS k, CASE WHEN o_orderkey % 4 <> 2 THEN 'new q' END AS q, CASE o_orderkey % 4 WHEN 3 THEN 'it goes far' WHEN 2 THEN NULL ELSE 'it goes ' || o_orderkey % 90 || ' mm' END AS a FROM orders""")
def q_parse_output(spark, d):
    text = F.replace(_pick(_OUTPUTS, k), F.lit("{x}"), (k % 90).cast("string"))
    return _orders(spark, d).select("k", evaluation.parse_output(text).alias("o")).select("k", "o.q", "o.a")


#: Outputs whose question keeps its number, the last but one excepted, and whose answer keeps its own in the first two and the last but one.
_REWRITES = ["<Q>new q{k}</Q>\n<A>it goes {x} mm</A>", 'Sure:\n{"q": "new q{k}", "a": "it goes {x} mm"}', "no tags at all", "<Q>new q</Q><A>it goes {x} mm</A>", "<Q>new q{k}</Q><A>it goes far</A>"]


def _rewrite(texts, line: Column) -> Column:
    return F.replace(F.replace(_pick(texts, line), F.lit("{k}"), line.cast("string")), F.lit("{x}"), (line % 90).cast("string"))


@query("""WITH f AS (SELECT o_orderkey AS k, o_orderkey % 5 < 2 OR o_orderkey % 3 = 1 AS ok FROM orders)
SELECT k AS line, CASE WHEN ok THEN 'it goes ' || k % 90 || ' mm' ELSE 'moves ' || k % 90 || ' mm' END AS a, ok AS faithful FROM f""")
def q_accepted_paraphrases(spark, d):
    """Outputs of two attempts; the first one with a faithful question and answer is taken, else the original stays."""
    jobs = evaluation.paraphrase_jobs(_paraphrase_records(spark, d), ["plain"], 1).where("turn = 2")
    keys = ["file", "line", "turn", "variant"]
    first = jobs.select(*keys, F.lit(1).alias("attempt"), _rewrite(_REWRITES, F.col("line")).alias("text"))
    again = jobs.where("line % 3 = 1").select(*keys, F.lit(2).alias("attempt"), _rewrite(_REWRITES[:1], F.col("line")).alias("text"))
    out = evaluation.accepted(jobs, first.unionByName(again), V.FULL_NAMES["en"], {})
    return out.select("line", "a", "faithful")


@query("""WITH f AS (SELECT o_orderkey AS k, CASE WHEN o_orderkey % 5 < 2 THEN 0 WHEN (o_orderkey + 1) % 5 < 2 THEN 1 WHEN (o_orderkey + 2) % 5 < 2 THEN 2 END AS round FROM orders)
SELECT k AS line, CASE WHEN round IS NULL THEN 'q' || k ELSE 'new q' || k END AS q, CASE WHEN round IS NULL THEN 'moves ' || k % 90 || ' mm' ELSE 'it goes ' || k % 90 || ' mm' END AS a, round IS NOT NULL AS faithful FROM f""")
def q_rewritten_rounds(spark, d):
    """Three rounds of a generator whose outputs depend on the attempt; only jobs without a faithful output are asked again."""
    jobs = evaluation.paraphrase_jobs(_paraphrase_records(spark, d), ["plain"], 1).where("turn = 2")

    def generate(asked):
        text = F.replace(F.replace(_pick(_REWRITES, F.col("line") + F.col("attempt")), F.lit("{k}"), F.col("line").cast("string")), F.lit("{x}"), (F.col("line") % 90).cast("string"))
        return asked.withColumn("text", text)

    return evaluation.rewritten(jobs, generate, V.FULL_NAMES["en"], {}).select("line", "q", "a", "faithful")


@query("""WITH j AS (SELECT conv_id, turn FROM (SELECT *, count(*) FILTER (WHERE role = 'user') OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS u FROM conversations) WHERE role = 'assistant' AND u > 0)
SELECT conv_id, turn, CASE WHEN turn % 3 = 0 THEN '' WHEN turn % 2 = 0 THEN 'second ' || conv_id ELSE 'first ' || conv_id END AS pred FROM j""")
def q_saved_predictions(spark, d):
    """Jobs of turns with saved predictions; the last one saved wins, none is ''."""
    turns = table(spark, d, "conversations")
    jobs = evaluation.turn_jobs(turns).select("conv_id", "turn")
    saved = lambda at, n, word: turns.where(f"turn % 3 <> 0 {n}").select("conv_id", "turn", F.concat(F.lit(word), F.col("conv_id").cast("string")).alias("pred"), F.lit(at).alias("at"))
    return evaluation.with_predictions(jobs, saved(1, "", "first ").unionByName(saved(2, "and turn % 2 = 0", "second ")), ["conv_id", "turn"], "at")


@query(f"""SELECT 'm' || o_orderkey AS uid, {_sm("o_orderkey")} || ', ' || {_sm("o_orderkey + 3")} AS reference FROM orders UNION ALL SELECT 'c' || o_orderkey, '↑ ' || {_sm("o_orderkey")} || '; ↓ ' || {_sm("o_orderkey + 5")} FROM orders
UNION ALL SELECT 'r' || o_orderkey, 'body=' || CASE WHEN o_orderkey % 2 = 0 THEN 'preserve' ELSE 'retract' END || '; dorsum=elevate; root=descend; tip=advance' FROM orders
UNION ALL SELECT 'a' || o_orderkey, 'ABSTAIN' FROM orders UNION ALL SELECT 'ua' || o_orderkey, 'given' FROM orders""")
def q_reference_answers(spark, d):
    i = _probe_items(spark, d).where("family <> 'value' and not startswith(uid, 'b')")
    i = i.withColumns({"reference_answer": F.when(F.col("family") == "utility", "given"), "gold_text": F.lit(" "), "gold_kind": F.when(F.col("kind").isin("prescriptive", "correction"), "correction"), "should_abstain": F.col("family") == "abstention"})
    return i.select("uid", records.reference_answer(i).alias("reference"))


# Activations, heads and lookups

_ACTS = [f"CASE WHEN {i} = o_orderkey % 11 OR {i} = o_orderkey * 7 % 11 THEN (1 + (o_orderkey + {i}) % 9) / 10 ELSE 0 END" for i in range(11)]


def _acts(spark, d):
    at = lambda i: F.when((k % 11 == i) | (k * 7 % 11 == i), (1 + (k + i) % 9) / 10).otherwise(0.0)
    return _orders(spark, d).select(k.alias("index"), *[at(i).alias(m) for i, m in enumerate(V.MUSCLES)])


@query(f"""SELECT o_orderkey AS k, CASE WHEN o_orderkey % 5 = 0 THEN 0 ELSE round(list_sum([{", ".join(_ACTS)}]), 6) END AS total FROM orders""")
def q_dense_activations(spark, d):
    """Activations of all ids in a fixed order of muscles; ids without a row are zeros."""
    a = records.activations(_acts(spark, d).where("index % 5 <> 0"), _acts(spark, d).select("index"))
    return a.select(F.col("index").alias("k"), F.round(F.aggregate("act", F.lit(0.0), lambda s, x: s + x), 6).alias("total"))


@query(f"""SELECT o_orderkey AS index, total FROM (SELECT o_orderkey, round({" + ".join(f"({a})" for a in _ACTS)}, 6) AS total FROM orders) ORDER BY total DESC, index LIMIT 1""")
def q_largest_total(spark, d):
    a = _acts(spark, d)
    rounded = a.select("index", F.round(sum((F.col(m) for m in V.MUSCLES[1:]), F.col(V.MUSCLES[0])), 6).alias("sum"))
    return records.largest_total(rounded, "index", ["sum"])


def _pool(spark, d):
    """A pool of single and effort rows: orders whose key gives the muscle, the level and the section."""
    level = T.fixed((k % 9 + 1) / 10, 2)
    single = F.concat(_m(k), F.lit("@"), level)
    effort = F.concat(F.lit("effort:"), _m(k), F.lit("+"), _m(k + 2), F.lit("@"), level)
    section = F.when(k % 3 == 0, "effort").when(k % 3 == 1, "single").otherwise("anchor")
    detail = F.when(k % 3 == 0, effort).when(k % 3 == 1, single).otherwise(F.concat(F.lit("anchor:"), _m(k)))
    return _orders(spark, d, "o_totalprice").select(k.alias("index"), section.alias("section"), detail.alias("detail"), F.when(k % 4 != 0, (k % 5).cast("int")).alias("n_active"), "o_totalprice")


@query("""SELECT o_orderkey AS index, ['effort', 'single', 'anchor'][CAST(1 + o_orderkey % 3 AS INT)] AS section, CASE WHEN o_orderkey % 3 <> 2 THEN (o_orderkey % 9 + 1) / 10 END AS effort, CAST(CASE WHEN o_orderkey % 4 <> 0 THEN o_orderkey % 5 ELSE 0 END AS INT) AS n_active FROM orders""")
def q_row_facts(spark, d):
    return records.row_facts(_pool(spark, d))


def _regional(spark, d):
    mm = lambda x: F.floor(F.col("o_totalprice") * x / 1000)
    return _pool(spark, d).select("index", F.array(*[mm(x).cast("double") for x in (1, 2, 3, 2, 1, 6, 3, 3, 9)]).alias("rd"))


_SWEEP_SQL = f"""p AS (SELECT o_orderkey AS index, o_orderkey % 3 AS s, {_sm("o_orderkey")} AS m, {_sm("o_orderkey + 2")} AS m2, (o_orderkey % 9 + 1) / 10 AS level, (floor(o_totalprice * 3 / 1000) + floor(o_totalprice * 6 / 1000) + floor(o_totalprice * 9 / 1000)) / 3 AS resp FROM orders WHERE o_orderkey % 7 <> 0),
sw AS (SELECT 'single' AS kind, m AS lead, level, resp, index FROM p WHERE s = 1 UNION ALL SELECT 'effort', m || '+' || m2, level, arg_min(resp, index), min(index) FROM p WHERE s = 0 GROUP BY m, m2, level)"""


@query(f"WITH {_SWEEP_SQL} SELECT kind, lead, level, round(resp, 4) AS resp, index FROM sw")
def q_sweeps(spark, d):
    """Levels of single-muscle and effort sweeps of valid meshes."""
    valid = _orders(spark, d).where(k % 7 != 0).select(k.alias("index"))
    s = qa.sweeps(_pool(spark, d), valid, _regional(spark, d))
    return s.select("kind", "lead", "level", F.round("resp", 4).alias("resp"), "index")


_B3 = {"lang": "en", "muscle_names": {m: m.lower() for m in V.MUSCLES}, "spans": {"feature": {"movement_words": ["rises"], "region_words": ["front"], "number_roles": []}}, "b3": {"seq_item": "{lv}:{resp}", "seq_sep": " ", "q_single": "How does {muscle} act from {lv0} to {lv1}?", "q_effort": "How do {muscles} act from {lv0} to {lv1}?", "a_strict": "{lead} strict {rho}", "a_near": "{lead} near {rho}", "a_partial": "{lead} partial {rho}"}}


@query(f"""WITH {_SWEEP_SQL}, g AS (SELECT kind, lead, count(*) AS n, min(level) AS a, max(level) AS b FROM sw GROUP BY kind, lead HAVING count(*) >= 3)
SELECT kind || '|' || lead AS sweep_id, 'How ' || CASE kind WHEN 'single' THEN 'does ' ELSE 'do ' END || replace(lower(lead), '+', ' + ') || ' act from ' || printf('%.2f', a) || ' to ' || printf('%.2f', b) || '?' AS question, CAST(n AS INT) AS n_levels FROM g""")
def q_sweep_questions(spark, d):
    valid = _orders(spark, d).where(k % 7 != 0).select(k.alias("index"))
    r = qa.dose_response_records(qa.sweeps(_pool(spark, d), valid, _regional(spark, d)), _B3)
    return r.select("sweep_id", F.get("conversations", F.lit(0))["value"].alias("question"), F.size("sweep.levels").alias("n_levels"))


_A1 = {"lang": "en", "spans": {"feature": {"movement_words": [], "region_words": ["front", "mid", "back"], "number_roles": []}}, "muscle_names": {}, "feature": {"place_words": {"front": "alveolar", "mid": "palatal", "back": "velar"}, "place_examples": {"front": "t", "mid": "j", "back": "k"}, "curv_words": {"gentle": "gentle", "sharp": "sharp"}, "doming_words": {"flat": "flat", "domed": "domed"}, "q1": "shape?", "a1": "{hi_reg} {cd_min} {curv_peak}", "q2": "place?", "a2": "{place} like {place_example} at {cl_t}", "q3": "curve?", "a3": "{curv_word} {doming_word}"}}


@query("""WITH x AS (SELECT p_partkey AS index, (p_partkey % 100) / 100 AS t, p_partkey % 7 AS a, p_partkey % 5 AS b, p_partkey % 3 AS c, p_size * 5 AS curv FROM part WHERE p_partkey % 4 <> 0 AND p_partkey % 9 <> 0)
SELECT index, CASE WHEN a >= b AND a >= c THEN 'front' WHEN b >= c THEN 'mid' ELSE 'back' END || ' ' || printf('%.3f', (index % 100) / 50) || ' ' || printf('%.1f', curv::DOUBLE) AS a1,
CASE WHEN t < 0.34::DOUBLE THEN 'alveolar like t' WHEN t < 0.67::DOUBLE THEN 'palatal like j' ELSE 'velar like k' END || ' at ' || printf('%.2f', t) AS a2,
CASE WHEN curv < 120 THEN 'gentle' ELSE 'sharp' END || ' ' || CASE WHEN index % 2 = 0 THEN 'flat' ELSE 'domed' END AS a3, index // 1000 AS verts_shard FROM x""")
def q_shape_texts(spark, d):
    """Three answers about the shape of every valid mesh with features."""
    p = F.col("p_partkey")
    f = table(spark, d, "part").select(p.alias("index"), (p % 4 != 0).alias("feat_ok"), ((p % 100) / 100).alias("cl_t"), ((p % 100) / 50).alias("cd_min"), (F.col("p_size") * 5.0).alias("curv_peak"), F.when(p % 2 == 0, 0.01).otherwise(0.5).alias("doming"), *[F.lit(0.0).alias(c) for c in ("peak_xn", "peak_z", "tilt", "arc_len")], (p % 7).cast("double").alias("h_front"), (p % 5).cast("double").alias("h_mid"), (p % 3).cast("double").alias("h_back"))
    r = qa.shape_descriptions(f, f.where("index % 9 <> 0").select("index"), _A1)
    said = lambda i: F.get("conversations", F.lit(i))["value"]
    return r.select("index", said(1).alias("a1"), said(3).alias("a2"), said(5).alias("a3"), "verts_shard")


_PHYSICS = {"lang": "en", "muscle_names": {m: m.lower() for m in V.MUSCLES}, "muscle_actions": {m: f"pulls {m.lower()}" for m in V.MUSCLES}, "direction_words": {"advance": "forward", "retract": "backward", "raise": "up", "lower": "down"}, "spans": {"physics": {"movement_words": ["forward"], "region_words": ["front"], "number_roles": []}}, "physics": {"attribution": {"q": "which?", "a": "{muscles}: {actions}", "action_item": "{muscle} {action}", "action_sep": "; ", "list_sep": ", "}, "identifiability": {"q": "only?", "a": "no"}, "volume": {"q": "volume?", "a": "{region} {h} {v} {vol_ratio}"}, "single": {"q": "{muscle}?", "a": "{action} {front_dx}"}, "counterfactual": {"q": "{delta} of {base}?", "a_effect": "{region} {h} {v} {dx} {dz}", "a_negligible": "nothing"}, "prescriptive": {"q": "to {target}?", "a": "{body}", "list_sep": ", ", "part_sep": "; ", "increase_prefix": "more ", "decrease_prefix": "less ", "already_close": "close"}}}


@query(f"""WITH p AS (SELECT o_orderkey AS index, [{", ".join(_ACTS)}] AS act, o_totalprice FROM orders WHERE o_orderkey % 6 <> 0),
x AS (SELECT index, list_filter(range(1, 12), lambda i: act[i] > 0.05) AS on_, floor(o_totalprice / 1000) AS r1, ['i', 'a', 'u', 't d s', 'k g'][CAST(1 + index % 5 AS INT)] AS ipa,
list_filter(range(1, 12), lambda i: 0.5 - act[i] > 0.12::DOUBLE) AS more, list_filter(range(1, 12), lambda i: act[i] - 0.5 > 0.12::DOUBLE) AS less, o_totalprice FROM p)
SELECT index, array_to_string(list_transform(on_, lambda i: lower({_list(V.MUSCLES)}[i])), ', ') AS names, 'back ' || 'backward ' || CASE WHEN floor(o_totalprice * 3 / 1000) > 0 THEN 'up ' ELSE 'down ' END || printf('%.3f', (index % 10) / 8) AS volume, 'to ' || ipa || '?' AS target,
concat_ws('; ', CASE WHEN len(more) > 0 THEN 'more ' || array_to_string(list_transform(more, lambda i: lower({_list(V.MUSCLES)}[i])), ', ') END, CASE WHEN len(less) > 0 THEN 'less ' || array_to_string(list_transform(less, lambda i: lower({_list(V.MUSCLES)}[i])), ', ') END) AS advice FROM x""")
def q_physics_texts(spark, d):
    """Which muscles act, what the tongue does, and how to get to a target, for every valid mesh."""
    o = _orders(spark, d, "o_totalprice")
    pool = _acts(spark, d).join(o.select(k.alias("index")), "index").withColumns({"section": F.lit("anchor"), "base_index": F.lit(-1).cast("long"), "delta": F.lit(None).cast("string")})
    meta = o.select(k.alias("index"), F.when(k % 6 == 0, "FAILED").otherwise("VALID").alias("label"), ((k % 10) / 8).alias("vol_ratio"))
    half = [F.lit(0.5).alias(m) for m in V.MUSCLES]
    targets = spark.createDataFrame([(t, t) for t in qa.TARGETS], "ipa string, label_ko string").select("ipa", "label_ko", *half)
    r = qa.physics_chain(pool, meta, _regional(spark, d), targets, _PHYSICS)
    said = lambda i: F.get("conversations", F.lit(i))["value"]
    return r.select("index", F.substring_index(said(1), ":", 1).alias("names"), said(5).alias("volume"), said(6).alias("target"), said(7).alias("advice"))


@query("""SELECT 'a' || p_partkey AS ipa, round(abs((p_partkey % 7) / 10 - (p_partkey % 7) / 10 - CASE WHEN p_partkey % 8 = 0 THEN 0.25 ELSE 0 END), 9) AS difference FROM part WHERE p_partkey % 8 = 0 AND p_partkey % 10 <> 0""")
def q_design_problems(spark, d):
    """Anchors that differ from the table of centres."""
    p = F.col("p_partkey")
    one = lambda more: [((p % 7) / 10 + (more if m == "GGP" else 0.0)).alias(m) for m in V.MUSCLES]
    name = F.concat(F.lit("a"), p.cast("string")).alias("ipa")
    parts = table(spark, d, "part")
    centers = parts.where(p % 10 != 0).select(name, *one(0.0))
    return qa.design_problems(centers, parts.select(name, *one(F.when(p % 8 == 0, 0.25).otherwise(0.0)))).withColumn("difference", F.round("difference", 9))


@query("""WITH r AS (SELECT p_partkey, list_transform(range(0, 11), lambda i: least(greatest((p_partkey * (i + 1) % 17 - 4) / 10, 0), 0.9)) AS a FROM part)
SELECT p_partkey, round(list_sum(list_transform(a, lambda x: CASE WHEN list_sum(a) > 2 THEN x * 2 / list_sum(a) ELSE x END)), 2) AS total, round(list_max(a), 4) AS largest FROM r""")
def q_clip_budget(spark, d):
    p = F.col("p_partkey")
    raw = F.array(*[(p * (i + 1) % 17 - 4) / 10 for i in range(11)])
    clipped = table(spark, d, "part").select("p_partkey", qa.clip_budget(raw, 2.0).alias("a"), qa.clip_budget(raw, 100.0).alias("b"))
    return clipped.select("p_partkey", F.round(F.aggregate("a", F.lit(0.0), lambda s, x: s + x), 2).alias("total"), F.round(F.array_max("b"), 4).alias("largest"))


@query(f"""WITH m AS (SELECT unnest(range(0, 11)) AS i, unnest({_list(V.MUSCLES)}) AS m), l AS (SELECT unnest([0.15, 0.30, 0.45, 0.60, 0.75, 0.90]) AS v), g AS (SELECT unnest([0.3, 0.6, 0.9]) AS v),
e AS (SELECT 'rest' AS section, 'rest' AS detail, 0::BIGINT AS n, 0.0::DOUBLE AS total UNION ALL SELECT 'single', m || '@' || printf('%.2f', v), 1, round(v, 4)::DOUBLE FROM m, l
UNION ALL SELECT 'pair', a.m || '+' || b.m, 2, round(x.v + y.v, 4)::DOUBLE FROM m a, m b, g x, g y WHERE a.i < b.i),
p AS (SELECT a.m || '@' || printf('%.2f', 0.15 * (1 + p_size % 6)) AS detail, count(*) AS parts FROM part JOIN m a ON a.i = p_partkey % 11 GROUP BY 1)
SELECT section, e.detail, n, total, coalesce(parts, 0) AS parts FROM e LEFT JOIN p ON e.detail = p.detail""")
def q_enumerated_pool(spark, d):
    """The enumerated part of a pool, and how many parts ask for each of its rows."""
    e = qa.enumerated_pool(spark)
    e = e.select("section", "detail", F.size(F.filter("act", lambda x: x > 0)).cast("long").alias("n"), F.round(F.aggregate("act", F.lit(0.0), lambda s, x: s + x), 4).alias("total"))
    asked = F.concat(_pick(V.MUSCLES, F.col("p_partkey")), F.lit("@"), T.fixed(0.15 * (1 + F.col("p_size") % 6), 2))
    parts = table(spark, d, "part").groupBy(asked.alias("detail")).agg(F.count(F.lit(1)).alias("parts"))
    return e.join(parts, "detail", "left").withColumn("parts", F.coalesce("parts", F.lit(0)))


_HEADS = "SELECT l_orderkey AS index, l_linenumber AS muscle, max(CASE WHEN l_tax > 0.04 THEN l_tax ELSE 0 END) AS gold, max(l_discount) AS pred FROM lineitem GROUP BY l_orderkey, l_linenumber"


def _heads(spark, d):
    c = F.col
    g = table(spark, d, "lineitem").groupBy(c("l_orderkey").alias("index"), c("l_linenumber").alias("muscle"))
    return g.agg(F.max(F.when(c("l_tax") > 0.04, c("l_tax")).otherwise(0.0)).alias("gold"), F.max("l_discount").alias("pred"))


@query(f"""WITH x AS ({_HEADS}), e AS (SELECT index, bool_and((gold > 0.055) = (gold > 1e-4)) AS ok, count_if(gold > 1e-4 AND gold <= 0.055) AS lost, count_if(gold > 1e-4) AS n FROM x GROUP BY index)
SELECT 0.055::DOUBLE AS threshold, round(avg(ok::INT), 6) AS muscle_em, CAST(sum(lost) AS BIGINT) AS n_active_lost, CAST(sum(n) AS BIGINT) AS n_active_entries FROM e""")
def q_scorer_ceiling(spark, d):
    return scoring.scorer_ceiling(_heads(spark, d), 0.055).withColumn("muscle_em", F.round("muscle_em", 6))


@query(f"WITH x AS ({_HEADS}) SELECT 'h' AS row_id, muscle, count(*) AS n, round(avg(abs(pred - gold)), 6) AS l1 FROM x GROUP BY muscle")
def q_muscle_errors(spark, d):
    e = scoring.per_muscle_errors(_heads(spark, d).withColumn("row_id", F.lit("h")))
    return e.withColumn("l1", F.round("l1", 6))


@query(f"""WITH x AS ({_HEADS}), e AS (SELECT index, bool_and((pred > 0.05) = (gold > 1e-4)) AS ok, count_if(pred > 0.05 AND gold > 1e-4) AS tp, count_if(pred > 0.05 AND gold <= 1e-4) AS fp, count_if(pred <= 0.05 AND gold > 1e-4) AS fn FROM x GROUP BY index)
SELECT 'h' AS row_id, count(*) AS n, CAST(count_if(ok) AS BIGINT) AS n_exact, round(avg(ok::INT), 6) AS em, round(2 * sum(tp) / (2 * sum(tp) + sum(fp) + sum(fn)), 6) AS f1 FROM e""")
def q_head_scores(spark, d):
    """Exact-set scores after the gold was found equal to the probe's."""
    long = _heads(spark, d).withColumn("row_id", F.lit("h"))
    items = long.where("gold > 1e-4").groupBy("index").agg(F.collect_set("muscle").alias("muscles"))
    every = long.select("index").distinct().join(items, "index", "left").withColumn("muscles", F.coalesce("muscles", F.expr("cast(array() as array<int>)")))
    s = scoring.score_heads(long, every, 0.05)
    return s.select("row_id", "n", "n_exact", F.round("em", 6).alias("em"), F.round("f1", 6).alias("f1"))


@query(f"""WITH x AS ({_HEADS}), a AS (SELECT index, list_sort(list(muscle) FILTER (WHERE gold > 1e-4)) AS l, list_sort(list(muscle) FILTER (WHERE pred > 0.05)) AS r FROM x GROUP BY index)
SELECT index, coalesce(array_to_string(l, ','), '') AS l, coalesce(array_to_string(r, ','), '') AS r FROM a WHERE l IS DISTINCT FROM r""")
def q_unequal_sets(spark, d):
    h = _heads(spark, d)
    sets = lambda cond: h.groupBy("index").agg(F.collect_set(F.when(cond, F.col("muscle"))).alias("muscles"))
    u = records.unequal_sets(sets(F.col("gold") > 1e-4), sets(F.col("pred") > 0.05), "index", "muscles")
    show = lambda c: F.array_join(F.transform(c, lambda x: x.cast("string")), ",")
    return u.select("index", show("left").alias("l"), show("right").alias("r"))


@query("""WITH c AS (SELECT l_returnflag, l_discount AS grid, round(avg(l_quantity), 6) AS value FROM lineitem GROUP BY ALL) SELECT l_returnflag, arg_min(grid, abs(grid - 0.034) * 1000 + grid / 1000) AS grid, arg_min(value, abs(grid - 0.034) * 1000 + grid / 1000) AS value FROM c GROUP BY l_returnflag""")
def q_nearest_grid(spark, d):
    curve = table(spark, d, "lineitem").groupBy("l_returnflag", F.col("l_discount").alias("grid")).agg(F.round(F.avg("l_quantity"), 6).alias("value"))
    return records.nearest_grid(curve, "grid", "value", 0.034, ["l_returnflag"])


@query("""WITH f AS (SELECT source, row_number() OVER (ORDER BY source) - 1 AS r FROM (SELECT DISTINCT source FROM documents)) SELECT doc_id, d.source FROM documents d JOIN f ON d.source = f.source WHERE r % 3 = 1""")
def q_file_stride(spark, d):
    return records.file_stride(table(spark, d, "documents").select("doc_id", "source"), "source", 3, 1)


@query("""WITH f AS (SELECT p_partkey, row_number() OVER (ORDER BY md5(p_partkey::VARCHAR), p_partkey) - 1 AS r, count(*) OVER () AS n FROM part WHERE p_size > 25), k AS (SELECT unnest(range(0, 5000)) AS k)
SELECT CAST(k AS INT) AS k, p_partkey FROM k JOIN f ON k % n = r""")
def q_assign_unused(spark, d):
    parts = table(spark, d, "part")
    return records.assign_unused(5000, parts, parts.where("p_size <= 25"), "p_partkey")


@query("SELECT conv_id, turn FROM conversations WHERE role <> 'system' AND turn % 3 IN (0, 1) AND conv_id % 4 <> 0")
def q_record_filter(spark, d):
    """Records of wanted scenarios, variants and faithfulness; what a record doesn't say has its default."""
    c = table(spark, d, "conversations")
    r = c.select("conv_id", "turn", F.col("role").alias("scenario"), F.when(F.col("turn") % 3 != 0, (F.col("turn") % 3).cast("int")).alias("variant"), F.when(F.col("conv_id") % 4 == 0, False).alias("nat_all_faithful"))
    return records.record_filter(r, ["system"], [0, 1], True).select("conv_id", "turn")


@query("SELECT s_suppkey FROM supplier WHERE s_suppkey % 4 NOT IN (0, 1) AND s_nationkey % 3 <> 0")
def q_named_anchors(spark, d):
    s = F.col("s_suppkey")
    ipa = F.when(s % 4 == 0, F.lit(" - ")).when(s % 4 == 1, F.lit(None).cast("string")).otherwise("i")
    c = table(spark, d, "supplier").select("s_suppkey", ipa.alias("ipa"), F.when(F.col("s_nationkey") % 3 == 0, "functional").alias("category"))
    return records.named_anchors(c).select("s_suppkey")


@query("SELECT o_orderkey, o_custkey, o_totalprice FROM orders WHERE o_orderkey = 77")
def q_point_lookup(spark, d):
    return records.lookup(table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_totalprice"), "o_orderkey", 77)


@query("""WITH t AS (SELECT conv_id, string_agg('<' || role || '>' || text || '</>', '' ORDER BY turn) AS text, list(struct_pack(r := role, n := length(text)) ORDER BY turn) AS l FROM conversations GROUP BY conv_id),
p AS (SELECT conv_id, text, unnest(range(1, len(l) + 1)) AS i, l FROM t),
s AS (SELECT conv_id, l[i].r AS r, coalesce(list_sum(list_transform(l[1:i - 1], lambda x: length(x.r) + x.n + 5)), 0) + length(l[i].r) + 2 AS begin_, l[i].n AS n FROM p)
SELECT conv_id, CAST(sum(begin_) AS BIGINT) AS starts, CAST(sum(begin_ + n) AS BIGINT) AS ends, count(*) AS n FROM s WHERE r = 'assistant' GROUP BY conv_id""")
def q_chat_spans(spark, d):
    """Where the assistants' texts stand in the rendered conversations."""
    turns = table(spark, d, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", F.col("text").alias("value")))).alias("t"))
    spans = turns.select("conv_id", F.explode(records.chat(F.col("t"), "<{role}>", "</>")["spans"]).alias("s"))
    return spans.groupBy("conv_id").agg(F.sum("s.start").cast("long").alias("starts"), F.sum("s.end").cast("long").alias("ends"), F.count(F.lit(1)).alias("n"))


@query("""WITH t AS (SELECT conv_id, list(struct_pack(r := role, t := text) ORDER BY turn) AS l FROM conversations GROUP BY conv_id),
u AS (SELECT conv_id, l, list_max([i for i in range(1, len(l) + 1) if l[i].r = 'user']) AS last FROM t),
p AS (SELECT conv_id, l, last, unnest(range(1, len(l) + 1)) AS i FROM u),
s AS (SELECT conv_id, l[i].r AS r, l[i].t AS t, coalesce(list_sum([length(l[j].t) + 14 + CASE WHEN j = last THEN 9 ELSE 0 END for j in range(1, i)]), 0) + 6 AS begin_ FROM p)
SELECT conv_id, CAST(sum(begin_) AS BIGINT) AS starts, CAST(sum(begin_ + length(t)) AS BIGINT) AS ends, CAST(sum(CASE WHEN length(t) >= 3 THEN begin_ END) AS BIGINT) AS facts FROM s WHERE r = 'assistant' GROUP BY conv_id""")
def q_chat_facts(spark, d):
    """Texts behind numbered headers and a slot of three tokens, found again in the chat, with a right and two wrong facts each."""
    turns = table(spark, d, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", F.col("text").alias("value")))).alias("t"))
    plain = F.transform("t", lambda t: F.struct(t["role"].alias("role"), t["value"].alias("value")))
    slot = turns.select("conv_id", records.with_slot(plain, "<m>", 3).alias("t"))
    text = F.concat_ws("", F.transform("t", lambda t: F.concat(F.lit("<turn>"), t["value"], F.lit("</turn>\n"))))
    fact = lambda kind, value, a, b: F.struct(F.lit(kind).alias("type"), value.alias("value"), F.lit(a).alias("start"), F.lit(b).alias("end"))
    said = F.transform(F.filter("t", lambda t: t["role"] == "assistant"), lambda t: F.array(fact("number", F.substring(t["value"], 1, 3), 0, 3), fact("other", F.substring(t["value"], 1, 3), 0, 3), fact("number", F.lit("\u0000"), 1, 2)))
    placed = slot.select("conv_id", text.alias("chat"), "t", said.alias("said")).withColumn("places", records.located(F.col("chat"), F.col("t")))
    kept = F.flatten(records.facts_in_chat(F.col("chat"), F.col("places"), F.col("said"), ["number"]))
    add = lambda c, field: F.aggregate(c, F.lit(0).cast("long"), lambda s, x: s + x[field])
    out = placed.where("size(places) > 0").select("conv_id", add(F.col("places"), "start").alias("starts"), add(F.col("places"), "end").alias("ends"), kept.alias("kept"))
    return out.select("conv_id", "starts", "ends", F.when(F.size("kept") > 0, add(F.col("kept"), "start")).alias("facts"))


@query("SELECT l_returnflag, sqrt(sum(CAST(l_quantity AS DOUBLE) * CAST(l_quantity AS DOUBLE))) AS norm FROM lineitem GROUP BY l_returnflag")
def q_l2_norm(spark, d):
    rows = table(spark, d, "lineitem").select("l_returnflag", F.col("l_quantity").cast("double").alias("g"))
    return metrics.l2_norm(rows, "g", ["l_returnflag"])


@query("""WITH a AS (SELECT l_orderkey, list(l_linenumber % 2 ORDER BY l_linenumber, l_suppkey, l_partkey, l_quantity, l_extendedprice) AS t FROM lineitem GROUP BY l_orderkey),
b AS (SELECT l_orderkey, list_filter(range(0, len(t)), lambda i: i + 2 <= len(t) AND t[i + 1] = 1 AND t[i + 2] = 1) AS places FROM a) SELECT l_orderkey, CAST(coalesce(places[1], -1) AS INT) AS slot FROM b""")
def q_slot_start(spark, d):
    """Where two equal tokens first follow each other."""
    t = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_suppkey", "l_partkey", "l_quantity", "l_extendedprice"))).alias("s"))
    return t.select("l_orderkey", records.slot_start(F.transform("s", lambda x: x["l_linenumber"] % 2), 1, 2).alias("slot"))


# Meshes


def _verts(spark, d):
    c = F.col
    lines = table(spark, d, "lineitem").groupBy(c("l_orderkey").alias("index"), c("l_linenumber").cast("long").alias("vertex"))
    return lines.agg(F.max("l_quantity").alias("x"), F.max("l_discount").alias("y"), F.max("l_tax").alias("z"))


_VERTS = "vt AS (SELECT l_orderkey AS index, CAST(l_linenumber AS BIGINT) AS vertex, max(l_quantity) AS x, max(l_discount) AS y, max(l_tax) AS z FROM lineitem GROUP BY ALL), dp AS (SELECT index, vertex, x - vertex AS dx, y - 0.5 AS dy, z - 0.25 AS dz FROM vt)"


def _rest(spark):
    return spark.createDataFrame([(v, float(v), 0.5, 0.25) for v in range(1, 8)], "vertex long, x double, y double, z double")


@query(f"WITH {_VERTS} SELECT index, vertex, round(dx, 6) AS dx, round(dy, 6) AS dy, round(dz, 6) AS dz FROM dp")
def q_displacement(spark, d):
    return mesh.displacement(_verts(spark, d), _rest(spark)).select("index", "vertex", *[F.round(a, 6).alias(a) for a in ("dx", "dy", "dz")])


@query(f"""WITH {_VERTS}, r AS (SELECT index, CASE WHEN vertex <= 2 THEN 'tip' ELSE 'body' END AS region, dx, dy, dz FROM dp)
SELECT index, region, round(-avg(dx) * 1000, 1) + 0 AS forward, round(avg(dz) * 1000, 1) + 0 AS up, round(avg(sqrt(dx * dx + dy * dy + dz * dz)) * 1000, 2) AS size FROM r GROUP BY index, region""")
def q_region_motion(spark, d):
    masks = spark.createDataFrame([(v, "tip" if v <= 2 else "body") for v in range(1, 8)], "vertex long, region string")
    m = probe.region_motion(mesh.displacement(_verts(spark, d), _rest(spark)), masks)
    return m.select("index", "region", (F.round("forward_mm", 1) + 0).alias("forward"), (F.round("up_mm", 1) + 0).alias("up"), F.col("mean_mag_mm").alias("size"))


@query("""SELECT l_orderkey AS index, round(sum(round(l_discount - 0.02, 6) * l_quantity) / sum(l_quantity), 12) + 0 AS vol_ratio, min(round(l_discount - 0.02, 6)) + 0 AS min_elem_vol, CAST(count_if(round(l_discount - 0.02, 6) <= 0) AS BIGINT) AS n_inverted FROM lineitem GROUP BY l_orderkey""")
def q_element_quality(spark, d):
    e = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("index"), F.round(F.col("l_discount") - 0.02, 6).alias("ratio"), F.col("l_quantity").alias("volume"))
    return mesh.element_quality(e).withColumns({"vol_ratio": F.round("vol_ratio", 12) + 0, "min_elem_vol": F.col("min_elem_vol") + 0})


@query("""SELECT l_orderkey AS index, round(max(sqrt(l_quantity * l_quantity + l_tax * l_tax + 1)) FILTER (WHERE l_discount > 0.01), 6) AS max_vel, bool_or(l_discount <= 0.01) AS has_nan FROM lineitem GROUP BY l_orderkey""")
def q_node_state(spark, d):
    c = F.col
    n = table(spark, d, "lineitem").select(c("l_orderkey").alias("index"), F.when(c("l_discount") <= 0.01, F.lit(float("nan"))).otherwise(c("l_quantity")).alias("vx"), c("l_tax").alias("vy"), F.lit(1.0).alias("vz"))
    return mesh.node_state(n).withColumn("max_vel", F.round("max_vel", 6))


@query("""SELECT l_orderkey, bool_and(l_discount > 0.005) AS finite FROM lineitem GROUP BY l_orderkey""")
def q_finite_rows(spark, d):
    x = F.when(F.col("l_discount") <= 0.005, F.lit(float("nan"))).otherwise(F.col("l_discount"))
    a = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.collect_list(x).alias("v"))
    return a.select("l_orderkey", mesh.all_finite(F.col("v")).alias("finite"))


@query("""SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, round(least(greatest(CASE WHEN l_discount = 0 THEN 8 ELSE 0.3 / 0.7 * (1 - l_discount) / l_discount END, 1), 8), 6) AS weight, CAST(least(l_quantity, greatest(1, ceil(l_quantity * 0.25))) AS BIGINT) AS n_spans FROM lineitem""")
def q_loss_weights(spark, d):
    c = F.col
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", F.round(mesh.loss_weight(c("l_discount"), 0.3, 8), 6).alias("weight"), mesh.subset_size(c("l_quantity").cast("long"), 0.25).cast("long").alias("n_spans"))


@query("""SELECT vec_id, round(list_sum(list_transform([3, 1, 4, 1, 5], lambda i: embedding[i + 1]::DOUBLE)), 5) AS total, 5::INT AS n FROM embeddings""")
def q_spiral_gather(spark, d):
    rows = F.transform("embedding", lambda x: F.array(x.cast("double")))
    s = table(spark, d, "embeddings").select("vec_id", mesh.spiral_gather(rows, F.array(*map(F.lit, [3, 1, 4, 1, 5]))).alias("g"))
    return s.select("vec_id", F.round(F.aggregate("g", F.lit(0.0), lambda a, x: a + x), 5).alias("total"), F.size("g").alias("n"))


@query(f"WITH {_VERTS} SELECT index, count(*) AS n, 0.0::DOUBLE AS total FROM dp GROUP BY index")
def q_rest_control(spark, d):
    r = records.mesh_control(mesh.displacement(_verts(spark, d), _rest(spark)), "rest")
    return r.groupBy("index").agg(F.count(F.lit(1)).alias("n"), F.sum(F.abs("dx") + F.abs("dy") + F.abs("dz")).alias("total"))


@query("""SELECT l_orderkey, l_linenumber, l_quantity, l_partkey, CASE WHEN l_linenumber = 1 THEN [l_orderkey, l_orderkey + 1] WHEN l_linenumber = 2 THEN [l_orderkey // 1000 * 1000 + 7] WHEN l_linenumber = 3 THEN [l_orderkey] ELSE [] END::BIGINT[] AS ids FROM lineitem""")
def q_mesh_refs(spark, d):
    """The ids that a reference names: its list, its shard and row, or the record's own index."""
    from ..sources.readers import mesh_ids

    c = F.col
    n = c("l_linenumber")
    ref = F.struct(F.when(n == 2, F.expr("int(l_orderkey div 1000)")).alias("verts_shard"), F.when(n == 2, F.lit(7)).alias("row_in_shard"), F.when(n == 1, F.array("l_orderkey", c("l_orderkey") + 1)).alias("indices"))
    rows = table(spark, d, "lineitem").withColumns({"ref": ref, "own": F.when(n == 3, c("l_orderkey"))})
    return rows.select("l_orderkey", "l_linenumber", "l_quantity", "l_partkey", mesh_ids(c("ref"), c("own")).alias("ids"))
