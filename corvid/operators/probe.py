"""Probe scores: directions of regions, corrections of muscles, axis signs, and the headline table.

Items are rows: uid, family, kind, pred, n_act_bin and the gold columns that a family has. Parsed answers come
from Arrow functions once; everything after that is array and aggregate work.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.parsers import corrections_of, direction_concepts, directions_of, muscle_mentions, nearest_corrections_of
from ..functions.text import first_number, prf
from ..functions.vocabulary import MOVE_EPS_MM, MUSCLES, REGIONS
from .metrics import abstention, set_scores
from .statistics import exact_quantiles

# Tolerances by unit and quantity, the opposite concepts, the axes and the least motion that is scored.
TOL_MM, TOL_NORM, TOL_BY_QUANTITY = 2.0, 0.1, {"cd_min": 0.03}
OPPOSITES = {"advance": "retract", "retract": "advance", "elevate": "descend", "descend": "elevate"}
AXES = (("advance", "retract"), ("elevate", "descend"))
LEAST_MOTION_MM = 2.0


def region_masks(rest: DataFrame) -> DataFrame:
    """vertex and region of the rest mesh: tip and root by the outer fifths of x, body between, dorsum by the top of z without the tip."""
    qx, qz = exact_quantiles(rest, [], "x", (0.2, 0.8)), exact_quantiles(rest, [], "z", (0.7,))
    d = rest.crossJoin(F.broadcast(qx.select(F.col("q").alias("qx")))).crossJoin(F.broadcast(qz.select(F.col("q")[0].alias("qz"))))
    tip, root = F.col("x") <= F.col("qx")[0], F.col("x") >= F.col("qx")[1]
    marks = F.array(F.when(tip, F.lit("tip")), F.when(root, F.lit("root")), F.when(~tip & ~root, F.lit("body")), F.when(~tip & (F.col("z") >= F.col("qz")), F.lit("dorsum")))
    return d.select("vertex", F.explode(F.filter(marks, lambda m: m.isNotNull())).alias("region"))


def region_motion(displacement: DataFrame, masks: DataFrame, anterior_sign: int = -1, vertical_sign: int = 1) -> DataFrame:
    """Mean forward, upward and total motion in mm of each region of each mesh; displacement has metres a vertex."""
    j = displacement.join(F.broadcast(masks), "vertex")
    size = F.sqrt(F.col("dx") * F.col("dx") + F.col("dy") * F.col("dy") + F.col("dz") * F.col("dz"))
    mm = lambda c: F.bround(c * 1000, 2)
    return j.groupBy("index", "region").agg(mm(F.avg("dx") * anterior_sign).alias("forward_mm"), mm(F.avg("dz") * vertical_sign).alias("up_mm"), mm(F.avg(size)).alias("mean_mag_mm"))


def direction_labels(forward: Column, up: Column, eps: float = MOVE_EPS_MM) -> Column:
    """advance or retract, elevate or descend, from eps on; preserve if neither."""
    sign = lambda x, plus, minus: F.when(F.abs(x) >= eps, F.when(x > 0, F.lit(plus)).otherwise(F.lit(minus)))
    found = F.filter(F.array(sign(forward, *AXES[0]), sign(up, *AXES[1])), lambda x: x.isNotNull())
    return F.when(F.size(found) > 0, found).otherwise(F.array(F.lit("preserve")))


def corrections_between(current: Column, target: Column, eps: float = 0.05) -> tuple[Column, Column]:
    """Muscles to contract more and to relax from one activation array to another, from eps on."""
    change = F.zip_with(current, target, lambda c, t: t - c)
    pick = lambda holds: F.filter(F.transform(change, lambda x, i: F.when(holds(x), F.get(F.array(*map(F.lit, MUSCLES)), i))), lambda x: x.isNotNull())
    return pick(lambda x: x >= eps), pick(lambda x: x <= -eps)


def value_tolerance(gold_tol: Column, meta_tol: Column, quantity: Column, unit: Column, source: str = "gold") -> Column:
    """An item's own tolerance, else its quantity's, else its unit's; source 'config' passes over the item's own."""
    own = [gold_tol, meta_tol] if source == "gold" else []
    by_quantity = F.try_element_at(F.create_map(*[F.lit(x) for kv in TOL_BY_QUANTITY.items() for x in kv]), quantity)
    return F.coalesce(*own, by_quantity, F.when(unit == "mm", TOL_MM).when(unit == "norm", TOL_NORM), F.lit(TOL_MM))


def score_values(items: DataFrame, tol: Column) -> DataFrame:
    """Rows with pred_value and correct: the first number of the answer lies within the tolerance of gold_value."""
    v = first_number(F.col("pred"))
    return items.withColumns({"pred_value": v, "correct": F.coalesce(F.abs(v - F.col("gold_value")) <= tol, F.lit(False))})


def direction_part(kind: Column) -> Column:
    """What scores a direction item: corrections for prescriptions, regions for descriptions of a rest shape, axes for all others."""
    return F.when(kind.isin("prescriptive", "correction"), "prescriptive").when(kind == "rest_desc", "rest_desc").otherwise("b2")


def score_muscles(items: DataFrame) -> DataFrame:
    """Micro P, R, F1 of the muscles named, by n_act_bin."""
    return set_scores(items, F.col("gold_muscles"), muscle_mentions(F.coalesce("pred", F.lit(""))), ["n_act_bin"])


def score_regions(items: DataFrame) -> DataFrame:
    """A row an item: regions scored, right and contradicted, and whether all are right.

    gold_directions maps regions to concepts. 'preserve' alone asks for nothing but preserve; else all gold
    concepts and no opposite. An answer that only says front, mid, back owes nothing for the dorsum.
    """
    low = F.lower(F.coalesce("pred", F.lit("")))
    coarse = low.rlike(r"\b(front|mid|middle|back)\b") & ~low.rlike(r"\b(tip|body|root|dorsum)\b")
    d = items.withColumns({"_said": directions_of(F.coalesce("pred", F.lit(""))), "_coarse": coarse})
    r = d.select("uid", "_coarse", F.explode(F.array(*map(F.lit, REGIONS))).alias("region"), "gold_directions", "_said")
    r = r.withColumns({"g": F.coalesce(F.try_element_at("gold_directions", "region"), F.expr("cast(array() as array<string>)")), "p": F.try_element_at("_said", "region")})
    opposite = F.create_map(*[F.lit(x) for kv in OPPOSITES.items() for x in kv])
    against = F.arrays_overlap(F.filter(F.transform("g", lambda x: F.try_element_at(opposite, x)), lambda x: x.isNotNull()), "p")
    still = (F.size("g") == 1) & F.array_contains("g", "preserve")
    only = (F.size("p") > 0) & (F.size(F.array_except("p", F.array(F.lit("preserve")))) == 0)
    right = F.when(still, only).otherwise((F.size(F.array_except("g", "p")) == 0) & ~against)
    counted = (F.size("g") > 0) & ~(F.col("_coarse") & (F.col("region") == "dorsum") & (F.size("p") == 0))
    out = r.select("uid", counted.alias("counted"), right.alias("right"), (counted & ~still & against).alias("against"))
    g = out.groupBy("uid").agg(F.count_if("counted").alias("n_regions"), F.count_if(F.col("counted") & F.col("right")).alias("n_right"), F.count_if("against").alias("n_against"))
    return g.withColumn("correct", (F.col("n_regions") > 0) & (F.col("n_regions") == F.col("n_right")))


def correction_pairs(inc: Column, dec: Column) -> Column:
    tag = lambda a, t: F.transform(F.coalesce(a, F.expr("cast(array() as array<string>)")), lambda m: F.concat(m, F.lit(f":{t}")))
    return F.array_sort(F.concat(tag(inc, "inc"), tag(dec, "dec")))


def with_corrections(items: DataFrame, parser=corrections_of) -> DataFrame:
    """gold_pairs and pred_pairs as sorted arrays of muscle:tag; parser maps an answer to muscles and tags."""
    said = F.map_entries(parser(F.coalesce("pred", F.lit(""))))
    pred = F.array_sort(F.transform(said, lambda e: F.concat(e["key"], F.lit(":"), e["value"])))
    return items.withColumns({"gold_pairs": correction_pairs(F.col("gold_inc"), F.col("gold_dec")), "pred_pairs": pred})


def score_nearest_corrections(items: DataFrame) -> DataFrame:
    """Micro P, R, F1 of the pairs that the nearest verb alone gives."""
    return score_corrections(items, nearest_corrections_of)


def score_corrections(items: DataFrame, parser=corrections_of) -> DataFrame:
    """Micro P, R, F1 of the pairs and the share of items with exactly the gold pairs (none without gold)."""
    d = with_corrections(items, parser)
    exact = (F.size("gold_pairs") > 0) & (F.col("gold_pairs") == F.col("pred_pairs"))
    return set_scores(d, F.col("gold_pairs"), F.col("pred_pairs")).crossJoin(d.agg(F.count(F.lit(1)).alias("n"), F.count_if(exact).alias("n_exact")))


def score_axes(items: DataFrame, least_mm: float = LEAST_MOTION_MM) -> DataFrame:
    """A row an item: skipped ('empty', 'weak' or null), axes of the gold, axes right, and whether all are.

    The answer must name exactly the gold's sign on each axis that the gold names; other axes don't count. Items
    have gold_concepts, dominant_region and mag_mm.
    """
    text = F.coalesce("pred", F.lit(""))
    d = items.withColumn("_said", directions_of(text)).withColumn("_all", F.array_distinct(F.concat(F.coalesce(F.try_element_at("_said", "dominant_region"), F.expr("cast(array() as array<string>)")), _bag(text))))
    pairs = [F.array(*map(F.lit, a)) for a in AXES]
    gold = [F.array_intersect("gold_concepts", a) for a in pairs]
    said = [F.array_intersect("_all", a) for a in pairs]
    named = sum((F.when(F.size(g) > 0, 1).otherwise(0) for g in gold), F.lit(0))
    right = sum((F.when((F.size(g) > 0) & (F.size(p) == 1) & (F.array_sort(g) == F.array_sort(p)), 1).otherwise(0) for g, p in zip(gold, said, strict=True)), F.lit(0))
    empty = F.size(F.array_except("gold_concepts", F.array(F.lit("preserve")))) == 0
    skipped = F.when(empty, "empty").when(F.col("mag_mm").isNull() | (F.col("mag_mm") < least_mm), "weak")
    out = d.select("uid", skipped.alias("skipped"), named.alias("n_axes"), right.alias("n_right"))
    return out.withColumn("correct", F.when(F.col("skipped").isNull(), (F.col("n_axes") > 0) & (F.col("n_axes") == F.col("n_right"))))


def _bag(text: Column) -> Column:
    """Concepts of the whole text, whatever regions it names."""

    @F.pandas_udf("array<string>")
    def bag(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: sorted(direction_concepts(t)))

    return bag(text)


def score_abstentions(items: DataFrame, abstained: Column) -> DataFrame:
    """The abstention family are the positives; muscle, value and direction items are answerable negatives."""
    answerable = items.where(F.col("family").isin("muscle_set", "value", "direction"))
    both = items.where("family = 'abstention'").withColumn("_should", F.lit(True)).unionByName(answerable.withColumn("_should", F.lit(False)))
    return abstention(both, F.col("_should"), abstained)


def control_delta(real: DataFrame, control: DataFrame, metric: str, names: tuple[str, str] = ("real", "control")) -> DataFrame:
    """A metric of one-row tables for the answers and for those under a control, and their difference."""
    a, b = real.select(F.col(metric).alias(names[0])), control.select(F.col(metric).alias(names[1]))
    return a.crossJoin(b).withColumn("delta", F.col(names[0]) - F.col(names[1]))


def headline(corrections: DataFrame | None, axes: DataFrame | None, regions: DataFrame | None) -> DataFrame:
    """Direction's headline: the F1 of corrections where there are such items, else the mean of the parts that have items, else 0.

    corrections is a row of score_corrections, axes and regions a row an item. Axes that were skipped don't count, but
    a part all of whose items were skipped has the accuracy 0.
    """
    if corrections is None and axes is None and regions is None:
        raise ValueError("no direction items")
    parts = []
    if corrections is not None:
        f1 = prf(F.col("tp"), F.col("fp"), F.col("fn"))[2]
        parts.append(corrections.select(F.lit("corrections").alias("part"), F.when(F.col("n") > 0, f1).alias("x")))
    if axes is not None:
        own = F.coalesce(F.avg(F.when(F.col("skipped").isNull(), F.col("correct").cast("int"))), F.lit(0.0))
        parts.append(axes.agg(F.lit("parts").alias("part"), F.when(F.count(F.lit(1)) > 0, own).alias("x")))
    if regions is not None:
        own = F.coalesce(F.try_divide(F.sum("n_right"), F.sum("n_regions")), F.lit(0.0))
        parts.append(regions.agg(F.lit("parts").alias("part"), F.when(F.count(F.lit(1)) > 0, own).alias("x")))
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    means = every.where("x is not null").groupBy("part").agg(F.avg("x").alias("x"))
    first = means.agg(F.max(F.when(F.col("part") == "corrections", F.col("x"))).alias("c"), F.max(F.when(F.col("part") == "parts", F.col("x"))).alias("p"))
    return first.select(F.when(F.col("c").isNotNull(), "corrections").otherwise("parts").alias("part"), F.coalesce("c", "p", F.lit(0.0)).alias("direction"))
