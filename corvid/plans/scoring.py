"""One call from items and predictions to a table of scores; metrics are found by name.

A score table has rows (metric, name, value). Every metric is a function of (items, lang, options) that gives
such rows, so a set of metrics is a union of them.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import vocabulary as V
from ..functions.parsers import muscle_mentions
from ..functions.text import matches_any, prf
from ..operators import facts, metrics, probe
from ..operators.records import of_families, require_equal_sets
from .evaluation import GOLD_EPS, overlap_by_type, set_matches

Metric = Callable[[DataFrame, str, Mapping], DataFrame]
METRICS: dict[str, Metric] = {}


def metric(f: Metric) -> Metric:
    METRICS[f.__name__] = f
    return f


def find(name: str) -> Metric:
    """The metric of a name; unknown names raise with those that are known."""
    if name not in METRICS:
        raise KeyError(f"no metric {name}; there are {', '.join(sorted(METRICS))}")
    return METRICS[name]


def rows_of(df: DataFrame, name: str, columns: Sequence[str], label: Column | None = None) -> DataFrame:
    """A table's columns as rows; label names the row they come from."""
    full = lambda c: F.lit(c) if label is None else F.concat_ws(".", label, F.lit(c))
    cells = F.explode(F.array(*[F.struct(full(c).alias("name"), F.col(c).cast("double").alias("value")) for c in columns]))
    return df.select(F.lit(name).alias("metric"), cells.alias("x")).select("metric", "x.name", "x.value")


def abstained(lang: str) -> Column:
    """Whether pred declines to answer, in the language or in English."""
    return matches_any(F.coalesce("pred", F.lit("")), list(dict.fromkeys([*V.ABSTENTIONS[lang], *V.ABSTENTIONS["en"]])))


@metric
def mask_f1(items: DataFrame, lang: str, options: Mapping) -> DataFrame:
    """Turn types that should abstain owe no facts and are left out."""
    skip = list(options.get("abstain_turn_types", ()))
    own = items.where(~F.col("turn_type").isin(*skip)) if skip else items
    return rows_of(facts.mask_f1(own, lang), "mask_f1", ["tp", "fp", "fn", "f1"], F.col("category"))


@metric
def abstention_f1(items: DataFrame, lang: str, options: Mapping) -> DataFrame:
    should = F.col("turn_type").isin(*options["abstain_turn_types"]) if "abstain_turn_types" in options else F.coalesce("should_abstain", F.lit(False))
    return rows_of(metrics.abstention(items, should, abstained(lang)), "abstention_f1", ["tp", "fp", "fn", "tn", "precision", "recall", "f1", "over_abstain"])


@metric
def direction_acc(items: DataFrame, lang: str, options: Mapping) -> DataFrame:
    own = items.where(F.col("turn_type").isin(*options["direction_turn_types"])) if "direction_turn_types" in options else items
    d = facts.direction_accuracy(own, lang)
    return rows_of(d.withColumn("accuracy", F.coalesce(F.try_divide("correct", "n"), F.lit(0.0))), "direction_acc", ["n", "correct", "contradictions", "skipped", "accuracy"])


@metric
def monotonicity_acc(items: DataFrame, lang: str, options: Mapping) -> DataFrame:
    """Accuracy of trends, and that of always naming the most frequent one."""
    own = items.where(F.col("turn_type").isin(*options["monotonicity_turn_types"])) if "monotonicity_turn_types" in options else items
    c = facts.trend_confusion(own, lang)
    by_gold = c.groupBy("gold").agg(F.sum("n").alias("g"), F.sum(F.when(F.col("gold") == F.col("pred"), F.col("n")).otherwise(0)).alias("hit"))
    t = by_gold.agg(F.coalesce(F.sum("g"), F.lit(0)).alias("n"), F.coalesce(F.sum("hit"), F.lit(0)).alias("correct"), F.coalesce(F.max("g"), F.lit(0)).alias("most"))
    ratio = lambda x: F.coalesce(F.try_divide(x, "n"), F.lit(0.0))
    return rows_of(t.withColumns({"accuracy": ratio("correct"), "majority": ratio("most")}), "monotonicity_acc", ["n", "correct", "accuracy", "majority"])


@metric
def sign_acc(items: DataFrame, lang: str, options: Mapping) -> DataFrame:
    d = items.select("gold", facts.sign_of(F.coalesce("pred", F.lit(""))).alias("p"))
    t = d.agg(F.count(F.lit(1)).alias("n"), F.avg((F.col("gold") == F.col("p")).cast("int")).alias("accuracy"), F.avg((F.col("p") == "?").cast("int")).alias("unparsed_rate"))
    return rows_of(t, "sign_acc", ["n", "accuracy", "unparsed_rate"])


@metric
def correction_sign_f1(items: DataFrame, lang: str, options: Mapping) -> DataFrame:
    """Corrections by the nearest verb, the anchor of free answers."""
    return rows_of(probe.score_nearest_corrections(items), "correction_sign_f1", ["tp", "fp", "fn", "precision", "recall", "f1", "n", "n_exact"])


@metric
def muscle_f1(items: DataFrame, lang: str, options: Mapping) -> DataFrame:
    own = of_families(items, "muscle_set")
    d = own.select(F.col("gold_muscles"), muscle_mentions(F.coalesce("pred", F.lit(""))).alias("p"))
    return rows_of(metrics.set_scores(d, F.col("gold_muscles"), F.col("p")), "muscle_f1", ["tp", "fp", "fn", "precision", "recall", "f1"])


@metric
def value_acc(items: DataFrame, lang: str, options: Mapping) -> DataFrame:
    tol = probe.value_tolerance(F.col("tol"), F.lit(None).cast("double"), F.col("quantity"), F.col("unit"), options.get("tolerance", "gold"))
    t = probe.score_values(of_families(items, "value"), tol).agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.avg(F.col("correct").cast("int")), F.lit(0.0)).alias("accuracy"))
    return rows_of(t, "value_acc", ["n", "accuracy"])


def score(items: DataFrame, names: Sequence[str], lang: str = "en", options: Mapping | None = None) -> DataFrame:
    """All named metrics of the items as one table."""
    out = None
    for name in names:
        rows = find(name)(items, lang, options or {})
        out = rows if out is None else out.unionByName(rows)
    if out is None:
        raise ValueError("no metrics named")
    return out


def score_turns(items: DataFrame, train: DataFrame, lang: str, options: Mapping, names: Sequence[str] = ("mask_f1", "abstention_f1", "direction_acc", "monotonicity_acc")) -> DataFrame:
    """Metrics of generated turns, with the number of each turn type and its share of training meshes."""
    counts = items.groupBy("turn_type").agg(F.count(F.lit(1)).alias("n"))
    counts = counts.select(F.lit("turn_type_counts").alias("metric"), F.col("turn_type").alias("name"), F.col("n").cast("double").alias("value"))
    seen = overlap_by_type(items, train).select(F.lit("train_mesh_overlap").alias("metric"), F.col("turn_type").alias("name"), F.col("rate").alias("value"))
    return score(items, names, lang, options).unionByName(counts).unionByName(seen)


def score_set(kind: str, items: DataFrame, train: DataFrame, lang: str = "en", options: Mapping | None = None, names: Sequence[str] | None = None) -> tuple[DataFrame, DataFrame | None]:
    """(scores, judge payloads or None) of one of the three sets of questions.

    turns: generated turns, with their counts and overlap. signs: super- or sub-additive answers by gold sign, and facts.
    diagnoses: corrections by the nearest verb, and for items with a grounding what a judge needs: mesh, question,
    answer and grounding. Named metrics narrow what is scored.
    """
    options = options or {}
    if kind == "turns":
        return score_turns(items, train, lang, options, *([names] if names else [])), None
    if kind == "signs":
        return score(items, names or ["sign_acc", "mask_f1"], lang, options), None
    if kind == "diagnoses":
        wanted = names or ["correction_sign_f1", "judge_payload"]
        scores = score(items, [n for n in wanted if n != "judge_payload"] or ["correction_sign_f1"], lang, options)
        judged = items.where("judge_grounding is not null").select("index", "question", F.coalesce("pred", F.lit("")).alias("pred"), F.col("judge_grounding").alias("grounding"))
        return scores, judged if "judge_payload" in wanted else None
    raise KeyError(f"no set {kind}; there are turns, signs, diagnoses")


def _by(scores: DataFrame, name: str, columns: Sequence[str], label: str, kind: str) -> DataFrame:
    return rows_of(scores, name, columns, F.concat_ws(".", F.lit(kind), F.coalesce(F.col(label).cast("string"), F.lit(""))))


def _muscle_bins(items: DataFrame) -> DataFrame:
    own = of_families(items, "muscle_set")
    return _by(probe.score_muscles(own), "muscle_f1", ["tp", "fp", "fn", "precision", "recall", "f1"], "n_act_bin", "per_n_act")


def _value_parts(items: DataFrame, options: Mapping) -> DataFrame:
    """Value accuracy of each bin of active muscles and of each quantity."""
    tol = probe.value_tolerance(F.col("tol"), F.lit(None).cast("double"), F.col("quantity"), F.col("unit"), options.get("tolerance", "gold"))
    scored = probe.score_values(of_families(items, "value"), tol).withColumn("quantity", F.coalesce("quantity", F.lit("?")))
    t = metrics.grouped_accuracy(scored, F.col("correct"), ["n_act_bin", "quantity"]).withColumn("n_correct", F.col("n_ok"))
    bins = t.where("level = 1").withColumn("accuracy", F.col("n_ok") / F.col("n"))
    kinds = t.where("level = 2").withColumn("accuracy", F.col("n_ok") / F.col("n"))
    return _by(bins, "value_acc", ["n", "n_correct", "accuracy"], "n_act_bin", "per_n_act").unionByName(_by(kinds, "value_acc", ["n", "n_correct", "accuracy"], "quantity", "per_quantity"))


def _directions(direction: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(rows of the three parts, the headline, the accuracy row of the axes); an item goes to the part of its kind."""
    part = probe.direction_part(F.coalesce("kind", F.lit("b2")))
    corrections = probe.score_corrections(direction.where(part == "prescriptive"))
    axes = probe.score_axes(direction.where(part == "b2"))
    regions = probe.score_regions(direction.where(part == "rest_desc"))
    ratio = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    corrections = corrections.withColumn("item_accuracy", ratio("n_exact", "n"))
    sums = lambda c: F.coalesce(F.sum(F.when(F.col("skipped").isNull(), F.col(c))), F.lit(0))
    b2 = axes.agg(
        F.count_if(F.col("skipped").isNull()).alias("n"),
        F.count_if(F.col("skipped").isNull() & F.col("correct")).alias("n_correct"),
        sums("n_axes").alias("n_axes"),
        sums("n_right").alias("n_right_axes"),
        F.count_if(F.col("skipped") == "weak").alias("n_skipped_weak"),
        F.count_if(F.col("skipped") == "empty").alias("n_skipped_empty"),
    )
    b2 = b2.withColumns({"accuracy": ratio("n_correct", "n"), "axis_accuracy": ratio("n_right_axes", "n_axes")})
    none = F.lit(0)
    rest = regions.agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if("correct").alias("n_correct"),
        *[F.coalesce(F.sum(c), none).alias(c) for c in ("n_regions", "n_right", "n_against")],
    )
    rest = rest.withColumns({"accuracy": ratio("n_right", "n_regions"), "item_accuracy": ratio("n_correct", "n"), "contradiction_rate": ratio("n_against", "n_regions")})
    out = rows_of(corrections, "direction_prescriptive", ["tp", "fp", "fn", "precision", "recall", "f1", "n", "n_exact", "item_accuracy"])
    out = out.unionByName(rows_of(b2, "direction_b2", ["n", "n_correct", "accuracy", "n_axes", "n_right_axes", "axis_accuracy", "n_skipped_weak", "n_skipped_empty"]))
    out = out.unionByName(rows_of(rest, "direction_rest", ["n", "n_correct", "item_accuracy", "n_regions", "n_right", "accuracy", "contradiction_rate"]))
    return out, probe.headline(corrections, axes, regions), b2


def score_probe(items: DataFrame, lang: str = "en", shuffled: DataFrame | None = None, options: Mapping | None = None) -> DataFrame:
    """All families of a probe, by bins and quantities too, and the headline rows.

    Direction items have kind: 'prescriptive' or 'correction' (corrections), 'rest_desc' (regions), all others count as
    axes. shuffled has the items with the predictions under shuffled meshes; what the muscle F1 loses is the
    headline's drop, or what the value accuracy loses where it has no muscle items.
    """
    options = options or {}
    muscles, values = muscle_f1(items, lang, options), value_acc(items, lang, options)
    out = muscles.unionByName(values).unionByName(_muscle_bins(items)).unionByName(_value_parts(items, options))
    parts, direction, b2 = _directions(of_families(items, "direction"))
    refused = probe.score_abstentions(items, abstained(lang))
    out = out.unionByName(parts)
    out = out.unionByName(rows_of(refused, "abstention_f1", ["tp", "fp", "fn", "tn", "precision", "recall", "f1", "over_abstain"]))
    out = out.unionByName(items.where("family = 'utility'").agg(F.count(F.lit(1)).cast("double").alias("value")).select(F.lit("utility").alias("metric"), F.lit("n").alias("name"), "value"))
    muscles, values = muscles.where("name = 'f1'"), values.where("name = 'accuracy'")
    head = [muscles.select(F.lit("Muscle F1").alias("name"), "value"), values.select(F.lit("Value acc").alias("name"), "value")]
    head += [direction.select(F.lit("Direction acc").alias("name"), F.col("direction").alias("value")), b2.where("n > 0").select(F.lit("B2-sign").alias("name"), F.col("accuracy").alias("value")), b2.select(F.lit("B2-sign n").alias("name"), F.col("n").cast("double").alias("value"))]
    head += [refused.select(F.lit("Abstention F1").alias("name"), F.col("f1").alias("value"))]
    if shuffled is not None:
        by_mesh = muscle_f1(shuffled, lang, options).withColumn("metric", F.lit("muscle_f1_shuf"))
        valued = shuffled if "gold_value" in shuffled.columns else items.where("false")
        by_value = value_acc(valued, lang, options).withColumn("metric", F.lit("value_acc_shuf"))
        n = shuffled.agg(F.count_if(F.col("family") == "muscle_set").alias("n_muscle"), F.count_if(F.col("family") == "value").alias("n_value"))
        # One row a table: which drop there is depends on the families that were answered.
        drop = lambda real, shuf, has: real.select(F.col("value").alias("a")).crossJoin(shuf.select(F.col("value").alias("b"))).crossJoin(n).where(has).select((F.col("a") - F.col("b")).alias("value"))
        lost = drop(muscles, by_mesh.where("name = 'f1'"), F.col("n_muscle") > 0)
        if "gold_value" in shuffled.columns:
            lost = lost.unionByName(drop(values, by_value.where("name = 'accuracy'"), (F.col("n_muscle") == 0) & (F.col("n_value") > 0)))
        head.append(lost.select(F.lit("Δ_shuf").alias("name"), "value"))
        out = out.unionByName(by_mesh.crossJoin(n).where("n_muscle > 0").select("metric", "name", "value")).unionByName(by_value.crossJoin(n).where("n_value > 0").select("metric", "name", "value"))
    for h in head:
        out = out.unionByName(h.select(F.lit("headline").alias("metric"), "name", "value"))
    return out


def validation_map(items: DataFrame, lang: str = "en") -> DataFrame:
    """name and value of a validation's flat map: 'val/mask_f1' and so on; categories without facts are left out."""
    m = facts.mask_f1(items, lang)
    p, r, _ = prf(F.col("tp"), F.col("fp"), F.col("fn"))
    micro = m.where("category = 'micro'").withColumns({"val/mask_f1": F.coalesce("f1", F.lit(0.0)), "val/mask_precision": p, "val/mask_recall": r})
    out = rows_of(micro, "val", ["val/mask_f1", "val/mask_precision", "val/mask_recall"])
    each = m.where(F.col("category").isin(*facts.CATEGORIES) & F.col("f1").isNotNull())
    out = out.unionByName(each.select(F.lit("val").alias("metric"), F.concat(F.lit("val/mask_f1_"), "category").alias("name"), F.col("f1").alias("value")))
    did = abstained(lang)
    a = metrics.abstention(items, F.coalesce("should_abstain", F.lit(False)), did).withColumnRenamed("f1", "val/abstention_f1")
    out = out.unionByName(rows_of(a, "val", ["val/abstention_f1"]))
    t = items.agg(F.avg(did.cast("int")).alias("val/abstain_rate"), F.count(F.lit(1)).alias("val/n_gen_samples"), F.avg(F.length(F.coalesce("pred", F.lit("")))).alias("val/pred_chars"))
    return out.unionByName(rows_of(t, "val", ["val/abstain_rate", "val/n_gen_samples", "val/pred_chars"])).select("name", "value")


# Regression heads


def scorer_ceiling(gold: DataFrame, threshold: float, eps: float = GOLD_EPS) -> DataFrame:
    """The exact share that the gold itself reaches at a threshold, and the active entries that the threshold loses.

    gold: index, muscle, gold.
    """
    perfect = gold.select(F.lit("gold").alias("row_id"), "index", "muscle", F.col("gold").alias("pred"), "gold")
    m = set_matches(perfect, threshold, eps)
    return m.agg(F.lit(float(threshold)).alias("threshold"), F.avg(F.col("exact").cast("int")).alias("muscle_em"), F.sum("fn").alias("n_active_lost"), F.sum(F.col("tp") + F.col("fn")).alias("n_active_entries"))


def per_muscle_errors(long: DataFrame) -> DataFrame:
    """Mean absolute error of each head and muscle."""
    return long.groupBy("row_id", "muscle").agg(F.count(F.lit(1)).alias("n"), F.avg(F.abs(F.col("pred") - F.col("gold"))).alias("l1"))


def score_heads(long: DataFrame, probe_items: DataFrame, threshold: float) -> DataFrame:
    """Exact scores of every head after its gold was found to equal that of the probe items (index, muscles); raises if not."""
    from .evaluation import exact_scores

    gold = long.groupBy("index", "muscle").agg(F.max("gold").alias("g")).groupBy("index").agg(F.collect_set(F.when(F.col("g") > GOLD_EPS, F.col("muscle"))).alias("muscles"))
    require_equal_sets(gold, probe_items, "index", "muscles")
    return exact_scores(set_matches(long, threshold))
