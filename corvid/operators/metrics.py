"""Scores of predictions: set and tolerance metrics, confusions, thresholds, paired tests."""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Mapping, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import prf, set_counts
from .bootstrap import bootstrap, mean_difference
from .curves import accuracy_curve
from .prefix import running


def set_scores(df: DataFrame, gold: Column, pred: Column, groups: Sequence[str] = ()) -> DataFrame:
    """Counts summed over rows, then precision, recall and F1, by group."""
    c = df.select(*groups, set_counts(gold, pred).alias("c"))
    sums = c.groupBy(*groups).agg(*[F.coalesce(F.sum(f"c.{x}"), F.lit(0)).alias(x) for x in ("tp", "fp", "fn")])
    p, r, f1 = prf(F.col("tp"), F.col("fp"), F.col("fn"))
    return sums.withColumns({"precision": F.round(p, 6), "recall": F.round(r, 6), "f1": F.round(f1, 6)})


def macro_micro(scores: DataFrame, category: str) -> DataFrame:
    """Category rows of set_scores with a row for all counts ('micro') and one for the mean F1 of categories with facts ('macro')."""
    total = scores.agg(*[F.coalesce(F.sum(x), F.lit(0)).alias(x) for x in ("tp", "fp", "fn")])
    micro = total.select(F.lit("micro").alias(category), "tp", "fp", "fn", F.round(prf(F.col("tp"), F.col("fp"), F.col("fn"))[2], 6).alias("f1"))
    own = scores.select(category, "tp", "fp", "fn", F.when(F.col("tp") + F.col("fp") + F.col("fn") > 0, F.col("f1")).alias("f1"))
    macro = own.agg(F.round(F.avg("f1"), 6).alias("f1")).select(F.lit("macro").alias(category), *[F.lit(None).cast("long").alias(x) for x in ("tp", "fp", "fn")], "f1")
    return own.unionByName(micro).unionByName(macro)


def abstention(df: DataFrame, should: Column, did: Column, groups: Sequence[str] = ()) -> DataFrame:
    """Confusion of abstentions; P, R, F1 are null without positives, the over-abstention rate without negatives."""
    c = df.groupBy(*groups).agg(F.count_if(should & did).alias("tp"), F.count_if(~should & did).alias("fp"), F.count_if(should & ~did).alias("fn"), F.count_if(~should & ~did).alias("tn"))
    p, r, f1 = (F.when(F.col("tp") + F.col("fn") > 0, F.round(x, 6)) for x in prf(F.col("tp"), F.col("fp"), F.col("fn")))
    over = F.round(F.try_divide(F.col("fp"), F.col("fp") + F.col("tn")), 6)
    return c.withColumns({"precision": p, "recall": r, "f1": f1, "over_abstain": over})


def label_confusion(df: DataFrame, gold: Column, pred: Column) -> DataFrame:
    """Counts by (gold, pred), with the accuracy and the majority share of all rows."""
    counts = df.select(gold.alias("gold"), pred.alias("pred")).groupBy("gold", "pred").agg(F.count(F.lit(1)).alias("n"))
    every = Window.partitionBy(F.lit(0))
    by_gold = Window.partitionBy("gold")
    d = counts.withColumns({"_all": F.sum("n").over(every), "_gold": F.sum("n").over(by_gold)})
    hit = F.sum(F.when(F.col("gold") == F.col("pred"), F.col("n")).otherwise(0)).over(every)
    return d.select("gold", "pred", "n", F.round(hit / F.col("_all"), 6).alias("accuracy"), F.round(F.max("_gold").over(every) / F.col("_all"), 6).alias("majority"))


def tolerance(*known: Column, default: float) -> Column:
    """The first tolerance that is known."""
    return F.coalesce(*known, F.lit(default))


def grouped_accuracy(df: DataFrame, ok: Column, dims: Sequence[str]) -> DataFrame:
    """Rows, hits and accuracy of all rows and of the values of each dimension."""
    d = df.withColumn("_ok", ok.cast("long"))
    sets = [[], *[[x] for x in dims]]
    g = d.groupingSets([[F.col(c) for c in s] for s in sets], *map(F.col, dims))
    out = g.agg(F.count(F.lit(1)).alias("n"), F.sum("_ok").alias("n_ok"), F.grouping_id().cast("long").alias("level"))
    return out.withColumn("accuracy", F.round(F.col("n_ok") / F.col("n"), 6))


def exact_match(df: DataFrame, gold: Sequence[Column], pred: Sequence[Column], groups: Sequence[str]) -> DataFrame:
    """Share of rows with all flags equal, and the mean share of equal flags, by group."""
    same = [(g == p).cast("int") for g, p in zip(gold, pred, strict=True)]
    d = df.select(*groups, F.least(*same).alias("em"), sum(same[1:], same[0]).alias("hits"))
    return d.groupBy(*groups).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("em"), 6).alias("exact"), F.round(F.avg(F.col("hits") / len(same)), 6).alias("per_flag"))


def regression_errors(df: DataFrame, pred: Column, gold: Column, active: Column, groups: Sequence[str]) -> DataFrame:
    e = df.select(*groups, (pred - gold).alias("e"), active.alias("on"))
    return e.groupBy(*groups).agg(
        F.count(F.lit(1)).alias("n"),
        F.round(F.avg(F.abs("e")), 6).alias("mae"),
        F.round(F.avg(F.when(F.col("on"), F.abs("e"))), 6).alias("mae_active"),
        F.round(F.avg(F.when(~F.col("on"), F.abs("e"))), 6).alias("mae_inactive"),
        F.round(F.sqrt(F.avg(F.col("e") * F.col("e"))), 6).alias("rmse"),
    )


def dead_columns(df: DataFrame, cols: Mapping[str, float]) -> DataFrame:
    """Each column's largest value against its threshold, and the share of rows where no dead column exceeds its half."""
    top = df.agg(*[F.max(c).alias(c) for c in cols])
    stack = F.explode(F.array(*[F.struct(F.lit(c).alias("name"), F.col(c).cast("double").alias("largest"), F.lit(t).alias("threshold")) for c, t in cols.items()]))
    return top.select(stack.alias("x")).select("x.*").withColumn("dead", F.col("largest") <= F.col("threshold"))


def threshold_sweep(df: DataFrame, score: Column, gold: Column, grid: Sequence[float]) -> DataFrame:
    """Accuracy of score > threshold at each grid value; the best one is the largest, the smaller threshold among equals."""
    hits = accuracy_curve(df, score, gold, grid)
    best = F.row_number().over(Window.orderBy(F.desc("n_ok"), "threshold"))
    return hits.withColumn("is_best", best == 1).withColumn("accuracy", F.round(F.col("n_ok") / F.col("n"), 6))


def _ln_factorial(x: str) -> str:
    """SQL for ln(x!) by Stirling's series; exact to 1e-12 from 10 on, and the sum of logarithms below."""
    z = f"cast({x} as double)"
    small = f"aggregate(if({x} < 2, cast(array() as array<bigint>), sequence(2L, least({x}, 10L))), 0D, (s, j) -> s + ln(cast(j as double)))"
    series = f"({z} + 0.5D) * ln({z}) - {z} + 0.9189385332046727D + 1D / (12 * {z}) - 1D / (360 * pow({z}, 3)) + 1D / (1260 * pow({z}, 5))"
    return f"if({x} <= 10, {small}, {series})"


def mcnemar(df: DataFrame, a_ok: Column, b_ok: Column) -> DataFrame:
    """Rows that only one side has right, and the exact two-sided binomial p-value.

    Terms follow from each other in one fold. Of very many discordant rows only the last terms of the tail are
    summed, 45 standard deviations of them; what stands before is below what a double can add.
    """
    c = df.agg(F.count_if(a_ok & ~b_ok).alias("a_only"), F.count_if(~a_ok & b_ok).alias("b_only"))
    c = c.withColumns({"_n": F.col("a_only") + F.col("b_only"), "_k": F.least("a_only", "b_only")})
    c = c.withColumn("_s", F.expr("if(_k < 2000, 0L, greatest(0L, _k - cast(45 * sqrt(_n) as bigint) - 50))"))
    c = c.withColumn("_t", F.expr(f"{_ln_factorial('_n')} - {_ln_factorial('_s')} - {_ln_factorial('(_n - _s)')} - _n * ln(2D)"))
    fold = "aggregate(sequence(_s, _k), struct(_t as t, 0D as total), (x, i) -> struct(x.t + ln(cast(_n - i as double)) - ln(cast(i + 1 as double)) as t, x.total + exp(x.t) as total), x -> x.total)"
    safe = fold.replace("ln(cast(_n - i as double))", "if(_n = i, 0D, ln(cast(_n - i as double)))")
    p = F.expr(f"if(_n = 0, 1D, least(1D, 2 * {safe}))")
    return c.select("a_only", "b_only", F.round(p, 6).alias("p_value"))


def _nearest_pairs(golds: list[float], left: list[float], rel: float, floor: float) -> int:
    """How many ascending golds take the nearest of the ascending predictions that are left, the smaller among equals."""
    hits = 0
    for x in golds:
        at = bisect_left(left, x)
        if at and (at == len(left) or x - left[at - 1] <= left[at] - x):
            at -= 1
        if at < len(left) and abs(left[at] - x) <= max(floor, rel * abs(x)):
            left.pop(at)
            hits += 1
    return hits


def greedy_tolerance(df: DataFrame, key: str, gold: str, pred: str, rel: float = 0.02, floor: float = 0.01) -> DataFrame:
    """tp, fp, fn of arrays of numbers: gold values in ascending order each take the nearest unused prediction in tolerance."""

    def match(frames):
        for f in frames:
            rows = []
            for k, g, p in zip(f.iloc[:, 0], f.iloc[:, 1], f.iloc[:, 2], strict=True):
                golds, left = sorted(g if g is not None else []), sorted(p if p is not None else [])
                tp = _nearest_pairs(golds, left, rel, floor)
                rows.append((k, tp, len(left), len(golds) - tp))
            yield pd.DataFrame(rows, columns=["key", "tp", "fp", "fn"])

    kind = df.schema[key].dataType.simpleString()
    return df.select(key, gold, pred).mapInPandas(match, f"key {kind}, tp long, fp long, fn long").withColumnRenamed("key", key)


def paired_bootstrap(df: DataFrame, a: Column, b: Column, item: str, samples: int = 20_000, level: float = 0.95) -> DataFrame:
    """Mean difference of paired outcomes, 0/1 or any numbers, and its percentile interval; item is a distinct number of each row."""
    found = bootstrap(df, item, {"_a": a, "_b": b}, mean_difference("_a", "_b"), samples, level)
    return found.select("n", F.col("value").alias("difference"), "low", "high")


def weighted_mean(df: DataFrame, value: str, weight: str, groups: Sequence[str] = ()) -> DataFrame:
    """sum(w x) / max(sum(w), 1)."""
    return df.groupBy(*groups).agg((F.coalesce(F.sum(F.col(weight) * F.col(value)), F.lit(0.0)) / F.greatest(F.coalesce(F.sum(weight), F.lit(0.0)), F.lit(1.0))).alias("mean"))


def l2_norm(df: DataFrame, value: str, groups: Sequence[str] = ()) -> DataFrame:
    """Euclidean norm of a group's values, as of the gradients of a part of a model; nulls count as absent."""
    return df.groupBy(*groups).agg(F.sqrt(F.coalesce(F.sum(F.col(value) * F.col(value)), F.lit(0.0))).alias("norm"))


def running_best(df: DataFrame, group: str, step: str, metric: str) -> DataFrame:
    """The best metric up to each step, and whether the step is a strict improvement; steps are distinct."""
    inside = {"_upto": lambda w: F.max(metric).over(w.rowsBetween(Window.unboundedPreceding, 0)), "_prior": lambda w: F.max(metric).over(w.rowsBetween(Window.unboundedPreceding, -1))}
    carry = {"_ahead": lambda w: F.max("_top").over(w.rowsBetween(Window.unboundedPreceding, -1))}
    d = running(df, group, step, inside, {"_top": F.max(metric)}, carry)
    before = F.greatest("_ahead", "_prior")
    return d.withColumns({"best": F.greatest("_ahead", "_upto"), "improved": before.isNull() | (F.col(metric) > before)}).drop("_upto", "_prior", "_ahead")
