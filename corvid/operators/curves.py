"""Threshold curves as sweep lines: every item changes a curve at a few places, so no item meets every threshold.

A prediction passes the thresholds below it, a stretch of the sorted grid. Counts of passing predictions are sums
over stretches, and an item is an exact match on one stretch: from the largest of its inactive predictions to the
smallest of its active ones. Stretches add up as differences at their ends, at most one row a grid place and group.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import prf
from .ranking import _same


def passed(value: Column, grid: Sequence[float]) -> Column:
    """How many thresholds of an ascending grid lie below the value, by binary search; none for null and NaN."""
    edges = F.array(*[F.lit(float(g)) for g in grid])
    steps = F.array(*[F.lit(1 << b) for b in reversed(range(len(grid).bit_length()))])
    own = F.when(~F.isnan(value.cast("double")), value.cast("double"))
    inside = lambda lo, step: (lo + step <= len(grid)) & (F.get(edges, F.least(lo + step, F.lit(len(grid))) - 1) < own)
    return F.aggregate(steps, F.lit(0), lambda lo, step: F.when(inside(lo, step), lo + step).otherwise(lo))


def _ascending(grid: Sequence[float]) -> list[float]:
    out = sorted({float(g) for g in grid})
    if not out:
        raise ValueError("a curve needs a threshold")
    return out


def _along(events: DataFrame, groups: Sequence[str], sizes: DataFrame, grid: Sequence[float], counts: Sequence[str]) -> DataFrame:
    """Sums of events at places up to each place of the grid, for all groups of sizes; a group has a row a place at most."""
    places = sizes.withColumn("_at", F.explode(F.sequence(F.lit(0), F.lit(len(grid) - 1))))
    names = [f"_e{i}" for i in range(len(groups))]
    own = events.select(*[F.col(g).alias(n) for g, n in zip(groups, names, strict=True)], F.col("_at").alias("_p"), *counts)
    d = places.join(own, _same([*groups, "_at"], [*names, "_p"]), "left").drop(*names, "_p")
    upto = Window.partitionBy(*groups).orderBy("_at").rowsBetween(Window.unboundedPreceding, 0)
    d = d.withColumns({c: F.sum(F.coalesce(F.col(c), F.lit(0))).over(upto) for c in counts})
    return d.withColumn("threshold", F.get(F.array(*[F.lit(float(g)) for g in grid]), F.col("_at"))).drop("_at")


def item_stretches(long: DataFrame, grid: Sequence[float], keys: Sequence[str] = ("row_id", "index"), eps: float = 1e-4) -> DataFrame:
    """For each item the grid places [low, high) at which its active set is the gold's; long has pred and gold."""
    at = passed(F.col("pred"), grid)
    on = F.col("gold") > eps
    d = long.select(*keys, at.alias("_b"), F.coalesce(on, F.lit(False)).alias("_on"))
    out = d.groupBy(*keys).agg(F.coalesce(F.max(F.when(~F.col("_on"), F.col("_b"))), F.lit(0)).alias("low"), F.coalesce(F.min(F.when(F.col("_on"), F.col("_b"))), F.lit(len(grid))).alias("high"))
    return out


def exact_curve(items: DataFrame, groups: Sequence[str], grid: Sequence[float]) -> DataFrame:
    """groups, threshold, n and n_exact from items' stretches."""
    grid = _ascending(grid)
    sizes = items.groupBy(*groups).agg(F.count(F.lit(1)).alias("n"))
    some = items.where("low < high")
    ends = some.select(*groups, F.explode(F.array(F.struct(F.col("low").alias("_at"), F.lit(1).alias("_d")), F.struct(F.col("high").alias("_at"), F.lit(-1).alias("_d")))).alias("x"))
    events = ends.groupBy(*groups, F.col("x._at").alias("_at")).agg(F.sum("x._d").alias("n_exact"))
    return _along(events, groups, sizes, grid, ["n_exact"])


def threshold_curves(long: DataFrame, grid: Sequence[float], group: str = "row_id", key: str = "index", eps: float = 1e-4) -> DataFrame:
    """group, threshold, n, n_exact, em, tp, fp, fn, precision, recall, f1 and pred_n_act at every threshold.

    long has a row for each group, key and muscle with pred and gold; predictions above a threshold are active. Null
    predictions never are. The rows are shuffled once, by (group, key), and counts combine before they are shuffled.
    """
    grid = _ascending(grid)
    exact = exact_curve(item_stretches(long, grid, (group, key), eps), [group], grid)
    at, on = passed(F.col("pred"), grid), F.coalesce(F.col("gold") > eps, F.lit(False))
    # A prediction counts from the first place on and no more from the place that it does not pass.
    ends = long.select(group, on.alias("_on"), at.alias("_b")).groupBy(group, "_on", "_b").agg(F.count(F.lit(1)).alias("_c"))
    ends = ends.select(group, F.explode(F.array(F.struct(F.lit(0).alias("_at"), F.col("_c").alias("_d")), F.struct(F.col("_b").alias("_at"), (-F.col("_c")).alias("_d")))).alias("x"), "_on")
    events = ends.groupBy(group, F.col("x._at").alias("_at")).agg(F.sum(F.when(F.col("_on"), F.col("x._d")).otherwise(0)).alias("tp"), F.sum(F.when(~F.col("_on"), F.col("x._d")).otherwise(0)).alias("fp"))
    sizes = long.groupBy(group).agg(F.count_if(on).alias("n_active"))
    counts = _along(events, [group], sizes, grid, ["tp", "fp"]).withColumn("fn", F.col("n_active") - F.col("tp"))
    right = counts.withColumnsRenamed({group: "_g", "threshold": "_t"})
    both = exact.join(right, _same([group, "threshold"], ["_g", "_t"])).drop("_g", "_t", "n_active")
    p, r, f1 = prf(F.col("tp"), F.col("fp"), F.col("fn"))
    return both.withColumns({"em": F.col("n_exact") / F.col("n"), "precision": p, "recall": r, "f1": f1, "pred_n_act": (F.col("tp") + F.col("fp")) / F.col("n")})


def best_of(curve: DataFrame, groups: Sequence[str], metric: str = "em") -> DataFrame:
    """The row of each group with the largest metric, the smaller threshold among equals."""
    names = [c for c in curve.columns if c not in groups]
    best = curve.groupBy(*groups).agg(F.max(F.struct(F.col(metric).alias("_m"), (-F.col("threshold")).alias("_t"), F.struct(*names).alias("_row"))).alias("b"))
    return best.select(*groups, "b._row.*")


def seed_sweep(val: DataFrame, others: dict[str, DataFrame], grid: Sequence[float], seeds: Sequence[int], n_select: int, eps: float = 1e-4) -> DataFrame:
    """row_id, seed, threshold, val_em and for each other set name_em and name_f1 at that threshold; seed null: chosen on all of val.

    A seed's sample are the n_select items of val that come first in the order of a hash of seed and item. Items are
    cut by a hash bound that lets n_select pass, found from counts of hash prefixes, so none are sorted as a whole.
    """
    grid = _ascending(grid)
    items = item_stretches(val, grid, ("row_id", "index"), eps)
    every = exact_curve(items, ["row_id"], grid).withColumn("seed", F.lit(None).cast("long"))
    drawn = items.withColumn("seed", F.explode(F.array(*[F.lit(int(s)).cast("long") for s in seeds])))
    # The same items of every row are compared, so the order depends on the item alone.
    drawn = drawn.withColumn("_h", F.md5(F.concat_ws(":", F.col("seed").cast("string"), F.col("index").cast("string")))).withColumn("_p", F.substring("_h", 1, 3))
    sizes = drawn.groupBy("row_id", "seed", "_p").agg(F.count(F.lit(1)).alias("_n"))
    ahead = Window.partitionBy("row_id", "seed").orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select(F.col("row_id").alias("_r"), F.col("seed").alias("_s"), F.col("_p").alias("_q"), F.coalesce(F.sum("_n").over(ahead), F.lit(0)).alias("_ahead")).where(F.col("_ahead") < n_select)
    own = Window.partitionBy("row_id", "seed", "_p").orderBy("_h", "index")
    taken = drawn.join(sizes, _same(["row_id", "seed", "_p"], ["_r", "_s", "_q"])).withColumn("_k", F.col("_ahead") + F.row_number().over(own)).where(F.col("_k") <= n_select)
    curves = exact_curve(taken, ["row_id", "seed"], grid).unionByName(every)
    best = best_of(curves.withColumn("em", F.col("n_exact") / F.col("n")), ["row_id", "seed"])
    out = best.select("row_id", "seed", "threshold", F.col("em").alias("val_em"))
    for name, long in others.items():
        c = threshold_curves(long, grid, eps=eps).select(F.col("row_id").alias("_g"), F.col("threshold").alias("_t"), F.col("em").alias(f"{name}_em"), F.col("f1").alias(f"{name}_f1"))
        out = out.join(c, _same(["row_id", "threshold"], ["_g", "_t"]), "left").drop("_g", "_t")
    return out


def accuracy_curve(df: DataFrame, score: Column, gold: Column, grid: Sequence[float]) -> DataFrame:
    """threshold, n, n_ok of `score > threshold` against a boolean gold; null scores are never above."""
    grid = _ascending(grid)
    on = F.coalesce(gold, F.lit(False))
    # Right from the first place up to where it ends to pass, or from there on.
    d = df.select(F.lit(0).alias("_g"), passed(score.cast("double"), grid).alias("_b"), on.alias("_on"))
    items = d.select("_g", F.when(F.col("_on"), 0).otherwise(F.col("_b")).alias("low"), F.when(F.col("_on"), F.col("_b")).otherwise(len(grid)).alias("high"))
    return exact_curve(items, ["_g"], grid).select("threshold", "n", F.col("n_exact").alias("n_ok"))
