"""Ranks with ties, rank correlation, monotone tiers, slopes, arc lengths, per-element and vector statistics."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .prefix import rank_correlation, rises, running


def correlation(x: Column | str, y: Column | str) -> Column:
    """Pearson's coefficient; 0.0 where a side is constant."""
    return F.coalesce(F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y)), F.lit(0.0))


def spearman(df: DataFrame, groups: Sequence[str], x: str, y: str) -> DataFrame:
    """rho and n of each group, over average ranks; a group may hold any share of the rows."""
    return rank_correlation(df, groups, x, y)


def dose_response(rows: DataFrame, group: str, level: str, response: str, least: int = 3, near: float = 0.9) -> DataFrame:
    """One sweep a group from rows with one response a level: n levels, rho, monotonicity and tier.

    strict: each step rises; near: rho of at least `near` and the last response above the first; else partial.
    Groups of fewer than `least` levels give no row. Levels of a group are dealt over bins, so a sweep may have any length.
    """
    up = rises(rows, group, level, response).withColumnRenamed("n", "n_levels").where(F.col("n_levels") >= least)
    rho = rank_correlation(rows, [group], level, response).select(F.col(group).alias("_g"), F.round("rho", 9).alias("rho"))
    out = up.join(rho, F.col(group).eqNullSafe(F.col("_g"))).drop("_g")
    tier = F.when(F.col("monotonic"), "strict").when((F.col("rho") >= near) & F.col("net_up"), "near").otherwise("partial")
    return out.select(group, "n_levels", "rho", "monotonic", "net_up", tier.alias("tier"))


def arc_length(df: DataFrame, group: str, order: str, value: str) -> DataFrame:
    """Length of the path of values up to each row; orders are distinct."""
    step = lambda w: F.coalesce(F.abs(F.col(value) - F.lag(value).over(w)), F.lit(0.0))
    inside = {"_step": step, "_arc": lambda w: F.sum("_step").over(w.rowsBetween(Window.unboundedPreceding, 0))}
    summary = {"_sum": F.sum("_step"), "_first": F.min_by(value, order), "_last": F.max_by(value, order)}
    # What earlier bins are long, with the steps from each bin to the next one.
    whole = lambda w: F.col("_sum") + F.coalesce(F.abs(F.col("_first") - F.lag("_last").over(w)), F.lit(0.0))
    carry = {"_whole": whole, "_ahead": lambda w: F.sum("_whole").over(w.rowsBetween(Window.unboundedPreceding, 0)) - F.col("_sum")}
    d = running(df, group, order, inside, summary, carry)
    return d.withColumn("arc", F.col("_ahead") + F.col("_arc")).drop("_step", "_arc", "_whole", "_ahead")


def exact_quantiles(df: DataFrame, groups: Sequence[str], x: str, probs: Sequence[float], bins: int = 1024) -> DataFrame:
    """groups and q (an array with the linear quantile for each probability) of non-null x.

    Equal values combine first. Each group is cut into bins of equal width, whose counts tell which of them hold
    the wanted ranks; only those bins are ordered, so no task holds all values of a group.
    """
    names = list(groups)
    c = df.where(F.col(x).isNotNull()).groupBy(*names, F.col(x).cast("double").alias("_x")).agg(F.count(F.lit(1)).alias("_c")).withColumn("_all", F.lit(0))
    keys = [*names, "_all"]
    span = c.groupBy(*keys).agg(F.min("_x").alias("_low"), F.max("_x").alias("_high"), F.sum("_c").alias("_n"))
    bin_of = F.least(F.lit(bins - 1), F.floor(F.coalesce(F.try_divide(F.col("_x") - F.col("_low"), F.col("_high") - F.col("_low")), F.lit(0.0)) * bins)).cast("int")
    binned = c.join(F.broadcast(span) if not names else span, keys).withColumn("_bin", bin_of)
    sizes = binned.groupBy(*keys, "_bin").agg(F.sum("_c").alias("_m"), F.first("_n").alias("_n"))
    upto = Window.partitionBy(*keys).orderBy("_bin").rowsBetween(Window.unboundedPreceding, 0)
    sizes = sizes.withColumn("_upto", F.sum("_m").over(upto))
    places = []
    for i, p in enumerate(probs):
        at = F.lit(float(p)) * (F.col("_n") - 1)
        places += [F.struct(F.lit(i).alias("i"), F.lit(0).alias("side"), F.floor(at).alias("rank"), (at - F.floor(at)).alias("part")), F.struct(F.lit(i).alias("i"), F.lit(1).alias("side"), F.ceil(at).alias("rank"), (at - F.floor(at)).alias("part"))]
    wanted = sizes.withColumn("_w", F.explode(F.array(*places))).where("_w.rank >= _upto - _m and _w.rank < _upto").select(*keys, "_bin", "_w", (F.col("_upto") - F.col("_m")).alias("_before"))
    inside = Window.partitionBy(*keys, "_bin").orderBy("_x").rowsBetween(Window.unboundedPreceding, 0)
    ordered = binned.join(wanted.select(*keys, "_bin").distinct(), [*keys, "_bin"], "left_semi").withColumn("_cum", F.sum("_c").over(inside))
    hit = ordered.select(*keys, "_bin", "_x", "_c", "_cum").join(wanted, [*keys, "_bin"]).where("_w.rank - _before >= _cum - _c and _w.rank - _before < _cum")
    sides = hit.groupBy(*keys, F.col("_w.i").alias("_i")).agg(F.max(F.when(F.col("_w.side") == 0, F.col("_x"))).alias("_lo"), F.max(F.when(F.col("_w.side") == 1, F.col("_x"))).alias("_hi"), F.max("_w.part").alias("_part"))
    value = F.col("_lo") + (F.col("_hi") - F.col("_lo")) * F.col("_part")
    listed = sides.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("_i", value.alias("v")))).alias("_q"))
    return listed.select(*names, F.col("_q.v").alias("q"))


def region_thirds(df: DataFrame, group: str, x: str) -> DataFrame:
    """front below the first third of x in its group, mid below the second, back above; exact linear quantiles."""
    q = exact_quantiles(df, [group], x, (1 / 3, 2 / 3)).withColumnRenamed("q", "_q")
    region = F.when(F.col(x) < F.col("_q")[0], "front").when(F.col(x) < F.col("_q")[1], "mid").otherwise("back")
    return df.join(q, group).withColumn("region", region).drop("_q")


def first_argmax(names: Sequence[str], values: Sequence[Column]) -> Column:
    """The name of the first of the largest values."""
    a = F.array(*values)
    return F.element_at(F.array(*map(F.lit, names)), F.array_position(a, F.array_max(a)).cast("int"))


def element_stats(df: DataFrame, vector: str) -> DataFrame:
    """Mean and population deviation of every element; a row for each dimension, combined before the shuffle."""
    e = df.select(F.posexplode(vector).alias("dim", "x"))
    return e.groupBy("dim").agg(F.avg(F.col("x").cast("double")).alias("mean"), F.stddev_pop(F.col("x").cast("double")).alias("std"), F.count(F.lit(1)).alias("n"))


def zscore(x: Column, mean: Column, std: Column, floor: float = 1e-6) -> Column:
    return (x - mean) / F.greatest(std, F.lit(floor))


def mean_offdiagonal_cosine(df: DataFrame, group: str, vector: str) -> DataFrame:
    """Mean cosine of different rows of a group, from the sum of unit vectors: (|sum|^2 - n) / (n (n - 1)), without pairs."""
    unit = df.select(group, F.expr(f"transform({vector}, x -> cast(x as double) / sqrt(aggregate({vector}, 0D, (a, y) -> a + cast(y as double) * cast(y as double))))").alias("u"))
    sums = unit.select(group, F.posexplode("u").alias("dim", "x")).groupBy(group, "dim").agg(F.sum("x").alias("s"), F.count(F.lit(1)).alias("n"))
    return sums.groupBy(group).agg(((F.sum(F.col("s") * F.col("s")) - F.max("n")) / (F.max("n") * (F.max("n") - 1))).alias("cosine"), F.max("n").alias("n"))
