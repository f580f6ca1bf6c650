"""Ranks, runs and running sums of groups of any size: a group is dealt over bins of its order, which are put together by a small table."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DecimalType, FractionalType, NumericType, StructType
from pyspark.sql.window import Window

from .ranking import _same

#: Bins of a group at most, and the rows of a group that need none.
BINS, AT_ONCE = 256, 100_000
#: A group or value with more rows than this part of all is joined by broadcast: there are fewer than HOT_PART of them.
HOT_PART, HOT_ROWS = 1000, 10_000


def with_facts(rows: DataFrame, facts: DataFrame, keys: Sequence[str], total: int, most: int, count: str) -> DataFrame:
    """rows joined with facts on keys, null with null; facts that concern very many rows are broadcast, count says how many.

    total and most are the sum and the largest of the counts.
    """
    names = [f"_f{i}" for i in range(len(keys))]
    f = facts.withColumnsRenamed(dict(zip(keys, names, strict=True)))
    line, same = max(HOT_ROWS, total // HOT_PART), _same(keys, names)
    if most <= line:
        return rows.join(f, same).drop(*names)
    hot = f.where(F.col(count) > line)
    cold = rows.join(F.broadcast(hot.select(*names)), same, "left_anti").join(f.where(F.col(count) <= line), same)
    return rows.join(F.broadcast(hot), same).unionByName(cold).drop(*names)


def largest(df: DataFrame, groups: Sequence[str]) -> tuple[int, int]:
    """(rows, rows of the largest group)."""
    r = df.groupBy(*groups).agg(F.count(F.lit(1)).alias("n")).agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.max("n"), F.lit(0))).first()
    return r[0], r[1]


def binned(df: DataFrame, groups: Sequence[str], by: str, bins: int = BINS, at_once: int = AT_ONCE) -> DataFrame:
    """df with _bin: bins of each group by approximate quantiles of a number, in its order, null and NaN last.

    Equal values share a bin. Where the edges lie changes nothing but how even the bins are. If no group has more than
    at_once rows, each is one bin. A struct is ordered by its fields, as Spark orders it: bins are cut by the first
    one, and where a frequent value fills a bin, that is cut by the next one.
    """
    total, most = largest(df, groups)
    if most <= at_once:
        return df.withColumn("_bin", F.lit(0))
    kind = df.schema[by].dataType
    if isinstance(kind, StructType):
        return _binned_struct(df, groups, by, kind, bins, at_once)
    value = F.col(by).cast("double")
    return _cut(df, groups, value, bins, total, most).withColumn("_bin", F.when(value.isNull() | F.isnan(value), F.lit(bins)).otherwise(F.col("_low"))).drop("_low", "_edge")


def _cut(df: DataFrame, groups: Sequence[str], value: Column, bins: int, total: int, most: int) -> DataFrame:
    """df with _low, how many of its group's edges lie below a double, and _edge, whether it is an edge."""
    known = F.when(~F.isnan(value), value)
    shares = F.array(*[F.lit(i / bins) for i in range(1, bins)])
    edges = df.groupBy(*groups).agg(F.percentile_approx(known, shares, 10 * bins).alias("_edges"), F.count(F.lit(1)).alias("_m"))
    edges = edges.withColumn("_edges", F.array_sort(F.array_distinct(F.coalesce("_edges", F.array().cast("array<double>")))))
    joined = with_facts(df, edges, groups, total, most, "_m") if groups else df.crossJoin(F.broadcast(edges))
    n = F.size("_edges")
    steps = F.array(*[F.lit(1 << b) for b in reversed(range(bins.bit_length()))])
    search = F.aggregate(steps, F.lit(0), lambda lo, s: F.when((lo + s <= n) & (F.get("_edges", F.least(lo + s, n) - 1) < value), lo + s).otherwise(lo))
    return joined.withColumn("_low", search).withColumn("_edge", F.coalesce(F.get("_edges", F.col("_low")) == value, F.lit(False))).drop("_edges", "_m")


def _binned_struct(df: DataFrame, groups: Sequence[str], by: str, kind: StructType, bins: int, at_once: int) -> DataFrame:
    """_bin by a struct's leading numbers. A bin is cut further only if it holds a single value, so the order stays."""
    width, keys, d = 2 * bins + 4, list(groups), df.withColumns({"_bin": F.lit(0).cast("long"), "_single": F.lit(True)})
    for field in kind.fields:
        total, most = largest(d.where("_single"), keys)
        if most <= at_once or not isinstance(field.dataType, NumericType):
            break
        raw = F.col(by)[field.name]
        # Whole numbers from 2**53 on share doubles, and decimals may; bins of these are not cut by further fields.
        exact = F.lit(True) if isinstance(field.dataType, FractionalType) else F.abs(raw.cast("double")) < 1 << 53
        exact = F.lit(False) if isinstance(field.dataType, DecimalType) else exact
        value = F.when(F.col("_single"), raw.cast("double"))
        low = F.when(value.isNull(), 0).when(F.isnan(value), width - 2).otherwise(2 * F.col("_low") + 1 + F.col("_edge").cast("int"))
        single = F.col("_single") & (value.isNull() | F.isnan(value) | F.col("_edge")) & F.coalesce(exact, F.lit(True))
        d = _cut(d, keys, value, bins, *largest(d, keys)).withColumns({"_bin": F.col("_bin") * width + low, "_single": single}).drop("_low", "_edge")
        keys = [*groups, "_bin"]
    return d.withColumn("_bin", F.when(F.col(by).isNull(), F.lit((1 << 63) - 1)).otherwise(F.col("_bin"))).drop("_single")


def _offsets(df: DataFrame, groups: Sequence[str], weight: Column) -> DataFrame:
    """(groups as _o0 ..., _b, _before): the sum of weights in earlier bins of a group; at most BINS rows a group."""
    names = [f"_o{i}" for i in range(len(groups))]
    sizes = df.groupBy(*[F.col(g).alias(n) for g, n in zip(groups, names, strict=True)], F.col("_bin").alias("_b")).agg(F.sum(weight).alias("_m"))
    ahead = Window.partitionBy(*names).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    return sizes.select(*names, "_b", F.coalesce(F.sum("_m").over(ahead), F.lit(0)).alias("_before"))


def average_ranks(df: DataFrame, groups: Sequence[str], value: str, out: str = "rank", bins: int = BINS, at_once: int = AT_ONCE) -> DataFrame:
    """groups, value, n and the mean rank from 1 that its rows share: a row for each distinct value.

    Equal values combine before the shuffle, so a value may have any share of the rows.
    """
    c = df.groupBy(*groups, value).agg(F.count(F.lit(1)).alias("n"))
    b = binned(c, groups, value, bins, at_once)
    names = [f"_o{i}" for i in range(len(groups))]
    own = Window.partitionBy(*groups, "_bin").orderBy(F.col(value).asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    d = b.join(_offsets(b, groups, F.col("n")), _same([*groups, "_bin"], [*names, "_b"]))
    below = F.col("_before") + F.coalesce(F.sum("n").over(own), F.lit(0))
    return d.select(*groups, value, "n", (below + (F.col("n") + 1) / 2).alias(out))


def rank_correlation(df: DataFrame, groups: Sequence[str], x: str, y: str, bins: int = BINS, at_once: int = AT_ONCE) -> DataFrame:
    """groups, rho, n: Spearman's coefficient from pairs of values and their numbers, 0.0 where a side is constant.

    Groups of at most at_once rows are ranked by windows. If one is larger no window spans a group: ranks come from
    bins, and pairs of equal values are one row.
    """
    total, most = largest(df, groups)
    if most <= at_once:
        d = df.select(*groups, _window_rank(groups, x).alias("_rx"), _window_rank(groups, y).alias("_ry"), F.lit(1).alias("_c"))
    else:
        d = df.groupBy(*groups, x, y).agg(F.count(F.lit(1)).alias("_c"))
        for name, v in (("_rx", x), ("_ry", y)):
            ranks = average_ranks(df, groups, v, name, bins, at_once).withColumnRenamed("n", f"_n{name}")
            d = with_facts(d, ranks, [*groups, v], *largest(d, [*groups, v]), f"_n{name}")
    c = F.col("_c")
    sums = d.groupBy(*groups).agg(F.sum("_c").alias("n"), *[F.sum(e).alias(k) for k, e in {"_sx": c * F.col("_rx"), "_sy": c * F.col("_ry"), "_xx": c * F.col("_rx") * F.col("_rx"), "_yy": c * F.col("_ry") * F.col("_ry"), "_xy": c * F.col("_rx") * F.col("_ry")}.items()])
    cov = F.col("_xy") - F.col("_sx") * F.col("_sy") / F.col("n")
    vx, vy = F.col("_xx") - F.col("_sx") * F.col("_sx") / F.col("n"), F.col("_yy") - F.col("_sy") * F.col("_sy") / F.col("n")
    rho = F.when((vx > 0) & (vy > 0), cov / F.sqrt(vx * vy)).otherwise(F.lit(0.0))
    return sums.select(*groups, rho.alias("rho"), "n")


def _window_rank(groups: Sequence[str], value: str) -> Column:
    order, ties = Window.partitionBy(*groups).orderBy(F.col(value).asc_nulls_last()), Window.partitionBy(*groups, value)
    return F.rank().over(order) + (F.count(F.lit(1)).over(ties) - 1) / F.lit(2.0)


def rises(df: DataFrame, group: str, order: str, value: str, bins: int = BINS, at_once: int = AT_ONCE) -> DataFrame:
    """group, n, monotonic (every value above the one before it), net_up (the last above the first); orders are distinct."""
    b = binned(df, [group], order, bins, at_once)
    own = Window.partitionBy(group, "_bin").orderBy(order)
    steps = b.withColumn("_next", F.lead(value).over(own))
    parts = steps.groupBy(group, "_bin").agg(
        F.count(F.lit(1)).alias("_n"),
        F.bool_and(F.coalesce(F.col("_next") > F.col(value), F.lit(True))).alias("_up"),
        F.min_by(value, order).alias("_first"),
        F.max_by(value, order).alias("_last"),
    )
    edge = F.lead("_first").over(Window.partitionBy(group).orderBy("_bin"))
    joined = parts.withColumn("_over", F.coalesce(edge > F.col("_last"), F.lit(True)))
    return joined.groupBy(group).agg(F.sum("_n").alias("n"), F.bool_and(F.col("_up") & F.col("_over")).alias("monotonic"), (F.max_by("_last", "_bin") > F.min_by("_first", "_bin")).alias("net_up"))


def running(df: DataFrame, group: str, order: str, inside: dict[str, Callable], summary: dict[str, Column], carry: dict[str, Callable], bins: int = BINS, at_once: int = AT_ONCE) -> DataFrame:
    """df with columns that functions of a window make, one after another.

    inside: over the rows of (group, bin) in order. summary: aggregates of a bin. carry: over the bins of a group in
    order, one row each, from the summaries; they become columns of every row of the bin.
    """
    own = Window.partitionBy(group, "_bin").orderBy(order)
    d = binned(df, [group], order, bins, at_once)
    for k, c in inside.items():
        d = d.withColumn(k, c(own))
    over = Window.partitionBy("_g").orderBy("_b")
    parts = d.groupBy(F.col(group).alias("_g"), F.col("_bin").alias("_b")).agg(*[c.alias(k) for k, c in summary.items()])
    for k, c in carry.items():
        parts = parts.withColumn(k, c(over))
    parts = parts.drop(*summary)
    return d.join(parts, _same([group, "_bin"], ["_g", "_b"])).drop("_g", "_b", "_bin")
