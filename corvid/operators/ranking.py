"""Exact ranks, splits, samples and interleavings with hash order in place of random numbers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def hash_order(key: str) -> Column:
    """A hash of the key's decimal text; equal in other engines."""
    return F.md5(F.col(key).cast("string"))


def bucketed_rank(df: DataFrame, groups: Sequence[str], key: str, out: str = "rank", digits: int = 2) -> DataFrame:
    """Rank from 1 within groups in hash order.

    The first digits of the hash cut each group into buckets whose offsets come from a small aggregate, so a
    group of any size is ranked by many tasks.
    """
    d = df.withColumn("_hash", hash_order(key)).withColumn("_bucket", F.substring("_hash", 1, digits))
    sizes = d.groupBy(*groups, "_bucket").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*groups).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(*groups, "_bucket", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"), F.sum("_n").over(Window.partitionBy(*groups)).alias("_size"))
    match = None
    right = offsets
    for g in [*groups, "_bucket"]:
        right = right.withColumnRenamed(g, f"_r{g}")
        cond = F.col(g).eqNullSafe(F.col(f"_r{g}"))
        match = cond if match is None else match & cond
    own = Window.partitionBy(*groups, "_bucket").orderBy("_hash", key)
    ranked = d.join(right, match).withColumn(out, F.col("_before") + F.row_number().over(own))
    return ranked.drop("_bucket", "_before", "_hash", *[f"_r{g}" for g in [*groups, "_bucket"]])


def stratified_split(df: DataFrame, stratum: str, key: str, val: float = 0.05, test: float = 0.05) -> DataFrame:
    """A column split: the first int(n * val) rows of a stratum are val, the next int(n * test) are test, the rest train."""
    r = bucketed_rank(df, [stratum], key)
    n_val, n_test = F.floor(F.col("_size") * F.lit(val)), F.floor(F.col("_size") * F.lit(test))
    split = F.when(F.col("rank") <= n_val, "val").when(F.col("rank") <= n_val + n_test, "test").otherwise("train")
    return r.withColumn("split", split).drop("rank", "_size")


def quotas(total: int, bins: Sequence[str]) -> dict[str, int]:
    """Equal quotas; the remainder goes to the first bins."""
    each, more = divmod(total, len(bins))
    return {b: each + (i < more) for i, b in enumerate(bins)}


def balanced_sample(df: DataFrame, bin_col: str, wanted: dict[str, int], prefer: Column, key: str) -> DataFrame:
    """Up to the wanted number of rows of each bin, preferred ones first, then in hash order."""
    order = Window.partitionBy(bin_col).orderBy(F.when(prefer, 0).otherwise(1), hash_order(key), key)
    most = F.create_map(*[x for b, n in wanted.items() for x in (F.lit(b), F.lit(n))])
    ranked = df.where(F.col(bin_col).isin(*wanted)).withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= max(wanted.values()))
    return ranked.where(F.col("_r") <= F.element_at(most, F.col(bin_col))).drop("_r")


def _same(left: Sequence[str], right: Sequence[str]) -> Column:
    """Equality of columns, null with null; true without columns."""
    out = F.lit(True)
    for x, y in zip(left, right, strict=True):
        out = out & F.col(x).eqNullSafe(F.col(y))
    return out


def quota_prefix(df: DataFrame, group: str, order: str, weight: str, quota: int, width: int = 100_000) -> DataFrame:
    """Rows of a group as long as the weights before them stay below the quota; the last one may overshoot.

    order is a whole number. A group is cut into runs of `width` values of it, whose sums are added up first, so
    a group of any size is dealt over many tasks.
    """
    d = df.withColumn("_run", F.expr(f"`{order}` div {width}"))
    ahead = Window.partitionBy("_g").orderBy("_r").rowsBetween(Window.unboundedPreceding, -1)
    sums = d.groupBy(F.col(group).alias("_g"), F.col("_run").alias("_r")).agg(F.sum(weight).alias("_w"))
    sums = sums.select("_g", "_r", F.coalesce(F.sum("_w").over(ahead), F.lit(0)).alias("_ahead")).where(F.col("_ahead") < quota)
    own = Window.partitionBy(group, "_run").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    d = d.join(sums, _same([group, "_run"], ["_g", "_r"])).withColumn("_before", F.col("_ahead") + F.coalesce(F.sum(weight).over(own), F.lit(0)))
    return d.where(F.col("_before") < quota).drop("_run", "_g", "_r", "_ahead", "_before")


def round_robin(df: DataFrame, group: str, order: str, limit: int) -> DataFrame:
    """The first rows of all groups, then the second ones, and so on; position from 1."""
    own = Window.partitionBy(group).orderBy(order)
    turns = df.withColumn("_r", F.row_number().over(own)).where(F.col("_r") <= limit)
    head = turns.orderBy("_r", group).limit(limit)
    return head.withColumn("position", F.row_number().over(Window.orderBy("_r", group))).drop("_r")


def per_group_cap(df: DataFrame, group: str, key: str, most: int) -> DataFrame:
    """At most `most` rows of each group, in hash order; partial limits run before the shuffle."""
    own = Window.partitionBy(group).orderBy(hash_order(key), key)
    return df.withColumn("_r", F.row_number().over(own)).where(F.col("_r") <= most).drop("_r")


def next_key(df: DataFrame, groups: Sequence[str], key: str, out: str, width: int = 1_000_000) -> DataFrame:
    """Each row's next larger key within its groups, the smallest one after the largest; _n: rows of the group.

    key is a distinct whole number. Groups are cut into runs of `width` keys; the first keys of the runs are a
    small table, so no task orders a whole group.
    """
    d = df.withColumn("_run", F.expr(f"`{key}` div {width}"))
    names = [f"_g{i}" for i in range(len(groups))]
    whole = Window.partitionBy(*names) if names else Window.partitionBy(F.lit(0))
    runs = d.groupBy(*[F.col(g).alias(n) for g, n in zip(groups, names, strict=True)], F.col("_run").alias("_r")).agg(F.min(key).alias("_first"), F.count(F.lit(1)).alias("_m"))
    runs = runs.withColumns({"_after": F.coalesce(F.lead("_first").over(whole.orderBy("_r")), F.min("_first").over(whole)), "_n": F.sum("_m").over(whole)}).drop("_first", "_m")
    own = Window.partitionBy(*groups, "_run").orderBy(key)
    d = d.join(runs, _same([*groups, "_run"], [*names, "_r"]))
    return d.withColumn(out, F.coalesce(F.lead(key).over(own), F.col("_after"))).drop("_run", "_r", "_after", *names)


def rotate(df: DataFrame, group: str, key: str, out: str = "effective") -> DataFrame:
    """A derangement: each row gets the next key of its group, the last one the first; single rows the next key of all."""
    near = next_key(df, [group], key, "_near")
    alone = near.where("_n = 1").select(F.col(key).alias("_k"))
    overall = next_key(df.select(key), [], key, "_next").join(alone, F.col(key) == F.col("_k"), "left_semi").select(F.col(key).alias("_k"), "_next")
    joined = near.join(overall, F.col(key) == F.col("_k"), "left")
    return joined.withColumn(out, F.when(F.col("_n") > 1, F.col("_near")).otherwise(F.col("_next"))).drop("_near", "_n", "_k", "_next")


def dense_number(df: DataFrame, key: str, out: str, width: int = 1_000_000) -> DataFrame:
    """Numbers from 0 in the order of a distinct long key.

    Rows are ranked within runs of `width` keys; only the runs' sizes are summed up in one task.
    """
    d = df.withColumn("_run", F.expr(f"`{key}` div {width}"))
    before = Window.orderBy("_run").rowsBetween(Window.unboundedPreceding, -1)
    offsets = d.groupBy("_run").agg(F.count(F.lit(1)).alias("_n")).select("_run", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    own = F.row_number().over(Window.partitionBy("_run").orderBy(key))
    return d.join(offsets, "_run").withColumn(out, F.col("_before") + own - 1).drop("_run", "_before")
