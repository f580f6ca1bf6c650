"""Index layer: shard addresses, pruned joins, membership, validity ladders, neighbour deltas, keep-first dedup."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def shard_address(df: DataFrame, id_col: str, size: int = 1000) -> DataFrame:
    """verts_shard and row_in_shard of non-negative ids."""
    return df.withColumns({"verts_shard": F.expr(f"`{id_col}` div {size}"), "row_in_shard": F.col(id_col) % size})


def pruned_left_join(left: DataFrame, right: DataFrame, key: str, cols: Sequence[str]) -> DataFrame:
    """All rows of left with only the named columns of right."""
    return left.join(right.select(key, *cols), key, "left")


def valid_only(df: DataFrame, valid: DataFrame, key: str) -> DataFrame:
    return df.join(valid.select(key), key, "left_semi")


def missing_from(df: DataFrame, known: DataFrame, key: str) -> DataFrame:
    return df.join(known.select(key), key, "left_anti")


def require_all(df: DataFrame, known: DataFrame, key: str) -> DataFrame:
    """df, or an error that names the number of its keys that are unknown."""
    lost = missing_from(df, known, key).count()
    if lost:
        raise ValueError(f"{lost} rows of {key} are not in the table")
    return df


def value_counts(df: DataFrame, *cols: str) -> DataFrame:
    """Counts by the columns, with a group for null."""
    return df.groupBy(*cols).agg(F.count(F.lit(1)).alias("n"))


def ladder(rules: Sequence[tuple[str, str, Column]], marginal: Sequence[tuple[str, Column]], ok: str = "VALID", doubtful: str = "MARGINAL") -> tuple[Column, Column]:
    """(label, reason): the first rule that holds decides; else the marginal reasons are joined by semicolons."""
    reasons = F.concat_ws(";", *[F.when(cond, F.lit(reason)) for reason, cond in marginal])
    label = F.when(reasons != "", F.lit(doubtful)).otherwise(F.lit(ok))
    reason = reasons
    for name, why, cond in reversed(rules):
        label, reason = F.when(cond, F.lit(name)).otherwise(label), F.when(cond, F.lit(why)).otherwise(reason)
    return label, reason


def with_shares(counts: DataFrame, n: str = "n") -> DataFrame:
    """Counts with their share of the total, from a small table of counts."""
    total = Window.partitionBy(F.lit(0))
    return counts.withColumn("share", F.round(F.col(n) / F.sum(n).over(total), 6))


def neighbor_delta(df: DataFrame, key: str, base: Column, values: Sequence[str]) -> DataFrame:
    """Each row with the differences of its values to those of its base row; null where the base is unknown."""
    own = df.select(key, *values, base.alias("_base"))
    other = df.select(F.col(key).alias("_base"), *[F.col(v).alias(f"_{v}") for v in values])
    joined = own.join(other, "_base", "left")
    return joined.select(key, F.col("_base").alias("base_index"), *[(F.col(v) - F.col(f"_{v}")).alias(f"d_{v}") for v in values])


def pairs(df: DataFrame, order: str, cols: Sequence[str]) -> DataFrame:
    """Unordered pairs i < j of a small dimension table; a theta join, not for fact tables."""
    a = df.select(*[F.col(c).alias(f"{c}_a") for c in [order, *cols]])
    b = df.select(*[F.col(c).alias(f"{c}_b") for c in [order, *cols]])
    return a.join(b, F.col(f"{order}_a") < F.col(f"{order}_b"))


def keep_first(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The first row by order of each group of equal keys. Groups combine before the shuffle, hot ones too.

    Rows are grouped by two hashes of the keys, 192 bits together, so long texts and arrays are neither
    compared nor sorted; that two different keys share both is not to be expected of any number of rows.
    """
    rest = [c for c in df.columns if c not in order]
    own = F.to_json(F.struct(*keys), {"ignoreNullFields": "false"})
    best = df.groupBy(F.unhex(F.md5(own)).alias("_h"), F.xxhash64(*keys).alias("_x")).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("_row"), F.min(F.struct(*order)).alias("_order"))
    return best.select(*[F.col(f"_order.{c}" if c in order else f"_row.{c}").alias(c) for c in df.columns])


def membership_policies(lists: DataFrame, key: str, item: str, member: Column, order: str) -> DataFrame:
    """For each key: whether all, the first, or any of its items are members."""
    return lists.groupBy(key).agg(F.bool_and(member).alias("in_all"), F.min_by(member, order).alias("in_primary"), F.bool_or(member).alias("in_any"))


def remap(df: DataFrame, ref: str, mapping: DataFrame, old: str, new: str, lost: int = -1) -> DataFrame:
    """References renumbered by a mapping; those to rows that are gone become `lost`."""
    m = mapping.select(F.col(old).alias(ref), F.col(new).alias("_new"))
    return df.join(m, ref, "left").withColumn(ref, F.coalesce("_new", F.lit(lost))).drop("_new")
