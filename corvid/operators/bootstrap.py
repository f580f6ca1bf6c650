"""Paired bootstrap of any metric that is a function of sums: every item has a Poisson weight in every resample.

The weights are integers that follow from a hash of item and resample, so a resample's sums combine before the
shuffle like any other, reruns agree, and SQL can say the same. Nothing is drawn on the driver.
"""

from __future__ import annotations

import math
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The hash works modulo this prime, so that all products fit 64 bits.
PRIME = (1 << 31) - 1


#: SQL for numbers of 0 to PRIME - 1 from the whole numbers item and sample; each may use the ones before it.
ROUNDS = {
    "u0": f"(item % {PRIME} * 48271 + sample * 69621 + 12345) % {PRIME}",
    "u1": f"(u0 * u0 % {PRIME} + item % {PRIME} + sample * 7919) % {PRIME}",
    "u2": f"(u1 * u1 % {PRIME} + u0) % {PRIME}",
    "u": f"(u2 * 630360016 + 950706376) % {PRIME}",
}


def poisson_steps(largest: int = 12) -> list[int]:
    """The hash values from which a weight is 1, 2, ...: the cumulative Poisson distribution with mean 1."""
    out, p, total = [], math.exp(-1), 0.0
    for k in range(largest):
        total += p
        out.append(int(total * PRIME))
        p /= k + 1
    return out


def weighted_sql(rows: str, samples: int) -> str:
    """DuckDB SQL for all columns of `rows` (with item), sample and w: the weight of each row in each sample."""
    out = f"SELECT * FROM {rows}, (SELECT unnest(range(0, {samples})) AS sample)"
    for name, rule in ROUNDS.items():
        out = f"SELECT *, {rule} AS {name} FROM ({out})"
    return f"SELECT *, {' + '.join(f'(u >= {s})::INT' for s in poisson_steps())} AS w FROM ({out})"


def resampled(df: DataFrame, item: str, sums: Mapping[str, Column], samples: int) -> DataFrame:
    """sample (-1: as they are), n and every named sum, weighted; item is a distinct number of each row that is not negative.

    Each task keeps one row a sample, so the rows themselves are not shuffled.
    """
    d = df.select(F.col(item).cast("long").alias("item"), *[c.cast("double").alias(n) for n, c in sums.items()])
    each = d.withColumn("sample", F.explode(F.sequence(F.lit(-1).cast("long"), F.lit(samples - 1).cast("long"))))
    for name, rule in ROUNDS.items():
        each = each.withColumn(name, F.expr(rule))
    weight = F.when(F.col("sample") < 0, F.lit(1)).otherwise(sum((F.when(F.col("u") >= s, 1).otherwise(0) for s in poisson_steps()), F.lit(0)))
    w = each.withColumn("w", weight)
    return w.groupBy("sample").agg(F.sum("w").alias("n"), *[F.sum(F.col("w") * F.col(n)).alias(n) for n in sums])


def bootstrap(df: DataFrame, item: str, sums: Mapping[str, Column], statistic: Column, samples: int = 20_000, level: float = 0.95) -> DataFrame:
    """n, value, low, high: a statistic of the sums (columns n and the names) and its percentile interval over the resamples.

    The quantiles are exact over `samples` numbers. Resamples without items have no value and don't count; without rows
    the result is empty.
    """
    found = resampled(df, item, sums, samples).withColumn("_v", statistic)
    a = (1 - level) / 2
    own = lambda c: F.max(F.when(F.col("sample") < 0, F.col(c)))
    drawn = F.when(F.col("sample") >= 0, F.col("_v"))
    out = found.agg(own("n").alias("n"), own("_v").alias("value"), F.percentile(drawn, a).alias("low"), F.percentile(drawn, 1 - a).alias("high"))
    return out.where("n is not null")


def f1_of(tp: str, fp: str, fn: str) -> Column:
    return F.coalesce(F.try_divide(2 * F.col(tp), 2 * F.col(tp) + F.col(fp) + F.col(fn)), F.lit(0.0))


def mean_difference(a: str, b: str) -> Column:
    return F.try_divide(F.col(a) - F.col(b), F.col("n"))
