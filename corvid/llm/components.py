"""Connected components of an edge table by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, join_hot, stored

#: Edges in a file of the state, so that a small graph is not spread over many files.
PER_FILE = 500_000


def _smallest(edges: DataFrame) -> DataFrame:
    """u, its smallest neighbour m, and the number _n of its edges; stored."""
    return stored(edges.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("_n")), "cc-low")


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) for every node of an edge; component is the smallest node that it reaches.

    Each step moves neighbours to the smallest node around: after the last step every node hangs on the
    component's smallest one. Minima are combined before the shuffle; nodes with a large share of the edges are
    joined by broadcast. State lives in the shared folder and is deleted as it is superseded. Null ends and loops
    are no edges; repeated edges count once; no edges give no rows.
    """
    e = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct()
    e = stored(e, "cc")
    before, rows = None, None
    while True:
        both = e.select("u", "v").unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        around = _smallest(both)
        above = both.where("v > u")
        large = join_hot(above, around, "u").select(F.col("v").alias("u"), F.least("u", "m").alias("v")).where("u <> v").distinct()
        large = stored(large, "cc-large")
        below = _smallest(large)
        small = join_hot(large, below, "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("x")).select("x.u", "x.v").where("u <> v").distinct()
        after = stored(small if rows is None else small.coalesce(-(-rows // PER_FILE) or 1), "cc")
        for old in (e, around, large, below):
            discard(old)
        e = after
        row = e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(row) == before:
            break
        before, rows = tuple(row), row[0]
    own = e.select("v").distinct().select(F.col("v").alias("node"), F.col("v").alias("component"))
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(own)
