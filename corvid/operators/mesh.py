"""Meshes and simulations as tables: topology, quality, padding, sparse maps, loss weights."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ranking import dense_number


def edges(faces: DataFrame) -> DataFrame:
    """Undirected edges (a < b) of triangles (i, j, k), each once."""
    sides = F.explode(F.array(F.struct("i", "j"), F.struct(F.col("j").alias("i"), F.col("k").alias("j")), F.struct(F.col("k").alias("i"), F.col("i").alias("j"))))
    e = faces.select(sides.alias("e"))
    return e.select(F.least("e.i", "e.j").alias("a"), F.greatest("e.i", "e.j").alias("b")).distinct()


def neighbours(faces: DataFrame) -> DataFrame:
    """Sorted neighbours of each vertex."""
    e = edges(faces)
    both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
    return both.groupBy("a").agg(F.array_sort(F.collect_set("b")).alias("neighbours")).withColumnRenamed("a", "vertex")


def compact_ids(faces: DataFrame) -> DataFrame:
    """old and new number of each vertex that a face uses, in order, from 0."""
    used = faces.select(F.explode(F.array("i", "j", "k")).alias("old")).distinct()
    return dense_number(used, "old", "new")


def sparse_apply(coo: DataFrame, x: DataFrame, row: str = "row", col: str = "col", val: str = "val", value: str = "x") -> DataFrame:
    """Rows of a sparse matrix times a vector: sum of val * x by row."""
    return coo.join(x, col).groupBy(row).agg(F.sum(F.col(val) * F.col(value)).alias(value))


def spiral_gather(features: Column, spiral: Column) -> Column:
    """The features at the indices of a spiral, one after the other."""
    return F.flatten(F.transform(spiral, lambda i: F.get(features, i)))


def displacement(verts: DataFrame, rest: DataFrame) -> DataFrame:
    """Differences of vertex positions to the rest mesh; both have vertex, x, y, z."""
    r = rest.select("vertex", *[F.col(a).alias(f"_{a}") for a in "xyz"])
    return verts.join(F.broadcast(r), "vertex").select("index", "vertex", *[(F.col(a).cast("double") - F.col(f"_{a}").cast("double")).alias(f"d{a}") for a in "xyz"])


def all_finite(values: Column) -> Column:
    return F.forall(values, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))


def min_jerk(t: Column) -> Column:
    """Smooth ramp from 0 to 1: 10 t^3 - 15 t^4 + 6 t^5."""
    return t * t * t * (F.lit(10.0) - 15.0 * t + 6.0 * t * t)


def element_quality(elements: DataFrame, group: str = "index", ratio: str = "ratio", weight: str = "volume") -> DataFrame:
    """Volume ratio, least element ratio and inverted elements of each mesh from its elements."""
    r = F.col(ratio)
    return elements.groupBy(group).agg(F.try_divide(F.sum(r * F.col(weight)), F.sum(weight)).alias("vol_ratio"), F.min(r).alias("min_elem_vol"), F.count_if(r <= 0).alias("n_inverted"))


def node_state(nodes: DataFrame, group: str = "index") -> DataFrame:
    """Largest node speed of each mesh without NaNs, and whether there are any."""
    v = F.sqrt(F.col("vx") ** 2 + F.col("vy") ** 2 + F.col("vz") ** 2)
    return nodes.groupBy(group).agg(F.max(F.when(~F.isnan(v), v)).alias("max_vel"), F.bool_or(F.isnan(v)).alias("has_nan"))


def padded(values: Column, size: int | Column) -> tuple[Column, Column]:
    """An array filled up with zeros to a size, and the mask of its own elements."""
    n = size if isinstance(size, Column) else F.lit(size)
    more = F.greatest(n - F.size(values), F.lit(0)).cast("int")
    return F.concat(values, F.array_repeat(F.lit(0.0), more)), F.concat(F.transform(values, lambda _: F.lit(True)), F.array_repeat(F.lit(False), more))


def loss_weight(share: Column, target: float, largest: float) -> Column:
    """The weight of fact tokens at which they make up the target share of a loss, within [1, largest]."""
    w = F.try_divide(F.lit(target / (1 - target)) * (1 - share), share)
    return F.least(F.greatest(F.coalesce(w, F.lit(largest)), F.lit(1.0)), F.lit(float(largest)))


def subset_size(n: Column, ratio: float) -> Column:
    """At least one and at most all of n spans: ceil(n * ratio)."""
    return F.least(n, F.greatest(F.lit(1), F.ceil(n * F.lit(ratio))))
