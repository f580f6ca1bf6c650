"""Many meshes at once: decimation and nearest points on their surfaces, one Arrow group a mesh.

A mesh has a bounded number of vertices (a template's), so a group is small; meshes are dealt over tasks.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.topology import TriangleBlocks, decimate


def _sorted(table: pa.Table, by: str) -> pa.Table:
    return table.sort_by(by)


def _places(table: pa.Table, names: tuple[str, ...], kind) -> np.ndarray:
    return np.stack([table.column(n).to_numpy().astype(kind) for n in names], axis=1) if table.num_rows else np.empty((0, len(names)), dtype=kind)


def nearest_on_surface(points: DataFrame, vertices: DataFrame, faces: DataFrame) -> DataFrame:
    """mesh, point, face, distance, wi, wj, wk, looked: for each point the nearest face of its own mesh and the weights of its corners there.

    points: mesh, point, x, y, z; vertices: mesh, id (from 0, without gaps), x, y, z; faces: mesh, face, i, j, k. Of equally near faces
    the smallest counts. Points of meshes without faces give no row; looked is the number of faces that were compared.
    """
    schema = pa.schema([("mesh", pa.int64()), ("point", pa.int64()), ("face", pa.int64()), *((c, pa.float64()) for c in ("distance", "wi", "wj", "wk")), ("looked", pa.int64())])
    shape = F.array_sort(F.collect_list(F.struct("id", "x", "y", "z"))).alias("v")
    sides = F.array_sort(F.collect_list(F.struct("face", "i", "j", "k"))).alias("f")
    surface = vertices.groupBy("mesh").agg(shape).join(faces.groupBy("mesh").agg(sides), "mesh")

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return schema.empty_table()
        v = np.array([[p["x"], p["y"], p["z"]] for p in right.column("v")[0].as_py()], dtype=np.float64)
        f = right.column("f")[0].as_py()
        blocks = TriangleBlocks(v[np.array([[t["i"], t["j"], t["k"]] for t in f])])
        names = [t["face"] for t in f]
        out = [blocks.nearest(p) for p in _places(left, ("x", "y", "z"), np.float64)]
        cols = [left.column("mesh"), left.column("point"), [names[b] for b, *_ in out], [d**0.5 for _, _, d, _ in out], *([float(w[k]) for _, w, _, _ in out] for k in range(3)), [n for *_, n in out]]
        return pa.table([pa.chunked_array([pa.array(c, s.type)]) if isinstance(c, list) else c for c, s in zip(cols, schema, strict=True)], schema=schema)

    own = points.select(F.col("mesh").cast("long").alias("mesh"), F.col("point").cast("long").alias("point"), "x", "y", "z")
    surface = surface.select(F.col("mesh").cast("long").alias("mesh"), "v", "f")
    return own.groupBy("mesh").cogroup(surface.groupBy("mesh")).applyInArrow(run, "mesh long, point long, face long, distance double, wi double, wj double, wk double, looked long")


def decimated(vertices: DataFrame, faces: DataFrame, keep: int) -> DataFrame:
    """mesh, face, i, j, k: the faces of every mesh over its original vertices after decimation to at most `keep` vertices."""
    schema = pa.schema([("mesh", pa.int64()), *((c, pa.int64()) for c in ("face", "i", "j", "k"))])

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return schema.empty_table()
        v = _places(_sorted(left, "id"), ("x", "y", "z"), np.float64)
        new, kept = decimate(v, _places(_sorted(right, "face"), ("i", "j", "k"), np.int64), keep)
        f = kept[new]
        mesh = left.column("mesh")[0].as_py()
        return pa.table([pa.array([mesh] * len(f), pa.int64()), pa.array(np.arange(len(f))), *(pa.array(f[:, c]) for c in range(3))], schema=schema)

    v = vertices.select(F.col("mesh").cast("long").alias("mesh"), "id", "x", "y", "z")
    f = faces.select(F.col("mesh").cast("long").alias("mesh"), "face", "i", "j", "k")
    return v.groupBy("mesh").cogroup(f.groupBy("mesh")).applyInArrow(run, "mesh long, face long, i long, j long, k long")
