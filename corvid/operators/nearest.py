"""Exact nearest vectors: a join over partitions by pivots, pruned by the triangle inequality.

Vectors go to their nearest pivot and, inside it, to rings by their distance from it. A query first looks into the
ring with the smallest bound; what it finds there rules out all rings that can't hold anything nearer. Equal vectors
are one object, so copies cost nothing.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import shared_folder
from .prefix import BINS, binned, with_facts

#: Objects of a ring, queries of a task, and pivots at most; what the driver holds are pivots and a row a ring.
RING, QUERIES, PIVOTS = 4096, 4096, 1024
#: Bounds are loosened by this, since distances are rounded.
SLACK = 1e-9


def _stored(df: DataFrame, name: str) -> DataFrame:
    path = shared_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _matrix(column) -> np.ndarray:
    """Vectors of equal length as rows."""
    arr = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return arr.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(arr), -1) if len(arr) else np.empty((0, 0))


def _far(points: np.ndarray, from_: np.ndarray) -> np.ndarray:
    return np.sqrt(((points - from_) ** 2).sum(axis=1))


def choose_pivots(objects: DataFrame, n: int) -> np.ndarray:
    """Vectors that lie far from each other: of 4 n in hash order, each next one is the farthest from those that are chosen."""
    rows = objects.orderBy(F.xxhash64("vector"), "first").limit(4 * n).select("vector").collect()
    found = np.array([r["vector"] for r in rows], dtype=np.float64)
    chosen = [0]
    far = _far(found, found[0])
    while len(chosen) < min(n, len(found)) and far.max() > 0:
        chosen.append(int(far.argmax()))
        far = np.minimum(far, _far(found, found[chosen[-1]]))
    return found[chosen]


class PivotIndex:
    """The objects of a table by pivot and ring, and the bounds of every ring."""

    def __init__(self, data: DataFrame, id_col: str, vector: str, pivots: int | None = None, ring: int = RING):
        known = data.where(F.col(vector).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.transform(vector, lambda x: x.cast("double")).alias("vector"))
        # Two ids are enough, since a query leaves out one at most. Copies combine before the shuffle.
        least = _stored(known.groupBy("vector").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("_n")), "nearest-least")
        copies = least.where("_n > 1")
        total, most = copies.agg(F.coalesce(F.sum("_n"), F.lit(0)), F.coalesce(F.max("_n"), F.lit(0))).first()
        second = with_facts(known, copies, ["vector"], total, most, "_n").where("id > first").groupBy(F.col("vector").alias("_v")).agg(F.min("id").alias("second"))
        self.objects = _stored(least.join(second, F.col("vector") == F.col("_v"), "left").select("vector", "first", "second"), "nearest-objects")
        n = self.objects.count()
        self.pivots = choose_pivots(self.objects, pivots or max(1, min(PIVOTS, int(n**0.5 / 4)))) if n else np.empty((0, 0))
        self.rings = None
        if n:
            self._assign(ring)

    def _assign(self, ring: int) -> None:
        pivots = self.pivots

        def place(batches):
            for batch in batches:
                m = _matrix(batch.column(0))
                near = np.empty(len(m), dtype=np.int32)
                far = np.full(len(m), np.inf)
                for i, p in enumerate(pivots):
                    d = _far(m, p)
                    better = d < far
                    near[better], far[better] = i, d[better]
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(near), pa.array(far)], names=["vector", "first", "second", "pivot", "far"])

        placed = _stored(self.objects.mapInArrow(place, "vector array<double>, first long, second long, pivot int, far double"), "nearest-placed")
        most = placed.groupBy("pivot").count().agg(F.max("count")).first()[0]
        self.placed = _stored(binned(placed, ["pivot"], "far", min(BINS, -(-most // ring)), ring), "nearest-rings")
        rows = self.placed.groupBy("pivot", "_bin").agg(F.min("far").alias("low"), F.max("far").alias("high"), F.count(F.lit(1)).alias("n"), F.count("second").alias("copies")).collect()
        rows.sort(key=lambda r: (r["pivot"], r["_bin"]))
        self.rings = [(r["pivot"], r["_bin"]) for r in rows]
        self.of_pivot = np.array([r["pivot"] for r in rows])
        self.low, self.high = (np.array([r[c] for r in rows]) for c in ("low", "high"))
        self.size = np.array([r["n"] for r in rows])
        self.safe = np.array([r["n"] + r["copies"] > 1 for r in rows])
        numbers = self.objects.sparkSession.createDataFrame([(p, b, i) for i, (p, b) in enumerate(self.rings)], "pivot int, _bin int, ring int")
        self.placed = self.placed.join(F.broadcast(numbers), ["pivot", "_bin"]).select("ring", "vector", "first", "second")

    def bounds(self):
        """A function of a query's vector: the least distance that an object of each ring can have."""
        pivots, of, low, high = self.pivots, self.of_pivot, self.low, self.high
        between = np.stack([_far(pivots, p) for p in pivots])

        def bound(v: np.ndarray) -> np.ndarray:
            d = _far(pivots, v)
            own = int(d.argmin())
            gap = np.maximum(d[of] - high, low - d[of])
            with np.errstate(divide="ignore", invalid="ignore"):
                plane = (d * d - d[own] * d[own]) / (2 * between[own])
            plane[own] = 0.0
            plane[~np.isfinite(plane)] = 0.0
            return np.maximum(0.0, np.maximum(gap, plane[of])) * (1 - SLACK) - SLACK

        return bound


def _search(index: PivotIndex, visits: DataFrame) -> DataFrame:
    """Visits (query, exclude, vector, ring) to query, d2, nn_id, compared: the best object of each ring, null if it has none."""
    per_ring = {r["ring"]: r["n"] for r in visits.groupBy("ring").agg(F.count(F.lit(1)).alias("n")).collect()}
    spark = visits.sparkSession
    tasks = spark.createDataFrame([(int(k), -(-n // QUERIES)) for k, n in per_ring.items()], "ring int, tasks int")
    v = visits.join(F.broadcast(tasks), "ring").withColumn("salt", F.pmod(F.xxhash64("query"), F.col("tasks")).cast("int")).drop("tasks")
    # Rings with very many queries are dealt over tasks; only their objects are sent more than once.
    objects = index.placed.join(F.broadcast(tasks), "ring").withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("tasks") - 1))).drop("tasks")

    def best(left: pa.Table, right: pa.Table) -> pa.Table:
        queries, exclude = left.column("query"), left.column("exclude").to_pylist()
        first = right.column("first").to_numpy()
        second = right.column("second").to_pylist()
        q, o = _matrix(left.column("vector")), _matrix(right.column("vector"))
        d2s, ids = [], []
        for x, skip in zip(q, exclude, strict=True):
            d2 = ((o - x) ** 2).sum(axis=1)
            least, nn = None, None
            while len(d2):
                near = float(d2.min())
                if not np.isfinite(near):
                    break
                here = np.flatnonzero(d2 == near)
                named = [int(first[i]) if first[i] != skip else second[i] for i in here.tolist()]
                named = [i for i in named if i is not None]
                if named:
                    least, nn = near, min(named)
                    break
                d2[here] = np.inf
            d2s.append(least)
            ids.append(nn)
        return pa.table({"query": queries, "d2": pa.array(d2s, pa.float64()), "nn_id": pa.array(ids, pa.int64()), "compared": pa.array([len(o)] * len(q), pa.int64())})

    schema = "query long, d2 double, nn_id long, compared long"
    return v.groupBy("ring", "salt").cogroup(objects.groupBy("ring", "salt")).applyInArrow(best, schema)


def nearest_join(queries: DataFrame, index: PivotIndex, query: str, exclude: str, vector: str) -> DataFrame:
    """query, nn_id, distance, compared: the nearest object of each query but for the id that it excludes, the smallest id among equals.

    query is a distinct number of each row. Queries without a vector, and without any other object, give no row. compared
    is the number of objects that the query met, which a product would make all of them.
    """
    spark = queries.sparkSession
    if index.rings is None:
        return spark.createDataFrame([], "query long, nn_id long, distance double, compared long")
    q = queries.where(F.col(vector).isNotNull()).select(F.col(query).cast("long").alias("query"), F.col(exclude).cast("long").alias("exclude"), F.transform(vector, lambda x: x.cast("double")).alias("vector"))
    bound, safe = index.bounds(), index.safe

    def first_visit(batches):
        for batch in batches:
            m = _matrix(batch.column(2))
            rings = []
            for x in m:
                b = bound(x)
                b = np.where(safe, b, np.inf) if safe.any() else b
                rings.append(int(b.argmin()))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(rings, pa.int32())], names=["query", "exclude", "vector", "ring"])

    visit = "query long, exclude long, vector array<double>, ring int"
    started = _stored(q.mapInArrow(first_visit, visit), "nearest-first")
    found = _stored(_search(index, started), "nearest-found")

    def more_visits(batches):
        for batch in batches:
            out: list[list] = [[], []]
            m, done, limit = _matrix(batch.column(2)), batch.column(3).to_pylist(), batch.column(4).to_pylist()
            for i, x in enumerate(m):
                b = bound(x)
                open_ = b <= (np.inf if limit[i] is None else limit[i] ** 0.5)
                open_[done[i]] = False
                rings = np.flatnonzero(open_).tolist()
                out[0] += [i] * len(rings)
                out[1] += rings
            rows = pa.array(out[0], pa.int64())
            yield pa.RecordBatch.from_arrays([*(batch.column(k).take(rows) for k in range(3)), pa.array(out[1], pa.int32())], names=["query", "exclude", "vector", "ring"])

    limits = started.join(found.select(F.col("query").alias("_q"), "d2"), F.col("query") == F.col("_q")).drop("_q")
    again = _stored(limits.mapInArrow(more_visits, visit), "nearest-more")
    every = found.unionByName(_search(index, again))
    least = F.min(F.when(F.col("nn_id").isNotNull(), F.struct("d2", "nn_id"))).alias("b")
    best = every.groupBy("query").agg(least, F.sum("compared").alias("compared")).where("b is not null")
    return best.select("query", F.col("b.nn_id").alias("nn_id"), F.sqrt("b.d2").alias("distance"), "compared")


def nearest(queries: DataFrame, data: DataFrame, id_col: str, vector: str, pivots: int | None = None, ring: int = RING) -> DataFrame:
    """id, nn_id, distance: the nearest other row by Euclidean distance, the smallest id among equals."""
    index = PivotIndex(data, id_col, vector, pivots, ring)
    own = queries.select(F.col(id_col).alias("id"), F.col(id_col).alias("_own"), vector)
    return nearest_join(own, index, "id", "_own", vector).select(F.col("query").alias("id"), "nn_id", "distance")
