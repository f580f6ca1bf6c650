"""Geometry shards as a data source: big-endian float32 rows of fixed size in shard_NNNNN.bin.

Reading: a partition is a range of bytes, and ids that a filter names are turned into places, so that a lookup reads
its rows' bytes alone. Writing: each task writes its shards under .part names, with their metadata beside them; only
when all tasks have ended are they renamed, metadata first, so a shard that is there is whole and has its metadata.
Paths are those that pyarrow opens; renames must be atomic there.
"""

from __future__ import annotations

import io
import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import csv, fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual, WriterCommitMessage

SCHEMA = "index long, verts array<array<float>>"
_NAME = re.compile(r"shard_(\d+)\.bin$")
#: Rows that leave a task at once.
BATCH = 1024
_PUSHDOWN = "spark.sql.python.filterPushdown.enabled"


def opened(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path or URI, and the path in it."""
    if path.startswith("file:"):
        path = "/" + path.removeprefix("file:").lstrip("/")
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


def shards_at(path: str) -> list[tuple[int, str, int]]:
    """(number, path, bytes) of the complete shards of a folder, in order."""
    system, at = opened(path)
    found = system.get_file_info(fs.FileSelector(at, allow_not_found=True))
    return sorted((int(m[1]), f.path, f.size) for f in found if (m := _NAME.search(f.base_name)))


@dataclass
class Stretch(InputPartition):
    """Rows of a shard: either `count` from `begin` on, or those at `places`."""

    shard: int
    file: str
    begin: int
    count: int
    places: tuple[int, ...] | None = None


class ShardReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path = options["path"]
        self.vertices = int(options["vertices"])
        self.size = int(options.get("shardsize", 1000))
        self.rows = int(options.get("partitionrows", 4096))
        self.low, self.high, self.ids = -(1 << 62), 1 << 62, None

    @property
    def width(self) -> int:
        return self.vertices * 12

    def partitions(self) -> list[Stretch]:
        out = []
        for number, file, size in shards_at(self.path):
            if size % self.width:
                raise ValueError(f"{file} has {size} bytes, which are no whole rows of {self.width}")
            first, n = number * self.size, size // self.width
            begin, end = max(0, self.low - first), min(n, self.high + 1 - first)
            if self.ids is not None:
                places = tuple(sorted(i - first for i in self.ids if begin <= i - first < end))
                if places:
                    out.append(Stretch(number, file, places[0], len(places), places))
                continue
            out += [Stretch(number, file, at, min(self.rows, end - at)) for at in range(begin, end, self.rows)]
        return out

    def read(self, part: Stretch | None) -> Iterator[pa.RecordBatch]:
        if not isinstance(part, Stretch):
            return  # Spark reads one partition, None, of a source without any.
        system, _ = opened(self.path)
        with system.open_input_file(part.file) as f:
            if part.places is None:
                for at in range(part.begin, part.begin + part.count, BATCH):
                    n = min(BATCH, part.begin + part.count - at)
                    yield self._batch(part.shard, np.arange(at, at + n), f.read_at(n * self.width, at * self.width))
            else:
                for at in range(0, len(part.places), BATCH):
                    places = part.places[at : at + BATCH]
                    yield self._batch(part.shard, np.array(places), b"".join(f.read_at(self.width, p * self.width) for p in places))

    def _batch(self, shard: int, places: np.ndarray, data: bytes) -> pa.RecordBatch:
        flat = pa.array(np.frombuffer(data, dtype=">f4").astype(np.float32))
        points = pa.ListArray.from_arrays(np.arange(0, len(flat) + 1, 3, dtype=np.int32), flat)
        meshes = pa.ListArray.from_arrays(np.arange(0, len(points) + 1, self.vertices, dtype=np.int32), points)
        return pa.RecordBatch.from_arrays([pa.array(shard * self.size + places.astype(np.int64)), meshes], names=["index", "verts"])


class PushingShardReader(ShardReader):
    """Takes filters on the index; others are left to Spark."""

    def pushFilters(self, filters):
        for f in filters:
            value = getattr(f, "value", None)
            if getattr(f, "attribute", None) != ("index",) or value is None:
                yield f
            elif isinstance(f, EqualTo):
                self._only([value])
            elif isinstance(f, In):
                self._only(value)
            elif isinstance(f, GreaterThan):
                self.low = max(self.low, value + 1)
            elif isinstance(f, GreaterThanOrEqual):
                self.low = max(self.low, value)
            elif isinstance(f, LessThan):
                self.high = min(self.high, value - 1)
            elif isinstance(f, LessThanOrEqual):
                self.high = min(self.high, value)
            else:
                yield f

    def _only(self, ids) -> None:
        own = {int(i) for i in ids if i is not None}
        self.ids = own if self.ids is None else self.ids & own


@dataclass
class Written(WriterCommitMessage):
    """(part name, final name) of a task's files, metadata before geometry."""

    files: list[tuple[str, str]]


class ShardWriter(DataSourceArrowWriter):
    def __init__(self, options: dict):
        self.path = options["path"]
        self.vertices = int(options["vertices"])
        self.size = int(options.get("shardsize", 1000))
        self.there = {n for n, _, _ in shards_at(f"{self.path}/verts")}
        system, at = opened(self.path)
        for folder in ("verts", "meta"):
            system.create_dir(f"{at}/{folder}", recursive=True)

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        """Rows come in the order of their index; those of a shard are all of it, without gaps."""
        files: list[tuple[str, str]] = []
        here, out, held, expected = None, None, [], 0
        try:
            for batch in iterator:
                index = batch.column("index").to_numpy(zero_copy_only=False)
                edges = np.flatnonzero(np.diff(index // self.size, prepend=-1))
                for a, b in zip(edges.tolist(), [*edges[1:].tolist(), len(index)], strict=True):
                    shard = int(index[a]) // self.size
                    if shard != here:
                        self._closed(here, out, held, files)
                        here, out, held, expected = shard, None, [], shard * self.size
                        if shard not in self.there:
                            out = self._part(files, "verts", shard, "bin")
                    if not np.array_equal(index[a:b], np.arange(expected, expected + b - a)):
                        raise ValueError(f"shard {shard} has gaps, repeats or rows out of order near {int(index[a])}")
                    expected += b - a
                    if out is not None:
                        rows = batch.slice(a, b - a)
                        flat = rows.column("verts").flatten().flatten().to_numpy(zero_copy_only=False)
                        if len(flat) != (b - a) * self.vertices * 3:
                            raise ValueError(f"shard {shard} has meshes of other than {self.vertices} vertices")
                        out.write(flat.astype(">f4").tobytes())
                        held.append(rows.drop_columns(["verts"]))
            self._closed(here, out, held, files)
            out = None
        finally:
            if out is not None:
                out.close()
        return Written(files)

    def _part(self, files: list, folder: str, shard: int, kind: str):
        system, at = opened(self.path)
        name = f"{at}/{folder}/shard_{shard:05d}.{kind}"
        part = f"{name}.{uuid.uuid4().hex}.part"
        files.append((part, name))
        return system.open_output_stream(part)

    def _closed(self, shard, out, held, files) -> None:
        if out is None:
            return
        out.close()
        data = io.BytesIO()
        csv.write_csv(pa.Table.from_batches(held), data, csv.WriteOptions(quoting_style="none"))
        head, _, body = data.getvalue().decode().partition("\n")
        lines = [",".join(x if x else "NA" for x in line.split(",")) for line in body.splitlines()]
        with self._part(files, "meta", shard, "csv") as f:
            f.write("\n".join([head.replace('"', ""), *lines, ""]).encode())
        # Metadata is renamed before the shard that it describes.
        files[-1], files[-2] = files[-2], files[-1]

    def commit(self, messages: list[Written | None]) -> None:
        system, _ = opened(self.path)
        for m in messages:
            for part, name in m.files if m else []:
                system.move(part, name)

    def abort(self, messages: list[Written | None]) -> None:
        system, _ = opened(self.path)
        for m in messages:
            for part, _ in m.files if m else []:
                if system.get_file_info(part).type != fs.FileType.NotFound:
                    system.delete_file(part)


class ShardSource(DataSource):
    """Options: path, vertices, shardSize (1000), partitionRows (4096), pushdown."""

    @classmethod
    def name(cls) -> str:
        return "corvid_shards"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return (PushingShardReader if self.options.get("pushdown") == "true" else ShardReader)(dict(self.options))

    def writer(self, schema, overwrite) -> DataSourceArrowWriter:
        if overwrite:
            raise ValueError("shards that are there stay: write in append mode")
        return ShardWriter(dict(self.options))


def read_shards(spark: SparkSession, path: str, vertices: int, shard_size: int = 1000, partition_rows: int = 4096) -> DataFrame:
    """index and verts (vertices x 3) of the complete shards of a folder; the last one may be shorter.

    Filters on index with =, in, <, <=, > and >= are read as places where the session pushes filters to Python sources.
    """
    spark.dataSource.register(ShardSource)
    push = spark.conf.get(_PUSHDOWN, "false")
    options = {"path": path, "vertices": vertices, "shardSize": shard_size, "partitionRows": partition_rows, "pushdown": push}
    return spark.read.format(ShardSource.name()).options(**options).load()


def lookup_shards(spark: SparkSession, path: str, vertices: int, ids: DataFrame, shard_size: int = 1000) -> DataFrame:
    """index and verts of the rows that ids (index) names; ids without a row in a complete shard give none.

    The ids are dealt by shard, and a task reads its ids' bytes alone, whatever their number: the list of shards is
    an entry a file, as Spark's own file index.
    """
    width = vertices * 12
    files = spark.createDataFrame([(n, f, size // width) for n, f, size in shards_at(path)], "shard long, file string, n long")
    wanted = ids.select(F.col("index").cast("long").alias("index")).distinct().withColumn("shard", F.expr(f"index div {shard_size}"))
    here = wanted.join(files, "shard").withColumn("place", F.col("index") - F.col("shard") * shard_size).where("place < n")
    ordered = here.repartition("shard").sortWithinPartitions("file", "place").select("shard", "file", "place")
    reader = ShardReader({"path": path, "vertices": vertices, "shardsize": shard_size})

    def read(batches):
        for batch in batches:
            found: dict[tuple[int, str], list[int]] = {}
            for shard, file, place in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                found.setdefault((shard, file), []).append(place)
            for (shard, file), places in found.items():
                yield from reader.read(Stretch(shard, file, places[0], len(places), tuple(places)))

    return ordered.mapInArrow(read, SCHEMA)


def write_shards(rows: DataFrame, meta: DataFrame, path: str, vertices: int, shard_size: int = 1000) -> None:
    """verts/shard_NNNNN.bin and meta/shard_NNNNN.csv in one job: index and verts from rows, the other columns from meta.

    A shard goes to one task. Shards that are there stay as they are; those of a failed job leave no trace but
    .part files, which no reader takes up.
    """
    rows.sparkSession.dataSource.register(ShardSource)
    more = [c for c in meta.columns if c != "index"]
    d = rows.select("index", "verts").join(meta.select("index", *more), "index") if more else rows.select("index", "verts")
    plain = d.select(F.col("index").cast("long").alias("index"), F.col("verts").cast("array<array<float>>").alias("verts"), *more)
    ordered = plain.repartitionByRange(F.expr(f"index div {shard_size}")).sortWithinPartitions("index")
    ordered.write.format(ShardSource.name()).mode("append").options(path=path, vertices=vertices, shardSize=shard_size).save()
