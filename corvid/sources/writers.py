"""Writers of the data format. Spark's commit protocol stands for write-aside-and-rename."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import fixed
from .images import npy_bytes, png_bytes
from .scratch import write_bytes
from .shard_source import write_shards  # noqa: F401


def write_pool(df: DataFrame, path: str, activations: Sequence[str]) -> None:
    """Pool rows as CSV with 4 decimals for activations."""
    df.withColumns({a: fixed(F.col(a), 4) for a in activations}).write.csv(path, header=True)


def _one_text(lines: DataFrame, path: str) -> None:
    """Lines (_k, _n, value) as one text file in their order; a text of one file is what the format asks for."""
    lines.coalesce(1).sortWithinPartitions("_k", "_n").select("value").write.mode("overwrite").text(path)


def write_pool_text(df: DataFrame, path: str, activations: Sequence[str], notes: Sequence[str] = (), tail: Sequence[str] = ()) -> None:
    """A pool as text: notes as comments, the names, index and activations with 4 decimals; tail are lines after the pool."""
    head = [*(f"# {n}" for n in notes), ",".join(["index", *activations])]
    own = df.select(F.lit(1).alias("_k"), F.col("index").cast("long").alias("_n"), F.concat_ws(",", F.col("index").cast("string"), *[fixed(F.col(a), 4) for a in activations]).alias("value"))
    outer = df.sparkSession.createDataFrame([(0, i, x) for i, x in enumerate(head)] + [(2, i, x) for i, x in enumerate(tail)], "_k int, _n long, value string")
    _one_text(own.unionByName(outer), path)


def write_json_array(df: DataFrame, path: str, order: str) -> None:
    """All rows as one JSON array in one file, in the order of a distinct whole number; commas stand before all but the first."""
    first = df.agg(F.min(order).alias("_first"))
    cell = F.to_json(F.struct(*df.columns))
    own = df.crossJoin(F.broadcast(first)).select(F.lit(1).alias("_k"), F.col(order).cast("long").alias("_n"), F.concat(F.when(F.col(order) > F.col("_first"), ",").otherwise(""), cell).alias("value"))
    outer = df.sparkSession.createDataFrame([(0, 0, "["), (2, 0, "]")], "_k int, _n long, value string")
    _one_text(own.unionByName(outer), path)


def write_table_text(df: DataFrame, path: str, head: Sequence[str], order: str, line) -> None:
    """Lines made of rows after given ones, in one file; a byte order mark is a character of the first line."""
    own = df.select(F.lit(1).alias("_k"), F.col(order).cast("long").alias("_n"), line.alias("value"))
    outer = df.sparkSession.createDataFrame([(0, i, x) for i, x in enumerate(head)], "_k int, _n long, value string")
    _one_text(own.unionByName(outer), path)


def write_records(df: DataFrame, path: str, shard: str = "verts_shard", resume: bool = True) -> None:
    """Records as JSON lines, a folder for each shard; with resume, shards that are there stay as they are."""
    if resume:
        df = unfinished(df, path, shard)
    df.write.mode("append").partitionBy(shard).json(path)


def unfinished(df: DataFrame, path: str, shard: str) -> DataFrame:
    """Rows of shards that have no folder below the path yet."""
    spark = df.sparkSession
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    names = [s.getPath().getName() for s in fs.listStatus(at)] if fs.exists(at) else []
    done = [n.partition("=")[2] for n in names if n.startswith(f"{shard}=")]
    if not done:
        return df
    return df.join(spark.createDataFrame([(x,) for x in done], "_done string"), F.col(shard).cast("string") == F.col("_done"), "left_anti")


def write_splits(df: DataFrame, path: str, key: str = "index", split: str = "split") -> None:
    """Sorted ids as text, a folder for each split."""
    ordered = df.select(F.col(key).cast("string").alias("value"), split, key).repartition(split).sortWithinPartitions(split, key)
    ordered.select("value", split).write.mode("overwrite").partitionBy(split).text(path)


def write_json_lines(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("ignoreNullFields", True).json(path)


def write_judge_payloads(df: DataFrame, path: str, shown: Sequence[str], hidden: Sequence[str], key: str = "uid") -> None:
    """What a judge may see and what it may not, apart from each other, with the key in both."""
    df.select(key, *shown).write.mode("overwrite").json(f"{path}/predictions")
    df.select(key, *hidden).write.mode("overwrite").json(f"{path}/references")


def write_png(spark, path: str, image: np.ndarray) -> str:
    """One image of bytes, (rows, columns) or with 1 to 4 channels."""
    return write_bytes(spark, path, png_bytes(image))


def write_npy(spark, path: str, array: np.ndarray) -> str:
    return write_bytes(spark, path, npy_bytes(array))


def write_obj(vertices: DataFrame, faces: DataFrame, path: str) -> None:
    """A mesh as OBJ text in one file, vertices before faces, numbered from 1; colours r, g, b of 0 to 255 follow the places as shares."""
    own = [F.col(a).cast("string") for a in "xyz"]
    if {"r", "g", "b"} <= set(vertices.columns):
        own += [fixed(F.col(a) / 255, 6) for a in "rgb"]
    v = vertices.select(F.lit(0).alias("k"), F.col("id").cast("long").alias("n"), F.lit(0).alias("p"), F.concat_ws(" ", F.lit("v"), *own).alias("value"))
    f = faces.select(F.lit(1).alias("k"), F.col("polygon").cast("long").alias("n"), F.col("part").alias("p"), F.concat_ws(" ", F.lit("f"), *[(F.col(a) + 1).cast("string") for a in "ijk"]).alias("value"))
    v.unionByName(f).coalesce(1).sortWithinPartitions("k", "n", "p").select("value").write.mode("overwrite").text(path)


def cached_index(path: str, build, spark) -> DataFrame:
    """The table at a path; built and written there first where there is none."""
    at = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    if not at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at):
        build().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)
