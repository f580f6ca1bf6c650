"""Readers of the data format: metadata CSV, pool text, geometry shards, topology, split lists, records.

Schemas are always given, never inferred; every reader takes paths that Spark can open.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType
from pyspark.sql.window import Window

from ..functions.vocabulary import MUSCLES
from .shard_source import lookup_shards, read_shards  # noqa: F401

POOL_SCHEMA = "index long, section string, phoneme string, detail string, base_index long, delta string, n_active int, refs string, " + ", ".join(f"{m} double" for m in MUSCLES)
META_SCHEMA = "index long, label string, reason string, max_vel double, peak_ramp_vel double, vol_ratio double, n_inverted int, min_elem_vol double, settle_t double, secs double"
_SPAN = "array<struct<type: string, value: string, start: int, end: int, role: string>>"
RECORD_SCHEMA = (
    "index long, mesh_ref struct<verts_shard: int, row_in_shard: int, indices: array<long>>, scenario string, lang string, "
    f"conversations array<struct<from: string, value: string, mask_spans: {_SPAN}>>, turn_types array<string>, verified boolean, "
    "sweep struct<levels: array<double>, resp_mm: array<double>, rho: double, monotonic: boolean, tier: string>, "
    "variant int, naturalized boolean, nat_all_faithful boolean, src_ref struct<file: string, line: int>"
)


def read_pool_meta(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(POOL_SCHEMA).csv(path, header=True)


def read_sim_meta(spark: SparkSession, path: str) -> DataFrame:
    """All shards' metadata; NA is null."""
    return spark.read.schema(META_SCHEMA).csv(path, header=True, nullValue="NA")


def read_pool_text(spark: SparkSession, path: str, names: Sequence[str] = MUSCLES) -> DataFrame:
    """index and activations of a pool text: blank lines and # comments are skipped, a comment that names
    keyframes or sequences ends the table, and a first line that is not numeric gives the columns' names."""
    raw = spark.read.text(path, wholetext=True)
    cut = F.split(F.col("value"), r"(?im)^#[^\n]*(?:keyframe|sequences)")[0]
    lines = F.filter(F.transform(F.split(cut, r"\r?\n"), lambda x: F.trim(x)), lambda x: (x != "") & ~x.startswith("#"))
    fields = F.transform(lines, lambda x: F.split(x, r"[,\s]+"))
    d = raw.select(fields.alias("rows"))
    header = F.get(F.get("rows", 0), 0).try_cast("double").isNull()
    d = d.select(F.when(header, F.get("rows", 0)).otherwise(F.array(F.lit("index"), *map(F.lit, names))).alias("names"), F.when(header, F.expr("slice(rows, 2, size(rows))")).otherwise(F.col("rows")).alias("rows"))
    out = d.select("names", F.explode("rows").alias("row"))
    at = lambda n: F.try_element_at("row", F.array_position("names", n).cast("int"))
    value = lambda n: F.when(F.array_contains("names", n), at(n).try_cast("double"))
    return out.select(value("index").cast("long").alias("index"), *[value(n).alias(n) for n in names])


def shard_rows(spark: SparkSession, path: str, vertices: int) -> DataFrame:
    """Rows of each complete shard from its size alone; .part files are not complete."""
    files = spark.read.format("binaryFile").load(path).where(F.col("path").rlike(r"shard_\d+\.bin$"))
    return files.select(F.regexp_extract("path", r"shard_(\d+)\.bin$", 1).cast("long").alias("shard"), F.expr(f"length div {vertices * 12}").alias("n_rows"))


def read_obj(spark: SparkSession, path: str, with_file: bool = False) -> tuple[DataFrame, DataFrame]:
    """(vertices, faces) of OBJ files, numbered from 0 in each file; polygons become fans, and only the first index of a/b/c counts.

    with_file adds the file's name, by which meshes of a folder are told apart.
    """
    raw = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), "value")
    lines = raw.select("file", F.posexplode(F.split("value", r"\r?\n")).alias("pos", "line"))
    kind = lambda k: lines.where(F.col("line").rlike(rf"^{k}\s")).select("file", "pos", F.split(F.trim("line"), r"\s+").alias("f"))
    number = lambda d: d.withColumn("id", F.row_number().over(Window.partitionBy("file").orderBy("pos")) - 1)
    own = [F.regexp_extract("file", r"([^/]+)$", 1).alias("file")] if with_file else []
    vertices = number(kind("v")).select(*own, "id", *[F.col("f")[i + 1].cast("double").alias(a) for i, a in enumerate("xyz")])
    corners = F.expr("transform(slice(f, 2, size(f)), x -> cast(split(x, '/')[0] as int) - 1)")
    fans = number(kind("f")).select("file", "id", corners.alias("c")).select("file", "id", F.posexplode(F.expr("transform(sequence(1, size(c) - 2), k -> array(c[0], c[k], c[k + 1]))")).alias("part", "t"))
    faces = fans.select(*own, F.col("id").alias("polygon"), "part", *[F.col("t")[i].alias(a) for i, a in enumerate("ijk")])
    return vertices, faces


def read_key_values(spark: SparkSession, path: str) -> DataFrame:
    """key, value of key=value lines; a value is its first token."""
    lines = spark.read.text(path).where(F.col("value").contains("="))
    return lines.select(F.trim(F.substring_index("value", "=", 1)).alias("key"), F.regexp_extract("value", r"=\s*(\S+)", 1).alias("val"))


def read_split(spark: SparkSession, path: str, name: str) -> DataFrame:
    """The ids of a split list: the first token of each line that is neither blank nor a comment."""
    lines = spark.read.text(path).select(F.trim("value").alias("line")).where("line <> '' and not startswith(line, '#')")
    return lines.select(F.split("line", r"\s+")[0].cast("long").alias("index"), F.lit(name).alias("split"))


def read_records(spark: SparkSession, path: str | list[str], schema: str = RECORD_SCHEMA) -> DataFrame:
    """Records of JSON lines; lines that are not JSON are dropped, and file names are kept as provenance."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path).withColumn("file", F.col("_metadata.file_name"))


def read_records_any(spark: SparkSession, path: str, schema: str = RECORD_SCHEMA) -> DataFrame:
    """Records of JSON lines or of one JSON array, told apart by the first character.

    An array whose lines hold whole elements, as write_json_array writes it, is read line by line in many tasks.
    One whose elements run over lines is read by Spark as one document, in one task that holds all its rows.
    """
    head = spark.read.text(path).select(F.trim("value").alias("v")).where("v <> ''").limit(1).collect()
    if not head or not head[0]["v"].startswith("["):
        return spark.read.schema(schema).json(path)
    # The brackets and commas around a line's elements are replaced by a pair of brackets.
    inner = F.regexp_replace(F.regexp_replace(F.trim("value"), r"^\s*\[?\s*,?\s*", ""), r"\s*,?\s*\]?\s*$", "")
    lines = spark.read.text(path).select(inner.alias("inner")).where("inner <> ''")
    cells = F.from_json(F.concat(F.lit("["), "inner", F.lit("]")), "array<string>")
    whole = F.col("inner").startswith("{") & F.col("inner").endswith("}") & F.forall(cells, lambda x: x.startswith("{"))
    if not lines.where(~F.coalesce(whole, F.lit(False))).isEmpty():
        return spark.read.schema(schema).option("multiLine", True).json(path)
    wanted = spark.createDataFrame([], schema).schema
    rows = lines.select(F.explode(F.from_json(F.concat(F.lit("["), "inner", F.lit("]")), ArrayType(wanted))).alias("r"))
    return rows.select("r.*")


def read_centers(spark: SparkSession, path: str) -> DataFrame:
    """The anchor table; a byte order mark is no part of the first name."""
    d = spark.read.csv(path, header=True, encoding="UTF-8")
    return d.toDF(*[c.lstrip("﻿") for c in d.columns])


def read_region_mm(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Displacements in metres as millimetres with 2 decimals, halves to even."""
    return df.select("index", *[F.bround(F.col(c).cast("double") * 1000, 2).alias(c) for c in cols])


def properties(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """index and the wanted, known features of rows that are ok."""
    wanted = F.array(*map(F.lit, keys))
    return df.where("feat_ok").select("index", F.map_filter("features", lambda k, v: F.array_contains(wanted, k) & v.isNotNull()).alias("features"))


def mesh_ids(ref: Column, index: Column | None = None, size: int = 1000) -> Column:
    """The ids that a reference names: its list, its shard and row, else the record's own index if given, else none."""
    own = F.when(ref["verts_shard"].isNotNull() & ref["row_in_shard"].isNotNull(), F.array((ref["verts_shard"].cast("long") * size + ref["row_in_shard"]).cast("long")))
    rest = F.when(index.isNotNull(), F.array(index.cast("long"))) if index is not None else F.lit(None).cast("array<long>")
    return F.coalesce(ref["indices"], own, rest, F.expr("cast(array() as array<bigint>)"))


def last_answers(df: DataFrame, key: str, text: str, order: str) -> DataFrame:
    """One answer a key; the last by order wins."""
    return df.groupBy(key).agg(F.max_by(text, order).alias(text))
