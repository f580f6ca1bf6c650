"""Shared pieces of the training-data operators: scratch tables, batches of whole texts, bitmap prefilters, salted ranks."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..sources.scratch import shared_root

#: The words of a text are maximal runs of other bytes than these.
SPACE_CLASS = r"[\x20\x09-\x0D]"

_marked: set[str] = set()
_scope: ContextVar[list[str] | None] = ContextVar("scratch", default=None)


def _delete(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def scratch_root(spark: SparkSession) -> str:
    """This application's folder below one that all executors share; the file system deletes it when the driver ends.

    The shared folder is spark.checkpoint.dir, else the context's checkpoint folder, else the warehouse unless that
    lies on the machines' own disks.
    """
    own = f"{shared_root(spark)}/corvid/{spark.sparkContext.applicationId}"
    if own not in _marked:
        path = spark._jvm.org.apache.hadoop.fs.Path(own)
        fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
        fs.mkdirs(path)
        fs.deleteOnExit(path)
        _marked.add(own)
    return own


def stored(df: DataFrame, name: str, outlives: bool = False) -> DataFrame:
    """Write df as Parquet to the shared folder and read it back: cuts lineage and survives lost executors.

    Inside a scratch_scope the table goes with the scope, unless it outlives it.
    """
    spark = df.sparkSession
    path = f"{scratch_root(spark)}/{name}-{uuid.uuid4().hex}"
    schema = df.schema
    df.write.parquet(path)
    if not outlives and (paths := _scope.get()) is not None:
        paths.append(path)
    out = spark.read.schema(schema).parquet(path)
    out._stored_at = path
    return out


def discard(df: DataFrame | None) -> None:
    """Delete a table that stored() wrote; nothing may be read from it any more."""
    if df is not None and (path := getattr(df, "_stored_at", None)):
        _delete(df.sparkSession, path)


@contextmanager
def scratch_scope(spark: SparkSession):
    """Tables stored inside are deleted at its end, when the result has been written with outlives."""
    paths: list[str] = []
    token = _scope.set(paths)
    try:
        yield
    finally:
        _scope.reset(token)
        for path in paths:
            _delete(spark, path)


#: Rows and bytes of whole texts that a Python worker takes up at once.
BATCH_ROWS, BATCH_BYTES = 1000, 1 << 24


def _small(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows of batches in slices of BATCH_ROWS rows and, but for single larger rows, BATCH_BYTES bytes."""
    for batch in batches:
        rows = max(1, min(BATCH_ROWS, batch.num_rows * BATCH_BYTES // max(batch.nbytes, 1)))
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def arrow_map(df: DataFrame, run, schema: str) -> DataFrame:
    """mapInArrow in slices that stay small with whole texts in them; the session's settings are not touched."""
    return df.mapInArrow(lambda batches: run(_small(batches)), schema)


def byte_slices(batches: Iterator[pa.RecordBatch], column: int, size: int) -> Iterator[tuple[list, list[bytes]]]:
    """(column 0, a binary column) of batches in slices whose bytes stay near size, but for single larger rows."""
    for batch in batches:
        ids, texts = batch.column(0).to_pylist(), batch.column(column).to_pylist()
        begin, held = 0, 0
        for i, text in enumerate(texts):
            if held and held + len(text) > size:
                yield ids[begin:i], texts[begin:i]
                begin, held = i, 0
            held += len(text) + 1
        if texts:
            yield ids[begin:], texts[begin:]


#: Bits of a bitmap for a key, and the most bits of one: the broadcast is 128 MB at most, whatever the input.
BITS_PER_KEY, MOST_BITS = 16, 1 << 30


def bitmap_bits(keys: int, least: int = 1 << 16) -> int:
    """Bits of a bitmap for so many keys: a power of two, bounded by MOST_BITS."""
    return min(MOST_BITS, max(least, 1 << (keys * BITS_PER_KEY).bit_length()))


def bitmap(keys: DataFrame, key: Column, bits: int) -> DataFrame:
    """A bitmap of pmod(key, bits) as rows (_bucket, _bits) of 4096 bytes each: bits / 8 bytes at most, whatever the input."""
    x = F.pmod(key, F.lit(bits)) + 1
    return keys.select(F.bitmap_bucket_number(x).alias("_bucket"), F.bitmap_bit_position(x).alias("_pos")).groupBy("_bucket").agg(F.bitmap_construct_agg("_pos").alias("_bits"))


def fresh_names(taken: list[str], *names: str) -> list[str]:
    """Names like the given ones that are not taken, whatever their case."""
    low = {t.lower() for t in taken}
    return [next(n for k in range(len(low) + 1) if (n := f"{name}{k or ''}").lower() not in low) for name in names]


def maybe_in(df: DataFrame, key: Column, bits_df: DataFrame, bits: int, flag: str) -> DataFrame:
    """Add a boolean: false means that the key is surely in none of the bitmap's keys. The broadcast is bits / 8 bytes at most.

    Helper columns take names that df does not have; a column of df named as the flag is replaced.
    """
    bucket, pos, own, words = fresh_names([*df.columns, "_bucket", "_bits"], "_b", "_p", "_k", "_w")
    x = F.pmod(key, F.lit(bits)) + 1
    marks = bits_df.select(F.col("_bucket").alias(own), F.col("_bits").alias(words))
    out = df.withColumns({bucket: F.bitmap_bucket_number(x), pos: F.bitmap_bit_position(x)}).join(F.broadcast(marks), F.col(bucket) == F.col(own), "left")
    byte = F.conv(F.hex(F.substring(words, (F.col(pos) / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    bit = byte.bitwiseAND(F.expr(f"shiftleft(1, int({pos} % 8))")) != 0
    return out.withColumn(flag, F.coalesce(bit, F.lit(False))).drop(bucket, pos, own, words)


#: A key with more than this share of a table's rows, and at least HOT_ROWS of them, is joined by broadcast.
HOT_PART, HOT_ROWS = 1 / 1000, 1000


def join_hot(rows: DataFrame, facts: DataFrame, key: str) -> DataFrame:
    """rows joined with facts on key, without a task that reads all rows of a frequent key.

    facts is a stored table with a row a key and the number _n of the key's rows; fewer than 1 / HOT_PART keys
    can have more than their share, so what is broadcast is bounded whatever the input.
    """
    total, most = facts.agg(F.coalesce(F.sum("_n"), F.lit(0)), F.coalesce(F.max("_n"), F.lit(0))).first()
    line = max(HOT_ROWS, int(total * HOT_PART))
    if most <= line:
        return rows.join(facts, key)
    hot, cold = facts.where(F.col("_n") > line), facts.where(F.col("_n") <= line)
    others = rows.join(F.broadcast(hot.select(key)), key, "left_anti")
    return rows.join(F.broadcast(hot), key).unionByName(others.join(cold, key))


def salted_rank(df: DataFrame, keys: list[str], order: list[Column], salts: int, salt: Column, out: str = "_rank") -> DataFrame:
    """A number from 0 for each row within its keys, dealt over `salts` tasks for each key.

    The rows of a key are ordered by salt, then by `order`; the salts' offsets come from a small aggregate.
    """
    d = df.withColumn("_salt", F.pmod(salt, F.lit(salts)).cast("int"))
    counts = d.groupBy(*keys, "_salt").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*keys).orderBy("_salt").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(*keys, "_salt", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    own = Window.partitionBy(*keys, "_salt").orderBy(*order)
    return d.join(offsets, [*keys, "_salt"]).withColumn(out, F.col("_before") + F.row_number().over(own) - 1).drop("_before", "_salt")
