"""A folder for files that a query writes and reads back, on storage that all executors share."""

from __future__ import annotations

import uuid

from pyspark.sql import SparkSession

_kept: set[str] = set()


def shared_root(spark: SparkSession) -> str:
    """A folder that all executors share: spark.checkpoint.dir, the context's checkpoint folder, or the warehouse.

    A warehouse on local disk serves only where everything runs in one process; on a cluster each machine would write its own.
    """
    known = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if known:
        return known.rstrip("/")
    root = spark.conf.get("spark.sql.warehouse.dir", None)
    local = spark.sparkContext.master.split("[")[0] == "local"
    if not root or not local and root.split(":", 1)[0] in {"", "file", root}:
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return root.rstrip("/")


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder below the shared root; it goes when the driver ends."""
    own = f"{shared_root(spark)}/corvid-files/{spark.sparkContext.applicationId}"
    if own not in _kept:
        at = spark._jvm.org.apache.hadoop.fs.Path(own)
        fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
        fs.mkdirs(at)
        fs.deleteOnExit(at)
        _kept.add(own)
    return f"{own}/{name}-{uuid.uuid4().hex}"


def write_bytes(spark: SparkSession, path: str, content: bytes) -> str:
    """A small file, written by the driver."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = at.getFileSystem(spark._jsc.hadoopConfiguration()).create(at, True)
    try:
        out.write(bytearray(content))
    finally:
        out.close()
    return path


def write_text(spark: SparkSession, path: str, text: str) -> str:
    """A small text file."""
    return write_bytes(spark, path, text.encode("utf-8"))
