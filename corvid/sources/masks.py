"""Label masks of one file a frame: arrays and images as rows, frames in natural order."""

from __future__ import annotations

import io

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .images import read_mat, read_png

#: The array that is taken from files that hold several, where they have it.
MASK_NAME = "mask_frame"


def natural_key(path: Column) -> Column:
    """The last number of a file's name, by which frames are ordered; 0 for names without one."""
    return F.coalesce(F.regexp_extract(F.regexp_extract(path, r"([^/]+)$", 1), r"(\d+)(?!.*\d)", 1).try_cast("long"), F.lit(0))


def load_mask(content: bytes, suffix: str, name: str = MASK_NAME) -> np.ndarray:
    """(rows, columns, channels) of a .npy, .npz, .mat or .png file; of several arrays the named one, else the first."""
    if suffix == "png":
        a = read_png(content)
    elif suffix == "mat":
        arrays = read_mat(content)
        a = arrays[name] if name in arrays else next(iter(arrays.values()), None)
    elif suffix in ("npy", "npz"):
        a = np.load(io.BytesIO(content), allow_pickle=False)
        if suffix == "npz":
            names = [n for n in a.files if not n.startswith("_")]
            a = a[name] if name in a.files else a[names[0]] if names else None
    else:
        raise ValueError(f"no mask format {suffix}")
    if a is None:
        raise ValueError("no array in the file")
    if a.ndim not in (2, 3):
        raise ValueError(f"a mask has 2 or 3 dimensions, not {a.ndim}")
    return a if a.ndim == 3 else a[..., None]


def read_masks(spark: SparkSession, path: str, name: str = MASK_NAME) -> DataFrame:
    """file, frame, shape (rows, columns, channels) and values, flat in this order, of mask files.

    Frames of a folder are numbered by the last number of the file's name, then by name. Files of other formats are not read.
    """
    files = spark.read.format("binaryFile").load(path).where(F.lower("path").rlike(r"\.(np[yz]|mat|png)$")).select("path", "content")

    def unpack(frames):
        for frame in frames:
            masks = [load_mask(bytes(c), p.rpartition(".")[2].lower(), name) for p, c in zip(frame["path"], frame["content"], strict=True)]
            yield pd.DataFrame({"path": frame["path"], "shape": [list(m.shape) for m in masks], "values": [m.astype(np.float64).ravel().tolist() for m in masks]})

    rows = files.mapInPandas(unpack, "path string, shape array<int>, values array<double>")
    # Numbering reads names only, which are a row for each file.
    names = files.select("path").withColumn("frame", F.row_number().over(Window.orderBy(natural_key(F.col("path")), "path")) - 1)
    return rows.join(names, "path").select(F.regexp_extract("path", r"([^/]+)$", 1).alias("file"), "frame", "shape", "values")


def labels(masks: DataFrame) -> DataFrame:
    """file, frame, shape (rows, columns) and labels: the first channel of each mask."""
    first = F.expr("transform(filter(values, (v, i) -> i % shape[2] = 0), v -> cast(v as long))")
    return masks.select("file", "frame", F.slice("shape", 1, 2).alias("shape"), first.alias("labels"))


def label_areas(masks: DataFrame) -> DataFrame:
    """Pixels of each label in each frame."""
    return labels(masks).select("file", "frame", F.explode("labels").alias("label")).groupBy("file", "frame", "label").agg(F.count(F.lit(1)).alias("n"))
