"""Exact dedup: groups by a 128-bit content hash, byte comparison inside groups, one stable row per group."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import HOT_PART, HOT_ROWS, bitmap, bitmap_bits, maybe_in, stored


def content_hash(text: Column) -> Column:
    """128 bits of the text's UTF-8 bytes."""
    return F.unhex(F.md5(text))


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "min", hash_with: Callable[[Column], Column] = content_hash) -> DataFrame:
    """Label every row with the row that stays of its group of equal texts.

    Returns doc_id, keep_id, group_size, kept, text_sha256. A null text counts as empty. keep: "min" or "max"
    of the ids; null ids never win against others, and a group of null ids only has keep_id null. Rows that
    repeat an id with the same text are the same row: all of them carry kept = true if that id stays. Other
    columns are not read, so names cannot clash. An empty table gives an empty result.

    All texts are hashed once, into a table of ids and digests. Texts are read again only to compare bytes, and
    move only where their hash is seen twice: a bitmap sized from the number of repeated hashes, and bounded,
    lets the others stay. Grouping by (hash, text) compares bytes and combines copies before the shuffle, so a
    hot group sends a row for each input partition. Labels go back by hash alone, or by hash and digest where
    one hash has several texts.
    """
    pick = {"min": F.min, "max": F.max}[keep]
    d = docs.select(F.col(id_col).alias("_id"), F.coalesce(F.col(text_col), F.lit("")).alias("_text"))
    hashed = stored(d.select("_id", hash_with(F.col("_text")).alias("_h"), F.unhex(F.sha2("_text", 256)).alias("_sha")), "dedup-digests")
    seen = hashed.groupBy("_h").agg(F.count(F.lit(1)).alias("_n"), pick("_id").alias("_keep")).where("_n > 1")
    seen = stored(seen, "dedup-seen")
    bits = bitmap_bits(seen.count())
    candidates = maybe_in(d.withColumn("_h", hash_with(F.col("_text"))), F.xxhash64("_h"), bitmap(seen, F.xxhash64("_h"), bits), bits, "_maybe").where("_maybe")
    classes = candidates.groupBy("_h", "_text").agg(pick("_id").alias("_keep"), F.count(F.lit(1)).alias("_size"))
    classes = stored(classes.select("_h", F.unhex(F.sha2("_text", 256)).alias("_sha"), "_keep", F.col("_size").cast("long").alias("_n")), "dedup-classes")
    texts = classes.groupBy("_h").agg(F.count(F.lit(1)).alias("_texts"))

    # One text for a hash, as is the rule: hash tells its rows. Hashes seen once have no label.
    single = stored(seen.join(texts.where("_texts = 1").select("_h"), "_h", "left_semi"), "dedup-groups")
    clashing = stored(classes.join(texts.where("_texts > 1").select("_h"), "_h", "left_semi").join(seen.select("_h"), "_h", "left_semi"), "dedup-clashes")
    rows = hashed if clashing.isEmpty() else hashed.join(clashing.select("_h").distinct(), "_h", "left_anti")
    out = label_hot(rows, single, "_h")
    if rows is not hashed:
        exact = hashed.join(clashing, ["_h", "_sha"]).select("_id", "_sha", "_keep", "_n")
        out = out.unionByName(exact)
    keep_id = F.when(F.col("_n").isNull(), F.col("_id")).otherwise(F.col("_keep"))
    return out.select(
        F.col("_id").alias("doc_id"),
        keep_id.alias("keep_id"),
        F.coalesce("_n", F.lit(1)).cast("long").alias("group_size"),
        F.col("_id").eqNullSafe(keep_id).alias("kept"),
        F.lower(F.hex("_sha")).alias("text_sha256"),
    )


def label_hot(rows: DataFrame, groups: DataFrame, key: str) -> DataFrame:
    """rows left-joined with groups (_keep, _n) on key; frequent keys are broadcast, so that no task reads all rows of one."""
    total, most = groups.agg(F.coalesce(F.sum("_n"), F.lit(0)), F.coalesce(F.max("_n"), F.lit(0))).first()
    line = max(HOT_ROWS, int(total * HOT_PART))
    facts = ["_id", "_sha", "_keep", "_n"]
    if most <= line:
        return rows.join(groups, key, "left").select(*facts)
    # Fewer than 1 / HOT_PART groups can be that large.
    hot, cold = groups.where(F.col("_n") > line), groups.where(F.col("_n") <= line)
    others = rows.join(F.broadcast(hot.select(key)), key, "left_anti")
    return rows.join(F.broadcast(hot), key).select(*facts).unionByName(others.join(cold, key, "left").select(*facts))
