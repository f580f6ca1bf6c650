"""Line dedup: hashes of lines in range partitions, sorted by document and position, streamed once into keep bitmaps."""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, bitmap, bitmap_bits, discard, fresh_names, maybe_in, stored

_STRIP = " \t\n\x0b\x0c\r"
_ROW = pa.schema([("key", pa.binary()), ("doc_id", pa.int64()), ("fp", pa.int64()), ("pos", pa.int32())])
_ROW_SQL = "key binary, doc_id long, fp long, pos int"
_SEEN = pa.schema([*_ROW, ("kind", pa.int8())])
DROP, OPEN, STAT = 0, 1, 2


def _lines_of(min_chars: int, most: int = 1 << 16):
    def batch_of(out):
        return pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(out, _ROW, strict=True)], schema=_ROW)

    def run(batches):
        out = [[], [], [], []]
        for batch in batches:
            ids, fps = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for doc, fp, text in zip(ids, fps, batch.column(2), strict=True):
                for pos, line in enumerate(text.as_py().split("\n")):
                    if len(line) >= min_chars and len(key := line.strip(_STRIP)) >= min_chars:
                        digest = hashlib.blake2b(key.encode("utf-8", "surrogatepass").lower(), digest_size=16).digest()
                        for col, x in zip(out, (digest, doc, fp, pos), strict=True):
                            col.append(x)
                if len(out[0]) >= most:
                    yield batch_of(out)
                    out = [[], [], [], []]
        if out[0]:
            yield batch_of(out)

    return run


def _stream(min_docs: int, most: int = 1 << 16):
    """One pass over rows in the order (key, doc_id descending, pos).

    A group that begins and ends inside the partition is decided here: from min_docs documents on, rows of all
    but the first document are emitted as drops. The first group of a partition may continue an earlier
    partition's, and the last may go on in the next: for these, up to min_docs documents are emitted as STAT
    rows; undecided rows go out as OPEN rows. At most the rows of min_docs documents are held.
    """

    def run(batches):
        out = [[], [], [], [], []]

        def emit(row, kind):
            for col, x in zip(out, (*row, kind), strict=True):
                col.append(x)

        def flush():
            nonlocal out
            batch = pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(out, _SEEN, strict=True)], schema=_SEEN)
            out = [[], [], [], [], []]
            return batch

        key, first, docs, held = None, True, [], []

        def close(last):
            """A group ends; nothing is left to do for one that was decided."""
            if first or last:
                for d in docs:
                    emit((key, d, 0, 0), STAT)
            if last and not first and len(docs) < min_docs:
                for row in held:
                    emit(row, OPEN)

        for batch in batches:
            for row in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                if row[0] != key:
                    if key is not None:
                        close(False)
                        first = False
                    key, docs, held = row[0], [], []
                if not docs or (len(docs) < min_docs and row[1] != docs[-1]):
                    docs.append(row[1])
                    if len(docs) == min_docs and not first:
                        for r in held:
                            if r[1] != docs[0]:
                                emit(r, DROP)
                        held = []
                if first:
                    emit(row, OPEN)
                elif len(docs) < min_docs:
                    held.append(row)
                elif row[1] != docs[0]:
                    emit(row, DROP)
                if len(out[0]) >= most:
                    yield flush()
        if key is not None:
            close(True)
        if out[0]:
            yield flush()

    return run


def _bitmaps(batches):
    """Sorted dropped positions into zlib-compressed bits, 1 for lines that stay; lines past the end stay."""
    for batch in batches:
        maps = []
        for gone in batch.column(2).to_pylist():
            keep = np.ones(-(-(max(gone) + 1) // 8) * 8, dtype=bool)
            keep[gone] = False
            maps.append(zlib.compress(np.packbits(keep).tobytes(), 1))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(maps, pa.binary())], names=["doc_id", "fp", "keep_bitmap"])


def kept_lines(text: str, keep_bitmap: bytes | None) -> tuple[list[str], int]:
    """The lines of a text that stay, and the number of all its lines."""
    lines = text.split("\n")
    if keep_bitmap is None:
        return lines, len(lines)
    keep = np.unpackbits(np.frombuffer(zlib.decompress(keep_bitmap), dtype=np.uint8)).astype(bool)
    return [x for i, x in enumerate(lines) if i >= len(keep) or keep[i]], len(lines)


def line_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 40, min_docs: int = 5) -> DataFrame:
    """Keep bitmaps of the documents that lose lines: doc_id, fp, keep_bitmap.

    A line's key is the line without white space at its ends, A-Z in lower case. Keys of at least min_chars
    code points in at least min_docs documents stay only in the largest doc_id holding them, there in all
    their lines. Null or empty texts are one empty line and lose nothing. Rows with the same doc_id count as
    one document; a null doc_id is one document below all others. fp is xxhash64 of the text: it tells rows
    apart that repeat a doc_id with another text. Other columns are not read.

    An empty table gives an empty result. Lines are split once: their keys are stored before range partitions are cut
    from a sample of them, by (key, doc_id, pos), so a key that very many documents share is dealt over several tasks.
    Only what concerns each partition's two outer keys is put together afterwards.
    """
    d = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("_text")).select("doc_id", F.xxhash64("_text").alias("fp"), "_text")
    order = [F.col("key"), F.col("doc_id").desc_nulls_last(), F.col("pos")]
    rows = stored(arrow_map(d, _lines_of(min_chars), _ROW_SQL), "line-keys")
    seen = stored(rows.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(_stream(min_docs), f"{_ROW_SQL}, kind byte"), "lines")
    discard(rows)
    stats = seen.where(f"kind = {STAT}").select("key", "doc_id").distinct().groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.max("doc_id").alias("keep")).where(F.col("n") >= min_docs)
    # Only the first and last key of each range partition have such rows: two keys a partition bound the broadcast.
    opened = seen.where(f"kind = {OPEN}").join(F.broadcast(stats), "key").where(~F.col("doc_id").eqNullSafe(F.col("keep")))
    drops = seen.where(f"kind = {DROP}").select("doc_id", "fp", "pos").unionByName(opened.select("doc_id", "fp", "pos"))
    by_doc = drops.groupBy("doc_id", "fp").agg(F.array_sort(F.collect_set("pos")).alias("gone"))
    return by_doc.mapInArrow(_bitmaps, "doc_id long, fp long, keep_bitmap binary")


def with_bitmaps(docs: DataFrame, bitmaps: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with a column keep_bitmap, null where all lines stay (so for null and empty texts). Only rows that may lose lines are shuffled.

    All columns of docs stay, whatever their names, but for one named keep_bitmap, which is replaced. Rows that
    repeat an id and text get the same bitmap; an empty table gives an empty result.
    """
    docs = docs.drop("keep_bitmap")
    flag, doc, fp, own, gone = fresh_names([*docs.columns, "keep_bitmap"], "_maybe", "_doc", "_fp", "_own", "_gone")
    bitmaps = stored(bitmaps.select(F.col("doc_id").alias(doc), F.col("fp").alias(fp), F.col("keep_bitmap").alias(gone)), "line-bitmaps")
    bits = bitmap_bits(bitmaps.count())
    print_of = F.xxhash64(F.coalesce(F.col(text_col), F.lit("")))
    marked = maybe_in(docs, F.xxhash64(F.col(id_col).cast("long"), print_of), bitmap(bitmaps, F.xxhash64(doc, fp), bits), bits, flag)
    untouched = marked.where(~F.col(flag)).drop(flag).withColumn("keep_bitmap", F.lit(None).cast("binary"))
    maybe = marked.where(F.col(flag)).drop(flag).withColumn(own, print_of)
    joined = maybe.join(bitmaps, F.col(id_col).cast("long").eqNullSafe(F.col(doc)) & (F.col(own) == F.col(fp)), "left").withColumn("keep_bitmap", F.col(gone))
    return untouched.unionByName(joined.drop(doc, fp, own, gone))


def line_digests(batches):
    """(doc_id, text, keep_bitmap) to n_lines, n_dropped and the digest of the lines that stay."""
    schema = pa.schema([("doc_id", pa.int64()), ("n_lines", pa.int64()), ("n_dropped", pa.int64()), ("kept_sha256", pa.string())])
    for batch in batches:
        cols = [[], [], []]
        for text, keep in zip(batch.column(1), batch.column(2).to_pylist(), strict=True):
            lines, n = kept_lines(text.as_py() or "", keep)
            for col, x in zip(cols, (n, n - len(lines), hashlib.sha256("\n".join(lines).encode("utf-8", "surrogatepass")).hexdigest()), strict=True):
                col.append(x)
        yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, f.type) for c, f in zip(cols, list(schema)[1:], strict=True))], schema=schema)


def kept_texts(batches):
    """(doc_id, text, keep_bitmap, other columns) with the text of the lines that stay; the bitmap goes."""
    for batch in batches:
        texts = [t.as_py() if k is None else "\n".join(kept_lines(t.as_py() or "", k)[0]) for t, k in zip(batch.column(1), batch.column(2).to_pylist(), strict=True)]
        names = [n for n in batch.schema.names if n != "keep_bitmap"]
        yield pa.RecordBatch.from_arrays([pa.array(texts, pa.string()) if n == batch.schema.names[1] else batch.column(n) for n in names], names=names)
