"""Random access to JSON lines: an index of byte offsets, made by readers that split files anywhere, and lookups by it.

A range of bytes owns the lines that begin in it. Its reader starts one byte early and drops what is left of an
earlier range's line, and reads on past its end until its last line ends, so no line is lost or read twice.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators.index import membership_policies
from ..operators.ranking import _same, quota_prefix
from .readers import RECORD_SCHEMA, mesh_ids
from .shard_source import opened

#: Bytes of a range, and of a read.
RANGE, READ = 32 << 20, 1 << 20
#: Lines of a batch.
BATCH = 1000


def _base(pattern: str) -> str:
    """The folder of a pattern's first part with a `*`, or of its last part."""
    parts = pattern.split("/")
    first = next((i for i, p in enumerate(parts) if "*" in p), len(parts) - 1)
    return "/".join(parts[:first])


def files_at(pattern: str) -> list[tuple[str, int]]:
    """(path, bytes) of the files that a pattern matches, sorted by path; `*` stands for any characters within a part."""
    base = _base(pattern)
    system, at = opened(base)
    rest = pattern[len(base) :].lstrip("/")
    match = re.compile("[^/]*".join(map(re.escape, rest.split("*"))) + r"\Z")
    found = system.get_file_info(fs.FileSelector(at, allow_not_found=True, recursive="/" in rest))
    prefix = at.rstrip("/") + "/"
    return sorted((f.path, f.size) for f in found if f.type == fs.FileType.File and match.match(f.path.removeprefix(prefix)))


def lines_of(system: fs.FileSystem, path: str, begin: int, end: int):
    """(offset, line) of the lines that begin in [begin, end), without their ends; the last line needs none."""
    with system.open_input_file(path) as f:
        size = f.size()
        at = max(0, begin - 1)
        f.seek(at)
        held, place = b"", at
        skipping = begin > 0
        while True:
            data = f.read(READ)
            held += data
            start = 0
            while (stop := held.find(b"\n", start)) >= 0 or (not data and start < len(held)):
                if stop < 0:
                    stop = len(held)
                here = place + start
                if skipping:
                    skipping = False
                elif here >= end:
                    return
                else:
                    yield here, held[start:stop]
                start = stop + 1
            place, held = place + start, held[start:]
            if not data or (place >= end and not skipping) or place >= size:
                return


def scan_lines(spark: SparkSession, pattern: str, span: int = RANGE) -> tuple[DataFrame, list[str]]:
    """(file, offset, line) of every line of the files, and the files; a task reads a range of a file."""
    files = files_at(pattern)
    if not files:
        raise FileNotFoundError(pattern)
    ranges = [(i, path, at, min(size, at + span)) for i, (path, size) in enumerate(files) for at in range(0, size, span)]
    schema = "file int, path string, begin long, end long"
    base = _base(pattern)

    def read(batches):
        system, _ = opened(base)
        for batch in batches:
            for i, path, begin, end in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                out: list[tuple[int, bytes]] = []
                for row in lines_of(system, path, begin, end):
                    out.append(row)
                    if len(out) >= BATCH:
                        yield _lines(i, out)
                        out = []
                yield _lines(i, out)

    d = spark.createDataFrame(ranges, schema).repartition(max(1, min(len(ranges), 10_000)), "file", "begin")
    return d.mapInArrow(read, "file int, offset long, line binary"), [p for p, _ in files]


def _lines(file: int, rows: list[tuple[int, bytes]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([file] * len(rows), pa.int32()), pa.array([o for o, _ in rows], pa.int64()), pa.array([x for _, x in rows], pa.binary())], names=["file", "offset", "line"])


def parsed(lines: DataFrame, schema: str = RECORD_SCHEMA) -> DataFrame:
    """Lines with their record as struct r; lines that are no JSON objects are left out."""
    d = lines.withColumn("_text", F.col("line").cast("string")).withColumn("r", F.from_json("_text", f"{schema}, _bad string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}))
    return d.where("r is not null and r._bad is null and ltrim(_text) like '{%'").drop("_text")


def qa_index(
    spark: SparkSession,
    pattern: str,
    allowed: DataFrame | None = None,
    policy: str = "all",
    exclude: Sequence[str] = (),
    variants: Sequence[int] | None = None,
    faithful_only: bool = False,
    turn_wise: bool = True,
    max_records: int | None = None,
    span: int = RANGE,
) -> tuple[DataFrame, list[str]]:
    """(file, offset, ids, turn, position) of the entries, and the files: turns of answers, or whole records (turn null).

    Records are left out by scenario, variant (0 by default), faithfulness (true by default), without meshes, and by the
    split: `all`, the `primary` or `any` of their meshes must be among `allowed` (index). With max_records every file
    gives entries up to its equal share, rounded up, as long as those before stay below it. Entries of the files take
    turns: position orders them by their number within the file, then by the file, and the first max_records are kept.
    """
    lines, files = scan_lines(spark, pattern, span)
    ids = mesh_ids(F.col("r.mesh_ref"), F.col("r.index"))
    d = parsed(lines).select("file", "offset", "r", ids.alias("ids")).where(F.size("ids") > 0)
    if exclude:
        d = d.where(~F.coalesce(F.col("r.scenario").isin(*exclude), F.lit(False)))
    if variants is not None:
        d = d.where(F.coalesce("r.variant", F.lit(0)).isin(*variants))
    if faithful_only:
        d = d.where(F.coalesce("r.nat_all_faithful", F.lit(True)))
    answers = F.greatest(F.coalesce(F.size(F.filter("r.conversations", lambda t: t["from"] == "gpt")), F.lit(0)), F.lit(0))
    d = d.select("file", "offset", "ids", (answers if turn_wise else F.lit(1)).alias("n"))
    if allowed is not None:
        mesh = d.select(F.struct("file", "offset").alias("entry"), F.posexplode("ids").alias("place", "id"))
        known = allowed.select(F.col("index").alias("id"), F.lit(True).alias("_in")).distinct()
        flags = membership_policies(mesh.join(known, "id", "left"), "entry", "id", F.coalesce("_in", F.lit(False)), "place")
        flags = flags.where(f"in_{policy}").select(F.col("entry.file").alias("_f"), F.col("entry.offset").alias("_o"))
        d = d.join(flags, (F.col("file") == F.col("_f")) & (F.col("offset") == F.col("_o")), "left_semi")
    if max_records:
        d = quota_prefix(d, "file", "offset", "n", max(1, -(-max_records // len(files))), width=span)
    turns = F.explode(F.sequence(F.lit(0), F.col("n") - 1)) if turn_wise else F.lit(None)
    entries = _numbered(d, span).withColumn("turn", turns)
    entries = entries.select("file", "offset", "ids", F.col("turn").cast("int").alias("turn"), (F.col("before") + F.coalesce("turn", F.lit(0))).alias("number"))
    return _in_turns(entries, max_records), files


def _numbered(d: DataFrame, width: int) -> DataFrame:
    """d with `before`: the entries of earlier records of the file, added up over ranges of offsets."""
    d = d.where("n > 0").withColumn("_run", F.expr(f"offset div {width}"))
    sums = d.groupBy(F.col("file").alias("_f"), F.col("_run").alias("_r")).agg(F.sum("n").alias("_w"))
    ahead = Window.partitionBy("_f").orderBy("_r").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("_f", "_r", F.coalesce(F.sum("_w").over(ahead), F.lit(0)).alias("_ahead"))
    own = Window.partitionBy("file", "_run").orderBy("offset").rowsBetween(Window.unboundedPreceding, -1)
    joined = d.join(sums, _same(["file", "_run"], ["_f", "_r"]))
    return joined.withColumn("before", F.col("_ahead") + F.coalesce(F.sum("n").over(own), F.lit(0))).drop("_run", "_f", "_r", "_ahead")


def _in_turns(entries: DataFrame, most: int | None) -> DataFrame:
    """position of entries by (number, file): how many entries have a smaller number, and those of earlier files.

    The files that still have an entry at a number follow from the files' sizes, so nothing is sorted as a whole:
    with c(k) = sum over files of min(size, k), an entry comes after c(number) others and the earlier files that reach it.
    """
    sizes = entries.groupBy("file").agg(F.count(F.lit(1)).alias("size"))
    # A row a file: the list of sizes is as long as the list of files.
    listed = sizes.agg(F.array_sort(F.collect_list(F.struct("file", "size"))).alias("sizes"))
    d = entries.join(F.broadcast(listed))
    before = F.aggregate("sizes", F.lit(0).cast("long"), lambda s, f: s + F.least(f["size"], F.col("number").cast("long")) + F.when((f["file"] < F.col("file")) & (f["size"] > F.col("number")), 1).otherwise(0))
    out = d.withColumn("position", before).drop("sizes", "number")
    return out.where(F.col("position") < most) if most else out


def read_entries(entries: DataFrame, files: Sequence[str], pattern: str, schema: str = RECORD_SCHEMA) -> DataFrame:
    """entries with their record r, read by (file, offset): a task seeks its lines alone; the files' names are what the index lists."""
    base, paths = _base(pattern), list(files)
    places = entries.select("file", "offset").distinct().repartition("file", F.expr(f"offset div {RANGE}")).sortWithinPartitions("file", "offset")

    def read(batches):
        system, _ = opened(base)
        held, handle = None, None
        try:
            for batch in batches:
                out = []
                for i, offset in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    if i != held:
                        if handle is not None:
                            handle.close()
                        held, handle = i, system.open_input_file(paths[i])
                    handle.seek(offset)
                    line = b""
                    while b"\n" not in line and (more := handle.read(1 << 16)):
                        line += more
                    out.append((i, offset, line.split(b"\n", 1)[0]))
                yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in out], pa.int32()), pa.array([r[1] for r in out], pa.int64()), pa.array([r[2] for r in out], pa.binary())], names=["_f", "_o", "line"])
        finally:
            if handle is not None:
                handle.close()

    lines = places.mapInArrow(read, "_f int, _o long, line binary")
    found = parsed(lines, schema).drop("line")
    return entries.join(found, (F.col("file") == F.col("_f")) & (F.col("offset") == F.col("_o"))).drop("_f", "_o")
