"""Sharding by size-tiered compaction.

Arrivals are appended as small immutable shards, one for each input partition. Whenever a tier holds enough
shards of similar size, they are merged into larger ones, until shards have the target size. A version is a
commit file with the shards that it adds and removes; every CHECKPOINT versions the whole list is written beside
it. Commits are written aside and renamed into place, so readers see one version or the next.
"""

from __future__ import annotations

import json
import math
import time
import uuid
from collections.abc import Callable
from dataclasses import asdict, dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fresh_names

#: Codec of shard files: arrivals stay beside the merged shards until a vacuum.
CODEC = "zstd"
#: Runs that one job merges; further runs follow in the next round.
ROUND = 2048
#: Versions from one whole list of shards to the next, and times that a commit is tried.
CHECKPOINT, TRIES = 16, 20


class Conflict(RuntimeError):
    """Another writer committed first, and what this one wanted to merge is gone."""


@dataclass(frozen=True)
class Shard:
    """An immutable Parquet file below the store's root: its rows and bytes of text."""

    path: str
    rows: int
    size: int


class ShardStore:
    """Shards and versions in a folder that all executors share.

    Rows keep all their columns, whatever their names; null and repeated rows are rows like any other, and null
    texts count 0 bytes. An append of no rows is a version without new shards. The driver holds an entry a shard,
    as Spark's own file index does for any table of so many files; what a commit writes is what it changes.
    """

    def __init__(self, spark: SparkSession, root: str, target: int = 64 << 20, fan_in: int = 4, text_col: str = "text"):
        if target < 1 or fan_in < 2:
            raise ValueError("target must be positive and fan_in at least 2")
        self.spark, self.root, self.target, self.fan_in, self.text_col = spark, root.rstrip("/"), target, fan_in, text_col
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())

    # Versions

    def _listed(self, prefix: str) -> list[int]:
        at = self._path(f"{self.root}/manifests")
        if not self._fs.exists(at):
            return []
        names = (s.getPath().getName() for s in self._fs.listStatus(at))
        return sorted(int(n[len(prefix) : -5]) for n in names if n.startswith(prefix) and n.endswith(".json"))

    def versions(self) -> list[int]:
        return self._listed("v")

    def _load(self, name: str) -> dict:
        stream = self._fs.open(self._path(f"{self.root}/manifests/{name}.json"))
        try:
            return json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def _put(self, name: str, content: dict) -> bool:
        """Write a file aside and rename it; false if there is one of that name already. The rename never replaces a file."""
        aside, final = self._path(f"{self.root}/manifests/.{uuid.uuid4().hex}.tmp"), self._path(f"{self.root}/manifests/{name}.json")
        stream = self._fs.create(aside, False)
        try:
            stream.write(bytearray(json.dumps(content).encode()))
        finally:
            stream.close()
        if not self._fs.exists(final) and self._fs.rename(aside, final):
            return True
        self._fs.delete(aside, False)
        return False

    def shards(self, version: int | None = None) -> list[Shard]:
        """The shards of a version, the newest by default; none before the first commit."""
        known = self.versions()
        if not known:
            return []
        version = known[-1] if version is None else version
        if version not in known:
            raise ValueError(f"version {version} is not kept")
        begin = max((c for c in self._listed("c") if c <= version), default=0)
        live = {s["path"]: Shard(**s) for s in self._load(f"c{begin:08d}")["shards"]} if begin else {}
        for v in range(begin + 1, version + 1):
            change = self._load(f"v{v:08d}")
            for path in change["removes"]:
                live.pop(path, None)
            live |= {s["path"]: Shard(**s) for s in change["adds"]}
        return sorted(live.values(), key=lambda s: s.path)

    def commit(self, adds: list[Shard], removes: frozenset[str] | set[str] = frozenset()) -> int:
        """Write the next version; where another writer was first, the one after that.

        Raises Conflict if a shard to remove is gone by then: someone else has merged it.
        """
        for turn in range(TRIES):
            version = self._version() + 1
            if removes and not removes <= {s.path for s in self.shards()}:
                raise Conflict("shards to merge were merged by another writer")
            if self._put(f"v{version:08d}", {"version": version, "time": time.time(), "adds": [asdict(s) for s in adds], "removes": sorted(removes)}):
                if version % CHECKPOINT == 0:
                    self._checkpoint(version)
                return version
            time.sleep(min(1.0, 0.01 * 2**turn))
        raise Conflict(f"no version could be committed in {TRIES} tries")

    def _checkpoint(self, version: int) -> None:
        self._put(f"c{version:08d}", {"version": version, "shards": [asdict(s) for s in self.shards(version)]})

    def _version(self) -> int:
        return max(self.versions(), default=0)

    # Shards

    def _measure(self, folder: str) -> list[Shard]:
        """Rows and text bytes of each file that a write left in a folder; the table has a row for each file."""
        names = [s.getPath().getName() for s in self._fs.listStatus(self._path(folder))]
        if not any(n.startswith("part-") for n in names):
            return []
        size = F.coalesce(F.octet_length(self.text_col), F.lit(0)) + 16
        rows = self.spark.read.parquet(folder).groupBy(F.col("_metadata.file_name").alias("name")).agg(F.count(F.lit(1)).alias("n"), F.sum(size).alias("size")).collect()
        base = folder.removeprefix(f"{self.root}/")
        return sorted((Shard(f"{base}/{r['name']}", r["n"], int(r["size"])) for r in rows), key=lambda s: s.path)

    def _write(self, rows: DataFrame) -> tuple[str, list[Shard]]:
        folder = f"{self.root}/shards/{uuid.uuid4().hex}"
        rows.write.option("compression", CODEC).parquet(folder)
        return folder, self._measure(folder)

    def append(self, arrivals: DataFrame) -> int:
        """Write arrivals as new shards, a file for each partition, and commit them. No rows move."""
        return self.commit(self._write(arrivals)[1])

    def tier(self, size: int) -> int:
        """Full shards are in tier 0; each further tier holds shards that are smaller by the fan-in."""
        return max(0, math.ceil(math.log(self.target / max(size, 1), self.fan_in) - 1e-9)) if size < self.target else 0

    def merges(self, shards: list[Shard], final: bool = False) -> list[list[Shard]]:
        """Runs of similar size to merge: fan_in or more shards of a tier, cut where a run reaches the target.

        final: the rest of all tiers is merged too, so that at most one shard stays below the target.
        """
        tiers: dict[int, list[Shard]] = {}
        for s in sorted(shards, key=lambda s: s.path):
            tiers.setdefault(self.tier(s.size), []).append(s)
        runs, rest = [], []
        for tier, members in sorted(tiers.items(), reverse=True):
            if tier == 0:
                continue
            members = rest + members if final else members
            run, held = [], 0
            for s in members:
                run.append(s)
                held += s.size
                if held >= self.target:
                    runs.append(run)
                    run, held = [], 0
            if not final and len(run) >= self.fan_in:
                runs.append(run)
                run = []
            rest = run if final else []
        if final and len(rest) > 1:
            runs.append(rest)
        return [r for r in runs if len(r) > 1]

    def compact(self, final: bool = False) -> int:
        """Merge until no tier has a run left; each round is one job and one commit.

        A run becomes one file: its rows are read by one task, and a run is at most the target and a shard. Where
        another writer merged the same shards first, this round's files are deleted and the round is planned anew.
        """
        while runs := self.merges(self.shards(), final)[:ROUND]:
            gone = {s.path for run in runs for s in run}
            rows = self.spark.read.parquet(*[f"{self.root}/{p}" for p in sorted(gone)])
            name, own, number = fresh_names(rows.columns, "_name", "_own", "_run")
            # A row for each shard of this round: ROUND * target bytes at most, in shards of a size.
            table = [(s.path.rpartition("/")[2], i) for i, run in enumerate(runs) for s in run]
            names = self.spark.createDataFrame(table, f"{own} string, {number} int")
            placed = rows.withColumn(name, F.col("_metadata.file_name")).join(F.broadcast(names), F.col(name) == F.col(own)).drop(name, own)
            folder, merged = self._write(self._by_run(placed, len(runs), number).drop(number))
            try:
                self.commit(merged, gone)
            except Conflict:
                self._fs.delete(self._path(folder), True)
        return self._version()

    @staticmethod
    def _by_run(rows: DataFrame, runs: int, number: str) -> DataFrame:
        """One partition for each run; a shuffle partition is the direct image of the run's number."""
        return rows.repartitionById(runs, F.col(number))

    def read(self, version: int | None = None, shard_col: str = "shard") -> DataFrame | None:
        """The rows of a version with the path of their shard in shard_col, or None for a store without shards.

        Raises ValueError if the rows have a column of that name.
        """
        shards = self.shards(version)
        if not shards:
            return None
        rows = self.spark.read.parquet(*[f"{self.root}/{s.path}" for s in shards])
        if shard_col.lower() in map(str.lower, rows.columns):
            raise ValueError(f"the rows have a column {shard_col}; name another shard_col")
        return rows.withColumn(shard_col, F.regexp_extract(F.col("_metadata.file_path"), r"(shards/[^/]+/[^/]+)$", 1))

    def vacuum(self, grace: float = 3600.0, now: Callable[[], float] = time.time) -> int:
        """Delete versions that were superseded more than grace seconds ago, and all files that no kept version names.

        Files younger than that stay, since a write may be on its way to its commit, and so do the versions that a reader
        may have begun to read. Returns the number of shard files deleted.
        """
        versions = self.versions()
        if not versions:
            return 0
        line = now() - grace
        born = {v: self._load(f"v{v:08d}")["time"] for v in versions}
        kept = [v for v, after in zip(versions, versions[1:], strict=False) if born[after] > line] + versions[-1:]
        named = {s.path for v in kept for s in self.shards(v)}
        if kept[0] > versions[0]:
            # Kept versions are read from a list of their first one.
            if kept[0] not in self._listed("c"):
                self._checkpoint(kept[0])
            for v in [v for v in versions if v < kept[0]]:
                self._fs.delete(self._path(f"{self.root}/manifests/v{v:08d}.json"), False)
            for c in [c for c in self._listed("c") if c < kept[0]]:
                self._fs.delete(self._path(f"{self.root}/manifests/c{c:08d}.json"), False)
        deleted = 0
        at = self._path(f"{self.root}/shards")
        for folder in self._fs.listStatus(at) if self._fs.exists(at) else []:
            base = folder.getPath().getName()
            files = [f for f in self._fs.listStatus(folder.getPath()) if f.getPath().getName().startswith("part-")]
            old = [f for f in files if f"shards/{base}/{f.getPath().getName()}" not in named and f.getModificationTime() / 1000 <= line]
            for f in old:
                deleted += bool(self._fs.delete(f.getPath(), False))
            if len(old) == len(files) and folder.getModificationTime() / 1000 <= line:
                self._fs.delete(folder.getPath(), True)
        return deleted
