"""Merkle manifests of a dataset: a tree for each source, and a tree of their roots.

Partitions of the sorted leaves hold sparse forests, nodes keyed by tree, level and index. Forests are a monoid: the
union of two replaces every complete run of siblings by its parent, and a run is complete when it has as many nodes as
the number of the tree's leaves says. Neighbouring partitions' forests are merged in a tree reduction until one node
is left, the root. All nodes are kept, and give every leaf its siblings on the way up.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import fresh_names, stored

ARITY = 16
#: The tree of the sources' roots.
TOP = -1
#: Forests that one step of the reduction merges.
FAN = 64
_NODE = pa.schema([("part", pa.int64()), ("tree", pa.int64()), ("n", pa.int64()), ("level", pa.int32()), ("index", pa.int64()), ("digest", pa.string()), ("made", pa.bool_()), ("open", pa.bool_())])
NODE = "part long, tree long, n long, level int, index long, digest string, made boolean, open boolean"


def digest(*parts: str) -> str:
    return hashlib.sha256("".join(parts).encode("utf-8", "surrogatepass")).hexdigest()


def leaf_digest(*fields: Column) -> Column:
    """The digest of a row: each field is `-` if null, else its bytes in UTF-8, a colon and the value."""
    said = [F.coalesce(F.concat(F.octet_length(f.cast("string")), F.lit(":"), f.cast("string")), F.lit("-")) for f in fields]
    return F.sha2(F.concat(*said).cast("binary"), 256)


def height(n: int, arity: int = ARITY) -> int:
    """The level at which n leaves have become one node."""
    level = 0
    while n > 1:
        n, level = -(-n // arity), level + 1
    return level


class Forest:
    """Nodes that have no parent yet, of any trees, levels and indexes."""

    def __init__(self, trees: int, arity: int = ARITY):
        self.trees, self.arity = trees, arity
        self.runs: dict[tuple[int, int, int], dict[int, str]] = defaultdict(dict)
        self.leaves_of = {TOP: trees}
        #: Nodes that were made here, in the order of making.
        self.made: list[tuple[int, int, int, str]] = []

    def add(self, tree: int, n: int, level: int, index: int, node: str) -> None:
        """Put a node in; what it completes is replaced by its parent, as far up as that goes."""
        self.leaves_of[tree] = n
        while True:
            width = -(-n // self.arity**level)
            if width == 1:
                if tree == TOP:
                    self.runs[TOP, level, 0][0] = node
                    return
                # A tree's root is a leaf of the tree above.
                tree, n, level, index = TOP, self.trees, 0, tree
                self.made.append((tree, level, index, node))
                continue
            run = index // self.arity
            members = self.runs[tree, level, run]
            members[index] = node
            if len(members) < min(self.arity, width - run * self.arity):
                return
            del self.runs[tree, level, run]
            level, index, node = level + 1, run, digest(*(members[i] for i in sorted(members)))
            self.made.append((tree, level, index, node))

    def rows(self, part: int) -> list[tuple]:
        """The nodes made here, and those that are open."""
        open_ = {(tree, level, index): node for (tree, level, _), run in self.runs.items() for index, node in run.items()}
        made = [(part, t, self.leaves_of[t], level, i, node, True, open_.pop((t, level, i), None) is not None) for t, level, i, node in self.made]
        return made + [(part, t, self.leaves_of[t], level, i, node, False, True) for (t, level, i), node in open_.items()]


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(_NODE)], schema=_NODE)


def _build(trees: int, arity: int, most: int = 1 << 16):
    """Leaves (part, tree, n, index, leaf) to the forests of their partitions."""

    def run(batches):
        forest, here = Forest(trees, arity), None
        for batch in batches:
            for part, tree, n, index, leaf in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True):
                if part != here or len(forest.made) >= most:
                    if here is not None:
                        yield _batch(forest.rows(here))
                    forest, here = Forest(trees, arity), part
                forest.add(tree, n, 0, index, leaf)
        if here is not None:
            yield _batch(forest.rows(here))

    return run


def _merge(trees: int, arity: int):
    """The open nodes of neighbouring forests to one forest."""

    def run(key, table):
        forest = Forest(trees, arity)
        for tree, n, level, index, node in zip(*(table.column(c).to_pylist() for c in ("tree", "n", "level", "index", "digest")), strict=True):
            forest.add(tree, n, level, index, node)
        return pa.Table.from_batches([_batch(forest.rows(key[0].as_py()))])

    return run


class Manifest:
    """The trees of a table: leaves in their places, all nodes above them, and the root (None without rows).

    docs has a key and a group column; leaf is a digest of its rows, extra are further columns to keep. A group's leaves
    ascend by key, null first, rows that repeat a key by digest; groups ascend bytewise, null first. A group may hold any
    share of the rows: leaves lie in range partitions of (group, key, digest, row).
    """

    def __init__(self, docs: DataFrame, leaf: Column, key: str = "doc_id", group: str = "source", extra: dict[str, Column] | None = None, arity: int = ARITY):
        self.arity, self.extra = arity, list(extra or {})
        taken = ["part", "tree", "n", "index", "leaf", "mid", "here", "first", "least", "home", "before", *self.extra]
        self.group, self.key, row = fresh_names(taken, "_group", "_key", "_row")
        cols = [F.col(group).alias(self.group), F.col(key).cast("long").alias(self.key), leaf.alias("leaf"), *(c.alias(x) for x, c in (extra or {}).items())]
        plain = stored(docs.select(*cols).withColumn(row, F.monotonically_increasing_id()), "merkle-leaves")
        order = [F.col(self.group).asc_nulls_first(), F.col(self.key).asc_nulls_first(), F.col("leaf"), F.col(row)]
        kept = [self.group, self.key, "leaf", *self.extra]
        numbered = plain.repartitionByRange(*order).sortWithinPartitions(*order).select(*kept, F.monotonically_increasing_id().alias("mid"))
        self.sorted = stored(numbered.withColumn("part", F.shiftright("mid", 33)), "merkle-sorted")
        self.facts = self._places()
        self.trees = self.facts.agg(F.max("tree")).first()[0]
        self.trees = 0 if self.trees is None else self.trees + 1
        self.nodes, self.root = self._reduced() if self.trees else (None, None)

    def _places(self) -> DataFrame:
        """For each partition and group in it: the group's number, its size and what lies in earlier partitions.

        A row a group and partition; the windows over a group hold a row a partition.
        """
        of, g = self.sorted, F.col(self.group)
        whole = Window.partitionBy(self.group)
        earlier = whole.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
        counts = of.groupBy("part", self.group).agg(F.count(F.lit(1)).alias("here"), F.min("mid").alias("first"))
        facts = counts.select("part", g, "first", F.coalesce(F.sum("here").over(earlier), F.lit(0)).alias("before"), F.sum("here").over(whole).alias("n"), F.min("first").over(whole).alias("least"))
        facts = stored(facts, "merkle-counts")
        # Groups in the order of their first leaves: numbered inside the partitions where they begin, behind those of earlier ones.
        heads = facts.where("first = least").select("least", F.shiftright("least", 33).alias("home"))
        homes = heads.groupBy("home").agg(F.count(F.lit(1)).alias("here"))
        homes = homes.select("home", F.coalesce(F.sum("here").over(Window.orderBy("home").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("done"))
        ranks = heads.withColumn("at", F.row_number().over(Window.partitionBy("home").orderBy("least")) - 1).join(homes, "home").select("least", (F.col("done") + F.col("at")).cast("long").alias("tree"))
        return stored(facts.join(ranks, "least").select("part", F.col(self.group), "first", "before", "n", "tree"), "merkle-places")

    def leaves(self) -> DataFrame:
        """part, tree, n, index, the key, leaf and further columns of every row.

        The places are broadcast as long as Spark measures them as small; beyond that the join has (partition, group) as
        its key, which has no more rows than a partition.
        """
        own, g = fresh_names([*self.sorted.columns, *self.facts.columns], "_part", "_of")
        places = self.facts.withColumnsRenamed({"part": own, self.group: g})
        joined = self.sorted.join(places, (F.col("part") == F.col(own)) & F.col(self.group).eqNullSafe(F.col(g)))
        return joined.select("part", "tree", "n", (F.col("before") + F.col("mid") - F.col("first")).alias("index"), self.key, "leaf", *self.extra)

    def _reduced(self) -> tuple[DataFrame, str]:
        """All nodes above the leaves, and the root: forests of FAN neighbouring partitions are merged until one is left."""
        made = stored(self.leaves().select("part", "tree", "n", "index", "leaf").mapInArrow(_build(self.trees, self.arity), NODE), "merkle-forest")
        steps, parts = [made], self.facts.agg(F.max("part")).first()[0] + 1
        while True:
            left = steps[-1].where("open").select(F.expr(f"part div {FAN}").alias("part"), "tree", "n", "level", "index", "digest")
            steps.append(stored(left.groupBy("part").applyInArrow(_merge(self.trees, self.arity), NODE), "merkle-merged"))
            parts = -(-parts // FAN)
            if parts <= 1:
                break
        root = steps[-1].where(f"open and tree = {TOP}").select("digest").first()[0]
        nodes = steps[0].where("made")
        for step in steps[1:]:
            nodes = nodes.unionByName(step.where("made"))
        return nodes.select("tree", "n", "level", "index", "digest"), root

    def _runs(self, nodes: DataFrame, level: int) -> DataFrame:
        """(tree, run, members): the digests of siblings one after another; levels with one node have none."""
        wide = F.col("n") > self.arity**level
        of = nodes.where((F.col("level") == level) & wide).groupBy("tree", F.expr(f"index div {self.arity}").alias("run"))
        listed = F.array_sort(F.collect_list(F.struct("index", "digest")))
        return of.agg(F.concat_ws("", F.transform(listed, lambda x: x["digest"])).alias("members"))

    def paths(self) -> DataFrame:
        """(tree, block, path): for the leaves of a tree whose index div arity^2 is block, the runs above their own.

        Levels are joined from the top downwards, each with at most arity nodes to a key.
        """
        a, up = self.arity, F.lit(None).cast("array<string>")
        top = self.nodes.where(f"tree = {TOP}")
        above = None
        for level in reversed(range(height(self.trees, a))):
            runs = self._runs(top, level).select("run", F.array("members").alias("own"))
            if above is None:
                above = runs.select("run", F.col("own").alias("path"))
            else:
                parents = above.select(F.col("run").alias("_over"), "path")
                above = runs.join(parents, F.expr(f"run div {a}") == F.col("_over")).select("run", F.concat("own", "path").alias("path"))
        sizes = self.facts.groupBy("tree").agg(F.first("n").alias("n"))
        if above is None:
            roots = sizes.withColumn("path", F.coalesce(up, F.array().cast("array<string>")))
        else:
            roots = sizes.join(above.withColumnRenamed("run", "_over"), F.expr(f"tree div {a}") == F.col("_over")).select("tree", "n", "path")
        roots = stored(roots, "merkle-roots")
        tallest = height(roots.agg(F.max("n")).first()[0], a)
        below = None
        for level in range(max(tallest, 1), 0, -1):
            # Trees whose root is at this level start here; at level 1 those of a single leaf do too.
            of_height = F.col("n") <= a**level if level == 1 else (F.col("n") <= a**level) & (F.col("n") > a ** (level - 1))
            starts = roots.where(of_height).select("tree", F.lit(0).cast("long").alias("run"), "path")
            if below is not None:
                parents = below.select(F.col("tree").alias("_tree"), F.col("run").alias("_over"), "path")
                runs = self._runs(self.nodes.where("tree >= 0"), level)
                lower = runs.join(parents, (F.col("tree") == F.col("_tree")) & (F.expr(f"run div {a}") == F.col("_over")))
                starts = starts.unionByName(lower.select("tree", "run", F.concat(F.array("members"), "path").alias("path")))
            below = starts
        return below.select("tree", F.col("run").alias("block"), "path")

    def proofs(self, claim: str = "leaf") -> DataFrame:
        """doc_id, leaf, subroot, root, proof_sha256, folded_root, verified of every row; claim is the leaf to fold up, `leaf` or one of extra.

        proof_sha256 is the digest of the siblings level by level from the leaf to the root, each from left to right.
        """
        block = F.expr(f"index div {self.arity**2}").alias("block")
        listed = F.collect_list(F.struct(F.col("index"), F.col(self.key).alias("doc_id"), F.col("leaf"), F.col(claim).alias("claim")))
        blocks = self.leaves().groupBy("tree", "n", block).agg(listed.alias("leaves"))
        rows = blocks.join(self.paths(), ["tree", "block"]).select("tree", "n", "block", "leaves", "path")
        return rows.mapInArrow(_prove(self.trees, self.arity, self.root), PROOF)


PROOF = "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"


def _around(members: str, at: int) -> tuple[str, str]:
    """The siblings to the left and right of the node at a place of a run."""
    return members[: 64 * at], members[64 * at + 64 :]


def _prove(trees: int, arity: int, root: str):
    schema = pa.schema([("doc_id", pa.int64()), *((c, pa.string()) for c in ("leaf", "subroot", "root", "proof_sha256", "folded_root")), ("verified", pa.bool_())])

    def run(batches):
        for batch in batches:
            out = [[] for _ in schema]
            for tree, n, block, leaves, path in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True):
                leaves.sort(key=lambda x: x["index"])
                levels = height(n, arity)
                # Above level 1 all leaves of a block have the same siblings.
                upper, over, subroot = [], block, root
                for level, members in enumerate(path, 1):
                    if level <= levels - 1:
                        own = None if level == 1 else over % arity
                        over = over if level == 1 else over // arity
                    else:
                        j = level - max(levels, 1)
                        own = tree // arity**j % arity
                        if not j:
                            subroot = members[64 * own : 64 * own + 64]
                    upper.append((members, own))
                rest = "".join("".join(_around(m, own)) for m, own in upper if own is not None)
                runs: dict[int, str] = defaultdict(str)
                for x in leaves:
                    runs[x["index"] // arity] += x["leaf"]
                for x in leaves:
                    i, node, near = x["index"], x["claim"], []
                    if n > 1:
                        near.append(_around(runs[i // arity], i % arity))
                    for members, own in upper:
                        near.append(_around(members, i // arity % arity if own is None else own))
                    for left, right in near:
                        node = digest(left, node, right)
                    proof = hashlib.sha256("".join([*(s for pair in near[: len(near) - sum(own is not None for _, own in upper)] for s in pair), rest]).encode()).hexdigest()
                    for col, value in zip(out, (x["doc_id"], x["leaf"], subroot, root, proof, node, node == root), strict=True):
                        col.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(out, schema, strict=True)], schema=schema)

    return run


def lower_ascii(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def merkle_proofs(docs: DataFrame) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root, verified of every document.

    Rows whose doc_id's crc32 is divisible by 5 are folded up from their leaf with A-Z of the text in lower case, so a
    row is not verified if that changes its text. Nulls are part of the leaf as `-`; a null source is a tree of its own
    before all others; a null doc_id comes first and is never tampered with; rows that repeat a doc_id are leaves each.
    Columns other than doc_id, source, lang, n_chars and text are not read. An empty table has no root and gives no rows.
    """
    fields = [F.col(c) for c in ("doc_id", "source", "lang", "n_chars", "text")]
    tampered = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    claim = F.when(tampered, leaf_digest(*fields[:4], lower_ascii(F.col("text"))))
    found = Manifest(docs, leaf_digest(*fields), extra={"claim": claim})
    if found.root is None:
        return docs.sparkSession.createDataFrame([], PROOF)
    found.sorted = found.sorted.withColumn("claim", F.coalesce("claim", "leaf"))
    return found.proofs("claim")
