"""Mixing sources to target weights by entropy balancing, in DataFrame operations only.

The mix takes document i at the rate min(cap, exp(lambda_s x_i)), x_i being its size over its source's mean
size. These are the rates of least relative entropy to the plain corpus under one token constraint a source,
sum of rate times size = target, and the box [0, cap]. lambda_s maximises the concave dual, whose gradient is
target minus tokens taken: guarded Newton steps for all sources at once over the histogram of sizes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import discard, stored

#: Terms are summed as integers in units of 2**-SCALE tokens, so that sums don't depend on the order of rows.
SCALE = 20
#: Cells that may correct a source's total, for each doubling of sizes.
CORRECTED = 4
#: A multiplier at which every document with a word is at its cap; also the bracket before a bound is known.
FULL = 1e12


def source_targets(sizes: DataFrame, weights: tuple[int, ...], cap: int) -> DataFrame:
    """source, source_size, n_docs, target from (source, size, n): water-filling of all tokens by weight up to the caps.

    Sources rank by code point, null last, and weights repeat in that order. A level c is found in closed form
    such that the targets min(c * weight, cap * source_size) share all tokens. The table has a row a source.
    """
    s = sizes.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"), F.sum("n").alias("n_docs"))
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    s = s.withColumn("w", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (rank % len(weights)).cast("int") + 1))
    s = s.withColumn("room", F.col("source_size") * F.lit(float(cap)))
    by_ratio = Window.orderBy(F.col("room") / F.col("w"), F.col("source").asc_nulls_last())
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    every = Window.orderBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    s = s.withColumns({"total": F.sum("source_size").over(every).cast("double"), "full": F.coalesce(F.sum("room").over(before), F.lit(0.0)), "ahead": F.coalesce(F.sum("w").over(before), F.lit(0.0)), "all_w": F.sum("w").over(every)})
    # With the sources before this one full, the level for the rest; the first source that this level leaves below its cap sets it.
    s = s.withColumn("level", (F.col("total") - F.col("full")) / (F.col("all_w") - F.col("ahead")))
    s = s.withColumn("pos", F.row_number().over(by_ratio))
    s = s.withColumn("at_pos", F.min(F.when(F.col("level") * F.col("w") <= F.col("room"), F.col("pos"))).over(every))
    s = s.withColumn("at", F.max(F.when(F.col("pos") == F.col("at_pos"), F.col("level"))).over(every))
    target = F.least(F.coalesce("at", F.lit(float("inf"))) * F.col("w"), F.col("room"))
    return s.select("source", "source_size", "n_docs", target.alias("target"))


def _rate(x: Column, lam: Column, cap: int) -> Column:
    return F.least(F.lit(float(cap)), F.exp(F.least(lam * x, F.lit(50.0))))


def solve_rates(hist: DataFrame, targets: DataFrame, cap: int, steps: int = 60, tolerance: float = 1e-7, accepted: float = 1e-3) -> DataFrame:
    """targets with lambda: Newton steps on the dual, each inside a bracket that shrinks, until every source is within tolerance.

    off_target marks sources that after these steps, or with brackets as narrow as numbers allow, miss their target by more
    than the accepted share of it; they get the rates reached, and the others theirs.
    """
    full = F.col("target") >= F.col("source_size") * F.lit(cap * (1 - 1e-9))
    state = targets.withColumns({"lam": F.when(full, FULL).otherwise(0.0), "lo": F.lit(-FULL), "hi": F.lit(FULL), "gap": F.lit(1.0)})
    state = state.withColumn("mean", F.greatest(F.col("source_size") / F.col("n_docs"), F.lit(1e-9)))
    state = stored(state, "mix-state")
    unit = float(1 << SCALE)
    for _ in range(steps):
        cells = hist.join(state.select(F.col("source").alias("_s"), "lam", "mean"), F.col("source").eqNullSafe(F.col("_s")))
        x = F.col("size") / F.col("mean")
        rate = _rate(x, F.col("lam"), cap)
        tokens = rate * F.col("size") * F.col("n")
        slope = F.when(rate < cap, tokens * x).otherwise(0.0)
        whole = lambda c: F.sum(F.round(c * unit).cast("decimal(38,0)"))
        sums = cells.groupBy("source").agg((whole(tokens).cast("double") / unit).alias("f"), (whole(slope).cast("double") / unit).alias("df"))
        s = state.join(sums.select(F.col("source").alias("_s"), "f", "df"), F.col("source").eqNullSafe(F.col("_s"))).drop("_s")
        s = s.withColumns({"lo": F.when(F.col("f") < F.col("target"), F.greatest("lo", "lam")).otherwise(F.col("lo")), "hi": F.when(F.col("f") >= F.col("target"), F.least("hi", "lam")).otherwise(F.col("hi")), "gap": F.when(F.col("target") > 0, F.abs(F.col("f") - F.col("target")) / F.col("target")).otherwise(F.lit(0.0))})
        newton = F.col("lam") + (F.col("target") - F.col("f")) / F.col("df")
        inside = (F.col("df") > 0) & (newton > F.col("lo")) & (newton < F.col("hi"))
        s = s.withColumn("lam", F.when(F.col("gap") <= tolerance, F.col("lam")).when(inside, newton).when(F.col("hi") == FULL, F.col("lo") * 2 + 1).when(F.col("lo") == -FULL, F.col("hi") * 2 - 1).otherwise((F.col("lo") + F.col("hi")) / 2))
        before, state = state, stored(s.drop("f", "df"), "mix-state")
        discard(before)
        if state.where(F.col("gap") > tolerance).where("hi - lo > 1e-12 * greatest(1, abs(lo), abs(hi))").isEmpty():
            break
    return state.select("source", "source_size", "target", "mean", "lam", (F.col("gap") > accepted).alias("off_target"))


def _bucket(size: Column) -> Column:
    """Sizes within a sixteenth of a factor of two share a bucket: at most 16 for each doubling of the longest text."""
    return F.floor(F.log2(size) * 16).cast("int")


def _copies(cells: DataFrame, cap: int) -> DataFrame:
    """Copies of each (source, size): rounded prefix sums of the expected copies, largest size first, then a correction.

    Rounded prefix sums never stray more than half a copy, so what they miss of a target is less than the longest
    text. The correction changes the copies of some cells, at most CORRECTED for each doubling of sizes, from the
    largest on, until less than the smallest of them is missing. Prefix sums run inside buckets of sizes; the sums
    of the buckets before, a bounded number a source, are added to them.
    """
    unit = 1 << SCALE
    c = cells.withColumns({"due": F.round(F.col("n") * F.col("rate") * unit).cast("long"), "bucket": _bucket(F.col("size"))})
    sums = c.groupBy("source", "bucket").agg(F.sum("due").alias("all_due"))
    before = Window.partitionBy("source").orderBy(F.desc("bucket")).rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(F.col("source").alias("_s"), F.col("bucket").alias("_b"), F.coalesce(F.sum("all_due").over(before), F.lit(0)).alias("ahead"))
    inside = Window.partitionBy("source", "bucket").orderBy(F.desc("size")).rowsBetween(Window.unboundedPreceding, 0)
    c = c.join(sums, F.col("source").eqNullSafe(F.col("_s")) & (F.col("bucket") == F.col("_b"))).drop("_s", "_b")
    c = c.withColumn("upto", F.col("ahead") + F.sum("due").over(inside))
    c = c.withColumn("copies", F.expr(f"(upto + {unit // 2}) div {unit} - (upto - due + {unit // 2}) div {unit}"))
    c = stored(c.select("source", "size", "n", "rate", "copies"), "mix-copies")

    missing = c.groupBy("source").agg(F.sum(F.round((F.col("n") * F.col("rate") - F.col("copies")) * F.col("size") * unit).cast("decimal(38,0)")).alias("missing"))
    chosen = c.groupBy("source", F.floor(F.log2("size")).alias("doubling"), F.pmod(F.xxhash64("size"), F.lit(CORRECTED)).alias("k")).agg(F.min(F.struct("size", "n", "copies")).alias("c"))
    listed = chosen.groupBy("source").agg(F.sort_array(F.collect_list("c"), asc=False).alias("cells")).select(F.col("source").alias("_s"), "cells")
    step = f"""
        aggregate(cells, struct(cast(missing as double) / {unit} as left, cast(array() as array<struct<size:bigint,more:bigint>>) as out),
          (acc, c) -> transform(array(cast(least(greatest(if(abs(acc.left) < c.size, round(acc.left / c.size), floor(abs(acc.left) / c.size) * sign(acc.left)), -c.copies), {cap} * c.n - c.copies) as bigint)), k ->
            struct(acc.left - k * c.size as left, concat(acc.out, array(struct(c.size as size, k as more))) as out))[0],
          acc -> acc.out)
    """
    fixed = missing.join(listed, F.col("source").eqNullSafe(F.col("_s"))).select("source", F.explode(F.expr(step)).alias("m"))
    fixed = fixed.select(F.col("source").alias("_s"), F.col("m.size").alias("_z"), F.col("m.more").alias("more")).where("more <> 0")
    out = c.join(fixed, F.col("source").eqNullSafe(F.col("_s")) & (F.col("size") == F.col("_z")), "left")
    return out.select("source", "size", "n", (F.col("copies") + F.coalesce("more", F.lit(0))).alias("copies"))


def mix_sources(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = (5, 2, 1), cap: int = 3, salts: int = 256, extra: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, source, size, source_size, target, copies, taken, off_target (and extra columns) for every row.

    off_target: the solver's rates for the row's source miss its target by more than a thousandth, which happens if it
    was stopped early. Sources without words are never off theirs.

    Size is the number of words (runs of other characters than \\x20 and \\x09-\\x0D); a null text has none. A
    null source is a source of its own, after all others. Rows without words are taken 0 times. Copies are
    whole: a document is taken 0 to cap times. Within (source, size), a hash of the id and the id decide who
    gets a copy more, so reruns agree; rows that repeat an id are rows of their own, and null ids share one
    hash. Other columns are not read. An empty table gives an empty result.

    The texts are read for their sizes only. All solving works on counts by (source, size), combined before
    the shuffle. Ranks inside (source, size) are dealt over `salts` tasks, so that a source, or copies of one
    text, may hold any share of the rows.
    """
    size = F.size(F.array_remove(F.split(F.coalesce(F.col(text_col), F.lit("")), r"[\x20\x09-\x0D]+"), "")).cast("long")
    rows = stored(docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), size.alias("size"), *extra), "mix-sizes")
    hist = stored(rows.groupBy("source", "size").agg(F.count(F.lit(1)).alias("n")), "mix-hist")
    targets = stored(source_targets(hist, weights, cap), "mix-targets")
    solved = stored(solve_rates(hist.where("size > 0"), targets.where("source_size > 0"), cap), "mix-rates")
    same = F.col("source").eqNullSafe(F.col("_s"))
    x = F.col("size") / F.col("mean")
    cells = hist.where("size > 0").join(solved.select(F.col("source").alias("_s"), "mean", "lam"), same).select("source", "size", "n", _rate(x, F.col("lam"), cap).alias("rate"))
    copies = _copies(cells, cap)

    # A cell's copies: each row gets the quotient; the remainder is dealt over the salts in proportion, then by rank.
    salted = rows.where("size > 0").withColumn("_salt", F.pmod(F.xxhash64("doc_id"), F.lit(salts)).cast("int"))
    parts = salted.groupBy("source", "size", "_salt").agg(F.count(F.lit(1)).alias("m"))
    up_to = Window.partitionBy("source", "size").orderBy("_salt")
    parts = parts.withColumns({"upto": F.sum("m").over(up_to), "n": F.sum("m").over(Window.partitionBy("source", "size"))})
    c = copies.select(F.col("source").alias("_s"), F.col("size").alias("_z"), "copies")
    parts = parts.join(c, F.col("source").eqNullSafe(F.col("_s")) & (F.col("size") == F.col("_z")))
    parts = parts.select("source", "size", "_salt", F.expr("copies div n").alias("base"), (F.expr("((copies % n) * upto) div n") - F.expr("((copies % n) * (upto - m)) div n")).alias("more"))
    parts = stored(parts, "mix-parts").select(F.col("source").alias("_s"), F.col("size").alias("_z"), F.col("_salt").alias("_t"), "base", "more")
    dealt = salted.join(parts, F.col("source").eqNullSafe(F.col("_s")) & (F.col("size") == F.col("_z")) & (F.col("_salt") == F.col("_t")), "left").drop("_s", "_z", "_t")
    rank = F.row_number().over(Window.partitionBy("source", "size", "_salt").orderBy(F.xxhash64("doc_id", F.lit(7)), "doc_id", *extra))
    taken = dealt.withColumn("copies", F.coalesce(F.col("base"), F.lit(0)) + F.when(rank <= F.col("more"), 1).otherwise(0)).select("doc_id", "source", "size", "copies", *extra)
    every = taken.unionByName(rows.where("size = 0").select("doc_id", "source", "size", F.lit(0).cast("long").alias("copies"), *extra))
    t = targets.select(F.col("source").alias("_s"), "source_size", "target")
    t = t.join(solved.select(F.col("source").alias("_r"), "off_target"), F.col("_s").eqNullSafe(F.col("_r")), "left").drop("_r")
    out = every.join(t, F.col("source").eqNullSafe(F.col("_s")), "left").drop("_s")
    return out.select("doc_id", "source", "size", F.col("source_size").cast("long").alias("source_size"), "target", F.col("copies").cast("long").alias("copies"), (F.col("copies") * F.col("size")).cast("long").alias("taken"), F.coalesce("off_target", F.lit(False)).alias("off_target"), *extra)
