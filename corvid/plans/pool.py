"""Activation pools: enumerated parts, random fills by section, first-wins dedup and renumbered bases.

Random numbers are hashes of (seed, row, use), so a pool is the same whatever the number of partitions; it has
the sections, shares, limits and steps of the format, not another generator's sequence.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import fixed
from ..functions.vocabulary import MUSCLES
from ..operators.index import keep_first, remap
from ..operators.ranking import dense_number
from .qa import clip_budget, enumerated_pool

# Fixed values of the format: shares of the random sections, limits and the neighbours' step.
SHARES = {"anchor": 0.35, "neighbor": 0.20, "effort": 0.15, "spacefill": 0.30}
LARGEST, BUDGET, STEP, ACTIVE = 0.9, 2.0, 0.15, 0.05
N = len(MUSCLES)


def uniform(seed: int, row: Column, use: Column | int) -> Column:
    """A number in [0, 1) from a hash."""
    return F.pmod(F.xxhash64(F.lit(seed), row, use if isinstance(use, Column) else F.lit(use)), F.lit(1 << 52)) / float(1 << 52)


def normal(seed: int, row: Column, use: Column) -> Column:
    a, b = uniform(seed, row, use * 2 + 1000), uniform(seed, row, use * 2 + 1001)
    return F.sqrt(-2 * F.ln(1 - a)) * F.cos(b * 6.283185307179586)


def center_vector(rules: Mapping[str, tuple[float, float]]) -> list[float]:
    """The middle of each muscle's band, 0 for muscles without one."""
    return [sum(rules[m]) / 2 if m in rules else 0.0 for m in MUSCLES]


def interpolated_centers(centers: DataFrame, order: str, parts: tuple[float, ...] = (0.25, 0.5, 0.75)) -> DataFrame:
    """phoneme, detail and act on the way between each pair of centres (phoneme, act), the first one by order; a small table."""
    a, b = (centers.select(*[F.col(c).alias(f"{c}_{side}") for c in ("phoneme", "act", order)]) for side in ("a", "b"))
    both = a.join(F.broadcast(b), F.col(f"{order}_a") < F.col(f"{order}_b")).withColumn("t", F.explode(F.array(*map(F.lit, parts))))
    act = F.zip_with("act_a", "act_b", lambda x, y: (1 - F.col("t")) * x + F.col("t") * y)
    name = F.concat_ws("~", "phoneme_a", "phoneme_b")
    return both.select(name.alias("phoneme"), F.concat(F.lit("interp:"), name, F.lit("@"), fixed(F.col("t"), 2)).alias("detail"), act.alias("act"))


def meets(act: Column, rule: Mapping[str, tuple[float, float]], slack: float = 1e-6) -> Column:
    """Whether every muscle of a rule lies in its band."""
    out = F.lit(True)
    for m, (low, high) in rule.items():
        out = out & F.get(act, MUSCLES.index(m)).between(low - slack, high + slack)
    return out


def consonant_draws(ids: DataFrame, rule: Mapping[str, tuple[float, float]], tries: int, seed: int = 0, budget: float = 1.6) -> DataFrame:
    """id, draw and act: `tries` draws for each id.

    The rule's muscles are drawn from their bands, MH is low in half of the draws, others are low in a third. Beyond
    the budget the others give way, so that the rule's muscles stay where they are.
    """
    i = F.xxhash64("id", "draw")
    d = ids.select("id", F.explode(F.sequence(F.lit(1), F.lit(tries))).alias("draw"))
    value = lambda m, k: F.lit(rule[m][0]) + uniform(seed, i, 500 + k) * (rule[m][1] - rule[m][0]) if m in rule else F.when(uniform(seed, i, 600 + k) < (0.5 if m == "MH" else 0.35), uniform(seed, i, 700 + k) * (0.25 if m == "MH" else 0.15)).otherwise(0.0)
    d = d.withColumn("raw", F.array(*[F.least(value(m, k), F.lit(LARGEST)) for k, m in enumerate(MUSCLES)]))
    free = [k for k, m in enumerate(MUSCLES) if m not in rule and m != "MH"]
    total = lambda ks: sum((F.get("raw", k) for k in ks[1:]), F.get("raw", ks[0])) if ks else F.lit(0.0)
    d = d.withColumns({"over": F.greatest(total(list(range(N))) - budget, F.lit(0.0)), "loose": total(free)})
    left = F.when(F.col("loose") > 0, F.greatest(1 - F.col("over") / F.col("loose"), F.lit(0.0))).otherwise(1.0)
    return d.select("id", "draw", F.array(*[F.bround(F.get("raw", k) * left if k in free else F.get("raw", k), 4) for k in range(N)]).alias("act"))


def accepted_draws(draws: DataFrame, rule: Mapping[str, tuple[float, float]]) -> DataFrame:
    """id, draw and act of the first draw of each id that meets the rule."""
    first = draws.where(meets(F.col("act"), rule)).groupBy("id").agg(F.min("draw").alias("draw"), F.min_by("act", "draw").alias("act"))
    return first


def _each(f) -> Column:
    return F.transform(F.sequence(F.lit(0), F.lit(N - 1)), f)


def random_sections(spark: SparkSession, centers: DataFrame, total: int, seed: int = 0) -> DataFrame:
    """build, section, detail, base, act: `total` random rows by SHARES; centers has phoneme, act and sigma.

    anchor: a centre with Gaussian noise. neighbor: the anchor row of the same rank, one muscle a step up or
    down, within the limits. effort: two muscles at a common level. spacefill: one to four random muscles.
    """
    counts = {k: int(total * v) for k, v in SHARES.items()}
    counts["spacefill"] += total - sum(counts.values())
    c = centers.agg(F.array_sort(F.collect_list(F.struct("phoneme", "act", "sigma"))).alias("all"))
    i = F.col("id")
    starts, at = {}, 0
    for k in SHARES:
        starts[k], at = at, at + counts[k]

    anchor = spark.range(counts["anchor"]).crossJoin(F.broadcast(c)).select("id", F.get("all", F.floor(uniform(seed, i, 1) * F.size("all")).cast("int")).alias("c"))
    anchor = anchor.select((i + starts["anchor"]).alias("build"), F.lit("anchor").alias("section"), F.concat(F.lit("anchor:"), "c.phoneme").alias("detail"), F.lit(-1).cast("long").alias("base"), clip_budget(_each(lambda k: F.get("c.act", k) + F.col("c.sigma") * normal(seed, i, k)), BUDGET, LARGEST).alias("act"))

    m = F.floor(uniform(seed, i, 2) * N).cast("int")
    up = uniform(seed, i, 3) < 0.5
    names = F.array(*map(F.lit, MUSCLES))
    moved = spark.range(counts["neighbor"]).withColumn("base", F.pmod(i, F.lit(max(1, counts["anchor"]))) + starts["anchor"]).join(anchor.select(F.col("build").alias("base"), "act"), "base")
    change = F.when(up, STEP).otherwise(-STEP)
    neighbor = moved.select((i + starts["neighbor"]).alias("build"), F.lit("neighbor").alias("section"), F.concat(F.lit("d"), F.get(names, m), F.when(up, "+1").otherwise("-1")).alias("detail"), "base", clip_budget(_each(lambda k: F.get("act", k) + F.when(k == m, change).otherwise(0.0)), BUDGET, LARGEST).alias("act"))

    a, gap = F.floor(uniform(seed, i, 4) * N).cast("int"), 1 + F.floor(uniform(seed, i, 5) * (N - 1)).cast("int")
    b, level = (a + gap) % N, F.bround(0.1 + uniform(seed, i, 6) * 0.8, 2)
    effort = spark.range(counts["effort"]).select((i + starts["effort"]).alias("build"), F.lit("effort").alias("section"), F.concat(F.lit("effort:"), F.get(names, a), F.lit("+"), F.get(names, b), F.lit("@"), fixed(level, 2)).alias("detail"), F.lit(-1).cast("long").alias("base"), _each(lambda k: F.when((k == a) | (k == b), level).otherwise(0.0)).alias("act"))

    few = 1 + F.floor(uniform(seed, i, 7) * 4)
    chosen = lambda k: uniform(seed, i, k + 200) < few / N
    fill = spark.range(counts["spacefill"]).select((i + starts["spacefill"]).alias("build"), F.lit("spacefill").alias("section"), F.lit("spacefill").alias("detail"), F.lit(-1).cast("long").alias("base"), clip_budget(_each(lambda k: F.when(chosen(k), uniform(seed, i, k + 100) * LARGEST).otherwise(0.0)), BUDGET, LARGEST).alias("act"))
    return anchor.unionByName(neighbor).unionByName(effort).unionByName(fill)


def triples(spark: SparkSession, n: int, seed: int = 0) -> DataFrame:
    """build, section, detail, base, act: n rows with three different muscles at random levels."""
    i = F.col("id")
    order = F.array_sort(_each(lambda k: F.struct(uniform(seed, i, k + 300).alias("u"), k.alias("k"))))
    three = F.array_sort(F.transform(F.slice(order, 1, 3), lambda x: x["k"]))
    names = F.array(*map(F.lit, MUSCLES))
    d = spark.range(n).withColumn("three", three)
    level = lambda k: F.bround(0.15 + uniform(seed, i, k + 400) * 0.75, 4)
    act = clip_budget(_each(lambda k: F.when(F.array_contains("three", k), level(k)).otherwise(0.0)), BUDGET, LARGEST)
    return d.select(i.alias("build"), F.lit("triple").alias("section"), F.array_join(F.transform("three", lambda k: F.get(names, k)), "+").alias("detail"), F.lit(-1).cast("long").alias("base"), act.alias("act"))


def build_pool(spark: SparkSession, centers: DataFrame, total: int, seed: int = 0, n_triples: int = 3000) -> DataFrame:
    """index, section, detail, base_index, n_active and activations: rest first, then all other rows in hash order.

    Rows with equal activations at 4 decimals keep the first one built; a base that went is -1.
    """
    parts = enumerated_pool(spark)
    order = F.struct(F.when(F.col("section") == "rest", 0).when(F.col("section") == "single", 1).otherwise(2).alias("s"), "detail", "act")
    fixed_part = parts.agg(F.array_sort(F.collect_list(F.struct(order.alias("o"), "section"))).alias("rows")).select(F.posexplode("rows").alias("build", "r"))
    fixed_part = fixed_part.select(F.col("build").cast("long").alias("build"), "r.section", F.col("r.o.detail").alias("detail"), F.lit(-1).cast("long").alias("base"), F.col("r.o.act").alias("act"))
    n_fixed = 1 + 6 * N + 9 * N * (N - 1) // 2
    combos = triples(spark, n_triples, seed).withColumn("build", F.col("build") + n_fixed)
    before = n_fixed + n_triples
    random = random_sections(spark, centers, max(0, total - before), seed)
    random = random.withColumns({"build": F.col("build") + before, "base": F.when(F.col("base") >= 0, F.col("base") + before).otherwise(-1)})
    rows = fixed_part.unionByName(combos).unionByName(random).withColumn("key", F.transform("act", lambda x: F.round(x * 10_000).cast("long")))
    kept = keep_first(rows, ["key"], ["build"])
    place = F.when(F.col("section") == "rest", F.lit(-(1 << 62))).otherwise(F.expr(f"shiftright(xxhash64({seed}, build), 2)"))
    numbered = dense_number(kept.withColumn("_place", place), "_place", "index", 1 << 54)
    out = remap(numbered.withColumnRenamed("base", "base_index"), "base_index", numbered.select("build", "index"), "build", "index")
    n_active = F.size(F.filter("act", lambda x: x >= ACTIVE))
    return out.select("index", "section", "detail", "base_index", n_active.alias("n_active"), *[F.get("act", k).alias(m) for k, m in enumerate(MUSCLES)])
