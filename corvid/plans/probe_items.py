"""Probe items: five families of questions about sampled meshes, as one wide table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import value_text
from ..functions.vocabulary import MOVE_EPS_MM, MUSCLES
from ..operators.nearest import PivotIndex, nearest_join
from ..operators.probe import corrections_between, direction_labels, value_tolerance
from ..operators.ranking import balanced_sample, hash_order, quotas
from .evaluation import GOLD_EPS

#: The regions of a contour by thirds, in the order in which equal ones count.
FMB = ("front", "mid", "back")
NO_STRINGS = "cast(null as array<string>)"
GOLD = {"gold_muscles": NO_STRINGS, "gold_value": "cast(null as double)", "gold_text": "cast(null as string)", "unit": "cast(null as string)", "quantity": "cast(null as string)", "tol": "cast(null as double)", "gold_inc": NO_STRINGS, "gold_dec": NO_STRINGS}


def n_act_bin(n: Column) -> Column:
    return F.when(n <= 1, "1").when(n == 2, "2").otherwise("3+")


def _items(d: DataFrame, family: str, question: Column, leadin: str, abstain: bool = False, **gold: Column) -> DataFrame:
    columns = [gold[g].alias(g) if g in gold else F.expr(e).alias(g) for g, e in GOLD.items()]
    uid = F.concat_ws("-", F.lit(family), F.col("index").cast("string"))
    return d.select(uid.alias("uid"), F.lit(family).alias("family"), F.col("index").alias("mesh_index"), "n_act_bin", question.alias("question"), F.lit(leadin).alias("answer_leadin"), F.lit(abstain).alias("should_abstain"), *columns)


def _hash_of(*parts: Column) -> Column:
    return F.md5(F.concat_ws(":", *[p.cast("string") for p in parts]))


def _number_of(*parts: Column) -> Column:
    """The first 32 bits of the hash."""
    return F.conv(F.substring(_hash_of(*parts), 1, 8), 16, 10).cast("long")


def trainlike_values(features: DataFrame, motion: DataFrame, share: float = 0.7) -> DataFrame:
    """index, quantity, value: one of the candidates of each mesh, a feature for the share of those that have both kinds.

    Both tables have index, quantity, value; the choices are hashes of the mesh and the quantity.
    """
    both = features.select("index", "quantity", "value", F.lit(True).alias("_f")).unionByName(motion.select("index", "quantity", "value", F.lit(False).alias("_f")))
    best = both.groupBy("index", "_f").agg(F.min_by(F.struct("quantity", "value"), _hash_of(F.col("index"), F.col("quantity"))).alias("_v"))
    kinds = best.groupBy("index").agg(F.max(F.when(F.col("_f"), F.col("_v"))).alias("_a"), F.max(F.when(~F.col("_f"), F.col("_v"))).alias("_b"))
    feature = F.col("_a").isNotNull() & (F.col("_b").isNull() | (_number_of(F.col("index"), F.lit("kind")) < share * (1 << 32)))
    return kinds.select("index", F.when(feature, F.col("_a")).otherwise(F.col("_b")).alias("_v")).select("index", "_v.quantity", "_v.value")


def first_acceptable(candidates: DataFrame, key: str, candidate: str, ok: str, most: int = 40) -> DataFrame:
    """Of each key's first `most` candidates in hash order the first that is acceptable; the limit is part of the search's definition."""
    order = Window.partitionBy(key).orderBy(_hash_of(F.col(key), F.col(candidate)), candidate)
    tried = candidates.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= most)
    return tried.where(F.col(ok)).groupBy(key).agg(F.min_by(candidate, "_r").alias(candidate))


def drawn_targets(meshes: DataFrame, n: int, useful: DataFrame, again: int = 5) -> DataFrame:
    """index and target: a number below n drawn by hash, and drawn again while (index, target) is not among the useful ones; the last draw stands."""
    draws = meshes.select("index", F.explode(F.sequence(F.lit(0), F.lit(again))).alias("_n"))
    draws = draws.withColumn("target", _number_of(F.col("index"), F.col("_n")) % n).join(useful.select("index", "target", F.lit(1).alias("_ok")).distinct(), ["index", "target"], "left")
    best = draws.groupBy("index").agg(F.min_by(F.when(F.col("_ok") == 1, F.col("target")), F.when(F.col("_ok") == 1, F.col("_n"))).alias("_t"), F.max_by("target", "_n").alias("_last"))
    return best.select("index", F.coalesce("_t", "_last").alias("target"))


def sample_meshes(pool: DataFrame, ids: DataFrame, total: int, prefer: Column | None = None, mode: str = "balanced") -> DataFrame:
    """Meshes of a split by number of active muscles: balanced over the bins, only 3+, or as they come."""
    act = F.array(*[F.col(m).cast("double") for m in MUSCLES])
    d = pool.join(ids.select("index"), "index", "left_semi").withColumn("act", act)
    d = d.withColumn("n_act_bin", n_act_bin(F.size(F.filter("act", lambda a: a > GOLD_EPS))))
    if mode == "natural":
        return d.orderBy(hash_order("index"), "index").limit(total)
    wanted = quotas(total, ["1", "2", "3+"]) if mode == "balanced" else {"3+": total}
    return balanced_sample(d, "n_act_bin", wanted, F.lit(False) if prefer is None else prefer, "index")


def build_items(meshes: DataFrame, values: DataFrame, targets: DataFrame, questions: dict[str, str], abstentions: Sequence[str]) -> DataFrame:
    """Items of all families: muscle sets, one value, a correction towards a target, an unanswerable question, a description.

    values: index, quantity, unit, value; of several a hash picks one. targets: ipa and goal (activations); a hash
    of the mesh picks one too. questions: a text for each family, with {quantity} and {target} where they belong.
    """
    pick = lambda n: F.pmod(F.xxhash64("index", F.lit(n)), F.lit(1 << 30))
    muscles = F.filter(F.transform("act", lambda a, i: F.when(a > GOLD_EPS, F.get(F.array(*map(F.lit, MUSCLES)), i))), lambda x: x.isNotNull())
    out = _items(meshes, "muscle_set", F.lit(questions["muscle_set"]), "The active muscles are", gold_muscles=muscles)

    one = values.groupBy("index").agg(F.min_by(F.struct("quantity", "unit", "value"), F.xxhash64("index", "quantity")).alias("v"))
    v = meshes.join(one, "index")
    asked = F.replace(F.lit(questions["value"]), F.lit("{quantity}"), F.col("v.quantity"))
    tol = value_tolerance(F.lit(None).cast("double"), F.lit(None).cast("double"), F.col("v.quantity"), F.col("v.unit"))
    out = out.unionByName(_items(v, "value", asked, "The value is", gold_value=F.col("v.value"), gold_text=value_text(F.col("v.value")), unit=F.col("v.unit"), quantity=F.col("v.quantity"), tol=tol))

    all_targets = targets.agg(F.array_sort(F.collect_list(F.struct("ipa", "goal"))).alias("all"))
    t = meshes.crossJoin(F.broadcast(all_targets)).withColumn("t", F.get("all", (pick(1) % F.size("all")).cast("int")))
    more, less = corrections_between(F.col("act"), F.col("t.goal"))
    t = t.withColumns({"more": more, "less": less}).where(F.size("more") + F.size("less") > 0)
    said = F.concat_ws("; ", F.when(F.size("more") > 0, F.concat(F.lit("contract more: "), F.array_join("more", ", "))), F.when(F.size("less") > 0, F.concat(F.lit("relax: "), F.array_join("less", ", "))))
    asked = F.replace(F.lit(questions["direction"]), F.lit("{target}"), F.col("t.ipa"))
    out = out.unionByName(_items(t, "direction", asked, "To get there", gold_inc=F.col("more"), gold_dec=F.col("less"), gold_text=said))

    q = F.element_at(F.array(*map(F.lit, abstentions)), (pick(2) % len(abstentions)).cast("int") + 1)
    out = out.unionByName(_items(meshes, "abstention", q, "", True))
    return out.unionByName(_items(meshes, "utility", F.lit(questions["utility"]), ""))


#: The changes of one muscle that are tried, and how many of them at most.
EDITS, TRIES = (0.15, -0.15, 0.10, -0.10), 40


def motion_between(base: Column, other: Column, eps: float = MOVE_EPS_MM) -> Column:
    """The region that moves most from one struct of front, mid and back (dx, dz in mm) to another, its directions and motion.

    struct(region, directions, dx, dz); null where either is unknown. Of equal motions the first region counts.
    """
    moves = []
    for r in FMB:
        dx, dz = other[r]["dx"] - base[r]["dx"], other[r]["dz"] - base[r]["dz"]
        moves.append(F.struct(F.sqrt(dx * dx + dz * dz).alias("mag"), F.lit(-len(moves)).alias("place"), F.lit(r).alias("region"), direction_labels(dx, dz, eps).alias("directions"), F.bround(dx, 2).alias("dx"), F.bround(dz, 2).alias("dz")))
    top = F.array_max(F.array(*[F.struct(m["mag"].alias("mag"), m["place"].alias("place"), m["region"].alias("region"), m["directions"].alias("directions"), m["dx"].alias("dx"), m["dz"].alias("dz")) for m in moves]))
    known = base.isNotNull() & other.isNotNull()
    return F.when(known, F.struct(top["region"].alias("region"), top["directions"].alias("directions"), top["dx"].alias("dx"), top["dz"].alias("dz")))


def interventions(meshes: DataFrame, pool: DataFrame, motion: DataFrame, edits: Sequence[float] = EDITS, most: int = TRIES) -> DataFrame:
    """index, muscle, delta, base_mesh, region, directions, dx, dz: for each mesh the first edit of one muscle that moves a region.

    meshes and pool have index and act (activations); motion has index and region_mm, a struct of front, mid and back with
    dx and dz. Edits stay within 0 and 1, come in hash order, and only the first `most` are tried. The mesh nearest to
    an edit, but for the edited one itself, stands for it; an edit is taken if that mesh's dominant region moves.
    """
    size = len(MUSCLES)
    steps = F.array(*[F.struct(F.lit(m).alias("m"), F.lit(float(d)).alias("delta")) for m in range(size) for d in edits])
    tried = meshes.select("index", "act", F.explode(steps).alias("e")).withColumn("to", F.get("act", F.col("e.m")) + F.col("e.delta"))
    tried = tried.where("to >= -1e-6 and to <= 1 + 1e-6")
    names = F.array(*map(F.lit, MUSCLES))
    tried = tried.select("index", F.get(names, F.col("e.m")).alias("muscle"), F.col("e.delta").alias("delta"), F.transform("act", lambda a, i: F.when(i == F.col("e.m"), F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col("to")))).otherwise(a)).alias("target"))
    order = Window.partitionBy("index").orderBy(_hash_of(F.col("index"), F.col("muscle"), F.col("delta")), "muscle", "delta")
    tried = tried.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= most).withColumn("query", F.col("index") * (size * len(edits) + 1) + F.col("_r"))
    found = nearest_join(tried, PivotIndex(pool, "index", "act"), "query", "index", "target").select("query", F.col("nn_id").alias("base_mesh"))
    own = motion.select("index", F.col("region_mm").alias("_own"))
    other = motion.select(F.col("index").alias("base_mesh"), F.col("region_mm").alias("_other"))
    d = tried.drop("target").join(found, "query").join(own, "index").join(other, "base_mesh").withColumn("m", motion_between(F.col("_own"), F.col("_other")))
    good = d.where(F.col("m").isNotNull() & ~F.array_contains("m.directions", "preserve"))
    best = good.groupBy("index").agg(F.min_by(F.struct("muscle", "delta", "base_mesh", "m.region", "m.directions", "m.dx", "m.dz"), "_r").alias("b"))
    return best.select("index", "b.*")
