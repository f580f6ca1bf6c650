"""Records, lookups and controls around an evaluation: filters, fallbacks, assertions, assignments."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.vocabulary import MUSCLES
from .ranking import hash_order, next_key  # noqa: F401

_NO_NAMES = "cast(array() as array<string>)"


def record_filter(records: DataFrame, exclude: Sequence[str] = (), variants: Sequence[int] | None = None, faithful_only: bool = False) -> DataFrame:
    """Records of other scenarios than the excluded ones, of the wanted variants, and, if asked, with faithful texts.

    A record without a variant is variant 0; one that doesn't say is faithful; one without a scenario is not excluded.
    """
    keep = F.lit(True)
    if exclude:
        keep = keep & ~F.coalesce(F.col("scenario").isin(*exclude), F.lit(False))
    if variants is not None:
        keep = keep & F.coalesce("variant", F.lit(0)).isin(*variants)
    if faithful_only:
        keep = keep & F.coalesce("nat_all_faithful", F.lit(True))
    return records.where(keep)


def named_anchors(centers: DataFrame) -> DataFrame:
    """Anchors with a phonetic name that are not functional."""
    ipa, category = F.trim(F.coalesce("ipa", F.lit(""))), F.trim(F.coalesce("category", F.lit("")))
    return centers.where(~ipa.isin("", "-") & (category != "functional"))


def reference_answer(items: DataFrame) -> Column:
    """The answer to show beside a prediction: the given one, the gold's text, or what the family's gold says.

    Reads reference_answer, gold_text, family, gold_muscles, gold_value, gold_kind, gold_inc, gold_dec,
    gold_directions (map of arrays) and should_abstain; '' where nothing is known.
    """
    c = F.col
    said = lambda x: F.when(F.trim(F.coalesce(x, F.lit(""))) != "", x)
    listed = lambda a: F.when(F.size(F.coalesce(a, F.expr(_NO_NAMES))) > 0, F.array_join(a, ", ")).otherwise("-")
    some = lambda a: F.coalesce(F.size(a), F.lit(0)) > 0
    corrects = (F.coalesce(c("gold_kind"), F.lit("")) == "correction") | some(c("gold_inc")) | some(c("gold_dec"))
    parts = F.transform(F.array_sort(F.map_entries("gold_directions")), lambda e: F.concat(e["key"], F.lit("="), F.array_join(e["value"], "+")))
    direction = F.when(corrects, F.concat(F.lit("↑ "), listed(c("gold_inc")), F.lit("; ↓ "), listed(c("gold_dec")))).when(F.coalesce(F.size("gold_directions"), F.lit(0)) > 0, F.array_join(parts, "; "))
    by_family = (
        F.when(c("family") == "muscle_set", F.array_join(F.coalesce("gold_muscles", F.expr(_NO_NAMES)), ", "))
        .when((c("family") == "value") & c("gold_value").isNotNull(), c("gold_value").cast("string"))
        .when(c("family") == "direction", direction)
    )
    given = F.when(F.coalesce("reference_answer", F.lit("")) != "", c("reference_answer"))
    return F.coalesce(given, said(c("gold_text")), by_family, F.when(c("should_abstain"), "ABSTAIN"), F.lit(""))


def nearest_grid(curve: DataFrame, grid: str, value: str, at: float, groups: Sequence[str] = ()) -> DataFrame:
    """The value at the grid point nearest to a place; of two equally near the smaller one."""
    return curve.groupBy(*groups).agg(F.min_by(F.struct(F.col(grid), F.col(value)), F.struct(F.abs(F.col(grid) - at), F.col(grid))).alias("_p")).select(*groups, f"_p.{grid}", f"_p.{value}")


def unequal_sets(a: DataFrame, b: DataFrame, key: str, items: str) -> DataFrame:
    """Keys in both tables whose arrays differ as sets, with both of them sorted."""
    one = a.select(key, F.array_sort(F.array_distinct(items)).alias("_a"))
    two = b.select(key, F.array_sort(F.array_distinct(items)).alias("_b"))
    return one.join(two, key).where(~F.col("_a").eqNullSafe(F.col("_b"))).select(key, F.col("_a").alias("left"), F.col("_b").alias("right"))


def require_equal_sets(a: DataFrame, b: DataFrame, key: str, items: str) -> None:
    """An error that names some of the keys whose sets differ."""
    bad = unequal_sets(a, b, key, items).orderBy(key).head(3)
    if bad:
        raise ValueError(f"gold differs: {[tuple(r) for r in bad]}")


def of_families(items: DataFrame, *families: str) -> DataFrame:
    return items.where(F.col("family").isin(*families))


def largest_total(rows: DataFrame, key: str, values: Sequence[str]) -> DataFrame:
    """The row whose values have the largest sum, the smallest key among equals, with that sum."""
    total = sum((F.col(v) for v in values[1:]), F.col(values[0]))
    best = rows.select(key, total.alias("total")).agg(F.max_by(F.struct(key, "total"), F.struct("total", (-F.col(key)).alias("k"))).alias("_b"))
    return best.select("_b.*")


def file_stride(df: DataFrame, file: str, stride: int, first: int = 0) -> DataFrame:
    """Rows of every stride-th file in name order, from the first; the table of files is small."""
    files = df.select(F.col(file).alias("_f")).distinct().withColumn("_r", F.row_number().over(Window.orderBy("_f")) - 1)
    return df.join(F.broadcast(files.where(F.col("_r") % stride == first).select("_f")), F.col(file) == F.col("_f"), "left_semi")


def assign_unused(n: int, pool: DataFrame, used: DataFrame, key: str, skip: int = 0) -> DataFrame:
    """k from 0 to n - 1, each with a key that is not used: the unused ones in hash order, again from the start when they run out.

    skip leaves out the first ones, unless that leaves none. Only the first n + skip ones are ordered.
    """
    free = pool.select(key).join(used.select(key), key, "left_anti")
    many = free.count()
    begin = skip if many > skip else 0
    if not many:
        return pool.sparkSession.createDataFrame([], f"k int, {key} {pool.schema[key].dataType.simpleString()}")
    head = free.orderBy(hash_order(key), key).limit(n + begin).withColumn("_p", F.row_number().over(Window.orderBy(hash_order(key), key)) - 1 - begin).where("_p >= 0")
    slots = pool.sparkSession.range(n).select(F.col("id").cast("int").alias("k"), (F.col("id") % (many - begin)).cast("int").alias("_p"))
    return slots.join(F.broadcast(head), "_p").select("k", key)


# Activations


def activations(df: DataFrame, ids: DataFrame | None = None, names: Sequence[str] = MUSCLES) -> DataFrame:
    """index and act, an array in the order of the names; missing values are 0, and so are all of an id without a row."""
    act = F.array(*[F.coalesce(F.col(m).cast("double"), F.lit(0.0)) for m in names])
    rows = df.select("index", act.alias("act"))
    if ids is None:
        return rows
    zeros = F.array(*[F.lit(0.0)] * len(names))
    return ids.select("index").join(rows, "index", "left").withColumn("act", F.coalesce("act", zeros))


def row_facts(pool: DataFrame) -> DataFrame:
    """index, section, effort (the level that the detail names, or null) and n_active (0 if unknown)."""
    level = F.regexp_extract(F.coalesce("detail", F.lit("")), r"@([0-9.]+)", 1).try_cast("double")
    return pool.select("index", "section", level.alias("effort"), F.coalesce("n_active", F.lit(0)).cast("int").alias("n_active"))


def lookup(df: DataFrame, key: str, value: int) -> DataFrame:
    """The rows of one id; the filter reaches the scan."""
    return df.where(F.col(key) == value)


def mesh_control(displacement: DataFrame, mode: str, seed: int = 0) -> DataFrame:
    """Displacements replaced by a control: 'rest' are zeros, 'noise' is Gaussian with each mesh's root mean square.

    Rows are index, vertex, dx, dy, dz. Random numbers are hashes of the seed, index, vertex and axis.
    """
    axes = ("dx", "dy", "dz")
    if mode == "rest":
        return displacement.withColumns({a: F.lit(0.0) for a in axes})
    if mode != "noise":
        raise ValueError(f"no control {mode}")
    squares = sum((F.col(a) * F.col(a) for a in axes[1:]), F.col(axes[0]) * F.col(axes[0]))
    size = displacement.groupBy("index").agg(F.sqrt(F.avg(squares / len(axes))).alias("_rms"))

    def normal(use: int) -> Column:
        unit = lambda k: (F.pmod(F.xxhash64(F.lit(seed), "index", "vertex", F.lit(use + k)), F.lit(1 << 52)) + 0.5) / float(1 << 52)
        return F.sqrt(-2 * F.ln(unit(0))) * F.cos(unit(1) * 6.283185307179586)

    return displacement.join(size, "index").withColumns({a: normal(2 * i) * F.col("_rms") for i, a in enumerate(axes)}).drop("_rms")


# Chats


def chat(turns: Column, before: str = "<|im_start|>{role}\n", after: str = "<|im_end|>\n") -> Column:
    """struct(text, spans) of an array of (role, value): the rendered chat, and where the assistants' values stand in it, half open."""
    head, _, tail = before.partition("{role}")
    piece = lambda t: F.concat(F.lit(head), t["role"], F.lit(tail), t["value"], F.lit(after))
    parts = F.transform(turns, piece)
    width = F.transform(parts, lambda p: F.length(p))
    starts = F.transform(turns, lambda t, i: F.aggregate(F.slice(width, F.lit(1), i), F.lit(0), lambda s, n: s + n) + len(head) + len(tail) + F.length(t["role"]))
    own = F.transform(F.arrays_zip(turns.alias("t"), starts.alias("s")), lambda z: F.struct(z["t"]["role"].alias("role"), z["s"].alias("start"), (z["s"] + F.length(z["t"]["value"])).alias("end")))
    spans = F.transform(F.filter(own, lambda o: o["role"] == "assistant"), lambda o: F.struct(o["start"].alias("start"), o["end"].alias("end")))
    return F.struct(F.concat_ws("", parts).alias("text"), spans.alias("spans"))


def with_slot(turns: Column, token: str, n: int) -> Column:
    """The (role, value) turns with n placeholder tokens before the last user's value; without a user as they are."""
    last = F.aggregate(F.transform(turns, lambda t, i: F.when(t["role"] == "user", i).otherwise(-1)), F.lit(-1), lambda a, b: F.greatest(a, b))
    return F.transform(turns, lambda t, i: F.struct(t["role"].alias("role"), F.when(i == last, F.concat(F.lit(token * n), t["value"])).otherwise(t["value"]).alias("value")))


def located(text: Column, turns: Column) -> Column:
    """array of (start, end): the assistants' values in a rendered chat, each looked for behind the turn before it.

    A template may put text of its own anywhere; a value that it changed is not found and is left out.
    """
    kind = "array<struct<start: int, end: int>>"
    begin = F.struct(F.lit(0).alias("cursor"), F.lit(None).cast(kind).alias("found"))

    def step(s: Column, t: Column) -> Column:
        at = F.when(F.length(t["value"]) == 0, s["cursor"]).otherwise(F.position(t["value"], text, s["cursor"] + 1) - 1)
        end = at + F.length(t["value"])
        own = F.when((at >= 0) & (t["role"] == "assistant"), F.array(F.struct(at.alias("start"), end.alias("end")))).otherwise(F.array().cast(kind))
        return F.struct(F.when(at < 0, s["cursor"]).otherwise(end).alias("cursor"), F.concat(F.coalesce(s["found"], F.array().cast(kind)), own).alias("found"))

    return F.aggregate(turns, begin, step, lambda s: F.coalesce(s["found"], F.array().cast(kind)))


def facts_in_chat(text: Column, places: Column, facts: Column, kinds: Sequence[str]) -> Column:
    """For each assistant's place the (start, end) in the chat of its facts (type, value, start, end within the value).

    Only facts of the given types count whose text stands where they say; places beyond the last list of facts have none.
    """

    def of(place: Column, i: Column) -> Column:
        moved = F.transform(F.coalesce(F.get(facts, i), F.slice(F.get(facts, F.lit(0)), 1, 0)), lambda f: F.struct(f["type"].alias("type"), f["value"].alias("value"), (place["start"] + f["start"]).alias("start"), (place["start"] + f["end"]).alias("end")))
        good = F.filter(moved, lambda f: f["type"].isin(*kinds) & (f["end"] > f["start"]) & (f["end"] <= F.length(text)) & (F.substring(text, f["start"] + 1, f["end"] - f["start"]) == f["value"]))
        return F.transform(good, lambda f: F.struct(f["start"].alias("start"), f["end"].alias("end")))

    return F.transform(places, of)


def slot_start(tokens: Column, token: int, n: int) -> Column:
    """Where n equal tokens first stand one after the other, from 0; -1 if nowhere."""
    begin = F.struct(F.lit(0).alias("run"), F.lit(-1).alias("found"), F.lit(0).alias("at"))

    def step(s: Column, t: Column) -> Column:
        run = F.when(t == token, s["run"] + 1).otherwise(0)
        found = F.when((s["found"] < 0) & (run == n), s["at"] - n + 1).otherwise(s["found"])
        return F.struct(run.alias("run"), found.alias("found"), (s["at"] + 1).alias("at"))

    return F.aggregate(tokens, begin, step, lambda s: s["found"])
