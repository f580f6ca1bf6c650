"""Facts of gold spans and of answers by category, their scores, and how often a number is boilerplate."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import vocabulary as V
from ..functions.text import NUMBERS_SCORED, numbers, pattern_label, prf
from .metrics import greedy_tolerance

CATEGORIES = ("muscle", "region", "movement", "number")
_NONE = "cast(array() as array<string>)"


def _concept_table(kind: str, lang: str) -> dict[str, list[str]]:
    if kind == "movement":
        return V.MOVEMENT_CONCEPTS[lang]
    return {s: [c] for s, c in V.REGION_CONCEPTS[lang].items()}


def _concepts_said(text: Column, table: dict[str, list[str]]) -> Column:
    found = [F.when(F.contains(text, F.lit(s)), F.array(*map(F.lit, c))) for s, c in table.items()]
    return F.array_sort(F.array_distinct(F.flatten(F.filter(F.array(*found), lambda x: x.isNotNull()))))


def _looked_up(surfaces: Column, table: Column) -> Column:
    known = F.filter(F.transform(surfaces, lambda v: F.try_element_at(table, v)), lambda x: x.isNotNull())
    return F.array_sort(F.array_distinct(F.flatten(known)))


def said_facts(text: Column, lang: str) -> dict[str, Column]:
    """Facts of an answer: full names and numbers as they stand, movements and regions as concepts."""
    names = F.array(*[F.when(F.contains(text, F.lit(n)), F.lit(n)) for n in V.FULL_NAMES[lang].values()])
    return {
        "muscle": F.filter(names, lambda x: x.isNotNull()),
        "region": _concepts_said(text, _concept_table("region", lang)),
        "movement": _concepts_said(text, _concept_table("movement", lang)),
        "number": F.array_distinct(numbers(text, NUMBERS_SCORED)),
    }


def gold_facts(spans: Column, lang: str) -> dict[str, Column]:
    """Facts of spans in the same form; surfaces without a concept contribute nothing."""
    values = lambda kind: F.transform(F.filter(F.coalesce(spans, F.expr("cast(array() as array<struct<type: string, value: string, start: int, end: int, role: string>>)")), lambda s: s["type"] == kind), lambda s: s["value"])
    out = {k: F.array_distinct(values(k)) for k in ("muscle", "number")}
    for kind in ("movement", "region"):
        table = F.create_map(*[x for s, c in _concept_table(kind, lang).items() for x in (F.lit(s), F.array(*map(F.lit, c)))])
        out[kind] = _looked_up(values(kind), table)
    return out


def untaggable(spans: Column, lang: str) -> Column:
    """Movement and region spans whose surface has no concept."""
    known = {kind: F.array(*map(F.lit, _concept_table(kind, lang))) for kind in ("movement", "region")}
    lost = lambda s: F.when(s["type"] == "movement", ~F.array_contains(known["movement"], s["value"])).when(s["type"] == "region", ~F.array_contains(known["region"], s["value"])).otherwise(False)
    return F.coalesce(F.size(F.filter(spans, lost)), F.lit(0))


def mask_f1(items: DataFrame, lang: str, boilerplate: DataFrame | None = None, rel: float = 0.02, floor: float = 0.01) -> DataFrame:
    """A row a category: tp, fp, fn and F1 of answers (pred) against gold_spans; null F1 where nothing was to be found.

    Categories: the four, micro over them, macro as the mean of those with facts, number_tol (greedy matches in
    tolerance), and with a boilerplate table (turn_type, value) also number_informative, without its numbers.
    """
    gold, said = gold_facts(F.col("gold_spans"), lang), said_facts(F.coalesce("pred", F.lit("")), lang)
    d = items.withColumn("_item", F.monotonically_increasing_id())
    per = F.array(*[F.struct(F.lit(c).alias("category"), gold[c].alias("g"), said[c].alias("p")) for c in CATEGORIES])
    long = d.select("_item", "turn_type", F.explode(per).alias("x")).select("_item", "turn_type", "x.*")
    if boilerplate is not None:
        dull = boilerplate.groupBy("turn_type").agg(F.collect_set("value").alias("dull"))
        num = long.where("category = 'number'").join(dull, "turn_type", "left").withColumn("dull", F.coalesce("dull", F.expr(_NONE)))
        long = long.unionByName(num.select("_item", "turn_type", F.lit("number_informative").alias("category"), F.array_except("g", "dull").alias("g"), F.array_except("p", "dull").alias("p")))
    n = lambda a: F.sum(F.size(a)).cast("long")
    sums = long.groupBy("category").agg(n(F.array_intersect("g", "p")).alias("tp"), n(F.array_except("p", "g")).alias("fp"), n(F.array_except("g", "p")).alias("fn"))
    as_numbers = lambda c: F.transform(c, lambda x: x.try_cast("double"))
    close = greedy_tolerance(long.where("category = 'number'").select("_item", as_numbers("g").alias("g"), as_numbers("p").alias("p")), "_item", "g", "p", rel, floor)
    sums = sums.unionByName(close.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("tp", "fp", "fn")]).select(F.lit("number_tol").alias("category"), "tp", "fp", "fn"))
    four = sums.where(F.col("category").isin(*CATEGORIES))
    micro = four.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("tp", "fp", "fn")]).select(F.lit("micro").alias("category"), "tp", "fp", "fn")
    f1 = F.when(F.col("tp") + F.col("fp") + F.col("fn") > 0, prf(F.col("tp"), F.col("fp"), F.col("fn"))[2])
    scored = sums.unionByName(micro).withColumn("f1", f1)
    macro = four.select(f1.alias("f1")).agg(F.avg("f1").alias("f1"))
    return scored.unionByName(macro.select(F.lit("macro").alias("category"), *[F.lit(None).cast("long").alias(c) for c in ("tp", "fp", "fn")], "f1"))


def number_df(records: DataFrame, train: DataFrame, least_share: float = 0.05, least_turns: int = 200, per_file: int = 1200) -> DataFrame:
    """turn_type, value, df: the share of a turn type's answers that hold a number, for numbers in least_share or more.

    records: file, line, variant, first_id, turn_types, conversations. Of each file the first per_file records of
    variant 0 whose first mesh is in train count; a number counts once an answer; turn types with fewer than
    least_turns answers are left out. The row limit is the table's definition, as its source states it.
    """
    own = records.where(F.coalesce("variant", F.lit(0)) == 0).join(train.select(F.col("index").alias("first_id")), "first_id", "left_semi")
    head = own.withColumn("_r", F.row_number().over(Window.partitionBy("file").orderBy("line"))).where(F.col("_r") <= per_file)
    answers = F.filter("conversations", lambda t: t["from"] == "gpt")
    turns = head.select("file", "line", "turn_types", F.posexplode(answers).alias("k", "t"))
    typed = turns.select("file", "line", "k", F.coalesce(F.get("turn_types", F.col("k")), F.lit("")).alias("turn_type"), F.array_distinct(F.transform(F.filter("t.mask_spans", lambda s: s["type"] == "number"), lambda s: s["value"])).alias("values"))
    totals = typed.groupBy("turn_type").agg(F.count(F.lit(1)).alias("n_turns")).where(F.col("n_turns") >= least_turns)
    hits = typed.select("turn_type", F.explode("values").alias("value")).groupBy("turn_type", "value").agg(F.count(F.lit(1)).alias("n"))
    return hits.join(F.broadcast(totals), "turn_type").select("turn_type", "value", (F.col("n") / F.col("n_turns")).alias("df")).where(F.col("df") >= least_share)


def trend(concepts: Column) -> Column:
    """The most specific trend among the concepts: reversal, then saturating, then monotonic; null without one."""
    out = F.lit(None).cast("string")
    for concept, label in reversed(V.TRENDS):
        out = F.when(F.array_contains(concepts, concept), F.lit(label)).otherwise(out)
    return out


def trend_confusion(items: DataFrame, lang: str) -> DataFrame:
    """gold, pred, n over items whose gold has a trend; answers without one are 'none'."""
    d = items.select(trend(gold_facts(F.col("gold_spans"), lang)["movement"]).alias("gold"), F.coalesce(trend(said_facts(F.coalesce("pred", F.lit("")), lang)["movement"]), F.lit("none")).alias("pred"))
    return d.where("gold is not null").groupBy("gold", "pred").agg(F.count(F.lit(1)).alias("n"))


def direction_accuracy(items: DataFrame, lang: str) -> DataFrame:
    """One row: items with a gold direction, right ones (all named, no opposite), contradictions, and items without one."""
    table = F.create_map(*[F.lit(x) for kv in V.OPPOSITE_CONCEPTS.items() for x in kv])
    gold = F.array_intersect(gold_facts(F.col("gold_spans"), lang)["movement"], F.array(*map(F.lit, V.OPPOSITE_CONCEPTS)))
    d = items.select(gold.alias("g"), said_facts(F.coalesce("pred", F.lit("")), lang)["movement"].alias("p"))
    against = F.arrays_overlap(F.transform("g", lambda x: F.element_at(table, x)), "p")
    some = F.size("g") > 0
    right = some & (F.size(F.array_except("g", "p")) == 0) & ~against
    return d.agg(F.count_if(some).alias("n"), F.count_if(right).alias("correct"), F.count_if(some & against).alias("contradictions"), F.count_if(~some).alias("skipped"))


def sign_of(text: Column) -> Column:
    """'+', '-', '0' or '?': claims of more or less than the sum stand before additive ones."""
    return pattern_label(text, V.SIGNS, "?")
