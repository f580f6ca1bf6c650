"""Facts in text: numbers, words, concept bags, span facts, set and multiset comparisons, pattern labels."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# The two number patterns of the data format. They differ on purpose and are never mixed.
NUMBERS_TAGGED = r"-?\d+\.\d+|-?\d+"
NUMBERS_SCORED = r"-?\d+\.?\d*"


def numbers(text: Column, pattern: str = NUMBERS_TAGGED) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(0))


def first_number(text: Column, pattern: str = NUMBERS_SCORED) -> Column:
    """The first number as double, null without one."""
    return F.regexp_extract(text, pattern, 0).try_cast("double")


def words(text: Column) -> Column:
    return F.array_remove(F.split(F.lower(text), r"[^a-zà-ÿ]+"), "")


def set_counts(gold: Column, pred: Column) -> Column:
    """struct(tp, fp, fn) of two arrays read as sets."""
    return F.struct(F.size(F.array_intersect(gold, pred)).cast("long").alias("tp"), F.size(F.array_except(pred, gold)).cast("long").alias("fp"), F.size(F.array_except(gold, pred)).cast("long").alias("fn"))


def prf(tp: Column, fp: Column, fn: Column) -> tuple[Column, Column, Column]:
    """Precision, recall and F1, each 0.0 where its denominator is 0."""
    zero = F.lit(0.0)
    p, r = F.coalesce(F.try_divide(tp, tp + fp), zero), F.coalesce(F.try_divide(tp, tp + fn), zero)
    return p, r, F.coalesce(F.try_divide(2 * p * r, p + r), zero)


def concepts(text: Column, surfaces: Mapping[str, str]) -> Column:
    """Concepts whose surface forms occur in the lower-cased text, sorted."""
    low = F.lower(text)
    found = F.array(*[F.when(F.contains(low, F.lit(s.lower())), F.lit(c)) for s, c in surfaces.items()])
    return F.array_sort(F.array_distinct(F.filter(found, lambda x: x.isNotNull())))


def names_in(text: Column, names: Mapping[str, str]) -> Column:
    """Keys whose full names occur in the text, in the mapping's order."""
    return F.filter(F.array(*[F.when(F.contains(text, F.lit(full)), F.lit(key)) for key, full in names.items()]), lambda x: x.isNotNull())


def facts_from_spans(spans: Column, kind: str) -> Column:
    """Distinct values of the spans of a type."""
    return F.array_sort(F.array_distinct(F.transform(F.filter(spans, lambda s: s["type"] == kind), lambda s: s["value"])))


def bound(columns: Sequence[Column], use: Callable[..., Column]) -> Column:
    """use(*columns) with each column computed once for a row, however often it is used."""
    names = [f"c{i}" for i in range(len(columns))]
    return F.get(F.transform(F.array(F.struct(*[c.alias(n) for c, n in zip(columns, names, strict=True)])), lambda s: use(*[s[n] for n in names])), 0)


def multiset_missing(original: Column, new: Column) -> Column:
    """Values of `original` that `new` holds less often, with how often they are missing."""
    count = lambda a, x: F.size(F.filter(a, lambda y: y == x))
    missing = lambda o, n: F.filter(F.transform(F.array_distinct(o), lambda x: F.struct(x.alias("value"), (count(o, x) - count(n, x)).alias("missing"))), lambda s: s["missing"] > 0)
    return bound([original, new], missing)


def faithful(original: Column, new: Column, names: Mapping[str, str], surfaces: Mapping[str, str]) -> Column:
    """Whether a paraphrase keeps all numbers (with multiplicity), all full names and the same concepts."""
    kept_numbers = F.size(multiset_missing(numbers(original, NUMBERS_SCORED), numbers(new, NUMBERS_SCORED))) == 0
    kept_names = F.size(F.array_except(names_in(original, names), names_in(new, names))) == 0
    kept_concepts = F.size(F.array_except(concepts(original, surfaces), concepts(new, surfaces))) == 0
    return kept_numbers & kept_names & kept_concepts


def pattern_label(text: Column, patterns: Sequence[tuple[str, str]], other: str) -> Column:
    """The label of the first pattern that occurs, case ignored."""
    out = F.lit(other)
    for pattern, label in reversed(patterns):
        out = F.when(text.rlike(f"(?i){pattern}"), F.lit(label)).otherwise(out)
    return out


def matches_any(text: Column, patterns: Sequence[str]) -> Column:
    return F.lower(text).rlike("|".join(patterns))


def fixed(x: Column, digits: int) -> Column:
    """A number with a fixed number of decimals, rounded half to even on its exact value, without grouping marks."""
    return F.replace(F.format_number(x, digits), F.lit(","), F.lit(""))


def value_text(x: Column) -> Column:
    """One decimal from 10 on, else three without trailing zeros; -0 is 0."""
    small = F.regexp_replace(F.regexp_replace(fixed(x, 3), r"0+$", ""), r"\.$", "")
    return F.when(F.abs(x) >= 10, fixed(x, 1)).otherwise(F.when(small == "-0", F.lit("0")).otherwise(small))


def render(template: str, slots: Mapping[str, Column]) -> Column:
    """A template with {name} slots filled by columns."""
    parts, rest = [], template
    while "{" in rest:
        head, _, rest = rest.partition("{")
        name, _, rest = rest.partition("}")
        parts += [F.lit(head), slots[name]]
    return F.concat(*parts, F.lit(rest))
