"""Free-text answers parsed into muscles, directions and corrections."""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from . import vocabulary as V

_ABBR = {m: re.compile(rf"\b{m}\b", re.I) for m in V.MUSCLES}
_AXES = ({"advance", "retract"}, {"elevate", "descend"})
_TOKENS = "|".join(sorted(map(re.escape, V.REGION_ALIASES), key=len, reverse=True))
_ASSIGNED = re.compile(rf"({_TOKENS})\s*[=:]\s*([^;|\n]+)", re.I)
_NEARBY = re.compile(rf"({_TOKENS})\b.{{0,80}}?(?={_TOKENS}|$)", re.I)
_AXIS = [(re.compile(p), plus, minus) for p, plus, minus in V.AXIS_NUMBERS]
_PAIR = re.compile(V.AXIS_PAIR)


def word_concepts(text: str) -> set[str]:
    low = text.lower()
    return {concept for surface, concept in V.DIRECTION_SURFACES.items() if surface in low}


def number_concepts(text: str) -> set[str]:
    """Directions of signed displacements of at least MOVE_EPS_MM."""
    low = text.lower()
    moves = [(m[1], plus, minus) for p, plus, minus in _AXIS for m in p.finditer(low)]
    for m in _PAIR.finditer(low):
        moves += [(x, plus, minus) for x, (_, plus, minus) in zip(m.groups(), _AXIS, strict=True)]
    return {plus if float(x) > 0 else minus for x, plus, minus in moves if abs(float(x)) >= V.MOVE_EPS_MM}


def direction_concepts(text: str) -> set[str]:
    """Words decide; numbers fill an axis on which no word speaks."""
    said, measured = word_concepts(text), number_concepts(text)
    return said.union(*(measured & axis for axis in _AXES if not said & axis))


def directions(text: str | None) -> dict[str, list[str]]:
    """Concepts of each region; those of the whole text for all regions where none is named with a concept."""
    low, out, named = (text or "").lower(), defaultdict(set), False
    for m in _ASSIGNED.finditer(low):
        named = True
        out[V.REGION_ALIASES[m[1]]] |= direction_concepts(m[2])
    for m in _NEARBY.finditer(low):
        if got := direction_concepts(m[0]):
            named = True
            out[V.REGION_ALIASES[m[1]]] |= got
    if not named:
        everywhere = direction_concepts(low)
        out = {r: everywhere for r in V.REGIONS}
    return {r: sorted(out.get(r, ())) for r in V.REGIONS}


def muscles_in(text: str) -> set[str]:
    """Abbreviations as whole words, and full names in either language."""
    low = text.lower()
    return {m for m, p in _ABBR.items() if p.search(text)} | {m for name, m in V.MUSCLE_SURFACES.items() if name in low or name in text}


_UP, _DOWN = "inc", "dec"
_TRAILING = {m: (re.compile(rf"\b{m}\s*↑", re.I), re.compile(rf"\b{m}\s*↓", re.I)) for m in V.MUSCLES}
_LEADING = [(re.compile(rf"(?<![A-Za-z]){a}\s*([^↑↓⬆⬇\n;]+)"), tag) for a, tag in (("↑", _UP), ("↓", _DOWN), ("⬆", _UP), ("⬇", _DOWN))]
_OWN_ARROW = re.compile(rf"(?:{'|'.join(V.MUSCLES)})\s*[↑↓⬆⬇]")
_LISTS = [
    (re.compile(rf"(?:{own})\b(.{{0,{V.LIST_REACH}}}?)(?=(?:{other})\b|[.;\n]|$)", re.I | re.S), tag)
    for own, other, tag in ((V.MORE_VERBS, V.LESS_VERBS, _UP), (V.LESS_VERBS, V.MORE_VERBS, _DOWN))
]
_KO_ORDER = [
    (re.compile(rf"(.{{0,{V.KO_REACH}}}?)(?:{own})", re.I | re.S), re.compile(rf"(?:{other})"), tag)
    for own, other, tag in ((V.KO_MORE_VERBS, V.KO_LESS_VERBS, _UP), (V.KO_LESS_VERBS, V.KO_MORE_VERBS, _DOWN))
]
_CLAUSE_END = re.compile(r"[.。\n;；]")
_HANGUL = re.compile("[가-힣]")
_NEAR_VERBS = ((re.compile(f"(?:{V.MORE_VERBS})"), _UP), (re.compile(rf"(?:{V.LESS_VERBS}\b)"), _DOWN))
_NAMES_EN = {m: name for name, m in V.MUSCLE_SURFACES.items() if name.isascii()}
_MENTIONS = {m: [_ABBR[m], re.compile(_NAMES_EN[m], re.I)] for m in V.MUSCLES}


def arrow_corrections(text: str) -> Iterator[tuple[str, str]]:
    """'GGP↑' first; then '↑ GGP, STY' for muscles without an arrow of their own."""
    known = {}
    for m, (up, down) in _TRAILING.items():
        here = [tag for p, tag in ((up, _UP), (down, _DOWN)) if p.search(text)]
        if len(here) == 1:
            known[m] = here[0]
    for pattern, tag in _LEADING:
        for hit in pattern.finditer(text):
            for m in muscles_in(_OWN_ARROW.split(hit[1], maxsplit=1)[0]):
                known.setdefault(m, tag)
    yield from known.items()


def list_corrections(text: str) -> Iterator[tuple[str, str]]:
    """'contract GGP, STY ... relax VERT': muscles after a verb, up to the opposite verb or the sentence's end."""
    for pattern, tag in _LISTS:
        for hit in pattern.finditer(text):
            yield from ((m, tag) for m in muscles_in(hit[1]))


def korean_corrections(text: str) -> Iterator[tuple[str, str]]:
    """The verb comes last: what it asks for stands between it and the nearest clause end or opposite verb before it."""
    if not _HANGUL.search(text):
        return
    for asked, opposite, tag in _KO_ORDER:
        for hit in asked.finditer(text):
            before = hit[1]
            start = max((stop.end() for ends in (_CLAUSE_END, opposite) for stop in ends.finditer(before)), default=0)
            yield from ((m, tag) for m in muscles_in(before[start:]))


def nearest_corrections(text: str) -> Iterator[tuple[str, str]]:
    """The verb that begins nearest to a mention, in NEAR_REACH characters around it; muscles with a tie between tags are left out."""
    for m, patterns in _MENTIONS.items():
        reached: dict[int, list[str]] = defaultdict(list)
        for hit in (h for p in patterns for h in p.finditer(text)):
            left = max(0, hit.start() - V.NEAR_REACH)
            window, anchor = text[left : hit.end() + V.NEAR_REACH].lower(), hit.start() - left
            options = [(abs(v.start() - anchor), order, tag) for order, (p, tag) in enumerate(_NEAR_VERBS) for v in p.finditer(window)]
            if options:
                distance, _, tag = min(options)
                reached[distance].append(tag)
        if reached and len(set(closest := reached[min(reached)])) == 1:
            yield m, closest[0]


def _ranked(text: str) -> Iterable[tuple[int, Iterable[tuple[str, str]]]]:
    yield 3, arrow_corrections(text)
    yield 2, korean_corrections(text)
    yield 2, list_corrections(text)
    yield 1, nearest_corrections(text)


def corrections(text: str | None) -> dict[str, str]:
    """Muscle to inc or dec by the parser of highest rank that names it; a muscle with both tags at that rank is left out."""
    claims: dict[str, dict[int, set[str]]] = defaultdict(lambda: defaultdict(set))
    for rank, pairs in _ranked(text or ""):
        for m, tag in pairs:
            claims[m][rank].add(tag)
    best = {m: by_rank[max(by_rank)] for m, by_rank in claims.items()}
    return {m: next(iter(best[m])) for m in V.MUSCLES if len(best.get(m, ())) == 1}


def _each_once(texts: pd.Series, parse) -> pd.Series:
    """Parsed texts of a batch; equal texts are parsed once."""
    known = {t: parse(t) for t in texts.unique()}
    return texts.map(lambda t: known[t])


def directions_of(text: Column) -> Column:
    @F.pandas_udf("map<string, array<string>>")
    def run(texts: pd.Series) -> pd.Series:
        return _each_once(texts, directions)

    return run(text)


def corrections_of(text: Column) -> Column:
    @F.pandas_udf("map<string, string>")
    def run(texts: pd.Series) -> pd.Series:
        return _each_once(texts, corrections)

    return run(text)


def nearest_corrections_of(text: Column) -> Column:
    """Muscle to tag by the nearest verb alone."""

    @F.pandas_udf("map<string, string>")
    def run(texts: pd.Series) -> pd.Series:
        return _each_once(texts, lambda t: dict(nearest_corrections(t or "")))

    return run(text)


def muscle_mentions(text: Column) -> Column:
    """Muscles named in the text, in the fixed order, without Python: whole abbreviations, or names of 3 letters or more."""
    low = F.lower(text)
    flags = []
    for m in V.MUSCLES:
        hit = text.rlike(rf"(?i)\b{m}\b")
        names = [n for n, x in V.MUSCLE_SURFACES.items() if x == m and n.isascii()]
        names += [V.FULL_NAMES[lang][m].lower() for lang in ("en", "ko")] + [V.FULL_NAMES["ko"][m].partition("(")[0]]
        names += [m.lower()] * (len(m) >= 3) + ["genioglossus medial"] * (m == "GGM")
        for n in names:
            hit = hit | F.contains(low, F.lit(n))
        flags.append(F.when(hit, F.lit(m)))
    return F.filter(F.array(*flags), lambda x: x.isNotNull())
