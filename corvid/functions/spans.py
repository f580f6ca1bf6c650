"""Typed spans of a text: muscle, region, movement and number, with code-point offsets."""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from . import vocabulary as V
from .text import NUMBERS_SCORED, NUMBERS_TAGGED

SPAN = "array<struct<type: string, value: string, start: int, end: int, role: string>>"


@dataclass(frozen=True)
class Vocabulary:
    """What a tagger looks for; a number's role is that of the first key in the context before it."""

    muscles: Sequence[str] = ()
    movements: Sequence[str] = ()
    regions: Sequence[str] = ()
    roles: Sequence[tuple[str, str]] = ()
    whole_movements: bool = False
    whole_regions: bool = False
    context: int = 12
    numbers: str = NUMBERS_TAGGED
    _kinds: tuple = field(default=(), repr=False, compare=False)

    @classmethod
    def rewritten(cls, lang: str) -> Vocabulary:
        """The vocabulary for texts that were paraphrased: plain substrings, wider context, the scorer's numbers."""
        return cls(list(V.FULL_NAMES[lang].values()), V.MOVEMENTS[lang], V.REGION_WORDS[lang], V.ROLES[lang], context=14, numbers=NUMBERS_SCORED)


def _word_char(c: str) -> bool:
    return c.isalnum() or c == "_"


def _edge(text: str, at: int) -> bool:
    """Whether a word begins or ends at a place, as a pattern's word boundary."""
    before, after = at > 0 and _word_char(text[at - 1]), at < len(text) and _word_char(text[at])
    return before != after


class Surfaces:
    """All words of a vocabulary in one automaton: a text is read once, however many words there are.

    A word that several kinds share is found for each of them. Of a word's own occurrences none overlaps another.
    """

    def __init__(self, words: Sequence[tuple[str, int, str, bool]]):
        import ahocorasick

        self.words = list(words)
        of: dict[str, list[int]] = {}
        for i, (surface, *_) in enumerate(self.words):
            if surface:
                of.setdefault(surface, []).append(i)
        self.automaton = ahocorasick.Automaton()
        for surface, places in of.items():
            self.automaton.add_word(surface, places)
        if of:
            self.automaton.make_automaton()
        self.empty = not of

    def find(self, text: str) -> list[tuple[int, int, int, int, str]]:
        """(start, rank, number, end, kind) of every occurrence."""
        if self.empty or not text:
            return []
        found, free = [], {}
        for last, places in self.automaton.iter(text):
            end = last + 1
            for i in places:
                surface, rank, kind, whole = self.words[i]
                start = end - len(surface)
                if start < free.get(i, 0) or whole and not (_edge(text, start) and _edge(text, end)):
                    continue
                free[i] = end
                found.append((start, rank, i, end, kind))
        return found


def tagger(vocabulary: Vocabulary) -> Callable[[str], list[dict]]:
    """A function from a text to its spans in order, none overlapping another."""
    words = []
    for rank, kind, surfaces, whole in (
        (0, "muscle", vocabulary.muscles, False),
        (1, "region", vocabulary.regions, vocabulary.whole_regions),
        (2, "movement", vocabulary.movements, vocabulary.whole_movements),
    ):
        words += [(s, rank, kind, whole) for s in surfaces]
    number = re.compile(vocabulary.numbers)
    made: list[Surfaces] = []  # the automaton is made where it is used

    def tag(text: str) -> list[dict]:
        if not made:
            made.append(Surfaces(words))
        found = [(start, rank, i, end, kind, text[start:end], None) for start, rank, i, end, kind in made[0].find(text)]
        for m in number.finditer(text):
            at = m.start()
            if at and text[at - 1] == "#":
                continue
            before = text[max(0, at - vocabulary.context) : at]
            role = next((name for key, name in vocabulary.roles if key in before), "value")
            found.append((at, 3, len(words), m.end(), "number", m[0], role))
        kept, free = [], 0
        # Kept spans are in order, so a span overlaps one of them only if it begins before the last one's end.
        for start, _, _, end, kind, value, role in sorted(found, key=lambda s: s[:3]):
            if start >= free:
                kept.append({"type": kind, "value": value, "start": start, "end": end, "role": role})
                free = end
        return kept

    return tag


def spans_of(text: Column, vocabulary: Vocabulary) -> Column:
    """The spans of a text column, tagged in Arrow batches; null for null."""
    run = tagger(vocabulary)

    @F.pandas_udf(SPAN)
    def tag(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: None if t is None else run(t))

    return tag(text)
