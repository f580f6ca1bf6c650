"""Training rows in the space of tokens: which tokens are supervised, which carry facts and what they weigh.

Character spans and token offsets are two sorted lists of intervals; a span's tokens are those from the first that
ends behind its begin to the last that begins before its end, found by binary search in either list. Choices are by
hash, so reruns agree.
"""

from __future__ import annotations

import hashlib
import math
import os
import re
import zlib
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The label of tokens without supervision.
IGNORED = -100

Offsets = Callable[[str], tuple[np.ndarray, np.ndarray, np.ndarray]]


def pattern_tokens(pattern: str) -> Offsets:
    """Tokens are what a pattern matches; the id of one is the CRC-32 of its text."""
    found = re.compile(pattern)

    def run(text: str):
        hits = list(found.finditer(text))
        ids = [zlib.crc32(m[0].encode("utf-8", "surrogatepass")) for m in hits]
        return np.array(ids, dtype=np.int64), np.array([m.start() for m in hits], dtype=np.int64), np.array([m.end() for m in hits], dtype=np.int64)

    return run


def library_tokens(path: str) -> Offsets:
    """Tokens and code-point offsets of a tokenizer file, without begin, end or added tokens."""
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()

    def run(text: str):
        e = tokenizer.encode(text, add_special_tokens=False)
        places = np.array(e.offsets, dtype=np.int64).reshape(-1, 2)
        return np.array(e.ids, dtype=np.int64), places[:, 0], places[:, 1]

    return run


def touched(begins: np.ndarray, ends: np.ndarray, spans: list[tuple[int, int]]) -> np.ndarray:
    """Which tokens, by ascending begins and ends, share a character with one of the spans (half open)."""
    step = np.zeros(len(begins) + 1, dtype=np.int64)
    for s, e in spans:
        if e > s:
            low, high = int(np.searchsorted(ends, s, "right")), int(np.searchsorted(begins, e, "left"))
            if low < high:
                step[low] += 1
                step[high] -= 1
    return (np.cumsum(step[:-1]) > 0) & (ends > begins)


def chance(*parts) -> float:
    """A number from 0 to 1 from a hash."""
    return int(hashlib.md5(":".join(map(str, parts)).encode("utf-8", "surrogatepass")).hexdigest()[:8], 16) / (1 << 32)


@dataclass(frozen=True)
class Collation:
    """How rows are made. end_mark: characters after an answer that are supervised with it; share: of a turn's facts that are weighed, one at least;
    context: chance that a fact of an earlier turn is hidden; target: share of the loss that facts get, else fact_weight."""

    end_mark: int = 0
    last_only: bool = False
    share: float = 0.5
    context: float = 0.0
    target: float | None = None
    fact_weight: float = 1.0
    largest: float = 20.0
    max_len: int = 2048
    mask_id: int = 0
    slot_id: int | None = None
    slot_size: int = 0

    def chosen(self, key, turn: int, n: int) -> list[int]:
        """The facts of a turn that are weighed: at least one and at most all, in hash order."""
        if not n or self.share <= 0:
            return []
        k = min(n, max(1, math.ceil(n * self.share)))
        return sorted(range(n), key=lambda i: (chance(key, turn, i), i))[:k]

    def slot(self, ids: np.ndarray) -> int:
        """Where slot_size slot tokens first follow each other; -1 where they don't."""
        if self.slot_id is None or not self.slot_size:
            return -1
        run = np.convolve(ids == self.slot_id, np.ones(self.slot_size, dtype=np.int64), "valid") if len(ids) >= self.slot_size else np.zeros(0)
        hits = np.flatnonzero(run == self.slot_size)
        return int(hits[0]) if len(hits) else -1

    def row(self, key, tokens: tuple[np.ndarray, np.ndarray, np.ndarray], answers: list[tuple[int, int]], facts: list[list[tuple[int, int]]]):
        """(ids, labels, weights, slot) of a text whose answers stand at given places, each with its facts' places."""
        ids, begins, ends = (t[: self.max_len] for t in tokens)
        turns = [len(answers) - 1] if self.last_only and answers else range(len(answers))
        on = touched(begins, ends, [(answers[t][0], answers[t][1] + self.end_mark) for t in turns])
        weighed = [facts[t][i] for t in range(len(facts)) for i in self.chosen(key, t, len(facts[t]))]
        fact = touched(begins, ends, weighed) & on
        hidden = [f for t, of in enumerate(facts[:-1]) for i, f in enumerate(of) if self.context > 0 and chance(key, "context", t, i) < self.context]
        shown = np.where(touched(begins, ends, hidden) & on, self.mask_id, ids)
        n_on, n_fact = int(on.sum()), int(fact.sum())
        weight = self.fact_weight
        if self.target is not None and n_fact and n_on > n_fact:
            s = n_fact / n_on
            weight = min(max(self.target / (1 - self.target) * (1 - s) / s, 1.0), self.largest)
        weights = np.where(fact, weight, on.astype(np.float64))
        return shown, np.where(on, ids, IGNORED), weights, self.slot(ids)


def collate(rows: DataFrame, key: str, text: str, answers: str, facts: str, tokens: Callable[[], Offsets], how: Collation) -> DataFrame:
    """key, ids, labels, weights, slot of rendered chats.

    answers: array of (start, end), facts: for each of them an array of (start, end) in the text, as places in a chat have
    them. tokens makes the tokenizer in each worker. Null texts give empty rows; rows that repeat are made each.
    """
    schema = pa.schema([("key", rows_type(rows, key)), ("ids", pa.list_(pa.int64())), ("labels", pa.list_(pa.int64())), ("weights", pa.list_(pa.float64())), ("slot", pa.int32())])
    spans = lambda xs: [(x["start"], x["end"]) for x in xs or []]

    def run(batches):
        offsets = tokens()
        for batch in batches:
            out: list[list] = [[] for _ in schema]
            for k, t, a, f in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                made = how.row(k, offsets(t or ""), spans(a), [spans(x) for x in f or []])
                for col, x in zip(out, (k, *made), strict=True):
                    col.append(x)
            yield pa.RecordBatch.from_arrays([pa.array(c, s.type) for c, s in zip(out, schema, strict=True)], schema=schema)

    kind = rows.schema[key].dataType.simpleString()
    found = rows.select(key, text, answers, facts).mapInArrow(run, f"key {kind}, ids array<long>, labels array<long>, weights array<double>, slot int")
    return found.withColumnRenamed("key", key)


def rows_type(rows: DataFrame, key: str) -> pa.DataType:
    """The Arrow type of a key column."""
    return {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}[rows.schema[key].dataType.simpleString()]


def padded(rows: DataFrame, width: int, pad_id: int) -> DataFrame:
    """ids, labels and weights filled up on the right to a common width, and the mask of what is not padding."""
    fill = lambda c, x: F.concat(c, F.array_repeat(F.lit(x), F.greatest(F.lit(0), F.lit(width) - F.size(c))))
    mask = F.concat(F.array_repeat(F.lit(1), F.size("ids")), F.array_repeat(F.lit(0), F.greatest(F.lit(0), F.lit(width) - F.size("ids"))))
    return rows.withColumn("mask", mask).withColumns({"ids": fill("ids", pad_id), "labels": fill("labels", IGNORED), "weights": fill("weights", 0.0)})
