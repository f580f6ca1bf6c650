"""Best-fit packing by exact complements, which are looked up in an index of single, pair and triple sums.

Sequences hold `capacity` tokens, so there are at most `capacity` distinct lengths of pieces, whatever the
corpus: the histogram of lengths is planned on the driver. A plan is a list of templates (lengths that share a
sequence) and how often each is used; both are bounded by the number of lengths, not of documents.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, byte_slices, salted_rank, stored
from .tokens import SECTION, counter


class Complements:
    """The lengths that are left, indexed by the sums that one, two or three of them make.

    one, two and three hold for every sum in how many ways that many pieces make it, no length being used more
    often than it is left. They are the coefficients of the product over lengths x of
    1 + z q^x + z^2 q^2x [two left] + z^3 q^3x [three left], cut after z^3: a length whose number changes is divided
    out and multiplied in again, which takes a few vector operations.
    """

    def __init__(self, counts: dict[int, int], capacity: int):
        self.left = np.zeros(capacity + 1, dtype=np.int64)
        self.one, self.two, self.three = (np.zeros(capacity + 1, dtype=np.int64) for _ in range(3))
        for length, n in counts.items():
            self.put(length, n)

    @staticmethod
    def _shifted(sums: np.ndarray, by: int) -> np.ndarray:
        out = np.zeros_like(sums)
        if by < len(sums):
            out[by:] = sums[: len(sums) - by]
        return out

    def put(self, x: int, n: int) -> None:
        """n pieces of length x are left."""
        old, new = min(int(self.left[x]), 3), min(n, 3)
        self.left[x] = n
        if old == new:
            return
        single = np.zeros_like(self.one)
        single[x] = 1
        double, triple = self._shifted(single, x), self._shifted(single, 2 * x)
        one, two, three = self.one, self.two, self.three
        if old:
            one = one - single
            two = two - self._shifted(one, x) - (old > 1) * double
            three = three - self._shifted(two, x) - (old > 1) * self._shifted(one, 2 * x) - (old > 2) * triple
        if new:
            three = three + self._shifted(two, x) + (new > 1) * self._shifted(one, 2 * x) + (new > 2) * triple
            two = two + self._shifted(one, x) + (new > 1) * double
            one = one + single
        self.one, self.two, self.three = one, two, three

    def _pairs_beside(self, a: np.ndarray, sums: np.ndarray) -> np.ndarray:
        """For each pair (a, sum) in how many ways two pieces make the sum once one a is taken."""
        ways, rest, left = self.two[sums], sums - a, self.left[a]
        with_a = np.where(rest > 0, (self.left[np.maximum(rest, 0)] > 0) & (rest != a), False)
        return ways - ((left == 1) & with_a) - ((rest == a) & (left == 2))

    def pair(self, gap: int) -> tuple[int, int]:
        """Two lengths of sum gap, the larger one as large as possible; there is one if two[gap] is not 0."""
        low = np.arange(1, gap // 2 + 1)
        fits = (self.left[low] > 0) & (self.left[gap - low] > 0) & ((2 * low < gap) | (self.left[low] > 1))
        low = int(low[fits.argmax()])
        return gap - low, low

    def exact(self, gap: int) -> tuple[int, ...] | None:
        """One, two or three lengths that fill the gap, by the index of their sums."""
        if self.one[gap]:
            return (gap,)
        if self.two[gap]:
            return self.pair(gap)
        if self.three[gap]:
            a = np.flatnonzero(self.left[1:gap] > 0) + 1
            a = int(a[self._pairs_beside(a, gap - a) > 0][-1])
            n = int(self.left[a])
            self.put(a, n - 1)
            two = self.pair(gap - a)
            self.put(a, n)
            return (a, *two)
        return None

    def template(self) -> tuple[int, ...] | None:
        """The largest length, with combinations that fill the gap exactly, else with the best fit, again and again.

        What it holds is taken from the lengths that are left.
        """
        here = np.flatnonzero(self.left)
        if not len(here):
            return None
        items, gap = [], len(self.left) - 1
        fill: tuple[int, ...] | None = (int(here[-1]),)
        while fill:
            for x in fill:
                self.put(x, int(self.left[x]) - 1)
                items.append(x)
                gap -= x
            if gap <= 0:
                break
            fill = self.exact(gap)
            if fill is None:
                fits = np.flatnonzero(self.left[: gap + 1])
                fill = (int(fits[-1]),) if len(fits) else None
        return tuple(items)


def plan(counts: dict[int, int], capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """(template, times) that use up all counts; each is repeated as long as its lengths last."""
    have, out = Complements(counts, capacity), []
    while items := have.template():
        uses = Counter(items)
        more = min(int(have.left[length]) // k for length, k in uses.items())
        for length, k in uses.items():
            have.put(length, int(have.left[length]) - k * more)
        out.append((items, 1 + more))
    return out


def slots(templates: list[tuple[tuple[int, ...], int]]) -> list[tuple[int, int, int, int, int]]:
    """(length, first rank, end rank, first sequence, offset): pieces of a length with these ranks go to consecutive sequences."""
    used, sequence, out = Counter(), 0, []
    for items, times in templates:
        offset = 0
        for length in items:
            out.append((length, used[length], used[length] + times, sequence, offset))
            used[length] += times
            offset += length
        sequence += times
    return out


def _sections(text: bytes, size: int) -> list[bytes]:
    """A text in parts of about size bytes that begin at white space."""
    out, at = [], 0
    while len(text) - at > size:
        m = re.compile(rb"[\x20\x09-\x0D]").search(text, at + size)
        end = m.start() if m else len(text)
        out.append(text[at:end])
        at = end
    return [*out, text[at:]]


_PIECE = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())])


def pieces_of(tokenizer: str, capacity: int, end_id: int):
    def cut(doc: int | None, ids: np.ndarray, start: int, out: list[list]) -> None:
        data = ids.tobytes()
        for at in range(0, len(ids), capacity):
            part = data[4 * at : 4 * (at + capacity)]
            for col, x in zip(out, (doc, (start + at) // capacity, start + at, len(part) // 4, zlib.crc32(part)), strict=True):
                col.append(x)

    def run(batches):
        own = counter(tokenizer)
        for docs, texts in byte_slices(batches, 1, SECTION):
            out: list[list] = [[], [], [], [], []]
            if len(texts) == 1 and len(texts[0]) > SECTION and own.transducer:
                # A very long text: whole pieces leave as they fill up.
                held, start = np.empty(0, dtype="<u4"), 0
                *first, last = _sections(texts[0], SECTION)
                for part, end in [*((p, None) for p in first), (last, end_id)]:
                    held = np.concatenate((held, own.ids([part], end)[0]))
                    full = len(held) if end is not None else len(held) // capacity * capacity
                    cut(docs[0], held[:full], start, out)
                    held, start = held[full:], start + full
            else:
                ids, ends = own.ids(texts, end_id)
                begin = 0
                for doc, end in zip(docs, ends.tolist(), strict=True):
                    cut(doc, ids[begin:end], 0, out)
                    begin = end
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(out, _PIECE, strict=True)], schema=_PIECE)

    return run


def _placer(rows: list[tuple[int, int, int, int, int]]):
    """Rows with length and rank to their sequence and offset, by binary search in the plan's ranges of each length."""
    ranges = np.array(sorted(rows) or [(0, 0, 0, 0, 0)], dtype=np.int64)
    keys = (ranges[:, 0] << 44) | ranges[:, 1]

    def run(batches):
        for batch in batches:
            length, rank = (batch.column(n).to_numpy() for n in ("length", "_rank"))
            at = np.searchsorted(keys, (length << 44) | rank, "right") - 1
            kept = [n for n in batch.schema.names if n != "_rank"]
            sequence = pa.array(ranges[at, 3] + rank - ranges[at, 1])
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in kept), sequence, pa.array(ranges[at, 4])], names=[*kept, "sequence_id", "offset"])

    return run


def pack(docs: DataFrame, tokenizer: str, capacity: int = 4096, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text", salts: int = 256) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset: every document's pieces and their places.

    A document is its token ids and end_id; null texts count as empty, so they are one token. Longer ones than
    capacity are cut into pieces of capacity tokens; the last may be shorter. Repeated rows are packed each, a null id
    stays null, and equal lengths are dealt by a hash of the id. Other columns are not read. An empty table gives an
    empty result. Ranks within a length are dealt over `salts` tasks, so any share of the pieces may have one length.
    """
    d = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("_text"))
    pieces = stored(arrow_map(d, pieces_of(tokenizer, capacity, end_id), "doc_id long, piece int, start long, length long, ids_crc32 long"), "pack-pieces")
    # At most capacity lengths, so the counts and the plan are bounded whatever the corpus.
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    rows = slots(plan(counts, capacity))
    hashed = F.xxhash64("doc_id", "piece")
    ranked = salted_rank(pieces, ["length"], [hashed, F.col("doc_id"), F.col("piece")], salts, hashed)
    ranked = ranked.select("doc_id", "piece", "start", "length", "ids_crc32", F.col("_rank").cast("long").alias("_rank"))
    return ranked.mapInArrow(_placer(rows), "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
