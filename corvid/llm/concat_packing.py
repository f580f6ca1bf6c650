"""Concatenate and cut: documents one after another in one stream of tokens, cut into fixed windows.

Two passes and no shuffle of tokens. The first stores every document's ids with its place inside its partition; the
partitions' totals are added up to each one's global offset; the second cuts at the windows' edges. What is left at
the end of the stream is cut into windows whose lengths are falling powers of two, which need no padding.
"""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, stored
from .tokens import Library, _byte_letters, tokenizer_path

#: Bytes of text that are encoded at once, and ids in a stored row; longer texts are cut between words, longer documents are several rows.
SECTION, ROW_IDS = 1 << 20, 1 << 18
#: Fixed value: the splitter of byte-level tokenizers.
BYTE_LEVEL = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_EDGE = re.compile(r"(?<=\S)\s")


class Encoder:
    """Ids of whole texts as the tokenizers library gives them, without begin, end or added special tokens.

    Byte-level merge lists whose ids follow the order of the merges are run by the faster tiktoken on the same
    vocabulary, which splits alike; the tests compare both on every code point. Others are run by their library.
    """

    def __init__(self, name: str):
        path = tokenizer_path(name)
        self.spec = {} if path.endswith(".model") else json.load(open(path, encoding="utf-8"))
        self.fast = self._same_ranks()
        self.library = None if self.fast else Library(name)
        self.spec = {}

    def _same_ranks(self):
        spec, model = self.spec, self.spec.get("model") or {}
        level = spec.get("pre_tokenizer") or {}
        if spec.get("normalizer") or (level.get("type"), level.get("add_prefix_space"), level.get("use_regex")) != ("ByteLevel", False, True):
            return None
        if model.get("type") != "BPE" or any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "fuse_unk", "byte_fallback", "ignore_merges")):
            return None
        if any(t["lstrip"] or t["rstrip"] or t["normalized"] or t["single_word"] or any(c.isspace() for c in t["content"]) for t in spec.get("added_tokens") or []):
            return None
        byte_of = {c: b for b, c in _byte_letters().items()}
        special = {t["content"]: t["id"] for t in spec.get("added_tokens") or []}
        merged = ["".join(m.split(" ") if isinstance(m, str) else m) for m in model["merges"]]
        made = [model["vocab"][m] for m in merged]
        plain = {t: i for t, i in model["vocab"].items() if t not in special}
        if made != sorted(made) or len(plain) != len(byte_of) + len(made) or any(c not in byte_of for t in plain for c in t):
            return None
        import tiktoken

        encoding = tiktoken.Encoding("corvid", pat_str=BYTE_LEVEL, mergeable_ranks={bytes(byte_of[c] for c in t): i for t, i in plain.items()}, special_tokens=special)
        return lambda text: encoding.encode_to_numpy(text, allowed_special="all")

    def ids(self, text: str, section: int = SECTION) -> np.ndarray:
        """All ids of a text as unsigned 32-bit numbers."""
        if self.fast is None:
            return np.asarray(self.library.encode(text), dtype="<u4")
        if len(text) <= section:
            return self.fast(text).astype("<u4", copy=False)
        out, at = [], 0
        while at < len(text):
            # No token spans the place between a word and the white space after it.
            m = _EDGE.search(text, at + section)
            end = m.start() if m else len(text)
            out.append(self.fast(text[at:end]).astype("<u4", copy=False))
            at = end
        return np.concatenate(out)


_encoders: dict[str, Encoder] = {}


def encoder(name: str) -> Encoder:
    """This worker's encoder of a tokenizer."""
    if name not in _encoders:
        _encoders[name] = Encoder(name)
    return _encoders[name]


_STREAM = pa.schema([("part", pa.int32()), ("at", pa.int64()), ("doc_id", pa.int64()), ("start", pa.int64()), ("doc_tokens", pa.int64()), ("n", pa.int32()), ("ids", pa.binary())])
STREAM = "part int, at long, doc_id long, start long, doc_tokens long, n int, ids binary"


def _streamed(tokenizer: str, end_id: int):
    def run(batches):
        own, part, at = encoder(tokenizer), TaskContext.get().partitionId(), 0
        for batch in batches:
            out = [[] for _ in _STREAM]
            held = 0
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = np.append(own.ids(text.as_py()), np.uint32(end_id)).astype("<u4", copy=False)
                for begin in range(0, len(ids), ROW_IDS):
                    data = ids[begin : begin + ROW_IDS].tobytes()
                    for col, x in zip(out, (part, at, doc, begin, len(ids), len(data) // 4, data), strict=True):
                        col.append(x)
                    at += len(data) // 4
                    held += len(data)
                    if held >= 4 * ROW_IDS:
                        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(out, _STREAM, strict=True)], schema=_STREAM)
                        out, held = [[] for _ in _STREAM], 0
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(out, _STREAM, strict=True)], schema=_STREAM)

    return run


class Windows:
    """The windows of a stream of so many tokens: full ones, then falling powers of two for what is left."""

    def __init__(self, total: int, capacity: int):
        self.capacity, self.full = capacity, total // capacity
        rest = total - self.full * capacity
        sizes = [1 << b for b in reversed(range(rest.bit_length())) if rest >> b & 1]
        self.edges = [self.full * capacity, *(self.full * capacity + np.cumsum(sizes, dtype=np.int64)).tolist()]

    def at(self, place: int) -> tuple[int, int, int]:
        """(window, its begin, its end) of a place in the stream."""
        if place < self.edges[0]:
            no = place // self.capacity
            return no, no * self.capacity, (no + 1) * self.capacity
        k = int(np.searchsorted(self.edges, place, "right")) - 1
        return self.full + k, self.edges[k], self.edges[k + 1]

    def cut(self, begin: int, end: int) -> Iterator[tuple[int, int, int, int]]:
        """(window, offset in it, begin, end) of the pieces of a stretch of the stream."""
        while begin < end:
            no, first, last = self.at(begin)
            yield no, begin - first, begin, min(end, last)
            begin = min(end, last)


class TokenStream:
    """All documents' ids one after another: a stored table of stretches, and where each partition begins.

    The totals of the partitions, two numbers each, pass through the driver; what holds tokens stays in the table.
    """

    def __init__(self, docs: DataFrame, tokenizer: str, end_id: int, capacity: int, id_col: str = "doc_id", text_col: str = "text"):
        d = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("_text"))
        self.rows = stored(arrow_map(d, _streamed(tokenizer, end_id), STREAM), "token-stream")
        totals = {r["part"]: r["n"] for r in self.rows.groupBy("part").agg(F.sum("n").alias("n")).collect()}
        sizes = np.zeros(max(totals, default=-1) + 1, dtype=np.int64)
        for part, n in totals.items():
            sizes[part] = n
        self.base = np.cumsum(sizes) - sizes
        self.total = int(sizes.sum())
        self.windows = Windows(self.total, capacity)

    def pieces(self) -> DataFrame:
        """doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset of every piece: the stored table read once."""
        base, windows = self.base, self.windows
        schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64())])

        def run(batches):
            for batch in batches:
                out = [[] for _ in schema]
                for part, at, doc, start, n, ids in zip(*(batch.column(c).to_pylist() for c in ("part", "at", "doc_id", "start", "doc_tokens", "ids")), strict=True):
                    here = int(base[part]) + at
                    for no, offset, begin, end in windows.cut(here, here + len(ids) // 4):
                        piece = ids[4 * (begin - here) : 4 * (end - here)]
                        for col, x in zip(out, (doc, start + begin - here, end - begin, zlib.crc32(piece), n, no, offset), strict=True):
                            col.append(x)
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(out, schema, strict=True)], schema=schema)

        return self.rows.mapInArrow(run, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")

    def sequences(self) -> DataFrame:
        """sequence_id, n_tokens, ids (little-endian unsigned 32-bit) of every window.

        Windows that lie in what one task reads leave it whole. Of the others each task emits boundary records, its part
        of the window and the place of it; only these are shuffled, at most `capacity` to a window.
        """
        base, windows = self.base, self.windows
        schema = pa.schema([("sequence_id", pa.int64()), ("offset", pa.int64()), ("ids", pa.binary()), ("whole", pa.bool_())])

        def run(batches):
            held, first, expected = [], None, None  # parts of the window that is open, where they begin, what comes next

            def close():
                no, begin, end = windows.at(first)
                data = b"".join(held)
                return no, first - begin, data, first == begin and len(data) == 4 * (end - begin)

            for batch in batches:
                out = []
                for part, at, ids in zip(*(batch.column(n).to_pylist() for n in ("part", "at", "ids")), strict=True):
                    here = int(base[part]) + at
                    if held and here != expected:
                        out.append(close())
                        held = []
                    for _, offset, begin, end in windows.cut(here, here + len(ids) // 4):
                        if held and not offset:
                            out.append(close())
                            held = []
                        if not held:
                            first = begin
                        held.append(ids[4 * (begin - here) : 4 * (end - here)])
                    expected = here + len(ids) // 4
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], f.type) for i, f in enumerate(schema)], schema=schema)
            if held:
                yield pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip(close(), schema, strict=True)], schema=schema)

        found = stored(self.rows.mapInArrow(run, "sequence_id long, offset long, ids binary, whole boolean"), "token-windows")
        parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))
        merged = found.where("not whole").groupBy("sequence_id").agg(parts.alias("parts"))
        merged = merged.select("sequence_id", F.aggregate("parts", F.lit(b""), lambda done, p: F.concat(done, p["ids"])).alias("ids"))
        out = found.where("whole").select("sequence_id", "ids").unionByName(merged)
        return out.select("sequence_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), "ids")


def concat_pack(docs: DataFrame, tokenizer: str, capacity: int = 1024, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset: the pieces of all documents in windows of capacity tokens.

    A document is its ids and end_id; null and empty texts are one token. Documents follow each other in the order in
    which they are read, so every id lies in one piece and all windows but the last are full; the rest of the stream
    goes to windows of falling powers of two, so that nothing is padded. Very long documents may have more than one
    piece in a window. Repeated rows are packed each; a null id stays null; other columns are not read; an empty table
    gives an empty result. Any share of the rows may have one id or text: nothing is grouped by either.
    """
    return TokenStream(docs, tokenizer, end_id, capacity, id_col, text_col).pieces()
