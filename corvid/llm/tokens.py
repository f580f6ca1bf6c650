"""Token counts by a finite-state compilation of a byte-pair tokenizer.

The encoding of a prefix ends in one token, and a token may follow another exactly where the boundary between
them stands when both are merged side by side. So the encoding can be followed byte by byte: a state is a prefix
of a piece (a run of letters, a digit, a run of marks), it knows the last token of its encoding, and its
successor's last token is the one token that ends there and may follow the state before it. States are compiled
from the merge list when a prefix is met, and kept in a table states x byte classes; a transition that leaves a
piece emits the number (or the ids) of the piece's tokens. The table is deterministic and runs on all words of a
batch in step. White space leads back to the start from everywhere.

A chunk cut anywhere has a state map: what it emits whatever comes before, plus an open head and tail, whose
words depend on the neighbours. State maps compose associatively, so the chunks of a long text are dealt over
tasks and their maps are combined pairwise, as in a parallel prefix scan.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Callable
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, byte_slices, stored

#: States of a worker's table, and words kept beside it in a generation.
STATES, TABLE = 80_000, 50_000
#: Bytes of text that go through the table at once; longer texts are cut into chunks of this size.
SECTION = 1 << 20
#: Longer words are given to the library.
LONGEST = 64
MISSING, START = 0, 1
#: Fixed value: the splitter of the tokenizers that this module compiles.
SPLITTER = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
_MARKS = "!\"#$%&()*+,-./:;=>?@[\\]^_`{|}~<"
_SPACES = (0x20, 9, 10, 11, 12, 13)


def tokenizer_path(name: str) -> str:
    """A file's own path, or the place of a public tokenizer's file on this machine."""
    if os.path.exists(name):
        return name
    import public_tokenizers

    return str(public_tokenizers.path(name))


def _byte_letters() -> dict[int, str]:
    """Byte-level vocabularies write printable bytes as themselves and the others as code points from 256 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in plain]
    return {b: chr(256 + i) for i, b in enumerate(others)} | {b: chr(b) for b in plain}


class Library:
    """The library's own encoding of whole texts, and the specification behind it."""

    def __init__(self, name: str):
        path, self.spec = tokenizer_path(name), {}
        if path.endswith(".model"):
            import sentencepiece

            model = sentencepiece.SentencePieceProcessor(model_file=path)
            self.encode: Callable[[str], list[int]] = lambda text: model.encode(text, num_threads=1) if text else []
            return
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            self.spec = json.load(f)
        tokenizer = Tokenizer.from_file(path)
        tokenizer.no_truncation()
        tokenizer.no_padding()
        self.encode = lambda text: tokenizer.encode(text, add_special_tokens=False).ids

    def folds_case(self) -> bool | None:
        """Whether A-Z become a-z; None where the tokenizer is not one that the compilation covers."""
        spec, model = self.spec, self.spec.get("model") or {}
        whole = {"type": "BPE", "dropout": None, "unk_token": None, "continuing_subword_prefix": None, "fuse_unk": False, "byte_fallback": False, "ignore_merges": False}
        if any(model.get(k, False if v is False else None) != v for k, v in whole.items()):
            return None
        split, level = ((spec.get("pre_tokenizer") or {}).get("pretokenizers") or [{}, {}])[:2]
        if (split.get("type"), split.get("pattern"), split.get("behavior"), split.get("invert")) != ("Split", {"Regex": SPLITTER}, "Removed", True):
            return None
        if (level.get("type"), level.get("add_prefix_space"), level.get("use_regex")) != ("ByteLevel", False, False) or len(spec["pre_tokenizer"]["pretokenizers"]) != 2:
            return None
        if any(any(c.isspace() for c in t["content"]) or t["lstrip"] or t["rstrip"] or t["normalized"] for t in spec.get("added_tokens") or []):
            return None
        steps = (spec.get("normalizer") or {}).get("normalizers", [spec.get("normalizer")] if spec.get("normalizer") else [])
        known = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]
        if steps not in ([], known, known[:2], known[:1], known[2:]):
            return None
        return known[2] in steps


class Merges:
    """The merge list: tokens by their bytes, inside and at the end of a piece, and which token may follow which."""

    def __init__(self, model: dict):
        byte_of = {c: b for b, c in _byte_letters().items()}
        suffix, vocab = model.get("end_of_word_suffix") or "", model["vocab"]
        self.inner: dict[bytes, int] = {}
        self.final: dict[bytes, int] = {}
        ends: set[str] = set()
        for c, b in byte_of.items():
            self.inner[bytes([b])] = vocab[c]
            self.final[bytes([b])] = vocab[c + suffix]
            ends.add(c + suffix)
        self.rank: dict[int, int] = {}
        self.pairs: dict[tuple[int, int], int] = {}
        self.halves: dict[int, tuple[int, int]] = {}
        for rank, merge in enumerate(model["merges"]):
            left, right = merge.split(" ") if isinstance(merge, str) else merge
            whole, pair = left + right, (vocab[left], vocab[right])
            token = vocab[whole]
            if token in self.halves:
                raise ValueError(f"two merges make {whole!r}")
            plain = whole.removesuffix(suffix) if right in ends else whole
            if right in ends:
                ends.add(whole)
            if not suffix or right not in ends:
                self.inner[bytes(byte_of[c] for c in plain)] = token
            if not suffix or right in ends:
                self.final[bytes(byte_of[c] for c in plain)] = token
            self.rank[token], self.pairs[pair], self.halves[token] = rank, rank, pair
        self.longest = max(map(len, [*self.inner, *self.final]))
        self._spines: dict[tuple[int, int], list[tuple[int, int, float]]] = {}
        #: What follows() has found.
        self.known: dict[tuple[int, int], bool] = {}

    def _spine(self, token: int, side: int) -> list[tuple[int, int, float]]:
        """What stands at a token's left (0) or right (1) edge while it is merged: (token, made at rank, used at rank)."""
        found = self._spines.get((token, side))
        if found is None:
            found, used, at = [], float("inf"), token
            while True:
                made = self.rank.get(at, -1)
                found.append((at, made, used))
                if at not in self.halves:
                    break
                used, at = made, self.halves[at][side]
            self._spines[token, side] = found
        return found

    def follows(self, a: int, b: int) -> bool:
        """stands(), kept."""
        if len(self.known) >= TABLE:
            self.known.clear()
        return self.known.setdefault((a, b), self.stands(a, b))

    def stands(self, a: int, b: int) -> bool:
        """Whether no merge crosses the boundary when the parts of a and b are merged side by side.

        A pair that meets at the boundary merges if its rank comes before both are used up inside their tokens;
        of equal ranks the one further left goes first.
        """
        stands = True
        for x, made_x, used_x in self._spine(a, 1):
            for y, made_y, used_y in self._spine(b, 0):
                rank = self.pairs.get((x, y))
                if rank is not None and rank < used_x and rank <= used_y and max(made_x, made_y) < min(used_x, used_y):
                    stands = False
        return stands


class Table:
    """Unsigned 64-bit keys to numbers from 0 on, read many at a time; -1 for keys that are not there. Key 0 is none."""

    def __init__(self):
        self.used, self.bits = 0, 16
        self._room()

    def _room(self) -> None:
        self.keys, self.values = np.zeros(1 << self.bits, np.uint64), np.full(1 << self.bits, -1, np.int64)

    def put(self, key: int, value: int) -> None:
        if 2 * self.used >= len(self.keys):
            old = [(k, v) for k, v in zip(self.keys.tolist(), self.values.tolist(), strict=True) if k]
            self.bits, self.used = self.bits + 1, 0
            self._room()
            for k, v in old:
                self.put(k, v)
        at = ((key * 0x9E3779B97F4A7C15) & 0xFFFFFFFFFFFFFFFF) >> (64 - self.bits)
        while (k := int(self.keys[at])) and k != key:
            at = (at + 1) % len(self.keys)
        self.keys[at], self.values[at] = key, value
        self.used += not k

    def get(self, keys: np.ndarray) -> np.ndarray:
        at = ((keys * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)
        there = self.keys[at]
        out = self.values[at]
        off = np.flatnonzero((there != keys) & (there != 0))
        out[there != keys] = -1
        while len(off):
            at[off] = (at[off] + 1) & (len(self.keys) - 1)
            there = self.keys[at[off]]
            hit = there == keys[off]
            out[off[hit]] = self.values[at[off[hit]]]
            off = off[~hit & (there != 0)]
        return out


class Generations(dict):
    """A table of at most 2 * TABLE entries: what was used since the last turn outlives the next one."""

    def __init__(self):
        super().__init__()
        self.old: dict = {}

    def recall(self, key):
        """An entry of either generation, or None."""
        x = self.get(key)
        if x is None and (x := self.old.get(key)) is not None:
            self.put(key, x)
        return x

    def put(self, key, x):
        if len(self) >= TABLE:
            self.old = dict(self)
            self.clear()
        self[key] = x
        return x


class Transducer:
    """The table of states, and what leaves it: ids of pieces by state, and of single words that are not in it."""

    def __init__(self, merges: Merges, library: Library, folds_case: bool):
        self.merges, self.library, self.folds_case = merges, library, folds_case
        # Bytes to classes: 0 is white space, 1 leads to the library.
        self.classes = np.ones(256, dtype=np.uint8)
        self.classes[list(_SPACES)] = 0
        special = {t["content"].encode()[0] for t in library.spec.get("added_tokens") or []}
        starts = sorted({b for b in [*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x41, 0x5B), *map(ord, _MARKS), 0xC3]} - special)
        fold = (lambda b: b + 0x20 if 0x41 <= b <= 0x5A else b) if folds_case else (lambda b: b)
        trails = [b for b in range(0x80, 0xC0) if b not in (0x97, 0xB7)]
        fold_trail = (lambda b: b + 0x20 if 0x80 <= b <= 0x9E else b) if folds_case else (lambda b: b)
        kinds = sorted({fold(b) for b in starts})
        tails = sorted({fold_trail(b) for b in trails})
        for b in starts:
            self.classes[b] = 2 + kinds.index(fold(b))
        for b in trails:
            self.classes[b] = 2 + len(kinds) + tails.index(fold_trail(b))
        self.width = 2 + len(kinds) + len(tails)
        self.class_of = self.classes.tolist()
        self.kinds, self.letters = kinds, {fold(b) for b in starts if chr(b).isalpha() and b < 0x80} | {0xC3}
        self.kind_of = np.array([0, 1] + [{"letter": 2, "digit": 3, "mark": 4}[self._kind(b)] for b in kinds] + [2] * len(tails), dtype=np.uint8)
        # Classes back to folded bytes, and tokens by their packed classes, final ones flagged. Pieces with a token that
        # is too long for a key are spelled one by one unless they are in the table.
        self.shift = 7 if self.width <= 128 else 8
        self.packed = 63 // self.shift
        self.byte_of = dict(enumerate([*kinds, *tails], 2))
        class_by_byte = {b: c for c, b in self.byte_of.items()}
        self.tokens, self.pairs = Table(), Table()
        for flag, table in ((0, merges.inner), (1 << 63, merges.final)):
            for text, token in table.items():
                if len(text) <= self.packed and all(b in class_by_byte for b in text):
                    self.tokens.put(flag | sum(class_by_byte[b] << self.shift * i for i, b in enumerate(reversed(text))), token)
        self.words = Generations()
        self.clear()

    def clear(self) -> None:
        self.delta = np.zeros(STATES * self.width, dtype=np.int32)
        self.first = np.zeros(STATES, dtype=bool)
        self.entry = np.zeros(STATES, dtype=np.int32)
        self.child: dict[int, int] = {}
        self.last: list[tuple[int, int] | None] = [None, None]
        self.num, self.flat = [0], []
        self.leaving: dict[str, np.ndarray] = {}
        for b in self.kinds:
            state = self._state(START, b, b"" if b == 0xC3 else bytes([b]), [START])
            self.first[state] = True
        # What leaves a piece leads to the first state of the next one.
        for kind in ("letter", "digit", "mark"):
            row = np.zeros(self.width, dtype=np.int32)
            for c in self.kinds:
                if kind == "digit" or self._kind(c) != kind:
                    row[self.class_of[c]] = self.child[START << 8 | c]
            self.leaving[kind] = row
        for b in self.kinds:
            state = self.child[START << 8 | b]
            self.delta[state * self.width : (state + 1) * self.width] = self.leaving[self._kind(b)]
            if b != 0xC3:
                self._end(state, bytes([b]))

    def _kind(self, b: int) -> str:
        return "letter" if b in self.letters else "digit" if 0x30 <= b <= 0x39 else "mark"

    def _last(self, piece: bytes, at: int, lasts: list, table: dict[bytes, int]) -> tuple[int, int]:
        """(token, length) that the encoding of piece[:at] ends in; lasts[i] is that of piece[:i]."""
        known, follows = self.merges.known, self.merges.follows
        for begin in range(at - 1, max(-1, at - self.merges.longest - 1), -1):
            token = table.get(piece[begin:at])
            if token is not None:
                if not begin:
                    return token, at
                stands = known.get((before := lasts[begin][0], token))
                if stands or stands is None and follows(before, token):
                    return token, at - begin
        raise ValueError(f"no token ends in {piece[:at]!r}")

    def _state(self, parent: int, b: int, piece: bytes, path: list[int]) -> int:
        state = len(self.last)
        self.child[parent << 8 | b] = state
        self.delta[parent * self.width + self.class_of[b]] = state
        if self.leaving:
            self.delta[state * self.width : (state + 1) * self.width] = self.leaving[self._kind(piece[0])]
        self.last.append(self._last(piece, len(piece), [self.last[s] for s in path], self.merges.inner) if piece else (self.merges.inner[bytes([b])], 1))
        return state

    def _end(self, state: int, piece: bytes) -> None:
        """A piece may end in this state: keep what it emits."""
        ids = self.spell(piece)
        self.entry[state] = len(self.num)
        self.num.append(len(ids))
        self.flat += ids

    def spell(self, piece: bytes) -> list[int]:
        """The ids of a piece, from the states it passes and, beyond them, from prefixes followed for it alone."""
        lasts, state = [None], START
        for at in range(1, len(piece)):
            state = self.child.get(state << 8 | piece[at - 1]) if state else None
            lasts.append(self.last[state] if state else self._last(piece, at, lasts, self.merges.inner))
        token, size = self._last(piece, len(piece), lasts, self.merges.final)
        out, at = [token], len(piece) - size
        while at:
            token, size = lasts[at]
            out.append(token)
            at -= size
        return out[::-1]

    def add(self, piece: bytes) -> None:
        """Give a piece a path of states."""
        state, path = START, [START]
        for at, b in enumerate(piece, 1):
            after = self.child.get(state << 8 | b)
            if after is None:
                if len(self.last) >= STATES:
                    return
                after = self._state(state, b, piece[:at], path)
            state = after
            path.append(state)
        if not self.entry[state]:
            self._end(state, piece)

    def _library_ids(self, word: bytes) -> bytes:
        """The ids of a word that is not compiled, as unsigned 32-bit numbers."""
        ids = self.words.recall(word)
        if ids is None:
            ids = np.array(self.library.encode(word.decode("utf-8", "replace")), dtype="<u4").tobytes()
            if len(word) <= 4 * LONGEST:
                self.words.put(word, ids)
        return ids

    def _spell_all(self, cls: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """spell() for many pieces in step, by their classes: (number of tokens of each, all tokens in order).

        At each prefix the candidates are tried from the shortest on; the one that may follow is the last token.
        """
        order = np.argsort(sizes, kind="stable")
        at0, size = starts[order], sizes[order].astype(np.int64)
        n, longest = len(order), int(size[-1]) if len(order) else 0
        last, length = np.zeros((longest + 1, n), np.int64), np.zeros((longest + 1, n), np.int64)
        hard: set[int] = set()
        for at in range(1, longest + 1):
            lane = np.arange(int(np.searchsorted(size, at)), n)
            end_flag = (size[lane] == at).astype(np.uint64) << np.uint64(63)
            key = np.zeros(len(lane), dtype=np.uint64)
            for span in range(1, min(at, self.packed) + 1):
                key |= cls[at0[lane] + (at - span)].astype(np.uint64) << np.uint64(self.shift * (span - 1))
                token = self.tokens.get(key | end_flag)
                there = token >= 0
                if span < at:
                    there[there] = self._follow_all(last[at - span][lane[there]], token[there])
                done = lane[there]
                last[at][done], length[at][done] = token[there], span
                lane, key, end_flag = lane[~there], key[~there], end_flag[~there]
                if not len(lane):
                    break
            if len(lane):  # a token beyond the packed keys: such pieces are spelled one by one
                hard.update(lane.tolist())
                length[at][lane], last[at][lane] = at, 0
        place, steps, many = size.copy(), [], np.zeros(n, np.int64)
        lane = np.arange(n)
        while len(lane):
            steps.append((lane, last[place[lane], lane]))
            many[lane] += 1
            place[lane] -= length[place[lane], lane]
            lane = lane[place[lane] > 0]
        slow = {}
        for i in hard:
            piece = bytes(self.byte_of[c] for c in cls[at0[i] : at0[i] + size[i]].tolist())
            slow[i] = self.spell(piece)
            many[i] = len(slow[i])
        num = np.zeros(n, np.int64)
        num[order] = many
        begin = (np.cumsum(num) - num)[order]
        flat = np.zeros(int(num.sum()), dtype="<u4")
        easy = np.ones(n, dtype=bool)
        easy[list(hard)] = False
        for k, (lane, tokens) in enumerate(steps):
            keep = easy[lane]
            flat[begin[lane[keep]] + many[lane[keep]] - 1 - k] = tokens[keep]
        for i, ids in slow.items():
            flat[begin[i] : begin[i] + len(ids)] = ids
        return num, flat

    def _follow_all(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        key = (a.astype(np.uint64) << np.uint64(24)) | b.astype(np.uint64)
        stands = self.pairs.get(key)
        if len(new := np.flatnonzero(stands < 0)):
            for k in np.unique(key[new]).tolist():
                self.pairs.put(k, self.merges.stands(k >> 24, k & 0xFFFFFF))
            stands = self.pairs.get(key)
        return stands == 1

    def _learn(self, data: bytes, starts: np.ndarray, sizes: np.ndarray) -> None:
        """Pieces that a batch misses twice enter the table while it has room."""
        if len(self.last) >= STATES or not len(starts):
            return
        name = np.zeros(len(starts), dtype=np.uint64)
        buf = np.frombuffer(data, dtype=np.uint8)
        for step in range(int(sizes.max())):
            on = sizes > step
            name[on] = (name[on] + buf[starts[on] + step]) * np.uint64(0x9E3779B97F4A7C15)
        _, first, often = np.unique(name, return_index=True, return_counts=True)
        for i in first[often > 1].tolist():
            piece = data[starts[i] : starts[i] + sizes[i]]
            if self.folds_case:
                piece = piece.decode().lower().encode()
            self.add(piece)

    def run(self, data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """All words of data at once, one byte of each a step: where pieces end, the entry of each, entries' sizes and ids.

        Pieces that leave the table, and words that only the library knows, get entries after those of the table.
        """
        cls = self.classes[np.frombuffer(data, dtype=np.uint8)]
        edges = np.diff(np.concatenate(([0], (cls != 0).view(np.int8), [0])))
        starts, ends = np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)
        sizes = np.minimum(ends - starts, LONGEST + 1).astype(np.uint8)
        order = np.argsort(sizes, kind="stable")
        at, ordered = starts[order], sizes[order]
        state = np.full(len(at), START, dtype=np.int64)
        stop = np.zeros(len(cls) + 1, dtype=np.int32)
        for step in range(int(ordered[-1]) if len(ordered) else 0):
            k = int(np.searchsorted(ordered, step, "right"))
            here = at[k:] + step
            old = state[k:]
            new = self.delta[old * self.width + cls[here]]
            if step:
                left = self.first[new]
                stop[here[left] - 1] = old[left]
            state[k:] = new
        stop[ends[order] - 1] = state
        where = np.flatnonzero(stop)
        entry = self.entry[stop[where]]
        unknown = np.zeros(len(starts), dtype=bool)
        unknown[order] = (state == MISSING) | (ordered > LONGEST)
        if len(starts):
            unknown[np.searchsorted(starts, where[entry == 0], "right") - 1] = True
        num = np.asarray(self.num, dtype=np.int64)
        flat = np.asarray(self.flat, dtype="<u4")
        if not unknown.any():
            return where, entry, num, flat
        foreign = np.concatenate(([0], np.cumsum(cls == 1)))
        plain = unknown & (sizes <= LONGEST) & (foreign[ends] == foreign[starts])
        others = np.flatnonzero(unknown & ~plain)
        inside = np.zeros(len(cls) + 1, dtype=np.int8)
        inside[starts[unknown]] = 1
        inside[ends[unknown]] -= 1
        known = np.cumsum(inside, dtype=np.int8)[where] == 0
        inside[starts[others]] = 0
        inside[ends[others]] += 1
        spelled = np.cumsum(inside, dtype=np.int8)[:-1] > 0
        kind = self.kind_of[cls]
        differs = np.concatenate(([True], kind[1:] != kind[:-1], [True]))
        digit = kind == 3
        begins = np.flatnonzero(spelled & (differs[:-1] | digit))
        stops = np.flatnonzero(spelled & (differs[1:] | digit)) + 1
        count, ids = self._spell_all(cls, begins, stops - begins)
        a, b = starts[others].tolist(), ends[others].tolist()
        found = [self._library_ids(data[i:j]) for i, j in zip(a, b, strict=True)]
        place = np.zeros(len(cls) + 1, dtype=np.int32)
        place[where[known]] = entry[known]
        place[stops - 1] = len(num) + np.arange(len(stops))
        place[ends[others] - 1] = len(num) + len(stops) + np.arange(len(others))
        where = np.flatnonzero(place)
        if len(self.last) >= STATES and 4 * np.count_nonzero(unknown) > len(starts):
            self.stale = True
        self._learn(data, begins, stops - begins)
        num = np.concatenate((num, count, np.fromiter(map(len, found), np.int64, len(found)) // 4))
        return where, place[where], num, np.concatenate((flat, ids, np.frombuffer(b"".join(found), dtype="<u4")))

    stale = False

    def refresh(self) -> None:
        """A full table that a quarter of the words miss is built anew."""
        if self.stale:
            self.clear()
            self.stale = False


class StateMap(NamedTuple):
    """A chunk's effect: head and tail are its words open to the left and right; without a boundary all is head."""

    head: bytes
    count: int
    tail: bytes | None  # None: the chunk has no white space


class Counter:
    """Tokens of whole texts and state maps of chunks; tokenizers that are not compiled go to the library."""

    def __init__(self, name: str):
        self.library = Library(name)
        folds = self.library.folds_case()
        # The vocabulary is held by the library and the compilation, the file's own text of it by nobody.
        model = self.library.spec.pop("model", None)
        self.transducer = None if folds is None else Transducer(Merges(model), self.library, folds)

    def _sums(self, data: bytes, ends: np.ndarray) -> np.ndarray:
        """Tokens before each of the given places."""
        self.transducer.refresh()
        where, entry, num, _ = self.transducer.run(data)
        sums = np.concatenate(([0], np.cumsum(num[entry])))
        return sums[np.searchsorted(where, ends)]

    def counts(self, texts: list[bytes]) -> list[int]:
        if self.transducer is None:
            return [len(self.library.encode(t.decode("utf-8", "replace"))) for t in texts]
        ends = np.cumsum([len(t) + 1 for t in texts])
        return np.diff(self._sums(b"\n".join(texts) + b"\n", ends), prepend=0).tolist()

    def state_map(self, chunk: bytes) -> StateMap:
        m = re.search(rb"[\x20\x09-\x0D]", chunk)
        if m is None:
            return StateMap(chunk, 0, None)
        inner = chunk[m.start() :]
        body = inner[: len(inner) - len(re.search(rb"[^\x20\x09-\x0D]*\Z", inner)[0])] if not inner[-1:].isspace() else inner
        return StateMap(chunk[: m.start()], self.counts([body])[0], inner[len(body) :])

    def compose(self, a: StateMap, b: StateMap) -> StateMap:
        if a.tail is None:
            return StateMap(a.head + b.head, b.count, b.tail)
        if b.tail is None:
            return StateMap(a.head, a.count, a.tail + b.head)
        joined = a.tail + b.head
        return StateMap(a.head, a.count + (self.counts([joined])[0] if joined else 0) + b.count, b.tail)

    def total(self, maps: list[StateMap]) -> int:
        """The count of a text from the maps of its chunks, composed in pairs level by level."""
        while len(maps) > 1:
            maps = [self.compose(*maps[i : i + 2]) if i + 1 < len(maps) else maps[i] for i in range(0, len(maps), 2)]
        return sum([maps[0].count, *self.counts([maps[0].head, maps[0].tail or b""])])

    def ids(self, texts: list[bytes], end_id: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """All ids one after another as unsigned 32-bit numbers, each text followed by end_id, and where each text ends."""
        tail = [] if end_id is None else [end_id]
        if self.transducer is None:
            each = [[*self.library.encode(t.decode("utf-8", "replace")), *tail] for t in texts]
            return np.fromiter((i for e in each for i in e), "<u4"), np.cumsum([len(e) for e in each])
        self.transducer.refresh()
        ends = np.cumsum([len(t) + 1 for t in texts])
        where, entry, num, flat = self.transducer.run(b"\n".join(texts) + b"\n")
        num = np.append(num, len(tail))
        off = np.cumsum(num) - num
        flat = np.append(flat, np.asarray(tail, dtype="<u4"))
        place = np.insert(entry, at := np.searchsorted(where, ends), len(num) - 1) if tail else entry
        many = num[place]
        sums = np.cumsum(many)
        ids = flat[np.repeat(off[place] - sums + many, many) + np.arange(sums[-1] if len(sums) else 0)]
        last = np.searchsorted(where, ends) if not tail else at + np.arange(1, len(at) + 1)
        return ids, np.concatenate(([0], sums))[last]


_compiled: dict[str, Counter] = {}


def counter(name: str) -> Counter:
    """This worker's compilation of a tokenizer."""
    if name not in _compiled:
        _compiled[name] = Counter(name)
    return _compiled[name]


_MAP = pa.schema([("text_no", pa.int64()), ("part", pa.int32()), ("head", pa.binary()), ("count", pa.int64()), ("tail", pa.binary())])


def token_counts(docs: DataFrame, tokenizer: str, limit: int = 2048, id_col: str = "doc_id", text_col: str = "text", section: int = SECTION) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit for every row, as the library counts the whole text.

    tokenizer: a file's path, or a public tokenizer's file name, resolved on each machine. No begin, end or
    added tokens; special strings inside texts are handled as the library does by default. Null and empty
    texts have 0 tokens. Repeated rows are counted each; a null id stays null; other columns are not read.
    An empty table gives an empty result. Tokenizers that are not compiled (see Library.folds_case) are run on the
    whole text. One pass without a shuffle; only the chunks of texts beyond `section` bytes are dealt over tasks.
    """
    schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_tokens", pa.int64()), ("text_no", pa.int64()), ("part", pa.int32()), ("chunk", pa.binary())])

    def run(batches):
        own, long_texts = counter(tokenizer), TaskContext.get().partitionId() << 33
        for ids, texts in byte_slices(batches, 1, section):
            whole = [t if len(t) <= section or own.transducer is None else b"" for t in texts]
            counts = own.counts(whole)
            cols = [ids, [len(t) for t in texts], counts, [None] * len(ids), [None] * len(ids), [None] * len(ids)]
            for i, (text, part) in enumerate(zip(texts, whole, strict=True)):
                if len(text) > len(part):
                    cols[2][i], cols[3][i] = None, long_texts
                    for k, at in enumerate(range(0, len(text), section)):
                        chunk = [[ids[i]], [len(text)], [None], [long_texts], [k], [text[at : at + section]]]
                        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(chunk, schema, strict=True)], schema=schema)
                    long_texts += 1
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, schema, strict=True)], schema=schema)

    def chunk_maps(batches):
        own = counter(tokenizer)
        for batch in batches:
            for no, part, chunk in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                m = own.state_map(chunk)
                yield pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip((no, part, *m), _MAP, strict=True)], schema=_MAP)

    def composed(batches):
        own = counter(tokenizer)
        for batch in batches:
            totals = [own.total([StateMap(m["head"], m["count"], m["tail"]) for m in maps]) for maps in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(totals, pa.int64())], names=["text_no", "total"])

    d = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("_text"))
    rows = stored(arrow_map(d, run, "doc_id long, n_bytes long, n_tokens long, text_no long, part int, chunk binary"), "token-counts")
    chunks = rows.where("chunk is not null").select("text_no", "part", "chunk")
    counted = rows.where("chunk is null").select("doc_id", "n_bytes", "n_tokens", "text_no")
    if not chunks.isEmpty():
        maps = chunks.repartition(F.col("text_no"), F.col("part")).mapInArrow(chunk_maps, "text_no long, part int, head binary, count long, tail binary")
        listed = maps.groupBy("text_no").agg(F.array_sort(F.collect_list(F.struct("part", "head", "count", "tail"))).alias("maps"))
        totals = listed.mapInArrow(composed, "text_no long, total long")
        counted = counted.join(totals, "text_no", "left").withColumn("n_tokens", F.coalesce("n_tokens", "total"))
    return counted.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
