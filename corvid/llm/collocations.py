"""Phrase collocations, mined in partitions by pivots: an n-gram is counted where its rarest word is.

Every occurrence of a word sends the fragment around it in which no word is rarer; of equally rare ones the first is
the pivot. An n-gram thus lies in the fragment of one occurrence only, its pivot's. Equal fragments are summed before
the shuffle and after it, and the task that has all fragments of a pivot counts its n-grams and emits frequent ones.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import arrow_map, join_hot, stored

#: Bytes of text that are taken up at once, words or fragments that a task sums up, and fragments that it mines at once.
SECTION, ENTRIES, GRAMS = 1 << 20, 200_000, 300_000
#: Words whose order by frequency every task knows, and the bytes of the longest of them: at most LISTED times LONGEST and a language's name are broadcast.
LISTED, LONGEST, HOT_LONGEST = 300_000, 64, 4096
#: An occurrence's share of the table and number beyond which a pivot's fragments are dealt over several tasks.
HOT_PART, HOT_ROWS = 512, 1 << 24
#: The order of a place that no n-gram contains, and the smallest of a word that is not listed.
BREAK, UNLISTED = np.iinfo(np.int64).max, 1 << 32
#: Bits of a pivot's home that say which of its tasks it is.
SALT_BITS = 20
#: Spaces and tabs part words; a piece ends at the others, with A-Z in lower case.
_FOLD = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ\t.,;:!?\x0b\x0c\r", b"abcdefghijklmnopqrstuvwxyz " + b"\n" * 9)
_EDGE = re.compile(rb"[ \n]")


def _sections(batches, size: int):
    """(lang, folded text, begins, ends) of batches (lang, binary text).

    Texts of a language follow one another in a section. Longer ones are cut between words: their first section begins
    a stretch and the last one ends it.
    """
    for batch in batches:
        by_lang: dict[str, list[bytes]] = defaultdict(list)
        held: Counter = Counter()
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            data = text.as_py().translate(_FOLD)
            if len(data) > size:
                at = 0
                while at < len(data):
                    m = _EDGE.search(data, at + size)
                    end = m.start() if m else len(data)
                    yield lang, data[at:end], not at, end == len(data)
                    at = end
                continue
            by_lang[lang].append(data)
            held[lang] += len(data)
            if held[lang] > size:
                yield lang, b"\n".join(by_lang.pop(lang)), True, True
                held[lang] = 0
        for lang, texts in by_lang.items():
            yield lang, b"\n".join(texts), True, True


_WORD = pa.schema([("lang", pa.string()), ("word", pa.string()), ("n", pa.int64())])


def _word_counts(section: int):
    def rows(counts):
        flat = [(lang, w.decode("utf-8", "replace"), n) for lang, of in counts.items() for w, n in of.items()]
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in flat], f.type) for i, f in enumerate(_WORD)], schema=_WORD)

    def run(batches):
        counts: dict[str, Counter] = defaultdict(Counter)
        for lang, data, _, _ in _sections(batches, section):
            counts[lang].update(w for w in data.replace(b"\n", b" ").split(b" ") if w)
            if sum(map(len, counts.values())) > ENTRIES:
                yield rows(counts)
                counts.clear()
        yield rows(counts)

    return run


class Order:
    """The order of a language's words by rarity.

    Listed words have numbers, the most frequent the smallest one, that no two languages share. Where they are all words
    that are frequent enough, the others are breaks; else these come after them in the order of a hash.
    """

    def __init__(self, listed: list[tuple[str, bytes]], complete: bool):
        self.numbers: dict[str, dict[bytes, int]] = defaultdict(dict)
        for i, (lang, word) in enumerate(listed):
            self.numbers[lang][word] = i
        self.complete = complete

    def of(self, lang: str, words: list[bytes]) -> np.ndarray:
        """The order of words; -1 for empty ones, BREAK for ends of pieces and words that no frequent n-gram contains."""
        get = self.numbers.get(lang, {}).get
        if self.complete:
            return np.fromiter((get(w, BREAK) if w else -1 for w in words), np.int64, len(words))
        return np.fromiter(((r if (r := get(w)) is not None else BREAK if w == b"\n" else beyond(w)) if w else -1 for w in words), np.int64, len(words))


def beyond(word: bytes) -> int:
    """The order of a word that is not listed."""
    return UNLISTED + (xxhash.xxh3_64_intdigest(word) >> 2)


def extents(order: np.ndarray, reach: int) -> tuple[np.ndarray, np.ndarray]:
    """How far to the left, and to the right, the words around a place are not rarer; on the left not equally rare either."""
    m = len(order)
    left, right = np.zeros(m, dtype=np.int64), np.zeros(m, dtype=np.int64)
    on_left = on_right = order != BREAK
    for j in range(1, reach + 1):
        if j >= m:
            break
        on_left = on_left & np.concatenate((np.zeros(j, bool), order[:-j] < order[j:]))
        on_right = on_right & np.concatenate((order[j:] <= order[:-j], np.zeros(j, bool)))
        left += on_left
        right += on_right
    return left, right


def grouped(rows: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Equal rows of a matrix of unsigned numbers: the index of one of each, the sums of n, and each row's group."""
    name = np.zeros(len(rows), dtype=np.uint64)
    for c in range(rows.shape[1]):
        name = (name + rows[:, c] + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
        name ^= name >> np.uint64(29)
    order = np.argsort(name)
    new = np.ones(len(rows), dtype=bool)
    new[1:] = (rows[order[1:]] != rows[order[:-1]]).any(axis=1)
    if (new[1:] & (name[order[1:]] == name[order[:-1]])).any():
        # Two different rows have one name, and may lie mixed.
        order = np.lexsort(rows.T)
        new[1:] = (rows[order[1:]] != rows[order[:-1]]).any(axis=1)
    begins = np.flatnonzero(new)
    group = np.empty(len(rows), dtype=np.int64)
    group[order] = np.cumsum(new) - 1
    return order[begins], np.add.reduceat(n[order], begins) if len(begins) else n[:0], group


def packed(rows: np.ndarray) -> pa.Array:
    """A binary array of a matrix's rows."""
    rows = np.ascontiguousarray(rows, dtype="<u4")
    offsets = np.arange(len(rows) + 1, dtype=np.int32) * (4 * rows.shape[1])
    return pa.Array.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer(offsets), pa.py_buffer(rows)])


_FRAGMENT = pa.schema([("home", pa.int64()), ("words", pa.binary()), ("n", pa.int64())])


def _spelled(lang: str, at: int, words: bytes) -> bytes:
    """A fragment around an unlisted pivot: its place, its language and the words themselves."""
    own = lang.encode("utf-8", "surrogatepass")
    return bytes([at]) + len(own).to_bytes(4, "little") + own + words


def _fragments(listed, complete: bool, deal: dict[int, int], reach: int, section: int):
    """Batches (lang, text) to sums of fragments.

    Around a listed pivot all words are listed: a fragment is the pivot's place in it and the words' numbers. Around
    others it is spelled. home is the pivot, and for pivots that are dealt over tasks which of these it goes to.
    """

    def numbered(found):
        for matrices in found.values():
            rows = np.concatenate(matrices)
            first, n, _ = grouped(rows, np.ones(len(rows), dtype=np.int64))
            rows = rows[first]
            pivot = rows[np.arange(len(rows)), 1 + rows[0, 0]].astype(np.int64)
            home = pivot << SALT_BITS
            for p, tasks in deal.items():
                own = np.flatnonzero(pivot == p)
                if len(own):
                    mixed = (rows[own].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) ** np.arange(1, rows.shape[1] + 1, dtype=np.uint64)).sum(axis=1, dtype=np.uint64)
                    home[own] += ((mixed >> np.uint64(33)) % np.uint64(tasks)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(home), packed(rows), pa.array(n)], schema=_FRAGMENT)

    def spelled(counts):
        cols = [[], [], []]
        for (lang, at), of in counts.items():
            for words, n in of.items():
                home = -1 - (xxhash.xxh3_64_intdigest(lang.encode("utf-8", "surrogatepass") + b"\n" + words.split(b" ")[at]) >> 2)
                for col, x in zip(cols, (home, _spelled(lang, at, words), n), strict=True):
                    col.append(x)
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, _FRAGMENT, strict=True)], schema=_FRAGMENT)

    def run(batches):
        order = Order(listed.value, complete)
        found: dict[tuple[int, int], list[np.ndarray]] = defaultdict(list)
        counts: dict[tuple[str, int], Counter] = defaultdict(Counter)
        kept: list[bytes] = []
        done = held = 0
        for lang, data, begins, ends in _sections(batches, section):
            words = data.replace(b"\n", b" \n ").split(b" ")
            if not begins:
                words = kept + words
            ranks = order.of(lang, words)
            there = np.flatnonzero(ranks >= 0)
            ranks = ranks[there]
            left, right = extents(ranks, reach)
            # Places whose words to the right are in the next section wait for it, with the words to their left.
            first = 0 if begins else done
            last = len(ranks) if ends else max(first, len(ranks) - reach)
            on = np.flatnonzero(left + right)
            on = on[(on >= first) & (on < last)]
            of_list = on[ranks[on] < UNLISTED]
            shape = left[of_list] * (reach + 1) + right[of_list]
            by_shape = of_list[np.argsort(shape, kind="stable")]
            sizes = np.bincount(shape, minlength=(reach + 1) ** 2)
            for k, end in zip(np.flatnonzero(sizes).tolist(), np.cumsum(sizes)[sizes > 0].tolist(), strict=True):
                at, after = divmod(k, reach + 1)
                here = by_shape[end - sizes[k] : end]
                rows = np.empty((len(here), at + after + 2), dtype=np.uint32)
                rows[:, 0] = at
                for c in range(at + after + 1):
                    rows[:, 1 + c] = ranks[here + (c - at)]
                found[at, after].append(rows)
                held += len(rows)
            for i in on[ranks[on] >= UNLISTED].tolist():
                at = int(left[i])
                counts[lang, at][b" ".join([words[there[j]] for j in range(i - at, i + int(right[i]) + 1)])] += 1
                held += 1
            done = min(reach, last)
            kept = [words[j] for j in there[last - done :].tolist()]
            if held > ENTRIES:
                yield from numbered(found)
                yield from spelled(counts)
                found.clear()
                counts.clear()
                held = 0
        yield from numbered(found)
        yield from spelled(counts)

    return run


_GRAM = pa.schema([("lang", pa.string()), ("phrase", pa.binary()), ("n", pa.int64())])


def _grams(rows: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.nulls(len(rows), pa.string()), packed(rows), pa.array(n)], schema=_GRAM)


def _mine_numbered(flat: np.ndarray, begins: np.ndarray, sizes: np.ndarray, n: np.ndarray, whole: np.ndarray, least: int, longest: int):
    """The n-grams around the pivots of fragments (place, numbers ...) that begin at `begins` in flat.

    Where a task has all fragments of the pivots (whole), only n-grams leave that occur `least` times, and what is longer
    than a rare one is not looked at. Parts of pivots leave all.
    """
    at = flat[begins].astype(np.int64)
    pivot, left, right = begins + 1 + at, at.copy(), sizes - 2 - at

    def count(i, j):
        on = np.flatnonzero((left >= i) & (right >= j))
        if not len(on):
            return None
        rows = np.empty((len(on), i + j + 1), dtype=np.uint32)
        for c in range(-i, j + 1):
            rows[:, i + c] = flat[pivot[on] + c]
        first, sums, group = grouped(rows, n[on])
        leaves = (sums >= least) | ~whole[on[first]]
        rare = on[~leaves[group]]
        if not i:
            right[rare] = j - 1
        elif not j:
            left[rare] = i - 1
        return _grams(rows[first[leaves]], sums[leaves]) if leaves.any() else None

    shapes = [(0, j) for j in range(1, longest)] + [(i, 0) for i in range(1, longest)]
    shapes += [(i, j) for i in range(1, longest - 1) for j in range(1, longest - i)]
    for i, j in shapes:
        if (batch := count(i, j)) is not None:
            yield batch


def _mine_spelled(rows, least: int, longest: int, whole: bool):
    """The n-grams around the pivots of spelled fragments: batches of one language each."""
    counts: dict[str, dict[bytes, int]] = defaultdict(lambda: defaultdict(int))
    for fragment, n in rows:
        size = int.from_bytes(fragment[1:5], "little")
        at, lang, words = fragment[0], fragment[5 : 5 + size].decode("utf-8", "surrogatepass"), fragment[5 + size :].split(b" ")
        for i in range(at + 1):
            for j in range(max(at + 1, i + 2), min(len(words), i + longest) + 1):
                counts[lang][b" ".join(words[i:j])] += n
    for lang, of in counts.items():
        kept = [(w, n) for w, n in of.items() if n >= least or not whole]
        yield pa.RecordBatch.from_arrays([pa.array([lang] * len(kept), pa.string()), pa.array([w for w, _ in kept], pa.binary()), pa.array([n for _, n in kept], pa.int64())], schema=_GRAM)


def _mine(deal: dict[int, int], least: int, longest: int, most: int):
    """Fragments sorted by home to n-grams: whole pivots together, `most` fragments at once, larger pivots in parts."""

    def solve(table: pa.Table, parts: set[int]):
        if not table.num_rows:
            return
        chunk = table.combine_chunks().to_batches()[0]
        homes, n = chunk.column(0).to_numpy(), chunk.column(2).to_numpy()
        numbered = int(np.searchsorted(homes, 0))
        if numbered:
            split = np.isin(homes[:numbered], list(parts))
            for on in (np.flatnonzero(split), np.flatnonzero(~split)):
                rows = ((chunk.column(1)[i].as_py(), int(n[i])) for i in on.tolist())
                yield from _mine_spelled(rows, least, longest, not split[on].any())
        if numbered < len(homes):
            words = chunk.column(1).slice(numbered)
            offsets = np.frombuffer(words.buffers()[1], dtype=np.int32)[words.offset : words.offset + len(words) + 1].astype(np.int64)
            flat = np.frombuffer(words.buffers()[2], dtype=np.uint8)[offsets[0] : offsets[-1]].view("<u4")
            begins = (offsets[:-1] - offsets[0]) // 4
            own = homes[numbered:]
            whole = ~np.isin(own >> SALT_BITS, list(deal)) & ~np.isin(own, list(parts))
            yield from _mine_numbered(flat, begins, np.diff(offsets) // 4, n[numbered:], whole, least, longest)

    def run(batches):
        held: list[pa.RecordBatch] = []
        rows, parts = 0, set()
        for batch in batches:
            held.append(batch)
            rows += batch.num_rows
            if rows <= most:
                continue
            table = pa.Table.from_batches(held)
            homes = table.column(0).to_numpy()
            last = int(np.searchsorted(homes, homes[-1]))
            if not last:
                # One pivot alone is more than is held at once.
                parts = {int(homes[-1])}
                last = rows
            yield from solve(table.slice(0, last), parts)
            held, rows = table.slice(last).to_batches(), rows - last
        if held:
            yield from solve(pa.Table.from_batches(held), parts)

    return run


def _decode(listed):
    """N-grams of listed words back to their language and words."""
    schema = pa.schema([("lang", pa.string()), ("phrase", pa.string()), ("n_words", pa.int32()), ("n", pa.int64())])

    def run(batches):
        names = listed.value
        for batch in batches:
            out = [[], [], []]
            for lang, phrase in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if lang is None:
                    found = [names[i] for i in np.frombuffer(phrase, dtype="<u4").tolist()]
                    lang, phrase = found[0][0], b" ".join([w for _, w in found])
                for col, x in zip(out, (lang, phrase.decode("utf-8", "replace"), phrase.count(b" ") + 1), strict=True):
                    col.append(x)
            yield pa.RecordBatch.from_arrays([*(pa.array(c, f.type) for c, f in zip(out, schema, strict=False)), batch.column(2)], schema=schema)

    return run


def phrase_counts(docs: DataFrame, least: int = 100, longest: int = 5, lang_col: str = "lang", text_col: str = "text", listed: int = LISTED, section: int = SECTION, grams: int = GRAMS, hot_part: int = HOT_PART) -> tuple[DataFrame, DataFrame]:
    """(lang, phrase, n_words, n) of all words and of phrases up to `longest` words that occur `least` times, and (lang, n), all words of each language."""
    d = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"), F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("_text"))
    spark = docs.sparkSession
    counted = arrow_map(d, _word_counts(section), "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))
    words = stored(counted, "phrase-words")
    totals = stored(words.groupBy("lang").agg(F.sum("n").alias("n")), "phrase-totals")
    frequent = words.where(F.col("n") >= least)
    every = totals.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    line = min(HOT_ROWS, max(least, every // hot_part))
    # At most `listed` words reach the driver and the tasks, of at most LONGEST bytes each but for the few hot ones.
    short = frequent.where(F.octet_length("word") <= F.when(F.col("n") > line, HOT_LONGEST).otherwise(LONGEST))
    top = short.orderBy(F.col("n").desc(), "lang", "word").limit(listed).collect()
    complete = len(top) == frequent.count()
    deal = {i: min(-(-r["n"] // line), 1 << SALT_BITS) for i, r in enumerate(top) if r["n"] > line}
    shared = spark.sparkContext.broadcast([(r["lang"], r["word"].encode("utf-8")) for r in top])
    found = arrow_map(d, _fragments(shared, complete, deal, longest - 1, section), "home long, words binary, n long")
    # The sums of equal fragments need no further shuffle: they lie where their pivot's share does.
    summed = found.repartition("home").groupBy("home", "words").agg(F.sum("n").alias("n")).sortWithinPartitions("home")
    mined = summed.mapInArrow(_mine(deal, least, longest, grams), "lang string, phrase binary, n long")
    phrases = mined.groupBy("lang", "phrase").agg(F.sum("n").alias("n")).where(F.col("n") >= least)
    phrases = phrases.mapInArrow(_decode(shared), "lang string, phrase string, n_words int, n long")
    alone = frequent.select("lang", F.col("word").alias("phrase"), F.lit(1).alias("n_words"), "n")
    return stored(phrases.unionByName(alone), "phrase-counts"), totals


#: floor(1000 a n / (l r)), exact as long as a product has 38 digits at most.
SCORE = "(cast(a as decimal(19,0)) * cast(1000 * n as decimal(19,0))) div (cast(l as decimal(19,0)) * cast(r as decimal(19,0)))"


def key_of(phrase: str) -> Column:
    return F.struct("lang", F.expr(phrase).alias("phrase"))


def collocations(docs: DataFrame, least: int = 100, longest: int = 5, top: int = 2000, lang_col: str = "lang", text_col: str = "text", **mining) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: each language's first `top` phrases of 2 to `longest` words that occur `least` times.

    Words and pieces of texts are those of the module's patterns, A-Z in lower case. a, l and r are the occurrences of the
    phrase and of the two parts of its lowest-scoring cut, n all words of the language, score floor(1000 a n / (l r)).
    A phrase that lies in a longer one as frequent as itself is left out: then one that is longer by one word is as
    frequent too, so only these are looked at. Null languages are `und`; null and empty texts have no words; repeated
    rows count each; an empty table gives an empty result. Ties go by score, a and the bytes of the phrase. Other
    columns are not read.
    """
    known, totals = phrase_counts(docs, least, longest, lang_col, text_col, **mining)
    phrases = known.where("n_words > 1")
    inside = phrases.where("n_words > 2").select("lang", F.explode(F.expr("array(substring_index(phrase, ' ', n_words - 1), substring_index(phrase, ' ', 1 - n_words))")).alias("phrase"), "n")
    kept = phrases.join(inside, ["lang", "phrase", "n"], "left_anti")
    cuts = kept.withColumn("k", F.explode(F.expr("sequence(1, n_words - 1)")))
    cuts = cuts.withColumns({"lk": key_of("substring_index(phrase, ' ', k)"), "rk": key_of("substring_index(phrase, ' ', k - n_words)")})
    cuts = stored(cuts.withColumnRenamed("n", "a"), "phrase-cuts")
    # A word may begin or end very many phrases: how many decides whether it is joined by broadcast.
    uses = cuts.select(F.explode(F.array("lk", "rk")).alias("key")).groupBy("key").agg(F.count(F.lit(1)).alias("_n"))
    parts = stored(known.select(key_of("phrase").alias("key"), "n").join(uses, "key"), "phrase-parts")
    both = join_hot(cuts, parts.select(F.col("key").alias("lk"), F.col("n").alias("l"), "_n"), "lk").drop("_n")
    both = join_hot(both, parts.select(F.col("key").alias("rk"), F.col("n").alias("r"), "_n"), "rk").drop("_n")
    both = join_hot(both, totals.select("lang", "n", F.col("n").alias("_n")), "lang").drop("_n")
    scored = both.withColumn("score", F.expr(SCORE))
    least_cut = F.min(F.struct("score", "k", "l", "r")).alias("cut")
    scored = scored.groupBy("lang", "phrase", "a", "n").agg(least_cut).select("lang", "phrase", "a", "cut.l", "cut.r", "n", "cut.score")
    order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase")]
    # The first ones of each language are among the first ones of its parts.
    first = Window.partitionBy("lang", F.pmod(F.xxhash64("phrase"), F.lit(256))).orderBy(*order)
    scored = scored.withColumn("rank", F.row_number().over(first)).where(F.col("rank") <= top)
    ranked = scored.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= top)
    return ranked.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
