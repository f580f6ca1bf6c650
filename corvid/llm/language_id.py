"""Language identification by bit-sliced Bloom filters over byte n-grams.

One table of masks holds a Bloom filter for each language in one bit: the bitwise and of an n-gram's masks
gives all languages that contain it. A text's n-grams are looked up at once; the hits of each language,
corrected for its filter's false positives, decide.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import arrow_map

_U = np.uint64
SIZES = (3, 4, 5)
MAX_LANGUAGES = 64
UNDETERMINED = "und"


def grams(text: str) -> np.ndarray:
    """64-bit codes of the byte n-grams of the lower-cased text between single spaces; digits and ASCII marks count as spaces."""
    data = np.frombuffer(b" " + text.lower().encode("utf-8", "surrogatepass") + b" ", dtype=np.uint8)
    data = _PLAIN[data]
    space = data == 32
    data = data[np.concatenate(([True], ~(space[1:] & space[:-1])))]
    wide = data.astype(np.uint64)
    out = []
    for n in SIZES:
        if len(wide) >= n:
            code = np.full(len(wide) - n + 1, n, dtype=np.uint64)
            for j in range(n):
                code = (code << _U(8)) | wide[j : len(wide) - n + 1 + j]
            out.append(code)
    return np.concatenate(out) if out else np.empty(0, dtype=np.uint64)


_PLAIN = np.arange(256, dtype=np.uint8)
_PLAIN[[c for c in range(128) if not chr(c).isalpha()]] = 32


def has_letter(text: str) -> bool:
    return any(map(str.isalpha, text))


def _slots(codes: np.ndarray, hashes: int, slots: int) -> list[np.ndarray]:
    with np.errstate(over="ignore"):
        x = codes * _U(0x9E3779B97F4A7C15)
        x ^= x >> _U(29)
        y = x * _U(0xBF58476D1CE4E5B9)
        y ^= y >> _U(32)
        step = (x >> _U(17)) | _U(1)
        return [((y + step * _U(j)) & _U(slots - 1)).astype(np.int64) for j in range(hashes)]


@dataclass
class LanguageFilters:
    """languages in the order of their bits, and the masks by slot."""

    languages: list[str]
    masks: np.ndarray
    hashes: int

    @classmethod
    def build(cls, profiles: dict[str, np.ndarray], slots: int = 1 << 20, hashes: int = 3) -> LanguageFilters:
        languages = sorted(profiles)
        if len(languages) > MAX_LANGUAGES:
            raise ValueError(f"{len(languages)} languages; a mask has {MAX_LANGUAGES} bits")
        masks = np.zeros(slots, dtype=np.uint8 if len(languages) <= 8 else np.uint64)
        for bit, language in enumerate(languages):
            for at in _slots(profiles[language].astype(np.uint64), hashes, slots):
                masks[at] |= masks.dtype.type(1 << bit)
        return cls(languages, masks, hashes)

    def false_positives(self) -> np.ndarray:
        fill = np.array([np.count_nonzero(self.masks & self.masks.dtype.type(1 << b)) for b in range(len(self.languages))]) / len(self.masks)
        return fill**self.hashes

    def hits(self, text: str) -> tuple[np.ndarray, int]:
        """n-grams of the text that each language's filter contains, and all of them."""
        codes = grams(text)
        first, *rest = _slots(codes, self.hashes, len(self.masks))
        found = self.masks[first]
        for at in rest:
            found &= self.masks[at]
        if found.dtype == np.uint8:
            by_mask = np.bincount(found, minlength=256)
            return np.array([by_mask[_HAS[b]].sum() for b in range(len(self.languages))]), len(codes)
        return np.array([np.count_nonzero(found & _U(1 << b)) for b in range(len(self.languages))]), len(codes)

    def corrected(self, text: str) -> tuple[np.ndarray, int]:
        """Each language's hits without the expected false positives, and all n-grams."""
        hits, n = self.hits(text)
        if not hasattr(self, "_fp"):
            self._fp = self.false_positives()
        return np.clip((hits - n * self._fp) / (1 - self._fp), 0, None), n

    def predict(self, text: str | None) -> tuple[str, float]:
        """The language with most corrected hits (the first by name among equals), and their share of the n-grams."""
        if text is None or not self.languages or not has_letter(text):
            return UNDETERMINED, 0.0
        corrected, n = self.corrected(text)
        if not n:
            return self.languages[0], 0.0
        best = int(np.argmax(corrected))
        return self.languages[best], float(min(1.0, corrected[best] / n))


class LanguagePlanes(LanguageFilters):
    """Any number of languages: a plane of filters for each MAX_LANGUAGES of them, by name."""

    def __init__(self, planes: list[LanguageFilters]):
        self.planes = planes
        self.languages = [x for p in planes for x in p.languages]

    @classmethod
    def build(cls, profiles: dict[str, np.ndarray], **sizes: int) -> LanguageFilters:
        """One plane is plain filters."""
        names = sorted(profiles)
        planes = [LanguageFilters.build({x: profiles[x] for x in names[i : i + MAX_LANGUAGES]}, **sizes) for i in range(0, len(names), MAX_LANGUAGES)]
        return planes[0] if len(planes) == 1 else cls(planes)

    def corrected(self, text: str) -> tuple[np.ndarray, int]:
        found = [p.corrected(text) for p in self.planes]
        return np.concatenate([x for x, _ in found]), found[0][1]


_HAS = [np.flatnonzero((np.arange(256) >> b) & 1) for b in range(8)]


def held_out(id_col: str = "doc_id"):
    return (F.crc32(F.col(id_col).cast("string")) % 4) == 2


def fit_languages(labelled: DataFrame, text_col: str, lang_col: str, key_col: str, sample: int = 3000, profile: int = 20_000, share: float = 0.01) -> LanguageFilters:
    """Filters from rows with a label.

    sample: the expected number of rows per language (all, where there are fewer), picked by a hash of key_col;
    their whole texts are read. Null texts and null labels teach nothing, repeated rows count each, and without any
    row with both nothing is learned (every text is then UNDETERMINED); other columns are not read. profile: n-grams kept for a language, those in most of its sampled texts and in
    at least `share` of them. Any number of labels may occur; what reaches the driver is bounded by labels * profile n-grams,
    and the filters take 8 MB for each MAX_LANGUAGES of them.
    """
    rows = labelled.select(F.col(text_col).alias("_text"), F.col(lang_col).alias("_lang"), F.pmod(F.xxhash64(F.col(key_col), F.lit("lang")), F.lit(1 << 30)).alias("_key")).where("_text is not null and _lang is not null")
    sizes = {r["_lang"]: r["n"] for r in rows.groupBy("_lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not sizes:
        return LanguageFilters([], np.zeros(1 << 10, dtype=np.uint8), 1)
    most = F.create_map(*[x for lang, n in sizes.items() for x in (F.lit(lang), F.lit(int(min(1.0, sample / n) * (1 << 30))))])
    picked = rows.where(F.col("_key") < F.try_element_at(most, F.col("_lang"))).select("_text", "_lang")

    def count(batches):
        """Texts of each language that hold an n-gram, summed within a partition; the key 0 counts the texts."""
        totals: dict[str, dict[int, int]] = {}
        held = 0

        def flush():
            langs, codes, ns = [], [], []
            for lang, t in totals.items():
                langs += [lang] * len(t)
                codes += t.keys()
                ns += t.values()
            return pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), pa.array(codes, pa.int64()), pa.array(ns, pa.int64())], names=["lang", "code", "n"])

        for batch in batches:
            for text, lang in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
                own = totals.setdefault(lang, {})
                for code in [0, *np.unique(grams(text.as_py())).tolist()]:
                    own[code] = own.get(code, 0) + 1
            held = sum(map(len, totals.values()))
            if held > 500_000:
                yield flush()
                totals = {}
        if totals:
            yield flush()

    sums = arrow_map(picked, count, "lang string, code long, n long").groupBy("lang", "code").agg(F.sum("n").alias("n"))
    texts = sums.where("code = 0").select("lang", F.col("n").alias("texts"))
    common = sums.where("code <> 0").join(F.broadcast(texts), "lang").where(F.col("n") >= F.greatest(F.lit(1.0), F.col("texts") * share))
    top = common.withColumn("r", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "code"))).where(F.col("r") <= profile)
    codes: dict[str, list[int]] = {lang: [] for lang in sizes}
    for r in top.select("lang", "code").collect():
        codes[r["lang"]].append(r["code"])
    return LanguagePlanes.build({lang: np.array(c, dtype=np.int64) for lang, c in codes.items()})


def identify_languages(docs: DataFrame, filters: LanguageFilters, id_col: str = "doc_id", text_col: str = "text", extra: tuple[str, ...] = ()) -> DataFrame:
    """id, lang_pred, score (and extra columns) for every row, from the whole text alone.

    lang_pred is UNDETERMINED with score 0.0 for a null text, one without a letter, or without languages to
    choose from. Equal hits: the first language by name. The filters' size is fixed, so they are broadcast.
    """
    shared = docs.sparkSession.sparkContext.broadcast(filters)

    def run(batches):
        own = shared.value
        for batch in batches:
            found = [own.predict(x.as_py()) for x in batch.column(1)]
            keep = [batch.column(0), *(batch.column(i) for i in range(2, batch.num_columns))]
            names = [batch.schema.names[0], *batch.schema.names[2:]]
            yield pa.RecordBatch.from_arrays([*keep, pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.float64())], names=[*names, "lang_pred", "score"])

    d = docs.select(F.col(id_col), F.col(text_col), *extra)
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in d.schema if f.name != text_col)
    return arrow_map(d, run, f"{fields}, lang_pred string, score double")
