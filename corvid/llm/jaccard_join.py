"""N-gram Jaccard join by universe partition.

Two sets of sizes s and l with similarity at least num / den differ in at most H = (s + l)(den - num)/(den + num)
elements. For each band of sizes the universe of shingle hashes is cut into m segments; among any H + 1
segments of one set at least one equals the other's. A set therefore indexes a signature of each segment that
is not empty, and probes all but the most frequent ones: as many as it can spare (its slack). A set with too
few segments adds the neighbourhoods of its segments with one element deleted (and more elements, where that
is not enough), so that the sum of (deletions + 1) reaches H + 1. Candidates are verified on the whole sets.

Bands grow by 25/16, which is more than den / num: a set takes part in its own band and, as the larger set, in
the band below if that holds sizes from num / den of its own.
"""

from __future__ import annotations

from bisect import bisect_right
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import arrow_map, bitmap, bitmap_bits, discard, join_hot, maybe_in, stored
from .components import connected_components
from .shingles import intersection, mix, shingle_set

_U = np.uint64
#: 64-bit words of the parities of a set's classes of shingles.
PARITY = 16
#: Tasks over which a signature is dealt that holds more than a HOT_SHARE-th of all rows, and rows of one in a task of the last round.
SALTS, HOT_SHARE, BLOCK = 256, 10_000, 2_000
#: One set in so many is looked at to find such signatures; a signature that is missed is only not dealt.
LOOK, LOOK_LEAST = 32, 100
#: Sets of a signature that make it a crowd, and the parts of a crowd that give it a central pivot each.
CROWD, PARTS = 256, 1


def band_edges(limit: int = 1 << 40) -> list[int]:
    edges = [1]
    while edges[-1] < limit:
        edges.append(max(edges[-1] + 1, edges[-1] * 25 // 16))
    return edges


_EDGES = band_edges()


def bands_of(s: int, num: int, den: int) -> list[int]:
    """The own band of a size, then the bands below that hold partners."""
    own = bisect_right(_EDGES, s) - 1
    low = bisect_right(_EDGES, -(-num * s // den)) - 1
    return list(range(own, low - 1, -1))


def _plan(h: np.ndarray, band: int, own: bool, num: int, den: int) -> tuple[np.ndarray, np.ndarray, int, int]:
    """Segment of each element, start of each segment, elements to reach (H + 1), deletions (0: none are needed)."""
    top = _EDGES[band + 1] - 1
    m = top * (den - num) // num + 1
    seg = ((h >> _U(32)) * _U(m)) >> _U(32)
    starts = np.flatnonzero(np.concatenate(([True], seg[1:] != seg[:-1])))
    s = len(h)
    # The own band also meets larger partners from the band above, so theirs are not bounded by its top.
    partner = s * den // num if own else min(top, s)
    need = (s + partner) * (den - num) // (den + num) + 1
    depth = 0
    if len(starts) < need:
        sizes = np.diff(np.append(starts, s))
        while int(np.minimum(depth, sizes - 1).sum()) + len(sizes) < need and depth < sizes.max():
            depth += 1
    return seg, starts, need, depth


def slack_of(h: np.ndarray, band: int, own: bool, num: int, den: int) -> int:
    _, starts, need, _ = _plan(h, band, own, num, den)
    return max(0, len(starts) - need)


def signatures(h: np.ndarray, band: int, own: bool, num: int, den: int) -> np.ndarray:
    """Signatures of the segments of a sorted set in a band, with deletions where they are needed."""
    seg, starts, _, depth = _plan(h, band, own, num, den)
    with np.errstate(over="ignore"):
        x = mix(h + _U(0x5851F42D4C957F2D))
        sums = np.add.reduceat(x, starts)
        place = mix(seg[starts] * _U(0x2545F4914F6CDD1D) + _U(band + 1) * _U(0xDA942042E4DD58B5))
        out = [mix(sums ^ place)]
        if depth:
            sizes = np.diff(np.append(starts, len(h)))
            of = np.repeat(np.arange(len(starts)), sizes)
            one = sizes[of] > 1
            out.append(mix((sums[of] - x)[one] ^ place[of][one]))
            for k in range(2, depth + 1):
                for i in np.flatnonzero(sizes > k):
                    part = x[starts[i] : starts[i] + sizes[i]]
                    gone = np.array([part[list(c)].sum(dtype=np.uint64) for c in combinations(range(sizes[i]), k)], dtype=np.uint64)
                    out.append(mix((sums[i] - gone) ^ place[i]))
    return np.unique(np.concatenate(out))


def set_name(h: np.ndarray, bits: int = 61) -> tuple[int, int]:
    """A name of so many bits, whose lowest bit is free, and a second hash of 64 bits that tells sets of one name apart."""
    with np.errstate(over="ignore"):
        n = _U(len(h))
        name = mix(mix(h ^ _U(0xA0761D6478BD642F)).sum(dtype=np.uint64) + n) >> _U(64 - bits)
        check = mix(mix(h + _U(0x8EBC6AF09C88C6E3)).sum(dtype=np.uint64) ^ (n << _U(32)))
    return int(name) << 1, int(check.astype(np.int64))


def parities(h: np.ndarray) -> np.ndarray:
    """PARITY words with a bit for each class of elements: 1 for an odd number of them."""
    odd = np.bincount((mix(h ^ _U(0x9FB21C651E98DF25)) >> _U(40)).astype(np.int64) % (64 * PARITY), minlength=64 * PARITY) & 1
    return np.packbits(odd.astype(bool), bitorder="little").view("<i8")


_MEMBER = pa.schema([("doc_id", pa.int64()), ("set_id", pa.int64()), ("check", pa.int64()), ("n", pa.int64()), ("slack", pa.int32()), ("slack_below", pa.int32()), ("copy", pa.int64()), ("parity", pa.list_(pa.int64()))])
_MEMBER_SQL = "doc_id long, set_id long, check long, n long, slack int, slack_below int, copy long, parity array<long>"


def members_of(k: int, num: int, den: int, renamed: dict[tuple[int, int], int], bits: int):
    """A row for each (doc_id, text, copy) with the set's name, size, slack and parities."""

    def run(batches):
        for batch in batches:
            out = [[] for _ in _MEMBER]
            for doc, text, copy in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist(), strict=True):
                h = shingle_set(text.as_py(), k)
                row = [doc, None, None, len(h), None, None, copy, parities(h)]
                if len(h):
                    row[1:3] = set_name(h, bits)
                    row[1] = renamed.get((row[1], row[2]), row[1])
                    own, *below = bands_of(len(h), num, den)
                    row[4] = slack_of(h, own, True, num, den)
                    if below:
                        row[5] = min(slack_of(h, band, False, num, den) for band in below)
                for col, x in zip(out, row, strict=True):
                    col.append(x)
            yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(out, _MEMBER, strict=True)], schema=_MEMBER)

    return run


def signatures_of(k: int, num: int, den: int, renamed: dict[tuple[int, int], int], bits: int, most: int = 1 << 18):
    """(sig, member) of texts: member is the set's name, odd where it takes part in a band below its own.

    Copies within an input partition give their rows once; the names seen are as many as its rows.
    """
    schema = pa.schema([("sig", pa.int64()), ("member", pa.int64())])

    def batch_of(sigs, names):
        member = np.repeat(np.array(names, dtype=np.int64), [len(x) for x in sigs])
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(sigs).view(np.int64)), pa.array(member)], schema=schema)

    def run(batches):
        seen, sigs, names, held = set(), [], [], 0
        for batch in batches:
            for text in batch.column(0):
                h = shingle_set(text.as_py(), k)
                if not len(h):
                    continue
                name = set_name(h, bits)
                name = renamed.get(name, name[0])
                if name in seen:
                    continue
                seen.add(name)
                for j, band in enumerate(bands_of(len(h), num, den)):
                    x = signatures(h, band, j == 0, num, den)
                    sigs.append(x)
                    names.append(name | (j > 0))
                    held += len(x)
                if held >= most:
                    yield batch_of(sigs, names)
                    sigs, names, held = [], [], 0
        if sigs:
            yield batch_of(sigs, names)

    return run


def _members(d: DataFrame, k: int, num: int, den: int, bits: int) -> tuple[DataFrame, dict[tuple[int, int], int]]:
    """Stored members whose names tell all their different sets apart, and the sets that were renamed for that.

    Two sets share a name with a chance of 2**-bits. Names that carry two second hashes are found and given up for
    new ones; at 1e10 different sets some five of them are expected, so their table is bounded by chance, not by rows.
    """
    renamed: dict[tuple[int, int], int] = {}
    while True:
        members = stored(arrow_map(d.select("_id", "_text", F.xxhash64("_text").alias("copy")), members_of(k, num, den, dict(renamed), bits), _MEMBER_SQL), "jaccard-members")
        names = members.where("set_id is not null").select("set_id", "check")
        clashing = names.groupBy("set_id").agg(F.min("check").alias("lo"), F.max("check").alias("hi")).where("lo <> hi").select("set_id")
        found = names.join(F.broadcast(clashing), "set_id", "left_semi").distinct().collect()
        if not found:
            return members, renamed
        first = {r["set_id"]: r["check"] for r in sorted(found, reverse=True)}
        before = {new: old for old, new in renamed.items()}
        for r in found:
            if r["check"] != first[r["set_id"]]:
                key = before.get(r["set_id"], (r["set_id"], r["check"]))
                key = (key[0], r["check"])
                # A different part of the second hash at each turn; the top bit is one that no first name has.
                renamed[key] = (1 << 62) | ((int(mix(np.array([(r["check"] + len(renamed)) & (2**64 - 1)], dtype=np.uint64))[0]) >> 3) << 1)
        discard(members)


def _verifier(k: int, num: int, den: int):
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("linked", pa.bool_())])

    def run(batches):
        last, h = None, None
        for batch in batches:
            ids = [batch.column(i).to_pylist() for i in (0, 1)]
            ok = []
            for a, text_a, text_b in zip(ids[0], batch.column(2), batch.column(3), strict=True):
                if a != last:
                    last, h = a, shingle_set(text_a.as_py(), k)
                other = shingle_set(text_b.as_py(), k)
                both = intersection(h, other)
                ok.append(den * both >= num * (len(h) + len(other) - both))
            yield pa.RecordBatch.from_arrays([pa.array(ids[0], pa.int64()), pa.array(ids[1], pa.int64()), pa.array(ok, pa.bool_())], schema=schema)

    return run


def _texts(names: DataFrame, docs: DataFrame, classes: DataFrame) -> DataFrame:
    """(set_id, text) for the named sets. Only these texts leave their partition, with few others that the bitmap lets pass."""
    wanted = stored(classes.join(names, "set_id", "left_semi").select("set_id", "rep", "copy"), "jaccard-wanted")
    bits = bitmap_bits(wanted.count())
    seen = bitmap(wanted, F.xxhash64("rep"), bits)
    texts = maybe_in(docs, F.xxhash64("_id"), seen, bits, "_maybe").where("_maybe").select("_id", "_text", F.xxhash64("_text").alias("_copy"))
    found = texts.join(wanted, F.col("_id").eqNullSafe(F.col("rep")) & (F.col("_copy") == F.col("copy"))).select("set_id", F.col("_text").alias("text"))
    return stored(found.dropDuplicates(["set_id"]), "jaccard-texts")


#: Pairs of one set that a task verifies; those of a crowd's pivot are dealt over more tasks.
DEAL = 1000


def _pairs_of(pairs: DataFrame, key: str) -> DataFrame:
    """(key, _n): in how many pairs each set is."""
    return stored(pairs.groupBy(key).agg(F.count(F.lit(1)).alias("_n")), "jaccard-counts")


def _verified(pairs: DataFrame, docs: DataFrame, classes: DataFrame, k: int, num: int, den: int) -> DataFrame:
    """The pairs (a, b) of set names that link, by their whole sets.

    A crowd's pivot meets its members in several tasks: its text is sent to each of them, one for DEAL pairs.
    """
    texts = _texts(pairs.select(F.explode(F.array("a", "b")).alias("set_id")).distinct(), docs, classes)
    counts = _pairs_of(pairs, "a")
    dealt = join_hot(pairs, counts, "a").select("a", "b", F.expr(f"pmod(xxhash64(b), _n div {DEAL} + 1)").alias("salt"))
    with_b = dealt.join(texts.select(F.col("set_id").alias("b"), F.col("text").alias("text_b")), "b")
    first = texts.join(counts.withColumnRenamed("a", "set_id"), "set_id").select(F.col("set_id").alias("a"), F.col("text").alias("text_a"), F.explode(F.expr(f"sequence(0L, _n div {DEAL})")).alias("salt"))
    with_both = with_b.join(first, ["a", "salt"]).select("a", "b", "text_a", "text_b")
    return arrow_map(with_both, _verifier(k, num, den), "a long, b long, linked boolean").where("linked").select("a", "b")


def _plausible(pairs: DataFrame, listed: DataFrame) -> DataFrame:
    """Pairs of members that share more signatures than either's slack: at most H segments of linked sets differ.

    The lists of members with very many pairs, a bounded number, are broadcast.
    """
    pairs = stored(pairs, "jaccard-pairs")
    one = listed.select(F.col("member").alias("ma"), F.col("sigs").alias("sigs_a"), F.col("slack").alias("slack_a"))
    two = listed.select(F.col("member").alias("mb"), F.col("sigs").alias("sigs_b"), F.col("slack").alias("slack_b"))
    one = stored(one.join(_pairs_of(pairs, "ma"), "ma"), "jaccard-one")
    both = join_hot(pairs, one, "ma").join(two, "mb").where("size(array_intersect(sigs_a, sigs_b)) > greatest(slack_a, slack_b)")
    x, y = F.expr("ma & -2L"), F.expr("mb & -2L")
    return both.select(F.least(x, y).alias("a"), F.greatest(x, y).alias("b")).distinct()


def _central(entries: DataFrame, pivots: DataFrame) -> DataFrame:
    """PARTS more pivots of each crowd: of each part, by a hash, the member with the most signatures in crowds.

    The smallest member of a crowd of near copies may be one at its edge, with which few others link; most of them
    link with those that have kept what the crowd has in common. Pairs grow with a crowd, not with its square.
    """
    crowds = pivots.where(F.col("_n") > CROWD).select("sig", "p", "_n")
    inside = stored(join_hot(entries.select("sig", "member", "n"), crowds, "sig"), "jaccard-crowds")
    held = inside.groupBy("member").agg(F.count(F.lit(1)).alias("held"))
    by_hash = F.xxhash64("member")
    parts = inside.join(held, "member").groupBy("sig", F.pmod(by_hash, F.lit(PARTS)))
    most = parts.agg(F.max_by(F.struct("member", "n"), F.struct("held", by_hash)).alias("x"), F.first("p").alias("p"), F.first("_n").alias("_n"))
    return stored(most.select("sig", F.col("x.member").alias("pivot"), F.col("x.n").alias("pivot_n"), "p", "_n"), "jaccard-central")


def _shared(d: DataFrame, signed) -> DataFrame:
    """(sig, member, c): signatures that two or more sets have, and about how many. member is the set's name, odd below its own band.

    Texts are hashed a second time here: stored signatures would take more of the disk than that takes of the time.
    A signature of very many sets is dealt over SALTS tasks. Such ones are found among every LOOK-th text; there
    are fewer than HOT_SHARE of them, and one that is missed is counted in one task with the same result.
    """
    sigs = arrow_map(d.select("_text"), signed, "sig long, member long")
    some = d.where(F.pmod(F.xxhash64("_text"), F.lit(LOOK)) == 0).select("_text")
    look = stored(arrow_map(some, signed, "sig long, member long").distinct(), "jaccard-look")
    hot = look.groupBy("sig").agg(F.count(F.lit(1)).alias("n"))
    line = max(LOOK_LEAST, look.count() // HOT_SHARE)
    hot = stored(hot.where(F.col("n") > line).select("sig", F.lit(True).alias("hot")), "jaccard-hot")
    discard(look)
    salt = F.when(F.col("hot"), F.pmod(F.xxhash64("member"), F.lit(SALTS)) + 1).otherwise(0).cast("int")
    dealt = sigs.join(F.broadcast(hot), "sig", "left").select("sig", "member", salt.alias("salt"))
    group = Window.partitionBy("sig", "salt")
    marked = dealt.withColumns({"lo": F.min(F.expr("member & -2L")).over(group), "hi": F.max(F.expr("member & -2L")).over(group), "c": F.count(F.lit(1)).over(group)})
    return marked.where("lo <> hi or salt > 0").select("sig", "member", F.expr(f"if(salt > 0, c * {SALTS}, c)").alias("c"))


def jaccard_join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5, num: int = 4, den: int = 5, name_bits: int = 61) -> dict[str, DataFrame]:
    """Link texts whose sets of k-word shingles have a Jaccard similarity of num / den or more.

    Words are runs of bytes other than white space, A-Z in lower case. Returns three tables:
    members (doc_id, n_shingles, set_id): one row per row of docs; set_id is null for an empty set (null text,
    no words), which links with nothing. links (a, b): verified links between different sets, enough of them
    to connect everything that links connect. components (doc_id, n_shingles, component_id): the smallest
    doc_id that a row reaches. Rows that repeat an id are members each; null ids are never the smallest unless
    no other id is in the component. Other columns are not read, and an empty table gives empty ones. Shingles are
    compared by 64-bit hashes; sets are told apart by their name and a second hash of 64 bits.

    Rounds: equal sets collapse first. Then each signature links its sets to its smallest set and, if it has very
    many, to a few central ones (stars, never all pairs), verified links merge into components, and at the end only
    pairs that share a probed signature and lie in different components are verified. Nothing is capped: stars only
    save pairs of the last round, which looks at all that are left.
    """
    d = docs.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).alias("_text"))
    members, renamed = _members(d, k, num, den, name_bits)
    named = members.where("set_id is not null")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "copy"))
    classes = stored(named.groupBy("set_id").agg(first.alias("first"), F.first("parity").alias("parity"), F.max("n").alias("n"), F.max("slack").alias("slack"), F.max("slack_below").alias("slack_below")).select("set_id", F.col("first.doc_id").alias("rep"), F.col("first.copy").alias("copy"), "n", "slack", "slack_below", "parity"), "jaccard-classes")

    info = classes.select(F.explode(F.array(F.struct(F.col("set_id").alias("member"), "n", "slack"), F.struct(F.expr("set_id | 1L").alias("member"), "n", F.col("slack_below").alias("slack")))).alias("x")).select("x.*").where("slack is not null")
    once = _shared(d, signatures_of(k, num, den, renamed, name_bits)).repartition("member").groupBy("member", "sig").agg(F.max("c").alias("c"))
    dearest = Window.partitionBy("member").orderBy(F.desc("c"), "sig")
    probes = once.join(info, "member").withColumn("rank", F.row_number().over(dearest))
    entries = probes.select("sig", "member", F.expr("member & -2L").alias("set_id"), "n", "slack", (F.col("rank") > F.col("slack")).alias("probe"))
    entries = stored(entries, "jaccard-entries")
    listed = stored(entries.groupBy("member").agg(F.collect_list("sig").alias("sigs"), F.max("slack").alias("slack")), "jaccard-lists")

    # Stars: the sets of a signature that anyone probes, each with the smallest one, in crowds also with central ones.
    pivots = entries.groupBy("sig").agg(F.min("member").alias("pivot"), F.min_by("n", "member").alias("pivot_n"), F.max("probe").alias("p"), F.count(F.lit(1)).alias("_n")).where("p")
    pivots = stored(pivots, "jaccard-pivots")
    pivots = pivots.unionByName(_central(entries, pivots))
    fits = f"{num} * greatest(n, pivot_n) <= {den} * least(n, pivot_n)"
    star = join_hot(entries, pivots, "sig").where("member <> pivot and (member & pivot & 1L) = 0").where(fits).select(F.col("pivot").alias("ma"), F.col("member").alias("mb")).distinct()
    tried = stored(_plausible(star, listed), "jaccard-star")
    links = stored(_verified(tried, d, classes, k, num, den), "jaccard-links")
    parts = stored(connected_components(links), "jaccard-parts")

    # What is left: pairs in different components that share a signature which one of them probes.
    placed = entries.join(parts.withColumnRenamed("node", "set_id"), "set_id", "left").withColumn("component", F.coalesce("component", "set_id"))
    placed = stored(placed, "jaccard-placed")
    split = placed.groupBy("sig").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.max("probe").alias("p"), F.count(F.lit(1)).alias("_n")).where("p and lo <> hi")
    split = stored(split.select("sig", F.expr(f"int(_n div {BLOCK})").alias("last_salt"), "_n"), "jaccard-split")
    opened = join_hot(placed, split, "sig")
    # A class of shingles of which two sets hold an odd and an even number has a difference: parities bound the
    # differences of two sets before a pair is made. A crowded signature is dealt in blocks: each probing member
    # goes to one of them, the others to all.
    opened = opened.join(classes.select("set_id", "parity"), "set_id").select("sig", "last_salt", "member", "n", "probe", "component", "parity")
    left = opened.where("probe").withColumn("salt", F.expr("pmod(xxhash64(member), last_salt + 1)"))
    right = opened.select("sig", F.explode(F.sequence(F.lit(0).cast("long"), F.col("last_salt").cast("long"))).alias("salt"), F.col("member").alias("m2"), F.col("n").alias("n2"), F.col("component").alias("component2"), F.col("parity").alias("parity2"), F.col("probe").alias("probe2"))
    apart = " + ".join(f"bit_count(get(parity, {i}) ^ get(parity2, {i}))" for i in range(PARITY)) + f" <= floor((n + n2) * {den - num} / {den + num})"
    rest = (
        left.join(right, ["sig", "salt"])
        .where(f"component <> component2 and (member & m2 & 1L) = 0 and (member < m2 or not probe2) and {num} * greatest(n, n2) <= {den} * least(n, n2) and {apart}")
        .select(F.least("member", "m2").alias("ma"), F.greatest("member", "m2").alias("mb"))
        .distinct()
    )
    rest = stored(_plausible(rest, listed).join(tried, ["a", "b"], "left_anti"), "jaccard-rest")
    if not rest.isEmpty():
        more = stored(_verified(rest, d, classes, k, num, den), "jaccard-more")
        if not more.isEmpty():
            links = links.unionByName(more)
            parts = stored(connected_components(links), "jaccard-parts")

    merged = classes.join(parts.withColumnRenamed("node", "set_id"), "set_id", "left").withColumn("component", F.coalesce("component", "set_id"))
    least = merged.groupBy("component").agg(F.min("rep").alias("component_id"))
    of_set = merged.join(least, "component").select("set_id", "component_id")
    out = members.join(of_set, "set_id", "left").select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("set_id").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))
    return {"members": members.select("doc_id", F.col("n").alias("n_shingles"), "set_id"), "links": links, "components": out, "tried": tried, "rest": rest, "entries": entries}
