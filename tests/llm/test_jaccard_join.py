import random
import re

import numpy as np

from corvid.llm.components import connected_components
from corvid.llm.jaccard_join import band_edges, bands_of, jaccard_join, parities, set_name, signatures, slack_of
from corvid.llm.shingles import intersection, shingle_set, word_hashes

from .data import documents, empty, frame

WORD = re.compile("[^\x20\x09-\x0d]+")


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def shingles(text, k=5):
    w = WORD.findall(lower(text))
    return {tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()


def expected(rows):
    sets = [shingles(t) for _, t, *_ in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * both >= 80 * (len(sets[i]) + len(sets[j]) - both):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    ids = {}
    for i, (doc, *_) in enumerate(rows):
        ids.setdefault(find(i), []).append(doc)
    least = {k: min((x for x in v if x is not None), default=None) for k, v in ids.items()}
    return sorted(((doc, len(sets[i]), least[find(i)] if sets[i] else doc) for i, (doc, *_) in enumerate(rows)), key=str)


def got(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_components_equal_brute_force(spark):
    for seed in (3, 4):
        rows = documents(seed=seed)
        assert got(jaccard_join(frame(spark, rows))["components"]) == expected(rows)


def test_crowded_group_of_near_copies(spark):
    rng = random.Random(9)
    base = [f"b{rng.randrange(10_000)}" for _ in range(120)]
    rows = []
    for i in range(160):
        w = list(base)
        for _ in range(rng.choice([0, 1, 1, 2, 3, 5, 8, 12])):
            w[rng.randrange(len(w))] = f"x{rng.randrange(40)}"
        rows.append((i, " ".join(w), "en", "s", 1, "", "", ""))
    rows += [(500 + n, " ".join(f"t{j}" for j in range(n)), "en", "s", 1, "", "", "") for n in range(1, 40)]
    assert got(jaccard_join(frame(spark, rows))["components"]) == expected(rows)


def test_nothing_and_empty_sets(spark):
    assert jaccard_join(empty(spark))["components"].collect() == []
    rows = [(1, None, "", "", 0, "", "", ""), (2, "", "", "", 0, "", "", ""), (3, " \n", "", "", 0, "", "", ""), (4, "One two", "", "", 0, "", "", ""), (5, "oNE\x0btWO", "", "", 0, "", "", "")]
    assert got(jaccard_join(frame(spark, rows))["components"]) == [(1, 0, 1), (2, 0, 2), (3, 0, 3), (4, 1, 4), (5, 1, 4)]


def test_shingle_hashes_equal_tuples():
    for _, text, *_ in documents():
        assert len(shingle_set(text)) == len(shingles(text))
    assert len(word_hashes("a b\x0ba  ü".encode())) == 4 and len(set(word_hashes(b"a b a").tolist())) == 2


def test_linked_sets_always_share_enough_signatures():
    """The pigeonhole: sets at the threshold share more signatures than either's slack, at all sizes."""
    rng = np.random.default_rng(5)
    for n in [*range(1, 60), 75, 76, 77, 150, 400, 1500]:
        for _ in range(12 if n < 60 else 4):
            pool = np.unique(rng.integers(0, 2**63, 3 * n + 8, dtype=np.uint64))
            rng.shuffle(pool)
            same = rng.integers(-(-4 * n // 5), n + 1)
            room = same * 5 // 4 - n  # elements of the union beyond the first set
            more = rng.integers(0, room + 1) if room > 0 else 0
            a, b = np.sort(pool[:n]), np.sort(pool[np.r_[:same, n : n + more]])
            both = intersection(a, b)
            if 5 * both < 4 * (len(a) + len(b) - both):
                continue
            big, small = (a, b) if len(a) >= len(b) else (b, a)
            band = bands_of(len(small), 4, 5)[0]
            own = bands_of(len(big), 4, 5)
            assert band in own
            x, y = signatures(big, band, own[0] == band, 4, 5), signatures(small, band, True, 4, 5)
            shared = len(np.intersect1d(x, y))
            assert shared > max(slack_of(big, band, own[0] == band, 4, 5), slack_of(small, band, True, 4, 5))
            differ = len(a) + len(b) - 2 * both
            assert sum(int(u).bit_count() for u in (parities(a) ^ parities(b)).view(np.uint64)) <= differ


def test_pairs_across_band_edges_share_enough_signatures():
    """The same with hashes of all 64 bits, for pairs at the threshold whose larger set comes from the band above."""
    rng = np.random.default_rng(6)
    for top in [e - 1 for e in band_edges(3000)[1:]]:
        for n in {top, top - 1, -(-9 * top // 10), 4 * top // 5 + 1}:
            for larger in {top + 1, n * 5 // 4}:
                if n < 1 or larger <= top or 5 * n < 4 * larger:
                    continue
                for _ in range(12):
                    b = rng.integers(0, 2**64, larger, dtype=np.uint64)
                    a, b = np.sort(b[:n]), np.sort(b)
                    band = bands_of(n, 4, 5)[0]
                    assert bands_of(larger, 4, 5)[1:] == [band]
                    x, y = signatures(a, band, True, 4, 5), signatures(b, band, False, 4, 5)
                    assert len(np.intersect1d(x, y)) > max(slack_of(a, band, True, 4, 5), slack_of(b, band, False, 4, 5))


def test_texts_with_words_appended_across_a_band_edge(spark):
    rows = []
    for i in range(60):
        w = [f"p{i}x{j}" for j in range(14)]
        rows += [(2 * i, " ".join(w[:12]), "en", "s", 1, "", "", ""), (2 * i + 1, " ".join(w), "en", "s", 1, "", "", "")]
    assert got(jaccard_join(frame(spark, rows))["components"]) == expected(rows)


def test_set_names():
    a = np.array([1, 2, 3], dtype=np.uint64)
    assert set_name(a) == set_name(a.copy()) != set_name(a[:2]) and set_name(a)[0] % 2 == 0 <= set_name(a)[0] < 1 << 62


def test_sets_that_share_a_name_are_told_apart(spark):
    """With names of 5 bits nearly every set shares one with others."""
    rows = documents(seed=5)
    assert got(jaccard_join(frame(spark, rows), name_bits=5)["components"]) == expected(rows)


def test_hot_signatures_are_dealt_with_the_same_result(spark, monkeypatch):
    from corvid.llm import common, jaccard_join as module

    for name, value in (("LOOK", 1), ("LOOK_LEAST", 3), ("SALTS", 3), ("BLOCK", 4)):
        monkeypatch.setattr(module, name, value)
    monkeypatch.setattr(common, "HOT_ROWS", 3)
    rng = random.Random(10)
    base = [f"b{i}" for i in range(90)]
    rows = []
    for i in range(90):
        w = list(base)
        for _ in range(rng.choice([1, 2, 3, 5, 8, 12])):
            w[rng.randrange(len(w))] = f"x{rng.randrange(500)}"
        rows.append((i, " ".join(w), "en", "s", 1, "", "", ""))
    assert got(jaccard_join(frame(spark, rows))["components"]) == expected(rows)


def test_crowd_that_shares_much_and_links_with_nobody(spark):
    """Two thirds of every text are the same, so most signatures are crowded, but no two texts are similar enough."""
    base = [f"b{i}" for i in range(130)]
    rows = [(i, " ".join([*base, *(f"own{i}x{j}" for j in range(60))]), "en", "s", 1, "", "", "") for i in range(1500)]
    out = jaccard_join(frame(spark, rows))
    assert got(out["components"]) == sorted(((i, 186, i) for i in range(1500)), key=str)
    assert out["rest"].count() == 0 and out["tried"].count() < 10 * 1500


def test_crowd_of_near_copies_leaves_few_pairs_to_the_last_round(spark):
    """Most of a crowd's texts link with its centre, but the smallest set of a signature is seldom the centre."""
    rng = random.Random(12)
    base = [f"b{i}" for i in range(150)]
    rows = []
    for i in range(600):
        w = list(base)
        for j in rng.sample(range(150), rng.choice([1, 1, 2, 2, 3, 3, 4, 6])):
            w[j] = f"x{i}y{j}"
        rows.append((i, " ".join(w), "en", "s", 1, "", "", ""))
    out = jaccard_join(frame(spark, rows))
    assert got(out["components"]) == expected(rows)
    left, tried = out["rest"].count(), out["tried"].count()
    assert left < 600 and tried < 20 * 600, (left, tried)


def test_components_of_a_chain_and_a_star(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 30)] + [(7, 7)]
    out = dict(map(tuple, connected_components(spark.createDataFrame(edges, "a long, b long")).collect()))
    assert all(out[i] == 0 for i in range(41)) and all(out[100 + i] == 100 for i in range(30))
