import hashlib
import re
from collections import Counter

from pyspark.sql import functions as F

from corvid.llm.exact_dedup import exact_dedup
from corvid.llm.line_dedup import kept_texts, line_dedup, line_digests, with_bitmaps
from corvid.llm.common import scratch_root
from corvid.llm.quality_rules import POLICIES, RULES, ablations, apply_policy, quality_ledger, quality_rules, stored_ledger

from .data import documents, empty, frame

WORD = re.compile("[^\x20\x09-\x0d]+")


def expected_groups(rows, pick):
    groups = {}
    for doc, text, *_ in rows:
        groups.setdefault(text or "", []).append(doc)
    out = []
    for doc, text, *_ in rows:
        ids = groups[text or ""]
        known = [i for i in ids if i is not None]
        keep = pick(known) if known else None
        out.append((doc, keep, len(ids), doc == keep, hashlib.sha256((text or "").encode()).hexdigest()))
    return Counter(out)


def test_exact_dedup_equals_grouping(spark):
    for keep, pick in (("max", max), ("min", min)):
        got = exact_dedup(frame(spark), keep=keep)
        assert Counter(map(tuple, got.collect())) == expected_groups(documents(), pick)


def test_exact_dedup_with_clashing_hashes_compares_bytes(spark):
    got = exact_dedup(frame(spark), keep="max", hash_with=lambda t: F.lit(b"same").cast("binary"))
    assert Counter(map(tuple, got.collect())) == expected_groups(documents(), max)


def test_exact_dedup_of_nothing(spark):
    assert exact_dedup(empty(spark)).collect() == []


def measure(text):
    text = text or ""
    w = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    windows = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    covered = {j for i in range(len(w) - 2) if windows[tuple(w[i : i + 3])] > 1 for j in (i, i + 1, i + 2)}
    return (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered))


def test_quality_measurements_equal_brute_force(spark):
    rows = [*documents(), (900, "a b c a b c a b c d", None, None, 1, "", "", ""), (901, "x # y\nx # y\nz\n\n", None, None, 1, "", "", ""), (902, "a a a a", None, None, 1, "", "", "")]
    got = quality_rules(frame(spark, rows)).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed").collect()
    want = Counter()
    for doc, text, *_ in rows:
        m = measure(text)
        want[(doc, *m, m[0] < 50 or 100 * m[4] > 50 * m[0])] += 1
    assert Counter(map(tuple, got)) == want


def test_quality_bits_policies_and_ablations(spark):
    ledger = quality_ledger(frame(spark))
    rows = quality_rules(frame(spark)).collect()
    assert all(r.kept == (r.rule_bits & POLICIES["v1"].mask == 0) for r in rows)
    for policy in POLICIES.values():
        cut = {r.rule: (r.n_failed, r.n_kept_without) for r in ablations(ledger, policy).collect()}
        for bit, name, _ in RULES:
            alone = sum(r.rule_bits & policy.mask == 1 << bit for r in rows)
            assert cut.get(name, (0, 0)) == (sum(r.rule_bits >> bit & 1 for r in rows), alone)


def test_a_stored_ledger_is_measured_once(spark):
    path = f"{scratch_root(spark)}/ledger"
    first = stored_ledger(frame(spark), path)
    assert stored_ledger(empty(spark), path).count() == first.count() == len(documents())
    for name, policy in POLICIES.items():
        kept = apply_policy(first, policy).where("kept").count()
        assert kept == quality_rules(frame(spark), policy).where("kept").count(), name


def test_rules_on_digits_bullets_and_ellipses(spark):
    rows = [(1, "12 345 6a b", *[None] * 6), (2, "- a\n * b\n\t• c\n-d", *[None] * 6), (3, "a...\nb…  \nc\nd", *[None] * 6), (4, "a b c", *[None] * 6)]
    got = {r.doc_id: (r.n_digits, r.n_bullet_lines, r.n_ellipsis_lines, r.rule_bits >> 5) for r in quality_ledger(frame(spark, rows)).collect()}
    assert got == {1: (6, 0, 0, 1), 2: (0, 4, 0, 2), 3: (0, 0, 2, 4), 4: (0, 0, 0, 0)}


def test_filters_on_the_verdict_stay_cheap(spark):
    plan = quality_rules(frame(spark)).where("kept")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("split(") < 12


def test_quality_of_nothing(spark):
    assert quality_rules(empty(spark)).collect() == []


def expected_lines(rows, min_chars=40, min_docs=5):
    strip = " \t\n\x0b\x0c\r"
    docs = {}
    key = lambda x: x.strip(strip).encode().lower()
    low = lambda d: -1 if d is None else d
    for doc, text, *_ in rows:
        for x in (text or "").split("\n"):
            if len(x.strip(strip)) >= min_chars:
                docs.setdefault(key(x), set()).add(low(doc))
    keep = {k: max(v) for k, v in docs.items() if len(v) >= min_docs}
    out = []
    for doc, text, *_ in rows:
        lines = (text or "").split("\n")
        stay = [x for x in lines if keep.get(key(x), low(doc)) == low(doc)]
        out.append((doc, len(lines), len(lines) - len(stay), hashlib.sha256("\n".join(stay).encode()).hexdigest()))
    return Counter(out)


def digests(df, **how):
    d = df.select("doc_id", "text")
    return with_bitmaps(d, line_dedup(df, **how)).mapInArrow(line_digests, "doc_id long, n_lines long, n_dropped long, kept_sha256 string").collect()


def test_line_dedup_equals_brute_force(spark):
    line = "This very line is found in a great many of the documents"
    rows = documents() + [(1000 + i, f"{line}\nown {i}\n  {line.lower()} ", "en", "s", 1, "", "", "") for i in range(60)]
    rows += [(None, line, "en", "s", 1, "", "", ""), (1003, line + "\nother", "en", "s", 1, "", "", "")]
    for parts in (1, 7):
        got = digests(frame(spark, rows, parts))
        assert Counter(map(tuple, got)) == expected_lines(rows)
        assert sum(r.n_dropped for r in got) > 100


def test_line_dedup_across_many_small_partitions(spark):
    rows = [(i, "\n".join(f"line number {j} is long enough to be counted here" for j in range(i % 9)), "en", "s", 1, "", "", "") for i in range(150)]
    spark.conf.set("spark.sql.shuffle.partitions", "60")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        assert Counter(map(tuple, digests(frame(spark, rows)))) == expected_lines(rows)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")


def test_with_bitmaps_keeps_columns_of_any_name(spark):
    line = "This very line is found in a great many of the documents"
    names = "doc_id long, text string, _bucket int, _pos int, _bits string, _maybe int, _doc int, _fp int, _own_fp int, keep_bitmap int"
    docs = spark.createDataFrame([(i, f"{line}\nown {i}", 1, 2, "3", 4, 5, 6, 7, 8) for i in range(9)] + [(None, None, *[None] * 8)], names)
    got = with_bitmaps(docs, line_dedup(docs))
    assert sorted(got.columns) == sorted(docs.columns)
    rows = got.collect()
    assert sum(r.keep_bitmap is None for r in rows) == 2
    assert all((r._bucket, r._pos, r._bits, r._maybe, r._doc, r._fp, r._own_fp) == (1, 2, "3", 4, 5, 6, 7) for r in rows if r.doc_id is not None)


def test_line_dedup_keeps_text_and_nulls(spark):
    d = frame(spark).select("doc_id", "text")
    got = with_bitmaps(d, line_dedup(d)).mapInArrow(kept_texts, "doc_id long, text string").collect()
    assert sum(r.text is None for r in got) == 1 and len(got) == len(documents())
    assert digests(empty(spark)) == []


def test_empty_ledgers_and_null_bits(spark):
    ledger = quality_ledger(empty(spark))
    assert apply_policy(ledger, POLICIES["v1"]).collect() == [] and ablations(ledger, POLICIES["v1"]).collect() == []
    nulls = spark.createDataFrame([(1, None), (2, 0)], "doc_id long, rule_bits int")
    assert {r.doc_id: r.kept for r in apply_policy(nulls, POLICIES["v1"]).collect()} == {1: None, 2: True}
    assert all((r.n_failed, r.n_kept_without) == (0, 0) for r in ablations(nulls, POLICIES["v1"]).collect())
