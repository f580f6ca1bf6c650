"""Token-space rows against a loop over characters and tokens."""

import random

import numpy as np
import pytest

from corvid.operators import token_spans as T

KIND = "key long, text string, answers array<struct<start: int, end: int>>, facts array<array<struct<start: int, end: int>>>"


def chars(spans, n):
    on = [False] * n
    for s, e in spans:
        for i in range(s, min(e, n)):
            on[i] = True
    return on


def plain(how, key, tokens, answers, facts, n):
    ids, begins, ends = (list(map(int, t)) for t in tokens)
    turns = [len(answers) - 1] if how.last_only and answers else range(len(answers))
    area = chars([(answers[t][0], answers[t][1] + how.end_mark) for t in turns], n + 50)
    chosen = chars([facts[t][i] for t in range(len(facts)) for i in how.chosen(key, t, len(facts[t]))], n + 50)
    hidden = chars([f for t, of in enumerate(facts[:-1]) for i, f in enumerate(of) if how.context > 0 and T.chance(key, "context", t, i) < how.context], n + 50)
    labels, fact, shown = [T.IGNORED] * len(ids), [], list(ids)
    for k in range(len(ids)):
        if any(area[begins[k] : ends[k]]):
            labels[k] = ids[k]
            if any(chosen[begins[k] : ends[k]]):
                fact.append(k)
            if any(hidden[begins[k] : ends[k]]):
                shown[k] = how.mask_id
    m = how.max_len
    fact = [k for k in fact if k < m]
    n_on = sum(x != T.IGNORED for x in labels[:m])
    lam = how.fact_weight
    if how.target is not None and fact and n_on > len(fact):
        s = len(fact) / n_on
        lam = min(max(how.target / (1 - how.target) * (1 - s) / s, 1.0), how.largest)
    weights = [lam if k in fact else float(labels[k] != T.IGNORED) for k in range(len(ids))]
    slot = next((i for i in range(len(ids[:m]) - how.slot_size + 1) if how.slot_size and all(x == how.slot_id for x in ids[i : i + how.slot_size])), -1)
    return shown[:m], labels[:m], weights[:m], slot


def sample(rng):
    text = "".join(rng.choice(["ab ", "é", "日本", " x-", "12.5 ", "\n", "<m>", "<m><m>"]) for _ in range(rng.randint(0, 40)))
    cuts = sorted(rng.sample(range(len(text) + 1), min(len(text) + 1, 2 * rng.randint(0, 3))))
    answers = list(zip(cuts[::2], cuts[1::2], strict=False))
    facts = [[(s, e) for s, e in (sorted((rng.randint(a, b), rng.randint(a, b))) for _ in range(rng.randint(0, 3)))] for a, b in answers]
    return text, answers, facts


WAYS = [T.Collation(end_mark=2, share=0.5), T.Collation(last_only=True, share=1.0, target=0.3), T.Collation(context=0.7, mask_id=9, share=0.0), T.Collation(max_len=5, target=0.5, largest=2.0), T.Collation(slot_id=None, fact_weight=4.0)]


@pytest.mark.parametrize("how", WAYS, ids=str)
def test_rows_equal_the_plain_loop(spark, how):
    rng = random.Random(5)
    offsets = T.pattern_tokens(r"<m>|\w+|\s+|[^\w\s]")
    rows = [(k, *sample(rng)) for k in range(150)]
    got = {r.key: r for r in T.collate(spark.createDataFrame(rows, KIND), "key", "text", "answers", "facts", lambda: T.pattern_tokens(r"<m>|\w+|\s+|[^\w\s]"), how).collect()}
    for key, text, answers, facts in rows:
        ids, labels, weights, slot = plain(how, key, offsets(text), answers, facts, len(text))
        r = got[key]
        assert (r.ids, r.labels, r.weights, r.slot) == (ids, labels, pytest.approx(weights), slot)


def test_slots_and_padding(spark):
    import zlib

    m = zlib.crc32(b"<m>")
    how = T.Collation(slot_id=m, slot_size=2)
    rows = [(1, "a<m>b<m><m>c", [], []), (2, "<m>", [], []), (3, None, None, None)]
    made = T.collate(spark.createDataFrame(rows, KIND), "key", "text", "answers", "facts", lambda: T.pattern_tokens("<m>|."), how)
    assert {r.key: r.slot for r in made.collect()} == {1: 3, 2: -1, 3: -1}
    p = {r.key: r for r in T.padded(made, 7, 5).collect()}
    assert p[2].ids == [m, 5, 5, 5, 5, 5, 5] and p[2].mask == [1, 0, 0, 0, 0, 0, 0] and p[3].labels == [T.IGNORED] * 7


def test_library_offsets_are_code_points():
    import public_tokenizers

    run = T.library_tokens(public_tokenizers.path("byte_bpe_50k.json"))
    text = "Tongue é moves 12.5 mm"
    ids, begins, ends = run(text)
    at = text.index("12.5")
    on = T.touched(begins, ends, [(at, at + 4)])
    assert "".join(text[b:e] for b, e in zip(begins[on], ends[on])).strip() == "12.5" and len(ids) == len(on)
    assert not T.touched(begins, ends, [(3, 3)]).any() and not T.touched(np.array([], int), np.array([], int), [(0, 4)]).any()
