"""Concatenated packing, Merkle manifests and collocations against brute force."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from corvid.llm import concat_packing, merkle
from corvid.llm.collocations import collocations, phrase_counts
from corvid.llm.concat_packing import Encoder, TokenStream, Windows, concat_pack
from corvid.llm.merkle import Forest, Manifest, height, leaf_digest, merkle_proofs
from corvid.llm.oracles import oracle_sql
from corvid.llm.tokens import tokenizer_path

from .data import SCHEMA, documents, empty, frame
from .test_text_and_tokens import ODD, noise

TOKENIZER = "byte_bpe_50k.json"


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenizer_path(TOKENIZER))
    return lambda text: t.encode(text, add_special_tokens=False).ids


def odd_rows():
    return documents() + [(1000 + i, t, "en", "odd", 1, "", "", "") for i, t in enumerate([*ODD, *noise(20)])]


def test_the_fast_encoder_equals_the_library(library):
    own = Encoder(TOKENIZER)
    assert own.fast is not None
    for text in [*ODD, *noise(80), *(t or "" for _, t, *_ in documents()), " " * 3000 + "x", "ab" * 20_000]:
        want = library(text)
        assert own.ids(text).tolist() == want
        assert own.ids(text, section=7).tolist() == want


def test_the_fast_encoder_splits_every_code_point_alike(library):
    own = Encoder(TOKENIZER)
    for begin in range(0, 0x30000, 4096):
        text = " ".join(f"a{c}b 1{c}2 {c} {c}{c}  {c}." for c in map(chr, range(begin, begin + 4096)) if not 0xD800 <= ord(c) <= 0xDFFF)
        assert own.ids(text).tolist() == library(text), hex(begin)


def test_other_tokenizers_go_to_their_library():
    assert Encoder("word_bpe_49k.json").fast is None and Encoder("piece_bpe_32k.model").fast is None
    assert Encoder("piece_bpe_32k.model").ids("") .tolist() == []


@pytest.mark.parametrize("total", [0, 1, 7, 1023, 1024, 1025, 3000, 4096])
def test_windows_cover_the_stream_without_padding(total):
    w = Windows(total, 1024)
    cuts = list(w.cut(0, total))
    assert sum(b - a for _, _, a, b in cuts) == total and all(offset == 0 for _, offset, _, _ in cuts)
    assert [no for no, *_ in cuts] == list(range(len(cuts)))
    assert all((n := b - a) == 1024 or n & (n - 1) == 0 for _, _, a, b in cuts)


def check_pieces(rows, got, encode, capacity, end_id):
    want = Counter()
    for doc, text, *_ in rows:
        ids = [*encode(text or ""), end_id]
        want[doc, len(ids), zlib.crc32(np.asarray(ids, dtype="<u4").tobytes())] += 1
    places = defaultdict(list)
    for r in got:
        places[r.sequence_id].append((r.offset, r.length))
    for spans in places.values():
        spans.sort()
        assert [o for o, _ in spans] == [sum(n for _, n in spans[:i]) for i in range(len(spans))]
    sizes = [sum(n for _, n in places[s]) for s in sorted(places)]
    assert sorted(places) == list(range(len(sizes))) and all(n == capacity or n & (n - 1) == 0 for n in sizes)
    assert sum(sizes) == sum(n * k for (_, n, _), k in want.items())
    # Pieces of a document without repeats cover it without gaps.
    once = {d for (d, _, _), k in Counter((d, 0, 0) for d, _, _ in want.elements()).items() if k == 1}
    texts = {d: t for d, t, *_ in rows if d in once}
    for doc in once:
        own = sorted((r.start, r.length, r.ids_crc32, r.doc_tokens) for r in got if r.doc_id == doc)
        ids = np.asarray([*encode(texts[doc] or ""), end_id], dtype="<u4")
        assert sum(n for _, n, _, _ in own) == len(ids) and {t for *_, t in own} == {len(ids)}
        at = 0
        for start, n, crc, _ in own:
            assert start == at and crc == zlib.crc32(ids[start : start + n].tobytes())
            at += n


@pytest.mark.parametrize("capacity", [16, 1024])
def test_pieces_equal_the_library(spark, library, capacity):
    rows = odd_rows()
    check_pieces(rows, concat_pack(frame(spark, rows), TOKENIZER, capacity).collect(), library, capacity, 0)


def test_small_stretches_and_sections(spark, library, monkeypatch):
    rows = odd_rows()
    stream = TokenStream(frame(spark, rows, 7), TOKENIZER, 0, 64)
    ids = {(r.part, r.at): r.ids for r in stream.rows.collect()}
    flat = b"".join(ids[k] for k in sorted(ids))
    got = stream.sequences().orderBy("sequence_id").collect()
    assert b"".join(bytes(r.ids) for r in got) == flat and len(flat) == 4 * stream.total
    assert [r.n_tokens for r in got[:-6]] == [64] * (len(got) - 6) or stream.total // 64 == sum(r.n_tokens == 64 for r in got)
    assert all(len(r.ids) == 4 * r.n_tokens for r in got)
    monkeypatch.setattr(concat_packing, "ROW_IDS", 50)
    many = spark.createDataFrame([(7, "one two three " * 60, None, None, None, None, None, None)], SCHEMA)
    check = concat_pack(many, TOKENIZER, 1024).collect()
    assert sum(r.length for r in check) == len(library("one two three " * 60)) + 1


def test_no_documents_give_no_pieces(spark):
    assert concat_pack(empty(spark), TOKENIZER).collect() == []
    assert TokenStream(empty(spark), TOKENIZER, 0, 1024).sequences().collect() == []
    nothing = spark.createDataFrame([(None, None, None, None, None, None, None, None)] * 3, SCHEMA)
    assert sorted((r.length, r.doc_tokens) for r in concat_pack(nothing, TOKENIZER).collect()) == [(1, 1), (1, 1), (1, 1)]


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def field(x):
    return "-" if x is None else f"{len(str(x).encode())}:{x}"


def leaf_of(doc, text, lang, source, n_chars):
    return h(*map(field, (doc, source, lang, n_chars, text)))


def tree_of(leaves, arity=16):
    """All levels."""
    levels = [leaves]
    while len(levels[-1]) > 1:
        levels.append([h(*levels[-1][i : i + arity]) for i in range(0, len(levels[-1]), arity)])
    return levels


def siblings(levels, i, arity=16):
    out = []
    for nodes in levels[:-1]:
        run = nodes[i - i % arity : i - i % arity + arity]
        out.append((run[: i % arity], run[i % arity + 1 :]))
        i //= arity
    return out


def proofs_of(rows):
    by_source = defaultdict(list)
    for doc, text, lang, source, n_chars, *_ in rows:
        by_source[source].append((doc is not None, doc or 0, leaf_of(doc, text, lang, source, n_chars), (doc, text, lang, source, n_chars)))
    names = sorted(by_source, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: tree_of([x[2] for x in sorted(by_source[s], key=lambda x: x[:3])]) for s in names}
    top = tree_of([trees[s][-1][0] for s in names])
    out = []
    for k, s in enumerate(names):
        for i, (_, _, leaf, row) in enumerate(sorted(by_source[s], key=lambda x: x[:3])):
            doc, text, lang, source, n_chars = row
            near = siblings(trees[s], i) + siblings(top, k)
            node = leaf
            if doc is not None and zlib.crc32(str(doc).encode()) % 5 == 0:
                low = None if text is None else re.sub("[A-Z]", lambda m: m[0].lower(), text)
                node = leaf_of(doc, low, lang, source, n_chars)
            for left, right in near:
                node = h(*left, node, *right)
            proof = h(*(x for left, right in near for x in [*left, *right]))
            out.append((doc, leaf, trees[s][-1][0], top[-1][0], proof, node, node == top[-1][0]))
    return out


def key(row):
    return tuple(map(str, row))


@pytest.mark.parametrize("fan", [2, 64])
def test_proofs_equal_brute_force(spark, monkeypatch, fan):
    monkeypatch.setattr(merkle, "FAN", fan)
    rows = documents(150) + [(2000 + i, f"Text {i}", "en", "hot", i, "", "", "") for i in range(600)] + [(5000 + i, "Same", None, f"site{i}", None, "", "", "") for i in range(40)]
    got = merkle_proofs(frame(spark, rows, 7)).collect()
    assert sorted(map(key, map(tuple, got))) == sorted(map(key, proofs_of(rows)))
    assert {r.verified for r in got} == {True, False}


def test_merkle_sql_equals(spark, tmp_path):
    rows = [r for r in documents(150) if r[0] is not None] + [(2000 + i, f"Text {i}", "en", "hot", i, "", "", "") for i in range(300)]
    frame(spark, rows).write.parquet(f"{tmp_path}/d")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/d/*.parquet'")
    want = con.execute(f"SELECT doc_id, leaf, subroot, root, proof_sha256, folded_root, verified FROM ({oracle_sql()['op12_merkle_manifest']})").fetchall()
    assert sorted(map(key, map(tuple, merkle_proofs(frame(spark, rows)).collect()))) == sorted(map(key, want))


@pytest.mark.parametrize("n", [1, 2, 16, 17, 257])
def test_single_and_few_leaves(spark, n):
    rows = [(i, f"T{i}", "en", "only", 1, "", "", "") for i in range(n)]
    assert sorted(map(key, map(tuple, merkle_proofs(frame(spark, rows, 3)).collect()))) == sorted(map(key, proofs_of(rows)))
    assert height(n) == len(tree_of(list("x" * n))) - 1


def test_no_leaves(spark):
    assert merkle_proofs(empty(spark)).collect() == []
    assert Manifest(empty(spark), leaf_digest(F.col("doc_id"))).root is None


def test_forests_merge_in_any_order():
    leaves = [h(str(i)) for i in range(700)]
    want = tree_of(leaves, 4)[-1][0]
    for seed in range(5):
        rng = random.Random(seed)
        parts = [Forest(1, 4) for _ in range(9)]
        for i in rng.sample(range(700), 700):
            parts[rng.randrange(9)].add(0, 700, 0, i, leaves[i])
        while len(parts) > 1:
            a, b = parts.pop(rng.randrange(len(parts))), parts.pop(rng.randrange(len(parts)))
            for *_, tree, n, level, index, node, _, is_open in [r for r in b.rows(0)]:
                if is_open:
                    a.add(tree, n, level, index, node)
            parts.append(a)
        ends = [r for r in parts[0].rows(0) if r[7]]
        assert [(r[1], r[5]) for r in ends] == [(merkle.TOP, want)]


def phrases_of(rows, least, longest=5, top=2000):
    count, n = defaultdict(Counter), Counter()
    for _, text, lang, *_ in rows:
        lang = lang or "und" if lang is None else lang
        low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split("[.,;:!?\n-\r]", low):
            words = re.findall("[^ \t]+", piece)
            n[lang] += len(words)
            for m in range(1, longest + 1):
                for i in range(len(words) - m + 1):
                    count[lang][" ".join(words[i : i + m])] += 1
    out = []
    for lang, f in count.items():
        found = {p: a for p, a in f.items() if a >= least and " " in p}
        scored = []
        for p, a in found.items():
            words = p.split(" ")
            if any(len(q.split(" ")) > len(words) and f" {p} " in f" {q} " and b >= a for q, b in found.items()):
                continue
            cut = min((1000 * a * n[lang] // (f[l] * f[r]), k, f[l], f[r]) for k in range(1, len(words)) for l, r in [(" ".join(words[:k]), " ".join(words[k:]))])
            scored.append((-cut[0], -a, p.encode(), p, a, cut[2], cut[3]))
        out += [(lang, i, p, a, l, r, n[lang], -s) for i, (s, _, _, p, a, l, r) in enumerate(sorted(scored)[:top], 1)]
    return sorted(out)


def phrase_rows():
    rng = random.Random(4)
    vocab = ["a", "b", "c", "The", "cat", "sat", "on", "mat", "é", "日本", "x-y", "a\x0b"]
    texts = ["".join(rng.choice(vocab) + rng.choice([" ", " ", " ", "  ", "\t", ". ", ",", "\n", " ! ", "\r\n"]) for _ in range(rng.randint(0, 60))) for _ in range(150)]
    rows = [(i, t, rng.choice(["en", "fr", None, "und"]), "s", 1, "", "", "") for i, t in enumerate(texts)]
    rows += [(900, "a a a a a a a a b a a", "en", "s", 1, "", "", ""), (901, "the cat sat on " * 400, "en", None, 1, "", "", ""), (902, None, "en", None, None, None, None, None), (903, "", None, "", 0, "", "", "")]
    return rows + rows[:3] + [(None, "w" * 90 + " long " + "w" * 90 + " long", "de", "s", 1, "", "", "")] * 30


@pytest.mark.parametrize("how", [{}, {"section": 40}, {"listed": 3}, {"listed": 0, "section": 64}, {"hot_part": 10**6}, {"grams": 5}, {"grams": 1, "listed": 2}, {"hot_part": 300, "grams": 20, "section": 50, "listed": 6}], ids=str)
def test_collocations_equal_brute_force(spark, how):
    rows = phrase_rows()
    got = collocations(frame(spark, rows), least=20, **how).collect()
    assert sorted(map(tuple, got)) == phrases_of(rows, 20)


def test_collocations_keep_the_first_ones_of_each_language(spark):
    rows = phrase_rows()
    assert sorted(map(tuple, collocations(frame(spark, rows), least=10, top=7).collect())) == phrases_of(rows, 10, top=7)


def test_collocations_of_nothing(spark):
    assert collocations(empty(spark)).collect() == []
    known, totals = phrase_counts(frame(spark, [(1, None, None, None, None, None, None, None)]))
    assert known.collect() == [] and totals.collect() == []


def test_scores_beyond_64_bits_are_exact(spark):
    from corvid.llm.collocations import SCORE

    a, n, l, r = 3 * 10**12 + 7, 9 * 10**14 + 1, 5 * 10**12 + 3, 4 * 10**12 + 9
    got = spark.createDataFrame([(a, n, l, r)], "a long, n long, l long, r long").select(F.expr(SCORE).alias("s")).first().s
    assert got == 1000 * a * n // (l * r)
