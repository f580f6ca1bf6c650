import random
import zlib
from collections import Counter
from itertools import combinations_with_replacement

import numpy as np
import pytest

from corvid.llm.html_text import Node, densities, extract_pages, main_text, parse, settle
from corvid.llm.language_id import LanguageFilters, fit_languages, grams, held_out, identify_languages
from corvid.llm.packing import Complements, pack, plan, slots
from corvid.llm import tokens
from corvid.llm.tokens import Counter as TokenCounter, token_counts, tokenizer_path

from .data import documents, empty, frame

TOKENIZER = "word_bpe_49k.json"
ODD = ["", " ", "<|endoftext|>foo BAR<|startoftext|> x", "don't I'll we've", "é́ café ÀÉÿŸ İstanbul ΣΑΣ Σ", "a b c　d", "x" * 9000, "日本語 テスト 123 4,5.6", "\x1c\x1d a\x85b", "A.B.C. !!! ??? (x) hello), 'tis", "é ́a ß ſ ﬁ Ⅻ ½ ²", "ab" * 5000 + " " + "c d" * 4000, "mid\x0bword\x0c\tend\r\n"]


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenizer_path(TOKENIZER))
    return lambda text: t.encode(text, add_special_tokens=False).ids


def noise(n, seed=1):
    rng = random.Random(seed)
    chars = [chr(c) for c in [*range(0x20, 0x7F), *range(0xA0, 0x180), 0x301, 0x3A3, 0x4E00, 0x200B, 9, 10, 11, 12, 13, 0x1F600]]
    return ["".join(rng.choice(chars) for _ in range(200)) for _ in range(n)]


def equal_library(counter, encode, texts):
    want = [encode(t) for t in texts]
    data = [t.encode() for t in texts]
    for _ in range(3):  # words that are met again enter the table
        assert counter.counts(data) == list(map(len, want))
        ids, ends = counter.ids(data, 1)
        assert [x.tolist() for x in np.split(ids, ends[:-1])] == [[*w, 1] for w in want]
        ids, ends = counter.ids(data)
        assert [x.tolist() for x in np.split(ids, ends[:-1])] == want


def test_transducer_equals_the_library(library):
    counter = TokenCounter(TOKENIZER)
    assert counter.transducer is not None
    syllables = random.Random(2)
    invented = [" ".join("".join(syllables.choices("the an ion ing ünd er ché que aaa bbb é ss zz Th ÀÉ".split(), k=syllables.randint(1, 9))) + syllables.choice(["", ".", ",", "!!!", "#$", "12"]) for _ in range(60)) for _ in range(200)]
    equal_library(counter, library, [*ODD, *noise(60), *(t or "" for _, t, *_ in documents()), *invented])


def test_a_full_table_still_equals_the_library(library, monkeypatch):
    monkeypatch.setattr(tokens, "STATES", 300)
    monkeypatch.setattr(tokens, "TABLE", 20)
    counter = TokenCounter(TOKENIZER)
    texts = [t or "" for _, t, *_ in documents()]
    for part in (texts, noise(20, 4), ["antidisestablishmentarianism " * 3 + "floccinaucinihilipilification internationalization"] * 2, texts):
        equal_library(counter, library, part)


@pytest.mark.parametrize("change", ["case", "nfc", "none", "splitter", "added"])
def test_other_files_of_the_kind(tmp_path, change):
    """Without lower-casing, 'The Quick' is other tokens; what the compilation does not cover goes to the library."""
    import json

    from tokenizers import Tokenizer

    spec = json.load(open(tokenizer_path(TOKENIZER), encoding="utf-8"))
    if change == "splitter":
        spec["pre_tokenizer"]["pretokenizers"][0]["pattern"] = {"Regex": "[^\\s]+"}
    elif change == "added":
        spec["added_tokens"].append({"id": 49408, "content": "[SEP] x", "single_word": False, "lstrip": False, "rstrip": False, "normalized": False, "special": True})
    else:
        spec["normalizer"] = {"case": {"type": "Sequence", "normalizers": spec["normalizer"]["normalizers"][:2]}, "nfc": {"type": "NFC"}, "none": None}[change]
    path = tmp_path / "other.json"
    path.write_text(json.dumps(spec))
    t = Tokenizer.from_file(str(path))
    counter = TokenCounter(str(path))
    assert (counter.transducer is None) == (change in ("splitter", "added"))
    equal_library(counter, lambda x: t.encode(x, add_special_tokens=False).ids, ["The Quick brown FOXES, Jumped. [SEP] x", "a\tb\nc", *ODD, *noise(20)])


def test_state_maps_compose_associatively(library):
    c = TokenCounter(TOKENIZER)
    chunks = [c.state_map(x) for x in (b"ab", b"c de", b" ", b"", b"fgh", b" x y")]
    left = chunks[0]
    for m in chunks[1:]:
        left = c.compose(left, m)
    right = chunks[-1]
    for m in reversed(chunks[:-1]):
        right = c.compose(m, right)
    assert left == right
    for text in [*ODD, *noise(10, 3)]:
        for size in (1, 3, 50):
            data = text.encode()
            parts = [data[i : i + size] for i in range(0, len(data), size)] or [b""]
            if len(parts) < 500:
                assert c.total([c.state_map(x) for x in parts]) == len(library(text))


def test_chunks_of_long_texts_are_dealt_and_composed(spark, library):
    got = token_counts(frame(spark), TOKENIZER, section=64).collect()
    assert Counter((r.doc_id, r.n_tokens) for r in got) == Counter((d, len(library(t or ""))) for d, t, *_ in documents())


@pytest.mark.parametrize("name", [TOKENIZER, "byte_bpe_50k.json", "piece_bpe_32k.model"])
def test_token_counts_of_rows(spark, name):
    got = token_counts(frame(spark), name).collect()
    if name.endswith(".model"):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=tokenizer_path(name))
        count = lambda t: len(model.encode(t)) if t else 0
    else:
        from tokenizers import Tokenizer

        library = Tokenizer.from_file(tokenizer_path(name))
        count = lambda t: len(library.encode(t or "", add_special_tokens=False).ids)
    want = Counter((doc, len((t or "").encode()), n := count(t), n > 2048) for doc, t, *_ in documents())
    assert Counter(map(tuple, got)) == want
    assert token_counts(empty(spark), name).collect() == []


def test_packing_is_gapless_and_whole(spark, library):
    capacity = 256
    got = pack(frame(spark), TOKENIZER, capacity=capacity).collect()
    want = Counter()
    for doc, text, *_ in documents():
        ids = np.asarray([*library(text or ""), 1], dtype="<u4")
        for piece, at in enumerate(range(0, len(ids), capacity)):
            part = ids[at : at + capacity]
            want[(doc, piece, at, len(part), zlib.crc32(part.tobytes()))] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == want
    sequences = {}
    for r in got:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for places in sequences.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= capacity
    assert len(sequences) <= -(-sum(r.length for r in got) // capacity) + 1
    assert pack(empty(spark), TOKENIZER).collect() == []


def test_plan_uses_all_counts_and_fills_exactly():
    rng = random.Random(2)
    for _ in range(5):
        counts = Counter(min(512, 1 + int(rng.expovariate(1 / 90))) for _ in range(3000))
        templates = plan(dict(counts), 512)
        used = Counter()
        for items, times in templates:
            assert sum(items) <= 512
            for x in items:
                used[x] += times
        assert used == counts
        total = sum(k * n for k, n in counts.items())
        assert sum(times for _, times in templates) <= -(-total // 512) + 1
        assert sum(hi - lo for _, lo, hi, _, _ in slots(templates)) == 3000
    assert plan({}, 64) == [] and plan({64: 3, 1: 1}, 64) == [((64,), 3), ((1,), 1)]


def test_sums_are_indexed_under_availability():
    """The index of single, pair and triple sums equals brute force while lengths come and go."""
    have = Complements({n: 1 for n in [*range(901, 1000), 400, 350, 250]}, 4096)
    assert have.exact(1000) == (400, 350, 250)
    rng = random.Random(8)
    for _ in range(60):
        left = {x: rng.randint(1, 4) for x in rng.sample(range(1, 41), rng.randint(1, 12))}
        have = Complements(left, 40)
        for _ in range(6):
            x = rng.choice(list(left))
            left[x] = rng.randint(0, 4)
            have.put(x, left[x])
        for size, index in ((1, have.one), (2, have.two), (3, have.three)):
            want = Counter(sum(c) for c in combinations_with_replacement([x for x in left if left[x]], size) if all(left[x] >= k for x, k in Counter(c).items()))
            assert [want[i] for i in range(41)] == index.tolist()
        for gap in range(1, 41):
            found = have.exact(gap)
            assert (found is None) == (not have.one[gap] and not have.two[gap] and not have.three[gap])
            assert found is None or (sum(found) == gap and all(left[x] >= k for x, k in Counter(found).items()))


def test_packing_cuts_very_long_texts_in_sections(spark, library, monkeypatch):
    from corvid.llm import packing

    text = " ".join(random.Random(3).choices(["alpha", "beta.", "gamma!", "don't", "x" * 90, "délta"], k=3000))
    own = tokens.counter(TOKENIZER)
    whole, _ = own.ids([text.encode()], 1)
    monkeypatch.setattr(packing, "SECTION", 500)
    import pyarrow as pa

    batch = pa.RecordBatch.from_arrays([pa.array([7, 8]), pa.array([text.encode(), b""])], names=["doc_id", "text"])
    rows = pa.Table.from_batches(packing.pieces_of(TOKENIZER, 256, 1)([batch])).to_pylist()
    want = [(7, i // 256, i, len(p := whole[i : i + 256]), zlib.crc32(p.astype("<u4").tobytes())) for i in range(0, len(whole), 256)]
    assert [tuple(r.values()) for r in rows] == [*want, (8, 0, 0, 1, zlib.crc32(np.array([1], "<u4").tobytes()))]


def test_main_text_of_awkward_pages():
    body = " ".join(["Some words of an article, long enough to weigh more than the rest of the page."] * 6)
    page = f"""<!doctype html><html><head><title>T</title><style>p{{x:1}}</style><script>var a="<p>no</p>";</script></head><body>
    <div id="cookie-notice">We use cookies. Accept all of them please.</div><header><a href=/>Home</a> Site</header><nav><ul><li><a href=1>One</a><li><a href=2>Two</a></ul></nav>
    <main><h1>Title &amp; more</h1><p>{body}<p>Second &eacute; &#x41; <b>bold</b>text<br>next <a href=x>link</a>.<!-- gone --><ul><li>first<li>second</ul>
    <aside>Related things</aside><form>Subscribe <input></form></main><div class="sidebar">Popular</div><section class="comments"><p>{body} says a reader</p></section><footer>&copy; 2020</footer></body></html>"""
    assert main_text(page) == f"Title & more {body} Second é A boldtext next link. first second"
    assert main_text(page.replace("<main>", "<div>").replace("</main>", "</div>")) == main_text(page)
    assert main_text(page[: page.index(" <a href=x>link")]).endswith("boldtext next")
    assert [main_text(x) for x in (None, "", "<p>", "<!--", "<")] == ["", "", "", "", "<"]
    assert main_text("<div>" * 4000 + "deep &lt;b&gt;" + "</div>" * 4000) == "deep <b>"


BODY = " ".join(["Some words of an article, long enough to weigh more than the rest of the page."] * 4)
SHORT = "A short line of other text on the page."


@pytest.mark.parametrize("name", ["main-menu", "content-ad", "post-navigation", "entry-share", "siteFooter", "sidebar", "cookie-notice", "page-comments", "relatedPosts"])
def test_furniture_by_name_beats_words_for_content(name):
    for wrap in ("<article>{}</article>", "<main>{}</main>", "<div>{}</div>"):
        page = "<body>" + wrap.format(f"<h1>Title</h1><div class='{name}'>{SHORT}</div><p>{BODY}</p><p>End.</p><ul id={name}><li>{SHORT}</ul>") + "</body>"
        assert main_text(page) == f"Title {BODY} End."


def test_reader_comments_in_articles_of_their_own_go():
    comment = f"<article class='comment-body'><p>{BODY} {BODY}</p></article>"
    page = f"<main><article class='post comments-open has-sidebar'><h1>T</h1><p>{BODY}</p><section><h2>3 Comments</h2>{comment}{comment}</section></article></main>"
    assert main_text(page) == f"T {BODY}"
    assert main_text(page.replace("<h2>3 Comments</h2>", "")) == f"T {BODY}"
    assert main_text(f"<div><p>{BODY}</p></div><ol><h3>Kommentare (2)</h3><li><p>{BODY} {BODY}</p></ol>") == BODY


def test_paragraphs_with_such_names_stay_and_articles_by_themselves():
    for name in ("review", "legal", "side-note-text", "tags"):
        assert main_text(f"<article><p>One.</p><p class='{name}'>{BODY}</p></article>") == f"One. {BODY}"
    teasers = "".join(f"<div class=x><p>{SHORT} <a href=/{i}>Read on here, please</a></p></div>" for i in range(6))
    assert main_text(f"<main><article><h1>T</h1><p>{BODY}</p></article>{teasers}</main>") == f"T {BODY}"
    links = "".join(f"<li><a href=/{i}>{SHORT}</a></li>" for i in range(9))
    assert main_text(f"<body><div id=a><ul>{links}</ul></div><main><h1>T</h1><div><p>{BODY}</p><p>{BODY}</p></div><ul>{links}</ul></main></body>") == f"T {BODY} {BODY}"


def test_pages_without_article_or_main():
    sections = "".join(f"<section><h2>Part {i}</h2><p>{BODY}</p><p>{BODY}</p></section>" for i in range(3))
    want = " ".join(f"Part {i} {BODY} {BODY}" for i in range(3))
    assert main_text(f"<body><div class=x1><a href=/>Home</a> <a href=/b>Other</a></div><div id=z>{sections}</div><div>&copy; 2020</div></body>") == want
    assert main_text(f"<body><form id=aspnet><div class=header>{SHORT}</div><div>{sections}</div></form></body>") == want
    assert main_text(f"<body class='has-sidebar'><div class='content-sidebar-wrap'><p>{BODY}</p><div class=sidebar>{SHORT}</div></div></body>") == BODY
    assert main_text(f"<body><div class=ad>{BODY}</div><p>Short.</p></body>") == "Short."
    assert main_text("<p>a&<b>amp;</b>&nbsp;&lt;x&gt;</p>") == "a&amp; <x>"


NAMES = "social-science share-price related-work promotion-of-science comment-on-law ad-hoc side-effects search-for-life tags-and-trees notice-period banner-year legal-notice-text reviews-body".split()


@pytest.mark.parametrize("name", NAMES)
def test_names_are_evidence_and_no_verdict(name):
    assert main_text(f"<article><div class='{name}'><p>{BODY}</p><p>{BODY}</p></div></article>") == f"{BODY} {BODY}"
    assert main_text(f"<article><p>One.</p><div class='{name}'><p>{BODY}</p><p>{BODY}</p></div></article>") == f"One. {BODY} {BODY}"
    assert main_text(f"<body><article><p id='{name}'>{BODY}</p><p>Two.</p></article></body>") == f"{BODY} Two."


def test_articles_do_not_become_empty():
    for name in ("ad", "comments", "newsletter", "sidebar", "promo-box"):
        assert main_text(f"<body><nav>x</nav><article><div class='{name}'><p>{BODY}</p></div></article></body>") == BODY
        assert main_text(f"<article><p>Kept.</p><div class='{name}'><p>{SHORT}</p></div></article>") == "Kept."
    assert main_text("<article><div class=ad>No paragraph here</div></article>") == ""


def test_headings_of_discussions():
    talk = f"<p>{BODY}</p><p>{BODY}</p>"
    assert main_text(f"<article><p>One.</p><section><h2>Responses</h2>{talk}</section></article>") == f"One. Responses {BODY} {BODY}"
    for heading in ("3 Responses", "Replies (4)", "Comments", "Leave a comment:"):
        assert main_text(f"<article><p>One.</p><section><h2>{heading}</h2>{talk}</section></article>") == "One."


def test_blocks_of_links_in_articles_go():
    links = "".join(f"<a href=/{i}>{SHORT}</a> " for i in range(5))
    assert main_text(f"<article><h1>T</h1><p>{BODY}</p><div>{links}</div><ul><li><a href=x>A source</a></li></ul></article>") == f"T {BODY} A source"


def test_quotes_are_read_as_browsers_do():
    assert main_text(f"""<p class="a"">Hello {BODY} <a href="x">link</a> end one.""") == f"Hello {BODY} link end one."
    assert main_text(f"""<img alt="5" TV"><p>First {BODY}</p><p>Second <b title="q">bold</b></p>""") == f"First {BODY} Second bold"
    assert main_text(f"""<p data-x='a>b' title = "c>d">{BODY}</p><p it's>Two</p>""") == f"{BODY} Two"
    assert main_text(f"""<p title="open>{BODY}</p><p>Two</p>""") == f"{BODY} Two"


def naive_text(node):
    """The selection of a page without names, by plain recursion; the tree is trusted."""

    def kids(n):
        return [c for c in n.children if isinstance(c, Node)]

    def every(n):
        return [n, *(x for c in kids(n) for x in every(c))]

    def ink(n, links=False):
        if links and n.tag == "a":
            return ink(n)
        return sum(ink(c, links) if isinstance(c, Node) else 0 if links else sum(map(len, c.split())) for c in n.children)

    nodes = every(node)
    total = lambda n: sum(c.density for c in kids(n)) + (0 if n.tag == "a" else sum(len("".join(c.split())) for c in n.children if isinstance(c, str)))
    best = None
    for n in nodes:
        if n.tag in ("body", "div", "section", "article", "main", "td", "center") and ink(n) and (best is None or total(n) > total(best)):
            best = n
    if best is None:
        return None, None
    path = [best]
    while path[-1].parent is not None:
        path.append(path[-1].parent)
    body = next(n for n in nodes if n.tag == "body")
    least = min((n.density for n in path[: path.index(body) + 1] if n.density > 0), default=0.0)

    def belongs(n):
        if not ink(n) or 2 * ink(n, True) >= ink(n):
            return False
        return n.tag[0] == "h" and n.tag[1:].isdigit() or n.density >= least and (n.tag in ("p", "ul", "ol", "dl", "pre", "blockquote", "figure", "table") or any(x.tag == "p" and ink(x) for x in every(n)))

    top, chosen = best, {id(x) for x in every(best)}
    while top is not body:
        beside = [c for c in kids(top.parent) if c is not top and ink(c)]
        more = [c for c in beside if belongs(c)]
        if beside and not more:
            break
        chosen |= {id(x) for c in more for x in every(c)}
        chosen |= {id(top.parent)}
        top = top.parent
    return top, chosen


def test_selection_equals_plain_recursion():
    rng = random.Random(12)

    def page(depth):
        kind = rng.random()
        if depth and kind < 0.5:
            return f"<div>{''.join(page(depth - 1) for _ in range(rng.randint(1, 4)))}</div>"
        if kind < 0.75:
            return f"<p>{' '.join(rng.choice(['some', 'words', 'of', 'text']) for _ in range(rng.randint(1, 60)))}</p>"
        if kind < 0.85:
            return f"<h2>Head {rng.randint(0, 9)}</h2>"
        return "".join(f"<a href=/>link {rng.randint(0, 99)}</a> " for _ in range(rng.randint(1, 6)))

    for _ in range(150):
        text = "<html><body>" + "".join(page(4) for _ in range(rng.randint(1, 5))) + "</body></html>"
        root = parse(text)
        settle(root)
        densities(root)
        top, chosen = naive_text(root)

        def words(n):
            return [w for c in n.children for w in (c.split() if isinstance(c, str) else words(c) if id(c) in chosen else [])]

        assert main_text(text).split() == (words(top) if top is not None else []), text


def test_densities_equal_a_direct_count():
    """Every count of the tree and the composite formula, by walking each node's whole subtree anew."""
    import math

    rng = random.Random(6)

    def page(depth):
        tag = rng.choice(["div", "p", "a", "span", "section", "ul"])
        inner = "".join(page(depth - 1) for _ in range(rng.randint(0, 3))) if depth else ""
        return f"<{tag}>{rng.choice(['', 'some words here', 'x ' * rng.randint(0, 30)])}{inner}</{tag}>"

    def below(n):
        return [x for c in n.children if isinstance(c, Node) for x in (c, *below(c))]

    def text(n):
        return "".join(c if isinstance(c, str) else text(c) for c in n.children)

    def ink(x):
        return len("".join(x.split()))

    def linked(n):
        return ink(text(n)) if n.tag == "a" else sum(linked(c) for c in n.children if isinstance(c, Node))

    for _ in range(40):
        root = parse("<body>" + "".join(page(4) for _ in range(3)) + "</body>")
        settle(root)
        nodes = densities(root)
        body = nodes[1]
        share = linked(body) / ink(text(body)) if ink(text(body)) else 0
        for n in nodes:
            c, t, lc, lt = ink(text(n)), len(below(n)), linked(n), sum(x.tag == "a" for x in below(n)) + (n.tag == "a")
            assert (n.chars, n.tags, n.link_chars, n.link_tags) == (c, t, lc, lt)
            if c:
                base = math.log(c / max(c - lc, 1) * max(lc, 1) + share * c + math.e)
                want = c / max(t, 1) * max(math.log(c / max(lc, 1) * max(t, 1) / max(lt, 1), base), 0)
                assert n.density == pytest.approx(want)
        for n in nodes:
            own = 0 if n.tag == "a" else sum(ink(c) for c in n.children if isinstance(c, str))
            assert n.total == pytest.approx(own + sum(c.density for c in n.children if isinstance(c, Node)))


def test_hostile_pages_take_linear_time():
    import time

    began = time.perf_counter()
    assert main_text("<div>" * 20_000 + "x y" + "</b></i>" * 20_000) == "x y"
    assert main_text("<p>a" + "<span>" * 3_000 + "x" + "</span>" * 3_000) == "ax"
    assert time.perf_counter() - began < 10


def test_extract_pages_rows(spark):
    rows = [(1, "u", "<p>a  b</p>", "x"), (1, "u", "<p>a  b</p>", "x"), (None, None, None, "x"), (2, "v", "", "x")]
    got = extract_pages(spark.createDataFrame(rows, "page_id long, url string, html string, text string")).collect()
    assert Counter(map(tuple, got)) == Counter([(1, "u", "a b", 3), (1, "u", "a b", 3), (None, None, "", 0), (2, "v", "", 0)])


def test_filters_return_all_languages_with_an_ngram():
    codes = {"a": grams("the quick brown fox"), "b": grams("der schnelle braune fuchs"), "c": grams("the brown")}
    f = LanguageFilters.build(codes, slots=1 << 16)
    hits, n = f.hits("the brown")
    assert n > hits[0] >= n / 2 and hits[2] == n and hits[1] < n / 2
    assert f.predict("der fuchs")[0] == "b"
    assert f.predict(None) == f.predict("12 34 !") == ("und", 0.0)
    many = LanguageFilters.build({f"l{i}": grams(f"language number {chr(97 + i)}{chr(98 + i)}{chr(99 + i)} words") for i in range(20)}, slots=1 << 16)
    assert many.predict("hij words")[0] == "l7"
    with pytest.raises(ValueError):
        LanguageFilters.build({str(i): grams("x y z") for i in range(65)})


def test_filters_equal_exact_gram_sets(spark):
    """Predictions by bit-sliced filters against whole sets of n-grams, learned by counting in plain Python."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").where("text is not null")
    filters = fit_languages(docs, "text", "lang", "doc_id", sample=10**9, profile=10**9, share=0.0)
    sets = {}
    rows = docs.select("doc_id", "text", "lang").collect()
    for r in rows:
        if r.lang is not None:
            sets.setdefault(r.lang, set()).update(grams(r.text).tolist())
    assert filters.languages == sorted(sets)
    got = {r.doc_id: r for r in identify_languages(docs.select("doc_id", "text"), filters).collect()}
    for r in rows:
        codes = grams(r.text).tolist()
        exact = {x: sum(c in s for c in codes) for x, s in sets.items()}
        hits, n = filters.hits(r.text)
        assert n == len(codes) and all(hits[i] >= exact[x] for i, x in enumerate(filters.languages))
        corrected, _ = filters.corrected(r.text)
        assert all(abs(corrected[i] - exact[x]) <= 0.02 * n + 3 for i, x in enumerate(filters.languages))
        if (g := got[r.doc_id]).lang_pred != "und":
            ranked = sorted(exact.values())
            assert exact[g.lang_pred] == ranked[-1] or exact[g.lang_pred] >= ranked[-1] - 0.02 * n - 3
            assert g.score == pytest.approx(exact[g.lang_pred] / n, abs=0.03 + 3 / n)


def test_more_labels_than_a_mask_has_bits(spark):
    word = lambda i: f"{chr(97 + i // 26)}{chr(97 + i % 26)}" * 3
    rows = [(i, f"{word(i)} {word(i)}", f"l{i:03}", "s", 1, "", "", "") for i in range(130)]
    docs = frame(spark, rows)
    got = identify_languages(docs.select("doc_id", "text"), fit_languages(docs, "text", "lang", "doc_id")).collect()
    assert len(got) == 130 and all(r.lang_pred == f"l{r.doc_id:03}" for r in got)


def test_held_out_languages(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    filters = fit_languages(docs.where(~held_out()), "text", "lang", "doc_id", sample=400)
    got = identify_languages(docs.select("doc_id", "text"), filters).join(docs.select("doc_id", "lang"), "doc_id").where(held_out()).collect()
    assert sum(r.lang == r.lang_pred for r in got) >= 0.98 * len(got) > 100
    assert all(0 <= r.score <= 1 for r in got)
    nobody = fit_languages(docs.limit(0), "text", "lang", "doc_id")
    assert identify_languages(docs.select("doc_id", "text").limit(3), nobody).first().lang_pred == "und"
    odd = identify_languages(frame(spark).select("doc_id", "text"), filters).collect()
    assert len(odd) == len(documents()) and sum(r.lang_pred == "und" for r in odd) == 3
