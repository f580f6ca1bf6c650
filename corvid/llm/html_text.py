"""Main text of web pages by composite text density.

Every DOM node has a density: characters per tag, times the logarithm of (characters per link character times
tags per link) to a base that grows with the links of the node and of the body. A node's density sum is that of
its children. The container of the largest sum is the centre of the article; the least density on the path from
body to it is the threshold that its surroundings must reach to belong to it. Parts that are furniture by their
element, role, class or id (navigation, footers, adverts, comments, forms) carry no text.
"""

from __future__ import annotations

import html as _html
import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map

_TOKEN = re.compile(r"<!--.*?(?:-->|$)|<!\[CDATA\[.*?(?:\]\]>|$)|<[!?][^>]*(?:>|$)|</([a-zA-Z][^\s/>]*)[^>]*(?:>|$)|<([a-zA-Z][^\s/>]*)((?>=\s*\"[^\"]*\"|=\s*'[^']*'|[^>])*+)(?:>|$)", re.S)
_ATTR = re.compile(r"([^\s=\"'/>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template textarea title xmp iframe noembed noframes svg math select".split())
#: Elements that hold no article text wherever they are.
FURNITURE = frozenset("nav footer aside button dialog menu object audio video canvas head label fieldset".split())
BLOCK = frozenset("address article aside blockquote body center dd details div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html li main nav ol p pre section summary table tbody td tfoot th thead tr ul caption br".split())
#: Elements that can be the chosen subtree.
CONTAINERS = frozenset("body div section article main td center".split())
#: An open p ends where one of these begins.
_ENDS_P = BLOCK - {"br", "body", "html", "td", "th", "tr", "tbody", "thead", "tfoot", "caption"}
_SIBLINGS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
_SCOPE = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table", "tbody", "thead", "tfoot"}, "td": {"tr", "table"}, "th": {"tr", "table"}, "option": {"select"}}
_ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog menu menubar form alert toolbar".split())
#: Words of class and id names that say what is furniture, and those among them that no article text hides behind.
_WORDS = frozenset(
    """ad ads advert adverts advertisement advertisements advertising adsense adslot banner banners sponsor sponsored sponsors promo promos promotion promoted
    cookie cookies consent gdpr notice notices popup modal overlay newsletter subscribe subscription signup paywall
    nav navbar navigation navi menu menus submenu breadcrumb breadcrumbs sidebar sidebars side aside widget widgets footer foot header masthead topbar toolbar
    comment comments commentlist discussion disqus respond replies reply reviews related recommended recommendations teaser teasers
    share sharing social login search searchbox pagination pager skip copyright disclaimer tags trending popular alert toc""".split()
)
_PLAIN = frozenset("ad ads advert adverts advertisement advertisements advertising adsense adslot sponsor sponsored sponsors cookie cookies consent gdpr newsletter subscribe subscription signup paywall login nav navbar navigation menu menus submenu breadcrumb breadcrumbs footer pagination pager".split())
#: Words that only say where an element stands; a name that has any other word beside the ones above is a hint and no more.
_PLACES = frozenset(
    """main content page post posts entry entries site blog box wrapper wrap container inner outer list item items block area section sections top bottom left right
    body text global primary secondary tertiary bar links link button buttons icon icons module panel slot unit row col column card cards user users reader readers
    thread form field group region zone mobile desktop small large new sticky fixed first last my the article articles news story js ui x""".split()
)
#: Those that mark single paragraphs, headings and other text elements too.
_STRONG = frozenset("ad ads advert advertisement advertising sponsored promo cookie cookies newsletter subscribe share sharing social breadcrumb breadcrumbs copyright comment comments navigation menu".split())
_TALK = frozenset("comment comments commentlist discussion disqus respond replies reply".split())
#: A name with one of these says how a page is laid out, not what the element is.
_LAYOUT = frozenset("has no with without open closed enabled disabled hide toggle layout".split())
#: Ends of names written in one word.
_ENDINGS = re.compile(r"(?:navbar|nav|menu|footer|sidebar|comments|commentlist|banner|breadcrumbs?|advert)$")
_TEXT_TAGS = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre li dt dd figcaption span a b i em strong u s q cite code small sub sup mark time td th tr tbody".split())
_ARTICLE_NAME = re.compile(r"(?:user-?|reader-?)?(?:comment|reply|response|user-review|teaser|related|promo|ad|advert|sponsored)(?:[-_]?(?:body|item|content|text|entry|card|post|inner|\d+))*")
_TALK_HEADING = re.compile(r"(?:\d+ )?(?:reader |user )?(?:comments?|leave a (?:comment|reply)|kommentare?|commentaires?|comentarios?)(?: \(?\d+\)?)?:?|\d+ (?:responses?|replies)|(?:responses?|replies) \(\d+\)", re.I)
_CAMEL = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)

#: Why an element may be furniture: a hint in its name, its name or kind, a plain name, a discussion, its element.
KEEP, HINT, SOFT, PLAIN, TALK, HARD = range(6)
#: Characters of a paragraph that count as prose, and links' largest share of it.
PROSE, LINKED = 80, 0.2


class Node:
    __slots__ = ("tag", "children", "parent", "own", "dropped", "text", "ink", "links", "prose", "holds", "some", "whole", "inside", "kept", "lost", "chars", "tags", "link_chars", "link_tags", "density", "total")

    def __init__(self, tag: str, parent: Node | None, own: int = KEEP):
        #: own: why the element itself is furniture; dropped: whether it or what is around it is.
        self.tag, self.parent, self.own, self.dropped = tag, parent, own, False
        self.children: list[Node | str] = []
        self.text = self.chars = self.tags = self.link_chars = self.link_tags = 0
        self.density = self.total = 0.0
        self.inside = self.lost = False


def _attributes(raw: str) -> dict[str, str]:
    return {m[1].lower(): next((x for x in m.groups()[1:] if x is not None), "") for m in _ATTR.finditer(raw)}


def _named(names: str, words: frozenset[str]) -> int:
    """What class and id names say of an element: HINT if one of the words stands beside words of another matter."""
    found = KEEP
    for name in names.split():
        low = name.lower()
        parts = ({w.lower() for w in _CAMEL.findall(name)} if name != low else set()) or set(re.split(r"[-_\d]+", low))
        parts = {w for p in parts for w in re.split(r"[-_\d]+", p) if w}
        if parts & _LAYOUT:
            continue
        hits = parts & words
        if words is _WORDS and not hits and len(parts) == 1 and (m := _ENDINGS.search(low)):
            hits = parts = {m[0]}
        if hits:
            other = {w for w in parts - _WORDS - _PLACES if len(w) > 1}
            found = max(found, HINT if other else TALK if hits & _TALK else PLAIN if hits & _PLAIN else SOFT)
    return found


def _furniture(tag: str, raw: str, inside: bool) -> int:
    """Why an element is furniture; inside: an article or main is open around it."""
    if tag in FURNITURE or tag in RAW:
        return HARD
    soft = SOFT if tag == "form" or tag == "header" and not inside else KEEP
    if tag in ("html", "body") or not raw or raw == "/":
        return soft
    a = _attributes(raw)
    if "hidden" in a or a.get("aria-hidden") == "true" or _HIDDEN.search(a.get("style", "")):
        return HARD
    if a.get("role", "").lower() in _ROLES and tag not in ("main", "article"):
        return max(soft, SOFT)
    names = f"{a.get('class', '')} {a.get('id', '')}".strip()
    if not names or tag == "main" or tag == "header" and inside:
        return soft
    if tag == "article":
        return max(soft, TALK if any(_ARTICLE_NAME.fullmatch(n.lower()) for n in names.split()) else KEEP)
    return max(soft, _named(names, _STRONG if tag in _TEXT_TAGS else _WORDS))


def parse(page: str) -> Node:
    """The element tree; missing end tags of p, li, dt, dd, tr, td and th are implied, other strays are ignored."""
    root = Node("#root", None)
    at, pos, is_open = root, 0, Counter()

    def close_to(node: Node) -> Node:
        up = at
        while up is not node:
            is_open[up.tag] -= 1
            up = up.parent
        return up

    size = len(page)
    while pos < size:
        m = _TOKEN.search(page, pos)
        if m is None:
            at.children.append(_html.unescape(page[pos:]))
            break
        if m.start() > pos:
            at.children.append(_html.unescape(page[pos : m.start()]))
        pos = m.end()
        if m[1]:
            tag = m[1].lower()
            if is_open[tag] > 0:
                up = at
                while up.tag != tag:
                    up = up.parent
                at = close_to(up.parent)
            continue
        if m[2] is None:
            if m[0].startswith("<![CDATA["):
                at.children.append(m[0][9:].removesuffix("]]>"))
            continue
        tag, raw = m[2].lower(), (m[3] or "").strip()
        if tag in ("html", "body") and is_open[tag]:
            continue
        if tag in _ENDS_P and is_open["p"]:
            up = at
            while up is not root and up.tag not in ("p", "td", "th", "li", "div", "article", "section", "body", "blockquote", "table"):
                up = up.parent
            if up.tag == "p":
                at = close_to(up.parent)
        elif tag == "body":
            up = at
            while up.tag not in ("html", "#root"):
                up = up.parent
            at = close_to(up)
        if tag in _SIBLINGS and any(is_open[t] for t in _SIBLINGS[tag]):
            up = at
            while up is not root and up.tag not in _SCOPE[tag] and up.tag not in _SIBLINGS[tag]:
                up = up.parent
            while up.tag in _SIBLINGS[tag]:
                up = at = close_to(up.parent)
        node = Node(tag, at, _furniture(tag, raw, is_open["article"] + is_open["main"] > 0))
        at.children.append(node)
        if tag in VOID or raw.endswith("/") and tag in ("svg", "path", "math"):
            continue
        if tag in RAW:
            end = re.compile(rf"</{tag}(?=[\s/>])[^>]*(?:>|$)", re.I).search(page, pos)
            pos = end.end() if end else size
            continue
        at = node
        is_open[tag] += 1
    return root


def _path(node: Node) -> Iterator[Node]:
    while node is not None:
        yield node
        node = node.parent


def _order(root: Node, every: bool = False) -> list[Node]:
    """All nodes (that may hold text, unless every is set), parents before children, without recursion."""
    out, stack = [], [root]
    while stack:
        n = stack.pop()
        out.append(n)
        stack += [c for c in n.children if isinstance(c, Node) and (every or not c.dropped)]
    return out


def _ink(text: str) -> int:
    """Characters of a text that are not white space."""
    return sum(map(len, text.split()))


def settle(root: Node) -> None:
    """Decide what is dropped.

    Names are evidence, not a verdict. An element that is furniture by its name or kind stays if it holds the page's
    article: an article or main element, or, on a page without one, paragraphs and more than half of the text. A
    name that only hints at furniture needs one paragraph of prose to be overruled, one that says so two, inside an
    article, unless it is a plain one (adverts, menus). Discussions never stay, and a container that begins with a
    heading like "Comments" is one. An article that would lose all its paragraphs keeps them.
    """
    nodes = _order(root, True)
    for n in nodes:
        if n.tag in ("section", "div", "ol", "ul") and n.own == KEEP:
            first = next((c for c in n.children if isinstance(c, Node) or c.strip()), None)
            if isinstance(first, Node) and first.tag in ("h1", "h2", "h3", "h4", "h5", "h6") and _TALK_HEADING.fullmatch(" ".join(_blocks(first, True))):
                n.own = TALK
    # Bottom up: text outside of furniture, links in it, paragraphs of prose; whether an article or a paragraph lies below.
    for n in reversed(nodes):
        text = whole = ink = links = prose = 0
        holds = some = paragraph = False
        for c in n.children:
            if isinstance(c, str):
                text += _ink(c)
            else:
                whole += c.whole
                ink += c.ink
                links += c.links
                prose += c.prose
                holds = holds or c.holds
                some = some or c.some
                paragraph = paragraph or c.kept
        n.text = text
        n.whole = 0 if n.tag in RAW else whole + text
        n.some = some or n.tag == "p" and n.whole > 0
        if n.own < TALK:
            n.ink = ink + text
            n.links = n.ink if n.tag == "a" else links
            good = n.tag == "p" and n.ink >= PROSE and n.links <= LINKED * n.ink
            n.prose = 1 if good else prose
            n.holds = holds or n.tag in ("article", "main") and n.own == KEEP and n.ink > 0
            n.kept = paragraph or n.tag == "p" and n.ink > 0
        else:
            n.ink = n.links = n.prose = 0
            n.holds = n.kept = False
    any_article, half = root.holds, root.ink / 2
    for n in nodes:
        n.inside = n.parent is not None and (n.parent.inside or n.parent.tag == "article" and n.parent.own == KEEP)
        if n.own == KEEP:
            stays = True
        elif n.own >= TALK:
            stays = False
        else:
            stays = n.holds or not any_article and n.kept and n.ink > half
            if not stays and n.links <= LINKED * n.ink:
                stays = n.own == HINT and (n.prose > 0 or n.tag in _TEXT_TAGS) or n.own == SOFT and n.prose > 1 and n.inside
        n.dropped = not stays or n.parent is not None and n.parent.dropped
    if any(n.tag in ("article", "main") for n in nodes) and any(HINT <= n.own <= TALK for n in nodes):
        _refill(nodes)


def _refill(nodes: list[Node]) -> None:
    """An article without a paragraph left keeps what its names alone took away, discussions only if there is nothing else."""
    for level in (PLAIN, TALK):
        for n in reversed(nodes):
            n.kept = n.tag == "p" and n.whole > 0 and not n.dropped or any(c.kept for c in n.children if isinstance(c, Node))
        for n in nodes:
            n.lost = n.tag in ("article", "main") and not n.dropped and n.some and not n.kept or n.parent is not None and n.parent.lost
            if n.lost:
                if HINT <= n.own <= level and n.some:
                    n.own = KEEP
                n.dropped = n.own != KEEP or n.parent.dropped


def composite_density(chars: int, tags: int, link_chars: int, link_tags: int, body_share: float) -> float:
    """chars / tags * log_b(chars / link_chars * tags / link_tags), b = ln(chars / other_chars * link_chars + body_share * chars + e).

    body_share: the share of the body's characters that links hold. Counts of 0 in a denominator or of link characters are taken as 1.
    """
    if not chars:
        return 0.0
    tags, link_tags, links, others = max(tags, 1), max(link_tags, 1), max(link_chars, 1), max(chars - link_chars, 1)
    base = math.log(chars / others * links + body_share * chars + math.e)
    return chars / tags * max(math.log(chars / links * tags / link_tags) / math.log(base), 0.0)


def densities(root: Node) -> list[Node]:
    """Fill in counts, composite densities and density sums; returns the nodes, parents first.

    Text that stands directly in a node counts to its sum as a child without tags and links would: by its characters.
    """
    nodes = _order(root)
    for n in reversed(nodes):
        n.chars = n.text
        for c in n.children:
            if not isinstance(c, str) and not c.dropped:
                n.chars += c.chars
                n.tags += 1 + c.tags
                n.link_chars += c.link_chars
                n.link_tags += c.link_tags
        if n.tag == "a":
            n.link_chars, n.link_tags = n.chars, n.link_tags + 1
    body = next((n for n in nodes if n.tag == "body"), root)
    share = body.link_chars / body.chars if body.chars else 0.0
    for n in nodes:
        n.density = composite_density(n.chars, n.tags, n.link_chars, n.link_tags, share)
    for n in nodes:
        n.total = sum(c.density for c in n.children if isinstance(c, Node) and not c.dropped)
        if n.tag != "a":
            n.total += n.text
    return nodes


def _blocks(node: Node, every: bool = False, only: set[int] | None = None) -> list[str]:
    """Texts of the blocks below a node in page order; only: of the node's children at any level, those to go into."""
    out, part = [], []

    def close():
        joined = " ".join("".join(part).split())
        part.clear()
        if joined:
            out.append(joined)

    stack: list[tuple[Node | str, int]] = [(node, 0)]
    while stack:
        x, done = stack.pop()
        if isinstance(x, str):
            part.append(x)
        elif done:
            close()
        elif every or not x.dropped:
            if x.tag in BLOCK:
                close()
                stack.append((x, 1))
            stack += [(c, 0) for c in reversed(x.children) if only is None or id(x) not in only or isinstance(c, str) or id(c) in only or -id(c) in only]
    close()
    return out


def _belongs(node: Node, threshold: float) -> bool:
    """Whether a node beside the article's centre is part of it: a heading, or text blocks as dense as the path; not mostly links."""
    if node.dropped or not node.chars or 2 * node.link_chars >= node.chars:
        return False
    if node.tag in ("h1", "h2", "h3", "h4", "h5", "h6"):
        return True
    if node.density < threshold:
        return False
    flow = ("p", "ul", "ol", "dl", "pre", "blockquote", "figure", "table")
    return node.tag in flow or any(n.tag == "p" and n.chars for n in _order(node))


def main_text(page: str | None) -> str:
    """The article's text: white space inside a block is one space, blocks are joined by one space."""
    if not page:
        return ""
    root = parse(page)
    settle(root)
    kept = [n for n in densities(root) if n.chars]
    if not kept:
        return ""
    body = next((n for n in kept if n.tag == "body"), root)
    # Paragraphs, headings and inline elements belong to the container that holds them.
    best = max([n for n in kept if n.tag in CONTAINERS] or [root], key=lambda n: n.total)
    path = list(_path(best))
    threshold = min((n.density for n in path[: path.index(body) + 1 if body in path else None] if n.density > 0), default=0.0)
    # The innermost article around the centre is the article, with its headings and short paragraphs, but without blocks of links.
    article = next((n for n in path if n.tag == "article"), None)
    if article is not None:
        around = {id(n) for n in path}
        for n in _order(article):
            if n.tag in ("div", "section") and id(n) not in around and n.link_tags > 2 and 5 * n.link_chars >= 4 * n.chars and n.density < threshold:
                n.dropped = True
        return " ".join(_blocks(article))
    # Climb to the innermost main, or to the body, as long as each level has dense blocks beside the centre or nothing else.
    top, whole = best, {id(best)}
    limit = next((n for n in path if n.tag == "main"), body)
    through: set[int] = set()
    while top is not limit and top is not root:
        beside = [c for c in top.parent.children if isinstance(c, Node) and c is not top and not c.dropped and c.chars]
        more = [c for c in beside if _belongs(c, threshold)]
        if beside and not more:
            break
        through.add(id(top.parent))
        whole |= {id(c) for c in more}
        top = top.parent
    # Nodes climbed through give way to what belongs to the article; everything below that is whole.
    return " ".join(_blocks(top, only=through | {-x for x in whole})) if through else " ".join(_blocks(best))


def extract_pages(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url, text, n_chars for every page; nothing is capped.

    A null or empty page, or one without article text, has text "" and 0 characters. Character references are
    decoded. Repeated rows and null ids or urls pass through; among equal density sums the first node of the page
    counts. Broken markup (tags left open, a page cut short) is read as browsers do in the common cases. Only the
    three named columns are read. An empty table gives an empty result. One pass, no shuffle.
    """
    id_type, url_type = (pages.schema[c].dataType.simpleString() for c in (id_col, url_col))

    def run(batches):
        for batch in batches:
            texts = [main_text(x.as_py()) for x in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    d = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("_html"))
    return arrow_map(d, run, f"page_id {id_type}, url {url_type}, text string, n_chars long")
