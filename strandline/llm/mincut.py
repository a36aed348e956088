"""HTML main text by minimum-cut labelling.

A page is read into text blocks with the elements around them. A logistic classifier gives each block log-odds of being
content from its words, links, punctuation and tag, and from what the elements around it say by name; its cost for
either label becomes the capacity to a terminal. Blocks that follow each other, on the page or among the children of one
element, are tied by smoothness edges that weigh more the nearer the two are in the tree. The minimum cut, found by
maximum flow, separates content from boilerplate. Blocks whose own cost outweighs all their edges are fixed first, which
never changes the cut, so most pages leave few blocks to the flow.

All weights are fitted by fitted() on TRAINING_PAGES made-up pages with known main text (page_maker): the classifier's by
penalized maximum likelihood, an edge's by how often blocks in its relation share their label, and one factor on all
edges by the labels that the cut gets right on pages that the rest was not fitted on. The pages are a fixed number, take
about two seconds of the driver, and give the same weights everywhere.
"""

from __future__ import annotations

import html as _html
import math
import operator
import re
from collections import deque
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.session import map_arrow, ship_package

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Their content is no text of the page.
SKIPPED = frozenset("script style noscript template iframe svg canvas audio video object head title".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rb rp rt ruby s samp small span strike strong sub sup time tt u var wbr img".split())
#: An opening tag ends an open element of these names first, within the nearest of the second set.
ENDS = {"p": ({"p"}, {"div", "article", "section", "td", "th", "li", "body", "blockquote", "main", "aside", "header", "footer", "nav", "form"})}
ENDS |= {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"})}

BOILERPLATE_TAGS = frozenset("nav footer aside form menu dialog button select fieldset textarea".split())
BOILERPLATE_ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert menu menubar form toolbar".split())
BOILERPLATE_WORDS = frozenset(
    "ad ads adbox adslot adunit advert adverts advertisement advertising adsense adsbygoogle sponsor sponsored sponsors promo promos promotion banner cookie cookies consent gdpr notice notices alert popup modal overlay"
    " newsletter subscribe subscription signup signin login register social share sharing shares related recommended recommendations sidebar sidebars rail menu menus nav navs navbar navigation topnav subnav breadcrumb breadcrumbs"
    " footer footers masthead topbar toolbar comment comments commentlist disqus reply replies respond discussion reader-comments widget widgets pagination pager skip search searchbox searchform form copyright disclaimer legal tags taglist byline-links outbrain taboola".split()
)
COMMENT_WORDS = frozenset("comment comments commentlist disqus reply replies respond discussion".split())
#: Of elements that wrap a whole page, as in "layout has-sidebar": their other words say nothing about what they hold.
LAYOUT_WORDS = frozenset("has with without no layout wrap wrapper page container site row columns main content root app".split())
CONTENT_WORDS = frozenset("article articlebody post entry content story body text main".split())
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
_TAG = re.compile(r"""<(/?)([A-Za-z][^\s/>]*)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>""")
_LOOSE = re.compile(r"<(/?)([A-Za-z][^\s/>]*)([^>]*)>")
_ATTR = re.compile(r"""([^\s=/"']+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
_RIGHTS = re.compile(r"©|\bcopyright\b|all rights reserved|\bcookies?\b|\bsubscribe\b", re.IGNORECASE)
_SENTENCE = re.compile(r"[.!?…。！？][\"'»”’)\]]*(?:\s|$)")

TRAINING_PAGES, TRAINING_SEED = 800, 1_000_000
#: Of the squared weights of the classifier.
PENALTY = 0.5
FACTORS = (0.0, 0.25, 0.5, 0.75, 1.0, 1.5, 2.0)
FEATURES = (
    "bias", "log_words", "ten_words", "link_share", "mostly_links", "sentence", "paragraph", "heading", "item", "no_element", "article",
    "content_name", "boilerplate_tag", "boilerplate_name", "boilerplate_in_article", "boilerplate_around_article", "comments", "header", "rights", "plain_page",
)
#: Steps in the tree from one block's element to the other's, at most, by whether marked elements lie in between.
FAR = 6


@dataclass(slots=True, eq=False)
class Element:
    tag: str
    parent: Element | None
    words: frozenset[str] = frozenset()
    hard: bool = False  # by tag or role
    article: bool = False  # an article or main part
    holds_article: bool = False
    hidden: bool = False  # or inside such an element
    block: bool = True
    depth: int = 0
    facts: tuple[float, ...] | None = None


@dataclass(slots=True)
class Block:
    element: Element
    text: str
    linked: int = 0  # characters in links
    chars: int = 0


@dataclass(slots=True)
class _Reader:
    blocks: list[Block] = field(default_factory=list)
    parts: list[str] = field(default_factory=list)
    owner: Element | None = None
    linked: int = 0

    def flush(self) -> None:
        if self.parts:
            text = " ".join("".join(self.parts).split())
            if text and not self.owner.hidden:
                self.blocks.append(Block(self.owner, text, self.linked, sum(map(len, self.parts))))
            self.parts, self.linked = [], 0


def _element(tag: str, attrs: str, parent: Element) -> Element:
    e = Element(tag, parent, article=tag in ("article", "main"), hard=tag in BOILERPLATE_TAGS, hidden=parent.hidden, depth=parent.depth + 1)
    if attrs and not attrs.isspace():
        for m in _ATTR.finditer(attrs):
            name = m[1].lower()
            value = m[2] or m[3] or m[4] or ""
            if name in ("class", "id", "itemprop"):
                if tag not in ("html", "body"):
                    e.words |= {w.lower() for w in _WORD.findall(value)}
            elif name == "role":
                role = value.strip().lower()
                e.hard |= role in BOILERPLATE_ROLES
                e.article |= role in ("main", "article")
            elif name == "hidden" or (name == "aria-hidden" and value.lower() == "true") or (name == "style" and "display:none" in value.replace(" ", "").lower()):
                e.hidden = True
    e.article &= not e.words & BOILERPLATE_WORDS
    e.block = tag not in INLINE or e.hidden != parent.hidden or bool(e.words & BOILERPLATE_WORDS)  # a marked inline element is a block of its own
    if e.article:
        up = parent
        while up is not None and not up.holds_article:
            up.holds_article = True
            up = up.parent
    return e


def read_blocks(page: str) -> list[Block]:
    """Text blocks in page order. Inline elements and unknown ones inside a block don't end it; br is white space."""
    root = Element("#root", None)
    stack, r, at, n, links = [root], _Reader(), 0, len(page), 0

    def text(s: str) -> None:
        if s:
            if "&" in s:
                s = _html.unescape(s)
            if not r.parts:
                r.owner = next(e for e in reversed(stack) if e.block)
            r.parts.append(s)
            if links:
                r.linked += len(s)

    unclosed: set[str] = set()
    while at < n:
        lt = page.find("<", at)
        if lt < 0:
            text(page[at:])
            break
        if lt > at:
            text(page[at:lt])
        following = page[lt + 1 : lt + 2]
        if following == "!" or following == "?":
            end = page.find("-->", lt + 4) + 3 if page.startswith("<!--", lt) else page.find(">", lt) + 1
            at = end if end > lt + 3 or (end > lt and not page.startswith("<!--", lt)) else n
            continue
        m = _TAG.match(page, lt) or _LOOSE.match(page, lt) if following == "/" or following.isalpha() else None
        if m is None:
            if following == "/" or following.isalpha():
                if page.find(">", lt) < 0:  # a tag that the page's end cuts off
                    break
            text("<")
            at = lt + 1
            continue
        at = m.end()
        closing, tag = m[1], m[2].lower()
        if tag == "br":
            text(" ")
            continue
        inline = tag in INLINE
        if not inline:
            r.flush()
        if closing:
            if any(e.tag == tag for e in stack):
                while True:
                    e = stack.pop()
                    links -= e.tag == "a"
                    if e.block:
                        r.flush()
                    if e.tag == tag:
                        break
            continue
        if tag in SKIPPED:
            if not m[3].endswith("/"):
                close = None if tag in unclosed else re.compile(f"</{re.escape(tag)}(?=[\\s/>])|<body(?=[\\s>])" if tag == "head" else f"</{re.escape(tag)}(?=[\\s/>])", re.IGNORECASE).search(page, at)
                if close is None:
                    unclosed.add(tag)  # nor is any later one closed
                    at = n if tag in ("script", "style", "title", "iframe") else at  # the others' content is markup
                elif close[0].lower() == "<body":
                    at = close.start()
                else:
                    end = page.find(">", close.end())
                    at = end + 1 if end >= 0 else n
            continue
        if tag in VOID:
            continue
        ends = ENDS.get(tag) or (None if inline else ENDS["p"])
        if ends:
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag in ends[0]:
                    for e in stack[i:]:
                        links -= e.tag == "a"
                    del stack[i:]
                    break
                if stack[i].tag in ends[1]:
                    break
        stack.append(_element(tag, m[3], stack[-1]))
        links += tag == "a"
        if inline and stack[-1].block:
            r.flush()
    r.flush()
    return r.blocks


def element_facts(e: Element) -> tuple[float, ...]:
    """What the elements around a block say: an article; a name of content; boilerplate by tag or role, and by name, up to
    the article's element; either of them in an article, and around one; comments; a header outside of
    articles."""
    if e.facts is None:
        article = content = tag = name = around = comments = header = False
        x = e
        while x is not None:
            wraps = x.holds_article and (x.tag == "form" or bool(x.words & LAYOUT_WORDS))
            if not wraps:
                comments |= bool(x.words & COMMENT_WORDS)
                bad_tag, bad_name = x.hard, bool(x.words & BOILERPLATE_WORDS)
                if article:
                    around |= bad_tag or bad_name
                else:
                    tag |= bad_tag
                    name |= bad_name
            article |= x.article
            content |= bool(x.words & CONTENT_WORDS)
            if (x.tag == "header" or "header" in x.words) and not article and not x.words & CONTENT_WORDS and not _in_article(x):
                header = True
            x = x.parent
        e.facts = tuple(map(float, (article, content, tag, name, article and (tag or name), around, comments, header)))
    return e.facts


def _in_article(e: Element | None) -> bool:
    while e is not None and not e.article:
        e = e.parent
    return e is not None


def is_plain(blocks: list[Block]) -> bool:
    """No marked element and no block of links."""
    return not any(2 * b.linked > b.chars or any(element_facts(b.element)) for b in blocks)


def block_features(b: Block, plain: bool = False) -> tuple[float, ...]:
    """FEATURES of a block of a page that is plain or not."""
    words, tag = b.text.count(" ") + 1, b.element.tag
    share = min(1.0, b.linked / max(1, b.chars))
    return (
        1.0,
        min(6.0, math.log2(1 + words)),
        float(words >= 10),
        share,
        float(share > 0.5),
        float(_SENTENCE.search(b.text) is not None),
        float(tag == "p"),
        float(tag in ("h1", "h2", "h3", "h4", "h5", "h6")),
        float(tag in ("li", "td", "th", "dt")),
        float(tag in ("#root", "body", "html")),
        *element_facts(b.element),
        float(words < 25 and _RIGHTS.search(b.text) is not None),
        float(plain),
    )


def _relation(a: Element, b: Element) -> int:
    """Steps from a to b through the tree, FAR at most; FAR + 1 if one is in an article or marked element and the other
    is not, by whichever mark."""
    if a is b:
        return 0
    if element_facts(a) != element_facts(b):
        return FAR + 1
    steps = 0
    while a is not b and steps < FAR:
        if a.depth >= b.depth:
            a = a.parent
        else:
            b = b.parent
        steps += 1
    return steps


def neighbours(blocks: list[Block]) -> list[tuple[int, int, int]]:
    """Pairs of blocks that follow each other on the page, or among the blocks of one parent element, and their relation."""
    edges, last = [], {}
    for i, b in enumerate(blocks):
        home = id(b.element.parent if b.element.parent is not None else b.element)
        if i:
            edges.append((i - 1, i, _relation(blocks[i - 1].element, b.element)))
        if last.get(home, i - 1) != i - 1:
            edges.append((last[home], i, _relation(blocks[last[home]].element, b.element)))
        last[home] = i
    return edges


@dataclass(frozen=True)
class Weights:
    unary: tuple[float, ...]  # by FEATURES
    edges: tuple[float, ...]  # by relation

    def log_odds(self, blocks: list[Block]) -> list[float]:
        plain = is_plain(blocks)
        return [sum(map(operator.mul, self.unary, block_features(b, plain))) for b in blocks]

    def smoothness(self, blocks: list[Block]) -> list[tuple[int, int, float]]:
        return [(a, b, self.edges[r]) for a, b, r in neighbours(blocks) if self.edges[r] > 0]

    def labels(self, blocks: list[Block]) -> list[bool]:
        return minimum_cut(self.log_odds(blocks), self.smoothness(blocks))


def labelled_blocks(seed: int) -> tuple[list[Block], list[bool]]:
    """Blocks of a made-up page and whether each is main text."""
    from strandline.llm.page_maker import make_page

    page = make_page(seed)
    blocks = read_blocks(page.html)
    return blocks, [b.text in page.content for b in blocks]


def logistic(x: np.ndarray, y: np.ndarray, penalty: float) -> np.ndarray:
    """Weights of a logistic regression with a squared penalty, by Newton's method."""
    w = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + penalty * np.eye(len(w)), x.T @ (y - p) - penalty * w)
        w += step
        if np.abs(step).max() < 1e-6:
            break
    return w


@lru_cache(1)
def fitted(pages: int = TRAINING_PAGES, seed: int = TRAINING_SEED) -> Weights:
    """Weights from made-up pages: half of them fit classifier and edges, the other half the factor of the edges."""
    made = [labelled_blocks(seed + i) for i in range(pages)]
    first, second = made[: pages // 2], made[pages // 2 :]
    unary = logistic(np.array([block_features(b, plain) for blocks, _ in first for plain in [is_plain(blocks)] for b in blocks]), np.array([y for _, ys in first for y in ys], dtype=float), PENALTY)
    alike, unlike = [1] * (FAR + 2), [1] * (FAR + 2)
    for blocks, ys in first:
        for a, b, r in neighbours(blocks):
            (alike if ys[a] == ys[b] else unlike)[r] += 1
    edges = [max(0.0, math.log(a / u)) for a, u in zip(alike, unlike)]
    best = None
    for factor in FACTORS:
        weights = Weights(tuple(round(float(w), 6) for w in unary), tuple(round(factor * e, 6) for e in edges))
        right = sum(x == y for blocks, ys in second for x, y in zip(weights.labels(blocks), ys))
        if best is None or right > best[0]:
            best = (right, weights)
    return best[1]


def minimum_cut(unary: list[float], edges: list[tuple[int, int, float]]) -> list[bool]:
    """Labels minimizing the sum of |unary| of nodes against their sign and of the weights of cut edges."""
    n = len(unary)
    near: list[dict[int, float]] = [{} for _ in range(n)]
    for a, b, w in edges:
        near[a][b] = near[a].get(b, 0.0) + w
        near[b][a] = near[b].get(a, 0.0) + w
    label: list[bool | None] = [None] * n
    cost = list(unary)
    queue, waiting = deque(range(n)), [True] * n
    while queue:
        i = queue.popleft()
        waiting[i] = False
        if label[i] is None and sum(near[i].values()) <= abs(cost[i]) and cost[i]:
            label[i] = cost[i] > 0
            for j, w in near[i].items():  # a fixed neighbour is a cost of its own
                cost[j] += w if label[i] else -w
                del near[j][i]
                if not waiting[j]:
                    waiting[j] = True
                    queue.append(j)
            near[i] = {}
    rest = [i for i in range(n) if label[i] is None]
    if rest:
        place = {i: k for k, i in enumerate(rest)}
        inside = _source_side([cost[i] for i in rest], [(place[i], place[j], w) for i in rest for j, w in near[i].items() if i < j])
        for i in rest:
            label[i] = place[i] in inside
    return [bool(x) for x in label]


def _source_side(cost: list[float], edges: list[tuple[int, int, float]]) -> set[int]:
    """Nodes on the source's side of a minimum cut, by Dinic's maximum flow."""
    n = len(cost)
    source, sink = n, n + 1
    to, room, out = [], [], [[] for _ in range(n + 2)]

    def arc(a: int, b: int, forth: float, back: float) -> None:
        out[a].append(len(to))
        to.append(b)
        room.append(forth)
        out[b].append(len(to))
        to.append(a)
        room.append(back)

    for i, c in enumerate(cost):
        arc(source, i, c, 0.0) if c > 0 else arc(i, sink, -c, 0.0)
    for a, b, w in edges:
        arc(a, b, w, w)
    tiny = 1e-9
    while True:
        level = [-1] * (n + 2)
        level[source] = 0
        queue = deque([source])
        while queue:
            a = queue.popleft()
            for e in out[a]:
                if room[e] > tiny and level[to[e]] < 0:
                    level[to[e]] = level[a] + 1
                    queue.append(to[e])
        if level[sink] < 0:
            return {i for i in range(n) if level[i] >= 0}
        at = [0] * (n + 2)
        path: list[int] = []
        a = source
        while True:  # advance and retreat without recursion
            if a == sink:
                flow = min(room[e] for e in path)
                for e in path:
                    room[e] -= flow
                    room[e ^ 1] += flow
                cut = next(k for k, e in enumerate(path) if room[e] <= tiny)
                a = to[path[cut] ^ 1]
                del path[cut:]
            elif at[a] < len(out[a]):
                e = out[a][at[a]]
                if room[e] > tiny and level[to[e]] == level[a] + 1:
                    path.append(e)
                    a = to[e]
                else:
                    at[a] += 1
            elif a == source:
                break
            else:
                e = path.pop()
                a = to[e ^ 1]
                at[a] += 1


def main_text(page: str | None, weights: Weights | None = None) -> str:
    """Content blocks in page order, joined by one space; empty if there are none."""
    blocks = read_blocks(page or "")
    kept = (weights or fitted()).labels(blocks)
    return " ".join(b.text for b, keep in zip(blocks, kept) if keep)


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of each row of pages (page_id, url, html; others are not read). A null or empty page
    has an empty text; null ids, null urls and repeated rows stay; malformed UTF-8 is read with replacement characters; a
    page is held whole, whatever its length."""
    ship_package(pages.sparkSession)
    weights = fitted()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from strandline.llm.mincut import main_text

        for b in batches:
            texts = [main_text(p.as_py(), weights) for p in b.column(2)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())], names=["page_id", "url", "text", "n_chars"])

    chosen = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.make_valid_utf8(F.col("html").cast("string")).alias("html"))
    return map_arrow(chosen, work, "page_id long, url string, text string, n_chars long")
