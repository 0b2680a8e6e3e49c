"""Main text of web pages by tree scoring of paragraph points."""

from __future__ import annotations

import re
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame

OUT_SCHEMA = "page_id long, url string, text string"
_OUT = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("text", pa.string())])

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*+>|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>",
    re.S,
)
_ATTRIBUTE = re.compile(r"([^\s=\"'/>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_CLASS = re.compile(r"(?:^|[\s\"'/])class\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_SPACE = re.compile(r"\s+")

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe noembed noframes xmp".split())
BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section"
    " summary table tbody td tfoot th thead tr ul caption".split()
)
DROPPED = frozenset("head script style noscript template svg math iframe object embed canvas audio video nav footer aside form menu button select option textarea input dialog title noembed noframes".split())
DROPPED_ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert menu menubar toolbar form status".split())
#: Names of what is not article text, within articles too.
CLEAR = frozenset(
    "ad ads adsbygoogle adv advert adverts advertisement advertising adsense adbox sponsor sponsored promo comments commentlist replies respond disqus outbrain taboola sidebar sidebars"
    " nav navbar navigation breadcrumb breadcrumbs pagination pager masthead topbar footer colophon gdpr newsletter toolbar".split()
)
#: Names that can also be an article's own subject or section.
DOUBTFUL = frozenset(
    "banner promotion comment reply discussion feedback responses disclaimer aside menu menus header foot copyright cookie cookies consent notice notices alert popup modal overlay"
    " subscribe subscription signup login form search share sharing social related recommended widget widgets skip hidden".split()
)
#: Words that say nothing beside one of those: related-posts is a list, related-work may be a section.
NEUTRAL = frozenset(
    "area areas section list lists box block wrap wrapper container content inner outer bar panel item items text body title head link links button buttons icon icons group row col column"
    " left right top bottom main site page primary secondary mobile desktop global post posts article articles entry story stories news blog thread zone slot unit wp mw js".split()
)
CLOSES_P = BLOCK - {"body", "html", "caption", "td", "th", "tr", "tbody", "thead", "tfoot", "legend", "summary", "figcaption"}
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
FLOW = HEADINGS | {"p", "pre", "blockquote", "ul", "ol", "dl", "table", "figure"}
LINKED = 0.5  # the share of text in links from which a container beside the best one is a list of links
INLINE_NAMED = HEADINGS | {"p", "pre", "blockquote", "dd", "dt"}  # and all inline elements
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
#: Elements that end where the next one of the first set begins, unless one of the second is in between.
_SCOPES = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "tr": ({"tr"}, {"table"}),
    "tbody": ({"tr", "tbody", "thead", "tfoot"}, {"table"}),
}
_SCOPE = {"li": "li", "dt": "dd", "dd": "dd", "td": "td", "th": "td", "tr": "tr", "tbody": "tbody", "thead": "tbody", "tfoot": "tbody"}
_SCOPES_OF = {t: [k for k, (ends, stops) in _SCOPES.items() if t in ends | stops] for t in frozenset().union(*(a | b for a, b in _SCOPES.values()))}
#: Parts of what an article itself is called: entry-header holds the article's heading.
OWN = frozenset("entry post article story content".split())


class Node:
    __slots__ = ("tag", "parent", "items", "dropped", "score", "text", "linked", "named", "doubt", "style", "articles", "block", "near", "cleared")

    def __init__(self, tag: str, parent: Node | None, dropped: bool = False, named: bool = False, doubt: bool = False, style: str = ""):
        self.tag, self.parent, self.items, self.dropped, self.score, self.named, self.doubt, self.style = tag, parent, [], dropped, 0.0, named, doubt, style
        self.text = self.linked = 0  # code points of text, and of text in links, below
        self.cleared = False
        # what an open element needs of its ancestors, itself included, so that nothing walks up to the root
        self.articles = (parent.articles if parent else 0) + (tag in ("article", "main"))
        self.block = self if tag in BLOCK or parent is None else parent.block
        self.near = parent.near if parent else {}
        scopes = _SCOPES_OF.get(tag)
        if scopes:
            self.near = self.near | dict.fromkeys(scopes, self)


def _judge(tag: str, name: str, value: str, section: bool, in_article: bool) -> tuple[bool, bool]:
    """Whether a class or id says that an element is not article text, and whether that holds only for lists of links.

    Ids of headings, paragraphs and sections are slugs of their text and say nothing. Of those elements and of inline
    ones only a whole clear class counts. Elsewhere a token counts whose words are all names or neutral; a doubtful one
    in an article, and a doubtful id of one word anywhere, only for lists of links.
    """
    tokens = value.split()
    if tag not in BLOCK or tag in INLINE_NAMED:
        return name == "class" and any(t.lower() in CLEAR for t in tokens), False
    named = doubt = False
    for token in tokens:
        words = [w.lower() for w in _WORD.findall(token)]
        if not words or not token.isascii() or not all(w in CLEAR or w in DOUBTFUL or w in NEUTRAL for w in words):
            continue
        clear = any(w in CLEAR for w in words)
        if clear or any(w in DOUBTFUL for w in words):
            own = any(w in OWN for w in words) and any(w in ("header", "head") for w in words)
            weak = section and name == "id" or not clear and (own or section or in_article or name == "id" and len(words) == 1)
            named, doubt = named or not weak, doubt or weak
    return named, doubt


def _unlikely(tag: str, attributes: str, style: str, in_article: bool) -> tuple[bool, bool, bool]:
    """Whether an element is left out by its tag, by its attributes, and by its attributes if it is a list of links."""
    if tag in DROPPED:
        return True, False, False
    named = doubt = False
    for m in _ATTRIBUTE.finditer(attributes):
        name, value = m[1].lower(), unescape(m[2] or m[3] or m[4] or "")
        if name == "hidden" or name == "aria-hidden" and value.lower() == "true" or name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
            return True, False, False
        if name == "role" and value.lower() in DROPPED_ROLES:
            return True, False, False
        if name in ("class", "id") and tag not in ("body", "html", "main"):
            says = _judge(tag, name, value, tag == "section" or "section" in style.split(), in_article)
            named, doubt = named or says[0], doubt or says[1]
    return tag == "header" and not in_article, named, doubt


def parse(html: str) -> Node:
    """A forgiving tree: unclosed paragraphs, list items and cells end where the next begins; stray ends are ignored."""
    root = Node("html", None)
    node, at, n = root, 0, len(html)
    doubts = False
    open_: dict = {}  # open elements by tag; of inline ones by their block, too

    def key(tag, block):
        return tag if tag in BLOCK else (id(block), tag)

    def leave(node, upto):
        """Close the open elements from node up to, and without, upto."""
        while node is not upto:
            open_[key(node.tag, node.block)] -= 1
            node = node.parent
        return upto

    while at < n:
        m = _TOKEN.search(html, at)
        end = m.start() if m else n
        if end > at:
            node.items.append(unescape(html[at:end]))
        if not m:
            break
        at = m.end()
        tag = (m[2] or m[5] or "").lower()
        if not tag:
            if m[0].startswith("<![CDATA["):
                node.items.append(m[0][9:].removesuffix("]]>"))
            continue
        if m[1] or m[4]:
            if open_.get(key(tag, node.block)):  # an inline end does not close a block
                up = node
                while up.tag != tag:
                    up = up.parent
                node = leave(node, up.parent)
            continue
        if tag in ("html", "body"):
            continue
        attributes = m[3] or m[6] or ""
        if tag in CLOSES_P and node.block.tag == "p":
            node = leave(node, node.block.parent)
        scope = _SCOPE.get(tag)
        if scope:
            up = node.near.get(scope)
            if up is not None and up.tag in _SCOPES[scope][0]:
                node = leave(node, up.parent)
        style = _CLASS.search(attributes) if attributes else None
        style = style[1] or style[2] or style[3] or "" if style else ""
        gone, named, doubt = _unlikely(tag, attributes, style, node.articles > 0)
        doubts = doubts or doubt
        child = Node(tag, node, gone, named, doubt, style)
        if tag in ("article", "main", "h1") and not named:  # what holds the article is no sidebar, whatever its name
            up = node
            while up is not None and not up.cleared:
                up.named, up.doubt, up.cleared, up = False, False, True, up.parent
        node.items.append(child)
        if tag in RAW:
            close = re.compile(rf"</{tag}\s*>", re.I).search(html, at)
            if not child.dropped:
                child.items.append(unescape(html[at : close.start() if close else n]))
            at = close.end() if close else n
        elif tag not in VOID and not attributes.rstrip().endswith("/"):
            node = child
            at_key = key(tag, child.block)
            open_[at_key] = open_.get(at_key, 0) + 1
    if doubts:
        for node in _measure(root, True):
            node.named = node.doubt and _density(node) >= LINKED
    return root


def _measure(root: Node, names: bool) -> list[Node]:
    """Fill text and linked bottom-up over what is not left out; returns the nodes, children after parents."""
    order, stack = [], [(root, False)]
    while stack:
        node, linked = stack.pop()
        order.append(node)
        node.text = node.linked = 0
        for item in reversed(node.items):
            if isinstance(item, str):
                size = len(_SPACE.sub(" ", item).strip())
                node.text += size
                node.linked += size * linked
            elif not item.dropped and not (names and item.named):
                stack.append((item, linked or item.tag == "a"))
    for node in reversed(order):
        if node.parent is not None:
            node.parent.text += node.text
            node.parent.linked += node.linked
    return order


def _inline(node: Node, names: bool, out: list[str]) -> None:
    """The inline text of a node: its own and that of inline descendants."""
    stack = list(reversed(node.items))
    while stack:
        item = stack.pop()
        if isinstance(item, str):
            out.append(item)
        elif item.tag in ("br", "wbr"):
            out.append(" " if item.tag == "br" else "")
        elif not item.dropped and not (names and item.named) and item.tag not in BLOCK:
            stack.extend(reversed(item.items))


def _blocks(node: Node, names: bool, beside: set[int]) -> list[str]:
    """Block texts below a node, in page order, without the nodes whose ids are in beside."""
    out, run = [], []
    stack: list = [node]
    while stack:
        item = stack.pop()
        if item is None:
            text = _SPACE.sub(" ", "".join(run)).strip()
            if text:
                out.append(text)
            run = []
        elif isinstance(item, str):
            run.append(item)
        elif item.tag == "br":
            run.append(" ")
        elif item is node or not item.dropped and not (names and item.named) and id(item) not in beside:
            edge = [None] if item.tag in BLOCK else []
            stack.extend(edge + list(reversed(item.items)) + edge)
    text = _SPACE.sub(" ", "".join(run)).strip()
    return out + [text] if text else out


def _density(node: Node) -> float:
    return node.linked / node.text if node.text else 0.0


def _score(order: list[Node], names: bool, least: int) -> list[Node]:
    """Paragraphs pass points to their ancestors: all to the parent, and half of what it has from each level to the next."""
    for node in order:
        node.score = 0.0
    for node in reversed(order):
        if node.parent is None:
            continue
        node.parent.score += node.score / 2
        if node.tag not in BLOCK:
            continue
        own: list[str] = []
        _inline(node, names, own)
        text = _SPACE.sub(" ", "".join(own)).strip()
        if len(text) >= least:
            node.parent.score += 1 + text.count(",") + min(len(text) / 100, 3.0)
    return [n for n in order if n.score]


def _main(root: Node, names: bool) -> tuple[list[Node], set[int]]:
    """The nodes that hold the article, and the ids of the nodes within them that do not belong.

    From the best container up to the outermost article element everything stays. From there up to the main element,
    or without both up to where the container's ancestors have siblings of the same tag and class with paragraphs,
    all stays but what consists of links. Beside an article without main only what reads like it stays.
    """
    order = _measure(root, names)
    for least in (25, 1):
        scored = _score(order, names, least)
        if scored:
            break
    else:
        return [root], set()
    value = {id(n): n.score * (1 - _density(n)) for n in scored}
    best = max(scored, key=lambda n: value[id(n)])
    path = [best]
    while path[-1].parent is not None:
        path.append(path[-1].parent)

    def others(node):
        return [x for x in node.parent.items if isinstance(x, Node) and x is not node and not x.dropped and not (names and x.named)]

    articles, mains = ([i for i, n in enumerate(path) if n.tag == tag] for tag in ("article", "main"))
    whole = articles[-1] if articles else 0  # up to here nothing goes
    if mains and mains[-1] > whole:
        top = strict = mains[-1]
    elif articles or mains:
        strict = max(articles[-1:] + mains[-1:])
        top = strict + 1
    else:
        like = [i for i, n in enumerate(path[:-1]) if n.text == best.text or any((x.tag, x.style) == (n.tag, n.style) and value.get(id(x)) and _density(x) < LINKED for x in others(n))]
        top = strict = min(max(like, default=0) + 1, len(path) - 1)
    bar = max(10.0, 0.2 * value[id(best)])
    far = [x for n in path[whole:strict] for x in others(n) if _density(x) >= LINKED and x.tag not in HEADINGS and value.get(id(x), 0.0) < bar]
    beside = {id(x) for x in far}
    if top == strict:
        return [path[top]], beside
    near = {id(x) for x in others(path[strict]) if value.get(id(x), 0.0) >= bar or x.tag in FLOW and x.text and _density(x) < 0.25}
    return [x for x in path[top].items if x is path[strict] or id(x) in near], beside


def extract(html: str | None) -> str:
    """The main text: blocks of the article around the best container, joined by two newlines.

    Elements whose class or id names say that they are not article text are left out, unless nothing else has text;
    headings, paragraphs and sections are not judged by their ids.
    """
    root = parse(html or "")
    for names in (True, False):
        nodes, beside = _main(root, names)
        blocks = [b for n in nodes for b in _blocks(n, names, beside)]
        if blocks:
            return "\n\n".join(blocks)
    return ""


def extract_pages(pages: DataFrame) -> DataFrame:
    """Main text of every page, from its whole html: page_id, url, text.

    pages needs page_id, url and html; other columns are ignored. Null or empty html, and html without article text,
    give ''. Null urls and page_ids are passed on; repeated rows give equal rows; of equally scored containers the
    outer, then the earlier one is taken; an empty table gives an empty result.
    """

    def run(batches):
        for batch in batches:
            ids, urls, html = (batch.column(i).to_pylist() for i in range(3))
            for i in range(0, len(ids), 500):
                part = slice(i, i + 500)
                yield pa.RecordBatch.from_arrays([pa.array(ids[part], pa.int64()), pa.array(urls[part], pa.string()), pa.array([extract(h) for h in html[part]], pa.string())], schema=_OUT)

    return pages.selectExpr("CAST(page_id AS BIGINT)", "url", "html").mapInArrow(run, OUT_SCHEMA)
