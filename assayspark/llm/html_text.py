"""Main text of web pages: boosted trees over DOM nodes, decoded from the root down.

A tolerant reader builds the tree of elements and text nodes. Each node has features of its own
(tag, attribute tokens, depth, place among its siblings) and of its subtree (text, links,
punctuation, density). A forest gives the probability that the subtree holds main text. Decoding
picks the likeliest set of nodes in which a node is chosen only if its parent is, so an ancestor
and a descendant never contradict each other; the text nodes chosen are the main text.

The forest learns from at most ``PAGES`` pages that mark their article (``article``, ``main`` or
``role=main``). Each is read as it is and once more with its mark changed to another container and
with boilerplate of the usual kinds put in, so that it does not hang on one mark or one template.

Blocks are block elements; ``br`` is white space. Defined cases: null and empty html give an
empty text; html without tags is read as text of the body; repeated rows get equal texts; an
empty table gives no rows; if no page marks its article, every text outside scripts counts.
"""

from __future__ import annotations

import html as references
import math
import random
import re
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assayspark.llm import boosting
from assayspark.llm.shared import append_columns, query, table

PAGES = 300
LARGEST = 60_000  # characters of a page to learn from
BLOCK_CHARS = 1_000_000

#: Groups of HTML elements.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = {"script", "style", "textarea", "title", "iframe"}
HIDDEN = {"noscript", "template", "svg", "select", "object"}
BLOCK = set(
    "address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hr html li main menu nav ol p pre section summary table tbody tfoot thead tr ul".split())
ENDS_P = BLOCK - {"body", "html", "tr", "tbody", "thead", "tfoot", "li", "dd", "dt", "summary", "figcaption"}
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
INLINE = set("a abbr b bdi bdo cite code data dfn em font i kbd label mark q s samp small span strong sub sup time u var".split())
_AROUND_ITEMS = ("ul", "ol", "dl", "table", "tbody", "div")
#: Items that end the item before them, and the elements beyond which they do not.
ITEMS = {
    "li": (("li",), (*_AROUND_ITEMS, "tr")), "option": (("option",), (*_AROUND_ITEMS, "tr")), "tr": (("tr",), _AROUND_ITEMS),
    **dict.fromkeys(("dd", "dt"), (("dd", "dt"), (*_AROUND_ITEMS, "tr"))), **dict.fromkeys(("td", "th"), (("td", "th"), (*_AROUND_ITEMS, "tr"))),
}
#: Attribute words that pages use for their article and for what is around it.
INSIDE = set("article articlebody content main post entry body text story page blog single prose read".split())
AROUND = set(
    "ad ads advert advertisement adverts banner sponsor sponsored promo promotion nav navbar navigation menu breadcrumb breadcrumbs "
    "header head masthead footer foot copyright legal sidebar side aside widget related recommended more comment comments reply "
    "replies discussion disqus respond share social follow subscribe newsletter signup login search form contact cookie cookies "
    "consent notice alert popup modal overlay gdpr toolbar pagination pager tags meta author toc skip hidden".split())

_TAG = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>|</([a-zA-Z][^\s/>]*)[^>]*>|"
    r"<([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"<>]*\"|'[^'<>]*'|[\"'])*+)>", re.S)
_OPEN = re.compile(r"(?:<!--|<!\[CDATA\[).*()()()", re.S)
_SHUT = re.compile(r"<!--.*-->\Z|<!\[CDATA\[.*\]\]>\Z", re.S)
_ATTRIBUTE = re.compile(r"([a-zA-Z_:][-\w:.]*)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))")
_WORD = re.compile(r"[A-Za-z]+")
_WHITE = re.compile(r"\s+")

TAGS = [
    ("is_p", {"p"}), ("is_heading", HEADINGS), ("is_article", {"article", "main"}), ("is_generic", {"div", "section"}),
    ("is_nav", {"nav", "menu"}), ("is_header", {"header"}), ("is_footer", {"footer"}), ("is_aside", {"aside"}),
    ("is_form", {"form", "fieldset", "button", "label"}), ("is_list", {"ul", "ol", "dl"}), ("is_item", {"li", "dd", "dt"}),
    ("is_link", {"a"}), ("is_inline", INLINE - {"a"}), ("is_table", {"table", "tr", "td", "th", "tbody", "thead"}),
    ("is_quote", {"blockquote", "pre", "figure", "figcaption"}), ("is_text", {"#text"}), ("is_root", {"html", "body"}),
]
FEATURES = [name for name, _ in TAGS] + [
    "around_words", "inside_words", "above_around", "above_inside", "above_aside", "depth", "log_text", "link_share", "text_share",
    "log_elements", "density", "paragraphs", "siblings", "sibling_place", "parent_share", "place", "above_form",
]


class Node:
    __slots__ = ("attributes", "children", "parent", "tag", "text")

    def __init__(self, tag: str, parent: Node | None, attributes: str = "", text: str = ""):
        self.tag, self.parent, self.attributes, self.text = tag, parent, attributes, text
        self.children: list[Node] = []
        if parent is not None:
            parent.children.append(self)


def empty(attributes: str) -> bool:
    """Whether a tag closes itself; a slash that ends an unquoted value does not."""
    return attributes.endswith("/") and (len(attributes) == 1 or attributes[-2] in " \t\r\n\f\"'" or "=" not in attributes.split()[-1])


class Path:
    """The open elements from the root down; what stands where is known by tag, so no step walks up the tree."""

    def __init__(self, root: Node):
        self.nodes = [root]
        self.depths: dict[str, list[int]] = {}
        self.blocks: list[int] = []  # depths of open elements that are not inline

    @property
    def here(self) -> Node:
        return self.nodes[-1]

    def enter(self, node: Node) -> None:
        self.depths.setdefault(node.tag, []).append(len(self.nodes))
        if node.tag not in INLINE:
            self.blocks.append(len(self.nodes))
        self.nodes.append(node)

    def cut(self, depth: int) -> None:
        """Close the element at this depth and all in it."""
        while len(self.nodes) > depth:
            node = self.nodes.pop()
            self.depths[node.tag].pop()
            if node.tag not in INLINE:
                self.blocks.pop()

    def nearest(self, tags: Iterable[str]) -> int:
        """Depth of the deepest open element of these tags; 0 if there is none."""
        return max((d[-1] for t in tags if (d := self.depths.get(t))), default=0)

    def close(self, tag: str) -> None:
        if depth := self.nearest((tag,)):
            self.cut(depth)

    def end_paragraph(self) -> None:
        """A block ends a paragraph that is open with nothing but inline elements in it."""
        if self.blocks and self.nodes[self.blocks[-1]].tag == "p":
            self.cut(self.blocks[-1])

    def end_item(self, like: tuple[str, ...], within: tuple[str, ...]) -> None:
        """An item ends the one before it in the same list or table."""
        depth = self.nearest(like)
        if depth and depth >= self.nearest(within):
            self.cut(depth)


def after_raw(html: str, name: str, at: int) -> int:
    gone = re.compile(rf"</{re.escape(name)}\b[^>]*>", re.I).search(html, at)
    return gone.end() if gone else len(html)


def next_tag(html: str, at: int, last: int) -> re.Match[str] | None:
    """The next tag or comment; ``last`` is the end of the last ``>``, beyond which only an open comment can begin."""
    m = _TAG.search(html, at, last) if at < last else None
    if m is None or (m.end() == last and _OPEN.match(m.group()) and not _SHUT.match(m.group())):
        return _OPEN.search(html, m.start() if m else at)
    return m


def closed(html: str) -> set[int]:
    """Where the tags of ``HIDDEN`` elements stand that have an end tag of their own."""
    out: set[int] = set()
    opened: dict[str, list[int]] = {name: [] for name in HIDDEN}
    at, last = 0, html.rfind(">") + 1
    while m := next_tag(html, at, last):
        at = m.end()
        close, name = (m.group(1) or "").lower(), (m.group(2) or "").lower()
        if name in RAW and not empty(m.group(3)):
            at = after_raw(html, name, at)
        elif name in HIDDEN and not empty(m.group(3)):
            opened[name].append(m.start())
        elif close in HIDDEN and opened[close]:
            out.add(opened[close].pop())
    return out


def parse(html: str) -> Node:
    """The tree below a ``body``; what is not closed ends with its parent.

    ``HIDDEN`` elements are read like others but hang on no parent, so nothing in them is ever
    chosen; one without an end tag hides nothing.
    """
    root = Node("body", None)
    path, at, size, last = Path(root), 0, len(html), html.rfind(">") + 1
    hiding: set[int] | None = None
    while at < size:
        m = next_tag(html, at, last)
        end = m.start() if m else size
        here = path.here
        if end > at:
            chunk = html[at:end]
            if not chunk.isspace():
                Node("#text", here, text=chunk)
            elif here.children and here.children[-1].tag == "#text":
                here.children[-1].text += " "
            else:
                Node("#space", here, text=" ")
        if not m:
            break
        at = m.end()
        if m.group(1):
            path.close(m.group(1).lower())
            continue
        name = (m.group(2) or "").lower()
        if not name:
            continue
        if name in ("body", "html"):
            root.attributes += m.group(3)
        elif name in ("br", "wbr"):
            Node("#space", here, text=" " if name == "br" else "")
        elif name in RAW:
            if not empty(m.group(3)):
                at = after_raw(html, name, at)
        elif name in HIDDEN:
            hiding = closed(html) if hiding is None else hiding
            if m.start() in hiding:
                node = Node(name, None)
                node.parent = here
                path.enter(node)
        else:
            if name in ENDS_P:
                path.end_paragraph()
            if name in ITEMS:
                like, within = ITEMS[name]
                path.end_item(like, within)
            node = Node(name, path.here, m.group(3))
            if name not in VOID and not m.group(3).endswith("/"):
                path.enter(node)
    return root


def _words(attributes: str) -> tuple[int, int]:
    """How many attribute words speak against and for main text."""
    if not attributes:
        return 0, 0
    around = inside = 0
    for name, a, b, c in _ATTRIBUTE.findall(attributes):
        if name.lower() in ("class", "id", "role", "itemprop", "aria-label"):
            for w in _WORD.findall(re.sub(r"([a-z])([A-Z])", r"\1 \2", a or b or c).lower()):
                around += w in AROUND
                inside += w in INSIDE
    return around, inside


def flatten(root: Node) -> tuple[list[Node], list[int]]:
    """Nodes in page order (parents before children) and the index of each one's parent."""
    nodes, parents, stack = [], [], [(root, -1)]
    while stack:
        node, parent = stack.pop()
        index = len(nodes)
        nodes.append(node)
        parents.append(parent)
        stack.extend((c, index) for c in reversed(node.children))
    return nodes, parents


def node_features(nodes: list[Node], parents: list[int]) -> np.ndarray:
    n = len(nodes)
    text, link, elements, paragraphs = [0] * n, [0] * n, [1] * n, [0] * n
    depth, around, inside, aside, form = [0] * n, [0] * n, [0] * n, [0] * n, [0] * n
    own = [(0, 0)] * n
    place, siblings = [0] * n, [1] * n
    for i, node in enumerate(nodes):
        own[i] = _words(node.attributes)
        p = parents[i]
        if p >= 0:
            depth[i] = depth[p] + 1
            around[i], inside[i] = around[p] + own[p][0], inside[p] + own[p][1]
            aside[i] = aside[p] or nodes[p].tag in ("nav", "aside", "footer", "header")
            form[i] = form[p] or nodes[p].tag == "form"
        if node.tag == "#text":
            text[i] = len(node.text)
        paragraphs[i] = node.tag == "p"
    counter = [0] * n
    for i in range(1, n):
        p = parents[i]
        place[i] = counter[p]
        counter[p] += 1
    for i in range(n - 1, 0, -1):
        p = parents[i]
        if nodes[i].tag == "a":
            link[i] = text[i]
        siblings[i] = counter[p]
        text[p] += text[i]
        link[p] += link[i]
        elements[p] += elements[i]
        paragraphs[p] += paragraphs[i]
    total = max(text[0], 1)
    rows = []
    for i, node in enumerate(nodes):
        p = max(parents[i], 0)
        t = max(text[i], 1)
        rows.append([
            *[node.tag in group for _, group in TAGS], own[i][0], own[i][1], around[i], inside[i], aside[i], depth[i], math.log1p(text[i]),
            link[i] / t, text[i] / total, math.log1p(elements[i]), text[i] / elements[i], paragraphs[i], siblings[i],
            place[i] / siblings[i], text[i] / max(text[p], 1), i / n, form[i],
        ])
    return np.array(rows, dtype=np.float32)


def decode(parents: list[int], p: np.ndarray) -> np.ndarray:
    """The likeliest choice of nodes that is closed upwards."""
    p = np.clip(p, 1e-6, 1 - 1e-6)
    yes, no = np.log(p).tolist(), np.log(1 - p).tolist()
    for i in range(len(parents) - 1, 0, -1):
        up = parents[i]
        yes[up] += max(yes[i], no[i])
        no[up] += no[i]
    chosen = np.zeros(len(parents), dtype=bool)
    for i, up in enumerate(parents):
        chosen[i] = (up < 0 or chosen[up]) and yes[i] > no[i]
    return chosen


def blocks_of(nodes: list[Node], parents: list[int], chosen: np.ndarray) -> list[str]:
    """Chosen text in page order, a block ending wherever a block element begins or ends."""
    out: list[str] = []
    current: list[str] = []
    owner: list[int] = [0] * len(nodes)
    last = 0
    for i, node in enumerate(nodes):
        owner[i] = i if node.tag in BLOCK or i == 0 else owner[parents[i]]
        if owner[i] != last:
            out.append("".join(current))
            current, last = [], owner[i]
        if node.tag == "#text" and chosen[i]:
            current.append(node.text)
        elif node.tag == "#space":
            current.append(" ")
        elif node.tag in ("td", "th"):
            current.append(" ")
    out.append("".join(current))
    clean = (_WHITE.sub(" ", references.unescape(b)).strip() for b in out)
    return [b for b in clean if b]


MARK = "data-main-text"


def marked(html: str) -> str | None:
    """The page with its article marked, or null if it has no single one."""
    found = re.findall(r"(?i)<(?:article|main)\b|\brole=[\"']?main\b", html)
    if len(found) != 1:
        return None
    return re.sub(r"(?i)<(article|main)\b|<(\w+)(?=[^>]*\brole=[\"']?main\b)", lambda m: f"<{m[1] or m[2]} {MARK}=1 ", html, count=1)


def varied(html: str, other: str, chance: random.Random) -> str:
    """A marked page in another dress, with boilerplate around and inside its article."""
    sentences = [s for s in re.findall(r">([^<>]{20,400})<", other)] or ["Read more about this"]
    say = lambda: chance.choice(sentences)[: chance.choice([30, 80, 200, 400])]
    link = lambda: f'<a href="/{chance.randrange(99)}">{say()[:25]}</a>'
    word = chance.choice

    def extra() -> str:
        name = word(sorted(AROUND))
        attribute = word(["class", "id"])
        container = word(["div", "div", "section", "aside", "ul"])
        kind = chance.randrange(8)
        if kind == 0:
            return f"<{container} {attribute}='{name}'>" + "".join(f"<p>{say()}</p>" for _ in range(chance.randint(1, 4))) + f"</{container}>"
        if kind == 1:
            return f"<aside>{say()} {link()}<p>{say()}</p></aside>"
        if kind == 2:
            return f"<form><label>{say()[:20]}</label><input><p>{say()[:60]}</p><button>{say()[:10]}</button></form>"
        if kind == 3:
            return f"<div {attribute}='{word(['comments', 'comment-list', 'replies'])}'>" + "".join(
                f"<div class='comment'><b>{say()[:10]}</b><p>{say()}</p></div>" for _ in range(chance.randint(1, 5))) + "</div>"
        if kind == 4:
            return f"<{word(['header', 'footer', 'nav'])}>{say()} {link()} {link()}</{word(['header', 'footer', 'nav'])}>"
        if kind == 5:
            return "<ul>" + "".join(f"<li>{link()}</li>" for _ in range(chance.randint(2, 8))) + "</ul>"
        if kind == 6:
            return f"<div {attribute}='{name}-{word(['box', 'bar', 'area', 'wrap'])}'>{say()}</div>"
        return f"<section {attribute}='{name}'><h2>{say()[:30]}</h2>" + "".join(f"<p>{link()} {say()}</p>" for _ in range(3)) + "</section>"

    def insert() -> str:
        body = extra()
        return f"<div {MARK}=0>{body}</div>" if chance.random() < 0.3 else re.sub(r"^<(\w+)", rf"<\1 {MARK}=0", body, count=1)

    dress = word(["article", "main", "div class='content'", "div id='main-content'", "section class='post-body'", "div class='entry text'", "div"])
    html = re.sub(rf"<\w+ {MARK}=1 ([^>]*)>", lambda m: f"<{dress} {MARK}=1>", html, count=1)
    html = re.sub(r"(?i)</(?:article|main)>", f"</{dress.split()[0]}>", html, count=1)
    opening = re.search(rf"<[^>]*{MARK}=1[^>]*>", html)
    for place in sorted({opening.end() if chance.random() < 0.3 else opening.start(), opening.start()}, reverse=True):
        if chance.random() < 0.6:
            html = html[:place] + insert() + html[place:]
    closing = html.rfind(f"</{dress.split()[0]}>")
    if closing > 0:
        html = html[:closing] + (insert() if chance.random() < 0.5 else "") + html[closing:]
        after = closing + html[closing:].find(">") + 1
        after = html.find(f"</{dress.split()[0]}>", closing) + len(dress.split()[0]) + 3
        html = html[:after] + "".join(insert() for _ in range(chance.randrange(3))) + html[after:]
    return html


_NEVER = {"nav", "aside", "footer", "form"}


def truth(nodes: list[Node], parents: list[int]) -> np.ndarray:
    """Whether a node's subtree holds main text, by the marks."""
    state, out = [False] * len(nodes), [False] * len(nodes)
    for i, node in enumerate(nodes):
        state[i] = state[parents[i]] if parents[i] >= 0 else False
        if MARK in node.attributes:
            state[i] = f"{MARK}=1" in node.attributes
        elif node.tag in _NEVER or "class=\"ad\"" in node.attributes:
            state[i] = False
        out[i] = state[i] and node.tag == "#text"
    for i in range(len(nodes) - 1, 0, -1):
        out[parents[i]] = out[parents[i]] or out[i]
    return np.array(out)


def learn(pages: list[str]) -> boosting.Forest | None:
    """A forest from pages that mark their article; none if there are none."""
    chance = random.Random(7)
    usable = [m for m in map(marked, pages) if m]
    xs, ys = [], []
    for i, page in enumerate(usable):
        other = usable[(i * 7 + 3) % len(usable)]
        for html in (page, varied(page, other, chance)):
            nodes, parents = flatten(parse(html))
            y = truth(nodes, parents)
            for node in nodes:
                node.attributes = re.sub(rf"{MARK}=[01]", "", node.attributes)
            xs.append(node_features(nodes, parents))
            ys.append(y)
    if not xs:
        return None
    return boosting.fit(np.concatenate(xs), np.concatenate(ys).astype(np.float64), trees=40, depth=5, rate=0.25)


def extract(pages: list[str], forest: boosting.Forest | None) -> list[str]:
    trees = [flatten(parse(h)) for h in pages]
    if not trees:
        return []
    x = [node_features(*t) for t in trees]
    bounds = np.cumsum([0, *map(len, x)])
    p = forest.score(np.concatenate(x)) if forest is not None else np.ones(bounds[-1])
    return ["\n\n".join(blocks_of(*t, decode(t[1], p[a:b]))) for t, a, b in zip(trees, bounds[:-1], bounds[1:], strict=True)]


def fit_pages(pages: DataFrame, html: str = "html", most: int = PAGES) -> boosting.Forest | None:
    """A forest from a sample by hash of at most ``most`` pages of at most ``LARGEST`` characters."""
    usable = pages.where(F.char_length(html) <= LARGEST).where(F.lower(html).rlike(r"<article\b|<main\b|role=[\"']?main"))
    n = usable.count()
    place = F.pmod(F.xxhash64(html), F.lit(1_000_000))
    some = usable.where(place < min(1_000_000, max(1, 2_000_000 * most // max(n, 1)))).select(F.col(html).alias("h"), F.xxhash64(html).alias("k"))
    return learn([r["h"] for r in some.distinct().orderBy("k", "h").limit(most).collect()])


def main_text(pages: DataFrame, forest: boosting.Forest | None, html: str = "html") -> tuple[DataFrame, str]:
    """The pages with their main text, and the name of that column."""
    shared = pages.sparkSession.sparkContext.broadcast(forest)

    def run(column: pa.Array) -> list[pa.Array]:
        from assayspark.llm import pieces

        htmls, out = [h or "" for h in column.to_pylist()], []
        for a, b in pieces.runs(htmls, BLOCK_CHARS):
            out += extract(htmls[a:b], shared.value)
        return [pa.array(out, pa.string())]

    out, names = append_columns(pages, html, {"main_text": "string"}, run)
    return out, names[0]


@query("op6_html_text")
def op6_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    out, text = main_text(pages, fit_pages(pages))
    return out.select("page_id", "url", F.col(text).alias("text"), F.char_length(text).cast("long").alias("n_chars"))
