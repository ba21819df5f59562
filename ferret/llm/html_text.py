"""Main text of web pages by tree scoring.

Each page becomes a small tree of elements. Paragraphs of some length pass points (one, one per comma, one per
hundred characters up to three) to their parent, half to the grandparent, a third and so on above; a container's
points are discounted by its link density. The best container, lifted to the article, main or named content element
around it, and those of its siblings that score well or are headings, paragraphs, lists or tables of text are kept. Menus, headers, footers, side
bars, notices, adverts, forms, reader comments, scripts and styles are left out by element, role, class or id wherever
they stand. A name of several words (``share-enabled``) only counts where no content is named beside it and the element
does not hold the article or most of the text; html, body and main always stay.

Edge cases: null or empty html gives an empty text; malformed markup never raises; a page without any paragraph
falls back to its article, its main element or its body; rows with equal page_id each give a row; extra columns are
ignored.
"""

from __future__ import annotations

import re
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ferret.llm.common import slices

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
DROP = frozenset("script style noscript template svg nav footer aside form button select textarea iframe object canvas audio video map dialog menu head title".split())
BLOCK = frozenset(
    "address article blockquote body center dd details div dl dt fieldset figcaption figure h1 h2 h3 h4 h5 h6 header hgroup hr html li main ol p pre "
    "section summary table tbody td tfoot th thead tr ul caption legend".split())
HEADING = frozenset("h1 h2 h3 h4 h5 h6".split())
CLOSES_P = BLOCK - {"html", "body", "caption", "legend", "tbody", "thead", "tfoot", "tr", "td", "th", "summary", "figcaption"}
FLOW = frozenset("p pre blockquote ul ol dl table figure".split())
PARAGRAPH = frozenset("p pre blockquote td li dd".split())
BASE = {"article": 30, "main": 25, "section": 3, "div": 5, "td": 3, "blockquote": 3, "body": 0, "ul": -3, "ol": -3, "dl": -3}
#: class, id and role words that mark what is not the article: as whole names always, as part of a name unless ``settle`` keeps the element
NEVER = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner comment comments commentlist disqus replies respond "
    "sidebar side aside nav navbar navigation menu menubar breadcrumb breadcrumbs footer cookie cookies consent gdpr notice alert popup modal overlay "
    "newsletter subscribe signup login search share sharing social widget toolbar skip contentinfo complementary".split())
#: the same, unless a word of CONTENT stands with them
PERHAPS = frozenset("header masthead related recommended recommendations pagination pager toc tags meta byline tools topbar".split())
CONTENT = frozenset("article content main post entry body story text".split())
#: words of NEVER and PERHAPS that may also be what a part of an article is about: inside one such a part stays if it holds prose
TOPICS = frozenset("search tools meta tags social navigation menu byline".split())
PROSE = 200  # characters outside links in paragraphs
COMMENTS = frozenset("comment comments commentlist disqus replies respond".split())
#: words that make a name a state of the page (comments-open), not a part of it
STATE = frozenset("has no not with without is show shows showing hide hides hiding open closed enabled disabled free on off".split())
#: words beside which a word of NEVER still names a part of the page
LAYOUT = NEVER | PERHAPS | CONTENT | frozenset(
    "site page top left right bottom primary secondary global section area container wrapper wrap box bar block list item items form field button buttons link links icon icons inner outer".split())
HEAD = frozenset("base basefont bgsound head link meta noscript script style template title".split())
_WORD = re.compile(r"[a-z]+")
_HIDDEN = re.compile(r"display\s*:\s*none", re.I)
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")


class Node:
    __slots__ = ("tag", "parent", "kids", "drop", "score", "scored", "chars", "linked", "commas", "content", "doubt", "inside", "topic")

    def __init__(self, tag, parent, drop):
        self.tag, self.parent, self.drop = tag, parent, drop
        self.kids: list = []  # nodes and strings, in page order
        self.score, self.scored, self.chars, self.linked, self.commas, self.content = 0.0, False, 0, 0, 0, False
        self.doubt = 0
        self.inside = parent is not None and (parent.inside or parent.tag in ("article", "main"))
        self.topic = False


def _topical(attrs) -> bool:
    """Whether all the words that speak against an element are of TOPICS."""
    bad = {w for k, v in attrs if k in ("class", "id", "role") and v for name in v.split() for w in _WORD.findall(_CAMEL.sub(" ", name).lower())} & (NEVER | PERHAPS)
    return bool(bad) and bad <= TOPICS


def _marks(tag: str, attrs, inside_article: bool) -> tuple[bool, bool, int]:
    """Whether an element is left out, whether its class, id or role names it as content, and its doubt: 1 for a name of
    several words one of which is of NEVER, 2 if all the others are of LAYOUT, or it is about comments, or a whole name of
    NEVER stands beside one of CONTENT."""
    if tag in DROP or tag == "header" and not inside_article:
        return True, False, 0
    never = NEVER if tag != "article" else frozenset(("comment", "comments", "ad", "advert", "sponsored"))
    words: set[str] = set()
    whole, related, clean, doubt = False, False, False, 0
    for k, v in attrs:
        if (k == "hidden" or k == "style" and v and _HIDDEN.search(v)) and tag not in ("html", "body", "main"):
            return True, False, 0
        if k in ("class", "id", "role") and v:
            for name in v.split():
                parts = set(_WORD.findall(_CAMEL.sub(" ", name).lower()))
                words |= parts
                bad = parts & never
                related |= bool(parts & PERHAPS) and (k != "id" or tag not in HEADING and parts <= LAYOUT)
                clean |= not bad and bool(parts & CONTENT)
                if not bad or tag in HEADING and k == "id":  # ids of headings are made from their text
                    continue
                plain = parts <= LAYOUT
                if len(parts) == 1:
                    whole = True
                elif not parts & STATE and (plain or k != "id"):  # other ids are made from headings, too
                    doubt = max(doubt, 2 if plain or bad & COMMENTS else 1)
    content = bool(words & CONTENT)
    if tag in ("html", "body", "main"):
        return False, content, 0
    if clean:  # a name of its own says content: no doubt, or only one instead of an end
        whole, doubt = False, 2 if whole or doubt == 2 else 0
    return whole or related and not content and tag != "article", content, doubt


def settle(root: Node) -> None:
    """Leave out the elements in doubt, but those that hold the article or more than half of the text outside links."""
    order, stack = [], [(root, False)]  # no recursion, as below
    while stack:
        n, a = stack.pop()
        a = a or n.tag == "a"
        order.append((n, 0 if a else sum(len(k.strip()) for k in n.kids if not isinstance(k, Node))))
        stack.extend((k, a) for k in n.kids if isinstance(k, Node) and not k.drop)
    total, size, holds, prose = sum(c for _, c in order), {}, {}, {}
    for n, own in reversed(order):
        kids = [k for k in n.kids if isinstance(k, Node) and not k.drop]
        size[n] = own + sum(size[k] for k in kids)
        prose[n] = size[n] if n.tag == "p" else sum(prose[k] for k in kids)
        if n.topic and prose[n] < PROSE:
            n.drop = True
        holds[n] = max([2 if k.tag in ("h1", "main") else 1 if k.tag == "article" else 0 for k in kids] + [holds[k] for k in kids], default=0)
        if n.doubt and holds[n] < n.doubt and not (n.doubt == 1 and 2 * size[n] > total):
            n.drop = True


class Tree(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = self.at = Node("html", None, False)
        self.doubt = False

    def parse_marked_section(self, i, report=1):
        return self.parse_bogus_comment(i, report)

    def handle_starttag(self, tag, attrs):
        if tag not in HEAD:
            self._leave_head(tag == "body")
        at = self.at
        if tag in VOID:
            at.kids.append(" " if tag in ("br", "wbr") else Node(tag, at, True) if tag == "hr" else "")
            return
        if tag in ("html", "body") and at.parent is None and not (tag == "body" and attrs):
            return
        if tag in CLOSES_P:
            self._close({"p"}, BLOCK - {"p"})
        if tag in HEADING:
            self._close(HEADING, BLOCK - HEADING)
        elif tag == "li":
            self._close({"li"}, frozenset(("ul", "ol", "menu")))
        elif tag in ("dt", "dd"):
            self._close({"dt", "dd"}, frozenset(("dl",)))
        elif tag in ("td", "th"):
            self._close({"td", "th"}, frozenset(("tr", "table")))
        elif tag == "tr":
            self._close({"tr"}, frozenset(("table",)))
        at = self.at
        inside = at.inside or at.tag in ("article", "main")
        out, content, doubt = _marks(tag, attrs, inside)
        topic = out and inside and not at.drop and tag not in DROP and tag != "header" and not any(k in ("hidden", "style") for k, _ in attrs) and _topical(attrs)
        if topic:
            out, self.doubt = False, True
        self.at = Node(tag, at, at.drop or out)
        self.at.topic = topic and tag not in PARAGRAPH and tag not in HEADING  # a paragraph is prose itself
        self.at.content, self.at.doubt = content, doubt
        self.doubt |= doubt > 0
        at.kids.append(self.at)

    def _leave_head(self, body: bool):
        """The end tag of head may be omitted: body, or else the first thing that cannot stand in it, closes it."""
        x = self.at
        while x.parent is not None and x.tag != "head" and (body or x.tag == "title"):
            x = x.parent
        if x.tag == "head":
            self.at = x.parent

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID and tag not in BLOCK and self.at.tag == tag:
            self.at = self.at.parent

    def _close(self, tags, barrier):
        """Close the innermost open element of ``tags``, unless a ``barrier`` element stands between. Without a barrier
        everything open inside it is closed with it."""
        x = self.at
        while x.parent is not None:
            if x.tag in tags:
                self.at = x.parent
                return
            if barrier and (x.tag in barrier or x.tag in DROP):
                return
            x = x.parent

    def handle_endtag(self, tag):
        if tag in ("html", "body") or tag in VOID:
            return
        # an inline end tag does not reach through a block; a block's end tag closes what is open inside it
        self._close({tag}, frozenset() if tag in BLOCK or tag in DROP else BLOCK)

    def handle_data(self, data):
        if self.at.tag == "head" and data.strip():
            self._leave_head(False)
        if not self.at.drop:
            self.at.kids.append(data)


def _measure(node: Node) -> None:
    """Characters, linked characters and commas of every element, then the points of the paragraphs. No recursion: pages
    may nest deeply."""
    order, stack = [], [(node, False)]
    while stack:
        n, a = stack.pop()
        a = a or n.tag == "a"
        order.append((n, a))
        for k in n.kids:
            if isinstance(k, Node):
                if not k.drop:
                    stack.append((k, a))
            else:
                n.chars += len(k.strip())
                n.commas += k.count(",") + k.count("\uff0c")
        n.linked = n.chars if a else 0
    for n, _ in reversed(order):
        if n.parent is not None and n is not node:
            n.parent.chars += n.chars
            n.parent.linked += n.linked
            n.parent.commas += n.commas
    for n, _ in order:
        own = [k for k in n.kids if not isinstance(k, Node)]
        para = n.tag in PARAGRAPH or n.tag in ("div", "section", "article", "main") and any(len(k.strip()) > 25 for k in own)
        if not para or n.chars < 25:
            continue
        points, up, level = 1 + n.commas + min(n.chars // 100, 3), n if n.tag not in PARAGRAPH else n.parent, 1
        while up is not None and level <= 5:
            if up.tag in BLOCK:
                if not up.scored:
                    up.scored, up.score = True, up.score + BASE.get(up.tag, 0)
                up.score += points / level
                level += 1
            up = up.parent


def blocks(nodes: list[Node]) -> list[str]:
    out, line = [], []

    def flush():
        text = " ".join("".join(line).split())
        line.clear()
        if text:
            out.append(text)

    for node in nodes:
        stack: list = [node]
        while stack:
            x = stack.pop()
            if x is None:
                flush()
            elif isinstance(x, Node):
                if x.tag == "hr":
                    flush()
                if x.drop:
                    continue
                if x.tag in BLOCK:
                    flush()
                    stack.append(None)
                kids = x.kids
                if x.tag == "header":  # inside an article: its title stays
                    kids = [k for k in _descend(x) if k.tag in HEADING]
                stack.extend(reversed(kids))
            else:
                line.append(x)
        flush()
    return out


def _descend(node: Node) -> list[Node]:
    out, stack = [], [node]
    while stack:
        x = stack.pop()
        if x is not node:
            out.append(x)
        stack.extend(k for k in reversed(x.kids) if isinstance(k, Node) and not k.drop)
    return out


def _inside(node: Node, tags) -> bool:
    while node is not None and node.tag not in tags:
        node = node.parent
    return node is not None


def main_text(html: str | None) -> str:
    """Blocks of the article in page order, white space in them made one space, joined by two newlines."""
    if not html:
        return ""
    tree = Tree()
    tree.feed(html)
    tree.close()
    root = tree.root
    if tree.doubt:
        settle(root)
    _measure(root)
    nodes = [root, *_descend(root)]
    lists = [n for n in nodes if n.tag in ("ul", "ol") and n.chars and n.linked >= 0.9 * n.chars and not _inside(n, ("article", "main"))]
    for n in lists:  # a list of nothing but links is a menu, unless it stands in an article
        n.drop = True
    worth = lambda n: n.score * (1 - n.linked / n.chars) if n.chars else 0.0
    scored = [n for n in nodes if n.scored]
    best = max(scored, key=worth, default=None)
    if best is None:
        best = next((n for t in ("article", "main") for n in nodes if n.tag == t), root)
    up, named = best, best
    while up is not None:  # the whole article around the best container: article, else main, else what is named content
        if up.tag in ("article", "main"):
            named = up
            if up.tag == "article":
                break
        elif up.content and up.tag in BLOCK and up.tag not in ("html", "body") and named.tag != "main":
            named = up
        up = up.parent
    best = named
    if best.content and best.tag not in ("html", "body"):  # what is named content is an article, too
        for n in lists:
            up = n.parent
            while up is not None and up is not best:
                up = up.parent
            n.drop = up is not best
    if best.parent is None:
        return "\n\n".join(blocks([best]))
    least = max(10.0, 0.2 * worth(best))
    keep = []
    for k in best.parent.kids:
        if k is best:
            keep.append(k)
        elif isinstance(k, Node) and not k.drop:
            density = k.linked / k.chars if k.chars else 1.0
            if k.tag == "article" and k.scored and worth(k) >= least or best.tag not in ("article", "main") and (
                    k.tag in HEADING or k.tag in FLOW and density < 0.5 or k.scored and worth(k) >= least):
                keep.append(k)
    return "\n\n".join(blocks(keep))


def extract_html(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars of every page; whole documents, nothing capped."""
    def run(batches):
        for b in batches:
            for s in slices(b, "html"):
                text = [main_text(x) for x in s.column("html").to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [s.column("page_id"), s.column("url"), pa.array(text, pa.string()), pa.array([len(x) for x in text], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html").mapInArrow(run, "page_id long, url string, text string, n_chars long")


def op10_html_extraction(spark, sf_dir: str) -> DataFrame:
    return extract_html(spark.read.parquet(f"{sf_dir}/pages.parquet"))
