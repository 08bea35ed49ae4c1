"""Main text of web pages by tree scoring.

A page becomes a tree (end tags that HTML leaves out are implied). Elements that are certainly never the
article - menus, page headers and footers, sidebars, notices, adverts, forms, scripts, styles, reader
comments, hidden parts - are cut by their tag or by what a class, id or role of theirs says as a whole.
Each paragraph of what is left passes points for its length and its commas to its ancestors, the nearest
most; an element's points are discounted by the share of its text that is inside of links; being an
``article`` or ``main``, or being called one, is worth some points and no more. The best container is
kept, and where it is in an ``article`` or ``main`` element, all of that. Else its siblings that score close to it
or are paragraphs or headings themselves are kept, with all that stands between two that are, and so the
siblings of what holds it.
"""

from __future__ import annotations

import html as entities
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracelake.llm.common import tidy

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset("address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html li main nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
#: A start tag of the key ends an open element of the values, up to the nearest of SCOPE.
ENDS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "tbody": ("tr", "td", "th", "thead"), "option": ("option",)}
SCOPE = frozenset("table ul ol dl select body html article section div main aside".split())
RAW = "script|style|noscript|template|textarea|title|iframe|svg|math|select|object|head"
#: Tags that are never part of an article.
CUT_TAGS = frozenset("nav footer aside form button dialog menu input label fieldset".split())
#: Words of a class, id or role that say so wherever they stand in it, unless a word beside them says that they are about something else.
TELLING = frozenset("nav navbar navigation menubar breadcrumb breadcrumbs sidebar ad ads adv advert adverts advertisement advertising adsense sponsored cookie cookies consent gdpr newsletter sharing related recommended comment comments disqus contentinfo".split())
ABOUT = frozenset("has no with without open closed enabled disabled in is body blog post entry article section main".split())
#: Words that say so together with each other or with those of PLAIN, when a class, id or role has no other words.
CALLED = TELLING | frozenset("menu header masthead topbar footer foot rail promo promotion banner sponsor sponsors notice notices alert alerts popup modal overlay subscribe subscription signup share social recommendations reply replies respond form search login widget widgets pagination pager toolbar skip copyright legal disclaimer complementary dialog hidden".split())
PLAIN = frozenset("site page global top bottom left right bar box list container wrapper wrap block area inner outer slot unit links link buttons button icons media policy form panel group item items primary secondary".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
GOOD_WORDS = frozenset("article content body entry main post story text page blog".split())
_TOKEN = re.compile(
    rf"<!--.*?(?:-->|\Z)|<({RAW})\b(?:[^>\"']|\"[^\"]*\"|'[^']*')*+>.*?(?:</\1\s*>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>|<(/?)([a-zA-Z][^\s/>]*)()[^>]*>|<[!?/][^>]*>",
    re.S | re.I,
)
_MARK = re.compile(r"""\b(class|id|role|style|hidden|aria-hidden)\b(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.I)
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")


class Node:
    __slots__ = ("tag", "parent", "inside", "words", "named", "gone", "chars", "linked", "points")

    def __init__(self, tag: str, parent: Node | None, words: frozenset, named: bool, gone: bool):
        self.tag, self.parent, self.words, self.named, self.gone = tag, parent, words, named, gone
        self.inside: list[Node | str] = []
        self.chars = self.linked = 0
        self.points = 0.0


def names_cut(name: list[str], text: bool) -> bool:
    """Whether the words of one class, id or role say that an element is never the article; of a paragraph or heading (``text``) only a single word does."""
    if text:
        return len(name) == 1 and name[0] in TELLING
    words = frozenset(name)
    return bool(words & TELLING and not words & ABOUT or words & CALLED and words <= CALLED | PLAIN or words & {"comment", "comments"} and not words & ABOUT - {"blog", "post", "entry", "article", "section"})


def marks(tag: str, attributes: str) -> tuple[frozenset, bool, bool]:
    """Words of class, id and role, whether one of these says that it is never the article, and whether the element is hidden."""
    words: set[str] = set()
    named = hidden = False
    if attributes.strip():
        for name, *values in _MARK.findall(attributes):
            value, name = values[0] or values[1] or values[2], name.lower()
            if name in ("class", "id", "role"):
                for one in value.split():
                    own = [w.lower() for w in _WORD.findall(one)]
                    words.update(own)
                    named |= names_cut(own, tag in HEADINGS or tag == "p")
            elif name == "style":
                hidden |= "display:none" in value.replace(" ", "").lower()
            else:
                hidden |= value.lower() != "false"
    return frozenset(words), named, hidden


def parse(page: str) -> Node:
    top = here = Node("html", None, frozenset(), False, False)
    at, end = 0, page.rfind(">") + 1  # no tag ends beyond the last bracket
    for found in _TOKEN.finditer(page, 0, end):
        if found.start() > at:
            here.inside.append(page[at : found.start()])
        at = found.end()
        tag = (found[3] or found[6] or "").lower()
        if not tag:
            open_comment = found[0].startswith("<!--") and not found[0].endswith("-->")
            open_raw = found[1] and not re.search(rf"</{found[1]}\s*>\Z", found[0], re.I)
            at = len(page) if at == end and (open_comment or open_raw) else at
            continue
        if found[2] or found[5]:
            node = here
            while node is not None and node.tag != tag:
                node = node.parent
            if node is not None and node.parent is not None:
                here = node.parent
            continue
        if tag in ("html", "body"):
            continue
        if tag in BLOCK:
            node = here
            while node is not None and node.tag not in SCOPE and node.tag != "p":
                node = node.parent
            if node is not None and node.tag == "p":
                here = node.parent
        for other in (ENDS.get(tag),) if tag in ENDS else ():
            node = here
            last = None
            while node is not None and (node.tag not in SCOPE or node.tag in other):
                if node.tag in other:
                    last = node
                node = node.parent
            if last is not None:
                here = last.parent
        node = Node(tag, here, *marks(tag, found[4] or ""))
        here.inside.append(node)
        if tag not in VOID:
            here = node
    if at < len(page):
        here.inside.append(page[at:])
    return top


def cut(top: Node) -> None:
    """Mark what is certainly never the article. What holds an article stays, and so does what holds the first heading but a header of the page."""
    order = [top]
    for node in order:
        order.extend(x for x in node.inside if not isinstance(x, str))
    holds: set[int] = set()
    heads: set[int] = set()
    for node in reversed(order):
        if node.tag in ("article", "main") and not node.named or id(node) in holds:
            holds.add(id(node.parent))
        if node.tag == "h1" or id(node) in heads:
            heads.add(id(node.parent))
    within = {id(n) for n in order if n.tag in ("article", "main", "section")}
    for node in order:
        if node.parent is None or id(node) in holds:
            continue
        if id(node.parent) in within:
            within.add(id(node))
        titled = id(node) in heads
        if node.tag in CUT_TAGS or node.tag == "header" and id(node) not in within or node.named and not (titled and node.tag != "header" and not node.words & TELLING):
            node.gone = True


def measure(node: Node, linked: bool = False) -> list[Node]:
    """Text and link lengths of every element that is left; the elements, children first. No recursion: pages can be deep."""
    order, stack = [], [(node, linked)]
    while stack:
        node, linked = stack.pop()
        order.append(node)
        for x in node.inside:
            if isinstance(x, str):
                size = len(x.strip())
                node.chars += size
                node.linked += size * linked
            elif not x.gone:
                stack.append((x, linked or x.tag == "a"))
    order.reverse()
    for node in order:
        if node.parent is not None:
            node.parent.chars += node.chars
            node.parent.linked += node.linked
    return order


def own_text(node: Node) -> str:
    """Text of a paragraph: its own and that of elements inside of it that aren't blocks."""
    parts, stack = [], list(reversed(node.inside))
    while stack:
        x = stack.pop()
        if isinstance(x, str):
            parts.append(x)
        elif not x.gone and x.tag not in BLOCK:
            stack.extend(reversed(x.inside))
    return "".join(parts)


def main_parts(top: Node) -> list[Node | str]:
    cut(top)
    order = measure(top)
    scored = []
    for node in order:
        if node.tag in ("p", "pre", "td", "blockquote", "li", "dd", "div", "section", "article", "main") and node.chars:
            text = own_text(node).strip()
            if len(text) < 25:
                continue
            points = 1 + text.count(",") + min(len(text) / 100, 3)
            to = node if node.tag in ("div", "section", "article", "main") else node.parent
            for level in range(4):
                if to is None:
                    break
                if not to.points:
                    to.points = 25 * bool(to.tag in ("article", "main")) + 10 * bool(to.words & GOOD_WORDS)
                    scored.append(to)
                to.points += points / (1, 2, 6, 9)[level]
                to = to.parent
    rate = lambda n: n.points * (1 - n.linked / n.chars) if n.chars else 0.0
    # of equal scores the element that ends first
    best = max(scored, key=rate, default=None)
    if best is None:
        # no paragraph of any length: the element that says it is the article, or all that is left
        return [next((n for n in reversed(order) if n.tag in ("article", "main")), top)]
    least = max(10.0, rate(best) / 5)
    kept: list[Node | str] = [best]
    node: Node | None = best
    while node is not None and node.tag not in ("article", "main"):
        node = node.parent
    if node is not None:
        # an article is kept whole, whatever part of it scores best
        kept = [node]
    node = node or best
    for _ in range(3):
        if node.parent is None:
            break
        whole, within = node.tag in ("article", "main"), node.parent.tag in ("article", "main")
        beside = [x for x in node.parent.inside if isinstance(x, str) or not x.gone and x.chars]
        # beside an article only what scores; within a main element whatever isn't links; what stands between two that stay, stays
        stays = [x is node or not isinstance(x, str) and x.linked / x.chars < 0.25 and (within or bool(x.points) and rate(x) >= least or not whole and (x.tag in HEADINGS or x.tag in ("p", "pre", "blockquote", "ul", "ol", "dl", "table", "figure"))) for x in beside]
        first, last = stays.index(True), len(stays) - 1 - stays[::-1].index(True)
        kept = [y for x in beside[first : last + 1] for y in (kept if x is node else [x])]
        node = node.parent
        if whole or within:
            break
    return kept


def blocks(parts: list[Node | str]) -> list[str]:
    out: list[str] = []
    run: list[str] = []

    def flush() -> None:
        text = " ".join(entities.unescape("".join(run)).split())
        if text:
            out.append(text)
        run.clear()

    stack: list[Node | str | None] = list(reversed(parts))
    while stack:
        x = stack.pop()
        if x is None:
            flush()
        elif isinstance(x, str):
            run.append(x)
        elif x.tag == "br":
            run.append(" ")
        elif not x.gone:
            if x.tag in BLOCK:
                flush()
                stack.append(None)
            stack.extend(reversed(x.inside))
    flush()
    return out


def main_text(page: str) -> str:
    return "\n".join(blocks(main_parts(parse(page)))) if page else ""


def extract_text(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) per row of pages (page_id, url, html).

    Null or empty html gives the empty text; a very long page is one tree, in memory of its size. Of equal scores the
    element that ends first in the page is taken. Rows are independent: repeated rows give repeated results,
    no rows none; nulls in page_id and url pass; other columns are left aside. Broken markup never fails.
    """

    def run(batches):
        for batch in batches:
            texts = [main_text(x.as_py()) for x in batch.column(2)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html")).mapInArrow(tidy(run), "page_id bigint, url string, text string, n_chars bigint")
