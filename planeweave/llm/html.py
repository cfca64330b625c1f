"""Main text of web pages by tree scoring.

Paragraphs pass points to their ancestors, for their length and commas, less by each level; a container's points are
discounted by the share of its text that stands in links, and element names and the words of class, id and role raise or
lower them. The container with most points is kept, and at each level above it those siblings that score well beside it, or are
headings or paragraphs of their own next to it. Scripts, forms, menus, page headers and footers, adverts, notices and comments are cut
from the tree first, by element, or by words of their attributes where they hold less text than they would take from the story.

Pages are read by a scanner that passes over each character a bounded number of times, so a page of any make takes a time linear in
its length.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable, Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from planeweave.llm.common import bounded

ATTRIBUTE = re.compile(r"""\b(class|id|role|hidden|style)\b(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""", re.IGNORECASE)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Their content is text up to their end tag, and none of it is shown as the page's text.
RAW = frozenset("script style title textarea xmp noembed noframes iframe".split())
CUT = frozenset("head nav footer aside form noscript template svg math canvas object audio video button select option datalist menu dialog map script style title textarea iframe".split())
BLOCK = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
PARAGRAPHS = frozenset("p pre blockquote li dd td".split())
#: Start tags that end an open element, and the elements that keep them from looking further out.
ENDS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",), "tbody": ("tr", "td", "th", "thead", "tbody"), "tfoot": ("tr", "td", "th", "thead", "tbody")}
SCOPE = {"li": ("ul", "ol", "menu", "dir"), "dt": ("dl",), "dd": ("dl",), "option": ("select", "datalist"), "tr": ("table",), "td": ("table",), "th": ("table",), "tbody": ("table",), "tfoot": ("table",)}
NOISE = frozenset(
    "ad ads advert adverts advertisement advertising adbox banner sponsor sponsored promo promotion cookie cookies consent gdpr notice notices notification alert popup modal overlay newsletter subscribe subscription signup nav navbar navigation navigational menu menus topmenu breadcrumb breadcrumbs sidebar sidebars rail aside footer foot footnav masthead topbar toolbar share sharing social related recommended recommendations comment comments commentlist disqus reply replies respond pagination pager paging login search searchbox widget skip complementary contentinfo outbrain taboola copyright disclaimer".split()
)
HEADS = frozenset("header head banner masthead siteheader pageheader".split())
CONTENT = frozenset("article content main post entry story body text page".split())
#: Words that make noise even of what is called content, and elements that are part of the story they stand in.
SURE = frozenset("ad ads advert sidebar footer nav menu cookie newsletter related share".split())
TEXTUAL = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre li dd td th span b i em strong figure figcaption".split())
NEVER = frozenset("comment comments commentlist disqus reply replies respond".split())
HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.IGNORECASE)
#: Characters of a short paragraph.
PARAGRAPH = 80
WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|[0-9]+")


LETTER = re.compile(r"[A-Za-z]")
NAME = re.compile(r"[^\s/>]++")
#: A tag's attributes up to its end; quotes count where they follow an equals sign.
INSIDE = re.compile(r"""(?:[^>="']++|=\s*+(?:"[^"]*+"|'[^']*+')?+|["'])*+>""")
LONG_NUMBER = re.compile(r"&#([xX]?)0*+([0-9a-fA-F]{8,})")
ZEROS = re.compile(r"&#([xX]?)0++(?=[0-9a-fA-F])")


def decode(text: str) -> str:
    """Character references decoded; numbers beyond all characters, which the library may refuse, as the replacement character."""
    if "&" not in text:
        return text
    return unescape(LONG_NUMBER.sub("\ufffd", ZEROS.sub(r"&#\1", text)))


def tags(page: str) -> Iterator[tuple[int, int, bool, str, str]]:
    """(start, end, whether it closes, name in lower case, attributes) of each tag; comments and the like have an empty name.

    A tag whose end does not come outside of quotes ends at the first ``>``, and so do all after it: one search to the end of the
    page is the most that fails. What does not end at all reaches to the end of the page.
    """
    at, quotes, size = 0, True, len(page)
    while (start := page.find("<", at)) >= 0:
        after = page[start + 1 : start + 2]
        if page.startswith("<!--", start):
            end = page.find("-->", start + 4)
            at = end + 3 if end >= 0 else size
            yield start, at, False, "", ""
            continue
        closes = after == "/"
        if not LETTER.match(page, start + 1 + closes):
            if after in ("!", "?") or closes:
                end = page.find(">", start)
                at = end + 1 if end >= 0 else size
                yield start, at, False, "", ""
            else:
                at = start + 1
            continue
        name = NAME.match(page, start + 1 + closes)
        inside = INSIDE.match(page, name.end()) if quotes else None
        if inside is None:
            quotes = False
            end = page.find(">", name.end())
            at = end + 1 if end >= 0 else size
        else:
            at = inside.end()
        yield start, at, closes, name[0].lower(), page[name.end() : at - 1]


class Node:
    """An element; ``parts`` holds its texts and elements in page order."""

    __slots__ = ("tag", "parent", "parts", "points", "weight", "noisy", "size", "linked", "whole")

    def __init__(self, tag: str, parent: Node | None, weight: float = 0.0, noisy: int = 0):
        self.tag, self.parent, self.parts, self.points = tag, parent, [], 0.0
        self.weight, self.noisy, self.size, self.linked, self.whole = weight, noisy, 0, 0, False


def _words(attributes: str) -> set[str] | None:
    """The words of class, id and role; None if the element is hidden."""
    words: set[str] = set()
    for name, value in ATTRIBUTE.findall(attributes):
        name, value = name.lower(), value.strip("\"'")
        if name == "hidden" or name == "style":
            if name == "hidden" or HIDDEN.search(value):
                return None
            continue
        for token in value.split():
            words |= {w.lower() for w in WORDS.findall(token)}
            words.add(re.sub(r"[^a-z]", "", token.lower()))
    return words


class Tree:
    """Open elements while a page is read. ``places`` holds for each name where on the stack such elements are open."""

    def __init__(self):
        self.root = Node("", None)
        self.stack, self.places = [self.root], {}

    def last(self, *names: str) -> int:
        """The place of the innermost open element of these names; 0 if there is none."""
        return max((self.places[n][-1] for n in names if self.places.get(n)), default=0)

    def open(self, node: Node) -> None:
        self.places.setdefault(node.tag, []).append(len(self.stack))
        self.stack.append(node)

    def close(self, place: int) -> None:
        while len(self.stack) > place:
            self.places[self.stack.pop().tag].pop()

    def close_within(self, name: str, scope: tuple[str, ...]) -> None:
        if (at := self.last(name)) and at > self.last(*scope):
            self.close(at)


P_SCOPE = ("article", "aside", "blockquote", "body", "button", "div", "main", "section", "td", "th", "table", "li", "ul", "ol")


def parse(page: str) -> Node:
    """The tree of ``page`` without elements that hold no text of the story by their names or attributes."""
    tree = Tree()
    lost: list[str] = []  # open elements inside one that is cut
    open_lost: Counter = Counter()
    at = 0

    def lose(tag: str) -> None:
        lost.append(tag)
        open_lost[tag] += 1

    for start, end, closes, tag, attributes in tags(page):
        if start < at:
            continue
        if not lost and start > at:
            tree.stack[-1].parts.append(decode(page[at:start]))
        at = end
        if not tag:
            continue
        if closes:
            if lost:
                if open_lost[tag]:
                    while True:
                        open_lost[gone := lost.pop()] -= 1
                        if gone == tag:
                            break
                elif tag in ("body", "html") or tag in ("article", "main") and tree.last(tag):
                    lost, open_lost = [], Counter()
                else:
                    continue
                if lost or tag not in ("body", "html", "article", "main"):
                    continue
            if place := tree.last(tag):
                tree.close(place)
            continue
        if tag in RAW:
            found = re.compile(rf"</{re.escape(tag)}[\s/>]", re.IGNORECASE).search(page, at)
            close = page.find(">", found.start()) if found else -1
            at = close + 1 if close >= 0 else len(page)
            continue
        closed = attributes.endswith("/") and tag not in BLOCK
        if lost:
            if tag not in VOID and not closed and not (tag == lost[-1] and tag in ("p", "li", "option", "dt", "dd")):
                lose(tag)
            continue
        if tag in BLOCK and tag != "html":
            tree.close_within("p", P_SCOPE)
        for old in ENDS.get(tag, ()):
            tree.close_within(old, SCOPE[tag])
        here = tree.stack[-1]
        if tag in VOID:
            here.parts.append(Node(tag, here))
            continue
        inside = tree.last("article", "main") > 0
        words = _words(attributes) if len(attributes) > 3 and tag not in ("html", "body") else set()
        bad = words & NOISE if words else set()
        if words is None or tag in CUT or words & NEVER or tag == "header" and not inside or words & HEADS and not inside:
            if not closed:
                lose(tag)
            continue
        good = tag in ("article", "main") or bool(words & CONTENT)
        # inside a story a paragraph's class tells how it looks, not that it is no part
        noisy = 2 if words & SURE else 1 if bad and not good else 0
        noisy = 0 if inside and tag in TEXTUAL else noisy
        node = Node(tag, here, (25.0 if good else 0.0) - (25.0 if bad else 0.0), noisy)
        here.parts.append(node)
        if not closed:
            tree.open(node)
    if not lost and at < len(page):
        tree.stack[-1].parts.append(decode(page[at:]))
    return tree.root


def walk(top: Node) -> Iterator[tuple[Node, bool]]:
    """Elements under ``top`` and itself: with False as they begin, with True as they end."""
    stack: list[tuple[Node, bool]] = [(top, False)]
    while stack:
        node, ended = stack.pop()
        yield node, ended
        if not ended:
            stack.append((node, True))
            stack += [(x, False) for x in reversed(node.parts) if isinstance(x, Node)]


def measure(root: Node) -> list[Node]:
    """All elements, inner ones first, with the sizes of their texts and of their links."""
    seen: list[Node] = []
    for node, ended in walk(root):
        if ended:
            own = sum(len(x.strip()) for x in node.parts if isinstance(x, str))
            under = [x for x in node.parts if isinstance(x, Node)]
            node.size = own + sum(x.size for x in under)
            node.linked = node.size if node.tag == "a" else sum(x.linked for x in under)
            seen.append(node)
    return seen


def cut_noise(root: Node) -> list[Node]:
    """Cut what the words of its attributes tell to be noise, but for sure words nothing that holds most of the page's text; measure what is left."""
    whole = measure(root)[-1].size
    todo = [root]
    while todo:
        node = todo.pop()
        node.parts = [x for x in node.parts if isinstance(x, str) or not x.noisy or x.noisy == 1 and x.size > 0.5 * whole]
        todo += [x for x in node.parts if isinstance(x, Node)]
    return measure(root)


def density(node: Node) -> float:
    """The share of a text that stands in no link."""
    return 1 - node.linked / max(1, node.size)


def score(seen: list[Node]) -> Node | None:
    """The container with the most points, those of all in ``points``."""
    raised: set[int] = set()
    for node in seen:
        own = [x for x in node.parts if isinstance(x, str)]
        size = sum(len(x.strip()) for x in own)
        bare = node.tag in ("div", "section", "article", "main", "body", "") and size > 0
        if node.tag in PARAGRAPHS or bare:
            size = size if bare else node.size
            commas = sum(x.count(",") for x in own)
            points = (1 + commas + min(size / 100, 3)) * density(node) if size else 0.0
            up, level = (node if bare else node.parent), 0
            while up is not None and up.tag and level < 6:
                if id(up) not in raised:
                    raised.add(id(up))
                    up.points += up.weight if points else 0.0
                up.points += points / (1 if level == 0 else 2 if level == 1 else 3 * level)
                up, level = up.parent, level + 1
    best, most = None, 0.0
    for node in seen:
        node.points *= density(node)
        if node.tag not in ("", "html") and node.tag not in PARAGRAPHS and node.points > most:
            best, most = node, node.points
    if best is None:  # paragraphs alone
        best = max((x for x in seen if x.tag and x.size), key=lambda x: x.points + x.size / 100, default=None)
    return best


def blocks(top: Node, kept: set[int] | None = None, own: set[int] = frozenset()) -> list[str]:
    """The texts of the blocks under ``top``, in page order; with ``kept``, of those nodes alone and what stands directly in ``own``."""
    found: list[str] = []
    line: list[str] = []

    def end() -> None:
        if words := "".join(line).split():
            found.append(" ".join(words))
        line.clear()

    stack: list[tuple[Node | str | None, bool]] = [(top, kept is None)]
    while stack:
        x, told = stack.pop()
        if x is None:
            end()
        elif isinstance(x, str):
            if told:
                line.append(x)
        elif x.tag == "br":
            line.append(" ")
        else:
            if x.tag in BLOCK:
                end()
                stack.append((None, False))
            whole = kept is None or x.whole or id(x) in kept
            text = whole or id(x) in own
            for y in reversed(x.parts):
                if isinstance(y, Node):
                    y.whole = whole
                stack.append((y, text))
    end()
    return found


def _holds(node: Node, tag: str) -> bool:
    return any(x.tag == tag for x, ended in walk(node) if ended)


def keep_with(best: Node) -> tuple[set[int], set[int]]:
    """``best`` and what is kept beside it and above it: ids of nodes that are kept whole, and of those whose own text is.

    At each level siblings are kept that reach a fifth of what the best container has there. Up to the outermost article or
    main element around it, and at its own level, headings and paragraphs next to it are kept too, and what
    stands before it and holds the first headline. Text that stands in an element around it without one of its own is kept there, or
    if it is as long as a short paragraph.
    """
    kept, own = {id(best)}, set()
    top, up, in_article = best, best.parent, best.tag == "article"
    while up is not None:
        if up.tag in ("article", "main"):
            top, in_article = up, in_article or up.tag == "article"
        up = up.parent
    node, inside, share = best, top is not best, 1.0
    while node.parent is not None and node.tag != "body":
        near, before = inside or node is best, True
        least = max(1.0, 0.2 * best.points * share)
        for x in node.parent.parts:
            if x is node:
                before = False
            elif isinstance(x, Node) and not x.noisy:
                told = near and (x.tag in HEADINGS or x.tag in ("p", "blockquote", "pre", "hgroup", "figure") and density(x) > 0.5)
                told = told or inside and (before and x.size and _holds(x, "h1"))
                # beside a page's articles only what holds articles too is more of the story
                alike = x.points >= least and density(x) > 0.5 and (near or not in_article or _holds(x, "article"))
                if told or alike:
                    kept.add(id(x))
            elif isinstance(x, str) and (near and x.strip() or len(x.strip()) >= PARAGRAPH):
                own.add(id(node.parent))
        node = node.parent
        inside, share = inside and node is not top, share / 2
    return kept, own


def main_text(page: str) -> str:
    """The main text of ``page``: its blocks, joined by two line feeds."""
    root = parse(page)
    best = score(cut_noise(root))
    alone = best is None or best.size < PARAGRAPH  # no story to tell from the rest
    return "\n\n".join(blocks(root, *(() if alone else keep_with(best))))


def extract(df: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Per row: id_col, url_col, text (empty if there is none), n_chars (its code points).

    A header of an article belongs to it, the page's own does not. A null or blank page, or one without a story, has an empty text; a null id or url stays null. Pages of any length are read whole,
    in a time linear in it. Of containers with as many points the first to end counts. Repeated rows are returned each; an empty
    table gives no rows; further columns, whatever their names, are left out.
    """
    out = pa.schema([(id_col, pa.int64()), (url_col, pa.string()), ("text", pa.string()), ("n_chars", pa.int64())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in bounded(batches, "html"):
            texts = [main_text(x) if x else "" for x in batch.column(2).to_pylist()]
            yield pa.record_batch([batch.column(0), batch.column(1).cast(pa.string()), pa.array(texts, pa.string()), pa.array([len(x) for x in texts], pa.int64())], schema=out)

    return df.select(F.col(id_col).cast("long").alias(id_col), F.col(url_col).cast("string").alias(url_col), F.col(html_col).cast("string").alias("html")).mapInArrow(run, f"{id_col} long, {url_col} string, text string, n_chars long")
