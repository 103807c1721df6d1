"""Main text of web pages from flat text blocks.

A page is cut into blocks of text at block tags. Each block has its number of words and link density, those of the
blocks before and after it, and whether the tags around it say content (article, main) or something else (menus,
headers, footers, sidebars, notices, adverts, forms, comments). A decision tree, trained on the small labelled table
below, tells main text from the rest; the chosen blocks are joined in page order. Of a page without any chosen block,
headings and paragraphs are taken that nothing around them speaks against.

The first article, or a main, tells that what holds it isn't something else by its name, nor as a menu, dialog or form;
but an article within what is named as comments, related stories or a sidebar tells nothing, nor does a later one. A form
with an article, main or three paragraphs in it is none.

Scripts, styles, comments of the markup and form controls hold no text. Character references are decoded, white space
within a block becomes one space. A null or empty page, or one without main text, gives the empty text; pages are read
whole, in one pass forward, broken markup included; repeated rows each get their text.

Broken markup: a tag whose quoted value never ends is taken to end at the next `>`; a `<` without any `>` after it is
text; of an element without its end tag only scripts and the like run to the page's end, of others the tag goes.
"""

from __future__ import annotations

import html as entities
import re
from collections import deque
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from leadmill.llm.common import table

#: Elements that hold no text, and those of them that run to the page's end where their end tag is missing.
_DROPPED = frozenset("script style noscript template textarea select button svg annotation-xml annotation iframe object title option datalist canvas audio video".split())
_RAW = frozenset("script style textarea title iframe".split())
_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)")
_VALUE = re.compile(r"=\s*([\"'])|>")
_INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img input ins kbd label mark nobr q rp rt ruby s samp small span strike strong sub sup time tt u var wbr math semantics mi mo mn ms mtext mrow msup msub msubsup mfrac msqrt mroot mover munder munderover mtable mtr mtd mfenced mstyle mspace mpadded mphantom menclose merror".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_OTHER = frozenset("nav aside footer".split())
#: The same, unless the page's article lies in them.
_PERHAPS = frozenset("fieldset menu dialog".split())
_CONTENT = frozenset("article main".split())
#: Elements whose end tags may be missing: what a start tag of that name ends, and the elements that bound the search.
_CELLS = frozenset("table td th".split())
_ENDS = {
    "p": ({"p"}, _CELLS), "li": ({"li"}, _CELLS | {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, _CELLS | {"dl"}), "dd": ({"dt", "dd"}, _CELLS | {"dl"}),
    "tr": ({"tr"}, {"table"}), "td": ({"td", "th"}, {"table", "tr"}), "th": ({"td", "th"}, {"table", "tr"}), **{k: ({"tbody", "thead", "tfoot", "tr"}, {"table"}) for k in ("tbody", "thead", "tfoot")},
}
#: Start tags that end an open p.
_END_P = frozenset("address article aside blockquote center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr li main menu nav ol p pre search section summary table ul".split())
_NAMES = re.compile(r"(?:class|id|role|aria-label)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
#: Whole names of what isn't main text: parts that say so, and others beside them that say nothing (sidebar, site-footer, but not has-sidebar, tag-politics).
_SAYS = r"(?:ads?|advert\w*|banner|sponsor\w*|promo\w*|nav\w*|menu\w*|breadcrumbs?|foot(?:er\w*)?|header|masthead|side(?:bar)?\w*|widget\w*|cookie\w*|consent|notice\w*|alert\w*|popup|modal|newsletter|subscri\w*|signup|login|comments?\w*|repl(?:y|ies)|disqus|share\w*|sharing|social\w*|related\w*|recommend\w*|contentinfo|navigation|complementary|search\w*|legal|copyright|tags?)\d*"
_BESIDE = r"(?:\d+|area|articles|bar|block|bottom|box|container|form|global|inner|items|left|links?|list|message|page|policy|posts|primary|right|secondary|section|site|slot|stories|text|top|unit|wrap(?:per)?)"
_SAYS_PART, _ANY_PART = re.compile(_SAYS, re.I), re.compile(f"{_SAYS}|{_BESIDE}", re.I)
#: Names of what holds others' words or stories: also with whose they are, and whatever articles lie in it.
_STRONG = r"(?:comment(?:s|ary|list|lists|form)?|repl(?:y|ies)|responses?|respond|discussion|disqus\w*|related\w*|recommend\w*|side(?:bar)?\w*)\d*"
_WHOSE = r"(?:user|users|reader|readers|visitor|visitors|member|members|guest|post|posts|entry|article|story|news|blog|view|all|new|latest|recent|wp|fb|facebook|threads?|feed)"
_STRONG_PART, _STRONG_ANY = re.compile(_STRONG, re.I), re.compile(f"{_STRONG}|{_SAYS}|{_BESIDE}|{_WHOSE}", re.I)
#: Paragraphs of at least so many words make text of a form, if there are so many.
FORM_WORDS, FORM_PARAGRAPHS = 8, 3
_PARAGRAPHS = frozenset("p blockquote pre".split())
#: Never something else by their names.
_NEVER = frozenset("html head body article main".split())


class Block(NamedTuple):
    text: str
    words: int
    linked: float
    other: int
    content: int
    heading: int
    paragraph: int


def says_other(names: str) -> int:
    """Whether one of the names, with all its parts, says that the element isn't main text: 2, or 3 if articles within it
    aren't either; else 0."""
    out = 0
    for name in names.split():
        parts = [p for p in re.split("[-_]+", name) if p]
        if parts and any(map(_STRONG_PART.fullmatch, parts)) and all(map(_STRONG_ANY.fullmatch, parts)):
            return 3
        if parts and any(map(_SAYS_PART.fullmatch, parts)) and all(map(_ANY_PART.fullmatch, parts)):
            out = 2
    return out


def tags(page: str) -> Iterator[tuple[str, str, bool, str]]:
    """(text before it, name, whether it ends the element, attributes) of each tag; without a name for comments, what
    holds no text, and the page's end. Each kind of end that is missing is looked for once."""
    at = pos = 0
    gone: set[str] = set()

    def end_of_tag(i: int) -> int:
        while "quotes" not in gone:
            m = _VALUE.search(page, i)
            if m is None:
                gone.add("quotes")  # no end outside of values: from here on quotes say nothing
                break
            if m[1] is None:
                return m.end()
            close = -1 if m[1] in gone else page.find(m[1], m.end())
            if close < 0:
                gone.add(m[1])
            i = m.end() if close < 0 else close + 1
        return page.find(">", i) + 1

    while (lt := page.find("<", pos)) >= 0:
        if page.startswith("<!--", lt):
            end = page.find("-->", lt + 2)
            yield page[at:lt], "", False, ""
            at = pos = len(page) if end < 0 else end + 3
            continue
        m = _TAG.match(page, lt)
        if m is None and page[lt + 1 : lt + 2] not in ("!", "?", "/"):
            pos = lt + 1
            continue
        end = end_of_tag(m.end()) if m else page.find(">", lt) + 1
        if not end and m:
            end = page.find(">", m.end()) + 1
        if not end:
            break
        if m is None:
            yield page[at:lt], "", False, ""
            at = pos = end
            continue
        name, attributes = m[2].lower(), page[m.end() : end - 1]
        if name in _DROPPED and not m[1]:
            close = None if name in gone or (name == "svg" and attributes.endswith("/")) else re.compile(rf"</{name}\s*>", re.I).search(page, end)
            yield page[at:lt], "", False, ""
            at = pos = close.end() if close else end
            if close is None and not attributes.endswith("/"):
                gone.add(name)
                if name in _RAW:
                    at = len(page)
                    break
            continue
        yield page[at:lt], name, bool(m[1]), attributes
        at = pos = end
    yield page[at:], "", False, ""


class _Open:
    """Open elements. Their places are kept by name and their marks are counted, so no step walks over all of them."""

    def __init__(self):
        self.stack: list[tuple[str, int, int]] = []  # name, other (1 for good, 2 unless an article lies in it), content
        self.places: dict[str, list[int]] = {}
        self.perhaps: deque[int] = deque()  # places of the latter
        self.other = self.content = 0
        self.link: int | None = None  # number of elements around the open link

    def push(self, name: str, other: int, content: int) -> None:
        self.places.setdefault(name, []).append(len(self.stack))
        if other == 2:
            self.perhaps.append(len(self.stack))
        self.stack.append((name, other, content))
        self.other += other == 1
        self.content += content

    def close(self, names, bounds=()) -> None:
        """Closes the nearest open element of one of the names and all within, unless one of the bounds is nearer."""
        nearest = lambda some: max((self.places[n][-1] for n in some if self.places.get(n)), default=-1)
        k = nearest(names)
        if k < 0 or k < nearest(bounds):
            return
        while len(self.stack) > k:
            name, other, content = self.stack.pop()
            self.places[name].pop()
            if self.perhaps and self.perhaps[-1] == len(self.stack):
                self.perhaps.pop()
            self.other -= other == 1
            self.content -= content
        if self.link is not None and self.link > k:
            self.link = None

    def unmark(self) -> None:
        """What is open isn't something else any more, but for what is for good."""
        self.perhaps.clear()


def blocks(page: str | None) -> list[Block]:
    """Flat blocks of a page in order."""
    out: list[Block] = []
    forms: list[int] = []  # of each block the number of its form, 0 for none
    texts: dict[int, int] = {}  # paragraphs of each form; very many where an article lies in it
    open_ = _Open()
    parts: list[str] = []
    link_parts: list[str] = []
    heading = form = 0
    articles = False

    def flush():
        if parts:
            text = " ".join(entities.unescape("".join(parts)).split())
            if text:
                n = text.count(" ") + 1
                linked = len(" ".join(entities.unescape(" ".join(link_parts)).split()).split(" ")) if link_parts else 0
                paragraph = int(bool(open_.stack) and open_.stack[-1][0] in _PARAGRAPHS)
                out.append(Block(text, n, min(1.0, linked / n), int(open_.other > 0 or bool(open_.perhaps)), int(open_.content > 0), heading, paragraph))
                inside = form if open_.places.get("form") else 0
                forms.append(inside)
                texts[inside] = texts.get(inside, 0) + (paragraph and n >= FORM_WORDS and 2 * linked < n)
            parts.clear()
            link_parts.clear()

    for text, name, closing, attributes in tags(page or ""):
        if text:
            parts.append(text)
            if open_.link is not None and not text.isspace():
                link_parts.append(text)
        if not name:
            continue
        if name == "a":
            open_.link = None if closing else len(open_.stack)
        elif name == "br" or name == "img":
            parts.append(" ")
        if name in _INLINE:
            continue
        flush()
        heading = int(not closing and len(name) == 2 and name[0] == "h" and name[1].isdigit())
        if not closing and name in _END_P:
            open_.close({"p"}, _CELLS)
        if not closing and name in _ENDS:
            open_.close(*_ENDS[name])
        if name in _VOID:
            continue
        if not closing:
            named = " ".join(filter(None, (x for g in _NAMES.findall(attributes) for x in g)))
            other = 1 if name in _OTHER or (name == "header" and not open_.content) else 2 if name in _PERHAPS else 0
            if name in _CONTENT:
                if open_.other == 0 and (name == "main" or not articles):
                    open_.unmark()
                    texts[form] = FORM_PARAGRAPHS + texts.get(form, 0)
                articles = articles or name == "article"
            elif name == "form":
                form += not open_.places.get("form")
            elif not other and name not in _NEVER:
                said = says_other(named)
                other = 1 if said == 3 else said
            if not attributes.endswith("/"):
                open_.push(name, other, int(name in _CONTENT))
        else:
            open_.close({name}, _ENDS[name][1] - {name} if name in _ENDS else ())
    flush()
    return [b if not f or texts[f] >= FORM_PARAGRAPHS else b._replace(other=1) for b, f in zip(out, forms, strict=True)]


FEATURES = ("words", "linked", "words_before", "linked_before", "words_after", "linked_after", "other", "content", "heading", "paragraph")
#: Labelled blocks, 1 for main text: words, link density, the same before and after, named as something else, inside content tags, heading, paragraph.
LABELLED = [
    # inside content tags: text of any length, headings, linked phrases
    (120, 0.0, 90, 0.0, 60, 0.0, 0, 1, 0, 1, 1), (45, 0.02, 10, 0.0, 80, 0.0, 0, 1, 0, 0, 1), (1, 0.0, 60, 0.0, 70, 0.0, 0, 1, 0, 1, 1), (3, 0.0, 40, 0.0, 12, 0.0, 0, 1, 0, 0, 1),
    (9, 0.0, 14, 0.0, 55, 0.0, 0, 1, 1, 0, 1), (7, 0.0, 1, 1.0, 30, 0.1, 0, 1, 1, 0, 1), (30, 0.3, 50, 0.0, 6, 1.0, 0, 1, 0, 1, 1), (12, 1.0, 70, 0.0, 50, 0.0, 0, 1, 0, 0, 1),
    (2, 0.0, 80, 0.0, 20, 0.0, 0, 1, 0, 1, 1), (200, 0.01, 5, 0.0, 9, 0.0, 0, 1, 0, 0, 1), (15, 0.0, 100, 0.0, 0, 0.0, 0, 1, 0, 1, 1), (1, 0.0, 1, 0.0, 1, 0.0, 0, 1, 0, 0, 1),
    # named as something else, within content or outside
    (30, 0.0, 60, 0.0, 25, 0.0, 1, 1, 0, 1, 0), (12, 0.0, 90, 0.0, 40, 0.0, 1, 1, 0, 0, 0), (80, 0.0, 30, 0.0, 70, 0.0, 1, 1, 0, 1, 0), (2, 1.0, 50, 0.0, 2, 1.0, 1, 1, 0, 0, 0),
    (9, 0.0, 1, 1.0, 10, 0.0, 1, 0, 0, 1, 0), (1, 1.0, 1, 1.0, 1, 1.0, 1, 0, 0, 0, 0), (20, 0.1, 80, 0.0, 0, 0.0, 1, 0, 0, 1, 0), (60, 0.0, 9, 0.0, 12, 0.0, 1, 0, 0, 0, 0),
    (6, 0.0, 40, 0.0, 30, 0.0, 1, 1, 1, 0, 0), (150, 0.0, 70, 0.0, 8, 0.0, 1, 0, 0, 0, 0), (1, 0.0, 12, 0.0, 3, 0.0, 1, 0, 0, 1, 0), (4, 0.0, 0, 0.0, 90, 0.0, 1, 0, 1, 0, 0),
    # no tags that tell: long unlinked text and what stands beside it is main text
    (70, 0.0, 55, 0.0, 64, 0.02, 0, 0, 0, 1, 1), (40, 0.05, 8, 0.0, 90, 0.0, 0, 0, 0, 0, 1), (33, 0.0, 3, 1.0, 45, 0.0, 0, 0, 0, 1, 1), (110, 0.1, 60, 0.0, 5, 0.9, 0, 0, 0, 0, 1),
    (8, 0.0, 60, 0.0, 75, 0.0, 0, 0, 1, 0, 1), (11, 0.0, 45, 0.0, 38, 0.0, 0, 0, 0, 0, 1), (5, 0.0, 90, 0.0, 66, 0.0, 0, 0, 0, 1, 1), (9, 0.0, 2, 1.0, 80, 0.0, 0, 0, 1, 0, 1),
    (10, 0.0, 4, 0.8, 50, 0.0, 0, 0, 1, 0, 1), (24, 0.0, 70, 0.0, 3, 1.0, 0, 0, 0, 0, 1), (52, 0.0, 0, 0.0, 0, 0.0, 0, 0, 0, 1, 1), (26, 0.04, 40, 0.0, 9, 0.5, 0, 0, 0, 0, 1),
    # no tags that tell: short, linked, or among links is not
    (2, 1.0, 2, 1.0, 2, 1.0, 0, 0, 0, 0, 0), (1, 1.0, 1, 1.0, 9, 0.0, 0, 0, 0, 0, 0), (6, 0.9, 4, 1.0, 60, 0.0, 0, 0, 0, 0, 0), (3, 0.0, 2, 1.0, 2, 1.0, 0, 0, 0, 0, 0),
    (4, 0.0, 80, 0.0, 2, 1.0, 0, 0, 0, 0, 0), (7, 0.2, 30, 0.0, 0, 0.0, 0, 0, 0, 0, 0), (25, 0.8, 3, 1.0, 4, 1.0, 0, 0, 0, 0, 0), (40, 0.9, 50, 0.0, 5, 1.0, 0, 0, 0, 0, 0),
    (5, 0.0, 6, 1.0, 4, 0.0, 0, 0, 0, 0, 0), (3, 0.0, 0, 0.0, 4, 0.0, 0, 0, 0, 0, 0), (8, 0.5, 5, 0.6, 7, 0.4, 0, 0, 0, 0, 0), (9, 0.0, 3, 0.0, 4, 0.5, 0, 0, 0, 0, 0),
    # what is main text only inside content tags
    (1, 0.0, 60, 0.0, 70, 0.0, 0, 0, 0, 0, 0), (3, 0.0, 40, 0.0, 12, 0.0, 0, 0, 0, 0, 0), (12, 1.0, 70, 0.0, 50, 0.0, 0, 0, 0, 0, 0), (2, 0.0, 80, 0.0, 20, 0.0, 0, 0, 0, 0, 0), (1, 0.0, 1, 0.0, 1, 0.0, 0, 0, 0, 0, 0),
    (1, 0.0, 60, 0.0, 70, 0.0, 0, 1, 0, 1, 1), (3, 0.0, 40, 0.0, 12, 0.0, 0, 1, 0, 0, 1), (12, 1.0, 70, 0.0, 50, 0.0, 0, 1, 0, 1, 1), (2, 0.0, 80, 0.0, 20, 0.0, 0, 1, 0, 1, 1), (1, 0.0, 1, 0.0, 1, 0.0, 0, 1, 0, 1, 1),
    (1, 1.0, 60, 0.0, 70, 0.0, 0, 1, 0, 1, 1), (3, 1.0, 2, 1.0, 2, 1.0, 0, 1, 0, 0, 1), (6, 0.9, 4, 1.0, 0, 0.0, 0, 1, 0, 0, 1), (4, 0.0, 0, 0.0, 4, 1.0, 0, 1, 1, 0, 1), (2, 0.0, 2, 1.0, 0, 0.0, 0, 1, 0, 0, 1),
    (3, 0.0, 2, 1.0, 0, 0.0, 0, 0, 0, 0, 0), (5, 1.0, 1, 0.0, 12, 0.0, 0, 0, 0, 0, 0), (4, 1.0, 60, 0.0, 0, 0.0, 0, 0, 0, 1, 0), (1, 0.0, 2, 1.0, 5, 1.0, 0, 0, 0, 0, 0), (1, 0.0, 1, 0.0, 4, 1.0, 0, 0, 0, 0, 0),
    # paragraphs without tags that tell: also short ones, at the end or among links, unless they are links themselves
    (19, 0.0, 18, 0.0, 0, 0.0, 0, 0, 0, 1, 1), (4, 0.0, 8, 0.0, 0, 0.0, 0, 0, 0, 1, 1), (12, 0.1, 3, 1.0, 5, 0.0, 0, 0, 0, 1, 1), (6, 0.0, 2, 1.0, 3, 1.0, 0, 0, 0, 1, 1),
    (18, 0.0, 2, 0.0, 19, 0.0, 0, 0, 0, 1, 1), (3, 0.0, 30, 0.0, 2, 1.0, 0, 0, 0, 1, 1), (3, 1.0, 20, 0.0, 20, 0.0, 0, 0, 0, 1, 0), (9, 0.9, 30, 0.0, 0, 0.0, 0, 0, 0, 1, 0),
    (40, 0.3, 50, 0.0, 30, 0.0, 0, 0, 0, 1, 1), (20, 0.4, 30, 0.0, 25, 0.1, 0, 0, 0, 1, 1), (60, 0.35, 0, 0.0, 9, 0.0, 0, 0, 0, 0, 1), (12, 0.3, 9, 0.0, 0, 0.0, 0, 0, 0, 1, 1),
    (4, 1.0, 1, 1.0, 2, 1.0, 0, 0, 0, 1, 0), (14, 0.7, 6, 0.0, 2, 1.0, 0, 0, 0, 1, 0), (2, 0.0, 19, 0.0, 18, 0.0, 0, 0, 1, 0, 1), (2, 0.0, 3, 1.0, 18, 0.0, 0, 0, 1, 0, 1),
]


class Tree(NamedTuple):
    feature: int
    threshold: float
    low: object
    high: object


def grown(rows: list[tuple], depth: int = 6):
    """A decision tree by least Gini impurity; a leaf is the share of main text among its rows."""
    share = sum(r[-1] for r in rows) / len(rows)
    if depth == 0 or share in (0.0, 1.0):
        return share
    gini = lambda part: 2 * sum(r[-1] for r in part) * (len(part) - sum(r[-1] for r in part)) / len(part)
    best = None
    for f in range(len(FEATURES)):
        values = sorted({r[f] for r in rows})
        for a, b in zip(values, values[1:], strict=False):
            cut = (a + b) / 2
            low, high = [r for r in rows if r[f] <= cut], [r for r in rows if r[f] > cut]
            if best is None or gini(low) + gini(high) < best[0] - 1e-12:
                best = (gini(low) + gini(high), f, cut, low, high)
    if best is None:
        return share
    return Tree(best[1], best[2], grown(best[3], depth - 1), grown(best[4], depth - 1))


@lru_cache(1)
def default_tree():
    return grown(LABELLED)


def is_main(tree, row: tuple) -> bool:
    while isinstance(tree, Tree):
        tree = tree.high if row[tree.feature] > tree.threshold else tree.low
    return tree >= 0.5


def main_text(page: str | None, tree=None) -> str:
    """The main text of a page: its main blocks joined by an empty line."""
    tree = tree or default_tree()
    found = blocks(page)
    out = []
    for k, b in enumerate(found):
        before, after = found[k - 1] if k else None, found[k + 1] if k + 1 < len(found) else None
        around = [x for n in (before, after) for x in ((n.words, n.linked) if n else (0, 0.0))]
        if is_main(tree, (b.words, b.linked, *around, b.other, b.content, b.heading, b.paragraph)):
            out.append(b.text)
    if not out and any(b.paragraph and not b.other and b.linked < 0.5 for b in found):
        out = [b.text for b in found if (b.paragraph or b.heading) and not b.other and b.linked < 0.5]
    return "\n\n".join(out)


def extractor(tree=None):
    """Column function: html -> main text."""

    @F.arrow_udf("string")
    def extract(pages: pa.Array) -> pa.Array:
        return pa.array([main_text(p, tree) for p in pages.to_pylist()], pa.string())

    return extract


def op10_html_extraction(spark, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url", extractor()(F.col("html")).alias("text"))
    return pages.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
