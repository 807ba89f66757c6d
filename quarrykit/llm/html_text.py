"""Main text of web pages from flat text blocks, classified by a small decision tree.

After Kohlschuetter et al. (2010): a page is a flat list of text blocks; a block is judged by the word count and the link
density of itself and of the blocks before and after it. Three marks of the markup come on top: whether the block stands
in an article, whether something speaks against it (a tag, role or comment section; or merely a class name, which long
running text outweighs), and what kind of element it is. The tree is grown here (Gini) from the labelled blocks in
``TABLE``.

A page is scanned once from left to right; no part of it is looked at again, however broken the markup is.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A tag with its attributes; nothing in it is tried twice.
_TAG = re.compile(r"""<(/?)([a-zA-Z][a-zA-Z0-9:-]*+)((?:[^>"']|"[^"]*+"|'[^']*+')*+)>""")
_NAME = re.compile(r"<(/?)([a-zA-Z][a-zA-Z0-9:-]*+)")
#: Elements whose content is no text: to the end of the page if left open, or, if left open, plain tags.
_RAW = frozenset(("script", "style"))
_SKIPPED = frozenset("noscript template svg math iframe object canvas audio video select textarea button title".split())
_CLOSING = {x: re.compile(rf"</{x}\b[^>]*>", re.I) for x in _RAW | _SKIPPED}
_INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark meta q rp rt ruby s samp small span strike strong sub sup time tt u var wbr link input".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Whose end tag may be left out before another one.
_LOOSE = frozenset("p li tr td th dt dd option".split())
_BOILER = frozenset("nav footer aside form menu dialog fieldset head".split())
_CONTENT = frozenset(("article", "main"))
_ROLES = frozenset("navigation banner contentinfo complementary search menu menubar dialog alert".split())
_COMMENTS = frozenset("comment comments commentlist disqus replies respond".split())
_AGAINST = frozenset(
    "ad ads adv advert advertisement advertising adsense banner breadcrumb breadcrumbs byline captcha consent cookie cookies copyright disclaimer discussion footer gdpr header legal login masthead menu meta modal nav navbar navigation newsletter notice notices notification overlay pager pagination popup promo promoted promotion related reply search share sharing sidebar signup social sponsor sponsored subscribe subscription tags teaser toolbar topbar widget widgets".split()
)
_MAIN = frozenset("article content entry main post story".split())
_MARKED = re.compile(r"""\b(?:class|id)\s*+=\s*+(?:"([^"]*+)"|'([^']*+)'|([^\s>]++))""", re.I)
_ROLE = re.compile(r"""\brole\s*+=\s*+["']?([a-z]++)""", re.I)
_HIDDEN = re.compile(r"""\shidden(?=[\s=/]|\Z)|aria-hidden\s*+=\s*+["']?true|display\s*+:\s*+none""", re.I)
_SPACE = re.compile(r"\s+")
_KINDS = dict.fromkeys("h1 h2 h3 h4 h5 h6".split(), 3) | dict.fromkeys("p blockquote pre dd figcaption".split(), 2) | dict.fromkeys("li td th dt".split(), 1)


@dataclass
class Block:
    text: str
    words: int
    linked: int
    inside: int  # 2 in an article or main element, 1 in one that is called so, 0 neither
    against: int  # 2 by tag, role or comment section, 1 by a class name or id, 0 nothing
    kind: int  # 3 heading, 2 paragraph, 1 list item or cell, 0 other

    @property
    def density(self) -> float:
        return self.linked / self.words if self.words else 0.0


def _marks(tag: str, attributes: str, inside: int, against: int) -> tuple[int, int]:
    """The marks of what an element holds, from its own and those around it."""
    if tag in _CONTENT:
        return 2, against
    if tag in _BOILER or tag == "header" and not inside:
        return inside, 2
    if attributes and tag not in ("html", "body"):
        if (m := _ROLE.search(attributes)) and m[1].lower() in _ROLES or _HIDDEN.search(attributes):
            return inside, 2
        for m in _MARKED.finditer(attributes):
            names = re.split(r"[^a-z]+", (m[1] or m[2] or m[3] or "").lower())
            if not _COMMENTS.isdisjoint(names):
                return inside, 2
            if not _AGAINST.isdisjoint(names):
                against = max(against, 1)
            elif not _MAIN.isdisjoint(names):
                inside = max(inside, 1)
    return inside, against


def tokens(page: str) -> Iterator[tuple[str, str, str]]:
    """(text before, tag in lower case with ``/`` before an end tag, attributes) from left to right; the last tag is empty.
    Of comments, declarations and elements without text only a blank remains."""
    at, n, quoted, missing = 0, len(page), True, set()
    text_from = 0
    while (start := page.find("<", at)) >= 0:
        if page.startswith("<!--", start):
            end = page.find("-->", start + 4)
            yield page[text_from:start], "", ""
            at = text_from = n if end < 0 else end + 3
        elif page.startswith(("<!", "<?"), start):
            end = page.find(">", start)
            yield page[text_from:start], "", ""
            at = text_from = n if end < 0 else end + 1
        elif m := _NAME.match(page, start):
            whole = _TAG.match(page, start) if quoted else None
            if whole is None:  # a quote is left open: from here on a tag ends at the next >
                quoted = False
                end = page.find(">", start)
                stop, attributes = (n, "") if end < 0 else (end + 1, page[m.end() : end])
            else:
                stop, attributes = whole.end(), whole[3]
            name = m[2].lower()
            if not m[1] and not attributes.endswith("/") and name in _CLOSING and name not in missing:
                if close := _CLOSING[name].search(page, stop):
                    stop, name = close.end(), "" if name in _RAW or name in ("noscript", "template", "title") else " "
                elif name in _RAW:
                    stop, name = n, ""
                else:
                    missing.add(name)
            yield page[text_from:start], m[1] + name, attributes
            at = text_from = stop
        else:
            at = start + 1  # a sign in the text
    yield page[text_from:], "", ""


def blocks(page: str) -> list[Block]:
    """The text blocks of a page in order. Inline elements and line breaks don't end a block, all others do."""
    out: list[Block] = []
    text: list[str] = []
    linked: list[str] = []
    stack: list[tuple[str, int, int]] = []
    held: Counter[str] = Counter()
    inside, against, anchors, kind = 0, 0, 0, 0

    def flush() -> None:
        if text:
            plain = _SPACE.sub(" ", html.unescape("".join(text))).strip()
            if plain:
                out.append(Block(plain, plain.count(" ") + 1, len(html.unescape(" ".join(linked)).split()), inside, against, kind))
            text.clear()
            linked.clear()

    for piece, tag, attributes in tokens(page):
        if piece:
            text.append(piece)
            if anchors:
                linked.append(piece)
        if tag in ("", " "):
            text += [" "] * len(tag)
            continue
        closing, tag = tag[0] == "/", tag.lstrip("/")
        if tag in _INLINE:
            if tag == "a":
                anchors = max(0, anchors - 1) if closing else anchors + 1
            elif tag in ("br", "img", "input"):
                text.append(" ")
            continue
        flush()
        if closing:
            while held[tag]:  # what is still open in it ends with it
                name, inside, against = stack.pop()
                held[name] -= 1
                if name == tag:
                    break
        elif tag not in _VOID and not attributes.endswith("/"):
            if tag in _LOOSE and stack and stack[-1][0] == tag:
                name, inside, against = stack.pop()
                held[name] -= 1
            stack.append((tag, inside, against))
            held[tag] += 1
            inside, against = _marks(tag, attributes, inside, against)
        anchors = 0 if tag in ("li", "p", "div", "nav", "article", "footer") else anchors
        kind = 0 if closing else _KINDS.get(tag, 0)
    flush()
    return out


#: Labelled blocks: inside, against, kind (see ``Block``); words and link density of the block, the one before, the one
#: after; main text or not.
TABLE = (
    # in articles: paragraphs short and long, headings, linked headings, sentences with links, lists, captions
    (2, 0, 2, 60, 0.0, 45, 0.0, 50, 0.0, 1), (2, 0, 2, 1, 0.0, 20, 0.0, 9, 0.0, 1), (2, 0, 2, 12, 0.0, 1, 1.0, 0, 0.0, 1), (2, 0, 2, 2, 0.0, 80, 0.0, 8, 0.0, 1),
    (2, 0, 3, 8, 0.0, 9, 0.0, 40, 0.0, 1), (2, 0, 3, 1, 0.0, 0, 0.0, 2, 0.0, 1), (2, 0, 3, 10, 1.0, 2, 1.0, 35, 0.0, 1), (2, 0, 2, 25, 0.45, 50, 0.0, 60, 0.1, 1),
    (2, 0, 1, 4, 0.0, 30, 0.0, 5, 0.0, 1), (2, 0, 1, 18, 0.2, 6, 0.0, 12, 0.0, 1), (2, 0, 0, 9, 0.0, 60, 0.0, 30, 0.0, 1), (2, 0, 0, 2, 0.0, 8, 0.0, 15, 0.0, 1),
    (1, 0, 2, 40, 0.0, 30, 0.0, 25, 0.0, 1), (1, 0, 2, 3, 0.0, 7, 0.0, 50, 0.0, 1), (1, 0, 3, 5, 0.0, 1, 1.0, 30, 0.0, 1), (1, 0, 1, 6, 0.0, 20, 0.0, 7, 0.0, 1),
    (1, 0, 0, 20, 0.0, 10, 0.0, 15, 0.0, 1), (1, 0, 2, 90, 0.1, 1, 1.0, 3, 1.0, 1), (2, 0, 2, 35, 0.1, 4, 1.0, 5, 1.0, 1), (1, 0, 0, 4, 0.0, 50, 0.0, 40, 0.0, 1),
    (2, 0, 2, 3, 0.0, 5, 0.0, 4, 0.0, 1), (2, 0, 2, 7, 0.0, 12, 0.0, 3, 0.0, 1), (2, 0, 2, 1, 0.0, 1, 0.0, 2, 0.0, 1), (2, 0, 2, 10, 0.0, 3, 0.0, 10, 0.0, 1),
    (2, 0, 2, 5, 0.0, 90, 0.0, 4, 1.0, 1), (2, 0, 3, 3, 0.0, 30, 0.0, 3, 0.0, 1), (2, 0, 3, 6, 0.0, 4, 1.0, 1, 0.0, 1), (2, 0, 2, 9, 0.0, 0, 0.0, 1, 1.0, 1),
    (2, 0, 0, 3, 0.0, 4, 0.0, 3, 0.0, 1), (2, 0, 1, 2, 0.0, 3, 0.0, 3, 0.0, 1), (2, 0, 0, 10, 0.0, 12, 0.0, 0, 0.0, 1), (2, 0, 1, 9, 0.0, 8, 0.0, 0, 0.0, 1),
    (1, 0, 2, 4, 0.0, 6, 0.0, 3, 0.0, 1), (1, 0, 2, 8, 0.0, 30, 0.0, 0, 0.0, 1), (1, 0, 3, 4, 0.0, 9, 0.0, 3, 0.0, 1), (1, 0, 1, 4, 0.0, 5, 0.0, 0, 0.0, 1),
    (2, 0, 2, 2, 0.0, 2, 1.0, 2, 1.0, 1), (2, 0, 0, 6, 0.1, 1, 1.0, 3, 1.0, 1), (2, 0, 1, 6, 0.0, 5, 1.0, 4, 1.0, 1), (1, 0, 2, 6, 0.2, 3, 1.0, 5, 1.0, 1),
    # in articles: lists of links, links to share or to go on
    (2, 0, 1, 1, 1.0, 40, 0.0, 1, 1.0, 0), (2, 0, 1, 5, 1.0, 6, 1.0, 4, 1.0, 0), (2, 0, 0, 3, 1.0, 2, 1.0, 12, 0.1, 0), (2, 0, 2, 14, 0.9, 30, 0.0, 25, 0.0, 0),
    (1, 0, 1, 2, 1.0, 3, 1.0, 2, 1.0, 0), (1, 0, 0, 7, 0.9, 50, 0.0, 2, 1.0, 0), (1, 0, 2, 3, 1.0, 60, 0.0, 0, 0.0, 0), (2, 0, 0, 30, 0.8, 20, 1.0, 15, 0.9, 0),
    # in articles, under a name that speaks against them: leads and long text stay, short pieces go
    (2, 1, 2, 35, 0.0, 9, 0.0, 60, 0.0, 1), (2, 1, 2, 28, 0.1, 7, 0.0, 40, 0.0, 1), (2, 1, 2, 80, 0.0, 60, 0.0, 70, 0.0, 1), (1, 1, 2, 70, 0.0, 50, 0.0, 60, 0.0, 1),
    (2, 1, 0, 45, 0.0, 8, 0.0, 50, 0.0, 1), (2, 1, 2, 8, 0.0, 50, 0.0, 30, 0.0, 0), (2, 1, 0, 4, 0.0, 60, 0.0, 10, 1.0, 0), (2, 1, 1, 3, 1.0, 30, 0.0, 3, 1.0, 0),
    (2, 1, 3, 2, 0.0, 70, 0.0, 6, 1.0, 0), (1, 1, 0, 10, 0.0, 40, 0.0, 30, 0.0, 0), (2, 1, 0, 15, 0.0, 45, 0.0, 60, 0.0, 0), (1, 1, 2, 12, 0.0, 25, 0.0, 0, 0.0, 0),
    (2, 1, 2, 25, 0.0, 1, 0.0, 3, 0.0, 1), (2, 1, 2, 30, 0.0, 9, 0.0, 8, 0.0, 1), (2, 1, 2, 22, 0.0, 30, 0.0, 12, 0.0, 1), (2, 1, 2, 26, 0.0, 4, 0.0, 20, 0.0, 1),
    (2, 1, 2, 14, 0.0, 9, 0.0, 20, 0.0, 0), (2, 1, 2, 10, 0.0, 8, 0.0, 60, 0.0, 0), (2, 1, 0, 6, 0.0, 5, 0.0, 50, 0.0, 0), (2, 1, 1, 12, 0.0, 20, 0.0, 40, 0.0, 0),
    # parts that are boilerplate whatever they say: menus, footers, forms, asides, reader comments
    (0, 2, 1, 1, 1.0, 1, 1.0, 1, 1.0, 0), (0, 2, 0, 14, 0.0, 40, 0.0, 0, 0.0, 0), (0, 2, 2, 60, 0.0, 50, 0.0, 40, 0.0, 0), (2, 2, 2, 70, 0.0, 60, 0.0, 45, 0.0, 0),
    (2, 2, 2, 12, 0.0, 30, 0.0, 25, 0.0, 0), (0, 2, 3, 2, 0.0, 30, 0.0, 25, 0.0, 0), (1, 2, 2, 35, 0.2, 20, 0.0, 30, 0.0, 0), (0, 2, 2, 130, 0.0, 4, 0.0, 100, 0.0, 0),
    (2, 2, 3, 3, 0.0, 60, 0.0, 20, 0.0, 0), (0, 2, 0, 8, 0.0, 3, 0.0, 0, 0.0, 0), (2, 2, 0, 150, 0.0, 80, 0.0, 90, 0.0, 0), (1, 2, 1, 9, 0.0, 12, 0.0, 9, 0.0, 0),
    (2, 2, 3, 1, 0.0, 150, 0.0, 150, 0.0, 0), (1, 2, 3, 2, 0.0, 20, 0.0, 100, 0.0, 0), (0, 2, 3, 4, 0.0, 1, 1.0, 160, 0.0, 0), (0, 2, 2, 160, 0.0, 150, 0.0, 150, 0.0, 0),
    # under a name that speaks against them: running text among running text stays
    (0, 1, 2, 150, 0.0, 3, 0.0, 140, 0.0, 1), (0, 1, 2, 70, 0.0, 60, 0.0, 80, 0.0, 1), (0, 1, 2, 140, 0.05, 1, 1.0, 0, 0.0, 1), (0, 1, 2, 65, 0.1, 55, 0.0, 4, 0.0, 1),
    (0, 1, 3, 4, 0.0, 2, 1.0, 120, 0.0, 1), (0, 1, 0, 160, 0.0, 90, 0.0, 130, 0.0, 1), (0, 1, 2, 66, 0.0, 8, 0.0, 75, 0.0, 1), (1, 1, 2, 90, 0.0, 5, 0.0, 80, 0.0, 1),
    (0, 1, 0, 9, 0.0, 1, 1.0, 8, 0.0, 0), (0, 1, 0, 20, 0.0, 1, 1.0, 12, 0.0, 0), (0, 1, 2, 40, 0.0, 6, 0.0, 1, 1.0, 0), (0, 1, 2, 62, 0.1, 5, 0.0, 2, 1.0, 0),
    (0, 1, 0, 2, 0.0, 60, 0.0, 50, 0.0, 0), (0, 1, 1, 6, 1.0, 5, 1.0, 7, 1.0, 0), (0, 1, 3, 3, 0.0, 4, 1.0, 12, 0.0, 0), (0, 1, 0, 30, 0.0, 50, 0.0, 60, 0.0, 0),
    (0, 1, 2, 18, 0.0, 70, 0.0, 90, 0.0, 0), (0, 1, 0, 70, 0.9, 60, 0.8, 65, 0.9, 0), (0, 1, 2, 25, 0.3, 3, 0.0, 0, 0.0, 0), (0, 1, 3, 5, 0.0, 8, 0.0, 30, 0.0, 0),
    # without any mark: running text, short paragraphs and lists beside it, headings before it
    (0, 0, 2, 60, 0.0, 45, 0.0, 50, 0.0, 1), (0, 0, 2, 20, 0.1, 8, 0.0, 40, 0.0, 1), (0, 0, 2, 90, 0.02, 1, 1.0, 2, 1.0, 1), (0, 0, 2, 6, 0.0, 40, 0.0, 8, 0.0, 1),
    (0, 0, 2, 3, 0.0, 9, 0.0, 14, 0.0, 1), (0, 0, 2, 25, 0.0, 0, 0.0, 0, 0.0, 1), (0, 0, 2, 5, 0.0, 0, 0.0, 0, 0.0, 1), (0, 0, 2, 16, 0.2, 1, 1.0, 20, 0.0, 1),
    (0, 0, 3, 6, 0.0, 1, 1.0, 45, 0.0, 1), (0, 0, 3, 9, 0.0, 50, 0.0, 30, 0.0, 1), (0, 0, 3, 3, 0.0, 0, 0.0, 12, 0.0, 1), (0, 0, 1, 7, 0.0, 30, 0.0, 9, 0.0, 1),
    (0, 0, 1, 4, 0.0, 5, 0.0, 6, 0.0, 1), (0, 0, 1, 25, 0.1, 8, 0.0, 40, 0.0, 1), (0, 0, 0, 40, 0.0, 20, 0.0, 18, 0.0, 1), (0, 0, 0, 25, 0.0, 30, 0.0, 35, 0.0, 1),
    (0, 0, 0, 70, 0.1, 2, 1.0, 3, 1.0, 1), (0, 0, 0, 18, 0.0, 45, 0.0, 60, 0.0, 1), (0, 0, 1, 12, 0.0, 10, 0.0, 2, 1.0, 1), (0, 0, 2, 9, 0.0, 18, 0.0, 2, 1.0, 1),
    (0, 0, 2, 7, 0.0, 9, 0.0, 3, 0.0, 1), (0, 0, 2, 2, 0.0, 30, 0.0, 3, 0.0, 1), (0, 0, 2, 8, 0.0, 4, 0.0, 4, 0.0, 1), (0, 0, 2, 4, 0.0, 20, 0.0, 0, 0.0, 1),
    # without any mark: menus, lists of links, bylines, dates, copyright lines, pieces among links
    (0, 0, 1, 1, 1.0, 1, 1.0, 1, 1.0, 0), (0, 0, 1, 5, 0.9, 4, 1.0, 6, 1.0, 0), (0, 0, 0, 20, 0.9, 18, 0.9, 22, 1.0, 0), (0, 0, 0, 3, 0.0, 1, 1.0, 4, 0.0, 0),
    (0, 0, 0, 8, 0.0, 40, 0.0, 0, 0.0, 0), (0, 0, 0, 5, 0.0, 60, 0.0, 3, 1.0, 0), (0, 0, 0, 4, 0.0, 8, 0.0, 50, 0.0, 0), (0, 0, 0, 10, 0.1, 4, 1.0, 3, 1.0, 0),
    (0, 0, 3, 2, 0.0, 6, 0.0, 3, 1.0, 0), (0, 0, 3, 4, 1.0, 9, 0.9, 12, 1.0, 0), (0, 0, 2, 10, 0.9, 6, 1.0, 20, 0.0, 0), (0, 0, 2, 30, 0.8, 40, 0.0, 25, 0.0, 0),
    (0, 0, 2, 4, 0.0, 2, 1.0, 3, 1.0, 0), (0, 0, 1, 3, 0.0, 1, 1.0, 2, 1.0, 0), (0, 0, 2, 6, 0.0, 5, 1.0, 8, 0.9, 0), (0, 0, 0, 35, 0.8, 20, 1.0, 30, 0.9, 0),
    (0, 0, 1, 2, 0.0, 1, 0.0, 1, 1.0, 0), (0, 0, 0, 12, 0.6, 10, 0.7, 15, 0.8, 0), (0, 0, 0, 9, 0.0, 0, 0.0, 1, 1.0, 0), (0, 0, 0, 6, 0.0, 2, 0.0, 0, 0.0, 0),
    (0, 0, 0, 3, 0.0, 4, 0.0, 3, 0.0, 0), (0, 0, 0, 9, 0.0, 12, 0.0, 4, 0.0, 0), (0, 0, 0, 2, 0.0, 9, 0.0, 2, 0.0, 0), (0, 0, 0, 10, 0.0, 30, 0.0, 12, 1.0, 0),
)


def grow(rows: list[tuple], depth: int = 10):
    """A binary tree: a label, or (feature, threshold, tree for values up to it, tree for larger ones)."""
    ones = sum(r[-1] for r in rows)
    if depth == 0 or ones in (0, len(rows)):
        return int(2 * ones >= len(rows))

    def gini(part: list[tuple]) -> float:
        p = sum(r[-1] for r in part) / len(part)
        return len(part) * p * (1 - p)

    best = None
    for f in range(len(rows[0]) - 1):
        values = sorted({r[f] for r in rows})
        for low, high in zip(values[:-1], values[1:], strict=True):
            cut = (low + high) / 2
            left, right = [r for r in rows if r[f] <= cut], [r for r in rows if r[f] > cut]
            worth = (gini(left) + gini(right), f, cut)
            if best is None or worth < best[0]:
                best = (worth, left, right)
    if best is None:
        return int(2 * ones >= len(rows))
    (_, f, cut), left, right = best
    return f, cut, grow(left, depth - 1), grow(right, depth - 1)


def decide(tree, features: tuple) -> int:
    while isinstance(tree, tuple):
        f, cut, low, high = tree
        tree = low if features[f] <= cut else high
    return tree


TREE = grow(list(TABLE))


def features(page: list[Block]) -> list[tuple]:
    """What the tree sees of each block; before the first and after the last stands an empty block."""
    none = Block("", 0, 0, 0, 0, 0)
    out = []
    if not page:
        return out
    for b, x, a in zip([none, *page[:-1]], page, [*page[1:], none], strict=True):
        out.append((x.inside, x.against, x.kind, x.words, x.density, b.words, b.density, a.words, a.density))
    return out


def extract(page: str | None, tree=TREE) -> str:
    """The blocks that the tree calls main text, joined by line feeds; empty for a null or empty page."""
    if not page:
        return ""
    found = blocks(page)
    return "\n".join(b.text for b, f in zip(found, features(found), strict=True) if decide(tree, f))


def _extract(tree):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                part = batch.slice(i, 256)
                texts = [extract(p, tree) for p in part.column(2).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    return run


def main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(id, url, text, n_chars) of every row, from the whole page; n_chars counts code points.

    Null and empty pages, and pages without main text, have an empty text. Rows without an id or url, and rows that
    repeat each other, stay as they are. Text that isn't well-formed is read much as browsers would: elements left open
    end with what encloses them; a comment, script or style left open runs to the end, other elements without text
    (buttons, drawings and the like) are then plain tags; once a quote is left open in a tag, tags end at the next ``>``.
    """
    source = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))
    kinds = dict(source.dtypes)
    out = source.mapInArrow(_extract(TREE), f"page_id {kinds['page_id']}, url {kinds['url']}, text string, n_chars long")
    return out.withColumnsRenamed({"page_id": id_col, "url": url_col})
