"""Main text of web pages by tree scoring.

The page becomes a tree of elements. Elements that by their kind, role or
name hold no article (menus, headers, footers, sidebars, notices, adverts,
forms, comments of readers, hidden parts) are left out with all they hold. A
paragraph gives its container one point, one for each comma and up to three
for its length, half of that to the next ancestor and less to the others; a
container's points count by the share of its text outside links. The best
container (or the article or main element around it) is kept with those of its siblings that score a
fifth of it, are headings, or are plain paragraphs.

Defined cases: null and empty pages give an empty text; broken markup, open
elements and cut character references are read as browsers do; pages without
any paragraph give the text that is left; pages of any length are read whole;
ties go to the container that starts first; repeated rows each get their text.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterable
from html import unescape

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from verilens.llm.common import free_name, text_of

# Kinds of elements.
BLOCKS = frozenset("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript iframe textarea title xmp noembed noframes".split())
LEFT_OUT = frozenset("head nav header footer aside form button select option datalist template dialog menu svg math canvas object audio video map".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
NAMES = frozenset("""ad ads adv advert adverts advertisement advertising advertorial sponsor sponsored promo promotion banner cookie cookies consent gdpr
    notice notices notification alert popup modal overlay newsletter subscribe signup paywall nav navbar navigation menu breadcrumb breadcrumbs pagination pager
    header masthead footer sidebar aside rail widget widgets comment comments disqus respond reply replies discussion share sharing social related recommended
    recommendation recommendations outbrain taboola login search toc skip""".split())
ARTICLE = frozenset(("article", "main"))
#: Words before a name that turn it into a layout property ("has-sidebar").
PROPERTY = frozenset(("has", "with", "no", "without", "is"))
CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
#: Elements that such an implied end does not reach across.
WALLS = frozenset("ul ol dl table div section article main body html td th".split())

_TAG = re.compile(r"<(?:(!--)|[!?][^>]*+>|(/?)([a-zA-Z][^\s/>]*+))")
_COMMENT_END = re.compile("--!?>")
#: Attributes up to the first > outside quotes. A tag whose quotes don't close within ``QUOTED`` characters ends at its first >.
_ATTRIBUTES = re.compile(r"((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>")
QUOTED = 1024
_ATTRIBUTE = re.compile(r"""([^\s"'>/=]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")
_PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
_END = {t: re.compile(rf"</{t}(?=[\s/>])[^>]*+>", re.I) for t in RAW}
_SPACE = re.compile(r"\s+")


def _no_article(tag: str, attributes: str) -> bool:
    """Whether an element is left out for its kind, role, name or because it is hidden."""
    if tag in LEFT_OUT:
        return True
    if not attributes.strip() or tag in ("html", "body", "main"):
        return False
    for name, value in _ATTRIBUTE.findall(attributes):
        name, value = name.lower(), value.strip("\"'")
        if name == "hidden" or (name == "aria-hidden" and value.lower() == "true") or (name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I)):
            return True
        if name == "role" and value.lower() in ROLES:
            return True
        if name in ("class", "id"):
            for one in value.split():
                parts = [x.lower() for x in _PARTS.findall(one)]
                if any(x in NAMES and (not i or parts[i - 1] not in PROPERTY) for i, x in enumerate(parts)):
                    return tag != "article" or parts[0] in ("comment", "ad", "advert", "promo", "related", "sponsored")
    return False


class _Page:
    """Elements by number (parents before children) and the blocks of text in page order."""

    def __init__(self, html: str):
        self.tag, self.parent, self.out, self.holder = ["html"], [-1], [False], [0]
        self.stack: list[int] = [0]
        self.open: defaultdict[str, list[int]] = defaultdict(list)  # places in the stack, by tag
        self.blocks: list[tuple[int, str, int]] = []  # element, text, characters in links
        self.buffer: list[str] = []
        self.linked = 0
        self._read(html)

    def _flush(self) -> None:
        if self.buffer:
            text = _SPACE.sub(" ", "".join(self.buffer)).strip()
            if text:
                self.blocks.append((self.holder[self.stack[-1]], text, self.linked))
            self.buffer, self.linked = [], 0

    def _pop(self) -> None:
        self.open[self.tag[self.stack.pop()]].pop()

    def _nearest(self, tags: Iterable[str]) -> int:
        """The highest place in the stack of an open element of these kinds; 0 if none is open."""
        return max((self.open[t][-1] for t in tags if self.open[t]), default=0)

    def _text(self, text: str) -> None:
        if text and not self.out[self.stack[-1]]:
            text = unescape(text)
            self.buffer.append(text)
            if self.open["a"]:
                self.linked += len(text.strip())

    def _close(self, tags: tuple[str, ...], walls: frozenset[str] = frozenset()) -> None:
        """End the nearest open element of these kinds, unless a wall stands before it."""
        at = self._nearest(tags)
        if at and at > self._nearest(walls - set(tags)):
            while len(self.stack) > at:
                self._pop()

    def _read(self, html: str) -> None:
        """One pass: nothing is a tag after the last >, so that no search runs to the end of the page in vain."""
        at, size, last = 0, len(html), html.rfind(">") + 1
        while at < size:
            m = _TAG.search(html, at, last)
            if not m:
                rest = html.find("<!--", at)  # a comment that never ends
                self._text(html[at:] if rest < 0 else html[at:rest])
                break
            self._text(html[at:m.start()])
            at = m.end()
            if m[1]:
                end = _COMMENT_END.search(html, at)
                at = end.end() if end else size
                continue
            if not m[3]:
                continue
            tag = m[3].lower()
            inside = _ATTRIBUTES.match(html, at, min(last, at + QUOTED))
            attributes = inside[1] if inside else html[at:html.index(">", at)]
            at += len(attributes) + 1
            if m[2]:
                if tag in BLOCKS:
                    self._flush()
                self._close((tag,), WALLS - {tag} if tag not in BLOCKS or tag in CLOSES or tag == "p" else frozenset())
                continue
            if tag in RAW:
                end = _END[tag].search(html, at, last)
                at = end.end() if end else size
                continue
            if tag == "br" or tag == "wbr":
                if tag == "br" and not self.out[self.stack[-1]]:
                    self.buffer.append(" ")
                continue
            if tag in BLOCKS:
                self._flush()
                self._close(("p",), WALLS)
            if tag in VOID:
                continue
            if tag in CLOSES:
                self._close(CLOSES[tag], frozenset(("ul", "ol", "dl", "table")))
            above = self.stack[-1]
            out = self.out[above] or _no_article(tag, attributes)
            if tag == "header" and not self.out[above] and self._nearest(ARTICLE):
                out = False  # only its headings stay, see main_text
            self.tag.append(tag)
            self.parent.append(above)
            self.out.append(out)
            self.holder.append(len(self.tag) - 1 if tag in BLOCKS else self.holder[above])
            if not attributes.rstrip().endswith("/") or tag in BLOCKS:
                self.open[tag].append(len(self.stack))
                self.stack.append(len(self.tag) - 1)
        self._flush()

    def main_text(self) -> str:
        tag, parent, n = self.tag, self.parent, len(self.tag)
        in_header = [False] * n
        for i in range(1, n):
            in_header[i] = in_header[parent[i]] or tag[i] == "header"
        blocks = [b for b in self.blocks if not in_header[b[0]] or tag[b[0]] in HEADINGS]
        points, chars, links = [0.0] * n, [0] * n, [0] * n
        for i, text, linked in blocks:
            chars[i] += len(text)
            links[i] += min(linked, len(text))
            if tag[i] in HEADINGS or linked > len(text) / 2:
                continue
            gain = 1 + text.count(",") + text.count("，") + text.count("、") + min(len(text) / 100, 3)
            at, share = (parent[i] if tag[i] in ("p", "pre", "li", "dd", "blockquote", "td") and parent[i] >= 0 else i), 1
            while at >= 0 and share <= 12:
                points[at] += gain / share
                at, share = parent[at], share * 2 if share < 2 else share + 4
        for i in range(n - 1, 0, -1):
            chars[parent[i]] += chars[i]
            links[parent[i]] += links[i]
        score = [p * (1 - k / c) if c else 0.0 for p, k, c in zip(points, links, chars, strict=True)]
        best = max(range(n), key=lambda i: (score[i], -i))
        if not score[best]:
            return "\n".join(text for _, text, linked in blocks if linked <= len(text) / 2)
        at = best
        while at >= 0 and tag[at] not in ARTICLE:
            at = parent[at]
        top = at if at >= 0 else best
        keep = [False] * n
        menu = [tag[i] in ("ul", "ol", "div", "p") and chars[i] > 0 and links[i] > 0.8 * chars[i] and i != top for i in range(n)]
        for i in range(n):
            beside = parent[i] == parent[top] and i != top and parent[i] >= 0
            density = links[i] / chars[i] if chars[i] else 0.0
            near = beside and chars[i] > 0 and (
                score[i] >= max(10, 0.2 * score[best]) or (tag[i] in HEADINGS and density < 0.25)
                or (tag[i] == "p" and density < 0.25 and tag[top] not in ARTICLE))
            keep[i] = (i == top or near or (parent[i] >= 0 and keep[parent[i]])) and not (menu[i] and tag[i] in ("ul", "ol"))
        return "\n".join(text for i, text, _ in blocks if keep[i])


def main_text(html: str) -> str:
    return _Page(html).main_text() if html else ""


def extract(pages: DataFrame, html_col: str = "html") -> DataFrame:
    """``pages`` with their main text in ``main_text`` (or a longer name if they have that)."""

    @F.pandas_udf("string")
    def run(html: pd.Series) -> pd.Series:
        return html.map(main_text)

    return pages.select(*[F.col(f"`{c}`") for c in pages.columns], run(text_of(html_col)).alias(free_name(pages, "main_text")))
