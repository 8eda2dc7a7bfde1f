"""Main text of web pages by line-block distribution.

**Method.**  Markup is stripped so that every block (paragraph, heading, list item, cell ...) becomes one
line.  The text lengths of the lines are summed over sliding windows of ``window`` lines; where
the sums rise from nothing is a surge point, where they fall back to nothing a dive point, and the text between the
two is kept.  Scripts, styles, form controls, comments and elements that are navigation, headers, footers or sidebars by name are markup too: they leave no line.

**Marked elements** are those whose class, id or role has a *whole* token for navigation, sidebars, notices, adverts, reader comments and the like (``sidebar``,
``sidebar-left``, but not ``has-sidebar`` or ``comments-open``), and forms.  Their lines go too, unless mass and place speak against it: a marked
element that holds more than half of the page's text is the page's wrapper, not a side element, when it holds the page's ``h1`` or an ``article`` or ``main``, or when
the unmarked lines outside come to less than ``share`` of it (for reader comments: to nothing).  A line of
links alone and a copyright line weigh nothing: they open no surge and are left out at its ends, but inside the text they stay.

A page's heaviest stretch and every stretch of at least ``share`` of it are the main text.  Where ``article`` or ``main``
elements hold most of the page's weight, or no stretch of the lines outside them outweighs them (more than their weight in ``window``
or more lines with weight, or more than ``ARTICLE`` times their weight in any number of lines), the main text is instead every line
of the elements that have weight, link-only lines included, and nothing else.
"""

from __future__ import annotations

import re
from collections import Counter
from html import unescape

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from seasonlens.llm.common import map_texts

# Lines of a window, and the weight a second stretch needs against the heaviest one.
WINDOW = 3
SHARE = 0.25
# What a stretch of few lines needs against the page's articles.
ARTICLE = 3

# Elements by what they do to the text.
DROPPED_RAW = ("script", "style", "noscript", "template", "iframe", "svg", "math", "object", "textarea", "title")
DROPPED = {"head", "nav", "footer", "aside", "button", "select", "dialog", "menu", "canvas", "audio", "video", "label", "input"}
BLOCKS = {"address", "article", "blockquote", "body", "caption", "center", "dd", "details", "div", "dl", "dt", "figcaption", "figure", "h1", "h2",
          "h3", "h4", "h5", "h6", "header", "hr", "html", "li", "main", "ol", "p", "pre", "section", "summary", "table", "tbody", "td", "tfoot",
          "th", "thead", "tr", "ul", "hgroup", "search", "form", "fieldset"} | DROPPED
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
# An opening block element ends an open paragraph; these end an open one of their own kind as well.
SELF_ENDING = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}}
# Words of class, id and role that mark what is not main text.
SIDE_WORDS = {"ad", "ads", "advert", "adverts", "advertisement", "advertising", "sponsor", "sponsored", "promo", "promotion", "banner", "sidebar",
              "menu", "nav", "navbar", "navigation", "breadcrumb", "breadcrumbs", "footer", "masthead", "cookie", "cookies", "consent", "gdpr",
              "notice", "notification", "alert", "popup", "modal", "overlay", "newsletter", "subscribe", "subscription", "signup", "login",
              "comment", "comments", "commentlist", "disqus", "respond", "reply", "replies", "share", "sharing", "social", "related",
              "recommended", "widget", "toolbar", "pagination", "pager", "search", "copyright", "complementary", "contentinfo", "dialog", "form", "hidden"}
COMMENT_WORDS = {"comment", "comments", "commentlist", "disqus", "respond", "reply", "replies"}
# Words that may stand beside such a word in one token.
PLACE_WORDS = {"left", "right", "top", "bottom", "main", "site", "page", "list", "box", "block", "wrap", "wrapper", "container", "section", "area", "bar",
               "item", "items", "link", "links", "button", "buttons", "slot", "unit", "post", "posts", "inner", "outer", "primary", "secondary", "global", "panel",
               "content", "form", "nav", "media", "by", "icons", "group"}
ARTICLE_SIDE_WORDS = {"ad", "ads", "advert", "advertisement", "comment", "comments", "reply", "promo", "sponsored", "related"}

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(?P<raw>" + "|".join(DROPPED_RAW) + r")(?=[\s/>])[^<>]*>.*?(?:</(?P=raw)\s*[^>]*>|\Z)"
    r"""|<(?P<close>/?)(?P<name>[A-Za-z][^\s/>]*)(?P<attributes>(?:[^<>"']|"[^"]*"|'[^']*')*+)>""", re.S | re.I)
MARKS = re.compile(r"""\b(class|id|role|hidden|aria-hidden)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.I)
MARK_PARTS = re.compile(r"[^a-z]+")
COPYRIGHT = re.compile(r"\s*(?:©|\(c\)\s|copyright\b)", re.I)


def _side_token(token: str, words: set[str]) -> bool:
    """Whether one class, id or role token names a side element: such a word alone, or beside words of place and shape only."""
    parts = [p for p in MARK_PARTS.split(token) if p]
    return not words.isdisjoint(parts) and all(p in words or p in PLACE_WORDS for p in parts)


def _dropped(name: str, attributes: str, in_article: bool) -> bool:
    """Whether an element goes whatever it holds."""
    if name in DROPPED or name == "header" and not in_article:
        return True
    if not attributes or name in ("html", "body", "article", "main"):
        return False
    return any(m[1].lower() == "hidden" or m[1].lower() == "aria-hidden" and (m[2] or m[3] or m[4] or "").lower() == "true" for m in MARKS.finditer(attributes))


def _marked(name: str, attributes: str) -> str:
    """"side", "comments" or "": what the element's tokens (or its being a form) say."""
    if name in ("html", "body"):
        return ""
    found = "side" if name == "form" else ""
    words = ARTICLE_SIDE_WORDS if name in ("article", "main") else SIDE_WORDS
    for m in MARKS.finditer(attributes) if attributes else ():
        if m[1].lower() in ("class", "id", "role"):
            tokens = [t for t in (m[2] or m[3] or m[4] or "").lower().split() if _side_token(t, words)]
            if any(not COMMENT_WORDS.isdisjoint(MARK_PARTS.split(t)) for t in tokens):
                return "comments"
            found = found or ("side" if tokens else "")
    return found


class _Lines:
    """Lines of a page with their weights."""

    def __init__(self) -> None:
        self.text: list[str] = []
        self.weight: list[int] = []
        self.inside: list[int] = []  # number of the outermost article or main element around the line, from 1
        self.mark: list[int] = []  # number of the innermost marked element around the line; 0 outside all
        self.marks: list[list] = [[0, "", False]]  # of each marked element: the one around it, its kind, whether it holds the page's heading or an article
        self.parts: list[str] = []
        self.linked = 0

    def add(self, raw: str, in_link: bool) -> None:
        self.parts.append(raw)
        if in_link:
            self.linked += len("".join(unescape(raw).split()))

    def end(self, inside: int, mark: int) -> None:
        if self.parts:
            line = " ".join(unescape("".join(self.parts)).split())
            if line:
                plain = len(line.replace(" ", "")) - self.linked
                self.text.append(line)
                self.weight.append(0 if plain <= 0 or COPYRIGHT.match(line) else len(line))
                self.inside.append(inside)
                self.mark.append(mark)
            self.parts, self.linked = [], 0

    def hold(self, mark: int) -> None:
        """A heading or article stands inside ``mark`` and the marked elements around it."""
        while mark and not self.marks[mark][2]:
            self.marks[mark][2] = True
            mark = self.marks[mark][0]

    def without_sides(self, share: float) -> None:
        """Takes out the lines of marked elements, but for those that mass and place show to be the page's wrappers."""
        if len(self.marks) == 1:
            return
        mass = [0] * len(self.marks)
        for weight, mark in zip(self.weight, self.mark, strict=True):
            mass[mark] += weight
        for mark in range(len(mass) - 1, 0, -1):  # an element comes after the one around it
            if self.marks[mark][0]:
                mass[self.marks[mark][0]] += mass[mark]
        unmarked = mass[0]
        total = unmarked + sum(m for m, (around, _, _) in zip(mass[1:], self.marks[1:], strict=True) if not around)
        side = [False]
        for m, (around, kind, holds) in zip(mass[1:], self.marks[1:], strict=True):
            wrapper = 2 * m > total and (holds and kind == "side" or (unmarked < share * m if kind == "side" else not unmarked))
            side.append(side[around] or not wrapper)
        keep = [i for i, mark in enumerate(self.mark) if not side[mark]]
        self.text, self.weight, self.inside, self.mark = ([of[i] for i in keep] for of in (self.text, self.weight, self.inside, self.mark))


def lines_of(html: str, share: float = SHARE) -> _Lines:
    """Strips the markup: one line a block."""
    lines = _Lines()
    # (element, it or one around it is dropped, number of the outermost article, and of the innermost marked element, among it and those around it)
    stack: list[tuple[str, bool, int, int]] = []
    opened: Counter[str] = Counter()  # open elements by name: what is not open is not looked for
    dropped = in_link = False
    at = article = articles = mark = 0

    def close_from(i: int) -> None:
        opened.subtract(e[0] for e in stack[i:])
        del stack[i:]

    for m in TOKEN.finditer(html):
        if not dropped and m.start() > at:
            lines.add(html[at:m.start()], in_link)
        at = m.end()
        name = m["name"]
        if name is None:
            continue
        name = name.lower()
        if name in BLOCKS:
            lines.end(article, mark)
            in_link = False
        elif name == "br" or name == "img":
            lines.parts.append(" ")
        if m["close"]:
            if name == "a":
                in_link = False
            for i in range(len(stack) - 1, -1, -1) if opened[name] > 0 else ():
                if stack[i][0] == name:
                    close_from(i)
                    break
                if stack[i][0] in BLOCKS and name not in BLOCKS:
                    break  # an inline end tag does not close a block
        else:
            ends = SELF_ENDING.get(name, set()) | {"p"}
            if name in BLOCKS and any(opened[e] > 0 for e in ends):
                for i in range(len(stack) - 1, -1, -1):
                    if stack[i][0] in ends:
                        close_from(i)
                        break
                    if stack[i][0] in BLOCKS:
                        break
            outer_dropped, outer_article, outer_mark = stack[-1][1:] if stack else (False, 0, 0)
            if name not in VOID and not m["attributes"].endswith("/"):
                own = name in ("article", "main") or "role" in m["attributes"] and 'role="main"' in m["attributes"]
                side = outer_dropped or _dropped(name, m["attributes"], bool(outer_article))
                if not side and (kind := _marked(name, m["attributes"])):
                    lines.marks.append([outer_mark, kind, False])
                    outer_mark = len(lines.marks) - 1
                elif not side and (own or name == "h1"):
                    lines.hold(outer_mark)
                if own and not side and not outer_article:
                    articles += 1
                    outer_article = articles
                stack.append((name, side, outer_article, outer_mark))
                opened[name] += 1
                in_link = in_link or name == "a"
        dropped, article, mark = stack[-1][1:] if stack else (False, 0, 0)
    if not dropped and at < len(html):
        lines.add(html[at:], in_link)
    lines.end(article, mark)
    lines.without_sides(share)
    return lines


def stretches(weight: np.ndarray, window: int = WINDOW) -> list[tuple[int, int]]:
    """(surge, dive) of every stretch: first and last line with weight between two points where window sums are nothing."""
    heavy = np.flatnonzero(weight)
    if not len(heavy):
        return []
    # a window sum is nothing between two heavy lines exactly when window or more lines without weight lie there
    cuts = np.flatnonzero(np.diff(heavy) > window) + 1
    return [(int(part[0]), int(part[-1]) + 1) for part in np.split(heavy, cuts)]


def main_text(html: str, window: int = WINDOW, share: float = SHARE) -> str:
    """Main text of one page: blocks in page order, joined by an empty line."""
    lines = lines_of(html, share)
    weight = np.array(lines.weight, dtype=np.int64)
    inside = np.array(lines.inside, dtype=np.int64)
    if _articles_decide(weight, inside, window):
        return "\n\n".join(lines.text[i] for i in np.flatnonzero((inside > 0) & np.isin(inside, inside[weight > 0])))
    found = stretches(weight, window)
    mass = [int(weight[a:b].sum()) for a, b in found]
    return "\n\n".join(lines.text[i] for (a, b), w in zip(found, mass, strict=True) if w >= share * max(mass) for i in range(a, b))


def _articles_decide(weight: np.ndarray, inside: np.ndarray, window: int) -> bool:
    """Whether the lines of articles are the main text whatever the other lines are."""
    held = int(weight[inside > 0].sum())
    if 2 * held >= weight.sum():
        return held > 0
    outside = np.where(inside > 0, 0, weight)
    for a, b in stretches(outside, window):
        mass = int(outside[a:b].sum())
        if mass > ARTICLE * held or mass > held and np.count_nonzero(outside[a:b]) >= window:
            return False
    return held > 0


def extract(pages: DataFrame, id_col: str = "page_id", html_col: str = "html", url_col: str | None = "url") -> DataFrame:
    """(id, url, text, n_chars): the main text of every page and its length in code points.

    A NULL or empty page, or one without main text, has the empty text; a very long page is read whole; a NULL id or url stays; repeated rows give repeated
    rows; an empty table gives no rows; other columns are not read.  One narrow pass, no shuffle.
    """
    key = F.struct(F.col(f"`{id_col}`").alias("id"), (F.col(f"`{url_col}`") if url_col else F.lit(None).cast("string")).alias("url"))
    rows = pages.select(key.alias("key"), F.coalesce(F.col(f"`{html_col}`"), F.lit("")).alias("text"))

    def each(html: str):
        text = main_text(html)
        yield text, len(text)

    out = map_texts(rows, "key", [T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())], lambda: each)
    columns = [F.col("key.id").alias(id_col), *([F.col("key.url").alias(url_col)] if url_col else []), "text", "n_chars"]
    return out.select(*columns)
