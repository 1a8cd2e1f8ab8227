"""Main text of web pages by composite text density.

Every element has a density: its characters per tag, lowered as links take
more of its characters and tags.  The densities of an element's children are
summed; the element with the greatest sum is the heart of the page.  The least
density on the path from the body down to it is the threshold: going down from
the body, an element is kept when its density reaches the threshold, and the
element with the greatest sum below it is taken.

Scripts, styles, form fields and the like are never text.  Menus, page headers
and footers, side bars, notices, adverts, forms and reader comments are left
out before densities are taken, by tag, role and whole names in class or id,
unless they are part of the article by their content.  What they hold outside
links decides: one that holds articles or main parts with more text than those
outside of marked elements have, or most of the page's text (beside no article
or main part with text), is judged by density like any other, and so is the
header of an article.

Null html counts as empty and gives an empty text; markup that is never
closed, or closed in the wrong order, is closed where a browser would (for
paragraphs, list items and table cells) or with its parent; a page of any
length takes time in proportion to its tags.
"""

from __future__ import annotations

import html
import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cartflow.llm.common import map_batches, texts_of

OPENS = re.compile(r"<(?:(!--)|([!?])|(/?)([a-zA-Z][^\s/>]*+))")
STOPS = re.compile("[>\"']")
#: Characters that may be looked at in vain for the ends of tags, per character of the page.
IN_VAIN = 8
ATTRIBUTE = re.compile(r"\b(class|id|role|hidden|aria-hidden)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
# Element names of HTML.
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
RAW = {"script", "style", "textarea", "title", "xmp", "iframe", "noembed", "noframes"}
LEFT_OUT = {"head", "script", "style", "noscript", "template", "iframe", "object", "svg", "canvas", "button", "select", "textarea", "input",
            "title", "xmp", "noembed", "noframes"}
#: Elements that are left out if their content agrees.
ASIDE = {"nav", "header", "footer", "aside", "form", "menu", "dialog"}
BLOCK = {"address", "article", "blockquote", "body", "center", "dd", "details", "div", "dl", "dt", "fieldset", "figcaption", "figure",
         "h1", "h2", "h3", "h4", "h5", "h6", "hgroup", "hr", "html", "li", "main", "ol", "p", "pre", "section", "summary", "table",
         "tbody", "td", "tfoot", "th", "thead", "tr", "ul", "caption", "header", "footer", "nav", "aside", "form"}
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"},
          "option": {"option"}, "tbody": {"tr", "td", "th", "thead"}}
FENCE = {"ul", "ol", "dl", "table", "body", "html"}  # an implied end doesn't reach out of these
#: Names in class or id that mark what isn't the article.
MARKS = {"ad", "ads", "advert", "adverts", "advertisement", "sponsor", "sponsored", "promo", "banner", "nav", "navbar", "navigation", "menu",
         "breadcrumb", "breadcrumbs", "sidebar", "header", "footer", "comment", "comments", "disqus", "cookie", "cookies", "consent",
         "notice", "popup", "modal", "newsletter", "subscribe", "share", "sharing", "social", "related", "widget", "pagination", "pager"}
ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "alert", "dialog", "menu", "menubar"}
#: The share of the page's characters outside links from which a marked element isn't left out for its mark.
MOST = 0.5


def tokens(source: str) -> Iterator[tuple[int, int, str | None, bool, str]]:
    """``(start, end, tag, closing, attributes)`` of every tag; the tag is None for comments and declarations.

    A ``>`` in quotes doesn't end a tag; what never ends is text.  A page that makes
    this look ahead in vain too often has its tags end at the next ``>``.
    """
    size, last, at, vain = len(source), source.rfind(">"), 0, 0
    while m := OPENS.search(source, at):
        start, here = m.start(), m.end()
        if m[1]:
            end = source.find("-->", here)
            at = end + 3 if end >= 0 else size
            yield start, at, None, False, ""
            continue
        if start > last:
            return
        if m[2]:
            at = source.find(">", here) + 1
            yield start, at, None, False, ""
            continue
        end, stop = here, None
        while vain <= IN_VAIN * size and end >= 0 and (stop := STOPS.search(source, end)) and stop[0] != ">":
            end = source.find(stop[0], stop.end())
            end += end >= 0
        if vain > IN_VAIN * size:
            end = source.find(">", here)
        elif end < 0 or not stop:
            vain += size - start
            at = start + 1
            continue
        else:
            end = stop.start()
        if end < 0:
            return
        at = end + 1
        yield start, at, m[4].lower(), bool(m[3]), source[here:end]


def is_marked(tag: str, attributes: str) -> bool:
    """Whether tag, role or names say that an element isn't the article; what it holds can say otherwise."""
    if tag in ASIDE:
        return True
    if not attributes or tag in ("html", "body", "article", "main"):
        return False
    for name, *values in ATTRIBUTE.findall(attributes):
        value, name = "".join(values).lower(), name.lower()
        if name == "role" and value in ROLES or name == "aria-hidden" and value == "true":
            return True
        if name in ("class", "id") and not MARKS.isdisjoint(value.split()):
            return True
    return False


class Page:
    """The elements of a page in the order they open, and its text with the element each part belongs to."""

    def __init__(self, source: str):
        self.tag, self.parent, self.out, self.marked = ["html"], [-1], [False], [False]
        self.part = [False]  # articles and main parts, but for readers' comments marked up as articles
        self.items: list[tuple[int, str | None]] = []  # text of an element, or the border of a block
        stack, at, size = [0], 0, len(source)
        # places in the stack of the open elements of each name, of those that hold stray ends in, and of those that hold implied ends in
        self.open: dict[str, list[int]] = {}
        self.holds, self.bars = [0], [0]
        body, skip = None, 0
        for start, end, tag, closing, attributes in tokens(source):
            if start < skip:
                continue
            if start > at:
                self.items.append((stack[-1], source[at:start]))
            at = end
            if tag is None:
                continue
            if closing:
                self._close(tag, stack)
                continue
            if tag in ("html", "body"):
                if tag == "html" or body is not None:
                    continue
            if tag in CLOSES:
                self._imply(CLOSES[tag], stack)
            elif tag in BLOCK:
                self._imply({"p"}, stack)
            node = len(self.tag)
            self.tag.append(tag)
            self.parent.append(stack[-1])
            self.out.append(self.out[stack[-1]] or tag in LEFT_OUT)
            self.marked.append(is_marked(tag, attributes))
            self.part.append(tag in ("article", "main") and not is_marked("", attributes))
            if tag == "body":
                body = node
            if tag in BLOCK:
                self.items.append((stack[-1], None))
            if tag == "br":
                self.items.append((node, " "))
            if tag in RAW:
                ends = re.compile(rf"</{tag}(?=[\s/>])[^>]*>?", re.I).search(source, at)
                at = skip = ends.end() if ends else size
            elif tag not in VOID and not attributes.endswith("/"):
                self._push(node, stack)
        if at < size:
            self.items.append((stack[-1], source[at:]))
        self.body = body or 0
        self._leave_out()

    def _leave_out(self) -> None:
        """Marked elements go with all they hold, but for those that the page's text is in, and headers of articles."""
        n = len(self.tag)
        plain, held, free = [0] * n, [0] * n, 0
        in_link, in_part, in_mark = [False] * n, [False] * n, [False] * n
        for i in range(1, n):
            up = self.parent[i]
            in_link[i] = self.tag[i] == "a" or in_link[up]
            in_part[i] = self.part[i] or in_part[up]
            in_mark[i] = self.marked[i] and not (self.tag[i] == "header" and in_part[i]) or in_mark[up]
        for node, text in self.items:
            if text and not self.out[node] and not in_link[node]:
                size = len(text) - sum(map(text.count, " \n\t\r"))
                plain[node] += size
                free += size if in_part[node] and not in_mark[node] else 0
        for i in range(n - 1, 0, -1):  # text, and what of it is in articles and main parts below
            up = self.parent[i]
            plain[up] += plain[i]
            held[up] += plain[i] if self.part[i] else held[i]
        for i in range(1, n):
            own = held[i] > free or plain[i] > MOST * plain[0] and (in_part[i] or not free) or self.tag[i] == "header" and in_part[i]
            self.out[i] = self.out[i] or self.out[self.parent[i]] or self.marked[i] and not own

    def _push(self, node: int, stack: list[int]) -> None:
        tag = self.tag[node]
        self.open.setdefault(tag, []).append(len(stack))
        if tag in ("table", "article", "body"):
            self.holds.append(len(stack))
        if tag in FENCE or tag in BLOCK and tag not in ("td", "th", "tr"):
            self.bars.append(len(stack))
        stack.append(node)

    def _pop_to(self, place: int, stack: list[int]) -> None:
        while len(stack) > place:
            node = stack.pop()
            self.open[self.tag[node]].pop()
            for border in (self.holds, self.bars):
                if border[-1] == len(stack):
                    border.pop()
            if self.tag[node] in BLOCK:
                self.items.append((node, None))

    def _close(self, tag: str, stack: list[int]) -> None:
        """Closes the innermost open element of that name; the end of an inline element doesn't reach out of tables and articles."""
        if places := self.open.get(tag):
            if tag in BLOCK or places[-1] >= self.holds[-1]:
                self._pop_to(places[-1], stack)

    def _imply(self, tags: set[str], stack: list[int]) -> None:
        place = max((self.open[t][-1] for t in tags if self.open.get(t)), default=0)
        if place and place >= self.bars[-1]:
            self._pop_to(place, stack)

    def _container(self, node: int) -> int:
        """The article or main part around an element, else the box that holds it: headings stay with their paragraphs."""
        box, i = None, node
        while i != self.body and i > 0:
            if self.tag[i] in ("article", "main"):
                return i
            if box is None and self.tag[i] in ("div", "section", "td"):
                box = i
            i = self.parent[i]
        return self.body if box is None else box

    def text(self) -> str:
        n = len(self.tag)
        chars, links, tags, link_tags = [0] * n, [0] * n, [0] * n, [0] * n
        in_link = [False] * n
        for i in range(1, n):
            in_link[i] = self.tag[i] == "a" or in_link[self.parent[i]]
        items = [(node, text if text is None else html.unescape(text)) for node, text in self.items if not self.out[node]]
        for node, text in items:
            if text:
                size = len(text) - text.count(" ") - text.count("\n")
                chars[node] += size
                links[node] += size if in_link[node] else 0
        last = list(range(n))
        for i in range(n - 1, 0, -1):
            up = self.parent[i]
            last[up] = max(last[up], last[i])
            if not self.out[i]:
                chars[up] += chars[i]
                links[up] += links[i]
                tags[up] += tags[i] + 1
                link_tags[up] += link_tags[i] + (self.tag[i] == "a")
        share = links[self.body] / max(chars[self.body], 1)
        density, total = [0.0] * n, [0.0] * n
        for i in range(n):
            if not self.out[i] and chars[i]:
                base = math.log(chars[i] / max(chars[i] - links[i], 1) * links[i] + share * chars[i] + math.e)
                ratio = chars[i] / max(links[i], 1) * max(tags[i], 1) / max(link_tags[i], 1)
                density[i] = chars[i] / max(tags[i], 1) * (math.log(ratio) / math.log(base) if base > 1 and ratio > 0 else math.log(max(ratio, 1) + math.e))
                density[i] = max(density[i], 0.0)
        for i in range(1, n):
            total[self.parent[i]] += density[i]
        heart = max(range(self.body, last[self.body] + 1), key=lambda i: (total[i], density[i], -i))
        heart = self._container(heart)
        threshold, i = density[heart], heart
        while i != self.body and i > 0:
            i = self.parent[i]
            threshold = min(threshold, density[i])
        kept = [False] * n
        i = self.body
        while i <= last[self.body]:
            if density[i] and density[i] >= threshold:  # the greatest sum within it is content; so is all below
                best = max(range(i, last[i] + 1), key=lambda k: (total[k], -k))
                best = i if i == heart or total[best] <= 0 else best
                if i <= heart <= last[i]:
                    best = heart
                for k in range(best, last[best] + 1):
                    kept[k] = True
                i = last[i] + 1
            else:
                i += 1
        blocks: list[str] = []
        part: list[str] = []
        for node, text in items:
            if text is None:
                blocks.append("".join(part))
                part = []
            elif kept[node]:
                part.append(text)
        blocks.append("".join(part))
        clean = [" ".join(b.split()) for b in blocks]
        return "\n".join(b for b in clean if b)


def main_text(source: str) -> str:
    return Page(source).text()


def extract(pages: DataFrame, keep: list[str], html_col: str = "html") -> DataFrame:
    """The named columns with ``text`` and ``n_chars`` (named columns called so give way).  One pass, no shuffle."""
    keep = [c for c in keep if c.lower() not in ("text", "n_chars")]
    def make(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = [main_text(t) for t in texts_of(batch, "_html")]
        return pa.RecordBatch.from_arrays([*[batch.column(c) for c in keep], pa.array(found, pa.string()),
                                           pa.array([len(t) for t in found], pa.int64())], [*keep, "text", "n_chars"])
    schema = ", ".join([*[f"`{c}` {pages.schema[c].dataType.simpleString()}" for c in keep], "text string", "n_chars long"])
    return map_batches(pages, [F.col(html_col).alias("_html"), *[F.col(f"`{c}`") for c in keep]], schema, make)
