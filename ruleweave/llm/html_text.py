"""Main text of web pages by scoring the tree of elements.

A page is read into a tree in one pass.  Every paragraph has points for its length
and its commas; it passes them to its parent, and a falling share to the ancestors
above.  A container's points are discounted by its link density; the best one is
kept, with the siblings that score like it.  Menus, headers, footers, sidebars,
notices, adverts, forms, comments, scripts and styles are known by their elements,
roles and class names, when a name says nothing else, and give no points.  A name that
says other things too (`related-work`) halves the points of what it stands on; that
stays out unless it has paragraphs enough to score.

Defined cases: a null or empty page, and one without text, gives an empty text;
unclosed elements end where their parent ends, paragraphs also where a new block
begins; a page that breaks off keeps what it has; nothing is capped.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TAG = re.compile(r"<!--.*?(?:-->|$)|<(?:!|\?)[^>]*(?:>|$)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*(?:\"|$)|'[^']*(?:'|$))*)(?:>|$)", re.S)
NAMED = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
HIDDEN = re.compile(r"(?:^|\s)hidden(?:[\s=]|$)|aria-hidden\s*=\s*[\"']?true|display\s*:\s*none", re.I)
PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
#: Fixed values of the HTML standard.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes noscript template".split())
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
CLOSES = {"li": frozenset(["li"]), "dt": frozenset(["dt", "dd"]), "dd": frozenset(["dt", "dd"]), "tr": frozenset(["tr", "td", "th"]), "td": frozenset(["td", "th"]), "th": frozenset(["td", "th"]), "option": frozenset(["option"])}
SCOPE = frozenset("ul ol dl table div article section main body".split())
LEAF = frozenset("p li td th pre h1 h2 h3 h4 h5 h6 blockquote dd dt figcaption".split())
#: What is not the article.
JUNK_TAGS = frozenset("nav footer aside form button select option fieldset menu dialog object canvas svg head".split())
JUNK_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert form menu menubar".split())
JUNK_NAMES = frozenset("ad ads adbox advert adverts advertisement advertising adsense banner breadcrumb breadcrumbs comment comments commentlist consent cookie cookies disqus footer gdpr masthead menu menus modal nav navbar navigation newsletter notice notices pager pagination popup promo promotion related replies respond share sharing sidebar sidebars signup social sponsor sponsored subscribe subscription toolbar widget widgets".split())
#: Words of names that say nothing of what an element holds.
PLAIN_NAMES = frozenset("area bar block body bottom box btn button buttons col column container content group head icon inner item items left link links list main of outer page panel post right row section site static sticky text the thread title top wrap wrapper".split())
ARTICLE = frozenset(["article", "main"])
DENSE = 0.6
#: Points below which a doubtful part stays out: about two paragraphs of a few lines.
DOUBTFUL = 6.0
NO, MAYBE, YES = 0, 1, 2


def _junk(tag: str, attributes: str, inside: bool) -> int:
    """Whether an element is no part of the article: NO, MAYBE or YES."""
    if tag in JUNK_TAGS or (tag == "header" and not inside):
        return YES
    if not attributes:
        return NO
    found = YES if HIDDEN.search(attributes) else NO
    for name, a, b, c in NAMED.findall(attributes):
        value = a or b or c
        if name.lower() == "role":
            if value.lower() in JUNK_ROLES:
                return YES
        elif tag not in ("body", "html", "article", "main"):
            for one in value.split():
                words = {w.lower() for w in PART.findall(one)} - PLAIN_NAMES
                junk = words & JUNK_NAMES or ("header" in words and not inside and {"header"})
                if junk:
                    found = max(found, YES if words <= junk else MAYBE)
    return found


class Page:
    """Elements in page order (parents before children) and the blocks of text in them."""

    def __init__(self, source: str):
        self.tag, self.parent = ["html"], [0]
        self.junk, self.maybe, self.inside = [False], [False], [False]
        #: (element, text, characters inside links)
        self.blocks: list[tuple[int, str, int]] = []
        self._read(source)

    def _read(self, source: str) -> None:
        open_, links = [0], 0
        text: list[str] = []
        linked = 0

        def flush() -> None:
            nonlocal linked
            if text:
                joined = "".join(text)
                words = " ".join((html.unescape(joined) if "&" in joined else joined).split())
                if words and not self.junk[block()]:
                    self.blocks.append((block(), words, min(linked, len(words))))
                text.clear()
            linked = 0

        def block() -> int:
            for i in reversed(open_):
                if self.tag[i] not in INLINE:
                    return i
            return 0

        def close(at: int) -> None:
            nonlocal links
            for i in open_[at:]:
                links -= self.tag[i] == "a"
            del open_[at:]

        at, end = 0, len(source)
        while at < end:
            m = TAG.search(source, at)
            piece = source[at : m.start()] if m else source[at:]
            if piece:
                text.append(piece)
                if links:
                    linked += len(piece.strip())
            if not m:
                break
            at = m.end()
            name = m[2]
            if not name:
                continue
            name = name.lower()
            inline = name in INLINE
            if not inline:
                flush()
            if m[1]:
                for k in range(len(open_) - 1, 0, -1):
                    if self.tag[open_[k]] == name:
                        close(k)
                        break
                    if inline and self.tag[open_[k]] not in INLINE:
                        break
                continue
            if name == "br":
                text.append(" ")
                continue
            if name in VOID:
                continue
            if name in RAW:
                stop = re.compile(rf"</{re.escape(name)}\s*>", re.I).search(source, at)
                at = stop.end() if stop else end
                continue
            if not inline:
                # an open paragraph, and inline elements in it, end where a block begins
                for k in range(len(open_) - 1, 0, -1):
                    if self.tag[open_[k]] == "p":
                        close(k)
                        break
                    if self.tag[open_[k]] not in INLINE:
                        break
                if name in CLOSES:
                    for k in range(len(open_) - 1, 0, -1):
                        if self.tag[open_[k]] in CLOSES[name]:
                            close(k)
                            break
                        if self.tag[open_[k]] in SCOPE:
                            break
            if m[3].endswith("/") and not inline:
                continue
            up = open_[-1]
            inside = self.inside[up] or name in ARTICLE
            kind = NO if name in ("html", "body") else _junk(name, m[3], self.inside[up])
            self.tag.append(name)
            self.parent.append(up)
            self.inside.append(inside)
            self.junk.append(self.junk[up] or kind == YES)
            self.maybe.append(kind == MAYBE)
            open_.append(len(self.tag) - 1)
            links += name == "a"
        flush()

    def main(self) -> list[str]:
        """The blocks of the best container and of its kept siblings, in page order."""
        n = len(self.tag)
        points, size, linked = [0.0] * n, [0] * n, [0] * n
        for e, t, k in self.blocks:
            size[e] += len(t)
            linked[e] += k
            worth = (1 + t.count(",") + min(len(t) / 100, 10)) * (1 - k / len(t)) * (0.1 if len(t) < 25 else 1)
            up = self.parent[e] if self.tag[e] in LEAF else e
            for level in range(1, 6):
                points[up] += worth / level
                if not up:
                    break
                up = self.parent[up]
        for e in range(n - 1, 0, -1):
            size[self.parent[e]] += size[e]
            linked[self.parent[e]] += linked[e]
        for e in range(n):
            points[e] *= (1 - linked[e] / max(1, size[e])) * (0.5 if self.maybe[e] else 1)
        if not self.blocks:
            return []
        best = max(range(n), key=lambda e: (points[e], -e))
        kept = {best}
        if best:
            bar = max(5.0, 0.2 * points[best])
            kept |= {e for e in range(1, n) if self.parent[e] == self.parent[best] and (points[e] >= bar or self._speaks(e, size, linked))}
        held, lists = [False] * n, [False] * n
        for e in range(n):
            held[e] = e in kept or (e > 0 and held[self.parent[e]])
            dense = self.tag[e] in ("ul", "ol", "dl", "table") and linked[e] > DENSE * size[e]
            lists[e] = dense or (self.maybe[e] and points[e] < DOUBTFUL) or (e > 0 and lists[self.parent[e]])
        return [t for e, t, _ in self.blocks if held[e] and not lists[e]]

    def _speaks(self, e: int, size: list[int], linked: list[int]) -> bool:
        """Whether a sibling is a paragraph or a heading of the article's own."""
        return self.tag[e] in LEAF and not self.junk[e] and size[e] > 0 and linked[e] < 0.3 * size[e]


def main_text(source: str | None) -> str:
    """The article of a page."""
    return " ".join(Page(source).main()) if source else ""


def extract(pages: DataFrame, column: str = "html", keep: tuple[str, ...] = ("page_id", "url")) -> DataFrame:
    """`keep`, text and n_chars of each page."""
    kept = pages.select(*(F.col(c).alias(f"k{i}") for i, c in enumerate(keep)), F.col(column).alias("html"))
    names = [f"k{i}" for i in range(len(keep))]
    schema = ", ".join([*(f"{n} {kept.schema[n].dataType.simpleString()}" for n in names), "text string, n_chars long"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [main_text(x) for x in b.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays([*(b.column(n) for n in names), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], [*names, "text", "n_chars"])

    return kept.mapInArrow(run, schema).select(*(F.col(n).alias(c) for n, c in zip(names, keep, strict=True)), "text", "n_chars")
