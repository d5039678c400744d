"""Main text of web pages by two passes of block rules.

A page is cut into blocks at block-level tags. The first pass decides a block by its link density, its length and its
density of stop words: it is boilerplate where most of its letters are links, or where it stands in an element made
for menus, headers, footers, sidebars, forms, adverts, notices or comments; it is content if it is long and has the stop words
of running text. What is left, mostly short blocks, is ambiguous: in the second pass it inherits the label of the nearest
decided block of its section (an article or main element, or what is outside of them), of the one before at equal distance; blocks
in elements made for boilerplate don't count.
Without decided blocks it is content in an article or main element, and boilerplate outside.

An element is made for boilerplate by its tag, or by a class, id or role of such a word without a word of state beside it
(`sidebar`, `comment-list`; not `has-sidebar`, `no-comments`, `share-enabled`).

Defined results: null or empty html gives an empty text and 0 characters; unclosed and stray tags are
tolerated; character references without a semicolon are read as browsers do; a `br` is white space;
repeated rows are rows. Other columns aren't read, so clashing names do no harm. Pages are read whole.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import map_arrow, table

#: HTML's element names by their role here.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark nobr q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
HIDDEN = frozenset("head title script style noscript template iframe object svg canvas audio video map datalist".split())
BOILERPLATE = frozenset("nav header footer aside form button select textarea menu dialog fieldset".split())
CONTENT = frozenset("article main".split())
#: Words of class, id and role attributes that mark what is not the main text.
MARKS = frozenset(
    "ad ads advert adverts advertisement advertising banner sponsor sponsored promo promoted popup modal cookie cookies consent gdpr notice notices alert "
    "nav navbar navigation menu breadcrumb breadcrumbs sidebar aside related recommended share sharing social footer header masthead contentinfo complementary "
    "comment comments disqus reply replies newsletter subscribe subscription signup login search widget toolbar pagination pager copyright".split()
)
#: Frequent words of running text, by language.
STOP_WORDS = frozenset(
    "the of and to in a is that for it with as was on be by at from this are or an have not but they which you we his her has had "
    "le la les de des du et un une est que qui dans pour pas sur avec au par il elle ce ne se plus "
    "der die das und ist von den dem mit im zu auf für nicht ein eine sich des als auch es an werden aus er hat dass sie nach "
    "el los las y en un una que es por con para del se no su al lo como más".split()
)
#: Words that make a class a state of the page, not the part that it names.
STATES = frozenset("has have is no not non with without hide hides hidden show shows enable enabled disable disabled on off open opened closed collapsed below above after before".split())
LINK_DENSITY, LONG, STOP_DENSITY = 0.5, 70, 0.15
SPACE = re.compile(r"\s+")
WORDS = re.compile(r"\w+")
SPLIT = re.compile(r"[^a-z]+")


@dataclass
class Block:
    text: str
    linked: int  # characters inside links
    boilerplate: bool
    section: int  # a number for each article or main element; 0 outside


def made_for_boilerplate(attrs: list[tuple[str, str | None]]) -> bool:
    for name, value in attrs:
        if name in ("class", "id", "role") and value:
            for token in value.lower().split():
                words = SPLIT.split(token)
                if not MARKS.isdisjoint(words) and STATES.isdisjoint(words):
                    return True
    return False


class Blocks(HTMLParser):
    """Cuts a page into blocks."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.found: list[Block] = []
        self.open: list[tuple[str, bool, bool, int]] = []  # tag, hidden, boilerplate, section; each with what encloses it
        self.parts: list[str] = []
        self.linked = 0
        self.links = 0
        self.sections = 0
        self.at = (False, False, 0)

    def parse_html_declaration(self, i: int) -> int:
        # Marked sections aren't HTML; browsers read them as comments.
        return self.parse_bogus_comment(i) if self.rawdata.startswith("<![", i) else super().parse_html_declaration(i)

    def flush(self) -> None:
        text = SPACE.sub(" ", "".join(self.parts)).strip()
        if text:
            self.found.append(Block(text, self.linked, self.at[1], self.at[2]))
        self.parts, self.linked = [], 0

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag == "br":
            self.parts.append(" ")
        if tag not in INLINE:
            self.flush()
        if tag in VOID:
            return
        hidden, boilerplate, section = self.at
        hidden |= tag in HIDDEN
        # A header inside an article is the article's own.
        boilerplate |= tag in BOILERPLATE and not (tag == "header" and section)
        if attrs and tag not in ("html", "body"):
            boilerplate |= tag not in CONTENT and made_for_boilerplate(attrs)
            hidden |= any(name == "hidden" or (name == "aria-hidden" and value == "true") for name, value in attrs)
        if not section and (tag in CONTENT or ("role", "main") in attrs):
            self.sections += 1
            section = self.sections
        self.open.append((tag, *self.at))
        changed = (hidden, boilerplate, section) != self.at
        if changed:
            self.flush()
        self.at = (hidden, boilerplate, section)
        self.links += tag == "a"

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def handle_endtag(self, tag: str) -> None:
        if tag not in INLINE:
            self.flush()
        for k in range(len(self.open) - 1, -1, -1):
            if self.open[k][0] == tag:
                if self.open[k][1:] != self.at:
                    self.flush()
                self.links -= sum(x[0] == "a" for x in self.open[k:])
                self.at = self.open[k][1:]
                del self.open[k:]
                break
            # An inline end tag doesn't close the blocks around it.
            if tag in INLINE and self.open[k][0] not in INLINE:
                break

    def handle_data(self, data: str) -> None:
        if not self.at[0]:
            self.parts.append(data)
            if self.links:
                self.linked += len(data)


def blocks(html: str) -> list[Block]:
    parser = Blocks()
    parser.feed(html)
    parser.close()
    parser.flush()
    return parser.found


def decided(block: Block) -> bool | None:
    """First pass: True for content, False for boilerplate, None for an ambiguous block."""
    if block.boilerplate or block.linked > LINK_DENSITY * len(block.text):
        return False
    words = WORDS.findall(block.text.lower())
    if len(block.text) >= LONG and sum(w in STOP_WORDS for w in words) >= STOP_DENSITY * len(words):
        return True
    return None


def nearest(labels: list[bool | None]) -> list[bool | None]:
    """For each place the label of the nearest decided one, of the one before at equal distance."""
    before, after, last = [], [], None
    for k, label in enumerate(labels):
        last = k if label is not None else last
        before.append(last)
    last = None
    for k in range(len(labels) - 1, -1, -1):
        last = k if labels[k] is not None else last
        after.append(last)
    out = []
    for k, (a, b) in enumerate(zip(before, reversed(after))):
        near = a if b is None or (a is not None and k - a <= b - k) else b
        out.append(None if near is None else labels[near])
    return out


def kept(found: list[Block]) -> list[bool]:
    """Second pass: whether each block is main text."""
    labels = [decided(b) for b in found]
    sections: dict[int, list[int]] = {}
    for k, block in enumerate(found):
        if not block.boilerplate:  # a menu or an advert says nothing of its neighbours
            sections.setdefault(block.section, []).append(k)
    for section, members in sections.items():
        for k, label in zip(members, nearest([labels[k] for k in members])):
            labels[k] = section > 0 if label is None else label
    return [label is True for label in labels]


def main_text(html: str | None) -> str:
    found = blocks(html or "")
    return "\n\n".join(block.text for block, keep in zip(found, kept(found)) if keep)


def extract(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """(page_id, url, text, n_chars), a row a page."""
    pages = pages.select(F.col(page_id).alias("page_id"), F.col(url).alias("url"), F.col(html).cast("string").alias("html"))
    schema = T.StructType([*pages.schema.fields[:2], T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                part = batch.slice(start, 256)
                texts = [main_text(x.as_py()) for x in part.column(2)]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array([len(x) for x in texts], pa.int64())], names=schema.names)

    return map_arrow(pages, run, schema)


def op7_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))
