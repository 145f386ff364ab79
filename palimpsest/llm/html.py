"""Main text of web pages: blocks classified by their words, and by their neighbours where unsure.

One scan cuts a page into blocks at block-level tags. Pass one decides each block by length, link
density and density of stop words; blocks in elements that surround an article are not main text.
Blocks too short to tell are left open. Pass two gives them the label of their nearest decided
neighbour. Where a page marks an article that holds the larger part of what the rules find, what lies
outside it is not main text; an article that holds less is a teaser, and marks nothing.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Elements that begin and end a block.
BLOCK_TAGS = frozenset("address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead title tr ul".split())
#: Elements whose content is never text of the page.
HIDDEN = frozenset("script style noscript template svg math iframe object canvas audio video select textarea button head title".split())
#: Elements that hold what surrounds the article.
BESIDE = frozenset("nav header footer aside form menu dialog".split())
#: Words of class and id names that mark what surrounds the article.
BESIDE_NAMES = frozenset("ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments consent cookie cookies copyright disclaimer discussion disqus footer form header masthead menu modal nav navbar navigation newsletter notice notices pagination popup promo promoted recommended related reply replies respond search share sharing sidebar signup social sponsor sponsored subscribe subscription toolbar widget".split())
#: Roles that do.
BESIDE_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert menu menubar".split())
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
#: Common words of English, French, German and Spanish.
STOP_WORDS = frozenset(
    "a about all also an and are as at be been but by can for from had has have he her his i if in into is it its more not of on one or our she so than that the their them they this to was we were what when which who will with would you your "
    "au aux avec ce cette ces dans de des du elle en est et il ils la le les leur lui mais ne nous on ont ou par pas plus pour que qui sa se ses son sont sur un une vous "
    "aber als am auch auf aus bei das dass dem den der des die durch ein eine einem einen einer er es für haben hat ich im in ist mit nach nicht noch nur oder sich sie sind so um und von vor war wie wir wird zu zum zur "
    "al como con de del el en entre era es esta este fue ha la las lo los más me mi muy no o para pero por que se ser si sin sobre su sus también un una y ya".split()
)
TAG = re.compile(r"<(/?)([A-Za-z][A-Za-z0-9:-]*)")
#: Elements of running text, which a name must match in full.
RUNNING = frozenset("p h1 h2 h3 h4 h5 h6 li td th tr dt dd blockquote pre figure figcaption span b i em strong a".split())
#: Parts of names of what holds the article beside something else.
HOLDERS = frozenset("with without has no main content body layout".split())
#: First parts of names of an article's own header.
HEADED = frozenset("article content entry page post story title".split())
#: Words that mark reader comments wherever a name has them.
READERS = frozenset("comment comments discussion disqus replies reply respond".split())
#: Ends of sentences.
STOPS = tuple(".!?…。！？:：\"”’»)")
ATTRIBUTE = re.compile(r"(?:^|\s)(class|id|role|hidden|aria-hidden)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?", re.I)
NAME = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
SPACES = re.compile(r"\s+")
HREF = re.compile(r"\bhref\b", re.I)
#: Elements past which an open sibling is not ended.
LIMITS = frozenset("ul ol table article section div main body blockquote nav footer header aside".split())

LONG, SHORT = 140, 40
LINKED, MOSTLY = 0.4, 0.8
STOPS_HIGH, STOPS_LOW, STRANGE = 0.18, 0.08, 0.02


class Block(NamedTuple):
    text: str
    linked: int
    heading: bool
    beside: bool
    inside: bool
    unsure: bool = False


#: What a name says of an element: nothing; beside the article by a part of a longer name, which may err; beside it.
NO, MAYBE, YES = 0, 1, 2


def named_beside(name: str, tag: str, inside: bool) -> int:
    """What a class or id name says: it is taken in full, or by its first or last part. An article's own header has its title."""
    parts = [x.lower() for x in NAME.findall(name)]
    if not parts or parts[-1] in ("header", "masthead") and (inside or len(parts) > 1 and parts[0] in HEADED):
        return NO
    if len(parts) == 1:
        return YES if parts[0] in BESIDE_NAMES else NO
    if tag in RUNNING or not HOLDERS.isdisjoint(parts) or BESIDE_NAMES.isdisjoint((parts[0], parts[-1])):
        return NO
    return MAYBE if READERS.isdisjoint(parts) else YES


def names_beside(attributes: str, tag: str, inside: bool) -> int:
    said = NO
    for m in ATTRIBUTE.finditer(attributes):
        key, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if key == "role" and value.strip().lower() in BESIDE_ROLES or key == "hidden" or key == "aria-hidden" and value.lower() == "true":
            return YES
        if key in ("class", "id"):
            said = max([said, *(named_beside(x, tag, inside) for x in value.split())])
    return said


class Finder:
    """``str.find`` for searches that move forward: what was found, or that nothing is left, is remembered, so that all of them take one pass."""

    def __init__(self, page: str, what: str) -> None:
        self.page, self.what, self.found, self.since = page, what, -2, 0

    def next(self, at: int) -> int:
        if self.found == -2 or at < self.since or -1 < self.found < at:
            self.found, self.since = self.page.find(self.what, at), at
        return self.found


class Scanner:
    """Tags, comments and text of a page from left to right, in time that grows with its length."""

    def __init__(self, page: str) -> None:
        self.page, self.lower, self.finders = page, page.translate(LOWER), {}

    def find(self, what: str, at: int) -> int:
        """Place of the lower-case string at or after ``at``, or -1."""
        if what not in self.finders:
            self.finders[what] = Finder(self.lower, what)
        return self.finders[what].next(at)

    def tag_end(self, at: int) -> int:
        """Place of the > that ends the tag whose attributes start at ``at``, or -1; a quote that closes nowhere sensible is a letter."""
        while True:
            end = self.find(">", at)
            if end < 0:
                return -1
            quotes = [(q, c) for c in "\"'" if 0 <= (q := self.find(c, at)) < end]
            if not quotes:
                return end
            quote, c = min(quotes)
            if not self.page[:quote].endswith("=") and not self.page[at:quote].rstrip().endswith("="):
                at = quote + 1
                continue
            close = self.find(c, quote + 1)
            after = self.page[close + 1 : close + 2]
            if close < 0 or close > end and ("<" in self.page[quote:close] or after not in ("", ">", "/", " ", "\t", "\n", "\r", "\f")):
                return end
            at = close + 1

    def closing(self, tag: str, at: int) -> int:
        """End of the next closing tag of that name, or -1."""
        start = at
        while (start := self.find(f"</{tag}", start)) >= 0:
            after = start + 2 + len(tag)
            if not self.lower[after : after + 1].isalnum():
                return self.tag_end(after) + 1 or len(self.page)
            start = after
        return -1


#: Lower case that keeps every character's place.
LOWER = {c: c + 32 for c in range(65, 91)}


def cut(page: str) -> list[Block]:
    """The blocks of a page in order."""
    blocks: list[Block] = []
    parts: list[str] = []
    linked, heading = 0, False
    # text before this place is a link's; 0: in no link; an anchor that is not closed before the next ends with its block
    link_end, until_block = 0, False
    open_tags: list[tuple[str, int, bool]] = []  # name, how surely beside, inside
    counts: dict[str, int] = {}
    beside, inside = NO, False
    scan, at, end = Scanner(page), 0, len(page)

    def flush() -> None:
        nonlocal linked, link_end, until_block
        text = SPACES.sub(" ", html.unescape("".join(parts))).strip() if parts else ""
        parts.clear()
        if text:
            blocks.append(Block(text, linked, heading, beside > NO, inside, beside == MAYBE))
        linked = 0
        if until_block:
            link_end, until_block = 0, False

    def shut(tag: str, within: frozenset[str] = frozenset()) -> None:
        """Closes the last open ``tag`` and what it holds, unless one of ``within`` was opened after it."""
        nonlocal beside, inside
        if counts.get(tag):
            for k in range(len(open_tags) - 1, -1, -1):
                if open_tags[k][0] == tag:
                    for name, _, _ in open_tags[k:]:
                        counts[name] -= 1
                    del open_tags[k:]
                    break
                if open_tags[k][0] in within:
                    break
        beside, inside = open_tags[-1][1:] if open_tags else (NO, False)

    while at < end:
        start = scan.find("<", at)
        if start < 0:
            start = end
        text = page[at:start]
        if text:
            parts.append(text)
            if link_end:
                linked += len(html.unescape(SPACES.sub(" ", text)))
        if start >= end:
            break
        m = TAG.match(page, start)
        if not m:
            if page.startswith("<!--", start):
                close = scan.find("-->", start + 4)
                at = close + 3 if close >= 0 else end
            elif page.startswith("<![CDATA[", start):
                close = scan.find("]]>", start)
                parts.append(page[start + 9 : close if close >= 0 else end])
                at = close + 3 if close >= 0 else end
            elif page[start + 1 : start + 2] in ("!", "?"):
                close = scan.find(">", start)
                at = close + 1 if close >= 0 else end
            else:
                parts.append("<")
                at = start + 1
            continue
        close = scan.tag_end(m.end())
        attributes = page[m.end() : close] if close >= 0 else ""
        at = close + 1 if close >= 0 else end
        tag = m[2].lower()
        if m[1]:
            if tag in BLOCK_TAGS:
                flush()
            if tag == "a":
                link_end, until_block = 0, False
            if tag not in VOID:
                shut(tag)
            heading = False if tag in BLOCK_TAGS else heading
            continue
        if tag in HIDDEN:
            if tag in BLOCK_TAGS:
                flush()
            if not attributes.endswith("/"):
                close = scan.closing(tag, at)
                # an element that is never closed hides only its own tag, except what cannot hold markup
                at = close if close >= 0 else end if tag in ("script", "style") else at
            continue
        if tag in BLOCK_TAGS:
            flush()
            heading = tag in ("h1", "h2", "h3", "h4", "h5", "h6")
        if tag == "a" and HREF.search(attributes):
            close, another = scan.find("</a", at), scan.find("<a ", at)
            link_end, until_block = 1, close < 0 or 0 <= another < close
        elif tag == "a":
            link_end, until_block = 0, False
        if tag == "br":
            parts.append(" ")
        if tag in VOID:
            continue
        if tag in ("p", "li", "td", "th", "tr", "dt", "dd", "option"):
            shut(tag, LIMITS)  # these end a sibling that was left open
        if tag in ("article", "main"):
            inside = True
        if tag not in ("html", "body", "article", "main") and not (tag == "header" and inside):
            beside = max(beside, YES if tag in BESIDE else names_beside(attributes, tag, inside) if attributes else NO)
        open_tags.append((tag, beside, inside))
        counts[tag] = counts.get(tag, 0) + 1
    flush()
    return blocks


def first_pass(b: Block) -> bool | None:
    """Main text or not by length, link density and density of stop words; None where they cannot tell."""
    if b.beside:
        return False
    n = len(b.text)
    if b.linked > LINKED * n:
        # running text of an article may be full of links
        return None if b.inside and n >= LONG and b.linked < MOSTLY * n else False
    if n < SHORT or b.heading:
        return None if b.inside or not b.linked else False
    words = b.text.lower().split()
    stops = sum(w.strip(".,;:!?\"'()") in STOP_WORDS for w in words) / len(words)
    if stops >= STOPS_HIGH:
        return True if n >= LONG else None
    if stops >= STOPS_LOW:
        return True if n >= 2 * LONG else None
    # without stop words: a list or a table of the page, or of the article
    return None if b.inside or not b.linked else False


def nearest(labels: list[bool | None], able: list[bool]) -> list[tuple[bool, int] | None]:
    """For each block the last decided block before it and how far back it is."""
    out, last = [], None
    for i, (x, ok) in enumerate(zip(labels, able, strict=True)):
        out.append((last[0], i - last[1]) if last else None)
        if x is not None and ok:
            last = (x, i)
    return out


def second_pass(blocks: list[Block], labels: list[bool | None], marked: bool) -> list[bool]:
    """Undecided blocks take the label of the nearest decided block, before or after; of two as near, main text wins.

    Menus, adverts and the like, and what is outside a marked article, are nobody's neighbours.
    A heading looks ahead first. On a page where nothing is decided as main text, what is open is it.
    """
    able = [not b.beside and (b.inside or not marked) for b in blocks]
    if not any(x and ok for x, ok in zip(labels, able, strict=True)):
        return [x is None and ok for x, ok in zip(labels, able, strict=True)]
    before = nearest(labels, able)
    after = nearest(labels[::-1], able[::-1])[::-1]
    out = []
    for b, x, p, q in zip(blocks, labels, before, after, strict=True):
        if x is None:
            near = [y for y in ((q or p,) if b.heading else (p, q)) if y]
            x = min(near, key=lambda y: (y[1], not y[0]))[0] if near else b.inside
        out.append(x)
    return out


def without_stop_words(blocks: list[Block]) -> list[bool | None]:
    """Labels of a page whose language the stop words are not of: long blocks with few links are its text.

    A short block before the first or after the last of them that ends no sentence and heads nothing is a menu's or a footer's
    line, unless it is in a marked article. Where stop words do occur, nothing is decided.
    """
    words = [w for b in blocks if not b.beside for w in b.text.lower().split()]
    if sum(w.strip(".,;:!?\"'()") in STOP_WORDS for w in words) > STRANGE * len(words):
        return [first_pass(b) for b in blocks]
    weight = [len(b.text) + 2 * sum("\u3040" <= x <= "\ud7ff" for x in b.text) for b in blocks]  # a sign of these scripts says as much as three letters
    labels = [None if not b.beside and not b.heading and b.linked <= LINKED * len(b.text) else first_pass(b) for b in blocks]
    long = [i for i, (b, x) in enumerate(zip(blocks, labels, strict=True)) if x is None and not b.heading and weight[i] >= LONG]
    for i, b in enumerate(blocks):
        if long and labels[i] is None:
            outside = not b.inside and (i < long[0] or i > long[-1])
            # the last heading before the text is its title
            title = b.heading and i < long[0] and not any(x.heading and not x.beside for x in blocks[i + 1 : long[0]])
            labels[i] = True if weight[i] >= LONG and not b.heading else False if outside and not title and not (b.text.endswith(STOPS) and weight[i] >= SHORT) else None
    return labels


def main_text(page: str) -> str:
    """The blocks of the main text, one a line.

    Where the rules find no main text, blocks count as open that are left out for a part of a name only;
    where they still find none, the page is taken to be in a language of other stop words.
    """
    blocks = cut(page)
    first = [first_pass(b) for b in blocks]
    if not any(first) and any(b.unsure for b in blocks):
        freed = [b._replace(beside=b.beside and not b.unsure) for b in blocks]
        again = [first_pass(b) for b in freed]
        if any(again) or not any(x is None for x in first):
            blocks, first = freed, again
    if not any(first):
        first = without_stop_words(blocks)
    labels = second_pass(blocks, first, False)
    if any(b.inside and not b.beside for b in blocks):
        own, other = (sum(len(b.text) for b, x in zip(blocks, labels, strict=True) if x and b.inside == side) for side in (True, False))
        if own >= other:
            marked = [False if not b.inside else x for b, x in zip(blocks, first, strict=True)]
            labels = second_pass(blocks, marked, True)
    return "\n".join(b.text for b, x in zip(blocks, labels, strict=True) if x)


def extract(pages: DataFrame) -> DataFrame:
    """Every column of ``pages`` but html, with text and n_chars (long: code points).

    * null, empty or text-less html: empty text, 0.
    * repeated rows each by themselves; empty table: empty result; columns text and n_chars are replaced.
    """
    keep = [c for c in pages.columns if c not in ("html", "text", "n_chars")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [main_text(x.as_py() or "") for x in b.column("html")]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], [*keep, "text", "n_chars"])

    schema = pages.select(*keep, F.lit("").alias("text"), F.lit(0).cast("long").alias("n_chars")).schema
    return pages.select(*keep, "html").mapInArrow(run, schema)
