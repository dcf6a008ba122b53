"""Main text of HTML pages by block rules in two passes.

A page is read once into blocks: the text between tags that begin or end a block, with its share of linked characters and the
innermost of the page's zones around it. Scripts, styles, comments, forms and the like have no text. First pass: blocks in zones
that are never main text (menus, footers, sidebars, notices, adverts, reader comments, by tag or by a word of the class, id or
role), and blocks with many links, are bad; long blocks with enough stop words are good, long ones without are bad unless an
article holds them; the others are undecided, headings too. Second pass: an undecided block takes the label that its nearest
decided neighbours on both sides agree on; where they differ, and at the ends, what holds the block decides: inside an article or
main element it is good, elsewhere bad. Blocks in never-main zones are decided but nobody's neighbours, so an advert in the middle
of an article takes nothing with it.

Defined results: a null page is an empty one; a page without main text has the empty text; character references are decoded once; white
space (Unicode's) in a block becomes one blank, a line break within a block is white space; blocks are joined by one newline in page
order; unclosed and stray tags are tolerated, as are pages cut off anywhere; equal pages have equal texts; repeated rows are all
kept; a page is read whole, in time and memory in proportion to it; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lociweave.llm.common import slices, small_batches

# The tags of HTML that begin and end blocks, have no text of their own, or stand for what is never main text.
BLOCK_TAGS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table tbody td tfoot th thead title tr ul".split()
)
SILENT_TAGS = frozenset("applet audio button canvas datalist embed form head iframe input map math noframes noscript object script select style svg template textarea title video".split())
NEVER_TAGS = frozenset("aside dialog footer menu nav search".split())
VOID_TAGS = frozenset("area base basefont bgsound br col embed frame hr img input link meta param source track wbr".split())
ARTICLE_TAGS = frozenset("article main".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: What the next of its kind may end, although one of these stands open in it.
WITHIN = HEADINGS | {"p", "a"}
#: Words of a class, id or role that name what is never main text.
NEVER_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising adsense banner breadcrumb breadcrumbs comment comments consent cookie cookies copyright disclaimer disqus footer gdpr masthead menu modal nav navbar navigation newsletter notice notices notification outbrain overlay pagination paywall popup promo promoted promotion recommended related respond share sharing sidebar sidebars signup skip social sponsor sponsored subscribe taboola teaser toolbar widget".split()
)
ARTICLE_WORDS = frozenset("articlebody".split())
#: Beside such words a name speaks of what a part has beside it, or of an article's own header.
BESIDE_WORDS, OWN_WORDS = frozenset("has no with without".split()), frozenset("article content entry post story".split())

# Common function words of English, German, French and Spanish.
STOP_WORDS = frozenset(
    """a an and are as at be been but by can for from had has have he her his i if in into is it its not of on only or she so than that the their them there they this to was we were what when which who will with would you
    aber als am auch auf aus bei bin bis das dass dem den der des die doch du durch ein eine einem einen einer er es für hat ich ihr im ist ja mit nach nicht noch nur oder ohne sich sie sind so über um und uns von vor war was wenn wie wir zu zum zur
    au aux avec ce ces cette dans de des du elle en entre est et il ils je la le les leur lui mais même ne nous on ou par pas plus pour que qui sa sans se ses son sont sur un une vous
    al como con de del el ella en entre es esta este fue ha hay la las le lo los más me no nos o para pero por que se ser si sin sobre su sus también un una y ya""".split()
)

#: A block with this share of linked characters is bad; of characters, one is long; with this share of stop words, it is prose.
LINKED, LONG, PROSE = 0.5, 120, 0.15

_PARTS, _WORDS = re.compile(r"[^a-z]+"), re.compile(r"\w+")
_CUT = re.compile(r"<[A-Za-z/!][^>]*\Z")
_CAMEL = re.compile(r"(?<=[a-z0-9])(?=[A-Z])")


@dataclass
class Text:
    """A block: its text, linked characters, and what holds it."""

    text: str
    linked: int
    heading: bool
    never: bool
    article: bool


class Blocks(HTMLParser):
    """Cuts a page into blocks. ``open`` holds the open elements that matter with the zones that they begin."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.blocks: list[Text] = []
        self.open: list[tuple[str, str]] = []
        self.count = {"silent": 0, "never": 0, "article": 0, "heading": 0, "link": 0}
        self.parts: list[str] = []
        self.links = 0

    def flush(self) -> None:
        text = " ".join("".join(self.parts).split())
        if text:
            c = self.count
            self.blocks.append(Text(text, min(self.links, len(text)), c["heading"] > 0, c["never"] > 0, c["article"] > 0))
        self.parts, self.links = [], 0

    def zone(self, tag: str, attrs: list[tuple[str, str | None]]) -> str:
        """What an element begins, or nothing."""
        named = {k: v for k, v in attrs if v and k in ("class", "id", "role", "hidden", "aria-hidden", "style", "itemprop")}
        if tag in SILENT_TAGS or "hidden" in dict(attrs) or named.get("aria-hidden") == "true" or "display:none" in named.get("style", "").replace(" ", "").lower():
            return "silent"
        if tag in ("html", "body"):
            return ""
        words = set(_PARTS.split(" ".join(_CAMEL.sub(" ", named[k]).lower() for k in ("class", "id", "role") if k in named))) if named else set()
        head = tag == "header" or "header" in words and not words & OWN_WORDS
        if tag in NEVER_TAGS or words & NEVER_WORDS and tag != "main" and not words & BESIDE_WORDS or head and not self.count["article"]:
            return "never"
        if tag in ARTICLE_TAGS or named.get("role", "").lower() in ARTICLE_TAGS or named.get("itemprop", "").lower() in ARTICLE_WORDS:
            return "article"
        return "heading" if tag in HEADINGS else "link" if tag == "a" else ""

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag in BLOCK_TAGS:
            self.flush()
            if self.count["silent"] and self.open[-1][0] == "head":  # a head that isn't closed
                self.drop(len(self.open) - 1)
        elif tag == "br":
            self.parts.append("\n")
        if tag in VOID_TAGS:
            return
        if tag in ("p", "li", "a") or tag in HEADINGS:  # end themselves at the next of their kind
            self.end(tag, WITHIN if tag != "li" else frozenset())
        zone = self.zone(tag, attrs)
        if zone or tag in BLOCK_TAGS or tag == "a":
            self.open.append((tag, zone))
            if zone:
                self.count[zone] += 1

    def end(self, tag: str, within: frozenset[str]) -> None:
        """End an open ``tag``, if only elements ``within`` stand open inside it."""
        for at in range(len(self.open) - 1, -1, -1):
            if self.open[at][0] == tag:
                self.drop(at)
                return
            if self.open[at][0] not in within:
                return

    def drop(self, at: int) -> None:
        for _, zone in self.open[at:]:
            if zone:
                self.count[zone] -= 1
        del self.open[at:]

    def handle_endtag(self, tag: str) -> None:
        if tag in BLOCK_TAGS:
            self.flush()
        for at in range(len(self.open) - 1, max(-1, len(self.open) - 200), -1):
            if self.open[at][0] == tag:
                self.drop(at)
                return

    def handle_data(self, data: str) -> None:
        if self.count["silent"]:
            return
        self.parts.append(data)
        if self.count["link"]:
            self.links += len("".join(data.split()))


def blocks(html: str | None) -> list[Text]:
    page, html = Blocks(), html or ""
    if _CUT.match(html, at := max(0, html.rfind("<"))):  # a tag that the page's end cuts off
        html = html[:at]
    page.feed(html)
    page.close()
    page.flush()
    return page.blocks


def decided(block: Text) -> bool | None:
    """First pass: whether a block is main text, or None where it is ambiguous."""
    if block.never or block.linked >= LINKED * len(block.text.replace(" ", "")):
        return False
    if block.heading or len(block.text) < LONG:
        return None
    words = _WORDS.findall(block.text.lower())
    if sum(map(STOP_WORDS.__contains__, words)) >= PROSE * len(words):
        return True
    return None if block.article else False


def main_text(html: str | None) -> str:
    """The page's main blocks, joined by newlines."""
    found = blocks(html)
    first = [decided(b) for b in found]
    near = [(b, label) for b, label in zip(found, first) if not b.never]

    def carried(labels: list[bool | None]) -> list[bool | None]:
        last, out = None, []
        for label in labels:
            last = label if label is not None else last
            out.append(last)
        return out

    labels = [label for _, label in near]
    before, after = carried(labels), carried(labels[::-1])[::-1]
    kept = [b.text for (b, label), x, y in zip(near, before, after) if (label if label is not None else x if x is not None and x == y else b.article)]
    return "\n".join(kept)


def extracted(pages: DataFrame, keep: list[str], html: str = "html") -> DataFrame:
    """The columns ``keep``, text and n_chars."""

    def run(batches):
        for b in slices(batches, "_html"):
            texts = [main_text(t) for t in b.column("_html").to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], [*b.schema.names[:-1], "text", "n_chars"])

    small_batches(pages.sparkSession)
    rows = pages.select(*keep, F.col(html).alias("_html"))
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema[:-1])
    return rows.mapInArrow(run, f"{kinds}, text string, n_chars long")
