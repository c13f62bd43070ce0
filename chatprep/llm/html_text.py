"""Main text of web pages by two passes of block rules.

The first pass cuts a page into blocks and decides each by itself: by the density of stop
words, by its length and by the density of links. What it can't decide, short blocks and
ones with few stop words, takes in the second pass the label of the nearest decided
neighbours.

Elements and names that stand for menus, notices, comments and so on speak against the
blocks in them, but only beside other text: where no block outside of them is text, the
outermost of them is passed over, then the next one, until the densities find text. A page
that has prose always gives some, whatever its containers are called.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Least characters of a block that is decided by its words, and of one that is good
#: by itself; densities of stop words above which a block may be and is text; density
#: of links above which it is none.
SHORT_CHARS = 70
LONG_CHARS = 200
LOW_STOP_WORDS = 0.15
HIGH_STOP_WORDS = 0.30
MAX_LINKS = 0.5

#: Frequent words of English, French, German and Spanish.
STOP_WORDS = frozenset(
    """a about all an and are as at be been but by can for from had has have he her his i if in into is it its more no
    not of on one or our she so than that the their there they this to up was we were what when which who will with
    would you
    au aux avec ce ces dans de des du elle en est et eux il je la le les leur lui mais me ne nous on ou par pas pour
    plus qu que qui sa se ses son sont sur te tu un une vos votre vous
    aber als am an auch auf aus bei bin bis das dass dem den der des die durch ein eine einem einen einer eines er es
    für hat ich ihr im in ist ja mit nach nicht noch nur oder sein sich sie sind so über um und uns von vor war was
    wie wir zu zum zur
    al algo con como cuando de del donde el ella en era es esta este fue ha hay la las le lo los más me mi muy no nos
    o para pero por que se ser si sin sobre son su sus también un una y ya yo""".split()
)

#: Elements by what they mean for text.
RAW = frozenset({"script", "style", "title", "textarea", "xmp", "iframe", "noembed", "noframes", "noscript", "template", "svg", "annotation", "annotation-xml"})
APART = frozenset(
    {"nav", "footer", "aside", "form", "button", "select", "option", "datalist", "dialog", "menu", "canvas", "object", "audio", "video", "map"}
)
MAIN = frozenset({"article", "main"})
INLINE = frozenset(
    """a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small
    span strike strong sub sup time tt u var wbr
    math mi mn mo ms mtext mrow msup msub msubsup mfrac msqrt mroot mover munder munderover mtable mtr mtd mstyle
    semantics""".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
CLOSED_BY_SAME = frozenset({"p", "li", "dt", "dd", "tr", "td", "th", "option"})
HEADINGS = frozenset({"h1", "h2", "h3", "h4", "h5", "h6"})

#: Words in a class, id or role that set an element apart; the second
#: list does so only outside of the article and where no word of the third is near.
APART_NAMES = frozenset(
    """ad ads advert adverts advertisement advertising adsense adbox sponsor sponsored sponsors promo promos promotion
    nav navbar navigation menu menus breadcrumb breadcrumbs sidebar sidebars aside footer footers cookie cookies consent
    gdpr comment comments commentlist disqus respond replies share sharing sharebar social related recommended
    recommendations newsletter subscribe subscription signup login popup modal overlay paywall pagination pager toolbar
    copyright contentinfo complementary masthead skiplink teaser teasers trending""".split()
)
APART_OUTSIDE = frozenset("header headers banner notice notices alert widget widgets search tags legal disclaimer form dialog reply topbar".split())
MAIN_NAMES = frozenset("article articlebody content main post entry story maincontent".split())

_TOKEN = re.compile(
    r"""<!--.*?(?:-->|\Z)|<(/?)([A-Za-z][A-Za-z0-9:_-]*)((?:[^>"']|"[^"]*"|'[^']*')*+)>|<(/?)([A-Za-z][A-Za-z0-9:_-]*)([^>]*)(?:>|\Z)|<[!?/][^>]*(?:>|\Z)""",
    re.DOTALL,
)
_NAMES = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>"']+))""", re.IGNORECASE)
_HIDDEN = re.compile(r"""(?:^|\s)hidden(?:\s|=|$)|display\s*:\s*none|aria-hidden\s*=\s*["']?true""", re.IGNORECASE)
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_LETTERS = re.compile(r"[^\W\d_]+")
#: Letters of scripts without blanks, of which one stands for about three of others.
_DENSE = re.compile(r"[\u3040-\u30ff\u3400-\u9fff]")


#: What speaks against a block: a name, an element, or that it is hidden, which stays.
NAMED, ELEMENT, HIDDEN = "name", "element", "hidden"
#: A block stands in the article by a name, or by its element.
BY_NAME = 1
BY_ELEMENT = 2


@dataclass
class Block:
    """A run of text between block elements; ``against`` is what speaks against it, the outermost first."""

    text: str
    links: int
    against: tuple[str, ...]
    main: int
    heading: bool
    apart: bool = False
    label: str = ""


@dataclass
class _Page:
    blocks: list[Block] = field(default_factory=list)
    pieces: list[str] = field(default_factory=list)
    links: int = 0


def _place(name: str, attributes: str, against: tuple[str, ...], main: int) -> tuple[tuple[str, ...], int]:
    """What speaks against the text of an element, and whether it stands in the article."""
    if name in ("html", "body"):
        return against, main
    if attributes and _HIDDEN.search(attributes):
        return (*against, HIDDEN), main
    words, tokens = _names(attributes) if attributes else (frozenset(), frozenset())
    near_text = bool(words & MAIN_NAMES)
    # A name that stands for the article by itself outweighs others beside it.
    apart = bool(words & APART_NAMES) and not tokens & MAIN_NAMES
    if name in MAIN:
        return ((*against, NAMED) if apart else against), BY_ELEMENT
    if name in APART or (name == "header" and not main):
        return (*against, ELEMENT), main
    if apart or (words & APART_OUTSIDE and not main and not near_text):
        return (*against, NAMED), main
    # Names that stand for notices do so inside an article as well.
    if main and words & {"notice", "notices", "alert", "banner", "widget"} and not near_text:
        return (*against, NAMED), main
    return against, main or (BY_NAME if near_text else 0)


def _names(attributes: str) -> tuple[set[str], set[str]]:
    """The words of an element's class, id and role, and the whole names in them."""
    values = [value[0] or value[1] or value[2] for value in _NAMES.findall(attributes)]
    whole = {name.lower() for value in values for name in value.split()}
    return {word.lower() for value in values for word in _WORD.findall(value)}, whole


def blocks_of(html: str) -> list[Block]:
    """The blocks of a page in order, without markup, white space made one blank."""
    page = _Page()
    # Open elements: name, what speaks against, main, inside a link, heading.
    stack: list[tuple[str, tuple[str, ...], int, bool, bool]] = [("", (), 0, False, False)]

    def flush() -> None:
        text = " ".join("".join(page.pieces).split())
        if text:
            _, against, main, _, heading = stack[-1]
            page.blocks.append(Block(text, min(page.links, len(text)), against, main, heading))
        page.pieces.clear()
        page.links = 0

    def add(raw: str) -> None:
        if raw:
            text = unescape(raw) if "&" in raw else raw
            page.pieces.append(text)
            if stack[-1][3]:
                page.links += len(text.strip())

    at, n = 0, len(html)
    while at < n:
        found = _TOKEN.search(html, at)
        if not found:
            add(html[at:])
            break
        add(html[at : found.start()])
        at = found.end()
        close = found[1] if found[2] else found[4]
        name = (found[2] or found[5] or "").lower()
        if not name:
            continue
        if close:
            if name not in INLINE:
                flush()
            for k in range(len(stack) - 1, 0, -1):
                if stack[k][0] == name:
                    if name in INLINE and any(open_[0] not in INLINE for open_ in stack[k + 1 :]):
                        break
                    # Text collected inside an element that is set apart ends with it.
                    if stack[-1][1] != stack[k - 1][1]:
                        flush()
                    del stack[k:]
                    break
            continue
        attributes = found[3] if found[2] else found[6]
        if name in RAW:
            if not (attributes or "").rstrip().endswith("/"):
                end = re.compile(rf"</{re.escape(name)}(?![A-Za-z0-9:_-])[^>]*(?:>|\Z)", re.IGNORECASE).search(html, at)
                at = end.end() if end else n
            continue
        if name == "br":
            page.pieces.append(" ")
            continue
        if name not in INLINE:
            flush()
            if name in CLOSED_BY_SAME and stack[-1][0] == name:
                stack.pop()
            elif stack[-1][0] == "p":
                stack.pop()
        if name in VOID or (attributes or "").endswith("/"):
            continue
        _, against, main, link, heading = stack[-1]
        now_against, now_main = _place(name, attributes, against, main)
        if now_against != against:
            flush()
        if name in INLINE and name != "a" and now_against == against:
            continue
        stack.append((name, now_against, now_main, link or name == "a", heading or name in HEADINGS))
    flush()
    return page.blocks


def _stops(text: str) -> tuple[int, int]:
    """Stop words and words of a text."""
    words = _LETTERS.findall(text.lower())
    return sum(word in STOP_WORDS for word in words), len(words)


def _first_label(block: Block, by_length: bool) -> str:
    """good, bad, or what the neighbours decide: near (few stop words) and short."""
    if block.apart:
        return "apart"
    size = len(block.text)
    links = block.links / size
    if by_length:
        size += 2 * len(_DENSE.findall(block.text))
    if links > MAX_LINKS:
        return "bad"
    if size < SHORT_CHARS or block.heading:
        return "short"
    if by_length:
        return "good" if size > LONG_CHARS or block.main else "near"
    found, words = _stops(block.text)
    stops = found / max(words, 1)
    if stops >= HIGH_STOP_WORDS and (size > LONG_CHARS or block.main):
        return "good"
    if stops >= LOW_STOP_WORDS or block.main == BY_ELEMENT:
        return "near"
    return "bad"


def _first_labels(blocks: list[Block]) -> bool:
    """The first pass; whether any block is good.

    A page without a good block whose words are not those of the known languages is
    judged by length and links alone.
    """
    for block in blocks:
        block.label = _first_label(block, False)
    if not any(block.label == "good" for block in blocks):
        counts = [_stops(block.text) for block in blocks if not block.apart]
        if sum(found for found, _ in counts) < LOW_STOP_WORDS * sum(words for _, words in counts):
            for block in blocks:
                block.label = _first_label(block, True)
    return any(block.label == "good" for block in blocks)


def _stands(blocks: list[Block]) -> bool:
    """Whether what nothing speaks against looks like text, though no block of it is good by itself."""
    return any(
        block.label == "near" or (block.label == "short" and block.main == BY_ELEMENT) for block in blocks
    )


def _first_pass(blocks: list[Block]) -> None:
    """Label blocks with as little passed over of what speaks against them as leaves some text."""
    for passed in range(max((len(block.against) for block in blocks), default=0) + 1):
        for block in blocks:
            block.apart = HIDDEN in block.against or len(block.against) > passed
        if _first_labels(blocks) or (not passed and _stands(blocks)):
            return
    # No block is good wherever it stands.
    for block in blocks:
        block.apart = bool(block.against)
    _first_labels(blocks)


def label(blocks: list[Block]) -> None:
    """Set each block's label to good or bad."""
    _first_pass(blocks)
    good = [bool(block.main) for block in blocks if block.label == "good"]
    in_main = any(good) or (not good and any(block.main == BY_ELEMENT and not block.apart for block in blocks))
    if in_main:
        # Where a page says what its article is and that reads as text, or nothing else
        # does and an element says so, the rest of it is not.
        for block in blocks:
            if not block.main and block.label != "apart":
                block.label = "bad"
    region = [block for block in blocks if block.label != "apart" and (block.main or not in_main)]
    decided = [k for k, block in enumerate(region) if block.label in ("good", "bad")]
    if not any(region[k].label == "good" for k in decided):
        # Nothing speaks for any block by itself: what is not bad is all there is, unless
        # it is scraps among bad blocks.
        keep = in_main or not decided or any(block.label == "near" for block in region)
        for block in region:
            if block.label in ("near", "short"):
                block.label = "good" if keep else "bad"
    else:
        before, after = [-1] * len(region), [-1] * len(region)
        last = -1
        for k, block in enumerate(region):
            before[k] = last
            if block.label in ("good", "bad"):
                last = k
        last = -1
        for k in range(len(region) - 1, -1, -1):
            after[k] = last
            if region[k].label in ("good", "bad"):
                last = k
        for k, block in enumerate([b.label for b in region]):
            if block in ("near", "short"):
                near = [(abs(j - k), region[j].label) for j in (before[k], after[k]) if j >= 0]
                least = min(distance for distance, _ in near)
                # Equally near: good wins for what looks like text or stands in the article.
                labels = {own for distance, own in near if distance == least}
                favoured = block == "near" or region[k].main or region[k].heading
                region[k].label = "good" if labels == {"good"} or ("good" in labels and favoured) else "bad"
    for block in blocks:
        if block.label == "apart":
            block.label = "bad"


def main_text(html: str) -> str:
    """The good blocks of a page, in order, joined by one blank."""
    blocks = blocks_of(html)
    label(blocks)
    return " ".join(block.text for block in blocks if block.label == "good")


def extract(pages: DataFrame, id_col: str, url_col: str, html_col: str) -> DataFrame:
    """One row per input row: id, url, ``text`` and ``n_chars``, its code points.

    A null or empty page has an empty text; a null id or url stays null. Repeated rows
    are read one by one, an empty table gives an empty result, other columns play no
    part. Pages are read whole, whatever their length, one Arrow batch at a time.
    """
    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))
    types = [rows.schema[name].dataType.simpleString() for name in ("id", "url")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(html) if html else "" for html in (value.as_py() for value in batch.column(2))]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())],
                ["id", "url", "text", "n_chars"],
            )

    out = rows.mapInArrow(run, f"id {types[0]}, url {types[1]}, text string, n_chars long")
    return out.withColumnsRenamed({"id": id_col, "url": url_col})
