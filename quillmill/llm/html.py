"""HTML extraction in two passes: blocks decided by stop words, length and links, then short ones by their nearest decided neighbours."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from quillmill.llm.base import pick, slabs, table

# HTML's element names by their part in a page, and frequent function words of four languages.
BLOCKS = frozenset(
    "address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hr html "
    "legend li main menu nav ol optgroup option p pre section select summary table tbody td tfoot th thead tr ul".split()
)
#: Of the blocks, those that end where the next one begins; their open tags aren't kept on the stack.
FLAT = frozenset("p h1 h2 h3 h4 h5 h6 li dd dt tr td th hr option caption".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Raw text up to their own end tag; foreign content, which a block ends; and what stands in place of something else. The latter two are passed over only if they are closed.
RAW = frozenset("script style".split())
FOREIGN = frozenset("svg math".split())
INSTEAD = frozenset("noscript template textarea title iframe object canvas audio video select".split())
ASIDE = frozenset("nav header footer aside menu dialog button fieldset".split())
ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog form menu menubar toolbar".split())
COMMENTS = frozenset("comment comments commentlist disqus respond reply replies".split())
NAMES = COMMENTS | frozenset(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored promo promoted promotion banner cookie cookies consent gdpr notice notices popup modal overlay sidebar menu nav navbar "
    "navigation breadcrumb breadcrumbs masthead header footer related recommended share sharing social newsletter subscribe subscription "
    "signup login widget widgets toolbar pagination pager hidden disclaimer copyright".split()
)
STOP_WORDS = frozenset(
    "the of and a an to in is was be are it that this with for on by at from as not or but they he she his her their have has had will which "
    "le la les un une des du de et en est que qui dans pour sur pas par au aux avec il elle ce se ne plus son sa ses "
    "der die das ein eine und ist von mit den dem im nicht zu auf für sich als auch es an werden aus er hat dass sie nach "
    "el los las una unos y que en por con para del se no al lo como más su sus es son fue".split()
)
TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)""", re.DOTALL)
NAMED = re.compile(r"""(?:^|\s)(class|id|role|hidden|aria-hidden|style)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""", re.IGNORECASE)
WORD = re.compile(r"[^\W\d_]+")
PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")


#: Suspect elements in so many others are not told apart from those around them.
NESTED = 50
LINK_END = re.compile(r"<(/?)a(?=[\s/>])", re.IGNORECASE)
BREAKOUT = re.compile(r"<(?:svg|math|p|div|h[1-6]|ul|ol|table|article|main|section|body|blockquote)\b|</(?:svg|math)\b[^>]*(?:>|\Z)", re.IGNORECASE)
HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.IGNORECASE)


@dataclass
class Block:
    """A block of text and what is known of the elements around it. bad: an element that is no part of an article (nav, footer, form and such). suspects: numbers of
    the elements whose class or id says that they are none. article, main: whether such an element is around it."""

    bad: bool
    suspects: tuple[int, ...]
    article: bool
    main: bool
    heading: bool
    pieces: list[str] = field(default_factory=list)
    linked: list[str] = field(default_factory=list)
    text: str = ""
    links: float = 0.0


def marks(tag: str, attributes: str) -> tuple[bool, str]:
    """Whether an element is no part of an article by its own name, its role or because it is hidden; and what its class and id suggest: "comments", "other" or nothing. A form is "other": some pages are one form."""
    bad, names = tag in ASIDE, set()
    if attributes.strip():
        for name, value in NAMED.findall(attributes):
            name, value = name.lower(), value.strip("\"'")
            bad |= name == "role" and value.lower() in ROLES or name == "hidden" or name == "aria-hidden" and value.lower() == "true" or name == "style" and HIDDEN.search(value) is not None
            if name in ("class", "id"):
                names |= {p.lower() for p in PARTS.findall(value)}
    # what names a page, an article or a heading says what they go with, not what they are
    told = set() if tag in HEADINGS or tag in ("body", "html", "main", "article") else names & NAMES
    return bad, "comments" if told & COMMENTS else "other" if told or tag == "form" else ""


def blocks(html: str) -> tuple[list[Block], dict[int, str]]:
    """The page's text in blocks, and the suspect elements by number. Open containers are kept on a stack; an end tag closes down to its own element, and is ignored if that isn't
    open. A link counts from its start to its end tag, blocks within included; one that isn't closed before the next counts for nothing."""
    found: list[Block] = []
    suspects: dict[int, str] = {}
    stack: list[tuple[str, bool, tuple[int, ...], bool, bool]] = [("", False, (), False, False)]
    open_: Counter[str] = Counter()
    block, at, link = Block(False, (), False, False, False), 0, -1

    def begin(heading: bool = False, within: tuple | None = None) -> Block:
        if block.pieces:
            found.append(block)
        return Block(*(within or stack[-1])[1:], heading)

    def text(start: int, end: int) -> None:
        block.pieces.append(html[start:end])
        if start < link:
            block.linked.append(html[start:end])

    while True:
        m = TAG.search(html, at)
        if m is None:
            text(at, len(html))
            break
        if m.start() > at:
            text(at, m.start())
        at = m.end()
        ends, tag, attributes = (m[1], m[2], m[3]) if m[2] else (m[4], m[5], m[6])
        if not tag:
            continue
        tag = tag.lower()
        if tag in RAW and not ends:
            close = re.compile(rf"</{tag}\b[^>]*(?:>|\Z)", re.IGNORECASE).search(html, at)
            at = close.end() if close else len(html)
            block.pieces.append(" ")
        elif tag in FOREIGN and not ends and not attributes.rstrip().endswith("/"):
            close = BREAKOUT.search(html, at)
            at = at if close is None else close.end() if close[0][1] == "/" else close.start()
            block.pieces.append(" ")
        elif tag in INSTEAD and not ends and not attributes.rstrip().endswith("/"):
            close = re.compile(rf"<(/?){tag}\b[^>]*(?:>|\Z)", re.IGNORECASE).search(html, at)
            at = close.end() if close and close[1] else at
            block.pieces.append(" ")
        elif tag == "a" and not ends:
            close = LINK_END.search(html, at)
            link = close.start() if close and close[1] else -1
        elif tag == "br":
            block.pieces.append(" ")
        elif tag in BLOCKS and tag != "head":
            if ends:
                while open_[tag]:
                    last = stack.pop()[0]
                    open_[last] -= 1
                    if last == tag:
                        break
                block = begin()
                continue
            _, bad, own, article, main = stack[-1]
            out, told = marks(tag, attributes)
            if tag == "main":
                bad = out = False
            elif tag == "article" and (open_["header"] or open_["nav"]) and not (open_["aside"] or open_["footer"]):
                bad = False  # such elements hold no articles; their end tag is missing
            elif tag == "header" and (article or main):
                out = False
            if told and len(own) < NESTED:
                suspects[len(suspects)] = told
                own = (*own, len(suspects) - 1)
            inner = (tag, bad or out, own, article or tag == "article", main or tag == "main")
            if tag not in FLAT:
                stack.append(inner)
                open_[tag] += 1
            block = begin(tag in HEADINGS, inner)
    if block.pieces:
        found.append(block)
    out = []
    for b in found:
        b.text = " ".join(unescape("".join(b.pieces)).split())
        if b.text:
            b.links = len(" ".join(unescape("".join(b.linked)).split())) / len(b.text)
            out.append(b)
    return out, suspects


def stop_density(text: str) -> float:
    words = WORD.findall(text.lower())
    return sum(w in STOP_WORDS for w in words) / len(words) if words else 0.0


def first_pass(found: list[Block], short: int = 70, long: int = 200, low: float = 0.10, high: float = 0.20, linked: float = 0.5) -> list[str]:
    """A label for each block from its length, links and stop words alone: out (mostly links), in (long, many stop words), near (of middle length or density), low (hardly
    any stop words) or short. Where no block shows the stop words of a known language, long ones are in."""
    label = []
    for b in found:
        if b.links > linked:
            label.append("out")
        elif len(b.text) < short:
            label.append("short")
        else:
            density = stop_density(b.text)
            label.append("in" if density >= high and len(b.text) >= long else "near" if density >= low else "low")
    if not any(x in ("in", "near") and not b.bad for b, x in zip(found, label, strict=True)):
        label = ["in" if x == "low" and len(b.text) >= long else x for b, x in zip(found, label, strict=True)]
    return label


def aside(found: list[Block], label: list[str], suspects: dict[int, str]) -> tuple[list[bool], bool]:
    """Which blocks are no part of the article for where they stand, and whether article or main elements tell where it is.

    What text there is decides what the marks are worth. It is the characters of all blocks that aren't out, twice those of blocks that are in or near. A suspect element is
    cleared if all articles with text lie in it or in other suspects, the one with the most text first; and, if there are no such articles, if it holds over twice the text
    outside all suspects, comments never. Article elements with at least half of the text that is left, or main elements with as much, keep all other blocks out.
    """
    weight = [0 if b.bad or x == "out" else len(b.text) * (2 if x in ("in", "near") else 1) for b, x in zip(found, label, strict=True)]
    cleared: set[int] = set()

    def free(b: Block) -> bool:
        return not b.bad and cleared.issuperset(b.suspects)

    def held(kinds: tuple[str, ...], marked: bool) -> dict[int, int]:
        """The text in each suspect that no other one is around, cleared ones aside."""
        out: dict[int, int] = {}
        for b, w in zip(found, weight, strict=True):
            outer = next((x for x in b.suspects if x not in cleared), None)
            if outer is not None and w and suspects[outer] in kinds and (b.article or b.main or not marked):
                out[outer] = out.get(outer, 0) + w
        return out

    while not any(w and (b.article or b.main) and free(b) for b, w in zip(found, weight, strict=True)) and (most := held(("other", "comments"), True)):
        cleared.add(max(most, key=most.get))
    while not any(w and (b.article or b.main) and free(b) for b, w in zip(found, weight, strict=True)) and (most := held(("other",), False)) and max(most.values()) > 2 * sum(w for b, w in zip(found, weight, strict=True) if free(b)):
        cleared.add(max(most, key=most.get))
    left = [w if free(b) else 0 for b, w in zip(found, weight, strict=True)]
    for inside in ([b.article for b in found], [b.main for b in found]):
        own = sum(w for w, x in zip(left, inside, strict=True) if x)
        if own and 2 * own >= sum(left):
            return [not free(b) or not x for b, x in zip(found, inside, strict=True)], True
    return [not free(b) for b in found], False


def classify(found: list[Block], suspects: dict[int, str]) -> list[bool]:
    """Which blocks belong to the main text.

    The first pass labels blocks by length, links and stop words (first_pass); where they stand takes some out (aside). Second pass: what is undecided takes the label of its nearest decided
    neighbours. Where elements mark the article, only its own blocks are neighbours, a nearly good block is decided, and a short one or one without stop words is in unless the decided ones
    on both sides are out. Elsewhere a nearly good one needs one good neighbour (none if no block is good), others two; a heading needs a good one after it; the page's ends count as out, as do short blocks
    with a copyright sign.
    """
    first = first_pass(found)
    away, marked = aside(found, first, suspects)
    label = []
    for b, x, out in zip(found, first, away, strict=True):
        if out:
            label.append("away" if marked else "out")
        elif marked or x == "near" and "in" not in first:
            label.append("in" if x == "near" else x)
        else:
            label.append("out" if x == "short" and "©" in b.text else x)
    before, last = [], "none"
    for x in label:
        before.append(last)
        last = x if x in ("in", "out") else last
    after, last = [], "none"
    for x in reversed(label):
        after.append(last)
        last = x if x in ("in", "out") else last
    after.reverse()
    keep = []
    for b, x, p, q in zip(found, label, before, after, strict=True):
        if x in ("in", "out", "away"):
            keep.append(x == "in")
        elif marked:
            keep.append(not (p == "out" and q == "out"))
        elif x == "near":
            keep.append("in" in (p, q) or p == q == "none")
        else:
            keep.append(p == q == "in" or b.heading and q == "in")
    return keep


def main_text(html: str | None) -> str:
    found, suspects = blocks(html or "")
    return "\n".join([b.text for b, k in zip(found, classify(found, suspects), strict=True) if k])


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url, text and n_chars of every page: its main text, one line for each block (see classify).

    Null and empty pages have an empty text. Character references are decoded once; white space inside a block is one space.
    Rows with equal or null ids stay as they are; other columns are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slabs(batches, "html"):
            texts = [main_text(x) for x in batch.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(x) for x in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    return pick(pages, page_id=id_col, url=url_col, html=html_col).selectExpr("cast(page_id as long) page_id", "cast(url as string) url", "html").mapInArrow(run, "page_id long, url string, text string, n_chars long")


def op2_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    """extract() over all pages."""
    return extract(table(spark, sf_dir, "pages"))


QUERIES = {"op2_html": op2_html}
ORACLE_SQL: dict[str, str] = {}
