"""Main text of web pages by two passes over their blocks.

First pass: each block is good, bad or undecided by where it stands (menus, forms and the like are
bad), by its link density, its length and its density of stop words; in a language whose stop words
are not known, by whether it has sentences. Articles decide only where they hold the larger part of
the page's running text. Second pass: undecided, mostly short, blocks take the label of the nearest decided block of their part of the page, of the page if
their part has none.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import map_arrow

GOOD, BAD, UNDECIDED = 1, -1, 0
SCHEMA = "page_id long, url string, text string, n_chars long"
ARROW = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("text", pa.string()), ("n_chars", pa.int64())])

STOP_WORDS = {
    "en": "the of and to in is that it was for on are as with they be at this from by have or had not but what were when your can said there an each which she do how their if will up other about out many then them these so some her would make like him into has".split(),
    "fr": "de la le et les des en un du une que est pour qui dans par plus pas au sur ne se ce il sont avec ou son aux ses mais on comme tout nous sa elle cette leur y a été même deux aussi bien".split(),
    "de": "der die und in den von zu das mit sich des auf für ist im dem nicht ein eine als auch es an werden aus er hat dass sie nach wird bei einer um am sind noch wie einem über einen so zum war haben nur oder aber vor zur".split(),
    "es": "de la que el en y a los se del las un por con no una su para es al lo como más pero sus le ya o este sí porque esta entre cuando muy sin sobre también me hasta hay donde quien desde todo".split(),
    "it": "di e il la che in un per è una sono non si del con da le i della come anche più dei nel ma al gli alla questo lo ha".split(),
    "pt": "de e o que do da em um para com não uma os no se na por mais as dos como mas ao ele das à seu sua ou quando muito nos já".split(),
    "nl": "de en van het een in is dat op te zijn met voor niet aan er die als ook om maar door naar bij uit dan nog wel werd".split(),
    "ru": "и в не на что он с как это по но из у за то к все она так его от о бы же для мы вы был они".split(),
}
#: Characters that take the place of stop words where words are not set apart.
STOP_CHARACTERS = frozenset("的了是在和有不这为我他们也就到说要以于而与其中のはをにがとでてたしるいもなか")
UNSPACED = re.compile(r"[\u3040-\u30ff\u3400-\u9fff\uf900-\ufaff]")
ENDS = re.compile("[.!?。！？]")
#: A line of dates and rights: a sign or a year, and no sentence.
RIGHTS = re.compile(r"©|\([cC]\)\s|\bcopyright\b|\b(?:19|20)\d\d\b", re.I)
#: The languages of each stop word, as bits.
_LANGUAGES: dict[str, int] = {}
for _k, _words in enumerate(STOP_WORDS.values()):
    for _w in _words:
        _LANGUAGES[_w] = _LANGUAGES.get(_w, 0) | 1 << _k

BLOCK = frozenset("address article aside blockquote body button center dd details dialog dir div dl dt fieldset figcaption figure footer form frame frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre section select summary table tbody tfoot thead title tr ul".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Raw text, or nothing that is read.
SKIPPED = "script|style|noscript|template|textarea|iframe|object|svg|math|canvas|audio|video|title|select|noframes"
BAD_TAGS = frozenset("nav footer aside form menu dialog button fieldset head".split())
BAD_ROLES = frozenset("navigation banner contentinfo complementary search alert alertdialog dialog menu menubar toolbar form".split())
BAD_NAMES = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense banner breadcrumb breadcrumbs comment comments commentlist consent cookie cookies copyright disclaimer discussion disqus footer footnav gdpr login menu modal nav navbar navigation newsletter notice notices notification overlay pager pagination popup promo promoted promotion reactions recommended related replies reply respond share sharing sidebar signup skip social sponsor sponsored subscribe subscription toolbar topbar widget widgets".split()
)
#: Names that also stand for subjects: bad alone or with words of layout, but not as in "share-price".
AMBIGUOUS = frozenset("banner copyright disclaimer discussion login menu notice notices overlay promo related respond share sharing skip social".split())
LAYOUT = frozenset("area bar bars block body bottom box btn btns button buttons col column container content footer group head header icon icons inner item items left links list main media message module nav outer panel post posts right row section site stories tools top widget wrap wrapper".split())
#: Only bad outside an article, which may have a header of its own.
BAD_OUTSIDE = frozenset("header masthead".split())
ARTICLE = frozenset(("article", "main"))
CLOSES_P = BLOCK - {"button", "option", "optgroup"}

TOKEN = re.compile(
    rf"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<({SKIPPED})(?=[\s/>])(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+>.*?(?:</\1\s*>|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)(?:>|\Z)|<[!?/][^>]*+(?:>|\Z)",
    re.S | re.I,
)
ATTRIBUTE = re.compile(r"(class|id|role|style|aria-hidden|hidden)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?(?=[\s/>]|\Z)", re.I)
NAME = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")


@dataclass
class Block:
    text: str
    linked: int
    bad_place: bool
    article: int
    tag: str
    label: int = UNDECIDED


@dataclass
class _Open:
    tag: str
    bad: bool
    article: int
    closed: bool = False


ROOT = _Open("", False, 0)
WITHIN = ("table", "td", "th", "button", "article", "div", "section", "main", "blockquote", "li")


@dataclass
class _Reader:
    """Open elements; their places are kept by tag as well, so that no step looks through all of them."""

    stack: list[_Open] = field(default_factory=list)
    places: dict[str, list[int]] = field(default_factory=dict)
    in_blocks: list[int] = field(default_factory=list)
    blocks: list[Block] = field(default_factory=list)
    parts: list[str] = field(default_factory=list)
    linked: int = 0
    links: int = 0
    breaks: int = 0
    articles: int = 0

    def close_block(self) -> None:
        text = " ".join(entities.unescape("".join(self.parts)).split())
        if text:
            top = self.stack[-1] if self.stack else ROOT
            tag = self.stack[self.in_blocks[-1]].tag if self.in_blocks else ""
            self.blocks.append(Block(text, min(self.linked, len(text)), top.bad, top.article, tag))
        self.parts.clear()
        self.linked = self.breaks = 0

    def text(self, piece: str) -> None:
        if not piece:
            return
        self.parts.append(piece)
        if self.links:
            self.linked += len(" ".join(piece.split()))
        if self.breaks and not piece.isspace():
            self.breaks = 0

    def start(self, tag: str, attributes: str) -> None:
        if tag == "br":
            self.breaks += 1
            self.close_block() if self.breaks > 1 else self.parts.append(" ")
            return
        if tag in BLOCK:
            self.close_block()
            if tag in CLOSES_P:
                self.end("p", WITHIN)
            if tag == "li":
                self.end("li", ("ul", "ol", "menu"))
        elif tag in ("td", "th"):
            self.parts.append(" ")
        if tag in VOID:
            return
        outer = self.stack[-1] if self.stack else ROOT
        article = outer.article
        if tag in ARTICLE and not article:
            self.articles += 1
            article = self.articles
        self.places.setdefault(tag, []).append(len(self.stack))
        if tag in BLOCK:
            self.in_blocks.append(len(self.stack))
        self.stack.append(_Open(tag, outer.bad or _bad_place(tag, attributes, bool(outer.article)), article))
        self.links += tag == "a"

    def _last(self, tag: str) -> int:
        own = self.places.get(tag)
        return own[-1] if own else -1

    def end(self, tag: str, within: tuple = ()) -> None:
        """Close the last open element of the tag; not if one of within was opened after it."""
        at = self._last(tag)
        if at < 0 or any(self._last(w) > at for w in within):
            return
        # an inline element that was never closed ends no block around it
        if tag not in BLOCK and self.in_blocks and self.in_blocks[-1] > at:
            self.links -= tag == "a"
            self.places[tag].pop()
            self.stack[at].closed = True
            return
        if tag in BLOCK:
            self.close_block()
        while len(self.stack) > at:
            own = self.stack.pop()
            if not own.closed:
                self.places[own.tag].pop()
                self.links -= own.tag == "a"
            if own.tag in BLOCK:
                self.in_blocks.pop()


def _bad_place(tag: str, attributes: str, in_article: bool) -> bool:
    if tag in BAD_TAGS or tag == "header" and not in_article:
        return True
    if not attributes or tag in ("html", "body"):
        return False
    for m in ATTRIBUTE.finditer(attributes):
        kind, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if kind in ("class", "id"):
            names = set()
            for token in value.split():
                own = {n.lower() for n in NAME.findall(token)}
                # an ambiguous name counts if all other words beside it are names of places or of layout
                names |= own if own <= BAD_NAMES | BAD_OUTSIDE | LAYOUT else own - AMBIGUOUS
            if tag in ARTICLE and not names & {"comment", "comments", "reply", "ad", "sponsored", "promo"}:
                continue
            if names & BAD_NAMES or not in_article and names & BAD_OUTSIDE:
                return True
        elif kind == "role" and value.lower() in BAD_ROLES:
            return True
        elif kind == "hidden" or kind == "aria-hidden" and value == "true" or kind == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
            return True
    return False


def read_blocks(page: str) -> list[Block]:
    """Blocks of a page in order, with their text, linked characters and place."""
    r, at = _Reader(), 0
    for m in TOKEN.finditer(page):
        r.text(page[at : m.start()])
        at = m.end()
        tag = (m[3] or m[6] or "").lower()
        if tag:
            r.end(tag) if m[2] or m[5] else r.start(tag, m[4] or m[7] or "")
    r.text(page[at:])
    r.close_block()
    return r.blocks


def _unspaced(text: str) -> int:
    return 0 if text.isascii() else len(UNSPACED.findall(text))


def stop_density(text: str) -> float:
    """Share of words that are stop words of the language that has most of them; of characters, where words are not set apart."""
    unspaced = _unspaced(text)
    if unspaced > len(text) / 3:
        return 2 * sum(c in STOP_CHARACTERS for c in text) / unspaced
    own = text.lower().split()
    held = Counter(map(_LANGUAGES.get, own))
    held.pop(None, None)
    return max(sum(n for bits, n in held.items() if bits >> k & 1) for k in range(len(STOP_WORDS))) / len(own) if held else 0.0


def has_sentence(text: str) -> bool:
    """Whether some words of 20 characters or more end as a sentence does; in an unspaced script any such end will do."""
    parts = ENDS.split(text)
    return any(len(p.strip()) >= 20 for p in parts[:-1]) or len(parts) > 1 and _unspaced(text) > len(text) / 3


def _size(text: str) -> int:
    """Length of a text, a character of an unspaced script counted as three."""
    return len(text) + 2 * _unspaced(text)


def classify(blocks: list[Block], length: int = 70, stop: float = 0.2, link: float = 0.5) -> list[Block]:
    """Label the blocks good or bad.

    Bad: in a bad place, a link density above link, or short and a line of dates and rights. Good: at
    least length characters and a stop word density of stop or more; where no block of the page reaches
    that, at least length characters and a sentence; in an article length alone is enough. Articles
    count if they hold at least as many characters of long blocks as the rest of the page holds in good
    ones. The rest inherits: within an article, where nothing is decided, blocks are good; elsewhere the
    nearer of the decided blocks before and after counts, good winning a tie and blocks in bad places left
    aside, and where no block is decided all are good.
    """
    for b in blocks:
        if b.bad_place or b.linked > link * len(b.text) or len(b.text) < length and b.tag[:1] != "h" and RIGHTS.search(b.text) and not has_sentence(b.text):
            b.label = BAD
    long = [b for b in blocks if not b.label and _size(b.text) >= length]
    inside = sum(len(b.text) for b in long if b.article)
    dense = []
    if not any(b.article and not b.bad_place for b in blocks) or inside < sum(len(b.text) for b in long if not b.article):
        dense = [b for b in long if stop_density(b.text) >= stop] or [b for b in long if has_sentence(b.text)]
    if inside < sum(len(b.text) for b in dense if not b.article):
        for b in blocks:
            b.article = 0
    articles = any(b.article and not b.bad_place for b in blocks)
    for b in long if articles else dense:
        if b.article or not articles:
            b.label = GOOD
    for article in {b.article for b in blocks}:
        part = [b for b in blocks if b.article == article and not b.bad_place and not (article and b.label == BAD)]
        if article and not any(b.label == GOOD for b in part):
            for b in part:
                b.label = GOOD
        elif not article and articles:
            for b in part:
                b.label = b.label or BAD
        else:
            _inherit(part)
    return blocks


def _inherit(part: list[Block]) -> None:
    labels = [b.label for b in part]
    n = len(part)
    before, after = [(n + 1, 0)] * n, [(n + 1, 0)] * n
    for i in range(n):
        before[i] = (0, labels[i]) if labels[i] else (before[i - 1][0] + 1, before[i - 1][1]) if i else (n + 1, 0)
    for i in reversed(range(n)):
        after[i] = (0, labels[i]) if labels[i] else (after[i + 1][0] + 1, after[i + 1][1]) if i + 1 < n else (n + 1, 0)
    for i, b in enumerate(part):
        if not b.label:
            near = [x for x in (before[i], after[i]) if x[1]]
            best = min((x[0] for x in near), default=0)
            b.label = max((x[1] for x in near if x[0] == best), default=GOOD)


def extract(page: str | None) -> str:
    """Main text of a page: its good blocks, one a line; empty for an empty or null page."""
    return "\n".join(b.text for b in classify(read_blocks(page)) if b.label == GOOD) if page else ""


def _run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, 500):
            some = batch.slice(at, 500)
            texts = [extract(h.as_py()) for h in some.column("html")]
            yield pa.RecordBatch.from_arrays([some.column("page_id"), some.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], schema=ARROW)


def extract_pages(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars of every row, nulls and repeated rows included; a null html has an empty text.

    Pages of any length are read whole, in time that grows with their length; of ties between neighbours
    the good one wins. Other columns of pages are not read, whatever their names, and an empty table
    gives an empty result.
    """
    return map_arrow(pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), "html"), _run, SCHEMA)


def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_pages(spark.read.parquet(f"{sf_dir}/pages.parquet"))
