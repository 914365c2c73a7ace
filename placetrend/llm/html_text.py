"""The main text of web pages, from parser events."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from placetrend.llm.shared import small

#: Spread of the Gaussian, in lines, and the share of the ratios' deviation that makes the threshold.
SIGMA = 1.0
THRESHOLD = 0.5

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 "
    "h5 h6 head header hr html legend li main menu nav ol option p pre section summary table tbody tfoot thead tr ul".split()
)
#: Elements that hold no article text, wherever they stand.
BARE = frozenset(
    "aside button canvas datalist dialog embed footer form head iframe input menu nav noframes noscript object script select "
    "style svg template textarea title".split()
)
CONTAINERS = frozenset("article body center div html main section table tbody td tr".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Words of a class, id or role that mark what surrounds an article, also inside it.
MARKS = frozenset(
    "ad ads adslot adsense advert adverts advertisement breadcrumb breadcrumbs comment comments complementary consent "
    "contentinfo cookie cookies disqus footer gdpr login masthead menu menubar modal nav navbar navigation newsletter pagination "
    "popup promo promoted recommended related replies reply respond share sharing sidebar signup skip social sponsor sponsored "
    "subscribe tablist toolbar topbar".split()
)
#: Words that do so outside an article; inside, only an element of links or of little text.
WEAK_MARKS = frozenset("banner dialog form header notice notices notification search widget widgets".split())
#: Beside one of these in the same name a word tells the layout of a wrapper, or the part of an article.
NAMES_A_WRAPPER = frozenset("has with without no".split())
NAMES_CONTENT = frozenset("article content entry headline post story title".split())
#: Text to tags below which an element holds little text, and the share of linked text from which it is links.
LITTLE_TEXT = 8
LINKED = 0.5
CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])|[^A-Za-z]+")


@dataclass(eq=False)
class Element:
    tag: str
    parent: Element | None
    article: bool
    link: bool = False
    strong: bool = False
    weak: bool = False
    content: bool = False
    hidden: bool = False
    #: Of all that it holds: characters, those in links, tags, an h1 or h2, an article or main.
    chars: int = 0
    linked: int = 0
    tags: int = 0
    titled: bool = False
    whole: bool = False
    gone: bool = False

    def up(self) -> Iterator[Element]:
        at: Element | None = self
        while at is not None:
            yield at
            at = at.parent


@dataclass
class Line:
    """The text of one block up to the next block tag, and the tags met meanwhile."""

    within: Element
    parts: list[str] = field(default_factory=list)
    tags: int = 0
    linked: int = 0

    def text(self) -> str:
        return " ".join("".join(self.parts).split())


def _marks(attributes: list[tuple[str, str | None]]) -> tuple[bool, bool, bool, bool]:
    """Whether the attributes mark surroundings strongly, weakly, name content, or hide the element."""
    strong = weak = content = hidden = False
    for name, value in attributes:
        if name in ("class", "id", "role") and value:
            for one in value.split():
                words = {w.lower() for w in CAMEL.split(one) if w}
                if words & NAMES_A_WRAPPER:
                    continue
                strong = strong or bool(words & MARKS)
                content = content or bool(words & NAMES_CONTENT)
                weak = weak or bool(words & WEAK_MARKS) and not words & NAMES_CONTENT
        hidden = hidden or name == "hidden" or (name == "aria-hidden" and value == "true")
    return strong, weak, content, hidden


class PageLines(HTMLParser):
    """Turns parser events into elements and what they hold in page order. Elements left open are closed
    where their parent ends, and a paragraph where the next block starts."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.top = Element("", None, False)
        self.elements = [self.top]
        #: Of the element on top: its text, the number one for a tag, or None where a block starts or ends.
        self.events: list[tuple[Element, str | int | None]] = []

    def handle_starttag(self, tag: str, attributes: list[tuple[str, str | None]]) -> None:
        if tag in BLOCK:
            self._close("p", CONTAINERS)
            if tag in ("li", "dt", "dd", "option", "tr"):
                self._close(tag, CONTAINERS - {"tr"} | {"ul", "ol", "dl", "select"})
        elif tag in ("br", "td", "th"):
            self.events.append((self.top, " "))
        if tag not in VOID:
            up = self.top
            inside = tag in ("article", "main") or up.article or ("role", "main") in attributes
            self.top = Element(tag, up, inside, up.link or tag == "a", *_marks(attributes))
            self.elements.append(self.top)
        if tag in BLOCK:
            self.events.append((self.top, None))
        self.events.append((self.top, 1))

    def handle_startendtag(self, tag: str, attributes: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attributes)

    def handle_endtag(self, tag: str) -> None:
        self.events.append((self.top, 1))
        self._close(tag, frozenset(("article", "body")) if tag not in CONTAINERS else frozenset())

    def _close(self, tag: str, stop: frozenset[str]) -> None:
        """Leave the innermost open ``tag``, unless an element of ``stop`` stands between."""
        block = False
        for at in self.top.up():
            block = block or at.tag in BLOCK
            if at.tag == tag:
                self.top = at.parent or self.top
                if block:
                    self.events.append((self.top, None))
                return
            if at.tag in stop:
                return

    def handle_data(self, data: str) -> None:
        self.events.append((self.top, data))

    def lines(self) -> list[Line]:
        """The lines of what is no surroundings; text that is left out breaks no line."""
        self._judge()
        lines = [Line(self.elements[0])]
        for element, event in self.events:
            if event is None:
                if lines[-1].parts:
                    lines.append(Line(element))
                lines[-1].within = element
            elif event == 1:
                lines[-1].tags += 1
            elif not element.gone:
                lines[-1].parts.append(event)
                lines[-1].linked += len(event) if element.link else 0
        return lines

    def _judge(self) -> None:
        """Which elements go, with all they hold. A word alone drops no element that holds the article, or
        most of a page without one; in an article a weak one needs links or little text to go with it."""
        for element, event in self.events:
            if event == 1:
                element.tags += 1
            elif event is not None and not any(e.tag in BARE and e.tag != "form" for e in _near(element)):
                size = len(event.strip())
                element.chars += size
                element.linked += size if element.link else 0
        for e in reversed(self.elements[1:]):
            up = e.parent
            up.chars, up.linked, up.tags = up.chars + e.chars, up.linked + e.linked, up.tags + e.tags
            up.titled = up.titled or e.titled or e.tag in ("h1", "h2")
            up.whole = up.whole or e.whole or (e.article and not up.article and e.tag not in BARE)
        page = self.elements[0]
        for e in self.elements[1:]:
            within = e.parent.article
            most = 2 * e.chars > page.chars and (e.titled or 5 * e.chars > 4 * page.chars)
            holds = e.whole or (not page.whole and most)
            poor = e.chars < LITTLE_TEXT * e.tags or e.linked >= LINKED * max(e.chars, 1)
            block = e.tag in BLOCK
            if e.tag in BARE:
                own = not (e.tag == "form" and holds)
            elif e.tag == "header":
                own = not (e.article or holds or e.content)
            elif e.tag in ("html", "body", "main") or e.tag in HEADINGS:
                own = False
            elif e.tag == "article":
                own = within and (e.strong or e.weak)
            else:
                own = block and not holds and (e.strong and (e.tag != "p" or poor) or e.weak and (not within or poor) and not (within and e.titled))
            e.gone = e.parent.gone or own or e.hidden


def _near(element: Element) -> Iterator[Element]:
    """The element and those around it up to its block."""
    for at in element.up():
        yield at
        if at.tag in BLOCK:
            return


def smoothed(values: np.ndarray, sigma: float = SIGMA) -> np.ndarray:
    """Gaussian smoothing; beyond the ends there is nothing."""
    reach = int(np.ceil(3 * sigma))
    kernel = np.exp(-0.5 * (np.arange(-reach, reach + 1) / sigma) ** 2)
    return np.convolve(values, kernel / kernel.sum(), "full")[reach : reach + len(values)]


def _region(lines: list[Line], texts: list[str]) -> Element | None:
    """The element that holds the content: where lines of a high smoothed text-to-tag ratio cluster.

    Every line above the threshold gives its length to the elements around it. An article or main
    element with the most wins, all of it. Without one, the deepest container that has nine tenths is
    widened until it holds all lines above the threshold that are not mostly links, every h1, and
    headings beside or above it.
    """
    sizes = np.array([len(t) for t in texts], float)
    ratios = smoothed(sizes / np.maximum([line.tags for line in lines], 1))
    content = ratios >= THRESHOLD * ratios.std()
    votes: dict[Element, float] = {}
    for line, size, chosen in zip(lines, sizes, content, strict=True):
        if chosen:
            for element in line.within.up():
                votes[element] = votes.get(element, 0) + size
    total = sizes[content].sum()
    named = [e for e in votes if e.article and not (e.parent and e.parent.article)]
    if named:
        return max(named, key=lambda e: votes[e])
    wide = [e for e in votes if (e.tag in CONTAINERS or not e.tag) and votes[e] >= 0.9 * total]
    best = max(wide, key=lambda e: sum(1 for _ in e.up()), default=None)
    if best is None:
        return None
    around = set(best.up())
    held, needed = dict.fromkeys(around, 0), 0
    for line, size, chosen in zip(lines, sizes, content, strict=True):
        if (chosen and 2 * line.linked < size) or any(e.tag == "h1" or (e.tag in HEADINGS and e.parent in around) for e in line.within.up()):
            needed += 1
            for element in line.within.up():
                if element in held:
                    held[element] += 1
    return next(e for e in best.up() if (e.tag in CONTAINERS or not e.tag) and held[e] == needed)


def main_text(html: str) -> str:
    """The blocks of a page's article in page order, one per line; empty if there is none."""
    parser = PageLines()
    # in HTML, marked sections are comments up to the next angle bracket
    parser.feed(html.replace("<![", "<! ["))
    parser.close()
    lines = parser.lines()
    texts = [line.text() for line in lines]
    lines, texts = [x for x, t in zip(lines, texts, strict=True) if t], [t for t in texts if t]
    region = _region(lines, texts) if texts else None
    return "\n".join(t for line, t in zip(lines, texts, strict=True) if region in line.within.up())


def extract_text(pages: DataFrame, id_column: str = "page_id", url_column: str = "url", html_column: str = "html") -> DataFrame:
    """One row per row of ``pages``: ``page_id``, ``url``, ``text``, ``n_chars`` (code points).

    The whole html is read. Null or empty html gives an empty text, as does a page without an
    article. Null ids and urls stay, repeated rows give repeated rows, other columns are not read.
    Nothing is shuffled; memory is bounded by a batch of pages.
    """

    def run(batches):
        for batch in small(batches):
            texts = [main_text(h) if h else "" for h in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                ["page_id", "url", "text", "n_chars"],
            )

    kinds = [pages.schema[c].dataType.simpleString() for c in (id_column, url_column)]
    return pages.select(F.col(id_column).alias("page_id"), F.col(url_column).alias("url"), html_column).mapInArrow(
        run, f"page_id {kinds[0]}, url {kinds[1]}, text string, n_chars bigint"
    )
