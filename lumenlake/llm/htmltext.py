"""Main text of web pages from flat text blocks and a decision tree.

A page is cut into flat blocks at block-level tags. A block's features are its word count and link density,
those of the blocks before and after it, and what its open elements say: an article around it; an element that is never
text (a menu, header, footer, sidebar or form, a class or id that names an advert, notice or comment, by word counts
alone such a block can't be told from a paragraph); or only a name that may mean either (side, widget, share, related),
which leaves the block to its neighbours. A CART tree, trained on the small labelled table below, decides which blocks are
text. Scripts, styles and comments of the markup are no blocks. Page after page is judged from its whole source;
nothing is dropped or capped beyond the tree's choice.

Defined results: null or empty html gives an empty text, as does a page without text blocks; an unclosed tag at
the end of a cut-off page is markup. The work follows a page's length, however deep its elements are. Rows that repeat are judged one by one; extra columns are ignored.
"""

from __future__ import annotations

import html as entities
import re
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import map_arrow

BLOCK_TAGS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form"
    " h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead title tr ul".split()
)
SKIPPED_TAGS = frozenset("script style noscript template iframe object svg math canvas audio video select textarea button option head title".split())
RAW_TAGS = frozenset("script style textarea title noscript iframe template".split())
VOID_TAGS = frozenset("area base br col embed hr img input link meta param source track wbr".split())
CHROME_TAGS = frozenset("nav header footer aside form menu dialog fieldset".split())
_NAMED = r"(?:^|[\s_-])(?:{})(?:$|[\s_-]|\d)"
CHROME_NAMES = re.compile(
    _NAMED.format(
        "ads?|adverts?|advertisement|sponsor(?:ed)?|banner|cookies?|consent|gdpr|notices?|popup|modal|newsletter|subscribe|sidebar"
        "|menu|nav|navbar|navigation|breadcrumbs?|masthead|footer|comments?|comment-list|replies|disqus|respond|login|signup|pagination|pager"
    ),
    re.IGNORECASE,
)
#: Names that stand around text as well as in it.
LOOSE_NAMES = re.compile(_NAMED.format("side|widget|header|promo|alert|share|social|related|recommend(?:ed)?|search|note|box|meta|tags?|author|byline|info"), re.IGNORECASE)
CHROME_ROLES = frozenset("navigation banner contentinfo complementary search alert alertdialog dialog menu menubar form".split())
TAG = re.compile(r"<!--.*?(?:-->|$)|<!\[CDATA\[.*?(?:\]\]>|$)|<[!?][^>]*(?:>|$)|<(/?)([a-zA-Z][^\s/>]*)((?:[^<>\"']|\"[^\"]*\"|'[^']*')*)(?:>|$)|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|$)|</?$", re.DOTALL)
ATTRIBUTE = re.compile(r"([^\s=\"'/>]+)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+))?")
HIDDEN = re.compile(r"display\s*:\s*none", re.IGNORECASE)

FEATURES = ("words", "density", "words_before", "density_before", "words_after", "density_after", "in_article", "in_chrome", "page_has_article", "loose_name")
#: The labelled table: features in the order of FEATURES, then 1 for main text and 0 for the rest.
LABELLED = (
    # running text on pages with an article element
    (180, 0.0, 90, 0.0, 120, 0.0, 1, 0, 1, 0, 1), (60, 0.05, 12, 0.0, 200, 0.0, 1, 0, 1, 0, 1), (25, 0.0, 40, 0.0, 30, 0.1, 1, 0, 1, 0, 1),
    (9, 0.0, 4, 1.0, 60, 0.0, 1, 0, 1, 0, 1), (1, 0.0, 130, 0.0, 1, 0.0, 1, 0, 1, 0, 1), (2, 0.0, 1, 0.0, 80, 0.0, 1, 0, 1, 0, 1),
    (1, 0.0, 90, 0.0, 9, 0.0, 1, 0, 1, 0, 1), (4, 1.0, 60, 0.0, 70, 0.0, 1, 0, 1, 0, 1), (30, 0.6, 25, 0.0, 40, 0.0, 1, 0, 1, 0, 1),
    (7, 0.0, 6, 0.0, 0, 0.0, 1, 0, 1, 0, 1), (12, 0.0, 1, 1.0, 1, 0.0, 1, 0, 1, 0, 1), (400, 0.02, 3, 0.0, 5, 0.5, 1, 0, 1, 0, 1),
    (2, 0.0, 60, 0.0, 9, 1.0, 1, 0, 1, 0, 1), (7, 0.0, 4, 1.0, 12, 1.0, 1, 0, 1, 0, 1), (5, 0.0, 90, 0.0, 3, 1.0, 1, 0, 1, 0, 1), (3, 0.0, 0, 0.0, 1, 1.0, 1, 0, 1, 0, 1), (8, 0.9, 3, 0.0, 2, 0.0, 1, 0, 1, 0, 1), (2, 1.0, 8, 0.0, 6, 1.0, 1, 0, 1, 0, 1),
    # what stands around it: menus, adverts, footers, comments, forms
    (1, 1.0, 0, 0.0, 1, 1.0, 0, 1, 1, 0, 0), (1, 1.0, 1, 1.0, 1, 1.0, 0, 1, 1, 0, 0), (3, 1.0, 1, 1.0, 8, 0.0, 0, 1, 1, 0, 0),
    (8, 0.0, 1, 1.0, 9, 0.0, 0, 1, 1, 0, 0), (12, 0.0, 150, 0.0, 0, 0.0, 0, 1, 1, 0, 0), (9, 0.2, 60, 0.0, 3, 1.0, 0, 1, 1, 0, 0),
    (45, 0.0, 200, 0.0, 30, 0.0, 0, 1, 1, 0, 0), (70, 0.0, 40, 0.0, 65, 0.0, 1, 1, 1, 0, 0), (15, 0.0, 90, 0.0, 80, 0.0, 1, 1, 1, 0, 0),
    (4, 1.0, 60, 0.0, 70, 0.0, 1, 1, 1, 0, 0), (10, 1.0, 90, 0.0, 80, 0.0, 0, 1, 1, 0, 0), (2, 1.0, 120, 0.0, 100, 0.0, 1, 1, 0, 0, 0), (80, 0.1, 100, 0.0, 90, 0.0, 1, 1, 1, 0, 0),
    (2, 0.0, 1, 0.0, 3, 0.0, 1, 1, 1, 0, 0), (6, 1.0, 120, 0.0, 10, 1.0, 1, 1, 1, 0, 0), (20, 0.0, 3, 1.0, 14, 0.0, 0, 0, 1, 0, 0),
    (6, 0.0, 2, 1.0, 9, 0.0, 0, 0, 1, 0, 0), (5, 1.0, 4, 1.0, 6, 1.0, 0, 0, 1, 0, 0), (90, 0.1, 14, 0.0, 60, 0.0, 0, 0, 1, 0, 0), (35, 0.0, 110, 0.0, 20, 0.5, 0, 0, 1, 0, 0),
    # loosely named blocks of an article: text if they are as long as paragraphs, have few links and stand among text
    (40, 0.0, 60, 0.0, 50, 0.0, 1, 0, 1, 1, 1), (25, 0.05, 40, 0.0, 35, 0.0, 1, 0, 1, 1, 1), (90, 0.02, 30, 0.0, 45, 0.1, 1, 0, 1, 1, 1), (18, 0.0, 80, 0.0, 120, 0.0, 1, 0, 1, 1, 1), (60, 0.1, 9, 0.0, 70, 0.0, 1, 0, 1, 1, 1), (140, 0.0, 100, 0.0, 90, 0.0, 1, 0, 1, 1, 1),
    (30, 0.0, 45, 0.0, 12, 0.0, 1, 0, 1, 1, 1), (22, 0.1, 25, 0.0, 0, 0.0, 1, 0, 1, 1, 1),
    (3, 1.0, 60, 0.0, 4, 1.0, 1, 0, 1, 1, 0), (5, 0.8, 4, 1.0, 70, 0.0, 1, 0, 1, 1, 0), (2, 0.0, 90, 0.0, 3, 1.0, 1, 0, 1, 1, 0), (4, 0.0, 40, 0.0, 60, 0.0, 1, 0, 1, 1, 0), (12, 0.7, 30, 0.0, 25, 0.0, 1, 0, 1, 1, 0), (30, 0.9, 50, 0.0, 40, 0.0, 1, 0, 1, 1, 0),
    (6, 0.0, 5, 1.0, 4, 1.0, 1, 0, 1, 1, 0), (8, 0.5, 20, 0.0, 6, 1.0, 1, 0, 1, 1, 0), (1, 1.0, 1, 1.0, 1, 1.0, 1, 0, 1, 1, 0), (7, 0.0, 70, 0.0, 0, 0.0, 1, 0, 1, 1, 0),
    (40, 0.0, 20, 0.0, 30, 0.0, 0, 0, 1, 1, 0), (3, 1.0, 8, 0.0, 5, 1.0, 0, 0, 1, 1, 0), (60, 0.0, 70, 0.0, 80, 0.0, 0, 0, 0, 1, 1), (35, 0.05, 30, 0.0, 60, 0.0, 0, 0, 0, 1, 1), (6, 0.0, 40, 0.0, 5, 1.0, 0, 0, 0, 1, 0), (4, 1.0, 3, 1.0, 30, 0.0, 0, 0, 0, 1, 0),
    # pages without an article element: length and links decide
    (120, 0.0, 60, 0.0, 80, 0.0, 0, 0, 0, 0, 1), (40, 0.05, 5, 0.0, 90, 0.0, 0, 0, 0, 0, 1), (30, 0.0, 2, 1.0, 45, 0.0, 0, 0, 0, 0, 1), (22, 0.1, 70, 0.0, 3, 1.0, 0, 0, 0, 0, 1),
    (15, 0.0, 50, 0.0, 60, 0.0, 0, 0, 0, 0, 1), (6, 0.0, 30, 0.0, 70, 0.0, 0, 0, 0, 0, 1), (3, 0.0, 45, 0.0, 50, 0.0, 0, 0, 0, 0, 1), (7, 0.0, 2, 1.0, 80, 0.0, 0, 0, 0, 0, 1),
    (150, 0.0, 40, 0.0, 6, 0.0, 0, 0, 0, 0, 1), (60, 0.0, 80, 0.0, 0, 0.0, 0, 0, 0, 0, 1), (200, 0.0, 0, 0.0, 0, 0.0, 0, 0, 0, 0, 1), (45, 0.0, 20, 0.0, 4, 1.0, 0, 0, 0, 0, 1),
    (35, 0.1, 3, 1.0, 5, 0.0, 0, 0, 0, 0, 1), (26, 0.0, 60, 0.0, 10, 0.3, 0, 0, 0, 0, 1), (80, 0.2, 8, 0.0, 15, 0.0, 0, 0, 0, 0, 1), (300, 0.05, 100, 0.0, 1, 1.0, 0, 0, 0, 0, 1),
    (60, 0.9, 40, 0.0, 30, 0.0, 0, 0, 0, 0, 0), (40, 0.8, 0, 0.0, 90, 0.0, 0, 0, 0, 0, 0), (3, 0.0, 0, 0.0, 4, 1.0, 0, 0, 0, 0, 0), (2, 0.0, 9, 0.0, 5, 0.0, 0, 0, 0, 0, 0),
    (150, 0.0, 30, 0.0, 60, 0.0, 0, 0, 1, 0, 0), (60, 0.0, 90, 0.0, 0, 0.0, 0, 0, 1, 0, 0), (30, 0.0, 8, 0.0, 100, 0.0, 0, 0, 1, 0, 0), (50, 0.0, 5, 1.0, 40, 0.0, 0, 0, 1, 0, 0), (7, 0.0, 60, 0.0, 70, 0.0, 0, 0, 1, 0, 0),
    (4, 1.0, 3, 1.0, 4, 1.0, 0, 0, 0, 0, 0), (2, 1.0, 0, 0.0, 2, 1.0, 0, 0, 0, 0, 0), (25, 0.9, 3, 1.0, 20, 0.8, 0, 0, 0, 0, 0), (4, 0.0, 3, 1.0, 2, 1.0, 0, 0, 0, 0, 0),
    (6, 0.0, 80, 0.0, 3, 1.0, 0, 0, 0, 0, 0), (5, 0.0, 60, 0.0, 0, 0.0, 0, 0, 0, 0, 0), (30, 0.0, 60, 0.0, 40, 0.0, 0, 1, 0, 0, 0), (80, 0.0, 30, 0.0, 90, 0.0, 0, 1, 0, 0, 0), (3, 0.0, 4, 0.0, 3, 1.0, 0, 1, 0, 0, 0),
)


class Tree:
    """A CART tree (Gini impurity) over rows of features."""

    def __init__(self, x: np.ndarray, y: np.ndarray, depth: int = 9):
        self.leaf, self.cut = float(y.mean()), None
        if depth == 0 or y.min() == y.max():
            return
        best = None
        for f in range(x.shape[1]):
            values = np.unique(x[:, f])
            for at in (values[1:] + values[:-1]) / 2:
                low = x[:, f] <= at
                impurity = sum(s.sum() * y[s].mean() * (1 - y[s].mean()) for s in (low, ~low))
                if best is None or impurity < best[0] - 1e-12:
                    best = impurity, f, at
        if best is not None:
            self.cut = best[1:]
            low = x[:, best[1]] <= best[2]
            self.sides = Tree(x[low], y[low], depth - 1), Tree(x[~low], y[~low], depth - 1)

    def judge(self, x: np.ndarray) -> np.ndarray:
        if self.cut is None:
            return np.full(len(x), self.leaf)
        out, low = np.empty(len(x)), x[:, self.cut[0]] <= self.cut[1]
        out[low], out[~low] = self.sides[0].judge(x[low]), self.sides[1].judge(x[~low])
        return out


@lru_cache(maxsize=1)
def trained() -> Tree:
    rows = np.array(LABELLED, float)
    return Tree(rows[:, :-1], rows[:, -1])


def _chrome(name: str, attributes: str) -> tuple[bool, bool]:
    """Whether an element is never text, and whether it only has a name that may mean either."""
    if name in CHROME_TAGS:
        return True, False
    loose = False
    for found in ATTRIBUTE.finditer(attributes) if attributes else ():
        key, value = found[1].lower(), (found[2] or "").strip("\"'")
        if key == "hidden" or key == "style" and HIDDEN.search(value) or key == "role" and value.lower() in CHROME_ROLES:
            return True, False
        if key in ("class", "id"):
            if CHROME_NAMES.search(value):
                return True, False
            loose |= bool(LOOSE_NAMES.search(value))
    return False, loose


def blocks(source: str) -> list[tuple[str, int, int, bool, bool, bool]]:
    """(text, words, words in links, in an article, in chrome, loosely named) of each flat block of a page, in order."""
    out: list[tuple[str, int, int, bool, bool, bool]] = []
    stack: list[tuple[str, bool, bool, bool, bool]] = []  # name, article, chrome, skipped, loose
    places: defaultdict[str, list[int]] = defaultdict(list)  # where in the stack each name is open
    article = chrome = skipped = loose = False
    links, pieces, linked = 0, [], []

    def flush() -> None:
        nonlocal pieces, linked
        text = " ".join(entities.unescape("".join(pieces)).split())
        if text:
            out.append((text, text.count(" ") + 1, len(entities.unescape("".join(linked)).split()), article, chrome, loose))
        pieces, linked = [], []

    def add(text: str) -> None:
        if text and not skipped:
            pieces.append(text)
            if links:
                linked.append(text)

    def close_from(place: int) -> None:
        nonlocal article, chrome, skipped, loose
        while len(stack) > place:
            places[stack.pop()[0]].pop()
        article, chrome, skipped, loose = stack[-1][1:] if stack else (False, False, False, False)

    at, end = 0, len(source)
    while at < end:
        tag = TAG.search(source, at)
        if tag is None:
            add(source[at:])
            break
        add(source[at : tag.start()])
        at = tag.end()
        close, name, attributes = (tag[1], tag[2], tag[3]) if tag[2] else (tag[4], tag[5], tag[6])
        if not name:
            continue
        name = name.lower()
        if name == "br" or name == "hr":
            add(" ")
        if name in BLOCK_TAGS or name in SKIPPED_TAGS:
            flush()
        if close:
            if name == "a":
                links = max(0, links - 1)
            if places[name]:
                close_from(places[name][-1])
            continue
        if name in RAW_TAGS:
            stop = re.compile(rf"</{name}\b[^>]*(?:>|$)", re.IGNORECASE).search(source, at)
            at = stop.end() if stop else end
            continue
        if name == "a":
            links = 1
        if name in VOID_TAGS or attributes.endswith("/"):
            continue
        if name in BLOCK_TAGS or name in SKIPPED_TAGS:
            if name == "p" and stack and stack[-1][0] == "p" or name == "li" and stack and stack[-1][0] == "li":
                close_from(len(stack) - 1)
            if name == "body":
                article = chrome = skipped = loose = False
            is_chrome, is_loose = (False, False) if name in ("html", "body", "article", "main") else _chrome(name, attributes)
            # A header or footer of the article itself belongs to what is around the text, too.
            article, chrome, skipped, loose = article or name in ("article", "main"), chrome or is_chrome, skipped or name in SKIPPED_TAGS, loose or is_loose
            places[name].append(len(stack))
            stack.append((name, article, chrome, skipped, loose))
    flush()
    return out


def main_text(source: str | None) -> str:
    found = blocks(source or "")
    if not found:
        return ""
    n = np.array([b[1] for b in found], float)
    density = np.array([min(1.0, b[2] / b[1]) for b in found])
    inside, chrome, loose = (np.array([b[k] for b in found], float) for k in (3, 4, 5))
    before, after = (lambda v: np.concatenate([[0], v[:-1]])), (lambda v: np.concatenate([v[1:], [0]]))
    has = np.full(len(n), float((inside * (1 - chrome)).any()))
    x = np.stack([n, density, before(n), before(density), after(n), after(density), inside, chrome, has, loose], 1)
    return " ".join(b[0] for b, p in zip(found, trained().judge(x)) if p > 0.5)


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = [main_text(source) for source in batch.column("html").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])


def extract_text(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of each row."""
    rows = pages.select("page_id", "url", "html")
    return map_arrow(rows, _extract, rows.select("page_id", "url").schema.add("text", "string").add("n_chars", "long"))
