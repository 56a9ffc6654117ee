"""Main text of web pages: flat text blocks classified by a decision tree.

A page becomes a flat list of text blocks.  Every block has its number of
words and link density, those of the block before and after it, and what its
enclosing elements say about themselves (article, navigation, advert, ...).  A
decision tree trained on the small labelled table below says which blocks are
content; their texts are joined in page order.  Where elements name their
roles that is one feature of the tree and mostly settles the matter; elsewhere
the measures of the block and its neighbours decide.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import text_or_empty

ROWS_PER_BATCH = 512

# Elements of HTML by their role.
BLOCK_TAGS = frozenset(
    "address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html "
    "legend li main menu nav noscript ol option p pre section select summary table tbody td tfoot th thead title tr ul".split()
)
RAW_TAGS = frozenset("script style textarea title xmp iframe noembed noframes template audio video canvas".split())
VOID_TAGS = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements that a new block closes implicitly: an open ``p`` by any block, ``li`` by ``li`` and so on.
CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
SECTION_TAGS = frozenset("article aside body div footer form header html main nav section table ul ol dl fieldset".split())

#: What the enclosing elements say.
HINTS = ("in_article", "in_navigation", "in_margin", "in_advert", "in_comments", "in_form", "in_head")
#: Of these hints the tree sees one feature: 1 for an article, -1 for any of the others, 0 where nothing is named.
FEATURES = ("words", "link_density", "words_before", "link_density_before", "words_after", "link_density_after", "role")
_NAMES = {
    "in_navigation": re.compile(r"(^|[\s_-])(nav|navbar|navigation|menu|breadcrumbs?|toc|pagination|pager|tabs)([\s_-]|$)", re.I),
    "in_margin": re.compile(r"(^|[\s_-])(footer|header|masthead|sidebar|side|aside|cookies?|consent|notice|banner|copyright|legal|related|social|share|newsletter|widget|popup|modal)([\s_-]|$)", re.I),
    "in_advert": re.compile(r"(^|[\s_-])(ads?|advert|advertisement|advertising|sponsor|sponsored|promo|promotion|adsense)([\s_-]|$)", re.I),
    "in_comments": re.compile(r"(^|[\s_-])(comments?|replies|reply|discussion|disqus|respond|guestbook|reviews)([\s_-]|$)", re.I),
    "in_form": re.compile(r"(^|[\s_-])(form|login|signup|subscribe|search|searchbox)([\s_-]|$)", re.I),
    "in_article": re.compile(r"(^|[\s_-])(article|articlebody|post-?body|entry-?content|post-?content|main-?content|content|story)([\s_-]|$)", re.I),
}
#: A name with one of these parts tells what an element has or lacks, such as ``with-sidebar``, not what it is.
_MODIFIERS = frozenset("with without has no non none not hide hidden show".split())
_TAG_HINT = {"article": "in_article", "main": "in_article", "nav": "in_navigation", "menu": "in_navigation", "header": "in_margin", "footer": "in_margin", "aside": "in_margin", "form": "in_form", "button": "in_form", "select": "in_form", "fieldset": "in_form", "dialog": "in_margin", "head": "in_head"}
_NAME_TAGS = frozenset("div section article aside ul ol table p span header footer nav main form dl".split())

#: Comments and declarations, then a tag with closed quotes, then one that ends at the first > because a quote stays open.
_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*+(?:>|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']|\"[^\"]*+\"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>",
    re.S,
)
_TAG_START = re.compile(r"<[a-zA-Z/!?]")
_ATTRIBUTE = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)

#: The labelled table: example pages as sequences of blocks (words, words in links, role, 1 for content).
#: The neighbours' measures follow from the sequence.
LABELLED: tuple[tuple[tuple[int, int, int, int], ...], ...] = (
    # Elements name their roles; blocks of any measure.
    ((2, 2, -1, 0), (1, 1, -1, 0), (3, 3, -1, 0), (12, 0, -1, 0), (9, 0, 1, 1), (70, 0, 1, 1), (35, 4, 1, 1), (1, 0, 1, 1), (90, 0, 1, 1), (6, 0, -1, 0)),
    ((25, 0, -1, 0), (3, 0, 1, 1), (2, 0, 1, 1), (120, 9, 1, 1), (5, 5, 1, 1), (40, 0, -1, 0), (60, 2, -1, 0), (2, 2, -1, 0)),
    ((4, 0, -1, 0), (6, 0, 1, 1), (1000, 0, 1, 1), (14, 0, 1, 1), (8, 0, -1, 0), (1, 1, -1, 0), (200, 0, -1, 0), (30, 0, -1, 0)),
    ((1, 1, -1, 0), (1, 0, 1, 1), (3, 1, -1, 0)),
    ((2, 0, 1, 1), (3, 0, 1, 1), (1, 0, 1, 1), (5, 0, 1, 1), (2, 0, 1, 1), (1, 0, 1, 1)),
    ((4, 4, 1, 1), (2, 2, 1, 1), (9, 0, 1, 1), (30, 30, 1, 1), (12, 5, 1, 1), (3, 3, 1, 1)),
    ((12, 12, 1, 1), (50, 0, 1, 1), (4, 1, 1, 1), (18, 9, 1, 1), (1, 1, 1, 1)),
    ((2, 2, 1, 1), (3, 3, 1, 1), (1, 1, 1, 1), (20, 20, 1, 1), (2, 2, 1, 1)),
    ((7, 0, 1, 1), (9, 0, 1, 1), (4, 0, 1, 1), (12, 0, 1, 1), (8, 0, 1, 1), (26, 0, 1, 1), (5, 0, 1, 1), (14, 0, 1, 1)),
    ((6, 0, 1, 1),),
    ((3, 3, -1, 0), (2, 2, 1, 1), (12, 0, 1, 1), (16, 0, -1, 0)),
    ((25, 0, 1, 1), (8, 8, 1, 1), (2, 0, 1, 1), (7, 7, 1, 1), (19, 0, 1, 1), (1, 0, 1, 1)),
    ((80, 0, -1, 0), (95, 0, -1, 0), (150, 3, -1, 0), (11, 0, -1, 0), (60, 0, -1, 0)),
    # No roles: menu, headline, paragraphs with a short one among them, copyright line.
    ((2, 2, 0, 0), (1, 1, 0, 0), (3, 3, 0, 0), (2, 2, 0, 0), (8, 0, 0, 1), (65, 0, 0, 1), (44, 3, 0, 1), (1, 0, 0, 1), (80, 0, 0, 1), (32, 0, 0, 1), (6, 0, 0, 0)),
    ((1, 1, 0, 0), (2, 2, 0, 0), (1, 1, 0, 0), (11, 0, 0, 1), (25, 0, 0, 1), (4, 0, 0, 1), (30, 0, 0, 1), (9, 0, 0, 0)),
    # An advertisement between menu and headline; a short last paragraph.
    ((1, 1, 0, 0), (2, 2, 0, 0), (12, 0, 0, 0), (7, 0, 0, 1), (52, 0, 0, 1), (2, 0, 0, 1), (28, 1, 0, 1), (3, 0, 0, 1), (7, 0, 0, 0)),
    ((3, 3, 0, 0), (1, 1, 0, 0), (9, 0, 0, 0), (10, 0, 0, 1), (110, 0, 0, 1), (75, 6, 0, 1), (5, 0, 0, 0)),
    # A notice first; lists of links after the text.
    ((19, 0, 0, 0), (2, 2, 0, 0), (2, 2, 0, 0), (6, 0, 0, 1), (41, 0, 0, 1), (37, 2, 0, 1), (3, 0, 0, 0), (7, 7, 0, 0), (6, 6, 0, 0), (8, 8, 0, 0), (4, 2, 0, 0)),
    ((14, 2, 0, 0), (1, 1, 0, 0), (5, 0, 0, 1), (300, 12, 0, 1), (16, 0, 0, 1), (48, 0, 0, 1), (25, 22, 0, 0), (12, 12, 0, 0)),
    # Short lines in a row, such as a dialogue, with and without longer ones.
    ((2, 2, 0, 0), (1, 1, 0, 0), (10, 0, 0, 0), (7, 0, 0, 1), (9, 0, 0, 1), (4, 0, 0, 1), (12, 0, 0, 1), (8, 0, 0, 1), (5, 0, 0, 1), (14, 0, 0, 1), (6, 0, 0, 0)),
    ((1, 1, 0, 0), (3, 3, 0, 0), (8, 0, 0, 0), (12, 0, 0, 1), (16, 0, 0, 1), (6, 0, 0, 1), (33, 0, 0, 1), (10, 0, 0, 1), (2, 0, 0, 1), (9, 0, 0, 0)),
    ((2, 2, 0, 0), (6, 0, 0, 0), (5, 0, 0, 1), (18, 1, 0, 1), (24, 0, 0, 1), (3, 0, 0, 1), (7, 0, 0, 1), (11, 0, 0, 0)),
    # Text and nothing else; links and nothing else.
    ((40, 0, 0, 1),),
    ((60, 0, 0, 1), (55, 0, 0, 1), (58, 0, 0, 1)),
    ((2, 2, 0, 0), (3, 3, 0, 0), (2, 2, 0, 0), (20, 18, 0, 0), (1, 1, 0, 0)),
)


def labelled_table() -> np.ndarray:
    """Rows of FEATURES and the label."""
    rows = []
    for page in LABELLED:
        found = [Block("", words, links / words, tuple(int(h == (HINTS[0] if role > 0 else HINTS[2])) if role else 0 for h in HINTS)) for words, links, role, _ in page]
        rows.append(np.column_stack([features(found), [label for *_, label in page]]))
    return np.concatenate(rows)


@dataclass
class Block:
    text: str
    words: int
    link_density: float
    hints: tuple[int, ...]


def blocks(page: str) -> list[Block]:
    """Flat text blocks of a page in page order.

    Comments and the contents of scripts, styles and other raw elements are no
    text; a raw element without an end tag ends at the next tag.  A tag whose
    quote stays open ends at its first ``>``, and one without ``>`` is dropped.
    Unclosed elements end with their section; stray end tags are ignored.
    Character references are decoded once, white space becomes one space, and
    blocks without text are left out.
    """
    out: list[Block] = []
    stack: list[tuple[str, tuple[int, ...]]] = []
    none = (0,) * len(HINTS)
    parts: list[str] = []
    linked: list[str] = []
    in_link = 0
    at = 0
    hints = none

    def flush() -> None:
        if parts:
            text = " ".join(entities.unescape("".join(parts)).split())
            if text:
                inside = " ".join(entities.unescape("".join(linked)).split()) if linked else ""
                words = text.count(" ") + 1
                out.append(Block(text, words, min(1.0, (inside.count(" ") + 1) / words) if inside else 0.0, hints))
            parts.clear()
            linked.clear()

    def add(text: str) -> None:
        parts.append(text)
        if in_link:
            linked.append(text)

    length = len(page)
    last = page.rfind(">") + 1  # no tag ends after it
    endless: set[str] = set()  # raw elements without a further end tag
    while at < length:
        m = _TOKEN.search(page, at, last)
        if m is None:
            rest = page[at:last] + page[max(at, last) :]
            cut = _TAG_START.search(rest)
            add(rest[: cut.start()] if cut else rest)
            break
        if m.start() > at:
            add(page[at : m.start()])
        at = m.end()
        closes, name, attributes = (m[1], m[2], m[3]) if m[2] else (m[4], m[5], m[6])
        if name is None:
            continue
        name = name.lower()
        if not closes and name in RAW_TAGS and not attributes.rstrip().endswith("/"):
            end = None if name in endless else re.compile(rf"</{re.escape(name)}[\s/>]", re.I).search(page, at)
            if end:
                at = page.find(">", end.end() - 1) + 1 or length
            else:
                endless.add(name)
                following = _TAG_START.search(page, at)
                at = following.start() if following else length
            if name in BLOCK_TAGS:
                flush()
            continue
        if name == "br":
            add(" ")
            continue
        if name == "a":
            in_link = 0 if closes else 1
            continue
        if name not in BLOCK_TAGS:
            continue
        flush()
        if closes:
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == name:
                    del stack[k:]
                    in_link = 0
                    break
                if stack[k][0] in SECTION_TAGS and name not in SECTION_TAGS:
                    break
        elif name not in VOID_TAGS:
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == "p" or stack[k][0] in CLOSES.get(name, ()):
                    del stack[k:]
                    break
                if stack[k][0] in SECTION_TAGS:
                    break
            outer = stack[-1][1] if stack else none
            stack.append((name, _hints(name, attributes, outer)))
        hints = stack[-1][1] if stack else none
    flush()
    return out


def _hints(name: str, attributes: str, outer: tuple[int, ...]) -> tuple[int, ...]:
    own = set()
    inside_article = outer[0]
    if name in _TAG_HINT and not (name == "header" and inside_article):  # the head of an article holds its title
        own.add(_TAG_HINT[name])
    if attributes and name in _NAME_TAGS:
        names = " ".join(a[1] or a[2] or a[3] for a in _ATTRIBUTE.findall(attributes)).split()
        said = " ".join(n for n in names if _MODIFIERS.isdisjoint(re.split("[-_]", n.lower())))
        if said:
            own.update(h for h, pattern in _NAMES.items() if pattern.search(said))
    if not own:
        return outer
    return tuple(1 if v or h in own else 0 for h, v in zip(HINTS, outer, strict=True))


def features(found: Sequence[Block]) -> np.ndarray:
    """One row of FEATURES for each block; beyond the ends of the page there are no words."""
    out = np.zeros((len(found), len(FEATURES)))
    if found:
        own = np.array([(b.words, b.link_density) for b in found], dtype=float)
        out[:, 0:2] = own
        out[1:, 2:4] = own[:-1]
        out[:-1, 4:6] = own[1:]
        out[:, 6] = [-1 if any(b.hints[1:]) else b.hints[0] for b in found]
    return out


class DecisionTree:
    """Binary classification tree by Gini impurity; ties go to the first feature and lowest threshold."""

    def __init__(self, max_depth: int = 12, min_leaf: int = 1) -> None:
        self.max_depth, self.min_leaf = max_depth, min_leaf
        self.feature: list[int] = []
        self.threshold: list[float] = []
        self.children: list[tuple[int, int]] = []
        self.value: list[float] = []

    def fit(self, x: np.ndarray, y: np.ndarray) -> DecisionTree:
        self._grow(np.asarray(x, float), np.asarray(y, float), 0)
        return self

    def _grow(self, x: np.ndarray, y: np.ndarray, depth: int) -> int:
        node = len(self.value)
        self.feature.append(-1)
        self.threshold.append(0.0)
        self.children.append((-1, -1))
        self.value.append(float(y.mean()))
        best = (1e-12, -1, 0.0)
        impurity = lambda v: len(v) * v.mean() * (1 - v.mean())
        if depth < self.max_depth and 0 < y.mean() < 1:
            for f in range(x.shape[1]):
                levels = np.unique(x[:, f])
                for t in (levels[1:] + levels[:-1]) / 2:
                    left = x[:, f] <= t
                    if min(left.sum(), (~left).sum()) >= self.min_leaf and (gain := impurity(y) - impurity(y[left]) - impurity(y[~left])) > best[0] + 1e-12:
                        best = (gain, f, float(t))
        if best[1] >= 0:
            left = x[:, best[1]] <= best[2]
            self.feature[node], self.threshold[node] = best[1], best[2]
            self.children[node] = (self._grow(x[left], y[left], depth + 1), self._grow(x[~left], y[~left], depth + 1))
        return node

    def predict(self, x: np.ndarray) -> np.ndarray:
        """Share of class 1 in each row's leaf."""
        x = np.asarray(x, float)
        out = np.empty(len(x))
        todo = [(0, np.arange(len(x)))]
        while todo:
            node, rows = todo.pop()
            if self.feature[node] < 0:
                out[rows] = self.value[node]
            elif len(rows):
                left = x[rows, self.feature[node]] <= self.threshold[node]
                todo += [(self.children[node][0], rows[left]), (self.children[node][1], rows[~left])]
        return out


def default_tree() -> DecisionTree:
    data = labelled_table()
    return DecisionTree().fit(data[:, :-1], data[:, -1])


def main_text(page: str, tree: DecisionTree) -> str:
    found = blocks(page)
    if not found:
        return ""
    keep = tree.predict(features(found)) >= 0.5
    return "\n".join(b.text for b, k in zip(found, keep.tolist(), strict=True) if k)


def extract(pages: DataFrame, *, html: str = "html", keep: tuple[str, ...] = ("page_id", "url"), tree: DecisionTree | None = None) -> DataFrame:
    """``keep`` columns, ``text`` string and ``n_chars`` long (code points) for every page.

    Null or empty html, and pages without content, give the empty text.
    Repeated rows stay repeated, nulls in ``keep`` pass, and an empty table
    gives an empty result.  The whole html is read, however long.
    """
    source = pages.select(*keep, text_or_empty(html).alias("_html"))
    tree = tree or default_tree()
    schema = T.StructType([*source.schema.fields[:-1], T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for first in range(0, whole.num_rows, ROWS_PER_BATCH):
                batch = whole.slice(first, ROWS_PER_BATCH)
                pages_blocks = [blocks(v.as_py()) for v in batch.column(batch.num_columns - 1)]
                content = tree.predict(np.concatenate([features(b) for b in pages_blocks])) >= 0.5
                texts, at = [], 0
                for found in pages_blocks:
                    texts.append("\n".join(b.text for b, k in zip(found, content[at : at + len(found)].tolist(), strict=True) if k))
                    at += len(found)
                arrays = [*batch.columns[:-1], pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())]
                yield pa.RecordBatch.from_arrays(arrays, names=schema.names)

    return source.mapInArrow(run, schema)
