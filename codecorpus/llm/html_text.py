"""HTML extraction: flat text blocks, classified by a decision tree.

A page is cut into blocks of text between block-level tags.  Each block has its number of words and
link density, those of its neighbours, and what its open elements say by tag, class, id and role.
A decision tree, trained here on a small labelled table, tells main text from the rest.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codecorpus.llm.labelled_pages import LABELLED_PAGES
from codecorpus.llm.made_pages import made_pages

#: Labelled blocks that the tree is trained on at most.
MAX_LABELLED = 10_000
#: Pages made by rule that the tree is trained on beside those made by hand, and their seed.
MADE_PAGES, MADE_SEED = 400, 1

#: Elements that stand in the flow of text and do not end a block.
INLINE = frozenset(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt "
    "ruby s samp small span strike strong sub sup time tt u var wbr".split()
)
#: Elements whose content is no text of the page.
SILENT = ("script", "style", "noscript", "template", "title", "textarea", "svg", "iframe", "object")
#: Elements that never have content.
VOID = frozenset(
    "area base br col embed hr img input link meta param source track wbr".split()
)
ASIDE_TAGS = frozenset("nav aside footer form menu button select dialog".split())
ASIDE_ROLES = frozenset(
    "navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar".split()
)
#: Words of a class or id that name what surrounds an article.
ASIDE_NAMES = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense banner sponsor sponsored promo "
    "promotion nav navbar navigation menu breadcrumb breadcrumbs sidebar aside header masthead "
    "footer cookie cookies consent gdpr notice notification alert popup modal overlay newsletter "
    "subscribe subscription signup login share sharing social related recommended comment comments "
    "commentlist reply replies discussion disqus respond widget toolbar pagination pager form "
    "search skip copyright legal disclaimer".split()
)
MAIN_TAGS = frozenset(("article", "main"))
MAIN_NAMES = frozenset("article content post entry story main body text".split())

_TOKEN = re.compile(
    r"<!--(?:.*?-->|.*\Z)"
    r"|<(" + "|".join(SILENT) + r")\b[^>]*>(?:.*?</\1\s*>|.*\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>"
    r"|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>"
    r"|<[!?][^>]*>",
    re.S | re.I,
)
_CLOSED = re.compile(r"(?:-->|</[a-z]+\s*>)\Z|\A<[!?](?!--)", re.I)
_ATTRIBUTE = re.compile(r"(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_NAME = re.compile(r"[a-z]+")
_MODIFIER = re.compile(r"(?:^|[-_])(?:has|no|with|without)[-_].*")
_SPACE = re.compile(r"\s+")


@dataclass
class Block:
    """A run of text without a block-level tag inside."""

    text: str
    n_words: int
    n_link_words: int
    aside: bool
    main: bool
    heading: int  # its level, 0 for none
    listed: bool
    article: bool


@dataclass
class _Builder:
    blocks: list[Block] = field(default_factory=list)
    parts: list[tuple[str, bool]] = field(default_factory=list)

    def flush(self, stack: list[tuple[str, bool, bool]]) -> None:
        # A reference does not go on beyond a tag, so parts are decoded one by one.
        parts = [(unescape(part), in_link) for part, in_link in self.parts]
        text = _SPACE.sub(" ", "".join(part for part, _ in parts)).strip()
        if text:
            linked = sum(len(part.split()) for part, in_link in parts if in_link)
            n_words = len(text.split())
            tags = [tag for tag, _, _ in stack]
            self.blocks.append(
                Block(
                    text,
                    n_words,
                    min(linked, n_words),
                    any(aside for _, aside, _ in stack),
                    any(main for _, _, main in stack),
                    max((int(tag[1]) for tag in tags if re.fullmatch("h[1-6]", tag)), default=0),
                    "li" in tags,
                    not MAIN_TAGS.isdisjoint(tags),
                )
            )
        self.parts.clear()


def _cues(tag: str, attributes: str, in_main: bool) -> tuple[bool, bool]:
    """Whether an element opens something beside the main text, and whether it opens main text."""
    aside, main = tag in ASIDE_TAGS or (tag == "header" and not in_main), tag in MAIN_TAGS
    if attributes:
        for name, *values in _ATTRIBUTE.findall(attributes):
            value = "".join(values).lower()
            if name.lower() == "role":
                aside |= value in ASIDE_ROLES
                main |= value in ("main", "article")
                continue
            names, known = set(), set()
            for token in value.split():
                # "has-sidebar" and "page-with-banner" tell what else there is, not what this is.
                parts = set(_NAME.findall(_MODIFIER.sub("", token)))
                names |= parts
                # Of an article only a name that says nothing else makes it something beside it.
                if tag not in MAIN_TAGS or parts <= ASIDE_NAMES | MAIN_NAMES:
                    known |= parts & ASIDE_NAMES
            # A page header is beside the text; the header of an article holds its title.
            aside |= bool(known - {"header"}) or (bool(known) and not in_main)
            main |= bool(names & MAIN_NAMES) and not known
    if tag in ("html", "body"):
        return False, False
    return aside, main


def blocks_of(html: str) -> list[Block]:
    """The text blocks of a page in order; tags may be missing or cut off."""
    out = _Builder()
    stack: list[tuple[str, bool, bool]] = []
    depth_of_links = 0
    place = 0
    silenced = None
    # Nothing after the last ">" can be a whole tag; this also keeps the search linear.
    for token in _TOKEN.finditer(html, 0, html.rfind(">") + 1):
        if token.start() > place:
            out.parts.append((html[place : token.start()], depth_of_links > 0))
        place = token.end()
        tag = token[3] or token[6]
        if tag is None:
            silenced = token
            continue
        closing, attributes = token[2] or token[5], token[4] or token[7] or ""
        tag = tag.lower()
        if tag == "a":
            depth_of_links = 0 if closing else 1
            continue
        if tag == "br":
            out.parts.append((" ", False))
        if tag in INLINE and not attributes:
            continue
        if tag not in INLINE:
            depth_of_links = 0
            out.flush(stack)
        if closing:
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == tag:
                    if tag in INLINE:
                        out.flush(stack)
                    del stack[k:]
                    break
        elif tag not in VOID and not attributes.rstrip().endswith("/"):
            cues = _cues(tag, attributes, any(main for _, _, main in stack))
            if tag in INLINE:
                if not any(cues):
                    continue
                out.flush(stack)
            elif tag in ("p", "li", "h1", "h2", "h3", "h4", "h5", "h6"):
                # These end an element of their own kind that was left open.
                if stack and stack[-1][0] == tag:
                    stack.pop()
            stack.append((tag, *cues))
    rest = html[place:]
    if silenced and silenced.end() == place and not _CLOSED.search(silenced[0]):
        rest = ""  # the page ends inside a script, a style or a comment
    # A tag that was cut off at the end of the page is no text.
    rest = re.sub(r"<(?:[a-zA-Z/!?][^>]*)?\Z", "", rest)
    if rest:
        out.parts.append((rest, depth_of_links > 0))
    out.flush(stack)
    return out.blocks


FEATURES = (
    "n_words", "link_density", "words_before", "density_before", "words_after", "density_after",
    "aside", "main", "heading", "listed", "page_has_main", "article", "page_has_article",
)


def features(blocks: list[Block]) -> np.ndarray:
    """One row of ``FEATURES`` per block; neighbours beyond the page have no words."""
    table = np.zeros((len(blocks), len(FEATURES)))
    if not blocks:
        return table
    words = np.array([b.n_words for b in blocks], float)
    density = np.array([b.n_link_words for b in blocks], float) / np.maximum(words, 1)
    table[:, 0], table[:, 1] = words, density
    table[1:, 2], table[1:, 3] = words[:-1], density[:-1]
    table[:-1, 4], table[:-1, 5] = words[1:], density[1:]
    for column, name in ((6, "aside"), (7, "main"), (8, "heading"), (9, "listed"), (11, "article")):
        table[:, column] = [getattr(b, name) for b in blocks]
    table[:, 10] = any(b.main and not b.aside for b in blocks)
    table[:, 12] = any(b.article and not b.aside for b in blocks)
    return table


@dataclass
class DecisionTree:
    """A binary tree as arrays; a leaf has feature -1."""

    feature: list[int] = field(default_factory=list)
    threshold: list[float] = field(default_factory=list)
    low: list[int] = field(default_factory=list)
    high: list[int] = field(default_factory=list)
    label: list[bool] = field(default_factory=list)

    def fit(self, x: np.ndarray, y: np.ndarray, max_depth: int = 12, min_rows: int = 2) -> DecisionTree:
        """Splits by the largest drop of Gini impurity; ties go to the first feature."""
        self._grow(x, y, max_depth, min_rows)
        return self

    def _grow(self, x: np.ndarray, y: np.ndarray, depth: int, min_rows: int) -> int:
        node = len(self.feature)
        self.feature.append(-1)
        self.threshold.append(0.0)
        self.low.append(-1)
        self.high.append(-1)
        self.label.append(bool(y.mean() >= 0.5) if len(y) else False)
        if depth == 0 or len(y) < 2 * min_rows or y.min() == y.max():
            return node
        best = (1e-9, -1, 0.0)
        whole = len(y) * 2 * y.mean() * (1 - y.mean())
        for f in range(x.shape[1]):
            order = np.argsort(x[:, f], kind="stable")
            values, labels = x[order, f], y[order].astype(float)
            n = np.arange(1, len(y))
            ones = np.cumsum(labels)[:-1]
            rest = labels.sum() - ones
            m = len(y) - n
            impurity = 2 * ones * (n - ones) / n + 2 * rest * (m - rest) / m
            allowed = (values[1:] > values[:-1]) & (n >= min_rows) & (m >= min_rows)
            if allowed.any():
                k = int(np.argmin(np.where(allowed, impurity, np.inf)))
                if whole - impurity[k] > best[0] + 1e-12:
                    best = (whole - impurity[k], f, (values[k] + values[k + 1]) / 2)
        if best[1] < 0:
            return node
        below = x[:, best[1]] <= best[2]
        self.feature[node], self.threshold[node] = best[1], float(best[2])
        self.low[node] = self._grow(x[below], y[below], depth - 1, min_rows)
        self.high[node] = self._grow(x[~below], y[~below], depth - 1, min_rows)
        return node

    def predict(self, x: np.ndarray) -> np.ndarray:
        node = np.zeros(len(x), np.int64)
        feature, threshold = np.array(self.feature), np.array(self.threshold)
        low, high = np.array(self.low), np.array(self.high)
        while (feature[node] >= 0).any():
            inner = np.flatnonzero(feature[node] >= 0)
            at = node[inner]
            below = x[inner, feature[at]] <= threshold[at]
            node[inner] = np.where(below, low[at], high[at])
        return np.array(self.label)[node]


def labelled_blocks(pages: tuple[tuple[str, tuple[str, ...]], ...]) -> tuple[np.ndarray, np.ndarray]:
    """Features and labels of the blocks of labelled pages (html, main blocks in order)."""
    x, y = [], []
    for html, main in pages:
        blocks = blocks_of(html)
        x.append(features(blocks))
        y += [block.text in main for block in blocks]
    return np.concatenate(x)[:MAX_LABELLED], np.array(y[:MAX_LABELLED])


def train_tree(pages: tuple[tuple[str, tuple[str, ...]], ...] | None = None) -> DecisionTree:
    """The tree of labelled pages: unless given, those made by hand and those made by rule."""
    if pages is None:
        pages = LABELLED_PAGES + made_pages(MADE_PAGES, MADE_SEED)
    return DecisionTree().fit(*labelled_blocks(pages))


def main_text(html: str | None, tree: DecisionTree) -> str:
    blocks = blocks_of(html or "")
    if not blocks:
        return ""
    chosen = tree.predict(features(blocks))
    return "\n".join(block.text for block, keep in zip(blocks, chosen) if keep)


def extract_main_text(
    pages: DataFrame, *, html: str = "html", keep: tuple[str, ...] = ("page_id", "url"),
    tree: DecisionTree | None = None,
) -> DataFrame:
    """The columns ``keep`` and text: main blocks of each page, joined by line breaks.

    Character references are decoded, white space inside a block becomes one space, and nothing is
    cut.  A null, empty or text-free page has an empty text; pages stay in their rows, so nothing
    is shuffled, and repeated rows are answered alike.  The tree is trained on the driver on the
    labelled table, at most ``MAX_LABELLED`` blocks, unless one is given.
    """
    model = tree or train_tree()
    types = ", ".join(f"{name} {pages.schema[name].dataType.simpleString()}" for name in keep)

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(page.as_py(), model) for page in batch.column(len(keep))]
            columns = [batch.column(k) for k in range(len(keep))]
            yield pa.RecordBatch.from_arrays(
                [*columns, pa.array(texts, pa.string())], names=[*keep, "text"]
            )

    return pages.select(*keep, F.col(html)).mapInArrow(extract, f"{types}, text string")
