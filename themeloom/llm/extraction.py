"""Main text of web pages by a linear-chain conditional random field over the leaf blocks of a page.

A page is cut into leaf blocks: runs of text without a block-level tag inside. Each block has features of
its ancestors' tags and names and of its text. The chain has the labels boilerplate and main; its weights
are trained on labelled pages, and Viterbi finds the best labels of all blocks of a page together.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from themeloom.llm.labelled_pages import labelled_pages
from themeloom.llm.shared import fresh

# Elements of HTML by what they do to text.
SILENT = {"script", "style", "noscript", "template", "svg", "iframe", "canvas", "head", "title", "select", "textarea", "button", "audio", "video", "annotation", "annotation-xml"}
MATH = {"math", "maction", "menclose", "merror", "mfenced", "mfrac", "mi", "mmultiscripts", "mn", "mo", "mover", "mpadded", "mphantom", "mprescripts", "mroot", "mrow", "ms", "mspace", "msqrt", "mstyle", "msub", "msubsup", "msup", "mtable", "mtd", "mtext", "mtr", "munder", "munderover", "semantics", "annotation", "annotation-xml"}
INLINE = {"a", "abbr", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "ins", "kbd", "label", "mark", "q", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr", "br", "img", "acronym", "object"} | MATH
#: Start tags that may stand in a head; any other, and text, ends it.
IN_HEAD = {"html", "head", "title", "meta", "link", "style", "script", "base", "noscript", "template"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
CLOSES_P = {"address", "article", "aside", "blockquote", "div", "dl", "fieldset", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hr", "main", "nav", "ol", "p", "pre", "section", "table", "ul"}
SIBLINGS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
SPACES = re.compile(r"\s+")
#: A tag that the page ends in the middle of.
CUT_TAG = re.compile(r"<[/!A-Za-z][^<>]*$")
NAME_PART = re.compile(r"[a-z]+")
LABELS = ("boilerplate", "main")
RIDGE, STEPS, RATE = 0.02, 300, 1.0
MOST_LOOKS = 50_000


@dataclass
class Block:
    """A leaf block: its ancestors from the outermost, words of their classes and ids, and its text."""

    path: tuple[str, ...]
    names: frozenset[str]
    text: str
    linked: int = 0


@dataclass
class _Open:
    tag: str
    names: frozenset[str] = field(default_factory=frozenset)


class PageBlocks(HTMLParser):
    """Reads a page, however malformed, into its leaf blocks."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.stack: list[_Open] = []
        self.blocks: list[Block] = []
        self.parts: list[str] = []
        self.linked, self.silent, self.anchors = 0, 0, 0

    def _flush(self) -> None:
        text = SPACES.sub(" ", "".join(self.parts)).strip()
        if text:
            tags = tuple(o.tag for o in self.stack if o.tag not in INLINE)
            names = frozenset().union(*(o.names for o in self.stack)) if self.stack else frozenset()
            self.blocks.append(Block(tags, names, text, min(self.linked, len(text))))
        self.parts, self.linked = [], 0

    def _close_to(self, at: int) -> None:
        if any(o.tag not in INLINE for o in self.stack[at:]):
            self._flush()
        for gone in self.stack[at:]:
            self.silent -= gone.tag in SILENT
            self.anchors -= gone.tag == "a"
        del self.stack[at:]

    def _end_head(self, body: bool) -> None:
        """What may not stand in an open head ends it and begins the body."""
        if self.stack and self.stack[-1].tag == "head":
            self._close_to(len(self.stack) - 1)
            if body:
                self.stack.append(_Open("body"))

    def handle_starttag(self, tag, attrs):
        if tag not in IN_HEAD:
            self._end_head(tag != "body")
        if tag == "br":
            self.parts.append(" ")
        if tag == "body":
            # a body ends a head that was left open
            for at, o in enumerate(self.stack):
                if o.tag == "head":
                    self._close_to(at)
                    break
        if tag not in INLINE:
            self._flush()
            if tag in CLOSES_P:
                for at in range(len(self.stack) - 1, -1, -1):
                    if self.stack[at].tag == "p":
                        self._close_to(at)
                        break
                    if self.stack[at].tag not in INLINE or self.stack[at].tag == "object":
                        break
            for at in range(len(self.stack) - 1, -1, -1):
                if self.stack[at].tag in SIBLINGS.get(tag, ()):
                    self._close_to(at)
                    break
                if self.stack[at].tag in ("ul", "ol", "dl", "table", "select"):
                    break
        if tag in VOID:
            return
        said = " ".join(v for k, v in attrs if k in ("class", "id", "role") and v).lower()
        self.stack.append(_Open(tag, frozenset(NAME_PART.findall(said)) if said else frozenset()))
        self.silent += tag in SILENT
        self.anchors += tag == "a"

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID and self.stack and self.stack[-1].tag == tag:
            self.handle_endtag(tag)

    def handle_endtag(self, tag):
        if tag == "br":
            self.parts.append(" ")
            return
        for at in range(len(self.stack) - 1, -1, -1):
            if self.stack[at].tag == tag:
                self._close_to(at)
                return

    def handle_data(self, data):
        if self.silent and data.strip():
            self._end_head(True)
        if self.silent:
            return
        self.parts.append(data)
        if self.anchors:
            self.linked += len(data.strip())

    def close(self):
        super().close()
        self._close_to(0)
        self._flush()


def blocks_of(page: str) -> list[Block]:
    """Leaf blocks of a page in order."""
    reader = PageBlocks()
    reader.feed(CUT_TAG.sub("", page))
    reader.close()
    return reader.blocks


# Name parts that say what a part of a page is.
TELLING = {
    "nav", "navigation", "menu", "breadcrumb", "breadcrumbs", "header", "masthead", "footer", "copyright", "sidebar", "aside",
    "related", "recommended", "promo", "ad", "ads", "advert", "advertisement", "sponsor", "sponsored", "banner", "cookie",
    "consent", "notice", "alert", "popup", "modal", "newsletter", "subscribe", "signup", "login", "form", "search", "share",
    "social", "comment", "comments", "reply", "replies", "discussion", "disqus", "widget", "tags", "pagination", "toolbar",
    "legal", "disclaimer", "article", "content", "main", "post", "entry", "story", "body", "text",
}
STRUCTURE = {"nav", "header", "footer", "aside", "form", "main", "article", "section", "ul", "ol", "li", "table", "dialog", "menu", "figure", "figcaption", "blockquote", "pre", "h1", "h2", "h3", "h4", "p"}
PARTS = {"nav", "header", "footer", "aside", "form", "main", "article", "dialog"}


Look = tuple[tuple[str, ...], frozenset[str], int, int, bool, bool]


def look_of(block: Block) -> Look:
    """What of a block matters: its place, and the length, links, end and signs of its text."""
    text = block.text
    return (
        block.path,
        block.names,
        min(6, int(math.log2(text.count(" ") + 1))),
        min(3, 4 * block.linked // len(text)),
        text[-1] in ".!?…:;\"”»",
        "©" in text or "(c)" in text or "(C)" in text,
    )


def features(look: Look) -> list[str]:
    """Names of what holds for a block."""
    path, names, words, links, sentence, copyright_sign = look
    found = [f"in {tag}" for tag in STRUCTURE.intersection(path)]
    found += [f"named {name}" for name in TELLING.intersection(names)]
    inner = next((t for t in reversed(path) if t in PARTS), "none")
    found += ["always", f"innermost {inner}", f"leaf {path[-1] if path else 'none'}", f"words {words}", f"links {links}"]
    found.append("ends a sentence" if sentence else "ends openly")
    return found + ["copyright sign"] * copyright_sign


@dataclass
class Chain:
    """Weights: per feature one for each label, and one for each pair of neighbouring labels."""

    emit: dict[str, tuple[float, float]]
    move: tuple[tuple[float, float], tuple[float, float]]
    known: dict[Look, tuple[float, float]] = field(default_factory=dict)

    def scores(self, blocks: Sequence[Block]) -> list[tuple[float, float]]:
        """Scores of both labels for each block; blocks that look alike are scored once."""
        if len(self.known) > MOST_LOOKS:
            self.known.clear()
        found = []
        for block in blocks:
            look = look_of(block)
            if look not in self.known:
                weights = [self.emit[f] for f in features(look) if f in self.emit]
                self.known[look] = (math.fsum(w[0] for w in weights), math.fsum(w[1] for w in weights))
            found.append(self.known[look])
        return found


def viterbi(scores: Sequence[tuple[float, float]], move: Sequence[Sequence[float]]) -> list[int]:
    """The best sequence of labels; of equal ones, boilerplate first."""
    best, back = (0.0, 0.0), []
    for i, score in enumerate(scores):
        if not i:
            best = score
            continue
        through = [(best[0] + move[0][y], best[1] + move[1][y]) for y in (0, 1)]
        back.append([int(one > zero) for zero, one in through])
        best = (max(through[0]) + score[0], max(through[1]) + score[1])
    labels = [int(best[1] > best[0])] if scores else []
    for before in reversed(back):
        labels.append(before[labels[-1]])
    return labels[::-1]


def _log_sum(values: np.ndarray, axis: int) -> np.ndarray:
    top = values.max(axis=axis, keepdims=True)
    return (top + np.log(np.exp(values - top).sum(axis=axis, keepdims=True))).squeeze(axis)


def _marginals(scores: np.ndarray, inside: np.ndarray, move: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of chains of blocks side by side: probabilities of labels and, summed, of neighbouring labels.

    ``inside`` marks the blocks that a chain has; chains of other lengths are filled up behind.
    """
    n = scores.shape[1]
    ahead, behind = np.zeros_like(scores), np.zeros_like(scores)
    ahead[:, 0] = scores[:, 0]
    for i in range(1, n):
        step = scores[:, i] + _log_sum(ahead[:, i - 1, :, None] + move, 1)
        ahead[:, i] = np.where(inside[:, i, None], step, ahead[:, i - 1])
    for i in range(n - 2, -1, -1):
        step = _log_sum(move + (scores[:, i + 1] + behind[:, i + 1])[:, None, :], 2)
        behind[:, i] = np.where(inside[:, i + 1, None], step, 0.0)
    total = _log_sum(ahead[:, -1], 1)
    joint = ahead[:, :-1, :, None] + move + (scores[:, 1:] + behind[:, 1:])[:, :, None, :] - total[:, None, None, None]
    pairs = np.where(inside[:, 1:, None, None], np.exp(np.minimum(joint, 0)), 0.0).sum(axis=(0, 1))
    return np.exp(ahead + behind - total[:, None, None]) * inside[:, :, None], pairs


def train(pages: Sequence[tuple[str, Sequence[int]]]) -> Chain:
    """Maximise the likelihood of the labels of the pages' blocks, with a ridge, by scaled gradient steps."""
    chains = [([features(look_of(b)) for b in blocks_of(page)], labels) for page, labels in pages]
    if any(len(rows) != len(labels) for rows, labels in chains):
        raise ValueError("each leaf block needs a label")
    number = {f: i for i, f in enumerate(sorted({f for rows, _ in chains for row in rows for f in row}))}
    shape = (len(chains), max(len(labels) for _, labels in chains))
    held, truth, inside = np.zeros((*shape, len(number))), np.zeros((*shape, 2)), np.zeros(shape, bool)
    follow = np.zeros((2, 2))
    for c, (rows, labels) in enumerate(chains):
        for i, (row, label) in enumerate(zip(rows, labels, strict=True)):
            held[c, i, [number[f] for f in row]] = 1
            truth[c, i, label], inside[c, i] = 1, True
        np.add.at(follow, (list(labels[:-1]), list(labels[1:])), 1)
    emit, move = np.zeros((len(number), 2)), np.zeros((2, 2))
    pace = RATE / np.sqrt(held.sum(axis=(0, 1)) + 1)[:, None] / 4
    flat = held.reshape(-1, len(number))
    for _ in range(STEPS):
        share, pairs = _marginals((flat @ emit).reshape(*shape, 2), inside, move)
        emit += pace * (flat.T @ (truth - share).reshape(-1, 2) - RIDGE * emit)
        move += RATE / np.sqrt(inside.sum()) / 4 * (follow - pairs - RIDGE * move)
    return Chain({f: tuple(emit[i].tolist()) for f, i in number.items()}, tuple(map(tuple, move.tolist())))


def main_text(page: str, chain: Chain) -> str:
    """The main blocks of a page, one per line."""
    blocks = blocks_of(page)
    labels = viterbi(chain.scores(blocks), chain.move)
    return "\n".join(block.text for block, label in zip(blocks, labels, strict=True) if label)


def extracted_text(pages: DataFrame, chain: Chain | None = None, html_column: str = "html") -> DataFrame:
    """All columns of ``pages``, and behind them the main text of the whole page.

    Null and empty pages have an empty text, and so have pages without a main block. Repeated rows and
    columns of any name pass through; an empty table gives no rows.
    """
    chain = chain or train(labelled_pages())
    emit, move = chain.emit, chain.move
    at = pages.columns.index(html_column)
    schema = T.StructType([*pages.schema.fields, T.StructField(fresh("text", pages.columns), T.StringType())])

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Chain(emit, move)
        for batch in batches:
            texts = [main_text(page.as_py() or "", model) for page in batch.column(at)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], schema.names)

    return pages.mapInArrow(extract, schema)


def page_texts(pages: DataFrame, key: str = "page_id", url: str = "url", html_column: str = "html") -> DataFrame:
    """``key, url, text, n_chars`` for every page."""
    given = pages.select(F.col(key), F.col(url), F.col(html_column).alias("_html"))
    out = extracted_text(given, html_column="_html")
    text = F.col(out.columns[-1])
    return out.select(key, url, text.alias("text"), F.length(text).cast("long").alias("n_chars"))
