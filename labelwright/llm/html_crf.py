"""Main text of web pages by a linear-chain conditional random field over DOM leaf blocks.

A page is read into its leaf blocks in order: runs of text between block
elements, each with its ancestors' tags, class, id and role words, its links and
its text.  The field has two labels (main text or not); every block scores its
features under both labels, neighbours score their pair of labels, and Viterbi
picks the best sequence.  Weights are learned by gradient steps on the
conditional likelihood (forward-backward) from labelled pages: a packaged set
marked by hand and, from the table, pages whose own markup states the article
(``MAX_PAGES`` bounds them).  Each of the latter is learned twice, once without
the telling ancestors, so that text and class words carry weight too.

Pages are independent: extraction is one pass without a shuffle.

Results: null, empty and textless pages give an empty text.  Unclosed and cut
off markup is read as far as it goes.  Repeated rows give equal results.  Extra
columns are passed on, whatever their names.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from labelwright.llm.common import bounded_sample, packed, texts_of
from labelwright.llm.html_examples import EXAMPLES

MAX_PAGES = 120
EPOCHS = 25
RATE = 0.3
RIDGE = 1e-3
EXAMPLE_WEIGHT = 6

# Fixed values of the HTML standard.
RAW = frozenset("script style noscript template iframe textarea select svg title".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark object q s samp small span strike strong sub sup time tt u var wbr "
                   "math maction menclose merror mfenced mfrac mi mmultiscripts mn mo mover mpadded mphantom mprescripts mroot mrow ms "
                   "mspace msqrt mstyle msub msubsup msup mtable mtd mtext mtr munder munderover none semantics annotation".split())
CLOSES_P = frozenset("address article aside blockquote div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split())
CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
# Elements that stop such an implied end.
SCOPES = frozenset("ul ol dl table article aside section div body main nav header footer".split())
# Ancestors that state the article; left out of every second reading of a table page.
STATING = frozenset(("anc=article", "anc=main"))

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)|[^<]+|<", re.S)
# What ends a raw element: its own end tag, whatever stands before; a title also ends with its head.
_RAW_END = {name: re.compile(rf"</{name}(?=[\s/>]|\Z)", re.I) for name in RAW}
_RAW_END["title"] = re.compile(r"</(?:title|head)(?=[\s/>]|\Z)|<body(?=[\s/>]|\Z)", re.I)
_HEAD_END = re.compile(r"</head(?=[\s/>]|\Z)|<body(?=[\s/>]|\Z)", re.I)
_NAMED = re.compile(r"(class|id|role|data-keep|itemprop)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_NAME_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")
_SPACE = re.compile(r"\s+")


class Block:
    """One leaf block: its text, link characters, and the features of its ancestors."""

    __slots__ = ("text", "linked", "where", "keep")

    def __init__(self, text: str, linked: int, where: tuple[str, ...], keep: bool | None):
        self.text, self.linked, self.where, self.keep = text, linked, where, keep


def _named(tag: str, attributes: str) -> tuple[tuple[str, ...], bool | None]:
    """Features of an element, and its mark if it has one."""
    out, keep = [f"anc={tag}"], None
    if attributes:
        for key, a, b, c in _NAMED.findall(attributes):
            value = a or b or c
            if key == "data-keep":
                keep = value == "1"
            elif key == "role":
                out.append(f"role={value.lower()}")
            else:
                out += [f"name={w.lower()}" for w in _NAME_WORD.findall(value)]
    return tuple(dict.fromkeys(out)), keep


def _tokens(page: str) -> Iterator[re.Match[str]]:
    """Tags and texts in order; what raw elements hold is passed over, not cut into tags."""
    at, endless = 0, set()
    while at < len(page):
        for m in _TOKEN.finditer(page, at):
            yield m
            name = (m[2] or m[5] or "").lower()
            if name in RAW and not (m[1] or m[4]) and not (m[3] or m[6] or "").rstrip().endswith("/"):
                stop = None if name in endless else _RAW_END[name].search(page, m.end())
                if stop is None:
                    # Never closed: it ends where its head ends, or with the page.
                    endless.add(name)
                    stop = _HEAD_END.search(page, m.end())
                at = stop.start() if stop else len(page)
                break
        else:
            return


def blocks(page: str | None) -> list[Block]:
    """Leaf blocks with text, in page order."""
    found: list[Block] = []
    stack: list[tuple[str, tuple[str, ...], bool | None]] = []
    parts: list[str] = []
    state = {"linked": 0}

    def end() -> None:
        if parts:
            text = _SPACE.sub(" ", "".join(parts)).strip()
            if text:
                where = tuple(dict.fromkeys(f for _, names, _ in stack for f in names))
                block = [t for t, _, _ in stack if t not in INLINE]
                keep = next((k for _, _, k in reversed(stack) if k is not None), None)
                found.append(Block(text, state["linked"], (*where, f"in={block[-1] if block else ''}"), keep))
            parts.clear()
            state["linked"] = 0

    def close(tags: tuple[str, ...], inside: frozenset[str] = frozenset()) -> None:
        for i in range(len(stack) - 1, -1, -1):
            if stack[i][0] in tags:
                if any(t not in INLINE for t, _, _ in stack[i:]):
                    end()
                del stack[i:]
                return
            if stack[i][0] in inside:
                return

    for m in _tokens(page or ""):
        tag = m[2] or m[5]
        if not tag:
            text = m[0]
            if text[0] != "<" or text == "<":
                if "&" in text:
                    text = entities.unescape(text)
                parts.append(text)
                if stack and any(t == "a" for t, _, _ in stack[-3:]):
                    state["linked"] += len(text.strip())
            continue
        tag = tag.lower()
        if m[1] or m[4]:
            if tag == "p" and not any(t == "p" for t, _, _ in stack):
                end()
            close((tag,))
        elif tag == "head" or tag in RAW:
            # What may stand in a head has no text outside of raw elements: whatever else comes is the body's.
            continue
        elif tag in VOID:
            if tag in ("br", "hr"):
                end()
        else:
            if tag not in INLINE:
                end()
                if tag in CLOSES_P:
                    close(("p",), SCOPES)
                if tag in CLOSES:
                    close(CLOSES[tag], SCOPES)
            stack.append((tag, *_named(tag, m[3] or m[6] or "")))
    end()
    return found


def features(page: list[Block]) -> list[list[str]]:
    """Features of every block of a page."""
    out = []
    for i, b in enumerate(page):
        words = b.text.count(" ") + 1
        density = min(b.linked / len(b.text), 1.0)
        own = [
            *b.where, "bias", f"words={min(words.bit_length(), 8)}", f"linked={round(density * 3)}",
            f"end={b.text[-1] if b.text[-1] in '.!?:,;' else 'x'}", f"from_start={min(i, 4)}", f"to_end={min(len(page) - 1 - i, 2)}",
        ]
        if "©" in b.text or "copyright" in b.text.lower():
            own.append("copyright")
        out.append(own)
    return out


class Field:
    """Weights per feature and label, and per pair of neighbouring labels."""

    def __init__(self) -> None:
        self.index: dict[str, int] = {}
        self.w = np.zeros((0, 2))
        self.pair = np.zeros((2, 2))

    def fit(self, pages: list[tuple[list[list[str]], list[int], float]]) -> Field:
        for rows, _, _ in pages:
            for row in rows:
                for f in row:
                    self.index.setdefault(f, len(self.index))
        data = [([np.array([self.index[f] for f in row]) for row in rows], np.array(y), weight) for rows, y, weight in pages if rows]
        self.w = np.zeros((len(self.index), 2))
        sum_w, sum_pair = np.full_like(self.w, 1e-2), np.full((2, 2), 1e-2)
        order = np.random.default_rng(11)
        for _ in range(EPOCHS):
            for k in order.permutation(len(data)):
                rows, y, weight = data[k]
                scores = np.stack([self.w[at].sum(axis=0) for at in rows])
                single, double = self.marginals(scores)
                gap = -single
                gap[np.arange(len(y)), y] += 1
                grad = np.zeros_like(self.w)
                np.add.at(grad, np.concatenate(rows), np.repeat(gap, [len(at) for at in rows], axis=0))
                grad = weight * grad - RIDGE * self.w
                pairs = np.zeros((2, 2))
                np.add.at(pairs, (y[:-1], y[1:]), 1)
                grad_pair = weight * (pairs - double) - RIDGE * self.pair
                sum_w += grad**2
                sum_pair += grad_pair**2
                self.w += RATE * grad / np.sqrt(sum_w)
                self.pair += RATE * grad_pair / np.sqrt(sum_pair)
        return self

    def marginals(self, scores: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Label probabilities of each block, and expected counts of label pairs."""
        n = len(scores)
        ahead, back = np.zeros((n, 2)), np.zeros((n, 2))
        ahead[0] = scores[0]
        for i in range(1, n):
            ahead[i] = scores[i] + np.logaddexp(*(ahead[i - 1][:, None] + self.pair))
        for i in range(n - 2, -1, -1):
            back[i] = np.logaddexp(*(self.pair + scores[i + 1] + back[i + 1]).T)
        total = np.logaddexp(*ahead[-1])
        double = np.exp(ahead[:-1, :, None] + self.pair + (scores[1:] + back[1:])[:, None, :] - total).sum(axis=0)
        return np.exp(ahead + back - total), double

    def decode(self, page: list[list[str]]) -> list[int]:
        """The best label sequence."""
        if not page:
            return []
        lists = self.w.tolist()
        (aa, ab), (ba, bb) = self.pair.tolist()
        index, trail = self.index, []
        zero = one = None
        for row in page:
            s0 = s1 = 0.0
            for f in row:
                k = index.get(f)
                if k is not None:
                    u, v = lists[k]
                    s0 += u
                    s1 += v
            if zero is None:
                zero, one = s0, s1
                continue
            from_0, from_1 = zero + aa >= one + ba, zero + ab >= one + bb
            trail.append((0 if from_0 else 1, 0 if from_1 else 1))
            zero, one = s0 + (zero + aa if from_0 else one + ba), s1 + (zero + ab if from_1 else one + bb)
        label = int(one > zero)
        out = [label]
        for step in reversed(trail):
            label = step[label]
            out.append(label)
        return out[::-1]


def stated(page: list[Block]) -> list[int] | None:
    """Labels by markup that states its article; None where it does not."""
    inside = [not STATING.isdisjoint(b.where) for b in page]
    if not any(inside):
        return None
    out = {"anc=nav", "anc=aside", "anc=footer", "anc=form", "name=comment", "name=comments", "name=ad", "name=related", "name=share"}
    return [int(x and out.isdisjoint(b.where)) for x, b in zip(inside, page)]


def train(pages: DataFrame, html_col: str = "html", id_col: str = "page_id", max_pages: int = MAX_PAGES) -> Field:
    """Learn from the packaged pages and from at most ``max_pages`` of the table."""
    rows = pages.select(F.col(f"`{id_col}`").alias("page"), F.col(f"`{html_col}`").alias("html"))
    chosen = bounded_sample(rows.where(F.col("html").rlike("(?i)<(article|main)[ >]")).select("page"), max_pages, "page").distinct()
    # At most max_pages ids: a broadcast of proven size.
    found = rows.join(F.broadcast(chosen), "page").orderBy("page", "html").limit(max_pages).collect()
    return fit([r["html"] for r in found])


def fit(pages: list[str]) -> Field:
    data = []
    for page in EXAMPLES:
        read = blocks(page)
        labels = [int(bool(b.keep)) for b in read]
        rows = features(read)
        data.append((rows, labels, EXAMPLE_WEIGHT))
        data.append(([[f for f in row if f not in STATING] for row in rows], labels, EXAMPLE_WEIGHT))
        # Names and tags alone must tell, too: a text's look says little about comments and notices.
        data.append(([[f for f in row if f.startswith(("anc=", "name=", "role=", "in=", "bias"))] for row in rows], labels, EXAMPLE_WEIGHT))
    for page in pages:
        read = blocks(page)
        labels = stated(read)
        if labels:
            rows = features(read)
            data.append((rows, labels, 1.0))
            data.append(([[f for f in row if f not in STATING] for row in rows], labels, 0.5))
    return Field().fit(data)


def main_text(field: Field, page: str | None) -> str:
    read = blocks(page)
    return " ".join(b.text for b, keep in zip(read, field.decode(features(read))) if keep)


def extracted(pages: DataFrame, field: Field, html_col: str = "html") -> DataFrame:
    """(row, text): every column of ``pages`` in ``row``."""
    @F.arrow_udf(T.StringType())
    def text(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            yield pa.array([main_text(field, p) for p in texts_of(batch)], pa.string())

    source: Column = F.col(f"`{html_col}`")
    return packed(pages, text=text(source))
