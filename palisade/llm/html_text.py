"""Main text of web pages: flat text blocks classified by a decision tree.

A page is cut into text blocks at its block-level tags. Every block has its number of words and link density,
those of the blocks before and after it, and what holds it (a container of page furniture, an article, a
heading). A small decision tree, grown from the labelled table below, says which blocks are content.

Null or empty html: empty text. Broken markup (unclosed tags, cut-off pages) is read as far as it goes. Any
length is read whole. Repeated rows: each extracted. Empty table: empty result.
"""

from __future__ import annotations

import html
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palisade.llm.common import ready, slices

#: Elements whose text is never shown or never running text.
SILENT = {"script", "style", "noscript", "template", "svg", "math", "iframe", "object", "canvas", "audio", "video", "head", "select", "option", "textarea", "datalist"}
#: Elements that hold page furniture.
FURNITURE = {"nav", "footer", "aside", "form", "menu", "dialog", "button", "fieldset", "header"}
#: Elements that don't end a block.
INLINE = set("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr img br input".split())
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
#: Words in class, id or role that name page furniture or reader comments.
FURNITURE_NAME = re.compile(
    r"(?:^|[\s_-])(?:ads?|advert\w*|adbox|sponsor\w*|promo\w*|banner|cookies?|consent|notice|alert|popup|modal|newsletter|subscribe|signup|login|comments?|disqus|replies|respond"
    r"|sidebar|menu|nav\w*|breadcrumbs?|footer|masthead|related|recommend\w*|share|sharing|social|widget|toolbar|pagination|pager|copyright)(?:$|[\s_-])", re.I)
ARTICLE_NAME = re.compile(r"(?:^|[\s_-])(?:article|content|main|post|entry|story|body-text|article-body|post-content|entry-content)(?:$|[\s_-])", re.I)
TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']++|\"[^\"]*\"|'[^']*')*+|[^>]*)(?:>|\Z)", re.S)
NAMED = re.compile(r"(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
CLOSED_BY = {t: re.compile(rf"</{t}\s*(?:>|\Z)", re.I) for t in ("script", "style", "noscript", "template", "textarea", "iframe")}

COLUMNS = ["words", "link_density", "words_before", "link_density_before", "words_after", "link_density_after", "furniture", "article", "heading"]
#: Labelled blocks: the columns above, then 1 for content (our own labels).
LABELLED = [
    (1, 1.00, 0, 0.00, 1, 1.00, 1, 0, 0, 0), (2, 1.00, 1, 1.00, 2, 1.00, 1, 0, 0, 0), (9, 0.00, 1, 1.00, 8, 0.00, 1, 0, 0, 0), (14, 0.00, 40, 0.00, 0, 0.00, 1, 0, 0, 0),
    (6, 0.00, 60, 0.05, 0, 0.00, 1, 0, 0, 0), (25, 0.00, 3, 0.00, 40, 0.00, 1, 1, 0, 0), (48, 0.00, 52, 0.00, 31, 0.00, 1, 1, 0, 0), (3, 0.33, 25, 0.00, 5, 0.00, 1, 1, 0, 0),
    (70, 0.02, 6, 0.00, 44, 0.00, 1, 0, 0, 0), (33, 0.10, 2, 1.00, 2, 1.00, 1, 0, 0, 0), (5, 0.00, 0, 0.00, 12, 0.00, 1, 0, 1, 0), (4, 0.00, 30, 0.00, 22, 0.00, 1, 1, 1, 0),
    (8, 0.00, 9, 0.00, 45, 0.00, 0, 1, 1, 1), (45, 0.00, 8, 0.00, 60, 0.00, 0, 1, 0, 1), (1, 0.00, 60, 0.00, 30, 0.00, 0, 1, 0, 1), (2, 0.00, 1, 0.00, 1, 0.00, 0, 1, 0, 1),
    (120, 0.03, 30, 0.00, 0, 0.00, 0, 1, 0, 1), (60, 0.00, 55, 0.00, 14, 0.00, 0, 1, 0, 1), (12, 0.50, 40, 0.00, 33, 0.02, 0, 1, 0, 1), (3, 1.00, 48, 0.00, 25, 0.00, 0, 1, 0, 1),
    (18, 0.11, 70, 0.00, 6, 0.00, 0, 1, 0, 1), (6, 0.00, 6, 0.00, 7, 0.00, 0, 1, 0, 1), (9, 0.00, 0, 0.00, 0, 0.00, 0, 1, 1, 1), (30, 0.00, 2, 1.00, 9, 0.00, 0, 1, 0, 1),
    (2, 0.00, 30, 0.00, 2, 0.50, 0, 1, 0, 1), (11, 0.00, 9, 0.00, 3, 1.00, 0, 1, 0, 1), (40, 0.00, 3, 1.00, 1, 1.00, 0, 1, 0, 1), (1, 1.00, 1, 1.00, 1, 1.00, 0, 1, 0, 1),
    (4, 0.00, 2, 0.50, 6, 0.67, 0, 1, 0, 1), (90, 0.40, 5, 1.00, 4, 1.00, 0, 1, 0, 1), (3, 0.67, 60, 0.30, 50, 0.90, 0, 1, 0, 1), (7, 0.00, 0, 0.00, 8, 0.80, 0, 1, 1, 1),
    (50, 0.00, 7, 0.00, 42, 0.00, 0, 0, 0, 1), (62, 0.00, 40, 0.00, 2, 1.00, 0, 0, 0, 1), (44, 0.04, 3, 1.00, 3, 1.00, 0, 0, 0, 1), (35, 0.00, 33, 0.00, 12, 0.75, 0, 0, 0, 1), (38, 0.05, 50, 0.00, 29, 0.00, 0, 0, 0, 1), (26, 0.00, 38, 0.05, 3, 1.00, 0, 0, 0, 1), (80, 0.08, 1, 1.00, 33, 0.00, 0, 0, 0, 1),
    (17, 0.00, 44, 0.00, 52, 0.00, 0, 0, 0, 1), (7, 0.00, 2, 1.00, 50, 0.00, 0, 0, 1, 1), (5, 0.00, 41, 0.00, 36, 0.00, 0, 0, 1, 1), (21, 0.10, 15, 0.00, 64, 0.00, 0, 0, 0, 1),
    (1, 1.00, 1, 1.00, 1, 1.00, 0, 0, 0, 0), (3, 1.00, 2, 1.00, 50, 0.00, 0, 0, 0, 0), (2, 0.50, 26, 0.00, 2, 1.00, 0, 0, 0, 0), (4, 0.00, 2, 1.00, 3, 1.00, 0, 0, 0, 0),
    (6, 0.67, 3, 1.00, 5, 0.80, 0, 0, 0, 0), (28, 0.90, 4, 1.00, 6, 1.00, 0, 0, 0, 0), (15, 0.80, 30, 0.00, 2, 1.00, 0, 0, 0, 0), (2, 0.00, 1, 1.00, 1, 1.00, 0, 0, 0, 0),
    (3, 0.00, 4, 0.00, 2, 0.00, 0, 0, 0, 0), (5, 0.40, 0, 0.00, 3, 1.00, 0, 0, 0, 0), (4, 1.00, 22, 0.00, 0, 0.00, 0, 0, 0, 0), (12, 0.75, 2, 1.00, 9, 0.50, 0, 0, 0, 0),
]


class Tree:
    """A decision tree: splits by least Gini impurity until leaves are pure."""

    def __init__(self, rows: np.ndarray, labels: np.ndarray, least: int = 1):
        self.value = bool(labels.mean() >= 0.5)
        self.column = None
        if labels.min() == labels.max() or len(rows) < 2 * least:
            return
        best = None
        for c in range(rows.shape[1]):
            for cut in np.unique(rows[:, c])[:-1]:
                low = rows[:, c] <= cut
                if min(low.sum(), (~low).sum()) < least:
                    continue
                impurity = sum(len(p) * p.mean() * (1 - p.mean()) for p in (labels[low], labels[~low]))
                if best is None or impurity < best[0] - 1e-12:
                    above = rows[~low, c].min()
                    best = (impurity, c, (cut + above) / 2, low)
        if best is not None:
            _, self.column, self.cut, low = best
            self.low, self.high = Tree(rows[low], labels[low], least), Tree(rows[~low], labels[~low], least)

    def says(self, rows: np.ndarray) -> np.ndarray:
        if self.column is None:
            return np.full(len(rows), self.value)
        low = rows[:, self.column] <= self.cut
        out = np.empty(len(rows), bool)
        out[low], out[~low] = self.low.says(rows[low]), self.high.says(rows[~low])
        return out


def grown(labelled=None) -> Tree:
    table = np.array(LABELLED if labelled is None else labelled, float)
    return Tree(table[:, :-1], table[:, -1])


def text_blocks(page: str) -> list[tuple[str, int, int, int, int, int]]:
    """(text, words, linked words, furniture, article, heading) of every non-empty block in page order."""
    out: list[tuple[str, int, int, int, int, int]] = []
    stack: list[tuple[str, bool, bool]] = []  # open block elements: name, furniture, article
    parts: list[str] = []
    linked: list[str] = []
    silent, link, heading, at = 0, False, 0, 0

    def flush():
        nonlocal heading
        if parts:
            words = html.unescape("".join(parts)).split()
            if words:
                n_linked = len(html.unescape(" ".join(linked)).split())
                out.append((" ".join(words), len(words), min(n_linked, len(words)), int(any(s[1] for s in stack)), int(any(s[2] for s in stack)), int(heading > 0)))
        parts.clear()
        linked.clear()

    def say(text: str):
        if text and not silent:
            parts.append(text)
            if link:
                linked.append(text)

    position, end = 0, len(page)
    while position < end:
        m = TOKEN.search(page, position)
        if m is None:
            say(page[position:])
            break
        say(page[position:m.start()])
        position = m.end()
        name = (m[2] or "").lower()
        if not name:
            continue
        if m[1]:
            if name == "a":
                link = False
            elif name in INLINE:
                continue
            else:
                flush()
                if re.fullmatch("h[1-6]", name):
                    heading = 0
                if any(s[0] == name for s in stack):
                    while stack:
                        top = stack.pop()
                        silent -= top[0] in SILENT
                        if top[0] == name:
                            break
            continue
        if name == "br":
            say(" ")
            continue
        if name in CLOSED_BY:
            flush() if name not in INLINE else None
            close = CLOSED_BY[name].search(page, position)
            position = close.end() if close else end
            continue
        if name == "a":
            link = True
        if name in INLINE:
            continue
        flush()
        if name in VOID or m[3].rstrip().endswith("/"):
            continue
        if name == "body":  # an unclosed head ends here
            silent, stack = 0, []
        if name in ("p", "li", "td", "th", "tr", "dt", "dd") and stack and stack[-1][0] == name:
            stack.pop()  # these close one another
        link = False
        heading = int(bool(re.fullmatch("h[1-6]", name)))
        inside = any(s[2] for s in stack)
        named = " ".join(x for g in NAMED.findall(m[3]) for x in g if x) if m[3] else ""
        article = name in ("article", "main") or bool(named and ARTICLE_NAME.search(named))
        own = name in FURNITURE and not (name == "header" and inside)
        furniture = own or name not in ("body", "html", "main") and bool(named and FURNITURE_NAME.search(named))
        stack.append((name, furniture, article))
        silent += name in SILENT
    flush()
    return out


def extract(page: str | None, tree: Tree) -> str:
    """The content blocks of a page, one a line."""
    blocks = text_blocks(page) if page else []
    if not blocks:
        return ""
    words = np.array([b[1] for b in blocks], float)
    density = np.array([b[2] for b in blocks], float) / words
    zero = np.zeros(1)
    rows = np.column_stack([words, density, np.concatenate([zero, words[:-1]]), np.concatenate([zero, density[:-1]]), np.concatenate([words[1:], zero]), np.concatenate([density[1:], zero]),
                            *[np.array([b[k] for b in blocks], float) for k in (3, 4, 5)]])
    return "\n".join(b[0] for b, keep in zip(blocks, tree.says(rows)) if keep)


def extracted(pages: DataFrame, labelled: list[tuple] | None = None) -> DataFrame:
    """Per row: page_id, url, text, n_chars (code points of text)."""
    ready(pages.sparkSession)
    slim = pages.select("page_id", "url", "html")
    tree = grown(labelled)

    def rows(batches):
        for b in slices(batches, "html"):
            texts = [extract(h, tree) for h in b.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("page_id"), b.column("url"), pa.array(texts, pa.string())], names=["page_id", "url", "text"])

    kinds = slim.select("page_id", "url", F.lit("").alias("text")).schema
    for f in kinds:
        f.nullable = True
    return slim.mapInArrow(rows, kinds).withColumn("n_chars", F.char_length("text").cast("bigint"))
