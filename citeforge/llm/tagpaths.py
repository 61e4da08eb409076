"""Main text of web pages by tag-path ratios.

A page is read once into text nodes, each with the path of tags (and classes) that leads to it. For
each path, characters and punctuation marks a node are aggregated over the page; both ratios are
smoothed along the page by a Gaussian window, averaged for each path again, and fused as two supports
for "content". Paths above half the page's mean score, weighted by characters, are content. The
innermost container that holds nearly all of them is the article; what lies between its first and
last content block is its text. Where the page marks an article itself, its bounds are that element.

Elements that are something else by their tag, role, class or id (menus, footers, adverts, forms,
comments and so on) are left out before, so they take no part in the ratios; where nothing would be
left, names of classes and ids are ignored.

Rows: a null or empty html, or one without text, gives the empty text; pages that occur twice are
extracted twice, null ids and urls are kept. Unclosed elements, tags and comments end with the page.
A page of any length is read whole, in time in proportion to its length. Of paths with equal scores
all are content or none. An empty table gives no rows. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import html
import re
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from citeforge.llm.textvec import column

#: Markup: comments, tags with quoted values, declarations. Parts that are not closed reach to the end.
_MARKUP = re.compile(r"<!--.*?(?:--!?>|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>=]++|=\s*+(?:\"[^\"]*+(?:\"|\Z)|'[^']*+(?:'|\Z))?+)*+)(?:>|\Z)|<[!?/][^>]*+(?:>|\Z)", re.S)
_NAME = re.compile(r"""(?:^|\s)(class|id|role)\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)""", re.I)
_HIDDEN = re.compile(r"(?:^|\s)hidden(?:\s|=|$)|display\s*:\s*none", re.I)
_MARKS = re.compile(r"[.,;:!?…¿¡。、，；：！？]")
_LETTERS = re.compile(r"[^a-z]+")

_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
_BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html li main menu nav ol option p pre search section summary table tbody td tfoot th thead tr ul".split()
)
_BOXES = frozenset("html body div section article main td center table tbody tr".split())
_HEADING = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Never part of the main text.
_OTHER = frozenset("head script style noscript template nav footer aside form button select textarea fieldset iframe object svg canvas audio video dialog menu search math map".split())
_ROLES = frozenset("navigation banner complementary contentinfo search alert alertdialog dialog menu menubar toolbar form".split())
_NAMES = frozenset(
    "ad ads advert adverts advertisement advertising adsense banner sponsor sponsored promo promotion sidebar comment comments commentlist disqus respond cookie cookies consent gdpr notice notices notification alert newsletter subscribe subscription signup signin login register popup modal overlay share sharing social related recommended recommendations trending breadcrumb breadcrumbs menu nav navbar navigation topbar toolbar footer masthead header pagination pager copyright disclaimer paywall widget skip".split()
)
_LAYOUT = frozenset(("with", "has", "no"))  # "with-sidebar" names the box beside one
#: Start tags that end an open element of the first kind, unless one of the second lies between.
_ENDS = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "option": ({"option"}, {"select"}),
    "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"table", "tr"}), "th": ({"td", "th"}, {"table", "tr"}),
}

_KERNEL = np.exp(-0.5 * np.arange(-2, 3) ** 2)
_SHARE = 0.9  # of the content's characters that the article's container holds


class Page:
    """A page's text nodes. ``nodes`` are (text, path, box, block, in a link, in an item, in an article, in a heading);
    a box is an element that can contain an article, with its parent, tag and path."""

    def __init__(self, source: str, by_name: bool = True):
        self.nodes: list[tuple] = []
        self.boxes: list[tuple[int, str, int]] = [(-1, "", 0)]
        self.by_name = by_name
        self._read(source)

    def _excluded(self, tag: str, attributes: str, in_article: bool) -> tuple[bool, str]:
        """Whether the element is something else than main text, and its class."""
        if tag in _OTHER or (tag == "header" and not in_article):
            return True, ""
        if len(attributes) < 4:
            return False, ""
        found = {k.lower(): v.strip("\"'").lower() for k, v in reversed(_NAME.findall(attributes))}
        kind = found.get("class", "")
        if tag in ("html", "body", "main", "article") and "comment" not in kind:
            return False, kind
        if found.get("role") in _ROLES or ("hid" in attributes or "none" in attributes) and _HIDDEN.search(attributes):
            return True, kind
        if self.by_name and ("class" in found or "id" in found):
            names = set(_LETTERS.split(f"{kind} {found.get('id', '')}"))
            hit = names & _NAMES
            if in_article and hit == {"header"}:
                hit = set()
            return bool(hit) and not names & _LAYOUT, kind
        return False, kind

    def _read(self, source: str) -> None:
        paths: dict[tuple[int, str], int] = {}
        # An open element: tag, path, box, left out, in a link, in an item, in an article, in a heading.
        stack = [("", 0, 0, False, False, False, False, False)]
        places: dict[str, list[int]] = defaultdict(list)  # of open elements in the stack, by tag; "block" has those of all blocks
        block, at, size = 0, 0, len(source)

        def text(upto: int) -> None:
            top = stack[-1]
            if upto > at and not top[3]:
                piece = source[at:upto]
                self.nodes.append((html.unescape(piece) if "&" in piece else piece, top[1], top[2], block, *top[4:]))

        def last(tags) -> int:
            return max((places[t][-1] for t in tags if places[t]), default=0)

        def close(tags, bounds) -> None:
            """End the innermost of the tags and all in it, unless one of the bounds lies between."""
            k = last(tags)
            if k > last(bounds):
                while len(stack) > k:
                    gone = stack.pop()[0]
                    places[gone].pop()
                    if gone in _BLOCK:
                        places["block"].pop()

        while at < size:
            m = _MARKUP.search(source, at)
            if not m:
                text(size)
                break
            text(m.start())
            at = m.end()
            tag = (m[2] or "").lower()
            if not tag:
                continue
            breaks = tag in _BLOCK
            block += breaks
            if m[1]:
                if not breaks:  # an inline element ends only inside its block
                    close((tag,), ("block",))
                elif tag not in ("html", "body"):
                    close((tag,), ())
                continue
            if tag == "br":
                if not stack[-1][3]:
                    self.nodes.append((" ", stack[-1][1], stack[-1][2], block, *stack[-1][4:]))
            elif breaks or tag in _ENDS:
                if places["p"] and places["p"][-1] == last(("block",)):  # only inline elements are open in it
                    close(("p",), ())
                if tag in _ENDS:
                    close(*_ENDS[tag])
            if tag in _VOID:
                continue
            _, path, box, out, link, item, article, heading = stack[-1]
            if not out:
                out, kind = self._excluded(tag, m[3], article)
                path = paths.setdefault((path, f"{tag}.{kind}"), len(paths) + 1)
                article = article or tag in ("article", "main")
                if tag in _BOXES:
                    self.boxes.append((box, tag, path))
                    box = len(self.boxes) - 1
            if tag in _RAW:
                end = re.compile(f"</{tag}", re.I).search(source, at)
                at = end.start() if end else size
            places[tag].append(len(stack))
            if breaks:
                places["block"].append(len(stack))
            stack.append((tag, path, box, out, link or tag == "a", item or tag == "li", article, heading or tag in _HEADING))
        self.n_paths = len(paths) + 1


def path_scores(path: np.ndarray, chars: np.ndarray, marks: np.ndarray, n_paths: int) -> np.ndarray:
    """The fused score of each path, from the characters and marks of its nodes in page order."""
    nodes = np.bincount(path, minlength=n_paths)
    known = np.maximum(nodes, 1)
    support = []
    for amount in (chars, marks):
        ratio = (np.bincount(path, amount, n_paths) / known)[path]
        weight = np.convolve(np.ones(len(path)), _KERNEL)[2:-2]
        smooth = np.convolve(ratio, _KERNEL)[2:-2] / weight
        score = np.bincount(path, smooth, n_paths) / known
        support.append(score / max(score.max(initial=0.0), 1e-9))
    a, b = support
    return a + b - a * b


def _container(boxes: list[tuple[int, str, int]], box: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Whether each box lies in the innermost one that holds nearly all of the weight."""
    own = np.bincount(box, weight, len(boxes))
    for e in range(len(boxes) - 1, 0, -1):
        own[boxes[e][0]] += own[e]
    alike: dict[tuple[int, int], float] = {}
    for e in range(1, len(boxes)):
        key = boxes[e][0], boxes[e][2]
        alike[key] = alike.get(key, 0.0) + own[e]
    inside = np.zeros(len(boxes), bool)
    best = 0
    for e in range(1, len(boxes)):  # boxes come in page order, so an outer one is met before its inner ones
        parent, tag, path = boxes[e]
        if parent == best and boxes[best][1] != "article" and own[e] >= _SHARE * own[0] > 0 and (tag == "article" or own[e] == alike[parent, path]):
            best = e
    inside[best] = True
    for e in range(best + 1, len(boxes)):
        inside[e] = inside[boxes[e][0]]
    return inside


def main_text(source: str | None) -> str:
    """The page's main text: its blocks in page order, one a line."""
    page = Page(source or "")
    if not any(x[0].strip() for x in page.nodes):
        page = Page(source or "", by_name=False)
    nodes = page.nodes
    seen = [k for k, x in enumerate(nodes) if x[0].strip()]
    if not seen:
        return ""
    in_article = np.fromiter((nodes[k][6] for k in seen), bool, len(seen))
    path = np.fromiter((nodes[k][1] for k in seen), np.int64, len(seen))
    chars = np.fromiter((len(nodes[k][0]) for k in seen), float, len(seen))
    marks = np.fromiter((len(_MARKS.findall(nodes[k][0])) for k in seen), float, len(seen))
    scores = path_scores(path, chars, marks, page.n_paths)[path]
    content = scores >= 0.5 * (scores * chars).sum() / chars.sum()
    marked = bool(in_article.any())
    if marked:
        content = content & in_article if (content & in_article).any() else in_article
    inside = _container(page.boxes, np.fromiter((nodes[k][2] for k in seen), np.int64, len(seen)), np.where(content, chars, 0.0))
    good = {k for k, c in zip(seen, content, strict=True) if c}
    blocks: dict[int, list[int]] = {}
    for k, x in enumerate(nodes):
        if inside[x[2]] and (x[6] or not marked):
            blocks.setdefault(x[3], []).append(k)
    kept = [b for b in blocks.values() if any(nodes[k][0].strip() for k in b) and (not all(nodes[k][4] and nodes[k][5] or not nodes[k][0].strip() for k in b) or any(k in good for k in b))]
    if not marked:
        hits = [i for i, b in enumerate(kept) if any(k in good for k in b)]
        first = hits[0] if hits else 0
        while first and any(nodes[k][7] for k in kept[first - 1]):
            first -= 1
        kept = kept[first : hits[-1] + 1] if hits else kept
    return "\n".join(" ".join("".join(nodes[k][0] for k in b).split()) for b in kept)


def extract(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) of pages with page_id, url and html, in one pass and without a shuffle."""
    rows = pages.select("page_id", "url", "html")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(x.as_py()) for x in column(batch, "html")]
            yield pa.RecordBatch.from_arrays(
                [column(batch, "page_id"), column(batch, "url"), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], names=["page_id", "url", "text", "n_chars"]
            )

    schema = rows.select("page_id", "url").schema.add("text", "string").add("n_chars", "long")
    return rows.mapInArrow(run, schema)


def op12_tag_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of all pages."""
    return extract(spark.read.parquet(f"{sf_dir}/pages.parquet"))
