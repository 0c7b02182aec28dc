"""Main text of web pages by tag-path ratios.

A page is cut into blocks of text, each with its path of block elements from the root (tags with their
class names). Blocks of one path are judged together: text length and punctuation per block are
aggregated per path, smoothed over the paths in page order, and fused by their product. Paths whose
fused ratio passes the page's threshold show where the content is; its container is the innermost
article or main element around the best of them, or else what all of them have in common. Every path in
the container that is no page furniture is content, so that short paragraphs stay.

Furniture (menus, headers and footers of the page, sidebars, notices, adverts, forms, scripts, styles,
reader comments) is told by elements and by whole class names, ids and roles, and counts neither for ratios
nor for the result. html, body, main and article are never furniture. Where no article or main is left with
text, an element that holds one and more text than is left, or that has a name of furniture and holds most
text of the page, is a wrapper of the content and no furniture either.

Null, empty and text-less pages give an empty text. Very long pages are read whole, one at a time; rows
are independent, so repeated rows and null ids are kept. Other columns are not read.
"""

import html
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pricetrail.llm.common import Batches, by_rows

#: Element and class names.
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset "
    "figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav "
    "ol p pre search section summary table tbody td tfoot th thead tr ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose content is no text of the page.
HIDDEN = frozenset(
    "script style noscript template title textarea select option button svg iframe object "
    "canvas audio video datalist".split()
)
RAW = frozenset("script style title textarea noscript iframe".split())
FURNITURE_TAGS = frozenset("nav footer aside form menu dialog search fieldset".split())
FURNITURE_NAMES = frozenset(
    "ad ads adbox ad-banner advert adverts advertisement advertising banner comment comments comment-list "
    "commentlist comments-area consent cookie cookies cookie-banner cookie-consent cookie-notice disqus "
    "footer page-footer site-footer gdpr menu main-menu nav-menu site-menu nav navbar navigation "
    "main-navigation site-navigation notice notices page-header site-header sidebar sponsored".split()
)
#: Never furniture; elements that are furniture wherever they stand; those that may wrap the content.
CONTENT = frozenset("html body main article".split())
FIXED_TAGS = frozenset("nav footer menu dialog search".split())
#: Furniture only outside articles, where they hold the title.
PAGE_HEADERS = frozenset(("header", "masthead"))
SCOPES = frozenset(("article", "main"))
PARAGRAPH_ENDERS = BLOCKS - {"html", "body"}

_TAG = re.compile(
    r"<!--(?:.*?-->|.*\Z)"
    r"|<([/!?]?)([a-zA-Z][^\s/>]*)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>"
    r"|<([/!?]?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)"
    r"|</?[!?][^>]*(?:>|\Z)",
    re.S,
)
_NAMES = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_PUNCTUATION = re.compile(r"[.,;:!?…。，、！？«»\"'()–—-]")

#: Weights of a path and its neighbours in page order.
KERNEL = np.array([0.25, 0.5, 0.25])
#: Paths pass with this share of the page's highest fused ratio.
SHARE = 0.2


@dataclass(frozen=True)
class Block:
    path: tuple[str, ...]
    text: str


def _furniture(tag: str, names: str, in_scope: bool) -> tuple[bool, bool]:
    """Whether an element is furniture, and whether only its names say so."""
    if tag in CONTENT:
        return False, False
    words = set(names.lower().split())
    by_tag = tag in FURNITURE_TAGS or (not in_scope and tag in PAGE_HEADERS)
    by_name = bool(words & FURNITURE_NAMES) or (not in_scope and bool(words & PAGE_HEADERS))
    return by_tag or by_name, by_name and not by_tag


@dataclass
class Furniture:
    """An element held for furniture, and the furniture around it by number."""

    outer: int
    named: bool
    fixed: bool
    dropped: bool = True


def wrappers(found: list[tuple[Block, int, int]], elements: list[Furniture]) -> None:
    """Mark furniture that wraps the page's content as none.

    `found` has for each block the number of its innermost furniture, and of the furniture around its
    innermost article or main; -1 is none, and the latter is -2 without article and main.
    """
    total = sum(len(b.text) for b, _, _ in found)
    while True:
        # The outermost dropped element around each, by numbers in the order of opening.
        top = [-1] * len(elements)
        for k, e in enumerate(elements):
            above = top[e.outer] if e.outer >= 0 else -1
            top[k] = above if above >= 0 else k if e.dropped else -1
        sizes, scoped, left = [0] * len(elements), [False] * len(elements), 0
        for block, inner, scope in found:
            at = top[inner] if inner >= 0 else -1
            if at < 0:
                if scope > -2:
                    return
                left += len(block.text)
                continue
            sizes[at] += len(block.text)
            scoped[at] |= scope >= 0 and top[scope] == at
        best = max(
            (k for k, e in enumerate(elements) if sizes[k] and not e.fixed
             and (scoped[k] and sizes[k] > left or e.named and 2 * sizes[k] > total)),
            key=lambda k: (scoped[k], sizes[k]), default=None,
        )
        if best is None:
            return
        elements[best].dropped = False


def blocks(page: str) -> Iterator[Block]:
    """The page's text outside furniture, in page order, white space collapsed."""
    found, elements = all_blocks(page)
    if any(inner >= 0 for _, inner, _ in found):
        wrappers(found, elements)
    kept = []
    for e in elements:
        kept.append(not e.dropped and (e.outer < 0 or kept[e.outer]))
    return (b for b, inner, _ in found if inner < 0 or kept[inner])


def all_blocks(page: str) -> tuple[list[tuple[Block, int, int]], list[Furniture]]:
    """All of the page's text in page order, as `wrappers` takes it, and the furniture."""
    #: Open block elements: tag, path component, innermost furniture, that around the innermost scope.
    stack: list[tuple[str, str, int, int]] = []
    found: list[tuple[Block, int, int]] = []
    elements: list[Furniture] = []
    held: list[str] = []
    at, hidden = 0, ""

    def flush() -> None:
        text = " ".join("".join(held).split())
        held.clear()
        if text:
            inner, scope = stack[-1][2:] if stack else (-1, -2)
            found.append((Block(tuple(part for _, part, *_ in stack), text), inner, scope))

    def keep(raw: str) -> None:
        if raw and not hidden:
            held.append(html.unescape(raw) if "&" in raw else raw)

    for tag in _TAG.finditer(page):
        keep(page[at : tag.start()])
        if tag.start() < at:
            continue  # inside a raw element
        at = tag.end()
        close, name, attributes = (tag[1], tag[2], tag[3]) if tag[2] else (tag[4], tag[5], tag[6])
        if not name or close in ("!", "?"):
            continue
        name = name.lower()
        if hidden:
            if close and name == hidden:
                hidden = ""
            continue
        if name in HIDDEN:
            if not close and not attributes.endswith("/"):
                if name in RAW:
                    end = re.compile(rf"</{name}\b[^>]*>", re.I).search(page, at)
                    at = end.end() if end else len(page)
                else:
                    hidden = name
            continue
        if name == "br":
            held.append(" ")
            continue
        if name not in BLOCKS:
            continue
        flush()
        if close:
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == name:
                    del stack[k:]
                    break
            continue
        # An open paragraph ends before any block; items, cells and the like end before their own.
        if name in PARAGRAPH_ENDERS and stack and stack[-1][0] == "p":
            stack.pop()
        if stack and stack[-1][0] == name and name in ("li", "dt", "dd", "tr", "td", "th"):
            stack.pop()
        if name in VOID:
            continue
        names = " ".join(a or b or c for a, b, c in _NAMES.findall(attributes)) if attributes else ""
        inner, scope = stack[-1][2:] if stack else (-1, -2)
        furniture, named = _furniture(name, names, scope > -2)
        if furniture:
            elements.append(Furniture(inner, named, name in FIXED_TAGS))
            inner = len(elements) - 1
        if name in SCOPES:
            scope = inner
        stack.append((name, f"{name}.{names}" if names else name, inner, scope))
    keep(page[at:])
    flush()
    return found, elements


def path_scores(found: list[Block]) -> dict[tuple[str, ...], float]:
    """The fused ratio of each path: smoothed text length times smoothed punctuation per block."""
    paths = list(dict.fromkeys(b.path for b in found))
    at = {path: k for k, path in enumerate(paths)}
    sums = np.zeros((len(paths), 3))
    for b in found:
        sums[at[b.path]] += (len(b.text), len(_PUNCTUATION.findall(b.text)), 1)
    ratios = sums[:, :2] / sums[:, 2:]
    # At the ends of the page a path stands in for the neighbour it lacks.
    padded = np.pad(ratios, ((1, 1), (0, 0)), mode="edge")
    smooth = sum(w * padded[k : k + len(paths)] for k, w in enumerate(KERNEL))
    # The path's own size decides between its neighbours' equals.
    fused = smooth[:, 0] * (1 + smooth[:, 1]) * np.log1p(sums[:, 0])
    return dict(zip(paths, fused.tolist()))


def container(scores: dict[tuple[str, ...], float]) -> tuple[str, ...]:
    """The path of the element that holds the content."""
    best = max(scores, key=lambda path: (scores[path], len(path)))
    scopes = [k for k, part in enumerate(best) if part.split(".")[0] in SCOPES]
    if scopes:
        return best[: scopes[-1] + 1]
    passed = [path for path, score in scores.items() if score >= SHARE * scores[best]]
    # Where one path passed, its parent: its siblings are paragraphs of the same text.
    common = min(map(len, passed)) - (len(passed) == 1)
    while any(path[:common] != best[:common] for path in passed):
        common -= 1
    return best[: max(common, 0)]


def main_text(page: str | None) -> str:
    found = list(blocks(page or ""))
    if not found:
        return ""
    root = container(path_scores(found))
    return "\n".join(b.text for b in found if b.path[: len(root)] == root)


def extract(
    df: DataFrame, page: str = "html", key: str = "page_id", url: str = "url"
) -> DataFrame:
    """`key`, `url`, `text` and `n_chars` of every page."""

    def run(batches: Batches) -> Batches:
        for batch in by_rows(batches):
            texts = [main_text(value.as_py()) for value in batch.column("_page")]
            yield pa.RecordBatch.from_arrays(
                [batch.column(key), batch.column(url), pa.array(texts, pa.string()),
                 pa.array([len(t) for t in texts], pa.int64())],
                names=[key, url, "text", "n_chars"],
            )

    rows = df.select(
        F.col(key).cast("long").alias(key), F.col(url).cast("string").alias(url),
        F.col(page).cast("string").alias("_page"),
    )
    return rows.mapInArrow(run, f"`{key}` long, `{url}` string, text string, n_chars long")
