"""Op 9: main text of web pages from flat text blocks.

A page is cut into blocks at block-level tags; nothing of its tree is kept but the kind of place a block stands in.
Each block has its word count and link density, those of the blocks before and after it, and that place; a decision
tree trained on LABELLED, a small table of labelled blocks, keeps or drops it.

Defined results: null html is the empty page, whose text is empty; blocks are kept whole, in page order, joined by one
line feed; character references are decoded once; a page cut off in a tag or comment ends there; pages of any length
are read whole; repeated rows give repeated results; extra columns do not matter.
"""

from __future__ import annotations

import html
import re

import numpy as np
from pyspark.sql import DataFrame

from .tree import fit_tree, predict

#: Names of HTML elements and of common page furniture.
#: Elements without article text: those whose content is no markup, which last to their end tag or to the end of the page,
#: and others, which are skipped only up to an end tag of their own.
RAW, SKIPPED = "script|style|textarea|iframe|title", "template|noscript|svg|object|canvas|select|audio|video"
BLOCK = frozenset(
    "address article aside blockquote body br button caption center datalist dd details dialog dir div dl dt fieldset figcaption figure footer form frameset "
    "h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol option p pre search section summary table tbody td tfoot th thead tr ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
FURNITURE = frozenset("nav header footer aside form menu dialog button datalist fieldset search head".split())
CONTENT = frozenset("article main".split())
FURNITURE_NAMES = frozenset(
    "ad ads advert adverts advertisement adsense banner sponsor sponsored promo promotion nav navbar navigation menu breadcrumb breadcrumbs header masthead footer foot "
    "sidebar aside related recommended recommendations widget comment comments reply replies disqus discussion respondents cookie cookies consent gdpr notice notices alert popup modal "
    "newsletter subscribe subscription signup login share sharing social toolbar pagination pager copyright legal form search skip hidden outbrain taboola rail tags".split()
)
FURNITURE_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())

_REST = r"(?:\"[^\"]*\"|'[^']*'|[^\"'>])*"
_TOKEN = re.compile(
    rf"<!--.*?(?:--!?>|\Z)|<(?P<raw>{RAW})(?=[\s/>]){_REST}>.*?(?:</(?P=raw)\s*>|\Z)|<(?P<end>/?)(?P<tag>[a-zA-Z][^\s/>]*)(?P<attrs>{_REST})(?:>|\Z)|<[!?][^>]*(?:>|\Z)",
    re.S | re.I,
)
_SKIPPED = re.compile(rf"<(/?)({SKIPPED})(?=[\s/>])({_REST})>", re.I)
_ATTR = re.compile(r"(class|id|role|hidden|aria-hidden|style)\s*(?:=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.I)
_NAME = re.compile(r"[a-z]+")
#: Last parts of a class or id that say nothing of what it names: the part before them does.
GENERIC = frozenset("list box wrapper wrap container block section area bar links link buttons button item items content inner outer row col column panel group posts articles text zone slot unit".split())

#: Features of a block: words, link density, words and link density before and after, place (0 furniture, 1 plain, 2 content).
#: Labelled blocks (1: main text), made for this table.
LABELLED = [
    # in an article or main element
    (120, 0.0, 80, 0.0, 90, 0.0, 2, 1), (45, 0.05, 12, 0.0, 60, 0.0, 2, 1), (8, 0.0, 5, 1.0, 70, 0.0, 2, 1), (1, 0.0, 40, 0.0, 30, 0.0, 2, 1),
    (2, 0.0, 0, 0.0, 0, 0.0, 2, 1), (30, 0.3, 25, 0.0, 25, 0.1, 2, 1), (15, 0.5, 30, 0.0, 0, 0.0, 2, 1), (4, 0.0, 6, 0.0, 3, 0.9, 2, 1),
    (60, 0.0, 0, 0.0, 5, 0.1, 2, 1), (300, 0.0, 3, 1.0, 6, 0.0, 2, 1), (6, 0.4, 50, 0.0, 45, 0.0, 2, 1), (3, 0.0, 1, 1.0, 9, 0.0, 2, 1),
    (2, 1.0, 2, 1.0, 2, 1.0, 2, 0), (3, 1.0, 60, 0.0, 3, 1.0, 2, 0), (5, 1.0, 4, 1.0, 0, 0.0, 2, 0), (1, 1.0, 1, 1.0, 1, 1.0, 2, 0),
    (12, 1.0, 9, 1.0, 70, 0.0, 2, 0), (4, 0.95, 2, 1.0, 3, 1.0, 2, 0),
    # in menus, headers, footers, sidebars, notices, adverts, forms, comments
    (1, 1.0, 1, 1.0, 1, 1.0, 0, 0), (2, 0.0, 1, 1.0, 30, 0.0, 0, 0), (7, 0.0, 1, 1.0, 8, 0.0, 0, 0), (40, 0.0, 60, 0.0, 3, 0.0, 0, 0),
    (90, 0.0, 80, 0.0, 40, 0.0, 0, 0), (12, 0.2, 100, 0.0, 0, 0.0, 0, 0), (5, 0.0, 50, 0.0, 0, 0.0, 0, 0), (150, 0.1, 20, 0.0, 30, 0.0, 0, 0),
    (9, 0.0, 9, 0.0, 9, 0.0, 0, 0), (25, 0.9, 3, 1.0, 3, 1.0, 0, 0), (3, 0.0, 0, 0.0, 10, 0.0, 0, 0), (60, 0.0, 7, 0.0, 55, 0.0, 0, 0),
    # elsewhere on the page
    (80, 0.0, 60, 0.0, 75, 0.0, 1, 1), (25, 0.0, 40, 0.0, 30, 0.0, 1, 1), (15, 0.1, 50, 0.0, 60, 0.0, 1, 1), (6, 0.0, 3, 1.0, 55, 0.0, 1, 1),
    (5, 0.0, 45, 0.0, 50, 0.0, 1, 1), (40, 0.2, 8, 0.0, 3, 1.0, 1, 1), (200, 0.0, 0, 0.0, 0, 0.0, 1, 1), (20, 0.0, 0, 0.0, 0, 0.0, 1, 1),
    (12, 0.0, 30, 0.0, 2, 1.0, 1, 1), (3, 0.0, 35, 0.0, 28, 0.0, 1, 1), (18, 0.0, 4, 0.0, 22, 0.0, 1, 1), (30, 0.0, 2, 1.0, 4, 0.0, 1, 1),
    (1, 1.0, 1, 1.0, 1, 1.0, 1, 0), (4, 1.0, 3, 1.0, 5, 1.0, 1, 0), (3, 0.0, 2, 1.0, 2, 1.0, 1, 0), (9, 0.8, 6, 0.7, 8, 0.9, 1, 0),
    (14, 0.7, 10, 0.9, 2, 0.5, 1, 0), (4, 0.0, 1, 1.0, 3, 0.0, 1, 0), (2, 0.0, 4, 0.0, 3, 0.0, 1, 0), (3, 0.5, 2, 0.0, 1, 1.0, 1, 0),
    (5, 0.0, 0, 0.0, 2, 1.0, 1, 0), (2, 0.0, 3, 0.5, 0, 0.0, 1, 0), (30, 0.8, 12, 0.9, 9, 1.0, 1, 0), (6, 0.9, 40, 0.0, 35, 0.0, 1, 0),
]


def train_block_tree() -> tuple:
    table = np.array(LABELLED, dtype=np.float64)
    return fit_tree(table[:, :-1], table[:, -1], depth=8)


def names_furniture(value: str) -> bool:
    """True if a class or id is called after page furniture: by its last part that says something, as in site-footer or comment-list-3."""
    for token in value.split():
        parts = _NAME.findall(token)
        while len(parts) > 1 and parts[-1] in GENERIC:
            parts.pop()
        if parts and parts[-1] in FURNITURE_NAMES and parts[0] not in ("has", "no", "with", "without"):
            return True
    return False


def _place(tag: str, attrs: str) -> int:
    """0 for page furniture, 2 for content, 1 for all else."""
    if tag in FURNITURE:
        return 0
    if attrs and tag not in ("body", "html"):
        for name, a, b, c in _ATTR.findall(attrs):
            name, value = name.lower(), (a or b or c).lower()
            # an article or main element is content, whatever it is called
            if name in ("class", "id") and tag not in CONTENT and names_furniture(value) or name == "role" and value in FURNITURE_ROLES:
                return 0
            if name == "hidden" or name == "aria-hidden" and value == "true" or name == "style" and "display:none" in value.replace(" ", ""):
                return 0
            if name == "role" and value in ("main", "article"):
                return 2
    return 2 if tag in CONTENT else 1


def skips(page: str) -> dict[int, int]:
    """Start and end of the elements SKIPPED that have an end tag of their own; a self-closed one has no content."""
    out, open_at = {}, {}
    for m in _SKIPPED.finditer(page):
        starts = open_at.setdefault(m[2].lower(), [])
        if not m[1] and not m[3].endswith("/"):
            starts.append(m.start())
        elif m[1] and starts:
            out[starts.pop()] = m.end()
    return out


def blocks(page: str) -> list[tuple[str, int, float, int]]:
    """(text, words, link density, place) of each text block with words, in page order."""
    out, parts, link_words, at, link, places = [], [], 0, 0, 0, [("", 1)]

    def close() -> None:
        nonlocal parts, link_words
        if parts and (text := " ".join(html.unescape("".join(parts)).split())):
            words = text.count(" ") + 1
            out.append((text, words, min(1.0, link_words / words), places[-1][1]))
        parts, link_words = [], 0

    ends = skips(page)
    while m := _TOKEN.search(page, at):
        if m.start() > at:
            parts.append(piece := page[at : m.start()])
            link_words += len(piece.split()) if link else 0
        at = ends.get(m.start(), m.end())
        tag = (m["tag"] or "").lower()
        if at > m.end():
            if tag in ("select", "video", "audio"):
                close()
            continue
        if not tag:
            if (m["raw"] or "").lower() in ("title", "textarea", "iframe"):
                close()
            continue
        if tag in BLOCK:
            close()
        if tag == "a":
            link = not m["end"]
        if m["end"]:
            depth = next((k for k in range(len(places) - 1, 0, -1) if places[k][0] == tag), 0)
            if depth:
                del places[depth:]
        elif tag not in VOID and not (m["attrs"] or "").endswith("/"):
            place = _place(tag, m["attrs"])
            if tag == "p" and places[-1][0] == "p":
                places.pop()  # an open paragraph ends where the next begins
            if place != 1 or tag in ("div", "section", "table", "ul", "ol", "dl", "span", "p"):
                around = places[-1][1]
                # furniture inside content is furniture; what stands in furniture stays so
                places.append((tag, around if place == 1 or around == 0 else place))
    if at < len(page):
        parts.append(page[at:])
    close()
    return out


def main_text(page: str | None, tree: tuple) -> str:
    found = blocks(page or "")
    edge = (0, 0.0)
    sizes = [edge, *((b[1], b[2]) for b in found), edge]
    return "\n".join(b[0] for i, b in enumerate(found) if predict(tree, (*sizes[i + 1], *sizes[i], *sizes[i + 2], b[3])) >= 0.5)


def extract_text(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of every row of pages(page_id, url, html)."""
    tree = train_block_tree()

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            texts = [main_text(x.as_py(), tree) for x in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], ["page_id", "url", "text", "n_chars"])

    return pages.selectExpr("cast(page_id as bigint) page_id", "cast(url as string) url", "cast(html as string) html").mapInArrow(run, "page_id bigint, url string, text string, n_chars bigint")
