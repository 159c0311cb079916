"""Main text of web pages by tag-path ratios.

Every text node of a page belongs to its root-to-leaf tag path. Per path the length of text and the
punctuation are taken relative to the number of nodes; both ratios are smoothed over neighbouring
nodes in page order and fused. Paths whose fused value reaches a share of the page's
length-weighted mean are content. Paths below an element that is never content (menus, footers,
sidebars, forms, scripts, ... by element, role, or class and id words) weigh nothing. Standing below an
``article`` or ``main`` element is one more weight in the fusion and decides nothing alone; an ``article``
below page furniture (a teaser in a sidebar) is furniture, unless the page shows no other text.

* null or empty html gives an empty text
* unclosed and stray tags are repaired as browsers do for paragraphs, lists and tables; an unclosed
  comment or script runs to the end of the page
* character references are decoded once; white space inside a block becomes one space; blocks are
  joined by one line feed in page order; nothing else is dropped or cut
* other columns are never read; an empty table gives an empty result
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Elements of HTML by their role.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe template xmp noembed noframes".split())
NEVER = frozenset(
    """script style noscript iframe template textarea title head nav footer aside form button select
    option datalist label fieldset legend svg math canvas object audio video map dialog menu input""".split()
)
CONTAINERS = frozenset(["article", "main"])
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
BLOCKS = frozenset(
    """address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption
    figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html li main menu nav ol optgroup option p pre section
    summary table tbody td tfoot th thead tr ul""".split()
)
# An opening tag that ends an open paragraph, and tags that end an open one of their own kind.
ENDS_PARAGRAPH = BLOCKS - frozenset("caption html body tbody td tfoot th thead tr option optgroup".split())
ENDS_OWN = {
    "li": ("li",),
    "dt": ("dt", "dd"),
    "dd": ("dt", "dd"),
    "tr": ("tr", "td", "th"),
    "td": ("td", "th"),
    "th": ("td", "th"),
    "option": ("option",),
}
SCOPES = frozenset("ul ol dl table select body html article main section div td th".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert menu menubar toolbar".split())
# Words of class and id names that mark what is not the article: page furniture, which an article may still
# stand in (a wrapper "has-sidebar"), and what never holds it.
FURNITURE = frozenset(
    """sidebar sidebars sidenav aside menu menus nav navbar navigation breadcrumb breadcrumbs header masthead
    footer notice notices search toolbar topbar widget widgets share sharing social modal overlay popup rail""".split()
)
# A name with one of these says how a wrapper is laid out ("has-sidebar"), not what it is.
LAYOUT = frozenset("has have with without no".split())
FOREIGN = frozenset(
    """ad ads advert adverts advertisement advertising banner promo promotion promoted sponsor sponsored cookie
    cookies consent gdpr notification comment comments commentlist respond reply replies discussion disqus
    related recommended recommendations newsletter subscribe subscription signup login pagination pager
    copyright""".split()
)
PUNCTUATION = re.compile(r"[.,;:!?…。、！？；：]")
SHARE = 0.3
INSIDE = 2.0
SMOOTH = 1

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>", re.S
)
_ATTRIBUTE = re.compile(r"(?:^|\s)(class|id|role|hidden)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.I)
_HEADERS = re.compile(r"(?:/(?:header|hgroup))+\Z")
_SPACE = re.compile(r"\s+")
_MARK_WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")


@dataclass
class Node:
    """A run of text: its path, the block it stands in, and where it lies."""

    text: str
    path: str
    block: int
    banned: bool
    inside: bool
    around: bool = False


@dataclass
class _Open:
    name: str
    path: str
    banned: bool
    furniture: bool
    inside: bool
    header: bool = field(default=False)
    around: bool = field(default=False)


def _marks(attributes: str) -> tuple[bool, bool]:
    """Whether class, id, role or hidden say furniture, and foreign."""
    furniture = foreign = False
    for m in _ATTRIBUTE.finditer(attributes):
        name = m.group(1).lower()
        value = m.group(2) or m.group(3) or m.group(4) or ""
        if name == "hidden":
            foreign = True
        elif name == "role":
            furniture |= value.strip().lower() in ROLES
        else:
            for mark in value.split():
                words = {w.lower() for w in _MARK_WORDS.findall(mark)}
                furniture |= not FURNITURE.isdisjoint(words) and LAYOUT.isdisjoint(words)
                foreign |= not FOREIGN.isdisjoint(words)
    return furniture, foreign


def _opened(parent: _Open, name: str, attributes: str) -> _Open:
    furniture, foreign = _marks(attributes) if name != "body" else (False, False)
    banned = parent.banned or foreign or name in NEVER
    container = name in CONTAINERS and not banned
    # Furniture named around the outermost article is noted, apart from what is named inside it. A page has one
    # main element, so that is no furniture.
    around = parent.around or (name == "article" and container and not parent.inside and parent.furniture)
    furniture = False if container and not parent.inside else parent.furniture or (furniture and not container)
    if name == "header" and not parent.inside:
        furniture = True
    return _Open(
        name,
        f"{parent.path}/{name}",
        banned,
        furniture,
        parent.inside or container,
        parent.header or name == "header",
        around,
    )


def text_nodes(page: str) -> list[Node]:
    """All runs of text in page order."""
    root = _Open("", "", False, False, False)
    stack, nodes, block, at = [root], [], 0, 0

    def add(text: str) -> None:
        top = stack[-1]
        if text:
            # The header of an article holds its headings and much else; only the headings are kept.
            headed = top.inside and top.header and not any(o.name in HEADINGS for o in stack)
            banned = top.banned or top.furniture or headed
            nodes.append(Node(html.unescape(text), top.path, block, banned, top.inside, top.around))

    def close(names: tuple[str, ...]) -> None:
        """End the innermost open element of ``names`` in scope, with all inside it."""
        for i in range(len(stack) - 1, 0, -1):
            if stack[i].name in names:
                del stack[i:]
                return
            if stack[i].name in SCOPES:
                return

    while True:
        m = _TOKEN.search(page, at)
        add(page[at : m.start()] if m else page[at:])
        if not m:
            return _without_teasers(nodes)
        at = m.end()
        if m.group(2) is None:
            continue
        name = m.group(2).lower()
        if name in BLOCKS:
            block += 1
        if m.group(1):
            if name == "p" or name not in BLOCKS:
                open_names = [o.name for o in stack]
                if name in open_names:
                    del stack[len(stack) - 1 - open_names[::-1].index(name) :]
            elif any(o.name == name for o in stack):
                while stack.pop().name != name:
                    pass
            continue
        if name in ENDS_PARAGRAPH and any(o.name == "p" for o in stack):
            last = max(i for i, o in enumerate(stack) if o.name == "p")
            if not any(o.name in SCOPES for o in stack[last + 1 :]):
                del stack[last:]
        if name in ENDS_OWN:
            close(ENDS_OWN[name])
        if name in VOID or m.group(3).endswith("/") and name not in BLOCKS and name not in RAW:
            if name in ("br", "hr"):
                nodes.append(Node(" ", stack[-1].path, block, True, False))
            continue
        if name in RAW:
            end = re.compile(rf"</{re.escape(name)}\s*>", re.I).search(page, at)
            at = end.end() if end else len(page)
            continue
        stack.append(_opened(stack[-1], name, m.group(3)))


def _without_teasers(nodes: list[Node]) -> list[Node]:
    """``nodes`` with the articles below furniture banned, if the page shows anything else."""
    if any(not n.banned and not n.around and n.text.strip() for n in nodes):
        for n in nodes:
            n.banned |= n.around
    return nodes


def content_paths(nodes: list[Node]) -> set[str]:
    """The paths whose smoothed, fused ratios mark content."""
    shown = [n for n in nodes if not n.banned and n.text.strip()]
    if not shown:
        return set()
    length, marks, count = {}, {}, {}
    for n in shown:
        size = len(n.text.strip())
        length[n.path] = length.get(n.path, 0) + size
        marks[n.path] = marks.get(n.path, 0) + len(PUNCTUATION.findall(n.text))
        count[n.path] = count.get(n.path, 0) + 1
    text_ratio = np.array([length[n.path] / count[n.path] for n in shown])
    mark_ratio = np.array([1.0 + marks[n.path] / count[n.path] for n in shown])
    container = np.array([INSIDE if n.inside else 1.0 for n in shown])
    fused = np.sqrt(_smoothed(text_ratio) * _smoothed(mark_ratio)) * container
    # A heading is worth what the text it heads is worth.
    for i in range(len(shown) - 2, -1, -1):
        section, _, last = shown[i].path.rpartition("/")
        if last in HEADINGS and shown[i + 1].path.startswith(_HEADERS.sub("", section) + "/"):
            fused[i] = max(fused[i], fused[i + 1])
    sizes = np.array([len(n.text.strip()) for n in shown], dtype=float)
    least = SHARE * float((fused * sizes).sum() / sizes.sum())
    values: dict[str, list[float]] = {}
    for n, value in zip(shown, fused, strict=True):
        values.setdefault(n.path, []).append(float(value))
    # The middle node speaks for a path: its ends may stand next to paths of another kind.
    return {path for path, own in values.items() if np.median(own) >= least}


def _smoothed(values: np.ndarray) -> np.ndarray:
    """Means over each node and its ``SMOOTH`` neighbours on either side, as far as there are any."""
    window, n = np.ones(2 * SMOOTH + 1), len(values)
    spread = np.convolve(np.ones(n), window)[SMOOTH : SMOOTH + n]
    return np.convolve(values, window)[SMOOTH : SMOOTH + n] / spread


def main_text(page: str | None) -> str:
    """The text of the content paths: blocks in page order, one per line."""
    nodes = text_nodes(page or "")
    paths = content_paths(nodes)
    blocks: list[str] = []
    current, parts = None, []
    for n in nodes:
        if n.text != " " and (n.banned or n.path not in paths):
            continue
        if n.block != current:
            blocks.append("".join(parts))
            current, parts = n.block, []
        parts.append(n.text)
    blocks.append("".join(parts))
    clean = (_SPACE.sub(" ", b).strip() for b in blocks)
    return "\n".join(b for b in clean if b)


def extract_pages(pages: DataFrame, key: str = "page_id", content: str = "html") -> DataFrame:
    """(id, text) of every row."""
    rows = pages.select(F.col(key).alias("id"), F.col(content).cast("binary").alias("html"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text((v.as_py() or b"").decode("utf-8", "replace")) for v in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["id", "text"])

    return rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, text string")
