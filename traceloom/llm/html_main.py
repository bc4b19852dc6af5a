"""Main text of web pages by consensus of container paths over each host.

1. Every page is parsed once, in time linear in its length. Text outside of menus, page headers, footers, sidebars,
   notices, adverts, forms and comments falls into blocks; a block is prose, a heading or neither, by its element, its
   length and the share of it that is links. The smallest container that holds nearly all prose is the page's
   candidate, named by its generalised tag-class path. Containers around it are taken instead while what they add is
   prose, or headings before it, rather than anything else: a headline or lead before the box of the body.
2. Spark counts the candidates of each host; the path with the most votes wins.
3. Every page is read again with its host's winning path; a page that lacks it, or has no text there, uses its own
   candidate. So does a page whose own candidate is an article or main of which that path holds only a part.

Class, id and role names decide alone where the whole name marks an element outside of articles (``ad``, ``share-box``,
``site-header``). Where such a word is only part of a name (``related-work``, ``market-share``), the element is left out
only if links make up half of it. The header of an article belongs to it.

Only (host, path) votes are shuffled, summed before they are, never pages: a host with a third of all pages is no
burden, and its winner reaches the pages by a join on the host.

Defined results: null or empty html has empty text; a null url counts as the empty host; malformed markup is read
leniently (unclosed elements end with their parent); a tie of votes goes to the path that is last in code-point order;
repeated rows give the same text; very long pages are read whole; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from html import unescape
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches, written

_ATTRIBUTES = r"""((?:[^>"']++|"[^"]*+"|'[^']*+')*+)"""
TOKEN = re.compile(rf"<!--.*?(?:-->|\Z)|<[!?][^>]*+>|<(/?)([a-zA-Z][a-zA-Z0-9:-]*+)(?:{_ATTRIBUTES}>|([^>]*+)>)", re.S)
_CLASS = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_CLASS_ONLY = re.compile(r"""\bclass\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)

RAW = frozenset("script style noscript template textarea title iframe svg object canvas select".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
CONTAINERS = frozenset("article main section div td body".split())
BLOCKS = CONTAINERS | frozenset(
    "p h1 h2 h3 h4 h5 h6 li ul ol dl dt dd table thead tbody tfoot tr th caption header footer nav aside form fieldset blockquote pre figure figcaption address html head details summary hr center".split()
)
#: Elements that are never part of an article, and words in class, id or role that mark such elements.
ASIDE_TAGS = frozenset("nav header footer aside form menu dialog button".split())
ASIDE_WORDS = frozenset(
    "ad ads advert adverts advertisement banner sponsor sponsored promo nav navbar navigation menu menubar breadcrumb breadcrumbs sidebar side footer header masthead topbar "
    "comment comments reply replies disqus respond notice notices cookie cookies consent alert gdpr popup modal overlay newsletter subscribe signup share sharing social related "
    "recommended widget toolbar pagination pager login search skip".split()
)
#: Words that leave the meaning of a name with one of the above as it is.
COMPANIONS = frozenset(
    "box list slot unit wrapper wrap container inner outer left right top bottom site page global section posts links link buttons button bar block area item items icon icons "
    "form text message inline small large main primary secondary post entry article content user thread count title col column group zone rail tools panel js fixed sticky".split()
)
#: Words that make a header one of an article's own.
OWN_HEADER = frozenset("article entry post story content".split())
#: Elements that a start tag of the same set ends, and those beyond which it ends none.
_CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
_FENCES = frozenset({"ul", "ol", "dl", "table"}) | (CONTAINERS - {"td"})
PROSE_TAGS = frozenset("p blockquote pre".split())
#: Characters from which a block is prose: in elements of running text, and elsewhere.
PROSE, LOOSE_PROSE = 25, 80
#: Share of a page's prose that its candidate holds, and the depth to which paths are told apart.
HELD, DEPTH = 0.85, 64


@dataclass
class Node:
    tag: str
    path: str
    depth: int
    aside: bool
    parent: int
    #: Only part of its name marks an aside: links decide.
    doubtful: bool = False
    #: First block inside, and the one after the last.
    first: int = 0
    last: int = 0
    size: int = 0


@dataclass
class Block:
    container: int
    text: str
    kind: str  # prose, head or other
    links: int


@dataclass
class Page:
    nodes: list[Node] = field(default_factory=list)
    #: In page order, without those of asides.
    blocks: list[Block] = field(default_factory=list)
    #: Running sums over the blocks: characters of prose, of headings, of all.
    sums: dict[str, list[int]] = field(default_factory=dict)


def _names(attributes: str, pattern: re.Pattern) -> list[str]:
    return " ".join(next(g for g in m.groups() if g is not None) for m in pattern.finditer(attributes)).lower().split() if attributes else []


def _aside(tag: str, attributes: str, in_article: bool) -> tuple[bool, bool]:
    """Whether an element is an aside, and whether only part of a name says so."""
    if tag in ASIDE_TAGS and not (tag == "header" and in_article):
        return True, False
    doubtful = False
    for name in _names(attributes, _CLASS):
        words = [w for w in re.split(r"[-_]+", name) if w]
        marks = [w for w in words if w in ASIDE_WORDS]
        if not marks or set(marks) <= {"header"} and (in_article or not OWN_HEADER.isdisjoint(words)):
            continue
        if all(w in ASIDE_WORDS or w in COMPANIONS or w.isdigit() for w in words):
            return True, False
        doubtful = True
    return False, doubtful


def parse(html: str) -> Page:
    """Containers and the text blocks outside of asides."""
    page = Page([Node("", "", 0, False, -1)])
    stack: list[tuple[str, int, bool, bool]] = [("", 0, False, False)]  # tag, nearest container, within an aside, within an article
    places: dict[str, list[int]] = {}  # of the open elements by tag, so that closing one takes no search
    text: list[str] = []
    links = 0
    at, n = 0, len(html)

    def top(tags) -> int:
        return max((places[t][-1] for t in tags if places.get(t)), default=-1)

    def close(k: int) -> None:
        for tag, *_ in reversed(stack[k:]):
            places[tag].pop()
        del stack[k:]

    def flush() -> None:
        nonlocal links
        if text:
            block = " ".join("".join(text).split())
            text.clear()
            if block:
                heading, running = top(HEADINGS), top(PROSE_TAGS)
                linked = 2 * links >= len(block)
                enough = len(block) >= (PROSE if running > 0 else LOOSE_PROSE)
                kind = "head" if heading > 0 else "prose" if enough and not linked else "other"
                page.blocks.append(Block(stack[-1][1], block, kind, links))
        links = 0

    def say(raw: str) -> None:
        nonlocal links
        if raw and not stack[-1][2]:
            said = unescape(raw) if "&" in raw else raw
            text.append(said)
            if places.get("a"):
                links += len(said.strip())

    lower = None
    for m in iter(lambda: TOKEN.search(html, at), None):
        say(html[at : m.start()])
        at = m.end()
        tag = m[2]
        if tag is None:
            continue
        tag = tag.lower()
        if m[1]:
            if tag in BLOCKS:
                flush()
            elif tag == "br":
                text.append(" ")
            k = top((tag,))
            if k > 0 and (tag in BLOCKS or k > top(CONTAINERS)):  # a stray inline end tag ends no container
                close(k)
            continue
        attributes = m[3] if m[3] is not None else m[4] or ""
        if tag in RAW:
            if attributes.endswith("/"):
                continue
            if lower is None:
                lower = html.lower() if len(html.lower()) == n else re.sub("[A-Z]", lambda c: c[0].lower(), html)
            end = lower.find(f"</{tag}", at)
            after = -1 if end < 0 else html.find(">", end)
            at = n if after < 0 else after + 1
            continue
        if tag in BLOCKS:
            flush()
            k = top(("p",))
            if k > 0 and stack[k][1] == stack[-1][1]:
                close(k)
            k = top(_CLOSES.get(tag, ()))
            if k > top(_FENCES):
                close(k)
        if tag == "br":
            text.append(" ")
        if tag in VOID:
            continue
        _, container, aside, in_article = stack[-1]
        doubtful = False
        if not aside:
            aside, doubtful = _aside(tag, attributes, in_article)
        if tag in CONTAINERS or doubtful:
            up = page.nodes[container]
            name = ".".join([tag, *sorted(re.sub(r"\d+", "#", c) for c in _names(attributes, _CLASS_ONLY))])
            path = f"{up.path}>{name}" if up.depth < DEPTH else up.path
            page.nodes.append(Node(tag, path, up.depth + 1, aside, container, doubtful))
            container = len(page.nodes) - 1
        places.setdefault(tag, []).append(len(stack))
        stack.append((tag, container, aside, in_article or tag in ("article", "main")))
    say(html[at:])
    flush()
    return _measured(page)


def _measured(page: Page) -> Page:
    """``page`` without the blocks of doubtful elements that are half links, with each node's range of blocks and prose."""
    nodes = page.nodes
    if any(node.doubtful for node in nodes):
        total, linked = [0] * len(nodes), [0] * len(nodes)
        for b in page.blocks:
            total[b.container] += len(b.text)
            linked[b.container] += b.links
        for i in range(len(nodes) - 1, 0, -1):
            total[nodes[i].parent] += total[i]
            linked[nodes[i].parent] += linked[i]
        for i, node in enumerate(nodes):
            node.aside = node.aside or node.doubtful and 2 * linked[i] >= total[i] or i > 0 and nodes[node.parent].aside and nodes[node.parent].doubtful
        page.blocks = [b for b in page.blocks if not nodes[b.container].aside]
    for kind in ("prose", "head", "all"):
        page.sums[kind] = [0, *accumulate(len(b.text) if kind in (b.kind, "all") else 0 for b in page.blocks)]
    for node in nodes:
        node.first, node.last = len(page.blocks), 0
    for i, b in enumerate(page.blocks):
        nodes[b.container].first = min(nodes[b.container].first, i)
        nodes[b.container].last = i + 1
    for node in reversed(nodes):
        if node.parent >= 0:
            up = nodes[node.parent]
            up.first, up.last = min(up.first, node.first), max(up.last, node.last)
    what = "prose" if page.sums["prose"][-1] else "all"
    for node in nodes:
        node.size = _sum(page, what, node.first, node.last)
    return page


def _sum(page: Page, kind: str, first: int, last: int) -> int:
    return page.sums[kind][last] - page.sums[kind][first] if last > first else 0


def candidate(page: Page) -> int:
    """The smallest, deepest container with nearly all of the page's prose, widened by ``_whole_article``."""
    whole = page.nodes[0].size
    fits = [i for i, node in enumerate(page.nodes) if node.size >= HELD * whole and not node.aside]
    return _whole_article(page, max(fits, key=lambda i: (page.nodes[i].depth, -i), default=0)) if whole else 0


def _whole_article(page: Page, chosen: int) -> int:
    """The outermost container around ``chosen`` that is an article, a main with little else, or one whose further blocks
    are mainly prose or a headline and lead before it; else ``chosen``."""
    best, up = chosen, page.nodes[chosen].parent
    while up >= 0:
        node, own = page.nodes[up], page.nodes[best]
        before, after = (node.first, own.first), (own.last, node.last)
        added = _sum(page, "all", *before) + _sum(page, "all", *after)
        if not node.aside and added:
            good = _sum(page, "prose", *before) + _sum(page, "prose", *after) + _lead(page, *before)
            little = node.tag == "main" and added - good <= (1 - HELD) * own.size
            if node.tag == "article" or little or 2 * good >= added and node.tag != "" and (node.tag != "body" or 2 * good > 3 * (added - good)):
                best = up
        elif not node.aside and node.tag in ("article", "main") and page.nodes[best].tag not in ("article", "main"):
            best = up
        up = node.parent
    return best


def _lead(page: Page, first: int, last: int) -> int:
    """Characters of headings, and of what stands between them and the body, in the blocks before it."""
    head = next((i for i in range(first, last) if page.blocks[i].kind == "head"), last)
    return sum(len(b.text) for b in page.blocks[head:last] if b.kind != "prose" and 2 * b.links < len(b.text) + 1)


def extract(html: str | None, path: str | None) -> str:
    page = parse(html or "")
    own = candidate(page)
    chosen = {i for i, node in enumerate(page.nodes) if path is not None and node.path == path and not node.aside}
    held = sum(page.nodes[i].size for i in chosen)
    text = any(page.nodes[i].last > page.nodes[i].first for i in chosen)
    if not text or page.nodes[own].tag in ("article", "main") and held < HELD * page.nodes[own].size:
        chosen = {own}
    inside = [False] * len(page.nodes)
    for i, node in enumerate(page.nodes):
        inside[i] = i in chosen or node.parent >= 0 and inside[node.parent]
    return "\n".join(b.text for b in page.blocks if inside[b.container])


def _vote(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        pages = [parse(h or "") for h in batch.column(1).to_pylist()]
        best = [p.nodes[candidate(p)] for p in pages]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([b.path if b.size else None for b in best], pa.string())], ["host", "path"])


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = [extract(h, p) for h, p in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])


#: Hosts whose winning paths are sent to all executors; more are joined by a shuffle.
FEW_HOSTS = 50_000


def extract_pages(pages: DataFrame) -> DataFrame:
    """One row per page: page_id, url, text, n_chars."""
    small_batches(pages.sparkSession)
    host = F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), r"^[^:]*://([^/?#]*)", 1))
    read = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html").withColumn("host", host)
    votes = read.select("host", "html").mapInArrow(_vote, "host string, path string").where("path IS NOT NULL")
    counted = votes.groupBy("host", "path").agg(F.count("*").alias("n"))
    winners = written(counted.groupBy("host").agg(F.max(F.struct("n", "path")).alias("w")).select("host", F.col("w.path").alias("path")), "html-winners")
    few = winners.count() <= FEW_HOSTS
    joined = read.join(F.broadcast(winners) if few else winners, "host", "left")
    return joined.select("page_id", "url", "html", "path").mapInArrow(_extract, "page_id long, url string, text string, n_chars long")
