"""Main-text extraction by consensus host paths.

Each page's containers are scored and named by a generalised path of tags and classes; the pages of a host vote, in
Spark, on the path that holds their articles; then every page is extracted again with its host's path. A page without
that path falls back on its own best container.
"""

from __future__ import annotations

import functools
import html
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialise, spread, table
from .url_filter import host_of

#: A tag with a longer quoted value (characters) or more pieces of attributes ends at its first >, quoted or not, so that unclosed
#: quotes do not have the rest of a page scanned for every tag.
QUOTED, PIECES = 2048, 200
TAG = re.compile(
    rf"""<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']+|"[^"]{{0,{QUOTED}}}"|'[^']{{0,{QUOTED}}}'){{0,{PIECES}}}+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>""", re.S
)
ATTRIBUTE = re.compile(r"""([^\s=/"'>]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")
# HTML's elements by role.
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
DROPPED = frozenset("script style noscript template textarea title head nav footer aside form button select option input iframe svg canvas object embed audio video dialog menu menuitem datalist xmp noembed noframes".split())
CONTAINERS = frozenset("html body main article section div td th center".split())
BLOCKS = CONTAINERS | frozenset("p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table thead tbody tfoot tr caption blockquote pre figure figcaption header address hr details summary hgroup fieldset legend".split()) | (DROPPED & frozenset("nav footer aside form dialog menu".split()))
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: An open element of the first kind ends where another one of its kind begins, unless one of the second has begun since.
ENDED_BY_NEXT, KEPT_OPEN_BY = frozenset("li dt dd tr td th option".split()), ("ul", "ol", "dl", "table", "select")
#: Parts of a class, id or role that name page furniture, and parts that say nothing by themselves: a name is that of furniture
#: if it has a part of the first kind and no part of any other: share-buttons is, social-policy and related-work are not.
FURNITURE = frozenset(
    "nav navbar navigation menu menubar breadcrumb breadcrumbs sidebar masthead topbar footer foot cookie cookies consent gdpr notice notices banner ad ads adv advert adverts advertisement "
    "advertisements advertising sponsor sponsored promo promotion promotions popup modal overlay newsletter subscribe subscription signup login share sharing social related recommend "
    "recommended recommendation recommendations teaser teasers comment comments disqus respond replies reply search pagination pager widget widgets toolbar skiplink contentinfo "
    "complementary alert alerts alertdialog dialog hidden tagcloud outbrain taboola".split()
)
NEUTRAL = frozenset(
    "site page main top bottom left right inner outer box bar block container wrapper wrap area section list item items link links button buttons btn icons icon group row col column content body title "
    "header heading posts post articles article stories news form field text print only sr screen reader skip up pop sign in by byline js is has the and for global primary secondary "
    "mobile desktop sticky fixed menu1 toggle".split()
)
#: Names of which all parts must stand.
WHOLE = frozenset(("side-bar", "site-header", "page-header", "sign-up", "skip-link", "print-only", "sr-only", "tags", "tag-list", "tag-cloud", "post-tags", "entry-tags", "pop-up", "cookie-policy", "social-media"))
COMMENTS = frozenset(("comment", "comments"))
GOOD = re.compile(r"(?:^|[\s_-])(?:article|content|main|post|entry|story|body|text|articlebody)(?:$|[\s_-])")


@dataclass
class Node:
    tag: str
    path: int  # hash of the path
    depth: int
    start: int = 0
    good: bool = False
    first: int = 0  # its blocks are those from first to end
    end: int = 0
    text: int = 0  # characters outside links
    linked: int = 0
    parent: Node | None = None


def _attributes(raw: str) -> dict[str, str]:
    return {k.lower(): html.unescape((v or "").strip("\"'")) for k, v in ATTRIBUTE.findall(raw)} if "=" in raw or raw.strip() else {}


def _generalised(tag: str, attributes: dict[str, str]) -> str:
    """tag.class.class without digits, so that numbered classes of one template agree."""
    names = sorted({n for c in attributes.get("class", "").lower().split() if (n := re.sub(r"\d+", "", c).strip("-_"))})
    return ".".join([tag, *names])


@functools.lru_cache(100_000)
def _names_furniture(names: str) -> bool:
    for name in names.split():
        parts = [p for p in re.split(r"[-_\d]+", name) if p]
        if "-".join(parts) in WHOLE or any(p in FURNITURE for p in parts) and all(p in FURNITURE or p in NEUTRAL for p in parts):
            return True
    return False


def _is_furniture(tag: str, attributes: dict[str, str], in_article: bool) -> bool:
    if tag in DROPPED:
        return True
    if tag == "header":
        return not in_article
    if not attributes:
        return False
    if "hidden" in attributes or attributes.get("aria-hidden") == "true" or re.search(r"display\s*:\s*none", attributes.get("style", "")):
        return tag not in ("html", "body")
    if tag in ("html", "body", "main"):
        return False
    names = " ".join(attributes.get(a, "") for a in ("class", "id", "role")).lower()
    if tag == "article":
        return bool(COMMENTS & set(re.split(r"[\s_-]+", names)))
    return bool(names) and _names_furniture(names)


class _Stack:
    """Open elements, with the places of each tag, so that no lookup walks the stack."""

    def __init__(self, root: Node):
        self.rows: list[tuple[str, Node, bool]] = [("html", root, False)]  # tag, container, dropped
        self.places: dict[str, list[int]] = {}

    def push(self, tag: str, node: Node, off: bool) -> None:
        self.places.setdefault(tag, []).append(len(self.rows))
        self.rows.append((tag, node, off))

    def last(self, *tags: str) -> int:
        """The place of the innermost open one, 0 for none."""
        return max((self.places[t][-1] for t in tags if self.places.get(t)), default=0)

    def cut(self, k: int) -> list[tuple[str, Node, bool]]:
        gone = self.rows[k:]
        for t, _, _ in reversed(gone):
            self.places[t].pop()
        del self.rows[k:]
        return gone


def containers(page: str) -> tuple[list[Node], list[str]]:
    """The page's containers in the order of their starts, and its text blocks; the blocks that a container holds at any depth
    stand next to each other. Time and memory follow the page's length, however deep or broken it is."""
    root = Node("html", 0, 0)
    nodes, stack = [root], _Stack(root)
    opened: list[Node] = [root]
    blocks: list[str] = []
    sums = [(0, 0)]  # characters outside and inside links before each block
    parts: list[str] = []
    state = {"links": 0, "linked": 0, "dropped": 0, "in_article": 0}

    def flush() -> None:
        if parts:
            text = " ".join(html.unescape("".join(parts)).split())
            linked = min(state["linked"], len(text))
            parts.clear()
            state["linked"] = 0
            if text:
                blocks.append(text)
                sums.append((sums[-1][0] + len(text) - linked, sums[-1][1] + linked))

    def end(node: Node) -> None:
        node.end = len(blocks)
        node.text, node.linked = (sums[node.end][i] - sums[node.first][i] for i in (0, 1))

    def close(k: int) -> None:
        for t, n, off in reversed(stack.cut(k)):
            state["dropped"] -= off
            state["in_article"] -= t in ("article", "main")
            if n is opened[-1] and not off and t in CONTAINERS and len(opened) > 1:
                end(opened.pop())

    at, last = 0, page.rfind(">") + 1
    if (unclosed := page.find("<!--", last)) >= 0:
        page = page[:unclosed]
    for m in TAG.finditer(page, 0, last):
        if m.start() < at:
            continue
        if not state["dropped"] and m.start() > at:
            piece = page[at : m.start()]
            parts.append(piece)
            if state["links"]:
                state["linked"] += len(piece)
        at = m.end()
        closing, tag, raw = (m[1], m[2], m[3]) if m[2] else (m[4], m[5], m[6])
        if not tag:
            if at == last and page.startswith(("<!--", "<![CDATA["), m.start()) and not page.endswith(("-->", "]]>"), m.start(), last):
                at = len(page)  # never closed
            continue
        tag = tag.lower()
        if not closing and tag in RAW and not (raw or "").endswith("/"):
            found = re.compile(rf"</{re.escape(tag)}\b[^>]*>", re.I).search(page, at)
            at = found.end() if found else len(page)
            continue
        if tag == "a":
            state["links"] = max(0, state["links"] + (-1 if closing else 1))
            continue
        if tag == "br":
            if not state["dropped"]:
                parts.append(" ")
            continue
        if tag not in BLOCKS and tag not in DROPPED:
            if not closing and (a := _attributes(raw)) and _is_furniture(tag, a, state["in_article"] > 0) and tag not in VOID:
                if not state["dropped"] and tag != "span":
                    flush()
                stack.push(tag, opened[-1], True)
                state["dropped"] += 1
                continue
            if not state["dropped"] or not stack.last(tag):
                continue
            if not closing:  # inside a dropped element of the same name: its end is not the dropped one's
                stack.push(tag, opened[-1], False)
                continue
        if closing:
            if tag == "p":
                if not state["dropped"]:
                    flush()
            elif k := stack.last(tag):
                if not state["dropped"]:
                    flush()
                close(k)
                state["links"] = 0
            elif not state["dropped"] and tag in BLOCKS:
                flush()
            continue
        if not state["dropped"] and tag in BLOCKS:
            flush()
        if tag in VOID or tag in ("p", "html"):
            continue
        attributes = _attributes(raw) if raw else {}
        off = _is_furniture(tag, attributes, state["in_article"] > 0)
        if raw and raw.endswith("/") and tag not in CONTAINERS:
            continue
        if tag in ENDED_BY_NEXT and (k := stack.last(tag)) and k > stack.last(*KEPT_OPEN_BY):
            close(k)
        node = opened[-1]
        if tag in CONTAINERS and not off and not state["dropped"]:
            path = xxhash.xxh3_64_intdigest(f"{node.path}>{_generalised(tag, attributes)}".encode("utf-8", "surrogatepass"))
            good = tag in ("article", "main") or bool(GOOD.search(f"{attributes.get('class', '')} {attributes.get('id', '')} {attributes.get('itemprop', '')}".lower()))
            node = Node(tag, path, node.depth + 1, m.start(), good, len(blocks), parent=node)
            nodes.append(node)
            opened.append(node)
        stack.push(tag, node, off)
        state["dropped"] += off
        state["in_article"] += tag in ("article", "main")
    if not state["dropped"] and at < len(page):
        parts.append(page[at:])
    flush()
    for n in opened:
        end(n)
    return nodes, blocks


def score(node: Node) -> float:
    """Text outside links, less what is linked; semantic containers and article classes weigh double."""
    return max(0.0, node.text - 2.0 * node.linked) * (2.0 if node.good else 1.0)


def best(nodes: list[Node]) -> Node:
    """The article around the deepest container that scores nearly as well as the best: its outermost article or main, or
    else the outermost one of an article class that scores no less, so that a title, lead or section beside it is kept."""
    top = max(score(n) for n in nodes)
    found = n = max((n for n in nodes if score(n) >= 0.8 * top), key=lambda n: (n.depth, score(n), -n.start))
    whole = article = None
    while n:
        if n.tag in ("article", "main"):
            article = n
        elif n.good and score(n) >= score(found):
            whole = n
        n = n.parent
    return article or whole or found


def extract_with(nodes: list[Node], blocks: list[str], path: int | None) -> str:
    """Text of the containers on the path; of the page's own best one if the path holds nothing here. Nodes of one path have
    one depth, so none holds another."""
    held = [n for n in nodes if n.path == path and n.end > n.first] if path is not None else []
    return "\n".join(t for n in (held or [best(nodes)]) for t in blocks[n.first : n.end])


def vote(pages: DataFrame) -> DataFrame:
    """host, path (hash of the path of tags and classes): the path with most votes on each host, ties to the smaller hash.
    Counts are combined before the shuffle, so a hot host costs a row for each task and path."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            won = [best(containers(h)[0]).path - 2**63 if h else None for h in (x.as_py() for x in b.column(1))]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(won, pa.int64())], ["host", "path"])

    ballots = spread(pages.select(host_of(F.col("url")).alias("host"), F.col("html").cast("string").alias("html"))).mapInArrow(run, "host string, path bigint")
    counts = ballots.where("path is not null").groupBy("host", "path").agg(F.count(F.lit(1)).alias("votes"))
    return counts.groupBy("host").agg(F.min(F.struct(-F.col("votes"), F.col("path").alias("path")))["path"].alias("path"))


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars: one row per page, blocks joined by newlines in page order.

    Null and empty pages have the empty text; null urls and those without a host vote together as the host ''. Repeated
    rows vote each and come out alike; equal scores go to the earlier container and equal votes to the smaller hash; extra
    columns are not carried; no block is cut or left out by length; an empty table gives an empty result.
    """
    winners = materialise(vote(pages), "host-paths")
    rows = pages.select(F.col("page_id").cast("bigint").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    rows = rows.withColumn("host", host_of(F.col("url"))).join(winners, "host", "left").select("page_id", "url", "html", "path")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [extract_with(*containers(h), None if p is None else p + 2**63) if h else "" for h, p in ((x.as_py(), y.as_py()) for x, y in zip(b.column(2), b.column(3), strict=True))]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], ["page_id", "url", "text", "n_chars"])

    return spread(rows).mapInArrow(run, "page_id bigint, url string, text string, n_chars bigint")


def op8_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))
