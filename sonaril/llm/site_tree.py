"""Main-text extraction by site style trees.

All pages of a host are merged into one tree: a node is an element's path (tag, class, id and role of
every element down to it; equal siblings are one node), with the number of pages that have it, the
styles it occurs in (the sequence of its children) and the contents seen under it. A node's importance
is, as in the site style tree, the entropy of its styles over its pages (presentation) blended with the
entropy of its contents, both scaled to 0..1 by the number of pages: what looks and reads alike on
every page of a site is decoration. Equal pages of a host count once, and nodes on fewer than
``LEAST_PAGES`` different pages are not judged. A page keeps the branch of its article and loses every
branch whose kind of element or whose importance on its host says that it isn't part of it.

Element kinds that never hold main text (menus, headers, footers, asides, forms, scripts, ...) and the
class and id words for adverts, notices and comments are presentation features, too: they have
importance 0 whatever varies in them. Inside a marked article only a branch that is named by a class,
id or role of its own, or stands outside the article, can be unimportant by entropy: paragraphs of an
article are told apart by nothing but their place.

Counts are grouped by (host, node, feature) after a pre-aggregation in every task, so a host with a
third of all pages is a few rows per task; pages meet their host's tree in a join that can be split.

Edges: null html is the empty page; a null url belongs to the host ``""``; unclosed and misnested
elements are closed as browsers do for the common cases; a page that a malformed declaration would stop is read
without its declarations; repeated rows are pages of their own; other columns are ignored.
"""

from __future__ import annotations

import functools
import hashlib
import re
import zlib
from html import unescape
from html.parser import HTMLParser
from math import log

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sonaril.llm.common import Scratch, map_arrow

LEAST_PAGES, THRESHOLD, ALPHA = 5, 0.2, 0.5

# Element kinds of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template iframe object svg math canvas audio video textarea select".split())
BLOCK = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table tbody td tfoot th thead title tr ul br".split())
NOT_MAIN = frozenset("head title nav header footer aside form button script style noscript template iframe object svg math canvas audio video textarea select dialog menu search".split())
ENDS_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre search section table ul".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
NAMES = re.compile(r"(?:^|[-_\s])(?:ad|ads|adv|advert|adverts|advertisement|advertising|adsense|sponsor|sponsored|promo|promotion|banner|nav|navbar|navigation|menu|menubar|breadcrumb|breadcrumbs|sidebar|side|rail|widget|related|recommended|share|sharing|social|cookie|cookies|consent|gdpr|notice|notices|notification|alert|popup|modal|overlay|newsletter|subscribe|subscription|signup|login|comment|comments|commentlist|disqus|respond|reply|replies|header|masthead|footer|foot|copyright|legal|skip|toolbar|pagination|pager|tags|search)(?:$|[-_\s\d])", re.I)


_MASK, _STEP = (1 << 63) - 1, 0x9E3779B97F4A7C15


def _id(text: str) -> int:
    """63 bits of a text's hash."""
    return int.from_bytes(hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little") & _MASK


_sign_id = functools.lru_cache(1 << 16)(_id)


def _then(before: int, x: int) -> int:
    """A sequence's hash with one more member."""
    return (before * _STEP + x + 1) & _MASK


class Node:
    __slots__ = ("tag", "sign", "named", "prior", "parent", "children", "path", "content")

    def __init__(self, tag: str, attrs: dict, parent):
        self.tag, self.parent, self.children, self.content = tag, parent, [], (0, 1)
        names = f"{attrs.get('class') or ''} {attrs.get('id') or ''}".strip()
        role = (attrs.get("role") or "").lower()
        self.named = bool(names or role)
        self.sign = f"{tag}.{names.lower()}.{role}" if self.named else tag
        hidden = "hidden" in attrs or (attrs.get("aria-hidden") or "").lower() == "true" or "display:none" in (attrs.get("style") or "").replace(" ", "").lower()
        main = tag in ("article", "main", "body", "html")
        #: no importance by kind
        self.prior = tag in NOT_MAIN or role in ROLES or hidden or (not main and bool(names) and bool(NAMES.search(names)))
        self.path = _then(parent.path, _sign_id(self.sign)) if parent else 0


class _Builder(HTMLParser):
    """A tree of nodes and text; end tags that close nothing are dropped.

    ``open`` counts the open elements of each kind, so that nothing is looked for along a deep branch that isn't there.
    """

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = self.at = Node("#root", {}, None)
        self.open: dict[str, int] = {}

    def _close(self, n: Node) -> None:
        """The element and all within it are closed."""
        x = self.at
        while x is not n.parent:
            self.open[x.tag] -= 1
            x = x.parent
        self.at = n.parent

    def _up_to(self, tags, stop) -> None:
        if not any(self.open.get(t) for t in tags):
            return
        n = self.at
        while n.parent is not None and n.tag not in stop:
            if n.tag in tags:
                self._close(n)
                return
            n = n.parent

    def handle_starttag(self, tag, attrs):
        if tag in ENDS_P:
            self._up_to(("p",), ("article", "section", "div", "td", "th", "li", "button", "table", "body", "aside", "blockquote"))
        if tag == "li":
            self._up_to(("li",), ("ul", "ol", "menu"))
        elif tag in ("dd", "dt"):
            self._up_to(("dd", "dt"), ("dl",))
        elif tag in ("td", "th"):
            self._up_to(("td", "th"), ("tr", "table"))
        elif tag == "tr":
            self._up_to(("tr",), ("table",))
        elif tag == "option":
            self._up_to(("option",), ("select",))
        elif tag == "body":
            self._up_to(("head",), ("html",))
        n = Node(tag, dict(attrs), self.at)
        self.at.children.append(n)
        if tag not in VOID:
            self.at = n
            self.open[tag] = self.open.get(tag, 0) + 1

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID and tag in ("svg", "path", "use"):
            self.handle_endtag(tag)

    def handle_endtag(self, tag):
        if not self.open.get(tag):
            return
        n = self.at
        while n is not None and n.tag != tag:
            if n.tag in ("table", "article", "main") and tag not in ("body", "html", "main", "article", "table", "div", "section"):
                return  # an inline end tag doesn't close the blocks around it
            n = n.parent
        if n is not None and n.parent is not None:
            self._close(n)

    def handle_data(self, data):
        if data:
            self.at.children.append(data)


def parse(html: str | None) -> Node:
    """The page's tree. Where a malformed declaration stops the parser, declarations go first, at last all markup."""
    for text in (html or "", _DECLARATION.sub("", html or "")):
        b = _Builder()
        try:
            b.feed(text)
            b.close()
            return b.root
        except (AssertionError, ValueError):
            continue
    b = _Builder()
    b.handle_data(unescape(_TAG.sub(" ", html or "")))
    return b.root


_DECLARATION, _TAG = re.compile(r"<![^>]*>?"), re.compile(r"<[^>]*>?")


def _walk(root: Node):
    todo = [root]
    while todo:
        n = todo.pop()
        yield n
        todo.extend(c for c in n.children if isinstance(c, Node))


_PRIME = (1 << 63) - 25


def note_contents(root: Node) -> None:
    """Each node's content, from the leaves up: its text without white space as a number modulo a prime, and the power that it shifts by."""
    for n in reversed(list(_walk(root))):
        number, shift = 0, 1
        for c in n.children if n.tag not in RAW else ():
            if isinstance(c, Node):
                x, by = c.content
            else:
                body = "".join(c.split()).encode("utf-8", "surrogatepass")
                x, by = int.from_bytes(body, "big") % _PRIME, pow(256, len(body), _PRIME)
            number, shift = (number * by + x) % _PRIME, shift * by % _PRIME
        n.content = number, shift


def host_of(url: str | None) -> str:
    m = re.match(r"(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//([^/?#]*)", url or "")
    return (m[1].rpartition("@")[2].lower() if m else "")


# --------------------------------------------------------------------------- the tree of a host
def page_features(root: Node) -> dict[int, tuple[int, int]]:
    """path -> (style, content) of each node of a page; equal siblings are one node whose parts are joined."""
    note_contents(root)
    parts: dict[int, list[Node]] = {}
    for n in _walk(root):
        if n.parent is not None and n.tag not in RAW:
            parts.setdefault(n.path, []).append(n)
    out = {}
    for path, ns in parts.items():
        style = content = 0
        for n in ns:
            last = None
            for c in n.children:
                sign = c.sign if isinstance(c, Node) else "#text" if c.strip() else None
                if sign is not None and sign != last:  # runs of equal children are one
                    style = _then(style, _sign_id(sign))
                    last = sign
            content = _then(content, n.content[0])
        out[path] = (style, content)
    return out


def distinct_pages(pages: DataFrame) -> DataFrame:
    """(host, key, z): of each host's pages with the same html, one, compressed."""

    def run(batches):
        seen: set[tuple[str, bytes]] = set()
        for b in batches:
            at, hosts, keys = [], [], []
            for i, (url, html) in enumerate(zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)):
                host, key = host_of(url), hashlib.md5((html or "").encode()).digest()
                if (host, key) not in seen:
                    seen.add((host, key))
                    at.append(i)
                    hosts.append(host)
                    keys.append(key)
            if len(seen) > 300_000:  # later copies are sent again
                seen.clear()
            z = [zlib.compress((b.column(1)[i].as_py() or "").encode(), 1) for i in at]
            yield pa.RecordBatch.from_arrays([pa.array(hosts, pa.string()), pa.array(keys, pa.binary()), pa.array(z, pa.binary())], names=["host", "key", "z"])

    return pages.select("url", "html").mapInArrow(run, "host string, key binary, z binary").dropDuplicates(["host", "key"])


def count_features(pages: DataFrame) -> DataFrame:
    """(host, path, kind, feature, n) per task, from each host's different pages; kind 0: styles, 1: contents."""

    def run(batches):
        held: dict[tuple, int] = {}

        def out():
            keys = list(held)
            return pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys], pa.string()), *(pa.array([k[i] for k in keys], pa.int64()) for i in (1, 2, 3)), pa.array(list(held.values()), pa.int64())], names=["host", "path", "kind", "feature", "n"])

        for b in batches:
            for host, z in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                for path, (style, content) in page_features(parse(zlib.decompress(z).decode())).items():
                    for k in ((host, path, 0, style), (host, path, 1, content)):
                        held[k] = held.get(k, 0) + 1
            if len(held) > 300_000:
                yield out()
                held = {}
        if held:
            yield out()

    return distinct_pages(pages).select("host", "z").mapInArrow(run, "host string, path long, kind long, feature long, n long")


def unimportant(pages: DataFrame) -> DataFrame:
    """(host, paths array<long>): nodes whose composite importance on their host is below the threshold."""
    counts = count_features(pages).groupBy("host", "path", "kind", "feature").agg(F.sum("n").alias("n"))
    # entropy from grouped sums: log m - sum(n log n) / m, over log m
    per = counts.groupBy("host", "path", "kind").agg(F.sum("n").alias("m"), F.sum(F.col("n") * F.log("n")).alias("s"))
    h = F.when(F.col("m") > 1, (F.log("m") - F.col("s") / F.col("m")) / F.log("m")).otherwise(1.0)
    both = per.groupBy("host", "path").agg(F.max("m").alias("m"), F.sum(F.when(F.col("kind") == 0, h).otherwise(0.0)).alias("style"), F.sum(F.when(F.col("kind") == 1, h).otherwise(0.0)).alias("content"))
    importance = F.lit(ALPHA) * F.col("style") + F.lit(1 - ALPHA) * F.col("content")
    return both.filter((F.col("m") >= LEAST_PAGES) & (importance < THRESHOLD)).groupBy("host").agg(F.collect_list("path").alias("paths"))


def log_entropy(ns: list[int]) -> float:
    """The same entropy, plainly; 0 if all pages agree, 1 if none do."""
    m = sum(ns)
    return -sum(n / m * log(n / m) for n in ns) / log(m) if m > 1 else 1.0


# --------------------------------------------------------------------------- a page
def _find_main(root: Node, low: set[int]) -> list[Node]:
    """The nodes that hold the main text: articles (or main elements) outside removed branches, else the body."""
    for wanted in (("article",), ("main",)):
        found, todo = [], [root]
        while todo:
            n = todo.pop()
            if n.prior:
                continue
            if n.tag in wanted or (wanted == ("main",) and n.parent is not None and n.named and "main" in n.sign.split(".")[2:]):
                found.append(n)
                continue
            todo.extend(c for c in reversed(n.children) if isinstance(c, Node))
        if found:
            return found
    return [root]


def extract(html: str | None, low: set[int]) -> str:
    """Main text of a page, given the unimportant nodes of its host."""
    root = parse(html)
    main = _find_main(root, low)
    marked, own = main != [root], {id(n) for n in main}
    blocks: list[str] = []
    run: list[str] = []

    def flush():
        t = " ".join("".join(run).split())
        if t:
            blocks.append(t)
        run.clear()

    todo: list = list(reversed(main))
    while todo:
        x = todo.pop()
        if x is None:
            flush()
        elif isinstance(x, str):
            run.append(x)
        else:
            inner = id(x) in own
            if not inner and (x.prior or (x.path in low and x.parent is not None and x.tag not in ("html", "body") and (x.named or not marked))):
                if x.tag in BLOCK or x.tag in NOT_MAIN:
                    flush()
                continue
            if x.tag in BLOCK:
                flush()
                todo.append(None)
            todo.extend(reversed(x.children))
    flush()
    return " ".join(blocks)


def main_texts(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) of every page."""
    tmp = Scratch(pages.sparkSession, "site_tree")
    low = tmp.table(unimportant(pages), "unimportant")

    def squeeze(b):
        z = [zlib.compress((h or "").encode(), 1) for h in b.column(2).to_pylist()]
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([host_of(u) for u in b.column(1).to_pylist()], pa.string()), pa.array(z, pa.binary())], names=["page_id", "url", "host", "z"])

    small = map_arrow(pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html"), squeeze, "page_id long, url string, host string, z binary")

    def kernel(b):
        texts = [extract(zlib.decompress(z).decode(), set(paths or ())) for z, paths in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True)]
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return map_arrow(small.join(low, "host", "left").select("page_id", "url", "z", "paths"), kernel, "page_id long, url string, text string, n_chars long")
