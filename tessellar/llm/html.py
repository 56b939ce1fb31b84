"""Main text of web pages: site template removal, then the article.

Every element's subtree is hashed in two ways. Its content (tag, attributes, children and
text) is hashed wherever it stands. The largest elements that lie beside an article or
main part, as menus and footers do, are also hashed by shape: tags and attributes, with
runs of like siblings counted as one and without text, addresses and numbers, since menus
and footers keep their shape while their words change. Spark counts with how many distinct
main texts of its host each hash occurs, so copies of one page count once; a subtree with at
least ``MIN_PAGES`` texts and ``MIN_SHARE`` of them, or with ``SURE_PAGES`` texts on a host of any size,
belongs to the site's template and is deleted. Flowing text (paragraphs, headings, lists, tables,
quotations) inside an article is exempt with the elements around it: a passage that many
articles share is content. Outside an article nothing is exempt, so a passage that pages
of different texts share goes there. Both counts are partially aggregated before the
shuffle. The set of template hashes is broadcast while it
is below ``MAX_BROADCAST`` hashes; beyond, pages join the hashes found on themselves.

What the counts leave goes through the usual roles, which decide alone on hosts of few
pages: menus, headers, footers, sidebars, notices, adverts, forms, scripts, styles and
reader comments are dropped by tag, role or class; of the rest, the text of the articles
(else of the main parts, else of the body) is cut into blocks.

Null pages count as empty and give empty text, as do pages without text. A null address is
a host of its own. Truncated and unbalanced markup is read as browsers do, in outline.
Repeated rows are pages of their own; other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from tessellar.llm.common import plain, settle, ship, slices

MIN_PAGES = 4
MIN_SHARE = 0.1
SURE_PAGES = 100
MAX_BROADCAST = 1_000_000

_TAG = re.compile(r"""<(?:(/?)([a-zA-Z][^\s/<>]*)((?:[^<>"']|"[^"<]*"|'[^'<]*')*+)>|(!--)|[!?][^<>]*>|(/?)([a-zA-Z][^\s/<>]*)([^<>]*)>)""")
_CUT_TAG = re.compile(r"<[a-zA-Z/!?][^<>]*\Z")
_ATTR = re.compile(r"""\b(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_LOOSE = re.compile(r"""\s*\b(?:href|src|alt|title|content|datetime|action|value)\s*=\s*(?:"[^"]*"|'[^']*'|[^\s"'>]+)|\d+""", re.I)
_HOST = re.compile(r"^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", re.I)


def _names(text: str) -> frozenset[str]:
    return frozenset(text.split())


# Element names by what they mean, and role and class names of dropped parts.
VOID = _names("area base br col embed hr img input link meta param source track wbr")
RAW = _names("script style textarea title noscript iframe xmp noembed noframes")
DROP = _names("head script style textarea title noscript iframe template nav header footer aside form button select dialog svg math object audio video canvas map menu")
BLOCK = _names(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul caption"
)
FLOW = _names("p h1 h2 h3 h4 h5 h6 blockquote pre ul ol dl li dt dd table thead tbody tfoot tr td th caption figure figcaption")
CLOSES_P = BLOCK - _names("body html li dd dt td th tr tbody thead tfoot caption legend summary")
SIBLINGS = {
    "li": _names("li"), "dd": _names("dd dt"), "dt": _names("dd dt"), "tr": _names("tr td th"), "td": _names("td th"), "th": _names("td th"),
    "tbody": _names("tbody thead tfoot tr td th"), "tfoot": _names("tbody thead tfoot tr td th"), "option": _names("option"),
}
SCOPE = _names("ul ol dl table div article section main body html aside nav footer header form blockquote")
ROLES = _names("navigation banner contentinfo complementary search dialog alertdialog menu menubar form")
CLASSES = _names(
    "ad ads advert adverts advertisement advertising adsbygoogle sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices "
    "newsletter subscribe subscription signup login sidebar menu nav navbar navigation breadcrumb breadcrumbs footer header masthead topbar "
    "social share sharing related recommended comment comments comment-list commentlist disqus respond reply replies popup modal overlay "
    "widget pagination pager skip-link"
)
_HINT = re.compile(r"[^a-z0-9]+")


class Node:
    """One element: name, whether its role or class marks it as dropped, main part, children, hashes, flowing text, main part inside."""

    __slots__ = ("flow", "holds", "kids", "main", "marked", "name", "own", "shape", "sum")

    def __init__(self, name: str, attrs: str = ""):
        self.name, self.kids, self.sum, self.shape, self.flow, self.holds = name, [], 0, 0, False, False
        self.marked = name in DROP
        self.main = name == "main"
        self.own = name
        if attrs:
            found = [(m[1].lower(), (m[2] or m[3] or m[4] or "").lower()) for m in _ATTR.finditer(attrs)]
            self.own = f"{name} {attrs.strip()}"
            for key, value in found:
                words = value.split()
                if key == "role":
                    self.marked |= not ROLES.isdisjoint(words)
                    self.main |= "main" in words
                else:
                    self.marked |= any(w in CLASSES or not CLASSES.isdisjoint(_HINT.split(w)[:1]) for w in words)
        if name in ("html", "body", "article", "main"):
            self.marked = False


def parse(page: str) -> Node:
    """The element tree under a root; text children are strings with references still in them."""
    root = Node("#root")
    stack, at = [root], 0

    def text(s: str) -> None:
        if s:
            stack[-1].kids.append(s)

    def close(name: str, stop: frozenset[str]) -> None:
        for i in range(len(stack) - 1, 0, -1):
            if stack[i].name == name:
                del stack[i:]
                return
            if stack[i].name in stop:
                return

    while m := _TAG.search(page, at):
        text(page[at : m.start()])
        at = m.end()
        if m[4]:
            end = page.find("-->", at)
            at = end + 3 if end >= 0 else len(page)
            continue
        name = (m[2] or m[6] or "").lower()
        if not name:
            continue
        if m[1] or m[5]:
            close(name, frozenset())
            continue
        attrs = m[3] or m[7] or ""
        if name in CLOSES_P:
            close("p", SCOPE)
        for other in SIBLINGS.get(name, ()):
            close(other, SCOPE)
        node = Node(name, attrs)
        stack[-1].kids.append(node)
        if name in VOID:
            continue
        if name in RAW:
            end = re.compile(rf"</{name}(?=[\s/>])[^>]*>?", re.I).search(page, at)
            at = end.end() if end else len(page)
            continue
        if not attrs.rstrip().endswith("/") or name not in ("svg", "path", "use"):
            stack.append(node)
    rest = page[at:]
    cut = _CUT_TAG.search(rest)
    text(rest[: cut.start()] if cut else rest)
    return root


def _walk(root: Node) -> Iterator[tuple[Node, bool]]:
    """All elements, children before parents, and whether they lie in an article or main part."""
    stack = [(root, False, False)]
    while stack:
        node, inside, left = stack.pop()
        if left:
            yield node, inside
            continue
        stack.append((node, inside, True))
        within = inside or node.name == "article" or node.main
        stack += [(k, within, False) for k in node.kids if not isinstance(k, str)]


def _shape(top: Node) -> str:
    """The outline of an element: names and attributes, without text, and runs of like siblings as one."""
    done: dict[int, str] = {}
    for node, _ in _walk(top):
        parts = [_LOOSE.sub("", node.own).lower()]
        for k in node.kids:
            if not isinstance(k, str) and (outline := done.pop(id(k))) != parts[-1]:
                parts.append(outline)
        # outlines nest, so long ones go on as hashes
        done[id(node)] = "\x1f".join(parts) if len(parts) < 2 else f"{xxh64_intdigest(chr(31).join(parts).encode('utf-8', 'surrogatepass')):x}"
    return done[id(top)]


def subtree_sums(root: Node, host: str) -> set[int]:
    """Hash all subtrees with the host and note which hold flowing text; the set of those that may be template parts."""
    found, seed = set(), xxh64_intdigest(host) & 0x7FFFFFFF
    for node, inside in _walk(root):
        parts = [node.own]
        for k in node.kids:
            parts.append(" ".join(k.split()) if isinstance(k, str) else f"{k.sum:x}")
        node.sum = xxh64_intdigest("\x1f".join(parts).encode("utf-8", "surrogatepass"), seed) >> 1
        node.flow = not node.marked and (node.name in FLOW or any(k.flow for k in node.kids if not isinstance(k, str)))
        node.holds = node.name == "article" or node.main or any(k.holds for k in node.kids if not isinstance(k, str))
        if node.name in BLOCK and not (inside and node.flow) and node.name not in ("article", "main", "body", "html"):
            found.add(node.sum)
    # elements beside the path to an article or main part
    path = [root] if root.holds else []
    while path:
        for k in path.pop().kids:
            if isinstance(k, str) or k.name == "article" or k.main:
                continue
            if k.holds:
                path.append(k)
            else:
                k.shape = xxh64_intdigest("shape " + _shape(k), seed) >> 1
                found.add(k.shape)
    return found


def _inside(node: Node, template: set[int] | frozenset[int]) -> bool:
    return node.sum in template or (node.shape != 0 and node.shape in template)


def main_text(root: Node, template: set[int] | frozenset[int] = frozenset(), roles: bool = True) -> str:
    """Blocks in page order without template subtrees, and without what roles drop.

    Without ``roles`` the counts alone decide: no tag, class or article is looked at.
    """
    mains: list[Node] = []
    others: list[Node] = []
    stack = [(root, False)] if roles else []
    while stack:
        node, inside = stack.pop()
        if node.marked or _inside(node, template):
            continue
        if node.name == "article":
            mains.append(node)
            continue
        if node.main and not inside:
            others.append(node)
        stack += [(k, inside or node.main) for k in reversed(node.kids) if not isinstance(k, str)]
    roots = mains or others or [root]
    blocks: list[str] = []
    run: list[str] = []

    def end() -> None:
        if run and (line := " ".join("".join(run).split())):
            blocks.append(line)
        run.clear()

    for top in roots:
        todo: list[tuple[object, bool]] = [(top, top is not root)]
        while todo:
            item, exempt = todo.pop()
            if item is None:
                end()
            elif isinstance(item, str):
                run.append(unescape(item) if "&" in item else item)
            elif (roles and item.marked) or (_inside(item, template) and not (exempt and item.flow)):
                end()
            elif item.name == "br":
                run.append(" ")
            else:
                if item.name in BLOCK:
                    end()
                    todo.append((None, exempt))
                exempt = exempt or item.name == "article" or item.main
                todo += [(k, exempt) for k in reversed(item.kids)]
        end()
    return "\n".join(blocks)


def host_of(url: str | None) -> str:
    m = _HOST.match(url or "")
    return m[1].lower() if m else ""


def _occurrences(pages: DataFrame) -> DataFrame:
    """(page key, host sum, subtree sum, sum of the main text), each subtree once a page; subtree sum 0 stands for the page."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            keys, hosts, sums, texts = [], [], [], []
            for key, url, page in zip(batch.column("key").to_pylist(), batch.column("url").to_pylist(), batch.column("html").to_pylist(), strict=True):
                host = host_of(url)
                root = parse(page or "")
                found = [0, *subtree_sums(root, host)]
                keys += [key] * len(found)
                hosts += [xxh64_intdigest(host) >> 1] * len(found)
                sums += found
                texts += [xxh64_intdigest(main_text(root).encode("utf-8", "surrogatepass")) >> 1] * len(found)
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (keys, hosts, sums, texts)], ["key", "host", "sum", "main"])

    return pages.mapInArrow(run, "key long, host long, sum long, main long")


def _extract(pages: DataFrame, template, roles: bool) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            texts = []
            own = batch.column("doomed").to_pylist() if "doomed" in batch.schema.names else None
            for i, (url, page) in enumerate(zip(batch.column("url").to_pylist(), batch.column("html").to_pylist(), strict=True)):
                root = parse(page or "")
                gone = template.value if own is None else frozenset(own[i] or ())
                if gone:
                    subtree_sums(root, host_of(url))
                texts.append(main_text(root, gone, roles))
            yield pa.RecordBatch.from_arrays(
                [batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())],
                ["page_id", "url", "text", "n_chars"],
            )

    return pages.mapInArrow(run, "page_id long, url string, text string, n_chars long")


def extract(df: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html", max_broadcast: int = MAX_BROADCAST, roles: bool = True) -> DataFrame:
    """page_id, url, text and n_chars of every page; without ``roles`` the template counts alone decide."""
    ship(df.sparkSession)
    pages = plain(df, page_id=page_id, url=url, html=html).select(F.col("page_id").cast("long").alias("page_id"), "url", "html")
    keyed = pages.withColumn("key", F.xxhash64("page_id", "url", "html"))
    seen = _occurrences(keyed)
    # settled, since its totals are needed too: pages are parsed once for the counts and once for their texts
    counts = settle(seen.select("host", "sum", "main").distinct().groupBy("host", "sum").agg(F.count("*").alias("n")).filter(f"n >= {MIN_PAGES}"))
    totals = counts.filter("sum = 0").select(F.col("host").alias("h"), F.col("n").alias("texts"))
    enough = F.least(F.col("texts") * MIN_SHARE, F.lit(SURE_PAGES))
    template = counts.filter("sum <> 0").join(totals, F.col("host") == F.col("h")).filter(F.col("n") >= enough).select("sum")
    held = [r["sum"] for r in template.limit(max_broadcast + 1).collect()]
    if len(held) <= max_broadcast:
        return _extract(pages, df.sparkSession.sparkContext.broadcast(frozenset(held)), roles)
    doomed = seen.join(template, "sum").groupBy("key").agg(F.collect_set("sum").alias("doomed")).withColumnRenamed("key", "k")
    return _extract(keyed.join(doomed, F.col("key") == F.col("k"), "left").select("page_id", "url", "html", "doomed"), None, roles)
