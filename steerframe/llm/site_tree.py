"""Main text of web pages by site style trees.

Pages of one host are merged into one tree: a node is the path of block elements with their
classes. Its presentation part is how its children differ between pages, its content part how
many pages share each text under it. Both are entropies over the different pages of the host,
so a node that looks and reads alike on most of them has low importance, and its branch is
removed from every page. Pages are different if the text in their articles is, or all their
text if they have no article; copies count once. Elements that by their role hold no article (menus, footers, forms, adverts,
comments ..) are removed whatever their statistics, and if a page has an article or main
element only what is inside counts.

Defined results: a null or empty page has an empty text; a page without a host belongs to the
host with an empty name; hosts with fewer than ``MIN_PAGES`` different pages are judged by element roles
alone; equal rows get equal results; a tag that never closes ends with its parent.
"""

from __future__ import annotations

import html as html_text
import re

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from .common import bytes_of, materialized, slices

#: pages of a host from which its statistics count
MIN_PAGES = 8
#: importance under which a branch goes: elsewhere, and inside an article
LOW, LOW_INSIDE = 0.5, 0.1

SCHEMA = "page_id long, url string, text string, n_chars long"

# fixed values: elements by their role in a page
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style textarea title xmp iframe noembed noframes".split())
NO_ARTICLE = set(
    "head script style noscript template iframe object svg canvas form button select textarea"
    " nav footer aside dialog menu title".split()
)
BLOCKS = set(
    "html body address article aside blockquote caption center dd details dialog div dl dt"
    " fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr legend li main menu nav"
    " ol optgroup option p pre section summary table tbody td tfoot th thead tr ul".split()
)
ENDS_PARAGRAPH = BLOCKS - set("caption dd dt legend option tbody td tfoot th thead tr".split())
ENDS_LIKE = {
    "li": {"li"}, "dd": {"dd", "dt"}, "dt": {"dd", "dt"}, "option": {"option"},
    "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"},
}
KEEPS_OPEN = set("ul ol dl table select article section div".split())
NO_ARTICLE_CLASS = re.compile(
    r"^(ads?|advert\w*|sponsor\w*|banner|promo\w*|cookie\w*|consent|notice|alert|nav\w*|menu\w*"
    r"|sidebar|side|footer|header|masthead|breadcrumbs?|share|sharing|social|related|popup|modal"
    r"|newsletter|subscribe|subscription|comments?|disqus\w*|search|widget|toolbar|pagination)$"
)
TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*>"
    r"|<(?P<end>/?)(?P<tag>[a-zA-Z][^\s/>]*)(?P<attrs>(?:[^>\"']+|\"[^\"]*\"|'[^']*')*+)>",
    re.S,
)
STYLE = re.compile(r"(?:^|\s)(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)


class Page:
    """Text blocks of a page in order: path, text, whether inside an article, whether dropped."""

    def __init__(self, source: str) -> None:
        self.blocks: list[tuple[str, str, bool, bool]] = []
        self.children: dict[str, list[str]] = {}
        self._open: list[tuple[str, str, bool, bool]] = []  # tag, path, inside, dropped
        self._text: list[str] = []
        self._read(source)
        self._flush()

    def _top(self) -> tuple[str, str, bool, bool]:
        return self._open[-1] if self._open else ("", "", False, False)

    def _flush(self) -> None:
        if self._text:
            text = " ".join("".join(self._text).split())
            self._text = []
            if text:
                self.blocks.append((self._top()[1], text, *self._top()[2:]))

    def _close(self, depth: int) -> None:
        for tag, *_ in self._open[depth:]:
            if tag in BLOCKS:
                self._flush()
                break
        del self._open[depth:]

    def _start(self, tag: str, attrs: str) -> None:
        if tag in BLOCKS:
            self._flush()
        if tag in ENDS_PARAGRAPH:
            self._end_like({"p"})
        if tag in ENDS_LIKE:
            self._end_like(ENDS_LIKE[tag])
        if tag in VOID:
            if tag == "br":
                self._text.append(" ")
            return
        _, path, inside, dropped = self._top()
        styles = []
        if attrs and not attrs.isspace():
            for kind, *values in STYLE.findall(attrs):
                styles += [(kind.lower(), v) for v in "".join(values).lower().split()]
        inside = inside or tag in ("article", "main") or ("role", "main") in styles
        dropped = (
            dropped or tag in NO_ARTICLE or (tag == "header" and not inside)
            or any(NO_ARTICLE_CLASS.match(v) for _, v in styles)
        )
        if tag in BLOCKS:
            own = ".".join([tag, *sorted(re.sub(r"\d+", "0", v) for _, v in styles)])
            self.children.setdefault(path, []).append(own)
            path = f"{path}/{own}"
        self._open.append((tag, path, inside, dropped))

    def _end_like(self, tags: set[str]) -> None:
        for depth in range(len(self._open) - 1, -1, -1):
            tag = self._open[depth][0]
            if tag in tags:
                self._close(depth)
                return
            if tag in KEEPS_OPEN:
                return

    def _end(self, tag: str) -> None:
        for depth in range(len(self._open) - 1, -1, -1):
            if self._open[depth][0] == tag:
                self._close(depth)
                return

    def _read(self, source: str) -> None:
        at = 0
        while (found := TOKEN.search(source, at)) is not None:
            if found.start() > at:
                self._text.append(html_text.unescape(source[at : found.start()]))
            at = found.end()
            tag = (found["tag"] or "").lower()
            if not tag:
                continue
            if found["end"]:
                self._end(tag)
                continue
            attrs = found["attrs"]
            self._start(tag, attrs)
            if tag in RAW and not attrs.endswith("/"):
                close = re.compile(rf"</{re.escape(tag)}(?=[\s/>])", re.I).search(source, at)
                at = close.start() if close else len(source)
        if at < len(source):
            self._text.append(html_text.unescape(source[at:]))


def host_of(url: str | None) -> str:
    return re.sub(r"^[a-zA-Z][\w+.-]*://", "", url or "").split("/")[0].split("?")[0].lower()


def _number(text: str) -> int:
    return xxhash.xxh3_64_intdigest(text.encode("utf-8", "replace")) - 2**63


NODES = "array<struct<path:string,kind:int,feature:long>>"
_NODE = pa.struct([("path", pa.string()), ("kind", pa.int32()), ("feature", pa.int64())])


def _page_key(page: Page) -> bytes:
    """A number of the text that tells a page from others: its article, or all if it has none."""
    blocks = [b for b in page.blocks if not b[3]]
    inside = [b for b in blocks if b[2]]
    return xxhash.xxh3_128_digest(
        "\n".join(f"{path}\t{text}" for path, text, *_ in inside or blocks).encode("utf-8", "replace")
    )


def _node_batches(batches):
    """(host, page, nodes) of pages; of copies in a batch one, the least by its nodes."""
    for batch in slices(batches, 2000):
        pages: dict = {}
        for url, raw in zip(batch.column("url").to_pylist(), bytes_of(batch.column("html"))):
            page = Page(raw.decode("utf-8", "replace"))
            # what is dropped by its role needs no statistics
            seen = {(p, 1, _number(t)) for p, t, _, dropped in page.blocks if not dropped}
            paths = {p for p, _, _ in seen}
            seen |= {(p, 0, 0) for p in paths}
            seen |= {(p, 2, _number(" ".join(dict.fromkeys(page.children.get(p, []))))) for p in paths}
            key, nodes = (host_of(url), _page_key(page)), sorted(seen)
            pages[key] = min(pages.get(key, nodes), nodes)
        rows = [[dict(zip(_NODE.names, node)) for node in nodes] for nodes in pages.values()]
        yield pa.RecordBatch.from_arrays(
            [pa.array([h for h, _ in pages], pa.string()), pa.array([k for _, k in pages], pa.binary()),
             pa.array(rows, pa.list_(_NODE))],
            ["host", "page", "nodes"],
        )


def importance(pages: DataFrame) -> DataFrame:
    """(host, path, pages, importance) of the nodes of every host's style tree.

    The content part of a node is one less the mean entropy of its texts, a text on k of m
    pages having log k / log m. The presentation part is the entropy of its children's styles
    over its pages. The larger part is the importance.
    """
    different = (
        pages.select("url", "html")
        .mapInArrow(_node_batches, f"host string, page binary, nodes {NODES}")
        .groupBy("host", "page").agg(F.min("nodes").alias("nodes"))
    )
    nodes = different.select("host", F.explode("nodes").alias("node")).select("host", "node.*")
    counted = nodes.groupBy("host", "path", "kind", "feature").agg(F.count(F.lit(1)).alias("k"))
    k, of = F.col("k"), lambda kind, value: F.when(F.col("kind") == kind, value)
    sums = counted.groupBy("host", "path").agg(
        F.max(of(0, k)).alias("pages"),
        F.avg(of(1, F.log(k))).alias("text_entropy"),
        F.sum(of(2, k * F.log(k))).alias("style_logs"),
    )
    size = F.log(F.col("pages"))
    content = F.lit(1.0) - F.col("text_entropy") / size
    style = (size - F.col("style_logs") / F.col("pages")) / size
    return sums.filter(F.col("pages") >= MIN_PAGES).select(
        "host", "path", "pages", F.greatest(content, style).alias("importance")
    )


def page_text(source: str, low: set[str], low_inside: set[str]) -> str:
    """The blocks of a page that stay, one to a line."""
    page = Page(source)
    only_inside = any(inside and not dropped for _, _, inside, dropped in page.blocks)
    kept = []
    for path, text, inside, dropped in page.blocks:
        bad = low_inside if inside else low
        branch = path
        while branch and branch not in bad:
            branch = branch.rpartition("/")[0]
        if not dropped and not branch and (inside or not only_inside):
            kept.append(text)
    return "\n".join(kept)


def _text_batches(batches):
    for batch in slices(batches, 2000):
        texts = []
        for raw, rows in zip(bytes_of(batch.column("html")), batch.column("branches").to_pylist()):
            rows = rows or []
            texts.append(
                page_text(
                    raw.decode("utf-8", "replace"), {r["path"] for r in rows},
                    {r["path"] for r in rows if r["importance"] < LOW_INSIDE},
                )
            )
        yield pa.RecordBatch.from_arrays(
            [batch.column("page_id").cast(pa.int64()), batch.column("url"),
             pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
            ["page_id", "url", "text", "n_chars"],
        )


def host_column(url: str = "url") -> Column:
    return F.lower(
        F.regexp_extract(F.coalesce(F.col(url), F.lit("")), r"^(?:[a-zA-Z][A-Za-z0-9_+.-]*://)?([^/?]*)", 1)
    )


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, main text and its length of every page.

    Only branches that go are brought to the pages, a list for each host. It is joined by its
    written size: broadcast if small, else by host, where a host with very many pages is split.
    """
    low = materialized(
        importance(pages).filter(F.col("importance") < LOW)
        .groupBy("host").agg(F.collect_list(F.struct("path", "importance")).alias("branches")),
        "site-branches",
    )
    keyed = pages.select("page_id", "url", "html", host_column().alias("host"))
    return keyed.join(low, "host", "left").select(
        "page_id", "url", "html", "branches"
    ).mapInArrow(_text_batches, SCHEMA)
