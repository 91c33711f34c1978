"""Main text of web pages by a site style tree.

The pages of a host are merged: elements with the same path of tags, classes and ids are one style node.
A node's importance joins how many different rows of children it has over the pages, and how much the
texts below it differ; templates are alike from page to page, content is not. Branches of low importance
are removed, on every page. Menus and footers that vary from page to page would look like content, so that
elements whose tag, class, id or role names them are removed too. A marked article (<article>, <main>)
weighs: inside it only branches of next to no importance go, and it is the main text where it holds the
larger part of what remains.

Pages are parsed twice, first for the counts, then beside the removed nodes of their host, so that only
the pages themselves are shuffled, and no parsed page is stored.
"""

from __future__ import annotations

import html as references
import re
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netsight.llm.common import rows_of
from netsight.llm.urls import host_of
from netsight.session import cut_lineage, ship_package

#: Fixed values of HTML: elements by how they are laid out and parsed.
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
RAW = frozenset("script style noscript template iframe svg title textarea select".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer "
    "form h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol p pre section summary table tbody td tfoot th "
    "thead tr ul".split()
)
#: A start tag of the first kind ends open elements of the second, up to an element of the third.
ENDS = {
    "li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}),
    "option": ({"option"}, {"select"}), "body": ({"head"}, {"html"}),
}
#: Elements and names of parts that are not the article.
OUTSIDE = frozenset("nav footer aside form menu dialog button head".split())
NAMES = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo banner cookie cookies consent notice popup modal "
    "sidebar menu nav navbar navigation breadcrumb breadcrumbs footer masthead comment comments commentlist disqus respond "
    "reply replies share sharing social related newsletter subscribe signup login widget toolbar pagination pager skip search "
    "contentinfo complementary alert form header".split()
)
#: Words that say where such a part is, beside its name.
PLACES = frozenset("main site top bottom".split())
COMMENTS = frozenset("comment comments commentlist disqus respond reply replies related".split())
CONTAINERS = frozenset(["article", "main"])
TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z)", re.S
)
ATTRIBUTE = re.compile(r"([^\s=/\"']+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))")
SPACE = re.compile(r"[\s ]+")

#: Pages on which a style node must be; importance below which it goes; and below which it goes in a marked article.
LEAST_PAGES, LOW, LOW_INSIDE = 3, 0.15, 0.05
SALTS = 16


class _Element:
    __slots__ = ("name", "path", "outside", "named", "inside", "children")

    def __init__(self, name: str, path: str, outside: bool, named: bool, inside: bool):
        self.name, self.path, self.outside, self.named, self.inside = name, path, outside, named, inside
        self.children: list[str] = []


def _words(named: str) -> set[str]:
    """Words of NAMES that are whole names, maybe with each other or a place, and "main" if it is one."""
    out = set()
    for token in named.split():
        words = {w for w in re.split(r"[^a-z]+", token) if w}
        if token == "main":
            out.add(token)
        elif words <= NAMES | PLACES:
            out |= words & NAMES
    return out


def _style(name: str, attributes: str) -> tuple[str, set[str], bool]:
    """The style of an element, the words that name it, and whether it is hidden."""
    if not attributes.strip():
        return name, set(), False
    found = {k.lower(): a or b or c for k, a, b, c in ATTRIBUTE.findall(attributes)}
    named = " ".join(found.get(k, "") for k in ("class", "id", "role")).lower()
    hidden = bool(re.search(r"(?:^|\s)hidden(?:\s|/|$)", attributes)) or "display:none" in found.get("style", "").replace(" ", "")
    label = "".join(f" {k}={found[k]}" for k in ("class", "id", "role") if k in found)
    return name + label, _words(named), hidden or found.get("aria-hidden") == "true"


def parse(page: str) -> tuple[list[tuple[str, str, bool]], list[tuple[str, str]]]:
    """The blocks of a page, (path, text, in a marked article) in page order, without those outside any
    article by name; and the elements, (path, its row of children)."""
    root = _Element("", "", False, False, False)
    stack, blocks, elements, held = [root], [], [], []
    within_named: list[tuple[int, tuple[str, str, bool]]] = []

    def flush() -> None:
        text = SPACE.sub(" ", "".join(held)).strip()
        held.clear()
        block = next(e for e in reversed(stack) if e.name in BLOCK or e is root)
        if not text or any(e.outside for e in stack):
            return
        first = next((k for k, e in enumerate(stack) if e.inside), len(stack))
        if not any(e.named for e in stack):
            blocks.append((block.path, text, first < len(stack)))
        elif first < len(stack) and not any(e.named for e in stack[first:]):
            within_named.append((len(blocks), (block.path, text, False)))

    def close(count: int) -> None:
        for _ in range(count):
            e = stack.pop()
            if e.name in BLOCK and e.children:
                elements.append((e.path, ">".join(e.children)))

    at = 0
    while at < len(page):
        m = TOKEN.search(page, at)
        if m is None:
            held.append(references.unescape(page[at:]))
            break
        if m.start() > at:
            held.append(references.unescape(page[at : m.start()]))
        at, name = m.end(), (m[2] or "").lower()
        if not name:
            continue
        if m[1]:  # an end tag
            depth = next((k for k in range(len(stack) - 1, 0, -1) if stack[k].name == name), 0)
            if name in BLOCK:
                flush()
            if depth:
                if any(e.name in BLOCK for e in stack[depth + 1 :]):
                    if name not in BLOCK:  # an inline end does not close blocks
                        continue
                    flush()
                close(len(stack) - depth)
            continue
        if name in VOID:
            if name == "br" or name in BLOCK:
                flush() if name in BLOCK else held.append(" ")
            continue
        if name in RAW:
            end = re.compile(rf"</{re.escape(name)}(?=[\s/>])[^>]*>", re.I).search(page, at)
            at = end.end() if end else len(page)
            held.append(" ")
            continue
        if name in BLOCK:
            flush()
            depth = next((k for k in range(len(stack) - 1, 0, -1) if stack[k].name in BLOCK), 0)
            if stack[depth].name == "p":
                close(len(stack) - depth)
        if name in ENDS:
            ended, upto = ENDS[name]
            k = len(stack) - 1
            while k > 0 and stack[k].name not in upto:
                if stack[k].name in ended:
                    flush()
                    close(len(stack) - k)
                k -= 1
                k = min(k, len(stack) - 1)
        style, names, hidden = _style(name, m[3])
        above = stack[-1]
        article = name in CONTAINERS or "main" in names
        within = any(e.inside for e in stack)
        outside, named = hidden or name in OUTSIDE, bool(names & NAMES)
        if name == "header" or names & NAMES == {"header"}:
            outside, named = hidden or name == "header" and not within, names & NAMES != set() and not within
        if name in ("html", "body"):
            outside = named = False
        if name == "main" or name == "article" and not any(e.name == "article" for e in stack):
            named = False  # an article in an article is a comment or a teaser if it is named so
        outside |= named and bool(names & COMMENTS)
        parent = next(e for e in reversed(stack) if e.name in BLOCK or e is root)
        path = f"{parent.path}/{style}" if name in BLOCK else above.path
        if name in BLOCK:
            parent.children.append(style)
        stack.append(_Element(name, path, outside, named, article and not outside and not named))
    flush()
    close(len(stack) - 1)
    # A container named as a part outside is none if the page's only article, its larger part, is in it; the
    # rest of the page stays beside it.
    rescued = sum(len(t) for _, (_, t, _) in within_named)
    if rescued > sum(len(t) for _, t, _ in blocks) and not any(i for _, _, i in blocks):
        for place, block in reversed(within_named):
            blocks.insert(place, block)
    return blocks, elements


def _name(text: str) -> int:
    return xxhash.xxh64_intdigest(text.encode(), 0) - (1 << 63)


class _Nodes:
    """The hashes of a path's style nodes, from the page down."""

    def __init__(self):
        self.known: dict[str, tuple[int, ...]] = {}

    def __call__(self, path: str) -> tuple[int, ...]:
        if path not in self.known:
            if len(self.known) > 1 << 16:
                self.known.clear()
            cut = path.split("/")
            self.known[path] = tuple(_name("/".join(cut[: k + 1])) for k in range(1, len(cut)))
        return self.known[path]


def _pages(pages: DataFrame, key: str, url: str, html: str) -> DataFrame:
    return pages.select(
        F.col(key).alias("key"), F.col(url).alias("url"), host_of(F.col(url)).alias("host"),
        F.coalesce(F.col(html), F.lit("")).cast("binary").alias("html"),
    )


def _outlines(rows: DataFrame) -> DataFrame:
    """(host, blocks, elements) of every page: paths, texts and rows of children as hashes."""
    block = pa.struct([("nodes", pa.list_(pa.int64())), ("content", pa.int64())])
    element = pa.struct([("node", pa.int64()), ("row", pa.int64())])
    schema = "host string, blocks array<struct<nodes:array<bigint>,content:bigint>>, elements array<struct<node:bigint,row:bigint>>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        nodes = _Nodes()
        for batch in batches:
            all_blocks, all_elements = [], []
            for (data,) in rows_of([batch], "html"):
                blocks, elements = parse(data.decode())
                all_blocks.append([{"nodes": nodes(p), "content": _name(t)} for p, t, _ in blocks])
                all_elements.append([{"node": n[-1], "row": _name(r)} for p, r in set(elements) if (n := nodes(p))])
            columns = [batch.column("host"), pa.array(all_blocks, pa.list_(block)), pa.array(all_elements, pa.list_(element))]
            yield pa.RecordBatch.from_arrays(columns, ["host", "blocks", "elements"])

    return rows.select("host", "html").mapInArrow(run, schema)


def chosen(blocks: list[tuple[tuple[int, ...], str, bool]], low: set[int], least: set[int]) -> list[str]:
    """The texts that make the main text, of (nodes, text, in a marked article): low are the unimportant nodes,
    least those of next to no importance. If that takes more than half of a marked article, the article itself
    repeats on its host, as near copies do, and stays whole."""
    inside = [(t, not least.intersection(n)) for n, t, marked in blocks if marked]
    whole = 2 * sum(len(t) for t, good in inside if good) < sum(len(t) for t, _ in inside)
    kept = [(t, m) for n, t, m in blocks if (whole or not least.intersection(n) if m else not low.intersection(n))]
    marked = sum(len(t) for t, m in kept if m)
    return [t for t, m in kept if m or 2 * marked <= sum(len(t) for t, _ in kept)]


def _variety(counted: DataFrame, by: list[str], name: str) -> DataFrame:
    """counted (by, kind, n) to (by, pages, kinds, name): the entropy of the kinds over the pages, from 0 to 1."""
    total = counted.groupBy(*by).agg(
        F.sum("n").alias("pages"), F.count("*").alias("kinds"), F.sum(F.col("n") * F.log("n")).alias("s")
    )
    entropy = (F.log("pages") - F.col("s") / F.col("pages")) / F.log("pages")
    return total.select(*by, "pages", "kinds", F.when(F.col("pages") > 1, F.greatest(F.lit(0.0), entropy)).otherwise(1.0).alias(name))


def unimportant(outlines: DataFrame, least_pages: int = LEAST_PAGES, low: float = LOW) -> DataFrame:
    """(host, node, importance): the style nodes of a host, on some pages at least, whose importance is low.

    importance = (1 - 0.9^l) * variety of the node's rows of children + 0.9^l * mean variety of the texts
    below it, l the number of different rows. Pages of a host with the same blocks count once: copies of
    a page tell nothing about its template.
    """
    seen = outlines.select("host", "blocks", F.array_sort("elements").alias("elements"))
    page = [F.xxhash64("blocks").alias("p"), F.xxhash64(F.lit(1), "blocks").alias("q")]
    once = seen.select("host", *page, F.struct(F.xxhash64("elements").alias("layout"), "blocks", "elements").alias("page"))
    pages = cut_lineage(once.groupBy("host", "p", "q").agg(F.min("page").alias("page")).select("host", "page.blocks", "page.elements"))
    blocks = pages.select("host", F.explode(F.array_distinct("blocks")).alias("b"))
    texts = blocks.groupBy("host", F.col("b.nodes").alias("nodes"), F.col("b.content").alias("kind")).agg(F.count("*").alias("n"))
    leaves = _variety(texts, ["host", "nodes"], "differ").where(F.size("nodes") > 0)
    content = leaves.select("host", F.explode("nodes").alias("node"), "differ", "pages").groupBy("host", "node").agg(
        (F.sum(F.col("differ") * F.col("pages")) / F.sum("pages")).alias("differ"), F.max("pages").alias("pages")
    )
    rows = pages.select("host", F.explode("elements").alias("e")).groupBy(
        "host", F.col("e.node").alias("node"), F.col("e.row").alias("kind")
    )
    styles = _variety(rows.agg(F.count("*").alias("n")), ["host", "node"], "vary").select("host", "node", "kinds", "vary")
    share = F.pow(F.lit(0.9), F.coalesce("kinds", F.lit(0)))
    importance = (1 - share) * F.coalesce("vary", F.lit(0.0)) + share * F.col("differ")
    joined = content.join(styles, ["host", "node"], "left").withColumn("importance", importance)
    return joined.where((F.col("pages") >= least_pages) & (F.col("importance") < low)).select("host", "node", "importance")


def main_texts(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """(key, url, text, n_chars) of every page: its blocks in page order, two line ends between them.

    Blocks below an unimportant style node of the page's host go; of the others, those in a marked article are
    the text if they are the larger part, else all. A block's white space is one space. Null and empty
    pages, and pages without text, have an empty text; a null url, or one without a host, belongs to the
    host ''. Every row gives a row, whatever its key. An empty table gives an empty one.
    """
    ship_package(pages.sparkSession)
    rows = _pages(pages, key, url, html)
    node = F.struct("node", (F.col("importance") < LOW_INSIDE).alias("least"))
    removed = cut_lineage(unimportant(_outlines(rows)).groupBy("host").agg(F.collect_list(node).alias("removed")))
    # A host may have any number of pages: each salt has the row to join.
    removed = removed.select("host", "removed", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    salted = rows.withColumn("salt", F.pmod(F.xxhash64("key", "url"), F.lit(SALTS)).cast("int"))
    joined = salted.join(removed, ["host", "salt"], "left").select(
        "key", "url", "html", F.transform("removed", lambda r: r["node"]).alias("low"),
        F.transform(F.filter("removed", lambda r: r["least"]), lambda r: r["node"]).alias("least"),
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        nodes = _Nodes()
        for batch in batches:
            texts = []
            for data, low, least in rows_of([batch], "html", "low", "least"):
                blocks, _ = parse(data.decode())
                texts.append("\n\n".join(chosen([(nodes(p), t, m) for p, t, m in blocks], set(low or ()), set(least or ()))))
            yield pa.RecordBatch.from_arrays([batch.column("key"), batch.column("url"), pa.array(texts, pa.string())], ["key", "url", "text"])

    found = joined.mapInArrow(run, f"key {rows.schema['key'].dataType.simpleString()}, url string, text string")
    return found.select(F.col("key").alias(key), "url", "text", F.length("text").cast("bigint").alias("n_chars"))
