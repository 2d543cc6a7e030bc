"""Main text of HTML pages by a style tree for each site.

The element trees of a host's pages are merged: a node is a path of tags with their classes (Yi, Liu and Li, 2003). Over the
pages that have it, a node has two importances:

- presentation: the greatest entropy, over its kinds of children, of how many of them a page has. What a template writes once
  or six times on every page has none; where an author writes as many paragraphs as it takes, it is above VARIED, which is
  more than a child that is there or not can have;
- content: 1 - log(n) / log(m + SMOOTH) for a block of text that n of the host's m pages have there; for the node the mean of that
  over its blocks on all pages.

Each page is then cut from the root down. A branch with an important node is entered, its sister branches without one go where
they hold less text than it, unless at least half of their text is headings and paragraphs of great content importance; the first important node that isn't itself mostly one important branch stays whole. Blocks of text
of little content importance outside articles, in nodes of little, go too. Equal pages of a host count as one.

Markup comes second, as a prior for what entropies can't tell: article and main elements are important from the start, what is
named as furniture (nav, footer, form, a class or id that is "ad" or "comments") never is, and leaves what the tree has kept:
comments vary from page to page like articles. Where an article (or else a main element) is left, it is all that is.

Entropies are summed by Spark over (host, path, count) and (host, path, block): no host's pages meet in one task, however many.
On hosts with few pages entropies are small of themselves: log(m) at most.

Cases: null or empty html has an empty text; markup that is cut short, unclosed or wrongly nested is read as far as it goes;
pages are read whole; equal pages of a host get equal texts; a null url is a host of its own, ""; extra columns pass through,
a column named text or n_chars raises ValueError.
"""

from __future__ import annotations

import hashlib
import html as entities
import re
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graywacke.llm.common import Scratch, bounded, distinct_names, small_batches

#: Entropy of counts from which on a node is important; content importance below which a block is the site's; pages for smoothing.
VARIED, THRESHOLD, SMOOTH = 1.0, 0.3, 7

TAG = re.compile(
    r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*+(?:>|\Z)"""
    r"""|<(?P<close>/?)(?P<name>[a-zA-Z][^\s/>]*+)(?P<rest>(?:[^>"']++|"[^"]*+"|'[^']*+')*+)>|<(?P<close2>/?)(?P<name2>[a-zA-Z][^\s/>]*+)(?P<rest2>[^>]*+)(?:>|\Z)""",
    re.S,
)
ATTRIBUTE = re.compile(r"""([^\s=/"'>]+)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""")
#: Elements whose content isn't markup, up to their end tag.
RAW = frozenset("script style textarea title xmp iframe noembed noframes noscript".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset("address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead title tr ul".split())
#: A start tag ends these elements, if they are open and no element of the second set is open inside them.
ENDS = {t: ({"p"}, {"button", "table", "object"}) for t in BLOCK} | {
    "li": ({"li", "p"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd", "p"}, {"dl"}), "dd": ({"dt", "dd", "p"}, {"dl"}), "option": ({"option"}, {"select"}),
    "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "tbody": ({"tr", "td", "th", "thead", "tbody"}, {"table"}), "body": ({"head", "p"}, set()),
}
#: Elements of running text: a branch of them with text of its own is no furniture, however short.
PROSE = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre figcaption".split())
FURNITURE_TAGS = frozenset("head nav footer aside form dialog button select option datalist template svg canvas object audio video map menu".split())
FURNITURE_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar toolbar form status".split())
FURNITURE_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising adsense sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices alert popup modal overlay "
    "nav navbar navigation menu menus submenu breadcrumb breadcrumbs pagination pager toolbar topbar sidebar sidebars aside rail widget widgets footer masthead header "
    "comment comments commentlist respond reply replies disqus share sharing social related recommended newsletter subscribe signup login search form skip".split()
)


@dataclass(slots=True)
class Element:
    name: str
    path: int
    up: Element | None = None
    #: Furniture by its tag, role or attributes; a form, which may hold a whole page; furniture by a class or id.
    named: bool = False
    form: bool = False
    marked: bool = False
    #: Whether it is an article or inside one, a main element or inside one; whether it is around one.
    article: bool = False
    main: bool = False
    holds: bool = False
    #: Whether it is such an element itself.
    body: bool = False
    #: Its place among the page's elements.
    at: int = 0


@lru_cache(1 << 16)
def path_of(parent: int, step: str) -> int:
    """The number of a path: that of the parent's path, and the tag with its classes."""
    return fingerprint(f"{parent}>{step}")


class Page:
    """The elements of a page in order, and its blocks of text, each with the element it stands in."""

    def __init__(self, source: str):
        self.blocks: list[tuple[Element, str]] = []
        self.elements: list[Element] = [Element("", 0)]
        self.open: list[Element] = self.elements[:]
        self.text: list[str] = []
        self.read(source)

    def read(self, source: str) -> None:
        at = 0
        while tag := TAG.search(source, at):
            self.text.append(source[at : tag.start()])
            at = tag.end()
            name, rest = tag["name"] or tag["name2"], tag["rest"] or tag["rest2"] or ""
            if not name:
                continue
            name = name.lower()
            if tag["close"] or tag["close2"]:
                self.end(name)
                continue
            self.start(name, rest)
            if name in RAW and not rest.endswith("/"):
                end = re.compile(rf"</{re.escape(name)}(?=[\s/>]|\Z)[^>]*>?", re.I).search(source, at)
                at = end.end() if end else len(source)
                self.end(name)
        self.text.append(source[at:])
        self.flush()

    def flush(self) -> None:
        text = " ".join(entities.unescape("".join(self.text)).split())
        self.text.clear()
        if text:
            self.blocks.append((self.open[-1], text))

    def start(self, name: str, rest: str) -> None:
        if name in ENDS:
            ended, stop = ENDS[name]
            for i in range(len(self.open) - 1, 0, -1):
                if self.open[i].name in stop or self.open[i].name in ("article", "div", "section", "main", "aside", "body") and name not in ("body",):
                    break
                if self.open[i].name in ended:
                    self.flush()
                    del self.open[i:]
        if name in BLOCK:
            self.flush()
        elif name == "br":
            self.text.append(" ")
        if name in VOID or rest.endswith("/") and name not in BLOCK:
            return
        up = self.open[-1]
        element = Element(name, up.path, up, article=up.article, main=up.main, at=len(self.elements))
        if name in BLOCK or name in FURNITURE_TAGS or name in RAW:
            attributes = {k.lower(): a or b or c for k, a, b, c in ATTRIBUTE.findall(rest)} if "=" in rest else {}
            # Whole classes and ids: "no-sidebar" and "has-comments" say something else than "sidebar" and "comments".
            words = {*attributes.get("class", "").lower().split(), *attributes.get("id", "").lower().split()}
            element.path = path_of(up.path, ".".join([name, *sorted(attributes.get("class", "").split())]))
            role = attributes.get("role", "").lower()
            body = name if name in ("article", "main") else role
            element.article, element.main = up.article or body == "article", up.main or body == "main"
            element.body = body in ("article", "main")
            element.form = name == "form" or role == "form"
            inside = up.article or up.main
            # The header of an article has its title; any other is the page's.
            element.named = not element.form and (name in FURNITURE_TAGS or name in RAW or role in FURNITURE_ROLES) or (name == "header" and not inside) or "hidden" in rest.lower().split() or attributes.get("aria-hidden") == "true"
            element.marked = body not in ("article", "main") and name not in ("html", "body") and not (name == "header" and inside) and not words.isdisjoint(FURNITURE_WORDS)
            around: Element | None = up if body in ("article", "main") else None
            while around and not around.holds:
                around.holds, around = True, around.up
        self.elements.append(element)
        self.open.append(element)

    def end(self, name: str) -> None:
        for i in range(len(self.open) - 1, 0, -1):
            if self.open[i].name == name:
                if any(x.name in BLOCK for x in self.open[i:]):
                    self.flush()
                del self.open[i:]
                return

    def cut(self, varied: frozenset[int], markup: bool = True, drop: frozenset[tuple[int, int]] = frozenset()) -> list[bool]:
        """Which elements the site's tree drops, text and all; varied: the paths of important nodes, drop: blocks of little importance.

        A branch stays if at least half its text is headings and paragraphs that are important in themselves, as few other pages have them.
        """
        n = len(self.elements)
        named, own, within, size, fresh = [False] * n, [False] * n, [False] * n, [0] * n, [0] * n
        for e, text in self.blocks:
            size[e.at] += len(text)
            node = e
            while node.up is not None and node.path == node.up.path:
                node = node.up  # inline elements are no nodes
            fresh[e.at] += len(text) * (node.name in PROSE and (not drop or (e.path, fingerprint(text)) not in drop))
        alone = size[:]
        for k, e in enumerate(self.elements):
            named[k] = markup and (e.named or e.form or e.marked and not e.holds or e.up is not None and named[e.up.at])
            within[k] = own[k] = (markup and e.body or e.path in varied and (e.up is None or e.path != e.up.path)) and not named[k]
        best, vital = [0] * n, [0] * n
        for k in range(n - 1, 0, -1):
            up = self.elements[k].up.at
            size[up] += size[k]
            fresh[up] += fresh[k]
            if within[k]:
                within[up], vital[up], best[up] = True, vital[up] + size[k], max(best[up], size[k])
        gone, whole = [False] * n, [False] * n
        for k, e in enumerate(self.elements):
            up = e.up.at if e.up else k
            if k and (gone[up] or whole[up]):
                gone[k], whole[k] = gone[up], whole[up]
            elif not within[k]:
                # Of an open parent only branches with as much text as its important ones stay; text of its own below.
                gone[k], whole[k] = k > 0 and size[k] < vital[up] and 2 * fresh[k] < size[k], True
            else:
                whole[k] = own[k] and 2 * best[k] < size[k] or not vital[k]
        return [g or not w and alone[k] < vital[k] for k, (g, w) in enumerate(zip(gone, whole))]

    def left(self, furniture: Callable[[Element], bool], gone: list[bool]) -> list[tuple[Element, str]]:
        """The blocks that neither the tree nor the markup drops; those inside articles where there are any, or else inside main elements."""
        out: list[bool] = []
        for e in self.elements:
            out.append(furniture(e) or (e.up is not None and out[e.up.at]))
        left = [(e, text) for e, text in self.blocks if not out[e.at] and not gone[e.at]]
        return [b for b in left if b[0].article] or [b for b in left if b[0].main] or left

    def kept(self, varied: frozenset[int] = frozenset(), markup: bool = True, drop: frozenset[tuple[int, int]] = frozenset()) -> list[tuple[int, str, bool]]:
        """(path, text, whether inside an article) of the blocks that the site's tree leaves, and then the page's own markup.

        A class or id doesn't make furniture of what holds an article or main element, unless another such element stands
        outside: comments and teasers are often articles of their own. Where classes, ids and forms leave no text they don't count.
        """
        gone = self.cut(varied, markup, drop)
        if not markup:
            left = [(e, text) for e, text in self.blocks if not gone[e.at] and e.name not in RAW and not (e.up and e.up.name == "head")]
            return [(e.path, text, e.article) for e, text in left]
        left = self.left(lambda e: e.named or e.form or e.marked, gone)
        if not left or self.elements[0].holds and not any(e.article or e.main for e, _ in left):
            left = self.left(lambda e: e.named or e.form or e.marked and not e.holds, gone) or self.left(lambda e: e.named, gone)
        return [(e.path, text, e.article) for e, text in left]


def fingerprint(text: str) -> int:
    return int.from_bytes(hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True)


def merged(pages: DataFrame) -> DataFrame:
    """The merged trees: (host, path, parent, kind, feature) and the number n of different pages that have it. kind layout: feature
    is how many elements of the path a page has; kind content: feature is the fingerprint of a block outside articles.

    pages: host and html.
    """

    def look(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows: list[tuple[str, int, int, int, str, int]] = []
            fresh = batch.drop_duplicates(["host", "page"])
            for host, number, source in zip(fresh.host, fresh.page, fresh.html):
                page = Page(source or "")
                # Inline elements have their parent's path and are no nodes.
                nodes = [e for e in page.elements if e.up is None or e.path != e.up.path]
                many = Counter((e.path, e.up.path if e.up else -1) for e in nodes)
                rows += [(host, number, path, up, "layout", n) for (path, up), n in many.items()]
                rows += {(host, number, e.path, 0, "content", fingerprint(text)) for e, text in page.blocks if not e.article}
            yield pd.DataFrame(rows, columns=["host", "page", "path", "parent", "kind", "feature"])

    small_batches(pages.sparkSession)
    seen = pages.select("host", "html", F.xxhash64("html").alias("page")).mapInPandas(look, "host string, page long, path long, parent long, kind string, feature long")
    # One page may be on many rows: it counts once.
    return seen.distinct().groupBy("host", "path", "parent", "kind", "feature").agg(F.count(F.lit(1)).alias("n"))


def important(counts: DataFrame) -> DataFrame:
    """(host, path) of the nodes of presentation importance VARIED or more. counts: as from merged()."""
    layout = counts.filter("kind = 'layout'").groupBy("host", "path", "parent").agg(F.sum("n").alias("m"), F.sum(F.col("n") * F.log("n")).alias("n_log_n"))
    above = layout.select("host", F.col("path").alias("parent"), F.col("m").alias("m_parent"))
    without = F.col("m_parent") - F.col("m")
    entropy = F.log("m_parent") - (F.col("n_log_n") + F.when(without > 0, without * F.log(without)).otherwise(0)) / F.col("m_parent")
    return layout.join(above, ["host", "parent"]).filter(entropy >= VARIED).select("host", F.col("parent").alias("path")).distinct()


def recurring(counts: DataFrame) -> DataFrame:
    """(host, path, feature) of the blocks whose content importance is below THRESHOLD, as is their node's. counts: as from merged()."""
    sizes = counts.filter("kind = 'layout' and parent = -1").groupBy("host").agg(F.sum("n").alias("m"))
    content = counts.filter("kind = 'content'")
    importance = lambda log_n: 1 - log_n / F.log(F.col("m") + SMOOTH)
    nodes = content.groupBy("host", "path").agg((F.sum(F.col("n") * F.log("n")) / F.sum("n")).alias("log_n")).join(sizes, "host").filter(importance(F.col("log_n")) < THRESHOLD)
    return content.join(nodes.select("host", "path", "m"), ["host", "path"]).filter(importance(F.log("n")) < THRESHOLD).select("host", "path", "feature")


def site_trees(pages: DataFrame, scratch: Scratch) -> DataFrame:
    """(host, varied, blocks): of each host that has any, the important paths and the (path, feature) of recurring blocks.

    Few pages can have different ones of them, so that both lists stay short: a path needs several pages, a block many.
    """
    counts = scratch.save("counts", merged(pages))
    nodes = important(counts).select("host", "path", F.lit(None).cast("long").alias("feature"))
    both = nodes.union(recurring(counts)).groupBy("host")
    block = F.when(F.col("feature").isNotNull(), F.struct("path", "feature"))
    trees = scratch.save("trees", both.agg(F.collect_set(F.when(F.col("feature").isNull(), F.col("path"))).alias("varied"), F.collect_set(block).alias("blocks")))
    scratch.drop("counts")
    return trees


def main_text(source: str | None, varied: frozenset[int] = frozenset(), drop: frozenset[tuple[int, int]] = frozenset(), markup: bool = True) -> str:
    """The text of a page by a site's tree (important paths, and blocks to drop by path and fingerprint), blocks parted by an empty line.

    Without markup only the tree counts, and that scripts, styles and the head hold no text to read.
    """
    blocks = Page(source or "").kept(varied, markup, drop)
    return "\n\n".join(text for path, text, article in blocks if article or not drop or (path, fingerprint(text)) not in drop)


def extract(pages: DataFrame, url: str = "url", html: str = "html", tree: bool = True, markup: bool = True) -> DataFrame:
    """pages with text (the main text) and n_chars, its code points. Without tree or markup, to measure what each does."""
    distinct_names(pages, "text", "n_chars")
    host = F.lower(F.regexp_extract(F.coalesce(F.col(url), F.lit("")), r"(?s)^.*?://([^/?#]*)", 1))
    rows = pages.select(F.struct(*(F.col(f"`{c}`") for c in pages.columns)).alias("row"), host.alias("host"), F.col(html).alias("html"))
    if tree:
        trees = bounded(site_trees(rows.select("host", "html"), Scratch(pages.sparkSession, "pages")))
        rows = rows.join(trees, "host", "left")
    else:
        rows = rows.withColumns({"varied": F.lit(None).cast("array<long>"), "blocks": F.lit(None).cast("array<struct<path:long,feature:long>>")})

    @F.pandas_udf("string")
    def text(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        none = ()
        for sources, paths, blocks in batches:
            yield pd.Series([
                main_text(s, frozenset(none if v is None else v), frozenset((b["path"], b["feature"]) for b in (none if d is None else d)), markup) for s, v, d in zip(sources, paths, blocks)
            ], dtype="object")

    small_batches(pages.sparkSession)
    return rows.select("row", text("html", "varied", "blocks").alias("text")).select("row.*", "text", F.length("text").cast("long").alias("n_chars"))
