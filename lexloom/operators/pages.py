"""Raw pages: node rows, the block that holds the prose, its paragraphs, titles and link clusters.

A page becomes rows in document order: elements and pieces of text (`tag` is `#text`).  Node ids
count from 1 (0 is the document), and `last` is the last id inside a node, so "inside" is a range
of ids.  Parsing is the only Python step, one page at a time; scoring, clustering and
assembling are joins and groupings by page.
"""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser
from urllib.parse import urljoin

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as X
from ..functions import urls as U
from ..plans.scratch import dealt, materialize

# Blocks that can hold prose; elements left out of content and of link lists.
BLOCKS = ("div", "p", "article", "section", "td")
DROP_CONTENT = ("script", "style", "nav", "header", "footer", "aside", "form", "button", "select", "textarea")
DROP_LINKS = ("script", "style", "nav", "header", "footer")
# A chapter label; signs of a link to a table of contents.
LABEL = r"第?\s*[0-9〇一二三四五六七八九十百千两廿卅]+\s*[章回卷节節集篇]"
TOC_HREF = r"(?i)(mainindex|catalog|chapterlist|chapter-list|chapters|mulu|dir)"
TOC_TEXT = r"(目录|章节目录|全部章节|章节列表|最新章节|点击阅读|开始阅读|立即阅读|在线阅读)"

NODE = "node int, parent int, up2 int, up3 int, last int, tag string, href string, text string, para int, link int, link_chars int"
#: Steps `tag.class` from the top to the element, address of its picture (or content of a meta element), its tip.
PATHS = "path string, src string, tip string"
_VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
_INLINE = frozenset("a b big code em font i s small strike strong tt u".split())
_CLOSES_P = frozenset("address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split())
_SIBLINGS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
_LIMITS = {"li": {"ul", "ol"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"tr", "table"}, "th": {"tr", "table"}, "option": {"select"}}


class _Nodes(HTMLParser):
    """Node rows of one page; elements that pages leave open are closed as browsers do."""

    def __init__(self, base: str, drop: frozenset[str], paths: bool = False):
        super().__init__(convert_charrefs=True)
        self.base, self.drop, self.paths = base, drop, paths
        self.rows: list[list] = []
        self.open: list[list] = []  # rows of the open elements
        self.again: list[tuple] = []  # inline elements cut off by the end of a paragraph
        self.hidden: list[str] = []

    def _add(self, tag: str, href: str | None, text: str | None) -> list:
        up = [r[0] for r in self.open[:-4:-1]] + [0]
        up += [None] * (3 - len(up))
        near = {t: next((r[0] for r in reversed(self.open) if r[5] == t), None) for t in ("p", "a")} if text is not None else {"p": None, "a": None}
        row = [len(self.rows) + 1, *up[:3], len(self.rows) + 1, tag, href, text, near["p"], near["a"], 0]
        if self.paths:
            row += [f"{self.open[-1][-3] if self.open else ''}/{tag}", None, None]
        self.rows.append(row)
        return row

    def _close(self, at: int) -> None:
        for row in reversed(self.open[at:]):
            row[4] = len(self.rows)
        del self.open[at:]

    def _close_p(self) -> None:
        at = next((i for i in range(len(self.open) - 1, -1, -1) if self.open[i][5] == "p"), None)
        if at is not None:
            self.again += [(r[5], r[6]) for r in self.open[at + 1 :] if r[5] in _INLINE]
            self._close(at)

    def _reopen(self) -> None:
        for tag, href in self.again:
            self.open.append(self._add(tag, href, None))
        self.again = []

    def handle_starttag(self, tag, attrs):
        if self.hidden or tag in self.drop:
            if tag not in _VOID:
                self.hidden.append(tag)
            return
        if tag in _CLOSES_P:
            self._close_p()
        elif tag in _SIBLINGS:
            for i in range(len(self.open) - 1, -1, -1):
                if self.open[i][5] in _LIMITS[tag]:
                    break
                if self.open[i][5] in _SIBLINGS[tag]:
                    self._close(i)
                    break
        else:
            self._reopen()
        href = dict(attrs).get("href") if tag == "a" else None
        if href:
            try:
                href = urljoin(self.base, href.strip())
            except ValueError:
                href = None
        row = self._add(tag, href, None)
        if self.paths:
            row[-3:] = self._place(tag, dict(attrs))
        if tag not in _VOID:
            self.open.append(row)

    def _place(self, tag: str, attrs: dict) -> list:
        kind = attrs.get("property") or attrs.get("name") if tag == "meta" else None
        step = ".".join([tag, *(attrs.get("class") or "").split()]) + (f"[{kind}]" if kind else "")
        above = self.open[-1][-3] if self.open else ""
        src = attrs.get("content") if tag == "meta" else attrs.get("src") or attrs.get("data-src")
        if src and (tag != "meta" or kind == "og:image"):
            try:
                src = urljoin(self.base, src.strip())
            except ValueError:
                src = None
        return [f"{above}/{step}", src, attrs.get("title")]

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)  # the slash means nothing in HTML

    def handle_endtag(self, tag):
        if self.hidden:
            if tag in self.hidden:
                while self.hidden.pop() != tag:
                    pass
            return
        at = next((i for i in range(len(self.open) - 1, -1, -1) if self.open[i][5] == tag), None)
        if at is not None:
            if tag not in _INLINE:
                self.again += [(r[5], r[6]) for r in self.open[at + 1 :] if r[5] in _INLINE]
            self._close(at)
        else:
            self.again = [x for x in self.again if x[0] != tag]

    def handle_data(self, data):
        if self.hidden:
            return
        if data.strip():
            self._reopen()
        row = self._add("#text", None, data)
        if row[9] is not None:
            for r in self.open:
                # text of a link counts for the blocks around the link, not within it
                if r[0] < row[9]:
                    r[10] += len(data)


def _mapper(drop: frozenset[str], fields: list[str], paths: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in fields]
        types = [pa.string() if x.endswith("string") else pa.int32() for x in fields]
        for batch in batches:
            for i in range(batch.num_rows):
                page = _Nodes(batch.column(1)[i].as_py() or "", drop, paths)
                page.feed(batch.column(2)[i].as_py() or "")
                page.close()
                page._close(0)
                if not page.rows:
                    continue
                columns = [pa.array(c, t) for c, t in zip(zip(*page.rows, strict=True), types, strict=True)]
                ids = pa.array([batch.column(0)[i].as_py()] * len(page.rows), batch.column(0).type)
                yield pa.RecordBatch.from_arrays([ids, *columns], names=["page_id", *names])

    return run


def html_nodes(pages: DataFrame, drop: tuple[str, ...] = (), paths: bool = False) -> DataFrame:
    """pages: page_id, url, html.  One row a node; dropped elements go with all inside them; null html has no nodes.

    With `paths`, the columns of PATHS too.
    """
    rows = pages.select("page_id", F.coalesce("url", F.lit("")).alias("url"), "html").where("html IS NOT NULL")
    schema = f"{NODE}, {PATHS}" if paths else NODE
    return rows.mapInArrow(_mapper(frozenset(drop), schema.split(", "), paths), f"page_id {dict(pages.dtypes)['page_id']}, {schema}")


def _glued(name: str) -> Column:
    """Pieces of text in document order."""
    return F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("node", "text"))), lambda x: x["text"]), "").alias(name)


def subtree_sums(nodes: DataFrame, value: Column, name: str) -> DataFrame:
    """page_id, node, tag, `name` of every element: the sum of a value over the pieces of text inside it.

    Nodes are numbered in document order, so a sum over what is inside is the difference of two running sums: one row a node, however deep
    the page is.
    """
    order = Window.partitionBy("page_id").orderBy("node")
    upto = nodes.select("page_id", "node", "last", "tag", F.sum(F.when(F.col("tag") == "#text", F.coalesce(value, F.lit(0))).otherwise(0)).over(order).alias("_upto"))
    ends = upto.select("page_id", F.col("node").alias("last"), F.col("_upto").alias("_end"))
    return upto.where("tag <> '#text'").join(ends, ["page_id", "last"]).select("page_id", "node", "tag", (F.col("_end") - F.col("_upto")).alias(name))


def span_texts(nodes: DataFrame, spans: DataFrame, breaks: bool = False) -> DataFrame:
    """page_id, top, text: all text inside the elements of `spans` (page_id, top), in order; with `breaks` a br is a line end.

    The pieces of a page are one array; a running count of them tells each element's slice of it, so an element costs what its
    own text holds, and no pairs of elements and pieces are made.
    """
    order = Window.partitionBy("page_id").orderBy("node")
    piece = (F.col("tag") == "#text") | ((F.col("tag") == "br") & F.lit(breaks))
    upto = nodes.select("page_id", "node", "last", F.sum(piece.cast("int")).over(order).alias("_upto"), piece.cast("int").alias("_own"))
    ends = upto.select("page_id", F.col("node").alias("last"), F.col("_upto").alias("_end"))
    wanted = spans.select("page_id", F.col("top").alias("node")).distinct()
    cuts = upto.join(wanted, ["page_id", "node"]).join(ends, ["page_id", "last"]).select("page_id", F.struct(F.col("node").alias("top"), (F.col("_upto") - F.col("_own") + 1).alias("first"), (F.col("_end") - F.col("_upto") + F.col("_own")).alias("n")).alias("cut"))
    text = F.when(F.col("tag") == "br", "\n").otherwise(F.col("text"))
    pieces = nodes.where(piece).groupBy("page_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("node", text.alias("t")))), lambda x: x["t"]).alias("_all"))
    cuts = cuts.groupBy("page_id").agg(F.collect_list("cut").alias("_cuts")).join(pieces, "page_id", "left")
    own = lambda c: F.array_join(F.slice(F.coalesce("_all", F.array().cast("array<string>")), c["first"].cast("int"), c["n"].cast("int")), "")
    each = cuts.select("page_id", F.explode(F.transform("_cuts", lambda c: F.struct(c["top"].alias("top"), own(c).alias("text")))).alias("x"))
    return each.select("page_id", "x.top", "x.text")


def score_blocks(nodes: DataFrame, cls: str = X.HAN, least: int = 8, link_share: float = 0.5) -> DataFrame:
    """page_id, node, score of the parent whose blocks have most characters of the class in text of their own.

    Blocks with fewer than `least` such characters, or with links over that share of their own text, count
    for nothing; the parent with the first block wins ties.
    """
    own = nodes.where("tag = '#text'").groupBy("page_id", F.col("parent").alias("node")).agg(F.sum(F.regexp_count("text", F.lit(cls))).alias("chars"), F.sum(F.length("text")).alias("size"))
    blocks = nodes.where(F.col("tag").isin(*BLOCKS)).select("page_id", "node", "parent", "link_chars")
    good = blocks.join(own, ["page_id", "node"]).where((F.col("chars") >= least) & (F.col("link_chars") <= F.col("size") * link_share))
    sums = good.groupBy("page_id", "parent").agg(F.sum("chars").alias("score"), F.min("node").alias("first"))
    best = sums.groupBy("page_id").agg(F.max(F.struct("score", (-F.col("first")).alias("order"), "parent")).alias("b"))
    return best.select("page_id", F.col("b.parent").alias("node"), F.col("b.score").alias("score"))


def richest_block(nodes: DataFrame, cls: str = X.HAN) -> DataFrame:
    """page_id, node, score of the block whose whole text has most characters of the class; the first wins ties."""
    sums = subtree_sums(nodes, F.regexp_count("text", F.lit(cls)), "score").where(F.col("tag").isin(*BLOCKS) & (F.col("score") > 0))
    best = sums.groupBy("page_id").agg(F.max(F.struct("score", (-F.col("node")).alias("order"))).alias("b"))
    return best.select("page_id", (-F.col("b.order")).alias("node"), F.col("b.score").alias("score"))


def paragraphs(nodes: DataFrame, winners: DataFrame) -> DataFrame:
    """page_id, text of the winning nodes: their paragraphs, or else the lines between breaks, or else the whole."""
    ends = nodes.select("page_id", "node", "last").unionByName(nodes.groupBy("page_id").agg(F.lit(0).alias("node"), F.max("node").alias("last")))
    spans = winners.select("page_id", F.col("node").alias("top")).join(ends.withColumnRenamed("node", "top"), ["page_id", "top"])
    spans = spans.withColumnRenamed("last", "to")
    inside = nodes.where("tag IN ('#text', 'br')").join(spans, "page_id").where("node > top AND node <= to")
    of_p = inside.where("tag = '#text' AND para > top").groupBy("page_id", "para").agg(_glued("t")).select("page_id", "para", X.trim_all(F.col("t")).alias("t")).where("t <> ''")
    joined = of_p.groupBy("page_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("para", "t"))), lambda x: x["t"]), "\n\n").alias("by_p"))
    whole = inside.withColumn("text", F.when(F.col("tag") == "br", "\n").otherwise(F.col("text"))).groupBy("page_id").agg(_glued("all"))
    return whole.join(joined, "page_id", "left").select("page_id", X.normalize_lines(F.coalesce("by_p", "all")).alias("text"))


def page_titles(nodes: DataFrame) -> DataFrame:
    """page_id, title: the first h1 where it isn't blank, else the title element, else null."""
    tops = nodes.where("tag IN ('h1', 'title')").groupBy("page_id", F.col("tag").alias("of")).agg(F.min("node").alias("top"))
    text = tops.join(span_texts(nodes, tops), ["page_id", "top"]).select("page_id", "of", F.nullif(X.trim_all(F.col("text")), F.lit("")).alias("t"))
    found = text.groupBy("page_id").agg(F.coalesce(F.max(F.when(F.col("of") == "h1", F.col("t"))), F.max(F.when(F.col("of") == "title", F.col("t")))).alias("title"))
    return nodes.select("page_id").distinct().join(found, "page_id", "left")


def page_content(pages: DataFrame, cls: str = X.HAN) -> DataFrame:
    """page_id, title, text: scored blocks, else the richest block; pages without either have an empty text."""
    nodes = materialize(html_nodes(dealt(pages), DROP_CONTENT), "nodes")  # parsed once, read by every step below
    scored = materialize(score_blocks(nodes, cls), "scored")  # a row a page
    rest = richest_block(nodes.join(scored, "page_id", "left_anti"), cls)
    text = paragraphs(nodes, scored.unionByName(rest))
    return pages.select("page_id").join(page_titles(nodes), "page_id", "left").join(text, "page_id", "left").select("page_id", "title", F.coalesce("text", F.lit("")).alias("text"))


def anchors(nodes: DataFrame) -> DataFrame:
    """page_id, node, parent, up2, up3, href, label of the links with an address and a text."""
    labels = nodes.where("link IS NOT NULL AND tag = '#text'").groupBy("page_id", F.col("link").alias("at")).agg(_glued("label"))
    links = nodes.where("tag = 'a' AND href <> ''").select("page_id", F.col("node").alias("at"), "parent", "up2", "up3", "href")
    return links.join(labels, ["page_id", "at"]).withColumn("label", X.trim_all(F.col("label"))).where("label <> ''")


def _clusters(links: DataFrame, enough: int) -> DataFrame:
    """page_id, depth, top, n of each page's cluster: the nearest depth with `enough` links, else the largest."""
    ups = F.array(*[F.struct(F.lit(d).alias("depth"), F.col(c).alias("top")) for d, c in ((1, "parent"), (2, "up2"), (3, "up3"))])
    each = links.select("page_id", "at", F.explode(ups).alias("u")).select("page_id", "at", "u.depth", "u.top").where("top IS NOT NULL")
    sizes = each.groupBy("page_id", "depth", "top").agg(F.count("*").alias("n"), F.min("at").alias("first"))
    large = F.max(F.struct("n", (-F.col("first")).alias("order"), "top"))
    best = sizes.groupBy("page_id", "depth").agg(large.alias("b")).select("page_id", "depth", F.col("b.n").alias("n"), F.col("b.top").alias("top"))
    enough_first = F.when(F.col("n") >= enough, -F.col("depth")).otherwise(-99)
    pick = best.groupBy("page_id").agg(F.max(F.struct(enough_first.alias("k"), "n", (-F.col("depth")).alias("near"), "depth", "top")).alias("p"))
    return pick.select("page_id", "p.depth", "p.top", "p.n")


def chapter_links(pages: DataFrame, label: str = LABEL) -> DataFrame:
    """page_id, number, title, url: the links that look like a list of chapters, first of each address, in order.

    Links with a chapter label are clustered by a shared ancestor up to three steps above; where no two of them
    share one, any links are, five or more.
    """
    links = anchors(html_nodes(pages, DROP_LINKS))
    labelled = links.where(F.col("label").rlike(label))
    first = _clusters(labelled, 2).where("n >= 2").withColumn("any", F.lit(False))
    other = _clusters(links, 5).join(first, "page_id", "left_anti").withColumn("any", F.lit(True))
    top = F.when(F.col("depth") == 1, F.col("parent")).when(F.col("depth") == 2, F.col("up2")).otherwise(F.col("up3"))
    mine = links.join(first.unionByName(other), "page_id").where((F.col("top") == top) & (F.col("any") | F.col("label").rlike(label)))
    once = mine.groupBy("page_id", F.col("href").alias("url")).agg(F.min(F.struct("at", "label")).alias("x"))
    number = F.row_number().over(Window.partitionBy("page_id").orderBy("x.at")).cast("long")
    return once.select("page_id", number.alias("number"), F.col("x.label").alias("title"), "url")


def _origin(url: Column) -> Column:
    return F.regexp_extract(F.lower(url), r"^([a-z][a-z0-9+.\-]*://[^/?#]*)", 1)


def toc_links(pages: DataFrame, href: str = TOC_HREF, text: str = TOC_TEXT) -> DataFrame:
    """page_id, url of the first link of the same origin, not to the page itself, that looks like a table of contents."""
    links = anchors(html_nodes(pages)).join(pages.select("page_id", F.col("url").alias("own")), "page_id")
    good = links.where((F.col("href").rlike(href) | F.col("label").rlike(text)) & (_origin(F.col("href")) == _origin(F.col("own"))) & (F.col("href") != F.col("own")) & U.is_public_url(F.col("href")))
    return good.groupBy("page_id").agg(F.min_by("href", "at").alias("url"))
