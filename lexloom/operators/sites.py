"""Site rules and page jobs: metadata, records, chapter lists with one hop, page text, books taken in.

Rules are a table, so a site is added by rows.  hosts: ord, site, host, subdomains (whether they belong to the site), skip (pattern
of addresses without a list, or null).  rules: site, field, path (pattern on a node's path of `tag.class.class` steps),
href (pattern on its address, or null), take (`text`, `href`, `src` or `tip`).
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as X
from ..functions import urls as U
from ..plans.scratch import materialize
from . import chapters as C
from . import corpus as J
from . import library as B
from . import match as M
from . import pages as P

META = ("title", "description", "cover", "author")
# Elements whose text isn't shown.
HIDDEN = ("script", "style", "noscript", "svg", "textarea")
RULES = "site string, field string, path string, href string, take string"
HOSTS = "ord int, site string, host string, subdomains boolean, skip string"


def page_sites(pages: DataFrame, hosts: DataFrame) -> DataFrame:
    """page_id, site, skip: the first site that the page's host, or a domain above it, belongs to."""
    labels = F.split(U.host(F.col("url")), r"\.")
    above = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    tails = pages.where(F.size(labels) > 0).select("page_id", F.posexplode(above).alias("up", "host"))
    hit = tails.join(hosts, "host").where((F.col("up") == 0) | F.col("subdomains"))
    return hit.groupBy("page_id").agg(F.min(F.struct("ord", "site", "skip")).alias("b")).select("page_id", "b.site", "b.skip")


def rule_hits(nodes: DataFrame, sites: DataFrame, rules: DataFrame, max_rules: int = 10_000) -> DataFrame:
    """page_id, field, node, last, href, value of every element that a rule of the page's site names; blank values are null."""
    if rules.count() > max_rules:
        raise ValueError("too many rules for a broadcast")
    named = nodes.where("tag <> '#text'").join(sites.select("page_id", "site"), "page_id")
    r = F.broadcast(rules.select("site", "field", F.col("path").alias("_path"), F.col("href").alias("_href"), "take"))
    hits = named.join(r, "site").where(F.rlike("path", F.col("_path")) & (F.col("_href").isNull() | F.coalesce(F.rlike("href", F.col("_href")), F.lit(False))))
    hits = hits.select("page_id", "field", "node", "last", "href", "take", "src", "tip")
    own = hits.where("take IN ('text', 'tip')").select("page_id", F.col("node").alias("top"))
    texts = P.span_texts(nodes, own, breaks=True).select("page_id", F.col("top").alias("node"), X.trim_all(F.col("text")).alias("t"))
    value = F.when(F.col("take") == "href", F.col("href")).when(F.col("take") == "src", F.col("src")).when(F.col("take") == "tip", F.coalesce(F.nullif(X.trim_all(F.col("tip")), F.lit("")), F.col("t"))).otherwise(F.col("t"))
    return hits.join(texts, ["page_id", "node"], "left").select("page_id", "field", "node", "last", "href", F.nullif(value, F.lit("")).alias("value"))


def _firsts(hits: DataFrame, by: list[str], fields: tuple[str, ...]) -> DataFrame:
    """The value of the first element of each field."""
    return hits.groupBy(*by).agg(*[F.min(F.when(F.col("field") == f, F.struct("node", "value"))).alias(f) for f in fields]).select(*by, *[F.col(f"{f}.value").alias(f) for f in fields])


def book_meta(pages: DataFrame, hosts: DataFrame, rules: DataFrame) -> DataFrame:
    """page_id, title, description, cover, author: by the rules of a site that has some for these, else from the page's own meta elements."""
    mine = rules.where(F.col("field").isin(*META))
    sites = page_sites(pages, hosts).join(mine.select("site").distinct(), "site", "left_semi")
    nodes = P.html_nodes(pages.join(sites, "page_id", "left_semi"), paths=True)
    by_rule = sites.select("page_id").join(_firsts(rule_hits(nodes, sites, mine), ["page_id"], META), "page_id", "left")
    rest = pages.join(sites, "page_id", "left_anti")
    return by_rule.unionByName(rest.select("page_id", *[c.alias(f) for f, c in U.meta_fields(F.col("html")).items()]))


def records(pages: DataFrame, hosts: DataFrame, rules: DataFrame, fields: tuple[str, ...] = ("url", *META)) -> DataFrame:
    """page_id, node, fields of each `item` on list pages; those without title or url go, the first of an address stays."""
    sites, nodes = page_sites(pages, hosts), P.html_nodes(pages, paths=True)
    hits = rule_hits(nodes, sites, rules.where(F.col("field").isin("item", *fields)))
    items = hits.where("field = 'item'").select("page_id", F.col("node").alias("item"), F.col("last").alias("to"))
    rows = _firsts(hits.join(items, "page_id").where("node > item AND node <= to"), ["page_id", "item"], fields)
    once = Window.partitionBy("page_id", "url").orderBy("item")
    good = rows.where("url IS NOT NULL AND title IS NOT NULL").withColumn("_k", F.row_number().over(once))
    return good.where("_k = 1").drop("_k").withColumnRenamed("item", "node")


def chapters_by(extract: Callable[[str, str], Iterable[tuple[str, str]]]):
    """A table function for a site that rules can't describe: `extract` takes a page's address and HTML and gives (title, address) in order."""

    @F.udtf(returnType="number bigint, title string, url string")
    class Chapters:
        def eval(self, url: str, html: str):
            if html is not None:
                for k, (title, link) in enumerate(extract(url, html), 1):
                    yield k, title, link

    return Chapters


class Adapter(NamedTuple):
    """What a site does in its own way: a table function for its chapter lists (`chapters_by`), and what is done to its HTML before (a column function)."""

    chapters: Callable
    preprocess: Callable[[Column], Column] = lambda html: html


def site_chapters(pages: DataFrame, hosts: DataFrame, rules: DataFrame, adapters: dict[str, Adapter] | None = None) -> DataFrame:
    """page_id, number, title, url: links that a site's adapter finds, or that its `chapter` rules name, over all its containers; elsewhere the generic list; none where the site skips."""
    if adapters:
        sites = page_sites(pages, hosts)
        skipped = pages.join(sites, "page_id").where(F.rlike("url", F.col("skip"))).select("page_id")
        own = sites.where(F.col("site").isin(*adapters))
        out = site_chapters(pages.join(own, "page_id", "left_anti"), hosts, rules)
        for site, adapter in adapters.items():
            html = pages.join(own.where(F.col("site") == site), "page_id", "left_semi").join(skipped, "page_id", "left_anti").select("page_id", F.col("url").alias("_url"), adapter.preprocess(F.col("html")).alias("_html"))
            found = html.lateralJoin(adapter.chapters(F.col("_url").outer(), F.col("_html").outer()))
            out = out.unionByName(found.select("page_id", "number", "title", "url"))
        return out
    sites, mine = page_sites(pages, hosts), rules.where("field = 'chapter'")
    skipped = pages.join(sites, "page_id").where(F.rlike("url", F.col("skip"))).select("page_id")
    ruled = sites.join(mine.select("site").distinct(), "site", "left_semi")
    open_pages = pages.join(skipped, "page_id", "left_anti")
    nodes = P.html_nodes(open_pages.join(ruled, "page_id", "left_semi"), paths=True)
    links = rule_hits(nodes, ruled, mine).where("href <> '' AND value IS NOT NULL")
    once = links.groupBy("page_id", F.col("href").alias("url")).agg(F.min(F.struct("node", "value")).alias("x"))
    number = F.row_number().over(Window.partitionBy("page_id").orderBy("x.node")).cast("long")
    listed = once.select("page_id", number.alias("number"), F.col("x.value").alias("title"), "url")
    return listed.unionByName(P.chapter_links(open_pages.join(ruled, "page_id", "left_anti")))


def follow_toc(pages: DataFrame, lists: DataFrame) -> DataFrame:
    """page_id, number, title, url: a page's own list, or else that of the page its link to a table of contents leads to (one hop)."""
    bare = pages.join(lists.select("page_id").distinct(), "page_id", "left_anti")
    target = pages.groupBy("url").agg(F.min("page_id").alias("_to"))
    hop = P.toc_links(bare).join(target, "url").select("page_id", "_to")
    more = lists.withColumnRenamed("page_id", "_to").join(hop, "_to").select("page_id", "number", "title", "url")
    return lists.select("page_id", "number", "title", "url").unionByName(more)


def translate_pages(pages: DataFrame, lexicon: DataFrame, readings: DataFrame, layers: DataFrame | None = None) -> DataFrame:
    """page_id, node, text, translated of every shown piece of text that isn't blank."""
    shown = P.html_nodes(pages, HIDDEN).where("tag = '#text'").select("page_id", "node", "text").where(X.trim_all(F.col("text")) != "")
    return M.translate_text(shown, lexicon, readings, layers)


def translate_listing(found: DataFrame, lexicon: DataFrame, readings: DataFrame, columns: tuple[str, ...] = ("title", "description")) -> DataFrame:
    """Records and `<column>_translated` for each of the columns; nulls stay."""
    out = found
    for c in columns:
        done = M.translate_text(out.withColumn("text", F.col(c)), lexicon, readings)
        out = done.withColumn(f"{c}_translated", F.when(F.col(c).isNotNull(), F.col("translated"))).drop("text", "translated")
    return out


def chapter_content(pages: DataFrame, hosts: DataFrame, rules: DataFrame, patterns: DataFrame, cls: str = X.HAN) -> DataFrame:
    """page_id, title, text: the prose without markup and blacklisted lines; pages without any go.  A site's `chapter_title` rule comes before the generic title."""
    mine = rules.where("field = 'chapter_title'")
    sites = page_sites(pages, hosts).join(mine.select("site").distinct(), "site", "left_semi")
    own = _firsts(rule_hits(P.html_nodes(pages.join(sites, "page_id", "left_semi"), paths=True), sites, mine), ["page_id"], ("chapter_title",))
    content = P.page_content(pages, cls).select("page_id", "title", F.posexplode(F.split(X.sanitize(F.col("text")), "\n")).alias("line", "text"))
    kept = C.drop_blacklisted(content, patterns).groupBy("page_id").agg(F.max("title").alias("title"), F.sort_array(F.collect_list(F.struct("line", "text"))).alias("x"))
    body = kept.select("page_id", "title", F.array_join(F.transform("x", lambda x: x["text"]), "\n").alias("text")).where(X.trim_all(F.col("text")) != "")
    return body.join(own, "page_id", "left").select("page_id", F.coalesce("chapter_title", "title").alias("title"), "text")


def ingest_books(pages: DataFrame, stored: DataFrame, hosts: DataFrame, rules: DataFrame, lexicon: DataFrame, readings: DataFrame, overrides: DataFrame, cls: str = X.HAN) -> tuple[DataFrame, DataFrame]:
    """Books and chapters to store from landing pages whose address no stored novel (source_url, slug) has.

    Books: page_id, source_url, slug, title, description, cover, author, original_title.  Chapters: page_id, chapter_number,
    url, original_title, title, status.  Titles are translated with the global layer; books that the gate refuses or without chapters go.
    """
    new = pages.join(stored.select(F.col("source_url").alias("url")).distinct(), "url", "left_anti")
    lists = materialize(site_chapters(pages, hosts, rules), "lists")
    listed = materialize(follow_toc(pages, lists).join(new.select("page_id"), "page_id", "left_semi"), "listed")
    meta = materialize(book_meta(new, hosts, rules).join(listed.select("page_id").distinct(), "page_id", "left_semi"), "meta")
    clean = [X.sanitize(F.col(c)).alias(c) for c in ("title", "description")]
    gate = J.validate_book(meta.select(F.col("page_id").alias("book_id"), *clean, "cover", "author"), listed.select(F.col("page_id").alias("book_id"), F.col("number").alias("chapter_number"), "title"), cls)
    good = gate.where("reason IS NULL").drop("reason").withColumnRenamed("book_id", "page_id")
    based = materialize(good.join(new.select("page_id", F.col("url").alias("source_url")), "page_id").withColumn("base", U.slug_from_url(F.col("source_url"))), "based")
    full, _ = J.scoped_lexicon(lexicon, overrides)
    slugged = B.assign_slugs(based, stored.select("slug"), "base", ["page_id"]).drop("base").withColumn("original_title", F.col("title"))
    books = M.translate_text(slugged.withColumn("text", F.col("title")), full, readings).drop("text", "title").withColumnRenamed("translated", "title")
    titles = listed.join(slugged.select("page_id"), "page_id", "left_semi").withColumn("text", X.sanitize(F.col("title")))
    done = M.translate_text(titles, full, readings)
    return books, done.select("page_id", F.col("number").alias("chapter_number"), "url", F.col("text").alias("original_title"), F.col("translated").alias("title"), F.lit("PENDING").alias("status"))


def reslug(novels: DataFrame, key: str = "novel_id") -> DataFrame:
    """novels: key, slug, source_url.  Slugs of the address anew; rows whose slug is already that, or a numbered form of it, keep theirs."""
    base = U.slug_from_url(F.col("source_url"))
    rest = F.substring("slug", F.length(base) + 1, F.length("slug"))
    fits = F.coalesce(F.startswith("slug", base) & rest.rlike(r"^(-\d+)?$"), F.lit(False))
    rows = novels.withColumn("base", base).withColumn("_keep", fits | F.col("base").isNull())
    stays = rows.where("_keep").drop("_keep", "base")
    moved = B.assign_slugs(rows.where("NOT _keep").drop("_keep", "slug"), stays.select("slug"), "base", [key]).drop("base")
    return stays.unionByName(moved.select(stays.columns))


def user_overrides(words: DataFrame, names: DataFrame, novels: DataFrame) -> DataFrame:
    """slug, phrase, value, cap, track, updated_at of one reader's or all readers' entries on both tracks."""
    both = words.withColumn("track", F.lit("phrase")).unionByName(names.withColumn("track", F.lit("name")))
    return both.join(novels.select("novel_id", "slug"), "novel_id").drop("novel_id")


def overlay_personal(lines: DataFrame, entries: DataFrame, keys: list[str], scope: str = "novel_id", max_entries: int = 3_000_000) -> DataFrame:
    """Lay a reader's entries over finished tokens: a run of whole tokens whose text is a phrase becomes one `name` token.

    lines: keys, scope, tokens (pos, len, src, dst, source, reading).  entries: scope, phrase, value, cap, ord.  The longest phrase comes
    first, then the smaller `ord`, then the earlier place; readings are joined by blanks.  Lines without tokens keep theirs.

    Entries reach the lines as those of a lexicon do (match.py), so a line's tokens stay in its row; more than `max_entries` are joined.
    """
    missing = [c for c in (*keys, scope, "tokens") if c not in lines.columns]
    if missing:
        raise ValueError(f"lines have no {', '.join(missing)}")
    best = entries.where(F.col("phrase").isNotNull() & (F.col("phrase") != "") & F.col(scope).isNotNull()).groupBy(F.col(scope).cast("string").alias("scope"), "phrase").agg(F.min(F.struct(F.col("ord").cast("long").alias("ord"), "value", "cap")).alias("b"))
    sent = best.select("scope", "phrase", F.col("b.ord").cast("string").alias("kind"), "b.value", "b.cap")  # a phrase's order is its kind here
    return M.laid_over(lines, sent, scope, max_entries)
