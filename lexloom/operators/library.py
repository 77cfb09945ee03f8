"""Library queries: filters, facets, details, order, pages, chapters, progress and activity."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import urls as U
from ..plans.scratch import materialize


# The states of a novel that a filter may name.
STATUSES = ("ONGOING", "COMPLETED")


@dataclass
class BrowseQuery:
    """A normalised request: unknown sorts are newest first, unknown states and blank or odd values no filter, pages begin at 1."""

    q: str = ""
    source: str | None = None
    status: str | None = None
    author: str | None = None
    added_by: int | None = None
    tags: list[str] = field(default_factory=list)
    sort: str = "newest"
    page: int = 1
    size: int = 24

    @classmethod
    def parse(cls, given: dict, statuses: tuple[str, ...] = STATUSES) -> BrowseQuery:
        sort = given.get("sort", "newest")
        page, added = str(given.get("page", "1")).strip(), str(given.get("addedBy", "")).strip()
        said = lambda k: str(given.get(k) or "").strip() or None
        return cls(
            q=str(given.get("q", "")).strip(),
            source=said("source"),
            status=given.get("status") if given.get("status") in statuses else None,
            author=said("author"),
            added_by=int(added) if added.isdigit() and int(added) > 0 else None,
            sort=sort if sort in ("newest", "title", "chapters") else "newest",
            tags=[t.strip() for t in str(given.get("tags", "")).split(",") if t.strip()],
            page=max(1, int(page)) if page.isdigit() else 1,
        )


def matches(q: str, columns: list[str]) -> Column:
    out = F.lit(False)
    for c in columns:
        out = out | F.contains(F.lower(F.coalesce(F.col(c), F.lit(""))), F.lit(q.lower()))
    return out


def with_any_tag(rows: DataFrame, bridge: DataFrame, tags: DataFrame, slugs: list[str], key: str) -> DataFrame:
    wanted = bridge.join(tags.where(F.col("slug").isin(slugs)), "tag_id").select(key).distinct()
    return rows.join(wanted, key, "left_semi") if slugs else rows


def browse(novels: DataFrame, query: BrowseQuery, bridge: DataFrame | None = None, tags: DataFrame | None = None, key: str = "novel_id") -> DataFrame:
    """Novels that pass every filter of the query.

    novels: title, description, original_title, original_description, source_url, completion_status, author, added_by.
    """
    rows = novels
    if query.q:
        rows = rows.where(matches(query.q, ["title", "description", "original_title", "original_description"]))
    if query.source:
        rows = rows.where(F.col("source_url").startswith(f"https://{query.source}/"))
    if query.status:
        rows = rows.where(F.col("completion_status") == query.status)
    if query.author:
        rows = rows.where(F.lower("author") == query.author.lower())
    if query.added_by:
        rows = rows.where(F.col("added_by") == query.added_by)
    return with_any_tag(rows, bridge, tags, query.tags, key) if query.tags else rows


def child_counts(parents: DataFrame, children: DataFrame, key: str, name: str) -> DataFrame:
    counts = children.groupBy(key).agg(F.count("*").alias(name))
    return parents.join(counts, key, "left").withColumn(name, F.coalesce(name, F.lit(0)))


def page(rows: DataFrame, order: list, n: int, size: int) -> DataFrame:
    return rows.orderBy(*order).offset((n - 1) * size).limit(size)


def page_info(rows: DataFrame, size: int) -> DataFrame:
    return rows.agg(F.count("*").alias("total")).select("total", F.greatest(F.lit(1), F.ceil(F.col("total") / size)).cast("long").alias("pages"))


def source_facets(rows: DataFrame, url: str) -> DataFrame:
    return rows.select(U.host(F.col(url)).alias("host")).where("host IS NOT NULL").groupBy("host").agg(F.count("*").alias("n"))


def number_appended(new: DataFrame, stored: DataFrame, parent: str, number: str, order: list[str]) -> DataFrame:
    """Numbers after the stored maximum, in order."""
    top = stored.groupBy(parent).agg(F.max(number).alias("_top"))
    at = F.row_number().over(Window.partitionBy(parent).orderBy(*order))
    return new.withColumn("_at", at).join(top, parent, "left").withColumn(number, (F.coalesce("_top", F.lit(0)) + F.col("_at")).cast("long")).drop("_top", "_at")


def delete_and_renumber(rows: DataFrame, deleted: DataFrame, parent: str, number: str) -> DataFrame:
    """Delete rows and shift later ones of the parent down."""
    gone = deleted.select(parent, number).distinct().withColumn("_gone", F.lit(1))
    below = F.sum(F.coalesce("_gone", F.lit(0))).over(Window.partitionBy(parent).orderBy(number).rowsBetween(Window.unboundedPreceding, 0))
    marked = rows.join(gone, [parent, number], "left").withColumn("_below", below)
    return marked.where("_gone IS NULL").withColumn(number, (F.col(number) - F.col("_below")).cast("long")).drop("_gone", "_below")


def neighbours(rows: DataFrame, parent: str, number: str) -> DataFrame:
    """Previous number, and the next one where it is at most the count of rows."""
    w = Window.partitionBy(parent)
    n = F.count("*").over(w)
    prev = F.when(F.col(number) > 1, F.col(number) - 1)
    return rows.withColumn("prev", prev.cast("long")).withColumn("next", F.when(F.col(number) < n, F.col(number) + 1).cast("long"))


def latest(events: DataFrame, keys: list[str], value: str, order: list[str]) -> DataFrame:
    return events.groupBy(*keys).agg(F.max(F.struct(*order, value)).alias("_b")).select(*keys, F.col(f"_b.{value}").alias(value), F.col(f"_b.{order[0]}").alias(order[0]))


def top_per(rows: DataFrame, by: list[str], order: list, k: int, name: str = "rank") -> DataFrame:
    return rows.withColumn(name, F.row_number().over(Window.partitionBy(*by).orderBy(*order)).cast("long")).where(F.col(name) <= k)


def sync_progress(local: DataFrame, server: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Local rows that the server lacks, or that are strictly further along."""
    there = server.select(*keys, F.col(value).alias("_there"))
    return local.join(there, keys, "left").where(F.col("_there").isNull() | (F.col(value) > F.col("_there"))).drop("_there")


def rate_limit(events: DataFrame, keys: list[str], size_s: int, most: int, ts: str = "ts", tie: str = "event_id") -> DataFrame:
    """A verdict for each event in fixed windows: window_start, hit (running count), denied, retry_after seconds."""
    sec = F.unix_micros(F.col(ts).cast("timestamp")) / 1_000_000
    start = (F.floor(sec / size_s) * size_s).cast("long")
    w = Window.partitionBy(*keys, "window_start").orderBy(ts, tie)
    out = events.withColumn("window_start", start).withColumn("hit", F.row_number().over(w).cast("long"))
    retry = F.greatest(F.lit(1), F.ceil(F.col("window_start") + size_s - sec)).cast("long")
    return out.withColumn("denied", F.col("hit") > most).withColumn("retry_after", F.when(F.col("hit") > most, retry))


def rate_windows(events: DataFrame, keys: list[str], size_s: int, most: int, ts: str = "ts") -> DataFrame:
    start = (F.floor(F.unix_micros(F.col(ts).cast("timestamp")) / 1_000_000 / size_s) * size_s).cast("long")
    out = events.groupBy(*keys, start.alias("window_start")).agg(F.count("*").alias("hits"))
    return out.withColumn("n_denied", F.greatest(F.lit(0), F.col("hits") - most).cast("long"))


def duplicate_keys(rows: DataFrame, keys: list[str]) -> DataFrame:
    return rows.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def _free_suffixes(new: DataFrame, taken: DataFrame, base: str, order: list[str]) -> DataFrame:
    """Each base's rows, in order, get its free names: base, base-2, base-3 ..."""
    rows = new.withColumn("_k", F.row_number().over(Window.partitionBy(base).orderBy(*order)))
    need = rows.groupBy(base).agg(F.max("_k").alias("_n"))
    split = F.regexp_extract("slug", r"^(.*)-([0-9]+)$", 1)
    own = taken.select(F.col("slug").alias(base), F.lit(1).alias("_at"))
    numbered = taken.select(split.alias(base), F.regexp_extract("slug", r"^(.*)-([0-9]+)$", 2).try_cast("int").alias("_at")).where(F.col("_at") > 1)
    used = own.unionByName(numbered.where(F.col("_at").isNotNull())).distinct().join(need.select(base), base, "left_semi")
    limit = need.join(used.groupBy(base).agg(F.count("*").alias("_u")), base, "left").withColumn("_n", F.col("_n") + F.coalesce("_u", F.lit(0)))
    free = limit.select(base, F.explode(F.sequence(F.lit(1), F.col("_n").cast("int"))).alias("_at")).join(used, [base, "_at"], "left_anti")
    free = free.withColumn("_k", F.row_number().over(Window.partitionBy(base).orderBy("_at")))
    name = F.when(F.col("_at") == 1, F.col(base)).otherwise(F.concat(base, F.lit("-"), "_at"))
    return rows.join(free, [base, "_k"]).withColumn("slug", name).drop("_k", "_at")


def assign_slugs(new: DataFrame, taken: DataFrame, base: str, order: list[str]) -> DataFrame:
    """Adds a unique `slug`: the base, or the first free of base-2, base-3 ...

    Where a numbered name is itself the base of another new row, the earlier row keeps it; the others try
    again against all names given so far.  Each round settles a row of every clash, so few are needed.
    """
    done = None
    while True:
        given = materialize(_free_suffixes(new, taken, base, order), "slugs")
        rank = F.row_number().over(Window.partitionBy("slug").orderBy(*order))
        ranked = given.withColumn("_r", rank)
        won = ranked.where("_r = 1").drop("_r")
        done = won if done is None else done.unionByName(won)
        lost = ranked.where("_r > 1").drop("_r", "slug")
        if lost.isEmpty():
            return done
        new, taken = lost, taken.select("slug").unionByName(won.select("slug"))


def cascade_delete(parents: DataFrame, deleted: DataFrame, key: str, cascade: dict, unset: dict) -> tuple[DataFrame, dict, dict]:
    """Parents and children without the deleted ids.  cascade and unset map a name to (table, its column): rows go, or the column becomes null."""
    gone = deleted.select(F.col(key).alias("_gone")).distinct()
    cut = {name: t.join(gone, F.col(c) == F.col("_gone"), "left_anti") for name, (t, c) in cascade.items()}
    loose = {}
    for name, (t, c) in unset.items():
        loose[name] = t.join(gone, F.col(c) == F.col("_gone"), "left").withColumn(c, F.when(F.col("_gone").isNull(), F.col(c))).drop("_gone")
    return parents.join(gone, F.col(key) == F.col("_gone"), "left_anti"), cut, loose


def orphans(child: DataFrame, parent: DataFrame, child_key: str, parent_key: str) -> DataFrame:
    return child.where(F.col(child_key).isNotNull()).join(parent.select(F.col(parent_key).alias(child_key)), child_key, "left_anti")


def browse_order(sort: str, ident: str, created: str, title: str, count: str) -> list[Column]:
    """Newest first, by title, or by most chapters; the id settles ties."""
    first = {"title": F.asc(title), "chapters": F.desc(count)}.get(sort, F.desc(created))
    return [first, F.asc(ident)]


def related_entries(entries: DataFrame, q: str, k: int = 8) -> DataFrame:
    """entries: id, phrase, track, is_active.  Active ones that contain q: names before phrases, the longest first, k in all."""
    hits = entries.where(F.col("is_active") & F.contains(F.col("phrase"), F.lit(q)))
    return hits.orderBy(F.when(F.col("track") == "name", 0).otherwise(1), F.desc(F.length("phrase")), "id").limit(k)


def list_recent(entries: DataFrame, q: str, k: int, updated: str, ident: str, columns: list[str]) -> DataFrame:
    """The k last changed entries that contain q."""
    return entries.where(matches(q, columns) if q else F.lit(True)).orderBy(F.desc(updated), F.desc(ident)).limit(k)


def library_preview(rows: DataFrame, created: str, ident: str, k: int = 8) -> DataFrame:
    """The k newest rows and the `total` of all."""
    return rows.orderBy(F.desc(created), F.desc(ident)).limit(k).crossJoin(F.broadcast(rows.agg(F.count("*").alias("total"))))


def tag_choices(tags: DataFrame, q: str = "", exclude: DataFrame | None = None, k: int = 30) -> DataFrame:
    """tags: tag_id, category, name.  By category and name, those that contain q and aren't excluded."""
    rows = tags.where(matches(q, ["name"])) if q else tags
    rows = rows if exclude is None else rows.join(exclude.select("tag_id"), "tag_id", "left_anti")
    return rows.orderBy("category", "name", "tag_id").limit(k)


def with_children(parents: DataFrame, children: DataFrame, key: str, order: list[str], columns: list[str], name: str) -> DataFrame:
    """parents and an ordered array of their children's columns; empty where there are none."""
    item = F.struct(*order, *[c for c in columns if c not in order])
    gathered = children.groupBy(key).agg(F.sort_array(F.collect_list(item)).alias(name))
    out = parents.join(gathered, key, "left")
    return out.withColumn(name, F.coalesce(name, F.array().cast(gathered.schema[name].dataType)))


def rate_limit_by_policy(events: DataFrame, policies: DataFrame, keys: list[str], bucket: str = "bucket", ts: str = "ts", tie: str = "event_id") -> DataFrame:
    """Verdicts where each bucket has a size and a most of its own (policies: bucket, size_s, most; a small table by design)."""
    sec = F.unix_micros(F.col(ts).cast("timestamp")) / 1_000_000
    rows = events.join(F.broadcast(policies), bucket)
    rows = rows.withColumn("window_start", (F.floor(sec / F.col("size_s")) * F.col("size_s")).cast("long"))
    hit = F.row_number().over(Window.partitionBy(bucket, *keys, "window_start").orderBy(ts, tie)).cast("long")
    return rows.withColumn("hit", hit).withColumn("denied", F.col("hit") > F.col("most"))


def upsert_tags(base: DataFrame, new: DataFrame) -> DataFrame:
    """base and new: slug, name, category.  New rows replace those of their slug; the last by name where a slug is repeated."""
    last = new.groupBy("slug").agg(F.max(F.struct("name", "category")).alias("_n")).select("slug", "_n.name", "_n.category")
    return last.unionByName(base.join(last, "slug", "left_anti").select("slug", "name", "category"))


def attach_once(bridge: DataFrame, new: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Rows that aren't attached yet, the first adder of each; those that are stay as they are."""
    first = new.withColumn("_k", F.row_number().over(Window.partitionBy(*keys).orderBy(order))).where("_k = 1").drop("_k")
    return bridge.unionByName(first.join(bridge.select(*keys), keys, "left_anti").select(bridge.columns))


def upsert_progress(base: DataFrame, events: DataFrame, keys: list[str], number: str = "chapter_number", order: tuple[str, ...] = ("ts", "event_id")) -> DataFrame:
    """base: keys, number.  The last event of each key wins, though it goes back; numbers that aren't positive integers are no events."""
    good = events.withColumn("_n", F.col(number).try_cast("double")).where("_n >= 1 AND _n = floor(_n)")
    last = good.groupBy(*keys).agg(F.max(F.struct(*order, F.col("_n").cast("long").alias("_n"))).alias("_e")).select(*keys, F.col("_e._n").alias(number))
    return last.unionByName(base.join(last, keys, "left_anti").select(*keys, F.col(number).cast("long").alias(number)))


AUDIT = "user_id string, action string, target_type string, target_id string, metadata string"


def audit_rows(rows: DataFrame, action: str, user: Column, target_type: str | None = None, target_id: Column | None = None, details: list[str] = ()) -> DataFrame:
    """Audit rows of what happened (AUDIT); details become the metadata, a JSON object."""
    none = F.lit(None).cast("string")
    meta = F.to_json(F.struct(*details)) if details else none
    return rows.select(user.cast("string").alias("user_id"), F.lit(action).alias("action"), F.lit(target_type).cast("string").alias("target_type"), (none if target_id is None else target_id.cast("string")).alias("target_id"), meta.alias("metadata"))


def append_audit(rows: DataFrame, path: str) -> None:
    """Add rows to the stored audit."""
    rows.write.mode("append").parquet(path)


def clear_audit(log: DataFrame, by: str) -> DataFrame:
    """The log after it was cleared: one row that tells how many went."""
    return log.agg(F.to_json(F.struct(F.count("*").alias("clearedCount"))).alias("metadata")).select(F.lit(by).alias("user_id"), F.lit("activity.clear").alias("action"), "metadata")


# The pages of a site map, with change frequency and priority.
SITE_PAGES = (("", "daily", 1.0), ("/search", "daily", 0.8), ("/surf", "weekly", 0.5), ("/surf/discover", "weekly", 0.5), ("/translate", "monthly", 0.5))


def export_urls(novels: DataFrame, base: str, slug: str, created: str) -> DataFrame:
    """Rows of a site map: the fixed pages, and one for each novel."""
    pages = novels.sparkSession.createDataFrame([(base + p, None, f, w) for p, f, w in SITE_PAGES], "url string, modified timestamp, frequency string, priority double")
    rows = novels.select(F.concat(F.lit(base + "/novels/"), F.col(slug)).alias("url"), F.col(created).cast("timestamp").alias("modified"), F.lit("weekly").alias("frequency"), F.lit(0.7).alias("priority"))
    return pages.unionByName(rows)
