"""Registered queries of library listings, edits, limits and streams, and their SQL twins for DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import queries as Q
from .functions import text as X
from .functions import urls as U
from .operators import corpus as J
from .operators import library as B
from .operators import overrides as O
from .sources.tables import table
from .streaming import live as S


def browse_sorts(spark: SparkSession, sf: str) -> DataFrame:
    """The first page of each order."""
    counted = B.child_counts(table(spark, sf, "customer").select("c_custkey", "c_name", "c_acctbal"), table(spark, sf, "orders").withColumnRenamed("o_custkey", "c_custkey"), "c_custkey", "n_orders")
    out = None
    for sort in ("newest", "title", "chapters"):
        one = B.page(counted, B.browse_order(sort, "c_custkey", "c_acctbal", "c_name", "n_orders"), 1, 24).withColumn("sort", F.lit(sort))
        out = one if out is None else out.unionByName(one)
    return out


_SORTS = """WITH c AS (SELECT c_custkey, c_name, c_acctbal, (SELECT count(*) FROM orders WHERE o_custkey = c_custkey) AS n_orders FROM customer)
(SELECT *, 'newest' AS sort FROM c ORDER BY c_acctbal DESC, c_custkey LIMIT 24) UNION ALL (SELECT *, 'title' FROM c ORDER BY c_name, c_custkey LIMIT 24) UNION ALL (SELECT *, 'chapters' FROM c ORDER BY n_orders DESC, c_custkey LIMIT 24)"""


def related_entries(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "part").select(F.col("p_partkey").alias("id"), F.col("p_type").alias("phrase"), F.when(F.col("p_size") % 2 == 0, "name").otherwise("phrase").alias("track"), (F.col("p_size") % 3 > 0).alias("is_active"))
    return B.related_entries(rows, "A")


_RELATED = """SELECT p_partkey AS id, p_type AS phrase, CASE WHEN p_size % 2 = 0 THEN 'name' ELSE 'phrase' END AS track, TRUE AS is_active FROM part WHERE p_size % 3 > 0 AND contains(p_type, 'A')
ORDER BY p_size % 2, length(p_type) DESC, p_partkey LIMIT 8"""


def list_recent(spark: SparkSession, sf: str) -> DataFrame:
    return B.list_recent(table(spark, sf, "orders").select("o_orderkey", "o_orderdate", "o_orderpriority"), "urg", 100, "o_orderdate", "o_orderkey", ["o_orderpriority"])


_RECENT = "SELECT o_orderkey, o_orderdate, o_orderpriority FROM orders WHERE contains(lower(o_orderpriority), 'urg') ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 100"


def library_preview(spark: SparkSession, sf: str) -> DataFrame:
    return B.library_preview(table(spark, sf, "orders").select("o_orderkey", "o_orderdate"), "o_orderdate", "o_orderkey")


_PREVIEW = "SELECT o_orderkey, o_orderdate, (SELECT count(*) FROM orders) AS total FROM orders ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 8"


def _tags(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "nation").select(F.col("n_nationkey").alias("tag_id"), (F.col("n_regionkey") % 2).alias("category"), F.col("n_name").alias("name"), F.lower("n_name").alias("slug"))


def tag_choices(spark: SparkSession, sf: str) -> DataFrame:
    used = table(spark, sf, "supplier").where("s_suppkey % 7 = 0").select(F.col("s_nationkey").alias("tag_id"))
    return B.tag_choices(_tags(spark, sf), "a", used)


_CHOICES = """SELECT n_nationkey AS tag_id, n_regionkey % 2 AS category, n_name AS name, lower(n_name) AS slug FROM nation WHERE contains(lower(n_name), 'a') AND n_nationkey NOT IN (SELECT s_nationkey FROM supplier WHERE s_suppkey % 7 = 0)
ORDER BY 2, 3, 1 LIMIT 30"""


def tag_filter(spark: SparkSession, sf: str) -> DataFrame:
    bridge = table(spark, sf, "customer").select("c_custkey", F.col("c_nationkey").alias("tag_id"))
    slugs = [f"nation_{k}" for k in (1, 3, 5)] + ["france", "brazil", "china"]
    return B.with_any_tag(table(spark, sf, "customer").select("c_custkey", "c_name"), bridge, _tags(spark, sf), slugs, "c_custkey")


_ANY = "SELECT c_custkey, c_name FROM customer JOIN nation ON n_nationkey = c_nationkey WHERE lower(n_name) IN ('nation_1', 'nation_3', 'nation_5', 'france', 'brazil', 'china')"


def novel_detail(spark: SparkSession, sf: str) -> DataFrame:
    chapters = table(spark, sf, "orders").select(F.col("o_custkey").alias("c_custkey"), F.col("o_orderkey").alias("number"), F.col("o_orderstatus").alias("status"))
    out = B.with_children(table(spark, sf, "customer").select("c_custkey", "c_name"), chapters, "c_custkey", ["number"], ["status"], "toc")
    return out.select("c_custkey", "c_name", F.array_join(F.transform("toc", lambda x: F.concat(x["number"].cast("string"), x["status"])), ",").alias("toc"))


_DETAIL = "SELECT c_custkey, c_name, coalesce(string_agg(o_orderkey || o_orderstatus, ',' ORDER BY o_orderkey), '') AS toc FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1, 2"


def user_progress(spark: SparkSession, sf: str) -> DataFrame:
    last = B.latest(table(spark, sf, "events"), ["user_id"], "value", ["ts", "event_id"])
    return last.join(table(spark, sf, "customer").select(F.col("c_custkey").alias("user_id"), "c_name"), "user_id").select("user_id", "c_name", "value")


_PROGRESS = "SELECT user_id, c_name, arg_max(value, (ts, event_id)) AS value FROM events JOIN customer ON c_custkey = user_id GROUP BY 1, 2"


def page_count(spark: SparkSession, sf: str) -> DataFrame:
    return B.page_info(table(spark, sf, "customer").where("c_acctbal > 0"), 24)


_COUNT = "SELECT count(*) AS total, CAST(greatest(1, ceil(count(*) / 24)) AS BIGINT) AS pages FROM customer WHERE c_acctbal > 0"

#: The limits of each bucket, seconds and requests (other names stand for them in the test events).
POLICIES = [("view", 600, 20), ("click", 600, 30), ("error", 900, 10), ("signup", 900, 5), ("purchase", 900, 5)]


def rate_limit_policies(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "events").select("event_id", "ts", F.col("event_type").alias("bucket"), (F.col("user_id") % 3).alias("client"))
    out = B.rate_limit_by_policy(rows, spark.createDataFrame([(b, s * 240, m) for b, s, m in POLICIES], "bucket string, size_s long, most long"), ["client"])
    return out.select("event_id", "window_start", "hit", "denied")


_POLICIES = f"""WITH p(bucket, size_s, most) AS (VALUES {", ".join(f"('{b}', {s * 240}, {m})" for b, s, m in POLICIES)}),
w AS (SELECT event_id, ts, event_type, user_id % 3 AS client, most, CAST(floor(epoch_us(ts) / 1000000 / size_s) * size_s AS BIGINT) AS window_start FROM events JOIN p ON bucket = event_type),
h AS (SELECT *, row_number() OVER (PARTITION BY event_type, client, window_start ORDER BY ts, event_id) AS hit FROM w) SELECT event_id, window_start, hit, hit > most AS denied FROM h"""

_HOSTS = ["example.com", "localhost", "10.1.2.3", "172.16.9.9", "172.32.0.1", "192.168.0.7", "169.254.1.1", "127.0.0.1", "0.0.0.0", "11.2.3.4", "[::1]", "[fd12::3]", "[2001:db8::1]", "8.8.8.8"]
_PUBLIC = ["example.com", "172.32.0.1", "11.2.3.4", "[2001:db8::1]", "8.8.8.8"]


def public_urls(spark: SparkSession, sf: str) -> DataFrame:
    scheme = F.when(F.col("page_id") % 5 == 0, "ftp").otherwise("https")
    name = F.element_at(F.array(*map(F.lit, _HOSTS)), (F.col("page_id") % len(_HOSTS) + 1).cast("int"))
    return table(spark, sf, "pages").select("page_id", U.is_public_url(F.concat(scheme, F.lit("://"), name, F.lit("/a"))).alias("is_public"))


_URLS = f"SELECT page_id, page_id % 5 <> 0 AND [{', '.join(repr(h) for h in _HOSTS)}][page_id % {len(_HOSTS)} + 1] IN ({', '.join(repr(h) for h in _PUBLIC)}) AS is_public FROM pages"


def title_slugs(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "documents").select("doc_id", F.substring_index("text", ".", 1).alias("title"))
    return rows.select("doc_id", X.slugify(F.col("title")).alias("slug"), F.md5(X.nfc(F.col("title"))).alias("nfc_md5"))


_TITLES = rf"""WITH t AS (SELECT doc_id, split_part(text, '.', 1) AS title FROM documents), s AS (SELECT *, regexp_replace(regexp_replace(lower(array_to_string(list_transform(string_split(title, ''), lambda c: CASE WHEN strip_accents(c) <> c THEN strip_accents(c) || '-' ELSE c END), '')), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') AS slug FROM t)
SELECT doc_id, CASE WHEN slug <> '' THEN slug ELSE 'truyen-' || substr(sha256(title), 1, 8) END AS slug, md5(nfc_normalize({Q._trim("title")})) AS nfc_md5 FROM s"""


def new_by_url(spark: SparkSession, sf: str) -> DataFrame:
    pages = table(spark, sf, "pages").select("page_id", F.pmod("page_id", F.lit(7)).alias("novel_id"), "url")
    stored = pages.where("page_id % 3 = 0").withColumn("url", F.when(F.col("page_id") % 2 == 0, F.col("url")))
    return J.new_rows(pages, stored, ["novel_id", "url"]).select("page_id")


_NEW = "SELECT page_id FROM pages p WHERE NOT EXISTS (SELECT 1 FROM pages s WHERE s.page_id % 6 = 0 AND s.page_id % 7 = p.page_id % 7 AND s.url = p.url)"


def chapters_appended(spark: SparkSession, sf: str) -> DataFrame:
    pages = table(spark, sf, "pages").select(F.pmod("page_id", F.lit(7)).alias("novel_id"), "url", F.col("page_id").alias("at"), F.concat(F.lit("then "), F.col("page_id").cast("string")).alias("title"))
    stored = pages.where("at % 3 = 0").select("novel_id", "url", F.col("at").alias("chapter_number"))
    return J.append_new_chapters(pages, stored, Q._lexicon(spark), Q._readings(spark))


_APPENDED = """WITH p AS (SELECT page_id % 7 AS novel_id, url, page_id AS n FROM pages), s AS (SELECT * FROM p WHERE n % 3 = 0), t AS (SELECT novel_id, max(n) AS top FROM s GROUP BY 1),
f AS (SELECT p.*, row_number() OVER (PARTITION BY p.novel_id ORDER BY n) AS k FROM p WHERE (novel_id, url) NOT IN (SELECT (novel_id, url) FROM s))
SELECT f.novel_id, url, CAST(coalesce(top, 0) + k AS BIGINT) AS chapter_number, 'then ' || n AS original_title, 'Puis   ' || array_to_string(string_split(CAST(n AS VARCHAR), ''), ' ') AS title FROM f LEFT JOIN t ON f.novel_id = t.novel_id"""


def client_keys(spark: SparkSession, sf: str) -> DataFrame:
    u = F.col("user_id").cast("string")
    fwd = F.when(F.col("event_id") % 3 == 0, F.concat(F.lit(" 10.0.0."), u, F.lit(", 1.1.1.1")))
    return table(spark, sf, "events").select("event_id", U.client_key(fwd, F.when(F.col("event_id") % 3 == 1, F.concat(F.lit("9.9.9."), u))).alias("client"))


_CLIENTS = "SELECT event_id, sha256(CASE event_id % 3 WHEN 0 THEN '10.0.0.' || user_id WHEN 1 THEN '9.9.9.' || user_id ELSE 'unknown' END) AS client FROM events"


def key_checks(spark: SparkSession, sf: str) -> DataFrame:
    """Repeated keys, a null scope being one scope, and children without a parent."""
    e = table(spark, sf, "events").select(F.when(F.col("event_id") % 4 > 0, F.col("event_type")).alias("scope"), F.col("user_id").alias("id"))
    twice = B.duplicate_keys(e, ["scope", "id"]).select(F.lit("repeated").alias("fault"), "scope", "id", "n")
    lost = B.orphans(e, table(spark, sf, "customer").where("c_custkey % 5 > 0"), "id", "c_custkey").groupBy("id").agg(F.count("*").alias("n"))
    return twice.unionByName(lost.select(F.lit("orphan").alias("fault"), F.lit(None).cast("string").alias("scope"), "id", "n"))


_CHECKS = """WITH e AS (SELECT CASE WHEN event_id % 4 > 0 THEN event_type END AS scope, user_id AS id FROM events)
SELECT 'repeated' AS fault, scope, id, count(*) AS n FROM e GROUP BY scope, id HAVING count(*) > 1 UNION ALL SELECT 'orphan', NULL, id, count(*) FROM e WHERE id NOT IN (SELECT c_custkey FROM customer WHERE c_custkey % 5 > 0) GROUP BY id"""


def toggle_active(spark: SparkSession, sf: str) -> DataFrame:
    base = table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), (F.col("c_acctbal") > 0).alias("is_active"))
    toggles = table(spark, sf, "events").select(F.col("event_id").alias("seq"), (F.col("user_id") * 3).alias("id"), (F.col("event_id") % 2 == 0).alias("is_active"))
    out, unknown = O.set_active(base, toggles, ["id"])
    return out.select("id", "is_active", F.lit(True).alias("known")).unionByName(unknown.select("id", F.lit(None).cast("boolean").alias("is_active"), F.lit(False).alias("known")).distinct())


_TOGGLE = """WITH t AS (SELECT user_id * 3 AS id, arg_max(event_id % 2 = 0, event_id) AS now FROM events GROUP BY 1)
SELECT c_custkey AS id, coalesce(now, c_acctbal > 0) AS is_active, TRUE AS known FROM customer LEFT JOIN t ON id = c_custkey UNION ALL SELECT id, NULL, FALSE FROM t WHERE id NOT IN (SELECT c_custkey FROM customer)"""


def tags_upserted(spark: SparkSession, sf: str) -> DataFrame:
    base = _tags(spark, sf).select("slug", "name", F.col("category").cast("string").alias("category"))
    new = table(spark, sf, "supplier").select(F.concat(F.lit("nation_"), F.col("s_nationkey").cast("string")).alias("slug"), F.col("s_name").alias("name"), F.lit("new").alias("category"))
    return B.upsert_tags(base, new)


_UPSERTED = """WITH n AS (SELECT 'nation_' || s_nationkey AS slug, max(s_name) AS name, 'new' AS category FROM supplier GROUP BY 1)
SELECT * FROM n UNION ALL SELECT lower(n_name), n_name, CAST(n_regionkey % 2 AS VARCHAR) FROM nation WHERE lower(n_name) NOT IN (SELECT slug FROM n)"""


def chapters_edited(spark: SparkSession, sf: str) -> DataFrame:
    base = table(spark, sf, "documents").select(F.col("doc_id").alias("chapter_id"), "text", F.lit("ZH").alias("language"), F.lit("SCRAPED").alias("status"))
    edits = table(spark, sf, "pages").select(F.pmod("page_id", F.lit(50)).alias("chapter_id"), F.col("page_id").alias("seq"), F.when(F.col("page_id") % 3 > 0, F.concat(F.lit("<b>"), "url", F.lit("</b>"))).alias("text"))
    return J.edit_chapters(base, edits).select("chapter_id", F.md5("text").alias("text_md5"), "language", "status")


_EDITED = """WITH e AS (SELECT page_id % 50 AS chapter_id, max(page_id) AS last FROM pages GROUP BY 1), l AS (SELECT chapter_id, CASE WHEN last % 3 > 0 THEN url END AS new FROM e JOIN pages ON page_id = last)
SELECT doc_id AS chapter_id, CASE WHEN l.chapter_id IS NULL THEN md5(text) ELSE md5(new) END AS text_md5, CASE WHEN new IS NULL THEN 'ZH' ELSE 'VI' END AS language, CASE WHEN l.chapter_id IS NOT NULL AND new IS NULL THEN 'PENDING' ELSE 'SCRAPED' END AS status
FROM documents LEFT JOIN l ON l.chapter_id = doc_id"""


def audit_cleared(spark: SparkSession, sf: str) -> DataFrame:
    return B.clear_audit(table(spark, sf, "events"), "admin").withColumn("deleted", F.get_json_object("metadata", "$.clearedCount").cast("long"))


_CLEARED = """SELECT 'admin' AS user_id, 'activity.clear' AS action, '{"clearedCount":' || count(*) || '}' AS metadata, count(*) AS deleted FROM events"""


def url_export(spark: SparkSession, sf: str) -> DataFrame:
    return B.export_urls(table(spark, sf, "orders").select(F.concat(F.lit("o"), F.col("o_orderkey").cast("string")).alias("slug"), "o_orderdate"), "https://a.test", "slug", "o_orderdate").drop("modified")


_EXPORT = f"""SELECT 'https://a.test/novels/o' || o_orderkey AS url, 'weekly' AS frequency, CAST(0.7 AS DOUBLE) AS priority FROM orders UNION ALL SELECT * FROM (VALUES {", ".join(f"('https://a.test{p}', '{f}', CAST({w} AS DOUBLE))" for p, f, w in B.SITE_PAGES)})"""


def meta_refreshed(spark: SparkSession, sf: str) -> DataFrame:
    novels = table(spark, sf, "part").select(F.col("p_partkey").alias("novel_id"), F.col("p_name").alias("title"), F.col("p_brand").alias("author"), F.col("p_type").alias("cover"), F.col("p_name").alias("description"))
    none = F.lit(None).cast("string")
    meta = table(spark, sf, "part").where("p_partkey % 2 = 0").select(F.col("p_partkey").alias("novel_id"), F.when(F.col("p_size") > 25, "new").alias("title"), none.alias("author"), F.lit("c").alias("cover"), none.alias("description"))
    return J.refresh_meta(novels, meta)


_REFRESHED = """SELECT p_partkey AS novel_id, CASE WHEN p_partkey % 2 = 0 AND p_size > 25 THEN 'new' ELSE p_name END AS title, p_brand AS author, CASE WHEN p_partkey % 2 = 0 THEN 'c' ELSE p_type END AS cover,
CASE WHEN p_partkey % 2 = 1 THEN p_name END AS description FROM part"""


def novels_created(spark: SparkSession, sf: str) -> DataFrame:
    given = table(spark, sf, "part").select(F.col("p_partkey").alias("novel_id"), F.concat(F.lit("<i>"), F.col("p_type"), F.lit("</i>")).alias("title"), F.col("p_brand").alias("description"))
    return J.create_novels(given, spark.createDataFrame([], "slug string")).select("novel_id", "slug", "title", "original_title")


_CREATED = r"""WITH p AS (SELECT p_partkey AS novel_id, p_type AS title, regexp_replace(regexp_replace(lower(p_type), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') AS base FROM part),
k AS (SELECT *, row_number() OVER (PARTITION BY base ORDER BY novel_id) AS k FROM p) SELECT novel_id, CASE WHEN k = 1 THEN base ELSE base || '-' || k END AS slug, title, title AS original_title FROM k"""


def overrides_to_send(spark: SparkSession, sf: str) -> DataFrame:
    """Local entries that the server lacks, by novel and phrase."""
    rows = table(spark, sf, "events").select(F.col("event_type").alias("slug"), F.col("user_id").alias("phrase"), "event_id")
    return J.new_rows(rows.where("event_id % 2 = 0"), rows.where("event_id % 5 = 0"), ["slug", "phrase"])


_SEND = "SELECT event_type AS slug, user_id AS phrase, event_id FROM events WHERE event_id % 2 = 0 AND (event_type, user_id) NOT IN (SELECT (event_type, user_id) FROM events WHERE event_id % 5 = 0)"


#: Requests of a library page; each filter is used by one of them at least.
REQUESTS = [
    {"q": " RED ", "sort": "odd"}, {"source": "host1.test", "page": "x"}, {"status": "COMPLETED", "q": "economy"}, {"status": "NONE", "author": " brand#7 "}, {"addedBy": "3", "tags": "nation_2, nation_4,,"}, {"addedBy": "-1", "q": "ring", "source": "host2.test", "status": "ONGOING"},
]


def library_filters(spark: SparkSession, sf: str) -> DataFrame:
    """Novels that each of the requests finds; parts stand for novels."""
    key = F.col("p_partkey").cast("string")
    novels = table(spark, sf, "part").select(
        F.col("p_partkey").alias("novel_id"), F.upper("p_name").alias("title"), F.col("p_type").alias("description"), F.when(F.col("p_size") % 2 == 0, F.col("p_brand")).alias("original_title"), F.lit(None).cast("string").alias("original_description"),
        F.concat(F.when(F.col("p_size") % 7 == 0, "http").otherwise("https"), F.lit("://host"), (F.col("p_partkey") % 4).cast("string"), F.lit(".test/"), key).alias("source_url"),
        F.when(F.col("p_size") % 3 == 0, "COMPLETED").when(F.col("p_size") % 3 == 1, "ONGOING").alias("completion_status"), F.col("p_brand").alias("author"), (F.col("p_partkey") % 5).alias("added_by"),
    )
    bridge = table(spark, sf, "part").select(F.col("p_partkey").alias("novel_id"), F.explode(F.array(F.col("p_size") % 6, F.col("p_size") % 5)).alias("tag_id"))
    tags = table(spark, sf, "nation").select(F.col("n_nationkey").alias("tag_id"), F.concat(F.lit("nation_"), F.col("n_nationkey").cast("string")).alias("slug"))
    out = None
    for k, given in enumerate(REQUESTS):
        one = B.browse(novels, B.BrowseQuery.parse(given), bridge, tags).select(F.lit(k).alias("request"), "novel_id")
        out = one if out is None else out.unionByName(one)
    return out


_FILTERED = """WITH n AS (SELECT p_partkey AS novel_id, lower(p_name || ' / ' || p_type || CASE WHEN p_size % 2 = 0 THEN ' / ' || p_brand ELSE '' END) AS words, p_size, p_brand,
CASE WHEN p_size % 7 = 0 THEN '' ELSE 'host' || p_partkey % 4 END AS host, p_partkey % 5 AS added_by FROM part)
SELECT 0 AS request, novel_id FROM n WHERE contains(words, 'red') UNION ALL SELECT 1, novel_id FROM n WHERE host = 'host1' UNION ALL SELECT 2, novel_id FROM n WHERE p_size % 3 = 0 AND contains(words, 'economy')
UNION ALL SELECT 3, novel_id FROM n WHERE lower(p_brand) = 'brand#7' UNION ALL SELECT 4, novel_id FROM n WHERE added_by = 3 AND (p_size % 6 IN (2, 4) OR p_size % 5 IN (2, 4))
UNION ALL SELECT 5, novel_id FROM n WHERE contains(words, 'ring') AND host = 'host2' AND p_size % 3 = 1"""


def progress_saved(spark: SparkSession, sf: str) -> DataFrame:
    """The last valid chapter of each user, who may go back; numbers under one and broken ones count as no request."""
    n = F.when(F.col("event_id") % 5 == 0, -3.0).when(F.col("event_id") % 7 == 0, 2.5).when(F.col("event_id") % 11 == 0, 0.0).otherwise(F.ceil("value") + 1)
    events = table(spark, sf, "events").select("user_id", "ts", "event_id", n.alias("chapter_number"))
    base = table(spark, sf, "customer").select(F.col("c_custkey").alias("user_id"), F.lit(1).cast("long").alias("chapter_number"))
    return B.upsert_progress(base, events, ["user_id"])


_SAVED = """WITH e AS (SELECT user_id, ts, event_id, CAST(ceil(value) AS BIGINT) + 1 AS n FROM events WHERE event_id % 5 > 0 AND event_id % 7 > 0 AND event_id % 11 > 0 AND ceil(value) + 1 >= 1),
l AS (SELECT user_id, arg_max(n, (ts, event_id)) AS chapter_number FROM e GROUP BY 1)
SELECT * FROM l UNION ALL SELECT c_custkey, 1 FROM customer WHERE c_custkey NOT IN (SELECT user_id FROM l)"""


def denied_requests(spark: SparkSession, sf: str) -> DataFrame:
    """An audit row for each denied request."""
    out = B.rate_limit(table(spark, sf, "events").select("event_id", "ts", "user_id", "event_type"), ["event_type"], 86_400, 3)
    rows = B.audit_rows(out.where("denied"), "rate_limit.denied", F.col("user_id"), "route", F.concat(F.lit("/api/"), "event_type"), ["event_id", "retry_after"])
    return rows.select("user_id", "action", "target_type", "target_id", "metadata")


_DENIED = f"""SELECT CAST(user_id AS VARCHAR) AS user_id, 'rate_limit.denied' AS action, 'route' AS target_type, '/api/' || event_type AS target_id, '{{"event_id":' || event_id || ',"retry_after":' || retry_after || '}}' AS metadata
FROM (SELECT *, row_number() OVER (PARTITION BY event_type, {Q._WINDOW} ORDER BY ts, event_id) AS hit, CAST(greatest(1, ceil({Q._WINDOW} + 86400 - epoch_us(ts) / 1000000)) AS BIGINT) AS retry_after FROM events) WHERE hit > 3"""


def _stream(spark: SparkSession, sf: str) -> DataFrame:
    return S.read_events(spark, f"{sf}/events.parquet", table(spark, sf, "events").schema)


def stream_views(spark: SparkSession, sf: str) -> DataFrame:
    return S.run_once(S.views(_stream(spark, sf), "event_type"), ["event_type"])


def stream_progress(spark: SparkSession, sf: str) -> DataFrame:
    return S.run_once(S.progress(_stream(spark, sf), ["user_id", "event_type"], "value", ["ts", "event_id"]), ["user_id", "event_type"])


def stream_windows(spark: SparkSession, sf: str) -> DataFrame:
    return S.run_once(S.windows(_stream(spark, sf), Q._KEYS, 86_400, 3), [*Q._KEYS, "window_start"])


def stream_denials(spark: SparkSession, sf: str) -> DataFrame:
    return S.run_once(S.denials(_stream(spark, sf), ["event_type"], 86_400, 3), ["event_type", "window_start"])


_DENIALS = f"SELECT 'rate_limited' AS action, event_type, {Q._WINDOW} AS window_start, CAST(count(*) - 3 AS BIGINT) AS n_denied FROM events GROUP BY ALL HAVING count(*) > 3"


def stream_denied_requests(spark: SparkSession, sf: str) -> DataFrame:
    """An audit row for each denied request, from a stream with a running count."""
    out = S.run_appending(S.denied_requests(_stream(spark, sf), ["event_type"], 86_400, 3))
    ids = table(spark, sf, "events").select("event_id", "user_id")
    return B.audit_rows(out.join(ids, "event_id"), "rate_limit.denied", F.col("user_id"), "route", F.concat(F.lit("/api/"), "event_type"), ["event_id", "retry_after"])


BUILT = {
    "stream_denied_requests": (stream_denied_requests, _DENIED), "library_filters": (library_filters, _FILTERED), "progress_saved": (progress_saved, _SAVED), "denied_requests": (denied_requests, _DENIED),
    "browse_sorts": (browse_sorts, _SORTS), "related_entries": (related_entries, _RELATED), "list_recent": (list_recent, _RECENT), "library_preview": (library_preview, _PREVIEW), "tag_choices": (tag_choices, _CHOICES), "tag_filter": (tag_filter, _ANY),
    "novel_detail": (novel_detail, _DETAIL), "user_progress": (user_progress, _PROGRESS), "page_count": (page_count, _COUNT), "rate_limit_policies": (rate_limit_policies, _POLICIES), "public_urls": (public_urls, _URLS), "title_slugs": (title_slugs, _TITLES),
    "new_by_url": (new_by_url, _NEW), "chapters_appended": (chapters_appended, _APPENDED), "client_keys": (client_keys, _CLIENTS), "key_checks": (key_checks, _CHECKS), "toggle_active": (toggle_active, _TOGGLE), "tags_upserted": (tags_upserted, _UPSERTED),
    "chapters_edited": (chapters_edited, _EDITED), "audit_cleared": (audit_cleared, _CLEARED), "url_export": (url_export, _EXPORT), "meta_refreshed": (meta_refreshed, _REFRESHED), "novels_created": (novels_created, _CREATED), "overrides_to_send": (overrides_to_send, _SEND),
    "stream_views": (stream_views, "SELECT event_type, count(*) AS views FROM events GROUP BY 1"), "stream_progress": (stream_progress, Q._LATEST), "stream_windows": (stream_windows, Q._WINDOWS), "stream_denials": (stream_denials, _DENIALS),
}
