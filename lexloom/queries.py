"""Registered queries of the library's own operators, and their SQL twins for DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import text as X
from .functions import urls as U
from .operators import chapters as C
from .operators import lexicon as L
from .operators import library as B
from .operators import match as M
from .operators import overrides as O
from .operators import pages as P
from .sources.tables import table

#: A small lexicon over syllables that the test texts use: phrase, value, kind, prio.
LEXICON = [
    ("the", "le/la", "word", 4), ("the", "der", "name", 2), ("then", "puis", "word", 4), ("and", "et", "word", 4), ("an", "un", "pronoun", 3),
    ("an", "une", "word", 4), ("ing", "ant", "word", 4), ("tion", "tsion/shun", "word", 4), ("ation", "asion", "name", 2), ("on", "sur", "word", 4),
    ("er", "eur", "word", 4), ("ere", "ici", "override", 1), ("en ", "in ", "word", 4), ("der", "the", "word", 4), ("ent", "ente", "pronoun", 3),
    ("ment", "mente", "word", 4), ("que", "that", "word", 4), ("eau", "water", "name", 2), ("ción", "tion", "word", 4), ("ich", "I", "pronoun", 3), ("sch", "sh", "word", 4), ("ou", "or", "word", 4),
]
READINGS = [("a", "ah"), ("e", "eh"), ("i", "ee"), ("o", "oh"), ("u", "oo"), ("s", "ess"), ("r", "ar"), ("h", "aitch"), ("t", "tee"), ("é", "ey")]


def _lexicon(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(LEXICON, "phrase string, value string, kind string, prio int")


def _readings(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(READINGS, "ch string, readings string")


def _lines(spark: SparkSession, sf: str, *more: str) -> DataFrame:
    docs = table(spark, sf, "documents")
    return M.lines_of(docs).where("text <> ''") if not more else docs.select(*more, F.posexplode(F.split("text", "\n", -1)).alias("line", "text")).where("text <> ''")


def _tokens(spark: SparkSession, sf: str, *more: str, fields: tuple = M.FIELDS) -> DataFrame:
    return M.tokenize(_lines(spark, sf, *more), _lexicon(spark), _readings(spark), fields=fields)


def _sql_list(items) -> str:
    return ", ".join("'" + str(x).replace("'", "''") + "'" for x in items)


_BEST: dict[str, tuple] = {}
for _p, _v, _k, _n in LEXICON:
    if _p not in _BEST or _n < _BEST[_p][2]:
        _BEST[_p] = (_v, "name" if _n == 1 else _k, _n)
_PATTERN = "(?s)" + "|".join(sorted(_BEST, key=lambda p: (-len(p), p))) + "|."
_VALUE = f"MAP {{{', '.join(f'{chr(39)}{p}{chr(39)}: {chr(39)}{v[0]}{chr(39)}' for p, v in _BEST.items())}}}"
_KIND = f"MAP {{{', '.join(f'{chr(39)}{p}{chr(39)}: {chr(39)}{v[1]}{chr(39)}' for p, v in _BEST.items())}}}"
_READ = f"MAP {{{', '.join(f'{chr(39)}{c}{chr(39)}: {chr(39)}{r}{chr(39)}' for c, r in READINGS)}}}"
_LINES = "l AS (SELECT doc_id, lang, i - 1 AS line, ls[i] AS text FROM (SELECT doc_id, lang, string_split(text, chr(10)) AS ls, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS i FROM documents) WHERE ls[i] <> '')"
_TOKS = f"""{_LINES}, t AS (SELECT doc_id, lang, line, unnest(range(1, len(m) + 1)) AS k, unnest(m) AS src FROM (SELECT doc_id, lang, line, regexp_extract_all(text, '{_PATTERN}') AS m FROM l)),
s AS (SELECT *, coalesce({_KIND}[src], CASE WHEN {_READ}[src] IS NULL THEN 'unmatched' ELSE 'hanviet_fallback' END) AS source,
      split_part(coalesce({_VALUE}[src], {_READ}[src], src), '/', 1) AS dst FROM t)"""


def tokenize_longest_match(spark: SparkSession, sf: str) -> DataFrame:
    fields = ("src", "dst", "source")
    out = M.joined_fields(_lines(spark, sf), _lexicon(spark), _readings(spark), {f"_{f}": f for f in fields}, "|", "n_tokens")
    return out.select("doc_id", F.col("line").cast("long").alias("line"), "n_tokens", *[F.md5(f"_{f}").alias(f"{f}_md5") for f in fields])


_TOKENIZE = f"""WITH {_TOKS} SELECT doc_id, line, count(*) AS n_tokens, md5(string_agg(src, '|' ORDER BY k)) AS src_md5, md5(string_agg(dst, '|' ORDER BY k)) AS dst_md5,
md5(string_agg(source, '|' ORDER BY k)) AS source_md5 FROM s GROUP BY doc_id, line"""


def token_coverage(spark: SparkSession, sf: str) -> DataFrame:
    return M.coverage(_tokens(spark, sf, "lang", fields=("source", "len")), ["lang"])


_COVERAGE = f"WITH {_TOKS} SELECT lang, source, count(*) AS n_tokens, CAST(sum(length(src)) AS BIGINT) AS n_chars FROM s GROUP BY lang, source"


def translate_lines(spark: SparkSession, sf: str) -> DataFrame:
    return M.translate_lines(_lines(spark, sf), _lexicon(spark), _readings(spark)).select("doc_id", F.col("line").cast("long").alias("line"), "translated")


def _trim(c: str) -> str:
    return rf"regexp_replace({c}, '^[\s\x{{00A0}}\x{{3000}}\x{{FEFF}}]+|[\s\x{{00A0}}\x{{3000}}\x{{FEFF}}]+$', '', 'g')"


_CAP = r"CASE WHEN regexp_matches(dst, '\p{L}') THEN regexp_extract(dst, '^([^\p{L}]*)', 1) || upper(substr(dst, length(regexp_extract(dst, '^([^\p{L}]*)', 1)) + 1, 1)) || substr(dst, length(regexp_extract(dst, '^([^\p{L}]*)', 1)) + 2) ELSE dst END"
_BEFORE, _AFTER = X.NO_SPACE_BEFORE.replace("'", "''"), X.NO_SPACE_AFTER.replace("'", "''")
_NARROW = f"MAP {{{', '.join(f'{chr(39)}{k}{chr(39)}: {chr(39)}{v.replace(chr(39), chr(39) * 2)}{chr(39)}' for k, v in X.NARROW.items())}}}"
_TRANSLATE = rf"""WITH {_TOKS},
n AS (SELECT doc_id, line, k, src, coalesce({_NARROW}[src], dst) AS dst, last_value(CASE WHEN {_trim("src")} <> '' THEN {_trim("src")} END IGNORE NULLS)
      OVER (PARTITION BY doc_id, line ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev, lead(src) OVER (PARTITION BY doc_id, line ORDER BY k) AS after FROM s),
c AS (SELECT *, CASE WHEN prev IS NULL OR regexp_matches(prev, '{X.SENTENCE_END}') THEN {_CAP} ELSE dst END AS shown FROM n)
SELECT doc_id, line, string_agg(shown || CASE WHEN after IS NOT NULL AND NOT regexp_matches({_trim("after")}, '{_BEFORE}') AND NOT regexp_matches({_trim("src")}, '{_AFTER}') THEN ' ' ELSE '' END, '' ORDER BY k) AS translated
FROM c GROUP BY doc_id, line"""


def candidate_names(spark: SparkSession, sf: str) -> DataFrame:
    keys = ["lang", "doc_id", "line"]
    runs = M.fallback_runs(_lines(spark, sf, "doc_id", "lang"), _lexicon(spark), _readings(spark), keys)
    return M.rank_names(runs, ["lang"], keys, cls=r"\p{L}").withColumn("rank", F.col("rank").cast("long"))


_CANDIDATES = rf"""WITH {_TOKS},
f AS (SELECT *, k - row_number() OVER (PARTITION BY doc_id, line ORDER BY k) AS island FROM s WHERE source = 'hanviet_fallback'),
r AS (SELECT lang, doc_id, line, min(k) AS k, string_agg(src, '' ORDER BY k) AS text, string_agg(dst, ' ' ORDER BY k) AS reading FROM f GROUP BY lang, doc_id, line, island),
g AS (SELECT lang, text, count(*) AS occurrences, min((doc_id, line, k)) AS first, any_value(reading) AS reading FROM r WHERE length(text) >= 2 AND regexp_matches(text, '\p{{L}}') GROUP BY lang, text),
o AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY occurrences DESC, length(text) DESC, first) AS rank FROM g WHERE occurrences >= 2)
SELECT lang, text, reading, occurrences, array_to_string(list_transform(string_split(reading, ' '), lambda w: upper(substr(w, 1, 1)) || substr(w, 2)), ' ') AS suggested, rank FROM o WHERE rank <= 30"""


_LAYERS = [
    ("global", "phrase", None, "on", "auf", "NONE", True), ("global", "name", None, "on", "an", "FIRST_LETTER", True), ("novel", "phrase", "src1", "on", "bei", "NONE", True), ("novel", "name", "src1", "on", "zu", "ALL_WORDS", False),
    ("novel", "name", "src2", "the", "die", "NONE", True), ("user", "phrase", "src2", "the", "das", "NONE", True), ("user", "name", "src3", "on", "ob", "ALL_WORDS", True), ("global", "phrase", None, "an", "a", "NONE", False),
]


def override_layers(spark: SparkSession, sf: str) -> DataFrame:
    rows = spark.createDataFrame(_LAYERS, "tier string, track string, novel_id string, phrase string, value string, cap string, is_active boolean")
    return O.merge_layers(rows, table(spark, sf, "documents").select(F.col("source").alias("novel_id")).distinct())


_OVERRIDES = f"""WITH o(tier, track, novel_id, phrase, value, cap, is_active) AS (VALUES {", ".join("(" + ", ".join("NULL" if x is None else str(x).upper() if isinstance(x, bool) else f"'{x}'" for x in r) + ")" for r in _LAYERS)}),
n AS (SELECT DISTINCT source AS novel_id FROM documents),
x AS (SELECT n.novel_id, phrase, value, cap, tier, track FROM o, n WHERE is_active AND tier = 'global' UNION ALL SELECT novel_id, phrase, value, cap, tier, track FROM o WHERE is_active AND tier <> 'global'),
r AS (SELECT *, row_number() OVER (PARTITION BY novel_id, phrase ORDER BY list_position(['global', 'novel', 'user'], tier) DESC, list_position(['phrase', 'name'], track) DESC) AS k FROM x)
SELECT novel_id, phrase, value, cap, tier, track FROM r WHERE k = 1"""


def _source_lines(spark: SparkSession, sf: str) -> DataFrame:
    part = table(spark, sf, "part")
    one = part.select(F.lit("names").alias("label"), F.lit(1).alias("prio"), F.col("p_partkey").alias("line_no"), F.concat("p_name", F.lit("="), "p_brand").alias("text"))
    two = part.select(F.lit("types").alias("label"), F.lit(2).alias("prio"), F.col("p_partkey").alias("line_no"), F.when(F.col("p_size") % 7 == 0, F.concat(F.lit("# "), "p_name")).otherwise(F.concat("p_name", F.lit(" = "), "p_type", F.lit(" | "), "p_brand")).alias("text"))
    people = table(spark, sf, "customer").select(
        F.lit("people").alias("label"), F.lit(3).alias("prio"), F.col("c_custkey").alias("line_no"), F.concat("c_name", F.lit("="), F.when(F.col("c_nationkey") % 5 == 0, "www.site.com").when(F.col("c_nationkey") % 5 == 1, "()").otherwise(F.col("c_mktsegment"))).alias("text")
    )
    return one.unionByName(two).unionByName(people)


def lexicon_merge(spark: SparkSession, sf: str) -> DataFrame:
    return L.merge_sources(L.parse_phrases(_source_lines(spark, sf), True)).withColumn("len", F.col("len").cast("long"))


def lexicon_report(spark: SparkSession, sf: str) -> DataFrame:
    return L.build_report(L.parse_phrases(_source_lines(spark, sf), True))


_PARSED = r"""WITH lines AS (SELECT 'names' AS label, 1 AS prio, p_partkey AS line_no, p_name || '=' || p_brand AS text FROM part
UNION ALL SELECT 'types', 2, p_partkey, CASE WHEN p_size % 7 = 0 THEN '# ' || p_name ELSE p_name || ' = ' || p_type || ' | ' || p_brand END FROM part
UNION ALL SELECT 'people', 3, c_custkey, c_name || '=' || CASE WHEN c_nationkey % 5 = 0 THEN 'www.site.com' WHEN c_nationkey % 5 = 1 THEN '()' ELSE c_mktsegment END FROM customer),
kv AS (SELECT *, trim(substr(text, 1, instr(text, '=') - 1)) AS phrase, trim(regexp_replace(replace(substr(text, instr(text, '=') + 1), '|', '/'), '\s*/\s*', '/', 'g')) AS value,
       instr(text, '=') = 0 OR text LIKE '#%' AS bad FROM lines),
p AS (SELECT label, prio, line_no, phrase, value, CASE WHEN bad THEN 'malformed' WHEN value IN ('', '()') OR regexp_matches(value, 'www\.') THEN 'junk' ELSE 'ok' END AS status FROM kv),
m AS (SELECT phrase, value, label AS source FROM (SELECT *, row_number() OVER (PARTITION BY phrase ORDER BY prio, line_no) AS k FROM p WHERE status = 'ok') WHERE k = 1)
"""
_MERGE = _PARSED + "SELECT phrase, value, source, length(phrase) AS len FROM m"
_REPORT = _PARSED + """SELECT p.label, count(*) FILTER (status = 'malformed') AS malformed, count(*) FILTER (status = 'junk') AS junk, CAST(0 AS BIGINT) AS artifact,
count(DISTINCT phrase) FILTER (status = 'ok') AS phrases, (SELECT count(*) FROM m WHERE source = p.label) AS won FROM p GROUP BY p.label"""

_BLACK = ["tion th", "Licensed under", " | ", "!!"]


def line_blacklist(spark: SparkSession, sf: str) -> DataFrame:
    lines = M.lines_of(table(spark, sf, "documents"))
    kept = C.drop_blacklisted(lines, spark.createDataFrame([(p,) for p in _BLACK], "pattern string"))
    return kept.groupBy("doc_id").agg(F.count("*").alias("n_lines"), F.sum(F.length("text").cast("long")).alias("n_chars"))


_BLACKLIST = f"""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS text FROM documents)
SELECT doc_id, count(*) AS n_lines, CAST(sum(length(text)) AS BIGINT) AS n_chars FROM l WHERE {" AND ".join(f"NOT contains(text, '{p}')" for p in _BLACK)} GROUP BY doc_id"""


def sanitize_markup(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "pages").select("page_id", F.md5(X.sanitize(F.col("html"))).alias("clean_md5"))


_SANITIZE = r"""SELECT page_id, md5(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '</?(?:script|style|iframe|object|embed)\b[^>]*>', '', 'gi'), '<[^>]+>', '', 'g'), 'javascript\s*:', '', 'gi'),
'[\x00-\x08\x0B\x0C\x0E-\x1F\x7F]', '', 'g')) AS clean_md5 FROM pages"""

_HEAD = r"^[A-ZÀ-Ý]\S*( \S+)?\.$"


def chapter_split(spark: SparkSession, sf: str) -> DataFrame:
    parts = C.split_by_headings(M.lines_of(table(spark, sf, "documents")), X.is_heading(F.col("text"), [_HEAD]))
    return parts.select("doc_id", "chapter_number", "title", F.md5("raw_text").alias("raw_md5"))


_CHAPTERS = rf"""WITH {_LINES.replace(" WHERE ls[i] <> ''", "")},
h AS (SELECT doc_id, line, text, trim(text) <> '' AND length(trim(text)) <= 60 AND regexp_matches(trim(text), '{_HEAD}') AS h FROM l),
g AS (SELECT *, sum(CAST(h AS INT)) OVER (PARTITION BY doc_id ORDER BY line) AS seg FROM h),
b AS (SELECT doc_id, seg, trim(max(text) FILTER (h)) AS title, trim(string_agg(text, chr(10) ORDER BY line) FILTER (NOT h)) AS raw_text FROM g WHERE seg > 0 GROUP BY doc_id, seg)
SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY seg) AS chapter_number, title, md5(raw_text) AS raw_md5 FROM b WHERE raw_text <> ''"""


def chapter_number_append(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "documents").select("doc_id", F.col("source").alias("novel_id"))
    stored = rows.where("doc_id % 3 = 0").groupBy("novel_id").agg(F.count("*").alias("number"))
    return B.number_appended(rows.where("doc_id % 3 <> 0"), stored, "novel_id", "number", ["doc_id"])


_NUMBER = """WITH s AS (SELECT source, count(*) AS top FROM documents WHERE doc_id % 3 = 0 GROUP BY source)
SELECT doc_id, d.source AS novel_id, CAST(coalesce(top, 0) + row_number() OVER (PARTITION BY d.source ORDER BY doc_id) AS BIGINT) AS number FROM documents d LEFT JOIN s ON d.source = s.source WHERE doc_id % 3 <> 0"""


def language_detect(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", X.detect_language(F.col("text"), "[éèêçàùñóíáöüäß]", 0.02, "marked", "plain").alias("detected"))


_LANGUAGE = r"""SELECT doc_id, CASE WHEN length(regexp_replace(text, '\s', '', 'g')) > 0 AND len(regexp_extract_all(text, '[éèêçàùñóíáöüäß]')) / length(regexp_replace(text, '\s', '', 'g')) > 0.02 THEN 'marked' ELSE 'plain' END AS detected FROM documents"""


def source_facets(spark: SparkSession, sf: str) -> DataFrame:
    return B.source_facets(table(spark, sf, "pages"), "url")


_HOST = r"regexp_extract(url, '^[a-z]+://([^/:?#]+)', 1)"
_FACETS = f"SELECT {_HOST} AS host, count(*) AS n FROM pages GROUP BY 1"


def slug_from_url(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "pages").select("page_id", U.slug_from_url(F.col("url")).alias("slug"), U.source_chapter_id(F.col("url")).alias("chapter_id"), U.is_public_url(F.col("url")).alias("is_public"))


_SLUG = rf"""WITH p AS (SELECT page_id, url, string_split(regexp_replace({_HOST}, '^www\.', ''), '.') AS labels, regexp_extract(url, '^[a-z]+://[^/]+(/[^?#]*)', 1) AS path FROM pages)
SELECT page_id, regexp_replace(regexp_replace(lower((CASE WHEN len(labels) > 1 THEN labels[-2] ELSE labels[1] END) || '-' || coalesce(list_filter(string_split(path, '/'), lambda s: regexp_full_match(s, '\d+'))[1], path)), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') AS slug,
nullif(regexp_extract(url, '(\d+)/?$', 1), '') AS chapter_id, TRUE AS is_public FROM p"""


def page_metadata(spark: SparkSession, sf: str) -> DataFrame:
    html = F.col("html")
    return table(spark, sf, "pages").select("page_id", *[c.alias(n) for n, c in U.meta_fields(html).items()], X.is_challenge(F.lit(200), html).alias("challenge"))


def _sql_meta(key: str) -> str:
    said = lambda name: rf"regexp_extract(t, '\s{name}\s*=\s*(?:\"([^\"]*)\"|''([^'']*)'')', ['a', 'b'], 'is')"
    text = lambda name: f"({said(name)}['a'] || {said(name)}['b'])"
    return f"list_filter(list_transform(list_filter(metas, lambda t: lower({text('(?:property|name)')}) = '{key}'), lambda t: trim({text('content')})), lambda c: c <> '')[1]"


_METADATA = rf"""WITH p AS (SELECT page_id, html, regexp_extract_all(html, '<meta\s[^>]*>', 0, 'is') AS metas FROM pages)
SELECT page_id, nullif(trim(regexp_extract(html, '<title[^>]*>([^<]*)</title', 1, 'i')), '') AS title, coalesce({_sql_meta("og:description")}, {_sql_meta("description")}) AS description,
{_sql_meta("og:image")} AS cover, {_sql_meta("author")} AS author, regexp_matches(substr(html, 1, 4000), '{X.CHALLENGE.replace("(?i)", "")}', 'i') AS challenge FROM p"""


def library_search(spark: SparkSession, sf: str) -> DataFrame:
    found = table(spark, sf, "customer").where(B.matches("00001", ["c_name", "c_mktsegment"]) | B.matches("build", ["c_mktsegment"]))
    counted = B.child_counts(found.select("c_custkey", "c_name", "c_mktsegment"), table(spark, sf, "orders").withColumnRenamed("o_custkey", "c_custkey"), "c_custkey", "n_orders")
    return counted.join(table(spark, sf, "customer").join(table(spark, sf, "nation").where("n_regionkey IN (1, 2)"), F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey"), "c_custkey", "left_semi")


_SEARCH = """SELECT c_custkey, c_name, c_mktsegment, (SELECT count(*) FROM orders WHERE o_custkey = c_custkey) AS n_orders FROM customer
WHERE (contains(lower(c_name), '00001') OR contains(lower(c_mktsegment), '00001') OR contains(lower(c_mktsegment), 'build')) AND c_nationkey IN (SELECT n_nationkey FROM nation WHERE n_regionkey IN (1, 2))"""


def library_page(spark: SparkSession, sf: str) -> DataFrame:
    counted = B.child_counts(table(spark, sf, "customer").select("c_custkey", "c_name"), table(spark, sf, "orders").withColumnRenamed("o_custkey", "c_custkey"), "c_custkey", "n_orders")
    return B.page(counted, [F.desc("n_orders"), "c_custkey"], 2, 24)


_PAGE = """SELECT c_custkey, c_name, n_orders FROM (SELECT c_custkey, c_name, (SELECT count(*) FROM orders WHERE o_custkey = c_custkey) AS n_orders FROM customer) ORDER BY n_orders DESC, c_custkey LIMIT 24 OFFSET 24"""

_KEYS = ["event_type", "user_id"]


def rate_limit_verdicts(spark: SparkSession, sf: str) -> DataFrame:
    out = B.rate_limit(table(spark, sf, "events").select("event_id", "ts", *_KEYS), _KEYS, 86_400, 3)
    return out.select("event_id", "window_start", "hit", "denied", "retry_after")


_WINDOW = "CAST(floor(epoch_us(ts) / 1000000 / 86400) * 86400 AS BIGINT)"
_VERDICTS = f"""WITH w AS (SELECT *, {_WINDOW} AS window_start FROM events), h AS (SELECT *, row_number() OVER (PARTITION BY event_type, user_id, window_start ORDER BY ts, event_id) AS hit FROM w)
SELECT event_id, window_start, hit, hit > 3 AS denied, CASE WHEN hit > 3 THEN CAST(greatest(1, ceil(window_start + 86400 - epoch_us(ts) / 1000000)) AS BIGINT) END AS retry_after FROM h"""


def rate_limit_windows(spark: SparkSession, sf: str) -> DataFrame:
    return B.rate_windows(table(spark, sf, "events"), _KEYS, 86_400, 3)


_WINDOWS = f"SELECT event_type, user_id, {_WINDOW} AS window_start, count(*) AS hits, CAST(greatest(0, count(*) - 3) AS BIGINT) AS n_denied FROM events GROUP BY ALL"


def view_counts(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").groupBy("event_type").agg(F.count("*").alias("views"))


def latest_progress(spark: SparkSession, sf: str) -> DataFrame:
    return B.latest(table(spark, sf, "events"), ["user_id", "event_type"], "value", ["ts", "event_id"])


_LATEST = "SELECT user_id, event_type, value, ts FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS k FROM events) WHERE k = 1"


def continue_reading(spark: SparkSession, sf: str) -> DataFrame:
    return B.top_per(table(spark, sf, "events").select("user_id", "event_id", "ts"), ["user_id"], [F.desc("ts"), F.desc("event_id")], 6)


_CONTINUE = "SELECT user_id, event_id, ts, k AS rank FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS k FROM events) WHERE k <= 6"


def progress_sync(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events")
    top = lambda odd: e.where(F.col("event_id") % 2 == odd).groupBy("user_id").agg(F.max("value").alias("value"))
    return B.sync_progress(top(1), top(0), ["user_id"], "value")


_SYNC = """WITH a AS (SELECT user_id, max(value) AS value FROM events WHERE event_id % 2 = 1 GROUP BY 1), b AS (SELECT user_id, max(value) AS value FROM events WHERE event_id % 2 = 0 GROUP BY 1)
SELECT a.user_id, a.value FROM a LEFT JOIN b USING (user_id) WHERE b.value IS NULL OR a.value > b.value"""


def _edits(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").select(F.col("event_id").alias("seq"), F.col("user_id").alias("phrase_id"), F.col("event_type").alias("value"), F.when(F.col("event_id") % 3 == 0, "user").when(F.col("event_id") % 3 == 1, "novel").otherwise("global").alias("tier"))


def apply_upserts(spark: SparkSession, sf: str) -> DataFrame:
    base = table(spark, sf, "customer").select(F.lit(None).cast("long").alias("seq"), F.col("c_custkey").alias("phrase_id"), F.col("c_mktsegment").alias("value"), F.lit("global").alias("tier"))
    return O.apply_upserts(base, _edits(spark, sf), ["phrase_id"], ["value"], keep_cols=["tier"])


_UPSERT = """WITH r AS (SELECT -1 AS seq, c_custkey AS phrase_id, c_mktsegment AS value, 'global' AS tier FROM customer UNION ALL
SELECT event_id, user_id, event_type, CASE event_id % 3 WHEN 0 THEN 'user' WHEN 1 THEN 'novel' ELSE 'global' END FROM events)
SELECT phrase_id, arg_max(value, seq) AS value, arg_min(tier, seq) AS tier, max(seq) AS seq FROM r GROUP BY phrase_id"""


def dictionary_version(spark: SparkSession, sf: str) -> DataFrame:
    return O.dictionary_version(_edits(spark, sf))


def override_validate(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "documents").select("doc_id", F.col("text").alias("phrase"), F.col("text").alias("value"), "lang").unionByName(table(spark, sf, "part").select(F.col("p_partkey").alias("doc_id"), F.col("p_name").alias("phrase"), F.col("p_type").alias("value"), F.when(F.col("p_size") % 2 == 0, "en").otherwise("fr").alias("lang")))
    reason = O.reject_reason(F.col("phrase"), F.col("value"), F.when(F.col("lang") == "en", "NONE").otherwise("X"), F.lit("name"))
    return e.groupBy(F.coalesce(reason, F.lit("ok")).alias("reason")).agg(F.count("*").alias("n"))


_VALIDATE = """WITH e AS (SELECT text AS phrase, text AS value, lang FROM documents UNION ALL SELECT p_name, p_type, CASE WHEN p_size % 2 = 0 THEN 'en' ELSE 'fr' END FROM part)
SELECT CASE WHEN coalesce(phrase, '') = '' OR coalesce(value, '') = '' THEN 'missing' WHEN contains(phrase, chr(10)) THEN 'line break' WHEN length(phrase) > 60 THEN 'phrase too long' WHEN length(value) > 200 THEN 'value too long'
WHEN len(string_split(value, '/')) > 8 THEN 'too many alternatives' WHEN lang <> 'en' THEN 'cap style' ELSE 'ok' END AS reason, count(*) AS n FROM e GROUP BY 1"""


def delete_renumber(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "conversations").select("conv_id", "turn", F.md5("text").alias("text_md5"))
    return B.delete_and_renumber(rows, rows.where("(conv_id + turn) % 4 = 1").select("conv_id", "turn"), "conv_id", "turn")


_RENUMBER = """WITH c AS (SELECT conv_id, turn, md5(text) AS text_md5, (conv_id + turn) % 4 = 1 AS gone FROM conversations),
b AS (SELECT *, sum(CAST(gone AS INT)) OVER (PARTITION BY conv_id ORDER BY turn) AS below FROM c) SELECT conv_id, CAST(turn - below AS BIGINT) AS turn, text_md5 FROM b WHERE NOT gone"""


def chapter_nav(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "conversations").select("conv_id", (F.col("turn") + 1).alias("number"))
    return B.neighbours(rows, "conv_id", "number")


_NAV = """SELECT conv_id, turn + 1 AS number, CASE WHEN turn + 1 > 1 THEN turn END AS prev, CASE WHEN turn + 1 < count(*) OVER (PARTITION BY conv_id) THEN turn + 2 END AS next FROM conversations"""


def activity_report(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events").select("event_id", "event_type", "user_id", F.get_json_object("props", "$.k").cast("long").alias("k"))
    return e.join(table(spark, sf, "customer").select(F.col("c_custkey").alias("user_id"), "c_name"), "user_id", "left")


_ACTIVITY = "SELECT user_id, event_id, event_type, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, c_name FROM events LEFT JOIN customer ON c_custkey = user_id"

_LATIN = r"\p{L}"


def page_content(spark: SparkSession, sf: str) -> DataFrame:
    return P.page_content(table(spark, sf, "pages"), _LATIN).select("page_id", "title", F.length("text").cast("long").alias("n_chars"), F.md5("text").alias("text_md5"))


def size_split(spark: SparkSession, sf: str) -> DataFrame:
    return C.split_by_size(table(spark, sf, "documents")).select("doc_id", "piece", F.length("text").cast("long").alias("n_chars"), F.md5("text").alias("text_md5"))


_SIZES = r"""WITH RECURSIVE r AS (SELECT doc_id, text, 0 AS k, CAST(0 AS BIGINT) AS a, CAST(0 AS BIGINT) AS b FROM documents UNION ALL
SELECT doc_id, text, k + 1, b, CASE WHEN b + 3000 >= length(text) THEN length(text) ELSE b + 3000 + length(regexp_extract(substr(text, b + 3001, 1500), '^[^。！？.!?]*[。！？.!?]')) END FROM r WHERE b < length(text)),
p AS (SELECT doc_id, k, regexp_replace(substr(text, a + 1, b - a), '^\s+|\s+$', '', 'g') AS piece_text FROM r WHERE k > 0)
SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY k) AS piece, length(piece_text) AS n_chars, md5(piece_text) AS text_md5 FROM p WHERE piece_text <> ''"""


def slug_assign(spark: SparkSession, sf: str) -> DataFrame:
    pages = table(spark, sf, "pages").select("page_id", F.regexp_extract(U.host(F.col("url")), r"([^.]+\.[^.]+)$", 1).alias("base"))
    taken = table(spark, sf, "pages").where("page_id % 2 = 0").select(F.regexp_extract(U.host(F.col("url")), r"([^.]+\.[^.]+)$", 1).alias("slug")).distinct()
    return B.assign_slugs(pages.where("page_id % 2 = 1"), taken, "base", ["page_id"])


_SLUGS = f"""WITH p AS (SELECT page_id, regexp_extract({_HOST}, '([^.]+\\.[^.]+)$', 1) AS base FROM pages),
n AS (SELECT page_id, base, row_number() OVER (PARTITION BY base ORDER BY page_id) + CAST(base IN (SELECT base FROM p WHERE page_id % 2 = 0) AS INT) AS k FROM p WHERE page_id % 2 = 1)
SELECT page_id, base, CASE WHEN k = 1 THEN base ELSE base || '-' || k END AS slug FROM n"""


def delete_across(spark: SparkSession, sf: str) -> DataFrame:
    people, orders = table(spark, sf, "customer"), table(spark, sf, "orders").select("o_orderkey", "o_custkey")
    events = table(spark, sf, "events").select("event_id", "user_id")
    kept, cut, loose = B.cascade_delete(people, people.where("c_acctbal < 0"), "c_custkey", {"orders": (orders, "o_custkey")}, {"events": (events, "user_id")})
    rows = [kept.select(F.lit("customer").alias("name"), F.col("c_custkey").alias("id"), F.col("c_custkey").alias("owner"))]
    rows += [cut["orders"].select(F.lit("orders").alias("name"), F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("owner"))]
    rows += [loose["events"].select(F.lit("events").alias("name"), F.col("event_id").alias("id"), F.col("user_id").alias("owner"))]
    return rows[0].unionByName(rows[1]).unionByName(rows[2])


_ACROSS = """WITH g AS (SELECT c_custkey FROM customer WHERE c_acctbal < 0)
SELECT 'customer' AS name, c_custkey AS id, c_custkey AS owner FROM customer WHERE NOT c_acctbal < 0
UNION ALL SELECT 'orders', o_orderkey, o_custkey FROM orders WHERE o_custkey NOT IN (FROM g)
UNION ALL SELECT 'events', event_id, CASE WHEN user_id NOT IN (FROM g) THEN user_id END FROM events"""


_BUILT = {
    "page_content": (page_content, None), "size_split": (size_split, _SIZES), "slug_assign": (slug_assign, _SLUGS), "delete_across": (delete_across, _ACROSS),
    "translate_lines": (translate_lines, _TRANSLATE), "tokenize_longest_match": (tokenize_longest_match, _TOKENIZE), "token_coverage": (token_coverage, _COVERAGE), "candidate_names": (candidate_names, _CANDIDATES),
    "override_layers": (override_layers, _OVERRIDES), "lexicon_merge": (lexicon_merge, _MERGE), "lexicon_report": (lexicon_report, _REPORT), "line_blacklist": (line_blacklist, _BLACKLIST), "sanitize_markup": (sanitize_markup, _SANITIZE),
    "chapter_split": (chapter_split, _CHAPTERS), "chapter_number_append": (chapter_number_append, _NUMBER), "language_detect": (language_detect, _LANGUAGE), "source_facets": (source_facets, _FACETS), "slug_from_url": (slug_from_url, _SLUG),
    "page_metadata": (page_metadata, _METADATA), "library_search": (library_search, _SEARCH), "library_page": (library_page, _PAGE), "rate_limit_verdicts": (rate_limit_verdicts, _VERDICTS), "rate_limit_windows": (rate_limit_windows, _WINDOWS),
    "view_counts": (view_counts, "SELECT event_type, count(*) AS views FROM events GROUP BY 1"), "latest_progress": (latest_progress, _LATEST), "continue_reading": (continue_reading, _CONTINUE), "progress_sync": (progress_sync, _SYNC),
    "apply_upserts": (apply_upserts, _UPSERT), "dictionary_version": (dictionary_version, "SELECT 1 + count(*) AS version FROM events WHERE event_id % 3 <> 0"), "override_validate": (override_validate, _VALIDATE),
    "delete_renumber": (delete_renumber, _RENUMBER), "chapter_nav": (chapter_nav, _NAV), "activity_report": (activity_report, _ACTIVITY),
}


def _built() -> dict:
    from .corpus_queries import BUILT as corpus
    from .library_queries import BUILT as library

    return _BUILT | corpus | library


def queries() -> dict:
    return {k: f for k, (f, _) in _built().items()}


def oracle_sql() -> dict[str, str]:
    return {k: s for k, (_, s) in _built().items() if s}
