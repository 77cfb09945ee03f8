"""Registered queries of translation jobs and of building a lexicon, and their SQL twins for DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import queries as Q
from .functions import text as X
from .functions import urls as U
from .operators import corpus as J
from .operators import lexicon as L
from .operators import match as M
from .operators import overrides as O
from .operators import sites as S
from .sources.tables import table

_Q = chr(39)
#: Overrides over the sources of the test documents, which stand for novels.
OVERRIDES = [
    ("global", "phrase", None, "on", "auf", "NONE", True), ("global", "name", None, "on", "an der", "FIRST_LETTER", True), ("novel", "phrase", "src1", "on", "bei", "NONE", True), ("novel", "name", "src1", "er", "zu oft", "ALL_WORDS", True),
    ("novel", "name", "src2", "thand", "die hand", "FIRST_LETTER", True), ("novel", "phrase", "src2", "the", "das", "NONE", False), ("global", "phrase", None, "an", "a", "NONE", False),
]
_NOVELS = ("src1", "src2")


def _overrides(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(OVERRIDES, "tier string, track string, novel_id string, phrase string, value string, cap string, is_active boolean")


def _docs(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", "text")


def _digest(df: DataFrame, column: str) -> DataFrame:
    return df.select("doc_id", F.md5(column).alias(f"{column}_md5"))


def _map(pairs: dict) -> str:
    return f"MAP {{{', '.join(f'{_Q}{k}{_Q}: {_Q}{v}{_Q}' for k, v in pairs.items())}}}"


def _twin(best: dict[str, tuple], where: str) -> str:
    """Translated documents (doc_id, translated) by a lexicon: phrase to (value, kind, cap)."""
    pattern = "(?s)" + "|".join(sorted(best, key=lambda p: (-len(p), p))) + "|."
    value, kind = _map({p: v[0] for p, v in best.items()}), _map({p: v[1] for p, v in best.items()})
    cap = _map({p: v[2] for p, v in best.items() if v[2]} or {"": "NONE"})
    return rf"""(WITH l AS (SELECT doc_id, i AS line, ls[i] AS text FROM (SELECT doc_id, string_split(text, chr(10)) AS ls, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS i FROM documents WHERE {where})),
t AS (SELECT doc_id, line, unnest(range(1, len(m) + 1)) AS k, unnest(m) AS src FROM (SELECT doc_id, line, regexp_extract_all(text, '{pattern}') AS m FROM l WHERE {Q._trim("text")} <> '')),
s AS (SELECT doc_id, line, k, src, split_part(coalesce({value}[src], {Q._READ}[src], src), '/', 1) AS plain, {cap}[src] AS cap FROM t),
q AS (SELECT doc_id, line, k, src, coalesce({Q._NARROW}[src], CASE cap WHEN 'FIRST_LETTER' THEN upper(substr(plain, 1, 1)) || substr(plain, 2)
      WHEN 'ALL_WORDS' THEN array_to_string(list_transform(string_split(plain, ' '), lambda w: upper(substr(w, 1, 1)) || substr(w, 2)), ' ') ELSE plain END) AS dst FROM s),
n AS (SELECT *, last_value(CASE WHEN {Q._trim("src")} <> '' THEN {Q._trim("src")} END IGNORE NULLS) OVER (PARTITION BY doc_id, line ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev,
      lead(src) OVER (PARTITION BY doc_id, line ORDER BY k) AS after FROM q),
c AS (SELECT *, CASE WHEN prev IS NULL OR regexp_matches(prev, '{X.SENTENCE_END}') THEN {Q._CAP} ELSE dst END AS shown FROM n),
j AS (SELECT doc_id, line, string_agg(shown || CASE WHEN after IS NOT NULL AND NOT regexp_matches({Q._trim("after")}, '{Q._BEFORE}') AND NOT regexp_matches({Q._trim("src")}, '{Q._AFTER}') THEN ' ' ELSE '' END, '' ORDER BY k) AS shown FROM c GROUP BY doc_id, line)
SELECT l.doc_id, string_agg(coalesce(j.shown, ''), chr(10) ORDER BY l.line) AS translated FROM l LEFT JOIN j ON l.doc_id = j.doc_id AND l.line = j.line GROUP BY l.doc_id)"""


def _layer(tier: str, novel: str | None = None) -> dict[str, tuple]:
    """What OVERRIDES say in a tier: phrases, then names over them; inactive ones nothing.  A style goes with its value in every tier."""
    return {p: (v, "name", cap) for track in ("phrase", "name") for t, k, n, p, v, cap, active in OVERRIDES if active and (t, k, n) == (tier, track, novel)}


_PLAIN = {p: (v[0], v[1], None) for p, v in Q._BEST.items()}
_GLOBAL = _PLAIN | _layer("global")
_OWN = {n: _layer("novel", n) for n in _NOVELS}


def translate_text(spark: SparkSession, sf: str) -> DataFrame:
    return _digest(M.translate_text(_docs(spark, sf), Q._lexicon(spark), Q._readings(spark)), "translated")


_TEXT = f"SELECT doc_id, md5(translated) AS translated_md5 FROM {_twin(_PLAIN, 'TRUE')}"


def reading_of_text(spark: SparkSession, sf: str) -> DataFrame:
    return _digest(M.reading_of_text(_docs(spark, sf), Q._lexicon(spark), Q._readings(spark)), "reading")


_READING = f"""WITH l AS (SELECT doc_id, i AS line, ls[i] AS text FROM (SELECT doc_id, string_split(text, chr(10)) AS ls, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS i FROM documents)),
c AS (SELECT doc_id, line, k, substr(text, k, 1) AS ch FROM (SELECT doc_id, line, text, unnest(range(1, length(text) + 1)) AS k FROM l WHERE {Q._trim("text")} <> '')),
r AS (SELECT doc_id, line, string_agg(coalesce({Q._READ}[ch], ch), ' ' ORDER BY k) AS r FROM c GROUP BY doc_id, line)
SELECT doc_id, md5(string_agg(coalesce(r, ''), chr(10) ORDER BY line)) AS reading_md5 FROM l LEFT JOIN r USING (doc_id, line) GROUP BY doc_id"""


def tokenize_raw(spark: SparkSession, sf: str) -> DataFrame:
    return _digest(M.tokenize_raw(_docs(spark, sf), Q._lexicon(spark), Q._readings(spark)), "shown")


_RAW = f"""SELECT doc_id, md5(array_to_string(list_transform(regexp_extract_all(text, '{Q._PATTERN}'), lambda src: split_part(coalesce({Q._VALUE}[src], {Q._READ}[src], src), '/', 1)), ' ')) AS shown_md5 FROM documents"""


def _chapters(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", F.col("source").alias("novel_id"), "text", "lang")


def translate_corpus(spark: SparkSession, sf: str) -> DataFrame:
    out = J.translate_corpus(_chapters(spark, sf), Q._lexicon(spark), Q._readings(spark), _overrides(spark), F.col("lang") != "de")
    return _digest(out, "translated")


_BY_NOVEL = " UNION ALL ".join(f"SELECT * FROM {_twin(_GLOBAL | _OWN.get(n, {}), w)}" for n, w in [(n, f"lang <> 'de' AND source = '{n}'") for n in _NOVELS] + [("", "lang <> 'de' AND source NOT IN ('src1', 'src2')")])
_CORPUS = f"SELECT doc_id, md5(translated) AS translated_md5 FROM ({_BY_NOVEL} UNION ALL SELECT doc_id, text FROM documents WHERE lang = 'de')"


def translate_changed(spark: SparkSession, sf: str) -> DataFrame:
    """A third of the rows is up to date, a third has an old version, the rest an old text or none."""
    rows = _chapters(spark, sf)
    state = rows.where("doc_id % 4 <> 3").select("doc_id", F.when(F.col("doc_id") % 4 == 0, 6).otherwise(7).alias("version"), F.when(F.col("doc_id") % 4 == 1, X.content_hash(F.lit("old"))).otherwise(X.content_hash(F.col("text"))).alias("hash"))
    out = J.translate_changed(rows, state, 7, Q._lexicon(spark), Q._readings(spark), _overrides(spark), "doc_id", F.col("lang") != "de")
    return out.select("doc_id", "version", "hash", F.md5("translated").alias("translated_md5"))


_CHANGED = f"SELECT d.doc_id, 7 AS version, sha256(text) AS hash, translated_md5 FROM documents d JOIN ({_CORPUS}) t ON d.doc_id = t.doc_id WHERE d.doc_id % 4 <> 2"


def retranslate_titles(spark: SparkSession, sf: str) -> DataFrame:
    """Titles with an original are translated again with the layer of their novel, after its overrides have changed."""
    rows = table(spark, sf, "part").select("p_partkey", F.when(F.col("p_size") % 3 > 0, F.concat("p_name", F.lit("\non sherander on"))).alias("original"), F.col("p_brand").alias("title"), F.lit("").alias("text"), F.concat(F.lit("src"), (F.col("p_size") % 5).cast("string")).alias("novel_id"))
    return J.retranslate(rows, "original", "title", Q._lexicon(spark), Q._readings(spark), _overrides(spark)).select("p_partkey", "original", F.md5("title").alias("title_md5"))


_IN = [(n, f"source = '{n}'") for n in _NOVELS] + [("", "source NOT IN ('src1', 'src2')")]
_TITLES = f"""WITH documents AS (SELECT p_partkey AS doc_id, p_name || chr(10) || 'on sherander on' AS text, 'src' || p_size % 5 AS source FROM part WHERE p_size % 3 > 0)
SELECT p_partkey, text AS original, md5(coalesce(translated, p_brand)) AS title_md5 FROM part LEFT JOIN documents d ON d.doc_id = p_partkey LEFT JOIN ({" UNION ALL ".join(f"SELECT * FROM {_twin(_GLOBAL | _OWN.get(n, {}), w)}" for n, w in _IN)}) t ON t.doc_id = p_partkey"""


def reader_translations(spark: SparkSession, sf: str) -> DataFrame:
    """Documents as two readers see them: each with their own entries over the novel's, never with the other's."""
    rows = _chapters(spark, sf).where("lang <> 'de'").withColumn("user_id", F.explode(F.array(F.lit(1).cast("long"), F.lit(2).cast("long"))))
    over = _overrides(spark).withColumn("user_id", F.lit(None).cast("long")).unionByName(spark.createDataFrame(PERSONAL, "tier string, track string, novel_id string, phrase string, value string, cap string, is_active boolean, user_id long"))
    full, _ = J.scoped_lexicon(Q._lexicon(spark), over.drop("user_id"))
    layers = O.reader_layers(over, rows)
    out = M.translate_text(rows.withColumn("reader", O.reader_scope()), full, Q._readings(spark), layers, "reader")
    return out.select("doc_id", "user_id", F.md5("translated").alias("translated_md5"))


#: Overrides of single readers.
PERSONAL = [("user", "phrase", "src1", "on", "mein", "NONE", True, 1), ("user", "name", "src1", "en", "dein ort", "ALL_WORDS", True, 2), ("user", "name", "src3", "er", "sie", "FIRST_LETTER", True, 2), ("user", "name", "src1", "er", "es", "NONE", False, 2)]


def _reader_twin() -> str:
    parts = []
    for user in (1, 2):
        for novel in ("src1", "src2", "src3", ""):
            where = f"source = '{novel}'" if novel else "source NOT IN ('src1', 'src2', 'src3')"
            own = {p: (v, "name", cap) for track in ("phrase", "name") for _, k, n, p, v, cap, active, u in PERSONAL if active and (k, n, u) == (track, novel, user)}
            parts.append(f"SELECT *, CAST({user} AS BIGINT) AS user_id FROM {_twin(_GLOBAL | _OWN.get(novel, {}) | own, where + ' AND lang <> ' + _Q + 'de' + _Q)}")
    return f"SELECT doc_id, user_id, md5(translated) AS translated_md5 FROM ({' UNION ALL '.join(parts)})"


def changed_since_edits(spark: SparkSession, sf: str) -> DataFrame:
    """Documents to translate again: new ones, changed texts, and those whose version of the edit log (events) has passed."""
    rows = _docs(spark, sf)
    n = F.lit(2) * F.col("doc_id") * 7919 % 12_000
    state = rows.where("doc_id % 4 <> 3").select("doc_id", F.when(F.col("doc_id") % 4 == 1, X.content_hash(F.lit("old"))).otherwise(X.content_hash(F.col("text"))).alias("hash"), F.when(F.col("doc_id") % 8 == 0, 10_000_000).otherwise(n).alias("seen_at"))
    return J.changed_since(rows, state, Q._edits(spark, sf), "doc_id").select("doc_id", "version", "hash")


_SINCE = """WITH v AS (SELECT event_id AS at, 1 + count(*) OVER (ORDER BY event_id) AS version FROM events WHERE event_id % 3 <> 0), n AS (SELECT coalesce(max(version), 1) AS now FROM v),
s AS (SELECT doc_id, CASE WHEN doc_id % 4 = 1 THEN sha256('old') ELSE sha256(text) END AS hash, CASE WHEN doc_id % 8 = 0 THEN 10000000 ELSE 2 * doc_id * 7919 % 12000 END AS at FROM documents WHERE doc_id % 4 <> 3),
t AS (SELECT s.doc_id, s.hash, coalesce(v.version, 1) AS version FROM s ASOF LEFT JOIN v ON s.at >= v.at)
SELECT d.doc_id, now AS version, sha256(text) AS hash FROM documents d LEFT JOIN t USING (doc_id), n WHERE t.doc_id IS NULL OR t.hash <> sha256(text) OR t.version <> now"""


def versions_as_of(spark: SparkSession, sf: str) -> DataFrame:
    """The dictionary's version at a place of the edit log, for every order."""
    rows = table(spark, sf, "orders").select("o_orderkey", F.when(F.col("o_orderkey") % 11 > 0, F.col("o_orderkey") * 7919 % 30_000 - 500).alias("place"))
    return O.version_as_of(rows, Q._edits(spark, sf), "place")


_AS_OF = """WITH v AS (SELECT event_id AS seq, 1 + count(*) OVER (ORDER BY event_id) AS version FROM events WHERE event_id % 3 <> 0),
o AS (SELECT o_orderkey, CASE WHEN o_orderkey % 11 > 0 THEN o_orderkey * 7919 % 30000 - 500 END AS place FROM orders)
SELECT o_orderkey, place, coalesce(version, 1) AS version FROM o ASOF LEFT JOIN v ON o.place >= v.seq"""


def backfill_titles(spark: SparkSession, sf: str) -> DataFrame:
    none = F.lit(None).cast("string")
    rows = table(spark, sf, "pages").select("page_id", F.when(F.col("page_id") % 3 == 0, F.lit("kept")).alias("original_title"), U.page_title(F.col("html")).alias("title"), none.alias("source_chapter_id"), F.col("url").alias("source_url"))
    out = J.backfill_titles(rows, Q._lexicon(spark), Q._readings(spark))
    return out.select("page_id", "original_title", "title", "source_chapter_id")


_BACKFILL = f"""WITH p AS (SELECT page_id, url, nullif(trim(regexp_extract(html, '<title[^>]*>([^<]*)</title>', 1, 'i')), '') AS title FROM pages)
SELECT page_id, CASE WHEN page_id % 3 = 0 THEN 'kept' ELSE title END AS original_title, CASE WHEN page_id % 3 = 0 OR title IS NULL THEN title ELSE
array_to_string(list_transform(regexp_extract_all(title, '{Q._PATTERN}'), lambda src: split_part(coalesce({Q._VALUE}[src], {Q._READ}[src], src), '/', 1)), ' ') END AS title, nullif(regexp_extract(url, '(\\d+)/?$', 1), '') AS source_chapter_id FROM p"""


def book_gate(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents")
    books = docs.select(F.col("doc_id").alias("book_id"), F.when(F.col("doc_id") % 5 > 0, F.substring_index("text", " ", 1)).alias("title"), F.lit(None).cast("string").alias("description"))
    heads = table(spark, sf, "conversations").select(F.col("conv_id").alias("book_id"), F.col("turn").alias("chapter_number"), F.col("text").alias("title"))
    return J.validate_book(books, heads, "[é]").select("book_id", "reason")


_GATE = r"""WITH b AS (SELECT doc_id AS book_id, CASE WHEN doc_id % 5 > 0 THEN split_part(text, ' ', 1) END AS title FROM documents),
h AS (SELECT conv_id AS book_id, bool_or(contains(text, 'é')) AS hit FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS k FROM conversations) WHERE k <= 3 GROUP BY 1)
SELECT b.book_id, CASE WHEN trim(coalesce(title, ''), chr(10) || chr(9) || ' ') = '' THEN 'no title' WHEN NOT coalesce(contains(title, 'é'), FALSE) AND NOT coalesce(hit, FALSE) THEN 'no text of the script' END AS reason FROM b LEFT JOIN h ON b.book_id = h.book_id"""


def cedict_parse(spark: SparkSession, sf: str) -> DataFrame:
    part = table(spark, sf, "part")
    text = F.concat(F.replace("p_name", F.lit(" "), F.lit("-")), F.lit(" "), F.replace("p_brand", F.lit(" "), F.lit("-")), F.lit(" [pin1 yin1] /"), F.lower("p_type"), F.lit(" (CL:x); rest/, to "), F.col("p_size").cast("string"), F.lit("./"))
    return L.parse_cedict(part.select(F.col("p_partkey").alias("line_no"), F.when(F.col("p_size") % 9 == 0, F.concat(F.lit("#"), text)).otherwise(text).alias("text")))


_CEDICT = """WITH c AS (SELECT p_partkey AS line_no, replace(p_name, ' ', '-') AS a, replace(p_brand, ' ', '-') AS b, lower(p_type) || '/to ' || p_size AS value FROM part WHERE p_size % 9 <> 0),
k AS (SELECT line_no, a AS phrase, value FROM c UNION SELECT line_no, b, value FROM c) SELECT phrase, arg_min(value, line_no) AS value FROM k GROUP BY phrase"""


def readings_merge(spark: SparkSession, sf: str) -> DataFrame:
    """A listed source, a simple and a classical one, merged in that order; gaps of the first are filled by the others."""
    part = table(spark, sf, "part")
    listed = L.parse_readings_csv(part.select(F.col("p_partkey").alias("line_no"), F.substring("p_type", 1, 1).alias("ch"), F.concat(F.lit("['"), F.lower("p_brand"), F.lit("', '"), F.substring("p_name", 1, 3), F.lit("']")).alias("listed")))
    line = lambda text: part.select(F.col("p_partkey").alias("line_no"), text.alias("text"))
    simple = L.parse_simple_readings(line(F.concat(F.substring("p_name", 1, 1), F.lit(" = "), F.lower("p_type"))))
    classical = L.parse_classical_readings(line(F.concat(F.substring("p_name", 2, 1), F.lit("="), F.lower("p_brand"), F.lit(", x [note]"))))
    base = L.merge_readings(listed)
    for extra in (simple, classical):
        base = L.fill_gaps(base, extra.withColumnRenamed("reading", "readings"), "ch")
    return base


_READINGS = """WITH r AS (SELECT p_partkey AS n, substr(p_type, 1, 1) AS ch, 0 AS k, lower(p_brand) AS reading FROM part UNION ALL SELECT p_partkey, substr(p_type, 1, 1), 1, substr(p_name, 1, 3) FROM part),
f AS (SELECT ch, reading, min((n, k)) AS first FROM r WHERE reading <> '' GROUP BY ch, reading), a AS (SELECT ch, string_agg(reading, ',' ORDER BY first) AS readings FROM f GROUP BY ch),
b AS (SELECT substr(p_name, 1, 1) AS ch, arg_min(lower(p_type), p_partkey) AS readings FROM part WHERE trim(substr(p_name, 1, 1)) <> '' GROUP BY 1), c AS (SELECT substr(p_name, 2, 1) AS ch, arg_min(lower(p_brand), p_partkey) AS readings FROM part WHERE trim(substr(p_name, 2, 1)) <> '' GROUP BY 1)
SELECT * FROM a UNION ALL SELECT * FROM b WHERE ch NOT IN (SELECT ch FROM a) UNION ALL SELECT * FROM c WHERE ch NOT IN (SELECT ch FROM a) AND ch NOT IN (SELECT ch FROM b)"""


def _old_entries(spark: SparkSession, sf: str) -> DataFrame:
    kinds = F.element_at(F.array(*map(F.lit, ("word", "name", "pronoun", "idiom"))), (F.col("o_orderkey") % 4 + 1).cast("int"))
    phrase = F.when(F.col("o_orderkey") % 11 == 0, "  ").otherwise(F.concat(F.lit(" é"), "o_orderpriority", (F.col("o_custkey") % 50).cast("string")))
    return table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), phrase.alias("phrase"), F.col("o_orderstatus").alias("value"), kinds.alias("category"), F.lit("old").alias("source"))


_OLD = "SELECT o_orderkey AS id, CASE WHEN o_orderkey % 11 = 0 THEN '' ELSE 'é' || o_orderpriority || (o_custkey % 50) END AS phrase, o_orderstatus AS value, ['word', 'name', 'pronoun', 'idiom'][o_orderkey % 4 + 1] AS category FROM orders"


def category_split(spark: SparkSession, sf: str) -> DataFrame:
    return L.split_by_category(_old_entries(spark, sf))


_SPLIT = f"SELECT category AS kind, phrase, arg_min(value, id) AS value, 'old' AS source FROM ({_OLD}) WHERE category <> 'idiom' AND phrase <> '' GROUP BY 1, 2"


def category_report(spark: SparkSession, sf: str) -> DataFrame:
    return L.split_report(_old_entries(spark, sf))


_SPLIT_REPORT = f"SELECT category, count(*) AS n, count(*) FILTER (phrase = '') AS n_empty, count(DISTINCT phrase) FILTER (phrase <> '') AS n_phrases, category <> 'idiom' AS known FROM ({_OLD}) GROUP BY 1"


def blacklist_merge(spark: SparkSession, sf: str) -> DataFrame:
    one = lambda name, key, text, label, prio: table(spark, sf, name).select(F.lit(label).alias("label"), F.lit(prio).alias("prio"), F.col(key).alias("line_no"), text.alias("text"))
    part = F.when(F.col("p_size") % 5 == 0, F.concat(F.lit("# "), "p_brand")).when(F.col("p_size") % 5 == 1, F.concat(F.lit("//"), "p_brand")).when(F.col("p_size") % 5 == 2, "BLACKLIST of brands").otherwise(F.concat(F.lit("  "), "p_brand", F.lit(" ")))
    people = F.when(F.col("c_custkey") % 2 == 0, F.col("c_mktsegment")).otherwise(F.concat(F.lit("Brand#"), (F.col("c_custkey") % 60).cast("string")))
    return L.merge_patterns(L.parse_blacklist(one("part", "p_partkey", part, "parts", 1).unionByName(one("customer", "c_custkey", people, "people", 2))))


_PATTERNS = """WITH r AS (SELECT 1 AS prio, p_partkey AS n, p_brand AS pattern FROM part WHERE p_size % 5 > 2 UNION ALL SELECT 2, c_custkey, CASE WHEN c_custkey % 2 = 0 THEN c_mktsegment ELSE 'Brand#' || (c_custkey % 60) END FROM customer)
SELECT pattern, CASE min(prio) WHEN 1 THEN 'parts' ELSE 'people' END AS source FROM r GROUP BY pattern"""


#: Lines that trigger each rule of the entry filters, with a number of the row: key, value, kind.
_ODD = [("第{}章", "x", "artifact"), ("{}年3月4日", "x", "artifact"), ("{}万人", "x", "artifact"), ("{}个", "x", "artifact"), ("a{}", "www.b.vn", "junk"), ("a{}", "qidian {}", "junk"), ("b{}", "Chương {}", "artifact"), ("b{}", "()", "junk"), ("ok{}", "tốt {}", "ok"), ("{}abc", "x{}", "ok")]


def entry_filters(spark: SparkSession, sf: str) -> DataFrame:
    """Junk, artefacts and number units told apart on rows made of order keys."""
    n = F.col("o_orderkey").cast("string")
    fill = lambda t: F.replace(F.lit(t), F.lit("{}"), n)
    pick = F.element_at(F.array(*[F.concat(fill(k), F.lit("="), fill(v)) for k, v, _ in _ODD]), (F.col("o_orderkey") % len(_ODD) + 1).cast("int"))
    lines = table(spark, sf, "orders").select(F.lit("odd").alias("label"), F.lit(1).alias("prio"), F.col("o_orderkey").alias("line_no"), pick.alias("text"))
    return L.parse_phrases(lines, True).select("line_no", "status")


_FILTERS = f"SELECT o_orderkey AS line_no, [{', '.join(_Q + k + _Q for *_, k in _ODD)}][o_orderkey % {len(_ODD)} + 1] AS status FROM orders"


def user_overrides(spark: SparkSession, sf: str) -> DataFrame:
    """Orders stand for entries on two tracks, customers for novels."""
    rows = table(spark, sf, "orders").select(F.col("o_custkey").alias("novel_id"), F.col("o_orderpriority").alias("phrase"), F.col("o_orderstatus").alias("value"), F.lit("NONE").alias("cap"), F.col("o_orderkey").alias("updated_at"))
    novels = table(spark, sf, "customer").where("c_custkey % 2 = 0").select(F.col("c_custkey").alias("novel_id"), F.lower("c_name").alias("slug"))
    return S.user_overrides(rows.where("updated_at % 2 = 0"), rows.where("updated_at % 2 = 1"), novels)


_USER = """SELECT o_orderpriority AS phrase, o_orderstatus AS value, 'NONE' AS cap, o_orderkey AS updated_at, CASE WHEN o_orderkey % 2 = 0 THEN 'phrase' ELSE 'name' END AS track, lower(c_name) AS slug
FROM orders JOIN customer ON c_custkey = o_custkey WHERE c_custkey % 2 = 0"""


def overlay_personal(spark: SparkSession, sf: str) -> DataFrame:
    """A reader's entries over the tokens of the documents of their novels."""
    lines = table(spark, sf, "documents").select("doc_id", F.col("source").alias("novel_id"), "text")
    tokens = M.tokenize(lines, Q._lexicon(spark), Q._readings(spark), fields=("pos", "len", "src", "dst", "source", "reading"))
    entries = spark.createDataFrame([(n, p, f"{p}/x", "ALL_WORDS", k) for n in _NOVELS for k, p in enumerate(("on the", "er", " the ", "and"))], "novel_id string, phrase string, value string, cap string, ord int")
    shown = F.array_join(F.transform("tokens", lambda t: t["dst"]), "|")
    return S.overlay_personal(tokens, entries, ["doc_id"]).select("doc_id", F.size("tokens").alias("n_tokens"), F.md5(shown).alias("shown_md5"))


def page_translation(spark: SparkSession, sf: str) -> DataFrame:
    """Shown pieces of text of whole pages, translated."""
    out = S.translate_pages(table(spark, sf, "pages").select("page_id", "url", "html"), Q._lexicon(spark), Q._readings(spark))
    return out.select("page_id", "node", F.md5("translated").alias("translated_md5"))


def imported_chapters(spark: SparkSession, sf: str) -> DataFrame:
    """Documents stand for files of their source's novel."""
    files = table(spark, sf, "documents").select(F.concat_ws("/", "source", F.format_string("%012d", "doc_id")).alias("path"), F.encode("text", "utf-8").alias("content"))
    stored = table(spark, sf, "documents").groupBy(F.col("source").alias("novel_id")).agg(F.count("*").alias("chapter_number"))
    out = J.import_files(files, stored, F.substring_index("path", "/", 1))
    return out.select("novel_id", "chapter_number", "title", "language", "status", F.md5("raw_text").alias("raw_md5"))


def _dictionary_lines(spark: SparkSession, sf: str) -> DataFrame:
    """Lines of eleven sources in six formats, made of parts, customers and suppliers."""
    part, people, firms = table(spark, sf, "part"), table(spark, sf, "customer"), table(spark, sf, "supplier")
    key = F.col("p_partkey")
    n = key.cast("string")
    row = lambda df, at, kind, form, label, prio, text: df.select(F.lit(kind).alias("kind"), F.lit(form).alias("format"), F.lit(label).alias("label"), F.lit(prio).alias("prio"), F.col(at).cast("long").alias("line_no"), text.alias("text"))
    eq, bar = F.lit("="), F.lit(" | ")
    odd = F.when(F.col("p_size") % 7 == 0, F.concat(F.lit("第"), n, F.lit("章=x"))).when(F.col("p_size") % 7 == 1, F.concat(F.lit("// "), "p_name")).when(F.col("p_size") % 7 == 2, F.concat(n, F.lit("万人="), "p_brand"))
    cedict = F.concat(F.replace("p_name", F.lit(" "), F.lit("-")), F.lit(" "), F.replace("p_brand", F.lit(" "), F.lit("-")), F.lit(" [p] /"), F.lower("p_type"), F.lit(" (CL:x); rest/to "), F.col("p_size").cast("string"), F.lit("./"))
    csv = F.concat(F.substring("p_type", 1, 1), F.lit(",\"['"), F.lower("p_brand"), F.lit("', '"), F.substring("p_name", 1, 3), F.lit("']\",pin"))
    black = F.when(F.col("p_size") % 5 == 0, F.concat(F.lit("# "), "p_brand")).otherwise(F.concat(F.lit("  "), "p_brand", F.lit(" ")))
    parts = [
        row(part, "p_partkey", "word", "phrases", "types", 1, odd.otherwise(F.concat("p_name", eq, "p_type", bar, "p_brand"))),
        row(people, "c_custkey", "word", "phrases", "people", 2, F.concat("c_name", eq, F.when(F.col("c_nationkey") % 5 == 0, "www.site.com").otherwise(F.col("c_mktsegment")))),
        row(part, "p_partkey", "word", "cedict", "gaps", 9, cedict),
        row(part, "p_partkey", "name", "phrases", "brands", 1, odd.otherwise(F.concat("p_brand", F.lit(" = e\u0301"), "p_name"))),
        row(firms, "s_suppkey", "pronoun", "phrases", "firms", 1, F.concat(F.lit("第"), F.col("s_nationkey").cast("string"), F.lit("章="), "s_name")),
        row(part, "p_partkey", "reading", "readings", "listed", 1, csv),
        row(part, "p_partkey", "reading", "simple", "simple", 2, F.concat(F.substring("p_name", 1, 1), F.lit(" = "), F.lower("p_type"))),
        row(part, "p_partkey", "reading", "classical", "classical", 3, F.concat(F.substring("p_name", 2, 1), eq, F.lower("p_brand"), F.lit(", x [note]"))),
        row(part, "p_partkey", "blacklist", "blacklist", "parts", 1, black),
        row(people, "c_custkey", "blacklist", "blacklist", "people", 2, F.concat(F.lit("Brand#"), (F.col("c_custkey") % 60).cast("string"))),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def dictionary_build(spark: SparkSession, sf: str) -> DataFrame:
    """Every table of a dictionary built from its sources' lines, as rows: name, key, value, source."""
    d = L.build_dictionary(_dictionary_lines(spark, sf), spark.createDataFrame([("E", "é"), ("S", "s"), ("P", "P")], "ch string, simple string"))
    row = lambda df, name, key, value: df.select(name.alias("name"), F.col(key).alias("key"), value.alias("value"), "source")
    out = row(d.lexicon, F.col("kind"), "phrase", F.col("value")).unionByName(row(d.readings, F.lit("reading"), "ch", F.col("readings")))
    return out.unionByName(row(d.blacklist, F.lit("blacklist"), "pattern", F.lit(None).cast("string")))


_DICTIONARY = r"""WITH w AS (SELECT 1 AS prio, p_partkey AS n, p_name AS phrase, p_type || '/' || p_brand AS value, 'types' AS source FROM part WHERE p_size % 7 > 2
UNION ALL SELECT 2, c_custkey, c_name, c_mktsegment, 'people' FROM customer WHERE c_nationkey % 5 > 0
UNION ALL SELECT 9, p_partkey, unnest([replace(p_name, ' ', '-'), replace(p_brand, ' ', '-')]), lower(p_type) || '/to ' || p_size, 'gaps' FROM part),
e AS (SELECT p_brand AS phrase, 'é' || p_name AS value, p_partkey AS n FROM part WHERE p_size % 7 > 2),
l AS (SELECT p_partkey AS n, substr(p_type, 1, 1) AS ch, unnest([lower(p_brand), substr(p_name, 1, 3)]) AS reading, unnest([0, 1]) AS k FROM part WHERE p_partkey > 0),
v AS (SELECT 0 AS late, * FROM l UNION ALL SELECT 1, n, CASE ch WHEN 'E' THEN 'é' ELSE 's' END, reading, k FROM l WHERE ch IN ('E', 'S')),
f AS (SELECT ch, reading, min((late, n, k)) AS first FROM v WHERE reading <> '' GROUP BY ch, reading), a AS (SELECT ch, string_agg(reading, ',' ORDER BY first) AS readings FROM f GROUP BY ch),
b AS (SELECT substr(p_name, 1, 1) AS ch, arg_min(lower(p_type), p_partkey) AS readings FROM part WHERE trim(substr(p_name, 1, 1)) <> '' GROUP BY 1), c AS (SELECT substr(p_name, 2, 1) AS ch, arg_min(lower(p_brand), p_partkey) AS readings FROM part WHERE trim(substr(p_name, 2, 1)) <> '' GROUP BY 1),
x AS (SELECT p_brand AS pattern, 'parts' AS source FROM part WHERE p_size % 5 > 0 UNION SELECT 'Brand#' || (c_custkey % 60), 'people' FROM customer)
SELECT 'word' AS name, phrase AS key, arg_min(value, (prio, n)) AS value, arg_min(source, (prio, n)) AS source FROM w GROUP BY phrase
UNION ALL SELECT 'name', phrase, arg_min(value, n), 'brands' FROM e GROUP BY phrase
UNION ALL SELECT 'pronoun', '第' || s_nationkey || '章', arg_min(s_name, s_suppkey), 'firms' FROM supplier GROUP BY s_nationkey
UNION ALL SELECT 'reading', ch, readings, 'listed' FROM a UNION ALL SELECT 'reading', ch, readings, 'simple' FROM b WHERE ch NOT IN (SELECT ch FROM a)
UNION ALL SELECT 'reading', ch, readings, 'classical' FROM c WHERE ch NOT IN (SELECT ch FROM a) AND ch NOT IN (SELECT ch FROM b)
UNION ALL SELECT 'blacklist', pattern, NULL, min(source) FROM x GROUP BY pattern"""


BUILT = {
    "dictionary_build": (dictionary_build, _DICTIONARY), "reader_translations": (reader_translations, _reader_twin()), "changed_since_edits": (changed_since_edits, _SINCE), "versions_as_of": (versions_as_of, _AS_OF),
    "user_overrides": (user_overrides, _USER), "overlay_personal": (overlay_personal, None), "page_translation": (page_translation, None), "imported_chapters": (imported_chapters, None),
    "translate_text": (translate_text, _TEXT), "reading_of_text": (reading_of_text, _READING), "tokenize_raw": (tokenize_raw, _RAW), "translate_corpus": (translate_corpus, _CORPUS), "translate_changed": (translate_changed, _CHANGED),
    "retranslate_titles": (retranslate_titles, _TITLES), "backfill_titles": (backfill_titles, _BACKFILL), "book_gate": (book_gate, _GATE), "cedict_parse": (cedict_parse, _CEDICT), "readings_merge": (readings_merge, _READINGS),
    "category_split": (category_split, _SPLIT), "category_report": (category_report, _SPLIT_REPORT), "blacklist_merge": (blacklist_merge, _PATTERNS), "entry_filters": (entry_filters, _FILTERS),
}
