"""Building a lexicon from noisy key=value lines of many sources."""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from ..plans.scratch import dealt, materialize


def _apart(df: DataFrame, **columns: Column) -> DataFrame:
    """Add columns that later expressions read often: evaluated once, as a lambda's argument isn't inlined."""
    for name, c in columns.items():
        df = df.withColumn(name, F.element_at(F.transform(F.array(c), lambda x: x), 1))
    return df


def parse_phrases(lines: DataFrame, filter_artifacts: bool | Column = False, also: tuple[str, ...] = ()) -> DataFrame:
    """lines: label, prio, line_no, text (and the columns `also`).  Adds phrase, value (both composed, NFC) and status (ok, malformed, junk, artifact)."""
    names = [*also, "label", "prio", "line_no"]
    t, k, v = F.col("_t"), F.col("_k"), F.col("_v")
    strict = F.lit(filter_artifacts) if isinstance(filter_artifacts, bool) else filter_artifacts
    rows = _apart(dealt(lines.select(*names, "text", strict.alias("_strict"))), _t=X.trim_all(F.regexp_replace("text", r"^\x{FEFF}", "")))
    at = F.instr(t, "=")
    rows = _apart(rows, _k=F.substring(t, F.lit(1), at - 1), _v=X.normalize_alternatives(F.substring(t, at + 1, F.length(t))))
    rows = _apart(rows.withColumns({"_k": X.nfc(k), "_v": X.nfc(v)}), _k=k, _v=v)
    bad = (t == "") | (at == 0) | t.startswith("#") | t.startswith("//") | (k == "")
    status = F.when(bad, "malformed").when(X.is_junk(k, v, trimmed=True), "junk")
    if filter_artifacts is not False:
        status = status.when(F.col("_strict") & X.is_artifact(k, v, trimmed=True), "artifact")
    return rows.select(*names, F.when(~bad, k).alias("phrase"), F.when(~bad, v).alias("value"), status.otherwise("ok").alias("status"))


def merge_sources(parsed: DataFrame) -> DataFrame:
    """First source, then first line, wins a phrase: phrase, value, source, len."""
    best = parsed.where("status = 'ok'").groupBy("phrase").agg(F.min(F.struct("prio", "line_no", "value", "label")).alias("b"))
    return best.select("phrase", F.col("b.value").alias("value"), F.col("b.label").alias("source"), F.length("phrase").alias("len"))


def build_report(parsed: DataFrame) -> DataFrame:
    """Per source: lines by status, distinct phrases, and how many of them the source wins."""
    parsed = materialize(parsed, "parsed")  # parsed once, read twice
    is_ = lambda s: F.count(F.when(F.col("status") == s, 1))
    counts = parsed.groupBy("label").agg(is_("malformed").alias("malformed"), is_("junk").alias("junk"), is_("artifact").alias("artifact"), F.countDistinct(F.when(F.col("status") == "ok", F.col("phrase"))).alias("phrases"))
    won = merge_sources(parsed).groupBy(F.col("source").alias("label")).agg(F.count("*").alias("won"))
    return counts.join(won, "label", "left").withColumn("won", F.coalesce("won", F.lit(0)))


def fill_gaps(base: DataFrame, extra: DataFrame, key: str = "phrase") -> DataFrame:
    return base.unionByName(extra.join(base.select(key), key, "left_anti").select(base.columns))


def merge_readings(rows: DataFrame) -> DataFrame:
    """rows: ch, ord, reading.  Distinct readings in order, comma-joined: ch, readings."""
    ordered = F.array_distinct(F.transform(F.sort_array(F.collect_list(F.struct("ord", "reading"))), lambda x: x["reading"]))
    return rows.groupBy("ch").agg(F.array_join(ordered, ",").alias("readings"))


def cedict_rows(lines: DataFrame, names: list[str]) -> DataFrame:
    """text of `trad simp [pinyin] /d1/d2/`: the columns `names`, phrase, value; a row for each script."""
    head = r"^(\S+)\s+(\S+)\s+\[[^\]]*\]\s+/(.*)/\s*$"
    part = lambda k: F.regexp_extract("text", head, k)

    def clean(d: Column) -> Column:
        d = F.regexp_replace(F.substring_index(F.substring_index(d, ";", 1), "/", 1), r"\([^)]*\)", "")
        return F.regexp_replace(F.regexp_replace(d, r"\s+", " "), r"^[ ,.]+|[ ,.]+$", "")

    value = F.array_join(F.filter(F.transform(F.split(part(3), "/"), clean), lambda d: d != ""), "/")
    rows = lines.where((~F.col("text").startswith("#")) & F.col("text").rlike(head)).select(*names, value.alias("value"), F.explode(F.array_distinct(F.array(part(1), part(2)))).alias("phrase"))
    return rows.where("value <> ''").select(*names, X.nfc(F.col("phrase")).alias("phrase"), "value").where("phrase <> ''")


def parse_cedict(lines: DataFrame) -> DataFrame:
    """line_no, text: phrase, value under both scripts, first line wins."""
    return cedict_rows(lines, ["line_no"]).groupBy("phrase").agg(F.min_by("value", "line_no").alias("value"))


def write_lexicon(lexicon: DataFrame, path: str) -> None:
    lexicon.dropDuplicates(["kind", "phrase"]).repartition("kind").sortWithinPartitions("kind", "len").write.mode("overwrite").partitionBy("kind").parquet(path)


def parse_readings_csv(lines: DataFrame) -> DataFrame:
    """line_no, ch, listed (a literal list such as "['a', 'b']"): ch, ord, reading, in order."""
    readings = F.regexp_extract_all("listed", F.lit(r"['\"]([^'\"]*)['\"]"), F.lit(1))
    rows = lines.select("line_no", "ch", F.posexplode(readings).alias("at", "reading")).where("reading <> ''")
    return rows.select("ch", F.struct("line_no", "at").alias("ord"), "reading")


def parse_simple_readings(lines: DataFrame) -> DataFrame:
    """line_no, text of `char=reading`: ch, reading; keys of one character, first line wins."""
    at = F.instr("text", "=")
    ch, reading = X.trim_all(F.substring("text", F.lit(1), at - 1)), X.trim_all(F.substring("text", at + 1, F.length("text")))
    rows = lines.where(at > 0).select("line_no", ch.alias("ch"), reading.alias("reading")).where("length(ch) = 1 AND reading <> ''")
    return rows.groupBy("ch").agg(F.min_by("reading", "line_no").alias("reading"))


def parse_classical_readings(lines: DataFrame) -> DataFrame:
    """line_no, text of `char=reading, ... [notes]`: the first reading before a literal \\n or a bracket; first line wins."""
    at = F.instr("text", "=")
    rest = F.get(F.split(F.substring("text", at + 1, F.length("text")), r"\\n|\["), F.lit(0))
    rows = lines.where(at > 0).select("line_no", X.trim_all(F.substring("text", F.lit(1), at - 1)).alias("ch"), X.trim_all(F.substring_index(rest, ",", 1)).alias("reading"))
    return rows.where("length(ch) = 1 AND reading <> ''").groupBy("ch").agg(F.min_by("reading", "line_no").alias("reading"))


def parse_blacklist(lines: DataFrame) -> DataFrame:
    """label, prio, line_no, text: the patterns; blank lines, comments and the heading go."""
    t = X.trim_all(F.col("text"))
    return lines.select("label", "prio", "line_no", t.alias("pattern")).where("pattern <> '' AND NOT startswith(pattern, '#') AND NOT startswith(pattern, '//') AND NOT startswith(pattern, 'BLACKLIST')")


def merge_patterns(parsed: DataFrame) -> DataFrame:
    """pattern, source: the first source that has it."""
    return parsed.groupBy("pattern").agg(F.min(F.struct("prio", "line_no", "label")).alias("b")).select("pattern", F.col("b.label").alias("source"))


def expand_variants(rows: DataFrame, char_map: DataFrame) -> DataFrame:
    """rows: ch, ord, reading.  Each key also under its simplified form (char_map: ch, simple), after its own readings there: ch, ord, reading."""
    more = rows.join(char_map, "ch").where("simple <> ch").select(F.col("simple").alias("ch"), F.struct(F.lit(1).alias("late"), "ord").alias("ord"), "reading")
    return rows.select("ch", F.struct(F.lit(0).alias("late"), "ord").alias("ord"), "reading").unionByName(more)


# The categories of the old single table.
CATEGORIES = ("word", "name", "pronoun")


def split_by_category(entries: DataFrame, categories: tuple[str, ...] = CATEGORIES) -> DataFrame:
    """entries: id, phrase, value, category, source.  kind, phrase, value, source; the first id wins a phrase of a kind, empty phrases and unknown categories go."""
    known = entries.where(F.col("category").isin(*categories))
    rows = known.select("id", F.col("category").alias("kind"), X.nfc(F.col("phrase")).alias("phrase"), X.nfc(F.col("value")).alias("value"), "source").where("phrase <> ''")
    best = rows.groupBy("kind", "phrase").agg(F.min(F.struct("id", "value", "source")).alias("b"))
    return best.select("kind", "phrase", "b.value", "b.source")


def split_report(entries: DataFrame, categories: tuple[str, ...] = CATEGORIES) -> DataFrame:
    """Per category: rows, those without a phrase, distinct phrases of the rest, and whether the category is known."""
    empty = X.trim_all(F.coalesce("phrase", F.lit(""))) == ""
    return entries.groupBy("category").agg(F.count("*").alias("n"), F.count(F.when(empty, 1)).alias("n_empty"), F.countDistinct(F.when(~empty, X.nfc(F.col("phrase")))).alias("n_phrases")).withColumn("known", F.col("category").isin(*categories))


# building all tables from the lines of all sources

_FROM = ["kind", "label", "prio", "line_no"]
#: In every kind but pronouns, entries that are chapter headings, dates or amounts are artefacts.
KINDS = {"name": 2, "pronoun": 3, "word": 4}


def _phrase_lines(lines: DataFrame) -> DataFrame:
    return parse_phrases(lines, F.col("kind") != "pronoun", ("kind",))


def _cedict_lines(lines: DataFrame) -> DataFrame:
    return cedict_rows(lines, _FROM).withColumn("status", F.lit("ok")).select(*_FROM, "phrase", "value", "status")


def _reading_rows(lines: DataFrame, rows: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Readings of a source: kind, label, prio, line_no, phrase (the character), value, status; the first line of each wins."""
    sources = lines.select(*_FROM[:3]).distinct()
    out = None
    for kind, label, prio in sources.collect():  # a row a source
        own = rows(lines.where((F.col("label") == label) & (F.col("prio") == prio)))
        own = own.select(F.lit(kind).alias("kind"), F.lit(label).alias("label"), F.lit(prio).alias("prio"), F.lit(0).cast("long").alias("line_no"), F.col("ch").alias("phrase"), F.col("reading").alias("value"), F.lit("ok").alias("status"))
        out = own if out is None else out.unionByName(own)
    return out


def _csv_lines(lines: DataFrame) -> DataFrame:
    """Lines of `character,list,pinyin` after a heading; every reading is a row, in order."""
    fields = lines.where("line_no > 0").withColumn("_f", F.from_csv("text", "ch string, listed string, pinyin string"))
    readings = F.regexp_extract_all(F.col("_f.listed"), F.lit(r"['\"]([^'\"]*)['\"]"), F.lit(1))
    rows = fields.select(*_FROM, F.col("_f.ch").alias("phrase"), F.posexplode(readings).alias("at", "value")).where("value <> ''")
    return rows.select("kind", "label", "prio", (F.col("line_no") * 1000 + F.col("at")).alias("line_no"), "phrase", "value", F.lit("listed").alias("status"))


def _blacklist_lines(lines: DataFrame) -> DataFrame:
    return parse_blacklist(lines).select(F.lit("blacklist").alias("kind"), "label", "prio", "line_no", F.col("pattern").alias("phrase"), F.lit(None).cast("string").alias("value"), F.lit("ok").alias("status"))


#: A parser for each format: lines (kind, label, prio, line_no, text) to kind, label, prio, line_no, phrase, value, status.  More can be given.
PARSERS: dict[str, Callable[[DataFrame], DataFrame]] = {
    "phrases": _phrase_lines,
    "cedict": _cedict_lines,
    "readings": _csv_lines,
    "simple": lambda lines: _reading_rows(lines, parse_simple_readings),
    "classical": lambda lines: _reading_rows(lines, parse_classical_readings),
    "blacklist": _blacklist_lines,
}


class Dictionary(NamedTuple):
    """lexicon: phrase, value, kind, prio, source, len.  readings: ch, readings, source.  blacklist: pattern, source.  report: kind, label and lines by status."""

    lexicon: DataFrame
    readings: DataFrame
    blacklist: DataFrame
    report: DataFrame


def build_dictionary(lines: DataFrame, char_map: DataFrame | None = None, parsers: dict[str, Callable[[DataFrame], DataFrame]] = PARSERS) -> Dictionary:
    """All tables of a dictionary from the lines of all sources.

    lines: kind (word, name, pronoun, reading, blacklist), format (a key of parsers), label and prio (of the source, the
    first wins; a source that fills gaps comes last), line_no, text.  Listed readings also stand under the
    simplified form of their character (char_map: ch, simple), and come before all others.
    """
    parsed = None
    for name, parse in parsers.items():
        rows = parse(lines.where(F.col("format") == name))
        if rows is not None:
            parsed = rows if parsed is None else parsed.unionByName(rows)
    parsed = materialize(parsed, "parsed")
    best = parsed.where(F.col("kind").isin(*KINDS) & (F.col("status") == "ok")).groupBy("kind", "phrase").agg(F.min(F.struct("prio", "line_no", "value", "label")).alias("b"))
    prio = F.element_at(F.create_map(*[F.lit(x) for kv in KINDS.items() for x in kv]), F.col("kind"))
    lexicon = best.select("phrase", "b.value", "kind", prio.alias("prio"), F.col("b.label").alias("source"), F.length("phrase").alias("len"))

    reading = parsed.where("kind = 'reading'")
    listed = reading.where("status = 'listed'").select(F.col("phrase").alias("ch"), F.struct("prio", "line_no").alias("ord"), F.col("value").alias("reading"))
    listed = listed if char_map is None else expand_variants(listed, char_map)
    label = reading.where("status = 'listed'").agg(F.coalesce(F.min_by("label", "prio"), F.lit("listed")).alias("source"))  # one row
    first = merge_readings(listed).join(F.broadcast(label))
    gaps = reading.where("status = 'ok'").groupBy(F.col("phrase").alias("ch")).agg(F.min(F.struct("prio", "value", "label")).alias("b")).select("ch", F.col("b.value").alias("readings"), F.col("b.label").alias("source"))
    readings = fill_gaps(first, gaps, "ch")

    blacklist = merge_patterns(parsed.where("kind = 'blacklist'").select("label", "prio", "line_no", F.col("phrase").alias("pattern")))
    report = parsed.groupBy("kind", "label", "status").agg(F.count("*").alias("n"))
    return Dictionary(lexicon, readings, blacklist, report)


def write_dictionary(tables: Dictionary, path: str) -> None:
    """The tables under a folder: lexicon (by kind, short phrases first), readings, blacklist."""
    write_lexicon(tables.lexicon, f"{path}/lexicon")
    tables.readings.write.mode("overwrite").parquet(f"{path}/readings")
    tables.blacklist.write.mode("overwrite").parquet(f"{path}/blacklist")


def build_lexicon(words: DataFrame, names: DataFrame, pronouns: DataFrame) -> DataFrame:
    """From the lines of each kind's phrase sources (label, prio, line_no, text) one lexicon: phrase, value, kind, prio, source, len."""
    out = None
    for kind, lines in (("word", words), ("name", names), ("pronoun", pronouns)):
        own = lines.select(F.lit(kind).alias("kind"), F.lit("phrases").alias("format"), "label", "prio", "line_no", "text")
        out = own if out is None else out.unionByName(own)
    return build_dictionary(out, parsers={"phrases": _phrase_lines}).lexicon
