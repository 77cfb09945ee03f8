"""Jobs over whole corpora: routing by language, translation with a layer for each novel, and what changed since."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as X
from ..functions import urls as U
from ..sources.files import decode_files
from . import chapters as C
from . import library as B
from . import match as M
from . import overrides as O


def scoped_lexicon(lexicon: DataFrame, overrides: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The lexicon with the global layer on top (cap styles included), and the layers of single novels (scope, phrase, value, cap).

    A novel's own entry always comes before a global one, so global entries needn't be repeated for each novel.
    """
    shared, own = O.split_layers(overrides)
    top = shared.select("phrase", "value", F.lit("override").alias("kind"), F.lit(1).alias("prio"), "cap")
    return lexicon.select("phrase", "value", "kind", "prio", F.lit(None).cast("string").alias("cap")).unionByName(top), own


def translate_corpus(chapters: DataFrame, lexicon: DataFrame, readings: DataFrame, overrides: DataFrame, needs: Column | None = None) -> DataFrame:
    """chapters (novel_id, text, ...) and `translated`, each with its novel's own layer; rows that don't need it keep their text."""
    needs = F.coalesce(X.detect_language(F.col("text")) == "ZH" if needs is None else needs, F.lit(False))
    full, layers = scoped_lexicon(lexicon, overrides)
    out = M.translate_text(chapters.where(needs), full, readings, layers, "novel_id")
    return out.unionByName(chapters.where(~needs).withColumn("translated", F.col("text")))


def changed_rows(chapters: DataFrame, state: DataFrame, version: int, key: str = "chapter_id") -> DataFrame:
    """Rows whose text or dictionary version isn't that of the state (key, version, hash); with their new `hash`."""
    known = state.select(F.col(key).alias("_key"), F.col("version").alias("_version"), F.col("hash").alias("_hash"))
    rows = chapters.withColumn("hash", X.content_hash(F.col("text"))).join(known, F.col(key) == F.col("_key"), "left")
    return rows.where(~(F.col("_version").eqNullSafe(F.lit(version)) & F.col("_hash").eqNullSafe(F.col("hash")))).drop("_key", "_version", "_hash")


def changed_since(chapters: DataFrame, state: DataFrame, edits: DataFrame, key: str = "chapter_id", seen: str = "seen_at") -> DataFrame:
    """Rows to translate again by the edit log: new rows, other texts, and those whose version when they were last translated isn't the one now.

    state: key, hash and `seen` (the place in the log, `seq`, of their translation).  Adds hash and version (the one now).
    """
    now = O.dictionary_version(edits).select(F.col("version").alias("_now"))  # one row
    then = O.version_as_of(state.select(key, F.col("hash").alias("_hash"), F.col(seen).alias("_seen")), edits, "_seen", "_then")
    rows = chapters.withColumn("hash", X.content_hash(F.col("text"))).join(then.withColumnRenamed(key, "_key"), F.col(key) == F.col("_key"), "left").join(F.broadcast(now))
    fresh = F.col("_hash").eqNullSafe(F.col("hash")) & F.col("_then").eqNullSafe(F.col("_now"))
    return rows.where(~fresh).withColumn("version", F.col("_now")).drop("_key", "_hash", "_seen", "_then", "_now")


def translate_changed(chapters: DataFrame, state: DataFrame, version: int, lexicon: DataFrame, readings: DataFrame, overrides: DataFrame, key: str = "chapter_id", needs: Column | None = None) -> DataFrame:
    """Translations of changed rows, with version and hash: what is appended to the state."""
    return translate_corpus(changed_rows(chapters, state, version, key), lexicon, readings, overrides, needs).withColumn("version", F.lit(version))


def retranslate(rows: DataFrame, original: str, target: str, lexicon: DataFrame, readings: DataFrame, overrides: DataFrame | None = None, novel_col: str = "novel_id") -> DataFrame:
    """`target` anew from `original` where that isn't empty, with the global layer and that of the row's novel; other rows stay."""
    known = F.coalesce(F.col(original) != "", F.lit(False))
    full, layers = (lexicon, None) if overrides is None else scoped_lexicon(lexicon, overrides)
    new = M.translate_text(rows.where(known).withColumn("text", F.col(original)), full, readings, layers, None if layers is None else novel_col)
    return new.withColumn(target, F.col("translated")).select(rows.columns).unionByName(rows.where(~known))


def backfill_titles(chapters: DataFrame, lexicon: DataFrame, readings: DataFrame) -> DataFrame:
    """title, original_title, source_chapter_id, source_url: what is missing from what is there; titles that had no original are translated."""
    lacks = F.col("original_title").isNull()
    new = M.tokenize_raw(chapters.withColumn("text", F.when(lacks, F.col("title"))), lexicon, readings)
    filled = {"original_title": F.coalesce("original_title", "title"), "title": F.when(lacks & F.col("title").isNotNull(), F.col("shown")).otherwise(F.col("title")), "source_chapter_id": F.coalesce("source_chapter_id", U.source_chapter_id(F.col("source_url")))}
    return new.select(*[filled.get(c, F.col(c)).alias(c) for c in chapters.columns])


def refresh_meta(novels: DataFrame, meta: DataFrame, key: str = "novel_id") -> DataFrame:
    """New author, cover and title where there is one; the description is taken over even where it is null."""
    new = meta.select(F.col(key).alias("_key"), *[F.col(c).alias(f"_{c}") for c in ("title", "author", "cover", "description")])
    rows = novels.join(new, F.col(key) == F.col("_key"), "left")
    take = {c: F.coalesce(f"_{c}", c) for c in ("title", "author", "cover")}
    take["description"] = F.when(F.col("_key").isNotNull(), F.col("_description")).otherwise(F.col("description"))
    return rows.select(*[take.get(c, F.col(c)).alias(c) for c in novels.columns])


def new_rows(fetched: DataFrame, stored: DataFrame, keys: list[str]) -> DataFrame:
    """Fetched rows whose keys aren't stored; stored nulls match nothing."""
    return fetched.join(stored.select(*keys).distinct(), keys, "left_anti")


def append_new_chapters(fetched: DataFrame, stored: DataFrame, lexicon: DataFrame, readings: DataFrame) -> DataFrame:
    """fetched: novel_id, url, at, title.  Those that aren't stored, numbered after the stored ones, titles translated without layers."""
    fresh = B.number_appended(new_rows(fetched, stored, ["novel_id", "url"]), stored, "novel_id", "chapter_number", ["at"])
    out = M.translate_text(fresh.withColumn("text", F.col("title")), lexicon, readings)
    return out.select("novel_id", "url", "chapter_number", F.col("title").alias("original_title"), F.col("translated").alias("title"))


def create_novels(given: DataFrame, taken: DataFrame) -> DataFrame:
    """given: novel_id, title, description.  Cleaned, with a slug of the title; the originals are the given texts."""
    clean = given.select("novel_id", X.sanitize(F.col("title")).alias("title"), X.sanitize(F.col("description")).alias("description"))
    based = clean.withColumn("base", X.slugify(F.col("title")))
    out = B.assign_slugs(based, taken, "base", ["novel_id"])
    return out.select("novel_id", "slug", "title", "description", F.col("title").alias("original_title"), F.col("description").alias("original_description"))


def validate_book(books: DataFrame, chapters: DataFrame, cls: str = X.HAN) -> DataFrame:
    """books (book_id, title, description) and `reason`: null, `no title`, or `no text of the script` in it or the first three chapter titles."""
    first = F.row_number().over(Window.partitionBy("book_id").orderBy("chapter_number"))
    heads = chapters.withColumn("_k", first).where("_k <= 3").groupBy("book_id").agg(F.concat_ws(" ", F.collect_list("title")).alias("_heads"))
    text = F.concat_ws(" ", "title", "description", "_heads")
    reason = F.when(X.trim_all(F.coalesce("title", F.lit(""))) == "", "no title").when(~text.rlike(cls), "no text of the script")
    return books.join(heads, "book_id", "left").withColumn("reason", reason).drop("_heads")


def edit_chapters(base: DataFrame, edits: DataFrame, key: str = "chapter_id") -> DataFrame:
    """base: key, text, language, status.  edits: key, seq, text (null: fetch again).  The last edit wins: texts are cleaned and their language told, fetched ones lose text and status."""
    last = edits.groupBy(key).agg(F.max(F.struct("seq", "text")).alias("_e"))
    clean = X.sanitize(F.col("_e.text"))
    rows, hit = base.join(last, key, "left"), F.col("_e").isNotNull()
    new = {"text": clean, "language": F.when(clean.isNotNull(), X.detect_language(clean)).otherwise(F.col("language")), "status": F.when(clean.isNotNull(), F.lit("SCRAPED")).otherwise(F.lit("PENDING"))}
    return rows.select(*[F.when(hit, new[c]).otherwise(F.col(c)).alias(c) if c in new else F.col(c) for c in base.columns])


def chunk_texts(docs: DataFrame, heading: Column | None = None) -> DataFrame:
    """docs: doc_id, text.  doc_id, chapter_number, title, raw_text: by headings where there are some, else by size; long ones are cut."""
    is_head = X.is_heading(F.col("text")) if heading is None else heading
    lines = docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("line", "text")).withColumn("_h", is_head)
    headed = lines.where("_h").select("doc_id").distinct()
    by_head = C.cap_oversized(C.split_by_headings(lines.join(headed, "doc_id", "left_semi").drop("_h"), is_head))
    by_size = C.split_by_size(docs.join(headed, "doc_id", "left_anti"))
    return by_head.unionByName(by_size.select("doc_id", F.col("piece").alias("chapter_number"), F.concat(F.lit("Chương "), "piece").alias("title"), F.col("text").alias("raw_text")))


def import_files(files: DataFrame, stored: DataFrame, novel: Column, heading: Column | None = None) -> DataFrame:
    """Chapters of novel files (path, content): novel_id, chapter_number after the stored ones, title, original_title, raw_text, language, status."""
    texts = decode_files(files).select(F.col("path").alias("doc_id"), "text")
    cut = chunk_texts(texts, heading).select(F.col("doc_id").alias("path"), F.col("chapter_number").alias("at"), X.sanitize(F.col("title")).alias("title"), X.sanitize(F.col("raw_text")).alias("raw_text"))
    rows = B.number_appended(cut.withColumn("novel_id", novel), stored, "novel_id", "chapter_number", ["path", "at"])
    return rows.select("novel_id", "chapter_number", "title", F.col("title").alias("original_title"), "raw_text", X.detect_language(F.col("raw_text")).alias("language"), F.lit("SCRAPED").alias("status"))


def append_chapters(rows: DataFrame, path: str) -> None:
    """Add numbered chapters to the stored ones."""
    rows.write.mode("append").parquet(path)
