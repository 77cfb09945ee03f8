"""Lines into chapters, and line filters."""

from __future__ import annotations

import re
from collections.abc import Iterator
from uuid import uuid4

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Characters that end a sentence; a piece aims at TARGET characters and may run on by OVERRUN to reach one.
_SENTENCE_END = re.compile("[。！？.!?]")
TARGET, OVERRUN = 3000, 1500


def _pieces(text: str, target: int, overrun: int) -> list[str]:
    out, start = [], 0
    while start < len(text):
        end = start + target
        if end < len(text):
            hit = _SENTENCE_END.search(text, end, end + overrun)
            end = hit.end() if hit else end
        out.append(text[start:end].strip())
        start = end
    return [p for p in out if p]


def split_by_size(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", target: int = TARGET, overrun: int = OVERRUN) -> DataFrame:
    """The id, piece (from 1) and text: pieces of about `target` characters that end with a sentence where one ends soon enough.

    Pieces are trimmed, blank ones go; null and blank texts have none.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 200):
                part = batch.slice(start, 200)
                cut = [_pieces(t or "", target, overrun) for t in part.column(1).to_pylist()]
                rows = pa.array([i for i, p in enumerate(cut) for _ in p], pa.int32())
                numbers = pa.array([k for p in cut for k in range(1, len(p) + 1)], pa.int64())
                yield pa.RecordBatch.from_arrays([part.column(0).take(rows), numbers, pa.array([x for p in cut for x in p], pa.string())], names=[id_col, "piece", "text"])

    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {dict(docs.dtypes)[id_col]}, piece long, text string")


def cap_oversized(parts: DataFrame, most: int = 4 * TARGET) -> DataFrame:
    """doc_id, chapter_number, title, raw_text with longer chapters cut by size, marked in the title where they fall into two or more."""
    key = F.struct("doc_id", "chapter_number", "title").alias("key")
    fits = parts.where(F.length("raw_text") <= most).select(key, F.lit(1).cast("long").alias("piece"), F.lit(1).cast("long").alias("n"), F.col("raw_text").alias("text"))
    cut = split_by_size(parts.where(F.length("raw_text") > most).select(F.to_json(key).alias("id"), "raw_text"), "id", "raw_text")
    cut = cut.withColumn("n", F.count("*").over(Window.partitionBy("id"))).withColumn("key", F.from_json("id", fits.schema["key"].dataType))
    rows = fits.unionByName(cut.select("key", "piece", "n", "text"))
    number = F.row_number().over(Window.partitionBy("key.doc_id").orderBy("key.chapter_number", "piece")).cast("long")
    title = F.when(F.col("n") > 1, F.concat("key.title", F.lit(" (phần "), "piece", F.lit(")"))).otherwise(F.col("key.title"))
    return rows.select("key.doc_id", number.alias("chapter_number"), title.alias("title"), F.col("text").alias("raw_text"))


def split_by_headings(lines: DataFrame, heading: Column) -> DataFrame:
    """lines: doc_id, line, text.  doc_id, chapter_number, title, raw_text; text before the first heading and empty bodies go."""
    order = Window.partitionBy("doc_id").orderBy("line")
    marked = lines.withColumn("h", heading).withColumn("seg", F.sum(F.col("h").cast("int")).over(order)).where("seg > 0")
    body = F.array_join(F.transform(F.sort_array(F.collect_list(F.when(~F.col("h"), F.struct("line", "text")))), lambda x: x["text"]), "\n")
    parts = marked.groupBy("doc_id", "seg").agg(F.trim(F.max(F.when(F.col("h"), F.col("text")))).alias("title"), F.trim(body).alias("raw_text")).where("raw_text <> ''")
    return parts.withColumn("chapter_number", F.row_number().over(Window.partitionBy("doc_id").orderBy("seg")).cast("long")).drop("seg")


#: Patterns of one automaton at most, and up to how many plain expressions are used; the automata that a worker holds.
_AUTOMATON, _FEW = 200_000, 32
_AUTOMATA: dict[str, ahocorasick.Automaton] = {}


def _automaton(key: str, patterns) -> ahocorasick.Automaton:
    if key not in _AUTOMATA:
        while len(_AUTOMATA) >= 4:
            _AUTOMATA.pop(next(iter(_AUTOMATA)))
        made = ahocorasick.Automaton(ahocorasick.STORE_LENGTH)
        for p in patterns:
            made.add_word(p)
        made.make_automaton()
        _AUTOMATA[key] = made
    return _AUTOMATA[key]


def drop_blacklisted(lines: DataFrame, patterns: DataFrame, text_col: str = "text", per_pass: int = _AUTOMATON, few: int = _FEW) -> DataFrame:
    """Lines that hold none of the patterns, each line read once (an Aho-Corasick automaton) for every `per_pass` patterns.

    Few patterns are plain expressions.  A null line holds no pattern, the empty pattern is in every other line; null patterns count for nothing.
    """
    spark = lines.sparkSession
    known = sorted(r[0] for r in patterns.select("pattern").where("pattern IS NOT NULL").distinct().collect())
    text = F.col(text_col)
    if "" in known:
        return lines.where(text.isNull())
    if len(known) <= few:
        for p in known:
            lines = lines.where(F.coalesce(~F.contains(text, F.lit(p)), F.lit(True)))
        return lines
    place = lines.columns.index(text_col)
    for start in range(0, len(known), per_pass):
        key, sent = uuid4().hex, spark.sparkContext.broadcast(known[start : start + per_pass])

        def run(batches: Iterator[pa.RecordBatch], key: str = key, sent=sent) -> Iterator[pa.RecordBatch]:
            find = _automaton(key, sent.value).iter
            for batch in batches:
                clean = [t is None or next(find(t), None) is None for t in batch.column(place).to_pylist()]
                yield batch.filter(pa.array(clean, pa.bool_()))

        lines = lines.mapInArrow(run, lines.schema)
    return lines
