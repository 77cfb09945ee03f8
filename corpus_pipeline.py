"""A training-data pipeline: quality, exact copies, near copies, repeated passages, packing.

Each stage reads all that the one before kept, and all but the last return the columns of
`documents`.  Rows are told apart by their place in the table, so several may have one doc_id or none.  Between stages the rows are a Parquet table in the shared folder.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexloom.llm.exact import exact_dedup, locator
from lexloom.llm.graph import ROW, field, keyed, on_files, unpacked, without
from lexloom.llm.minhash import near_dedup
from lexloom.llm.packing import pack_documents
from lexloom.llm.quality import fit_quality, score_quality
from lexloom.llm.queries import vocabulary
from lexloom.llm.suffixes import suffix_dedup
from lexloom.plans.scratch import materialize
from lexloom.sources.tables import table

#: Documents that score lower are rejected: well under the even 0.5, so that few good ones go.
REJECT_BELOW = 0.3


def _own(name: str) -> Column:
    return F.col("own").getField(name).alias(name)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Reject documents that look like the ones labelled bad."""
    model = fit_quality(docs.select("doc_id", "text"), table(spark, sf_dir, "labels"))
    packed = docs.select(F.struct(*map(field, docs.columns)).alias("own"), "text")
    return unpacked(score_quality(packed, model).where(F.col("score") >= REJECT_BELOW))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts one row of the smallest doc_id stays."""
    docs = on_files(docs)
    dropped = materialize(exact_dedup(docs, located=True).where("NOT kept").select("locator"), "dropped")
    rows = docs.select(F.struct(*map(field, docs.columns)).alias("own"), locator(docs).alias("locator"))
    return unpacked(without(rows, "locator", dropped, dropped.count()))


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of near copies (five-word shingles, similarity 0.8) one row of the smallest doc_id stays."""
    rows = keyed(docs)
    found = near_dedup(rows.select(ROW, _own("doc_id"), _own("text")), size=5, percent=80, row_col=ROW)
    dropped = materialize(found.where("NOT kept").select(ROW), "dropped")
    return unpacked(without(rows, ROW, dropped, dropped.count()))


def passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Take out passages of 50 words that an earlier document holds; a row of which nothing is left goes."""
    cut = suffix_dedup(docs, whole_rows=True).where("n_removed = 0 OR n_removed < n_words")
    new = {"text": F.col("kept"), "n_chars": F.length("kept").cast("long")}
    own = lambda c: F.col("own").getField(c)
    return cut.select(*[F.when(F.col("n_removed") > 0, new[c]).otherwise(own(c)).alias(c) if c in new else own(c).alias(c) for c in docs.columns])


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pack what is left into sequences of 1024 tokens."""
    return pack_documents(docs, vocabulary())


STAGES = [("quality", quality), ("exact", exact), ("near", near), ("passages", passages), ("packing", packing)]

#: SQL can't express the compression classifier; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
