"""Exact dedup as a stateful stream.

A digest log (document id, locator of the row, SHA-256 of the normalised text) is
written in one pass over the texts.  The log streams in micro-batches through keyed state
(RocksDB, on disk, never expired) that keeps for each digest the smallest document id,
the locator of that row (hash of the file's path, and row index) and the number of rows.  A digest that is
already known is a hit: the full text of the hit is compared with the text that the
locator points at, and only equal texts join the class.  Texts that share a digest but
differ (never seen) are classed among themselves by their whole text.

Texts of hits are found by a bitmap over locators (at most 2^26 bits, 8 MB, whatever
the corpus; when it fills up more texts are fetched, none is missed), so texts without
a copy aren't shuffled.  Everything runs in the JVM; a stream that is started again
with the same log and checkpoint reads only what was appended.

Defined results: null text is empty; all empty texts are one class; a null doc_id counts
as larger than any other, so it stays only where its class has no other id; rows that
repeat a doc_id are rows of their own; very long texts are hashed whole; an empty table gives an empty
table; other columns of docs aren't looked at, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.scratch import discard, materialize, remove, scratch_path
from .graph import field, on_files, prefilter

_LAST = (1 << 63) - 1
#: The state is on disk; files aren't allocated ahead, which would cost megabytes a partition, and
#: native memory is bounded over all partitions of an executor, and freed soon after a run.
_STATE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "128",
    "spark.sql.streaming.stateStore.rocksdb.writeBufferSizeMB": "4",
    "spark.sql.streaming.stateStore.maintenanceInterval": "10s",
}
_LOG = "doc_id long, order_id long, locator struct<file: bigint, row: bigint>, digest binary"


def normalised(text: Column) -> Column:
    """Runs of ASCII white space become one space; null is empty."""
    out = F.coalesce(text, F.lit(""))
    for mark in "\t\n\x0b\x0c\r":
        out = F.replace(out, F.lit(mark), F.lit(" "))
    return F.when(F.contains(out, F.lit("  ")), F.regexp_replace(out, " +", " ")).otherwise(out)


def locator(docs: DataFrame) -> Column:
    """Where a row of a table of files is: hash of the file's path, and row index."""
    at = docs.metadataColumn("_metadata")
    return F.struct(F.xxhash64(at["file_path"]).alias("file"), at["row_index"].alias("row"))


def _located(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """doc_id, order_id, locator, text."""
    docs = on_files(docs)
    return docs.select(field(id_col).alias("doc_id"), F.coalesce(field(id_col), F.lit(_LAST)).alias("order_id"), locator(docs).alias("locator"), field(text_col).alias("text"))


def append_digests(located: DataFrame, log: str) -> None:
    """Write the digests of rows to the log that the stream reads."""
    located.select("doc_id", "order_id", "locator", F.unhex(F.sha2(normalised(F.col("text")), 256)).alias("digest")).write.mode("append").option("compression", "zstd").parquet(log)


def digest_state(spark: SparkSession, log: str, checkpoint: str, sink: str, files_per_batch: int = 10_000) -> DataFrame:
    """Run the stream over the log until it has read it all.

    Returns digest, first (order_id and locator of the row that stays) and copies.
    """
    stream = spark.readStream.schema(_LOG).option("maxFilesPerTrigger", files_per_batch).parquet(log)
    state = stream.groupBy("digest").agg(F.min(F.struct("order_id", "locator")).alias("first"), F.count("*").alias("copies"))
    before = {k: spark.conf.get(k, None) for k in _STATE}
    for k, v in _STATE.items():
        spark.conf.set(k, v)
    try:
        query = (
            state.writeStream.outputMode("update")
            .option("checkpointLocation", checkpoint)
            .trigger(availableNow=True)
            .foreachBatch(lambda part, n: part.write.mode("overwrite").option("compression", "zstd").parquet(f"{sink}/batch={n}"))
            .start()
        )
        query.awaitTermination()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    updates = spark.read.schema("digest binary, first struct<order_id: bigint, locator: struct<file: bigint, row: bigint>>, copies bigint").parquet(sink)
    return updates.groupBy("digest").agg(F.min("first").alias("first"), F.max("copies").alias("copies"))


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", folder: str | None = None, located: bool = False) -> DataFrame:
    """One row for every row of docs: doc_id, keep_id, group_size, kept, text_sha256, and with `located` its locator.

    `folder`: keeps the log and the stream's state; by default a new one in the shared folder.
    """
    spark = docs.sparkSession
    base = folder or scratch_path(spark, "exact")
    texts_at = _located(docs, id_col, text_col)
    append_digests(texts_at, f"{base}/log")
    state = digest_state(spark, f"{base}/log", f"{base}/state", f"{base}/updates")
    rows = spark.read.schema(_LOG).parquet(f"{base}/log")
    # a table, so that the joins see two plain shuffles, of which adaptive execution splits a frequent digest's
    known = materialize(state.select("digest", "copies", F.col("first.order_id").alias("keep"), F.col("first.locator").alias("keep_at")), "known")
    placed = materialize(rows.join(known, "digest"), "placed")
    discard(known)
    several = placed.where("copies > 1").select("locator", "digest", "keep_at")
    texts = _differing(texts_at, several)
    odd = materialize(texts, "odd")
    discard(texts.texts)
    if folder is None:
        remove(spark, base)
    if odd.isEmpty():
        out = placed.withColumns({"odd_at": F.lit(None).cast("string"), "odd_first": F.struct(F.col("keep").alias("order_id"), F.col("keep_at").alias("locator")), "odd_size": F.lit(0).cast("long"), "odd_n": F.lit(0).cast("long")})
    else:
        odd_class = odd.groupBy("digest", "second").agg(F.min(F.struct("order_id", "locator")).alias("odd_first"), F.count("*").alias("odd_size"))
        odd_rows = odd.join(odd_class, ["digest", "second"]).select(F.col("locator").alias("odd_at"), "odd_first", "odd_size")
        odd_counts = odd.groupBy(F.col("digest").alias("odd_digest")).agg(F.count("*").alias("odd_n"))
        out = placed.join(odd_rows, F.col("locator") == F.col("odd_at"), "left").join(odd_counts, F.col("digest") == F.col("odd_digest"), "left")
    is_odd = F.col("odd_at").isNotNull()
    keep = F.when(is_odd, F.col("odd_first.order_id")).otherwise(F.col("keep"))
    return out.select(
        "doc_id",
        F.nullif(keep, F.lit(_LAST)).alias("keep_id"),
        F.when(is_odd, F.col("odd_size")).otherwise(F.col("copies") - F.coalesce("odd_n", F.lit(0))).alias("group_size"),
        (F.col("locator") == F.when(is_odd, F.col("odd_first.locator")).otherwise(F.col("keep_at"))).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
        *(["locator"] if located else []),
    )


def _differing(located: DataFrame, several: DataFrame) -> DataFrame:
    """Hits whose full text isn't that of the row that their digest's state points at."""
    some = prefilter(located.select("locator", "order_id", "text"), "locator", several, several.count()).join(several, "locator")
    texts = materialize(some.withColumn("text", normalised(F.col("text"))).withColumnRenamed("text", "body"), "hits")
    kept = texts.where("locator = keep_at").select(F.col("digest").alias("d"), F.col("body").alias("kept_body"))
    hits = texts.where("locator != keep_at").join(kept, F.col("digest") == F.col("d"), "left")
    out = hits.where(F.col("kept_body").isNull() | (F.col("body") != F.col("kept_body"))).select("digest", "locator", "order_id", F.sha2(F.concat(F.lit("second"), "body"), 512).alias("second"))
    out.texts = texts
    return out
