"""Streaming twins of the batch operators on events: limits, views, progress and denials.

Each takes a stream with the columns of its batch twin and returns a streaming DataFrame; `run_once` reads all
that has arrived and writes it, from a checkpoint that a later run goes on from.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators import corpus as J
from ..operators import match as M
from ..plans.scratch import scratch_path
from ..sources.files import read_files
from .tables import KeyedTable


def read_events(spark: SparkSession, path: str, schema, files_per_batch: int = 1000) -> DataFrame:
    """Files of a folder, or one file, as a stream; the last letter as a class makes a path of either kind a pattern."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(f"{path[:-1]}[{path[-1]}]")


def windows(events: DataFrame, keys: list[str], size_s: int, most: int, ts: str = "ts") -> DataFrame:
    """Hits and denials of each fixed window.  State of windows that ended four sizes before the latest event goes, and later events of these are dropped."""
    late = events.withColumn("_ts", F.col(ts).cast("timestamp")).withWatermark("_ts", f"{4 * size_s} seconds")
    counted = late.groupBy(F.window("_ts", f"{size_s} seconds").alias("w"), *keys).agg(F.count("*").alias("hits"))
    return counted.select(*keys, F.unix_seconds("w.start").alias("window_start"), "hits", F.greatest(F.lit(0), F.col("hits") - most).cast("long").alias("n_denied"))


def views(events: DataFrame, key: str) -> DataFrame:
    return events.groupBy(key).agg(F.count("*").alias("views"))


def progress(events: DataFrame, keys: list[str], value: str, order: list[str]) -> DataFrame:
    """The last value of each key, one row a key in the state."""
    return events.groupBy(*keys).agg(F.max(F.struct(*order, value)).alias("b")).select(*keys, F.col(f"b.{value}").alias(value), F.col(f"b.{order[0]}").alias(order[0]))


def denials(events: DataFrame, keys: list[str], size_s: int, most: int, ts: str = "ts") -> DataFrame:
    """An audit row for each window in which requests were denied."""
    return windows(events, keys, size_s, most, ts).where("n_denied > 0").select(F.lit("rate_limited").alias("action"), *keys, "window_start", "n_denied")


class _Limiter(StatefulProcessor):
    """Counts the requests of one key in one window, and tells those over the limit.

    Of a batch the earliest requests are let through; as many as may pass are held, no more, however many come in.
    """

    def __init__(self, keys: list[str], size_s: int, most: int, tie: str):
        self.keys, self.size_s, self.most, self.tie = keys, size_s, most, tie

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.hits = handle.getValueState("hits", "hits long")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        *names, window = key
        before = self.hits.get()[0] if self.hits.exists() else 0
        free, passing, n = max(0, self.most - before), [], 0
        for r in rows:
            n += 1
            heapq.heappush(passing, (-r["_us"], -r[self.tie]))
            if len(passing) > free:
                us, tie = heapq.heappop(passing)  # the latest of those that might pass
                left = max(1, math.ceil(window + self.size_s + us / 1_000_000))
                yield Row(**dict(zip(self.keys, names, strict=True)), window_start=window, **{self.tie: -tie}, retry_after=left)
        self.hits.update((before + n,))
        self.handle.registerTimer((window + self.size_s) * 1000)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        self.hits.clear()
        yield from ()

    def close(self) -> None:
        pass


def denied_requests(events: DataFrame, keys: list[str], size_s: int, most: int, ts: str = "ts", tie: str = "event_id") -> DataFrame:
    """Each denied request, once: keys, window_start, tie, retry_after.  A running count for each window; windows that ended four sizes before the latest event go, and later events of these are dropped.

    Needs the state store of RocksDB (`run_appending` sets it).
    """
    us = F.unix_micros(F.col(ts).cast("timestamp"))
    rows = events.select(*keys, tie, us.alias("_us"), (F.floor(us / 1_000_000 / size_s) * size_s).cast("long").alias("window_start"), F.col(ts).cast("timestamp").alias("_ts")).withWatermark("_ts", f"{4 * size_s} seconds")
    kinds = dict(rows.dtypes)
    schema = ", ".join(f"`{c}` {kinds[c]}" for c in [*keys, "window_start", tie]) + ", retry_after long"
    return rows.groupBy(*keys, "window_start").transformWithState(_Limiter(keys, size_s, most, tie), schema, "Append", "EventTime")


_ROCKSDB = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider", "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false"}


def run_appending(stream: DataFrame, folder: str | None = None) -> DataFrame:
    """Process what has arrived; all rows that came out so far, each once.  A batch that is run again writes its own folder again."""
    spark = stream.sparkSession
    base = folder or scratch_path(spark, "stream")
    schema = T.StructType([*stream.schema.fields, T.StructField("n", T.LongType())])
    spark.createDataFrame([], stream.schema).write.mode("overwrite").parquet(f"{base}/rows/n=-1")  # a stream without rows has a table too
    before = {k: spark.conf.get(k, None) for k in _ROCKSDB}
    for k, v in _ROCKSDB.items():
        spark.conf.set(k, v)
    try:
        write = stream.writeStream.outputMode("append").option("checkpointLocation", f"{base}/state").trigger(availableNow=True)
        write.foreachBatch(lambda part, n: part.write.mode("overwrite").parquet(f"{base}/rows/n={n}")).start().awaitTermination()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    return spark.read.schema(schema).parquet(f"{base}/rows").drop("n")


def run_once(stream: DataFrame, keys: list[str], folder: str | None = None) -> DataFrame:
    """Process what has arrived; the last update of each key as a table.  `folder` keeps checkpoint and table for later runs, whose work follows the new rows."""
    spark = stream.sparkSession
    base = folder or scratch_path(spark, "stream")
    kept = KeyedTable(spark, f"{base}/table", keys, stream.schema)
    query = stream.writeStream.outputMode("update").option("checkpointLocation", f"{base}/state").trigger(availableNow=True).foreachBatch(kept.write).start()
    query.awaitTermination()
    return kept.read()


CHAPTERS = "novel_id string, chapter_number long, title string, original_title string, raw_text string, language string, status string"


def import_new(spark: SparkSession, folder: str, target: str, checkpoint: str, novel: Column, heading: Column | None = None) -> DataFrame:
    """Import the files of a folder that no earlier run has seen; the chapters stored by now.

    Each batch writes a folder of its own, so that a batch run again after a failure stores nothing twice and is
    numbered after the other batches.  The highest number of each novel is a table beside the chapters, which aren't read again.
    """
    tops = KeyedTable(spark, f"{target}/_tops", ["novel_id"], T._parse_datatype_string("novel_id string, chapter_number long"))

    def store(part: DataFrame, n: int) -> None:
        J.import_files(part, tops.read(n), novel, heading).write.mode("overwrite").parquet(f"{target}/batch={n}")
        new = spark.read.schema(CHAPTERS).parquet(f"{target}/batch={n}")
        tops.write(new.groupBy("novel_id").agg(F.max("chapter_number").alias("chapter_number")), n)

    spark.createDataFrame([], CHAPTERS).write.mode("append").parquet(f"{target}/batch=-1")
    files = read_files(spark, folder, True)
    files.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(store).start().awaitTermination()
    return spark.read.schema(CHAPTERS + ", batch long").parquet(target).drop("batch")


def translate_stream(rows: DataFrame, lexicon: DataFrame, readings: DataFrame, overrides: DataFrame) -> DataFrame:
    """Translate rows (novel_id, text, ...) as they arrive, without state; lexicon and layers are those of the start."""
    full, layers = J.scoped_lexicon(lexicon, overrides)
    return M.translate_text(rows, full, readings, layers, "novel_id")
