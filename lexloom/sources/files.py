"""Text files of unknown encoding."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ..plans.scratch import first_bytes, materialize


@F.pandas_udf(T.StructType([T.StructField("text", T.StringType()), T.StructField("encoding", T.StringType())]))
def _legacy(content: pd.Series) -> pd.DataFrame:
    """GBK, then Big5, then UTF-8 with replacement characters."""

    def one(raw: bytes) -> tuple[str, str]:
        for codec, name in (("gb18030", "gbk"), ("big5", "big5")):
            try:
                return raw.decode(codec), name
            except UnicodeDecodeError:
                pass
        return raw.decode("utf-8", "replace"), "utf-8"

    return pd.DataFrame([one(bytes(raw)) for raw in content], columns=["text", "encoding"])


def decode_files(files: DataFrame) -> DataFrame:
    """files: path, content.  path, text, encoding; only bytes that aren't UTF-8 reach Python, a byte-order mark goes.

    Null content gives an empty text.
    """
    rows = files.select("path", F.coalesce("content", F.lit(b"")).alias("content"))
    valid = F.is_valid_utf8(F.col("content").cast("string"))
    clean = rows.where(valid).select("path", F.regexp_replace(F.col("content").cast("string"), r"^\x{FEFF}", "").alias("text"), F.lit("utf-8").alias("encoding"))
    other = rows.where(~valid).select("path", _legacy("content").alias("d")).select("path", "d.text", "d.encoding")
    return clean.unionByName(other)


def scan_lines(files: DataFrame) -> DataFrame:
    """files: path, content.  path, line_no (from 0), text: the byte-order mark tells UTF-16, else UTF-8 with replacement characters; a last line end opens no line."""
    raw = F.coalesce("content", F.lit(b""))
    wide = F.startswith(raw, F.lit(b"\xff\xfe"))
    pairs = F.substring(raw, F.lit(3), F.octet_length(raw) - 2)
    utf8 = F.regexp_replace(F.make_valid_utf8(raw.cast("string")), r"^\x{FEFF}", "")
    text = F.when(wide, F.decode(pairs, "UTF-16LE")).otherwise(utf8)
    rows = files.select("path", F.regexp_replace(text, r"(\r\n|\r|\n)\z", "").alias("text")).where("text <> ''")
    return rows.select("path", F.posexplode(F.split("text", r"\r\n|\r|\n")).alias("line_no", "text"))


def read_files(spark: SparkSession, path: str, stream: bool = False) -> DataFrame:
    """path, content of every file under a folder; as a stream where new files shall be picked up."""
    if stream:
        schema = "path string, modificationTime timestamp, length long, content binary"
        return spark.readStream.format("binaryFile").schema(schema).load(path).select("path", "content")
    return spark.read.format("binaryFile").load(path).select("path", "content")


# files of any size, read in splits


def _before(rows: DataFrame, amount: Column, name: str) -> DataFrame:
    """rows (path, block, at) and `name`: the sum of an amount over all rows of the file before this one.

    Summed inside each split, and over the splits of a file, of which there is one row each.
    """
    inside = F.sum(amount).over(Window.partitionBy("path", "block").orderBy("at")) - amount
    totals = rows.groupBy("path", "block").agg(F.sum(amount).alias("_total"))
    starts = totals.select("path", "block", (F.sum("_total").over(Window.partitionBy("path").orderBy("block")) - F.col("_total")).alias("_start"))
    return rows.withColumn("_inside", inside).join(starts, ["path", "block"]).withColumn(name, F.col("_start") + F.col("_inside")).drop("_start", "_inside")


def _records(spark: SparkSession, paths: list[str], end: bytes) -> DataFrame:
    """path, block, at, raw: the bytes between line ends, in the order of `at` inside each split."""
    meta = F.col("_metadata")
    rows = spark.read.option("lineSep", end.decode("latin-1")).text(paths)
    rows = rows.select(meta["file_path"].alias("path"), meta["file_block_start"].alias("block"), F.col("value").cast("binary").alias("raw"), F.monotonically_increasing_id().alias("at"))
    return materialize(rows, "records")


def _whole_lines(rows: DataFrame) -> DataFrame:
    """Records of UTF-16 that were cut inside a pair of characters (their end is at an odd byte) joined again."""
    rows = _before(rows, F.octet_length("raw").cast("long") + 2, "offset")
    cut = F.pmod(F.col("offset") + F.octet_length("raw"), F.lit(2)) == 1
    rows = materialize(_before(rows.withColumn("cut", cut), F.when(cut, 0).otherwise(1).cast("long"), "line"), "lines")
    broken = rows.where("cut").select("path", "line").distinct()
    parts = rows.join(broken, ["path", "line"]).groupBy("path", "line").agg(F.min("block").alias("block"), F.min("at").alias("at"), F.sort_array(F.collect_list(F.struct("at", "raw"))).alias("x"))
    joined = F.unhex(F.array_join(F.transform("x", lambda v: F.hex(v["raw"])), "0A00"))
    return rows.join(broken, ["path", "line"], "left_anti").select("path", "block", "at", "raw").unionByName(parts.select("path", "block", "at", joined.alias("raw")))


def scan_large(spark: SparkSession, paths: list[str]) -> DataFrame:
    """path, line_no (from 0), text of files that may be larger than a row holds; the same lines as `scan_lines`.

    The first bytes of each file (read on the driver) tell its encoding.  Spark reads the files in splits at line ends; lines get their
    numbers from running sums over splits.  In UTF-16 the bytes of a line end also occur across two characters: a line that was cut there is
    joined again.
    """
    wide = [p for p in paths if first_bytes(spark, p, 2) == b"\xff\xfe"]
    narrow = [p for p in paths if p not in set(wide)]
    out = None
    for some, end in ((narrow, b"\n"), (wide, b"\n\x00")):
        if not some:
            continue
        rows = _records(spark, some, end)
        if end == b"\n":
            text = F.make_valid_utf8(F.col("raw").cast("string"))
        else:
            rows, text = _whole_lines(rows), F.decode("raw", "UTF-16LE")
        pieces = F.split(F.regexp_replace(text, r"\r\z", ""), r"\r")
        lines = _before(materialize(rows.select("path", "block", "at", pieces.alias("pieces")), "pieces"), F.size("pieces").cast("long"), "before")
        lines = lines.select("path", "before", F.posexplode("pieces").alias("k", "text")).select("path", (F.col("before") + F.col("k")).alias("line_no"), "text")
        lines = lines.withColumn("text", F.when(F.col("line_no") == 0, F.regexp_replace("text", r"^\x{FEFF}", "")).otherwise(F.col("text")))
        out = lines if out is None else out.unionByName(lines)
    return out
