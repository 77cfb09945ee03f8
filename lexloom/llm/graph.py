"""Helpers on ids: connected components, and a bounded prefilter for rows of wanted ids."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.scratch import discard, materialize

_ROUNDS = 60
ROW = "_row"


def field(column: str) -> Column:
    """A column by its exact name, whatever characters it has."""
    return F.col("`" + column.replace("`", "``") + "`")


def on_files(docs: DataFrame) -> DataFrame:
    """docs as a table read from files, whose rows have a place; written first where it is something else."""
    return docs if docs._jdf.queryExecution().analyzed().nodeName() == "LogicalRelation" else materialize(docs, "rows")


def keyed(docs: DataFrame) -> DataFrame:
    """_row, a number of its own for each row (from its file and its place there), and `own`, a struct of the row's columns.

    As the columns are inside the struct, none of their names can clash with names used here.
    """
    docs = on_files(docs)
    at = docs.metadataColumn("_metadata")
    path = F.xxhash64(at["file_path"]).alias("_path")
    names = sorted(r["_path"] for r in docs.select(path).distinct().collect())  # 8 bytes a file: 8 MB for a million files
    files = docs.sparkSession.createDataFrame([(p, k << 40) for k, p in enumerate(names)], "_path long, _file long")
    rows = docs.select(F.struct(*map(field, docs.columns)).alias("own"), path, at["row_index"].alias("_at")).join(F.broadcast(files), "_path")
    return rows.select((F.col("_file") + F.col("_at")).alias(ROW), "own")


def unpacked(rows: DataFrame) -> DataFrame:
    """The columns inside `own`, as a table of their own."""
    return rows.select(*[F.col("own").getField(c).alias(c) for c in rows.schema["own"].dataType.names])


def _are_stars(edges: DataFrame) -> bool:
    """Whether every u has one edge, and no v is a u."""
    ends = edges.select(F.col("u").alias("node"), F.lit(1).alias("out"), F.lit(0).alias("into")).unionByName(edges.select(F.col("v").alias("node"), F.lit(0).alias("out"), F.lit(1).alias("into")))
    return ends.groupBy("node").agg(F.sum("out").alias("out"), F.max("into").alias("into")).where("out + into > 1").isEmpty()


def components(edges: DataFrame) -> DataFrame:
    """edges: u, v (long).  Returns node, component (the smallest id that the node reaches).

    Alternates large-star and small-star steps until the edges are stars around the
    smallest ids; each step is a few joins and ends in a table of the shared folder.
    """
    pairs = edges.where("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    pairs = materialize(pairs, "edges")
    for _ in range(_ROUNDS):
        if _are_stars(pairs):
            nodes = pairs.select(F.col("u").alias("node"), F.col("v").alias("component"))
            return nodes.unionByName(pairs.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
        both = pairs.unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = materialize(both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m")), "least")
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()
        large = materialize(large, "large")
        discard(pairs, least)
        least = materialize(large.groupBy("u").agg(F.min("v").alias("m")), "least")
        small = large.join(least, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        pairs = materialize(small.unionByName(least.select("u", F.col("m").alias("v"))).distinct(), "edges")
        discard(large, least)
    raise RuntimeError("components did not settle")


def _slot(keys: list[Column], bits: int) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(bits))


def flagged(rows: DataFrame, key: str, wanted: DataFrame, n: int) -> DataFrame:
    """rows and `_maybe`: true where `key` may be among the n wanted keys; for all that are, and for few others.

    The wanted keys go into a bitmap of at most 2^26 bits (8 MB), which is broadcast.
    When it fills up more rows are flagged; none is missed.  `wanted` has the column `key`.
    """
    bits = 1 << max(15, min(26, (16 * n).bit_length()))
    slot = wanted.select(_slot([F.col(key)], bits).alias("_slot"))
    maps = slot.groupBy(F.bitmap_bucket_number("_slot").alias("_page")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("_slot")).alias("_bits"))
    at = F.bitmap_bit_position("_slot").cast("int")
    byte = F.conv(F.hex(F.substring("_bits", F.shiftright(at, 3) + 1, F.lit(1))), 16, 10).cast("int")
    paged = rows.withColumn("_slot", _slot([F.col(key)], bits)).join(F.broadcast(maps), F.bitmap_bucket_number("_slot") == F.col("_page"), "left")
    bit = F.call_function("shiftright", byte, F.pmod(at, F.lit(8))).bitwiseAND(F.lit(1)) == 1
    return paged.withColumn("_maybe", F.coalesce(bit, F.lit(False))).drop("_slot", "_page", "_bits")


def prefilter(rows: DataFrame, key: str, wanted: DataFrame, n: int) -> DataFrame:
    """Rows whose `key` may be among the n wanted keys: all that are, and few others."""
    return flagged(rows, key, wanted, n).where("_maybe").drop("_maybe")


def without(rows: DataFrame, key: str, dropped: DataFrame, n: int) -> DataFrame:
    """Rows whose `key` isn't among the n dropped ones.  Only rows that the bitmap flags are shuffled."""
    marked = flagged(rows, key, dropped, n)
    doubtful = marked.where("_maybe").drop("_maybe").join(dropped.select(key).hint("merge"), key, "left_anti")
    return marked.where("NOT _maybe").drop("_maybe").unionByName(doubtful.select(rows.columns))
