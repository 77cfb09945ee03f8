"""Rows of a file of one row group, which is one task whatever its size, reach all cores."""

import random

import numpy as np
from pyspark.sql import functions as F

from lexloom.operators import corpus as J
from lexloom.operators import match as M
from lexloom.operators import phrases as P


def one_row_group(spark, folder):
    rng = random.Random(5)
    rows = [(i, f"n{i % 3}", "".join(rng.choices("abcdefgh .\n", k=400))) for i in range(800)]
    rows += [(800 + i, "n0", "same text") for i in range(800)]
    path = f"{folder}/documents.parquet"
    spark.createDataFrame(rows, "doc_id long, novel_id string, text string").coalesce(1).write.parquet(path)
    return path


def shares(df):
    return [r["count"] for r in df.groupBy(F.spark_partition_id()).count().collect()]


def check_dealt(spark, tmp_path, make):
    path = one_row_group(spark, tmp_path)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "16k")
    try:
        docs = spark.read.parquet(path)
        assert docs.rdd.getNumPartitions() > spark.sparkContext.defaultParallelism and shares(docs) == [1600]
        found = shares(make(docs))
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert sum(found) == 1600 and len(found) >= 4 * spark.sparkContext.defaultParallelism and max(found) <= 2 * 1600 / len(found)


def given(spark):
    lexicon = spark.createDataFrame([("ab", "eins", "word", 4), ("cd", "zwei", "name", 2)], "phrase string, value string, kind string, prio int")
    return lexicon, spark.createDataFrame([("a", "x")], "ch string, readings string")


def test_translated_rows_are_dealt(spark, tmp_path):
    over = spark.createDataFrame([("novel", "name", "n1", "ab", "own", "NONE", True)], "tier string, track string, novel_id string, phrase string, value string, cap string, is_active boolean")
    check_dealt(spark, tmp_path, lambda docs: J.translate_corpus(docs, *given(spark), over, F.lit(True)))


def test_tokens_from_left_are_those_of_a_loop():
    rng = np.random.default_rng(3)
    for dense in (0.05, 0.3, 0.9):
        for n in (0, 1, 7, 3000):
            size = np.where(rng.random(n) < dense, rng.integers(1, 9, n), 1)
            size = np.minimum(size, n - np.arange(n))
            want, at = [], 0
            while at < n:
                want.append(at)
                at += size[at]
            assert P._from_left(size).tolist() == want


def test_rounds_leave_no_chain():
    """Every window overlaps the next, far more of them than there are rounds."""
    size = np.minimum(np.full(1001, 3), 1001 - np.arange(1001))
    assert P._from_left(size).tolist() == list(range(0, 1001, 3))


def test_scopes_of_layers_are_compared(monkeypatch):
    """All hashes the same: the plain pass may find another scope's entry, the exact one must not."""
    monkeypatch.setattr(P, "_key", lambda h, n, scopes=0: np.zeros(np.shape(h), dtype=np.uint64))
    rows = [(None, "ab", "word", "plain"), ("n1", "ab", "name", "one"), ("n2", "ab", "name", "two")]
    table, plain, own = P.entry_table(P.pa.Table.from_pylist([dict(zip(P.ENTRY.names, (*r, None), strict=True)) for r in rows], schema=P.ENTRY), M.first_alternative)
    index = P.Index(table, plain, own, P.Readings([], M.first_alternative))
    tokens = P.Tokens(["ab"] * 4, ["n1", "n2", "n3", None], index, M.first_alternative)
    assert tokens.joined("dst", "").to_pylist() == ["one", "two", "plain", "plain"]


def test_read_rows_are_dealt(spark, tmp_path):
    check_dealt(spark, tmp_path, lambda docs: M.reading_of_text(docs, *given(spark)))
