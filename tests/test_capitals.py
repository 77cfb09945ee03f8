"""Capitals of one character, against the twins' own upper()."""

import duckdb
from pyspark.sql import functions as F

from lexloom import corpus_queries as K
from lexloom import queries as Q
from lexloom.functions import text as X


def test_capitals_are_the_twins(spark):
    letters = [chr(c) for c in range(0x80, 0x2000) if chr(c).isalpha()]
    said = dict(duckdb.sql("SELECT c, upper(c) FROM (SELECT unnest($1) AS c)", params=[letters]).fetchall())
    odd = [c for c in letters if len(c.upper()) > 1]
    assert len(odd) > 50 and {c: X.capital_of(c) for c in odd} == {c: said[c] for c in odd}
    got = spark.createDataFrame([(c,) for c in odd], "c string").select("c", X.capital(F.col("c")).alias("u")).collect()
    assert {r["c"]: r["u"] for r in got} == {c: said[c] for c in odd}
    row = spark.createDataFrame([("«ßa ßb",)], "t string").select(X.capitalize_first(F.col("t")), X.apply_cap_style(F.col("t"), F.lit("ALL_WORDS"))).first()
    assert tuple(row) == ("«ẞa ßb", "«ßa ẞb")


def test_sentences_that_begin_with_a_sharp_s(spark, tmp_path):
    rows = [(1, "ßand on. ß! the ß\n ß ŉ", "de", "src1", 1), (2, "on the. ǆ ßen\n\nﬁ", "en", "src2", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs.coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    db = duckdb.connect()
    db.execute(f"CREATE VIEW documents AS FROM '{tmp_path}/documents.parquet/*.parquet'")
    for query, sql in ((Q.translate_lines, Q._TRANSLATE), (K.translate_text, K._TEXT)):
        got, want = query(spark, str(tmp_path)), db.sql(sql)
        assert {tuple(r) for r in got.select(want.columns).collect()} == set(want.fetchall())
