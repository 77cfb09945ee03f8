"""Golden cases of the matcher and the text functions, and the two matching strategies against a plain loop."""

import random

from pyspark.sql import functions as F

from lexloom.functions import text as X
from lexloom.functions import urls as U
from lexloom.operators import lexicon as L
from lexloom.operators import match as M

LEX = [("他", "hắn/nó/khác", "word", 4), ("他", "hắn", "pronoun", 3), ("自己的人生", "nhân sinh của mình", "word", 4), ("自己", "tự mình", "pronoun", 3), ("萧炎", "Tiêu Viêm", "name", 2), ("好", "hảo", "word", 4)]


def entries(spark, rows):
    return spark.createDataFrame(rows, "phrase string, value string, kind string, prio int")


def test_priority_and_longest(spark):
    lines = spark.createDataFrame([(1, 0, "他"), (2, 0, "自己的人生"), (3, 0, "萧炎龘龍"), (4, 0, "他好。他好"), (5, 0, "他，好"), (6, 0, "")], "doc_id long, line int, text string")
    got = M.tokenize(lines, entries(spark, LEX), spark.createDataFrame([("龘", "đạp")], "ch string, readings string"))
    rows = {r["doc_id"]: [(t["source"], t["dst"]) for t in r["tokens"]] for r in got.collect()}
    assert rows[1] == [("pronoun", "hắn")]
    assert rows[2] == [("word", "nhân sinh của mình")]
    assert rows[3] == [("name", "Tiêu Viêm"), ("hanviet_fallback", "đạp"), ("unmatched", "龍")]
    assert rows[6] == []
    shown = {r["doc_id"]: r["t"] for r in got.select("doc_id", M.joined(M.displayed(F.col("tokens"))).alias("t")).collect()}
    assert shown[4] == "Hắn hảo. Hắn hảo" and shown[5] == "Hắn, hảo"


def greedy(text, best):
    out, at = [], 0
    while at < len(text):
        hit = next((n for n in range(len(text) - at, 0, -1) if text[at : at + n] in best), 0)
        if hit:
            out.append((at, text[at : at + hit]))
        at += hit or 1
    return out


def test_strategies_agree(spark):
    rng = random.Random(5)
    lex = [("".join(rng.choice("abc") for _ in range(rng.randint(1, 4))), f"v{i}", "word", 4) for i in range(12)]
    texts = [(i, "".join(rng.choice("abcd") for _ in range(rng.randint(0, 30)))) for i in range(60)]
    lines = spark.createDataFrame(texts, "doc_id long, text string")
    e = entries(spark, lex)
    want = {(d, at, p) for d, t in texts for at, p in greedy(t, {x[0] for x in lex})}
    got = M.tokenize(lines, e, spark.createDataFrame([], "ch string, readings string")).select("doc_id", F.explode("tokens").alias("t")).where("t.source = 'word'")
    assert {(r["doc_id"], r["t"]["pos"], r["t"]["src"]) for r in got.collect()} == want
    assert {(r["doc_id"], r["pos"], r["phrase"]) for r in M.match_by_join(lines, e, ["doc_id"]).collect()} == want


def test_lexicon_lines(spark):
    rows = ["# note", "no sign", "=empty key", "甲=một | hai", "甲=again", "542年=x", "5G网络=mạng", "1997=y", "乙=()", "丙=a=b", "﻿丁=bom", "戊=www.x.com"]
    lines = spark.createDataFrame([("s", 1, i, t) for i, t in enumerate(rows)], "label string, prio int, line_no int, text string")
    parsed = L.parse_phrases(lines, True)
    assert [r["status"] for r in parsed.orderBy("line_no").collect()] == ["malformed", "malformed", "malformed", "ok", "ok", "artifact", "ok", "artifact", "junk", "ok", "ok", "junk"]
    assert {r["phrase"]: r["value"] for r in L.merge_sources(parsed).collect()} == {"甲": "một/hai", "5G网络": "mạng", "丙": "a=b", "丁": "bom"}


def test_columns(spark):
    df = spark.createDataFrame([("trương gia", "http://10.0.0.1/x"), ("«mộc", "https://www.book.site.com/novel/530/12/")], "t string, u string")
    rows = df.select(X.apply_cap_style(F.col("t"), F.lit("ALL_WORDS")).alias("a"), X.capitalize_first(F.col("t")).alias("f"), U.is_public_url(F.col("u")).alias("p"), U.slug_from_url(F.col("u")).alias("s"), U.source_chapter_id(F.col("u")).alias("c")).collect()
    assert [r["a"] for r in rows] == ["Trương Gia", "«mộc"] and [r["f"] for r in rows] == ["Trương gia", "«Mộc"]
    assert [r["p"] for r in rows] == [False, True] and rows[1]["s"] == "site-530" and rows[1]["c"] == "12"
