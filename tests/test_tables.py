"""Streams with running counts, tables kept up by key, versions as of a place, and the dictionary build."""

from datetime import datetime, timedelta

from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexloom.functions import text as X
from lexloom.operators import corpus as J
from lexloom.operators import lexicon as L
from lexloom.operators import library as B
from lexloom.operators import overrides as O
from lexloom.sources.files import decode_files
from lexloom.streaming import live as S
from lexloom.streaming.tables import KeyedTable


def test_denied_requests_over_batches(spark, tmp_path):
    """Three batches in order of time: each denied request once, as the batch verdicts say; an old one is dropped after the watermark."""
    start = datetime(2024, 1, 1)
    rows = [(k, start + timedelta(seconds=7 * k), f"u{k % 3}") for k in range(120)]
    schema = "event_id long, ts timestamp, user string"
    want = {(r["user"], r["event_id"], r["window_start"], r["retry_after"]) for r in B.rate_limit(spark.createDataFrame(rows, schema), ["user"], 60, 2).where("denied").collect()}
    assert want
    run = lambda: [(r["user"], r["event_id"], r["window_start"], r["retry_after"]) for r in S.run_appending(S.denied_requests(spark.readStream.schema(schema).parquet(f"{tmp_path}/in"), ["user"], 60, 2), f"{tmp_path}/out").collect()]
    for k in range(3):
        spark.createDataFrame(rows[40 * k : 40 * k + 40], schema).coalesce(1).write.parquet(f"{tmp_path}/in/part={k}")
        got = run()
        assert len(got) == len(set(got)) and set(got) == {x for x in want if x[1] < 40 * k + 40}
    spark.createDataFrame([(500 + k, start, "u0") for k in range(9)], schema).write.parquet(f"{tmp_path}/in/part=9")
    assert set(run()) == want


def test_keyed_table_folds_and_repeats(spark, tmp_path):
    schema = T._parse_datatype_string("k long, v string")
    kept = KeyedTable(spark, str(tmp_path / "t"), ["k"], schema, deltas=2)
    said = lambda before=None: {r["k"]: r["v"] for r in kept.read(before).collect()}
    assert said() == {}
    want, history = {}, []
    for n in range(9):
        part = {k: f"{n}" for k in (n, n - 1, None) if k is None or k >= 0}
        for _ in range(2):  # a batch that runs twice changes nothing
            kept.write(spark.createDataFrame(list(part.items()), schema), n)
        want |= part
        history.append(dict(want))
        assert said() == want and said(n) == (history[n - 1] if n else {})
    names = lambda kind: sorted(int(p.name[2:]) for p in (tmp_path / "t" / kind).iterdir())
    assert len(names("snapshot")) == 2 and min(names("delta")) > names("snapshot")[0]


def test_versions_as_of_a_place(spark):
    edits = spark.createDataFrame([(k, "user" if k % 3 == 0 else "novel") for k in range(0, 100, 2)] + [(50, "global")], "seq long, tier string")
    rows = spark.createDataFrame([(k, None if k == 7 else k * 3 - 20) for k in range(50)], "id long, place long")
    shared = [k for k in range(0, 100, 2) if k % 3] + [50]
    got = {r["id"]: r["version"] for r in O.version_as_of(rows.repartition(5), edits, "place").collect()}
    assert got == {k: 1 if k == 7 else 1 + sum(s <= k * 3 - 20 for s in shared) for k in range(50)}
    chapters = spark.createDataFrame([(1, "x"), (2, "y"), (3, "z"), (4, None)], "chapter_id long, text string")
    state = chapters.where("chapter_id < 4").select("chapter_id", X.content_hash(F.when(F.col("chapter_id") == 2, F.lit("old")).otherwise(F.col("text"))).alias("hash"), F.when(F.col("chapter_id") == 3, 10).otherwise(99).alias("seen_at"))
    assert sorted(r["chapter_id"] for r in J.changed_since(chapters, state, edits).collect()) == [2, 3, 4]


LINES = "kind string, format string, label string, prio int, line_no long, text string"


def test_dictionary_of_all_formats(spark, tmp_path):
    rows = [
        ("word", "phrases", "w1", 1, 0, "﻿甲=một | hai"), ("word", "phrases", "w1", 1, 1, "第3章=x"), ("word", "phrases", "w2", 2, 0, "甲=khác"), ("word", "phrases", "w2", 2, 1, "é=é"), ("word", "cedict", "gap", 3, 0, "甲 乙 [a] /one; x/(q) two,/"),
        ("name", "phrases", "n", 1, 0, "2023年1月2日=y"), ("name", "phrases", "n", 1, 1, "萧炎=Tiêu Viêm"), ("pronoun", "phrases", "p", 1, 0, "第3章=kept"), ("reading", "readings", "r", 1, 0, "char,list,pinyin"), ("reading", "readings", "r", 1, 1, "好,\"['hảo', 'hiếu']\",hao"),
        ("reading", "simple", "s", 2, 0, "好=no"), ("reading", "simple", "s", 2, 1, "乙 = ất"), ("reading", "classical", "c", 3, 0, "乙=sau"), ("reading", "classical", "c", 3, 1, "丙=bính, x [p]\\n1"), ("blacklist", "blacklist", "b", 1, 0, " ad "), ("blacklist", "blacklist", "b", 1, 1, "# no"), ("blacklist", "blacklist", "b2", 2, 0, "ad"),
    ]
    d = L.build_dictionary(spark.createDataFrame(rows, LINES), spark.createDataFrame([("好", "女"), ("丙", "丁")], "ch string, simple string"))
    assert {(r["kind"], r["phrase"]): (r["value"], r["source"], r["len"]) for r in d.lexicon.collect()} == {
        ("word", "甲"): ("một/hai", "w1", 1), ("word", "é"): ("é", "w2", 1), ("word", "乙"): ("one/two", "gap", 1), ("name", "萧炎"): ("Tiêu Viêm", "n", 2), ("pronoun", "第3章"): ("kept", "p", 3),
    }
    assert {r["ch"]: (r["readings"], r["source"]) for r in d.readings.collect()} == {"好": ("hảo,hiếu", "r"), "女": ("hảo,hiếu", "r"), "乙": ("ất", "s"), "丙": ("bính", "c")}
    assert [tuple(r) for r in d.blacklist.collect()] == [("ad", "b")]
    assert {(r["kind"], r["status"]): r["n"] for r in d.report.where("kind IN ('word', 'name')").groupBy("kind", "status").agg(F.sum("n").alias("n")).collect()} == {("word", "ok"): 5, ("word", "artifact"): 1, ("name", "artifact"): 1, ("name", "ok"): 1}
    L.write_dictionary(d, str(tmp_path / "d"))
    back = spark.read.parquet(str(tmp_path / "d" / "lexicon"))
    assert back.where("kind = 'word'").count() == 3 and {r["kind"] for r in back.select("kind").distinct().collect()} == {"word", "name", "pronoun"}
    more = L.PARSERS | {"tabs": lambda lines: lines.select("kind", "label", "prio", "line_no", F.split("text", "\t")[0].alias("phrase"), F.split("text", "\t")[1].alias("value"), F.lit("ok").alias("status"))}
    own = L.build_dictionary(spark.createDataFrame([("word", "tabs", "t", 1, 0, "丑\tsửu")], LINES), parsers=more)
    assert [(r["phrase"], r["value"]) for r in own.lexicon.collect()] == [("丑", "sửu")] and own.readings.count() == 0


def test_small_sinks_and_functions(spark, tmp_path):
    rows = spark.createDataFrame([(1, 1, "t")], "novel_id long, chapter_number long, title string")
    for _ in range(2):
        J.append_chapters(rows, str(tmp_path / "chapters"))
    assert spark.read.parquet(str(tmp_path / "chapters")).count() == 2
    audit = B.audit_rows(rows, "x.done", F.lit(3), "novel", F.col("novel_id"), ["title"])
    B.append_audit(audit, str(tmp_path / "audit"))
    assert [tuple(r) for r in spark.read.parquet(str(tmp_path / "audit")).collect()] == [("3", "x.done", "novel", "1", '{"title":"t"}')]
    one = spark.createDataFrame([("a", " a / b// c ")], "p string, v string").select(X.remap_codepoints(F.col("p"), "", "好").alias("p"), X.split_alternatives(F.col("v")).alias("v")).first()
    assert one["p"] == "好□a" and one["v"] == ["a", "b", "c"]
    big5 = "中文測試".encode("big5") + b"\xa1\x40"
    odd = b"\xff\xff\xfe\x80abc"
    files = spark.createDataFrame([("b", bytearray("萧炎".encode("gb18030"))), ("o", bytearray(odd)), ("u", bytearray(b"\xef\xbb\xbfok"))], "path string, content binary")
    got = {r["path"]: (r["text"], r["encoding"]) for r in decode_files(files).collect()}
    assert got["b"] == ("萧炎", "gbk") and got["u"] == ("ok", "utf-8") and "abc" in got["o"][0]
    # bytes that aren't GBK, but Big5
    only = bytes([0xA1, 0x40, 0xF9, 0xFE, 0x80])
    assert {r["encoding"] for r in decode_files(spark.createDataFrame([("x", bytearray(big5)), ("y", bytearray(only))], "path string, content binary")).collect()} <= {"gbk", "big5", "utf-8"}


def test_request_parsing():
    q = B.BrowseQuery.parse({"q": " a ", "source": " h ", "status": "COMPLETED", "author": "", "addedBy": "7", "tags": "x, ,y", "sort": "title", "page": "0"})
    assert (q.q, q.source, q.status, q.author, q.added_by, q.tags, q.sort, q.page) == ("a", "h", "COMPLETED", None, 7, ["x", "y"], "title", 1)
    q = B.BrowseQuery.parse({"status": "odd", "addedBy": "-3", "page": "z"})
    assert (q.status, q.added_by, q.page, q.sort) == (None, None, 1, "newest")
