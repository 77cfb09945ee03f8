"""Translation jobs, layers, streams and lexicon sources on small cases."""

import pytest
from pyspark.sql import functions as F

from lexloom.functions import text as X
from lexloom.operators import corpus as J
from lexloom.operators import lexicon as L
from lexloom.operators import library as B
from lexloom.operators import match as M
from lexloom.operators import overrides as O
from lexloom.streaming import live as S

ENTRY = "phrase string, value string, kind string, prio int"
OVER = "tier string, track string, novel_id string, phrase string, value string, cap string, is_active boolean"


def readings(spark):
    return spark.createDataFrame([("龘", "đạp")], "ch string, readings string")


def test_lexicons_alternate(spark):
    """Workers outlive a lexicon; none sees that of an earlier call."""
    lines = spark.createDataFrame([(1, "他好")], "doc_id long, text string").coalesce(1)
    for k in range(12):
        lexicon = spark.createDataFrame([("他", f"v{k % 2}", "word", 4)], ENTRY)
        got = M.tokenize(lines, lexicon, readings(spark), fields=("dst",), max_scan_len=4).first()["tokens"]
        assert [t["dst"] for t in got] == [f"v{k % 2}", "好"]


def test_layers_of_novels(spark):
    lexicon = spark.createDataFrame([("他", "hắn", "word", 4), ("萧炎", "Tiêu Viêm", "name", 2)], ENTRY)
    over = spark.createDataFrame(
        [("global", "phrase", None, "他", "gã", "NONE", True), ("novel", "name", "a", "他", "y ta", "ALL_WORDS", True), ("novel", "name", "b", "萧炎他", "ai đó", "FIRST_LETTER", True), ("novel", "name", "c", "他", "tắt", "NONE", False)], OVER
    )
    chapters = spark.createDataFrame([("a", "萧炎他\n\n 他"), ("b", "，萧炎他"), ("c", "龘他"), ("c", None)], "novel_id string, text string")
    out = J.translate_corpus(chapters, lexicon, readings(spark), over, F.lit(True))
    got = {(r["novel_id"], r["text"]): r["translated"] for r in out.collect()}
    assert got[("a", "萧炎他\n\n 他")] == "Tiêu Viêm Y Ta\n\n  Y Ta"
    assert got[("b", "，萧炎他")] == ", Ai đó"
    assert got[("c", "龘他")] == "Đạp gã"


def test_changed_rows(spark):
    rows = spark.createDataFrame([(1, "x"), (2, "y"), (3, None)], "chapter_id long, text string")
    state = rows.select("chapter_id", F.lit(3).alias("version"), X.content_hash(F.col("text")).alias("hash"))
    ids = lambda df: sorted(r["chapter_id"] for r in df.collect())
    assert ids(J.changed_rows(rows, state, 3)) == []
    assert ids(J.changed_rows(rows, state, 4)) == [1, 2, 3]
    assert ids(J.changed_rows(rows.withColumn("text", F.when(F.col("chapter_id") == 2, "z").otherwise(F.col("text"))), state, 3)) == [2]


def test_join_and_broadcast_matchers_agree(spark):
    lexicon = spark.createDataFrame([("ab", "1", "word", 4), ("abc", "2", "word", 4), ("c", "3", "name", 2), ("bca", "4", "word", 4)], ENTRY)
    lines = spark.createDataFrame([(1, "abcabcab"), (2, "cabbca"), (3, ""), (4, "zzz")], "doc_id long, text string")
    joined = {(r["doc_id"], r["pos"], r["phrase"]) for r in M.match_by_join(lines, lexicon, ["doc_id"]).collect()}
    rows = M.tokenize(lines, lexicon, readings(spark), fields=("pos", "src", "source")).collect()
    assert joined == {(r["doc_id"], t["pos"], t["src"]) for r in rows for t in r["tokens"] if t["source"] != "unmatched"}


@pytest.mark.parametrize("seed", ["é", "é"])
def test_unicode_forms(spark, seed):
    row = spark.createDataFrame([(f" Caf{seed} №1 ",)], "t string").select(X.nfc(F.col("t")).alias("nfc"), X.slugify(F.col("t")).alias("slug"), X.slugify(F.lit("好")).alias("none")).first()
    assert row["nfc"] == "Café №1" and row["slug"] == "cafe-no1" and row["none"].startswith("truyen-")


def test_classical_and_listed_readings(spark):
    lines = spark.createDataFrame([(1, "好=hảo, hiếu [x]\\n1"), (2, "好=sau"), (3, "好好=dài"), (4, "#")], "line_no long, text string")
    assert [tuple(r) for r in L.parse_classical_readings(lines).collect()] == [("好", "hảo")]
    listed = spark.createDataFrame([(1, "好", "['hảo', 'hiếu']"), (2, "好", "['hiếu', \"háo\"]")], "line_no long, ch string, listed string")
    rows = L.parse_readings_csv(listed)
    assert [tuple(r) for r in L.merge_readings(rows).collect()] == [("好", "hảo,hiếu,háo")]
    both = L.expand_variants(rows.where("reading <> 'háo'"), spark.createDataFrame([("好", "女")], "ch string, simple string"))
    assert {r["ch"]: r["readings"] for r in L.merge_readings(both).collect()} == {"好": "hảo,hiếu", "女": "hảo,hiếu"}


def test_toggles_take_the_last(spark):
    base = spark.createDataFrame([(1, True), (2, True)], "id long, is_active boolean")
    toggles = spark.createDataFrame([(1, 1, False), (2, 1, True), (3, 1, False), (4, 9, True)], "seq long, id long, is_active boolean")
    out, unknown = O.set_active(base, toggles, ["id"])
    assert sorted(map(tuple, out.collect())) == [(1, False), (2, True)] and [r["id"] for r in unknown.collect()] == [9]


def test_stream_goes_on_from_its_state(spark, tmp_path):
    schema = "ts timestamp, user long"
    add = lambda rows, k: spark.createDataFrame(rows, "ts string, user long").select(F.col("ts").cast("timestamp").alias("ts"), "user").write.parquet(f"{tmp_path}/in/part={k}")
    stream = lambda: spark.readStream.schema(schema).parquet(f"{tmp_path}/in")
    run = lambda: sorted((r["user"], r["hits"], r["n_denied"]) for r in S.run_once(S.windows(stream(), ["user"], 60, 2), ["user", "window_start"], f"{tmp_path}/state").collect())
    add([("2024-01-01 00:00:01", 1), ("2024-01-01 00:00:02", 1)], 1)
    assert run() == [(1, 2, 0)]
    add([("2024-01-01 00:00:30", 1), ("2024-01-01 00:00:31", 2)], 2)
    assert run() == [(1, 3, 1), (2, 1, 0)]
    add([("2024-01-01 01:00:00", 1)], 3)
    add([("2024-01-01 00:00:40", 1)], 4)  # not dropped before the watermark has moved
    assert (1, 1, 0) in run()
    add([("2024-01-01 00:00:41", 1)], 5)  # four sizes late: dropped
    assert max(h for _, h, _ in run()) <= 4


def test_tags_are_attached_once(spark):
    bridge = spark.createDataFrame([(1, 1, "a")], "novel_id long, tag_id long, by string")
    new = spark.createDataFrame([(1, 1, "b"), (1, 2, "c"), (1, 2, "b")], "novel_id long, tag_id long, by string")
    assert sorted(map(tuple, B.attach_once(bridge, new, ["novel_id", "tag_id"], "by").collect())) == [(1, 1, "a"), (1, 2, "b")]
