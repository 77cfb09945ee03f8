"""What workers make of tokens, against the same made of token columns by Spark."""

import random

from pyspark.sql import functions as F

from lexloom.operators import match as M
from lexloom.operators import sites as S

ENTRY = "phrase string, value string, kind string, prio int"


def given(spark):
    rng = random.Random(11)
    marks = ["a", "b", "c", "ß", " ", ".", "。", "“", "”", "(", "　", "é", "\n"]
    rows = [(i, f"n{i % 3}", "".join(rng.choices(marks, k=rng.randrange(0, 40)))) for i in range(150)] + [(999, "n0", None)]
    lines = spark.createDataFrame(rows, "line_id long, novel_id string, text string").coalesce(1)
    lexicon = spark.createDataFrame([("ab", "eins/x", "word", 4), ("ca", "ßb cd", "name", 2), ("abc", "(drei) vier", "word", 4), ("b", "", "word", 4)], ENTRY)
    readings = spark.createDataFrame([("a", "x/y"), ("c", "ß"), ("é", "z")], "ch string, readings string")
    layers = spark.createDataFrame([("n1", "ca", "own word", "ALL_WORDS"), ("n2", "bc", "éa", "FIRST_LETTER")], "scope string, phrase string, value string, cap string")
    return lines, lexicon, readings, layers


def rows_of(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


def test_texts_of_workers_are_those_of_token_columns(spark):
    lines, lexicon, readings, layers = given(spark)
    fields = F.transform("tokens", lambda t: t["dst"])
    shown = M.joined(M.displayed(F.col("tokens")))
    tokens = M.tokenize(lines, lexicon, readings, layers=layers, scope_col="novel_id", fields=M.SHOWN)
    want = rows_of(tokens, "line_id", shown)
    for most in (100, 0):  # sent, fetched
        assert rows_of(M.translate_lines(lines, lexicon, readings, layers, "novel_id", most), "line_id", "translated") == want
    plain = M.tokenize(lines, lexicon, readings)
    assert rows_of(M.joined_fields(lines, lexicon, readings, {"d": "dst"}, "|", "n"), "line_id", "d", "n") == rows_of(plain, "line_id", F.array_join(fields, "|"), F.size("tokens").cast("long"))
    by_line = M.tokenize(lines, lexicon, readings, layers=layers, scope_col="novel_id", fields=(*M.SHOWN, "reading"), by_line=True)
    whole = F.array_join(F.transform("tokens", lambda x: M.joined(M.displayed(x))), "\n")
    assert rows_of(M.translate_text(lines, lexicon, readings, layers, "novel_id"), "line_id", "translated") == rows_of(by_line, "line_id", whole)
    read = F.array_join(F.transform("tokens", lambda x: F.array_join(F.transform(x, lambda t: t["reading"]), " ")), "\n")
    assert rows_of(M.reading_of_text(lines, lexicon, readings, layers, "novel_id"), "line_id", "reading") == rows_of(by_line, "line_id", read)


def test_runs_of_fallback_tokens_without_a_shuffle(spark):
    lines, lexicon, readings, _ = given(spark)
    tokens, keys = M.tokenize(lines, lexicon, readings), ["line_id"]
    runs = M.fallback_runs(lines, lexicon, readings, keys)
    want = []
    for r in tokens.collect():
        run = None
        for k, t in enumerate(r["tokens"]):
            if t["source"] != "hanviet_fallback":
                run = None
            elif run is None:
                want.append(run := [r["line_id"], k, t["src"], t["dst"]])
            else:
                run[2] += t["src"]
                run[3] += " " + t["dst"]
    assert rows_of(runs, "line_id", "k", "text", "reading") == rows_of(M._runs_of(tokens, keys), "line_id", "k", "text", "reading") == sorted(map(tuple, want))
    for df in (M._runs_of(tokens.select("line_id", "tokens"), keys), runs):
        assert "hashpartitioning" not in df._jdf.queryExecution().executedPlan().toString()


def test_overlay_keeps_tokens_in_their_rows(spark):
    """Sent or fetched entries give the same; several orders of a phrase, lines without tokens; no shuffle of tokens."""
    lines, lexicon, readings, _ = given(spark)
    tokens = M.tokenize(lines, lexicon, readings, fields=("pos", "len", "src", "dst", "source", "reading"))
    tokens = tokens.withColumn("tokens", F.when(F.col("line_id") % 7 > 0, F.col("tokens")))
    entries = spark.createDataFrame([("n1", "ca", "2/x", "NONE", 2), ("n1", "ca", "1", "NONE", 1), ("n1", "bc", "ßd", "ALL_WORDS", 0), ("n2", " ", "_", "NONE", 0), (None, "a", "-", "NONE", 0)], "novel_id string, phrase string, value string, cap string, ord int")
    out = S.overlay_personal(tokens, entries, ["line_id"])
    assert "hashpartitioning" not in out._jdf.queryExecution().executedPlan().toString()
    got = rows_of(out, "line_id", F.to_json("tokens"))
    assert rows_of(S.overlay_personal(tokens, entries, ["line_id"], max_entries=0), "line_id", F.to_json("tokens")) == got
    laid = {t["dst"] for r in out.where("novel_id = 'n1'").collect() for t in r["tokens"] or () if t["source"] == "name" and t["src"] in ("ca", "bc")}
    assert laid == {"1", "ẞd"} and out.where("tokens IS NULL").count() == tokens.where("tokens IS NULL").count()
