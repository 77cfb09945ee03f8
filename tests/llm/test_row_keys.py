"""Rows without an id of their own: several null ids, one id on several rows."""

import pytest

from lexloom.llm.substring import substring_dedup
from lexloom.llm.suffixes import suffix_dedup


def words(tag, n):
    return [f"{tag}{i}" for i in range(n)]


SHARED = words("s", 60)
CLEAN = " ".join(words("c", 90))
ROWS = [(1, " ".join(SHARED + words("a", 20))), (None, " ".join(words("n", 10) + SHARED)), (None, CLEAN), (7, " ".join(words("m", 5) + SHARED)), (7, CLEAN + " end")]


@pytest.mark.parametrize("dedup", [substring_dedup, suffix_dedup])
def test_spans_stay_in_their_row(spark, dedup):
    rows = dedup(spark.createDataFrame(ROWS, "doc_id long, text string")).collect()
    left = sorted((r["doc_id"] or -1, r["n_removed"], r["kept"]) for r in rows)
    # the clean null text repeats one of id 7
    want = [(1, 0, ROWS[0][1]), (-1, 60, " ".join(words("n", 10))), (-1, 90, ""), (7, 60, " ".join(words("m", 5))), (7, 0, CLEAN + " end")]
    assert left == sorted(want)


def test_stages_decide_by_row(spark):
    import corpus_pipeline as P

    near = words("b", 100)
    near[50] = "other"
    rows = [(1, " ".join(words("k", 40))), (None, " ".join(words("k", 40))), (None, CLEAN), (None, CLEAN), (5, " ".join(words("x", 9))), (5, " ".join(words("x", 9))), (None, " ".join(words("b", 100))), (None, " ".join(near))]
    docs = spark.createDataFrame([(d, t, len(t)) for d, t in rows], "doc_id long, text string, n_chars long")
    texts = lambda out: sorted((r["doc_id"] or -1, r["text"]) for r in out.collect())
    want = [(1, rows[0][1]), (-1, CLEAN), (5, rows[4][1])]
    pair = [(-1, rows[6][1]), (-1, rows[7][1])]
    assert texts(P.exact(spark, docs, "")) == sorted(want + pair)
    out = texts(P.near(spark, docs, ""))
    assert len(out) == 4 and [x for x in out if x not in pair] == sorted(want)
    cut = spark.createDataFrame([(d, t, len(t)) for d, t in ROWS], "doc_id long, text string, n_chars long")
    out = P.passages(spark, cut, "")
    assert out.columns == cut.columns
    assert texts(out) == sorted([(1, ROWS[0][1]), (-1, " ".join(words("n", 10))), (7, " ".join(words("m", 5))), (7, CLEAN + " end")])
