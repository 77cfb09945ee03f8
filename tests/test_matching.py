"""Matching: entries that are sent against entries that are fetched, plain loops, options, and filters by many patterns."""

import random

import numpy as np
import pyarrow as pa
import pytest

from lexloom.operators import chapters as C
from lexloom.operators import corpus as J
from lexloom.operators import match as M
from lexloom.operators import overrides as O
from lexloom.operators import phrases as P

ENTRY = "phrase string, value string, kind string, prio int, cap string"


def plain_tokens(text, scope, lexicon, layers, readings):
    """A loop over the text, longest first; at one length the own layer, then the lexicon."""
    read = lambda c: readings[c].split("/")[0] if c in readings else c
    out, at = [], 0
    while at < len(text):
        for n in range(len(text) - at, 0, -1):
            src = text[at : at + n]
            hit = layers.get((scope, src)) or lexicon.get(src)
            if hit:
                out.append((at, n, hit[0], src, hit[1].split("/")[0], hit[1], " ".join(map(read, src)), hit[2]))
                break
        else:
            n, c = 1, text[at]
            raw = readings.get(c, c)
            out.append((at, 1, "hanviet_fallback" if c in readings else "unmatched", c, raw.split("/")[0], raw, read(c), None))
        at += n
    return out


def random_case(rng, letters="abcé好😀 ./"):
    word = lambda m: "".join(rng.choice(letters) for _ in range(rng.randint(1, m)))
    lexicon = {word(4): (rng.choice(["word", "pronoun"]), f"v{i}/x", None) for i in range(rng.randint(0, 15))}
    layers = {(rng.choice("st"), word(5)): ("name", f"L{i}", rng.choice(["NONE", "ALL_WORDS"])) for i in range(rng.randint(0, 9))}
    rows = [(k, rng.choice(["s", "t", "u", None]), "".join(rng.choice(letters + "zQ\n") for _ in range(rng.randint(0, 40)))) for k in range(30)]
    return lexicon, layers, [*rows, (30, "s", None), (31, None, "")]


READ = {"a": "ah/eh", "好": "hảo", "😀": "mặt"}
FIELDS = ("pos", "len", "source", "src", "dst", "raw", "reading", "cap")


@pytest.mark.parametrize("most", [3_000_000, 0])
def test_tokens_are_those_of_a_loop(spark, most):
    """most = 0: nothing is sent, every chunk fetches its entries."""
    rng = random.Random(3)
    lexicon, layers, rows = random_case(rng)
    entries = spark.createDataFrame([(p, v, k, 4, None) for p, (k, v, _) in lexicon.items()], ENTRY)
    own = spark.createDataFrame([(s, p, v, c) for (s, p), (_, v, c) in layers.items()], "scope string, phrase string, value string, cap string")
    lines = spark.createDataFrame(rows, "id long, novel string, text string")
    readings = spark.createDataFrame(list(READ.items()), "ch string, readings string")
    args = dict(max_scan_len=9, layers=own, scope_col="novel", max_entries=most)
    got = {r["id"]: [tuple(t) for t in r["tokens"]] for r in M.tokenize(lines, entries, readings, fields=FIELDS, **args).collect()}
    assert got == {k: plain_tokens(t or "", s, lexicon, layers, READ) for k, s, t in rows}
    by_line = {r["id"]: [[tuple(t) for t in line] for line in r["tokens"]] for r in M.tokenize(lines, entries, readings, fields=FIELDS, by_line=True, **args).collect()}
    assert by_line == {k: [plain_tokens(x, s, lexicon, layers, READ) if not P.is_blank(x) else [] for x in (t or "").split("\n")] for k, s, t in rows}


def test_sent_and_fetched_entries_give_the_same_tokens(spark):
    """All fields, several chunks, an empty lexicon, and rows of very different length."""
    rng = random.Random(8)
    words = ["".join(rng.choice("abcdef") for _ in range(rng.randint(1, 6))) for _ in range(3000)]
    lines = spark.createDataFrame([(k, " ".join(rng.choice(words) for _ in range(rng.choice([0, 3, 200])))) for k in range(300)], "id long, text string").repartition(3)
    readings = spark.createDataFrame([("a", "ah")], "ch string, readings string")
    for some in (words, []):
        entries = spark.createDataFrame([(w, f"v{w}", "word", 4, None) for w in some], ENTRY)
        one, two = ({r["id"]: r["tokens"] for r in M.tokenize(lines, entries, readings, max_scan_len=6, max_entries=m).collect()} for m in (10_000, -1))
        assert one == two


def test_shared_hashes_cost_nothing_but_time(monkeypatch):
    """With keys of a few bits most phrases share one; the tokens are those of the phrases all the same."""
    whole = P._key
    rng, pick = random.Random(1), M.first_alternative
    for bits in (0x3, 0xF000000000000003):
        monkeypatch.setattr(P, "_key", lambda h, n, scopes=0, bits=bits: whole(h, n, scopes) & np.uint64(bits))
        for _ in range(40):
            lexicon, layers, rows = random_case(rng)
            columns = [[None] * len(lexicon) + [s for s, _ in layers], [*lexicon, *(p for _, p in layers)], *([v[i] for v in (*lexicon.values(), *layers.values())] for i in range(3))]
            table, plain, own = P.entry_table(pa.table([pa.array(c, pa.string()) for c in columns], names=P.ENTRY.names).select(P.ENTRY.names), pick)
            index = P.Index(table, plain, own, P.Readings(list(READ.items()), pick))
            texts, scopes = [t or "" for *_, t in rows], [s for _, s, _ in rows]
            offsets, got = P.token_columns(texts, scopes, index, FIELDS, pick)
            flat = list(zip(*(got[f].to_pylist() for f in FIELDS), strict=True))
            assert [flat[a:b] for a, b in zip(offsets[:-1], offsets[1:], strict=True)] == [plain_tokens(t, s, lexicon, layers, READ) for t, s in zip(texts, scopes, strict=True)]


def test_index_in_a_file(spark, monkeypatch):
    """A lexicon over the size of a broadcast lies in one file that workers map; sent once for equal entries."""
    monkeypatch.setattr(M, "_SMALL", 10)
    entries = spark.createDataFrame([(f"w{k}", f"v{k}", "word", 4, None) for k in range(2000)], ENTRY)
    lines = spark.createDataFrame([(k, f"w{k}w{k + 1}") for k in range(50)], "id long, text string")
    none = spark.createDataFrame([], "ch string, readings string")
    found = lambda: {r["id"]: [t["dst"] for t in r["tokens"]] for r in M.tokenize(lines, entries, none, fields=("dst",), max_scan_len=9).collect()}
    first, sent = found(), next(iter(M._SENT.values()))
    assert first == {k: [f"v{k}", f"v{k + 1}"] for k in range(50)}
    assert found() == first and next(iter(M._SENT.values())) is sent and sent[1].value[0].endswith(".arrow")


def test_window_cap_and_choice(spark):
    """Pronouns don't widen the window; a cap shortens it; another choice of alternatives holds for entries, readings and what is left."""
    entries = spark.createDataFrame([("abcd", "long", "pronoun", 3, None), ("ab", "x/y", "word", 4, None), ("a", "z", "name", 2, None)], ENTRY)
    lines = spark.createDataFrame([(1, "abcd/")], "id long, text string")
    readings = spark.createDataFrame([("c", "p/q")], "ch string, readings string")
    said = lambda **k: [(t["src"], t["dst"]) for t in M.tokenize(lines, entries, readings, fields=("src", "dst"), **k).first()["tokens"]]
    assert M.scan_window(entries) == 2
    assert said() == [("ab", "x"), ("c", "p"), ("d", "d"), ("/", "")]
    assert said(max_scan_len=1) == [("a", "z"), ("b", "b"), ("c", "p"), ("d", "d"), ("/", "")]
    assert said(max_scan_len=4) == [("abcd", "long"), ("/", "")]
    assert said(pick=lambda v: v.split("/")[-1]) == [("ab", "y"), ("c", "q"), ("d", "d"), ("/", "")]


def test_clashing_columns_are_refused(spark):
    entries, none = spark.createDataFrame([], ENTRY), spark.createDataFrame([], "ch string, readings string")
    with pytest.raises(ValueError):
        M.tokenize(spark.createDataFrame([("x", 1)], "text string, tokens int"), entries, none)
    with pytest.raises(ValueError):
        M.translate_text(spark.createDataFrame([("x", 1)], "text string, translated int"), entries, none)


OVER = "tier string, track string, novel_id string, phrase string, value string, cap string, is_active boolean, user_id long"


def test_styles_go_with_values_in_every_tier(spark):
    lexicon = spark.createDataFrame([("他", "hắn", "word", 4)], "phrase string, value string, kind string, prio int")
    readings = spark.createDataFrame([("龘", "đạp")], "ch string, readings string")
    over = spark.createDataFrame([("global", "name", None, "萧炎", "tiêu viêm", "ALL_WORDS", True, None), ("global", "phrase", None, "好", "hảo lắm", "FIRST_LETTER", True, None), ("novel", "phrase", "b", "萧炎", "ai đó", "NONE", True, None), ("user", "name", "b", "好", "tốt", "ALL_WORDS", True, 7), ("user", "name", "b", "好", "xấu", "NONE", True, 8)], OVER)
    rows = spark.createDataFrame([("a", "他萧炎好"), ("b", "他萧炎好\n\n龘")], "novel_id string, text string")
    shown = {r["novel_id"]: r["translated"] for r in J.translate_corpus(rows, lexicon, readings, over.where("tier <> 'user'").drop("user_id"), needs=rows["text"].isNotNull()).collect()}
    assert shown == {"a": "Hắn Tiêu Viêm Hảo lắm", "b": "Hắn ai đó Hảo lắm\n\nĐạp"}
    titles = rows.withColumnRenamed("text", "original").selectExpr("novel_id", "original", "'old' AS title", "'' AS text")
    again = {r["novel_id"]: r["title"] for r in J.retranslate(titles, "original", "title", lexicon, readings, over.where("tier <> 'user'").drop("user_id")).collect()}
    assert again == shown
    assert [r["reading"] for r in M.reading_of_text(rows.where("novel_id = 'b'"), lexicon, readings).collect()] == ["他 萧 炎 好\n\nđạp"]
    readers = spark.createDataFrame([("b", 7), ("b", 8), ("b", 9)], "novel_id string, user_id long")
    layers = {(r["scope"], r["phrase"]): (r["value"], r["cap"]) for r in O.reader_layers(over, readers).collect()}
    assert layers[('["b","7"]', "好")] == ("tốt", "ALL_WORDS") and layers[('["b","8"]', "好")] == ("xấu", "NONE")
    assert ('["b","9"]', "好") not in layers and all(layers[f'["b","{u}"]', "萧炎"] == ("ai đó", "NONE") for u in (7, 8, 9))


def test_many_patterns(spark):
    rng = random.Random(2)
    word = lambda m: "".join(rng.choice("ab好 .|") for _ in range(rng.randint(1, m)))
    texts = [word(40) for _ in range(200)] + [None, ""]
    lines = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    for n, per_pass in ((3, 10), (60, 10), (60, 1000)):
        patterns = [word(6) + "好" for _ in range(n)]
        kept = C.drop_blacklisted(lines, spark.createDataFrame([(p,) for p in [*patterns, None]], "pattern string"), per_pass=per_pass)
        assert sorted(r["id"] for r in kept.collect()) == [i for i, t in enumerate(texts) if t is None or not any(p in t for p in patterns)]
    empty = C.drop_blacklisted(lines, spark.createDataFrame([("",), ("x",)], "pattern string"))
    assert [r["id"] for r in empty.collect()] == [200]
