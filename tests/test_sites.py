"""Site rules, page jobs, imports and overlays on small cases."""

import random

from pyspark.sql import functions as F

from lexloom.operators import corpus as J
from lexloom.operators import match as M
from lexloom.operators import sites as S
from lexloom.sources.files import scan_lines
from lexloom.streaming import live

ENTRY = "phrase string, value string, kind string, prio int"
HOST_ROWS = [(1, "one", "one.test", False, r"\.htm$"), (2, "two", "two.test", True, None)]
RULE_ROWS = [
    ("one", "title", r"/div[^/]*\.summary\b[^/]*/h1$", None, "text"), ("one", "author", r"/a$", "author", "text"), ("one", "cover", r"/meta\[og:image\]$", None, "src"), ("one", "chapter", r"/ul\.part/.*a$", None, "tip"),
    ("two", "item", r"/li\.book$", None, "text"), ("two", "url", r"/h3/a$", None, "href"), ("two", "title", r"/h3/a$", None, "text"), ("two", "author", r"/label$", None, "text"), ("two", "cover", r"/img$", None, "src"),
    ("two", "chapter_title", r"/h1\.real$", None, "text"),
]
LANDING = '<head><meta property="og:image" content="/c.png"></head><div class="x summary"><h1> Tên </h1></div><a href="/author/1">Ai</a><a href="/author/2">Khác</a><p></p>'
LISTS = '<ul class="part"><li><a href="/c/1" title="Một">1</a></li></ul><ul class="part"><li><a href="/c/2">Hai</a></li><li><a href="/c/1">again</a></li></ul>'
BOOKS = '<ul><li class="book"><h3><a href="/b/1">A</a></h3><label>x</label><label>y</label><img data-src="//p/1.png"></li><li class="book"><h3><a href="/b/1">again</a></h3></li><li class="book"><h3><a href="/b/2">B</a></h3></li><li class="book"><b>none</b></li></ul>'
PROSE = '<h1>Site</h1><h1 class="real">Đúng</h1><div><p>một hai ba bốn năm sáu bảy tám</p><p>quảng cáo một hai ba bốn</p></div>'
PAGES = [
    (1, "https://one.test/book/7", LANDING + '<a href="/mulu/7">x</a>'), (2, "https://one.test/mulu/7", LISTS), (3, "https://one.test/old.htm", LISTS), (4, "https://sub.one.test/", "<title> Chung </title>" + LISTS),
    (5, "https://m.two.test/list", BOOKS), (6, "https://two.test/read/1", PROSE), (7, "https://two.test/empty", ""), (8, None, None),
]


def given(spark):
    pages = spark.createDataFrame(PAGES, "page_id long, url string, html string")
    return pages, spark.createDataFrame(HOST_ROWS, S.HOSTS), spark.createDataFrame(RULE_ROWS, S.RULES)


def test_sites_and_meta(spark):
    pages, hosts, rules = given(spark)
    assert {r["page_id"]: r["site"] for r in S.page_sites(pages, hosts).collect()} == {1: "one", 2: "one", 3: "one", 5: "two", 6: "two", 7: "two"}
    meta = {r["page_id"]: tuple(r)[1:] for r in S.book_meta(pages, hosts, rules).collect()}
    assert sorted(meta) == [1, 2, 3, 4, 5, 6, 7, 8]
    assert meta[1] == ("Tên", None, "https://one.test/c.png", "Ai")
    assert meta[4][0] == "Chung" and meta[2][0] is None


def test_records_and_lists(spark):
    pages, hosts, rules = given(spark)
    found = sorted((tuple(r)[0:1] + tuple(r)[2:] for r in S.records(pages, hosts, rules).collect()), key=str)
    assert found == [(5, "https://m.two.test/b/1", "A", None, "https://p/1.png", "x"), (5, "https://m.two.test/b/2", "B", None, None, None)]
    lists = S.site_chapters(pages, hosts, rules)
    got = {}
    for r in S.follow_toc(pages, lists).collect():
        got.setdefault(r["page_id"], {})[r["number"]] = (r["title"], r["url"])
    want = {1: ("Một", "https://one.test/c/1"), 2: ("Hai", "https://one.test/c/2")}
    assert got[1] == want and got[2] == want and 3 not in got


def test_chapter_content_and_page_text(spark):
    pages, hosts, rules = given(spark)
    patterns = spark.createDataFrame([("quảng cáo",)], "pattern string")
    out = {r["page_id"]: (r["title"], r["text"]) for r in S.chapter_content(pages, hosts, rules, patterns, r"[\p{L}]").collect()}
    assert out[6] == ("Đúng", "một hai ba bốn năm sáu bảy tám") and 7 not in out and 8 not in out
    lexicon, readings = spark.createDataFrame([("một", "1", "word", 4)], ENTRY), spark.createDataFrame([], "ch string, readings string")
    shown = S.translate_pages(spark.createDataFrame([(1, None, "<p>một<script>một</script></p> <b>một</b>")], "page_id long, url string, html string"), lexicon, readings)
    assert [r["translated"] for r in shown.orderBy("node").collect()] == ["1", "1"]
    titles = S.translate_listing(spark.createDataFrame([("một", None)], "title string, description string"), lexicon, readings).first()
    assert (titles["title_translated"], titles["description_translated"]) == ("1", None)


def test_ingest_books(spark):
    pages, hosts, rules = given(spark)
    lexicon, readings = spark.createDataFrame([("Tên", "Name", "word", 4)], ENTRY), spark.createDataFrame([], "ch string, readings string")
    none = spark.createDataFrame([], "tier string, track string, novel_id string, phrase string, value string, cap string, is_active boolean")
    stored = spark.createDataFrame([("https://one.test/mulu/7", "one-7")], "source_url string, slug string")
    books, chapters = S.ingest_books(pages.where("page_id < 4"), stored, hosts, rules, lexicon, readings, none, r"\p{L}")
    assert [(r["page_id"], r["slug"], r["original_title"], r["title"]) for r in books.collect()] == [(1, "one-7-2", "Tên", "Name")]
    assert sorted((r["page_id"], r["chapter_number"], r["original_title"], r["status"]) for r in chapters.collect()) == [(1, 1, "Một", "PENDING"), (1, 2, "Hai", "PENDING")]


def test_reslug_and_user_overrides(spark):
    rows = [(1, "old", "https://www.site.test/b/12"), (2, "site-12", "https://site.test/b/12"), (3, "site-12-2", "https://site.test/x/12"), (4, "kept", None)]
    out = S.reslug(spark.createDataFrame(rows, "novel_id long, slug string, source_url string"))
    assert {r["novel_id"]: r["slug"] for r in out.collect()} == {1: "site-12-3", 2: "site-12", 3: "site-12-2", 4: "kept"}
    entry = "novel_id long, phrase string, value string, cap string, updated_at long"
    both = S.user_overrides(spark.createDataFrame([(1, "a", "b", "NONE", 5)], entry), spark.createDataFrame([(2, "c", "d", "NONE", 6), (9, "e", "f", "NONE", 7)], entry), out)
    assert sorted((r["slug"], r["track"], r["phrase"]) for r in both.collect()) == [("site-12", "name", "c"), ("site-12-3", "phrase", "a")]


def overlaid(tokens, entries):
    """Plain version: one phrase after the other, longest first."""
    for phrase, value in sorted(entries, key=lambda e: -len(e[0])):
        out, i = [], 0
        while i < len(tokens):
            j, text = i, ""
            while j < len(tokens) and len(text) < len(phrase):
                text += tokens[j][0]
                j += 1
            if text == phrase:
                out.append((phrase, value, " ".join(t[2] for t in tokens[i:j])))
                i = j
            else:
                out.append(tokens[i])
                i += 1
        tokens = out
    return tokens


def test_overlay_is_brute_force(spark):
    rng = random.Random(3)
    lexicon = spark.createDataFrame([("ab", "1", "word", 4), ("ca", "2", "word", 4)], ENTRY)
    readings = spark.createDataFrame([("a", "x"), ("b", "y")], "ch string, readings string")
    rows = [(i, f"n{i % 3}", "".join(rng.choices("abc", k=rng.randrange(0, 30)))) for i in range(120)]
    entries = [(f"n{s}", p, f"{p.upper()}{s}/z", "NONE", k) for s in range(2) for k, p in enumerate(("abc", "bc", "cab", "b", "caab", "cc"))]
    lines = M.tokenize(spark.createDataFrame(rows, "line_id long, novel_id string, text string"), lexicon, readings, fields=("pos", "len", "src", "dst", "source", "reading"))
    before = {r["line_id"]: [(t["src"], t["dst"], t["reading"]) for t in r["tokens"]] for r in lines.collect()}
    out = S.overlay_personal(lines, spark.createDataFrame(entries, "novel_id string, phrase string, value string, cap string, ord int"), ["line_id"])
    after = {r["line_id"]: [(t["src"], t["dst"], t["reading"]) for t in r["tokens"]] for r in out.collect()}
    for i, novel, text in rows:
        assert after[i] == overlaid(before[i], [(p, v.split("/")[0]) for s, p, v, _, _ in entries if s == novel]), (text, novel)


def test_overlay_of_long_lines(spark):
    """A line of 100,000 tokens: as many spans, each looked at twice."""
    n = 100_000
    token = "struct<pos:int,len:int,src:string,dst:string,source:string,reading:string>"
    tokens = f"transform(sequence(0, {n - 1}), i -> named_struct('pos', cast(i as int), 'len', 1, 'src', substring('abc', i % 3 + 1, 1), 'dst', 'x', 'source', 'unmatched', 'reading', 'r'))"
    lines = spark.range(1).selectExpr("id AS line_id", "'n' AS novel_id", f"cast({tokens} AS array<{token}>) AS tokens")
    entries = spark.createDataFrame([("n", "bc", "BC", "NONE", 0), ("n", "ca", "CA", "NONE", 1)], "novel_id string, phrase string, value string, cap string, ord int")
    out = S.overlay_personal(lines, entries, ["line_id"]).selectExpr("size(tokens) AS n", "size(filter(tokens, t -> t.dst = 'BC')) AS bc", "size(filter(tokens, t -> t.dst = 'CA')) AS ca").first()
    assert (out["bc"], out["ca"], out["n"]) == (33333, 0, n - 33333)


def test_one_site_by_a_table_function_another_by_rules(spark):
    """Private-use marks become characters first (another column function), then Python finds the list."""
    import json

    from lexloom.functions import text as X

    html = json.dumps({"items": [{"t": "chapter \ue001", "id": 5}, {"t": "next \ue009", "id": 6}]}, ensure_ascii=False)
    pages = spark.createDataFrame([(1, "https://odd.test/book", html), (2, "https://one.test/mulu/7", LISTS), (3, "https://odd.test/off.htm", html), (4, "https://odd.test/none", None)], "page_id long, url string, html string")
    hosts = spark.createDataFrame([*HOST_ROWS, (9, "odd", "odd.test", False, r"\.htm$")], S.HOSTS)

    def extract(url, text):
        return [(x["t"], f"{url}/{x['id']}") for x in json.loads(text)["items"]]

    odd = S.Adapter(S.chapters_by(extract), lambda html: X.remap_codepoints(html, "\ue001", "一"))
    found = S.site_chapters(pages, hosts, spark.createDataFrame(RULE_ROWS, S.RULES), {"odd": odd})
    got = {}
    for r in found.orderBy("page_id", "number").collect():
        got.setdefault(r["page_id"], []).append((r["title"], r["url"]))
    assert got[1] == [("chapter 一", "https://odd.test/book/5"), ("next □", "https://odd.test/book/6")]
    assert set(got) == {1, 2} and len(got[2]) == 2


def test_scan_and_import(spark, tmp_path):
    files = [("u16", b"\xff\xfe" + "một\r\nhai\n".encode("utf-16-le")), ("bom", b"\xef\xbb\xbfx=y"), ("bad", b"a\xffb\n\nc"), ("none", None)]
    rows = {(r["path"], r["line_no"]): r["text"] for r in scan_lines(spark.createDataFrame(files, "path string, content binary")).collect()}
    assert rows == {("u16", 0): "một", ("u16", 1): "hai", ("bom", 0): "x=y", ("bad", 0): "a�b", ("bad", 1): "", ("bad", 2): "c"}
    stored = spark.createDataFrame([("n", 4)], "novel_id string, chapter_number long")
    text = "第一章 起\n他来了。\n第二章 承\n<script>他走了。"
    given = spark.createDataFrame([("p", text.encode()), ("q", b"no heads. here")], "path string, content binary")
    got = [tuple(r) for r in J.import_files(given, stored, F.lit("n")).orderBy("chapter_number").collect()]
    assert got == [("n", 5, "第一章 起", "第一章 起", "他来了。", "ZH", "SCRAPED"), ("n", 6, "第二章 承", "第二章 承", "他走了。", "ZH", "SCRAPED"), ("n", 7, "Chương 1", "Chương 1", "no heads. here", "VI", "SCRAPED")]


def test_files_in_splits_have_the_same_lines(spark, tmp_path):
    """Splits of a few bytes; in UTF-16 the bytes of a line end across two characters, at even and odd places."""
    from lexloom.sources.files import scan_large

    rng = random.Random(4)
    letters = ["a", "é", "好", "\u0a41", "\u4e00", "\u0a0a", "\u0100", "😀", "\n", "\r\n", "\r", "=", " "]
    texts = ["".join(rng.choice(letters) for _ in range(rng.randint(1, 300))) for _ in range(6)] + ["\n\n", "x"]
    files = [(f"{tmp_path}/f{k}", t.encode("utf-16-le") if k % 2 else t.encode()) for k, t in enumerate(texts)]
    files = [(p, (b"\xff\xfe" if k % 2 else b"\xef\xbb\xbf" if k % 3 == 0 else b"") + b) for k, (p, b) in enumerate(files)]
    for p, b in files:
        with open(p, "wb") as f:
            f.write(b)
    want = sorted((r["path"].rsplit("/")[-1], r["line_no"], r["text"]) for r in scan_lines(spark.createDataFrame(files, "path string, content binary")).collect())
    before = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    for k in before:
        spark.conf.set(k, "40")
    try:
        got = sorted((r["path"].rsplit("/")[-1], r["line_no"], r["text"]) for r in scan_large(spark, [p for p, _ in files]).collect())
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert got == want


def test_streams_import_and_translate(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    run = lambda: live.import_new(spark, str(folder), str(tmp_path / "out"), str(tmp_path / "state"), F.lit("n"))
    for k in (1, 2):
        (folder / f"{k}.txt").write_text(f"第{k}章 a\n他{k}。")
        assert sorted(r["chapter_number"] for r in run().collect()) == list(range(1, k + 1))
    assert run().count() == 2
    rows = tmp_path / "rows"
    spark.createDataFrame([(1, "a", "他们"), (2, "b", "他们\n他")], "id long, novel_id string, text string").write.parquet(str(rows))
    lexicon, readings = spark.createDataFrame([("他", "hắn", "word", 4), ("他们", "họ", "word", 4)], ENTRY), spark.createDataFrame([], "ch string, readings string")
    over = spark.createDataFrame([("novel", "name", "b", "他", "y", "NONE", True)], "tier string, track string, novel_id string, phrase string, value string, cap string, is_active boolean")
    stream = live.translate_stream(spark.readStream.schema("id long, novel_id string, text string").parquet(str(rows)), lexicon, readings, over)
    out = {r["id"]: r["translated"] for r in live.run_once(stream.select("id", "translated"), ["id"], str(tmp_path / "t")).collect()}
    assert out == {1: "Họ", 2: "Họ\nY"}
