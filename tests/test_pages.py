"""Page extraction on small pages, chapter sizes, slugs and files."""

from lexloom.operators import chapters as C
from lexloom.operators import library as B
from lexloom.operators import pages as P

PROSE = "她走进了房间然后停下来看着窗外"


def pages(spark, *html):
    return spark.createDataFrame([(i, "http://www.book.site/n/1/", h) for i, h in enumerate(html)], "page_id long, url string, html string")


def test_content(spark):
    got = P.page_content(
        pages(
            spark,
            f"<title>T</title><nav>{PROSE}{PROSE}{PROSE}</nav><div id=a><p>{PROSE}<p>{PROSE}二<b>!</b></div><div><p>{PROSE}</div>",
            f"<h1> H </h1><div>{PROSE}<br>{PROSE}三<br/></div>",
            "<title> only </title><p>短</p>",
            f"<div><p><a href=x>{PROSE}</a>{PROSE[:8]}</p></div>",
            "",
            None,
        )
    )
    rows = {r["page_id"]: (r["title"], r["text"]) for r in got.collect()}
    assert rows[0] == ("T", f"{PROSE}\n{PROSE}二!")
    assert rows[1] == ("H", f"H {PROSE}\n{PROSE}三")  # the document wins, as the parent of the block; only breaks end lines
    assert rows[2] == ("only", "短")
    assert rows[3] == (None, PROSE + PROSE[:8])
    assert rows[4] == rows[5] == (None, "")


def test_unclosed_inline(spark):
    nodes = P.html_nodes(pages(spark, "<p><b>x<p>y</b>z"))
    rows = {r["node"]: (r["parent"], r["tag"], r["text"], r["para"]) for r in nodes.collect()}
    assert [rows[k][1] for k in sorted(rows)] == ["p", "b", "#text", "p", "b", "#text", "#text"]
    assert rows[6] == (5, "#text", "y", 4) and rows[7] == (4, "#text", "z", 4)


def test_links(spark):
    menu = "".join(f"<a href=/m{i}>m{i}</a>" for i in range(6))
    listed = "".join(f"<li><a href='{i}.html'>第{i}章</a></li>" for i in (1, 2, 2, 3))
    df = pages(spark, f"<div>{menu}</div><ul>{listed}</ul>", f"<div>{menu}</div>", "<a href=/x>x</a>", "<p><a href='/mulu/'>go</a><a href=/b>目录</a></p>", "<a href='http://other.site/mulu'>a</a>")
    got = {}
    for r in P.chapter_links(df).orderBy("page_id", "number").collect():
        got.setdefault(r["page_id"], []).append((r["title"], r["url"]))
    assert got[0] == [(f"第{i}章", f"http://www.book.site/n/1/{i}.html") for i in (1, 2, 3)]
    assert [t for t, _ in got[1]] == [f"m{i}" for i in range(6)]
    assert {r["page_id"]: r["url"] for r in P.toc_links(df).collect()} == {3: "http://www.book.site/mulu/"}


def test_sizes(spark):
    texts = ["", None, "a" * 7000, "b" * 3100 + ". " + "c" * 10, "x" * 3000]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {}
    for r in C.split_by_size(docs).orderBy("doc_id", "piece").collect():
        got.setdefault(r["doc_id"], []).append(len(r["text"]))
    assert got == {2: [3000, 3000, 1000], 3: [3101, 10], 4: [3000]}
    parts = spark.createDataFrame([(1, 1, "t", "d" * 12000), (1, 2, "u", "e" * 12001)], "doc_id long, chapter_number long, title string, raw_text string")
    rows = C.cap_oversized(parts).orderBy("chapter_number").collect()
    assert [r["title"] for r in rows] == ["t", *[f"u (phần {i})" for i in range(1, 6)]]
    assert [r["chapter_number"] for r in rows] == [1, 2, 3, 4, 5, 6]


def test_slugs(spark):
    new = spark.createDataFrame([(1, "a"), (2, "a"), (3, "a"), (4, "b"), (5, "a-2")], "id long, base string")
    taken = spark.createDataFrame([("a",), ("a-3",)], "slug string")
    got = {r["id"]: r["slug"] for r in B.assign_slugs(new, taken, "base", ["id"]).collect()}
    assert len(set(got.values())) == 5 and got[1] == "a-2" and got[4] == "b" and not set(got.values()) & {"a", "a-3"}


def test_cascade(spark):
    parents = spark.createDataFrame([(1,), (2,)], "id long")
    children = spark.createDataFrame([(1, 10), (2, 20), (None, 30)], "parent long, x long")
    kept, cut, loose = B.cascade_delete(parents, parents.where("id = 1"), "id", {"c": (children, "parent")}, {"d": (children, "parent")})
    assert [r["id"] for r in kept.collect()] == [2]
    assert {r["x"] for r in cut["c"].collect()} == {20, 30}
    assert {r["x"]: r["parent"] for r in loose["d"].collect()} == {10: None, 20: 2, 30: None}


def test_files(spark):
    texts = ["héllo", "第一章", "第一章内容在这里", "第一章內容在這裡"]
    raw = [b"\xef\xbb\xbf" + texts[0].encode(), texts[1].encode(), texts[2].encode("gb18030"), b""]
    from lexloom.sources.files import decode_files

    files = spark.createDataFrame([(str(i), bytearray(b)) for i, b in enumerate(raw)], "path string, content binary")
    rows = {r["path"]: (r["text"], r["encoding"]) for r in decode_files(files).collect()}
    assert rows == {"0": (texts[0], "utf-8"), "1": (texts[1], "utf-8"), "2": (texts[2], "gbk"), "3": ("", "utf-8")}
