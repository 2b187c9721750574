"""Links of small pages, their targets and the text around them."""

import pytest
from pyspark.sql import functions as F

from lectern.functions import urls
from lectern.operators import links

BASE = "https://canvas.test/courses/1/pages/week"


def found(spark, html, url=BASE):
    df = spark.createDataFrame([(1, url, html)], "page_id long, url string, html string")
    return [r.asDict() for r in links.page_links(df).orderBy("pos").collect()]


def test_forms_of_file_addresses(spark):
    forms = ["/courses/1/files/31/download?download_frd=1", "/files/31/download", "/api/v1/files/31", "/api/v1/courses/1/files/31", "/courses/1/files?preview=31", "//canvas.test/files/31#preview", "../files/31/preview/", "/courses/1/files/?file_id=31", "https://CANVAS.test:443/files/31"]
    rows = found(spark, "".join(f'<a href="{f}">x</a>' for f in forms))
    assert [(r["kind"], r["file_id"]) for r in rows] == [("file", 31)] * len(forms)


def test_what_is_no_file(spark):
    forms = ["/files/9/evil/x", "/x/files/9", "/files/09", "/files?preview=9", "/courses/1/files?preview=9&preview=8", "http://canvas.test/files/9", "https://canvas.test.evil/files/9", "https://u:p@canvas.test/files/9", "https://evil.test/files/9", "javascript:alert(1)", "/a b/files/9", "/courses/1/pages/other", ""]
    rows = found(spark, "".join(f'<a href="{f}">x</a>' for f in forms) + "<a name=x>y</a><a>z</a>")
    assert [(r["kind"], r["file_id"], r["target"]) for r in rows] == [("unsupported", None, None)] * (len(forms) + 2)


def test_endpoint_without_href_and_entities(spark):
    rows = found(spark, """<a data-api-endpoint="/api/v1/files/1" data-x='>'>A</a><a HREF="/ignored" data-api-endpoint='/api/v1/files/2'>B</a><a href="/files/3" data-api-endpoint="https://evil.test/files/4">C</a>
        <a href="https://public.test/slides.PDF?a=1&amp;b=2#page=3">P&amp;Q</a><a href="/attachment" data-file-id="31">own</a><a href="https://other.test/attachment" data-file-id="31">other</a>""")
    assert [(r["kind"], r["file_id"]) for r in rows] == [("file", 1), ("file", 2), ("file", 3), ("document", None), ("file", 31), ("unsupported", None)]
    assert (rows[3]["target"], rows[3]["link_text"]) == ("https://public.test/slides.PDF?a=1&b=2", "P&Q")


def test_inactive_content_and_fragments(spark):
    html = """<script>var a = '<a href="/files/1">no</a>';</script><form action="/delete"><a href="/files/2">no</a></form><!-- <a href="/files/5">no</a> --><iframe src="/files/3"></iframe>
        <template><a href="/files/6">no</a></template><a href="#section">jump</a><a href="/files/4">yes</a><style>a{}</style><form><a href="/files/7">open to the end"""
    assert [(r["pos"], r["file_id"]) for r in found(spark, html)] == [(0, 4)]


CONTEXTS = [
    ("<h1>A</h1><h2>B</h2><h3>C</h3><h2>D <i>e</i></h2><p>x <a href='/files/1'>l</a> y</p>", "A D e", "", "x l y"),
    ("<h2>B</h2><h1>A</h1><a href='/files/1'>l</a>", "A", "", ""),
    ("<h1>A <a href='/files/1'>l</a></h1>", "", "", ""),
    ("<p>Intro</p><a href='/files/1'>l</a>", "", "Intro", ""),
    ("<p>Intro</p><h2>B</h2><a href='/files/1'>l</a>", "B", "", ""),
    ("<p>Intro</p><ul><li>one</li><li>two <a href='/files/1'>l</a></li></ul>", "", "Intro", "two l"),
    ("<p>Intro</p><ul><li><p>inner</p><ol><li><a href='/files/1'>l</a></li></ol></li></ul>", "", "inner", "l"),
    ("<p>Intro</p><ul><li>a</li></ul><a href='/files/1'>l</a>", "", "", ""),
    ("</ul></li><p>Intro</p><ul><li><a href='/files/1'>l</a></li></ul>", "", "Intro", "l"),
    ("<p>With <a href='#x'>a link</a></p><a href='/files/1'>l</a>", "", "", ""),
    (f"<p>{'w' * 500}</p><a href='/files/1'>l</a>", "", "w" * 500, ""),
    (f"<p>{'w' * 501}</p><a href='/files/1'>l</a>", "", "", ""),
    ("<table><tr><td>cell <a href='/files/1'>l</a></td><td>next</td></tr></table>", "", "", "cell l"),
    ("<li>outer <p>inner</p> <a href='/files/1'>l</a> rest</li>", "", "inner", "outer l rest"),
    ("<p>a&nbsp;&lt; b<p>c <a href='/files/1'>l</a>", "", "", "c l"),
]


def test_context(spark):
    df = spark.createDataFrame([(i, BASE, c[0]) for i, c in enumerate(CONTEXTS)], "page_id long, url string, html string")
    rows = links.page_links(df).filter("kind = 'file'").orderBy("page_id").collect()
    assert [(r["heading"], r["before"], r["around"], r["link_text"]) for r in rows] == [(*c[1:], "l") for c in CONTEXTS]


def test_limits_count_characters_and_all_anchors(spark):
    pages = ["é" * 1_999_000 + '<a href="/files/1">x</a>', '<a href="#x">x</a>' * 2001, '<a href="#x">x</a>' * 2000, "x" * 2_000_001, None]
    df = spark.createDataFrame([(i, BASE, p) for i, p in enumerate(pages)], "page_id long, url string, html string")
    assert sorted((r["page_id"], r["file_id"], r["problem"]) for r in links.page_links(df).collect()) == [(0, 1, None), (1, None, "links"), (3, None, "size")]


def test_long_attributes_and_bare_marks(spark):
    rows = found(spark, f"<p data-x='{'<' * 50_000}' y={'z' * 50_000}>1 < 2 <a href='/files/1'>l</a> <b")
    assert [(r["file_id"], r["around"][:7]) for r in rows] == [(1, "1 < 2 l")]


@pytest.mark.parametrize(
    ("href", "want"),
    [("../x", "https://a.test/p/x"), ("./x?y=../z", "https://a.test/p/q/x?y=../z"), ("../../../../x", "https://a.test/x"), ("..", "https://a.test/p/"), ("x/../y/.", "https://a.test/p/q/y/"), ("/a/b/../c#d/../e", "https://a.test/a/c#d/../e"), ("x..y", "https://a.test/p/q/x..y")],
)
def test_dot_segments(spark, href, want):
    df = spark.createDataFrame([(href, "https://a.test/p/q/r")], "h string, b string")
    assert df.select(urls.resolve(F.col("h"), F.col("b"))).first()[0] == want
