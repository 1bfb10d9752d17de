import html
import re

import pytest

from formline.llm import wrapper
from formline.llm.queries import QUERIES
from tests.llm.conftest import SF

PLAIN = """<html><body><nav><ul><li><a href="/a">Home {i}</a></li></ul></nav><div class="ad">Buy {i}</div><article><h1>Title {i}</h1>
<p>One <b>bold {i}</b>
 and&amp;more<p>Two</p><ul><li>x<li>y</ul><script>var a = "</p><p>no";</script><form>Name <input></form><div id="comments"><p>Nice!</p></div></article>
<aside>Side {i}</aside><footer>Foot</footer></body></html>"""


def pages(spark, rows):
    return spark.createDataFrame(rows, "page_id long, url string, html string")


def texts(df):
    return {r["page_id"]: r["text"] for r in wrapper.extract(df).collect()}


def test_article_without_furniture(spark):
    got = texts(pages(spark, [(i, f"http://a.example/{i}", PLAIN.format(i=i)) for i in range(6)]).repartition(3))
    assert got == {i: f"Title {i}\nOne bold {i} and&more\nTwo\nx\ny" for i in range(6)}


def test_constant_nodes_are_template_where_there_is_no_article(spark):
    body = "<body><div><p>Welcome to our site</p></div><div><h2>News {i}</h2><p>Story number {i} &eacute;</p></div><div><ul><li><a href=x>one</a><li><a href=y>two {i}</a></ul></div></body>"
    got = texts(pages(spark, [(i, f"http://b.example/{i}", body.format(i=i)) for i in range(8)]))
    assert got == {i: f"News {i}\nStory number {i} é" for i in range(8)}


def test_edges(spark):
    rows = [
        (1, None, None), (2, "http://c.example/", ""), (3, None, "just text"), (4, "http://c.example/x", "<p>a<p>b"), (4, "http://c.example/x", "<p>a<p>b"),
        (None, "nonsense", "<div>" * 300 + "deep" + "</div>" * 300), (5, "http://c.example/y", "</p></div><b>x</i>&lt;y&gt; &#233;<!-- no"), (6, "http://c.example/z", "<article></article>"),
        (7, "http://c.example/w", "<p>" + "long " * 60000 + "</p>"),
    ]
    got = sorted((str(r["page_id"]), r["text"][:9], r["n_chars"]) for r in wrapper.extract(pages(spark, rows)).collect())
    assert got == sorted([("1", "", 0), ("2", "", 0), ("3", "just text", 9), ("4", "a\nb", 3), ("4", "a\nb", 3), ("None", "deep", 4), ("5", "x<y> é", 6), ("6", "", 0), ("7", "long long"[:9], 5 * 60000 - 1)])
    assert wrapper.extract(pages(spark, rows).limit(0)).collect() == []


def test_what_follows_deep_elements(spark):
    deep = "<div class=page><article>" + "<div>" * 200 + "in" + "</div>" * 200 + "<p>rest {i}</p></article></div><nav>menu {i}</nav>"
    inline = "<article>" + "<font>" * 200 + "<p>text {i}</p><nav>menu {i}</nav><aside>side {i}</aside></article>"
    deeper = "<article>" + "<div><b>" * 3000 + "in {i}" + "</b></div>" * 3000 + "<p>rest {i}</p></article>"
    rows = [(10 * k + i, f"http://{k}.example/{i}", x.format(i=i)) for k, x in enumerate((deep, inline, deeper)) for i in range(3)]
    got = texts(pages(spark, rows).repartition(3))
    want = ("in\nrest {i}", "text {i}", "in {i}\nrest {i}")
    assert got == {10 * k + i: x.format(i=i) for k, x in enumerate(want) for i in range(3)}


def test_simple_tree_matching():
    a, b = (wrapper.shape(wrapper.parse(x)) for x in ("<div><p>1</p><ul></ul><table></table></div>", "<div><h1>0</h1><p>1</p><table></table></div>"))
    size, _ = wrapper.matching(a, b)
    assert size == 4  # root, div, p and table
    wrapper.merge(a, b)
    assert wrapper.form(a) == "#root(div(h1,p,ul,table))" or wrapper.form(a) == "#root(div(p,ul,h1,table))" or a[5][0][1] == 2
    assert a[1] == 2 and a[5][0][1] == 2


def truth(source):
    article = re.search(r"<article>(.*?)</article>", source, re.S)[1]
    parts = (" ".join(html.unescape(re.sub(r"<[^>]+>", "", b)).split()) for b in re.split(r"</?(?:p|h1|br)>", article))
    return "\n".join(p for p in parts if p)


@pytest.mark.parametrize("broadcast", [16 << 20, 0])
def test_query(spark, monkeypatch, broadcast):
    monkeypatch.setattr(wrapper, "BROADCAST_BYTES", broadcast)
    given = {r["page_id"]: r["html"] for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    rows = QUERIES["op10_wrapper_text"](spark, SF).collect()
    assert {r["page_id"]: r["text"] for r in rows} == {k: truth(v) for k, v in given.items()}
    assert all(r["n_chars"] == len(r["text"]) for r in rows)
