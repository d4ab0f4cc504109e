import html
import re
import time

import pytest

from millrace.llm import html_extract as op

from .common import SF

ARTICLE = "<p>First long paragraph of the story, with enough words to matter.</p><p>Second one &amp; more&nbsp;text<br>here <a href=x>link</a></p>"
OTHERS = {
    "http://a.example/1": f"<html><body><nav><ul><li>Menu</ul></nav><div class='post-17'><h1>Title</h1>{ARTICLE}<div class='comments'><p>Reader says hi</p></div></div><div class=sidebar>{'<p>side text that is really long</p>' * 9}</div><footer>Foot</footer></body></html>",
    "http://a.example/2": "<body><div class='post-2'><p>Short.</p></div><div class=extra><p>Another container holds much more text than the post itself does, but not by consensus.</p></div>",
    "http://a.example/3": f"<body><div class=post-3>{ARTICLE}</div>",
    "http://a.example/4": f"<body><div class=post-4>{ARTICLE}</div>",
}


def rows(spark, pages):
    return spark.createDataFrame([(i, u, h) for i, (u, h) in enumerate(pages)], "page_id long, url string, html string")


def test_own_pages(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    got = {r.page_id: r for r in op.extract(pages).collect()}
    for r in pages.collect():
        body = re.search(r"<article>(.*)</article>", r.html, re.S)[1].replace("<b>", "").replace("</b>", "").replace("<br>", " ")
        blocks = [" ".join(html.unescape(b).split()) for b in re.split(r"</?(?:h1|p)>", body)]
        assert got[r.page_id].text == "\n".join(b for b in blocks if b)
        assert got[r.page_id].n_chars == len(got[r.page_id].text) and got[r.page_id].url == r.url


def test_consensus_over_pages(spark):
    out = {r.url: r.text for r in op.extract(rows(spark, OTHERS.items())).collect()}
    want = "First long paragraph of the story, with enough words to matter.\nSecond one & more text here link"
    assert out["http://a.example/1"] == "Title\n" + want
    assert out["http://a.example/2"] == "Short."
    assert out["http://a.example/3"] == want
    assert {r.host: r.path for r in op.consensus(rows(spark, OTHERS.items())).collect()} == {"a.example": "/body/div.post-"}


MOST = "<p>" + "The greater part of the story stands in here. " * 9 + "</p>"


@pytest.mark.parametrize("inner", ["section", "div", "table><tr><td", "blockquote"])
@pytest.mark.parametrize("outer", ["article", "main", "div class=post"])
def test_text_beside_an_inner_container_stays(inner, outer):
    page = op.Page(f"<body><ul><li><a href=x>Home</a></ul><{outer}><h1>Title</h1><p>Intro.</p><{inner}>{MOST}</{inner.split('>')[0]}></{outer.split()[0]}><footer>f</footer>")
    most = " ".join(MOST[3:-4].split())
    assert page.text(page.vote()[0]) == f"Title\nIntro.\n{most}"


def test_host_path_keeps_all_of_a_page(spark):
    one = f"<body><article><section>{MOST}</section></article>"
    bare = f"<body><div class=story>{MOST}</div>"
    pages = [(f"http://c.example/{i}", one) for i in range(3)] + [(f"http://d.example/{i}", bare) for i in range(3)]
    pages.append(("http://c.example/x", "<body><article><h1>T</h1><section>one</section><section>two</section><section>three</section></article>"))
    pages.append(("http://d.example/x", "<body><ul><li><a href=x>Home</a></ul><h1><a href=x>T</a></h1><div class=story>one</div><blockquote>q</blockquote><div class=story>two</div><div class=extra>left out by consensus</div>"))
    out = {r.url: r.text for r in op.extract(rows(spark, pages)).collect()}
    assert out["http://c.example/x"] == "T\none\ntwo\nthree"
    assert out["http://d.example/x"] == "T\none\nq\ntwo"


def test_broadcast_and_shuffle_agree(spark):
    pages = rows(spark, OTHERS.items())
    a, b = (sorted(map(tuple, op.extract(pages, broadcast_hosts=n).collect())) for n in (100, 0))
    assert a == b


def test_broken_markup(spark):
    pages = [
        (None, None),
        ("x", ""),
        ("http://b.example", "plain text, no tags &lt;b&gt;"),
        ("http://b.example", "<p>open <b>bold <p>next <!-- never closed"),
        ("http://b.example", "<script>var x = '<p>no</p>'"),
        ("http://b.example", "<p title=it's>quote</p><p>more"),
        ("http://b.example", "<li>one<li>two<table><tr><td>a<td>b</table>" + "<div>" * 3000 + "deep"),
        ("http://b.example", "<p>" + "word " * 100_000),
    ]
    out = [r.text for r in op.extract(rows(spark, pages)).orderBy("page_id").collect()]
    assert out[0] == out[1] == "" and out[2] == "plain text, no tags <b>" and out[3] == "open bold\nnext" and out[4] == ""
    assert out[5] == "quote\nmore" and out[6] == "one\ntwo\na\nb\ndeep" and len(out[7]) == 499_999


def test_boilerplate_elements():
    page = op.Page("<body><article><header>H</header><p>Keep <span class='ad x'>not <i>this</i></span>it</p><div role=navigation>n</div><form>f</form><aside>a</aside><p hidden>h</p><p>End</p></article>")
    assert page.text(page.vote()[0]) == "Keep it\nEnd"


def test_three_sections_of_a_path(spark):
    part = "<section class=part>" + "words of this part " * 20 + "</section>"
    pages = [(f"http://s.example/{i}", f"<body><main>{part}</main>") for i in range(3)] + [("http://s.example/x", f"<body><main>{part * 3}</main><footer>f</footer>")]
    out = {r.url: r.text for r in op.extract(rows(spark, pages)).collect()}
    assert out["http://s.example/x"] == "\n".join([("words of this part " * 20).strip()] * 3)


@pytest.mark.parametrize("kept", ["<p class=share-price>1 EUR</p>", "<div class='notice-period'>two weeks</div>", "<div id=search-theory>found</div>", "<p>sum <math><mi>x</mi><mo>+</mo><mn>1</mn></math> here</p>"])
def test_names_that_only_look_like_boilerplate(kept):
    page = op.Page(f"<body><article><p>Begin</p>{kept}<p>End</p></article>")
    assert page.text(page.vote()[0]).split("\n")[1] == "".join(op.html.unescape(x) for x in op.re.split("<[^>]*>", kept))


@pytest.mark.parametrize("left_out", ["<div class=site-header>x</div>", "<ul class='comment-list'><li>x</ul>", "<div class=ad1>x</div>", "<div id=sidebar-right>x</div>", "<div class='post-comments'>x</div>"])
def test_boilerplate_names_with_places(left_out):
    page = op.Page(f"<body><article><p>Begin</p>{left_out}<p>End</p></article>")
    assert page.text(page.vote()[0]) == "Begin\nEnd"


@pytest.mark.parametrize(
    "hostile",
    ["<div>" * 100_000 + "</p>" * 100_000, "<td><table>" + "<div>" * 50_000 + "<th></th>" * 50_000, "<ul><li>" * 30_000 + "</dd>" * 30_000, "<section class=a>" * 30_000 + "</i>" * 30_000, "<p>" + "<a '" * 100_000],
    ids=["stray", "table", "lists", "paths", "quotes"],
)
def test_hostile_markup_takes_linear_time(hostile):
    began = time.process_time()
    page = op.Page(f"<body><article><p>Begin</p></article>{hostile}")
    page.text(page.vote()[0])
    assert time.process_time() - began < 30


def test_clashing_columns_and_tied_votes(spark):
    pages = [(i, f"http://t.example/{i}", f"<body><div class={'ab'[i % 2]}>text {i}</div>", "x", "y", "z") for i in range(4)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string, id string, path string, host string")
    assert [r.path for r in op.consensus(df).collect()] == ["/body/div.a"]
    out = sorted(map(tuple, op.extract(df).select("page_id", "text", "path").collect()))
    assert out == [(i, f"text {i}", f"/body/div.{'ab'[i % 2]}") for i in range(4)]


def test_empty_table(spark):
    assert op.extract(rows(spark, [])).count() == 0
