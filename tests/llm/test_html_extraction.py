"""Main text of pages: whole pages of several makes, the rules, broken markup and odd tables."""

import html
import re
import time

import pytest

from tidewright.llm import registry
from tidewright.llm.html_extraction import blocks, extract, label, main_text, STOP_WORDS

LONG = "It was the best of times and it was the worst of times, so that all of us were in the dark for a while."
OTHER = "He said that this is what they had in mind for the rest of the year and for all that comes with it."


def test_named_places_and_scripts_are_left_out():
    page = f"""<html><head><title>T</title><style>p{{}}</style></head><body><header><a href=/>Home</a> The daily of the town and of the people in it, as it was and as it is.</header>
<nav><ul><li><a href=/a>A</a></ul></nav><div class="cookie-notice">{OTHER}</div><main><article><header><h1>The title</h1><p>By Ann</p></header><p>{LONG}</p>
<div class="ad-slot">{OTHER}</div><script>if (a < b) document.write("</p><p>{OTHER}");</script><p>Short one.</p><form><label>{OTHER}</label></form></article>
<section id="readerComments"><article class="comment"><p>{OTHER}</p></article></section></main><aside>{OTHER}</aside><footer>{OTHER}</footer></body></html>"""
    assert main_text(page) == f"The title\n{LONG}\nShort one."


def test_page_without_an_article_is_told_by_its_blocks():
    links = "".join(f"<a href=/{i}>one of the links {i}</a> " for i in range(9))
    junk = "qwx zrt " * 20
    page = f"<div>{links}</div><div>Log in</div><div><h2>A heading</h2><p>{LONG}</p><p>And so on.</p><p>{OTHER}</p></div><div>x</div><div>{junk}</div><div>imprint</div><div>{links}</div>"
    assert main_text(page) == f"A heading\n{LONG}\nAnd so on.\n{OTHER}\nx"


def test_short_blocks_take_the_nearest_label():
    found = blocks(f"<p>{'zz ' * 40}</p><p>near junk</p><p>mid</p><p>near text</p><p>{LONG}</p>")
    assert label(found, STOP_WORDS) == [False, False, True, True, True]


def test_white_space_and_references():
    assert main_text("<article><p> a\n\t b&nbsp;&#x41;&amp;lt; &am</p><p>c<b>d</b>e<br>f<br><br>g</p>h</article>") == "a b A&lt; &am\ncde f\ng\nh"


def test_broken_markup():
    assert main_text("<ul><li>x<ul><li>y<li>z</ul><li>w</ul><table><tr><td>a<td>b<tr><td>c</table>") == "x\ny\nz\nw\na\nb\nc"
    assert main_text("<p class=ad>no<p>yes <b>b<div>in</div></p>after</i></div> <!-- x > y --> <? z ?> 1 < 2 <b") == "yes b\nin\nafter\n1 < 2 <b"
    assert main_text("<p title='a > b'>x</p><p hidden>y</p><p style='display: none'>z</p><script>var a = 1;") == "x"
    assert main_text('<p title="never ends>x</p>') == "x"


def test_names_that_say_nothing():
    assert main_text(f"<body class='no-sidebar'><div class='has-comments page'><p>{LONG}</p></div></body>") == LONG
    assert main_text(f"<form action=/x><main><p>{LONG}</p></main></form>") == LONG


@pytest.mark.parametrize("part", ["<a ", "<p>", "<b>x", "<div>", "</div ", "<a href=\"", "<b x='", "<ul><li>x", "<p>x<b>", "&amp", "<!-", "x</p>"])
def test_time_grows_with_the_page(part):
    main_text(part * 1_000)
    began = time.perf_counter()
    main_text(part * 40_000)
    assert time.perf_counter() - began < 8


def test_very_long_page_is_read_whole():
    assert main_text("<article>" + f"<p>{LONG}</p>" * 20_000 + "</article>") == "\n".join([LONG] * 20_000)


def test_tables(spark):
    rows = [(1, "u", None, "own"), (1, "u", "", "own"), (2, None, f"<p>{LONG}", "x"), (2, None, f"<p>{LONG}", "x"), (None, "v", "<nav>m</nav>", None)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = sorted(map(tuple, extract(pages).select("page_id", "url", "text").collect()), key=str)
    assert got == sorted([(1, "u", ""), (1, "u", ""), (2, None, LONG), (2, None, LONG), (None, "v", "")], key=str)
    assert extract(pages.limit(0)).collect() == []
    named = spark.createDataFrame([(1, "h", f"<p>{LONG}")], "`a.b` long, html string, `pa ge` string")
    assert extract(named, "pa ge", "out").columns == ["a.b", "html", "out"]


def test_query_returns_the_articles(spark, sf_dir):
    """The pages of the given tables hold one article each: its headings and paragraphs, told by another reading."""
    pages = {r.page_id: r for r in spark.read.parquet(f"{sf_dir}/pages.parquet").collect()}
    got = registry.QUERIES["op11_html_extraction"](spark, sf_dir).collect()
    assert len(got) == len(pages)
    for r in got:
        inside = re.search("<article>(.*?)</article>", pages[r.page_id].html, re.S)[1]
        lines = [" ".join(html.unescape(x.replace("<br>", " ").replace("<b>", "")).split()) for x in re.split("</?(?:h1|p)>", inside)]
        assert r.text == "\n".join(x for x in lines if x)
        assert (r.url, r.n_chars) == (pages[r.page_id].url, len(r.text))
