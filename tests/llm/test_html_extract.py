import time

import pytest

from pyspark.sql import functions as F

from logsentinel.llm import html_extract as h
from logsentinel.llm.html_extract import extract, main_text, regions

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{x}</style><script>var t="</p>";</script></head><body>
<header><h1>Site</h1></header><nav><ul><li><a href="/a">Home</a></li></ul></nav><!-- <p>no</p> --><div class="ad">Buy now, this is a long advert text.</div>
<article><header><h1>Head &amp; tail</h1></header><p><b>First</b> part<br>goes   on &eacute;&#233;&nbsp;x.<p>Second <i>one</i>.</p><form><p>mail</p></form><ul><li>one</li><li><a href="x">two</a></li></ul>
<div class="comments"><div>c1</div><p>bad comment</p></div><p>Last</p></article><aside><article><p>teaser</p></article></aside><footer>&copy; foot</footer></body></html>"""


def test_article():
    assert main_text(PAGE) == "Head & tail\n\nFirst part goes on éé x.\n\nSecond one.\n\none\n\ntwo\n\nLast"


def test_without_article():
    body = "".join(f"<p>Paragraph {i} with a good deal of running text that goes on and on.</p>" for i in range(6))
    page = f"<body><div><a href=x>Menu one</a> <a href=y>Menu two</a></div><div id='cookie-notice'>We use cookies a lot, dear reader.</div><div>{body}<p>Short.</p>{body}</div><div class='footer'>bye</div>"
    assert main_text(page).split("\n\n") == ([f"Paragraph {i} with a good deal of running text that goes on and on." for i in range(6)] + ["Short."] + [f"Paragraph {i} with a good deal of running text that goes on and on." for i in range(6)])


def test_long_block_keeps_short_ones():
    """Without a marked article, a very long paragraph takes none of the short ones with it, before or after."""
    for sizes in ([5000, 80, 80, 80, 80, 80], [7, 9, 80, 4, 80, 80, 300_000, 80, 3, 80, 80, 2]):
        body = [chr(97 + i) * n for i, n in enumerate(sizes)]
        page = "<nav><a href=x>menu</a></nav><div>" + "".join(f"<p>{x}</p><div class='ad'>Buy</div>" for x in body) + "<div><a href=y>next page</a></div></div>"
        assert main_text(page).split("\n\n") == body


def test_surge_and_dive_decide():
    """What lies before the surge or behind the dive goes though nothing marks it; what lies between stays."""
    text = ["A paragraph of the article that is long enough to be one.", "Yes.", "Another paragraph of the same article, long too."]
    outside = "<div>Tom's page</div><div>{}</div><div>&copy; Tom</div><div>up</div><div>top</div>"
    body = "".join(f"<p>{x}</p>" for x in text)
    assert main_text(outside.format(f"<article>{body}</article>")).split("\n\n") == text
    slogans = "".join(f"<div>{x}</div>" for x in ("Tom", "home", "a b", "c d"))
    assert main_text(f"{slogans}<hr>{body}{slogans}").split("\n\n") == ["a b", "c d", *text, "Tom", "home"]  # within a window of the text
    two = main_text(f"{body}{slogans}{slogans}{slogans}{body}").split("\n\n")
    assert two == [*text, "Tom", "home", "a b", "c d", *text]  # the lines further off lie between a dive and a surge


def test_regions():
    assert regions([]) == regions([0, 0, 5, 0]) == []
    assert regions([0, 40, 0, 0, 0, 40]) == [(1, 1), (5, 5)] and regions([0, 40, 0, 0, 40, 0]) == [(1, 4)]
    assert regions([1, 1, 1, 40, 2, 2, 2, 2]) == [(1, 5)] and regions([14, 13, 13]) == [(0, 2)]


def test_edges():
    assert main_text(None) == main_text("") == main_text("<p> \n </p>") == ""
    assert main_text("just text") == "just text"
    assert main_text("<nav><a>x</a><article><p>hi</p></article>") == "hi"
    assert main_text("<div class=ad>open <p>and text that must not vanish") == "open\n\nand text that must not vanish"
    assert main_text("<article><p>" + "x" * 300_000 + "</p></article>") == "x" * 300_000
    assert main_text("a < b and <b>c</b> <") == "a < b and c <"
    assert main_text("<p title='a>b'>q</p>") == "q"


def test_rows(spark):
    df = spark.createDataFrame([(1, "u", PAGE), (1, "u", PAGE), (None, None, None)], "page_id long, url string, html string").withColumn("text", F.lit(1))
    got = extract(df).collect()
    assert len(got) == 3 and {r.text for r in got} == {main_text(PAGE), ""}
    assert extract(df.limit(0)).count() == 0


@pytest.mark.parametrize("wrapper", ['div class="has-sidebar"', 'div class="content no-sidebar"', 'div class="top-nav-layout"', 'div class="social-science"', 'section class="related-work"', 'div class="ad-free article"', 'div id="notice-of-intent"', 'form action="x"'])
def test_what_holds_the_article_is_no_boilerplate(wrapper):
    """A name alone doesn't make it one: the wrapper stays, what is beside the article goes."""
    said = "This is a sentence of the article with many words in it. " * 12
    tag = wrapper.split()[0]
    page = f'<html><body><div class="sidebar">Other things to read</div><{wrapper}><h1>The title stands here</h1><p>{said}</p><p>{said}</p></{tag}><div class="ads">Buy this now</div></body></html>'
    got = [line for line, *_ in h.lines(page)]
    assert got == ["The title stands here", said.strip(), said.strip()]


@pytest.mark.parametrize("piece", ["<a ", '<div class="ad">x', '<p "', "<p '", "<!", "<!--", "<script ", "<div class=ad>x</div>", "<nav>", "</div>"])
def test_hostile_pages_in_time(piece):
    """A megabyte of it takes no more than seconds in either parser."""
    from logsentinel.llm import media

    page = piece * (1_000_000 // len(piece))
    began = time.monotonic()
    h.lines(page)
    media.sequence(page)
    assert time.monotonic() - began < 8
