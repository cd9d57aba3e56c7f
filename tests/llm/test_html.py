import pytest

from roleweave.llm import html

LONG = "This paragraph has enough words in it to count as a part of the text of the page."


@pytest.mark.parametrize(
    "page,text",
    [
        ("", ""), ("plain  text\nonly", "plain text only"), ("a &lt; b &amp; c", "a < b & c"), ("<p>", ""),
        (f"<article><h1>Head</h1><p><b>{LONG}<br><p>Short.</article><footer>x</footer>", f"Head\n{LONG}\nShort."),
        (f"<nav><a href=x>Menu</a></nav><div class='ad'>Buy</div><article><p>{LONG}</p></article><div class=\"comments\"><p>{LONG}</p></div>", LONG),
        (f"<header>Site</header><main><h1>T</h1><p>{LONG}</p><p>B&nbsp;c\n d</p></main><aside>Side</aside>", f"T\n{LONG}\nB c d"),
        (f"<script>var t='</p>';</script><style>p{{}}</style><article><p>{LONG}</p><form><input>Mail</form></article>", LONG),
        (f"<div class=ad>Buy now<article><p>{LONG}</p></article>", LONG),
        (f"<article><ul><li>one<li>two</ul><table><tr><td>x<td>y</table><p>{LONG}</article>", f"one\ntwo\nx\ny\n{LONG}"),
        (f"<div id='cookieNotice'>Cookies</div><div class='post'><p>{LONG}</p></div><div class='shareButtons'>Share</div>", LONG),
        (f"<body><p>{LONG}</p><p>{LONG}</p></body>", f"{LONG}\n{LONG}"),
        (f"<article>{LONG}<!-- no --><noscript>x</noscript></article", LONG), (f"<article><p>{LONG}<p hidden>x</p></article>", LONG),
        (f"<article><p>a<i>b</i>c {LONG}</p></article></div></p>", f"abc {LONG}"),
    ],
)
def test_pages(page, text):
    assert html.main_text(page) == text


def test_smoothing_and_threshold():
    import numpy as np

    flat = html.smoothed(np.full(9, 3.0))
    assert np.allclose(flat, 3.0) and len(html.smoothed(np.array([1.0, 2.0]))) == 2
    assert 10 < html.threshold(np.array([1.0, 2, 3, 90, 95, 100])) < 90
    assert html.threshold(np.array([5.0, 5.0])) == 5.0


def test_table(spark):
    rows = [(1, "u", f"<article><p>{LONG}</p></article>", "t"), (1, "u", f"<article><p>{LONG}</p></article>", "t"), (2, None, None, "t"), (None, "u", "", "t"), (3, "u", "<p>" + "word " * 20000 + "</p>", "t")]
    got = html.extract(spark.createDataFrame(rows, "page_id long, url string, html string, text string")).collect()
    by = [(r.page_id, r.url, r.text) for r in got]
    assert by.count((1, "u", LONG)) == 2 and (2, None, "") in by and (None, "u", "") in by and (3, "u", ("word " * 20000).strip()) in by
    assert html.extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_test_pages_against_their_article(spark):
    import html as std
    import re

    for r in spark.read.parquet("/root/testdata/sf0.001/pages.parquet").collect():
        inside = re.search(r"<article>(.*)</article>", r.html, re.S)[1]
        blocks = [" ".join(std.unescape(re.sub("<[^>]+>", "", b)).split()) for b in re.split(r"</?(?:h1|p)>", inside)]
        assert html.main_text(r.html) == "\n".join(b for b in blocks if b)
