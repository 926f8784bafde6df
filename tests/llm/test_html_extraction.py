"""Main-text extraction: pages of known text, and the provided pages against a plain version."""

import html
import pathlib
import random
import re

import pytest
from pyspark.sql import functions as F

from sievestone.llm import html_extraction as he

P1 = "The first paragraph of the article tells at some length what happened on that day in the town."
P2 = "A second one follows, and it is about as long as the first, with no link in it at all, only words."
PAGE = "<html><head><title>T</title></head><body><nav><a href=/>Home</a><a href=/b>News</a></nav>{}<footer>&copy; us</footer></body></html>"

CASES = {
    "null": (None, ""),
    "empty": ("", ""),
    "markup only": ("<html><body><div></div></body></html>", ""),
    "text only": (P1, P1),
    "article": (PAGE.format(f"<article><h1>Title</h1><p>{P1}</p><p>{P2}</p></article>"), f"Title\n{P1}\n{P2}"),
    "no article": (PAGE.format(f"<div id=x><h1>Title</h1><p>{P1}</p><p>{P2}</p></div>"), f"Title\n{P1}\n{P2}"),
    "references": (f"<article><p>{P1} a &amp; b &lt;c&gt; &#233;&nbsp;&eacute;</p></article>", f"{P1} a & b <c> é é"),
    "white space": (f"<article><p>  {P1.replace(' ', chr(10) + chr(9))} </p></article>", P1),
    "script and style": (PAGE.format(f"<article><p>{P1}</p><script>var a = '<p>no</p>';</script><style>p {{}}</style><p>{P2}</p></article>"), f"{P1}\n{P2}"),
    "comment": (PAGE.format(f"<article><!-- <p>no</p> --><p>{P1}</p></article>"), P1),
    "furniture words in content": (PAGE.format(f'<div class="content search-results-body"><p>{P1}</p><p>{P2}</p></div>'), f"{P1}\n{P2}"),
    "form of words": (PAGE.format(f'<div class="form-of-words widget-area"><p>{P1}</p><p>{P2}</p></div>'), f"{P1}\n{P2}"),
    "furniture": (PAGE.format(f'<div class="sidebar-left"><p>{P2}</p></div><article><p>{P1}</p><div class="share"><p>Share this</p></div><div id="comments"><p>{P2}</p></div></article>'), P1),
    "short article, then more": (PAGE.format(f"<article><h1>Title</h1><p>In short.</p></article><p>{P1}</p><p>{P2}</p>"), f"Title\nIn short.\n{P1}\n{P2}"),
    "two articles": (PAGE.format(f"<article><p>{P1}</p></article><article><p>{P2}</p></article>"), f"{P1}\n{P2}"),
    "header in article": (PAGE.format(f"<article><header><h1>Title</h1><p>By Ann</p></header><p>{P1}</p></article>"), f"Title\n{P1}"),
    "header of page": (PAGE.format(f"<header><h1>Site</h1><p>{P2}</p></header><article><p>{P1}</p></article>"), P1),
    "unclosed": (f"<body><article><p>{P1}<p>{P2}<b>", f"{P1}\n{P2}"),
    "cut in a tag": (f"<article><p>{P1}</p><p cla", P1),
    "list and table": (PAGE.format(f"<article><p>{P1}</p><ul><li>one</li><li>two</li></ul><table><tr><td>a</td><td>b</td></tr></table></article>"), f"{P1}\none\ntwo\na b"),
    "notice and form": (PAGE.format(f'<div class="notice"><p>{P2}</p></div><article><p>{P1}</p><form><p>Your name</p></form></article>'), P1),
}


@pytest.mark.parametrize("name", CASES)
def test_pages_of_known_text(name):
    page, want = CASES[name]
    assert he.extract(page) == want


def test_long_page_is_whole():
    rng = random.Random(1)
    parts = [" ".join(f"w{rng.randrange(10**4)}" for _ in range(60)) for _ in range(4000)]
    page = "<html><body><nav>" + "<a href=/>x</a>" * 500 + "</nav><article>" + "".join(f"<p>{x}</p>" for x in parts) + "</article></body></html>"
    assert he.extract(page) == "\n".join(parts)


def plain(page):
    """The article of a provided page: furniture, scripts and tags cut out by patterns."""
    body = re.search(r"(?s)<article>(.*?)</article>", page or "")
    if not body:
        return ""
    blocks = re.split(r"</?(?:p|h1|h2|h3|ul|ol|li|div|blockquote)\b[^>]*>", re.sub(r"(?s)<!--.*?-->|<(script|style)\b.*?</\1>", "", body[1]))
    texts = [" ".join(html.unescape(re.sub(r"<[^>]*>", "", re.sub(r"<br\s*/?>", " ", x))).split()) for x in blocks]
    return "\n".join(x for x in texts if x)


def test_provided_pages_against_plain(spark):
    path = pathlib.Path("/root/testdata/sf0.01/pages.parquet")
    if not path.exists():
        pytest.skip("needs the provided pages")
    pages = spark.read.parquet(str(path))
    got = {r.page_id: r for r in he.extract_pages(pages).collect()}
    for r in pages.collect():
        assert got[r.page_id].text == plain(r.html) and got[r.page_id].n_chars == len(plain(r.html)), r.page_id


def test_smoothing_is_a_weighted_mean():
    x = he.smooth(he.np.array([0.0, 0.0, 9.0, 0.0, 0.0]))
    assert abs(x[2] - 9 / (1 + 2 * 2.718281828**-0.5 + 2 * 2.718281828**-2)) < 1e-6 and x[1] == x[3] > x[0]


def test_odd_tables(spark):
    rows = [(i, page) for i, (page, _) in enumerate(CASES.values())]
    pages = spark.createDataFrame(rows + rows[:3], "page_id long, html string").withColumn("text", F.lit(3)).withColumn("html_in", F.lit("mine")).withColumn("n_chars", F.lit(True))
    out = he.extract_pages(pages)
    assert out.columns == ["page_id", "html_in", "text", "n_chars"] and out.filter("html_in = 'mine'").count() == len(rows) + 3
    for r in out.collect():
        assert r.text == list(CASES.values())[r.page_id][1] and r.n_chars == len(r.text)
    assert he.extract_pages(pages.limit(0)).count() == 0
