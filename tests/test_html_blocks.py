"""Blocks of pages: hand-made pages, broken ones, and the blocks' places in the text."""

import pytest
from pyspark.sql import functions as F

from tessera.operators import chunkers
from tessera.operators.html_blocks import html_blocks, html_texts, page_blocks

CASES = {
    "<h2>A &amp; b<br>c</h2>x <b>y</b>\n z<p>q": [("heading", "A & b c", "## A & b c"), ("text", None, "x y z"), ("text", None, "q")],
    "<p>a<br><br> b <br></p><hr/>c": [("text", None, "a\nb"), ("text", None, "c")],
    "<ul><li>one<li><p>two</p><ol start=3><li>x<li>y</ol></ul>z": [("text", None, "- one"), ("text", None, "- two"), ("text", None, "  3. x"), ("text", None, "  4. y"), ("text", None, "z")],
    "<table><caption>C</caption><tr><th>a|b<th colspan=2>c<tr><td rowspan=2>1<td>2<td>3<tr><td>4</table>": [("table", "C", "| a\\|b | c |  |\n| --- | --- | --- |\n| 1 | 2 | 3 |\n|  | 4 |")],
    "<table><tr><td>o<table><tr><td>i<td>j</table>p</td></tr></table>": [("table", None, "| o i j p |\n| --- |")],
    "<table><tr><td>open": [("table", None, "| open |\n| --- |")],
    "<table><tr><td> </td></tr></table><p>after": [("text", None, "after")],
    "a<img src='x y.png' alt=' The\n[pic] '>b<img alt='no source'>": [("text", None, "a"), ("image", "The (pic)", "![The (pic)](x%20y.png)"), ("text", None, "b")],
    "<pre>\n  a\n\n\n  b  </pre>c": [("text", None, "```\n  a\n  b\n```"), ("text", None, "c")],
    "<title>t</title><script>var a='<p>x</p>'</script><style>p{}</style><!-- <p>no --><p>yes": [("text", None, "yes")],
    "</p></li></table></ul>text</div>": [("text", None, "text")],
    "<h1></h1><li></li><p>&nbsp;</p>1 &lt; 2 &copy x": [("text", None, "1 < 2 © x")],
    "": [],
    " \n ": [],
}


@pytest.mark.parametrize("html", CASES)
def test_blocks_of_a_page(html):
    assert [b[:3] for b in page_blocks(html)] == CASES[html]


def test_blocks_lie_at_their_places_and_have_no_blank_lines(spark):
    pages = spark.createDataFrame([(k, h, "mine") for k, h in enumerate([*CASES, None, "<p>" + "w " * 300_000 + "</p><h1>end</h1>"])], "page_id long, html string, kind string")
    blocks = html_blocks(pages).join(html_texts(pages).select("page_id", F.col("text").alias("whole")), "page_id")
    wrong = blocks.where((F.substring("whole", (F.col("char_start") + 1).cast("int"), (F.col("char_end") - F.col("char_start")).cast("int")) != F.col("text")) | F.contains("text", F.lit("\n\n")))
    assert wrong.count() == 0 and blocks.count() == sum(map(len, CASES.values())) + 2
    assert blocks.where("char_end > 599990 AND kind = 'heading'").count() == 1
    assert html_blocks(pages.limit(0)).columns == ["page_id", "element_index", "kind", "caption", "text", "char_start", "char_end"]
    assert html_blocks(pages.limit(0)).count() == 0


def test_chunks_know_the_tables_they_touch(spark):
    pages = spark.createDataFrame([(1, "<h1>T</h1><p>" + "long words. " * 40 + "</p><table><tr><td>cell</table>")], "doc_id long, html string")
    refs = chunkers.element_refs(html_blocks(pages), chunkers.chunk_documents(html_texts(pages), 200)).collect()
    assert {r.content_kinds for r in refs} >= {"heading"} and any("table" in r.content_kinds for r in refs)


def test_hostile_pages_end(spark):
    for html in ("<table>" * 20_000 + "x", "<ul><li>" * 20_000 + "x", "<tr><td colspan=99999 rowspan=99999>" * 50, "<table>" + "<tr><td colspan=99999 rowspan=99999>a" * 50, "<" * 50_000, "&" * 50_000):
        assert sum(1 for _ in page_blocks(html)) <= 2
