"""Queries over web pages. The given pages have no tables, images or lists in lists, so some get them at their end."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import chunkers
from tessera.operators.html_blocks import html_blocks, html_texts
from tessera.plans.registry import query
from tessera.sources.tables import read_table

#: What every third and every fifth page gets, and a page's html with it, in terms that Spark and DuckDB both take.
FACTS = "concat('<h2>Facts &amp; figures</h2><table><caption>Of the page</caption><tr><th>page<th>url</tr><tr><td>', CAST(page_id AS VARCHAR(20)), '<td>', url, '</table>')"
SHOWN = "'<p>before<img src=\"/i.png\" alt=\"A  picture\">after<ul><li>one<br>two<ol start=4><li>deep</ol></ul>'"
PLANTED = f"concat(html, CASE WHEN page_id % 3 = 0 THEN {FACTS} ELSE '' END, CASE WHEN page_id % 5 = 0 THEN {SHOWN} ELSE '' END)"

#: Characters that stand for the end of a block, the end of a line and the begin of a heading.
_BLOCK, _LINE, _HEAD = "chr(30)", "chr(31)", "chr(29)"
_STEPS = (
    ("(?s)<script.*?</script>|<style.*?</style>|<title>.*?</title>|<!--.*?-->", "''"),
    ("<h1>", f"concat({_BLOCK}, {_HEAD}, '# ')"),
    ("<li>", f"concat({_BLOCK}, '- ')"),
    ("</?(p|div|h1|li|ul|nav|article|footer|body|html|head|meta)( [^>]*)?>", _BLOCK),
    ("<br>", _LINE),
    ("</?[a-zA-Z!][^>]*>", "''"),
    ("&copy;", "'©'"), ("&middot;", "'·'"), ("&quot;", "chr(34)"), ("&lt;", "'<'"), ("&gt;", "'>'"), ("&amp;?", "'&'"),
    ("[ \\t\\n\\r\\f]+", "' '"),
)


def _stripped(sql: str) -> str:
    for pattern, by in _STEPS:
        sql = f"regexp_replace({sql}, '{pattern}', {by}, 'g')"
    return sql


_BLOCKS = (
    f"own AS (SELECT page_id, url, [array_to_string([trim(y) FOR y IN string_split(x, {_LINE}) IF trim(y) <> ''], chr(10)) FOR x IN string_split({_stripped('html')}, {_BLOCK})] AS b FROM pages), "
    f"told AS (SELECT page_id, url, [{{'kind': CASE WHEN starts_with(x, {_HEAD}) THEN 'heading' ELSE 'text' END, 'caption': CASE WHEN starts_with(x, {_HEAD}) THEN substr(x, 4, 1000) END, 'text': ltrim(x, {_HEAD})}} FOR x IN b IF trim(ltrim(x, {_HEAD})) NOT IN ('', '#', '-')] AS b FROM own), "
    "more AS (SELECT page_id, list_concat(b, CASE WHEN page_id % 3 = 0 THEN [{'kind': 'heading', 'caption': 'Facts & figures', 'text': '## Facts & figures'}, {'kind': 'table', 'caption': 'Of the page', 'text': concat('| page | url |', chr(10), '| --- | --- |', chr(10), '| ', page_id, ' | ', url, ' |')}] ELSE [] END, "
    "CASE WHEN page_id % 5 = 0 THEN [{'kind': 'text', 'caption': NULL, 'text': 'before'}, {'kind': 'image', 'caption': 'A picture', 'text': '![A picture](/i.png)'}, {'kind': 'text', 'caption': NULL, 'text': 'after'}, {'kind': 'text', 'caption': NULL, 'text': concat('- one', chr(10), 'two')}, {'kind': 'text', 'caption': NULL, 'text': '  4. deep'}] ELSE [] END) AS b FROM told), "
    "flat AS (SELECT page_id, unnest(b) AS e, generate_subscripts(b, 1) - 1 AS element_index FROM more), "
    "blocks AS (SELECT page_id, element_index, e.kind AS kind, e.caption AS caption, e.text AS text, CAST(coalesce(sum(length(e.text) + 2) OVER (PARTITION BY page_id ORDER BY element_index ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS char_start FROM flat) "
)


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "pages").selectExpr("page_id", f"{PLANTED} AS html")


@query(f"WITH {_BLOCKS} SELECT page_id, element_index, kind, caption, sha256(text) AS text_hash, char_start, char_start + length(text) AS char_end FROM blocks")
def page_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every block of every page."""
    return html_blocks(pages(spark, sf_dir)).withColumn("text_hash", F.sha2("text", 256)).drop("text")


_SIZE = 400


@query(
    f"WITH {_BLOCKS}, n AS (SELECT page_id, max(char_start + length(text)) AS n FROM blocks GROUP BY page_id), "
    f"c AS (SELECT page_id, i AS chunk_index, i * {_SIZE} AS c0, least((i + 1) * {_SIZE}, n) AS c1 FROM (SELECT page_id, n, unnest(range(CAST(ceil(n / {_SIZE}) AS BIGINT))) AS i FROM n)), "
    "t AS (SELECT c.page_id, chunk_index, element_index, kind, row_number() OVER (PARTITION BY c.page_id, chunk_index ORDER BY element_index) AS place FROM c JOIN blocks b ON b.page_id = c.page_id AND kind <> 'text' AND char_start < c1 AND char_start + length(text) > c0 QUALIFY place <= 8) "
    "SELECT page_id, chunk_index, string_agg(DISTINCT kind, ',' ORDER BY kind) AS content_kinds, string_agg(CAST(element_index AS VARCHAR), ',' ORDER BY element_index) AS refs FROM t GROUP BY page_id, chunk_index"
)
def page_chunk_refs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Headings, tables and images of the windows that a page's text is cut into."""
    texts = html_texts(pages(spark, sf_dir)).select(F.col("page_id").alias("doc_id"), F.length("text").cast("long").alias("n")).where("n > 0")
    windows = texts.select("doc_id", "n", F.explode(F.expr(f"sequence(0L, (n - 1) div {_SIZE})")).alias("chunk_index"))
    windows = windows.selectExpr("doc_id", "chunk_index", f"chunk_index * {_SIZE} AS char_start", f"least((chunk_index + 1) * {_SIZE}, n) AS char_end")
    blocks = html_blocks(pages(spark, sf_dir)).withColumnRenamed("page_id", "doc_id")
    return chunkers.element_refs(blocks, windows).withColumnRenamed("doc_id", "page_id")
