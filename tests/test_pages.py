"""Queries over pages whose text was cut inside a character reference, against their SQL."""

import duckdb
import pytest

import __spark_entry__ as entry
from lorekeep.sources import readers

PAGES = [
    (1, "u", "<html><body><article><h1>cut here &amp;&amp;&amp</h1><p>" + "long &lt;enough&gt; &quot;text&quot; of a paragraph &#39;here&#39; and on" + "</p></article></body></html>"),
    (2, "u", "<article><p>R&D &ampx; &lt &copy 1 & 2 &amp;lt; with words enough for a whole segment of text</p></article>"),
    (3, "u", "<article></article>"),
]


@pytest.mark.parametrize("query", ["q_html_text", "q_page_segments"])
def test_cut_references_as_in_the_sql(spark, tmp_path, query):
    spark.createDataFrame(PAGES, "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet'")
    want = con.sql(entry.oracle_sql()[query])
    got = entry.queries()[query](spark, str(tmp_path)).select(*want.columns).collect()
    assert sorted(map(tuple, got)) == sorted(want.fetchall())


def test_references_without_semicolon():
    html = "<article>a &amp b &amp; c<script>x &amp;&amp y</script></article>"
    assert readers.html_main_text(html) == "a & b & c\n\nx &amp;&amp y"
    assert readers.html_main_text(html, bare=False) == "a &amp b & c\n\nx &&amp y"
