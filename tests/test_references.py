"""Character references without their semicolon: plain text where the SQL has it so, as HTML reads them elsewhere."""

import duckdb

from tessera import catalog, catalog_io  # noqa: F401 - the second registers its queries
from tessera.sources import readers

PAGES = [
    (1, "u", "<html><title>x</title><article><h1>a &amp;&amp b &lt c&amp</h1><p>one &amp;lt; two &gt three &quot;q&quot;&copy;</p></article></html>"),
    (2, "u", "<html><article><h1>plain &lt;b&gt; &</h1><p>&nothing; &notit; &amp</p></article></html>"),
]


def test_titles_and_texts_equal_their_sql(spark, tmp_path):
    spark.createDataFrame(PAGES, "page_id long, url string, html string").coalesce(1).write.parquet(str(tmp_path / "pages.parquet"))
    db = duckdb.connect()
    db.execute(f"CREATE VIEW pages AS SELECT * FROM read_parquet('{tmp_path}/pages.parquet/*.parquet')")
    for name in ("html_titles", "page_texts"):
        got = sorted(map(tuple, catalog.QUERIES[name](spark, str(tmp_path)).collect()))
        assert got == sorted(db.execute(catalog.ORACLE_SQL[name]).fetchall())


def test_references_may_be_closed():
    assert readers.html_text("a &amp b &#65; &copy") == "a & b A ©"
    text = readers.closed_references("a &amp b &amp; &#65; &#x42; &copy &copy; &notit; & &#65")
    assert readers.html_text(text) == "a &amp b & A B &copy © &notit; & &#65"
