import duckdb
import pytest

from tablewright import queries, source_queries  # noqa: F401  (registers its queries)
from tablewright.operators import scrape

PAGE = '<!DOCTYPE html><html lang="en"><head><title>{}</title></head><body><nav><ul><li><a href="/a?b=1&amp;c=2">x</a></li></ul></nav></body></html>'
TITLES = ["one &amp; two", "say &quot;no", "cut &amp", "&lt;b&gt; &#39;c&#x27;", "&amp;quot; twice", "a & b && c &", " &copy;"]


@pytest.mark.parametrize("name", ["scrape_head", "scrape_files", "scrape_fields", "scrape_each"])
def test_references_are_read_as_the_sql_reads_them(spark, tmp_path, name):
    rows = [(i, PAGE.format(t)) for i, t in enumerate(TITLES)]
    spark.createDataFrame(rows, "page_id long, html string").write.parquet(f"{tmp_path}/pages.parquet")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet'")
    want = con.sql(queries.SQL[name])
    got = queries.QUERIES[name](spark, str(tmp_path)).select(*want.columns).collect()
    assert sorted(map(tuple, got)) == sorted(want.fetchall())


def test_the_operators_read_all_references(spark):
    df = spark.createDataFrame([(PAGE.format("say &quot;no&quot; &amp"),)], "html string")
    assert scrape.head(df, "html").first().title == 'say "no" &'
    assert scrape.scrape(df, "html", 'a: "a".attr("href")').first().a == "/a?b=1&c=2"
    kept = scrape.parse('<script>if (a && b) "&amp;"</script><p title="&lt;&">&eacute;&</p>', written=True)
    assert kept.inner_html() == '<script>if (a && b) "&amp;"</script><p title="&lt;&">&eacute;&</p>'
