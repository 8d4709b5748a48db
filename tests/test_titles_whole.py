"""Titles with references other than &amp;, whole or cut short: the same rows as the SQL."""

import duckdb
import pytest

from tidewire.plans import all_queries, registry  # noqa: F401
from tidewire.sources.landed import parse_page

TITLES = ["a &amp; b", "the&amp;&amp;&amp", "token = &quot;73ab&quot;", "x &lt; y &#39;z&#39;", "cut &am", "plain", "&amp;quot; twice"]


@pytest.mark.parametrize("name", ["page_functions", "landed_pages", "landed_stream"])
def test_titles_as_they_are_written(spark, tmp_path, name):
    rows = [(k, f"https://e.com/{k}", f"<html><head><title>{t}</title></head><a href='/x?a=1&b=2'>x &amp; y</a><a href='/y'>y</a></html>".replace("href='", 'href="').replace("'>", '">')) for k, t in enumerate(TITLES)]
    rows.append((len(rows), "https://e.com/none", "<html><p>no title</p></html>"))
    spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    got = registry.QUERIES[name](spark, str(tmp_path))
    c = duckdb.connect()
    c.execute(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet'")
    done = c.execute(registry.ORACLE_SQL[name])
    names = [d[0] for d in done.description]
    assert sorted(map(repr, map(tuple, got.select(*names).collect()))) == sorted(map(repr, done.fetchall()))


def test_the_parser_still_decodes(spark):
    assert parse_page("<title> a &quot;b&quot; &eacute; &amp </title><a href='/?a&b'>") == [{"title": 'a "b" é &', "title_written": "a &quot;b&quot; &eacute; &amp", "links": 1}]
    assert parse_page("") == [{"title": None, "title_written": None, "links": 0}]
