import json

from pyspark.sql import functions as F

from tidewire.operators import collect, extract
from tidewire.sources import catalogs, feeds, fetch, providers


def test_feed_items(spark):
    xml = """<rss><channel><item><title>T</title><link>https://e.com/1</link><description>&lt;b&gt;x&lt;/b&gt; y</description></item><item><title>no link</title></item></channel></rss>"""
    df = spark.createDataFrame([("a", xml), ("b", "<rss"), ("c", None)], "source_id string, xml string")
    rows = {r["source_id"]: r for r in feeds.parse_feeds(df, F.lit("2026-01-01").cast("timestamp")).collect()}
    assert rows["a"]["raw_text"] == "T\nx y" and rows["a"]["error"] is None
    assert rows["b"]["error"] and rows["c"]["error"]


def test_nested_cards(spark):
    html = '<div class="post"><div><h2>A</h2></div><p>b</p><a href="x">l</a></div><div class="event"><h3>B</h3></div><article class="card"><h1>C</h1><a href="/c">c</a></article>'
    df = spark.createDataFrame([("s", "https://e.com/l/", html), ("t", "https://e.com/", None)], "source_id string, page_url string, html string")
    got = sorted((r["url"], r["raw_text"]) for r in feeds.parse_pages(df, F.lit("2026-01-01").cast("timestamp")).collect())
    assert got == [("https://e.com/c", "C"), ("https://e.com/l/x", "A\nb")]


def test_fetch_outcomes():
    R = fetch.Response
    go = lambda url, *answers: fetch.fetch(url, lambda u, it=iter(answers): next(it))
    assert go("ftp://x").status == "invalid_url"
    assert go("http://127.0.0.1/").status == "blocked"
    assert go("http://e.com", R(302, "u", location="http://10.0.0.1/")).error == "unsafe_redirect"
    assert go("http://e.com", R(302, "u")).error == "redirect_without_location"
    assert go("http://e.com", *[R(301, "u", location="/n")] * 4).status == "too_many_redirects"
    assert go("http://e.com", R(404, "u")).error == "http_404"
    assert go("http://e.com", R(200, "u", body=b"x" * 2_000_001)).status == "too_large"
    assert go("http://e.com", R(301, "u", location="/n"), R(200, "v", body=b"y")).ok

    def slow(url):
        raise TimeoutError

    assert fetch.fetch("http://e.com", slow).status == "timeout"


def test_catalog_files(spark, tmp_path):
    places = tmp_path / "places.json"
    places.write_text(json.dumps([{"name": "Posadas", "normalized_name": "posadas", "aliases": ["Posadas, Mnes."], "latitude": -27.3, "longitude": -55.8}, 5]))
    rows = catalogs.read_places(spark, str(places)).collect()
    assert len(rows) == 1 and rows[0]["country_code"] == "ar" and rows[0]["allowed"]
    names = [r["matched_key"] for r in catalogs.place_names(catalogs.read_places(spark, str(places))).orderBy("name_ordinal").collect()]
    assert names == ["posadas", "posadas misiones"]
    bad = tmp_path / "bad.json"
    bad.write_text('{"a": 1}')
    try:
        catalogs.read_sources(spark, str(bad)).collect()
        raise AssertionError("an object is no catalog")
    except Exception as e:
        assert "list" in str(e)


def test_provider_round_trip(spark):
    df = spark.createDataFrame([("q", '{"candidates": [{"latitude": 1.5, "longitude": 2.5, "score": 0.5}, {"latitude": 3.5, "longitude": 4.5}]}')], "query string, payload string")
    c = providers.any_answer(df)
    again = providers.any_answer(providers.as_answer(c))
    assert [tuple(r) for r in c.select("latitude", "longitude", "confidence").collect()] == [tuple(r) for r in again.select("latitude", "longitude", "confidence").collect()]
    assert providers.enabled(("geoapify", "nominatim"), {}) == ["nominatim"]
    assert "countrycodes=ar" in providers.request_url("nominatim", "Posadas")


def test_failing_extractor_is_isolated(spark):
    posts = spark.createDataFrame([("s", "u1", "good"), ("s", "u2", "bad")], "source_id string, url string, raw_text string").withColumn("fetched_at", F.lit("2026-01-01").cast("timestamp")).withColumn("published_at", F.lit(None).cast("timestamp"))

    def model(text, date):
        if text == "bad":
            raise ValueError("no")
        return '{"events": [{"is_event": true, "confidence": 0.9, "title": "Feria"}]}'

    asked = extract.ask(posts, model).collect()
    assert {r["raw_text"]: (r["answer"] is not None, r["answer_error"]) for r in asked} == {"good": (True, None), "bad": (False, "ValueError: no")}


def test_missing_key_is_not_null(spark):
    answer = '{"events": [{"is_event": true, "confidence": 0.9, "title": null}, {"is_event": true, "confidence": 0.9}]}'
    posts = spark.createDataFrame([("s", "u", "First\nrest", answer)], "source_id string, url string, raw_text string, answer string").withColumn("fetched_at", F.lit("2026-01-01").cast("timestamp")).withColumn("published_at", F.lit(None).cast("timestamp"))
    rows = extract.candidates(posts).orderBy("event_ordinal").collect()
    assert [r["title"] for r in rows] == [None, "First"]
    assert rows[0]["source_url"] == "u" and rows[0]["description"] == "First\nrest"


def test_first_in_batch_and_unseen(spark):
    posts = spark.createDataFrame([("s", "h1", 2), ("s", "h1", 1), ("s", "h2", 3), ("s", None, 4)], "source_id string, content_hash string, n int")
    stored = spark.createDataFrame([("s", "h2")], "source_id string, content_hash string")
    assert sorted(r["n"] for r in collect.collect_new(posts, stored, [F.col("n")]).collect()) == [1, 4]
