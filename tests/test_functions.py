"""Parsers as table functions of SQL."""

import pytest

from tidewire.sources import functions


def test_read_document(spark):
    functions.register(spark)
    feed = "<rss><channel><item><title>a</title><link>l</link><category>x</category></item></channel></rss>"
    spark.createDataFrame([(1, feed), (2, "<rss"), (3, None), (4, "")], "id int, body string").createOrReplaceTempView("tw_bodies")
    got = spark.sql("SELECT b.id, r.* FROM tw_bodies b, LATERAL read_document(b.body, 'feed') r").collect()
    rows = {(r["id"], r["ordinal"], r["title"], r["link"], tuple(r["categories"] or ()), r["error"] is None) for r in got}
    assert rows == {(1, 0, "a", "l", ("x",), True), (2, 0, None, None, (), False), (4, 0, None, None, (), False)}
    cards = spark.sql("SELECT r.* FROM (SELECT '<div class=\"event\"><h2>Obra</h2><a href=\"/e\">x</a></div>' AS h) p, LATERAL read_document(p.h, 'cards') r").collect()
    assert [(r["title"], r["link"]) for r in cards] == [("Obra", "/e")]
    for wrong in ("read_document(b.body, 'book')", "read_document(b.id, 'page')", "read_document(b.body, b.body)"):
        with pytest.raises(Exception, match="must be"):
            spark.sql(f"SELECT r.* FROM tw_bodies b, LATERAL {wrong} r").collect()


def test_read_answer_and_geocoder(spark):
    functions.register(spark)
    said = ["```json\n{\"events\": [{\"is_event\": true, \"confidence\": 1, \"title\": \"t\"}, 5]}\n```", "{\"is_event\": false}", "no", None, "[]", "{\"events\": 3}"]
    df = spark.createDataFrame(list(enumerate(said)), "id int, answer string")
    got = spark.sql("SELECT p.id, r.* FROM {p} p, LATERAL read_answer(p.answer) r", p=df).collect()
    assert sorted((r["id"], r["ordinal"], r["is_event"], r["confidence"], r["title"]) for r in got) == [(0, 0, True, 1.0, "t"), (1, 0, False, 0.0, None)]
    spark.udtf.register("geocode", functions.geocoder(lambda q: [{"display_name": q.upper(), "latitude": 1.0, "longitude": 2.0}] * len(q)))
    rows = spark.sql("SELECT q, g.* FROM VALUES ('ab'), (NULL) t(q), LATERAL geocode(t.q) g").collect()
    assert [(r["q"], r["ordinal"], r["display_name"]) for r in rows] == [("ab", 0, "AB"), ("ab", 1, "AB")]
