from datetime import datetime

import pytest
from pyspark.sql import functions as F

from tidewire.functions import dates, text, urls
from tidewire.operators import extract
from tidewire.sources import feeds


def one(spark, column, **values):
    kinds = {k: "timestamp" if isinstance(v, datetime) else "string" for k, v in values.items()}
    df = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} {t}" for k, t in kinds.items()))
    return df.select(column.alias("x")).first()["x"]


ANCHOR = datetime(2026, 8, 12, 15, 30)  # a Wednesday


@pytest.mark.parametrize(
    "said, want",
    [
        ("Este viernes a las 21:30 en el centro", datetime(2026, 8, 14, 21, 30)),
        ("El próximo miércoles a las 9", datetime(2026, 8, 19, 9)),
        ("este miércoles", datetime(2026, 8, 12)),
        ("El 5 de septiembre de 2027 a las 20", datetime(2027, 9, 5, 20)),
        ("el 3 de marzo", datetime(2027, 3, 3)),
        ("Inscripción hasta el 20 de agosto", None),
        ("31 de febrero de 2027", datetime(2027, 2, 1)),
        ("en octubre", datetime(2026, 10, 1)),
        ("a las 25:75, el 1 de diciembre", datetime(2026, 12, 1)),
        ("nada", None),
    ],
)
def test_start(spark, said, want):
    assert one(spark, dates.start_of(dates.plain(F.col("t")), F.col("a")), t=said, a=ANCHOR) == want


@pytest.mark.parametrize(
    "said, want",
    [
        ("Del 3 al 9 de octubre de 2026", (datetime(2026, 10, 3), datetime(2026, 10, 9, 23, 59, 59))),
        ("entre el 12 y el 15, en noviembre 2026", (datetime(2026, 11, 12), datetime(2026, 11, 15, 23, 59, 59))),
        ("del 9 al 3 de octubre de 2026", None),
        ("del 3 al 9 de octubre", None),
        ("del 3 al 9, julio o agosto de 2026", None),
        ("Desde el 1 hasta 2 de enero, 2026", (datetime(2027, 1, 1), datetime(2027, 1, 2, 23, 59, 59))),
    ],
)
def test_range(spark, said, want):
    got = one(spark, dates.range_of(dates.plain(F.col("t")), F.col("a")), t=said, a=ANCHOR)
    assert (got and (got["start"], got["end"])) == want


@pytest.mark.parametrize("given, want", [("Tue, 02 Jan 2024 03:04:05 -0300", datetime(2024, 1, 2, 6, 4, 5)), ("2 Jan 2024 03:04:05 GMT", datetime(2024, 1, 2, 3, 4, 5)), ("02 Jan 2024 03:04:05", datetime(2024, 1, 2, 3, 4, 5)), ("soon", None)])
def test_rfc822(spark, given, want):
    assert one(spark, dates.parse_rfc822(F.col("t")), t=given) == want


@pytest.mark.parametrize("given, want", [("2024-05-06T07:08:09Z", datetime(2024, 5, 6, 7, 8, 9)), ("2024-05-06T07:08:09-03:00", datetime(2024, 5, 6, 10, 8, 9)), ("2024-05-06", datetime(2024, 5, 6)), ("x", None)])
def test_iso(spark, given, want):
    assert one(spark, dates.parse_iso(F.col("t")), t=given) == want


@pytest.mark.parametrize(
    "given, want",
    [
        (" HTTPS://User@Example.com:443/Path/?b=2&utm_source=x&a=1#top ", "https://example.com/Path?a=1&b=2"),
        ("http://e.com:8080", "http://e.com:8080/"),
        ("http://e.com/a;p?q=%C3%B1+x&q=", "http://e.com/a?q=&q=%C3%B1+x"),
        ("ftp://e.com", None),
        ("http://e.com:99999/", None),
        ("http:///x", None),
        ("", None),
        ("http://e.com/?FBCLID=1", "http://e.com/"),
    ],
)
def test_normalize_source_url(spark, given, want):
    assert one(spark, urls.normalize_source_url(F.col("u")), u=given) == want


@pytest.mark.parametrize("href, want", [("/a", "https://e.com/a"), ("b?x", "https://e.com/d/b?x"), ("../c", "https://e.com/c"), ("//f.com/x", "https://f.com/x"), ("http://g.com", "http://g.com"), ("#t", "https://e.com/d/p.html#t")])
def test_resolve(spark, href, want):
    assert one(spark, urls.resolve(F.col("b"), F.col("h")), b="https://e.com/d/p.html", h=href) == want


def test_texts(spark):
    assert one(spark, text.normalize_location(F.col("t")), t="Av. Bolívar & Sta. Ana/Gral_Paz (Mnes.)") == "avenida bolivar y santa ana general paz misiones"
    assert one(spark, text.match_text(F.col("t")), t="¡Feria  de la Ñ! Straße") == "feria de la ñ strasse"
    assert one(spark, text.slug(F.col("t")), t="  Ñandú: ¡Fiesta! 2 ") == "nandu-fiesta-2"
    assert one(spark, text.slug(F.col("t")), t="日本") == "evento"
    assert one(spark, text.strip_html(F.col("t")), t="<p>a&amp;b</p>\n <b>c</b>") == "a&amp;b c"
    assert one(spark, text.first_line(F.col("t")), t="\n  \n Uno \nDos") == "Uno"
    assert one(spark, text.first_line(F.col("t")), t=" ") is None
    assert one(spark, text.infer_venue(F.col("t")), t="La obra se presentará en el Teatro, a las 8") == "Teatro"
    assert one(spark, text.infer_address(F.col("t")), t="Dirección: Colón 123,\notra") == "Colón 123"
    assert one(spark, text.strip_fence(F.col("t")), t='```json\n{"a": 1}\n```') == '{"a": 1}'


def test_clocks_keep_the_zone_of_the_post(spark):
    """22:30 on the 31st at -03:00 is the next day, and month, in UTC; the post's own day counts."""
    feed = "<rss><channel><item><title>Recital</title><link>l</link><pubDate>{}</pubDate><description>{}</description></item></channel></rss>"
    said = [
        ("west", "Fri, 31 Jul 2026 22:30:00 -0300", "este viernes a las 21:30", datetime(2026, 8, 1, 0, 30)),
        ("utc", "Sat, 01 Aug 2026 01:30:00 +0000", "este viernes a las 21:30", datetime(2026, 8, 7, 21, 30)),
        ("named", "Sat, 01 Aug 2026 01:30:00 GMT", "este viernes a las 21:30", datetime(2026, 8, 7, 21, 30)),
        ("east", "Sat, 01 Aug 2026 01:30:00 +0530", "el 1 de agosto a las 2:00", datetime(2026, 7, 31, 20, 30)),
        ("range", "Fri, 31 Jul 2026 22:30:00 -0300", "del 3 al 9 de agosto de 2026", datetime(2026, 8, 3, 3, 0)),
    ]
    docs = spark.createDataFrame([(k, feed.format(p, d)) for k, p, d, _ in said], "source_id string, xml string")
    posts = feeds.parse_feeds(docs, F.lit("2026-08-02").cast("timestamp"))
    blank = [F.lit(None).cast("timestamp").alias(c) for c in ("start_at", "end_at")] + [F.lit(None).cast("string").alias(c) for c in ("venue_name", "address", "title")]
    got = extract.enrich(posts.drop("error", "metadata").select("*", *blank, F.lit(False).alias("is_event"))).collect()
    assert {r["source_id"]: r["start_at"] for r in got} == {k: t for k, _, _, t in said}
    assert {r["source_id"]: r["end_at"] for r in got}["range"] == datetime(2026, 8, 10, 2, 59, 59)
    stamps = ["2026-05-06T07:08:09-03:00", "2026-05-06T07:08:09+0530", "2026-05-06T07:08:09Z", "2026-05-06", "2026-05-06T07:08", None, "x", "2026-05-06T07:08:09+99:00"]
    df = spark.createDataFrame([(x,) for x in stamps], "t string").select(dates.offset_iso(F.col("t")).alias("o"))
    assert [r["o"] for r in df.collect()] == [-180, 330, None, None, None, None, None, None]
