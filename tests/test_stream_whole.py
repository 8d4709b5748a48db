"""The stream stores every post that lands."""

from tidewire.streaming import cycle


def test_no_post_is_left_out(spark):
    rows = [("s", f"u{k}", f"text {k}", k) for k in range(24)] + [("s", "u", "no ordinal", None)]
    posts = spark.createDataFrame(rows, "source_id string, url string, raw_text string, ordinal long")
    got = sorted(r["url"] for r in cycle.ingest_twice(spark, posts).collect())
    assert got == sorted(r[1] for r in rows)
