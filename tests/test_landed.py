"""Landed documents as a source, versions of stored tables, locks."""

import threading

import pytest
from pyspark.sql import functions as F

from tidewire.runtime import scratch
from tidewire.sources import landed
from tidewire.store import Conflict, Lock, Versions

DOC = "name string, source_id string, url string, body string"


def docs(spark, names, more="<a href='/x'>x</a><a>no</a>"):
    return spark.createDataFrame([(str(n), f"s{n % 5}", f"https://e.com/{n}", f"<html><title>T &amp; {n}</title>{more}</html>") for n in names], DOC)


def test_batch_read_and_filters(spark):
    root = scratch(spark, "landed")
    assert landed.batch(spark, root).count() == 0
    assert (landed.land(docs(spark, range(20)), root), landed.land(docs(spark, range(20, 31)), root)) == (0, 1)
    got = landed.batch(spark, root)
    assert {(r["name"], r["title"], r["links"], r["version"]) for r in got.collect()} == {(str(n), f"T & {n}", 1, int(n >= 20)) for n in range(31)}
    one = got.filter(F.col("source_id") == "s3")
    assert {r["name"] for r in one.collect()} == {str(n) for n in range(31) if n % 5 == 3}
    reader = landed.LandedReader({"path": root})
    from pyspark.sql.datasource import EqualTo

    list(reader.pushFilters([EqualTo(("source_id",), "s3")]))
    kept = {f for p in reader.partitions() for f, _ in p.files}
    every = {f for p in landed.LandedReader({"path": root}).partitions() for f, _ in p.files}
    assert kept < every and all(f"bucket={landed.bucket_of('s3', 8)}/" in f for f in kept)


def test_kinds_and_odd_documents(spark):
    root = scratch(spark, "landed")
    feed = "<rss><channel><item><title>a</title><link>l</link></item><item><title>b</title><link>m</link></item></channel></rss>"
    landed.land(spark.createDataFrame([("f", "s", "u", feed), ("bad", None, None, "<rss"), ("none", "s", "u", None)], DOC), root)
    rows = {(r["name"], r["ordinal"], r["title"], r["link"], r["error"] is None) for r in landed.batch(spark, root, "feed").collect()}
    assert rows == {("f", 0, "a", "l", True), ("f", 1, "b", "m", True), ("bad", 0, None, None, False), ("none", 0, None, None, False)}
    assert {(r["name"], r["title"], r["links"]) for r in landed.batch(spark, root).collect()} >= {("none", None, 0)}
    landed.land(spark.createDataFrame([("c", "s", "u", '<div class="event"><h2>Obra</h2><a href="/e">x</a></div>')], DOC), root)
    assert {(r["name"], r["title"], r["link"]) for r in landed.batch(spark, root, "cards").collect()} == {("c", "Obra", "/e")}


def run(spark, root, store, checkpoint):
    q = landed.stream(spark, root).writeStream.format("parquet").option("path", store).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    return sorted(int(r["name"]) for r in spark.read.parquet(store).select("name").collect())


def test_stream_goes_on_from_its_offset(spark):
    root, store, checkpoint = (scratch(spark, f"landed-{n}") for n in ("root", "store", "checkpoint"))
    landed.land(docs(spark, range(7)), root)
    landed.land(docs(spark, range(7, 9)), root)
    assert run(spark, root, store, checkpoint) == list(range(9))
    assert run(spark, root, store, checkpoint) == list(range(9))
    landed.land(docs(spark, range(9, 30)), root)
    assert run(spark, root, store, checkpoint) == list(range(30))
    assert run(spark, root, scratch(spark, "landed-store"), scratch(spark, "landed-checkpoint")) == list(range(30))


def test_versions_and_a_writer_that_breaks_off(spark):
    table = Versions(spark, scratch(spark, "versions"))
    assert table.latest() == -1
    assert table.commit(spark.range(3)) == 0

    @F.udf("long")
    def breaks(x):
        raise RuntimeError("off")

    with pytest.raises(Exception, match="off"):
        table.commit(table.read().select(breaks("id").alias("id")), base=0)
    assert table.latest() == 0 and sorted(r["id"] for r in table.read().collect()) == [0, 1, 2]
    assert table.commit(table.read().filter("id > 0"), base=0) == 1
    with pytest.raises(Conflict):
        table.commit(spark.range(9), base=0)
    assert table.read().count() == 2 and table.read(0).count() == 3
    assert table.vacuum(keep=1) >= 2 and table.read().count() == 2
    empty = Versions(spark, scratch(spark, "versions"))
    empty.commit(spark.range(3).limit(0))
    assert empty.read().count() == 0 and empty.read().columns == ["id"]


def at_once(n, work):
    out, gate = [None] * n, threading.Barrier(n)

    def one(k):
        gate.wait()
        out[k] = work(k)

    threads = [threading.Thread(target=one, args=(k,)) for k in range(n)]
    [t.start() for t in threads]
    [t.join() for t in threads]
    return out


def test_one_of_many_takes_a_lock(spark):
    lock = Lock(spark, scratch(spark, "lock"))
    took = at_once(16, lambda k: lock.take(f"h{k}"))
    assert sum(took) == 1 and lock.holder() == f"h{took.index(True)}"
    assert not lock.release("another") and lock.release(lock.holder()) and lock.take("again")
    took = at_once(16, lambda k: lock.take_over("again", f"n{k}"))
    assert sum(took) == 1 and lock.holder() == f"n{took.index(True)}"
    assert not lock.take_over("again", "late")


def test_one_of_many_writers_makes_a_version(spark):
    table = Versions(spark, scratch(spark, "versions"))

    def work(k):
        try:
            return table.commit(spark.range(k + 1), base=-1)
        except Conflict:
            return None

    made = at_once(6, work)
    assert made.count(0) == 1 and table.read().count() == made.index(0) + 1
    assert sorted(at_once(4, lambda k: table.commit(spark.range(1)))) == [1, 2, 3, 4]
