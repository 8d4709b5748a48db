"""Keyed state that expires, against a plain loop."""

import random
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from tidewire.runtime import scratch
from tidewire.streaming import memory

START = datetime(2026, 1, 1)


def plainly(rows):
    until, out = {}, set()
    for key, at, number, life in sorted(rows, key=lambda r: (r[1], r[2])):
        known = key in until and at < until[key]
        if not known:
            until[key] = at + timedelta(seconds=life)
        out.add((key or "", number, known))
    return out


def test_against_a_loop_across_restarts(spark):
    rng = random.Random(1)
    rows = [(rng.choice(["a", "b", "c", None, *map(str, range(30))]), START + timedelta(minutes=rng.randrange(5000)), n, rng.choice([60.0, 3600.0, 86400.0])) for n in range(600)]
    landing, store, checkpoint = (scratch(spark, f"memory-{n}") for n in ("landing", "store", "checkpoint"))
    left = []
    for k in range(4):
        mine = [r for r in rows if k * 1250 <= (r[1] - START) / timedelta(minutes=1) < (k + 1) * 1250]
        df = spark.createDataFrame(mine, "key string, at timestamp, number long, life double")
        df.write.mode("append").parquet(landing)
        found = memory.remember(spark.readStream.schema(df.schema).parquet(landing), F.col("key"), "at", F.col("number"), F.col("life"))
        q = found.writeStream.format("parquet").option("path", store).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
        q.awaitTermination()
        left.append(q.lastProgress["stateOperators"][0]["numRowsTotal"] if q.lastProgress else None)
    got = spark.read.parquet(store).collect()
    assert {(r["key"], r["number"], r["known"]) for r in got} == plainly(rows) and len(got) == len(rows)
    assert 0.1 < sum(r["known"] for r in got) / len(got) < 0.9


def test_expired_keys_leave_the_state(spark):
    landing, checkpoint = scratch(spark, "memory-landing"), scratch(spark, "memory-checkpoint")
    schema = "key string, at timestamp, number long"
    sizes = []
    for day, keys in ((0, 50), (1, 1), (2, 1)):
        spark.createDataFrame([(f"{day}-{k}", START + timedelta(days=day), k) for k in range(keys)], schema).write.mode("append").parquet(landing)
        found = memory.remember(spark.readStream.schema(schema).parquet(landing), F.col("key"), "at", F.col("number"), F.lit(60.0))
        q = found.writeStream.format("noop").option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
        q.awaitTermination()
        sizes.append(q.recentProgress[-1]["stateOperators"][0]["numRowsTotal"])
    assert sizes[0] >= 50 and sizes[-1] < 20


def test_first_seen(spark):
    landing = scratch(spark, "memory-landing")
    schema = "source_id string, url string, raw_text string, fetched_at timestamp, ordinal long"
    at = lambda h: START + timedelta(hours=h)
    spark.createDataFrame([("s", "u", "x", at(0), 1), ("s", "u", "x", at(1), 2), ("s", "u", "y", at(1), 3), ("t", "u", "x", at(1), 4), ("s", "u", "x", at(2), 5), ("s", "u", "x", None, 6)], schema).write.parquet(landing)
    store = scratch(spark, "memory-store")
    found = memory.first_seen(spark.readStream.schema(schema).parquet(landing), 2)
    found.writeStream.format("parquet").option("path", store).option("checkpointLocation", scratch(spark, "memory-checkpoint")).trigger(availableNow=True).start().awaitTermination()
    assert sorted(r["number"] for r in spark.read.parquet(store).collect()) == [1, 3, 4, 5]
