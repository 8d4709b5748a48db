"""What a stream remembers of a key for a while: caches with positive and negative lives, posts that were seen."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tidewire import streaming
from tidewire.functions import text
from tidewire.runtime import carried, prepare

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
RECALLED = "key string, number long, at_us long, known boolean"


class Remember(StatefulProcessor):
    """Per key the time until which it is known. A row before that is known; any other makes it known for the row's life.

    A timer at that time removes the key once the watermark has passed, so the state holds what is still alive.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.until = handle.getValueState("until", "until_us long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        part = pd.concat(rows).sort_values(["at_us", "number"], kind="stable")
        was = self.until.get()[0] if self.until.exists() else None
        until, known = was, []
        for at, life in zip(part["at_us"].tolist(), part["life_us"].tolist()):
            known.append(until is not None and at < until)
            if not known[-1]:
                until = at + life
        if until != was:
            if was is not None:
                self.handle.deleteTimer(was // 1000)
            self.until.update((until,))
            self.handle.registerTimer(until // 1000)
        yield pd.DataFrame({"key": key[0], "number": part["number"].astype("int64"), "at_us": part["at_us"].astype("int64"), "known": known})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.until.exists() and self.until.get()[0] // 1000 <= expiredTimerInfo.getExpiryTimeInMs():
            self.until.clear()
        return iter(())

    def close(self) -> None:
        pass


def remember(rows: DataFrame, key: Column, at: str, number: Column, life: Column, late: str = "0 seconds") -> DataFrame:
    """Whether each row of a stream finds its key known: key, number, at_us, known (RECALLED).

    at names the rows' time and life is how long (an interval in seconds) a key stays known by a row that found it unknown.
    Rows of a key are taken by time, then number, within a micro-batch; rows that come later than `late` after
    the latest time are dropped by the watermark, as their key may be forgotten already. Null keys are one
    key; null times take no part. A micro-batch's rows of one key are held together, so files for each trigger
    bound a hot key.
    """
    spark = rows.sparkSession
    prepare(spark)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    named = rows.filter(F.col(at).isNotNull()).select(F.coalesce(key.cast("string"), F.lit("")).alias("key"), F.col(at).alias("at"), F.unix_micros(F.col(at)).alias("at_us"), number.cast("long").alias("number"), (life.cast("double") * 1_000_000).cast("long").alias("life_us"))
    with carried(streaming):
        return named.withWatermark("at", late).groupBy("key").transformWithStateInPandas(Remember(), RECALLED, "Append", "EventTime")


def first_seen(posts: DataFrame, hours: float, late: str = "0 seconds") -> DataFrame:
    """Posts (source_id, url, raw_text, fetched_at, ordinal) of a stream whose content was not seen for so long: key (the content's hash), number, at_us."""
    hashed = text.content_hash(F.col("source_id"), F.col("url"), F.col("raw_text"))
    return remember(posts, hashed, "fetched_at", F.col("ordinal"), F.lit(hours * 3600.0), late).filter("not known").drop("known")
