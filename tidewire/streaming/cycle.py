"""The cycle as a stream: each micro-batch is one run over newly landed posts."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tidewire.functions import text
from tidewire.operators import collect
from tidewire.runtime import scratch


def posts_stream(spark: SparkSession, folder: str, schema: StructType, files_per_batch: int = 1000) -> DataFrame:
    """Files of posts (source_id, url, raw_text, ordinal) as they land in a folder."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(folder)


def store_new(batch: DataFrame, store: str, batch_id: str, then: Callable[[DataFrame], None] | None = None) -> None:
    """Store a batch's new posts below its own name; a batch that is run again finds, and stores, the same posts.

    then() gets the new posts as they are stored: extraction, location, decisions and persistence follow
    from there. A batch that broke off, in writing or in then(), is run again as a whole, so then() sees
    every new post at least once and must not mind to see a batch twice.
    """
    spark = batch.sparkSession
    hashed = batch.withColumn("content_hash", text.content_hash(F.col("source_id"), F.col("url"), F.col("raw_text")))
    columns = "source_id string, content_hash string"
    stored = spark.createDataFrame([], columns)
    if _exists(spark, store):  # what other batches stored; this one's own earlier attempt does not count
        stored = spark.read.schema(f"{columns}, batch string").parquet(store).filter(F.col("batch") != batch_id).drop("batch")
    new = collect.collect_new(hashed, stored, [F.col("ordinal")])
    own = f"{store}/batch={batch_id}"
    new.write.mode("overwrite").parquet(own)
    if then is not None:
        then(spark.read.schema(new.schema).parquet(own))


def _exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def run_available(posts: DataFrame, store: str, checkpoint: str, then: Callable[[DataFrame], None] | None = None) -> None:
    """Work off all that has landed, in micro-batches one after another, and stop: what a schedule starts."""


    def work(batch: DataFrame, number: int) -> None:
        # A new checkpoint numbers its batches anew, but has an id of its own.
        said = batch.sparkSession.read.text(f"{checkpoint}/metadata", wholetext=True).first()["value"]
        store_new(batch, store, f"{json.loads(said)['id']}-{number}", then)

    query = posts.writeStream.foreachBatch(work).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()


def ingest_twice(spark: SparkSession, posts: DataFrame) -> DataFrame:
    """Land posts in two overlapping parts that together hold all, run the stream after each, and return what is stored."""
    landing, store, checkpoint = (scratch(spark, f"stream-{n}") for n in ("landing", "store", "checkpoint"))
    for part in (posts.filter("ordinal % 3 <> 0"), posts.filter("ordinal % 2 = 0 or coalesce(ordinal % 3, 0) = 0")):
        part.write.mode("append").parquet(landing)
        run_available(posts_stream(spark, landing, posts.schema), store, checkpoint)
    return spark.read.option("basePath", store).parquet(store).drop("batch")
