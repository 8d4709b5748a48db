"""New posts: the first of equal ones in a batch, without those already stored."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def first_in_batch(posts: DataFrame, order: list[Column], key: str = "content_hash") -> DataFrame:
    """Of posts with one hash the first in order; rows without a hash are one group."""
    place = Window.partitionBy(key).orderBy(*order)
    return posts.withColumn("tw_n", F.row_number().over(place)).filter("tw_n = 1").drop("tw_n")


def unseen(posts: DataFrame, stored: DataFrame) -> DataFrame:
    """Posts whose (source_id, content_hash) is not stored yet."""
    return posts.join(stored.select("source_id", "content_hash").distinct(), ["source_id", "content_hash"], "left_anti").select(*posts.columns)


def collect_new(posts: DataFrame, stored: DataFrame, order: list[Column]) -> DataFrame:
    return unseen(first_in_batch(posts, order), stored)
