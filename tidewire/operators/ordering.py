"""Numbers for rows in an order, without any task that sees them all."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewire.runtime import materialise

#: monotonically_increasing_id() has the partition above these bits.
PLACE_BITS = 33


def numbered(rows: DataFrame, name: str, *order: Column) -> DataFrame:
    """rows with number (from 0) in the given order, which nothing but equal rows may leave open.

    Rows are dealt and sorted by ranges and written; a range's numbers begin where those before it end. The only window
    without a key is over the ranges' counts, as many as a shuffle has partitions.
    """
    lanes = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = materialise(rows.repartitionByRange(lanes, *order).sortWithinPartitions(*order).withColumn("tw_at", F.monotonically_increasing_id()), name)
    part = F.shiftright("tw_at", PLACE_BITS)
    counts = placed.groupBy(part.alias("tw_part")).agg(F.count("*").alias("tw_count"))
    before = counts.select("tw_part", (F.sum("tw_count").over(Window.orderBy("tw_part")) - F.col("tw_count")).alias("tw_before"))
    return placed.withColumn("tw_part", part).join(before, "tw_part").withColumn("number", F.col("tw_before") + F.col("tw_at").bitwiseAND((1 << PLACE_BITS) - 1)).drop("tw_at", "tw_part", "tw_before")
