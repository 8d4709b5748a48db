"""How reliable sources turn out to be."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewire.functions.geo import clamp01

#: Weights of the score before, the smoothed rate of acceptance, and the quality; and the smoothing counts.
BEFORE, RATE, QUALITY = 0.4, 0.4, 0.2
GOOD, ALL = 2, 4


def source_stats(decisions: DataFrame) -> DataFrame:
    """Per source of decisions (source_id, decision, confidence): processed, accepted, rejected, avg_quality; null sources are left out."""
    good = F.col("decision").isin("ACCEPT", "MERGE")
    return decisions.filter("source_id is not null").groupBy("source_id").agg(F.count("*").alias("processed"), F.count_if(good).alias("accepted"), F.count_if(F.col("decision") == "REJECT").alias("rejected"), F.coalesce(F.avg(F.when(good, F.col("confidence"))), F.lit(0.0)).alias("avg_quality"))


def reliability(before: Column, accepted: Column, processed: Column, quality: Column) -> Column:
    return clamp01(before * BEFORE + (accepted + GOOD) / (processed + ALL) * RATE + quality * QUALITY)


def update(sources: DataFrame, stats: DataFrame) -> DataFrame:
    """The score history of sources that have stats: source_id, previous_score, new_score and the counts."""
    new = reliability(F.col("reliability_score"), F.col("accepted"), F.col("processed"), F.col("avg_quality"))
    return sources.join(stats, "source_id").select("source_id", F.round("reliability_score", 3).alias("previous_score"), F.round(new, 3).alias("new_score"), "processed", "accepted", "rejected", F.round("avg_quality", 3).alias("avg_quality"))


def apply(sources: DataFrame, history: DataFrame) -> DataFrame:
    """Sources with their new scores."""
    new = history.select("source_id", F.col("new_score").alias("tw_new"))
    return sources.join(new, "source_id", "left").withColumn("reliability_score", F.coalesce("tw_new", "reliability_score")).select(*sources.columns)
