"""Agreement of several geocoding providers on one place."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from tidewire.config import DEFAULT, Settings
from tidewire.functions.geo import EARTH_KM, haversine_km
from tidewire.runtime import materialise, prepare


def labels(latitude: np.ndarray, longitude: np.ndarray, meters: float) -> np.ndarray:
    """Clusters of points in their order: each joins the first cluster that has a member within the limit, else begins one.

    Points without coordinates (NaN) are near none. Copies of a point are compared once: each distinct point knows the
    first cluster that has come near it, which changes only when a distinct point is new to a cluster.
    """
    there = ~(np.isnan(latitude) | np.isnan(longitude))
    points, at = np.unique(np.stack([latitude[there], longitude[there]], axis=1), axis=0, return_inverse=True)
    code = np.full(len(latitude), -1)
    code[there] = at.reshape(-1)
    ys, y, x = points[:, 0], np.radians(points[:, 0]), np.radians(points[:, 1])
    band = np.degrees(meters / 1000 / EARTH_KM) * (1 + 1e-9) + 1e-9
    none = len(latitude)
    near, joined = np.full(len(points), none), np.full(len(points), none)
    out, made = np.empty(len(latitude), np.int64), 0
    for i, p in enumerate(code.tolist()):
        c = made if p < 0 else min(int(near[p]), made)
        out[i] = c
        made = max(made, c + 1)
        if p >= 0 and joined[p] != c:
            joined[p] = c
            low, high = np.searchsorted(ys, ys[p] - band), np.searchsorted(ys, ys[p] + band, "right")
            h = np.sin((y[low:high] - y[p]) / 2) ** 2 + np.cos(y[p]) * np.cos(y[low:high]) * np.sin((x[low:high] - x[p]) / 2) ** 2
            close = low + np.flatnonzero(2 * EARTH_KM * np.arcsin(np.sqrt(h)) * 1000 <= meters)
            near[close] = np.minimum(near[close], c)
    return out


def _labelled(rows: DataFrame, meters: float) -> DataFrame:
    """rows (query, many, k and a point) with label, the cluster of their query that they are in; k if there is one provider."""

    def label(group: pa.Table) -> pa.Table:
        k = group["k"].to_numpy()
        found = k.astype(np.int64)
        if group["many"][0].as_py() > 1:
            order = np.argsort(k)
            y, x = (group[c].to_numpy().astype(float)[order] for c in ("latitude", "longitude"))
            found[order] = labels(y, x, meters)
        return group.append_column("label", pa.array(found))

    return rows.groupBy("query").applyInArrow(label, StructType([*rows.schema.fields, StructField("label", LongType())]))


def agree(candidates: DataFrame, s: Settings = DEFAULT) -> DataFrame:
    """Per query (query, provider, ordinal, display_name, latitude, longitude, importance, confidence) its places, best first.

    With one provider its candidates stay as they are. Else candidates are clustered by distance, best first, and if
    the best cluster holds enough providers closely enough, it alone is returned, at its weighted centre. A score of
    zero counts as none. A point without coordinates is near none. A query's candidates are clustered in one task,
    which costs their number and the distinct points that are new to a cluster; how far a cluster's points lie apart is a
    join of its distinct points.
    """
    prepare(candidates.sparkSession)
    score = F.coalesce(F.when(F.col("confidence") != 0, F.col("confidence")), F.col("importance"), F.lit(0.0)).cast("double")
    rows = candidates.select("query", "provider", "ordinal", "display_name", F.col("latitude").cast("double").alias("latitude"), F.col("longitude").cast("double").alias("longitude"), score.alias("score"))
    many = rows.groupBy(F.col("query").alias("of")).agg(F.count_distinct("provider").alias("many"))
    rows = rows.join(many, rows["query"].eqNullSafe(F.col("of"))).drop("of")
    in_turn = Window.partitionBy("query").orderBy(F.when(F.col("many") > 1, -F.col("score")), "provider", "ordinal", "display_name", "latitude", "longitude", "score")
    rows = rows.withColumn("k", F.row_number().over(in_turn) - 1)
    rows = materialise(_labelled(rows, s.consensus_meters), "consensus-labels")
    weight = F.when(F.col("score") > 0, F.col("score")).otherwise(1.0)
    found = rows.groupBy("query", "label").agg(
        F.first("many").alias("many"),
        F.min_by(F.struct("provider", "display_name", "latitude", "longitude", "score"), "k").alias("best"),
        F.array_sort(F.collect_set("provider")).alias("names"),
        F.count("*").cast("int").alias("candidate_count"),
        *[F.round(which(c), 6).alias(f"{n}_{c}") for c in ("latitude", "longitude") for n, which in (("min", F.min), ("max", F.max))],
        F.array_sort(F.collect_list(F.struct("k", "latitude", "longitude", weight.alias("weight")))).alias("members"),
    )
    points = rows.select("query", "label", "latitude", "longitude").distinct()
    other = points.toDF("query_b", "label_b", "latitude_b", "longitude_b")
    pairs = points.join(other, F.col("query").eqNullSafe(F.col("query_b")) & (F.col("label") == F.col("label_b")))
    meters = haversine_km(F.col("latitude"), F.col("longitude"), F.col("latitude_b"), F.col("longitude_b")) * 1000
    far = pairs.groupBy(F.col("query").alias("query_b"), F.col("label").alias("label_b")).agg(F.coalesce(F.max(meters), F.lit(0.0)).alias("apart"))
    told = found.join(far, F.col("query").eqNullSafe(F.col("query_b")) & (F.col("label") == F.col("label_b"))).drop("query_b", "label_b")
    several = F.col("many") > 1
    agreed = several & (F.size("names") >= s.consensus_providers) & (F.col("apart") <= s.consensus_meters)
    total = lambda of: F.aggregate("members", F.lit(0.0), lambda a, m: a + of(m))
    centre = lambda f: F.when(agreed, total(lambda m: m[f] * m["weight"]) / total(lambda m: m["weight"])).otherwise(F.col("best")[f])
    told = told.select(
        "query",
        "label",
        "many",
        F.when(agreed, "consensus").otherwise(F.col("best.provider")).alias("provider"),
        "best.display_name",
        centre("latitude").alias("latitude"),
        centre("longitude").alias("longitude"),
        "best.score",
        F.size("names").alias("provider_count"),
        "candidate_count",
        F.array_join("names", ",").alias("providers"),
        "min_latitude",
        "max_latitude",
        "min_longitude",
        "max_longitude",
        F.round("apart", 1).alias("max_distance_m"),
        agreed.alias("consensus"),
    )
    ranked = Window.partitionBy("query").orderBy(*[F.when(several, c) for c in (-F.col("provider_count"), -F.col("score"), F.col("max_distance_m"))], "label")
    sure = several & (F.first("provider_count").over(ranked) >= s.consensus_providers) & (F.first("max_distance_m").over(ranked) <= s.consensus_meters)
    placed = told.withColumns({"place": F.row_number().over(ranked) - 1, "sure": sure}).filter(~F.col("sure") | (F.col("place") == 0))
    return placed.select("query", "place", *[c for c in told.columns if c not in ("query", "label", "many")])


#: The names under which providers' metadata tell of a cluster.
COUNT_KEY, DISTANCE_KEY = "geo_cluster_provider_count", "geo_cluster_max_distance_m"


def told_count(metadata: Column) -> Column:
    """How many providers a cluster has, by its metadata; 1 unless digits say so."""
    said = metadata[COUNT_KEY]
    return F.when(said.rlike(r"^[0-9]+$"), said.try_cast("int")).otherwise(1)


def told_distance(metadata: Column) -> Column:
    """How far apart a cluster's places are, by its metadata; 0 unless a number says so."""
    return F.coalesce(metadata[DISTANCE_KEY].try_cast("double"), F.lit(0.0))
