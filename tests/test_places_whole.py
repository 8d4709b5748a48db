"""Places are worked out once for what is alike, however many rows there are."""

import random

import numpy as np
from pyspark.sql import functions as F

from tidewire.functions.geo import EARTH_KM
from tidewire.operators import consensus, geoclassify

SAID = "id int, address string, venue_name string, geo_query string, evidence map<string,string>"
CANDIDATE = "key string, normalized_name string, provider string, ordinal int, latitude double, longitude double, city string, state string, country_code string, precision string, importance double, confidence double"


def _meters(a, b):
    p, q = np.radians(a), np.radians(b)
    h = np.sin((q[0] - p[0]) / 2) ** 2 + np.cos(p[0]) * np.cos(q[0]) * np.sin((q[1] - p[1]) / 2) ** 2
    return 2 * EARTH_KM * np.arcsin(np.sqrt(h)) * 1000


def _greedy(points):
    found, out = [], []
    for p in points:
        at = next((k for k, c in enumerate(found) if any(_meters(m, p) <= 300 for m in c)), len(found))
        if at == len(found):
            found.append([])
        found[at].append(p)
        out.append(at)
    return out


def test_labels_are_those_of_a_plain_loop():
    """Copies too, which may join an earlier cluster than the copy before them did."""
    rng = random.Random(4)
    spots = [(-27.3 + rng.randrange(8) * 0.002, -55.9 + rng.randrange(8) * 0.002) for _ in range(25)] + [(float("nan"), 1.0)]
    for _ in range(20):
        points = [rng.choice(spots) for _ in range(60)]
        y, x = np.array(points).T
        assert consensus.labels(y, x, 300.0).tolist() == _greedy(points)


def test_thousands_of_candidates_of_one_query(spark):
    """Two spots 3 km apart, with 20 thousand candidates at each: all pairs of them would be 800 million."""
    k = F.col("id")
    rows = spark.range(40_000).select(F.lit("q").alias("query"), F.when(k % 3 == 0, "a").otherwise("b").alias("provider"), k.cast("int").alias("ordinal"), F.concat(F.lit("n"), k).alias("display_name"), (-27.3 - (k % 2) * 0.03 - (k % 5) * 0.0001).alias("latitude"), F.lit(-55.9).alias("longitude"), F.lit(None).cast("double").alias("importance"), F.when(k == 7, 0.9).otherwise(0.5).alias("confidence"))
    (got,) = consensus.agree(rows).collect()
    assert (got["place"], got["provider"], got["display_name"], got["candidate_count"], got["providers"], got["score"]) == (0, "consensus", "n7", 20_000, "a,b", 0.9)
    assert abs(got["latitude"] - -27.3302) < 1e-6 and 44 < got["max_distance_m"] < 45


def test_what_rows_say_alike_is_worked_out_once(spark):
    said = [("Calle 1", "Sala", None, {"venue_name": "Sala"}), ("Calle 1", None, None, None), (None, None, None, {"address": "Calle 1"}), (None, None, None, None)]
    rows = spark.createDataFrame([(k, *said[k % 4]) for k in range(400)], SAID)
    kinds = geoclassify.kinds_of(rows)
    assert kinds.count() == 4
    got = {r["id"]: (r["text"], r["queries"]) for r in geoclassify.with_kinds(rows, kinds, "text", "queries").collect()}
    want = {r["id"]: (r["text"], r["queries"]) for r in rows.select("id", geoclassify.original_text().alias("text"), geoclassify.queries_of().alias("queries")).collect()}
    assert len(got) == 400 and got == want


def test_candidates_that_cannot_decide_meet_no_text(spark):
    """Of 3000 candidates under two names one of each remains; of those whose two surest are close, the surest."""
    near, far = (-27.3671, -55.8961), (-20.0, -50.0)
    rows = [("q", f"plaza {k % 2}", "p", k, *(near if k % 10 in (4, 7) else far), "Posadas" if k % 5 in (2, 4) else None, None, "ar", "street", None, 0.95 if k == 0 else 0.5) for k in range(3000)]
    rows += [("r", "plaza", "p", k, *near, "Posadas", None, "ar", "street", None, 0.5 + 0.01 * (k == 900)) for k in range(1000)]
    none = spark.createDataFrame([], "key string, name string")
    found = spark.createDataFrame(rows, CANDIDATE)
    left = sorted((r["key"], r["normalized_name"], r["unclear"], r["x"]["ordinal"]) for r in geoclassify.standing(found, none, "key").collect())
    assert left == [("q", "plaza 0", False, 4), ("q", "plaza 1", False, 7), ("r", "plaza", True, 900)]
    got = {r["key"]: (r["decision"], r["breakdown"]["city_match"]) for r in geoclassify.from_candidates(found.withColumn("normalized_name", F.replace("normalized_name", F.lit("plaza"), F.col("key"))), none).collect()}
    assert got["r"] == ("manual_review", 1.0) and got["q"][1] == 1.0
