import random
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from tidewire.config import Settings, split_list
from tests import plain_replay
from tidewire.functions import similarity, text
from tidewire.operators import consensus, decide, duplicates, learn, persist, replay



def now():
    return F.lit("2026-08-01 00:00:00").cast("timestamp")


FIELDS = "candidate_id string, source_id string, is_event boolean, confidence double, title string, venue_name string, address string, start_at timestamp, end_at timestamp, latitude double, longitude double, source_url string, processing_status string, evidence map<string,string>"
GOOD = dict(candidate_id="c", source_id="s", is_event=True, confidence=0.9, title="Festival", venue_name="Sala", address=None, start_at=datetime(2026, 8, 20, 20), end_at=None, latitude=-27.3671, longitude=-55.8961, source_url="https://e.com/1", processing_status="GEOLOCATED", evidence={})


def rows(spark, *changes):
    return spark.createDataFrame([tuple((GOOD | c).values()) for c in changes], FIELDS)


@pytest.mark.parametrize(
    "change, decision, reasons",
    [
        ({}, "ACCEPT", ["passed_validation"]),
        ({"is_event": False}, "REJECT", ["publication_is_not_an_event"]),
        ({"source_url": " "}, "REJECT", ["missing_source_url"]),
        ({"source_url": None, "evidence": {"source_url": "https://e.com/2"}}, "ACCEPT", ["passed_validation"]),
        ({"title": " ", "source_url": "http://10.0.0.1"}, "REJECT", ["missing_title", "source_url_not_permitted"]),
        ({"confidence": 0.4, "venue_name": None}, "REJECT", ["confidence_below_minimum"]),
        ({"start_at": None, "venue_name": None}, "REJECT", ["missing_venue_name", "missing_start_at"]),
        ({"start_at": datetime(2026, 8, 1)}, "REJECT", ["event_date_is_not_future"]),
        ({"start_at": datetime(2027, 8, 2)}, "REJECT", ["event_date_beyond_horizon"]),
        ({"end_at": datetime(2026, 8, 20, 19)}, "REJECT", ["end_at_before_start_at"]),
        ({"latitude": -27.0}, "REJECT", ["outside_radius_40.82km"]),
        ({"latitude": None}, "ACCEPT", ["passed_validation"]),
        ({"venue_name": None, "confidence": 0.6, "processing_status": "PENDING_REVIEW"}, "REVIEW", ["missing_venue_name", "low_extraction_confidence", "low_geo_confidence"]),
    ],
)
def test_waterfall(spark, change, decision, reasons):
    r = decide.decide(rows(spark, change), None, now()).first()
    assert (r["decision"], r["reasons"]) == (decision, reasons)


def event(spark, **change):
    e = {"event_id": "e1", "title": "Festival", "venue_name": "Sala", "address": None, "start_at": datetime(2026, 8, 20, 20), "latitude": -27.3671, "longitude": -55.8961} | change
    return spark.createDataFrame([tuple(e.values())], "event_id string, title string, venue_name string, address string, start_at timestamp, latitude double, longitude double")


@pytest.mark.parametrize(
    "change, decision",
    [
        ({}, "MERGE"),
        ({"start_at": datetime(2026, 8, 22, 20)}, "REVIEW"),  # 0.45 + 0.2 + 0.25 * 0.35 + 0.1
        ({"start_at": datetime(2026, 9, 22, 20)}, "REVIEW"),  # all but the date: exactly 0.75
        ({"title": "Otra cosa distinta"}, "ACCEPT"),
    ],
)
def test_duplicates(spark, change, decision):
    c = rows(spark, {})
    found = duplicates.find(c, event(spark, **change))
    assert decide.decide(c, found, now()).first()["decision"] == decision


def batch_of(seed, n, days=6):
    """Candidates with near titles, venues, dates and places, and fields that are missing."""
    rng = random.Random(seed)
    titles = ["Festival del Litoral", "Festival Litoral", "festival del litoral!", "Noche de Jazz", "Noche de jazz en Posadas", "Feria", "Ferias", "Feria del libro", "", "¡!"]
    pick = lambda *xs: rng.choice(xs)
    out = []
    for i in range(n):
        out.append({
            "candidate_id": f"{i:03d}", "source_id": pick("s", "t"), "title": pick(*titles), "venue_name": pick("Sala", "Sala Norte", "sala", None, ""),
            "address": pick(None, None, "", "Calle 1", "Norte", "Calle 12"), "start_at": datetime(2026, 8, 10 + rng.randrange(days), pick(0, 3, 12, 20), pick(0, 30)),
            "latitude": pick(None, -27.3671, -27.3671, -27.3690, -27.3802, -27.4), "longitude": pick(None, -55.8961, -55.8961, -55.8975, -55.9), "confidence": pick(0.6, 0.9, 0.9, 0.9),
        })
    return out


@pytest.mark.parametrize("seed", range(2))
def test_find_loses_nothing(spark, seed):
    """Against all pairs: each candidate's best event, where it scores 0.75 or more."""
    c, e = rows(spark, *batch_of(seed, 60)), rows(spark, *batch_of(seed + 50, 60, 20)).select(F.concat(F.lit("e"), "candidate_id").alias("event_id"), *duplicates.COMPARED)
    got = {r["candidate_id"]: r for r in duplicates.find(c, e).collect()}
    events, n = sorted((r.asDict() for r in e.collect()), key=lambda x: x["event_id"]), 0
    for r in c.collect():
        scored = [(m, x["event_id"]) for x in events if (m := plain_replay.compare(r.asDict(), x, Settings())) and m[0] >= 0.75 - 1e-9]
        top = max((m[0] for m, _ in scored), default=None)
        if top is None:
            assert r["candidate_id"] not in got
            continue
        n += 1
        (score, dated, placed), name = next((m, k) for m, k in scored if m[0] >= top - 1e-12)
        g = got[r["candidate_id"]]
        assert g["score"] == pytest.approx(score) and (g["event_id"], g["date_compatible"], g["location_compatible"]) == (name, dated, placed)
    assert n > 15


def test_bound_of_titles_holds(spark):
    """No pair is more alike than its lengths, letters and words allow."""
    rng = random.Random(8)
    words = ["feria", "ferias", "de", "la", "el", "jazz", "ñandú", "x", "noche", "9", "festival", "niño"]
    texts = [" ".join(rng.choices(words, k=rng.randrange(0, 7))) for _ in range(60)] + ["".join(rng.choices("abcdé ", k=rng.randrange(20))) for _ in range(40)]
    df = spark.createDataFrame([(a, b) for a in texts for b in rng.sample(texts, 20)], "a string, b string").select(text.match_text(F.col("a")).alias("a"), text.match_text(F.col("b")).alias("b"))
    got = df.select(similarity.composite(similarity.fuzzy("a", "b"), F.col("a"), F.col("b")).alias("s"), similarity.at_most(similarity.features(F.col("a")), similarity.features(F.col("b"))).alias("m")).collect()
    assert all(r["s"] <= r["m"] + 1e-9 for r in got) and sum(r["m"] < 0.6 for r in got) > 200


def test_replay_sees_its_own_batch(spark):
    batch = rows(spark, {"candidate_id": "a", "source_id": "1"}, {"candidate_id": "b", "source_id": "2"}, {"candidate_id": "c", "source_id": "3", "title": "Otra"}, {"candidate_id": "d", "source_id": "0", "is_event": False})
    first = decide.decide(batch, None, now())
    out = {r["candidate_id"]: (r["decision"], r["duplicate_of"]) for r in replay.replay(first, event(spark).limit(0), ["source_id"]).collect()}
    assert out == {"a": ("ACCEPT", None), "b": ("MERGE", "new:a"), "c": ("ACCEPT", None), "d": ("REJECT", None)}


@pytest.mark.parametrize("seed, n, stored", [(1, 70, 6), (2, 70, 25)])
def test_replay_agrees_with_a_plain_loop(spark, seed, n, stored):
    """Rounds over all candidates at once give what one loop over them gives."""
    first = decide.decide(rows(spark, *batch_of(seed, n)), None, now()).cache()
    events = rows(spark, *batch_of(seed + 90, stored), {"candidate_id": "zz"}).select(F.concat(F.lit("e"), "candidate_id").alias("event_id"), *duplicates.COMPARED)
    told = {}
    got = {r["candidate_id"]: (r["decision"], r["duplicate_of"], r["decision_score"]) for r in replay.replay(first, events, ["source_id"], told=told).collect()}
    mine = sorted((r.asDict() for r in first.collect() if r["decision"] != "REJECT"), key=lambda r: (r["source_id"], r["candidate_id"]))
    want = plain_replay.loop(mine, [r.asDict() for r in events.collect()])
    assert {k: got[k][:2] for k in want} == {k: v[:2] for k, v in want.items()}
    assert all(got[k][2] == pytest.approx(v[2]) for k, v in want.items() if v[1])
    kinds = [d for d, *_ in want.values()]
    assert kinds.count("ACCEPT") > 3 and "MERGE" in kinds and told["rounds"] > 1


def test_replay_of_nothing(spark):
    first = decide.decide(rows(spark, {}).limit(0), None, now())
    assert replay.replay(first, event(spark), ["source_id"]).count() == 0


def test_consensus(spark):
    p = "query string, provider string, ordinal int, display_name string, latitude double, longitude double, importance double, confidence double"
    agreeing = [("q", "a", 0, "A", -27.367, -55.896, 0.5, None), ("q", "b", 0, "B", -27.368, -55.896, None, 0.8), ("q", "b", 1, "far", -27.9, -55.8, None, 0.9)]
    out = consensus.agree(spark.createDataFrame(agreeing, p)).collect()
    assert len(out) == 1 and out[0]["consensus"] and out[0]["provider"] == "consensus" and out[0]["display_name"] == "B"
    assert abs(out[0]["latitude"] - (-27.367 * 0.5 - 27.368 * 0.8) / 1.3) < 1e-9
    apart = [("q", "a", 0, "A", -27.0, -55.0, 0.5, 0.0), ("q", "b", 0, "B", -28.0, -56.0, None, 0.8)]
    out = consensus.agree(spark.createDataFrame(apart, p)).orderBy("place").collect()
    assert [r["provider"] for r in out] == ["b", "a"] and not any(r["consensus"] for r in out)
    alone = [("q", "a", k, f"A{k}", -27.0, -55.0, 0.1 * k, None) for k in range(3)]
    assert consensus.agree(spark.createDataFrame(alone, p)).count() == 3


def test_slugs_skip_taken_numbers(spark):
    new = spark.createDataFrame([("a", "Feria", datetime(2026, 8, 1)), ("b", "Feria", datetime(2026, 8, 1)), ("c", "FERIA!", datetime(2026, 8, 1))], "id string, title string, start_at timestamp")
    taken = spark.createDataFrame([("feria-20260801",), ("feria-20260801-3",)], "slug string")
    assert [r["slug"] for r in persist.unique_slugs(new, taken, ["id"]).orderBy("id").collect()] == ["feria-20260801-2", "feria-20260801-4", "feria-20260801-5"]


def test_reliability(spark):
    df = spark.createDataFrame([(1.0, 100, 100, 1.0), (0.5, 0, 0, 0.0)], "b double, a int, p int, q double")
    got = [r["x"] for r in df.select(learn.reliability(F.col("b"), F.col("a"), F.col("p"), F.col("q")).alias("x")).collect()]
    assert got == pytest.approx([0.9923076923, 0.4])


def test_similarity():
    assert similarity.token_set("a b c", "c a") == 100
    assert similarity.ratio("abc", "abc") == 100 and similarity.ratio("abc", "xyz") == 0
    assert similarity.partial("jazz", "noche de jazz") == 100
    assert similarity.weighted("", "x") == 0
    assert similarity.lcs("festival", "fstivl") == 6


def test_settings():
    with pytest.raises(ValueError):
        Settings(confidence_review=0.8)
    with pytest.raises(ValueError):
        Settings(geo_weights=(1.0, 1.0))
    assert split_list(" A, ,b ") == ("a", "b")
