"""The whole cycle over a few sources that tell of one event."""

import json
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from tidewire import cli
from tidewire.plans import cycle
from tidewire.sources import catalogs, providers
from tidewire.store import Lock

RSS = "<rss><channel>{}</channel></rss>"
ITEM = "<item><title>{}</title><link>https://n{}.example.com/{}</link><description>{}</description></item>"
PLACES = [(0, "Anfiteatro", "anfiteatro manuel ramirez", [], "Posadas", "Misiones", "ar", -27.36, -55.89, "venue", True)]


def model(text, date):
    title = text.split("\n")[0]
    if title == "broken":
        raise RuntimeError("rate limit")
    if title == "no event":
        return json.dumps({"events": []})
    return json.dumps({"events": [{"is_event": True, "confidence": 0.9, "title": "Festival del Litoral", "start_at": "2026-08-20T20:00:00Z", "venue_name": "Anfiteatro Manuel Ramírez", "price_text": "$ 100" if "price" in text else None}]})


def start(spark):
    sources = spark.createDataFrame([("s1", "rss", "https://n1.example.com/feed", True, 0.9), ("s2", "rss", "https://n2.example.com/feed", True, 0.6), ("s3", "rss", "https://n3.example.com/feed", True, 0.5), ("s4", "facebook", "https://n4.example.com", True, 0.5), ("s5", "rss", "https://n5.example.com", False, 0.5)], "source_id string, adapter_type string, base_url string, active boolean, reliability_score double")
    empty = lambda kinds: spark.createDataFrame([], kinds)
    return cycle.State(sources, empty(cycle.RAW), empty(cycle.EVENTS), empty(cycle.LINKS))


def fetched(spark):
    bodies = {"s1": [("a", "x"), ("b", "price")], "s2": [("c", "x"), ("d", "x"), ("broken", "x")], "s3": [("e", "x"), ("f", "x"), ("g", "x"), ("no event", "x")]}
    rows = [(k, RSS.format("".join(ITEM.format(t, k[1], i, d) for i, (t, d) in enumerate(v)))) for k, v in bodies.items()] + [("s4", "page"), ("s5", RSS.format(""))]
    return spark.createDataFrame(rows, "source_id string, body string")


def test_cycle_and_rerun(spark):
    places = spark.createDataFrame(PLACES, f"ordinal int, {catalogs.PLACE}")
    answers = providers.nominatim(spark.createDataFrame([], "query string, payload string"))
    now = F.lit("2026-08-01 00:00:00").cast("timestamp")
    out = cycle.run_cycle(start(spark), fetched(spark), model, places, answers, now)
    decided = [(r["source_id"], r["decision"]) for r in out.results.orderBy("source_rank", "ordinal").collect()]
    assert decided == [("s1", "ACCEPT"), ("s1", "MERGE"), ("s2", "MERGE"), ("s2", "MERGE"), ("s3", "MERGE"), ("s3", "MERGE"), ("s3", "MERGE")]
    counters = out.logs["counters"].first()
    assert (counters["events_accepted"], counters["events_merged"]) == (1, 6)
    event = out.state.events.collect()
    assert len(event) == 1 and event[0]["slug"] == "festival-del-litoral-20260820" and event[0]["status"] == "UPDATED" and event[0]["price_text"] == "$ 100"
    links = out.state.links.collect()
    assert len(links) == 7 and sum(r["is_primary"] for r in links) == 1 and len({r["source_id"] for r in links}) == 3
    assert out.logs["status"].first()["status"] == "PARTIAL"
    by_source = {r["source_id"]: (r["status"], r["items_accepted"]) for r in out.logs["source_runs"].collect()}
    assert by_source["s4"][0] == "FAILED" and by_source["s2"] == ("COMPLETED", 2)
    assert out.state.raw_contents.count() == 9 and out.logs["classifications"].count() == 9
    history = {r["source_id"]: r["new_score"] for r in out.logs["score_history"].collect()}
    assert history["s1"] == round(0.4 * 0.9 + 0.4 * 4 / 6 + 0.2 * 0.9, 3)

    again = cycle.run_cycle(out.state, fetched(spark), model, places, answers, now)
    assert again.results.count() == 0 and again.state.events.count() == 1 and again.state.links.count() == 7

    later = F.lit("2027-01-01 00:00:00").cast("timestamp")
    over = cycle.run_cycle(again.state, fetched(spark), model, places, answers, later)
    assert over.logs["archived"].first()["events_archived"] == 1
    assert over.state.events.first()["status"] == "ARCHIVED" and over.state.events.first()["start_at"] == datetime(2026, 8, 20, 20)


def test_single_cycle_command(spark, tmp_path, capsys, monkeypatch):
    """Seed, one cycle, the same again, and one that breaks off: the store keeps its last whole version."""
    store = f"{tmp_path}/store"
    entries = [{"name": n, "base_url": f"https://{n}.example.com/feed", "adapter_type": "rss", "reliability_score": 0.6, "active": True} for n in ("n1", "n2")]
    (tmp_path / "sources.json").write_text(json.dumps(entries))
    (tmp_path / "places.json").write_text(json.dumps([{"name": "Anfiteatro", "normalized_name": "anfiteatro manuel ramirez", "city": "Posadas", "state": "Misiones", "latitude": -27.36, "longitude": -55.89, "kind": "venue"}]))
    cli.main(["seed", "--catalog", f"{tmp_path}/sources.json", "--store", store], spark)
    ids = sorted(r["source_id"] for r in cli.stored(spark, store)[0].collect())
    (tmp_path / "fetched").mkdir()
    (tmp_path / "fetched/a.json").write_text("\n".join(json.dumps({"source_id": s, "body": RSS.format(ITEM.format(f"t{k}", k, k, "x"))}) for k, s in enumerate(ids)))
    args = ["cycle", "--store", store, "--fetched", f"{tmp_path}/fetched", "--catalog", f"{tmp_path}/places.json", "--extractor", "tests.test_cycle:model", "--now", "2026-08-01 00:00:00"]
    assert cli.main(args, spark) == 0 and cli.main(args, spark) == 0
    said = capsys.readouterr().out.splitlines()
    assert said[1] == "COMPLETED version=1 accepted=1 merged=1 reviewed=0 rejected=0" and said[2].startswith("COMPLETED version=2 accepted=0 merged=0")
    tables, last, versions = cli.state(spark, store)
    assert last == 2 and tables["events"].count() == 1 and tables["links"].count() == 2 and versions.read(1, "log_decisions").count() == 2
    lock = Lock(spark, f"{store}/{cli.LOCK}")
    assert lock.take("other") and cli.main(args, spark) == 1 and lock.release("other")
    monkeypatch.setattr(cli.cycle, "run_cycle", lambda *a: 1 / 0)
    with pytest.raises(ZeroDivisionError):
        cli.main(args, spark)
    assert cli.state(spark, store)[1] == 2 and lock.holder() is None
    cli.main(["empty", "--store", store], spark)
    tables, last, versions = cli.state(spark, store)
    assert last == 3 and tables["events"].count() == 0 and versions.read(2, "events").count() == 1
