"""Services around the engine: links, cards, waits, breakers, commands, exactly-once storing, scratch."""

import json
import random
from urllib.parse import urljoin

import pytest
from pyspark.sql import functions as F

from tidewire import cli, runtime
from tidewire.functions import similarity, urls
from tidewire.functions.text import normalize_location
from tidewire.operators import consensus, geoclassify, runs
from tidewire.sources import clients, feeds, providers, resilience
from tidewire.store import Lock
from tidewire.streaming import cycle


def test_links_of_any_depth(spark):
    bases = ["http://h/a/b/c/d/e/f/", "http://h/a/b", "http://h", "https://h:8/x/y/z?q#f"]
    hrefs = ["../../../../../x", "../x", "./x", "x/./y/../z", "../../../../../../../../x", "/p/../q", "..", ".", "x?u=../v", "?n=1", "#t", "//o/x", "mailto:a", "a/b/..", ""]
    rows = [(b, h) for b in bases for h in hrefs]
    got = {(r["b"], r["h"]): r["u"] for r in spark.createDataFrame(rows, "b string, h string").select("b", "h", urls.resolve(F.col("b"), F.col("h")).alias("u")).collect()}
    for (b, h), u in got.items():
        assert u == urljoin(b, h), (b, h)


def test_cards():
    html = """<p>no</p><article><h2><a href="/no">plain</a></h2></article>
      <div class="Big EVENT-row"><h2> A <b>b</b> </h2><div><p>one</p><li><p>two</p></li></div><a href=""></a><a href="/a">x</a><a href="/b"></a><time>soon</time><time datetime="2026-01-01">now</time></div>
      <li class="item"><h3>no link</h3></li><li class="item"><a href="/c">no title</a></li>
      <div class="card"><h1>lost<p>kept</p></h1><h4>T</h4><a href="/d"></a></div><div class="post"><h2>never ends</h2><a href="/e"></a>"""
    got = feeds.read_cards(html)
    assert got == [
        {"link": "/a", "title": "A b", "body": "one two", "published": "2026-01-01", "when": "soon now"},
        {"link": "/d", "title": "T", "body": "kept", "published": None, "when": ""},
    ]
    assert feeds.read_cards(None) == [] and feeds.read_cards("<div class=card>") == []


def test_spaced_and_guarded_calls(spark):
    rng = random.Random(1)
    calls = [(rng.randrange(3), float(rng.randrange(100)), rng.random() < 0.5) for _ in range(200)]
    df = spark.createDataFrame(calls, "service int, at double, ok boolean")
    got = sorted((r["service"], r["starts_at"]) for r in resilience.spaced(df, 2.5).collect())
    want = []
    for s in range(3):
        last = None
        for at in sorted(a for k, a, _ in calls if k == s):
            last = at if last is None else max(at, last + 2.5)
            want.append((s, last))
    assert got == sorted(want)
    got = sorted((r["service"], r["at"], r["ok"], r["allowed"]) for r in resilience.guarded(df, 2, 10.0).collect())
    want = []
    for s in range(3):
        failed, shut = 0, None
        for at, ok in sorted((a, o) for k, a, o in calls if k == s):
            allowed = shut is None or at - shut >= 10
            if allowed and shut is not None:
                failed, shut = 0, None
            want.append((s, at, ok, allowed))
            if allowed:
                failed = 0 if ok else failed + 1
                shut = at if failed >= 2 else None
    assert got == sorted(want)
    row = spark.range(1).select(resilience.backoff(F.lit(3), 0.5, 0.0).alias("a"), resilience.backoff(F.lit(0), 1.0, 2.0).alias("b")).first()
    assert row["a"] == 4.0 and 1.0 <= row["b"] <= 3.0


def test_clients():
    with pytest.raises(clients.NotConfigured):
        clients.read_image("http://x")
    with pytest.raises(TypeError):
        clients.classification(lambda _: 5, None)
    with pytest.raises(ValueError):
        providers.request_url("geoapify", "x")
    assert clients.jdbc_options("postgres://u:p@h/d", "t")["url"] == "jdbc:postgresql://h:5432/d"


def test_database_in_parts(spark):
    """Filters and columns reach the database, connections share the rows, nulls and empty tables are read."""
    url = "jdbc:derby:memory:parts;create=true"
    rows = spark.createDataFrame([(k if k % 10 else None, f"n{k % 7}", k * 0.5) for k in range(200)], "id long, name string, price double")
    clients.write_table(rows, url, "T", "id BIGINT, name VARCHAR(10)")
    got = clients.read_parts(spark, url, "T", "id", 4)
    assert got.rdd.getNumPartitions() == 4
    assert sorted((r["id"] or -1, r["name"], r["price"]) for r in got.collect()) == sorted((r["id"] or -1, r["name"], r["price"]) for r in rows.collect())
    some = got.filter("name = 'n3' and id > 100").select("price")
    plan = some._jdf.queryExecution().executedPlan().toString()
    assert "*EqualTo(name,n3)" in plan and "*GreaterThan(id,100)" in plan and "ReadSchema: struct<price:double>" in plan
    assert sorted(r["price"] for r in some.collect()) == [k * 0.5 for k in range(101, 200) if k % 7 == 3 and k % 10]
    clients.write_table(rows.limit(0), url, "T")
    assert clients.read_parts(spark, url, "T", "id", 4).count() == 0 and clients.read_table(spark, url, "T").count() == 0


def test_column_forms_agree_with_plain_ones(spark):
    """Provider chains, database urls and checks of settings, as columns and as functions."""
    from dataclasses import replace

    from tidewire import config

    cases = [(["locationiq", "nominatim", "geoapify"], {"locationiq": "a", "geoapify": "b"}), (["nominatim", "geoapify"], {}), (["geoapify"], {"geoapify": ""}), (["nominatim"], None)]
    got = spark.createDataFrame(cases, "n array<string>, k map<string,string>").select(providers.chain(F.col("n"), F.col("k")).alias("c")).collect()
    assert [r["c"] for r in got] == [providers.enabled(tuple(n), k or {}) for n, k in cases]
    urls = ["postgres://u:p@h/d", "postgresql://h:5433/d", "jdbc:derby:x"]
    df = spark.createDataFrame([(u,) for u in urls], "u string")
    made = df.select(*[c.alias(n) for n, c in clients.jdbc_columns(F.col("u")).items()]).collect()
    assert [r["url"] for r in made] == [clients.jdbc_options(u, "t")["url"] for u in urls] and [r["user"] for r in made[:2]] == [clients.jdbc_options(u, "t")["user"] for u in urls[:2]]
    given = [{}, {"confidence_review": 0.9}, {"duplicate_merge": 0.6}, {"geo_review": 0.95}, {"geo_weights": (0.5, 0.6)}, {"confidence_accept": 1.5}, {"duplicate_candidate": 0.8}, {"bbox": (1.0, 2.0, None, 4.0)}, {"bbox": (1.0, 2.0, 3.0, 4.0)}, {"bbox": (1.0, 2.0)}]
    for g in given:
        try:
            replace(config.DEFAULT, **g)
            fine = True
        except ValueError:
            fine = False
        kinds = ", ".join(f"{k} {'array<double>' if isinstance(v, tuple) else 'double'}" for k, v in g.items()) or "x int"
        rows = spark.createDataFrame([tuple(list(v) if isinstance(v, tuple) else v for v in g.values()) or (1,)], kinds)
        assert (rows.select(config.contradictions(rows).alias("w")).first()["w"] == []) == fine


def test_requests_agree(spark):
    said = ["a b", "ñ/é&*~", "1+1=2?", "100% #x"]
    got = [r["u"] for r in spark.createDataFrame([(x,) for x in said], "q string").select(providers.request_column("locationiq", F.col("q"), key="K").alias("u")).collect()]
    assert got == [providers.request_url("locationiq", x, key="K") for x in said]


def test_open_run(spark):
    lock = Lock(spark, runtime.scratch(spark, "lock"))
    run = runs.open_run(lock, "a", "schedule", F.current_timestamp())
    with pytest.raises(runs.AlreadyRunning, match="a"):
        runs.open_run(lock, "b", "manual", F.current_timestamp())
    assert runs.close_run(lock, run, F.current_timestamp()).first()["status"] == "COMPLETED"
    assert runs.open_run(lock, "b", "manual", F.current_timestamp()).first()["execution_id"] == "b"
    assert runs.close_run(lock, run, F.current_timestamp(), "FAILED", "x").first()["error_message"] == "x" and lock.holder() == "b"


def test_told_numbers(spark):
    df = spark.createDataFrame([({consensus.COUNT_KEY: "4", consensus.DISTANCE_KEY: "x"},), ({},), (None,)], "m map<string,string>")
    assert [tuple(r) for r in df.select(consensus.told_count(F.col("m")), consensus.told_distance(F.col("m"))).collect()] == [(4, 0.0), (1, 0.0), (1, 0.0)]


def test_commands(spark, tmp_path, capsys):
    entries = [{"name": "A", "base_url": "https://a.example.com/feed", "adapter_type": "rss", "reliability_score": 0.5, "active": True}, {"name": "B", "base_url": "mailto:b"}, {"name": "A2", "base_url": "https://A.example.com/feed/", "adapter_type": "rss", "reliability_score": 0.6, "active": True}]
    (tmp_path / "c.json").write_text(json.dumps(entries))
    store = f"{tmp_path}/store"
    args = ["seed", "--catalog", f"{tmp_path}/c.json", "--store", store]
    assert cli.main([*args, "--dry-run"], spark) == 0 and not (tmp_path / "store").exists()
    cli.main(args, spark)
    assert [(r["name"], r["canonical_base_url"]) for r in cli.stored(spark, store)[0].collect()] == [("A2", "https://a.example.com/feed")]
    first = cli.stored(spark, store)[0].first()["source_id"]
    entries[2]["name"] = "A3"
    (tmp_path / "c.json").write_text(json.dumps(entries[2:]))
    cli.main(args, spark)
    assert [(r["name"], r["source_id"]) for r in cli.stored(spark, store)[0].collect()] == [("A3", first)]
    cli.main(["repair", "--store", store, "--dry-run"], spark)
    cli.main(["repair", "--store", store], spark)
    assert cli.stored(spark, store)[0].count() == 1
    cli.main(["empty", "--store", store], spark)
    assert cli.stored(spark, store)[0].count() == 0
    said = capsys.readouterr().out.splitlines()
    assert said[0].startswith("DRY_RUN configured=3") and said[1].startswith("BOOTSTRAP configured=3 inserted=1 updated=1") and said[2].startswith("BOOTSTRAP configured=1 inserted=0 updated=1")


def test_a_batch_that_broke_off_is_seen_whole(spark, tmp_path):
    """A crash between storing and what follows loses no post, and stores none twice."""
    landing, store, checkpoint = (f"{tmp_path}/{n}" for n in ("landing", "store", "checkpoint"))
    kinds = "source_id string, url string, raw_text string, ordinal long"
    posts = spark.createDataFrame([("s", "u", f"t{k % 5}", k) for k in range(8)], kinds)
    posts.write.parquet(landing)
    seen = []

    def breaks(new):
        raise RuntimeError("broke off")

    stream = lambda: cycle.posts_stream(spark, landing, posts.schema)
    with pytest.raises(Exception, match="broke off"):
        cycle.run_available(stream(), store, checkpoint, breaks)
    cycle.run_available(stream(), store, checkpoint, lambda new: seen.extend(r["raw_text"] for r in new.collect()))
    assert sorted(seen) == [f"t{k}" for k in range(5)]
    assert spark.read.parquet(store).count() == 5
    spark.createDataFrame([("s", "u", "t1", 9), ("s", "u", "t9", 10)], kinds).write.mode("append").parquet(landing)
    # Another checkpoint numbers its batches from zero again; nothing that is stored goes.
    cycle.run_available(stream(), store, f"{checkpoint}-2", lambda new: seen.extend(r["raw_text"] for r in new.collect()))
    assert sorted(seen) == ["t0", "t1", "t2", "t3", "t4", "t9"] and spark.read.parquet(store).count() == 6


def test_catalog_names_of_any_number(spark):
    """The best name from the threshold on is found however large the catalog is."""
    rng = random.Random(7)
    words = ["teatro", "plaza", "club", "san", "martin", "del", "lago", "ab", "x", "norte", "museo"]
    names = sorted({" ".join(rng.choices(words, k=rng.randrange(1, 4))) for _ in range(40)})
    place = lambda n: (n, n, [], "posadas", "misiones", "ar", -27.0, -55.0, "venue", True)

    def typo(x):
        k = rng.randrange(len(x) + 1)
        return rng.choice([x, x[:k] + "q" + x[k:], x[:k] + x[k + 1 :], " ".join(reversed(x.split())), x + " sur"])

    texts = sorted({typo(rng.choice(names)) for _ in range(60)} | {"zzz", "b a", "abxcd"} - {""})
    kinds = "name string, normalized_name string, aliases array<string>, city string, state string, country_code string, latitude double, longitude double, kind string, allowed boolean"
    for extra in ([], [f"zq{k} wv{k}" for k in range(5100)]):
        every = names + extra
        df = spark.createDataFrame([(k, *place(n)) for k, n in enumerate(every)], f"ordinal int, {kinds}")
        got = {r["key"]: (r["entry"]["name"], round(r["score"], 9)) for r in geoclassify.match_catalog(spark.createDataFrame([(t,) for t in texts], "text string"), df).collect()}
        keys = {r["k"] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(normalize_location(F.col("t")).alias("k")).collect()}
        known = [r["k"] for r in spark.createDataFrame([(k, n) for k, n in enumerate(names)], "o int, n string").orderBy("o").select(normalize_location(F.col("n")).alias("k")).collect()]
        want = {}
        for t in keys:
            score = lambda n: 1.0 if n == t else (similarity.weighted(t, n) * 0.5 + similarity.token_set(t, n) * 0.3 + similarity.token_sort(t, n) * 0.2) / 100  # noqa: B023, E731
            best = max(range(len(known)), key=lambda k: (known[k] == t, score(known[k]), -k))
            if score(known[best]) >= 0.85:
                want[t] = (names[best], round(score(known[best]), 9))
        assert got == want


def test_scratch(spark):
    path = runtime.scratch(spark, "gone")
    spark.range(3).write.parquet(path)
    runtime._written[:], kept = [path], runtime._written[:-1]
    assert runtime.clear_scratch(spark) == 1
    runtime._written.extend(kept)
    with pytest.raises(Exception):
        spark.read.parquet(path).count()
