"""Queries on services around the engine: fetching, catalogs in files, models, providers, settings, waits, locks."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from tidewire import cli
from tidewire.config import contradictions, split_list
from tidewire.functions import text
from tidewire.operators import consensus, extract, runs
from tidewire.runtime import materialise, scratch, table
from tidewire.sources import catalogs, clients, database, fetch, providers, resilience
from tidewire.store import Lock, Versions

from .registry import query
from .views import NOW, view

# --- fetching over a transport that a table stands for ---

_KINDS = ("fine", "moved", "maze", "inward", "gone", "large", "slow", "broken")
_URL = "CASE WHEN page_id % 10 < 8 THEN 'https://w' || CAST(page_id AS STRING) || '.example.com/' || CAST(page_id % 10 AS STRING) WHEN page_id % 10 = 8 THEN 'http://10.0.0.' || CAST(page_id % 250 AS STRING) || '/x' WHEN page_id % 20 = 9 THEN 'ftp://example.com/x' ELSE NULL END"


def _answers(url: str) -> fetch.Response:
    """What stands at the urls of the query: one kind of behaviour for each last digit."""
    name = _KINDS[int(url.rstrip("/").rsplit("/", 1)[1])]
    if name == "slow":
        raise TimeoutError
    if name == "broken":
        raise ConnectionResetError
    if name == "gone":
        return fetch.Response(404, url)
    if name == "large":
        return fetch.Response(200, url, b"x" * 101)
    to = {"moved": url[:-1] + "0", "maze": url, "inward": "http://127.0.0.1/0"}.get(name)
    return fetch.Response(302, url, location=to) if to else fetch.Response(200, url, b"body", "text/html")


@query(
    "fetch_outcomes",
    f"""WITH u AS (SELECT page_id, {_URL} AS url FROM pages)
        SELECT page_id, CASE WHEN url IS NULL OR url LIKE 'ftp%' THEN 'invalid_url' ELSE ['ok', 'ok', 'too_many_redirects', 'blocked', 'invalid', 'too_large', 'timeout', 'invalid', 'blocked'][page_id % 10 + 1] END AS status,
            CASE WHEN url IS NULL OR url LIKE 'ftp%' THEN 'invalid_url' ELSE [NULL, NULL, 'too_many_redirects', 'unsafe_redirect', 'http_404', 'response_too_large', 'timeout', 'ConnectionResetError', 'unsafe_url'][page_id % 10 + 1] END AS error,
            CASE WHEN page_id % 10 < 2 THEN 4 ELSE 0 END AS n_bytes FROM u""",
)
def fetch_outcomes(spark, sf_dir):
    """What a guarded fetch of each url ends in: redirects, unsafe hops, sizes, errors."""
    wanted = table(spark, sf_dir, "pages").select("page_id", F.expr(_URL).alias("url"))
    found = fetch.fetch_all(wanted, _answers, most_bytes=100)
    return found.select("page_id", "status", "error", F.length("body").alias("n_bytes"))


# --- catalogs and labelled sets in files ---


def _file(rows, name):
    """Rows as one JSON list in a file; for catalogs, which are small."""
    path = scratch(rows.sparkSession, name)
    rows.agg(F.to_json(F.sort_array(F.collect_list(F.struct(*rows.columns)))).alias("value")).coalesce(1).write.text(path)
    return path


@query("catalog_file", "SELECT name, trim(base_url) AS base_url, active, round(reliability_score, 6) AS reliability_score FROM v_source")
def catalog_file(spark, sf_dir):
    """The source catalog, read from its file."""
    path = _file(view(spark, sf_dir, "v_source").select("name", "base_url", "adapter_type", "reliability_score", "active"), "catalog-file")
    return catalogs.read_sources(spark, path).select("name", F.trim("base_url").alias("base_url"), "active", F.round("reliability_score", 6).alias("reliability_score"))


@query("labelled_file", "SELECT 'case ' || n_name AS id, CASE WHEN n_regionkey % 2 = 0 THEN 'valid' ELSE 'typo' END AS case_type, n_regionkey > 1 AS valid FROM nation")
def labelled_file(spark, sf_dir):
    """A labelled set, read from its file."""
    n = table(spark, sf_dir, "nation")
    rows = n.select(F.concat(F.lit("case "), "n_name").alias("id"), F.when(F.col("n_regionkey") % 2 == 0, "valid").otherwise("typo").alias("case_type"), F.struct((F.col("n_regionkey") > 1).alias("valid")).alias("expected"))
    return catalogs.read_labelled(spark, _file(rows, "labelled-file"), "id string, case_type string, expected struct<valid:boolean>").select("id", "case_type", "expected.valid")


# --- models ---

_POST = "raw_text IS NOT NULL AND raw_text <> ''"


@query("prompts", "SELECT ordinal, 'Read.' || chr(10) || chr(10) || 'Date: 2026-01-02' || chr(10) || '<post>' || chr(10) || raw_text || chr(10) || '</post>' AS prompt FROM v_raw")
def prompts(spark, sf_dir):
    """What a model is asked about each post."""
    return view(spark, sf_dir, "v_raw").select("ordinal", extract.prompt(F.col("raw_text"), F.lit("2026-01-02"), "Read.").alias("prompt"))


@query(
    "asked_answers",
    """SELECT ordinal, CASE WHEN length(coalesce(raw_text, '')) % 7 <> 0 THEN '{"is_event": ' || CASE WHEN length(coalesce(raw_text, '')) % 2 = 0 THEN 'true' ELSE 'false' END || ', "date": "1998-06-01T12:00:00"}' END AS answer,
        CASE WHEN length(coalesce(raw_text, '')) % 7 = 0 THEN 'ValueError: no answer' END AS answer_error FROM v_raw""",
)
def asked_answers(spark, sf_dir):
    """A model's answers; one that fails leaves an error and stops no other."""

    def model(said: str, date: str) -> str:
        if len(said) % 7 == 0:
            raise ValueError("no answer")
        return json.dumps({"is_event": len(said) % 2 == 0, "date": date})

    posts = view(spark, sf_dir, "v_raw").select("ordinal", "raw_text", F.expr(NOW).alias("fetched_at"))
    return extract.ask(posts, model).select("ordinal", "answer", "answer_error")


@query("classified", "SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN 'accepted' WHEN 1 THEN o_orderpriority WHEN 2 THEN 'waited' END AS decision, CASE WHEN o_orderkey % 4 = 3 THEN 'TypeError' END AS error FROM orders")
def classified(spark, sf_dir):
    """Classifiers that return a mapping, an object, something to wait for, or nothing of use, over all orders."""

    class Said:
        def __init__(self, decision):
            self.decision = decision

        def as_dict(self):
            return {"decision": self.decision}

    async def waits():
        return {"decision": "waited"}

    kinds = (lambda _: {"decision": "accepted"}, lambda r: Said(r["o_orderpriority"]), lambda _: waits(), lambda _: "accepted")
    rows = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority")
    found = clients.classify(rows, lambda r: kinds[r["o_orderkey"] % 4](r), "decision string")
    return found.select("o_orderkey", "decision", F.col("classifier_error").alias("error"))


@query("image_texts", "SELECT s_suppkey, CAST(NULL AS VARCHAR) AS said, 'NotConfigured' AS error FROM supplier")
def image_texts(spark, sf_dir):
    """Text recognition is a service that none has: an error for each image."""

    def read(url: str, date: str) -> str:
        return clients.read_image(url)

    images = table(spark, sf_dir, "supplier").select("s_suppkey", F.col("s_name").alias("raw_text"), F.expr(NOW).alias("fetched_at"))
    return extract.ask(images, read).select("s_suppkey", F.col("answer").alias("said"), F.regexp_extract("answer_error", r"^\w+", 0).alias("error"))


# --- providers ---


@query(
    "provider_requests",
    """SELECT place_id, 'https://nominatim.openstreetmap.org/search?q=' || url_encode(place) || '&format=jsonv2&addressdetails=1&limit=5&countrycodes=ar' AS nominatim,
        'https://api.geoapify.com/v1/geocode/search?text=' || url_encode(place) || '&limit=5&filter=countrycode%3Aar&apiKey=K' AS geoapify FROM v_place WHERE place IS NOT NULL""",
)
def provider_requests(spark, sf_dir):
    """The urls that ask providers for each place."""
    p = view(spark, sf_dir, "v_place").filter("place is not null")
    return p.select("place_id", *[providers.request_column(n, F.col("place"), key=k).alias(n) for n, k in (("nominatim", None), ("geoapify", "K"))])


_NAMED = "CASE c_custkey % 4 WHEN 0 THEN 'locationiq,nominatim,geoapify' WHEN 1 THEN 'nominatim,geoapify' WHEN 2 THEN 'geoapify' ELSE '' END"


@query(
    "provider_chain",
    f"""SELECT c_custkey, array_to_string(list_filter(string_split({_NAMED}, ','), lambda n: n = 'nominatim' OR (n = 'locationiq' AND c_custkey % 3 = 1) OR (n = 'geoapify' AND c_custkey % 5 > 1)), ',') AS chain FROM customer""",
)
def provider_chain(spark, sf_dir):
    """Providers in the order that each customer configured, those without a key left out."""
    k = F.col("c_custkey")
    keys = F.when(k % 7 == 0, F.create_map(F.lit("locationiq"), F.when(k % 3 == 1, "a"), F.lit("geoapify"), F.when(k % 5 > 1, "b"))).otherwise(F.create_map(F.lit("locationiq"), F.when(k % 3 == 1, "a").otherwise(""), F.lit("geoapify"), F.when(k % 5 > 1, "b").otherwise("")))
    return table(spark, sf_dir, "customer").select("c_custkey", F.array_join(providers.chain(F.split(F.expr(_NAMED), ","), keys), ",").alias("chain"))


@query(
    "cluster_numbers",
    "SELECT c_custkey, CASE c_custkey % 5 WHEN 0 THEN 3 WHEN 4 THEN 12 ELSE 1 END AS providers, CASE c_custkey % 5 WHEN 0 THEN CAST(12.5 AS DOUBLE) WHEN 1 THEN -1 WHEN 4 THEN 1000 ELSE 0 END AS max_distance_m FROM customer",
)
def cluster_numbers(spark, sf_dir):
    """Numbers of a cluster that providers' metadata tell as text; what is no number counts as 1 and 0."""
    k = F.col("c_custkey") % 5
    said = lambda *xs: F.get(F.array(*[F.lit(x) for x in xs]), k.cast("int"))
    meta = F.create_map(F.lit(consensus.COUNT_KEY), said("3", "-2", None, "2.0", "12"), F.lit(consensus.DISTANCE_KEY), said("12.5", "-1", "far", None, "1e3"))
    return table(spark, sf_dir, "customer").select("c_custkey", consensus.told_count(meta).alias("providers"), consensus.told_distance(meta).alias("max_distance_m"))


# --- settings ---


_SETTINGS = {"confidence_review": "(o_orderkey % 8) / 1E1", "confidence_accept": "(o_orderkey % 13) / 1E1", "duplicate_candidate": "5E-1", "duplicate_review": "(o_orderkey % 5 + 4) / 1E1", "duplicate_merge": "(o_orderkey % 3 + 7) / 1E1", "geo_reject": "(o_orderkey % 6) / 1E1", "geo_review": "6E-1", "geo_accept": "(o_orderkey % 7 + 4) / 1E1"}


@query(
    "settings_checked",
    f"""SELECT o_orderkey, concat_ws(',', CASE WHEN confidence_accept > 1 THEN 'shares' END, CASE WHEN confidence_review > confidence_accept THEN 'confidence' END, CASE WHEN duplicate_candidate > duplicate_review OR duplicate_review > duplicate_merge THEN 'duplicates' END,
        CASE WHEN geo_reject > geo_review OR geo_review > geo_accept THEN 'location' END, CASE WHEN o_orderkey % 11 = 1 THEN 'box' END, CASE WHEN o_orderkey % 9 = 4 THEN 'weights' END) AS wrong FROM (SELECT o_orderkey, {", ".join(f"{e} AS {n}" for n, e in _SETTINGS.items())} FROM orders)""",
)
def settings_checked(spark, sf_dir):
    """Which of many settings contradict themselves, and in what."""
    k = F.col("o_orderkey")
    box = F.when(k % 11 == 0, F.array(F.lit(1.0), F.lit(2.0), F.lit(3.0), F.lit(4.0))).when(k % 11 == 1, F.array(F.lit(1.0), F.lit(2.0), F.lit(None).cast("double"), F.lit(4.0)))
    weights = F.when(k % 9 == 4, F.array(F.lit(0.5), F.lit(0.6))).otherwise(F.array(F.lit(0.25), F.lit(0.75)))
    rows = table(spark, sf_dir, "orders").select("o_orderkey", *[F.expr(e).alias(n) for n, e in _SETTINGS.items()], box.alias("bbox"), weights.alias("geo_weights"))
    return rows.select("o_orderkey", F.array_join(contradictions(rows), ",").alias("wrong"))


_LISTED = "CASE place_id % 4 WHEN 0 THEN NULL WHEN 1 THEN ' ,, ' WHEN 2 THEN 'Nominatim, GEOAPIFY ,' ELSE 'a' || CAST(place_id AS STRING) || ',B' END"


@query("setting_lists", f"SELECT place_id, list_filter(list_transform(string_split({_LISTED}, ','), lambda x: lower(trim(x))), lambda x: x <> '')::VARCHAR AS parts FROM v_place")
def setting_lists(spark, sf_dir):
    """Comma-separated settings, trimmed, folded, without blanks; the column and the plain form agree."""
    rows = view(spark, sf_dir, "v_place").select("place_id", F.expr(_LISTED).alias("given"))
    assert split_list("Nominatim, GEOAPIFY ,") == ("nominatim", "geoapify")
    return rows.select("place_id", F.concat(F.lit("["), F.array_join(text.split_list(F.col("given")), ", "), F.lit("]")).alias("parts"))


@query("connection_settings", "SELECT 'jdbc:postgresql://db' || CAST(n_nationkey AS VARCHAR) || ':' || CASE WHEN n_nationkey % 2 = 0 THEN '5433' ELSE '5432' END || '/tidewire' AS url, 'u' || CAST(n_nationkey AS VARCHAR) AS user FROM nation")
def connection_settings(spark, sf_dir):
    """Where the stored tables are: a given database url, or one made of its parts, as options of Spark's reader."""
    k = F.col("n_nationkey").cast("string")
    given = F.when(F.col("n_nationkey") % 2 == 0, F.concat(F.lit("postgres://u"), k, F.lit(":p@db"), k, F.lit(":5433/tidewire"))).otherwise(F.concat(F.lit("postgres://u"), k, F.lit(":p@db"), k, F.lit("/tidewire")))
    return table(spark, sf_dir, "nation").select(*[c.alias(n) for n, c in clients.jdbc_columns(given).items()])


@query("database_orders", "SELECT o_orderkey, CAST(o_orderdate AS DATE) AS o_orderdate, round(o_totalprice, 2) AS o_totalprice FROM orders WHERE o_orderstatus = 'F'")
def database_orders(spark, sf_dir):
    """All orders written into a database and read back by eight connections, those that are done by a filter in the database.

    The database is a file in shared scratch that the driver and all executors open; a server's url takes its place on
    a cluster of several machines.
    """
    url = f"{database.SCHEME}{scratch(spark, 'orders-database')}"
    rows = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice", F.col("o_orderdate").cast("date").alias("o_orderdate"))
    clients.write_table(rows, url, "ORDERS")
    found = clients.read_parts(spark, url, "ORDERS", "o_orderkey", 8).filter("o_orderstatus = 'F'")
    return found.select("o_orderkey", "o_orderdate", F.round("o_totalprice", 2).alias("o_totalprice"))


# --- waits ---


@query("retry_waits", "SELECT event_id, CASE event_id % 5 WHEN 0 THEN 3 WHEN 1 THEN 0 WHEN 4 THEN CAST(1.5 AS DOUBLE) END AS seconds FROM events")
def retry_waits(spark, sf_dir):
    """How long a server asks to wait."""
    said = F.get(F.array(*[F.lit(x) for x in ("3", "-2", "soon", None, "1.5")]), (F.col("event_id") % 5).cast("int"))
    return table(spark, sf_dir, "events").select("event_id", text.retry_after(said).alias("seconds"))


@query("backoff_waits", "SELECT event_id, round(0.5 * pow(2, event_id % 6) + (user_id % 10) / 10.0 * 0.25, 9) AS seconds FROM events")
def backoff_waits(spark, sf_dir):
    """How long a client waits before a repeated attempt."""
    draw = (F.col("user_id") % 10) / 10.0
    return table(spark, sf_dir, "events").select("event_id", F.round(resilience.backoff(F.col("event_id") % 6, 0.5, 0.25, draw), 9).alias("seconds"))


@query(
    "spaced_calls",
    """WITH RECURSIVE c AS (SELECT user_id, event_id, CAST(floor(epoch(ts)) AS DOUBLE) AS asked, row_number() OVER (PARTITION BY user_id ORDER BY floor(epoch(ts)), event_id) AS n FROM events),
        walk AS (SELECT user_id, event_id, n, asked AS starts_at FROM c WHERE n = 1
            UNION ALL SELECT c.user_id, c.event_id, c.n, greatest(c.asked, walk.starts_at + 3600) FROM walk JOIN c ON c.user_id = walk.user_id AND c.n = walk.n + 1)
        SELECT event_id, starts_at FROM walk""",
)
def spaced_calls(spark, sf_dir):
    """When calls may start that must keep an hour apart, service by service."""
    calls = table(spark, sf_dir, "events").select("user_id", "event_id", F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).cast("double").alias("at"))
    return resilience.spaced(calls, 3600.0, "user_id").select("event_id", "starts_at")


@query("guarded_calls")
def guarded_calls(spark, sf_dir):
    """Which calls a breaker lets through; the tests hold it against a plain one."""
    calls = table(spark, sf_dir, "events").select(F.col("user_id").alias("service"), F.unix_seconds(F.col("ts").cast("timestamp")).cast("double").alias("at"), (F.col("event_type") != "error").alias("ok"))
    return resilience.guarded(calls, 2, 36_000.0).groupBy("service", "allowed").agg(F.count("*").alias("n"))


# --- locks and commands ---


@query("run_locks", "SELECT 'as it is' AS \"case\", count(*) FILTER (status = 'RUNNING') = 0 AS opened, CASE WHEN count(*) FILTER (status = 'RUNNING') = 0 THEN 'RUNNING' END AS status FROM v_run UNION ALL SELECT 'all ended', true, 'RUNNING'")
def run_locks(spark, sf_dir):
    """A run opens only while no other holds the lock, as a run does that the log says is running."""
    log = view(spark, sf_dir, "v_run")
    rows = []
    for name, known in (("as it is", log), ("all ended", log.filter("status <> 'RUNNING'"))):
        lock, holder = Lock(spark, scratch(spark, "run-lock")), runs.running(known).agg(F.min("execution_id")).first()[0]
        if holder is not None:
            runs.open_run(lock, holder, "schedule", F.expr(NOW))
        try:
            rows.append((name, True, runs.open_run(lock, "new", "manual", F.expr(NOW)).first()["status"]))
        except runs.AlreadyRunning:
            rows.append((name, False, None))
    return spark.createDataFrame(rows, "case string, opened boolean, status string")


@query("emptied_tables", "SELECT 'region' AS name, count(*) AS rows_before, 0 AS rows_after FROM region UNION ALL SELECT 'nation', count(*), 0 FROM nation")
def emptied_tables(spark, sf_dir):
    """Stored tables before and after they are emptied."""
    paths = {}
    for name in ("region", "nation"):
        paths[path := scratch(spark, f"emptied-{name}")] = name
        Versions(spark, path).commit(table(spark, sf_dir, name))
    return spark.createDataFrame([(paths[p], a, b) for p, a, b in cli.empty(spark, list(paths))], "name string, rows_before long, rows_after long")


@query("seeded_twice", "SELECT * FROM (VALUES ('dry', true, true), ('first', true, false), ('again', true, true)) t(step, ok, same_rows)")
def seeded_twice(spark, sf_dir):
    """The seed command: a dry run writes nothing, a second run of the same catalog changes nothing."""
    one = view(spark, sf_dir, "v_source").groupBy("base_url").agg(F.min_by(F.struct("name", "adapter_type", "reliability_score", "active"), "source_id").alias("x")).select("x.name", "base_url", "x.adapter_type", "x.reliability_score", "x.active")
    path, store = _file(materialise(one, "seed-entries"), "seed-file"), scratch(spark, "seed-store")
    rows, before = [], 0
    for step in ("dry", "first", "again"):
        said = cli.seed(spark, path, store, step == "dry")
        after = cli.stored(spark, store)[0].count()
        rows.append((step, said.startswith("DRY_RUN" if step == "dry" else "BOOTSTRAP"), after == before))
        before = after
    return spark.createDataFrame(rows, "step string, ok boolean, same_rows boolean")
