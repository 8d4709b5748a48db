"""Queries on sources, runs, quality and the event API."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidewire.operators import event_api, quality, runs, source_admin
from tidewire.functions import text
from tidewire.runtime import table
from tidewire.sources import catalogs

from .registry import query
from .text_queries import _ADAPTER, _CANON
from .views import TABLES, view

# --- sources ---

_STORED = f"""entry AS (SELECT CAST(source_id AS BIGINT) AS ordinal, source_id, trim(name) AS name, trim(base_url) AS base_url, {_CANON} AS canonical, {_ADAPTER} AS adapter, active, reliability_score FROM v_source),
    stored AS (SELECT 'x' || source_id AS source_id, canonical, name, base_url, adapter, ordinal % 4 <> 1 AS active, reliability_score FROM (SELECT *, row_number() OVER (PARTITION BY canonical ORDER BY ordinal) AS n FROM entry WHERE canonical IS NOT NULL AND ordinal % 2 = 0) WHERE n = 1)"""


def _stored(spark, sf_dir):
    s = source_admin.catalog_actions(view(spark, sf_dir, "v_source").withColumn("ordinal", F.col("source_id").cast("long")), _no_sources(spark))
    first = Window.partitionBy("canonical_base_url").orderBy("ordinal")
    kept = s.filter("canonical_base_url is not null and ordinal % 2 = 0").withColumn("n", F.row_number().over(first)).filter("n = 1")
    return kept.select(F.concat(F.lit("x"), F.col("ordinal").cast("string")).alias("source_id"), "name", "base_url", "canonical_base_url", "adapter_type", (F.col("ordinal") % 4 != 1).alias("active"), "reliability_score", F.lit("catalog").alias("validation_status"), F.lit(None).cast("string").alias("discovered_from_url"))


def _no_sources(spark):
    return spark.createDataFrame([], "source_id string, name string, base_url string, canonical_base_url string, adapter_type string, active boolean, reliability_score double")


@query(
    "catalog_actions",
    f"""WITH {_STORED}, steps AS (SELECT e.*, lag(struct_pack(a := e.name, b := e.base_url, d := e.adapter, f := e.active, g := e.reliability_score)) OVER (PARTITION BY e.canonical ORDER BY e.ordinal) AS prev,
            CASE WHEN s.source_id IS NOT NULL THEN struct_pack(a := s.name, b := s.base_url, d := s.adapter, f := s.active, g := s.reliability_score) END AS old FROM entry e LEFT JOIN stored s ON e.canonical = s.canonical)
        SELECT ordinal, CASE WHEN canonical IS NULL THEN 'invalid' WHEN coalesce(prev, old) IS NULL THEN 'inserted' WHEN coalesce(prev, old) = struct_pack(a := name, b := base_url, d := adapter, f := active, g := reliability_score) THEN 'unchanged' ELSE 'updated' END AS action,
            canonical IS NOT NULL AND coalesce((coalesce(prev, old)).f AND NOT active, false) AS deactivated FROM steps""",
)
def catalog_actions(spark, sf_dir):
    """What loading a catalog inserts, updates, deactivates and leaves."""
    entries = view(spark, sf_dir, "v_source").withColumn("ordinal", F.col("source_id").cast("long"))
    return source_admin.catalog_actions(entries, _stored(spark, sf_dir)).select("ordinal", "action", "deactivated")


@query("catalog_counts", f"WITH {_STORED} SELECT count(*) AS configured, count(*) FILTER (canonical IS NULL) AS invalid FROM entry")
def catalog_counts(spark, sf_dir):
    entries = view(spark, sf_dir, "v_source").withColumn("ordinal", F.col("source_id").cast("long"))
    return source_admin.action_counts(source_admin.catalog_actions(entries, _stored(spark, sf_dir))).select("configured", "invalid")


@query(
    "repaired_sources",
    f"""WITH c AS (SELECT *, {_CANON} AS canonical FROM v_source), g AS (SELECT *, count(*) FILTER (active) OVER (PARTITION BY canonical) AS live, count(*) OVER (PARTITION BY canonical) AS everyone,
            row_number() OVER (PARTITION BY canonical ORDER BY active DESC, created_at, source_id) AS n FROM c)
        SELECT source_id, CASE WHEN canonical IS NULL THEN 'invalid' WHEN active AND live > 1 THEN CASE WHEN n = 1 THEN 'survivor' ELSE 'loser' END WHEN active AND base_url <> canonical THEN 'realign' WHEN live = 0 AND everyone > 1 THEN 'no_survivor' ELSE 'ok' END AS repair,
            active AND NOT (canonical IS NOT NULL AND live > 1 AND n > 1) AS active FROM g""",
)
def repaired_sources(spark, sf_dir):
    """Of active sources with one canonical url the oldest stays."""
    s = view(spark, sf_dir, "v_source").withColumn("canonical_base_url", F.col("base_url"))
    return source_admin.repair_duplicates(s).select("source_id", "repair", "active")


@query("canonical_backfill", "SELECT source_id, CASE WHEN row_number() OVER (PARTITION BY base_url ORDER BY created_at, source_id) = 1 THEN base_url END AS canonical_base_url FROM v_source")
def canonical_backfill(spark, sf_dir):
    return source_admin.canonical_backfill(view(spark, sf_dir, "v_source")).select("source_id", "canonical_base_url")


@query(
    "discovered_sources",
    """WITH f AS (SELECT DISTINCT 'https://d' || CAST(CAST(source_id AS BIGINT) % 15 AS VARCHAR) || '.example.com/feed' || CAST(k AS VARCHAR) AS canonical FROM v_source, range(0, 5) t(k))
       SELECT canonical AS canonical_base_url, 'Discovered feed - ' || substring(canonical, 9) AS name, 'discovered' AS validation_status, false AS active FROM f""",
)
def discovered_sources(spark, sf_dir):
    """New sources from feeds that pages name, five at most for each."""
    k = (F.col("source_id").cast("long") % 15).cast("string")
    found = view(spark, sf_dir, "v_source").select(F.col("base_url").alias("source_url"), F.transform(F.sequence(F.lit(0), F.lit(7)), lambda n: F.concat(F.lit("https://D"), k, F.lit(".example.com/feed"), n.cast("string"), F.lit("/"))).alias("feeds"))
    new, _ = source_admin.discovered(found, _stored(spark, sf_dir), 5)
    return new.select("canonical_base_url", "name", "validation_status", "active")


_NUMBER = "CAST(substring(source_id, 2) AS BIGINT)"


@query("discovered_marks", f"WITH {_STORED} SELECT source_id, 'https://page' || source_id || '.example.com' AS discovered_from_url, CASE WHEN {_NUMBER} % 3 = 0 THEN 'valid' ELSE 'discovered' END AS validation_status FROM stored WHERE {_NUMBER} % 4 = 2")
def discovered_marks(spark, sf_dir):
    """Inactive stored sources that a page names become discovered, unless a check said more of them."""
    n = F.substring("source_id", 2, 20).cast("long")
    stored = _stored(spark, sf_dir).withColumns({"active": n % 4 != 2, "validation_status": F.when(n % 3 == 0, "valid").otherwise("catalog")})
    found = stored.select(F.concat(F.lit("https://page"), "source_id", F.lit(".example.com")).alias("source_url"), F.array("canonical_base_url").alias("feeds"))
    return source_admin.discovered(found, stored, 5)[1].select("source_id", "discovered_from_url", "validation_status")


@query(
    "validated_sources",
    f"""WITH {_STORED} SELECT source_id, CASE WHEN CAST(substring(source_id, 2) AS BIGINT) % 3 = 0 THEN 'valid' ELSE 'catalog' END AS validation_status, CASE WHEN CAST(substring(source_id, 2) AS BIGINT) % 3 = 0 THEN 'https://final' END AS validation_final_url FROM stored""",
)
def validated_sources(spark, sf_dir):
    """Sources with the outcome of their last check."""
    none = F.lit(None).cast("string")
    stored = _stored(spark, sf_dir).withColumn("validation_error", none).withColumn("validation_final_url", none).withColumn("validation_checked_at", F.lit(None).cast("timestamp")).withColumn("last_reviewed_at", F.lit(None).cast("timestamp"))
    results = stored.filter("CAST(substring(source_id, 2) AS BIGINT) % 3 = 0").select("source_id", F.lit("valid").alias("status"), none.alias("error"), F.lit("https://final").alias("final_url"))
    return source_admin.record_validation(stored, results, F.lit("2026-01-01").cast("timestamp")).select("source_id", "validation_status", "validation_final_url")


@query(
    "patched_sources",
    "SELECT source_id, CASE WHEN CAST(source_id AS BIGINT) % 3 = 0 THEN 'renamed' ELSE name END AS name, CASE WHEN CAST(source_id AS BIGINT) % 3 = 0 THEN false ELSE active END AS active FROM v_source",
)
def patched_sources(spark, sf_dir):
    """Sources after partial updates: only given fields change."""
    s = view(spark, sf_dir, "v_source").select("source_id", "name", "active")
    patches = s.filter("CAST(source_id AS BIGINT) % 3 = 0").select("source_id", F.create_map(F.lit("name"), F.lit("renamed"), F.lit("active"), F.lit("false")).alias("changes"))
    return source_admin.patch(s, patches)


@query("check_counts", "SELECT count(*) FILTER (CAST(source_id AS BIGINT) % 4 <> 0) AS validated, count(*) FILTER (CAST(source_id AS BIGINT) % 4 = 0) AS invalid, CAST(count(*) FILTER (CAST(source_id AS BIGINT) % 4 <> 0) * 2 AS BIGINT) AS discovered, 7 AS inserted FROM v_source")
def check_counts(spark, sf_dir):
    ok = F.col("source_id").cast("long") % 4 != 0
    r = view(spark, sf_dir, "v_source").select(ok.alias("ok"), F.when(ok, F.array(F.lit("a"), F.lit("b"))).otherwise(F.array().cast("array<string>")).alias("feeds"))
    return source_admin.check_counts(r, F.lit(7))


@query("sources_page", "SELECT source_id, name FROM v_source ORDER BY reliability_score DESC, source_id LIMIT 20 OFFSET 3")
def sources_page(spark, sf_dir):
    return catalogs.page(view(spark, sf_dir, "v_source"), [F.desc("reliability_score"), F.col("source_id")], 20, 3).select("source_id", "name")


@query("active_sources", "SELECT source_id, reliability_score FROM v_source WHERE active")
def active_sources(spark, sf_dir):
    return catalogs.active_sources(view(spark, sf_dir, "v_source")).select("source_id", "reliability_score")


# --- event API ---

_LISTED = "status = 'ACTIVE' AND start_at >= TIMESTAMP '1997-01-01 00:00:00' AND start_at <= TIMESTAMP '1999-12-31 23:59:59' AND category = 'building' AND contains(upper(title), 'FEST')"


def _listed(spark, sf_dir):
    at = lambda t: F.lit(t).cast("timestamp")
    return event_api.matching(view(spark, sf_dir, "v_event"), at("1997-01-01 00:00:00"), at("1999-12-31 23:59:59"), "building", "fest")


@query("events_page", f"SELECT event_id, title, CAST(epoch(start_at) AS BIGINT) AS start_at FROM v_event WHERE {_LISTED} ORDER BY v_event.start_at, event_id LIMIT 10 OFFSET 10")
def events_page(spark, sf_dir):
    """The second page of a filtered list."""
    return event_api.page(_listed(spark, sf_dir), 2, 10).select("event_id", "title", F.unix_timestamp("start_at").alias("start_at"))


@query(
    "events_total",
    f"""SELECT count(*) AS total, greatest(1, CAST(ceil(count(*) / 1E1) AS BIGINT)) AS pages, CAST(CASE WHEN count(*) = 0 THEN 0 ELSE 11 END AS BIGINT) AS first_shown, CAST(least(count(*), 20) AS BIGINT) AS last_shown FROM v_event WHERE {_LISTED}""",
)
def events_total(spark, sf_dir):
    """The count before paging, and what a page shows of it."""
    n = _listed(spark, sf_dir).agg(F.count("*").alias("total"))
    return n.select("total", *event_api.page_summary(F.col("total"), F.lit(2), F.lit(10)))


@query("open_events", "SELECT event_id, status FROM v_event WHERE status IN ('ACTIVE', 'UPDATED')")
def open_events(spark, sf_dir):
    return catalogs.open_events(view(spark, sf_dir, "v_event")).select("event_id", "status")


@query(
    "events_with_primary",
    """WITH p AS (SELECT event_id, arg_min(source_url, struct_pack(a := contributed_at, b := source_url)) AS source_url, arg_min(source_id, struct_pack(a := contributed_at, b := source_url)) AS source_id FROM v_link WHERE is_primary GROUP BY event_id)
       SELECT e.event_id, p.source_url, s.name AS source_name FROM v_event e LEFT JOIN p ON e.event_id = p.event_id LEFT JOIN v_source s ON p.source_id = s.source_id WHERE e.status = 'ACTIVE'""",
)
def events_with_primary(spark, sf_dir):
    e = view(spark, sf_dir, "v_event").filter("status = 'ACTIVE'")
    return event_api.with_primary(e, view(spark, sf_dir, "v_link"), view(spark, sf_dir, "v_source")).select("event_id", "source_url", "source_name")


@query("detail_sources", "SELECT event_id, source_id, source_url, is_primary FROM (SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY is_primary DESC, contributed_at, source_url) AS n FROM v_link) WHERE n = 1")
def detail_sources(spark, sf_dir):
    return event_api.detail_source(view(spark, sf_dir, "v_link")).select("event_id", "source_id", "source_url", "is_primary")


@query("event_by_name", "SELECT event_id, slug FROM v_event WHERE event_id = '14' OR slug = '14'")
def event_by_name(spark, sf_dir):
    return event_api.lookup(view(spark, sf_dir, "v_event"), "14").select("event_id", "slug")


@query("event_categories", "SELECT DISTINCT category FROM v_event WHERE status = 'ACTIVE' AND category IS NOT NULL AND category <> ''")
def event_categories(spark, sf_dir):
    return event_api.categories(view(spark, sf_dir, "v_event"))


@query("featured_event", f"SELECT event_id, quality_score FROM v_event WHERE {_LISTED} ORDER BY quality_score DESC NULLS LAST, start_at, event_id LIMIT 1")
def featured_event(spark, sf_dir):
    return event_api.featured(_listed(spark, sf_dir)).select("event_id", "quality_score")


@query(
    "event_labels",
    """SELECT event_id, CASE status WHEN 'ACTIVE' THEN 'Activo' WHEN 'UPDATED' THEN 'Actualizado' ELSE 'Archivado' END AS label, CASE status WHEN 'ACTIVE' THEN 'success' WHEN 'UPDATED' THEN 'warning' ELSE 'danger' END AS variant,
        CASE WHEN regexp_matches(title, '(?i)m[úu]sica|recital|concierto|festival') THEN 'music' WHEN regexp_matches(title, '(?i)gastronom|food|feria') THEN 'food' ELSE 'default' END AS theme FROM v_event""",
)
def event_labels(spark, sf_dir):
    label, variant = event_api.status_label(F.col("status"))
    return view(spark, sf_dir, "v_event").select("event_id", label.alias("label"), variant.alias("variant"), event_api.theme(F.col("title")).alias("theme"))


# --- runs ---

_LATE = "TIMESTAMP '2024-01-10 00:00:00'"


@query("run_totals", "SELECT count(*) FILTER (status = 'RUNNING') AS running, count(*) FILTER (status = 'FAILED') AS failed, count(*) FILTER (status = 'PARTIAL') AS partial, CAST(sum(coalesce(items_collected, 0)) AS BIGINT) AS total_collected, CAST(sum(coalesce(items_failed, 0) + coalesce(events_rejected, 0)) AS BIGINT) AS total_excluded FROM v_run")
def run_totals(spark, sf_dir):
    return runs.dashboard(view(spark, sf_dir, "v_run"))


for _mode, _rank in (("recent", "started_at DESC"), ("failed", "CASE status WHEN 'FAILED' THEN 0 WHEN 'PARTIAL' THEN 1 WHEN 'RUNNING' THEN 2 ELSE 3 END"), ("running", "CASE status WHEN 'RUNNING' THEN 0 WHEN 'PARTIAL' THEN 1 WHEN 'FAILED' THEN 3 ELSE 2 END")):

    @query(f"runs_{_mode}", f"SELECT execution_id, status FROM v_run ORDER BY {_rank}, started_at DESC, execution_id LIMIT 50 OFFSET 20")
    def _runs(spark, sf_dir, mode=_mode):
        """A page of runs as the dashboard orders them."""
        return catalogs.page(view(spark, sf_dir, "v_run"), runs.shown(None, mode), 50, 20).select("execution_id", "status")


@query("runs_timed_out", f"SELECT execution_id FROM v_run WHERE status = 'RUNNING' AND started_at <= {_LATE} - INTERVAL '60' MINUTE")
def runs_timed_out(spark, sf_dir):
    return runs.timed_out(view(spark, sf_dir, "v_run"), F.expr(_LATE), 60).select("execution_id")


@query("runs_reaped", f"SELECT execution_id, CASE WHEN status = 'RUNNING' AND started_at <= {_LATE} - INTERVAL '60' MINUTE THEN 'FAILED' ELSE status END AS status, CASE WHEN status = 'RUNNING' AND started_at <= {_LATE} - INTERVAL '60' MINUTE THEN 'timed out' END AS error_message FROM v_run")
def runs_reaped(spark, sf_dir):
    return runs.reap(view(spark, sf_dir, "v_run"), F.expr(_LATE), 60).select("execution_id", "status", "error_message")


@query("running_runs", "SELECT execution_id FROM v_run WHERE status = 'RUNNING'")
def running_runs(spark, sf_dir):
    return runs.running(view(spark, sf_dir, "v_run")).select("execution_id")


@query(
    "run_states",
    "SELECT execution_id, CASE WHEN event_type_failed THEN 'FAILED' WHEN coalesce(items_failed, 0) > 0 THEN 'PARTIAL' ELSE 'COMPLETED' END AS final_status, CASE WHEN duration_ms < 1000 THEN CAST(CAST(trunc(duration_ms) AS BIGINT) AS VARCHAR) || ' ms' END AS short_duration FROM (SELECT *, status = 'FAILED' AS event_type_failed FROM v_run)",
)
def run_states(spark, sf_dir):
    error = F.when(F.col("status") == "FAILED", F.lit("broken"))
    r = view(spark, sf_dir, "v_run")
    return r.select("execution_id", runs.status(F.lit(0), F.col("items_failed"), error).alias("final_status"), F.when(F.col("duration_ms") < 1000, text.format_duration(F.col("duration_ms"))).alias("short_duration"))


@query(
    "run_details",
    """WITH s AS (SELECT CAST(l_orderkey % 1000 AS VARCHAR) AS execution_id, CAST(l_suppkey AS VARCHAR) AS source_id, CAST(l_linenumber AS BIGINT) AS items FROM lineitem)
       SELECT r.execution_id, r.status, coalesce(n, 0) AS sources, coalesce(items, 0) AS items FROM v_run r LEFT JOIN (SELECT execution_id, count(*) AS n, CAST(sum(items) AS BIGINT) AS items FROM s GROUP BY execution_id) x ON r.execution_id = x.execution_id""",
)
def run_details(spark, sf_dir):
    """Runs with what each source's part did."""
    parts = table(spark, sf_dir, "lineitem").select((F.col("l_orderkey") % 1000).cast("string").alias("execution_id"), F.col("l_suppkey").cast("string").alias("source_id"), F.lit("COMPLETED").alias("status"), F.col("l_linenumber").cast("long").alias("items_collected"), F.lit(0).alias("items_accepted"))
    d = runs.detail(view(spark, sf_dir, "v_run"), parts)
    return d.select("execution_id", "status", F.coalesce(F.size("sources"), F.lit(0)).cast("long").alias("sources"), F.coalesce(F.aggregate("sources", F.lit(0).cast("long"), lambda a, x: a + x["items_collected"]), F.lit(0)).alias("items")).withColumn("sources", F.greatest("sources", F.lit(0)))


@query("metrics_texts", """SELECT execution_id, '{"items_collected":' || CAST(coalesce(items_collected, 0) AS VARCHAR) || ',"events_rejected":' || CAST(events_rejected AS VARCHAR) || '}' AS metrics FROM v_run""")
def metrics_texts(spark, sf_dir):
    r = view(spark, sf_dir, "v_run").withColumn("items_collected", F.coalesce("items_collected", F.lit(0)))
    return r.select("execution_id", runs.metrics_json("items_collected", "events_rejected").alias("metrics"))


# --- quality ---

_COUNTS = "c AS (SELECT count(*) AS total, count(*) FILTER (expected_valid AND predicted_valid) AS tp, count(*) FILTER (NOT expected_valid AND NOT predicted_valid) AS tn, count(*) FILTER (NOT expected_valid AND predicted_valid) AS fp, count(*) FILTER (expected_valid AND NOT predicted_valid) AS fn, count(*) FILTER (decision = 'manual_review') AS rv, count(*) FILTER (provider IS NOT NULL) AS cv FROM v_label)"
_FIGURES = f"""{_COUNTS}, pr AS (SELECT *, coalesce(tp / nullif(CAST(tp + fp AS DOUBLE), 0), 0) AS p, coalesce(tp / nullif(CAST(tp + fn AS DOUBLE), 0), 0) AS r FROM c),
    f AS (SELECT total, coalesce((tp + tn) / nullif(CAST(total AS DOUBLE), 0), 0) AS accuracy, p AS precision, r AS recall, coalesce(2 * p * r / nullif(p + r, 0), 0) AS f1, coalesce(rv / nullif(CAST(total AS DOUBLE), 0), 0) AS review_rate, fp AS false_positives, fn AS false_negatives, coalesce(cv / nullif(CAST(total AS DOUBLE), 0), 0) AS geocoding_coverage FROM pr)"""


@query("quality_report", f"WITH {_FIGURES} SELECT total, round(accuracy, 9) AS accuracy, round(precision, 9) AS precision, round(recall, 9) AS recall, round(f1, 9) AS f1, round(review_rate, 9) AS review_rate, false_positives, false_negatives, round(geocoding_coverage, 9) AS geocoding_coverage FROM f")
def quality_report(spark, sf_dir):
    r = quality.report(view(spark, sf_dir, "v_label"))
    return r.select(*[F.round(c, 9).alias(c) if t == "double" else F.col(c) for c, t in r.dtypes])


@query("quality_markdown", f"""WITH {_FIGURES} SELECT '# Location quality' || chr(10) || '- total: ' || CAST(total AS VARCHAR) || chr(10) || '- accuracy: ' || printf('%.3f', accuracy) || chr(10) || '- precision: ' || printf('%.3f', precision) || chr(10) || '- recall: ' || printf('%.3f', recall) || chr(10) || '- f1: ' || printf('%.3f', f1) || chr(10) || '- review_rate: ' || printf('%.3f', review_rate) || chr(10) || '- geocoding_coverage: ' || printf('%.3f', geocoding_coverage) AS report FROM f""")
def quality_markdown(spark, sf_dir):
    return quality.as_markdown(quality.report(view(spark, sf_dir, "v_label")))


@query("quality_histogram", "SELECT count(*) FILTER (confidence < 5E-1) AS lt_0_50, count(*) FILTER (confidence >= 5E-1 AND confidence < 75E-2) AS ge_0_50_lt_0_75, count(*) FILTER (confidence >= 75E-2 AND confidence < 9E-1) AS ge_0_75_lt_0_90, count(*) FILTER (confidence >= 9E-1) AS ge_0_90 FROM v_label")
def quality_histogram(spark, sf_dir):
    return quality.histogram(view(spark, sf_dir, "v_label"))


@query("quality_by_provider", "SELECT coalesce(provider, 'unresolved') AS provider, count(*) AS total, count(*) FILTER (expected_valid = predicted_valid) AS correct, round(count(*) FILTER (expected_valid = predicted_valid) / CAST(count(*) AS DOUBLE), 9) AS accuracy FROM v_label GROUP BY 1")
def quality_by_provider(spark, sf_dir):
    return quality.by_provider(view(spark, sf_dir, "v_label")).withColumn("accuracy", F.round("accuracy", 9))


@query("quality_failures", f"""WITH {_FIGURES}, m AS (SELECT 'accuracy' AS metric, accuracy AS value, 8E-1 AS minimum FROM f UNION ALL SELECT 'precision', precision, 75E-2 FROM f UNION ALL SELECT 'recall', recall, 99E-2 FROM f UNION ALL SELECT 'f1', f1, 75E-2 FROM f UNION ALL SELECT 'geocoding_coverage', geocoding_coverage, 8E-1 FROM f)
    SELECT metric, round(value, 9) AS value, minimum, printf('%s=%.3f < %.3f', metric, value, minimum) AS message FROM m WHERE value < minimum""")
def quality_failures(spark, sf_dir):
    return quality.failures(quality.report(view(spark, sf_dir, "v_label")), {"recall": 0.99}).withColumn("value", F.round("value", 9))


@query("label_kinds", """SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN quality = 1 WHEN 1 THEN quality = 1 ELSE toxic = 1 END AS valid FROM labels""")
def label_kinds(spark, sf_dir):
    """Labels as an object, as a name, or as a flag."""
    k = F.col("doc_id") % 3
    rows = table(spark, sf_dir, "labels").select("doc_id", F.when(k == 0, F.to_json(F.struct((F.col("quality") == 1).alias("valid")))).alias("expected"), F.when(k == 1, F.when(F.col("quality") == 1, "provisional").otherwise("rejected")).alias("label"), F.when(k == 2, F.col("toxic") == 1).alias("flag"))
    return rows.select("doc_id", quality.expected_valid(F.col("expected"), F.col("label"), F.col("flag")).alias("valid"))


@query("duplicate_cases", "SELECT l_returnflag AS case_type, count(*) AS cases, count(*) FILTER ((l_linestatus = 'O') = (l_returnflag = 'N') AND 1 - l_discount >= 95E-2) AS ok FROM lineitem GROUP BY l_returnflag")
def duplicate_cases(spark, sf_dir):
    """Labelled pairs: is the decision as expected, and is the score enough."""
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("case_type"), F.when(F.col("l_linestatus") == "O", "MERGE").otherwise("REVIEW").alias("decision"), F.when(F.col("l_returnflag") == "N", "MERGE").otherwise("REVIEW").alias("expected_decision"), (1 - F.col("l_discount")).alias("score"), F.lit(0.95).alias("score_min"))
    return quality.duplicate_cases(rows).groupBy("case_type").agg(F.count("*").alias("cases"), F.count_if("ok").alias("ok"))


@query("table_names", "SELECT string_agg(n, ', ' ORDER BY n) AS names FROM (SELECT DISTINCT event_type AS n FROM events)")
def table_names(spark, sf_dir):
    return table(spark, sf_dir, "events").select(F.col("event_type").alias("n")).distinct().agg(F.expr("listagg(n, ', ') WITHIN GROUP (ORDER BY n)").alias("names"))


@query("ready", " UNION ALL ".join(f"SELECT '{t}' AS name, count(*) > 0 AS ok FROM {t}" for t in TABLES))
def ready(spark, sf_dir):
    """Readiness: every stored table answers and has rows."""
    return event_api.ready({t: table(spark, sf_dir, t) for t in TABLES})
