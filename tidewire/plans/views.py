"""The engine's tables as views over the general tables, in SQL that Spark and DuckDB both run."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from tidewire.runtime import table

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")
NOW = "TIMESTAMP '1998-06-01 12:00:00'"
_MONTHS = "CASE EXTRACT(MONTH FROM o_orderdate) " + " ".join(f"WHEN {k} THEN '{m}'" for k, m in enumerate(("enero", "febrero", "marzo", "abril", "mayo", "junio", "julio", "agosto", "septiembre", "octubre", "noviembre", "diciembre"), 1)) + " END"
_DAY, _YEAR = "CAST(EXTRACT(DAY FROM o_orderdate) AS STRING)", "CAST(EXTRACT(YEAR FROM o_orderdate) AS STRING)"
_K = "CAST(o_orderkey % 90 AS STRING)"

VIEWS = {
    # posts: a document is what a source published
    "v_raw": "SELECT source AS source_id, 'https://' || source || '.example.com/' || CAST(doc_id % 97 AS STRING) AS url, text AS raw_text, doc_id AS ordinal FROM {documents}",
    # notices in Spanish, with dates of every form
    "v_notice": f"""
        SELECT o_orderkey AS notice_id, CAST(o_orderdate AS TIMESTAMP) - INTERVAL '10' DAY AS anchor,
            CASE o_orderkey % 10
            WHEN 0 THEN 'Recital de la orquesta ' || {_K} || chr(10) || 'El ' || {_DAY} || ' de ' || {_MONTHS} || ' de ' || {_YEAR} || ' a las 21:30 en Posadas. Será en el Teatro Lírico, con entradas a la venta.'
            WHEN 1 THEN '  ' || chr(10) || 'Muestra de arte ' || {_K} || chr(10) || 'Del 3 al 9 de ' || {_MONTHS} || ' de ' || {_YEAR} || '. Ubicado en Bolívar ' || {_K} || ', centro.'
            WHEN 2 THEN 'Taller ' || {_K} || ': este sábado a las 20. Dirección: Av. Mitre ' || {_K}
            WHEN 3 THEN 'Inscripciones abiertas hasta el ' || {_DAY} || ' de ' || {_MONTHS} || ' para el curso ' || {_K}
            WHEN 4 THEN 'Ciclo de cine en ' || {_MONTHS} || '. Se presentará en el Espacio ' || {_K} || '; gratis.'
            WHEN 5 THEN 'Fiesta popular ' || {_K} || ' el próximo viernes a las 9:05. Será en la Plaza 9 de Julio'
            WHEN 6 THEN 'Entre el 12 y el 15 habrá feria ' || {_K} || ' en ' || {_MONTHS} || ' ' || {_YEAR}
            WHEN 7 THEN 'Aviso número ' || {_K} || ' sin fecha'
            WHEN 8 THEN 'El ' || {_DAY} || ' de ' || {_MONTHS} || ', a las 25:75, obra de teatro ' || {_K}
            ELSE 'Desde el 28 hasta el 31 de ' || {_MONTHS} || ': función ' || {_K}
            END AS raw_text
        FROM {{orders}}""",
    # candidates of one cycle
    "v_candidate": """
        SELECT CAST(o_orderkey AS STRING) AS candidate_id, 's' || CAST(c_nationkey AS STRING) AS source_id, CAST(o_orderkey % 500 AS STRING) AS classification_id,
            o_orderkey % 19 <> 0 AS is_event, 4E-1 + (o_orderkey % 60) / 1E2 AS confidence,
            CASE o_orderkey % 23 WHEN 0 THEN NULL WHEN 1 THEN ' ' ELSE (CASE o_orderkey % 4 WHEN 0 THEN 'Festival ' WHEN 1 THEN 'Noche de ' WHEN 2 THEN 'Feria ' ELSE 'Taller de ' END) || lower(c_mktsegment) || ' ' || CAST(c_nationkey AS STRING) END AS title,
            CASE o_orderkey % 29 WHEN 0 THEN NULL ELSE 'Sala ' || CAST(c_nationkey AS STRING) END AS venue_name,
            CASE o_orderkey % 5 WHEN 0 THEN NULL ELSE 'Calle ' || CAST(c_custkey % 40 AS STRING) || ', Posadas' END AS address,
            CASE o_orderkey % 31 WHEN 0 THEN NULL ELSE CAST(o_orderdate AS TIMESTAMP) END AS start_at,
            CASE o_orderkey % 6 WHEN 0 THEN CAST(o_orderdate AS TIMESTAMP) - INTERVAL '1' DAY WHEN 1 THEN CAST(o_orderdate AS TIMESTAMP) + INTERVAL '2' DAY ELSE NULL END AS end_at,
            CASE o_orderkey % 7 WHEN 0 THEN NULL ELSE -2.73671E1 + (c_custkey % 50 - 25) / 1E2 END AS latitude,
            CASE o_orderkey % 7 WHEN 0 THEN NULL ELSE -5.58961E1 + (c_custkey % 40 - 20) / 1E2 END AS longitude,
            CASE o_orderkey % 37 WHEN 0 THEN NULL WHEN 1 THEN 'http://localhost/x' WHEN 2 THEN 'http://10.1.2.3/x' WHEN 3 THEN 'ftp://example.com/x' ELSE 'https://source' || CAST(c_nationkey AS STRING) || '.example.com/n/' || CAST(o_orderkey AS STRING) END AS source_url,
            CASE o_orderkey % 3 WHEN 0 THEN 'PENDING_REVIEW' ELSE 'GEOLOCATED' END AS processing_status,
            CASE o_orderkey % 8 WHEN 0 THEN NULL ELSE 'about ' || o_orderpriority END AS description,
            CASE o_orderkey % 9 WHEN 0 THEN '' ELSE '$ ' || CAST(o_orderkey % 9 AS STRING) || '00' END AS price_text,
            CASE o_orderkey % 10 WHEN 0 THEN NULL ELSE lower(c_mktsegment) END AS category, CAST(NULL AS STRING) AS recurrence_text
        FROM {orders} JOIN {customer} ON o_custkey = c_custkey""",
    # stored events
    "v_event": """
        SELECT CAST(o_orderkey AS STRING) AS event_id, 'festival-' || lower(c_mktsegment) || '-' || CAST(o_orderkey AS STRING) AS slug,
            (CASE o_orderkey % 4 WHEN 0 THEN 'Festival ' WHEN 1 THEN 'Noche de ' WHEN 2 THEN 'Feria ' ELSE 'Taller de ' END) || lower(c_mktsegment) || ' ' || CAST(c_nationkey AS STRING) AS title,
            CASE o_orderkey % 2 WHEN 0 THEN NULL ELSE 'about ' || o_orderpriority END AS description,
            CAST(o_orderdate AS TIMESTAMP) + INTERVAL '3' HOUR AS start_at,
            CASE o_orderkey % 3 WHEN 0 THEN CAST(o_orderdate AS TIMESTAMP) + INTERVAL '2' DAY ELSE NULL END AS end_at,
            CAST(NULL AS STRING) AS recurrence_text, 'Sala ' || CAST(c_nationkey AS STRING) AS venue_name,
            CASE o_orderkey % 5 WHEN 0 THEN NULL WHEN 1 THEN '' ELSE 'Calle ' || CAST(c_custkey % 40 AS STRING) || ', Posadas' END AS address,
            CASE o_orderkey % 4 WHEN 0 THEN NULL ELSE CAST(-2.73671E1 + (c_custkey % 50 - 25) / 1E2 AS DECIMAL(9, 6)) END AS latitude,
            CASE o_orderkey % 4 WHEN 0 THEN NULL ELSE CAST(-5.58961E1 + (c_custkey % 40 - 20) / 1E2 AS DECIMAL(9, 6)) END AS longitude,
            CAST(NULL AS STRING) AS price_text, CASE o_orderkey % 11 WHEN 0 THEN NULL WHEN 1 THEN '' ELSE lower(c_mktsegment) END AS category,
            (o_orderkey % 100) / 1E2 AS quality_score, CASE o_orderstatus WHEN 'O' THEN 'ACTIVE' WHEN 'P' THEN 'UPDATED' ELSE 'ARCHIVED' END AS status
        FROM {orders} JOIN {customer} ON o_custkey = c_custkey""",
    # which sources told of which event
    "v_link": """
        SELECT CAST(l_orderkey AS STRING) AS event_id, CAST(l_suppkey AS STRING) AS source_id, 'https://s' || CAST(l_suppkey AS STRING) || '.example.com/' || CAST(l_linenumber AS STRING) AS source_url,
            l_linenumber = 2 AS is_primary, CAST(l_shipdate AS TIMESTAMP) AS contributed_at
        FROM {lineitem}""",
    # decisions of sources
    "v_decision": """
        SELECT CASE WHEN l_suppkey % 50 = 0 THEN NULL ELSE CAST(l_suppkey AS STRING) END AS source_id, 1 - l_discount AS confidence, l_orderkey, l_linenumber,
            CASE WHEN l_returnflag = 'A' AND l_linestatus = 'F' THEN 'ACCEPT' WHEN l_returnflag = 'A' THEN 'MERGE' WHEN l_returnflag = 'N' THEN 'REJECT' ELSE 'REVIEW' END AS decision
        FROM {lineitem}""",
    "v_source": """
        SELECT CAST(s_suppkey AS STRING) AS source_id, s_name AS name, s_suppkey % 6 <> 0 AS active, 5E-1 + 4E-2 * (s_suppkey % 10) AS reliability_score,
            CASE s_suppkey % 5 WHEN 0 THEN 'HTTPS://Site' || CAST(s_suppkey % 20 AS STRING) || '.Example.com:443/feed/' WHEN 1 THEN 'http://site' || CAST(s_suppkey % 20 AS STRING) || '.example.com:8080/a;x?b=2&utm_source=t&a=1'
                WHEN 2 THEN 'https://user@site' || CAST(s_suppkey % 20 AS STRING) || '.example.com#top' WHEN 3 THEN 'mailto:site' || CAST(s_suppkey AS STRING) ELSE '  https://site' || CAST(s_suppkey % 20 AS STRING) || '.example.com/feed ' END AS base_url,
            CASE s_suppkey % 7 WHEN 0 THEN ' RSS_feed' WHEN 1 THEN 'atom' WHEN 2 THEN 'static' WHEN 3 THEN 'Scrapy_Static' WHEN 4 THEN 'rss' WHEN 5 THEN 'facebook' ELSE 'html' END AS adapter_type,
            TIMESTAMP '2026-01-01 00:00:00' + CAST(s_suppkey * 37 % 11 AS INT) * INTERVAL '1' DAY AS created_at
        FROM {supplier}""",
    # providers' candidates
    "v_geo": """
        SELECT 'q' || CAST(c_custkey % 1000 AS STRING) AS query, CASE c_custkey % 3 WHEN 0 THEN 'nominatim' WHEN 1 THEN 'locationiq' ELSE 'geoapify' END AS provider, CAST(c_custkey AS INT) AS ordinal,
            'Place ' || CAST(c_custkey % 1000 AS STRING) AS display_name, 'place ' || CAST(c_custkey % 1000 AS STRING) AS normalized_name,
            -2.73671E1 + (c_custkey % 1000) / 1E4 + c_nationkey / 2E4 AS latitude, -5.58961E1 + (c_custkey % 300) / 3E3 AS longitude,
            CASE c_custkey % 9 WHEN 0 THEN 'py' WHEN 1 THEN NULL ELSE 'AR' END AS country_code, CASE c_custkey % 4 WHEN 0 THEN 'Provincia de Misiones' WHEN 1 THEN 'Misiones' ELSE NULL END AS state,
            CASE c_custkey % 5 WHEN 0 THEN 'Posadas' WHEN 1 THEN 'Gran Posadas' WHEN 2 THEN 'Garupá' ELSE NULL END AS city, 'street' AS precision,
            (c_custkey % 11) / 1E1 AS importance, CASE c_custkey % 6 WHEN 0 THEN 0E0 WHEN 1 THEN NULL ELSE (c_custkey % 13) / 1.2E1 END AS confidence
        FROM {customer}""",
    # labelled decisions
    "v_label": """
        SELECT d.doc_id, l.quality = 1 AS expected_valid, d.n_chars % 5 <> 0 AS predicted_valid, CASE WHEN d.n_chars % 5 = 0 THEN 'manual_review' ELSE 'accepted' END AS decision,
            CASE d.doc_id % 4 WHEN 0 THEN NULL WHEN 1 THEN 'catalog' ELSE 'nominatim' END AS provider, (d.n_chars % 100) / 1E2 AS confidence
        FROM {documents} d JOIN {labels} l ON d.doc_id = l.doc_id""",
    # runs of cycles
    "v_run": """
        SELECT CAST(event_id AS STRING) AS execution_id, CASE event_type WHEN 'error' THEN 'FAILED' WHEN 'click' THEN 'PARTIAL' WHEN 'signup' THEN 'RUNNING' ELSE 'COMPLETED' END AS status,
            CAST(ts AS TIMESTAMP) AS started_at, CASE WHEN event_id % 5 = 0 THEN NULL ELSE CAST(user_id AS BIGINT) END AS items_collected, CASE WHEN event_id % 3 = 0 THEN NULL ELSE event_id % 4 END AS items_failed, event_id % 6 AS events_rejected, value * 100 AS duration_ms
        FROM {events}""",
    # texts of places, as people write them
    "v_place": """
        SELECT c_custkey AS place_id, CASE c_custkey % 8 WHEN 0 THEN 'Av. Bolívar ' || CAST(c_custkey % 90 AS STRING) || ', Posadas' WHEN 1 THEN 'Pje. Ñandubay & Av Roque_Pérez' WHEN 2 THEN 'Posadas, Mnes.' WHEN 3 THEN '  Gral. San-Martín/Sta. Ana  '
            WHEN 4 THEN 'Mis. ' || CAST(c_nationkey AS STRING) WHEN 5 THEN NULL WHEN 6 THEN 'Anfiteatro (Manuel) Ramírez' ELSE c_name || ' Straße' END AS place
        FROM {customer}""",
}

_USED = {name: tuple(dict.fromkeys(re.findall(r"(?<!\{)\{(\w+)\}", sql))) for name, sql in VIEWS.items()}


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.sql(VIEWS[name], **{t: table(spark, sf_dir, t) for t in _USED[name]})


def with_views(sql: str) -> str:
    """DuckDB SQL with the views that it names put before it."""
    named = [v for v in VIEWS if re.search(rf"\b{v}\b", sql)]
    if not named:
        return sql
    parts = [f"{v} AS ({VIEWS[v].format(**{t: t for t in TABLES})})" for v in named]
    body = sql.strip()
    if body.upper().startswith("WITH RECURSIVE "):
        return f"WITH RECURSIVE {', '.join(parts)}, {body[15:]}"
    return f"WITH {', '.join(parts)}, {body[5:]}" if body.upper().startswith("WITH ") else f"WITH {', '.join(parts)} {body}"
