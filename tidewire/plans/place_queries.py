"""Queries on places and providers."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewire.config import DEFAULT
from tidewire.functions import geo, text
from tidewire.operators import consensus, geoclassify
from tidewire.runtime import table
from tidewire.sources import catalogs, providers

from . import similarity_sql
from .registry import query
from .text_queries import _LOC
from .views import view


def _km(a: str, b: str, c: str = "-27.3671", d: str = "-55.8961") -> str:
    return f"(2 * 6371.0 * asin(sqrt(pow(sin((radians({c}) - radians({a})) / 2), 2) + cos(radians({a})) * cos(radians({c})) * pow(sin((radians({d}) - radians({b})) / 2), 2))))"


@query(
    "distances",
    f"""SELECT query, ordinal, round({_km('latitude', 'longitude')}, 6) AS km, {_km('latitude', 'longitude')} <= 15 AS in_area, latitude BETWEEN -27.40 AND -27.30 AND longitude BETWEEN -55.90 AND -55.80 AS in_box,
        CASE WHEN {_km('latitude', 'longitude')} <= 0.25 THEN 1.0 WHEN {_km('latitude', 'longitude')} <= 1 THEN 0.8 WHEN {_km('latitude', 'longitude')} <= 2 THEN 0.6 WHEN {_km('latitude', 'longitude')} <= 5 THEN 0.3 ELSE 0.0 END::DOUBLE AS similarity FROM v_geo""",
)
def distances(spark, sf_dir):
    g = view(spark, sf_dir, "v_geo")
    lat, lon = F.col("latitude"), F.col("longitude")
    box = type(DEFAULT)(bbox=(-27.40, -27.30, -55.90, -55.80))
    return g.select("query", "ordinal", F.round(geo.to_base_km(lat, lon), 6).alias("km"), geo.in_area(lat, lon).alias("in_area"), geo.in_area(lat, lon, box).alias("in_box"), geo.geo_similarity(geo.to_base_km(lat, lon)).alias("similarity"))


_N = lambda c: _LOC.replace("coalesce(place, '')", f"coalesce({c}, '')")
_CITY = f"CASE WHEN {_N('city')} = 'posadas' THEN 1E0 WHEN contains({_N('city')}, 'posadas') THEN 9E-1 ELSE 0E0 END"
_STATE = f"CASE WHEN {_N('state')} = 'misiones' THEN 1E0 WHEN contains({_N('state')}, 'misiones') THEN 9E-1 ELSE 0E0 END"
_COUNTRY = "CASE WHEN lower(country_code) = 'ar' THEN 1E0 ELSE 0E0 END"
_AREA = f"CASE WHEN {_km('latitude', 'longitude')} <= 15 THEN 1E0 ELSE 0E0 END"
_SURE = "greatest(0E0, least(1E0, coalesce(nullif(confidence, 0), importance, 0E0)))"


def _or_area(m: str) -> str:
    return f"CASE WHEN ({m}) > 0 THEN ({m}) ELSE ({_AREA}) END"


_TOTAL = f"least(1E0, greatest(0E0, 0E0 + 1E0 * 30E-2 + ({_or_area(_CITY)}) * 15E-2 + ({_or_area(_STATE)}) * 10E-2 + ({_or_area(_COUNTRY)}) * 10E-2 + ({_AREA}) * 15E-2 + ({_SURE}) * 15E-2 + 0E0 * 5E-2))"
_DECISION = "CASE WHEN total >= 90E-2 THEN 'accepted' WHEN total >= 75E-2 THEN 'provisional' WHEN total >= 50E-2 THEN 'manual_review' ELSE 'rejected' END"
_SCORED = f"WITH scored AS (SELECT *, ({_SURE})::DOUBLE AS sure, ({_AREA})::DOUBLE AS area, ({_TOTAL})::DOUBLE AS total FROM v_geo)"


def _scored(g):
    lat, lon = F.col("latitude"), F.col("longitude")
    area = F.when(geo.in_area(lat, lon), 1.0).otherwise(0.0)
    or_area = lambda m: F.when(m > 0, m).otherwise(area)
    sure = geo.clamp01(F.coalesce(F.when(F.col("confidence") != 0, F.col("confidence")), F.col("importance"), F.lit(0.0)))
    parts = dict(zip(geo.CONFIDENCE_PARTS, (F.lit(1.0), or_area(geo.name_match(F.col("city"), "posadas")), or_area(geo.name_match(F.col("state"), "misiones")), or_area(geo.country_match(F.col("country_code"))), area, sure, F.lit(0.0))))
    return g.withColumn("sure", sure).withColumn("area", area).withColumn("total", geo.confidence(parts))


@query("candidate_confidence", f"{_SCORED} SELECT query, ordinal, round(total, 9) AS total, {_DECISION} AS decision, CASE WHEN {_DECISION} IN ('accepted', 'provisional') THEN 'GEOLOCATED' WHEN {_DECISION} = 'manual_review' THEN 'PENDING_REVIEW' ELSE 'REJECTED' END AS status FROM scored")
def candidate_confidence(spark, sf_dir):
    g = _scored(view(spark, sf_dir, "v_geo"))
    return g.select("query", "ordinal", F.round("total", 9).alias("total"), geo.decision(F.col("total")).alias("decision"), geo.status_of(geo.decision(F.col("total"))).alias("status"))


@query(
    "provider_decisions",
    f"""{_SCORED}, near AS (SELECT *, row_number() OVER w AS n, lead(sure) OVER w AS next FROM scored WINDOW w AS (PARTITION BY query ORDER BY sure DESC, provider, ordinal)),
        top AS (SELECT * FROM near WHERE n = 1), best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY total DESC, ordinal) AS r FROM scored) WHERE r = 1),
        picked AS (SELECT b.query, coalesce(t.next IS NOT NULL AND t.sure - t.next < 1E-1, false) AS unclear, b.ordinal AS bo, t.ordinal AS t_o, b.total AS bt, t.total AS tt, b.country_code AS bc, b.area AS ba FROM best b JOIN top t ON b.query = t.query)
        SELECT query, CASE WHEN unclear THEN 'manual_review' WHEN lower(bc) <> 'ar' OR ba = 0 THEN 'rejected' ELSE {_DECISION.replace('total', 'bt')} END AS decision, round(CASE WHEN unclear THEN tt ELSE bt END, 9) AS confidence FROM picked""",
)
def provider_decisions(spark, sf_dir):
    """The best of a query's candidates decides, unless the two surest are too close."""
    g = view(spark, sf_dir, "v_geo").withColumn("key", F.col("normalized_name"))
    none = spark.createDataFrame([], "key string, name string")
    return geoclassify.from_candidates(g.drop("query").withColumnRenamed("key", "key").withColumn("query", F.col("key")), none).select(F.replace("key", F.lit("place "), F.lit("q")).alias("query"), "decision", F.round("confidence", 9).alias("confidence"))


_METERS = "2 * 6371.0::DOUBLE * asin(sqrt(pow(sin((radians({0}) - radians({2})) / 2), 2) + cos(radians({0})) * cos(radians({2})) * pow(sin((radians({3}) - radians({1})) / 2), 2))) * 1000"


@query(
    "geo_consensus",
    f"""WITH RECURSIVE pts AS (SELECT query, provider, ordinal, display_name, CAST(latitude AS DOUBLE) AS lat, CAST(longitude AS DOUBLE) AS lon, CAST(coalesce(nullif(confidence, 0), importance, 0) AS DOUBLE) AS score FROM v_geo),
        many AS (SELECT query, count(DISTINCT provider) AS many FROM pts GROUP BY query),
        ranked AS (SELECT pts.*, many, row_number() OVER (PARTITION BY query ORDER BY CASE WHEN many > 1 THEN -score END, provider, ordinal) AS k FROM pts JOIN many USING (query)),
        lists AS (SELECT query, many, list(lat ORDER BY k) AS ys, list(lon ORDER BY k) AS xs FROM ranked GROUP BY query, many),
        fold AS (
            SELECT query, many, ys, xs, 1 AS k, [0] AS labels FROM lists
            UNION ALL
            SELECT query, many, ys, xs, k + 1, list_append(labels, coalesce(CASE WHEN many > 1 THEN list_min(list_transform(list_filter(range(1, k + 1), lambda j: {_METERS.format("ys[j]", "xs[j]", "ys[k + 1]", "xs[k + 1]")} <= 300), lambda j: labels[j])) END, list_max(labels) + 1))
            FROM fold WHERE k < len(ys)
        ),
        labelled AS (SELECT ranked.*, labels[ranked.k] AS label FROM ranked JOIN fold ON ranked.query = fold.query AND fold.k = len(fold.ys)),
        apart AS (SELECT a.query, a.label, max({_METERS.format("a.lat", "a.lon", "b.lat", "b.lon")}) AS apart FROM labelled a JOIN labelled b ON a.query = b.query AND a.label = b.label GROUP BY a.query, a.label),
        told AS (
            SELECT query, label, any_value(many) AS many, arg_min(provider, k) AS provider, arg_min(display_name, k) AS display_name, arg_min(lat, k) AS lat, arg_min(lon, k) AS lon, max(score) AS score,
                CAST(count(DISTINCT provider) AS INTEGER) AS provider_count, CAST(count(*) AS INTEGER) AS candidate_count, string_agg(DISTINCT provider, ',' ORDER BY provider) AS providers,
                round(min(lat), 6) AS min_latitude, round(max(lat), 6) AS max_latitude, round(min(lon), 6) AS min_longitude, round(max(lon), 6) AS max_longitude,
                sum(lat * CASE WHEN score > 0 THEN score ELSE 1 END) / sum(CASE WHEN score > 0 THEN score ELSE 1 END) AS mid_lat, sum(lon * CASE WHEN score > 0 THEN score ELSE 1 END) / sum(CASE WHEN score > 0 THEN score ELSE 1 END) AS mid_lon
            FROM labelled GROUP BY query, label
        ),
        judged AS (SELECT told.*, round(apart, 1) AS max_distance_m, many > 1 AND provider_count >= 2 AND apart <= 300 AS consensus FROM told JOIN apart USING (query, label)),
        placed AS (SELECT *, CAST(row_number() OVER w - 1 AS INTEGER) AS place, many > 1 AND first_value(provider_count) OVER w >= 2 AND first_value(max_distance_m) OVER w <= 300 AS sure
            FROM judged WINDOW w AS (PARTITION BY query ORDER BY CASE WHEN many > 1 THEN -provider_count END, CASE WHEN many > 1 THEN -score END, CASE WHEN many > 1 THEN max_distance_m END, label))
        SELECT query, place, CASE WHEN consensus THEN 'consensus' ELSE provider END AS provider, display_name, CASE WHEN consensus THEN mid_lat ELSE lat END AS latitude, CASE WHEN consensus THEN mid_lon ELSE lon END AS longitude, score,
            provider_count, candidate_count, providers, min_latitude, max_latitude, min_longitude, max_longitude, max_distance_m, consensus FROM placed WHERE NOT sure OR place = 0""",
)
def geo_consensus(spark, sf_dir):
    """Clusters of providers' candidates, ranked, or the one that they agree on."""
    return consensus.agree(view(spark, sf_dir, "v_geo"))


@query(
    "provider_counts",
    "SELECT query, count(DISTINCT provider) AS providers, count(*) AS candidates, string_agg(DISTINCT provider, ',' ORDER BY provider) AS names, printf('%.6f', min(latitude)) AS least_latitude FROM v_geo GROUP BY query",
)
def provider_counts(spark, sf_dir):
    g = view(spark, sf_dir, "v_geo")
    return g.groupBy("query").agg(F.count_distinct("provider").alias("providers"), F.count("*").alias("candidates"), F.array_join(F.array_sort(F.collect_set("provider")), ",").alias("names"), F.format_string("%.6f", F.min("latitude")).alias("least_latitude"))


def _places(spark):
    """A small catalog, as a file of places would give it."""
    rows = [(0, "Posadas", "posadas", ["Posadas, Misiones", "Posadas Mnes"], "Posadas", "Misiones", "ar", -27.3671, -55.8961, "city", True), (1, "Anfiteatro", "anfiteatro manuel ramirez", ["Anfiteatro (Manuel) Ramírez"], "Posadas", "Misiones", "ar", -27.36, -55.89, "venue", True), (2, "Encarnacion", "encarnacion", [], None, None, "py", -27.33, -55.87, "city", False), (3, "Lejos", "pje nandubay y av roque perez", None, "Oberá", "Misiones", "ar", -27.48, -55.13, "street", True)]
    return spark.createDataFrame(rows, f"ordinal int, {catalogs.PLACE}")


@query(
    "catalog_exact",
    f"SELECT place_id, CASE {_LOC} WHEN 'posadas misiones' THEN 'Posadas' WHEN 'posadas' THEN 'Posadas' WHEN 'anfiteatro manuel ramirez' THEN 'Anfiteatro' WHEN 'pasaje nandubay y avenida roque perez' THEN 'Lejos' END AS name, CASE {_LOC} WHEN 'posadas misiones' THEN 'accepted' WHEN 'anfiteatro manuel ramirez' THEN 'accepted' WHEN 'pasaje nandubay y avenida roque perez' THEN 'rejected' END AS decision FROM v_place",
)
def catalog_exact(spark, sf_dir):
    """Texts that are a catalog name or alias once normalised, and what that decides."""
    p = view(spark, sf_dir, "v_place").withColumn("key", text.normalize_location(F.col("place")))
    found = geoclassify.match_catalog(p.select(F.col("place").alias("text")), _places(spark)).filter("exact")
    return p.join(geoclassify.from_catalog(found), "key", "left").select("place_id", F.col("matched_catalog_entry").alias("name"), "decision")


_NAMES = "(VALUES (0, 0, 'Posadas', 'posadas'), (0, 1, 'Posadas', 'posadas misiones'), (0, 2, 'Posadas', 'posadas misiones'), (1, 0, 'Anfiteatro', 'anfiteatro manuel ramirez'), (1, 1, 'Anfiteatro', 'anfiteatro manuel ramirez'), (2, 0, 'Encarnacion', 'encarnacion'), (3, 0, 'Lejos', 'pasaje nandubay y avenida roque perez')) names(o, k, name, b)"


@query(
    "catalog_matches",
    f"""WITH keys AS (SELECT DISTINCT {_LOC} AS a FROM v_place WHERE {_LOC} <> ''), p AS (SELECT DISTINCT a, b FROM keys, {_NAMES}), {similarity_sql.fuzzy("p", "f")},
        s AS (SELECT f.a AS key, name, CASE WHEN f.a = f.b THEN 1E0 ELSE weighted * 0.5::DOUBLE + token_set * 0.3::DOUBLE + token_sort * 0.2::DOUBLE END AS score, f.a = f.b AS exact, o, k FROM f JOIN {_NAMES} ON f.b = names.b),
        r AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY exact DESC, score DESC, o, k) AS n FROM s WHERE score >= 85E-2)
        SELECT key, name, round(score, 9) AS score, exact FROM r WHERE n = 1""",
)
def catalog_matches(spark, sf_dir):
    """The best catalog name of every text that has one from the threshold on, and its score."""
    p = view(spark, sf_dir, "v_place").select(F.col("place").alias("text"))
    return geoclassify.match_catalog(p, _places(spark)).select("key", F.col("entry.name").alias("name"), F.round("score", 9).alias("score"), "exact")


@query("location_decisions")
def location_decisions(spark, sf_dir):
    """Candidates through given coordinates, the catalog and providers."""
    return _located(spark, sf_dir).groupBy("geo_decision", "geo_provider", "processing_status").agg(F.count("*").alias("n"))


def _located(spark, sf_dir):
    c = view(spark, sf_dir, "v_candidate").select(F.col("candidate_id").alias("id"), "venue_name", "address", F.lit(None).cast("string").alias("geo_query"), F.create_map(F.lit("venue_name"), "venue_name").alias("evidence"), F.when(F.col("confidence") > 0.7, F.col("latitude")).alias("latitude"), F.when(F.col("confidence") > 0.7, F.col("longitude")).alias("longitude"))
    answers = view(spark, sf_dir, "v_geo").withColumn("query", F.concat(F.lit("Sala "), F.substring("query", 2, 9)))
    return geoclassify.classify(c, _places(spark), answers)


_PARTS = ("text_similarity", "city_match", "state_match", "country_match", "coordinate_in_allowed_area", "provider_confidence", "catalog_exact_match")
_TOTAL = "least(1, greatest(0, " + " + ".join(f"{p} * {w}::DOUBLE" for p, w in zip(_PARTS, (0.30, 0.15, 0.10, 0.10, 0.15, 0.15, 0.05))) + "))"
_BY_TOTAL = "CASE WHEN total >= 90E-2 THEN 'accepted' WHEN total >= 75E-2 THEN 'provisional' WHEN total >= 50E-2 THEN 'manual_review' ELSE 'rejected' END"
_OR_AREA = "CASE WHEN {0} > 0 THEN {0} ELSE inside END"
_NAMED = lambda c, name: f"CASE WHEN {_N(c)} = '{name}' THEN 1E0 WHEN contains({_N(c)}, '{name}') THEN 9E-1 ELSE 0E0 END"
#: Places as people write them, some with a venue that providers know, some with coordinates.
_ASKED = "CASE WHEN place_id % 3 = 0 THEN 'Place ' || CAST(place_id % 1000 AS STRING) END"
_GIVEN = "CASE WHEN place_id % 7 = 0 THEN {0} + (place_id % 50 - 25) / 1E2 END"
_ENTRIES = "(VALUES (0, 1E0, 1E0, 1E0, 1E0, false, -27.3671, -55.8961), (1, 1E0, 1E0, 1E0, 1E0, false, -27.36, -55.89), (2, 0E0, 0E0, 0E0, 1E0, true, -27.33, -55.87), (3, 0E0, 1E0, 1E0, 0E0, true, -27.48, -55.13)) entries(o, city_match, state_match, country_match, inside, barred, lat, lon)"


@query(
    "location_rows",
    f"""WITH r AS (SELECT place_id, place, {_ASKED} AS venue, {_GIVEN.format("-273671E-4")} AS lat, {_GIVEN.format("-558961E-4")} AS lon FROM v_place),
        t AS (SELECT *, {_N("text")} AS key, lat IS NOT NULL AS given FROM (SELECT *, concat_ws(', ', CASE WHEN trim(place) <> '' THEN place END, venue) AS text FROM r)),
        keys AS (SELECT DISTINCT key AS a FROM t WHERE NOT given AND key <> ''), p AS (SELECT DISTINCT a, b FROM keys, {_NAMES}), {similarity_sql.fuzzy("p", "f")},
        named AS (SELECT f.a AS key, o, k, CASE WHEN f.a = f.b THEN 1E0 ELSE weighted * 0.5::DOUBLE + token_set * 0.3::DOUBLE + token_sort * 0.2::DOUBLE END AS text_similarity, CASE WHEN f.a = f.b THEN 1E0 ELSE 0E0 END AS catalog_exact_match FROM f JOIN {_NAMES} ON f.b = names.b),
        close AS (SELECT * FROM named WHERE text_similarity >= 85E-2 QUALIFY row_number() OVER (PARTITION BY key ORDER BY catalog_exact_match DESC, text_similarity DESC, o, k) = 1),
        c1 AS (SELECT key, lat, lon, barred, text_similarity, city_match, state_match, country_match, inside AS coordinate_in_allowed_area, 1E0 AS provider_confidence, catalog_exact_match FROM close JOIN {_ENTRIES} ON close.o = entries.o),
        catalog AS (SELECT *, {_TOTAL} AS total FROM c1),
        q AS (SELECT DISTINCT key, venue FROM t WHERE NOT given AND key <> '' AND venue IS NOT NULL AND key NOT IN (SELECT key FROM catalog)),
        g AS (SELECT q.key, provider, ordinal, city, state, country_code, latitude AS lat, longitude AS lon, normalized_name AS b, least(1, greatest(0, coalesce(nullif(confidence, 0), importance, 0))) AS provider_confidence, CASE WHEN {_km("latitude", "longitude")} <= 15 THEN 1E0 ELSE 0E0 END AS inside FROM q JOIN v_geo ON venue = display_name),
        gp AS (SELECT DISTINCT key AS a, b FROM g), {similarity_sql.fuzzy("gp", "gf")},
        g1 AS (SELECT g.*, greatest(weighted, token_set, token_sort) AS text_similarity, {_NAMED("city", "posadas")} AS cm, {_NAMED("state", "misiones")} AS sm, CASE WHEN lower(country_code) = 'ar' THEN 1E0 ELSE 0E0 END AS nm, 0E0 AS catalog_exact_match, inside AS coordinate_in_allowed_area FROM g JOIN gf ON gf.a = g.key AND gf.b = g.b),
        g2 AS (SELECT *, {_OR_AREA.format("cm")} AS city_match, {_OR_AREA.format("sm")} AS state_match, {_OR_AREA.format("nm")} AS country_match FROM g1),
        g3 AS (SELECT *, {_TOTAL} AS total, row_number() OVER w AS n, lead(provider_confidence) OVER w AS next FROM g2 WINDOW w AS (PARTITION BY key ORDER BY provider_confidence DESC, provider, ordinal)),
        g4 AS (SELECT *, coalesce(bool_or(n = 1 AND provider_confidence - next < 1E-1) OVER (PARTITION BY key), false) AS unclear FROM g3),
        g5 AS (SELECT * FROM g4 QUALIFY row_number() OVER (PARTITION BY key ORDER BY CASE WHEN unclear THEN n END, total DESC, ordinal) = 1),
        provided AS (SELECT *, coalesce(country_code <> '' AND lower(country_code) <> 'ar', false) AS away FROM g5),
        decided AS (
            SELECT key, CASE WHEN barred THEN 'rejected' ELSE {_BY_TOTAL} END AS decision, total, lat, lon, 'catalog' AS provider, CASE WHEN catalog_exact_match = 1 THEN 'catalog_exact_match' ELSE 'catalog_fuzzy_match' END AS reasons, {", ".join(_PARTS)} FROM catalog
            UNION ALL
            SELECT key, CASE WHEN unclear THEN 'manual_review' WHEN away OR inside = 0 THEN 'rejected' ELSE {_BY_TOTAL} END, total, lat, lon, provider,
                concat_ws(', ', CASE WHEN unclear THEN 'multiple_close_matches' END, CASE WHEN NOT unclear AND away THEN 'country_out_of_scope' END, CASE WHEN NOT unclear AND inside = 0 THEN 'outside_allowed_area' END, CASE WHEN NOT unclear AND cm = 1 THEN 'city_matches_posadas' END, CASE WHEN NOT unclear AND sm = 1 THEN 'state_matches_misiones' END,
                    CASE WHEN country_match < 1 THEN 'country_mismatch' END, CASE WHEN inside = 0 THEN 'outside_allowed_area' END), {", ".join(_PARTS)} FROM provided
        ),
        j AS (
            SELECT place_id, given, CASE WHEN given THEN CASE WHEN {_km("t.lat", "t.lon")} <= 15 THEN 'accepted' ELSE 'rejected' END ELSE coalesce(decision, 'unresolved') END AS decision, CASE WHEN given THEN CASE WHEN {_km("t.lat", "t.lon")} <= 15 THEN 1E0 ELSE 0E0 END ELSE coalesce(total, 0) END AS confidence,
                CASE WHEN given THEN 'explicit' ELSE provider END AS provider, CASE WHEN given THEN 'explicit_coordinates' WHEN t.key = '' THEN 'missing_location_text' ELSE coalesce(reasons, 'no_geocoding_candidates') END AS reasons, coalesce(t.lat, decided.lat) AS latitude, coalesce(t.lon, decided.lon) AS longitude, {", ".join(_PARTS)}
            FROM t LEFT JOIN decided ON NOT given AND t.key = decided.key
        )
        SELECT place_id, decision, round(confidence, 9) AS confidence, provider, reasons, round(latitude, 6) AS latitude, round(longitude, 6) AS longitude, CASE WHEN decision IN ('accepted', 'provisional') THEN 'GEOLOCATED' WHEN decision IN ('manual_review', 'unresolved') THEN 'PENDING_REVIEW' ELSE 'REJECTED' END AS status,
            CASE WHEN given THEN 'geo_decision=old; told=by ' || CAST(place_id % 5 AS VARCHAR) ELSE concat_ws('; ', 'geo_decision=' || decision, 'geo_provider=' || provider, 'geo_reason=' || reasons, 'geo_source=' || coalesce(provider, decision), 'told=by ' || CAST(place_id % 5 AS VARCHAR)) END AS evidence, {", ".join(f"round({p}, 9) AS {p}" for p in _PARTS)} FROM j""",
)
def location_rows(spark, sf_dir):
    """Where each text is, from its coordinates, the catalog or providers: decision, confidence and its parts, reasons, evidence."""
    p = view(spark, sf_dir, "v_place")
    given = lambda least: F.expr(_GIVEN.format(least))
    evidence = F.create_map(F.lit("told"), F.concat(F.lit("by "), (F.col("place_id") % 5).cast("string")), F.lit("geo_decision"), F.lit("old"))
    rows = p.select(F.col("place_id").alias("id"), F.expr(_ASKED).alias("venue_name"), F.col("place").alias("address"), F.lit(None).cast("string").alias("geo_query"), evidence.alias("evidence"), given("-273671E-4").alias("latitude"), given("-558961E-4").alias("longitude"))
    answers = view(spark, sf_dir, "v_geo").withColumn("query", F.col("display_name"))
    found = geoclassify.classify(rows, _places(spark), answers, with_breakdown=True)
    said = F.array_sort(F.transform(F.filter(F.map_entries("evidence"), lambda e: e["key"] != "geo_confidence"), lambda e: F.concat(e["key"], F.lit("="), e["value"])))
    return found.select(F.col("id").alias("place_id"), F.col("geo_decision").alias("decision"), F.round("geo_confidence", 9).alias("confidence"), F.col("geo_provider").alias("provider"), F.array_join("geo_reasons", ", ").alias("reasons"), F.round("latitude", 6).alias("latitude"), F.round("longitude", 6).alias("longitude"), F.col("processing_status").alias("status"), F.array_join(said, "; ").alias("evidence"), *[F.round(f"geo_breakdown.{n}", 9).alias(n) for n in _PARTS])


@query(
    "location_queries",
    """SELECT candidate_id, CASE WHEN venue_name IS NULL AND address IS NULL THEN 0 WHEN venue_name IS NULL THEN 1 WHEN address IS NULL THEN 3 ELSE 5 END AS n_queries,
        coalesce(venue_name, address) AS first_query, concat_ws(', ', address, venue_name) AS original FROM v_candidate""",
)
def location_queries(spark, sf_dir):
    """What providers are asked about a candidate, each spelling once."""
    c = view(spark, sf_dir, "v_candidate").withColumn("geo_query", F.lit(None).cast("string")).withColumn("evidence", F.create_map(F.lit("venue_name"), F.col("venue_name")))
    told = geoclassify.with_kinds(c, geoclassify.kinds_of(c), "text", "queries")
    return told.select("candidate_id", F.size("queries").alias("n_queries"), F.get("queries", F.lit(0)).alias("first_query"), F.col("text").alias("original"))


@query(
    "first_answers",
    """WITH q AS (SELECT c_custkey % 200 AS key, c_custkey // 200 AS position, 'q' || CAST(c_custkey AS VARCHAR) AS query FROM customer), a AS (SELECT DISTINCT query FROM v_geo)
       SELECT CAST(key AS VARCHAR) AS key, arg_min(q.query, position) AS query FROM q JOIN a ON q.query = a.query GROUP BY key""",
)
def first_answers(spark, sf_dir):
    """Of a candidate's queries the first that has an answer."""
    c = table(spark, sf_dir, "customer")
    q = c.select((F.col("c_custkey") % 200).cast("string").alias("key"), F.floor(F.col("c_custkey") / 200).alias("position"), F.concat(F.lit("q"), "c_custkey").alias("query"))
    answers = view(spark, sf_dir, "v_geo")
    return geoclassify.first_answers(q, answers).select("key", "query").distinct()


@query(
    "primary_fallback",
    """SELECT 'q' || CAST(c_custkey AS VARCHAR) AS query, CASE WHEN c_custkey % 3 = 0 THEN 'primary' WHEN c_custkey % 2 = 0 THEN 'fallback' ELSE 'primary' END AS client,
        CASE WHEN c_custkey % 3 = 0 THEN 1.0 WHEN c_custkey % 2 = 0 THEN 2.0 WHEN c_custkey % 3 = 1 THEN 3.0 END::DOUBLE AS latitude FROM customer""",
)
def primary_fallback(spark, sf_dir):
    k = F.col("c_custkey")
    c = table(spark, sf_dir, "customer").withColumn("query", F.concat(F.lit("q"), "c_custkey"))
    none = F.lit(None).cast("array<string>")
    first = c.select("query", F.when(k % 3 == 0, 1.0).when(k % 3 == 1, 3.0).alias("latitude"), F.lit(1.0).alias("longitude"), F.when(k % 3 == 1, F.array(F.lit("several"))).otherwise(none).alias("candidates"))
    second = c.filter(k % 2 == 0).select("query", F.lit(2.0).alias("latitude"), F.lit(2.0).alias("longitude"), none.alias("candidates"))
    return geoclassify.primary_or_fallback(first, second).select("query", "client", "latitude")


_PAYLOAD = {
    "nominatim": """'[{"display_name": "Plaza ' || CAST(c_custkey AS STRING) || '", "lat": "-27.' || CAST(c_custkey % 90 + 10 AS STRING) || '", "lon": "-55.5", "importance": 0.5, "type": "park", "address": {"town": "Posadas", "state": "Misiones", "country_code": "ar"}}, {"display_name": "nowhere"}]'""",
    "geoapify": """'{"features": [{"properties": {"formatted": "Plaza ' || CAST(c_custkey AS STRING) || '", "lat": -27.' || CAST(c_custkey % 90 + 10 AS STRING) || ', "lon": -55.5, "city": "Posadas", "country_code": "ar", "result_type": "park", "rank": {"importance": 0.5, "confidence": 0.75}}}]}'""",
    "client": """CASE c_custkey % 3 WHEN 0 THEN '{"latitude": -27.5, "longitude": -55.5, "confidence": 1.5}' WHEN 1 THEN '{"candidates": [{"latitude": -27.5, "longitude": -55.5, "score": 0.25}, {"latitude": -27.5}]}' ELSE 'oops' END""",
}


@query(
    "provider_payloads",
    """SELECT 'nominatim' AS provider, c_custkey, 'Plaza ' || CAST(c_custkey AS VARCHAR) AS display_name, CAST('-27.' || CAST(c_custkey % 90 + 10 AS VARCHAR) AS DOUBLE) AS latitude, 'Posadas' AS city, CAST(0.5 AS DOUBLE) AS importance, CAST(NULL AS DOUBLE) AS confidence FROM customer
       UNION ALL SELECT 'locationiq', c_custkey, 'Plaza ' || CAST(c_custkey AS VARCHAR), CAST('-27.' || CAST(c_custkey % 90 + 10 AS VARCHAR) AS DOUBLE), 'Posadas', 0.5, NULL FROM customer
       UNION ALL SELECT 'geoapify', c_custkey, 'Plaza ' || CAST(c_custkey AS VARCHAR), CAST('-27.' || CAST(c_custkey % 90 + 10 AS VARCHAR) AS DOUBLE), 'Posadas', 0.5, 0.75 FROM customer
       UNION ALL SELECT 'client', c_custkey, CAST(c_custkey AS VARCHAR), -27.5, NULL, CASE c_custkey % 3 WHEN 0 THEN 1.0 ELSE 0.25 END, CASE c_custkey % 3 WHEN 0 THEN 1.0 ELSE 0.25 END FROM customer WHERE c_custkey % 3 < 2""",
)
def provider_payloads(spark, sf_dir):
    """JSON answers of three providers and of an unknown client as one table."""
    c = table(spark, sf_dir, "customer")
    said = lambda name: c.select(F.col("c_custkey").cast("string").alias("query"), F.expr(_PAYLOAD[name]).alias("payload"))
    every = providers.nominatim(said("nominatim")).unionByName(providers.locationiq(said("nominatim"))).unionByName(providers.geoapify(said("geoapify"))).unionByName(providers.any_answer(said("client")))
    return every.select("provider", F.col("query").cast("long").alias("c_custkey"), "display_name", "latitude", "city", "importance", "confidence")


@query(
    "geocode_cache",
    """SELECT c_custkey, c_custkey % 4 IN (0, 1) AS hit, CASE c_custkey % 4 WHEN 0 THEN '[1]' WHEN 1 THEN '' END AS payload FROM customer""",
)
def geocode_cache(spark, sf_dir):
    """Answers kept from before: found places for a month, misses for an hour."""
    c = table(spark, sf_dir, "customer").withColumn("key", F.concat(F.lit("k"), "c_custkey"))
    now = F.lit("2026-01-02 00:00:00").cast("timestamp")
    made = F.when(F.col("c_custkey") % 4 == 3, F.lit("2026-01-01 22:59:00").cast("timestamp")).otherwise(F.lit("2026-01-01 23:30:00").cast("timestamp"))
    answers = c.filter("c_custkey % 4 <> 2").withColumn("payload", F.when(F.col("c_custkey") % 4 == 0, "[1]").otherwise(""))
    cache = providers.cache_entries(answers.withColumn("at", made), F.col("at"))
    return providers.cached(c, cache, now).select("c_custkey", "hit", "payload")
