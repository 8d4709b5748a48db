"""Where a candidate takes place: a local catalog first, then providers' candidates."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewire.config import DEFAULT, Settings
from tidewire.functions import geo
from tidewire.functions.similarity import fuzzy, with_fuzzy
from tidewire.functions.text import normalize_location, present
from tidewire.runtime import materialise, spread
from tidewire.sources.catalogs import place_names

#: Names and texts up to this long also meet by stretches of two letters.
SHORT = 10


def _pieces(*cols: Column) -> Column:
    return F.filter(F.array(*cols), present)


def original_text(e: Column | None = None) -> Column:
    """All that a candidate says about its place, each piece once, parted by ', '."""
    said = lambda k: F.col("evidence")[k]
    return F.array_join(F.array_distinct(_pieces(F.col("address"), F.col("venue_name"), F.col("geo_query"), said("address"), said("venue_name"), said("geo_query"))), ", ")


def queries_of() -> Column:
    """What providers are asked about a candidate, in order; of queries that normalise alike the first stays."""
    said = lambda k: F.col("evidence")[k]
    venue = F.col("venue_name")
    wide = lambda tail: F.when(venue != "", F.concat(venue, F.lit(tail)))
    key = normalize_location(original_text())
    every = _pieces(venue, F.col("address"), F.col("geo_query"), said("address"), said("venue_name"), wide(", Posadas, Misiones, Argentina"), wide(", Misiones, Argentina"), key)
    pairs = F.filter(F.transform(every, lambda q: F.struct(normalize_location(q).alias("key"), q.alias("query"))), lambda p: p["key"] != "")
    keys = F.transform(pairs, lambda p: p["key"])
    return F.transform(F.filter(pairs, lambda p, k: F.array_position(keys, p["key"]) == k + 1), lambda p: p["query"])


#: What may be said of a place, by name.
SAID = {"tw_address": ("address", None), "tw_venue": ("venue_name", None), "tw_query": ("geo_query", None), "tw_told_address": ("evidence", "address"), "tw_told_venue": ("evidence", "venue_name"), "tw_told_query": ("evidence", "geo_query")}


def kinds_of(rows: DataFrame) -> DataFrame:
    """What rows say of their places, each combination once: the columns SAID, and text, key and queries made of them."""
    said = spread(rows.select(*[(F.col(c) if k is None else F.col(c)[k]).alias(n) for n, (c, k) in SAID.items()]).distinct())
    told = F.create_map(*[x for n, (_, k) in SAID.items() if k for x in (F.lit(k), F.col(n))])
    own = said.withColumns({**{c: F.col(n) for n, (c, k) in SAID.items() if k is None}, "evidence": told})
    made = own.select(*SAID, original_text().alias("text"), normalize_location(original_text()).alias("key"), queries_of().alias("queries"))
    return materialise(made, "geo-kinds")  # read several times, and costly to make


def with_kinds(rows: DataFrame, kinds: DataFrame, *more: str, where: Column | None = None) -> DataFrame:
    """rows with the columns `more` of what kinds_of() made of them; null for rows that `where` leaves out."""
    same = reduce(and_, ((F.col(c) if k is None else F.col(c)[k]).eqNullSafe(F.col(n)) for n, (c, k) in SAID.items()))
    return rows.join(kinds.select(*SAID, *more), same if where is None else same & where, "left").drop(*SAID)


def match_catalog(texts: DataFrame, places: DataFrame, column: str = "text", least: float = DEFAULT.catalog_threshold) -> DataFrame:
    """Per distinct text its best name in the catalog: key, entry columns, score and exact.

    Texts without a name that is exact or scores `least` have no row. Exact names are found by an
    equi-join; other texts meet the names that share a word or a stretch of letters. Of equal scores the
    first name in the catalog wins.
    """
    names = place_names(places)
    keys = texts.select(normalize_location(F.col(column)).alias("key")).distinct().filter("key <> ''")
    entry = [c for c in names.columns if c not in ("matched_key",)]
    row = F.struct(*entry)
    first = names.groupBy("matched_key").agg(F.min_by(row, F.struct("ordinal", "name_ordinal")).alias("entry"))
    exact = keys.join(first, keys.key == first.matched_key).select("key", "entry", F.lit(1.0).alias("score"), F.lit(True).alias("exact"))
    rest = keys.join(first, keys.key == first.matched_key, "left_anti")
    scored = _meeting(rest, names).withColumn("fz", fuzzy("key", "matched_key")).withColumn("score", F.col("fz.weighted") * 0.5 + F.col("fz.token_set") * 0.3 + F.col("fz.token_sort") * 0.2)
    scored = scored.filter(F.col("score") >= least).join(names, "matched_key")
    best = scored.groupBy("key").agg(F.max_by(F.struct(row.alias("entry"), "score"), F.struct("score", (-F.col("ordinal")).alias("a"), (-F.col("name_ordinal")).alias("b"))).alias("b"))
    return exact.unionByName(best.select("key", "b.entry", "b.score", F.lit(False).alias("exact")))


def _stretches(c: Column, n: int) -> Column:
    return F.when(F.length(c) >= n, F.transform(F.sequence(F.lit(1), F.greatest(F.length(c) - (n - 1), F.lit(1))), lambda i: F.substring(c, i, F.lit(n)))).otherwise(F.array().cast("array<string>"))


def _meeting(keys: DataFrame, names: DataFrame) -> DataFrame:
    """Pairs (key, matched_key) that share a word, three letters in a row, or, where both are short, two; each once.

    Texts that share no three letters in a row have at most two thirds of a longer text's letters in
    common runs, which is below any threshold in use; only short ones get further.
    """

    def marks(c: Column) -> Column:
        short = F.when(F.length(c) <= SHORT, F.transform(_stretches(c, 2), lambda x: F.concat(F.lit("2"), x))).otherwise(F.array().cast("array<string>"))
        return F.array_distinct(F.concat(F.transform(F.split(c, " "), lambda x: F.concat(F.lit("w"), x)), F.transform(_stretches(c, 3), lambda x: F.concat(F.lit("3"), x)), short))

    left, right = keys.withColumn("g", F.explode(marks(F.col("key")))), names.select("matched_key", F.explode(marks(F.col("matched_key"))).alias("g")).distinct()
    return left.join(right, "g").drop("g").distinct()


def from_catalog(found: DataFrame, s: Settings = DEFAULT) -> DataFrame:
    """Decisions for catalog matches that are exact or close enough."""
    e = F.col("entry")
    inside = F.when(geo.in_area(e["latitude"], e["longitude"], s), 1.0).otherwise(0.0)
    parts = {
        "text_similarity": F.col("score"),
        "city_match": geo.name_match(e["city"], s.city),
        "state_match": geo.name_match(e["state"], s.state),
        "country_match": geo.country_match(e["country_code"], s),
        "coordinate_in_allowed_area": inside,
        "provider_confidence": F.lit(1.0),
        "catalog_exact_match": F.when(F.col("exact"), 1.0).otherwise(0.0),
    }
    close = found.filter(F.col("exact") | (F.col("score") >= s.catalog_threshold))
    conf = geo.confidence(parts, s)
    out = ~e["allowed"] | ((e["country_code"] != "") & (F.lower(e["country_code"]) != s.country)) | (e["latitude"].isNotNull() & e["longitude"].isNotNull() & (inside == 0))
    return close.select("key", F.when(F.coalesce(out, F.lit(False)), "rejected").otherwise(geo.decision(conf, s)).alias("decision"), conf.alias("confidence"), e["latitude"].alias("latitude"), e["longitude"].alias("longitude"), e["city"].alias("city"), e["state"].alias("state"), e["country_code"].alias("country_code"), F.lit("catalog").alias("precision"), F.lit("catalog").alias("provider"), e["name"].alias("matched_catalog_entry"), F.array(F.when(F.col("exact"), "catalog_exact_match").otherwise("catalog_fuzzy_match")).alias("reasons"), F.struct(*[c.alias(n) for n, c in parts.items()]).alias("breakdown"))


#: Parts of the confidence that rest on a candidate alone, and not on the text that it was asked for.
OWN_PARTS = geo.CONFIDENCE_PARTS[1:]
#: Candidates whose parts sum to less than the best by this cannot win, however floating-point sums are rounded.
LESS = 1e-8


def standing(rows: DataFrame, exact_names: DataFrame, by: str, s: Settings = DEFAULT) -> DataFrame:
    """Of the candidates that share `by` those that can decide: (by, normalized_name, unclear, x); x is a candidate with its parts.

    If the two most confident are less than 0.1 apart, the first of them decides alone. Else the best composite
    confidence decides, whose other part is the same for all candidates of one name: of each name only those remain
    whose own parts sum to the most, and of equal ones the first. So what a text must be held against does not
    grow with the number of candidates.
    """
    lookup = exact_names.select(F.col("key").alias("normalized_name"), F.col("name").alias("named")).dropDuplicates(["normalized_name"])
    rows = rows.join(lookup, "normalized_name", "left")
    sure = geo.clamp01(F.coalesce(F.when(F.col("confidence") != 0, F.col("confidence")), F.col("importance"), F.lit(0.0)))
    inside = F.when(geo.in_area(F.col("latitude"), F.col("longitude"), s), 1.0).otherwise(0.0)
    or_area = lambda m: F.when(m > 0, m).otherwise(inside)
    parts = {
        "city_match": or_area(geo.name_match(F.col("city"), s.city)),
        "state_match": or_area(geo.name_match(F.col("state"), s.state)),
        "country_match": or_area(geo.country_match(F.col("country_code"), s)),
        "coordinate_in_allowed_area": inside,
        "provider_confidence": sure,
        "catalog_exact_match": F.when(F.col("named").isNotNull(), 1.0).otherwise(0.0),
    }
    x = F.struct("ordinal", "latitude", "longitude", "city", "state", "country_code", "precision", "provider", "named", F.struct(*[F.col(p) for p in OWN_PARTS]).alias("parts"))
    rows = rows.withColumns(parts).select(by, "normalized_name", "provider", "ordinal", *OWN_PARTS, x.alias("x"))
    by_sure = Window.partitionBy(by).orderBy(F.desc("provider_confidence"), "provider", "ordinal")
    two = rows.withColumn("n", F.row_number().over(by_sure)).filter("n <= 2")
    tops = two.groupBy(by).agg(F.min_by(F.struct("normalized_name", "x"), "n").alias("top"), (F.min_by("provider_confidence", "n") - F.max_by("provider_confidence", "n") < 0.1).alias("near"), F.count("*").alias("count"))
    tops = tops.filter("count = 2 and near").select(by, "top.normalized_name", F.lit(True).alias("unclear"), "top.x")
    first = rows.groupBy(by, "normalized_name", *OWN_PARTS).agg(F.min_by("x", "ordinal").alias("x"))
    if min(s.geo_weights) >= 0:
        own = sum((F.col(p) * w for p, w in zip(OWN_PARTS, s.geo_weights[1:])), F.lit(0.0))
        first = first.withColumn("own", own).withColumn("most", F.max("own").over(Window.partitionBy(by, "normalized_name"))).filter(F.col("own") >= F.col("most") - LESS)
    best = first.join(tops.select(by), by, "left_anti").select(by, "normalized_name", F.lit(False).alias("unclear"), "x")
    return materialise(tops.unionByName(best), "geo-standing")


def from_candidates(rows: DataFrame, exact_names: DataFrame, s: Settings = DEFAULT) -> DataFrame:
    """Decisions from providers' candidates: key and the columns of providers.CANDIDATE; one row per key.

    exact_names (key, name): catalog names that a normalised text is exactly. If the two most confident
    candidates are less than 0.1 apart, a person decides; else the best composite confidence does.
    """
    return judged(standing(rows, exact_names, "key", s), s)


def judged(rows: DataFrame, s: Settings = DEFAULT) -> DataFrame:
    """Decisions of keys from what standing() returns, with the key that each row is held against; one row per key."""
    rows = with_fuzzy(rows, F.col("key"), F.col("normalized_name"), "fz")
    text = F.greatest("fz.weighted", "fz.token_set", "fz.token_sort")
    rows = rows.withColumn("breakdown", F.struct(text.alias("text_similarity"), *[F.col("x.parts")[n].alias(n) for n in OWN_PARTS]))
    rows = rows.withColumn("total", geo.confidence({n: F.col("breakdown")[n] for n in geo.CONFIDENCE_PARTS}, s))
    row = F.struct("unclear", "x", "breakdown", "total")
    best = rows.groupBy("key").agg(F.max_by(row, F.struct("total", (-F.col("x.ordinal")).alias("o"))).alias("b"))
    picked = best.select("key", "b.unclear", *[F.col("b.x")[n].alias(n) for n in ("latitude", "longitude", "city", "state", "country_code", "precision", "provider", "named")], "b.breakdown", "b.total")
    away = (F.col("country_code") != "") & (F.lower("country_code") != s.country)
    away = F.coalesce(away, F.lit(False))
    outside = ~geo.in_area(F.col("latitude"), F.col("longitude"), s)
    b = F.col("breakdown")
    noted = lambda cond, name: F.when(cond, F.lit(name))
    own = F.array(noted(b["catalog_exact_match"] > 0, "catalog_match"), noted(b["country_match"] < 1, "country_mismatch"), noted(b["coordinate_in_allowed_area"] < 1, "outside_allowed_area"))
    first = F.when(F.col("unclear"), F.array(F.lit("multiple_close_matches"))).otherwise(F.array(noted(away, "country_out_of_scope"), noted(outside, "outside_allowed_area"), noted(normalize_location(F.col("city")) == s.city, f"city_matches_{s.city}"), noted(normalize_location(F.col("state")) == s.state, f"state_matches_{s.state}")))
    dec = F.when(F.col("unclear"), "manual_review").when(away | outside, "rejected").otherwise(geo.decision(F.col("total"), s))
    return picked.select("key", dec.alias("decision"), F.col("total").alias("confidence"), "latitude", "longitude", "city", "state", "country_code", "precision", "provider", F.col("named").alias("matched_catalog_entry"), F.filter(F.concat(first, own), lambda x: x.isNotNull()).alias("reasons"), "breakdown")


def first_asked(queries: DataFrame, answers: DataFrame) -> DataFrame:
    """(key, query): the first query of each key (key, position, query) that has any candidates in answers (query, ...)."""
    usable = queries.join(answers.select("query").distinct(), "query", "left_semi")
    return usable.groupBy("key").agg(F.min_by("query", "position").alias("query"))


def first_answers(queries: DataFrame, answers: DataFrame) -> DataFrame:
    """Candidates of the first query of each key (key, position, query) that has any in answers (query, ...)."""
    return first_asked(queries, answers).join(answers, "query")


def primary_or_fallback(primary: DataFrame, fallback: DataFrame) -> DataFrame:
    """Answers (query, latitude, longitude, candidates) of a first client; where they are not one precise place, of a second one if it has any."""
    p = primary.select("query", F.struct("latitude", "longitude", "candidates").alias("p"))
    f = fallback.select("query", F.struct("latitude", "longitude", "candidates").alias("f"))
    precise = F.col("p.latitude").isNotNull() & F.col("p.longitude").isNotNull() & F.col("p.candidates").isNull()
    return p.join(f, "query", "full_outer").select("query", F.when(precise | F.col("f").isNull(), F.col("p")).otherwise(F.col("f")).alias("x"), F.when(precise | F.col("f").isNull(), "primary").otherwise("fallback").alias("client")).select("query", "x.*", "client")


def merge_evidence(evidence: Column, notes: dict[str, Column]) -> Column:
    """A map with further entries that are not null; of equal keys the note wins."""
    added = F.map_filter(F.create_map(*[x for k, v in notes.items() for x in (F.lit(k), v.cast("string"))]), lambda _, v: v.isNotNull())
    base = F.map_filter(F.coalesce(evidence, F.create_map().cast("map<string,string>")), lambda k, _: ~F.map_contains_key(added, k))
    return F.map_concat(base, added)


def classify(rows: DataFrame, places: DataFrame, answers: DataFrame, s: Settings = DEFAULT, with_breakdown: bool = False) -> DataFrame:
    """Add geo (the decision and its grounds), coordinates and processing_status to candidates; with_breakdown also geo_breakdown, the parts of the confidence.

    rows need a unique `id`, address, venue_name, geo_query, evidence, latitude, longitude; answers are
    providers' candidates. Given coordinates are judged as they are; then the catalog; then providers.
    """
    given = F.col("latitude").isNotNull() & F.col("longitude").isNotNull()
    kinds = kinds_of(rows.filter(~given))
    found = match_catalog(kinds, places)
    catalog = materialise(from_catalog(found, s), "geo-catalog")
    open_ = kinds.join(catalog.select("key"), "key", "left_anti").filter("key <> ''")
    asked = open_.select("key", F.posexplode("queries").alias("position", "query")).dropDuplicates(["key", "position"])
    exact = place_names(places).select(F.col("matched_key").alias("key"), "name")
    provided = judged(first_asked(asked, answers).join(standing(answers, exact, "query", s), "query").drop("query"), s)
    decided = catalog.unionByName(provided)
    inside = geo.in_area(F.col("latitude"), F.col("longitude"), s)
    joined = with_kinds(rows, kinds, "key", where=~given).join(decided.select("key", F.struct(*[c for c in decided.columns if c != "key"]).alias("g")), "key", "left")
    missing = F.coalesce(F.col("key"), F.lit("")) == ""
    dec = F.when(given, F.when(inside, "accepted").otherwise("rejected")).otherwise(F.coalesce("g.decision", F.lit("unresolved")))
    reasons = F.when(given, F.array(F.lit("explicit_coordinates"))).when(missing, F.array(F.lit("missing_location_text"))).otherwise(F.coalesce("g.reasons", F.array(F.lit("no_geocoding_candidates"))))
    out = joined.withColumn("geo_decision", dec).withColumn("geo_confidence", F.when(given, F.when(inside, 1.0).otherwise(0.0)).otherwise(F.coalesce("g.confidence", F.lit(0.0)))).withColumn("geo_reasons", reasons).withColumn("geo_provider", F.when(given, F.lit("explicit")).otherwise(F.col("g.provider")))
    out = out.withColumn("processing_status", geo.status_of(F.col("geo_decision"))).withColumn("geo_precision", F.when(given, F.coalesce("geo_precision", F.lit("explicit"))).otherwise(F.coalesce("g.precision", "geo_decision")) if "geo_precision" in rows.columns else F.coalesce("g.precision", "geo_decision"))
    notes = {"geo_provider": F.col("geo_provider"), "geo_source": F.coalesce("geo_provider", "geo_decision"), "geo_decision": F.col("geo_decision"), "geo_confidence": F.format_string("%.3f", "geo_confidence"), "geo_reason": F.array_join("geo_reasons", ", ")}
    out = out.withColumn("evidence", F.when(given, F.col("evidence")).otherwise(merge_evidence(F.col("evidence"), notes)))
    if with_breakdown:
        out = out.withColumn("geo_breakdown", F.when(~given, F.col("g.breakdown")))
    out = out.withColumns({"latitude": F.coalesce("latitude", "g.latitude"), "longitude": F.coalesce("longitude", "g.longitude")})
    return out.drop("key", "g")
