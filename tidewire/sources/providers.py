"""Answers of geocoding providers as one table of candidates."""

from __future__ import annotations

from urllib.parse import quote, urlencode

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewire.config import DEFAULT, Settings
from tidewire.functions.geo import clamp01
from tidewire.functions.text import normalize_location

CANDIDATE = ["query", "provider", "ordinal", "display_name", "normalized_name", "latitude", "longitude", "country_code", "state", "city", "precision", "importance", "confidence"]


def _get(v: Column, path: str, kind: str = "string") -> Column:
    return F.try_variant_get(v, path, kind)


def _first(v: Column, *paths: str, kind: str = "string") -> Column:
    return F.coalesce(*[_get(v, p, kind) for p in paths])


def _rows(answers: DataFrame, inside: str | None) -> DataFrame:
    """One variant per candidate of a JSON answer (query, payload)."""
    v = F.try_parse_json("payload")
    items = _get(v, inside, "array<variant>") if inside else _get(v, "$", "array<variant>")
    return answers.select("query", F.posexplode(items).alias("ordinal", "v"))


def _candidate(rows: DataFrame, provider: str, v: dict[str, Column]) -> DataFrame:
    made = rows.select("query", F.lit(provider).alias("provider"), "ordinal", *[c.alias(k) for k, c in v.items()])
    return made.filter("latitude is not null and longitude is not null").withColumn("normalized_name", normalize_location(F.col("display_name"))).select(*CANDIDATE)


def nominatim(answers: DataFrame, provider: str = "nominatim") -> DataFrame:
    """A list of places with lat and lon as text. LocationIQ answers alike."""
    v = F.col("v")
    return _candidate(_rows(answers, None), provider, {
        "display_name": F.coalesce(_get(v, "$.display_name"), F.lit("")), "latitude": _get(v, "$.lat").try_cast("double"), "longitude": _get(v, "$.lon").try_cast("double"),
        "country_code": _get(v, "$.address.country_code"), "state": _get(v, "$.address.state"), "city": _first(v, "$.address.city", "$.address.town", "$.address.village", "$.address.municipality"),
        "precision": _first(v, "$.addresstype", "$.type"), "importance": _get(v, "$.importance", "double"), "confidence": F.lit(None).cast("double"),
    })


def locationiq(answers: DataFrame) -> DataFrame:
    return nominatim(answers, "locationiq")


def geoapify(answers: DataFrame) -> DataFrame:
    """A GeoJSON collection, or a list of results."""
    v = F.col("v")
    at = lambda *names: [f"$.properties.{n}" for n in names] + [f"$.{n}" for n in names]
    rows = _rows(answers, "$.features").unionByName(_rows(answers, "$.results"))
    return _candidate(rows, "geoapify", {
        "display_name": F.coalesce(_first(v, *at("formatted", "name")), F.lit("")), "latitude": _first(v, *at("lat"), kind="double"), "longitude": _first(v, *at("lon"), kind="double"),
        "country_code": _first(v, *at("country_code")), "state": _first(v, *at("state")), "city": _first(v, *at("city", "town", "village")),
        "precision": _first(v, *at("result_type")), "importance": _first(v, *at("rank.importance"), kind="double"), "confidence": _first(v, *at("rank.confidence"), kind="double"),
    })


def any_answer(answers: DataFrame, provider: str = "client") -> DataFrame:
    """Answers of an unknown client: a list, an object with `candidates`, or one object."""
    v = F.try_parse_json("payload")
    listed = F.coalesce(_get(v, "$", "array<variant>"), _get(v, "$.candidates", "array<variant>"), F.when(_get(v, "$.latitude", "double").isNotNull(), F.array(v)))
    rows = answers.select("query", F.posexplode(listed).alias("ordinal", "v"))
    v = F.col("v")
    score = [clamp01(_get(v, f"$.{n}", "double")) for n in ("importance", "confidence", "score")]
    return _candidate(rows, provider, {
        "display_name": F.coalesce(_first(v, "$.display_name", "$.name"), F.col("query")), "latitude": _get(v, "$.latitude", "double"), "longitude": _get(v, "$.longitude", "double"),
        "country_code": _get(v, "$.country_code"), "state": _get(v, "$.state"), "city": _get(v, "$.city"), "precision": _get(v, "$.precision"),
        "importance": F.coalesce(*score), "confidence": F.coalesce(score[1], score[2], score[0]),
    })


def as_answer(candidates: DataFrame) -> DataFrame:
    """(query, payload): the inverse of any_answer; one candidate is an object, several are a list in `candidates`."""
    one = F.struct("latitude", "longitude", "display_name", "country_code", "state", "city", "precision", "importance", "confidence")
    grouped = candidates.groupBy("query").agg(F.transform(F.sort_array(F.collect_list(F.struct("ordinal", one.alias("x")))), lambda r: r["x"]).alias("xs"))
    return grouped.select("query", F.when(F.size("xs") == 1, F.to_json(F.get("xs", F.lit(0)))).otherwise(F.to_json(F.struct(F.col("xs").alias("candidates")))).alias("payload"))


#: Address of each provider's search.
ENDPOINTS = {"nominatim": "https://nominatim.openstreetmap.org/search", "locationiq": "https://us1.locationiq.com/v1/search", "geoapify": "https://api.geoapify.com/v1/geocode/search"}


def request_url(provider: str, query: str, country: str = DEFAULT.country, limit: int = 5, key: str | None = None) -> str:
    """The url of a provider's search; raises ValueError without the key that it needs."""
    if provider != "nominatim" and not key:
        raise ValueError(f"{provider} is not configured")
    if provider == "geoapify":
        params = {"text": query, "limit": limit, "filter": f"countrycode:{country}", "apiKey": key}
    else:
        params = {"q": query, "format": "jsonv2" if provider == "nominatim" else "json", "addressdetails": 1, "limit": limit, "countrycodes": country}
        params |= {"key": key} if key else {}
    return f"{ENDPOINTS[provider]}?{urlencode(params, quote_via=quote)}"


def request_column(provider: str, query: Column, country: str = DEFAULT.country, limit: int = 5, key: str | None = None) -> Column:
    """request_url() for a column of queries."""
    mark = "0x7e"  # stands for a query; no character of it is encoded
    before, after = request_url(provider, mark, country, limit, key).split(mark)
    coded = F.replace(F.replace(F.replace(F.url_encode(query), F.lit("+"), F.lit("%20")), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))
    return F.concat(F.lit(before), coded, F.lit(after))


def enabled(names: tuple[str, ...], keys: dict[str, str]) -> list[str]:
    """Providers in the configured order whose key is there."""
    return [n for n in names if n == "nominatim" or keys.get(n)]


def chain(names: Column, keys: Column) -> Column:
    """enabled() for columns: an array of names, a map of keys; null maps hold none."""
    given = F.coalesce(keys, F.create_map().cast("map<string,string>"))
    return F.filter(names, lambda n: (n == "nominatim") | (F.coalesce(F.element_at(given, n), F.lit("")) != ""))


def cache_key(provider: Column, query: Column, country: str, limit: int) -> Column:
    return F.concat_ws("|", provider, normalize_location(query), F.lit(country), F.lit(limit))


def cached(queries: DataFrame, cache: DataFrame, now: Column) -> DataFrame:
    """queries (key) with the payload of a live cache entry (key, payload, expires_at) and hit; an empty payload is a known miss."""
    live = cache.filter(F.col("expires_at") > now).select("key", F.col("payload"), F.lit(True).alias("hit"))
    return queries.join(live, "key", "left").withColumn("hit", F.coalesce("hit", F.lit(False)))


def cache_entries(answers: DataFrame, now: Column, s: Settings = DEFAULT) -> DataFrame:
    """Cache rows of answers (key, payload): found places live long, misses short."""
    found = F.col("payload").isNotNull() & ~F.col("payload").isin("", "[]")
    hours = F.when(found, s.cache_hours).otherwise(s.cache_negative_hours)
    return answers.select("key", "payload", (now + F.make_dt_interval(F.lit(0), hours)).alias("expires_at"))
