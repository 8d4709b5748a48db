"""Places: distances, areas and the composite confidence, as native columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidewire.config import DEFAULT, Settings

from .text import normalize_location

EARTH_KM = 6371.0
CONFIDENCE_PARTS = ("text_similarity", "city_match", "state_match", "country_match", "coordinate_in_allowed_area", "provider_confidence", "catalog_exact_match")


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Great-circle distance; null if any coordinate is."""
    a, b = F.radians(lat1), F.radians(lat2)
    h = F.pow(F.sin((b - a) / 2), 2) + F.cos(a) * F.cos(b) * F.pow(F.sin((F.radians(lon2) - F.radians(lon1)) / 2), 2)
    return 2 * EARTH_KM * F.asin(F.sqrt(h))


def to_base_km(lat: Column, lon: Column, s: Settings = DEFAULT) -> Column:
    return haversine_km(lat, lon, F.lit(s.base_latitude), F.lit(s.base_longitude))


def in_area(lat: Column, lon: Column, s: Settings = DEFAULT) -> Column:
    """Whether a point is in the box, or within the radius without one; false for nulls."""
    if s.bbox:
        inside = lat.between(*s.bbox[:2]) & lon.between(*s.bbox[2:])
    else:
        inside = to_base_km(lat, lon, s) <= s.radius_km
    return F.coalesce(inside, F.lit(False))


def geo_similarity(km: Column) -> Column:
    return F.when(km <= 0.25, 1.0).when(km <= 1, 0.8).when(km <= 2, 0.6).when(km <= 5, 0.3).otherwise(0.0)


def clamp01(c: Column) -> Column:
    """Null stays null."""
    return F.when(c.isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(1.0), c)))


def name_match(c: Column, name: str) -> Column:
    """1 for the name itself, 0.9 if it is part of the text, else 0."""
    t = normalize_location(c)
    return F.when(t == name, 1.0).when(t.contains(name), 0.9).otherwise(0.0)


def country_match(c: Column, s: Settings = DEFAULT) -> Column:
    return F.when(F.lower(c) == s.country, 1.0).otherwise(0.0)


def confidence(parts: dict[str, Column], s: Settings = DEFAULT) -> Column:
    total = F.lit(0.0)
    for name, weight in zip(CONFIDENCE_PARTS, s.geo_weights):
        total = total + parts[name] * F.lit(weight)
    return clamp01(total)


def decision(conf: Column, s: Settings = DEFAULT) -> Column:
    return F.when(conf >= s.geo_accept, "accepted").when(conf >= s.geo_review, "provisional").when(conf >= s.geo_reject, "manual_review").otherwise("rejected")


def status_of(dec: Column) -> Column:
    """The processing status that a location decision leads to."""
    return F.when(dec.isin("accepted", "provisional"), "GEOLOCATED").when(dec.isin("manual_review", "unresolved"), "PENDING_REVIEW").otherwise("REJECTED")
