"""Settings of the event engine."""

from __future__ import annotations

from dataclasses import dataclass, fields
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Settings:
    timezone: str = "America/Argentina/Cordoba"
    base_latitude: float = -27.3671
    base_longitude: float = -55.8961
    radius_km: float = 15.0
    #: (least latitude, most latitude, least longitude, most longitude); replaces the radius when given.
    bbox: tuple[float, float, float, float] | None = None
    confidence_review: float = 0.50
    confidence_accept: float = 0.70
    duplicate_candidate: float = 0.50
    duplicate_review: float = 0.75
    duplicate_merge: float = 0.90
    geo_reject: float = 0.50
    geo_review: float = 0.75
    geo_accept: float = 0.90
    catalog_threshold: float = 0.85
    consensus_providers: int = 2
    consensus_meters: float = 300.0
    country: str = "ar"
    city: str = "posadas"
    state: str = "misiones"
    horizon_days: int = 365
    allowed_hosts: tuple[str, ...] = ()
    near_hours: int = 24
    near_km: float = 2.0
    discovered_urls: int = 5
    execution_minutes: int = 60
    #: Weights of the composite location confidence, in the order of `geo.CONFIDENCE_PARTS`.
    geo_weights: tuple[float, ...] = (0.30, 0.15, 0.10, 0.10, 0.15, 0.15, 0.05)
    cache_hours: int = 30 * 24
    cache_negative_hours: int = 1

    def __post_init__(self) -> None:
        for f in fields(self):
            v = getattr(self, f.name)
            if f.type == "float" and not f.name.startswith(("base_", "radius", "consensus", "near")) and not 0 <= v <= 1:
                raise ValueError(f"{f.name} must be from 0 to 1")
        if self.confidence_review > self.confidence_accept:
            raise ValueError("confidence_review must not exceed confidence_accept")
        if not self.duplicate_candidate <= self.duplicate_review <= self.duplicate_merge:
            raise ValueError("duplicate thresholds must ascend")
        if not self.geo_reject <= self.geo_review <= self.geo_accept:
            raise ValueError("location thresholds must ascend")
        if self.bbox is not None and (len(self.bbox) != 4 or None in self.bbox):
            raise ValueError("bbox needs all four bounds")
        if abs(sum(self.geo_weights) - 1) > 1e-9:
            raise ValueError("location weights must sum to 1")


DEFAULT = Settings()


def split_list(value: str) -> tuple[str, ...]:
    """A comma-separated setting: trimmed, lower-cased, blanks dropped."""
    return tuple(x.strip().casefold() for x in value.split(",") if x.strip())


def contradictions(rows: DataFrame) -> Column:
    """What is wrong with each row of a table of settings, as an array of names; the rules are those of Settings.

    Columns that the table lacks have their defaults. The weights and the box are arrays.
    """
    given = lambda n: F.col(n) if n in rows.columns else F.lit(getattr(DEFAULT, n))
    shares = [f.name for f in fields(Settings) if f.type == "float" and not f.name.startswith(("base_", "radius", "consensus", "near"))]
    weights = F.col("geo_weights") if "geo_weights" in rows.columns else F.array(*[F.lit(w) for w in DEFAULT.geo_weights])
    box = F.col("bbox") if "bbox" in rows.columns else F.lit(None).cast("array<double>")
    wrong = {
        "shares": ~reduce(lambda a, b: a & b, [given(n).between(0, 1) for n in shares]),
        "confidence": given("confidence_review") > given("confidence_accept"),
        "duplicates": (given("duplicate_candidate") > given("duplicate_review")) | (given("duplicate_review") > given("duplicate_merge")),
        "location": (given("geo_reject") > given("geo_review")) | (given("geo_review") > given("geo_accept")),
        "box": box.isNotNull() & ((F.size(box) != 4) | F.exists(box, lambda x: x.isNull())),
        "weights": F.abs(F.aggregate(weights, F.lit(0.0), lambda a, x: a + x) - 1) > 1e-9,
    }
    return F.filter(F.array(*[F.when(F.coalesce(c, F.lit(True)), F.lit(n)) for n, c in wrong.items()]), lambda x: x.isNotNull())
