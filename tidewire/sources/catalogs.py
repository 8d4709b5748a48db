"""Catalogs and labelled sets in JSON files, and scans of stored tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewire.functions.text import normalize_location

PLACE = "name string, normalized_name string, aliases array<string>, city string, state string, country_code string, latitude double, longitude double, kind string, allowed boolean"
SOURCE = "name string, base_url string, adapter_type string, reliability_score double, active boolean, contact_notes string"


def _items(spark: SparkSession, path: str) -> DataFrame:
    """Each element of a JSON list as text; what is no list fails, elements that are no objects are dropped."""
    whole = spark.read.text(path, wholetext=True)
    kind = F.expr("try_cast(schema_of_variant(try_parse_json(value)) as string)")
    checked = whole.select(F.when(kind.startswith("ARRAY"), F.col("value")).otherwise(F.raise_error(F.lit("a catalog must be a JSON list"))).alias("value"))
    item = F.from_json("value", "array<string>")
    return checked.select(F.posexplode(item).alias("ordinal", "item")).filter(F.trim("item").startswith("{"))


def read_places(spark: SparkSession, path: str) -> DataFrame:
    """A location catalog: ordinal and the columns of PLACE; country and allowed have defaults."""
    rows = _items(spark, path).select("ordinal", F.from_json("item", PLACE).alias("x")).select("ordinal", "x.*")
    return rows.withColumn("country_code", F.coalesce("country_code", F.lit("ar"))).withColumn("allowed", F.coalesce("allowed", F.lit(True)))


def read_sources(spark: SparkSession, path: str) -> DataFrame:
    """A source catalog: ordinal and the columns of SOURCE."""
    return _items(spark, path).select("ordinal", F.from_json("item", SOURCE).alias("x")).select("ordinal", "x.*")


def read_labelled(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A labelled set: its objects, in the given schema."""
    return _items(spark, path).select("ordinal", F.from_json("item", schema).alias("x")).select("ordinal", "x.*")


def place_names(places: DataFrame) -> DataFrame:
    """One row per place and name or alias, in order: the place's columns, matched_text, matched_key, name_ordinal."""
    names = F.concat(F.array("normalized_name"), F.coalesce("aliases", F.array().cast("array<string>")))
    rows = places.select(*places.columns, F.posexplode(names).alias("name_ordinal", "matched_text"))
    return rows.withColumn("matched_key", normalize_location(F.col("matched_text"))).filter("matched_key <> ''")


def page(table: DataFrame, order: list[Column], limit: int, offset: int = 0) -> DataFrame:
    """A page of a table in a fixed order."""
    return table.orderBy(*order).offset(offset).limit(limit)


def active_sources(sources: DataFrame) -> DataFrame:
    return sources.filter("active").orderBy(F.desc("reliability_score"), "source_id")


def open_events(events: DataFrame) -> DataFrame:
    """The events that a new post may repeat."""
    return events.filter(F.col("status").isin("ACTIVE", "UPDATED"))
