"""The catalog of sources: upserts, repairs, discoveries, checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewire.functions import urls
from tidewire.functions.text import squeeze_ends

#: Columns that the catalog file rules over what is stored.
MANAGED = ("name", "base_url", "canonical_base_url", "adapter_type", "active", "reliability_score")


def catalog_actions(catalog: DataFrame, stored: DataFrame) -> DataFrame:
    """What a catalog (ordinal, name, base_url, adapter_type, active, reliability_score) does to stored sources.

    Rows: ordinal, canonical_base_url, source_id (null for new), action (invalid, inserted, updated,
    unchanged), deactivated, and the managed columns. Of entries with one canonical url the first that
    is new inserts and later ones update it.
    """
    entry = catalog.select("ordinal", squeeze_ends(F.col("name")).alias("name"), squeeze_ends(F.col("base_url")).alias("base_url"), urls.normalize_source_url(F.col("base_url")).alias("canonical_base_url"), urls.normalize_adapter(F.col("adapter_type")).alias("adapter_type"), "active", F.col("reliability_score").cast("double").alias("reliability_score"))
    old = stored.select("source_id", F.col("canonical_base_url").alias("tw_key"), F.struct(*MANAGED).alias("old"))
    same_url = Window.partitionBy("canonical_base_url").orderBy("ordinal")
    state = F.struct(*MANAGED)
    before = F.lag(state).over(same_url)
    rows = entry.join(old, entry.canonical_base_url == old.tw_key, "left").withColumn("tw_before", F.when(F.col("canonical_base_url").isNotNull(), F.coalesce(before, F.when(F.col("source_id").isNotNull(), F.col("old")))))
    same = F.lit(True)
    for c in MANAGED:
        same = same & F.col(c).eqNullSafe(F.col(f"tw_before.{c}"))
    action = F.when(F.col("canonical_base_url").isNull(), "invalid").when(F.col("tw_before").isNull(), "inserted").when(same, "unchanged").otherwise("updated")
    return rows.select("ordinal", "canonical_base_url", "source_id", action.alias("action"), F.coalesce(F.col("tw_before.active") & ~F.col("active"), F.lit(False)).alias("deactivated"), *[c for c in MANAGED if c != "canonical_base_url"])


def action_counts(actions: DataFrame) -> DataFrame:
    kinds = ("inserted", "updated", "unchanged", "invalid")
    return actions.agg(F.count("*").alias("configured"), *[F.count_if(F.col("action") == k).alias(k) for k in kinds], F.count_if("deactivated").alias("deactivated"))


def repair_duplicates(sources: DataFrame) -> DataFrame:
    """What a repair does to sources (source_id, base_url, canonical_base_url, active, created_at).

    Adds canonical (recomputed), repair: survivor, loser, realign, ok, no_survivor or invalid, and the
    columns after it. Of active sources with one url the oldest stays.
    """
    key = urls.normalize_source_url(F.col("base_url"))
    group = Window.partitionBy("canonical")
    rows = sources.withColumn("canonical", key)
    rows = rows.withColumn("tw_on", F.count_if("active").over(group)).withColumn("tw_all", F.count("*").over(group)).withColumn("tw_n", F.row_number().over(group.orderBy(F.desc("active"), "created_at", "source_id")))
    off = F.col("canonical_base_url").isNull() | (F.col("canonical_base_url") != F.col("canonical"))
    kind = F.when(F.col("canonical").isNull(), "invalid").when(F.col("active") & (F.col("tw_on") > 1), F.when(F.col("tw_n") == 1, "survivor").otherwise("loser")).when(F.col("active") & off, "realign").when((F.col("tw_on") == 0) & (F.col("tw_all") > 1), "no_survivor").otherwise("ok")
    rows = rows.withColumn("repair", kind)
    lost, fixed = F.col("repair") == "loser", F.col("repair").isin("survivor", "realign")
    return rows.select(*[c for c in sources.columns if c not in ("canonical_base_url", "active")], "canonical", "repair", F.when(lost, F.lit(None)).when(fixed, F.col("canonical")).otherwise(F.col("canonical_base_url")).alias("canonical_base_url"), (F.col("active") & ~lost).alias("active"), (fixed & off).alias("corrected"))


def canonical_backfill(sources: DataFrame) -> DataFrame:
    """The first source of each base_url keeps it as canonical; repeats get none."""
    first = Window.partitionBy("base_url").orderBy("created_at", "source_id")
    n = F.row_number().over(first)
    return sources.withColumn("canonical_base_url", F.when(n == 1, F.col("base_url")))


def discovered(found: DataFrame, stored: DataFrame, limit: int) -> tuple[DataFrame, DataFrame]:
    """(new sources, stored sources marked as discovered) from found (source_url, feeds), at most `limit` feeds each."""
    rows = found.select("source_url", F.posexplode(F.slice("feeds", 1, limit)).alias("n", "url")).withColumn("canonical_base_url", urls.normalize_source_url(F.col("url"))).filter("canonical_base_url is not null")
    first = rows.groupBy("canonical_base_url").agg(F.min_by(F.struct("url", "source_url"), F.struct("source_url", "n")).alias("x")).select("canonical_base_url", "x.*")
    new = first.join(stored.select("canonical_base_url"), "canonical_base_url", "left_anti").select(urls.discovered_name(F.col("canonical_base_url")).alias("name"), F.col("url").alias("base_url"), "canonical_base_url", F.lit("rss").alias("adapter_type"), F.lit(False).alias("active"), F.lit(0.5).alias("reliability_score"), F.lit("discovered").alias("validation_status"), F.col("source_url").alias("discovered_from_url"))
    marked = stored.filter("not active and discovered_from_url is null").join(first.select("canonical_base_url", "source_url"), "canonical_base_url").select("source_id", F.col("source_url").alias("discovered_from_url"), F.when(F.col("validation_status") == "catalog", "discovered").otherwise(F.col("validation_status")).alias("validation_status"))
    return new, marked


def record_validation(sources: DataFrame, results: DataFrame, now: Column) -> DataFrame:
    """Sources with the outcome of a check (source_id, status, error, final_url)."""
    r = results.select("source_id", F.struct("status", "error", "final_url").alias("tw"))
    done = F.col("tw").isNotNull()
    out = sources.join(r, "source_id", "left")
    for column, value in (("validation_status", F.col("tw.status")), ("validation_error", F.col("tw.error")), ("validation_final_url", F.col("tw.final_url")), ("validation_checked_at", now), ("last_reviewed_at", now)):
        out = out.withColumn(column, F.when(done, value).otherwise(F.col(column)))
    return out.select(*sources.columns)


def patch(sources: DataFrame, patches: DataFrame) -> DataFrame:
    """Sources with the given fields of patches (source_id, changes as a map from column to text); what is not given stays."""
    rows = sources.join(patches.select("source_id", F.col("changes").alias("tw")), "source_id", "left")
    return rows.select(*[F.when(F.coalesce(F.map_contains_key("tw", c), F.lit(False)), F.col("tw")[c].cast(t)).otherwise(F.col(c)).alias(c) if c != "source_id" else F.col(c) for c, t in sources.dtypes])


def check_counts(results: DataFrame, inserted: Column) -> DataFrame:
    """Totals of a round of checks (ok, feeds): validated, invalid, discovered, and how many were inserted."""
    return results.agg(F.count_if("ok").alias("validated"), F.count_if(~F.col("ok")).alias("invalid"), F.coalesce(F.sum(F.size("feeds")), F.lit(0)).alias("discovered")).withColumn("inserted", inserted)
