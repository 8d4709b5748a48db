"""What decisions do to the stored tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewire.functions.text import slug

EVENT = ("title", "description", "start_at", "end_at", "recurrence_text", "venue_name", "address", "latitude", "longitude", "price_text", "category")
#: What a merge fills in where it is missing.
MERGEABLE = ("description", "end_at", "address", "latitude", "longitude", "price_text", "category", "recurrence_text")


def _filled(c: Column) -> Column:
    return c.isNotNull() & (c.cast("string") != "")


def downgrade(results: DataFrame, events: DataFrame) -> DataFrame:
    """Decisions that cannot be carried out become reviews: merges without a known target, accepts without what an event needs.

    results: decision, reasons, duplicate_of, title, venue_name, start_at and whatever else; events: event_id.
    """
    known = events.select(F.col("event_id").alias("duplicate_of"), F.lit(True).alias("tw_known")).distinct()
    rows = results.join(known, "duplicate_of", "left")
    persistable = _filled(F.col("title")) & _filled(F.col("venue_name")) & F.col("start_at").isNotNull()
    why = F.when((F.col("decision") == "MERGE") & F.col("duplicate_of").isNull(), "merge_without_duplicate_target").when((F.col("decision") == "MERGE") & F.col("tw_known").isNull(), "duplicate_event_not_found").when((F.col("decision") == "ACCEPT") & ~persistable, "accept_without_persistable_fields")
    out = rows.withColumn("tw_why", why)
    down = F.col("tw_why").isNotNull()
    out = out.withColumn("decision", F.when(down, "REVIEW").otherwise(F.col("decision"))).withColumn("reasons", F.when(down, F.array_append("reasons", F.col("tw_why"))).otherwise(F.col("reasons"))).withColumn("duplicate_of", F.when(~down, F.col("duplicate_of")))
    return out.select(*results.columns)


def unique_slugs(new: DataFrame, taken: DataFrame, order: list[str]) -> DataFrame:
    """Add slug: title and day, with -2, -3 and so on where it is taken, by stored events (slug) or earlier rows.

    A slug that ends in a free number may itself be another title's; the first free ones are dealt in order.
    """
    base = F.concat(slug(F.col("title")), F.lit("-"), F.date_format("start_at", "yyyyMMdd"))
    rows = new.withColumn("tw_base", base)
    used = taken.select("slug").distinct()
    bases = rows.select("tw_base").distinct()
    # Numbers that stored slugs use up, per base: 1 stands for the base itself.
    split = used.select(F.regexp_extract("slug", r"^(.*?-\d{8})(?:-(\d+))?$", 1).alias("tw_base"), F.when(F.regexp_extract("slug", r"^(.*?-\d{8})-(\d+)$", 2) == "", F.lit("1")).otherwise(F.regexp_extract("slug", r"^(.*?-\d{8})-(\d+)$", 2)).cast("int").alias("k"))
    busy = split.join(bases, "tw_base", "left_semi").groupBy("tw_base").agg(F.sort_array(F.collect_set("k")).alias("busy"))
    rows = rows.withColumn("tw_n", F.row_number().over(Window.partitionBy("tw_base").orderBy(*order))).join(busy, "tw_base", "left")
    none = F.array().cast("array<int>")
    taken_numbers = F.coalesce("busy", none)
    # The n-th number that is not busy: n plus the busy ones at or below it.
    number = F.aggregate(taken_numbers, F.col("tw_n"), lambda acc, b: F.when(b <= acc, acc + 1).otherwise(acc))
    return rows.withColumn("slug", F.when(number == 1, F.col("tw_base")).otherwise(F.concat("tw_base", F.lit("-"), number.cast("string")))).drop("tw_base", "tw_n", "busy")


def new_events(results: DataFrame, taken: DataFrame, order: list[str]) -> DataFrame:
    """Events that accepted candidates become; ids are derived from the candidate, so a rerun makes the same."""
    accepted = results.filter("decision = 'ACCEPT'")
    named = unique_slugs(accepted, taken, order)
    decimals = {"latitude": "decimal(9,6)", "longitude": "decimal(9,6)"}
    cols = [F.round(F.col(c), 6).cast(decimals[c]).alias(c) if c in decimals else F.col(c) for c in EVENT]
    return named.select(F.sha2(F.concat(F.lit("event:"), F.col("candidate_id").cast("string")), 256).substr(1, 32).alias("event_id"), "candidate_id", "slug", *cols, F.round("confidence", 3).cast("decimal(4,3)").alias("quality_score"), F.lit("ACTIVE").alias("status"))


def merges(results: DataFrame, events: DataFrame, order: list[str]) -> tuple[DataFrame, DataFrame]:
    """(events after merges, changes): empty fields take the first value that a merging candidate has.

    changes: event_id, field_name, old_value, new_value, source_id, candidate_id. An event with a change is UPDATED.
    """
    merging = results.filter("decision = 'MERGE'").select(F.col("duplicate_of").alias("event_id"), F.struct(*order).alias("tw_order"), "candidate_id", "source_id", *[F.col(c).alias(f"new_{c}") for c in MERGEABLE])
    offers = merging.groupBy("event_id").agg(*[F.min_by(F.struct(F.col(f"new_{c}").alias("value"), "source_id", "candidate_id"), F.when(_filled(F.col(f"new_{c}")), F.col("tw_order"))).alias(f"o_{c}") for c in MERGEABLE])
    joined = events.join(offers, "event_id", "left")
    fills = {c: ~_filled(F.col(c)) & F.coalesce(_filled(F.col(f"o_{c}.value")), F.lit(False)) for c in MERGEABLE}
    kinds = dict(events.dtypes)
    value = {c: (F.round(F.col(f"o_{c}.value"), 6) if c in ("latitude", "longitude") else F.col(f"o_{c}.value")).cast(kinds[c]) for c in MERGEABLE}
    changed = F.lit(False)
    for f in fills.values():
        changed = changed | f
    after = joined.select(*[F.when(fills[c], value[c]).otherwise(F.col(c)).alias(c) if c in fills else F.when(changed, "UPDATED").otherwise(F.col(c)).alias(c) if c == "status" else F.col(c) for c in events.columns])
    entries = F.array(*[F.when(fills[c], F.struct(F.lit(c).alias("field_name"), F.col(c).cast("string").alias("old_value"), value[c].cast("string").alias("new_value"), F.col(f"o_{c}.source_id").alias("source_id"), F.col(f"o_{c}.candidate_id").alias("candidate_id"))) for c in MERGEABLE])
    changes = joined.select("event_id", F.explode(F.filter(entries, lambda x: x.isNotNull())).alias("x")).select("event_id", "x.*")
    return after, changes


def links(results: DataFrame, created: DataFrame, stored: DataFrame) -> DataFrame:
    """New rows (event_id, source_id, source_url, is_primary); those already stored are not repeated."""
    own = created.select("candidate_id", F.col("event_id").alias("tw_event"))
    rows = results.filter("decision in ('ACCEPT', 'MERGE')").join(own, "candidate_id", "left")
    made = rows.select(F.coalesce("tw_event", "duplicate_of").alias("event_id"), "source_id", F.coalesce("source_url", F.lit("")).alias("source_url"), (F.col("decision") == "ACCEPT").alias("is_primary"))
    first = made.groupBy("event_id", "source_id", "source_url").agg(F.max("is_primary").alias("is_primary"))
    return first.join(stored.select("event_id", "source_id", "source_url"), ["event_id", "source_id", "source_url"], "left_anti")


def decisions(results: DataFrame) -> DataFrame:
    """The decision log; only merges and reviews name a duplicate."""
    of = F.when(F.col("decision").isin("MERGE", "REVIEW"), F.col("duplicate_of"))
    return results.select("candidate_id", "classification_id", "decision", "reasons", of.alias("duplicate_of"), F.round("decision_score", 3).cast("decimal(4,3)").alias("score"))


def review_items(results: DataFrame) -> DataFrame:
    reason = F.array_join("reasons", "; ")
    return results.filter("decision = 'REVIEW'").select("candidate_id", "classification_id", F.lit("PENDING").alias("status"), F.when(reason != "", reason).alias("reason"))


def classifications(posts: DataFrame, model: str | None, prompt_version: str) -> DataFrame:
    """One row per post that was asked about: post id, whether any event was found and how surely, and the raw answer."""
    from .extract import events_of, summarise

    said = summarise(events_of(F.col("answer")))
    return posts.filter("raw_content_id is not null").select("raw_content_id", said["is_event"].alias("is_event"), said["confidence"].cast("decimal(4,3)").alias("confidence"), F.col("answer").alias("extracted_fields"), F.lit(model).cast("string").alias("model_name"), F.lit(prompt_version).alias("prompt_version"), F.lit(None).cast("int").alias("tokens_used"), F.lit(None).cast("decimal(8,4)").alias("cost_usd"))


def archive(events: DataFrame, now: Column) -> DataFrame:
    """Events that are over become ARCHIVED; one without an end is over once it began."""
    over = F.col("status").isin("ACTIVE", "UPDATED") & F.coalesce(F.coalesce("end_at", "start_at") < now, F.lit(False))
    return events.withColumn("archived_now", over).withColumn("status", F.when(F.col("archived_now"), "ARCHIVED").otherwise(F.col("status")))
