"""From a model's answer about a post to event candidates."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewire.config import DEFAULT, Settings
from tidewire.functions import dates, text

#: Fields of an event in an answer that are text, and how they are called.
TEXTS = ("title", "recurrence_text", "venue_name", "address", "geo_precision", "geo_query", "price_text", "description", "category", "special_requirements")


def prompt(raw: Column, date: Column, instructions: str) -> Column:
    """What a model is asked; the post stands between marks, as content that is not trusted."""
    return F.concat(F.lit(instructions), F.lit("\n\nDate: "), date, F.lit("\n<post>\n"), raw, F.lit("\n</post>"))


def ask(posts: DataFrame, extract: Callable[[str, str], str], anchor: str = "fetched_at") -> DataFrame:
    """Add `answer`, what `extract(text, date)` says about each post; a failing call leaves `answer_error`."""

    def call(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            answers, errors = [], []
            for raw, date in zip(part["raw_text"], part["tw_date"]):
                try:
                    answers.append(extract(raw or "", date))
                    errors.append(None)
                except Exception as e:  # one post must not stop the others
                    answers.append(None)
                    errors.append(f"{type(e).__name__}: {e}")
            yield part.drop(columns="tw_date").assign(answer=answers, answer_error=errors)

    kinds = ", ".join(f"`{c}` {t}" for c, t in posts.dtypes)
    dated = posts.withColumn("tw_date", F.date_format(anchor, "yyyy-MM-dd'T'HH:mm:ss"))
    return dated.mapInPandas(call, f"{kinds}, answer string, answer_error string")


def events_of(answer: Column) -> Column:
    """The events of an answer as JSON texts: its `events` list, or itself if it is one event, or none."""
    v = F.try_parse_json(text.strip_fence(answer))
    listed = F.try_variant_get(v, "$.events", "array<variant>")
    single = F.try_variant_get(v, "$.is_event", "string").isNotNull()
    none = F.array().cast("array<string>")
    return F.when(listed.isNotNull(), F.transform(listed, lambda x: F.to_json(x))).when(single, F.array(F.to_json(v))).otherwise(none)


def summarise(events: Column) -> Column:
    """(is_event, confidence) of a post: whether any element is an event, and the largest number given, at least 0."""
    said = F.transform(events, lambda e: F.from_json(e, "struct<is_event:boolean,confidence:double>"))
    return F.struct(F.exists(said, lambda x: F.coalesce(x["is_event"], F.lit(False))).alias("is_event"), F.aggregate(said, F.lit(0.0), lambda a, x: F.greatest(a, F.coalesce(x["confidence"], F.lit(0.0)))).alias("confidence"))


def _field(name: str, default: Column, kind: str = "string") -> Column:
    """A value of the event; the default only where the key is missing, an explicit null stays."""
    return F.when(F.map_contains_key("tw_keys", name), F.get_json_object("event", f"$.{name}").cast(kind)).otherwise(default.cast(kind))


def candidates(posts: DataFrame, s: Settings = DEFAULT) -> DataFrame:
    """One row per event in posts' answers, with defaults; an element that is no object has `error` and nulls.

    posts: source_id, url, raw_text, published_at, fetched_at, answer; other columns stay.
    """
    rows = posts.select("*", F.posexplode(events_of(F.col("answer"))).alias("event_ordinal", "event"))
    # A map of raw values tells a missing key from an explicit null.
    rows = rows.withColumn("tw_keys", F.coalesce(F.from_json("event", "map<string,string>"), F.create_map().cast("map<string,string>")))
    null = F.lit(None)
    defaults = {"title": text.first_line(F.col("raw_text")), "description": F.col("raw_text")}
    stamp = lambda c: F.coalesce(
        F.when(c.rlike(r"(?:Z|[+-]\d{2}:?\d{2})$"), c.try_cast("timestamp")), F.to_utc_timestamp(c.try_cast("timestamp_ntz").cast("timestamp"), s.timezone)
    )
    out = rows.select(
        *posts.columns,
        "event_ordinal",
        F.coalesce(_field("is_event", F.lit(False), "boolean"), F.lit(False)).alias("is_event"),
        _field("confidence", F.lit(0.0), "double").alias("confidence"),
        *[_field(n, defaults.get(n, null)).alias(n) for n in TEXTS],
        *[stamp(_field(n, null)).alias(n) for n in ("start_at", "end_at")],
        *[_field(n, null, "double").alias(n) for n in ("latitude", "longitude")],
        text.keep_texts(F.from_json(F.get_json_object("event", "$.evidence"), "map<string,string>")).alias("evidence"),
        _field("source_url", F.col("url")).alias("source_url"),
        F.when(~F.trim("event").startswith("{"), F.lit("event is not an object")).when(~F.coalesce(_field("confidence", F.lit(0.0), "double").between(0, 1), F.lit(False)), F.lit("confidence is not from 0 to 1")).alias("error"),
    )
    return out


def enrich(rows: DataFrame) -> DataFrame:
    """Fill what a model left open from the post's own words: dates, venue, address, and whether it is an event.

    A post's published_offset (minutes east of UTC, if it has the column) is the zone of the days and clocks in its text:
    they are read from its own local time, and start_at and end_at are the instants that they mean there.
    """
    anchor = F.coalesce("published_at", "fetched_at")
    offset = F.when(F.col("published_at").isNotNull(), F.col("published_offset")) if "published_offset" in rows.columns else F.lit(None).cast("int")
    rows = rows.withColumns({"tw_text": dates.plain(F.col("raw_text")), "tw_offset": F.coalesce(offset, F.lit(0))}).withColumn("tw_anchor", dates.moved(anchor, F.col("tw_offset")))
    utc = lambda t: dates.moved(t, -F.col("tw_offset"))
    found = dates.range_of(F.col("tw_text"), F.col("tw_anchor"))
    rows = rows.withColumn("tw_range", F.when(F.col("start_at").isNull(), found))
    alone = F.when(F.col("tw_range").isNull(), dates.start_of(F.col("tw_text"), F.col("tw_anchor")))
    rows = rows.withColumn("end_at", F.coalesce("end_at", utc(F.col("tw_range.end")))).withColumn("start_at", F.coalesce("start_at", utc(F.coalesce("tw_range.start", alone))))
    full = lambda c: F.when(F.col(c) != "", F.col(c))
    rows = rows.withColumn("venue_name", F.coalesce(full("venue_name"), text.infer_venue(F.col("raw_text")), full("title")))
    rows = rows.withColumn("address", F.coalesce(full("address"), text.infer_address(F.col("raw_text"))))
    return rows.withColumn("is_event", F.col("is_event") | (F.col("start_at").isNotNull() & text.looks_like_event(F.col("raw_text")))).drop("tw_text", "tw_anchor", "tw_range", "tw_offset")


def usable(rows: DataFrame, s: Settings = DEFAULT) -> DataFrame:
    """Candidates worth judging: events, sure enough, not over when fetched; adds processing_status."""
    kept = rows.filter((F.col("error").isNull() if "error" in rows.columns else F.lit(True)) & F.col("is_event") & (F.col("confidence") >= s.confidence_review) & ~F.coalesce(F.col("start_at") < F.col("fetched_at"), F.lit(False)))
    return kept.withColumn("processing_status", F.when(F.col("confidence") < s.confidence_accept, "PENDING_REVIEW").otherwise("ANALYZED"))
