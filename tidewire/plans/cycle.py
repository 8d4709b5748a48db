"""One whole cycle: from fetched documents to the tables as they are afterwards."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewire.config import DEFAULT, Settings
from tidewire.operators import collect, decide, extract, geoclassify, learn, persist, replay, runs
from tidewire.runtime import materialise
from tidewire.sources import catalogs, feeds

RAW = "source_id string, url string, raw_text string, published_at timestamp, published_offset int, fetched_at timestamp, content_hash string"
EVENTS = "event_id string, slug string, title string, description string, start_at timestamp, end_at timestamp, recurrence_text string, venue_name string, address string, latitude decimal(9,6), longitude decimal(9,6), price_text string, category string, quality_score decimal(4,3), status string"
LINKS = "event_id string, source_id string, source_url string, is_primary boolean"


@dataclass
class State:
    """The stored tables that a cycle reads: sources, posts, events and their links."""

    sources: DataFrame
    raw_contents: DataFrame
    events: DataFrame
    links: DataFrame


@dataclass
class Outcome:
    """What a cycle leaves: the tables for the next one, and what is logged of it."""

    state: State
    results: DataFrame
    logs: dict[str, DataFrame] = field(default_factory=dict)


def event_id_of(candidate_id: Column) -> Column:
    return F.sha2(F.concat(F.lit("event:"), candidate_id), 256).substr(1, 32)


def run_cycle(state: State, fetched: DataFrame, extractor: Callable[[str, str], str], places: DataFrame, answers: DataFrame, now: Column, s: Settings = DEFAULT) -> Outcome:
    """Collect, extract, locate, decide, persist, learn and archive.

    fetched has source_id and body of what was downloaded; extractor(text, date) returns a model's
    answer; answers are geocoding candidates. Sources and posts that fail are logged and stop nothing.
    Everything is derived from its inputs, ids too, so a cycle that is run again adds nothing.
    """
    sources = state.sources.filter("active")
    posts = materialise(feeds.collect(sources, fetched, now).join(sources.select("source_id", (-F.col("reliability_score")).alias("source_rank")), "source_id"), "cycle-posts")
    place = ["source_rank", "source_id", "ordinal"]
    new = materialise(collect.collect_new(posts.filter("error is null").drop("error"), state.raw_contents, [F.col(c) for c in place]), "cycle-new")
    asked = materialise(extract.ask(new, extractor), "cycle-asked")  # a model is asked once
    found = extract.enrich(extract.candidates(asked.filter("answer_error is null"), s))
    usable = extract.usable(found, s).withColumn("classification_id", F.col("content_hash")).withColumn("candidate_id", F.sha2(F.concat("content_hash", F.lit(":"), F.col("event_ordinal").cast("string")), 256))
    located = geoclassify.classify(usable.withColumn("id", F.col("candidate_id")), places, answers, s).drop("id", "reasons", "error", "answer_error")
    located = materialise(located, "cycle-located")
    first = materialise(decide.decide(located, None, now, None, s), "cycle-first")
    events = state.events.withColumn("latitude", F.col("latitude").cast("double")).withColumn("longitude", F.col("longitude").cast("double"))
    final = replay.replay(first, catalogs.open_events(events), place + ["event_ordinal"], s)
    of = F.when(F.col("duplicate_of").startswith("new:"), event_id_of(F.substring("duplicate_of", 5, 64))).otherwise(F.col("duplicate_of"))
    results = first.drop("decision", "reasons", "duplicate_of", "decision_score").join(final.withColumn("duplicate_of", of), "candidate_id")
    results = materialise(results, "cycle-results")
    order = [*place, "event_ordinal"]

    made = persist.new_events(persist.downgrade(results, state.events.select("event_id").union(results.select(event_id_of(F.col("candidate_id"))))), state.events, order)
    made = materialise(made, "cycle-made")
    every = state.events.unionByName(made.drop("candidate_id").select(*state.events.columns))
    carried = materialise(persist.downgrade(results, every), "cycle-carried")
    after, changes = persist.merges(carried, every, order)
    links = persist.links(carried, made, state.links)
    archived = persist.archive(after, now)
    history = learn.update(state.sources, learn.source_stats(carried))
    failures = posts.filter("error is not null").select("source_id", "error", F.lit(True).alias("whole")).unionByName(asked.filter("answer_error is not null").select("source_id", F.col("answer_error").alias("error"), F.lit(False).alias("whole")))
    next_state = State(
        materialise(learn.apply(state.sources, history), "cycle-sources"),
        materialise(state.raw_contents.unionByName(new.select(*state.raw_contents.columns)), "cycle-raw"),
        materialise(archived.drop("archived_now"), "cycle-events"),
        materialise(state.links.unionByName(links.select(*state.links.columns)), "cycle-links"),
    )
    logs = {
        "classifications": persist.classifications(asked.withColumn("raw_content_id", F.col("content_hash")), None, "v2"),
        "decisions": persist.decisions(carried),
        "reviews": persist.review_items(carried),
        "changes": changes,
        "score_history": history,
        "source_runs": runs.source_runs(new, results, failures),
        "counters": runs.counters(results),
        "archived": archived.agg(F.count_if("archived_now").alias("events_archived")),
        "status": failures.agg(F.count_if("whole").alias("a"), F.count_if(~F.col("whole")).alias("b")).select(runs.status(F.col("a"), F.col("b")).alias("status")),
    }
    return Outcome(next_state, results, logs)
