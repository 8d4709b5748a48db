"""Commands: seed the source catalog, repair repeated sources, run one cycle, empty tables.

    python -m tidewire.cli seed --catalog sources.json --store /data/state --dry-run
    python -m tidewire.cli repair --store /data/state --dry-run
    python -m tidewire.cli cycle --store /data/state --fetched /data/fetched --catalog places.json --extractor shop.model:extract
    python -m tidewire.cli empty --store /data/state --store /data/other

A store is a folder of versions (store.Versions): a command that breaks off leaves the version before it, and one
that another overtook fails instead of overwriting. A cycle holds the store's lock while it runs.
"""

from __future__ import annotations

import argparse
import importlib
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewire.operators import runs, source_admin
from tidewire.plans import cycle
from tidewire.runtime import materialise
from tidewire.sources import catalogs, providers
from tidewire.store import Lock, Versions

STORED = "source_id string, name string, base_url string, canonical_base_url string, adapter_type string, active boolean, reliability_score double, created_at timestamp"
#: The tables of a store; each is there from the first version on, if only empty.
TABLES = {"sources": STORED, "raw_contents": cycle.RAW, "events": cycle.EVENTS, "links": cycle.LINKS}
#: A run that is older may be taken for dead.
LOCK = "_running"


def state(spark: SparkSession, store: str) -> tuple[dict[str, DataFrame], int, Versions]:
    """A store's tables, the version they are of (-1: none yet), and its versions."""
    versions = Versions(spark, store)
    last = versions.latest()
    known = versions.entry(last)["schemas"] if last >= 0 else {}
    return {n: versions.read(last, n) if n in known else spark.createDataFrame([], kinds) for n, kinds in TABLES.items()}, last, versions


def stored(spark: SparkSession, store: str) -> tuple[DataFrame, int]:
    """The stored sources and their version."""
    tables, last, _ = state(spark, store)
    return tables["sources"], last


def seed(spark: SparkSession, catalog: str, store: str, dry_run: bool) -> str:
    """Load a catalog into the stored sources; only counts its entries in a dry run."""
    entries = catalogs.read_sources(spark, catalog)
    if dry_run:
        return f"DRY_RUN configured={entries.count()} dataset={catalog}"
    tables, base, versions = state(spark, store)
    known = tables["sources"]
    actions = materialise(source_admin.catalog_actions(entries, known), "cli-actions")
    last = actions.filter("action <> 'invalid'").groupBy("canonical_base_url").agg(F.max_by(F.struct("name", "base_url", "adapter_type", "active", "reliability_score"), "ordinal").alias("x"))
    fresh = last.select(F.sha2("canonical_base_url", 256).alias("source_id"), "x.name", "x.base_url", "canonical_base_url", "x.adapter_type", "x.active", "x.reliability_score", F.current_timestamp().alias("created_at"))
    old = known.select("canonical_base_url", F.col("source_id").alias("old_id"), F.col("created_at").alias("old_at"))
    fresh = fresh.join(old, "canonical_base_url", "left").withColumn("source_id", F.coalesce("old_id", "source_id")).withColumn("created_at", F.coalesce("old_at", "created_at"))
    kept = known.join(last.select("canonical_base_url"), "canonical_base_url", "left_anti")
    versions.commit(tables | {"sources": fresh.select(*known.columns).unionByName(kept.select(*known.columns))}, base)
    n = {r["action"]: r["n"] for r in actions.groupBy("action").agg(F.count("*").alias("n")).collect()}
    return f"BOOTSTRAP configured={sum(n.values())} inserted={n.get('inserted', 0)} updated={n.get('updated', 0)} unchanged={n.get('unchanged', 0)} invalid={n.get('invalid', 0)}"


def repair(spark: SparkSession, store: str, dry_run: bool) -> str:
    """Deactivate repeats of stored sources; only counts them in a dry run."""
    tables, base, versions = state(spark, store)
    found = materialise(source_admin.repair_duplicates(tables["sources"]), "cli-repair")
    n = {r["repair"]: r["n"] for r in found.groupBy("repair").agg(F.count("*").alias("n")).collect()}
    if not dry_run:
        versions.commit(tables | {"sources": found.select(*tables["sources"].columns)}, base)
    return f"{'DRY_RUN' if dry_run else 'REPAIR'} survivors={n.get('survivor', 0)} losers={n.get('loser', 0)} realigned={n.get('realign', 0)}"


def run_once(spark: SparkSession, store: str, fetched: DataFrame, places: DataFrame, extractor, answers: DataFrame | None = None, now=None, execution_id: str | None = None) -> str:
    """One cycle over a store's tables and what was fetched (source_id, body); its results and logs become the next version.

    Fails at once while another cycle holds the store's lock. A cycle that breaks off commits nothing and frees the lock;
    the same posts are then new to the next one.
    """
    now = F.current_timestamp() if now is None else now
    lock = Lock(spark, f"{store.rstrip('/')}/{LOCK}")
    run = runs.open_run(lock, execution_id or uuid.uuid4().hex, "manual", now)
    try:
        tables, base, versions = state(spark, store)
        answers = providers.any_answer(spark.createDataFrame([], "query string, payload string")) if answers is None else answers
        out = cycle.run_cycle(cycle.State(tables["sources"], tables["raw_contents"], tables["events"], tables["links"]), fetched, extractor, places, answers, now)
        after = {"sources": out.state.sources, "raw_contents": out.state.raw_contents, "events": out.state.events, "links": out.state.links}
        status = out.logs["status"].first()["status"]
        number = versions.commit(after | {"results": out.results} | {f"log_{k}": v for k, v in out.logs.items()}, base)
        counted = out.logs["counters"].first().asDict()
    except Exception as e:
        runs.close_run(lock, run, now, "FAILED", str(e)[:2000])
        raise
    runs.close_run(lock, run, now, status)
    return f"{status} version={number} " + " ".join(f"{k.removeprefix('events_')}={v}" for k, v in counted.items())


def empty(spark: SparkSession, stores: list[str]) -> list[tuple[str, int, int]]:
    """Commit a version of each store whose tables have no rows: (store, rows before, rows after). The version before stays until vacuum()."""
    out = []
    for path in stores:
        versions = Versions(spark, path)
        base = versions.latest()
        tables = {n: versions.read(base, n) for n in versions.entry(base)["schemas"]}
        before = sum(t.count() for t in tables.values())
        last = versions.commit({n: spark.createDataFrame([], t.schema) for n, t in tables.items()}, base)
        out.append((path, before, sum(versions.read(last, n).count() for n in tables)))
    return out


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    parser = argparse.ArgumentParser(prog="tidewire")
    commands = parser.add_subparsers(dest="command", required=True)
    for name in ("seed", "repair", "cycle", "empty"):
        p = commands.add_parser(name)
        p.add_argument("--store", required=True, action="append" if name == "empty" else "store")
        if name in ("seed", "repair"):
            p.add_argument("--dry-run", action="store_true")
        if name in ("seed", "cycle"):
            p.add_argument("--catalog", required=True, help="sources to seed, or places to locate in")
        if name == "cycle":
            p.add_argument("--fetched", required=True, help="a folder of JSON lines with source_id and body")
            p.add_argument("--extractor", required=True, help="module:function that answers (text, date)")
            p.add_argument("--answers", help="a folder of parquet with geocoders' candidates")
            p.add_argument("--now", help="a timestamp; by default the present")
    args = parser.parse_args(argv)
    spark = spark or SparkSession.builder.appName("tidewire").getOrCreate()
    if args.command == "seed":
        print(seed(spark, args.catalog, args.store, args.dry_run))
    elif args.command == "repair":
        print(repair(spark, args.store, args.dry_run))
    elif args.command == "cycle":
        module, _, function = args.extractor.partition(":")
        fetched = spark.read.schema("source_id string, body string").json(args.fetched)
        answers = spark.read.parquet(args.answers) if args.answers else None
        now = F.lit(args.now).cast("timestamp") if args.now else None
        try:
            print(run_once(spark, args.store, fetched, catalogs.read_places(spark, args.catalog), getattr(importlib.import_module(module), function), answers, now))
        except runs.AlreadyRunning as e:
            print(f"ALREADY_RUNNING {e}")
            return 1
    else:
        for path, before, after in empty(spark, args.store):
            print(f"EMPTIED {path} before={before} after={after}")
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
