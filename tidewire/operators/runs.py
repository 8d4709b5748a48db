"""The log of cycles: opening, closing, timing out, counting, showing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewire.store import Lock

COUNTERS = {"events_accepted": "ACCEPT", "events_merged": "MERGE", "events_reviewed": "REVIEW", "events_rejected": "REJECT"}


class AlreadyRunning(Exception):
    """Another cycle holds the lock."""


def open_run(lock: Lock, execution_id: str, triggered_by: str, now: Column) -> DataFrame:
    """The row of a new run, which holds the lock from here on; fails while another run holds it, on whichever driver."""
    if not lock.take(execution_id):
        raise AlreadyRunning(lock.holder())
    return lock.spark.range(1).select(F.lit(execution_id).alias("execution_id"), F.lit("RUNNING").alias("status"), F.lit(triggered_by).alias("triggered_by"), now.alias("started_at"))


def close_run(lock: Lock, run: DataFrame, now: Column, ended: str = "COMPLETED", error: str | None = None) -> DataFrame:
    """The row of a run that ended; its lock is free again, unless a watchdog gave it to another."""
    lock.release(run.first()["execution_id"])
    return run.withColumns({"status": F.lit(ended), "finished_at": now, "error_message": F.lit(error).cast("string")})


def running(runs: DataFrame) -> DataFrame:
    return runs.filter("status = 'RUNNING'")


def counters(results: DataFrame) -> DataFrame:
    """Decisions by kind, as they were made and before any downgrade."""
    return results.agg(*[F.count_if(F.col("decision") == d).alias(n) for n, d in COUNTERS.items()])


def status(sources_failed: Column, items_failed: Column, error: Column | None = None) -> Column:
    s = F.when((F.coalesce(sources_failed, F.lit(0)) > 0) | (F.coalesce(items_failed, F.lit(0)) > 0), "PARTIAL").otherwise("COMPLETED")
    return s if error is None else F.when(error.isNotNull(), "FAILED").otherwise(s)


def source_runs(posts: DataFrame, results: DataFrame, failures: DataFrame) -> DataFrame:
    """Per source: items collected, accepted and failed, and what its run says.

    posts (source_id), results (source_id, decision), failures (source_id, error, whole: the source itself failed).
    """
    got = posts.groupBy("source_id").agg(F.count("*").alias("collected"))
    good = results.groupBy("source_id").agg(F.count_if(F.col("decision").isin("ACCEPT", "MERGE")).alias("accepted"))
    bad = failures.groupBy("source_id").agg(F.count_if(~F.col("whole")).alias("failed"), F.max(F.when(F.col("whole"), F.substring("error", 1, 2000))).alias("error"))
    rows = got.join(good, "source_id", "full_outer").join(bad, "source_id", "full_outer").na.fill(0, ["collected", "accepted", "failed"])
    down = F.col("error").isNotNull()
    return rows.select("source_id", F.when(down, "FAILED").otherwise("COMPLETED").alias("status"), F.when(down, 0).otherwise(F.col("collected")).alias("items_collected"), F.when(down, 0).otherwise(F.col("accepted")).alias("items_accepted"), F.when(down, F.col("error")).when(F.col("failed") > 0, F.concat(F.col("failed").cast("string"), F.lit(" item(s) failed"))).alias("error_message"))


def timed_out(runs: DataFrame, now: Column, minutes: int) -> DataFrame:
    return runs.filter((F.col("status") == "RUNNING") & (F.col("started_at") <= now - F.make_dt_interval(F.lit(0), F.lit(0), F.lit(minutes))))


def reap(runs: DataFrame, now: Column, minutes: int) -> DataFrame:
    """Runs that hang become FAILED."""
    late = (F.col("status") == "RUNNING") & (F.col("started_at") <= now - F.make_dt_interval(F.lit(0), F.lit(0), F.lit(minutes)))
    out = runs.withColumn("tw_late", late)
    late = F.col("tw_late")
    return out.withColumn("status", F.when(late, "FAILED").otherwise(F.col("status"))).withColumn("error_message", F.when(late, F.lit("timed out"))).withColumn("finished_at", F.when(late, now)).drop("tw_late")


def dashboard(runs: DataFrame) -> DataFrame:
    """Totals of runs (status, items_collected, items_failed, events_rejected); nulls count as none."""
    n = lambda c: F.coalesce(F.col(c), F.lit(0))
    return runs.agg(*[F.count_if(F.col("status") == s).alias(s.lower()) for s in ("RUNNING", "FAILED", "PARTIAL")], F.coalesce(F.sum(n("items_collected")), F.lit(0)).alias("total_collected"), F.coalesce(F.sum(n("items_failed") + n("events_rejected")), F.lit(0)).alias("total_excluded"))


def shown(runs: DataFrame, mode: str = "recent") -> list[Column]:
    """The order of runs on screen: recent, failed (failures first) or running (running ones first, failures last)."""
    s = F.col("status")
    ranks = {
        "failed": F.when(s == "FAILED", 0).when(s == "PARTIAL", 1).when(s == "RUNNING", 2).otherwise(3),
        "running": F.when(s == "RUNNING", 0).when(s == "PARTIAL", 1).when(s == "FAILED", 3).otherwise(2),
    }
    return [*([] if mode == "recent" else [ranks[mode]]), F.desc("started_at"), F.col("execution_id")]


def detail(runs: DataFrame, by_source: DataFrame) -> DataFrame:
    """Runs with an array of what each source's part did."""
    parts = by_source.groupBy("execution_id").agg(F.sort_array(F.collect_list(F.struct("source_id", "status", "items_collected", "items_accepted"))).alias("sources"))
    return runs.join(parts, "execution_id", "left")


def metrics_json(*cols: str) -> Column:
    return F.to_json(F.struct(*cols))
