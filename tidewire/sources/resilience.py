"""How clients of a service hold back: spaced calls, growing waits, a breaker that opens after failures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def backoff(attempt: Column, base_seconds: float, jitter_seconds: float, draw: Column | None = None) -> Column:
    """Seconds to wait before a repeated attempt (0 is the first): base * 2 ** attempt, and a part of the jitter.

    draw is a number from 0 to 1; without one it is random.
    """
    return F.lit(base_seconds) * F.pow(F.lit(2.0), attempt) + (F.rand() if draw is None else draw) * F.lit(max(jitter_seconds, 0.0))


def spaced(calls: DataFrame, gap_seconds: float, key: str = "service", at: str = "at") -> DataFrame:
    """Add starts_at to calls of services: as asked (seconds), but never sooner than a gap after the call before.

    The n-th call starts at the latest of all earlier requests, each with the gaps of the calls since; so
    one running maximum says it, without a step from call to call.
    """
    gap = max(gap_seconds, 0.0)
    order = Window.partitionBy(key).orderBy(at, *[c for c in calls.columns if c not in (key, at)])
    numbered = calls.withColumn("tw_n", F.row_number().over(order))
    reached = F.max(F.col(at) - F.col("tw_n") * gap).over(order.rowsBetween(Window.unboundedPreceding, 0))
    return numbered.withColumn("starts_at", reached + F.col("tw_n") * gap).drop("tw_n")


class Breaker:
    """Refuses calls for a while after so many failures in a row; times are seconds of any clock."""

    def __init__(self, most_failures: int, rest_seconds: float):
        self.most, self.rest = max(most_failures, 1), max(rest_seconds, 1.0)
        self.failed, self.shut_since = 0, None

    def allows(self, now: float) -> bool:
        if self.shut_since is not None and now - self.shut_since < self.rest:
            return False
        if self.shut_since is not None:
            self.succeeded()
        return True

    def succeeded(self) -> None:
        self.failed, self.shut_since = 0, None

    def failed_at(self, now: float) -> None:
        self.failed += 1
        if self.failed >= self.most:
            self.shut_since = now


def guarded(calls: DataFrame, most_failures: int, rest_seconds: float, key: str = "service", at: str = "at", ok: str = "ok") -> DataFrame:
    """Which calls of services a breaker lets through: key, at, ok, allowed; calls are taken in the order of at, then ok.

    One service's log is one group, as its breaker is one state.
    """
    import pandas as pd

    def of_service(part: pd.DataFrame) -> pd.DataFrame:
        breaker, out = Breaker(most_failures, rest_seconds), []
        part = part.sort_values([at, ok], kind="stable")
        for now, good in zip(part[at], part[ok]):
            out.append(breaker.allows(now))
            if out[-1]:
                breaker.succeeded() if good else breaker.failed_at(now)
        return part.assign(allowed=out)

    rows = calls.select(key, F.col(at).cast("double").alias(at), F.col(ok).cast("boolean").alias(ok))
    return rows.groupBy(key).applyInPandas(of_service, f"{rows.schema[key].name} {rows.schema[key].dataType.simpleString()}, {at} double, {ok} boolean, allowed boolean")
