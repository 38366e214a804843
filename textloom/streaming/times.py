"""Event time: sessions of a plan's work, and claims joined with their results while a lease lasts.

Both keep state only as far back as their watermarks reach; rows later than that are dropped, and batch tables give the same."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def sessions(events: DataFrame, key: str, at: str, gap: str = "30 minutes", delay: str = "10 minutes", value: str | None = None) -> DataFrame:
    """key, start, end, n, total of runs of events that are less than `gap` apart; a stream hands one on once the watermark has passed its end."""
    timed = events.withWatermark(at, delay) if events.isStreaming else events
    total = F.sum(value) if value else F.count("*")
    return timed.groupBy(key, F.session_window(at, gap).alias("w")).agg(F.count("*").alias("n"), total.alias("total")).select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n", "total")


def results_of_claims(claims: DataFrame, results: DataFrame, keys: list[str], lease: str = "15 minutes", delay: str = "10 minutes", how: str = "inner") -> DataFrame:
    """claims(keys, claimed_at) with the results(keys, finished_at, ...) that came within the lease; `leftOuter` also has the claims without one.

    The interval and both watermarks bound the state: a claim waits for lease and delay, a result for the delay of claims."""
    if claims.isStreaming:
        claims = claims.withWatermark("claimed_at", delay)
    if results.isStreaming:
        results = results.withWatermark("finished_at", delay)
    c, r = claims.alias("c"), results.alias("r")
    on = [F.col(f"c.{k}") == F.col(f"r.{k}") for k in keys]
    on += [F.col("r.finished_at") >= F.col("c.claimed_at"), F.col("r.finished_at") < F.col("c.claimed_at") + F.expr(f"interval {lease}")]
    rest = [F.col(f"r.{x}") for x in results.columns if x not in keys]
    return c.join(r, on, how).select(*[F.col(f"c.{x}") for x in claims.columns], *rest)
