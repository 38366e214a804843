"""The extraction queue with leases that end by themselves: one state entry for each job, and a timer for each lease.

The journal in textloom.streaming.queue sees that a lease is over when the plan's next event comes.  Here the time of the
stream's events (their watermark) ends it: a job whose worker died is open again although its plan is silent.  Only jobs that
events or timers touch are written to the state store, which must be RocksDB's (`prepare`).

Events of a plan are applied in order of (at, seq) within a micro-batch.  An event that arrives later than the watermark allows is
dropped by the engine before it gets here; one that is late, but not that late, is applied when it comes, at its own
time: a claim never starts a lease that is already over by the watermark, and a finish counts only while its lease is alive.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from textloom.operators.queue import ATTEMPTS, LEASE, Jobs

OUT = "plan long, seq long, at timestamp, job long, token string, event string, attempts int"
STATE = "start long, state string, attempts int, token string, until double"


def prepare(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


class Leases(StatefulProcessor):
    def __init__(self, lease: float = LEASE, most: int = ATTEMPTS):
        self.lease, self.most = lease, most

    def init(self, handle) -> None:
        self.handle = handle
        self.held = handle.getMapState("jobs", "job long", STATE)

    def _load(self) -> Jobs:
        machine = Jobs([], self.lease, self.most)
        machine.jobs = {k[0]: dict(zip(("start", "state", "attempts", "token", "until"), v, strict=True)) for k, v in self.held.iterator()}
        return machine

    def _save(self, machine: Jobs, before: dict) -> None:
        for j, x in machine.jobs.items():
            now = (x["start"], x["state"], x["attempts"], x["token"], x["until"])
            if before.get(j) != now:
                self.held.updateValue((j,), now)

    def _rows(self, key, found: list) -> pd.DataFrame:
        out = [(key[0], seq, pd.Timestamp(at, unit="s"), *rest) for seq, at, *rest in found]
        return pd.DataFrame(out, columns=["plan", "seq", "at", "job", "token", "event", "attempts"]).astype({"plan": "int64", "seq": "Int64", "at": "datetime64[ns]", "job": "Int64", "token": object, "event": object, "attempts": "int32"})

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        machine = self._load()
        before = {j: tuple(x.values()) for j, x in machine.jobs.items()}
        mark, out = max(0, timerValues.getCurrentWatermarkInMs()) / 1000, []
        for x in pd.concat(list(rows)).sort_values(["at", "seq"]).itertuples():
            at = x.at.timestamp()
            if x.kind == "job":
                machine.jobs.setdefault(int(x.job), {"start": int(x.start), "state": "pending", "attempts": 0, "token": None, "until": 0.0})
            elif x.kind == "claim" and at + self.lease <= mark:
                out.append((x.seq, at, None, x.token, "too_late", 0))
            else:
                for job, token, event, attempts in machine.logged(x.kind, at, x.token, bool(x.ok)):
                    out.append((x.seq, at, job, token, event, attempts))
                    if event == "claimed":
                        self.handle.registerTimer(int(machine.jobs[job]["until"] * 1000))
        self._save(machine, before)
        yield self._rows(key, out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        machine = self._load()
        before = {j: tuple(x.values()) for j, x in machine.jobs.items()}
        now = expiredTimerInfo.getExpiryTimeInMs() / 1000
        out = [(None, now, j, None, "lease_expired", machine.jobs[j]["attempts"]) for j in machine.expire(now)]
        self._save(machine, before)
        yield self._rows(key, out)

    def close(self) -> None:
        pass


def journal(events: DataFrame, lease: float = LEASE, most: int = ATTEMPTS, delay: str = "0 seconds") -> DataFrame:
    """Stream of OUT rows of a stream of (plan, seq, at timestamp, kind, token, ok, job, start); rows that a timer makes have no seq."""
    timed = events.withWatermark("at", delay).select("plan", "seq", "at", "kind", "token", F.coalesce("ok", F.lit(False)).alias("ok"), "job", "start")
    return timed.groupBy("plan").transformWithStateInPandas(Leases(lease, most), OUT, "Append", "EventTime")
