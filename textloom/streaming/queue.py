"""The extraction queue and the decision journal as stateful streams.

State is kept per plan (per event id) in the stream's state store, so a restart goes on from the
checkpoint of the query and executors can be lost.  Each batch of a plan's events is folded in
order of `seq` by the same machine as the batch form in textloom.operators.queue, whose results
the stream equals, provided that a plan's events arrive in order of `seq`."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from textloom.operators.queue import ATTEMPTS, LEASE, OUT, Jobs

DECIDED = "seq long, event_id string, status string"


def journal(events: DataFrame, lease: float = LEASE, most: int = ATTEMPTS) -> DataFrame:
    """Stream of OUT rows of a stream of (plan, seq, at, kind, token, ok, job, start).

    Rows of kind `job` open a job of the plan; `claim` and `finish` work on those that are open."""

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        machine = Jobs([], lease, most)
        if state.exists:
            machine.jobs = {int(k): v for k, v in json.loads(state.get[0]).items()}
        out = []
        for x in pd.concat(batches).sort_values("seq").itertuples():
            if x.kind == "job":
                machine.jobs.setdefault(int(x.job), {"start": int(x.start), "state": "pending", "attempts": 0, "token": None, "until": 0.0})
                continue
            out += [(key[0], x.seq, x.at, *said) for said in machine.logged(x.kind, x.at, x.token, bool(x.ok))]
        state.update((json.dumps(machine.jobs),))
        yield pd.DataFrame(out, columns=["plan", "seq", "at", "job", "token", "event", "attempts"]).astype({"plan": "int64", "seq": "int64", "at": float, "job": "Int64", "token": object, "event": object, "attempts": "int32"})

    return events.groupBy("plan").applyInPandasWithState(run, OUT, "jobs string", "append", GroupStateTimeout.NoTimeout)


def decisions(events: DataFrame) -> DataFrame:
    """Stream of (seq, event_id, status): the first payload of an event id is saved, the same again is a duplicate, another a conflict.

    Events have a fault of their own in `fault`, or null (textloom.operators.catalogue.decision_faults)."""

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        first = state.get[0] if state.exists else None
        out = []
        for x in pd.concat(batches).sort_values("seq").itertuples():
            if isinstance(x.fault, str):
                out.append((x.seq, key[0], x.fault))
                continue
            out.append((x.seq, key[0], "saved" if first is None else "duplicate" if first == x.payload else "conflict"))
            first = first or x.payload
        if first is not None:
            state.update((first,))
        yield pd.DataFrame(out, columns=["seq", "event_id", "status"])

    return events.groupBy("event_id").applyInPandasWithState(run, DECIDED, "payload string", "append", GroupStateTimeout.NoTimeout)


def coverage(finished: DataFrame, delay: str = "10 minutes") -> DataFrame:
    """Bytes of finished jobs by plan and hour of a stream of (plan, at timestamp, n); later rows than `delay` are dropped."""
    return finished.withWatermark("at", delay).groupBy("plan", F.window("at", "1 hour").alias("hour")).agg(F.sum("n").alias("bytes"), F.count("*").alias("jobs"))


def run_available(stream: DataFrame, path: str, checkpoint: str, name: str) -> None:
    """Works off what is there, appends it to a Parquet table, and stops."""
    q = stream.writeStream.queryName(name).format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()


def new_windows(spark: SparkSession, artifacts: str, plan, path: str, checkpoint: str) -> None:
    """Plans windows of each artifact that arrives in a folder: every micro-batch is planned as a batch and appended once."""
    schema = "doc_id long, text string, n_chars long"

    def each(batch: DataFrame, number: int) -> None:
        plan(batch).write.mode("overwrite").parquet(f"{path}/batch={number}")  # a batch that is run again replaces itself

    q = spark.readStream.schema(schema).parquet(artifacts).writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
