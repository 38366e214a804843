"""Leases that end without a further event of their plan, late events, and the state machine of the batch form."""

import pytest

from textloom.operators import queue as Q
from textloom.streaming import leases as L
from textloom.streaming.queue import run_available

EVENTS = "plan long, seq long, at timestamp, kind string, token string, ok boolean, job long, start long"
pytest.importorskip("google.protobuf")


def run(spark, tmp_path, parts, **more):
    import datetime as dt

    L.prepare(spark)
    at = lambda s: dt.datetime(2024, 1, 1) + dt.timedelta(seconds=s)
    try:
        for i, rows in enumerate(parts):
            spark.createDataFrame([(p, q, at(t), *rest) for p, q, t, *rest in rows], EVENTS).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
            stream = L.journal(spark.readStream.schema(EVENTS).parquet(f"{tmp_path}/in"), **more)
            run_available(stream, f"{tmp_path}/out", f"{tmp_path}/ck", f"leases{i}")
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    zero = dt.datetime(2024, 1, 1)
    return [(r.plan, r.seq, (r["at"] - zero).total_seconds(), r.job, r.token, r.event, r.attempts) for r in spark.read.parquet(f"{tmp_path}/out").collect()]


def job(plan, seq, j, start):
    return (plan, seq, 0, "job", "", True, j, start)


def event(plan, seq, at, kind, token, ok=True):
    return (plan, seq, at, kind, token, ok, None, None)


def test_a_silent_plan_loses_its_lease(spark, tmp_path):
    parts = [
        [job(1, 0, 10, 0), job(1, 1, 11, 50), job(2, 2, 20, 0), event(1, 3, 5, "claim", "a")],
        [event(2, 4, 30, "claim", "b")],  # time goes on in another plan alone
        [event(2, 5, 40, "finish", "b"), event(1, 6, 41, "finish", "a"), event(1, 7, 42, "claim", "c")],
    ]
    got = run(spark, tmp_path, parts, lease=20)
    assert (1, None, 25.0, 10, None, "lease_expired", 1) in got
    seen = sorted((r for r in got if r[1] is not None), key=lambda r: r[1])
    assert seen == [(1, 3, 5.0, 10, "a", "claimed", 1), (2, 4, 30.0, 20, "b", "claimed", 1), (2, 5, 40.0, 20, "b", "done", 1), (1, 6, 41.0, None, "a", "stale_lease", 0), (1, 7, 42.0, 10, "c", "claimed", 2)]


def test_order_within_a_batch_and_late_claims(spark, tmp_path):
    parts = [
        [job(1, 0, 10, 0), event(1, 3, 9, "finish", "a", False), event(1, 2, 5, "claim", "a"), event(1, 5, 12, "claim", "b"), event(2, 9, 100, "claim", "x")],
        [event(2, 10, 101, "claim", "y"), event(1, 6, 95, "claim", "late"), event(1, 7, 60, "claim", "over")],
    ]
    got = run(spark, tmp_path, parts, lease=20, most=5, delay="60 seconds")
    seen = {r[1]: r[5] for r in got if r[1] is not None}
    assert [seen[k] for k in (2, 3, 5, 9)] == ["claimed", "error", "claimed", "nothing"] and seen[6] == "claimed"
    assert sum(r[5] == "lease_expired" and r[3] == 10 for r in got) >= 1


def test_in_order_it_is_the_machine_of_the_batch_form(spark, tmp_path):
    rows = [job(1, k, k, k * 10) for k in range(4)]
    rows += [event(1, 10 + i, 10 + i * 3, "claim" if i % 3 else "finish", f"t{i if i % 3 else i - 1}", i % 2 == 0) for i in range(24)]
    got = run(spark, tmp_path, [rows], lease=1000)
    machine, want = Q.Jobs([(k, k * 10) for k in range(4)], 1000, Q.ATTEMPTS), []
    for p, q, t, kind, token, ok, *_ in rows:
        if kind != "job":
            want += [(p, q, float(t), j, k, e, 0 if j is None else machine.jobs[j]["attempts"]) for j, k, e in machine.apply(kind, t, token, ok)]
    assert sorted((r for r in got if r[1] is not None), key=str) == sorted(want, key=str)
