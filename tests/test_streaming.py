"""Streams against their batch forms."""

import random

import pandas as pd
from textloom.operators import queue as Q
from textloom.streaming import queue as S

EVENTS = "plan long, seq long, at double, kind string, token string, ok boolean, job long, start long"


def made(seed=1):
    rng = random.Random(seed)
    out, seq = [], 0
    for plan in range(3):
        for j in range(4):
            out.append((plan, seq, 0.0, "job", "", True, plan * 10 + j, j * 100))
            seq += 1
        held = []
        for k in range(60):
            at = k * rng.choice([1.0, 5.0])
            if rng.random() < 0.5:
                held.append(f"t{seq}")
                out.append((plan, seq, at + k * 10, "claim", held[-1], True, None, None))
            else:
                out.append((plan, seq, at + k * 10, "finish", rng.choice(held[-3:] or ["none"]), rng.random() < 0.6, None, None))
            seq += 1
    return out


def test_claims_leases_and_attempts():
    m = Q.Jobs([(1, 0), (2, 10)], lease=10, most=3)
    assert m.claim(100, "a") == [(1, "a", "claimed")] and m.claim(100, "b") == [(2, "b", "claimed")]
    assert m.claim(111, "c") == [(1, None, "lease_expired"), (2, None, "lease_expired"), (1, "c", "claimed")]
    assert m.finish(112, "a", True) == [(None, "a", "stale_lease")] and m.finish(112, "c", False) == [(1, "c", "error")]
    assert m.claim(113, "d") == [(1, "d", "claimed")] and m.finish(113, "d", False) == [(1, "d", "error")]
    assert m.claim(114, "e") == [(2, "e", "claimed")] and m.finish(124, "e", True) == [(None, "e", "stale_lease")]
    assert m.finish(115, "e", True) == [(2, "e", "done")] and m.claim(116, "f") == [(None, "f", "nothing")]


def test_stream_over_restarts_equals_the_batch_fold(spark, tmp_path):
    rows = made()
    every = spark.createDataFrame(rows, EVENTS)
    batch = Q.fold(every.where("kind = 'job'").select("plan", "job", "start"), every.where("kind <> 'job'").select("plan", "seq", "at", "kind", "token", "ok"), lease=40, most=3)
    want = sorted(map(str, (tuple(r) for r in batch.collect())))
    for part in range(3):  # a run for each part: the state comes back from the checkpoint
        some = [r for r in rows if (r[1] - r[0] * 64) // 22 == part]
        spark.createDataFrame(some, EVENTS).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        stream = S.journal(spark.readStream.schema(EVENTS).parquet(f"{tmp_path}/in"), lease=40, most=3)
        S.run_available(stream, f"{tmp_path}/out", f"{tmp_path}/ck", f"queue{part}")
    assert sorted(map(str, (tuple(r) for r in spark.read.parquet(f"{tmp_path}/out").collect()))) == want
    states = Q.states(every.where("kind = 'job'").select("plan", "job"), batch).collect()
    machine = {p: Q.Jobs([(r[6], r[7]) for r in rows if r[0] == p and r[3] == "job"], 40, 3) for p in range(3)}
    for r in sorted(rows, key=lambda x: x[1]):
        if r[3] != "job":
            machine[r[0]].apply(r[3], r[2], r[4], r[5])
    assert {(r.plan, r.job): (r.state, r.attempts) for r in states} == {(p, j): (x["state"], x["attempts"]) for p, m in machine.items() for j, x in m.jobs.items()}


def test_decision_stream(spark, tmp_path):
    schema = "seq long, event_id string, payload string, fault string"
    parts = [[(1, "a", "x", None), (2, "b", "y", "unknown_action"), (3, "a", "x", None)], [(4, "a", "z", None), (5, "b", "y", None), (6, "b", "y", None)]]
    for i, p in enumerate(parts):
        spark.createDataFrame(p, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        S.run_available(S.decisions(spark.readStream.schema(schema).parquet(f"{tmp_path}/in")), f"{tmp_path}/out", f"{tmp_path}/ck", f"decisions{i}")
    got = [r.status for r in spark.read.parquet(f"{tmp_path}/out").orderBy("seq").collect()]
    assert got == ["saved", "unknown_action", "duplicate", "conflict", "saved", "duplicate"]


def test_coverage_by_hour_and_new_windows(spark, tmp_path):
    from textloom.operators import evidence as E

    pdf = pd.DataFrame({"plan": [1, 1, 2], "at": pd.to_datetime(["2024-01-01 00:10", "2024-01-01 00:50", "2024-01-01 05:00"]), "n": [3, 4, 5]})
    spark.createDataFrame(pdf).write.parquet(f"{tmp_path}/in")
    out = S.coverage(spark.readStream.schema("plan long, at timestamp, n long").parquet(f"{tmp_path}/in"))
    q = out.writeStream.format("memory").queryName("covered").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted((r.plan, r.bytes, r.jobs) for r in spark.table("covered").collect()) == [(1, 7, 2), (2, 5, 1)]
    for i in range(2):
        spark.createDataFrame([(i, "x" * 1000, 1000)], "doc_id long, text string, n_chars long").write.mode("append").parquet(f"{tmp_path}/texts")
        S.new_windows(spark, f"{tmp_path}/texts", lambda b: E.windows(b, "n_chars", 800, 100), f"{tmp_path}/windows", f"{tmp_path}/wck")
    assert sorted((r.doc_id, r.start, r.end) for r in spark.read.parquet(f"{tmp_path}/windows").collect()) == [(i, s, e) for i in range(2) for s, e in ((0, 800), (700, 1000))]
