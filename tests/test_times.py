"""Sessions and interval joins of streams against their batch forms, with late rows and state that is let go."""

import datetime as dt

from textloom.streaming import times as T

ZERO = dt.datetime(2024, 1, 1)


def at(m):
    return ZERO + dt.timedelta(minutes=m)


def start(stream, tmp_path, name):
    return stream.writeStream.queryName(name).format("memory").option("checkpointLocation", f"{tmp_path}/ck").outputMode("append").start()


def put(spark, tmp_path, name, rows, schema):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/{name}")


def test_sessions_with_late_rows_and_cleaned_state(spark, tmp_path):
    schema = "plan long, at timestamp, v long"
    parts = [[(1, at(0), 1), (1, at(20), 2), (2, at(5), 4)], [(1, at(45), 8), (2, at(100), 16)], [(1, at(10), 32), (2, at(101), 64)], [(3, at(500), 1)], [(3, at(501), 1)]]
    put(spark, tmp_path, "in", parts[0], schema)
    q = start(T.sessions(spark.readStream.schema(schema).parquet(f"{tmp_path}/in"), "plan", "at", value="v"), tmp_path, "sessions")
    try:
        for p in [None, *parts[1:]]:
            if p:
                put(spark, tmp_path, "in", p, schema)
            q.processAllAvailable()
        got = sorted((r.plan, r.start, r.end, r.n, r.total) for r in spark.table("sessions").collect())
        held, late = q.lastProgress["stateOperators"][0]["numRowsTotal"], sum(p["stateOperators"][0]["numRowsDroppedByWatermark"] for p in q.recentProgress if p["stateOperators"])
    finally:
        q.stop()
    on_time = [r for i, p in enumerate(parts) for r in p if i != 2 or r[0] == 2]  # the third part's first row came after its time
    batch = T.sessions(spark.createDataFrame(on_time, schema), "plan", "at", value="v").where("plan <> 3")
    assert got == sorted((r.plan, r.start, r.end, r.n, r.total) for r in batch.collect()) and len(got) == 3
    assert held == 1 and late >= 1  # the open session alone


def test_claims_and_results_within_a_lease(spark, tmp_path):
    cs, rs = "token string, claimed_at timestamp", "token string, finished_at timestamp, ok boolean"
    claims = [[("a", at(0)), ("b", at(1)), ("c", at(2))], [("d", at(60))], [("e", at(300))], [("f", at(301))]]
    results = [[("a", at(5), True), ("b", at(16), False)], [("c", at(16), True), ("d", at(74), True), ("zz", at(61), True)], [("e", at(314), False)], [("f", at(316), True)]]
    for name, parts, schema in (("c", claims, cs), ("r", results, rs)):
        put(spark, tmp_path, name, parts[0], schema)
    read = lambda n, s: spark.readStream.schema(s).parquet(f"{tmp_path}/{n}")
    q = start(T.results_of_claims(read("c", cs), read("r", rs), ["token"]), tmp_path, "claimed")
    try:
        for i in range(4):
            if i:
                put(spark, tmp_path, "c", claims[i], cs)
                put(spark, tmp_path, "r", results[i], rs)
            q.processAllAvailable()
        got = sorted((r.token, r.claimed_at, r.finished_at, r.ok) for r in spark.table("claimed").collect())
        held = q.lastProgress["stateOperators"][0]["numRowsTotal"]
    finally:
        q.stop()
    whole = lambda parts, s: spark.createDataFrame([r for p in parts for r in p], s)
    batch = T.results_of_claims(whole(claims, cs), whole(results, rs), ["token"])
    assert got == sorted((r.token, r.claimed_at, r.finished_at, r.ok) for r in batch.collect()) and [r[0] for r in got] == ["a", "c", "d", "e"]
    assert held <= 4  # claims and results of the first hour are gone
    outer = T.results_of_claims(whole(claims, cs), whole(results, rs), ["token"], how="leftOuter")
    assert sorted(r.token for r in outer.where("finished_at is null").collect()) == ["b", "f"]
