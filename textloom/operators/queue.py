"""The extraction queue as batch operators: plans, a fold of claims and results over ordered events, budgets.

An event is (plan, at, seq, kind, job, token, ok); folds are per plan.  The stream form is textloom.streaming.queue."""

from __future__ import annotations


import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textloom.functions import raw as R

LEASE, ATTEMPTS = 900.0, 3
OUT = "plan long, seq long, at double, job long, token string, event string, attempts int"


def plan_id(work: Column, source: Column, zones: Column, profile: Column, window: Column, overlap: Column, target: Column) -> Column:
    """Digest of what a plan is made of; where its text lies is no part of it."""
    return F.sha2(R.canonical(work_id=work.cast("string"), source_sha=R.quoted(source), zones_sha=R.quoted(zones), profile=R.quoted(profile), window_size=window.cast("string"), overlap=overlap.cast("string"), target_bytes=target.cast("string")), 256)


class Jobs:
    """State machine of one plan: expired leases return, the lowest job open is claimed, only the holder of a live lease finishes."""

    def __init__(self, jobs: list[tuple], lease: float = LEASE, most: int = ATTEMPTS):
        self.jobs = {j: {"start": start, "state": "pending", "attempts": 0, "token": None, "until": 0.0} for j, start in jobs}
        self.lease, self.most = lease, most

    def expire(self, now: float) -> list[int]:
        late = sorted(j for j, x in self.jobs.items() if x["state"] == "running" and x["until"] <= now)
        for j in late:
            self.jobs[j].update(state="error", token=None)
        return late

    def claim(self, now: float, token: str) -> list[tuple]:
        out = [(j, None, "lease_expired") for j in self.expire(now)]
        open_ = [(x["start"], j) for j, x in self.jobs.items() if x["state"] in ("pending", "error") and x["attempts"] < self.most]
        if not open_:
            return [*out, (None, token, "nothing")]
        j = min(open_)[1]
        x = self.jobs[j]
        x.update(state="running", attempts=x["attempts"] + 1, token=token, until=now + self.lease)
        return [*out, (j, token, "claimed")]

    def finish(self, now: float, token: str, ok: bool) -> list[tuple]:
        for j, x in self.jobs.items():
            if x["state"] == "running" and x["token"] == token and x["until"] > now:
                x.update(state="done" if ok else "error", token=None)
                return [(j, token, x["state"])]
        return [(None, token, "stale_lease")]

    def apply(self, kind: str, now: float, token: str, ok: bool) -> list[tuple]:
        return self.claim(now, token) if kind == "claim" else self.finish(now, token, ok)

    def logged(self, kind: str, now: float, token: str, ok: bool) -> list[tuple]:
        """What apply says, each entry with the attempts of its job at that moment: a lease ends before the claim that finds it over."""
        late = [(j, None, "lease_expired") for j in self.expire(now)] if kind == "claim" else []
        out = [(*x, self.jobs[x[0]]["attempts"]) for x in late]
        return out + [(*x, 0 if x[0] is None else self.jobs[x[0]]["attempts"]) for x in self.apply(kind, now, token, ok)]


def fold(jobs: DataFrame, events: DataFrame, lease: float = LEASE, most: int = ATTEMPTS) -> DataFrame:
    """plan, seq, at, job, token, event, attempts: the journal that events(plan, seq, at, kind, token, ok) make on jobs(plan, job, start).

    Plans run in parallel; one plan's jobs and events are folded in one task, in order."""

    def run(key, j: pd.DataFrame, e: pd.DataFrame) -> pd.DataFrame:
        machine, out = Jobs(list(zip(j.job.tolist(), j.start.tolist(), strict=True)), lease, most), []
        for x in e.sort_values("seq").itertuples():
            out += [(key[0], x.seq, x.at, *said) for said in machine.logged(x.kind, x.at, x.token, bool(x.ok))]
        return pd.DataFrame(out, columns=["plan", "seq", "at", "job", "token", "event", "attempts"]).astype({"job": "Int64"})

    return jobs.groupBy("plan").cogroup(events.groupBy("plan")).applyInPandas(run, OUT)


def states(jobs: DataFrame, journal: DataFrame) -> DataFrame:
    """plan, job, state, attempts after a journal; a job that it does not name is pending."""
    last = journal.where("job is not null").groupBy("plan", "job").agg(F.max_by(F.struct("event", "attempts"), F.struct("seq", (F.col("event") != "lease_expired").alias("later"))).alias("l"))
    state = F.when(F.col("l").isNull(), "pending").when(F.col("l.event") == "claimed", "running").when(F.col("l.event") == "done", "done").otherwise("error")
    return jobs.join(last, ["plan", "job"], "left").select(*jobs.columns, state.alias("state"), F.coalesce("l.attempts", F.lit(0)).alias("attempts"))


def budget(calls: DataFrame, key: str, order: str, most_seconds: float = 3600, most_in: int = 300_000, most_out: int = 20_000) -> DataFrame:
    """calls(…, at seconds since the start, tokens_in, tokens_out, failed) with `stop`: the first reason, before each call, not to make it.

    Unknown use counts as the reserve, 8,192 tokens in and 512 out."""
    before = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    total = lambda c: F.coalesce(F.sum(c).over(before), F.lit(0))
    bad = F.col("failed").cast("int")
    run = calls.withColumn("_in", total(F.coalesce("tokens_in", F.lit(8192)))).withColumn("_out", total(F.coalesce("tokens_out", F.lit(512))))
    run = run.withColumn("_bad", total(bad)).withColumn("_n", F.count("*").over(before)).withColumn("_good", total(1 - bad))
    # errors since the last success: those after as many successes as there are now
    own = Window.partitionBy(key, "_good").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    run = run.withColumn("_row", F.coalesce(F.sum(bad).over(own), F.lit(0)))
    stop = (
        F.when(F.col("at") >= most_seconds, "time_budget")
        .when(F.col("_in") + 8192 > most_in, "input_budget")
        .when(F.col("_out") + 512 > most_out, "output_budget")
        .when(F.col("_row") >= 3, "consecutive_errors")
        .when((F.col("_n") >= 10) & (F.col("_bad") * 10 > F.col("_n")), "error_rate")
    )
    return run.withColumn("stop", stop).drop("_in", "_out", "_bad", "_n", "_good", "_row")


def bounded_run(results: DataFrame, key: str, order: str, most: int) -> DataFrame:
    """Rows of a run that happen: up to `most`, and none after the first error."""
    before = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    n = Window.partitionBy(key).orderBy(order)
    done = results.withColumn("_n", F.row_number().over(n)).withColumn("_bad", F.coalesce(F.max(F.col("failed").cast("int")).over(before), F.lit(0)))
    return done.where((F.col("_n") <= most) & (F.col("_bad") == 0)).drop("_n", "_bad")


def undrifted(read: DataFrame, published: DataFrame, key: str) -> DataFrame:
    """Rows read whose hash is still the same when their result is published; others drift."""
    now = published.select(key, F.col("sha256").alias("_now"))
    return read.join(now, key, "left").withColumn("drift", ~F.col("sha256").eqNullSafe(F.col("_now"))).drop("_now")


def publish(target: DataFrame, new: DataFrame, baseline: str, columns: list[str]) -> DataFrame:
    """target with new rows, if target's hash is the baseline that the new rows were made against; else it raises."""
    now = R.relation_hash(target, columns).first()[0]
    if now != baseline:
        raise ValueError("baseline_changed")
    return target.unionByName(new)


