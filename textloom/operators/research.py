"""The research cycle over many works at once: propose, locate, derive, commit.

Of each work the candidates of the first windows are tried in order.  A candidate counts once its first
window inside the body is found in the text; its derived word is scored, and the first that is acceptable is committed and ends the
work's cycle.  Those before it are rolled back; a window whose proposal failed ends the cycle as failed; a work
without any of these is idle.  Answers of models come as tables, as from a CandidateProvider.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textloom.functions import text as T
from textloom.operators import scan
from textloom.operators import scoring as S
from textloom.operators import zones as Z
from textloom.sources.published import Published

MOST = 5  # windows of a cycle
EDGES = "'\"`.,:;!?"


def cleaned(candidate: Column) -> Column:
    return F.btrim(T.strip(candidate), F.lit(EDGES))


def cycle(works: DataFrame, attested: DataFrame, proposals: DataFrame, derivations: DataFrame, most: int = MOST) -> DataFrame:
    """work_id, window, pos, status, term, form, proposed, score, issue, byte_start, byte_len, window_sha256: what a cycle of each work records, in order.

    works(work_id, text, zones), attested(work_id, term), proposals(work_id, window, status, candidates),
    derivations(work_id, term, proposed, root, model, note).  A work without records is idle.  Unknown derivations are
    errors of the model: the next candidate is tried.  Null texts have no windows and stay idle."""
    early = proposals.where(F.col("window") < most)
    broken = early.where("status <> 'ok'").groupBy("work_id").agg(F.min("window").alias("until"))
    open_ = early.join(broken, "work_id", "left").where("until is null or window < until")
    said = open_.select("work_id", "window", F.posexplode("candidates").alias("pos", "c")).select("work_id", "window", "pos", cleaned(F.col("c")).alias("term")).where(F.length("term") > 2)
    known = attested.select("work_id", F.trim(F.lower("term")).alias("low")).distinct()
    fresh = said.withColumn("low", F.lower("term")).join(known, ["work_id", "low"], "left_anti").drop("low")

    asked = works.join(fresh.groupBy("work_id").agg(F.collect_set("term").alias("terms")), "work_id")  # a work's few candidates
    found = scan.own_occurrences(asked, "terms", ("work_id",), show=scan.witness).join(works.select("work_id", "zones"), "work_id")
    body = found.where(Z.of_span(F.col("zones"), F.col("byte_start"), F.col("byte_start") + F.col("byte_len")) == "body")
    seen = body.groupBy("work_id", "term").agg(F.min(F.struct("byte_offset", "form", "byte_start", "byte_len", "window_sha256")).alias("x")).select("work_id", "term", "x.*")

    tried = fresh.join(seen, ["work_id", "term"]).join(derivations, ["work_id", "term"])
    word = S.formed_word(F.col("proposed"), F.concat_ws(" ", F.coalesce("note", F.lit("")), F.coalesce("model", F.lit(""))))
    judged = tried.withColumn("v", word).withColumn("ok", F.col("v.acceptable"))
    before = Window.partitionBy("work_id").orderBy("window", "pos").rowsBetween(Window.unboundedPreceding, -1)
    lived = judged.withColumn("done", F.coalesce(F.max(F.col("ok").cast("int")).over(before), F.lit(0))).where("done = 0")
    rows = lived.select("work_id", "window", "pos", F.when(F.col("ok"), "committed").otherwise("rolled_back").alias("status"), "term", "form", "proposed", F.col("v.score").alias("score"), F.col("v.issue").alias("issue"), "byte_start", "byte_len", "window_sha256")
    over = rows.where("status = 'committed'").select("work_id")
    failed = broken.join(over, "work_id", "left_anti").select("work_id", F.col("until").alias("window"), F.lit(-1).alias("pos"), F.lit("failed").alias("status"))
    return rows.unionByName(failed, allowMissingColumns=True)


def outcomes(works: DataFrame, records: DataFrame) -> DataFrame:
    """work_id, outcome: committed, error (a proposal failed) or idle."""
    best = records.groupBy("work_id").agg(F.bool_or(F.col("status") == "committed").alias("c"), F.bool_or(F.col("status") == "failed").alias("f"))
    return works.select("work_id").join(best, "work_id", "left").select("work_id", F.when(F.col("c"), "committed").when(F.col("f"), "error").otherwise("idle").alias("outcome"))


def commit(store: Published, proposals: DataFrame, derivations: DataFrame, at: str) -> int:
    """Runs a cycle of every work in the store's newest version and publishes all that it makes as one version.

    The store has works(work_id, author_slug, slug, year, text, zones, research_status) and, once there were any, terms,
    attestations (of registers attested and proposed) and cycles.  Terms that are there are kept.  If another publisher
    was faster, the cycle is run anew against what it published; nothing of the lost one is seen."""
    spark = store.spark

    def make(v: int) -> dict:
        have = set(store.tables(v))
        works = store.read("works", v)
        read = lambda t, schema: store.read(t, v) if t in have else spark.createDataFrame([], schema)
        old = read("attestations", "work_id long, term string, register string").where("register = 'attested'")
        path = store.stage(cycle(works, old, proposals, derivations))  # judged once, however many tables are made of it
        records = spark.read.parquet(path)
        won = records.where("status = 'committed'").join(works.select("work_id", "author_slug", "slug", "year", F.sha2(F.encode("text", "utf-8"), 256).alias("artifact_sha256")), "work_id")
        urn = F.concat(F.lit("urn:cts:texts:"), "author_slug", F.lit("."), "slug", F.lit(":"), F.col("byte_start").cast("string"), F.lit("+"), F.col("byte_len").cast("string"))
        terms = won.groupBy("term").agg(F.min(F.struct("work_id", "proposed", "score")).alias("x")).select("term", "x.*").join(read("terms", "term string").select("term"), "term", "left_anti")
        shown = won.select("work_id", "term", F.lit("attested").alias("register"), "year", F.lit("body").alias("zone"), F.col("form").alias("matched_form"), urn.alias("cts_urn"), "artifact_sha256", "byte_start", "byte_len", "window_sha256", F.lit(at).alias("verified_at"))
        made = won.select("work_id", "term", F.lit("proposed").alias("register"), "year", F.col("proposed").alias("proposed_term"), F.lit(at).alias("verified_at"))
        status = works.join(won.select("work_id").distinct().withColumn("_won", F.lit(True)), "work_id", "left").withColumn("research_status", F.when(F.col("_won"), "in_progress").otherwise(F.col("research_status"))).drop("_won").select(works.columns)
        return {"replace": {"works": status}, "append": {"terms": terms, "attestations": shown.unionByName(made, allowMissingColumns=True), "cycles": records.withColumn("at", F.lit(at))}, "note": f"cycle at {at}"}

    return store.update(make)
