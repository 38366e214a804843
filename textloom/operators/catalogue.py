"""Catalogue operators: upserts, routing, cards, search, reports, journals of decisions."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textloom.functions import text as T

VERDICTS = ("accept", "revise", "reject", "context")


def upsert(old: DataFrame, new: DataFrame, keys: list[str], columns: list[str], order: str | None = None) -> DataFrame:
    """Rows of both, one for each key: `columns` come from the last incoming row (by `order`), all else from the row that was there."""
    newest = F.max_by(F.struct(*new.columns), F.struct(order or keys[0], *new.columns))
    n = new.groupBy(*keys).agg(newest.alias("n"))
    o = old.select(*keys, F.struct(*old.columns).alias("o"))
    pick = [F.coalesce(F.col(c), F.col(c)).alias(c) if c in keys else (F.when(F.col("n").isNotNull(), F.col(f"n.{c}")).otherwise(F.col(f"o.{c}")) if c in columns else F.when(F.col("o").isNotNull(), F.col(f"o.{c}")).otherwise(F.col(f"n.{c}"))).alias(c) for c in old.columns]
    return o.join(n, keys, "full").select(*pick)


def ignore_known(new: DataFrame, known: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Incoming rows whose key is not there yet; of several with one key the first."""
    first = new.withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_r = 1").drop("_r")
    return first.join(known.select(*keys).distinct(), keys, "left_anti")


def resolve(incoming: DataFrame, known: DataFrame, key: str, ident: str) -> DataFrame:
    """incoming with the id of its key; keys not known yet get the next ids.

    New keys are numbered within 4,096 groups by hash, whose sizes are summed: no task sees them all."""
    ids = known.groupBy(key).agg(F.min(ident).alias(ident))
    top = known.agg(F.coalesce(F.max(ident), F.lit(0))).first()[0]
    fresh = incoming.select(key).distinct().join(ids, key, "left_anti").withColumn("_g", F.substring(F.md5(key), 1, 3))
    sizes = fresh.groupBy("_g").agg(F.count("*").alias("_n"))
    before = sizes.select("_g", (F.lit(top) + F.coalesce(F.sum("_n").over(Window.orderBy("_g").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).alias("_from"))  # 4,096 rows
    nth = F.row_number().over(Window.partitionBy("_g").orderBy(key))
    given = fresh.join(F.broadcast(before), "_g").select(key, (F.col("_from") + nth).alias(ident), F.lit(True).alias("is_new"))
    return incoming.join(ids.withColumn("is_new", F.lit(False)).unionByName(given), key)


def routed(rows: DataFrame, register: str, columns: dict[str, list[str]]) -> DataFrame:
    """One filtered projection for each value of a register column, put together; columns a register lacks are null."""
    parts = [rows.where(F.col(register) == v).select(register, *c) for v, c in columns.items()]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def cards(terms: DataFrame, rows: DataFrame) -> DataFrame:
    """Cards by folded term and work of terms(term, work_id, definition) and of register
    rows(id, term, work_id, register, year, quote, variant, authority), with nested lists in order of id."""
    key = [T.casefold(T.strip("term")).alias("key"), F.col("work_id")]
    base = terms.select(*key, F.struct(F.lit(0).alias("o"), F.lit(0).cast("long").alias("id"), "term").alias("name"), "definition")
    rest = rows.select(*key, F.struct(F.lit(1).alias("o"), F.col("id").cast("long").alias("id"), "term").alias("name"), "id", "register", "year", "quote", "variant", "authority")
    every = base.unionByName(rest, allowMissingColumns=True)
    listed = lambda reg, *c: F.sort_array(F.collect_list(F.when(F.col("register") == reg, F.struct("id", *c))))
    out = every.groupBy("key", "work_id").agg(
        F.min("name").alias("name"), F.max("definition").alias("definition"), listed("attested", "year", "quote").alias("attestations"), listed("proposed", "variant").alias("proposals"), listed("external", "authority").alias("external"),
        F.min(F.when((F.col("register") == "attested") & F.col("quote").isNotNull(), F.col("year"))).alias("earliest"),
    )
    return out.withColumn("term", F.col("name.term")).drop("name")


def snapshot_counts(made: DataFrame) -> DataFrame:
    verified = F.size(F.filter("attestations", lambda a: a.quote.isNotNull()))
    return made.agg(F.count("*").alias("cards"), F.sum(F.size("attestations")).alias("attestations"), F.sum(verified).alias("byte_verified"), F.sum(F.size("proposals")).alias("proposals"))


def latest(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The last row of each key."""
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rows.columns), order).alias("_l")).select("_l.*")


def choose(made: DataFrame, choices: DataFrame, keys: list[str], source: str, held: str, order: str) -> DataFrame:
    """made with the last choice of its keys whose source is among the `held` array; null where there is none."""
    few = choices.groupBy(*keys).agg(F.collect_list(F.struct(order, source, "value")).alias("_c"))
    fits = F.filter("_c", lambda c: F.array_contains(F.col(held), c[source]))
    return made.join(few, keys, "left").withColumn("chosen", F.try_element_at(F.array_sort(fits), F.lit(-1))).drop("_c")


def tokens(c: Column) -> Column:
    """Tokens of a full-text index: runs of letters and numbers, in small letters without accents."""
    return F.regexp_extract_all(T.strip_accents(F.lower(c)), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))


def _phrase(words: list[str]):
    """Whether a place begins a phrase: its words stand there and at the places after it."""

    def begins(x: Column) -> Column:
        return reduce(lambda a, b: a & b, [F.array_contains(F.col("at"), F.struct(F.lit(w).alias("token"), (x.pos + k).alias("pos"))) for k, w in enumerate(words)])

    return begins


def search(rows: DataFrame, key: str, columns: list[str], match: str) -> DataFrame:
    """Keys of rows that hold every word, "phrase" and prefix* of a query in some column.

    Only tokens that the query names leave the scan; they are grouped once by row and column."""
    wants = [(m[0].split(), m[1], m[2]) for m in re.findall(r'"([^"]*)"|(\S+?)(\*?)(?:\s|$)', match)]
    wants = [([w.lower() for w in (phrase or [word])], bool(star)) for phrase, word, star in wants if phrase or word]
    exact, prefixes = sorted({w for ws, star in wants if not star for w in ws}), sorted({ws[0] for ws, star in wants if star})
    named = reduce(lambda a, b: a | b, [F.startswith(F.col("token"), F.lit(p)) for p in prefixes], F.col("token").isin(*exact) if exact else F.lit(False))
    one = [rows.select(key, F.lit(i).alias("col"), F.posexplode(tokens(F.col(c))).alias("pos", "token")).where(named) for i, c in enumerate(columns)]
    places = reduce(lambda a, b: a.unionByName(b), one).groupBy(key, "col").agg(F.collect_set(F.struct("token", "pos")).alias("at"))
    hits = []
    for words, star in wants:
        if star:
            hits.append(F.exists("at", (lambda p: lambda x: F.startswith(x.token, F.lit(p)))(words[0])))
        else:
            hits.append(F.exists("at", _phrase(words)))
    found = places.select(key, *[h.alias(f"h{i}") for i, h in enumerate(hits)]).groupBy(key).agg(*[F.bool_or(f"h{i}").alias(f"h{i}") for i in range(len(hits))])
    return found.where(reduce(lambda a, b: a & b, [F.col(f"h{i}") for i in range(len(hits))])).select(key)


def row_faults(rows: DataFrame) -> DataFrame:
    """rows with `valid`: an attested row has its whole witness, an external one its authority and snapshot, a proposed one a term and no witness."""
    has = lambda *c: reduce(lambda a, b: a & b, [F.col(x).isNotNull() for x in c])
    witness = ("cts_urn", "artifact_sha256", "byte_start", "byte_len", "window_sha256")
    ok = F.when(F.col("register") == "attested", has(*witness)).when(F.col("register") == "external", has("authority", "authority_snapshot_sha256"))
    ok = ok.when(F.col("register") == "proposed", F.col("cts_urn").isNull() & F.col("artifact_sha256").isNull() & has("proposed_ukr_term"))
    return rows.withColumn("valid", F.coalesce(ok, F.lit(False)))


def decision_faults(d: str = "") -> Column:
    """The first fault of a decision event, or null."""
    c = lambda n: F.col(f"{d}{n}")
    fields = ("event_id", "card_id", "revision", "action", "note", "ukrainian", "english")
    return (
        F.when(reduce(lambda a, b: a | b, [c(f).isNull() for f in fields]), "invalid_fields")
        .when(reduce(lambda a, b: a | b, [F.length(c(f)) > 4000 for f in fields]) | ~F.length(c("event_id")).between(8, 80), "too_large")
        .when(~c("action").isin(*VERDICTS), "unknown_action")
        .when((c("action") != "accept") & T.blank(c("note")), "note_required")
    )


def judge_decisions(events: DataFrame, known: DataFrame, order: str) -> DataFrame:
    """events with status: faults first, then unknown or stale cards, then the first of an event id is saved and later ones are duplicates or conflicts."""
    fields = ["event_id", "card_id", "revision", "action", "note", "ukrainian", "english"]
    seen = events.join(known.select("card_id", F.col("revision").alias("_now")), "card_id", "left")
    early = F.coalesce(decision_faults(), F.when(F.col("_now").isNull(), "unknown_card").when(F.col("_now") != F.col("revision"), "stale_revision"))
    seen = seen.withColumn("_early", early).withColumn("_payload", F.sha2(F.to_json(F.struct(*fields)), 256))
    good = Window.partitionBy("event_id", F.col("_early").isNull()).orderBy(order)
    first = F.first("_payload").over(good)
    status = F.coalesce("_early", F.when(F.row_number().over(good) == 1, "saved").when(first == F.col("_payload"), "duplicate").otherwise("conflict"))
    return seen.withColumn("status", status).drop("_now", "_early", "_payload")


def relevance(records: DataFrame, limit: int, order: str) -> DataFrame:
    """records(…, decision, reviewer_role, reviewer, rationale, reviewed_at) with route: selected, approved over the budget, or held for review."""
    said = [~T.blank(F.col(k)) for k in ("reviewer", "rationale", "reviewed_at")]
    ok = F.coalesce((F.col("decision") == "include") & (F.col("reviewer_role") == "human") & reduce(lambda a, b: a & b, said), F.lit(False))
    best = records.where(ok).orderBy(order).limit(limit).select(order, F.lit(True).alias("_in"))
    out = records.withColumn("_ok", ok).join(F.broadcast(best), order, "left")  # `limit` rows
    return out.withColumn("route", F.when(F.col("_in"), "selected").when(F.col("_ok"), "approved_over_budget").otherwise("relevance_review_required")).drop("_ok", "_in")


def quarantine(rows: DataFrame, bad: Column, status: str) -> DataFrame:
    """Rows that are bad get the class 'synthetic' and the status given; others stay as they are."""
    return rows.withColumn("status", F.when(bad, status).otherwise(F.col("status"))).withColumn("class", F.when(bad, "synthetic").otherwise(F.col("class")))


def best_mirror(fetched: DataFrame, key: str) -> DataFrame:
    """Of each key's fetches(priority, status, body) the first good one: answered whole, and over 1,000 characters."""
    good = fetched.where((F.col("status") == 200) & (F.length("body") > 1000))
    return good.groupBy(key).agg(F.min_by(F.struct("priority", "body"), "priority").alias("b")).select(key, "b.*")
