"""Review forms: faults, completeness, arbitration, mode and agreement by phase."""

from __future__ import annotations

import random
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.functions import text as T
from textloom.operators.evidence import kappa

SCALES = ("semantics", "naturalness", "word_formation", "style")


# Seeds of the split and of the two reviewers' orders, and the items of the calibration.
SEEDS, CALIBRATION = (901, 902, 903), 10


def drawn(items: DataFrame, package: str, order: str, seeds: tuple[int, int, int] = SEEDS, calibration: int = CALIBRATION) -> DataFrame:
    """items(package, id, order) with phase and the places of both reviewers' orders, drawn by the Mersenne Twister.

    The split shuffles the ids in ascending order, the reviewers' orders the items in order of `order`, then id.  A package is what one
    person reviews, so it is drawn in one task; packages are drawn in parallel.  Ids are unique within a package."""
    split, *readers = seeds

    def run(key, rows: pd.DataFrame) -> pd.DataFrame:
        ids = sorted(rows["id"])
        random.Random(split).shuffle(ids)
        given = rows.sort_values(["ord", "id"])["id"].tolist()
        places = []
        for seed in readers:
            now = list(given)
            random.Random(seed).shuffle(now)
            at = {x: i for i, x in enumerate(now)}
            places.append([at[x] for x in given])
        first = set(ids[:calibration])
        return pd.DataFrame({"package": key[0], "id": given, "phase": ["calibration" if x in first else "development_review" for x in given], "place_1": places[0], "place_2": places[1]})

    kinds = dict(items.dtypes)
    return items.select(F.col(package).alias("package"), "id", F.col(order).alias("ord")).groupBy("package").applyInPandas(run, f"package {kinds[package]}, id {kinds['id']}, phase string, place_1 int, place_2 int")


def faults(i: str, t: str) -> Column:
    """Faults of a filled item (struct column `i`: frozen, context_sufficient, relevance, relevance_reason,
    recognized_provenance, scores map<string,double>, na_reasons map<string,string>, comment) against its template `t`."""
    g = lambda n: F.col(f"{i}.{n}")
    scores, reasons = g("scores"), g("na_reasons")
    keys = F.array_sort(F.map_keys(scores))
    out = [
        F.when(~g("frozen").eqNullSafe(F.col(f"{t}.frozen")), "protected_content_changed"),
        F.when(g("relevance").isNotNull() & ~g("relevance").isin("include", "exclude", "uncertain"), "invalid_relevance"),
        F.when(scores.isNull() | reasons.isNull() | (keys != F.array_sort(F.array(*[F.lit(s) for s in SCALES]))), "invalid_score_schema"),
        F.when(F.size(F.array_except(F.map_keys(reasons), F.array(*[F.lit(s) for s in SCALES]))) > 0, "unknown_na_scale"),
        F.when(F.exists(F.map_values(scores), lambda v: v.isNotNull() & ~v.isin(0.0, 1.0, 2.0, 3.0)), "invalid_score"),
        F.when(F.exists(F.map_values(reasons), T.blank), "invalid_na_reason"),
        F.when(F.exists(F.map_entries(scores), lambda e: e.value.isNotNull() & F.map_contains_key(reasons, e.key)), "score_and_na_conflict"),
        F.when((g("context_sufficient") == F.lit(False)) & F.exists(F.map_values(scores), lambda v: v.isNotNull()), "insufficient_context_scored"),
        F.when(g("comment").isNull() | g("relevance_reason").isNull(), "invalid_text_field"),
    ]
    return F.array_compact(F.array(*out))


def complete(i: str) -> Column:
    g = lambda n: F.col(f"{i}.{n}")
    rated = F.forall(F.map_entries(g("scores")), lambda e: e.value.isNotNull() | F.map_contains_key(g("na_reasons"), e.key))
    return F.coalesce(g("context_sufficient").isNotNull() & g("relevance").isNotNull() & ~T.blank(g("relevance_reason")) & g("recognized_provenance").isNotNull() & rated, F.lit(False))


def arbitration(a: str, b: str) -> Column:
    """Reasons to look at a pair of items again, in order."""
    g = lambda f, n: F.col(f"{f}.{n}")
    unsure = lambda f: (g(f, "relevance") == "uncertain") | ~g(f, "context_sufficient")
    out = [F.when(~g(a, "relevance").eqNullSafe(g(b, "relevance")), "relevance_disagreement"), F.when(unsure(a) | unsure(b), "uncertain_or_insufficient_context")]
    for s in SCALES:
        x, y = F.col(f"{a}.scores")[s], F.col(f"{b}.scores")[s]
        out.append(F.when(x.isNull() | y.isNull(), f"NA:{s}").when(F.abs(x - y) >= 2, f"large_difference:{s}"))
        if s == "semantics":
            out.append(F.when((x <= 1) | (y <= 1), "low_semantics"))
    return F.array_compact(F.array(*out))


def mode(first: Column, second: Column) -> Column:
    """Kind of review by the two roles."""
    roles = F.array_sort(F.array(F.coalesce(first, F.lit("None")), F.coalesce(second, F.lit("None"))))
    return F.when(F.array_join(roles, ",") == "ai,human", "ai_assisted_human_audit").when(F.array_join(roles, ",") == "human,human", "two_human_review").otherwise("unconfirmed_roles")


def status(kind: Column, ready: Column, pairs: Column) -> Column:
    some = ready & (pairs > 0) & (kind != "unconfirmed_roles")
    return F.when(~F.coalesce(some, F.lit(False)), "not_ready").when(kind == "ai_assisted_human_audit", "assisted_audit_comparison").otherwise("descriptive_development_results")


def agreement(pairs: DataFrame, kind: str) -> DataFrame:
    """phase, scale, n, exact, within_one, kappa of pairs(phase, scale, a, b); no kappa unless two humans reviewed."""
    cells = [pairs.where(F.col("scale") == s).select("phase", "a", "b") for s in SCALES]
    phases = ("calibration", "development_review")
    one = lambda p, s, df: kappa(df.where((F.col("phase") == p) & F.col("a").isNotNull() & F.col("b").isNotNull()).select(F.col("a").cast("int"), F.col("b").cast("int"))).select(F.lit(p).alias("phase"), F.lit(s).alias("scale"), "*")
    every = reduce(lambda x, y: x.unionByName(y), [one(p, s, df) for p in phases for s, df in zip(SCALES, cells, strict=True)])
    return every if kind == "two_human_review" else every.withColumn("kappa", F.lit(None).cast("double"))
