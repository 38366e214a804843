"""Scores of works, authors, formed words and candidates."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.functions import text as T

# Eras and their multipliers, award and canon weights in the order they are tried, tier bonuses.
ERAS = ((1925, "proto_sf", 2.2), (1950, "pulp_golden", 1.6), (1964, "classic_mid", 1.2), (1979, "new_wave", 1.0), (1989, "cyberpunk_80s", 1.0), (None, "modern", 1.0))
AWARDS = (("hugo", "win", 12.0), ("hugo", "", 4.0), ("nebula", "win", 11.0), ("nebula", "", 4.0), ("locus", "win", 9.0), ("locus", "", 3.0), ("clarke", "", 9.0), ("pkd", "", 8.0), ("philip k. dick", "", 8.0), ("bsfa", "", 7.0))
OTHER_AWARD = 4.0
CANONS = (("sf masterworks", 18.0), ("locus all-time best", 16.0), ("npr top 100 sf", 14.0), ("r/printsf top tier", 12.0), ("isfdb top ranked", 10.0), ("porges century canon", 15.0))
TIERS = {1: (90.0, 8.0), 2: (80.0, 4.0), 3: (65.0, 1.0)}
# What a formed word may end and begin with, and stems that it must not hold.
SUFFIXES = "ник ниця ище ня ень ець ість ство цтво ар яр ач ло ій ич сник тель від пис шина ина ка янка".split()
PREFIXES = "пра понад без межи поза перед над під все само першо часо просторо вітро вогне".split()
FOREIGN_STEMS = "включ выключ двигател переключ накопител глушител предохранител указател подогрев нагревател".split()
FIELDS = ("term_orig", "scientific_definition", "original_context", "ukr_grinchenko_neologisms", "morphological_rationale", "ukr_translated_context")


def era(year: Column) -> Column:
    out = F.lit(ERAS[-1][1])
    for top, name, _ in reversed(ERAS[:-1]):
        out = F.when(year <= top, name).otherwise(out)
    return out


def multiplier(year: Column) -> Column:
    out = F.lit(ERAS[-1][2])
    for top, _, by in reversed(ERAS[:-1]):
        out = F.when(year <= top, by).otherwise(out)
    return out


def _award(a: Column) -> Column:
    low = F.lower(a)
    named, out = F.replace(low, F.lit(" "), F.lit("_")), F.lit(OTHER_AWARD)
    for name, win, weight in reversed(AWARDS):
        out = F.when(named.contains(name) & named.contains(win), weight).otherwise(out)
    return out


def _canon(c: Column) -> Column:
    out = F.lit(0.0)
    for name, weight in reversed(CANONS):
        out = F.when(F.lower(c).contains(name), weight).otherwise(out)
    return out


def _sum(xs: Column) -> Column:
    return F.aggregate(xs, F.lit(0.0), lambda s, x: s + x)


def _cents(x: Column) -> Column:
    """To two places by the double's own value, as SQL rounds: F.round goes by its decimal text, which takes 70.945 (a little less as a double) up."""
    return F.round(x * 100) / 100


def work_score(year: Column, awards: Column, canons: Column, maker: Column) -> Column:
    """40, plus awards and canons by the first weight that fits each, plus 15 for makers of tropes, raised by era; 50 to 99.8."""
    won = _sum(F.transform(awards, _award))
    raw = F.lit(40.0) + won + _sum(F.transform(canons, _canon)) + F.when(maker, 15.0).otherwise(0.0)
    by = multiplier(year)
    raised = F.when((year <= 1950) & (won == 0), (raw + 25.0) * by).otherwise(raw * (F.lit(1.0) + (by - 1.0) * 0.3))
    return F.greatest(F.lit(50.0), F.least(F.lit(99.8), _cents(raised * 0.72)))


def author_score(tier: Column, scores: Column, coined: Column) -> Column:
    """Without works the tier's base and up to 10 for concepts; else nine tenths of the three best on average, the tier's bonus and up to 7."""
    base, bonus = F.lit(TIERS[1][0]), F.lit(0.0)
    for t, (b, more) in TIERS.items():
        base, bonus = F.when(tier == t, b).otherwise(base), F.when(tier == t, more).otherwise(bonus)
    best = F.slice(F.sort_array(scores, asc=False), 1, 3)
    mean = _sum(best) / F.size(best)
    some = F.least(F.lit(100.0), _cents(mean * 0.90 + bonus + F.least(F.lit(7.0), coined * 1.5)))
    return F.when(F.coalesce(F.size(scores), F.lit(0)) <= 0, base + F.least(F.lit(10.0), coined * 2.0)).otherwise(some)


def formed_word(variant: Column, rationale: Column) -> Column:
    """score, issue, acceptable of a word formed in Ukrainian: hard faults give 0, then points add up from 0.40."""
    v, r = T.strip(F.coalesce(variant, F.lit(""))), T.strip(F.coalesce(rationale, F.lit("")))
    low = F.lower(v)
    bare = F.regexp_replace(low, r"[\x{0300}-\x{036F}]", "")
    some = lambda f, words: reduce(lambda a, b: a | b, [f(bare, F.lit(w)) for w in words])
    issue = (
        F.when(v == "", "empty")
        .when(v.rlike("[0-9a-zA-Z]"), "latin_or_digits")
        .when(v.rlike("[ыэъёЫЭЪЁ]") | r.rlike("[ыэъёЫЭЪЁ]"), "foreign_letters")
        .when(some(F.contains, FOREIGN_STEMS), "foreign_stem")
        .when(~v.rlike(rf"^[а-яіїєґА-ЯІЇЄҐ\x27’\-{T.WS}\x{{0300}}-\x{{036F}}]+$"), "other_characters")
    )
    points = F.lit(0.40) + F.when(some(F.endswith, SUFFIXES), 0.25).otherwise(0.0) + F.when(some(F.startswith, PREFIXES), 0.15).otherwise(0.0)
    points = points + F.when(F.length(low).between(4, 30), 0.10).otherwise(0.0) + F.when(F.length(r) > 15, 0.10).otherwise(0.0)
    score = F.when(issue.isNull(), F.round(points, 2)).otherwise(0.0)
    return F.struct(score.alias("score"), issue.alias("issue"), (score >= 0.70).alias("acceptable"))


def critic(c: str, source: Column) -> Column:
    """score, passed and the four parts for a candidate struct column with FIELDS."""
    g = lambda n: F.col(f"{c}.{n}")
    lacks = [F.coalesce(F.size(g(n)), F.lit(0)) <= 0 if n == "ukr_grinchenko_neologisms" else F.coalesce(g(n), F.lit("")) == "" for n in FIELDS]
    missing = reduce(lambda a, b: a + b, [x.cast("int") for x in lacks])
    complete = F.greatest(F.lit(0.0), F.lit(1.0) - missing * 0.25)
    term, context = F.lower(T.strip(F.coalesce(g("term_orig"), F.lit("")))), T.strip(F.coalesce(g("original_context"), F.lit("")))
    near = F.lower(context).contains(term)
    there = (F.coalesce(source, F.lit("")) == "") | F.lower(source).contains(F.lower(F.substring(context, 1, 40)))
    attested = F.when((term == "") | (context == ""), 0.0).when(near & there, 1.0).when(near, 0.85).otherwise(0.30)
    words = g("ukr_grinchenko_neologisms")
    one = F.transform(words, lambda n: formed_word(n.variant, F.concat(F.coalesce(n.morphemes, F.lit("")), F.lit(" "), F.coalesce(g("morphological_rationale"), F.lit("")))).score)
    formed = F.when(F.coalesce(F.size(words), F.lit(0)) <= 0, 0.2).otherwise(_sum(one) / F.size(one))
    deep = F.when((F.length(F.coalesce(g("scientific_definition"), F.lit(""))) > 30) & (F.length(F.coalesce(g("ukr_translated_context"), F.lit(""))) > 20), 1.0).otherwise(0.6)
    score = F.round(F.least(F.lit(0.99), F.greatest(F.lit(0.0), complete * 0.25 + attested * 0.30 + formed * 0.30 + deep * 0.15)), 2)
    return F.struct(score.alias("score"), (score >= 0.85).alias("passed"), complete.alias("completeness"), attested.alias("attestation"), formed.alias("morphology"), deep.alias("depth"))


def entity_issues(item: str, scene: Column, byte_start: Column) -> Column:
    """issues (in the order they are looked for), evidence, status of an entity struct column (name, kind, quote, description_uk, epistemic) in a scene."""
    g = lambda n: F.col(f"{item}.{n}")
    found = T.locate(scene, g("quote"))
    named = ~T.blank(g("name"))
    shown = F.decode(F.substring(F.encode(scene, "utf-8"), found.byte_start + 1, found.byte_len), "utf-8")
    issues = F.array_compact(
        F.array(
            found.error,
            F.when(~named, "missing_name").when(~T.whole_word(scene, g("name")), "name_not_in_original"),
            F.when(named & found.error.isNull() & ~T.whole_word(shown, g("name")), "name_not_in_evidence"),
            F.when(~F.coalesce(g("kind").isin("concept", "character", "place"), F.lit(False)), "unknown_category"),
            F.when(~F.coalesce(g("epistemic").isin("explicit", "inferred"), F.lit(False)), "unknown_epistemic_status"),
            F.when(T.blank(g("description_uk")), "missing_description"),
        )
    )
    return F.struct(issues.alias("issues"), (byte_start + found.byte_start).alias("byte_start"), found.byte_len.alias("byte_len"), F.when(F.size(issues) > 0, "held").otherwise("source_grounded_editorial_pending").alias("status"))


def grounded(entities: Column, scene: Column, byte_start: Column) -> Column:
    """Verdict on a model's entities: an error for the whole answer, or each entity with the bytes of its exact quote, or a reason."""
    fields = ("name", "kind", "description_uk", "quote", "epistemic")
    whole = lambda e: reduce(lambda a, b: a & b, [~T.blank(e[f]) for f in fields])
    typed = lambda e: e.kind.isin("concept", "character", "place") & e.epistemic.isin("explicit", "inferred")
    error = F.when(entities.isNull(), "invalid_entities").when(F.size(entities) > 4, "entity_limit").when(~F.forall(entities, whole), "invalid_entity").when(~F.forall(entities, typed), "invalid_type")

    def one(e):
        p = F.position(e.quote, scene)
        at = byte_start + F.octet_length(F.substring(scene, F.lit(1), p - 1))
        return F.struct(e["name"].alias("name"), (p > 0).alias("accepted"), F.when(p > 0, at).alias("byte_start"), F.when(p > 0, F.octet_length(e.quote)).alias("byte_len"), F.when(p == 0, "quote_not_exact_in_original").alias("reason"))

    return F.struct(error.alias("error"), F.when(error.isNull(), F.transform(entities, one)).alias("entities"))


def repairs(models: DataFrame, key: str) -> DataFrame:
    """key and whether its rationale may be replaced: only if every model word is attested; one that is not stops it."""
    return models.groupBy(key).agg(F.bool_and(F.col("verdict") == "ATTESTED").alias("replace"), F.sort_array(F.collect_list(F.when(F.col("verdict") != "ATTESTED", F.col("word")))).alias("absent"))
