"""Occurrences, witnesses, windows, coverage, containment and agreement."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textloom.functions import raw as R
from textloom.functions.text import WORD
from textloom.operators import scan
from textloom.operators import zones as Z
from textloom.operators.scan import SEPARATOR, TAIL, occurrences, term_forms

BLOCK = 64  # items of an array that offsets are counted within
BROADCAST_TERMS = 200_000  # above this many keys the join is shuffled


def _size(x: Column, extra: int = 0) -> Column:
    return F.aggregate(x, F.lit(0).cast("long"), lambda s, r: s + F.octet_length(r) + extra)


def _blocks(rows: DataFrame, keys: list[str], items: Column, extra: int, ahead: int) -> DataFrame:
    """keys, b, x, base: blocks of an array's items, and the bytes (with `extra` for each item) before every block.

    Sums run within blocks and over blocks, inside the row: no shuffle."""
    cuts = F.transform(F.sequence(F.lit(0), F.greatest(F.lit(0), F.floor((F.size("items") - 1) / BLOCK).cast("int"))), lambda b: F.slice("items", b * BLOCK + 1, BLOCK + ahead))
    own = rows.select(*keys, items.alias("items")).where("size(items) > 0").select(*keys, cuts.alias("blocks"))
    sized = own.withColumn("sizes", F.transform("blocks", lambda x: _size(F.slice(x, 1, BLOCK), extra)))
    base = F.transform("blocks", lambda x, b: F.struct(b.alias("b"), x.alias("x"), F.aggregate(F.slice("sizes", 1, b), F.lit(0).cast("long"), lambda s, n: s + n).alias("base")))
    return sized.select(*keys, F.explode(base).alias("k")).select(*keys, "k.*")


def array_offsets(rows: DataFrame, keys: list[str], items: Column, extra: int = 0) -> DataFrame:
    """keys, i, byte_offset, item of each string of an array whose items stand `extra` bytes apart."""
    one = F.transform("x", lambda r, i: F.struct((F.col("b") * BLOCK + i).alias("i"), (F.col("base") + _size(F.slice("x", 1, i), extra)).alias("byte_offset"), r.alias("item")))
    return _blocks(rows, keys, items, extra, 0).select(*keys, F.explode(one).alias("k")).select(*keys, "k.*")


def counts(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """term, n, n_docs of one-word terms: no offsets, and words are counted before anything is shuffled."""
    forms = term_forms(terms).where("size(runs) = 1").select("term", "key").distinct()
    small = forms.limit(BROADCAST_TERMS + 1).count() <= BROADCAST_TERMS
    word = docs.select("doc_id", F.explode(F.regexp_extract_all(F.lower("text"), F.lit(f"[{WORD}]+"), F.lit(0))).alias("word")).groupBy("doc_id", "word").agg(F.count("*").alias("k"))
    n = F.length("word")
    keyed = word.select("doc_id", "word", "k", F.explode(F.transform(F.sequence(F.lit(0), F.least(F.lit(TAIL), n - 1)), lambda i: F.substring("word", F.lit(1), n - i))).alias("key"))
    hit = keyed.join(F.broadcast(forms) if small else forms, "key").select("doc_id", "word", "k", "term").distinct()
    return hit.groupBy("term", "doc_id").agg(F.sum("k").alias("k")).groupBy("term").agg(F.sum("k").alias("n"), F.count("*").alias("n_docs"))


def has_term(text: Column, term: Column) -> Column:
    """Whether a text holds a term or an inflected form of it: the rule of occurrences as one expression, for short windows."""
    esc = lambda c: F.concat(F.lit(r"\Q"), c, F.lit(r"\E"))
    parts = F.split(term, SEPARATOR)
    body = F.when(F.forall(parts, lambda s: F.length(s) >= 3), F.array_join(F.transform(parts, esc), SEPARATOR)).otherwise(esc(term))
    return F.regexp_like(text, F.concat(F.lit(f"(?iu)(?<![{WORD}])"), body, F.lit(f"[{WORD}]{{0,{TAIL}}}(?![{WORD}])")))


def witnesses(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """Each occurrence with the window that shows it: byte_start, byte_len, window_sha256, matched_form, occurrences_total."""
    found = occurrences(docs, terms, show=scan.witness, form="matched_form")  # made in this order, so that no row is copied for it
    return found.select("doc_id", "term", "idx", "byte_offset", "byte_start", "byte_len", "window_sha256", "matched_form", "occurrences_total")


def witness_lists(docs: DataFrame, terms: DataFrame, first: int = 0) -> DataFrame:
    """doc_id, text and `found`, an array of the same witnesses of each text; `first` keeps so many of each term."""
    return scan.listed(docs, terms, show=scan.witness, first=first)


def first_in_body(docs: DataFrame, terms: DataFrame, zones: Column) -> DataFrame:
    """doc_id, term, byte_offset, form, byte_start, byte_len: of the occurrences whose whole window a body zone of the text holds, the first.

    Zones of texts, not the texts themselves, meet the occurrences."""
    at = occurrences(docs, terms, show=scan.witness).join(docs.select("doc_id", zones.alias("zones")), "doc_id")
    kept = at.where(Z.of_span(F.col("zones"), F.col("byte_start"), F.col("byte_start") + F.col("byte_len")) == "body")
    first = kept.groupBy("doc_id", "term").agg(F.min(F.struct("byte_offset", "form", F.col("byte_start").cast("int").alias("byte_start"), F.col("byte_len").cast("int").alias("byte_len"))).alias("x"))
    return first.select("doc_id", "term", "x.*")


def localised(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """doc_id, term, byte_offset, byte_start, byte_len of the quote around each term's first place in each text."""
    return occurrences(docs, terms, show=scan.quote, first=True).select("doc_id", "term", "byte_offset", F.col("byte_start").cast("int").alias("byte_start"), F.col("byte_len").cast("int").alias("byte_len"))


def in_jobs(jobs: DataFrame, candidates: Column) -> DataFrame:
    """doc_id, job, term, status, n, first of every candidate of jobs(doc_id, job, text): places in the whole text, or its absence.

    A job is the byte at which its fragment begins; jobs are unique by both."""
    asked = jobs.withColumn("terms", candidates)
    found = scan.own_occurrences(asked, "terms", ("doc_id", "job"))
    places = found.groupBy("doc_id", "job", "term").agg(F.count("*").alias("n"), F.min(F.col("job") + F.col("byte_offset")).alias("first"))
    every = asked.select("doc_id", "job", F.explode(F.array_distinct("terms")).alias("term")).join(places, ["doc_id", "job", "term"], "left")
    status = F.when(F.col("n") > 0, "present_in_fragment").otherwise("absent_in_fragment")
    return every.select("doc_id", "job", "term", status.alias("status"), F.coalesce("n", F.lit(0)).alias("n"), "first")


def verdict(content: Column, w: str, term: Column) -> Column:
    """Reason of a witness struct column `w` against the bytes it names: the first check that fails, or ok."""
    part = R.byte_slice(content, F.col(f"{w}.byte_start"), F.col(f"{w}.byte_len"))
    text = F.when(F.is_valid_utf8(part.cast("string")), part.cast("string")).otherwise("")
    near = lambda c: F.coalesce((c != "") & F.lower(text).contains(F.lower(c)), F.lit(False))
    said = near(term) | near(F.col(f"{w}.matched_form")) | has_term(text, term)
    return (
        F.when(content.isNull(), "file_not_found")
        .when(~F.sha2(content, 256).eqNullSafe(F.col(f"{w}.artifact_sha256")), "artifact_drift")
        .when(F.octet_length(part) != F.col(f"{w}.byte_len"), "short_read")
        .when(~F.sha2(part, 256).eqNullSafe(F.col(f"{w}.window_sha256")), "window_mismatch")
        .when(~F.is_valid_utf8(part.cast("string")), "decode_error")
        .when((F.coalesce(term, F.lit("")) != "") & ~said, "term_absent")
        .otherwise("ok")
    )


def export_check(content: Column, w: str, term: Column, zone: Column, zones_sha: Column, inside_body: Column) -> Column:
    """The stricter reason for exports: coordinates and length come before drift, and the zones must be bound to the bytes."""
    start, size = F.col(f"{w}.byte_start"), F.col(f"{w}.byte_len")
    part = R.byte_slice(content, start, size)
    text = F.when(F.is_valid_utf8(part.cast("string")), part.cast("string")).otherwise("")
    return (
        F.when(content.isNull(), "unavailable")
        .when(start.isNull() | size.isNull() | (start < 0) | (size <= 0), "invalid_coordinates")
        .when(start + size > F.octet_length(content), "short_read")
        .when(~F.sha2(content, 256).eqNullSafe(F.col(f"{w}.artifact_sha256")), "artifact_drift")
        .when(~F.sha2(part, 256).eqNullSafe(F.col(f"{w}.window_sha256")), "window_mismatch")
        .when(~F.is_valid_utf8(part.cast("string")), "decode_error")
        .when(~has_term(text, term), "term_absent")
        .when(~zones_sha.eqNullSafe(F.col(f"{w}.artifact_sha256")), "zone_hash_unbound")
        .when(~zone.eqNullSafe(F.lit("body")) | ~F.coalesce(inside_body, F.lit(False)), "outside_body")
        .otherwise("byte_verified_zone_map_checked")
    )


def windows(docs: DataFrame, length: str, size: int, overlap: int) -> DataFrame:
    """doc_id, start, end: overlapping windows that reach the end of each text."""
    step = size - overlap
    n = F.col(length)
    starts = F.when(n > 0, F.sequence(F.lit(0).cast("long"), F.greatest(F.lit(0).cast("long"), F.ceil((n - overlap) / F.lit(step)).cast("long") - 1) * step, F.lit(step).cast("long")))
    return docs.select("doc_id", n.alias("n"), F.explode(starts).alias("start")).select("doc_id", "start", F.least(F.col("start") + size, F.col("n")).alias("end"))


def covered(spans: DataFrame, key: str) -> DataFrame:
    """key, covered: size of the union of half-open spans, by a running maximum of ends."""
    before = Window.partitionBy(key).orderBy("start", "end").rowsBetween(Window.unboundedPreceding, -1)
    part = F.greatest(F.lit(0), F.col("end") - F.greatest("start", F.coalesce(F.max("end").over(before), F.col("start"))))
    return spans.withColumn("part", part).groupBy(key).agg(F.sum("part").cast("long").alias("covered"))


def contained(spans: DataFrame, zones: DataFrame, key: str) -> DataFrame:
    """Spans with the kind of the first zone that holds them whole; null where none does."""
    s, z = spans.alias("s"), zones.alias("z")
    on = (F.col(f"s.{key}") == F.col(f"z.{key}")) & (F.col("z.z_start") <= F.col("s.start")) & (F.col("s.end") <= F.col("z.z_end"))
    return s.join(z, on, "left").groupBy(*[F.col(f"s.{c}") for c in spans.columns]).agg(F.min_by("z.kind", "z.ord").alias("zone"))


def kappa(pairs: DataFrame, top: int = 3) -> DataFrame:
    """n, exact, within_one, kappa (linear weights; null where chance disagreement is zero)."""
    cells = pairs.groupBy("a", "b").agg(F.count("*").alias("n"))  # at most (top + 1)^2 rows
    t = cells.agg(F.sum("n").alias("n"), F.sum(F.when(F.col("a") == F.col("b"), F.col("n")).otherwise(0)).alias("same"), F.sum(F.when(F.abs(F.col("a") - F.col("b")) <= 1, F.col("n")).otherwise(0)).alias("near"), F.sum(F.col("n") * F.abs(F.col("a") - F.col("b"))).alias("off"), *[F.sum(F.when(F.col(c) == k, F.col("n")).otherwise(0)).alias(f"{c}{k}") for c in "ab" for k in range(top + 1)])
    chance = sum((F.col(f"a{i}") * F.col(f"b{j}") * abs(i - j) for i in range(top + 1) for j in range(top + 1)), F.lit(0))
    d = F.nullif(chance.cast("double"), F.lit(0.0))
    return t.select(F.coalesce("n", F.lit(0)).alias("n"), (F.col("same") / F.col("n")).alias("exact"), (F.col("near") / F.col("n")).alias("within_one"), (1 - F.col("off") * F.col("n").cast("double") / d).alias("kappa"))


def contingency(pairs: DataFrame, top: int = 3) -> DataFrame:
    """a, b, n of every pair of scores from 0 to `top`, zero for those that never met."""
    every = F.explode(F.flatten(F.transform(F.sequence(F.lit(0), F.lit(top)), lambda a: F.transform(F.sequence(F.lit(0), F.lit(top)), lambda b: F.struct(a.alias("a"), b.alias("b")))))).alias("x")
    grid = pairs.sparkSession.range(1).select(every).select("x.a", "x.b")
    return grid.join(pairs.groupBy("a", "b").agg(F.count("*").alias("n")), ["a", "b"], "left").select("a", "b", F.coalesce("n", F.lit(0)).alias("n"))
