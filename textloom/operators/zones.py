"""Structural zones of byte texts: from headings, from anchors, and where a span lies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KIND = "array<struct<kind:string,byte_start:bigint,byte_end:bigint>>"
# Words that open a table of contents, a first chapter and an end, in ASCII letters of any case.
CONTENTS = r"(?i)(?<![A-Za-z0-9_])(?:CONTENTS|TABLE\s+OF\s+CONTENTS|INDEX)(?![A-Za-z0-9_])"
FIRST = (
    r"(?i)(?:\r?\n|^)\s*(?:CHAPTER\s+(?:I|1|ONE)|BOOK\s+(?:I|1|ONE)|PART\s+(?:I|1|ONE))(?![A-Za-z0-9_])",
    r"(?i)(?:\r?\n|^)\s*(?:I\.\s+[A-Z]|I\s*\r?\n\s*[A-Z])",
)
END = r"(?i)(?:\r?\n|^)\s*(?:THE\s+END|FINIS)(?![A-Za-z0-9_])"
FOOTER = r"(?i)\*\*\*\s*END\s+OF\s+TH(?:E|IS)\s+PROJECT\s+GUTENBERG"


def _before(text: Column, pattern: str) -> Column:
    """Characters before the first match; null without one."""
    return F.when(text.rlike(pattern), F.length(F.element_at(F.split(text, pattern, 2), 1)))


def _match(text: Column, pattern: str) -> Column:
    return F.length(F.regexp_extract(text, pattern, 0))


def _zone(kind: str, a: Column, b: Column) -> Column:
    return F.struct(F.lit(kind).alias("kind"), a.cast("long").alias("byte_start"), b.cast("long").alias("byte_end"))


def detect(texts: DataFrame, key: str) -> DataFrame:
    """key, zones: contents, first chapter after them, and end of the body by the headings of texts(key, text)."""
    t = F.col("text")
    toc = texts.select(key, "text", _before(t, CONTENTS).alias("toc"), _match(t, CONTENTS).alias("toc_n")).withColumn("from", F.coalesce(F.col("toc") + F.col("toc_n"), F.lit(0)))
    rest = F.substring("text", F.col("from") + 1, F.length("text"))
    first = F.coalesce(*[_before(rest, p) for p in FIRST]) + F.col("from")
    close = F.locate("---", F.col("text"), 4)
    matter = F.when(F.startswith("text", F.lit("---")) & (close > 0), close + 2)
    opened = toc.withColumn("start", F.coalesce(first, matter, F.lit(0)))
    body = F.substring("text", F.col("start") + 1, F.length("text"))
    stop = F.coalesce(_before(body, END) + _match(body, END) + F.col("start"), _before(t, FOOTER), F.length("text"))
    at = opened.withColumn("stop", stop)
    b = lambda c: F.octet_length(F.substring("text", F.lit(1), F.col(c)))
    n = F.octet_length("text")
    with_toc = F.array(_zone("front_matter", F.lit(0), b("toc")), _zone("toc", b("toc"), b("start")), _zone("body", b("start"), b("stop")), _zone("back_matter", b("stop"), n))
    without = F.array(_zone("front_matter", F.lit(0), b("start")), _zone("body", b("start"), b("stop")), _zone("back_matter", b("stop"), n))
    return at.select(key, F.when(F.col("start") > F.col("toc"), with_toc).otherwise(without).alias("zones"))


def from_offsets(size: Column, start: Column, end: Column, toc_start: Column, toc_end: Column) -> Column:
    """Zones that borders in bytes make; contents count if they lie in order before the body, and empty zones go."""
    zero = F.lit(0)
    good = F.coalesce((toc_start < toc_end) & (toc_end <= start), F.lit(False))
    front = F.when(good, F.array(_zone("front_matter", zero, toc_start), _zone("toc", toc_start, toc_end), _zone("front_matter", toc_end, start))).otherwise(F.array(_zone("front_matter", zero, start)))
    return F.filter(F.concat(front, F.array(_zone("body", start, end), _zone("back_matter", end, size))), lambda z: z.byte_end > z.byte_start)


def from_selection(chosen: DataFrame, candidates: DataFrame, key: str) -> DataFrame:
    """key, zones of chosen(key, head, tail, size): indexes into candidate lines; null where an index is wrong or the order is."""
    head, tail = (candidates.where(F.col("side") == s).select(key, F.col("idx").alias(s), F.col("byte_offset").alias(f"{s}_at"), F.octet_length("line").alias(f"{s}_n")) for s in ("head", "tail"))
    at = chosen.join(head, [key, "head"], "left").join(tail, [key, "tail"], "left")
    start, end = F.col("head_at"), F.col("tail_at") + F.col("tail_n")
    none = F.lit(None).cast("long")
    return at.select(key, F.when(start < end, from_offsets(F.col("size"), start, end, none, none)).alias("zones"))


def shifted(zones: Column, by: Column) -> Column:
    return F.transform(zones, lambda z: F.struct(z.kind.alias("kind"), F.greatest(F.lit(0), z.byte_start - by).alias("byte_start"), F.greatest(F.lit(0), z.byte_end - by).alias("byte_end")))


def of_byte(zones: Column, at: Column) -> Column:
    """Kind of the first zone that holds a byte; body beyond all."""
    return F.coalesce(F.get(F.filter(zones, lambda z: (z.byte_start <= at) & (at < z.byte_end)), F.lit(0)).kind, F.lit("body"))


def of_span(zones: Column, start: Column, end: Column) -> Column:
    """Kind of the first zone that holds a whole span; null where it crosses a border."""
    return F.get(F.filter(zones, lambda z: (z.byte_start <= start) & (end <= z.byte_end)), F.lit(0)).kind


def inside_body(zones: Column, start: Column, end: Column) -> Column:
    return F.exists(zones, lambda z: (z.kind == "body") & (z.byte_start <= start) & (end <= z.byte_end))
