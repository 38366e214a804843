"""Bytes of texts in blocks, so that a stored place fetches one block in place of its whole text.

Blocks of `size` bytes overlap by `reach`: a span of at most `reach` bytes lies whole in the block that it begins
in, and one equi-join on (key, block) fetches it.  What is shuffled is the corpus once and a block for each span's
slice; the slice is cut right after the join.  Witnesses that stand in their text's own row need no join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.functions import raw as R
from textloom.operators import evidence as E

SIZE, REACH = 4096, 512


def _parts(content: Column, size: int, reach: int) -> Column:
    """The blocks of a text's bytes, in order; an empty text has one empty block."""
    ends = F.sequence(F.lit(0), F.floor(F.greatest(F.lit(0), F.octet_length(content) - 1) / size).cast("int"))
    return F.transform(ends, lambda k: F.substring(content, k * size + 1, F.lit(size + reach)))


def store(docs: DataFrame, key: str = "doc_id", size: int = SIZE, reach: int = REACH) -> DataFrame:
    """key, block, bytes of docs(key, text); an empty text has one empty block, a null text none."""
    return docs.where("text is not null").select(key, F.encode("text", "utf-8").alias("content")).select(key, F.posexplode(_parts(F.col("content"), size, reach)).alias("block", "bytes"))


def artifacts(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """key, size and sha256 of each text's bytes; both null where the text is."""
    content = F.encode("text", "utf-8")
    return docs.select(key, F.octet_length(content).cast("long").alias("size"), F.sha2(content, 256).alias("sha256"))


def _length(length: Column, reach: int) -> Column:
    return F.when(length > reach, F.raise_error(F.lit("span longer than the blocks overlap")).cast("long")).otherwise(length.cast("long"))


def _block(at: Column, size: int) -> Column:
    return F.floor(F.greatest(F.lit(0), at) / size).cast("int")


def _cut(block: Column, at: Column, n: Column, size: int) -> Column:
    """What the block that a span begins in has of it."""
    return F.when((at < 0) | (n <= 0), F.lit(b"")).otherwise(F.substring(block, (at - _block(at, size) * size + 1).cast("int"), n.cast("int")))


def fetch(spans: DataFrame, blocks: DataFrame, start: Column, length: Column, key: str = "doc_id", size: int = SIZE, reach: int = REACH) -> DataFrame:
    """spans with `part`, the bytes [start, start + length) as far as there are any; null where the text is not stored.

    Spans longer than `reach` are an error: they need longer blocks.  A negative start or length has no bytes."""
    asked = spans.withColumn("_at", start.cast("long")).withColumn("_n", _length(length, reach)).withColumn("_block", _block(F.col("_at"), size))
    held = blocks.select(F.col(key), F.col("block").alias("_block"), F.col("bytes").alias("_bytes"))
    joined = asked.join(held, [key, "_block"], "left")
    return joined.select(*spans.columns, F.when(F.col("_bytes").isNotNull(), _cut(F.col("_bytes"), F.col("_at"), F.col("_n"), size)).alias("part"))


def _reason() -> Column:
    """The first check that a witness fails, or ok, from its own columns, `_sha256` of the text and `part`, the bytes that it names.

    The same order as evidence.verdict."""
    part = F.coalesce(F.col("part"), F.lit(b""))  # beyond the last block there are no bytes
    text = F.when(F.is_valid_utf8(part.cast("string")), part.cast("string")).otherwise("")
    near = lambda c: F.coalesce((F.col(c) != "") & F.lower(text).contains(F.lower(F.col(c))), F.lit(False))
    named = F.coalesce(F.col("term"), F.lit("")) != ""
    return (
        F.when(F.col("_sha256").isNull(), "file_not_found")
        .when(~F.col("_sha256").eqNullSafe(F.col("artifact_sha256")), "artifact_drift")
        .when(F.octet_length(part) != F.col("byte_len"), "short_read")
        .when(~F.sha2(part, 256).eqNullSafe(F.col("window_sha256")), "window_mismatch")
        .when(~F.is_valid_utf8(part.cast("string")), "decode_error")
        .when(named & ~(near("term") | near("matched_form") | E.has_term(text, F.col("term"))), "term_absent")
        .otherwise("ok")
    )


def verdicts(witnesses: DataFrame, docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """witnesses(key, term, byte_start, byte_len, window_sha256, artifact_sha256, matched_form) with `reason`: the first check that fails, or ok.

    From digests of texts and fetched windows alone."""
    known = artifacts(docs, key).select(key, F.col("sha256").alias("_sha256"))
    return fetch(witnesses, store(docs, key), F.col("byte_start"), F.col("byte_len"), key).join(known, key, "left").select(*witnesses.columns, _reason().alias("reason"))


def listed_verdicts(docs: DataFrame, key: str = "doc_id", size: int = SIZE, reach: int = REACH) -> DataFrame:
    """key, the witnesses' fields and `reason` of docs(key, text, found), each with an array of its witnesses' structs.

    Blocks, digest and witnesses of a text stand in one row: each window is fetched from its block there, and no witness is shuffled."""
    w = [f.name for f in docs.schema["found"].dataType.elementType.fields]
    held = docs.select(key, "found", F.encode("text", "utf-8").alias("_content"))
    once = F.struct(F.sha2("_content", 256).alias("_sha256"), _parts(F.col("_content"), size, reach).alias("_blocks"))
    held = held.select(key, "found", F.inline(F.array(once)))  # made once a text: as plain columns they would be made for each witness

    def one(x: Column) -> Column:
        at = x.byte_start.cast("long")
        part = _cut(F.get("_blocks", _block(at, size)), at, _length(x.byte_len, reach), size)
        return F.named_struct(*[c for k in w for c in (F.lit(k), x[k])], F.lit("part"), part)

    flat = held.select(key, "_sha256", F.explode(F.transform("found", one)).alias("_w")).select(key, "_sha256", "_w.*")
    return flat.select(key, *w, _reason().alias("reason"))
