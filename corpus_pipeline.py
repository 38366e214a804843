"""Corpus pipeline: language ID, line dedup, SimHash near-dedup, decontamination, BPE encoding."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.llm import bpe, decontaminate, langid, lines, near
from textloom.llm.common import cut, table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
SMALL = 4_000_000  # numbers of rows, 32 MB, that are broadcast; more are joined by shuffle


BATCH_ROWS, FEW_ROWS = 10_000, 1_000  # rows that go to or from a Python worker at once; few where all are whole texts


def batches_of(spark: SparkSession, rows: int) -> None:
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", rows)


def numbered(docs: DataFrame) -> DataFrame:
    """Rows with a key of their own, which judges rows in place of a doc_id that may be null or repeat.

    Files may be split otherwise when read again, once executors are lost: they are checkpointed first,
    so that rows get the same keys each time."""
    return (cut(docs.select(COLUMNS)) if docs.inputFiles() else docs).withColumn("row", F.monotonically_increasing_id())


def without(rows: DataFrame, gone: DataFrame) -> DataFrame:
    """rows but those whose key is gone; texts move only where too many go to tell every task."""
    gone = cut(gone.select("row"))
    return rows.join(F.broadcast(gone) if gone.count() <= SMALL else gone, "row", "left_anti").select(COLUMNS)


def keep_known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows without a letter go, and those whose language has less than half the probability.

    Null texts go, and empty and letterless ones; each of repeated rows is judged, all alike, and so are
    rows with a null doc_id.  A table without labelled texts loses every row, an empty one has none."""
    batches_of(spark, BATCH_ROWS)
    said = langid.predict(docs, langid.train(docs), carry=["text", "lang", "source", "n_chars"])
    return said.where("lang_pred <> 'und' and score >= 0.5").select(COLUMNS)


def drop_shared_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts lose the lines that a smaller doc_id holds; the other columns stay, and every row.

    A null text becomes empty.  Rows with a null doc_id lose nothing, rows that share one lose alike.
    Texts of any length are split whole; an empty table has no rows."""
    batches_of(spark, BATCH_ROWS)
    new = lines.dedup_lines(docs, carry=["lang", "source"])
    return new.select("doc_id", F.col("kept").alias("text"), F.col("_c0").alias("lang"), F.col("_c1").alias("source"), F.length("kept").cast("long").alias("n_chars"))


def keep_one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The smallest doc_id of each group of 5-word similarity 0.8 or more stays.

    A null doc_id comes after all others, and of equal ones any one row stays; null texts are empty,
    and texts without words are one group.  Repeated rows are one group too, so one of them stays; texts of any
    length are compared whole, and an empty table has no rows."""
    batches_of(spark, BATCH_ROWS)
    rows = numbered(docs)
    groups = cut(near.similar_groups(rows))
    best = groups.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "row")).alias("best"))
    return without(rows, groups.join(best.select("best.row"), "row", "left_anti"))


def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that hold a benchmark item go, whatever their doc_id; null and empty texts hold none.

    Repeated rows are judged each, all alike; texts of any length are read whole; an empty table has no rows, and
    with an empty benchmark every row stays."""
    batches_of(spark, BATCH_ROWS)
    rows = numbered(docs)
    leaks = decontaminate.matches(rows.select(F.col("row").alias("doc_id"), "text"), table(spark, sf_dir, "benchmark"))
    return without(rows, leaks.select(F.col("doc_id").alias("row")).distinct())


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens and digests of ids and of the decoded text of every row; a null text is empty.

    Repeated rows are encoded each; texts of any length are encoded whole; an empty table has no rows."""
    batches_of(spark, FEW_ROWS)
    return bpe.encode_documents(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES = [
    ("language_id", keep_known_language),
    ("line_dedup", drop_shared_lines),
    ("simhash_near_dedup", keep_one_of_each_group),
    ("decontamination", drop_benchmark_leaks),
    ("bpe", encode),
]

ORACLE_SQL = None  # a trained network and a tokenizer are not SQL


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = cut(docs)
    return docs
