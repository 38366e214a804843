"""Where candidates and fixtures come from: the one interface to be replaced, and seeds."""

from __future__ import annotations

from collections.abc import Callable
from typing import Protocol

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.functions import text as T

ANSWER = "candidates array<string>"


class CandidateProvider(Protocol):
    """windows(window_id, text, title, author) to answers(window_id, answer): one string of JSON each."""

    def answers(self, windows: DataFrame) -> DataFrame: ...


class Recorded:
    """Answers that were recorded earlier, by hash of the window's text: what offline runs and tests use."""

    def __init__(self, table: DataFrame):
        self.table = table

    def answers(self, windows: DataFrame) -> DataFrame:
        known = self.table.select("text_sha256", "answer")
        return windows.withColumn("text_sha256", F.sha2("text", 256)).join(known, "text_sha256", "left").select("window_id", "answer")


def proposed(windows: DataFrame, provider: CandidateProvider) -> DataFrame:
    """window_id, status, candidates: an answer that is not a list of non-blank strings is an error, an empty list is none."""
    said = provider.answers(windows).withColumn("c", F.from_json(T.rescue_json(F.col("answer")), ANSWER).candidates)
    ok = F.col("c").isNotNull() & F.forall("c", lambda x: ~T.blank(x))
    return said.select("window_id", F.when(ok, "ok").otherwise("invalid_candidates").alias("status"), F.when(ok, F.array_distinct(F.transform("c", T.strip))).alias("candidates"))


def seeded(spark: SparkSession, authors: list[dict], works: list[dict]) -> tuple[DataFrame, DataFrame]:
    """Constant lists as tables; works name their author by slug and get the author's id, in order of slug."""
    a = spark.createDataFrame([dict(x, id=i) for i, x in enumerate(sorted(authors, key=lambda x: x["slug"]), 1)])
    w = spark.createDataFrame(works)
    return a, w.join(a.select(F.col("slug").alias("author_slug"), F.col("id").alias("author_id")), "author_slug", "left")


def watched(step: Callable[..., DataFrame], told: Callable[[str, int], None], name: str) -> Callable[..., DataFrame]:
    """A step that tells its name and number of rows once it is done; the rows come from its written result."""

    def run(*args, path: str, **more) -> DataFrame:
        out = step(*args, **more)
        out.write.mode("errorifexists").parquet(path)
        done = out.sparkSession.read.parquet(path)
        told(name, done.count())
        return done

    return run
