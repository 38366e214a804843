"""Readers of texts, books, artifacts, sidecars, manifests and SQLite files."""

from __future__ import annotations

import html
import io
import sqlite3
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

from textloom.functions import text as T
from textloom.operators import zones as Z

ZONES = "source_sha256 string, zones array<struct<kind string, byte_start bigint, byte_end bigint>>"
MANIFEST = "author_slug string, work_slug string, title string, word_count bigint, chapters array<struct<index bigint, title string, word_count bigint>>"
INDEX = "indexer_version string, artifact_sha256 string, entries array<struct<headword string, normalized string, byte_start bigint, byte_len bigint>>"
PAGES = (".xhtml", ".html", ".htm")
SIDE = ("cover", "nav", "toc")  # names of pages that are not text


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def artifacts(spark: SparkSession, path: str) -> DataFrame:
    """path, content, sha256 of whole files."""
    return spark.read.format("binaryFile").load(path).select("path", "content", F.sha2("content", 256).alias("sha256"))


def json_documents(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).option("multiLine", True).json(path)


def zones(spark: SparkSession, path: str) -> DataFrame:
    """One row per zone, with its place in the sidecar's list."""
    side = json_documents(spark, path, ZONES)
    return side.select("source_sha256", F.posexplode("zones").alias("ord", "z")).select("source_sha256", "ord", "z.*")


def plain_texts(spark: SparkSession, path: str) -> DataFrame:
    """path, text of text and Markdown files; bytes that are not UTF-8 are left out."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"path": b.path, "text": [c.decode("utf-8", "ignore") for c in b.content]})

    raw = spark.read.format("binaryFile").load(path).select("path", "content", F.is_valid_utf8(F.col("content").cast("string")).alias("ok"))
    good = raw.where("ok").select("path", F.col("content").cast("string").alias("text"))
    return good.unionByName(raw.where("not ok").select("path", "content").mapInPandas(run, "path string, text string"))


def fiction_books(spark: SparkSession, path: str) -> DataFrame:
    return plain_texts(spark, path).select("path", T.fiction_book_text(F.col("text")).alias("text"))


def epub_members(spark: SparkSession, path: str) -> DataFrame:
    """path, ord, member, html of the pages of e-books; covers and contents only if there is nothing else."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for p, content in zip(b.path, b.content, strict=True):
                with zipfile.ZipFile(io.BytesIO(content)) as z:
                    pages = [n for n in z.namelist() if n.lower().endswith(PAGES)]
                    own = [n for n in pages if not any(s in n.lower() for s in SIDE)] or pages
                    for i, n in enumerate(own):
                        raw = z.read(n)
                        try:
                            page = raw.decode("utf-8")
                        except UnicodeDecodeError:
                            page = raw.decode("latin-1")
                        yield pd.DataFrame({"path": [p], "ord": [i], "member": [n], "html": [page]})

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, "path string, ord int, member string, html string")


def whole_html_text(c) -> Column:
    """Text of a page with every entity of HTML read: those beyond the common ones by Arrow batches, where there are any."""

    @F.pandas_udf("string")
    def unescape(c: pd.Series) -> pd.Series:
        return c.map(html.unescape, na_action="ignore")

    plain = T.html_text(c)
    return F.when(plain.rlike("&#?[A-Za-z0-9]+;"), T.strip(F.regexp_replace(unescape(plain), "\n{3,}", "\n\n"))).otherwise(plain)


def epubs(spark: SparkSession, path: str) -> DataFrame:
    """path, text of e-books: the parts of more than 80 characters, a blank line between them."""
    parts = epub_members(spark, path).withColumn("text", whole_html_text(F.col("html"))).where(F.length("text") > 80)
    return parts.groupBy("path").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("ord", "text"))), lambda x: x.text), "\n\n").alias("text"))


def versioned_index(spark: SparkSession, path: str, version: str) -> DataFrame:
    """Entries of a headword index of that version of its maker; any other raises."""
    raw = json_documents(spark, path, INDEX)
    found = [r[0] for r in raw.select("indexer_version").distinct().limit(2).collect()]
    if found != [version]:
        raise ValueError(f"index was made by {found}, not by {version}: make it anew")
    return raw.select("artifact_sha256", F.posexplode("entries").alias("ord", "e")).select("artifact_sha256", "ord", "e.*")


def library(spark: SparkSession, root: str) -> DataFrame:
    """One row: authors, works and words of the manifests under a root."""
    m = json_documents(spark, f"{root}/*/*/manifest.json", MANIFEST)
    return m.agg(F.countDistinct("author_slug").alias("authors"), F.count("*").alias("works"), F.coalesce(F.sum("word_count"), F.lit(0)).alias("words"))


def library_zones(spark: SparkSession, root: str) -> DataFrame:
    """path, source_sha256, zones of every full text under a root, found in one pass: bound to the bytes they were found in."""
    full = plain_texts(spark, f"{root}/*/*/full_text.md")
    found = Z.detect(full, "path")
    return found.join(artifacts(spark, f"{root}/*/*/full_text.md").select("path", F.col("sha256").alias("source_sha256")), "path").select("path", "source_sha256", "zones")


def packages(spark: SparkSession, root: str) -> DataFrame:
    """path, header, text of the full texts under a root, front matter taken off."""
    full = plain_texts(spark, f"{root}/*/*/full_text.md")
    return full.select("path", T.front_matter(F.col("text")).alias("f")).select("path", "f.header", F.col("f.body").alias("text"))


def chapter_files(spark: SparkSession, root: str, index: int | None = None) -> DataFrame:
    """path, index, text of the chapter files under a root."""
    every = plain_texts(spark, f"{root}/*/*/chapters/chapter_*.md").withColumn("index", F.regexp_extract("path", r"chapter_(\d+)\.md$", 1).cast("int"))
    return every if index is None else every.where(F.col("index") == index)


class SqliteTable(DataSource):
    """A table of an SQLite file, opened read-only, in ranges of row numbers: spark.read.format("sqlite_table").option("table", t).load(path)."""

    KINDS = {"INTEGER": "bigint", "REAL": "double", "TEXT": "string", "BLOB": "binary"}

    @classmethod
    def name(cls) -> str:
        return "sqlite_table"

    def _connect(self) -> sqlite3.Connection:
        return sqlite3.connect(f"file:{self.options['path']}?mode=ro", uri=True)

    def schema(self) -> str:
        c = self._connect()
        try:
            return ", ".join(f"`{n}` {self.KINDS.get(t.upper().split('(')[0], 'string')}" for _, n, t, *_ in c.execute(f'PRAGMA table_info("{self.options["table"]}")'))
        finally:
            c.close()

    def reader(self, schema: StructType) -> DataSourceReader:
        return SqliteReader(self.options, schema.names)


class Range(InputPartition):
    def __init__(self, low: int, high: int):
        self.low, self.high = low, high


class SqliteReader(DataSourceReader):
    def __init__(self, options: dict, names: list[str]):
        self.path, self.table, self.size, self.names = options["path"], options["table"], int(options.get("rows", 100_000)), names

    def _connect(self) -> sqlite3.Connection:
        return sqlite3.connect(f"file:{self.path}?mode=ro", uri=True)

    def partitions(self) -> list[Range]:
        c = self._connect()
        low, high = c.execute(f'SELECT coalesce(min(rowid), 0), coalesce(max(rowid), -1) FROM "{self.table}"').fetchone()
        c.close()
        return [Range(i, min(i + self.size, high + 1)) for i in range(low, high + 1, self.size)] or [Range(0, 0)]

    def read(self, partition: Range) -> Iterator[tuple]:
        c = self._connect()
        try:
            columns = ", ".join(f'"{n}"' for n in self.names)
            yield from c.execute(f'SELECT {columns} FROM "{self.table}" WHERE rowid >= ? AND rowid < ?', (partition.low, partition.high))
        finally:
            c.close()


def sqlite(spark: SparkSession, path: str, name: str) -> DataFrame:
    spark.dataSource.register(SqliteTable)
    return spark.read.format("sqlite_table").option("table", name).load(path)
