"""Writers: packages of works, exports of cards, reports, receipts, snapshots and seals.

Tables are written by the executors.  Only what is one file by its nature, a report or an export,
passes through one task, row by row in order."""

from __future__ import annotations

import json
import shutil
from collections.abc import Iterator
from pathlib import Path

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.functions import raw as R
from textloom.functions import text as T


def create(df: DataFrame, path: str) -> None:
    """Writes a table that must not be there yet."""
    df.write.mode("errorifexists").parquet(path)


def append(df: DataFrame, path: str) -> None:
    """Adds rows; columns that either side lacks are null."""
    df.write.mode("append").option("mergeSchema", "true").parquet(path)


def snapshot(df: DataFrame, root: str, version: str) -> str:
    """An immutable version of a table, in a folder of its own."""
    path = f"{root}/version={version}"
    create(df, path)
    return path


def front_matter(**fields: Column) -> Column:
    """A header of `key: value` lines between two lines of dashes."""
    lines = [F.concat(F.lit(f"{k}: "), F.coalesce(v.cast("string"), F.lit(""))) for k, v in fields.items()]
    return F.concat_ws("\n", F.lit("---"), *lines, F.lit("---"), F.lit(""))


def package(works: DataFrame) -> DataFrame:
    """works(author_slug, work_slug, title, text) with the files of each package: path, content.

    A full text with front matter, its chapters (or sections of 3,000 words), and a manifest."""
    text = T.newlines(F.col("text"))
    base = works.withColumn("text", text).withColumn("dir", F.concat_ws("/", "author_slug", "work_slug")).withColumn("words", T.word_count("text"))
    parts = F.transform(T.chapters(F.col("text")), lambda c: F.struct(c.title.alias("title"), T.strip(F.substring(F.col("text"), c.start + 1, c.end - c.start)).alias("text")))
    sections = F.transform(T.chunks(F.col("text")), lambda w, i: F.struct(F.concat(F.lit("Section "), (i + 1).cast("string")).alias("title"), F.array_join(w, " ").alias("text")))
    held = base.withColumn("parts", F.coalesce(parts, sections, F.array().cast("array<struct<title:string,text:string>>")))
    header = front_matter(title=F.col("title"), author=F.col("author_slug"), word_count=F.col("words"), token_estimate=T.token_estimate("text"), sha256=F.sha2("text", 256))
    listed = F.transform("parts", lambda p, i: F.struct((i + 1).alias("index"), p.title.alias("title"), T.word_count(p.text).alias("word_count")))
    manifest = F.to_json(F.struct("author_slug", "work_slug", "title", F.col("words").alias("word_count"), listed.alias("chapters")))
    one = lambda name, content: F.struct(F.concat(F.col("dir"), F.lit(f"/{name}")).alias("path"), content.alias("content"))
    chapters = F.transform("parts", lambda p, i: F.struct(F.concat(F.col("dir"), F.lit("/chapters/chapter_"), F.lpad((i + 1).cast("string"), 2, "0"), F.lit(".md")).alias("path"), F.concat(F.lit("# "), p.title, F.lit("\n\n"), p.text).alias("content")))
    files = F.concat(F.array(one("full_text.md", F.concat(header, F.col("text"))), one("original.txt", F.col("text")), one("manifest.json", manifest)), chapters)
    return held.select(F.explode(files).alias("f")).select("f.*")


def write_files(files: DataFrame, root: str) -> DataFrame:
    """Each row (path, content) as a file under a root that all executors share; gives path, sha256 of what was written.

    A task that runs again writes the same bytes over its own."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for path, content in zip(b.path, b.content, strict=True):
                target = inside(root, path)
                target.parent.mkdir(parents=True, exist_ok=True)
                target.write_bytes(content.encode("utf-8"))
            yield b[["path", "sha256"]]

    return files.withColumn("sha256", F.sha2("content", 256)).mapInPandas(run, "path string, sha256 string")


def inside(root: str, name: str) -> Path:
    """A path under the root; one that leads out of it raises."""
    base = Path(root).resolve()
    path = (base / name).resolve()
    if not path.is_relative_to(base):
        raise ValueError(f"path leaves its root: {name}")
    return path


def card_lines(cards: DataFrame) -> DataFrame:
    """ord, line: cards(term, title, author, definition, earliest, attestations, proposals, external) as Markdown, one row a card."""
    part = lambda test, *lines: F.when(test, F.array(*lines)).otherwise(F.array().cast("array<string>"))
    quote = lambda q: F.array_join(F.transform(F.split(q, "\n"), lambda x: F.rtrim(F.concat(F.lit("> "), x))), "\n")
    shown = F.flatten(F.transform("attestations", lambda a: F.array(F.concat(F.lit("Attestation #"), a.id.cast("string"), F.lit(":")), F.coalesce(quote(a.quote), F.lit("not verified")), F.lit(""))))
    offered = F.flatten(F.transform("proposals", lambda p: F.array(F.concat(F.lit("### Proposal: "), p.variant), F.lit(""))))
    held = F.flatten(F.transform("external", lambda e: F.array(F.concat(F.lit("External: "), e.authority), F.lit(""))))
    lines = F.concat(
        F.array(F.concat(F.lit("## "), F.col("term")), F.lit(""), F.format_string("Work: %s. Author: %s.", F.coalesce("title", F.lit("unknown")), F.coalesce("author", F.lit("unknown"))), F.lit("")),
        part(F.col("definition").isNotNull(), F.col("definition"), F.lit("")),
        part(F.col("earliest").isNotNull(), F.concat(F.lit("Earliest verified: "), F.col("earliest").cast("string")), F.lit("")),
        shown, part(~F.exists("attestations", lambda a: a.quote.isNotNull()), F.lit("No verified quote."), F.lit("")), offered, held,
    )
    return cards.select("key", F.coalesce("work_id", F.lit(-1)).alias("work_id"), F.array_join(lines, "\n").alias("line"))


def write_report(lines: DataFrame, order: list[str], path: str, head: str = "") -> None:
    """Lines in order as one text file, streamed to the driver partition by partition."""
    target = Path(path)
    target.parent.mkdir(parents=True, exist_ok=True)
    with open(target, "w", encoding="utf-8", newline="\n") as f:
        f.write(head)
        for r in lines.orderBy(*order).select("line").toLocalIterator():
            f.write(r.line + "\n")


def write_cards(cards: DataFrame, counts: DataFrame, folder: str) -> None:
    """Markdown for reading, JSON lines for machines."""
    n = counts.first().asDict()
    write_report(card_lines(cards), ["key", "work_id"], f"{folder}/cards.md", f"# Cards\n\nCounts: {json.dumps(n, sort_keys=True)}\n\n")
    cards.write.mode("errorifexists").json(f"{folder}/cards.json")


def catalogue_line() -> Column:
    cell = lambda c, none="—": F.coalesce(F.col(c).cast("string"), F.lit(none))
    return F.concat(F.lit("| **"), cell("title"), F.lit("** | "), cell("year"), F.lit(" | "), cell("author"), F.lit(" | `"), cell("class", "absent"), F.lit("` | "), F.coalesce(F.format_number("words", 0), F.lit("—")), F.lit(" | `"), cell("rights", "unknown"), F.lit("` |"))


def catalogue_report(works: DataFrame, counters: DataFrame, path: str) -> dict:
    """A table of works(title, year, author, class, words, rights) by year and title, and the counters."""
    n = counters.first().asDict()
    head = "# Library\n\n" + "".join(f"- {k}: {v:,}\n" for k, v in n.items()) + "\n| work | year | author | class | words | rights |\n| --- | --- | --- | --- | --- | --- |\n"
    write_report(works.select(F.coalesce("year", F.lit(0)).alias("y"), "title", catalogue_line().alias("line")), ["y", "title", "line"], path, head)
    return n


def receipt(inputs: dict[str, DataFrame], outputs: dict[str, DataFrame], rejected: DataFrame) -> dict:
    """Rows and hashes of what a run read and wrote, and how many rows it rejected for which reason."""
    seen = lambda df: {"rows": df.count(), "sha256": R.relation_hash(df, df.columns).first()[0]}
    return {"inputs": {k: seen(v) for k, v in inputs.items()}, "outputs": {k: seen(v) for k, v in outputs.items()}, "rejected": {r.reason: r.n for r in rejected.groupBy("reason").agg(F.count("*").alias("n")).collect()}}


def checked_copy(files: DataFrame, expected: DataFrame) -> DataFrame:
    """Files whose bytes have the expected hash (path, sha256)."""
    return files.join(expected, ["path", "sha256"], "left_semi")


def seal(files: DataFrame, root: str) -> dict:
    """Manifest hash, head and count of files(path, sha256): hashes of files in order of path, chained.

    The chain is our own: each link is the hash of the link before and of one path and hash."""
    named = files.select(F.substring("path", F.length(F.lit(root)) + 2, F.length("path")).alias("uri"), "sha256").orderBy("uri")
    head, n, manifest = "0" * 64, 0, []
    import hashlib

    for r in named.toLocalIterator():  # a bundle's file list, two strings a file
        head = hashlib.sha256(f"{head}\n{r.uri}\n{r.sha256}".encode()).hexdigest()
        manifest.append((r.uri, r.sha256))
        n += 1
    return {"manifest_sha256": hashlib.sha256(json.dumps(manifest).encode()).hexdigest(), "head_chain_hash": head, "artifact_count": n}


def verify_seal(files: DataFrame, root: str, anchor: dict) -> None:
    """Raises unless files make the anchor again; the anchor is kept apart from them and given here."""
    now = seal(files, root)
    for k in ("artifact_count", "manifest_sha256", "head_chain_hash"):
        if now[k] != anchor[k]:
            raise ValueError(f"seal_mismatch:{k}")


def preflight(folder: str, free_bytes: int, spark: SparkSession, cores: int = 1) -> None:
    """Raises unless the driver's folder has room and the session the cores asked for."""
    if shutil.disk_usage(folder).free < free_bytes:
        raise RuntimeError("disk_space")
    if spark.sparkContext.defaultParallelism < cores:
        raise RuntimeError("cores")
