"""Readers and writers on small files, and seals that are tampered with."""

import hashlib
import json
import sqlite3
import zipfile

import pytest
from pyspark.sql import functions as F
from textloom.sources import files, provider, writers

PAGE = "<html><body><h2>Head &eacute; &mdash; x</h2><p>{}</p><script>no()</script></body></html>"


def test_texts_of_any_bytes_and_fiction_books(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes("čau\n".encode() + b"\xffx")
    (tmp_path / "b.txt").write_text("plain")
    got = {r.path.rsplit("/", 1)[1]: r.text for r in files.plain_texts(spark, f"{tmp_path}/*.txt").collect()}
    assert got == {"a.txt": "čau\nx", "b.txt": "plain"}
    (tmp_path / "c.fb2").write_text("<a><b>one</b>\n<c>two</c></a>")
    assert files.fiction_books(spark, f"{tmp_path}/*.fb2").first().text == "one two"


def test_epubs_leave_out_covers_and_short_parts(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "x.epub", "w") as z:
        z.writestr("cover.xhtml", PAGE.format("cover " * 40))
        z.writestr("1.xhtml", PAGE.format("first part &copy; " * 10))
        z.writestr("2.html", PAGE.format("short"))
        z.writestr("3.htm", PAGE.format("third Ünï " * 10).encode("latin-1"))
        z.writestr("style.css", "p {}")
    with zipfile.ZipFile(tmp_path / "y.epub", "w") as z:
        z.writestr("nav.xhtml", PAGE.format("only this one " * 10))
    got = {r.path[-6:]: r.text for r in files.epubs(spark, f"{tmp_path}/*.epub").collect()}
    assert got["x.epub"].startswith("## Head é — x\n\nfirst part ©") and "third Ünï" in got["x.epub"] and "short" not in got["x.epub"] and "cover" not in got["x.epub"] and "no()" not in got["x.epub"]
    assert "only this one" in got["y.epub"]


def test_sqlite_is_read_only_and_in_ranges(spark, tmp_path):
    path = str(tmp_path / "x.db")
    c = sqlite3.connect(path)
    c.execute("create table t (id integer primary key, name text, score real, raw blob)")
    c.executemany("insert into t values (?, ?, ?, ?)", [(i, f"n{i}" if i % 2 else None, i / 2, b"x") for i in range(1, 26)])
    c.execute("create table empty (id integer)")
    c.commit()
    c.close()
    before = (tmp_path / "x.db").read_bytes()
    spark.dataSource.register(files.SqliteTable)
    df = spark.read.format("sqlite_table").option("table", "t").option("rows", 10).load(path)
    assert df.rdd.getNumPartitions() == 3 and df.agg(F.sum("id"), F.sum("score"), F.count("name")).first()[:] == (325, 162.5, 13)
    assert files.sqlite(spark, path, "empty").count() == 0 and (tmp_path / "x.db").read_bytes() == before


def test_sidecars_manifests_and_versions(spark, tmp_path):
    (tmp_path / "zones.json").write_text(json.dumps({"source_sha256": "s", "zones": [{"kind": "body", "byte_start": 0, "byte_end": 5}]}))
    assert files.zones(spark, str(tmp_path / "zones.json")).first()[:] == ("s", 0, "body", 0, 5)
    (tmp_path / "i.json").write_text(json.dumps({"indexer_version": "v2", "artifact_sha256": "a", "entries": [{"headword": "x", "normalized": "x", "byte_start": 3, "byte_len": 4}]}))
    assert files.versioned_index(spark, str(tmp_path / "i.json"), "v2").first().headword == "x"
    with pytest.raises(ValueError, match="v1"):
        files.versioned_index(spark, str(tmp_path / "i.json"), "v1")


def test_packages_are_written_and_read_back(spark, tmp_path):
    text = "Chapter One\r\nabc def\r\n\r\nChapter Two\r\nghi"
    works = spark.createDataFrame([("ann", "w1", "First", text), ("ann", "w2", "Second", "one two three"), ("bob", "w3", "Third", "")], "author_slug string, work_slug string, title string, text string")
    written = writers.write_files(writers.package(works), str(tmp_path)).collect()
    assert all(hashlib.sha256((tmp_path / r.path).read_bytes()).hexdigest() == r.sha256 for r in written)
    assert files.library(spark, str(tmp_path)).first()[:] == (2, 3, 10)
    got = {r.path.split("/")[-2]: r for r in files.packages(spark, str(tmp_path)).collect()}
    assert got["w1"].text == text.replace("\r\n", "\n") and "title: First" in got["w1"].header
    assert sorted(r.text[:15] for r in files.chapter_files(spark, str(tmp_path)).collect()) == ["# Chapter One\n\n", "# Chapter Two\n\n", "# Section 1\n\non"]
    assert files.chapter_files(spark, str(tmp_path), 2).count() == 1
    zones = {r.path.split("/")[-2]: r for r in files.library_zones(spark, str(tmp_path)).collect()}
    raw = (tmp_path / "ann/w1/full_text.md").read_bytes()
    assert zones["w1"].source_sha256 == hashlib.sha256(raw).hexdigest() and [(z.kind, raw[z.byte_start : z.byte_end][:12].strip()) for z in zones["w1"].zones] == [("front_matter", b"---\ntitle: F"), ("body", b"Chapter One"), ("back_matter", b"")]
    with pytest.raises(ValueError, match="leaves"):
        writers.inside(str(tmp_path), "../x")


def test_tables_are_not_overwritten_and_snapshots_stay(spark, tmp_path):
    df = spark.range(3)
    first = writers.snapshot(df, str(tmp_path / "t"), "1")
    with pytest.raises(Exception, match="exists"):
        writers.create(df, first)
    writers.append(spark.range(2).withColumn("more", F.lit(1)), str(tmp_path / "a"))
    writers.append(df, str(tmp_path / "a"))
    assert spark.read.option("mergeSchema", "true").parquet(str(tmp_path / "a")).where("more is null").count() == 3


def test_seal_fails_for_any_change(spark, tmp_path):
    for n in ("a.txt", "b.txt", "c.txt"):
        (tmp_path / n).write_text(n)
    root = f"file:{tmp_path}"
    read = lambda: files.artifacts(spark, f"{tmp_path}/*.txt").select("path", "sha256")
    anchor = writers.seal(read(), root)
    writers.verify_seal(read(), root, anchor)
    expected = spark.createDataFrame([(f"{root}/a.txt", hashlib.sha256(b"a.txt").hexdigest()), (f"{root}/b.txt", "0" * 64)], "path string, sha256 string")
    assert [r.path[-5:] for r in writers.checked_copy(read(), expected).collect()] == ["a.txt"]
    for change in (lambda: (tmp_path / "b.txt").write_text("B"), lambda: (tmp_path / "c.txt").unlink(), lambda: (tmp_path / "d.txt").write_text("d")):
        change()
        with pytest.raises(ValueError, match="seal_mismatch"):
            writers.verify_seal(read(), root, anchor)
    with pytest.raises(ValueError, match="head_chain_hash"):
        writers.verify_seal(read(), root, dict(writers.seal(read(), root), head_chain_hash="0" * 64))


def test_cards_report_and_receipt(spark, tmp_path):
    from textloom.operators import catalogue as C

    terms = spark.createDataFrame([("Robot", 1, "a machine"), (" robot", 1, None), ("Éra", None, None)], "term string, work_id long, definition string")
    rows = spark.createDataFrame([(1, "ROBOT ", 1, "attested", 1920, "a\nquote", None, None), (2, "robot", 1, "attested", 1900, None, None, None), (3, "robot", 2, "proposed", None, None, "x", None), (4, "robot", 1, "external", None, None, None, "who")], "id int, term string, work_id long, register string, year int, quote string, variant string, authority string")
    cards = C.cards(terms, rows).withColumn("title", F.lit("T")).withColumn("author", F.lit(None).cast("string"))
    counts = C.snapshot_counts(cards)
    assert counts.first().asDict() == {"cards": 3, "attestations": 2, "byte_verified": 1, "proposals": 1}
    writers.write_cards(cards, counts, str(tmp_path))
    said = (tmp_path / "cards.md").read_text()
    assert said.index("## robot") < said.index("## Éra") or "## Robot" in said
    assert "> a\n> quote" in said and "Earliest verified: 1920" in said and "not verified" in said and "Author: unknown" in said
    n = writers.catalogue_report(spark.createDataFrame([("B", 1920, "x", "verified", 1234, None), ("A", None, None, None, None, "pd")], "title string, year int, author string, class string, words long, rights string"), spark.sql("select 2 as total"), str(tmp_path / "r.md"))
    assert n == {"total": 2} and (tmp_path / "r.md").read_text().endswith("| **A** | — | — | `absent` | — | `pd` |\n| **B** | 1920 | x | `verified` | 1,234 | `unknown` |\n")
    r = writers.receipt({"t": spark.range(5)}, {"o": spark.range(5).repartition(3)}, spark.createDataFrame([("late",), ("late",)], "reason string"))
    assert r["inputs"]["t"] == r["outputs"]["o"] and r["rejected"] == {"late": 2}


def test_recorded_answers(spark, tmp_path):
    windows = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c"), (4, "d")], "window_id long, text string")
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    table = spark.createDataFrame([(sha("a"), '<think>x</think>```json\n{"candidates": ["x ", "x", "y",]}\n```'), (sha("b"), '{"candidates": []}'), (sha("c"), '{"candidates": [""]}')], "text_sha256 string, answer string")
    got = {r.window_id: (r.status, r.candidates) for r in provider.proposed(windows, provider.Recorded(table)).collect()}
    assert got == {1: ("ok", ["x", "y"]), 2: ("ok", []), 3: ("invalid_candidates", None), 4: ("invalid_candidates", None)}
    told = []
    done = provider.watched(lambda: windows, lambda *x: told.append(x), "plan")(path=str(tmp_path / "w"))
    assert done.count() == 4 and told == [("plan", 4)]
    a, w = provider.seeded(spark, [{"slug": "b"}, {"slug": "a"}], [{"slug": "w", "author_slug": "b"}, {"slug": "v", "author_slug": "z"}])
    assert {r.slug: r.author_id for r in w.collect()} == {"w": 2, "v": None}
    writers.preflight(str(tmp_path), 1, spark)
    with pytest.raises(RuntimeError, match="disk"):
        writers.preflight(str(tmp_path), 1 << 60, spark)


def test_run_time_is_utc(spark):
    import datetime

    from textloom.functions import raw as R

    got = spark.range(1).select(R.run_time().alias("now"), R.run_time("2024-01-01T00:00:00+00:00").alias("own")).first()
    assert abs((datetime.datetime.fromisoformat(got.now) - datetime.datetime.now(datetime.UTC)).total_seconds()) < 60 and got.own.startswith("2024")
