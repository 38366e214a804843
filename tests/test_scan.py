"""One-pass occurrences and their windows, stored windows by blocks, places by maps: against plain versions."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from textloom.functions import text as T
from textloom.operators import blocks as B
from textloom.operators import evidence as E
from textloom.operators import scan

WORDS = ["robot", "Robots", "time", "machine", "čas", "ROBOTICS", "日本", "🙂", "an", "time-machine", "ß", "robotický"]
TERMS = ["robot", "time machine", "čas", "an", "日本"]


def made_texts():
    rng = random.Random(11)
    return [(i, "".join(rng.choice(WORDS) + rng.choice([" ", "  ", "\n", ", ", "-", " "]) for _ in range(n))) for i, n in enumerate((0, 1, 5, 40, 400, 3000))] + [(90, None), (91, "x" * 50_000 + " robot"), (92, "🙂" * 300 + " čas " + "🙂" * 300), (92, "robot")]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(made_texts(), "doc_id long, text string")


@pytest.fixture(scope="module")
def terms(spark):
    return spark.createDataFrame([(t,) for t in TERMS], "term string")


def edge(data, at, step):
    if at <= 0 or at >= len(data):
        return max(0, min(at, len(data)))
    while at < len(data) and data[at] & 0xC0 == 0x80:
        at += step
    return at


def test_windows_come_with_their_places(docs, terms):
    plain = sorted(map(tuple, E.occurrences(docs, terms).select("doc_id", "term", "idx", "byte_offset", "form").collect()))
    text = {i: (t or "").encode() for i, t in made_texts()[:-1]}
    shown = E.witnesses(docs, terms).where("doc_id <> 92").collect()
    assert sorted((r.doc_id, r.term, r.idx, r.byte_offset, r.matched_form) for r in shown) == [x for x in plain if x[0] != 92] and len(shown) > 900
    total = {}
    for r in shown:
        data = text[r.doc_id]
        a = edge(data, max(0, r.byte_offset - 80), -1)
        b = edge(data, min(len(data), a + 200), 1)
        assert (r.byte_start, r.byte_len, r.window_sha256) == (a, b - a, hashlib.sha256(data[a:b]).hexdigest())
        total[r.doc_id, r.term] = total.get((r.doc_id, r.term), 0) + 1
    assert all(r.occurrences_total == total[r.doc_id, r.term] for r in shown)
    for r in E.localised(docs, terms).where("doc_id <> 92").collect():
        data, n = text[r.doc_id], next(len(x[4].encode()) for x in plain if (x[0], x[1], x[2]) == (r.doc_id, r.term, 0))
        a = edge(data, max(0, r.byte_offset - 100), 1)
        assert (r.byte_start, r.byte_start + r.byte_len) == (a, edge(data, min(len(data), max(r.byte_offset + n, a + 320)), -1))


def test_more_tries_find_the_same(docs, terms, monkeypatch):
    want = sorted(map(tuple, E.occurrences(docs, terms).collect()))
    monkeypatch.setattr(scan, "LIST_BYTES", 150)
    monkeypatch.setattr(scan, "ROWS", 7)
    monkeypatch.setattr(scan, "WORDS_KEPT", 3)
    assert sorted(map(tuple, E.occurrences(docs, terms).collect())) == want


def test_texts_with_terms_of_their_own(docs, terms):
    every = E.occurrences(docs, terms)
    own = docs.withColumn("terms", F.when(F.col("doc_id") % 2 == 0, F.array(F.lit("robot"), F.lit("čas"), F.lit(None).cast("string"))))
    got = scan.own_occurrences(own, "terms")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, every.where("doc_id % 2 = 0 and term in ('robot', 'čas')").collect()))


def test_no_terms_and_no_texts(spark, docs, terms):
    assert E.occurrences(docs, terms.limit(0)).count() == 0 and E.occurrences(docs.limit(0), terms).count() == 0
    assert E.occurrences(docs, spark.createDataFrame([("--",), (None,), ("",)], "term string")).count() == 0


def test_stored_windows_by_blocks(spark, docs, terms):
    one = docs.where("doc_id <> 92 or text <> 'robot'")
    w = E.witnesses(one, terms).join(B.artifacts(one).select("doc_id", F.col("sha256").alias("artifact_sha256")), "doc_id").select("doc_id", "term", "idx", "byte_start", "byte_len", "window_sha256", "artifact_sha256", "matched_form")
    assert {r.reason for r in B.verdicts(w, one).collect()} == {"ok"}
    small = B.store(one, size=64, reach=512)
    got = B.fetch(w, small, F.col("byte_start"), F.col("byte_len"), size=64)
    assert got.count() == w.count() and got.where(F.sha2("part", 256) != F.col("window_sha256")).count() == 0
    bad = {
        "file_not_found": w.withColumn("doc_id", F.col("doc_id") + 1000), "artifact_drift": w.withColumn("artifact_sha256", F.lit("0")), "short_read": w.withColumn("byte_start", F.lit(10_000_000)), "window_mismatch": w.withColumn("window_sha256", F.lit("0")),
        "term_absent": w.withColumn("term", F.lit("zzz")).withColumn("matched_form", F.lit("zzz")),
    }
    for reason, rows in bad.items():
        assert {r.reason for r in B.verdicts(rows, one).collect()} == {reason}
    assert {r.reason for r in B.verdicts(w.withColumn("byte_start", F.lit(-1)), one).collect()} == {"short_read"}
    cut = spark.createDataFrame([(92, "čas", 0, 1, 9, hashlib.sha256(("🙂" * 3).encode()[1:10]).hexdigest(), hashlib.sha256(("🙂" * 300 + " čas " + "🙂" * 300).encode()).hexdigest(), None)], w.schema)
    assert B.verdicts(cut, one).first().reason == "decode_error"
    with pytest.raises(Exception, match="longer than the blocks overlap"):
        B.fetch(w, small, F.col("byte_start"), F.lit(1000), size=64).collect()


def test_many_quotes_of_one_text(spark):
    rng = random.Random(2)
    texts = ["".join(rng.choice(["a", "b", "ß", "日", " ", "  ", "\n\t", "　", "🙂"]) for _ in range(n)) for n in (0, 3, 60, 900)]
    asked = [(t, [None, " ", *(("".join(rng.choice(["a", "b", "ß", " ", "日"]) for _ in range(rng.randint(1, 4)))) for _ in range(40)), *(t[i : i + 5] for i in range(0, len(t), 7))]) for t in texts]
    flat = lambda s: " ".join(s.split()) if s.strip() else ""
    for r in spark.createDataFrame(asked, "t string, qs array<string>").select("t", "qs", T.locate_all(F.col("t"), F.col("qs")).alias("x")).collect():
        squeezed = "".join(" " if c.isspace() else c for i, c in enumerate(r.t) if not (c.isspace() and i and r.t[i - 1].isspace()))
        for q, x in zip(r.qs, r.x, strict=True):
            n = sum(squeezed.startswith(flat(q or ""), i) for i in range(len(squeezed)))
            want = "empty_quote" if not flat(q or "") else "quote_absent" if n == 0 else "quote_ambiguous" if n > 1 else None
            assert x.error == want
            if want is None:
                part = r.t.encode()[x.byte_start : x.byte_start + x.byte_len].decode()
                assert flat(part) == flat(q) == part.replace(part, flat(part)) and part == part.strip() and (x.alignment == "exact") == (part == q)


def test_a_long_text_is_mapped_once(spark):
    t = "слово  і ще\n" * 90_000
    df = spark.createDataFrame([(t + "кінець  тут", ["кінець тут", "немає"] * 300)], "t string, qs array<string>")
    x = df.select(T.locate_all(F.col("t"), F.col("qs")).alias("x")).first().x
    assert len(x) == 600 and x[0].byte_start == len(t.encode()) and x[0].alignment == "whitespace_only" and x[1].error == "quote_absent"


def test_places_listed_in_their_texts_rows(docs, terms, monkeypatch):
    want = sorted(map(tuple, E.witnesses(docs, terms).where("idx < 2").drop("matched_form").collect()))
    fields = [c for c in E.witnesses(docs, terms).columns if c not in ("doc_id", "matched_form")]
    for size, rows in ((32 << 20, 100_000), (150, 7)):
        monkeypatch.setattr(scan, "LIST_BYTES", size)
        monkeypatch.setattr(scan, "ROWS", rows)
        kept = E.witness_lists(docs, terms, first=2)
        assert kept.count() == docs.count()
        flat = kept.select("doc_id", F.explode("found").alias("w")).select("doc_id", *[f"w.{c}" for c in fields])
        assert sorted(map(tuple, flat.collect())) == want


def test_verdicts_in_a_row_shuffle_no_witness(spark, docs, terms, tmp_path):
    """The same reasons as by the join, whatever was tampered with; the query's plan deals no rows by a key."""
    one = docs.where("doc_id <> 92 or text <> 'robot'")
    w = E.witnesses(one, terms).join(B.artifacts(one).select("doc_id", F.col("sha256").alias("artifact_sha256")), "doc_id")
    bad = F.col("byte_offset") % 4
    w = w.select("doc_id", "term", "idx", F.when(bad == 1, 10_000_000).when(F.col("idx") % 7 == 6, -1).otherwise(F.col("byte_start")).alias("byte_start"), "byte_len", F.when(bad == 2, "0").otherwise(F.col("window_sha256")).alias("window_sha256"), F.when(F.col("idx") % 5 == 4, "0").otherwise(F.col("artifact_sha256")).alias("artifact_sha256"), "matched_form")
    want = sorted(map(tuple, B.verdicts(w, one).collect()))
    rows = one.join(w.groupBy("doc_id").agg(F.collect_list(F.struct(*w.columns[1:])).alias("found")), "doc_id")
    for size in (64, 4096):
        assert sorted(map(tuple, B.listed_verdicts(rows, size=size).collect())) == want
    assert {r[-1] for r in want} == {"ok", "artifact_drift", "short_read", "window_mismatch"}

    from textloom.plans.every import QUERIES

    one.write.parquet(f"{tmp_path}/documents.parquet")
    terms.withColumnRenamed("term", "text").write.parquet(f"{tmp_path}/benchmark.parquet")
    plan = QUERIES["m06c_stored_witnesses"](spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "hashpartitioning" not in plan


def test_a_window_is_hashed_once_for_all_of_its_places(monkeypatch):
    """Texts shorter than a window, and places near a text's begin, share theirs; texts that stand side by side share none."""
    made = []
    monkeypatch.setattr(scan, "sha256", lambda data: made.append(data) or hashlib.sha256(data))
    texts = ["robot ß robots " * 4, "čas 日本 an " * 60, "none", "日本"]
    for terms in (["robot", "robots", "čas", "an", "日本"], ["robot", "robots", "čas", "an", "日本", "an an"]):
        made.clear()
        trie = scan.Trie((t, t) for t in terms)
        known, found = scan.Known(trie), scan.Found(trie.terms)
        for i, t in enumerate(texts):
            found.walk(i, t, known, False, True, False)
        row, part = found.rows(scan.witness, 0)
        columns = dict(zip(scan.SHOWN, (x.to_pylist() for x in part(slice(None))), strict=True))
        windows = []
        for i, at, start, size, digest in zip(row.tolist(), *(columns[c] for c in ("byte_offset", "byte_start", "byte_len", "window_sha256")), strict=True):
            data = texts[i].encode()
            a = edge(data, max(0, at - 80), -1)
            b = edge(data, min(len(data), a + 200), 1)
            assert (start, size, digest) == (a, b - a, hashlib.sha256(data[a:b]).hexdigest())
            windows.append((i, a, b))
        assert len(made) == len(set(windows)) < len({*zip(row.tolist(), columns["byte_offset"], strict=True)}) < len(windows)


def test_witnesses_leave_the_scan_as_they_are_returned(spark, terms, tmp_path):
    """Nothing stands between the scan and who stores its rows: no shuffle, no sort, and no row is copied for the columns' order."""
    spark.createDataFrame(made_texts(), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    plan = E.witnesses(spark.read.parquet(f"{tmp_path}/documents.parquet"), terms)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.startswith("MapInArrow") and "Sort" not in plan and "Aggregate" not in plan
