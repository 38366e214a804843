"""The stored index against SQLite's own, through additions, deletions and replacements."""

import random
import sqlite3

import pytest
from pyspark.sql import functions as F

from textloom.operators import fulltext as FT
from textloom.sources.published import Published

MATCHES = ["red", '"red fox"', "gre*", "red fox", '"a red fox"', 'fox "old tree" the', "čas", "cas", "t*", "none", '"fox red"', "the th* tree", "9*"]
WORDS = "red green fox old tree the a greens Čas 99 x9 Straße théâtre".split()


def texts(seed, n):
    rng = random.Random(seed)
    return [" ".join(rng.choice(WORDS) + rng.choice(["", "", ",", " -"]) for _ in range(rng.randint(0, 14))) for _ in range(n)]


class Plain:
    def __init__(self):
        self.db = sqlite3.connect(":memory:")
        self.db.execute("create virtual table t using fts5(title, body, tokenize = 'unicode61')")

    def put(self, rows):
        self.db.executemany("delete from t where rowid = ?", [(k,) for k, _, _ in rows])
        self.db.executemany("insert into t(rowid, title, body) values (?, ?, ?)", rows)

    def drop(self, keys):
        self.db.executemany("delete from t where rowid = ?", [(k,) for k in keys])

    def search(self, match):
        return sorted(r[0] for r in self.db.execute("select rowid from t where t match ?", (match,)))


def test_index_through_its_life(spark, tmp_path):
    plain, index = Plain(), FT.FullText(Published(spark, f"file://{tmp_path}/i"), ["title", "body"], shards=8)
    rows = lambda keys, seed: list(zip(keys, texts(seed, len(keys)), texts(seed + 1, len(keys)), strict=True))
    df = lambda r: spark.createDataFrame(r, "k long, title string, body string")

    def same():
        for m in MATCHES:
            assert sorted(r.key for r in index.search(m).collect()) == plain.search(m), m

    first, more, other = rows(range(120), 1), rows(range(120, 160), 3), rows(range(30, 60), 5)
    index.add(df(first), "k")
    plain.put(first)
    same()
    index.add(df(more), "k")
    plain.put(more)
    index.delete(spark.createDataFrame([(k,) for k in range(0, 160, 7)], "key long"))
    plain.drop(range(0, 160, 7))
    same()
    before = {m: plain.search(m) for m in MATCHES[:3]}
    index.replace(df(other), "k")
    plain.put(other)
    same()
    index.compact()
    same()
    assert all(sorted(r.key for r in index.search(m, 3).collect()) == before[m] for m in before)
    index.add(df([(0, "red fox", None)]), "k")  # a key that was deleted comes back
    plain.put([(0, "red fox", None)])
    same()


def test_a_query_reads_its_own_shards(spark, tmp_path):
    index = FT.FullText(Published(spark, f"file://{tmp_path}/i"), ["body"], shards=32)
    index.add(spark.createDataFrame([(i, t) for i, t in enumerate(texts(8, 60))], "k long, body string"), "k")
    plan = index.search("fox gre*")._jdf.queryExecution().toString()
    assert "PartitionFilters: [" in plan and "shard" in plan.split("PartitionFilters: [")[1].split("]")[0]
    every = index.store.read("postings")
    asked = [r[0] for r in spark.createDataFrame([("fox",), ("gre",)], "w string").select(FT.shard_of(F.col("w"), 32)).collect()]
    files = lambda df: {r[0] for r in df.select(F.input_file_name()).distinct().collect()}
    assert 0 < len(files(every.where(F.col("shard").isin(*asked)))) < len(files(every))


def test_empty_queries_and_tables(spark):
    none = spark.createDataFrame([], "k long, body string")
    assert FT.found(FT.postings(none, "k", ["body"]), "red").count() == 0
    some = FT.postings(spark.createDataFrame([(1, "red"), (2, None)], "k long, body string"), "k", ["body"])
    assert FT.found(some, "  ").count() == 0 and [r.key for r in FT.found(some, "red").collect()] == [1]


@pytest.mark.parametrize("match,want", [('a "b c" d*', [(["a"], False), (["b", "c"], False), (["d"], True)]), ("", []), ("X", [(["x"], False)])])
def test_terms_of_a_query(match, want):
    assert FT.wanted(match) == want
