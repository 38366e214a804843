"""The engine's own queries against DuckDB, and small fixtures."""

import duckdb
import pytest
from textloom.operators import evidence as E
from textloom.plans.every import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_sql(spark, con, name):
    df, sql = QUERIES[name](spark, SF), con.execute(ORACLES[name])
    theirs = [d[0] for d in sql.description]
    cols = sorted(df.columns)
    assert cols == sorted(theirs)
    plain = lambda rows, names: sorted((tuple(str(r[names.index(c)]) for c in cols) for r in rows))
    got, want = plain(df.collect(), df.columns), plain(sql.fetchall(), theirs)
    assert got == want and got


def test_kappa_fixture(spark):
    r = E.kappa(spark.createDataFrame([(0, 0), (1, 2), (2, 1), (3, 3)], "a int, b int")).first()
    assert (round(r.kappa, 9), r.exact, r.within_one) == (0.6, 0.5, 1)
    assert E.kappa(spark.createDataFrame([(3, 3)] * 4, "a int, b int")).first().kappa is None
    assert E.kappa(spark.createDataFrame([], "a int, b int")).first().n == 0


def test_coverage_of_two_spans_with_a_gap(spark):
    spans = spark.createDataFrame([("x", 0, 3), ("x", 6, 9), ("x", 7, 8)], "k string, start long, end long")
    assert E.covered(spans, "k").first().covered == 6


def test_occurrences_allow_short_endings(spark):
    docs = spark.createDataFrame([(1, "Morlock, morlocks and MORLOCK; morlockship")], "doc_id long, text string")
    assert E.occurrences(docs, spark.createDataFrame([("morlock",)], "term string")).count() == 3
