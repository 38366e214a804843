"""Publishing: one of two wins, the dead leave nothing, cycles go in whole or not at all."""

from concurrent.futures import ThreadPoolExecutor
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from textloom.operators import research as X
from textloom.operators import zones as Z
from textloom.sources.published import Conflict, Published


@pytest.fixture
def store(spark, tmp_path):
    return Published(spark, f"file://{tmp_path}/store")


def ids(df):
    return sorted(r.id for r in df.collect())


def test_versions_stay_as_they_were(spark, store):
    assert store.version() == 0 and store.tables() == []
    one = store.publish(0, replace={"t": spark.range(3)}, note="first")
    two = store.publish(1, append={"t": spark.range(3, 5)}, replace={"u": spark.range(1)})
    assert (one, two) == (1, 2) and ids(store.read("t", 1)) == [0, 1, 2] and ids(store.read("t")) == [0, 1, 2, 3, 4]
    assert store.tables(1) == ["t"] and store.tables() == ["t", "u"] and store.manifest(1)["note"] == "first"
    assert Published(spark, store.root).version() == 2


def test_a_late_publisher_is_told(spark, store):
    other = Published(spark, store.root)
    store.publish(0, replace={"t": spark.range(1)})
    with pytest.raises(Conflict):
        other.publish(0, replace={"t": spark.range(2)})
    assert ids(store.read("t")) == [0]


def test_of_many_at_once_exactly_one_wins(spark, store):
    store.publish(0, replace={"t": spark.range(1)})
    rivals = [Published(spark, store.root) for _ in range(6)]
    for r in rivals:
        r.version()

    def run(r):
        tables = r.manifest(1)["tables"] | {"t": [r.stage(spark.range(9))]}
        try:
            r._commit(2, f'{{"version": 2, "note": "{rivals.index(r)}", "tables": {str(tables).replace(chr(39), chr(34))}}}')
            return True
        except Conflict:
            return False

    with ThreadPoolExecutor(6) as pool:
        assert sum(pool.map(run, rivals)) == 1
    assert store.version() == 2 and len(store.unnamed()) == 5


def test_losers_try_again(spark, store):
    store.publish(0, replace={"t": spark.createDataFrame([(1, "a", 0)], "id long, name string, n long")})
    rivals = [Published(spark, store.root) for _ in range(4)]
    add = lambda i: rivals[i].upsert("t", spark.createDataFrame([(1, f"x{i}", 7), (10 + i, "new", i)], "id long, name string, n long"), ["id"], ["name"])
    with ThreadPoolExecutor(4) as pool:
        assert sorted(pool.map(add, range(4))) == [2, 3, 4, 5]
    rows = {r.id: r for r in store.read("t").collect()}
    assert sorted(rows) == [1, 10, 11, 12, 13] and rows[1].n == 0 and rows[1].name.startswith("x")


def test_a_publisher_that_dies_leaves_the_old_version(spark, store, monkeypatch):
    store.publish(0, replace={"t": spark.range(1)})
    dying = Published(spark, store.root)
    monkeypatch.setattr(dying, "_commit", lambda *a: (_ for _ in ()).throw(KeyboardInterrupt()))
    with pytest.raises(KeyboardInterrupt):
        dying.publish(1, replace={"t": spark.range(5)})
    fresh = Published(spark, store.root)
    assert fresh.version() == 1 and ids(fresh.read("t")) == [0] and len(fresh.unnamed()) == 1
    assert not [p for p in Path(store.root.removeprefix("file://"), "versions").iterdir() if p.name.startswith(".") and not p.name.endswith(".crc")]


TEXT = "title page robot. " + "the engine stands here and a robot walks by the time machine, said the morlock. " * 6


@pytest.fixture
def library(spark, store):
    n = F.octet_length("text")
    rows = [(1, "a", "w1", 1920, TEXT, None), (2, "a", "w2", 1921, TEXT, None), (3, "b", "w3", 1922, TEXT, "analyzed"), (4, "b", "w4", 1923, None, None), (5, "b", "w5", 1924, "no such thing " * 30, None)]
    works = spark.createDataFrame(rows, "work_id long, author_slug string, slug string, year int, text string, research_status string").withColumn("zones", F.array(Z._zone("front_matter", F.lit(0), F.lit(18)), Z._zone("body", F.lit(18), n)))
    store.publish(0, replace={"works": works})
    said = spark.createDataFrame([(1, 0, "ok", ["'robot'", "morlock"]), (1, 1, "ok", ["engine"]), (2, 0, "ok", ["ab", "martian"]), (2, 1, "invalid_candidates", None), (2, 2, "ok", ["robot"]), (3, 0, "ok", ["morlock", "engine", "time machine"]), (3, 7, "ok", ["robot"]), (5, 0, "ok", [])], "work_id long, window int, status string, candidates array<string>")
    good, bad = "зорельотник", "zorelit"
    made = spark.createDataFrame([(1, "robot", bad), (1, "morlock", good), (1, "engine", good), (2, "robot", good), (3, "morlock", None), (3, "engine", good)], "work_id long, term string, proposed string").selectExpr("*", "'r' as root", "'суфіксальна модель' as model", "'від коренів слова' as note")
    return store, said, made


def test_a_cycle_is_committed_as_one_version(spark, library):
    store, said, made = library
    assert X.commit(store, said, made, "2026-01-01T00:00:00") == 2
    got = sorted((r.work_id, r.window, r.pos, r.status, r.term) for r in store.read("cycles").collect())
    assert got == [(1, 0, 0, "rolled_back", "robot"), (1, 0, 1, "committed", "morlock"), (2, 1, -1, "failed", None), (3, 0, 0, "rolled_back", "morlock"), (3, 0, 1, "committed", "engine")]
    assert sorted((r.work_id, r.register, r.term) for r in store.read("attestations").collect()) == [(1, "attested", "morlock"), (1, "proposed", "morlock"), (3, "attested", "engine"), (3, "proposed", "engine")]
    assert {r.work_id: r.research_status for r in store.read("works").collect()} == {1: "in_progress", 2: None, 3: "in_progress", 4: None, 5: None}
    out = X.outcomes(store.read("works"), store.read("cycles"))
    assert {r.work_id: r.outcome for r in out.collect()} == {1: "committed", 2: "error", 3: "committed", 4: "idle", 5: "idle"}
    for r in store.read("attestations").where("register = 'attested'").collect():
        assert r.byte_start >= 18 and r.cts_urn.endswith(f":{r.byte_start}+{r.byte_len}")
    # the next cycle goes on with what is not attested yet, and adds no known term again
    assert X.commit(store, said, made, "2026-01-02T00:00:00") == 3
    terms = [r.term for r in store.read("terms").collect()]
    assert sorted(terms) == ["engine", "morlock"] and store.read("attestations").where("work_id = 1 and term = 'engine'").count() == 2


def test_a_faster_publisher_makes_the_cycle_run_anew(spark, library, monkeypatch):
    store, said, made = library
    real, calls = store.stage, []

    def stage(df):
        calls.append(1)
        if len(calls) == 1:  # meanwhile another adds a witness of the term that would win
            Published(spark, store.root).publish(1, append={"attestations": spark.createDataFrame([(1, "Morlock", "attested")], "work_id long, term string, register string")})
        return real(df)

    monkeypatch.setattr(store, "stage", stage)
    assert X.commit(store, said, made, "x") == 3
    assert [(r.term, r.status) for r in store.read("cycles").where("work_id = 1").orderBy("window", "pos").collect()] == [("robot", "rolled_back"), ("engine", "committed")]


def test_a_cycle_that_breaks_leaves_nothing(spark, library, monkeypatch):
    store, said, made = library
    monkeypatch.setattr(store, "_commit", lambda *a: (_ for _ in ()).throw(OSError("disk")))
    with pytest.raises(OSError):
        X.commit(store, said, made, "x")
    fresh = Published(spark, store.root)
    assert fresh.version() == 1 and fresh.tables() == ["works"] and fresh.read("works").where("research_status = 'in_progress'").count() == 0
