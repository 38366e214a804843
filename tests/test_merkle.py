"""Trees of hashes: proofs, and what differs."""

import hashlib

import pytest
from pyspark.sql import functions as F

from textloom.operators import merkle as M


def sha(x):
    return hashlib.sha256(x.encode()).hexdigest()


FILES = [(f"a/{i}.txt", sha(str(i * i))) for i in range(300)]


def made(spark, files):
    return M.tree(spark.createDataFrame(files, "uri string, sha256 string").repartition(3), 2)


def plain_root(files, depth=2):
    nodes = dict(M.leaf(*f) for f in files)
    for d in range(depth, -1, -1):
        groups = {}
        for k, h in nodes.items():
            groups.setdefault(k[:d], []).append(f"{k}:{h}")
        nodes = {k: sha("\n".join(sorted(v))) for k, v in groups.items()}
    return nodes.get("")


def test_root_and_proofs(spark):
    t = made(spark, FILES).cache()
    top = M.root(t)
    assert top == plain_root(FILES) and t.where("level = 3").count() == 300
    path = M.proof(t, *FILES[7][:1], 2)
    assert len(path) == 3 and max(map(len, path)) <= 16 and M.proven(*FILES[7], path, top)
    assert not M.proven(FILES[7][0], sha("x"), path, top) and not M.proven("b", FILES[7][1], path, top) and not M.proven(*FILES[7], path, sha("top"))
    assert not M.proven(*FILES[7], [path[0][1:], *path[1:]], top)


@pytest.mark.parametrize("change", ["changed", "missing", "added", "moved", "none"])
def test_what_differs_is_named(spark, change):
    other = {"changed": [*FILES[:-1], (FILES[-1][0], sha("new"))], "missing": FILES[:-1], "added": [*FILES, ("b", sha("b"))], "moved": [*FILES[:-1], ("b", FILES[-1][1])], "none": FILES[::-1]}[change]
    a, b = made(spark, FILES), made(spark, other)
    found = {r.key: (r.ours, r.theirs) for r in M.differences(a, b, 2).collect()}
    ours, theirs = dict(M.leaf(*f) for f in FILES), dict(M.leaf(*f) for f in other)
    assert found == {k: (ours.get(k), theirs.get(k)) for k in ours.keys() | theirs.keys() if ours.get(k) != theirs.get(k)}
    assert (M.root(a) == M.root(b)) == (change == "none")


def test_no_files_nulls_and_depths(spark):
    assert M.root(made(spark, [])) is None and M.differences(made(spark, []), made(spark, FILES[:1]), 2).count() == 1
    with pytest.raises(Exception, match="no sha256"):
        made(spark, [("a", None)]).select(F.max("hash")).collect()
    assert [M.depth_for(n) for n in (0, 16, 256, 257, 5000, 10**6)] == [1, 1, 1, 2, 3, 4]
