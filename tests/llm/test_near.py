"""Groups by shingle similarity against all pairs of sets."""

import random

import corpus_pipeline
import numpy as np
import pytest
from textloom.llm import near


def grams(text):
    w = (text or "").lower().split()
    return {" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def groups(data):
    """All pairs: row numbers by component."""
    sets, root = [grams(t) for _, t in data], list(range(len(data)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(data)):
        for j in range(i):
            both, every = len(sets[i] & sets[j]), len(sets[i] | sets[j])
            if both * 10 >= every * 8 and find(i) != find(j):
                root[max(find(i), find(j))] = min(find(i), find(j))
    return [find(i) for i in range(len(data))]


def near_copies(seed):
    """Texts whose copies have whole passages changed, about the threshold on both sides, and one large family."""
    rng = random.Random(seed)
    word = lambda: f"w{rng.randint(0, 5000)}"
    data = [(None, "null id row of some length here"), (None, "null id row of some length here"), (900, None), (901, ""), (902, "one"), (902, "one"), (903, "two words")]
    for d in range(60):
        base = [word() for _ in range(rng.randint(40, 300))]
        data.append((d * 3, " ".join(base)))
        for k in (1, 2):
            n = int(len(base) * rng.uniform(0.02, 0.14))
            i = rng.randint(0, len(base) - n)
            data.append((d * 3 + k, " ".join(base[:i] + [word() for _ in range(n)] + base[i + n :])))
    base = [word() for _ in range(200)]
    for d in range(120):
        i = rng.randint(0, 190)
        data.append((1000 + d, " ".join(base[:i] + [word()] + base[i + rng.randint(1, 9) :])))
    return data


@pytest.mark.parametrize("seed", [1, 2])
def test_near_groups_equal_all_pairs(spark, seed):
    data = near_copies(seed)
    df = spark.createDataFrame([(i, d, t) for i, (d, t) in enumerate(data)], "row long, doc_id long, text string")
    got = {r.row: r.root for r in near.similar_groups(df).collect()}
    want = groups(data)
    parts = lambda named: {frozenset(i for i in range(len(data)) if named[i] == r) for r in set(named)}
    assert parts([got[i] for i in range(len(data))]) == parts(want)


def test_stage_keeps_one_of_pairs_at_0_8(spark):
    data = near_copies(3)
    df = spark.createDataFrame([(d, t, "en", "s", len(t or "")) for d, t in data], "doc_id long, text string, lang string, source string, n_chars long")
    got = sorted(((r.doc_id, r.text) for r in corpus_pipeline.keep_one_of_each_group(spark, df, "").collect()), key=str)
    best = {}
    for i, r in enumerate(groups(data)):
        best[r] = min(best.get(r, i), i, key=lambda j: (data[j][0] is None, data[j][0], j))
    assert got == sorted((data[i] for i in best.values()), key=str)


def test_sketches_of_similar_sets_meet():
    """Sets at similarity 0.8 share a keyed segment and stay within MAX_OTHER; unlike ones do not."""
    rng = np.random.default_rng(5)
    missed = 0
    for _ in range(400):
        h = rng.integers(0, 2**64, 100, np.uint64)
        a, b, c = (np.frombuffer(near.sketch(np.unique(x)), np.uint64) for x in (h[:90], h[10:], rng.integers(0, 2**64, 90, np.uint64)))
        meet = (a.view(np.uint16) == b.view(np.uint16))[: near.KEYED].any()
        missed += not (meet and near._others(a, b[None])[0] <= near.MAX_OTHER)
        assert near._others(a, c[None])[0] > near.MAX_OTHER
    assert missed <= 2
    assert near.sketch(np.zeros(0, np.uint64)) == near.sketch(np.zeros(0, np.uint64))
