"""Seeded orders of review packages against shuffles of plain lists."""

import hashlib
import random

from textloom.operators import review as V
from textloom.plans.every import QUERIES

SF = "/root/testdata/sf0.001"


def plain(ids):
    """Phase and both places of ids in the order given."""
    ordered = sorted(ids)
    random.Random(901).shuffle(ordered)
    first = set(ordered[:10])
    orders = []
    for seed in (902, 903):
        now = list(ids)
        random.Random(seed).shuffle(now)
        orders.append({x: i for i, x in enumerate(now)})
    return sorted((x, "calibration" if x in first else "development_review", orders[0][x], orders[1][x]) for x in ids)


def test_orders_of_packages(spark):
    rows = [("p", f"{i * 7 % 40:02d}", i) for i in range(40)] + [("q", f"{i}", 9 - i) for i in range(4)] + [("r", "x", 0)]
    got = V.drawn(spark.createDataFrame(rows, "package string, id string, ord int"), "package", "ord").collect()
    for package in "pqr":
        ids = [x[1] for x in sorted((r for r in rows if r[0] == package), key=lambda r: r[2])]
        assert sorted((r.id, r.phase, r.place_1, r.place_2) for r in got if r.package == package) == plain(ids)
    assert random.Random(901).sample(range(5), 5) != random.Random(902).sample(range(5), 5)


def test_query_on_the_tables(spark):
    parts = spark.read.parquet(f"{SF}/part.parquet").select("p_brand", "p_partkey").collect()
    got = QUERIES["w13b_drawn_orders"](spark, SF).collect()
    assert len(got) == len(parts)
    for brand in {r.p_brand for r in parts}:
        ids = [hashlib.sha256(f"review.v1:{k}".encode()).hexdigest()[:16] for k in sorted(r.p_partkey for r in parts if r.p_brand == brand)]
        assert sorted((r.id, r.phase, r.place_1, r.place_2) for r in got if r.package == brand) == plain(ids)
