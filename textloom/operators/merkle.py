"""Seals by a tree of hashes that executors make level by level; only its root reaches the driver.

A file's place in the tree is the hash of its path, so no task sees the files in order.  The lowest level groups files by
the first `depth` hexadecimal digits of that hash, each level above takes one digit away, and a node's hash covers the
keys and hashes of its children, sorted.  A group has 16 children at most, but for the lowest level's: there about
n / 16 ** depth, which `depth_for` keeps near 16.

A proof names what stands beside one file on every level.  Two trees differ in the branches whose hashes do, so
`differences` goes down these alone.  Paths are unique; a path or hash that is null is an error.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def depth_for(n: int) -> int:
    """Levels below the root for so many files."""
    d = 1
    while n > 16 ** (d + 1) and d < 12:
        d += 1
    return d


def leaf(uri: str, sha256: str) -> tuple[str, str]:
    return hashlib.sha256(uri.encode()).hexdigest(), hashlib.sha256(f"{uri}\n{sha256}".encode()).hexdigest()


def tree(files: DataFrame, depth: int) -> DataFrame:
    """level, key, hash of all nodes over files(uri, sha256): the root has level 0 and an empty key, files level depth + 1."""
    whole = lambda c: F.when(F.col(c).isNull(), F.raise_error(F.lit(f"no {c}"))).otherwise(F.col(c))
    now = files.select(F.sha2(whole("uri"), 256).alias("key"), F.sha2(F.concat_ws("\n", "uri", whole("sha256")), 256).alias("hash"))
    out = now.select(F.lit(depth + 1).alias("level"), "key", "hash")
    for d in range(depth, -1, -1):
        said = F.array_join(F.sort_array(F.collect_list(F.concat("key", F.lit(":"), "hash"))), "\n")
        now = now.groupBy(F.substring("key", 1, d).alias("up")).agg(F.sha2(said, 256).alias("hash")).select(F.col("up").alias("key"), "hash")
        out = out.unionByName(now.select(F.lit(d).alias("level"), "key", "hash"))
    return out


def root(nodes: DataFrame) -> str | None:
    """None for a tree without files."""
    row = nodes.where("level = 0").first()
    return row.hash if row else None


def proof(nodes: DataFrame, uri: str, depth: int) -> list[list[str]]:
    """For each level from the files up: `key:hash` of all children of the node above the file, itself included."""
    key = hashlib.sha256(uri.encode()).hexdigest()
    near = None
    for d in range(depth, -1, -1):
        here = nodes.where((F.col("level") == d + 1) & F.startswith("key", F.lit(key[:d])))
        near = here if near is None else near.unionByName(here)
    rows = near.collect()  # 16 nodes a level or about
    return [sorted(f"{r.key}:{r.hash}" for r in rows if r.level == d + 1) for d in range(depth, -1, -1)]


def proven(uri: str, sha256: str, path: list[list[str]], top: str) -> bool:
    """Whether a proof leads from a file to the root."""
    key, now = leaf(uri, sha256)
    for d, level in zip(range(len(path) - 1, -1, -1), path, strict=True):
        if f"{key}:{now}" not in level:
            return False
        key, now = key[:d], hashlib.sha256("\n".join(level).encode()).hexdigest()
    return now == top


def differences(ours: DataFrame, theirs: DataFrame, depth: int) -> DataFrame:
    """key, ours, theirs of the files that differ (null where one side lacks it), found by going down differing branches."""
    side = lambda nodes, d, name: nodes.where(F.col("level") == d).select("key", F.col("hash").alias(name))
    bad = None
    for d in range(depth + 2):
        a, b = side(ours, d, "ours"), side(theirs, d, "theirs")
        if bad is not None:
            up = bad.select(F.col("key").alias("up"))
            under = lambda x, up=up, d=d: x.join(up, F.substring("key", 1, d - 1 if d <= depth else depth) == F.col("up"), "left_semi")
            a, b = under(a), under(b)
        bad = a.join(b, "key", "full").where(~F.col("ours").eqNullSafe(F.col("theirs")))
    return bad
