"""SimHash near-dedup by multi-index hashing.

A fingerprint has two 32-bit halves.  Distance 4 or less means that the first halves differ in
at most 2 bits or the second in at most 1.  Each distinct fingerprint enumerates the ball of
radius 1 of its first half (two balls of radius 1 meet where halves differ in up to 2 bits) and
of its second half, and full distances are checked among those that meet.  A bucket streams by
in sorted order: up to BUCKET fingerprints are held; what a bucket holds beyond that takes the
exact way without pairs, by common midpoints: two words within 4 bits share a word within 2.

Copies collapse to one fingerprint before any of this, and a bucket gives a spanning forest,
not all its pairs, so groups of copies cost no more than their rows.  Null text is empty; texts
without words have fingerprint zero and are linked like others.  Rows with a null doc_id get a
fingerprint and the component of its documents.  Repeated rows share a component; a bit that half
of the shingles set is 0.  Texts of any length are read whole, hashes by blocks.  An empty table
gives no rows; columns but doc_id and text are never read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, cut, of_key, parts, texts

BUCKET = 2048
ONE = np.uint64(1)


def fingerprint(text: str, width: int = 4, seed: int = 42) -> int:
    data = text.encode("utf-8").lower().split()  # bytes: A-Z alone, ASCII white space alone
    if not data:
        return 0
    if len(data) <= width:
        hashes = np.array([xxhash.xxh64_intdigest(b" ".join(data), seed)], np.uint64)
        return int(hashes[0])
    joined = b" ".join(data)
    ends = np.cumsum(np.array([len(w) + 1 for w in data], np.int64))
    stop = (ends[width - 1 :] - 1).tolist()
    start = [0, *ends[:-width].tolist()]
    digest, total, n = xxhash.xxh64_intdigest, np.zeros(64, np.int64), len(stop)
    for k in range(0, n, 65536):
        h = np.array([digest(joined[i:j], seed) for i, j in zip(start[k : k + 65536], stop[k : k + 65536], strict=True)], dtype=">u8")
        total += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(total * 2 > n).tobytes(), "big")


def fingerprints(docs: DataFrame, width: int = 4) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            fp = np.array([fingerprint(t, width) for t in b.text], np.uint64).view(np.int64)
            yield pd.DataFrame({"doc_id": b.doc_id.astype("Int64").to_numpy(), "fp": fp})

    return texts(docs).mapInPandas(run, "doc_id long, fp long")


def _keys(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    low = np.uint64(0xFFFFFFFF)
    flips = np.r_[np.uint64(0), ONE << np.arange(32, dtype=np.uint64)]
    for b in batches:
        fp = b.fp.to_numpy(np.int64).view(np.uint64)
        for side, half in ((0, fp >> np.uint64(32)), (1, fp & low)):
            ball = half[:, None] ^ flips[None, :]
            key = (ball | np.uint64(side << 32)).ravel().view(np.int64)
            yield pd.DataFrame({"key": key, "fp": np.repeat(b.fp.to_numpy(np.int64), 33)})


def _forest(fps: np.ndarray, max_bits: int) -> list[tuple[int, int]]:
    """Edges of a spanning forest of the links among distinct fingerprints."""
    x, out = fps.view(np.uint64), []
    left = np.arange(len(x))
    while len(left):
        reach, left = left[:1], left[1:]
        while len(reach) and len(left):
            u, reach = reach[0], reach[1:]
            near = np.bitwise_count(x[left] ^ x[u]) <= max_bits
            out += [(int(fps[u]), int(fps[v])) for v in left[near]]
            reach, left = np.r_[reach, left[near]], left[~near]
    return out


def _links(batches: Iterator[pd.DataFrame], max_bits: int) -> Iterator[pd.DataFrame]:
    """Sorted by key: edges (a, b); rows with b null name fingerprints of over-full buckets."""
    rest, over = None, False  # the bucket that may go on in the next batch, at most BUCKET of its rows, and whether it has passed that

    def bucket(fps: np.ndarray) -> list[tuple]:
        return [(x, None) for x in fps.tolist()] if over or len(fps) > BUCKET else _forest(np.unique(fps), max_bits) if len(fps) > 1 else []

    for b in batches:
        key, fp = b.key.to_numpy(np.int64), b.fp.to_numpy(np.int64)
        out: list[tuple] = []
        if rest is not None and key[0] == rest[0]:
            key, fp = np.r_[np.full(len(rest[1]), rest[0]), key], np.r_[rest[1], fp]
        elif rest is not None:
            out += bucket(rest[1])
            over = False
        cuts = np.r_[0, np.flatnonzero(key[1:] != key[:-1]) + 1, len(key)]
        for i in np.flatnonzero(np.diff(cuts[:-1]) > 1 - int(over)).tolist():  # closed buckets of two or more
            out += bucket(fp[cuts[i] : cuts[i + 1]])
            over = False
        if len(cuts) > 2:
            over = False
        last = fp[cuts[-2] :]
        if over or len(last) > BUCKET:
            out += [(x, None) for x in last.tolist()]
            over, last = True, last[:0]
        rest = (key[-1], last)
        yield _edges(out)
    if rest is not None:
        yield _edges(bucket(rest[1]))


def _edges(rows: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame({"a": pd.array([r[0] for r in rows], dtype="Int64"), "b": pd.array([r[1] for r in rows], dtype="Int64")})


def _midpoints(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    one = ONE << np.arange(64, dtype=np.uint64)
    i, j = np.triu_indices(64, 1)
    ball = np.r_[np.uint64(0), one, one[i] | one[j]]
    for b in batches:
        fps = b.fp.to_numpy(np.int64)
        for k in range(0, len(fps), 64):
            f = fps[k : k + 64]
            yield pd.DataFrame({"mid": (f.view(np.uint64)[:, None] ^ ball[None, :]).ravel().view(np.int64), "fp": np.repeat(f, len(ball))})


def near_groups(docs: DataFrame, width: int = 4, max_bits: int = 4) -> DataFrame:
    """doc_id, fp (long), component_id: the smallest doc_id reachable by links."""
    if max_bits != 4:
        raise ValueError("the index is laid out for 4 differing bits")
    spark = docs.sparkSession
    every = cut(fingerprints(docs, width))
    alone = every.groupBy("fp").agg(F.min("doc_id").alias("low"))
    keyed = alone.select("fp").repartition(parts(spark)).mapInPandas(_keys, "key long, fp long")
    found = cut(keyed.repartition(parts(spark), "key").sortWithinPartitions("key", "fp").mapInPandas(lambda it: _links(it, max_bits), "a long, b long"))
    edges = found.where("b is not null")
    over = found.where("b is null").select(F.col("a").alias("fp")).distinct()
    if over.limit(1).count():
        mids = over.mapInPandas(_midpoints, "mid long, fp long")
        lows = mids.groupBy("mid").agg(F.min("fp").alias("b"), F.max("fp").alias("top")).where("b < top").drop("top")
        edges = edges.union(of_key(mids, lows, "mid", "inner").where("fp <> b").select(F.col("fp").alias("a"), "b").distinct())
    roots = components(edges)
    named = alone.join(roots, alone.fp == roots.node, "left").select("fp", "low", F.coalesce("root", "fp").alias("root"))
    best = named.groupBy("root").agg(F.min("low").alias("component_id"))
    final = of_key(named, best, "root", "inner").select("fp", "component_id")
    return of_key(every, final, "fp", "inner").select("doc_id", "fp", "component_id")
