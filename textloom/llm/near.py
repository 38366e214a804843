"""Groups of rows whose sets of WIDTH-word shingles have Jaccard similarity SIMILAR or more.

Distinct shingle sets get a 128-bit SimHash: two 64-bit words, each of four 16-bit segments.
Each segment enumerates its ball of radius 1, so sets meet where one segment differs in at most
2 bits, and are near where all 128 bits differ in at most MAX_BITS.  At similarity 0.8 a bit
differs with probability 0.15: all eight segments miss with probability 0.002.  Every pair that
counts is verified on the sets themselves.

Sets that are near any other keep one partner, the nearest leader of their buckets within LEAD_BITS,
and are verified with it: large groups of near copies become components by as many pairs as they have sets.
Near sets then get a sketch, 2 bits of each of FUNCTIONS minima, and what meets across components in one of
its segments is verified pair by pair where at most MAX_OTHER of the minima differ.  At similarity
0.8 a minimum's bits differ with probability 0.15; MAX_OTHER is four deviations above the mean, and all KEYED
segments differ with probability 0.0005.  A pair is named by the first segment that it shares alone.

Copies of a set collapse before any of this.  Null text is empty; texts without words are one set.  Rows are judged by
`row`, so a null doc_id is carried along and repeated rows fall into one group; of equal candidates the smallest row leads.
Texts of any length are read whole; an empty table gives no rows; columns but row, doc_id and text are never read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, cut, hold, parts

WIDTH, MAX_BITS = 5, 36  # 36 of 128 bits: four deviations above the mean at similarity 0.8
SEGMENTS, BITS = 8, 16
LEAD_BITS = 24  # one deviation above the mean at similarity 0.8: which leaders are tried first
FUNCTIONS, KEYED, MAX_OTHER = 512, 24, 109
_DRAWN = np.random.Generator(np.random.PCG64(11)).integers(0, 2**64, (2, FUNCTIONS, 1), np.uint64)
_FLIP, _TIMES = _DRAWN[0], _DRAWN[1] | np.uint64(1)


def shingles(text: str, width: int = WIDTH) -> np.ndarray:
    """Sorted distinct hashes; texts with fewer words are one shingle."""
    data = text.encode("utf-8").lower().split()
    if not data:
        return np.zeros(0, np.uint64)
    joined, digest = b" ".join(data), xxhash.xxh64_intdigest
    if len(data) <= width:
        return np.array([digest(joined, 42)], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, data), np.int64, len(data)) + 1)
    start, stop = [0, *ends[:-width].tolist()], (ends[width - 1 :] - 1).tolist()
    return np.unique(np.array([digest(joined[i:j], 42) for i, j in zip(start, stop, strict=True)], np.uint64))


def _majority(h: np.ndarray) -> int:
    total = np.zeros(64, np.int64)
    for k in range(0, len(h), 65536):
        total += np.unpackbits(h[k : k + 65536].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(total * 2 > len(h)).tobytes(), "big")


def wide(h: np.ndarray) -> tuple[int, int]:
    """Two SimHash words of one set: of its hashes, and of the hashes mixed again."""
    with np.errstate(over="ignore"):
        m = (h ^ (h >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
        m = (m ^ (m >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        m ^= m >> np.uint64(32)
    return _majority(h), _majority(m)


def _prints(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    hold("near")
    for b in batches:
        sets = [shingles(t) for t in b.text]
        words = np.array([wide(h) for h in sets], np.uint64).reshape(-1, 2).view(np.int64)
        same = np.array([xxhash.xxh64_intdigest(h.tobytes()) for h in sets], np.uint64).view(np.int64)
        yield pd.DataFrame({"row": b.row, "doc_id": b.doc_id.astype("Int64").to_numpy(), "same": same, "fa": words[:, 0], "fb": words[:, 1]})


def sketch(h: np.ndarray) -> bytes:
    """2 bits of the smallest value that each function gives to the hashes of a set."""
    least = np.full(FUNCTIONS, 2**64 - 1, np.uint64)
    with np.errstate(over="ignore"):
        for k in range(0, len(h), 256):
            least = np.minimum(least, ((h[None, k : k + 256] ^ _FLIP) * _TIMES).min(axis=1))
        two = ((least * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(62)).astype(np.uint8).reshape(-1, 4)
    return (two << np.array([0, 2, 4, 6], np.uint8)).sum(axis=1, dtype=np.uint8).tobytes()


def _others(one: np.ndarray, many: np.ndarray) -> np.ndarray:
    """How many of the functions' bits differ."""
    x = one ^ many
    return np.bitwise_count((x | (x >> np.uint64(1))) & np.uint64(0x5555555555555555)).sum(axis=1, dtype=np.int64)


def _sets(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    hold("near")
    for b in batches:
        sets = [shingles(t) for t in b.text]
        yield pd.DataFrame({"id": b.row, "held": [h.view(np.int64) for h in sets], "sketch": [sketch(h) for h in sets]})


def _keys(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    flips = np.r_[np.uint64(0), np.uint64(1) << np.arange(BITS, dtype=np.uint64)]
    each = SEGMENTS * len(flips)
    for big in batches:
        for k in range(0, len(big), 1000):
            b = big.iloc[k : k + 1000]
            key = np.empty((len(b), SEGMENTS, len(flips)), np.int64)
            for s in range(SEGMENTS):
                word = b[("fa", "fb")[s // 4]].to_numpy(np.int64).view(np.uint64)
                part = (word >> np.uint64(BITS * (s % 4))) & np.uint64(0xFFFF)
                key[:, s] = (part[:, None] ^ flips[None, :]) | np.uint64(s << BITS)
            yield pd.DataFrame({"key": key.ravel(), **{c: np.repeat(b[c].to_numpy(np.int64), each) for c in b.columns}})


def _sketch_keys(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for big in batches:
        for k in range(0, len(big), 500):
            b = big.iloc[k : k + 500]
            parts_of = np.frombuffer(b"".join(b.sketch), np.uint16).reshape(len(b), -1)[:, :KEYED]
            key = parts_of.astype(np.int64) | (np.arange(KEYED, dtype=np.int64) << 16)
            yield pd.DataFrame({"key": key.ravel(), **{c: np.repeat(b[c].to_numpy(), KEYED) for c in ("id", "root", "sketch")}})


def _bits(fps: np.ndarray, i: int) -> np.ndarray:
    return np.bitwise_count(fps ^ fps[i]).sum(axis=1, dtype=np.int64)


def _leaders(key: int, ids: np.ndarray, fps: np.ndarray, roots: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sets that are near others, each with the nearest leader within LEAD_BITS, or else with itself at no distance that counts."""
    best, lead, near, free = np.full(len(ids), 129), ids.copy(), np.zeros(len(ids), bool), np.ones(len(ids), bool)
    for i in range(len(ids)):
        if not free[i]:
            continue
        bits = _bits(fps, i)
        bits[i] = 999
        near |= bits <= MAX_BITS
        near[i] |= bits.min() <= MAX_BITS
        close = bits <= LEAD_BITS
        if not (close & free).any() and close.any():  # near followers of other leaders alone: with the nearest of those
            j = int(bits.argmin())
            best[i], lead[i] = bits[j], ids[j]
        close &= bits < best
        close[: i + 1] = False
        best[close], lead[close] = bits[close], ids[i]
        free[bits <= LEAD_BITS] = False
    return ids[near], lead[near], best[near]


def _across(key: int, ids: np.ndarray, fps: np.ndarray, roots: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs of different components whose sketches are alike, and that share no segment before this."""
    order = np.argsort(roots, kind="stable")
    ids, fps, roots = ids[order], fps[order], roots[order]
    segments, ends = fps.view(np.uint16)[:, :KEYED], np.searchsorted(roots, roots, side="right")
    a, b, far = [ids[:0]], [ids[:0]], [ids[:0]]
    for i in range(len(ids)):
        others = _others(fps[i], fps[ends[i] :])
        got = np.flatnonzero(others <= MAX_OTHER)
        got = got[(segments[ends[i] + got] == segments[i]).argmax(axis=1) == key >> 16]
        a.append(np.full(len(got), ids[i]))
        b.append(ids[ends[i] + got])
        far.append(others[got])
    return np.concatenate(a), np.concatenate(b), np.concatenate(far)


def _with_near(keys: np.ndarray, fps: np.ndarray, cuts: np.ndarray, most: int = 64) -> np.ndarray:
    """Which of the buckets of a frame may hold a near pair: rows are compared with those up to `most` places on, all buckets at once."""
    out = np.diff(cuts) > most
    for k in range(1, most):
        same = np.flatnonzero(keys[k:] == keys[:-k])
        if not len(same):
            break
        near = same[np.bitwise_count(fps[same + k] ^ fps[same]).sum(axis=1) <= MAX_BITS]
        out[np.searchsorted(cuts, near, side="right") - 1] = True
    return out


def _meet(batches: Iterator[pd.DataFrame], name) -> Iterator[pd.DataFrame]:
    """Rows sorted by key; a bucket may go on in the next batches, and its pieces wait for its end."""
    key, held = None, []

    def close() -> list:
        return [name(key, *(np.concatenate(x) for x in zip(*held, strict=True)))] if sum(len(x[0]) for x in held) > 1 else []

    def frame(out: list) -> Iterator[pd.DataFrame]:
        if out:
            named = pd.DataFrame(dict(zip(("a", "b", "far"), map(np.concatenate, zip(*out, strict=True)), strict=True)))
            yield named.sort_values(["a", "far", "b"]).drop_duplicates("a") if name is _leaders else named

    for b in batches:
        keys, ids = (b[c].to_numpy(np.int64) for c in ("key", "id"))
        cuts, out = np.r_[0, np.flatnonzero(keys[1:] != keys[:-1]) + 1, len(b)], []
        if name is _leaders:
            roots, fps = ids, b[["fa", "fb"]].to_numpy(np.int64).view(np.uint64)
            some = _with_near(keys, fps, cuts)
        else:
            roots, fps = b.root.to_numpy(np.int64), np.frombuffer(b"".join(b.sketch), np.uint64).reshape(len(b), -1)
            some = np.diff(cuts) > 1
        some[[0, -1]] = True  # these may go on in other frames
        for n in np.flatnonzero(some).tolist():
            i, j = int(cuts[n]), int(cuts[n + 1])
            if keys[i] != key:
                out += close()
                key, held = int(keys[i]), []
            if j < len(b) and not held:  # a whole bucket
                if j - i > 1:
                    out.append(name(key, ids[i:j], fps[i:j], roots[i:j]))
            else:
                held.append((ids[i:j], fps[i:j], roots[i:j]))
        yield from frame(out)
    yield from frame(close())


def _met(keyed: DataFrame, name) -> DataFrame:
    met = keyed.repartition(parts(keyed.sparkSession), "key").sortWithinPartitions("key", "id")
    return met.mapInPandas(lambda it: _meet(it, name), "a long, b long, far long")


def similar_groups(rows: DataFrame) -> DataFrame:
    """row, doc_id, root of rows(row long, doc_id, text); row must be unique, and stable when read again."""
    base = rows.select("row", F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    every = cut(base.mapInPandas(_prints, "row long, doc_id long, same long, fa long, fb long"))
    sets = cut(every.groupBy("same").agg(F.min("row").alias("id"), F.first("fa").alias("fa"), F.first("fb").alias("fb")))
    met = _met(sets.select("id", "fa", "fb").mapInPandas(_keys, "key long, id long, fa long, fb long"), _leaders)
    near = cut(met.groupBy("a").agg(F.min(F.struct("far", "b")).alias("best")).select(F.col("a").alias("id"), "best.far", "best.b"))
    text = base.join(near, base.row == near.id, "left_semi").select("row", "text")
    held = cut(text.mapInPandas(_sets, "id long, held array<long>, sketch binary"))

    def verified(pairs):
        x, y = (held.select(F.col("id").alias(c), F.col("held").alias(f"h{c}")) for c in "ab")
        both = pairs.select("a", "b").join(x, "a").join(y, "b").withColumn("n", F.size(F.array_intersect("ha", "hb")))
        return both.where(F.col("n") * 9 >= (F.size("ha") + F.size("hb")) * 4).select("a", "b")  # n / union >= 0.8

    sure = cut(verified(near.where("far <= 128").select(F.col("id").alias("a"), "b")))
    roots = components(sure)
    known = held.select("id", "sketch").join(roots, held.id == roots.node, "left").select("id", F.coalesce("root", "id").alias("root"), "sketch")
    more = verified(_met(known.mapInPandas(_sketch_keys, "key long, id long, root long, sketch binary"), _across))
    roots = components(sure.union(more))
    named = sets.join(roots, sets.id == roots.node, "left").select("same", F.coalesce("root", "id").alias("root"))
    return every.join(named, "same").select("row", "doc_id", "root")
