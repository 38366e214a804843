"""Line dedup: sharded minimal perfect hashes over repeated line keys, probed by documents.

Lines repeated across documents are found by one map-side combined aggregation on 128 hash
bits.  Each shard of the repeated keys becomes one row: a levelled minimal perfect hash, a
fingerprint array, an array of counts and one of smallest holders.  Documents send the hashes of
lines to the shards, which answer from the arrays as rows stream by; the lines themselves stay
where they are, and a sieve of bounded size keeps lines that only one document holds from being
asked about.  Shards that many documents ask (frequent lines) are copied and asked by salt.  Only
texts that may lose a line are joined to the answers; the others are written as they are read.

The arrays are together as large as the repeated lines, which have no bound, so they are not
broadcast: hashes of lines that may be repeated go to them.  Fingerprints hold the 64 bits of a
key that the perfect hash does not use, since fewer could take one line for another.

Null or empty text is one empty line.  Rows with a null doc_id hold no line and lose none.
Repeated rows with one doc_id count as one document and all keep or lose a line together.  Ties
cannot be: the smallest doc_id keeps a line.  Texts of any length are read whole.  An empty table
gives an empty result; columns but doc_id, text and those to carry are never read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER, UPPER, WS, cut, hold, parts, sieve, texts

MIN_CHARS = 10
SHARD_KEYS = 50_000  # repeated keys of a shard on average: bounds a probe task's memory
MAX_SHARDS = 1 << 16  # bound of the broadcast table of salts
SALT_ROWS = 20_000  # questions that one copy of a shard answers


def _mix(h: np.ndarray, level: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (h ^ np.uint64((level * 0x9E3779B97F4A7C15) & (2**64 - 1))) * np.uint64(0xFF51AFD7ED558CCD)
        x ^= x >> np.uint64(33)
        x *= np.uint64(0xC4CEB9FE1A85EC53)
        return x ^ (x >> np.uint64(29))


class PerfectHash:
    """Levelled minimal perfect hash: a key sits at the first level where it is alone."""

    def __init__(self, sizes: list[int], bits: np.ndarray):
        self.sizes, self.bits = sizes, bits
        self.ranks = np.cumsum(bits, dtype=np.int64) - 1

    @classmethod
    def build(cls, keys: np.ndarray) -> PerfectHash:
        """keys: distinct uint64."""
        sizes, levels, left = [], [], keys
        while len(left):
            size = 2 * len(left) + 1
            at = (_mix(left, len(sizes)) % np.uint64(size)).astype(np.int64)
            alone = np.bincount(at, minlength=size) == 1
            sizes.append(size)
            levels.append(alone)
            left = left[~alone[at]]
        return cls(sizes, np.concatenate(levels) if levels else np.zeros(0, bool))

    def index(self, keys: np.ndarray) -> np.ndarray:
        """Place of each key; -1 for some of the keys not built in."""
        out, open_, base = np.full(len(keys), -1, np.int64), np.arange(len(keys)), 0
        for level, size in enumerate(self.sizes):
            at = base + (_mix(keys[open_], level) % np.uint64(size)).astype(np.int64)
            hit = self.bits[at]
            out[open_[hit]] = self.ranks[at[hit]]
            open_, base = open_[~hit], base + size
        return out

    def pack(self) -> bytes:
        return np.array([len(self.sizes), len(self.bits), *self.sizes], np.int64).tobytes() + np.packbits(self.bits).tobytes()

    @classmethod
    def unpack(cls, data: bytes) -> PerfectHash:
        n, bits = np.frombuffer(data, np.int64, 2)
        sizes = np.frombuffer(data, np.int64, n, 16).tolist()
        return cls(sizes, np.unpackbits(np.frombuffer(data, np.uint8, offset=16 + 8 * n), count=bits).astype(bool))


def _pack_shard(key, rows: pd.DataFrame) -> pd.DataFrame:
    """One row, or more when keys agree in h and differ in g: a perfect hash takes each h once."""
    nth = rows.groupby("h").cumcount()
    return pd.concat([_pack(key[0], rows[nth == k]) for k in range(int(nth.max()) + 1)])


def _pack(shard: int, rows: pd.DataFrame) -> pd.DataFrame:
    h = rows.h.to_numpy(np.int64).view(np.uint64)
    ph = PerfectHash.build(h)
    at = ph.index(h)

    def arr(col, kind):
        out = np.zeros(len(h), kind)
        out[at] = rows[col].to_numpy(kind)
        return out.tobytes()

    return pd.DataFrame([{"shard": shard, "hash": ph.pack(), "prints": arr("g", np.int64), "holders": arr("holder", np.int64), "counts": arr("n", np.int64)}])


def _probe(batches: Iterator[pd.DataFrame], least: int) -> Iterator[pd.DataFrame]:
    """Rows sorted by shard, salt, kind: a shard's arrays come before the questions to it."""
    held, now = [], None
    for b in batches:
        b = b.reset_index(drop=True)
        for i, j in _runs(b):
            shard = (b.shard[i], b.salt[i])
            if b.kind[i] == 0:
                held, now = held if now == shard else [], shard
                held.append((PerfectHash.unpack(b.hash[i]), *(np.frombuffer(b[c][i], np.int64) for c in ("prints", "holders", "counts"))))
                continue
            q = b.iloc[i:j]
            h, g, doc = (q[c].to_numpy(np.int64) for c in ("h", "g", "doc_id"))
            for index, prints, holders, counts in held if now == shard else ():
                at = index.index(h.view(np.uint64))
                ok = (at >= 0) & (prints[at] == g) & (counts[at] >= least) & (holders[at] != doc)
                yield q.loc[ok, ["doc_id", "h", "g"]]


def _runs(b: pd.DataFrame):
    k = b[["shard", "salt", "kind"]].to_numpy(np.int64)
    cuts = [0, *(np.flatnonzero((k[1:] != k[:-1]).any(axis=1)) + 1).tolist(), len(b)]
    for i, j in zip(cuts, cuts[1:], strict=False):
        if j > i and k[i][2] == 0:
            yield from ((x, x + 1) for x in range(i, j))
        elif j > i:
            yield i, j


def _strip(batches: Iterator[pd.DataFrame], low: int, carry: list[str]) -> Iterator[pd.DataFrame]:
    table = str.maketrans(UPPER, LOWER)
    for b in batches:
        out = []
        for text, drops in zip(b["_text"], b["drops"], strict=True):
            lines = text.split("\n")
            if drops is not None and len(drops):
                gone = {bytes(x) for x in drops}
                keys = (x.strip(WS).translate(table) for x in lines)
                kept = [x for x, k in zip(lines, keys, strict=True) if len(k) < low or hashlib.md5(k.encode()).digest() not in gone]
            else:
                kept = lines
            out.append((len(lines), len(lines) - len(kept), "\n".join(kept)))
        yield pd.DataFrame({"doc_id": b["_id"].astype("Int64").to_numpy(), "n_lines": [x[0] for x in out], "n_dropped": [x[1] for x in out], "kept": [x[2] for x in out], **{c: b[c].to_numpy() for c in carry}})


def dedup_lines(docs: DataFrame, min_chars: int = MIN_CHARS, carry: list[str] | None = None, least: int = 2) -> DataFrame:
    """doc_id, n_lines, n_dropped, kept, and columns to carry (as strings _c0, _c1, ...): the text without
    lines that a smaller doc_id holds too, where `least` documents or more hold them."""
    spark, base, carry = docs.sparkSession, texts(docs), carry or []
    keys = F.transform(F.split("text", "\n", -1), lambda x: F.translate(F.btrim(x, F.lit(WS)), UPPER, LOWER))
    md5s = F.array_distinct(F.transform(F.filter(keys, lambda k: F.length(k) >= min_chars), F.md5))
    num = lambda a: F.conv(F.substring("m", a, 16), 16, -10).cast("long")
    asked = base.where("doc_id is not null").select("doc_id", F.explode(md5s).alias("m")).select("doc_id", num(1).alias("h"), num(17).alias("g"))
    held = asked.groupBy("h", "g").agg(F.min("doc_id").alias("holder"), F.max("doc_id").alias("top"), F.count("*").alias("n"))
    shared = cut(held.where("holder < top").drop("top"))
    n = shared.count()
    known = sieve(shared, "h", n)
    shards = min(MAX_SHARDS, max(16, n // SHARD_KEYS + 1))
    shard = lambda: F.pmod(F.xxhash64("h"), F.lit(shards)).cast("int")
    built = cut(shared.withColumn("shard", shard()).groupBy("shard").applyInPandas(_pack_shard, "shard int, hash binary, prints binary, holders binary, counts binary"))
    # a hot line is asked once by every document that holds it, so the sum of counts bounds a shard's hits
    salts = shared.groupBy(shard().alias("shard")).agg((F.sum("n") / SALT_ROWS).cast("int").alias("more"))
    copies = F.broadcast(salts)  # at most MAX_SHARDS rows of two ints
    arrays = ("hash", "prints", "holders", "counts")
    one = built.join(copies, "shard").select("shard", F.explode(F.sequence(F.lit(0), F.col("more"))).alias("salt"), F.lit(0).alias("kind"), *[F.lit(0).cast("long").alias(c) for c in ("doc_id", "h", "g")], *arrays)

    def ask(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hold("lines")
        for b in batches:
            yield b[known.value.may_hold(b.h.to_numpy(np.int64))]

    some = asked.mapInPandas(ask, "doc_id long, h long, g long")
    two = some.withColumn("shard", shard()).join(copies, "shard").select("shard", F.pmod(F.xxhash64("doc_id"), F.col("more") + 1).cast("int").alias("salt"), F.lit(1).alias("kind"), "doc_id", "h", "g", *[F.lit(None).cast("binary").alias(c) for c in arrays])
    drops = one.union(two).repartition(parts(spark), "shard", "salt").sortWithinPartitions("shard", "salt", "kind").mapInPandas(lambda it: _probe(it, least), "doc_id long, h long, g long")
    hexed = lambda c: F.lpad(F.hex(c), 16, "0")
    per_doc = cut(drops.groupBy(F.col("doc_id").alias("_id")).agg(F.collect_set(F.unhex(F.concat(hexed("h"), hexed("g")))).alias("drops")))
    losing = sieve(per_doc, "_id", per_doc.count())
    names = [f"_c{k}" for k in range(len(carry))]
    whole = docs.select(F.col("doc_id").cast("long").alias("_id"), F.coalesce(F.col("text"), F.lit("")).alias("_text"), *[F.col(c).cast("string").alias(x) for c, x in zip(carry, names, strict=True)])
    kinds = "".join(f", {x} string" for x in names)
    made = f"doc_id long, n_lines long, n_dropped long, kept string{kinds}"

    def split(batches: Iterator[pd.DataFrame], may: bool) -> Iterator[pd.DataFrame]:
        hold("lines")
        for b in batches:
            ids = b["_id"].astype("Int64")
            b = b[(losing.value.may_hold(ids.fillna(0).to_numpy(np.int64)) & ids.notna().to_numpy(bool)) == may]
            if len(b) and may:
                yield pd.DataFrame({c: b[c].astype("Int64").to_numpy() if c == "_id" else pd.Series(b[c].tolist(), dtype=object) for c in b.columns})
            elif len(b):
                yield from _strip(iter([b.assign(drops=None)]), min_chars, names)

    touched = whole.mapInPandas(lambda it: split(it, True), f"_id long, _text string{kinds}").join(per_doc, "_id", "left")
    return touched.mapInPandas(lambda it: _strip(it, min_chars, names), made).union(whole.mapInPandas(lambda it: split(it, False), made))
