"""Shared pieces of the corpus operators: inputs, cut lineage, connected components."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

WS = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


_HELD: dict[str, Callable[[], object]] = {}


def hold(owner: str, drop: Callable[[], object] = lambda: None) -> None:
    """Called by tasks: a worker process, which later tasks use again, remembers things for one operator at a time.

    What another operator left goes, by its `drop`, and its memory back to the machine."""
    others = [k for k in _HELD if k != owner]
    for other in others:
        _HELD.pop(other)()
    if others:
        gc.unfreeze()
        gc.collect()
        try:
            ctypes.CDLL("libc.so.6").malloc_trim(0)
        except (OSError, AttributeError):  # another C library
            pass
    _HELD[owner] = drop


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts(docs: DataFrame) -> DataFrame:
    """doc_id and text alone (null text: empty), so clashing extra columns never matter."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))


def cut(df: DataFrame) -> DataFrame:
    """Checkpoint in the shared folder that the session names.

    A session without one gets a folder of its own only if it runs on this machine alone, as in tests."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        folder = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if folder is None and not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="textloom-"))
    return df.checkpoint()


def written(df: DataFrame) -> DataFrame:
    """A Parquet table of these rows in the shared folder of `cut`, read again: smaller than a checkpoint, read by column."""
    spark = df.sparkSession
    if spark.sparkContext.getCheckpointDir() is None:
        cut(spark.range(0))
    path = f"{spark.sparkContext.getCheckpointDir()}/table-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def of_key(rows: DataFrame, keys: DataFrame, key: str, how: str, *more: str) -> DataFrame:
    """Joins on keys that were just grouped, by another expression of them: both sides are then dealt
    anew, so that a hot key's rows can be split among tasks."""
    dealt = lambda df: df.withColumn("dealt", F.bitwise_not(key)).drop(key)
    return dealt(rows).join(dealt(keys), ["dealt", *more], how).withColumn(key, F.bitwise_not("dealt")).drop("dealt")


def parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def smallest(rows: DataFrame, keys: list[str], n: int) -> DataFrame:
    """The n rows of smallest hash of their keys, or a few less where hashes crowd: a sample that never grows with the table.

    Rows are counted, those below a threshold that about four times n pass are kept, and only these are sorted."""
    h = F.xxhash64(*keys)
    share = min(1.0, 4.0 * n / max(1, rows.count()))
    low = rows.where(h <= F.lit(int(-(2**63) + share * (2**64 - 1)) if share < 1 else 2**63 - 1))
    return low.orderBy(h, *keys, *[c for c in rows.columns if c not in keys]).limit(n)


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Connected components of edges(a long, b long): rows (node, root), root the smallest node.

    Alternating large-star and small-star: only minima and rewired edges are shuffled, the
    rounds grow with the logarithm of the longest chain, and no component meets in one task.
    """
    now = cut(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    state = None
    for _ in range(max_rounds):
        both = now.union(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = of_key(both, low, "a", "inner").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        down = large.groupBy("a").agg(F.min("b").alias("m"))
        small = of_key(large, down, "a", "inner").select(F.col("b").alias("a"), F.col("m").alias("b")).union(down.select("a", F.col("m").alias("b")))
        now = cut(small.where("a <> b").distinct())
        seen = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("s")).first()
        if state == seen:
            break
        state = seen
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return now.select(F.col("a").alias("node"), F.col("b").alias("root"))


SLICES, SIEVE_BITS = 64, 28  # slices that tasks fill; at most 2^28 bits, 32 MB, whatever the number of keys


class Sieve:
    """Bloom filter of 64-bit keys: says no only to keys that it lacks, and rarely yes to those."""

    def __init__(self, slices: dict[int, bytes], log: int):
        self.bits = np.zeros((SLICES, (1 << log) // 8), np.uint8)
        for i, b in slices.items():
            self.bits[i] |= np.frombuffer(b, np.uint8)
        self.log = log

    @staticmethod
    def places(keys: np.ndarray, log: int) -> tuple[np.ndarray, ...]:
        """Slice of each key, and two bits in it."""
        x = keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        x ^= x >> np.uint64(29)
        x *= np.uint64(0xBF58476D1CE4E5B9)
        low = np.uint64((1 << log) - 1)
        return tuple(v.astype(np.int64) for v in (x >> np.uint64(58), x & low, (x >> np.uint64(29)) & low))

    def may_hold(self, keys: np.ndarray) -> np.ndarray:
        i, a, b = self.places(keys, self.log)
        return ((self.bits[i, a >> 3] >> (a & 7)) & (self.bits[i, b >> 3] >> (b & 7)) & 1).astype(bool)


def sieve(df: DataFrame, key: str, n: int):
    """Broadcast sieve of the n keys of a column; tasks fill slices, the driver sees bits alone."""
    log = min(SIEVE_BITS, max(16, (16 * max(1, n) - 1).bit_length())) - 6

    def deal(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            k = b[key].to_numpy(np.int64)
            yield pd.DataFrame({"i": Sieve.places(k, log)[0], "k": k})

    def fill(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[int, np.ndarray] = {}
        for b in batches:
            s, x, y = Sieve.places(b.k.to_numpy(np.int64), log)
            for i in np.unique(s).tolist():
                bits = held.setdefault(i, np.zeros((1 << log) // 8, np.uint8))
                for at in (x[s == i], y[s == i]):
                    np.bitwise_or.at(bits, at >> 3, (1 << (at & 7)).astype(np.uint8))
        yield pd.DataFrame({"i": list(held), "bits": [v.tobytes() for v in held.values()]})

    dealt = df.select(key).mapInPandas(deal, "i long, k long").repartition(min(SLICES, parts(df.sparkSession)), "i")
    rows = dealt.mapInPandas(fill, "i long, bits binary").collect()  # the bits of the sieve, 32 MB at most
    return df.sparkSession.sparkContext.broadcast(Sieve({r.i: bytes(r.bits) for r in rows}, log))
