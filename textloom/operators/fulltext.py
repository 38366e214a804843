"""A stored inverted index: a query reads the shards and row groups of its own tokens, not the texts.

A posting is a token's places in one column of one row.  Texts are turned into postings one by one, without a shuffle of
words; postings are dealt to shards by their token's first two letters, so that words and prefixes name their shards, and lie in order of
token within files.  Rows are added, deleted and replaced as versions of published tables: a deletion
hides what earlier versions said of a key, and what the same version adds stays.
"""

from __future__ import annotations

import re
import unicodedata
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.operators.catalogue import tokens
from textloom.sources.published import Published

SHARDS, SPLITS = 64, 8  # shards, and the parts in which each is written


def wanted(match: str) -> list[tuple[list[str], bool]]:
    """Words of a query's terms, as texts have them, and whether a term is a prefix: word, "a phrase", prefix*."""
    found = [(m[0] or m[1], m[2]) for m in re.findall(r'"([^"]*)"|(\S+?)(\*?)(?:\s|$)', match)]
    plain = lambda x: "".join(c for c in unicodedata.normalize("NFD", x.lower()) if unicodedata.category(c) != "Mn")
    terms = [(re.findall(r"[^\W_]+", plain(said)), bool(star)) for said, star in found]
    return [(ws, star) for ws, star in terms if ws]


def shard_of(token: Column, shards: int = SHARDS) -> Column:
    return F.pmod(F.xxhash64(F.substring(token, 1, 2)), F.lit(shards)).cast("int")


def _grouped(words: Column) -> Column:
    """token and ascending places of each different word of an array."""

    def run(texts: pa.Array) -> pa.Array:
        out = []
        for ws in texts.to_pylist():
            at: dict[str, list[int]] = {}
            for i, w in enumerate(ws or ()):
                at.setdefault(w, []).append(i)
            out.append([{"token": w, "at": p} for w, p in at.items()])
        return pa.array(out, pa.list_(pa.struct([("token", pa.string()), ("at", pa.list_(pa.int32()))])))

    return F.arrow_udf(run, "array<struct<token:string,at:array<int>>>")(words)


def postings(rows: DataFrame, key: str, columns: list[str], shards: int = SHARDS) -> DataFrame:
    """shard, token, key, col, at of every word of every row; keys are unique, null texts have no words."""
    one = [rows.select(F.col(key).alias("key"), F.lit(i).alias("col"), F.explode(_grouped(tokens(F.col(c)))).alias("p")) for i, c in enumerate(columns)]
    return reduce(DataFrame.unionByName, one).select(shard_of(F.col("p.token"), shards).alias("shard"), "p.token", "key", "col", "p.at")


def found(held: DataFrame, match: str, shards: int = SHARDS) -> DataFrame:
    """key of the rows that hold every term of a query in some column; a phrase stands in one column.  A query without terms finds none."""
    wants = wanted(match)
    if not wants:
        return held.select("key").limit(0)
    exact, prefixes = sorted({w for ws, star in wants if not star for w in ws}), sorted({ws[0] for ws, star in wants if star})
    named = reduce(lambda a, b: a | b, [F.startswith(F.col("token"), F.lit(p)) for p in prefixes], F.col("token").isin(*exact) if exact else F.lit(False))
    if all(len(p) > 1 for p in prefixes):  # the shards of the query's own tokens; the driver asks for a few hashes
        spark = held.sparkSession
        asked = [r[0] for r in spark.createDataFrame([(w,) for w in {*exact, *prefixes}], "w string").select(shard_of(F.col("w"), shards)).distinct().collect()]
        named &= F.col("shard").isin(*asked)
    mine = held.where(named)
    places = {w: F.first(F.when(F.col("token") == w, F.col("at")), ignorenulls=True).alias(f"w{i}") for i, w in enumerate(exact)}
    begun = [F.bool_or(F.startswith(F.col("token"), F.lit(p))).alias(f"p{i}") for i, p in enumerate(prefixes)]
    cells = mine.groupBy("key", "col").agg(*places.values(), *begun)

    def hit(words: list[str], star: bool) -> Column:
        if star:
            return F.col(f"p{prefixes.index(words[0])}")
        at = F.col(f"w{exact.index(words[0])}")
        for w in words[1:]:
            at = F.array_intersect(F.transform(at, lambda x: x + 1), F.col(f"w{exact.index(w)}"))
        return F.coalesce(F.size(at) > 0, F.lit(False))

    said = cells.select("key", *[hit(*x).alias(f"h{i}") for i, x in enumerate(wants)])
    every = said.groupBy("key").agg(*[F.bool_or(f"h{i}").alias(f"h{i}") for i in range(len(wants))])
    return every.where(reduce(lambda a, b: a & b, [F.col(f"h{i}") for i in range(len(wants))])).select("key")


class FullText:
    """An index of some columns of rows with unique keys, kept in a published store."""

    def __init__(self, store: Published, columns: list[str], shards: int = SHARDS):
        self.store, self.columns, self.shards = store, columns, shards

    def _dealt(self, rows: DataFrame, key: str, version: int) -> tuple[DataFrame, str]:
        p = postings(rows, key, self.columns, self.shards).withColumn("version", F.lit(version))
        return p.repartition(self.shards, "shard", F.pmod(F.xxhash64("key"), F.lit(SPLITS))).sortWithinPartitions("shard", "token", "key"), "shard"

    def add(self, rows: DataFrame, key: str) -> int:
        return self.store.update(lambda v: {"append": {"postings": self._dealt(rows, key, v + 1)}, "note": "add"})

    def delete(self, keys: DataFrame) -> int:
        """Hides the rows of keys(key) from this version on."""
        return self.store.update(lambda v: {"append": {"gone": keys.select("key", F.lit(v + 1).alias("version"))}, "note": "delete"})

    def replace(self, rows: DataFrame, key: str) -> int:
        """What earlier versions said of these keys goes, what the rows say now stays, in one version."""
        return self.store.update(lambda v: {"append": {"gone": rows.select(F.col(key).alias("key"), F.lit(v + 1).alias("version")), "postings": self._dealt(rows, key, v + 1)}, "note": "replace"})

    def compact(self) -> int:
        """Writes what is visible anew, in one folder."""
        return self.store.update(lambda v: {"replace": {"postings": (self.visible(v).repartition(self.shards, "shard", F.pmod(F.xxhash64("key"), F.lit(SPLITS))).sortWithinPartitions("shard", "token", "key"), "shard"), **({"gone": self.store.read("gone", v).limit(0)} if "gone" in self.store.tables(v) else {})}, "note": "compact"})

    def visible(self, version: int | None = None, match: str | None = None) -> DataFrame:
        held = self.store.read("postings", version)
        if "gone" not in self.store.tables(version):
            return held
        gone = self.store.read("gone", version).groupBy("key").agg(F.max("version").alias("_gone"))
        return held.join(gone, "key", "left").where("_gone is null or version >= _gone").drop("_gone").select(held.columns)

    def search(self, match: str, version: int | None = None) -> DataFrame:
        return found(self.visible(version), match, self.shards)
