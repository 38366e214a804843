"""Exact top-k inner products: norm-sorted candidates, SVD-rotated partial sums, Cauchy-Schwarz bounds.

Components become floor(256 x), so scores are integers, exact in double precision while they stay
below 2^53.  A rotation from the second-moment matrix of all vectors gathers most of each product
in the first coordinates; the rest is bounded by the product of the residual norms.

Vectors are sorted by descending norm over the whole cluster and packed in groups of GROUP rows.
Queries are packed in blocks of QUERIES.  Every block first meets the groups of the longest
vectors, which gives each query a score to beat; then it goes to those groups alone whose longest
vector could still win.  A task holds one group and one block at a time, and the driver only the
moments and one (norm, number) pair for each group.

Every row is a candidate of all queries but its own row: repeated rows of one vec_id are rows of
their own, each with its answers if it is a query.  Equal scores go to the smaller vec_id.
Vectors that are null, or hold a null or non-finite component, or have a null vec_id take no
part.  Where lengths differ, components that one vector lacks count as zero; an empty vector
scores 0 with all.  An empty table gives no rows; other columns are never read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark import TaskContext

from .common import cut, parts

GROUP, QUERIES, BLOCK, HEAD = 16_384, 1024, 1024, 24
PACK = "part int, seq int, top double, ids binary, rows binary, v binary"


def quantise(vectors: DataFrame) -> DataFrame:
    """row, vec_id, v (integers), norm of the vectors that take part."""
    x = F.transform("embedding", lambda c: c.cast("double"))
    finite = F.forall("x", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))))
    q = vectors.select(F.monotonically_increasing_id().alias("row"), F.col("vec_id").cast("long").alias("vec_id"), x.alias("x")).where("vec_id is not null and x is not null").where(finite)
    q = q.select("row", "vec_id", F.transform("x", lambda c: F.floor(c * 256).cast("long")).alias("v"))
    return q.withColumn("norm", F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, c: a + c.cast("double") * c.cast("double"))))


def _matrix(vs, dim: int) -> np.ndarray:
    out = np.zeros((len(vs), dim))
    for i, v in enumerate(vs):
        out[i, : len(v)] = v
    return out


def _moments(dim: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = np.zeros((dim, dim))
        for b in batches:
            x = _matrix(b.v, dim)
            m += x.T @ x
        yield pd.DataFrame({"m": [m.tobytes()]})

    return run


def _pack(dim: int, size: int):
    """Rows of a partition as blocks of at most `size` vectors."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part, seq, held, n = TaskContext.get().partitionId(), 0, [], 0

        def block(b: pd.DataFrame) -> pd.DataFrame:
            return pd.DataFrame({"part": [part], "seq": [seq], "top": [b.norm.max()], "ids": [b.vec_id.to_numpy(np.int64).tobytes()], "rows": [b.row.to_numpy(np.int64).tobytes()], "v": [_matrix(b.v, dim).tobytes()]})

        for b in batches:
            held.append(b)
            n += len(b)
            while n >= size:
                every = pd.concat(held, ignore_index=True)
                yield block(every.iloc[:size])
                seq, held, n = seq + 1, [every.iloc[size:]], n - size
        if n:
            yield block(pd.concat(held, ignore_index=True))

    return run


class Group:
    """Vectors by descending norm, and their rotation."""

    def __init__(self, ids: bytes, rows: bytes, v: bytes, rot: np.ndarray, head: int):
        ids, rows = np.frombuffer(ids, np.int64), np.frombuffer(rows, np.int64)
        v = np.frombuffer(v).reshape(len(ids), -1)
        norm = np.linalg.norm(v, axis=1)
        o = np.argsort(-norm, kind="stable")
        self.ids, self.rows, self.v, self.norm, self.head = ids[o], rows[o], v[o], norm[o], head
        self.turned = self.v @ rot
        self.rest = np.linalg.norm(self.turned[:, head:], axis=1)

    def best(self, q: Group, k: int, floor: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Scores and vec_ids of each query's k best here that reach its floor; -inf where there are fewer."""
        best, who = np.full((len(q.ids), k), -np.inf), np.full((len(q.ids), k), -1, np.int64)
        for i in range(0, len(self.ids), BLOCK):
            at = slice(i, i + BLOCK)
            slack = 1e-9 * (1 + q.norm * self.norm[i])
            bar = np.maximum(best[:, -1], floor)
            alive = np.flatnonzero(q.norm * self.norm[i] + slack >= bar)  # later vectors are shorter still
            if not len(alive):
                break
            for a in range(0, len(alive), 512):
                r = alive[a : a + 512]
                bound = q.turned[r, : self.head] @ self.turned[at, : self.head].T + np.outer(q.rest[r], self.rest[at])
                go = (bound + slack[r, None] >= bar[r, None]) & (q.rows[r, None] != self.rows[None, at])
                qi, ci = np.nonzero(go)
                if len(qi) * 4 > go.size:
                    s = np.where(go, q.v[r] @ self.v[at].T, -np.inf)
                else:
                    s = np.full(go.shape, -np.inf)
                    s[qi, ci] = np.einsum("ij,ij->i", q.v[r][qi], self.v[at][ci])
                for t in np.unique(qi).tolist():
                    row = r[t]
                    c = np.flatnonzero((s[t] >= bar[row]) & np.isfinite(s[t]))
                    if len(c):
                        sc, vi = np.r_[best[row], s[t, c]], np.r_[who[row], self.ids[at][c]]
                        o = np.lexsort((vi, -sc))[:k]
                        best[row], who[row] = sc[o], vi[o]
        return best, who


def top_k(vectors: DataFrame, k: int = 5, every: int = 50) -> DataFrame:
    """query_id, rank, vec_id, score: queries are the rows whose vec_id is divisible by `every`."""
    spark = vectors.sparkSession
    q = cut(quantise(vectors))
    size = q.agg(F.count("*").alias("n"), F.max(F.size("v")).alias("dim")).first()
    if not size.n:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    dim = max(1, size.dim)
    ms = q.select("v").mapInPandas(_moments(dim), "m binary")
    # matrices of dim x dim, one for each task, are summed pairwise on the executors
    total = ms.rdd.map(lambda r: np.frombuffer(r.m).reshape(dim, dim)).treeReduce(np.add)
    rot = np.ascontiguousarray(np.linalg.eigh(total)[1][:, ::-1])
    head = min(HEAD, dim)
    sorted_ = q.repartitionByRange(max(1, -(-size.n // GROUP)), F.desc("norm"), "row").sortWithinPartitions(F.desc("norm"), "row")
    groups = cut(sorted_.mapInPandas(_pack(dim, GROUP), PACK))
    blocks = cut(q.where(F.pmod("vec_id", F.lit(every)) == 0).repartition(parts(spark), "row").mapInPandas(_pack(dim, QUERIES), PACK))
    # two numbers for each GROUP vectors
    tops = sorted((-r.top, r.part, r.seq) for r in groups.select("top", "part", "seq").collect())

    def floors(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Each block with the k-th score that each query finds in the first group."""
        first = None
        for b in batches:
            for i in range(len(b)):
                if first is None:
                    first = Group(b.ids0[i], b.rows0[i], b.v0[i], rot, head)
                block = Group(b.ids[i], b.rows[i], b.v[i], rot, head)
                best, _ = first.best(block, k, np.full(len(block.ids), -np.inf))
                yield pd.DataFrame({"part": [b.part[i]], "seq": [b.seq[i]], "ids": [block.ids.tobytes()], "rows": [block.rows.tobytes()], "v": [block.v.tobytes()], "floor": [best[:, -1].tobytes()]})

    def visits(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Each block once for every group that could still hold one of some query's best."""
        for b in batches:
            for i in range(len(b)):
                norm = np.linalg.norm(np.frombuffer(b.v[i]).reshape(-1, dim), axis=1)
                floor = np.frombuffer(b.floor[i])
                for top, part, seq in tops:
                    if (norm * -top * (1 + 1e-9) + 1e-6 < floor).all():
                        break
                    yield pd.DataFrame({"part": [part], "seq": [seq], "block": [f"{b.part[i]}:{b.seq[i]}"], "ids": [b.ids[i]], "rows": [b.rows[i]], "v": [b.v[i]], "floor": [b.floor[i]]})

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Sorted by group: its vectors, then the blocks that visit it."""
        group = None
        for b in batches:
            for i in range(len(b)):
                if b.block[i] is None:
                    group = Group(b.ids[i], b.rows[i], b.v[i], rot, head)
                    continue
                block = Group(b.ids[i], b.rows[i], b.v[i], rot, head)
                best, who = group.best(block, k, np.frombuffer(b.floor[i]))  # already in order of norm
                qi, ki = np.nonzero(np.isfinite(best))
                yield pd.DataFrame({"query_row": block.rows[qi], "query_id": block.ids[qi], "vec_id": who[qi, ki], "score": best[qi, ki].astype(np.int64)})

    _, part0, seq0 = tops[0]
    longest = groups.where((F.col("part") == part0) & (F.col("seq") == seq0)).select(F.lit(1).alias("one"), F.col("ids").alias("ids0"), F.col("rows").alias("rows0"), F.col("v").alias("v0"))
    seeded = cut(blocks.withColumn("one", F.lit(1)).join(F.broadcast(longest), "one").mapInPandas(floors, "part int, seq int, ids binary, rows binary, v binary, floor binary"))  # one group
    null = lambda t: F.lit(None).cast(t)
    held = groups.select("part", "seq", null("string").alias("block"), "ids", "rows", "v", null("binary").alias("floor"))
    asked = seeded.mapInPandas(visits, "part int, seq int, block string, ids binary, rows binary, v binary, floor binary")
    met = held.union(asked).repartition(parts(spark), "part", "seq").sortWithinPartitions("part", "seq", F.asc_nulls_first("block"))
    found = met.mapInPandas(search, "query_row long, query_id long, vec_id long, score long")
    w = Window.partitionBy("query_row").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
