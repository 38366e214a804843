"""Toxicity by a factorization machine over hashed terms.

The score is sigmoid(b + sum w_i x_i + sum_{i<j} <v_i, v_j> x_i x_j): pairwise factors learn
such interactions as an insult beside a group mention.  Terms are hashed words; x_i says
whether a bucket occurs.  The machine is fitted by full-batch Adam in numpy on a bounded sample
of labelled rows, those of smallest hash; two documented bounds hold what it learns from and what
it holds: `max_rows` labelled rows, and the `terms` buckets that tell the labels apart best among
those rows.  Every text is read and scored whole, whatever its length.

Null or empty texts get the score of the bias alone.  Rows with a null doc_id are scored and
never learned from.  With no labels, or labels of one kind, the score is the smoothed base
rate.  A doc_id labelled more than once counts once, toxic if any label says so; of repeated rows
each is scored, and all alike.  Ties for the last term go to the smaller bucket.  An empty table
gives no rows; columns but doc_id, text and toxic are never read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import smallest, texts

BUCKETS, TERMS, FACTORS, MAX_ROWS = 1 << 20, 1024, 4, 12_000
_HASHES: dict[bytes, int] = {}


def terms(text: str) -> np.ndarray:
    """Distinct hash buckets of the lower-cased words, edge punctuation removed."""
    if len(_HASHES) > 500_000:
        _HASHES.clear()
    out = set()
    for w in set(text.lower().split()):
        h = _HASHES.get(w)
        if h is None:
            h = _HASHES[w] = zlib.crc32(w.strip("""!"#$%&'()*+,-./:;<=>?@[]^_`{|}~""").encode()) % BUCKETS
        out.add(h)
    return np.fromiter(out, np.int64, len(out))


@dataclass
class FactorizationMachine:
    buckets: np.ndarray  # sorted
    bias: float
    w: np.ndarray
    v: np.ndarray

    def rows(self, found: list[np.ndarray]) -> np.ndarray:
        x = np.zeros((len(found), len(self.buckets)), np.float32)
        for i, f in enumerate(found if len(self.buckets) else ()):
            at = np.minimum(np.searchsorted(self.buckets, f), len(self.buckets) - 1)
            x[i, at[self.buckets[at] == f]] = 1
        return x

    def score(self, x: np.ndarray) -> np.ndarray:
        """x holds 0 and 1, so squares of its entries are its entries."""
        s = x @ self.v
        z = self.bias + x @ self.w + 0.5 * ((s * s).sum(axis=1) - x @ (self.v * self.v).sum(axis=1))
        return 1 / (1 + np.exp(-np.clip(z.astype(np.float64), -30, 30)))


def fit(found: list[np.ndarray], y: np.ndarray, terms: int = TERMS, epochs: int = 200, rate: float = 0.05, l2: float = 2e-4) -> FactorizationMachine:
    base = float(np.log((y.sum() + 1) / (len(y) - y.sum() + 1)))
    empty = FactorizationMachine(np.zeros(0, np.int64), base, np.zeros(0, np.float32), np.zeros((0, FACTORS), np.float32))
    if len(y) == 0 or y.min() == y.max():
        return empty
    ids, at = np.unique(np.concatenate([np.zeros(0, np.int64), *found]), return_inverse=True)
    label = np.repeat(y, [len(f) for f in found])
    pos, every = np.bincount(at, label, len(ids)), np.bincount(at, minlength=len(ids))
    share = y.mean()
    z = (pos - every * share) / np.sqrt(every * share * (1 - share) + 1)
    fm = FactorizationMachine(np.sort(ids[np.argsort(-np.abs(z), kind="stable")[:terms]]), base, np.zeros(0), np.zeros(0))
    x, rng = fm.rows(found), np.random.default_rng(0)
    k = x.shape[1]
    p = np.r_[base, np.zeros(k), rng.normal(0, 0.05, k * FACTORS)].astype(np.float32)
    m, q = np.zeros_like(p), np.zeros_like(p)
    for t in range(1, epochs + 1):
        fm.bias, fm.w, fm.v = p[0], p[1 : k + 1], p[k + 1 :].reshape(k, FACTORS)
        s = x @ fm.v
        d = ((fm.score(x) - y) / len(y)).astype(np.float32)
        xd = x.T @ np.c_[d, d[:, None] * s]
        g = np.r_[d.sum(), xd[:, 0] + 1e-4 * fm.w, (xd[:, 1:] - xd[:, :1] * fm.v + l2 * fm.v).ravel()]
        m, q = 0.9 * m + 0.1 * g, 0.999 * q + 0.001 * g * g
        p = (p - rate * (m / (1 - 0.9**t)) / (np.sqrt(q / (1 - 0.999**t)) + 1e-8)).astype(np.float32)
    fm.bias, fm.w, fm.v = float(p[0]), p[1 : k + 1], p[k + 1 :].reshape(k, FACTORS)
    return fm


def crc_mod(n: int):
    return F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(n))


def train(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS, terms_held: int = TERMS) -> FactorizationMachine:
    marked = labels.where("toxic is not null and doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").alias("toxic"))
    rows = smallest(marked.where(crc_mod(5) != 0), ["doc_id"], max_rows)
    chosen = texts(docs).join(F.broadcast(rows), "doc_id").groupBy("doc_id", "toxic").agg(F.min("text").alias("text"))  # rows: at most max_rows of two numbers

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"doc_id": b.doc_id, "toxic": b.toxic, "ids": [terms(t).astype(np.int32).tobytes() for t in b.text]})

    got = sorted(chosen.mapInPandas(run, "doc_id long, toxic int, ids binary").collect(), key=lambda r: (r.doc_id, bytes(r.ids)))
    return fit([np.frombuffer(r.ids, np.int32).astype(np.int64) for r in got], np.array([r.toxic for r in got], float), terms_held)


def score(docs: DataFrame, model: FactorizationMachine) -> DataFrame:
    """doc_id, held_out, score, predicted."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            s = model.score(model.rows([terms(t) for t in b.text]))
            yield pd.DataFrame({"doc_id": b.doc_id.astype("Int64").to_numpy(), "score": s.astype(float), "predicted": (s >= 0.5).astype(np.int32)})

    out = texts(docs).mapInPandas(run, "doc_id long, score double, predicted int")
    return out.select("doc_id", F.coalesce(crc_mod(5) == 0, F.lit(False)).alias("held_out"), "score", "predicted")
