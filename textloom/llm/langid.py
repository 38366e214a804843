"""Language ID by a bidirectional gated recurrent network over bytes.

Trained in numpy by backpropagation through time on one window of `window` code points, from
anywhere in the text, of a bounded sample: the `max_rows` documents of smallest hash (both are
parameters).  At prediction whole texts are read: texts of up to SEGMENT bytes in one run from end
to end; longer ones in segments whose states are first warmed up on CONTEXT bytes of each
neighbour, by which the network forgets where it began.  Every position gets a distribution, and
their mean over the document is its probability.

`und` with score 0 for null texts and texts without a letter.  With no labelled text, every
text is `und`.  Rows with a null doc_id are predicted and never learned from; repeated rows
get equal results; equal probabilities go to the first language by name.  An empty table gives no
rows; columns but doc_id, text and lang (in training) and those to carry are never read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import hold, smallest

HIDDEN, WINDOW, MAX_ROWS = 8, 96, 4_000
SEGMENT, CONTEXT, LANES, TEXTS = 1024, 128, 512, 2048
LETTER = regex.compile(r"\p{L}")


def _sig(x):
    return 0.5 * np.tanh(0.5 * x) + 0.5


@dataclass
class Reader:
    """One direction: h' = (1 - z) h + z n, with update z, reset r and proposal n."""

    e: np.ndarray  # 257 x 3H; 256 is padding
    u: np.ndarray  # H x 3H

    def step(self, byte, h):
        k = h.shape[1]
        a = self.e[byte]
        zr = _sig(a[:, : 2 * k] + h @ self.u[:, : 2 * k])
        z, r = zr[:, :k], zr[:, k:]
        n = np.tanh(a[:, 2 * k :] + (r * h) @ self.u[:, 2 * k :])
        return h + z * (n - h), z, r, n

    def forward(self, x, keep=False):
        h = np.zeros((x.shape[1], self.u.shape[0]), np.float32)
        hs, parts = np.empty((len(x), *h.shape), np.float32), []
        for t in range(len(x)):
            new, z, r, n = self.step(x[t], h)
            if keep:
                parts.append((h, z, r, n))
            hs[t] = h = new
        return hs, parts

    def backward(self, x, parts, dhs):
        k = self.u.shape[0]
        de, du, dh = np.zeros_like(self.e), np.zeros_like(self.u), np.zeros_like(dhs[0])
        for t in range(len(x) - 1, -1, -1):
            h, z, r, n = parts[t]
            dh = dh + dhs[t]
            dn = dh * z * (1 - n * n)
            dz = dh * (n - h) * z * (1 - z)
            drh = dn @ self.u[:, 2 * k :].T
            dr = drh * h * r * (1 - r)
            da = np.concatenate([dz, dr, dn], axis=1)
            np.add.at(de, x[t], da)
            du[:, : 2 * k] += h.T @ da[:, : 2 * k]
            du[:, 2 * k :] += (r * h).T @ dn
            dh = dh * (1 - z) + drh * r + da[:, : 2 * k] @ self.u[:, : 2 * k].T
        return de, du


@dataclass
class Model:
    langs: list[str]
    fore: Reader
    back: Reader
    w: np.ndarray  # 2H x L
    b: np.ndarray

    def logits(self, x):
        """steps x languages x lanes.  Both directions go at once, and each gate is one stretch of memory.

        Forward and backward parts add up step by step, so that states need not be kept.  A gate is
        1 / (1 + exp(-v)), the proposal 2 / (1 + exp(-2v)) - 1: the factors of v go into the weights beforehand."""
        k, lanes, readers = self.fore.u.shape[0], x.shape[1], (self.fore, self.back)
        scaled = lambda v, g: np.ascontiguousarray(v[..., g * k : (g + 1) * k] * np.float32(-2 if g == 2 else -1))
        e = [np.concatenate([scaled(r.e, g) for r in readers]) for g in range(3)]
        u = np.stack([[scaled(r.u, g) for r in readers] for g in range(3)])
        w = np.stack([self.w[:k].T, self.w[k:].T])
        x = np.concatenate([x, x[::-1] + len(self.fore.e)], axis=1)
        a, h = np.empty((3, 2, lanes, k), np.float32), np.zeros((2, lanes, k), np.float32)
        flat, zr, (z, r, n) = a.reshape(3, 2 * lanes, k), a[:2], a
        more, own, said = np.empty_like(zr), np.empty_like(h), np.empty((2, len(self.b), lanes), np.float32)
        out = np.empty((len(x), len(self.b), lanes), np.float32)
        out[:] = self.b[:, None]
        with np.errstate(over="ignore"):  # a shut gate
            for t in range(len(x)):
                for g in range(3):
                    np.take(e[g], x[t], axis=0, out=flat[g], mode="clip")
                zr += np.matmul(h, u[:2], out=more)
                np.exp(zr, out=zr)
                zr += 1
                np.divide(h, r, out=r)
                n += np.matmul(r, u[2], out=own)
                np.exp(n, out=n)
                n += 1
                np.divide(2, n, out=n)
                n -= 1
                n -= h
                n /= z
                h += n
                np.matmul(w, h.transpose(0, 2, 1), out=said)
                out[t] += said[0]
                out[-1 - t] += said[1]
        return out

    def documents(self, texts: list[bytes]) -> np.ndarray:
        """Mean of the distributions at every byte of each text."""
        total, size = np.zeros((len(texts), len(self.langs))), np.array([max(1, len(t)) for t in texts])
        parts = [(min(SEGMENT, len(t) - s) + min(s, CONTEXT) + min(CONTEXT, max(0, len(t) - s - SEGMENT)), i, s) for i, t in enumerate(texts) for s in range(0, len(t), SEGMENT)]
        parts.sort()
        for p in range(0, len(parts), LANES):
            lanes = parts[p : p + LANES]
            steps = lanes[-1][0]
            x = np.full((len(lanes), steps), 256, np.int64)
            own = np.zeros((len(lanes), steps), np.float32)
            for j, (n, i, s) in enumerate(lanes):
                a = max(0, s - CONTEXT)
                x[j, :n] = np.frombuffer(texts[i], np.uint8, n, a)
                own[j, s - a : s - a + min(SEGMENT, len(texts[i]) - s)] = 1
            z = self.logits(np.ascontiguousarray(x.T))
            z -= z.max(axis=1, keepdims=True)
            np.exp(z, out=z)
            z *= (own.T / z.sum(axis=1))[:, None]
            np.add.at(total, [i for _, i, _ in lanes], z.sum(axis=0).T)
        return total / size[:, None]


def fit(texts: list[bytes], langs: list[str], epochs: int = 12, rate: float = 0.01, seed: int = 0) -> Model:
    names = sorted(set(langs))
    rng = np.random.default_rng(seed)
    init = lambda *s: rng.normal(0, 0.3, s).astype(np.float32)
    m = Model(names, Reader(init(257, 3 * HIDDEN), init(HIDDEN, 3 * HIDDEN)), Reader(init(257, 3 * HIDDEN), init(HIDDEN, 3 * HIDDEN)), init(2 * HIDDEN, len(names)), np.zeros(len(names), np.float32))
    for reader in (m.fore, m.back):
        reader.e[256, :HIDDEN] = -1e4  # padding shuts the update gate, here and for good: states pass it unchanged
    longest = max(len(t) for t in texts)
    x = np.full((len(texts), longest), 256, np.int64)
    for i, t in enumerate(texts):
        x[i, : len(t)] = np.frombuffer(t, np.uint8)
    y = np.array([names.index(v) for v in langs])
    params = [m.fore.e, m.fore.u, m.back.e, m.back.u, m.w, m.b]
    mo, ve, t = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params], 0
    for _ in range(epochs):
        for lot in np.array_split(rng.permutation(len(y)), max(1, len(y) // 64)):
            xb, yb = np.ascontiguousarray(x[lot].T), y[lot]
            f, fp = m.fore.forward(xb, True)
            g, gp = m.back.forward(xb[::-1], True)
            hid = np.concatenate([f, g[::-1]], axis=2)
            z = hid @ m.w + m.b
            z = np.exp(z - z.max(axis=2, keepdims=True))
            d = z / z.sum(axis=2, keepdims=True)
            d[:, np.arange(len(lot)), yb] -= 1
            d *= (xb < 256)[:, :, None] / max(1, int((xb < 256).sum()))
            dh = d @ m.w.T
            grads = [*m.fore.backward(xb, fp, dh[:, :, :HIDDEN]), *m.back.backward(xb[::-1], gp, dh[::-1, :, HIDDEN:]), np.tensordot(hid, d, ((0, 1), (0, 1))), d.sum(axis=(0, 1))]
            t += 1
            size = np.sqrt(sum(float((v * v).sum()) for v in grads))
            for p, v, a, b in zip(params, grads, mo, ve, strict=True):
                v = v * min(1, 1 / (size + 1e-9))
                a += 0.1 * (v - a)
                b += 0.001 * (v * v - b)
                p -= rate * (a / (1 - 0.9**t)) / (np.sqrt(b / (1 - 0.999**t)) + 1e-8)
    return m


def crc_mod(n: int):
    return F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(n))


def train(docs: DataFrame, max_rows: int = MAX_ROWS, window: int = WINDOW) -> Model | None:
    """Learns from documents whose crc32(doc_id) mod 3 is not 1 alone; a window from anywhere in each."""
    known = docs.where("doc_id is not null and lang is not null and text is not null").where(crc_mod(3) != 1).where(F.col("text").rlike(r"\p{L}"))
    rows = known.select(F.col("doc_id").cast("long").alias("doc_id"), "lang", F.xxhash64("text").alias("same"), "text")
    start = F.pmod(F.xxhash64("doc_id"), F.greatest(F.lit(1), F.length("text") - window)).cast("int") + 1
    cut = rows.select("doc_id", "same", "lang", F.substring("text", start, F.lit(window)).alias("text"))
    got = [(r.text.encode("utf-8"), r.lang) for r in smallest(cut, ["doc_id", "same"], max_rows).collect()]
    return fit([a for a, _ in got], [b for _, b in got]) if got else None


def predict(docs: DataFrame, model: Model | None, carry: list[str] | None = None) -> DataFrame:
    """doc_id, held_out, lang_pred, score, and columns of plain types to carry as they came."""
    carry = carry or []

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hold("langid")
        for b in batches:
            for i in range(0, len(b), TEXTS):  # the more at once, the nearer in length are the lanes of a run
                part = b.iloc[i : i + TEXTS]
                text = part["_text"].tolist()
                said = [isinstance(t, str) and bool(LETTER.search(t)) and model is not None for t in text]
                lang, score = ["und"] * len(part), [0.0] * len(part)
                at = [j for j, s in enumerate(said) if s]
                if at:
                    p = model.documents([text[j].encode("utf-8") for j in at])
                    for j, row in zip(at, p, strict=True):
                        lang[j], score[j] = model.langs[int(row.argmax())], float(min(1.0, row.max()))
                yield pd.DataFrame({"_id": part["_id"].astype("Int64").to_numpy(), "lang_pred": lang, "score": score, **{f"_c{k}": part[f"_c{k}"].to_numpy() for k in range(len(carry))}})

    asked = docs.select(F.col("doc_id").cast("long").alias("_id"), F.col("text").alias("_text"), *[F.col(c).cast("string").alias(f"_c{k}") for k, c in enumerate(carry)])
    kinds = "".join(f", _c{k} string" for k in range(len(carry)))
    out = asked.mapInPandas(run, f"_id long, lang_pred string, score double{kinds}").withColumn("doc_id", F.col("_id"))
    return out.select("doc_id", F.coalesce(crc_mod(3) == 1, F.lit(False)).alias("held_out"), "lang_pred", "score", *[F.col(f"_c{k}").cast(docs.schema[c].dataType).alias(c) for k, c in enumerate(carry)])
