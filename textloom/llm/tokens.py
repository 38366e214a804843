"""Token counts by rank-synchronous merging of ragged numpy arrays.

Distinct pre-tokens of an Arrow batch lie end to end in one array.  In each round every
sequence merges its own lowest-rank pair wherever it stands, all sequences at once; finished
sequences leave.  What survives is counted.  Null text counts as empty; an empty table gives
no rows; repeated rows are counted each; text of any length is counted whole; a null doc_id stays
null; columns but doc_id and text are never read.  Equal ranks cannot be: a pair has one rank.
"""

from __future__ import annotations

import json
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame

from .common import texts

FAR = np.iinfo(np.int64).max
CACHE = 400_000  # pre-tokens whose counts a worker remembers
WORDS = regex.compile(r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+""")


def byte_letters() -> dict[int, str]:
    """Letters that stand for bytes in byte-level vocabularies: printable bytes stand for themselves."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


class MergeCounter:
    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab, merges = spec["model"]["vocab"], spec["model"]["merges"]
        self.size = max(vocab.values()) + 1
        self.special = [x["content"] for x in spec.get("added_tokens", [])]
        self.split = regex.compile("|".join(map(regex.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None
        self.first = np.array([vocab[x] for _, x in sorted(byte_letters().items())], np.int64)
        pairs = [x.split(" ") if isinstance(x, str) else x for x in merges]
        keys = np.array([vocab[a] * self.size + vocab[b] for a, b in pairs], np.int64)
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks = keys[order], order.astype(np.int64)
        self.into = np.array([vocab[a + b] for a, b in pairs], np.int64)
        self.known: dict[str, int] = {}

    def merge(self, words: list[str]) -> np.ndarray:
        """Symbols left of each word."""
        data = [w.encode("utf-8") for w in words]
        out = np.array([len(x) for x in data], np.int64)
        sym = self.first[np.frombuffer(b"".join(data), np.uint8)]
        seq = np.repeat(np.arange(len(words)), out)
        while len(sym) > 1:
            pair = sym[:-1] * self.size + sym[1:]
            at = np.minimum(np.searchsorted(self.keys, pair), len(self.keys) - 1)
            rank = np.where((self.keys[at] == pair) & (seq[1:] == seq[:-1]), self.ranks[at], FAR)
            starts = np.flatnonzero(np.r_[True, seq[1:] != seq[:-1]])
            low = np.minimum.reduceat(np.r_[rank, FAR], starts)
            live = low < FAR
            if not live.any():
                break
            width = np.diff(np.r_[starts, len(sym)])
            least = np.repeat(low, width)
            hit = np.r_[rank, FAR]
            hit = (hit == least) & (hit < FAR)
            # in a run such as a a a only every other place merges, from the left
            places = np.flatnonzero(hit)
            run = np.flatnonzero(np.r_[True, np.diff(places) != 1])
            nth = np.arange(len(places)) - np.repeat(run, np.diff(np.r_[run, len(places)]))
            same = sym[places] == sym[np.minimum(places + 1, len(sym) - 1)]
            places = places[~same | (nth % 2 == 0)]
            sym[places] = self.into[least[places]]
            keep = np.ones(len(sym), bool)
            keep[places + 1] = False
            np.subtract.at(out, seq[places], 1)
            keep &= np.repeat(live, width)
            sym, seq = sym[keep], seq[keep]
        return out

    def count(self, batch: list[str]) -> list[int]:
        found, extra = [], []
        for text in batch:
            pieces = self.split.split(text) if self.split else [text]
            extra.append(len(pieces) - 1)
            c: Counter = Counter()
            for p in pieces:
                c.update(WORDS.findall(p))
            found.append(c)
        if len(self.known) > CACHE:
            self.known.clear()
        new = [w for w in dict.fromkeys(w for c in found for w in c) if w not in self.known]
        self.known.update(zip(new, self.merge(new).tolist(), strict=True) if new else ())
        return [e + sum(self.known[w] * n for w, n in c.items()) for c, e in zip(found, extra, strict=True)]


@lru_cache(2)
def _counter(path: str) -> MergeCounter:
    return MergeCounter(path)


def count_tokens(docs: DataFrame, path: str, limit: int = 512) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit of every whole text."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        c = _counter(path)
        for b in batches:
            for i in range(0, len(b), 256):
                part = b.iloc[i : i + 256]
                n = np.array(c.count(part.text.tolist()), np.int64)
                yield pd.DataFrame({"doc_id": part.doc_id.astype("Int64").to_numpy(), "n_bytes": [len(t.encode()) for t in part.text], "n_tokens": n, "over_limit": n > limit})

    return texts(docs).mapInPandas(run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
