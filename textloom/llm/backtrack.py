"""Byte-level BPE by backtracking over longest token matches; decoding by an offset table.

An Aho-Corasick automaton of reversed tokens reads a word backwards, so that its longest match ending at a
place is the longest token that starts there; moves over its failure links are remembered as they are met.  The encoder takes longest matches from the left, falls back to
the next shorter token where a pair could not stand side by side after all merges, and steps back where no
token is left; a place that led nowhere is never tried again, so the work is linear.  Whether a pair can
stand is asked of a table that fills as pairs are met: the merges of both tokens are undone from the last one
on, and the pair falls if its border would have been merged before one of them.  That a sequence is right
when each of its pairs is, holds for merges listed in the order in which they were learned; other files are refused.

Tokens lie end to end in one array of bytes, and an array of offsets gives their places: ids are decoded by
gathering.  Null text is empty; special tokens of the file inside texts are tokens, or plain text if asked;
texts are encoded whole, whatever their length; a null doc_id stays null, repeated rows are each encoded, an
empty table gives no rows, and columns but doc_id and text are never read.  Ties between equal pairs go to the left.
"""

from __future__ import annotations

import gc
import hashlib
import json
import re
from collections import deque
from collections.abc import Iterable, Iterator
from functools import lru_cache
from struct import pack

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame

from .common import hold, texts
from .tokens import WORDS, byte_letters

WORDS_KEPT, PAIRS_KEPT, MOVES_KEPT = 250_000, 600_000, 600_000  # what a worker remembers; forgetting costs time alone
BATCH = 1 << 20  # code points that are looked at together
FAR = re.compile("[\U00010000-\U0010ffff]")


@lru_cache(1)
def near_classes() -> tuple[str, str, str]:
    """Letters, numbers and white space below code point 65536, for the plainer engine, which has tables for them."""
    every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x10000)]))
    return tuple("".join(re.escape(r[0]) + (f"-{re.escape(r[-1])}" if len(r) > 1 else "") for r in regex.findall(rf"{c}+", every)) for c in (r"\p{L}", r"\p{N}", r"\s"))  # type: ignore[return-value]


def near_words() -> re.Pattern:
    """The pattern of words for texts without code points from 65536 on."""
    a, n, s = near_classes()
    return re.compile(f"'s|'t|'re|'ve|'m|'ll|'d| ?[{a}]+| ?[{n}]+| ?[^{s}{a}{n}]+|[{s}]+(?![^{s}])|[{s}]+")


class LongestMatch:
    """Aho-Corasick automaton over bytes: the longest pattern that ends at each place."""

    def __init__(self, patterns: dict[bytes, int]):
        self.goto: dict[int, int] = {}
        said = [-1]
        for p, name in patterns.items():
            at = 0
            for c in p:
                k = at << 8 | c
                if (to := self.goto.get(k)) is None:
                    to = self.goto[k] = len(said)
                    said.append(-1)
                at = to
            said[at] = name
        children: list[list[tuple[int, int]]] = [[] for _ in said]
        for k, to in self.goto.items():
            children[k >> 8].append((k & 255, to))
        self.fail, self.said = [0] * len(said), said
        wait = deque(to for _, to in children[0])
        while wait:
            at = wait.popleft()
            if said[at] < 0:
                said[at] = said[self.fail[at]]
            for c, to in children[at]:
                self.fail[to] = self.move(self.fail[at], c)
                wait.append(to)
        self.moves: dict[int, int] = {}

    def move(self, at: int, c: int) -> int:
        while (to := self.goto.get(at << 8 | c)) is None:
            if not at:
                return 0
            at = self.fail[at]
        return to

    def read(self, data: bytes) -> list[int]:
        moves, said, at, out = self.moves, self.said, 0, []
        for c in data:
            k = at << 8 | c
            to = moves.get(k)
            if to is None:
                to = moves[k] = self.move(at, c)
            at = to
            out.append(said[at])
        return out


class ByteLevel:
    """A file's tokens and merges; files that are no plain byte-level BPE in the order of learning are refused."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, pre, more = spec["model"], spec.get("pre_tokenizer") or {}, spec.get("added_tokens", [])
        if model.get("type", "BPE") != "BPE" or spec.get("normalizer") or pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or not pre.get("use_regex", True) or any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges")):
            raise ValueError(f"{path} is no plain byte-level BPE")
        if any(x.get(k) for x in more for k in ("lstrip", "rstrip", "single_word")):
            raise ValueError("added tokens that take in their surroundings")
        vocab: dict[str, int] = model["vocab"]
        self.added = {x["content"]: x["id"] for x in more}
        self.size = size = max([*vocab.values(), *self.added.values()]) + 1
        byte_of = {c: b for b, c in byte_letters().items()}
        if not byte_of.keys() <= vocab.keys():
            raise ValueError("a byte has no token")
        self.single = [vocab[c] for c in byte_of]
        self.data = [b""] * size
        for t, i in vocab.items():
            self.data[i] = bytes(byte_of[c] for c in t) if all(c in byte_of for c in t) else t.encode("utf-8")
        for t, i in self.added.items():
            self.data[i] = t.encode("utf-8")
        self.length = [len(x) for x in self.data]
        self.left, self.right, self.rank = [-1] * size, [-1] * size, [-1] * size
        self.merged: dict[int, int] = {}
        for r, pair in enumerate(model["merges"]):
            x, y = pair.split(" ") if isinstance(pair, str) else pair
            a, b, t = vocab[x], vocab[y], vocab[x + y]
            if self.rank[t] >= 0 or max(self.rank[a], self.rank[b]) >= r or any(self.rank[z] < 0 and self.length[z] > 1 for z in (a, b)):
                raise ValueError("merges are not in the order in which they were learned")
            self.left[t], self.right[t], self.rank[t] = a, b, r
            self.merged[a * size + b] = r


class Encoder(ByteLevel):
    def __init__(self, path: str, special: bool = True):
        super().__init__(path)
        size = self.size
        self.special = self.added if special else {}
        self.split = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.offsets = np.cumsum([0, *self.length])
        self.blob = np.frombuffer(b"".join(self.data), np.uint8)
        self.stands: dict[int, bool] = {}
        own = self.single + [t for t in range(size) if self.rank[t] >= 0 and self.compatible(self.left[t], self.right[t], self.rank[t])]
        self.match = LongestMatch({self.data[t][::-1]: t for t in own})
        by_data = {self.data[t]: t for t in own}
        self.shorter = [-1] * size  # the longest token that a token starts with
        for t in own:
            d = self.data[t]
            self.shorter[t] = next((by_data[d[:i]] for i in range(len(d) - 1, 0, -1) if d[:i] in by_data), -1)
        self.known: dict[str, bytes] = {}
        self.near = near_words()

    def compatible(self, a: int, b: int, before: int = 1 << 60) -> bool:
        """Whether a and b stay apart: undoes their merges, last one first, and looks for an earlier one across the border."""
        rank, size = self.rank, self.size
        while True:
            if self.merged.get(a * size + b, before) < before:
                return False
            if rank[a] > rank[b]:
                before, a = rank[a], self.right[a]
            elif rank[b] >= 0:
                before, b = rank[b] + 1, self.left[b]  # of equal merges the left one comes first
            else:
                return True

    def words(self, words: list[str]) -> list[list[int]]:
        """Ids of each word, which is merged by itself."""
        size, length, shorter, stands, read = self.size, self.length, self.shorter, self.stands, self.match.read
        out = []
        for w in words:
            data = w.encode("utf-8")
            best = read(data[::-1])  # from the end
            last, at, ids, dead = len(best) - 1, 0, [], set()
            t = best[last] if best else -1
            while at <= last:
                after = at + length[t]
                fits = after not in dead
                if fits and ids:
                    pair = ids[-1] * size + t
                    fits = stands.get(pair)
                    if fits is None:
                        fits = stands[pair] = self.compatible(ids[-1], t)
                if fits:
                    ids.append(t)
                    at = after
                    if at <= last:
                        t = best[last - at]
                elif shorter[t] >= 0:
                    t = shorter[t]
                else:
                    dead.add(at)
                    t = ids.pop()
                    at -= length[t]
            out.append(ids)
        if len(self.match.moves) > MOVES_KEPT:
            self.match.moves.clear()
        if len(stands) > PAIRS_KEPT:
            stands.clear()
        return out

    def split_words(self, text: str) -> list[str]:
        return WORDS.findall(text) if not text.isascii() and FAR.search(text) else self.near.findall(text)

    def encode(self, batch: list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        known, found = self.known, []
        if len(known) > WORDS_KEPT:
            known.clear()
        for text in batch:
            if self.split and any(s in text for s in self.special):
                pieces = self.split.split(text)
                found.append([w for i, p in enumerate(pieces) for w in ([p] if i % 2 else self.split_words(p))])
            else:
                found.append(self.split_words(text))
        new = set().union(*found).difference(known)
        for s in new & self.special.keys():  # no word is split off that looks like one: what splits comes first
            known[s] = pack("<I", self.special[s])
            new.remove(s)
        todo = list(new)
        for w, ids in zip(todo, self.words(todo), strict=True):
            known[w] = pack(f"<{len(ids)}I", *ids)
        return [b"".join(map(known.__getitem__, ws)) for ws in found]

    def decode(self, ids: np.ndarray) -> bytes:
        first = self.offsets[ids]
        width = self.offsets[ids + 1] - first
        ends = np.cumsum(width)
        return self.blob[np.repeat(first - ends + width, width) + np.arange(ends[-1] if len(ends) else 0)].tobytes()


def parts(texts: Iterable[str]) -> Iterator[list[str]]:
    """Lists of texts that are not much longer together than BATCH, unless one is."""
    some, n = [], 0
    for t in texts:
        some.append(t)
        n += len(t)
        if n >= BATCH:
            yield some
            some, n = [], 0
    if some:
        yield some


@lru_cache(2)
def encoder(path: str, special: bool = True) -> Encoder:
    return Encoder(path, special)


def encode_documents(docs: DataFrame, path: str, special: bool = True, digests: bool = True) -> DataFrame:
    """doc_id, n_tokens, and either digests of the ids and of the decoded text, or ids and decoded text."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hold("backtrack", encoder.cache_clear)
        e = encoder(path, special)
        gc.freeze()
        for b in batches:
            out = []
            for some in parts(b.text):
                for said in e.encode(some):
                    ids = np.frombuffer(said, "<u4").astype(np.int64)
                    text = e.decode(ids).decode("utf-8", "replace")
                    out.append((len(ids), hashlib.sha256(said).hexdigest(), hashlib.sha256(text.encode("utf-8")).hexdigest()) if digests else (len(ids), ids, text))
            cols = ("ids_sha256", "decoded_sha256") if digests else ("ids", "decoded")
            yield pd.DataFrame({"doc_id": b.doc_id.astype("Int64").to_numpy(), "n_tokens": [x[0] for x in out], cols[0]: [x[1] for x in out], cols[1]: [x[2] for x in out]})

    tail = "ids_sha256 string, decoded_sha256 string" if digests else "ids array<long>, decoded string"
    return texts(docs).mapInPandas(run, f"doc_id long, n_tokens long, {tail}")
