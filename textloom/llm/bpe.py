"""Byte-level BPE by a lazily determinised transducer, and a streaming decoder.

After any prefix of a piece, each earlier place that a longer token may still span is live, and
every prefix has one valid tokenisation, known by its last token.  A state is, for each live place,
its node in the trie of tokens and the last token before it; reading a byte finds the token that ends
there and fits its predecessor, and emits it as the last token of the prefix read so far.  The tokens
of a piece are read back from its end, each at the place where the next one begins.  States and
arcs are made when first met.

Of the tokens that end at a place exactly one fits, so that the shortest, a byte, needs no proof when no other does.

Two tokens may stand side by side if, when their own merges are replayed together by rank, no
merge across their border comes first.

Null text is empty and gives no ids; repeated rows, ties and empty tables need nothing special;
a null doc_id stays null; other columns are never read; texts of any length are encoded whole,
piece by piece.
"""

from __future__ import annotations

import base64
import gc
import hashlib
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import chain, islice

import pandas as pd
import regex
from pyspark.sql import DataFrame

from .backtrack import FAR as FAR_LETTERS
from .backtrack import near_words
from .common import hold, texts
from .tokens import WORDS

ARCS, PIECES, FITS, FAR = 500_000, 250_000, 200_000, 1 << 60  # arcs, (twice) pieces and neighbours that a worker remembers; no rank


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


class Utf8:
    """Reads bytes as they come: characters that a chunk leaves open are carried to the next."""

    def __init__(self) -> None:
        self.carry = b""

    def feed(self, data: bytes, final: bool = False) -> str:
        data, self.carry = self.carry + data, b""
        if not final:
            for back in range(1, min(3, len(data)) + 1):
                lead = data[-back]
                if lead >= 0xC0:  # opens a character of 2 to 4 bytes
                    if back < 2 + (lead >= 0xE0) + (lead >= 0xF0):
                        data, self.carry = data[:-back], data[-back:]
                    break
                if lead < 0x80:
                    break
        return data.decode("utf-8", "replace")


class Pieces(dict):
    """Ids of pieces as they are met; the last PIECES before these are kept beside them."""

    def __init__(self, fst: Transducer):
        self.fst, self.older = fst, {}

    def __missing__(self, piece: str) -> tuple[int, ...]:
        ids = self.older.get(piece)
        if ids is None:
            data = piece.encode("utf-8")
            t = self.fst.ranks.get(data)  # a piece that is a token is that token
            ids = (t,) if t is not None else tuple(self.fst.run(data))
        if len(self) >= PIECES:
            self.older = self.copy()
            self.clear()
        self[piece] = ids
        return ids


class Transducer:
    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks, self.pattern = ranks, regex.compile(pattern)
        self.near = near_words() if pattern == WORDS.pattern else None
        self.bytes_of = {v: k for k, v in ranks.items()}
        self.size = {v: len(k) for k, v in ranks.items()}
        self.trie: dict[int, int] = {}  # by node * 256 + byte
        self.token_at: dict[int, int] = {}
        self.inner: set[int] = set()
        for token, rank in ranks.items():
            node = 0
            for byte in token:
                self.inner.add(node)
                node = self.trie.setdefault(node << 8 | byte, len(self.trie) + 1)
            self.token_at[node] = rank
        self.replays: dict[int, tuple | None] = {}
        self.fits: dict[int, bool] = {}
        self.pieces = Pieces(self)
        self.reset()

    def reset(self) -> None:
        self.arcs: dict[int, int] = {}  # by state * 256 + byte
        self.states: list[tuple[int, ...]] = [(0, -1)]  # node and last token of each live place; those of the newest place come last
        self.last = [-1]
        self.number = {self.states[0]: 0}

    def replay(self, t: int) -> tuple | None:
        """A token's own merges in order: ranks, and the first and last part after each; None if they make another."""
        if t in self.replays:
            return self.replays[t]
        data = self.bytes_of[t]
        part = [data[i : i + 1] for i in range(len(data))]
        ranks, firsts, lasts = [], [part[0]], [part[-1]]
        while len(part) > 1:
            rank = [self.ranks.get(x + y, FAR) for x, y in zip(part, part[1:], strict=False)]
            low = min(rank)
            if low == FAR:
                break
            i = rank.index(low)
            part[i : i + 2] = [part[i] + part[i + 1]]
            ranks.append(low)
            firsts.append(part[0])
            lasts.append(part[-1])
        got = self.replays[t] = ((*ranks, FAR), tuple(firsts), tuple(lasts)) if len(part) == 1 else None
        return got

    def fit(self, a: int, b: int) -> bool:
        """Whether b may follow a, or begin a piece (a is -1)."""
        right = self.replay(b)
        if right is None or a < 0:
            return right is not None
        ok = self.fits.get(a << 32 | b)
        if ok is not None:
            return ok
        ranks_a, _, lasts = self.replay(a)
        ranks_b, firsts, _ = right
        i = j = 0
        while True:
            across, low_a, low_b = self.ranks.get(lasts[i] + firsts[j], FAR), ranks_a[i], ranks_b[j]
            if across < low_a and across <= low_b:  # of equal ranks the leftmost pair is merged first
                ok = False
                break
            if low_a == low_b == FAR:
                ok = True
                break
            if low_a <= low_b:
                i += 1
            else:
                j += 1
        if len(self.fits) >= FITS:
            self.fits.clear()
        self.fits[a << 32 | b] = ok
        return ok

    def step(self, arc: int) -> int:
        """Makes an arc."""
        byte, trie, inner, token_at = arc & 255, self.trie, self.inner, self.token_at
        new, ends = [], []
        at = iter(self.states[arc >> 8])
        for node, last in zip(at, at, strict=True):
            node = trie.get(node << 8 | byte)
            if node is None:
                continue
            t = token_at.get(node)
            if t is not None:
                ends.append((last, t))
            if node in inner:
                new += (node, last)
        found = next((t for last, t in ends if self.size[t] == 1 or self.fit(last, t)), None)
        if found is None:
            raise ValueError("the ranks lack a byte")
        key = (*new, 0, found)
        number = self.number.get(key)
        if number is None:
            number = self.number[key] = len(self.states)
            self.states.append(key)
            self.last.append(found)
        self.arcs[arc] = number
        return number

    def run(self, data: bytes) -> list[int]:
        if len(self.arcs) > ARCS:
            self.reset()
        state, said = 0, []  # said: the last token of every prefix
        for k in range(0, len(data), 0xFFFF):
            if k and len(self.arcs) > ARCS:  # a very long piece: forget arcs, keep the state
                here = self.states[state]
                self.reset()
                state = self.number.setdefault(here, len(self.states))
                if state:
                    self.states.append(here)
                    self.last.append(here[-1])
            known, path = self.arcs.get, []
            for byte in data[k : k + 0xFFFF]:
                arc = state << 8 | byte
                state = known(arc)
                if state is None:
                    state = self.step(arc)
                path.append(state)
            said += map(self.last.__getitem__, path)
        out, size, end = [], self.size, len(said)
        while end:
            t = said[end - 1]
            out.append(t)
            end -= size[t]
        out.reverse()
        return out

    def split(self, text: str) -> list[str]:
        return self.pattern.findall(text) if self.near is None or not text.isascii() and FAR_LETTERS.search(text) else self.near.findall(text)

    def encode(self, text: str) -> list[int]:
        return list(chain.from_iterable(map(self.pieces.__getitem__, self.split(text))))

    def decode(self, ids: Iterable[int]) -> Iterator[str]:
        """Text as it becomes whole: the machine's state carries characters that tokens cut."""
        machine, ids = Utf8(), iter(ids)
        while some := b"".join(map(self.bytes_of.__getitem__, islice(ids, 4096))):
            yield machine.feed(some)
        yield machine.feed(b"", final=True)


@lru_cache(2)
def _transducer(path: str, pattern: str) -> Transducer:
    return Transducer(load_ranks(path), pattern)


def encode_documents(docs: DataFrame, path: str, pattern: str, digests: bool = True) -> DataFrame:
    """doc_id, n_tokens, and either digests of the ids and of the decoded text, or ids and decoded text."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hold("bpe", _transducer.cache_clear)
        fst = _transducer(path, pattern)
        names = [str(i) for i in range(max(fst.bytes_of) + 1)] if digests else []
        for b in batches:
            gc.freeze()  # states and pieces hold no cycles: do not scan them again
            out = []
            for text in b.text:
                ids = fst.encode(text)
                if digests:
                    h = hashlib.sha256()
                    for s in fst.decode(ids):
                        h.update(s.encode("utf-8"))
                    out.append((len(ids), hashlib.sha256(",".join(map(names.__getitem__, ids)).encode()).hexdigest(), h.hexdigest()))
                else:
                    out.append((len(ids), ids, "".join(fst.decode(ids))))
            cols = ("ids_sha256", "decoded_sha256") if digests else ("ids", "decoded")
            yield pd.DataFrame({"doc_id": b.doc_id.astype("Int64").to_numpy(), "n_tokens": [x[0] for x in out], cols[0]: [x[1] for x in out], cols[1]: [x[2] for x in out]})

    tail = "ids_sha256 string, decoded_sha256 string" if digests else "ids array<int>, decoded string"
    return texts(docs).mapInPandas(run, f"doc_id long, n_tokens long, {tail}")
