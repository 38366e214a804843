"""Substring dedup by suffix automata of reference shards: exact removal of repeated spans of words.

A span of `length` or more words that occurs more than once goes.  Reference shards hold the
text that may repeat, a suffix automaton of each shard knows how often every run of its words
occurs, and texts are streamed through it for matching statistics: at each word the longest run
ending there that occurs twice or more.  Runs of `length` or more are the spans that go.

So that no text need meet every shard, text is dealt to shards by content:

1. Every window of `length` words names its smallest gram of `length // 2 + 1` words, the
   leftmost if equal, so equal windows name equal grams.  Consecutive windows of one name make a
   stretch, about one for ten words.  Grams are counted with a map-side combine; stretches of
   grams found once go.
2. Equal stretches of one gram become one reference with a count.  The shards are dealt by gram,
   so all places of a window are in one shard, and counts there are counts in the corpus.
3. Each shard's automaton is made in the task that its references are sent to, and those are
   streamed through it; the spans found come back to every text that has the stretch.
4. A gram with more than HOT different stretches (a common passage in ever other surroundings)
   would outgrow a shard.  Its windows are dealt singly, by hash: the exact way for the rest.

Counts are of every row, so windows are judged on the input and a text's own repeats count.
Texts, stretches and windows are known by 128 bits of hash, words by 64.

Automata are not broadcast: together they grow with the repeated text, which has no bound.  They
go to tasks by shuffle, in shards of about SHARD references.

Null text has no words.  A repeated row is one more document with the same words.  Rows with
a null doc_id take part.  Texts shorter than a window lose nothing; very long ones are read in
whole.  An empty table gives no rows; other columns are never read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, of_key, parts, sieve, texts

LENGTH = 35
BASES = (0x9E3779B97F4A7C15, 0xD1B54A32D192ED03)
ROWS = 50_000  # of an emitted frame, about
SHARD, HOT = 800, 2_000  # references of a shard, about; different stretches of a gram that a shard takes
LONG = 64  # bytes of a word from which its letters' polynomial could be made to collide
BLOCK, SLAB = 250_000, 50_000  # bytes, words
SPACE = np.isin(np.arange(256), list(b" \t\n\x0b\x0c\r"))
LETTERS = np.array([[xxhash.xxh3_64_intdigest(bytes([i, k])) for i in range(256)] for k in range(2)], np.uint64)


def split_words(text: str) -> list[str]:
    return [w.decode("utf-8") for w in text.encode("utf-8").split()]  # bytes: ASCII white space alone


@lru_cache(16)
def _powers(base: int, size: int) -> np.ndarray:
    out = np.full(size, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


class Rolling:
    """Polynomial hashes of any runs of the numbers."""

    def __init__(self, h: np.ndarray, base: int):
        n = len(h)
        size = 1 << max(10, n.bit_length())
        self.sums = np.zeros(n + 1, np.uint64)
        np.add.accumulate(h * _powers(base, size)[:n], out=self.sums[1:])
        self.back = _powers(pow(base, -1, 2**64), size)

    def of(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        x = (self.sums[ends] - self.sums[starts]) * self.back[starts]
        return _mix(x + (ends - starts).astype(np.uint64) * np.uint64(0x94D049BB133111EB))


class Words:
    """The words of some texts, end to end, and their hashes."""

    def __init__(self, held: list[bytes]):
        self.data = np.frombuffer(b"\n".join(held), np.uint8)
        edge = np.diff(np.concatenate([[1], SPACE[self.data], [1]]).astype(np.int8))
        self.starts, self.ends = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
        sizes = np.array([len(x) + 1 for x in held], np.int64)
        self.first = np.searchsorted(self.starts, np.r_[0, np.cumsum(sizes)])  # word of each text, and an end

    def hashes(self, k: int) -> np.ndarray:
        out = np.zeros(len(self.starts), np.uint64)
        for i in range(0, len(out), SLAB):
            s, e = self.starts[i : i + SLAB], self.ends[i : i + SLAB]
            out[i : i + SLAB] = Rolling(LETTERS[k][self.data[s[0] : e[-1]]], BASES[k]).of(s - s[0], e - s[0])
        for i in np.flatnonzero(self.ends - self.starts >= LONG).tolist():
            out[i] = xxhash.xxh3_64_intdigest(self.data[self.starts[i] : self.ends[i]].tobytes(), seed=k)
        return out


class Automaton:
    """Suffix automaton of many runs of words, each with a weight."""

    def __init__(self) -> None:
        self.next: list[dict[int, int]] = [{}]
        self.size, self.link, self.weight = [0], [-1], [0]
        self.twice: list[int] = []

    def _state(self, after: dict[int, int], size: int, link: int) -> int:
        self.next.append(after)
        self.size.append(size)
        self.link.append(link)
        self.weight.append(0)
        return len(self.size) - 1

    def _split(self, p: int, w: int, q: int) -> int:
        """A state for the shorter runs of q, those that p reaches."""
        half = self._state(self.next[q].copy(), self.size[p] + 1, self.link[q])
        self.link[q] = half
        while p >= 0 and self.next[p].get(w) == q:
            self.next[p][w] = half
            p = self.link[p]
        return half

    def add(self, words: list[int], weight: int) -> None:
        follow, size, link, v = self.next, self.size, self.link, 0
        for w in words:
            q = follow[v].get(w)
            if q is not None:
                v = q if size[q] == size[v] + 1 else self._split(v, w, q)
            else:
                new, p = self._state({}, size[v] + 1, 0), v
                while p >= 0 and w not in follow[p]:
                    follow[p][w] = new
                    p = link[p]
                if p >= 0:
                    q = follow[p][w]
                    link[new] = q if size[q] == size[p] + 1 else self._split(p, w, q)
                v = new
            self.weight[v] += weight

    def close(self) -> None:
        """Sums the weights up to shorter runs; then names of each state the longest run within it found twice."""
        order = np.argsort(self.size, kind="stable").tolist()
        for v in reversed(order[1:]):
            self.weight[self.link[v]] += self.weight[v]
        self.twice = [0] * len(order)
        for v in order[1:]:
            self.twice[v] = v if self.weight[v] > 1 else self.twice[self.link[v]]

    def statistics(self, words: list[int]) -> list[int]:
        """After each word: the length of the longest run ending there that was added twice or more."""
        follow, size, link, twice, out, v, n = self.next, self.size, self.link, self.twice, [], 0, 0
        for w in words:
            q = follow[v].get(w)
            while q is None and v:
                v = link[v]
                n = size[v]
                q = follow[v].get(w)
            if q is not None:
                v, n = q, n + 1
            t = twice[v]
            out.append(n if t == v else size[t])
        return out


def spans(statistics: list[int], length: int) -> list[tuple[int, int]]:
    """Maximal runs of words (first, end) that matches of `length` or more cover."""
    out: list[tuple[int, int]] = []
    for i, n in enumerate(statistics, 1):
        if n >= length:
            lo = i - n
            while out and out[-1][1] >= lo:
                lo = min(lo, out.pop()[0])
            out.append((lo, i))
    return out


def stretches(held: list[bytes], length: int, whole: bool = True) -> dict[str, np.ndarray]:
    """Of each stretch: gram hash h and, if whole, hash of its words c, its text's place, first and last window."""
    words, gram = Words(held), length // 2 + 1
    n = len(words.starts)
    if n < length:
        at = np.zeros(0, np.int64)
        return {"h": at} | ({"c": at, "text": at, "lo": at, "hi": at} if whole else {})
    at = np.arange(n - gram + 1)
    a = Rolling(words.hashes(0), BASES[0]).of(at, at + gram)
    named = np.lib.stride_tricks.sliding_window_view(a, length - gram + 1).argmin(axis=1)
    named += np.arange(len(named))
    text = np.repeat(np.arange(len(held)), np.diff(words.first))
    inside = text[: n - length + 1] == text[length - 1 :]
    fresh = np.r_[True, (named[1:] != named[:-1]) | (text[1 : len(named)] != text[: len(named) - 1])]
    lo = np.flatnonzero(fresh & inside)
    out = {"h": a[named[lo]].view(np.int64)}
    if whole:
        last = np.flatnonzero(inside & np.r_[fresh[1:] | ~inside[1:], True])
        c = Rolling(words.hashes(1), BASES[1]).of(lo, last + length)
        start = words.first[text[lo]]
        out |= {"c": c.view(np.int64), "text": text[lo], "lo": (lo - start).astype(np.int32), "hi": (last - start).astype(np.int32)}
    return out


def blocks(texts: list[str]) -> Iterator[tuple[int, list[bytes]]]:
    """Whole texts in blocks of about BLOCK bytes, each with the place of its first."""
    held, size, at = [], 0, 0
    for i, t in enumerate(texts):
        held.append(t.encode())
        size += len(held[-1])
        if size >= BLOCK or i + 1 == len(texts):
            yield at, held
            held, size, at = [], 0, i + 1


def _frames(parts: Iterator[dict[str, np.ndarray]], size: str) -> Iterator[pd.DataFrame]:
    """Joins the parts to frames of about ROWS rows; numbers spread over the length of `size`."""
    held, n = [], 0

    def frame() -> pd.DataFrame:
        wide = [[np.broadcast_to(v, len(p[size])) for v in p.values()] for p in held]
        return pd.DataFrame({k: np.concatenate([w[i] for w in wide]) for i, k in enumerate(held[0])})

    for p in parts:
        if len(p[size]):
            held.append(p)
            n += len(p[size])
        if n >= ROWS:
            yield frame()
            held, n = [], 0
    if held:
        yield frame()


def _hashed(docs: DataFrame) -> DataFrame:
    m = F.md5("text")
    num = lambda a: F.conv(F.substring(m, a, 16), 16, -10).cast("long")
    return texts(docs).withColumn("t1", num(1)).withColumn("t2", num(17))


def found_stretches(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """t1, t2 (hash of a text), doc_id, and its stretches (h, c, lo, hi) of repeated grams, one in a row."""

    def name(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        yield from _frames((stretches(held, length, whole=False) for b in batches for _, held in blocks(b.text.tolist())), "h")

    def find(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def each():
            for b in batches:
                t1, t2, doc = b.t1.to_numpy(), b.t2.to_numpy(), b.doc_id.to_numpy()
                for at, held in blocks(b.text.tolist()):
                    x = stretches(held, length)
                    some = known.value.may_hold(x["h"])  # most stretches of grams found once stop here
                    x = {k: v[some] for k, v in x.items()}
                    text = x.pop("text") + at
                    yield x | {"t1": t1[text], "t2": t2[text], "doc_id": doc[text]}

        yield from _frames(each(), "h")

    grams = cut(texts(docs).select("text").mapInPandas(name, "h long").groupBy("h").agg(F.count("*").alias("n")).where("n > 1").select("h"))
    known = sieve(grams, "h", grams.count())
    hashed = _hashed(docs).withColumn("doc_id", F.coalesce("doc_id", F.lit(0)))
    found = hashed.mapInPandas(find, "h long, c long, lo int, hi int, t1 long, t2 long, doc_id long")
    return cut(of_key(found, grams, "h", "left_semi"))


def _sieve_of_texts(keys: DataFrame):
    some = cut(keys.select("t1", "t2").distinct())
    return sieve(some, "t1", some.count())


def _among(docs: DataFrame, known) -> DataFrame:
    """doc_id, text, t1, t2 of the texts that may be among the keys of a sieve: the others need no shuffle."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            b = b[known.value.may_hold(b.t1.to_numpy(np.int64))]
            if len(b):
                yield pd.DataFrame({"doc_id": b.doc_id.astype("Int64").to_numpy(), "text": pd.Series(b.text.tolist(), dtype=object), "t1": b.t1.to_numpy(), "t2": b.t2.to_numpy()})

    return _hashed(docs).mapInPandas(run, "doc_id long, text string, t1 long, t2 long")


def _with_words(docs: DataFrame, kinds: DataFrame, length: int) -> DataFrame:
    """kinds with words, the 64-bit hashes of each one's words, read from the row that stands for it."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            held: list[tuple] = []
            for text, refs in zip(b.text, b.refs, strict=True):
                w = Words([text.encode()]).hashes(1).view(np.int64)
                held += [(r["h"], r["c"], r["n"], w[r["lo"] : r["hi"] + length]) for r in refs]
                if len(held) * length > ROWS * 20:
                    yield pd.DataFrame(held, columns=["h", "c", "n", "words"])
                    held = []
            if held:
                yield pd.DataFrame(held, columns=["h", "c", "n", "words"])

    where = kinds.groupBy("one.t1", "one.t2", "one.doc_id").agg(F.collect_list(F.struct("h", "c", "n", "one.lo", "one.hi")).alias("refs"))
    where = cut(where)
    rows = _among(docs, _sieve_of_texts(where)).withColumn("doc_id", F.coalesce("doc_id", F.lit(0))).join(where, ["t1", "t2", "doc_id"])
    return rows.select("text", "refs").mapInPandas(read, "h long, c long, n long, words array<long>")


def _judge(batches: Iterator[pd.DataFrame], length: int) -> Iterator[pd.DataFrame]:
    """Rows sorted by shard, h, c: the spans of each reference that its shard holds twice or more."""
    held, rest = [], None

    def close(rows: list[pd.DataFrame]) -> list[pd.DataFrame]:
        one = pd.concat(rows).drop_duplicates(["h", "c"])  # a repeated row reads its stretches again
        machine, words = Automaton(), [w.tolist() for w in one.words]
        for w, n in zip(words, one.n.tolist(), strict=True):
            machine.add(w, n)
        machine.close()
        out = [(h, c, [{"a": a, "b": b} for a, b in x]) for h, c, x in ((h, c, spans(machine.statistics(w), length)) for h, c, w in zip(one.h, one.c, words, strict=True)) if x]
        return [pd.DataFrame(out, columns=["h", "c", "gone"])] if out else []

    for b in batches:
        shard = b.shard.to_numpy()
        for lo, hi in zip([0, *(np.flatnonzero(shard[1:] != shard[:-1]) + 1)], [*(np.flatnonzero(shard[1:] != shard[:-1]) + 1), len(b)], strict=True):
            if held and rest != shard[lo]:
                yield from close(held)
                held = []
            rest = shard[lo]
            held.append(b.iloc[lo:hi])
    if held:
        yield from close(held)


def repeated_spans(docs: DataFrame, found: DataFrame, length: int = LENGTH) -> DataFrame:
    """t1, t2 and spots: the spans (a, b) of words of each text that occur more than once."""
    rep = F.min(F.struct("t1", "t2", "doc_id", "lo", "hi")).alias("one")
    kinds = cut(found.groupBy("h", "c").agg(F.count("*").alias("n"), rep))
    hot = kinds.groupBy("h").agg(F.count("*").alias("kinds")).where(F.col("kinds") > HOT).select("h")
    hot = cut(hot)
    cold = of_key(kinds, hot, "h", "left_anti")
    shards = max(1, kinds.count() // SHARD)
    dealt = _with_words(docs, cold, length).withColumn("shard", F.pmod(F.xxhash64("h"), F.lit(shards)))
    gone = dealt.repartition(parts(docs.sparkSession), "shard").sortWithinPartitions("shard", "h", "c").mapInPandas(lambda it: _judge(it, length), "h long, c long, gone array<struct<a int, b int>>")
    spots = found.join(cut(gone), ["h", "c"]).select("t1", "t2", F.explode("gone").alias("x"), "lo").select("t1", "t2", F.struct((F.col("lo") + F.col("x.a")).alias("a"), (F.col("lo") + F.col("x.b")).alias("b")).alias("x"))
    if hot.limit(1).count():
        spots = spots.union(repeated_windows(docs, of_key(found, hot, "h", "left_semi"), length))
    return spots.groupBy("t1", "t2").agg(F.collect_set("x").alias("spots"))


def repeated_windows(docs: DataFrame, found: DataFrame, length: int = LENGTH) -> DataFrame:
    """t1, t2, x: the windows (a, b) that also start elsewhere, each looked at alone."""

    def windows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def each():
            for b in batches:
                for t1, t2, text, some in zip(b.t1, b.t2, b.text, b.some, strict=True):
                    r = Rolling(Words([text.encode()]).hashes(1), BASES[1])
                    lo, hi, h = (np.array([x[k] for x in some]) for k in ("lo", "hi", "h"))
                    n = hi - lo + 1
                    s = np.repeat(lo - np.r_[0, np.cumsum(n)[:-1]], n) + np.arange(n.sum())
                    yield {"h": np.repeat(h, n), "w": r.of(s, s + length).view(np.int64), "t1": np.int64(t1), "t2": np.int64(t2), "a": s.astype(np.int32)}

        yield from _frames(each(), "h")

    some = found.groupBy("t1", "t2").agg(F.collect_set(F.struct("lo", "hi", "h")).alias("some"))
    some = cut(some)
    made = cut(_among(docs, _sieve_of_texts(some)).drop("doc_id").join(some, ["t1", "t2"]).mapInPandas(windows, "h long, w long, t1 long, t2 long, a int"))
    twice = made.groupBy("h", "w").agg(F.count("*").alias("n")).where("n > 1").select("h", "w")
    return of_key(made, twice, "w", "left_semi", "h").select("t1", "t2", F.struct("a", (F.col("a") + length).alias("b")).alias("x"))


def drop_repeats(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """doc_id, n_words, n_removed, kept (words joined by one space)."""

    spots = cut(repeated_spans(docs, found_stretches(docs, length), length))
    known = _sieve_of_texts(spots)

    def strip(batches: Iterator[pd.DataFrame], whole: bool) -> Iterator[pd.DataFrame]:
        for b in batches:
            if whole:
                b = b[~known.value.may_hold(b.t1.to_numpy(np.int64))]
            if not len(b):  # a frame without rows has no Arrow type
                continue
            out = []
            for text, gone in zip(b.text, [None] * len(b) if whole else b.spots, strict=True):
                words = text.encode().split()
                n = len(words)
                if gone is not None and len(gone):
                    edge = np.bincount([x["a"] for x in gone], minlength=n + 1) - np.bincount([x["b"] for x in gone], minlength=n + 1)
                    words = [words[i] for i in np.flatnonzero(np.cumsum(edge)[:n] == 0).tolist()]
                out.append((n, n - len(words), b" ".join(words).decode()))
            yield pd.DataFrame({"doc_id": b.doc_id.astype("Int64").to_numpy(), "n_words": [x[0] for x in out], "n_removed": [x[1] for x in out], "kept": [x[2] for x in out]})

    kind = "doc_id long, n_words long, n_removed long, kept string"
    joined = _among(docs, known).join(spots, ["t1", "t2"], "left").select("doc_id", "text", "spots")
    whole = _hashed(docs).drop("t2").mapInPandas(lambda it: strip(it, True), kind)
    return joined.mapInPandas(lambda it: strip(it, False), kind).union(whole)
