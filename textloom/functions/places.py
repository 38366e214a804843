"""Places of quotes, anchors, words and headings in texts: each text is mapped once, whatever is asked of it.

A text's collapsed form has one space for each run of white space.  `Collapsed` keeps where runs were shortened and how
many characters went before: a place in the collapsed form becomes one in the text by a binary search, and
one in its bytes by the ranks of the bytes that begin characters.  So a quote costs its search alone.
Columns come as Arrow batches; results are structs by Arrow too.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

SPACES = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"
_SPACE = re.compile(f"[{re.escape(SPACES)}]+")
_LONG = re.compile(f"[{re.escape(SPACES)}]{{2,}}")
# Chapter words of several languages, after a line's signs.
CHAPTERS = "chapter|act|book|part|canto|глава|розділ|действие|часть|scene"
_HEADING = re.compile(rf"(?:^|\n)[\t-\r ]*(?:#+[\t-\r ]*)?(?i:{CHAPTERS})(?:[^\w\n\r][^\n\r]*)?(?=[\n\r]|$)")


class Collapsed:
    def __init__(self, text: str):
        self.text, self.flat = text, _SPACE.sub(" ", text)
        ends, gone = [0], [0]
        for m in _LONG.finditer(text):
            gone.append(gone[-1] + m.end() - m.start() - 1)
            ends.append(m.end() - gone[-1])
        self.ends, self.gone = ends, gone  # from ends[i] on, gone[i] characters are missing
        self._bytes: np.ndarray | None = None

    def place(self, at: int) -> int:
        """The character of the text that one of the collapsed form stands for; of a run of white space the first one."""
        return at + self.gone[bisect_right(self.ends, at) - 1]

    def byte(self, at: int) -> int:
        """Bytes before a character."""
        if self.text.isascii():
            return at
        if self._bytes is None:
            data = np.frombuffer(self.text.encode("utf-8"), np.uint8)
            self._bytes = np.append(np.flatnonzero((data & 0xC0) != 0x80), len(data))
        return int(self._bytes[at])

    def locate(self, quote: str | None) -> dict:
        """error, byte_start, byte_len, alignment of a quote's one place, white space aside."""
        none = {"error": None, "byte_start": None, "byte_len": None, "alignment": None}
        q = _SPACE.sub(" ", (quote or "").strip(SPACES))
        if not q:
            return none | {"error": "empty_quote"}
        p = self.flat.find(q)
        if p < 0:
            return none | {"error": "quote_absent"}
        if self.flat.find(q, p + 1) >= 0:
            return none | {"error": "quote_ambiguous"}
        a, b = self.place(p), self.place(p + len(q) - 1) + 1
        start, end = self.byte(a), self.byte(b)
        return {"error": None, "byte_start": start, "byte_len": end - start, "alignment": "exact" if self.text[a:b] == quote else "whitespace_only"}

    def anchor(self, needle: str | None, most: int) -> int | None:
        """Byte place of an anchor: its own letters if they stand there at most `most` times; else, where they never do, with other white space."""
        q = (needle or "").strip(SPACES)
        if len(q) < 3:
            return None
        times = self.text.count(q)
        if times:
            return self.byte(self.text.find(q)) if times <= most else None
        p = self.flat.find(_SPACE.sub(" ", q))
        return self.byte(self.place(p)) if p >= 0 else None


@lru_cache(1)
def collapsed(text: str) -> Collapsed:
    """Of the last text: rows of one text often follow one another."""
    return Collapsed(text)


LOCATED = pa.struct([("error", pa.string()), ("byte_start", pa.int32()), ("byte_len", pa.int32()), ("alignment", pa.string())])
_LOCATED = "struct<error:string,byte_start:int,byte_len:int,alignment:string>"


def locate_all(text, quotes) -> Column:
    """The array of places (see locate) of an array of quotes in one text."""

    def run(texts: pa.Array, wanted: pa.Array) -> pa.Array:
        out = []
        for t, qs in zip(texts.to_pylist(), wanted.to_pylist(), strict=True):
            c = collapsed(t or "")
            out.append(None if qs is None else [c.locate(q) for q in qs])
        return pa.array(out, pa.list_(LOCATED))

    return F.arrow_udf(run, f"array<{_LOCATED}>")(text, quotes)


def locate(text, quote) -> Column:
    """error, byte_start, byte_len, alignment of a quote's one place in a text, white space aside; a null text holds nothing."""

    def run(texts: pa.Array, quotes: pa.Array) -> pa.Array:
        return pa.array([collapsed(t or "").locate(q) for t, q in zip(texts.to_pylist(), quotes.to_pylist(), strict=True)], LOCATED)

    return F.arrow_udf(run, _LOCATED)(text, quote)


def anchor(text, needle, most: int = 3) -> Column:
    """Byte place of an anchor in a text (see Collapsed.anchor); null where it has none."""

    def run(texts: pa.Array, needles: pa.Array) -> pa.Array:
        return pa.array([collapsed(t or "").anchor(q, most) for t, q in zip(texts.to_pylist(), needles.to_pylist(), strict=True)], pa.int32())

    return F.arrow_udf(run, "int")(text, needle)


@lru_cache(1000)
def _whole(term: str) -> re.Pattern:
    return re.compile(rf"(?<!\w){re.escape(term)}(?!\w)", re.I)


def snippets(text, term, width: int = 350, most: int = 5) -> Column:
    """exact_match, position, context of a whole word's first `most` places, case aside: `width` characters on both sides, white space collapsed.

    The search ends with the last place that is asked for; null where there is none."""

    def of(t: str | None, term: str | None) -> list[dict] | None:
        out = []
        for m in _whole(term).finditer(t) if t and term else ():
            out.append({"exact_match": m[0], "position": m.start(), "context": _SPACE.sub(" ", t[max(0, m.start() - width) : m.end() + width].strip(SPACES))})
            if len(out) == most:
                break
        return out or None

    def run(texts: pa.Array, terms: pa.Array) -> pa.Array:
        return pa.array([of(t, w) for t, w in zip(texts.to_pylist(), terms.to_pylist(), strict=True)], pa.list_(pa.struct([("exact_match", pa.string()), ("position", pa.int32()), ("context", pa.string())])))

    return F.arrow_udf(run, "array<struct<exact_match:string,position:int,context:string>>")(text, term)


def chapters(text) -> Column:
    """title, start, end (characters) of the parts that headings open; null where there are fewer than two."""

    def of(t: str | None) -> list[dict] | None:
        found = list(_HEADING.finditer(t or ""))
        if len(found) < 2:
            return None
        ends = [m.start() for m in found[1:]] + [len(t)]
        return [{"title": m[0].strip(SPACES).lstrip("# "), "start": m.start(), "end": e} for m, e in zip(found, ends, strict=True)]

    def run(texts: pa.Array) -> pa.Array:
        return pa.array(list(map(of, texts.to_pylist())), pa.list_(pa.struct([("title", pa.string()), ("start", pa.int32()), ("end", pa.int32())])))

    return F.arrow_udf(run, "array<struct<title:string,start:int,end:int>>")(text)
