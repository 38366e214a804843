"""Secret scans: Aho-Corasick keywords, anchored expressions at their hits, embedded checksums.

Base kinds are assignments, access keys and hexadecimal runs.  The method adds kind `github`:
tokens with a known prefix whose last six characters are the base-62 CRC-32 of the rest.
The automaton reads each text twice: with letters folded, for the keywords of the named kinds, and
with hexadecimal digits folded to one, for runs as long as the hexadecimal kind asks.  Expressions
are tried at its hits alone.

Offsets count code points, end exclusive.  Null text is empty; letters of keywords match in
either ASCII case; overlapping matches of different kinds are all kept, and of those that start together the kind listed first comes first; texts are scanned whole,
whatever their length.  A null doc_id stays null, repeated rows are each scanned, an empty table
gives no rows, and columns but doc_id and text are never read.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import pandas as pd
from pyspark.sql import DataFrame

from .common import LOWER, UPPER, texts

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.A | re.I)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
TOKEN = re.compile(r"(?:gh[pousr]|npm)_([A-Za-z0-9]{30})([A-Za-z0-9]{6})(?![A-Za-z0-9])")
DIGITS = "0123456789" + UPPER + LOWER
SHORT = 24  # hexadecimal digits of a run that counts
# one byte for each code point: those beyond 255 become question marks, which no keyword holds
FOLD = bytes.maketrans(UPPER.encode(), LOWER.encode())
AS_HEX = bytes(ord("h") if chr(i) in "0123456789abcdef" else ord("-") for i in range(256))
KINDS = ("assign", "access", "hex", "github")


@lru_cache(1)
def _automaton():
    a = ahocorasick.Automaton()
    a.add_word("h" * SHORT, (2, SHORT))
    for kind, words in ((0, ("password", "passwd", "secret", "token", "apikey", "api_key")), (1, ("akia",)), (3, ("ghp_", "gho_", "ghu_", "ghs_", "ghr_", "npm_"))):
        for w in words:
            a.add_word(w, (kind, len(w)))
    a.make_automaton()
    return a


def checksum(body: str) -> str:
    n, out = zlib.crc32(body.encode()), ""
    for _ in range(6):
        n, d = divmod(n, 62)
        out = DIGITS[d] + out
    return out


def scan(text: str) -> list[tuple[int, int, int]]:
    """(start, kind number, end), sorted by start and kind."""
    flat = text.encode("latin-1", "replace")
    hits: tuple[list, ...] = ([], [], [], [])
    for table in (FOLD, AS_HEX):
        for end, (kind, n) in _automaton().iter(flat.translate(table).decode("latin-1")):
            if (kind == 2) == (table is AS_HEX):
                hits[kind].append(end + 1 - n)
    out = []
    for kind, rule in ((0, ASSIGN), (1, ACCESS), (2, HEX)):
        after = 0
        for at in sorted(set(hits[kind])):
            if at < after or (m := rule.match(text, at)) is None:
                continue
            after = m.end()
            if len(m[2]) >= 6 if kind == 0 else len(m[0]) >= 20:
                out.append((at, kind, m.end()))
    for at in hits[3]:
        if (m := TOKEN.match(text, at)) and checksum(m[1]) == m[2]:
            out.append((at, 3, m.end()))
    return sorted(out)


def scan_documents(docs: DataFrame) -> DataFrame:
    """doc_id, spans: array of (kind, start, end) by start, then kind as listed."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"doc_id": b.doc_id.astype("Int64").to_numpy(), "spans": [[{"kind": KINDS[k], "start": s, "end": e} for s, k, e in scan(t)] for t in b.text]})

    return texts(docs).mapInPandas(run, "doc_id long, spans array<struct<kind string, start long, end long>>")
