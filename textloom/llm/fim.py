"""Fill-in-middle transformation by bit-parallel arithmetic on big integers.

A text's UTF-8 bytes become one integer per class of bytes: `bytes.translate` maps a byte to 1 or 0, so
that byte i is bit 8i.  Units start where shifted boolean operations on these masks say so: a code
point at a byte that continues none, a word where its first letter follows white space, a line after a
line feed.  `bit_count` gives the number of units, and halving the mask again and again finds the bytes
at which the units of two given ranks start.

Three spans go out in another order behind sentinels, by draws from the SHA-256 of doc_id: plain text stays
plain where it is empty, holds a sentinel or is not drawn.  Null text is empty.  A null doc_id draws as the
text `null`; repeated rows draw alike; an empty table gives no rows; texts of any length are cut whole, and
columns but doc_id and text are never read.  Equal cuts, of which the smaller comes first, give an empty middle.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WS, texts

SENTINELS = ("<P>", "<S>", "<M>")  # before prefix, suffix and middle
PLAIN, SPM = 90, 20  # of a hundred: from here on plain; below this, suffix first


def _class(*bytes_of: int) -> bytes:
    return bytes(i in bytes_of for i in range(256))


STARTS = bytes(i & 0xC0 != 0x80 for i in range(256))  # bytes that continue no code point
SPACES = _class(*WS.encode())
FEEDS = _class(0x0A)


def mask(data: bytes, of: bytes) -> int:
    return int.from_bytes(data.translate(of), "little")


def starts(data: bytes, unit: str = "char") -> int:
    """Bit 8i where a unit starts at byte i; the first unit starts at byte 0, whatever it is."""
    if unit == "char":
        return mask(data, STARTS)
    if unit == "word":
        space = mask(data, SPACES)
        return (space << 8 & ~space | 1) & ((1 << 8 * len(data)) - 1) if data else 0
    if unit == "line":
        return (mask(data, FEEDS) << 8 | 1) & ((1 << 8 * len(data)) - 1) if data else 0
    raise ValueError(f"no unit {unit}")


def select(bits: int, width: int, ranks: list[int]) -> list[int]:
    """Bytes at which the units of these ascending ranks start; the one after the last starts at the end."""
    n = bits.bit_count()
    found: dict[int, int] = {r: width for r in ranks if r >= n}
    work = [(bits, 0, width, 0, sorted({r for r in ranks if r < n}))]
    while work:
        m, at, size, before, wanted = work.pop()
        if not wanted:
            continue
        if size == 1:
            found[wanted[0]] = at
            continue
        half = size // 2
        low = m & ((1 << 8 * half) - 1)
        middle = before + low.bit_count()
        work.append((low, at, half, before, [r for r in wanted if r < middle]))
        work.append((m >> 8 * half, at + half, size - half, middle, [r for r in wanted if r >= middle]))
    return [found[r] for r in ranks]


def draws(doc_id: int | None) -> tuple[int, int, int, int]:
    h = hashlib.sha256(f"1:{'null' if doc_id is None else doc_id}".encode()).hexdigest()
    return tuple(int(h[i : i + 8], 16) for i in (0, 8, 16, 24))  # type: ignore[return-value]


def transform(text: str, doc_id: int | None, unit: str = "char") -> tuple[int, str, int | None, int | None, str]:
    """Units of the text, form, units of prefix and middle, output."""
    data = text.encode("utf-8")
    bits = starts(data, unit)
    n = bits.bit_count()
    h1, h2, h3, h4 = draws(doc_id)
    if not text or h3 % 100 >= PLAIN or any(s in text for s in SENTINELS):
        return n, "plain", None, None, text
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    i, j = select(bits, len(data), [a, b])
    prefix, middle, suffix = (x.decode("utf-8") for x in (data[:i], data[i:j], data[j:]))
    p, s, m = SENTINELS
    spm = h4 % 100 < SPM
    return n, "spm" if spm else "psm", a, b - a, f"{s}{suffix}{p}{prefix}{m}{middle}" if spm else f"{p}{prefix}{s}{suffix}{m}{middle}"


def restored(output: str = "output", form: str = "form"):
    """The text of an output, by its sentinels alone: as a text that holds one stays plain, each occurs once."""
    out = F.col(output)
    between = lambda a, b: F.split_part(F.split_part(out, F.lit(a), F.lit(2)), F.lit(b), F.lit(1))
    p, s, m = SENTINELS
    last = F.split_part(out, F.lit(m), F.lit(2))
    psm, spm = F.concat(between(p, s), last, between(s, m)), F.concat(between(p, m), last, between(s, p))
    return F.when(F.col(form) == "psm", psm).when(F.col(form) == "spm", spm).otherwise(out)


def fill_in_middle(docs: DataFrame, unit: str = "char") -> DataFrame:
    """doc_id, n, form, prefix_units, middle_units (null where plain), output of every text."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            ids = b.doc_id.astype("Int64")
            out = [transform(t, None if i is pd.NA else int(i), unit) for t, i in zip(b.text, ids, strict=True)]
            n, form, prefix, middle, said = zip(*out, strict=True) if out else ((),) * 5
            whole = lambda x: pd.array(list(x), "Int64")
            yield pd.DataFrame({"doc_id": ids.to_numpy(), "n": whole(n), "form": form, "prefix_units": whole(prefix), "middle_units": whole(middle), "output": said})

    return texts(docs).mapInPandas(run, "doc_id long, n long, form string, prefix_units long, middle_units long, output string")
