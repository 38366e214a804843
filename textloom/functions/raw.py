"""Column expressions over bytes, digests and canonical JSON."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def byte_slice(content, start, length) -> Column:
    return F.substring(content, start + 1, length)


def _inside(content, at) -> Column:
    """Whether the byte at a place goes on a character that began before it."""
    return F.hex(F.substring(content, at + 1, F.lit(1))).between("80", "BF")


def snap(content, at, forward: bool = False) -> Column:
    """The place itself, or the nearest character border before (after) it; places beyond the ends become the ends."""
    n, step = F.octet_length(content), 1 if forward else -1
    out = at + step * 3
    for k in (2, 1, 0):
        out = F.when(_inside(content, at + step * k), out if k == 2 else F.least(n, out)).otherwise(at + step * k)
    return F.when(at <= 0, 0).when(at >= n, n).otherwise(F.least(out, n))


def window(content, start, end) -> Column:
    """byte_start, byte_len, bytes, their hash."""
    part = byte_slice(content, start, end - start)
    return F.struct(start.alias("byte_start"), (end - start).alias("byte_len"), F.sha2(part, 256).alias("window_sha256"), part.alias("window"))


def run_time(at: str | None = None) -> Column:
    """Time of a run in UTC, to the second, as text; a run that must be repeatable gives its own."""
    return F.lit(at) if at else F.date_format(F.to_utc_timestamp(F.current_timestamp(), F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss'+00:00'")


def quoted(c: Column) -> Column:
    """A JSON string with non-ASCII letters kept; control characters are escaped."""
    plain = F.replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))
    for raw, esc in (("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t"), ("\b", "\\b"), ("\f", "\\f")):
        plain = F.replace(plain, F.lit(raw), F.lit(esc))
    rest = plain
    for i in range(0x20):
        if chr(i) not in "\n\r\t\b\f":
            rest = F.replace(rest, F.lit(chr(i)), F.lit(f"\\u{i:04x}"))
    plain = F.when(c.rlike(r"[\x00-\x07\x0B\x0E-\x1F]"), rest).otherwise(plain)
    return F.when(c.isNull(), "null").otherwise(F.concat(F.lit('"'), plain, F.lit('"')))


def canonical(**fields) -> Column:
    """A JSON object of columns of JSON, keys sorted, with a space after commas and colons."""
    return F.concat(F.lit("{"), F.concat_ws(", ", *[F.concat(F.lit(f'"{k}": '), v) for k, v in sorted(fields.items())]), F.lit("}"))


def listed(*items) -> Column:
    return F.concat(F.lit("["), F.concat_ws(", ", *items), F.lit("]"))


def relation_hash(df, columns, digits: int = 3):
    """One hash of a whole relation, whatever the order of its rows: hashes of groups of row hashes, hashed.

    A task holds the row hashes of one of 16 ** digits groups: more digits for larger tables make another hash."""
    row = F.sha2(F.concat_ws("\x1f", *[F.coalesce(F.col(c).cast("string"), F.lit("\x00")) for c in columns]), 256)
    groups = df.select(row.alias("h")).groupBy(F.substring("h", 1, digits).alias("g")).agg(F.sha2(F.array_join(F.sort_array(F.collect_list("h")), "\n"), 256).alias("h"))
    return groups.agg(F.sha2(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("g", "h"))), lambda x: x.h), "\n"), 256).alias("relation_sha256"))
