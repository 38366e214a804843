"""Column expressions over texts.

White space is that of Unicode (what a split without arguments takes), not of ASCII; words are runs
of letters, numbers and the underscore.  Both classes are written out, so that they mean the same
in every regular-expression dialect.
"""

from __future__ import annotations

import unicodedata
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

from textloom.functions.places import CHAPTERS, SPACES, anchor, chapters, locate, locate_all, snippets  # noqa: F401

WS = r"\x{09}-\x{0D}\x{1C}-\x{20}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
SPACE = f"[{WS}]+"
WORD = r"\p{L}\p{N}_"
RUNS = f"[{WORD}]+|[^{WORD}]+"
BLANKS = f"{SPACE}|[^{WS}]+"
# Lines of distributors and transcribers that are never a text's own.
BOILERPLATE = (
    r"(?i)(Produced by|Transcribed by|E-?text prepared|Proofreading Team|Distributed Proofread|Thanks to .{0,40}for creating|anonymous donor|"
    r"PROJECT GUTENBERG|gutenberg\.org|Updated editions will replace|START OF (THE|THIS) PROJECT|END OF (THE|THIS) PROJECT|"
    r"Character set encoding|Release Date|Posting Date|\[Illustration)"
)
# Banners around a distributor's text, tried in order.
HEADERS = (r"(?i)\*\*\*\s*START OF TH(?:E|IS) PROJECT GUTENBERG EBOOK[^\*]*\*\*\*", r"(?i)\*\*\*\s*START OF THE PROJECT GUTENBERG[^\*]*\*\*\*")
FOOTERS = (r"(?i)\*\*\*\s*END OF TH(?:E|IS) PROJECT GUTENBERG EBOOK", r"(?i)\*\*\*\s*END OF THE PROJECT GUTENBERG")


def words(c) -> Column:
    own = strip(c)
    return F.when(own == "", F.array().cast("array<string>")).otherwise(F.split(own, SPACE))


def word_count(c) -> Column:
    return F.size(words(c))


def token_estimate(c) -> Column:
    return (word_count(c) * F.lit(1.35)).cast("int")


def strip(c) -> Column:
    return F.btrim(c, F.lit(SPACES))


def newlines(c) -> Column:
    """Line ends of any kind become one newline; the edges are stripped."""
    return strip(F.regexp_replace(c, "\r\n?", "\n"))


def slug(c) -> Column:
    return F.btrim(F.regexp_replace(F.lower(c), f"[^{WORD}]+", "-"), F.lit("-"))


def collapse(c) -> Column:
    return F.regexp_replace(c, SPACE, " ")


@lru_cache(1)
def _folds() -> tuple[str, str]:
    """Precomposed characters and the one base character that is left of each without its marks."""
    pairs = []
    for i in range(0x80, 0x10000):
        c = chr(i)
        base = "".join(x for x in unicodedata.normalize("NFD", c) if unicodedata.category(x) != "Mn")
        if len(base) == 1 and base != c:
            pairs.append((c, base))
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


def strip_accents(c) -> Column:
    """Letters without their marks; Hangul syllables, which come apart into several letters, stay whole."""
    return F.regexp_replace(F.translate(c, *_folds()), r"\p{Mn}", "")


def old_orthography(c) -> Column:
    """Key of a dictionary word: accents, hard signs and apostrophes go, yat becomes i."""
    return strip(F.translate(F.lower(strip_accents(c)), "ѣъ’'", "і"))


def casefold(c) -> Column:
    """Lower case, with the few letters that folding changes further."""
    return F.replace(F.translate(F.lower(c), "ςſ", "σs"), F.lit("ß"), F.lit("ss"))


def cut_boilerplate(c) -> Column:
    """What follows the last header banner and precedes the first footer banner; of either kind the first pattern that matches counts."""

    def part(text, patterns, last):
        out = text
        for p in reversed(patterns):
            parts = F.split(text, p)
            out = F.when(F.size(parts) > 1, F.element_at(parts, -1 if last else 1)).otherwise(out)
        return out

    return strip(part(part(F.regexp_replace(c, "\r\n?", "\n"), HEADERS, True), FOOTERS, False))


def front_matter(c) -> Column:
    """header, body, shift: a leading block between two lines of dashes, the rest, and the bytes before it."""
    close = F.locate("---", c, 4)
    has = F.startswith(c, F.lit("---")) & (close > 0)
    header = F.when(has, F.substring(c, F.lit(1), close + 2)).otherwise("")
    body = F.when(has, F.substring(c, close + 3, F.length(c))).otherwise(c)
    return F.struct(header.alias("header"), F.when(has, strip(body)).otherwise(body).alias("body"), F.octet_length(header).alias("shift"))


def html_text(c) -> Column:
    """Scripts and styles go, headings get as many signs as their level, paragraphs and breaks become lines, tags go, entities are read."""
    for pattern, by in (
        (r"(?is)<script[^>]*>.*?</script>", ""), (r"(?is)<style[^>]*>.*?</style>", ""),
        (r"(?i)<h1[^>]*>(.*?)</h1>", "\n\n# $1\n\n"), (r"(?i)<h2[^>]*>(.*?)</h2>", "\n\n## $1\n\n"), (r"(?i)<h3[^>]*>(.*?)</h3>", "\n\n### $1\n\n"),
        (r"(?i)<p[^>]*>(.*?)</p>", "$1\n\n"), (r"(?i)<br\s*/?>", "\n"), (r"<[^>]+>", ""),
    ):
        c = F.regexp_replace(c, pattern, by)
    for entity, by in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&middot;", "·"), ("&copy;", "©"), ("&amp;", "&")):
        c = F.replace(c, F.lit(entity), F.lit(by))
    return strip(F.regexp_replace(c, r"\n{3,}", "\n\n"))


def fiction_book_text(c) -> Column:
    return strip(collapse(F.regexp_replace(c, r"<[^>]+>", " ")))


def lines(c) -> Column:
    return F.split(c, "\n", -1)


def whole_word(text, name) -> Column:
    """Whether a name's words stand in the text, whatever the white space between them, not inside longer words."""
    parts = F.transform(words(name), lambda w: F.concat(F.lit(r"\Q"), w, F.lit(r"\E")))
    return F.regexp_like(text, F.concat(F.lit(f"(?<![{WORD}])"), F.array_join(parts, SPACE), F.lit(f"(?![{WORD}])")))


def chunks(text, size: int = 3000) -> Column:
    w = words(text)
    return F.when(F.size(w) > 0, F.transform(F.sequence(F.lit(0), F.size(w) - 1, F.lit(size)), lambda i: F.slice(w, i + 1, size)))


def rescue_json(c) -> Column:
    """The JSON object within a model's answer: thoughts, fences, what stands outside the braces and trailing commas go."""
    c = F.when(c.contains("</think>"), strip(F.element_at(F.split(c, "</think>", -1), -1))).otherwise(c)
    fenced = lambda mark: strip(F.element_at(F.split(F.element_at(F.split(c, mark, -1), 2), "```", -1), 1))
    c = F.when(c.contains("```json"), fenced("```json")).when(c.contains("```"), fenced("```")).otherwise(c)
    braces = F.regexp_extract(c, r"(?s)\{.*\}", 0)
    c = F.when(braces != "", braces).otherwise(c)
    return F.when(F.try_parse_json(c).isNotNull(), c).otherwise(F.regexp_replace(c, r",\s*([\]}])", "$1"))


def blank(c) -> Column:
    return c.isNull() | (strip(c) == "")
