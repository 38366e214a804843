"""Dictionary text: citations, headwords, volumes, entries with byte places, claims against them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textloom.functions import raw as R
from textloom.functions import text as T
from textloom.operators.evidence import array_offsets

# The dictionary's alphabet, the letters of its four volumes, and the shapes of references to it.
ALPHABET = "АБВГҐДЕЄЖЗИІЇЙКЛМНОПРСТУФХЦЧШЩЬЮЯ"
VOLUMES = ((1, "А", "Ж"), (2, "З", "Н"), (3, "О", "П"), (4, "Р", "Я"))
ROMAN = {"I": 1, "II": 2, "III": 3, "IV": 4}
CITATION = rf"(?iu)(?:т\.\s*)?(?<![{T.WORD}])([IVXІVХivxіvх]{{1,4}}|[1-4])\s*[,;]\s*(?:с\.?|ст\.?)?\s*(\d{{1,4}})"
LETTERS = r"[А-ЯЄІЇҐа-яєіїґ’\x27]+"
HEADWORDS = (
    rf"[«\x27\x22]({LETTERS})[»\x27\x22]",
    rf"(?:за\s+)?(?:модел[{T.WORD}]{{0,4}}|зразк(?:ом|у)|на\s+зразок)\s+({LETTERS})",
    rf"\(({LETTERS})[,)]",
    rf"давні\s+композити\s+на\s+зразок\s+({LETTERS})",
)
NOT_HEADWORDS = ("грінченко", "словарь", "модель")
COORDINATES = r"«([^»]+)»\s*\(Грінченко,\s*том\s*(\d),\s*артефакт\s*(\d+)\+(\d+)\)"
SMALL = r"[а-яїієґёъьѣ\x{0301}’\x27\-]{1,40}"
ENTRY = rf"^([А-ЯЇІЄҐЂѢ]{SMALL})(?:(?:\s*,\s*|\s+и\s+){SMALL}){{0,3}}\s*,\s*(?:-|[а-яїієґ]{{1,6}}\.|=)"
RUNNING_HEAD = r"^«Словарь української мови» Бориса Грінченка\s*\d*\s*$"

SAMPLE = ("вісник", "Мережа", "сховище", "праліс", "дім", "Ящик", "Еxo")  # words of made-up claims


def citation(text: Column) -> Column:
    """volume, page of the first reference in a text; Cyrillic letters count as the Roman numerals they look like."""
    mark = F.regexp_extract(text, CITATION, 1)
    roman = F.upper(F.translate(mark, "ІіХхУу", "IIXXVV"))
    volume = F.when(roman.rlike("^[0-9]+$"), roman.cast("int"))
    for name, n in ROMAN.items():
        volume = F.when(roman == name, n).otherwise(volume)
    page = F.regexp_extract(text, CITATION, 2)
    return F.struct(F.when(mark != "", volume).alias("volume"), F.when(mark != "", page.cast("int")).alias("page"), (mark != "").alias("cited"))


def headword(text: Column) -> Column:
    """The word that a claim is about: by the first pattern whose first match is long enough."""
    out = F.lit(None).cast("string")
    for pattern in reversed(HEADWORDS):
        w = F.regexp_extract(text, pattern, 1)
        out = F.when((F.length(w) >= 3) & ~F.lower(w).isin(*NOT_HEADWORDS), w).otherwise(out)
    return out


def volume_of(word: Column) -> Column:
    """Volume by first letter; a word that begins with a hard sign sorts before all others."""
    first = F.substring(F.upper(T.strip(T.strip_accents(word))), 1, 1)
    first = F.when(first == "Ы", "И").when(first == "Э", "Е").otherwise(first)
    at = F.position(first, F.lit(ALPHABET))
    out = F.lit(None).cast("int")
    for v, low, high in reversed(VOLUMES):
        out = F.when(at.between(ALPHABET.index(low) + 1, ALPHABET.index(high) + 1), v).otherwise(out)
    return F.when(F.coalesce(word, F.lit("")) == "", None).when(first.isin("", "Ъ"), 1).otherwise(out)


def volume_verdict(word: Column, claimed: Column) -> Column:
    own = volume_of(word)
    known = (F.coalesce(word, F.lit("")) != "") & claimed.isNotNull() & own.isNotNull()
    return F.when(~known, "UNDECIDABLE").when(own == claimed, "PLAUSIBLE").otherwise("CONTRADICTED")


def by_affix(words: DataFrame, word: Column, suffix: str = "", prefix: str = "", contains: str = "", least: int = 4) -> DataFrame:
    """Rows whose word, in small letters without accents, has the affixes asked for."""
    w = F.lower(T.strip_accents(word))
    return words.where((F.length(w) >= least) & F.endswith(w, F.lit(suffix.lower())) & F.startswith(w, F.lit(prefix.lower())) & F.contains(w, F.lit(contains.lower())))


def coordinates(text: Column) -> Column:
    """word, volume, byte_start, byte_len of every reference by bytes."""
    part = lambda k: F.regexp_extract_all(text, F.lit(COORDINATES), F.lit(k))
    return F.transform(F.arrays_zip(part(1).alias("a"), part(2).alias("b"), part(3).alias("c"), part(4).alias("d")), lambda x: F.struct(x.a.alias("word"), x.b.cast("int").alias("volume"), x.c.cast("long").alias("byte_start"), x.d.cast("long").alias("byte_len")))


def entries(texts: DataFrame, key: str) -> DataFrame:
    """key, headword, byte_start, byte_len of the dictionary lines of texts."""
    line = array_offsets(texts, [key], T.lines(F.col("text")), 1)
    return line.where(F.col("item").rlike(ENTRY)).select(key, "byte_offset", F.octet_length("item").alias("byte_len"), F.regexp_extract("item", ENTRY, 1).alias("headword")).withColumnRenamed("byte_offset", "byte_start")


def index(found: DataFrame) -> DataFrame:
    """Entries by normal form: the first by place stands for those of one form."""
    return found.groupBy(T.old_orthography(F.col("headword")).alias("form")).agg(F.min_by(F.struct(*found.columns), F.struct("byte_start", "headword")).alias("entry"), F.count("*").alias("n_entries"))


def attested(words: DataFrame, found: DataFrame, artifacts: DataFrame, key: str) -> DataFrame:
    """words(key, word) with the verdict on each: absent, attested, or an entry whose bytes begin otherwise."""
    bare = lambda c: F.lower(T.strip_accents(c))
    first = found.groupBy(key, bare(F.col("headword")).alias("form")).agg(F.min_by(F.struct("headword", "byte_start", "byte_len"), "byte_start").alias("e"))
    seen = words.withColumn("form", bare(F.col("word"))).join(first, [key, "form"], "left").join(artifacts.select(key, "content"), key, "left")
    at = bare(F.make_valid_utf8(R.byte_slice(F.col("content"), F.col("e.byte_start"), F.col("e.byte_len")).cast("string")))
    ok = F.startswith(at, F.substring(bare(F.col("e.headword")), 1, 5))
    return seen.select(key, "word", F.when(F.col("e").isNull(), "ABSENT").when(ok, "ATTESTED").otherwise("COORD_MISMATCH").alias("verdict"))


def claim_verdicts(claims: DataFrame, forms: DataFrame, coordinate_verdict: Column | None = None) -> DataFrame:
    """claims(…, claim) with headword, volume, page and verdict against index(form).

    References by bytes decide first, where `coordinate_verdict` is given and not null."""
    said = claims.withColumn("cite", citation(F.col("claim"))).withColumn("headword", headword(F.col("claim")))
    met = said.withColumn("form", T.old_orthography(F.col("headword"))).join(forms.select("form", F.lit(True).alias("listed")), "form", "left")
    by_words = (
        F.when(~F.col("cite.cited"), "UNDECIDABLE")
        .when(F.col("headword").isNull(), "NOT_FOUND")
        .when(F.col("listed").isNull(), "CONTRADICTED")
        .when(~volume_of(F.col("headword")).eqNullSafe(F.col("cite.volume")), "CONTRADICTED")
        .otherwise("CONFIRMED")
    )
    verdict = by_words if coordinate_verdict is None else F.coalesce(coordinate_verdict, by_words)
    return met.withColumn("verdict", verdict).select(*claims.columns, "headword", "cite.volume", "cite.page", "verdict")


def proposals(rows: DataFrame) -> DataFrame:
    """One row for each non-blank variant in rows(…, json, traditional); the traditional form where there is none."""
    kind = "array<struct<variant string, morphemes string, grinchenko_model string, semantic_nuance string>>"
    own = F.from_json("json", kind)
    none = F.array(F.struct(F.col("traditional").alias("variant"), F.lit("traditional loan").alias("morphemes"), F.lit(None).cast("string").alias("grinchenko_model"), F.lit(None).cast("string").alias("semantic_nuance")))
    some = F.when(F.coalesce(F.size(own), F.lit(0)) > 0, own).when(~T.blank(F.col("traditional")), none)
    out = rows.withColumn("p", F.explode(some)).where(~T.blank(F.col("p.variant")))
    rest = [c for c in rows.columns if c not in ("json", "traditional")]
    return out.select(*rest, T.strip("p.variant").alias("variant"), F.get(T.words("p.morphemes"), F.lit(0)).alias("root"), F.coalesce(F.nullif(F.col("p.grinchenko_model"), F.lit("")), "p.morphemes").alias("model"), F.col("p.semantic_nuance").alias("note"))


def evidence_key(work: Column, artifact: Column, term: Column, window: Column) -> Column:
    """Names a term in its context: another window makes another key."""
    return F.sha2(R.listed(work.cast("string"), R.quoted(artifact), R.quoted(T.casefold(term)), R.quoted(window)), 256)


def boundary_lines(texts: DataFrame, key: str, most: int = 220, tail: bool = False) -> DataFrame:
    """key, side, idx, byte_offset, line: the first (last) lines that are long enough and not a distributor's."""
    line = array_offsets(texts, [key], T.lines(F.col("text")), 1).withColumn("line", T.strip("item"))
    good = line.where((F.length("line") >= 3) & ~F.col("line").rlike(T.BOILERPLATE))
    near = Window.partitionBy(key).orderBy(F.desc("i") if tail else F.asc("i"))
    some = good.withColumn("r", F.row_number().over(near)).where(F.col("r") <= most)
    n = F.count("*").over(Window.partitionBy(key))
    idx = (n - F.col("r")).cast("int") if tail else F.col("r") - 1
    return some.select(key, F.lit("tail" if tail else "head").alias("side"), idx.alias("idx"), "byte_offset", F.substring("line", 1, 160).alias("line"))


def review_items(cards: DataFrame) -> DataFrame:
    """One blank review item for each proposal of cards(term, title, proposals, attestations)."""
    scales = "semantics naturalness word_formation style".split()
    one = cards.select("*", F.explode("proposals").alias("p"))
    return one.select(
        F.substring(F.sha2(F.concat(F.lit("review.v1:"), F.col("p.id").cast("string")), 256), 1, 16).alias("id"), "term", "title", F.col("p.variant").alias("variant"),
        F.transform("attestations", lambda a: F.struct(a.quote.alias("quote"), a.byte_start.alias("byte_start"), a.byte_len.alias("byte_len"), a.artifact_sha256.alias("source_sha256"))).alias("contexts"),
        F.lit(None).cast("boolean").alias("context_sufficient"), F.lit(None).cast("string").alias("relevance"), F.lit("").alias("relevance_reason"),
        F.struct(*[F.lit(None).cast("int").alias(s) for s in scales]).alias("scores"), F.lit("").alias("comment"),
    )


def phases(items: DataFrame, seed: int = 901, calibration: int = 10) -> DataFrame:
    """Items in an order drawn by hash of seed and id; the first few are for calibration.

    The order is our own: not that of another language's random numbers."""
    drawn = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string")), 256)
    first = items.select("id", drawn.alias("drawn")).orderBy("drawn", "id").limit(calibration).select("id", F.lit("calibration").alias("phase"))
    return items.join(F.broadcast(first), "id", "left").withColumn("phase", F.coalesce("phase", F.lit("development_review"))).withColumn("drawn", drawn)


def page_places(pages: DataFrame, key: str, page: str) -> DataFrame:
    """Bytes at which each page of a dictionary begins, running heads left out."""
    kept = F.filter(T.lines(F.col("text")), lambda x: ~T.strip(x).rlike(RUNNING_HEAD))
    body = F.concat(T.strip(F.array_join(kept, "\n")), F.lit("\n"))
    n = F.octet_length(body)
    before = F.sum(n).over(Window.partitionBy(key).orderBy(page)) - n
    return pages.select(key, page, before.alias("byte_start"), n.alias("byte_len"))
