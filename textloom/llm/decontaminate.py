"""Benchmark decontamination by template windows, in DataFrame functions alone.

Numbers, units (words that name one, anywhere, and up to four letters joined to a number) and
capitalised words become typed placeholders, case and punctuation go, items are also met without
their capitals, and windows of WIDTH template words are hash-joined with those of the
benchmark.  A document holds an item when at least SHARE of the item's distinct windows occur
in it and its slots agree at one place: with each item window taken once, at one offset or at
offsets close to each other, most benchmark values of a slot stand for one document value each,
so a question with other numbers or names is caught, alone or among its variants, while a text
that merely shares a form with shuffled values is not.

A window of placeholders alone carries no wording: such windows of an item are left out, and an item that has no
others, such as a row of numbers, is held by the documents that have its very words and values.

Null text is empty.  Items with fewer than WIDTH words are one shorter window, items without
words match nothing.  Repeated rows of a doc_id, or of an item_id, count as one.  Rows with a
null doc_id are reported as not matched; null item ids are ignored.  Of an item's texts the
smallest counts.  Texts of any length are read whole.  Empty tables give no matches; columns but
ids and texts are never read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, of_key

WIDTH, SHARE = 8, 0.8
BROADCAST_WINDOWS = 500_000  # above this many benchmark windows, three numbers each, the join is shuffled
BROADCAST_DOCS = 4_000_000  # above this many documents that hold an item by form, one number each, texts are shuffled
# Words that name a unit of measure, time or money.
UNITS = frozenset(
    "kg g mg t km m cm mm kmh mph l ml hz khz mhz kw kwh w v kilogram kilograms gram grams gramme grammes ton tons tonne tonnes pound pounds lb lbs ounce ounces oz kilometer kilometers kilometre kilometres "
    "meter meters metre metres centimeter centimeters centimetre centimetres millimeter millimeters millimetre millimetres mile miles yard yards feet foot ft inch inches acre acres hectare hectares "
    "liter liters litre litres gallon gallons pint pints quart quarts cup cups hour hours hr hrs minute minutes min mins second seconds sec secs day days week weeks month months year years decade decades "
    "degree degrees percent dollar dollars cent cents euro euros pence rupee rupees yen volt volts watt watts knot knots".split()
)
SLOTS = "(xnumx|xunitx|xnamex)"


def _plain(c):
    """Lower-cased words without punctuation."""
    return F.filter(F.split(F.lower(F.regexp_replace(c, r"[^\p{L}\p{N}\s]+", "")), r"\s+"), lambda x: x != "")


# a number and up to four letters joined to it; a capitalised word.  The first character is tried before what stands before it
NUMBER = r"(\p{N}(?<![\p{L}\p{N}.,]\p{N})[\p{N}.,]*)(\p{L}{1,4})?(?![\p{L}\p{N}])"
NAME = r"\p{Lu}(?<![\p{L}\p{N}]\p{Lu})\p{Ll}+(?![\p{L}\p{N}])"


def _template(c):
    """Joined units become words of their own; a tilde that marks none goes with other punctuation."""
    c = F.regexp_replace(F.regexp_replace(c, NUMBER, "xnumx ~$2 "), r"~\p{L}+", "xunitx")
    return F.regexp_replace(c, NAME, "xnamex")


def _values(c):
    """The same words with the same breaks, values kept."""
    return F.regexp_replace(c, NUMBER, "$1 $2 ")


def _words(c):
    """Words of a template: those that name a unit are one too."""
    return F.transform(_plain(c), lambda w: F.when(w.isin(*sorted(UNITS)), "xunitx").otherwise(w))


def _windows(words, width):
    n = F.size(words)
    return F.when(n >= width, F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), n - width + 1)), lambda i: F.xxhash64(F.slice(words, i, width))))


def matches(docs: DataFrame, benchmark: DataFrame, width: int = WIDTH, share: float = SHARE) -> DataFrame:
    """doc_id, item_id, n_matched, n_windows of the items that documents hold."""
    items = benchmark.where("item_id is not null").groupBy(F.col("item_id").cast("long").alias("item_id")).agg(F.min("text").alias("text"))
    items = items.select("item_id", _words(_template(F.coalesce("text", F.lit("")))).alias("t"), _words(_template(F.lower(F.coalesce("text", F.lit(""))))).alias("low"), _plain(_values(F.coalesce("text", F.lit("")))).alias("v")).where("size(t) > 0")
    items = items.withColumn("size", F.least(F.size("t"), F.lit(width)))
    # an item window meets documents in three forms: its own, without capitals, and its first word with one
    cutout = lambda c, i: F.slice(c, i, F.col("size"))
    first = lambda i: F.when(i == 1, F.concat(F.array(F.lit("xnamex")), F.slice("t", 2, F.col("size") - 1))).otherwise(cutout("t", i))
    at = F.posexplode(F.transform(F.sequence(F.lit(1), F.size("t") - F.col("size") + 1), lambda i: F.struct(F.xxhash64(cutout("t", i)).alias("own"), F.array_distinct(F.array(cutout("t", i), cutout("low", i), first(i))).alias("forms"), cutout("v", i).alias("held"), F.exists(cutout("t", i), lambda w: ~w.rlike(f"^{SLOTS}$")).alias("worded"))))
    bench = items.select("item_id", "size", F.size("t").alias("long"), at.alias("idx", "x")).where("x.worded").select("item_id", "size", "long", "idx", "x.own", "x.held", F.explode("x.forms").alias("form")).withColumn("h", F.xxhash64("form"))
    distinct = bench.select("item_id", "own", "h").distinct()
    total = distinct.groupBy("item_id").agg(F.countDistinct("own").alias("n_windows"))
    sizes = sorted(r[0] for r in bench.select("size").distinct().collect())  # at most `width` values
    small = distinct.limit(BROADCAST_WINDOWS + 1).count() <= BROADCAST_WINDOWS
    b = F.broadcast(distinct) if small else distinct
    raw = docs.where("doc_id is not null and text is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    texts = raw.select("doc_id", _words(_template(F.col("text"))).alias("t"))
    hashed = F.filter(F.concat(*[F.coalesce(_windows(F.col("t"), s), F.array().cast("array<long>")) for s in sizes]), lambda x: x.isNotNull()) if sizes else F.array().cast("array<long>")
    # explode_outer: for explode, the optimizer adds a filter that makes the templates twice
    hits = texts.select("doc_id", F.explode_outer(F.array_distinct(hashed)).alias("h"))
    hits = hits.join(b, "h") if small else of_key(hits.where("h is not null"), b, "h", "inner")
    enough = hits.groupBy("doc_id", "item_id").agg(F.countDistinct("own").alias("n_matched")).join(F.broadcast(total) if small else total, "item_id").where(F.col("n_matched") >= share * F.col("n_windows"))
    if sizes:
        enough = _agreeing(cut(enough), bench, raw, sizes, share)
    enough = enough.select("doc_id", "item_id", "n_matched", "n_windows")
    bare = cut(items.join(bench.select("item_id").distinct(), "item_id", "left_anti").select("item_id", "v", F.least(F.size("v"), F.lit(width)).alias("size")))
    return enough.union(_verbatim(raw, bare, share)) if bare.head(1) else enough


def _verbatim(raw: DataFrame, bare: DataFrame, share: float) -> DataFrame:
    """Matches of items without wording, by windows of their values."""
    window = F.explode(F.array_distinct(F.transform(F.sequence(F.lit(1), F.size("v") - F.col("size") + 1), lambda i: F.xxhash64(F.slice("v", i, F.col("size"))))))
    b = bare.where("size > 0").select("item_id", window.alias("h"))
    total = b.groupBy("item_id").agg(F.count("*").alias("n_windows"))
    sizes = [r[0] for r in bare.select("size").distinct().collect() if r[0]]  # at most as many as words in a window
    texts = raw.select("doc_id", _plain(_values(F.col("text"))).alias("v"))
    hashed = F.concat(*[F.coalesce(_windows(F.col("v"), s), F.array().cast("array<long>")) for s in sizes])
    hits = of_key(texts.select("doc_id", F.explode(F.array_distinct(hashed)).alias("h")), b, "h", "inner")
    return hits.groupBy("doc_id", "item_id").agg(F.countDistinct("h").alias("n_matched")).join(total, "item_id").where(F.col("n_matched") >= share * F.col("n_windows")).select("doc_id", "item_id", "n_matched", "n_windows")


def _agreeing(enough: DataFrame, bench: DataFrame, raw: DataFrame, sizes: list[int], share: float) -> DataFrame:
    """Pairs that have a place where the slots agree; only pairs that match by form are looked at."""
    held = enough.join(bench, "item_id").select("doc_id", "item_id", "n_windows", "long", "idx", "own", "h", "form", F.col("held").alias("ours"))
    some = cut(held.groupBy("doc_id").agg(F.collect_set("h").alias("hs")))
    ids = some.select("doc_id")
    ids = F.broadcast(ids) if some.count() <= BROADCAST_DOCS else ids
    few = raw.join(ids, "doc_id", "left_semi").join(some, "doc_id")  # the texts that hold an item by form, with its windows' hashes
    wide = few.select("doc_id", "hs", F.xxhash64("text").alias("copy"), _words(_template(F.col("text"))).alias("t"), _plain(_values(F.col("text"))).alias("v"))
    n = F.when(F.size("t") == F.size("v"), F.size("t"))  # null where breaks differ: no windows
    # a lambda of two parameters, defaults too, would get the place in the array as its second
    window = lambda s: lambda i: F.struct(i.alias("pos"), F.xxhash64(F.slice("t", i, s)).alias("h"), F.slice("v", i, s).alias("theirs"))
    own = lambda s: lambda i: F.array_contains("hs", F.xxhash64(F.slice("t", i, s)))
    spot = [F.when(n >= s, F.transform(F.filter(F.sequence(F.lit(1), F.greatest(F.lit(1), n - s + 1)), own(s)), window(s))) for s in sizes]
    none = F.array().cast("array<struct<pos:int,h:bigint,theirs:array<string>>>")
    theirs = wide.select("doc_id", "copy", F.explode_outer(F.concat(*[F.coalesce(x, none) for x in spot])).alias("x")).select("doc_id", "copy", "x.*")
    met = held.join(theirs, ["doc_id", "h"]).withColumn("off", F.col("pos") - F.col("idx"))
    # places: one offset; offsets that words put in or left out move by less than half an item (two grids); the whole document
    place = lambda kind, at, copy: F.struct(F.lit(kind).alias("kind"), at.cast("long").alias("at"), copy.alias("copy"))
    off, long, copy = F.col("off"), F.col("long"), F.col("copy")
    places = F.array(place(0, off, copy), place(1, F.floor(off / long), copy), place(2, F.floor(off / long + 0.5), copy), place(3, F.lit(0), F.lit(0).cast("long")))
    met = met.withColumn("place", F.explode(places))
    key = ["doc_id", "item_id", "place"]
    # a window of the item counts once in a place: at the offset that holds most of its windows
    most = met.groupBy(*key, "copy", "off").agg(F.countDistinct("idx").alias("n"))
    best = F.min_by(F.struct("n_windows", "own", "form", "ours", "theirs"), F.struct(-F.col("n"), "off", "copy"))
    one = met.join(most, [*key, "copy", "off"]).groupBy(*key, "idx").agg(best.alias("m")).select(*key, "m.*")
    cover = one.groupBy(*key).agg((F.countDistinct("own") >= share * F.max("n_windows")).alias("covers")).where("covers or place.kind = 3")
    words = one.select(*key, F.explode(F.arrays_zip("form", "ours", "theirs")).alias("s")).where(F.col("s.form").rlike(SLOTS)).select(*key, "s.form", "s.ours", "s.theirs").distinct()
    slots = words.groupBy(*key, "form", "ours").agg(F.count("*").alias("n"))
    good = slots.groupBy(*key).agg((F.count_if(F.col("n") == 1) * 2 >= F.count("*")).alias("agree"))
    judged = cover.join(good, key, "left").groupBy("doc_id", "item_id").agg(F.bool_or(F.coalesce("agree", F.lit(True))).alias("agree"))
    return enough.join(judged, ["doc_id", "item_id"], "left").where(F.coalesce("agree", F.lit(True)))


def flag_documents(docs: DataFrame, benchmark: DataFrame, width: int = WIDTH, share: float = SHARE) -> DataFrame:
    """doc_id, contaminated, item_ids (ascending), for every document row."""
    found = matches(docs, benchmark, width, share).groupBy("doc_id").agg(F.sort_array(F.collect_set("item_id")).alias("items"))
    out = docs.select(F.col("doc_id").cast("long").alias("doc_id")).join(found, "doc_id", "left")
    return out.select("doc_id", F.col("items").isNotNull().alias("contaminated"), F.coalesce("items", F.array().cast("array<long>")).alias("item_ids"))
