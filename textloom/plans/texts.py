"""Registered queries on texts, bytes and digests."""

from __future__ import annotations

from pyspark.sql import functions as F

from textloom.functions import raw as R
from textloom.functions import text as T
from textloom.operators import dictionary as D
from textloom.plans.registry import query

_SP, _RE = T.SPACE, f"'{T.SPACE}'"


def _words(c: str) -> str:
    return f"list_filter(regexp_split_to_array({c}, {_RE}), lambda w: w <> '')"


def _strip(c: str) -> str:
    return f"regexp_replace(regexp_replace({c}, '^{_SP}', ''), '{_SP}$', '')"


def _flat(c: str) -> str:
    return f"regexp_replace({c}, {_RE}, ' ', 'g')"


@query(f"select doc_id, cast(len({_words('text')}) as integer) as n_words, cast(floor(len({_words('text')}) * cast(1.35 as double)) as integer) as n_tokens from documents", "documents")
def x03_word_counts(d):
    return d.select("doc_id", T.word_count("text").alias("n_words"), T.token_estimate("text").alias("n_tokens"))


@query(f"select cast(sum(strlen(text)) as bigint) as bytes, cast(sum(coalesce(nullif(if(doc_id % 3 = 0, 0, n_chars), 0), len({_words('text')}))) as bigint) as words from documents", "documents")
def a04_corpus_totals(d):
    """Stored counts (n_chars stands for them, and 0 for a missing one), else words counted now."""
    stored = F.when(F.col("doc_id") % 3 == 0, 0).otherwise(F.col("n_chars"))
    return d.agg(F.sum(F.octet_length("text")).alias("bytes"), F.sum(F.coalesce(F.nullif(stored, F.lit(0)), T.word_count("text"))).alias("words"))


_CR = "' ' || chr(13) || chr(10) || replace(text, '. ', '.' || chr(13)) || chr(13) || chr(10) || ' '"


@query(rf"select doc_id, sha256({_strip(f'''regexp_replace({_CR}, '\r\n?', chr(10), 'g')''')}) as h from documents", "documents")
def x05_newlines(d):
    return d.select("doc_id", F.sha2(T.newlines(F.concat(F.lit(" \r\n"), F.replace("text", F.lit(". "), F.lit(".\r")), F.lit("\r\n "))), 256).alias("h"))


_BANNERS = "case doc_id % 3 when 0 then 'x *** START OF THIS PROJECT GUTENBERG EBOOK A B *** ' || text || ' *** End of the Project Gutenberg x' when 1 then 'y ***START OF THE PROJECT GUTENBERG z*** ' || text else text end"


@query(
    f"with b as (select doc_id, {_BANNERS} as t from documents), h as (select doc_id, case when regexp_matches(t, '{T.HEADERS[0]}') then regexp_split_to_array(t, '{T.HEADERS[0]}')[-1] when regexp_matches(t, '{T.HEADERS[1]}') then regexp_split_to_array(t, '{T.HEADERS[1]}')[-1] else t end as t from b) "
    f"select doc_id, sha256({_strip(f'''case when regexp_matches(t, '{T.FOOTERS[0]}') then regexp_split_to_array(t, '{T.FOOTERS[0]}')[1] when regexp_matches(t, '{T.FOOTERS[1]}') then regexp_split_to_array(t, '{T.FOOTERS[1]}')[1] else t end''')}) as h from h",
    "documents",
)
def x06_cut_boilerplate(d):
    return d.select("doc_id", F.sha2(T.cut_boilerplate(F.expr(_BANNERS)), 256).alias("h"))


_FRONT = "if(doc_id % 2 = 0, '---' || chr(10) || 'title: ' || source || chr(10) || '---' || chr(10) || text, text)"


@query(
    f"with f as (select doc_id, {_FRONT} as t from documents), c as (select *, starts_with(t, '---') and instr(substr(t, 4), '---') > 0 as has, instr(substr(t, 4), '---') + 5 as cut from f) "
    f"select doc_id, cast(if(has, strlen(substr(t, 1, cut)), 0) as integer) as shift, sha256(if(has, {_strip('substr(t, cut + 1)')}, t)) as h from c",
    "documents",
)
def x07_front_matter(d):
    f = d.select("doc_id", T.front_matter(F.expr(_FRONT)).alias("f"))
    return f.select("doc_id", "f.shift", F.sha2("f.body", 256).alias("h"))


@query("select doc_id, md5(strip_accents(text)) as h from documents", "documents")
def x09_strip_accents(d):
    return d.select("doc_id", F.md5(T.strip_accents(F.col("text"))).alias("h"))


@query(rf"select doc_id, md5({_strip('''translate(lower(strip_accents('Трудникъ вѣстник’ ' || text)), 'ѣъ’' || chr(39), 'і')''')}) as h from documents", "documents")
def x10_old_orthography(d):
    return d.select("doc_id", F.md5(T.old_orthography(F.concat(F.lit("Трудникъ вѣстник’ "), F.col("text")))).alias("h"))


@query("select doc_id, md5(replace(translate(lower('Straße ΣΑΣ ' || text), 'ςſ', 'σs'), 'ß', 'ss')) as h from documents", "documents")
def x11_casefold(d):
    return d.select("doc_id", F.md5(T.casefold(F.concat(F.lit("Straße ΣΑΣ "), F.col("text")))).alias("h"))


@query(f"select doc_id, md5({_flat('text')}) as h, substr({_flat('text')}, 1, 90) as gloss from documents", "documents")
def x12_collapse(d):
    return d.select("doc_id", F.md5(T.collapse("text")).alias("h"), F.substring(T.collapse("text"), 1, 90).alias("gloss"))


@query(
    rf"""with t as (select doc_id, text, regexp_extract_all(text, '(?i)[{T.WORD}]+|[^{T.WORD}]+') as r from documents), p as (select doc_id, text, unnest(r) as f, generate_subscripts(r, 1) as i from t),
o as (select doc_id, text, f, cast(sum(length(f)) over (partition by doc_id order by i) - length(f) as bigint) as spot from p), n as (select *, row_number() over (partition by doc_id order by spot) as k from o where lower(f) = 'the')
select doc_id, f as exact_match, cast(spot as integer) as position, {_flat(_strip('substr(text, cast(greatest(0, spot - 350) + 1 as bigint), cast(spot + length(f) + 350 - greatest(0, spot - 350) as bigint))'))} as context from n where k <= 5""",
    "documents",
)
def x13_snippets(d):
    """The first five places of a whole word in each text (L09 is the limit)."""
    return d.select("doc_id", F.explode(T.snippets(F.col("text"), F.lit("the"))).alias("s")).select("doc_id", "s.*")


# a quote of each text's own words with other white space, a word that is not there, or one that is there often
_QUOTE = f"case doc_id % 4 when 0 then array_to_string(({_words('text')})[3:9], '  ') when 1 then array_to_string(({_words('text')})[2:4], chr(10)) when 2 then 'no such words' else ({_words('text')})[1] end"


def _bytes_before(prefix: str) -> str:
    runs, own = f"regexp_extract_all(text, '{T.BLANKS}')", f"regexp_extract_all({prefix}, '{T.BLANKS}')"
    return f"if(len({own}) = 0, 0, strlen(array_to_string({runs}[1:len({own}) - 1], '')) + if({own}[-1] = ' ', strlen({runs}[len({own})]), strlen({own}[-1])))"


@query(
    f"with q as (select doc_id, text, coalesce({_QUOTE}, '') as quote from documents), p as (select *, {_flat(_strip('quote'))} as q, {_flat('text')} as flat from q), l as (select *, if(q = '', 0, instr(flat, q)) as p, if(q = '', 0, instr(substr(flat, instr(flat, q) + 1), q)) as again from p), "
    f"b as (select *, {_bytes_before('substr(flat, 1, p - 1)')} as s, {_bytes_before('substr(flat, 1, p - 1 + length(q))')} as e, case when q = '' then 'empty_quote' when p = 0 then 'quote_absent' when again > 0 then 'quote_ambiguous' end as error from l) "
    "select doc_id, error, cast(if(error is null, s, null) as integer) as byte_start, cast(if(error is null, e - s, null) as integer) as byte_len, if(error is null, if(decode(unhex(substr(hex(text), 2 * s + 1, 2 * (e - s)))) = quote, 'exact', 'whitespace_only'), null) as alignment from b",
    "documents",
    holes="byte_start byte_len",
)
def x14_locate(d):
    w = T.words(F.col("text"))
    k = F.col("doc_id") % 4
    quote = F.when(k == 0, F.array_join(F.slice(w, 3, 7), "  ")).when(k == 1, F.array_join(F.slice(w, 2, 3), "\n")).when(k == 2, "no such words").otherwise(F.get(w, F.lit(0)))
    return d.select("doc_id", T.locate(F.col("text"), F.coalesce(quote, F.lit(""))).alias("x")).select("doc_id", "x.*")


_NAME = f"if(doc_id % 2 = 0, array_to_string(({_words('text')})[2:3], ' '), substr(({_words('text')})[4], 1, 2))"


@query(rf"select doc_id, regexp_matches(text, '(^|[^{T.WORD}])' || replace(regexp_escape(name), '\ ', '{_SP}') || '($|[^{T.WORD}])') as named from (select doc_id, text, {_NAME} as name from documents) where name is not null and name <> '' and regexp_full_match(name, '[{T.WORD} ]+')", "documents")
def x15_whole_word(d):
    w = T.words(F.col("text"))
    named = d.withColumn("name", F.when(F.col("doc_id") % 2 == 0, F.array_join(F.slice(w, 2, 2), " ")).otherwise(F.substring(F.get(w, F.lit(3)), 1, 2)))
    return named.where(f"name is not null and name <> '' and name rlike '^[{T.WORD} ]+$'".replace("\\", "\\\\")).select("doc_id", T.whole_word(F.col("text"), F.col("name")).alias("named"))


_NEEDLE = f"case doc_id % 3 when 0 then array_to_string(({_words('text')})[2:6], ' ') when 1 then array_to_string(({_words('text')})[2:6], '   ') else substr(text, 1, 1) || ' ' end"


@query(
    f"with n as (select doc_id, text, {_strip(_NEEDLE)} as q from documents), t as (select *, {_flat('text')} as flat, {_flat('q')} as qf, if(q = '', 0, len(string_split(text, q)) - 1) as times from n), p as (select *, if(qf = '', 0, instr(flat, qf)) as p from t) "
    f"select doc_id, cast(case when length(q) < 3 then null when times between 1 and 3 then strlen(substr(text, 1, instr(text, q) - 1)) when times = 0 and p > 0 then {_bytes_before('substr(flat, 1, p - 1)')} end as integer) as byte_start from p",
    "documents",
    holes="byte_start",
)
def x16_anchor(d):
    w = T.words(F.col("text"))
    k = F.col("doc_id") % 3
    needle = F.when(k == 0, F.array_join(F.slice(w, 2, 5), " ")).when(k == 1, F.array_join(F.slice(w, 2, 5), "   ")).otherwise(F.concat(F.substring("text", 1, 1), F.lit(" ")))
    return d.select("doc_id", T.anchor(F.col("text"), needle).alias("byte_start"))


_HEADED = "if(doc_id % 2 = 0, 'Chapter One' || chr(10) || text || chr(10) || '  ## Розділ 2: x' || chr(10) || 'end' || chr(10) || 'partly no heading', text)"


@query(
    f"with h as (select doc_id, t, regexp_extract_all(t, '(?m)^[\\t-\\r ]*(?:#+[\\t-\\r ]*)?(?i:{T.CHAPTERS})(?:[^{T.WORD}\\n\\r][^\\n\\r]*)?$') as f, regexp_split_to_array(t, '(?m)^[\\t-\\r ]*(?:#+[\\t-\\r ]*)?(?i:{T.CHAPTERS})(?:[^{T.WORD}\\n\\r][^\\n\\r]*)?$') as g from (select doc_id, {_HEADED} as t from documents)), "
    "e as (select doc_id, t, unnest(f) as title, generate_subscripts(f, 1) as i, f, g from h where len(f) >= 2) "
    f"select doc_id, cast(i - 1 as integer) as idx, regexp_replace({_strip('title')}, '^[# ]+', '') as title, sha256({_strip('title || g[i + 1]')}) as h from e",
    "documents",
)
def x18_chapters(d):
    """Chapters by headings; each ends where the next begins (W06)."""
    t = d.select("doc_id", F.expr(_HEADED).alias("t"))
    c = t.select("doc_id", "t", F.posexplode(T.chapters(F.col("t"))).alias("idx", "c"))
    return c.select("doc_id", "idx", "c.title", F.sha2(T.strip(F.substring("t", F.col("c.start") + 1, F.col("c.end") - F.col("c.start"))), 256).alias("h"))


@query(f"select doc_id, cast(k as integer) as idx, cast(len(w[k * 3000 + 1:k * 3000 + 3000]) as integer) as word_count, md5(array_to_string(w[k * 3000 + 1:k * 3000 + 3000], ' ')) as h from (select doc_id, w, unnest(range((len(w) + 2999) // 3000)) as k from (select doc_id, {_words('text')} as w from documents))", "documents")
def x19_chunks(d):
    return d.select("doc_id", F.posexplode(T.chunks(F.col("text"))).alias("idx", "w")).select("doc_id", "idx", F.size("w").alias("word_count"), F.md5(F.array_join("w", " ")).alias("h"))


_HTML = "html"
for _p, _b in (
    ("(?is)<script[^>]*>.*?</script>", "''"), ("(?is)<style[^>]*>.*?</style>", "''"), ("(?i)<h1[^>]*>(.*?)</h1>", "concat(chr(10), chr(10), '# \\1', chr(10), chr(10))"), ("(?i)<h2[^>]*>(.*?)</h2>", "concat(chr(10), chr(10), '## \\1', chr(10), chr(10))"),
    ("(?i)<h3[^>]*>(.*?)</h3>", "concat(chr(10), chr(10), '### \\1', chr(10), chr(10))"), ("(?i)<p[^>]*>(.*?)</p>", "concat('\\1', chr(10), chr(10))"), (r"(?i)<br\s*/?>", "chr(10)"), ("<[^>]+>", "''"),
):
    _HTML = f"regexp_replace({_HTML}, '{_p}', {_b}, 'g')"
for _p, _b in (("&nbsp;", "' '"), ("&lt;", "'<'"), ("&gt;", "'>'"), ("&quot;", "chr(34)"), ("&#39;", "chr(39)"), ("&middot;", "'·'"), ("&copy;", "'©'"), ("&amp;", "'&'")):
    _HTML = f"replace({_HTML}, '{_p}', {_b})"
_HTML = _strip(rf"regexp_replace({_HTML}, '\n{{3,}}', chr(10) || chr(10), 'g')")


@query(f"select page_id, md5({_HTML}) as h from pages", "pages")
def x20_html_text(p):
    return p.select("page_id", F.md5(T.html_text("html")).alias("h"))


_ANSWER = """'<think>{}</think>text ```json' || chr(10) || replace(props, '}', ', "list": [1, 2, ], }') || chr(10) || '``` bye'"""


@query("select event_id, cast(json_extract(props, '$.k') as bigint) as k, 2 as n from events", "events")
def x21_rescue_json(e):
    v = F.try_parse_json(T.rescue_json(F.expr(_ANSWER)))
    return e.select("event_id", F.variant_get(v, "$.k", "bigint").alias("k"), F.size(F.variant_get(v, "$.list", "array<int>")).alias("n"))


_CANDIDATES = """case event_id % 4 when 0 then '{"candidates": ["a", "' || event_type || '", "a "]}' when 1 then '{"candidates": []}' when 2 then '{"candidates": ["a", " "]}' else '{"other": 1}' end"""


@query("select event_id, case event_id % 4 when 0 then 'ok' when 1 then 'ok' when 2 then 'invalid_candidates' else 'invalid_candidates' end as status, cast(case event_id % 4 when 0 then 2 when 1 then 0 end as integer) as n from events", "events", holes="n")
def x22_candidates(e):
    """Candidates of a model's answer: a list of non-blank strings, or an error; the distinct ones in order (U06)."""
    c = F.from_json(F.expr(_CANDIDATES), "candidates array<string>").candidates
    ok = c.isNotNull() & F.forall(c, lambda x: ~T.blank(x))
    return e.select("event_id", F.when(ok, "ok").otherwise("invalid_candidates").alias("status"), F.when(ok, F.size(F.array_distinct(F.transform(c, T.strip)))).alias("n"))


@query("select conv_id, array_to_string(list_transform(list_filter(range(1, len(l) + 1), lambda i: list_position(l, l[i]) = i), lambda i: l[i]), ',') as kept from (select conv_id, list(trim(role) order by turn) as l from conversations group by conv_id)", "conversations")
def u06_ordered_distinct(c):
    seq = F.sort_array(F.collect_list(F.struct("turn", F.trim("role").alias("role"))))
    return c.groupBy("conv_id").agg(seq.alias("x")).select("conv_id", F.array_join(F.array_distinct("x.role"), ",").alias("kept"))


# dictionary text: claims made of driver columns
_CLAIM = "case p_partkey % 5 when 0 then 'Словарь Грінченка, т. ІV, с. ' || p_size || ': «' || word || '»' when 1 then 'Грінченко І, ' || p_size || ': за моделлю ' || word when 2 then 'т. 2, с. ' || p_size || ' (' || word || ')' when 3 then 'без посилання на ' || word else 'т. ІІІ, ст. ' || p_size end"
_WORDS = "['вісник', 'Мережа', 'сховище', 'праліс', 'дім', 'Ящик', 'Еxo']"
_CLAIMS = f"(select p_partkey, p_size, word, {_CLAIM} as claim from (select p_partkey, p_size, ({_WORDS})[p_partkey % 7 + 1] as word from part))"


def _claims(p):
    words = F.array(*[F.lit(w) for w in D.SAMPLE])
    return p.select("p_partkey", "p_size", F.get(words, (F.col("p_partkey") % 7).cast("int")).alias("word")).withColumn("claim", F.expr(_CLAIM))


@query(f"select p_partkey, cast(case p_partkey % 5 when 0 then 4 when 1 then 1 when 2 then 2 when 4 then 3 end as integer) as volume, cast(if(p_partkey % 5 = 3, null, p_size) as integer) as page from {_CLAIMS}", "part", holes="volume page")
def x23_citations(p):
    c = _claims(p).select("p_partkey", D.citation(F.col("claim")).alias("c"))
    return c.select("p_partkey", "c.volume", "c.page")


@query(f"select p_partkey, case when word in ('Еxo') then null when p_partkey % 5 in (0, 1, 2) and length(word) >= 3 then word end as headword from {_CLAIMS}", "part")
def x24_headwords(p):
    return _claims(p).select("p_partkey", D.headword(F.col("claim")).alias("headword"))


_VOLUME = "case word when 'вісник' then 1 when 'Мережа' then 2 when 'сховище' then 4 when 'праліс' then 3 when 'дім' then 1 when 'Ящик' then 4 when 'Еxo' then 1 end"


@query(f"select p_partkey, cast({_VOLUME.replace('when ' + chr(39) + 'Еxo' + chr(39) + ' then 1 ', '')} as integer) as volume from {_CLAIMS} where word <> 'Еxo'", "part", holes="volume")
def x25_volumes(p):
    return _claims(p).where("word <> 'Еxo'").select("p_partkey", D.volume_of(F.col("word")).alias("volume"))


@query(f"select p_partkey, case when word is null or claimed is null then 'UNDECIDABLE' when v is null then 'UNDECIDABLE' when v = claimed then 'PLAUSIBLE' else 'CONTRADICTED' end as verdict from (select p_partkey, word, {_VOLUME} as v, if(p_partkey % 5 = 3, null, p_partkey % 4 + 1) as claimed from {_CLAIMS} where word <> 'Еxo')", "part")
def x26_volume_verdicts(p):
    claimed = F.when(F.col("p_partkey") % 5 != 3, (F.col("p_partkey") % 4 + 1).cast("int"))
    return _claims(p).where("word <> 'Еxo'").select("p_partkey", D.volume_verdict(F.col("word"), claimed).alias("verdict"))


@query("select p_partkey, p_name from part where length(strip_accents(p_name)) >= 4 and ends_with(lower(strip_accents(p_name)), 'et') and starts_with(lower(p_name), 'c') and contains(lower(p_name), 'old')", "part")
def x27_affixes(p):
    return D.by_affix(p, F.col("p_name"), suffix="et", prefix="c", contains="old").select("p_partkey", "p_name")


@query("select p_partkey, p_name from part where length(p_name) >= 4 and ends_with(lower(p_name), 'et') order by p_partkey limit 25", "part")
def l10_pattern_search(p):
    return D.by_affix(p, F.col("p_name"), suffix="et").orderBy("p_partkey").limit(25).select("p_partkey", "p_name")


@query("select p_partkey, cast(i as integer) as i, ['Тяжкороб', 'вісник'][i] as word, 4 as volume, cast(p_partkey * 10 as bigint) as byte_start, cast(p_size as bigint) as byte_len from part, (select unnest([1, 2]) as i) where p_partkey % 2 = 0 or i = 1", "part")
def x28_coordinates(p):
    text = F.format_string("«Тяжкороб» (Грінченко, том 4, артефакт %s+%s)", (F.col("p_partkey") * 10).cast("string"), F.col("p_size").cast("string"))
    both = F.when(F.col("p_partkey") % 2 == 0, F.concat(text, F.lit("; "), F.replace(text, F.lit("Тяжкороб"), F.lit("вісник")))).otherwise(text)
    return p.select("p_partkey", F.posexplode(D.coordinates(both)).alias("i", "c")).select("p_partkey", (F.col("i") + 1).alias("i"), "c.*")


@query("select doc_id, 'urn:cts:texts:' || doc_id || ':' || n_chars || '+' || strlen(text) as urn from documents", "documents")
def x29_identifiers(d):
    return d.select("doc_id", F.format_string("urn:cts:texts:%d:%d+%d", "doc_id", "n_chars", F.octet_length("text")).alias("urn"))


@query(
    "with l as (select doc_id, unnest(string_split(t, chr(10))) as line, generate_subscripts(string_split(t, chr(10)), 1) as i from (select doc_id, 'Вісник, -ка, м. x' || chr(10) || text || chr(10) || 'Бездоріжжя, бездорожжя, -жя, с. y' || chr(10) || 'Аминь и амінь, нар. z' as t from documents)), o as (select *, cast(sum(strlen(line) + 1) over (partition by doc_id order by i) - strlen(line) - 1 as bigint) as byte_start from l) "
    f"select doc_id, byte_start, cast(strlen(line) as integer) as byte_len, regexp_extract(line, '{D.ENTRY}', 1) as headword from o where regexp_matches(line, '{D.ENTRY}')",
    "documents",
)
def x31_dictionary_entries(d):
    """Headwords of dictionary lines with the bytes of their lines."""
    t = d.select("doc_id", F.concat(F.lit("Вісник, -ка, м. x\n"), F.col("text"), F.lit("\nБездоріжжя, бездорожжя, -жя, с. y\nАминь и амінь, нар. z")).alias("text"))
    return D.entries(t, "doc_id")


_PROPOSALS = """case p_partkey % 3 when 0 then '[{"variant": "' || p_name || '", "morphemes": "a b"}, {"variant": " "}]' when 1 then '[]' else null end"""


@query("select p_partkey, case p_partkey % 3 when 0 then p_name else p_type end as variant, case p_partkey % 3 when 0 then 'a' else 'traditional' end as root from part where p_partkey % 3 = 0 or p_type <> ''", "part")
def x33_proposals(p):
    return D.proposals(p.select("p_partkey", F.expr(_PROPOSALS).alias("json"), F.col("p_type").alias("traditional"))).select("p_partkey", "variant", "root")


def _edge(at: str, step: int) -> str:
    """A place moved to the next border of a character."""
    inside = lambda k: f"substr(hex(text), 2 * ({at} + {step * k}) + 1, 2) between '80' and 'BF'"
    return f"case when {at} <= 0 then 0 when {at} >= strlen(text) then strlen(text) when not ({inside(0)}) then {at} when not ({inside(1)}) then {at} + {step} when not ({inside(2)}) then {at} + {2 * step} else {at} + {3 * step} end"


@query(f"select doc_id, k, cast({_edge('k', -1)} as integer) as back, cast({_edge('k', 1)} as integer) as forth from (select doc_id, text, unnest([0, 1, 7, 33, 50, 51, 52, 10000000]) as k from documents)", "documents")
def x02_character_borders(d):
    c = F.encode("text", "utf-8")
    at = d.select("doc_id", c.alias("c"), F.explode(F.array(*[F.lit(k) for k in (0, 1, 7, 33, 50, 51, 52, 10000000)])).alias("k"))
    return at.select("doc_id", "k", R.snap(F.col("c"), F.col("k")).alias("back"), R.snap(F.col("c"), F.col("k"), forward=True).alias("forth"))


@query("select doc_id, sha256(unhex(substr(hex(text), 2 * 20 + 1, 2 * 60))) as h, cast(least(60, greatest(0, strlen(text) - 20)) as integer) as n, strlen(text) < 80 as short_read from documents", "documents")
def x44_byte_slices(d):
    part = R.byte_slice(F.encode("text", "utf-8"), F.lit(20), F.lit(60))
    return d.select("doc_id", F.sha2(part, 256).alias("h"), F.octet_length(part).alias("n"), (F.octet_length(part) != 60).alias("short_read"))


def _json(c: str) -> str:
    out = f"replace(replace({c}, '\\', '\\\\'), chr(34), '\\' || chr(34))"
    for i in range(1, 0x20):
        esc = {8: "\\b", 9: "\\t", 10: "\\n", 12: "\\f", 13: "\\r"}.get(i, f"\\u{i:04x}")
        out = f"replace({out}, chr({i}), '{esc}')"
    return f"""'"' || {out} || '"'"""


# every third text has control characters of its own
_SAID = "if(turn % 3 = 0, text || chr(1) || chr(9) || chr(31), text)"


@query(f"""select conv_id, turn, sha256('{{"role": ' || {_json('role')} || ', "text": ' || {_json(_SAID)} || ', "turn": ' || turn || '}}') as digest from conversations""", "conversations")
def x41_canonical_digest(c):
    said = F.when(F.col("turn") % 3 == 0, F.concat("text", F.lit("\x01\t\x1f"))).otherwise(F.col("text"))
    return c.select("conv_id", "turn", F.sha2(R.canonical(turn=F.col("turn").cast("string"), role=R.quoted(F.col("role")), text=R.quoted(said)), 256).alias("digest"))


@query(f"""select p_partkey, 'lex-' || substr(sha256('[' || p_size || ', ' || {_json('p_name')} || ']'), 1, 20) as card, sha256('{{"id": ' || p_partkey || ', "term": ' || {_json('p_name')} || '}}') as revision from part""", "part")
def x42_card_ids(p):
    name = R.quoted(F.col("p_name"))
    return p.select("p_partkey", F.concat(F.lit("lex-"), F.substring(F.sha2(R.listed(F.col("p_size").cast("string"), name), 256), 1, 20)).alias("card"), F.sha2(R.canonical(term=name, id=F.col("p_partkey").cast("string")), 256).alias("revision"))


@query(f"""select doc_id, sha256('[' || doc_id || ', "' || sha256(text) || '", ' || {_json('lower(source)')} || ', "' || sha256(substr(text, 1, 50)) || '"]') as evidence_key from documents""", "documents")
def x43_evidence_keys(d):
    return d.select("doc_id", D.evidence_key(F.col("doc_id"), F.sha2("text", 256), F.col("source"), F.sha2(F.substring("text", 1, 50), 256)).alias("evidence_key"))


@query("select doc_id, greatest(0, n_chars // 10 - 55) as front_end, greatest(0, n_chars - 55) as body_end from documents", "documents")
def x45_zone_shift(d):
    zones = F.array(F.expr("n_chars div 10"), F.col("n_chars"))
    return d.select("doc_id", F.transform(zones, lambda z: F.greatest(F.lit(0), z - 55)).alias("z")).select("doc_id", F.col("z")[0].alias("front_end"), F.col("z")[1].alias("body_end"))


@query(f"select doc_id, len(list_filter(l, lambda w: length(w) < 3)) = 0 as every_long, len(list_filter(l, lambda w: length(w) >= 8)) > 0 as some_long, list_contains(l, 'the') as has_the from (select doc_id, {_words('text')} as l from documents)", "documents")
def x47_array_predicates(d):
    w = T.words(F.col("text"))
    return d.select("doc_id", F.forall(w, lambda x: F.length(x) >= 3).alias("every_long"), F.exists(w, lambda x: F.length(x) >= 8).alias("some_long"), F.array_contains(w, "the").alias("has_the"))


@query("select o_orderkey, round(least(100.0, greatest(50.0, cast(o_totalprice as double) / 4096)), 2) as score from orders", "orders")
def x48_clip_and_round(o):
    return o.select("o_orderkey", F.round(F.least(F.lit(100.0), F.greatest(F.lit(50.0), F.col("o_totalprice") / 4096)), 2).alias("score"))


@query("select doc_id, count(*) as n, cast(sum(length(line)) as bigint) as chars from (select doc_id, unnest(string_split(text, chr(10))) as line from documents) where length(" + _strip("line") + rf") >= 3 and not regexp_matches({_strip('line')}, '{T.BOILERPLATE}') group by doc_id", "documents")
def f10_boilerplate_lines(d):
    line = d.select("doc_id", F.explode(T.lines("text")).alias("line"))
    return line.where((F.length(T.strip("line")) >= 3) & ~T.strip("line").rlike(T.BOILERPLATE)).groupBy("doc_id").agg(F.count("*").alias("n"), F.sum(F.length("line")).alias("chars"))


_LINES = f"with l as (select doc_id, unnest(string_split(text, chr(10))) as line, generate_subscripts(string_split(text, chr(10)), 1) as i from documents), o as (select *, cast(sum(strlen(line) + 1) over (partition by doc_id order by i) - strlen(line) - 1 as bigint) as byte_offset from l), k as (select *, row_number() over (partition by doc_id order by i) as up, row_number() over (partition by doc_id order by i desc) as down, count(*) over (partition by doc_id) as n from o where length({_strip('line')}) >= 3 and not regexp_matches({_strip('line')}, '{T.BOILERPLATE}'))"


@query(_LINES + f" select doc_id, 'head' as side, cast(up - 1 as integer) as idx, byte_offset, substr({_strip('line')}, 1, 160) as line from k where up <= 220 union all select doc_id, 'tail', cast(up - 1 - greatest(0, n - 220) as integer), byte_offset, substr({_strip('line')}, 1, 160) from k where down <= 220", "documents")
def l11_boundary_candidates(d):
    """The first and the last lines that may be a border of the text proper, numbered anew."""
    return D.boundary_lines(d, "doc_id", 220, False).unionByName(D.boundary_lines(d, "doc_id", 220, True))
