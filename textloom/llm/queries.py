"""The registered queries of the corpus operators: thin digests of their results."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import align, backtrack, bpe, decontaminate, fim, langid, lines, secret_scan, simhash, substrings, tokens, topk, toxicity
from .common import table


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = lines.dedup_lines(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("kept", 256).alias("kept_sha256"))


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = simhash.near_groups(table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substrings.drop_repeats(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op7_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"))


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.flag_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return langid.predict(docs, langid.train(docs))


def op10_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = secret_scan.scan_documents(table(spark, sf_dir, "documents"))
    base = F.filter("spans", lambda s: s.kind.isin("assign", "access", "hex"))
    count = lambda k: F.size(F.filter("spans", lambda s: s.kind == k)).cast("long").alias(f"n_{k}")
    said = lambda a: F.array_join(F.transform(a, lambda s: F.concat_ws(":", s.kind, s.start.cast("string"), s.end.cast("string"))), ",")
    return out.select("doc_id", count("assign"), count("access"), count("hex"), F.sha2(said(base), 256).alias("base_sha256"), said(F.col("spans")).alias("spans"))


def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = fim.fill_in_middle(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n", "form", F.col("prefix_units").alias("prefix_chars"), F.col("middle_units").alias("middle_chars"), F.sha2("output", 256).alias("output_sha256"), F.sha2(fim.restored(), 256).alias("restored_sha256"))


def op12_backtracking_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return backtrack.encode_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op13_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = align.align_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))
    return out.select("doc_id", "n_a", "n_b", "n_groups", "n_links", F.col("n_best_a").alias("n_best"), "count_sum", F.col("groups").alias("groups_sha256"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_line_dedup, op2_token_counts, op3_simhash, op4_toxicity, op5_bpe, op6_substring_dedup, op7_top_k, op8_decontaminate, op9_language_id, op10_secrets, op11_fill_in_middle, op12_backtracking_bpe, op13_token_alignment)}

# Matches and the gaps between them give the places.  Of the checksum kind, 30 characters and the base-62 CRC-32
# of them, folded bit by bit.
_ANY = lambda w: "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in w)
_KEYS = "|".join([*map(_ANY, ("password", "passwd", "secret", "token")), f"{_ANY('api')}_?{_ANY('key')}"])
_RULES = (
    ("assign", rf"(?:{_KEYS})[\x22\x27]?\x20*[:=]\x20*[\x22\x27]?[A-Za-z0-9+/_.=-]+", rf"length(regexp_extract(m, '(?:{_KEYS})[\x22\x27]?\x20*[:=]\x20*[\x22\x27]?([A-Za-z0-9+/_.=-]+)', 1)) >= 6"),
    ("access", "AKIA[A-Z0-9]+", "length(m) >= 20"),
    ("hex", "[0-9a-f]+", "length(m) >= 24"),
    ("github", "(?:gh[pousr]|npm)_[A-Za-z0-9]{36}(?:[^A-Za-z0-9]|$)", "crc = said"),
)
_BITS = "flatten(list_transform(string_split(body, ''), lambda c: list_transform(range(8), lambda k: (ascii(c) >> k) & 1)))"
_CRC = f"xor(4294967295, list_reduce(list_prepend(cast(4294967295 as bigint), {_BITS}), lambda c, b: if(xor(c, b) & 1 = 1, xor(c >> 1, 3988292384), c >> 1)))"
_SAID = "list_reduce(list_prepend(cast(0 as bigint), list_transform(string_split(sign, ''), lambda c: cast(instr('0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz', c) - 1 as bigint))), lambda s, d: s * 62 + d)"


def _found(kind: str, rule: str, ok: str, order: int) -> str:
    every = f"select r, unnest(ms) as m, generate_subscripts(ms, 1) as i, gs, ms from (select r, regexp_extract_all(t, '{rule}') as ms, regexp_split_to_array(t, '{rule}') as gs from d where regexp_matches(t, '{rule}'))"
    spot = f"select r, m, length(array_to_string(gs[1:i], '')) + length(array_to_string(ms[1:i - 1], '')) as a from ({every})"
    if kind == "github":
        cut = "m[instr(m, '_') + 1:instr(m, '_') + 30] as body, m[instr(m, '_') + 31:instr(m, '_') + 36] as sign, m[1:instr(m, '_') + 36] as m"
        spot = f"select r, m, a, {_CRC} as crc, {_SAID} as said from (select r, a, {cut} from ({spot}))"
    return f"select r, '{kind}' as kind, {order} as o, a, a + length(m) as e from ({spot}) where {ok}"


_SECRETS = (
    "with d as (select row_number() over () as r, doc_id, coalesce(text, '') as t from documents), "
    + "s as (" + " union all ".join(_found(*x, i) for i, x in enumerate(_RULES)) + "), "
    + "x as (select r, count(*) filter (kind = 'assign') as n_assign, count(*) filter (kind = 'access') as n_access, count(*) filter (kind = 'hex') as n_hex, string_agg(kind || ':' || a || ':' || e, ',' order by a, o) filter (o < 3) as base, string_agg(kind || ':' || a || ':' || e, ',' order by a, o) as spans from s group by r) "
    + "select d.doc_id, coalesce(n_assign, 0) as n_assign, coalesce(n_access, 0) as n_access, coalesce(n_hex, 0) as n_hex, sha256(coalesce(base, '')) as base_sha256, coalesce(spans, '') as spans from d left join x using (r)"
)

_WS = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
ORACLES: dict[str, str] = {
    "op1_line_dedup": f"""
with l as (select doc_id, i, line, translate(trim(line, {_WS}), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as k
           from (select doc_id, unnest(string_split(coalesce(text, ''), chr(10))) as line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) as i from documents)),
     d as (select k, min(doc_id) as low from l where length(k) >= 10 group by k having count(distinct doc_id) > 1),
     m as (select l.*, coalesce(l.doc_id <> d.low, false) as gone from l left join d using (k))
select doc_id, count(*) as n_lines, count(*) filter (gone) as n_dropped,
       sha256(coalesce(string_agg(line, chr(10) order by i) filter (not gone), '')) as kept_sha256
from m group by doc_id""",
    "op7_top_k": """
with v as (select row_number() over () as r, vec_id, list_transform(embedding, lambda x: cast(floor(256 * cast(x as double)) as bigint)) as v from embeddings
           where vec_id is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
     s as (select q.r, q.vec_id as query_id, c.vec_id, cast(coalesce(list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2])), 0) as bigint) as score
           from v q, v c where q.vec_id % 50 = 0 and c.r <> q.r),
     r as (select *, cast(row_number() over (partition by r order by score desc, vec_id) as integer) as rank from s)
select query_id, rank, vec_id, score from r where rank <= 5""",
    "op6_substring_dedup": r"""
with d as (select row_number() over () as r, doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') as ws from documents),
     w as (select r, unnest(range(1, len(ws) - 33)) as i, ws from d),
     g as (select r, i, array_to_string(ws[i:i + 34], ' ') as g from w),
     s as (select r, i from g semi join (select g from g group by g having count(*) > 1) using (g)),
     c as (select distinct r, unnest(range(i, i + 35)) as j from s),
     x as (select d.r, d.doc_id, unnest(ws) as word, generate_subscripts(ws, 1) as j from d),
     k as (select x.r, count(*) as n, count(c.j) as gone, string_agg(word, ' ' order by x.j) filter (c.j is null) as kept from x left join c on c.r = x.r and c.j = x.j group by x.r)
select d.doc_id, coalesce(n, 0) as n_words, coalesce(gone, 0) as n_removed, sha256(coalesce(kept, '')) as kept_sha256 from d left join k using (r)""",
    "op10_secrets": _SECRETS,
    "op11_fill_in_middle": """
with d as (select doc_id, coalesce(text, '') as t, length(coalesce(text, '')) as n, sha256('1:' || coalesce(cast(doc_id as varchar), 'null')) as h from documents),
     r as (select *, cast('0x' || h[1:8] as bigint) % (n + 1) as u, cast('0x' || h[9:16] as bigint) % (n + 1) as v,
                  n = 0 or contains(t, '<P>') or contains(t, '<S>') or contains(t, '<M>') or cast('0x' || h[17:24] as bigint) % 100 >= 90 as plain,
                  cast('0x' || h[25:32] as bigint) % 100 < 20 as spm from d),
     s as (select *, least(u, v) as a, abs(u - v) as m from r),
     c as (select *, substring(t, 1, a) as x, substring(t, a + 1, m) as y, substring(t, a + m + 1, n) as z from s)
select doc_id, n, case when plain then 'plain' when spm then 'spm' else 'psm' end as form,
       if(plain, null, a) as prefix_chars, if(plain, null, m) as middle_chars,
       sha256(case when plain then t when spm then '<S>' || z || '<P>' || x || '<M>' || y else '<P>' || x || '<S>' || z || '<M>' || y end) as output_sha256,
       sha256(t) as restored_sha256 from c""",
}
