"""Registered queries of the catalogue: filters, joins, aggregates, order, sets and writes on rows."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from textloom.functions import raw as R
from textloom.functions import text as T
from textloom.operators import catalogue as C
from textloom.operators import dictionary as D
from textloom.operators import evidence as E
from textloom.operators import fulltext as FT
from textloom.operators import merkle as MK
from textloom.plans.registry import query
from textloom.sources.writers import catalogue_line, checked_copy, package


# filters and projections
@query("select o_orderkey, o_totalprice from orders where o_orderstatus = 'F'", "orders")
def f04_flag_filter(o):
    flagged = o.withColumn("has_full_text", F.col("o_orderstatus") == "F")
    return flagged.where("has_full_text").select("o_orderkey", "o_totalprice")


@query("select p_partkey, p_retailprice from part where p_retailprice >= 901 and p_size > 20 and (contains(lower(p_name), 'ol') or contains(lower(p_brand), 'ol') or contains(lower(p_type), 'ol') or contains(cast(p_partkey as varchar), 'ol'))", "part")
def f05_conjunctive(p):
    needle = F.lit("ol")
    named = [F.lower(F.col(c).cast("string")).contains(needle) for c in ("p_name", "p_brand", "p_type", "p_partkey")]
    return p.where((F.col("p_retailprice") >= 901) & (F.col("p_size") > 20) & (named[0] | named[1] | named[2] | named[3])).select("p_partkey", "p_retailprice")


@query("select o_orderkey, o_orderstatus from orders where o_orderstatus in ('O', 'P') and exists (select 1 from documents where doc_id = o_orderkey)", "orders", "documents")
def f06_membership(o, d):
    return o.where(F.col("o_orderstatus").isin("O", "P")).join(d.select(F.col("doc_id").alias("o_orderkey")), "o_orderkey", "left_semi").select("o_orderkey", "o_orderstatus")


_REGISTER = "case l_returnflag when 'A' then 'attested' when 'N' then 'proposed' else 'external' end"


@query(
    f"select register, l_orderkey, l_linenumber, if(register = 'attested', l_quantity, null) as witness, if(register = 'proposed', l_partkey, null) as proposed, if(register = 'external', l_suppkey, null) as authority from (select *, {_REGISTER} as register from lineitem)",
    "lineitem",
    holes="proposed authority",
)
def f07_register_routing(li):
    rows = li.select("l_orderkey", "l_linenumber", F.expr(_REGISTER).alias("register"), F.col("l_quantity").alias("witness"), F.col("l_partkey").alias("proposed"), F.col("l_suppkey").alias("authority"))
    key = ["l_orderkey", "l_linenumber"]
    return C.routed(rows, "register", {"attested": [*key, "witness"], "proposed": [*key, "proposed"], "external": [*key, "authority"]})


@query("select l_orderkey, l_linenumber from lineitem where l_returnflag = 'A' and l_linestatus = 'F' and l_shipdate is not null", "lineitem")
def f08_body_only(li):
    return li.where("l_returnflag = 'A' and l_linestatus = 'F' and l_shipdate is not null").select("l_orderkey", "l_linenumber")


_TRIM = "chr(39) || '\"`.,:;!?'"


@query(f"with c as (select distinct trim(trim(w), {_TRIM}) as c from (select unnest(string_split(text, ' ')) as w from benchmark)) select c as candidate from c where length(c) > 2 and lower(c) not in (select lower(trim(trim(w), {_TRIM})) from (select unnest(string_split(text, ' ')) as w from benchmark where item_id % 10 = 0))", "benchmark")
def f09_candidates(b):
    """Words without quotes and stops, longer than two letters, that are not among those attested already."""
    words = b.select("item_id", F.explode(F.split("text", " ")).alias("w")).select("item_id", F.btrim(F.trim("w"), F.lit("'\"`.,:;!?")).alias("candidate"))
    known = words.where("item_id % 10 = 0").select(F.lower("candidate").alias("low"))
    c = words.select("candidate").where("length(candidate) > 2").distinct()
    return c.withColumn("low", F.lower("candidate")).join(known, "low", "left_anti").select("candidate")


@query("with l as (select o_custkey, arg_max(o_orderstatus, o_orderkey) as action from orders group by o_custkey) select c_custkey, coalesce(action, 'pending') as status from customer left join nation on c_nationkey = n_nationkey left join l on o_custkey = c_custkey where contains(lower(concat_ws(' ', c_name, c_mktsegment, n_name)), 'in') and list_contains(['BUILDING', 'MACHINERY'], c_mktsegment) and coalesce(action, 'pending') in ('O', 'pending')", "customer", "nation", "orders")
def f12_interface_search(c, n, o):
    """Text in any shown field, a category, and the status of the last decision."""
    last = C.latest(o.select("o_custkey", "o_orderkey", "o_orderstatus"), ["o_custkey"], "o_orderkey").select("o_custkey", F.col("o_orderstatus").alias("action"))
    every = c.join(F.broadcast(n), c.c_nationkey == n.n_nationkey, "left").join(last, F.col("o_custkey") == F.col("c_custkey"), "left")  # a table of nations
    status = F.coalesce("action", F.lit("pending"))
    shown = every.where(F.lower(F.concat_ws(" ", "c_name", "c_mktsegment", "n_name")).contains("in") & F.array_contains(F.array(F.lit("BUILDING"), F.lit("MACHINERY")), F.col("c_mktsegment")))
    return shown.where(status.isin("O", "pending")).select("c_custkey", status.alias("status"))


@query("select event_id, cast(json_extract(coalesce(nullif(if(event_id % 5 = 0, '', props), ''), '{}'), '$.k') as bigint) as k, event_type as kind from events", "events", holes="k")
def f13_decoded_projection(e):
    raw = F.when(F.col("event_id") % 5 == 0, "").otherwise(F.col("props"))
    return e.select("event_id", F.from_json(F.coalesce(F.nullif(raw, F.lit("")), F.lit("{}")), "k bigint").k.alias("k"), F.col("event_type").alias("kind"))


@query("select p_partkey, printf('%.1f', p_retailprice) as score, if(p_size > 25, 'yes', 'pending') as text, p_name || ' (' || p_brand || ')' as title from part", "part")
def f14_formatted(p):
    return p.select("p_partkey", F.format_string("%.1f", "p_retailprice").alias("score"), F.when(F.col("p_size") > 25, "yes").otherwise("pending").alias("text"), F.format_string("%s (%s)", "p_name", "p_brand").alias("title"))


@query("select event_id, ts, user_id, event_type, value, length(props) as size, cast(json_extract(props, '$.k') as bigint) as k from events order by event_id desc limit 15", "events")
def f15_log_projection(e):
    last = e.orderBy(F.desc("event_id")).limit(15)
    return last.select("event_id", "ts", "user_id", "event_type", "value", F.length("props").cast("long").alias("size"), F.from_json("props", "k bigint").k.alias("k"))


@query(f"select doc_id from documents where length(regexp_replace(regexp_replace(text, '^{T.SPACE}', ''), '{T.SPACE}$', '')) > 200", "documents")
def f16_length(d):
    return d.where(F.length(T.strip("text")) > 200).select("doc_id")


# joins
_EARLY = "(select l_partkey, min(year(l_shipdate)) as earliest_year, count(*) as n from lineitem where l_returnflag = 'N' group by l_partkey)"


@query(f"select l_orderkey, l_linenumber, e.earliest_year, c_name from lineitem t left join {_EARLY} e using (l_partkey) join orders on o_orderkey = l_orderkey join customer on c_custkey = o_custkey", "lineitem", "orders", "customer", holes="earliest_year")
def j02_terms_with_earliest(li, o, c):
    """Terms with their earliest year, or null, and always their work and its author."""
    early = li.where("l_returnflag = 'N'").groupBy("l_partkey").agg(F.min(F.year("l_shipdate")).cast("long").alias("earliest_year"))
    every = li.select("l_orderkey", "l_linenumber", "l_partkey").join(early, "l_partkey", "left").join(o, o.o_orderkey == F.col("l_orderkey")).join(c, c.c_custkey == F.col("o_custkey"))
    return every.select("l_orderkey", "l_linenumber", "earliest_year", "c_name")


@query(f"select l_orderkey, l_linenumber, cast(coalesce(e.earliest_year, 9999) as bigint) as year from lineitem left join {_EARLY} e using (l_partkey) order by year, l_orderkey, l_linenumber limit 60", "lineitem")
def l02_earliest_first(li):
    early = li.where("l_returnflag = 'N'").groupBy("l_partkey").agg(F.min(F.year("l_shipdate")).cast("long").alias("y"))
    every = li.join(early, "l_partkey", "left").select("l_orderkey", "l_linenumber", F.coalesce("y", F.lit(9999).cast("long")).alias("year"))
    return every.orderBy("year", "l_orderkey", "l_linenumber").limit(60)


_TOK = "regexp_extract_all(strip_accents(lower(text)), '[\\p{L}\\p{N}]+')"
_MATCH = f"(select doc_id, n_chars from documents where list_contains({_TOK}, 'the') and len(list_filter({_TOK}, lambda w: starts_with(w, 'an'))) > 0 and contains(' ' || array_to_string({_TOK}, ' ') || ' ', ' is and '))"


@query(f"select doc_id, n_chars from {_MATCH}", "documents")
def j04_search(d):
    """Full-text match joined back to its rows (X30 is the match: words, a phrase and a prefix)."""
    return d.join(C.search(d, "doc_id", ["text", "source"], '"is and" the an*'), "doc_id", "left_semi").select("doc_id", "n_chars")


@query(f"select doc_id as key from {_MATCH}", "documents")
def x30_index_match(d):
    """The same match by postings: places of the query's own words are intersected, texts are not looked at again."""
    return FT.found(FT.postings(d, "doc_id", ["text", "source"]), '"is and" the an*')


@query(f"select doc_id, n_chars from {_MATCH} order by n_chars desc, doc_id limit 20", "documents")
def l03_search_by_score(d):
    """Matches by the score that is stored, not by how well they match."""
    return d.join(C.search(d, "doc_id", ["text"], '"is and" the an*'), "doc_id", "left_semi").select("doc_id", "n_chars").orderBy(F.desc("n_chars"), "doc_id").limit(20)


@query("select w.word, min(p_partkey * 10) as byte_start, count(*) as n_entries from (select distinct upper(p_name) as word from part) w join part on lower(p_name) = lower(w.word) group by w.word", "part")
def j10_headword_lookup(p):
    entries = p.select(F.col("p_name").alias("headword"), (F.col("p_partkey") * 10).alias("byte_start"))
    asked = p.select(F.upper("p_name").alias("word")).distinct().withColumn("form", T.old_orthography(F.col("word")))
    return asked.join(D.index(entries), "form").select("word", "entry.byte_start", "n_entries")


_KNOWN = "select distinct l_orderkey, l_suppkey, lower(l_returnflag) as term from lineitem where l_linenumber = 1"


@query(f"select l_orderkey, l_suppkey, l_returnflag, l_linenumber from (select *, row_number() over (partition by l_orderkey, l_suppkey, lower(l_returnflag) order by l_linenumber) as r from lineitem where l_linenumber > 1) x where r = 1 and not exists (select 1 from ({_KNOWN}) k where k.l_orderkey = x.l_orderkey and k.l_suppkey = x.l_suppkey and k.term = lower(x.l_returnflag))", "lineitem")
def j11_new_evidence(li):
    """Rows whose key is not known, the first of each key in the batch (W02)."""
    rows = li.select("l_orderkey", "l_suppkey", "l_returnflag", "l_linenumber", F.lower("l_returnflag").alias("term"))
    return C.ignore_known(rows.where("l_linenumber > 1"), rows.where("l_linenumber = 1"), ["l_orderkey", "l_suppkey", "term"], ["l_linenumber"]).drop("term")


_SUPPLIED = "(select l_orderkey, list(distinct l_suppkey) as held from lineitem group by l_orderkey)"
_CHOICES = "(select l_orderkey, l_suppkey + l_linenumber % 2 as src, l_partkey as value, l_linenumber as ord from lineitem where l_linenumber <= 3)"


@query(f"select a.l_orderkey, (select arg_max(value, row(ord, src, value)) from {_CHOICES} c where c.l_orderkey = a.l_orderkey and list_contains(a.held, c.src)) as value from {_SUPPLIED} a", "lineitem", holes="value")
def j12_preferred(li):
    """Cards with the last choice made for them whose source is among their attestations."""
    cards = li.groupBy("l_orderkey").agg(F.collect_set("l_suppkey").alias("held"))
    choices = li.where("l_linenumber <= 3").select("l_orderkey", (F.col("l_suppkey") + F.col("l_linenumber") % 2).alias("src"), F.col("l_partkey").alias("value"), F.col("l_linenumber").alias("ord"))
    return C.choose(cards, choices, ["l_orderkey"], "src", "held", "ord").select("l_orderkey", F.col("chosen.value").alias("value"))


@query(f"select a.l_orderkey, (select arg_max(l_returnflag, row(l_linenumber, l_suppkey, l_returnflag)) from lineitem c where c.l_orderkey = a.l_orderkey and list_contains(a.held, c.l_suppkey) and c.l_linestatus = 'F') as kind from {_SUPPLIED} a", "lineitem")
def j13_taxonomy(li):
    cards = li.groupBy("l_orderkey").agg(F.collect_set("l_suppkey").alias("held"))
    kinds = li.where("l_linestatus = 'F'").select("l_orderkey", "l_suppkey", F.col("l_returnflag").alias("value"), "l_linenumber")
    return C.choose(cards, kinds, ["l_orderkey"], "l_suppkey", "held", "l_linenumber").select("l_orderkey", F.col("chosen.value").alias("kind"))


_K16 = "substring(sha256('review.v1:' || {}), 1, 16)"


@query(f"select d.doc_id, {_K16.format('d.doc_id')} as k, l.quality, c.excerpts from documents d left join labels l using (doc_id) left join (select conv_id, count(*) as excerpts from conversations group by conv_id) c on c.conv_id = l.doc_id", "documents", "labels", "conversations", holes="quality excerpts")
def j14_reviews_and_contexts(d, lab, c):
    """Proposals with the decision of their computed key, if any, and that key's contexts, if any."""
    key = lambda x: F.substring(F.sha2(F.concat(F.lit("review.v1:"), x.cast("string")), 256), 1, 16)
    decided = lab.select(key(F.col("doc_id")).alias("k"), "quality", F.lit(True).alias("decided"))
    contexts = c.groupBy(key(F.col("conv_id")).alias("k")).agg(F.count("*").alias("excerpts"))
    every = d.select("doc_id", key(F.col("doc_id")).alias("k")).join(decided, "k", "left").join(contexts, "k", "left")
    return every.select("doc_id", "k", "quality", F.when(F.col("decided"), F.col("excerpts")).alias("excerpts"))


_DRAFT = "case when x.l_orderkey is not null then 'excluded_by_draft_scope' when r.l_orderkey is null then 'unmapped_review_required' when r.l_returnflag = s.l_returnflag then 'category_matches_draft' else 'category_conflicts_with_draft' end"


@query(f"select s.l_orderkey, s.l_linenumber, {_DRAFT} as decision from lineitem s left join lineitem r on r.l_orderkey = s.l_orderkey and r.l_linenumber = s.l_linenumber + 1 left join (select l_orderkey, l_linenumber from lineitem where l_quantity > 40) x on x.l_orderkey = s.l_orderkey and x.l_linenumber = s.l_linenumber", "lineitem")
def j15_draft_reference(li):
    """Scene and name against the draft reference, exclusions first (M19 is the decision)."""
    key = ["l_orderkey", "l_linenumber"]
    ref = li.select("l_orderkey", (F.col("l_linenumber") - 1).alias("l_linenumber"), F.col("l_returnflag").alias("ref"))
    out = li.where("l_quantity > 40").select(*key, F.lit(True).alias("out"))
    decision = F.when(F.col("out"), "excluded_by_draft_scope").when(F.col("ref").isNull(), "unmapped_review_required").when(F.col("ref") == F.col("l_returnflag"), "category_matches_draft").otherwise("category_conflicts_with_draft")
    return li.join(ref, key, "left").join(out, key, "left").select(*key, decision.alias("decision"))


@query(f"select decision, count(*) as n from (select {_DRAFT} as decision from lineitem s left join lineitem r on r.l_orderkey = s.l_orderkey and r.l_linenumber = s.l_linenumber + 1 left join (select l_orderkey, l_linenumber from lineitem where l_quantity > 40) x on x.l_orderkey = s.l_orderkey and x.l_linenumber = s.l_linenumber) group by decision", "lineitem")
def a16_replay_summary(li):
    return j15_draft_reference(li).groupBy("decision").agg(F.count("*").alias("n"))


@query("select l_orderkey, a.l_quantity as first, b.l_quantity as second from lineitem a join lineitem b using (l_orderkey) where a.l_linenumber = 1 and b.l_linenumber = 2", "lineitem")
def j16_paired_forms(li):
    a, b = (li.where(f"l_linenumber = {k}").select("l_orderkey", F.col("l_quantity").alias(n)) for k, n in ((1, "first"), (2, "second")))
    return a.join(b, "l_orderkey")


@query("with k as (select l_linenumber as n, list(l_orderkey order by l_orderkey) as l from lineitem group by l_linenumber) select a.n, a.l = b.l as same_items from k a join k b on b.n = a.n + 1", "lineitem")
def u03_same_items(li):
    """Whether two forms hold the same items: keys of one of the two alone are counted."""
    keys = li.select(F.col("l_linenumber").alias("n"), "l_orderkey").distinct()
    both = keys.union(keys.select(F.col("n") - 1, "l_orderkey")).groupBy("n", "l_orderkey").agg(F.count("*").alias("times"))
    pairs = keys.select("n").distinct().join(keys.select((F.col("n") - 1).alias("n")).distinct(), "n")
    return both.groupBy("n").agg((F.count_if(F.col("times") != 2) == 0).alias("same_items")).join(pairs, "n").select("n", "same_items")


@query("with i as (select s_name as slug, s_suppkey as r from supplier union all select c_name, c_custkey + 1000000 from customer where c_custkey % 2 = 0), f as (select slug, row_number() over (order by substring(md5(slug), 1, 3), slug) as n from (select distinct slug from i) where slug not in (select c_name from customer)) select i.r, coalesce(c.id, f.n + m.top) as id, c.id is null as is_new from i left join (select c_name, min(c_custkey) as id from customer group by c_name) c on c_name = slug left join f using (slug), (select max(c_custkey) as top from customer) m", "supplier", "customer")
def j18_resolved_keys(s, c):
    incoming = s.select(F.col("s_name").alias("slug"), F.col("s_suppkey").alias("r")).union(c.where("c_custkey % 2 = 0").select("c_name", F.col("c_custkey") + 1000000))
    known = c.select(F.col("c_name").alias("slug"), F.col("c_custkey").alias("id"))
    return C.resolve(incoming, known, "slug", "id").select("r", "id", "is_new")


# aggregates
@query("select 'customers' as what, count(*) as n from customer union all select 'orders', count(*) from orders union all select 'orders_done', count(*) from orders where o_orderstatus = 'F' union all select 'rows', count(*) from lineitem union all select 'events', count(*) from events", "customer", "orders", "lineitem", "events")
def a02_global_stats(c, o, li, e):
    one = lambda df, *names: df.agg(*[x.alias(n) for n, x in names]).unpivot([], [n for n, _ in names], "what", "n")
    n = F.count("*")
    every = [one(c, ("customers", n)), one(o, ("orders", n), ("orders_done", F.count_if(F.col("o_orderstatus") == "F"))), one(li, ("rows", n)), one(e, ("events", n))]
    return every[0].union(every[1]).union(every[2]).union(every[3])


@query("select count(*) as total, count(*) filter (o_orderstatus = 'F') as verified, count(*) filter (o_orderpriority = '1-URGENT') as in_copyright, count(*) filter (o_orderstatus = 'P' and o_orderpriority <> '1-URGENT') as not_found from orders", "orders")
def a03_report_counters(o):
    s, p = F.col("o_orderstatus"), F.col("o_orderpriority")
    return o.agg(F.count("*").alias("total"), F.count_if(s == "F").alias("verified"), F.count_if(p == "1-URGENT").alias("in_copyright"), F.count_if((s == "P") & (p != "1-URGENT")).alias("not_found"))


_DONE = "(select doc_id, s as start, least(s + 800, n_chars) as stop from (select doc_id, n_chars, unnest(range(0, greatest(0, cast(ceil((n_chars - 100) / 700.0) as bigint) - 1) * 700 + 1, 700)) as s from documents where n_chars > 0) where (s // 700) % 3 <> 1)"
_UNION = f"(select doc_id, sum(greatest(0, stop - greatest(start, coalesce(before, start)))) as covered from (select *, max(stop) over (partition by doc_id order by start rows between unbounded preceding and 1 preceding) as before from {_DONE}) group by doc_id)"


def _done(d):
    return E.windows(d, "n_chars", 800, 100).where("(start div 700) % 3 <> 1")


@query(f"select doc_id, cast(list_sum(list_transform(list_filter(range(0, n), lambda i: len(list_filter(spans, lambda w: w.start <= i * 100 and i * 100 < w.stop)) > 0), lambda i: least(100, n_chars - i * 100))) as bigint) as covered from (select doc_id, n_chars, cast(ceil(n_chars / 100.0) as bigint) as n, list(struct_pack(start := start, stop := stop)) as spans from {_DONE} join documents using (doc_id) group by doc_id, n_chars)", "documents")
def a06_interval_union(d):
    """Size of the union of done windows, every third left out; the SQL counts covered hundreds instead."""
    return E.covered(_done(d), "doc_id")


@query(f"select doc_id, cast(covered as double) / n_chars as coverage, covered = n_chars as complete from {_UNION} join documents using (doc_id)", "documents")
def a07_coverage(d):
    c = E.covered(_done(d), "doc_id").join(d.select("doc_id", "n_chars"), "doc_id")
    return c.select("doc_id", (F.col("covered").cast("double") / F.col("n_chars")).alias("coverage"), (F.col("covered") == F.col("n_chars")).alias("complete"))


_ROWS = f"(select l_orderkey * 10 + l_linenumber as id, '  ' || upper(l_linestatus) || ' ' as term, l_orderkey as work_id, {_REGISTER} as register, year(l_shipdate) as year, if(l_quantity > 25, 'q' || l_partkey, null) as quote, 'v' || l_suppkey as variant, 'a' || l_suppkey as authority from lineitem)"
_TERMS = "(select o_orderstatus as term, o_orderkey as work_id, o_orderpriority as definition from orders)"
_CARDS = f"(select coalesce(t.k, r.k) as key, coalesce(t.work_id, r.work_id) as work_id, t.definition, r.* exclude (k, work_id) from (select distinct lower(trim(term)) as k, work_id, definition from {_TERMS}) t full join (select lower(trim(term)) as k, work_id, count(*) filter (register = 'attested') as n_attested, count(*) filter (register = 'attested' and quote is not null) as n_verified, string_agg(variant, ',' order by id, variant) filter (register = 'proposed') as variants, count(*) filter (register = 'external') as n_external, min(year) filter (register = 'attested' and quote is not null) as earliest from {_ROWS} group by 1, 2) r on t.k = r.k and t.work_id = r.work_id)"


def _cards(li, o):
    rows = li.select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), F.concat(F.lit("  "), F.upper("l_linestatus"), F.lit(" ")).alias("term"), F.col("l_orderkey").alias("work_id"), F.expr(_REGISTER).alias("register"), F.year("l_shipdate").alias("year"), F.when(F.col("l_quantity") > 25, F.concat(F.lit("q"), F.col("l_partkey").cast("string"))).alias("quote"), F.concat(F.lit("v"), F.col("l_suppkey").cast("string")).alias("variant"), F.concat(F.lit("a"), F.col("l_suppkey").cast("string")).alias("authority"))
    return C.cards(o.select(F.col("o_orderstatus").alias("term"), F.col("o_orderkey").alias("work_id"), F.col("o_orderpriority").alias("definition")), rows)


@query(f"select key, work_id, definition, coalesce(n_attested, 0) as n_attested, coalesce(n_external, 0) as n_external, coalesce(variants, '') as variants from {_CARDS}", "lineitem", "orders")
def u01_cards(li, o):
    """Cards of terms and of three registers, merged on folded term and work."""
    return _cards(li, o).select("key", "work_id", "definition", F.size("attestations").cast("long").alias("n_attested"), F.size("external").cast("long").alias("n_external"), F.array_join("proposals.variant", ",").alias("variants"))


@query(f"select key, work_id, cast(earliest as bigint) as earliest from {_CARDS}", "lineitem", "orders", holes="earliest")
def a08_earliest_verified(li, o):
    return _cards(li, o).select("key", "work_id", F.col("earliest").cast("long").alias("earliest"))


@query(f"select count(*) as cards, cast(sum(coalesce(n_attested, 0)) as bigint) as attestations, cast(sum(coalesce(n_verified, 0)) as bigint) as byte_verified, cast(sum(coalesce(len(string_split(variants, ',')), 0)) as bigint) as proposals from {_CARDS}", "lineitem", "orders")
def a09_snapshot_counts(li, o):
    return C.snapshot_counts(_cards(li, o))


@query(f"select key, work_id from {_CARDS} order by key, coalesce(work_id, -1) limit 100", "lineitem", "orders")
def l07_card_order(li, o):
    return _cards(li, o).select("key", "work_id").orderBy("key", F.coalesce("work_id", F.lit(-1))).limit(100)


@query(f"select key, work_id, 'lex' as source from {_CARDS} union all select lower(n_name), n_nationkey, 'world' from nation where n_regionkey in (1, 2)", "lineitem", "orders", "nation")
def u02_cards_and_entities(li, o, n):
    """Cards with entities of the kinds that make cards of their own."""
    world = n.where("n_regionkey in (1, 2)").select(F.lower("n_name").alias("key"), F.col("n_nationkey").cast("long").alias("work_id"), F.lit("world").alias("source"))
    return _cards(li, o).select("key", "work_id", F.lit("lex").alias("source")).unionByName(world, allowMissingColumns=True)


@query("select x.a, y.b, count(l_orderkey) as n from (select unnest([0, 1, 2, 3]) as a) x cross join (select unnest([0, 1, 2, 3]) as b) y left join lineitem on l_linenumber % 4 = x.a and cast(l_quantity as bigint) % 4 = y.b and l_returnflag = 'R' and l_linenumber < 3 group by x.a, y.b", "lineitem")
def a11_contingency(li):
    """Counts of pairs of scores, with a zero for those that never met."""
    pairs = li.where("l_returnflag = 'R' and l_linenumber < 3").select((F.col("l_linenumber") % 4).cast("int").alias("a"), (F.col("l_quantity").cast("long") % 4).cast("int").alias("b"))
    return E.contingency(pairs)


@query("select event_type, count(*) as n, count(distinct user_id) as users from events group by event_type order by n desc, event_type", "events")
def a15_histogram(e):
    return e.groupBy("event_type").agg(F.count("*").alias("n"), F.countDistinct("user_id").alias("users")).orderBy(F.desc("n"), "event_type")


@query("select count(*) as calls, count(*) filter (event_type = 'error') as errors, cast(sum(cast(value * 100 as bigint)) as bigint) as tokens, count(distinct user_id) as works from events", "events")
def a17_run_summary(e):
    return e.agg(F.count("*").alias("calls"), F.count_if(F.col("event_type") == "error").alias("errors"), F.sum(F.expr("cast(round(value * 100) as bigint)")).alias("tokens"), F.countDistinct("user_id").alias("works"))


_CATEGORIES = "list_filter(['all', if(p_size > 25, 'entity', null), if(p_type = 'PROMO', 'concept', null), lower(p_type)], lambda x: x is not null)"


@query(f"select c as category, count(*) as n from (select unnest({_CATEGORIES}) as c from part) group by c", "part")
def a18_category_counts(p):
    """Rows by category; a row counts in each of its own."""
    own = F.array_compact(F.array(F.lit("all"), F.when(F.col("p_size") > 25, "entity"), F.when(F.col("p_type") == "PROMO", "concept"), F.lower("p_type")))
    return p.select(F.explode(own).alias("category")).groupBy("category").agg(F.count("*").alias("n"))


@query("select count(distinct l_orderkey) as works from lineitem", "lineitem")
def a19_distinct_works(li):
    return li.agg(F.countDistinct("l_orderkey").alias("works"))


@query("select event_type as stage, cast(sum(cast(round(value * 100) as bigint)) as bigint) as wall, count(*) as calls from events group by event_type", "events")
def a21_stage_totals(e):
    return e.groupBy(F.col("event_type").alias("stage")).agg(F.sum(F.expr("cast(round(value * 100) as bigint)")).alias("wall"), F.count("*").alias("calls"))


@query("with r as (select sha256(c_custkey || chr(31) || c_name || chr(31) || c_mktsegment) as h from customer), g as (select substring(h, 1, 3) as g, sha256(string_agg(h, chr(10) order by h)) as h from r group by 1) select sha256(string_agg(h, chr(10) order by g)) as relation_sha256 from g", "customer")
def a22_relation_hash(c):
    return R.relation_hash(c, ["c_custkey", "c_name", "c_mktsegment"])


# order and windows
@query("select user_id, event_id, coalesce(stop, 'go') as state from (select *, case when streak >= 3 then 'consecutive_errors' when calls >= 10 and errors * 10 > calls then 'error_rate' end as stop from (select *, count(*) filter (event_type = 'error') over (partition by user_id, island order by event_id) as streak from (select *, count(*) filter (event_type <> 'error') over w as island, count(*) filter (event_type = 'error') over w as errors, count(*) over w as calls from events window w as (partition by user_id order by event_id))))", "events")
def w11_stop_rules(e):
    """Third error in a row, or more than a tenth of errors after ten calls."""
    bad, w = F.col("event_type") == "error", Window.partitionBy("user_id").orderBy("event_id")
    run = e.withColumn("island", F.sum((~bad).cast("int")).over(w)).withColumn("errors", F.sum(bad.cast("int")).over(w)).withColumn("calls", F.count("*").over(w))
    run = run.withColumn("streak", F.sum(bad.cast("int")).over(Window.partitionBy("user_id", "island").orderBy("event_id")))
    stop = F.when(F.col("streak") >= 3, "consecutive_errors").when((F.col("calls") >= 10) & (F.col("errors") * 10 > F.col("calls")), "error_rate")
    return run.select("user_id", "event_id", F.coalesce(stop, F.lit("go")).alias("state"))


@query("select l_orderkey, l_linenumber from (select *, row_number() over (partition by l_suppkey order by l_orderkey, l_linenumber) as r from lineitem) where r % 97 = 1", "lineitem")
def w12_every_nth(li):
    """Every 97th row of each source, from its first (the rule's own step, 997, is over one long list; sources here have some 600 rows)."""
    r = F.row_number().over(Window.partitionBy("l_suppkey").orderBy("l_orderkey", "l_linenumber"))
    return li.withColumn("r", r).where("r % 97 = 1").select("l_orderkey", "l_linenumber")


@query("select id, if(r <= 10, 'calibration', 'development_review') as phase from (select p_partkey as id, row_number() over (order by sha256('901:' || p_partkey), p_partkey) as r from part)", "part")
def w13_drawn_split(p):
    return D.phases(p.select(F.col("p_partkey").alias("id"))).select("id", "phase")


@query("select o_orderkey, year(o_orderdate) as y, o_orderpriority from orders order by y, o_orderpriority, o_orderkey limit 80", "orders")
def l05_year_and_title(o):
    return o.select("o_orderkey", F.year("o_orderdate").cast("long").alias("y"), "o_orderpriority").orderBy("y", "o_orderpriority", "o_orderkey").limit(80)


@query("select o_orderkey, o_totalprice from orders where o_orderstatus = 'F' order by o_totalprice desc, o_orderkey limit 80", "orders")
def l06_work_order(o):
    return o.where("o_orderstatus = 'F'").select("o_orderkey", "o_totalprice").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(80)


@query("select p_partkey, case when p_name = 'cold widget' then 0 when p_size > 40 then 1 else 2 end as rank from part order by rank, lower(p_name), p_partkey limit 70", "part")
def l08_priority_order(p):
    rank = F.when(F.col("p_name") == "cold widget", 0).when(F.col("p_size") > 40, 1).otherwise(2)
    return p.select("p_partkey", rank.alias("rank"), T.casefold(F.col("p_name")).alias("k")).orderBy("rank", "k", "p_partkey").limit(70).select("p_partkey", "rank")


@query("select user_id, event_id, event_type from events where user_id = 13 order by event_id desc", "events")
def l12_history(e):
    return e.where("user_id = 13").orderBy(F.desc("event_id")).select("user_id", "event_id", "event_type")


# sets and writes
@query("select p_partkey, array_to_string(list_filter([lower(p_type), 'style', 'semantics'], lambda s: not list_contains(['semantics', 'naturalness', 'word_formation', 'style'], s)), ',') as unknown from part", "part")
def u05_unknown_scales(p):
    own = F.array(F.lower("p_type"), F.lit("style"), F.lit("semantics"))
    return p.select("p_partkey", F.array_join(F.array_except(own, F.array(*[F.lit(s) for s in ("semantics", "naturalness", "word_formation", "style")])), ",").alias("unknown"))


@query("select * from (select o_custkey, o_orderpriority, min(o_orderkey) as o_orderkey from orders where o_orderstatus <> 'F' group by all) x where not exists (select 1 from orders k where k.o_orderstatus = 'F' and k.o_custkey = x.o_custkey and k.o_orderpriority = x.o_orderpriority)", "orders")
def u08_insert_or_ignore(o):
    new = o.where("o_orderstatus <> 'F'").select("o_custkey", "o_orderpriority", "o_orderkey")
    return C.ignore_known(new, o.where("o_orderstatus = 'F'"), ["o_custkey", "o_orderpriority"], ["o_orderkey"])


_INCOMING = "(select s_suppkey as id, s_name as name, s_acctbal as score, n as ord from supplier, (select unnest([1, 2]) as n) where n = 1 or s_suppkey % 2 = 0)"


def _incoming(s):
    twice = s.select("*", F.explode(F.when(F.col("s_suppkey") % 2 == 0, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))).alias("ord"))
    return twice.select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"), (F.col("s_acctbal") + F.col("ord")).alias("score"), "ord")


@query(f"with n as (select id, arg_max(name, ord) as name, arg_max(score + ord, ord) as score from {_INCOMING} group by id) select coalesce(c.c_custkey, n.id) as id, coalesce(c.c_name, n.name) as name, coalesce(n.score, c.c_acctbal) as score from customer c full join n on c.c_custkey = n.id", "customer", "supplier")
def s17_upsert(c, s):
    """Keys in both keep their row but for the columns listed; a key that comes twice counts once, with its last row."""
    old = c.select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.col("c_acctbal").alias("score"))
    return C.upsert(old, _incoming(s), ["id"], ["score"], order="ord")


@query("with o as (select o_custkey as c, o_orderkey as k, o_totalprice as q from orders where o_orderkey % 4 <= 2), n as (select o_custkey as c, o_orderkey as k, o_totalprice + 1 as q from orders where o_orderkey % 4 >= 2) select coalesce(o.c, n.c) as c, coalesce(o.k, n.k) as k, coalesce(n.q, o.q) as q from o full join n on o.c = n.c and o.k = n.k", "orders")
def s27_replace_by_pair(o):
    """Upsert by a key of two columns that replaces all others (U09 too)."""
    rows = o.select(F.col("o_custkey").alias("c"), F.col("o_orderkey").alias("k"), F.col("o_totalprice").alias("q"))
    return C.upsert(rows.where("k % 4 <= 2"), rows.where("k % 4 >= 2").withColumn("q", F.col("q") + 1), ["c", "k"], ["q"])


@query("select doc_id, if(text ilike '%worthless%', 'quarantined', lang) as status, if(text ilike '%worthless%', 'synthetic', source) as class from documents where not (source ilike '%3%')", "documents")
def s28_quarantine(d):
    rows = d.where(~F.col("source").ilike("%3%")).select("doc_id", "text", F.col("lang").alias("status"), F.col("source").alias("class"))
    return C.quarantine(rows, F.col("text").ilike("%worthless%"), "quarantined").drop("text")


@query("select o_orderkey, if(c_custkey is not null, 'absent', 'verified') as class, if(c_custkey is not null, 'in_copyright', o_orderstatus) as rights from orders left join (select * from customer where c_mktsegment = 'BUILDING') on c_custkey = o_custkey", "orders", "customer")
def s30_rights_receipts(o, c):
    """Works of the authors listed get absent receipts; others keep what they have."""
    listed = c.where("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("o_custkey"), F.lit(True).alias("listed"))
    every = o.join(listed, "o_custkey", "left")
    return every.select("o_orderkey", F.when(F.col("listed"), "absent").otherwise("verified").alias("class"), F.when(F.col("listed"), "in_copyright").otherwise(F.col("o_orderstatus")).alias("rights"))


@query("with n as (select l_orderkey, l_linenumber, l_partkey % 2 = 0 as proposal from lineitem where l_linenumber > 2 and l_orderkey not in (select o_orderkey from orders where o_orderstatus = 'F')) select l_orderkey, l_linenumber, 'attested' as register from n union all select l_orderkey, l_linenumber, 'proposed' from n where proposal", "lineitem", "orders")
def s31_record_append(li, o):
    """New records make an attested row each, and a proposed one if they hold a proposal."""
    new = li.where("l_linenumber > 2").join(o.where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("l_orderkey")), "l_orderkey", "left_anti")
    rows = F.array_compact(F.array(F.lit("attested"), F.when(F.col("l_partkey") % 2 == 0, "proposed")))
    return new.select("l_orderkey", "l_linenumber", F.explode(rows).alias("register"))


@query("select page_id, cast(p as integer) as priority, sha256(html || p) as h from pages, (select unnest([1, 2, 3]) as p) where length(html) > 1000 and p = case page_id % 4 when 0 then 1 when 1 then 2 when 2 then 3 end", "pages")
def s09_best_mirror(p):
    """The first of three mirrors that answered with a whole page."""
    fetched = p.select("page_id", F.col("html").alias("page"), F.explode(F.array(F.lit(1), F.lit(2), F.lit(3))).alias("priority"))
    status = F.when((F.col("page_id") % 4) < F.col("priority"), 200).otherwise(404)
    tries = fetched.where("page_id % 4 <> 3").select("page_id", "priority", status.alias("status"), F.concat("page", F.col("priority").cast("string")).alias("body"))
    return C.best_mirror(tries.where(F.length("body") > 1001), "page_id").select("page_id", "priority", F.sha2("body", 256).alias("h"))


@query("select page_id, cast(sum(n) over (partition by book order by page_id) - n as bigint) as byte_start from (select page_id, regexp_extract(url, '^[a-z]+://([^/]+)', 1) as book, strlen(regexp_replace(regexp_replace(html, '^" + T.SPACE + "', ''), '" + T.SPACE + "$', '')) + 1 as n from pages)", "pages")
def s10_page_places(p):
    return D.page_places(p.select(F.regexp_extract("url", "^[a-z]+://([^/]+)", 1).alias("book"), "page_id", F.col("html").alias("text")), "book", "page_id").select("page_id", "byte_start")


_LEAVES = "l as (select sha256(uri) as key, sha256(uri || chr(10) || sha) as hash from (select 'docs/' || doc_id || '.txt' as uri, sha256(text) as sha from documents))"
_UP = "sha256(string_agg(key || ':' || hash, chr(10) order by key))"


@query(f"with {_LEAVES}, b as (select key[1:2] as up, {_UP} as hash from l group by 1), a as (select up[1:1] as up2, sha256(string_agg(up || ':' || hash, chr(10) order by up)) as hash from b group by 1) select 3 as level, key, hash from l union all select 2, up, hash from b union all select 1, up2, hash from a union all select 0, '', sha256(string_agg(up2 || ':' || hash, chr(10) order by up2)) from a", "documents")
def i04_hash_tree(d):
    """The tree of hashes that seals the texts as files: every node, the root at level 0."""
    files = d.select(F.concat(F.lit("docs/"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("uri"), F.sha2("text", 256).alias("sha256"))
    return MK.tree(files, 2)


# constraints
_ROW = "case l_linenumber % 3 when 0 then 'attested' when 1 then 'external' else 'proposed' end"


@query(f"select l_orderkey, l_linenumber, case {_ROW} when 'attested' then l_quantity > 10 when 'external' then l_tax > 0 and l_discount > 0 else l_discount > 0 and not (l_quantity > 10) end as valid from lineitem", "lineitem")
def i01_row_constraints(li):
    own = lambda ok, c: F.when(ok, F.col(c).cast("string"))
    witness = F.col("l_quantity") > 10
    rows = li.select("l_orderkey", "l_linenumber", F.expr(_ROW).alias("register"), *[own(witness, "l_orderkey").alias(c) for c in ("cts_urn", "artifact_sha256", "byte_start", "byte_len", "window_sha256")], own(F.col("l_tax") > 0, "l_tax").alias("authority"), own(F.col("l_discount") > 0, "l_tax").alias("authority_snapshot_sha256"), own(F.col("l_discount") > 0, "l_partkey").alias("proposed_ukr_term"))
    return C.row_faults(rows).select("l_orderkey", "l_linenumber", "valid")


@query("select 'duplicate' as fault, o_custkey as k, count(*) as n from orders where o_orderstatus = 'P' group by o_custkey having count(*) > 1 union all select 'orphan', l_suppkey, count(*) from lineitem where l_suppkey not in (select s_suppkey from supplier where s_acctbal > 0) group by l_suppkey", "orders", "lineitem", "supplier")
def i02_keys(o, li, s):
    """Keys that are there more than once, and references to rows that are not."""
    twice = o.where("o_orderstatus = 'P'").groupBy(F.col("o_custkey").alias("k")).agg(F.count("*").alias("n")).where("n > 1")
    orphans = li.join(s.where("s_acctbal > 0"), li.l_suppkey == s.s_suppkey, "left_anti").groupBy(F.col("l_suppkey").alias("k")).agg(F.count("*").alias("n"))
    return twice.select(F.lit("duplicate").alias("fault"), "k", "n").unionByName(orphans.select(F.lit("orphan").alias("fault"), "k", "n"))


# sinks, as the rows that they write
_TAGS = f"regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '<[^>]+>', ' ', 'g'), '{T.SPACE}', ' ', 'g'), '^{T.SPACE}', ''), '{T.SPACE}$', '')"


@query(f"select page_id, md5({_TAGS}) as h from pages", "pages")
def s08_stripped_tags(p):
    """Marked-up books read as plain text: tags become spaces, white space collapses."""
    return p.select("page_id", F.md5(T.fiction_book_text(F.col("html"))).alias("h"))


@query("""select '/w' || doc_id || '/full_text.md' as path, sha256('---' || chr(10) || 'title: ' || source || chr(10) || 'author: ' || lang || chr(10) || 'word_count: ' || n || chr(10) || 'token_estimate: ' || cast(floor(n * cast(1.35 as double)) as integer) || chr(10) || 'sha256: ' || sha256(t) || chr(10) || '---' || chr(10) || t) as h from (select doc_id, source, lang, t, len(list_filter(regexp_split_to_array(t, '""" + T.SPACE + """'), lambda w: w <> '')) as n from (select doc_id, source, lang, regexp_replace(regexp_replace(text, '^""" + T.SPACE + """', ''), '""" + T.SPACE + """$', '') as t from documents))""", "documents")
def s16_package_texts(d):
    """Full texts of packages, with front matter on words, tokens and hash."""
    works = d.select(F.col("lang").alias("author_slug"), F.concat(F.lit("w"), F.col("doc_id").cast("string")).alias("work_slug"), F.col("source").alias("title"), "text")
    full = package(works).where(F.col("path").endswith("/full_text.md"))
    return full.select(F.regexp_replace("path", "^[^/]*", "").alias("path"), F.sha2("content", 256).alias("h"))


@query("select c_custkey as id, c_name as name, c_acctbal as score, null as zone from customer union all select s_suppkey, s_name, null, s_nationkey from supplier", "customer", "supplier", holes="zone")
def s18_append(c, s):
    """Rows appended by name; columns that either side lacks are null."""
    new = s.select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"), F.col("s_nationkey").alias("zone"))
    return c.select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.col("c_acctbal").alias("score")).unionByName(new, allowMissingColumns=True)


@query("select conv_id, to_json({'id': conv_id, 'turns': list({'turn': turn, 'role': role} order by turn)}) as line from conversations group by conv_id", "conversations")
def s20_json_export(c):
    turns = F.sort_array(F.collect_list(F.struct("turn", "role")))
    return c.groupBy("conv_id").agg(turns.alias("turns")).select("conv_id", F.to_json(F.struct(F.col("conv_id").alias("id"), "turns")).alias("line"))


@query("select o_orderkey, '| **' || o_orderkey || '** | ' || year(o_orderdate) || ' | ' || coalesce(c_name, '—') || ' | `' || o_orderstatus || '` | ' || format('{:,}', cast(floor(o_totalprice) as bigint)) || ' | `unknown` |' as line from orders left join customer on c_custkey = o_custkey and c_mktsegment <> 'BUILDING'", "orders", "customer")
def s21_catalogue_lines(o, c):
    """Rows of the catalogue's table, by work."""
    known = c.where("c_mktsegment <> 'BUILDING'").select(F.col("c_custkey").alias("o_custkey"), "c_name")
    works = o.join(known, "o_custkey", "left").select("o_orderkey", F.col("o_orderkey").alias("title"), F.year("o_orderdate").alias("year"), F.col("c_name").alias("author"), F.col("o_orderstatus").alias("class"), F.floor("o_totalprice").alias("words"), F.lit(None).cast("string").alias("rights"))
    return works.select("o_orderkey", catalogue_line().alias("line"))


@query("select doc_id from documents where doc_id % 3 <> 1", "documents")
def s24_checked_copies(d):
    """Only bytes with the hash that was expected are taken over."""
    files = d.select(F.col("doc_id").alias("path"), F.sha2("text", 256).alias("sha256"))
    expected = d.select(F.col("doc_id").alias("path"), F.sha2(F.when(F.col("doc_id") % 3 == 1, F.concat("text", F.lit("x"))).otherwise(F.col("text")), 256).alias("sha256"))
    return checked_copy(files, expected).select(F.col("path").alias("doc_id"))


@query("select user_id, count(*) as n, sha256(string_agg(to_json({'event_id': event_id, 'action': event_type}), chr(10) order by event_id)) as h from events group by user_id", "events")
def s26_audit_export(e):
    """What the decision endpoints serve: each card's history as JSON, oldest first."""
    rows = F.sort_array(F.collect_list(F.struct("event_id", F.to_json(F.struct("event_id", F.col("event_type").alias("action"))).alias("line"))))
    return e.groupBy("user_id").agg(F.count("*").alias("n"), F.sha2(F.array_join(F.transform(rows, lambda r: r.line), "\n"), 256).alias("h"))


@query("select l_orderkey, l_suppkey, term, min(l_linenumber) as l_linenumber from (select *, lower(l_returnflag) as term from lineitem) group by all", "lineitem")
def w02_first_records(li):
    """The first record of each work, artifact and folded term."""
    rows = li.select("l_orderkey", "l_suppkey", F.lower("l_returnflag").alias("term"), "l_linenumber")
    return C.ignore_known(rows, rows.limit(0), ["l_orderkey", "l_suppkey", "term"], ["l_linenumber"])


@query("select c_custkey as id, coalesce(s_name, c_name) as name, coalesce(s_acctbal, c_acctbal) as score from customer left join supplier on s_suppkey = c_custkey union all select s_suppkey, s_name, s_acctbal from supplier where s_suppkey not in (select c_custkey from customer)", "customer", "supplier")
def u09_insert_or_replace(c, s):
    old = c.select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.col("c_acctbal").alias("score"))
    return C.upsert(old, s.select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"), F.col("s_acctbal").alias("score")), ["id"], ["name", "score"])
