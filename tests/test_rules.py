"""Rules on fixtures of their own: what SQL on the driver's tables does not reach."""

import hashlib
import re

import pytest
from pyspark.sql import functions as F
from textloom.functions import raw as R
from textloom.functions import text as T
from textloom.operators import catalogue as C
from textloom.operators import dictionary as D
from textloom.operators import evidence as E
from textloom.operators import queue as Q
from textloom.operators import review as V
from textloom.operators import scoring as S
from textloom.operators import zones as Z
from textloom.plans.every import ORACLES, QUERIES


def sha(x):
    return hashlib.sha256(x if isinstance(x, bytes) else x.encode()).hexdigest()


def plain_occurrences(text, term, variants=()):
    """The rule as one expression of another engine."""
    parts = []
    for w in (term, *variants):
        seg = re.split(r"[-\s]+", w)
        parts.append(r"[-\s]+".join(map(re.escape, seg)) if all(len(s) >= 3 for s in seg) else re.escape(w))
    return [(len(text[: m.start()].encode()), m.group()) for m in re.finditer(r"\b(?:" + "|".join(parts) + r")\w{0,3}\b", text, re.I)]


TEXTS = [
    "Morlock, morlocks and MORLOCK; morlockians", "Robot, Robotů a robotech; роботи РОБОТІВ робот", "the time\n machine and Time-Machines, time machinery, time, machine",
    "an An-a an anxious An-abc An-abcd an a", "time time time machine", "čas čas " * 200 + "Čas", "", "x" * 300 + " robot", "o'neill colony O'Neill  colonies",
]
TERMS = [("morlock", None), ("robot", None), ("робот", None), ("time machine", None), ("An-a", None), ("time time", None), ("čas", None), ("an", None), ("machine", ["time", "robot"]), ("o'neill colony", None)]


def test_occurrences_against_a_plain_search(spark):
    docs = spark.createDataFrame([*enumerate(TEXTS), (99, None)], "doc_id long, text string")
    terms = spark.createDataFrame(TERMS, "term string, variants array<string>")
    got = sorted((r.doc_id, r.term, r.idx, r.byte_offset, r.form) for r in E.occurrences(docs, terms).collect())
    want = sorted((i, t, k, at, form) for i, x in enumerate(TEXTS) for t, v in TERMS for k, (at, form) in enumerate(plain_occurrences(x, t, v or ())))
    assert got == want and len(want) > 400
    one = terms.where("variants is null and not term rlike '[^a-zа-яčěů]'")
    counts = {r.term: (r.n, r.n_docs) for r in E.counts(docs, one).collect()}
    assert counts == {t: (sum(len(plain_occurrences(x, t)) for x in TEXTS), sum(bool(plain_occurrences(x, t)) for x in TEXTS)) for t in (r.term for r in one.collect()) if any(plain_occurrences(x, t) for x in TEXTS)}
    pairs = [(x, t) for x in TEXTS for t, _ in TERMS]
    said = spark.createDataFrame(pairs, "x string, t string").select("x", "t", E.has_term(F.col("x"), F.col("t")).alias("y")).collect()
    assert all(r.y == bool(plain_occurrences(r.x, r.t)) for r in said)


def test_borders_of_characters(spark):
    data = "aß日🙂b".encode()
    df = spark.createDataFrame([(data, i) for i in range(-2, len(data) + 3)], "c binary, i int")

    def plain(pos, step):
        if pos <= 0 or pos >= len(data):
            return max(0, min(pos, len(data)))
        while 0 < pos < len(data) and data[pos] & 0xC0 == 0x80:
            pos += step
        return pos

    for r in df.select("i", R.snap(F.col("c"), F.col("i")).alias("b"), R.snap(F.col("c"), F.col("i"), forward=True).alias("f")).collect():
        assert (r.b, r.f) == (plain(r.i, -1), plain(r.i, 1)), r.i


def test_witness_and_export_reasons(spark):
    text = "The old robot, ß and робот stand here"
    raw = text.encode()
    good = dict(artifact_sha256=sha(raw), byte_start=4, byte_len=10, window_sha256=sha(raw[4:14]), matched_form=None)
    cut = raw.index("ß".encode()) + 1
    cases = [
        ("ok", raw, good, "robot", "byte_verified_zone_map_checked"), ("ok", raw, dict(good, matched_form="OLD"), "zzz", "term_absent"), ("ok", raw, good, "rob", "byte_verified_zone_map_checked"), ("file_not_found", None, good, "robot", "unavailable"),
        ("artifact_drift", raw + b"x", good, "robot", "artifact_drift"), ("short_read", raw, dict(good, byte_start=9000), "robot", "short_read"), ("artifact_drift", raw + b"x", dict(good, byte_start=9000), "robot", "short_read"),
        ("window_mismatch", raw, dict(good, window_sha256="0" * 64), "robot", "window_mismatch"), ("decode_error", raw, dict(good, byte_start=cut, byte_len=5, window_sha256=sha(raw[cut : cut + 5])), "and", "decode_error"),
        ("term_absent", raw, good, "tobor", "term_absent"), ("ok", raw, dict(good, byte_len=8, window_sha256=sha(raw[4:12])), "obo", "term_absent"),
    ]
    kind = "reason string, content binary, w struct<artifact_sha256:string,byte_start:int,byte_len:int,window_sha256:string,matched_form:string>, term string, strict string"
    df = spark.createDataFrame([(a, None if b is None else bytearray(b), c, d, e) for a, b, c, d, e in cases], kind)
    strict = lambda zone, zsha, inside: E.export_check(F.col("content"), "w", F.col("term"), F.lit(zone), zsha, F.lit(inside))
    for r in df.select("reason", "strict", E.verdict(F.col("content"), "w", F.col("term")).alias("a"), strict("body", F.col("w.artifact_sha256"), True).alias("b")).collect():
        assert (r.a, r.b) == (r.reason, r.strict)
    first = df.limit(1)
    assert first.select(strict("body", F.lit("x"), True)).first()[0] == "zone_hash_unbound"
    assert first.select(strict("body", F.col("w.artifact_sha256"), False)).first()[0] == first.select(strict("toc", F.col("w.artifact_sha256"), True)).first()[0] == "outside_body"


def test_spans_in_zones(spark):
    z = "array(named_struct('kind','toc','byte_start',345L,'byte_end',738L), named_struct('kind','body','byte_start',738L,'byte_end',181770L))"
    df = spark.createDataFrame([(687, 887, None, "toc"), (800, 900, "body", "body"), (400, 500, "toc", "toc"), (10, 20, None, "body")], "a long, b long, span string, byte string").withColumn("z", F.expr(z))
    for r in df.select("span", "byte", Z.of_span(F.col("z"), F.col("a"), F.col("b")).alias("s"), Z.of_byte(F.col("z"), F.col("a")).alias("p"), Z.inside_body(F.col("z"), F.col("a"), F.col("b")).alias("i")).collect():
        assert (r.s, r.p, r.i) == (r.span, r.byte, r.span == "body")


def test_windows_and_coverage_of_a_plan(spark):
    text = "я" * 20
    w = E.windows(spark.createDataFrame([(1, text, 20)], "doc_id long, text string, n long"), "n", 8, 3)
    assert [(r.start, r.end) for r in w.orderBy("start").collect()] == [(0, 8), (5, 13), (10, 18), (15, 20)]
    assert E.covered(w, "doc_id").first().covered == 20


def test_locate_anchor_and_names(spark):
    rows = [
        ("one  two\nthree two", "one two", None, 0, 8, "whitespace_only"), ("one two", "one two", None, 0, 7, "exact"), ("a two b two", "two", "quote_ambiguous", None, None, None), ("aaa", "aa", "quote_ambiguous", None, None, None),
        ("one, two", "one two", "quote_absent", None, None, None), ("x", " ", "empty_quote", None, None, None), ("x", None, "empty_quote", None, None, None), ("日本 čau  ß end", "čau ß", None, 7, 8, "whitespace_only"), ("  lead in", "ead", None, 3, 3, "exact"),
    ]
    df = spark.createDataFrame(rows, "t string, q string, e string, a int, n int, al string")
    for r in df.select("*", T.locate(F.col("t"), F.col("q")).alias("x")).collect():
        assert (r.x.error, r.x.byte_start, r.x.byte_len, r.x.alignment) == (r.e, r.a, r.n, r.al), r
    anchors = [("ß x y z", "x y", 3), ("x x x x here", "x x", 0), ("ab ab ab ab", "ab", None), ("abc abc abc abc", "abc", None), ("ä one\n two", "one two", 3), ("abc", "zzz", None)]
    for r in spark.createDataFrame(anchors, "t string, q string, at int").select("*", T.anchor(F.col("t"), F.col("q")).alias("x")).collect():
        assert r.x == r["at"], r
    names = [("See Anna\n Lee.", "Anna Lee", True), ("Annabel", "Anna", False), ("(Anna)", "Anna", True), ("anna", "Anna", False), ("C++ x", "C++", True)]
    assert all(r.x == r.y for r in spark.createDataFrame(names, "t string, n string, y boolean").select("y", T.whole_word(F.col("t"), F.col("n")).alias("x")).collect())


def test_entities_and_grounding(spark):
    kind = "e struct<name:string,kind:string,quote:string,description_uk:string,epistemic:string>, s string"
    base = dict(name="Elizabeth", kind="character", quote="Elizabeth  came", description_uk="d", epistemic="explicit")
    cases = [
        (base, "Then Elizabeth\ncame in", []), (dict(base, name="Eliza"), "Then Elizabeth came in", ["name_not_in_original", "name_not_in_evidence"]), (dict(base, quote="she came"), "Elizabeth saw that she came", ["name_not_in_evidence"]),
        (dict(base, name=None, kind="x", epistemic=None, description_uk=" ", quote=""), "x", ["empty_quote", "missing_name", "unknown_category", "unknown_epistemic_status", "missing_description"]),
    ]
    df = spark.createDataFrame([c[:2] for c in cases], kind)
    got = [r.x for r in df.select(S.entity_issues("e", F.col("s"), F.lit(100)).alias("x")).collect()]
    assert [x.issues for x in got] == [c[2] for c in cases] and (got[0].byte_start, got[0].byte_len, got[0].status) == (105, 14, "source_grounded_editorial_pending") and got[1].status == "held"
    ents = spark.createDataFrame([([dict(base, quote="Elizabeth"), dict(base, quote="nope")], "ß Elizabeth"), ([base] * 5, ""), ([dict(base, name=" ")], ""), ([dict(base, kind="thing")], ""), (None, "")], "e array<struct<name:string,kind:string,quote:string,description_uk:string,epistemic:string>>, s string")
    got = [r.x for r in ents.select(S.grounded(F.col("e"), F.col("s"), F.lit(10)).alias("x")).collect()]
    assert [x.error for x in got] == [None, "entity_limit", "invalid_entity", "invalid_type", "invalid_entities"]
    assert [(x.accepted, x.byte_start, x.byte_len, x.reason) for x in got[0].entities] == [(True, 13, 9, None), (False, None, None, "quote_not_exact_in_original")]


def test_scores_of_works_and_words(spark):
    works = [(1965, ["Hugo win", "Nebula win"], ["SF Masterworks", "Locus All-Time Best", "NPR Top 100 SF", "ISFDB Top Ranked"], True, 95.0), (1920, [], ["SF Masterworks", "Locus All-Time Best", "ISFDB Top Ranked"], True, 90.0), (2000, [], [], False, 50.0)]
    for r in spark.createDataFrame(works, "y int, a array<string>, c array<string>, m boolean, least double").select("least", S.work_score(F.col("y"), F.col("a"), F.col("c"), F.col("m")).alias("s")).collect():
        assert r.least <= r.s <= 99.8
    words = [("мислитель", 0.75, True), ("вчитель", 0.75, True), ("Миттєвісник", 0.75, True), ("12", 0.0, False), ("robot", 0.0, False), ("  ", 0.0, False), (None, 0.0, False), ("объект", 0.0, False), ("включатель", 0.0, False), ("слово!", 0.0, False), ("Мере́жище", 0.75, True)]
    for r in spark.createDataFrame(words, "w string, s double, ok boolean").select("*", S.formed_word(F.col("w"), F.lit("")).alias("x")).collect():
        assert (r.x.score, r.x.acceptable) == (r.s, r.ok), r


def test_citations_volumes_and_claims(spark):
    said = [
        ("Словарь Грінченка, т. IV, с. 293: 'Трудникъ'", 4, 293, "Трудникъ"), ("т. ІІ, с. 417: за зразком сховище", 2, 417, "сховище"), ("За моделлю велетень (Грінченко І, 73).", 1, 73, "велетень"), ("без посилання", None, None, None), ("т. 3; 12 (дім, x)", 3, 12, "дім"),
    ]
    for r in spark.createDataFrame(said, "t string, v int, p int, w string").select("*", D.citation(F.col("t")).alias("c"), D.headword(F.col("t")).alias("h")).collect():
        assert (r.c.volume, r.c.page, r.h) == (r.v, r.p, r.w)
    letters = [("вісник", 1), ("Людина", 2), ("праліс", 3), ("сховище", 4), ("Ъ", 1), ("Ыж", 2), ("Эх", 1), ("Їжак", 2), ("x", None), ("", None), (None, None)]
    for r in spark.createDataFrame(letters, "w string, v int").select("*", D.volume_of(F.col("w")).alias("x")).collect():
        # accents go first, so that a letter with a mark counts as its base
        assert r.x == r.v, r
    both = "«Тяжкороб» (Грінченко, том 4, артефакт 2451234+58), «вісник» (Грінченко, том 1, артефакт 5+7)"
    got = spark.createDataFrame([(both,), ("none",)], "t string").select(D.coordinates(F.col("t")).alias("c")).collect()
    assert [tuple(x) for x in got[0].c] == [("Тяжкороб", 4, 2451234, 58), ("вісник", 1, 5, 7)] and got[1].c == []


def test_old_words_and_json(spark):
    df = spark.createDataFrame([("Трудникъ",), ("вѣстникъ",), ("Підґрунтя́",), ("м’я'та й їжа",)], "w string")
    assert [r[0] for r in df.select(D.T.old_orthography(F.col("w"))).collect()] == ["трудник", "вістник", "підґрунтя", "мята и іжа"]
    import json

    values = [3, "a" * 64, 'ROBOT "x" \\ ß\n', "w"]
    want = sha(json.dumps([values[0], values[1], values[2].casefold(), values[3]], ensure_ascii=False))
    got = spark.createDataFrame([tuple(values)], "a long, b string, c string, d string").select(D.evidence_key(F.col("a"), F.col("b"), F.col("c"), F.col("d"))).first()[0]
    assert got == want


def test_review_of_two_people(spark):
    roles = [("ai", "human", "ai_assisted_human_audit"), ("human", "human", "two_human_review"), ("ai", None, "unconfirmed_roles")]
    assert all(r.m == r.x for r in spark.createDataFrame(roles, "a string, b string, m string").select("m", V.mode(F.col("a"), F.col("b")).alias("x")).collect())
    pairs = spark.createDataFrame([("calibration", "semantics", a, b) for a, b in ((0, 0), (1, 2), (2, 1), (3, 3))] + [("calibration", "style", 3, 3), ("calibration", "style", None, 1)], "phase string, scale string, a int, b int")
    two = {(r.phase, r.scale): r for r in V.agreement(pairs, "two_human_review").collect()}
    assert round(two["calibration", "semantics"].kappa, 9) == 0.6 and two["calibration", "style"].kappa is None and two["calibration", "style"].n == 1 and two["development_review", "style"].n == 0
    assert all(r.kappa is None for r in V.agreement(pairs, "ai_assisted_human_audit").collect())


def test_search_words_phrases_and_prefixes(spark):
    rows = spark.createDataFrame([(1, "The Time Machine", "Wells"), (2, "machine of time", "Élan"), (3, "timeless", "the machine")], "id long, a string, b string")
    found = lambda q: sorted(r.id for r in C.search(rows, "id", ["a", "b"], q).collect())
    assert found('"time machine"') == [1] and found("time machine") == [1, 2] and found("tim* the") == [1, 3] and found("elan") == [2] and found("zzz") == []


def test_publishing_needs_the_same_baseline(spark):
    a, b = spark.range(5), spark.range(5, 7)
    base = R.relation_hash(a, ["id"]).first()[0]
    assert Q.publish(a, b, base, ["id"]).count() == 7 and R.relation_hash(a.repartition(3), ["id"]).first()[0] == base
    with pytest.raises(ValueError, match="baseline"):
        Q.publish(a.union(b), b, base, ["id"])


def test_zones_from_a_selection(spark):
    text = "\n".join(f"line {i}" for i in range(30))
    lines = D.boundary_lines(spark.createDataFrame([(1, text)], "doc_id long, text string"), "doc_id", 10).unionByName(D.boundary_lines(spark.createDataFrame([(1, text)], "doc_id long, text string"), "doc_id", 10, True))
    chosen = spark.createDataFrame([(1, 2, 8, len(text)), (1, 2, 99, len(text))], "doc_id long, head int, tail int, size int")
    got = Z.from_selection(chosen, lines, "doc_id").collect()
    good = next(r.zones for r in got if r.zones)
    assert [(z.kind, text[z.byte_start : z.byte_end][:7]) for z in good] == [("front_matter", "line 0\n"), ("body", "line 2\n"), ("back_matter", "\nline 2")] and any(r.zones is None for r in got)


def test_author_scores_round_the_double_itself(spark):
    """70.945, 73.945 and 72.445 are a little less as doubles: they go down, as in SQL; decimal text takes them up."""
    rows = [(2, 4, [60.71, 74.88, 67.56]), (2, 1, [94.0, 57.77, 76.38]), (2, 1, [80.71, 74.88, 67.56]), (3, 5, [])]
    df = spark.createDataFrame(rows, "tier int, coined int, scores array<double>")
    got = [r.s for r in df.select(S.author_score(F.col("tier"), F.col("scores"), F.col("coined")).alias("s")).collect()]
    assert got == [70.94, 73.94, 72.44, 75.0]


def as_sql(spark, tmp_path, name, **tables):
    """Rows of a registered query on small tables, and those of its SQL."""
    import duckdb

    con = duckdb.connect()
    for t, df in tables.items():
        df.coalesce(1).write.parquet(f"{tmp_path}/{t}.parquet")
        con.execute(f"create view {t} as select * from '{tmp_path}/{t}.parquet/*.parquet'")
    return sorted(map(repr, map(tuple, QUERIES[name](spark, str(tmp_path)).collect()))), sorted(map(repr, con.execute(ORACLES[name]).fetchall()))


def test_chains_of_a_repeated_word(spark, tmp_path):
    texts = ["der der der der der", "Der der, der  der der-der x der der", "the the then the the", "new york new york york"]
    docs = spark.createDataFrame([*enumerate(texts)], "doc_id long, text string")
    asked = spark.createDataFrame([("der der",), ("the the",), ("new york",), ("york new",)], "text string")
    got, want = as_sql(spark, tmp_path, "x01_two_word_terms", documents=docs, benchmark=asked)
    assert got == want and len(got) == 9


def test_a_cycle_of_texts_too_short_for_their_known_words(spark, tmp_path):
    text = "Thingedan eaoure onorndly in inanonthou the threanin.\nEnnton thinbleth ble entior oresti on it. Inwh."
    docs = spark.createDataFrame([(i, text + more) for i, more in ((1, ""), (5, ""), (10, " a b c d e f"), (15, ""), (45, ""), (50, ""))], "doc_id long, text string")
    got, want = as_sql(spark, tmp_path, "m20_research_cycle", documents=docs)
    assert got == want and len(got) > 2


def test_every_nth_row_goes_on_beyond_the_first(spark, tmp_path):
    lines = spark.range(400).select(F.col("id").alias("l_orderkey"), F.lit(1).alias("l_linenumber"), (F.col("id") % 2).alias("l_suppkey"))
    got, want = as_sql(spark, tmp_path, "w12_every_nth", lineitem=lines)
    assert got == want and len(got) == 6
