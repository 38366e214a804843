"""Operators against their plain versions, the libraries and planted cases."""

import base64
import random

import brute
import public_tokenizers as P
import pytest
import tiktoken
from pyspark.sql import functions as F
from textloom.llm import bpe, decontaminate, langid, lines, queries, secret_scan, simhash, substrings, tokens, topk, toxicity
from textloom.llm.common import components
from tokenizers import Tokenizer

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, kept string, h long"


def odd_rows():
    rng = random.Random(5)
    words = [rng.choice("ab cd ef gh ij kl mn".split()) + str(rng.randint(0, 30)) for _ in range(4000)]
    long = " ".join(words)
    shared = " ".join(words[100:160])
    return [
        (1, long), (2, long), (3, shared + " tail one"), (4, "head " + shared), (5, None), (6, ""), (7, "  \n\t\n "), (8, "Same line here\nother\nsame LINE here "),
        (9, "same line here\x0b\nß　x"), (10, "日本語のテキスト 🙂 <|endoftext|> x"), (10, "日本語のテキスト 🙂 <|endoftext|> x"), (11, "tie tie tie " * 40), (12, "password: hunter22 AKIA" + "A" * 16 + " " + "0f" * 12),
    ]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(d, t, "en", "s", 0, "clash", 1) for d, t in odd_rows()], SCHEMA)


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_lines(docs):
    got = lines.dedup_lines(docs).select("doc_id", "n_lines", "n_dropped", F.sha2("kept", 256))
    assert rows(got) == sorted(brute.lines(odd_rows()))


def test_perfect_hash_is_minimal():
    import numpy as np

    keys = np.random.default_rng(0).integers(0, 2**63, 5000, dtype=np.int64).view(np.uint64)
    ph = lines.PerfectHash.unpack(lines.PerfectHash.build(np.unique(keys)).pack())
    assert sorted(ph.index(np.unique(keys)).tolist()) == list(range(len(np.unique(keys))))


def test_tokens_match_the_library(docs):
    path = P.path("byte_bpe_50k.json")
    t = Tokenizer.from_file(path)
    got = rows(tokens.count_tokens(docs, path).select("doc_id", "n_tokens"))
    assert got == sorted((d, len(t.encode(x or "", add_special_tokens=False).ids)) for d, x in odd_rows())


def test_bpe_matches_the_library_and_round_trips(docs):
    path = P.path("byte_bpe_multi_50k.tiktoken")
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    e = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    got = bpe.encode_documents(docs, path, P.PATTERN, digests=False).collect()
    assert sorted((r.doc_id, r.ids, r.decoded) for r in got) == sorted((d, e.encode_ordinary(t or ""), t or "") for d, t in odd_rows())


def test_simhash_groups(docs):
    got = simhash.near_groups(docs).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")), "component_id")
    assert rows(got) == sorted(brute.simhash(odd_rows()))


def test_simhash_full_buckets_take_the_exact_way(spark, monkeypatch):
    sf = spark.read.parquet(f"{SF}/documents.parquet")
    want = rows(simhash.near_groups(sf))
    monkeypatch.setattr(simhash, "BUCKET", 1)
    assert rows(simhash.near_groups(sf)) == want


def test_components_of_a_chain(spark):
    chain = spark.createDataFrame([(i, i + 1) for i in range(50)], "a long, b long")
    assert {r.root for r in components(chain).collect()} == {0}


def test_substrings(docs):
    got = substrings.drop_repeats(docs).select("doc_id", "n_words", "n_removed", F.sha2("kept", 256))
    assert rows(got) == sorted(brute.substrings(odd_rows()))


def test_secrets(docs, spark):
    got = {r[0]: tuple(r) for r in brute.secrets(odd_rows())}
    for d, t in odd_rows():
        spans = [f"{secret_scan.KINDS[k]}:{s}:{e}" for s, k, e in secret_scan.scan(t or "") if k < 3]
        assert brute.sha(",".join(spans)) == got[d][4]
    body = "xyz" * 10
    assert secret_scan.scan(f"ghp_{body}{secret_scan.checksum(body)}") and not secret_scan.scan(f"ghp_{body}000000")


def test_top_k_skips_bad_vectors(spark):
    data = [(i, [((i * 7 + j * 3) % 11 - 5) / 7 for j in range(6)]) for i in range(120)] + [(200, None), (250, [None] * 6), (300, [float("nan")] * 6)]
    got = topk.top_k(spark.createDataFrame(data, "vec_id long, embedding array<float>"))
    import numpy as np

    assert rows(got) == sorted(brute.top_k([(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v]) for i, v in data]))


def test_decontamination_catches_other_numbers(spark):
    bench = spark.createDataFrame([(1, "a train leaves with 12 cars and travels 300 km before it stops for fuel in the town"), (2, None), (3, "")], "item_id long, text string")
    docs = spark.createDataFrame([(1, "intro words. A train leaves with 45 cars and travels 810 km before it stops for fuel in the town, he said"), (2, "a train is late and nobody knows why it has to be so"), (3, None), (None, "x")], "doc_id long, text string")
    got = {r.doc_id: r.item_ids for r in decontaminate.flag_documents(docs, bench).collect()}
    assert got == {1: [1], 2: [], 3: [], None: []}


def test_held_out_accuracy(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    p = langid.predict(docs, langid.train(docs)).join(docs.select("doc_id", "lang"), "doc_id").where("held_out and lang_pred <> 'und'")
    assert p.agg(F.avg((F.col("lang_pred") == F.col("lang")).cast("int"))).first()[0] > 0.95
    s = toxicity.score(docs, toxicity.train(docs, labels)).join(labels, "doc_id").where("held_out")
    assert s.agg(F.avg((F.col("predicted") == F.col("toxic")).cast("int"))).first()[0] > 0.9


def test_empty_tables(spark):
    docs, bench = spark.createDataFrame([], SCHEMA), spark.createDataFrame([], "item_id long, text string")
    labels, vectors = spark.createDataFrame([], "doc_id long, toxic int"), spark.createDataFrame([], "vec_id long, embedding array<float>")
    for df in (lines.dedup_lines(docs), simhash.near_groups(docs), substrings.drop_repeats(docs), decontaminate.flag_documents(docs, bench), topk.top_k(vectors), toxicity.score(docs, toxicity.train(docs, labels)), langid.predict(docs, langid.train(docs)), tokens.count_tokens(docs, P.path("byte_bpe_50k.json")), secret_scan.scan_documents(docs), bpe.encode_documents(docs, P.path("byte_bpe_multi_50k.tiktoken"), P.PATTERN)):
        assert df.count() == 0


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    for t in ("documents", "embeddings"):
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    df = queries.QUERIES[name](spark, SF)
    assert rows(df) == sorted(con.execute(f"select {','.join(df.columns)} from ({queries.ORACLES[name]})").fetchall())


@pytest.mark.parametrize("length", [1, 2, 4, 35])
def test_substrings_of_spliced_texts(spark, length):
    """Shared passages begin and end anywhere, lie in several texts and repeat within one."""
    rng = random.Random(length)
    base = [rng.choice("abcdefgh") for _ in range(300)]
    data = [(97, "a " * 100), (97, "a " * 100), (96, "q " * length), (95, "z " * (length - 1)), (94, None)]
    for d in range(40):
        words = []
        for _ in range(rng.randint(0, 4)):
            i = rng.randint(0, 250)
            words += base[i : i + rng.randint(1, 90)] + [rng.choice("xy") for _ in range(rng.randint(0, 60))]
        data.append((d, "\t".join(words)))
    docs = spark.createDataFrame(data, "doc_id long, text string")
    got = substrings.drop_repeats(docs, length).select("doc_id", "n_words", "n_removed", F.sha2("kept", 256))
    assert rows(got) == sorted(brute.substrings(data, length))


def test_bpe_keeps_its_state_when_arcs_are_forgotten(monkeypatch):
    path = P.path("byte_bpe_multi_50k.tiktoken")
    monkeypatch.setattr(bpe, "ARCS", 500)
    ranks = bpe.load_ranks(path)
    e = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    rng = random.Random(3)
    text = "".join(rng.choice("wxyzé日") for _ in range(150_000)) + " aaaa" * 9
    assert bpe.Transducer(ranks, P.PATTERN).encode(text) == e.encode_ordinary(text)


def test_bpe_proves_no_byte_and_forgets_pieces(monkeypatch):
    """A byte alone needs no proof that it fits; pieces that were forgotten come out the same."""
    path = P.path("byte_bpe_multi_50k.tiktoken")
    monkeypatch.setattr(bpe, "PIECES", 50)
    proved = []
    fit = bpe.Transducer.fit
    monkeypatch.setattr(bpe.Transducer, "fit", lambda self, a, b: proved.append(b) or fit(self, a, b))
    ranks = bpe.load_ranks(path)
    e = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    rng = random.Random(5)
    words = ["".join(rng.choice(("th", "er", "in", "q", "zz", "é", "日", "ж")) for _ in range(rng.randint(1, 9))) for _ in range(400)]
    fst = bpe.Transducer(ranks, P.PATTERN)
    for _ in range(3):
        text = " ".join(rng.choice(words) for _ in range(1500))
        assert fst.encode(text) == e.encode_ordinary(text)
    assert proved and all(len(fst.bytes_of[t]) > 1 for t in proved)


def test_bpe_query_digests_and_empty_table(spark, docs, tmp_path):
    import hashlib

    ranks = bpe.load_ranks(P.path("byte_bpe_multi_50k.tiktoken"))
    e = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    docs.union(docs.limit(0)).write.parquet(f"{tmp_path}/documents.parquet")
    want = []
    for d, t in odd_rows():
        ids = e.encode_ordinary(t or "")
        want.append((d, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), brute.sha(t or "")))
    assert rows(queries.op5_bpe(spark, str(tmp_path))) == sorted(want)
    assert bpe.encode_documents(docs.limit(0), P.path("byte_bpe_multi_50k.tiktoken"), P.PATTERN).count() == 0


def test_utf8_machine_carries_open_characters():
    data = ("aß日🙂" * 50).encode() + b"\xff\xe6\x97" + "é".encode()
    for size in (1, 2, 3, 5, 7):
        m = bpe.Utf8()
        got = "".join(m.feed(data[i : i + size]) for i in range(0, len(data), size)) + m.feed(b"", True)
        assert got == data.decode("utf-8", "replace"), size


@pytest.mark.parametrize("length", [2, 35])
def test_substrings_of_hot_grams_take_the_exact_way(spark, monkeypatch, length):
    rng = random.Random(7)
    passage = [f"p{i}" for i in range(60)]
    data = [(d, " ".join([f"x{rng.randint(0, 9)}" for _ in range(rng.randint(0, 50))] + passage[: rng.randint(0, 60)] + [f"y{rng.randint(0, 9)}" for _ in range(rng.randint(0, 50))])) for d in range(60)]
    docs = spark.createDataFrame(data, "doc_id long, text string")
    want = sorted(brute.substrings(data, length))
    for hot, shard in ((1, 3), (4, 1), (2000, 5)):
        monkeypatch.setattr(substrings, "HOT", hot)
        monkeypatch.setattr(substrings, "SHARD", shard)
        got = substrings.drop_repeats(docs, length).select("doc_id", "n_words", "n_removed", F.sha2("kept", 256))
        assert rows(got) == want


def test_substrings_of_long_words_that_collide_in_polynomials(spark):
    """Two words of 1,024 letters whose polynomials modulo 2^64 agree are not one word."""
    turn = "a"
    for _ in range(10):
        turn += turn.translate(str.maketrans("ab", "ba"))
    other, common = turn.translate(str.maketrans("ab", "ba")), " ".join(f"w{i}" for i in range(34))
    data = [(1, f"{common} {turn}"), (2, f"{common} {other}")]
    got = substrings.drop_repeats(spark.createDataFrame(data, "doc_id long, text string"))
    assert sorted((r.doc_id, r.n_removed) for r in got.collect()) == [(1, 0), (2, 0)]


def test_automaton_statistics_against_plain_search():
    rng = random.Random(2)
    runs = [[rng.randint(0, 2) for _ in range(rng.randint(1, 25))] for _ in range(30)]
    m = substrings.Automaton()
    for r in runs:
        m.add(r, 1)
    m.close()
    times = lambda x: sum(r[i : i + len(x)] == x for r in runs for i in range(len(r)))
    for q in [*runs[:10], [rng.randint(0, 3) for _ in range(60)]]:
        want = [max(n for n in range(i + 1) if n == 0 or times(q[i - n : i]) > 1) for i in range(1, len(q) + 1)]
        assert m.statistics(q) == want


def test_top_k_rows_lengths_ties_and_groups(spark, monkeypatch):
    """Repeated rows of one vec_id stay rows, lengths may differ, ties go to the smaller vec_id; also over many groups and blocks."""
    rng = random.Random(1)
    data = [(0, [1.0, 0.0], "x"), (1, [1.0, 0.0], "x"), (1, [0.5, 0.0], "x"), (2, [0.2, 0.1], "x")]
    vectors = lambda d: spark.createDataFrame(d, "vec_id long, embedding array<double>, score string")
    assert rows(topk.top_k(vectors(data))) == [(0, 1, 1, 65536), (0, 2, 1, 32768), (0, 3, 2, 13056)]
    same = [0.25, -0.5, 0.75, 0.125]
    data = [(i % 130, [rng.choice([-1.0, -0.5, 0.25, 0.5, 2.0]) for _ in range(rng.choice([0, 2, 4, 4, 4]))], "x") for i in range(200)] + [(200 + i, same, "x") for i in range(100)] + [(None, same, "x"), (50, None, "x")]
    want = sorted(brute.top_k([d[:2] for d in data]))
    assert rows(topk.top_k(vectors(data))) == want
    for name, n in (("GROUP", 16), ("QUERIES", 2), ("BLOCK", 4), ("HEAD", 1)):
        monkeypatch.setattr(topk, name, n)
    assert rows(topk.top_k(vectors(data))) == want


def test_secret_columns_of_the_query(spark, docs, tmp_path):
    body = "xyz" * 10
    more = [(20, f"x ghp_{body}{secret_scan.checksum(body)} y ghp_{body}000000"), (21, "ß日🙂 API_KEY = 'abc123' " + "a1" * 11 + " " + "a1" * 12 + "z"), (22, "0" * 200_000 + " secret:" + "x" * 6), (None, "token=abcdef")]
    docs.select("doc_id", "text").union(spark.createDataFrame(more, "doc_id long, text string")).selectExpr("*", "'x' as spans").write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted((tuple(r) for r in queries.op10_secrets(spark, str(tmp_path)).collect()), key=str)
    assert [r[:5] for r in got] == sorted(brute.secrets(odd_rows() + more), key=str)
    spans = {r[0]: r[5] for r in got}
    assert spans[20] == "github:2:42" and "hex:" in spans[21] and spans[22].startswith("hex:0:200000,assign:200001")


def test_toxicity_learns_pairs_and_holds_its_contract(spark):
    """Neither word is toxic alone; more terms than there are change nothing; odd rows have a score."""
    import numpy as np

    rng = random.Random(3)
    data = []
    for d in range(1500):
        words = [rng.choice("abcdefgh") + str(rng.randint(0, 9)) for _ in range(8)] + rng.choice([["insult"], ["group"], ["insult", "group"], []])
        data.append((d, " ".join(words), int("insult" in words and "group" in words)))
    docs = spark.createDataFrame([x[:2] for x in data] + [(5000, None), (5001, ""), (None, "insult group"), (7, data[7][1]), (5002, "insult group " * 20_000)], "doc_id long, text string")
    labels = spark.createDataFrame([(d, y) for d, _, y in data] + [(3, data[3][2]), (None, 1)], "doc_id long, toxic int")
    model = toxicity.train(docs, labels)
    got = {r.doc_id: r for r in toxicity.score(docs, model).collect()}
    assert sum(got[d].predicted == y for d, _, y in data if got[d].held_out) / sum(got[d].held_out for d, _, _ in data) > 0.97
    assert got[None].predicted == 1 and got[5002].predicted == 1 and got[5000].score == got[5001].score
    assert np.abs(model.v).max() > 0.3
    assert [tuple(r) for r in toxicity.score(docs, toxicity.train(docs, labels, terms_held=100_000)).collect()] == [tuple(r) for r in toxicity.score(docs, model).collect()]
    one = toxicity.train(docs, labels.where("toxic = 0"))
    assert {round(r.score, 6) for r in toxicity.score(docs, one).collect()} == {round(one.score(one.rows([toxicity.terms("")]))[0], 6)}


def test_language_of_odd_rows(spark):
    """No letter, null and empty: und; long texts are read in segments; repeated rows agree; extra columns are carried."""
    import numpy as np

    text = {"a": "lorem ipsum dolor sit amet ", "b": "das ist ein schöner tag über "}
    data = [(d, text["ab"[d % 2]] * (d % 5 + 1), "ab"[d % 2]) for d in range(300)] + [(900, None, "a"), (901, "", None), (902, "12 34 ?", "b"), (903, text["b"] * 300, None), (903, text["b"] * 300, None), (None, text["a"], "b")]
    docs = spark.createDataFrame([(*x, 7, "x") for x in data], "doc_id long, text string, lang string, n_chars long, score string")
    model = langid.train(docs)
    got = langid.predict(docs, model, carry=["n_chars", "text"]).collect()
    by = {r.doc_id: r for r in got}
    assert [(by[d].lang_pred, by[d].score) for d in (900, 901, 902)] == [("und", 0.0)] * 3
    assert by[903].lang_pred == "b" and by[None].lang_pred == "a" and not by[None].held_out and {r.n_chars for r in got} == {7}
    assert len({(r.lang_pred, r.score) for r in got if r.doc_id == 903}) == 1
    whole, cut = model.documents([(text["b"] * 300).encode()]), None
    old, langid.SEGMENT = langid.SEGMENT, 10**9
    try:
        cut = model.documents([(text["b"] * 300).encode()])
    finally:
        langid.SEGMENT = old
    assert np.abs(whole - cut).max() < 0.05
    nothing = langid.predict(docs, langid.train(docs.where("lang is null")))
    assert {r.lang_pred for r in nothing.collect()} == {"und"}


def test_samples_are_small_and_the_same_each_time(spark):
    from textloom.llm.common import smallest

    df = spark.range(5000).selectExpr("id as doc_id", "id % 7 as x")
    a, b = (sorted(r.doc_id for r in smallest(df.repartition(n), ["doc_id"], 100).collect()) for n in (1, 9))
    assert a == b and len(a) == 100 and len(smallest(df.limit(20), ["doc_id"], 100).collect()) == 20


def test_line_rule_with_more_holders(spark):
    line = "a line of some length"
    docs = spark.createDataFrame([(d, f"{line}\n{d}" + ("\nanother line of two" if d < 2 else "")) for d in range(3)], "doc_id long, text string")
    got = {r.doc_id: r.n_dropped for r in lines.dedup_lines(docs, least=3).collect()}
    assert got == {0: 0, 1: 1, 2: 1}
    assert {r.doc_id: r.n_dropped for r in lines.dedup_lines(docs).collect()} == {0: 0, 1: 2, 2: 1}


def test_secret_sql_reads_every_kind(spark, tmp_path):
    """The SQL against the query on texts that the driver's tables lack."""
    import duckdb

    body = "a1B" * 10
    sign = secret_scan.checksum(body)
    texts = [f"ghp_{body}{sign}", f"x npm_{body}{sign}, ghs_{body}{sign}", f"ghp_{body}000000", "API_KEY=abcdef apikey: 'xyz'", "é AKIA" + "Z" * 20 + " " + "f0" * 13, "passwordpassword=secret=abcdefg token = abc", None, ""]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    df = queries.op10_secrets(spark, str(tmp_path))
    assert rows(df) == sorted(con.execute(f"select {','.join(df.columns)} from ({queries.ORACLES['op10_secrets']})").fetchall())


def test_null_ids_repeated_rows_and_clashing_columns(spark):
    """Every operator on documents gives one row for each row, also without an id, and never reads columns of its own outputs' names."""
    data = [(None, "a text of some words here"), (None, None), (7, "a text of some words here"), (7, "a text of some words here"), (8, "x" * 300_000)]
    docs = spark.createDataFrame([(*x, "bad", -1, [1.5], True) for x in data], "doc_id long, text string, kept string, n_tokens long, spans array<double>, held_out boolean")
    bench, labels = spark.createDataFrame([(1, "a text of some words here", 5)], "item_id long, text string, contaminated int"), spark.createDataFrame([(7, 1, 1)], "doc_id long, toxic int, predicted int")
    made = {
        "lines": lines.dedup_lines(docs), "tokens": tokens.count_tokens(docs, P.path("byte_bpe_50k.json")), "simhash": simhash.near_groups(docs), "toxicity": toxicity.score(docs, toxicity.train(docs, labels)), "bpe": bpe.encode_documents(docs, P.path("byte_bpe_multi_50k.tiktoken"), P.PATTERN),
        "substrings": substrings.drop_repeats(docs, 4), "flags": decontaminate.flag_documents(docs, bench), "lang": langid.predict(docs, None), "secrets": secret_scan.scan_documents(docs),
    }
    got = {k: df.collect() for k, df in made.items()}
    for k, found in got.items():
        assert sorted(str(r.doc_id) for r in found) == ["7", "7", "8", "None", "None"], k
        assert len({str(r) for r in found if r.doc_id == 7}) == 1, k
    assert {r.contaminated for r in got["flags"] if r.doc_id is None} == {False} and {r.contaminated for r in got["flags"] if r.doc_id == 7} == {True}
    assert [r.n_removed for r in got["substrings"] if r.doc_id == 7] == [6, 6] and {r.kept for r in got["lines"] if r.doc_id == 7} == {data[0][1]}
