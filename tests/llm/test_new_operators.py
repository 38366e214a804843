"""Fill-in-middle, backtracking BPE and token alignment against plain versions and the libraries."""

import hashlib
import random
from collections import Counter, defaultdict
from itertools import product

import duckdb
import numpy as np
import public_tokenizers as P
import pytest
import sentencepiece
from pyspark.sql import functions as F
from test_operators import SCHEMA, odd_rows
from textloom.llm import align, backtrack, fim, queries
from tokenizers import Tokenizer

A, B = P.path("byte_bpe_50k.json"), P.path("piece_bpe_32k.model")
SIGNS = ["a", "b", "the", " ", "  ", "\n", "é", "日", "1", "9", "'s", ".", "-", "==", "　", "\x1c", "ing", "un", "🙂", "\x00", "\t", ",", "#", "²", "क", "ि", "\r", ");", "\x85", "(", "Д", "​", "_", "▁", "<s>", "<0x41>", "<|endoftext|>"]


def more_rows():
    rng = random.Random(9)
    odd = ["<P> in a text", "a <S", "M> b <M", "x" * 70_000 + " tail", "日本語 🙂 " * 3000, "\n", " ", "<|endoftext|><|endoftext|> a"]
    return odd_rows() + [(None, "no id, twice"), (None, "no id, twice"), (-7, "negative id")] + list(enumerate(odd, 100)) + [(200 + i, "".join(rng.choices(SIGNS, k=rng.randint(1, 60)))) for i in range(150)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(d, t, "en", "s", 0, "clash", 1) for d, t in more_rows()], SCHEMA).repartition(3)


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def plain_fim(doc_id, text):
    text = text or ""
    h = hashlib.sha256(f"1:{'null' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[8 * i : 8 * i + 8], 16) for i in range(4))
    n = len(text)
    if not text or any(s in text for s in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return doc_id, n, "plain", None, None, text
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = text[:a], text[a:b], text[b:]
    return (doc_id, n, "spm", a, b - a, f"<S>{s}<P>{p}<M>{m}") if h4 % 100 < 20 else (doc_id, n, "psm", a, b - a, f"<P>{p}<S>{s}<M>{m}")


def test_fill_in_middle_cuts_moves_and_restores(docs):
    got = fim.fill_in_middle(docs)
    assert rows(got) == sorted((plain_fim(d, t) for d, t in more_rows()), key=repr)
    assert rows(got.select("doc_id", fim.restored())) == sorted(((d, t or "") for d, t in more_rows()), key=repr)


@pytest.mark.parametrize("unit", ["char", "word", "line"])
def test_units_start_where_a_plain_walk_says(unit):
    for _, t in more_rows():
        t = t or ""
        at = [i for i in range(len(t)) if i == 0 or unit == "char" or (unit == "line" and t[i - 1] == "\n") or (unit == "word" and t[i - 1] in fim.WS and t[i] not in fim.WS)]
        data, bits = t.encode(), fim.starts(t.encode(), unit)
        assert bits.bit_count() == len(at)
        ranks = sorted({0, len(at) // 3, len(at) // 2, len(at)})
        assert fim.select(bits, len(data), ranks) == [len(t[: at[r]].encode()) if r < len(at) else len(data) for r in ranks]


def test_unknown_unit_is_refused():
    with pytest.raises(ValueError):
        fim.starts(b"x", "page")


@pytest.mark.parametrize("special", [True, False])
def test_backtracking_matches_the_library(docs, special):
    t = Tokenizer.from_file(A)
    t.encode_special_tokens = not special
    want = []
    for d, x in more_rows():
        ids = t.encode(x or "", add_special_tokens=False).ids
        want.append((d, len(ids), ids, t.decode(ids, skip_special_tokens=False)))
    assert rows(backtrack.encode_documents(docs, A, special, digests=False)) == sorted(want, key=repr)


def test_op12_digests(spark):
    sf = "/root/testdata/sf0.001"
    t = Tokenizer.from_file(A)
    want = []
    for r in spark.read.parquet(f"{sf}/documents.parquet").collect():
        ids = t.encode(r.text or "", add_special_tokens=False).ids
        want.append((r.doc_id, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(t.decode(ids, skip_special_tokens=False).encode()).hexdigest()))
    assert rows(queries.op12_backtracking_bpe(spark, sf)) == sorted(want, key=repr)


def test_pairs_stand_as_merging_says():
    e, t = backtrack.encoder(A), Tokenizer.from_file(A)
    t.pre_tokenizer = None
    from tokenizers import pre_tokenizers

    t.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
    rng = random.Random(4)
    short = [i for i in range(e.size - 1) if e.data[i].isascii()]
    held = [(a, b) for a, b in zip(rng.choices(short, k=3000), rng.choices(short, k=3000), strict=True)]
    for a, b in held:
        ids = t.encode((e.data[a] + e.data[b]).decode(), add_special_tokens=False).ids
        assert e.compatible(a, b) == (ids == [a, b])


def test_forgetting_changes_nothing(monkeypatch):
    text = " ".join(t or "" for _, t in more_rows())
    want = backtrack.Encoder(A).encode([text])
    for name in ("WORDS_KEPT", "PAIRS_KEPT", "MOVES_KEPT"):
        monkeypatch.setattr(backtrack, name, 10)
    e = backtrack.Encoder(A)
    assert [e.encode([text]) for _ in range(3)] == [want] * 3


def test_other_files_are_refused():
    with pytest.raises(ValueError):
        backtrack.Encoder(P.path("word_bpe_49k.json"))


def plain_alignment(data):
    t, sp = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
    t.encode_special_tokens = True
    e = backtrack.encoder(A)
    of_b = lambda i: bytes([int(sp.id_to_piece(i)[3:-1], 16)]) if sp.is_byte(i) else sp.id_to_piece(i).replace("▁", " ").encode()
    out, held = [], defaultdict(set)
    for row, (d, text) in enumerate(data):
        groups = []
        if text:
            a, b = t.encode(" " + text, add_special_tokens=False).ids, sp.encode(text)
            xs, ys = [e.data[i] for i in a], [of_b(i) for i in b]
            if b"".join(xs) == b"".join(ys) == (" " + text).encode():
                ends_a, ends_b = np.cumsum(list(map(len, xs))).tolist(), np.cumsum(list(map(len, ys))).tolist()
                low = 0
                for end in sorted(set(ends_a) & set(ends_b)):
                    groups.append(([x for x, k in zip(a, ends_a, strict=True) if low < k <= end], [y for y, k in zip(b, ends_b, strict=True) if low < k <= end]))
                    low = end
        pairs = Counter(p for g in groups for p in product(*g))
        for p in pairs:
            held[p].add(row)
        out.append((d, groups, pairs))
    best = Counter()
    for (a, _), of in held.items():
        best[a] = max(best[a], len(of))
    said = lambda groups: ";".join(f"{','.join(map(str, a))}|{','.join(map(str, b))}" for a, b in groups)
    return [(d, sum(len(a) for a, _ in g), sum(len(b) for _, b in g), len(g), sum(p.values()), sum(n for x, n in p.items() if len(held[x]) == best[x[0]]), sum(n * len(held[x]) for x, n in p.items()), said(g)) for d, g, p in out]


# walks through every prefix of a long text would take long: the texts of over 20,000 code points are tested by length
SOME = [(d, t) for d, t in more_rows() if len(t or "") < 20_000]
COLUMNS = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best_a", "count_sum", "groups"]


@pytest.mark.parametrize("hot", [align.HOT, 20, 0])
def test_alignment_against_a_plain_version(spark, hot):
    some = spark.createDataFrame([(d, t, "en", "s", 0, "clash", 1) for d, t in SOME], SCHEMA).repartition(3)
    assert rows(align.align_documents(some, A, B, digests=False, hot=hot).select(COLUMNS)) == sorted(plain_alignment(SOME), key=repr)


def test_long_groups_are_multiplied():
    al = align.Aligner(A, B)
    al.len_a, al.len_b = [1] * len(al.len_a), [3] * len(al.len_b)
    na, nb, ng, links, said, keys, long = al.meet([5] * 90 + [6] * 30, [7] * 40)
    assert (na, nb, ng, links) == (120, 40, 40, 120) and len(keys) == 120 * 8 and not long
    al.len_a, al.len_b = [2] * len(al.len_a), [1] * 6 + [129] + [1] * len(al.len_b)
    na, nb, ng, links, said, keys, long = al.meet([5] * 65, [6, 7])
    assert (ng, links, keys) == (1, 130, b"") and long == {5 * al.size_b + 6: 65, 5 * al.size_b + 7: 65}


def test_cuts_change_nothing():
    whole = align.Aligner(A, B)
    whole.cuts = None
    texts = [t or "" for _, t in SOME]
    for a, b in zip(align.Aligner(A, B).align(texts), whole.align(texts), strict=True):
        assert a[:5] == b[:5] and dict(zip(a[5].tolist(), a[6].tolist(), strict=True)) == dict(zip(b[5].tolist(), b[6].tolist(), strict=True))


def test_empty_tables(spark):
    none = spark.createDataFrame([], SCHEMA)
    for df in (fim.fill_in_middle(none), backtrack.encode_documents(none, A), align.align_documents(none, A, B)):
        assert df.count() == 0


def test_sql_of_fill_in_middle(spark):
    sf = "/root/testdata/sf0.01"
    con = duckdb.connect()
    con.sql(f"create view documents as select * from '{sf}/documents.parquet'")
    got = queries.op11_fill_in_middle(spark, sf)
    assert rows(got.select(*sorted(got.columns))) == sorted(con.sql(f"select {', '.join(sorted(got.columns))} from ({queries.ORACLES['op11_fill_in_middle']})").fetchall(), key=repr)
    assert got.where(F.col("form") == "psm").count() > 400
