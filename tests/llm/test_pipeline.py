"""Stages keep rows apart where doc_id is null or repeats."""

import corpus_pipeline

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
LONG = "a line that several of the documents hold"
DATA = [
    (1, f"{LONG}\nfirst words of the one", "en", "a"), (1, f"{LONG}\nother words of the same id", "de", "b"), (1, "", "fr", "c"), (2, f"{LONG}\nsecond", "en", "d"),
    (None, f"{LONG}\nno id here", "en", "e"), (None, "12 34", None, "f"), (3, None, None, None),
]


def rows(df):
    return sorted((tuple(r) for r in df.select(corpus_pipeline.COLUMNS).collect()), key=str)


def table(spark):
    return spark.createDataFrame([(d, t, x, s, len(t or "")) for d, t, x, s in DATA], SCHEMA)


def test_line_stage_keeps_rows_and_their_columns(spark):
    want = []
    for d, t, x, s in DATA:
        t = "\n".join(y for y in (t or "").split("\n") if not (d == 2 and y == LONG))
        want.append((d, t, x, s, len(t)))
    assert rows(corpus_pipeline.drop_shared_lines(spark, table(spark), "")) == sorted(want, key=str)


def test_language_stage_judges_rows(spark, monkeypatch):
    from textloom.llm import langid

    by_letter = lambda docs, model, carry: docs.selectExpr("doc_id", "if(text rlike '[a-z]', 'en', 'und') as lang_pred", "1D as score", *carry)
    monkeypatch.setattr(langid, "train", lambda docs: None)
    monkeypatch.setattr(langid, "predict", by_letter)
    want = [(d, t, x, s, len(t)) for d, t, x, s in DATA if t and any(c.isalpha() for c in t)]
    got = [r for r in rows(corpus_pipeline.keep_known_language(spark, table(spark), ""))]
    assert [r for r in got if r[1] is not None] == sorted(want, key=str)


def test_leak_stage_judges_rows(spark, tmp_path):
    spark.createDataFrame([(1, "first words of the one")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    want = [(d, t, x, s, len(t or "")) for d, t, x, s in DATA if "first words" not in (t or "")]
    assert rows(corpus_pipeline.drop_benchmark_leaks(spark, table(spark), str(tmp_path))) == sorted(want, key=str)


def test_every_stage_of_odd_rows_of_an_empty_table_and_of_files(spark, tmp_path):
    """Null and repeated ids, null and empty texts, equal rows and clashing columns; then no rows at all."""
    spark.createDataFrame([(1, "no words of any document stand in this one")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    odd = table(spark).union(table(spark)).selectExpr("*", "'x' as kept", "1 as row", "'y' as score")
    odd.write.parquet(f"{tmp_path}/documents.parquet")
    files = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for docs in (odd, files, odd.limit(0)):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, str(tmp_path))
            n = out.count()
            if name in ("line_dedup", "bpe"):
                assert n == docs.count()
            if name == "simhash_near_dedup" and n:
                assert len({r.text or "" for r in out.collect()}) == n
            assert (out.columns == corpus_pipeline.COLUMNS) == (name != "bpe")


def test_run_against_plain_stages(spark, tmp_path):
    """All five stages over small documents, and what plain rules leave of them."""
    import base64
    import hashlib

    import public_tokenizers as P
    import tiktoken
    from textloom.llm import langid

    rows_ = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select(corpus_pipeline.COLUMNS).orderBy("doc_id").collect()
    spark.createDataFrame(rows_).write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    model = langid.train(docs)
    kept = []
    for r in rows_:
        data = (r.text or "").encode()
        if r.text and langid.LETTER.search(r.text) and model.documents([data]).max() >= 0.5:
            kept.append([r.doc_id, r.text])
    key = lambda x: x.strip(" \t\n\x0b\x0c\r").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
    first = {}
    for d, t in kept:
        for x in t.split("\n"):
            if len(key(x)) >= 10:
                first[key(x)] = min(first.get(key(x), d), d)
    kept = [(d, "\n".join(x for x in t.split("\n") if len(key(x)) < 10 or first[key(x)] == d)) for d, t in kept]

    def grams(t, n):
        w = t.encode().lower().split()
        return {b" ".join(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set()

    sets, root = [grams(t, 5) for _, t in kept], list(range(len(kept)))
    for i in range(len(kept)):
        for j in range(i):
            if len(sets[i] & sets[j]) * 10 >= len(sets[i] | sets[j]) * 8:
                a, b = root[i], root[j]
                root = [min(a, b) if x in (a, b) else x for x in root]
    kept = [x for i, x in enumerate(kept) if root[i] == i]
    flat = lambda t: " ".join("".join(c for c in t.lower() if c.isalnum() or c.isspace()).split())
    items = [flat(r.text) for r in docs.sparkSession.read.parquet(f"{tmp_path}/benchmark.parquet").collect()]
    kept = [(d, t) for d, t in kept if not any(x in flat(t) for x in items)]
    e = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks={base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path("byte_bpe_multi_50k.tiktoken"), "rb"))}, special_tokens={})
    want = sorted((d, hashlib.sha256(",".join(map(str, e.encode_ordinary(t))).encode()).hexdigest()) for d, t in kept)
    got = sorted((r.doc_id, r.ids_sha256) for r in corpus_pipeline.run(spark, str(tmp_path)).collect())
    assert sorted(set(got) - set(want)) == [] and sorted(set(want) - set(got)) == []
