"""Cross-tokenizer alignment: where two tokenizers' tokens meet, and how often their ids are linked.

Two pointers run over the cumulative ends of a text's A and B tokens; wherever both end at one byte a group ends,
and all A tokens of a group are linked with all its B tokens.  `mapInPandas` emits a row per document and a row per
document and pair of ids that it holds linked.  These go to a written table; Spark groups it by pair
for the number of documents, by either id for that side's maximum, and joins all three back to the links.

Both ends stand wherever white space follows something else, and before signs that no B piece has after a letter.
So texts are cut there, and the pointers run once over each different cut that a worker meets.  Whether B's pieces
allow it is read from the model; otherwise a text is one cut.  B is a BPE model.

Pairs that more than a millionth of all links name are at most a million; they are broadcast with that
bound.  The other pairs, none of which is hot, meet their links by a shuffle.

A is a byte-level file as in `backtrack`, special strings plain; B a sentencepiece file.  Null and empty texts, and
those whose A or B bytes are not a space and the text, have no tokens: zeros and an empty column `groups`.  Ties for a maximum
all count.  A null doc_id stays null; repeated rows are each aligned and each count as a document; an empty table gives no rows;
texts are aligned whole; columns but doc_id and text are never read.  The written table stays in the shared folder
as long as the result is needed.
"""

from __future__ import annotations

import gc
import hashlib
import re
from array import array
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import sentencepiece
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .backtrack import ByteLevel, near_classes, parts
from .common import cut, hold, texts, written
from .tokens import WORDS

CUTS_KEPT = 120_000  # cuts that a worker remembers; forgetting costs time alone
HOT = 1_000_000  # pairs that are broadcast at most
SIGNS = "!\"#$%&()*+,-./:;<=>?@[]^_`{|}~"
SPACE = "▁"
NO_TOKENS = (0, 0, 0, 0, "", np.zeros(0, np.int64), np.zeros(0, np.int64))


class Aligner:
    def __init__(self, path_a: str, path_b: str):
        self.a = a = ByteLevel(path_a)
        made = sorted((t for t in range(a.size) if a.rank[t] >= 0), key=a.rank.__getitem__)
        if made != sorted(made):
            raise ValueError("A's ids are not in the order of its merges")
        self.encode_a = tiktoken.Encoding("a", pat_str=WORDS.pattern, mergeable_ranks={a.data[t]: t for t in (*a.single, *made)}, special_tokens={}).encode_ordinary
        self.b = b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        n = b.get_piece_size()
        pieces = [b.id_to_piece(i) for i in range(n)]
        self.bytes_b = [bytes([int(p[3:-1], 16)]) if b.is_byte(i) else p.replace(SPACE, " ").encode("utf-8") for i, p in enumerate(pieces)]
        self.size_b = n
        self.len_a, self.len_b = self.a.length, [len(x) for x in self.bytes_b]
        inside = {p[i : i + 2] for j, p in enumerate(pieces) if not b.is_byte(j) for i in range(len(p) - 1)}
        # what stands before a line feed never runs on: a cut is encoded after one, which takes no space of the model's own
        self.head = len(b.encode("\n"))
        self.cuts = None
        if not any("\n" in x or x[0] not in " \n" + SPACE and x[1] in " " + SPACE for x in inside):
            letters = near_classes()[0]
            letter = re.compile(f"[{letters}]")
            ends = "".join("\\" + s for s in SIGNS if not any(x[1] == s and letter.match(x) for x in inside))
            # ends are a letter before such a sign, and anything but white space before a space or line feed
            self.cuts = re.compile(rf"\s*+[{letters}]++(?=[{ends} \n])|(?:\s*+\S++)+?(?=[ \n])|.+", re.S)
        self.known: dict[str, tuple | None] = {}

    def meet(self, a: list[int], b: list[int]) -> tuple:
        """Tokens of either side, groups, links, groups as text, a key for each link, and keys of long groups with their numbers."""
        len_a, len_b, size = self.len_a, self.len_b, self.size_b
        said, keys, long, links = [], array("q"), {}, 0
        i = j = start_a = start_b = 0
        end_a, end_b = len_a[a[0]], len_b[b[0]]
        while True:
            if end_a < end_b:
                i += 1
                end_a += len_a[a[i]]
            elif end_b < end_a:
                j += 1
                end_b += len_b[b[j]]
            else:
                if i == start_a and j == start_b:
                    links += 1
                    said.append(f"{a[i]}|{b[j]}")
                    keys.append(a[i] * size + b[j])
                else:
                    of_a, of_b = a[start_a : i + 1], b[start_b : j + 1]
                    links += len(of_a) * len(of_b)
                    said.append(f"{','.join(map(str, of_a))}|{','.join(map(str, of_b))}")
                    if len(of_a) * len(of_b) < 64:
                        keys.extend([x * size + y for x in of_a for y in of_b])
                    else:  # repeats within a long group are multiplied, not written out
                        times_b = Counter(of_b).items()
                        for x, n in Counter(of_a).items():
                            for y, m in times_b:
                                long[x * size + y] = long.get(x * size + y, 0) + n * m
                i += 1
                j += 1
                if i == len(a):
                    break
                start_a, start_b = i, j
                end_a += len_a[a[i]]
                end_b += len_b[b[j]]
        return len(a), len(b), len(said), links, ";".join(said), keys.tobytes(), long

    def align(self, batch: list[str]) -> list[tuple]:
        """Of each whole text: tokens of either side, groups, links, groups as text, keys of linked pairs, how often each is linked."""
        known = self.known
        if len(known) > CUTS_KEPT:
            known.clear()
        found = [(self.cuts.findall(" " + t) if self.cuts else [" " + t]) if t else [] for t in batch]
        new = list(set().union(*found).difference(known))
        of_b = self.b.encode(["\n" + c for c in new], num_threads=1) if new else []
        for c, b in zip(new, of_b, strict=True):
            b = b[self.head :]
            same = b"".join([self.bytes_b[i] for i in b]) == c.encode("utf-8")
            known[c] = self.meet(self.encode_a(c), b) if same else None
        out = []
        for cuts in found:
            got = list(map(known.__getitem__, cuts))
            if not got or None in got:
                out.append(NO_TOKENS)
                continue
            na, nb, ng, nl, said, keys, long = zip(*got, strict=True)
            k = np.sort(np.frombuffer(b"".join(keys), np.int64))
            first = np.flatnonzero(np.r_[True, k[1:] != k[:-1]][: len(k)])
            k, times = k[first], np.diff(np.r_[first, len(k)])
            if any(long):
                pairs = Counter(dict(zip(k.tolist(), times.tolist(), strict=True)))
                for x in filter(None, long):
                    pairs.update(x)
                k, times = np.fromiter(pairs, np.int64, len(pairs)), np.fromiter(pairs.values(), np.int64, len(pairs))
            out.append((sum(na), sum(nb), sum(ng), sum(nl), ";".join(said), k, times))
        return out


@lru_cache(1)
def _aligner(path_a: str, path_b: str) -> Aligner:
    return Aligner(path_a, path_b)


def links(docs: DataFrame, path_a: str, path_b: str, digests: bool = True) -> DataFrame:
    """Rows of documents (a is null) and, under the same `row`, rows of the pairs (a, b) that they hold linked, `times` each."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hold("align", _aligner.cache_clear)
        al = _aligner(path_a, path_b)
        gc.freeze()
        none = lambda n: pd.array([None] * n, "Int64")
        for batch in batches:
            at = 0
            for some in parts(batch.text):
                b = batch.iloc[at : at + len(some)]
                at += len(some)
                na, nb, ng, nl, said, keys, times = zip(*al.align(some), strict=True)
                yield pd.DataFrame({"row": b.row.to_numpy(), "doc_id": b.doc_id.astype("Int64").to_numpy(), "n_a": na, "n_b": nb, "n_groups": ng, "n_links": nl, "groups": [hashlib.sha256(s.encode()).hexdigest() if s and digests else s for s in said], "a": none(len(b)), "b": none(len(b)), "times": none(len(b))})
                full = [i for i, k in enumerate(keys) if len(k)]
                for lo in range(0, len(full), 64):
                    mine = full[lo : lo + 64]
                    k = np.concatenate([keys[i] for i in mine])
                    a, bb = np.divmod(k, al.size_b)
                    row = np.repeat(b.row.to_numpy()[mine], [len(keys[i]) for i in mine])
                    yield pd.DataFrame({"row": row, "doc_id": None, "n_a": None, "n_b": None, "n_groups": None, "n_links": None, "groups": None, "a": a, "b": bb, "times": np.concatenate([times[i] for i in mine])})

    rows = texts(docs).withColumn("row", F.monotonically_increasing_id())
    return rows.mapInPandas(run, "row long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups string, a int, b int, times long")


def align_documents(docs: DataFrame, path_a: str, path_b: str, digests: bool = True, hot: int = HOT) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best_a and n_best_b (links whose count is the highest of their A or B id),
    count_sum (of all links), groups (`a1,a2|b1;a3|b2,b3`, or its digest)."""
    kept = written(links(docs, path_a, path_b, digests))
    pairs = kept.where("a is not null").select("row", "a", "b", "times")
    counts = cut(pairs.groupBy("a", "b").agg(F.count("*").alias("count")))
    total = counts.agg(F.coalesce(F.sum("count"), F.lit(0))).first()[0]
    best = lambda c: counts.groupBy(c).agg(F.max("count").alias(f"best_{c}"))
    judged = cut(counts.join(best("a"), "a").join(best("b"), "b").select("a", "b", "count", (F.col("count") == F.col("best_a")).alias("is_a"), (F.col("count") == F.col("best_b")).alias("is_b")))
    often = F.broadcast(judged.where(F.col("count") * hot > total))  # fewer than `hot`: their counts add up to total at most
    rare = judged.where(F.col("count") * hot <= total)

    def sums(df: DataFrame) -> DataFrame:
        of = lambda c, name: F.sum(F.when(F.col(c), F.col("times")).otherwise(0)).alias(name)
        none = [F.lit(None).cast(t).alias(c) for c, t in kept.dtypes if c in DOCUMENT]
        return df.groupBy("row").agg(of("is_a", "n_best_a"), of("is_b", "n_best_b"), F.sum(F.col("times") * F.col("count")).alias("count_sum")).select("row", *none, "n_best_a", "n_best_b", "count_sum")

    zero = [F.lit(0).cast("long").alias(c) for c in ("n_best_a", "n_best_b", "count_sum")]
    every = kept.where("a is null").select("row", *DOCUMENT, *zero).union(sums(pairs.join(often, ["a", "b"]))).union(sums(pairs.join(often.select("a", "b"), ["a", "b"], "left_anti").join(rare, ["a", "b"])))
    return every.groupBy("row").agg(*[F.max(c).alias(c) for c in DOCUMENT], *[F.sum(c).alias(c) for c in ("n_best_a", "n_best_b", "count_sum")]).drop("row")


DOCUMENT = ("doc_id", "n_a", "n_b", "n_groups", "n_links", "groups")
