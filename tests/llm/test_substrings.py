import hashlib
import random

import numpy as np
from pyspark.sql import functions as F

from tests.llm.helpers import documents, with_clashes, words
from trackweave.llm import substrings as S


def brute(texts, length):
    seen, out = {}, {}
    for i, t in enumerate(texts):
        raw = (t or "").encode()
        gone = np.zeros(len(raw) + 1, bool)
        for p in range(len(raw) - length + 1):
            if seen.setdefault(raw[p : p + length], (i, p)) != (i, p):
                gone[p : p + length] = True
        gone = gone[: len(raw)]
        runs = int((gone & ~np.concatenate(([False], gone[:-1]))).sum()) if len(raw) else 0
        out[i] = (len(raw), int(gone.sum()), runs, hashlib.sha256(bytes(b for b, g in zip(raw, gone) if not g)).hexdigest())
    return out


def corpus(seed):
    r = random.Random(seed)
    passage, other = " ".join(words(1, 60)), " ".join(words(2, 80))
    texts = [None, "", "short", "é" * 300, "ab" * 200, passage, passage, passage[3:], passage[:150] + "X" + passage[151:], "a" * 99, "a" * 100, "a" * 101]
    for k in range(40):
        a, b = r.randrange(len(passage)), r.randrange(len(other))
        texts.append(" ".join(words(k + 10, r.randrange(30))) + passage[a : a + 180] + r.choice(["", "ü", "zz"]) + other[b : b + r.randrange(300)])
    return texts + [texts[20] + texts[21], "".join(words(3, 4000)) + other]


def check(spark, texts, length=100, gram=32):
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in S.remove_repeats(with_clashes(documents(spark, texts)), length, gram).collect()}
    assert got == brute(texts, length)


def test_matches_brute_force(spark):
    check(spark, corpus(1))


def test_short_strings_small_chunks_and_large_buckets(spark, monkeypatch):
    monkeypatch.setattr(S, "BUCKET_CELLS", 3)
    monkeypatch.setattr(S, "PIECE", 500)
    monkeypatch.setattr(S, "RANKED", 20)
    check(spark, corpus(2), length=20, gram=6)
    r = random.Random(3)
    check(spark, ["".join(r.choice("ab") for _ in range(200)) for _ in range(20)], length=12, gram=4)


def test_shared_ids_nulls_and_empty_tables(spark):
    text = " ".join(words(5, 60))
    docs = documents(spark, [text, "x", text]).withColumn("doc_id", F.when(F.col("doc_id") == 2, 0).otherwise(F.col("doc_id")))
    docs = docs.union(docs.withColumn("doc_id", F.lit(None).cast("long")))
    assert [(r.doc_id, r.n_removed) for r in S.remove_repeats(docs).orderBy("doc_id").collect()] == [(0, 0), (0, 0), (1, 0)]
    assert S.remove_repeats(docs.where("false")).count() == 0


def test_equal_windows_lie_in_equal_cells():
    r = random.Random(9)
    raw = bytes(r.choice(b"abc") for _ in range(3000))
    texts = [raw, raw[777:1900], bytes(r.choice(b"abc") for _ in range(50)) + raw[100:900]]
    text, lo, off, n, g, _ = S.cells_of(texts, S.Hasher(), 40, 10)
    by = {}
    for t, a, o, k, x in zip(text, lo, off, n, g):
        for j in range(k):
            by.setdefault(texts[t][a + j : a + j + 40], set()).add((o - j, x))
    assert all(len(v) == 1 for v in by.values()) and sum(n) == sum(len(t) - 39 for t in texts)
