import math
import random
import zlib
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from tests.llm.helpers import documents, with_clashes
from trackweave.llm import lm


def grammar(seed, n=60):
    r = random.Random(seed)
    return " ".join(f"{s} {v} {o}." for s, v, o in ((r.choice("ABC"), r.choice(["sees", "hears"]), f"thing{r.randrange(300)}") for _ in range(n)))


def held():
    return F.crc32(F.col("doc_id").cast("string")) % 7 == 2


def brute(texts):
    toks = [[w for w in "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "").replace("\n", " ").replace("\t", " ").split(" ") if w] + [" "] for t in texts]
    held = [zlib.crc32(str(i).encode()) % 7 == 2 for i in range(len(texts))]
    c = Counter(w for t, h in zip(toks, held) if not h for w in t)
    n, v = sum(c.values()), len(c)
    return [(h, len(t), sum(c[w] > 0 for w in t), n, sum(math.log10((c[w] + 1) / (n + v + 1)) for w in t)) for t, h in zip(toks, held)]


def test_base_matches_brute_force_and_model_beats_it_held_out(spark):
    texts = [grammar(i) for i in range(150)] + [None, "", " \n\t ", "Éa éA ÉA", "hapax legomenon", grammar(3), "x " * 5000]
    rows = {r.doc_id: r for r in lm.score_documents(with_clashes(documents(spark, texts)), held(), chunk_bytes=20_000).collect()}
    want = brute(texts)
    assert len(rows) == len(texts)
    for i, (h, n, known, total, base) in enumerate(want):
        r = rows[i]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (h, n, known, total) and abs(r.base_score - base) < 1e-6
    out = [r for r in rows.values() if r.held_out and r.n_tokens > 100]
    assert out and sum(r.score for r in out) > 0.8 * sum(r.base_score for r in out)
    few = {r.doc_id: r for r in lm.score_documents(documents(spark, texts), held(), chunk_bytes=20_000, least_words=40, most_words=40).collect()}
    assert all(few[i].base_score == rows[i].base_score for i in rows) and sum(few[r.doc_id].score for r in out) > sum(r.base_score for r in out)


def test_probabilities_sum_to_one():
    rng = np.random.default_rng(0)
    counts = rng.integers(0, 90, 23)
    start = lm.LogBilinear.start(counts)
    ids = rng.integers(0, 23, 900).astype("<i4")
    model, seen = lm.learn(start.filled(start.flat()), start, [([400, 500], [False, False], lm.packed(ids))], step=100)
    assert seen == 900 and abs(model.p["q"]).max() > 0
    for m in (start, model):
        for a, b in ((0, 0), (23, 23), (3, 7)):
            logs = m.log_probabilities(np.full(23, a), np.full(23, b), np.arange(23), step=4)
            assert abs(np.exp(logs).sum() - 1) < 1e-5
    assert np.allclose(np.exp(start.log_probabilities(np.zeros(23, int), np.zeros(23, int), np.arange(23))), (counts + 1) / (counts.sum() + 23), atol=1e-6)


def test_gradient_lowers_the_contrastive_loss():
    rng = np.random.default_rng(1)
    ids = np.tile(rng.integers(0, 30, 50), 60)
    start = lm.LogBilinear.start(np.bincount(ids, minlength=30))
    model, _ = lm.learn(start.filled(start.flat()), start, [([len(ids)], [False], lm.packed(ids))] * 5, step=256)
    first, second = lm.contexts(ids, np.array([0]), 30)
    assert model.log_probabilities(first, second, ids).mean() > start.log_probabilities(first, second, ids).mean() + 1


def test_rare_words_share_frequency_classes(spark):
    totals = spark.createDataFrame([(i, c) for i, c in enumerate([90, 50, 7, 5, 4, 3, 1, 1, 0])], "h long, c long")
    v = lm.vocabulary(totals, least=2, most=2)
    assert (v.named, v.size, v.kinds) == (2, 161, 8) and v.counts[:2].tolist() == [90, 50] and v.counts[2:5].tolist() == [2, 3, 16]
    classes, share = v.classes_of(np.arange(9), np.array([90, 50, 7, 5, 4, 3, 1, 1, 0]))
    assert classes.tolist() == [0, 1, 4, 4, 4, 3, 2, 2, 2] and abs(sum(10 ** share[[6, 7, 8]]) - 1) < 1e-9 and abs(sum(10 ** share[[2, 3, 4]]) - 1) < 1e-9


def test_contexts_stop_at_texts():
    first, second = lm.contexts(np.array([1, 2, 3, 4, 5]), np.array([0, 3]), 9)
    assert first.tolist() == [9, 9, 1, 9, 9] and second.tolist() == [9, 1, 2, 9, 4]


def test_empty_table_and_nothing_to_learn_from(spark):
    assert lm.score_documents(documents(spark, []), held()).count() == 0
    only = lm.score_documents(documents(spark, ["a b"]), F.lit(True)).first()
    assert (only.n_tokens, only.n_known, only.train_tokens) == (3, 0, 0) and only.base_score == 0.0
