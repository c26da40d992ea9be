import numpy as np
import pytest
from pyspark.sql import functions as F

from trackweave.llm import ann


def vectors(spark, x, extra=()):
    rows = [(i, [float(c) for c in v]) for i, v in enumerate(x)] + list(extra)
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("leaf", F.lit("x")).withColumn("score", F.lit("x"))


def exact(x, ids, queries, k=5):
    x = np.asarray(x, dtype=np.float32).astype(np.float64)
    out = {}
    for q in queries:
        s = [((x[i] * x[q]).sum() / (np.sqrt((x[i] ** 2).sum()) * np.sqrt((x[q] ** 2).sum())), i) for i in ids if i != q]
        out[q] = sorted(s, key=lambda t: (-t[0], t[1]))[:k]
    return out


@pytest.fixture(scope="module")
def clustered():
    r = np.random.default_rng(1)
    centres = r.normal(size=(20, 16))
    x = centres[r.integers(0, 20, 3000)] + 0.6 * r.normal(size=(3000, 16))
    x[100:900] = x[100]
    return x


def test_recall_ties_and_rows_left_out(spark, clustered, monkeypatch):
    monkeypatch.setattr(ann, "GROUP_ROWS", 200)
    monkeypatch.setattr(ann, "GROUP_QUERIES", 20)
    bad = [(5000, None), (5050, []), (5100, [0.0] * 16), (5150, [float("nan")] * 16), (5200, [None] + [1.0] * 15), (5250, [float("inf")] * 16), (5300, [1.0] * 15), (5350, [1.0] * 17)]
    found, said = ann.approximate_neighbours(vectors(spark, clustered, bad), F.col("vec_id") % 50 == 0)
    got = {}
    for r in found.collect():
        got.setdefault(r.query_id, {})[r.rank] = (r.score, r.vec_id)
    want = exact(clustered, range(3000), range(0, 3000, 50))
    assert got.keys() == want.keys() and all(sorted(g) == [1, 2, 3, 4, 5] for g in got.values())
    assert said["recall"] >= 0.95
    hits = sum((s, i) in got[q].values() for q, t in want.items() for s, i in t)
    assert hits / (5 * len(want)) >= 0.9 and said["visited"] < said["leaves"]
    assert [got[150][k][1] for k in range(1, 6)] == [100, 101, 102, 103, 104]
    ranked = [[g[k] for k in range(1, 6)] for g in got.values()]
    assert all(t == sorted(t, key=lambda p: (-p[0], p[1])) for t in ranked)


def test_all_leaves_are_exact(spark, clustered):
    found, said = ann.approximate_neighbours(vectors(spark, clustered[:400]), F.col("vec_id") % 50 == 0, target_recall=2.0)
    assert said["visited"] == said["leaves"]
    got = {(r.query_id, r["rank"]): (r.score, r.vec_id) for r in found.collect()}
    assert got == {(q, k + 1): t for q, ts in exact(clustered[:400], range(400), range(0, 400, 50)).items() for k, t in enumerate(ts)}


def test_few_and_no_rows(spark):
    assert [(r.query_id, r["rank"], r.vec_id) for r in ann.approximate_neighbours(vectors(spark, [[1, 0], [1, 1]]), F.col("vec_id") == 0)[0].collect()] == [(0, 1, 1)]
    assert ann.approximate_neighbours(vectors(spark, []), F.col("vec_id") == 0)[0].count() == 0


def test_a_query_alone_in_its_leaf_still_finds_k(spark, monkeypatch):
    monkeypatch.setattr(ann, "calibrate", lambda *_: (1, 0.0))
    r = np.random.default_rng(4)
    x = np.concatenate((r.normal(size=(400, 8)), -50 * np.eye(8)[:1]))
    x[:400, 0] = abs(x[:400, 0])
    found, said = ann.approximate_neighbours(vectors(spark, x), F.col("vec_id") == 400)
    assert said["visited"] == 1 and found.count() == 5


def test_walk_visits_every_leaf_once(clustered):
    tree = ann.fit_tree(ann._unit(clustered))
    assert sorted(tree.walk(ann._unit(clustered[:1])[0], 10**6)) == list(range(tree.leaves))
