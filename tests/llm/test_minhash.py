"""MinHash near-dedup against every pair's whole sets."""

import random

import duckdb
import numpy as np
import pytest

from tests.llm.helpers import documents, with_clashes, words
from trackweave.llm import minhash


def plain_set(text, k=5):
    w = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").replace("\x0b", " ").replace("\x0c", " ").split()
    return frozenset(tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))) if w else frozenset()


def plain_groups(texts, percent=85):
    sets, root = [plain_set(t) for t in texts], list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(sets)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return [(i, len(s), find(i), find(i) == i) for i, s in enumerate(sets)]


def edited(own, n, r):
    own = list(own)
    for _ in range(n):
        own[r.randrange(len(own))] = f"e{r.randrange(10**9)}"
    return own


def corpus(seed, bases=12, copies=14):
    r = random.Random(seed)
    passage, out = words(99, 60), []
    for k in range(bases):
        base = words(1000 * seed + k, r.choice([40, 120, 200, 500]), 5000)
        out += [" ".join(base)] + [" ".join(edited(base, r.randrange(1, 8), r)) for _ in range(copies)]
    out += [" ".join(words(5000 + k, 60, 5000) + passage) for k in range(80)]  # share a passage and nothing else
    out += [None, "", " \n", "one", "ONE", "one two three four", "a b c d e f", "a b c d e f g", out[0].upper(), out[0], "big " * 20_000]
    r.shuffle(out)
    return out


def rows_of(df):
    return sorted((r["doc_id"], r["n_shingles"], r["component_id"], r["kept"]) for r in df.collect())


@pytest.mark.parametrize(("bucket", "tile"), [(64, 512), (3, 5)])
def test_groups_equal_brute_force(spark, monkeypatch, bucket, tile):
    monkeypatch.setattr(minhash, "BUCKET", bucket)
    monkeypatch.setattr(minhash, "TILE", tile)
    texts = corpus(3)
    got, want = rows_of(minhash.minhash_groups(with_clashes(documents(spark, texts)))), plain_groups(texts)
    assert got == want and len({c for _, _, c, k in want if not k}) > 5


def test_crowd_of_copies_and_chains(spark):
    """A crowd whose members are similar to their base alone, and a chain whose ends are not similar."""
    r = random.Random(5)
    base = words(7, 400, 5000)
    crowd = [" ".join(edited(base, 11, r)) for _ in range(150)]
    chain = [words(8, 300, 5000)]
    for _ in range(12):
        chain.append(edited(chain[-1], 5, r))
    texts = crowd[:75] + [" ".join(base)] + crowd[75:] + [" ".join(c) for c in chain]
    assert rows_of(minhash.minhash_groups(documents(spark, texts))) == plain_groups(texts)


def test_crowd_of_unlike_copies_makes_few_pairs(spark):
    """Copies of a text that is not there, too far from each other, share its shingles and nearly a signature; only some share their edits."""
    r = random.Random(11)
    base = words(17, 135, 5000)
    texts = [" ".join(edited(base, 2, r)) for _ in range(200)]
    texts += [f"{t} more" for t in texts[:20]]
    docs = documents(spark, texts)
    found = minhash.signatures(docs, 5)
    firsts = found.select("node", "doc_id", "n", "sig").distinct()
    members = firsts.select("node", firsts["node"].alias("component"))
    made = minhash.crowded_pairs(members, docs.select("doc_id", "text"), firsts, 5, 85, minhash.most_different(85))
    pairs = {frozenset(x) for x in made.select("a", "b").collect()}
    ids = {x.doc_id: x.node for x in firsts.collect()}
    sets = [plain_set(x.text) for x in docs.orderBy("doc_id").collect()]
    similar = [(i, j) for i in range(len(sets)) for j in range(i) if 100 * len(sets[i] & sets[j]) >= 85 * len(sets[i] | sets[j])]
    assert len(similar) >= 20 and all(frozenset((ids[i], ids[i - 200])) in pairs for i in range(201, 220))
    assert len(pairs) < 10 * len(texts)
    assert rows_of(minhash.minhash_groups(docs)) == plain_groups([x.text for x in docs.orderBy("doc_id").collect()])


def test_keys_guarantee_the_distance():
    r = np.random.default_rng(1)
    limit = minhash.most_different(85)
    a = r.integers(0, 256, (300, minhash.COMPONENTS), dtype=np.uint8)
    b = a.copy()
    for row in b:
        at = r.choice(minhash.COMPONENTS, limit, replace=False)
        row[at] ^= r.integers(1, 256, limit, dtype=np.uint8)
    assert ((minhash.chunk_keys(a, limit) == minhash.chunk_keys(b, limit)).sum(axis=1) > 0).all()
    assert sum(hi - lo for lo, hi in minhash.chunk_bounds(limit)) == minhash.COMPONENTS


def test_signature_distance_in_sql(spark):
    r = np.random.default_rng(2)
    a = r.integers(0, 256, (50, 96), dtype=np.uint8)
    b = np.where(r.random((50, 96)) < 0.3, r.integers(0, 256, (50, 96)), a).astype(np.uint8)
    df = spark.createDataFrame([(x.view("<i8").tolist(), y.view("<i8").tolist(), int((x != y).sum())) for x, y in zip(a, b)], "a array<long>, b array<long>, d int")
    assert df.where(minhash.differing("a", "b") != df["d"]).count() == 0


def test_edges_and_sql(spark):
    assert minhash.minhash_groups(documents(spark, ["x"]).limit(0)).count() == 0
    odd = spark.createDataFrame([(None, "a b c d e f g h"), (3, "a b c d e f g h"), (3, "a b c d e f g h"), (None, None)], "doc_id long, text string")
    got = sorted([(r["doc_id"], r["component_id"], r["kept"]) for r in minhash.minhash_groups(odd).collect()], key=str)
    assert got == sorted([(3, 3, True), (3, 3, True), (None, 3, False), (None, None, False)], key=str)
    sf, con = "/root/testdata/sf0.001", duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{sf}/documents.parquet')")
    assert rows_of(minhash.op12_minhash_dedup(spark, sf)) == sorted(con.execute(minhash.OP12_SQL).fetchall())
