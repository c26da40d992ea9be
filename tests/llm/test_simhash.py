import random

import xxhash
from pyspark.sql import functions as F

from tests.llm.helpers import documents, with_clashes, words
from trackweave.llm.common import connected_components
from trackweave.llm.simhash import allocate, fingerprint, group_bits, links, plan, simhash_groups


def plain_fingerprint(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\x0b\x0c\r":
        low = low.replace(c, " ")
    ws = [w for w in low.split(" ") if w]
    if not ws:
        return 0
    grams = [" ".join(ws[i : i + 3]) for i in range(max(1, len(ws) - 2))]
    hs = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hs) * 2 > len(hs))


def brute(nodes, near):
    comp = {a: a for a in nodes}

    def find(a):
        while comp[a] != a:
            a = comp[a]
        return a

    for i, a in enumerate(nodes):
        for b in nodes[i + 1 :]:
            if near(a, b):
                x, y = sorted((find(a), find(b)))
                comp[y] = x
    return {a: find(a) for a in nodes}


def test_groups_match_brute_force(spark):
    base = words(1, 120)
    texts = [None, "", "   \n", "One two", "one TWO", "Éa b c d", " ".join(base), " ".join(base)]
    for k in range(60):
        own = list(base)
        for _ in range(k % 4):
            own[random.Random(k).randrange(120)] = f"x{k}"
        texts.append(" ".join(own))
    texts += [" ".join(words(k, 90)) for k in range(2, 30)]
    got = {r.doc_id: (r.fp & (2**64 - 1), r.component_id) for r in simhash_groups(with_clashes(documents(spark, texts))).collect()}
    fps = {i: plain_fingerprint(t) for i, t in enumerate(texts)}
    comp = brute(list(fps), lambda a, b: bin(fps[a] ^ fps[b]).count("1") <= 2)
    assert got == {i: (fps[i], comp[i]) for i in fps}


def test_crowded_buckets_keep_every_link(spark):
    r = random.Random(5)
    centre, fps = r.getrandbits(63), set()
    while len(fps) < 900:
        x = centre
        for b in r.sample(range(63), r.choice([1, 2, 2, 3, 4, 6])):
            x ^= 1 << b
        fps.add(x)
    fps = sorted(fps | {r.getrandbits(63) for _ in range(100)})
    reps = spark.createDataFrame(list(zip(fps, range(len(fps)))), "fp long, rep long")
    found = {x.node: x.component for x in connected_components(links(reps)).collect()}
    comp = brute(list(range(len(fps))), lambda a, b: bin(fps[a] ^ fps[b]).count("1") <= 2)
    assert {a: found.get(a, a) for a in comp} == comp


def test_a_crowd_of_near_copies_does_not_widen_the_probes(spark):
    r = random.Random(6)
    centre, fps = r.getrandbits(63), {r.getrandbits(63) for _ in range(3000)}
    while len(fps) < 4000:
        x = centre
        for b in r.sample(range(63), 3):
            x ^= 1 << b
        fps.add(x)
    chosen = plan(spark.createDataFrame([(f,) for f in fps], "fp long"), 2)
    assert [t for _, t in chosen] == [0, 0, 0]  # a row a partition; a threshold of one over 16 bits makes 17


def test_thresholds_are_the_cheapest():
    cost = [[0, 5, 9, 50], [0, 1, 2, 90], [0, 8, 9, 9]]
    spent, ts = allocate(cost, 0)
    assert sum(ts) == 0 and spent == min(cost[0][a + 1] + cost[1][b + 1] + cost[2][c + 1] for a in range(-1, 3) for b in range(-1, 3) for c in range(-1, 3) if a + b + c == 0)
    import numpy as np

    masks = group_bits(0, np.zeros((64, 64)), 3)
    assert sum(masks) == 2**64 - 1 and sorted(bin(m).count("1") for m in masks) == [21, 21, 22]


def test_long_text_and_empty_table(spark):
    assert fingerprint("a b c " * 60_000) == plain_fingerprint("a b c " * 60_000)
    assert simhash_groups(documents(spark, []).where(F.lit(False))).count() == 0
