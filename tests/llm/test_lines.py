import random

import pytest
from pyspark.sql import functions as F

from tests.llm.helpers import documents, with_clashes
from trackweave.llm import lines as L


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(new[-1] + 1, row[j] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def edited(r, s, k):
    s = list(s)
    for _ in range(k):
        p, kind = r.randrange(len(s) + 1), r.randrange(3)
        s[p : p + (kind > 0)] = r.choice("abé ") if kind < 2 else ""
    return "".join(s)


def brute(texts, near=20, edits=2):
    occ = [(i, p, x) for i, t in enumerate(texts) if t is not None for p, x in enumerate(t.split("\n"))]
    gone = {i: [] for i, t in enumerate(texts) if t is not None}
    for k, (i, p, x) in enumerate(occ):
        if x.strip(" ") and any(y == x or (min(len(x), len(y)) >= near and abs(len(x) - len(y)) <= edits and distance(x, y) <= edits) for _, _, y in occ[:k] if y.strip(" ")):
            gone[i].append(p)
    return gone


def test_banded_distance(spark):
    r = random.Random(3)
    pairs = []
    for k in range(200):
        a = "".join(r.choice("ab") for _ in range(r.choice([0, 1, 2, 5, 17, 40, 70])))
        pairs.append((a, edited(r, a, r.randrange(5)), k))
    df = spark.createDataFrame(pairs, "a string, b string, k int")
    for most in (1, 2, 3):
        got = df.select("a", "b", L.banded_distance(F.col("a"), F.col("b"), most).alias("d"), L.near_distance(F.col("a"), F.col("b"), most).alias("t")).collect()
        assert all(x.d == x.t == min(distance(x.a, x.b), most + 1) for x in got)


def check(spark, texts, edits=2):
    docs = with_clashes(documents(spark, texts))
    got = {x.doc_id: (x.n_lines, x.removed) for x in L.line_decisions(docs, edits=edits).collect()}
    want = brute(texts, edits=edits)
    assert got == {i: (len(texts[i].split("\n")), want[i]) for i in want}
    kept = {x.doc_id: x.text for x in L.dedup_lines(docs, edits=edits).collect()}
    assert kept == {i: None if t is None else "\n".join(x for p, x in enumerate(t.split("\n")) if p not in want[i]) for i, t in enumerate(texts)}


def test_matches_brute_force(spark):
    r = random.Random(8)
    base = ["".join(r.choice("abcde é") for _ in range(n)) for n in (19, 20, 21, 40, 64, 90)]
    texts = [None, "", "\n\n", "  \n ", "short\nshirt", "the\n\nthe\nend\n"]
    texts += ["\n".join(edited(r, r.choice(base), r.randrange(4)) for _ in range(4)) for _ in range(40)]
    check(spark, texts, 1)
    check(spark, texts)
    check(spark, texts, 3)


@pytest.mark.parametrize("edits", [1, 2])
def test_crowded_segments_lose_no_link(spark, monkeypatch, edits):
    monkeypatch.setattr(L, "CROWD", 3)
    r = random.Random(4)
    base = "".join(r.choice("abcdefgh ") for _ in range(60))
    texts = [base[:30] + edited(r, base[30:], r.choice([1, 2, 3])) for _ in range(50)] + [base[:50] + c + base[51:] for c in "abcdefgh"] + [base[:50] + base[51:], base]
    texts += [edited(r, base[:3] + base[4:], 1) + "xyz"[k % 3] for k in range(9)]
    r.shuffle(texts)
    check(spark, texts, edits)


def test_rows_of_one_doc_id_keep_their_own_lines(spark):
    again, own = "a line that stands in two documents", "a line of its own that stands nowhere else"
    docs = spark.createDataFrame([(1, again), (2, again), (2, own), (2, own), (None, "x")], "doc_id long, text string")
    got = sorted((x.doc_id or 0, x.text) for x in L.dedup_lines(docs).collect())
    assert got == [(0, "x"), (1, again), (2, ""), (2, own), (2, own)]


def test_a_very_long_crowded_line_costs_its_length(spark, monkeypatch):
    monkeypatch.setattr(L, "CROWD", 3)
    r = random.Random(2)
    base = "".join(r.choice("abcdefgh ") for _ in range(3_000))
    check(spark, [base[:900] + c + base[901:2500] + c + base[2501:] for c in "stuvwxyz"] + [base], 1)


def test_empty_table(spark):
    assert L.line_decisions(documents(spark, [])).count() == 0


def test_letters_are_counted_for_lines_that_share_a_key_alone(spark, monkeypatch):
    made, keep = {}, L.table
    monkeypatch.setattr(L, "table", lambda df, name: made.setdefault(name, keep(df, name)))
    texts = [f"{k * 7919:>05d} a line like no other {'qwertzuiop'[k] * 30} {k * 104729}" for k in range(10)] + ["this line has a near copy of it", "this line has a near copy of is"]
    assert L.line_decisions(documents(spark, texts)).where("size(removed) > 0").count() == 1
    assert "letters" not in made["line-firsts"].columns and made["line-firsts"].count() == 12
    assert {r.line for r in made["line-texts"].where("letters is not null").collect()} == set(texts[10:])
