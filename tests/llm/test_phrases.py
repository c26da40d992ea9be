"""Phrase collocations against a plain count of all phrases."""

import gc
import random
import re
from collections import Counter
from pathlib import Path

import duckdb
import pyarrow.parquet as pq
import pytest

from tests.llm.helpers import SCHEMA, documents, with_clashes, words
from trackweave.llm import phrases

COLUMNS = ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]


def plain(rows, top=2000, least=30):
    f, total = Counter(), Counter()
    for lang, text in rows:
        lang = lang or "und"
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", low):
            w = [x for x in re.split("[ \t]+", piece) if x]
            total[lang] += len(w)
            f.update((lang, *w[i : i + m]) for m in range(1, 5) for i in range(len(w) - m + 1))
    cand = {p: n for p, n in f.items() if n >= least and len(p) > 2}
    gone = {(p[0], *p[i:j]) for p in cand for i in range(1, len(p)) for j in range(i + 2, len(p) + 1) if j - i < len(p) - 1 and 100 * cand[p] >= 80 * f[(p[0], *p[i:j])]}
    out = []
    for p, a in cand.items():
        if p in gone:
            continue
        score, _, left, right = min((2_000_000 * a // (f[p[:k]] + f[(p[0], *p[k:])]), k, f[p[:k]], f[(p[0], *p[k:])]) for k in range(2, len(p)))
        out.append((p[0], " ".join(p[1:]), a, left, right, score))
    out.sort(key=lambda r: (r[0], -r[5], -r[2], r[1].encode()))
    rank, rows = Counter(), []
    for lang, phrase, a, left, right, score in out:
        rank[lang] += 1
        if rank[lang] <= top:
            rows.append((lang, rank[lang], phrase, a, left, right, total[lang], score))
    return rows


def some_texts(n, seed):
    r = random.Random(seed)
    stock = ["New York City hall", "as well as", "in order to be", "é \U0001f389 ￿", "a b a b a b a"]
    made = []
    for _ in range(n):
        parts = [r.choice(stock) if r.random() < 0.5 else f"w{int(r.paretovariate(0.6)) % 9}" for _ in range(r.randrange(1, 60))]
        made.append("".join(p + r.choice([" ", " ", " ", "  ", "\t", ". ", ",", "!\n", "\r\n"]) for p in parts))
    return made


@pytest.mark.parametrize("chunk", [1 << 20, 50])
def test_equals_the_plain_count(spark, monkeypatch, chunk):
    monkeypatch.setattr(phrases, "CHUNK", chunk)
    rows = [(random.Random(i).choice(["en", "fr", None, "und"]), t) for i, t in enumerate(some_texts(400, 5))] + [("en", None), ("en", ""), (None, " . , "), ("de", "x")]
    df = with_clashes(spark.createDataFrame([(i, t, lang, "s", 0) for i, (lang, t) in enumerate(rows)], SCHEMA)).drop("n").repartition(3)
    got = sorted((tuple(r[c] for c in COLUMNS) for r in phrases.collocations(df, top=50).collect()), key=lambda r: (r[0], r[1]))
    want = plain(rows, top=50)
    assert got == want and len(want) > 50


def test_repetition_overlaps_and_pieces(spark):
    texts = ["Go go go go. go go"] * 10 + ["x.y"] * 40
    got = {r["phrase"]: (r["a"], r["l"], r["r"], r["score"]) for r in phrases.collocations(documents(spark, texts)).collect()}
    assert got == {"go go": (40, 60, 60, 666666)}  # three words occur 20 times only
    assert {r["n"] for r in phrases.collocations(documents(spark, texts)).collect()} == {140}


def test_scores_beyond_64_bits(spark):
    row = [(["x", "y"], 9_000_000_000_000_000, [9_000_000_000_000_001, 9_000_000_000_000_000], [9_000_000_000_000_003, 9_000_000_000_000_000])]
    c = spark.createDataFrame(row, "words array<string>, a long, begins array<long>, ends array<long>").select(phrases.lowest_cut().alias("c")).first()["c"]
    assert c["score"] == 2_000_000 * 9_000_000_000_000_000 // 18_000_000_000_000_004


def test_empty_table_and_sql(spark):
    assert phrases.collocations(documents(spark, ["x"]).limit(0)).count() == 0
    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{sf}/documents.parquet')")
    want = con.execute(phrases.OP11_SQL).fetchall()
    got = [tuple(r[c] for c in COLUMNS) for r in phrases.op11_phrase_collocations(spark, sf).collect()]
    assert sorted(got) == sorted(want) and len(got) >= 50


def test_shuffle_files_go_with_their_query(spark):
    """Those of all levels would else lie on the disk until the driver collects garbage."""

    def held():
        files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
        return {name for k in range(files.size()) if (name := files.apply(k).getName()).startswith("shuffle_") and name.endswith(".data")}

    before = held()
    phrases.frequent_phrases(documents(spark, ["a b c d e"] * 40))
    assert not held() - before


def test_no_level_is_stored_place_by_place(spark, monkeypatch):
    """The disk's worst was a table of all pairs of a level, with two ids of 64 bits each."""
    texts = [" ".join(words(i, 1000, 3000)) for i in range(200)]
    plain_stored, sizes = phrases.stored, {}

    def stored(df, name):
        found = plain_stored(df, name)
        sizes[name] = sum(f.stat().st_size for f in Path(found[1].removeprefix("file:")).glob("*.parquet"))
        return found

    monkeypatch.setattr(phrases, "stored", stored)
    phrases.frequent_phrases(documents(spark, texts))
    assert "phrases-words" in sizes and max(sizes.values()) < 0.75 * sum(map(len, texts)), sizes


@pytest.mark.parametrize("bits", [1 << 25, 1 << 7])
def test_longer_phrases_whatever_the_bit_map_lets_through(spark, monkeypatch, bits):
    monkeypatch.setattr(phrases, "BITS", bits)
    texts = [t.replace(".", " ").lower() for t in some_texts(150, 8)]
    f = Counter()
    for t in texts:
        for piece in re.split("[,;:!?\n\x0b\x0c\r]", t):
            w = re.split("[ \t]+", piece.strip(" \t")) if piece.strip(" \t") else []
            f.update(tuple(w[i : i + m]) for m in range(1, 7) for i in range(len(w) - m + 1))
    _, levels = phrases.frequent_phrases(documents(spark, texts), most_words=6, least=5)
    got = {tuple(r["words"]): (r["a"], r["begins"], r["ends"]) for level in levels for r in level.collect()}
    want = {p: (n, [f[p[:k]] for k in range(1, len(p) + 1)], [f[p[-k:]] for k in range(1, len(p) + 1)]) for p, n in f.items() if n >= 5}
    assert got == want and max(map(len, want)) == 6


def test_no_row_holds_a_chunk(spark, monkeypatch):
    """Readers take thousands of rows at once: with a chunk a row, all chunks of a file lay in memory together."""
    plain_stored, sizes = phrases.stored, {}

    def stored(df, name):
        found = plain_stored(df, name)
        files = [pq.read_table(f) for f in Path(found[1].removeprefix("file:")).glob("*.parquet")]
        sizes[name] = max(t.slice(i, 1).nbytes for t in files for i in range(0, t.num_rows, 7))
        return found

    monkeypatch.setattr(phrases, "stored", stored)
    phrases.frequent_phrases(documents(spark, [" ".join(words(i, 3000, 3000)) for i in range(60)]))
    assert {"phrases-words", "phrases-found", "phrases-runs"} <= set(sizes) and max(sizes.values()) < 16_000, sizes


def test_a_chunks_dictionary_goes_with_it():
    """A cycle stays until Python looks for cycles, which words and numbers do not make it do: workers kept every chunk's words."""
    gc.collect()
    slots = phrases._dictionary()
    assert [slots[w] for w in (b"a", b"\n", b"b", b"a")] == [1, 0, 2, 1]
    del slots
    assert gc.collect() == 0


@pytest.mark.parametrize("row", [1, 2, 5])
def test_phrases_over_the_ends_of_rows(spark, monkeypatch, row):
    monkeypatch.setattr(phrases, "ROW", row)
    monkeypatch.setattr(phrases, "CHUNK", 300)
    rows = [("en", t) for t in some_texts(120, 3)]
    df = spark.createDataFrame([(i, t, lang, "s", 0) for i, (lang, t) in enumerate(rows)], SCHEMA).repartition(2)
    got = sorted((tuple(r[c] for c in COLUMNS) for r in phrases.collocations(df).collect()), key=lambda r: (r[0], r[1]))
    assert got == plain(rows) and len(got) > 10
