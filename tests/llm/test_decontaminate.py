import hashlib

from pyspark.sql import functions as F

from tests.llm.helpers import documents, with_clashes, words
from trackweave.llm.decontaminate import contamination, words_of

ITEMS = [" ".join(words(9, 25)), "short ITEM here", None, "", "!!!", " ".join(words(9, 25)), "solo", "áb cd " + " ".join(words(3, 12)), "a a a a a a a a a a a a"]


def brute(texts, items, window=10):
    out = {}
    for i, t in enumerate(texts):
        ws, hit, found = words_of(t), set(), set()
        for k, item in enumerate(items):
            iw = words_of(item)
            m = min(window, len(iw))
            grams = {tuple(iw[j : j + m]) for j in range(len(iw) - m + 1)} if iw else set()
            for j in range(len(ws) - m + 1):
                if m and tuple(ws[j : j + m]) in grams:
                    hit.update(range(j, j + m))
                    found.add(str(k))
        out[i] = (len(ws), len(hit), sorted(found))
    return out


def test_matches_brute_force_in_one_pass_and_in_many(spark):
    a = words(9, 25)
    texts = [None, "", "nothing", " ".join(["x", *a[3:15], "y", *a[3:15], "z"]), " ".join(a), "a " * 40, "Short item, here; SOLO.", "solo solo", " ".join(words(7, 3000) + a[10:21]), "ÁB cd " + " ".join(words(3, 9)), "áb cd " + " ".join(words(3, 9))]
    docs = with_clashes(documents(spark, texts))
    bench = spark.createDataFrame(list(enumerate(ITEMS)), "item_id long, text string").withColumn("doc_id", F.lit(1))
    for step in (20_000, 3):
        got = {r.doc_id: (r.n_words, r.n_hit, r["items"]) for r in contamination(docs, bench, items_a_pass=step).collect()}
        assert got == brute(texts, ITEMS)


def test_empty_tables(spark):
    docs, none = documents(spark, ["a b"]), spark.createDataFrame([], "item_id long, text string")
    assert [(r.n_hit, r["items"]) for r in contamination(docs, none).collect()] == [(0, [])]
    assert contamination(docs.where("false"), none).count() == 0
    assert hashlib.sha256(b"").hexdigest().startswith("e3b0")
