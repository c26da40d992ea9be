import random

import numpy as np
from pyspark.sql import functions as F

from tests.llm.helpers import documents, with_clashes, words
from trackweave.llm import language as L
from trackweave.llm.language import declared_of, fit, host_of, identify, identify_documents, page_text, suffix_of, trigram_buckets

STEMS = {"aa": ["bana", "nabu", "tari"], "bb": ["schrk", "pfutz", "gron"], "cc": ["ellou", "aiseau", "que"]}


def text(lang, seed, n=30):
    r = random.Random(seed)
    return " ".join(r.choice(STEMS[lang]) + r.choice(STEMS[lang]) for _ in range(n))


def corpus(spark):
    langs = [list(STEMS)[i % 3] for i in range(90)]
    texts = [text(x, i) for i, x in enumerate(langs)] + [None, "", "x"]
    labels = dict(enumerate(langs + [None, "aa", "bb"]))
    return documents(spark, texts, labels, {i: f"h{i % 3}.{'xy'[i % 2]}" for i in range(93)}), labels


def test_held_out_accuracy_and_rejection(spark):
    docs, labels = corpus(spark)
    model = fit(docs.where("doc_id < 45"))
    found = {r.doc_id: r.language for r in identify(with_clashes(docs), model, F.col("text"), F.col("source")).collect()}
    assert len(found) == 93 and all(found[i].lang == labels[i] and not found[i].rejected for i in range(45, 90))
    assert found[90].rejected and found[91].rejected and found[90].lang == "und" and not any(found[i].rejected for i in range(90))


def test_every_kind_of_evidence_counts(spark):
    docs, _ = corpus(spark)
    model = fit(docs)
    unclear = "zz zz"
    rows = docs.where("lang = 'aa'").select("text", F.lit("aa.host").alias("host"), F.lit(None).cast("string").alias("said"), F.lit(False).alias("q"))
    extra = spark.createDataFrame([(unclear, "aa.host", None, True), (unclear, "new.host", "cc", True), (unclear, "new.host", "unknown", True)], rows.schema)
    found = identify(rows.union(extra), model, F.col("text"), F.col("host"), F.lit("host"), F.col("said")).where("q").select("host", "said", "language.*").collect()
    by = {(r.host, r.said): r for r in found}
    assert by["aa.host", None].lang == "aa" and by["new.host", "cc"].lang == "cc"
    assert by["new.host", "unknown"].lang == "aa"  # the suffix's counts reach a host without any


def test_buckets_do_not_cross_texts():
    both, first = trigram_buckets(["abc", None, "", "ü", "abc"])
    one, _ = trigram_buckets(["abc"])
    assert first.tolist() == [0, 3, 3, 3, 5, 8] and both[:3].tolist() == one.tolist() == both[5:].tolist()


def test_markup_and_addresses(spark):
    r = spark.createDataFrame([('<!x><html a="b" LANG="DE-at"><p>Hi<script>no()</script> you</p>', "https://u@Www.Ab.co.uk:80/x?y")], "html string, url string")
    got = r.select(declared_of(F.col("html")), host_of(F.col("url")), suffix_of(host_of(F.col("url"))), F.trim(page_text(F.col("html")))).first()
    assert tuple(got)[:3] == ("de", "www.ab.co.uk", "uk") and "no()" not in got[3]


def test_empty_table_and_no_labels(spark):
    docs, _ = corpus(spark)
    assert identify_documents(docs.where("false")).count() == 0
    assert {r.lang for r in identify_documents(docs.withColumn("lang", F.lit(None).cast("string"))).select("language.lang").collect()} == {"und"}
    assert np.isfinite(fit(docs).table).all()


def test_posterior_matches_brute_force(spark):
    """Every document's fused posterior, from the model's likelihoods and priors counted in Python."""
    langs = ["de", "en"]
    logs = np.log(np.random.default_rng(3).dirichlet(np.ones(L.BUCKETS), 2)).astype("<f4")
    model = L.Model(langs, logs)
    rows = [(i, " ".join(words(i, 3 + i % 5, 60)), f"h{i % 3}.{'ab'[i % 2]}" if i % 7 else None, ["de", "en", "xx", None][i % 4]) for i in range(40)] + [(40, None, "h1.a", "de"), (41, "", "h9.a", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, host string, said string").withColumn("evidence", F.lit("x"))
    got = {r.doc_id: r.language for r in L.identify(docs, model, F.col("text"), F.col("host"), L.suffix_of(F.col("host")), F.col("said")).collect()}

    def soft(x):
        e = np.exp(np.array(x) - max(x))
        return e / e.sum()

    own = {i: model.log_likelihoods([t])[0] for i, t, _, _ in rows}
    place = lambda h: ((h or "").rpartition(".")[2] if "." in (h or "") else "", h or "")
    by_host, by_suffix, whole = {}, {}, np.zeros(2)
    for i, _, h, _ in rows:
        if own[i][0] > 0:
            p = np.round(soft(own[i][1:]) * L.UNIT) / L.UNIT
            by_host[place(h)] = by_host.get(place(h), 0) + p
            by_suffix[place(h)[0]] = by_suffix.get(place(h)[0], 0) + p
            whole = whole + p
    base = (whole + 1) / (whole.sum() + 2)
    mix = lambda c, below: (c + 20 * below) / (c.sum() + 20)
    for i, _, h, said in rows:
        if own[i][0] == 0:
            assert got[i].rejected and got[i].lang == "und"
            continue
        prior = mix(by_host[place(h)], mix(by_suffix[place(h)[0]], base))
        evidence = np.array([0.0, 0.0]) if said not in langs else np.array([np.log(0.9 if x == said else 0.1) for x in langs])
        want = soft(own[i][1:] + evidence + np.log(prior))
        assert got[i].lang == langs[int(want.argmax())] and abs(got[i].posterior - want.max()) < 1e-9


def test_text_of_no_known_language_is_rejected(spark):
    known = [" ".join(words(k, 60, 300)) for k in range(30)]
    strange = ["".join(chr(0x4E00 + (i * j * 37) % 5000) for i in range(200)) for j in (1, 2, 3)]
    rows = [(i, t, "en") for i, t in enumerate(known)] + [(100 + i, t, None) for i, t in enumerate(strange)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumns({"source": F.lit("s"), "language": F.lit("x")})
    left = L.recognised(docs)
    assert left.columns == docs.columns and {r.doc_id for r in left.collect()} == set(range(30)) and left.first().language == "x"
