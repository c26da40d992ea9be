import random

import corpus_pipeline
from pyspark.sql import functions as F

from tests.llm.helpers import SCHEMA, documents, words
from tests.llm.test_decontaminate import brute as contaminated
from tests.llm.test_lines import brute as repeated_lines
from trackweave.llm import simhash
from trackweave.llm.language import identify_documents
from trackweave.llm.simhash import near_duplicate_groups, shingle_hashes, wide_fingerprint


def jaccard(a, b, k=5):
    x, y = ({tuple(t.split()[i : i + k]) for i in range(max(1, len(t.split()) - k + 1))} for t in (a, b))
    return len(x & y) / len(x | y)


def edited(base, seed, n):
    out, r = list(base), random.Random(seed)
    for k in range(n):
        out[r.randrange(len(out))] = f"edit{seed}x{k}"
    return " ".join(out)


def test_near_copies_group_and_others_do_not(spark, monkeypatch):
    monkeypatch.setattr(simhash, "BUCKET", 5)
    monkeypatch.setattr(simhash, "TILE", 8)
    base = words(1, 300)
    texts = [" ".join(base)] + [edited(base, k, 1 + k % 4) for k in range(40)] + [" ".join(words(k, 250, 5000)) for k in range(50, 90)] + [None, "", "tiny text", "tiny text"]
    texts += [edited(words(99, 300), k, 60) for k in range(3)]
    got = {r.doc_id: r.component_id for r in near_duplicate_groups(documents(spark, texts)).collect()}
    assert all(jaccard(texts[0], t) > 0.8 for t in texts[1:41]) and {got[i] for i in range(41)} == {0}
    assert all(got[i] == i for i in range(41, 81)) and got[81] == got[82] == 81 and got[83] == got[84] == 83
    assert len({got[i] for i in range(85, 88)}) == 3 and len(got) == len(texts)
    assert near_duplicate_groups(documents(spark, [])).count() == 0
    assert wide_fingerprint(shingle_hashes("a b c d e f", 5)).tolist() != wide_fingerprint(shingle_hashes("a b c d e g", 5)).tolist()


def test_every_pair_at_the_threshold_links_and_none_below(spark, monkeypatch):
    monkeypatch.setattr(simhash, "BUCKET", 6)
    monkeypatch.setattr(simhash, "TILE", 8)
    texts = []
    for k in range(60):  # pairs from 0.75 to 0.88 by one edited run
        base, r = words(k, 200, 5000), random.Random(k)
        n = r.randrange(9, 25)
        at = r.randrange(5, 190 - n)
        texts += [" ".join(base), " ".join(base[:at] + [f"new{k}x{j}" for j in range(n)] + base[at + n :])]
    base = words(900, 200, 5000)
    texts += [" ".join(base[j : j + 120]) for j in range(0, 80, 2)]  # a chain: each is near the next ones alone
    texts += [" ".join(base[:100] + words(k, 9, 5000)) for k in range(901, 921)]
    comp = list(range(len(texts)))
    near = [(i, j) for i in range(len(texts)) for j in range(i) if jaccard(texts[i], texts[j]) >= 0.8]
    for _ in texts:
        for i, j in near:
            comp[i] = comp[j] = min(comp[i], comp[j])
    pairs = [jaccard(texts[i], texts[i + 1]) for i in range(0, 120, 2)]
    assert sum(0.8 <= p <= 0.85 for p in pairs) > 15 and sum(0.75 <= p < 0.8 for p in pairs) > 5
    assert {r.doc_id: r.component_id for r in near_duplicate_groups(documents(spark, texts)).collect()} == dict(enumerate(comp))


def test_candidates_come_by_the_pigeonhole_principle_first(spark, monkeypatch):
    made, keep = {}, simhash.table
    monkeypatch.setattr(simhash, "table", lambda df, name: made.setdefault(name, keep(df, name)))
    base = words(7, 400)
    texts = [" ".join(base)] + [" ".join(base[:-1] + [f"end{k}"]) for k in range(6)] + [edited(words(8, 200), k, 2 * k) for k in range(2)] + [" ".join(words(k, 90)) for k in range(20, 30)]
    assert jaccard(texts[7], texts[8]) > 0.8
    found = {r.doc_id: r.component_id for r in near_duplicate_groups(documents(spark, texts)).collect()}
    assert found == {i: 0 if i < 7 else min(i, 7) if i < 9 else i for i in range(len(texts))}
    fps = {r.node: r.fp for r in made["near-firsts"].collect()}
    holes = [(r.a, r.b) for r in made["pigeonhole-pairs"].collect()]
    assert len(holes) >= 6 and all(bin((fps[a] ^ fps[b]) & (2**64 - 1)).count("1") <= 2 for a, b in holes)
    linked = {r.node: r.component for r in made["pigeonhole-components"].collect()}  # the prefix filter is left with what that did not link
    assert len(linked) >= 7 and all(linked.get(r.a, r.a) != linked.get(r.b, r.b) for r in made["near-first"].collect())


def test_stages_match_brute_force(spark, tmp_path):
    bench = [" ".join(words(500, 20)), "short item"]
    texts = [" ".join(words(k, 60, 3000)) for k in range(30)]
    texts += [texts[0] + "\n" + texts[1], edited(texts[2].split(), 1, 1), "x y " + " ".join(words(500, 20)[3:15]) + " z", None, "", "123 456", texts[5] + "\nown line that is long enough", texts[6][:-1] + "q"]
    docs = documents(spark, texts)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(list(enumerate(bench)), "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["language_id", "line_dedup", "simhash_near_dedup", "decontaminate", "sentencepiece"]
    kept = stages["language_id"](spark, docs, str(tmp_path))
    rejected = {r.doc_id for r in identify_documents(docs).where("language.rejected").collect()}
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == set(range(len(texts))) - rejected and rejected == {33, 34}
    own = [None if i in rejected else t for i, t in enumerate(texts)]
    gone = repeated_lines(own)
    lines = {i: "\n".join(x for p, x in enumerate(t.split("\n")) if p not in gone[i]) for i, t in enumerate(own) if t is not None}
    after = stages["line_dedup"](spark, kept, str(tmp_path))
    assert {r.doc_id: r.text for r in after.collect()} == lines and after.columns == docs.columns
    unique = stages["simhash_near_dedup"](spark, after, str(tmp_path))
    left = {r.doc_id for r in unique.collect()}
    empty = [i for i, t in lines.items() if not t]
    assert left == set(lines) - set(empty[1:]) - {31} and unique.columns == docs.columns
    clean = stages["decontaminate"](spark, unique, str(tmp_path))
    leaked = {i for i, (_, hit, _) in contaminated([lines.get(i) for i in range(len(texts))], bench).items() if hit}
    assert {r.doc_id for r in clean.collect()} == left - leaked and 32 in leaked and clean.columns == docs.columns
    final = {r.doc_id: r for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert final.keys() == left - leaked and all(r.lossless for r in final.values())


def test_empty_documents(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).where(F.lit(True)).count() == 0
