"""Cross-tokenizer alignment against a plain version that walks the tokens."""

import hashlib
from collections import Counter

import sentencepiece
from tokenizers import Tokenizer

from tests.llm.helpers import documents, with_clashes, words
from trackweave.llm import alignment
from trackweave.llm.pieces import MODEL

A = Tokenizer.from_file(alignment.BYTE_BPE)
A.encode_special_tokens = True
B = sentencepiece.SentencePieceProcessor(model_file=MODEL)
ALPHABET = alignment.byte_alphabet()


def bytes_of_piece(i):
    piece = B.id_to_piece(i)
    return bytes([int(piece[3:5], 16)]) if B.is_byte(i) else piece.replace("▁", " ").encode()


def plain_groups(text):
    """[(A ids, B ids)] by walking both token lists until their byte counts meet."""
    if not text:
        return []
    a, b = A.encode(" " + text, add_special_tokens=False).ids, B.encode(text)
    raw_a, raw_b = [bytes(ALPHABET[c] for c in A.id_to_token(i)) for i in a], [bytes_of_piece(i) for i in b]
    whole = (" " + text).encode()
    if b"".join(raw_a) != whole or b"".join(raw_b) != whole:
        return []
    ends = lambda raw: {sum(map(len, raw[: k + 1])): k + 1 for k in range(len(raw))}
    ends_a, ends_b, out, x, y = ends(raw_a), ends(raw_b), [], 0, 0
    for end in sorted(set(ends_a) & set(ends_b)):
        out.append((a[x : ends_a[end]], b[y : ends_b[end]]))
        x, y = ends_a[end], ends_b[end]
    return out


def plain_statistics(texts):
    groups = [plain_groups(t) for t in texts]
    links = [Counter((p, q) for a, b in g for p in a for q in b) for g in groups]
    held = Counter(k for c in links for k in c)
    most = {}
    for (p, _), n in held.items():
        most[p] = max(most.get(p, 0), n)
    rows = []
    for g, c in zip(groups, links):
        digest = hashlib.sha256(";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in g).encode()).hexdigest() if g else ""
        best, total = sum(n for k, n in c.items() if held[k] == most[k[0]]), sum(n * held[k] for k, n in c.items())
        rows.append((sum(len(a) for a, _ in g), sum(len(b) for _, b in g), len(g), sum(c.values()), best, total, digest))
    return rows


TEXTS = [
    " ".join(words(1, 300)), None, "", " ", "x", "Ünïcode — naïve café 漢字かな交じり 🎉🎉 end", "two  spaces\n\nand\ttabs  ", "<|endoftext|> <s> </s> <unk> plain", "a▁b mark of its own",
    "nul\x00 byte", "aaaaaaaa" * 60, "0123456789" * 40, "antidisestablishmentarianism " * 5, " ".join(words(1, 300)), "漢" * 400, "don't we'll they're", " odd spaces​",
]


def rows_of(df):
    return sorted((r["doc_id"], tuple(r[c] for c in ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"))) for r in df.collect())


def test_statistics_equal_the_plain_version(spark):
    got = rows_of(alignment.link_statistics(with_clashes(documents(spark, TEXTS)).repartition(3)))
    assert got == list(enumerate(plain_statistics(TEXTS)))
    assert got[1][1] == (0, 0, 0, 0, 0, 0, "") and got[8][1][0] == 0  # a mark in the text comes back as a space


def test_chunks_and_wide_groups_change_nothing(spark, monkeypatch):
    monkeypatch.setattr(alignment, "CHUNK", 40)
    monkeypatch.setattr(alignment, "LINKS", 7)
    monkeypatch.setattr(alignment, "WIDE", 1)
    monkeypatch.setattr(alignment, "FEW", 3)
    monkeypatch.setattr(alignment, "KNOWN", 5)
    monkeypatch.setattr(alignment, "SHORT", 6)
    monkeypatch.setattr(alignment, "BATCH", 3)
    assert rows_of(alignment.link_statistics(documents(spark, TEXTS).repartition(2))) == list(enumerate(plain_statistics(TEXTS)))


def test_groups_are_real_outputs(spark):
    for r in alignment.align_documents(documents(spark, TEXTS)).collect():
        want = plain_groups(TEXTS[r["doc_id"]])
        assert r["in_a"] == [len(a) for a, _ in want] and r["in_b"] == [len(b) for _, b in want]
        assert r["a_ids"] == [i for a, _ in want for i in a] and r["b_ids"] == [i for _, b in want for i in b]
        assert not want or r["ends"][-1] == len(TEXTS[r["doc_id"]].encode()) + 1


def test_repeated_rows_nulls_and_empty_table(spark):
    texts = ["same text here", "same text here"]
    docs = documents(spark, texts)
    twice = docs.unionAll(docs)
    assert [r[1] for r in rows_of(alignment.link_statistics(twice))] == plain_statistics(texts * 2)
    assert alignment.link_statistics(docs.limit(0)).count() == 0
    odd = spark.createDataFrame([(None, "a text"), (None, None)], "doc_id long, text string")
    assert sorted(r["n_a"] for r in alignment.link_statistics(odd).collect()) == [0, 2]
