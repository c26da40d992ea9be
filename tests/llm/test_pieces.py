import numpy as np
import pytest
import sentencepiece
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer, decoders, models

from tests.llm.helpers import documents, with_clashes, words
from trackweave.llm import pieces
from trackweave.llm.pieces import DRAW, M64, MARK, PIECE, PLACE, MergeEncoder, ViterbiCounter, Vocabulary, count_tokens, decode_documents, encode_documents, mixed, model_bytes, op7_sentencepiece

TEXTS = [None, "", " ", "  two  spaces \n\nlines\tand tabs ", "Ünïcode 中文 and \U0001f600 ①", f"own {MARK}mark{MARK} \ufdd0 \ufffe", "<s> <0x0A> </s>", "a" * 500, " ".join(words(1, 2000)), "the the the", "the the the"]
TEXT = st.text(alphabet=st.sampled_from(list("abetho .,\n\t ▁é中①<0x>s\ufdd0")), max_size=60)


@pytest.fixture(scope="module")
def vocabulary():
    return Vocabulary(model_bytes())


@pytest.fixture(scope="module")
def processor():
    return sentencepiece.SentencePieceProcessor(model_proto=model_bytes())


@pytest.fixture(scope="module")
def unigram(vocabulary):
    pieces = [("<unk>", -2e9)] + [(f"<0x{b:02X}>", -2e9) for b in range(256)] + list(vocabulary.score.items())
    t = Tokenizer(models.Unigram(pieces, unk_id=0, byte_fallback=True))
    t.decoder = decoders.ByteFallback()
    return t


@settings(max_examples=150, deadline=None)
@given(TEXT)
def test_plain_merges_are_the_models(vocabulary, processor, text):
    assert MergeEncoder(vocabulary, 0.0, 1).encode(text.replace(MARK, "")).tolist() == processor.encode(text.replace(MARK, ""))


@settings(max_examples=150, deadline=None)
@given(TEXT, st.integers(0, 5), st.floats(0, 1))
def test_dropout_is_lossless(vocabulary, text, seed, p):
    encoder = MergeEncoder(vocabulary, p, seed)
    assert vocabulary.decode(encoder.encode(text).tolist()) == text


def test_seeds_vary_and_repeat(vocabulary):
    text = " ".join(words(4, 300)) + " understanding international communication"
    one, again, other = (MergeEncoder(vocabulary, 0.2, s).encode(text).tolist() for s in (1, 1, 2))
    assert one == again != other and len(one) > len(MergeEncoder(vocabulary, 0.0, 1).encode(text))


def slow_units(vocabulary, text, name, dropout, seed):
    """The segmentation by its definition: at each turn the best live pair of neighbours is skipped or merged."""
    units = list(vocabulary.units(text))
    order = {p: k for k, p in enumerate(sorted(vocabulary.score, key=vocabulary.score.get, reverse=True))}
    keys = mixed(xxhash.xxh64_intdigest(name.encode(), seed), len(units)).tolist()
    out = []
    for key, unit in zip(keys, units):
        parts, skipped = list(enumerate(unit)), set()
        while True:
            pairs = [(order[x + y], i, x + y, k) for k, ((i, x), (j, y)) in enumerate(zip(parts, parts[1:])) if x + y in vocabulary.score and (i, x, y) not in skipped]
            if not pairs:
                break
            n, i, piece, k = min(pairs)
            if (key ^ (i * PLACE ^ n * PIECE) & M64) * DRAW % 2**64 < int(dropout * 2**64):
                skipped.add((i, parts[k][1], parts[k + 1][1]))
            else:
                parts[k : k + 2] = [(i, piece)]
        for _, p in parts:
            out += [vocabulary.ids[p]] if p in vocabulary.ids else vocabulary.fallback(p)
    return out


@pytest.mark.parametrize("p", [0.0, 0.1, 0.5, 0.9])
def test_dropout_matches_brute_force(vocabulary, p):
    text = " ".join(words(4, 60) + ["understanding", "communication"] * 20) + " Ünïcode 中文 " + "internationalcommunication" * 4
    encoder = MergeEncoder(vocabulary, p, 7)
    for name in ("1", "2", "1"):
        assert encoder.encode(text, name).tolist() == slow_units(vocabulary, text, name, p, 7)


def test_every_occurrence_draws_its_own_dropout(spark, vocabulary, tmp_path):
    encoder = MergeEncoder(vocabulary, 0.2, 1)
    text = " ".join(["communication"] * 400)
    assert encoder.encode(text, "7").tolist() == encoder.encode(text, "7").tolist() != encoder.encode(text, "8").tolist()
    assert len({encoder.encode("communication", str(k)).tobytes() for k in range(2000)}) > 10
    codes = encoder.merge_all([MARK + "communication"]).codes.tolist()
    clear = sum(all((key ^ c) * DRAW % 2**64 >= encoder.below for c in codes) for key in mixed(5, 20_000).tolist()) / 20_000
    assert abs(clear - 0.8 ** len(codes)) < 0.01
    documents(spark, [text, text]).write.parquet(f"{tmp_path}/documents.parquet")
    assert len({r.ids_sha256 for r in op7_sentencepiece(spark, str(tmp_path)).collect()}) == 2


def test_little_memory_changes_nothing(vocabulary, monkeypatch):
    text = " ".join(words(5, 500))
    want = MergeEncoder(vocabulary, 0.3, 1).encode(text, "1").tolist(), ViterbiCounter(vocabulary).count(text)
    monkeypatch.setattr(pieces, "KEPT_BYTES", 0)
    monkeypatch.setattr(pieces, "UNITS", 37)
    monkeypatch.setattr(pieces, "ROWS", 5)
    encoder, counter = MergeEncoder(vocabulary, 0.3, 1), ViterbiCounter(vocabulary)
    assert all((encoder.encode(text, "1").tolist(), counter.count(text)) == want for _ in range(3))


def test_scores_of_a_unigram_model_are_added_as_they_are():
    class Tiny(Vocabulary):
        def __init__(self):
            self.score = {"▁a": -0.25, "b": -1.3, "ab": -1.1}
            self.byte_ids, self.ids = [0] * 256, {}

    assert ViterbiCounter(Tiny()).count("ab a") == (3, -0.25 - 1.3 - 0.25)


@settings(max_examples=150, deadline=None)
@given(TEXT)
def test_counts_are_the_unigram_tokenizers(vocabulary, unigram, text):
    text = text.replace(MARK, "")
    marked = MARK + text.replace(" ", MARK) if text else ""
    assert ViterbiCounter(vocabulary).count(text)[0] == len(unigram.encode(marked).ids)


def test_ties_take_the_longest_last_piece():
    class Tiny:
        score = {"a": -1.0, "b": -1.0, "c": -1.0, "ab": -2.0, "bc": -2.0, "abc": -4.0}

    assert ViterbiCounter(Tiny()).best("abc") == (-3.0, 2)


def test_tables(spark, vocabulary):
    docs = with_clashes(documents(spark, TEXTS))
    encoded = encode_documents(docs)
    rows = {r.doc_id: r for r in decode_documents(encoded).collect()}
    assert all(r.lossless and r.text == (TEXTS[i] or "") and r.n_tokens == len(r.token_ids) for i, r in rows.items()) and len(rows) == len(TEXTS)
    own = {r.doc_id: r for r in encode_documents(docs, dropout=0.5).collect()}
    assert own[9].token_ids != own[10].token_ids and all(r.lossless for r in own.values())
    counter = ViterbiCounter(vocabulary)
    assert {r.doc_id: (r.n_tokens, r.path_score) for r in count_tokens(docs).collect()} == {i: counter.count(t) for i, t in enumerate(TEXTS)}
    assert encode_documents(docs.where("false")).count() == count_tokens(docs.where("false")).count() == 0
    assert np.isfinite(counter.count("x" * 3000)[1])
