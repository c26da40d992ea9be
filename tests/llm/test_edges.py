"""Nulls in any column, repeated rows, and texts of every size through every operator that reads documents."""

import pytest
from pyspark.sql import functions as F

from tests.llm.helpers import SCHEMA, with_clashes, words
from trackweave.llm import alignment, decontaminate, language, lines, lm, minhash, phrases, pieces, pii, queries, simhash, substrings


@pytest.fixture(scope="module")
def docs(spark):
    text = " ".join(words(1, 60))
    rows = [(0, text, "en", "s", 5), (1, text, None, None, None), (None, text, "en", "s", 5), (None, None, None, None, None), (2, None, "en", "s", 0), (3, "", "fr", "", 0), (4, "x", "fr", "s", 1), (4, "x", "fr", "s", 1), (5, "long " * 30_000, "fr", "s", 150_000)]
    return with_clashes(spark.createDataFrame(rows, SCHEMA)).cache()


def test_every_row_comes_back(spark, docs):
    bench = spark.createDataFrame([(None, "x"), (1, None), (2, "x")], "item_id long, text string")
    held = F.crc32(F.col("doc_id").cast("string")) % 7 == 2
    assert simhash.simhash_groups(docs).count() == 9 and simhash.near_duplicate_groups(docs).count() == 9
    assert decontaminate.contamination(docs, bench).where("n_hit > 0").count() == 2 and decontaminate.drop_contaminated(docs, bench).count() == 7
    assert language.identify_documents(docs).count() == 9
    assert pieces.encode_documents(docs).where("lossless").count() == 9 and pieces.count_tokens(docs).count() == 9
    assert pii.find_personal_data(docs, pii.fit(docs)).count() == 9
    assert lm.score_documents(docs, held).count() == 9
    assert substrings.remove_repeats(docs).count() == 7
    assert phrases.collocations(docs).where("phrase = 'long long long long'").count() == 1
    assert minhash.minhash_groups(docs).count() == 9 and alignment.link_statistics(docs).count() == 9
    assert lines.dedup_lines(docs).count() == 9 and lines.dedup_lines(docs).columns == docs.columns


def test_registered_queries_have_the_contract_columns():
    assert [k for k in queries.QUERIES if k.startswith("op")] == [f"op{n}_{x}" for n, x in zip(range(1, 14), ("simhash_dedup", "decontaminate", "substring_dedup", "language_id", "pii", "ann", "sentencepiece", "line_dedup", "token_counts", "lm_scores", "phrase_collocations", "minhash_dedup", "cross_tokenizer"))]
    assert set(queries.ORACLE_SQL) <= set(queries.QUERIES)
