"""Small fixtures with the awkward rows every operator must take."""

import random

from pyspark.sql import functions as F

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def documents(spark, texts, langs=None, sources=None):
    rows = [(i, t, (langs or {}).get(i, "en"), (sources or {}).get(i, "src0"), None if t is None else len(t)) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, SCHEMA)


def with_clashes(df):
    """Extra columns under names that operators use inside."""
    return df.select("*", *[F.lit("x").alias(c) for c in ("fp", "key", "n", "word", "line", "pos", "score", "lang_pred", "chunk", "rep")])


def words(seed, n, vocabulary=400):
    r = random.Random(seed)
    return [f"w{r.randrange(vocabulary)}" for _ in range(n)]
