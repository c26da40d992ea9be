"""Language identification by fusing evidence in log space.

Text likelihood: hashed byte trigrams under a multinomial model fitted on a bounded sample of
labelled rows. Declared markup language: right with probability ``reliability``. Address: a prior
per host, smoothed towards its address suffix, which is smoothed towards the whole table; the counts
are the text's own posteriors, summed over all rows by grouped aggregation.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import columns_of, read, short_batches, table, unused

BUCKETS = 1 << 16
#: Neighbouring trigrams overlap, so each counts a third; beyond this many effective ones a text says no more.
OVERLAP, MOST_GRAMS = 1 / 3, 300.0
#: Share of a language's probability that all buckets have alike, seen or not; trigrams from which a text is held against chance, and by how much
#: a trigram chance must be the better explanation (a text of unseen trigrams alone is 3 behind), so that numbers and keys in a text do not reject it.
ALIKE, JUDGED, MARGIN = 0.05, 24, 1.0
#: A soft count is summed as an integer of this unit, so sums do not depend on their order.
UNIT = 1_000_000


def trigram_buckets(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Bucket of every byte trigram of all texts, and the first index of each text's own (its length at the end)."""
    raws = [f" {t.lower()} ".encode("utf-8", "surrogatepass") if t else b"" for t in texts]
    sizes = np.array([max(0, len(r) - 2) for r in raws])
    joined = np.frombuffer(b"".join(raws) + b"\0\0", dtype=np.uint8).astype(np.uint32)
    code = joined[:-2] * np.uint32(0x9E3779B1) ^ joined[1:-1] * np.uint32(0x85EBCA77) ^ joined[2:] * np.uint32(0xC2B2AE3D)
    code = ((code ^ (code >> np.uint32(15))) * np.uint32(0x2C1B3C6D)) >> np.uint32(16)
    ends = np.cumsum([len(r) for r in raws])
    keep = np.ones(len(code), dtype=bool)
    for e, r in zip(ends, raws):  # trigrams across two texts
        keep[max(0, e - min(2, len(r))) : e] = False
    return code[keep[: len(code)]], np.concatenate(([0], np.cumsum(sizes)))


@dataclass
class Model:
    langs: list[str]
    table: np.ndarray  # float32 (languages, BUCKETS): log probability of a bucket

    def log_likelihoods(self, texts: list[str | None]) -> np.ndarray:
        """(texts, 1 + languages): number of trigrams, then the tempered log likelihood of each language."""
        out = np.zeros((len(texts), 1 + len(self.langs)))
        at = 0
        while at < len(texts):  # about 4 MB of text at a time
            upto, size = at, 0
            while upto < len(texts) and (upto == at or size < 4_000_000):
                size += len(texts[upto] or "")
                upto += 1
            codes, first = trigram_buckets(texts[at:upto])
            n = np.diff(first)
            out[at:upto, 0] = n
            some = n > 0
            if some.any():
                weight = np.minimum(n[some] * OVERLAP, MOST_GRAMS) / n[some]
                for k, own in enumerate(self.table):
                    out[np.flatnonzero(some) + at, 1 + k] = np.add.reduceat(own[codes], first[:-1][some], dtype=np.float64) * weight
            at = upto
        return out


def fit(labelled: DataFrame, text_col: str = "text", label_col: str = "lang", id_col: str = "doc_id", rows_a_language: int = 400) -> Model:
    """Fit on at most ``rows_a_language`` labelled rows of every language, the first in hash order; rows without label or text do not count.

    A bucket without a trigram of a language has the same probability in all of them, however large their samples.
    With no labelled row at all the model knows one language, 'und'.
    """
    rows = columns_of(labelled, id_col, text_col, label_col).toDF("id", "text", "label").where("label is not null and length(text) > 2")
    counts = rows.groupBy("label").count().collect()
    if not counts:
        return Model(["und"], np.full((1, BUCKETS), -np.log(BUCKETS), dtype=np.float32))
    share = F.element_at(F.create_map(*[F.lit(x) for r in counts for x in (r["label"], min(1.0, 3.0 * rows_a_language / r["count"]))]), F.col("label"))
    drawn = rows.where((F.pmod(F.xxhash64("id"), F.lit(1 << 30)) / float(1 << 30)) < share)
    drawn = drawn.withColumn("at", F.row_number().over(Window.partitionBy("label").orderBy(F.xxhash64("id"), "id"))).where(F.col("at") <= rows_a_language)

    def count(key, frame: pd.DataFrame) -> pd.DataFrame:
        seen = np.bincount(trigram_buckets(frame["text"].tolist())[0], minlength=BUCKETS).astype(np.float64)
        share = (1 - ALIKE) * seen / max(1.0, seen.sum()) + ALIKE / BUCKETS
        return pd.DataFrame({"label": [key[0]], "logs": [np.log(share).astype("<f4").tobytes()]})

    found = sorted((r["label"], r["logs"]) for r in drawn.groupBy("label").applyInPandas(count, "label string, logs binary").collect())
    if not found:
        return Model(["und"], np.full((1, BUCKETS), -np.log(BUCKETS), dtype=np.float32))
    return Model([k for k, _ in found], np.stack([np.frombuffer(v, dtype="<f4") for _, v in found]))


def _softmax(logs: F.Column) -> F.Column:
    top = F.array_max(logs)
    exps = F.transform(logs, lambda x: F.exp(x - top))
    return F.transform(exps, lambda x: x / F.aggregate(exps, F.lit(0.0), lambda s, y: s + y))


def identify(docs: DataFrame, model: Model, text: F.Column, host: F.Column, suffix: F.Column | None = None, declared: F.Column | None = None, reliability: float = 0.9, smoothing: float = 20.0, least_posterior: float = 0.5, into: str = "language") -> DataFrame:
    """``docs`` with a struct ``into``: (lang, posterior, text_lang, n_grams, rejected).

    Rejected: no trigram to judge (null or empty text), no language that reaches ``least_posterior``, or a text of ``JUDGED`` trigrams or more
    that chance (all buckets alike) explains better than any language by ``MARGIN`` a trigram: it is of none that the model knows.
    A null host or suffix is its own group; a declared language that the model does not know, or none,
    is no evidence; of equal posteriors the first language in alphabetical order wins. All rows and
    columns are kept. Texts are read twice and not shuffled; only the counts per host are, and they
    join back broadcast where Spark finds their table small enough, and sorted otherwise.
    """
    spark = docs.sparkSession
    short_batches(spark)
    shared = spark.sparkContext.broadcast(model)
    langs, n = model.langs, len(model.langs)
    kept = [c for c in docs.columns if c != into]
    ev, post, by = (unused(docs, c) for c in ("evidence", "posterior_of", "prior_of"))

    @F.pandas_udf("array<double>")
    def scores(texts: pd.Series) -> pd.Series:
        return pd.Series(list(shared.value.log_likelihoods(texts.tolist())))

    named = docs.select("*", F.struct(scores(text.cast("string")).alias("scores"), F.coalesce(host.cast("string"), F.lit("")).alias("host"), F.coalesce((suffix if suffix is not None else F.lit("")).cast("string"), F.lit("")).alias("suffix"), (F.lower(declared.cast("string")) if declared is not None else F.lit(None).cast("string")).alias("declared")).alias(ev))
    own = F.slice(f"{ev}.scores", 2, n)
    soft = _softmax(own)
    counted = named.where(F.col(f"{ev}.scores")[0] > 0).select(F.col(f"{ev}.host").alias("host"), F.col(f"{ev}.suffix").alias("suffix"), soft.alias("p"))
    sums = [F.sum(F.round(F.get("p", k) * UNIT).cast("long")).alias(f"c{k}") for k in range(n)]
    by_host = table(counted.groupBy("suffix", "host").agg(*sums), "language-hosts")
    cols = [f"c{k}" for k in range(n)]
    total = by_host.agg(*[F.sum(c).cast("double") for c in cols]).first()
    whole = [((x or 0.0) / UNIT + 1) / (sum(y or 0.0 for y in total) / UNIT + n) for x in total]

    def smoothed(counts: list[str], below: list) -> list:
        size = reduce(lambda a, b: a + b, [F.col(c) for c in counts]) / float(UNIT)
        return [(F.col(c) / float(UNIT) + smoothing * b) / (size + smoothing) for c, b in zip(counts, below)]

    by_suffix = by_host.groupBy("suffix").agg(*[F.sum(c).alias(f"s{k}") for k, c in enumerate(cols)]).select("suffix", F.array(*smoothed([f"s{k}" for k in range(n)], [F.lit(x) for x in whole])).alias("below"))
    priors = by_host.join(by_suffix, "suffix").select(F.struct("suffix", "host", F.array(*smoothed(cols, [F.get("below", k) for k in range(n)])).alias("p")).alias("prior"))
    priors = table(priors, "language-priors").withColumnRenamed("prior", by)
    off = float(np.log((1 - reliability) / max(1, n - 1))) if n > 1 else 0.0
    say = F.array(*[F.when(F.col(f"{ev}.declared").isin(langs), F.when(F.col(f"{ev}.declared") == x, float(np.log(reliability))).otherwise(off)).otherwise(0.0) for x in langs])
    prior = F.coalesce(f"{by}.p", F.array(*[F.lit(x) for x in whole]))
    fused = F.zip_with(F.zip_with(own, say, lambda a, b: a + b), prior, lambda a, b: a + F.ln(b))
    joined = named.join(priors, (F.col(f"{ev}.host") == F.col(f"{by}.host")) & (F.col(f"{ev}.suffix") == F.col(f"{by}.suffix")), "left").withColumn(post, _softmax(fused))
    pick = lambda p: F.element_at(F.array(*[F.lit(x) for x in langs]), F.array_position(p, F.array_max(p)).cast("int"))
    grams = F.col(f"{ev}.scores")[0]
    some, chance = grams > 0, -F.least(grams * OVERLAP, F.lit(MOST_GRAMS)) * float(np.log(BUCKETS) + MARGIN)
    unlike = (grams >= JUDGED) & (F.array_max(own) < chance) & F.lit(model.langs != ["und"])
    language = F.struct(
        F.when(some, pick(F.col(post))).otherwise("und").alias("lang"), F.when(some, F.array_max(post)).otherwise(0.0).alias("posterior"), F.when(some, pick(own)).otherwise("und").alias("text_lang"),
        grams.cast("long").alias("n_grams"), (~some | (F.array_max(post) < least_posterior) | unlike).alias("rejected"),
    )
    return joined.select(*[F.col(f"`{c}`") for c in kept], language.alias(into))


def host_of(url: F.Column) -> F.Column:
    return F.nullif(F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/@]*@)?([^/:?#]+)", 1)), F.lit(""))


def suffix_of(host: F.Column) -> F.Column:
    return F.nullif(F.regexp_extract(host, r"\.([^.]+)$", 1), F.lit(""))


def declared_of(html: F.Column) -> F.Column:
    """Primary subtag of the html element's lang attribute."""
    return F.nullif(F.lower(F.regexp_extract(html, r"""(?i)<html[^>]*\slang\s*=\s*["']?([A-Za-z]+)""", 1)), F.lit(""))


def page_text(html: F.Column) -> F.Column:
    return F.regexp_replace(F.regexp_replace(html, r"(?is)<(script|style)[^>]*>.*?</\1>", " "), r"<[^>]*>", " ")


def identify_documents(docs: DataFrame, **options) -> DataFrame:
    """:func:`identify` over documents: the source is the host, its last label the suffix, and markup in the text may declare."""
    return identify(docs, fit(docs), F.col("text"), F.col("source"), suffix_of(F.col("source")), declared_of(F.col("text")), **options)


def recognised(docs: DataFrame) -> DataFrame:
    """``docs`` without those that :func:`identify_documents` rejects; all columns stay, whatever their names."""
    name = unused(docs, "language")
    return identify_documents(docs, into=name).where(~F.col(f"{name}.rejected")).drop(name)


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify_documents(read(spark, sf_dir, "documents")).select("doc_id", F.col("language.lang").alias("lang_pred"), F.round("language.posterior", 6).alias("posterior"), "language.text_lang", "language.n_grams", "language.rejected")


def language_id_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same operator over web pages, with all four kinds of evidence; the text model is fitted on documents."""
    host = host_of(F.col("url"))
    found = identify(read(spark, sf_dir, "pages"), fit(read(spark, sf_dir, "documents")), page_text(F.col("html")), host, suffix_of(host), declared_of(F.col("html")))
    return found.select("page_id", F.col("language.lang").alias("lang_pred"), F.round("language.posterior", 6).alias("posterior"), "language.text_lang", "language.rejected")
