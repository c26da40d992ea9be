"""Benchmark decontamination by Wu-Manber multi-pattern search over words.

The patterns are the benchmark's word windows, grouped by length. A table of the shift that each
two-word block allows skips positions no window can end at; where the shift is zero, the block
selects its bucket, the window's first block selects within it, and comparing all words confirms.
"""

from __future__ import annotations

import re
from collections import defaultdict

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ASCII_LOWER, columns_of, read, short_batches

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
SQL_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Items a search table may hold; a larger benchmark is searched in as many passes as it takes.
ITEMS_A_PASS = 20_000
RESULT = "doc_id long, n_words long, n_hit long, hits array<int>, items array<string>"


def words_of(text: str | None) -> list[str]:
    return WORD.findall((text or "").translate(ASCII_LOWER))


class WuManber:
    """Search tables for windows of one length, in words."""

    def __init__(self, windows: dict[tuple, list[int]]):
        self.m = len(next(iter(windows)))
        self.block = min(2, self.m)
        self.most = self.m - self.block + 1
        self.shift: dict[tuple, int] = {}
        self.buckets: dict[tuple, dict[tuple, list[tuple]]] = defaultdict(lambda: defaultdict(list))
        for w in windows:
            for end in range(self.block, self.m + 1):
                key = w[end - self.block : end]
                self.shift[key] = min(self.shift.get(key, self.most), self.m - end)
            self.buckets[w[-self.block :]][w[: self.block]].append(w)
        self.items = windows

    def find(self, words: list[str]):
        """(start, items) of every occurrence of every window."""
        m, block, most, shift = self.m, self.block, self.most, self.shift.get
        end, n, own = m, len(words), tuple(words)
        while end <= n:
            last = own[end - block : end]
            skip = shift(last, most)
            if skip:
                end += skip
                continue
            start = end - m
            for window in self.buckets[last].get(own[start : start + block], ()):
                if window == own[start:end]:
                    yield start, self.items[window]
            end += 1


def search_tables(items: list[tuple], window: int) -> list[WuManber]:
    by_length: dict[int, dict[tuple, list[int]]] = defaultdict(lambda: defaultdict(list))
    for item, text in items:
        words = tuple(words_of(text))
        if not words:
            continue
        size = min(window, len(words))
        for w in {words[i : i + size] for i in range(len(words) - size + 1)}:
            by_length[size][w].append(item)
    return [WuManber(dict(w)) for w in by_length.values()]


def merged(spans) -> list[int]:
    """Runs of positions covered by (start, end) spans, flat as [start, end, start, end ...]."""
    runs: list[int] = []
    for a, b in sorted(spans):
        if runs and a <= runs[-1]:
            runs[-1] = max(runs[-1], b)
        else:
            runs += [a, b]
    return runs


def hit_words(words: list[str], tables: list[WuManber], hits=(), items=()) -> tuple[list[int], list[str]]:
    """Runs of hit word positions and the items found, added to those of earlier passes."""
    spans, found = list(zip(hits[::2], hits[1::2])), set(items)
    for t in tables:
        for start, own in t.find(words):
            spans.append((start, start + t.m))
            found.update(own)
    return merged(spans), sorted(found)


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = 10, items_a_pass: int = ITEMS_A_PASS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_words, n_hit, hits, items) of every document row.

    hits: the hit word positions as flat [start, end) runs; items: ids of the benchmark items with a
    window in the document, sorted as strings. The texts are read once and not shuffled: the search
    tables are broadcast, and their size is checked first; a benchmark of more than ``items_a_pass``
    items is searched in several passes, each adding to the hits. A null or empty text has no words;
    an item without words has no window; an item repeated under several ids counts for each of them;
    repeated document rows are each returned; further columns are ignored.
    """
    spark = docs.sparkSession
    short_batches(spark)
    bench = benchmark.select(F.col("item_id").cast("string").alias("item_id"), F.col("text").cast("string").alias("text")).where("item_id is not null and text is not null")
    passes = -(-bench.count() // items_a_pass) or 1
    found = columns_of(docs, id_col, text_col).select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    for k in range(passes):
        part = bench if passes == 1 else bench.where(F.pmod(F.xxhash64("item_id"), F.lit(passes)) == k)
        found = _search(found, sorted((r["item_id"], r["text"]) for r in part.toLocalIterator()), window, first=k == 0, last=k == passes - 1)
    return found


def _search(found: DataFrame, items: list[tuple[str, str]], window: int, first: bool, last: bool) -> DataFrame:
    shared, own = found.sparkSession.sparkContext.broadcast(items), []

    def run(batches):
        if not own:
            own.append(search_tables(shared.value, window))
        for b in batches:
            before = ([()] * len(b),) * 2 if first else (b.column("hits").to_pylist(), b.column("items").to_pylist())
            out = []
            for text, hits, items in zip(b.column("text").to_pylist(), *before):
                words = words_of(text)
                hits, items = hit_words(words, own[0], hits, items)
                out.append((len(words), sum(hits[1::2]) - sum(hits[::2]), hits, items))
            cols = list(zip(*out)) or [()] * 4
            arrays = [b.column("doc_id"), *[pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.list_(pa.int32()), pa.list_(pa.string())))]]
            names = ["doc_id", "n_words", "n_hit", "hits", "items"]
            yield pa.RecordBatch.from_arrays(arrays if last else [*arrays, b.column("text")], names=names if last else [*names, "text"])

    return found.mapInArrow(run, RESULT if last else f"{RESULT}, text string")


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, window: int = 10, items_a_pass: int = ITEMS_A_PASS, text_col: str = "text") -> DataFrame:
    """``docs`` without the documents in which a benchmark window occurs; columns stay, texts are not shuffled."""
    spark = docs.sparkSession
    short_batches(spark)
    bench = benchmark.select(F.col("item_id").cast("string").alias("item_id"), F.col("text").cast("string").alias("text")).where("item_id is not null and text is not null")
    passes = -(-bench.count() // items_a_pass) or 1
    for k in range(passes):
        part = bench if passes == 1 else bench.where(F.pmod(F.xxhash64("item_id"), F.lit(passes)) == k)
        shared, own = spark.sparkContext.broadcast(sorted((r["item_id"], r["text"]) for r in part.toLocalIterator())), []

        @F.pandas_udf("boolean")
        def clean(texts: pd.Series) -> pd.Series:
            if not own:
                own.append(search_tables(shared.value, window))
            return pd.Series([not any(True for s in own[0] for _ in s.find(words)) for words in map(words_of, texts)], dtype=bool)

        docs = docs.where(clean.asNondeterministic()(F.col(f"`{text_col}`").cast("string")))  # so that the optimizer leaves it where it stands
    return docs


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contamination(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated")
    )


OP2_SQL = rf"""
WITH doc AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{SQL_WORD}') AS w FROM documents),
item AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{SQL_WORD}') AS w FROM benchmark),
sized AS (SELECT item_id, w, least(10, len(w)) AS m FROM item WHERE len(w) > 0),
windows AS (SELECT DISTINCT item_id, m, array_to_string(w[i : i + m - 1], ' ') AS g FROM (SELECT item_id, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM sized)),
sizes AS (SELECT DISTINCT m FROM windows),
spots AS (SELECT doc_id, m, i, array_to_string(w[i : i + m - 1], ' ') AS g FROM (SELECT doc_id, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM doc, sizes)),
found AS (SELECT s.doc_id, s.m, s.i, v.item_id FROM spots s JOIN windows v ON s.m = v.m AND s.g = v.g),
hit AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + m)) AS p FROM found) GROUP BY doc_id),
named AS (SELECT doc_id, count(*) AS n_items, string_agg(k, ',' ORDER BY k) AS items FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS k FROM found) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, coalesce(h.n_hit, 0) AS n_hit, coalesce(n.n_items, 0) AS n_items, sha256(coalesce(n.items, '')) AS items_sha256, coalesce(h.n_hit, 0) > 0 AS contaminated
FROM doc d LEFT JOIN hit h USING (doc_id) LEFT JOIN named n USING (doc_id)
"""
