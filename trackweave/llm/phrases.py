"""Phrase collocations level by level: a phrase of k words can be frequent only where both its parts of k - 1 words are.

Words of enough occurrences get dense numbers, which are joined back to the places where they stand; after that the corpus is kept once,
as runs of these numbers. Every level reads the runs anew: a bit map of the frequent phrases of the level below tells the places to count, and a
phrase is counted under its words' numbers, two to a long, which is exact and small. No level is stored place by place.
A phrase's row has its words' numbers, so joined by their slices it has the counts of all its beginnings and endings.

Word sequences stay together in chunks, runs of documents that one task met. A chunk counts its own phrases first, so what is
shuffled is a phrase once a chunk, not an occurrence.

A chunk is many rows of bounded size, never one: Spark's readers take thousands of rows at once, and hold all of a row group if it has fewer.
"""

from __future__ import annotations

import re
from array import array
from collections import defaultdict
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import BYTES_LOWER, bit_map, bits_set, columns_of, forget, read, short_batches, short_lived_shuffles, stored, table

#: Lower-cases A-Z and makes a line feed of every character that ends a piece.
MAP = bytes(0x0A if b in b".,;:!?\x0a\x0b\x0c\x0d" else c for b, c in enumerate(BYTES_LOWER))
TOKEN = re.compile(rb"[^ \t\n]+|\n")
#: Words of a chunk, about; words, or entries of a list, in a row; rows of an Arrow batch that a worker gets (of such rows, not texts) or returns, at most.
CHUNK, ROW, LISTS, OUT = 1 << 20, 1 << 10, 1 << 11, 1 << 16
#: Bits of the map that lets those entries of a chunk's list through that may be frequent.
BITS = 1 << 25
#: Parts that a language's phrases are ranked in first.
SHARES = 64
NO_LANG = "und"
SCORE_UNIT = 2_000_000


def _bytes(rows: np.ndarray) -> pa.Array:
    """A binary for every row of a table of numbers."""
    ends = np.arange(len(rows) + 1, dtype=np.int32) * np.int32(rows.itemsize * rows.shape[1])
    return pa.Array.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(rows))])


def _numbers(column: pa.ChunkedArray | pa.Array, kind: type) -> np.ndarray:
    """The numbers of all binaries, one after the other."""
    return np.frombuffer(b"".join(column.to_pylist()), kind)


def _rows(values: np.ndarray, size: int, more: int = 0) -> np.ndarray:
    """``values`` in rows of ``size``, each with the ``more`` values that follow it; -1 where there are none."""
    n = -(-len(values) // size)
    filled = np.append(values, np.full(n * size + more - len(values), -1, values.dtype))
    return np.lib.stride_tricks.sliding_window_view(filled, size + more)[::size][:n] if n else filled[:0].reshape(0, size + more)


def _parts(rows: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    for i in range(0, rows.num_rows, OUT):
        yield rows.slice(i, OUT)


def word_chunks(docs: DataFrame, lang_col: str, text_col: str) -> DataFrame:
    """(chunk, part, slot, low, high, lang, word, a): the entries of a chunk's list of distinct (language, word) with their counts, number
    part * ROW + slot in it; and, without a word, the places of the chunk's words in that list, -1 where a piece ends, ROW of them for each ``part``.

    Places go in two halves of 16 bits, entries' numbers in two columns: the higher are mostly alike, and compress to little where whole numbers do not.
    """

    def run(batches):
        chunk, size = TaskContext.get().partitionId() << 32, 0
        fresh = lambda: defaultdict(lambda: (_dictionary(), array("i")))
        held = fresh()
        for b in batches:
            for lang, text in zip(b.column(0), b.column(1)):
                slots, places = held[lang.as_py()]
                before = len(places)
                if text.is_valid:
                    places.extend(map(slots.__getitem__, TOKEN.findall(text.as_buffer().to_pybytes().translate(MAP))))
                places.append(0)  # a document ends
                size += len(places) - before
                if size >= CHUNK:
                    yield from _word_chunk(chunk, held, ROW)
                    chunk, size, held = chunk + 1, 0, fresh()
        if size:
            yield from _word_chunk(chunk, held, ROW)

    named = columns_of(docs, lang_col, text_col).select(F.coalesce(F.col(f"`{lang_col}`").cast("string"), F.lit(NO_LANG)).alias("lang"), F.col(f"`{text_col}`").cast("string").alias("text"))
    return named.mapInArrow(run, "chunk long, part int, slot short, low binary, high binary, lang string, word string, a long")


def _dictionary() -> defaultdict:
    """Word -> its number, in order of first sight; the end of a piece is number 0."""
    slots: defaultdict = defaultdict(count().__next__)  # its own __len__ would be a cycle, which outlives its chunk
    slots[b"\n"]  # noqa: B018
    return slots


def _word_chunk(chunk: int, held: dict, size: int) -> Iterator[pa.RecordBatch]:
    kinds = {"part": pa.int32(), "slot": pa.int16(), "low": pa.binary(), "high": pa.binary(), "lang": pa.string(), "word": pa.string(), "a": pa.int64()}

    def batch(n: int, **columns: pa.Array) -> pa.RecordBatch:
        filled = [columns[c] if c in columns else pa.nulls(n, kind) for c, kind in kinds.items()]
        return pa.RecordBatch.from_arrays([pa.array(np.full(n, chunk, np.int64)), *filled], names=["chunk", *kinds])

    seq, n = [], 0
    for lang, (slots, places) in held.items():
        own = np.frombuffer(places, np.int32)
        seq.append(np.where(own == 0, np.int32(-1), own + np.int32(n - 1)))
        counts, words = np.bincount(own, minlength=len(slots))[1:], pa.array(list(slots)[1:], pa.binary()).view(pa.string())
        at = np.arange(n, n + len(words))
        yield from _parts(batch(len(at), part=pa.array(at // size, pa.int32()), slot=pa.array(at % size, pa.int16()), lang=pa.repeat(lang, len(at)), word=words, a=pa.array(counts, pa.int64())))
        n += len(at)
    rows = _rows(np.concatenate(seq), size)
    yield from _parts(batch(len(rows), part=pa.array(np.arange(len(rows)), pa.int32()), low=_bytes(rows.astype(np.int16)), high=_bytes((rows >> 16).astype(np.int16))))


def word_runs(coded: DataFrame, names: DataFrame, most_words: int) -> DataFrame:
    """(seq): each chunk's words by number, -1 once between runs of frequent words, in rows of ROW numbers and the ``most_words`` - 1 that follow
    them, so that a phrase lies whole in the row where it starts; ``names`` is from :func:`named_words`. A group is one chunk."""

    def run(rows: pa.Table, found: pa.Table) -> pa.Table:
        rows = rows.sort_by("part")
        seq = _numbers(rows.column("high"), np.int16).astype(np.int32) << 16 | _numbers(rows.column("low"), np.uint16)
        numbers = np.full(int(seq.max(initial=-1)) + 2, -1, np.int32)  # the last is that of -1
        pairs = _numbers(found.column("pairs"), np.int64)
        numbers[pairs >> 32] = (pairs & (1 << 32) - 1).astype(np.int32)
        own = numbers[seq]
        return pa.table({"seq": _bytes(_rows(own[(own >= 0) | np.append(True, own[:-1] >= 0)], ROW, most_words - 1))})

    places = coded.where(F.col("low").isNotNull()).select("chunk", "part", "low", "high")
    return places.groupBy("chunk").cogroup(names.groupBy("of")).applyInArrow(run, "seq binary")


def packed(words: list[np.ndarray]) -> list[np.ndarray]:
    """The key of a phrase: its words' numbers, two to a long, an odd one by itself."""
    wide = [w.astype(np.int64) for w in words]
    return [wide[i] << 32 | wide[i + 1] if i + 1 < len(wide) else wide[i] for i in range(0, len(wide), 2)]


def number_at(k: int, j: int) -> Column:
    """Word ``j`` of ``k`` from the columns of :func:`packed`."""
    part = F.col(f"p{j // 2}")
    return (part if j % 2 or j + 1 == k else F.shiftright(part, 32)).bitwiseAND(F.lit((1 << 31) - 1)).cast("int")


def key_bits(keys: list[np.ndarray], size: int) -> np.ndarray:
    """The bit of a phrase in the map of its level; ``size`` is a power of two."""
    x = np.zeros(len(keys[0]), np.uint64)
    for k in keys:
        x = (x ^ k.astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        x ^= x >> np.uint64(32)
    return (x * np.uint64(0xD6E8FEB86659FD93) >> np.uint64(65 - size.bit_length())).astype(np.int64)


def own_counts(keys: list[np.ndarray]) -> list[np.ndarray]:
    """The distinct keys of a chunk in order, and how often each occurs."""
    if len(keys) == 1:
        return list(np.unique(keys[0], return_counts=True))
    order = np.lexsort(keys[::-1])
    keys = [k[order] for k in keys]
    fresh = np.flatnonzero(np.logical_or.reduce([np.append(True, k[1:] != k[:-1])[: len(k)] for k in keys]))
    return [*(k[fresh] for k in keys), np.diff(np.append(fresh, len(order)))]


def phrase_counts(runs: DataFrame, k: int, most_words: int, below: DataFrame | None) -> DataFrame:
    """(p0, p1 and so on, a): phrases of ``k`` words and their occurrences in some rows, of about a chunk's words at most, from the places where both parts pass the bit map of ``below``, the frequent phrases of a word less (None: all do)."""
    names = [f"p{i}" for i in range((k + 1) // 2)]
    shared = None
    if below is not None:

        def bits(batches):
            for b in batches:
                yield pa.RecordBatch.from_arrays([pa.array(key_bits([c.to_numpy() for c in b.columns], BITS))], names=["bit"])

        shared = runs.sparkSession.sparkContext.broadcast(bit_map(below.mapInArrow(bits, "bit long"), BITS))
    width = ROW + most_words - 1

    def counted(own: np.ndarray) -> Iterator[pa.RecordBatch]:
        known = own.reshape(-1, width) >= 0
        m, starts = (k, ROW) if shared is None else (k - 1, ROW + 1)  # the second part of a row's last phrase starts behind its starts
        row, at = np.nonzero(np.logical_and.reduce([known[:, j : j + starts] for j in range(m)]))
        at += row * width
        if shared is not None:
            at = at[bits_set(shared.value, key_bits(packed([own[at + j] for j in range(m)]), BITS))]
            at = at[np.append(at[1:] == at[:-1] + 1, False)[: len(at)]]
        *keys, counts = own_counts(packed([own[at + j] for j in range(k)]))
        return _parts(pa.RecordBatch.from_arrays([*map(pa.array, keys), pa.array(counts, pa.int64())], names=[*names, "a"]))

    def run(batches):
        for b in batches:
            for i in range(0, b.num_rows, -(-CHUNK // ROW)):
                yield from counted(_numbers(b.column(0).slice(i, -(-CHUNK // ROW)), np.int32))

    return runs.select("seq").mapInArrow(run, ", ".join(f"{n} long" for n in [*names, "a"]))


def _entries(coded: DataFrame) -> DataFrame:
    """The entries of every chunk's list."""
    return coded.where(F.col("word").isNotNull()).select("chunk", (F.col("part") * ROW + F.col("slot")).alias("slot"), "lang", "word", "a")


def named_words(coded: DataFrame, level: DataFrame) -> DataFrame:
    """(of, pairs): for the chunk ``of`` the entries of its list that have a number, slot and number in a long, some hundreds a row.

    What a bit map of the words with a number rules out is not shuffled.
    """
    bit = F.pmod(F.xxhash64("lang", "word"), F.lit(BITS)).alias("bit")
    names = level.select(F.col("numbers")[0].alias("number"), "lang", F.col("words")[0].alias("word"))
    shared = coded.sparkSession.sparkContext.broadcast(bit_map(names.select(bit), BITS))

    def passed(batches):
        for b in batches:
            yield b.select([0, 1, 2, 3]).filter(pa.array(bits_set(shared.value, b.column(4).to_numpy())))

    def gathered(batches):  # rows of many chunks come mixed: those of a chunk are put together as far as a bounded number of rows goes
        held, size = [], 0
        for b in batches:
            held.append(b)
            size += b.num_rows
            if size >= CHUNK:
                yield from _pairs(held, ROW)
                held, size = [], 0
        if size:
            yield from _pairs(held, ROW)

    entries = _entries(coded).select(F.col("chunk").alias("of"), "slot", "lang", "word", bit).mapInArrow(passed, "of long, slot int, lang string, word string")
    return entries.join(names, ["lang", "word"]).select("of", "slot", "number").mapInArrow(gathered, "of long, pairs binary")


def _pairs(held: list[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    of, slot, number = (np.concatenate([b.column(c).to_numpy() for b in held]) for c in range(3))
    order = np.lexsort([slot, of])
    of, pairs = of[order], (slot.astype(np.int64) << 32 | number)[order]
    chunks, first, counts = np.unique(of, return_index=True, return_counts=True)
    cuts = np.concatenate([np.arange(f, f + n, most) for f, n in zip(first, counts)])
    ends = np.append(cuts, len(pairs)).astype(np.int32) * np.int32(8)
    found = pa.Array.from_buffers(pa.binary(), len(cuts), [None, pa.py_buffer(ends), pa.py_buffer(pairs)])
    yield from _parts(pa.RecordBatch.from_arrays([pa.array(of[cuts]), found], names=["of", "pairs"]))


def numbered(words: DataFrame) -> DataFrame:
    """Words (lang, word, a) with a dense ``number``, smaller for words of more occurrences: dealt in turn from the partitions, each in that order."""
    at = table(words.sortWithinPartitions(F.desc("a"), "lang", "word").select("lang", "word", "a", F.monotonically_increasing_id().alias("at")), "phrases-frequent")
    part, row = F.shiftright("at", 33), F.col("at").bitwiseAND(F.lit((1 << 33) - 1))
    parts = (at.agg(F.max(part)).first()[0] or 0) + 1
    number = row * parts + part
    return at.withColumn("number", F.when(number < 1 << 31, number.cast("int")).otherwise(F.raise_error(F.lit("more frequent words than 31 bits can number"))))


def frequent_phrases(docs: DataFrame, most_words: int = 4, least: int = 30, lang_col: str = "lang", text_col: str = "text") -> tuple[DataFrame, list[DataFrame]]:
    """Words a language, and a table a level of the phrases of 1 to ``most_words`` words with ``least`` occurrences.

    Totals: (lang, n). A level: (numbers, lang, words, a, begins, ends); numbers has the words' numbers, those of a phrase without its last
    or its first word name it a level below; begins[k - 1] counts its first k words and ends[k - 1] its last k.
    """
    spark = docs.sparkSession
    short_batches(spark)
    short_lived_shuffles(spark)
    coded, path = stored(word_chunks(docs, lang_col, text_col), "phrases-words")
    totals = table(_entries(coded).groupBy("lang").agg(F.sum("a").alias("n")), "phrases-totals")
    counted = _entries(coded).groupBy("lang", "word").agg(F.sum("a").alias("a")).where(F.col("a") >= least)
    one = F.array("a")
    level = table(numbered(counted).select(F.array("number").alias("numbers"), "lang", F.array("word").alias("words"), "a", one.alias("begins"), one.alias("ends")), "phrases-1")
    levels, keys = [level], None
    short_batches(spark, LISTS)
    found, found_path = stored(named_words(coded, level), "phrases-found")  # its shuffle files go before the runs' come
    runs, runs_path = stored(word_runs(coded, found, most_words), "phrases-runs")
    forget(spark, path)
    forget(spark, found_path)
    for k in range(2, most_words + 1):
        names = [f"p{i}" for i in range((k + 1) // 2)]
        counted = phrase_counts(runs, k, most_words, keys).groupBy(*names).agg(F.sum("a").alias("a")).where(F.col("a") >= least)
        named = table(counted.select(*names, F.array(*[number_at(k, j) for j in range(k)]).alias("numbers"), "a"), f"phrases-names-{k}")
        keys = named.select(*names)
        named = named.select("numbers", F.slice("numbers", 1, k - 1).alias("left"), F.slice("numbers", 2, k - 1).alias("right"), "a")
        left = level.select(F.col("numbers").alias("left"), "lang", F.col("words").alias("first"), "begins")
        right = level.select(F.col("numbers").alias("right"), F.element_at("words", -1).alias("last"), "ends")
        full = named.join(left, "left").join(right, "right")
        full = full.select("numbers", "lang", F.concat("first", F.array("last")).alias("words"), "a", F.concat("begins", F.array("a")).alias("begins"), F.concat("ends", F.array("a")).alias("ends"))
        level = table(full, f"phrases-{k}")
        levels.append(level)
    forget(spark, runs_path)
    short_batches(spark)
    return totals, levels


def lowest_cut() -> Column:
    """(score, k, l, r) of the cut of least score, ties to the least k; score is floor(SCORE_UNIT * a / (l + r)), in decimals, which are exact."""

    def cut(k: Column) -> Column:
        l, r = F.element_at("begins", k), F.element_at("ends", F.size("words") - k)  # noqa: E741
        score = F.call_function("div", F.lit(SCORE_UNIT).cast("decimal(10,0)") * F.col("a").cast("decimal(19,0)"), l.cast("decimal(19,0)") + r.cast("decimal(19,0)"))
        return F.struct(score.alias("score"), k.alias("k"), l.alias("l"), r.alias("r"))

    return F.array_min(F.transform(F.sequence(F.lit(1), F.size("words") - 1), cut))


def collocations(docs: DataFrame, top: int = 2000, most_words: int = 4, least: int = 30, covered: int = 80, lang_col: str = "lang", text_col: str = "text") -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's ``top`` phrases by score, then a, both descending, then the phrase's bytes.

    Phrases of 2 to ``most_words`` words with ``least`` occurrences are candidates; one that lies inside a longer candidate of ``covered`` per
    cent of its occurrences goes. (It then lies inside one of a single word more that has as many, so the parts of the next
    level's rows tell.) A null language is ``und``; null and empty texts have no words; rows that repeat count each time; an empty
    table gives no rows; further columns are ignored; a very long text is one run of words in its chunk.
    """
    totals, levels = frequent_phrases(docs, most_words, least, lang_col, text_col)
    found = None
    for k, level in enumerate(levels[1:], 1):
        kept = level
        if k + 1 < len(levels):
            above = levels[k + 1]
            part = lambda start: above.select(F.slice("numbers", start, k + 1).alias("numbers"), F.col("a").alias("most"))  # noqa: B023, E731
            over = part(1).union(part(2)).groupBy("numbers").agg(F.max("most").alias("most"))
            kept = level.join(over, "numbers", "left").where(F.col("most").isNull() | (100 * F.col("most") < covered * F.col("a")))
        kept = kept.select("lang", F.array_join("words", " ").alias("phrase"), "a", lowest_cut().alias("c")).select("lang", "phrase", "a", "c.l", "c.r", "c.score")
        found = kept if found is None else found.union(kept)
    order = [F.desc("score"), F.desc("a"), "phrase"]
    ranked = found.withColumn("share", F.pmod(F.xxhash64("phrase"), F.lit(SHARES)))  # the first of a language are among the first of its shares, so no task sorts all its phrases
    for keys in (["lang", "share"], ["lang"]):
        ranked = ranked.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("rank") <= top)
    return ranked.join(totals, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


def op11_phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(read(spark, sf_dir, "documents"))


OP11_SQL = r"""
WITH piece AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS p FROM documents),
run AS (SELECT lang, regexp_extract_all(p, '[^\x20\x09]+') AS w FROM piece),
total AS (SELECT lang, sum(len(w)) AS n FROM run GROUP BY lang),
gram AS (SELECT lang, m, array_to_string(w[i : i + m - 1], ' ') AS g FROM (SELECT lang, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM run, (SELECT unnest([1, 2, 3, 4]) AS m))),
f AS (SELECT lang, m, g, count(*) AS a FROM gram GROUP BY ALL HAVING count(*) >= 30),
cand AS (SELECT lang, m, g, a, string_split(g, ' ') AS w FROM f WHERE m > 1),
cut AS (SELECT lang, m, g, a, k, array_to_string(w[1 : k], ' ') AS x, array_to_string(w[k + 1 : m], ' ') AS y FROM (SELECT *, unnest(range(1, m)) AS k FROM cand)),
scored AS (SELECT c.lang, c.m, c.g, c.a, c.k, p.a AS l, q.a AS r, (2000000 * CAST(c.a AS HUGEINT)) // (p.a + q.a) AS score FROM cut c JOIN f p ON p.lang = c.lang AND p.g = c.x JOIN f q ON q.lang = c.lang AND q.g = c.y),
best AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, g ORDER BY score, k) = 1),
gone AS (SELECT DISTINCT s.lang, s.g FROM (SELECT lang, a, array_to_string(w[i : i + j - 1], ' ') AS g FROM (SELECT *, unnest(range(1, m - j + 2)) AS i FROM (SELECT *, unnest(range(2, m)) AS j FROM cand))) o
         JOIN cand s ON s.lang = o.lang AND s.g = o.g WHERE 100 * o.a >= 80 * s.a),
ranked AS (SELECT b.*, row_number() OVER (PARTITION BY b.lang ORDER BY b.score DESC, b.a DESC, b.g) AS rank FROM best b ANTI JOIN gone x ON x.lang = b.lang AND x.g = b.g)
SELECT lang, rank, g AS phrase, a, l, r, CAST(n AS BIGINT) AS n, CAST(score AS BIGINT) AS score FROM ranked JOIN total USING (lang) WHERE rank <= 2000
"""
