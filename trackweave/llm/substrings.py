"""Exact substring dedup: bytes covered by a string of ``length`` bytes that also starts earlier are removed.

Blockwise suffix sorting over a cover sample. The cover is chosen by content: of the grams in each window of
``length`` bytes the one of least hash is sampled, so equal windows hold equal samples at equal distances, as a
difference cover holds them by position at many times the density. A sample and the windows that chose it are
its cell. Suffix buckets, one for each sampled gram, are sorted by Spark one at a time: cells that tie in all
their bytes have one rank (a hash of them), so long ties are settled by ranks alone, and the first of each
rank in the order of (doc_id, start) stands for the others. Only where different cells share a bucket are their
windows compared, byte by byte.
"""

from __future__ import annotations

import gc
import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import read, short_batches, table
from .decontaminate import merged

LENGTH, GRAM = 100, 32
#: Bytes hashed at a time, cells ranked together before they are sent, and cells of a bucket that one task compares.
PIECE, RANKED, BUCKET_CELLS = 1 << 20, 400_000, 20_000
BASE = 0x9E3779B97F4A7C15
U = np.uint64


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> U(31))) * U(0xBF58476D1CE4E5B9)
    return h ^ (h >> U(29))


class Hasher:
    """Hashes of all substrings of one length, from prefix sums of byte values times powers of an odd base, modulo 2**64."""

    def __init__(self):
        self.values = np.random.default_rng(7).integers(0, 2**63, 256, dtype=np.uint64) * U(2) + U(1)
        self.up = self.down = np.ones(1, np.uint64)

    def prepare(self, raw: np.ndarray) -> np.ndarray:
        n = len(raw)
        if len(self.up) <= n:
            inverse = pow(BASE, -1, 1 << 64)
            self.up, self.down = (np.multiply.accumulate(np.concatenate(([U(1)], np.full(n + 1, U(b))))) for b in (BASE, inverse))
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum(self.values[raw] * self.up[:n], out=sums[1:])
        return sums


def _sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Least of each ``width`` neighbours, by running minima of blocks from both sides."""
    blocks = np.concatenate((x, np.full(-len(x) % width, U(2**64 - 1)))).reshape(-1, width)
    ahead, back = np.minimum.accumulate(blocks, axis=1).ravel(), np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    n = len(x) - width + 1
    return np.minimum(back[:n], ahead[width - 1 : width - 1 + n])


def cells_of(raws: list[bytes], hasher: Hasher, length: int = LENGTH, gram: int = GRAM):
    """Cells of texts: (text number, first window, sample's distance from it, number of windows, gram hash, rank hash)."""
    raw = np.frombuffer(b"".join(raws), np.uint8)
    none = tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.int64, np.int64, np.uint64, np.uint64))
    if len(raw) < length:
        return none
    ends = np.cumsum([len(r) for r in raws])
    sums = hasher.prepare(raw)
    m = len(raw) - gram + 1
    grams = _mix((sums[gram:] - sums[:-gram]) * hasher.down[:m])
    low = U((1 << max(1, int(m).bit_length())) - 1)  # the place breaks ties: the leftmost of equal grams
    least = _sliding_min((grams & ~low) | np.arange(m, dtype=np.uint64), length - gram + 1)
    sample, start = (least & low).astype(np.int64), np.arange(len(least))
    text = np.searchsorted(ends, start, side="right")
    inside = start + length <= ends[text]
    sample, start, text = sample[inside], start[inside], text[inside]
    if not len(start):
        return none
    new = np.ones(len(start), bool)
    new[1:] = (sample[1:] != sample[:-1]) | (text[1:] != text[:-1])
    first = np.flatnonzero(new)
    lo, hi, at, text = start[first], start[np.append(first[1:], len(start)) - 1], sample[first], text[first]
    begins = ends - np.array([len(r) for r in raws])
    shape = (at - lo).astype(np.uint64) * U(1 << 20) + (hi - lo).astype(np.uint64)
    rank = _mix(((sums[hi + length] - sums[lo]) * hasher.down[lo]) ^ _mix(shape * U(BASE)))
    return text, lo - begins[text], at - lo, hi - lo + 1, grams[at], rank


def _pack(lo, windows, again=0):
    return (lo << 24) | (windows << 8) | again


def _unpack(m: int) -> tuple[int, int]:
    """First window and number of windows."""
    return m >> 24, m >> 8 & 0xFFFF


def _ranked(docs: DataFrame, length: int, gram: int) -> DataFrame:
    """(g, c, doc_id, m) of all cells. A cell whose rank an earlier one of the same chunk has is settled (m odd)
    and dealt by its place, so copies within a chunk do not crowd a bucket."""

    def run(batches):
        hasher = Hasher()

        def ranked(found):
            doc, lo, windows, g, c = (np.concatenate(x) for x in zip(*found))
            order = np.lexsort((lo, doc, c))
            doc, lo, windows, g, c = doc[order], lo[order], windows[order], g[order], c[order]
            new = np.concatenate(([True], c[1:] != c[:-1]))
            head = np.flatnonzero(new)[np.cumsum(new) - 1]
            again = (doc != doc[head]) | (lo != lo[head])
            g = np.where(again, _mix(doc.astype(np.uint64) * U(BASE) + lo.astype(np.uint64)), g)
            m = _pack(lo, windows, again.astype(np.int64))
            for at in range(0, len(m), 50_000):
                cut = slice(at, at + 50_000)
                yield pa.RecordBatch.from_arrays([pa.array(x[cut]) for x in (g.view(np.int64), c.view(np.int64), doc, m)], names=["g", "c", "doc_id", "m"])

        found, held = [], 0
        for b in batches:
            ids, raws = b.column("doc_id").to_numpy(), b.column("raw").to_pylist()
            at = 0
            while at < len(raws):
                upto, size = at, 0
                while upto < len(raws) and (upto == at or size + len(raws[upto]) <= PIECE):
                    size += len(raws[upto])
                    upto += 1
                text, lo, _, windows, g, c = cells_of(raws[at:upto], hasher, length, gram)
                if len(text):
                    found.append((ids[at:upto][text], lo, windows, g, c))
                    held += len(text)
                at = upto
                if held >= RANKED:
                    yield from ranked(found)
                    found, held = [], 0
        if found:
            yield from ranked(found)

    return docs.mapInArrow(run, "g long, c long, doc_id long, m long")


RESULT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
PENDING = f"{RESULT}, raw binary, runs array<long>, g array<long>, m array<long>, cell array<binary>"


def _outcome(raw: bytes, runs: list[int]) -> tuple:
    digest, at = hashlib.sha256(), 0
    for a, b in zip(runs[::2], runs[1::2]):
        digest.update(raw[at:a])
        at = b
    digest.update(raw[at:])
    return len(raw), sum(runs[1::2]) - sum(runs[::2]), len(runs) // 2, digest.hexdigest()


def _settle(joined: DataFrame, length: int) -> DataFrame:
    """A row for each document: its outcome if no cell of it is open, else its bytes, the runs removed so far and the open cells' bytes."""

    def run(batches):
        for b in batches:
            out = []
            for doc, raw, gone, opened in zip(*(b.column(c).to_pylist() for c in ("doc_id", "raw", "gone", "opened"))):
                runs = merged((lo, lo + n - 1 + length) for lo, n in map(_unpack, gone or ()))
                if opened:
                    spots = [(o["g"], o["m"], *_unpack(o["m"])) for o in opened]
                    out.append((doc, None, None, None, None, raw, runs, [s[0] for s in spots], [s[1] for s in spots], [raw[lo : lo + n - 1 + length] for _, _, lo, n in spots]))
                else:
                    out.append((doc, *_outcome(raw, runs), None, None, [], [], []))
            cols = list(zip(*out)) or [()] * 10
            kinds = [pa.int64()] * 4 + [pa.string(), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.binary())]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], names=[c.strip().split()[0] for c in PENDING.split(",")])

    return joined.mapInArrow(run, PENDING)


def _compare(cells: DataFrame, length: int) -> DataFrame:
    """(doc_id, a, b): runs of window starts [a, b) that an earlier window of the same bucket equals; buckets come one after another, in order of place."""

    def run(batches):
        bucket, seen, before = None, {}, None
        for b in batches:
            out = []
            for g, doc, m, cell in zip(*(b.column(c).to_pylist() for c in ("g", "doc_id", "m", "cell"))):
                if g != bucket:
                    bucket, seen = g, {}
                if (g, doc, m) == before:
                    continue
                before = (g, doc, m)
                lo, n = _unpack(m)
                for j in range(n):
                    if seen.setdefault(cell[j : j + length], (doc, lo + j)) != (doc, lo + j):
                        if out and out[-1][0] == doc and out[-1][2] == lo + j:
                            out[-1][2] += 1
                        else:
                            out.append([doc, lo + j, lo + j + 1])
            cols = list(zip(*out)) or [()] * 3
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=["doc_id", "a", "b"])

    return cells.sortWithinPartitions("g", "doc_id", "m").mapInArrow(run, "doc_id long, a long, b long")


def _compare_large(cells: DataFrame, length: int) -> DataFrame:
    """The same for buckets of too many cells: their windows are dealt out by a 128-bit hash and the least place of each is found by grouping."""

    def run(batches):
        for b in batches:
            out = [(xxhash.xxh3_128_digest(cell[j : j + length]), doc, _unpack(m)[0] + j) for doc, m, cell in zip(*(b.column(c).to_pylist() for c in ("doc_id", "m", "cell"))) for j in range(_unpack(m)[1])]
            cols = list(zip(*out)) or [()] * 3
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.binary(), pa.int64(), pa.int64()))], names=["h", "doc_id", "a"])

    windows = cells.mapInArrow(run, "h binary, doc_id long, a long")
    first = windows.groupBy("h").agg(F.min(F.struct("doc_id", "a")).alias("first"))
    later = windows.join(first, "h").where("first.doc_id != doc_id or first.a != a")
    return later.select("doc_id", "a", (F.col("a") + 1).alias("b")).distinct()


def _free(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of finished jobs: its cleaner follows the driver's garbage collection."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def remove_repeats(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) of every document row with an id.

    Texts are UTF-8 bytes; a null text is empty. Removed is each byte covered by a string of ``length`` bytes
    that also starts earlier: in a smaller doc_id, or before it in the same text; overlaps count, and
    strings are judged on the input. Rows that share a doc_id stand at one place, none earlier than the other,
    and what goes from one goes from each. Rows without doc_id have no place and are left out. An empty
    table gives an empty result. Ranks are 64-bit hashes of cells.
    """
    spark = docs.sparkSession
    short_batches(spark)
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.coalesce(F.col(f"`{text_col}`").cast("string").cast("binary"), F.lit(b"")).alias("raw")).where("doc_id is not null")
    bucket, tie = Window.partitionBy("g"), Window.partitionBy("g", "c").orderBy("doc_id", "m")
    ranked = _ranked(rows, length, gram).withColumn("first", F.first(F.struct("doc_id", "m")).over(tie)).withColumn("mixed", F.min("c").over(bucket) != F.max("c").over(bucket))
    later = (F.col("m") % 2 == 1) | (F.col("first.doc_id") != F.col("doc_id")) | (F.col("first.m") != F.col("m"))
    decided = table(ranked.where(later | F.col("mixed")).select("doc_id", "m", F.when(~later, F.col("g")).alias("g")), "repeat-cells")
    _free(spark)
    lists = decided.groupBy("doc_id").agg(F.collect_set(F.when(F.col("g").isNull(), F.col("m"))).alias("gone"), F.collect_set(F.when(F.col("g").isNotNull(), F.struct("g", "m"))).alias("opened"))
    pending = table(_settle(rows.join(lists, "doc_id", "left").select("doc_id", "raw", "gone", "opened"), length), "repeat-pending")
    _free(spark)
    cells = pending.where("raw is not null").select("doc_id", F.inline(F.arrays_zip("g", "m", "cell")))
    sizes = cells.groupBy("g").agg(F.count("*").alias("n")).where(F.col("n") > BUCKET_CELLS).select("g")
    large = table(sizes, "repeat-large")
    small, most = cells.join(large, "g", "left_anti"), cells.join(large, "g", "left_semi")
    runs = _compare(small.repartition("g"), length)
    if large.limit(1).count():
        runs = runs.union(_compare_large(most, length))
    found = table(runs.groupBy("doc_id").agg(F.collect_list(F.struct("a", "b")).alias("more")), "repeat-runs")
    _free(spark)

    def finish(batches):
        for b in batches:
            out = []
            for doc, raw, gone, more in zip(*(b.column(c).to_pylist() for c in ("doc_id", "raw", "runs", "more"))):
                spans = list(zip(gone[::2], gone[1::2])) + [(x["a"], x["b"] - 1 + length) for x in more or ()]
                out.append((doc, *_outcome(raw, merged(spans))))
            cols = list(zip(*out)) or [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, [pa.int64()] * 4 + [pa.string()])], names=[c.strip().split()[0] for c in RESULT.split(",")])

    last = pending.where("raw is not null").select("doc_id", "raw", "runs").join(found, "doc_id", "left").select("doc_id", "raw", "runs", "more").mapInArrow(finish, RESULT)
    return pending.where("raw is null").select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").union(last)


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(read(spark, sf_dir, "documents"))




OP3_SQL = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS x, octet_length(encode(coalesce(text, ''))) AS n FROM documents WHERE doc_id IS NOT NULL),
piece AS (SELECT doc_id, c, n, substr(x, 2000 * c + 1, 2198) AS y FROM (SELECT doc_id, x, n, unnest(range(0, n // 1000 + 1)) AS c FROM d)),
spot AS (SELECT doc_id, 1000 * c + i AS p, hash(substr(y, 2 * i + 1, 200)) AS s FROM (SELECT doc_id, c, y, unnest(range(0, least(1000, n - 99 - 1000 * c))) AS i FROM piece)),
firsts AS (SELECT s, min((doc_id, p)) AS f FROM spot GROUP BY s HAVING count(*) > 1),
later AS (SELECT doc_id, p FROM spot JOIN firsts USING (s) WHERE f <> (doc_id, p)),
reached AS (SELECT doc_id, p, max(p + 100) OVER (PARTITION BY doc_id ORDER BY p ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM later),
numbered AS (SELECT doc_id, p, sum(CASE WHEN reach IS NULL OR p > reach THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY p) AS run FROM reached),
runs AS (SELECT doc_id, min(p) AS a, max(p) + 100 AS b FROM numbered GROUP BY doc_id, run),
parts AS (SELECT doc_id, a, b, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS before FROM runs),
kept AS (SELECT parts.doc_id, string_agg(substr(x, 2 * before + 1, 2 * (a - before)), '' ORDER BY a) AS head, max(b) AS tail, sum(b - a) AS n_removed, count(*) AS n_spans FROM parts JOIN d USING (doc_id) GROUP BY parts.doc_id)
SELECT d.doc_id, CAST(n AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(coalesce(head || substr(x, 2 * tail + 1), x))) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id)
"""
