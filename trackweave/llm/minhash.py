"""MinHash near-dedup by a multi-index Hamming join.

A signature has ``COMPONENTS`` minima of ``b`` = 8 bits each. Sets of the wanted similarity differ in ``most_different`` components at
most (six deviations above the mean). The components are split into so few chunks that, by the pigeonhole principle, two such
signatures have a chunk in which one component differs at most: every chunk is indexed once for each component that may be the one in
error, by the others. Whatever shares a key is a candidate, its signature distance is compared, and the whole sets confirm it.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bit_map, bits_set, columns_of, connected_components, read, short_batches, signed, table
from .simhash import BITS, shingle_hashes

COMPONENTS, WORDS = 96, 12
#: Members of a key up to which they are paired whole; rows of a tile of a larger one; parts that a set in many pairs is sent to.
BUCKET, TILE, SALTS = 16, 512, 16
#: One set of a crowd in so many is counted to rank its shingles, and so many ranks are kept: they bear on speed alone.
RANK_SHARE, RANKS = 16, 100_000
_RANDOM = np.random.default_rng(12)
ODD = _RANDOM.integers(0, 1 << 63, COMPONENTS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
ADD = _RANDOM.integers(0, 1 << 63, COMPONENTS, dtype=np.uint64)
#: The lowest bit of each byte of a 64-bit word.
LOWEST = 0x0101010101010101


def signature(hashes: np.ndarray) -> np.ndarray:
    """A byte for each order of the shingle hashes: 8 bits of the least."""
    least = np.full(COMPONENTS, np.uint64(2**64 - 1))
    for at in range(0, len(hashes), 512):  # bounds the memory of a very long text
        np.minimum(least, (hashes[at : at + 512, None] * ODD + ADD).min(axis=0), out=least)
    least = (least ^ (least >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return (least >> np.uint64(56)).astype(np.uint8)


def most_different(percent: int) -> int:
    """Differing components that sets of ``percent`` similarity or more stay within, at six deviations."""
    p = (1 - percent / 100) * 255 / 256
    return math.ceil(COMPONENTS * p + 6 * math.sqrt(COMPONENTS * p * (1 - p)))


def chunk_bounds(limit: int) -> list[tuple[int, int]]:
    """(first, end) of the fewest chunks of which two signatures within ``limit`` components must have one with a single error at most."""
    n = limit // 2 + 1
    if n * 2 > COMPONENTS:
        raise ValueError("the similarity is too low for keys of chunks with an error")
    cuts = [round(k * COMPONENTS / n) for k in range(n + 1)]
    return list(zip(cuts, cuts[1:]))


def chunk_keys(signatures: np.ndarray, limit: int) -> np.ndarray:
    """A key for each component that may be in error: its number, and a hash of the chunk's other components."""
    keys = np.empty(signatures.shape, np.int64)
    for lo, hi in chunk_bounds(limit):
        for k in range(lo, hi):
            own = np.full(len(signatures), np.uint64(k + 1))
            for c in range(lo, hi):
                if c != k:
                    own = (own ^ signatures[:, c]) * np.uint64(0x9E3779B97F4A7C15)
                    own ^= own >> np.uint64(29)
            keys[:, k] = own.view(np.int64)
    return keys


def signatures(docs: DataFrame, shingle: int) -> DataFrame:
    """(doc_id, node, n, sig) of docs (doc_id, text): a hash that names the set, its size, and its signature as 64-bit words; no shuffle."""

    def run(batches):
        for b in batches:
            nodes, sizes, sigs = [], [], []
            for text in b.column(1).to_pylist():
                own = np.unique(shingle_hashes(text, shingle))
                nodes.append(signed(xxhash.xxh64_intdigest(own.astype("<u8").tobytes(), 42)) if len(own) else None)
                sizes.append(len(own))
                sigs.append(signature(own).view("<i8") if len(own) else np.zeros(WORDS, "<i8"))
            words = pa.FixedSizeListArray.from_arrays(pa.array(np.concatenate(sigs) if sigs else np.zeros(0, "<i8")), WORDS).cast(pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(nodes, pa.int64()), pa.array(sizes, pa.int64()), words], names=["doc_id", "node", "n", "sig"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, node long, n long, sig array<long>")


def keyed(firsts: DataFrame, limit: int) -> DataFrame:
    """(key, node, n) of every distinct set."""

    def run(batches):
        for b in batches:
            keys = chunk_keys(b.column(2).flatten().to_numpy().astype("<i8").view(np.uint8).reshape(len(b), COMPONENTS), limit) if len(b) else np.zeros((0, COMPONENTS), np.int64)
            node, n = (pa.array(np.repeat(b.column(k).to_numpy(), COMPONENTS)) for k in (0, 1))
            yield pa.RecordBatch.from_arrays([pa.array(keys.ravel()), node, n], names=["key", "node", "n"])

    return firsts.select("node", "n", "sig").mapInArrow(run, "key long, node long, n long")


def differing(a: str, b: str) -> Column:
    """Components in which the signatures of columns ``a`` and ``b`` differ: each byte of the words' XOR is folded onto its lowest bit."""
    total = F.lit(0)
    for k in range(WORDS):
        x = F.get(F.col(a), F.lit(k)).bitwiseXOR(F.get(F.col(b), F.lit(k)))
        for step in (4, 2, 1):
            x = x.bitwiseOR(F.shiftrightunsigned(x, step))
        total = total + F.bit_count(x.bitwiseAND(F.lit(LOWEST)))
    return total


def size_fits(a: Column, b: Column, percent: int) -> Column:
    return 100 * F.least(a, b) >= percent * F.greatest(a, b)


def _bit(column: str) -> Column:
    return F.pmod(F.xxhash64(column), F.lit(BITS)).alias("bit")


def shingle_sets(docs: DataFrame, wanted: DataFrame, shingle: int) -> DataFrame:
    """(node, shingles) of the sets named in ``wanted`` (node, doc_id), made again from those texts that a bit map of the doc_ids lets through."""
    shared = docs.sparkSession.sparkContext.broadcast(bit_map(wanted.select(_bit("doc_id")), BITS))

    def run(batches):
        for b in batches:
            b = b.filter(pa.array(bits_set(shared.value, b.column(0).to_numpy())))
            sets = [np.unique(shingle_hashes(t, shingle)).astype("<u8") for t in b.column(1).to_pylist()]
            nodes = [signed(xxhash.xxh64_intdigest(x.tobytes(), 42)) for x in sets]
            offsets = pa.array(np.concatenate(([0], np.cumsum([len(x) for x in sets]))).astype(np.int32))
            lists = pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(sets).view("<i8") if sets else np.zeros(0, "<i8")))
            yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), lists], names=["node", "shingles"])

    made = docs.where("doc_id is not null").select(_bit("doc_id"), "text").mapInArrow(run, "node long, shingles array<long>")
    return made.join(wanted.select("node"), "node", "left_semi").dropDuplicates(["node"])


def confirmed(pairs: DataFrame, docs: DataFrame, firsts: DataFrame, shingle: int, percent: int, name: str) -> DataFrame:
    """Those of ``pairs`` (a, b), already within the signature distance, whose whole sets are similar; a set in many pairs may stand in a only."""
    pairs = table(pairs.select("a", "b", F.pmod(F.xxhash64("b"), F.lit(SALTS)).alias("salt")), f"minhash-{name}-pairs")
    wanted = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct()
    wanted = table(firsts.select("node", "doc_id").join(wanted, "node", "left_semi"), f"minhash-{name}-wanted")
    sets = table(shingle_sets(docs, wanted, shingle), f"minhash-{name}-sets")
    left = pairs.select("a", "salt").distinct().join(sets.select(F.col("node").alias("a"), F.col("shingles").alias("sa")), "a")
    both = pairs.join(sets.select(F.col("node").alias("b"), F.col("shingles").alias("sb")), "b").join(left, ["a", "salt"])
    shared = F.size(F.array_intersect("sa", "sb")).cast("long")
    return table(both.where(100 * shared >= percent * (F.size("sa") + F.size("sb") - shared)).select("a", "b"), f"minhash-{name}-links")


def _near(pairs: DataFrame, firsts: DataFrame, percent: int, limit: int) -> DataFrame:
    """Those of ``pairs`` (a, b) whose sizes and signatures allow the similarity."""
    side = lambda x: firsts.select(F.col("node").alias(x), F.col("n").alias(f"n{x}"), F.col("sig").alias(f"s{x}"))
    both = pairs.join(side("b"), "b").join(side("a"), "a").where(size_fits(F.col("na"), F.col("nb"), percent))
    return both.where(differing("sa", "sb") <= limit).select("a", "b")


def _sharing(rows: DataFrame, firsts: DataFrame, percent: int, limit: int, enough) -> DataFrame:
    """Pairs (a, b) of ``rows`` (key, node, component, and what ``enough`` reads of two) that share a key and lie in different components, and whose sizes and signatures allow the similarity.

    Members outside a key's commonest component meet all in tiles of bounded size.
    """
    own = [c for c in rows.columns if c != "key"]
    sizes = rows.groupBy("key", "component").agg(F.count("*").alias("m")).groupBy("key").agg(F.max_by("component", F.struct("m", "component")).alias("main"), F.sum("m").alias("all"), F.max("m").alias("most")).where("all > most")
    rows = rows.join(sizes.select("key", "main", F.ceil((F.col("all") - F.col("most")) / TILE).cast("int").alias("xs"), F.ceil(F.col("all") / TILE).cast("int").alias("ys")), "key")
    rows = rows.join(firsts.select("node", "n", "sig"), "node").withColumn("out", F.col("component") != F.col("main"))
    tile = lambda n: F.pmod(F.xxhash64("node"), F.col(n)).cast("int")
    row = F.struct(*own, "out", "n", "sig")
    left = rows.where("out").select("key", tile("xs").alias("x"), F.explode(F.sequence(F.lit(0), F.col("ys") - 1)).alias("y"), row.alias("a"))
    right = rows.select("key", F.explode(F.sequence(F.lit(0), F.col("xs") - 1)).alias("x"), tile("ys").alias("y"), row.alias("b"))
    met = (F.col("a.component") != F.col("b.component")) & (~F.col("b.out") | (F.col("a.node") < F.col("b.node"))) & size_fits(F.col("a.n"), F.col("b.n"), percent)
    return left.join(right, ["key", "x", "y"]).where(met & enough & (differing("a.sig", "b.sig") <= limit)).select(F.col("a.node").alias("a"), F.col("b.node").alias("b"))


def crowded_pairs(members: DataFrame, docs: DataFrame, firsts: DataFrame, shingle: int, percent: int, limit: int) -> DataFrame:
    """Pairs (a, b) of ``members`` (node, component) in different components whose sizes and signatures allow the similarity, enough to connect all that are similar.

    A similar pair shares one of the first shingles of either in any order common to all sets: all but ceil(percent of the size), and one. In
    an order by how often a sample holds them, what makes a text unlike its fellows comes first, so a member of a crowd meets few others; and of a key far
    down in a set too little is left to be similar, unless they share an earlier one. Keys within one component go, the members of those of up to ``BUCKET`` meet.

    A larger key has a pivot, the member in most and largest keys, and each of its members only the shingles that it and the pivot do not share. Of two
    members the sets differ in as many shingles as these differences do from each other. So two that are similar share one of the first of them,
    or are both so near to the pivot that they are similar to it; those are tied to the pivot alone. What all of a crowd have in common makes no pairs.
    """
    wanted = table(firsts.select("node", "doc_id").join(members.select("node"), "node", "left_semi"), "minhash-crowd-wanted")
    sets = table(shingle_sets(docs, wanted, shingle), "minhash-crowd-sets")
    sample = sets.where(F.pmod(F.xxhash64("node", F.lit(3)), F.lit(RANK_SHARE)) == 0)
    common = sample.select(F.explode("shingles").alias("key")).groupBy("key").count().where("count > 1").orderBy(F.desc("count"), "key").limit(RANKS).collect()
    ranks = docs.sparkSession.sparkContext.broadcast(tuple(np.array(v, np.int64) for v in (zip(*sorted((r["key"], r["count"]) for r in common)) if common else ([], []))))

    def seen(own):
        known, times = ranks.value
        if not len(known):
            return np.zeros(len(own), np.int64)
        at = np.minimum(np.searchsorted(known, own), len(known) - 1)
        return np.where(known[at] == own, times[at], 0)

    def first(batches):
        for b in batches:
            nodes, keys, places = [], [], []
            for node, own in zip(b.column(0).to_pylist(), b.column(1)):
                own = own.values.to_numpy()
                n = len(own)
                own = own[np.lexsort((own, seen(own)))]
                keys.append(own[: n + (-percent * n) // 100 + 1])
                nodes.append(np.full(len(keys[-1]), node, np.int64))
                places.append(np.arange(len(keys[-1])))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x) if x else np.zeros(0, np.int64), pa.int64()) for x in (nodes, keys, places)], names=["node", "key", "place"])

    keyed_ = sets.select("node", "shingles").mapInArrow(first, "node long, key long, place long").join(members, "node")
    mixed = keyed_.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.count("*").alias("m")).where("lo != hi").select("key", "m")
    rows = table(keyed_.join(mixed, "key").join(firsts.select("node", F.col("n").alias("size")), "node"), "minhash-crowd-keys")
    small = rows.where(F.col("m") <= BUCKET).select("key", "node", "component", (F.col("size") - F.col("place")).alias("left"))
    enough = (100 + percent) * F.least(F.col("a.left"), F.col("b.left")) >= percent * (F.col("a.n") + F.col("b.n"))  # from the first key that they share on
    few = _sharing(small, firsts, percent, limit, enough)

    large = rows.where(F.col("m") > BUCKET).select("key", "node", "m")
    degrees = large.groupBy("node").agg(F.sum("m").alias("degree"))
    pivots = large.join(degrees, "node").groupBy("key").agg(F.max(F.struct("degree", "node"))["node"].alias("pivot"))
    spread = table(large.join(pivots, "key").select("node", "pivot").distinct().where("node != pivot").withColumn("salt", F.pmod(F.xxhash64("node"), F.lit(SALTS))), "minhash-crowd-pivots")
    held = spread.select("pivot", "salt").distinct().join(sets.select(F.col("node").alias("pivot"), F.col("shingles").alias("other")), "pivot")
    both = spread.join(sets, "node").join(held, ["pivot", "salt"]).select("node", "pivot", "shingles", "other")

    def unlike(batches):
        for b in batches:
            out = []
            for node, pivot, own, other in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), b.column(3)):
                own, other = own.values.to_numpy(), other.values.to_numpy()
                more, less = np.setdiff1d(own, other, assume_unique=True), np.setdiff1d(other, own, assume_unique=True)
                n, d = len(own), len(more) + len(less)
                near = (100 + percent) * d <= (100 - percent) * (n + len(other))
                most = (100 - percent) * (n + 100 * n // percent) // (100 + percent)  # shingles that any set similar to this one can differ in
                keys = np.concatenate((more, less))
                times = np.concatenate((seen(more), seen(other).max(initial=0) - seen(less)))  # about how many others differ so
                out.append((node, pivot, near, d, most // 2, keys[np.lexsort((keys, times))[: most + 1]]))
            columns = list(zip(*out)) if out else [()] * 6
            offsets = pa.array(np.concatenate(([0], np.cumsum([len(k) for k in columns[5]]))).astype(np.int32))
            lists = pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(columns[5]) if out else np.zeros(0, np.int64), pa.int64()))
            kinds = (pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([*[pa.array(c, k) for c, k in zip(columns, kinds)], lists], names=["node", "pivot", "near", "d", "half", "keys"])

    apart = both.mapInArrow(unlike, "node long, pivot long, near boolean, d long, half long, keys array<long>")
    apart = table(apart.join(members, "node").join(members.select(F.col("node").alias("pivot"), F.col("component").alias("home")), "pivot"), "minhash-crowd-apart")
    stars = apart.where("near and component != home").select(F.col("pivot").alias("a"), F.col("node").alias("b"))
    rows = apart.withColumn("component", F.when(F.col("near"), F.col("home")).otherwise(F.col("component"))).select("node", "component", "pivot", "d", "half", F.posexplode("keys").alias("place", "key"))
    rows = rows.select(F.xxhash64("pivot", "key").alias("key"), "node", "component", "d", (F.col("d") - F.col("place")).alias("left"), (F.col("place") <= F.col("half")).alias("early"))
    smaller = (F.col("b.d") < F.col("a.d")) | ((F.col("b.d") == F.col("a.d")) & (F.col("b.node") < F.col("a.node")))  # of two differences the smaller shares one of fewer
    alike = (100 + percent) * (F.col("a.d") + F.col("b.d") - 2 * F.least(F.col("a.left"), F.col("b.left"))) <= (100 - percent) * (F.col("a.n") + F.col("b.n"))
    many = _sharing(table(rows, "minhash-crowd-unlike"), firsts, percent, limit, F.when(smaller, F.col("b.early")).otherwise(F.col("a.early")) & alike)
    return few.union(stars).union(many).distinct()


def minhash_links(docs: DataFrame, firsts: DataFrame, shingle: int, percent: int) -> DataFrame:
    """(node, component) of those distinct sets that are linked to others: links of similar sets that connect all that are similar.

    Keys of up to ``BUCKET`` members give all their pairs. The members of a larger one first meet one of them: the one that shares most keys with
    others, as the text does that near copies were made of; each does so in its largest key and in one by hash. Keys whose members are then
    not all in one component go on to :func:`crowded_pairs`. So no pair is left out, and a group of near copies costs its members, not their pairs.
    """
    limit = most_different(percent)
    rows = keyed(firsts.where((100 - percent) * F.col("n") >= percent), limit)  # smaller sets are similar to none but themselves
    counts = table(rows.groupBy("key").agg(F.count("*").alias("m")).where("m > 1"), "minhash-keys")
    shared = docs.sparkSession.sparkContext.broadcast(bit_map(counts.select(_bit("key")), BITS))

    def passed(batches):
        for b in batches:
            yield b.select([0, 1, 2]).filter(pa.array(bits_set(shared.value, b.column(3).to_numpy())))

    through = rows.select("key", "node", "n", _bit("key")).mapInArrow(passed, "key long, node long, n long")
    many = table(through.join(counts, "key"), "minhash-rows")
    a, b = many.where(F.col("m") <= BUCKET).alias("a"), many.where(F.col("m") <= BUCKET).alias("b")
    sized = size_fits(F.col("a.n"), F.col("b.n"), percent)
    few = a.join(b, (F.col("a.key") == F.col("b.key")) & (F.col("a.node") < F.col("b.node")) & sized).select(F.col("a.node").alias("a"), F.col("b.node").alias("b"))
    crowd = many.where(F.col("m") > BUCKET)
    own = crowd.groupBy("node").agg(F.first("n").alias("n"), F.sum("m").alias("degree"), F.max(F.struct("m", "key"))["key"].alias("one"), F.max_by("key", F.struct(F.xxhash64("key"), "key")).alias("other"))
    own = table(own, "minhash-crowd")
    centres = crowd.select("key", "node").join(own.select("node", "degree", "n"), "node").groupBy("key").agg(F.max(F.struct("degree", "node", "n")).alias("c"))
    centres = table(centres.select("key", F.col("c.node").alias("a"), F.col("c.n").alias("na")), "minhash-centres")
    stars = own.select("node", "n", F.explode(F.array_distinct(F.array("one", "other"))).alias("key")).join(centres, "key").where((F.col("a") != F.col("node")) & size_fits(F.col("n"), F.col("na"), percent)).select("a", F.col("node").alias("b"))
    first = few.union(stars).distinct()
    links = confirmed(_near(first, firsts, percent, limit), docs, firsts, shingle, percent, "first")
    groups = connected_components(links)

    named = crowd.select("key", "node").join(groups, "node", "left").withColumn("component", F.coalesce("component", "node"))
    named = table(named, "minhash-named")
    mixed = named.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo != hi").select("key")
    members = table(named.join(mixed, "key").select("node", "component").distinct(), "minhash-members")
    pairs = table(crowded_pairs(members, docs, firsts, shingle, percent, limit), "minhash-left")
    if not pairs.limit(1).count():
        return groups
    more = confirmed(pairs, docs, firsts, shingle, percent, "left")
    of = lambda x: members.select(F.col("node").alias(x), F.col("component").alias(f"c{x}"))
    joined = connected_components(more.join(of("a"), "a").join(of("b"), "b").select(F.col("ca").alias("a"), F.col("cb").alias("b")))
    joined = table(joined.select(F.col("node").alias("component"), F.col("component").alias("whole")), "minhash-joined")
    every = groups.union(joined.select("component", "component")).distinct()  # a set that was alone is its own component
    return every.join(joined, "component", "left").select("node", F.coalesce("whole", "component").alias("component"))


def minhash_groups(docs: DataFrame, shingle: int = 5, percent: int = 85, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of every document row; component_id is the smallest doc_id reachable over links.

    Documents link when their sets of ``shingle``-word shingles (a shorter text is one shingle) have ``percent`` per cent of their
    union in common. Shingles are compared by 64-bit hashes; of pairs exactly at the threshold one in 10**9 has a signature
    too far apart. Equal sets are collapsed first. Null and empty texts and texts without words have no set and link with nothing; an empty
    table gives none; rows that share a doc_id are each returned, in one component if they link; a null doc_id is returned and
    takes no part in the minimum; further columns are ignored; a very long text is one row of its whole set.
    """
    short_batches(docs.sparkSession)
    docs = columns_of(docs, id_col, text_col).select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    found = table(signatures(docs, shingle), "minhash-signatures")
    firsts = table(found.where("n > 0").groupBy("node").agg(F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "n", "sig")).alias("f")).select("node", "f.doc_id", "f.n", "f.sig"), "minhash-firsts")
    groups = minhash_links(docs, firsts, shingle, percent)
    named = table(firsts.select("node", "doc_id").join(groups, "node", "left").withColumn("component", F.coalesce("component", "node")), "minhash-components")
    least = named.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    named = table(named.join(least, "component").select("node", "component_id"), "minhash-groups")
    grouped = found.where("n > 0").join(named, "node").select("doc_id", "n", "component_id")
    every = grouped.union(found.where("n = 0").select("doc_id", "n", F.col("doc_id").alias("component_id")))
    return every.select("doc_id", F.col("n").alias("n_shingles"), "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)).alias("kept"))


def op12_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash_groups(read(spark, sf_dir, "documents"))


OP12_SQL = r"""
WITH RECURSIVE doc AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
gram AS (SELECT DISTINCT doc_id, array_to_string(w[i : i + m - 1], ' ') AS g FROM (SELECT *, unnest(range(1, len(w) - m + 2)) AS i FROM (SELECT *, least(5, len(w)) AS m FROM doc WHERE len(w) > 0))),
sized AS (SELECT doc_id, count(*) AS n FROM gram GROUP BY doc_id),
met AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS s FROM gram a JOIN gram b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
link AS (SELECT x, y FROM met JOIN sized p ON p.doc_id = x JOIN sized q ON q.doc_id = y WHERE 100 * s >= 85 * (p.n + q.n - s)),
way AS (SELECT x, y FROM link UNION ALL SELECT y, x FROM link),
reach AS (SELECT doc_id, doc_id AS root FROM documents UNION SELECT w.y, r.root FROM reach r JOIN way w ON w.x = r.doc_id WHERE r.root < w.y),
least_root AS (SELECT doc_id, min(root) AS component_id FROM reach GROUP BY doc_id)
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, component_id, d.doc_id = component_id AS kept FROM doc d JOIN least_root USING (doc_id) LEFT JOIN sized USING (doc_id)
"""
