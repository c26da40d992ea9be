"""SimHash near-dedup by the generalised pigeonhole principle.

Fingerprint bits that vary together are grouped into partitions; a dynamic program over estimated
candidate counts gives each partition its own threshold t_i (-1: not probed) with
sum(t_i) = max_bits - partitions + 1, so any two fingerprints within ``max_bits`` bits agree within
t_i bits in some partition i. Fingerprints are indexed by partition value, probed by every value in
the threshold's ball, and verified on all 64 bits.
"""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import byte_words, columns_of, connected_components, flips, read, short_batches, signed, table, unused

#: A bucket of more members than this is not paired; it is dealt out again by finer keys, which make about ``DEALT`` rows a member at most.
BUCKET, DEALT = 24, 93


def fingerprint(text: str | None, shingle: int = 3) -> int:
    """Unsigned 64-bit fingerprint: a bit is set if it is set in over half of the shingles' XXH64 (seed 42)."""
    raw = byte_words(text)
    if not raw:
        return 0
    joined = b" ".join(raw)
    if len(raw) <= shingle:
        hashes = [xxhash.xxh64_intdigest(joined, 42)]
    else:
        ends = np.cumsum([len(w) + 1 for w in raw]) - 1
        starts = np.concatenate(([0], ends[:-1] + 1))
        digest = xxhash.xxh64_intdigest
        hashes = [digest(joined[a:b], 42) for a, b in zip(starts[: len(raw) - shingle + 1].tolist(), ends[shingle - 1 :].tolist())]
    grid = np.array(hashes, dtype="<u8").view(np.uint8).reshape(-1, 8)
    ones = np.zeros(64, dtype=np.int64)
    for at in range(0, len(grid), 4096):  # bounds the unpacked bits of a very long text
        ones += np.unpackbits(grid[at : at + 4096], axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, shingle: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp): one pass over whole texts, no shuffle. A null or empty text has fingerprint 0."""
    short_batches(docs.sparkSession)

    def run(batches):
        for b in batches:
            fps = [signed(fingerprint(t, shingle)) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps, pa.int64())], names=["doc_id", "fp"])

    return columns_of(docs, id_col, text_col).withColumnRenamed(id_col, "doc_id").select(F.col("doc_id").cast("long"), text_col).mapInArrow(run, "doc_id long, fp long")


def bit_statistics(fps: DataFrame) -> tuple[int, np.ndarray]:
    """How often each pair of bits is set together, over all rows: a 64 x 64 matrix summed on the executors."""

    def run(batches):
        total, n = np.zeros((64, 64)), 0
        for b in batches:
            grid = b.column(0).to_numpy().astype("<i8").view(np.uint8).reshape(-1, 8)
            bits = np.unpackbits(grid, axis=1, bitorder="little").astype(np.float32)
            total += bits.T @ bits
            n += len(bits)
        if n:
            rows = np.hstack([np.full((64, 1), n), total]).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(range(64), pa.int32()), *[pa.array(c) for c in rows.T]], names=["i", "n", *[f"c{k}" for k in range(64)]])

    cols = ["n", *[f"c{k}" for k in range(64)]]
    sums = fps.select("fp").mapInArrow(run, "i int, " + ", ".join(f"{c} long" for c in cols)).groupBy("i").agg(*[F.sum(c).alias(c) for c in cols]).collect()
    together = np.zeros((64, 64))
    for r in sums:
        together[r["i"]] = [r[f"c{k}"] for k in range(64)]
    return (sums[0]["n"] if sums else 0), together


def group_bits(n: int, together: np.ndarray, parts: int) -> list[int]:
    """``parts`` bit masks of even size; each starts from the most correlated free bit and takes its closest bits."""
    p = np.diag(together) / max(n, 1)
    spread = np.sqrt(np.maximum(p * (1 - p), 1e-9))
    corr = np.abs((together / max(n, 1) - np.outer(p, p)) / np.outer(spread, spread))
    np.fill_diagonal(corr, 0)
    free, masks = set(range(64)), []
    for k in range(parts):
        size = (64 - sum(bin(m).count("1") for m in masks)) // (parts - k)
        own = [max(free, key=lambda b: (sum(corr[b][c] for c in free), -b))]
        free.discard(own[0])
        while len(own) < size:
            best = max(free, key=lambda b: (sum(corr[b][c] for c in own), -b))
            own.append(best)
            free.discard(best)
        masks.append(sum(1 << b for b in own))
    return masks


def allocate(cost: list[list[float]], total: int) -> tuple[float, list[int]]:
    """Thresholds of at least -1 per partition that sum to ``total`` at least cost; cost[i][t + 1] is that of t in partition i."""
    best: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
    for options in cost:
        nxt: dict[int, tuple[float, list[int]]] = {}
        for s, (c, ts) in best.items():
            for t, own in enumerate(options, -1):
                if s + t not in nxt or c + own < nxt[s + t][0]:
                    nxt[s + t] = (c + own, [*ts, t])
        best = nxt
    return best[total]


def plan(fps: DataFrame, max_bits: int, sample: int = 2048) -> list[tuple[int, int]]:
    """[(mask, threshold)] of the probed partitions.

    Bit correlations come from all fingerprints; the candidate estimate of a (partition, threshold)
    is the mean number of fingerprints within that threshold there, by a bounded sample (``sample``
    fingerprints in hash order) or by chance if that is more, plus one for each value probed. Crowded
    buckets are dealt again and not paired, so no fingerprint counts for more than ``DEALT``: a large group
    of near copies, crowded in every partition, does not make few partitions of many probes look cheap.
    """
    n, together = bit_statistics(fps)
    some = np.array([r[0] for r in fps.select("fp").orderBy(F.xxhash64("fp"), "fp").limit(sample).collect()], dtype=np.int64).astype(np.uint64)
    odds, choice = np.diag(together) / max(n, 1), None
    for parts in range(2, max_bits + 3):
        masks, cost = group_bits(n, together, parts), []
        for mask in masks:
            values = some & np.uint64(mask)
            seen = np.zeros((max(1, len(values)), max_bits + 2))
            for at, v in enumerate(values):
                seen[at] = np.bincount(np.minimum(np.bitwise_count(values ^ v), max_bits + 1), minlength=max_bits + 2)
            met = n * np.maximum(np.cumsum(seen, axis=1)[:, : max_bits + 1] - 1, 0) / max(1, len(values) - 1)
            chance = np.ones(1)
            for q in (2 * odds * (1 - odds))[[b for b in range(64) if mask >> b & 1]]:
                chance = np.convolve(chance, [1 - q, q])
            chance = np.concatenate((chance, np.zeros(max_bits + 1)))  # a partition may have fewer bits
            near = np.maximum(np.minimum(met, DEALT).mean(axis=0), np.minimum(n * np.cumsum(chance)[: max_bits + 1], DEALT))
            cost.append([0.0, *[1 + len(flips(mask, t)) + near[t] for t in range(max_bits + 1)]])
        spent, ts = allocate(cost, max_bits - parts + 1)
        if choice is None or spent < choice[0]:
            choice = (spent, [(m, t) for m, t in zip(masks, ts) if t >= 0])
    return choice[1]


def _pairs(rows: DataFrame, max_bits: int) -> DataFrame:
    """Verified links inside the buckets (part, key) of ``rows``; probes (kind 1) meet indexed rows only."""
    a, b = rows.alias("a"), rows.where("kind = 0").alias("b")
    return a.join(b, (F.col("a.part") == F.col("b.part")) & (F.col("a.key") == F.col("b.key")) & (F.col("a.fp") != F.col("b.fp"))
                  & ((F.col("a.kind") == 1) | (F.col("a.fp") < F.col("b.fp"))) & (F.bit_count(F.col("a.fp").bitwiseXOR(F.col("b.fp"))) <= max_bits)
                  ).select(F.col("a.rep").alias("a"), F.col("b.rep").alias("b"))


def _buckets(reps: DataFrame, keys: list[tuple[int, int, int, int]]) -> DataFrame:
    """A row for each (part, mask, flip, kind) of ``keys``, with the size of its bucket; single members drop."""
    made = F.explode(F.array(*[F.struct(F.lit(p).alias("part"), F.col("fp").bitwiseXOR(F.lit(signed(f))).bitwiseAND(F.lit(signed(m))).alias("key"), F.lit(k).alias("kind")) for p, m, f, k in keys]))
    rows = reps.select("fp", "rep", made.alias("s")).select("fp", "rep", "s.*")
    sizes = rows.groupBy("part", "key").agg(F.count("*").alias("n")).where("n > 1")
    return rows.join(table(sizes, "simhash-sizes"), ["part", "key"])


def links(reps: DataFrame, max_bits: int = 2) -> DataFrame:
    """Links (a, b) over distinct fingerprints (fp, rep) that connect exactly those within ``max_bits`` bits.

    Small buckets give their verified pairs. The members of larger ones (a group of near copies) are
    dealt out again by finer keys, all of 8-bit pieces but ``max_bits`` of them; what is still
    crowded is tied through common neighbours: two fingerprints within 2 bits share a value at most
    one bit from either, so the rows stay in proportion to the members and no pair is lost. For
    other ``max_bits`` the finer keys are paired whole.
    """
    keys = []
    for part, (mask, t) in enumerate(plan(reps, max_bits)):
        keys += [(part, mask, 0, 0)] + [(part, mask, f, 1) for f in flips(mask, t) if f]
    rows = table(_buckets(reps, keys), "simhash-buckets")
    out = _pairs(rows.where(F.col("n") <= BUCKET), max_bits)
    hot = rows.where(F.col("n") > BUCKET).select("fp", "rep").distinct()
    pieces = [0xFF << (8 * i) for i in range(8)]
    whole = (1 << 64) - 1
    finer = [(i, whole ^ sum(c), 0, 0) for i, c in enumerate(itertools.combinations(pieces, max_bits))]
    again = table(_buckets(hot, finer), "simhash-finer")
    if max_bits != 2:
        return out.union(_pairs(again, max_bits))
    out = out.union(_pairs(again.where(F.col("n") <= BUCKET), max_bits))
    crowded = again.where(F.col("n") > BUCKET).select("fp", "rep").distinct()
    near = F.explode(F.array(*[F.col("fp").bitwiseXOR(F.lit(signed(f))) for f in flips(whole, 1)]))
    rays = crowded.select("rep", near.alias("key"))
    centres = table(rays.groupBy("key").agg(F.min("rep").alias("a"), F.count("*").alias("n")).where("n > 1").select("key", "a"), "simhash-centres")
    return out.union(rays.join(centres, "key").where("a != rep").select("a", F.col("rep").alias("b")))


def simhash_groups(docs: DataFrame, shingle: int = 3, max_bits: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp, component_id) of every document; component_id is the smallest doc_id reachable over links.

    Documents link when their fingerprints differ in ``max_bits`` bits or fewer. Equal fingerprints
    are collapsed first, so thousands of exact copies cost one row. Null and empty texts have
    fingerprint 0 and link like any other; an empty table gives an empty result; further columns
    are ignored; rows that share a doc_id are each returned, in one component if they link.
    """
    fps = table(fingerprints(docs, shingle, id_col, text_col), "simhash-fps")
    reps = table(fps.groupBy("fp").agg(F.min("doc_id").alias("rep")), "simhash-reps")
    groups = connected_components(links(reps, max_bits)).select(F.col("node").alias("rep"), "component")
    named = reps.join(groups, "rep", "left").select(F.col("fp"), F.coalesce("component", "rep").alias("component_id"))
    return fps.join(table(named, "simhash-groups"), "fp").select("doc_id", "fp", "component_id")


def op1_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = simhash_groups(read(spark, sf_dir, "documents"))
    return groups.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


#: 64-bit words of a wide fingerprint; members of a key up to which they are paired; rows of a tile of a crowded key; one set in so many is counted
#: to rank shingles, and so many ranks are kept; bits of the map that lets wanted documents through; shingles from which fingerprints are compared first.
WIDE, TILE, RANK_SHARE, RANKS, BITS, COMPARED = 6, 512, 16, 100_000, 1 << 24, 64


def shingle_hashes(text: str | None, shingle: int) -> np.ndarray:
    """XXH64 (seed 42) of each shingle in order of place, as uint64; a text of fewer words is one shingle, one without words has none."""
    raw = byte_words(text)
    if not raw:
        return np.zeros(0, dtype=np.uint64)
    joined = b" ".join(raw)
    ends = np.cumsum([len(w) + 1 for w in raw]) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    size = min(shingle, len(raw))
    digest = xxhash.xxh64_intdigest
    return np.array([digest(joined[a:b], 42) for a, b in zip(starts[: len(raw) - size + 1].tolist(), ends[size - 1 :].tolist())], dtype=np.uint64)


def wide_fingerprint(hashes: np.ndarray, words: int = WIDE) -> np.ndarray:
    """``words`` 64-bit words: the bits set in over half of the hashes, each word under another mixing of them."""
    out = np.zeros(words, dtype="<u8")
    for k in range(words if len(hashes) else 0):
        ones = np.zeros(64, dtype=np.int64)
        for at in range(0, len(hashes), 4096):
            h = hashes[at : at + 4096] + np.uint64(k * 0x9E3779B97F4A7C15 & (2**64 - 1))
            h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
            h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
            h ^= h >> np.uint64(31)
            ones += np.unpackbits(h.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        out[k] = np.packbits(ones * 2 > len(hashes), bitorder="little").view("<u8")[0]
    return out.view("<i8")


def most_bits(similarity: float, words: int = WIDE) -> int:
    """Differing bits of a wide fingerprint that sets of ``similarity`` or more stay within: six deviations above the mean."""
    p = np.arccos(2 * similarity / (1 + similarity)) / np.pi
    return int(np.ceil(64 * words * p + 6 * np.sqrt(64 * words * p * (1 - p))))


def shingle_sets(docs: DataFrame, shingle: int, keep: np.ndarray | None = None) -> DataFrame:
    """(doc_id, node, shingles, wide) of docs (doc_id, text): the ascending distinct shingle hashes of each row, and a 64-bit hash that names the set.

    With ``keep``, a bit map, only of rows whose hashed doc_id is in it, and with their wide fingerprints.
    """
    shared = docs.sparkSession.sparkContext.broadcast(keep)

    def run(batches):
        for b in batches:
            if shared.value is not None:
                at = b.column(2).to_numpy()
                b = b.filter(pa.array((shared.value[at >> 5] >> (at & 31).astype(np.uint32) & np.uint32(1)).astype(bool)))
            sets = [np.unique(shingle_hashes(t, shingle).astype("<u8").view("<i8")) for t in b.column(1).to_pylist()]
            nodes = [signed(xxhash.xxh64_intdigest(x.tobytes(), 42)) for x in sets]
            offsets = pa.array(np.concatenate(([0], np.cumsum([len(x) for x in sets]))).astype(np.int32))
            own = pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(sets) if sets else np.zeros(0, "<i8"), pa.int64()))
            wide = pa.array([wide_fingerprint(x.view("<u8")) if shared.value is not None else None for x in sets], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(nodes, pa.int64()), own, wide], names=["doc_id", "node", "shingles", "wide"])

    return docs.select("doc_id", "text", _bit("doc_id").alias("bit")).mapInArrow(run, "doc_id long, node long, shingles array<long>, wide array<long>")


def _bit(col: str):
    return F.pmod(F.xxhash64(col, F.lit(5)), F.lit(BITS))


def prefix_keys(docs: DataFrame, shingle: int, similarity: float) -> DataFrame:
    """(doc_id, node, size, fp, keys): the 64-bit fingerprint of a set, and its shingles in one order for all sets, as far as any set of Jaccard ``similarity`` must share one.

    Sets that similar share ceil(similarity * size) shingles at least, so one of the first size - ceil(similarity * size) + 1
    of either. Any order gives all pairs; shingles that recur in a sample of the sets come last here, so the keys are rare ones.
    """
    sample = shingle_sets(docs.where(F.pmod(F.xxhash64("doc_id", F.lit(3)), F.lit(RANK_SHARE)) == 0), shingle)
    common = sample.select(F.explode("shingles").alias("key")).groupBy("key").count().where("count > 2").orderBy(F.desc("count"), "key").limit(RANKS).collect()
    common = sorted((r["key"], r["count"]) for r in common)
    known, times = (np.array([r[k] for r in common], dtype=np.int64) for k in (0, 1))

    def run(batches):
        for b in batches:
            heads, sizes, fps = [], [], []
            for own in b.column(2):
                own = own.values.to_numpy()
                n = len(own)
                sizes.append(n)
                fps.append(wide_fingerprint(own.view("<u8"), 1)[0])
                if len(known) and n:
                    at = np.minimum(np.searchsorted(known, own), len(known) - 1)
                    own = own[np.lexsort((own, np.where(known[at] == own, times[at], 0)))]
                heads.append(own[: n - int(np.ceil(similarity * n - 1e-9)) + 1])
            offsets = pa.array(np.concatenate(([0], np.cumsum([len(x) for x in heads]))).astype(np.int32))
            keys = pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(heads) if heads else np.zeros(0, "<i8"), pa.int64()))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(sizes, pa.int32()), pa.array(fps, pa.int64()), keys], names=["doc_id", "node", "size", "fp", "keys"])

    return shingle_sets(docs, shingle).mapInArrow(run, "doc_id long, node long, size int, fp long, keys array<long>")


def _similar(pairs: DataFrame, docs: DataFrame, firsts: DataFrame, shingle: int, similarity: float, name: str) -> DataFrame:
    """Those of ``pairs`` (a, b) of nodes whose sets have Jaccard ``similarity`` or more; a node in many pairs may stand in a only.

    Sets are made again from the texts: of those documents that a bit map of the wanted ones lets through. Pairs whose SimHash fingerprints are
    further apart than similar sets ever are go first, so that only sets that are likely similar are sent to each other.
    """
    wanted = pairs.select("a").union(pairs.select("b")).distinct().withColumnRenamed("a", "node")
    wanted = table(wanted.join(firsts.select("node", "doc_id"), "node"), f"{name}-wanted")
    bits = wanted.select(_bit("doc_id").alias("bit")).groupBy(F.shiftright("bit", 5).alias("at")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), F.col("bit").bitwiseAND(F.lit(31)).cast("int"))).alias("word")).collect()
    keep = np.zeros(BITS >> 5, dtype=np.uint32)
    for r in bits:
        keep[r["at"]] = r["word"]
    sets = table(shingle_sets(docs, shingle, keep), f"{name}-sets")
    side = lambda x: sets.select(F.col("node").alias(x), F.col("wide").alias(f"w{x}"), F.size("shingles").alias(f"n{x}")).dropDuplicates([x])
    apart = sum((F.bit_count(F.get("wa", F.lit(k)).bitwiseXOR(F.get("wb", F.lit(k)))) for k in range(1, WIDE)), F.bit_count(F.get("wa", F.lit(0)).bitwiseXOR(F.get("wb", F.lit(0)))))
    close = pairs.join(side("b"), "b").join(side("a"), "a").where((F.least("na", "nb") < COMPARED) | (apart <= most_bits(similarity)))
    close = table(close.select("a", "b", F.pmod(F.xxhash64("b"), F.lit(16)).alias("salt")), f"{name}-close")
    own = sets.select("node", "shingles").join(close.select("a").union(close.select("b")).distinct().withColumnRenamed("a", "node"), "node", "left_semi").dropDuplicates(["node"])
    own = table(own, f"{name}-own")
    left = close.select("a", "salt").distinct().join(own.select(F.col("node").alias("a"), F.col("shingles").alias("sa")), "a")
    both = close.join(own.select(F.col("node").alias("b"), F.col("shingles").alias("sb")), "b").join(left, ["a", "salt"])
    shared = F.size(F.array_intersect("sa", "sb"))
    return table(both.where(shared / (F.size("sa") + F.size("sb") - shared) >= similarity).select("a", "b"), f"{name}-links")


def _possible(similarity: float):
    """Whether rows a and b of one key may be similar by their sizes, this being the first key they share."""
    a, b = (F.col(f"{x}.size") for x in "ab")
    least, most = F.least(a, b), F.greatest(a, b)
    left = F.least(a - F.col("a.pos"), b - F.col("b.pos"))
    return (least >= F.ceil(similarity * most - 1e-9)) & (left >= F.ceil(similarity / (1 + similarity) * (a + b) - 1e-9))


def near_duplicate_groups(docs: DataFrame, shingle: int = 5, similarity: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, component_id): documents whose sets of ``shingle``-word shingles have Jaccard ``similarity`` or more link; component_id is the smallest doc_id reachable.

    Every such pair is found and no other links (but for clashes of 64-bit hashes, and one pair in 10**9 at the threshold whose fingerprints are
    six deviations too far apart). Equal sets are collapsed first. Candidates come by the generalised pigeonhole principle from 64-bit SimHash
    fingerprints within two bits (:func:`links`) and are verified on the whole sets. Similar sets may differ in more bits than any partition
    can find, so those not in one component yet go on by an exact way: they share a key of :func:`prefix_keys`, are compared by wide
    fingerprints, and verified likewise. The members of a key of more than ``BUCKET`` meet three of them; after that only members
    still in different components are paired, in tiles of bounded size. Texts without words link; an empty table gives an
    empty result; rows that share a doc_id are each returned; a very long text is one row of its whole set.
    """
    short_batches(docs.sparkSession)
    docs = columns_of(docs, id_col, text_col).select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    heads = table(prefix_keys(docs, shingle, similarity), "near-heads")
    firsts = table(heads.groupBy("node").agg(F.min(F.struct("doc_id", "size", "fp", "keys")).alias("f")).select("node", "f.*"), "near-firsts")
    reps = table(firsts.groupBy("fp").agg(F.min("node").alias("rep")), "near-reps")
    alike = firsts.select("node", "fp").join(reps, "fp").where("node != rep").select(F.col("rep").alias("a"), F.col("node").alias("b"))
    holes = table(links(reps).union(alike).distinct(), "pigeonhole-pairs")
    holed = table(connected_components(_similar(holes, docs, firsts, shingle, similarity, "pigeonhole")), "pigeonhole-components")

    keyed = firsts.select("node", "size", F.posexplode("keys").alias("pos", "key"))
    shared = table(keyed.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"), "near-shared")
    rows = table(keyed.join(shared, "key").join(holed, "node", "left").withColumn("component", F.coalesce("component", "node")), "near-keys")
    row = F.struct("node", "size", "pos", "component")
    apart = F.col("a.component") != F.col("b.component")
    a, b = rows.where(F.col("n") <= BUCKET).alias("a"), rows.where(F.col("n") <= BUCKET).alias("b")
    few = a.join(b, (F.col("a.key") == F.col("b.key")) & (F.col("a.node") < F.col("b.node")) & apart & _possible(similarity)).select(F.col("a.node").alias("a"), F.col("b.node").alias("b"))
    crowd = rows.where(F.col("n") > BUCKET)
    centres = crowd.groupBy("key").agg(F.array_distinct(F.array(F.min(row), F.max(row), F.min_by(row, F.xxhash64("node")))).alias("centres"))
    stars = crowd.join(table(centres, "near-centres"), "key").select(row.alias("b"), F.explode("centres").alias("a")).where(apart & _possible(similarity))
    first = table(few.union(stars.select(F.col("a.node").alias("a"), F.col("b.node").alias("b"))).distinct(), "near-first")
    more = _similar(first, docs, firsts, shingle, similarity, "near")
    found = connected_components(holed.select(F.col("node").alias("a"), F.col("component").alias("b")).union(more))

    rest = crowd.drop("component").join(found, "node", "left").withColumn("component", F.coalesce("component", "node"))
    mixed = table(rest.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo != hi").select("key"), "near-mixed")
    rest = rest.join(mixed, "key").withColumn("tiles", F.ceil(F.col("n") / TILE).cast("int")).withColumn("tile", F.pmod(F.xxhash64("node"), F.col("tiles")).cast("int"))
    rest = rest.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1))).select("key", F.least("tile", "other").alias("x"), F.greatest("tile", "other").alias("y"), "node", "size", "pos", "component")
    rest = table(rest, "near-rest")
    a, b = rest.alias("a"), rest.alias("b")
    same = (F.col("a.key") == F.col("b.key")) & (F.col("a.x") == F.col("b.x")) & (F.col("a.y") == F.col("b.y"))
    pairs = a.join(b, same & apart & (F.col("a.node") < F.col("b.node")) & _possible(similarity)).select(F.col("a.node").alias("a"), F.col("b.node").alias("b"))
    met = first.union(holes).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    pairs = table(pairs.distinct().join(met, ["a", "b"], "left_anti"), "near-pairs")
    if pairs.limit(1).count():
        more = _similar(pairs, docs, firsts, shingle, similarity, "rest")
        found = connected_components(found.select(F.col("node").alias("a"), F.col("component").alias("b")).union(more))
    named = table(firsts.select("node", "doc_id").join(found, "node", "left").withColumn("component", F.coalesce("component", "node")), "near-named")
    least = named.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    return heads.select("doc_id", "node").join(table(named.join(least, "component").select("node", "component_id"), "near-groups"), "node").select("doc_id", "component_id")


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", **options) -> DataFrame:
    """``docs`` without the documents whose group has a smaller doc_id; all columns stay, whatever their names."""
    gone = near_duplicate_groups(docs, id_col=id_col, **options).where("doc_id != component_id").select(F.struct("doc_id").alias("gone")).distinct()
    name = unused(docs, "gone")
    gone = table(gone, "near-gone").withColumnRenamed("gone", name)
    return docs.join(gone, F.col(f"`{id_col}`").cast("long") == F.col(f"{name}.doc_id"), "left_anti")
