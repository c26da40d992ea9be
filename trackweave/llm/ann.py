"""Approximate nearest neighbours by a hierarchical k-means tree.

The tree is fitted on a bounded sample; every row is filed under its leaf. A query walks the tree
best bin first through a priority queue and visits leaves in that order; the number of leaves is
widened until the true neighbours of calibration queries, found by brute force over all rows, lie in the
leaves visited as often as the wanted recall asks. Queries go to the leaves; rows stay where they are filed.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import first_in_hash_order, read, short_batches, table

SAMPLE_ROWS, BRANCHING, LEAF_ROWS, CALIBRATION_QUERIES = 16_384, 16, 32, 256
#: Rows of a bin of neighbouring leaves that a group holds in memory, queries that stream past them, and queries walked at a time; a larger
#: leaf and more queries are dealt over several groups.
GROUP_ROWS, GROUP_QUERIES, WALKED = 4_096, 65_536, 64


@dataclass
class Node:
    centre: np.ndarray
    children: list[Node] = field(default_factory=list)
    leaf: int = -1


@dataclass
class Tree:
    root: Node
    leaves: int

    def file(self, x: np.ndarray) -> np.ndarray:
        """Leaf of every row of unit vectors: at each node the child of the largest inner product, the first of equals."""
        out = np.zeros(len(x), dtype=np.int32)
        todo = [(self.root, np.arange(len(x)))]
        while todo:
            node, rows = todo.pop()
            if node.leaf >= 0:
                out[rows] = node.leaf
            elif len(rows):
                near = np.argmax(x[rows] @ np.stack([c.centre for c in node.children]).T, axis=1)
                todo += [(c, rows[near == k]) for k, c in enumerate(node.children)]
        return out

    def walk(self, q: np.ndarray, leaves: int, sizes: dict[int, int] | None = None, least: int = 0) -> list[int]:
        """The first ``leaves`` leaves, best bin first, and further ones until they hold ``least`` rows by ``sizes``."""
        queue, found, turn, held = [(0.0, 0, self.root)], [], 1, 0
        while queue and (len(found) < leaves or held < least):
            _, _, node = heapq.heappop(queue)
            while node.leaf < 0:
                scores = [float(c.centre @ q) for c in node.children]
                best = int(np.argmax(scores))
                for k, c in enumerate(node.children):
                    if k != best:
                        heapq.heappush(queue, (-scores[k], turn, c))
                        turn += 1
                node = node.children[best]
            found.append(node.leaf)
            held += sizes.get(node.leaf, 0) if sizes else 0
        return found


def fit_tree(x: np.ndarray, branching: int = BRANCHING, leaf_rows: int = LEAF_ROWS, seed: int = 42, rounds: int = 8) -> Tree:
    """Spherical k-means, split again until a node has at most ``leaf_rows`` sample rows or its rows are all alike."""
    rng, count = np.random.default_rng(seed), 0

    def grow(rows: np.ndarray) -> Node:
        nonlocal count
        centre = rows.mean(axis=0) if len(rows) else np.zeros(x.shape[1] if x.ndim == 2 else 0)
        different = np.unique(rows, axis=0) if len(rows) > leaf_rows else rows[:0]
        if len(different) < 2:
            count += 1
            return Node(centre, leaf=count - 1)
        centres = different[rng.permutation(len(different))[:branching]]
        for _ in range(rounds):
            near = np.argmax(rows @ centres.T, axis=1)
            sums = np.zeros_like(centres)
            np.add.at(sums, near, rows)
            norms = np.linalg.norm(sums, axis=1, keepdims=True)
            centres = np.where(norms > 0, sums / np.where(norms > 0, norms, 1), centres)
        near = np.argmax(rows @ centres.T, axis=1)
        parts = [(centres[k], rows[near == k]) for k in range(len(centres)) if (near == k).any()]
        if len(parts) < 2:
            count += 1
            return Node(centre, leaf=count - 1)
        node = Node(centre)
        for c, part in parts:
            child = grow(part)
            child.centre = c
            node.children.append(child)
        return node

    root = grow(x)
    return Tree(root, count)


def usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(vec_id, v): rows that take part; null, empty and zero vectors, those with a null or non-finite component, and those of
    another length than the most common one (of equals the smaller) do not."""
    v = F.col(f"`{vector_col}`").cast("array<double>")
    rows = vectors.select(F.col(f"`{id_col}`").cast("long").alias("vec_id"), v.alias("v"))
    fine = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))) & F.exists("v", lambda x: x != 0)
    rows = rows.where(F.col("vec_id").isNotNull() & F.col("v").isNotNull() & F.coalesce(fine, F.lit(False)))
    common = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").first()
    return rows.where(F.size("v") == (common["d"] if common else 0))


def _matrix(column: pd.Series) -> np.ndarray:
    return np.stack(column.to_numpy()).astype(np.float64) if len(column) else np.zeros((0, 0))


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.linalg.norm(x / np.abs(x).max(axis=1, keepdims=True), axis=1, keepdims=True) / np.abs(x).max(axis=1, keepdims=True)


def nearest(queries: np.ndarray, query_ids: np.ndarray, rows: np.ndarray, ids: np.ndarray, k: int, leaves: np.ndarray | None = None, visited=None, block: int = 256) -> pd.DataFrame:
    """The k rows of largest cosine for each query, in double precision over the original vectors, a query's own id left out;
    with the rows' ``leaves``, of those in the leaves that the query has ``visited``.

    Matrix products name the rows that could be among them; those rows' sums run along one row at a time, so equal
    vectors have equal scores wherever they stand.
    """
    norms, out = np.sqrt((rows * rows).sum(axis=1)), []
    order = np.argsort(ids, kind="stable")
    rows, ids, norms = rows[order], ids[order], norms[order]
    kinds, leaf = np.unique(leaves[order], return_inverse=True) if leaves is not None else (None, None)
    scaled = rows / norms[:, None]
    for at in range(0, len(queries), block):
        some = queries[at : at + block]
        lengths = np.sqrt((some * some).sum(axis=1))
        about = (some / lengths[:, None]) @ scaled.T
        about[ids[None, :] == query_ids[at : at + block, None]] = -np.inf
        if kinds is not None:
            open_ = np.stack([np.isin(kinds, v) for v in visited[at : at + block]])
            about[~open_[:, leaf]] = -np.inf
        least = np.partition(about, -k, axis=1)[:, -k] if about.shape[1] > k else np.full(len(some), -2.0)
        for q, own, length, row, low in zip(some, query_ids[at : at + block], lengths, about, least):
            near = np.flatnonzero((row >= low - 1e-9) & (row > -np.inf))
            scores = (rows[near] * q).sum(axis=1) / (norms[near] * length)
            best = np.argsort(-scores, kind="stable")[:k]
            out.append((np.full(len(best), own), ids[near[best]], scores[best]))
    cols = [np.concatenate(c) for c in zip(*out)] if out else [ids[:0], ids[:0], norms[:0]]
    return pd.DataFrame(dict(zip(("query_id", "vec_id", "score"), cols)))


def _best(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


FOUND = "query_id long, vec_id long, score double"


def brute_force(rows: DataFrame, queries: pd.DataFrame, k: int) -> DataFrame:
    """Exact neighbours of a bounded set of queries (vec_id, v) over all rows, block by block."""
    shared = rows.sparkSession.sparkContext.broadcast((_matrix(queries["v"]), queries["vec_id"].to_numpy()))

    def run(batches):
        q, own = shared.value
        for b in batches:
            if len(b):
                yield nearest(q, own, _matrix(b["v"]), b["vec_id"].to_numpy(), k)

    return _best(rows.mapInPandas(run, FOUND), k)


def bins_of(sizes: dict[int, int]) -> dict[int, int]:
    """Leaf -> bin: leaves in tree order, as many to a bin as hold ``GROUP_ROWS`` rows together, one at least."""
    out, held, number = {}, 0, 0
    for leaf in sorted(sizes):
        if held and held + sizes[leaf] > GROUP_ROWS:
            held, number = 0, number + 1
        out[leaf] = number
        held += sizes[leaf]
    return out


def search(indexed: DataFrame, queries: DataFrame, tree: Tree, leaves: int, sizes: dict[int, int], k: int) -> DataFrame:
    """(query_id, rank, vec_id, score) from the ``leaves`` leaves each query visits, and further ones until they hold k rows beside its own.

    A query goes once to each bin of leaves that it visits. A group is (bin, part of its rows, turn of its queries): its rows, of
    bounded number, are held while its queries stream past. Rows are repeated only for turns, of which a bin has one for
    every ``GROUP_QUERIES`` queries.
    """
    spark, bins = indexed.sparkSession, bins_of(sizes)
    shared = spark.sparkContext.broadcast((tree, sizes, bins))

    def visit(batches):
        tree_, sizes_, bins_ = shared.value
        for b in batches:
            for at in range(0, len(b), WALKED):
                out = []
                own = b.iloc[at : at + WALKED]
                for q, v, unit in zip(own["vec_id"], own["v"], _unit(_matrix(own["v"]))):
                    found: dict[int, list[int]] = {}
                    for leaf in tree_.walk(unit, leaves, sizes_, k + 1):
                        if leaf in bins_:
                            found.setdefault(bins_[leaf], []).append(leaf)
                    out += [(n, q, v, x) for n, x in found.items()]
                yield pd.DataFrame(out, columns=["bin", "vec_id", "v", "visited"])

    visits = table(queries.select("vec_id", "v").mapInPandas(visit, "bin int, vec_id long, v array<double>, visited array<int>"), "ann-visits")
    asked = {r["bin"]: r["count"] for r in visits.groupBy("bin").count().collect()}
    held: dict[int, int] = {}
    for leaf, n in bins.items():
        held[n] = held.get(n, 0) + sizes[leaf]
    dealt = {n: (max(1, -(-rows // GROUP_ROWS)), max(1, -(-asked.get(n, 0) // GROUP_QUERIES))) for n, rows in held.items()}
    plan = spark.createDataFrame([(leaf, n, *dealt[n]) for leaf, n in bins.items()], "leaf int, bin int, parts int, turns int")
    by_bin = plan.select("bin", "parts", "turns").distinct()

    def each(own: str, other: str, number: str):  # a row of its own part (turn) in every turn (part) of the bin
        return [F.pmod(F.xxhash64("vec_id"), F.col(own)).cast("int").alias(number), F.explode(F.sequence(F.lit(0), F.col(other) - 1))]

    part, turns = each("parts", "turns", "part")
    none = F.array().cast("array<int>").alias("visited")
    rows = indexed.join(F.broadcast(plan), "leaf").select("bin", part, turns.alias("turn"), F.lit(0).alias("kind"), "vec_id", "v", "leaf", none)
    turn, parts = each("turns", "parts", "turn")
    calls = visits.join(F.broadcast(by_bin), "bin").select("bin", parts.alias("part"), turn, F.lit(1).alias("kind"), "vec_id", "v", F.lit(-1).alias("leaf"), "visited")

    def meet(batches):
        group, held_rows, ids, vectors, own_leaves = None, [], None, None, None
        for b in batches:
            for key, own in b.groupby(["bin", "part", "turn"], sort=False):
                if key != group:
                    group, held_rows, vectors = key, [], None
                held_rows.append(own[own["kind"] == 0])
                calling = own[own["kind"] == 1]
                if not len(calling):
                    continue
                if vectors is None:
                    all_rows = pd.concat(held_rows)
                    ids, vectors, own_leaves = all_rows["vec_id"].to_numpy(), _matrix(all_rows["v"]), all_rows["leaf"].to_numpy()
                if len(ids):
                    yield nearest(_matrix(calling["v"]), calling["vec_id"].to_numpy(), vectors, ids, k, own_leaves, calling["visited"].tolist())

    together = rows.unionByName(calls).repartition("bin", "part", "turn").sortWithinPartitions("bin", "part", "turn", "kind", "vec_id")
    return _best(together.mapInPandas(meet, FOUND), k)


def calibrate(tree: Tree, sizes: dict[int, int], asked: pd.DataFrame, true: list[tuple[int, int, int]], target: float) -> tuple[int, float]:
    """Leaves to visit so that ``target`` of the true neighbours (query, rank, leaf) are met, and the share that is."""
    if not len(asked):
        return min(4, tree.leaves), 1.0
    order = {}
    for own, unit in zip(asked["vec_id"], _unit(_matrix(asked["v"]))):
        order[own] = {leaf: n for n, leaf in enumerate(tree.walk(unit, tree.leaves))}
    places = np.sort([order[q][leaf] for q, _, leaf in true]) if true else np.zeros(1, int)
    leaves = tree.leaves if target > 1 else int(places[min(len(places), max(1, int(np.ceil(target * len(places))))) - 1]) + 1
    return leaves, float((places < leaves).mean())


def approximate_neighbours(vectors: DataFrame, is_query: F.Column, k: int = 5, target_recall: float = 0.95, id_col: str = "vec_id", vector_col: str = "embedding") -> tuple[DataFrame, dict]:
    """(query_id, rank, vec_id, score) and what calibration found: {leaves, visited, recall}.

    The tree is fitted on ``SAMPLE_ROWS`` rows in hash order and indexes every row. ``CALIBRATION_QUERIES`` queries in
    hash order are answered by brute force over all rows; as many leaves are visited as hold ``target_recall`` of their
    neighbours. All leaves are exact. Queries and candidates are the rows :func:`usable` keeps, rows of one id each on its own;
    equal scores go to the smaller id; an empty table gives an empty result; further columns are ignored.
    """
    spark = vectors.sparkSession
    short_batches(spark, 2048)
    all_rows = usable(vectors, id_col, vector_col)
    sample = first_in_hash_order(all_rows, SAMPLE_ROWS, "vec_id").orderBy("turn", "vec_id").limit(SAMPLE_ROWS).select("vec_id", "v").toPandas()
    tree = fit_tree(_unit(_matrix(sample["v"]))) if len(sample) else Tree(Node(np.zeros(0), leaf=0), 1)
    shared = spark.sparkContext.broadcast(tree)

    def file(batches):
        for b in batches:
            if len(b):
                yield b.assign(leaf=shared.value.file(_unit(_matrix(b["v"]))))

    indexed = table(all_rows.mapInPandas(file, "vec_id long, v array<double>, leaf int"), "ann-index")
    sizes = {r["leaf"]: r["count"] for r in indexed.groupBy("leaf").count().collect()}
    queries = indexed.where(is_query)
    some = first_in_hash_order(queries.select("vec_id", "v"), CALIBRATION_QUERIES, "vec_id", seed=1).orderBy("turn", "vec_id").limit(CALIBRATION_QUERIES).select("vec_id", "v").toPandas()
    true = []
    if len(some) and tree.leaves > 1:
        near = brute_force(indexed.select("vec_id", "v"), some, k).select("query_id", "rank", "vec_id")
        true = [tuple(r) for r in near.join(indexed.select("vec_id", "leaf"), "vec_id").select("query_id", "rank", "leaf").collect()]
    leaves, recall = calibrate(tree, sizes, some, true, target_recall)
    return search(indexed, queries, tree, leaves, sizes, k), {"leaves": tree.leaves, "visited": leaves, "recall": recall}


def op6_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The neighbours, the recall that calibration measured, and the share of the tree's leaves that a query visits."""
    found, said = approximate_neighbours(read(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)
    return found.withColumns({"recall": F.lit(said["recall"]), "visited": F.lit(said["visited"] / said["leaves"])})
