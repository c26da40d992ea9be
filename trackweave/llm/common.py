"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import itertools
import tempfile
import uuid

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
ASCII_LOWER = str.maketrans(UPPER, LOWER)
#: Rows and bytes an Arrow batch carries to a Python worker; texts can be long, so batches are short.
BATCH_ROWS, BATCH_BYTES = 512, 16 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``; a folder of our own only where all run on one machine."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.conf.get("spark.master", "local").startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        path = tempfile.mkdtemp(prefix="trackweave-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path


def short_batches(spark: SparkSession, rows: int = BATCH_ROWS) -> None:
    """Bound the rows and bytes of an Arrow batch, and with them the Python workers' memory."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def short_lived_shuffles(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of a query when it ends, not when the driver happens to collect what refers to them; else those of all rounds pile up."""
    spark.conf.set("spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true")


def stored(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """Write a frame to the shared folder and read it back: cuts the lineage and survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def table(df: DataFrame, name: str) -> DataFrame:
    return stored(df, name)[0]


def forget(spark: SparkSession, path: str) -> None:
    """Delete a table of :func:`stored` that nothing reads any more."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def columns_of(df: DataFrame, *names: str) -> DataFrame:
    """Only the named columns, so that extra columns of a caller's table cannot clash with ours."""
    return df.select(*[F.col(f"`{n}`") for n in names])


def unused(df: DataFrame, name: str) -> str:
    """``name``, or with underscores before it the first name that is no column of ``df``."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Lower-cases A-Z in UTF-8 bytes, where no other character holds those bytes.
BYTES_LOWER = bytes.maketrans(UPPER.encode(), LOWER.encode())


def byte_words(text: str | None) -> list[bytes]:
    """The words [^\\x20\\x09-\\x0D]+ of a text as UTF-8, A-Z in lower case: bytes split at exactly these six."""
    return (text or "").encode("utf-8", "surrogatepass").translate(BYTES_LOWER).split()


def ascii_lower(col):
    """Lower-case A-Z only, as the contracts say; other letters stay."""
    return F.translate(col, UPPER, LOWER)


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, component) for every node of undirected ``edges`` (a, b); component is the smallest node reachable.

    Alternates large-star and small-star rounds, each a few grouped minima and joins over the edge
    table, which is written to the shared folder between rounds; rounds grow with the logarithm of
    the longest path. An isolated node has no edge and so no row.
    """
    spark = edges.sparkSession
    now, path = stored(edges.where("a != b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    seen = None
    for _ in range(max_rounds):
        both = now.union(now.select("v", "u"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        small_least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(small_least, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        nxt = small.union(small_least.select("u", F.col("m").alias("v"))).distinct()
        nxt, nxt_path = stored(nxt, "edges")
        now_seen = tuple(nxt.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first())
        forget(spark, path)
        now, path = nxt, nxt_path
        if now_seen == seen:
            break
        seen = now_seen
    else:
        raise RuntimeError("connected components did not settle")
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(now.select("v", "v").distinct())


def flips(mask: int, radius: int) -> list[int]:
    """Every XOR pattern of at most ``radius`` bits inside ``mask``."""
    bits = [1 << b for b in range(64) if mask >> b & 1]
    return [sum(c) for k in range(radius + 1) for c in itertools.combinations(bits, k)]


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def first_in_hash_order(df: DataFrame, n: int, *keys: str, seed: int = 0) -> DataFrame:
    """The ``n`` rows of least hash of ``keys``, with the hash as column ``turn``; rows of equal keys stand or go together.

    Only hashes are sorted to find the n-th; the rows themselves are then filtered where they lie, so a
    bounded sample moves no more than itself. May return more than ``n`` rows where keys repeat.
    """
    turned = df.withColumn("turn", F.xxhash64(*keys, F.lit(seed)))
    last = turned.select("turn").orderBy("turn").limit(n).agg(F.max("turn")).first()[0]
    return turned.where(F.lit(False) if last is None else F.col("turn") <= last)


def bit_map(bits: DataFrame, size: int) -> np.ndarray:
    """A map of ``size`` bits with those of column ``bit`` set, as 32-bit words: of fixed size whatever the number of rows, put together by aggregation."""
    words = bits.groupBy(F.shiftright("bit", 5).alias("at")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), F.col("bit").bitwiseAND(F.lit(31)).cast("int"))).alias("word")).toArrow()
    found = np.zeros(size >> 5, dtype=np.uint32)
    found[words.column("at").to_numpy()] = words.column("word").to_numpy().astype(np.uint32)
    return found


def bits_set(words: np.ndarray, bits: np.ndarray) -> np.ndarray:
    return (words[bits >> 5] >> (bits & 31).astype(np.uint32) & np.uint32(1)).astype(bool)
