"""Deterministic samples per case."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def evenly(df: DataFrame, k: int) -> DataFrame:
    """Rows at round-half-even(i (n - 1) / (k - 1)), i = 0 .. k - 1, of each case in frame order; all rows if there are at most k."""
    w = Window.partitionBy("case_id")
    rows = df.withColumn("_n", F.count("*").over(w)).withColumn("_at", F.row_number().over(w.orderBy("frame")) - 1)
    wanted = F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda i: F.bround(i * (F.col("_n") - 1) / F.lit(float(max(1, k - 1)))).cast("int"))
    return rows.where((F.col("_n") <= k) | F.array_contains(wanted, F.col("_at"))).drop("_n", "_at")


def strided(df: DataFrame, m: int) -> DataFrame:
    """Every (n div m)-th row of each case, from the first, m rows at most."""
    w = Window.partitionBy("case_id")
    rows = df.withColumn("_n", F.count("*").over(w)).withColumn("_at", F.row_number().over(w.orderBy("frame")) - 1)
    step = F.greatest(F.lit(1), F.floor(F.col("_n") / m))
    return rows.where((F.col("_at") % step == 0) & (F.col("_at") / step < m)).drop("_n", "_at")


def hash_order(seed: int, *keys: str) -> Column:
    """A seeded order that any engine with SHA-256 can repeat."""
    return F.sha2(F.concat_ws("|", F.lit(str(seed)), *[F.col(k).cast("string") for k in keys]), 256)


def drawn(df: DataFrame, n: int, seed: int, key: str, by: str) -> DataFrame:
    """``n`` rows of each group, the first in hash order."""
    return df.withColumn("_r", F.row_number().over(Window.partitionBy(by).orderBy(hash_order(seed, key), key))).where(F.col("_r") <= n).drop("_r")


def split(df: DataFrame, share: int, seed: int, key: str) -> DataFrame:
    """Adds ``part``: 'train' for about ``share`` percent of the keys, else 'validation', by the hash's first byte."""
    byte = F.conv(F.substring(hash_order(seed, key), 1, 2), 16, 10).cast("int")
    return df.withColumn("part", F.when(byte * 100 < share * 256, "train").otherwise("validation"))


def top(df: DataFrame, n: int, by: str, *order: Column) -> DataFrame:
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(by).orderBy(*order))).where(F.col("rank") <= n)
