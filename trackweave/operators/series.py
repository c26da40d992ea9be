"""Per-case time series: windows ordered by frame."""

from __future__ import annotations

import itertools

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from trackweave.functions import numbers as N
from trackweave.operators.tracking import fold_sorted

def by_frame() -> Window:
    return Window.partitionBy("case_id").orderBy("frame")


def with_motion(valid: DataFrame) -> DataFrame:
    """Adds rn, velocity (pixels a frame, over the gap to the case's previous valid row; 0 for the first) and acceleration."""
    before = {c: F.lag(c).over(by_frame()) for c in ("cx", "cy", "frame")}
    gap = F.greatest(F.lit(1), F.col("frame") - before["frame"])
    moved = valid.withColumns({
        "rn": F.row_number().over(by_frame()), "gap": gap,
        "velocity": F.coalesce(F.sqrt(F.pow(F.col("cx") - before["cx"], 2) + F.pow(F.col("cy") - before["cy"], 2)) / gap, F.lit(0.0)),
    })
    return moved.withColumn("acceleration", F.coalesce((F.col("velocity") - F.lag("velocity").over(by_frame())) / F.col("gap"), F.lit(0.0)))


def flag_at_percentile(df: DataFrame, value: str, q: float, name: str = "flag", floor: float | None = None) -> DataFrame:
    """Marks rows at or above their case's own percentile (a constant series marks every row).

    The percentile lies between two rows by value. Rows that differ in their last bit fall on either side of it by its rounding alone, so
    it is low * (1 - share) + high * share with the sum rounded once, as the SQL's ``quantile_cont`` does; Spark's own rounds otherwise.
    """
    by_value = Window.partitionBy("case_id").orderBy(F.col(value).asc_nulls_last())
    whole = by_value.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    place = (F.col("_n") - 1) * F.lit(float(q))
    at = lambda f: F.max(F.when(F.col("_at") == f(place), F.col(value).cast("double"))).over(whole)
    ends = df.withColumns({"_at": F.row_number().over(by_value) - 1, "_n": F.count(value).over(whole)}).withColumns({"_low": at(F.floor), "_high": at(F.ceil), "_share": place - F.floor(place)})
    low, share = F.col("_low"), F.col("_share")
    threshold = F.when(share == 0, low).otherwise(N.fused(low, 1 - share, F.col("_high") * share))
    if floor is not None:
        threshold = F.greatest(F.lit(float(floor)), threshold)
    return ends.withColumn(name, F.col(value) >= threshold).drop("_at", "_n", "_low", "_high", "_share")


def dilate(df: DataFrame, mask: str, margin: int, name: str | None = None) -> DataFrame:
    """A row is marked if any row of the case within ``margin`` frames is."""
    near = by_frame().rangeBetween(-margin, margin)
    return df.withColumn(name or mask, F.max(F.col(mask).cast("int")).over(near) == 1)


def segments(df: DataFrame, mask: str, least: int) -> DataFrame:
    """(case_id, start_frame, end_frame, n): runs of marked rows that follow each other, of at least ``least`` rows."""
    at = F.row_number().over(by_frame())
    inner = F.row_number().over(Window.partitionBy("case_id", mask).orderBy("frame"))
    islands = df.withColumn("island", at - inner).where(mask)
    return islands.groupBy("case_id", "island").agg(F.min("frame").alias("start_frame"), F.max("frame").alias("end_frame"), F.count("*").alias("n")).where(F.col("n") >= least).drop("island")


def outside_segments(df: DataFrame, mask: str, least: int) -> DataFrame:
    """The rows whose frame lies in none of the :func:`segments`: unmarked ones, and those of runs that are too short.

    A frame has one row a case, so a segment covers its own rows alone and none of its frames need be made. A row without case or frame lies in none.
    """
    marked = F.coalesce(F.col(mask), F.lit(False)) & F.col("case_id").isNotNull() & F.col("frame").isNotNull()
    inner = F.row_number().over(Window.partitionBy("case_id", mask).orderBy("frame"))
    islands = df.withColumn("_island", F.row_number().over(by_frame()) - inner)
    run = F.count("*").over(Window.partitionBy("case_id", mask, "_island"))
    return islands.withColumn("_run", run).where(~marked | (F.col("_run") < least)).drop("_island", "_run")


def streaks(df: DataFrame, lost: Column) -> DataFrame:
    """Adds ``streak``: rows in a row, up to this one, for which ``lost`` holds."""
    reset = F.sum(F.when(lost, 0).otherwise(1)).over(by_frame())
    return df.withColumn("block", reset).withColumn("streak", F.sum(F.when(lost, 1).otherwise(0)).over(Window.partitionBy("case_id", "block").orderBy("frame"))).drop("block")


def carried(column: str) -> Column:
    """The last known value of the case."""
    return F.last(column, ignorenulls=True).over(by_frame())


def smoothed(df: DataFrame, value: str, alpha: float) -> DataFrame:
    """(case_id, frame, ema): exponential mean rounded half-even at each step, a fold over the case's rows in frame order."""

    def fold(own):
        now = None
        for case, frame, v in own:
            now = float(round(v if now is None else now * (1 - alpha) + v * alpha))
            yield case, frame, now

    return fold_sorted(df.select("case_id", "frame", F.col(value).cast("double").alias("v")), ["case_id"], ["frame"], "case_id long, frame long, ema double", fold)


def temporal_spectrum(df: DataFrame, value: str, fps: float = 1.0) -> DataFrame:
    """(case_id, n, peak_frequency, peak_strength, entropy) of the mean-removed, Hann-weighted series, by a fast Fourier transform.

    Bins 0 to n/2 of each case; bin 0 counts as zero; entropy is over log2 of the number of bins. Under four rows all are 0.
    A case's values, 8 bytes a row, are held while it is transformed.
    """

    def fold(own):
        first = next(own)
        x = np.fromiter((r[2] for r in itertools.chain([first], own)), dtype=np.float64)
        n = len(x)
        if n < 4:
            yield first[0], n, 0.0, 0.0, 0.0
            return
        p = np.abs(np.fft.rfft((x - x.mean()) * np.hanning(n))) ** 2
        p[0] = 0
        share = p / (p.sum() + 1e-9)
        peak, some = int(np.round(p, 9).argmax()), share[share > 0]
        yield first[0], n, peak * fps / n, float(share.max()), float(-(some * np.log2(some)).sum() / max(1.0, np.log2(len(p))))

    return fold_sorted(df.select("case_id", "frame", F.col(value).cast("double").alias("v")), ["case_id"], ["frame"], "case_id long, n long, peak_frequency double, peak_strength double, entropy double", fold)
