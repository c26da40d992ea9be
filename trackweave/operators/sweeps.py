"""Sensitivity sweeps: patches of gray frames scored against every choice of background, region and patch size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from trackweave.functions import numbers as N
from trackweave.functions import vectors as V
from trackweave.operators import regions
from trackweave.operators.tiles import cut

#: Of the sweep: sizes of patches, and the least background patches that make a template. Fixed values.
SIZES, LEAST = (8, 12, 16, 24, 32), 5


def patches(grays: DataFrame, size: int, stride: int | None = None) -> DataFrame:
    """(case_id, frame, height, width, size, px, py, v): all whole patches of a gray frame at a stride (their size), pixels from 0 to 1."""
    stride = stride or size
    steps = lambda n: F.expr(f"sequence(0, greatest({n} - {size}, 0), {stride})")
    rows = grays.where((F.col("height") >= size) & (F.col("width") >= size)).select("*", F.explode(steps("height")).alias("py")).select("*", F.explode(steps("width")).alias("px"))
    v = F.transform(cut("gray", F.col("width"), F.col("py"), F.lit(size), F.col("px"), F.lit(size)), lambda p: p / 255)
    return rows.select("case_id", "frame", "height", "width", F.lit(size).alias("size"), "px", "py", v.alias("v"))


def quiet_frames(grays: DataFrame) -> DataFrame:
    """(case_id, frame, quiet): whether a frame is among the max(10, n div 10) of its case that differ least from the frame before."""
    per_case = Window.partitionBy("case_id")
    rows = grays.select("case_id", "frame", F.coalesce(F.round(V.mean_abs_difference(F.col("gray"), F.lag("gray").over(per_case.orderBy("frame"))), 10), F.lit(0.0)).alias("activity"))
    rank = F.row_number().over(per_case.orderBy("activity", "frame"))
    return rows.select("case_id", "frame", (rank <= F.greatest(F.lit(10), F.floor(F.count("*").over(per_case) / 10))).alias("quiet"))


def background_patches(grays: DataFrame, rois: DataFrame, sizes: tuple[int, ...] = SIZES) -> DataFrame:
    """(case_id, roi, size, strategy, frame, px, py, v): every patch under each choice of background that takes it, for each region (case_id, roi, x, y, w, h)."""
    every = None
    for size in sizes:
        own = patches(grays, size)
        every = own if every is None else every.union(own)
    rows = every.join(quiet_frames(grays), ["case_id", "frame"]).join(rois.select("case_id", "roi", "x", "y", "w", "h"), "case_id")
    rows = rows.withColumns({"mean": V.mean(F.col("v")), "high": F.array_max("v")})
    tests = regions.patch_grid_choices(F.col("px"), F.col("py"), F.col("size"), F.col("width"), F.col("height"), tuple(F.col(c) for c in "xywh"), F.col("mean"), F.col("high"), F.col("quiet"))
    chosen = F.array_compact(F.array(*[F.when(test, F.lit(name)) for name, test in tests.items()]))
    return rows.select("case_id", "roi", "size", F.explode(chosen).alias("strategy"), "frame", "px", "py", "v")


def centre_targets(grays: DataFrame, rois: DataFrame, sizes: tuple[int, ...] = SIZES) -> DataFrame:
    """(case_id, roi, size, frame, px, py, v): the patch at the centre of each region in each frame, moved into the frame."""
    every = None
    for size in sizes:
        rows = grays.where((F.col("height") >= size) & (F.col("width") >= size)).join(rois.select("case_id", "roi", "x", "y", "w", "h"), "case_id")
        px, py = regions.patch_corner(F.floor(F.col("x") + F.col("w") / 2) - size // 2, F.floor(F.col("y") + F.col("h") / 2) - size // 2, size, F.col("width"), F.col("height"))
        rows = rows.withColumns({"px": px.cast("int"), "py": py.cast("int")})
        own = rows.select("case_id", "roi", F.lit(size).alias("size"), "frame", "px", "py", F.transform(cut("gray", F.col("width"), F.col("py"), F.lit(size), F.col("px"), F.lit(size)), lambda p: p / 255).alias("v"))
        every = own if every is None else every.union(own)
    return every


def patch_sweep(background: DataFrame, targets: DataFrame) -> DataFrame:
    """Targets against the mean of each choice's patches: (case_id, roi, size, strategy, frame, px, py, n, mean, std, error, zscore, percentile, ratio, class).

    Means and errors of patches are grouped aggregates over (case, region, size, choice); how many errors lie below a target's is a running count in
    order of error, so no target meets every patch. Choices with fewer than ``LEAST`` patches give no row.
    """
    group = ["case_id", "roi", "size", "strategy"]
    at = background.select(*group, F.posexplode("v").alias("pos", "x")).groupBy(*group, "pos").agg(F.avg("x").alias("x"))
    template = at.groupBy(*group).agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "x"))), lambda p: p["x"]).alias("template"))
    error = F.round(V.mean_squared_difference(F.col("v"), F.col("template")), 12).alias("error")
    base = background.join(template, group).select(*group, F.lit(None).cast("long").alias("frame"), F.lit(None).cast("int").alias("px"), F.lit(None).cast("int").alias("py"), error, F.lit(1).alias("base"))
    aimed = targets.join(template, ["case_id", "roi", "size"]).select(*group, "frame", "px", "py", error, F.lit(0).alias("base"))
    stats = base.groupBy(*group).agg(F.count("*").alias("n"), F.avg("error").alias("mean"), F.stddev_pop("error").alias("std")).where(F.col("n") >= LEAST)
    upto = Window.partitionBy(*group).orderBy("error").rangeBetween(Window.unboundedPreceding, 0)
    below = F.sum("base").over(upto) - F.sum("base").over(Window.partitionBy(*group, "error"))
    rows = base.unionByName(aimed).withColumn("below", below).where("base = 0").join(stats, group)
    z, percentile = (F.col("error") - F.col("mean")) / (F.col("std") + 1e-12), 100.0 * F.col("below") / F.col("n")
    rows = rows.withColumns({"zscore": z, "percentile": percentile, "ratio": F.col("error") / (F.col("mean") + 1e-12)})
    named = N.zscore_class(F.col("zscore"), F.col("std"), F.col("n"), F.col("percentile"), F.col("strategy"))
    return rows.select(*group, "frame", "px", "py", "n", "mean", "std", "error", "zscore", "percentile", "ratio", named.alias("class"))


def head_and_nearest(scored: DataFrame, by: str, value: str, top: int, reference: float | Column, *order: str) -> DataFrame:
    """Each group's ``top`` rows by ``value``, descending, with ``rank`` from 1, and its row nearest to ``reference``, with rank 0; ties by ``order``."""
    rank = F.row_number().over(Window.partitionBy(by).orderBy(F.desc(value), *order))
    near = F.row_number().over(Window.partitionBy(by).orderBy(F.abs(F.col(value) - reference), *order))
    heads = scored.withColumn("rank", rank).where(F.col("rank") <= top)
    return heads.union(scored.withColumn("rank", near).where("rank = 1").withColumn("rank", F.lit(0)))
