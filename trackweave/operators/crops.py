"""Image crops as array columns: stacks, templates, error scores, patch grids, background rings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from trackweave.functions import numbers as N
from trackweave.functions import vectors as V

SIDE = 8
BACKGROUNDS = ("near_background", "far_background", "random_background")


def pixels(crops: DataFrame, *keep: str) -> DataFrame:
    return crops.select(*keep, F.posexplode("v").alias("pos", "val"))


def projections(crops: DataFrame) -> DataFrame:
    """Per case and pixel over time: mean, least, largest, range and mean absolute step from the case's previous crop."""
    step = F.abs(F.col("val") - F.lag("val").over(Window.partitionBy("case_id", "pos").orderBy("frame")))
    g = pixels(crops, "case_id", "frame").withColumn("step", step).groupBy("case_id", "pos").agg(F.avg("val").alias("mean"), F.min("val").alias("low"), F.max("val").alias("high"), F.coalesce(F.avg("step"), F.lit(0.0)).alias("mean_step"))
    return g.withColumn("range", F.col("high") - F.col("low"))


def sharpness(v: Column) -> Column:
    """Variance of the four-neighbour Laplacian over inner pixels."""
    return F.pow(V.std(V.stencil_laplacian(v, SIDE, SIDE)), 2)


def sharpest_stack(crops: DataFrame, top: int = 64) -> DataFrame:
    """Pixel mean and median of each case's ``top`` sharpest crops."""
    order = Window.partitionBy("case_id").orderBy(F.desc("sharpness"), "frame")
    best = crops.withColumn("sharpness", F.round(sharpness(F.col("v")), 10)).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return pixels(best, "case_id").groupBy("case_id", "pos").agg(F.avg("val").alias("mean"), F.percentile("val", F.lit(0.5)).alias("median"))


def mean_crop(crops: DataFrame, *by: str) -> DataFrame:
    """(by, template): pixelwise mean of a group's crops, summed map-side."""
    means = pixels(crops, *by).groupBy(*by, "pos").agg(F.avg("val").alias("m"))
    return means.groupBy(*by).agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "m"))), lambda x: x["m"]).alias("template"))


def template_scores(crops: DataFrame, background: Column, target: Column) -> DataFrame:
    """(case_id, frame, error, zscore, percentile, ratio, n, std): error of target crops against the mean of the case's background crops,
    set against the background's own errors; percentile counts strictly smaller errors."""
    template = mean_crop(crops.where(background), "case_id")
    scored = crops.join(template, "case_id").withColumn("error", V.mean_squared_difference(F.col("v"), F.col("template")))
    base = scored.where(background).groupBy("case_id").agg(F.count("*").alias("n"), F.avg("error").alias("mean"), F.stddev_pop("error").alias("std"))
    # of all errors of the case in order, the background's before each target's
    marked = scored.select("case_id", "frame", "error", background.cast("int").alias("is_base"), target.alias("is_target"))
    below = F.coalesce(F.sum("is_base").over(Window.partitionBy("case_id").orderBy("error").rangeBetween(Window.unboundedPreceding, 0)), F.lit(0)) - F.sum("is_base").over(Window.partitionBy("case_id", "error"))
    placed = marked.withColumn("below", below).where("is_target").join(base, "case_id")
    return placed.select(
        "case_id", "frame", "error", ((F.col("error") - F.col("mean")) / (F.col("std") + 1e-12)).alias("zscore"), (100.0 * F.col("below") / F.col("n")).alias("percentile"), (F.col("error") / (F.col("mean") + 1e-12)).alias("ratio"), "n", "std"
    )


#: Background choices of the sweep: which crops count as background (the crops' signed values are scaled to this data).
def strategies(activity: Column) -> dict[str, Column]:
    mean, high = V.mean(F.col("v")), F.array_max("v")
    outside = F.coalesce(F.col("class_label"), F.lit("none")) != "object"
    return {
        "dark_strict": (mean < 0.0) & (high < 0.3), "corners": F.abs(F.get("v", F.lit(0))) < 0.1, "outside_roi": outside, "outside_central_zone": F.col("class_label").isNull(), "low_activity_frames": outside & activity,
        "all_frames_excluding_roi": outside, "exclude_saturated": outside & (high < 0.35), "brightness_threshold_loose": outside & (mean < 0.01),
    }


def low_activity(crops: DataFrame) -> DataFrame:
    """Adds ``activity`` (mean absolute difference to the case's previous crop, 0 first) and ``quiet``: the lowest max(10, n div 10)."""
    per_case = Window.partitionBy("case_id")
    rows = crops.withColumn("before", F.lag("v").over(per_case.orderBy("frame")))
    rows = rows.withColumn("activity", F.coalesce(F.round(V.mean_abs_difference(F.col("v"), F.col("before")), 10), F.lit(0.0))).drop("before")
    rank, n = F.row_number().over(per_case.orderBy("activity", "frame")), F.count("*").over(per_case)
    return rows.withColumn("quiet", rank <= F.greatest(F.lit(10), F.floor(n / 10)))


def sweep(crops: DataFrame) -> DataFrame:
    """Template scores of object crops under every background choice, with the class each score may be shown as."""
    rows = low_activity(crops)
    chosen = F.array(*[F.when(test, F.lit(name)) for name, test in strategies(F.col("quiet")).items()])
    tagged = rows.withColumn("chosen", F.array_compact(chosen))
    used = tagged.select(F.explode("chosen").alias("strategy"), "case_id", "frame", "v")
    template = mean_crop(used, "strategy", "case_id")
    error = F.round(V.mean_squared_difference(F.col("v"), F.col("template")), 12).alias("error")
    base = used.join(template, ["strategy", "case_id"]).select("strategy", "case_id", "frame", error, F.lit(1).alias("is_base"))
    targets = rows.where("class_label = 'object'").select("case_id", "frame", "v").join(template, "case_id").select("strategy", "case_id", "frame", error, F.lit(0).alias("is_base"))
    stats = base.groupBy("strategy", "case_id").agg(F.count("*").alias("n"), F.avg("error").alias("mean"), F.stddev_pop("error").alias("std")).where("n >= 5")
    group = Window.partitionBy("strategy", "case_id")
    below = F.sum("is_base").over(group.orderBy("error").rangeBetween(Window.unboundedPreceding, 0)) - F.sum("is_base").over(Window.partitionBy("strategy", "case_id", "error"))
    placed = base.unionByName(targets).withColumn("below", below).where("is_base = 0").join(stats, ["strategy", "case_id"])
    out = placed.select("strategy", "case_id", "frame", "error", "n", "std", ((F.col("error") - F.col("mean")) / (F.col("std") + 1e-12)).alias("zscore"), (100.0 * F.col("below") / F.col("n")).alias("percentile"))
    return out.withColumn("class", N.zscore_class(F.col("zscore"), F.col("std"), F.col("n"), F.col("percentile"), F.col("strategy")))


def class_errors(crops: DataFrame) -> DataFrame:
    """Errors against the mean of all control crops of the case: per-class means, pooled control deviation (ddof 1), object z and percentile (<=)."""
    control = F.col("class_label").isNotNull() & (F.col("class_label") != "object")
    template = mean_crop(crops.where(control), "case_id")
    rows = crops.where("class_label is not null").join(template, "case_id").withColumn("error", V.mean_squared_difference(F.col("v"), F.col("template")))
    pooled = rows.where(control).groupBy("case_id").agg(F.avg("error").alias("control_mean"), F.coalesce(F.stddev_samp("error"), F.lit(1e-9)).alias("control_std"), F.count("*").alias("n_control"))
    per_class = rows.groupBy("case_id", "class_label").agg(F.avg("error").alias("m"))
    means = per_class.groupBy("case_id").agg(F.avg(F.when(F.col("class_label").isin(*BACKGROUNDS), F.col("m"))).alias("background_mean"), F.max(F.when(F.col("class_label") == "object", F.col("m"))).alias("object_mean"))
    upto = F.sum(F.when(control, 1).otherwise(0)).over(Window.partitionBy("case_id").orderBy("error").rangeBetween(Window.unboundedPreceding, 0))
    placed = rows.withColumn("upto", upto).where("class_label = 'object'").join(pooled, "case_id")
    objects = placed.groupBy("case_id").agg(
        F.avg((F.col("error") - F.col("control_mean")) / (F.col("control_std") + 1e-9)).alias("mean_z"), F.max((F.col("error") - F.col("control_mean")) / (F.col("control_std") + 1e-9)).alias("max_z"),
        F.avg(100.0 * F.col("upto") / F.col("n_control")).alias("mean_percentile"),
    )
    return pooled.join(means, "case_id").join(objects, "case_id", "left").withColumn("ratio_background", F.col("object_mean") / (F.col("background_mean") + 1e-9))


def patch_grid(crops: DataFrame, size: int = 4, stride: int = 2) -> DataFrame:
    """(case_id, frame, px, py, patch): square windows of a crop at a stride."""
    starts = F.sequence(F.lit(0), F.lit(SIDE - size), F.lit(stride))
    grid = crops.select("case_id", "frame", "v", F.explode(starts).alias("py")).select("*", F.explode(starts).alias("px"))
    offsets = F.array(*[F.lit(j * SIDE + i) for j in range(size) for i in range(size)])
    return grid.select("case_id", "frame", "px", "py", F.transform(offsets, lambda o: F.get("v", o + F.col("py") * SIDE + F.col("px"))).alias("patch"))


def overlap_add(patches: DataFrame, score: Column, size: int = 4) -> DataFrame:
    """(case_id, pos, value): patch scores spread over their pixels and divided by how many patches cover each."""
    offsets = F.array(*[F.lit(j * SIDE + i) for j in range(size) for i in range(size)])
    spread = patches.select("case_id", score.alias("s"), F.explode(offsets).alias("o"), "px", "py")
    return spread.groupBy("case_id", (F.col("o") + F.col("py") * SIDE + F.col("px")).alias("pos")).agg(F.avg("s").alias("value"))


def ring_statistics(crops: DataFrame, box: tuple[int, int, int, int], pad: int, least: float) -> DataFrame:
    """Object box against the ring around it: means, deviation, shares hotter and colder than the ring by max(least, deviation)."""
    x, y, w, h = box
    inside = [j * SIDE + i for j in range(y, y + h) for i in range(x, x + w)]
    outer = [j * SIDE + i for j in range(max(0, y - pad), min(SIDE, y + h + pad)) for i in range(max(0, x - pad), min(SIDE, x + w + pad))]
    take = lambda idx: F.transform(F.array(*[F.lit(i) for i in idx]), lambda i: F.get("v", i))
    rows = crops.select("case_id", "frame", take(inside).alias("roi"), take([i for i in outer if i not in inside]).alias("ring"))
    rows = rows.select("case_id", "frame", "roi", V.mean(F.col("roi")).alias("roi_mean"), V.mean(F.col("ring")).alias("ring_mean"), V.std(F.col("ring")).alias("ring_std"))
    off = F.greatest(F.lit(least), F.col("ring_std"))
    return rows.select("case_id", "frame", "roi_mean", "ring_mean", "ring_std", V.share(F.col("roi"), lambda p: p > F.col("ring_mean") + off).alias("hot"), V.share(F.col("roi"), lambda p: p < F.col("ring_mean") - off).alias("cold"))


def peak_and_centre(crops: DataFrame, q: float = 0.9) -> DataFrame:
    """Brightest pixel (first of equals) and the centre of mass of the pixels at or over the ``q`` percentile."""
    rows = pixels(crops.withColumn("cut", V.percentile(F.col("v"), q)), "case_id", "frame", "cut").withColumns({"px": F.col("pos") % SIDE, "py": F.floor(F.col("pos") / SIDE)})
    bright = F.col("val") >= F.col("cut")
    mass = F.when(bright, F.col("val") - F.col("cut") + 1e-3)
    return rows.groupBy("case_id", "frame").agg(
        F.max_by("pos", F.struct("val", -F.col("pos"))).alias("peak"), (F.sum(mass * F.col("px")) / F.sum(mass)).alias("mass_x"), (F.sum(mass * F.col("py")) / F.sum(mass)).alias("mass_y"),
        F.min(F.when(bright, F.col("px"))).alias("x0"), F.max(F.when(bright, F.col("px"))).alias("x1"), F.count_if(bright).alias("n"),
    )
