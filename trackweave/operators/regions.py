"""Regions of interest: centred, default and named candidates, how one is chosen, patch choices, and readiness of a case."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

Box = tuple[Column, Column, Column, Column]

#: The reference centre and sides of the manual candidates.
CENTRE, SIDES = (321.6, 183.7), (64, 96, 128)
#: Words in a source's text that say it is infrared.
INFRARED_WORDS = ("flir", "thermal", "infrared")


def clipped(box: Box, width: int, height: int, least: int = 4) -> Box:
    """Whole-numbered box (half to even), its corner in the frame, its sides within it but ``least`` long."""
    x, y, w, h = (F.bround(c.cast("double")).cast("int") for c in box)
    x, y = F.greatest(F.lit(0), F.least(x, F.lit(width - 1))), F.greatest(F.lit(0), F.least(y, F.lit(height - 1)))
    return x, y, F.greatest(F.lit(least), F.least(w, width - x)), F.greatest(F.lit(least), F.least(h, height - y))


def centred(cx: Column, cy: Column, w: Column, h: Column, width: int, height: int) -> Box:
    return clipped((cx - w / 2, cy - h / 2, w, h), width, height)


def patch_corner(x: Column, y: Column, size: int, width: int, height: int) -> tuple[Column, Column]:
    """Corner of a patch moved into the frame."""
    return F.greatest(F.lit(0), F.least(x, F.lit(width - size))), F.greatest(F.lit(0), F.least(y, F.lit(height - size)))


def whole_entity(width: Column, height: Column) -> Box:
    """Default region of a whole structure: 15 %, 6 % from the corner, 70 % by 88 %, cut to whole pixels."""
    return tuple(F.floor(F.bround(c * share, 9)).cast("int") for c, share in ((width, 0.15), (height, 0.06), (width, 0.70), (height, 0.88)))


def frame_at(index: Column, frames: Column) -> Column:
    """Index moved into 0 to frames - 1."""
    return F.greatest(F.lit(0), F.least(frames - 1, index))


def candidates(cases: DataFrame, width: int, height: int) -> DataFrame:
    """(case_id, ord, name, x, y, w, h): each case's own box (x, y, w, h; null without one), the manual ones, and the one round its brightest place (bx, by); equal ones once."""
    shape = lambda name, box: F.struct(F.lit(name).alias("name"), *[c.alias(n) for c, n in zip(box, "xywh")])
    own = F.when(F.col("x").isNotNull(), shape("pipeline_auto_current", clipped(tuple(F.col(c) for c in "xywh"), width, height)))
    manual = [shape(f"manual_center_{s}", centred(F.lit(CENTRE[0]), F.lit(CENTRE[1]), F.lit(s), F.lit(s), width, height)) for s in SIDES]
    bright = shape("central_brightness_peak", centred(F.col("bx"), F.col("by"), F.lit(96), F.lit(96), width, height))
    found = F.array_distinct(F.array_compact(F.array(own, *manual, bright)))
    return cases.select("case_id", F.posexplode(found).alias("ord", "b")).select("case_id", "ord", "b.*")


def roi_mode(mode: Column, w: Column, h: Column) -> Column:
    """How a region is resolved: the configured one if manual with sides, found by brightness if asked for or without sides, else as configured."""
    sides = (F.coalesce(w, F.lit(0)) > 0) & (F.coalesce(h, F.lit(0)) > 0)
    own = F.coalesce(mode, F.lit("manual"))
    absent = (F.coalesce(w, F.lit(0)) == 0) | (F.coalesce(h, F.lit(0)) == 0)
    return F.when((own == "manual") & sides, "configured").when(own.isin("auto", "auto-brightness") | absent, "auto_brightness").otherwise("configured")


def infrared_mode(text: Column, channel_delta: Column) -> Column:
    """Whether a source is infrared by its text, or by channels that hardly differ."""
    said = reduce(lambda a, b: a | b, [F.contains(F.lower(text), F.lit(w)) for w in INFRARED_WORDS])
    return F.when(F.coalesce(said, F.lit(False)) | (channel_delta < 4), "true_ir_unknown_calibration").otherwise("pseudo_intensity_only")


def core_confident(active: Column) -> Column:
    """A detected core counts from more than 12 active pixels on."""
    return active > 12


def patch_grid_choices(x: Column, y: Column, size: int | Column, width: int | Column, height: int | Column, roi: Box, mean: Column, high: Column, quiet: Column) -> dict[str, Column]:
    """The eight background choices of a patch at (x, y), by its place, the region, its brightness (0 to 1) and its frame's activity."""
    corner = ((x < width * 0.18) | (x > width * 0.82 - size)) & ((y < height * 0.18) | (y > height * 0.82 - size))
    central = (x < width * 0.70) & (x + size > width * 0.30) & (y < height * 0.70) & (y + size > height * 0.30)
    outside = ~((x < roi[0] + roi[2]) & (x + size > roi[0]) & (y < roi[1] + roi[3]) & (y + size > roi[1]))
    return {
        "dark_strict": (mean < 0.055) & (high < 0.20), "corners": corner, "outside_roi": outside, "outside_central_zone": ~central, "low_activity_frames": outside & quiet,
        "all_frames_excluding_roi": outside, "exclude_saturated": outside & (high < 0.92), "brightness_threshold_loose": outside & (mean < 0.25),
    }


def off_centre(x: Column, y: Column, size: int, width: int | Column, height: int | Column) -> Column:
    """Whether a patch lies off the middle of its frame (35 to 65 % both ways)."""
    lo, hi = (lambda n: F.floor(F.lit(n) * 0.35)), (lambda n: F.floor(F.lit(n) * 0.65))
    return ~((x < hi(width)) & (x + size > lo(width)) & (y < hi(height)) & (y + size > lo(height)))


def beside_core(x: Column, y: Column, size: int, width: int, height: int, high: Column) -> Column:
    """Whether a patch is background of a whole structure: off its core (28 to 72 % by 22 to 78 %) and not saturated."""
    x0, x1, y0, y1 = int(width * 0.28), int(width * 0.72), int(height * 0.22), int(height * 0.78)
    return ~((x < x1) & (x + size > x0) & (y < y1) & (y + size > y0)) & (high < 0.94)


def review_frames(rows: DataFrame, value: str) -> DataFrame:
    """(case_id, ord, frame): first, middle, last frame and that of the largest ``value`` (the earliest of equals), each once, in order."""
    at = F.row_number().over(Window.partitionBy("case_id").orderBy("frame")) - 1
    n = F.count("*").over(Window.partitionBy("case_id"))
    marked = rows.select("case_id", "frame", value, at.alias("at"), n.alias("n"))
    g = marked.groupBy("case_id").agg(
        F.min("frame").alias("first"), F.min(F.when(F.col("at") == F.floor(F.col("n") / 2), F.col("frame"))).alias("middle"), F.max("frame").alias("last"), F.min_by("frame", F.struct(-F.col(value), "frame")).alias("peak"),
    )
    return g.select("case_id", F.posexplode(F.array_sort(F.array_distinct(F.array("first", "middle", "last", "peak")))).alias("ord", "frame"))


#: Gates of a case in order, each with the outputs that must be there.
READY = [
    ("tracking_generated", ["track"]), ("track_based_analysis_ready", ["track_based_metrics", "dynamic_rois_json"]), ("dynamic_rois_ready", ["dynamic_rois_csv"]), ("motion_analysis_ready", ["motion_metrics", "motion_timeseries"]),
    ("spectral_analysis_ready", ["spectral_metrics", "spectral_timeseries"]), ("thermal_analysis_ready", ["thermal_metrics", "thermal_timeseries"]), ("controls_analysis_ready", ["controls_metrics", "controls_timeseries"]),
    ("pca_analysis_ready", ["pca_metrics", "pca_samples"]), ("autoencoder_analysis_ready", ["autoencoder_metrics", "autoencoder_timeseries"]), ("unified_report_ready", ["unified_report", "unified_summary"]),
    ("reddit_template_ready", ["template_text", "template_data"]), ("srv_analysis_ready", ["srv_metrics", "srv_timeseries"]), ("srv_object_core_ready", ["srv_core_metrics", "srv_core_rois"]),
]


def readiness(outputs: Column, advice: Column, validated: Column, version: Column, wanted: str) -> dict[str, Column]:
    """The fifteen gates of a case from the names of its outputs (array), its tracking advice, its three-fold validation and its controls' version."""
    gates = {name: F.coalesce(reduce(lambda a, b: a & b, [F.array_contains(outputs, o) for o in needed]), F.lit(False)) for name, needed in READY}
    gates["tracking_validated"] = F.coalesce(validated, F.lit(False)) & ~F.coalesce(advice == "tracking_failed", F.lit(False))
    gates["clean_controls_v02_ready"] = gates["controls_analysis_ready"] & F.coalesce(version == wanted, F.lit(False))
    return gates


def review_status(gates: dict[str, Column]) -> Column:
    return F.when(gates["tracking_validated"], "tracking_human_validated").when(gates["tracking_generated"], "tracking_unvalidated").otherwise("tracking_required")


def module_lock(module: Column, gates: dict[str, Column]) -> Column:
    """struct(status, locked) of a module by the gates: open ones, then tracking, then the dynamic regions, then the module's own output."""
    own = F.lit(False)
    for name in ("motion", "spectral", "thermal", "srv", "controls", "pca", "autoencoder"):
        own = F.when(module == name, gates[f"{name}_analysis_ready"]).otherwise(own)
    known = module.isin("motion", "spectral", "thermal", "srv", "controls", "pca", "autoencoder")
    state = lambda s, locked: F.struct(F.lit(s).alias("status"), F.lit(locked).alias("locked"))
    return (
        F.when(module.isin("overview", "video"), state("ready", False)).when(~gates["tracking_generated"], state("blocked", True)).when(~gates["tracking_validated"], state("pending", True))
        .when(module == "roi", F.when(gates["track_based_analysis_ready"], state("available", False)).otherwise(state("validated", False))).when(~gates["track_based_analysis_ready"], state("pending", True))
        .when(known, F.when(own, state("available", False)).otherwise(state("validated", False))).when(module == "reports", state("available", False))
        .when(module == "publicSummary", F.when(gates["reddit_template_ready"], state("available", False)).when(gates["unified_report_ready"], state("validated", False)).otherwise(state("pending", False)))
        .otherwise(state("placeholder", False))
    )


def known_metrics(shares: DataFrame, errors: DataFrame, sweep: DataFrame) -> DataFrame:
    """(case_id, k5, k10, mean_z, max_z, top_z, unstable): what earlier modules left: cumulative shares (case_id, component, cumulative) at the 5th and
    10th component or the last, object z-scores (case_id, z), and the sweep's scores with their class (case_id, zscore, class)."""
    at = lambda k: F.max_by("cumulative", F.when(F.col("component") <= k, F.col("component")))
    a = shares.groupBy("case_id").agg(at(5).alias("k5"), at(10).alias("k10"))
    b = errors.groupBy("case_id").agg(F.avg("z").alias("mean_z"), F.max("z").alias("max_z"))
    c = sweep.groupBy("case_id").agg(F.max("zscore").alias("top_z"), F.count_if(F.col("class") == "unstable").alias("unstable"))
    return a.join(b, "case_id", "full_outer").join(c, "case_id", "full_outer")
