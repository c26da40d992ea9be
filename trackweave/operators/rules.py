"""Rule cascades as Column expressions: the first rule that holds decides."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trackweave.functions import numbers as N

#: Names of the priority labels in order of urgency.
PRIORITIES = ["high_priority", "medium_priority", "manual_review_required", "low_priority", "discard_candidate"]


def candidate_reasons(overlap: Column, artifact: Column, black: Column, cyan: Column, edge: Column) -> Column:
    """Why a control candidate is rejected; an empty list means it is valid."""
    rules = [(overlap > 0.02, "overlaps_object"), (artifact > 0.005, "artifact_mask_ratio_high"), (black > 0.001, "black_block_ratio_high"), (cyan > 0.0, "cyan_hud_ratio_high"), (edge < 0.12, "too_close_to_edge")]
    return F.array_compact(F.array(*[F.when(test, F.lit(name)) for test, name in rules]))


def priority(failed: Column, roi_ok: Column, width: Column, height: Column, duration: Column, motion: Column, saturated: Column, contrast: Column) -> Column:
    label = (
        F.when(failed, "discard_candidate").when(~roi_ok, "manual_review_required").when((width < 320) | (height < 180) | (duration < 1), "low_priority")
        .when((motion > 6) & (contrast > 20) & (saturated < 0.12), "high_priority").when((motion > 2) & (contrast > 10), "medium_priority").otherwise("low_priority")
    )
    return label


def artifact_warnings(saturated: Column, motion: Column, duration: Column, width: Column, height: Column, roi_ok: Column) -> Column:
    rules = [
        F.when(saturated > 0.18, "high saturation risk").when(saturated > 0.06, "some saturated highlights"), F.when(motion > 25, "large global motion"), F.when(duration < 6, "very short clip"),
        F.when((width < 640) | (height < 360), "low resolution"), F.when(~roi_ok, "ROI uncertain"),
    ]
    return F.array_compact(F.array(*rules))


def artifact_risk(warnings: Column, saturated: Column) -> Column:
    return F.when(F.size(warnings) == 0, "low").when((F.size(warnings) >= 3) | (saturated > 0.18), "high").otherwise("medium")


def recommendation(gate: Column, roi_ok: Column, risk: Column, roi_contrast: Column, motion: Column, contrast: Column, duration: Column) -> Column:
    visible, moving, clear = N.linear_score(roi_contrast, 8, 45), N.linear_score(motion, 1, 18), N.linear_score(contrast, 10, 55)
    return (
        F.when(gate != "validated", gate).when(~roi_ok, "needs_manual_roi").when(risk == "high", "likely_artifact").when((visible >= 55) & (moving >= 45) & (risk == "low") & (duration >= 8), "promote_to_deep_analysis")
        .when((visible >= 45) & (clear >= 45) & (duration < 30), "content_candidate").when((visible < 25) & (moving < 20), "low_value_after_review").otherwise("needs_manual_roi")
    )


def gate_status(has_track: Column, validated: Column, correct: Column, real: Column) -> Column:
    return F.when(~has_track, "tracking_required").when(F.coalesce(validated & correct & real, F.lit(False)), "validated").otherwise("tracking_unvalidated")


def module_status(valid: Column, has_rois: Column) -> dict[str, Column]:
    """Strength of each module from its score, over columns motion, stability, spectral, thermal, controls, pca, anomaly, max_z and n."""
    motion = N.strength(F.col("motion"))
    anomaly = N.strength(F.col("anomaly"), 0.75, 0.6)
    return {
        "tracking": F.when(F.coalesce(valid, F.lit(False)), "strong").otherwise("missing"), "dynamic_roi": F.when(has_rois, "ready").otherwise("missing"),
        "motion": F.when((motion == "strong") & (F.coalesce("stability", F.lit(0.0)) < 0.5), "moderate").otherwise(motion), "spectral": N.strength(F.col("spectral"), 0.55, 0.35), "thermal_ir": N.strength(F.col("thermal"), 0.12, 0.04),
        "srv": F.when(F.col("n").isNull(), "missing").when(F.col("n") % 3 == 0, "weak").otherwise("moderate"), "controls": N.strength(F.col("controls"), 0.8, 0.55), "pca": N.strength(F.col("pca"), 0.75, 0.45),
        "autoencoder": F.when((anomaly == "weak") & (F.coalesce("max_z", F.lit(0.0)) > 3), "exploratory").otherwise(anomaly),
    }


def overall(status: Column) -> Column:
    """Assessment of a map of module strengths from how many are strong, moderate, exploratory and missing."""
    count = lambda s: F.size(F.filter(F.map_values(status), lambda v: v == s))
    strong, moderate, exploratory, missing = (count(s) for s in ("strong", "moderate", "exploratory", "missing"))
    return F.when((strong >= 3) & (moderate >= 2), "usable").when(strong + moderate >= 4, "mixed").when((exploratory > 0) & (strong + moderate >= 2), "exploratory").when(missing > 4, "incomplete").otherwise("limited")


def modules_with(status: Column, *strengths: str) -> Column:
    """Names of the modules of some strengths, comma-joined in order."""
    return F.array_join(F.array_sort(F.map_keys(F.map_filter(status, lambda k, v: v.isin(*strengths)))), ",")


def hud_overlap(cx: Column, cy: Column, x: Column, y: Column, w: Column, h: Column, width: int, height: int) -> Column:
    """How far a box lies on an overlay: near the frame's centre, on its cross, or at its border."""
    far = F.hypot(cx - width / 2, cy - height / 2) / max(1.0, (width**2 + height**2) ** 0.5)
    cross = (F.abs(cx - width / 2) < max(8, width * 0.035)) | (F.abs(cy - height / 2) < max(8, height * 0.035))
    border = (x < width * 0.035) | (y < height * 0.035) | (x + w > width * 0.965) | (y + h > height * 0.965)
    return F.greatest(F.greatest(F.lit(0.0), 1 - far / 0.16), F.when(cross, 0.65).otherwise(0.0), F.when(border, 0.75).otherwise(0.0))


def line_score(w: Column, h: Column, edges: Column) -> Column:
    aspect = w / F.greatest(F.lit(1), h)
    thin = F.when((aspect > 5.5) | (aspect < 0.18), 0.78).otherwise(0.0)
    return F.greatest(thin, F.when((edges > 0.18) & ((aspect > 3) | (aspect < 0.33)), F.least(F.lit(1.0), edges * 3)).otherwise(0.0))


def pick_controls(valid: DataFrame, invalid: DataFrame, near: float | Column, by: list[str] | None = None) -> DataFrame:
    """:func:`pick_controls_of` over the valid candidates and the others as two tables of the same columns."""
    return pick_controls_of(valid.withColumn("_valid", F.lit(True)).unionByName(invalid.withColumn("_valid", F.lit(False))), F.col("_valid"), near, by)


def pick_controls_of(rows: DataFrame, valid: Column, near: float | Column, by: list[str] | None = None, more: list[Column] | None = None) -> DataFrame:
    """Per frame the candidate of each control type, as ``ord``: nearest to a distance, farthest, darkest, brightest, flattest, drawn, worst overlay.

    Columns: frame (or ``by``), ord, distance, luminance, texture, edges, artifact_ratio, black, cyan, draw (a seeded order); ties go to the least ``ord``.
    ``valid`` tells which may be a background, and ``more`` is what else is aggregated over all. One aggregation; rows should be dealt by ``by`` before, as
    they are far narrower than what is kept of each frame. Rows without a frame are of two groups, the valid and the others.
    """
    low = lambda c, test: F.min(F.when(test, F.struct(c.alias("c"), F.col("ord").alias("ord"))))["ord"]
    by = by or ["frame"]
    bad = ~valid
    overlay = (F.col("artifact_ratio") > 0.005) | (F.col("black") > 0.001) | (F.col("cyan") > 0)
    lost = F.when(F.greatest(*[F.col(c).isNull() for c in by], F.lit(False)), valid)
    g = rows.groupBy(*by, lost.alias("_lost")).agg(
        F.nullif(F.count_if(valid), F.lit(0)).alias("n_valid"), low(F.abs(F.col("distance") - near), valid).alias("near_background"), low(-F.col("distance"), valid).alias("far_background"), low(F.col("luminance"), valid & (F.col("luminance") < 95)).alias("dark_region"),
        low(-F.col("luminance"), valid & (F.col("luminance") > 90)).alias("bright_region"), low(F.col("texture") + F.col("edges") * 100, valid & F.col("texture").between(4, 38)).alias("compression_noise"), low(F.col("draw"), valid).alias("random_background"),
        low(-(F.col("artifact_ratio") + F.col("black") + F.col("cyan") * 50), bad & overlay).alias("hud_artifact"), *(more or []),
    )
    return g.drop("_lost")

