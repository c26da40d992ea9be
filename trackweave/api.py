"""Entry points over tables of many cases: register media, rebuild ROIs from validated tracks, module records, report.

Inputs are DataFrames: tracks (case_id, frame, status, confidence, x, y, w, h, cx, cy), validations (case_id, track_validated,
track_is_correct, object_is_real_target), frames (case_id, frame, v) with crops as arrays. Nothing runs until a result is used or written.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trackweave.functions import geometry as G
from trackweave.functions import text as T
from trackweave.functions import vectors as V
from trackweave.operators import crops as C
from trackweave.operators import joins, metrics, rules, series, tracking
from trackweave.sources import readers, sinks
from trackweave.sources.fixtures import VALID_STATES

FLAGS = ("track_validated", "track_is_correct", "object_is_real_target")


def register_sources(spark: SparkSession, folder: str, batch_id: str, known: DataFrame | None = None) -> DataFrame:
    """(batch_id, case_id, file, path, size_bytes, sha256, source_quality) of the folder's media; files whose content is known are left out."""
    found = readers.fingerprints(spark, folder).withColumn("file", F.element_at(F.split("path", "/"), -1)).where(readers.extension(F.col("path")).isin(*readers.MEDIA))
    if known is not None:
        found = found.join(known.select("sha256").distinct(), "sha256", "left_anti")
    named = T.unique_ids(found.withColumn("stem", F.regexp_replace("file", r"\.[^.]+$", "")), "stem", "path")
    return named.select(F.lit(batch_id).alias("batch_id"), F.col("unique_id").alias("case_id"), "file", "path", "size_bytes", "sha256", T.source_quality(F.col("file")).alias("source_quality"))


def decide(validations: DataFrame, decisions: DataFrame) -> DataFrame:
    """Validations with three-way decisions (case_id, decision) applied: accept, reject, or anything else for undecided."""
    flag = F.when(F.col("decision") == "accept", True).when(F.col("decision") == "reject", False)
    new = decisions.select("case_id", *[flag.alias(f) for f in FLAGS])
    kept = sinks.with_defaults(validations, {}).join(new.select("case_id"), "case_id", "left_anti")
    return kept.select("case_id", *FLAGS).unionByName(new)


def validated(rows: DataFrame, validations: DataFrame) -> DataFrame:
    return joins.gate(rows, validations, *FLAGS)


def dynamic_rois(tracks: DataFrame, validations: DataFrame, width: int, height: int, margin: float = 0.25) -> DataFrame:
    """ROI table of validated cases; rows that are not in a valid state keep their frame and status alone."""
    box = tuple(F.col(c) for c in "xywh")
    usable = F.col("status").isin(*VALID_STATES) & F.col("x").isNotNull()
    inside, wide = G.clamp(box, width, height), G.expand(box, margin, width, height)
    cx, cy = G.centre(inside)
    cols = {**{f"bbox_{n}": c for n, c in zip("xywh", inside)}, **{f"expanded_{n}": c for n, c in zip("xywh", wide)}, "centroid_x": cx, "centroid_y": cy, "area": inside[2] * inside[3]}
    return validated(tracks, validations).select("case_id", "frame", "status", *[F.when(usable, c).alias(n) for n, c in cols.items()], "confidence")


def run_motion(tracks: DataFrame, validations: DataFrame, fps: float = 30.0) -> tuple[DataFrame, DataFrame]:
    """Series and metric record of each validated case."""
    rows = validated(tracks, validations).where(F.col("status").isin(*VALID_STATES))
    moved = series.with_motion(rows).withColumn("timestamp", F.col("frame") / F.lit(fps))
    return moved, metrics.motion_summary(rows)


def run_spectral(frames: DataFrame, rois: DataFrame, fps: float = 30.0) -> DataFrame:
    """Luminance, flicker and temporal spectrum of each case's ROI crops; frames without an ROI do not count."""
    lit = frames.join(rois.where("bbox_x is not null").select("case_id", "frame"), ["case_id", "frame"]).select("case_id", "frame", V.mean(F.col("v")).alias("luminance"))
    return metrics.luminance_summary(lit, "luminance", fps).join(series.temporal_spectrum(lit, "luminance", fps).drop("n"), "case_id", "left")


def run_anomaly(crops: DataFrame) -> DataFrame:
    """Template errors of object crops against background crops, per case."""
    background = F.coalesce(F.col("class_label").isin(*C.BACKGROUNDS), F.lit(False))
    scored = C.template_scores(crops, background, F.coalesce(F.col("class_label") == "object", F.lit(False)))
    return scored.groupBy("case_id").agg(F.count("*").alias("n_object"), F.avg("zscore").alias("mean_z"), F.max("zscore").alias("max_z"), F.avg("percentile").alias("mean_percentile"))


def unified_report(modules: DataFrame, validations: DataFrame) -> DataFrame:
    """(case_id, status map, overall, strongest, weakest) from module scores (see rules.module_status) and validations."""
    joined = modules.join(validations, "case_id", "left")
    found = rules.module_status(F.col(FLAGS[0]) & F.col(FLAGS[1]) & F.col(FLAGS[2]), F.col("n").isNotNull())
    status = F.map_from_arrays(F.array(*[F.lit(n) for n in found]), F.array(*found.values()))
    rows = joined.select("case_id", status.alias("status"))
    s = F.col("status")
    return rows.select("case_id", "status", rules.overall(s).alias("overall"), rules.modules_with(s, "strong").alias("strongest"), rules.modules_with(s, "weak", "missing").alias("weakest"))


#: Trackers by name: each takes (rows, reach) and returns followed rows.
TRACKERS: dict[str, Callable[..., DataFrame]] = {"follower": tracking.follow}


def register_tracker(name: str, run: Callable[..., DataFrame]) -> None:
    TRACKERS[name] = run


def track_cases(rows: DataFrame, preferred: list[str], reach: float) -> tuple[str, DataFrame]:
    """The first tracker of ``preferred`` that is registered, else the follower, and its result."""
    name = next((p for p in preferred if p in TRACKERS), "follower")
    return name, TRACKERS[name](rows, reach)
