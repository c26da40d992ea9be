"""Metric records: one row a case."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trackweave.functions import geometry as G
from trackweave.functions import numbers as N
from trackweave.operators.series import flag_at_percentile, with_motion


def or_zero(c: Column) -> Column:
    return F.coalesce(c, F.lit(0.0))


def motion_summary(valid: DataFrame) -> DataFrame:
    """Velocity from the second row of a case on, acceleration from the third, and the scores made of them."""
    later, third = F.col("rn") > 1, F.col("rn") > 2
    v, a, area = F.when(later, F.col("velocity")), F.when(third, F.abs("acceleration")), (F.col("w") * F.col("h")).cast("double")
    g = with_motion(valid).groupBy("case_id").agg(
        F.count("*").alias("valid_tracked_frames"), or_zero(F.avg(v)).alias("mean_velocity"), or_zero(F.percentile(v, F.lit(0.5))).alias("median_velocity"), or_zero(F.max(v)).alias("max_velocity"),
        or_zero(F.avg(a)).alias("mean_acceleration"), or_zero(F.max(a)).alias("max_acceleration"), F.avg(area).alias("mean_bbox_area"), F.stddev_pop(area).alias("_sa"), or_zero(F.stddev_pop(v)).alias("_sv"),
        (F.max("frame") - F.min("frame") + 1).alias("_span"),
    )
    g = g.withColumns({"continuity": F.col("valid_tracked_frames") / F.col("_span"), "area_variation": F.col("_sa") / F.greatest(F.lit(1.0), F.col("mean_bbox_area")), "jitter": F.when(F.col("mean_velocity") > 0, N.ratio(F.col("_sv"), F.col("mean_velocity"))).otherwise(0.0)})
    return g.withColumn("stability", N.clip(F.col("continuity") / (1 + F.col("area_variation") + F.col("jitter")))).drop("_sa", "_sv", "_span")


def track_quality(track: DataFrame, names: dict[str, tuple[str, ...]]) -> DataFrame:
    """State counts of a case, its confidence, and a recommendation; ``names`` says which states count as which."""
    has = lambda k: F.col("status").isin(*names[k])
    g = track.groupBy("case_id").agg(F.count("*").alias("total"), *[F.count_if(has(k)).alias(k) for k in names], F.avg("confidence").alias("mean_confidence"), F.min("confidence").alias("min_confidence"))
    usable, lost = F.col("tracked") + F.col("recovered"), F.col("lost") + F.col("predicted")
    advice = (
        F.when((usable == 0) | (lost / F.col("total") > 0.5), "tracking_failed").when((F.col("low") > usable * 0.35) | (F.col("recovered") > usable * 0.35), "tracking_needs_review")
        .when((F.col("recovered") > 0) | (F.col("low") > 0), "tracking_usable_with_review").when(usable / F.col("total") > 0.65, "tracking_good").otherwise("tracking_usable_with_review")
    )
    return g.withColumn("recommendation", advice)


def track_score(valid: DataFrame, total_frames: int, width: int, height: int) -> DataFrame:
    """Weighted confidence of a track from continuity, persistence, motion, contrast, size and edge risk, and its reason."""
    box = tuple(F.col(c) for c in "xywh")
    area = (F.col("w") * F.col("h")).cast("double")
    g = with_motion(valid).groupBy("case_id").agg(
        F.count("*").alias("detected"), F.min("frame").alias("start_frame"), F.max("frame").alias("end_frame"), or_zero(F.avg(F.when(F.col("rn") > 1, F.col("velocity")))).alias("motion"),
        F.avg(F.col("confidence") * 40).alias("contrast"), F.avg(area).alias("_a"), F.stddev_pop(area).alias("_s"), F.count_if(G.touches_edge(box, width, height, 0.03)).alias("edge_hits"), F.avg(F.col("w") / F.col("h")).alias("aspect"),
    )
    n = F.col("detected")
    g = g.withColumns({
        "continuity": n / (F.col("end_frame") - F.col("start_frame") + 1), "persistence": n / float(total_frames), "size_stability": 1 / (1 + F.col("_s") / F.greatest(F.lit(1.0), F.col("_a"))),
        "artifact": F.least(F.lit(1.0), F.col("edge_hits") / n + F.when(F.col("_a") > width * height * 0.07, 0.25).otherwise(0.0)), "dark": F.least(F.lit(1.0), F.col("aspect") / 5 * 0.25),
    })
    one = lambda c: F.least(F.lit(1.0), c)
    weighted = 0.30 * one(F.col("continuity")) + 0.24 * one(F.col("persistence") * 8) + 0.13 * one(F.col("contrast") / 40) + 0.12 * one(F.col("motion") / 12) + 0.11 * one(F.col("size_stability")) + 0.18 * F.col("dark") - 0.28 * F.col("artifact")
    g = g.withColumn("confidence", N.clip(weighted))
    reason = (
        F.when(n < 5, "too few frames").when(F.col("artifact") > 0.55, "edge risk").when(F.col("confidence") >= 0.55, "selected").when(F.col("confidence") >= 0.35, "low confidence").otherwise("weak")
    )
    ready = (F.col("confidence") >= 0.55) & (n >= 8) & (F.col("artifact") < 0.55)
    return g.withColumns({"reason": reason, "tracking_status": F.when(ready, "tracking_candidate_ready").otherwise("tracking_low_confidence")}).drop("_a", "_s")


def envelope(rows: DataFrame) -> DataFrame:
    """Bounding box of all boxes of a case."""
    g = rows.groupBy("case_id").agg(F.min("x").alias("x"), F.min("y").alias("y"), F.max(F.col("x") + F.col("w")).alias("_x"), F.max(F.col("y") + F.col("h")).alias("_y"))
    return g.select("case_id", "x", "y", (F.col("_x") - F.col("x")).alias("w"), (F.col("_y") - F.col("y")).alias("h"))


def luminance_summary(series: DataFrame, value: str, fps: float = 1.0) -> DataFrame:
    """Mean, deviation, range, flicker and duration of a case's series."""
    return series.groupBy("case_id").agg(
        F.count("*").alias("n"), F.avg(value).alias("mean_luminance"), F.stddev_pop(value).alias("luminance_std"), F.min(value).alias("luminance_min"), F.max(value).alias("luminance_max"),
        N.ratio(F.stddev_pop(value), F.avg(value)).alias("flicker_index"), ((F.max("frame") - F.min("frame")) / fps).alias("duration"),
    )


def contrast_summary(series: DataFrame) -> DataFrame:
    """Of (roi, background) series: contrast index, stability of the difference, and the first 20 peak frames (at or over the 95th percentile)."""
    delta = series.withColumn("delta", F.col("roi") - F.col("background"))
    marked = flag_at_percentile(delta.withColumn("size", F.abs("delta")), "size", 0.95, "peak")
    return marked.groupBy("case_id").agg(
        F.avg("delta").alias("delta_mean"), F.stddev_pop("delta").alias("delta_std"), (F.avg("size") / F.greatest(F.lit(1.0), F.avg("background"))).alias("contrast_index"),
        (1 / (1 + F.stddev_pop("delta") / F.greatest(F.lit(1e-6), F.abs(F.avg("delta"))))).alias("stability"), F.slice(F.sort_array(F.collect_list(F.when(F.col("peak"), F.col("frame")))), 1, 20).alias("peak_frames"),
    )


def histogram(df: DataFrame, value: str, bins: int) -> DataFrame:
    """Counts per case of ``bins`` even bins between the case's least and largest value, the largest in the last bin."""
    ends = df.groupBy("case_id").agg(F.min(value).alias("low"), F.max(value).alias("high"))
    at = F.when(F.col("high") > F.col("low"), F.least(F.lit(bins - 1), F.floor((F.col(value) - F.col("low")) / (F.col("high") - F.col("low")) * bins))).otherwise(0).cast("int")
    return df.join(ends, "case_id").groupBy("case_id", at.alias("bin")).agg(F.count("*").alias("n"))


def counts_with_zeros(df: DataFrame, by: str, values: list[str], *groups: str) -> DataFrame:
    """Row counts of every value of a closed list, missing ones as 0; with ``groups`` for each of their values."""
    counted = df.groupBy(*groups, by).agg(F.count("*").alias("n"))
    if groups:
        wanted = counted.select(*groups).distinct().withColumn(by, F.explode(F.array(*[F.lit(v) for v in values])))
        return wanted.join(counted, [*groups, by], "left").select(*groups, by, F.coalesce("n", F.lit(0)).alias("n"))
    names = df.sparkSession.createDataFrame([(v,) for v in values], f"{by} string")
    return F.broadcast(names).join(counted, by, "left").select(by, F.coalesce("n", F.lit(0)).alias("n"))


#: Of a sequence track: least rows, and the shares of continuity and of rows in its confidence. Fixed values.
SEQUENCE_ROWS, SEQUENCE_SHARES, SEQUENCE_FULL = 3, (0.35, 0.35, 0.20, 0.95), 12


def sequence_tracks(rows: DataFrame, pause: int = 8, fps: float = 30.0, total: int | None = None) -> DataFrame:
    """A row for each run of a case's rows whose frames are ``pause`` apart at most; a table or a stream, by session windows over the frames.

    Takes case_id, frame_time (the frame as a timestamp of as many seconds), frame, velocity (null for the first of a run), dark_delta, aspect,
    brightness. Runs of fewer than ``SEQUENCE_ROWS`` rows are none.
    """
    session = F.session_window("frame_time", f"{pause * 1000 + 500} milliseconds")
    g = rows.groupBy("case_id", session.alias("run")).agg(
        F.min("frame").alias("start_frame"), F.max("frame").alias("end_frame"), F.count("*").alias("n"), F.avg("velocity").alias("velocity"),
        *[F.avg(c).alias(c) for c in ("dark_delta", "aspect", "brightness")],
    ).where(F.col("n") >= SEQUENCE_ROWS)
    span = F.col("end_frame") - F.col("start_frame") + 1
    continuity = F.col("n") / F.greatest(F.lit(1), span)
    base, of_continuity, of_rows, most = SEQUENCE_SHARES
    confidence = F.least(F.lit(most), base + of_continuity * continuity + of_rows * F.least(F.lit(1.0), F.col("n") / SEQUENCE_FULL))
    persistence = F.col("n") / F.greatest(F.lit(1), F.lit(total)) if total else F.lit(None).cast("double")
    return g.select(
        "case_id", "start_frame", "end_frame", span.alias("duration_frames"), (span / fps).alias("duration_seconds"), F.col("n").alias("detected_frames"), continuity.alias("continuity"), persistence.alias("persistence"),
        F.coalesce("velocity", F.lit(0.0)).alias("motion"), F.col("dark_delta").alias("contrast"), F.col("aspect").alias("mean_aspect"), F.col("brightness").alias("mean_brightness"), confidence.alias("confidence"),
    )


def comparison_summary(components: DataFrame, shares: DataFrame, errors: DataFrame, luminance: DataFrame) -> DataFrame:
    """A row for each case of any of four tables, for comparisons between cases; what a case has not is null.

    ``components`` (residual, correlation), ``shares`` (cumulative share of each component: how many it takes to 90 %), ``errors`` (zscore, percentile), ``luminance`` (std).
    """
    mean = lambda df, **names: df.groupBy("case_id").agg(*[F.avg(c).alias(n) for n, c in names.items()])
    parts = [
        mean(components, residual_mean="residual", correlation_mean="correlation"), shares.groupBy("case_id").agg((F.count_if(F.col("cumulative") < 0.9) + 1).alias("components_for_90")),
        mean(errors, zscore_mean="zscore", percentile_mean="percentile"), mean(luminance, luminance_std_mean="std"),
    ]
    found = parts[0]
    for part in parts[1:]:
        found = found.join(part, "case_id", "full_outer")
    return found
