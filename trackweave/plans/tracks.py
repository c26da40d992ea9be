"""Queries over tracks: motion, segments, nearest rows, quality, samples, folds."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from trackweave.operators import joins, metrics, sampling, series
from trackweave.plans.sql import SERIES, TRACK, q
from trackweave.sources import fixtures as X


def rounded(*names, places=8):
    return [F.round(n, places).alias(n) for n in names]


def q01_motion_timeseries(spark, sf):
    return series.with_motion(X.valid_tracks(spark, sf)).select("case_id", "frame", F.col("frame").cast("double").alias("timestamp"), "status", *rounded("cx", "cy", "velocity", "acceleration"))


Q01 = q(SERIES, "SELECT case_id, frame, CAST(frame AS DOUBLE) AS timestamp, status, round(cx, 8) AS cx, round(cy, 8) AS cy, round(velocity, 8) AS velocity, round(acceleration, 8) AS acceleration FROM motion")

SUMMARY = ["mean_velocity", "median_velocity", "max_velocity", "mean_acceleration", "max_acceleration", "mean_bbox_area", "continuity", "area_variation", "jitter", "stability"]


def q02_motion_summary(spark, sf):
    track = X.tracks(spark, sf)
    lost = track.groupBy("case_id").agg(F.count("*").alias("total_frames"), F.count_if(F.col("status").isin(*X.LOST_STATES)).alias("lost_frames"))
    return metrics.motion_summary(X.valid_tracks(spark, sf)).join(lost, "case_id").select("case_id", "total_frames", "valid_tracked_frames", "lost_frames", *rounded(*SUMMARY))


Q02 = q(SERIES, """
, g AS (SELECT case_id, count(*) AS valid_tracked_frames, coalesce(avg(velocity) FILTER (rn > 1), 0.0) AS mean_velocity, coalesce(quantile_cont(velocity, 0.5) FILTER (rn > 1), 0.0) AS median_velocity, coalesce(max(velocity) FILTER (rn > 1), 0.0) AS max_velocity,
  coalesce(avg(abs(acceleration)) FILTER (rn > 2), 0.0) AS mean_acceleration, coalesce(max(abs(acceleration)) FILTER (rn > 2), 0.0) AS max_acceleration, avg(CAST(w * h AS DOUBLE)) AS mean_bbox_area, stddev_pop(CAST(w * h AS DOUBLE)) AS sa,
  coalesce(stddev_pop(velocity) FILTER (rn > 1), 0.0) AS sv, count(*) / (max(frame) - min(frame) + 1) AS continuity FROM motion GROUP BY case_id),
s AS (SELECT *, sa / greatest(1.0, mean_bbox_area) AS area_variation, CASE WHEN mean_velocity > 0 THEN sv / greatest(1e-6, mean_velocity) ELSE 0.0 END AS jitter FROM g),
t AS (SELECT case_id, count(*) AS total_frames, count(*) FILTER (status IN ('TRACK_LOST', 'TRACK LOST', 'LOW_CONFIDENCE')) AS lost_frames FROM track GROUP BY case_id)
SELECT case_id, total_frames, valid_tracked_frames, lost_frames, round(mean_velocity, 8) AS mean_velocity, round(median_velocity, 8) AS median_velocity, round(max_velocity, 8) AS max_velocity, round(mean_acceleration, 8) AS mean_acceleration, round(max_acceleration, 8) AS max_acceleration,
  round(mean_bbox_area, 8) AS mean_bbox_area, round(continuity, 8) AS continuity, round(area_variation, 8) AS area_variation, round(jitter, 8) AS jitter, round(greatest(0.0, least(1.0, continuity / (1 + area_variation + jitter))), 8) AS stability FROM s JOIN t USING (case_id)""")

NAMES = {"tracked": ("tracked", "TRACKING_ACTIVE"), "recovered": ("auto_recovered",), "low": ("LOW_CONFIDENCE",), "predicted": ("predicted_only",), "lost": ("TRACK_LOST", "lost")}


def q05_track_quality(spark, sf):
    return metrics.track_quality(X.tracks(spark, sf), NAMES).select("case_id", "total", "tracked", "recovered", "low", "predicted", "lost", "recommendation", *rounded("mean_confidence", "min_confidence"))


QUALITY = TRACK + """,
counted AS (SELECT case_id, count(*) AS total, count(*) FILTER (status IN ('tracked', 'TRACKING_ACTIVE')) AS tracked, count(*) FILTER (status = 'auto_recovered') AS recovered, count(*) FILTER (status = 'LOW_CONFIDENCE') AS low, count(*) FILTER (status = 'predicted_only') AS predicted,
  count(*) FILTER (status IN ('TRACK_LOST', 'lost')) AS lost, avg(confidence) AS mean_confidence, min(confidence) AS min_confidence FROM track GROUP BY case_id)"""
Q05 = q(QUALITY, """SELECT case_id, total, tracked, recovered, low, predicted, lost, CASE WHEN tracked + recovered = 0 OR (lost + predicted) / total > 0.5 THEN 'tracking_failed' WHEN low > (tracked + recovered) * 0.35 OR recovered > (tracked + recovered) * 0.35 THEN 'tracking_needs_review'
  WHEN recovered > 0 OR low > 0 THEN 'tracking_usable_with_review' WHEN (tracked + recovered) / total > 0.65 THEN 'tracking_good' ELSE 'tracking_usable_with_review' END AS recommendation, round(mean_confidence, 8) AS mean_confidence, round(min_confidence, 8) AS min_confidence FROM counted""")

SCORES = ["motion", "contrast", "continuity", "persistence", "size_stability", "artifact", "dark", "confidence"]


def q06_track_score(spark, sf):
    return metrics.track_score(X.valid_tracks(spark, sf), 1440, X.WIDTH, X.HEIGHT).select("case_id", "detected", "start_frame", "end_frame", "edge_hits", "reason", "tracking_status", *rounded(*SCORES, places=6))


Q06 = q(SERIES, """
, g AS (SELECT case_id, count(*) AS detected, min(frame) AS start_frame, max(frame) AS end_frame, coalesce(avg(velocity) FILTER (rn > 1), 0.0) AS motion, avg(confidence * 40) AS contrast, avg(CAST(w * h AS DOUBLE)) AS a, stddev_pop(CAST(w * h AS DOUBLE)) AS s,
  count(*) FILTER (x <= 640 * 0.03 OR y <= 360 * 0.03 OR x + w >= 640 * (1 - 0.03) OR y + h >= 360 * (1 - 0.03)) AS edge_hits, avg(w / h) AS aspect FROM motion GROUP BY case_id),
p AS (SELECT *, detected / (end_frame - start_frame + 1) AS continuity, detected / 1440.0 AS persistence, 1 / (1 + s / greatest(1.0, a)) AS size_stability, least(1.0, edge_hits / detected + CASE WHEN a > 640 * 360 * 0.07 THEN 0.25 ELSE 0.0 END) AS artifact, least(1.0, aspect / 5 * 0.25) AS dark FROM g),
c AS (SELECT *, greatest(0.0, least(1.0, 0.30 * least(1.0, continuity) + 0.24 * least(1.0, persistence * 8) + 0.13 * least(1.0, contrast / 40) + 0.12 * least(1.0, motion / 12) + 0.11 * least(1.0, size_stability) + 0.18 * dark - 0.28 * artifact)) AS confidence FROM p)
SELECT case_id, detected, start_frame, end_frame, edge_hits, CASE WHEN detected < 5 THEN 'too few frames' WHEN artifact > 0.55 THEN 'edge risk' WHEN confidence >= 0.55 THEN 'selected' WHEN confidence >= 0.35 THEN 'low confidence' ELSE 'weak' END AS reason,
  CASE WHEN confidence >= 0.55 AND detected >= 8 AND artifact < 0.55 THEN 'tracking_candidate_ready' ELSE 'tracking_low_confidence' END AS tracking_status, round(motion, 6) AS motion, round(contrast, 6) AS contrast, round(continuity, 6) AS continuity, round(persistence, 6) AS persistence,
  round(size_stability, 6) AS size_stability, round(artifact, 6) AS artifact, round(dark, 6) AS dark, round(confidence, 6) AS confidence FROM c""")


def _bright(spark, sf):
    return series.flag_at_percentile(X.tracks(spark, sf), "cx", 0.75, "bright")


def q07_segments(spark, sf):
    wide = series.dilate(_bright(spark, sf), "bright", 8, "wide")
    light = series.segments(wide, "wide", 2).withColumn("reason", F.lit("light"))
    dark = series.segments(wide.withColumn("rest", ~F.col("wide")), "rest", 2)
    first = F.row_number().over(Window.partitionBy("case_id").orderBy("start_frame")) == 1
    return light.unionByName(dark.withColumn("reason", F.when(first, "before light").otherwise("after light")))


WIDE = TRACK + """,
bright AS (SELECT *, cx >= quantile_cont(cx, 0.75) OVER (PARTITION BY case_id) AS bright FROM track),
wide AS (SELECT *, max(CAST(bright AS INTEGER)) OVER (PARTITION BY case_id ORDER BY frame RANGE BETWEEN 8 PRECEDING AND 8 FOLLOWING) = 1 AS wide FROM bright),
runs AS (SELECT case_id, wide, frame, row_number() OVER (PARTITION BY case_id ORDER BY frame) - row_number() OVER (PARTITION BY case_id, wide ORDER BY frame) AS island FROM wide),
segs AS (SELECT case_id, wide, min(frame) AS start_frame, max(frame) AS end_frame, count(*) AS n FROM runs GROUP BY case_id, wide, island HAVING count(*) >= 2)"""
Q07 = q(WIDE, """SELECT case_id, start_frame, end_frame, n, CASE WHEN wide THEN 'light' WHEN row_number() OVER (PARTITION BY case_id, wide ORDER BY start_frame) = 1 THEN 'before light' ELSE 'after light' END AS reason FROM segs""")


def q08_segment_expand_except(spark, sf):
    wide = series.dilate(_bright(spark, sf), "bright", 8, "wide")
    return series.outside_segments(wide.select("case_id", "frame", "wide"), "wide", 2).select("case_id", "frame")


Q08 = q(WIDE, "SELECT case_id, frame FROM wide w WHERE NOT EXISTS (SELECT 1 FROM segs s WHERE s.wide AND s.case_id = w.case_id AND w.frame BETWEEN s.start_frame AND s.end_frame)")


def _probes(spark, sf):
    ends = X.tracks(spark, sf).groupBy("case_id").agg(F.min("frame").alias("a"), F.max("frame").alias("b"))
    return ends.select("case_id", F.explode(F.sequence("a", "b", F.lit(97).cast("long"))).alias("frame"))


def q09_nearest_box(spark, sf):
    return joins.nearest_frame(_probes(spark, sf), X.valid_tracks(spark, sf), 10, ["x", "y", "w", "h"])


Q09 = q(TRACK, """
, ends AS (SELECT case_id, min(frame) AS a, max(frame) AS b FROM track GROUP BY case_id), probe AS (SELECT case_id, unnest(generate_series(a, b, 97)) AS frame FROM ends),
near AS (SELECT p.case_id, p.frame, arg_min({'near_frame': v.frame, 'x': v.x, 'y': v.y, 'w': v.w, 'h': v.h}, (abs(v.frame - p.frame), v.frame)) AS b FROM probe p JOIN valid v ON v.case_id = p.case_id AND v.frame BETWEEN p.frame - 10 AND p.frame + 10 GROUP BY p.case_id, p.frame)
SELECT p.case_id, p.frame, b.near_frame, b.x, b.y, b.w, b.h FROM probe p LEFT JOIN near n ON n.case_id = p.case_id AND n.frame = p.frame""")


def q10_hint_match(spark, sf):
    track = X.tracks(spark, sf)
    hints = track.groupBy("case_id").agg((F.floor((F.min("frame") + F.max("frame")) / 2)).alias("hint_frame"), F.min("x").alias("hx"), F.min("y").alias("hy"), F.max("w").alias("hw"), F.max("h").alias("hh"))
    return joins.hinted(hints, X.valid_tracks(spark, sf), 600).select("case_id", "hint_frame", "frame", F.round("score", 6).alias("score"))


Q10 = q(TRACK, """
, hint AS (SELECT case_id, CAST(floor((min(frame) + max(frame)) / 2) AS BIGINT) AS hint_frame, min(x) AS hx, min(y) AS hy, max(w) AS hw, max(h) AS hh FROM track GROUP BY case_id),
both_ AS (SELECT t.case_id, t.frame, hint_frame, abs(t.frame - hint_frame) AS gap, CAST(greatest(0, least(x + w, hx + hw) - greatest(x, hx)) * greatest(0, least(y + h, hy + hh) - greatest(y, hy)) AS DOUBLE) AS i, w * h + hw * hh AS areas, sqrt(power(x + w / 2.0 - (hx + hw / 2.0), 2) + power(y + h / 2.0 - (hy + hh / 2.0), 2)) AS d
  FROM valid t JOIN hint USING (case_id) WHERE abs(t.frame - hint_frame) <= 600),
scored AS (SELECT *, greatest(CASE WHEN areas - i > 0 THEN i / (areas - i) ELSE 0.0 END, 0.65 / (1 + d / 80)) - gap * 0.01 AS score FROM both_)
SELECT case_id, hint_frame, arg_max(frame, (score, -gap, -frame)) AS frame, round(max(score), 6) AS score FROM scored WHERE score > 0 GROUP BY case_id, hint_frame""")


def q11_envelope(spark, sf):
    return metrics.envelope(X.valid_tracks(spark, sf))


Q11 = q(TRACK, "SELECT case_id, min(x) AS x, min(y) AS y, max(x + w) - min(x) AS w, max(y + h) - min(y) AS h FROM valid GROUP BY case_id")


def q12_spectral_summary(spark, sf):
    return metrics.luminance_summary(X.valid_tracks(spark, sf), "cx").select("case_id", "n", *rounded("mean_luminance", "luminance_std", "luminance_min", "luminance_max", "flicker_index", "duration"))


Q12 = q(TRACK, """SELECT case_id, count(*) AS n, round(avg(cx), 8) AS mean_luminance, round(stddev_pop(cx), 8) AS luminance_std, round(min(cx), 8) AS luminance_min, round(max(cx), 8) AS luminance_max, round(stddev_pop(cx) / greatest(1e-6, avg(cx)), 8) AS flicker_index,
  round(CAST(max(frame) - min(frame) AS DOUBLE), 8) AS duration FROM valid GROUP BY case_id""")


def q13_temporal_fft(spark, sf):
    return series.temporal_spectrum(X.valid_tracks(spark, sf), "cx").select("case_id", "n", *rounded("peak_frequency", "peak_strength", "entropy", places=4))


Q13 = q(TRACK, """
, rows_ AS (SELECT case_id, row_number() OVER (PARTITION BY case_id ORDER BY frame) - 1 AS i, count(*) OVER (PARTITION BY case_id) AS n, cx - avg(cx) OVER (PARTITION BY case_id) AS x FROM valid),
weighted AS (SELECT case_id, i, n, x * (0.5 - 0.5 * cos(2 * pi() * i / (n - 1))) AS x FROM rows_ WHERE n >= 4),
bins AS (SELECT *, unnest(range(1, n // 2 + 1)) AS k FROM weighted),
power_ AS (SELECT case_id, n, k, power(sum(x * cos(2 * pi() * k * i / n)), 2) + power(sum(x * sin(2 * pi() * k * i / n)), 2) AS p FROM bins GROUP BY case_id, n, k),
shares AS (SELECT *, p / (sum(p) OVER (PARTITION BY case_id) + 1e-9) AS share FROM power_)
SELECT case_id, n, round(arg_max(k, (p, -k)) / n, 4) AS peak_frequency, round(max(share), 4) AS peak_strength, round(-sum(CASE WHEN share > 0 THEN share * log2(share) ELSE 0.0 END) / greatest(1.0, log2(n // 2 + 1)), 4) AS entropy FROM shares GROUP BY case_id, n
UNION ALL SELECT DISTINCT case_id, n, 0.0, 0.0, 0.0 FROM rows_ WHERE n < 4""")


def _contrast(spark, sf):
    return X.valid_tracks(spark, sf).select("case_id", "frame", F.col("cx").alias("roi"), F.col("cy").alias("background"))


def q14_thermal_summary(spark, sf):
    return metrics.contrast_summary(_contrast(spark, sf)).select("case_id", *rounded("delta_mean", "delta_std", "contrast_index", "stability"))


PEAK = TRACK + """,
delta AS (SELECT case_id, frame, cx - cy AS delta, abs(cx - cy) AS size, cy AS background FROM valid),
peak AS (SELECT *, size >= quantile_cont(size, 0.95) OVER (PARTITION BY case_id) AS peak FROM delta)"""
Q14 = q(PEAK, "SELECT case_id, round(avg(delta), 8) AS delta_mean, round(stddev_pop(delta), 8) AS delta_std, round(avg(size) / greatest(1.0, avg(background)), 8) AS contrast_index, round(1 / (1 + stddev_pop(delta) / greatest(1e-6, abs(avg(delta)))), 8) AS stability FROM peak GROUP BY case_id")


def q15_peak_frames(spark, sf):
    return metrics.contrast_summary(_contrast(spark, sf)).select("case_id", F.array_join(F.col("peak_frames").cast("array<string>"), ",").alias("peak_frames"))


Q15 = q(PEAK, "SELECT case_id, array_to_string(list_sort(list(frame) FILTER (peak))[1:20], ',') AS peak_frames FROM peak GROUP BY case_id")


def q34_even_sample(spark, sf):
    return sampling.evenly(X.valid_tracks(spark, sf), 24).select("case_id", "frame")


NUMBERED = TRACK + ", numbered AS (SELECT case_id, frame, row_number() OVER (PARTITION BY case_id ORDER BY frame) - 1 AS i, count(*) OVER (PARTITION BY case_id) AS n FROM valid)"
Q34 = q(NUMBERED, "SELECT case_id, frame FROM numbered WHERE n <= 24 OR list_contains(list_transform(range(0, 24), lambda j: CAST(round_even(j * (n - 1) / 23.0, 0) AS BIGINT)), i)")


def q35_stride_sample(spark, sf):
    return sampling.strided(X.valid_tracks(spark, sf), 30).select("case_id", "frame")


Q35 = q(NUMBERED, "SELECT case_id, frame FROM numbered WHERE i % greatest(1, n // 30) = 0 AND i // greatest(1, n // 30) < 30")


def validations(spark, sf):
    """(case_id, validated, correct, real): three-way human decisions made from the case number; null is undecided."""
    k = F.col("case_id")
    return X.tracks(spark, sf).select("case_id").distinct().select("case_id", F.when(k % 7 != 3, k % 3 != 0).alias("validated"), F.when(k % 5 != 1, True).alias("correct"), (k % 11 != 0).alias("real"))


VALIDATION = "validation AS (SELECT case_id, CASE WHEN case_id % 7 <> 3 THEN case_id % 3 <> 0 END AS validated, CASE WHEN case_id % 5 <> 1 THEN true END AS correct, case_id % 11 <> 0 AS real FROM (SELECT DISTINCT case_id FROM track))"


def q46_gate_semi(spark, sf):
    gated = joins.gate(X.valid_tracks(spark, sf), validations(spark, sf), "validated", "correct", "real")
    return gated.groupBy("case_id").agg(F.count("*").alias("rows_passed"))


Q46 = q(f"{TRACK}, {VALIDATION}", "SELECT case_id, count(*) AS rows_passed FROM valid SEMI JOIN (SELECT case_id FROM validation WHERE validated AND correct AND real) USING (case_id) GROUP BY case_id")


def q47_consistency_violations(spark, sf):
    quality = metrics.track_quality(X.tracks(spark, sf), NAMES)
    motion = q02_motion_summary(spark, sf).select("case_id", "valid_tracked_frames", "lost_frames")
    both = quality.join(motion, "case_id", "full_outer")
    rules = F.array_compact(F.array(F.when(F.col("lost_frames").isNull(), F.lit("no_motion_record")), F.when(F.col("lost") != F.col("lost_frames"), F.lit("lost_frames_differ")), F.when(F.col("valid_tracked_frames") != F.col("tracked") + F.col("recovered"), F.lit("valid_frames_differ"))))
    return both.withColumn("rule", F.explode(rules)).select("case_id", "rule", "lost", "lost_frames")


Q47 = q(QUALITY, """
, motion_ AS (SELECT case_id, v.n AS valid_tracked_frames, l.n AS lost_frames FROM (SELECT case_id, count(*) AS n FROM valid GROUP BY case_id) v JOIN (SELECT case_id, count(*) FILTER (status IN ('TRACK_LOST', 'TRACK LOST', 'LOW_CONFIDENCE')) AS n FROM track GROUP BY case_id) l USING (case_id)),
joined AS (SELECT * FROM counted FULL JOIN motion_ USING (case_id))
SELECT case_id, 'no_motion_record' AS rule, lost, lost_frames FROM joined WHERE lost_frames IS NULL UNION ALL SELECT case_id, 'lost_frames_differ', lost, lost_frames FROM joined WHERE lost <> lost_frames UNION ALL SELECT case_id, 'valid_frames_differ', lost, lost_frames FROM joined WHERE valid_tracked_frames <> tracked + recovered""")


def q48_histogram(spark, sf):
    return metrics.histogram(X.valid_tracks(spark, sf), "cx", 24)


Q48 = q(TRACK, """
, ends AS (SELECT case_id, min(cx) AS low, max(cx) AS high FROM valid GROUP BY case_id)
SELECT case_id, CAST(CASE WHEN high > low THEN least(23, floor((cx - low) / (high - low) * 24)) ELSE 0 END AS INTEGER) AS bin, count(*) AS n FROM valid JOIN ends USING (case_id) GROUP BY 1, 2""")


def q49_ema_fold(spark, sf):
    folded = series.smoothed(X.valid_tracks(spark, sf), "x", 0.35)
    shown = X.tracks(spark, sf).select("case_id", "frame").join(folded, ["case_id", "frame"], "left")
    return shown.select("case_id", "frame", F.col("ema"), series.carried("ema").alias("carried"))


Q49 = "WITH RECURSIVE " + TRACK.strip() + """,
numbered AS (SELECT case_id, frame, CAST(x AS DOUBLE) AS v, row_number() OVER (PARTITION BY case_id ORDER BY frame) AS rn FROM valid),
fold AS (SELECT case_id, frame, rn, round_even(v, 0) AS ema FROM numbered WHERE rn = 1 UNION ALL SELECT n.case_id, n.frame, n.rn, round_even(f.ema * (1 - 0.35) + n.v * 0.35, 0) FROM fold f JOIN numbered n ON n.case_id = f.case_id AND n.rn = f.rn + 1)
SELECT t.case_id, t.frame, f.ema, last_value(f.ema IGNORE NULLS) OVER (PARTITION BY t.case_id ORDER BY t.frame ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS carried FROM track t LEFT JOIN fold f ON f.case_id = t.case_id AND f.frame = t.frame"""


def q50_lost_streak(spark, sf):
    return series.streaks(X.tracks(spark, sf), F.col("status").isin(*X.LOST_STATES)).select("case_id", "frame", "status", "streak")


Q50 = q(TRACK, """
, blocks AS (SELECT *, status IN ('TRACK_LOST', 'TRACK LOST', 'LOW_CONFIDENCE') AS lost FROM track),
blocked AS (SELECT *, sum(CASE WHEN lost THEN 0 ELSE 1 END) OVER (PARTITION BY case_id ORDER BY frame) AS block FROM blocks)
SELECT case_id, frame, status, CAST(sum(CASE WHEN lost THEN 1 ELSE 0 END) OVER (PARTITION BY case_id, block ORDER BY frame) AS BIGINT) AS streak FROM blocked""")


def q58_masked_set_ops(spark, sf):
    track = X.tracks(spark, sf)
    bright, early = series.flag_at_percentile(track, "cx", 0.9).where("flag"), track.where("confidence < 0.8")
    tagged = bright.select("case_id", "frame", F.lit("bright").alias("source")).unionByName(early.select("case_id", "frame", F.lit("unsure").alias("source")))
    both = bright.select("case_id", "frame").intersect(early.select("case_id", "frame")).withColumn("source", F.lit("both"))
    return tagged.union(both).groupBy("case_id", "source").agg(F.count("*").alias("n"))


Q58 = q(TRACK, """
, bright AS (SELECT case_id, frame FROM (SELECT *, cx >= quantile_cont(cx, 0.9) OVER (PARTITION BY case_id) AS flag FROM track) WHERE flag), unsure AS (SELECT case_id, frame FROM track WHERE confidence < 0.8)
SELECT case_id, source, count(*) AS n FROM (SELECT *, 'bright' AS source FROM bright UNION ALL SELECT *, 'unsure' FROM unsure UNION ALL SELECT *, 'both' FROM (SELECT * FROM bright INTERSECT SELECT * FROM unsure)) GROUP BY 1, 2""")


def q59_frame_window_join(spark, sf):
    track = X.valid_tracks(spark, sf)
    ends = track.groupBy("case_id").agg((F.min("frame") + 10).alias("a"), F.max("frame").alias("b"))
    return track.join(ends, "case_id").where((F.col("frame") >= F.col("a")) & (F.col("frame") < F.col("b")) & ((F.col("frame") - F.col("a")) % 3 == 0)).select("case_id", "frame", "x", "y")


Q59 = q(TRACK, "SELECT case_id, frame, x, y FROM valid JOIN (SELECT case_id, min(frame) + 10 AS a, max(frame) AS b FROM valid GROUP BY case_id) USING (case_id) WHERE frame >= a AND frame < b AND (frame - a) % 3 = 0")


def q68_trail_window(spark, sf):
    w = Window.partitionBy("case_id").orderBy("frame")
    track = X.valid_tracks(spark, sf)
    return track.select("case_id", "frame", F.count("*").over(w.rangeBetween(-450, 0)).alias("trail"), F.round(F.avg("cx").over(w.rowsBetween(-12, -1)), 8).alias("recent_cx"), F.round(F.coalesce(F.hypot(F.col("cx") - F.lag("cx").over(w), F.col("cy") - F.lag("cy").over(w)), F.lit(0.0)), 8).alias("step"))


Q68 = q(TRACK, """SELECT case_id, frame, count(*) OVER (w RANGE BETWEEN 450 PRECEDING AND CURRENT ROW) AS trail, round(avg(cx) OVER (w ROWS BETWEEN 12 PRECEDING AND 1 PRECEDING), 8) AS recent_cx,
  round(coalesce(sqrt(power(cx - lag(cx) OVER w, 2) + power(cy - lag(cy) OVER w, 2)), 0.0), 8) AS step FROM valid WINDOW w AS (PARTITION BY case_id ORDER BY frame)""")


def q72_metric_rollup(spark, sf):
    moved = series.with_motion(X.valid_tracks(spark, sf))
    by_state = moved.groupBy("status").agg(F.count("*").alias("n"), F.countDistinct("case_id").alias("cases"), F.avg("velocity").alias("mean_velocity"), F.max("velocity").alias("max_velocity"), F.avg(F.col("w") * F.col("h")).alias("mean_area"), F.count_if(F.col("velocity") > 1).alias("fast"))
    return by_state.select("status", "n", "cases", "fast", *rounded("mean_velocity", "max_velocity", "mean_area"))


Q72 = q(SERIES, "SELECT status, count(*) AS n, count(DISTINCT case_id) AS cases, count(*) FILTER (velocity > 1) AS fast, round(avg(velocity), 8) AS mean_velocity, round(max(velocity), 8) AS max_velocity, round(avg(w * h), 8) AS mean_area FROM motion GROUP BY status")

QUERIES = {k: v for k, v in list(globals().items()) if k.startswith("q") and k[1:3].isdigit()}
ORACLE_SQL = {k: globals()["Q" + k[1:3]] for k in QUERIES}
