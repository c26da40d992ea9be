"""Queries over crops: projections, stacks, template and class errors, patches, rings."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from trackweave.functions import vectors as V
from trackweave.operators import crops as C
from trackweave.operators import metrics, sampling, series
from trackweave.plans.sql import PATCH, q
from trackweave.sources import fixtures as X


def rounded(*names, places=6):
    return [F.round(n, places).alias(n) for n in names]


def q19_missing_classes(spark, sf):
    found = metrics.counts_with_zeros(X.patches(spark, sf), "class_label", [*X.CLASSES, "reflection"], "case_id")
    return found.select("case_id", "class_label", "n", (F.col("n") == 0).alias("missing"))


Q19 = q(PATCH, """
, names AS (SELECT unnest(['object', 'near_background', 'far_background', 'compression_noise', 'random_background', 'hud_artifact', 'dark_region', 'bright_region', 'reflection']) AS class_label)
SELECT case_id, class_label, count(frame) AS n, count(frame) = 0 AS missing FROM (SELECT * FROM (SELECT DISTINCT case_id FROM patch), names) LEFT JOIN patch USING (case_id, class_label) GROUP BY case_id, class_label""")


def q20_projections(spark, sf):
    return C.projections(X.patches(spark, sf)).select("case_id", "pos", *rounded("mean", "low", "high", "range", "mean_step"))


Q20 = q(PATCH, """
, stepped AS (SELECT *, abs(val - lag(val) OVER (PARTITION BY case_id, pos ORDER BY frame)) AS step FROM pixel)
SELECT case_id, CAST(pos AS INTEGER) AS pos, round(avg(val), 6) AS mean, round(min(val), 6) AS low, round(max(val), 6) AS high, round(max(val) - min(val), 6) AS range, round(coalesce(avg(step), 0.0), 6) AS mean_step FROM stepped GROUP BY case_id, pos""")
LAPLACE = PATCH + """,
lap AS (SELECT case_id, frame, v, v[i] + v[i + 2] + v[i - 7] + v[i + 9] - 4 * v[i + 1] AS l FROM (SELECT *, unnest([y * 8 + x FOR y IN range(1, 7) FOR x IN range(1, 7)]) AS i FROM patch)),
sharp AS (SELECT case_id, frame, round(var_pop(l), 10) AS sharpness FROM lap GROUP BY case_id, frame)"""
LAPLACE = LAPLACE.replace("[y * 8 + x FOR y IN range(1, 7) FOR x IN range(1, 7)]", "list_filter(range(9, 55), lambda p: p % 8 BETWEEN 1 AND 6)")


def q21_topk_stack(spark, sf):
    return C.sharpest_stack(X.patches(spark, sf)).select("case_id", "pos", *rounded("mean", "median"))


Q21 = q(LAPLACE, """
, best AS (SELECT case_id, frame FROM (SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY sharpness DESC, frame) AS rank FROM sharp) WHERE rank <= 64)
SELECT case_id, CAST(pos AS INTEGER) AS pos, round(avg(val), 6) AS mean, round(quantile_cont(val, 0.5), 6) AS median FROM pixel JOIN best USING (case_id, frame) GROUP BY case_id, pos""")


def q22_sharpness(spark, sf):
    return X.patches(spark, sf).select("case_id", "frame", F.round(C.sharpness(F.col("v")), 6).alias("sharpness"), F.round(V.std(F.col("v")), 6).alias("contrast"))


Q22 = q(LAPLACE, "SELECT s.case_id, s.frame, round(s.sharpness, 6) AS sharpness, round(p.contrast, 6) AS contrast FROM sharp s JOIN (SELECT frame, stddev_pop(val) AS contrast FROM pixel GROUP BY frame) p USING (frame)")


def q23_corr_mean_signature(spark, sf):
    rows = X.patches(spark, sf).where("class_label is not null")
    joined = rows.join(C.mean_crop(rows, "class_label"), "class_label").withColumn("r", V.correlation(F.col("v"), F.col("template")))
    return joined.groupBy("class_label").agg(F.round(F.avg("r"), 6).alias("mean_r"), F.round(F.stddev_pop("r"), 6).alias("std_r"), F.count("r").alias("n"))


Q23 = q(PATCH, """
, m AS (SELECT class_label, pos, avg(val) AS t FROM pixel WHERE class_label IS NOT NULL GROUP BY 1, 2), r AS (SELECT class_label, frame, corr(val, t) AS r FROM pixel JOIN m USING (class_label, pos) GROUP BY 1, 2)
SELECT class_label, round(avg(r), 6) AS mean_r, round(stddev_pop(r), 6) AS std_r, count(r) AS n FROM r GROUP BY 1""")


def q24_corr_prev(spark, sf):
    before = F.lag("v").over(Window.partitionBy("case_id").orderBy("frame"))
    return X.patches(spark, sf).withColumn("before", before).select("case_id", "frame", F.round(V.correlation(F.col("v"), F.col("before")), 6).alias("r"))


Q24 = q(PATCH, """
, b AS (SELECT *, lag(v) OVER (PARTITION BY case_id ORDER BY frame) AS before FROM patch), e AS (SELECT case_id, frame, unnest(v) AS x, unnest(before) AS y FROM b)
SELECT case_id, frame, round(corr(x, y), 6) AS r FROM e GROUP BY 1, 2""")
TEMPLATE = PATCH + """,
t AS (SELECT case_id, pos, avg(val) AS t FROM pixel WHERE class_label IN ('near_background', 'far_background', 'random_background') GROUP BY 1, 2),
err AS (SELECT case_id, frame, class_label, avg((val - t) * (val - t)) AS error FROM pixel JOIN t USING (case_id, pos) GROUP BY 1, 2, 3),
base AS (SELECT case_id, count(*) AS n, avg(error) AS m, stddev_pop(error) AS std FROM err WHERE class_label IN ('near_background', 'far_background', 'random_background') GROUP BY 1)"""


def _scores(spark, sf):
    return C.template_scores(X.patches(spark, sf), F.coalesce(F.col("class_label").isin(*C.BACKGROUNDS), F.lit(False)), F.coalesce(F.col("class_label") == "object", F.lit(False)))


def q25_zscore_template(spark, sf):
    from trackweave.functions.numbers import zscore_class

    return _scores(spark, sf).select("case_id", "frame", "n", zscore_class(F.col("zscore"), F.col("std"), F.col("n"), F.col("percentile"), F.lit("near")).alias("class"), *rounded("error", "zscore", "percentile", "ratio", places=5))


Q25 = q(TEMPLATE, """
, scored AS (SELECT o.case_id, o.frame, b.n, b.std, o.error, (o.error - b.m) / (b.std + 1e-12) AS zscore, (SELECT count(*) FROM err e WHERE e.case_id = o.case_id AND e.class_label IN ('near_background', 'far_background', 'random_background') AND e.error < o.error) * 100.0 / b.n AS percentile, o.error / (b.m + 1e-12) AS ratio
  FROM err o JOIN base b USING (case_id) WHERE o.class_label = 'object')
SELECT case_id, frame, n, CASE WHEN n < 30 THEN 'discard' WHEN std < 1e-5 THEN 'unstable' WHEN zscore > 100 THEN 'unstable' WHEN zscore > 20 OR percentile >= 99.5 THEN 'exploratory' ELSE 'public_safe' END AS class, round(error, 5) AS error, round(zscore, 5) AS zscore, round(percentile, 5) AS percentile, round(ratio, 5) AS ratio FROM scored""")


def q26_zscore_sweep(spark, sf):
    return C.sweep(X.patches(spark, sf)).select("strategy", "case_id", "frame", "n", "class", *rounded("error", "zscore", "percentile", places=5))


Q26 = q(PATCH, """
, stat AS (SELECT frame, avg(val) AS mean, max(val) AS high FROM pixel GROUP BY frame),
step AS (SELECT case_id, frame, class_label, v, lag(v) OVER (PARTITION BY case_id ORDER BY frame) AS before FROM patch),
pairs AS (SELECT case_id, frame, unnest(v) AS x, unnest(before) AS y FROM step WHERE before IS NOT NULL), acts AS (SELECT frame, round(avg(abs(x - y)), 10) AS activity FROM pairs GROUP BY frame),
act AS (SELECT case_id, frame, class_label, v, coalesce(activity, 0.0) AS activity FROM patch LEFT JOIN acts USING (frame)),
quiet AS (SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY activity, frame) <= greatest(10, count(*) OVER (PARTITION BY case_id) // 10) AS quiet FROM act),
full_ AS (SELECT q.*, mean, high, coalesce(class_label, 'none') <> 'object' AS outside FROM quiet q JOIN stat USING (frame)),
used AS (SELECT 'dark_strict' AS strategy, case_id, frame, v FROM full_ WHERE mean < 0.0 AND high < 0.3 UNION ALL SELECT 'corners', case_id, frame, v FROM full_ WHERE abs(v[1]) < 0.1 UNION ALL SELECT 'outside_roi', case_id, frame, v FROM full_ WHERE outside
  UNION ALL SELECT 'outside_central_zone', case_id, frame, v FROM full_ WHERE class_label IS NULL UNION ALL SELECT 'low_activity_frames', case_id, frame, v FROM full_ WHERE outside AND quiet UNION ALL SELECT 'all_frames_excluding_roi', case_id, frame, v FROM full_ WHERE outside
  UNION ALL SELECT 'exclude_saturated', case_id, frame, v FROM full_ WHERE outside AND high < 0.35 UNION ALL SELECT 'brightness_threshold_loose', case_id, frame, v FROM full_ WHERE outside AND mean < 0.01),
up AS (SELECT strategy, case_id, frame, unnest(range(0, 64)) AS pos, unnest(v) AS val FROM used), tm AS (SELECT strategy, case_id, pos, avg(val) AS t FROM up GROUP BY 1, 2, 3),
be AS (SELECT strategy, case_id, frame, round(avg((val - t) * (val - t)), 12) AS error FROM up JOIN tm USING (strategy, case_id, pos) GROUP BY 1, 2, 3),
bs AS (SELECT strategy, case_id, count(*) AS n, avg(error) AS m, stddev_pop(error) AS std FROM be GROUP BY 1, 2 HAVING count(*) >= 5),
oe AS (SELECT tm.strategy, p.case_id, p.frame, round(avg((val - t) * (val - t)), 12) AS error FROM pixel p JOIN tm ON tm.case_id = p.case_id AND tm.pos = p.pos WHERE class_label = 'object' GROUP BY 1, 2, 3),
z AS (SELECT o.strategy, o.case_id, o.frame, n, std, o.error, (o.error - m) / (std + 1e-12) AS zscore, (SELECT count(*) FROM be WHERE be.strategy = o.strategy AND be.case_id = o.case_id AND be.error < o.error) * 100.0 / n AS percentile FROM oe o JOIN bs USING (strategy, case_id))
SELECT strategy, case_id, frame, n, CASE WHEN n < 30 THEN 'discard' WHEN std < 1e-5 THEN 'unstable' WHEN zscore > 100 OR (zscore > 50 AND strategy IN ('dark_strict', 'brightness_threshold_loose')) THEN 'unstable' WHEN zscore > 20 OR percentile >= 99.5 THEN 'exploratory' ELSE 'public_safe' END AS class,
  round(error, 5) AS error, round(zscore, 5) AS zscore, round(percentile, 5) AS percentile FROM z""")


def q27_class_error(spark, sf):
    return C.class_errors(X.patches(spark, sf)).select("case_id", "n_control", *rounded("control_mean", "control_std", "background_mean", "object_mean", "mean_z", "max_z", "mean_percentile", "ratio_background", places=5))


Q27 = q(PATCH, """
, t AS (SELECT case_id, pos, avg(val) AS t FROM pixel WHERE class_label IS NOT NULL AND class_label <> 'object' GROUP BY 1, 2),
e AS (SELECT case_id, frame, class_label, avg((val - t) * (val - t)) AS error FROM pixel JOIN t USING (case_id, pos) WHERE class_label IS NOT NULL GROUP BY 1, 2, 3),
p AS (SELECT case_id, avg(error) AS control_mean, coalesce(stddev_samp(error), 1e-9) AS control_std, count(*) AS n_control FROM e WHERE class_label <> 'object' GROUP BY 1),
c AS (SELECT case_id, class_label, avg(error) AS m FROM e GROUP BY 1, 2), b AS (SELECT case_id, avg(m) FILTER (class_label IN ('near_background', 'far_background', 'random_background')) AS background_mean, max(m) FILTER (class_label = 'object') AS object_mean FROM c GROUP BY 1),
o AS (SELECT e.case_id, (error - control_mean) / (control_std + 1e-9) AS z, (SELECT count(*) FROM e k WHERE k.case_id = e.case_id AND k.class_label <> 'object' AND k.error <= e.error) * 100.0 / n_control AS pc FROM e JOIN p USING (case_id) WHERE class_label = 'object'),
g AS (SELECT case_id, avg(z) AS mean_z, max(z) AS max_z, avg(pc) AS mean_percentile FROM o GROUP BY 1)
SELECT case_id, n_control, round(control_mean, 5) AS control_mean, round(control_std, 5) AS control_std, round(background_mean, 5) AS background_mean, round(object_mean, 5) AS object_mean, round(mean_z, 5) AS mean_z, round(max_z, 5) AS max_z, round(mean_percentile, 5) AS mean_percentile, round(object_mean / (background_mean + 1e-9), 5) AS ratio_background
FROM p JOIN b USING (case_id) LEFT JOIN g USING (case_id)""")


def q36_hash_sample(spark, sf):
    rows = X.patches(spark, sf).where("class_label is not null").select("class_label", "frame")
    return sampling.split(sampling.drawn(rows, 20, 42, "frame", "class_label"), 80, 7, "frame")


Q36 = q(PATCH, """
SELECT class_label, frame, CASE WHEN CAST('0x' || substr(sha256('7|' || frame), 1, 2) AS INTEGER) * 100 < 80 * 256 THEN 'train' ELSE 'validation' END AS part
FROM (SELECT class_label, frame, row_number() OVER (PARTITION BY class_label ORDER BY sha256('42|' || frame), frame) AS r FROM patch WHERE class_label IS NOT NULL) WHERE r <= 20""")


def q53_background_ring(spark, sf):
    return C.ring_statistics(X.patches(spark, sf), (3, 3, 2, 2), 2, 0.05).select("case_id", "frame", *rounded("roi_mean", "ring_mean", "ring_std", "hot", "cold"))


Q53 = q(PATCH, """
, zone AS (SELECT *, pos % 8 BETWEEN 3 AND 4 AND pos // 8 BETWEEN 3 AND 4 AS roi FROM pixel WHERE pos % 8 BETWEEN 1 AND 6 AND pos // 8 BETWEEN 1 AND 6),
s AS (SELECT frame, avg(val) FILTER (roi) AS roi_mean, avg(val) FILTER (NOT roi) AS ring_mean, stddev_pop(val) FILTER (NOT roi) AS ring_std FROM zone GROUP BY frame)
SELECT case_id, frame, round(any_value(roi_mean), 6) AS roi_mean, round(any_value(ring_mean), 6) AS ring_mean, round(any_value(ring_std), 6) AS ring_std, round(avg(CAST(val > ring_mean + greatest(0.05, ring_std) AS INTEGER)), 6) AS hot, round(avg(CAST(val < ring_mean - greatest(0.05, ring_std) AS INTEGER)), 6) AS cold FROM zone JOIN s USING (frame) WHERE roi GROUP BY 1, 2""")


def q54_light_events(spark, sf):
    rows = X.patches(spark, sf).select("case_id", F.floor(F.col("frame") / 4).alias("frame"), V.share(F.col("v"), lambda x: x >= 0.25).alias("saturated"), F.round(V.percentile(F.col("v"), 0.995), 9).alias("high"))
    marked = series.flag_at_percentile(series.flag_at_percentile(rows, "saturated", 0.9, "a", 0.004), "high", 0.9, "b", 0.1).withColumn("light", F.col("a") | F.col("b"))
    return series.segments(series.dilate(marked, "light", 2), "light", 2)


Q54 = q(PATCH, """
, s AS (SELECT case_id, frame // 4 AS frame, avg(CAST(val >= 0.25 AS INTEGER)) AS saturated, round(quantile_cont(val, 0.995), 9) AS high FROM pixel GROUP BY case_id, frame),
m AS (SELECT *, saturated >= greatest(0.004, quantile_cont(saturated, 0.9) OVER (PARTITION BY case_id)) OR high >= greatest(0.1, quantile_cont(high, 0.9) OVER (PARTITION BY case_id)) AS flag FROM s),
d AS (SELECT case_id, frame, max(CAST(flag AS INTEGER)) OVER (PARTITION BY case_id ORDER BY frame RANGE BETWEEN 2 PRECEDING AND 2 FOLLOWING) = 1 AS light FROM m),
i AS (SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY frame) - row_number() OVER (PARTITION BY case_id, light ORDER BY frame) AS island FROM d)
SELECT case_id, min(frame) AS start_frame, max(frame) AS end_frame, count(*) AS n FROM i WHERE light GROUP BY case_id, island HAVING count(*) >= 2""")


def q66_frame_difference(spark, sf):
    rows = C.low_activity(X.patches(spark, sf))
    ranked = rows.withColumn("rank", F.row_number().over(Window.partitionBy("case_id").orderBy(F.desc("activity"), "frame")))
    return ranked.select("case_id", "frame", "quiet", F.round("activity", 6).alias("activity"), (F.col("rank") <= 12).alias("top"))


Q66 = q(PATCH, """
, step AS (SELECT case_id, frame, v, lag(v) OVER (PARTITION BY case_id ORDER BY frame) AS before FROM patch), pairs AS (SELECT frame, unnest(v) AS x, unnest(before) AS y FROM step WHERE before IS NOT NULL), acts AS (SELECT frame, round(avg(abs(x - y)), 10) AS activity FROM pairs GROUP BY frame),
act AS (SELECT case_id, frame, coalesce(activity, 0.0) AS activity FROM patch LEFT JOIN acts USING (frame))
SELECT case_id, frame, row_number() OVER (PARTITION BY case_id ORDER BY activity, frame) <= greatest(10, count(*) OVER (PARTITION BY case_id) // 10) AS quiet, round(activity, 6) AS activity, row_number() OVER (PARTITION BY case_id ORDER BY activity DESC, frame) <= 12 AS top FROM act""")


def q67_luminance_profile(spark, sf):
    v = F.col("v")
    return X.patches(spark, sf).select("case_id", "frame", F.round(V.mean(v), 6).alias("mean"), F.round(F.array_max(v), 6).alias("high"), F.round(V.std(v), 6).alias("std"), F.round(V.percentile(v, 0.95), 6).alias("p95"), F.round(V.share(v, lambda x: x > 0.2), 6).alias("bright_share"))


Q67 = q(PATCH, "SELECT case_id, frame, round(avg(val), 6) AS mean, round(max(val), 6) AS high, round(stddev_pop(val), 6) AS std, round(quantile_cont(val, 0.95), 6) AS p95, round(avg(CAST(val > 0.2 AS INTEGER)), 6) AS bright_share FROM pixel GROUP BY case_id, frame")


def q69_srv_metrics(spark, sf):
    rows = X.patches(spark, sf).select("case_id", C.sharpness(F.col("v")).alias("s"), V.std(F.col("v")).alias("c"), V.share(F.col("v"), lambda x: x < -0.2).alias("masked"), F.col("class_label"))
    g = rows.groupBy("case_id").agg(
        F.count("*").alias("n"), F.avg("s").alias("mean_sharpness"), F.percentile("s", F.lit(0.5)).alias("median_sharpness"), F.max("s").alias("max_sharpness"), F.avg("c").alias("mean_contrast"),
        F.count_if(F.col("class_label").isNull()).alias("not_found"), F.count_if(F.col("class_label") == "hud_artifact").alias("low_confidence"), (F.avg("masked") / (301 * 204)).alias("artifact_score"),
    )
    return g.select("case_id", "n", "not_found", "low_confidence", *rounded("mean_sharpness", "median_sharpness", "max_sharpness", "mean_contrast", places=5), F.round("artifact_score", 9).alias("artifact_score"))


Q69 = q(LAPLACE, """
, r AS (SELECT p.case_id, p.frame, p.class_label, stddev_pop(val) AS c, avg(CAST(val < -0.2 AS INTEGER)) AS masked FROM pixel p GROUP BY 1, 2, 3)
SELECT case_id, count(*) AS n, count(*) FILTER (class_label IS NULL) AS not_found, count(*) FILTER (class_label = 'hud_artifact') AS low_confidence, round(avg(sharpness), 5) AS mean_sharpness, round(quantile_cont(sharpness, 0.5), 5) AS median_sharpness, round(max(sharpness), 5) AS max_sharpness, round(avg(c), 5) AS mean_contrast, round(avg(masked) / (301 * 204), 9) AS artifact_score
FROM r JOIN sharp USING (case_id, frame) GROUP BY case_id""")


def q71_patch_grid_overlap_add(spark, sf):
    grid = C.patch_grid(X.patches(spark, sf))
    return C.overlap_add(grid, V.std(F.col("patch"))).select("case_id", "pos", F.round("value", 6).alias("value"))


Q71 = q(PATCH, """
, w AS (SELECT case_id, frame, px, py, stddev_pop(val) AS s FROM pixel JOIN (SELECT unnest([0, 2, 4]) AS px) ON pos % 8 BETWEEN px AND px + 3 JOIN (SELECT unnest([0, 2, 4]) AS py) ON pos // 8 BETWEEN py AND py + 3 GROUP BY 1, 2, 3, 4),
p AS (SELECT unnest(range(0, 64)) AS pos) SELECT case_id, CAST(pos AS INTEGER) AS pos, round(avg(s), 6) AS value FROM w JOIN p ON pos % 8 BETWEEN px AND px + 3 AND pos // 8 BETWEEN py AND py + 3 GROUP BY 1, 2""")


def q74_sample_union(spark, sf):
    rows = X.patches(spark, sf).select("frame", "class_label")
    objects, controls = rows.where("class_label = 'object'"), rows.where("class_label <> 'object'")
    samples = objects.withColumn("role", F.lit("object")).unionByName(controls.withColumn("role", F.lit("control")))
    left_out = rows.select("frame").exceptAll(samples.select("frame")).withColumns({"class_label": F.lit(None).cast("string"), "role": F.lit("left_out")})
    return samples.unionByName(left_out)


Q74 = q(PATCH, "SELECT frame, class_label, CASE WHEN class_label = 'object' THEN 'object' WHEN class_label IS NOT NULL THEN 'control' ELSE 'left_out' END AS role FROM patch")


def q75_template_match(spark, sf):
    rows = X.patches(spark, sf)
    template = C.mean_crop(rows.where("class_label is not null"), "class_label").withColumnRenamed("class_label", "template_class")
    scored = rows.select("frame", "v").crossJoin(F.broadcast(template)).withColumn("r", F.round(V.correlation(F.col("v"), F.col("template")), 6))
    return scored.groupBy("frame").agg(F.max_by(F.struct("template_class", "r"), F.struct("r", "template_class")).alias("b")).select("frame", "b.template_class", "b.r")


Q75 = q(PATCH, """
, m AS (SELECT class_label AS template_class, pos, avg(val) AS t FROM pixel WHERE class_label IS NOT NULL GROUP BY 1, 2), r AS (SELECT frame, template_class, round(corr(val, t), 6) AS r FROM pixel JOIN m USING (pos) GROUP BY 1, 2)
SELECT frame, arg_max(template_class, (r, template_class)) AS template_class, max(r) AS r FROM r GROUP BY frame""")


def q77_peak_and_centroid(spark, sf):
    return C.peak_and_centre(X.patches(spark, sf)).select("case_id", "frame", "peak", "x0", "x1", "n", *rounded("mass_x", "mass_y"))


Q77 = q(PATCH, """
, c AS (SELECT frame, quantile_cont(val, 0.9) AS cut FROM pixel GROUP BY frame), b AS (SELECT *, val >= cut AS bright, CASE WHEN val >= cut THEN val - cut + 1e-3 END AS mass FROM pixel JOIN c USING (frame))
SELECT case_id, frame, CAST(arg_max(pos, (val, -pos)) AS INTEGER) AS peak, CAST(min(pos % 8) FILTER (bright) AS INTEGER) AS x0, CAST(max(pos % 8) FILTER (bright) AS INTEGER) AS x1, count(*) FILTER (bright) AS n, round(sum(mass * (pos % 8)) / sum(mass), 6) AS mass_x, round(sum(mass * (pos // 8)) / sum(mass), 6) AS mass_y FROM b GROUP BY 1, 2""")


def q78_area_resize(spark, sf):
    small = V.block_mean(F.col("v"), 8, 8, 2)
    return X.patches(spark, sf).select("frame", F.posexplode(small).alias("pos", "val")).select("frame", "pos", F.round("val", 6).alias("val"))


Q78 = q(PATCH, "SELECT frame, CAST((pos // 16) * 4 + (pos % 8) // 2 AS INTEGER) AS pos, round(avg(val), 6) AS val FROM pixel GROUP BY 1, 2")

QUERIES = {k: v for k, v in list(globals().items()) if k.startswith("q") and k[1:3].isdigit()}
ORACLE_SQL = {k: globals()["Q" + k[1:3]] for k in QUERIES}
